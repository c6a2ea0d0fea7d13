"""Secret scans over a trigram inverted index.

Each rule's regular expression gives a Boolean query: sets of trigrams, of which
one set must be in a text as a whole for the rule to match there. The stored
index holds, for each trigram that some rule needs, the documents that contain
it. Intersecting postings gives each rule's candidates, and the expression
itself then verifies those; rules without mandatory trigrams scan every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, table, unused, with_row


@dataclass(frozen=True)
class Rule:
    """``regex`` in the syntax that Java, RE2 and Python share; ``group`` must have ``least`` characters or the match is dropped."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


#: Keywords are spelled in both cases letter by letter, so that only ASCII letters fold.
KEYWORD = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
BASE = (
    Rule("assign", rf"""({KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

#: Strings that an exact set may hold before it is cut into trigram sets.
EXACT = 16
Query = frozenset  # of frozensets of trigrams: any of the sets, each as a whole; a set without trigrams asks for nothing


def _both(a: Query, b: Query) -> Query:
    return frozenset(x | y for x, y in product(a, b))


def _grams(strings: set[str]) -> Query:
    return frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


Item = "frozenset[str] | list | None"  # the letters that one place may hold, a group's branches, or anything


def _letter(regex: str, at: int) -> tuple[frozenset[str] | None, int]:
    """The element at ``at`` of a class or a sequence, lower-cased, and what follows; None for a class such as ``\\d``."""
    if regex[at] != "\\":
        return frozenset(regex[at].lower()), at + 1
    if regex[at + 1] == "x":
        return frozenset(chr(int(regex[at + 2 : at + 4], 16)).lower()), at + 4
    if regex[at + 1].isalnum():
        if regex[at + 1] not in "dDwWsS":
            raise ValueError(f"{regex}: no \\{regex[at + 1]} here")
        return None, at + 2
    return frozenset(regex[at + 1]), at + 2


def _class(regex: str, at: int) -> tuple[frozenset[str] | None, int]:
    """A class's letters, None if they are many or excluded ones."""
    held: set[str] | None = None if regex[at] == "^" else set()
    at += regex[at] == "^"
    while regex[at] != "]":
        own, at = _letter(regex, at)
        if regex[at] == "-" and regex[at + 1] != "]":
            _, at = _letter(regex, at + 1)
            own = None
        held = None if held is None or own is None else held | own
    return (frozenset(held) if held and len(held) <= 8 else None), at + 1


def _branches(regex: str, at: int = 0) -> tuple[list, int]:
    """The alternatives from ``at`` to the end or the closing bracket, each a list of ``item, least, most``."""
    found: list[list] = [[]]
    while at < len(regex) and regex[at] != ")":
        if regex[at] == "|":
            found.append([])
            at += 1
            continue
        if regex[at] == "(":
            at += 3 if regex.startswith("(?:", at) else 1
            item, at = _branches(regex, at)
            at += 1
        elif regex[at] == "[":
            item, at = _class(regex, at + 1)
        elif regex[at] == ".":
            item, at = None, at + 1
        elif regex[at] in "^$?*+{":
            raise ValueError(f"{regex}: {regex[at]} isn't known here")
        else:
            item, at = _letter(regex, at)
        least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(regex[at : at + 1], (1, 1))
        if regex[at : at + 1] == "{":
            end = regex.index("}", at)
            low, _, high = regex[at + 1 : end].partition(",")
            least, most, at = int(low), int(high) if high else None if "," in regex[at:end] else int(low), end + 1
        elif regex[at : at + 1] in ("?", "*", "+"):
            at += 1
        found[-1].append((item, least, most))
    return found, at


def _exact(item: Item, least: int, most: int | None) -> set[str] | None:
    """The strings that an element matches, if they are few."""
    if (least, most) == (0, 1):
        inner = _exact(item, 1, 1)
        return None if inner is None else inner | {""}
    if (least, most) != (1, 1) or item is None:
        return None
    if isinstance(item, frozenset):
        return set(item)
    branches = [_strings(b) for b in item]
    return None if None in branches else set().union(*branches)


def _strings(sequence: list) -> set[str] | None:
    found = {""}
    for element in sequence:
        if (own := _exact(*element)) is None or len(found) * len(own) > EXACT:
            return None
        found = {a + b for a, b in product(found, own)}
    return found


def _needs(item: Item, least: int, most: int | None) -> Query:
    if least >= 1 and isinstance(item, list):
        return frozenset().union(*(_query(b) for b in item))
    return frozenset({frozenset()})


def _query(sequence: list) -> Query:
    query, run = frozenset({frozenset()}), {""}
    for element in sequence:
        own = _exact(*element)
        if own is not None and len(run) * len(own) <= EXACT:
            run = {a + b for a, b in product(run, own)}
        else:
            query = _both(_both(query, _grams(run)), _needs(*element) if own is None else frozenset({frozenset()}))
            run = {""} if own is None else own
    return _both(query, _grams(run))


def trigram_query(regex: str) -> list[frozenset[str]]:
    """Sets of lower-case trigrams, one of which any match holds as a whole; none if trigrams aren't mandatory.

    Reads letters, escapes, classes, groups, alternatives and repeats; of an
    expression with anything else, such as anchors, it says nothing, so that its
    rule scans every text.
    """
    try:
        query = frozenset().union(*(_query(b) for b in _branches(regex)[0]))
    except (ValueError, IndexError):
        return []
    return [] if frozenset() in query else sorted((q for q in query if not any(o < q for o in query)), key=sorted)


def build_index(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The stored index ``trigram, doc_id``, one posting for each trigram of the rules' queries and row that contains it.

    The trigrams are fixed by the rules; texts are lower-cased, so that one index serves either case.
    """
    wanted = sorted({g for rule in rules for clause in trigram_query(rule.regex) for g in clause})
    if not wanted:
        return docs.select(F.lit("").alias("trigram"), "doc_id").where(F.lit(False))
    low = docs.select(F.col("doc_id").alias("doc_id"), ascii_lower(F.col("text")).alias("low"))
    held = F.concat(*(F.when(F.contains("low", F.lit(g)), F.array(F.lit(g))).otherwise(F.array().cast("array<string>")) for g in wanted))
    return materialize(low.select("doc_id", F.explode(held).alias("trigram")).select("trigram", "doc_id"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``doc_id, kinds``: the rules whose query a document meets, by intersecting the postings of each clause."""
    clauses = [(rule.kind, f"{rule.kind}/{i}", g, len(clause)) for rule in rules for i, clause in enumerate(trigram_query(rule.regex)) for g in sorted(clause)]
    spark = index.sparkSession
    asked = spark.createDataFrame(clauses, "kind string, clause string, trigram string, needed long")
    met = index.join(F.broadcast(asked), "trigram").groupBy("doc_id", "kind", "clause", "needed").agg(F.count_distinct("trigram").alias("n"))
    return met.where(F.col("n") == F.col("needed")).groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def spans_of(text: Column, rule: Rule) -> Column:
    """``array<struct<start, end, kind>>`` of a rule's matches, leftmost first, in code points with the end exclusive."""
    whole, pieces = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0)), F.split(text, rule.regex, -1)
    values = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)) if rule.group else whole
    zipped = F.zip_with(F.arrays_zip(whole.alias("m"), values.alias("v")), F.slice(pieces, 1, F.size(whole)), lambda m, before: F.struct(F.length(before).alias("gap"), F.length(m["m"]).alias("size"), F.length(m["v"]).alias("value")))
    empty = F.array().cast("array<struct<start:int,end:int,kind:string>>")

    def add(state: Column, m: Column) -> Column:
        start = state["at"] + m["gap"]
        end = start + m["size"]
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(m["value"] >= rule.least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    found = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), empty.alias("spans")), add, lambda state: state["spans"])
    return F.when(F.regexp_like(text, F.lit(rule.regex)), found).otherwise(empty)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, spans: str = "_spans") -> DataFrame:
    """The input's rows and columns, with ``spans array<struct<start, end, kind>>`` by start, then by the rules' order.

    Null texts count as empty. The index names rows, not doc_ids, so repeated
    rows and null ids are each scanned for what their own text holds. ``spans``
    may not be a column already; other columns may have any name.
    """
    indexed = tuple(rule for rule in rules if trigram_query(rule.regex))
    rank = {rule.kind: i for i, rule in enumerate(rules)}
    row, doc, kinds = (unused(name, docs) for name in ("_row", "_doc", "_kinds"))
    rows = with_row(docs, row)
    chosen = materialize(candidates(build_index(rows.select(F.col(row).alias("doc_id"), "text"), indexed), indexed).select(F.col("doc_id").alias(doc), F.col("kinds").alias(kinds)))
    joined = rows.join(chosen, rows[row] == chosen[doc], "left")
    text, none = F.coalesce(joined["text"], F.lit("")), F.array().cast("array<struct<start:int,end:int,kind:string>>")
    wanted = lambda rule: F.array_contains(joined[kinds], rule.kind) if rule in indexed else F.lit(True)
    found = [F.when(F.coalesce(wanted(rule), F.lit(False)), spans_of(text, rule)).otherwise(none) for rule in rules]
    order = lambda x: F.struct(x["start"], reduce(lambda c, r: c.when(x["kind"] == r, rank[r]), list(rank)[1:], F.when(x["kind"] == list(rank)[0], 0)))
    by_order = F.array_sort(F.concat(*found), lambda a, b: F.when(order(a) < order(b), -1).when(order(a) > order(b), 1).otherwise(0))
    return joined.select(*(joined[c] for c in docs.columns), by_order.alias(spans))


def digest_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole text of ``documents``; odd rows as ``scan`` says. An empty table gives no rows."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("_spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("_spans", lambda x: x["kind"].isin([r.kind for r in BASE]))
    return found.select("doc_id", *(count(r.kind).alias(f"n_{r.kind}") for r in BASE), F.sha2(digest_of(base), 256).alias("base_sha256"), digest_of(F.col("_spans")).alias("spans"))
