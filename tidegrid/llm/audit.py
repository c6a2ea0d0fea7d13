"""Filter interaction audit: what each filter of a chain removes, in every order of the chain.

Each filter keeps, for each part of the corpus and each range of row ids, the
sorted list of the ids that fail it. A galloping merge of a range's lists cuts
them into runs of ids that the same lists hold; the size of any union,
intersection or difference of lists is a sum of those runs, and sums over ranges
are sizes of the whole part. No task holds more than one range's lists, however
large a part is.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, with_row

#: Ids of a range: a part's lists of one range are one group.
RANGE = 4_096
#: Filters of a chain at most, as all their orders are returned.
MOST_FILTERS = 6


def gallop(ids: list[int], begin: int, bound: int) -> int:
    """The first place from ``begin`` on whose id is ``bound`` or more: steps that double, then a search of the last one."""
    step, low = 1, begin
    while low + step < len(ids) and ids[low + step] < bound:
        low += step
        step *= 2
    return bisect_left(ids, bound, low, min(len(ids), low + step))


def runs(lists: list[list[int]]) -> Counter[int]:
    """How many ids exactly the lists of each mask hold (bit i for list i), by a galloping merge of sorted lists without repeats."""
    sizes: Counter[int] = Counter()
    at = [0] * len(lists)
    open_ = [i for i, ids in enumerate(lists) if ids]
    while open_:
        heads = [lists[i][at[i]] for i in open_]
        low = min(heads)
        holders = [i for i, head in zip(open_, heads) if head == low]
        if len(holders) == 1:  # alone up to the next head of another list
            (i,) = holders
            bound = min((head for head in heads if head != low), default=lists[i][-1] + 1)
            end = gallop(lists[i], at[i], bound)
            sizes[1 << i] += end - at[i]
            at[i] = end
        else:
            sizes[sum(1 << i for i in holders)] += 1
            for i in holders:
                at[i] += 1
        open_ = [i for i in open_ if at[i] < len(lists[i])]
    return sizes


def postings(facts: DataFrame, filters: list[str], marks: list[str]) -> DataFrame:
    """``part, range, n`` and a sorted list of ids for each filter and mark, one row for each part and range of RANGE ids.

    ``facts`` has ``row`` (a long no two rows share), ``part``, and a boolean for
    each filter (true where the row fails it) and mark; null counts as false.
    ``n`` counts all rows; a mark's list holds only rows that fail a filter.
    Ids are kept as places in their range.
    """
    failed = F.lit(False)
    for name in filters:
        failed = failed | F.coalesce(F.col(name), F.lit(False))
    holds = {name: F.col(name) for name in filters} | {name: F.col(name) & failed for name in marks}
    place = F.pmod("row", F.lit(RANGE)).cast("int")
    lists = (F.sort_array(F.collect_list(F.when(c, place))).alias(name) for name, c in holds.items())
    return facts.groupBy("part", F.floor(F.col("row") / RANGE).alias("range")).agg(F.count("*").alias("n"), *lists)


def set_sizes(index: DataFrame, filters: list[str], marks: list[str]) -> DataFrame:
    """``part, mask, size``: how many rows of a part exactly the lists of the mask hold; mask 0 counts all rows of the part."""
    names = [*filters, *marks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[tuple[str, int]] = Counter()
            columns = [batch.column(name) for name in names]
            for i, part in enumerate(batch.column("part").to_pylist()):
                found[part, 0] += batch.column("n")[i].as_py()
                for mask, size in runs([c[i].as_py() for c in columns]).items():
                    found[part, mask] += size
            keys = list(found)
            kinds = ((pa.string(), [k[0] for k in keys]), (pa.int32(), [k[1] for k in keys]), (pa.int64(), list(found.values())))
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for kind, v in kinds], ["part", "mask", "size"])

    counted = index.select("part", "n", *names).mapInArrow(run, "part string, mask int, size long")
    return counted.groupBy("part", "mask").agg(F.sum("size").alias("size"))


def interactions(sizes: DataFrame, filters: list[str], marks: list[str]) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, <mark>_lost ..., shapley`` for every order and step.

    A step removes the difference of its filter's list and the union of those
    before it. ``shapley`` is that, summed over all orders. Every part has all
    its rows, zeros included.
    """
    if len(filters) > MOST_FILTERS:
        raise ValueError(f"{len(filters)} filters, more than {MOST_FILTERS}")
    orders = list(permutations(range(len(filters))))
    masks = np.arange(1 << len(filters) + len(marks))
    bit = [(masks >> i & 1).astype(bool) for i in range(len(filters) + len(marks))]
    every = (1 << len(filters)) - 1
    alone = [(masks & every) == 1 << f for f in range(len(filters))]
    steps, shares = [], np.zeros((len(filters), len(masks)), np.int64)
    for order in orders:
        gone = np.zeros(len(masks), bool)
        for f in order:
            steps.append((f, bit[f] & ~gone))
            shares[f] += steps[-1][1]
            gone = gone | bit[f]
    new = np.array([s for _, s in steps], np.int64)
    own = np.array([f for f, _ in steps])
    lost = [new * bit[len(filters) + i] for i in range(len(marks))]
    names = ["kept", "removed", "redundant", "unique_fails", *(f"{mark}_lost" for mark in marks), "shapley"]
    shown = ["".join(filters[f] for f in order) for order in orders for _ in filters]
    numbers = [i + 1 for _ in orders for i in range(len(filters))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, pairs in zip(batch.column("part").to_pylist(), batch.column("sizes").to_pylist()):
                held = np.zeros(len(masks), np.int64)
                for pair in pairs:
                    held[pair["mask"]] = pair["size"]
                n, held[0] = int(held[0]), 0
                removed = new @ held
                kept = n - removed.reshape(len(orders), len(filters)).cumsum(axis=1).ravel()
                fails, unique = (np.array([held[which[f]].sum() for f in range(len(filters))]) for which in (bit, alone))
                made = [kept, removed, fails[own] - removed, unique[own], *(marked @ held for marked in lost), (shares @ held)[own]]
                columns = [pa.array([part] * len(own), pa.string()), pa.array(shown), pa.array(numbers, pa.int32()), *(pa.array(v, pa.int64()) for v in made)]
                yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *names])

    gathered = sizes.groupBy("part").agg(F.collect_list(F.struct("mask", "size")).alias("sizes"))  # a pair for each mask at most
    return gathered.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{name} long" for name in names))


# --- five filters over documents


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of single texts: few words (A), repeated ones (B), capitals (C), marks (D)."""
    n = F.size(_words(text))
    return {
        "A": n < 200, "B": 100 * F.size(F.array_distinct(_words(text))) < 50 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text), "D": text.rlike(r"[#$%&*|]"),
    }


def with_copies(facts: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: whether a smaller ``doc_id`` has the same ``digest``. A null id has no smaller one and is none itself.

    The least id of each digest is combined before the shuffle; only digests that
    repeat are joined, against slim rows, in a join that Spark can split where one
    text has very many copies.
    """
    least = facts.where(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("_least"), F.max("doc_id").alias("_most"))
    repeated = least.where(F.col("_most") > F.col("_least")).drop("_most")
    joined = facts.join(repeated, "digest", "left")
    return joined.withColumn(name, F.coalesce(F.col("doc_id") > F.col("_least"), F.lit(False))).drop("_least")


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of A to D and of E, exact copies, in each source; rows that repeat count each.

    Texts and sources that are null are empty. Texts are the same if their
    SHA-256 is. A document is good or toxic if any label of its id says so; null
    ids have no label. Other columns are left out.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = with_row(docs.select("doc_id", "text", "source"), "row").withColumn("text", text)
    slim = keyed.select("row", "doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2("text", 256)).alias("digest"), *(c.alias(name) for name, c in text_filters(F.col("text")).items()))
    facts = with_copies(materialize(slim), "E")  # read twice: the texts once
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    filters, marks = list("ABCDE"), ["good", "toxic"]
    index = materialize(postings(facts.join(known, "doc_id", "left"), filters, marks))
    return interactions(set_sizes(index, filters, marks), filters, marks)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source of ``documents``, each order of the five filters and each step, one row; odd rows as ``audit_documents`` says.

    An empty table has no sources and gives no rows.
    """
    return audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH x AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
  100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(x.doc_id > min(x.doc_id) OVER (PARTITION BY t), false) AS e
  FROM x LEFT JOIN l ON l.doc_id = x.doc_id),
m AS (SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails,
  count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic FROM f GROUP BY 1, 2),
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (SELECT p.k || q.k || r.k || s.k || t.k AS filter_order FROM k p, k q, k r, k s, k t
  WHERE p.k NOT IN (q.k, r.k, s.k, t.k) AND q.k NOT IN (r.k, s.k, t.k) AND r.k NOT IN (s.k, t.k) AND s.k <> t.k),
g AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before, substr(filter_order, 1, step) AS upto FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
y AS (SELECT part, filter_order, own, CAST(step AS INTEGER) AS step, n, n_good, n_toxic, contains(fails, own) AS hit, contains(fails, own) AND translate(fails, before, '') = fails AS gone,
  fails = own AS only_own, translate(fails, upto, '') = fails AS stays FROM m, g),
z AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE stays), 0) AS kept, coalesce(sum(n) FILTER (WHERE gone), 0) AS removed, coalesce(sum(n) FILTER (WHERE hit AND NOT gone), 0) AS redundant,
  coalesce(sum(n) FILTER (WHERE only_own), 0) AS unique_fails, coalesce(sum(n_good) FILTER (WHERE gone), 0) AS good_lost, coalesce(sum(n_toxic) FILTER (WHERE gone), 0) AS toxic_lost FROM y GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM z
"""
