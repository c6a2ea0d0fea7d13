"""Personal data by a semi-Markov conditional random field.

Plain patterns give the base spans. Beside them, every segment of up to
``LONGEST`` neighbouring tokens that holds a digit or an at-sign is a candidate.
A text's regions are the stretches that such segments cover; stretches that
overlap are one region, of any length, so none is cut. Features of whole
candidates (digit counts, check sums, groups, what stands before) give each type
a score, and a dynamic programme over the region chooses boundaries and types
jointly. Weights are learned by gradient ascent on the segmentations' likelihood.

The base spans of a bounded sample are the labels, and so are copies of them with
other separators, as people write them (``a @ b.c``, ``10-0-0-1``,
``4111.1111.1111.1111``, ``0044 20 ...``). The patterns can't match those copies,
so they, and not the patterns, teach what the method adds. Base spans stay.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

KINDS = ("email", "ip", "card", "phone")
#: Tokens of the longest entity, and the most characters between neighbouring tokens of a run.
LONGEST, GAP = 7, 3
#: Documents, about, that training regions are drawn from, and regions that the model is fitted on.
SAMPLE_DOCS, SAMPLE_REGIONS = 20_000, 480
#: Tokens of a training region at most; the regions that are searched have no limit.
TRAINING_TOKENS = 64
EPOCHS, RATE, DECAY = 25, 0.15, 0.002

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z0-9._%+-]*[A-Za-z_%][A-Za-z0-9._%+-]*|@")
_MARK = re.compile(r"[0-9]{2,}|@")
_HELD = re.compile(r"[0-9]+|@")
_HINTS = {"email": re.compile(r"mail", re.I), "ip": re.compile(r"\bip\b|host|addr", re.I), "card": re.compile(r"card|visa|iban|pay", re.I), "phone": re.compile(r"phone|tel|call|fax|mobil", re.I)}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the plain patterns, by kind, then start; linear in the text."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:  # a match has one at-sign; it starts where the run of local characters does, or where the last match ended
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, end := m.end()))
        at = text.find("@", max(at + 1, end))
    for run in _DOTTED.finditer(text):
        if run[0].count(".") >= 3:
            out += [("ip", m.start(), m.end()) for m in _IP.finditer(text, run.start(), run.end()) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if len(m[0]) >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def regions(text: str) -> list[list[tuple[int, int]]]:
    """Tokens of each region, in order.

    A run is tokens no more than GAP characters apart; runs without two digits in
    a row or an at-sign have no regions. A candidate lies whole in one region, so
    the best segmentations of the regions are that of the whole run.
    """
    if not _MARK.search(text):
        return []
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    begins = [a for a, _ in tokens]
    breaks = [0, *(i for i, (x, y) in enumerate(zip(tokens, tokens[1:]), 1) if y[0] - x[1] > GAP), len(tokens)]
    marked = {bisect_right(breaks, bisect_right(begins, m.start()) - 1) for m in _MARK.finditer(text)}
    found: list[list[int]] = []
    for m in _HELD.finditer(text):
        at = bisect_right(begins, m.start()) - 1
        if (run := bisect_right(breaks, at)) not in marked:
            continue
        first, last = max(breaks[run - 1], at - LONGEST + 1), min(breaks[run], at + LONGEST)
        if found and first < found[-1][1]:
            found[-1][1] = last
        else:
            found.append([first, last])
    return [tokens[first:last] for first, last in found]


def features(text: str, start: int, end: int) -> list[int]:
    """Indices of the features that hold for a whole candidate; none asks for the separators that a base pattern asks for."""
    span = text[start:end]
    digits = _digits(span)
    groups, before = re.findall(r"[0-9]+", span), text[max(0, start - 24) : start]
    gaps = re.split(r"[0-9]+", span)[1:-1]
    n, letters, after = len(digits), any(c.isalpha() for c in span), text[end : end + 2]
    name, _, host = span.partition("@")
    name, host = name.rstrip(" ([{<"), host.lstrip(" )]}>")
    email = bool(name) and not any(c.isspace() for c in name + host) and (m := _DOMAIN.match(host)) is not None and m.end() == len(host)
    small = bool(groups) and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    tests = (
        True, n < 7, 7 <= n <= 8, 9 <= n <= 12, 13 <= n <= 19, n > 19,
        before.endswith("+"), span.count("@") == 1, email, letters and not email,
        len(groups) == 4 and small and not letters and len(set(gaps)) == 1, small,
        13 <= n <= 19 and not letters and luhn(digits), len(groups) == 1, len(groups) in (3, 4, 5), "(" in span,
        len(set(gaps)) <= 1, before[-1:].isalnum(), after[:1].isalnum(),
        any(c.isspace() for c in span), digits.startswith("0"), before[-1:] == ".", bool(re.match(r"[^A-Za-z0-9\s][0-9]", after)),
        bool(re.search(r"[0-9][^A-Za-z0-9\s]$", before)), any(len(gap) > 1 for gap in gaps), len({len(g) for g in groups[:-1]}) == 1 and len(groups) > 2, before[-1:] == "(",
        *(bool(hint.search(before)) for hint in _HINTS.values()),
    )
    return [i for i, x in enumerate(tests) if x]


N_FEATURES = 27 + len(_HINTS)


def _lattice(text: str, run: list[tuple[int, int]]) -> list[tuple[int, int, list[int]]]:
    """The candidates ``first, end, features`` of a region."""
    held = [bool(_HELD.search(text, a, b)) for a, b in run]
    return [(i, j, features(text, run[i][0], run[j - 1][1])) for i in range(len(run)) for j in range(i + 1, min(len(run), i + LONGEST) + 1) if any(held[i:j])]


def expectations(size: int, segments: list[tuple[int, int]], scores: np.ndarray) -> tuple[np.ndarray, float]:
    """How likely each segment is to be an entity of each kind, and the logarithm of all segmentations' sum.

    ``scores`` is segments x kinds; a token outside entities scores 0.
    """
    total = np.logaddexp.reduce(scores, axis=1) if len(segments) else np.zeros(0)
    forward, backward = [0.0] + [None] * size, [None] * size + [0.0]
    into, out = [[] for _ in range(size + 1)], [[] for _ in range(size + 1)]
    for s, (i, j) in enumerate(segments):
        into[j].append((i, total[s]))
        out[i].append((j, total[s]))
    for j in range(1, size + 1):
        forward[j] = np.logaddexp.reduce([forward[j - 1], *(forward[i] + x for i, x in into[j])])
    for i in range(size - 1, -1, -1):
        backward[i] = np.logaddexp.reduce([backward[i + 1], *(backward[j] + x for j, x in out[i])])
    through = np.array([forward[i] + backward[j] - forward[size] for i, j in segments])
    return np.exp(scores + through[:, None]), float(forward[size])


def fit(sample: list[tuple[str, list[tuple[int, int]], list[tuple[str, int, int]]]]) -> np.ndarray:
    """Weights ``kinds x features`` that make the labelled segmentations likely.

    Each step is label less expectation. Without samples all weights are those
    that find nothing.
    """
    weights = np.zeros((len(KINDS), N_FEATURES))
    weights[:, 0] = -4.0
    cases = []
    for text, run, gold in sample:
        segments = _lattice(text, run)
        matrix = np.zeros((len(segments), N_FEATURES))
        for s, (_, _, own) in enumerate(segments):
            matrix[s, own] = 1
        starts, ends = {a: i for i, (a, _) in enumerate(run)}, {b: i + 1 for i, (_, b) in enumerate(run)}
        label = np.zeros((len(segments), len(KINDS)))
        at, taken = {(i, j): s for s, (i, j, _) in enumerate(segments)}, -1
        for kind, a, b in sorted(gold, key=lambda x: (x[1], KINDS.index(x[0]))):
            a += text[a : a + 1] in "+("
            if (s := at.get((starts.get(a), ends.get(b)))) is not None and a >= taken:
                label[s, KINDS.index(kind)], taken = 1, b
        cases.append((len(run), [x[:2] for x in segments], matrix, label))
    for _ in range(EPOCHS):
        gradient = np.zeros_like(weights)
        for size, segments, matrix, label in cases:
            gradient += (label - expectations(size, segments, matrix @ weights.T)[0]).T @ matrix
        weights += RATE * (gradient / max(1, len(cases)) ** 0.5 - DECAY * weights * len(cases) ** 0.5)
    return weights


def decode(text: str, run: list[tuple[int, int]], weights: np.ndarray) -> list[tuple[str, int, int]]:
    """The best segmentation's entities; ties go to fewer entities, then to the kind listed first."""
    best, back = [0.0] * (len(run) + 1), [None] * (len(run) + 1)
    by_end: dict[int, list[tuple[int, int, float]]] = {}
    for i, j, own in _lattice(text, run):
        scores = weights[:, own].sum(axis=1)
        kind = int(scores.argmax())
        by_end.setdefault(j, []).append((i, kind, float(scores[kind])))
    for j in range(1, len(run) + 1):
        best[j] = best[j - 1]
        for i, kind, score in by_end.get(j, ()):
            if best[i] + score > best[j] + 1e-9:
                best[j], back[j] = best[i] + score, (i, kind)
    out, j = [], len(run)
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            i, kind = back[j]
            out.append((KINDS[kind], run[i][0], run[j - 1][1]))
            j = i
    return out[::-1]


def _varied(kind: str, span: str, draw: random.Random) -> str:
    """The entity as it may be written too, in a form that its base pattern doesn't match."""
    if kind == "email":
        return draw.choice((" @ ", "(@)", "[@]", "@ ")).join(span.split("@"))
    if kind == "ip":
        return draw.choice((" . ", ",", "-", "[.]")).join(span.split("."))
    if kind == "card":
        digits = _digits(span)
        return draw.choice((".", "/", "  ", "--")).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    first, *rest = re.findall(r"[0-9]+", span)
    rest = rest or [first[i : i + 3] for i in range(2, len(first), 3)]
    first = first if rest and first != "".join([first[:2], *rest]) else first[:2]
    return draw.choice((f"00{first} {' '.join(rest)}", f"+{'/'.join([first, *rest])}", f"({first}) {'-'.join(rest)}", f"0{'.'.join([first, *rest])}"))


def perturbed(text: str, spans: list[tuple[str, int, int]], draw: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its entities written in other forms, and where they are then."""
    out, found, at, length = [], [], 0, 0
    for kind, a, b in sorted(spans, key=lambda x: x[1]):
        if a < at:
            continue
        new = _varied(kind, text[a:b], draw)
        length += a - at
        found.append((kind, length, length + len(new)))
        length += len(new)
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), found


def _training_rows(text: str, spans: list[tuple[str, int, int]]) -> list[tuple]:
    rows = []
    for run in regions(text):
        if len(run) <= TRAINING_TOKENS:
            a, b = max(0, run[0][0] - 32), min(len(text), run[-1][1] + 8)
            gold = [(k, s - a, e - a) for k, s, e in spans if s >= a and e <= b]
            rows.append((text[a:b], [x - a for p in run for x in p], [x[0] for x in gold], [x for g in gold for x in g[1:]]))
    return rows


def train(docs: DataFrame) -> np.ndarray:
    """Fit on at most ``SAMPLE_REGIONS`` regions of about ``SAMPLE_DOCS`` documents, chosen by hashes of the text.

    A quarter holds base spans, half the same kinds of spans in other forms, a
    quarter none. Null texts and texts without two digits in a row or an at-sign
    teach nothing; an empty table gives weights that find nothing.
    """
    texts = docs.select(F.col("text").alias("text"))
    share = min(1.0, SAMPLE_DOCS / max(1, texts.count()))
    hashed = texts.where((F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000)) & F.regexp_like("text", F.lit("[0-9]{2}|@")))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch.text:
                spans = base_spans(text)
                rows += [(*row, False) for row in _training_rows(text, spans)]
                if spans:
                    rows += [(*row, True) for row in _training_rows(*perturbed(text, spans, random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass"))))) if row[2]]
            yield pd.DataFrame(rows, columns=["snippet", "run", "kinds", "bounds", "varied"])

    drawn = hashed.mapInPandas(cut, "snippet string, run array<int>, kinds array<string>, bounds array<int>, varied boolean").dropDuplicates(["snippet"])
    group = F.when(F.size("kinds") == 0, "none").when(F.col("varied"), "varied").otherwise("base")
    drawn = materialize(drawn.withColumn("group", group))
    rows = []
    for name, share in (("none", 4), ("base", 4), ("varied", 2)):
        rows += drawn.where(F.col("group") == name).orderBy(F.xxhash64("snippet"), "snippet").limit(SAMPLE_REGIONS // share).collect()
    pair = lambda x: list(zip(x[::2], x[1::2]))
    return fit([(r.snippet, pair(r.run), [(k, a, b) for k, (a, b) in zip(r.kinds, pair(r.bounds))]) for r in rows])


def added_spans(text: str, base: list[tuple[str, int, int]], weights: np.ndarray) -> list[tuple[str, int, int]]:
    """What the model finds beside the base spans; none overlaps one."""
    covered = bytearray(len(text))
    for _, a, b in base:
        covered[a:b] = b"\1" * (b - a)
    return [x for run in regions(text) for x in decode(text, run, weights) if not any(covered[x[1] : x[2]])]


def find(text: Column, weights: np.ndarray) -> Column:
    """``array<struct<kind, start, end, base>>`` of whole texts, by kind as listed, then start; none for null.

    Added spans never overlap a base span.
    """
    rank = {k: i for i, k in enumerate(KINDS)}

    def spans(value: str) -> list[dict]:
        base = base_spans(value)
        added = added_spans(value, base, weights)
        found = [(*x, True) for x in base] + [(*x, False) for x in added]
        return [dict(zip(("kind", "start", "end", "base"), x)) for x in sorted(found, key=lambda x: (rank[x[0]], x[1], x[2]))]

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    @F.arrow_udf("array<struct<kind:string,start:int,end:int,base:boolean>>")
    def udf(texts: pa.Array) -> pa.Array:
        return pa.array([spans(x.as_py() or "") for x in texts], kind)

    return udf(text)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole text of ``documents``, repeated rows and null ids included; null texts count as empty. Narrow: no shuffle after training. An empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", find(F.col("text"), train(docs)).alias("s"))
    base = F.filter("s", lambda x: x["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("s", lambda x: x["base"] & (x["kind"] == kind))).cast("long")
    return found.select("doc_id", *(count(kind).alias(f"n_{kind}") for kind in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))
