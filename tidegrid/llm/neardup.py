"""Near-duplicate classes by BagMinHash.

A document is the multiset of its five-word shingles. For each shingle, and each
dyadic piece of the weight axis, a Poisson process runs in time; its points fall
on signature places at random, and each place keeps its first time. A process
over a piece of several units splits after its first point into one for each
half, so weights that differ share all points below the smaller one, and no
process runs past the time at which the signature is settled. Equal places are
an unbiased estimate of the weighted Jaccard similarity. Signatures are banded,
and the pairs that a bucket suggests are verified by their multisets' overlap.

To verify, buckets that share texts are grouped and cut into blocks. Two blocks
of a group meet once, in one task, however many buckets they share; there a matrix
product over the shingles that both hold gives the exact overlap of every pair of
their texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, materialize, table, with_row, words
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
#: A pair at the threshold misses all bands with probability (1 - 0.8**5)**25, under 0.0001.
BANDS, ROWS = 25, 5
#: Words of a block, about; each text counts EXTRA words more, which bounds the texts of a block too.
BLOCK, EXTRA = 131_072, 64
#: Blocks that buckets which share texts may make together; beyond, each bucket is compared for itself.
WIDE = 16
#: Words of the part of a block that one product takes on its right side.
PART = 32_768
#: Cells of an incidence matrix held at once.
CELLS = 4_000_000
#: Shingles that a worker signs at once.
AT_ONCE = 100_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in [0, 1)."""
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def shingles(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a document's word hashes, and their counts; fewer words than a shingle are one."""
    n = min(SHINGLE, len(hashes))
    if not n:
        return hashes[:0], np.zeros(0, np.int64)
    mixed = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        mixed = _mix(mixed + hashes[i : len(hashes) - n + 1 + i] + _STEP)
    return np.unique(mixed, return_counts=True)


def _start(element: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return _mix(element ^ _mix(low.astype(np.uint64) * _STEP + high.astype(np.uint64)))


def bag_min_hash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, places: int) -> np.ndarray:
    """First times, docs x places, of documents whose distinct elements have the given whole weights; inf for none."""
    first = np.full(docs * places, np.inf)
    parts = []
    low, high = 0, 1
    while (at := np.flatnonzero(weight > low)).size:
        parts.append((doc[at], element[at], weight[at], np.full(at.size, low), np.full(at.size, high)))
        low, high = high, 2 * high
    if not parts:
        return first.reshape(docs, places)
    doc, element, weight, low, high = (np.concatenate(x) for x in zip(*parts))
    state, time = _start(element, low, high), np.zeros(len(doc))
    while len(doc):
        width = high - low
        units = bool((width == 1).all())
        ahead = min(64, max(1, 40_000 // len(doc))) if units else 1  # several points at once where few processes are left
        steps = state[:, None] + _STEP * np.arange(1, ahead + 1, dtype=np.uint64)
        drawn = _mix(steps)
        gaps = -np.log1p(-_unit(drawn)) / width[:, None]
        times = np.cumsum(np.column_stack([time, gaps]), axis=1)[:, 1:]  # added one by one from 0, so the last bit doesn't depend on ahead
        settled = first.reshape(docs, places).max(axis=1)
        row, col = np.nonzero(times < settled[doc][:, None])
        other = _mix(drawn[row, col] ^ _STEP)
        place = (other % np.uint64(places)).astype(np.int64)
        unit = low[row] + 1 + (_unit(_mix(other)) * width[row]).astype(np.int64)
        kept = unit <= weight[row]
        np.minimum.at(first, doc[row[kept]] * places + place[kept], times[row, col][kept])
        settled = first.reshape(docs, places).max(axis=1)
        on = times[:, -1] < settled[doc]
        doc, element, weight, low, high, state, time, width = (x[on] for x in (doc, element, weight, low, high, steps[:, -1], times[:, -1], width))
        if not units:
            leaf, half = width == 1, (low + high) // 2
            left, right = ~leaf, ~leaf & (half < weight)
            join = lambda a, b, c: np.concatenate([a[leaf], b[left], c[right]])  # noqa: B023, E731
            state = join(state, _start(element, low, half), _start(element, half, high))
            low, high = join(low, low, half), join(high, half, high)
            doc, element, weight, time = (join(x, x, x) for x in (doc, element, weight, time))
    return first.reshape(docs, places)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = signatures.view(np.uint64).reshape(-1, bands, rows)
    key = np.broadcast_to(_mix(np.arange(1, bands + 1, dtype=np.uint64)), bits.shape[:2])
    for r in range(rows):
        key = _mix(key + bits[:, :, r] + _STEP)
    return key.view(np.int64)


def signature(word_hashes: Column, bands: int = BANDS, rows: int = ROWS) -> Column:
    """Band keys ``array<bigint>`` of word hashes; null without words."""

    @F.arrow_udf("array<bigint>")
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            flat, ends = batch.values.to_numpy(zero_copy_only=False).view(np.uint64), batch.offsets.to_numpy()
            cut, keys = 0, [np.zeros((0, bands), np.int64)]
            while cut < len(batch):
                to = max(cut + 1, int(np.searchsorted(ends, ends[cut] + AT_ONCE)) - 1)
                own = [shingles(flat[a:b]) for a, b in zip(ends[cut:to], ends[cut + 1 : to + 1])]
                docs = np.repeat(np.arange(to - cut), [len(x) for x, _ in own])
                first = bag_min_hash(docs, np.concatenate([x for x, _ in own]), np.concatenate([n for _, n in own]), to - cut, bands * rows)
                keys.append(band_keys(first, bands, rows))
                cut = to
            offsets = pa.array(np.arange(0, (len(batch) + 1) * bands, bands, dtype=np.int32))
            yield pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys).reshape(-1)), mask=pa.array(np.diff(ends) == 0))

    return udf(word_hashes)


_find = re.compile(WORD.encode("latin-1")).findall


def bag(text: str) -> Counter:
    """A text's shingle multiset, as words."""
    own = _find(text.encode("utf-8").lower())  # bytes.lower folds A-Z only
    return Counter(zip(*(own[i:] for i in range(SHINGLE)))) if len(own) >= SHINGLE else Counter([tuple(own)] if own else [])


def overlap(a: str, b: str) -> float:
    """Weighted Jaccard similarity of two texts' shingle multisets; 0 if either has no words."""
    x, y = bag(a), bag(b)
    shared = (x & y).total()
    return shared / max(1, x.total() + y.total() - shared)


class Part:
    """Texts of a block with their shingles' names.

    The nth repeat of a shingle in a text has a name of its own, so multisets
    become sets: n and m repeats have min(n, m) names in common. Names are 64-bit
    hashes that hold within a worker.
    """

    def __init__(self, rows: list[tuple[int, int, bytes, np.ndarray]]):
        self.ids, self.classes = (np.array([row[i] for row in rows], np.int64) for i in (0, 1))
        self.bands = np.stack([row[3] for row in rows])
        own = [_find(row[2].lower()) for row in rows]
        sizes = np.array([len(x) for x in own], np.int64)
        flat = np.fromiter((hash(w) for x in own for w in x), np.int64, int(sizes.sum())).view(np.uint64)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        self.sizes = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, np.minimum(sizes, 1))
        doc = np.repeat(np.arange(len(rows)), self.sizes)
        at = np.arange(self.sizes.sum()) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes) + begins[doc]
        length = np.minimum(sizes, SHINGLE)[doc]
        mixed = np.zeros(len(doc), np.uint64)
        for i in range(SHINGLE):
            there = i < length
            mixed[there] = _mix(mixed[there] + flat[at[there] + i] + _STEP)
        order = np.lexsort((mixed, doc))
        mixed, doc = mixed[order], doc[order]
        new = np.ones(len(doc), bool)
        new[1:] = (mixed[1:] != mixed[:-1]) | (doc[1:] != doc[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
        self.doc, self.names = doc, _mix(mixed + _mix((np.arange(len(doc)) - first).astype(np.uint64) * _STEP))


def _shared(a: Part, b: Part) -> np.ndarray:
    """How many names each text of one part shares with each of another."""
    shared = np.zeros((len(a.ids), len(b.ids)), np.float32)
    common = np.intersect1d(a.names, b.names)
    if not len(common):
        return shared

    def columns(part: Part):
        at = np.minimum(np.searchsorted(common, part.names), len(common) - 1)
        held = np.flatnonzero(common[at] == part.names)
        order = held[np.argsort(at[held], kind="stable")]
        return part.doc[order], at[order]

    sides = columns(a), columns(b)
    width = max(64, CELLS // max(shared.shape))
    for begin in range(0, len(common), width):
        matrices = []
        for (doc, at), n in zip(sides, shared.shape):
            x, y = np.searchsorted(at, (begin, begin + width))
            matrix = np.zeros((n, min(width, len(common) - begin)), np.float32)
            matrix[doc[x:y], at[x:y] - begin] = 1
            matrices.append(matrix)
        shared += matrices[0] @ matrices[1].T  # whole numbers under 2**24 are exact
    return shared


def _links(a: Part, b: Part, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of linked texts of different classes, one pair for each pair of classes that has any.

    Linked are texts that are similar and share a band key, whatever else the
    block holds: a pair's link doesn't depend on how its group was cut.
    """
    shared = _shared(a, b).astype(np.float64)
    near = shared / np.maximum(1, a.sizes[:, None] + b.sizes[None, :] - shared) >= similarity
    i, j = np.nonzero(near & (a.classes[:, None] != b.classes[None, :]))
    met = np.zeros(len(i), bool)
    for x, y in zip(a.bands.T, b.bands.T):
        met |= x[i] == y[j]
    i, j = i[met], j[met]
    if len(i):
        low, high = np.minimum(a.classes[i], b.classes[j]), np.maximum(a.classes[i], b.classes[j])
        _, one = np.unique(np.stack([low, high]), axis=1, return_index=True)
        yield a.ids[i[one]], b.ids[j[one]]


def _in_units(similarity: float):
    """Links ``u, v`` of units ``x, y``: all pairs of one block (x = y), or of two, whose sides come one after the other.

    Held at once are the first side, at most a block, and one part of the second.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, side, waiting, words = None, 0, [], 0
        first: list[Part] = []

        def close() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Takes the waiting rows as a part."""
            nonlocal waiting, words
            if waiting:
                part = Part(waiting)
                waiting, words = [], 0
                if side == 0:
                    first.append(part)
                for other in first if side == 1 or unit[0] == unit[1] else ():
                    yield from _links(other, part, similarity)

        def take(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            nonlocal unit, side, words
            xs, ys, sides, ids, classes, sizes = (batch.column(c).to_pylist() for c in ("x", "y", "side", "id", "class", "n"))
            keys = batch.column("bands").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for x, y, s, i, c, n, text, own in zip(xs, ys, sides, ids, classes, sizes, batch.column("text"), keys):
                if (x, y) != unit or s != side or words >= PART:
                    yield from close()
                if (x, y) != unit:
                    first.clear()
                unit, side = (x, y), s
                waiting.append((i, c, text.as_buffer().to_pybytes(), own))
                words += n + EXTRA

        def batch_of(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            none = np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *(pair[k] for pair in found)])) for k in (0, 1)], ["u", "v"])

        for batch in batches:
            yield batch_of(list(take(batch)))
        yield batch_of(list(close()))

    return run


def _verified(dealt: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links ``u < v`` of the texts that ``x, y, side, id, class, n`` deals to units; each unit is one task's at most."""
    held = texts.join(dealt, "id").select("x", "y", "side", "id", "class", "n", "text", "bands")
    found = held.repartition("x", "y").sortWithinPartitions("x", "y", "side").mapInArrow(_in_units(similarity), "u long, v long")
    return materialize(found.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())


def hashed(split: Column) -> Column:
    return F.transform(split, lambda w: F.xxhash64(w))


def _weight() -> Column:
    return F.col("n") + EXTRA


def _homes(crowded: DataFrame) -> DataFrame:
    """``id, n, cell, degree`` of each text: its largest bucket, and the texts of all its buckets."""
    return crowded.groupBy("id", "n").agg(F.max_by("key", F.struct("size", "key")).alias("cell"), F.sum("size").alias("degree"))


def _star_links(homes: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links of the texts of each bucket of several blocks with one of them, the text that shares most buckets.

    Linear in the texts: a large group of near copies is one class after it, and
    needn't be compared with itself. The texts are dealt over units of about a block.
    """
    cells = homes.groupBy("cell").agg(F.sum(_weight()).alias("words"), F.max_by("id", F.struct("degree", -F.col("id"))).alias("pivot"))
    large = materialize(cells.where(F.col("words") > BLOCK).select("cell", "pivot", F.ceil(F.col("words") / BLOCK).alias("slices")))
    own = homes.join(large, "cell").where("id <> pivot").select(F.col("cell").alias("x"), F.pmod(F.xxhash64("id"), F.col("slices")).alias("y"), F.lit(1).alias("side"), "id", F.col("id").alias("class"), "n")
    pivots = large.select(F.col("cell").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("y"), F.lit(0).alias("side"), F.col("pivot").alias("id"), F.col("pivot").alias("class"), F.lit(0).alias("n"))
    return _verified(own.unionByName(pivots), texts, similarity)


def _groups(members: DataFrame) -> DataFrame:
    """``group, id, n, class``: what must be compared, from the ``key, id, n, class`` of mixed buckets.

    Buckets that share texts are one group, so that a text is sent once and not
    once a bucket. Where that makes more than WIDE blocks, each bucket stays a
    group, once for all buckets of the same texts; a text is then in BANDS groups at most.
    """
    mark = (F.count("*"), F.min("id"), F.max("id"), F.sum(F.xxhash64("id").cast("decimal(38,0)")))
    buckets = materialize(members.groupBy("key").agg(F.min("id").alias("lead"), F.struct(*mark).alias("mark")))
    one_each = buckets.groupBy("mark").agg(F.min("key").alias("key"), F.min("lead").alias("lead"))
    held = materialize(members.join(one_each.select("key", "lead"), "key"))
    nodes = materialize(components(held.where("id <> lead").select(F.col("id").alias("u"), F.col("lead").alias("v"))).select(F.col("node").alias("id"), "component"))
    own = held.select("id", "n", "class").distinct().join(nodes, "id")
    wide = materialize(own.groupBy("component").agg(F.sum(_weight()).alias("words")).where(F.col("words") > WIDE * BLOCK).select("component"))
    narrow = own.join(wide, "component", "left_anti").select(F.xxhash64(F.lit("group"), "component").alias("group"), "id", "n", "class")
    apart = held.join(nodes.join(wide, "component", "left_semi").select("id"), "id", "left_semi").select(F.col("key").alias("group"), "id", "n", "class")
    return materialize(narrow.unionByName(apart))


def _block_links(crowded: DataFrame, joined: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links between the classes of each bucket that holds several: every pair of its texts is compared, but pairs of one class.

    A class of more than a block makes blocks of its own, which never meet each
    other; the others of a group share blocks.
    """
    placed = materialize(crowded.join(joined, crowded["id"] == joined["node"], "left").select("key", "id", "n", F.coalesce("component", "id").alias("class")))
    mixed = materialize(placed.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("key"))
    grouped = _groups(materialize(placed.join(mixed, "key", "left_semi")))
    shares = grouped.groupBy("group", "class").agg(F.sum(_weight()).alias("words"))
    rest = shares.groupBy("group").agg(F.sum(F.when(F.col("words") <= BLOCK, F.col("words"))).alias("rest"))
    sizes = materialize(shares.join(rest, "group"))
    solo = F.col("words") > BLOCK
    slot = F.when(solo, F.pmod(F.xxhash64("id"), F.ceil(F.col("words") / BLOCK))).otherwise(F.pmod(F.xxhash64("class"), F.ceil(F.col("rest") / BLOCK)))
    cut = grouped.join(sizes, ["group", "class"]).select("group", "id", "n", "class", F.when(solo, F.col("class")).alias("owner"), slot.alias("slot"))
    blocks = materialize(cut.withColumn("block", F.xxhash64("group", F.coalesce("owner", F.lit(-1)), "slot")).drop("slot"))

    each = blocks.select("group", "block", "owner").distinct()
    a, b = each.select("group", F.col("block").alias("x"), "owner"), each.select("group", F.col("block").alias("y"), F.col("owner").alias("other"))
    units = materialize(a.join(b, "group").where((F.col("x") <= F.col("y")) & ~F.coalesce(F.col("owner") == F.col("other"), F.lit(False))).select("x", "y").distinct())
    sides = materialize(units.select("x", "y", F.lit(0).alias("side"), F.col("x").alias("block")).unionAll(units.where("x <> y").select("x", "y", F.lit(1), "y")))
    dealt = materialize(blocks.join(sides, "block").select("x", "y", "side", "id", "class", "n"))
    return _verified(dealt, texts, similarity)


def row_classes(texts: DataFrame, *carried: str, similarity: float = SIMILARITY) -> DataFrame:
    """``id, <carried>, class`` of each row of ``id, text``; the ids are longs, no two alike and none null.

    The class is the least id of a text's near-duplicates, null for a text
    without words. Texts with the same words in the same order are joined first,
    by a digest, so copies cost one comparison. Every pair of different texts
    that shares a bucket is then compared exactly, or joined already through
    others; pairs that share none are no links, in groups of any size. Nothing is capped. What is shuffled are ids, and the texts that share
    a bucket, once for each block that theirs meets.
    """
    split = texts.select("id", *carried, words(F.col("text")).alias("w"))
    split = split.select("id", *carried, F.unhex(F.sha2(F.array_join("w", " "), 256)).alias("digest"), hashed(F.col("w")).alias("h"))
    signed = materialize(split.select("id", *carried, F.when(F.size("h") > 0, F.col("digest")).alias("digest"), F.size("h").alias("n"), signature(F.col("h")).alias("bands")))
    reps = materialize(signed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"), F.any_value("bands").alias("bands"), F.any_value("n").alias("n")))

    rows = reps.select("id", "n", F.explode("bands").alias("key"))
    full = materialize(rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    crowded = materialize(rows.join(full, "key"))
    homes = materialize(_homes(crowded))
    keyed = reps.select("id", "bands").join(homes.select("id"), "id", "left_semi")
    near = materialize(texts.select("id", "text").join(keyed, "id"))
    star = _star_links(homes, near, similarity)
    joined = components(star)
    more = _block_links(crowded, joined, near, similarity)
    if not more.isEmpty():
        joined = components(star.unionAll(more))
    classes = reps.join(joined, reps["id"] == joined["node"], "left").select("digest", F.coalesce("component", "id").alias("class"))
    return signed.select("id", *carried, "digest").join(classes, "digest", "left").select("id", *carried, "class")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, class_id`` of each row of ``documents``; the class is the least doc_id of the row's near-duplicates.

    Rows are told apart by a key of their own, so repeated rows, and rows that
    repeat an id with another text, are each classed by their own text. A null
    doc_id takes part; its class is null only if no near-duplicate has an id. A
    text without words (null and empty ones included) is a class of its own
    doc_id. Other columns are left out; an empty table gives no rows.
    """
    rows = with_row(docs.select("doc_id", "text"), "id")
    found = materialize(row_classes(rows, "doc_id", similarity=similarity))
    least = materialize(found.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("class_id")))
    return found.join(least, "class", "left").select("doc_id", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``, five-word shingles, similarity 0.8; odd rows as ``near_duplicates`` says."""
    return near_duplicates(table(spark, sf_dir, "documents"))
