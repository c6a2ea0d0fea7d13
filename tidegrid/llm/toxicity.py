"""Toxicity by averaged subword embeddings and a linear softmax.

A text is the bag of its words' character n-grams, ends of words included. Each
n-gram's bucket has an embedding; their average goes through a linear layer and a
softmax. Embeddings and layer are trained jointly, in numpy, on a bounded sample
of labelled texts. A misspelt word shares most of its n-grams, and so their
embeddings, with the words that were learned.

The sample is dealt to folds; a network is trained without each of them, and the
logits that it gives the fold set how steep the final score is. The score is that
of the networks' mean logit. As the layers are linear, the logit of an average is
the average of the n-grams' logits: the executors get one number for each bucket.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Lengths of n-grams, a word's ends counted as a character each.
SIZES = (3, 4, 5)
#: Bits of a bucket; dimensions of an embedding.
BUCKET_BITS, DIMENSIONS = 20, 8
#: Texts that are learned from at most, about: of label 1 and of label 0.
SAMPLE, SAMPLE_OTHER = 1_200, 3_000
#: Characters of the sample, about, at most; and of a text that is learned from.
SAMPLE_CHARACTERS, LONGEST = 16_000_000, 50_000
#: N-grams without meaning that every average holds besides its own, so that a few n-grams decide little.
NEUTRAL = 60
#: Folds of the sample, passes over it, step sizes, decay of an embedding at each use.
FOLDS, PASSES, STEP, LAYER_STEP, BIAS_STEP, DECAY = 3, 8, 600.0, 0.05, 0.05, 1e-3
#: Characters of a text that are hashed at once.
AT_ONCE = 500_000
BLANK = np.uint64(0x20)
_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _in_word() -> np.ndarray:
    return np.array([chr(i).isalnum() for i in range(sys.maxunicode + 1)])


def _pieces(text: str) -> Iterator[str]:
    """A long text cut after characters that no word holds, so that no n-gram is."""
    begin = 0
    while begin < len(text):
        end = min(len(text), begin + AT_ONCE)
        while end < len(text) and text[end - 1].isalnum():
            end += 1
        yield text[begin:end]
        begin = end


def _buckets(piece: str) -> np.ndarray:
    points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.concatenate([[0x20], np.where(_in_word()[points], points, 0x20), [0x20]]).astype(np.uint64)
    blank = points == BLANK
    points = points[np.concatenate([[True], ~(blank[1:] & blank[:-1])])]  # one blank between words
    blanks, out, code = np.cumsum(points == BLANK), [], points
    for n in range(2, max(SIZES) + 1):
        if len(points) < n:
            break
        code = code[: len(points) - n + 1] * _FACTOR + points[n - 1 :]
        if n in SIZES:
            inside = code[blanks[n - 2 : len(points) - 1] == blanks[: len(points) - n + 1]]  # no blank but at its ends
            mixed = inside + np.uint64(n)
            out.append((((mixed ^ (mixed >> np.uint64(32))) * _MIX) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def buckets(text: str) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of a lower-cased text's words, in pieces; words are runs of letters and digits."""
    for piece in _pieces(text.lower()):
        yield _buckets(piece)


@dataclass(frozen=True)
class Network:
    """Buckets with an embedding, the embeddings (a row each), and the layer's two rows and biases, for labels 0 and 1."""

    known: np.ndarray
    embeddings: np.ndarray
    layer: np.ndarray
    bias: np.ndarray


@dataclass(frozen=True)
class Classifier:
    """Networks whose mean logit, by ``slope`` and ``offset``, gives the probability of label 1."""

    networks: list[Network]
    slope: float
    offset: float

    def evidence(self) -> np.ndarray:
        """What each bucket adds to the logit: its embedding through the layers; 0 for buckets that weren't learned."""
        every = np.zeros(1 << BUCKET_BITS, np.float32)
        for network in self.networks:
            every[network.known] += self.slope / len(self.networks) * (network.embeddings @ (network.layer[1] - network.layer[0]))
        return every

    def bias(self) -> float:
        return self.offset + self.slope * float(np.mean([n.bias[1] - n.bias[0] for n in self.networks]))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 0) -> Network:
    """Trains on bags, each the distinct buckets of a text and their counts, by stochastic descent.

    Both labels count alike, however many texts they have. Only n-grams of several
    texts are learned. Steps of an embedding are scaled by the root of how rare
    its n-gram is, and shrink to 0 over the passes.
    """
    weight = len(labels) / 2 / np.maximum(1, np.bincount(labels, minlength=2))
    seen = np.bincount(np.concatenate([np.zeros(0, np.int32), *(b for b, _ in bags)]), minlength=1 << BUCKET_BITS)
    known = np.flatnonzero(seen >= min(8, max(3, len(bags) // 500)))
    row = np.full(1 << BUCKET_BITS, -1, np.int32)
    row[known] = np.arange(len(known))
    inputs, mean = [], np.zeros(len(known))
    for b, n in bags:
        kept = row[b] >= 0
        inputs.append((row[b[kept]], (n[kept] / (NEUTRAL + n.sum())).astype(np.float32)))
        mean[inputs[-1][0]] += inputs[-1][1] / len(bags)
    scale = np.sqrt(np.median(mean) / mean).astype(np.float32) if len(mean) else mean
    draw = np.random.default_rng(seed)
    embeddings, bias = np.zeros((len(known), DIMENSIONS), np.float32), np.zeros(2, np.float32)
    layer = draw.normal(0, 0.3, (2, DIMENSIONS)).astype(np.float32)
    for turn in range(PASSES):
        fading = 1 - turn / PASSES
        for i in draw.permutation(len(inputs)):
            at, share = inputs[i]
            own = embeddings[at]
            hidden = share @ own
            z = layer @ hidden + bias
            error = np.exp(z - z.max())
            error /= error.sum()
            error[labels[i]] -= 1
            error *= weight[labels[i]]
            embeddings[at] = own * (1 - DECAY * fading) - (STEP * fading * share * scale[at])[:, None] * (error @ layer)
            layer -= LAYER_STEP * fading * np.outer(error, hidden)
            bias -= BIAS_STEP * fading * error
    return Network(known, embeddings, layer, bias)


def calibrate(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve from logits to labels, both labels counting alike, by Newton steps; targets fall short of 0 and 1, so that it stays finite."""
    n = np.bincount(labels, minlength=2)
    target = np.where(labels == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    weight = np.where(labels == 1, 1 / max(1, n[1]), 1 / max(1, n[0]))
    x, found = np.column_stack([logits, np.ones(len(logits))]), np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ found, -50, 50)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), x.T @ (weight * (p - target)))
        found = found - step * min(1, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return float(max(found[0], 0.0)), float(found[1])  # never against the networks


def cross_fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Classifier:
    """A network without each fold of the texts, dealt by label, and the curve of what they say of the folds they haven't seen."""
    fold = np.zeros(len(labels), int)
    for label in (0, 1):
        fold[labels == label] = np.arange((labels == label).sum()) % FOLDS
    networks, logits = [], np.zeros(len(labels))
    for k in range(FOLDS):
        inside = np.flatnonzero(fold != k)
        networks.append(train([bags[i] for i in inside], labels[inside], seed=k))
        alone = Classifier(networks[-1:], 1.0, 0.0)
        evidence, bias = alone.evidence(), alone.bias()
        for i in np.flatnonzero(fold == k):
            b, n = bags[i]
            logits[i] = (evidence[b] @ n) / (NEUTRAL + n.sum()) + bias
    return Classifier(networks, *calibrate(logits, labels))


def _chance(key: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) / F.lit(1_000_000)


def sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, other: int = SAMPLE_OTHER) -> DataFrame:
    """``doc_id, label, text`` of about ``sample`` ids of label 1 and ``other`` of label 0.

    Ids are drawn by their hash, from ``labels`` (``doc_id, label``) alone, and
    sent to the texts: a bounded number. An id that repeats is one text, the
    least; with several labels it has the greatest. Null ids, labels and texts,
    and texts beyond LONGEST, teach nothing.
    """
    known = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = dict(known.groupBy("label").count().collect())  # of two labels
    wanted = lambda label: (sample if label == 1 else other) / max(1, counts.get(label, 0))
    drawn = known.where(_chance("doc_id", 1) < F.when(F.col("label") == 1, wanted(1)).otherwise(wanted(0)))
    texts = docs.select("doc_id", "text").where(F.length("text").between(1, LONGEST)).join(F.broadcast(drawn), "doc_id")
    found = materialize(texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")))
    characters = found.agg(F.sum(F.length("text"))).first()[0] or 0
    return found.where(_chance("doc_id", 2) < SAMPLE_CHARACTERS / max(1, characters))


def fit(labelled: DataFrame) -> Classifier | None:
    """A classifier of ``label, text``, which ``sample`` bounds; None without texts of both labels. The bags are counted in tasks, and trained on in one process."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                b, n = np.unique(np.concatenate([np.zeros(0, np.int32), *buckets(text or "")]), return_counts=True)
                found.append((b.tobytes(), n.astype(np.int32).tobytes()))
            columns = [batch.column("label"), *(pa.array([f[i] for f in found], pa.binary()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["label", "buckets", "counts"])

    counted = labelled.select(F.col("label").cast("int").alias("label"), "text").mapInArrow(bags, "label int, buckets binary, counts binary")
    rows = sorted(counted.collect(), key=lambda r: (r.label, bytes(r.buckets), bytes(r.counts)))  # the same order however it was partitioned
    labels = np.array([r.label for r in rows], int)
    if len(set(labels)) < 2:
        return None
    return cross_fit([(np.frombuffer(r.buckets, np.int32), np.frombuffer(r.counts, np.int32)) for r in rows], labels)


def probability(spark: SparkSession, text: Column, model: Classifier | None) -> Column:
    """The probability of label 1 for whole texts: the bias alone decides where there is no word; 0 without a model."""
    if model is None:
        return F.lit(0.0)
    shared, bias = spark.sparkContext.broadcast(model.evidence()), model.bias()

    @F.arrow_udf("double")
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        evidence = shared.value
        for batch in batches:
            logits = []
            for value in batch:
                total, n = 0.0, NEUTRAL
                for found in buckets(value.as_py() or ""):
                    total += float(evidence[found].sum(dtype=float))
                    n += len(found)
                logits.append(total / n + bias)
            yield pa.array(1 / (1 + np.exp(-np.clip(np.array(logits, float), -700, 700))), pa.float64())

    return udf(text)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(3)) == 1


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of ``documents``, repeated rows and null ids included, scored by its text alone; null and empty texts get what a text without words gets.

    Learned from labels of ids that aren't held out; without texts of both labels
    every score is 0. An empty table gives no rows.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where(~held_out(F.col("doc_id")))
    score = probability(spark, F.col("text"), fit(sample(docs, known)))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))
