"""Toxicity scores against plain arithmetic, on words never seen, on held-out rows and on odd ones."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import registry, toxicity

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, label int, score double, predicted int"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", None, None, 1, 2.0, 3) for i, t in texts], DOCS)


def plain_buckets(text):
    """Every n-gram of every word, one by one."""
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    out, wrap = [], 2**64
    for word in (f" {w} " for w in words):
        for n in toxicity.SIZES:
            for i in range(len(word) - n + 1):
                code = 0
                for c in word[i : i + n]:
                    code = (code * 0x9E3779B97F4A7C15 + ord(c)) % wrap
                code = (code + n) % wrap
                out.append((((code ^ (code >> 32)) * 0xD6E8FEB86659FD93) % wrap) >> (64 - toxicity.BUCKET_BITS))
    return sorted(out)


@pytest.mark.parametrize("at_once", [toxicity.AT_ONCE, 5])
def test_buckets_equal_plain_ngrams(monkeypatch, at_once):
    monkeypatch.setattr(toxicity, "AT_ONCE", at_once)
    draw = random.Random(1)
    texts = ["".join(draw.choice("abÉß日1 .\n\U0001d54f") for _ in range(draw.randint(0, 60))) for _ in range(200)] + ["", " ", "a", "...", "x" * 300]
    for text in texts:
        assert sorted(int(b) for found in toxicity.buckets(text) for b in found) == plain_buckets(text)


def made_up(draw, n, bad):
    word = lambda: "".join(draw.choice(["ka", "lo", "mi", "tu", "re", "sa", "no"]) for _ in range(draw.randint(2, 4)))
    out = []
    for i in range(n):
        words = [word() for _ in range(draw.randint(30, 80))]
        for _ in range(3 if i % 2 else 0):
            words.insert(draw.randrange(len(words)), draw.choice(bad))
        out.append((i % 2, " ".join(words)))
    return out


def test_unseen_misspellings_are_found(spark):
    draw = random.Random(2)
    labelled = spark.createDataFrame(made_up(draw, 800, ["vexquaril", "zyndropht"]), "label int, text string")
    model = toxicity.fit(labelled)
    again = toxicity.fit(labelled.repartition(5))
    assert (model.evidence() == again.evidence()).all() and model.bias() == again.bias()
    unseen = made_up(draw, 100, ["vexquarrill", "zyndr0pht", "vvexquaril"])
    rows = docs_of(spark, list(enumerate(t for _, t in unseen))).select("doc_id", toxicity.probability(spark, F.col("text"), model).alias("p")).collect()
    got = {r.doc_id: r.p for r in rows}
    bad, good = ([got[i] for i, (label, _) in enumerate(unseen) if label == of] for of in (1, 0))
    assert max(good) < min(0.1, min(bad)) and np.mean([p >= 0.7 for p in bad]) > 0.75
    logits, bias = model.evidence(), model.bias()
    for i, (_, text) in enumerate(unseen[:10]):
        b = plain_buckets(text)
        assert abs(got[i] - 1 / (1 + np.exp(-(sum(map(float, logits[b])) / (toxicity.NEUTRAL + len(b)) + bias)))) < 1e-6


def test_query_on_held_out_rows(spark):
    got = {r.doc_id: r for r in registry.QUERIES["op12_toxicity"](spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert got.keys() == {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    unseen = [i for i in labels if got[i].held_out]
    found = {i for i in unseen if got[i].predicted}
    bad = {i for i in unseen if labels[i] == 1}
    assert len(found & bad) >= 0.7 * len(bad) and len(found - bad) <= 0.1 * (len(unseen) - len(bad))  # 33 toxic texts to learn from


def test_odd_rows(spark, tmp_path):
    rows = [(1, None), (1, ""), (None, "plain words"), (4, "..."), (5, "x" * 1_200_000), (5, "ab " * 400_000), (6, "same"), (6, "same")]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, None), (None, 0, 1), (6, None, 0), (77, 0, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op12_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == 8 and {(r.score, r.predicted) for r in got} == {(0.0, 0)}  # one label alone teaches nothing
    model = toxicity.fit(spark.createDataFrame(made_up(random.Random(3), 60, ["vexquaril"]), "label int, text string"))
    scored = docs_of(spark, rows).select("text", toxicity.probability(spark, F.col("text"), model).alias("p")).collect()
    empty = {r.p for r in scored if r.text in (None, "", "...")}
    assert len(empty) == 1 and 0 < empty.pop() < 1 and len({r.p for r in scored if r.text == "same"}) == 1
    assert toxicity.fit(docs_of(spark, []).select("label", "text")) is None
    few = toxicity.sample(docs_of(spark, [*rows, (6, "least")]), labels.withColumnRenamed("toxic", "label"))
    assert [(r.doc_id, r.label, r.text) for r in few.collect()] == [(6, 0, "least")]
    many = spark.range(5_000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), (F.col("id") % 5 == 0).cast("int").alias("label"))
    sizes = dict(toxicity.sample(many, many, 100, 200).groupBy("label").count().collect())
    assert 60 < sizes[1] < 140 and 140 < sizes[0] < 260
