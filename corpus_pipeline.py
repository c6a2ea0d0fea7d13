"""A training-data pipeline: five stages over ``documents``, each written as Parquet and read again.

1. Language identification: rows without a letter to judge by are rejected.
2. Near-duplicates: of each class the row with the least doc_id stays.
3. Decontamination: rows that hold a benchmark phrase go.
4. Secret scans: secrets are masked in the text; the documents stay.
5. Byte-level BPE: token ids, and the text decoded from them.
"""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import bpe, decontaminate, langid, neardup, secrets
from tidegrid.llm.common import WORD, materialize, table, unused, with_row

MASK = "[secret]"
#: Bytes of a memo's generation in the encoding stage, which shares its executors' memory with the stages before.
MEMO_BYTES = 8_000_000
#: Bytes of a batch that goes to a Python worker, in all stages: texts lie there several times over, outside the heap.
BATCH_BYTES = 4_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows whose language can be told; profiles are learned from the stage's own input.

    Null texts and texts without a letter go; every other row stays, repeated
    rows, null ids and all columns included. Without any labelled row no language
    can be told, and all rows go.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    profiles = langid.learn_profiles(docs)
    return docs.where(langid.predict(docs["text"], profiles)["lang"] != "und")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class, of the least doc_id; null ids come last, ties go to the least hash of the text, then to any one.

    Classes are of rows, whatever their ids. Rows without words (null and empty
    texts included) have no class; of those that repeat both id and text one
    stays, unless the id is null. All columns stay, whatever their names; an
    empty table stays empty.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    row = unused("_row", docs)
    rows = with_row(docs, row)
    worded = F.coalesce(F.regexp_like("text", F.lit(WORD)), F.lit(False))
    alone = F.when(~worded & F.col("doc_id").isNotNull(), F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2("text", 256)))
    texts = rows.select(F.col(row).alias("id"), "text", "doc_id", alone.alias("alone"), F.xxhash64("text").alias("hash"))
    found = materialize(neardup.row_classes(texts, "doc_id", "alone", "hash"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash", "id")
    group = F.coalesce("class", F.when(F.col("alone").isNull(), F.col("id")))
    kept = found.groupBy("alone", group.alias("group")).agg(F.min(order).alias("first")).select("first.id")
    dropped = materialize(found.select("id").join(kept, "id", "left_anti"))
    return rows.join(dropped, rows[row] == dropped["id"], "left_anti").drop(row)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that hold a benchmark phrase, and no others that share their id.

    Each row is judged by its own text, repeated rows and null ids included; null
    and empty texts hold nothing and stay. All columns stay, whatever their names.
    """
    row = unused("_row", docs)
    rows = with_row(docs, row)
    found = decontaminate.contamination(rows.select(F.col(row).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    hit = materialize(found.where("contaminated").select(F.col("doc_id").alias("hit")))
    return rows.join(hit, rows[row] == hit["hit"], "left_anti").drop(row)


def secret_masks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every span, overlapping ones as one; ``n_chars`` follows the text. All rows and columns stay, null texts as they are."""
    spans = unused("_spans", docs)
    scanned = secrets.scan(docs, spans=spans)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    text = F.col("text")

    def add(state, span):
        begin = F.greatest(span["start"], state["at"])
        piece = F.concat(text.substr(state["at"] + 1, begin - state["at"]), F.when(span["end"] > state["at"], F.lit(MASK)).otherwise(F.lit("")))
        return F.struct(F.greatest(span["end"], state["at"]).alias("at"), F.concat(state["text"], piece).alias("text"))

    masked, held = unused("_masked", scanned), F.size(spans) > 0
    whole = F.aggregate(spans, start, add, lambda s: F.concat(s["text"], text.substr(s["at"] + 1, F.length(text))))
    made = scanned.withColumn(masked, F.when(held, whole))
    own = {"text": F.coalesce(masked, "text").alias("text"), "n_chars": F.when(held, F.length(masked).cast("long")).otherwise(F.col("n_chars")).alias("n_chars")}
    return made.select(*(own.get(c, F.col(c)) for c in docs.columns))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, ids`` of each row, repeated rows and null ids included; null texts have no tokens."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    made = bpe.tokenize(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, MEMO_BYTES, keep=False)
    return bpe.digests(made, "ids")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_masks),
    ("encoding", encoding),
]

#: None: SQL expresses neither the signatures nor the merges; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    staged = lambda docs, stage: materialize(stage[1](spark, docs, sf_dir))
    return reduce(staged, STAGES, docs)
