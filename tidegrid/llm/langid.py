"""Language identification by rank-order n-gram profiles.

Each language's profile ranks its most frequent n-grams of one to three letters.
A document's own most frequent n-grams are ranked in the same way; the predicted
language is the one with the least out-of-place distance, the sum over the
document's n-grams of how far their ranks lie apart (the profile's length for
n-grams it lacks).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: N-grams of a profile, and of a document's.
PROFILE = 400
#: Labelled documents of a language, about, that profiles are learned from.
SAMPLE_PER_LANGUAGE = 1_500
#: Bits of a letter in an n-gram's code; a word's end is a blank.
BITS, BLANK = np.int64(21), 0x20
#: Letters of a text that are counted at once.
AT_ONCE = 1_000_000


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)])


def _pieces(text: str) -> Iterator[str]:
    """A long text cut after marks that aren't letters, so that no n-gram is."""
    begin = 0
    while begin < len(text):
        end = min(len(text), begin + AT_ONCE)
        while end < len(text) and text[end - 1].isalpha():
            end += 1
        yield text[begin:end]
        begin = end


def _distinct(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def _gram_codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.concatenate([[BLANK], np.where(_is_letter()[points], points, BLANK), [BLANK]]).astype(np.int64)
    points = points[np.concatenate([[True], (points[1:] != BLANK) | (points[:-1] != BLANK)])]  # one blank between words
    letter = points != BLANK
    pairs = (points[:-1] << BITS) | points[1:]
    triples = ((pairs[:-1] << BITS) | points[2:])[letter[1:-1]]
    return np.concatenate([points[letter], pairs if len(points) > 1 else pairs[:0], triples])


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a text's distinct n-grams, ascending, and their counts; none without letters.

    Letters are lower-cased. One n-gram is a letter; two and three may begin or
    end with a word's end, but don't span words. A code is the letters' code
    points side by side, so n-grams order by length, then by letters.
    """
    found = []
    for piece in _pieces(text.lower()):
        codes = np.sort(_gram_codes(piece))
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1]]))
        found.append((codes[first], np.diff(first, append=len(codes))))
    if len(found) == 1:
        return found[0]
    none = np.zeros(0, np.int64)
    return _distinct(np.concatenate([none, *(c for c, _ in found)]), np.concatenate([none, *(n for _, n in found)]))


def ranked_grams(text: str, most: int = PROFILE) -> np.ndarray:
    """Codes of the text's most frequent n-grams, most frequent first, ties by the code."""
    codes, counts = gram_counts(text)
    return codes[np.argsort(-counts, kind="stable")[:most]]


def learn_profiles(labelled: DataFrame, sample: int = SAMPLE_PER_LANGUAGE, length: int = PROFILE) -> dict[str, list[int]]:
    """Codes of each language's most frequent n-grams, most frequent first.

    Learns from ``text`` and ``lang`` of rows that have both; of each language
    about ``sample`` rows, chosen by a hash of the text. What reaches the driver
    is ``length`` n-grams of each language; of no labelled rows, none.
    """
    known = labelled.select(F.col("text").alias("text"), F.col("lang").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = known.groupBy("lang").agg(F.count("*").alias("rows"))
    chance = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / F.lit(1_000_000)
    chosen = known.join(F.broadcast(sizes), "lang").where(chance < F.lit(sample) / F.col("rows")).select("text", "lang")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, own in batch.groupby("lang"):
                counted = [gram_counts(text) for text in own.text]
                codes, counts = _distinct(np.concatenate([c for c, _ in counted]), np.concatenate([n for _, n in counted]))
                yield pd.DataFrame({"lang": lang, "gram": codes, "n": counts})

    grams = chosen.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = grams.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= length).orderBy("lang", "rank").collect()
    return {lang: [row.gram for row in rows] for lang, rows in groupby(top, lambda row: row.lang)}


def predict(text: Column, profiles: dict[str, list[int]], length: int = PROFILE) -> Column:
    """``struct<lang, score>`` of whole texts.

    ``und`` and 0 for null, for a text without letters, and without any profile.
    The score is 1 less the share of the greatest possible distance. Ties go to
    the language that sorts first.
    """
    ordered = sorted(profiles.items())

    @F.arrow_udf("struct<lang:string,score:double>")
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sides = [(lang, np.sort(np.array(ranked, np.int64)), np.argsort(np.array(ranked, np.int64))) for lang, ranked in ordered]
        for batch in batches:
            langs, scores = [], []
            for value in batch:
                own = ranked_grams(value.as_py() or "", length)
                best, found = float("inf"), "und"
                ranks = np.arange(len(own))
                for lang, codes, places in sides if len(own) else ():
                    at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
                    distance = int(np.where(codes[at] == own, np.abs(places[at] - ranks), length).sum())
                    if distance < best:
                        best, found = distance, lang
                langs.append(found)
                scores.append(min(1.0, max(0.0, 1 - best / (length * len(own)))) if found != "und" else 0.0)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return udf(text)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(4)) == 2


def identify(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """``doc_id, lang_pred, score`` of each row of ``documents``, repeated rows and null ids included. Narrow: no shuffle."""
    return docs.select("doc_id", predict(F.col("text"), profiles).alias("_p")).select("doc_id", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of ``documents``, repeated rows and null ids included; ``und`` and 0 for texts that are null or have no letters.

    Profiles are learned from the rows that aren't held out; a null lang teaches
    nothing. Equal distances go to the language that sorts first. An empty table
    gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    profiles = learn_profiles(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, profiles).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
