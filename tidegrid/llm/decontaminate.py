"""Benchmark decontamination by a distributed positional inverted index.

Two narrow passes over the training texts. The first counts how often each term
of the test items occurs. The second stores postings ``(row, position)`` of the
rarest terms of each test phrase. Phrases are found by intersecting the lists of
their rarest terms, each shifted by the term's place in the phrase; the posting
of the very rarest also holds the words around it, against which what is left is
checked word by word. A phrase of no more terms than are intersected needs no
such check and stores no words. Only postings of rare terms are ever shuffled.

Terms and phrases reach the texts by broadcast. Where they are too many for one,
they go in several, each in a pass of its own, so that neither a text nor all
places of a frequent term are ever shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, broadcast_parts, materialize, table, words

#: Consecutive words of an item that make up a test phrase.
WINDOW_WORDS = 10
#: Rarest terms of a phrase whose postings are intersected.
RAREST = 2


def phrases(items: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """``phrase, terms, item_ids``: distinct windows of ``size`` words of the items and the items that have them.

    An item of fewer words is one phrase; one without words (or null) has none.
    """
    split = items.select(F.col("item_id").alias("item_id"), words(F.col("text")).alias("terms")).where(F.size("terms") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("terms") - (size - 1), F.lit(1)))
    cut = split.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("terms", i, size))).alias("terms"))
    named = cut.groupBy("terms").agg(F.collect_set("item_id").alias("item_ids"))
    return materialize(named.select(F.monotonically_increasing_id().alias("phrase"), "terms", "item_ids"))


def _met(frame: DataFrame, asked: DataFrame, key: str, most: int) -> DataFrame:
    """The frame joined by ``term`` with a written one that is broadcast, in parts by ``key`` if need be."""
    return reduce(DataFrame.unionAll, [frame.join(part, "term") for part in broadcast_parts(asked, key, most)])


def term_counts(rows: DataFrame, terms: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``term, n``: occurrences in all rows, 0 included, of each of the given terms."""
    found = _met(rows.select(F.explode("words").alias("term")), terms, "term", most)
    counted = found.groupBy("term").agg(F.count("*").alias("n"))
    return terms.join(counted, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def probes(cut: DataFrame, counts: DataFrame, rarest: int = RAREST, most: int = BROADCAST_BYTES) -> DataFrame:
    """``phrase, terms, term, place, rank, of``: the rarest terms of each phrase, rank 1 the rarest; ties to the earliest place."""
    placed = cut.select("phrase", "terms", F.posexplode("terms").alias("place", "term"))
    known = _met(placed, counts, "term", most)
    by_rarity = Window.partitionBy("phrase").orderBy("n", "place")
    ranked = known.withColumn("rank", F.row_number().over(by_rarity)).where(F.col("rank") <= rarest)
    return materialize(ranked.withColumn("of", F.least(F.size("terms"), F.lit(rarest))).select("phrase", "terms", "term", "place", "rank", "of"))


def indexed_terms(probe: DataFrame) -> DataFrame:
    """``term, context``: the terms to index, and whether a phrase must be checked by the words around them."""
    return materialize(probe.groupBy("term").agg(F.max((F.col("rank") == 1) & (F.size("terms") > F.col("of"))).alias("context")))


def build_index(docs: DataFrame, used: DataFrame, around: int = WINDOW_WORDS - 1, most: int = BROADCAST_BYTES) -> DataFrame:
    """The stored index: ``row, doc_id, n_words, head, pos, term, near, near_from``.

    ``used`` has the indexed terms and whether they need context. ``near`` holds
    the words up to ``around`` places away, from place ``near_from``. Each row has
    one entry that is its ``head``, its place 0, or with null ``pos`` if it has no
    words; its ``term`` may be null. So every document and its ``n_words`` can be
    read from the index. If the terms take several passes, the texts are written
    once with their row's key.
    """
    parts = broadcast_parts(used.select("term", "context"), "term", most)
    keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    rows = (keyed if len(parts) == 1 else materialize(keyed)).select("row", "doc_id", words(F.col("text")).alias("words"))
    posted = rows.select("row", "doc_id", "words", F.posexplode_outer("words").alias("pos", "term"))
    first = F.greatest(F.col("pos") - around, F.lit(0))

    def postings(part: DataFrame, heads: bool) -> DataFrame:
        head = F.coalesce(F.col("pos") == 0, F.lit(True)) & F.lit(heads)
        kept = posted.join(part, "term", "left" if heads else "inner").where(F.col("context").isNotNull() | head)
        return kept.select(
            "row", "doc_id", F.size("words").cast("long").alias("n_words"), head.alias("head"), "pos",
            F.when(F.col("context").isNotNull(), F.col("term")).alias("term"),
            F.when(F.col("context"), F.slice("words", first + 1, 2 * around + 1)).alias("near"),
            F.when(F.col("context"), first).alias("near_from"),
        )

    return materialize(reduce(DataFrame.unionAll, [postings(part, i == 0) for i, part in enumerate(parts)]))


def _contexts(index: DataFrame, probe: DataFrame, most: int) -> DataFrame:
    """The postings of each longer phrase's rarest term, with the words around them."""
    anchor = probe.where((F.col("rank") == 1) & (F.size("terms") > F.col("of"))).select("phrase", "term", "place", "terms")
    return _met(index.where(F.col("near").isNotNull()).select("row", "term", "pos", "near", "near_from"), anchor, "phrase", most)


def phrase_matches(index: DataFrame, probe: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``row, phrase, start, len``: every occurrence of every phrase, word by word."""
    slim = probe.select("phrase", "term", "place", "of", F.size("terms").alias("len"))
    met = _met(index.where(F.col("term").isNotNull()).select("row", "term", "pos"), slim, "phrase", most)
    shifted = met.select("row", "phrase", "of", "len", (F.col("pos") - F.col("place")).alias("start")).where("start >= 0")
    whole = shifted.groupBy("row", "phrase", "start", "of", "len").agg(F.count("*").alias("lists")).where(F.col("lists") == F.col("of"))
    short = whole.where(F.col("len") == F.col("of")).select("row", "phrase", "start", "len")
    context = _contexts(index, probe, most).withColumn("start", F.col("pos") - F.col("place"))
    exact = F.slice("near", F.greatest(F.col("start") - F.col("near_from") + 1, F.lit(1)), F.size("terms")) == F.col("terms")
    checked = context.where((F.col("start") >= 0) & exact).select("row", "phrase", "start", F.size("terms").alias("len"))
    return short.unionAll(checked.join(whole.where(F.col("len") > F.col("of")).select("row", "phrase", "start"), ["row", "phrase", "start"], "left_semi"))


def proximity_matches(index: DataFrame, probe: DataFrame, slop: int, around: int = WINDOW_WORDS - 1, most: int = BROADCAST_BYTES) -> DataFrame:
    """``row, phrase, pos``: places of a phrase's rarest term with all its terms, in any order, at most ``slop`` words away.

    A term that a phrase repeats need be there once. ``around`` is the one that the
    index was built with; a ``slop`` beyond it, or below 0, is refused. Phrases of
    no more terms than are intersected have no context; all their terms have
    postings, which meet by stretches of ``slop + 1`` words, each with its neighbours.
    """
    if not 0 <= slop <= around:
        raise ValueError(f"slop is {slop}; an index with {around} words around its postings allows 0 to {around}")
    first = F.greatest(F.col("pos") - slop, F.lit(0))
    close = F.slice("near", first - F.col("near_from") + 1, F.col("pos") - first + 1 + slop)
    long = _contexts(index, probe, most).where(F.size(F.array_except("terms", close)) == 0).select("row", "phrase", "pos")

    posted = index.where(F.col("term").isNotNull()).select("row", "term", "pos")
    stretch = lambda pos: F.floor(pos / (slop + 1))
    brief = probe.where((F.col("rank") == 1) & (F.size("terms") == F.col("of"))).select("phrase", "term", F.array_distinct("terms").alias("asked"))
    anchors = _met(posted, brief, "phrase", most).select("row", "phrase", "pos", F.explode("asked").alias("other"), F.size("asked").alias("n"))
    beside = anchors.withColumn("stretch", F.explode(F.sequence(stretch(F.col("pos")) - 1, stretch(F.col("pos")) + 1)))
    others = posted.select("row", F.col("term").alias("other"), F.col("pos").alias("at"), stretch(F.col("pos")).alias("stretch"))
    seen = beside.join(others, ["row", "other", "stretch"]).where(F.abs(F.col("at") - F.col("pos")) <= slop)
    short = seen.groupBy("row", "phrase", "pos", "n").agg(F.count_distinct("other").alias("held")).where(F.col("held") == F.col("n"))
    return long.unionAll(short.select("row", "phrase", "pos"))


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS, rarest: int = RAREST, slop: int | None = None, most: int = BROADCAST_BYTES) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, item_ids, contaminated`` of each row of ``documents``.

    A word inside any occurrence of a phrase is hit. With a ``slop`` there is also
    ``near_ids``: the items with a phrase all of whose terms are at most that many
    words from a place of its rarest one. Repeated rows and null ids are each
    reported; null and empty texts have no words and no hits; empty items or
    documents give no matches; other columns are left out. An item with a null
    item_id hits words and is no item to report; items that share an id are one.
    ``most`` is how many bytes are broadcast at once; it changes no result.
    """
    cut = phrases(items, size)
    terms = materialize(cut.select(F.explode("terms").alias("term")).distinct())
    rows = docs.select(words(F.col("text")).alias("words"))
    probe = probes(cut, materialize(term_counts(rows, terms, most)), rarest, most)
    index = build_index(docs, indexed_terms(probe), size - 1, most)
    found = materialize(phrase_matches(index, probe, most))
    none = F.array().cast("array<bigint>")

    def items_of(matches: DataFrame, name: str) -> DataFrame:
        by_item = matches.select("row", "phrase").distinct().join(cut.select("phrase", F.explode("item_ids").alias("item")), "phrase")
        return by_item.groupBy("row").agg(F.collect_set("item").alias(name))

    upto = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("row", "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(upto), F.lit(0))))
    hits = spans.select("row", fresh.cast("long").alias("new")).groupBy("row").agg(F.sum("new").alias("hit"))
    whole = index.where("head").select("row", "doc_id", "n_words").join(hits, "row", "left").join(items_of(found, "item_ids"), "row", "left")
    near = []
    if slop is not None:
        whole = whole.join(items_of(proximity_matches(index, probe, slop, size - 1, most), "near_ids"), "row", "left")
        near = [F.coalesce("near_ids", none).alias("near_ids")]
    n_hit = F.coalesce("hit", F.lit(0).cast("long"))
    return whole.select(
        "doc_id", F.greatest("n_words", F.lit(0).cast("long")).alias("n_words"), n_hit.alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", none).alias("item_ids"), (n_hit > 0).alias("contaminated"), *near,
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` against whole ``benchmark``; odd rows as ``contamination`` says.

    ``n_near`` counts the items with a window whose words all are, in any order,
    within a window's length of its rarest word.
    """
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=WINDOW_WORDS - 1)
    ids = F.array_join(F.array_sort(F.col("item_ids").cast("array<string>")), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(ids, 256).alias("items_sha256"), "contaminated", F.size("near_ids").cast("long").alias("n_near"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, ws[s:s + 9] AS p FROM b, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS t(s) WHERE len(ws) > 0),
lens AS (SELECT DISTINCT len(p) AS n FROM iw),
dw AS (SELECT r, s, n, ws[s:s + n - 1] AS p FROM w, lens, unnest(generate_series(1, len(ws) - n + 1)) AS t(s)),
m AS (SELECT r, s, n, item_id FROM dw JOIN iw USING (p)),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM m, unnest(generate_series(s, s + n - 1)) AS t(x) GROUP BY r),
i AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY r),
ph AS (SELECT DISTINCT p FROM iw),
placed AS (SELECT p, x, p[x] AS term FROM ph, unnest(generate_series(1, len(p))) AS t(x)),
told AS (SELECT r, ws, x, ws[x] AS term FROM w, unnest(generate_series(1, len(ws))) AS t(x)),
freq AS (SELECT term, count(*) AS n FROM told GROUP BY term),
ranked AS (SELECT p, placed.term, row_number() OVER (PARTITION BY p ORDER BY coalesce(n, 0), x) AS k FROM placed LEFT JOIN freq ON placed.term = freq.term),
near AS (SELECT DISTINCT r, ranked.p FROM told JOIN ranked ON told.term = ranked.term AND k = 1 WHERE list_has_all(ws[greatest(x - 9, 1):x + 9], ranked.p)),
nr AS (SELECT r, count(DISTINCT item_id) AS n_near FROM near JOIN iw ON near.p = iw.p GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM w LEFT JOIN h USING (r) LEFT JOIN i USING (r) LEFT JOIN nr USING (r)
"""
