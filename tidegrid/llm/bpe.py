"""Byte-level BPE encoding and decoding by backtracking over longest matches.

Bytes are mapped to Latin-1 characters, so that one Aho-Corasick automaton over
the vocabulary finds every token in a piece. The encoder walks the piece with
the longest match at each position, falls back to shorter prefixes, and steps
back where no token fits. Two adjacent tokens fit if merging their bytes alone
would keep the border between them; that answer is memoised. Every border is
closed at most once, so the work is linear in the piece, and the tokens are the
ones that merging the lowest rank first gives.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Bytes of a memo's generation, about; the older of two is dropped, which bounds memory and never changes results.
MEMO_BYTES = 64_000_000
#: Bytes of a memo's entry beside key and value, about.
ENTRY = 110
#: Characters of the longest piece that is memoised, and pieces of a text that are encoded before a memo may be aged.
MEMO_CHARS, PIECES = 64, 50_000
#: Texts whose tokens a worker hands on at once.
TEXTS = 250


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as lines:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    if [rank for rank, _ in ranked] != list(range(len(ranked))):
        raise ValueError(f"{path}: ranks aren't 0..{len(ranked) - 1}")
    return [token for _, token in ranked]


class _Memo(dict):
    """Two generations of answers; what is asked for moves to the younger one. ``fixed`` answers never age."""

    def __init__(self, make, most: int, fixed: dict):
        super().__init__(fixed)
        self.make, self.most, self.fixed, self.older, self.bytes = make, most, fixed, {}, 0

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= MEMO_CHARS:
            self[key] = value
            self.bytes += ENTRY + sys.getsizeof(key) + sys.getsizeof(value)
        return value

    def age(self) -> None:
        if self.bytes > self.most:
            self.older = dict(self)
            self.clear()
            self.update(self.fixed)
            self.bytes = 0

    def forget(self) -> None:
        """Keep the fixed answers only."""
        self.clear()
        self.update(self.fixed)
        self.older, self.bytes = {}, 0


#: Characters that ``re`` and ``regex`` class differently: numbers that aren't decimal digits, and U+001C to U+001F.
ODD = frozenset(map(chr, [*range(0x1C, 0x20), *(i for i in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(i)) in ("No", "Nl"))]))


class _HasOdd(Exception):
    """A piece holds a character of ODD."""


def splitters(pattern: str) -> tuple:
    """``findall`` of a pattern of Unicode classes: a fast one for texts without ODD, and an exact one.

    ``re`` is several times as fast as ``regex``; without ODD it splits alike
    with ``[^\\W\\d_]`` for letters and ``\\d`` for numbers.
    """
    import regex

    exact = regex.compile(pattern).findall
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
    return exact if "\\p" in plain else re.compile(plain).findall, exact


class Codec:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str, memo_bytes: int = MEMO_BYTES):
        import ahocorasick

        self.tokens, self.ids = tokens, {t: i for i, t in enumerate(tokens)}
        if missing := [b for b in range(256) if bytes([b]) not in self.ids]:
            raise ValueError(f"vocabulary lacks the bytes {missing[:5]}")
        self.size = [len(t) for t in tokens]
        self.shorter = [next((self.ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), -1) for t in tokens]
        self.find, self.find_exactly = splitters(pattern)
        self.matches = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.matches.add_word(t.decode("latin-1"), i)
        self.matches.make_automaton()
        self.left, self.right, self.merged = list(range(len(tokens))), list(range(len(tokens))), {}
        self._learn_merges()
        self.fits = _Memo(self._fits, memo_bytes // 2, {})
        self.pieces = _Memo(self._piece, memo_bytes, dict(self._whole_tokens()))

    def _whole_tokens(self) -> Iterator[tuple[str, bytes]]:
        """Pieces that are tokens themselves: those whose bytes are UTF-8 without ODD."""
        for i, token in enumerate(self.tokens):
            try:
                piece = token.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if ODD.isdisjoint(piece):
                yield piece, array("i", [i]).tobytes()

    def _learn_merges(self) -> None:
        """The last merge that makes each token: the one split whose halves keep their border until then."""
        for i, token in enumerate(self.tokens):
            head = self.shorter[i]
            while head >= 0:
                tail = self.ids.get(token[self.size[head] :])
                if tail is not None and max(head, tail) < i and self._fits((head, tail)):
                    self.left[i], self.right[i], self.merged[head, tail] = head, tail, i
                    break
                head = self.shorter[head]

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether merging the bytes of both tokens keeps the border between them.

        Takes the merges back, latest first; the border falls if the two tokens
        then beside it merge earlier than the merge just taken back.
        """
        a, b = pair
        before = len(self.tokens)
        while True:
            if self.merged.get((a, b), before) < before:
                return False
            whole_a, whole_b = self.right[a] == a, self.right[b] == b
            if whole_a and whole_b:
                return True
            if not whole_a and (whole_b or a > b):
                before, a = a, self.right[a]
            else:
                before, b = b + 1, self.left[b]

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        if piece in self.ids:
            return (self.ids[piece],)
        size, shorter, fits, end = self.size, self.shorter, self.fits, len(piece)
        longest = [0] * end
        for last, token in self.matches.iter(piece.decode("latin-1")):
            longest[last - size[token] + 1] = token
        closed, out, at, token = set(), [], 0, longest[0]
        while at < end:
            before = out[-1] if out else -1
            while token >= 0:
                to = at + size[token]
                if to not in closed and (before < 0 or fits[before, token]):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = to
                token = longest[at] if at < end else -1
            else:
                closed.add(at)
                token = out.pop()
                at -= size[token]
        return tuple(out)

    def _piece(self, piece: str) -> bytes:
        if not ODD.isdisjoint(piece):
            raise _HasOdd
        return array("i", self.encode_piece(piece.encode("utf-8"))).tobytes()

    def encode(self, text: str) -> np.ndarray:
        try:
            pieces, found = self.find(text), []
            for begin in range(0, len(pieces), PIECES):
                self.pieces.age()
                self.fits.age()
                found += map(self.pieces.__getitem__, pieces[begin : begin + PIECES])
            return np.frombuffer(b"".join(found), np.int32)
        except _HasOdd:  # such pieces never enter the memo
            return np.array([i for piece in self.find_exactly(text) for i in self.encode_piece(piece.encode("utf-8"))], np.int32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def _codec(tokens: tuple[bytes, ...], pattern: str, memo_bytes: int) -> Codec:
    return Codec(list(tokens), pattern, memo_bytes)


def _worker_codec(shared) -> Codec:
    """One codec for each worker process, from the broadcast vocabulary."""
    return _codec(*shared.value)


def vocabulary(spark: SparkSession, path: str, pattern: str, memo_bytes: int = MEMO_BYTES):
    """Broadcast a vocabulary; its size is fixed by the rank file. A worker's memos take about three times ``memo_bytes``."""
    return spark.sparkContext.broadcast((tuple(read_ranks(path)), pattern, memo_bytes))


def _as_lists(found: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*found, np.empty(0, np.int32)])))


def _parts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The batches in pieces of TEXTS rows, whose results are small; an empty batch stays one."""
    for batch in batches:
        for begin in range(0, max(1, len(batch)), TEXTS):
            yield batch.slice(begin, TEXTS)


def encode(text: Column, shared) -> Column:
    """Ids ``array<int>`` of whole texts, each match of the pattern encoded for itself; null and empty give none."""

    @F.arrow_udf("array<int>")
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _worker_codec(shared)
        for part in _parts(batches):
            yield _as_lists([codec.encode(x.as_py() or "") for x in part])

    return udf(text)


def decode(ids: Column, shared) -> Column:
    """The bytes of ids; null gives none. An id outside the vocabulary fails the job."""

    @F.arrow_udf("binary")
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _worker_codec(shared)
        for part in _parts(batches):
            yield pa.array([codec.decode(x.values.to_numpy(zero_copy_only=False).tolist()) for x in part], pa.binary())

    return udf(F.coalesce(ids, F.array().cast("array<int>")))


def _both(text: Column, shared, keep: bool = True) -> Column:
    """``struct<ids array<int>, decoded binary>`` of whole texts in one pass: a worker then holds one codec, not one for each way. Without ``keep`` its memos end with the task."""

    @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _worker_codec(shared)
        try:
            for part in _parts(batches):
                found = [codec.encode(x.as_py() or "") for x in part]
                decoded = pa.array([codec.decode(own.tolist()) for own in found], pa.binary())
                yield pa.StructArray.from_arrays([_as_lists(found), decoded], ["ids", "decoded"])
        finally:
            if not keep:
                codec.pieces.forget()
                codec.fits.forget()
                pa.default_memory_pool().release_unused()

    return udf(text)


def tokenize(docs: DataFrame, path: str, pattern: str, memo_bytes: int = MEMO_BYTES, keep: bool = True) -> DataFrame:
    """``doc_id, ids array<int>, decoded binary`` of each row of ``documents``.

    One row for each input row, repeated rows and repeated or null doc_ids
    included; null texts count as empty; other columns are left out. Narrow: no
    shuffle, and memory is bounded by one Arrow batch and the memos, which a worker
    keeps for its next task unless ``keep`` is false.
    """
    shared = vocabulary(docs.sparkSession, path, pattern, memo_bytes)
    return docs.select("doc_id", _both(F.col("text"), shared, keep).alias("_b")).select("doc_id", "_b.ids", "_b.decoded")


def digests(tokenized: DataFrame, *more: str) -> DataFrame:
    return tokenized.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *more,
    )


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole text of ``documents``; odd rows as ``tokenize`` says. An empty table gives no rows."""
    import public_tokenizers

    return digests(tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
