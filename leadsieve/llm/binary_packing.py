"""Packing without padding or mixed sequences: documents split by the binary form of their length.

A document of n tokens becomes n // capacity pieces of full length and, for the rest, one piece for
each set bit, longest first. Every piece is a sequence of its own whose length is a power of two, so
no sequence crosses documents and none is padded; sequences of equal length share a bucket, from
which batches of equal shape are drawn. Each document is split where it is read: texts and ids meet
no shuffle, and a document of any length or source weighs on no other task.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadsieve.llm.common import PieceModel, id_type, map_batches, small_batches, texts_of, tokenizer
from leadsieve.llm.token_counts import _LETTER, _PIECE, _PLAIN, PROVEN

CAPACITY = 2048
#: Characters after which an unusual text is cut for the library, at the next proven boundary.
SEGMENT = 32_768
#: Distinct words in a generation that a worker keeps, and the longest of them.
CACHE, CACHED_LENGTH = 600_000, 64
#: A sequence id is the task, the number within the task and bucket, and the bucket's exponent.
TASK_SHIFT, NUMBER_SHIFT = 40, 5
#: Sequences of a bucket that are ranked together when batches are drawn.
RANKED_TOGETHER = 1000

_NOT_AFTER = re.compile(r"[\s\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]\Z")
#: No sign of the plain characters below is a space, a letter or a digit; no special string is made of them alone.
_SIMPLE = re.compile(rf"([{_LETTER}]+)([!-/:-@\[-`{{-~]*)")


class _Recent(dict):
    """Answers of `ask`, kept in two generations: a full one becomes the old, and what is asked again moves up."""

    def __init__(self, ask):
        super().__init__()
        self.ask, self.old = ask, {}

    def __missing__(self, word: str) -> bytes | None:
        ids = self.old.get(word, self)
        if ids is self:
            ids = self.ask(word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class ByteEncoder:
    """Ids (little-endian unsigned 32-bit, as bytes) as the library gives them for a byte-level BPE.

    The vocabulary's pattern always cuts between a character that is no white space and a space
    after it. A text is therefore encoded word by word, each distinct word once; a text with a space
    after white space (or after a character that some Unicode version counts as such) goes the long
    way, in pieces of the pattern or, with unusual characters or special strings, to the library.
    """

    def __init__(self, vocabulary: str):
        self.tok = tokenizer(vocabulary)
        special = [x.content for x in self.tok.get_added_tokens_decoder().values()]
        self.whole_only = any(re.search(r"\s", x) for x in special)
        self.unusual = re.compile("|".join([_PLAIN.pattern, *map(re.escape, special)]))
        self.model, self.tokenize = PieceModel(self.tok), self.tok.model.tokenize
        self.words, self.pieces = _Recent(self.word), _Recent(self.piece)

    def ids(self, text: str) -> bytes:
        if self.whole_only:
            return self.encoded(text)
        first, *rest = text.split(" ")
        if rest and _NOT_AFTER.search(first):
            return self.long_way(text)
        try:
            return self.chunk(first) + b"".join(map(self.words.__getitem__, rest))
        except TypeError:  # a None: two blanks in a row
            return self.long_way(text)

    def piece(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.model(piece)]).tobytes()

    def word(self, word: str) -> bytes | None:
        """Ids of a word behind a space; None where a space after it is no sure boundary."""
        if word.isascii() and word.isalpha():  # its bytes stand for themselves
            return array("I", [t.id for t in self.tokenize("\u0120" + word)]).tobytes()
        if found := _SIMPLE.fullmatch(word):  # letters, then at most one run of signs: a piece each
            letters, signs = found.groups()
            return self.words[letters] + self.pieces[signs] if signs else self.piece(" " + word)
        return None if not word or _NOT_AFTER.search(word) else self.chunk(" " + word)

    def chunk(self, text: str) -> bytes:
        if self.unusual.search(text):
            return self.encoded(text)
        return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text)))

    def long_way(self, text: str) -> bytes:
        cuts = [0]
        while cuts[-1] + SEGMENT < len(text) and (found := PROVEN.search(text, cuts[-1] + SEGMENT)):
            cuts.append(found.start())
        return b"".join(self.chunk(text[a:b]) for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True))

    def encoded(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@lru_cache(maxsize=1)
def worker_encoder(vocabulary: str) -> ByteEncoder:
    """One for all tasks of a Python worker, so that they share the words met before."""
    return ByteEncoder(vocabulary)


def binary_pieces(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones first, then one for each set bit."""
    full = n // capacity
    out = [(i * capacity, capacity) for i in range(full)]
    start, rest = full * capacity, n % capacity
    while rest:
        length = 1 << (rest.bit_length() - 1)
        out.append((start, length))
        start, rest = start + length, rest - length
    return out


def binary_sequences(
    docs: DataFrame,
    vocabulary: str = "byte_bpe_50k.json",
    end_id: int = 1,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per sequence: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (0).

    `length` is a power of two up to `capacity` (itself one) and names the bucket; with `with_ids`
    a column `ids` holds the tokens. `sequence_id` is unique in the result of a run. A NULL or empty
    text is the end token alone. Repeated rows and NULL ids have sequences of their own; other
    columns are not read; an empty table gives an empty one. One pass, no shuffle; a task holds the
    ids of one text.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity is a power of two")
    small_batches(docs.sparkSession)
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    fields = [T.StructField(id_col, id_type(docs, id_col)), *(T.StructField(x, T.LongType()) for x in names)]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))

    def make():
        encoder = worker_encoder(vocabulary)
        end = np.array([end_id], dtype="<u4").tobytes()
        task = TaskContext.get().partitionId() << TASK_SHIFT
        numbers = [0] * capacity.bit_length()  # sequences of each bucket so far in this task

        def work(batch):
            row, start, length, crc, tokens, sequence, ids = [], [], [], [], [], [], []
            for i, text in enumerate(texts_of(batch, text_col)):
                data = memoryview(encoder.ids(text) + end)
                n = len(data) // 4
                for at, size in binary_pieces(n, capacity):
                    part = data[4 * at : 4 * (at + size)]
                    bucket = size.bit_length() - 1
                    row.append(i)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(part))
                    tokens.append(n)
                    sequence.append(task + (numbers[bucket] << NUMBER_SHIFT) + bucket)
                    numbers[bucket] += 1
                    if with_ids:
                        ids.append(np.frombuffer(part, dtype="<u4").astype(np.int64))
            out = [batch.column(id_col).take(pa.array(row, pa.int64())), start, length, crc, tokens, sequence, [0] * len(row)]
            return [*out, ids] if with_ids else out

        return work

    return map_batches(docs.select(id_col, text_col), make, T.StructType(fields))


def buckets(sequences: DataFrame) -> DataFrame:
    """(length, sequences, tokens, share) of each bucket; `share` is its part of all tokens."""
    sums = sequences.groupBy("length").agg(F.count(F.lit(1)).alias("sequences"), F.sum("length").alias("tokens"))
    return sums.withColumn("share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy(F.lit(0))))  # a row per bucket


def batches(sequences: DataFrame, tokens: int, seed: int = 0) -> DataFrame:
    """`sequences` (a stored table, read twice) with `batch` and `place`, each batch of one bucket.

    A bucket is put in the order of a seeded hash and cut into batches of `tokens` tokens (one
    sequence at least); only its last batch may hold fewer. A bucket is ranked in hash slices, so
    no task sorts a whole one.
    """
    counts = sequences.groupBy("length").agg(F.count(F.lit(1)).alias("n")).select(
        "length", F.ceil(F.col("n") / RANKED_TOGETHER).cast("int").alias("_slices")
    )
    key = F.xxhash64(F.lit(seed), "sequence_id")
    sliced = sequences.join(counts, "length").withColumn("_slice", F.pmod(key, F.col("_slices"))).drop("_slices")
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    first = sliced.groupBy("length", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    first = first.select("length", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("length", "_slice").orderBy(key, "sequence_id")
    ranked = sliced.withColumn("_rank", F.row_number().over(within) - 1).join(first, ["length", "_slice"])
    rank, per = F.col("_first") + F.col("_rank"), F.greatest(F.lit(1), F.floor(F.lit(tokens) / F.col("length")))
    return ranked.select(*sequences.columns, F.floor(rank / per).cast("long").alias("batch"), (rank % per).cast("long").alias("place"))
