"""Token counts of whole texts; huge texts are encoded in overlapping chunks and spliced.

A byte-level BPE never merges across the pieces its pre-tokenizer cuts, and that pre-tokenizer
always cuts between a character that is not white space and white space after it: no piece holds
both, whatever stands around them. Such a place is a *proven* boundary. Two neighbouring chunks
are spliced at a proven boundary in their overlap at which both encodings also have a token edge.
An overlap without one is widened to the left, at most to the last splice, where encoding afresh
is exact. A text without any white space thus ends as one chunk.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadsieve.llm.common import PieceModel, id_type, map_batches, texts_of, tokenizer

#: Texts with more characters than this are encoded in chunks.
HUGE = 32_768
CHUNK = 16_384
OVERLAP = 256
#: Tokens of distinct pieces kept by a worker.
CACHE = 1_000_000

#: White space that every Unicode version knows, after a character that is surely none.
PROVEN = re.compile(r"(?<=[^\s\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff])[ \t\r\n]")

#: Characters whose class (letter, digit, white space, other) has never changed between Unicode
#: versions, so that this pattern cuts texts made of them exactly as the vocabulary's own does.
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\u024f\u2010-\u2027\u2030-\u205e\u20ac]")
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECE = re.compile(
    rf" ?[{_LETTER}]+| ?[{_DIGIT}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s{_LETTER}{_DIGIT}]+|\s+(?!\S)|\s+"
)


def splice(text: str, encode, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int]:
    """Tokens of the text by overlapping chunks, and how often an overlap was widened.

    `encode(part)` returns the starts and ends of the part's tokens, in characters.
    """
    overlap = min(overlap, chunk // 2)
    total, widened = 0, 0
    done = 0  # the last splice: everything before it is counted
    start, end = 0, min(len(text), chunk)
    starts, ends = encode(text[start:end])
    starts, ends = starts + start, ends + start
    while end < len(text):
        next_end = min(len(text), end + chunk - overlap)
        reach = overlap
        while True:
            next_start = max(done, end - reach)
            right_starts, right_ends = encode(text[next_start:next_end])
            right_starts, right_ends = right_starts + next_start, right_ends + next_start
            if next_start == done:  # encoded afresh from a splice: exact, nothing left of it to count
                break
            shared = [m.start() for m in PROVEN.finditer(text, next_start, end)]
            cut = next(
                (p for p in reversed(shared) if p > next_start and _edge(starts, ends, p) and _edge(right_starts, right_ends, p)),
                None,
            )
            if cut is not None:
                total += int(((ends <= cut) & (starts >= done)).sum())
                done = cut
                break
            widened += 1
            reach *= 2
        starts, ends, end = right_starts, right_ends, next_end
    return total + int((starts >= done).sum()), widened


def _edge(starts: np.ndarray, ends: np.ndarray, place: int) -> bool:
    """No token lies across the place, and one begins there."""
    i = int(np.searchsorted(starts, place))
    return i < len(starts) and int(starts[i]) == place and (i == 0 or int(ends[i - 1]) <= place)


class Counter:
    """Counts tokens as the vocabulary's library does, special strings in texts by its default."""

    def __init__(self, name: str, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.tok = tokenizer(name)
        self.huge, self.chunk, self.overlap = huge, chunk, overlap
        self.special = [x.content for x in self.tok.get_added_tokens_decoder().values()]
        self.known: dict[str, int] = _Known(self.tok)

    def offsets(self, part: str) -> tuple[np.ndarray, np.ndarray]:
        found = np.array(self.tok.encode(part, add_special_tokens=False).offsets, dtype=np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]

    def count(self, text: str) -> int:
        if len(text) > self.huge:
            return splice(text, self.offsets, self.chunk, self.overlap)[0]
        if _PLAIN.search(text) or any(x in text for x in self.special):
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        if len(self.known) > CACHE:
            self.known.clear()
        return sum(map(self.known.__getitem__, _PIECE.findall(text)))


class _Known(dict):
    """Tokens of a piece, asked from the library once: pieces are encoded one by one in any text."""

    def __init__(self, tok):
        super().__init__()
        self.ask = PieceModel(tok)

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self.ask(piece))
        return n


def token_counts(
    docs: DataFrame,
    vocabulary: str = "byte_bpe_50k.json",
    limit: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    huge: int = HUGE,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """One row per row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    The vocabulary is a GPT-2 style byte-level BPE file of the `tokenizers` library. NULL and
    empty texts count 0. Ids may be NULL or repeat; other columns are not read. An empty table
    gives an empty one. A task holds one batch of texts and the offsets of one chunk.
    """
    schema = T.StructType(
        [T.StructField(id_col, id_type(docs, id_col)), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    )

    def make():
        counter = Counter(vocabulary, huge, chunk, overlap)

        def work(batch):
            texts = texts_of(batch, text_col)
            return [batch.column(id_col), [len(x.encode("utf-8", "surrogatepass")) for x in texts], [counter.count(x) for x in texts]]

        return work

    counted = map_batches(docs.select(id_col, text_col), make, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
