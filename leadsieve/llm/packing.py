"""Best-fit packing of documents into sequences of fixed length by linear grouping.

Large lengths are rounded up within groups of equal cardinality, so that few sizes remain; a
cutting-stock search over those sizes fixes a few configurations and how often each is used; actual
documents, at most as long as their rounded size, take the places; short documents then go best-fit
into what the large ones leave open. The plan needs only how often each length occurs: a table of
at most `capacity` rows, whatever the corpus. It comes back as runs of equal sequences, and every
piece finds its place from its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import bisect
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadsieve.llm.common import PieceModel, id_type, map_batches, small_batches, stored, texts_of, tokenizer

CAPACITY = 4096
#: Lengths above this share of the capacity are grouped; the others fill gaps.
LARGE = 1 / 8
#: Groups of large lengths, and so sizes that configurations are made of.
GROUPS = 256
#: Pieces of one length that are ranked together; more of them are ranked in several slices.
RANKED_TOGETHER = 1000
CACHE = 1_000_000


# ---------------------------------------------------------------- token ids

#: Lower case, NFC and the pattern's classes are beyond doubt for these characters.
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u024f\u2010-\u2027\u2030-\u205e\u20ac]")
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECE = re.compile(rf"[{_LETTER}]+|[{_DIGIT}]|'s|'t|'re|'ve|'m|'ll|'d|[^\s{_LETTER}{_DIGIT}]+")


class _Known(dict):
    def __init__(self, tok):
        super().__init__()
        self.ask = PieceModel(tok)

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = np.array([t.id for t in self.ask(piece)], dtype="<u4").tobytes()
        return ids


class Encoder:
    """Token ids of a text as the vocabulary's library gives them, each distinct piece asked once."""

    def __init__(self, vocabulary: str):
        self.tok = tokenizer(vocabulary)
        self.special = [x.content for x in self.tok.get_added_tokens_decoder().values()]
        self.known = _Known(self.tok)

    def ids(self, text: str) -> np.ndarray:
        if _PLAIN.search(text) or any(x in text for x in self.special):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4")
        if len(self.known) > CACHE:
            self.known.clear()
        return np.frombuffer(b"".join(map(self.known.__getitem__, _PIECE.findall(text.lower()))), dtype="<u4")


def token_pieces(
    docs: DataFrame,
    vocabulary: str = "word_bpe_49k.json",
    end_id: int = 1,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each text's ids and `end_id`, cut only beyond capacity."""
    schema = T.StructType(
        [
            T.StructField(id_col, id_type(docs, id_col)),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )

    def make():
        encoder = Encoder(vocabulary)
        end = np.array([end_id], dtype="<u4")

        def work(batch):
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(texts_of(batch, text_col)):
                ids = np.concatenate([encoder.ids(text), end])
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            return [batch.column(id_col).take(pa.array(row, pa.int64())), piece, start, length, crc]

        return work

    return map_batches(docs.select(id_col, text_col), make, schema)


# ---------------------------------------------------------------- the plan, from lengths alone


class Plan:
    """Runs of places: pieces `rank_lo <= rank < rank_hi` of one length, `per` in each sequence."""

    COLUMNS = ("length", "rank_lo", "rank_hi", "per", "sequence", "offset")

    def __init__(self):
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0

    def place(self, length: int, lo: int, hi: int, per: int, sequence: int, offset: int) -> None:
        self.rows.append((length, lo, hi, per, sequence, offset))

    def arrays(self) -> dict[str, np.ndarray]:
        rows = np.array(sorted(self.rows), dtype=np.int64).reshape(-1, len(self.COLUMNS))
        return dict(zip(self.COLUMNS, rows.T, strict=True))


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY, large: float = LARGE, groups: int = GROUPS) -> Plan:
    """The packing of `counts[length]` pieces of each length into sequences of `capacity`."""
    plan = Plan()
    used = dict.fromkeys(counts, 0)  # pieces of a length that have a place
    open_runs: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first sequence, how many)

    if counts.get(capacity):
        plan.place(capacity, 0, counts[capacity], 1, 0, 0)
        plan.sequences = counts[capacity]
    big = sorted(x for x in counts if capacity * large < x < capacity and counts[x])
    _large(plan, counts, used, open_runs, big, capacity, groups)
    _small(plan, counts, used, open_runs, sorted((x for x in counts if x <= capacity * large and counts[x]), reverse=True), capacity)
    return plan


def _grouped(counts: dict[int, int], lengths: list[int], groups: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Equal-cardinality groups over sorted lengths: (rounded size, runs (length, first rank, pieces))."""
    total = sum(counts[x] for x in lengths)
    size = max(1, -(-total // groups))
    out, runs, room = [], [], size
    for length in lengths:
        rank, left = 0, counts[length]
        while left:
            n = min(left, room)
            runs.append((length, rank, n))
            rank, left, room = rank + n, left - n, room - n
            if not room:
                out.append((length, runs))
                runs, room = [], size
    if runs:
        out.append((runs[-1][0], runs))
    return out


def _fullest(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[int]:
    """The multiset of sizes, within what is left of each, that fills the capacity best.

    Bounded knapsack over sums; of equal fillings the one with the larger sizes is taken, since
    small sizes are easier to place later.
    """
    reach = np.zeros(capacity + 1, dtype=bool)
    reach[0] = True
    last = np.full(capacity + 1, -1, dtype=np.int64)  # the size that first reached a sum
    for k in range(len(sizes) - 1, -1, -1):
        step = int(sizes[k])
        for _ in range(int(min(left[k], capacity // step))):
            new = np.zeros_like(reach)
            new[step:] = reach[:-step]
            new &= ~reach
            if not new.any():
                break
            last[new] = k
            reach |= new
    at = int(np.flatnonzero(reach)[-1])
    chosen = [0] * len(sizes)
    while at:
        k = int(last[at])
        chosen[k] += 1
        at -= int(sizes[k])
    return chosen


def _large(plan, counts, used, open_runs, lengths, capacity, groups) -> None:
    grouped = _grouped(counts, lengths, groups)
    if not grouped:
        return
    sizes = np.array([x for x, _ in grouped])
    left = np.array([sum(n for _, _, n in runs) for _, runs in grouped], dtype=np.int64)
    taken = np.zeros(len(grouped), dtype=np.int64)
    edges = [np.cumsum([0, *(n for _, _, n in runs)]) for _, runs in grouped]
    while left.any():
        # the largest size left is in the next configuration: it gets harder to place, never easier
        top = int(np.flatnonzero(left)[-1])
        rest = left.copy()
        rest[top] -= 1
        config = _fullest(sizes, rest, capacity - int(sizes[top]))
        config[top] += 1
        times = min(int(left[k]) // c for k, c in enumerate(config) if c)
        _instances(plan, grouped, edges, taken, open_runs, config, times, capacity)
        for k, c in enumerate(config):
            left[k] -= c * times
            taken[k] += c * times
    for length in lengths:
        used[length] = counts[length]


def _instances(plan, grouped, edges, taken, open_runs, config, times, capacity) -> None:
    """Put actual pieces into `times` uses of a configuration, as runs of sequences with equal lengths."""
    places = []  # (group, first rank within the group)
    for k, c in enumerate(config):
        places += [(k, int(taken[k]) + j * times) for j in range(c)]
    cuts = {0, times}
    for k, first in places:
        cuts.update(int(e) - first for e in edges[k] if first < e < first + times)
    cuts = sorted(cuts)
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        offset = 0
        for k, first in places:
            at = int(np.searchsorted(edges[k], first + lo, side="right")) - 1
            length, rank, _ = grouped[k][1][at]
            begin = rank + first + lo - int(edges[k][at])
            plan.place(length, begin, begin + hi - lo, 1, plan.sequences + lo, offset)
            offset += length
        if offset < capacity:
            open_runs.setdefault(capacity - offset, []).append((plan.sequences + lo, hi - lo))
    plan.sequences += times


def _small(plan, counts, used, open_runs, lengths, capacity) -> None:
    """Best fit, longest first: a piece goes where the least room is left that still holds it."""
    rooms = sorted(open_runs)
    for length in lengths:
        while used[length] < counts[length]:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                first, many, room = plan.sequences, -(-(counts[length] - used[length]) // (capacity // length)), capacity
                plan.sequences += many
            else:
                room = rooms[at]
                first, many = open_runs[room].pop()
                if not open_runs[room]:
                    del open_runs[room]
                    del rooms[at]
            need = counts[length] - used[length]
            per = min(room // length, need)
            full = min(many, need // per)
            lo = used[length]
            plan.place(length, lo, lo + full * per, per, first, capacity - room)
            used[length] += full * per
            for begin, n, rest in ((first, full, room - per * length), (first + full, many - full, room)):
                if n and rest:
                    if rest not in open_runs:
                        bisect.insort(rooms, rest)
                    open_runs.setdefault(rest, []).append((begin, n))


# ---------------------------------------------------------------- packing


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece"), **how) -> DataFrame:
    """`pieces` (length <= capacity, kept as a table: it is read twice) with sequence_id and offset.

    Every piece gets a place; sequences are gapless from 0 and nothing is cut. Pieces of equal
    length are interchangeable, so ties and repeated rows may swap places, never share one.
    """
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    lengths = {int(r["length"]): int(r["n"]) for r in counts.collect()}  # at most `capacity` rows
    plan = plan_sequences(lengths, capacity, **how).arrays()
    shared = pieces.sparkSession.sparkContext.broadcast(plan)

    slices = max(1, -(-max(lengths.values(), default=0) // RANKED_TOGETHER))
    sliced = pieces.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        sliced.groupBy("length", "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("length", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    )
    within = Window.partitionBy("length", "_slice").orderBy(*order)
    ranked = sliced.withColumn("_rank", F.row_number().over(within) - 1).join(first, ["length", "_slice"])
    ranked = ranked.withColumn("_rank", F.col("_first") + F.col("_rank")).drop("_first", "_slice")

    keep = [x for x in ranked.columns if x != "_rank"]
    fields = [ranked.schema[x] for x in keep]
    schema = T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def make():
        runs = shared.value
        key = (runs["length"] << 44) + runs["rank_lo"]

        def work(batch):
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            nth, per = rank - runs["rank_lo"][at], runs["per"][at]
            return [*(batch.column(x) for x in keep), runs["sequence"][at] + nth // per, runs["offset"][at] + nth % per * length]

        return work

    return map_batches(ranked, make, schema)


def pack_documents(
    docs: DataFrame,
    vocabulary: str = "word_bpe_49k.json",
    end_id: int = 1,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A NULL or empty text is the end token alone. Repeated rows are packed as often as they occur;
    ids may be NULL; other columns are not read; an empty table gives an empty one. Runs two small
    jobs when called: the pieces are written to the shared scratch folder and their lengths counted.
    """
    small_batches(docs.sparkSession)
    pieces = stored(token_pieces(docs, vocabulary, end_id, capacity, id_col, text_col), "pieces")
    return pack(pieces, capacity, (id_col, "piece"))
