"""The prefix trie of conversations and totals over its subtrees by time-forward processing.

Conversations are rebuilt from a shared head and their own turns. A turn becomes a 128-bit digest,
and a prefix the exclusive or of its turns' digests, each taken with its depth, so that prefixes are
running values which a conversation of any length computes in slices. The trie's nodes are the
distinct prefixes; turns themselves meet no shuffle.

Totals over subtrees (leaves, saved tokens) go up the trie by time-forward processing. Nodes are cut
into shards: whole subtrees whose conversations have few turns left, and above them bands of levels.
Spark sorts the nodes of a shard externally by reverse level order; a task reads them in that order
and each node sends its total to its parent through a priority queue ordered alike, which spills to
disk. Shard roots then send theirs across: subtrees to the nodes above them, bands to each other
through the trie of their roots, which is processed in the same way.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import struct
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadsieve.llm.common import stored

#: Turns left in all conversations of a subtree that is one shard, and levels of a band above those.
SHARD_TURNS, BAND = 50_000, 64
#: Turns of a conversation that are summed together.
SLICE = 4096
#: Messages that a queue holds in memory; ids written as one block of a digest.
IN_MEMORY, BLOCK = 200_000, 4096

KEY = ["depth", "k1", "k2"]


# ---------------------------------------------------------------- rebuilt conversations


def ranked_turns(conversations: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", with_text=False) -> DataFrame:
    """(conv_id, rank, c1, c2, bytes) of every turn: its place from 1, its digest, its text's UTF-8 bytes.

    Turns are ordered by turn, NULL first, equal ones by digest. NULL roles and texts are empty;
    rows without a conversation id belong to none. Equal rows are counted first, the rest is sorted
    by range over all conversations at once, and each range adds what earlier ones hold of the
    conversation: one of any size, or with one turn number throughout, has no task to itself.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    more = [role.alias("role"), text.alias("text")] if with_text else []
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("c1"),
        F.xxhash64(text, F.lit(2), role).alias("c2"),
        F.octet_length(text).cast("long").alias("bytes"),
        *more,
    )
    extra = ["role", "text"] if with_text else []
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("c1"), F.col("c2")]
    counted = rows.groupBy("conv_id", "turn", "c1", "c2", "bytes", *extra).agg(F.count(F.lit(1)).alias("n"))
    ranged = counted.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "c1", "c2", "bytes", "n", *extra)

    def run(batches):
        part, conv, total = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            ends = []
            for c, n in zip(batch.column("conv_id").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if c != conv:
                    conv, total = c, 0
                total += n
                ends.append(total)
            columns = [*batch.columns, pa.array([part] * len(ends), pa.int32()), pa.array(ends, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "last"])

    text_type = ", role string, text string" if with_text else ""
    schema = f"conv_id long, c1 long, c2 long, bytes long, n long{text_type}, part int, last long"
    placed = stored(ranged.mapInArrow(run, schema), "trie-ranked")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("conv_id", "part").agg(F.sum("n").alias("m"))  # a row for each range a conversation reaches into
    before = before.select("conv_id", "part", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before"))
    last = F.col("before") + F.col("last")
    rank = F.explode(F.sequence(last - F.col("n") + 1, last)).alias("rank")
    return placed.join(before, ["conv_id", "part"]).select("conv_id", rank, "c1", "c2", "bytes", *extra)


def head_length(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its group: crc32 of its id, modulo 9."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 9


def group_head(conv_id: Column) -> Column:
    return conv_id - conv_id % 5


def rebuilt(
    turns: DataFrame,
    head_of: Callable[[Column], Column] = group_head,
    length_of: Callable[[Column], Column] = head_length,
    most: int = 8,
) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, ...) of the rebuilt conversations, and conversations (conv_id, turns).

    `turns` is a stored table with `rank`, read three times. Conversation c is the first
    `length_of(c)` (at most `most`) turns of conversation `head_of(c)`, all if it has fewer, none if
    there is no such conversation, then its own turns after its first `length_of(c)`.
    """
    rest = [c for c in turns.columns if c not in ("conv_id", "rank")]
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    mine = lengths.select("conv_id", "own", head_of(F.col("conv_id")).alias("head"), length_of(F.col("conv_id")).alias("h"))
    heads = lengths.select(F.col("conv_id").alias("head"), F.col("own").alias("_n"))
    found = F.least("h", F.coalesce("_n", F.lit(0)))
    plan = mine.join(heads, "head", "left").select("conv_id", "own", "head", "h", found.alias("taken"))
    plan = stored(plan, "trie-plan")
    own = turns.join(plan.select("conv_id", "h", "taken"), "conv_id").where("rank > h")
    own = own.select("conv_id", (F.col("taken") + F.col("rank") - F.col("h")).alias("depth"), *rest)
    first = turns.where(F.col("rank") <= most).withColumnRenamed("conv_id", "head").join(plan.select("conv_id", "head", "h"), "head")
    first = first.where("rank <= h").select("conv_id", F.col("rank").alias("depth"), *rest)
    whole = plan.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("turns"))
    return own.unionByName(first), whole


# ---------------------------------------------------------------- prefixes and nodes


def prefixes(turns: DataFrame, whole: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, bytes, left): every prefix, the empty one too, with its parent's key.

    `left` is how many turns of the conversation follow. Running values are taken within slices of
    a conversation and carried over its slices.
    """
    one = F.xxhash64(F.lit(3), "depth", "c1", "c2").alias("d1")
    two = F.xxhash64("c2", F.lit(4), "c1", "depth").alias("d2")
    sliced = turns.select("conv_id", "depth", F.floor((F.col("depth") - 1) / SLICE).alias("slice"), one, two, "bytes")
    within = Window.partitionBy("conv_id", "slice").orderBy("depth")
    run = sliced.select("*", F.bit_xor("d1").over(within).alias("r1"), F.bit_xor("d2").over(within).alias("r2"))
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sliced.groupBy("conv_id", "slice").agg(F.bit_xor("d1").alias("s1"), F.bit_xor("d2").alias("s2"))
    carry = sums.select("conv_id", "slice", *(F.coalesce(F.bit_xor(s).over(earlier), F.lit(0)).alias(s) for s in ("s1", "s2")))
    keyed = run.join(carry, ["conv_id", "slice"]).join(whole, "conv_id")
    k1, k2 = F.col("r1").bitwiseXOR(F.col("s1")), F.col("r2").bitwiseXOR(F.col("s2"))
    named = keyed.select(
        "conv_id", "depth", k1.alias("k1"), k2.alias("k2"), k1.bitwiseXOR(F.col("d1")).alias("p1"), k2.bitwiseXOR(F.col("d2")).alias("p2"),
        "bytes", (F.col("turns") - F.col("depth")).alias("left"),
    )
    zero, null = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = whole.select(
        "conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), null.alias("p1"), null.alias("p2"), zero.alias("bytes"), F.col("turns").alias("left")
    )
    return named.unionByName(root)


def trie_nodes(rows: DataFrame) -> DataFrame:
    """One row per distinct prefix: key, parent's key, conv_id, n_convs, n_children, weight, and its own
    share of the totals (leaves, saved). `weight` is the turns that its members have left."""
    nodes = rows.groupBy(*KEY).agg(
        F.min("p1").alias("p1"),
        F.min("p2").alias("p2"),
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.max("bytes").alias("bytes"),
        F.sum("left").alias("weight"),
    )
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    kids = kids.agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(kids, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    return nodes.select(
        *KEY, "p1", "p2", "conv_id", "n_convs", "n_children", "weight",
        (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
    )


# ---------------------------------------------------------------- time-forward processing


class SpillingQueue:
    """A priority queue of (order, k1, k2, leaves, saved) that keeps a bounded number in memory.

    What is beyond goes to an unnamed scratch file of the task as a sorted run, as Spark's own sorts
    do, and runs are read back block by block while they are merged. A lost task leaves nothing.
    """

    ROW = struct.Struct("<5q")

    def __init__(self, in_memory: int = IN_MEMORY):
        self.in_memory = max(1, in_memory)
        self.heap: list[tuple[int, ...]] = []
        self.runs: list[tuple[tuple[int, ...], int, Iterator]] = []  # a heap of run heads
        self.spilled = 0

    def push(self, message: tuple[int, int, int, int, int]) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.in_memory:
            folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
            file = tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)
            self.heap.sort()
            file.writelines(self.ROW.pack(*m) for m in self.heap)
            file.seek(0)
            self.heap.clear()
            self.spilled += 1
            self._advance(self.spilled, self._read(file))

    def _read(self, file) -> Iterator[tuple[int, ...]]:
        with file:
            while block := file.read(self.ROW.size * 1024):
                yield from self.ROW.iter_unpack(block)

    def _advance(self, number: int, run: Iterator) -> None:
        if (head := next(run, None)) is not None:
            heapq.heappush(self.runs, (head, number, run))

    def first(self) -> tuple[int, ...] | None:
        heads = [x for x in (self.heap[0] if self.heap else None, self.runs[0][0] if self.runs else None) if x is not None]
        return min(heads, default=None)

    def pop(self) -> tuple[int, ...]:
        if not self.runs or (self.heap and self.heap[0] <= self.runs[0][0]):
            return heapq.heappop(self.heap)
        head, number, run = heapq.heappop(self.runs)
        self._advance(number, run)
        return head


def forward(nodes: DataFrame, in_memory: int = IN_MEMORY) -> DataFrame:
    """(depth, k1, k2, leaves, saved, top): totals of each node over its subtree within its shard.

    `nodes` hold a shard (sd, s1, s2), a key, a parent's key and own shares. A shard is a connected
    part of a trie; its `top` node sends nothing.
    """
    order = [F.col("sd"), F.col("s1"), F.col("s2"), F.col("depth").desc(), F.col("k1"), F.col("k2")]
    top = ((F.col("depth") == F.col("sd")) & (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2"))).alias("top")
    columns = ["sd", "s1", "s2", *KEY, "p1", "p2", "leaves", "saved", top]
    sent = nodes.select(*columns).repartition("sd", "s1", "s2").sortWithinPartitions(*order)
    names = [*KEY, "leaves", "saved", "top"]

    def run(batches):
        queue = SpillingQueue(in_memory)
        for batch in batches:
            depth, k1, k2, p1, p2, leaves, saved, tops = (batch.column(x).to_pylist() for x in [*KEY, "p1", "p2", "leaves", "saved", "top"])
            for i, d in enumerate(depth):
                here = (-d, k1[i], k2[i])  # reverse level order
                while (message := queue.first()) is not None and message[:3] == here:
                    _, _, _, more, spared = queue.pop()
                    leaves[i] += more
                    saved[i] += spared
                if not tops[i]:
                    queue.push((1 - d, p1[i], p2[i], leaves[i], saved[i]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in KEY), pa.array(leaves, pa.int64()), pa.array(saved, pa.int64()), batch.column("top")], names=names
            )

    return sent.mapInArrow(run, "depth long, k1 long, k2 long, leaves long, saved long, top boolean")


def with_inflow(nodes: DataFrame, senders: DataFrame) -> DataFrame:
    """`nodes` with the totals of `senders` (a parent's key, leaves, saved) added to their parents' shares."""
    key = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    inflow = senders.groupBy(*key).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
    joined = nodes.join(inflow, KEY, "left")
    more = {x: F.col(x) + F.coalesce(f"_{x}", F.lit(0)) for x in ("leaves", "saved")}
    return joined.withColumns(more).select(*nodes.columns)


def banded(nodes: DataFrame, rows: DataFrame, band: int, in_memory: int) -> DataFrame:
    """(depth, k1, k2, leaves, saved) of a trie, by bands of levels and then across their roots.

    `rows` (conv_id, depth, key) hold every ancestor of every node's `conv_id`.
    """
    deepest = nodes.agg(F.max("depth")).first()[0]
    zero = F.lit(0).cast("long")
    if deepest is None or deepest < band:
        return forward(nodes.withColumns({"sd": zero, "s1": zero, "s2": zero}), in_memory).drop("top")
    levels = rows.where(F.col("depth") % band == 0)
    roots = levels.select("conv_id", F.col("depth").alias("sd"), F.col("k1").alias("s1"), F.col("k2").alias("s2"))
    level = F.col("depth") - F.col("depth") % band
    placed = stored(nodes.withColumn("sd", level).join(roots, ["conv_id", "sd"]), "trie-bands")
    local = forward(placed, in_memory).where("top").drop("top")
    heads = stored(local.join(placed.select(*KEY, "p1", "p2", "conv_id"), KEY), "trie-heads")
    # the trie of the bands' roots: parents are the roots of the bands above
    above = levels.select("conv_id", (F.col("depth") + band).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"))
    short = heads.drop("p1", "p2").join(above, ["conv_id", "depth"], "left").withColumn("depth", F.floor(F.col("depth") / band))
    totals = banded(stored(short, "trie-short"), levels.withColumn("depth", F.floor(F.col("depth") / band)), band, in_memory)
    totals = totals.withColumn("depth", F.col("depth") * band)
    senders = totals.join(heads.select(*KEY, "p1", "p2"), KEY).where("depth > 0")
    return forward(with_inflow(placed, senders), in_memory).drop("top")


def subtree_totals(nodes: DataFrame, rows: DataFrame, shard_turns: int = SHARD_TURNS, band: int = BAND, in_memory: int = IN_MEMORY) -> DataFrame:
    """(depth, k1, k2, leaves, saved) over each node's subtree. `nodes` and `rows` are stored tables."""
    key = [(F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2")]
    upper = nodes.where(F.col("weight") > shard_turns)
    light = nodes.where(F.col("weight") <= shard_turns)
    # a light node is a shard's root if the node above it is not light
    tops = light.join(upper.select(*key), ["depth", "p1", "p2"], "left_semi").unionByName(light.where("depth = 0"), allowMissingColumns=True)
    tops = tops.select(*KEY)
    member = rows.join(tops, KEY).select("conv_id", F.col("depth").alias("sd"), F.col("k1").alias("s1"), F.col("k2").alias("s2"))
    lower = stored(forward(light.join(member, "conv_id"), in_memory), "trie-lower")
    senders = lower.where("top AND depth > 0").join(nodes.select(*KEY, "p1", "p2"), KEY)
    above = stored(with_inflow(upper, senders).select(*KEY, "p1", "p2", "conv_id", "leaves", "saved"), "trie-upper")
    return lower.drop("top").unionByName(banded(above, rows.select("conv_id", *KEY), band, in_memory))


# ---------------------------------------------------------------- what the trie returns


def end_digests(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes at which conversations end, over their ids in order.

    Ids are sorted by range and joined into blocks; a task then feeds a node's blocks to one digest,
    of which it holds one at a time.
    """
    order = [*KEY, "conv_id"]
    ends = rows.where("left = 0").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)

    def joined(batches):
        key, ids = None, []

        def out():
            return pa.RecordBatch.from_pydict(
                {"depth": [key[0]], "k1": [key[1]], "k2": [key[2]], "first": [ids[0]], "ids": [",".join(map(str, ids))]}
            )

        for batch in batches:
            for *k, conv in zip(*(batch.column(x).to_pylist() for x in order), strict=True):
                if ids and (k != key or len(ids) >= block):
                    yield out()
                    ids = []
                key = k
                ids.append(conv)
        if ids:
            yield out()

    blocks = ends.mapInArrow(joined, "depth long, k1 long, k2 long, first long, ids string")
    blocks = blocks.repartition(*KEY).sortWithinPartitions(*KEY, "first")

    def digest(batches):
        key, state, done = None, None, []

        def out():
            columns = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3])], names=[*KEY, "ends_sha256"])

        for batch in batches:
            for *k, ids in zip(*(batch.column(x).to_pylist() for x in [*KEY, "ids"]), strict=True):
                if k == key:
                    state.update(b",")
                else:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                state.update(ids.encode())
            if len(done) >= 1000:
                yield out()
                done = []
        if key is not None:
            done.append((*key, state.hexdigest()))
            yield out()

    return blocks.mapInArrow(digest, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    shard_turns: int = SHARD_TURNS,
    band: int = BAND,
    in_memory: int = IN_MEMORY,
    block: int = BLOCK,
) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    (conv_id, depth) names a node: its smallest member and its number of turns. NULL roles and texts
    are empty, a NULL turn comes first, rows of equal turn are ordered by a digest of role and text,
    repeated rows are turns of their own, rows without a conversation id are left out, other columns
    are not read, and an empty table has no root. Runs when called, with tables in the shared
    scratch folder between the steps.
    """
    turns = stored(ranked_turns(conversations, conv_col, turn_col, role_col, text_col), "trie-turns")
    rows = stored(prefixes(*rebuilt(turns)), "trie-rows")
    nodes = stored(trie_nodes(rows), "trie-nodes")
    totals = subtree_totals(nodes, rows, shard_turns, band, in_memory).select(*KEY, F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    out = nodes.join(totals, KEY).join(end_digests(rows, block), KEY, "left")
    parents = nodes.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id")
    )
    return out.join(parents, ["depth", "p1", "p2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256")
    )


def node_texts(nodes: DataFrame, conversations: DataFrame, **columns) -> DataFrame:
    """`nodes` (conv_id, depth, ...) with the role and text of their last turn; the root has none."""
    turns, _ = rebuilt(stored(ranked_turns(conversations, with_text=True, **columns), "trie-texts"))
    return nodes.join(turns.select("conv_id", "depth", "role", "text"), ["conv_id", "depth"], "left")
