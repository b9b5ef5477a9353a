"""Near-duplicate texts by consistent weighted sampling over TF-IDF word shingles.

A text is a weighted set of five-word shingles. Improved consistent weighted sampling (Ioffe 2010)
draws `BANDS * ROWS` shingles from it so that two texts draw the same one with a probability equal
to their weighted Jaccard similarity; `ROWS` draws in a row make a band, and texts that share a band
are candidates. One byte of each draw is kept as a sketch: candidates whose sketches agree in fewer
than half of the draws are dropped before any text is read (a pair at a similarity of 0.8 with a
chance below 1e-6). A remaining pair is a link if the similarity of the two whole texts is at least
`THRESHOLD`. Texts are thus shuffled for likely links only, not for whatever shares a common shingle.

Candidates of a band are first compared with its smallest member only, so a family of thousands
costs thousands of comparisons. Where that leaves several components in a band, all pairs across
them are compared: pair by pair in small bands, and in large ones in blocks of bounded size. A block
first looks at sketches; the members that agree with one of another component then bring their
texts, weighted sets become rows of a matrix, and a task returns a forest of its links, not its
pairs. No band is cut.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadsieve.llm.common import map_batches, small_batches, stored, texts_of
from leadsieve.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 14, 4
#: Share of the draws in which the sketches of a candidate pair agree at least.
LIKELY = 0.5
#: Document frequencies are kept by a hash of the shingle, so their table never grows. The weight
#: of a shingle is its count times 1 (in every document) to 1 + SPREAD (in none other): a family of
#: copies makes its own shingles frequent, and full weights would tear it apart.
DF_BUCKETS, SPREAD = 1 << 18, 0.25
#: Largest band whose pairs are rows; members of a slice in the blocks of larger ones, sketches and texts.
SMALL, SKETCH_SLICE, SLICE = 8, 2048, 128

_M = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a hash that choose a row in a table of random numbers.
_PART = 13


#: Base of the running hash of bytes and its inverse (modulo 2^64), and the bytes hashed at once.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 18


@lru_cache(maxsize=1)
def _byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, whether it is part of a word, and powers of base and inverse."""
    rng = np.random.default_rng(11)
    values = rng.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    inside = np.ones(256, dtype=bool)
    inside[[0x20, *range(0x09, 0x0E)]] = False
    powers = []
    for base in (_BASE, _INVERSE):
        steps = np.full(_BLOCK + 1, base, dtype=np.uint64)
        steps[0] = 1
        powers.append(np.multiply.accumulate(steps))
    return values, inside, powers[0], powers[1]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word in order.

    One running sum of byte * base^place over the text; a word is the difference of two sums, moved
    back to place 0. Blanks are single bytes of UTF-8. Long texts go block by block, and a word may
    cross any number of blocks.
    """
    values, inside, up, down = _byte_tables()
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    one, sums, moves, ends = 1 << 64, [], [], []
    total, power, inverse, before = np.uint64(0), 1, 1, False
    for at in range(0, len(data), _BLOCK):
        part = data[at : at + _BLOCK]
        word = inside[part]
        run = np.empty(len(part) + 1, dtype=np.uint64)
        run[0] = total
        np.cumsum(values[part] * (up[: len(part)] * np.uint64(power)), out=run[1:])
        run[1:] += total
        was = np.append(before, word[:-1])
        start, end = np.flatnonzero(word & ~was), np.flatnonzero(was & ~word)
        sums.append(run[start])
        moves.append(down[start] * np.uint64(inverse))
        ends.append(run[end])
        total, before = run[-1], bool(word[-1])
        power, inverse = power * int(up[len(part)]) % one, inverse * int(down[len(part)]) % one
    if before:
        ends.append(np.array([total], dtype=np.uint64))
    if not sums:
        return np.empty(0, dtype=np.uint64)
    h = (np.concatenate(ends) - np.concatenate(sums)) * np.concatenate(moves)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the distinct shingles; a text of fewer words has one of all its words."""
    h = word_hashes(text)
    if not len(h):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    width = min(SHINGLE, len(h))
    key = np.zeros(len(h) - width + 1, dtype=np.uint64)
    for j in range(width):
        key = (key ^ h[j : j + len(key)]) * _M
        key ^= key >> np.uint64(29)
    return np.unique(key, return_counts=True)


class Weights:
    """Shingle weights from document frequencies by hash bucket."""

    def __init__(self, df: np.ndarray, n_docs: int):
        idf = np.log1p(n_docs / (1.0 + df)) / np.log1p(max(1, n_docs))
        self.factor = (1.0 + SPREAD * np.minimum(1.0, idf)).astype(np.float32)

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, weights and counts of the distinct shingles."""
        keys, counts = shingles(text)
        return keys, counts * self.factor[(keys >> np.uint64(20)) & np.uint64(len(self.factor) - 1)], counts


def similarity(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> float:
    """Weighted Jaccard similarity of two weighted sets with sorted keys; 0 if one is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    both = b[0][at] == a[0]
    low = float(np.minimum(a[1][both], b[1][at[both]]).sum())
    return low / (float(a[1].sum()) + float(b[1].sum()) - low)


@lru_cache(maxsize=1)
def _tables(draws: int, seed: int = 5) -> tuple[np.ndarray, ...]:
    """Tabulated randomness: a shingle's numbers by 13-bit parts of its hash.

    r and c are Gamma(2, 1) variates (kept as r, 1 / r and log c), beta is uniform.
    """
    rng = np.random.default_rng(seed)
    shape = (1 << _PART, draws)
    r, c, beta = rng.gamma(2.0, size=shape), rng.gamma(2.0, size=shape), rng.random(shape)
    return tuple(x.astype(np.float32) for x in (r, 1.0 / r, np.log(c), beta))


def draw(keys: np.ndarray, weights: np.ndarray, draws: int = BANDS * ROWS) -> np.ndarray:
    """The consistent weighted samples of one set: a hash of (shingle, level) for each draw."""
    rs, inverses, logs, betas = _tables(draws)
    best = np.full(draws, np.inf, dtype=np.float32)
    out = np.zeros(draws, dtype=np.uint64)
    low, cols = np.uint64((1 << _PART) - 1), np.arange(draws)
    for at in range(0, len(keys), 1024):  # the arrays of a step stay in the processor's cache
        k = keys[at : at + 1024]
        one, two, three = (((k >> np.uint64(i * _PART)) & low).astype(np.intp) for i in range(3))
        r = rs.take(one, axis=0)
        beta = betas.take(three, axis=0)
        level = inverses.take(one, axis=0)
        level *= np.log(weights[at : at + 1024]).astype(np.float32)[:, None]
        level += beta
        np.floor(level, out=level)
        beta -= level
        beta -= 1
        beta *= r
        beta += logs.take(two, axis=0)  # log c - r (level - beta + 1)
        i = beta.argmin(axis=0)
        a = beta[i, cols]
        better = a < best
        best[better] = a[better]
        out[better] = ((k[i] ^ (level[i, cols].astype(np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * _M)[better]
    return out


def bands_of(drawn: np.ndarray, rows: int = ROWS) -> list[int]:
    key = np.arange(len(drawn) // rows, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
    for row in drawn.reshape(-1, rows).T:
        key = (key ^ row) * _M
        key ^= key >> np.uint64(31)
    return key.view(np.int64).tolist()


def frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Documents that hold a shingle of each hash bucket, and documents in all.

    Every task adds up its own texts; the sums that meet on the driver are one number for each of
    the fixed number of buckets, whatever the corpus.
    """

    def run(batches):
        df, n = np.zeros(DF_BUCKETS, dtype=np.int64), 0
        for batch in batches:
            for text in texts_of(batch, "text"):
                keys, _ = shingles(text)
                n += 1
                df[((keys >> np.uint64(20)) & np.uint64(DF_BUCKETS - 1)).astype(np.int64)] += 1  # a bucket once, however often it is named
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["bucket", "n"])

    sums = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = sums.toPandas()
    df = np.zeros(DF_BUCKETS, dtype=np.float64)
    real = found["bucket"].to_numpy() >= 0
    df[found["bucket"].to_numpy()[real].astype(np.int64)] = found["n"].to_numpy()[real]
    return df, int(found["n"].to_numpy()[~real].sum())


def signatures(docs: DataFrame, shared, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h1, h2, bands, sketch): a digest of the text, its bands and a byte of each draw; a text without words has none."""
    schema = T.StructType(
        [docs.schema[id_col], T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())]
        + [T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())]
    )

    def make():
        weights = shared.value

        def work(batch):
            h1, h2, bands, sketches = [], [], [], []
            for text in texts_of(batch, text_col):
                digest = np.frombuffer(hashlib.md5(text.encode("utf-8", "surrogatepass")).digest(), dtype=np.int64)
                keys, w, _ = weights.of(text)
                h1.append(int(digest[0]))
                h2.append(int(digest[1]))
                drawn = draw(keys, w) if len(keys) else np.empty(0, dtype=np.uint64)
                bands.append(bands_of(drawn) if len(keys) else [])
                sketches.append((drawn >> np.uint64(40)).astype(np.uint8).tobytes())
            return [batch.column(id_col), h1, h2, bands, sketches]

        return work

    return map_batches(docs.select(id_col, text_col), make, schema)


def sketch_rows(column, draws: int = BANDS * ROWS) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(-1, draws)


def likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches agree in `LIKELY` of the draws; only sketches are shuffled."""
    left = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa"))
    right = sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    wide = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                same = sketch_rows(batch.column("sa").to_pylist()) == sketch_rows(batch.column("sb").to_pylist())
                keep = pa.array(same.mean(axis=1) >= LIKELY)
                yield pa.RecordBatch.from_arrays([batch.column(x).filter(keep) for x in ("a", "b")], names=["a", "b"])

    return wide.mapInArrow(run, "a long, b long")


def only(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    return texts.join(nodes.distinct(), "node", "left_semi")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def compared(pairs: DataFrame, texts: DataFrame, shared) -> DataFrame:
    """(a, b, sim) of the pairs; the texts (node, text) are shuffled by node once for both ends."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    wide = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("sim", T.DoubleType())])

    def make():
        weights = shared.value
        last = {}  # neighbouring rows often share an end

        def of(node, text):
            if node not in last:
                if len(last) >= 8:
                    last.clear()
                last[node] = weights.of(text)
            return last[node]

        def work(batch):
            a, b, ta, tb = (batch.column(x).to_pylist() for x in ("a", "b", "ta", "tb"))
            return [a, b, [similarity(of(i, x), of(j, y)) for i, x, j, y in zip(a, ta, b, tb, strict=True)]]

        return work

    return map_batches(wide, make, schema)


def text_links(nodes: DataFrame, texts: DataFrame, shared, threshold: float = THRESHOLD) -> DataFrame:
    """(node, component) of the nodes (node, bands, sketch) that have a link."""
    bands = nodes.select("node", F.explode("bands").alias("key"))
    first = bands.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    bands = stored(bands.join(first, "key"), "dedup-bands")  # only bands that two or more share
    sketches = nodes.select("node", "sketch")

    def linked_pairs(pairs: DataFrame) -> DataFrame:
        found = stored(likely(pairs, sketches), "dedup-likely")
        sims = compared(found, only(texts, ends(found)), shared)
        return stored(sims.where(F.col("sim") >= threshold).select("a", "b"), "dedup-links")

    links = linked_pairs(bands.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    linked = stored(components(links), "dedup-components")

    members = bands.select("key", "node")
    small = apart(members, linked, "n <= {}".format(SMALL))
    x, y = (small.select("key", F.col("node").alias(n), F.col("component").alias(f"_{n}")) for n in "ab")
    links = links.unionByName(linked_pairs(x.join(y, "key").where("a > b AND _a <> _b").select("a", "b").distinct()))
    linked = stored(components(links), "dedup-components")

    large = stored(apart(members, linked, "n > {}".format(SMALL)), "dedup-large")
    found = stored(block_links(large, texts, sketches, shared, threshold), "dedup-blocks")
    return stored(components(links.unionByName(found)), "dedup-components")


def apart(members: DataFrame, linked: DataFrame, size: str) -> DataFrame:
    """(key, node, component, outside) of the bands of that size that hold several components.

    Of bands with the same members one is enough. `outside` are those not in the band's largest
    component: any pair across components has at least one of them.
    """
    now = members.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    per = now.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("h"))
    bands = per.groupBy("key").agg(
        F.count(F.lit(1)).alias("many"), F.sum("c").alias("n"), F.sum("h").alias("h"), F.max(F.struct("c", "component"))["component"].alias("main")
    )
    one = bands.where("many > 1").where(size).groupBy("n", "h").agg(F.min(F.struct("key", "main")).alias("k")).select("k.*")
    return now.join(one, "key").select("key", "node", "component", (F.col("component") != F.col("main")).alias("outside"))


def in_blocks(rows: DataFrame, group: list[str], size: int) -> DataFrame:
    """`rows` of each group with a block (_i, _j): slices of the centres against slices of the others.

    A centre is in one slice of centres and meets all slices of others, and the other way round. Groups
    of up to `size` on each side are one block.
    """
    centre = F.col("centre").cast("int")
    sizes = rows.groupBy(*group).agg(
        F.greatest(F.lit(1), F.ceil(F.sum(centre) / size)).cast("int").alias("_x"),
        F.greatest(F.lit(1), F.ceil(F.sum(1 - centre) / size)).cast("int").alias("_y"),
    )

    def slices(mine: str) -> Column:
        """The row's own slice on its side, all slices on the other."""
        own = F.array(F.pmod(F.xxhash64(F.lit(size), "node"), F.col(mine)).cast("int"))
        return F.when(F.col("centre") == F.lit(mine == "_x"), own).otherwise(F.sequence(F.lit(0), F.col(mine) - 1))

    placed = rows.join(sizes, group).withColumn("_i", F.explode(slices("_x")))
    return placed.withColumn("_j", F.explode(slices("_y"))).drop("_x", "_y")


def block_links(large: DataFrame, texts: DataFrame, sketches: DataFrame, shared, threshold: float) -> DataFrame:
    """(node, root): links across components within large bands, as a forest in each block.

    A block is a slice of the members outside the band's largest component against a slice of all
    members. It gets the sketches of its members first, and the texts of those that agree with one
    of another component after that. A task holds two slices; what it returns is not more than it got.
    """
    # all members stand on one side, those outside the largest component on the other one too
    both = large.select("key", "node", "component", F.lit(False).alias("centre")).unionByName(
        large.where("outside").select("key", "node", "component", F.lit(True).alias("centre"))
    )
    block = ["key", "_i", "_j", "node", "component", "centre"]
    sketched = in_blocks(both, ["key"], SKETCH_SLICE).join(sketches, "node").select(*block, "sketch")

    def agree(df: pd.DataFrame) -> pd.DataFrame:
        centre, component = df["centre"].to_numpy(), df["component"].to_numpy()
        sketch = sketch_rows(df["sketch"])
        same = np.zeros((int(centre.sum()), int((~centre).sum())), dtype=np.int32)
        for k in range(sketch.shape[1]):
            same += sketch[centre, k][:, None] == sketch[~centre, k][None, :]
        hit = (same >= LIKELY * sketch.shape[1]) & (component[centre][:, None] != component[~centre][None, :])
        keep = np.zeros(len(df), dtype=bool)
        keep[centre], keep[~centre] = hit.any(axis=1), hit.any(axis=0)
        return df.loc[keep, block]

    near = sketched.groupBy("key", "_i", "_j").applyInPandas(agree, "key long, _i int, _j int, node long, component long, centre boolean")
    near = stored(near.withColumnsRenamed({"_i": "_a", "_j": "_b"}), "dedup-near")
    cells = in_blocks(near, ["key", "_a", "_b"], SLICE)
    wide = cells.join(only(texts, near.select("node")), "node").select("_a", "_b", *block, "text")

    def run(df: pd.DataFrame) -> pd.DataFrame:
        weights = shared.value
        centre = df["centre"].to_numpy()
        if not centre.any() or centre.all():
            return pd.DataFrame({"node": [], "root": []}, dtype="int64")
        sets = [leveled(*weights.of(t)) for t in df["text"]]
        sims = all_similarities([x for x, c in zip(sets, centre, strict=True) if c], [x for x, c in zip(sets, centre, strict=True) if not c])
        component, node = df["component"].to_numpy(), df["node"].to_numpy()
        hit = (sims >= threshold) & (component[centre][:, None] != component[~centre][None, :])
        root: dict[int, int] = {}

        def top(i):
            while root.setdefault(i, i) != i:
                root[i] = i = root.setdefault(root[i], root[i])
            return i

        out = []
        for i, j in zip(*np.nonzero(hit), strict=True):
            a, b = int(node[centre][i]), int(node[~centre][j])
            if top(int(component[centre][i])) != top(int(component[~centre][j])):
                root[top(int(component[centre][i]))] = top(int(component[~centre][j]))
                out.append((max(a, b), min(a, b)))
        return pd.DataFrame(out, columns=["a", "b"]).rename(columns={"a": "node", "b": "root"}).astype("int64")

    return wide.groupBy("key", "_a", "_b", "_i", "_j").applyInPandas(run, "node long, root long").select(F.col("node").alias("a"), F.col("root").alias("b"))


def leveled(keys: np.ndarray, weights: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A weighted set as plain features: a shingle found k times is k features of its single weight.

    The weight that two texts share is then that of their common features.
    """
    key, level = np.repeat(keys, counts), np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return key ^ (level.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.repeat(weights / counts, counts)


def all_similarities(xs: list, ys: list, columns: int = 4096) -> np.ndarray:
    """Weighted Jaccard similarities of two lists of feature sets, by products of narrow dense blocks."""
    keys = np.concatenate([k for k, _ in [*xs, *ys]])
    owner = np.repeat(np.arange(len(xs) + len(ys)), [len(k) for k, _ in [*xs, *ys]])
    weight = np.concatenate([w for _, w in [*xs, *ys]])
    order = np.argsort(keys, kind="stable")
    keys, owner, weight = keys[order], owner[order], weight[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    runs = np.diff(np.append(first, len(keys)))
    total = np.bincount(owner, weights=weight, minlength=len(xs) + len(ys))
    column = np.repeat(np.cumsum(runs > 1) - 1, runs)
    common = np.repeat(runs > 1, runs)  # features of one text alone add to its total only
    column, owner, weight = column[common], owner[common], weight[common]
    shared = np.zeros((len(xs), len(ys)))
    edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + columns, columns))
    for lo, hi in zip(edges, edges[1:], strict=False):
        if hi > lo:
            dense = np.zeros((len(total), columns))
            at = column[lo:hi] - column[lo] // columns * columns
            dense[owner[lo:hi], at] = 1.0
            by = np.zeros(columns)
            by[at] = weight[lo:hi]
            shared += (dense[: len(xs)] * by) @ dense[len(xs) :].T
    return shared / (total[: len(xs), None] + total[None, len(xs) :] - shared)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row: doc_id, class_id (smallest id of its class), kept (doc_id = class_id).

    Classes are the components of equal texts and links. Texts without words (NULL, empty, blanks)
    are in no class but their own, as is every row without an id; those rows are kept. Of repeated
    rows all copies carry the same flag. Ids are integers. Other columns are not read; an empty table
    gives an empty one. Runs when called; tables between the steps are in the shared scratch folder.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = spark.sparkContext.broadcast(Weights(*frequencies(docs)))
    signed = stored(signatures(docs, shared, "doc_id", "text"), "dedup-signatures")
    usable = signed.where(F.col("doc_id").isNotNull() & (F.size("bands") > 0))
    nodes = stored(usable.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "dedup-nodes")
    texts = docs.where(F.col("doc_id").isNotNull()).withColumnRenamed("doc_id", "node")
    linked = text_links(nodes.select("node", "bands", "sketch"), texts, shared, threshold)
    classes = nodes.select("h1", "h2", "node").join(linked, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("class_id"))
    out = usable.select("doc_id", "h1", "h2").join(classes, ["h1", "h2"]).select("doc_id", "class_id")
    lone = signed.where(F.col("doc_id").isNull() | (F.size("bands") == 0)).select("doc_id", F.col("doc_id").alias("class_id"))
    out = out.unionByName(lone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that are kept, one for each class; repeated rows of one id become one."""
    found = near_duplicates(docs, id_col, text_col, threshold)
    kept = found.where(F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_kept")).distinct()
    named = docs.where(F.col(id_col).isNotNull()).join(kept, F.col(id_col) == F.col("_kept"), "left_semi").dropDuplicates([id_col])
    return named.unionByName(docs.where(F.col(id_col).isNull()))
