"""Product codes of vectors by exact integer k-means, its searches pruned by pivots (LAESA).

Components become integers, vectors are cut into equal parts, and each part position has a codebook
of a few entries that some rounds of assigning and averaging improve. For each codebook a few pivots
are fixed once, and every part's distances to them are computed once and kept beside it. In each
round the distances between pivots and entries give a lower bound of the distance of each part to
each entry (triangle inequality). Entries are tried in the order of their bounds, exactly and in
integers, until the next bound lies beyond the best distance found; the rest are never evaluated.

A round is one pass over the kept parts. What leaves a task is one sum for each place of each
codebook, so neither labels nor hot entries matter, and the driver holds codebooks only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadsieve.llm.common import map_batches, stored

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Pivots of each codebook, drawn from its first entries.
PIVOTS = 3
#: Kept distances are single precision; a bound is lowered by this share of the two distances.
SLACK = 2.0**-21
ROWS = 4096


def spans(dimensions: int, parts: int = PARTS) -> list[slice]:
    """Consecutive parts of equal length; where that does not divide, the first are one longer."""
    edges = np.cumsum([0, *(dimensions // parts + (i < dimensions % parts) for i in range(parts))])
    return [slice(int(a), int(b)) for a, b in zip(edges, edges[1:], strict=False)]


def integers(values: np.ndarray, dimensions: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x); beyond what keeps a vector's squared distances in 58 bits, the bound itself."""
    most = 1 << max(1, (58 - max(1, dimensions - 1).bit_length()) // 2 - 1)
    return np.clip(np.floor(values.astype(np.float64) * scale), -most, most).astype(np.int64)


def fixed_pivots(entries: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Entries far from each other: the first, then each time the one farthest from those chosen."""
    chosen = [0]
    nearest = ((entries - entries[0]) ** 2).sum(axis=1)
    while len(chosen) < count and nearest.max(initial=0):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((entries - entries[chosen[-1]]) ** 2).sum(axis=1))
    return entries[chosen]


def distances(parts: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distance of each part to each point, one point at a time."""
    columns = [np.sqrt(((parts - x) ** 2).sum(axis=1).astype(np.float64)) for x in points]
    return np.stack(columns, axis=1)


def nearest(parts: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of each part's nearest entry (the lower index of equals), and how
    many exact distances that took."""
    between = distances(entries, pivots)
    bound = np.zeros((len(parts), len(entries)))
    for p in range(len(pivots)):
        mine, its = to_pivots[:, p, None].astype(np.float64), between[None, :, p]
        np.maximum(bound, np.abs(mine - its) - SLACK * (mine + its), out=bound)
    order = bound.argsort(axis=1, kind="stable")
    best, root, at = np.full(len(parts), np.iinfo(np.int64).max), np.full(len(parts), np.inf), np.zeros(len(parts), dtype=np.int64)
    active, tried = np.arange(len(parts)), 0
    for turn in range(len(entries)):
        entry = order[active, turn]
        open_ = bound[active, entry] <= root[active]
        active, entry = active[open_], entry[open_]
        if not len(active):
            break
        tried += len(active)
        off = parts[active] - entries[entry]
        exact = np.einsum("ij,ij->i", off, off)
        better = (exact < best[active]) | ((exact == best[active]) & (entry < at[active]))
        rows = active[better]
        best[rows], at[rows] = exact[better], entry[better]
        root[rows] = np.sqrt(best[rows].astype(np.float64))
    return at, best, tried


def kept_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, v) of the rows whose vector is whole: not null, every component finite."""
    double = F.col(vec_col).cast("array<double>")
    named = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), double.alias("v"))
    return named.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))))


def first_entries(kept: DataFrame, count: int = ENTRIES) -> tuple[int | None, list[list[float]]]:
    """The number of dimensions of the smallest id's vector, and the vectors of the smallest ids that have as many.

    NULL is the largest id; of several vectors of one id the smallest counts. Collects `count` vectors.
    """
    sized = kept.select("vec_id", F.size("v").alias("d"))
    one = sized.orderBy(F.col("vec_id").asc_nulls_last(), "d").limit(1).collect()
    if not one:
        return None, []
    fits = kept.where(F.size("v") == one[0]["d"])
    ids = [r["vec_id"] for r in fits.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(count).collect()]
    mine = F.col("vec_id").isin([x for x in ids if x is not None])
    if None in ids:
        mine = mine | F.col("vec_id").isNull()
    rows = fits.where(mine).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy(F.col("vec_id").asc_nulls_last())
    return one[0]["d"], [r["v"] for r in rows.collect()]


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), width)


def measured(kept: DataFrame, dimensions: int, pivots: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """(vec_id, label, x, p): integers of each vector and its parts' distances to the pivots, once."""
    cut = spans(dimensions, len(pivots))
    schema = T.StructType(
        [kept.schema["vec_id"], kept.schema["label"], T.StructField("x", T.ArrayType(T.LongType())), T.StructField("p", T.ArrayType(T.FloatType()))]
    )

    def work(batch):
        x = integers(_matrix(batch.column("v"), dimensions), dimensions, scale)
        p = np.concatenate([distances(x[:, s], v) for s, v in zip(cut, pivots, strict=True)], axis=1).astype(np.float32)
        lists = [pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * m.shape[1], m.ravel()) for m in (x, p)]
        return [batch.column("vec_id"), batch.column("label"), *lists]

    return map_batches(kept, lambda: work, schema)


def _assigned(batch, codebooks: list[np.ndarray], pivots: list[np.ndarray], cut: list[slice]):
    """(integers, then for each part: indexes and squared distances) of a batch."""
    x = _matrix(batch.column("x"), cut[-1].stop)
    p = _matrix(batch.column("p"), sum(map(len, pivots)))
    ends = np.cumsum([0, *map(len, pivots)])
    found = [nearest(x[:, s], p[:, ends[i] : ends[i + 1]], codebooks[i], pivots[i])[:2] for i, s in enumerate(cut)]
    return x, found


def improved(parts: DataFrame, codebooks: list[np.ndarray], pivots: list[np.ndarray], cut: list[slice]) -> list[np.ndarray]:
    """The codebooks after one round: the floored means of what each entry was given."""

    def run(batches):
        sums = [np.zeros((len(c), c.shape[1] + 1), dtype=np.int64) for c in codebooks]
        for batch in batches:
            if batch.num_rows:
                x, found = _assigned(batch, codebooks, pivots, cut)
                for i, (s, (at, _)) in enumerate(zip(cut, found, strict=True)):
                    np.add.at(sums[i], at, np.concatenate([x[:, s], np.ones((len(x), 1), dtype=np.int64)], axis=1))
        flat = np.concatenate([m.ravel() for m in sums])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["place", "total"])

    totals = parts.select("x", "p").mapInArrow(run, "place long, total long").groupBy("place").agg(F.sum("total").alias("total"))
    found = {r["place"]: r["total"] for r in totals.collect()}  # one number for each place of a codebook
    out, at = [], 0
    for entries in codebooks:
        new = entries.copy()
        width = entries.shape[1] + 1
        for k in range(len(entries)):
            *total, count = (found.get(at + k * width + j, 0) for j in range(width))
            if count:
                new[k] = [t // count for t in total]
        at += len(entries) * width
        out.append(new)
    return out


def vector_codes(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every kept row, and the codebooks, one matrix for each part.

    Rows whose vector is NULL or holds NULL or non-finite components are dropped. The smallest id's
    vector sets the number of dimensions; rows with another number stay, without code and error.
    Parts differ by one in length if that number does not divide. With fewer ids than `entries` a
    codebook has as many entries as there are ids. Labels and ids may be NULL or repeat, rows may
    repeat, other columns are not read. An empty table gives no rows and no codebooks. Components
    too large for exact sums (for 64 dimensions beyond 8192 in magnitude) count as the largest that
    are not. Runs when called: the parts and their pivot distances are written to the shared scratch
    folder and read once a round.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, id_col, vec_col, label_col)
    schema = T.StructType(
        [kept.schema["vec_id"], kept.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
    )
    dimensions, seeds = first_entries(kept, entries)
    if dimensions is None:
        return spark.createDataFrame([], schema), []
    cut = spans(dimensions, parts)
    first = integers(np.array(seeds, dtype=np.float64).reshape(len(seeds), dimensions), dimensions, scale)
    codebooks = [first[:, s] for s in cut]
    pivots = [fixed_pivots(c) for c in codebooks]
    same = F.size("v") == dimensions
    table = stored(measured(kept.where(same), dimensions, pivots, scale), "codes-parts")
    for _ in range(rounds):
        codebooks = improved(table, codebooks, pivots, cut)

    def make():
        digits = np.array([f"{i:02x}" for i in range(entries)], dtype=object)

        def work(batch):
            _, found = _assigned(batch, codebooks, pivots, cut)
            code = sum((digits[at] for at, _ in found[1:]), start=digits[found[0][0]])
            return [batch.column("vec_id"), batch.column("label"), code.tolist(), sum(d for _, d in found)]

        return work

    none = [F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")]
    coded = map_batches(table, make, schema).unionByName(kept.where(~same).select("vec_id", "label", *none))
    return stored(coded, "codes"), codebooks


def codebooks_sha256(codebooks: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for c in codebooks for x in c.ravel().tolist()).encode()).hexdigest()


def code_report(vectors: DataFrame, **columns) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256); `label_error` is NULL beyond a long.

    Labels are summed map-side and joined back, one row for each label, NULL among them.
    """
    codes, codebooks = vector_codes(vectors, **columns)
    sums = codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint").alias("label_error"))
    sums = sums.withColumnRenamed("label", "_label")
    joined = codes.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(codebooks)).alias("codebooks_sha256"))
