"""Near-duplicate embeddings by a robust-pruned flat graph.

Equal vectors of a label are one node. Nodes go to their nearest pivots, several each, so that
shards overlap; every shard builds a graph whose edges are pruned by the robust rule (a neighbour is
dropped if a kept one is `ALPHA` times nearer to it than the node is); the adjacency lists that a
node got in its shards are united. Each node is then searched for in its home shard: a greedy beam
from the shard's medoid, and from the node itself, finds the region, and the range is expanded over
all nodes that are near enough or nearly so. Links are verified by cosine in double precision, and a
link that only one end can see counts for both. Nodes of a task that the search left in different
components are compared exactly, so that no link within a shard is lost between them. Recall is audited against brute force, on nodes drawn
from every group; groups where it is too low are done again with more shards for each node. Groups where
it stays too low, or where the drawn nodes have no link to measure by, are compared in full. Within the
components found, links are then counted in full.

A shard with too many nodes is cut into slices, and every two slices are one task: no pair is lost,
and no task holds more than two slices.
"""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadsieve.llm.common import stored
from leadsieve.llm.components import components

THRESHOLD = 0.93
#: Nodes of a label for each pivot; shards of a node; nodes in a task before its shard is sliced.
PER_PIVOT, OVERLAP, SLICE = 300, 4, 3000
#: Most pivots of a label, all drawn from the nodes by hash: the documented sample of the index.
MOST_PIVOTS = 1024
DEGREE, POOL, ALPHA = 16, 48, 1.2
BEAM, SLACK = 16, 0.06
#: Nodes of the audit from each group, and the recall below which its shards overlap more.
AUDITED, RECALL, ATTEMPTS = 500, 0.98, 3

log = logging.getLogger(__name__)


def nodes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, h1, h2) of every row, and (h1, h2, node, grp, embedding, copies) of the distinct vectors.

    Only vectors with a label, an id and finite components that are not all zero are nodes. `grp` is
    the label and the number of dimensions; only within it are cosines compared.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    good = good & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    vectors = vectors.select("vec_id", "label", "embedding")
    hashes = [F.when(good, F.xxhash64(F.lit(k), "label", "embedding")).alias(f"h{k}") for k in (1, 2)]
    rows = vectors.select("vec_id", *hashes)
    grp = F.concat_ws("/", F.col("label").cast("string"), F.size("embedding").cast("string"))
    found = vectors.where(good).select("vec_id", *hashes, grp.alias("grp"), "embedding")
    nodes = found.groupBy("h1", "h2").agg(
        F.min("vec_id").alias("node"), F.first("grp").alias("grp"), F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("copies")
    )
    return rows, nodes


def unit(arrays) -> np.ndarray:
    x = np.stack([np.asarray(a, dtype=np.float64) for a in arrays])
    # scaled first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pivots_of(nodes: DataFrame, per_pivot: int = PER_PIVOT) -> dict[str, np.ndarray]:
    """Unit vectors of each group's pivots: the nodes that come first by a hash."""
    counts = {r["grp"]: min(MOST_PIVOTS, -(-r["n"] // per_pivot)) for r in nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("_n"))
    # a hash cut that leaves about three times as many candidates as pivots, then the first of them
    share = F.least(F.lit(1.0), F.lit(3.0) * F.greatest(F.col("_n") / per_pivot, F.lit(8.0)) / F.col("_n"))
    share = F.least(share, F.lit(3.0) * MOST_PIVOTS / F.col("_n"))
    drawn = nodes.join(F.broadcast(total), "grp").where((F.pmod(F.xxhash64(F.lit("pivot"), "node"), F.lit(1 << 30)) / (1 << 30)) <= share)
    rows: dict[str, list] = {}
    for r in drawn.select("grp", F.xxhash64(F.lit("pivot"), "node").alias("k"), "node", "embedding").collect():
        rows.setdefault(r["grp"], []).append((r["k"] % (1 << 30), r["node"], r["embedding"]))
    return {g: unit([e for _, _, e in sorted(x, key=lambda t: t[:2])[: counts[g]]]) for g, x in rows.items()}


def sharded(nodes: DataFrame, pivots: dict[str, np.ndarray], overlap: int) -> DataFrame:
    """The nodes with `shards`, nearest pivot first (numbers within the group)."""
    shared = nodes.sparkSession.sparkContext.broadcast(pivots)

    def run(frames):
        known = shared.value
        for df in frames:
            out = np.empty(len(df), dtype=object)
            for grp, at in df.groupby("grp").indices.items():
                p = known.get(grp)
                if p is None:
                    out[at] = pd.Series([[0]] * len(at))
                    continue
                near = np.argsort(-(unit(df["embedding"].iloc[at]) @ p.T), axis=1, kind="stable")[:, :overlap]
                for i, row in zip(at, near.tolist(), strict=True):
                    out[i] = row
            yield df.assign(shards=out)

    from pyspark.sql import types as T

    schema = T.StructType([*nodes.schema.fields, T.StructField("shards", T.ArrayType(T.IntegerType()))])
    return nodes.mapInPandas(run, schema)


def tasks_of(placed: DataFrame, slice_size: int) -> DataFrame:
    """A row for each node and task, with `task` and `slice`; a task is a shard or two slices of one."""
    each = placed.withColumn("shard", F.explode("shards"))
    sizes = each.groupBy("grp", "shard").agg(F.ceil(F.count(F.lit(1)) / slice_size).cast("int").alias("_g"))
    each = each.join(sizes, ["grp", "shard"])
    each = each.withColumn("slice", F.pmod(F.xxhash64(F.lit("slice"), "node"), F.col("_g")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_g") - 1)).alias("_other")
    each = each.select("*", other)
    low, high = F.least("slice", "_other"), F.greatest("slice", "_other")
    return each.withColumn("task", F.concat_ws("/", "grp", "shard", low, high)).drop("_g", "_other")


def robust_prune(x: np.ndarray, degree: int = DEGREE, pool: int = POOL, alpha: float = ALPHA) -> list[np.ndarray]:
    """For each unit vector the neighbours that the robust rule keeps among its nearest ones."""
    n = len(x)
    keep: list[np.ndarray] = [np.empty(0, dtype=np.int64)] * n
    if n < 2:
        return keep
    pool = min(pool, n - 1)
    for at in range(0, n, 512):
        sims = x[at : at + 512] @ x.T
        sims[np.arange(len(sims)), np.arange(at, at + len(sims))] = -np.inf
        near = np.argpartition(-sims, pool - 1, axis=1)[:, :pool]
        for i in range(len(sims)):
            c = near[i][np.argsort(-sims[i][near[i]], kind="stable")]
            mine = np.sqrt(np.maximum(0, 2 - 2 * sims[i][c]))
            between = np.sqrt(np.maximum(0, 2 - 2 * (x[c] @ x[c].T)))
            alive = np.ones(pool, dtype=bool)
            chosen = []
            for j in range(pool):
                if alive[j]:
                    chosen.append(j)
                    if len(chosen) == degree:
                        break
                    alive &= alpha * between[j] > mine
            keep[at + i] = c[chosen]
    return keep


def built(tasks: DataFrame) -> DataFrame:
    """(node, near): the adjacency lists of each task's graph, edges in both directions."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        ids = df["node"].to_numpy()
        kept = robust_prune(unit(df["embedding"]))
        out = [set(k.tolist()) for k in kept]
        for i, k in enumerate(kept):
            for j in k.tolist():
                if len(out[j]) < 3 * DEGREE:
                    out[j].add(i)
        return pd.DataFrame({"node": ids, "near": [ids[sorted(k)].tolist() for k in out]})

    return tasks.select("task", "node", "embedding").groupBy("task").applyInPandas(run, "node long, near array<long>")


def neighbourhoods(x: np.ndarray, near: list[np.ndarray], queries: np.ndarray, threshold: float):
    """For each query (a row of x) the rows at least `threshold` near, by greedy search over the graph."""
    n = len(x)
    width = max(1, max((len(k) for k in near), default=1))
    table = np.full((n, width), -1, dtype=np.int64)
    for i, k in enumerate(near):
        table[i, : len(k)] = k
    medoid = int(np.argmax(x @ x.mean(axis=0)))
    for q in queries.tolist():
        seen = np.zeros(n, dtype=bool)
        seen[[medoid, q]] = True
        ids = np.unique(np.array([medoid, q]))
        sims = x[ids] @ x[q]
        done = np.zeros(len(ids), dtype=bool)
        while True:
            # the beam's best rows, and all rows in the widened range
            front = sims >= threshold - SLACK
            front[np.argpartition(-sims, BEAM - 1)[:BEAM] if len(sims) > BEAM else slice(None)] = True
            front &= ~done
            if not front.any():
                break
            done |= front
            new = table[ids[front]].ravel()
            new = np.unique(new[new >= 0])
            new = new[~seen[new]]
            if len(new):
                seen[new] = True
                ids, sims, done = np.append(ids, new), np.append(sims, x[new] @ x[q]), np.append(done, np.zeros(len(new), dtype=bool))
        found = ids[(sims >= threshold) & (ids != q)]
        yield q, found


def searched(tasks: DataFrame, adjacency: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root): links seen in a task, by either end, and a node of the same component."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        ids, copies, slices = df["node"].to_numpy(), df["copies"].to_numpy(), df["slice"].to_numpy()
        shard = int(df["shard"].iloc[0])
        shards = [set(s) for s in df["shards"]]
        home = np.array([s[0] for s in df["shards"]])
        at = {v: i for i, v in enumerate(ids.tolist())}
        near = [np.array([at[v] for v in k if v in at], dtype=np.int64) for k in df["near"]]
        two = len(set(slices.tolist())) > 1
        links = np.zeros(len(ids), dtype=np.int64)
        root = np.arange(len(ids))

        def top(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        x = unit(df["embedding"])
        for q, found in neighbourhoods(x, near, np.flatnonzero(home == shard), threshold):
            if two:  # pairs of one slice belong to that slice's own task
                found = found[slices[found] != slices[q]]
            links[q] += copies[found].sum()
            for y in found.tolist():
                if home[y] not in shards[q]:  # y's own search, elsewhere, cannot meet q
                    links[y] += copies[q]
                a, b = top(q), top(y)
                if a != b:
                    root[max(a, b)] = min(a, b)
        # the graph may have no way between two tight groups: pairs of different components, exactly
        whole = np.array([top(i) for i in range(len(ids))])
        root, own, lists = whole, home == shard, np.stack(df["shards"].to_numpy())
        for start in range(0, len(ids), 512):
            part = slice(start, start + 512)
            hit = (x[part] @ x.T >= threshold) & (whole[part, None] != whole[None, :])
            if two:
                hit &= slices[part, None] != slices[None, :]
            i, j = np.nonzero(hit)
            i, j = i[own[i + start]] + start, j[own[i + start]]
            links += np.bincount(i, weights=copies[j], minlength=len(ids)).astype(np.int64)
            unmet = ~(lists[i] == home[j][:, None]).any(axis=1)
            links += np.bincount(j[unmet], weights=copies[i[unmet]], minlength=len(ids)).astype(np.int64)
            root = merged(root, start, hit)
        roots = ids[root]
        some = (links > 0) | (roots != ids)
        return pd.DataFrame({"node": ids[some], "links": links[some], "root": roots[some]})

    wide = tasks.join(adjacency, "node")
    return wide.select("task", "node", "embedding", "copies", "shards", "shard", "slice", "near").groupBy("task").applyInPandas(
        run, "node long, links long, root long"
    )


def recounted(nodes: DataFrame, linked: DataFrame, threshold: float, slice_size: int) -> DataFrame:
    """(node, links): the links within each component that the search found, counted once more in full.

    A link that the search missed mostly joins two nodes that others connect. Components are cut
    into slices like shards.
    """
    placed = nodes.drop("grp").join(linked, "node").withColumn("grp", F.col("component").cast("string")).withColumn("shards", F.array(F.lit(0)))
    tasks = tasks_of(placed, slice_size).select("task", "node", "embedding", "copies", "slice")

    def run(df: pd.DataFrame) -> pd.DataFrame:
        x, copies, slices = unit(df["embedding"]), df["copies"].to_numpy(), df["slice"].to_numpy()
        two = len(set(slices.tolist())) > 1
        links = np.zeros(len(x), dtype=np.int64)
        for at in range(0, len(x), 512):
            part = slice(at, at + 512)
            hit = x[part] @ x.T >= threshold
            hit[np.arange(len(hit)), np.arange(at, at + len(hit))] = False
            if two:
                hit &= slices[part, None] != slices[None, :]
            links[part] = hit @ copies
        return pd.DataFrame({"node": df["node"], "links": links})

    each = tasks.groupBy("task").applyInPandas(run, "node long, links long")
    return each.groupBy("node").agg(F.sum("links").alias("links"))


def merged(labels: np.ndarray, first: int, hit: np.ndarray) -> np.ndarray:
    """`labels` once row `first + i` has the label of every column that row i of `hit` marks."""
    for i in np.flatnonzero(hit.any(axis=1)):
        some = np.unique(np.append(labels[hit[i]], labels[first + i]))
        if len(some) > 1:
            labels = np.where(np.isin(labels, some), some[0], labels)
    return labels


def compared(nodes: DataFrame, threshold: float, slice_size: int) -> DataFrame:
    """(node, links, root) from every pair of every group, two slices to a task: no graph, nothing missed."""
    tasks = tasks_of(nodes.withColumn("shards", F.array(F.lit(0))), slice_size).select("task", "node", "embedding", "copies", "slice")

    def run(df: pd.DataFrame) -> pd.DataFrame:
        x, ids, copies, slices = unit(df["embedding"]), df["node"].to_numpy(), df["copies"].to_numpy(), df["slice"].to_numpy()
        two = len(set(slices.tolist())) > 1
        links, labels = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        for at in range(0, len(x), 512):
            part = slice(at, at + 512)
            hit = x[part] @ x.T >= threshold
            hit[np.arange(len(hit)), np.arange(at, at + len(hit))] = False
            if two:
                hit &= slices[part, None] != slices[None, :]
            links[part] = hit @ copies
            labels = merged(labels, at, hit)
        some = links > 0
        return pd.DataFrame({"node": ids[some], "links": links[some], "root": ids[labels][some]})

    return tasks.groupBy("task").applyInPandas(run, "node long, links long, root long")


def audit(nodes: DataFrame, seen: DataFrame, threshold: float, audited: int = AUDITED, slice_size: int = SLICE) -> DataFrame:
    """(grp, recall): share of the true links of some nodes of each group that were found.

    About `audited` nodes of every group, drawn by hash, are compared with all nodes of the group, in
    blocks. `recall` is NULL if they have no true link and are not the whole group: nothing was measured.
    """
    sizes = nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("_n"))
    sized = nodes.select("node", "grp", "embedding", "copies").join(sizes, "grp")
    blocks = F.ceil(F.col("_n") / slice_size).cast("int")
    drawn = F.pmod(F.xxhash64(F.lit("audit"), "node"), F.lit(1 << 30)) / (1 << 30) < F.lit(float(audited)) / F.col("_n")
    asked = sized.where(drawn).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("asked", F.lit(True))
    rest = sized.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "node"), blocks).cast("int")).withColumn("asked", F.lit(False))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        q, part = df[df["asked"]], df[~df["asked"]]
        if not len(q) or not len(part):
            return pd.DataFrame({"node": [], "grp": [], "links": []})
        hit = (unit(part["embedding"]) @ unit(q["embedding"]).T >= threshold) & (part["node"].to_numpy()[:, None] != q["node"].to_numpy()[None, :])
        return pd.DataFrame({"node": q["node"], "grp": q["grp"], "links": part["copies"].to_numpy() @ hit})

    true = asked.unionByName(rest).groupBy("grp", "block").applyInPandas(run, "node long, grp string, links long")
    true = true.groupBy("grp", "node").agg(F.sum("links").alias("true")).join(seen, "node", "left")
    got = F.least("true", F.coalesce("links", F.lit(0)))
    sums = true.groupBy("grp").agg(F.sum("true").alias("t"), F.sum(got).alias("f"), F.count(F.lit(1)).alias("c"))
    recall = F.when(F.col("t") > 0, F.col("f") / F.col("t")).when(F.col("c") == F.col("_n"), F.lit(1.0))
    return sizes.join(sums, "grp", "left").select("grp", recall.alias("recall"))


def vector_links(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    overlap: int = OVERLAP,
    per_pivot: int = PER_PIVOT,
    slice_size: int = SLICE,
    wanted: float = RECALL,
) -> DataFrame:
    """One row per row of (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    n_links counts the other vectors of the same label at a cosine of `threshold` or more, copies
    included. Rows with a NULL label, NULL or unusable vector link with nothing and are their own
    component; a row without an id has no component and is kept. Repeated rows are vectors of their
    own with one id. Vectors of different length are never linked. Other columns are not read; an
    empty table gives an empty one. Runs when called.
    """
    rows, nodes = nodes_of(vectors)
    rows, nodes = stored(rows, "vector-rows"), stored(nodes, "vector-nodes")
    pivots = pivots_of(nodes, per_pivot)
    left, found, unsure = nodes, None, None
    for attempt in range(ATTEMPTS):
        tasks = stored(tasks_of(sharded(left, pivots, overlap), slice_size), "vector-tasks")
        adjacency = built(tasks).groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
        part = stored(searched(tasks, adjacency, threshold), "vector-links")
        found = part if found is None else found.unionByName(part)
        links = part.groupBy("node").agg(F.sum("links").alias("links"))
        recall = stored(audit(left, links, threshold, slice_size=slice_size), "vector-recall")
        low = recall.where(F.col("recall") < wanted).select("grp")
        blind = recall.where("recall IS NULL").select("grp")
        unsure = blind if unsure is None else unsure.unionByName(blind)
        row = recall.agg(F.min("recall").alias("least"), F.count_if(F.col("recall") < wanted).alias("low")).first()
        log.info("least recall of a group %s with %d shards for each node, %d groups too low", row["least"], overlap, row["low"])
        if not row["low"]:
            break
        if attempt == ATTEMPTS - 1:
            unsure = unsure.unionByName(low)
            break
        left = stored(left.join(low, "grp", "left_semi"), "vector-left")
        overlap *= 2
    if not unsure.isEmpty():
        log.info("groups without a measured recall of %s are compared in full", wanted)
        found = found.unionByName(stored(compared(nodes.join(unsure, "grp", "left_semi"), threshold, slice_size), "vector-compared"))
    linked = stored(components(found, "node", "root"), "vector-components")
    links = recounted(nodes, linked, threshold, slice_size)
    per_node = nodes.select("h1", "h2", "node", "copies").join(links, "node", "left").join(linked, "node", "left")
    per_node = per_node.select(
        "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")
    )
    lone = rows.where("h1 IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.where("h1 IS NOT NULL").join(per_node, ["h1", "h2"]).select("vec_id", "n_links", "component_id").unionByName(lone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
