"""Embedding near-dedup: navigable small-world graphs per shard, widening beams, verified cosines, components.

Equal vectors are one row first. Distinct vectors are dealt to shards by hash; each shard builds a hierarchical graph by
insertion: batches of vectors search the graph built so far and link both ways with what they find (neighbours thinned for
diversity, the nearest of a random sample as long links). Each pair of shards is one task: the vectors of one search the
graph of the other in lockstep batches. A beam that is full of links is widened until it is not; then an audit compares the
vectors whose id is divisible by 100 with all vectors of the shard, and the searches are repeated with a wider beam until the
audited recall passes. Candidates are verified by cosine in double precision. Links between two shards are searched,
audited and counted for ``SLICE`` vectors at a time, so a group of near copies is held in parts; links inside a shard count
from whichever side found them and are held together. Tasks return counts per vector and a spanning forest, never pairs.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mailwarden.llm.common import salted_join, shuffle_partitions, written
from mailwarden.llm.jaccard_join import Forest
from mailwarden.operators.components import connected_components

#: Least cosine; shards at least, bytes of vectors in a shard; links per node; beam to begin with; audited recall.
LEAST, SHARDS, SHARD_BYTES, NEAR, FAR, BEAM, RECALL = 0.95, 16, 16 << 20, 16, 8, 24, 0.98
#: Vectors that search together, early vectors that long links end at, links that a node can hold.
BATCH, SAMPLE, WIDTH = 512, 256, 3 * (NEAR + FAR)
#: Vectors of a shard whose links with another one are held at a time.
SLICE = 4096


def build(v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers of a graph over unit vectors, lowest first: (nodes, links as node numbers, -1 for none)."""
    layers, nodes, rng = [], np.arange(len(v)), np.random.default_rng(7)
    while True:
        links = _inserted(v[nodes], rng)
        layers.append((nodes, np.where(links >= 0, nodes[links], -1).astype(np.int32)))
        if len(nodes) <= 48:
            return layers
        nodes = np.sort(rng.choice(nodes, max(16, len(nodes) // 16), replace=False))


def _inserted(v: np.ndarray, rng) -> np.ndarray:
    """Links of a layer, by insertion in random order. A batch sees what was inserted before it, and itself."""
    n = len(v)
    order = rng.permutation(n)
    links, used = np.full((n, WIDTH), -1, np.int32), np.zeros(n, np.int64)
    entries, sample = order[:48], order[:SAMPLE]
    for done in range(0, n, BATCH):
        new = order[done:done + BATCH]
        near = np.broadcast_to(new, (len(new), len(new)))
        sims = v[new] @ v[new].T
        np.fill_diagonal(sims, -2)
        if done:
            found, s = search(v, [(np.arange(n), links), (entries, None)], v[new], 2 * NEAR)
            near, sims = np.concatenate([found, near], 1), np.concatenate([s, sims], 1)
        k = min(near.shape[1], 2 * NEAR)
        top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        near, sims = np.take_along_axis(near, top, 1), np.take_along_axis(sims, top, 1)
        q, j = np.nonzero(_diverse(v, near, sims))
        far = v[new] @ v[sample].T
        g, h = np.arange(len(new)).repeat(min(FAR, len(sample))), np.argpartition(-far, min(FAR, len(sample)) - 1, axis=1)[:, :FAR].ravel()
        a, b = np.concatenate([new[q], new[g]]), np.concatenate([near[q, j], sample[h]])
        _join(links, used, a[a != b], b[a != b], rng)
    return links[:, :max(int(used.max(initial=1)), 1)]


def _diverse(v, near, sims):
    """Which of the neighbours, nearest first, are kept: one nearer to a kept one than to the node is passed over, but for the
    nearest three."""
    between = np.einsum("qad,qbd->qab", v[near], v[near])
    kept = np.zeros(near.shape, bool)
    for j in range(near.shape[1]):
        covered = (kept & (between[:, j] > sims[:, j:j + 1])).any(1)
        kept[:, j] = (sims[:, j] > -1.5) & (~covered | (j < 3)) & (kept.sum(1) < NEAR)
    return kept


def _join(links, used, a, b, rng):
    """Link both ways. A full node gives up some later link, so what is new can always be reached."""
    pairs = np.unique(np.concatenate([a * len(links) + b, b * len(links) + a]))
    a, b = pairs // len(links), pairs % len(links)
    place = used[a] + np.arange(len(a)) - np.searchsorted(a, a)
    full = place >= WIDTH
    place[full] = rng.integers(NEAR, WIDTH, int(full.sum()))
    links[a, place] = b
    np.maximum.at(used, a, place + 1)


def search(v: np.ndarray, layers, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, similarities) of a beam per query, by descent through the layers."""
    top = layers[-1][0]
    at = top[np.argmax(q @ v[top].T, axis=1)][:, None]
    sims = np.einsum("qd,qmd->qm", q, v[at])
    for depth in range(len(layers) - 2, -1, -1):
        nodes, links = layers[depth]
        width = beam if depth == 0 else 4
        row = np.full(len(v), -1, np.int32)
        row[nodes] = np.arange(len(nodes))
        ids = np.full((len(q), width), -1, np.int64)
        val = np.full((len(q), width), -2.0, np.float32)
        m = min(width, at.shape[1])
        ids[:, :m], val[:, :m] = at[:, :m], sims[:, :m]
        seen = np.zeros((len(q), len(v)), bool)
        r, c = np.nonzero(ids >= 0)
        seen[r, ids[r, c]] = True
        open_ = ids >= 0
        while True:
            todo = np.where(open_, val, -3)
            best = todo.argmax(1)
            live = np.flatnonzero(todo[np.arange(len(q)), best] > -3)
            if not len(live):
                break
            open_[live, best[live]] = False
            nb = links[row[ids[live, best[live]]]].astype(np.int64)
            ok = nb >= 0
            nb[~ok] = 0
            ok &= ~seen[live[:, None], nb]
            r, c = np.nonzero(ok)
            seen[live[r], nb[r, c]] = True
            s = np.full(nb.shape, -2.0, np.float32)
            s[r, c] = np.einsum("md,md->m", q[live[r]], v[nb[r, c]])
            ai = np.concatenate([ids[live], np.where(ok, nb, -1)], 1)
            av = np.concatenate([val[live], s], 1)
            ao = np.concatenate([open_[live], ok], 1)
            keep = np.argpartition(-av, width - 1, axis=1)[:, :width]
            ids[live], val[live] = np.take_along_axis(ai, keep, 1), np.take_along_axis(av, keep, 1)
            open_[live] = np.take_along_axis(ao, keep, 1) & (ids[live] >= 0)
        order = np.argsort(-val, axis=1)
        at, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(val, order, 1)
        at = np.where(at < 0, at[:, :1], at)
    return at, sims


def range_search(v, layers, q, least: float, beam: int):
    """(query numbers, nodes) of all links found; beams that are full of links are searched again, wider."""
    out_q, out_n, todo, width = [], [], np.arange(len(q)), min(beam, len(v))
    while len(todo):
        again = []
        for start in range(0, len(todo), BATCH):
            own = todo[start:start + BATCH]
            if width >= len(v):
                nodes, sims = np.broadcast_to(np.arange(len(v)), (len(own), len(v))), q[own] @ v.T
                full = np.zeros(len(own), bool)
            else:
                nodes, sims = search(v, layers, q[own], width)
                full = sims[:, -1] >= least - 1e-3
            again.append(own[full])
            r, c = np.nonzero((sims >= least - 1e-3) & ~full[:, None])
            out_q.append(own[r])
            out_n.append(nodes[r, c])
        todo, width = np.concatenate(again), min(4 * width, len(v))
    none = np.zeros(0, np.int64)
    key = np.unique(np.concatenate(out_q or [none]) * max(len(v), 1) + np.concatenate(out_n or [none]))
    return key // max(len(v), 1), key % max(len(v), 1)


class Shard:
    def __init__(self, row):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.copies = np.frombuffer(row["copies"], np.int64)
        self.raw = np.frombuffer(row["vectors"], np.float32).reshape(len(self.ids), -1)
        self.norm = np.linalg.norm(self.raw.astype(np.float64), axis=1)
        self.unit = (self.raw / self.norm[:, None]).astype(np.float32)
        self.layers = [(np.frombuffer(x["nodes"], np.int64), np.frombuffer(x["links"], np.int32).reshape(len(x["nodes"]) // 8, -1))
                       for x in row["layers"]]

    def part(self, start: int) -> Shard:
        """``SLICE`` vectors as searchers; a part has no graph."""
        out = object.__new__(Shard)
        out.ids, out.copies, out.raw, out.norm, out.unit = (x[start:start + SLICE] for x in (self.ids, self.copies, self.raw, self.norm, self.unit))
        return out


def join_shards(a: Shard, b: Shard, same: bool, least: float, beam: int):
    """Links of the vectors of ``a`` in ``b``, exact cosines, audited recall.

    Within one shard a pair counts once, later vector first, whichever of the two found the other.
    """
    audited = a.ids % 100 == 0
    checked = np.flatnonzero(audited)
    while True:
        q, n = range_search(b.unit, b.layers, a.unit, least, beam)
        if same:
            pairs = np.unique((np.maximum(q, n) * len(b.ids) + np.minimum(q, n))[q != n])
            q, n = pairs // len(b.ids), pairs % len(b.ids)
        expected = found = 0
        for start in range(0, len(checked), BATCH):
            own = checked[start:start + BATCH]
            near = (a.unit[own] @ b.unit.T) >= least
            if same:
                near &= ~audited | (np.arange(len(b.ids)) < own[:, None])   # two audited vectors once, no vector with itself
            expected += int(near.sum())
        sims = np.einsum("md,md->m", a.unit[q], b.unit[n]) if len(q) else np.zeros(0)
        found = int(((audited[q] | audited[n] if same else audited[q]) & (sims >= least)).sum())
        if found >= RECALL * expected or beam >= len(b.ids):
            break
        beam = min(2 * beam, len(b.ids))
    keep = []
    for start in range(0, len(q), 1 << 16):
        x, y = q[start:start + (1 << 16)], n[start:start + (1 << 16)]
        cos = np.einsum("md,md->m", a.raw[x].astype(np.float64), b.raw[y].astype(np.float64)) / (a.norm[x] * b.norm[y])
        keep.append(cos >= least)
    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
    return q[keep], n[keep]


def linked(a: Shard, b: Shard, same: bool, least: float, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, links, root) of the vectors with links between two shards; the root is the smallest id of a tree of links."""
    every = a.ids if same else np.concatenate([a.ids, b.ids])
    order = np.argsort(every)
    rank = np.empty(len(every), np.int64)
    rank[order] = np.arange(len(every))
    rank_a, rank_b = rank[:len(a.ids)], rank[len(every) - len(b.ids):]
    links, forest, label = np.zeros(len(every), np.int64), Forest(len(every)), np.arange(len(every))
    for start in range(0, len(a.ids), len(a.ids) if same else SLICE):
        q, n = join_shards(a if same else a.part(start), b, same, least, beam)
        q = q + start
        x, y = rank_a[q], rank_b[n]
        links += np.bincount(x, b.copies[n], len(every)).astype(np.int64) + np.bincount(y, a.copies[q], len(every)).astype(np.int64)
        x, y = label[x], label[y]
        pairs = np.unique(x[x != y] * len(every) + y[x != y])
        if len(pairs):      # trees that meet in this batch, each two once
            x, y = pairs // len(every), pairs % len(every)
            for i, j in zip(x.tolist(), y.tolist()):
                forest.join(i, j)
            moved, new = np.unique(np.concatenate([x, y])), np.arange(len(every))
            new[moved] = [forest.root(i) for i in moved.tolist()]
            label = new[label]
    ids, has = every[order], np.flatnonzero(links)
    return ids[has], links[has], ids[label[has]]


FOUND = "vec long, links long, root long"


def _graph(table: pa.Table) -> pa.Table:
    order = np.argsort(table["rep"].to_numpy())
    v = np.array([table["embedding"][int(i)].as_py() for i in order], np.float32)
    unit = v / np.linalg.norm(v.astype(np.float64), axis=1)[:, None]
    layers = [{"nodes": n.astype(np.int64).tobytes(), "links": x.tobytes()} for n, x in build(unit.astype(np.float32))]
    return pa.Table.from_pylist([{
        "part": table["part"][0].as_py(), "shard": table["shard"][0].as_py(),
        "ids": table["rep"].to_numpy()[order].tobytes(), "copies": table["copies"].to_numpy()[order].tobytes(),
        "vectors": v.tobytes(), "layers": layers}], schema=_GRAPH_ARROW)


_GRAPH = "part int, shard int, ids binary, copies binary, vectors binary, layers array<struct<nodes: binary, links: binary>>"
_GRAPH_ARROW = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("ids", pa.binary()), ("copies", pa.binary()),
                          ("vectors", pa.binary()), ("layers", pa.list_(pa.struct([("nodes", pa.binary()), ("links", pa.binary())])))])


def embedding_dedup(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST,
                    shards: int = SHARDS, shard_bytes: int = SHARD_BYTES, beam: int = BEAM) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of ``df``.

    A vector that is null, empty, zero or holds null or non-finite components links with nothing, nor do vectors of
    different lengths. Equal vectors link with each other, repeated rows as well. A null id has a null component and is
    kept; its vector links with nothing. An empty table gives no rows. Other columns are not read.
    """
    spark = df.sparkSession
    raw = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("embedding"))
    fine = F.expr("vec_id is not null and embedding is not null and size(embedding) > 0 and "
                  "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < float('infinity')) and "
                  "exists(embedding, x -> x <> 0)")
    key = F.when(F.coalesce(fine, F.lit(False)), F.concat_ws(":", F.xxhash64("embedding"), F.xxhash64("embedding", F.lit(1)), F.size("embedding")))
    rows = raw.withColumn("key", key)
    reps = written(rows.filter("key is not null").groupBy("key").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding")), "vectors")
    size = reps.agg(F.sum(F.size("embedding") * 4)).first()[0] or 0
    parts = max(shards, -(-size // shard_bytes))
    dealt = reps.select(F.size("embedding").alias("part"), F.pmod(F.xxhash64("rep"), F.lit(parts)).cast("int").alias("shard"), "rep", "copies", "embedding")
    graphs = written(dealt.groupBy("part", "shard").applyInArrow(_graph, _GRAPH), "graphs")

    def work(batches):
        for batch in batches:
            for r in batch.to_pylist():
                a, b = Shard(r["a"]), Shard(r["b"])
                same = r["a"]["shard"] == r["b"]["shard"]
                found = linked(a, b, same, least, beam)
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["vec", "links", "root"])

    whole = F.struct("shard", "ids", "copies", "vectors", "layers")
    left = graphs.select("part", whole.alias("a"), F.explode(F.sequence(F.lit(0), F.col("shard"))).alias("shard"))
    pairs = left.join(graphs.select("part", "shard", whole.alias("b")), ["part", "shard"]).select("a", "b")
    tasks = pairs.repartition(max(shuffle_partitions(spark), 48), F.xxhash64("a.shard", "b.shard", F.length("a.ids")))
    found = written(tasks.mapInArrow(work, FOUND), "vector_links")
    groups = connected_components(found.select(F.col("vec").alias("src"), F.col("root").alias("dst")))
    counts = found.groupBy(F.col("vec").alias("rep")).agg(F.sum("links").alias("links"))
    answer = written(reps.select("key", "rep", "copies").join(counts, "rep", "left")
                     .join(groups.withColumnRenamed("id", "rep"), "rep", "left")
                     .select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"),
                             F.coalesce("component", "rep").alias("component")).filter("n > 0"), "vector_groups")
    component = F.coalesce("component", "vec_id")
    return salted_join(rows.select("vec_id", "key"), answer, "key", "vec_id").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"))
