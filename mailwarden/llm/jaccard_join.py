"""N-gram Jaccard join: pivots, Voronoi regions, triangle-inequality windows, exact and recursive.

Distance is 1 - Jaccard over sets of word shingles, a metric; two sets are linked at Jaccard of ``least`` percent or more, that is
at distance D = 1 - least / 100 or less (0.1 unless another ``least`` is given).

Level 0. Whole documents are useless as first pivots: a text is at distance 1 from nearly every other text, so no window
would exclude anything. The first pivots are therefore shingles, and a set lies in the regions of its rarest ones. All
shingles are ordered by the number of rows that hold them (at most ``TOP``), then by key. Linked sets share ``least``
percent of the shingles of either, so among the first n - ceil(n * least / 100) + 1 shingles of both, in that order, is one
that they share: these are a set's pivots, and no linked pair is lost. Most of them occur in one set only and are
dropped where they are counted; a set that has enough of those links with nothing. A passage that many documents share is
frequent, so it is a pivot only of documents that are little else. Regions that share a set are merged, so that every set
meets all that may be near it, in one place.

Level 1 and on. Within a region documents are pivots: each set learns its exact distance to a pivot, is linked if that is
D or less, and is compared with other sets only where their distances to every pivot so far differ by at most D and
they are not yet in one component. Regions beyond ``REGION`` sets are dealt to the nearest of several pivots in a
distributed round, with sets at most 2 D farther from another pivot replicated to it, and joined again; a region whose
sets lie equally far from all pivots is compared block by block instead.

Copies are one set: all work is on distinct sets, so a group of copies of any size is one row.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from mailwarden.llm.common import bitmap, flagged, map_texts, pieces, salted_join, shuffle_partitions, written
from mailwarden.llm.words import LOWER, hash_texts, mix, windows
from mailwarden.operators.components import connected_components

SHINGLE = 3
#: Least Jaccard of a link, in percent.
LEAST = 90
#: Sets that one task joins at most.
REGION = 4096
#: Counts of a shingle are told apart up to this one; bits of a shingle's key.
TOP, BITS = 32767, 48
PIVOTS = 8
#: Keys (and sets) that a task holds before it hands them on; these are a group, and groups of a task are told apart by
#: their last ``GROUP`` bits.
HELD, GROUP = 1 << 20, 20
U = np.uint64


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
    h, ptr = hash_texts([t.translate(LOWER) for t in texts])
    out = []
    for i in range(len(texts)):
        own = h[ptr[i]:ptr[i + 1]]
        out.append(np.unique(windows(own, min(size, len(own)))) if len(own) else own)
    return out


def set_keys(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit keys of a set, as signed numbers."""
    a = mix(np.bitwise_xor.reduce(mix(s + U(11)))[None] + U(len(s)))[0]
    b = mix(np.add.reduce(mix(s ^ U(0x5DEECE66D)))[None])[0]
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def shingle_keys(sets: list[np.ndarray], least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(key, number of its set) of every shingle. Keys of ``BITS`` bits: two shingles with the same key only bring two
    sets together that are then compared.

    Sets below ``smallest`` shingles link with equal sets only, which are copies, and have no keys: n link with n + 1
    that hold them where n / (n + 1) is ``least`` or more (nine with ten at 90).
    """
    smallest = -(-least // (100 - least))
    sizes = np.array([len(s) if len(s) >= smallest else 0 for s in sets], np.int64)
    flat = np.concatenate([s[:n] for s, n in zip(sets, sizes)] or [np.zeros(0, np.uint64)])
    return mix(flat + U(17)) >> U(64 - BITS), np.repeat(np.arange(len(sets)), sizes)


def pivots_needed(n, least: int = LEAST):
    """How many of its rarest shingles a set of n has as pivots."""
    return n - (n * least + 99) // 100 + 1


def shared_cells(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, cell) of the keys that have two owners or more, by owner. A cell is the number of owners above the key, so
    that the order of cells is the order of pivots."""
    order = np.argsort(keys, kind="stable")
    k, own = keys[order], owners[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(k)))
    many = np.repeat(counts, counts)
    cells = (np.minimum(many, TOP).astype(np.uint64) << U(BITS) | k)[many > 1].astype(np.int64)
    own = own[many > 1]
    order = np.argsort(own, kind="stable")
    return own[order], cells[order]


def choose_pivots(owners: np.ndarray, cells: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(owner, cell) of the pivots. ``sizes`` has the shingles of every owner; those without a shared cell come first."""
    order = np.lexsort((cells, owners))
    owners, cells = owners[order], cells[order]
    shared = np.bincount(owners, minlength=len(sizes))
    rank = np.arange(len(owners)) - (np.cumsum(shared) - shared)[owners]
    use = rank < (pivots_needed(sizes, least) - (sizes - shared))[owners]
    return owners[use], cells[use]


def _packed(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BITS // 8]).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) * 8 // BITS, 8), np.uint8)
    out[:, :BITS // 8] = np.frombuffer(raw, np.uint8).reshape(-1, BITS // 8)
    return out.view("<u8").ravel()


SCAN = "kind int, doc_id long, sid long, n long, key2 long, part long, bucket int, keys binary, owners binary"


def _steps(numbers: np.ndarray) -> bytes:
    return zstandard.compress(np.diff(numbers, prepend=0).tobytes(), 1)


def _from_steps(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(raw), np.int64))


def _scan(df: DataFrame, id_col: str, text_col: str, size: int, buckets: int, least: int) -> DataFrame:
    """Per text its set (kind 0); per group of sets that a task holds at the same time, and bucket, the keys of the sets and
    their owners (kind 1); per group its owners and their sizes (kind 2).

    An owner is the place of a set in its group. Copies within a group have one owner. A group is bounded, whatever the
    size of the scan's tasks is.
    """
    shape = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in ("doc_id", "sid", "n", "key2", "part")),
                       ("bucket", pa.int32()), ("keys", pa.binary()), ("owners", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        held, owners, seen, n_held, part = [], [], {}, 0, TaskContext.get().partitionId() << GROUP

        def flush():
            a, own = np.concatenate(held), np.concatenate(owners)
            which = (mix(a) % U(buckets)).astype(np.int64)
            order = np.lexsort((own, which))
            cut = np.searchsorted(which[order], np.arange(buckets + 1))
            out = [(2, None, None, None, None, part, None, np.array(list(seen), np.int64).tobytes(), np.array(list(seen.values()), np.int64).tobytes())]
            for b in range(buckets):
                k = order[cut[b]:cut[b + 1]]
                if len(k):
                    out.append((1, None, None, None, None, part, b, _packed(a[k]), _steps(own[k])))
            return out

        def rows_of():
            nonlocal n_held, part
            for rows in pieces(batches):
                sets, out = shingle_sets([t or b"" for _, t in rows], size), []
                own = np.zeros(len(rows), np.int64)
                for i, ((key, _), s) in enumerate(zip(rows, sets)):
                    if not len(s) or key is None:
                        out.append((0, key, None, len(s), None, None, None, None, None))
                        sets[i] = s[:0]
                        continue
                    sid, key2 = set_keys(s)
                    out.append((0, key, sid, len(s), key2, None, None, None, None))
                    if sid in seen:
                        sets[i] = s[:0]
                        continue
                    own[i] = len(seen)
                    seen[sid] = len(s)
                keys, which = shingle_keys(sets, least)
                held.append(keys)
                owners.append(own[which])
                n_held += len(keys)
                yield out
                if n_held >= HELD or len(seen) >= HELD:
                    yield flush()
                    held.clear()
                    owners.clear()
                    seen.clear()
                    n_held, part = 0, part + 1
            if seen:
                yield flush()

        for out in rows_of():
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), shape.types)], schema=shape)

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, SCAN)


def _near(scan: DataFrame, least: int) -> DataFrame:
    """(src, dst): each set with the least set of every region of a pivot of its own.

    Keys meet in their bucket; the shared ones go back, packed, to the group that has their owners.
    """
    place = HELD.bit_length() + 1             # bits of an owner: the last piece of a group may go beyond HELD

    def meet(table):
        parts = table["part"].to_pylist()
        lists = [_from_steps(x) for x in table["owners"].to_pylist()]
        own, cells = shared_cells(_unpacked(b"".join(table["keys"].to_pylist())), np.concatenate([(t << place) + x for t, x in zip(parts, lists)]))
        home = own >> place
        first = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1]))) if len(own) else np.zeros(0, np.int64)
        runs = list(zip(first.tolist(), [*first[1:].tolist(), len(own)]))
        return pa.table({"part": pa.array(home[first], pa.int64()), "cells": pa.array([cells[a:b].tobytes() for a, b in runs], pa.binary()),
                         "owners": pa.array([_steps(own[a:b] & ((1 << place) - 1)) for a, b in runs], pa.binary())})

    def choose(met, sets):
        sids, sizes = (np.frombuffer(b"".join(sets[c].to_pylist()), np.int64) for c in ("keys", "owners"))        # one row per group
        own = [_from_steps(x) for x in met["owners"].to_pylist()]
        cells = [np.frombuffer(x, np.int64) for x in met["cells"].to_pylist()]
        none = [np.zeros(0, np.int64)]
        own, cells = choose_pivots(np.concatenate(own or none), np.concatenate(cells or none), sizes, least)
        return pa.table({"sid": pa.array(sids[own], pa.int64()), "key": pa.array(cells, pa.int64())})

    met = scan.filter("kind = 1").select("part", "bucket", "keys", "owners").groupBy("bucket").applyInArrow(meet, "part long, cells binary, owners binary")
    sets = scan.filter("kind = 2").select("part", "keys", "owners")
    chosen = met.groupBy("part").cogroup(sets.groupBy("part")).applyInArrow(choose, "sid long, key long")
    pivots = written(chosen, "jaccard_pivots")
    firsts = written(pivots.groupBy("key").agg(F.min("sid").alias("first"), F.max("sid").alias("last")).filter("first < last").drop("last"), "jaccard_firsts")
    # a row per shared shingle: a file of a few MB is ten times that on the driver
    return pivots.join(firsts.hint("merge"), "key").filter("sid <> first").select(F.col("sid").alias("src"), F.col("first").alias("dst")).distinct()


class Forest:
    """Union-find; the root is the least member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def overlap(s: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Size of the intersection of ``s`` with each set of ``flat`` that begins at ``starts``."""
    if not len(starts):
        return np.zeros(0, np.int64)
    first = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) + np.repeat(starts - first, sizes)
    values = flat[at]
    place = np.minimum(np.searchsorted(s, values), len(s) - 1)
    return np.add.reduceat((s[place] == values).astype(np.int64), first)


def linked(inter, a, b, least: int = LEAST):
    return 100 * inter >= least * (a + b - inter)


def join_region(sets: list[np.ndarray], halves: np.ndarray | None = None, least: int = LEAST) -> Forest:
    """Exact components of one region. With ``halves`` (0 or 1 per set) only pairs across the halves are compared."""
    m = len(sets)
    forest, sizes = Forest(m), np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    starts = np.cumsum(sizes) - sizes
    known: list[np.ndarray] = []                         # distances of all sets to the first pivots
    comp = np.arange(m)
    for x in range(m):
        if len(known) < PIVOTS and m > 8:
            todo = np.arange(m)
        else:
            near = np.ones(m - x - 1, bool)
            for d in known:
                near &= np.abs(d[x + 1:] - d[x]) <= 1 - least / 100 + 1e-9
            near &= (100 * sizes[x + 1:] >= least * sizes[x]) & (least * sizes[x + 1:] <= 100 * sizes[x])
            near &= comp[x + 1:] != comp[x]
            if halves is not None:
                near &= halves[x + 1:] != halves[x]
            todo = np.flatnonzero(near) + x + 1
        if not len(todo):
            continue
        inter = overlap(sets[x], flat, starts[todo], sizes[todo])
        if len(todo) == m and m > 8 and len(known) < PIVOTS:
            known.append(1 - inter / (sizes + sizes[x] - inter))
        hits = todo[linked(inter, sizes[todo], sizes[x], least)]
        hits = hits[hits != x]
        if len(hits):
            for y in hits.tolist():
                forest.join(x, y)
            touched = np.isin(comp, np.append(comp[hits], comp[x]))
            comp[touched] = comp[touched].min()
    return forest


EDGE = "src long, dst long"


def _edges(sids, forest) -> list[tuple[int, int]]:
    return [(sids[i], sids[r]) for i in range(len(sids)) if (r := forest.root(i)) != i]


def _join_regions(sets: DataFrame, buckets: int, least: int) -> DataFrame:
    """Links within regions of at most ``REGION`` sets; many small regions share a task."""
    def work(table):
        out, by = [], {}
        for region, sid, raw, half in zip(*(table[c].to_pylist() for c in ("region", "sid", "hashes", "half"))):
            by.setdefault(region, {})[sid] = (np.frombuffer(raw, np.uint64), half)
        for members in by.values():
            sids = sorted(members)
            halves = [members[s][1] for s in sids]
            out += _edges(sids, join_region([members[s][0] for s in sids], None if halves[0] is None else np.array(halves), least))
        return pa.table([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], names=["src", "dst"])

    return (sets.withColumn("bucket", F.pmod(F.xxhash64("region"), F.lit(buckets)))
            .groupBy("bucket").applyInArrow(work, EDGE))


MEMBER = "parent long, region long, sid long, core boolean, src long, dst long"


def _deal(sets: DataFrame, least: int) -> DataFrame:
    """One distributed round for large regions: distances to a few pivots, links, and who is in which new region with its
    window. Sets are not copied: most new regions need no more work."""
    firsts = [F.min_by("sid", F.xxhash64("sid", F.lit(j))).alias(f"p{j}") for j in range(PIVOTS)]
    chosen = (sets.groupBy("region").agg(*firsts)
              .select("region", F.explode(F.array_distinct(F.array(*[f"p{j}" for j in range(PIVOTS)]))).alias("sid")))
    pivots = written(chosen.join(sets, ["region", "sid"]).dropDuplicates(["region", "sid"]).groupBy("region")
                     .agg(F.collect_list(F.struct("sid", "hashes")).alias("pivots")), "jaccard_pivots")

    def work(batches):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
        for batch in batches:
            out = []
            for region, sid, raw, near in zip(*(c.to_pylist() for c in batch.columns)):
                s, dist = np.frombuffer(raw, np.uint64), []
                for p in near:
                    q = np.frombuffer(p["hashes"], np.uint64)
                    inter = int(overlap(s, q, np.array([0]), np.array([len(q)]))[0])
                    if p["sid"] != sid and linked(inter, len(s), len(q), least):
                        out.append((region, None, None, None, sid, p["sid"]))
                    dist.append(1 - inter / (len(s) + len(q) - inter))
                for p, d in zip(near, dist):
                    if d <= min(dist) + 2 * (1 - least / 100) + 1e-9:
                        new = int(mix(np.array([region, p["sid"]], np.int64).view(np.uint64) * U(3))[:2].sum().astype(np.int64))
                        q = np.frombuffer(p["hashes"], np.uint64)
                        inter = round((len(s) + len(q)) * (1 - d) / (2 - d))
                        out.append((region, new, sid, bool(linked(inter, len(s), len(q), least)), None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)],
                                             names=["parent", "region", "sid", "core", "src", "dst"])

    return written(sets.select("region", "sid", "hashes").join(pivots, "region").mapInArrow(work, MEMBER), "jaccard_regions")


def _links(sets_of, members: DataFrame, sized: DataFrame, buckets: int, region_limit: int, least: int) -> DataFrame:
    """All links of the regions, up to connectivity: large regions are dealt anew until they are small.

    ``sets_of`` gives the shingle sets of some members; only those of large regions are written, the others go straight
    to the task of their region.
    """
    found, blank = [], F.lit(None).cast("int").alias("half")
    if sized.isEmpty():
        return _join_regions(sets_of(members).withColumn("half", blank), buckets, least)
    found.append(_join_regions(sets_of(members.join(sized, "region", "left_anti")).withColumn("half", blank), buckets, least))
    large = written(sets_of(members.join(sized.select("region"), "region")), "jaccard_sets")
    while True:
        dealt = _deal(large, least)
        found.append(dealt.filter("src is not null").select("src", "dst"))
        members = dealt.filter("src is null")
        # a region whose sets are all linked to its pivot is done; one that did not shrink is compared block by block
        state = written(members.groupBy("parent", "region").agg(F.count(F.lit(1)).alias("m"), F.min("core").alias("done"))
                        .join(sized.select(F.col("region").alias("parent"), F.col("m").alias("before")), "parent")
                        .filter("not done").withColumn("stuck", F.expr(f"m > {region_limit} and m > 0.7 * before"))
                        .select("region", "m", "stuck"), "jaccard_state")
        rest = members.select("parent", "region", "sid").join(state, "region").join(
            large.select(F.col("region").alias("parent"), "sid", "hashes"), ["parent", "sid"])
        block = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
        blocks = (rest.filter("stuck").withColumn("blocks", F.ceil(2 * F.col("m") / region_limit).cast("int"))
                  .withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                  .select(F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")).alias("region"), "sid", "hashes",
                          F.when(F.col("own") == F.col("other"), None).otherwise((F.col("own") < F.col("other")).cast("int")).alias("half")))
        found.append(_join_regions(written(blocks, "jaccard_blocks"), buckets, least))
        sets = written(rest.filter("not stuck").select("region", "sid", "hashes"), "jaccard_sets")
        sized = written(sets.groupBy("region").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > region_limit), "jaccard_large")
        found.append(_join_regions(sets.join(sized, "region", "left_anti").select("region", "sid", "hashes", blank), buckets, least))
        if sized.isEmpty():
            break
        large = written(sets.join(sized.select("region"), "region"), "jaccard_sets")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                 region_limit: int = REGION, least: int = LEAST) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row of ``df``; linked texts at Jaccard of ``least`` percent or more
    share the smallest doc_id reachable by links.

    A null or empty text, or one of blanks, has no shingles and links with nothing. A null id links with nothing and has a
    null component. Repeated rows are copies of one another: each gets the component of its set. An empty table gives no
    rows. Only the id and text columns are read.
    """
    if not 1 <= least <= 99:
        raise ValueError("least is a percentage from 1 to 99")
    spark = df.sparkSession
    buckets = 4 * shuffle_partitions(spark)
    scan = written(_scan(df, id_col, text_col, size, buckets, least), "jaccard_scan")
    docs = scan.filter("kind = 0").select("doc_id", "sid", "key2", "n")
    firsts = written(docs.filter("sid is not null").groupBy("sid").agg(
        F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"), F.min("key2").alias("a"), F.max("key2").alias("b")),
        "jaccard_sets_of_rows")
    if not firsts.filter("a <> b").isEmpty():
        raise RuntimeError("two different sets have the same 64-bit key; change the constants of set_keys")
    regions = connected_components(written(_near(scan, least), "jaccard_near")).select(F.col("id").alias("sid"), F.col("component").alias("region"))
    members = written(regions.join(firsts.select("sid", "first"), "sid")
                      .select(F.col("first").alias("doc_id"), "sid", "region"), "jaccard_members")

    def to_sets(rows):
        sets = shingle_sets([t or b"" for _, t, _, _ in rows], size)
        return [(region, sid, s.tobytes()) for (_, _, sid, region), s in zip(rows, sets) if len(s) and set_keys(s)[0] == sid]

    def sets_of(some):
        texts = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
        texts = flagged(texts, bitmap(some, ["doc_id"]), ["doc_id"], "_hit").filter("_hit").drop("_hit").join(some.hint("merge"), "doc_id")
        return map_texts(texts, ["doc_id", "text", "sid", "region"], "region long, sid long, hashes binary", to_sets)

    sized = members.groupBy("region").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > region_limit)
    links = _links(sets_of, members, written(sized, "jaccard_large"), buckets, region_limit, least)
    groups = connected_components(links).withColumnRenamed("id", "sid")
    smallest = groups.join(firsts, "sid").groupBy("component").agg(F.min("first").alias("component_id"))
    named = groups.join(smallest, "component").select("sid", "component_id")
    copies = firsts.filter("rows > 1").join(named, "sid", "left_anti").select("sid", F.col("first").alias("component_id"))
    answer = written(named.unionByName(copies), "jaccard_groups")
    return salted_join(docs, answer, "sid", "doc_id").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """``df`` without the documents whose group has a smaller id; rows with a null id stay."""
    drop = (jaccard_join(df, id_col, text_col, size, least=least).filter("doc_id <> component_id")
            .select(F.col("doc_id").cast(df.schema[id_col].dataType).alias(id_col)).distinct())
    drop = written(drop, "jaccard_drop")
    rows = flagged(df, bitmap(drop, [id_col]), [id_col], "_hit")
    kept = rows.filter("_hit").join(drop.hint("merge"), id_col, "left_anti").select(*df.columns)
    return rows.filter("not _hit").select(*df.columns).unionByName(kept)
