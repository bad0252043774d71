import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailwarden.operators import components, dedup, leakage, neardup, splits


def test_hash_levels(mail):
    r = dedup.add_duplicate_hashes(mail(
        {"body": "Hello  World", "subject": "a"}, {"body": "hello world", "subject": "a"},
        {"body": "hello world", "subject": None}, {"body": None}, {"body": ""})).orderBy("sample_id").collect()
    assert r[0]["body_hash_norm"] == r[1]["body_hash_norm"] and r[0]["body_hash_raw"] != r[1]["body_hash_raw"]
    assert r[0]["subj_body_hash"] == r[1]["subj_body_hash"] != r[2]["subj_body_hash"]
    assert r[3]["body_hash_raw"] == r[4]["body_hash_raw"] and r[3]["subj_body_hash"] != r[4]["subj_body_hash"]


def test_all_members_flagged(mail):
    def flagged(*bodies):
        h = dedup.add_duplicate_hashes(mail(*[{"body": b} for b in bodies]))
        return dedup.mark_exact_duplicates(h, "body_hash_norm").filter("is_duplicate").count()
    assert flagged("hello", "hello", "world") == 2
    assert flagged("hello", "world", "foo") == 0


def _brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_components(spark):
    rnd = random.Random(3)
    edges = [(f"n{rnd.randint(0, 60):03d}", f"n{rnd.randint(0, 60):03d}") for _ in range(45)]
    edges += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)]                 # a long chain
    edges += [("hub", f"h{i:04d}") for i in range(500)]                          # a hub
    edges = [e for e in edges if e[0] != e[1]]
    got = components.connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()
    assert {r["id"]: r["component"] for r in got} == _brute_components(edges)
    assert len(got) == len({r["id"] for r in got})
    empty = components.connected_components(spark.createDataFrame([], "src string, dst string"))
    assert empty.count() == 0


def _corpus(seed=5):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 9))) for _ in range(300)]
    docs = []
    for _ in range(12):
        base = [rnd.choice(words) for _ in range(120)]
        docs.append(" ".join(base))
        for edits in (0, 1, 2, 4, 30):
            copy = list(base)
            for _ in range(edits):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            docs.append(" ".join(copy).upper() + " ")
    return docs + ["", None, "abc"]


def _sets(docs):
    out = {}
    for i, d in enumerate(docs):
        t = (d or "").lower().strip()
        out[f"s{i:03d}"] = {t[j:j + 5] for j in range(len(t) - 4)}
    return out


def test_near_duplicates_against_brute_force(mail):
    docs = _corpus()
    sets = _sets(docs)
    df = mail(*[{"body": d} for d in docs])
    clusters = neardup.near_duplicate_clusters(df, bands=(16, 8)).cache()
    cluster = {r[0]: r[1] for r in clusters.collect()}
    ids = [i for i in sets if sets[i]]
    close = [(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.85]
    assert close and all(cluster.get(a) == cluster.get(b) is not None for a, b in close)
    similarity = neardup.leader_similarity(df, clusters).collect()
    for r in similarity:
        a, b = sets[r["sample_id"]], sets[r["leader_id"]]
        assert abs(r["jaccard"] - len(a & b) / len(a | b)) < 1e-12
        assert r["is_verified"] == (r["jaccard"] >= 0.85)
    gone = {r["sample_id"] for r in similarity if r["is_verified"]}
    kept = {r[0] for r in neardup.purge_verified(df, neardup.leader_similarity(df, clusters)).select("sample_id").collect()}
    assert kept == set(sets) - gone
    assert not {r["leader_id"] for r in similarity} & gone


def test_one_hot_cluster_is_linear(spark):
    """A third of all rows share one text: the star has one edge per copy and band, not a pair per pair."""
    rows = [(f"k{i:05d}", "the very same body text over and over") for i in range(2000)]
    rows += [(f"u{i:05d}", f"unique text number {i * 7919} about {i * 104729} things") for i in range(4000)]
    df = spark.createDataFrame(rows, "sample_id string, body string").repartition(4)
    members = neardup.band_keys(neardup.signatures(df), 8, 16)
    edges = neardup.band_edges(members).filter("dst like 'k%'")
    assert edges.count() == 1999
    sizes = neardup.near_duplicate_clusters(df).filter("near_dup_cluster_id = 'k00000'").count()
    assert sizes == 2000


def test_unify_and_split(mail, spark):
    df = mail(*[{"body": str(i)} for i in range(60)])
    a = spark.createDataFrame([("s000", "x"), ("s001", "x"), ("s010", "y"), ("s011", "y")], "sample_id string, c1 string")
    b = spark.createDataFrame([("s001", "x"), ("s010", "x"), ("s020", None)], "sample_id string, c2 string")
    u = neardup.unify_clusters(df, (a, "c1"), (b, "c2"))
    ids = {r["sample_id"]: r["unified_cluster_id"] for r in u.collect()}
    assert {i for i, c in ids.items() if c == "s000"} == {"s000", "s001", "s010", "s011"}
    assert ids["s020"] == "s020" and len(ids) == 60
    assert dedup.keep_one(u, "unified_cluster_id").count() == 57
    split = dedup.add_duplicate_hashes(splits.group_split(u))
    assert all(r["n_overlap"] == 0 for r in leakage.split_leakage(split).collect())
    again = {r[0]: r[1] for r in splits.group_split(u.repartition(7)).select("sample_id", "split").collect()}
    assert again == {r["sample_id"]: r["split"] for r in split.collect()}


def test_stratified_quotas(mail):
    df = mail(*[{"label": int(i % 3 == 0)} for i in range(300)])
    got = {(r[0], r[1]): r[2] for r in splits.stratified_split(df).groupBy("label", "split").count().collect()}
    assert got[(1, "test")] == 15 and got[(0, "test")] == 30 and sum(got.values()) == 300


def test_loso_fold_without_leaks(spark):
    df = spark.createDataFrame([(f"s{i}", "abc"[i % 3], f"g{i // 2}") for i in range(30)],
                               "sample_id string, dataset_id string, g string")
    assigned = splits.loso_assign(df, group_col="g")
    plain, safe = splits.loso_fold(assigned, "a"), splits.loso_fold(assigned, "a", "g")
    assert plain.count() == 30
    held = {r["g"] for r in safe.filter("split = 'test'").collect()}
    assert not held & {r["g"] for r in safe.filter("split <> 'test'").collect()}
    summary = {r["fold"]: r for r in splits.loso_summary(assigned).collect()}
    assert summary["a"]["n_test"] == 10 and summary["a"]["n_train"] + summary["a"]["n_val"] == 20


def test_quotes(mail):
    r = leakage.mark_quoted(mail(
        {"body": "hi\n> old"}, {"body": "-----Original Message-----"}, {"body": "----- Forwarded by -----"},
        {"body": "On Mon, Jan 1, 2024 a wrote:"}, {"body": "plain > text"}, {"body": None},
        {"body": "Begin Forwarded Message:\n> x"})).orderBy("sample_id").collect()
    assert [list(x["quote_patterns"]) for x in r] == [[0], [1], [2], [3], [], [], [0, 5]]
    assert [x["has_quoted_content"] for x in r] == [True, True, False, False, False, False, True]
    assert [x["has_forwarded_content"] for x in r] == [False, False, True, True, False, False, True]


def test_shipped_bands_against_brute_force_on_documents(spark):
    """Near pairs share a cluster, and every dropped row is similar (or equal) to the row kept for it."""
    import collections

    from mailwarden.plans import catalog

    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").collect()
    sets = {}
    for r in rows:
        t = (r["text"] or "").lower().strip()
        sets[f"{r['source']}_{r['doc_id']}"] = {t[j:j + 5] for j in range(len(t) - 4)}
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = collections.Counter()
    for ids in holders.values():
        if len(ids) <= 40:                      # candidates only: a similar pair shares many rare shingles
            common.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1:])
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    pairs = [(a, b) for a, b in common if jaccard(a, b) >= 0.85]
    cluster = {r["sample_id"]: r["unified_cluster_id"] for r in catalog.QUERIES["unified_clusters"](spark, sf).collect()}
    together = sum(cluster[a] == cluster[b] for a, b in pairs)
    assert len(pairs) >= 100 and together >= 0.99 * len(pairs)
    kept = {r["sample_id"] for r in catalog.QUERIES["decontaminated"](spark, sf).collect()}
    dropped = [i for i in cluster if i not in kept]
    assert dropped and all(jaccard(i, cluster[i]) >= 0.85 for i in dropped)


@pytest.mark.parametrize("operator", ["buckets", "clusters", "hashes"])
def test_a_hot_key_is_split(spark, operator):
    """Two thirds of the rows on one key: the final plan of the join holds a skew split."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        key = F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.md5((F.col("id") % 7000).cast("string")))
        rows = spark.range(0, 60000, 1, 8).select(F.format_string("s%06d", "id").alias("sample_id"), key.alias("key"))
        if operator == "buckets":
            out = neardup.band_edges(rows.withColumn("band", F.lit(1)))
        elif operator == "clusters":
            out = neardup.cluster_edges(rows, "key")
        else:
            out = dedup.mark_exact_duplicates(rows, "key")
        assert out.count() == {"hashes": 60000}.get(operator, 60000 - 7001)
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_pairs_that_fail_against_the_leader_of_their_bucket_are_compared(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = []
    for f in range(40):
        body = text(400)                            # the smallest id is at about 0.8 to the rest, these at about 0.95 to each other
        rows += [(10 * f, body + text(100))] + [(10 * f + k, body + text(10)) for k in (1, 2, 3)]
    df = spark.createDataFrame(rows, "sample_id long, body string")
    keys = {x["sample_id"]: x["key"] for x in neardup.band_keys(neardup.signatures(df, 1), 1, 1).collect()}
    sets = {i: {t[j:j + 5] for j in range(len(t) - 4)} for i, t in rows}
    links = [(a, b) for a in keys for b in keys if a < b and keys[a] == keys[b] and len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])]
    assert sum(keys[a - a % 10] == keys[a] for a, _ in links) > 20
    got = {x["sample_id"]: x["near_dup_cluster_id"] for x in neardup.near_duplicate_clusters(df, bands=(1, 1)).collect()}
    assert set(got) == {x for pair in links for x in pair}
    assert all(got[a] == got[b] for a, b in links) and all(c // 10 == i // 10 for i, c in got.items())


def test_shingle_sets_are_read_in_small_parts(spark, monkeypatch):
    """A reader decodes up to 4,096 rows of a row group at once; sets of long texts must not meet in one."""
    import pyarrow.parquet as pq

    rng, tables, stored = random.Random(4), [], neardup.stored
    monkeypatch.setattr(neardup, "stored", lambda df, name, *a: tables.append((name, stored(df, name, *a))) or tables[-1][1])
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["".join(rng.choices(letters, k=4000)) for _ in range(400)]
    df = spark.createDataFrame([(f"{i:04}", t) for i, t in enumerate(texts + texts)], "sample_id string, body string").coalesce(1)
    links = neardup.near_duplicate_edges(df)
    assert links.count() == 400
    files = [f for name, t in tables if name == "shingle_sets" for f in t.inputFiles()]
    sizes = [g for f in files for m in [pq.ParquetFile(f.removeprefix("file://")).metadata]
             for g in (m.row_group(i).total_byte_size for i in range(m.num_row_groups))]
    assert sum(sizes) > 16 << 20 and max(sizes) < 8 << 20


def test_copies_without_shingles_are_compared(spark):
    """Exact copies of a text shorter than a shingle: no Jaccard, no division by zero; the copies go as exact duplicates."""
    df = spark.createDataFrame([("a", "", 0, "x"), ("b", "", 0, "x"), ("c", "hi", 0, "x"), ("d", None, 0, "x")],
                               "sample_id string, body string, label int, dataset_id string")
    unified = df.select("sample_id", F.when(F.col("sample_id") < "c", "a").alias("dedup_cluster_id"),
                        F.when(F.col("sample_id") < "c", "a").otherwise(F.col("sample_id")).alias("unified_cluster_id"))
    similarity = neardup.leader_similarity(df, unified, cluster="unified_cluster_id")
    assert [(r["sample_id"], r["jaccard"], r["is_verified"]) for r in similarity.collect()] == [("b", None, False)]
    kept = dedup.keep_unverified(unified, "unified_cluster_id", similarity)
    assert sorted(r["sample_id"] for r in kept.collect()) == ["a", "c", "d"]


def test_open_pairs_are_those_that_parity_bits_cannot_rule_out(spark, monkeypatch):
    """A family around one text whose members fail against the leader: every similar pair comes out, few others, whatever the
    blocks; copies of a member come with one row each."""
    rng = np.random.default_rng(3)
    core = rng.integers(-2 ** 62, 2 ** 62, 1500)
    rows, n_own = [], [150, 250, 330]           # own elements of a member; pairs are similar up to 123 on either side
    for i in range(60):
        own = rng.integers(-2 ** 62, 2 ** 62, n_own[i % 3] if i % 5 else 60)
        rows.append((f"m{i:03}", 1, np.concatenate([core, own])))
    rows += [(f"x{k}{i:03}", 1, rows[i][2]) for i in (1, 2, 5) for k in range(8)]
    rows = [("a", 1, rng.integers(-2 ** 62, 2 ** 62, 1600)), *rows]
    members = spark.createDataFrame([(i, 0, "k") for i, _, _ in rows], "sample_id string, band int, key string")
    sets = spark.createDataFrame([(i, len(h), h.tolist()) for i, _, h in rows], "sample_id string, n int, hashes array<bigint>")
    none = spark.createDataFrame([("m000", "m001")], "src string, dst string")          # m000 and m001 are one component already
    got = []
    for block in (neardup.PAIR_BLOCK, 20000):
        monkeypatch.setattr(neardup, "PAIR_BLOCK", block)
        got.append({tuple(sorted(r)) for r in neardup.open_pairs(members, none, sets, 0.85).collect()})
    assert got[0] == got[1]
    of = {i: set(h.tolist()) for i, _, h in rows}
    base = sorted(i for i in of if i[0] == "m")
    similar = {(a, b) for a in base for b in base if a < b and (a, b) != ("m000", "m001") and len(of[a] & of[b]) >= 0.85 * len(of[a] | of[b])}
    copies = {(f"m{i:03}", f"x{k}{i:03}") for i in (1, 2, 5) for k in range(8)}
    assert 0 < len(similar) and similar | copies <= got[0] and len(got[0] - similar - copies) < 100


def test_copies_of_open_texts_add_a_link_each(spark, monkeypatch):
    """Rows repeated under other ids: the pairs to check grow with the rows."""
    rng, seen, check = random.Random(11), [], neardup.pair_similarity
    text = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    core = text(500)
    bodies = [core + text(100) for _ in range(12)]
    monkeypatch.setattr(neardup, "pair_similarity", lambda sets, pairs, t: seen.append(pairs.count()) or check(sets, pairs, t))
    found = []
    for n in (2, 8):
        df = spark.createDataFrame([(f"{i:02}-{k}", b) for i, b in enumerate(bodies) for k in range(n)], "sample_id string, body string")
        clusters = neardup.near_duplicate_clusters(df, bands=(64, 1)).collect()
        found.append({(r[0][:2], r[1]) for r in clusters})
    assert found[0] == found[1] and len({r[1] for r in clusters}) == 12
    assert 0 < seen[3] <= 8 * seen[1]
