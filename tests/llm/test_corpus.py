"""Corpus operators against brute force: substring dedup, Jaccard join, embeddings, classifier, lattice, pipeline."""
import collections
import functools
import hashlib
import itertools
import random
import re
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailwarden.llm import embedding_dedup, jaccard_join, quality_classifier, sentencepiece_lattice, substring_dedup

WORD = "[^\x20\x09-\x0d]+"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["th", "er", "ing", "an", "ou", "É"]) for _ in range(rng.randint(1, 4)))
    base = [[word() for _ in range(rng.randint(60, 160))] for _ in range(12)]
    texts = [None, "", " \n ", "one two", "ONE two", "a b c", "x " * 300, "x " * 120]
    for _ in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            w = [word() for _ in range(40)] + w[:rng.randint(45, len(w))] + [word() for _ in range(40)]
        texts.append(rng.choice([" ", "\n", "  "]).join(w))
    rows = [(i, t, "en", "clash", 7) for i, t in enumerate(texts)]
    rows += [(None, rows[20][1], "en", "clash", 7), rows[21]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_removed string, sid int"), rows


def components(ids, links):
    up = {i: i for i in ids}
    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("parts", [1, 7])
def test_substring_dedup(docs, parts):
    df, rows = docs
    out = substring_dedup.substring_dedup(df.repartition(parts)).collect()
    windows = collections.defaultdict(lambda: 1 << 60)
    for key, text, *_ in rows:
        w = re.findall(WORD, text or "")
        for k in range(len(w) - 49) if key is not None else ():
            windows[tuple(w[k:k + 50])] = min(windows[tuple(w[k:k + 50])], key)
    expected = []
    for key, text, *_ in rows:
        w = re.findall(WORD, text or "")
        gone = {j for k in range(len(w) - 49) if key is not None and windows[tuple(w[k:k + 50])] < key for j in range(k, k + 50)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        expected.append((key, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out), key=str) == sorted(expected, key=str)
    assert sum(e[2] for e in expected) > 1000
    for r in out:
        assert r["lang"] == "en" and r["sid"] == 7
        assert hashlib.sha256(" ".join(re.findall(WORD, r["text"] or "")).encode()).hexdigest() == r["kept_sha256"]


@pytest.mark.parametrize("limit", [4096, 3])
def test_jaccard_join(docs, limit):
    df, rows = docs
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for key, text, *_ in rows:
        w = re.findall(WORD, (text or "").translate(low))
        sets.append((key, {tuple(w[k:k + 3]) for k in range(max(len(w) - 2, min(1, len(w))))}))
    links = [(a, b) for (a, s), (b, t) in itertools.combinations(sets, 2)
             if a is not None and b is not None and s and 100 * len(s & t) >= 90 * len(s | t)]
    group = components([k for k, _ in sets if k is not None], links)
    got = sorted(map(tuple, jaccard_join.jaccard_join(df, region_limit=limit).collect()), key=str)
    assert got == sorted(((k, len(s), group.get(k)) for k, s in sets), key=str)
    assert len(links) > 100


def pivots_of(sets, least):
    """The pivots of every set, chosen as the join chooses them."""
    own, cells = jaccard_join.shared_cells(*jaccard_join.shingle_keys(sets, least))
    out = [set() for _ in sets]
    for i, cell in zip(*jaccard_join.choose_pivots(own, cells, np.array([len(s) for s in sets]), least)):
        out[i].add(int(cell))
    return out


@pytest.mark.parametrize("least", [50, 70, 80, 90, 95])
def test_linked_sets_share_a_pivot(least):
    rng = np.random.default_rng(least)
    common = rng.integers(1, 1 << 62, 40, dtype=np.uint64)                # shingles of many sets
    sets = []
    for n in (4, 5, 9, 10, 11, 19, 20, 37, 90, 300):
        for _ in range(30):
            s = np.unique(np.concatenate([rng.choice(common, min(n // 3, 30), replace=False), rng.integers(1, 1 << 62, n - n // 3, dtype=np.uint64)]))
            most = 2 * n * (100 - least) // (100 + least)
            cut = rng.integers(0, most + 1)
            fresh = rng.integers(1, 1 << 62, most - cut, dtype=np.uint64)
            sets += [s, np.unique(np.concatenate([rng.permutation(s)[cut:], fresh]))]
    pivots, n_linked = pivots_of(sets, least), 0
    for (i, s), (j, t) in itertools.combinations(enumerate(sets), 2):
        inter = len(np.intersect1d(s, t))
        if jaccard_join.linked(inter, len(s), len(t), least) and not len(s) == inter == len(t):
            n_linked += 1
            assert pivots[i] & pivots[j]
    assert n_linked > 50
    assert sum(not p for p in pivots) > 0 or least < 80                   # sets with enough shingles of their own have none


def test_nine_shingles_share_a_pivot_with_ten():
    rng = np.random.default_rng(5)
    for _ in range(200):
        t = np.unique(rng.integers(1, 1 << 62, 10, dtype=np.uint64))
        a, b = pivots_of([np.delete(t, rng.integers(0, 10)), t], 90)
        assert a & b


def test_packed_keys():
    keys = np.array([0, 1, (1 << jaccard_join.BITS) - 1, 123456789012], np.uint64)
    assert (jaccard_join._unpacked(jaccard_join._packed(keys)) == keys).all() and len(jaccard_join._packed(keys)) == 24


def test_jaccard_join_of_small_sets(spark):
    words = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join(words[:11])), (2, " ".join(words)), (3, " ".join(words[1:])), (4, " ".join(words[:10])), (5, "a b c d")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (9, 1), 2: (10, 1), 3: (9, 1), 4: (8, 4), 5: (2, 5)}


@pytest.mark.parametrize("limit", [4096, 3])
def test_jaccard_join_of_five_words_at_80(docs, limit):
    df, rows = docs
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for key, text, *_ in rows:
        w = re.findall(WORD, (text or "").translate(low))
        sets.append((key, {tuple(w[k:k + 5]) for k in range(max(len(w) - 4, min(1, len(w))))}))
    links = [(a, b) for (a, s), (b, t) in itertools.combinations(sets, 2)
             if a is not None and b is not None and s and 100 * len(s & t) >= 80 * len(s | t)]
    group = components([k for k, _ in sets if k is not None], links)
    got = sorted(map(tuple, jaccard_join.jaccard_join(df, size=5, region_limit=limit, least=80).collect()), key=str)
    assert got == sorted(((k, len(s), group.get(k)) for k, s in sets), key=str)


def test_near_duplicate_stage_takes_five_words_at_80(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(50)]
    other = [*words[:25], "other", *words[26:]]                     # 41 of 51 five-word shingles, 45 of 51 of three words
    far = [*words[:15], "one", *words[16:30], "two", *words[31:]]   # 36 of 56 five-word shingles
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(far))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.one_of_each(spark, df, "").collect()) == [1, 3]


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 16))
    v = np.concatenate([v, v[:80] + 0.05 * rng.normal(size=(80, 16)), np.repeat(v[:1], 40, 0) + 0.02 * rng.normal(size=(40, 16)), v[5:8]])
    rows = [(i, [float(x) for x in a], "clash") for i, a in enumerate(v.astype(np.float32).tolist())]
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] * 16]
    rows += [(1000 + k, x, "clash") for k, x in enumerate(odd)] + [(2000, [1.0, 0.0], "c"), (2001, [2.0, 0.0], "c"), (None, rows[0][1], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, key string")
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding_dedup.embedding_dedup(df, shards=3).collect()}
    u = v.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    group = components(range(len(u)), zip(*map(list, np.nonzero(near))))
    for i in range(len(u)):
        assert got[i] == (int(near[i].sum()), group[i], group[i] == i)
    assert all(got[1000 + k] == (0, 1000 + k, True) for k in range(len(odd)))
    assert got[2000] == (1, 2000, True) and got[2001] == (1, 2000, False) and got[None] == (0, None, True)
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_a_large_group_of_near_copies(spark):
    """A third of all vectors are near one another, all different."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=24)
    v = np.concatenate([base + 0.15 * rng.normal(size=(1000, 24)), rng.normal(size=(2000, 24))]).astype(np.float32)
    v = v[rng.permutation(len(v))]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_dedup(df, shards=3).collect()}
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    group = components(range(len(u)), zip(*map(list, np.nonzero(near))))
    links = np.array([got[i]["n_links"] for i in range(len(u))])
    assert near.sum() > 100_000 and (links <= near.sum(1)).all() and links.sum() >= 0.97 * near.sum()
    missed = sum(got[i]["component_id"] != group[i] for i in range(len(u)))
    assert missed <= 0.01 * len(u)


@pytest.mark.parametrize("size", [70, 4096])
def test_shards_meet_in_slices(monkeypatch, size):
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.normal(size=12) + 0.1 * rng.normal(size=(150, 12)), rng.normal(size=(250, 12))]).astype(np.float32)
    ids, copies = rng.permutation(400).astype(np.int64) * 100, rng.integers(1, 4, 400)
    monkeypatch.setattr(embedding_dedup, "SLICE", size)

    def shard(at):
        layers = [{"nodes": n.astype(np.int64).tobytes(), "links": x.tobytes()}
                  for n, x in embedding_dedup.build(v[at] / np.linalg.norm(v[at], axis=1)[:, None])]
        return embedding_dedup.Shard({"ids": ids[at].tobytes(), "copies": copies[at].tobytes(), "vectors": v[at].tobytes(), "layers": layers})
    left, right = np.arange(0, 400, 2), np.arange(1, 400, 2)
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1)[:, None]
    near = u @ u.T >= 0.95
    for a, b in ((left, right), (left, left)):
        pairs = [(x, y) for x in a for y in b if x != y and near[x, y]]
        links, group = collections.Counter(), components(ids.tolist(), [(ids[x], ids[y]) for x, y in pairs])
        for x, y in pairs:
            links[ids[x]] += copies[y]
            if a is not b:
                links[ids[y]] += copies[x]
        got = embedding_dedup.linked(shard(a), shard(b), a is b, 0.95, 400)
        assert {i: (n, r) for i, n, r in zip(*map(np.ndarray.tolist, got))} == {i: (n, group[i]) for i, n in links.items()}


def test_graph_by_insertion_is_navigable():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(3000, 16)).astype(np.float32)
    v[1500:] = v[:1500] + 0.1 * rng.normal(size=(1500, 16)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1)[:, None]
    layers = embedding_dedup.build(v)
    assert layers[0][1].shape[1] <= embedding_dedup.WIDTH and len(layers[-1][0]) <= 48
    found, _ = embedding_dedup.search(v, layers, v[:500], 24)
    best = np.argsort(-(v[:500] @ v.T), axis=1)[:, :5]
    assert np.mean([len(set(f) & set(b)) / 5 for f, b in zip(found.tolist(), best.tolist())]) > 0.9
    for n in (1, 2, 49, 300):
        assert embedding_dedup.search(v[:n], embedding_dedup.build(v[:n]), v[:n], min(8, n))[0][:, 0].tolist() == list(range(n))


def test_links_found_from_one_side_within_a_shard(monkeypatch):
    rng = np.random.default_rng(3)
    raw = (rng.normal(size=8) + 0.01 * rng.normal(size=(6, 8))).astype(np.float32)
    norm = np.linalg.norm(raw.astype(np.float64), axis=1)
    shard = lambda ids: types.SimpleNamespace(ids=np.array(ids), raw=raw, norm=norm, unit=(raw / norm[:, None]).astype(np.float32), layers=None)
    beams = []

    def found(v, layers, q, least, beam):
        beams.append(beam)
        if beam >= len(v):
            return tuple(x.ravel() for x in np.indices((6, 6)))
        return np.array([0, 0, 1, 2, 3, 4, 5, 3]), np.array([0, 4, 1, 2, 3, 4, 5, 0])   # 0 finds 4, 3 finds 0, and all themselves

    monkeypatch.setattr(embedding_dedup, "range_search", found)
    some = shard([1, 2, 3, 4, 5, 6])                                # none is audited
    assert sorted(zip(*map(np.ndarray.tolist, embedding_dedup.join_shards(some, some, True, 0.95, 2)))) == [(3, 0), (4, 0)]
    assert beams == [2]
    every = shard([100, 200, 300, 400, 500, 600])                   # 2 of 15 links are no 98 %, whatever they find of themselves
    assert len(embedding_dedup.join_shards(every, every, True, 0.95, 2)[0]) == 15
    assert beams == [2, 2, 4, 6]


def test_kneser_ney_is_a_distribution_and_matches_brute_force(spark):
    texts = ["the thing then", "that other thing", "an error", "then"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    tables = quality_classifier.model(df.select("text"))
    counts = collections.Counter()
    for t in texts:
        s = "\x02\x02\x02" + t + "\x03"
        counts.update(s[i - 3:i + 1] for i in range(3, len(s)))
    levels = [counts]
    for _ in range(3):
        levels.append(collections.Counter(g[1:] for g in levels[-1]))
    def prob(gram, level=0):
        c = levels[level]
        n = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
        d = [min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.1), k + 0.9) if n[k] else 0.5 for k in range(3)]
        lower = prob(gram[1:], level + 1) if level < 3 else 1 / (len(c) + 1)
        own = {g: v for g, v in c.items() if g[:-1] == gram[:-1]}
        if not own:
            return lower
        cut = lambda v: d[min(v, 3) - 1]
        total = sum(own.values())
        return (max(own.get(gram, 0) - cut(own[gram]), 0) if gram in own else 0) / total + sum(map(cut, own.values())) / total * lower
    test = ["then the", "xyz", "", None]
    got = {r["doc_id"]: r["log_prob"] for r in quality_classifier.scores(
        spark.createDataFrame([(i, t, None) for i, t in enumerate(test)], "doc_id long, text string, lang string"), tables).collect()}
    for i, t in enumerate(test):
        s = "\x02\x02\x02" + (t or "") + "\x03"
        assert got[i] == pytest.approx(sum(np.log(prob(s[k - 3:k + 1])) for k in range(3, len(s))), rel=1e-4)


def test_classifier_on_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality_classifier.quality_classifier(docs, labels).join(labels, "doc_id")
    rates = {r["quality"]: r["k"] for r in out.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert rates[1] > 0.99 and rates[0] < 0.5
    none = quality_classifier.quality_classifier(docs.limit(20), labels.limit(0))
    assert none.filter("kept").count() == 20


def test_a_rare_language_sets_its_own_limit(spark):
    rng = random.Random(8)
    word = {"en": lambda: rng.choice(["the", "thing", "then", "other", "an", "error"]),
            "xx": lambda: "".join(rng.choice("αβγδεζηθικλμ") for _ in range(5)), None: lambda: "".join(rng.choice("qwz") for _ in range(5))}
    langs = ["en"] * 2000 + ["xx"] * 80 + [None] * 80
    df = spark.createDataFrame([(i, " ".join(word[x]() for _ in range(40)), x) for i, x in enumerate(langs)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(langs))], "doc_id long, quality int, toxic int")
    out = collections.defaultdict(list)
    for r in quality_classifier.quality_classifier(df, labels, rows=200).collect():
        out[r["lang"]].append((r["limit"], r["kept"]))
    assert sum(map(len, out.values())) == len(langs) and len({v[0][0] for v in out.values()}) == 3
    assert all(sum(kept for _, kept in v) >= 0.97 * len(v) for v in out.values())


def test_fit_shares():
    shares = dict(quality_classifier.fit_shares([("en", 10_000), ("xx", 40), (None, 300)], 1000))
    assert shares["xx"] == shares[None] == 0.5 and shares["en"] * 10_000 == pytest.approx(330)
    assert quality_classifier.fit_shares([], 1000) == []


def test_sentencepiece(spark):
    import public_tokenizers
    import sentencepiece

    texts = [None, "", " ", "Hello  world", " a\tb\n\nc", "é 你好😀 ｆ", "the " * 50, "thtioning" * 30, "x" * 100, "the thing"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "k int, text string, words string")
    out = sentencepiece_lattice.decode(sentencepiece_lattice.encode(df)).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in out:
        t = texts[r["k"]]
        assert r["decoded"] == t and r["words"] == "clash"
        assert r["ids"] == (None if t is None else model.encode(t))


def test_viterbi(spark):
    pieces = {"▁": -3.0, "▁a": -2.0, "a": -2.5, "b": -2.5, "ab": -3.5, "ba": -1.5, "aba": -6.0, "▁ab": -4.9}
    table = spark.createDataFrame([(p, i, s, False) for i, (p, s) in enumerate(pieces.items())], "piece string, id int, score double, byte boolean")
    words = ["▁abab", "▁a", "▁bbaab", "▁abaaba"]
    got = {r["word"]: r["ids"] for r in sentencepiece_lattice.encode_words(
        spark.createDataFrame([(w,) for w in words], "word string"), table, "unigram").collect()}
    names = list(pieces)
    for w in words:
        best = []
        def walk(at, path):
            if at == len(w):
                best.append((sum(pieces[p] for p in path), path))
            for e in range(at + 1, len(w) + 1):
                if w[at:e] in pieces:
                    walk(e, [*path, w[at:e]])
        walk(0, [])
        top = max(s for s, _ in best)
        assert sum(pieces[names[i]] for i in got[w]) == pytest.approx(top) and "".join(names[i] for i in got[w]) == w


def test_pipeline(spark):
    import corpus_pipeline

    docs, sf = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "/root/testdata/sf0.01"
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        path = f"{corpus_pipeline.written(after, 'stage').inputFiles()[0].rsplit('/', 1)[0]}"
        after = spark.read.parquet(path)
        assert 0 < after.count() <= docs.count()
        docs = after
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.select("doc_id").distinct().count() == docs.count()


@pytest.mark.parametrize("run", [substring_dedup.substring_dedup, jaccard_join.jaccard_join, sentencepiece_lattice.encode])
def test_empty(spark, run):
    assert run(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_trusted_document_is_counted_and_sets_the_limits(spark, monkeypatch):
    """No sample: the model counts all trusted texts; a held-out score is that of the other half's model."""
    texts = [f"{w} and {w} {i % 7}" for i in range(60) for w in ("alpha", "beta")]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    counted, scored, model, scores = [], [], quality_classifier.model, quality_classifier.scores
    monkeypatch.setattr(quality_classifier, "model", lambda t: counted.append(t) or model(t))
    monkeypatch.setattr(quality_classifier, "scores", lambda d, t: scored.append(scores(d, t)) or scored[-1])
    assert quality_classifier.quality_classifier(df, labels).count() == len(texts)
    assert sorted(r["text"] for r in counted[0].collect()) == sorted(t for i, t in enumerate(texts) if i % 3)
    folds = {f: counted[0].filter(f"fold = {f}").select("text") for f in (0, 1)}
    one = {f: {r["doc_id"]: r["log_prob"] for r in scores(df, model(folds[1 - f])).collect()} for f in folds}
    whole = {r["doc_id"]: r["log_prob"] for r in scores(df, model(counted[0].select("text"))).collect()}
    fold = {r["doc_id"]: r["fold"] for r in df.select("doc_id", F.expr("pmod(xxhash64(doc_id), 2)").alias("fold")).collect()}
    for r in scored[0].collect():
        assert r["log_prob"] == pytest.approx(whole[r["doc_id"]], rel=1e-5)
        assert r["held_out"] == pytest.approx(one[fold[r["doc_id"]]][r["doc_id"]], rel=1e-5)


def test_jaccard_groups_are_bounded(docs, monkeypatch):
    """A scan task hands on its sets in groups of bounded size, and each is chosen pivots for by itself."""
    df, _ = docs
    df = df.coalesce(1)
    whole = sorted(map(tuple, jaccard_join.jaccard_join(df).collect()), key=str)
    monkeypatch.setattr(jaccard_join, "HELD", 1000)
    monkeypatch.setattr(jaccard_join, "pieces", functools.partial(jaccard_join.pieces, limit=2000))
    scan = jaccard_join._scan(df, "doc_id", "text", 3, 4, 90).filter("kind = 2").select("part", F.length("keys").alias("n")).collect()
    assert len({r["part"] for r in scan}) == len(scan) > 1
    assert sorted(map(tuple, jaccard_join.jaccard_join(df).collect()), key=str) == whole
