"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text scores every document's perplexity.

The model is over characters, order 4 (invented or rare words are common, characters are not). Every trusted document is
counted, and every one sets the thresholds: beside the model of all of them there is one of each half (by the hash of the id),
from the same counts, and a trusted document's held-out perplexity is that under the half it is not in.

Scoring is a sharded count join. Each block of documents sends its distinct n-grams, packed by shard. The distinct n-grams
of a shard are joined with the counts, continuation counts and context totals of the model (equi-joins on keys); the
shards answer the blocks with one log-probability per n-gram and model, in the order asked; the blocks, compressed, meet their
answers and sum up. Every character of every document is scored; what is shuffled follows the input.

A document is rejected when its perplexity exceeds the limit of its language: a high quantile of the held-out perplexities
of all trusted documents, with a margin. Short texts are shrunk towards the language's mean.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from mailwarden.llm.common import bitmap, flagged, map_texts, pieces, shuffle_partitions, written
from mailwarden.llm.words import mix

ORDER = 4
#: Characters by which a short text is shrunk; limit = margin * quantile.
SHRINK, QUANTILE, MARGIN = 200, 0.995, 1.3
#: Quantiles are sketched, to a rank within 1 / ACCURACY of the rows.
ACCURACY = 100_000
#: Held-out documents that a language needs for a limit of its own.
LEAST_ROWS = 30
BLOCK = 16 << 20
#: Characters a text begins and ends with.
BEGIN, END = 2, 3
U = np.uint64
SCORES = "doc_id long, lang string, n_chars long, log_prob double, held_out double, mismatch boolean"
#: The model of all texts, of those outside fold 0 and of those outside fold 1.
MODELS = ("", "_0", "_1")


def codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """16-bit characters of all texts, each between begin and end marks, and the place of each text's end mark."""
    out, ends, at = [], [], 0
    frame = np.array([BEGIN] * (ORDER - 1), np.uint16)
    for t in texts:
        c = np.frombuffer(t.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        c = np.where((c > 0xFFFF) | (c == BEGIN) | (c == END), 0xFFFF, c).astype(np.uint16)
        out += [frame, c, np.array([END], np.uint16)]
        at += len(c) + ORDER
        ends.append(at - 1)
    return np.concatenate(out), np.array(ends)


def grams(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct n-grams, which one ends at each scored place, the scored places)."""
    there = np.zeros(1 << 16, bool)
    there[c] = True
    letters, scored = np.flatnonzero(there).astype(np.uint16), c[ORDER - 1:] != BEGIN
    n, places = len(letters), np.flatnonzero(scored) + ORDER - 1
    if n <= 200:
        # dense tables: contexts that occur, then context and character; windows are slices, and arrays of 4 bytes a place
        small = (np.cumsum(there, dtype=np.int32) - 1)[c]
        context = small[:-3] * np.int32(n)
        context += small[1:-2]
        context *= np.int32(n)
        context += small[2:-1]
        context = context[scored]
        seen = np.zeros(n ** 3, bool)
        seen[context] = True
        rank = np.cumsum(seen, dtype=np.int32)
        rank -= 1
        full = rank[context]
        del context
        full *= np.int32(n)
        full += small[3:][scored]
        marks = np.zeros((int(rank[-1]) + 1) * n, bool)
        del rank, small
        marks[full] = True
        which = (np.cumsum(marks, dtype=np.int32) - 1)[full]
        found = np.flatnonzero(marks)
        owner, last = np.flatnonzero(seen)[found // n], found % n
        parts = (owner // (n * n), owner // n % n, owner % n, last)
    else:
        key = np.zeros(len(places), np.uint64)
        for k in range(ORDER):
            key = (key << U(16)) | c[places - (ORDER - 1 - k)].astype(np.uint64)
        distinct, which = np.unique(key, return_inverse=True)
        return distinct, which, places
    key = np.zeros(len(last), np.uint64)
    for p in parts:
        key = (key << U(16)) | letters[p].astype(np.uint64)
    return key, which, places


def _models(columns: list[str]) -> tuple[str, ...]:
    return tuple(m for m in MODELS if f"n{m}" in columns)


def _counts(df: DataFrame) -> DataFrame:
    """(key, n): n-gram counts of the texts; with a ``fold`` (0 or 1) also n_0 and n_1, those of the texts outside it."""
    folded = "fold" in df.columns

    def work(rows):
        c, ends = codes([t or b"" for _, t in rows])
        distinct, which, places = grams(c)
        n = np.bincount(which, minlength=len(distinct))
        out = [distinct.view(np.int64).tolist(), n.tolist()]
        if folded:
            fold = np.array([f for f, _ in rows])[np.searchsorted(ends, places)]
            n_0 = np.bincount(which[fold == 1], minlength=len(distinct))
            out += [n_0.tolist(), (n - n_0).tolist()]
        return list(zip(*out))

    names = ["n", "n_0", "n_1"] if folded else ["n"]
    columns = [F.col("fold").cast("long") if folded else F.lit(0).alias("id"), "text"]
    return (map_texts(df, columns, ", ".join(["key long", *(f"{x} long" for x in names)]), work)
            .groupBy("key").agg(*[F.sum(x).alias(x) for x in names]))


def model(texts: DataFrame) -> list[DataFrame]:
    """Per order, highest first: (key, own, context, gamma tables) of all ``texts``, with a ``fold`` also of those outside each."""
    counts, tables = written(_counts(texts), "kn_counts"), []
    models = _models(counts.columns)
    for order in range(ORDER, 0, -1):
        if order < ORDER:                     # continuation counts: distinct characters before the n-gram
            mask = (1 << 16 * order) - 1
            counts = written(counts.groupBy(F.col("key").bitwiseAND(F.lit(mask)).alias("key"))
                             .agg(*[F.count_if(F.col(f"n{m}") > 0).alias(f"n{m}") for m in models]), "kn_counts")
        f = counts.agg(*[F.sum((F.col(f"n{m}") == k).cast("long")).alias(f"c{m}_{k}") for m in models for k in (1, 2, 3, 4)]).first()
        taken = []
        for m in models:
            n = [f[f"c{m}_{k}"] or 0 for k in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
            d = [min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.1), k + 0.9) if n[k] else 0.5 for k in range(3)]
            at = F.col(f"n{m}")
            taken.append(F.when(at == 0, 0.0).when(at == 1, d[0]).when(at == 2, d[1]).otherwise(d[2]).alias(f"d{m}"))
        context = F.shiftrightunsigned("key", 16) if order > 1 else F.lit(0).cast("long")
        parts = counts.select("key", context.alias("context"), *[f"n{m}" for m in models], *taken)
        totals = parts.groupBy("context").agg(*[F.sum(f"n{m}").alias(f"total{m}") for m in models],
                                              *[F.sum(f"d{m}").alias(f"held{m}") for m in models])
        # a model without the n-gram or its context: no mass of its own, all of it from the shorter one
        own = parts.join(totals, "context").select("key", *[
            F.when(F.col(f"n{m}") > 0, (F.col(f"n{m}") - F.col(f"d{m}")) / F.col(f"total{m}")).otherwise(0.0).alias(f"own{m}") for m in models])
        gamma = totals.select("context", *[
            F.when(F.col(f"total{m}") > 0, F.col(f"held{m}") / F.col(f"total{m}")).otherwise(1.0).alias(f"gamma{m}") for m in models])
        tables.append((written(own, "kn_own"), written(gamma, "kn_gamma")))
    return tables


def _log_probs(distinct: DataFrame, tables: list) -> DataFrame:
    """``distinct`` (shard, key) with log_prob for every model: the interpolation of all orders by equi-joins."""
    models = [m for m in MODELS if f"own{m}" in tables[0][0].columns]
    out, values = distinct, {}
    for k, (own, gamma) in enumerate(tables):
        order = ORDER - k
        out = out.withColumn("_key", F.col("key") if order == ORDER else F.col("key").bitwiseAND(F.lit((1 << 16 * order) - 1)))
        out = out.withColumn("_context", F.shiftrightunsigned("_key", 16))
        out = out.join(own.select(F.col("key").alias("_key"), *[F.col(f"own{m}").alias(f"own{order}{m}") for m in models]), "_key", "left")
        if order > 1:
            out = out.join(gamma.select(F.col("context").alias("_context"), *[F.col(f"gamma{m}").alias(f"gamma{order}{m}") for m in models]),
                           "_context", "left")
        else:
            rest = gamma.first()
            letters = own.agg(*[F.count_if(F.col(f"own{m}") > 0).alias(f"own{m}") for m in models]).first()
            values = {m: F.coalesce(f"own1{m}", F.lit(0.0)) + F.lit((rest[f"gamma{m}"] if rest else 1.0) / (letters[f"own{m}"] + 1))
                      for m in models}
        out = out.drop("_key", "_context")
    for order in range(2, ORDER + 1):
        values = {m: F.coalesce(f"own{order}{m}", F.lit(0.0)) + F.coalesce(f"gamma{order}{m}", F.lit(1.0)) * v for m, v in values.items()}
    return out.select("shard", "key", *[F.log(v).alias(f"log_prob{m}") for m, v in values.items()])


def _blocks(batches):
    """(block number, rows) of at most ``BLOCK`` bytes, the same in every pass over the same partition."""
    from pyspark import TaskContext

    number, held, size = TaskContext.get().partitionId() << 32, [], 0
    for rows in pieces(batches):
        held.append(rows)
        size += sum(len(r[1] or b"") for r in rows)
        if size >= BLOCK:
            yield number, held
            number, held, size = number + 1, [], 0
    if held:
        yield number, held


def _asked(parts: list, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a block in shard order, and where each shard's begin."""
    key = np.unique(np.concatenate([grams(codes([r[1] or b"" for r in rows])[0])[0] for rows in parts]))
    shard = (mix(key) % U(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return key[order], np.searchsorted(shard[order], np.arange(shards + 1))


def _check(parts) -> int:
    return zlib.crc32(repr([(r[0], len(r[1] or b"")) for rows in parts for r in rows]).encode())


def _batch(rows, kinds, names):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def scores(docs: DataFrame, tables: list) -> DataFrame:
    """(doc_id, lang, n_chars, log_prob, held_out) of every row of ``docs`` (doc_id, text, lang), written. With a ``fold``
    (0 or 1) and models of the folds, ``held_out`` is the log-probability under the model without the row's fold.

    Blocks are formed twice from the same scan; a block that meets the answers to another one (a scan that was planned
    anew after executors were lost) is noticed by its checksum, and everything is scored again.
    """
    shards = 2 * shuffle_partitions(docs.sparkSession)
    folded = "fold" in docs.columns
    z_level, docs = 3, docs.select("doc_id", "text", "lang", F.col("fold").cast("int") if folded else F.lit(-1).alias("fold"))
    logs_of = [f"log_prob{m}" for m in MODELS] if folded else ["log_prob"]

    def ask(batches):
        z = zstandard.ZstdCompressor(level=z_level)
        for number, parts in _blocks(batches):
            key, cut = _asked(parts, shards)
            rows = [(s, number, _check(parts), z.compress(np.diff(key[cut[s]:cut[s + 1]], prepend=U(0)).tobytes()))
                    for s in range(shards) if cut[s] < cut[s + 1]]
            if rows:
                yield _batch(rows, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), ["shard", "block", "sum", "keys"])

    def unpack(raw):
        return np.cumsum(np.frombuffer(zstandard.decompress(raw), np.uint64), dtype=np.uint64)

    def distinct(table):
        key = np.unique(np.concatenate([unpack(x) for x in table["keys"].to_pylist()]))
        return pa.table({"shard": pa.array(np.full(len(key), table["shard"][0].as_py()), pa.int32()),
                         "key": pa.array(key.view(np.int64))})

    def answer(asked, known):
        if not asked.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "sum": pa.array([], pa.int64()),
                             "shard": pa.array([], pa.int32()), "logs": pa.array([], pa.binary())})
        key, log = known["key"].to_numpy().view(np.uint64), np.column_stack([known[c].to_numpy() for c in logs_of])
        order = np.argsort(key)
        key, log = key[order], log[order].astype(np.float32)
        logs = [log[np.searchsorted(key, unpack(x))].tobytes() for x in asked["keys"].to_pylist()]
        return pa.table({"block": asked["block"], "sum": asked["sum"], "shard": asked["shard"], "logs": pa.array(logs, pa.binary())})

    def shrink(batches):
        z = zstandard.ZstdCompressor(level=z_level)
        for number, parts in _blocks(batches):
            rows = [r for part in parts for r in part]
            yield _batch([(number, _check(parts), [r[0] for r in rows], [r[2] for r in rows], [r[3] for r in rows],
                           [len(r[1] or b"") for r in rows], z.compress(b"".join(r[1] or b"" for r in rows)),
                           [len(p) for p in parts])],
                         (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()),
                          pa.binary(), pa.list_(pa.int32())), ["block", "own_sum", "ids", "langs", "folds", "sizes", "payload", "groups"])

    def score(batches):
        for batch in batches:
            for _, own, ids, langs, folds, sizes, payload, groups, answers in zip(*(c.to_pylist() for c in batch.columns)):
                raw, at, texts = zstandard.decompress(payload), 0, []
                for n in sizes:
                    texts.append(raw[at:at + n])
                    at += n
                parts, at = [], 0
                for n in groups:
                    parts.append([(None, t) for t in texts[at:at + n]])
                    at += n
                key, cut = _asked(parts, shards)
                log, wrong = np.zeros((len(key), len(logs_of)), np.float32), answers is None or any(a["sum"] != own for a in answers)
                for a in [] if wrong else answers:
                    log[cut[a["shard"]]:cut[a["shard"] + 1]] = np.frombuffer(a["logs"], np.float32).reshape(-1, len(logs_of))
                order = np.argsort(key)
                key, log, at, out = key[order], log[order], 0, []
                for part in parts:
                    c, ends = codes([t for _, t in part])
                    found, which, places = grams(c)
                    known = log[np.searchsorted(key, found)]
                    stop = np.searchsorted(places, ends, side="right")
                    start = np.concatenate(([0], stop[:-1]))

                    def sums(each):
                        upto = np.concatenate(([0.0], np.cumsum(each, dtype=np.float64)))
                        return (upto[stop] - upto[start]).tolist()
                    whole = held = sums(known[which, 0])
                    if folded:
                        held = sums(known[which, 1 + np.repeat(np.array(folds[at:at + len(part)]), stop - start)])
                    for i, (n, a, b) in enumerate(zip((stop - start).tolist(), whole, held)):
                        out.append((ids[at + i], langs[at + i], n, a, b, wrong))
                    at += len(part)
                yield _batch(out, (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()),
                             ["doc_id", "lang", "n_chars", "log_prob", "held_out", "mismatch"])

    for _ in range(3):
        asked = written(docs.mapInArrow(ask, "shard int, block long, sum long, keys binary"), "kn_asked")
        known = written(_log_probs(written(asked.select("shard", "keys").groupBy("shard").applyInArrow(
            distinct, "shard int, key long"), "kn_distinct"), tables), "kn_known")
        replies = written(asked.groupBy("shard").cogroup(known.groupBy("shard"))
                          .applyInArrow(answer, "block long, sum long, shard int, logs binary")
                          .groupBy("block").agg(F.collect_list(F.struct("sum", "shard", "logs")).alias("answers")), "kn_answers")
        payload = docs.mapInArrow(shrink, "block long, own_sum long, ids array<long>, langs array<string>, folds array<int>, sizes array<long>, "
                                          "payload binary, groups array<int>")
        out = written(payload.join(replies.hint("merge"), "block", "left").mapInArrow(score, SCORES), "kn_scores")
        if out.filter("mismatch").isEmpty():
            return out.drop("mismatch")
    raise RuntimeError("the scan was planned differently in each pass three times")


def trusted(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, u): the trusted ids, each with a number from 0 to 1 by its hash."""
    good = (labels.groupBy(F.col(id_col).alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
            .filter("doc_id is not null and q = 1 and coalesce(t, 0) = 0"))
    return written(good.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / (1 << 40)).alias("u")), "kn_trusted")


def fit_shares(sizes: list[tuple[str | None, int]], rows: int) -> list[tuple[str | None, float]]:
    """(language, share of its trusted rows that is counted): an even deal of ``rows // 2``, at most half of each."""
    left, out = rows // 2, []
    for k, (lang, n) in enumerate(sorted(sizes, key=lambda x: x[1])):
        own = min(n / 2, left / (len(sizes) - k))
        left -= own
        out.append((lang, own / n))
    return out


def quality_classifier(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                       rows: int | None = None) -> DataFrame:
    """(doc_id, lang, n_chars, perplexity, limit, kept) of every row of ``df``.

    Every trusted row is counted; ``rows`` asks for a model of about ``rows // 2`` of them, dealt evenly over the languages.
    Limits come from all trusted rows in either case. A null or empty text is its end mark alone and is kept. A null language is a language of its own; one with too few
    held-out rows takes the limit over all languages. Without any trusted rows nothing is rejected. Null ids and repeated
    rows are scored like any other. Columns besides id, text and language are not read.
    """
    fold = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)), F.lit(0)).cast("int")
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"), df[lang_col].alias("lang")).withColumn("fold", fold)
    good = trusted(labels)
    if rows is None:
        # a bitmap keeps the other texts out of the join's shuffle
        likely = flagged(docs, bitmap(good, ["doc_id"]), ["doc_id"], "_likely").filter("_likely").drop("_likely")
        counted = likely.join(good, "doc_id", "left_semi")
    else:
        own = docs.select("doc_id", "lang").join(good, "doc_id")
        sizes = [(r["lang"], r["count"]) for r in own.groupBy("lang").count().collect()]            # one per language
        shares = F.broadcast(df.sparkSession.createDataFrame(fit_shares(sizes, rows), "_lang string, share double"))
        chosen = own.join(shares, own["lang"].eqNullSafe(shares["_lang"])).filter("u < share")
        sample = F.broadcast(written(chosen.select("doc_id", "_lang").distinct(), "kn_sample"))         # about ``rows / 2`` pairs
        counted = docs.join(sample, (docs["doc_id"] == sample["doc_id"]) & docs["lang"].eqNullSafe(sample["_lang"]))
    found = scores(docs, model(counted.select("fold", "text")))
    held = written(found.join(good, "doc_id").select("lang", F.col("held_out").alias("log_prob"), "n_chars"), "kn_held")
    per = written(held.groupBy("lang").agg(
        F.count(F.lit(1)).alias("rows"), (-F.sum("log_prob") / F.sum("n_chars")).alias("mean")), "kn_means")
    means = F.broadcast(per.withColumnRenamed("lang", "_lang"))                                     # one row per language
    each = held.join(means, held["lang"].eqNullSafe(means["_lang"]))
    shrunk = "(mean * {k} - log_prob) / ({k} + n_chars)".format(k=SHRINK)
    quantile = F.percentile_approx(F.expr(shrunk), F.lit(QUANTILE), F.lit(ACCURACY)).alias("q")
    pooled = each.agg(quantile, F.avg("mean").alias("mean")).first()
    limits = (each.filter(F.col("rows") >= LEAST_ROWS).groupBy(F.col("lang").alias("_lang"), F.col("mean").alias("_mean"))
              .agg(quantile.alias("_q")))
    mean = F.coalesce("_mean", F.lit(pooled["mean"]), F.lit(0.0))
    score = (mean * SHRINK - F.col("log_prob")) / (F.col("n_chars") + SHRINK)
    limit = F.exp(F.coalesce("_q", F.lit(pooled["q"]).cast("double"))) * MARGIN
    return (found.join(limits, found["lang"].eqNullSafe(limits["_lang"]), "left")
            .select("doc_id", "lang", "n_chars", F.exp(score).alias("perplexity"), limit.alias("limit"))
            .withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("limit"), F.lit(True))))


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``df`` without the rejected documents; rows with a null id stay."""
    bad = (quality_classifier(df, labels, id_col, text_col, lang_col).filter("not kept and doc_id is not null")
           .select(F.col("doc_id").alias("_drop_id")).distinct())
    return df.join(bad.hint("merge"), df[id_col] == bad["_drop_id"], "left_anti")
