"""Queries over duplicates, splits, leakage and vectorization."""
from __future__ import annotations

from pyspark.sql import functions as F

from mailwarden.constants import QUOTE_PATTERNS
from mailwarden.functions.text import let
from mailwarden.operators import dedup, grams, leakage, neardup, splits, vectorize
from mailwarden.plans.registry import collapse, ctes, lit, nfkd, query, rnd, rounded, side, unit
from mailwarden.session import cut_lineage, scratch_path
from mailwarden.sources import files, tables as A


# --- exact duplicates -------------------------------------------------------------------------
def _norm(c: str) -> str:
    return collapse(f"lower({nfkd(c)})")


_HASHED = f"""SELECT *, sha256(coalesce(body, '')) AS body_hash_raw, sha256({_norm("coalesce(body, '')")}) AS body_hash_norm,
  sha256(CASE WHEN subject IS NULL THEN '<na>' ELSE {_norm('subject')} END || ' ||| ' ||
         CASE WHEN body IS NULL THEN '<na>' ELSE {_norm('body')} END) AS subj_body_hash FROM mail_docs"""
_GROUPS = "SELECT {h} AS h, min(sample_id) AS leader, count(*) AS n FROM hashed GROUP BY 1 HAVING count(*) > 1"
_EXACT = dict(hashed=_HASHED, g=_GROUPS.format(h="subj_body_hash"),
              exact="SELECT hashed.*, leader AS dedup_cluster_id FROM hashed LEFT JOIN g ON subj_body_hash = h")


def _hashed(spark, sf):
    return dedup.add_duplicate_hashes(A.mail_docs(spark, sf))


def _exact(spark, sf):
    """Ids, labels, hash and exact cluster of every row, without the texts; written once."""
    marked = dedup.mark_exact_duplicates(_hashed(spark, sf), "subj_body_hash")
    return cut_lineage(marked.select("sample_id", "dataset_id", "label", "subj_body_hash", "dedup_cluster_id"))


@query("dup_hashes", ctes("mail_docs", hashed=_HASHED)
       + "SELECT sample_id, body_hash_raw, body_hash_norm, subj_body_hash FROM hashed")
def dup_hashes(spark, sf):
    return _hashed(spark, sf).select("sample_id", *dedup.HASH_LEVELS)


@query("exact_clusters", ctes("mail_docs", **_EXACT)
       + "SELECT sample_id, dedup_cluster_id, dedup_cluster_id IS NOT NULL AS is_duplicate FROM exact")
def exact_clusters(spark, sf):
    return dedup.mark_exact_duplicates(_hashed(spark, sf), "subj_body_hash").select(
        "sample_id", "dedup_cluster_id", "is_duplicate")


@query("exact_clusters_numbered", ctes("mail_docs", hashed=_HASHED, g=_GROUPS.format(h="body_hash_norm")) + """
SELECT sample_id, k AS dedup_cluster_id, k IS NOT NULL AS is_duplicate FROM hashed
LEFT JOIN (SELECT h, row_number() OVER (ORDER BY h) - 1 AS k FROM g) ON body_hash_norm = h""")
def exact_clusters_numbered(spark, sf):
    return dedup.mark_exact_duplicates(_hashed(spark, sf), "body_hash_norm", dense=True).select(
        "sample_id", "dedup_cluster_id", "is_duplicate")


_CROSS = """SELECT body_hash_norm, count(DISTINCT dataset_id) AS n_sources, count(*)::BIGINT AS total_count,
  array_to_string(list_sort(list_distinct(list(dataset_id))), ', ') AS sources
FROM hashed GROUP BY 1 HAVING count(DISTINCT dataset_id) > 1"""


@query("cross_source_dups", ctes("mail_docs", hashed=_HASHED) + _CROSS)
def cross_source_dups(spark, sf):
    return dedup.cross_source_duplicates(_hashed(spark, sf))


@query("cross_source_top", ctes("mail_docs", hashed=_HASHED) + _CROSS + " ORDER BY total_count DESC, body_hash_norm LIMIT 20")
def cross_source_top(spark, sf):
    return dedup.top_cross_source(_hashed(spark, sf))


@query("dup_report", ctes("mail_docs", hashed=_HASHED) + "\nUNION ALL\n".join(f"""
SELECT '{h}' AS level, sum(n)::BIGINT AS total_rows, count(*) AS unique_hashes, count(*) FILTER (n > 1) AS duplicate_groups,
  coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicate_rows,
  {rnd('coalesce(sum(n) FILTER (n > 1), 0) / sum(n) * 100', 2)} AS duplicate_pct
FROM (SELECT {h}, count(*) AS n FROM hashed GROUP BY 1)""" for h in dedup.HASH_LEVELS))
def dup_report(spark, sf):
    return dedup.duplicate_report(_hashed(spark, sf))


@query("dedup_stats", ctes("mail_docs", **_EXACT) + """
SELECT 'total_rows' AS stat, 'all' AS key, count(*) AS value FROM exact
UNION ALL SELECT 'clusters', 'all', count(DISTINCT dedup_cluster_id) FROM exact
UNION ALL SELECT 'rows_in_clusters', 'all', count(dedup_cluster_id) FROM exact
UNION ALL SELECT 'rows_per_source', dataset_id, count(*) FROM exact GROUP BY 2
UNION ALL SELECT 'rows_per_label', coalesce(label::VARCHAR, 'missing'), count(*) FROM exact GROUP BY 2""")
def dedup_stats(spark, sf):
    return dedup.dedup_stats(_exact(spark, sf))


# --- near duplicates ---------------------------------------------------------------------------------
_TEXT = r"regexp_replace(regexp_replace(lower(body), '^\s+', ''), '\s+$', '')"
_SHINGLES = f"""SELECT sample_id, unnest([c[i] || c[i + 1] || c[i + 2] || c[i + 3] || c[i + 4] FOR i IN range(1, len(c) - 3)]) AS s
  FROM (SELECT sample_id, string_split({_TEXT}, '') AS c FROM mail_docs)"""
_BANDS, _ROWS = neardup.BANDS[0.85]
_PERMS = [neardup.permutation(i) for i in range(_BANDS * _ROWS)]
_SIG = ("SELECT sample_id, " + ", ".join(f"min((h * {a} + {c}) % 2147483647) AS m{i}" for i, (a, c) in enumerate(_PERMS))
        + " FROM (SELECT sample_id, CAST(('0x' || substr(md5(s), 1, 8)) AS BIGINT) AS h FROM sh) GROUP BY 1")
_BUCKETS = " UNION ALL ".join(
    f"SELECT sample_id, {b} AS band, md5(concat_ws(',', {', '.join(f'm{b * _ROWS + r}' for r in range(_ROWS))})) AS key FROM sig"
    for b in range(_BANDS))
_NEAR = dict(
    sh=_SHINGLES, sig=_SIG, buckets=_BUCKETS,
    sets="SELECT sample_id, list(DISTINCT s) AS ss FROM sh GROUP BY 1",
    shared="""SELECT DISTINCT sample_id AS a, leader AS b FROM (
        SELECT sample_id, min(sample_id) OVER (PARTITION BY band, key) AS leader FROM buckets) WHERE sample_id <> leader""",
    star="""SELECT a, b FROM (SELECT a, b, len(list_intersect(x.ss, y.ss)) AS c, len(x.ss) AS n, len(y.ss) AS m
        FROM shared JOIN sets x ON a = x.sample_id JOIN sets y ON b = y.sample_id) WHERE c / (n + m - c) >= 0.85""",
    links="SELECT a, b FROM star UNION SELECT b, a FROM star",
    reach="SELECT DISTINCT a AS id, a AS comp FROM links UNION SELECT l.b, r.comp FROM reach r JOIN links l ON r.id = l.a",
    near="SELECT id AS sample_id, min(comp) AS near_dup_cluster_id FROM reach GROUP BY id")


def _near(spark, sf, hash_name="md5"):
    return neardup.near_duplicate_clusters(A.mail_docs(spark, sf), hash_name=hash_name)


@query("shingles", ctes("mail_docs", sh=_SHINGLES)
       + "SELECT sample_id, count(*) AS n_shingles, count(DISTINCT s) AS n_distinct FROM sh GROUP BY 1")
def shingles(spark, sf):
    # the shingles are computed once, for both counts; a filter on them would be pushed down and compute them again
    counts = let(neardup.shingles(F.col("body")), lambda s: F.struct(
        F.size(s).alias("n_shingles"), F.size(F.array_distinct(s)).alias("n_distinct")))
    long_enough = F.length(neardup.shingle_text(F.col("body"))) >= 5
    return A.mail_docs(spark, sf).filter(long_enough).select("sample_id", counts.alias("c")).select("sample_id", "c.n_shingles", "c.n_distinct")


@query("minhash_bands", ctes("mail_docs", sh=_SHINGLES, sig=_SIG, buckets=_BUCKETS) + "SELECT * FROM buckets")
def minhash_bands(spark, sf):
    sig = neardup.signatures(A.mail_docs(spark, sf), _BANDS * _ROWS, hash_name="md5")
    return neardup.band_keys(sig, _BANDS, _ROWS)


@query("near_dup_clusters", ctes("mail_docs", recursive=True, **_NEAR) + "SELECT * FROM near")
def near_dup_clusters(spark, sf):
    return _near(spark, sf)


@query("near_dup_clusters_fast")
def near_dup_clusters_fast(spark, sf):
    """The default shingle hash (xxhash64), which other engines do not share."""
    return _near(spark, sf, "xxhash64")


_SIMILAR = dict(
    sims="""SELECT *, n_common / (n_own + n_leader - n_common) AS jaccard FROM (
      SELECT n.sample_id, near_dup_cluster_id AS leader_id, len(x.ss) AS n_own, len(y.ss) AS n_leader,
             len(list_intersect(x.ss, y.ss)) AS n_common
      FROM near n JOIN sets x ON n.sample_id = x.sample_id JOIN sets y ON near_dup_cluster_id = y.sample_id
      WHERE n.sample_id <> near_dup_cluster_id)""")


@query("near_dup_similarity", ctes("mail_docs", recursive=True, **_NEAR, **_SIMILAR) + f"""
SELECT * REPLACE ({rnd('jaccard')} AS jaccard), jaccard >= 0.85 AS is_verified FROM sims""")
def near_dup_similarity(spark, sf):
    docs = A.mail_docs(spark, sf)
    clusters = neardup.near_duplicate_clusters(docs, hash_name="md5")
    return rounded(neardup.leader_similarity(docs, clusters), "jaccard")


@query("purged_near_dups", ctes("mail_docs", recursive=True, **_NEAR, **_SIMILAR) + """
SELECT sample_id FROM mail_docs WHERE sample_id NOT IN (SELECT sample_id FROM sims WHERE jaccard >= 0.85)""")
def purged_near_dups(spark, sf):
    docs = A.mail_docs(spark, sf)
    similarity = neardup.leader_similarity(docs, neardup.near_duplicate_clusters(docs, hash_name="md5"))
    return neardup.purge_verified(docs, similarity).select("sample_id")


_UNIFIED = dict(
    _NEAR, **_EXACT,
    ustar="""SELECT a, b FROM star UNION SELECT sample_id, dedup_cluster_id FROM exact
             WHERE dedup_cluster_id IS NOT NULL AND sample_id <> dedup_cluster_id""",
    ulinks="SELECT a, b FROM ustar UNION SELECT b, a FROM ustar",
    ureach="SELECT DISTINCT a AS id, a AS comp FROM ulinks UNION SELECT l.b, r.comp FROM ureach r JOIN ulinks l ON r.id = l.a",
    unified="""SELECT e.*, coalesce(c, sample_id) AS unified_cluster_id FROM exact e
               LEFT JOIN (SELECT id, min(comp) AS c FROM ureach GROUP BY id) ON id = sample_id""")


def _unified(spark, sf):
    exact = _exact(spark, sf)
    near = neardup.near_duplicate_edges(A.mail_docs(spark, sf), hash_name="md5")
    return neardup.unify_edges(exact, neardup.cluster_edges(exact, "dedup_cluster_id"), near)


@query("unified_clusters", ctes("mail_docs", recursive=True, **_UNIFIED)
       + "SELECT sample_id, dedup_cluster_id, unified_cluster_id FROM unified")
def unified_clusters(spark, sf):
    return _unified(spark, sf).select("sample_id", "dedup_cluster_id", "unified_cluster_id")


@query("decontaminated", ctes("mail_docs", recursive=True, **_UNIFIED) + """
SELECT u.sample_id, dataset_id, label FROM unified u LEFT JOIN sets x ON u.sample_id = x.sample_id
LEFT JOIN sets y ON unified_cluster_id = y.sample_id
WHERE u.sample_id = unified_cluster_id OR NOT (coalesce(dedup_cluster_id = unified_cluster_id, false) OR coalesce(
  len(list_intersect(x.ss, y.ss)) / (len(x.ss) + len(y.ss) - len(list_intersect(x.ss, y.ss))) >= 0.85, false))""")
def decontaminated(spark, sf):
    unified = cut_lineage(_unified(spark, sf))
    similarity = neardup.leader_similarity(A.mail_docs(spark, sf), unified, cluster="unified_cluster_id")
    return dedup.keep_unverified(unified, "unified_cluster_id", similarity).select("sample_id", "dataset_id", "label")


# --- splits ---------------------------------------------------------------------------------------------
_ASSIGNED = dict(_UNIFIED, assigned=f"SELECT *, {side('unified_cluster_id')} AS split FROM unified")


def _assigned(spark, sf):
    return splits.group_split(_unified(spark, sf))


@query("split_assign", ctes("mail_docs", recursive=True, **_ASSIGNED)
       + "SELECT sample_id, unified_cluster_id, split FROM assigned")
def split_assign(spark, sf):
    return _assigned(spark, sf).select("sample_id", "unified_cluster_id", "split")


@query("split_profile", ctes("mail_docs", recursive=True, **_ASSIGNED)
       + "SELECT split, dataset_id, label, count(*) AS n_rows FROM assigned GROUP BY ALL")
def split_profile(spark, sf):
    return splits.split_profile(_assigned(spark, sf))


@query("split_label_matrix", ctes("mail_docs", recursive=True, **_ASSIGNED) + f"""
SELECT split, count(*) AS n_rows, count(*) FILTER (label = 0) AS n_legitimate, count(*) FILTER (label = 1) AS n_phishing,
  {rnd('count(*) FILTER (label = 1) / greatest(count(label), 1)')} AS phishing_share FROM assigned GROUP BY 1""")
def split_label_matrix(spark, sf):
    return rounded(splits.split_label_matrix(_assigned(spark, sf)), "phishing_share")


@query("split_stratified", ctes("mail_docs") + """
SELECT sample_id, label, CASE WHEN r <= round(n * 0.15) THEN 'test' WHEN r <= round(n * 0.15) + round(n * 0.15) THEN 'val'
  ELSE 'train' END AS split
FROM (SELECT sample_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || sample_id), sample_id) AS r,
             count(*) OVER (PARTITION BY label) AS n FROM mail_docs)""")
def split_stratified(spark, sf):
    return splits.stratified_split(A.mail_docs(spark, sf)).select("sample_id", "label", "split")


@query("split_tables", ctes("mail_docs") + f"""
SELECT dataset_id, count(*) AS n_rows FROM mail_docs WHERE {side('sample_id')} = 'val' GROUP BY 1""")
def split_tables(spark, sf):
    """Splits written as partitioned parquet with JSON metadata; one split read back by partition pruning."""
    path = scratch_path(spark, "splits")
    files.save_splits(splits.group_split(A.mail_docs(spark, sf), "sample_id"), path)
    return files.load_split(spark, path, "val").groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query("split_metadata", ctes("mail_docs") + f"""
SELECT {side('sample_id')} AS split, label, count(*) AS n_rows FROM mail_docs GROUP BY ALL""")
def split_metadata(spark, sf):
    path = scratch_path(spark, "splits")
    files.save_splits(splits.group_split(A.mail_docs(spark, sf), "sample_id"), path)
    return spark.read.schema("split string, label int, n_rows bigint").json(f"{path}/metadata")


_INNER = f"CASE WHEN {unit(chr(39) + '42:loso:' + chr(39) + ' || sample_id')} < 0.15 THEN 'val' ELSE 'train' END"


@query("loso_assign", ctes("mail_docs")
       + f"SELECT sample_id, dataset_id AS held_out_fold, {_INNER} AS inner_split FROM mail_docs WHERE trim(dataset_id) <> ''")
def loso_assign(spark, sf):
    return splits.loso_assign(A.mail_docs(spark, sf)).select("sample_id", "held_out_fold", "inner_split")


@query("loso_summary", ctes("mail_docs", x=f"SELECT dataset_id, {_INNER} AS inner_split FROM mail_docs") + """
SELECT f.dataset_id AS fold, count(*) FILTER (x.dataset_id <> f.dataset_id AND inner_split = 'train') AS n_train,
  count(*) FILTER (x.dataset_id <> f.dataset_id AND inner_split = 'val') AS n_val,
  count(*) FILTER (x.dataset_id = f.dataset_id) AS n_test,
  count(DISTINCT CASE WHEN x.dataset_id <> f.dataset_id AND inner_split = 'train' THEN x.dataset_id END) AS n_train_sources
FROM x, (SELECT DISTINCT dataset_id FROM x) f GROUP BY 1""")
def loso_summary(spark, sf):
    return splits.loso_summary(splits.loso_assign(A.mail_docs(spark, sf)))


# --- leakage ------------------------------------------------------------------------------------------------
def _leak_sql(base: str) -> str:
    parts = []
    for check, key in (("hash", "subj_body_hash"), ("cluster", "unified_cluster_id"), ("sample_id", "sample_id")):
        for a, b in leakage.PAIRS:
            n = (f"(SELECT count(*) FROM (SELECT {key} FROM {base} WHERE split = '{a}' INTERSECT "
                 f"SELECT {key} FROM {base} WHERE split = '{b}'))")
            small = (f"(SELECT least(count(*) FILTER (split = '{a}'), count(*) FILTER (split = '{b}')) FROM {base})")
            parts.append(f"SELECT '{check}' AS \"check\", '{a}-{b}' AS pair, {n} AS n_overlap, {small} AS smaller_rows, "
                         f"{rnd(f'{n} / greatest({small}, 1) * 100')} AS overlap_pct, {n} = 0 AS is_clean")
    return "\nUNION ALL\n".join(parts)


@query("leakage_report", ctes("mail_docs", recursive=True, **{
    **_ASSIGNED, "assigned": f"SELECT *, {side('unified_cluster_id')} AS split FROM unified"}) + _leak_sql("assigned"))
def leakage_report(spark, sf):
    return rounded(leakage.split_leakage(_assigned(spark, sf)), "overlap_pct")


@query("leakage_of_plain_split", ctes("mail_docs", recursive=True, **{
    **_UNIFIED, "assigned": f"SELECT *, {side('sample_id')} AS split FROM unified"}) + _leak_sql("assigned"))
def leakage_of_plain_split(spark, sf):
    """The same check on a split that ignores clusters: overlaps show up."""
    return rounded(leakage.split_leakage(splits.group_split(_unified(spark, sf), "sample_id")), "overlap_pct")


def _quoted_sql() -> str:
    hits = ", ".join(f"CASE WHEN regexp_matches(body, {lit(p)}) THEN {i} END" for i, p in enumerate(QUOTE_PATTERNS))
    return (f"SELECT sample_id, list_filter([{hits}], lambda x: x IS NOT NULL) AS q FROM mail_threads")


_QUOTED = dict(h=_quoted_sql(), marked="""SELECT sample_id, array_to_string(q, ',') AS quote_patterns,
  len(list_filter(q, lambda x: x <= 1)) > 0 AS has_quoted_content,
  len(list_filter(q, lambda x: x > 1)) > 0 AS has_forwarded_content FROM h""")


@query("quoted_content", ctes("mail_threads", **_QUOTED) + "SELECT * FROM marked")
def quoted_content(spark, sf):
    out = leakage.mark_quoted(A.mail_threads(spark, sf))
    return out.select("sample_id", F.concat_ws(",", F.col("quote_patterns").cast("array<string>")).alias("quote_patterns"),
                      "has_quoted_content", "has_forwarded_content")


@query("quoted_summary", ctes("mail_threads", **_QUOTED) + f"""
SELECT count(*) AS n_rows, count(*) FILTER (has_quoted_content) AS n_quoted, count(*) FILTER (has_forwarded_content) AS n_forwarded,
  {rnd('count(*) FILTER (has_quoted_content) / count(*) * 100')} AS quoted_pct,
  {rnd('count(*) FILTER (has_forwarded_content) / count(*) * 100')} AS forwarded_pct FROM marked""")
def quoted_summary(spark, sf):
    return rounded(leakage.quoted_summary(leakage.mark_quoted(A.mail_threads(spark, sf))), "quoted_pct", "forwarded_pct")


# --- vectorization --------------------------------------------------------------------------------------------
_WORDS = r"""SELECT sample_id, unnest(l || [l[i] || ' ' || l[i + 1] FOR i IN range(1, len(l))]) AS term
  FROM (SELECT sample_id, regexp_extract_all(lower(t), '[\p{L}\p{N}_]{2,}') AS l FROM txt)"""
_CHARS = r"""SELECT sample_id, unnest([substr(w, i, n) FOR i IN range(1, length(w) - n + 2)]) AS term
  FROM (SELECT sample_id, w, unnest([3, 4, 5]) AS n FROM (
    SELECT sample_id, ' ' || unnest(regexp_extract_all(lower(t), '\S+')) || ' ' AS w FROM txt))"""
_TXT = f"SELECT sample_id, coalesce(subject, '') || ' ' || body AS t, {side('sample_id')} AS split FROM mail_docs"
_VOCAB = """SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM counts
  WHERE sample_id IN (SELECT sample_id FROM txt WHERE split = 'train')
  GROUP BY 1 HAVING count(*) >= 2 ORDER BY cf DESC, term LIMIT {n}"""


def _vocab_ctes(terms: str, n: int) -> dict:
    return dict(txt=_TXT, terms=terms, counts="SELECT sample_id, term, count(*) AS tf FROM terms GROUP BY 1, 2",
                vocab=_VOCAB.format(n=n))


def _split_docs(spark, sf):
    return splits.group_split(A.mail_docs(spark, sf), "sample_id")


def _model_text():
    return F.concat(F.coalesce("subject", F.lit("")), F.lit(" "), F.coalesce("body", F.lit("")))


def _train_vocab(docs, terms, n):
    return vectorize.most_frequent(grams.term_totals(docs.filter("split = 'train'"), terms), 2, n)


@query("vocab_word", ctes("mail_docs", **_vocab_ctes(_WORDS, 30000)) + "SELECT * FROM vocab")
def vocab_word(spark, sf):
    return _train_vocab(_split_docs(spark, sf), grams.words(_model_text()), 30000)


@query("vocab_char", ctes("mail_docs", **_vocab_ctes(_CHARS, 30000)) + "SELECT * FROM vocab")
def vocab_char(spark, sf):
    return _train_vocab(_split_docs(spark, sf), grams.chars(_model_text()), 30000)


_WEIGHTS = f"""
SELECT sample_id, term, idx, {rnd('w / sqrt(sum(w * w) OVER (PARTITION BY sample_id))')} AS weight FROM (
  SELECT sample_id, term, idx, (1 + ln(tf)) * idf AS w FROM counts JOIN (
    SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx,
           ln((1 + (SELECT count(*) FROM txt WHERE split = 'train')) / (1 + df)) + 1 AS idf FROM vocab) USING (term))"""


def _weights(spark, sf, terms):
    docs = _split_docs(spark, sf)
    fitted = vectorize.fit(docs.filter("split = 'train'"), terms, 2, 30000)
    return rounded(vectorize.weights(docs, terms, fitted), "weight"), fitted


@query("tfidf_word", ctes("mail_docs", **_vocab_ctes(_WORDS, 30000)) + _WEIGHTS)
def tfidf_word(spark, sf):
    long, fitted = _weights(spark, sf, grams.words(_model_text()))
    # the vocabulary is limited to 30,000 rows
    return long.join(F.broadcast(fitted.select("term", "idx")), "idx").select("sample_id", "term", "idx", "weight")


@query("tfidf_char", ctes("mail_docs", **_vocab_ctes(_CHARS, 30000), w=_WEIGHTS) + f"""
SELECT sample_id, count(*) AS n_terms, {rnd('sum(round_even(weight * 1e6, 0)::BIGINT)::DOUBLE / 1e6', 3)} AS total_weight, {rnd('max(weight)', 5)} AS max_weight
FROM w GROUP BY 1""")
def tfidf_char(spark, sf):
    """Per email: terms, total and largest weight (the table itself has a row per email and n-gram). Weights have six digits
    and are summed as whole numbers, so the order of summation does not matter."""
    long, _ = _weights(spark, sf, grams.chars(_model_text()))
    per = long.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_terms"), (F.sum(F.rint(F.col("weight") * 1e6).cast("long")).cast("double") / 1e6).alias("total_weight"),
                                        F.max("weight").alias("max_weight"))
    return rounded(rounded(per, "total_weight", digits=3), "max_weight", digits=5)


# --- flagship -----------------------------------------------------------------------------------------------------
@query("flagship", ctes("mail_docs", **_EXACT) + f"""
SELECT split, count(*) AS n_rows, count(dedup_cluster_id) AS n_duplicate_rows,
  count(*) FILTER (label = 0) AS n_legitimate, count(*) FILTER (label = 1) AS n_phishing,
  (SELECT count(*) FROM (SELECT dedup_cluster_id FROM (SELECT dedup_cluster_id, {side('coalesce(dedup_cluster_id, sample_id)')} AS s
     FROM exact) WHERE dedup_cluster_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT s) > 1)) AS n_crossing_clusters
FROM (SELECT *, {side('coalesce(dedup_cluster_id, sample_id)')} AS split FROM exact) GROUP BY 1""")
def flagship(spark, sf):
    """Rows, duplicate rows and label mix per split, and how many duplicate clusters cross splits (none)."""
    marked = dedup.mark_exact_duplicates(_hashed(spark, sf), "subj_body_hash").select(
        "sample_id", "dedup_cluster_id", "label")
    split = splits.group_split(marked, "dedup_cluster_id")
    per = split.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("dedup_cluster_id").alias("n_duplicate_rows"),
        F.count_if(F.col("label") == 0).alias("n_legitimate"), F.count_if(F.col("label") == 1).alias("n_phishing"))
    crossing = (split.filter("dedup_cluster_id is not null").groupBy("dedup_cluster_id")
                .agg(F.min("split").alias("a"), F.max("split").alias("b"))
                .agg(F.count_if(F.col("a") != F.col("b")).alias("n_crossing_clusters")))
    return per.withColumn("_k", F.lit(1)).join(F.broadcast(crossing.withColumn("_k", F.lit(1))), "_k").drop("_k")
