"""Queries over the corpus: harmonization, audits, text preparation, URLs and features."""
from __future__ import annotations

from pyspark.sql import functions as F

from mailwarden import constants as K
from mailwarden.functions import text as X
from mailwarden.operators import audit, features, scaling
from mailwarden.operators.splits import group_split
from mailwarden.plans.registry import (collapse, count, ctes, lit, nfkd, present, query, rnd, rounded, strip, unit)
from mailwarden.session import scratch_path
from mailwarden.sources import files, harmonize as H, tables as A

# --- harmonization -----------------------------------------------------------------------------
_VALUE = f"""CASE WHEN lower(trim(v)) IN ({', '.join(lit(x) for x in K.LEGITIMATE_LABELS)}) THEN 0
  WHEN lower(trim(v)) IN ({', '.join(lit(x) for x in K.PHISHING_LABELS)}) THEN 1
  WHEN trunc(try_cast(trim(v) AS DOUBLE)) = 0 THEN 0 WHEN trunc(try_cast(trim(v) AS DOUBLE)) = 1 THEN 1 END"""


@query("canonical_emails", ctes("raw_corpus") + f"""
SELECT source || '_' || raw_row_id AS sample_id, source AS dataset_id, "Title" AS subject, md5(" Text ") AS body_md5,
       NULL::VARCHAR AS sender, NULL::VARCHAR AS receiver, NULL::VARCHAR AS date, NULL::VARCHAR AS urls_raw,
       NULL::INT AS url_count_source, {_VALUE.replace('(v)', '("Label")')} AS label, raw_row_id
FROM raw_corpus""")
def canonical_emails(spark, sf):
    out = H.harmonize(A.raw_corpus(spark, sf).drop("lang"), F.col("source"))
    return out.withColumn("body", F.md5("body")).withColumnRenamed("body", "body_md5")


@query("schema_profile", ctes("raw_corpus") + """
SELECT 'docs' AS source, role, column_name, (SELECT count(*) FROM raw_corpus) AS n_rows, n_missing FROM (
  SELECT 'label' AS role, 'Label' AS column_name, count(*) FILTER ("Label" IS NULL) AS n_missing FROM raw_corpus
  UNION ALL SELECT 'subject', 'Title', count(*) FILTER ("Title" IS NULL) FROM raw_corpus
  UNION ALL SELECT 'body', ' Text ', count(*) FILTER (" Text " IS NULL) FROM raw_corpus)""")
def schema_profile(spark, sf):
    return H.schema_profile(A.raw_corpus(spark, sf), "docs")


@query("label_mapping", ctes("raw_corpus") + f"""
SELECT source, v AS raw_label, n_rows, label, label IS NULL AS is_ambiguous FROM (
  SELECT source, v, n_rows, {_VALUE} AS label FROM (
    SELECT source, "Label" AS v, count(*) AS n_rows FROM raw_corpus WHERE "Label" IS NOT NULL GROUP BY ALL))""")
def label_mapping(spark, sf):
    return H.label_mapping(A.raw_corpus(spark, sf), "Label", "source")


_KNOWN = [f"src{i}" for i in range(15)]


@query("canonical_violations", ctes("broken_docs") + f"""
SELECT 'invalid_label' AS rule, label::VARCHAR AS value, count(*) AS n FROM broken_docs
 WHERE label NOT IN (0, 1) GROUP BY label
UNION ALL SELECT 'unknown_source', dataset_id, count(*) FROM broken_docs
 WHERE dataset_id NOT IN ({', '.join(lit(s) for s in _KNOWN)}) GROUP BY dataset_id
UNION ALL SELECT 'duplicate_sample_id', 'all', n FROM (
  SELECT count(*) - count(DISTINCT sample_id) AS n FROM broken_docs) WHERE n > 0""")
def canonical_violations(spark, sf):
    return H.violations(A.broken_docs(spark, sf), _KNOWN)


# --- sources and sinks ----------------------------------------------------------------------------
@query("csv_corpus", """
SELECT doc_id::VARCHAR AS doc_id, md5(text) AS text_md5, length(text) AS n_chars, lang, 'docs' AS dataset_id,
  row_number() OVER (ORDER BY doc_id) - 1 AS raw_row_id
FROM documents""")
def csv_corpus(spark, sf):
    path = scratch_path(spark, "csv")
    docs = A.read_table(spark, sf, "documents").select("doc_id", "lang", "text")
    # files in the order of the ids, none of them one task's work; rows are numbered by their place in the corpus
    docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.csv(
        path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    back = files.read_corpus(spark, path, "docs", follow=True)
    return back.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"), "lang", "dataset_id", "raw_row_id")


@query("file_manifest")
def file_manifest(spark, sf):
    return files.file_integrity(spark, sf)


@query("corpora_by_manifest", """
SELECT lang AS dataset_id, count(*) AS n_rows, sum(length(text))::BIGINT AS n_chars
FROM documents WHERE lang <> 'es' GROUP BY lang""")
def corpora_by_manifest(spark, sf):
    """A corpus per language, of as many files as tasks wrote; the manifest carries wrong checksums for one of them, which is
    left out."""
    root = scratch_path(spark, "corpora")
    A.read_table(spark, sf, "documents").select("text", "source", "lang") \
        .write.partitionBy("lang").csv(root, header=True, quoteAll=True, escape='"',
                                       ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    lang = F.regexp_extract("file", r"lang=(\w+)/part.*\.csv$", 1)
    found = files.file_integrity(spark, root, min_bytes=1).withColumn("lang", lang).filter("lang <> ''")
    wrong = F.when(F.col("lang") == "es", F.lit("0" * 32)).otherwise(F.col("md5"))
    manifest = found.select("file", wrong.alias("expected_md5"))
    sources = {}
    for r in found.select("lang", "file").collect():      # one row per file
        sources.setdefault(r["lang"], []).append(r["file"])
    raw = files.read_corpora(spark, root, sources, manifest, min_bytes=1)
    return files.union_corpora(raw).groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("text")).cast("bigint").alias("n_chars"))


# --- audits ------------------------------------------------------------------------------------------
@query("audit_summary", ctes("mail_docs") + f"""
SELECT dataset_id, n_rows, 11 AS n_columns, total_missing, {rnd('total_missing / (n_rows * 11) * 100', 2)} AS missing_pct
FROM (SELECT dataset_id, count(*) AS n_rows, (count(*) * 10 - count(sample_id) - count(subject) - count(body)
  - count(sender) - count(receiver) - count(date) - count(urls_raw) - count(url_count_source) - count(label)
  - count(raw_row_id)) AS total_missing FROM mail_docs GROUP BY 1)""")
def audit_summary(spark, sf):
    return audit.dataset_summary(A.mail_docs(spark, sf))


def _text_stats_sql(view: str, column: str) -> str:
    return ctes(view) + f"""
SELECT dataset_id, count({column}) AS present, count(*) - count({column}) AS missing,
  count(*) FILTER (NOT regexp_matches(coalesce({column}, ''), '\\S')) AS empty,
  {rnd(f'avg(length({column}))', 1)} AS char_mean, {rnd(f'median(length({column}))', 1)} AS char_median,
  min(length({column})) AS char_min, max(length({column})) AS char_max,
  {rnd(f'stddev_samp(length({column}))', 1)} AS char_std,
  {rnd('avg(words)', 1)} AS word_mean, {rnd('median(words)', 1)} AS word_median, max(words) AS word_max
FROM (SELECT *, len(regexp_extract_all({column}, '\\S+')) AS words FROM {view}) GROUP BY dataset_id"""


@query("audit_text_stats", _text_stats_sql("mail_docs", "body"))
def audit_text_stats(spark, sf):
    return audit.text_stats(A.mail_docs(spark, sf), "body")


@query("audit_sender_stats", _text_stats_sql("mail_pages", "sender"))
def audit_sender_stats(spark, sf):
    return audit.text_stats(A.mail_pages(spark, sf), "sender")


@query("audit_url_stats", ctes("mail_pages") + f"""
SELECT dataset_id, count(*) FILTER (n > 0) AS emails_with_urls,
  {rnd('count(*) FILTER (n > 0) / count(*) * 100', 2)} AS emails_with_urls_pct, {rnd('avg(n)', 2)} AS url_count_mean,
  max(n) AS url_count_max, sum(n)::BIGINT AS total_urls_found
FROM (SELECT dataset_id, {count('body', '''(?i)https?://[^\\s<>"']+|www\\.[^\\s<>"']+''')} AS n FROM mail_pages)
GROUP BY 1""")
def audit_url_stats(spark, sf):
    return audit.url_stats(A.mail_pages(spark, sf))


_AUDITED = ["subject", "body", "sender", "receiver", "date", "label"]


@query("audit_missing", ctes("mail_pages") + "\nUNION ALL\n".join(
    f"SELECT dataset_id, count(*) AS n_rows, '{c}' AS column_name, count(*) - count({c}) AS n_missing, "
    f"{rnd(f'(count(*) - count({c})) / count(*) * 100', 2)} AS missing_pct FROM mail_pages GROUP BY dataset_id"
    for c in _AUDITED))
def audit_missing(spark, sf):
    return audit.missing_by_column(A.mail_pages(spark, sf), _AUDITED)


@query("audit_class_pct", ctes("mail_docs") + f"""
SELECT dataset_id, label, n_rows, {rnd('n_rows / total * 100', 2)} AS class_pct FROM (
  SELECT dataset_id, label, count(*) AS n_rows, sum(count(*)) OVER (PARTITION BY dataset_id) AS total
  FROM mail_docs GROUP BY 1, 2) WHERE label IS NOT NULL""")
def audit_class_pct(spark, sf):
    return audit.class_distribution(A.mail_docs(spark, sf))


@query("audit_metadata", ctes("mail_pages") + """
SELECT dataset_id, count(sender) > 0 AS has_sender, count(receiver) > 0 AS has_receiver, count(date) > 0 AS has_date
FROM mail_pages GROUP BY 1""")
def audit_metadata(spark, sf):
    return audit.metadata_availability(A.mail_pages(spark, sf))


# --- text preparation -------------------------------------------------------------------------------------
def _digest(df, text):
    return df.select("sample_id", F.md5(text).alias("text_md5"), F.length(text).alias("n_chars"))


def _digest_sql(view: str, expr: str) -> str:
    return ctes(view) + f"SELECT sample_id, md5(t) AS text_md5, length(t) AS n_chars FROM (" \
                        f"SELECT sample_id, {expr} AS t FROM {view})"


_TRANSFORMER = strip(
    r"regexp_replace(regexp_replace(regexp_replace(coalesce(@, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), "
    r"'[ \t]{6,}', '     ', 'g'), '\n{4,}', chr(10) || chr(10) || chr(10), 'g')")
_CLASSICAL = collapse("lower(regexp_replace(" + nfkd("coalesce(@, '')") + r", '[\x00-\x1f\x7f]', ' ', 'g'))")


def _combine(subject: str, body: str, sep: str) -> str:
    return f"concat_ws({lit(sep)}, nullif({strip(subject)}, ''), nullif({strip(body)}, ''))"


@query("clean_transformer", _digest_sql("mail_docs", _TRANSFORMER.replace("@", "body")))
def clean_transformer(spark, sf):
    return _digest(A.mail_docs(spark, sf), X.transformer_text(F.col("body")))


@query("clean_classical", _digest_sql("mail_docs", _CLASSICAL.replace("@", "body")))
def clean_classical(spark, sf):
    return _digest(A.mail_docs(spark, sf), X.classical_text(F.col("body")))


@query("clean_classical_masked", _digest_sql("mail_pages", collapse(
    r"regexp_replace(regexp_replace(regexp_replace(" + _CLASSICAL.replace("@", "body")
    + r", 'https?://\S+', ' URL ', 'g'), 'www\.\S+', ' URL ', 'g'), '\b\d+\b', ' NUM ', 'g')")))
def clean_classical_masked(spark, sf):
    return _digest(A.mail_pages(spark, sf), X.classical_text(F.col("body"), remove_urls=True, remove_numbers=True))


@query("nfkd_text", _digest_sql("mail_docs", nfkd("body")))
def nfkd_text(spark, sf):
    return _digest(A.mail_docs(spark, sf), X.nfkd(F.col("body")))


@query("strip_html", _digest_sql("mail_pages", collapse(
    "replace(replace(replace(replace(replace(replace(regexp_replace(body, '<[^>]+>', ' ', 'g'), "
    "'&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', '''')")))
def strip_html(spark, sf):
    return _digest(A.mail_pages(spark, sf), X.strip_tags(F.col("body")))


@query("combined_text", ctes("mail_docs") + f"""
SELECT sample_id, md5(a) AS transformer_md5, md5(b) AS classical_md5, length(a) AS n_transformer, length(b) AS n_classical
FROM (SELECT sample_id,
  {_combine(_TRANSFORMER.replace('@', 'subject'), _TRANSFORMER.replace('@', 'body'), ' [SEP] ')} AS a,
  {_combine(_CLASSICAL.replace('@', 'subject'), _CLASSICAL.replace('@', 'body'), ' ')} AS b FROM mail_docs)""")
def combined_text(spark, sf):
    s, b = F.col("subject"), F.col("body")

    def measured(text, name):
        # digest and length of a text that is computed once
        return X.let(text, lambda t: F.struct(F.md5(t).alias(f"{name}_md5"), F.length(t).alias(f"n_{name}"))).alias(name)
    df = A.mail_docs(spark, sf).select(
        "sample_id", measured(X.join_subject_body(X.transformer_text(s), X.transformer_text(b), " [SEP] "), "transformer"),
        measured(X.join_subject_body(X.classical_text(s), X.classical_text(b), " "), "classical"))
    return df.select("sample_id", "transformer.transformer_md5", "classical.classical_md5", "transformer.n_transformer", "classical.n_classical")


@query("model_text", _digest_sql("mail_docs", "coalesce(subject, '') || ' ' || coalesce(body, '')"))
def model_text(spark, sf):
    return _digest(A.mail_docs(spark, sf), X.model_text(F.col("subject"), F.col("body")))


# --- URLs ------------------------------------------------------------------------------------------------------
_URL_PATTERN = r"""(?i)(?:https?://|www\.)[^\s<>"')\]]+"""
_PARSED = f"""
SELECT sample_id, position, url, length(url) AS url_length, length(host) AS host_length,
  length(regexp_replace(regexp_extract(tail, '^[^?#]*'), ';[^/]*$', '')) AS path_length,
  length(regexp_extract(tail, '^[^?#]*\\?([^#]*)', 1)) AS query_length,
  greatest(0, len(string_split(host, '.')) - 2) AS subdomains,
  length(regexp_replace(url, '[^0-9]', '', 'g')) / greatest(length(url), 1) AS digit_ratio,
  length(regexp_replace(url, '[\\p{{L}}\\p{{N}}./_:\\-]', '', 'g')) / greatest(length(url), 1) AS special_ratio,
  length(url) - length(replace(url, '%', '')) AS percent_count,
  regexp_matches(host, '^(\\d{{1,3}}\\.){{3}}\\d{{1,3}}$')::INT AS is_ipv4,
  contains(host, 'xn--')::INT AS is_punycode,
  {present('lower(url)', K.SUSPICIOUS_URL_TOKENS)} AS suspicious_tokens
FROM (SELECT *, lower(regexp_replace(regexp_replace(regexp_extract(rest, '^//([^/?#]*)', 1), '^.*@', ''), ':.*$', '')) AS host,
             regexp_replace(rest, '^//[^/?#]*', '') AS tail
      FROM (SELECT *, regexp_replace(CASE WHEN contains(url, '://') THEN url ELSE 'http://' || url END,
                                     '^[A-Za-z][A-Za-z0-9+.\\-]*:', '') AS rest
            FROM (SELECT sample_id, generate_subscripts(urls, 1) - 1 AS position, unnest(urls) AS url
                  FROM (SELECT sample_id, regexp_extract_all(body, {lit(_URL_PATTERN)}) AS urls FROM mail_pages))))
"""
_ENTROPY = f"""
SELECT sample_id, position, {rnd('sum(-(c / n) * log2(c / n))', 4)} AS entropy FROM (
  SELECT sample_id, position, ch, count(*) AS c, any_value(n) AS n FROM (
    SELECT sample_id, position, length(url) AS n, unnest(string_split(url, '')) AS ch FROM parsed)
  GROUP BY 1, 2, 3) GROUP BY 1, 2"""
_URLS = ctes("mail_pages", parsed=_PARSED, ent=_ENTROPY, urls="SELECT * FROM parsed JOIN ent USING (sample_id, position)")


@query("url_table", _URLS + f"""
SELECT * REPLACE ({rnd('digit_ratio')} AS digit_ratio, {rnd('special_ratio')} AS special_ratio) FROM urls""")
def url_table(spark, sf):
    return rounded(features.url_table(A.mail_pages(spark, sf)), "digit_ratio", "special_ratio")


def _features(spark, sf, adapter, group):
    df = features.feature_table(adapter(spark, sf), [group])
    doubles = [n for n, t in df.dtypes if t == "double"]
    return rounded(df, *doubles)


def _mean(c: str, d: int) -> str:
    return f"{rnd(f'coalesce(avg({c}), 0)', d)}"


@query("url_features", _URLS + f"""
SELECT m.sample_id, count(url) AS url_count, coalesce(sum(url_length), 0)::INT AS total_url_chars,
  {_mean('url_length', 2)} AS mean_url_length, coalesce(max(url_length), 0) AS max_url_length,
  {_mean('host_length', 2)} AS hostname_length_mean, {_mean('path_length', 2)} AS path_length_mean,
  {_mean('query_length', 2)} AS query_length_mean, {_mean('subdomains', 2)} AS num_subdomains_mean,
  {_mean('digit_ratio', 4)} AS digit_ratio_url, {_mean('special_ratio', 4)} AS special_char_ratio_url,
  coalesce(sum(percent_count), 0)::INT AS percent_encoding_count, coalesce(sum(is_ipv4), 0)::INT AS ip_address_hostname,
  coalesce(sum(is_punycode), 0)::INT AS punycode_indicator,
  coalesce(sum(suspicious_tokens), 0)::INT AS suspicious_token_count, {_mean('entropy', 4)} AS url_entropy_mean
FROM mail_pages m LEFT JOIN urls USING (sample_id) GROUP BY 1""")
def url_features(spark, sf):
    return _features(spark, sf, A.mail_pages, "url")


# --- the other feature groups -------------------------------------------------------------------------------------
_HAY = "lower(CASE WHEN coalesce(subject, '') <> '' THEN subject || ' ' || body ELSE body END)"


def _only(c: str, keep: str) -> str:
    return f"length(regexp_replace({c}, '[^{keep}]', '', 'g'))"


def _lexical_sql(view: str) -> str:
    return ctes(view) + f"""
SELECT sample_id, length(body) AS email_length, length(coalesce(subject, '')) AS subject_length,
  {count('body', r'[^ \t\n\r\f\v]+')} AS word_count,
  greatest(1, len(list_filter(regexp_split_to_array(body, '[.!?]+'), lambda s: regexp_matches(s, '\\S')))) AS sentence_count,
  {rnd(_only('body', chr(92) + 'p{Lu}') + ' / greatest(length(body), 1)')} AS uppercase_ratio,
  {rnd(_only('body', '0-9') + ' / greatest(length(body), 1)')} AS digit_ratio,
  {rnd("length(regexp_replace(body, '[" + chr(92) + "p{L}" + chr(92) + "p{N}" + chr(92) + "s]', '', 'g')) / greatest(length(body), 1)")} AS punctuation_ratio,
  {_only('body', '!')} AS exclamation_count, {_only('body', '?')} AS question_count,
  {present(_HAY, K.URGENCY_TERMS)} AS urgency_lexicon_count,
  {present(_HAY, K.CREDENTIAL_TERMS)} AS credential_request_lexicon_count,
  {present(_HAY, K.FINANCIAL_TERMS)} AS financial_action_lexicon_count,
  {present(_HAY, K.CALL_TO_ACTION_TERMS)} AS call_to_action_count
FROM {view}"""


@query("features_lexical", _lexical_sql("mail_docs"))
def features_lexical(spark, sf):
    return _features(spark, sf, A.mail_docs, "lexical")


@query("features_lexical_pages", _lexical_sql("mail_pages"))
def features_lexical_pages(spark, sf):
    return _features(spark, sf, A.mail_pages, "lexical")


@query("features_structural", ctes("mail_docs") + f"""
SELECT sample_id, len(lines) AS line_count,
  {rnd("len(list_filter(lines, lambda l: NOT regexp_matches(l, '" + chr(92) + "S'))) / len(lines)")} AS empty_line_ratio,
  {rnd("list_sum(list_transform(lines, lambda l: length(l))) / len(lines)")} AS avg_line_length,
  {rnd(_only('body', chr(92) + 's') + ' / greatest(length(body), 1)')} AS whitespace_ratio,
  {_only('body', chr(92) + 't')} AS tab_count, {_only('body', '$')} AS dollar_sign_count,
  {_only('body', '@')} AS at_sign_count, {_only('body', '#')} AS hash_count,
  shouted AS all_caps_word_count, {rnd('shouted / greatest(len(words), 1)')} AS all_caps_word_ratio,
  {count('body', chr(92) + 'b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+' + chr(92) + '.[A-Z|a-z]{2,}' + chr(92) + 'b')} AS email_addresses_in_body,
  {count('body', chr(92) + 'b' + chr(92) + 'd{3}[-.]?' + chr(92) + 'd{3}[-.]?' + chr(92) + 'd{4}' + chr(92) + 'b')} AS phone_numbers_in_body
FROM (SELECT *, len(list_filter(words, lambda w: regexp_matches(w, '^\\p{{Lu}}{{2,}}$'))) AS shouted
      FROM (SELECT sample_id, body, string_split(body, chr(10)) AS lines, regexp_extract_all(body, '\\S+') AS words
            FROM mail_docs))""")
def features_structural(spark, sf):
    return _features(spark, sf, A.mail_docs, "structural")


def _domain(c: str) -> str:
    return rf"lower(regexp_extract(coalesce({c}, ''), '@([A-Za-z0-9.-]+\.[A-Za-z]{{2,}})', 1))"


@query("features_header", ctes("mail_pages") + f"""
SELECT sample_id, (trim(coalesce(sender, '')) <> '')::INT AS sender_present, length(own) AS sender_domain_length,
  (own IN ({', '.join(lit(d) for d in K.FREE_MAIL_DOMAINS)}))::INT AS free_email_provider,
  (own <> '' AND shown <> '' AND shown <> own)::INT AS display_name_email_mismatch,
  (own <> '' AND other <> '' AND own <> other)::INT AS sender_receiver_mismatch,
  (trim(coalesce(receiver, '')) <> '')::INT AS receiver_present
FROM (SELECT *, {_domain('sender')} AS own, {_domain('receiver')} AS other,
        {_domain("regexp_extract(trim(coalesce(sender, '')), '^" + '"?([^"<]+)"?' + chr(92) + "s*<', 1)")} AS shown
      FROM mail_pages)""")
def features_header(spark, sf):
    return _features(spark, sf, A.mail_pages, "header")


_PLAIN = collapse(
    "replace(replace(replace(replace(replace(replace(regexp_replace(body, '<[^>]+>', ' ', 'g'), "
    "'&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', '''')")


@query("features_html", ctes("mail_pages") + f"""
SELECT sample_id, h::INT AS html_presence,
  CASE WHEN h THEN {rnd(f'length({_PLAIN}) / greatest(length(body), 1)', 4)} ELSE 1.0 END AS text_html_ratio,
  CASE WHEN h THEN {count('body', '(?i)<a' + chr(92) + 'b')} ELSE 0 END AS anchor_count,
  CASE WHEN h THEN {count('body', '(?i)<form' + chr(92) + 'b')} ELSE 0 END AS form_count,
  CASE WHEN h THEN {' + '.join(count('body', '(?i)' + p) for p in K.HIDDEN_TEXT_PATTERNS)} ELSE 0 END AS hidden_text_indicators,
  CASE WHEN h THEN {' + '.join(count('body', '(?i)' + a + chr(92) + 's*=' + chr(92) + 's*["' + chr(39) + ']https?://') for a in K.EXTERNAL_RESOURCE_ATTRIBUTES)} ELSE 0 END AS external_resource_count
FROM (SELECT *, regexp_matches(body, '<[a-zA-Z][^>]*>') AS h FROM mail_pages)""")
def features_html(spark, sf):
    return _features(spark, sf, A.mail_pages, "html")


@query("features_all")
def features_all(spark, sf):
    """The whole 52-column table in one projection."""
    return features.feature_table(A.mail_pages(spark, sf), keep=["sample_id", "dataset_id", "label"])


_SCALED = ["email_length", "word_count", "uppercase_ratio", "punctuation_ratio", "tab_count"]
_U = unit("'42:' || sample_id")
_SPLIT = f"CASE WHEN {_U} < 0.15 THEN 'test' WHEN {_U} < 0.3 THEN 'val' ELSE 'train' END"
_SCALE_BASE = f"""SELECT sample_id, {_SPLIT} AS split, length(body)::DOUBLE AS email_length,
  {count('body', r'[^ \t\n\r\f\v]+')}::DOUBLE AS word_count,
  {_only('body', chr(92) + 'p{Lu}')} / greatest(length(body), 1) AS uppercase_ratio,
  length(regexp_replace(body, '[\\p{{L}}\\p{{N}}\\s]', '', 'g')) / greatest(length(body), 1) AS punctuation_ratio,
  {_only('body', chr(92) + 't')}::DOUBLE AS tab_count FROM mail_docs"""


def _scaled_sql(center: str, spread: str) -> str:
    pick = ", ".join(f"{center.format(c=c)} AS c_{c}, {spread.format(c=c)} AS s_{c}" for c in _SCALED)
    out = ", ".join(rnd(f"({c} - c_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END") + f" AS {c}" for c in _SCALED)
    return ctes("mail_docs", base=_SCALE_BASE) + f"""
SELECT sample_id, split, {out} FROM base, (SELECT {pick} FROM base WHERE split = 'train')"""


def _scaled(spark, sf, method):
    base = group_split(A.mail_docs(spark, sf), "sample_id", seed=42)
    rows = features.feature_table(base, ["lexical", "structural"], ["sample_id", "split"]) \
        .select("sample_id", "split", *_SCALED)
    params = scaling.fit_scaler(rows.filter("split = 'train'"), _SCALED, method)
    return rounded(scaling.apply_scaler(rows, params), *_SCALED)


@query("features_scaled", _scaled_sql("avg({c})", "stddev_pop({c})"))
def features_scaled(spark, sf):
    return _scaled(spark, sf, "standard")


@query("features_scaled_minmax", _scaled_sql("min({c})", "max({c}) - min({c})"))
def features_scaled_minmax(spark, sf):
    return _scaled(spark, sf, "minmax")


@query("features_scaled_robust", _scaled_sql("quantile_disc({c}, 0.5)", "quantile_disc({c}, 0.75) - quantile_disc({c}, 0.25)"))
def features_scaled_robust(spark, sf):
    return _scaled(spark, sf, "robust")


@query("scaler_params", ctes("mail_docs", base=_SCALE_BASE) + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, {rnd(f'avg({c})')} AS center, "
    f"{rnd(f'CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END')} AS scale FROM base WHERE split = 'train'"
    for c in _SCALED))
def scaler_params(spark, sf):
    """Fitted parameters saved as a table and read back."""
    base = group_split(A.mail_docs(spark, sf), "sample_id", seed=42)
    rows = features.feature_table(base, ["lexical", "structural"], ["sample_id", "split"])
    path = scratch_path(spark, "scaler")
    scaling.save_scaler(scaling.fit_scaler(rows.filter("split = 'train'"), _SCALED), path)
    return rounded(scaling.load_scaler(spark, path), "center", "scale")
