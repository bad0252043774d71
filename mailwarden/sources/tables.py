"""Reading the given tables and viewing them as canonical email tables.

The adapters are plain SQL text so that another SQL engine can run the same text; only the
hash-prefix expression differs by dialect.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt to ``spark.mailwarden.scan.tasks`` tasks where that is set.

    A file of a single row group is one scan task, and every projection on it too. The setting is for such files (a local
    session sets it to its cores); without it the splits of the scan stay as they are.
    """
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tasks = spark.conf.get("spark.mailwarden.scan.tasks", None)
    return table.repartition(int(tasks)) if tasks else table


def hash32_sql(expr: str, dialect: str) -> str:
    """First 32 bits of md5 as a bigint, in either dialect."""
    if dialect == "spark":
        return f"CAST(conv(substr(md5({expr}),1,8),16,10) AS BIGINT)"
    return f"CAST(('0x' || substr(md5({expr}),1,8)) AS BIGINT)"


MAIL_DOCS = """
SELECT d.source || '_' || CAST(d.doc_id AS STRING) AS sample_id,
       d.source AS dataset_id,
       split_part(d.text, chr(10), 1) AS subject,
       d.text AS body,
       nullif(regexp_extract(d.text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', 0), '') AS sender,
       CAST(NULL AS STRING) AS receiver,
       CAST(NULL AS STRING) AS date,
       CAST(NULL AS STRING) AS urls_raw,
       CAST(NULL AS INT) AS url_count_source,
       CAST(l.toxic AS INT) AS label,
       d.doc_id AS raw_row_id
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""

# Relative links are resolved against the page's own origin; some pages get an IPv4 or punycode
# origin, an urgent subject, a form with hidden text, and sender/receiver headers of every shape.
MAIL_PAGES = """
SELECT host || '_' || CAST(page_id AS STRING) AS sample_id,
       host AS dataset_id,
       CASE WHEN page_id % 5 = 0 THEN 'URGENT: verify your account now - ' || title
            WHEN page_id % 8 = 3 THEN 'Invoice and payment order - ' || title
            ELSE title END AS subject,
       replace(html, 'href="/', 'href="' || origin || '/') || ' ' || url
         || CASE WHEN page_id % 6 = 0
                 THEN ' <form action="go"><p style="display: none">log in with your password</p></form>'
                      || ' www.login-update.xyz/verify%20now?id=' || CAST(page_id AS STRING)
                 ELSE '' END AS body,
       CASE page_id % 4 WHEN 0 THEN '"Support" <help@' || host || '>'
                        WHEN 1 THEN '"billing@paypal.com" <u' || CAST(page_id AS STRING) || '@gmail.com>'
                        WHEN 2 THEN 'news@' || host
                        ELSE CAST(NULL AS STRING) END AS sender,
       CASE page_id % 3 WHEN 0 THEN 'Team <team@example.org>'
                        WHEN 1 THEN 'user@' || host
                        ELSE CAST(NULL AS STRING) END AS receiver,
       CAST(NULL AS STRING) AS date,
       url AS urls_raw,
       CAST(NULL AS INT) AS url_count_source,
       CASE WHEN page_id % 5 = 0 OR page_id % 7 = 0 OR page_id % 13 = 0 THEN 1 ELSE 0 END AS label,
       page_id AS raw_row_id
FROM (
  SELECT page_id, url, html,
         regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
         CASE WHEN page_id % 7 = 0 THEN 'http://192.168.' || CAST(page_id % 250 AS STRING) || '.7'
              WHEN page_id % 11 = 0 THEN 'http://user@xn--mail' || CAST(page_id AS STRING) || '.example.com:8080'
              ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) END AS origin,
         regexp_extract(html, '<title>([^<]*)</title>', 1) AS title
  FROM pages
) p
"""

# A reply quotes the turn before it, in one of four styles.
MAIL_THREADS = """
SELECT 'conv_' || CAST(c.conv_id AS STRING) || '_' || CAST(c.turn AS STRING) AS sample_id,
       c.role AS dataset_id,
       CASE WHEN p.text IS NULL THEN c.text
            WHEN c.turn % 4 = 1 THEN c.text || chr(10) || 'On Mon, Jan 1, 2024 at 10:00 they wrote:' || chr(10) || '> ' || p.text
            WHEN c.turn % 4 = 2 THEN c.text || chr(10) || '----- Original Message -----' || chr(10) || p.text
            WHEN c.turn % 4 = 3 THEN c.text || chr(10) || 'From: a' || chr(10) || 'Sent: b' || chr(10) || 'To: c'
                                     || chr(10) || 'Subject: d' || chr(10) || p.text
            ELSE c.text || chr(10) || 'Begin forwarded message:' || chr(10) || p.text END AS body
FROM conversations c LEFT JOIN conversations p ON c.conv_id = p.conv_id AND c.turn = p.turn + 1
"""


def predictions_sql(dialect: str) -> str:
    """A scored table: labelled documents with a hash-made probability (two decimals, hence ties)."""
    u = hash32_sql("'p:' || CAST(raw_row_id AS STRING)", dialect)
    return f"""
SELECT sample_id, dataset_id, subject, label, prob, CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS pred
FROM (SELECT sample_id, dataset_id, subject, label,
             CAST(label * 25 + floor({u} / 4294967296 * 76) AS DOUBLE) / 100 AS prob
      FROM ({MAIL_DOCS}) m WHERE label IS NOT NULL) s
"""


def register_views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)


def mail_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, sf_dir, "documents", "labels")
    return spark.sql(MAIL_DOCS)


def mail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, sf_dir, "pages")
    return spark.sql(MAIL_PAGES)


def mail_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, sf_dir, "conversations")
    return spark.sql(MAIL_THREADS)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, sf_dir, "documents", "labels")
    return spark.sql(predictions_sql("spark"))


# Raw corpus with the label spellings found in the wild, and a few that no rule can place.
RAW_CORPUS = """
SELECT d.source AS source, d.doc_id AS raw_row_id,
       split_part(d.text, chr(10), 1) AS `Title`, d.text AS ` Text `, d.lang AS lang,
       CASE WHEN l.toxic IS NULL THEN NULL
            WHEN d.doc_id % 17 = 0 THEN 'unknown'
            WHEN d.doc_id % 19 = 0 THEN '2'
            WHEN l.toxic = 1 THEN CASE d.doc_id % 6 WHEN 0 THEN ' Phishing' WHEN 1 THEN 'spam' WHEN 2 THEN '1'
                                       WHEN 3 THEN '1.0' WHEN 4 THEN 'SCAM ' ELSE '1.9' END
            ELSE CASE d.doc_id % 6 WHEN 0 THEN 'ham' WHEN 1 THEN 'Legitimate ' WHEN 2 THEN '0'
                                   WHEN 3 THEN '0.0' WHEN 4 THEN 'Not Spam' ELSE '0.7' END END AS `Label`
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""


def raw_corpus_sql(dialect: str) -> str:
    return RAW_CORPUS if dialect == "spark" else RAW_CORPUS.replace("`", '"')


def raw_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, sf_dir, "documents", "labels")
    return spark.sql(raw_corpus_sql("spark"))


# The canonical table with rows that break each validation rule mixed in.
BROKEN_DOCS = f"""
SELECT sample_id, dataset_id, CASE WHEN raw_row_id % 50 = 0 THEN 5 ELSE label END AS label, raw_row_id
FROM ({MAIL_DOCS}) a
UNION ALL
SELECT sample_id, dataset_id, label, raw_row_id FROM ({MAIL_DOCS}) b WHERE raw_row_id % 40 = 0
"""


def broken_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, sf_dir, "documents", "labels")
    return spark.sql(BROKEN_DOCS)
