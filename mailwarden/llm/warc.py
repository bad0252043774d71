"""WARC archives with revisit records: payload digests choose the original of each payload, headers are shuffled, not pages.

Writing: narrow heads (id, url, digest, size) are joined with the table of repeated digests (least record id per digest);
the first record of a payload is a response, the others are revisits that refer to it and carry no payload, so they are
written from their heads alone. A scan of the pages then has to know which of its rows are responses. It asks a bitmap of
the revisits, of fixed size (``BITS``) and so broadcast: a row whose bit is not set is a response and goes straight to its
archive. Responses whose bit another record has set are found among the heads; a second bitmap of these lets the scan pick
them out, and only what both bitmaps let through is joined exactly, payloads included: the chance hits. Where the bitmaps
fill up, more rows take the exact join; the result is the same. Records are written by Spark's text writer with the
record separator of the format, one gzip archive per task.
Reading: each archive is one stream; records are cut by their Content-Length, so payloads may hold the separator. Revisit
headers are joined with the responses that they refer to, by id and digest, which give back the payload's size and digest.
"""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mailwarden.llm.common import BITS, bitmap, flagged, salted_join, written
from mailwarden.session import scratch_path

MIN_BYTES = 100
KEY = ["record_id", "payload_digest"]
_END = "\r\n\r\n"
RECORDS = "record_id string, record_type string, url string, refers_to string, digest string, payload string"


def payloads(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """record_id, url, payload, payload_bytes and payload_digest of every row."""
    plain = pages.select(F.col(id_col).cast("long").alias("record_id"), F.col("url").cast("string").alias("url"),
                         F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    return plain.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn(
        "payload_digest", F.sha2("payload", 256))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["record_id"].eqNullSafe(b["record_id"]) & (a["payload_digest"] == b["payload_digest"])


def split_records(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int = MIN_BYTES, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """Responses with their payloads, and revisits (record_id, url, payload_digest, original) without."""
    wide = payloads(pages, id_col, payload_col)
    heads = written(wide.drop("payload"), "warc_heads")
    firsts = (heads.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
              .agg(F.min("record_id").alias("original"), F.count(F.lit(1)).alias("_n"))
              .filter("_n > 1 and original is not null").drop("_n"))
    # a popular payload's heads are dealt over many tasks
    revisits = salted_join(heads, firsts, "payload_digest", "record_id", "inner").filter(~F.col("original").eqNullSafe(F.col("record_id")))
    revisits = written(revisits.select("record_id", "url", "payload_digest", "original"), "warc_revisits")
    first = bitmap(revisits, KEY, 1, bits)
    known = revisits.select(*KEY).distinct()
    hit = flagged(heads.select(*KEY), first, KEY, "_hit", 1, bits).filter("_hit").drop("_hit").distinct()
    strays = written(hit.join(known, _same(hit, known), "left_anti"), "warc_strays")
    second = bitmap(strays, KEY, 2, bits)
    rows = flagged(flagged(wide, first, KEY, "_hit", 1, bits), second, KEY, "_stray", 2, bits)
    plain = rows.filter("not _hit").drop("_hit", "_stray")
    some = rows.filter("_hit and _stray").drop("_hit", "_stray")
    return plain.unionByName(some.join(strays, _same(some, strays), "left_semi")), revisits


def _record(kind: str, body: Column, more: Column) -> Column:
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    return F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\n"),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("record_id").cast("string"), F.lit(">"))),
        line("WARC-Target-URI", F.regexp_replace(F.col("url"), "[\\r\\n]", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))), more,
        F.lit("Content-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(_END), body)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html",
                   min_bytes: int = MIN_BYTES, bits: int = BITS) -> None:
    """Write one record per row of ``pages`` (id, url, payload); a null payload is empty, null urls and ids are left out
    of the headers. Rows repeated with the same id and payload are all responses or all revisits, as the least id is
    their own; one id may have several payloads. Other columns are not read."""
    responses, revisits = split_records(pages, id_col, payload_col, min_bytes, bits)
    refers = F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"),
                      F.col("original").cast("string"), F.lit(">\r\n"))
    records = responses.select(_record("response", F.col("payload"), F.lit("")).alias("value")).unionByName(
        revisits.select(_record("revisit", F.lit(""), refers).alias("value")))
    records.write.option("lineSep", _END).option("compression", "gzip").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, url, refers_to, digest, payload): one row per record of the archives under ``path``."""
    end = _END.encode()

    def cut(batches):
        held, need, out = bytearray(), 0, []      # bytes not yet cut, length of the record that they begin

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=[
                "record_id", "record_type", "url", "refers_to", "digest", "payload"])

        for b in batches:
            for part in b.column(0).cast(pa.binary()).to_pylist():
                held += part + end
                while held and len(held) >= need:
                    stop = held.find(end)
                    head = held[:stop].decode()
                    fields = dict(x.split(": ", 1) for x in head.split("\r\n")[1:])
                    need = stop + 2 * len(end) + int(fields["Content-Length"])
                    if len(held) < need:
                        break
                    bare = lambda k: fields[k][10:-1] if k in fields else None
                    out.append((bare("WARC-Record-ID"), fields["WARC-Type"], fields.get("WARC-Target-URI"),
                                bare("WARC-Refers-To"), fields["WARC-Payload-Digest"].removeprefix("sha256:"),
                                held[stop + len(end):need - len(end)].decode()))
                    del held[:need]
                    need = 0
                if len(out) >= 256:
                    yield batch()
                    out.clear()
        if held:
            raise ValueError("an archive ends within a record")
        if out:
            yield batch()

    return spark.read.option("lineSep", _END).text(path).mapInArrow(cut, RECORDS)


def resolve(records: DataFrame) -> DataFrame:
    """Headers of all records; a revisit gets size and digest from the response that it refers to, by id and digest."""
    heads = written(records.select(
        F.col("record_id").cast("long").alias("page_id"), "record_type", F.col("refers_to").cast("long").alias("refers_to"), "digest",
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")), "warc_headers")
    responses = heads.filter("record_type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    wanted = heads.filter("record_type = 'revisit'").select("page_id", F.col("refers_to").alias("_of"), "digest")
    # the record referred to has the id and the digest of the revisit's header
    asked = wanted.select(F.col("_of").alias("page_id"), F.col("digest").alias("payload_digest")).distinct()
    originals = responses.join(asked, ["page_id", "payload_digest"], "left_semi").select(
        F.concat_ws(":", "page_id", "payload_digest").alias("_key"), "payload_bytes", "payload_digest").dropDuplicates(["_key"])
    revisits = salted_join(wanted.withColumn("_key", F.concat_ws(":", "_of", "digest")), originals, "_key", "page_id", "inner").select(
        "page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("_of").alias("refers_to"))
    return responses.unionByName(revisits)


def deduplicated(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", payload_col: str = "html",
                 min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write archives of ``pages`` to the shared folder, read them back and return one resolved header per record."""
    path = scratch_path(spark, "warc")
    write_archives(pages, path, id_col, payload_col, min_bytes)
    return resolve(read_archives(spark, path))
