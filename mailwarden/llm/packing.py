"""Packing: concatenate and cut. Token totals of partitions become global offsets; fixed windows cut the stream.

Pass one tokenizes each text once and writes (ids, tokens before it in its partition) to the shared folder; the totals of
the partitions, one number each, are summed up to partition offsets. Pass two reads that table, adds the offset and cuts
each document where it crosses a multiple of the window. No token is shuffled. The written table fixes the order, so a
recomputed task yields the same pieces.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mailwarden.llm.common import ROW_GROUP, pieces, written

WINDOW, END_ID = 1024, 0
IDS = "doc_id long, ids binary, doc_tokens long, part int, before long"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, boundary boolean"


class Encoder:
    """Ids of the byte-level BPE vocabulary ``byte_bpe_50k``, as little-endian unsigned 32-bit bytes.

    ``path`` is its ``byte_bpe_50k.json``; the merges are read from the rank file of the same vocabulary (``ranks``), which
    gives the same ids several times faster (a test holds them together). As in the library, names of added tokens in a
    text (the end-of-text mark) become the ids of these tokens.
    """

    def __init__(self, path: str | None = None, ranks: str | None = None):
        import base64
        import json

        import public_tokenizers
        import tiktoken

        with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            merges = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
        with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.added = set(added)
        self.bpe = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=added)

    def encode(self, text: str) -> bytes:
        return np.array(self.bpe.encode(text, allowed_special=self.added, disallowed_special=()), "<u4").tobytes()


_encoders: dict = {}


def encoder(path: str | None = None) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path=path)
    return _encoders[path]


def tokenized(df: DataFrame, id_col: str, text_col: str, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """Pass one: ids of every text with the closing id, and the tokens before it in its partition."""
    closing = np.array([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        part, before, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for rows in pieces(batches):
            out = []
            for key, text in rows:
                ids = enc.encode((text or b"").decode("utf-8", "replace")) + closing
                out.append((key, ids, len(ids) // 4, part, before))
                before += len(ids) // 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64()))],
                names=["doc_id", "ids", "doc_tokens", "part", "before"])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, IDS)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID,
         tokenizer: str | None = None) -> DataFrame:
    """One row per piece of a document within one sequence; ``boundary`` marks pieces that do not end their document.

    Every row of ``df`` is packed, repeated rows and null ids too; a null or empty text is the closing id alone. An empty
    table gives no rows. Only the last sequence can be shorter than ``window``.
    """
    ids = written(tokenized(df, id_col, text_col, end_id, tokenizer), "packed_ids", ROW_GROUP)
    # one number per partition of the scan, never one per document
    totals = ids.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect()
    offsets, total = {}, 0
    for row in sorted(totals):
        offsets[row["part"]] = total
        total += row["n"]

    def run(batches):
        for batch in batches:
            out = []
            for key, raw, n, part, before in zip(*(c.to_pylist() for c in batch.columns)):
                at, start, view = offsets[part] + before, 0, memoryview(raw)
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    length = min(n - start, window - offset)
                    out.append((key, start, length, zlib.crc32(view[4 * start:4 * (start + length)]), n, sequence, offset,
                                start + length < n))
                    start += length
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 7 + [pa.bool_()])],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "boundary"])

    return ids.mapInArrow(run, SCHEMA)
