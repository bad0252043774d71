"""Substring dedup: recurring phrases are confirmed, compiled into sharded Aho-Corasick automata, and located everywhere.

A window of ``WINDOW`` words is represented by its least phrase of ``PHRASE`` words (by hash), so two equal windows have
equal phrases, and a text has about one phrase per twenty words.

1. Texts become blocks of a few MB, written once (compressed, with their other columns). Each block sends its phrases,
   packed by hash bucket; a bucket answers with one bit per phrase: does another block have it?
2. Shards: a block's automaton holds the recurring phrases of its documents, so each text is streamed once through one
   automaton of bounded size, however many phrases recur in the corpus. It locates every occurrence. Windows whose phrase
   was located go, as 96-bit hashes with the least document of the block, to hash buckets, which answer with one bit per
   window: does a smaller document have it?
3. The blocks apply the answers: a word is removed if a window over it also starts in a document with a smaller id.

The answers to blocks are joined by shuffle at every size, not broadcast where they happen to be small.
What is shuffled is hashes without row overhead, and blocks; a passage that a third of all documents share is one entry
per block. No passage, document group or shard grows with the corpus.
"""
from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from mailwarden.llm.common import shuffle_partitions, written
from mailwarden.llm.words import hash_texts, mix, sliding_min, windows

WINDOW, PHRASE = 50, 8
#: Bytes of text in a block (more only for one longer text), and rows.
BLOCK, ROWS = 4 << 20, 8192
U = np.uint64
TOP = U((1 << 64) - 1)


class Block:
    """The words of a block of texts, its phrases and windows."""

    def __init__(self, texts: list, ids: list, window: int, phrase: int, buckets: int):
        self.texts, self.window, self.phrase, self.buckets = [t or b"" for t in texts], window, phrase, buckets
        self.h, self.ptr = hash_texts(self.texts)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.ptr))
        self.ids = np.array([-1 if i is None else i for i in ids], np.int64)
        self.phrases = windows(self.h, phrase)
        n = max(0, len(self.h) - window + 1)
        start = np.arange(n)
        known = np.array([i is not None for i in ids], bool)
        self.valid = (start + window <= self.ptr[self.doc[:n] + 1]) & known[self.doc[:n]] if n else np.zeros(0, bool)
        self.least = sliding_min(self.phrases, window - phrase + 1)

    def _by_bucket(self, values: np.ndarray) -> np.ndarray:
        """Order of sorted distinct values: bucket by bucket."""
        return np.argsort((mix(values) % U(self.buckets)).astype(np.int64), kind="stable")

    def bucket_cuts(self, ordered: np.ndarray) -> np.ndarray:
        return np.searchsorted((mix(ordered) % U(self.buckets)).astype(np.int64), np.arange(self.buckets + 1))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct phrases of valid windows in bucket order, and whether two documents of the block have them."""
        at = np.flatnonzero(self.valid)
        value, doc = self.least[at], self.doc[at]
        keep = np.concatenate(([True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1]))) if len(at) else np.zeros(0, bool)
        value, doc = value[keep], doc[keep]
        distinct, first, where = np.unique(value, return_index=True, return_inverse=True)
        twice = np.zeros(len(distinct), bool)
        twice[where[doc != doc[first][where]]] = True
        order = self._by_bucket(distinct)
        return distinct[order], twice[order]

    def locate(self, recurring: np.ndarray) -> np.ndarray:
        """Valid windows whose phrase is among the recurring ones, found by the block's automaton."""
        if not len(recurring):
            return np.zeros(0, np.int64)
        spaced = [b" ".join(t.split()) for t in self.texts]
        hay = b"\n".join(b" " + s + b" " for s in spaced)
        raw = np.frombuffer(hay, np.uint8)
        gap = (raw == 32) | (raw == 10)
        begin = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
        stop = np.flatnonzero(~gap[:-1] & gap[1:])                       # last byte of each word
        wanted = np.sort(recurring)
        k = np.minimum(np.searchsorted(wanted, self.phrases), len(wanted) - 1)
        inside = self.doc[:len(self.phrases)] == self.doc[self.phrase - 1:]
        hit = np.flatnonzero((wanted[k] == self.phrases) & inside)
        _, first = np.unique(self.phrases[hit], return_index=True)
        text = hay.decode("latin-1")
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for i in hit[first].tolist():                                   # one place of each phrase gives its words
            automaton.add_word(text[begin[i] - 1:stop[i + self.phrase - 1] + 2])
        automaton.make_automaton()
        ends = np.fromiter((e for e, _ in automaton.iter(text)), np.int64)
        found = np.zeros(len(self.phrases), bool)
        last = np.searchsorted(stop, ends - 1)                          # the match ends one blank after its last word
        found[last - self.phrase + 1] = True
        seen = sliding_min(np.where(found, self.phrases, TOP), self.window - self.phrase + 1)
        return np.flatnonzero(self.valid & (seen == self.least) & (seen != TOP))

    def candidates(self, recurring: np.ndarray):
        """(places, which distinct window each is, distinct hashes in bucket order, second hashes, least documents)."""
        at = self.locate(recurring)
        one, two = windows(self.h, self.window, 0)[at], windows(self.h, self.window, 1)[at].astype(np.uint32)
        key = mix(one) ^ two.astype(np.uint64)
        distinct, first, where = np.unique(key, return_index=True, return_inverse=True)
        least = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(least, where, self.ids[self.doc[at]])
        order = np.argsort((mix(one[first]) % U(self.buckets)).astype(np.int64), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return at, rank[where], one[first][order], two[first][order], least[order]


def _blocks(df: DataFrame, text_col: str, window: int, phrase: int, id_col: str, buckets: int) -> DataFrame:
    """Kind 0: a block of rows with compressed texts. Kind 1: phrases of a block in one bucket."""
    others = [c for c in df.columns if c != text_col]
    plain = df.select(F.struct(*[df[c] for c in others]).alias("row"), df[id_col].cast("long").alias("id"),
                      df[text_col].alias("text"))
    schema = f"kind int, block long, bucket int, hashes binary, sizes array<long>, ids array<long>, rows array<{plain.schema['row'].dataType.simpleString()}>, payload binary"

    def run(batches):
        from pyspark import TaskContext

        z = zstandard.ZstdCompressor(level=3)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            row_type = batch.schema.field("row").type
            texts = batch.column(2).cast(pa.binary())
            sizes = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in texts], np.int64)
            start = 0
            while start < batch.num_rows:
                total = np.cumsum(sizes[start:start + ROWS])
                end = start + max(1, int(np.searchsorted(total, BLOCK, side="right")))
                own, ids = texts.slice(start, end - start).to_pylist(), batch.column(1).slice(start, end - start)
                number += 1
                block = Block(own, ids.to_pylist(), window, phrase, buckets)
                values, _ = block.anchors()
                cut = block.bucket_cuts(values)
                rows = [(0, number, None, None, [-1 if t is None else len(t) for t in own], ids.to_pylist(),
                         z.compress(b"".join(t or b"" for t in own)))]
                rows += [(1, number, b, values[cut[b]:cut[b + 1]].tobytes(), None, None, None)
                         for b in range(buckets) if cut[b] < cut[b + 1]]
                lists = pa.ListArray.from_arrays(pa.array([0] + [end - start] * len(rows), pa.int32()),
                                                 batch.column(0).slice(start, end - start))
                lists = pa.array(lists) if len(rows) == 1 else lists
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[0], pa.int32()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.binary()),
                     pa.array(c[4], pa.list_(pa.int64())), pa.array(c[5], pa.list_(pa.int64())),
                     lists, pa.array(c[6], pa.binary())],
                    names=["kind", "block", "bucket", "hashes", "sizes", "ids", "rows", "payload"])
                start = end

    return plain.mapInArrow(run, schema)


def _texts(payload: bytes, sizes: list[int]) -> list:
    raw, out, at = zstandard.decompress(payload), [], 0
    for n in sizes:
        out.append(None if n < 0 else raw[at:at + n])
        at += max(n, 0)
    return out


def _recurring(block: Block, answers) -> np.ndarray:
    values, twice = block.anchors()
    cut = block.bucket_cuts(values)
    for a in answers or []:
        lo, hi = cut[a["bucket"]], cut[a["bucket"] + 1]
        twice[lo:hi] |= np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=hi - lo).astype(bool)
    return values[twice]


ANSWER = "block long, bucket int, bits binary"


def _phrase_bits(table: pa.Table) -> pa.Table:
    """One bit per phrase of each block: another block has it."""
    parts = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
    flat = np.concatenate(parts)
    _, where, count = np.unique(flat, return_inverse=True, return_counts=True)
    return _answers(table, parts, count[where] > 1)


def _window_bits(table: pa.Table) -> pa.Table:
    """One bit per window of each block: a smaller document of another block has it."""
    one = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
    a = np.concatenate(one)
    b = np.concatenate([np.frombuffer(x, np.uint32) for x in table["more"].to_pylist()])
    doc = np.concatenate([np.frombuffer(zstandard.decompress(x), np.int64) for x in table["docs"].to_pylist()])
    order = np.lexsort((doc, b, a))
    new = np.concatenate(([True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))) if len(a) else np.zeros(0, bool)
    least = np.empty(len(a), np.int64)
    least[order] = doc[order][new][np.cumsum(new) - 1]
    return _answers(table, one, least < doc)


def _answers(table, parts, flags) -> pa.Table:
    cut = np.cumsum([0] + [len(p) for p in parts])
    out = [(blk, bkt, np.packbits(flags[cut[i]:cut[i + 1]]).tobytes())
           for i, (blk, bkt) in enumerate(zip(table["block"].to_pylist(), table["bucket"].to_pylist())) if flags[cut[i]:cut[i + 1]].any()]
    c = list(zip(*out)) or [[], [], []]
    return pa.table([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.binary())], names=["block", "bucket", "bits"])


def _gathered(answers: DataFrame, name: str, alias: str) -> DataFrame:
    """All answers to a block in one row; their size is a bit per entry of the block."""
    return written(answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias(alias)), name)


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    phrase: int = PHRASE) -> DataFrame:
    """``df`` with the words of repeated windows cut out of the text, and n_words, n_removed and kept_sha256 added.

    Windows are judged on the input. A text without removals is returned as it is; otherwise the kept runs of the text
    are joined by a space. The digest is that of the kept words joined by one space. A null text stays null and has no
    words; an empty table gives no rows; rows that share an id are not smaller than each other; rows with a null id keep
    all words and take none from others. Columns of ``df`` named like the added ones are replaced.
    """
    df = df.drop(*[c for c in ("n_words", "n_removed", "kept_sha256") if c not in (id_col, text_col)])
    buckets = 2 * shuffle_partitions(df.sparkSession)
    table = written(_blocks(df, text_col, window, phrase, id_col, buckets), "dedup_blocks")
    blocks = table.filter("kind = 0").select("block", "sizes", "ids", "payload", "rows")
    phrase_bits = (table.filter("kind = 1").select("block", "bucket", "hashes").groupBy("bucket")
                   .applyInArrow(_phrase_bits, ANSWER))
    known = _gathered(phrase_bits, "dedup_phrases", "known")

    def send(batches):
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for number, sizes, ids, payload, answers in zip(*(c.to_pylist() for c in batch.columns)):
                block = Block(_texts(payload, sizes), ids, window, phrase, buckets)
                _, _, one, two, least = block.candidates(_recurring(block, answers))
                cut, rows = block.bucket_cuts(one), []
                for b in range(buckets):
                    if (k := slice(cut[b], cut[b + 1])).start < k.stop:
                        rows.append((number, b, one[k].tobytes(), two[k].tobytes(), z.compress(least[k].tobytes())))
                if rows:
                    c = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), *(pa.array(x, pa.binary()) for x in c[2:])],
                        names=["block", "bucket", "hashes", "more", "docs"])

    sent = (blocks.select("block", "sizes", "ids", "payload").join(known.hint("merge"), "block", "left")
            .select("block", "sizes", "ids", "payload", "known")
            .mapInArrow(send, "block long, bucket int, hashes binary, more binary, docs binary"))
    smaller = _gathered(sent.groupBy("bucket").applyInArrow(_window_bits, ANSWER), "dedup_windows", "smaller")
    shape = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.drop(text_col).schema)}, `{text_col}` string, n_words long, n_removed long, kept_sha256 string"

    def apply(batches):
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index("rows"))
            for k, (number, sizes, ids, payload, known_bits, bits) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(6)))):
                texts = _texts(payload, sizes)
                block = Block(texts, ids, window, phrase, buckets)
                at, which, one, _, least = block.candidates(_recurring(block, known_bits))
                flag, cut = np.zeros(len(one), bool), block.bucket_cuts(one)
                for a in bits or []:
                    lo, hi = cut[a["bucket"]], cut[a["bucket"] + 1]
                    flag[lo:hi] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=hi - lo).astype(bool)
                gone = at[flag[which] | (block.ids[block.doc[at]] > least[which])]
                edge = np.zeros(len(block.h) + 1, np.int64)
                np.add.at(edge, gone, 1)
                np.add.at(edge, gone + window, -1)
                removed = np.cumsum(edge[:-1]) > 0
                out = [cut_text(t, removed[block.ptr[i]:block.ptr[i + 1]]) for i, t in enumerate(texts)]
                c = list(zip(*out))
                flat = rows.slice(k, 1).flatten()
                yield pa.RecordBatch.from_arrays(
                    [*flat.flatten(), pa.array(c[0], pa.string()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()),
                     pa.array(c[3], pa.string())],
                    names=[*(f.name for f in flat.type), text_col, "n_words", "n_removed", "kept_sha256"])

    return (blocks.join(known.hint("merge"), "block", "left").join(smaller.hint("merge"), "block", "left")
            .select("block", "sizes", "ids", "payload", "known", "smaller", "rows").mapInArrow(apply, shape))


def cut_text(text: bytes | None, removed: np.ndarray):
    """(kept text, words, removed words, digest of the kept words)."""
    words = (text or b"").split()
    if not removed.any():
        return (None if text is None else text.decode("utf-8", "replace"), len(words), 0,
                hashlib.sha256(b" ".join(words)).hexdigest())
    kept = [w for w, r in zip(words, removed.tolist()) if not r]
    runs, place, at = [], 0, None
    for w, r in zip(words, removed.tolist()):
        begin = text.index(w, place)
        place = begin + len(w)
        if r:
            at = None
        elif at is None:
            runs.append([begin, place])
            at = begin
        else:
            runs[-1][1] = place
    return (b" ".join(text[a:b] for a, b in runs).decode("utf-8", "replace"), len(words), len(words) - len(kept),
            hashlib.sha256(b" ".join(kept)).hexdigest())
