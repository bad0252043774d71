"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into words (blanks become U+2581; a word is such marks and what follows, and no piece of the vocabulary
goes beyond one). The distinct words explode into substrings no longer than the longest piece, an equi-join with the
piece table keeps those that are pieces, and the edges are grouped by word. A higher-order aggregate folds each word's
lattice. Encoded words are joined back to their places and gathered per text.

The fold depends on the model. A unigram model's best path is the Viterbi path (``viterbi``). The public model here is a
BPE model, whose scores are merge ranks; its encoding is not a best path, and a Viterbi fold over them gives other ids
than the library. For it the fold replays the merges on the lattice (``merges``): the edge of best rank whose two halves
meet is taken, leftmost first, until none is left. Characters of no piece become byte pieces. Words beyond ``LONG``
characters are folded by the same rule in an Arrow function, as the fold's steps grow with the square of the length.
"""
from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mailwarden.llm.common import written

MARK, LONG = "▁", 40


def pieces_of(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(piece, id, score) of a model file: a table of fixed size."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    rows = [(model.id_to_piece(i), i, float(model.get_score(i)), model.is_byte(i)) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return spark.createDataFrame(rows, "piece string, id int, score double, byte boolean")


def words_of(text: Column) -> Column:
    marked = F.concat(F.lit(MARK), F.replace(text, F.lit(" "), F.lit(MARK)))
    return F.when(F.length(text) > 0, F.regexp_extract_all(marked, F.lit(f"({MARK}+[^{MARK}]*)"), 1))


def lattice(words: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """``words`` (word) with edges: a map from start * 1000 + end to (score, id)."""
    n = F.char_length("word")
    spans = words.select("word", F.explode(F.sequence(F.lit(0), n - 1)).alias("s")).select(
        "word", "s", F.explode(F.sequence(F.col("s") + 1, F.least(F.col("s") + longest, n))).alias("e"))
    # the piece table has as many rows as the model, whatever the size of the texts
    edges = spans.withColumn("piece", F.expr("substring(word, s + 1, e - s)")).join(F.broadcast(table), "piece", "left")
    edges = edges.filter("id is not null or e = 1")              # the first character keeps words without any piece
    return edges.groupBy("word").agg(F.map_from_entries(F.collect_list(F.when(F.col("id").isNotNull(), F.struct(
        (F.col("s") * 1000 + F.col("e")).alias("k"), F.struct("score", "id").alias("v"))))).alias("edges"))


#: Places of the cuts of a word after all merges.
MERGES = """aggregate(sequence(1, char_length(word)), sequence(0, char_length(word)), (cut, step) ->
    CASE WHEN size(cut) < 3 THEN cut ELSE
    aggregate(array(array_min(transform(filter(sequence(0, size(cut) - 3), i -> map_contains_key(edges, cut[i] * 1000 + cut[i + 2])),
        i -> named_struct('rank', -edges[cut[i] * 1000 + cut[i + 2]].score, 'i', i)))), cut, (c, best) ->
        CASE WHEN best IS NULL THEN c ELSE concat(slice(c, 1, best.i + 1), slice(c, best.i + 3, size(c))) END) END)"""
#: Best path: per end the best (score, cuts) over the edges that end there; a character of no piece costs the worst score.
VITERBI = """aggregate(sequence(1, char_length(word)), array(named_struct('score', 0D, 'cut', array(0))), (best, e) -> concat(best, array(
    array_max(transform(filter(sequence(greatest(0, e - {longest}), e - 1), s -> map_contains_key(edges, s * 1000 + e) OR s = e - 1),
    s -> named_struct('score', best[s].score + coalesce(edges[s * 1000 + e].score, {unknown}D), 'cut', concat(best[s].cut, array(e))))))),
    best -> element_at(best, -1).cut)"""
IDS = """flatten(transform(sequence(0, size(cut) - 2), i -> CASE WHEN map_contains_key(edges, cut[i] * 1000 + cut[i + 1])
    THEN array(edges[cut[i] * 1000 + cut[i + 1]].id) ELSE transform(sequence(1, octet_length(substring(word, cut[i] + 1, cut[i + 1] - cut[i]))),
    k -> CAST(conv(substring(hex(encode(substring(word, cut[i] + 1, cut[i + 1] - cut[i]), 'UTF-8')), 2 * k - 1, 2), 16, 10) AS INT) + {byte}) END))"""


def fold_long(word: str, ranks: dict, byte: int) -> list[int]:
    """The merges of one long word with a queue: the same ids as ``MERGES``."""
    n = len(word)
    after, before, end, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    queue = []

    def offer(i):
        j = after[i]
        if i >= 0 and j < n and (r := ranks.get(word[i:end[j]])) is not None:
            heapq.heappush(queue, (r[0], i, end[j]))

    for i in range(n):
        offer(i)
    while queue:
        _, i, e = heapq.heappop(queue)
        if not alive[i] or after[i] >= n or end[after[i]] != e:
            continue
        j = after[i]
        alive[j], end[i], after[i] = False, e, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        piece = ranks.get(word[i:end[i]])
        out += [piece[1]] if piece else [byte + b for b in word[i:end[i]].encode()]
        i = after[i]
    return out


def encode_words(words: DataFrame, table: DataFrame, kind: str = "bpe", long: int = LONG) -> DataFrame:
    """``words`` (distinct word) with ids."""
    plain = table.filter("not byte").select("piece", "id", "score")
    facts = table.agg(F.max(F.when(~F.col("byte"), F.char_length("piece"))), F.min("score"), F.min(F.when(F.col("byte"), F.col("id")))).first()
    longest, byte = facts[0] or 1, facts[2] or 0
    cut = MERGES if kind == "bpe" else VITERBI.format(longest=longest, unknown=facts[1] - 10)
    short = lattice(words.filter(F.char_length("word") <= long) if kind == "bpe" else words, plain, longest)
    # written, as the optimizer would otherwise put the whole fold in each place that names its result
    out = written(short.withColumn("cut", F.expr(cut)), "lattice_cuts").select("word", F.expr(IDS.format(byte=byte)).alias("ids"))
    if kind != "bpe":
        return out
    ranks = {r["piece"]: (-r["score"], r["id"]) for r in plain.collect()}       # the piece table, of fixed size

    @F.pandas_udf("array<int>")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda w: fold_long(w, ranks, byte))

    return out.unionByName(words.filter(F.char_length("word") > long).select("word", fold("word").alias("ids")))


def encode(df: DataFrame, text_col: str = "text", table: DataFrame | None = None, kind: str = "bpe", long: int = LONG) -> DataFrame:
    """``df`` with ids (array<int>), in no order.

    A null text has null ids, an empty one none. Rows are told apart by a number of their own, so repeated rows, null
    keys and columns of any name are fine; a column named ids is replaced.
    """
    table = table if table is not None else pieces_of(df.sparkSession)
    own = [c for c in df.columns if c != "ids"]
    rows = written(df.select(F.struct(*[df[c] for c in own]).alias("row"), words_of(df[text_col]).alias("words"),
                             F.monotonically_increasing_id().alias("n")), "lattice_rows")
    places = rows.select("n", F.posexplode("words").alias("pos", "word"))
    known = written(encode_words(places.select("word").distinct(), table, kind, long), "lattice_words")
    # frequent words: both sides are plain exchanges, so that the adaptive join splits them
    found = places.join(known.hint("merge"), "word").groupBy("n").agg(F.collect_list(F.struct("pos", "ids")).alias("found"))
    ids = F.when(F.col("words").isNotNull(), F.expr("flatten(transform(array_sort(found), x -> x.ids))"))
    empty = F.when(F.col(f"row.{text_col}").isNotNull(), F.array().cast("array<int>"))
    return (rows.join(found.hint("merge"), "n", "left").select("row.*", F.coalesce(ids, empty).alias("ids")))


def decode(df: DataFrame, ids_col: str = "ids", table: DataFrame | None = None) -> DataFrame:
    """``df`` with ``decoded``: the bytes of the pieces in order, marks as blanks, without the first. Null ids give null."""
    table = table if table is not None else pieces_of(df.sparkSession)
    raw = {r["id"]: bytes([int(r["piece"][3:5], 16)]) if r["byte"] else r["piece"].replace(MARK, " ").encode()
           for r in table.collect()}                                            # the piece table, of fixed size

    @F.pandas_udf("string")
    def join(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else b"".join(map(raw.__getitem__, x.tolist())).decode("utf-8", "replace")[1:])

    return df.withColumn("decoded", join(F.col(ids_col)))
