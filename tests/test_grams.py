"""Counting n-grams in tasks: the same totals and rows as one Counter per text."""
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mailwarden.operators import grams, vectorize

TEXTS = ["Win money now", "win  Money\tlater  x", "", None, "a\x00b\x00 zz\x00", "日本語テキスト 日本", "😀😀😀😀 ok", "x y z",
         "one\ntwo\nthree one two", "ÀÉ é_1 ab ab ab"] * 2
BOTH = [(grams.words, vectorize.word_terms), (grams.chars, vectorize.char_terms)]


@pytest.fixture
def mails(spark):
    """Repeated and null ids; texts of no words, with NUL and beyond the basic plane."""
    rows = [(f"s{i % 7}" if i % 9 else None, "ab"[i % 2], t) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "sample_id string, dataset_id string, t string")


def tuples(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("own, plain", BOTH)
def test_totals_equal_those_of_exploded_terms(mails, own, plain):
    counts = vectorize.term_counts(mails, plain(F.col("t"))).groupBy("term").agg(F.count(F.lit(1)), F.sum("tf"))
    assert tuples(grams.term_totals(mails, own(F.col("t")))) == tuples(counts)
    assert (tuples(grams.term_totals(mails, own(F.col("t")), "dataset_id"))
            == tuples(vectorize.source_terms(mails, plain(F.col("t")))))


@pytest.mark.parametrize("limit", [1 << 62, 1 << 12, 1])
@pytest.mark.parametrize("is_chars", [True, False])
def test_numbers_that_do_not_fit_are_split(monkeypatch, limit, is_chars):
    """Texts of very many symbols are counted in smaller pieces, at last one by one."""
    monkeypatch.setattr(grams, "NUMBERS", limit)
    texts = [[" ab \n cab "], [" ab ", " ba "], [""]] if is_chars else [["ab cab ab"], ["ab", "ba ab"], [""]]
    weight, got = np.array([1, 3, 2]), Counter()
    for terms, df, cf in grams._totals(texts, weight, grams.Grams(None, 1, 2, is_chars)):
        for term, d, c in zip(terms, df, cf):
            got[term] += np.array([d, c])
    expected = Counter()
    for text, w in zip(texts, weight):
        found = Counter()
        for part in text:
            for row in part.split("\n") if is_chars else [part.split()]:
                found.update(("" if is_chars else " ").join(row[i:i + n]) for n in (1, 2) for i in range(len(row) - n + 1))
        for term, tf in found.items():
            expected[term] += np.array([w, w * tf])
    assert {k: tuple(v) for k, v in got.items()} == {k: tuple(v) for k, v in expected.items()}


@pytest.mark.parametrize("table", [1 << 24, 0])
@pytest.mark.parametrize("own, plain", BOTH)
def test_rows_hold_the_vocabulary_of_each_text(mails, monkeypatch, own, plain, table):
    terms = own(F.col("t"))
    fitted = vectorize.fit(mails, terms, 1, 40)
    vocabulary = {r["term"]: (r["idx"], r["idf"]) for r in fitted.collect()}
    monkeypatch.setattr(grams, "TABLE", table)
    tree = grams.Tree(list(vocabulary), [i for i, _ in vocabulary.values()], terms.chars)
    assert (tree.table is None) == (table == 0)
    counts = {}
    for r in vectorize.term_counts(mails, plain(F.col("t"))).collect():
        counts.setdefault(r["sample_id"], {})[r["term"]] = r["tf"]
    rows = grams.term_rows(mails, [(terms, fitted)]).collect()
    assert len(rows) == mails.select("sample_id").distinct().count()
    for r in rows:
        raw = {vocabulary[t][0]: (1 + math.log(tf)) * vocabulary[t][1] for t, tf in counts.get(r["sample_id"], {}).items() if t in vocabulary}
        length = math.sqrt(sum(v * v for v in raw.values()))
        assert r["idx"] == sorted(raw) and r["val"] == pytest.approx([raw[i] / length for i in sorted(raw)])
    texts = [[t] for t in mails.select(terms.text).toPandas().iloc[:, 0]]
    a = tree.found(texts, terms)
    monkeypatch.setattr(grams, "TABLE", 1 << 24)
    b = grams.Tree(list(vocabulary), [i for i, _ in vocabulary.values()], terms.chars).found(texts, terms)
    assert all((x == y).all() for x, y in zip(a, b)) and len(a[0])


@pytest.mark.parametrize("query, step, times", [("combined_text", "Normalizer", 2), ("shingles", "regexp_extract_all", 1)])
def test_texts_are_computed_once(spark, sf, query, step, times):
    """Cleaning and shingling are most of the work: each text goes through them once."""
    plan = entry.queries()[query](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(step) == times


def test_distinct_shingles_are_hashed_once(spark, monkeypatch):
    """The md5 hashes are those of Spark, and a shingle of many texts is hashed once a batch."""
    from mailwarden.functions.hashing import hash32
    from mailwarden.operators import neardup

    texts = ["win money now", "win money", "日本語テキスト", "😀😀😀😀ab", "abcde", "four", ""]
    df = spark.createDataFrame([(t,) for t in texts], "body string")
    expected = [r[0] for r in df.select(F.transform(neardup.shingles(F.col("body")), hash32)).collect()]
    assert [h.tolist() for h in neardup.md5_hashes(texts, 5)] == expected
    calls, md5 = [], neardup.hashlib.md5
    monkeypatch.setattr(neardup.hashlib, "md5", lambda *a, **k: calls.append(a) or md5(*a, **k))
    neardup.md5_hashes(["win money now"] * 9, 5)
    assert len(calls) < 13 + 5


def test_strip_removes_every_white_space(spark):
    """All 29 characters that Python counts, and nothing else; runs that are one blank already stay."""
    from mailwarden.functions import text as X

    spaces = [chr(i) for i in range(0x110000) if chr(i).isspace()]
    rows = [f"{a}x{a}{b} y{b}" for a, b in zip(spaces, spaces[1:])] + ["​x﻿", "  ", "", None]
    got = spark.createDataFrame([(r,) for r in rows], "c string").select("c", X.strip(F.col("c")), X.collapse(F.col("c"))).collect()
    assert all(r[1] == (r["c"] and r["c"].strip()) and r[2] == (r["c"] and " ".join(r["c"].split())) for r in got)
