"""Text, URL and feature facts, and agreement with Python's own string rules on awkward characters."""
import math
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mailwarden.functions import text as X, urls as U
from mailwarden.operators import features, scaling

ODD = ["", "    x \x1c ", "É² ①٣ Ⅷ ﬁ", "ABC Ab ÀÉ A1 ΑΒ 中文 A中", "a\tb\n\n c\r\n  \nd", "ṕ ½ ß İ", "..!? a. b!c",
       "😀 smile😀😀", "x" * 50 + "　" * 40 + "y"]


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t")).alias("o")).collect()]


def test_strip_collapse_nfkd(spark):
    assert column(spark, ODD, X.strip) == [s.strip() for s in ODD]
    assert column(spark, ODD, X.collapse) == [re.sub(r"\s+", " ", s).strip() for s in ODD]
    assert column(spark, ODD, X.nfkd) == [unicodedata.normalize("NFKD", s) for s in ODD]
    assert column(spark, [None], X.dedup_text) == [""]


def test_py_round(spark):
    values = [0.125, 1.005, -0.5, 1 / 3, 12.345678, 0.285]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(X.py_round(F.col("v"), 2)).collect()] == pytest.approx([round(v, 2) for v in values], abs=1e-9)


def test_dedup_text_facts(spark):
    assert column(spark, ["HELLO", "hello   world", "  hello  "], X.dedup_text) == ["hello", "hello world", "hello"]


def test_transformer_and_tags(spark):
    got = column(spark, ["a\x00b" + " " * 9 + "c\n\n\n\n\nd "], X.transformer_text)
    assert got == ["ab     c\n\n\nd"]
    assert column(spark, ["<b>a&nbsp;&amp;lt;</b>  x"], X.strip_tags) == ["a < x"]


def test_lexical_and_structural_match_python(spark, mail):
    rows = features.feature_table(mail(*[{"body": t} for t in ODD]), ["lexical", "structural"]).orderBy("sample_id").collect()
    for t, r in zip(ODD, rows):
        n = max(len(t), 1)
        words, lines = t.split(), t.split("\n")
        shouted = sum(w.isupper() and len(w) > 1 and w.isalpha() for w in words)
        assert r["email_length"] == len(t) and r["word_count"] == len(words)
        assert r["sentence_count"] == max(1, sum(bool(s.strip()) for s in re.split(r"[.!?]+", t)))
        assert r["uppercase_ratio"] == pytest.approx(sum(c.isupper() for c in t) / n)
        assert r["digit_ratio"] == pytest.approx(sum(c.isdigit() for c in t) / n)
        assert r["punctuation_ratio"] == pytest.approx(sum(not c.isalnum() and not c.isspace() for c in t) / n)
        assert r["whitespace_ratio"] == pytest.approx(sum(c.isspace() for c in t) / n)
        assert r["line_count"] == len(lines)
        assert r["empty_line_ratio"] == pytest.approx(sum(not x.strip() for x in lines) / len(lines))
        assert r["avg_line_length"] == pytest.approx(sum(map(len, lines)) / len(lines))
        assert r["all_caps_word_count"] == shouted, t


def test_fixture_facts(mail):
    t = features.feature_table(mail(
        {"body": "Hello World! This is urgent."}, {"body": "This is urgent, act now immediately"},
        {"body": "Please enter your password and login"}, {"body": "Line 1\nLine 2\n\nLine 4"},
        {"body": "THIS IS VERY IMPORTANT"}, {"body": None}, {"body": "call 555-123-4567 or a@b.com $5 #1"})).orderBy("sample_id").collect()
    assert len(t[0].asDict()) == 53
    assert (t[0]["word_count"], t[0]["exclamation_count"]) == (5, 1)
    assert t[1]["urgency_lexicon_count"] >= 2 and t[2]["credential_request_lexicon_count"] >= 2
    assert t[3]["line_count"] == 4 and t[3]["empty_line_ratio"] > 0
    assert t[4]["all_caps_word_count"] >= 3
    assert t[5]["email_length"] == 0 and t[5]["word_count"] == 0 and t[5]["html_presence"] == 0 and t[5]["text_html_ratio"] == 1.0
    assert (t[6]["phone_numbers_in_body"], t[6]["email_addresses_in_body"], t[6]["dollar_sign_count"]) == (1, 1, 1)


def test_headers(mail):
    r = features.feature_table(mail(
        {"sender": "user@gmail.com"}, {"sender": None}, {"sender": "ceo@bigcorp.com", "receiver": "x@other.org"},
        {"sender": '"pay@paypal.com" <u@evil.net>', "receiver": "a@evil.net"}), ["header"]).orderBy("sample_id").collect()
    assert (r[0]["sender_present"], r[0]["free_email_provider"]) == (1, 1)
    assert r[1]["sender_present"] == 0
    assert (r[2]["free_email_provider"], r[2]["sender_receiver_mismatch"]) == (0, 1)
    # the sender's domain is that of the first address, which here is the one in the display name
    assert (r[3]["display_name_email_mismatch"], r[3]["sender_receiver_mismatch"]) == (0, 1)


def test_urls(spark, mail):
    assert column(spark, ["Visit http://example.com and https://test.org/page"], U.extract_urls) == [
        ["http://example.com", "https://test.org/page"]]
    t = features.url_table(mail({"body": "http://u:p@Example.com:80/a;v/b;w?q=1#f www.x.com/?u=http://y http://192.168.1.1/phish http://[bad"}))
    r = {x["position"]: x for x in t.collect()}
    assert (r[0]["host_length"], r[0]["path_length"], r[0]["query_length"]) == (11, len("/a;v/b"), 3)
    assert (r[1]["host_length"], r[1]["path_length"], r[1]["query_length"]) == (0, len("www.x.com/"), len("u=http://y"))
    assert r[2]["is_ipv4"] == 1 and r[2]["subdomains"] == 2
    assert len(r) == 3
    counts = features.feature_table(mail({"body": "http://[bad http://a.b"}), ["url"]).first()
    assert counts["url_count"] == 2 and counts["total_url_chars"] == len("http://a.b")


def test_entropy(spark):
    values = ["aaaaaa", "abcdef", "", "aab/..é😀😀"]
    want = [round(-sum(c / len(v) * math.log2(c / len(v)) for c in Counter(v).values()), 4) if v else 0.0 for v in values]
    assert column(spark, values, U.entropy) == pytest.approx(want)


def test_html(mail):
    body = '<A href="https://x.y">k</a><form><p style="display : none;opacity:0">t</p></form><img src=\'http://z\'>'
    r = features.feature_table(mail({"body": body}), ["html"]).first()
    assert (r["html_presence"], r["anchor_count"], r["form_count"], r["hidden_text_indicators"], r["external_resource_count"]) == (1, 1, 1, 2, 2)


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (float("nan"), 5.0), (float("inf"), 5.0)], "a double, b double")
    assert [r[0] for r in scaling.finite(df, ["a"]).collect()] == [1.0, 3.0, 0.0, 1e6]
    params = scaling.fit_scaler(df.limit(2), ["a", "b"])
    out = scaling.apply_scaler(df.limit(2), params).collect()
    assert sorted(r["a"] for r in out) == [-1.0, 1.0] and all(r["b"] == 0.0 for r in out)
    with pytest.raises(ValueError):
        scaling.fit_scaler(df, ["a"], "other")
    with pytest.raises(RuntimeError):
        scaling.apply_scaler(df, scaling.fit_scaler(df.limit(0), ["a"]))


def test_digits_and_words_are_matched_in_two_steps(spark):
    """Digits and words are the characters of their full classes; most characters are settled by an ASCII range first."""
    codes = [c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(chr(c),) for c in codes], "c string")
    wrong = df.filter(F.col("c").rlike(X.DIGIT) != F.col("c").rlike(f"[{X.DIGIT_CLASS}]"))
    assert wrong.isEmpty()
    assert df.filter(F.col("c").rlike(X.WORD) != F.col("c").rlike(rf"(?U)[^{X.SPACE}]+")).isEmpty()
    assert X.WORD.startswith("(?U)[!-~")
