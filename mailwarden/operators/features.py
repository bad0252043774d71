"""The 52-column security feature table.

One projection computes everything. URL measures need an array per row, so that array is built
once in an inner projection; every other feature is a regex count or a length, which keeps the
outer projection inside whole-stage codegen. There is no shuffle and no Python.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailwarden import constants as K
from mailwarden.functions import text as X
from mailwarden.functions import urls as U

S = X.SPACE
LEXICAL = [
    "email_length", "subject_length", "word_count", "sentence_count", "uppercase_ratio", "digit_ratio",
    "punctuation_ratio", "exclamation_count", "question_count", "urgency_lexicon_count",
    "credential_request_lexicon_count", "financial_action_lexicon_count", "call_to_action_count",
]
STRUCTURAL = [
    "line_count", "empty_line_ratio", "avg_line_length", "whitespace_ratio", "tab_count", "dollar_sign_count",
    "at_sign_count", "hash_count", "all_caps_word_count", "all_caps_word_ratio", "email_addresses_in_body",
    "phone_numbers_in_body",
]
URL = [
    "url_count", "total_url_chars", "mean_url_length", "max_url_length", "hostname_length_mean",
    "path_length_mean", "query_length_mean", "num_subdomains_mean", "digit_ratio_url", "special_char_ratio_url",
    "percent_encoding_count", "ip_address_hostname", "punycode_indicator", "suspicious_token_count",
    "url_entropy_mean",
]
HEADER = [
    "sender_present", "sender_domain_length", "free_email_provider", "display_name_email_mismatch",
    "sender_receiver_mismatch", "receiver_present",
]
HTML = [
    "html_presence", "text_html_ratio", "anchor_count", "form_count", "hidden_text_indicators",
    "external_resource_count",
]
FEATURE_GROUPS = {"lexical": LEXICAL, "structural": STRUCTURAL, "url": URL, "header": HEADER, "html": HTML}
FEATURES = LEXICAL + STRUCTURAL + URL + HEADER + HTML


def _at_least_one(c: Column) -> Column:
    return F.greatest(c, F.lit(1))


def _lexical(subject: Column, body: Column) -> dict[str, Column]:
    chars = _at_least_one(F.length(body))
    haystack = F.lower(F.when(subject != "", F.concat(subject, F.lit(" "), body)).otherwise(body))
    return {
        "email_length": F.length(body),
        "subject_length": F.length(subject),
        "word_count": X.count(body, X.WORD),
        # a sentence starts at the first visible character after a terminator
        "sentence_count": _at_least_one(X.count(body, rf"(?U)[^{S}.!?][^.!?]*")),
        "uppercase_ratio": X.count(body, r"\p{IsUppercase}") / chars,
        "digit_ratio": X.count(body, X.DIGIT) / chars,
        "punctuation_ratio": X.count(body, rf"(?U)[^\p{{L}}\p{{N}}{S}]") / chars,
        "exclamation_count": X.count(body, "!"),
        "question_count": X.count(body, r"\?"),
        "urgency_lexicon_count": X.terms_present(haystack, K.URGENCY_TERMS),
        "credential_request_lexicon_count": X.terms_present(haystack, K.CREDENTIAL_TERMS),
        "financial_action_lexicon_count": X.terms_present(haystack, K.FINANCIAL_TERMS),
        "call_to_action_count": X.terms_present(haystack, K.CALL_TO_ACTION_TERMS),
    }


def _structural(body: Column) -> dict[str, Column]:
    lines = X.count(body, "\n") + 1
    visible_lines = X.count(body, rf"(?U)[^{S}][^\n]*")
    capital = r"[\p{L}&&[^\p{IsLowercase}\p{Lt}]]"
    shouted = X.count(body, rf"(?U)(?<![^{S}])(?={capital}*\p{{IsUppercase}}){capital}{{2,}}+(?![^{S}])")
    return {
        "line_count": lines,
        "empty_line_ratio": (lines - visible_lines) / lines,
        "avg_line_length": (F.length(body) - (lines - 1)) / lines,
        "whitespace_ratio": X.count(body, rf"(?U)[{S}]") / _at_least_one(F.length(body)),
        "tab_count": X.count(body, "\t"),
        "dollar_sign_count": X.count(body, r"\$"),
        "at_sign_count": X.count(body, "@"),
        "hash_count": X.count(body, "#"),
        "all_caps_word_count": shouted,
        "all_caps_word_ratio": shouted / _at_least_one(X.count(body, X.WORD)),
        "email_addresses_in_body": X.count(
            body, r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
        "phone_numbers_in_body": X.count(body, r"(?U)\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"),
    }


def _url(raw: Column, m: Column) -> dict[str, Column]:
    """``raw`` is the array of URLs, ``m`` the array of measures of the parsable ones."""
    n = F.size(m)

    def total(field: str) -> Column:
        return F.aggregate(m, F.lit(0), lambda acc, x: acc + x[field])

    def mean(field: str, digits: int) -> Column:
        s = F.aggregate(m, F.lit(0.0), lambda acc, x: acc + x[field])
        return F.when(n > 0, X.py_round(s / F.greatest(n, F.lit(1)), digits)).otherwise(F.lit(0.0))

    return {
        "url_count": F.size(raw),
        "total_url_chars": total("url_length"),
        "mean_url_length": mean("url_length", 2),
        "max_url_length": F.coalesce(F.array_max(m["url_length"]), F.lit(0)),
        "hostname_length_mean": mean("host_length", 2),
        "path_length_mean": mean("path_length", 2),
        "query_length_mean": mean("query_length", 2),
        "num_subdomains_mean": mean("subdomains", 2),
        "digit_ratio_url": mean("digit_ratio", 4),
        "special_char_ratio_url": mean("special_ratio", 4),
        "percent_encoding_count": total("percent_count"),
        "ip_address_hostname": total("is_ipv4"),
        "punycode_indicator": total("is_punycode"),
        "suspicious_token_count": total("suspicious_tokens"),
        "url_entropy_mean": mean("entropy", 4),
    }


def mail_domain(c: Column) -> Column:
    """Domain of the first address in a header, lower-cased; empty when there is none."""
    return F.lower(F.regexp_extract(X.nz(c), r"@([A-Za-z0-9.-]+\.[A-Za-z]{2,})", 1))


def _header(sender: Column, receiver: Column) -> dict[str, Column]:
    has_sender, has_receiver = ~X.is_blank(sender), ~X.is_blank(receiver)
    own, other = mail_domain(sender), mail_domain(receiver)
    shown = mail_domain(F.regexp_extract(X.strip(sender), r'(?U)^"?([^"<]+)"?\s*<', 1))
    differs = (own != "") & (other != "") & (own != other)
    return {
        "sender_present": has_sender.cast("int"),
        "sender_domain_length": F.length(own),
        "free_email_provider": own.isin(K.FREE_MAIL_DOMAINS).cast("int"),
        "display_name_email_mismatch": ((own != "") & (shown != "") & (shown != own)).cast("int"),
        "sender_receiver_mismatch": (has_sender & has_receiver & differs).cast("int"),
        "receiver_present": has_receiver.cast("int"),
    }


def _html(body: Column) -> dict[str, Column]:
    present = body.rlike(r"<[a-zA-Z][^>]*>")

    def when_html(c: Column, default) -> Column:
        return F.when(present, c).otherwise(F.lit(default))

    def total(patterns: list[str]) -> Column:
        return sum((X.count(body, p) for p in patterns), F.lit(0))

    return {
        "html_presence": present.cast("int"),
        "text_html_ratio": when_html(
            X.py_round(F.length(X.strip_tags(body)) / _at_least_one(F.length(body)), 4), 1.0),
        "anchor_count": when_html(X.count(body, r"(?iU)<a\b"), 0),
        "form_count": when_html(X.count(body, r"(?iU)<form\b"), 0),
        "hidden_text_indicators": when_html(total([f"(?iU){p}" for p in K.HIDDEN_TEXT_PATTERNS]), 0),
        "external_resource_count": when_html(
            total([rf"""(?iU){a}\s*=\s*["']https?://""" for a in K.EXTERNAL_RESOURCE_ATTRIBUTES]), 0),
    }


def feature_table(df: DataFrame, groups: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Features of the named groups (default: all 52), with ``keep`` columns in front."""
    groups = groups or list(FEATURE_GROUPS)
    keep = keep or ["sample_id"]
    subject, body, sender, receiver = (X.nz(F.col(c)) for c in ("subject", "body", "sender", "receiver"))
    if "url" in groups:
        df = df.withColumn("_urls", U.extract_urls(body))
        df = df.withColumn("_measures", F.transform(F.filter("_urls", U.parsable), U.measures))
    makers = {
        "lexical": lambda: _lexical(subject, body),
        "structural": lambda: _structural(body),
        "url": lambda: _url(F.col("_urls"), F.col("_measures")),
        "header": lambda: _header(sender, receiver),
        "html": lambda: _html(body),
    }
    columns = {name: c for g in groups for name, c in makers[g]().items()}
    return df.select(*keep, *[c.alias(name) for name, c in columns.items()])


def url_table(df: DataFrame) -> DataFrame:
    """One row per URL and position, with its measures: the exploded twin of the URL features."""
    exploded = df.select("sample_id", F.posexplode(F.filter(U.extract_urls(F.col("body")), U.parsable))
                         .alias("position", "url"))
    return exploded.select("sample_id", "position", "url", U.measures(F.col("url")).alias("m")).select(
        "sample_id", "position", "url", "m.*")
