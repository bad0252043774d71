"""URL extraction and per-URL measures, as expressions over one string or an array of strings."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from mailwarden.constants import SUSPICIOUS_URL_TOKENS
from mailwarden.functions.text import DIGIT, SPACE, count, let, nz, py_round, terms_present

URL = rf"(?iU)(?:https?://|www\.)[^{SPACE}<>\"')\]]+"
AUDIT_URL = rf"(?iU)https?://[^{SPACE}<>\"']+|www\.[^{SPACE}<>\"']+"


def extract_urls(c: Column) -> Column:
    """All URLs in order, repeats kept. Nothing is ever resolved."""
    return F.regexp_extract_all(nz(c), F.lit(URL), F.lit(0))


def entropy(u: Column) -> Column:
    """Shannon entropy in bits over the characters of a string, 4 decimals.

    Sorting the characters turns equal ones into runs; every run is found by one regex pass, so the
    cost is that of the sort and not distinct-characters times length.
    """
    chars = F.array_join(F.array_sort(F.split(u, "")), "")
    runs = F.regexp_extract_all(chars, F.lit(r"(?s)(.)\1*"), F.lit(0))
    bits = let(F.greatest(F.length(u), F.lit(1)).cast("double"), lambda n: F.aggregate(
        runs, F.lit(0.0), lambda acc, r: acc - (F.length(r) / n) * F.log2(F.length(r) / n)))
    return F.when(F.length(u) == 0, F.lit(0.0)).otherwise(py_round(bits, 4) + F.lit(0.0))


def _parts(u: Column) -> Column:
    """Struct (host, path, query) of one URL."""
    full = F.when(F.contains(u, F.lit("://")), u).otherwise(F.concat(F.lit("http://"), u))

    def split(rest: Column) -> Column:
        authority = F.regexp_extract(rest, r"^//([^/?#]*)", 1)
        tail = F.regexp_replace(rest, r"^//[^/?#]*", "")
        return F.struct(
            F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":.*$", "")).alias("host"),
            # a ";" in the last path segment opens parameters, which are not part of the path
            F.regexp_replace(F.regexp_extract(tail, r"(?s)^[^?#]*", 0), r"(?s);[^/]*$", "").alias("path"),
            F.regexp_extract(tail, r"(?s)^[^?#]*\?([^#]*)", 1).alias("query"))
    return let(F.regexp_replace(full, r"^[A-Za-z][A-Za-z0-9+.\-]*:", ""), split)


def measures(u: Column) -> Column:
    """Struct of the lexical measures of one URL."""
    length = F.length(u)

    def measure(p: Column) -> Column:
        return F.struct(
            length.alias("url_length"),
            F.length(p["host"]).alias("host_length"),
            F.length(p["path"]).alias("path_length"),
            F.length(p["query"]).alias("query_length"),
            F.greatest(F.lit(0), F.size(F.split(p["host"], r"\.")) - 2).alias("subdomains"),
            (count(u, DIGIT) / F.greatest(length, F.lit(1))).alias("digit_ratio"),
            (count(u, r"[^\p{L}\p{N}./_:\-]") / F.greatest(length, F.lit(1))).alias("special_ratio"),
            count(u, "%").alias("percent_count"),
            p["host"].rlike(r"(?U)^(\d{1,3}\.){3}\d{1,3}$").cast("int").alias("is_ipv4"),
            F.contains(p["host"], F.lit("xn--")).cast("int").alias("is_punycode"),
            let(F.lower(u), lambda x: terms_present(x, SUSPICIOUS_URL_TOKENS)).alias("suspicious_tokens"),
            entropy(u).alias("entropy"),
        )
    return let(_parts(u), measure)


def parsable(u: Column) -> Column:
    """False for the malformation URL text can carry past extraction: an unclosed ``[`` host."""
    return ~u.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?[^/?#]*\[")
