"""Registry of queries and helpers for writing their SQL twins."""
from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from mailwarden.functions.text import py_round
from mailwarden.sources import tables as A

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function, with its SQL twin when there is one."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round doubles for comparison; summation order differs between engines in the last bits."""
    return df.select(*[(py_round(F.col(c).cast("double"), digits) + F.lit(0.0)).alias(c) if c in columns
                       else F.col(c) for c in df.columns])


# --- DuckDB text ------------------------------------------------------------------------------
def ctes(*names: str, recursive: bool = False, **extra: str) -> str:
    """WITH clause naming the adapters (and extra sub-queries) used by a twin."""
    adapters = {
        "mail_docs": A.MAIL_DOCS, "mail_pages": A.MAIL_PAGES, "mail_threads": A.MAIL_THREADS,
        "predictions": A.predictions_sql("duckdb"), "raw_corpus": A.raw_corpus_sql("duckdb"),
        "broken_docs": A.BROKEN_DOCS,
    }
    parts = [f"{n} AS MATERIALIZED ({adapters[n]})" for n in names]
    parts += [f"{n} AS ({q})" for n, q in extra.items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"


def rnd(expr: str, digits: int = 6) -> str:
    """Half-even rounding on the binary value."""
    s = f"1e{digits}"
    return f"(round_even(({expr})::DOUBLE * {s}, 0) / {s} + 0.0::DOUBLE)"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '^\s+', ''), '\s+$', '')"


def collapse(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def nfkd(c: str) -> str:
    """Decomposition of the Latin letters with marks (all the non-ASCII letters of the test tables)."""
    for cp in range(0xA0, 0x180):
        d = unicodedata.normalize("NFKD", chr(cp))
        if d != chr(cp):
            c = f"replace({c}, {lit(chr(cp))}, {lit(d)})"
    return c


def hash32(expr: str) -> str:
    return A.hash32_sql(expr, "duckdb")


def unit(expr: str) -> str:
    return f"({hash32(expr)} / 4294967296.0::DOUBLE)"


def side(key: str, salt: str = "42:") -> str:
    """Split of a key."""
    u = unit(f"'{salt}' || {key}")
    return f"CASE WHEN {u} < 0.15 THEN 'test' WHEN {u} < 0.3 THEN 'val' ELSE 'train' END"


def count(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, {lit(pattern)}))"


def present(c: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"contains({c}, {lit(t)})::INT" for t in terms) + ")"
