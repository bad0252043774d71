"""Text expressions. All run inside the JVM; none is a Python UDF.

Regex classes follow Python's ``str`` predicates: white space is Java's Unicode white space
plus the four separators U+001C..U+001F, which Python also counts.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from mailwarden.constants import HTML_ENTITIES

SPACE = r"\s\x1c-\x1f"              # inside a class, under (?U)
# every character of that class
_SPACES = ("\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
           "\u2028\u2029\u202f\u205f\u3000")
# runs that are not one blank already
_RUN = rf"(?U) [{SPACE}]+|[{SPACE}&&[^ ]][{SPACE}]*"
# printable ASCII first: most characters pass one test of two bounds
WORD = rf"(?U)[!-~[^{SPACE}]]+"
# code points Python's isdigit() accepts: decimal digits plus super-/subscript, circled, ... digits
DIGIT_CLASS = (
    r"\p{Nd}\x{B2}\x{B3}\x{B9}\x{1369}-\x{1371}\x{19DA}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"
    r"\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}\x{24EA}\x{24F5}-\x{24FD}\x{24FF}"
    r"\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}"
    r"\x{11052}-\x{1105A}\x{1F100}-\x{1F10A}"
)
# the same as a class of its own: what no digit can be is ruled out by two ranges
DIGIT = rf"[[^\x00-\x2F\x3A-\xB1]&&[{DIGIT_CLASS}]]"


def nz(c: Column) -> Column:
    """Null text becomes the empty string."""
    return F.coalesce(c, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row.

    Inside a lambda, and below functions that have no code generation, Spark recomputes repeated or row-level
    expressions for every use; a one-element transform binds them to a variable instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Remove leading and trailing Unicode white space (plain ``trim`` would remove blanks only)."""
    return F.btrim(c, F.lit(_SPACES))


def collapse(c: Column) -> Column:
    """Each run of white space becomes one blank; ends are stripped."""
    return F.trim(F.regexp_replace(c, _RUN, " "))


def is_blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(rf"(?U)[^{SPACE}]")


def count(c: Column, pattern: str) -> Column:
    """Number of matches of a regex; stays inside whole-stage codegen."""
    return F.regexp_count(c, F.lit(pattern))


def py_round(c: Column, digits: int) -> Column:
    """Half-even rounding close to Python's ``round`` (Spark's rounds half-up on the decimal text).

    A product that lands on a tie by rounding (2.675 * 100) can differ from Python in the last digit.
    """
    scale = float(10 ** digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def nfkd(c: Column) -> Column:
    """Unicode compatibility decomposition.

    Spark has no normalize function, but its bundled ICU offers a static one that ``reflect``
    can call in the JVM. Pure ASCII text is its own decomposition and skips the call.
    """
    decomposed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), nz(c), F.lit(True))
    return F.when(c.rlike(r"[^\x00-\x7F]"), decomposed).otherwise(c)


def transformer_text(c: Column) -> Column:
    """Minimal cleaning: control characters out, extreme runs of blanks and newlines shortened."""
    out = F.regexp_replace(nz(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    out = F.regexp_replace(out, r"[ \t]{6,}", "     ")
    out = F.regexp_replace(out, r"\n{4,}", "\n\n\n")
    return strip(out)


def classical_text(c: Column, lowercase: bool = True, remove_urls: bool = False,
                   remove_numbers: bool = False) -> Column:
    """Normalized text for bag-of-words models."""
    out = F.regexp_replace(nfkd(nz(c)), r"[\x00-\x1f\x7f]", " ")
    if lowercase:
        out = F.lower(out)
    if remove_urls:
        for head in ("https?://", r"www\."):
            out = F.regexp_replace(out, rf"(?U){head}[^{SPACE}]+", " URL ")
    if remove_numbers:
        out = F.regexp_replace(out, r"(?U)\b\d+\b", " NUM ")
    return collapse(out)


def dedup_text(c: Column) -> Column:
    """Comparison form: NFKD, lower case, collapsed white space."""
    return collapse(F.lower(nfkd(nz(c))))


def join_subject_body(subject: Column, body: Column, separator: str) -> Column:
    """Non-blank parts, stripped and joined; blank parts vanish together with the separator."""
    # an array, so that each part is computed once: a part that is tested and then used would be computed for both
    return F.array_join(F.filter(F.array(strip(subject), strip(body)), lambda part: part != ""), separator)


def model_text(subject: Column, body: Column) -> Column:
    """Uncleaned text every trainer uses: subject, one blank, body."""
    return F.concat(nz(subject), F.lit(" "), nz(body))


def strip_tags(c: Column) -> Column:
    """Tags become blanks, the common entities are decoded in a fixed order, white space collapses."""
    out = F.regexp_replace(nz(c), r"<[^>]+>", " ")
    for entity, char in HTML_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return collapse(out)


def code_points(c: Column) -> Column:
    """Array with one entry per character."""
    return F.filter(F.split(c, ""), lambda x: x != "")


def terms_present(c: Column, terms: list[str]) -> Column:
    """How many of the terms occur in the (lower-cased) text; each counts once."""
    return sum((F.contains(c, F.lit(t)).cast("int") for t in terms), F.lit(0))
