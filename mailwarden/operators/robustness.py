"""Text perturbations, robustness benchmark and prediction-consistency audits.

Every random choice is a function of (seed, sample id, position), so a perturbed text does not depend on
partitioning and can be rebuilt after a lost executor. Whole texts are perturbed, row by row, no shuffle.
"""
from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from mailwarden import constants as K
from mailwarden.functions import text as X
from mailwarden.functions.hashing import MODULUS, draw, draw_unit, draws, hash32, seeded
from mailwarden.functions.text import py_round
from mailwarden.operators.metrics import classification_metrics, ranking_metrics

ATTACKS = ["homoglyph", "zero_width", "typo", "url", "combined"]
#: Bytes of text that a task perturbs at once.
PIECE = 1 << 20
AUGMENTATIONS = ["whitespace", "casing", "punctuation", "character"]


def row_start(seed: int, key: Column) -> Column:
    """Starting point of a row's draws."""
    return hash32(seeded(seed, key)) % F.lit(MODULUS)


class Points:
    """Texts as one array of code points, with the place of each in its text and the ``start`` of the text."""

    def __init__(self, texts: list[str], starts: list[int]):
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.row = np.repeat(np.arange(len(texts)), self.sizes)
        self.place = np.arange(len(self.codes)) - (np.cumsum(self.sizes) - self.sizes)[self.row]
        self.starts = np.array(starts, np.int64)

    def drawn(self, at: np.ndarray, salt: int) -> np.ndarray:
        return draws(self.starts[self.row[at]], self.place[at], salt)


def _texts(codes: np.ndarray, sizes: np.ndarray) -> list[str]:
    joined, ends = codes.astype("<u4").tobytes().decode("utf-32-le"), np.cumsum(sizes)
    return [joined[e - n:e] for n, e in zip(sizes.tolist(), ends.tolist())]


_LOOKALIKE = np.zeros(128, np.uint32)
_LOOKALIKE[[ord(c) for c in K.HOMOGLYPH_LATIN]] = [ord(c) for c in K.HOMOGLYPH_LOOKALIKE]
_MARKS = np.array([ord(z) for z in K.ZERO_WIDTH], np.uint32)
_ASCII_LETTER = np.array([chr(c).isalpha() for c in range(128)])


def _letters(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters (Unicode category L)."""
    out = _ASCII_LETTER[np.minimum(codes, 127)]
    rest = np.flatnonzero(codes > 127)
    found, which = np.unique(codes[rest], return_inverse=True)
    out[rest] = np.array([unicodedata.category(chr(c))[0] == "L" for c in found.tolist()], bool)[which]
    return out


def homoglyph(points: Points, p: float) -> np.ndarray:
    """Code points where each mapped Latin letter becomes its look-alike with probability p."""
    out = points.codes.copy()
    at = np.flatnonzero(_LOOKALIKE[np.minimum(out, 127)] > 0)
    at = at[points.drawn(at, 1) / float(MODULUS) < p]
    out[at] = _LOOKALIKE[out[at]]
    return out


def zero_width(points: Points, codes: np.ndarray, p: float) -> tuple[np.ndarray, np.ndarray]:
    """``codes`` at the places of ``points`` with, after each letter with probability p, one of the zero-width characters;
    and the new sizes of the texts."""
    at = np.flatnonzero(_letters(codes))
    at = at[points.drawn(at, 2) / float(MODULUS) < p]
    marks = _MARKS[points.drawn(at, 3) % len(_MARKS)]
    return np.insert(codes, at + 1, marks), points.sizes + np.bincount(points.row[at], minlength=len(points.sizes))


def typo(text: str, start: int, p: float) -> str:
    """Words over three characters get one adjacent swap with probability p; words are re-joined by blanks."""
    words = text.split()
    place = np.arange(len(words))
    chosen = np.flatnonzero(draws(start, place, 4) / float(MODULUS) < p)
    for i, at in zip(chosen.tolist(), draws(start, chosen, 5).tolist()):
        w = words[i]
        if len(w) > 3:
            at %= len(w) - 1
            words[i] = w[:at] + w[at + 1] + w[at] + w[at + 2:]
    return " ".join(words)


def swap_at(text: Column, at: Column) -> Column:
    """Exchange the characters at 0-based positions ``at`` and ``at + 1``."""
    return F.concat(F.substring(text, F.lit(1), at), F.substring(text, at + 2, F.lit(1)),
                    F.substring(text, at + 1, F.lit(1)), F.substring(text, at + 3, F.length(text)))


def defang(text: Column) -> Column:
    """http:// becomes hxxp://, and a dot before a short ending becomes [.] (also outside URLs)."""
    out = F.regexp_replace(text, r"(?i)https?://", "hxxp://")
    return F.regexp_replace(out, rf"(?U)\.([a-zA-Z]{{2,6}})([/{X.SPACE}]|$)", "[.]$1$2")


def perturbed(texts: list[str], starts: list[int], attacks: list[str], severity: float = 0.1) -> list[list[str]]:
    """The texts under each attack; ``combined`` chains homoglyph and zero width. Other names leave the texts unchanged."""
    points, out = Points(texts, starts), []
    swapped = homoglyph(points, severity) if {"homoglyph", "combined"} & set(attacks) else None
    for attack in attacks:
        if attack == "homoglyph":
            out.append(_texts(swapped, points.sizes))
        elif attack in ("zero_width", "combined"):
            out.append(_texts(*zero_width(points, points.codes if attack == "zero_width" else swapped, severity)))
        elif attack == "typo":
            out.append([typo(t, s, severity) for t, s in zip(texts, starts)])
        else:
            out.append(texts)
    return out


def attack_table(df: DataFrame, text: str, attacks: list[str] | None = None, severity: float = 0.1,
                 seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """(keep..., attack, text): the clean text and one row per attack; unknown names leave the text unchanged.

    Characters are drawn in numpy, pieces of ``PIECE`` characters at a time (as array expressions they were boxed one by
    one); the links are defanged in the JVM, last where attacks are combined.
    """
    names = ["clean", *(ATTACKS if attacks is None else attacks)]
    keep = keep or ["sample_id"]
    made = [a for a in dict.fromkeys(names) if a in ("homoglyph", "zero_width", "typo", "combined")]
    # bytes that are no characters, which Java shows as U+FFFD, would not reach Python
    prepared = df.select(*keep, F.make_valid_utf8(X.nz(F.col(text))).alias("_clean"), row_start(seed, F.col("sample_id")).alias("_start"))
    schema = StructType([*prepared.schema.fields[:len(keep) + 1], *(StructField(f"_{a}", StringType()) for a in made)])
    shape = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            texts, starts, first, size = batch.column(len(keep)), batch.column(len(keep) + 1), 0, 0
            for i in range(batch.num_rows):
                size += len(texts[i].as_buffer())
                if size >= PIECE or i + 1 == batch.num_rows:
                    own = texts.slice(first, i + 1 - first)
                    columns = perturbed(own.to_pylist(), starts.slice(first, i + 1 - first).to_pylist(), made, severity)
                    kept = [batch.column(c).slice(first, i + 1 - first) for c in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*kept, own, *(pa.array(c, pa.string()) for c in columns)], schema=shape)
                    first, size = i + 1, 0

    table = prepared.mapInArrow(run, schema)
    shown = {a: F.col(f"_{a}") if a in made else F.col("_clean") for a in names}
    shown |= {a: defang(shown[a]) for a in ("url", "combined") if a in shown}
    return table.select(*keep, F.inline(F.array(*[F.struct(F.lit(a).alias("attack"), shown[a].alias("text")) for a in names])))


def _insert_blank(text: Column, start: Column, j: int) -> Column:
    at = (draw(start, F.lit(j), 7) % F.greatest(F.length(text), F.lit(1))).cast("int")
    return F.concat(F.substring(text, F.lit(1), at), F.lit(" "), F.substring(text, at + 1, F.length(text)))


def _flip_case(text: Column, start: Column, changes: int) -> Column:
    n = F.greatest(F.length(text), F.lit(1))
    spots = F.array(*[((draw(start, F.lit(0), 9) + F.lit(j) * (draw(start, F.lit(1), 9) % 97 + 1)) % n).cast("int")
                      for j in range(changes)])

    def flip(chosen: Column):
        def one(c: Column, i: Column) -> Column:
            flipped = F.when(F.lower(c) == c, F.upper(c)).otherwise(F.lower(c))
            return F.when(F.array_contains(chosen, i) & c.rlike(r"\p{L}"), flipped).otherwise(c)
        return F.transform(X.code_points(text), one)
    return F.array_join(X.let(spots, flip), "")


def _punctuate(text: Column, start: Column, j: int) -> Column:
    """Half the time a mark before some blank, otherwise a trailing run of marks cut to its last one."""
    mark = F.when(draw(start, F.lit(j), 13) % 2 == 0, ".").otherwise(",")

    def add(pieces: Column) -> Column:
        blanks = F.size(pieces) - 1
        at = (draw(start, F.lit(j), 11) % F.greatest(blanks, F.lit(1))).cast("int")
        marked = F.concat(F.slice(pieces, F.lit(1), at), F.array(F.concat(F.get(pieces, at), mark)),
                          F.slice(pieces, at + 2, F.size(pieces)))
        return F.when(blanks > 0, F.array_join(marked, " ")).otherwise(text)
    added = X.let(F.split(text, " "), add)
    trimmed = F.regexp_replace(text, r"(?<![.,])[.,]*([.,])\z", "$1")
    return F.when(draw_unit(start, F.lit(j), 15) < 0.5, added).otherwise(trimmed)


def _swap_one(text: Column, start: Column, j: int) -> Column:
    n = F.length(text)
    at = (draw(start, F.lit(j), 17) % F.greatest(n, F.lit(1))).cast("int")
    usable = (n >= 3) & (at < n - 1) & F.substring(text, at + 1, F.lit(1)).rlike(r"\p{L}")
    allowed = F.lit(j) < F.greatest(F.lit(1), F.floor(n / 50))
    return F.when(usable & allowed, swap_at(text, at)).otherwise(text)


def augment(text: Column, kind: str, start: Column, intensity: int = 1) -> Column:
    """Label-preserving training-time changes."""
    if kind == "casing":
        return _flip_case(text, start, 2 * intensity)
    step = {"whitespace": _insert_blank, "punctuation": _punctuate, "character": _swap_one}.get(kind)
    if step is None:
        raise ValueError(f"unknown augmentation: {kind}")
    out = text
    for j in range(intensity):
        out = step(out, start, j)
    return F.when(F.length(text) > 0, out).otherwise(text)


def augmentation_table(df: DataFrame, text: str, seed: int = 42, intensity: int = 1,
                       kinds: list[str] | None = None) -> DataFrame:
    """(sample_id, kind, text): each row changed by one augmentation picked by its hash."""
    kinds = kinds or AUGMENTATIONS
    start = F.col("_start")
    prepared = df.select("sample_id", X.nz(F.col(text)).alias("_text"),
                         row_start(seed, F.col("sample_id")).alias("_start"))
    pick = draw(start, F.lit(0), 19) % len(kinds)
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (pick + 1).cast("int"))
    changed = F.lit(None).cast("string")
    for k in kinds:
        changed = F.when(F.col("kind") == k, augment(F.col("_text"), k, start, intensity)).otherwise(changed)
    return prepared.withColumn("kind", kind).select("sample_id", "kind", changed.alias("text"))


def injection_table(df: DataFrame, text: str, templates: list[str] | None = None,
                    keep: list[str] | None = None) -> DataFrame:
    """(keep..., attack, text): the clean text and one row per appended template."""
    templates = K.INJECTION_TEMPLATES if templates is None else templates
    base = X.nz(F.col(text))
    rows = [F.struct(F.lit("clean").alias("attack"), base.alias("text"))]
    rows += [F.struct(F.lit(f"injection_{i}").alias("attack"), F.concat(base, F.lit(" " + t)).alias("text"))
             for i, t in enumerate(templates)]
    return df.select(*(keep or ["sample_id"]), F.inline(F.array(*rows)))


def robustness_report(scored: DataFrame) -> DataFrame:
    """Per attack: roc_auc, f1, recall and the drops against the clean rows (4 decimals)."""
    m = classification_metrics(scored, ["attack"]).select("attack", "f1", "recall")
    table = m.join(ranking_metrics(scored, ["attack"]).select("attack", "roc_auc"), "attack")
    clean = table.filter("attack = 'clean'").select(F.col("roc_auc").alias("_auc"), F.col("f1").alias("_f1"),
                                                    F.lit(1).alias("_one"))
    joined = table.withColumn("_one", F.lit(1)).join(F.broadcast(clean), "_one", "left")     # one row
    return joined.select(
        "attack", py_round(F.col("roc_auc"), 4).alias("roc_auc"), py_round(F.col("f1"), 4).alias("f1"),
        py_round(F.col("recall"), 4).alias("recall"),
        py_round(F.col("_auc") - F.col("roc_auc"), 4).alias("auc_drop"),
        py_round(F.col("_f1") - F.col("f1"), 4).alias("f1_drop"))


def paired_with_clean(scored: DataFrame) -> DataFrame:
    """(sample_id, attack, p, q): the clean and the attacked probability of each email."""
    clean = scored.filter("attack = 'clean'").select("sample_id", F.col("prob").alias("p"))
    attacked = scored.filter("attack <> 'clean'").select("sample_id", "attack", F.col("prob").alias("q"))
    return attacked.join(clean, "sample_id")


def consistency_audit(scored: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Mean symmetric KL, Jensen-Shannon and squared difference between clean and attacked predictions."""
    def clamp(c: Column) -> Column:
        return F.greatest(c, F.lit(eps))

    def kl(target: Column, given: Column) -> Column:
        return target * (F.log(target) - F.log(given))

    skl, js = F.lit(0.0), F.lit(0.0)
    for p, q in ((F.col("p"), F.col("q")), (1.0 - F.col("p"), 1.0 - F.col("q"))):
        cp, cq, m = clamp(p), clamp(q), clamp((p + q) * 0.5)
        skl = skl + 0.5 * (kl(cp, cq) + kl(cq, cp))
        js = js + 0.5 * (kl(cp, m) + kl(cq, m))
    d = F.col("p") - F.col("q")
    return paired_with_clean(scored).groupBy("attack").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg(skl).alias("symmetric_kl"),
        F.avg(js).alias("js_divergence"), F.avg(d * d).alias("mse"))


def attack_success(scored: DataFrame, cut: float = 0.5) -> DataFrame:
    """Per attack: share of emails whose verdict flips, share of caught mail that escapes, mean shift."""
    was, now = F.col("p") >= cut, F.col("q") >= cut
    return paired_with_clean(scored).groupBy("attack").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.avg((was != now).cast("int")).alias("flip_rate"),
        (F.count_if(was & ~now) / F.greatest(F.count_if(was), F.lit(1))).alias("attack_success_rate"),
        F.avg(F.col("p") - F.col("q")).alias("confidence_shift"))
