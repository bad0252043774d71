"""Classification, ranking and calibration metrics over a prediction table.

Input: label (0/1), pred (0/1), prob in [0, 1], and any slice columns. Every function takes ``groups`` and
returns one row per slice. Counts are aggregated first; nothing is ordered before it is pre-aggregated.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from mailwarden.functions.hashing import hash32, seeded, unit
from mailwarden.operators.ranks import probability_bin, running_totals

ECE_BINS = 15


def _ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 when b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.greatest(b, F.lit(1)))


def confusion(df: DataFrame, groups: list[str]) -> DataFrame:
    y, p = F.col("label") == 1, F.col("pred") == 1
    return df.groupBy(*groups).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"),
        F.avg((F.col("prob") - F.col("label")) * (F.col("prob") - F.col("label"))).alias("brier_score"))


def with_rates(counts: DataFrame) -> DataFrame:
    """Threshold metrics from tp, fp, tn, fn. Zero denominators give 0."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    pos, neg = tp + fn, tn + fp
    f1_pos, f1_neg = _ratio(2 * tp, 2 * tp + fp + fn), _ratio(2 * tn, 2 * tn + fp + fn)
    seen_pos = (tp + fp + fn > 0).cast("int")
    seen_neg = (tn + fp + fn > 0).cast("int")
    classes = (pos > 0).cast("int") + (neg > 0).cast("int")
    spread = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return counts.withColumns({
        "accuracy": _ratio(tp + tn, pos + neg),
        "balanced_accuracy": (_ratio(tp, pos) + _ratio(tn, neg)) / F.greatest(classes, F.lit(1)),
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, pos),
        "f1": f1_pos,
        "f1_macro": (f1_pos + f1_neg) / F.greatest(seen_pos + seen_neg, F.lit(1)),
        "mcc": F.when(spread == 0, F.lit(0.0)).otherwise((tp * tn - fp * fn) / F.nullif(spread, F.lit(0.0))),
        "specificity": tn / F.greatest(neg, F.lit(1.0)),
        "fpr": fp / F.greatest(neg, F.lit(1.0)),
        "fnr": fn / F.greatest(pos, F.lit(1.0)),
    })


def classification_metrics(df: DataFrame, groups: list[str] | None = None) -> DataFrame:
    return with_rates(confusion(df, groups or []))


def threshold_curve(df: DataFrame, groups: list[str]) -> DataFrame:
    """Per distinct score: positives and negatives at it, cumulative tp / fp down to it, and the slice's totals."""
    at_score = df.groupBy(*groups, "prob").agg(
        F.sum("label").cast("bigint").alias("pos"), F.sum(1 - F.col("label")).cast("bigint").alias("neg"))
    return running_totals(at_score, groups, probability_bin(F.col("prob")), [F.col("prob").desc()],
                          {"pos": "tp", "neg": "fp"}, descending_bins=True,
                          totals={"pos": "all_pos", "neg": "all_neg"})


def ranking_metrics(df: DataFrame, groups: list[str] | None = None, fpr_budget: float = 0.005) -> DataFrame:
    """roc_auc (null with one class), pr_auc (average precision) and recall at an FPR budget."""
    made = not groups
    groups = groups or ["_all"]
    if made:
        df = df.withColumn("_all", F.lit(0))
    points = threshold_curve(df, groups)
    p, n = F.max("all_pos").cast("double"), F.max("all_neg").cast("double")
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    within = F.col("fp") <= F.col("all_neg") * fpr_budget
    out = points.groupBy(*groups).agg(
        F.when((p > 0) & (n > 0), area / F.nullif(p * n, F.lit(0.0))).alias("roc_auc"),
        F.coalesce(F.sum(F.col("pos").cast("double") * F.col("tp") / (F.col("tp") + F.col("fp")))
                   / F.nullif(p, F.lit(0.0)), F.lit(0.0)).alias("pr_auc"),
        F.coalesce(F.max(F.when(within, F.col("tp"))) / F.nullif(p, F.lit(0.0)), F.lit(0.0)).alias("recall_at_fpr"))
    return out.drop("_all") if made else out


def calibration_error(df: DataFrame, groups: list[str] | None = None, bins: int = ECE_BINS,
                      include_right: bool = False) -> DataFrame:
    """Expected calibration error over half-open bins; a score of exactly 1 falls in no bin by default."""
    groups = groups or []
    step = 1.0 / bins
    edges = [i * step for i in range(1, bins)] + [1.0]
    index = sum(((F.col("prob") >= e).cast("int") for e in edges), F.lit(0))
    if include_right:
        index = F.least(index, F.lit(bins - 1))
    binned = df.groupBy(*groups, index.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("label").alias("acc"), F.avg("prob").alias("conf"))
    gap = F.when(F.col("bin") < bins, F.col("n") * F.abs(F.col("acc") - F.col("conf")))
    return binned.groupBy(*groups).agg(
        (F.coalesce(F.sum(gap), F.lit(0.0)) / F.greatest(F.sum("n"), F.lit(1))).alias("ece"))


def all_metrics(df: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Every metric of a slice in one row."""
    if groups:
        return (classification_metrics(df, groups).join(ranking_metrics(df, groups), groups)
                .join(calibration_error(df, groups), groups))
    parts = [f(df).withColumn("_all", F.lit(0)) for f in (classification_metrics, ranking_metrics, calibration_error)]
    return parts[0].join(F.broadcast(parts[1]), "_all").join(F.broadcast(parts[2]), "_all").drop("_all")   # one row each


def coverage_risk(df: DataFrame, thresholds: tuple[float, ...] = (0.3, 0.4, 0.5, 0.6, 0.7)) -> DataFrame:
    """Selective prediction: accept rows whose uncertainty 1 - |2p - 1| is within the threshold."""
    uncertainty = 1.0 - F.abs(2.0 * F.col("prob") - 1.0)
    wrong = F.col("label") != F.col("pred")
    parts = []
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, t in enumerate(thresholds):
        kept = uncertainty <= t
        aggs += [F.count_if(kept).alias(f"k{i}"), F.count_if(kept & wrong).alias(f"w{i}")]
        parts.append(F.struct(F.lit(t).alias("threshold"), F.col(f"k{i}").alias("n_kept"),
                              F.col(f"w{i}").alias("n_wrong")))
    long = df.agg(*aggs).select("n", F.inline(F.array(*parts)))
    return long.select("threshold", "n_kept", (F.col("n_kept") / F.greatest("n", F.lit(1))).alias("coverage"),
                       _ratio(F.col("n_wrong"), F.col("n_kept")).alias("risk"))


def mcnemar(df: DataFrame, a: str, b: str) -> DataFrame:
    """Discordant counts of two prediction columns and the continuity-corrected statistic."""
    ok_a, ok_b = F.col(a) == F.col("label"), F.col(b) == F.col("label")
    counts = df.agg(F.count_if(ok_a & ~ok_b).alias("only_a"), F.count_if(~ok_a & ok_b).alias("only_b"))
    gap = F.greatest(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(0))
    return counts.withColumn("statistic", _ratio(gap * gap, F.col("only_a") + F.col("only_b")))


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """Signed-rank sums of two paired columns in [0, 1], zero differences left out, ties by mid-rank."""
    diffs = df.select((F.col(a) - F.col(b)).alias("d")).filter("d <> 0")
    at = diffs.groupBy(F.abs("d").alias("size")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("up")).withColumn("_all", F.lit(0))
    ranked = running_totals(at, ["_all"], probability_bin(F.col("size")), [F.col("size")], {"n": "upto"})
    mid = F.col("upto") - F.col("n") + (F.col("n") + 1) / 2.0
    sums = ranked.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"),
        F.coalesce(F.sum(F.col("up") * mid), F.lit(0.0)).alias("rank_sum_up"),
        F.coalesce(F.sum((F.col("n") - F.col("up")) * mid), F.lit(0.0)).alias("rank_sum_down"))
    n = F.col("n_pairs").cast("double")
    return sums.withColumn("z", F.when(n > 0, (F.col("rank_sum_up") - n * (n + 1) / 4)
                                       / F.sqrt(F.greatest(n * (n + 1) * (2 * n + 1) / 24, F.lit(1e-300)))))


def _poisson_weight(u: Column) -> Column:
    """Poisson(1) count for a uniform draw, by the cumulative distribution."""
    cdf, term = [], math.exp(-1.0)
    for k in range(1, 13):
        cdf.append((cdf[-1] if cdf else 0.0) + term)
        term /= k
    return sum(((u >= c).cast("int") for c in cdf), F.lit(0))


def bootstrap_ci(df: DataFrame, iterations: int = 1000, level: float = 0.95, blocks: int = 1024,
                 seed: int = 42) -> DataFrame:
    """Percentile intervals of accuracy, recall and f1 by a Poisson bootstrap of hash blocks.

    Rows are hashed into blocks and reduced to confusion counts first; replicates reweight the blocks. The
    replicate table has blocks x iterations rows whatever the size of the data.
    """
    block = (hash32(F.concat(F.lit("block:"), F.col("sample_id"))) % blocks).alias("block")
    per_block = confusion(df.select("label", "pred", "prob", block), ["block"]).drop("brier_score")
    reps = per_block.select("*", F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("rep"))
    w = _poisson_weight(unit(seeded(seed, F.col("rep"), F.col("block"))))
    per_rep = reps.groupBy("rep").agg(*[F.sum(F.col(c) * w).alias(c) for c in ("tp", "fp", "tn", "fn")])
    rated = with_rates(per_rep)
    tail = (1.0 - level) / 2
    out = rated.agg(*[
        F.percentile(m, F.array(F.lit(tail), F.lit(0.5), F.lit(1.0 - tail))).alias(m)
        for m in ("accuracy", "recall", "f1")])
    return out.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m)[0].alias("low"), F.col(m)[1].alias("median"),
                 F.col(m)[2].alias("high")) for m in ("accuracy", "recall", "f1")])))


def _margins(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, m, n): signed log-odds of every distinct (score, label), and its rows."""
    p = F.least(F.greatest(F.col("prob"), F.lit(1e-6)), F.lit(1.0 - 1e-6))
    signed = F.log(p / (1.0 - p)) * (2 * F.col("label") - 1)
    return df.groupBy(*keys, "prob", "label").agg(F.count(F.lit(1)).alias("n")).select(*keys, signed.alias("m"), "n")


def temperature_fit(df: DataFrame, low: float = 0.25, step: float = 0.05, count: int = 96) -> DataFrame:
    """Temperature with the smallest log loss on a grid, in one pass: one sum per grid point."""
    grid = [round(low + step * i, 10) for i in range(count)]
    distinct = _margins(df, [])
    loss = [F.struct((F.sum(F.log1p(F.exp(-F.col("m") / t)) * F.col("n")) / F.sum("n")).alias("nll"),
                     F.lit(t).alias("t")) for t in grid]
    at_one = F.sum(F.log1p(F.exp(-F.col("m"))) * F.col("n")) / F.sum("n")
    best = distinct.agg(F.array_min(F.array(*loss)).alias("best"), at_one.alias("nll_before"))
    return best.select(F.col("best.t").alias("temperature"), "nll_before", F.col("best.nll").alias("nll_after"))


def temperature_report(df: DataFrame, fitted: DataFrame, keys: list[str]) -> DataFrame:
    """Per slice: log loss as it is and at the fitted temperature (``fitted`` has one row)."""
    rows = _margins(df, keys).withColumn("_k", F.lit(1)).join(F.broadcast(fitted.withColumn("_k", F.lit(1))), "_k")
    loss = lambda t: F.sum(F.log1p(F.exp(-F.col("m") / t)) * F.col("n")) / F.sum("n")
    return rows.groupBy(*keys, "temperature").agg(loss(F.lit(1.0)).alias("nll_before"),
                                                  loss(F.col("temperature")).alias("nll_after"))


def apply_temperature(prob: Column, temperature: float) -> Column:
    p = F.least(F.greatest(prob, F.lit(1e-6)), F.lit(1.0 - 1e-6))
    return 1.0 / (1.0 + F.exp(-F.log(p / (1.0 - p)) / temperature))
