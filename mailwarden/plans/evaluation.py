"""Queries over scoring, metrics, error analysis, robustness, models and attribution."""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window, functions as F

from mailwarden import constants as K
from mailwarden.functions.hashing import hash32, seeded, unit as unit_hash
from mailwarden.operators import (attribution, boosting, evaluate, features, grams, mail_model, metrics, models, robustness, scaling, scoring, splits,
                                  stacked, vectorize)
from mailwarden.plans.registry import ctes, hash32 as hash32_sql, lit, query, rnd, rounded, side, unit
from mailwarden.session import cut_lineage, scratch_path
from mailwarden.sources import tables as A
from mailwarden.streaming.scorer import read_scores, start_scoring


# --- rule scorer ---------------------------------------------------------------------------------
def _rules_sql(subject: str, body: str, source: str, keep: str) -> str:
    hay = f"lower(trim({subject} || ' ' || {body}))"
    hits = ", ".join(f"CASE WHEN contains({hay}, {lit(p)}) THEN {lit(p)} END" for p in K.SCORER_URGENCY_PHRASES)
    links = f"regexp_extract_all({body}, {lit(chr(104) + 'ttps?://[^' + chr(92) + 's<>' + chr(34) + chr(39) + ']+')})"
    return f"""SELECT *, CASE WHEN has_ip_url OR urgency_score >= 0.5 THEN 0.85 WHEN num_urls = 0 THEN 0.1 ELSE 0.45 END::DOUBLE AS prob
FROM (SELECT {keep}, len(links) AS num_urls,
        len(list_filter(links, lambda u: regexp_matches(u, 'https?://\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}'))) > 0 AS has_ip_url,
        len(list_filter(links, lambda u: regexp_matches(u, '(?i)\\.({'|'.join(K.RISKY_TLDS)})/?'))) > 0 AS suspicious_tld,
        body_length, hits, least(1.0, len(hits) * 0.25)::DOUBLE AS urgency_score
      FROM (SELECT {keep}, {links} AS links, length({body}) AS body_length,
                   list_filter([{hits}], lambda x: x IS NOT NULL) AS hits FROM {source}))"""


_SCORED = _rules_sql("coalesce(subject, '')", "coalesce(body, '')", "mail_pages", "sample_id, label")
_VERDICTS = f"""SELECT sample_id, (prob >= 0.5)::INT AS prediction,
  CASE WHEN prob >= 0.5 THEN 'Phishing' ELSE 'Legitimate' END AS label_name, {rnd('prob', 4)} AS phishing_probability,
  {rnd('CASE WHEN prob >= 0.5 THEN prob ELSE 1.0::DOUBLE - prob END', 4)} AS confidence,
  CASE WHEN prob >= 0.85 THEN 'CRITICAL' WHEN prob >= 0.6 THEN 'HIGH' WHEN prob >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  concat_ws(' | ', CASE WHEN has_ip_url THEN {lit(K.SIGNAL_IP)} END, CASE WHEN suspicious_tld THEN {lit(K.SIGNAL_TLD)} END,
    CASE WHEN len(hits) > 0 THEN {lit(K.SIGNAL_URGENCY)} || array_to_string(hits[1:3], ', ') END,
    CASE WHEN num_urls > 3 THEN {lit(K.SIGNAL_DENSITY[0])} || num_urls || {lit(K.SIGNAL_DENSITY[1])} END) AS top_signals
FROM scored"""
_VERDICT_COLUMNS = ["sample_id", "prediction", "label_name", "phishing_probability", "confidence", "risk_level", "top_signals"]


@query("rule_scores", ctes("mail_pages", scored=_SCORED) + """
SELECT sample_id, num_urls, has_ip_url, suspicious_tld, body_length, urgency_score, prob FROM scored""")
def rule_scores(spark, sf):
    return scoring.rule_scores(A.mail_pages(spark, sf)).select(
        "sample_id", "num_urls", "has_ip_url", "suspicious_tld", "body_length", "urgency_score", "prob")


@query("verdicts", ctes("mail_pages", scored=_SCORED) + _VERDICTS)
def verdicts(spark, sf):
    out = scoring.analyze(A.mail_pages(spark, sf))
    return out.withColumn("top_signals", F.concat_ws(" | ", "top_signals")).select(*_VERDICT_COLUMNS)


@query("stream_scores", ctes("mail_pages", scored=_SCORED) + _VERDICTS)
def stream_scores(spark, sf):
    """The same verdicts from a stream of parquet files, a few files per micro-batch."""
    base = scratch_path(spark, "stream")
    mail = A.mail_pages(spark, sf).select("sample_id", "subject", "body")
    mail.repartition(6, "sample_id").write.parquet(f"{base}/in")
    job = start_scoring(spark, f"{base}/in", mail.schema, f"{base}/out", f"{base}/checkpoint", files_per_batch=3)
    job.awaitTermination()
    out = read_scores(spark, f"{base}/out")
    return out.withColumn("top_signals", F.concat_ws(" | ", "top_signals")).select(*_VERDICT_COLUMNS)


@query("stream_model_scores", """SELECT count(*) AS n_emails, count(*) AS n_equal_to_batch, count(*) AS n_after_replay FROM pages""")
def stream_model_scores(spark, sf):
    """A model fitted on the feature table and the words of the mails, stored as one artifact, scores a stream; counts the
    mails whose streamed probability equals the batch one, and the mails after a replay from the start."""
    base = scratch_path(spark, "model-stream")
    mail = splits.group_split(A.mail_pages(spark, sf), "sample_id")
    columns = ["sample_id", "subject", "body", "sender", "receiver"]
    mail.select(*columns, "label", "split").repartition(6, "sample_id").write.parquet(f"{base}/mail")
    mail = spark.read.parquet(f"{base}/mail")
    mail_model.save(mail_model.fit(mail), f"{base}/model")

    def streamed(checkpoint):
        start_scoring(spark, f"{base}/mail", mail.schema, f"{base}/out", f"{base}/{checkpoint}", mail_model.scorer(f"{base}/model"),
                      files_per_batch=3).awaitTermination()
        return read_scores(spark, f"{base}/out")
    once = models.compact(streamed("first").select("sample_id", F.col("prob").alias("p")))
    again = streamed("second").select("sample_id")
    batch = mail_model.scorer(f"{base}/model")(mail).select("sample_id", "prob")
    equal = batch.join(once, "sample_id").agg(F.count_if(F.abs(F.col("prob") - F.col("p")) < 1e-9).alias("n_equal_to_batch"))
    return (once.agg(F.count(F.lit(1)).alias("n_emails")).join(equal).join(again.agg(F.count(F.lit(1)).alias("n_after_replay"))))


@query("policy_counts", ctes("predictions") + f"""
SELECT CASE WHEN prob < 0.15 THEN 'deliver' WHEN prob <= 0.8 THEN 'quarantine' ELSE 'block' END AS action,
  count(*) AS n_emails, {rnd('avg(prob)')} AS mean_prob FROM predictions GROUP BY 1""")
def policy_counts(spark, sf):
    return rounded(scoring.policy_counts(A.predictions(spark, sf)), "mean_prob")


# --- metrics -----------------------------------------------------------------------------------------
_RATES = ["brier_score", "accuracy", "balanced_accuracy", "precision", "recall", "f1", "f1_macro", "mcc", "specificity",
          "fpr", "fnr"]


def _z(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0 ELSE ({a}) / ({b})::DOUBLE END"


def _rates_sql(source: str, group: str | None) -> str:
    key = f"{group}, " if group else ""
    by = f"GROUP BY {group}" if group else ""
    f1p, f1n = _z("2 * tp", "2 * tp + fp + fn"), _z("2 * tn", "2 * tn + fp + fn")
    body = {
        "brier_score": "brier_score", "accuracy": _z("tp + tn", "tp + tn + fp + fn"),
        "balanced_accuracy": f"({_z('tp', 'tp + fn')} + {_z('tn', 'tn + fp')}) / greatest((tp + fn > 0)::INT + (tn + fp > 0)::INT, 1)",
        "precision": _z("tp", "tp + fp"), "recall": _z("tp", "tp + fn"), "f1": f1p,
        "f1_macro": f"({f1p} + {f1n}) / greatest((tp + fp + fn > 0)::INT + (tn + fp + fn > 0)::INT, 1)",
        "mcc": _z("tp * tn - fp * fn", "sqrt(((tp + fp) * (tp + fn))::DOUBLE * (tn + fp) * (tn + fn))"),
        "specificity": "tn / greatest(tn + fp, 1)", "fpr": "fp / greatest(tn + fp, 1)", "fnr": "fn / greatest(tp + fn, 1)",
    }
    return f"""SELECT {key}tp, fp, tn, fn, {', '.join(f'{rnd(e)} AS {c}' for c, e in body.items())} FROM (
  SELECT {key}count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp,
    count(*) FILTER (label = 0 AND pred = 0) AS tn, count(*) FILTER (label = 1 AND pred = 0) AS fn,
    avg((prob - label) * (prob - label)) AS brier_score FROM {source} {by})"""


def _ranking_sql(source: str, groups: str, budget: float = 0.005) -> str:
    """One row per slice from plain windows over the distinct scores."""
    return f"""SELECT {groups}, CASE WHEN p > 0 AND n > 0 THEN area / (p * n) END AS roc_auc,
  CASE WHEN p > 0 THEN ap / p ELSE 0 END AS pr_auc, CASE WHEN p > 0 THEN coalesce(best, 0) / p ELSE 0 END AS recall_at_fpr
FROM (SELECT {groups}, sum(pos)::DOUBLE AS p, sum(neg)::DOUBLE AS n, sum(neg * (tp - pos / 2.0::DOUBLE)) AS area,
        sum(pos * tp / (tp + fp)::DOUBLE) AS ap, max(tp) FILTER (fp <= total_neg * {budget}::DOUBLE) AS best
      FROM (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(neg) OVER (PARTITION BY {groups}) AS total_neg
            FROM (SELECT {groups}, prob, sum(label) AS pos, sum(1 - label) AS neg FROM {source} GROUP BY {groups}, prob)
            WINDOW w AS (PARTITION BY {groups} ORDER BY prob DESC)) GROUP BY {groups})"""


def _ranks(columns: str, groups: str | None, source: str) -> str:
    inner = _ranking_sql(source, groups or "one")
    picked = ", ".join(f"{rnd(c)} AS {c}" for c in columns.split())
    return f"SELECT {groups + ', ' if groups else ''}{picked} FROM ({inner})"


_ONE = dict(p1="SELECT *, 1 AS one FROM predictions")


@query("metrics_overall", ctes("predictions") + _rates_sql("predictions", None))
def metrics_overall(spark, sf):
    return rounded(metrics.classification_metrics(A.predictions(spark, sf)), *_RATES)


@query("metrics_by_source", ctes("predictions") + _rates_sql("predictions", "dataset_id"))
def metrics_by_source(spark, sf):
    return rounded(metrics.classification_metrics(A.predictions(spark, sf), ["dataset_id"]), *_RATES)


@query("roc_auc", ctes("predictions") + _ranks("roc_auc", "dataset_id", "predictions"))
def roc_auc(spark, sf):
    out = metrics.ranking_metrics(A.predictions(spark, sf), ["dataset_id"])
    return rounded(out.select("dataset_id", "roc_auc"), "roc_auc")


@query("pr_auc", ctes("predictions") + _ranks("pr_auc", "dataset_id", "predictions"))
def pr_auc(spark, sf):
    out = metrics.ranking_metrics(A.predictions(spark, sf), ["dataset_id"])
    return rounded(out.select("dataset_id", "pr_auc"), "pr_auc")


@query("recall_at_fpr", ctes("predictions") + _ranks("recall_at_fpr", "dataset_id", "predictions"))
def recall_at_fpr(spark, sf):
    out = metrics.ranking_metrics(A.predictions(spark, sf), ["dataset_id"])
    return rounded(out.select("dataset_id", "recall_at_fpr"), "recall_at_fpr")


@query("ranking_overall", ctes("predictions", **_ONE) + _ranks("roc_auc pr_auc recall_at_fpr", None, "p1"))
def ranking_overall(spark, sf):
    return rounded(metrics.ranking_metrics(A.predictions(spark, sf)), "roc_auc", "pr_auc", "recall_at_fpr")


@query("roc_points", ctes("predictions", **_ONE) + """
SELECT prob, pos::BIGINT AS pos, neg::BIGINT AS neg, (sum(pos) OVER w)::BIGINT AS tp, (sum(neg) OVER w)::BIGINT AS fp
FROM (SELECT prob, sum(label) AS pos, sum(1 - label) AS neg FROM predictions GROUP BY 1) WINDOW w AS (ORDER BY prob DESC)""")
def roc_points(spark, sf):
    df = A.predictions(spark, sf).withColumn("one", F.lit(1))
    return metrics.threshold_curve(df, ["one"]).drop("one", "all_pos", "all_neg")


_EDGES = [i * (1.0 / 15) for i in range(1, 15)] + [1.0]
_BIN = " + ".join(f"(prob >= {e!r}::DOUBLE)::INT" for e in _EDGES)


def _ece_sql(group: str | None) -> str:
    key, by = (f"{group}, ", f"GROUP BY {group}") if group else ("", "")
    inner_by = f"{group}, bin" if group else "bin"
    return f"""SELECT {key}{rnd('coalesce(sum(n * abs(acc - conf)) FILTER (bin < 15), 0) / sum(n)')} AS ece FROM (
  SELECT {key}bin, count(*) AS n, avg(label) AS acc, avg(prob) AS conf
  FROM (SELECT *, {_BIN} AS bin FROM predictions) GROUP BY {inner_by}) {by}"""


@query("ece", ctes("predictions") + _ece_sql("dataset_id"))
def ece(spark, sf):
    return rounded(metrics.calibration_error(A.predictions(spark, sf), ["dataset_id"]), "ece")


@query("ece_overall", ctes("predictions") + _ece_sql(None))
def ece_overall(spark, sf):
    return rounded(metrics.calibration_error(A.predictions(spark, sf)), "ece")


@query("coverage_risk", ctes("predictions") + "\nUNION ALL\n".join(f"""
SELECT {t}::DOUBLE AS threshold, count(*) FILTER (u <= {t}::DOUBLE) AS n_kept,
  {rnd(f'count(*) FILTER (u <= {t}::DOUBLE) / count(*)')} AS coverage,
  {rnd(_z(f'count(*) FILTER (u <= {t}::DOUBLE AND label <> pred)', f'count(*) FILTER (u <= {t}::DOUBLE)'))} AS risk
FROM (SELECT *, 1.0::DOUBLE - abs(2.0::DOUBLE * prob - 1.0::DOUBLE) AS u FROM predictions)""" for t in (0.3, 0.4, 0.5, 0.6, 0.7)))
def coverage_risk(spark, sf):
    return rounded(metrics.coverage_risk(A.predictions(spark, sf)), "coverage", "risk")


_RIVAL_SQL = dict(rival=f"""SELECT *, {rnd(unit("'r:' || sample_id") + ' * 0.6 + label * 0.4', 2)} AS prob_b FROM predictions""")


def _rival(spark, sf):
    """A second scored column for the paired tests."""
    df = A.predictions(spark, sf)
    u = unit_hash(F.concat(F.lit("r:"), F.col("sample_id")))
    return df.withColumn("prob_b", F.rint((u * 0.6 + F.col("label") * 0.4) * 100.0) / 100.0)


@query("mcnemar", ctes("predictions", **_RIVAL_SQL) + f"""
SELECT a AS only_a, b AS only_b, {rnd(_z('greatest(abs(a - b) - 1, 0) * greatest(abs(a - b) - 1, 0)', 'a + b'))} AS statistic FROM (
  SELECT count(*) FILTER (pred = label AND (prob_b >= 0.5)::INT <> label) AS a,
         count(*) FILTER (pred <> label AND (prob_b >= 0.5)::INT = label) AS b FROM rival)""")
def mcnemar(spark, sf):
    df = _rival(spark, sf).withColumn("pred_b", (F.col("prob_b") >= 0.5).cast("int"))
    return rounded(metrics.mcnemar(df, "pred", "pred_b"), "statistic")


@query("wilcoxon", ctes("predictions", **_RIVAL_SQL) + f"""
SELECT n AS n_pairs, up AS rank_sum_up, down AS rank_sum_down,
  {rnd('(up - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1)::DOUBLE / 24)')} AS z FROM (
  SELECT count(*) AS n, sum(r) FILTER (d > 0) AS up, sum(r) FILTER (d < 0) AS down FROM (
    SELECT d, avg(k) OVER (PARTITION BY abs(d)) AS r FROM (
      SELECT d, row_number() OVER (ORDER BY abs(d)) AS k FROM (SELECT prob - prob_b AS d FROM rival) WHERE d <> 0)))""")
def wilcoxon(spark, sf):
    return rounded(metrics.wilcoxon(_rival(spark, sf), "prob", "prob_b"), "z")


def _poisson_sql(u: str) -> str:
    cdf, term, total = [], math.exp(-1.0), 0.0
    for k in range(1, 13):
        total += term
        cdf.append(total)
        term /= k
    return " + ".join(f"({u} >= {c!r}::DOUBLE)::INT" for c in cdf)


@query("bootstrap_ci", ctes(
    "predictions",
    blocks=f"""SELECT block, count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp,
      count(*) FILTER (label = 0 AND pred = 0) AS tn, count(*) FILTER (label = 1 AND pred = 0) AS fn
      FROM (SELECT *, {hash32_sql("'block:' || sample_id")} % 1024 AS block FROM predictions) GROUP BY 1""",
    weighted=f"""SELECT rep, {_poisson_sql(unit("'42:' || rep || ':' || block"))} AS w, tp, fp, tn, fn
      FROM blocks, range(1, 10001) r(rep)""",
    reps=f"""SELECT {_z('tp + tn', 'tp + tn + fp + fn')} AS accuracy, {_z('tp', 'tp + fn')} AS recall, {_z('2 * tp', '2 * tp + fp + fn')} AS f1
      FROM (SELECT rep, sum(tp * w) AS tp, sum(fp * w) AS fp, sum(tn * w) AS tn, sum(fn * w) AS fn FROM weighted GROUP BY 1)""")
       + "\nUNION ALL\n".join(f"""SELECT '{m}' AS metric, {rnd(f'quantile_cont({m}::DOUBLE, {(1 - 0.95) / 2!r})')} AS low,
  {rnd(f'quantile_cont({m}::DOUBLE, 0.5)')} AS median, {rnd(f'quantile_cont({m}::DOUBLE, {1 - (1 - 0.95) / 2!r})')} AS high FROM reps"""
                              for m in ("accuracy", "recall", "f1")))
def bootstrap_ci(spark, sf):
    return rounded(metrics.bootstrap_ci(A.predictions(spark, sf), iterations=10_000), "low", "median", "high")


_GRID = ", ".join(f"{round(0.25 + 0.05 * i, 10)!r}" for i in range(96))
_CLIP = "least(greatest(prob, 1e-6::DOUBLE), 1.0::DOUBLE - 1e-6::DOUBLE)"


_LOSS = "ln(1 + exp(-m / {t}))"


@query("temperature_fit", ctes(
    "predictions",
    margins=f"""SELECT {side('sample_id')} AS split, ln({_CLIP} / (1 - {_CLIP})) * (2 * label - 1) AS m FROM predictions""",
    fitted=f"""SELECT t FROM (SELECT t, avg({_LOSS.format(t='t')}) AS nll FROM (
      SELECT m, unnest([{_GRID}]::DOUBLE[]) AS t FROM margins WHERE split = 'val') GROUP BY 1) ORDER BY nll, t LIMIT 1""") + f"""
SELECT split, t AS temperature, {rnd(f"avg({_LOSS.format(t='1')})")} AS nll_before, {rnd(f"avg({_LOSS.format(t='t')})")} AS nll_after
FROM margins, fitted WHERE split <> 'train' GROUP BY 1, 2""")
def temperature_fit(spark, sf):
    """Temperature chosen on validation rows; log loss before and after on validation and on test rows."""
    rows = splits.group_split(A.predictions(spark, sf), "sample_id")
    fitted = metrics.temperature_fit(rows.filter("split = 'val'")).select("temperature")
    out = metrics.temperature_report(rows.filter("split <> 'train'"), fitted, ["split"])
    return rounded(out, "nll_before", "nll_after")


# --- error analysis and cross-source ---------------------------------------------------------------------
_ERR = dict(e="""SELECT *, CASE WHEN label = 0 AND pred = 1 THEN 'FALSE_POSITIVE' WHEN label = 1 AND pred = 0 THEN 'FALSE_NEGATIVE'
  ELSE 'CORRECT' END AS error_type FROM predictions""")


@query("error_types", ctes("predictions", **_ERR) + "SELECT sample_id, error_type FROM e")
def error_types(spark, sf):
    return evaluate.mark_errors(A.predictions(spark, sf)).select("sample_id", "error_type")


@query("error_slices", ctes("predictions", **_ERR) + f"""
SELECT dataset_id, total, fp, fn, {rnd('(fp + fn) / total')} AS error_rate, {rnd('fp / greatest(neg, 1)')} AS fp_rate,
  {rnd('fn / greatest(pos, 1)')} AS fn_rate FROM (
  SELECT dataset_id, count(*) AS total, count(*) FILTER (error_type = 'FALSE_POSITIVE') AS fp,
    count(*) FILTER (error_type = 'FALSE_NEGATIVE') AS fn, count(*) FILTER (label = 0) AS neg, count(*) FILTER (label = 1) AS pos
  FROM e GROUP BY ROLLUP (dataset_id))""")
def error_slices(spark, sf):
    out = evaluate.error_slices(evaluate.mark_errors(A.predictions(spark, sf)))
    return rounded(out, "error_rate", "fp_rate", "fn_rate")


@query("worst_errors", ctes("predictions", **_ERR) + """
SELECT error_type, rank, sample_id, dataset_id, substr(coalesce(subject, ''), 1, 80) AS subject, prob AS pred_prob FROM (
  SELECT *, row_number() OVER (PARTITION BY error_type ORDER BY CASE WHEN error_type = 'FALSE_POSITIVE' THEN -prob ELSE prob END,
    sample_id) AS rank FROM e WHERE error_type <> 'CORRECT') WHERE rank <= 5""")
def worst_errors(spark, sf):
    return evaluate.worst_errors(evaluate.mark_errors(A.predictions(spark, sf)))


_TRANSFER = dict(t=f"""SELECT m.dataset_id AS train_source, p.dataset_id AS eval_source, label,
    {rnd(unit("m.dataset_id || ':' || sample_id") + ' * 0.7 + label * 0.3', 2)} AS prob
  FROM predictions p, (SELECT DISTINCT dataset_id FROM predictions) m""")


def _transfer_scores(spark, sf):
    """Each labelled email scored by one (hash-made) model per source."""
    df = A.predictions(spark, sf)
    sources = df.agg(F.array_sort(F.collect_set("dataset_id")).alias("models")).withColumn("_k", F.lit(1))   # one row
    rows = df.withColumn("_k", F.lit(1)).join(F.broadcast(sources), "_k").select(
        "sample_id", F.col("dataset_id").alias("eval_source"), "label", F.explode("models").alias("train_source"))
    u = unit_hash(F.concat_ws(":", "train_source", "sample_id"))
    return rows.withColumn("prob", F.rint((u * 0.7 + F.col("label") * 0.3) * 100.0) / 100.0)


_TRANSFER_SQL = ctes("predictions", **_TRANSFER, x=_ranking_sql("t", "train_source, eval_source")) \
    + f"SELECT train_source, eval_source, {rnd('roc_auc', 4)} AS score FROM x"


@query("transfer_scores", _TRANSFER_SQL)
def transfer_scores(spark, sf):
    return evaluate.transfer_scores(_transfer_scores(spark, sf))


#: Columns of the square form: the sources of the given tables.
_SOURCES = [f"src{i}" for i in range(20)]


@query("transfer_matrix", f"""SELECT train_source, {', '.join(f"max(score) FILTER (eval_source = '{x}') AS {x}" for x in _SOURCES)}
FROM ({_TRANSFER_SQL}) GROUP BY 1""")
def transfer_matrix(spark, sf):
    return evaluate.transfer_matrix(evaluate.transfer_scores(_transfer_scores(spark, sf)), _SOURCES)


_SUMMED = ["accuracy", "recall", "f1", "mcc"]


@query("loso_metric_summary", ctes("predictions", m=_rates_sql("predictions", "dataset_id").replace(rnd("@"), ""),
                                   k="SELECT dataset_id, count(*) AS num_test_samples FROM predictions GROUP BY 1")
       + "\nUNION ALL\n".join(f"""SELECT '{c}' AS metric, {rnd(f'avg({c})', 4)} AS mean, {rnd(f'stddev_pop({c})', 4)} AS std,
  {rnd(f'min({c})', 4)} AS min, {rnd(f'max({c})', 4)} AS max FROM m JOIN k USING (dataset_id)""" for c in [*_SUMMED, "num_test_samples"]))
def loso_metric_summary(spark, sf):
    df = A.predictions(spark, sf)
    m = rounded(metrics.classification_metrics(df, ["dataset_id"]), *_RATES)
    m = m.withColumn("num_test_samples", F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))
    return evaluate.metric_summary(m, [*_SUMMED, "num_test_samples"], "dataset_id")


@query("generalization_gap", ctes(
    "predictions", i=_rates_sql("predictions", "dataset_id"),
    rest="SELECT f.dataset_id, label, pred, prob FROM predictions p, (SELECT DISTINCT dataset_id FROM predictions) f "
         "WHERE p.dataset_id <> f.dataset_id", o=_rates_sql("rest", "dataset_id"))
       + f"SELECT dataset_id, i.f1 AS in_domain, o.f1 AS out_domain, {rnd('i.f1 - o.f1', 4)} AS gap FROM i JOIN o USING (dataset_id)")
def generalization_gap(spark, sf):
    """F1 on a source against F1 on all other sources; the latter is total counts minus the source's own."""
    own = metrics.confusion(A.predictions(spark, sf), ["dataset_id"]).withColumn("_k", F.lit(1))
    cells = ["tp", "fp", "tn", "fn"]
    total = own.groupBy("_k").agg(*[F.sum(c).alias(f"_{c}") for c in cells])
    others = own.join(F.broadcast(total), "_k").select(
        "dataset_id", "brier_score", *[(F.col(f"_{c}") - F.col(c)).alias(c) for c in cells])
    a, b = (rounded(metrics.with_rates(x.drop("_k")), "f1") for x in (own, others))
    return evaluate.generalization_gap(a, b, "f1", "dataset_id")


# --- robustness ----------------------------------------------------------------------------------------------
_M = 2147483647


def _draw(start: str, i: str, salt: int) -> str:
    x = f"(({start} + ({i}) * {748321 + 2 * salt}::BIGINT) % {_M})"
    return f"(({x} * {x} + {salt}) % {_M})"


def _u(start: str, i: str, salt: int) -> str:
    return f"({_draw(start, i, salt)} / {_M}.0::DOUBLE)"


def _homoglyph_sql(t: str) -> str:
    return (f"array_to_string(list_transform(string_split({t}, ''), lambda c, i: CASE WHEN contains({lit(K.HOMOGLYPH_LATIN)}, c) "
            f"AND {_u('s', 'i - 1', 1)} < 0.1 THEN translate(c, {lit(K.HOMOGLYPH_LATIN)}, {lit(K.HOMOGLYPH_LOOKALIKE)}) ELSE c END), '')")


def _zero_width_sql(t: str) -> str:
    marks = "[" + ", ".join(lit(z) for z in K.ZERO_WIDTH) + "]"
    return (f"array_to_string(list_transform(string_split({t}, ''), lambda c, i: CASE WHEN regexp_matches(c, '\\p{{L}}') "
            f"AND {_u('s', 'i - 1', 2)} < 0.1 THEN c || {marks}[{_draw('s', 'i - 1', 3)} % 4 + 1] ELSE c END), '')")


def _typo_sql(t: str) -> str:
    at = f"({_draw('s', 'i - 1', 5)} % greatest(length(w) - 1, 1))"
    swapped = f"substr(w, 1, {at}) || substr(w, {at} + 2, 1) || substr(w, {at} + 1, 1) || substr(w, {at} + 3)"
    return (f"array_to_string(list_transform(regexp_extract_all({t}, '\\S+'), lambda w, i: "
            f"CASE WHEN length(w) > 3 AND {_u('s', 'i - 1', 4)} < 0.1 THEN {swapped} ELSE w END), ' ')")


def _defang_sql(t: str) -> str:
    return (rf"regexp_replace(regexp_replace({t}, '(?i)https?://', 'hxxp://', 'g'), "
            r"'\.([a-zA-Z]{2,6})([/\s]|$)', '[.]\1\2', 'g')")


_TEXT = "coalesce(subject, '') || ' ' || coalesce(body, '')"
_START = f"({hash32_sql(chr(39) + '42:' + chr(39) + ' || sample_id')} % {_M})"
_ATTACKS = dict(
    b=f"SELECT sample_id, label, {_TEXT} AS t, {_START} AS s FROM mail_pages",
    hg=f"SELECT *, {_homoglyph_sql('t')} AS h FROM b",
    attacked=f"""SELECT sample_id, label, 'clean' AS attack, t AS text FROM b
      UNION ALL SELECT sample_id, label, 'homoglyph', h FROM hg
      UNION ALL SELECT sample_id, label, 'zero_width', {_zero_width_sql('t')} FROM b
      UNION ALL SELECT sample_id, label, 'typo', {_typo_sql('t')} FROM b
      UNION ALL SELECT sample_id, label, 'url', {_defang_sql('t')} FROM b
      UNION ALL SELECT sample_id, label, 'combined', {_defang_sql(_zero_width_sql('h'))} FROM hg""",
    scored=_rules_sql("''", "text", "attacked", "sample_id, label, attack"),
    predicted="SELECT *, (prob >= 0.5)::INT AS pred FROM scored")


def _attacked(spark, sf):
    mail = A.mail_pages(spark, sf)
    text = F.concat(F.coalesce("subject", F.lit("")), F.lit(" "), F.coalesce("body", F.lit("")))
    return robustness.attack_table(mail.withColumn("model_text", text), "model_text", keep=["sample_id", "label"])


def _scored(table):
    """Rule scores of a (sample_id, label, attack, text) table."""
    out = scoring.rule_scores(table.withColumn("subject", F.lit("")).withColumnRenamed("text", "body"))
    return out.withColumn("pred", (F.col("prob") >= 0.5).cast("int")).select("sample_id", "label", "attack", "prob", "pred")


@query("attack_table", ctes("mail_pages", **_ATTACKS)
       + "SELECT sample_id, label, attack, md5(text) AS text_md5, length(text) AS n_chars FROM attacked")
def attack_table(spark, sf):
    return _attacked(spark, sf).select("sample_id", "label", "attack", F.md5("text").alias("text_md5"),
                                       F.length("text").alias("n_chars"))


@query("robustness_report", ctes(
    "mail_pages", **_ATTACKS, r=_rates_sql("predicted", "attack"), q=_ranking_sql("predicted", "attack"),
    j="SELECT r.attack, roc_auc, f1, recall FROM r JOIN q USING (attack)")
       + f"""SELECT j.attack, {rnd('j.roc_auc', 4)} AS roc_auc, {rnd('j.f1', 4)} AS f1, {rnd('j.recall', 4)} AS recall,
  {rnd('c.roc_auc - j.roc_auc', 4)} AS auc_drop, {rnd('c.f1 - j.f1', 4)} AS f1_drop FROM j, (SELECT * FROM j WHERE attack = 'clean') c""")
def robustness_report(spark, sf):
    return robustness.robustness_report(cut_lineage(_scored(_attacked(spark, sf))))


_PAIRS = "SELECT a.sample_id, a.attack, c.prob AS p, a.prob AS q FROM {t} a JOIN {t} c USING (sample_id) WHERE a.attack <> 'clean' AND c.attack = 'clean'"


def _kl(a: str, b: str) -> str:
    return f"{a} * (ln({a}) - ln({b}))"


def _clamped(x: str) -> str:
    return f"greatest({x}, 1e-8::DOUBLE)"


def _divergence(kind: str) -> str:
    parts = []
    for p, q in (("p", "q"), ("(1 - p)", "(1 - q)")):
        cp, cq, m = _clamped(p), _clamped(q), _clamped(f"(({p} + {q}) * 0.5::DOUBLE)")
        parts += [_kl(cp, cq), _kl(cq, cp)] if kind == "skl" else [_kl(cp, m), _kl(cq, m)]
    return "0.5::DOUBLE * (" + " + ".join(parts) + ")"


@query("consistency_audit", ctes("mail_pages", **_ATTACKS, z=_PAIRS.format(t="predicted")) + f"""
SELECT attack, count(*) AS n_pairs, {rnd(f"avg({_divergence('skl')})")} AS symmetric_kl,
  {rnd(f"avg({_divergence('js')})")} AS js_divergence, {rnd('avg((p - q) * (p - q))')} AS mse FROM z GROUP BY 1""")
def consistency_audit(spark, sf):
    out = robustness.consistency_audit(cut_lineage(_scored(_attacked(spark, sf))))
    return rounded(out, "symmetric_kl", "js_divergence", "mse")


def _success_sql(t: str) -> str:
    return f"""SELECT attack, count(*) AS n_pairs, {rnd('avg(((p >= 0.5) <> (q >= 0.5))::INT)')} AS flip_rate,
  {rnd('count(*) FILTER (p >= 0.5 AND q < 0.5) / greatest(count(*) FILTER (p >= 0.5), 1)')} AS attack_success_rate,
  {rnd('avg(p - q)')} AS confidence_shift FROM {t} GROUP BY 1"""


@query("attack_success", ctes("mail_pages", **_ATTACKS, z=_PAIRS.format(t="predicted")) + _success_sql("z"))
def attack_success(spark, sf):
    out = robustness.attack_success(cut_lineage(_scored(_attacked(spark, sf))))
    return rounded(out, "flip_rate", "attack_success_rate", "confidence_shift")


_INJECTED = dict(
    b=f"SELECT sample_id, label, {_TEXT} AS t FROM mail_pages",
    injected="SELECT sample_id, label, 'clean' AS attack, t AS text FROM b" + "".join(
        f"\nUNION ALL SELECT sample_id, label, 'injection_{i}', t || {lit(' ' + x)} FROM b" for i, x in enumerate(K.INJECTION_TEMPLATES)),
    scored=_rules_sql("''", "text", "injected", "sample_id, label, attack"),
    z=_PAIRS.format(t="scored"))


@query("injection_audit", ctes("mail_pages", **_INJECTED) + _success_sql("z"))
def injection_audit(spark, sf):
    mail = A.mail_pages(spark, sf)
    text = F.concat(F.coalesce("subject", F.lit("")), F.lit(" "), F.coalesce("body", F.lit("")))
    table = robustness.injection_table(mail.withColumn("model_text", text), "model_text", keep=["sample_id", "label"])
    return rounded(robustness.attack_success(cut_lineage(_scored(table))), "flip_rate", "attack_success_rate", "confidence_shift")


def _augment_sql() -> str:
    ws = f"({_draw('s', '0', 7)} % greatest(length(t), 1))"
    spots = "[" + ", ".join(f"({_draw('s', '0', 9)} + {j} * ({_draw('s', '1', 9)} % 97 + 1)) % greatest(length(t), 1)" for j in range(2)) + "]"
    casing = (f"array_to_string(list_transform(string_split(t, ''), lambda c, i: CASE WHEN list_contains({spots}, i - 1) AND "
              r"regexp_matches(c, '\p{L}') THEN CASE WHEN c = 'ß' THEN 'SS' WHEN lower(c) = c THEN upper(c) ELSE lower(c) END ELSE c END), '')")
    mark = f"CASE WHEN {_draw('s', '0', 13)} % 2 = 0 THEN '.' ELSE ',' END"
    at = f"({_draw('s', '0', 11)} % greatest(len(string_split(t, ' ')) - 1, 1))"
    punct = (f"CASE WHEN {_u('s', '0', 15)} < 0.5 THEN array_to_string(list_transform(string_split(t, ' '), lambda w, i: "
             f"CASE WHEN i - 1 = {at} AND i < len(string_split(t, ' ')) THEN w || {mark} ELSE w END), ' ') "
             r"ELSE regexp_replace(t, '[.,]*([.,])$', '\1') END")
    pos = f"({_draw('s', '0', 17)} % greatest(length(t), 1))"
    swap = (f"CASE WHEN length(t) >= 3 AND {pos} < length(t) - 1 AND regexp_matches(substr(t, {pos} + 1, 1), '\\p{{L}}') THEN "
            f"substr(t, 1, {pos}) || substr(t, {pos} + 2, 1) || substr(t, {pos} + 1, 1) || substr(t, {pos} + 3) ELSE t END")
    return f"""SELECT sample_id, kind, CASE kind WHEN 'whitespace' THEN CASE WHEN length(t) > 0 THEN
        substr(t, 1, {ws}) || ' ' || substr(t, {ws} + 1) ELSE t END WHEN 'casing' THEN {casing} WHEN 'punctuation' THEN {punct}
      ELSE {swap} END AS text FROM (SELECT *, ['whitespace', 'casing', 'punctuation', 'character'][{_draw('s', '0', 19)} % 4 + 1] AS kind FROM a)"""


@query("augmentation_table", ctes("mail_docs", a=f"SELECT sample_id, body AS t, {_START} AS s FROM mail_docs", x=_augment_sql())
       + "SELECT sample_id, kind, md5(text) AS text_md5, length(text) AS n_chars FROM x")
def augmentation_table(spark, sf):
    return robustness.augmentation_table(A.mail_docs(spark, sf), "body").select(
        "sample_id", "kind", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"))


# --- attribution, reports ----------------------------------------------------------------------------------------
@query("token_source_lift", ctes(
    "mail_docs",
    w=r"SELECT DISTINCT sample_id, dataset_id, unnest(regexp_extract_all(lower(body), '[\p{L}\p{N}_]{2,}')) AS token FROM mail_docs",
    cell="SELECT dataset_id, token, count(*) AS n FROM w GROUP BY 1, 2",
    tok="SELECT token, sum(n)::BIGINT AS nt FROM cell GROUP BY 1 HAVING sum(n) >= 5",
    src="SELECT dataset_id, count(*) AS ns, (SELECT count(*) FROM mail_docs) AS na FROM mail_docs GROUP BY 1")
       + f"""SELECT dataset_id, token, n AS n_docs, nt AS n_token, {rnd('lift')} AS lift, {rnd('chi2', 4)} AS chi2, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY lift DESC, n DESC, token) AS rank FROM (
    SELECT *, n::DOUBLE * na / (nt::DOUBLE * ns) AS lift, {_z('na::DOUBLE * (n::DOUBLE * na - nt * ns) * (n::DOUBLE * na - nt * ns)',
                                                              'nt::DOUBLE * ns * (na - nt) * (na - ns)')} AS chi2
    FROM cell JOIN tok USING (token) JOIN src USING (dataset_id))) WHERE rank <= 20""")
def token_source_lift(spark, sf):
    out = attribution.token_source_lift(A.mail_docs(spark, sf), vectorize.word_terms(F.col("body"), 1))
    return rounded(rounded(out, "lift"), "chi2", digits=4)


@query("report_long", ctes("predictions", o=_rates_sql("predictions", None), s=_rates_sql("predictions", "dataset_id"), c=_ece_sql("dataset_id"))
       + "\nUNION ALL\n".join(
           [f"SELECT 'overall' AS section, 'all' AS slice, '{m}' AS metric, {m}::DOUBLE AS value FROM o" for m in ["tp", "fp", "tn", "fn", *_RATES]]
           + [f"SELECT 'by_source', dataset_id, '{m}', {m}::DOUBLE FROM s" for m in ["tp", "fp", "tn", "fn", *_RATES]]
           + ["SELECT 'calibration', dataset_id, 'ece', ece FROM c"]))
def report_long(spark, sf):
    df = A.predictions(spark, sf)
    out = evaluate.report_long({"overall": metrics.classification_metrics(df),
                                "by_source": metrics.classification_metrics(df, ["dataset_id"]),
                                "calibration": metrics.calibration_error(df, ["dataset_id"])},
                               {"by_source": "dataset_id", "calibration": "dataset_id"})
    return rounded(out, "value")


# --- models (no SQL twin) --------------------------------------------------------------------------------------------
def _featured(spark, sf):
    """Feature rows of the labelled pages with a split; written once, because every fit reads them again."""
    rows = splits.group_split(A.mail_pages(spark, sf), "sample_id")
    return models.compact(features.feature_table(rows, keep=["sample_id", "dataset_id", "label", "split"]))


def _report(scored):
    return metrics.all_metrics(scored.select("split", "label", "pred", "prob"), ["split"])


def _parts(df):
    return (df.filter(F.col("split") == s) for s in ("train", "val"))


def _standard_columns(rows, columns, train="split = 'train'"):
    """The feature columns centred and scaled on the training rows; folds are scaled by their own rows later."""
    return scaling.apply_scaler(rows, scaling.fit_scaler(rows.filter(train), columns))


def _holdout_stack(featured, columns, folds=1, mask=None):
    """Every fold trains on the rows with split = 'train'."""
    rows = _standard_columns(featured, columns)
    rows = rows.withColumn("label", F.col("label").cast("double")).withColumn("val_use", F.array(*[(F.col("split") == "val").cast("double")] * folds))
    use = F.array(*[(F.col("split") == "train").cast("double")] * folds)
    dense = stacked.dense_rows(rows, columns, use, ["sample_id", "label", "split", "val_use"])
    return stacked.standardized(stacked.stack(dense, len(columns), folds), mask)


def _best_lr(s, grid=models.C_GRID):
    """Weights for every fold and C, margins of all rows, and the place of each fold's best C."""
    weights = stacked.fit(s, grid)
    scored = models.compact(stacked.margins(s, weights, [c for c in s.rows.columns if c not in ("use", "idx", "val")]))
    return weights, scored, stacked.choose(scored, s.folds, len(grid))


def _with_prob(scored, z):
    prob = stacked.probability(z)
    return scored.withColumn("prob", prob).withColumn("pred", (prob >= 0.5).cast("int")).withColumn("label", F.col("label").cast("int"))


def _lr_scored(featured):
    """All rows scored by the logistic baseline, and its C."""
    _, scored, best = _best_lr(_holdout_stack(featured, features.FEATURES))
    return _with_prob(scored, F.col("z")[int(best[0])]), models.C_GRID[best[0]]


@query("lr_holdout")
def lr_holdout(spark, sf):
    """Logistic regression on the 52 features, C chosen on validation rows; metrics per split."""
    scored, c = _lr_scored(_featured(spark, sf))
    return _report(scored).withColumn("best_c", F.lit(c))


@query("lr_tfidf_holdout")
def lr_tfidf_holdout(spark, sf):
    """Logistic regression on word and character TF-IDF."""
    mail = splits.group_split(A.mail_docs(spark, sf).filter("label is not null"), "sample_id")
    rows, _ = vectorize.fit_transform(
        mail.select("sample_id", "label", "split", _subject_body().alias("t")), F.col("t"), F.col("split") == "train", 30000, 30000,
        keep=["sample_id", "label", "split"])
    fitted = models.train_logistic(*_parts(rows))
    return _report(fitted.score(rows)).withColumn("best_c", F.lit(fitted.best_c))


def _subject_body():
    return F.concat(F.coalesce("subject", F.lit("")), F.lit(" "), F.coalesce("body", F.lit("")))


def _svm_scored(featured):
    """All rows scored by the calibrated SVM, and its C. Margins of three held-out folds calibrate it; all fits are columns of
    one stack."""
    folds, grid, columns = 3, models.C_GRID, features.FEATURES
    rows = _standard_columns(featured, columns)
    train, fold = F.col("split") == "train", (hash32(seeded(42, F.lit("fold"), F.col("sample_id"))) % folds).cast("int")
    rows = rows.withColumn("label", F.col("label").cast("double")).withColumn("fold", fold)
    use = F.array(*[(train & (F.col("fold") != k)).cast("double") for k in range(folds)], train.cast("double"))
    s = stacked.standardized(stacked.stack(stacked.dense_rows(rows, columns, use, ["sample_id", "label", "split", "fold"]), len(columns), folds + 1))
    scored = models.compact(stacked.margins(s, stacked.fit(s, grid, kind="hinge"), ["sample_id", "label", "split", "fold"]))
    n = len(grid)
    # a sigmoid per value of C on margins of models that have not seen the row
    held = scored.filter("split = 'train'").select(
        "label", F.array_repeat(F.lit(1.0), n).alias("use"), F.sequence(F.lit(0), F.lit(n - 1)).alias("idx"),
        F.slice("z", F.col("fold") * n + 1, n).alias("val"))
    sigmoid = stacked.fit(stacked.stack(held, n, n, np.eye(n)), [100.0])      # a light penalty: separable margins have no finite fit
    steep = [(float(sigmoid[c, c, 0]), float(sigmoid[n, c, 0])) for c in range(n)]
    z = F.array(*[F.col("z")[folds * n + c] * a + b for c, (a, b) in enumerate(steep)])
    calibrated = scored.withColumn("z", z).withColumn("val_use", F.array((F.col("split") == "val").cast("double")))
    best = int(stacked.choose(calibrated, 1, n)[0])
    return _with_prob(calibrated, F.col("z")[best]), grid[best]


@query("svm_holdout")
def svm_holdout(spark, sf):
    """Linear SVM (squared hinge), full grid; metrics per split."""
    scored, c = _svm_scored(_featured(spark, sf))
    return _report(scored).withColumn("best_c", F.lit(c))


_FORESTS = {}


def _forest(spark, sf, featured):
    """300 trees of depth 6 fitted on the training rows; the queries of a session that need them share one fit."""
    key = spark.sparkContext.applicationId, sf
    if key not in _FORESTS:
        _FORESTS[key] = boosting.fit(featured.filter("split = 'train'"), features.FEATURES)
    return _FORESTS[key]


@query("gbt_holdout")
def gbt_holdout(spark, sf):
    """Boosted trees on the 52 features; metrics per split."""
    featured = _featured(spark, sf)
    return _report(boosting.score(featured, _forest(spark, sf, featured)))


@query("baseline_report")
def baseline_report(spark, sf):
    """The three baselines trained from one feature table, in one long report: model, split, metric, value."""
    featured = _featured(spark, sf)
    scored = {"logistic": _lr_scored(featured)[0], "svm": _svm_scored(featured)[0],
              "trees": boosting.score(featured, _forest(spark, sf, featured))}
    tables = {name: _report(rows) for name, rows in scored.items()}
    return evaluate.report_long(tables, {name: "split" for name in tables}).withColumnsRenamed({"section": "model", "slice": "split"})


def _labelled(spark, sf):
    """Labelled mail of the real sources, their names in order (one row per source), and the inner split."""
    mail = splits.loso_assign(A.mail_docs(spark, sf).filter("label is not null"))
    return mail, sorted(r[0] for r in mail.select("held_out_fold").distinct().collect())


def _source_columns(rows, sources, member):
    """``use``, ``val_use`` (weight of a row in each fold) and ``place``, the position of its source."""
    place = F.array_position(F.lit(sources).cast("array<string>"), F.col("held_out_fold")).cast("int") - 1
    def weights(part):
        return F.transform(F.sequence(F.lit(0), F.lit(len(sources) - 1)), lambda f: (member(f, F.col("place")) & (F.col("inner_split") == part)).cast("double"))
    return (rows.withColumn("place", place).withColumn("use", weights("train")).withColumn("val_use", weights("val"))
            .withColumn("label", F.col("label").cast("double")))


_OTHERS, _OWN = (lambda f, place: f != place), (lambda f, place: f == place)
_TEXT_FEATURES = features.LEXICAL + features.STRUCTURAL


def _source_stack(spark, sf, member):
    mail, sources = _labelled(spark, sf)
    keep = ["sample_id", "held_out_fold", "inner_split", "label"]
    rows = models.compact(features.feature_table(mail, ["lexical", "structural"], keep))
    rows = _source_columns(_standard_columns(rows, _TEXT_FEATURES, "inner_split = 'train'"), sources, member)
    dense = stacked.dense_rows(rows, _TEXT_FEATURES, F.col("use"), [*keep, "place", "val_use"])
    return stacked.standardized(stacked.stack(dense, len(_TEXT_FEATURES), len(sources))), sources


def _chosen(best, n_grid, place):
    """Margin of the chosen C of a fold."""
    at = F.lit([int(f * n_grid + c + 1) for f, c in enumerate(best)]).cast("array<int>")
    return F.element_at(F.col("z"), F.element_at(at, place + 1))


@query("loso_lr")
def loso_lr(spark, sf):
    """One model per held-out source on text features: trained on the other sources, C from their validation rows, tested on
    it. All sources and values of C are fitted together."""
    s, _ = _source_stack(spark, sf, _OTHERS)
    _, scored, best = _best_lr(s)
    scored = _with_prob(scored, _chosen(best, len(models.C_GRID), F.col("place")))
    return metrics.all_metrics(scored.select("held_out_fold", "label", "pred", "prob"), ["held_out_fold"])


@query("transfer_lr")
def transfer_lr(spark, sf):
    """ROC-AUC on every source of a model trained on every source (its own training and validation rows); a model's own
    source is judged by its validation rows."""
    s, sources = _source_stack(spark, sf, _OWN)
    _, scored, best = _best_lr(s)
    z = F.transform(F.sequence(F.lit(0), F.lit(len(sources) - 1)), lambda f: _chosen(best, len(models.C_GRID), f))
    pairs = scored.select("label", "inner_split", F.col("held_out_fold").alias("eval_source"), "place", F.posexplode(z).alias("model", "margin"))
    pairs = pairs.filter("model <> place or inner_split = 'val'").select(
        F.element_at(F.lit(sources).cast("array<string>"), F.col("model") + 1).alias("train_source"), "eval_source",
        F.col("label").cast("int").alias("label"), stacked.probability(F.col("margin")).alias("prob"))
    return evaluate.transfer_scores(pairs)


_LOSO_TERMS = dict(
    t=f"""SELECT sample_id, dataset_id AS source, coalesce(subject, '') || ' ' || coalesce(body, '') AS text FROM mail_docs
  WHERE label IS NOT NULL AND trim(dataset_id) <> '' AND NOT ({unit("'42:loso:' || sample_id")} < 0.15)""",
    w=r"SELECT sample_id, source, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS ws FROM t",
    g="""SELECT sample_id, source, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM w""",
    c="SELECT sample_id, source, term, count(*) AS tf FROM g GROUP BY ALL",
    f="SELECT x.source AS fold, term, count(*) AS df, sum(tf)::BIGINT AS cf FROM c JOIN (SELECT DISTINCT source FROM t) x ON c.source <> x.source GROUP BY ALL HAVING count(*) >= 2")


def _source_terms(rows, terms):
    return models.compact(grams.term_totals(rows.filter("inner_split = 'train'"), terms, "held_out_fold"))


@query("loso_vocabulary", ctes("mail_docs", **_LOSO_TERMS) + """SELECT fold, term, df, cf FROM (
  SELECT *, row_number() OVER (PARTITION BY fold ORDER BY cf DESC, term) AS r FROM f) WHERE r <= 20000""")
def loso_vocabulary(spark, sf):
    """The word vocabulary of every fold, from the counts of the sources: totals minus the held-out one."""
    mail, sources = _labelled(spark, sf)
    return vectorize.complement_vocabulary(_source_terms(mail.withColumn("t", _subject_body()), grams.words(F.col("t"))), sources)


def _fold_terms(rows, sources, terms, per_fold, n_max):
    """(term, idx) of the terms of any fold, and the idf of each in each fold (0 where it is not in the vocabulary)."""
    vocab = models.compact(vectorize.complement_vocabulary(_source_terms(rows, terms), sources, 2, n_max))
    index = vocab.select("term").distinct().withColumn("idx", F.row_number().over(Window.orderBy("term")) - 1)      # folds x n_max terms at most
    index = models.compact(index)
    size = index.count()
    scale = np.zeros((size, len(sources)))
    # a column per fold on the driver, as the weights are: at most n_max terms each
    for r in vocab.join(index, "term").select("fold", "idx", "df").toLocalIterator():
        f = sources.index(r["fold"])
        scale[r["idx"], f] = math.log((1 + per_fold[f]) / (1 + r["df"])) + 1
    return index, scale


@query("loso_tfidf_lr")
def loso_tfidf_lr(spark, sf):
    """The same on word and character TF-IDF of 20,000 terms each. Every fold has the vocabulary and idf of its training
    sources; term counts are stored once and each fold's weights are formed in the pass."""
    mail, sources = _labelled(spark, sf)
    rows = models.compact(mail.select("sample_id", "held_out_fold", "inner_split", "label", _subject_body().alias("t")))
    sizes = {r[0]: r[1] for r in rows.filter("inner_split = 'train'").groupBy("held_out_fold").count().collect()}      # one row per source
    per_fold = [sum(sizes.values()) - sizes.get(x, 0) for x in sources]
    words, chars = grams.words(F.col("t")), grams.chars(F.col("t"))
    word_index, word_scale = _fold_terms(rows, sources, words, per_fold, 20000)
    char_index, char_scale = _fold_terms(rows, sources, chars, per_fold, 20000)
    packed = grams.term_rows(rows, [(words, word_index), (chars, char_index)], weighted=False)
    none = F.array()
    keyed = _source_columns(rows.drop("t"), sources, _OTHERS).join(packed, "sample_id", "left").withColumns({
        "idx": F.coalesce("idx", none.cast("array<int>")), "val": F.coalesce("val", none.cast("array<double>"))})
    s = stacked.stack(keyed, len(word_scale) + len(char_scale), len(sources), np.vstack([word_scale, char_scale]), (0, len(word_scale)))
    _, scored, best = _best_lr(s)
    scored = _with_prob(scored, _chosen(best, len(models.C_GRID), F.col("place")))
    return metrics.all_metrics(scored.select("held_out_fold", "label", "pred", "prob"), ["held_out_fold"])


@query("linear_attribution")
def linear_attribution(spark, sf):
    """Mean absolute contribution of each feature to the logistic baseline (C from the full grid)."""
    featured = _featured(spark, sf)
    s = _holdout_stack(featured, features.FEATURES)
    weights, _, best = _best_lr(s)
    rows = _standard_columns(featured, features.FEATURES)
    own = weights[:-1, 0, best[0]] * s.scale[:, 0]
    return attribution.linear_attribution(rows, dict(zip(features.FEATURES, own)), rows.filter("split = 'train'"))


def _explained(spark, sf):
    featured = _featured(spark, sf)
    forest = _forest(spark, sf, featured)
    return boosting.shapley(boosting.score(featured, forest), forest), forest


@query("tree_importance")
def tree_importance(spark, sf):
    """Mean absolute Shapley value of each feature over all mails."""
    rows, forest = _explained(spark, sf)
    return attribution.rank_importance(boosting.long_contributions(rows, forest).groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance")))


@query("tree_attribution")
def tree_attribution(spark, sf):
    """What each feature adds to the margin of each mail under the boosted trees."""
    rows, forest = _explained(spark, sf)
    return boosting.long_contributions(rows, forest, ["sample_id", "margin"]).withColumn("expected_margin", F.lit(boosting.expected(forest)))


@query("feature_ablation")
def feature_ablation(spark, sf):
    """Metrics of the logistic baseline with one feature group left out at a time, C chosen for each; all fitted together."""
    sets = models.ablation_columns()
    mask = np.array([[float(c in columns) for columns in sets.values()] for c in features.FEATURES])
    _, scored, best = _best_lr(_holdout_stack(_featured(spark, sf), features.FEATURES, len(sets), mask))
    tables, n = {}, len(models.C_GRID)
    for f, name in enumerate(sets):
        own = _with_prob(scored.filter("split <> 'train'"), F.col("z")[f * n + int(best[f])])
        tables[name] = metrics.all_metrics(own.select("label", "pred", "prob"))
    return evaluate.report_long(tables, {})


@query("source_probe")
def source_probe(spark, sf):
    """How well the text features give away the source a mail comes from."""
    mail = splits.group_split(A.mail_docs(spark, sf), "sample_id")
    rows = features.feature_table(mail, ["lexical", "structural"], ["sample_id", "dataset_id", "split"])
    return models.source_probe(models.dense_features(models.compact(rows), features.LEXICAL + features.STRUCTURAL))
