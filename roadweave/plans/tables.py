"""Registered queries on candidate groups, labelled scores and result tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import table
from ..functions.numeric import UNIT_HASH_SQL
from ..operators import aggregates, calibrate, costs, datasets, joins, models, ranking
from ..sources import io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


ROWS = """rows_ AS (SELECT l_orderkey AS anchor_id, CAST(l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS BIGINT) AS candidate_id, CAST(l_extendedprice AS DOUBLE) / 10000 AS cost, CAST(l_discount AS DOUBLE) AS base, CAST(l_quantity AS DOUBLE) AS gap,
  CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END AS label, l_suppkey AS gt_id FROM lineitem)"""


def rows(spark, d):
    """Anchor and candidate rows: an order and its lines."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("anchor_id"), (F.col("l_partkey") * 100000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("candidate_id"), (F.col("l_extendedprice").cast("double") / 10000).alias("cost"), F.col("l_discount").cast("double").alias("base"),
        F.col("l_quantity").cast("double").alias("gap"), F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0).alias("label"), F.col("l_suppkey").alias("gt_id"))


SCORES = """scores AS (SELECT doc_id, quality AS label, (n_chars * 7 + toxic * 131) % 1000 / 1000.0::DOUBLE AS p, CAST(n_chars AS DOUBLE) AS n_chars, CAST(n_chars % 97 AS DOUBLE) AS rest, lang AS scenario FROM labels JOIN documents USING (doc_id))"""


def scores(spark, d):
    """Labelled scores: a number derived from each labelled document."""
    m = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    return m.select("doc_id", F.col("quality").alias("label"), ((F.col("n_chars") * 7 + F.col("toxic") * 131) % 1000 / 1000).alias("p"), F.col("n_chars").cast("double").alias("n_chars"), (F.col("n_chars") % 97).cast("double").alias("rest"), F.col("lang").alias("scenario"))


@query(f"WITH {ROWS} SELECT anchor_id, arg_min(candidate_id, (cost, candidate_id)) AS candidate_id, round(min(cost), 6) AS cost FROM rows_ GROUP BY anchor_id")
def top_candidate(spark, d):
    return ranking.top_candidate(rows(spark, d)).withColumn("cost", r6("cost"))


@query(f"WITH {ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY coalesce(label = 1, false) DESC, {UNIT_HASH_SQL.format('anchor_id, candidate_id', 0)}, candidate_id) AS rn FROM rows_) SELECT anchor_id, candidate_id, label FROM r WHERE rn <= 3")
def cap_group(spark, d):
    return ranking.cap_group(rows(spark, d), 3).select("anchor_id", "candidate_id", "label")


@query(f"WITH {ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY cost, candidate_id) AS rn FROM rows_) SELECT anchor_id, candidate_id FROM r WHERE rn <= 2")
def cap_group_cheapest(spark, d):
    return ranking.cap_group(rows(spark, d), 2, "cheapest").select("anchor_id", "candidate_id")


@query(f"WITH {ROWS}, u AS (SELECT *, {UNIT_HASH_SQL.format('anchor_id, candidate_id', 0)} AS u FROM rows_), l AS (SELECT *, coalesce(min(label) OVER (PARTITION BY anchor_id) <> max(label) OVER (PARTITION BY anchor_id) AND label IS NOT NULL AND row_number() OVER (PARTITION BY anchor_id, label ORDER BY u, candidate_id) = 1, false) AS lead FROM u), r AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY lead DESC, u, candidate_id) AS rn FROM l) SELECT anchor_id, candidate_id, label FROM r WHERE rn <= 3")
def cap_group_one_of_each(spark, d):
    return ranking.cap_group(rows(spark, d), 3, "one_of_each").select("anchor_id", "candidate_id", "label")


@query(f"WITH {ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY cost, candidate_id) - 1 AS rn, count(*) OVER (PARTITION BY anchor_id) AS n FROM rows_) SELECT anchor_id, candidate_id FROM r WHERE rn >= n // 4 AND rn < greatest(n // 4 + 1, 3 * n // 4)")
def middle_slice(spark, d):
    return ranking.middle_slice(rows(spark, d), "anchor_id", "cost").select("anchor_id", "candidate_id")


@query(f"WITH {ROWS}, p AS (SELECT anchor_id, min(cost) AS pos FROM rows_ WHERE label = 1 GROUP BY anchor_id), n AS (SELECT anchor_id, candidate_id, cost - pos AS d, {UNIT_HASH_SQL.format('anchor_id, candidate_id', 0)} AS u FROM rows_ JOIN p USING (anchor_id) WHERE label = 0), has AS (SELECT anchor_id, bool_or(d > 0 AND d < 0.8) AS soft, bool_or(d <= 0) AS hard FROM n GROUP BY anchor_id), r AS (SELECT n.*, soft, hard, row_number() OVER (PARTITION BY anchor_id, (d > 0 AND d < 0.8), (d <= 0) ORDER BY d, candidate_id) AS near, row_number() OVER (PARTITION BY anchor_id ORDER BY u, candidate_id) AS any_ FROM n JOIN has USING (anchor_id)) SELECT anchor_id, candidate_id, CASE WHEN soft THEN 0 WHEN hard THEN 1 ELSE 2 END AS tier FROM r WHERE CASE WHEN soft THEN d > 0 AND d < 0.8 AND near <= 2 WHEN hard THEN d <= 0 AND near <= 2 ELSE any_ = 1 END")
def semi_hard_negatives(spark, d):
    return ranking.semi_hard_negatives(rows(spark, d), 0.5, 2).select("anchor_id", "candidate_id", "tier")


@query(f"WITH {ROWS}, r AS (SELECT anchor_id, row_number() OVER (PARTITION BY anchor_id ORDER BY cost, candidate_id)::DOUBLE AS a, row_number() OVER (PARTITION BY anchor_id ORDER BY base, candidate_id)::DOUBLE AS b FROM rows_) SELECT anchor_id, round(coalesce(CASE WHEN count(*) > 1 THEN corr(a, b) END, 0.0), 6) AS rho, count(*) AS n FROM r GROUP BY anchor_id")
def rank_correlation(spark, d):
    return ranking.rank_correlation(rows(spark, d), "cost", "base").withColumn("rho", r6("rho"))


@query(f"WITH {ROWS} SELECT anchor_id, candidate_id, round(cost, 6) AS cost FROM rows_ ORDER BY cost DESC, anchor_id LIMIT 25")
def top_n(spark, d):
    return ranking.top_n(rows(spark, d), 25, "cost", "anchor_id").select("anchor_id", "candidate_id", r6("cost").alias("cost"))


OUTCOMES = f"""{ROWS}, o AS (SELECT anchor_id, count(*) AS n, min(CASE WHEN label = 1 THEN gap END) AS min_positive_gap, arg_min(label, (base, candidate_id)) = 1 AS base_correct, arg_min(label, (cost, candidate_id)) = 1 AS other_correct
  FROM rows_ WHERE label IS NOT NULL GROUP BY anchor_id HAVING count(*) >= 2 AND max(label) = 1 AND min(label) = 0)"""
METRICS = """count(*) AS n, round(avg((NOT base_correct)::INT), 6) AS base_error, round(avg((NOT other_correct)::INT), 6) AS other_error,
  round(coalesce(sum((NOT base_correct AND other_correct)::INT) / nullif(sum((NOT base_correct)::INT), 0), 0.0), 6) AS recovery, round(coalesce(sum((base_correct AND NOT other_correct)::INT) / nullif(sum(base_correct::INT), 0), 0.0), 6) AS regression"""


def _outcomes(spark, d):
    return ranking.anchor_outcomes(rows(spark, d), {"base": "base", "other": "cost"})


@query(f"WITH {OUTCOMES} SELECT * FROM o")
def anchor_outcomes(spark, d):
    return _outcomes(spark, d)


@query(f"WITH {OUTCOMES}, m AS (SELECT {METRICS} FROM o) SELECT *, CASE WHEN recovery >= 0.15 AND regression <= 0.05 AND other_error <= base_error THEN 'continue' ELSE 'pivot' END AS decision FROM m")
def anchor_metrics(spark, d):
    m = ranking.audit_decision(ranking.anchor_metrics(_outcomes(spark, d), "base", "other"))
    return m.select("n", *(r6(c).alias(c) for c in ("base_error", "other_error", "recovery", "regression")), "decision")


@query(f"""WITH {OUTCOMES}, k(slice, bucket) AS (VALUES ('gap', '0-2'), ('gap', '2-5'), ('gap', '5-15'), ('gap', 'other'), ('candidates', '2'), ('candidates', '3-4'), ('candidates', '5+')),
b AS (SELECT *, 'gap' AS slice, CASE WHEN min_positive_gap < 2 THEN '0-2' WHEN min_positive_gap < 5 THEN '2-5' WHEN min_positive_gap < 15 THEN '5-15' ELSE 'other' END AS bucket FROM o UNION ALL SELECT *, 'candidates', CASE WHEN n = 2 THEN '2' WHEN n <= 4 THEN '3-4' ELSE '5+' END FROM o),
m AS (SELECT slice, bucket, {METRICS} FROM b GROUP BY slice, bucket) SELECT slice, bucket, coalesce(n, 0) AS n, base_error, other_error FROM k LEFT JOIN m USING (slice, bucket)""")
def sliced_metrics(spark, d):
    return ranking.sliced_metrics(_outcomes(spark, d), "base", "other").select("slice", "bucket", "n", r6("base_error").alias("base_error"), r6("other_error").alias("other_error"))


@query(f"""WITH {ROWS}, k AS (SELECT * FROM rows_ WHERE label IS NOT NULL AND anchor_id IN (SELECT anchor_id FROM rows_ WHERE label IS NOT NULL GROUP BY anchor_id HAVING count(*) >= 2 AND min(label) = 0 AND max(label) = 1)),
w AS (SELECT p.anchor_id, count(*) FILTER (WHERE p.cost < n.cost) AS won, count(*) AS pairs FROM k p JOIN k n ON p.anchor_id = n.anchor_id AND p.label = 1 AND n.label = 0 GROUP BY p.anchor_id),
t AS (SELECT anchor_id, (arg_min(label, (cost, candidate_id)) = 1)::INT AS top1 FROM k GROUP BY anchor_id),
r AS (SELECT anchor_id, row_number() OVER (PARTITION BY anchor_id ORDER BY cost, candidate_id)::DOUBLE AS a, row_number() OVER (PARTITION BY anchor_id ORDER BY base, candidate_id)::DOUBLE AS b FROM k), c AS (SELECT anchor_id, coalesce(corr(a, b), 0.0) AS rho FROM r GROUP BY anchor_id)
SELECT count(*) AS anchors, round(sum(won) / sum(pairs), 6) AS pairwise, round(avg(top1), 6) AS top1, round(avg(rho), 6) AS spearman FROM w JOIN t USING (anchor_id) JOIN c USING (anchor_id)""")
def ranking_gate(spark, d):
    return ranking.ranking_gate(rows(spark, d)).select("anchors", *(r6(c).alias(c) for c in ("pairwise", "top1", "spearman")))


@query(f"WITH {OUTCOMES}, bad AS (SELECT anchor_id FROM o WHERE NOT other_correct) SELECT anchor_id, candidate_id, label FROM rows_ WHERE anchor_id IN (SELECT anchor_id FROM bad) ORDER BY anchor_id, candidate_id LIMIT 100")
def error_examples(spark, d):
    return ranking.error_examples(rows(spark, d), _outcomes(spark, d).filter("NOT other_correct")).select("anchor_id", "candidate_id", "label")


@query(f"WITH {ROWS} SELECT anchor_id, count(*) AS n, bool_or(label IS NOT NULL) AS has_any_gt, coalesce(bool_or(label = 1), false) AS has_pos, coalesce(bool_or(label = 0), false) AS has_neg, min(gt_id) AS gt_id FROM rows_ GROUP BY anchor_id HAVING count(*) BETWEEN 2 AND 80")
def anchor_meta(spark, d):
    return aggregates.anchor_meta(rows(spark, d))


@query(f"WITH {ROWS}, s AS (SELECT *, CASE WHEN {UNIT_HASH_SQL.format('gt_id', 0)} < 0.2 THEN 'val' ELSE 'train' END AS candidate_side, CASE WHEN anchor_id % 5 = 0 THEN 'val' ELSE 'train' END AS side FROM rows_) SELECT anchor_id, candidate_id, CASE WHEN candidate_side = side THEN label END AS label FROM s")
def mask_cross_labels(spark, d):
    r = rows(spark, d).withColumn("side", F.when(F.col("anchor_id") % 5 == 0, "val").otherwise("train")).withColumnRenamed("gt_id", "candidate_gt_id")
    split = joins.vehicle_split(rows(spark, d).select("gt_id"), 0.2)
    return joins.mask_cross_labels(r, split).select("anchor_id", "candidate_id", "label")


@query(f"WITH {ROWS} SELECT anchor_id, candidate_id, round(CASE WHEN cost > 3.0 OR base = 0 THEN cost ELSE base END, 6) AS cost FROM rows_")
def gate_rank_cost(spark, d):
    rank = F.when(F.col("base") != 0, F.col("base")).otherwise(F.lit(float("nan")))
    return rows(spark, d).select("anchor_id", "candidate_id", r6(costs.gate_rank_cost(F.col("cost"), rank)).alias("cost"))


@query(f"WITH {SCORES} SELECT doc_id, round((1 - p) * 5 + 0.1 * rest, 6) AS linear, round(5 - ln(greatest(1e-6, least(1 - 1e-6, p)) / (1 - greatest(1e-6, least(1 - 1e-6, p)))) + 0.1 * rest, 6) AS logit FROM scores")
def logistic_cost(spark, d):
    p, g = F.col("p"), F.col("rest")
    return scores(spark, d).select("doc_id", r6(costs.logistic_cost(p, g)).alias("linear"), r6(costs.logistic_cost(p, g, mode="logit")).alias("logit"))


@query(f"WITH {SCORES}, q AS (SELECT *, greatest(1e-6, least(1 - 1e-6, p)) AS q FROM scores) SELECT doc_id, round((1 - q) * 5, 6) AS linear, round(pow(1 - q, 2) * 5 + 0.1 * rest, 6) AS power, round((1 - q) / q * 5, 4) AS odds, round(ln(1 + exp(p)), 6) AS direct FROM scores JOIN q USING (doc_id, p, rest)")
def score_to_cost(spark, d):
    p = F.col("p")
    return scores(spark, d).select("doc_id", r6(costs.score_to_cost(p)).alias("linear"), r6(costs.score_to_cost(p, F.col("rest"), "power")).alias("power"), F.round(costs.score_to_cost(p, mode="odds"), 4).alias("odds"), r6(costs.score_to_cost(p, mode="direct")).alias("direct"))


@query(f"WITH {SCORES} SELECT doc_id, round(CASE WHEN p <= 0.1 THEN 0 WHEN p <= 0.5 THEN (p - 0.1) * 5 WHEN p <= 0.9 THEN 2 + (p - 0.5) * 20 ELSE 10 END, 6) AS cost FROM scores")
def apply_calibration(spark, d):
    return scores(spark, d).select("doc_id", r6(costs.apply_calibration(F.col("p"), [(0.1, 0.0), (0.5, 2.0), (0.9, 10.0)])).alias("cost"))


@query("SELECT vec_id, round(((embedding[1] / 0.5)^2 + ((embedding[2] - 0.1 * embedding[1] / 0.5) / 0.7)^2) / 2, 5) AS z2 FROM embeddings")
def mahalanobis_score(spark, d):
    e = table(spark, d, "embeddings")
    z, _ = costs.mahalanobis_score(F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double"), F.lit(0.5), F.lit(0.1), F.lit(0.7))
    return e.select("vec_id", F.round(z, 5).alias("z2"))


CONFUSION = "count(*) FILTER (WHERE label = 1 AND p >= 0.5) AS tp, count(*) FILTER (WHERE label = 0 AND p >= 0.5) AS fp, count(*) FILTER (WHERE label = 0 AND p < 0.5) AS tn, count(*) FILTER (WHERE label = 1 AND p < 0.5) AS fn"


@query(f"WITH {SCORES}, c AS (SELECT {CONFUSION}, avg(pow(p - label, 2)) AS brier, avg(-CASE WHEN label = 1 THEN ln(greatest(1e-15, p)) ELSE ln(1 - p) END) AS log_loss FROM scores) SELECT tp, fp, tn, fn, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy FROM c")
def classification_metrics(spark, d):
    m = calibrate.classification_metrics(scores(spark, d))
    return m.select("tp", "fp", "tn", "fn", *(r6(c).alias(c) for c in ("brier", "log_loss", "precision", "recall", "f1", "accuracy")))


CURVE = f"{SCORES}, per AS (SELECT p, sum(label) AS a, sum(1 - label) AS b FROM scores GROUP BY p), cum AS (SELECT p, a, b, sum(a) OVER w AS tp, sum(b) OVER w AS fp, sum(a) OVER () AS ap, sum(b) OVER () AS an FROM per WINDOW w AS (ORDER BY p DESC)), roc AS (SELECT p AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, tp / ap AS tpr, fp / an AS fpr, tp / (tp + fp) AS precision FROM cum)"


@query(f"WITH {CURVE} SELECT round(threshold, 6) AS threshold, tp, fp, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM roc")
def roc_curve(spark, d):
    return calibrate.roc_curve(scores(spark, d), "p").select(r6("threshold").alias("threshold"), "tp", "fp", r6("tpr").alias("tpr"), r6("fpr").alias("fpr"))


@query(f"WITH {CURVE} SELECT round(sum(b * (tp - a / 2.0)) / (max(ap) * max(an)), 6) AS auc, round(sum(a * tp / (tp + fp)) / max(ap), 6) AS average_precision FROM cum")
def roc_auc(spark, d):
    return calibrate.roc_auc(scores(spark, d), "p").select(r6("auc").alias("auc"), r6("average_precision").alias("average_precision"))


BINS = f"{SCORES}, b AS (SELECT CAST(greatest(0, ceil(p * 10) - 1) AS INTEGER) AS bin, count(*) AS n, avg(p) AS confidence, avg(label) AS accuracy FROM scores GROUP BY 1)"


@query(f"WITH {BINS} SELECT CAST(r.bin AS INTEGER) AS bin, coalesce(n, 0) AS n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM range(10) r(bin) LEFT JOIN b ON b.bin = r.bin")
def calibration_bins(spark, d):
    return calibrate.calibration_bins(scores(spark, d)).select("bin", "n", r6("confidence").alias("confidence"), r6("accuracy").alias("accuracy"))


@query(f"WITH {BINS} SELECT round(sum(n * abs(accuracy - confidence)) / sum(n), 6) AS ece FROM b")
def expected_calibration_error(spark, d):
    return calibrate.expected_calibration_error(scores(spark, d)).select(r6("ece").alias("ece"))


UNPIVOT = f"{SCORES}, u AS (SELECT label, 'p' AS feature, p AS value FROM scores UNION ALL SELECT label, 'n_chars', n_chars FROM scores UNION ALL SELECT label, 'rest', rest FROM scores), per AS (SELECT feature, value, sum(label) AS a, sum(1 - label) AS b FROM u GROUP BY ALL), cum AS (SELECT *, sum(a) OVER w AS tp, sum(b) OVER w AS fp, sum(a) OVER (PARTITION BY feature) AS ap, sum(b) OVER (PARTITION BY feature) AS an FROM per WINDOW w AS (PARTITION BY feature ORDER BY value DESC))"
FEATURES = ("p", "n_chars", "rest")


@query(f"WITH {UNPIVOT}, z AS (SELECT feature, sum(b * (tp - a / 2.0)) / (max(ap) * max(an)) AS auc FROM cum GROUP BY feature) SELECT feature, round(greatest(auc, 1 - auc), 6) AS auc FROM z")
def feature_auc(spark, d):
    return calibrate.feature_auc(scores(spark, d), FEATURES).withColumn("auc", r6("auc"))


@query(f"WITH {UNPIVOT}, r AS (SELECT feature, abs(corr(value, label)) AS r FROM u GROUP BY feature), k AS (SELECT feature, max(abs(tp / ap - fp / an)) AS ks FROM cum GROUP BY feature) SELECT feature, round(r, 6) AS r, round(ks, 6) AS ks, round(0.5 * r + 0.5 * ks, 6) AS risk FROM r JOIN k USING (feature)")
def shortcut_risk(spark, d):
    s = calibrate.shortcut_risk(scores(spark, d), FEATURES)
    return s.select("feature", *(r6(c).alias(c) for c in ("r", "ks", "risk")))


@query(f"WITH {SCORES}, q AS (SELECT quantile_cont(p, 0.005) AS lo, quantile_cont(p, 0.995) AS hi FROM scores), i AS (SELECT label, least(floor((p - lo) / (hi - lo) * 50), 49) AS b FROM scores, q WHERE p BETWEEN lo AND hi), h AS (SELECT b, sum(label) AS a, sum(1 - label) AS z FROM i GROUP BY b), o AS (SELECT sum(least(a / (SELECT sum(label) FROM i), z / (SELECT sum(1 - label) FROM i))) AS overlap FROM h) SELECT round(overlap, 6) AS overlap, round((SELECT abs(avg(p) FILTER (WHERE label = 1) - avg(p) FILTER (WHERE label = 0)) / sqrt(((sum(label) - 1) * var_pop(p) FILTER (WHERE label = 1) + (sum(1 - label) - 1) * var_pop(p) FILTER (WHERE label = 0)) / (count(*) - 2)) FROM scores), 6) AS cohens_d FROM o")
def histogram_overlap(spark, d):
    return calibrate.histogram_overlap(scores(spark, d), "p", bins=50).select(r6("overlap").alias("overlap"), r6("cohens_d").alias("cohens_d"))


@query(f"WITH {CURVE} SELECT 'youden' AS strategy, round(max(tpr - fpr), 6) AS best FROM roc UNION ALL SELECT 'fpr_ceiling', round(max(tpr) FILTER (WHERE fpr <= 0.2), 6) FROM roc")
def choose_threshold(spark, d):
    roc = calibrate.roc_curve(scores(spark, d), "p")
    a, b = calibrate.choose_threshold(roc, "youden"), calibrate.choose_threshold(roc, "fpr_ceiling", 0.2)
    return a.select("strategy", r6(F.col("tpr") - F.col("fpr")).alias("best")).union(b.select("strategy", r6("tpr").alias("best")))


_BEST = "SELECT '{0}' AS strategy, arg_max(threshold, (({2})::INT, round(CASE WHEN {2} THEN {1} WHEN '{0}' <> 'fpr_ceiling' THEN precision WHEN fpr > 0 THEN -fpr ELSE -1e9 END, 9), threshold)) AS threshold FROM roc"
_F = "coalesce((1 + {0}) * precision * tpr / nullif({0} * precision + tpr, 0), 0.0)"
_CHOICES = [("youden", "tpr - fpr", "true"), ("fpr_ceiling", "tpr", "fpr <= 0.05"), ("fpr_ceiling", "tpr", "fpr <= 0.2"), ("fpr_ceiling", "tpr", "fpr <= -1"), ("precision_floor", "tpr", "precision >= 0.9"), ("f_beta", _F.format(0.1**2), "true"), ("f_beta", _F.format(0.5**2), "true")]


@query(f"WITH {CURVE}, c AS ({' UNION ALL '.join(_BEST.format(*x) for x in _CHOICES)}) SELECT round(threshold, 6) AS threshold, array_to_string(list_sort(list_distinct(list(strategy))), ',') AS strategies FROM c GROUP BY threshold")
def threshold_candidates(spark, d):
    roc = calibrate.roc_curve(scores(spark, d), "p")
    values = [("youden", None), ("fpr_ceiling", 0.05), ("fpr_ceiling", 0.2), ("fpr_ceiling", -1.0), ("precision_floor", 0.9), ("f_beta", 0.1), ("f_beta", 0.5)]
    return calibrate.threshold_candidates(roc, values).withColumn("threshold", r6("threshold"))


@query(f"WITH {ROWS}, r AS (SELECT *, CAST(anchor_id % 3 AS INTEGER) AS scenario FROM rows_) SELECT scenario, count(*) AS n, round(avg(cost) FILTER (WHERE label = 1), 6) AS pos_mean, round(avg(cost) FILTER (WHERE label = 0), 6) AS neg_mean, round(avg(cost) FILTER (WHERE label = 0) - avg(cost) FILTER (WHERE label = 1), 6) AS margin, count(*) FILTER (WHERE label = 0 AND cost <= 3) AS false_edges, count(*) FILTER (WHERE label = 1 AND cost <= 3) AS true_edges FROM r GROUP BY scenario")
def calibration_report(spark, d):
    r = calibrate.calibration_report(rows(spark, d).withColumn("scenario", (F.col("anchor_id") % 3).cast("int")), 3.0)
    return r.select("scenario", "n", *(r6(c).alias(c) for c in ("pos_mean", "neg_mean", "margin")), "false_edges", "true_edges")


@query(f"WITH {ROWS} SELECT label, count(*) AS n, round(min(cost), 6) AS min, " + ", ".join(f"round(quantile_cont(cost, {q}), 6) AS p{n}" for n, q in ((5, .05), (25, .25), (50, .5), (75, .75), (95, .95))) + ", round(max(cost), 6) AS max FROM rows_ GROUP BY label")
def separation_report(spark, d):
    s = calibrate.separation_report(rows(spark, d))
    return s.select("label", "n", *(r6(c).alias(c) for c in ("min", "p5", "p25", "p50", "p75", "p95", "max")))


@query(f"WITH {ROWS}, t AS (SELECT * FROM rows_, (VALUES (1.0::DOUBLE), (3.0::DOUBLE), (5.0::DOUBLE)) v(threshold) WHERE label IS NOT NULL) SELECT threshold, count(*) FILTER (WHERE label = 1 AND cost <= threshold) AS tp, count(*) FILTER (WHERE label = 0 AND cost <= threshold) AS fp, round(count(*) FILTER (WHERE label = 1 AND cost <= threshold) / sum(label), 6) AS tpr, round(avg(threshold - cost) FILTER (WHERE label = 1 AND cost <= threshold), 6) AS margin FROM t GROUP BY threshold")
def threshold_sweep(spark, d):
    s = calibrate.threshold_sweep(rows(spark, d).filter("label is not null"), (1.0, 3.0, 5.0))
    return s.select("threshold", "tp", "fp", r6("tpr").alias("tpr"), r6("margin").alias("margin"))


@query(f"WITH {ROWS} SELECT round(greatest(min(cost) FILTER (WHERE label = 1), min(cost) FILTER (WHERE label = 0)), 6) AS lo, round(least(max(cost) FILTER (WHERE label = 1), max(cost) FILTER (WHERE label = 0)), 6) AS hi FROM rows_")
def overlap_zone(spark, d):
    return calibrate.overlap_zone(rows(spark, d)).select(r6("lo").alias("lo"), r6("hi").alias("hi"))


@query(f"""WITH {ROWS}, q AS (SELECT s.share, quantile_cont(r.cost, [0.9, 0.95, 0.99])[s.i] AS threshold FROM rows_ r, (VALUES (1, 0.9::DOUBLE), (2, 0.95::DOUBLE), (3, 0.99::DOUBLE)) s(i, share) WHERE r.label = 1 GROUP BY s.i, s.share)
SELECT share, round(threshold, 6) AS threshold, count(*) FILTER (WHERE label = 1 AND cost <= threshold) AS tp, count(*) FILTER (WHERE label = 0 AND cost <= threshold) AS fp, round(count(*) FILTER (WHERE label = 0 AND cost <= threshold) / count(*) FILTER (WHERE label = 0), 6) AS fpr,
  round(avg(threshold - cost) FILTER (WHERE label = 1 AND cost <= threshold), 6) AS margin FROM rows_, q WHERE label IS NOT NULL GROUP BY share, threshold""")
def positive_thresholds(spark, d):
    p = calibrate.positive_thresholds(rows(spark, d))
    return p.select("share", r6("threshold").alias("threshold"), "tp", "fp", r6("fpr").alias("fpr"), r6("margin").alias("margin"))


@query(f"""WITH {ROWS}, fit AS (SELECT base AS x, cost AS y FROM rows_ WHERE cost BETWEEN 0 AND 10), q AS (SELECT unnest(quantile_cont(x, [i / 100 FOR i IN range(101)])) AS kx, unnest(quantile_cont(y, [i / 100 FOR i IN range(101)])) AS ky, unnest(range(101)) AS i FROM fit),
k AS (SELECT kx, arg_min(ky, i) AS ky FROM q GROUP BY kx), s AS (SELECT kx, ky, lead(kx) OVER (ORDER BY kx) AS nx, lead(ky) OVER (ORDER BY kx) AS ny FROM k),
m AS (SELECT x, y, CASE WHEN nx IS NULL THEN ky ELSE ky + (ny - ky) * (x - kx) / (nx - kx) END AS c FROM fit ASOF JOIN s ON fit.x >= s.kx),
r AS (SELECT *, rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2 AS rc, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM m)
SELECT count(*) AS n, round(avg(abs(x - y)), 6) AS mae_raw, round(avg(abs(c - y)), 6) AS mae, round(corr(rc, ry), 6) AS spearman FROM r""")
def calibration_quality(spark, d):
    _, report = calibrate.calibration_fit(rows(spark, d), "base", "cost")
    return report.select("n", *(r6(c).alias(c) for c in ("mae_raw", "mae", "spearman")))


@query(f"WITH {ROWS}, g AS (SELECT scale, penalty, (1 - base) * scale + penalty * gap <= 4 AS o, cost <= 4 AS b FROM rows_, (VALUES (1.0::DOUBLE), (5.0::DOUBLE)) s(scale), (VALUES (0.0::DOUBLE), (0.1::DOUBLE)) p(penalty)) SELECT scale, penalty, count(*) FILTER (WHERE o AND b) AS tp, count(*) FILTER (WHERE NOT o AND NOT b) AS tn, round(avg((o = b)::INT), 6) AS agreement FROM g GROUP BY ALL")
def agreement_grid(spark, d):
    r = rows(spark, d).select(F.col("cost").alias("base_cost"), F.col("base").alias("score"), "gap")
    return calibrate.agreement_grid(r, (1.0, 5.0), (0.0, 0.1), 4.0).select("scale", "penalty", "tp", "tn", r6("agreement").alias("agreement"))


@query(f"WITH {ROWS}, q AS (SELECT unnest(range(11)) AS i, unnest(quantile_cont(base, [i / 10 FOR i IN range(11)])) AS x, unnest(quantile_cont(cost, [i / 10 FOR i IN range(11)])) AS y FROM rows_ WHERE cost BETWEEN 0 AND 10) SELECT CAST(i AS INTEGER) AS i, round(x, 6) AS x, round(y, 6) AS y FROM q")
def quantile_calibration(spark, d):
    return calibrate.quantile_calibration(rows(spark, d), "base", "cost", 11).select("i", r6("x").alias("x"), r6("y").alias("y"))


@query(f"WITH {ROWS} SELECT round(regr_slope(cost, base), 6) AS slope, round(regr_intercept(cost, base), 6) AS intercept FROM rows_")
def linear_calibration(spark, d):
    return calibrate.linear_calibration(rows(spark, d), "base", "cost").select(r6("slope").alias("slope"), r6("intercept").alias("intercept"))


@query(f"WITH {ROWS}, u AS (SELECT label, 'cost' AS feature, cost AS v FROM rows_ UNION ALL SELECT label, 'base', base FROM rows_ UNION ALL SELECT label, 'gap', gap FROM rows_) SELECT feature, label, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50, round(avg((v = 0)::INT), 6) AS zero_fraction FROM u GROUP BY ALL")
def feature_audit(spark, d):
    a = aggregates.feature_audit(rows(spark, d), ("cost", "base", "gap"))
    return a.select("feature", "label", "n", *(r6(c).alias(c) for c in ("mean", "std", "p25", "p50", "zero_fraction")))


RESULTS = "res AS (SELECT o_orderpriority AS method, o_orderstatus AS metric, CAST(o_totalprice AS DOUBLE) / 1000 AS value FROM orders)"


def results(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("method"), F.col("o_orderstatus").alias("metric"), (F.col("o_totalprice").cast("double") / 1000).alias("value"))


@query(f"WITH {RESULTS} SELECT method, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max FROM res GROUP BY ALL")
def benchmark_summary(spark, d):
    b = aggregates.benchmark_summary(results(spark, d), "method")
    return b.select("method", "metric", *(r6(c).alias(c) for c in ("mean", "std", "min", "max")))


@query(f"WITH {RESULTS}, m AS (SELECT metric, method, avg(value) AS mean FROM res GROUP BY ALL) SELECT metric, arg_max(method, mean) AS method, round(max(mean), 6) AS mean FROM m GROUP BY metric")
def best_performer(spark, d):
    return aggregates.best_performer(results(spark, d)).withColumn("mean", r6("mean"))


PRIORITIES = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified", "5-LOW": "low"}


@query(f"WITH {RESULTS} SELECT metric, " + ", ".join(f"round(avg(value) FILTER (WHERE method = '{m}'), 6) AS {c}" for m, c in PRIORITIES.items()) + " FROM res GROUP BY metric")
def comparison_pivot(spark, d):
    return aggregates.comparison_pivot(results(spark, d), list(PRIORITIES)).select("metric", *(r6(m).alias(c) for m, c in PRIORITIES.items()))


@query(f"WITH {ROWS}, m(scenario, sw, fg) AS (VALUES (0, 2.0::DOUBLE, 6.0::DOUBLE), (1, 20.0, 6.0), (2, 5.0, 6.0), (3, 5.0, 6.0)) SELECT anchor_id, candidate_id, round(0.4 * base + 0.25 * base + 0.2 * base + 0.1 * (1 - least(1, gap / sw)) + 0.05 * (1 - least(1, cost / fg)), 9) AS score, round(base, 6) AS quality FROM rows_ JOIN m ON anchor_id % 4 = scenario")
def composite_score(spark, d):
    b, names = F.col("base"), F.array(*(F.lit(n) for n in ("i", "ii", "iii", "other")))
    r = rows(spark, d).withColumn("scenario", F.element_at(names, (F.col("anchor_id") % 4 + 1).cast("int")))
    return r.select("anchor_id", "candidate_id", F.round(aggregates.composite_score(b, b, b, F.col("gap"), F.col("cost"), F.col("scenario")), 9).alias("score"), r6(aggregates.mean_quality(b, b)).alias("quality"))


@query(f"WITH {ROWS}, w AS (SELECT cost AS a, CASE WHEN base > 0.02 THEN base END AS b FROM rows_) SELECT round(avg(CASE WHEN b IS NULL THEN a ELSE (0.7 * a + 0.3 * b) END), 6) AS score FROM w")
def selection_score(spark, d):
    w = rows(spark, d).select(F.col("cost").alias("a"), F.when(F.col("base") > 0.02, F.col("base")).alias("b"))
    return ranking.selection_score(w, {"a": 0.7, "b": 0.3}).agg(r6(F.avg("selection_score")).alias("score"))


@query("WITH f AS (SELECT DISTINCT o_orderstatus AS scenario, o_custkey AS feature FROM orders) SELECT a.scenario AS a, b.scenario AS b, round(count(*) FILTER (WHERE a.feature = b.feature) / ((SELECT count(*) FROM f WHERE scenario = a.scenario) + (SELECT count(*) FROM f WHERE scenario = b.scenario) - count(*) FILTER (WHERE a.feature = b.feature)), 6) AS jaccard FROM f a JOIN f b ON a.scenario < b.scenario GROUP BY a.scenario, b.scenario")
def set_jaccard(spark, d):
    f = table(spark, d, "orders").select(F.col("o_orderstatus").alias("scenario"), F.col("o_custkey").alias("feature"))
    return ranking.set_jaccard(f).withColumn("jaccard", r6("jaccard"))


@query("SELECT status, source_tag, count(*) AS n FROM (SELECT o_orderstatus AS status, 'a' AS source_tag FROM orders UNION ALL SELECT l_linestatus, 'b' FROM lineitem) GROUP BY ALL")
def stack_datasets(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    i = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linestatus").alias("status"))
    return ranking.stack(o, i).groupBy("status", "source_tag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def not_selected(spark, d):
    taken = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return ranking.not_selected(table(spark, d, "orders").select("o_orderkey"), taken, "o_orderkey")


@query("SELECT DISTINCT l_orderkey AS key FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def append_new(spark, d):
    batch = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"))
    return io.append_new(batch, table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key")), "key")


@query("SELECT l_suppkey AS fragment_ref, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_suppkey")
def fragment_store(spark, d):
    return io.fragment_store(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("fragment_ref"))).withColumn("n", F.lit(1).cast("bigint"))


@query("SELECT l_orderkey, l_linenumber, a.s_nationkey AS a_nation, b.s_nationkey AS b_nation FROM lineitem JOIN supplier a ON a.s_suppkey = l_suppkey JOIN supplier b ON b.s_suppkey = l_suppkey % 7 + 1 WHERE l_returnflag = 'R'")
def resolve_pairs(spark, d):
    f = table(spark, d, "supplier").select(F.col("s_suppkey").alias("fragment_ref"), F.col("s_nationkey").alias("nation"))
    p = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("a_fragment_ref"), (F.col("l_suppkey") % 7 + 1).alias("b_fragment_ref"), F.col("l_returnflag").alias("split"))
    return io.resolve_pairs(p, f, "R").select("l_orderkey", "l_linenumber", "a_nation", "b_nation")


@query("SELECT o_orderkey AS report, metric, number FROM (SELECT o_orderkey, 'HOTA' AS metric, CAST(o_totalprice AS DOUBLE) AS number FROM orders UNION ALL SELECT o_orderkey, 'MOTA', -CAST(o_custkey AS DOUBLE) FROM orders)")
def parse_metric_reports(spark, d):
    o = table(spark, d, "orders")
    text = F.concat(F.lit("HOTA: "), F.format_string("%.4f", F.col("o_totalprice").cast("double")), F.lit("\n----\nMOTA = -"), F.col("o_custkey").cast("string"), F.lit("\nnote: none"))
    return io.parse_metric_reports(o.select(F.col("o_orderkey").alias("report"), text.alias("value"))).withColumn("number", F.round("number", 4))


@query("WITH a AS (SELECT p_partkey AS id, CAST(p_retailprice AS DOUBLE) AS v FROM part), m AS (SELECT a.id AS row_id, min((round(abs(a.v - b.v - 0.0002) + abs(a.id % 50 - b.id % 50), 9), b.id)) AS m FROM a JOIN a b ON abs(a.v - (b.v + 0.0002)) < 1e-3 AND abs(a.id % 50 - b.id % 50) < 1e-3 GROUP BY a.id) SELECT row_id, m[2] AS target_id FROM m")
def match_by_values(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").cast("double").alias("v"), (F.col("p_partkey") % 50).cast("double").alias("w"))
    return joins.match_by_values(p, p.withColumn("v", F.col("v") + 0.0002), ("v", "w"))


@query("SELECT n_name AS config, r_name AS scenario, CASE WHEN n_regionkey = r_regionkey THEN 'OK' ELSE 'FAILED' END AS status FROM nation, region")
def experiment_matrix(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    done = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("config"), F.col("r_name").alias("scenario"), F.lit(1.0).alias("value"))
    return joins.experiment_matrix(n.select(F.col("n_name").alias("config")), r.select(F.col("r_name").alias("scenario")), done).select("config", "scenario", "status")


@query(f"WITH {SCORES} SELECT doc_id || '_c' || c AS pair_id, 'up' AS source_split_tag, c AS copy FROM scores, (VALUES (0), (1)) t(c)")
def upscale(spark, d):
    s = scores(spark, d).select(F.col("doc_id").cast("string").alias("pair_id"))
    return datasets.upscale(s, 2, "up").select("pair_id", "source_split_tag", "copy")


@query(f"WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {UNIT_HASH_SQL.format('doc_id', 0)}, doc_id) AS rn FROM scores) SELECT doc_id, label FROM r WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM scores GROUP BY label))")
def balance_classes(spark, d):
    return datasets.balance_classes(scores(spark, d), "doc_id").select("doc_id", "label")


@query(f"WITH {SCORES}, q AS (SELECT label, quantile_cont(p, 0.4) AS a, quantile_cont(p, 0.75) AS b FROM scores GROUP BY label) SELECT doc_id, CASE WHEN rest > 90 OR p >= b THEN 'hard' WHEN p >= a THEN 'medium' ELSE 'easy' END AS bucket FROM scores JOIN q USING (label)")
def hardness_buckets(spark, d):
    s = scores(spark, d).withColumns({"difficulty": F.col("p"), "misclassified": F.col("rest") > 90})
    return datasets.hardness_buckets(s).select("doc_id", "bucket")


STRAT = f"{SCORES}, q AS (SELECT quantile_cont(p, [i / 8 FOR i IN range(1, 8)]) AS a, quantile_cont(rest, [i / 8 FOR i IN range(1, 8)]) AS b FROM scores), k AS (SELECT doc_id, len(list_filter(a, lambda v: v < p)) || '|' || len(list_filter(b, lambda v: v < rest)) AS strat_key FROM scores, q)"


@query(f"WITH {STRAT} SELECT doc_id, strat_key FROM k")
def stratification_key(spark, d):
    return datasets.stratification_key(scores(spark, d), ("p", "rest")).select("doc_id", "strat_key")


@query(f"WITH {STRAT}, u AS (SELECT *, count(*) OVER (PARTITION BY strat_key) AS n, {UNIT_HASH_SQL.format('doc_id', 0)} AS u FROM k), l AS (SELECT *, row_number() OVER (PARTITION BY strat_key ORDER BY u, doc_id) = 1 AS lead FROM u) SELECT doc_id, strat_key FROM l ORDER BY lead DESC, CASE WHEN lead THEN n ELSE -ln(greatest(u, 1e-12)) * sqrt(n) END, doc_id LIMIT 100")
def diverse_sample(spark, d):
    s = datasets.stratification_key(scores(spark, d), ("p", "rest"))
    return datasets.diverse_sample(s, 100, "doc_id").select("doc_id", "strat_key")


@query(f"WITH {STRAT}, x AS (SELECT doc_id, label, p, strat_key FROM scores JOIN k USING (doc_id) WHERE rest >= 10), c AS (SELECT label, quantile_cont(p, 0.4) AS a, quantile_cont(p, 0.75) AS b FROM x GROUP BY label), h AS (SELECT doc_id, label, strat_key, CASE WHEN p >= b THEN 24 WHEN p >= a THEN 12 ELSE 4 END AS quota, {UNIT_HASH_SQL.format('doc_id', 0)} AS u FROM x JOIN c USING (label)), l AS (SELECT *, count(*) OVER (PARTITION BY label, quota, strat_key) AS n, row_number() OVER (PARTITION BY label, quota, strat_key ORDER BY u, doc_id) = 1 AS lead FROM h), o AS (SELECT *, CASE WHEN lead THEN n ELSE -ln(greatest(u, 1e-12)) * sqrt(n) END AS o FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY label, quota ORDER BY lead DESC, o, doc_id) > quota AS over FROM o), f AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY over, lead DESC, o, doc_id) AS rn FROM r) SELECT doc_id, label, 'base' AS source_tag FROM scores WHERE rest < 10 UNION ALL SELECT doc_id, label, 'extra' FROM f WHERE rn <= 40")
def balanced_build(spark, d):
    s = datasets.stratification_key(scores(spark, d), ("p", "rest")).withColumns({"difficulty": F.col("p"), "misclassified": F.lit(False)})
    base = scores(spark, d).filter("rest < 10").select("doc_id", "label")
    return datasets.balanced_build(base, datasets.hardness_buckets(s.filter("rest >= 10")), 40, "doc_id")


@query(f"WITH {ROWS}, p AS (SELECT anchor_id AS a, candidate_id AS pos FROM rows_ WHERE label = 1), n AS (SELECT anchor_id AS a, candidate_id AS neg FROM rows_ WHERE label = 0), r AS (SELECT p.a, pos, neg, row_number() OVER (PARTITION BY p.a, pos ORDER BY {UNIT_HASH_SQL.format('p.a, pos, neg', 0)}, neg) AS rn FROM p JOIN n ON p.a = n.a AND pos <> neg) SELECT a AS anchor, pos AS positive, neg AS negative FROM r WHERE rn <= 2")
def triplets(spark, d):
    r = rows(spark, d)
    p = r.filter("label = 1").select(F.col("anchor_id").alias("anchor"), F.col("candidate_id").alias("positive"))
    n = r.filter("label = 0").select(F.col("anchor_id").alias("anchor"), F.col("candidate_id").alias("negative"))
    return datasets.triplets(p, n, 2).select("anchor", "positive", "negative")


@query(f"WITH {RESULTS}, s AS (SELECT metric AS method, method AS feature, avg(value) AS score FROM res GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, feature) AS rk, count(*) OVER (PARTITION BY method) AS n FROM s) SELECT feature, CAST(sum(n - rk) AS BIGINT) AS points, count(*) FILTER (WHERE rk <= 10) AS votes FROM r GROUP BY feature")
def consensus_rank(spark, d):
    s = results(spark, d).groupBy(F.col("metric").alias("method"), F.col("method").alias("feature")).agg(F.avg("value").alias("score"))
    return models.consensus_rank(s)


@query()
def vif_selection(spark, d):
    r = rows(spark, d).withColumn("twin", F.col("cost") * 2 + F.col("base") * 0.01)
    return models.vif_selection(r, ["cost", "base", "gap", "twin"]).select("feature", "kept", "step", r6("vif").alias("vif"))


@query(f"WITH {SCORES}, r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {UNIT_HASH_SQL.format('doc_id', 0)}, doc_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM scores) SELECT doc_id, CAST((rn - 1) % 5 AS INTEGER) AS fold, rn <= ceil(n * 0.2::DOUBLE) AS held FROM r")
def stratified_folds(spark, d):
    s = scores(spark, d)
    return models.folds(s, "doc_id").select("doc_id", "fold").join(models.held_out(s, "doc_id").select("doc_id", "held"), "doc_id")


@query(f"WITH {SCORES}, t AS (SELECT scenario, count(*) AS n, count(DISTINCT label) AS c, row_number() OVER (ORDER BY count(*) DESC, scenario) AS rn FROM scores GROUP BY scenario) SELECT CASE WHEN min(c) < 2 THEN 'skipped' ELSE 'executed' END AS status, max(scenario) FILTER (WHERE rn = 1) AS train_tag, max(scenario) FILTER (WHERE rn = 2) AS test_tag, CAST(max(n) FILTER (WHERE rn = 1) AS BIGINT) AS n_train, CAST(max(n) FILTER (WHERE rn = 2) AS BIGINT) AS n_test FROM t WHERE rn <= 2")
def source_holdout(spark, d):
    h = models.source_holdout(scores(spark, d).withColumn("label", F.col("label").cast("double")), ["p", "n_chars", "rest"], "scenario")
    return h.select("status", "train_tag", "test_tag", "n_train", "n_test")


@query()
def out_of_fold_scores(spark, d):
    o = models.out_of_fold(scores(spark, d).withColumn("label", F.col("label").cast("double")), "doc_id", ["p", "n_chars", "rest"], 3)
    return o.select("doc_id", "fold", r6("p").alias("p")) if "p" in o.columns else o


@query()
def coefficient_table(spark, d):
    r = rows(spark, d).filter("label is not null")
    f = ["cost", "base", "gap"]
    t = models.coefficient_table(models.fit_logistic(r, f), r, f)
    return t.select("feature", *(r6(c).alias(c) for c in ("coefficient", "se", "z", "p", "odds_ratio")))


@query(f"""WITH {ROWS}, m AS (SELECT anchor_id || '-' || candidate_id AS key, cost - avg(cost) OVER () AS a, gap - avg(gap) OVER () AS b, count(*) OVER () AS n FROM rows_ WHERE label IS NOT NULL), s AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM m)
SELECT key, round(1 / n + (a * a * bb - 2 * a * b * ab + b * b * aa) / (aa * bb - ab * ab), 9) AS leverage FROM m, s""")
def leverage(spark, d):
    r = rows(spark, d).filter("label is not null").withColumn("key", F.concat_ws("-", "anchor_id", "candidate_id"))
    return models.leverage(r, ["cost", "gap"]).select("key", F.round("leverage", 9).alias("leverage"))


@query(f"WITH {ROWS}, c AS (SELECT corr(cost, gap)^2 AS r2 FROM rows_) SELECT f AS feature, round(1 / (1 - r2 + 1e-8), 4) AS vif FROM c, (VALUES ('cost'), ('gap')) v(f)")
def vif(spark, d):
    return models.vif_selection(rows(spark, d), ["cost", "gap"]).select("feature", F.round("vif", 4).alias("vif"))


@query(f"WITH {ROWS}, t AS (SELECT cost, gap, 2 * cost + 0.01 * base AS twin FROM rows_), c AS (SELECT 'cost' AS a, 'gap' AS b, corr(cost, gap) AS r FROM t UNION ALL SELECT 'cost', 'twin', corr(cost, twin) FROM t UNION ALL SELECT 'gap', 'twin', corr(gap, twin) FROM t) SELECT a, b, round(r, 6) AS r FROM c WHERE abs(r) > 0.8")
def correlated_groups(spark, d):
    r = rows(spark, d).withColumn("twin", F.col("cost") * 2 + F.col("base") * 0.01)
    return models.correlated_groups(r, ["cost", "gap", "twin"]).select("a", "b", r6("r").alias("r"))


@query()
def influence(spark, d):
    r = rows(spark, d).filter("label is not null").withColumn("key", F.concat_ws("-", "anchor_id", "candidate_id"))
    return models.influence(models.fit_logistic(r, ["cost", "base", "gap"]), r, "key").select("key", r6("leverage").alias("leverage"), r6("cooks").alias("cooks"), "influential")


@query(f"WITH {SCORES} SELECT doc_id, CASE WHEN rest > 50 THEN 'p' || doc_id ELSE '' END AS pair_id, 'unknown' AS source_split_tag, scenario, -1 AS mask_idx FROM scores")
def feature_metadata(spark, d):
    x = scores(spark, d).select("doc_id", "scenario", F.when(F.col("rest") > 50, F.concat(F.lit("p"), "doc_id")).alias("pair_id"))
    return io.with_metadata(x).select("doc_id", "pair_id", "source_split_tag", "scenario", "mask_idx")


def _labelled(spark, d):
    return scores(spark, d).withColumn("label", F.col("label").cast("double"))


@query()
def l1_path(spark, d):
    return models.l1_path(_labelled(spark, d), FEATURES).select(r6("reg").alias("reg"), "feature", r6("coefficient").alias("coefficient"), "selected")


@query()
def recursive_elimination(spark, d):
    return models.recursive_elimination(_labelled(spark, d), FEATURES, 1)


@query()
def permutation_importance(spark, d):
    r = _labelled(spark, d)
    return models.permutation_importance(models.fit_logistic(r, FEATURES), r, FEATURES, "doc_id", 2).select("feature", r6("importance").alias("importance"), r6("std").alias("std"))


@query()
def subset_comparison(spark, d):
    return models.subset_comparison(_labelled(spark, d), "doc_id", {"all": FEATURES, "sizes": ("n_chars", "rest")}).withColumn("auc", r6("auc"))
