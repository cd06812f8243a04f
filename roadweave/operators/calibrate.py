"""Classification metrics, ROC work, thresholds and calibration.

Running sums and percentiles over a whole table never sit in one task (``prefix``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import unpivot
from .prefix import percentiles, percentiles_of, running_sums


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def classification_metrics(rows: DataFrame, p: str = "p", label: str = "label", threshold: float = 0.5) -> DataFrame:
    """One row: tp, fp, tn, fn and what follows from them, log loss and Brier score."""
    y, hat = F.col(label) == 1, F.col(p) >= threshold
    q = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(p)))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    c = rows.agg(count(y & hat).alias("tp"), count(~y & hat).alias("fp"), count(~y & ~hat).alias("tn"), count(y & ~hat).alias("fn"),
        F.avg(-F.when(y, F.log(q)).otherwise(F.log(1 - q))).alias("log_loss"), F.avg(F.pow(F.col(p) - F.col(label), 2)).alias("brier"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "specificity": _ratio(tn, tn + fp), "f1": _ratio(2 * tp, 2 * tp + fp + fn), "accuracy": _ratio(tp + tn, tp + fp + tn + fn)})


def cumulative_counts(rows: DataFrame, score: str, label: str = "label", keys: Sequence[str] = (), ranges: int = 64) -> DataFrame:
    """score and, per distinct one (falling): p, n of that score and the sums tp, fp down to it, by two-level prefix sums."""
    per = rows.groupBy(*keys, F.col(score).alias("score")).agg(F.sum(F.col(label)).cast("long").alias("p"), F.sum(1 - F.col(label)).cast("long").alias("n"))
    return running_sums(per, keys, "score", {"tp": "p", "fp": "n"}, descending=True, ranges=ranges)


def roc_curve(rows: DataFrame, score: str, label: str = "label") -> DataFrame:
    """threshold, tpr, fpr, precision for each distinct score."""
    c = cumulative_counts(rows, score, label)
    all_ = rows.agg(F.sum(F.col(label)).alias("all_pos"), F.sum(1 - F.col(label)).alias("all_neg"))
    return c.crossJoin(F.broadcast(all_)).select(F.col("score").alias("threshold"), "tp", "fp", _ratio(F.col("tp"), F.col("all_pos")).alias("tpr"), _ratio(F.col("fp"), F.col("all_neg")).alias("fpr"), _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def roc_auc(rows: DataFrame, score: str, label: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve and average precision; ties are one step. Per ``keys`` if given."""
    c = cumulative_counts(rows, score, label, keys)
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2))
    ap = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return c.groupBy(*keys).agg(_ratio(area, F.sum("p") * F.sum("n")).alias("auc"), _ratio(ap, F.sum("p")).alias("average_precision"))


def calibration_bins(rows: DataFrame, p: str = "p", label: str = "label", bins: int = 10) -> DataFrame:
    """Reliability rows of right-closed bins, empty ones too."""
    b = F.greatest(F.lit(0), F.ceil(F.col(p) * bins).cast("int") - 1)
    found = rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("confidence"), F.avg(F.col(label).cast("double")).alias("accuracy"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def expected_calibration_error(rows: DataFrame, p: str = "p", label: str = "label", bins: int = 10) -> DataFrame:
    b = calibration_bins(rows, p, label, bins)
    return b.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))


def feature_auc(x: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """max(auc, 1 - auc) of each feature alone."""
    a = roc_auc(unpivot(x, [label], features), "value", label, ["feature"])
    return a.select("feature", F.greatest(F.col("auc"), 1 - F.col("auc")).alias("auc"))


def shortcut_risk(x: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """Half the absolute correlation with the label plus half the Kolmogorov-Smirnov distance between the classes."""
    u = unpivot(x, [label], features)
    r = u.groupBy("feature").agg(F.coalesce(F.abs(F.corr("value", label)), F.lit(0.0)).alias("r"))
    c = cumulative_counts(u, "value", label, ["feature"])
    t = u.groupBy("feature").agg(F.sum(label).alias("all_pos"), F.sum(1 - F.col(label)).alias("all_neg"))
    ks = c.join(F.broadcast(t), "feature").groupBy("feature").agg(F.max(F.abs(_ratio(F.col("tp"), F.col("all_pos")) - _ratio(F.col("fp"), F.col("all_neg")))).alias("ks"))
    return r.join(ks, "feature").select("feature", "r", "ks", (0.5 * F.col("r") + 0.5 * F.col("ks")).alias("risk"))


def histogram_overlap(x: DataFrame, value: str, label: str = "label", bins: int = 200) -> DataFrame:
    """Shared mass of the two classes' histograms between percentiles 0.5 and 99.5 (1 for a constant), and the absolute Cohen's d (0 without spread)."""
    q = percentiles(x, value, (0.005, 0.995)).select(F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    inside = x.crossJoin(F.broadcast(q)).filter((F.col(value) >= F.col("lo")) & (F.col(value) <= F.col("hi")))
    b = F.least(F.floor((F.col(value) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    h = inside.groupBy(b.alias("b")).agg(F.sum(F.col(label)).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    total = inside.agg(F.sum(F.col(label)).alias("all_pos"), F.sum(1 - F.col(label)).alias("all_neg"))
    overlap = h.crossJoin(F.broadcast(total)).agg(F.sum(F.least(_ratio(F.col("p"), F.col("all_pos")), _ratio(F.col("n"), F.col("all_neg")))).alias("overlap"))
    pos, neg = F.when(F.col(label) == 1, F.col(value)), F.when(F.col(label) == 0, F.col(value))
    n1, n2 = F.count(pos), F.count(neg)
    pooled = F.sqrt(((n1 - 1) * F.var_pop(pos) + (n2 - 1) * F.var_pop(neg)) / F.nullif(n1 + n2 - 2, F.lit(0)))
    d = x.agg(F.when(pooled < 1e-12, 0.0).otherwise(F.abs(F.avg(pos) - F.avg(neg)) / pooled).alias("cohens_d"))
    met = overlap.crossJoin(d).crossJoin(F.broadcast(q))
    return met.select(F.when(F.col("lo") == F.col("hi"), 1.0).otherwise(F.col("overlap")).alias("overlap"), "cohens_d")


def choose_threshold(roc: DataFrame, strategy: str, value: float | None = None) -> DataFrame:
    """One row of a ROC table (threshold is minus the cost): youden, fpr_ceiling, precision_floor or f_beta.

    If no row qualifies: for a ceiling the lowest positive false positive rate, for a floor the highest precision.  Equal ones go to the higher threshold.
    """
    fallback = F.col("precision")
    if strategy == "youden":
        best, good = F.col("tpr") - F.col("fpr"), F.lit(True)
    elif strategy == "fpr_ceiling":
        best, good = F.col("tpr"), F.col("fpr") <= (0.005 if value is None else value)
        fallback = F.when(F.col("fpr") > 0, -F.col("fpr")).otherwise(float("-inf"))
    elif strategy == "precision_floor":
        best, good = F.col("tpr"), F.col("precision") >= (0.99 if value is None else value)
    else:
        b2 = (0.1 if value is None else value) ** 2
        best, good = _ratio((1 + b2) * F.col("precision") * F.col("tpr"), b2 * F.col("precision") + F.col("tpr")), F.lit(True)
    order = F.struct(good.cast("int").alias("good"), F.round(F.when(good, best).otherwise(fallback), 9).alias("best"), F.col("threshold"))
    return roc.agg(F.max_by(F.struct("threshold", "tpr", "fpr", "precision"), order).alias("m")).select(F.lit(strategy).alias("strategy"), "m.*")


def threshold_candidates(roc: DataFrame, values: Sequence[tuple[str, float | None]], most: int = 10) -> DataFrame:
    """Distinct thresholds of many strategies, evenly thinned."""
    rows = None
    for strategy, value in values:
        one = choose_threshold(roc, strategy, value)
        rows = one if rows is None else rows.union(one)
    kinds = rows.groupBy("threshold").agg(F.array_join(F.array_sort(F.collect_set("strategy")), ",").alias("strategies"))
    w = Window.orderBy("threshold")  # over one row per strategy
    ranked = kinds.withColumns({"rn": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy())})
    step = F.greatest(F.lit(1), F.ceil(F.col("n") / most))
    return ranked.filter(F.col("rn") % step == 0).select("threshold", "strategies")


def calibration_report(pairs: DataFrame, threshold: float) -> DataFrame:
    """Per scenario: pairs, margin between class means, expected false edges at the threshold, class statistics."""
    pos, neg = F.when(F.col("label") == 1, F.col("cost")), F.when(F.col("label") == 0, F.col("cost"))
    return pairs.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n"), F.avg(pos).alias("pos_mean"), F.avg(neg).alias("neg_mean"), (F.avg(neg) - F.avg(pos)).alias("margin"),
        F.coalesce(F.sum((neg <= threshold).cast("long")), F.lit(0)).alias("false_edges"), F.coalesce(F.sum((pos <= threshold).cast("long")), F.lit(0)).alias("true_edges"))


def weighted_threshold(reports: DataFrame) -> DataFrame:
    """Mean threshold weighted by pairs."""
    return reports.agg((F.sum(F.col("threshold") * F.col("n")) / F.sum("n")).alias("threshold"))


def separation_report(pairs: DataFrame) -> DataFrame:
    """Per class: min, p5, p25, median, p75, p95, max of the cost."""
    g = pairs.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("cost").alias("min"), F.max("cost").alias("max"))
    q = percentiles(pairs.withColumn("_class", F.coalesce("label", F.lit(-1))), "cost", (0.05, 0.25, 0.5, 0.75, 0.95), ["_class"])
    g = g.withColumn("_class", F.coalesce("label", F.lit(-1))).join(q, "_class", "left")
    return g.select("label", "n", "min", *(F.col("q")[i].alias(n) for i, n in enumerate(("p5", "p25", "p50", "p75", "p95"))), "max")


def overlap_zone(pairs: DataFrame) -> DataFrame:
    """One row: the costs between which both classes have pairs; null where they are apart."""
    ends = lambda y: (F.min(F.when(F.col("label") == y, F.col("cost"))), F.max(F.when(F.col("label") == y, F.col("cost"))))
    (p_lo, p_hi), (n_lo, n_hi) = ends(1), ends(0)
    lo, hi = F.greatest(p_lo, n_lo), F.least(p_hi, n_hi)
    return pairs.agg(F.when(lo < hi, lo).alias("lo"), F.when(lo < hi, hi).alias("hi"))


def threshold_sweep(pairs: DataFrame, thresholds: Sequence[float] | DataFrame) -> DataFrame:
    """At each threshold the true and false positive rate, precision and mean margin of the positives. One pass: rows are exploded by a short list.

    ``thresholds`` may be a table of a few rows with a column ``threshold``; its other columns stay.
    """
    if isinstance(thresholds, DataFrame):
        each = pairs.crossJoin(F.broadcast(thresholds))
        by = thresholds.columns
    else:
        each, by = pairs.withColumn("threshold", F.explode(F.lit(list(thresholds)))), ["threshold"]
    y, hit = F.col("label") == 1, F.col("cost") <= F.col("threshold")
    s = lambda c: F.sum(c.cast("long"))
    g = each.groupBy(*by).agg(s(y & hit).alias("tp"), s(~y & hit).alias("fp"), s(y).alias("all_pos"), s(~y).alias("all_neg"), F.avg(F.when(y & hit, F.col("threshold") - F.col("cost"))).alias("margin"))
    return g.select(*by, "tp", "fp", _ratio(F.col("tp"), F.col("all_pos")).alias("tpr"), _ratio(F.col("fp"), F.col("all_neg")).alias("fpr"), _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), "margin")


def positive_thresholds(pairs: DataFrame, shares: Sequence[float] = (0.90, 0.95, 0.99)) -> DataFrame:
    """``threshold_sweep`` at the percentiles of the positives' costs (column ``share``)."""
    q = percentiles(pairs.filter("label = 1"), "cost", shares)
    names = F.transform(F.sequence(F.lit(0), F.lit(len(shares) - 1)), lambda i: F.struct(F.element_at(F.lit(list(shares)), i + 1).alias("share"), F.element_at("q", i + 1).alias("threshold")))
    return threshold_sweep(pairs.filter("label is not null"), q.select(F.inline(names)))


def agreement_grid(pairs: DataFrame, scales: Sequence[float], penalties: Sequence[float], threshold: float) -> DataFrame:
    """How each (scale, penalty) of ``score`` agrees with the baseline's decisions ``base_cost <= threshold``."""
    grid = F.explode(F.lit([[float(s), float(p)] for s in scales for p in penalties]))
    each = pairs.withColumn("g", grid).select("base_cost", "score", "gap", F.col("g")[0].alias("scale"), F.col("g")[1].alias("penalty"))
    ours, base = (1 - F.col("score")) * F.col("scale") + F.col("penalty") * F.col("gap") <= threshold, F.col("base_cost") <= threshold
    s = lambda c: F.sum(c.cast("long"))
    g = each.groupBy("scale", "penalty").agg(s(ours & base).alias("tp"), s(~ours & ~base).alias("tn"), s(ours & ~base).alias("fp"), s(~ours & base).alias("fn"))
    return g.withColumn("agreement", (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")))


def calibration_rows(rows: DataFrame, source: str, target: str, most: float = 10.0, enough: int = 100, least: int = 20) -> DataFrame:
    """Rows to fit on: finite source, target from 0 to ``most``; with fewer than ``enough`` up to the target's p95 instead; fewer than ``least`` are an error."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    good = rows.filter(finite(source) & finite(target))
    fit = good.filter(F.col(target).between(0, most))
    n = fit.count()
    if n < enough:
        cap = percentiles(good, target, (0.95,)).first()["q"]
        fit = good.filter(F.col(target).between(0, cap[0])) if cap else fit
        n = fit.count()
    if n < least:
        raise ValueError(f"{n} rows to fit on; {least} are needed")
    return fit


def calibration_knots(fit: DataFrame, source: str, target: str, mode: str = "quantile_match", points: int = 101) -> list[tuple[float, float]]:
    """Knots (x, y) of a piecewise linear map, by rising x: ``linear`` (the identity over the source's range), ``quantile_match`` or ``isotonic``."""
    if mode == "linear":
        lo, hi = fit.agg(F.min(source), F.max(source)).first()
        return [(float(lo), float(lo)), (float(hi), float(hi))]
    if mode == "quantile_match":
        found = quantile_calibration(fit, source, target, points).orderBy("i").collect()
        knots: dict[float, float] = {}
        for r in found:
            knots.setdefault(r["x"], r["y"])  # the first of equal quantiles
        out = list(knots.items())
    elif mode == "isotonic":
        from .models import isotonic_calibration

        model = isotonic_calibration(fit, source, target)
        out = list(zip(model.boundaries.toArray().tolist(), model.predictions.toArray().tolist(), strict=True))
    else:
        raise ValueError(f"unknown mode {mode}")
    if len(out) < 2:
        lo, hi, y_lo, y_hi = fit.agg(F.min(source), F.max(source), F.min(target), F.max(target)).first()
        out = [(float(lo), float(y_lo)), (float(hi), float(y_hi))]
    return sorted(out)


def calibrated(rows: DataFrame, source: str, knots: Sequence[tuple[float, float]], name: str = "calibrated") -> DataFrame:
    """``rows`` with the knots' map of ``source``; flat beyond the ends."""
    table = F.lit([[float(x), float(y)] for x, y in knots])
    i = F.size(F.filter(table, lambda k: k[0] <= F.col(source)))
    a, b = F.element_at(table, F.greatest(i, F.lit(1))), F.element_at(table, F.least(i + 1, F.lit(len(knots))))
    line = F.when(b[0] > a[0], a[1] + (b[1] - a[1]) * (F.col(source) - a[0]) / F.when(b[0] > a[0], b[0] - a[0])).otherwise(a[1])
    return rows.withColumn(name, F.when(i == 0, a[1]).otherwise(line))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the correlation of the two columns' ranks, equal values sharing the mean of theirs; 0 where one is constant or there are fewer than two rows."""

    def ranked(c: str) -> DataFrame:
        per = rows.groupBy(F.col(c).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
        return running_sums(per, [], "_v", {"_upto": "_c"}).select(F.col("_v").alias(c), (F.col("_upto") - (F.col("_c") - 1) / 2).alias(f"_r_{c}"))

    met = rows.select(a, b).join(ranked(a), a).join(ranked(b), b)
    r = F.corr(f"_r_{a}", f"_r_{b}")
    return met.agg(F.when(r.isNull() | F.isnan(r), 0.0).otherwise(r).alias("spearman"))


def calibration_fit(rows: DataFrame, source: str, target: str, mode: str = "quantile_match", most: float = 10.0) -> tuple[list[tuple[float, float]], DataFrame]:
    """Knots, and one row: n, the mean absolute error of the source itself (``mae_raw``) and of the calibrated source (``mae``), and its rank correlation with the target."""
    from .graph import checkpointed

    fit = checkpointed(calibration_rows(rows, source, target, most).select(F.col(source).cast("double").alias(source), F.col(target).cast("double").alias(target)))
    knots = calibration_knots(fit, source, target, mode)
    mapped = checkpointed(calibrated(fit, source, knots))
    error = mapped.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col(source) - F.col(target))).alias("mae_raw"), F.avg(F.abs(F.col("calibrated") - F.col(target))).alias("mae"))
    return knots, error.crossJoin(F.broadcast(spearman(mapped, "calibrated", target)))


def quantile_calibration(rows: DataFrame, source: str, target: str, points: int = 101) -> DataFrame:
    """Knots that match the quantiles of two columns; targets outside [0, 10] don't count."""
    good = rows.filter(F.col(target).between(0, 10) & F.col(source).isNotNull() & ~F.isnan(source))
    q = percentiles_of(good, [source, target], [i / (points - 1) for i in range(points)])
    q = q.agg(*(F.max(F.when(F.col("column") == c, F.col("q"))).alias(n) for c, n in ((source, "x"), (target, "y"))))
    return q.select(F.posexplode(F.arrays_zip("x", "y")).alias("i", "k")).select("i", "k.x", "k.y")


def linear_calibration(rows: DataFrame, source: str, target: str) -> DataFrame:
    return rows.agg(F.regr_slope(target, source).alias("slope"), F.regr_intercept(target, source).alias("intercept"))
