"""Scaled logistic regression, validation protocols and feature diagnostics.

Matrices of feature size are built by one distributed aggregate and inverted on
the driver; rows never leave the executors.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import erfc, sqrt

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import unit_hash
from .calibrate import roc_auc
from .graph import checkpointed
from .prefix import ranked_within


def fit_logistic(train: DataFrame, features: Sequence[str], label: str = "label", l1: float = 0.0, reg: float = 1e-3) -> PipelineModel:
    """Scaler and model, both fitted on ``train`` only."""
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="skip"),
        StandardScaler(inputCol="_raw", outputCol="_x", withMean=True),
        LogisticRegression(featuresCol="_x", labelCol=label, regParam=reg, elasticNetParam=l1, maxIter=50),
    ]
    return Pipeline(stages=stages).fit(train)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    out = model.transform(rows)
    return out.withColumn("p", vector_to_array("probability")[1]).drop("_raw", "_x", "rawPrediction", "probability", "prediction")


def folds(rows: DataFrame, key: str, k: int = 5, seed: int = 0, label: str = "label") -> DataFrame:
    """``rows`` with a ``fold``: each class is dealt out in hash order, so a fold has its share of every class, to one row."""
    placed = ranked_within(rows.withColumn("_u", unit_hash(key, seed=seed)), [label], ["_u", key], "_rn")
    return placed.withColumn("fold", ((F.col("_rn") - 1) % k).cast("int")).drop("_u", "_rn")


def out_of_fold(rows: DataFrame, key: str, features: Sequence[str], k: int = 5, **kw) -> DataFrame:
    """Predictions for every row from a model that has not seen its fold."""
    dealt, out = checkpointed(folds(rows, key, k)), None
    for i in range(k):
        made = predict(fit_logistic(dealt.filter(F.col("fold") != i), features, **kw), dealt.filter(F.col("fold") == i))
        out = made if out is None else out.unionByName(made)
    return out


def held_out(rows: DataFrame, key: str, share: float = 0.2, seed: int = 0, label: str = "label") -> DataFrame:
    """``rows`` with ``held``: the first ``share`` (rounded up) of each class in hash order."""
    placed = ranked_within(rows.withColumn("_u", unit_hash(key, seed=seed)), [label], ["_u", key], "_rn")
    sizes = rows.groupBy(F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))  # a row per class
    met = placed.join(sizes, F.col(label).eqNullSafe(F.col("_l")))
    return met.withColumn("held", F.col("_rn") <= F.ceil(F.col("_n") * F.lit(share))).drop("_u", "_rn", "_l", "_n")


def holdout(rows: DataFrame, key: str, features: Sequence[str], share: float = 0.2, seed: int = 0) -> DataFrame:
    """Predictions for the held-out rows from a model of the others."""
    dealt = checkpointed(held_out(rows, key, share, seed))
    return predict(fit_logistic(dealt.filter("not held"), features), dealt.filter("held"))


def source_holdout(rows: DataFrame, features: Sequence[str], tag: str, preferred: tuple[str, str] | None = None, label: str = "label") -> DataFrame:
    """One row: fitted on one source and tested on another, ``preferred`` if there are both, else the largest and the second largest.

    ``status`` is skipped, with a reason, with fewer than two sources or where one of the two has a single class.
    """
    spark, schema = rows.sparkSession, "status string, reason string, train_tag string, test_tag string, n_train bigint, n_test bigint, auc double"
    known = rows.groupBy(F.col(tag).cast("string").alias("tag"))
    about = known.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(label).alias("classes")).orderBy(F.desc("n"), "tag")
    two = about.limit(2).collect()
    if preferred:
        asked = {r["tag"]: r for r in about.filter(F.col("tag").isin(*preferred)).collect()}
        two = [asked[t] for t in preferred] if len(asked) == 2 else two
    if len(two) < 2:
        return spark.createDataFrame([("skipped", "fewer than two sources", None, None, None, None, None)], schema)
    train, test = two
    if min(train["classes"], test["classes"]) < 2:
        return spark.createDataFrame([("skipped", "a single class", train["tag"], test["tag"], train["n"], test["n"], None)], schema)
    of = lambda r: rows.filter(F.col(tag).cast("string") == r["tag"])
    auc = roc_auc(predict(fit_logistic(of(train), features, label), of(test)), "p").first()["auc"]
    return spark.createDataFrame([("executed", None, train["tag"], test["tag"], train["n"], test["n"], float(auc))], schema)


def scenario_validation(rows: DataFrame, key: str, features: Sequence[str], scenario: str = "scenario") -> DataFrame:
    """AUC within each scenario (out of fold), for each ordered pair, and leave-one-out; with the drop class."""
    spark = rows.sparkSession
    names = sorted(r[0] for r in rows.select(scenario).distinct().collect())  # a handful of scenarios
    auc = lambda d: roc_auc(d, "p").first()["auc"]
    out, within = [], {}
    for s in names:
        own = rows.filter(F.col(scenario) == s)
        within[s] = auc(out_of_fold(own, key, features))
        out.append(("within", str(s), str(s), within[s]))
    for s in names:
        model = fit_logistic(rows.filter(F.col(scenario) == s), features)
        out += [("pair", str(s), str(t), auc(predict(model, rows.filter(F.col(scenario) == t)))) for t in names if t != s]
        rest = fit_logistic(rows.filter(F.col(scenario) != s), features)
        out.append(("leave_one_out", "rest", str(s), auc(predict(rest, rows.filter(F.col(scenario) == s)))))
    table = [(k, a, b, float(v), float(within[type(names[0])(b)] - v)) for k, a, b, v in out]
    made = spark.createDataFrame(table, "protocol string, train string, test string, auc double, auc_drop double")
    return made.withColumn("drop_class", F.when(F.col("auc_drop") < 0.10, "Good").when(F.col("auc_drop") < 0.15, "Moderate").otherwise("Severe"))


def moments(rows: DataFrame, features: Sequence[str], weight=None) -> tuple[float, np.ndarray, np.ndarray]:
    """(n, sums, cross products) in one aggregate."""
    w = F.lit(1.0) if weight is None else weight
    c = [F.col(f).cast("double") for f in features]
    pairs = [(i, j) for i in range(len(c)) for j in range(i, len(c))]
    row = rows.agg(F.sum(w), *(F.sum(w * x) for x in c), *(F.sum(w * c[i] * c[j]) for i, j in pairs)).first()
    k = len(c)
    cross = np.zeros((k, k))
    for (i, j), v in zip(pairs, row[1 + k :], strict=True):
        cross[i, j] = cross[j, i] = v
    return float(row[0]), np.array(row[1 : 1 + k], float), cross


def correlation(rows: DataFrame, features: Sequence[str]) -> np.ndarray:
    n, s, cross = moments(rows, features)
    cov = cross / n - np.outer(s, s) / n**2
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.outer(sd, sd) > 1e-12, cov / np.outer(sd, sd), 0) * (1 - np.eye(len(s))) + np.diag((sd > 1e-6).astype(float))


def vif(r: np.ndarray) -> np.ndarray:
    """1 / (1 - R^2 + 1e-8) of each column from a correlation matrix; a constant column has 1e8."""
    out = np.full(len(r), 1e8)
    live = np.flatnonzero(np.diag(r) > 0)
    if len(live):
        d = np.maximum(np.diag(np.linalg.inv(r[np.ix_(live, live)] + 1e-10 * np.eye(len(live)))), 1.0)
        out[live] = 1 / (1 / d + 1e-8)
    return out


def vif_selection(rows: DataFrame, features: Sequence[str], limit: float = 10.0) -> DataFrame:
    """Worst column dropped again and again until none exceeds ``limit``: feature, vif, kept, step."""
    r, live, out = correlation(rows, features), list(range(len(features))), []
    while live:
        v = vif(r[np.ix_(live, live)])
        worst = int(np.argmax(v))
        if v[worst] <= limit:
            out += [(features[i], float(x), True, len(features) - len(live)) for i, x in zip(live, v, strict=True)]
            break
        out.append((features[live[worst]], float(v[worst]), False, len(features) - len(live)))
        del live[worst]
    return rows.sparkSession.createDataFrame(out, "feature string, vif double, kept boolean, step int")


def correlated_groups(rows: DataFrame, features: Sequence[str], limit: float = 0.8) -> DataFrame:
    r = correlation(rows, features)
    out = [(a, b, float(r[i, j])) for i, a in enumerate(features) for j, b in enumerate(features) if i < j and abs(r[i, j]) > limit]
    return rows.sparkSession.createDataFrame(out, "a string, b string, r double")


def _information(model: PipelineModel, rows: DataFrame) -> tuple[DataFrame, list[str], np.ndarray]:
    """Predicted rows with scaled columns z0.. (z0 = 1), their names, and the inverse of X'WX."""
    lr = model.stages[-1]
    k = len(lr.coefficients)
    z = model.transform(rows).withColumns({"_a": vector_to_array("_x"), "p": vector_to_array("probability")[1]})
    z = z.withColumns({"z0": F.lit(1.0)} | {f"z{i + 1}": F.col("_a")[i] for i in range(k)})
    names = [f"z{i}" for i in range(k + 1)]
    _, _, xwx = moments(z, names, F.col("p") * (1 - F.col("p")))
    return z, names, np.linalg.inv(xwx + 1e-8 * np.eye(k + 1))


def coefficient_table(model: PipelineModel, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """coefficient, standard error, z, p, 95 % interval and odds ratio of each scaled feature."""
    lr = model.stages[-1]
    _, _, inverse = _information(model, rows)
    out = []
    for name, b, v in zip(["intercept", *features], [lr.intercept, *lr.coefficients.toArray()], np.diag(inverse), strict=True):
        se = sqrt(max(v, 0.0))
        z = b / se if se > 0 else 0.0
        out.append((name, float(b), se, float(z), erfc(abs(z) / sqrt(2)), float(b - 1.96 * se), float(b + 1.96 * se), float(np.exp(np.clip(b, -500, 500)))))
    return rows.sparkSession.createDataFrame(out, "feature string, coefficient double, se double, z double, p double, lo double, hi double, odds_ratio double")


def quadratic_form(names: Sequence[str], matrix: np.ndarray) -> Column:
    """x'Mx of each row for a positive definite M, as a sum of squares of columns: with M = LL', it is |L'x|^2."""
    low = np.linalg.cholesky(matrix)
    parts = [reduce(lambda s, c: s + c, [float(low[i, j]) * F.col(names[i]) for i in range(j, len(names))]) for j in range(len(names))]
    return reduce(lambda s, c: s + c, [p * p for p in parts])


def leverage(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """``rows`` with the leverage of each in a linear fit with intercept, from one pass for the moments."""
    n, s, cross = moments(rows, features)
    mean = s / n
    centred = [f"_c{i}" for i in range(len(features))]
    spread = cross - n * np.outer(mean, mean)
    d = rows.withColumns({c: F.col(f).cast("double") - float(m) for c, f, m in zip(centred, features, mean, strict=True)})
    return d.withColumn("leverage", 1 / n + quadratic_form(centred, np.linalg.inv(spread))).drop(*centred)


def influence(model: PipelineModel, rows: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Leverage, studentised residual, Cook's distance and their flags for each row."""
    z, names, inverse = _information(model, rows)
    k = len(names)
    n = z.agg(F.count(F.lit(1)).alias("_rows"))
    w = F.col("p") * (1 - F.col("p"))
    h = z.withColumn("leverage", F.least(w * quadratic_form(names, inverse), F.lit(1 - 1e-9)))
    r = (F.col(label) - F.col("p")) / F.sqrt(F.greatest(w, F.lit(1e-12)) * (1 - F.col("leverage")))
    h = h.withColumn("residual", r).withColumn("cooks", F.col("residual") * F.col("residual") * F.col("leverage") / ((1 - F.col("leverage")) * k))
    h = h.crossJoin(F.broadcast(n))  # one row
    return h.select(key, "leverage", "residual", "cooks", (F.col("cooks") > 4 / F.col("_rows")).alias("influential"), (F.col("leverage") > 2 * k / F.col("_rows")).alias("high_leverage"), (F.abs("residual") > 3).alias("outlier"))


def permutation_importance(model: PipelineModel, rows: DataFrame, features: Sequence[str], key: str, repeats: int = 3) -> DataFrame:
    """Mean AUC drop when a column is dealt out anew. Values move by a join on hash ranks within ranges."""
    from .datasets import rank_in_ranges

    base, out = roc_auc(predict(model, rows), "p").first()["auc"], []
    for c in features:
        drops = []
        for s in range(repeats):
            one = F.lit(1).alias("_g")
            left = rank_in_ranges(rows.withColumn("_u", unit_hash(key, seed=2 * s)).withColumn("_g", F.lit(1)), ["_g"], "_u", [key]).drop("_u", "_g", c)
            right = rank_in_ranges(rows.select(key, c, one, unit_hash(key, seed=2 * s + 1).alias("_u")), ["_g"], "_u", [key]).select("rn", c)
            drops.append(base - roc_auc(predict(model, left.join(right, "rn").drop("rn")), "p").first()["auc"])
        out.append((c, float(np.mean(drops)), float(np.std(drops))))
    return rows.sparkSession.createDataFrame(out, "feature string, importance double, std double")


def l1_path(rows: DataFrame, features: Sequence[str], strengths: Sequence[float] = (0.001, 0.01, 0.05, 0.1)) -> DataFrame:
    out = []
    for reg in strengths:
        model = fit_logistic(rows, features, l1=1.0, reg=reg).stages[-1]
        out += [(float(reg), f, float(b), bool(abs(b) > 1e-8)) for f, b in zip(features, model.coefficients.toArray(), strict=True)]
    return rows.sparkSession.createDataFrame(out, "reg double, feature string, coefficient double, selected boolean")


def recursive_elimination(rows: DataFrame, features: Sequence[str], keep: int) -> DataFrame:
    """Rank 1 for the ``keep`` features left after dropping the smallest coefficient each time."""
    live, ranks = list(features), {}
    while len(live) > keep:
        b = np.abs(fit_logistic(rows, live).stages[-1].coefficients.toArray())
        worst = live[int(np.argmin(b))]
        ranks[worst] = len(live) - keep + 1
        live.remove(worst)
    return rows.sparkSession.createDataFrame([(f, ranks.get(f, 1)) for f in features], "feature string, rank int")


def subset_comparison(rows: DataFrame, key: str, subsets: dict[str, Sequence[str]]) -> DataFrame:
    out = [(n, len(f), float(roc_auc(out_of_fold(rows, key, f), "p").first()["auc"])) for n, f in subsets.items()]
    return rows.sparkSession.createDataFrame(out, "subset string, size int, auc double")


def consensus_rank(methods: DataFrame, l1: DataFrame | None = None) -> DataFrame:
    """Points n - rank over the methods plus 20 for an L1 pick; votes; order by points. ``methods``: method, feature, score."""
    from pyspark.sql import Window

    w = Window.partitionBy("method").orderBy(F.desc("score"), "feature")
    n = F.count(F.lit(1)).over(Window.partitionBy("method"))
    ranked = methods.withColumns({"rank": F.row_number().over(w), "n": n})
    points = ranked.groupBy("feature").agg(F.sum(F.col("n") - F.col("rank")).alias("points"), F.count_if(F.col("rank") <= 10).alias("votes"))
    if l1 is not None:
        points = points.join(l1.select("feature", F.lit(20).alias("bonus")).distinct(), "feature", "left").withColumn("points", F.col("points") + F.coalesce("bonus", F.lit(0))).drop("bonus")
    return points


def isotonic_calibration(rows: DataFrame, source: str, target: str):
    from pyspark.ml.regression import IsotonicRegression

    return IsotonicRegression(featuresCol=source, labelCol=target).fit(rows)


