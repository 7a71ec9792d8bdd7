"""Abstention thresholds and calibration: one pass over rows grouped by confidence, then running sums.

A threshold accepts all rows with at least its confidence, so every curve is a cumulative sum over
distinct confidences in falling order; nothing joins thresholds with rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from querent.functions.text import answer_em, bin_index, has_answer

#: The threshold that accepts nothing.
ABSTAIN_ALWAYS = 1.0000001


def by_confidence(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., threshold, pos, neg, wrong, right, n): rows at each confidence; nonblank answers only can be accepted.

    The candidates 0 and ``ABSTAIN_ALWAYS`` are added with no rows.
    """
    em = answer_em(F.col("raw_answer"), F.col("answers"))
    named = has_answer(F.col("raw_answer"))
    each = rows.select(
        *by, F.col("confidence").cast("double").alias("threshold"), (F.size("answers") > 0).alias("gold"), named.alias("named"), em.alias("em")
    )
    counts = each.groupBy(*by, "threshold").agg(
        F.count_if(F.col("gold") & F.col("named")).alias("pos"), F.count_if(~F.col("gold") & F.col("named")).alias("neg"),
        F.count_if(F.col("named") & (F.col("em") < 1)).alias("wrong"), F.count_if(F.col("gold")).alias("golds"), F.count(F.lit(1)).alias("n"),
    )
    ends = (counts.select(*by).distinct() if by else counts.limit(1).select()).withColumn("threshold", F.explode(F.array(F.lit(0.0), F.lit(ABSTAIN_ALWAYS))))
    zero = [F.lit(0).cast("long").alias(c) for c in ("pos", "neg", "wrong", "golds", "n")]
    return counts.unionByName(ends.select(*by, "threshold", *zero)).groupBy(*by, "threshold").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "wrong", "golds", "n")])


#: Confidences are summed up in this many steps first, so that no group's curve is one task.
STEPS = 4096


def running_counts(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., threshold, tp, fp, wrong, golds, total, own): sums over the confidences from the threshold up.

    Two levels: sums within a step of the confidence range, and sums of the steps above, of which a
    group has at most ``STEPS`` + 2.
    """
    cols = ["pos", "neg", "wrong", "golds", "n"]
    stepped = counts.withColumn("_step", F.floor(F.col("threshold") * STEPS))
    sums = stepped.groupBy(*by, "_step").agg(*[F.sum(c).alias(f"_{c}") for c in cols])
    above = Window.partitionBy(*by).orderBy(F.desc("_step")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = sums.select(
        *by, "_step", *[F.coalesce(F.sum(f"_{c}").over(above), F.lit(0)).alias(f"_{c}") for c in ("pos", "neg", "wrong")],
        F.sum("_golds").over(whole).alias("golds"), F.sum("_n").over(whole).alias("total"),
    )
    falling = Window.partitionBy(*by, "_step").orderBy(F.desc("threshold"))
    within = stepped.select(*by, "_step", "threshold", (F.col("pos") + F.col("neg")).alias("own"), *[F.sum(c).over(falling).alias(c) for c in ("pos", "neg", "wrong")])
    joined = within.join(offsets, [*by, "_step"])
    return joined.select(*by, "threshold", (F.col("pos") + F.col("_pos")).alias("tp"), (F.col("neg") + F.col("_neg")).alias("fp"), (F.col("wrong") + F.col("_wrong")).alias("wrong"), "golds", "total", "own")


def threshold_diagnostics(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., threshold, tp, fp, tn, fn, accepted, wrong, total, balanced_accuracy) of every candidate threshold.

    Answerable rows that are accepted are true positives. Balanced accuracy is null if a class is absent.
    """
    run = running_counts(by_confidence(rows, by), by)
    negatives = F.col("total") - F.col("golds")
    run = run.withColumn("tn", negatives - F.col("fp")).withColumn("fn", F.col("golds") - F.col("tp")).withColumn("accepted", F.col("tp") + F.col("fp"))
    accuracy = F.when((F.col("golds") > 0) & (negatives > 0), (F.col("tp") / F.col("golds") + F.col("tn") / negatives) / 2)
    return run.withColumn("balanced_accuracy", accuracy).drop("golds")


def calibrate_threshold(rows: DataFrame, by: tuple[str, ...] = (), min_class_count: int = 1, split: str = "dev") -> DataFrame:
    """(by..., threshold, balanced_accuracy): the best threshold, the higher one of equals. Development rows only."""
    if split != "dev":
        raise ValueError("thresholds are calibrated on the development split only")
    curve = threshold_diagnostics(rows, by).filter((F.col("tp") + F.col("fn") >= min_class_count) & (F.col("tn") + F.col("fp") >= min_class_count))
    best = F.max_by(F.struct("threshold", "balanced_accuracy"), F.struct("balanced_accuracy", "threshold"))
    return curve.filter("balanced_accuracy is not null").groupBy(*by).agg(best.alias("x")).select(*by, "x.threshold", "x.balanced_accuracy")


def calibrate_risk(rows: DataFrame, max_risk: float, min_coverage: float = 0.0, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., threshold, risk, coverage): the largest coverage with at most this risk, then the higher threshold.

    Accepting nothing has no risk (null) and passes.
    """
    for value in (max_risk, min_coverage):
        if isinstance(value, bool) or not 0 <= value <= 1:
            raise ValueError("risk and coverage are shares")
    curve = threshold_diagnostics(rows, by).select(*by, "threshold", F.try_divide("wrong", "accepted").alias("risk"), (F.col("accepted") / F.col("total")).alias("coverage"))
    passing = curve.filter((F.col("risk").isNull() | (F.col("risk") <= max_risk)) & (F.col("coverage") >= min_coverage))
    best = F.max_by(F.struct("threshold", "risk", "coverage"), F.struct("coverage", "threshold"))
    return passing.groupBy(*by).agg(best.alias("x")).select(*by, "x.threshold", "x.risk", "x.coverage")


def risk_coverage(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., threshold, coverage, risk, area): points at distinct confidences of nonblank answers, ties together.

    ``area`` is the part of the area under the curve that the step to this point adds.
    """
    # a confidence at which only blank answers stand adds no point
    curve = threshold_diagnostics(rows, by).filter("own > 0")
    risk = F.col("wrong") / F.col("accepted")
    return curve.select(*by, "threshold", (F.col("accepted") / F.col("total")).alias("coverage"), risk.alias("risk"), (risk * F.col("own") / F.col("total")).alias("area"))


def reliability_bins(rows: DataFrame, bins: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., bin, count, mean_confidence, accuracy, gap): fixed-width bins, empty ones with null statistics.

    ``gap`` is the bin's part of the expected calibration error.
    """
    if isinstance(bins, bool) or bins < 1:
        raise ValueError("bins must be at least 1")
    em = answer_em(F.col("raw_answer"), F.col("answers"))
    filled = rows.select(*by, bin_index(F.col("confidence"), bins).alias("bin"), "confidence", em.alias("em")).groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("count"), F.avg("confidence").alias("mean_confidence"), F.avg("em").alias("accuracy")
    )
    spark = rows.sparkSession
    every = (filled.select(*by).distinct() if by else spark.range(1).select()).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    joined = every.join(filled, [*by, "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    total = F.sum("count").over(Window.partitionBy(*by))
    gap = F.coalesce(F.try_divide(F.abs(F.col("mean_confidence") - F.col("accuracy")) * F.col("count"), total), F.lit(0.0))
    return joined.select(*by, "bin", "count", "mean_confidence", "accuracy", gap.alias("gap"))


def assert_support(rows: DataFrame, min_class_count: int = 1, by: tuple[str, ...] = ()) -> None:
    """ValueError unless each group has so many answerable and so many unanswerable rows."""
    counts = rows.groupBy(*by).agg(F.count_if(F.size("answers") > 0).alias("answerable"), F.count_if(F.size("answers") == 0).alias("unanswerable"))
    short = counts.filter(F.least("answerable", "unanswerable") < min_class_count).limit(1).collect()
    if short or (not by and counts.filter("answerable + unanswerable > 0").isEmpty()):
        raise ValueError(f"each class needs {min_class_count} rows: {short[0].asDict() if short else 'no rows'}")


def place_folds(rows: DataFrame, groups: DataFrame, key: str = "query_id") -> DataFrame:
    """Rows with the ``fold`` of ``groups`` (key, fold); ValueError unless the groups cover the rows' ids exactly, each once."""
    if twice := groups.groupBy(key).count().filter("count > 1").limit(1).collect():
        raise ValueError(f"{twice[0][key]} is in several folds")
    ids = rows.select(key).distinct().withColumn("_row", F.lit(True)).join(groups.select(key, F.lit(True).alias("_group")), key, "full_outer")
    if off := ids.filter("_row is null or _group is null").limit(1).collect():
        raise ValueError(f"the folds don't cover the rows: {off[0][key]}")
    return rows.join(groups.select(key, "fold"), key)


def cross_validate(rows: DataFrame, fold: Column, folds: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., fold, threshold, accepted, coverage, selective_em): fitted on the other folds, scored on the fold."""
    if isinstance(folds, bool) or folds < 2:
        raise ValueError("folds must be at least 2")
    placed = rows.withColumn("_own", fold)
    train = placed.withColumn("fold", F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("_own"))))
    fitted = calibrate_threshold(train, (*by, "fold")).select(*by, "fold", "threshold")
    held = placed.withColumnRenamed("_own", "fold").join(fitted, [*by, "fold"])
    ok = has_answer(F.col("raw_answer")) & (F.col("confidence") >= F.col("threshold"))
    scored = held.select(*by, "fold", "threshold", ok.alias("_ok"), F.when(ok, answer_em(F.col("raw_answer"), F.col("answers"))).alias("_em"))
    return scored.groupBy(*by, "fold", "threshold").agg(F.count_if("_ok").alias("accepted"), F.avg(F.col("_ok").cast("double")).alias("coverage"), F.avg("_em").alias("selective_em"))
