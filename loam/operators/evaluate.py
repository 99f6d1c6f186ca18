"""Model evaluation on a prediction table (M1-M6) and best-model choice.

Classification metrics come from the confusion counts ``(label, prediction,
count)``, which are pre-aggregated and bounded by the number of classes
squared.  AUC and ROC points use per-score counts and distributed running
sums (``loam.operators.ordered``), so no task sees more than one range
partition of distinct scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.stats import clean_double
from loam.operators.ordered import cumulative_sums

# Fixed value: metrics of which less is better.
MINIMIZE = ("rmse", "mae", "mse", "log_loss")


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """M4: long form ``(label, prediction, count)``."""
    return (df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction"))
            .agg(F.count("*").alias("count")))


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """M1: one row ``(n, accuracy, precision, recall, f1)``; precision, recall and F1 are
    support-weighted averages over classes; an undefined per-class value counts as 0."""
    cm = confusion_matrix(df, label, prediction)
    lab = cm.select(F.col("label").alias("cls"), "count", (F.col("label") == F.col("prediction")).alias("hit"))
    pred = cm.select(F.col("prediction").alias("cls"), F.col("count").alias("pcount"))
    sup = lab.groupBy("cls").agg(F.sum("count").alias("support"),
                                 F.sum(F.when(F.col("hit"), F.col("count")).otherwise(0)).alias("tp"))
    prd = pred.groupBy("cls").agg(F.sum("pcount").alias("predicted"))
    per = sup.join(prd, "cls", "full").fillna(0, ["support", "tp", "predicted"])
    p = F.coalesce(F.try_divide(F.col("tp"), F.when(F.col("predicted") > 0, F.col("predicted"))), F.lit(0.0))
    rcl = F.coalesce(F.try_divide(F.col("tp"), F.when(F.col("support") > 0, F.col("support"))), F.lit(0.0))
    per = per.withColumn("p", p).withColumn("r", rcl)
    per = per.withColumn("f", F.when(F.col("p") + F.col("r") > 0,
                                     2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))
    n = F.sum("support")
    return per.agg(n.cast("long").alias("n"),
                   (F.sum("tp") / n).alias("accuracy"),
                   (F.sum(F.col("support") * F.col("p")) / n).alias("precision"),
                   (F.sum(F.col("support") * F.col("r")) / n).alias("recall"),
                   (F.sum(F.col("support") * F.col("f")) / n).alias("f1"))


def _score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    pos = F.col(label).cast("double") == 1.0
    return (df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
            .groupBy(F.col(score).cast("double").alias("score"))
            .agg(F.count_if(pos).cast("long").alias("pos"), F.count_if(~pos).cast("long").alias("neg")))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """M2: binary ROC-AUC from the class-1 score; tied scores count one half.

    ``AUC = sum_s pos(s) * (neg(score < s) + neg(s) / 2) / (P * N)``.
    """
    sc = _score_counts(df, label, score)
    cum = cumulative_sums(sc, "score", ["neg"], inclusive=False)
    part = cum.select((F.col("pos") * (F.col("cum_neg") + F.col("neg") / 2.0)).alias("w"), "pos", "neg")
    tot = part.agg(F.sum("w").alias("w"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return tot.select(F.try_divide(F.col("w"), F.when((F.col("P") > 0) & (F.col("N") > 0),
                                                      F.col("P").cast("double") * F.col("N"))).alias("roc_auc"))


def roc_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """M5: ``(threshold, fpr, tpr)`` at every distinct score (scores at or above the
    threshold are predicted positive); no intermediate point is dropped."""
    sc = _score_counts(df, label, score)
    cum = cumulative_sums(sc, "score", ["pos", "neg"], descending=True)
    # two numbers: positives and negatives in total
    tot = sc.agg(F.sum("pos"), F.sum("neg")).first()
    n_pos, n_neg = tot[0] or 0, tot[1] or 0
    fpr = F.col("cum_neg") / F.lit(float(n_neg)) if n_neg else F.lit(None).cast("double")
    tpr = F.col("cum_pos") / F.lit(float(n_pos)) if n_pos else F.lit(None).cast("double")
    return cum.select(F.col("score").alias("threshold"), fpr.alias("fpr"), tpr.alias("tpr"))


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """M3: ``(n, mse, rmse, mae, r2)``; r2 is 1 when both residual and total sums of
    squares are 0 and 0 when only the total is 0."""
    y = clean_double(F.col(label))
    p = clean_double(F.col(prediction))
    agg = df.where(y.isNotNull() & p.isNotNull()).agg(
        F.count("*").alias("n"), F.avg((y - p) * (y - p)).alias("mse"), F.avg(F.abs(y - p)).alias("mae"),
        F.var_pop(y).alias("vy"))
    ss_res = F.col("mse")
    ss_tot = F.col("vy")
    r2 = (F.when(ss_tot > 0, 1 - ss_res / ss_tot).when(ss_res == 0, 1.0).otherwise(0.0))
    return agg.select("n", "mse", F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"))


def residuals(df: DataFrame, label: str = "label", prediction: str = "prediction",
              keep: Sequence[str] = ()) -> DataFrame:
    """M6: ``(keep..., actual, predicted, residual = actual - predicted)``."""
    return df.select(*keep, F.col(label).cast("double").alias("actual"),
                     F.col(prediction).cast("double").alias("predicted"),
                     (F.col(label).cast("double") - F.col(prediction).cast("double")).alias("residual"))


def select_best(metrics: DataFrame, metric: str, model_col: str = "model", position_col: str = "position") -> DataFrame:
    """The best row of a metrics table; minimise rmse/mae/mse/log_loss, maximise
    the rest; the earlier position wins a tie.  Raises when no model has the metric."""
    metric = metric.lower()
    if metric not in metrics.columns:
        raise ValueError(f"no column {metric} in the comparison table")
    order = F.asc(metric) if metric in MINIMIZE else F.desc(metric)
    w = Window.orderBy(order, F.asc(position_col))
    # the metrics table has one row per trained model
    best = (metrics.where(F.col(metric).isNotNull()).withColumn("_rk", F.row_number().over(w))
            .where(F.col("_rk") == 1).drop("_rk"))
    return best.select(model_col, F.col(metric).alias("best_score"), F.lit(metric).alias("metric"))
