"""Checkable evaluation queries (M1-M6, L11) on prediction tables made by fixed rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from loam.operators import evaluate as EV
from loam.plans.registry import r, register, rounded, table

# ------------------------------------------------------------ prediction tables


def doc_scores(spark, sf_dir):
    """Binary: label = quality; score from document length; prediction = score >= 0.5."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    j = d.join(lab, "doc_id")
    score = F.col("n_chars") / (F.col("n_chars") + F.lit(1000.0))
    return j.select("doc_id", F.col("quality").alias("label"), score.alias("score"),
                    (score >= 0.5).cast("int").alias("prediction"))


DOC_SCORES_SQL = ("(SELECT doc_id, quality AS label, n_chars / (n_chars + 1000.0) AS score, "
                  "CAST(n_chars / (n_chars + 1000.0) >= 0.5 AS INTEGER) AS prediction "
                  "FROM documents JOIN labels USING (doc_id))")

# Fixed rule: price bands mapped to priorities (a stand-in classifier).
_BANDS = [(100000, "1-URGENT"), (200000, "2-HIGH"), (300000, "3-MEDIUM"), (400000, "4-NOT SPECIFIED")]


def _band_rule(col: str, shift: float = 0.0):
    e = F.lit("5-LOW")
    for limit, name in reversed(_BANDS):
        e = F.when(F.col(col) < limit + shift, name).otherwise(e)
    return e


def _band_sql(shift: float = 0.0) -> str:
    whens = " ".join(f"WHEN o_totalprice < {limit + shift} THEN '{name}'" for limit, name in _BANDS)
    return f"CASE {whens} ELSE '5-LOW' END"


def priority_predictions(spark, sf_dir, shift: float = 0.0):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.col("o_orderpriority").alias("label"),
                    _band_rule("o_totalprice", shift).alias("prediction"))


def _priority_sql(shift: float = 0.0) -> str:
    return f"(SELECT o_orderkey, o_orderpriority AS label, {_band_sql(shift)} AS prediction FROM orders)"


def _cls_metrics_sql(src: str) -> str:
    return f"""WITH p AS {src},
cm AS (SELECT label, prediction, count(*) AS c FROM p GROUP BY ALL),
sup AS (SELECT label AS cls, sum(c) AS support, sum(CASE WHEN label = prediction THEN c ELSE 0 END) AS tp FROM cm GROUP BY 1),
prd AS (SELECT prediction AS cls, sum(c) AS predicted FROM cm GROUP BY 1),
per AS (SELECT coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(predicted, 0) AS predicted
        FROM sup FULL JOIN prd ON sup.cls = prd.cls),
m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS pr,
                CASE WHEN support > 0 THEN tp / support ELSE 0 END AS rc FROM per),
f AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS fs FROM m)
SELECT CAST(sum(support) AS BIGINT) AS n, {r('sum(tp) / sum(support)')} AS accuracy,
  {r('sum(support * pr) / sum(support)')} AS precision, {r('sum(support * rc) / sum(support)')} AS recall,
  {r('sum(support * fs) / sum(support)')} AS f1 FROM f"""


@register("classification_metrics_priority", _cls_metrics_sql(_priority_sql()))
def classification_metrics_priority(spark, sf_dir):
    """M1: accuracy and support-weighted precision/recall/F1 of a multi-class rule."""
    return rounded(EV.classification_metrics(priority_predictions(spark, sf_dir)))


@register("classification_metrics_quality", _cls_metrics_sql(DOC_SCORES_SQL))
def classification_metrics_quality(spark, sf_dir):
    """M1 on the binary quality labels."""
    return rounded(EV.classification_metrics(doc_scores(spark, sf_dir)))


@register("roc_auc_quality", f"""WITH p AS {DOC_SCORES_SQL},
s AS (SELECT score, count_if(label = 1) AS pos, count_if(label <> 1) AS neg FROM p GROUP BY 1),
c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
SELECT {r('sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg))')} AS roc_auc FROM c""")
def roc_auc_quality(spark, sf_dir):
    """M2: ROC-AUC of the length score for quality, tied scores averaged."""
    return rounded(EV.roc_auc(doc_scores(spark, sf_dir)))


@register("roc_curve_quality", f"""WITH p AS {DOC_SCORES_SQL},
s AS (SELECT score, count_if(label = 1) AS pos, count_if(label <> 1) AS neg FROM p GROUP BY 1)
SELECT {r('score')} AS threshold,
  {r('sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) / sum(neg) OVER ()')} AS fpr,
  {r('sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) / sum(pos) OVER ()')} AS tpr FROM s""")
def roc_curve_quality(spark, sf_dir):
    """M5: false/true positive rates at every distinct score."""
    return rounded(EV.roc_curve(doc_scores(spark, sf_dir)))


@register("confusion_matrix_priority",
          f"SELECT label, prediction, count(*) AS count FROM {_priority_sql()} GROUP BY ALL")
def confusion_matrix_priority(spark, sf_dir):
    """M4: confusion counts in long form."""
    return EV.confusion_matrix(priority_predictions(spark, sf_dir))


def price_predictions(spark, sf_dir, unit: float = 1500.0):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("label"),
                     (F.col("l_quantity") * F.lit(unit)).alias("prediction"))


def _price_sql(unit: float = 1500.0) -> str:
    return (f"(SELECT l_orderkey, l_linenumber, l_extendedprice AS label, l_quantity * {unit} AS prediction "
            "FROM lineitem)")


def _reg_sql(src: str) -> str:
    return (f"SELECT count(*) AS n, {r('avg((label - prediction) * (label - prediction))', 2)} AS mse, "
            f"{r('sqrt(avg((label - prediction) * (label - prediction)))')} AS rmse, {r('avg(abs(label - prediction))')} AS mae, "
            f"{r('1 - avg((label - prediction) * (label - prediction)) / var_pop(label)')} AS r2 FROM {src}")


@register("regression_metrics_price", _reg_sql(_price_sql()))
def regression_metrics_price(spark, sf_dir):
    """M3: MSE, RMSE, MAE and R^2 of a quantity-times-unit-price rule."""
    m = EV.regression_metrics(price_predictions(spark, sf_dir))
    return rounded(m.withColumn("mse", F.round("mse", 2)))


@register("residuals_price",
          f"SELECT l_orderkey, l_linenumber, label AS actual, prediction AS predicted, {r('label - prediction')} "
          f"AS residual FROM {_price_sql()}")
def residuals_price(spark, sf_dir):
    """M6: actual, predicted and residual per line."""
    res = EV.residuals(price_predictions(spark, sf_dir), keep=["l_orderkey", "l_linenumber"])
    return res.withColumn("residual", F.round("residual", 4))


_SHIFTS = [0.0, 50000.0, -50000.0]


@register("select_best_priority_rule", "WITH " + ", ".join(
    f"m{i} AS (SELECT 'rule_{i}' AS model, {i} AS position, * FROM ({_cls_metrics_sql(_priority_sql(s))}))"
    for i, s in enumerate(_SHIFTS))
    + " SELECT model, accuracy AS best_score, 'accuracy' AS metric FROM ("
    + " UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(len(_SHIFTS)))
    + ") ORDER BY accuracy DESC, position LIMIT 1")
def select_best_priority_rule(spark, sf_dir):
    """Three candidate rules evaluated; highest accuracy wins, earlier position on a tie."""
    frames = []
    for i, s in enumerate(_SHIFTS):
        m = rounded(EV.classification_metrics(priority_predictions(spark, sf_dir, s)))
        frames.append(m.select(F.lit(f"rule_{i}").alias("model"), F.lit(i).alias("position"), "*"))
    metrics = reduce(lambda a, b: a.unionByName(b), frames)
    return EV.select_best(metrics, "accuracy")


_UNITS = [1500.0, 1000.0, 2000.0]


@register("select_best_price_rule", "WITH " + ", ".join(
    f"m{i} AS (SELECT 'unit_{i}' AS model, {i} AS position, * FROM ({_reg_sql(_price_sql(u))}))"
    for i, u in enumerate(_UNITS))
    + " SELECT model, rmse AS best_score, 'rmse' AS metric FROM ("
    + " UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(len(_UNITS)))
    + ") ORDER BY rmse ASC, position LIMIT 1")
def select_best_price_rule(spark, sf_dir):
    """Minimised metric (rmse) across three candidate rules."""
    frames = []
    for i, u in enumerate(_UNITS):
        m = rounded(EV.regression_metrics(price_predictions(spark, sf_dir, u)))
        frames.append(m.select(F.lit(f"unit_{i}").alias("model"), F.lit(i).alias("position"), "*"))
    metrics = reduce(lambda a, b: a.unionByName(b), frames)
    return EV.select_best(metrics, "rmse")
