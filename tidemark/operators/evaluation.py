"""Classification metrics and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.features import numeric_columns, text_columns
from tidemark.operators.ordered import running_total
from tidemark.operators.quality import value_frequencies


def confusion_matrix(scored: DataFrame) -> DataFrame:
    """(y_true, y_pred, n) of the pairs that occur."""
    return scored.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _class_counts(scored: DataFrame) -> DataFrame:
    """Per class: true rows, predicted rows, hits."""
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("y_true").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), hit.alias("hits")),
        F.struct(F.col("y_pred").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hits")),
    )
    return (
        confusion_matrix(scored)
        .select(F.inline(sides))
        .groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    )


def per_class_metrics(scored: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each true class; 0 where undefined."""
    p, r = _ratio(F.col("hits"), F.col("predicted")), _ratio(F.col("hits"), F.col("support"))
    return (
        _class_counts(scored)
        .withColumns({"precision": p, "recall": r})
        .withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
        .filter(F.col("support") > 0)
        .select("class", "precision", "recall", "f1", "support", "hits")
    )


def classification_metrics(scored: DataFrame) -> DataFrame:
    """One row: accuracy and support-weighted precision, recall and F1."""
    n = F.sum("support")

    def weighted(c: str) -> Column:
        return _ratio(F.sum(F.col(c) * F.col("support")), n)

    return per_class_metrics(scored).agg(
        _ratio(F.sum("hits"), n).alias("accuracy"),
        weighted("precision").alias("precision"),
        weighted("recall").alias("recall"),
        weighted("f1").alias("f1_score"),
    )


def roc_auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve with ties counted half; 0 where a class is missing.

    Rows are counted per score first, then running totals go over the scores.
    """
    counts = scored.groupBy("score").agg(
        F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") != 1).alias("neg")
    ).withColumn("all", F.lit("all"))
    placed = running_total(counts, "score", "neg", "all")
    below = F.col("running") - F.col("neg")
    wins = F.sum(F.col("pos") * (below + F.col("neg") / 2.0))
    return placed.agg(_ratio(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def evaluation(scored: DataFrame) -> DataFrame:
    """The whole evaluation in one row: metrics, AUC, confusion matrix and per-class part.

    The matrix has a row per true and a column per predicted class, classes in order.
    """
    cells = F.collect_list(F.struct("y_true", "y_pred", "n"))  # one per pair of classes
    seen = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("y_true", "y_pred")))))

    def count_of(a: Column, b: Column) -> Column:
        cell = F.get(F.filter("_cells", lambda c: (c["y_true"] == a) & (c["y_pred"] == b)), F.lit(0))
        return F.coalesce(cell["n"], F.lit(0).cast("bigint"))

    matrix = confusion_matrix(scored).agg(cells.alias("_cells"), seen.alias("_classes")).select(
        F.transform("_classes", lambda a: F.transform("_classes", lambda b: count_of(a, b)))
    )
    classes = per_class_metrics(scored).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("class").cast("string"), F.struct("precision", "recall", "f1"))))
    )
    return classification_metrics(scored).withColumns(
        {"roc_auc": roc_auc(scored).scalar(), "confusion_matrix": matrix.scalar(), "per_class": classes.scalar()}
    )


def _moments(df: DataFrame, columns: list[str], side: str) -> DataFrame:
    """(feature, mean, std) from one pass over the rows."""
    one = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("feature"),
                    F.avg(c).alias(f"{side}_mean"),
                    F.stddev_samp(c).alias(f"{side}_std"),
                )
                for c in columns
            ]
        ).alias("m")
    )
    return one.select(F.inline("m"))


def drift_numeric(
    reference: DataFrame, current: DataFrame, columns: list[str] | None = None, limit: float = 0.5
) -> DataFrame:
    """Shift of mean and spread of each numeric column, in reference standard deviations."""
    names = [c for c in columns or numeric_columns(reference) if c in current.columns]
    both = _moments(reference, names, "reference").join(_moments(current, names, "current"), "feature")
    wide = F.col("reference_std") > 0

    def shift(what: str) -> Column:
        gap = F.abs(F.col(f"current_{what}") - F.col(f"reference_{what}"))
        return F.when(wide, F.try_divide(gap, F.col("reference_std"))).otherwise(F.lit(0.0))

    return both.withColumns({"mean_drift": shift("mean"), "std_drift": shift("std")}).withColumn(
        "drift_detected",
        F.coalesce((F.col("mean_drift") > limit) | (F.col("std_drift") > limit), F.lit(False)),
    )


def drift_categorical(
    reference: DataFrame, current: DataFrame, columns: list[str] | None = None, limit: float = 0.3
) -> DataFrame:
    """Summed share difference over the categories both sides have, per text column."""
    names = [c for c in columns or text_columns(reference) if c in current.columns]
    ref, cur = value_frequencies(reference, names), value_frequencies(current, names)
    zero = F.lit(0).cast("bigint")
    sides = ref.select("column", "value", F.col("n").alias("r"), zero.alias("c")).unionByName(
        cur.select("column", "value", zero.alias("r"), F.col("n").alias("c"))
    )
    pairs = sides.groupBy("column", "value").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    totals = (
        sides.groupBy("column")
        .agg(F.struct(F.sum("r").alias("r"), F.sum("c").alias("c")).alias("t"))
        .agg(F.map_from_entries(F.collect_list(F.struct("column", "t"))))
        .scalar()
    )
    t = F.element_at(totals, F.col("column"))
    gap = F.abs(F.try_divide("r", t["r"]) - F.try_divide("c", t["c"]))
    common = (F.col("r") > 0) & (F.col("c") > 0)
    return (
        pairs.groupBy(F.col("column").alias("feature"))
        .agg(
            F.coalesce(F.sum(F.when(common, gap)), F.lit(0.0)).alias("distribution_drift"),
            F.count_if(common).alias("common_categories"),
        )
        .withColumn("drift_detected", F.col("distribution_drift") > limit)
    )


def drift_overall(numeric: DataFrame, categorical: DataFrame) -> DataFrame:
    """One row: features, drifted features, their share and its severity; none without features."""
    flags = numeric.select("drift_detected").unionByName(categorical.select("drift_detected"))
    counted = flags.agg(
        F.count(F.lit(1)).alias("total_features"),
        F.count_if("drift_detected").alias("drifted_features"),
    ).filter(F.col("total_features") > 0)
    share = F.col("drift_percentage")
    return counted.withColumn(
        "drift_percentage", F.col("drifted_features") / F.col("total_features")
    ).withColumn("drift_severity", F.when(share > 0.5, "high").when(share > 0.2, "medium").otherwise("low"))


def category_overlap(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Values of a column that both frames have."""
    side = lambda df: df.select(column).filter(F.col(column).isNotNull())
    return side(reference).intersect(side(current))
