"""Random forest: train, version, update, predict, cross-validate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import preparation as P
from tidemark.operators.features import with_fold
from tidemark.session import saved
from tidemark.sources.csv_files import list_files

TREES, DEPTH, SEED = 100, 10, 42


@dataclass(frozen=True)
class ForestModel:
    """A fitted forest with the statistics and the stored dictionary its inputs are prepared by."""

    preparation: P.Preparation
    forest: RandomForestClassificationModel

    def transform(self, df: DataFrame) -> DataFrame:
        prepared = self.preparation.features(self.preparation.coded(df))
        return self.forest.transform(prepared)

    def save(self, path: str) -> None:
        """The forest goes last: a folder without it is not a version."""
        self.preparation.save(path)
        self.forest.write().overwrite().save(f"{path}/forest")

    @staticmethod
    def load(spark: SparkSession, path: str) -> ForestModel:
        return ForestModel(P.Preparation.load(spark, path), RandomForestClassificationModel.load(f"{path}/forest"))


@dataclass(frozen=True)
class Forest:
    """Impute, code, scale and classify. All statistics belong to the training rows.

    ``categories`` may have any number of values: their codes are a stored table that is joined.
    Nulls, and texts that the training rows lack, share the code after the last one.
    """

    numbers: list[str]
    categories: list[str]
    label: str
    trees: int = TREES
    depth: int = DEPTH

    def classifier(self) -> RandomForestClassifier:
        return RandomForestClassifier(
            featuresCol="_features", labelCol=self.label, numTrees=self.trees, maxDepth=self.depth, seed=SEED
        )

    def columns(self) -> list[str]:
        return list(dict.fromkeys([*self.numbers, *self.categories, self.label]))

    def fit(self, df: DataFrame) -> ForestModel:
        """``df`` is read once, into a table of the columns in use that all steps share."""
        rows = saved(df.select(*self.columns()).withColumn("fold", F.lit(0)), "training-rows")
        made = P.fit(rows, self.numbers, self.categories)
        inputs = saved(made.features(made.coded(rows)).select("_features", self.label), "training-features")
        return ForestModel(made, self.classifier().fit(inputs))


def forest(numbers: list[str], categories: list[str], label: str, trees: int = TREES, depth: int = DEPTH) -> Forest:
    return Forest(numbers, categories, label, trees, depth)


def score(model: ForestModel, df: DataFrame, label: str | None = None) -> DataFrame:
    """Rows with prediction and, where there are two classes, the score of class 1."""
    out = _outcome(model.transform(df), label)
    hidden = [c for c in out.columns if c not in df.columns and c not in ("y_pred", "score", "y_true")]
    return out.drop(*hidden)


def _outcome(predicted: DataFrame, label: str | None) -> DataFrame:
    added = {"y_pred": F.col("prediction").cast("int"), "score": F.element_at(_probabilities(), 2)}
    if label:
        added["y_true"] = F.col(label).cast("int")
    return predicted.withColumns(added)


def _probabilities() -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array("probability")


def accuracy(scored: DataFrame) -> float:
    return scored.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double"))).first()[0] or 0.0


def save_version(model: ForestModel, folder: str, version: int) -> str:
    path = f"{folder.rstrip('/')}/v{version}"
    model.save(path)
    return path


def newest_version(spark: SparkSession, folder: str) -> int | None:
    """Highest version number below a folder, by number and not by text."""
    number = F.regexp_extract("path", r"/v(\d+)/forest/metadata/", 1).try_cast("int")
    return list_files(spark, folder).agg(F.max(number)).first()[0]


def load_newest(spark: SparkSession, folder: str) -> ForestModel:
    version = newest_version(spark, folder)
    if version is None:
        raise FileNotFoundError(f"no model below {folder}")
    return ForestModel.load(spark, f"{folder.rstrip('/')}/v{version}")


def update_if_better(
    current: ForestModel,
    estimator: Forest,
    history: DataFrame,
    new: DataFrame,
    label: str,
    folder: str | None = None,
) -> tuple[ForestModel, bool, float, float]:
    """Retrain on old and new rows; keep the result only if it scores better on the new ones.

    Returns the model to use, whether it changed, and both accuracies. With the ``folder`` in which
    the current model is the newest version, a model that is replaced goes to its archive, and the new
    one is saved as the next version.
    """
    before = accuracy(score(current, new, label))
    candidate = estimator.fit(history.unionByName(new))
    after = accuracy(score(candidate, new, label))
    if after <= before:
        return current, False, before, after
    if folder is not None:
        version = newest_version(new.sparkSession, folder) or 1
        save_version(current, f"{folder.rstrip('/')}/archive", version)
        save_version(candidate, folder, version + 1)
    return candidate, True, before, after


def cross_validate(df: DataFrame, estimator: Forest, label: str, keys: list[str], folds: int = 5) -> DataFrame:
    """One row per fold with its accuracy (null where it has no rows); ``fold_summary`` condenses them.

    ``df`` is read once. The statistics of all folds come from one scan of the stored rows, and each row
    is joined to its codes once, for all folds.
    """
    rows = fold_rows(df, estimator, keys, folds)
    made = P.fit(rows, estimator.numbers, estimator.categories, folds)
    coded = saved(made.coded(rows), "fold-codes")
    out = None
    for k in range(folds):
        inputs = made.features(coded, k).select("fold", "_features", label)
        model = estimator.classifier().fit(inputs.filter(F.col("fold") != k))
        part = _outcome(model.transform(inputs.filter(F.col("fold") == k)), label).agg(
            F.lit(k).alias("fold"),
            F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def fold_rows(df: DataFrame, estimator: Forest, keys: list[str], folds: int) -> DataFrame:
    """The columns in use with their ``fold``, stored."""
    if "fold" in estimator.columns():
        raise ValueError("a column in use is named fold")
    return saved(with_fold(df, keys, folds).select("fold", *estimator.columns()), "fold-rows")


def fold_summary(scores: DataFrame) -> DataFrame:
    """Mean, population std, min and max over the folds."""
    return scores.agg(
        F.avg("accuracy").alias("cv_mean"),
        F.stddev_pop("accuracy").alias("cv_std"),
        F.min("accuracy").alias("cv_min"),
        F.max("accuracy").alias("cv_max"),
    )
