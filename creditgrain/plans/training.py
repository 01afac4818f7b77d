"""From transactions to stored model inputs to a fitted classifier."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import customer_features
from ..operators.metrics import classification_report, confusion_matrix, pr_auc, roc_auc
from ..operators.newton import MAX_INPUTS, LogitModel, fit_logit
from ..operators.sample import assign_split, oversample, with_class_weight
from ..schema import ACCOUNT, LEAKAGE, TARGET
from ..session import store
from ..sources.versions import current_version, new_version, publish
from .preprocess import CreditPreprocessor, CreditPreprocessorModel

MODEL_TYPES = ("logistic_regression", "gradient_boosting")
SOLVERS = ("newton", "lbfgs")


def build_features(txns: DataFrame, seed: int = 42, test_size: float = 0.2) -> DataFrame:
    """Stored account features with a stratified ``split`` column.

    Stored, because everything after it reads the table several times.
    """
    features = store(customer_features(txns), "features")
    return assign_split(features, TARGET, ACCOUNT, test_size, seed)


def preprocess(
    features: DataFrame, categorical: Sequence[str] | None = None
) -> tuple[DataFrame, CreditPreprocessorModel]:
    """Model inputs for all rows, with statistics fitted on the training rows.

    ``categorical`` names the columns to treat as categories, numeric ids for
    instance; by default the text columns.
    """
    usable = features.drop(LEAKAGE)
    fitted = CreditPreprocessor(categorical=categorical).fit(usable.where(F.col("split") == "train"))
    return fitted.transform(usable), fitted


@dataclass
class CreditModel:
    """Preprocessing and classifier as used for scoring."""

    preprocessor: CreditPreprocessorModel
    classifier: PipelineModel | LogitModel

    def probabilities(self, inputs: DataFrame) -> DataFrame:
        """Add ``p`` (probability of class 1) and ``prediction`` to model inputs."""
        if isinstance(self.classifier, LogitModel):
            return self.classifier.transform(inputs)
        scored = self.classifier.transform(inputs)
        return scored.withColumn("p", vector_to_array("probability")[1]).drop(
            "features", "rawPrediction", "probability"
        )

    def save(self, path: str) -> None:
        """Write the model and publish it: a reader gets all of the new one or the one before."""
        spark = self.preprocessor.woe.table.sparkSession
        version = new_version(path)
        self.preprocessor.save(f"{version}/preprocessing")
        kind = type(self.classifier).__name__
        spark.createDataFrame([(kind,)], "kind string").coalesce(1).write.parquet(f"{version}/kind")
        if isinstance(self.classifier, LogitModel):
            self.classifier.save(spark, f"{version}/logit")
        else:
            self.classifier.write().save(f"{version}/classifier")
        publish(spark, path, version)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CreditModel:
        version = current_version(spark, path)
        kind = spark.read.parquet(f"{version}/kind").first().kind
        return cls(
            CreditPreprocessorModel.load(spark, f"{version}/preprocessing"),
            LogitModel.load(spark, f"{version}/logit") if kind == LogitModel.__name__ else PipelineModel.load(f"{version}/classifier"),
        )


def train_model(
    train: DataFrame,
    inputs: Sequence[str],
    model_type: str = "logistic_regression",
    label: str = TARGET,
    key: str = ACCOUNT,
    seed: int = 42,
    solver: str = "newton",
) -> PipelineModel | LogitModel:
    """Balance the classes by oversampling and fit a classifier on ``inputs``.

    Logistic regression has an L2 penalty of strength 1 (per total weight, and
    not on the intercept) and balanced class weights; gradient boosting has 100
    trees of depth 3 with rate 0.1. ``solver`` is ``newton`` or ``lbfgs``, which
    find the same optimum; models too wide for the first get the second.
    """
    if solver not in SOLVERS:
        raise ValueError(f"solver must be one of {', '.join(SOLVERS)}, not {solver!r}")
    if model_type not in MODEL_TYPES:
        raise ValueError(f"model_type must be one of {', '.join(MODEL_TYPES)}, not {model_type!r}")
    # one stored table for all iterations; it outlives lost executors
    balanced = store(oversample(train.select(key, label, *inputs), label, key, seed), "training")
    assembler = VectorAssembler(inputCols=list(inputs), outputCol="features")
    weighted = with_class_weight(balanced.where(F.col(label).isNotNull()), label)
    if model_type == "logistic_regression" and solver == "newton" and len(inputs) <= MAX_INPUTS:
        return fit_logit(weighted, inputs, label, "weight")
    rows = assembler.transform(weighted).select(
        "features", "weight", F.col(label).cast("double").alias(label)
    )
    if model_type == "logistic_regression":
        # balanced weights add up to the number of rows
        total_weight = rows.count()
        estimator = LogisticRegression(
            labelCol=label,
            weightCol="weight",
            regParam=1.0 / total_weight,
            elasticNetParam=0.0,
            standardization=False,
            maxIter=1000,
            tol=1e-6,
        )
    else:
        estimator = GBTClassifier(
            labelCol=label, maxIter=100, maxDepth=3, stepSize=0.1, seed=seed
        )
    return PipelineModel([assembler, estimator.fit(rows)])


def fit_credit_model(
    txns: DataFrame,
    model_type: str = "logistic_regression",
    seed: int = 42,
    categorical: Sequence[str] | None = None,
) -> tuple[CreditModel, DataFrame]:
    """A fitted model and the stored model inputs of all accounts."""
    inputs, fitted = preprocess(build_features(txns, seed), categorical)
    inputs = store(inputs, "inputs")
    classifier = train_model(
        inputs.where(F.col("split") == "train"), fitted.outputs, model_type, seed=seed
    )
    return CreditModel(fitted, classifier), inputs


def evaluate(scored: DataFrame, label: str = TARGET) -> dict[str, DataFrame]:
    """Metrics of rows with ``label``, ``p`` and ``prediction``."""
    return {
        "roc_auc": roc_auc(scored, label),
        "pr_auc": pr_auc(scored, label),
        "classification_report": classification_report(scored, label),
        "confusion_matrix": confusion_matrix(scored, label),
    }
