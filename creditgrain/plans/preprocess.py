"""Model inputs from account features: numeric columns imputed and standardised,
text columns replaced by their Weight of Evidence, the rest passed through."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import numeric_columns, string_columns
from ..operators.encode import NumericStats, WoeModel, fit_numeric
from ..schema import NOT_FEATURES


def feature_columns(df: DataFrame, extra: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Numeric and text model inputs by column type, without identifier, target and leakage."""
    excluded = [*NOT_FEATURES, *extra]
    return numeric_columns(df, excluded), string_columns(df, excluded)


class CreditPreprocessor(Estimator):
    """Fits on training rows only.

    ``keep`` columns (identifier, target, split) come through under their own
    names; other columns that are not encoded come through as ``remainder__x``
    unless ``drop_rest``.
    """

    def __init__(
        self,
        numeric: Sequence[str] | None = None,
        categorical: Sequence[str] | None = None,
        label: str = "HasFraud",
        keep: Sequence[str] = ("AccountId", "HasFraud", "split"),
        drop_rest: bool = False,
    ):
        super().__init__()
        self.numeric = numeric
        self.categorical = categorical
        self.label = label
        self.keep = tuple(keep)
        self.drop_rest = drop_rest

    def _fit(self, df: DataFrame) -> CreditPreprocessorModel:
        numeric, categorical = feature_columns(df, [*self.keep, self.label])
        if self.categorical is not None:
            categorical = list(self.categorical)
            numeric = [c for c in numeric if c not in categorical]
        if self.numeric is not None:
            numeric = list(self.numeric)
        return CreditPreprocessorModel(
            numeric,
            fit_numeric(df, numeric),
            WoeModel.fit(df, categorical, self.label),
            self.keep,
            self.drop_rest,
        )


class CreditPreprocessorModel(Model):
    def __init__(
        self,
        numeric: Sequence[str],
        stats: Sequence[NumericStats],
        woe: WoeModel,
        keep: Sequence[str],
        drop_rest: bool,
    ):
        super().__init__()
        self.numeric = list(numeric)
        self.stats = list(stats)
        self.woe = woe
        self.keep = tuple(keep)
        self.drop_rest = drop_rest

    @property
    def outputs(self) -> list[str]:
        """The model input columns, in order."""
        return [f"num__{s.feature}" for s in self.stats] + [f"cat__{c}" for c in self.woe.columns]

    def missing_columns(self, df: DataFrame) -> list[str]:
        """Fitted numeric columns the input lacks. An absent categorical column
        is no error: it has weight 0."""
        return [s.feature for s in self.stats if s.feature not in df.columns]

    def _transform(self, df: DataFrame) -> DataFrame:
        missing = self.missing_columns(df)
        if missing:
            raise ValueError(f"feature columns are missing: {', '.join(missing)}")
        weighted = self.woe.transform(df)
        used = {*self.numeric, *self.woe.columns, *self.keep}
        rest = [] if self.drop_rest else [c for c in df.columns if c not in used and c not in NOT_FEATURES]
        return weighted.select(
            *[c for c in df.columns if c in self.keep],
            *[s.standardized(F.col(s.feature)).alias(f"num__{s.feature}") for s in self.stats],
            *[F.col(c).alias(f"cat__{c}") for c in self.woe.columns],
            *[F.col(c).alias(f"remainder__{c}") for c in rest],
        )

    def save(self, path: str) -> None:
        spark = self.woe.table.sparkSession
        rows = [(i, *asdict(s).values()) for i, s in enumerate(self.stats)]
        spark.createDataFrame(
            rows, "position int, feature string, median double, mean double, std double"
        ).coalesce(1).write.mode("overwrite").parquet(f"{path}/numeric")
        settings = [(self.numeric, list(self.keep), self.drop_rest)]
        spark.createDataFrame(
            settings, "numeric array<string>, keep array<string>, drop_rest boolean"
        ).coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")
        self.woe.save(f"{path}/woe")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CreditPreprocessorModel:
        settings = spark.read.parquet(f"{path}/settings").first()
        stats = [
            NumericStats(r.feature, r.median, r.mean, r.std)
            for r in spark.read.parquet(f"{path}/numeric").orderBy("position").collect()
        ]
        woe = WoeModel.load(spark, f"{path}/woe")
        return cls(settings.numeric, stats, woe, settings.keep, settings.drop_rest)
