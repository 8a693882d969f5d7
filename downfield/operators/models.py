"""One regressor for each target over shared features, with a registry on disk."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession, functions as F

from downfield.functions.scalars import finite, floor_at, half_even, log1p_or_zero, ratio
from downfield.operators.features import Scaler, standard_scaler
from downfield.operators.windows import training_rows

PREFIX = "next_week_"


def preprocess(df: DataFrame, skewed: Sequence[str] = (), ratios: Mapping[str, tuple[str, str]] | None = None, fill: Sequence[str] = (), fill_targets: bool = False, targets: Sequence[str] = ()) -> DataFrame:
    """Logs of skewed stats, guarded ratios, and 0 for infinities and nulls of features; of targets only if asked for."""
    out = df.withColumns({c: log1p_or_zero(c) for c in skewed}) if skewed else df
    out = out.withColumns({k: ratio(n, d) for k, (n, d) in (ratios or {}).items()}) if ratios else out
    zero = [*fill, *(targets if fill_targets else ())]
    return out.withColumns({c: F.coalesce(finite(c), F.lit(0.0)) for c in zero}) if zero else out


class Regressors:
    """Models by stat, features through one scaler and one pipeline."""

    def __init__(self, numeric: Sequence[str], categorical: Sequence[str] = (), kind: str = "linear", **params):
        self.numeric, self.categorical, self.kind, self.params = list(numeric), list(categorical), kind, params
        self.scaler: Scaler | None = None
        self.features: PipelineModel | None = None
        self.models: dict[str, PipelineModel] = {}

    def _estimator(self, target: str):
        made = {"linear": LinearRegression, "boosted": GBTRegressor}[self.kind]
        return made(featuresCol="features", labelCol=target, predictionCol=f"predicted_{target.removeprefix(PREFIX)}", **self.params)

    def _prepared(self, df: DataFrame) -> DataFrame:
        return self.features.transform(self.scaler.transform(df.fillna(0.0, subset=self.numeric), "__x_"))

    def fit(self, df: DataFrame, targets: Sequence[str]) -> "Regressors":
        """Fit on rows whose target is not null, one target after the other over cached features."""
        self.scaler = standard_scaler(df.fillna(0.0, subset=self.numeric), self.numeric)
        stages = []
        for c in self.categorical:  # an unseen value is in the dropped place, so all zeros
            stages += [StringIndexer(inputCol=c, outputCol=f"__i_{c}", handleInvalid="keep"), OneHotEncoder(inputCol=f"__i_{c}", outputCol=f"__o_{c}", dropLast=True)]
        stages.append(VectorAssembler(inputCols=[*(f"__x_{c}" for c in self.numeric), *(f"__o_{c}" for c in self.categorical)], outputCol="features"))
        self.features = Pipeline(stages=stages).fit(self.scaler.transform(df, "__x_"))
        data = self._prepared(df).select("features", *targets).cache()
        for t in targets:
            self.models[t.removeprefix(PREFIX)] = Pipeline(stages=[self._estimator(t)]).fit(data.filter(F.col(t).isNotNull()))
        data.unpersist()
        return self

    def update(self, df: DataFrame, targets: Sequence[str]) -> "Regressors":
        """Fit again on the dataset with its new rows."""
        return self.fit(df, targets)

    def predict(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """All targets for all rows in one plan."""
        out = self._prepared(df)
        for m in self.models.values():
            out = m.transform(out)
        return out.select(*keep, *(f"predicted_{s}" for s in self.models))

    def evaluate(self, df: DataFrame) -> DataFrame:
        """stat, mse and mae over rows with the target."""
        targets = [f"{PREFIX}{s}" for s in self.models if f"{PREFIX}{s}" in df.columns]
        out = self.predict(df, targets)
        rows = F.array(*(F.struct(F.lit(t.removeprefix(PREFIX)).alias("stat"), (F.col(f"predicted_{t.removeprefix(PREFIX)}") - F.col(t)).alias("e")) for t in targets))
        return out.select(F.explode(rows).alias("r")).groupBy("r.stat").agg(F.avg(F.col("r.e") ** 2).alias("mse"), F.avg(F.abs("r.e")).alias("mae"))

    def learning_curve(self, spark: SparkSession) -> DataFrame:
        """stat, iteration, loss of the linear models."""
        rows = [(s, i, float(v)) for s, m in self.models.items() if getattr(m.stages[-1], "hasSummary", False) for i, v in enumerate(m.stages[-1].summary.objectiveHistory)]
        return spark.createDataFrame(rows, "stat string, iteration int, loss double")

    def save(self, path: str, version: str = "current") -> None:
        spark = SparkSession.active()
        at = f"{path}/{version}"
        self.features.write().overwrite().save(f"{at}/features")
        for s, m in self.models.items():
            m.write().overwrite().save(f"{at}/model={s}")
        meta = [(c, "numeric", self.scaler.centre[c], self.scaler.scale[c]) for c in self.numeric] + [(c, "categorical", None, None) for c in self.categorical] + [(s, "model", None, None) for s in self.models] + [(self.kind, "kind", None, None), (json.dumps(self.params, sort_keys=True), "params", None, None)]
        spark.createDataFrame(meta, "name string, role string, centre double, scale double").coalesce(1).write.mode("overwrite").parquet(f"{at}/meta")

    @classmethod
    def load(cls, path: str, version: str = "current") -> "Regressors | None":
        """The saved models, or none if there are none."""
        try:
            meta = SparkSession.active().read.parquet(f"{path}/{version}/meta").collect()
        except AnalysisException:
            return None
        of = lambda role: [r for r in meta if r["role"] == role]
        out = cls([r["name"] for r in of("numeric")], [r["name"] for r in of("categorical")], of("kind")[0]["name"], **json.loads(of("params")[0]["name"]))
        out.scaler = Scaler({r["name"]: r["centre"] for r in of("numeric")}, {r["name"]: r["scale"] for r in of("numeric")})
        out.features = PipelineModel.load(f"{path}/{version}/features")
        out.models = {r["name"]: PipelineModel.load(f"{path}/{version}/model={r['name']}") for r in of("model")}
        return out


def train(df: DataFrame, stats: Sequence[str], numeric: Sequence[str], categorical: Sequence[str] = (), keys=("player_id", "season"), order=("week",), **kw) -> Regressors:
    """Lead targets, last rows dropped, one model for each stat."""
    return Regressors(numeric, categorical, **kw).fit(training_rows(df, stats, keys, order), [f"{PREFIX}{s}" for s in stats])


def finished(df: DataFrame, stats: Sequence[str], unfloored: Sequence[str] = ("offensive_snap_pct",)) -> DataFrame:
    """Predictions floored at 0.01 but for shares, rounded to two places."""
    return df.withColumns({f"predicted_{s}": half_even(f"predicted_{s}" if s in unfloored else floor_at(f"predicted_{s}")) for s in stats})


def gated(df: DataFrame, gate: str, columns: Sequence[str]) -> DataFrame:
    """Predictions times a share that passes through a logistic gate."""
    g = 1 / (1 + F.exp(-F.col(gate)))
    return df.withColumns({c: F.col(c) * g for c in columns})
