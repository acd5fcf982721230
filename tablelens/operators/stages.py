"""Fitted preprocessors as pipeline stages that can be saved on their own (S13): P2-P6, P8-P10, M5-M7.

``Preprocess(steps)`` fits its steps in order on the training table, each on what the steps before give, and yields a
``Preprocessor``: a Spark ML model that applies the same columns, values, categories, codes and bounds to any table,
alone or in a ``Pipeline``. What was fitted is a short list per column, written as JSON; label codes, which have a row
per distinct value, are kept as a table.

Steps: ``drop_constant``, ``impute`` (P3-P6: dropped above half missing, then mean, median or mode), ``onehot``,
``label``, ``winsorize``, ``standard``, ``minmax``, ``robust``; each as a name, or (name, [columns]).

Defined results: columns that a table lacks are passed over; values that were not there when fitting have no dummy set
and a null label code; null stays null where no step fills it; extra columns pass.
"""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model
from pyspark.ml.util import MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import categorical_columns, clean_value, numeric_columns
from tablelens.functions.quantiles import quantiles_wide
from tablelens.operators import prep, scaling
from tablelens.operators.profile import distinct_counts
from tablelens.session import scratch_path

STEPS = ("drop_constant", "impute", "onehot", "label", "winsorize", "standard", "minmax", "robust")


def _fit_step(df: DataFrame, name: str, cols: list[str] | None, target: str | None) -> dict:
    """What a step learns: JSON-able, but for label codes, which are written under ``codes``."""
    if name == "drop_constant":
        return {"drop": [c for c in prep.constant_columns(df) if cols is None or c in cols]}
    if name == "impute":
        plan = {c: s for c, s in prep.impute_plan(df).items() if cols is None or c in cols}
        return {"plan": plan, "values": prep.fill_values(df, plan)}
    if name in ("onehot", "label"):
        cats = [c for c in categorical_columns(df) if c != target or name == "label"]
        if cols is None:
            n = {r["column"]: r["unique_count"] for r in distinct_counts(df, cats).collect()} if cats else {}
            few = {c for c in cats if c != target and n[c] <= prep.ONE_HOT_MAX}
            cols = [c for c in cats if (c in few) == (name == "onehot")]
        if name == "onehot":
            return {"categories": {c: prep.onehot_categories(df, c) for c in cols}}
        codes = {}
        for c in cols:
            codes[c] = scratch_path(df.sparkSession, "codes")
            prep.label_codes(df, c).write.parquet(codes[c])
        return {"codes": codes}
    cols = cols or numeric_columns(df)
    if name == "winsorize":
        q = {r["column"]: r for r in quantiles_wide(df, cols, (0.25, 0.75), ["q1", "q3"]).collect()}
        return {"bounds": {c: [r["q1"] - 1.5 * (r["q3"] - r["q1"]), r["q3"] + 1.5 * (r["q3"] - r["q1"])] for c, r in q.items() if r["q1"] is not None}}
    fit = {"standard": scaling.fit_standard, "minmax": scaling.fit_minmax, "robust": scaling.fit_robust}[name]
    return {"scales": {c: list(v) for c, v in fit(df, cols).items()}}


def _apply_step(df: DataFrame, name: str, fitted: dict) -> DataFrame:
    there = set(df.columns)
    if name == "drop_constant":
        return df.drop(*fitted["drop"])
    if name == "impute":
        return prep.apply_imputation(df, {c: s for c, s in fitted["plan"].items() if c in there}, fitted["values"])
    if name == "onehot":
        for c, cats in fitted["categories"].items():
            df = prep.encode_onehot(df, c, cats) if c in there else df
        return df
    if name == "label":
        for c, path in fitted["codes"].items():
            if c in there:
                codes = df.sparkSession.read.parquet(path).withColumnRenamed("value", "__value").withColumnRenamed("code", "__code")
                key = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan"))
                df = df.join(codes, key == F.col("__value"), "left").select(*[F.col("__code").alias(x) if x == c else F.col(f"`{x}`") for x in df.columns])
        return df
    if name == "winsorize":
        x = {c: clean_value(df, c).cast("double") for c in fitted["bounds"] if c in there}
        bounded = {c: F.when(v < F.lit(fitted["bounds"][c][0]), F.lit(fitted["bounds"][c][0])).when(
            v > F.lit(fitted["bounds"][c][1]), F.lit(fitted["bounds"][c][1])).otherwise(v) for c, v in x.items()}
        return df.select(*[bounded[c].alias(c) if c in bounded else F.col(f"`{c}`") for c in df.columns])
    return scaling._apply(df, {c: tuple(v) for c, v in fitted["scales"].items() if c in there})


class Preprocess(Estimator):
    """Fits the steps in order. ``target``: labelled rather than one-hot encoded."""

    def __init__(self, steps, target: str | None = None):
        super().__init__()
        self.steps = [(s, None) if isinstance(s, str) else (s[0], list(s[1])) for s in steps]
        self.target = target
        unknown = [s for s, _ in self.steps if s not in STEPS]
        if unknown:
            raise ValueError(f"Unknown steps: {unknown}")

    def copy(self, extra=None):
        return Preprocess([s if c is None else (s, c) for s, c in self.steps], self.target)

    def _fit(self, dataset: DataFrame) -> "Preprocessor":
        fitted = []
        for name, cols in self.steps:
            fitted.append((name, _fit_step(dataset, name, cols, self.target)))
            dataset = _apply_step(dataset, *fitted[-1])
        return Preprocessor(fitted)


class Preprocessor(Model, MLWritable, MLReadable):
    """The fitted steps: [(name, what it learnt)]."""

    def __init__(self, fitted):
        super().__init__()
        self.fitted = [(n, f) for n, f in fitted]

    def copy(self, extra=None):
        return Preprocessor(self.fitted)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        for name, fitted in self.fitted:
            dataset = _apply_step(dataset, name, fitted)
        return dataset

    def write(self) -> "PreprocessorWriter":
        return PreprocessorWriter(self)

    @classmethod
    def read(cls) -> "PreprocessorReader":
        return PreprocessorReader()


def _plain(v):
    """Values as JSON has them: decimals and dates as text, which the imputed column's type reads back."""
    return v if v is None or isinstance(v, (bool, int, float, str)) else str(v)


class PreprocessorWriter(MLWriter):
    def __init__(self, model: Preprocessor):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark, kept = self.sparkSession, []
        for k, (name, fitted) in enumerate(self.model.fitted):
            if name == "label":  # tables move with the model
                places = {}
                for j, (c, at) in enumerate(fitted["codes"].items()):
                    spark.read.parquet(at).write.parquet(f"{path}/codes/{k}-{j}")
                    places[c] = f"codes/{k}-{j}"
                fitted = {"codes": places}
            elif name == "impute":
                fitted = {"plan": fitted["plan"], "values": {c: _plain(v) for c, v in fitted["values"].items()}}
            kept.append([name, fitted])
        meta = {"class": "tablelens.operators.stages.Preprocessor", "uid": self.model.uid, "timestamp": 0, "sparkVersion": spark.version,
                "paramMap": {}, "defaultParamMap": {}}
        for name, value in (("steps", kept), ("metadata", meta)):
            spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.text(f"{path}/{name}")


class PreprocessorReader(MLReader):
    def load(self, path: str) -> Preprocessor:
        steps = json.loads(self.sparkSession.read.text(f"{path}/steps").first()["value"])
        return Preprocessor([(n, {"codes": {c: f"{path}/{at}" for c, at in f["codes"].items()}} if n == "label" else f) for n, f in steps])
