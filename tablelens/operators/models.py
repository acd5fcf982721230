"""Model training, tuning, ranking, persistence and scoring (M13, M14, M16-M19) with Spark ML.

Every algorithm is a Spark ML ``Pipeline``: label indexing (alphabetical, like
a label encoder), categorical indexing, mean imputation fitted on the training
rows, vector assembly, scaling, estimator. Hyper-parameter search is a seeded
random sample of the reference's search spaces, scored on hash-assigned folds;
all trials and folds run at once. Trees, forests and boosters are those of
``trees``: the boosters differ as their libraries do (first-order gradients on
depth-wise trees; second-order ones with L1 and L2; the same, leaf-wise). k
nearest neighbours run on the exact distributed join. Parameters are fitted as
given: nothing is clipped.
"""

from __future__ import annotations

import random
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, OneVsRest
from pyspark.ml.feature import Imputer, IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import kind_of, missing_flag
from tablelens.operators import evaluate, trees
from tablelens.operators.splits import cv_fold_count, cv_folds, split_random, split_stratified
from tablelens.session import scratch_path

SEED = 42

# fixed values: the algorithm names accepted by the reference and its default sets
CLASSIFIERS = ["random_forest", "xgboost", "lightgbm", "logistic_regression", "gradient_boosting", "svm", "knn",
               "naive_bayes", "decision_tree"]
REGRESSORS = ["random_forest", "xgboost", "lightgbm", "linear_regression", "ridge", "lasso", "gradient_boosting",
              "knn", "decision_tree"]
DEFAULT_CLASSIFIERS = ["random_forest", "xgboost", "logistic_regression", "gradient_boosting"]
DEFAULT_REGRESSORS = ["random_forest", "xgboost", "linear_regression", "gradient_boosting"]

# fixed values: search spaces of the reference (integer ranges, then float ranges)
SPACES = {
    "random_forest": {"n_estimators": (50, 300), "max_depth": (3, 10), "min_samples_split": (5, 20),
                      "min_samples_leaf": (2, 10)},
    "xgboost": {"n_estimators": (50, 300), "max_depth": (3, 8), "learning_rate": (0.01, 0.2),
                "subsample": (0.6, 0.9), "colsample_bytree": (0.6, 0.9), "reg_alpha": (0.1, 10.0), "reg_lambda": (0.1, 10.0)},
    "lightgbm": {"n_estimators": (50, 300), "max_depth": (3, 8), "learning_rate": (0.01, 0.2),
                 "feature_fraction": (0.6, 0.9), "bagging_fraction": (0.6, 0.9), "reg_alpha": (0.1, 10.0), "reg_lambda": (0.1, 10.0)},
}
_INT_PARAMS = {"n_estimators", "max_depth", "min_samples_split", "min_samples_leaf"}


@dataclass
class AutoMLResult:
    task_type: str
    leaderboard: DataFrame
    models: dict = field(default_factory=dict)
    best_algorithm: str | None = None
    params: dict = field(default_factory=dict)
    feature_cols: list = field(default_factory=list)


def infer_task(df: DataFrame, target: str) -> str:
    """M8, by the same rule as ``splits.infer_task_type``: missing values don't count."""
    kind = kind_of(df.schema[target].dataType)
    if kind != "numeric":
        return "classification"
    n = df.select(target).where(~missing_flag(df, target)).distinct().limit(20).count()
    return "classification" if n < 20 else "regression"


#: What each tree model uses where a parameter is unset. Depth 0: unlimited.
TREE_DEFAULTS = {
    "random_forest": {"n_estimators": 100, "max_depth": 0, "min_samples_leaf": 1},
    "gradient_boosting": {"n_estimators": 100, "max_depth": 3, "learning_rate": 0.1, "min_samples_leaf": 1},
    "xgboost": {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.3, "min_samples_leaf": 1, "reg_lambda": 1.0, "min_child_weight": 1.0},
    "lightgbm": {"n_estimators": 100, "max_depth": 0, "num_leaves": 31, "learning_rate": 0.1, "min_samples_leaf": 20, "min_child_weight": 1e-3},
    "decision_tree": {"max_depth": 0, "min_samples_leaf": 1},
}


def tree_params(name: str, hp: dict | None) -> dict:
    """The parameters that are fitted: what was asked for, else the algorithm's defaults; nothing is clipped."""
    p = {**TREE_DEFAULTS[name], **(hp or {})}
    if int(p["max_depth"] or 0) < 0:
        p["max_depth"] = 0  # how the boosters' library writes "unlimited"
    return {"trees": int(p.get("n_estimators", 1)), "depth": int(p["max_depth"] or 0), "lr": float(p.get("learning_rate", 0.1)),
            "min_leaf": int(p["min_samples_leaf"]), "min_split": int(p.get("min_samples_split", 2)),
            "leaves": int(p.get("num_leaves", 0)), "l1": float(p.get("reg_alpha", 0.0)), "l2": float(p.get("reg_lambda", 0.0)),
            "min_hessian": float(p.get("min_child_weight", 0.0)),
            "subsample": float(p.get("subsample", p.get("bagging_fraction", 1.0))),
            "colsample": float(p.get("colsample_bytree", p.get("feature_fraction", 1.0)))}


BOOSTERS = ("gradient_boosting", "xgboost", "lightgbm")


def tree_spec(name: str, task: str, n_classes: int, hp: dict | None, n_features: int = 0) -> trees.Spec:
    """What ``trees`` fits. A forest's classifier looks at the root of the number of features per node, as in the
    original library (``n_features`` 0: all); its regressor at all."""
    p = tree_params(name, hp)
    classes = max(2, n_classes) if task == "classification" else 0
    common = {"n_classes": classes, "trees": p["trees"], "depth": p["depth"], "min_split": p["min_split"], "min_leaf": p["min_leaf"], "seed": SEED}
    if name == "decision_tree":
        return trees.Spec("forest", **common)
    if name == "random_forest":
        return trees.Spec("forest", per_node=max(1, int(n_features ** 0.5)) if classes and n_features else 0, bootstrap=True, **common)
    return trees.Spec("boost", leaves=p["leaves"], rate=p["lr"], l1=p["l1"], l2=p["l2"], min_hessian=p["min_hessian"], subsample=p["subsample"],
                      colsample=p["colsample"], second_order=name != "gradient_boosting", **common)


def make_estimator(name: str, task: str, n_classes: int = 2, hp: dict | None = None, n_rows: int = 1,
                   label_std: float = 1.0, n_features: int = 0):
    """The unfitted estimator. ``n_rows`` scales penalties: the reference's losses are sums over rows,
    Spark's are means; and Spark divides a square penalty by the label's (population) deviation."""
    classify = task == "classification"
    fcol, lcol = "features", "label"
    hp = hp or {}
    n = max(1, n_rows)
    if name in TREE_DEFAULTS:
        return trees.Trees(tree_spec(name, task, n_classes, hp, n_features), fcol, lcol)
    if classify:
        if name == "logistic_regression":  # C: the inverse of the penalty on the summed loss
            return LogisticRegression(featuresCol=fcol, labelCol=lcol, maxIter=100, regParam=1.0 / (float(hp.get("C", 1.0)) * n))
        if name == "svm":
            svc = LinearSVC(featuresCol=fcol, labelCol=lcol, maxIter=100, regParam=1.0 / (float(hp.get("C", 1.0)) * n))
            return svc if n_classes <= 2 else OneVsRest(classifier=svc, featuresCol=fcol, labelCol=lcol)
        if name == "naive_bayes":
            return NaiveBayes(featuresCol=fcol, labelCol=lcol, modelType="gaussian")
    else:
        plain = {"featuresCol": fcol, "labelCol": lcol, "standardization": False}
        if name == "linear_regression":
            return LinearRegression(**plain)
        if name == "ridge":  # sum of squares + alpha |w|^2, where Spark halves and averages both
            return LinearRegression(regParam=float(hp.get("alpha", 1.0)) * label_std / n, elasticNetParam=0.0, **plain)
        if name == "lasso":  # both libraries average and halve the squares
            return LinearRegression(regParam=float(hp.get("alpha", 1.0)), elasticNetParam=1.0, **plain)
    raise ValueError(f"Unsupported algorithm for {task}: {name}")


def _as_numbers(df: DataFrame, features: list[str]) -> list[str]:
    """Features that become one number each: numeric, boolean (0/1) and date-time (seconds)."""
    return [c for c in features if kind_of(df.schema[c].dataType) in ("numeric", "boolean", "datetime")]


def _as_codes(df: DataFrame, features: list[str]) -> list[str]:
    return [c for c in features if kind_of(df.schema[c].dataType) == "categorical"]


def feature_stages(df: DataFrame, target: str, task: str, features: list[str] | None = None):
    """Pipeline stages turning raw columns into (features, label); returns (stages, feature names)."""
    features = features or [c for c in df.columns if c != target]
    num, cat = _as_numbers(df, features), _as_codes(df, features)
    stages = []
    idx_out = [f"{c}__idx" for c in cat]
    if cat:
        stages.append(StringIndexer(inputCols=cat, outputCols=idx_out, handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
    dbl = [f"{c}__dbl" for c in num]
    imp = [f"{c}__imp" for c in num]
    if num:
        stages.append(Imputer(inputCols=dbl, outputCols=imp, strategy="mean"))
    stages.append(VectorAssembler(inputCols=imp + idx_out, outputCol="raw_features", handleInvalid="keep"))
    stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=False, withStd=True))
    if task == "classification":
        stages.insert(0, StringIndexer(inputCol=f"{target}__str", outputCol="label", stringOrderType="alphabetAsc",
                                       handleInvalid="skip"))
    return stages, num + cat


def prepare(df: DataFrame, target: str, task: str, features: list[str] | None = None,
            extra: list[str] | None = None) -> DataFrame:
    """Cast features to double or string and the target to its label type; drop rows whose target is missing."""
    features = features or [c for c in df.columns if c != target and c not in (extra or [])]
    d = df.where(~missing_flag(df, target))
    cols = []
    for c in _as_numbers(df, features):
        v = F.col(f"`{c}`")
        if kind_of(df.schema[c].dataType) == "datetime":
            v = F.unix_micros(v.cast("timestamp")) / 1e6
        cols.append(v.cast("double").alias(f"{c}__dbl"))
    cols += [F.col(f"`{c}`") for c in _as_codes(df, features)]
    if task == "classification":
        cols.append(F.col(f"`{target}`").cast("string").alias(f"{target}__str"))
    else:
        cols.append(F.col(f"`{target}`").cast("double").alias("label"))
    return d.select(*[F.col(f"`{c}`") for c in (extra or [])], *cols)


class KnnModel:
    """M13 knn: the scaled training rows, kept in the shared folder, answered by the exact kNN join."""

    def __init__(self, features: PipelineModel, path: str, k: int, task: str, target: str):
        self.features, self.path, self.k, self.task, self.target = features, path, k, task, target

    def transform(self, prepared: DataFrame) -> DataFrame:
        from tablelens.operators.resample import knn_predict
        y = f"{self.target}__str" if self.task == "classification" else "label"
        spark = prepared.sparkSession
        rows = _numbered(self.features.transform(prepared), y)
        pred = knn_predict(spark.read.parquet(self.path), rows, "id", "vec", y, self.k, self.task)
        out = "predicted_label" if self.task == "classification" else "prediction"
        return rows.join(pred.withColumnRenamed("prediction", out), "id").select(y, out)


def _numbered(featured: DataFrame, y: str) -> DataFrame:
    """(id, vec, y), written once so that the ids stay."""
    path = scratch_path(featured.sparkSession, "knn-rows")
    featured.select(F.monotonically_increasing_id().alias("id"), vector_to_array("features").alias("vec"), y).write.parquet(path)
    return featured.sparkSession.read.parquet(path)


def train(train_df: DataFrame, target: str, algorithm: str, task: str, hp: dict | None = None,
          features: list[str] | None = None):
    """Fit one algorithm as a full pipeline on the training rows."""
    # every stage fit and every optimiser iteration reads the training rows: materialise them once
    prepared = prepare(train_df, target, task, features).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        stages, names = feature_stages(train_df, target, task, features)
        y = f"{target}__str" if task == "classification" else "label"
        if algorithm == "knn":
            fitted = Pipeline(stages=stages).fit(prepared)
            path = scratch_path(train_df.sparkSession, "knn-model")
            _numbered(fitted.transform(prepared), y).write.parquet(path)
            return KnnModel(fitted, path, int((hp or {}).get("n_neighbors", 5)), task, target)
        if task == "classification":
            (n_rows, n_classes), spread = prepared.agg(F.count(F.lit(1)), F.count_distinct(y)).first(), 1.0
        else:
            (n_rows, spread), n_classes = prepared.agg(F.count(F.lit(1)), F.stddev_pop(y)).first(), 0
        est = make_estimator(algorithm, task, n_classes, hp, n_rows, spread or 1.0, len(names))
        model = Pipeline(stages=stages + [est]).fit(prepared)
    finally:
        prepared.unpersist()
    if task == "classification":
        labels = model.stages[0].labels
        return PipelineModel(stages=model.stages + [IndexToString(inputCol="prediction", outputCol="predicted_label",
                                                                  labels=labels)])
    return model


def predict(model, df: DataFrame, target: str, task: str, features: list[str] | None = None) -> DataFrame:
    return model.transform(prepare(df, target, task, features))


def score(pred: DataFrame, task: str, target: str) -> dict:
    """Primary and secondary metrics of a prediction frame (accuracy & weighted P/R/F1, or R^2/MSE/MAE/RMSE)."""
    if task == "classification":
        m = evaluate.classification_metrics(pred, f"{target}__str", "predicted_label").first().asDict()
        return {"accuracy": m["accuracy"], "precision": m["precision"], "recall": m["recall"], "f1_score": m["f1_score"]}
    m = evaluate.regression_metrics(pred, "label", "prediction").first().asDict()
    return {"r2_score": m["r2_score"], "mse": m["mse"], "mae": m["mae"], "rmse": m["rmse"]}


def feature_importance(model, feature_names: list[str]) -> list[tuple[str, float]]:
    """Tree importances, or mean |coefficient| over classes; sorted descending (none for knn)."""
    if isinstance(model, KnnModel):
        return []
    est = model.stages[-2] if isinstance(model.stages[-1], IndexToString) else model.stages[-1]
    vals = None
    if hasattr(est, "featureImportances"):
        vals = list(est.featureImportances.toArray())
    elif hasattr(est, "coefficientMatrix"):
        m = est.coefficientMatrix.toArray()
        vals = [float(abs(m[:, j]).mean()) for j in range(m.shape[1])]
    elif hasattr(est, "coefficients"):
        vals = [abs(float(v)) for v in est.coefficients.toArray()]
    elif hasattr(est, "models"):  # one-vs-rest: average the per-class importances
        acc = None
        for sub in est.models:
            v = sub.featureImportances.toArray() if hasattr(sub, "featureImportances") else abs(sub.coefficients.toArray())
            acc = v if acc is None else acc + v
        vals = list(acc / len(est.models))
    if vals is None:
        return []
    pairs = list(zip(feature_names, [float(v) for v in vals]))
    return sorted(pairs, key=lambda t: -abs(t[1]))


def sample_trials(algorithm: str, n_trials: int, seed: int = SEED) -> list[dict]:
    """Seeded random draws from the algorithm's search space (no space -> the default only)."""
    space = SPACES.get(algorithm)
    if not space:
        return [{}]
    rnd = random.Random(f"{seed}-{algorithm}")
    out = []
    for _ in range(n_trials):
        hp = {}
        for k, (lo, hi) in space.items():
            hp[k] = rnd.randint(lo, hi) if k in _INT_PARAMS else rnd.uniform(lo, hi)
        out.append(hp)
    return out


class Trial(tuple):
    """(parameters, score), with the folds done and the error of a trial that failed (it scores 0, as in the reference)."""

    def __new__(cls, hp: dict, score: float, folds_done: int = 0, error: str | None = None):
        t = super().__new__(cls, (hp, score))
        t.folds_done, t.error = folds_done, error
        return t


def tune(train_df: DataFrame, target: str, algorithm: str, task: str, n_trials: int = 20, folds: int | None = None,
         features: list[str] | None = None, key_cols: list[str] | None = None, timeout: float | None = None):
    """Random search (at most 20 trials, as the reference) scored by k-fold CV accuracy / R^2 on
    hash-assigned folds, by default as many as M3 gives; returns (best hp, [(hp, score)]), the trials as ``Trial``.

    Features are encoded and binned once. Where the binned rows fit a task, every trial and fold is a task of one
    job; else trials run as concurrent fits of the distributed growth. ``timeout`` (seconds; the reference stops after
    300, here off by default): trials that have not begun by then are left out, and those that have are reported."""
    trials = sample_trials(algorithm, min(n_trials, 20))
    if trials == [{}]:
        return {}, []
    deadline = time.time() + timeout if timeout else None
    data = train_df.where(~missing_flag(train_df, target))
    if folds is None:
        folds = cv_fold_count(data, target if task == "classification" else None, task == "classification").first()["cv_folds"]
    features = features or [c for c in train_df.columns if c != target]
    keys = key_cols or list(train_df.columns)
    folded = cv_folds(data, keys, folds, target if task == "classification" else None)
    prepared = prepare(folded, target, task, features, extra=["fold"]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        stages, names = feature_stages(train_df, target, task, features)
        fitted = Pipeline(stages=stages).fit(prepared)
        n_classes = len(fitted.stages[0].labels) if task == "classification" else 0
        binned = trees.binned(fitted.transform(prepared).select("features", "label", "fold"), others=("fold",))
    finally:
        prepared.unpersist()
    specs = [tree_spec(algorithm, task, n_classes, hp, len(names)) for hp in trials]
    if binned.fits(trees.TASK_BYTES):
        found = trees.search_at_hand(binned, specs, folds, deadline)
    else:
        found = _search_by_fits(binned, specs, folds, deadline)
    results = [Trial(hp, sum(got) / len(got), len(got), error) for hp, (got, error) in zip(trials, found) if got]
    if not results:
        return {}, []
    return max(results, key=lambda t: t[1])[0], results


def _search_by_fits(binned, specs, folds: int, deadline: float | None, at_once: int = 4):
    """Trials and folds as concurrent fits over the written rows."""
    def one(task):
        spec, f = task
        if deadline is not None and time.time() >= deadline:
            return None, None
        try:
            return trees.fit_and_score(binned, spec, f), None
        except Exception as e:  # noqa: BLE001 -- a failed trial scores 0, as in the reference, and is reported
            return 0.0, f"{type(e).__name__}: {str(e)[:200]}"

    with ThreadPoolExecutor(at_once) as pool:
        got = list(pool.map(one, [(s, f) for s in specs for f in range(folds)]))
    out = []
    for k in range(len(specs)):
        mine = got[k * folds:(k + 1) * folds]
        out.append(([s for s, _ in mine if s is not None], next((e for _, e in mine if e), None)))
    return out


def leaderboard_df(spark, rows: list[tuple], task: str) -> DataFrame:
    """(algorithm, score, rank, metrics, error) ranked by the primary metric; the first wins ties, and
    algorithms that failed come last with their error. Metrics of the training rows start with train_."""
    metric = "accuracy" if task == "classification" else "r2_score"
    ordered = sorted(enumerate(rows), key=lambda t: (t[1][2] is not None, -(t[1][1].get(metric) or 0.0), t[0]))
    out = [(alg, None if error else float(m.get(metric) or 0.0), rank, {k: float(v) for k, v in m.items() if v is not None}, error)
           for rank, (_, (alg, m, error)) in enumerate(ordered, start=1)]
    return spark.createDataFrame(out, "algorithm string, score double, rank int, metrics map<string,double>, error string")


def automl(df: DataFrame, target: str, key_cols: list[str], task_type: str = "auto", test_size: float = 0.2,
           algorithms: list[str] | None = None, tune_trials: int = 20, defaults: dict | None = None,
           timeout: float | None = None) -> AutoMLResult:
    """Prepare, drop rare classes, split, tune and train each algorithm, evaluate on training and test
    rows, rank. ``tune_trials=0``: no search. ``defaults``: hyper-parameters by algorithm, over the usual
    defaults, for algorithms without a search. ``timeout``: seconds for the search of one algorithm (see ``tune``)."""
    from tablelens.operators.prep import drop_rare_classes, validate_target
    validate_target(df, target)
    task = infer_task(df, target) if task_type == "auto" else task_type
    data = df.where(~missing_flag(df, target))
    if task == "classification":
        data = drop_rare_classes(data, target, 2)
        n = data.count()
        k = data.select(target).distinct().count()
        if n < 10 or n < 2 * k:
            raise ValueError("Not enough rows for training after removing rare classes")
        split = split_stratified(data, key_cols, target, test_size)
    else:
        if data.count() < 10:
            raise ValueError("Dataset too small: at least 10 rows are needed for training")
        split = split_random(data, key_cols, test_size)
    path = scratch_path(df.sparkSession, "split")
    split.write.parquet(path)  # ranked once: every row is in one part, whatever runs again later
    split = df.sparkSession.read.parquet(path)
    tr = split.where(F.col("split") == "train").drop("split")
    te = split.where(F.col("split") == "test").drop("split")
    if tr.count() < 3:
        raise ValueError("Training set too small: at least 3 rows are needed")
    feats = [c for c in df.columns if c != target and c not in key_cols]
    algos = algorithms or (DEFAULT_CLASSIFIERS if task == "classification" else DEFAULT_REGRESSORS)
    rows, models, params = [], {}, {}
    for alg in algos:
        try:
            hp = dict((defaults or {}).get(alg, {}))
            if tune_trials and alg in SPACES:
                hp = tune(tr, target, alg, task, tune_trials, None, feats, key_cols, *([timeout] if timeout else []))[0]
            m = train(tr, target, alg, task, hp, feats)
            metrics = score(predict(m, te, target, task, feats), task, target)
            metrics |= {f"train_{k}": v for k, v in score(predict(m, tr, target, task, feats), task, target).items()}
            rows.append((alg, metrics, None))
            models[alg], params[alg] = m, hp
        except Exception as e:  # noqa: BLE001 -- one failing algorithm must not lose the others; it is reported
            rows.append((alg, {}, f"{type(e).__name__}: {str(e)[:300]}"))
    if not models:
        raise RuntimeError("All algorithms failed: " + "; ".join(f"{a}: {e}" for a, _, e in rows))
    lb = leaderboard_df(df.sparkSession, rows, task)
    best = lb.orderBy("rank").first()["algorithm"]
    return AutoMLResult(task, lb, models, best, feats, params)


def save(model: PipelineModel, path: str) -> None:
    """Persist the fitted pipeline (preprocessing + estimator)."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def batch_score(path: str, df: DataFrame, target: str, task: str, features: list[str]) -> DataFrame:
    """Score a frame with a saved pipeline."""
    return predict(load(path), df, target, task, features)
