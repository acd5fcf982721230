"""Catalog entries: cleaning, encoding, scaling, splits, evaluation, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.functions.numfmt import sig
from tablelens.operators import drift, evaluate, prep, scaling, splits
from tablelens.plans.catalog import (
    ORDERS_NULLS_COLS,
    ORDERS_NULLS_SQL,
    R,
    S,
    orders_nulls,
    register,
    table,
    union,
)

ON = ORDERS_NULLS_SQL
ON_ALL = [c for c, _ in ORDERS_NULLS_COLS]

# ---------------------------------------------------------------- cleaning
register("drop_constant", f"SELECT {', '.join(c for c in ON_ALL if c != 'k')} FROM {ON}")(
    lambda s, d: prep.drop_constant(orders_nulls(s, d)))

register("drop_high_missing", f"SELECT {', '.join(c for c in ON_ALL if c != 'price_m60')} FROM {ON}")(
    lambda s, d: prep.drop_high_missing(orders_nulls(s, d)))

register("impute_mean", f"SELECT o_orderkey, {S('coalesce(price_m5, avg(price_m5) OVER ())')} AS price_m5 FROM {ON}")(
    lambda s, d: prep.impute(orders_nulls(s, d), ["price_m5"], "mean").select("o_orderkey", sig("price_m5").alias("price_m5")))

register("impute_median",
         f"SELECT o_orderkey, {S(f'coalesce(price_m20, (SELECT quantile_cont(price_m20, 0.5) FROM {ON}))')} AS price_m20 FROM {ON}")(
    lambda s, d: prep.impute(orders_nulls(s, d), ["price_m20"], "median").select(
        "o_orderkey", sig("price_m20").alias("price_m20")))

register("impute_mode",
         f"SELECT o_orderkey, coalesce(prio_m10, (SELECT v FROM (SELECT prio_m10 AS v, count(*) AS n FROM {ON} "
         f"WHERE prio_m10 IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1)) AS prio_m10 FROM {ON}")(
    lambda s, d: prep.impute(orders_nulls(s, d), ["prio_m10"], "mode").select("o_orderkey", "prio_m10"))

_WZ = ["o_orderkey", "o_custkey", "o_totalprice"]


def _clamp_sql(c, src):
    q = f"(SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {src})"
    lo = f"(SELECT q1 - 1.5 * (q3 - q1) FROM {q})"
    hi = f"(SELECT q3 + 1.5 * (q3 - q1) FROM {q})"
    return S(f"CASE WHEN {c}::DOUBLE < {lo} THEN {lo} WHEN {c}::DOUBLE > {hi} THEN {hi} ELSE {c}::DOUBLE END")


register("winsorize_iqr", f"SELECT {', '.join(_clamp_sql(c, 'orders') + ' AS ' + c for c in _WZ)}, o_orderstatus FROM orders")(
    lambda s, d: (lambda w: w.select(*[sig(c).alias(c) for c in _WZ], "o_orderstatus"))(
        prep.winsorize_iqr(table(s, d, "orders").select(*_WZ, "o_orderstatus"))))

_PRIOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
register("encode_onehot",
         "SELECT o_orderkey, " + ", ".join(f"coalesce(o_orderpriority = '{v}', false) AS \"o_orderpriority_{v}\""
                                          for v in _PRIOS[1:]) + " FROM orders")(
    lambda s, d: prep.encode_onehot(table(s, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority"))

register("encode_label",
         "SELECT p_partkey, (dense_rank() OVER (ORDER BY coalesce(p_brand::VARCHAR, 'nan')) - 1)::INTEGER AS p_brand FROM part")(
    lambda s, d: prep.encode_label(table(s, d, "part").select("p_partkey", "p_brand"), "p_brand"))


def _prep_report_sql():
    cols = [(c, t) for c, t in ORDERS_NULLS_COLS]
    parts = []
    for c, _t in cols:
        parts.append(f"SELECT 1 AS step_no, 'removed_constant_columns' AS step, '{c}' AS \"column\", "
                     f"'dropped_constant' AS action FROM {ON} HAVING count(DISTINCT {c}) <= 1")
    for c, t in cols:
        frac = f"(count(*) FILTER (WHERE {c} IS NULL) / count(*))"
        if t == "string":
            strat = f"CASE WHEN {frac} > 0.5 THEN 'dropped_high_missing' ELSE 'mode_imputation' END"
        else:
            strat = (f"CASE WHEN {frac} > 0.5 THEN 'dropped_high_missing' WHEN {frac} < 0.1 THEN 'mean_imputation' "
                     f"ELSE 'median_imputation' END")
        parts.append(f"SELECT 2, 'missing_value_imputation', '{c}', {strat} FROM {ON} "
                     f"HAVING count(DISTINCT {c}) > 1 AND {frac} > 0")
    for c, t in cols:
        if t != "string":
            continue
        frac = f"(count(*) FILTER (WHERE {c} IS NULL) / count(*))"
        enc = "'label_encoding'" if c == "o_orderstatus" else \
            f"CASE WHEN count(DISTINCT {c}) > 10 THEN 'label_encoding' ELSE 'one_hot_encoding' END"
        parts.append(f"SELECT 3, 'categorical_encoding', '{c}', {enc} FROM {ON} "
                     f"HAVING count(DISTINCT {c}) > 1 AND {frac} <= 0.5")
    parts.append("SELECT 4, 'outlier_treatment', NULL, 'iqr_winsorize'")
    return f"SELECT step_no::INTEGER AS step_no, step, \"column\", action FROM ({union(parts)})"


register("preprocess_report", _prep_report_sql())(
    lambda s, d: prep.preprocess(orders_nulls(s, d), target="o_orderstatus")[1])

register("drop_rare_classes",
         "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 2)")(
    lambda s, d: prep.drop_rare_classes(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey"))

# ---------------------------------------------------------------- scaling (fit and apply on the same table)
_SC = ["o_custkey", "o_totalprice"]
register("scale_standard", "SELECT o_orderkey, " + ", ".join(
    f"{R(f'({c}::DOUBLE - avg({c}::DOUBLE) OVER ()) / coalesce(nullif(stddev_pop({c}::DOUBLE) OVER (), 0), 1)', 9)} AS {c}"
    for c in _SC) + " FROM orders")(
    lambda s, d: scaling.scale(table(s, d, "orders").select("o_orderkey", *_SC), method="standard", cols=_SC)
    .select("o_orderkey", *[F.round(c, 9).alias(c) for c in _SC]))

register("scale_minmax", "SELECT o_orderkey, " + ", ".join(
    f"{R(f'({c}::DOUBLE - min({c}::DOUBLE) OVER ()) / coalesce(nullif(max({c}::DOUBLE) OVER () - min({c}::DOUBLE) OVER (), 0), 1)', 9)} AS {c}"
    for c in _SC) + " FROM orders")(
    lambda s, d: scaling.scale(table(s, d, "orders").select("o_orderkey", *_SC), method="minmax", cols=_SC)
    .select("o_orderkey", *[F.round(c, 9).alias(c) for c in _SC]))


def _robust(c):
    q = f"(SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.5) AS q2, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM orders)"
    return R(f"({c}::DOUBLE - (SELECT q2 FROM {q})) / coalesce(nullif((SELECT q3 - q1 FROM {q}), 0), 1)", 9)


register("scale_robust", "SELECT o_orderkey, " + ", ".join(f"{_robust(c)} AS {c}" for c in _SC) + " FROM orders")(
    lambda s, d: scaling.scale(table(s, d, "orders").select("o_orderkey", *_SC), method="robust", cols=_SC)
    .select("o_orderkey", *[F.round(c, 9).alias(c) for c in _SC]))

# ---------------------------------------------------------------- splits
_MD5 = "md5('{seed}|' || o_orderkey::VARCHAR)"
register("split_random",
         f"SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {_MD5.format(seed=42)}, o_orderkey) <= "
         f"ceil(0.2 * (SELECT count(*) FROM orders)) THEN 'test' ELSE 'train' END AS split FROM orders")(
    lambda s, d: splits.split_random(table(s, d, "orders").select("o_orderkey"), ["o_orderkey"], 0.2))

register("split_stratified",
         f"SELECT o_orderkey, o_orderstatus, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY "
         f"{_MD5.format(seed=42)}, o_orderkey) <= round(count(*) OVER (PARTITION BY o_orderstatus) * 0.2) "
         f"THEN 'test' ELSE 'train' END AS split FROM orders")(
    lambda s, d: splits.split_stratified(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"],
                                         "o_orderstatus", 0.2))

register("cv_fold_count",
         "SELECT sum(c)::BIGINT AS n_train, min(c)::BIGINT AS smallest_class, greatest(2, least(5, min(c), "
         "floor(sum(c) / 10)))::INTEGER AS cv_folds FROM (SELECT o_orderstatus, count(*) AS c FROM orders GROUP BY 1)")(
    lambda s, d: splits.cv_fold_count(table(s, d, "orders"), "o_orderstatus"))

register("cv_folds",
         f"SELECT o_orderkey, o_orderstatus, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY "
         f"{_MD5.format(seed=43)}, o_orderkey) - 1) % 5)::INTEGER AS fold FROM orders")(
    lambda s, d: splits.cv_folds(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 5,
                                 "o_orderstatus"))

register("infer_task_type",
         "SELECT 'o_orderstatus' AS target, count(DISTINCT o_orderstatus)::BIGINT AS unique_count, "
         "'classification' AS task_type FROM orders\nUNION ALL\n"
         "SELECT 'o_totalprice', count(DISTINCT o_totalprice)::BIGINT, CASE WHEN count(DISTINCT o_totalprice) < 20 "
         "THEN 'classification' ELSE 'regression' END FROM orders")(
    lambda s, d: splits.infer_task_type(table(s, d, "orders"), "o_orderstatus").unionByName(
        splits.infer_task_type(table(s, d, "orders"), "o_totalprice")))

# ---------------------------------------------------------------- evaluation
_PRED_SQL = "(SELECT l_returnflag AS label, CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'R' END AS prediction FROM lineitem)"


def _pred(s, d):
    li = table(s, d, "lineitem")
    return li.select(F.col("l_returnflag").alias("label"),
                     F.when(F.col("l_linestatus") == "O", "N").otherwise("R").alias("prediction"))


register("confusion_matrix",
         f"SELECT g.label, h.prediction, coalesce(c.n, 0)::BIGINT AS n FROM "
         f"(SELECT DISTINCT label FROM (SELECT label FROM {_PRED_SQL} UNION SELECT prediction FROM {_PRED_SQL})) g, "
         f"(SELECT DISTINCT label AS prediction FROM (SELECT label FROM {_PRED_SQL} UNION SELECT prediction FROM {_PRED_SQL})) h "
         f"LEFT JOIN (SELECT label, prediction, count(*) AS n FROM {_PRED_SQL} GROUP BY 1, 2) c "
         f"ON c.label = g.label AND c.prediction = h.prediction")(
    lambda s, d: evaluate.confusion_matrix(_pred(s, d), "label", "prediction"))

register("classification_metrics",
         "WITH cm AS (SELECT label AS y, prediction AS p, count(*) AS n FROM " + _PRED_SQL + " GROUP BY 1, 2), "
         "cls AS (SELECT y AS c FROM cm UNION SELECT p FROM cm), "
         "per AS (SELECT c, coalesce((SELECT sum(n) FROM cm WHERE y = c), 0) AS support, "
         "coalesce((SELECT sum(n) FROM cm WHERE p = c), 0) AS predicted, coalesce((SELECT sum(n) FROM cm WHERE y = c AND p = c), 0) AS tp FROM cls), "
         "m AS (SELECT c, support, tp, coalesce(tp / nullif(predicted, 0), 0) AS pr, coalesce(tp / nullif(support, 0), 0) AS rc FROM per) "
         "SELECT sum(support)::BIGINT AS n, sum(tp)::BIGINT AS correct, " + R("sum(tp) / sum(support)") + " AS accuracy, "
         + R("sum(pr * support) / sum(support)") + " AS precision, " + R("sum(rc * support) / sum(support)") + " AS recall, "
         + R("sum(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0) * support) / sum(support)") + " AS f1_score FROM m")(
    lambda s, d: evaluate.classification_metrics(_pred(s, d), "label", "prediction"))

register("regression_metrics",
         "SELECT count(*)::BIGINT AS n, " + S("1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))") + " AS r2_score, "
         + S("avg((y - p) * (y - p))") + " AS mse, " + S("avg(abs(y - p))") + " AS mae, " + S("sqrt(avg((y - p) * (y - p)))")
         + " AS rmse FROM (SELECT l_extendedprice AS y, l_quantity * p_retailprice AS p FROM lineitem JOIN part ON l_partkey = p_partkey)")(
    lambda s, d: evaluate.regression_metrics(
        table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * F.col("p_retailprice")).alias("p")), "y", "p"))

# ---------------------------------------------------------------- drift: lineitem snapshots by line status
_DRIFT_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
_DRIFT_CAT = ["l_returnflag", "l_linestatus"]


def _snapshots(s, d):
    li = table(s, d, "lineitem").select(*_DRIFT_NUM, *_DRIFT_CAT)
    return li.where(F.col("l_linestatus") == "F"), li.where(F.col("l_linestatus") == "O")


def _ks_sql(c):
    return (f"SELECT '{c}' AS \"column\", {R('max(abs(c1 / t1 - c2 / t2))')} AS ks_statistic FROM ("
            f"SELECT sum(n1) OVER (ORDER BY x) AS c1, sum(n2) OVER (ORDER BY x) AS c2, sum(n1) OVER () AS t1, "
            f"sum(n2) OVER () AS t2 FROM (SELECT coalesce(a.x, b.x) AS x, coalesce(a.n, 0) AS n1, coalesce(b.n, 0) AS n2 FROM "
            f"(SELECT {c}::DOUBLE AS x, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' AND {c} IS NOT NULL GROUP BY 1) a FULL JOIN "
            f"(SELECT {c}::DOUBLE AS x, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' AND {c} IS NOT NULL GROUP BY 1) b "
            f"ON a.x = b.x))")


def _chi_sql(c):
    side = ("(SELECT {c}::VARCHAR AS v, count(*) / sum(count(*)) OVER () AS pr FROM lineitem "
            "WHERE l_linestatus = '{s}' AND {c} IS NOT NULL GROUP BY 1)")
    return (f"SELECT '{c}' AS \"column\", count(*)::BIGINT AS n_categories, CASE WHEN bool_or(p = 0 AND q > 0) THEN NULL "
            f"ELSE {R('sum(CASE WHEN p > 0 THEN (q - p) * (q - p) / p END) / count(*)')} END AS chi2_score, "
            f"bool_or(p = 0 AND q > 0) AS infinite FROM (SELECT coalesce(a.pr, 0) AS p, coalesce(b.pr, 0) AS q FROM "
            f"{side.format(c=c, s='F')} a FULL JOIN {side.format(c=c, s='O')} b ON a.v = b.v)")


register("drift_ks", union(_ks_sql(c) for c in _DRIFT_NUM))(
    lambda s, d: drift.drift_ks(*_snapshots(s, d), _DRIFT_NUM))

register("drift_chi2", union(_chi_sql(c) for c in _DRIFT_CAT))(
    lambda s, d: drift.drift_chi2(*_snapshots(s, d), _DRIFT_CAT))

register("drift_report",
         "SELECT \"column\", test, score, infinite, drifted, (sum(drifted::INTEGER) OVER () > 0) AS overall_drift, "
         f"(sum(drifted::INTEGER) OVER () > {len(_DRIFT_NUM + _DRIFT_CAT)} * 0.5) AS full_retrain FROM ("
         "SELECT \"column\", test, score, infinite, infinite OR coalesce(score > 0.1, false) AS drifted FROM ("
         + union([f"SELECT \"column\", 'ks' AS test, ks_statistic AS score, false AS infinite FROM ({_ks_sql(c)})" for c in _DRIFT_NUM]
                 + [f"SELECT \"column\", 'chi2', chi2_score, infinite FROM ({_chi_sql(c)})" for c in _DRIFT_CAT]) + "))")(
    lambda s, d: drift.drift_report(*_snapshots(s, d)))
