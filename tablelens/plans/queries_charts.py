"""Catalog entries: chart data and rule-based findings."""

from __future__ import annotations

from tablelens.operators import charts, rules
from tablelens.plans.catalog import (
    LINEITEM_NUM,
    ORDERS_NULLS_COLS,
    ORDERS_NULLS_SQL,
    R,
    S,
    _kind,
    orders_nulls,
    register,
    table,
    union,
)

ON = ORDERS_NULLS_SQL
ON_ALL = [c for c, _ in ORDERS_NULLS_COLS]


# ---------------------------------------------------------------- charts
def _hist_sql(c, src, bins=30):
    return (f"SELECT '{c}' AS \"column\", bin, {S(f'lo + bin * ((hi - lo) / {bins}.0)')} AS bin_start, "
            f"{S(f'lo + (bin + 1) * ((hi - lo) / {bins}.0)')} AS bin_end, count(*)::BIGINT AS n FROM ("
            f"SELECT lo, hi, (CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) / ((hi - lo) / {bins}.0)), {bins - 1}) END)::INTEGER AS bin "
            f"FROM (SELECT {c}::DOUBLE AS x FROM {src} WHERE {c} IS NOT NULL), "
            f"(SELECT min({c}::DOUBLE) AS lo, max({c}::DOUBLE) AS hi FROM {src})) GROUP BY bin, lo, hi")


register("histogram", union(_hist_sql(c, "lineitem") for c in LINEITEM_NUM))(
    lambda s, d: charts.histogram(table(s, d, "lineitem"), LINEITEM_NUM))

register("histogram_markers", union(
    f"SELECT '{c}' AS \"column\", {S(f'avg({c}::DOUBLE)')} AS mean, {S(f'quantile_cont({c}::DOUBLE, 0.5)')} AS median FROM lineitem"
    for c in LINEITEM_NUM))(lambda s, d: charts.histogram_markers(table(s, d, "lineitem"), LINEITEM_NUM))

register("scatter_ols",
         "SELECT 'l_quantity' AS x, 'l_extendedprice' AS y, count(*)::BIGINT AS n, "
         f"{S('regr_slope(l_extendedprice, l_quantity)')} AS slope, {S('regr_intercept(l_extendedprice, l_quantity)')} AS intercept, "
         f"{R('corr(l_quantity, l_extendedprice)')} AS r FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL")(
    lambda s, d: charts.scatter_ols(table(s, d, "lineitem"), "l_quantity", "l_extendedprice"))


def _b(x, lo, hi, n):
    return f"(CASE WHEN {hi} = {lo} THEN 0 ELSE least(floor(({x} - {lo}) / (({hi} - {lo}) / {n}.0)), {n - 1}) END)::INTEGER"


register("scatter_bins",
         f"SELECT {_b('x', 'x0', 'x1', 50)} AS xbin, {_b('y', 'y0', 'y1', 50)} AS ybin, count(*)::BIGINT AS n FROM "
         "(SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL), "
         "(SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem) "
         "GROUP BY 1, 2")(lambda s, d: charts.scatter_bins(table(s, d, "lineitem"), "l_quantity", "l_extendedprice"))

_BOX = ("WITH d AS (SELECT coalesce(l_returnflag::VARCHAR, 'NULL') AS g, l_extendedprice AS x FROM lineitem WHERE l_extendedprice IS NOT NULL), "
        "q AS (SELECT g, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3 FROM d GROUP BY g), "
        "f AS (SELECT g, q1, med, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q) ")
register("box_stats",
         _BOX + f"SELECT f.g AS \"group\", count(*)::BIGINT AS n, {S('min(q1)')} AS q1, {S('min(med)')} AS median, {S('min(q3)')} AS q3, "
         f"{S('min(lo)')} AS lower_fence, {S('min(hi)')} AS upper_fence, {S('min(x) FILTER (WHERE x >= lo AND x <= hi)')} AS whisker_low, "
         f"{S('max(x) FILTER (WHERE x >= lo AND x <= hi)')} AS whisker_high, count(*) FILTER (WHERE x < lo OR x > hi)::BIGINT AS n_outliers "
         "FROM d JOIN f ON d.g = f.g GROUP BY f.g")(
    lambda s, d: charts.box_stats(table(s, d, "lineitem"), "l_extendedprice", "l_returnflag"))

register("violin_density",
         "SELECT g AS \"group\", bin, count(*)::BIGINT AS n, "
         f"{S('count(*) / (sum(count(*)) OVER (PARTITION BY g) * ((hi - lo) / 30.0))')} AS density FROM ("
         f"SELECT coalesce(l_returnflag::VARCHAR, 'NULL') AS g, lo, hi, {_b('l_extendedprice', 'lo', 'hi', 30)} AS bin FROM lineitem, "
         "(SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) WHERE l_extendedprice IS NOT NULL) "
         "GROUP BY g, bin, lo, hi")(
    lambda s, d: charts.violin_density(table(s, d, "lineitem"), "l_extendedprice", "l_returnflag"))

_BAR = union(f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS value FROM part WHERE {c} IS NOT NULL" for c in ["p_brand", "p_type"])
register("bar_top10",
         "SELECT * FROM (SELECT \"column\", value, n, (row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value))::INTEGER AS rank "
         f"FROM (SELECT \"column\", value, count(*)::BIGINT AS n FROM ({_BAR}) GROUP BY 1, 2)) WHERE rank <= 10")(
    lambda s, d: charts.bar_top10(table(s, d, "part"), ["p_brand", "p_type"]))

register("pie_shares",
         "SELECT value, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT o_orderpriority AS value, count(*)::BIGINT AS n "
         "FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1) WHERE (SELECT count(DISTINCT o_orderpriority) FROM orders) BETWEEN 2 AND 10")(
    lambda s, d: charts.pie_shares(table(s, d, "orders"), "o_orderpriority"))

register("missing_bar", "SELECT * FROM (" + union(
    f"SELECT '{c}' AS \"column\", {i} AS ordinal, count(*) FILTER (WHERE {c} IS NULL)::BIGINT AS null_count FROM {ON}"
    for i, c in enumerate(ON_ALL)) + ") WHERE null_count > 0")(lambda s, d: charts.missing_bar(orders_nulls(s, d)))

register("missing_matrix",
         "SELECT strip, \"column\", count(*)::BIGINT AS rows, round(avg(m), 6) AS missing_share FROM ("
         + union(f"SELECT {_b('o_orderkey::DOUBLE', 'k0', 'k1', 100)} AS strip, '{c}' AS \"column\", "
                 f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS m FROM {ON}, "
                 f"(SELECT min(o_orderkey)::DOUBLE AS k0, max(o_orderkey)::DOUBLE AS k1 FROM orders)" for c in ON_ALL)
         + ") GROUP BY 1, 2")(lambda s, d: charts.missing_matrix(orders_nulls(s, d), "o_orderkey"))

_NUM_ON = [c for c, t in ORDERS_NULLS_COLS if _kind(t) == "numeric"]
_ANY_MISSING = f"(SELECT count(*) FROM {ON} WHERE " + " OR ".join(f"{c} IS NULL" for c in ON_ALL) + ") > 0"
_MISSING_COLS = ("(SELECT string_agg(\"column\", ',' ORDER BY ordinal) FROM (" + union(
    f"SELECT '{c}' AS \"column\", {i} AS ordinal, count(*) FILTER (WHERE {c} IS NULL) AS m FROM {ON}" for i, c in enumerate(ON_ALL))
    + ") WHERE m > 0)")
_plan_parts = ["SELECT 0 AS ord, 'pie' AS chart, 'dtypes' AS columns",
               f"SELECT 1, 'bar', {_MISSING_COLS} WHERE {_ANY_MISSING}"]
_plan_parts += [f"SELECT {2 + i}, 'histogram', '{c}'" for i, c in enumerate(_NUM_ON[:5])]
_plan_parts.append(f"SELECT 10, 'correlation_heatmap', '{','.join(_NUM_ON)}'")
# the target is a string column, so its chart is a bar whatever its distinct count
_plan_parts.append("SELECT 11, 'bar', 'o_orderstatus'")
_plan_parts.append(f"SELECT 12, 'missing_heatmap', '{','.join(ON_ALL)}' WHERE {_ANY_MISSING}")
_plan_parts += [f"SELECT {13 + i}, 'box', '{c}'" for i, c in enumerate(_NUM_ON[:3])]
_plan_parts.append(f"SELECT 20, 'pca_scatter', '{','.join(_NUM_ON)}' WHERE (SELECT count(*) FROM orders) >= 10")
register("chart_plan",
         f"SELECT (row_number() OVER (ORDER BY ord) - 1)::INTEGER AS position, chart, columns FROM ({union(_plan_parts)}) "
         "QUALIFY position < 20")(
    lambda s, d: charts.chart_plan(orders_nulls(s, d), "o_orderstatus"))

# ---------------------------------------------------------------- rules
def _u(c, src):
    return f"(SELECT count(DISTINCT {c}) FROM {src})"


_st = []
for _i, (_c, _t) in enumerate(ORDERS_NULLS_COLS):
    _k = _kind(_t)
    _uu = _u(_c, ON)
    _st.append(
        f"SELECT '{_c}' AS \"column\", {_i} AS ordinal, CASE WHEN {_uu} = 2 THEN 'binary_classification' "
        f"WHEN {_uu} <= 20 AND '{_k}' = 'categorical' THEN 'multiclass_classification' "
        f"WHEN '{_k}' = 'numeric' AND {_uu} > 20 THEN 'regression' END AS task_type, "
        f"CASE WHEN {_uu} = 2 THEN 0.9 WHEN {_uu} <= 20 AND '{_k}' = 'categorical' THEN 0.7 "
        f"WHEN '{_k}' = 'numeric' AND {_uu} > 20 THEN 0.6 END::DOUBLE AS confidence")
register("suggest_targets",
         f"SELECT \"column\", task_type, confidence FROM ({union(_st)}) WHERE task_type IS NOT NULL "
         "ORDER BY confidence DESC, ordinal LIMIT 5")(lambda s, d: rules.suggest_targets(orders_nulls(s, d)))

register("modeling_suggestions", "SELECT \"column\", u AS unique_values, round(nn / n * 100, 6) AS null_percentage, "
         "CASE WHEN n < 1000 THEN 'random_forest,xgboost' ELSE 'xgboost,lightgbm,random_forest' END AS recommended_algorithms, "
         "(CASE WHEN n < 100 THEN 0.15 WHEN n > 10000 THEN 0.25 ELSE 0.2 END)::DOUBLE AS recommended_test_size FROM ("
         + union(f"SELECT '{c}' AS \"column\", count(DISTINCT {c})::BIGINT AS u, count(*) FILTER (WHERE {c} IS NULL) AS nn, "
                 f"count(*) AS n FROM {ON}" for c in ON_ALL) + ") WHERE nn / n < 0.1 AND u >= 2 AND u <= n * 0.9")(
    lambda s, d: rules.modeling_suggestions(orders_nulls(s, d)))

_PART = [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
         ("p_size", "int"), ("p_retailprice", "double")]
_DOCS = [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]


def _ft_sql(cols, src):
    parts = []
    for i, (c, t) in enumerate(cols):
        k = _kind(t)
        ml = f"avg(length({c}))" if k == "categorical" else "NULL"
        parts.append(
            f"SELECT '{c}' AS \"column\", {i} AS ordinal, CASE WHEN u <= 1 THEN 'constant' "
            f"WHEN '{k}' = 'datetime' THEN 'datetime' WHEN '{k}' IN ('numeric', 'boolean') AND u = 2 THEN 'binary' "
            f"WHEN '{k}' IN ('numeric', 'boolean') THEN 'numeric' WHEN '{k}' = 'categorical' AND u = 2 THEN 'binary' "
            f"WHEN '{k}' = 'categorical' AND u / n > 0.5 AND u > 50 THEN 'high_cardinality' "
            f"WHEN '{k}' = 'categorical' AND ml > 20 THEN 'text' WHEN '{k}' = 'categorical' THEN 'categorical' END AS feature_type "
            f"FROM (SELECT count(DISTINCT {c}) AS u, count(*) AS n, {ml} AS ml FROM {src})")
    return f"SELECT * FROM ({union(parts)}) WHERE feature_type IS NOT NULL"


register("feature_types", _ft_sql(_PART, "part"))(lambda s, d: rules.feature_types(table(s, d, "part")))
register("feature_types_text", _ft_sql(_DOCS, "documents"))(lambda s, d: rules.feature_types(table(s, d, "documents")))


def _bands_sql():
    parts = []
    for c, t in ORDERS_NULLS_COLS:
        k = _kind(t)
        if k == "numeric":
            x = f"{c}::DOUBLE"
            sk = (f"(SELECT CASE WHEN m2 = 0 THEN NULL ELSE m3 / power(m2, 1.5) END FROM (SELECT avg(power(x - m, 2)) AS m2, "
                  f"avg(power(x - m, 3)) AS m3 FROM (SELECT x, avg(x) OVER () AS m FROM (SELECT {x} AS x FROM {ON} WHERE {c} IS NOT NULL))))")
            q = f"(SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM {ON})"
            oc = (f"(SELECT count(*) FILTER (WHERE {x} < q1 - 1.5 * (q3 - q1) OR {x} > q3 + 1.5 * (q3 - q1)) FROM {ON}, {q})")
            op = f"({oc} * 100.0 / nullif((SELECT count({c}) FROM {ON}), 0))"
        else:
            sk, oc, op = "NULL", "NULL", "NULL"
        pct = f"(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*))"
        card = (f"CASE WHEN count(DISTINCT {c}) > 50 THEN 'High' WHEN count(DISTINCT {c}) > 10 THEN 'Medium' ELSE 'Low' END"
                if k == "categorical" else "NULL")
        parts.append(
            f"SELECT '{c}' AS \"column\", CASE WHEN {pct} = 0 THEN 'success' WHEN {pct} < 10 THEN 'warning' ELSE 'error' END AS null_badge, "
            f"CASE WHEN count(*) FILTER (WHERE {c} IS NULL) = 0 THEN NULL WHEN {pct} > 50 THEN 'critical' WHEN {pct} > 20 THEN 'high' "
            f"ELSE 'low' END AS missing_severity, {card} AS cardinality, "
            f"CASE WHEN {sk} IS NULL THEN NULL WHEN abs({sk}) < 0.5 THEN 'Symmetric' WHEN {sk} > 0 THEN 'Right-skewed' "
            f"ELSE 'Left-skewed' END AS distribution, CASE WHEN coalesce({oc}, 0) = 0 THEN NULL WHEN {op} > 10 THEN 'High' "
            f"WHEN {op} > 5 THEN 'Medium' ELSE 'Low' END AS outlier_severity FROM {ON}")
    return union(parts)


register("report_bands", _bands_sql())(lambda s, d: rules.report_bands(orders_nulls(s, d)))

_LI_CNT = "(SELECT count(*) FROM lineitem)"
_LI_MISS = "0.0"  # lineitem has no missing cells; the oracle still derives the share below
_LI_MISS_PCT = ("((SELECT " + " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c, _ in
                                          [(x, None) for x in LINEITEM_NUM + ['l_returnflag', 'l_linestatus', 'l_shipdate']])
                + " FROM lineitem) * 100.0 / (" + _LI_CNT + " * 11))")
_HIGH_CORR = ("(SELECT count(*) FROM (" + union(
    f"SELECT corr({a}::DOUBLE, {b}::DOUBLE) AS r FROM lineitem" for i, a in enumerate(LINEITEM_NUM)
    for b in LINEITEM_NUM[i + 1:]) + ") WHERE abs(r) > 0.8 AND r <> 1.0) > 0")
_IMB = ("(SELECT max(n) / min(n) FROM (SELECT count(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag))")
register("eda_insights",
         "SELECT (row_number() OVER (ORDER BY ord) - 1)::INTEGER AS position, rule, message FROM (" + union([
             f"SELECT 0 AS ord, 'small_dataset' AS rule, 'Dataset is small; more data would help model quality.' AS message WHERE {_LI_CNT} < 1000",
             f"SELECT 1, 'large_dataset', 'Large dataset; sampling can speed up exploration.' WHERE {_LI_CNT} > 100000",
             f"SELECT 2, 'high_missing', 'High share of missing values (' || printf('%.1f', {_LI_MISS_PCT}) || '%); plan imputation.' WHERE {_LI_MISS_PCT} > 20",
             f"SELECT 3, 'low_missing', 'Very few missing values.' WHERE {_LI_MISS_PCT} < 1",
             f"SELECT 4, 'high_correlation', 'Some features are highly correlated; consider feature selection.' WHERE {_HIGH_CORR}",
             f"SELECT 5, 'class_imbalance', 'Significant class imbalance; consider resampling.' WHERE {_IMB} > 5",
             "SELECT 6, 'high_dimensional', 'Many columns; consider dimensionality reduction.' WHERE 11 > 100"]) + ")")(
    lambda s, d: rules.eda_insights(table(s, d, "lineitem"), "l_returnflag"))

_STD_RATIO = ("(SELECT max(sd) / nullif(min(sd), 0) FROM (" + union(
    f"SELECT stddev_samp({c}::DOUBLE) AS sd FROM lineitem" for c in LINEITEM_NUM) + "))")
register("eda_recommendations",
         "SELECT (row_number() OVER (ORDER BY ord) - 1)::INTEGER AS position, rule, message FROM (" + union([
             f"SELECT 0 AS ord, 'imputation' AS rule, 'Impute missing values before modelling.' AS message WHERE {_LI_MISS_PCT} > 10",
             "SELECT 1, 'high_cardinality_encoding', 'Use target encoding or embeddings for high-cardinality categories.' "
             "WHERE (SELECT count(DISTINCT l_returnflag) FROM lineitem) > 50 OR (SELECT count(DISTINCT l_linestatus) FROM lineitem) > 50",
             "SELECT 2, 'classification', 'Classification task: try random forest or gradient boosting.'",
             f"SELECT 3, 'scaling', 'Features have very different scales; standardise or normalise.' WHERE coalesce({_STD_RATIO}, 1e300) > 100",
             f"SELECT 4, 'more_data', 'Few rows: augment or collect more data.' WHERE {_LI_CNT} < 1000"]) + ")")(
    lambda s, d: rules.eda_recommendations(table(s, d, "lineitem"), "l_returnflag"))

def _prep_suggest_sql():
    num_kind = [c for c, t in ORDERS_NULLS_COLS if _kind(t) == "numeric"]
    cast = ", ".join(f"{c}::DOUBLE AS {c}" for c in num_kind)
    n = f"(SELECT count(*) FROM {ON})"
    n_feat = len(ORDERS_NULLS_COLS) - 1
    long = f"(UNPIVOT (SELECT {cast} FROM {ON}) ON COLUMNS(*) INTO NAME col VALUE v)"
    ft = f"({_ft_sql(ORDERS_NULLS_COLS, ON)})"
    numf = f"(SELECT \"column\" FROM {ft} WHERE feature_type = 'numeric')"
    st = f"(SELECT col, stddev_samp(v) AS sd, min(v) AS mn FROM {long} WHERE col IN {numf} GROUP BY col)"
    q = f"(SELECT col, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM {long} GROUP BY col)"
    outl = (f"(SELECT count(*) FROM {long} l JOIN {q} q USING (col) WHERE l.col IN {numf} "
            f"AND (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)))")
    parts = [
        f"SELECT 0 AS ord, 0 AS sub, 'scaling' AS aspect, NULL AS \"column\", CASE WHEN (SELECT min(sd) = 0 OR max(sd) / min(sd) > 100 "
        f"OR min(mn) < 0 FROM {st}) THEN 'standard' ELSE 'minmax' END AS suggestion WHERE (SELECT count(*) FROM {numf}) > 0",
        f"SELECT 1, 0, 'feature_selection', NULL, CASE WHEN {n_feat} > {n} THEN 'univariate' ELSE 'model_based' END "
        f"WHERE {n_feat} > {n} OR {n_feat} > 50",
        f"SELECT 2, 0, 'dimensionality_reduction', NULL, 'pca' WHERE {n_feat} > 20 AND {n} > 100",
        f"SELECT 3, 0, 'encoding', NULL, 'one_hot_encoding' WHERE (SELECT count(*) FROM {ft} WHERE feature_type = 'categorical') > 0",
        f"SELECT 4, 0, 'encoding', NULL, 'target_encoding' WHERE (SELECT count(*) FROM {ft} WHERE feature_type = 'high_cardinality') > 0",
    ]
    for i, (c, t) in enumerate(ORDERS_NULLS_COLS):
        frac = f"(count(*) FILTER (WHERE {c} IS NULL) / count(*))"
        strat = (f"CASE WHEN {frac} > 0.5 THEN 'drop_column' WHEN {frac} < 0.1 THEN 'mean_imputation' ELSE 'median_imputation' END"
                 if _kind(t) == "numeric" else f"CASE WHEN {frac} > 0.5 THEN 'drop_column' ELSE 'mode_imputation' END")
        parts.append(f"SELECT 5, {i}, 'missing_value_strategy', '{c}', {strat} FROM {ON} HAVING {frac} > 0")
    parts += [
        f"SELECT 6, 0, 'outlier_treatment', NULL, 'true' WHERE (SELECT count(*) FROM {numf}) > 0 AND {outl} > {n} * 0.05",
        f"SELECT 7, 0, 'feature_engineering', NULL, 'datetime_features' WHERE (SELECT count(*) FROM {ft} WHERE feature_type = 'datetime') > 0",
        f"SELECT 8, 0, 'feature_engineering', NULL, 'polynomial_features' WHERE (SELECT count(*) FROM {numf}) > 1",
        f"SELECT 9, 0, 'feature_engineering', NULL, 'text_features' WHERE (SELECT count(*) FROM {ft} WHERE feature_type = 'text') > 0",
    ]
    return (f"SELECT (row_number() OVER (ORDER BY ord, sub) - 1)::INTEGER AS position, aspect, \"column\", suggestion "
            f"FROM ({union(parts)})")


register("suggest_preprocessing", _prep_suggest_sql())(
    lambda s, d: rules.suggest_preprocessing(orders_nulls(s, d), "o_orderstatus"))
def _chart_insights_sql():
    num = [c for c, t in ORDERS_NULLS_COLS if _kind(t) == "numeric"]
    parts = []
    for i, c in enumerate(num):
        x = f"{c}::DOUBLE"
        sk = (f"(SELECT CASE WHEN m2 = 0 THEN NULL ELSE m3 / power(m2, 1.5) END FROM (SELECT avg(power(x - m, 2)) AS m2, "
              f"avg(power(x - m, 3)) AS m3 FROM (SELECT x, avg(x) OVER () AS m FROM (SELECT {x} AS x FROM {ON} WHERE {c} IS NOT NULL))))")
        q = f"(SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM {ON})"
        oc = f"(SELECT count(*) FILTER (WHERE {x} < q1 - 1.5 * (q3 - q1) OR {x} > q3 + 1.5 * (q3 - q1)) FROM {ON}, {q})"
        nulls = f"(SELECT count(*) FILTER (WHERE {c} IS NULL) FROM {ON})"
        parts += [
            f"SELECT {i * 3} AS ord, 'histogram' AS chart, '{c}' AS \"column\", CASE WHEN {sk} IS NOT NULL AND abs({sk}) > 1 "
            f"THEN CASE WHEN {sk} > 0 THEN 'right_skewed' ELSE 'left_skewed' END ELSE 'symmetric' END AS insight",
            f"SELECT {i * 3 + 1}, 'histogram', '{c}', 'missing:' || {nulls} WHERE {nulls} > 0",
            f"SELECT {i * 3 + 2}, 'box', '{c}', CASE WHEN {oc} > 0 THEN 'outliers:' || {oc} || ':' || "
            f"printf('%.1f', {oc} * 100.0 / (SELECT count(*) FROM {ON})) || '%' ELSE 'no_outliers' END"]
    base = len(num) * 3
    r = f"(SELECT corr(o_totalprice, o_custkey::DOUBLE) FROM {ON})"
    parts.append(f"SELECT {base}, 'scatter', 'o_totalprice,o_custkey', CASE WHEN abs({r}) > 0.7 THEN "
                 f"'strong_' || CASE WHEN {r} > 0 THEN 'positive' ELSE 'negative' END WHEN abs({r}) > 0.3 THEN "
                 f"'moderate_' || CASE WHEN {r} > 0 THEN 'positive' ELSE 'negative' END ELSE 'weak' END WHERE {r} IS NOT NULL")
    miss = ("(SELECT * FROM (" + union(
        f"SELECT count(*) FILTER (WHERE {c} IS NULL) AS m, count(*) AS n FROM {ON}" for c in ON_ALL) + ") WHERE m > 0)")
    parts.append(f"SELECT {base + 1}, 'missing', NULL, 'columns_with_missing:' || (SELECT count(*) FROM {miss}) "
                 f"WHERE (SELECT count(*) FROM {miss}) > 0")
    parts.append(f"SELECT {base + 2}, 'missing', NULL, 'columns_over_50pct:' || (SELECT count(*) FROM {miss} WHERE m * 100.0 / n > 50) "
                 f"WHERE (SELECT count(*) FROM {miss} WHERE m * 100.0 / n > 50) > 0")
    cls = "(SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1)"
    parts.append(f"SELECT {base + 3}, 'target', 'o_orderstatus', 'classes:' || (SELECT count(*) FROM {cls})")
    parts.append(f"SELECT {base + 4}, 'target', 'o_orderstatus', 'imbalance:' || printf('%.1f', (SELECT max(n) / min(n) FROM {cls})) "
                 f"WHERE (SELECT max(n) / min(n) FROM {cls}) > 5")
    return (f"SELECT (row_number() OVER (ORDER BY ord) - 1)::INTEGER AS position, chart, \"column\", insight "
            f"FROM ({union(parts)})")


register("chart_insights", _chart_insights_sql())(
    lambda s, d: rules.chart_insights(orders_nulls(s, d), "o_orderstatus", "o_totalprice", "o_custkey"))
