"""Catalog entries: profile, descriptive statistics, relationships, outliers."""

from __future__ import annotations

from tablelens.functions.numfmt import sig
from tablelens.operators import outliers, profile, relate, stats
from tablelens.operators import rules
from tablelens.plans.catalog import (
    LINEITEM_NUM,
    ORDERS_NULLS_COLS,
    ORDERS_NULLS_SQL,
    SCHEMAS,
    R,
    S,
    _kind,
    orders_nulls,
    register,
    table,
    union,
)

ON = ORDERS_NULLS_SQL
ON_CAT = [c for c, t in ORDERS_NULLS_COLS if t == "string"]
ON_ALL = [c for c, _ in ORDERS_NULLS_COLS]


def _dbl(c: str) -> str:
    return f"{c}::DOUBLE"


# ---------------------------------------------------------------- shape / missing
register("shape", "SELECT count(*)::BIGINT AS n_rows, 11::BIGINT AS n_columns FROM lineitem")(
    lambda s, d: profile.shape(table(s, d, "lineitem")))

register("null_counts", union(
    f"SELECT '{c}' AS \"column\", {i} AS ordinal, count(*) FILTER (WHERE {c} IS NULL)::BIGINT AS null_count, "
    f"count(*)::BIGINT AS n_rows FROM {ON}" for i, c in enumerate(ON_ALL)))(
    lambda s, d: profile.null_counts(orders_nulls(s, d)))

register("missing_pct", union(
    f"SELECT '{c}' AS \"column\", {i} AS ordinal, count(*) FILTER (WHERE {c} IS NULL)::BIGINT AS null_count, "
    f"{S(f'count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*)')} AS missing_pct, "
    f"count(*) FILTER (WHERE {c} IS NULL) > 0 AS has_missing FROM {ON}" for i, c in enumerate(ON_ALL)))(
    lambda s, d: profile.missing_pct(orders_nulls(s, d)))

_pat = " || ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in ON_ALL)
register("missing_patterns",
         f"SELECT {_pat} AS pattern, count(*)::BIGINT AS n FROM {ON} GROUP BY 1 ORDER BY n DESC, pattern LIMIT 10")(
    lambda s, d: profile.missing_patterns(orders_nulls(s, d)))

register("duplicate_rows",
         "SELECT count(*)::BIGINT AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, "
         "l_quantity FROM lineitem))::BIGINT AS n_distinct, (count(*) - (SELECT count(*) FROM (SELECT DISTINCT "
         "l_returnflag, l_linestatus, l_quantity FROM lineitem)))::BIGINT AS duplicate_rows FROM lineitem")(
    lambda s, d: profile.duplicate_rows(table(s, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")))

register("distinct_counts", union(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c})::BIGINT AS unique_count FROM {ON}" for c in ON_ALL))(
    lambda s, d: profile.distinct_counts(orders_nulls(s, d), ON_ALL))

_ID = "(lower('{c}') IN ('id','index','key') OR contains(lower('{c}'), 'id'))"
register("column_flags", union(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c})::BIGINT AS unique_count, count(DISTINCT {c}) <= 1 AS is_constant, "
    f"(count(DISTINCT {c}) / count(*) > 0.9 AND count(DISTINCT {c}) > 100) AS is_high_cardinality, "
    f"(count(DISTINCT {c}) = count(*) OR {_ID.format(c=c)}) AS is_potential_id FROM {ON}" for c in ON_ALL))(
    lambda s, d: profile.column_flags(orders_nulls(s, d)))

register("quality_report", union(
    f"SELECT '{c}' AS \"column\", {i} AS ordinal, '{t}' AS dtype, '{_kind(t)}' AS kind, "
    f"count(*) FILTER (WHERE {c} IS NULL)::BIGINT AS null_count, "
    f"{S(f'count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*)')} AS null_percentage, "
    f"count(DISTINCT {c})::BIGINT AS unique_count, count(DISTINCT {c}) <= 1 AS is_constant, "
    f"(count(DISTINCT {c}) / count(*) > 0.9 AND count(DISTINCT {c}) > 100) AS is_high_cardinality, "
    f"(count(DISTINCT {c}) = count(*) OR {_ID.format(c=c)}) AS is_potential_id FROM {ON}"
    for i, (c, t) in enumerate(ORDERS_NULLS_COLS)))(
    lambda s, d: profile.quality_report(orders_nulls(s, d)))

_W = {"bigint": 8, "int": 4, "double": 8, "timestamp": 8, "timestamp_ntz": 8}
register("logical_bytes", union(
    (f"SELECT '{c}' AS \"column\", {i} AS ordinal, (count(*) * {_W[t]})::BIGINT AS bytes FROM orders" if t in _W else
     f"SELECT '{c}' AS \"column\", {i} AS ordinal, coalesce(sum(strlen({c})), 0)::BIGINT AS bytes FROM orders")
    for i, (c, t) in enumerate(SCHEMAS["orders"])))(
    lambda s, d: profile.logical_bytes(table(s, d, "orders")))

_DT = ("CASE WHEN data_type = 'BIGINT' THEN 'bigint' WHEN data_type = 'INTEGER' THEN 'int' WHEN data_type = 'DOUBLE' "
       "THEN 'double' WHEN data_type = 'VARCHAR' THEN 'string' WHEN data_type = 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp' "
       "WHEN data_type LIKE 'TIMESTAMP%' THEN 'timestamp_ntz' "
       "ELSE lower(data_type) END")
register("dtype_counts",
         f"SELECT {_DT} AS dtype, count(*)::BIGINT AS n_columns FROM information_schema.columns "
         f"WHERE table_name = 'lineitem' GROUP BY 1")(
    lambda s, d: profile.dtype_counts(table(s, d, "lineitem")))

_KIND = ("CASE WHEN data_type IN ('BIGINT','INTEGER','DOUBLE','FLOAT','SMALLINT','TINYINT') THEN 'numeric' "
         "WHEN data_type = 'VARCHAR' THEN 'categorical' WHEN data_type LIKE 'TIMESTAMP%' OR data_type = 'DATE' "
         "THEN 'datetime' WHEN data_type = 'BOOLEAN' THEN 'boolean' ELSE 'other' END")
register("column_kinds",
         f"SELECT column_name AS \"column\", (ordinal_position - 1)::INTEGER AS ordinal, {_DT} AS dtype, {_KIND} AS kind "
         f"FROM information_schema.columns WHERE table_name = 'lineitem'")(
    lambda s, d: profile.column_kinds(table(s, d, "lineitem")))

_nullsum = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in ON_ALL)
register("quality_score",
         f"SELECT ({_nullsum})::BIGINT AS missing, (count(*) * {len(ON_ALL)})::BIGINT AS cells, "
         f"{S(f'greatest(0.0, 100.0 - ({_nullsum}) * 100.0 / (count(*) * {len(ON_ALL)}))')} AS quality_score FROM {ON}")(
    lambda s, d: profile.quality_score(orders_nulls(s, d)))

_FREQ_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "prio_m10", "o_orderpriority", "k"]
_freq_sql = union(f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS value FROM {ON} WHERE {c} IS NOT NULL" for c in _FREQ_COLS)
register("value_frequencies",
         f"SELECT \"column\", value, count(*)::BIGINT AS n FROM ({_freq_sql}) GROUP BY 1, 2")(
    lambda s, d: profile.value_frequencies(orders_nulls(s, d), _FREQ_COLS))

register("top_values",
         f"SELECT * FROM (SELECT \"column\", value, n, (row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value))::INTEGER AS rank "
         f"FROM (SELECT \"column\", value, count(*)::BIGINT AS n FROM ({_freq_sql}) GROUP BY 1, 2)) WHERE rank <= 10")(
    lambda s, d: profile.top_values(orders_nulls(s, d), _FREQ_COLS))

register("sample_values",
         f"SELECT \"column\", rank, value FROM (SELECT \"column\", value, (row_number() OVER (PARTITION BY \"column\" ORDER BY value))::INTEGER AS rank "
         f"FROM (SELECT DISTINCT \"column\", value FROM ({_freq_sql}))) WHERE rank <= 5")(
    lambda s, d: profile.sample_values(orders_nulls(s, d), _FREQ_COLS))

register("worst_missing",
         f"SELECT \"column\", null_count, missing_pct FROM ({union(f'''SELECT '{c}' AS "column", {i} AS ordinal, count(*) FILTER (WHERE {c} IS NULL)::BIGINT AS null_count, {S(f'count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*)')} AS missing_pct FROM {ON}''' for i, c in enumerate(ON_ALL))}) "
         f"WHERE null_count > 0 ORDER BY missing_pct DESC, ordinal LIMIT 15")(
    lambda s, d: profile.worst_missing(orders_nulls(s, d)))

register("preview_head", "SELECT * FROM customer ORDER BY c_custkey LIMIT 10")(
    lambda s, d: profile.preview_head(table(s, d, "customer"), ["c_custkey"]))

register("schema_listing", union(
    f"SELECT '{c}' AS \"column\", {i} AS ordinal, '{t}' AS dtype, "
    f"(SELECT string_agg({c}::VARCHAR, ', ' ORDER BY c_custkey) FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 3)) AS first_values"
    for i, (c, t) in enumerate(SCHEMAS["customer"])))(
    lambda s, d: profile.schema_listing(table(s, d, "customer"), ["c_custkey"]))

# ---------------------------------------------------------------- descriptive statistics
_LX = [(c, _dbl(c)) for c in LINEITEM_NUM]


def _describe_sql(cols, src):
    return union(
        f"SELECT '{c}' AS \"column\", {i} AS ordinal, count({x})::BIGINT AS count, {S(f'avg({x})')} AS mean, "
        f"{S(f'stddev_samp({x})')} AS std, {S(f'min({x})')} AS min, {S(f'quantile_cont({x}, 0.25)')} AS p25, "
        f"{S(f'quantile_cont({x}, 0.5)')} AS p50, {S(f'quantile_cont({x}, 0.75)')} AS p75, {S(f'max({x})')} AS max FROM {src}"
        for i, (c, x) in enumerate(cols))


register("describe_numeric", _describe_sql(_LX, "lineitem"))(
    lambda s, d: stats.describe_numeric(table(s, d, "lineitem")))

register("quartiles", union(
    f"SELECT '{c}' AS \"column\", {S(f'quantile_cont({x}, 0.25)')} AS q1, {S(f'quantile_cont({x}, 0.5)')} AS q2, "
    f"{S(f'quantile_cont({x}, 0.75)')} AS q3 FROM lineitem" for c, x in _LX))(
    lambda s, d: stats.quartiles(table(s, d, "lineitem")))


def _moment_sql(c, x, expr, name, src="lineitem"):
    return (f"SELECT '{c}' AS \"column\", {R(expr)} AS {name} FROM (SELECT avg(power(x - m, 2)) AS m2, "
            f"avg(power(x - m, 3)) AS m3, avg(power(x - m, 4)) AS m4 FROM (SELECT x, avg(x) OVER () AS m FROM "
            f"(SELECT {x} AS x FROM {src} WHERE {c} IS NOT NULL)))")


register("skewness", union(_moment_sql(c, x, "CASE WHEN m2 = 0 THEN NULL ELSE m3 / power(m2, 1.5) END", "skewness")
                           for c, x in _LX))(
    lambda s, d: stats.skewness(table(s, d, "lineitem")))

register("kurtosis", union(_moment_sql(c, x, "CASE WHEN m2 = 0 THEN NULL ELSE m4 / (m2 * m2) - 3 END", "kurtosis")
                           for c, x in _LX))(
    lambda s, d: stats.kurtosis(table(s, d, "lineitem")))

register("variance_cv", union(
    f"SELECT '{c}' AS \"column\", {S(f'var_samp({x})')} AS variance, "
    f"{S(f'CASE WHEN avg({x}) <> 0 THEN stddev_samp({x}) / avg({x}) ELSE 0.0 END')} AS coefficient_of_variation FROM lineitem"
    for c, x in _LX))(
    lambda s, d: stats.variance_cv(table(s, d, "lineitem")))

register("scale_ratio",
         f"SELECT {S('max(sd)')} AS max_std, {S('min(sd)')} AS min_std, {S('max(sd) / nullif(min(sd), 0)')} AS scale_ratio, "
         f"min(sd) = 0 AS infinite FROM ({union(f'SELECT stddev_samp({x}) AS sd FROM lineitem' for c, x in _LX)})")(
    lambda s, d: stats.scale_ratio(table(s, d, "lineitem")))

register("class_imbalance",
         f"SELECT count(*)::BIGINT AS n_classes, max(n)::BIGINT AS max_count, min(n)::BIGINT AS min_count, "
         f"{S('max(n) / min(n)')} AS imbalance_ratio FROM (SELECT l_returnflag, count(*) AS n FROM lineitem "
         f"WHERE l_returnflag IS NOT NULL GROUP BY 1)")(
    lambda s, d: stats.class_imbalance(table(s, d, "lineitem"), "l_returnflag"))

_CAT = ["o_orderstatus", "prio_m10", "o_orderpriority", "k"]


def _mode_sql(cols, src, body):
    vc = union(f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS value, count(*) AS n FROM {src} WHERE {c} IS NOT NULL GROUP BY 1, 2"
               for c in cols)
    return (f"SELECT {body} FROM (SELECT \"column\", count(*)::BIGINT AS unique_count, "
            f"first(value ORDER BY n DESC, value ASC) AS top, max(n)::BIGINT AS freq, "
            f"first(value ORDER BY n ASC, value DESC) AS least, min(n)::BIGINT AS least_freq FROM ({vc}) GROUP BY 1) m")


register("categorical_stats", _mode_sql(
    _CAT, ON, "\"column\", unique_count, top AS most_frequent, freq AS frequency_of_most_frequent, least AS least_frequent"))(
    lambda s, d: stats.categorical_stats(orders_nulls(s, d), _CAT))

register("categorical_analysis", _mode_sql(
    _CAT, ON, f"\"column\", unique_count AS unique_values, top AS most_frequent_value, freq AS most_frequent_count, "
              f"least AS least_frequent_value, least_freq AS least_frequent_count, "
              f"{S(f'unique_count / (SELECT count(*) FROM orders)')} AS cardinality_ratio"))(
    lambda s, d: stats.categorical_analysis(orders_nulls(s, d), _CAT))

_PART_NUM = [("p_partkey", "p_partkey::DOUBLE"), ("p_size", "p_size::DOUBLE"), ("p_retailprice", "p_retailprice")]
_PART_CAT = ["p_name", "p_brand", "p_type"]
register("describe_all",
         "SELECT \"column\", count, NULL::BIGINT AS unique, NULL::VARCHAR AS top, NULL::BIGINT AS freq, mean, std, min, p25, p50, p75, max "
         f"FROM ({_describe_sql(_PART_NUM, 'part')})\nUNION ALL\n"
         + _mode_sql(_PART_CAT, "part", "\"column\", (SELECT count(*) FROM part)::BIGINT AS count, unique_count AS unique, top, freq, "
                     "NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS p25, "
                     "NULL::DOUBLE AS p50, NULL::DOUBLE AS p75, NULL::DOUBLE AS max"))(
    lambda s, d: stats.describe_all(table(s, d, "part")))

# ---------------------------------------------------------------- correlation
def _corr_pairs_sql(cols, src, digits):
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i == j:
                r = f"CASE WHEN stddev_samp({a}::DOUBLE) > 0 THEN 1.0 END"
            else:
                r = f"CASE WHEN isnan(corr({a}::DOUBLE, {b}::DOUBLE)) THEN NULL ELSE corr({a}::DOUBLE, {b}::DOUBLE) END"
            parts.append(f"SELECT '{a}' AS col1, '{b}' AS col2, {i} AS i, {j} AS j, round(({r})::DOUBLE, {digits}) AS r FROM {src}")
    return union(parts)


_CORR_ALL = _corr_pairs_sql(LINEITEM_NUM, "lineitem", 6)
register("correlation_matrix",
         f"SELECT col1, col2, round(r, 3) AS correlation FROM ({_corr_pairs_sql(LINEITEM_NUM, 'lineitem', 12)})")(
    lambda s, d: relate.correlation_matrix(table(s, d, "lineitem")))

register("corr_heatmap",
         f"SELECT col1, col2, i, j, CASE WHEN j > i THEN NULL ELSE round(r, 3) END AS value "
         f"FROM ({_corr_pairs_sql(LINEITEM_NUM, 'lineitem', 12)})")(
    lambda s, d: relate.corr_heatmap(table(s, d, "lineitem"), mask_upper=True))

register("high_corr_pairs",
         f"SELECT col1 AS feature1, col2 AS feature2, round(r, 3) AS correlation FROM ({_corr_pairs_sql(LINEITEM_NUM, 'lineitem', 12)}) "
         f"WHERE i < j AND abs(r) > 0.7")(
    lambda s, d: relate.high_corr_pairs(table(s, d, "lineitem")))

_PART = ["p_partkey", "p_size", "p_retailprice"]

register("correlation_bands",
         f"SELECT col1 AS feature1, col2 AS feature2, round(r, 3) AS correlation, CASE WHEN abs(round(r, 3)) > 0.9 THEN 'Very Strong' ELSE 'Strong' END AS strength "
         f"FROM ({_corr_pairs_sql(_PART, 'part', 12)}) WHERE i < j AND abs(r) > 0.01")(
    lambda s, d: rules.correlation_bands(table(s, d, "part"), _PART, 0.01))

register("correlation_insights", f"""WITH p AS (SELECT col1, col2, i, j, r FROM ({_corr_pairs_sql(_PART, 'part', 12)}) WHERE i < j AND abs(r) > 0.01),
n AS (SELECT count(*) AS k FROM p)
SELECT 0 AS position, 'correlation' AS chart, NULL AS "column", CASE WHEN k = 0 THEN 'no_high_pairs' ELSE 'high_pairs:' || k END AS insight FROM n
UNION ALL SELECT position, 'correlation', "column", insight FROM (SELECT (row_number() OVER (ORDER BY i, j))::INTEGER AS position,
  col1 || ',' || col2 AS "column", printf('%.3f', r) AS insight FROM p) WHERE position <= 3""")(
    lambda s, d: rules.correlation_insights(table(s, d, "part"), _PART, 0.01))

register("correlation_summary",
         f"SELECT {R('max(mx)')} AS max_correlation, {R('min(mn)')} AS min_correlation, {R('avg(m)')} AS mean_abs_correlation, "
         f"{R('max(mo)')} AS max_offdiag FROM (SELECT j, avg(abs(r)) AS m, max(abs(r)) AS mx, min(r) AS mn, "
         f"max(CASE WHEN i <> j THEN abs(r) END) AS mo FROM ({_corr_pairs_sql(LINEITEM_NUM, 'lineitem', 15)}) GROUP BY j)")(
    lambda s, d: relate.correlation_summary(table(s, d, "lineitem")))

register("target_correlation", f"SELECT \"column\", {R('r')} AS correlation_with_target, CASE WHEN abs(r) > 0.7 THEN 'strong' "
         f"WHEN abs(r) > 0.3 THEN 'moderate' ELSE 'weak' END AS relationship_strength FROM ("
         + union(f"SELECT '{c}' AS \"column\", corr({c}::DOUBLE, l_extendedprice) AS r FROM lineitem"
                 for c in LINEITEM_NUM if c != "l_extendedprice") + ") WHERE r IS NOT NULL AND NOT isnan(r)")(
    lambda s, d: relate.target_correlation(table(s, d, "lineitem"), "l_extendedprice"))


def _anova_sql(cols, src, target):
    parts = []
    for c in cols:
        parts.append(
            f"SELECT '{c}' AS \"column\", count(*)::BIGINT AS k, sum(n)::BIGINT AS n, "
            f"(sum(n * power(mu - grand, 2)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f FROM ("
            f"SELECT n, mu, v, sum(n * mu) OVER () / sum(n) OVER () AS grand FROM ("
            f"SELECT count({c}) AS n, avg({c}::DOUBLE) AS mu, var_pop({c}::DOUBLE) AS v FROM {src} "
            f"WHERE {target} IS NOT NULL GROUP BY {target}) WHERE n > 0) HAVING count(*) > 1")
    return union(parts)


register("anova_f", f"SELECT \"column\", k, n, {S('f')} AS f_statistic FROM ({_anova_sql(LINEITEM_NUM, 'lineitem', 'l_returnflag')})")(
    lambda s, d: relate.anova_table(table(s, d, "lineitem"), "l_returnflag", LINEITEM_NUM).select(
        "column", "k", "n", sig("f").alias("f_statistic")))

register("anova_test")(lambda s, d: relate.anova_f(table(s, d, "lineitem"), "l_returnflag", LINEITEM_NUM))

# ---------------------------------------------------------------- outliers
def _iqr_sql(cols, src):
    parts = []
    for c, x in cols:
        parts.append(
            f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE x < lo OR x > hi)::BIGINT AS iqr_outliers_count, "
            f"{S('count(*) FILTER (WHERE x < lo OR x > hi) * 100.0 / count(*)')} AS iqr_outliers_percentage, "
            f"{S('min(lo)')} AS lower_bound, {S('min(hi)')} AS upper_bound FROM (SELECT {x} AS x, "
            f"q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM {src}, (SELECT quantile_cont({x}, 0.25) AS q1, "
            f"quantile_cont({x}, 0.75) AS q3 FROM {src}) WHERE {c} IS NOT NULL)")
    return union(parts)


register("iqr_outliers", _iqr_sql(_LX, "lineitem"))(lambda s, d: outliers.iqr_outliers(table(s, d, "lineitem")))

register("zscore_outliers", union(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE abs(x - m) / nullif(sd, 0) > 3)::BIGINT AS z_score_outliers_count, "
    f"{S('count(*) FILTER (WHERE abs(x - m) / nullif(sd, 0) > 3) * 100.0 / count(*)')} AS z_score_outliers_percentage "
    f"FROM (SELECT {x} AS x, avg({x}) OVER () AS m, stddev_pop({x}) OVER () AS sd FROM lineitem WHERE {c} IS NOT NULL)"
    for c, x in _LX))(lambda s, d: outliers.zscore_outliers(table(s, d, "lineitem")))

register("outlier_cell_count",
         f"SELECT sum(iqr_outliers_count)::BIGINT AS outlier_cells FROM ({_iqr_sql(_LX, 'lineitem')})")(
    lambda s, d: outliers.outlier_cell_count(table(s, d, "lineitem")))

_OR = [("o_custkey", "o_custkey::DOUBLE"), ("o_totalprice", "o_totalprice")]
register("outlier_rows", union(
    f"SELECT * FROM (SELECT '{c}' AS \"column\", o_orderkey, x AS value, (row_number() OVER (ORDER BY o_orderkey, x))::INTEGER AS rank "
    f"FROM (SELECT o_orderkey, {x} AS x, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM orders, "
    f"(SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM orders) WHERE {c} IS NOT NULL) "
    f"WHERE x < lo OR x > hi) WHERE rank <= 20" for c, x in _OR))(
    lambda s, d: outliers.outlier_rows(table(s, d, "orders"), "o_orderkey", [c for c, _ in _OR]))
