"""What the registered queries must return, as plain SQL over the same tables.

The two dirty views are one text for both engines. Per-column statements are made
from a column list, so that each rule is written once.
"""

from __future__ import annotations

DIRTY_EVENTS = """b AS (SELECT event_id, ts, user_id,
   CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS event_type,
   CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value,
   CASE WHEN event_id % 10 < 6 THEN NULL ELSE user_id END AS sparse_user,
   CAST(user_id AS STRING) AS num_text,
   CASE WHEN event_id % 4 = 0 THEN event_type ELSE CAST(user_id AS STRING) END AS mixed,
   CAST(CAST(ts AS DATE) AS STRING) AS date_text,
   'x' AS const_col,
   100000.0E0 + event_id % 3 AS low_var
 FROM events),
events_dirty AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE event_id % 50 = 0)"""

SPARSE_CUSTOMERS = """customer_sparse AS (SELECT
   CASE WHEN c_custkey % 100 = 0 THEN NULL ELSE c_custkey END AS c_custkey,
   CASE WHEN c_custkey % 8 = 0 OR c_custkey % 100 = 0 THEN NULL ELSE c_name END AS c_name,
   CASE WHEN c_custkey % 8 = 0 OR c_custkey % 100 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey,
   CASE WHEN c_custkey % 8 = 0 OR c_custkey % 100 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
   CASE WHEN c_custkey % 4 = 0 OR c_custkey % 100 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment,
   CAST(NULL AS STRING) AS empty_col
 FROM customer)"""

# Columns of the inputs with their types.
EVENTS_DIRTY = {
    "event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string",
    "value": "double", "sparse_user": "bigint", "num_text": "string", "mixed": "string",
    "date_text": "string", "const_col": "string", "low_var": "double",
}
SPARSE = {
    "c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double",
    "c_mktsegment": "string", "empty_col": "string",
}
LINEITEM = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}
EVENTS = {
    "event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string",
    "value": "double", "props": "string",
}
CUSTOMER = {
    "c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double",
    "c_mktsegment": "string",
}
SUPPLIER = {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"}
PART = {
    "p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int",
    "p_retailprice": "double",
}
ORDERS = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
}
DOCUMENT_TEXTS = {"text": "string", "lang": "string", "source": "string"}
LABELS = {"doc_id": "bigint", "quality": "int", "toxic": "int"}

NUMERIC = ("bigint", "int", "double")
WIDTH = {"bigint": 8, "double": 8, "timestamp_ntz": 8, "int": 4}
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
DATE = r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?\s*$"


def _numbers(cols):
    return [c for c, t in cols.items() if t in NUMERIC]


def _texts(cols):
    return [c for c, t in cols.items() if t == "string"]


def _each(cols, table, make, only=None):
    """UNION ALL of one SELECT per column."""
    names = list(cols)
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, {names.index(c)} AS position, '{cols[c]}' AS dtype, {make(c)} FROM {table}"
        for c in names if only is None or c in only)


def _with(*ctes):
    return "WITH " + ",\n".join(ctes)


def _presence(cols, table):
    return _each(cols, table, lambda c: f"count(*) AS n, count({c}) AS nn, count(*) - count({c}) AS missing, "
                                        f"count(DISTINCT {c}) AS d")


def _parse(c):
    return (f"count(*) AS n, count({c}) AS nn, count(DISTINCT {c}) AS d, "
            f"count(*) FILTER (WHERE regexp_matches({c}, '{NUMBER}')) AS num, "
            f"count(*) FILTER (WHERE regexp_matches({c}, '{DATE}') AND try_cast({c} AS TIMESTAMP) IS NOT NULL) AS dat")


def _semantic(cols, table):
    fixed = {"bigint": "integer", "int": "integer", "double": "float", "timestamp_ntz": "datetime"}
    parts = []
    for i, (c, t) in enumerate(cols.items()):
        if t == "string":
            kind = ("CASE WHEN nn = 0 THEN 'empty' WHEN num = nn THEN 'numeric_string' "
                    "WHEN dat = nn THEN 'datetime_string' "
                    "WHEN d * 1.0 / nn < 0.1 AND d < 50 THEN 'categorical' ELSE 'text' END")
            source = f"(SELECT {_parse(c)} FROM {table})"
        else:
            kind = f"CASE WHEN nn = 0 THEN 'empty' ELSE '{fixed[t]}' END"
            source = f"(SELECT count(*) AS n, count({c}) AS nn FROM {table})"
        parts.append(f"SELECT '{c}' AS column_name, {i} AS position, '{t}' AS dtype, {kind} AS semantic_type, "
                     f"n > nn AS nullable FROM {source}")
    return "\nUNION ALL ".join(parts)


def _pct(part, whole, digits=2):
    return f"round({part} * 1e2 / {whole}, {digits})"


def _moments(c):
    return (f"count({c}) AS nn, avg({c}) AS mean, stddev_samp({c}) AS std, min({c})::DOUBLE AS min, "
            f"max({c})::DOUBLE AS max, quantile_cont({c}::DOUBLE, 0.25) AS q25, "
            f"quantile_cont({c}::DOUBLE, 0.5) AS median, quantile_cont({c}::DOUBLE, 0.75) AS q75")


def _r(*names, digits=4):
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


def _numeric_profile(cols, table, extra="", only=None):
    inner = _each(cols, table, lambda c: (
        f"count(*) AS n, count(DISTINCT {c}) AS d, {_moments(c)}, "
        f"CASE WHEN count({c}) < 3 THEN NULL WHEN stddev_samp({c}) = 0 THEN 0 ELSE skewness({c}) END AS skewness, "
        f"CASE WHEN count({c}) < 4 THEN NULL WHEN stddev_samp({c}) = 0 THEN 0 ELSE kurtosis({c}) END AS kurtosis"),
        only or _numbers(cols))
    return f"""SELECT {extra}column_name, position, dtype, n AS count, n - nn AS missing_count,
 {_pct('(n - nn)', 'n')} AS missing_percentage, d AS unique_count,
 {_r('mean', 'median', 'std', 'min', 'max', 'q25', 'q75', 'skewness', 'kurtosis')} FROM ({inner})"""


def _counts(cols, table):
    """(column_name, value, n) of the text columns."""
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in _texts(cols))


def _duplicates(cols, table):
    names = ", ".join(cols)
    return (f"SELECT sum(k)::BIGINT AS total, count(*) AS distinct_rows, (sum(k) - count(*))::BIGINT AS copies "
            f"FROM (SELECT {names}, count(*) AS k FROM {table} GROUP BY {names})")


def _gaps(cols):
    return "(" + " + ".join(f"({c} IS NULL)::INT" for c in cols) + ")"


# Quality issues: one statistics row per column, then every rule over those rows.

def _issue_stats(cols, table):
    parts = []
    for i, (c, t) in enumerate(cols.items()):
        x = f"{c}::DOUBLE" if t in NUMERIC else "NULL::DOUBLE"
        text = c if t == "string" else "NULL::VARCHAR"
        parts.append(f"""SELECT '{c}' AS column_name, {i} AS position, '{t}' AS dtype, n, nn, d, mean, std, q1, q3, least,
 (SELECT count(*) FROM {table} WHERE abs({x} - mean) / nullif(std, 0) > 3) AS z,
 (SELECT count(*) FROM {table} WHERE {x} < q1 - 1.5 * (q3 - q1) OR {x} > q3 + 1.5 * (q3 - q1)) AS fenced,
 loose, commas, dates
 FROM (SELECT count(*) AS n, count({c}) AS nn, count(DISTINCT {c}) AS d, avg({x}) AS mean, stddev_samp({x}) AS std,
  quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3, min({c})::VARCHAR AS least,
  count(*) FILTER (WHERE regexp_matches(replace(replace({text}, ',', ''), ' ', ''), '{NUMBER}')) AS loose,
  count(*) FILTER (WHERE regexp_matches(replace({text}, ',', ''), '{NUMBER}')) AS commas,
  count(*) FILTER (WHERE regexp_matches({text}, '[/-]') AND regexp_matches({text}, '[0-9]')) AS dates
  FROM {table})""")
    return "\nUNION ALL ".join(parts)


def _ladder(x, *rungs, otherwise):
    return "CASE " + " ".join(f"WHEN {x} >= {v} THEN '{s}'" for v, s in rungs) + f" ELSE '{otherwise}' END"


def _issues(cols, table):
    """CTEs stats, dups, empties and issues(detector, position, part, ...)."""
    numeric = "dtype IN ('bigint', 'int', 'double')"
    gap = "(n - nn) * 1e2 / n"
    copies = "(n - d - (CASE WHEN n > nn THEN 1 ELSE 0 END))"
    out = "greatest(CASE WHEN std > 0 THEN z ELSE 0 END, CASE WHEN q3 - q1 > 0 THEN fenced ELSE 0 END)"
    share = f"{out} * 1e2 / nn"
    severe = [(10, "high"), (5, "medium")]
    return [
        f"stats AS ({_issue_stats(cols, table)})",
        f"dups AS ({_duplicates(cols, table)})",
        f"empties AS (SELECT count(*) AS n, count(*) FILTER (WHERE {_gaps(cols)} > {len(cols)} * 0.5) AS k FROM {table})",
        f"""issues AS (
SELECT 1 AS detector, position, 0 AS part, 'missing_values' AS issue_type,
 {_ladder(gap, (50, 'critical'), (20, 'high'), (5, 'medium'), otherwise='low')} AS severity, column_name,
 n - nn AS affected_rows, round({gap}, 2) AS affected_percentage FROM stats WHERE n > nn
UNION ALL SELECT 2, 0, 0, 'missing_values', CASE WHEN k > n * 0.1 THEN 'high' ELSE 'medium' END, NULL, k,
 round(k * 1e2 / n, 2) FROM empties WHERE k > 0
UNION ALL SELECT 3, 0, 0, 'duplicates', {_ladder('copies * 1e2 / total', *severe, otherwise='low')}, NULL, copies,
 round(copies * 1e2 / total, 2) FROM dups WHERE copies > 0
UNION ALL SELECT 4, position, 0, 'duplicates', 'medium', column_name, {copies}, round({copies} * 1e2 / n, 2)
 FROM stats WHERE {copies} > 0 AND (lower(column_name) LIKE '%id%' OR lower(column_name) LIKE '%key%'
 OR lower(column_name) LIKE '%code%')
UNION ALL SELECT 5, position, 0, 'outliers', {_ladder(share, *severe, otherwise='low')}, column_name, {out},
 round({share}, 2) FROM stats WHERE {numeric} AND nn >= 10 AND {out} > 0
UNION ALL SELECT 6, position, 0, 'type_inconsistency', 'medium', column_name, nn, 1e2 FROM stats
 WHERE dtype = 'string' AND nn > 0 AND loose >= nn * 0.9
UNION ALL SELECT 6, position, 0, 'mixed_types', 'high', column_name, nn - loose, round((nn - loose) * 1e2 / nn, 2)
 FROM stats WHERE dtype = 'string' AND loose > 0 AND loose < nn * 0.9
UNION ALL SELECT 6, position, 1, 'type_inconsistency', 'low', column_name, nn, 1e2 FROM stats
 WHERE dtype = 'string' AND nn > 0 AND dates >= nn * 0.8
UNION ALL SELECT 7, position, 0, 'constant_column', 'medium', column_name, nn, 1e2 FROM stats WHERE d = 1
UNION ALL SELECT 7, position, 0, 'low_variance', 'info', column_name, nn, 1e2 FROM stats
 WHERE {numeric} AND d > 1 AND (std = 0 OR std / (abs(mean) + 1e-10) < 0.01)
UNION ALL SELECT 7, position, 1, 'high_cardinality', 'info', column_name, d, round(d * 1e2 / nn, 2) FROM stats
 WHERE dtype = 'string' AND d * 1.0 / nn > 0.9 AND d > 100)""",
    ]


_SEVERITY = "CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 ELSE 5 END"


def _bin(x, low, high, bins=30):
    return f"coalesce(least(floor(({x} - {low}) / nullif({high} - {low}, 0) * {bins}), {bins} - 1), 0)::INT"


def _box(table, c):
    return f"""SELECT '{c}' AS column_name, round(q25, 4) AS q25, round(median, 4) AS median, round(q75, 4) AS q75,
 round(min({c}) FILTER (WHERE {c} >= q25 - 1.5 * (q75 - q25)), 4)::DOUBLE AS whisker_low,
 round(max({c}) FILTER (WHERE {c} <= q75 + 1.5 * (q75 - q25)), 4)::DOUBLE AS whisker_high,
 count(*) FILTER (WHERE {c} < q25 - 1.5 * (q75 - q25) OR {c} > q75 + 1.5 * (q75 - q25)) AS outliers
 FROM {table}, (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q25, quantile_cont({c}::DOUBLE, 0.5) AS median,
  quantile_cont({c}::DOUBLE, 0.75) AS q75 FROM {table}) GROUP BY q25, median, q75"""


def _outlier_issues(table, cols, source):
    ctes = _issues(cols, source)
    return f"""SELECT '{table}' AS table_name, i.issue_type, i.severity, i.column_name, i.affected_rows,
 i.affected_percentage, s.z AS z_score_outliers, CASE WHEN q3 > q1 THEN s.fenced ELSE 0 END AS iqr_outliers,
 {_r('mean', 'std', 'q1', 'q3')}, round(q3 - q1, 4) AS iqr,
 CASE WHEN q3 > q1 THEN round(q1 - 1.5 * (q3 - q1), 4) END AS lower_bound,
 CASE WHEN q3 > q1 THEN round(q3 + 1.5 * (q3 - q1), 4) END AS upper_bound
 FROM ({_with(*ctes)} SELECT * FROM issues) i JOIN ({_with(*ctes)} SELECT * FROM stats) s USING (column_name)
 WHERE i.issue_type = 'outliers'"""


def _mode(c, table):
    return (f"(SELECT {c} FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)")


def oracle_queries() -> dict[str, str]:
    e, s = DIRTY_EVENTS, SPARSE_CUSTOMERS
    ed, cs = "events_dirty", "customer_sparse"
    dirty = f"WITH {e}\n"
    found = _with(e, *_issues(EVENTS_DIRTY, ed)) + "\n"
    dedup = f"WITH {e}, u AS (SELECT DISTINCT * FROM events_dirty)\n"
    total_missing = " + ".join(f"(count(*) - count({c}))" for c in EVENTS_DIRTY)
    bytes_of = " + ".join(
        f"sum(strlen({c}))" if t == "string" else f"count(*) * {WIDTH[t]}" for c, t in EVENTS_DIRTY.items())
    sparse_bytes = " + ".join(
        f"coalesce(sum(strlen({c})), 0)" if t == "string" else f"count(*) * {WIDTH[t]}" for c, t in SPARSE.items())
    sparse_missing = " + ".join(f"(count(*) - count({c}))" for c in SPARSE)
    numeric_text = " + ".join(
        f"(CASE WHEN count({c}) = count(*) FILTER (WHERE regexp_matches({c}, '{NUMBER}')) THEN 1 ELSE 0 END)"
        for c in _texts(EVENTS_DIRTY))
    with_gap = " + ".join(f"(CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END)" for c in EVENTS_DIRTY)
    q = {}

    # sources
    q["s_csv_null_tokens"] = """SELECT c_custkey,
 CASE WHEN c_custkey % 8 = 0 OR c_custkey % 9 = 0 OR c_custkey % 10 = 0 THEN NULL ELSE c_name END AS c_name,
 CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey::BIGINT END AS c_nationkey,
 CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE round(c_acctbal, 4) END AS c_acctbal, c_mktsegment FROM customer"""
    q["s_csv_many_files"] = """SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey,
 CASE WHEN s_suppkey % 2 = 1 THEN round(s_acctbal, 4) END AS s_acctbal FROM supplier"""
    q["s_preview"] = """SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey,
 c_acctbal::VARCHAR AS c_acctbal, c_mktsegment FROM customer ORDER BY customer.c_custkey LIMIT 1000"""

    # metadata
    q["m_dataset_summary"] = dirty + f""", d AS ({_duplicates(EVENTS_DIRTY, ed)}),
a AS (SELECT count(*) AS n, ({total_missing})::BIGINT AS missing_cells, ({bytes_of})::BIGINT AS bytes FROM {ed})
SELECT n AS row_count, 11 AS column_count, 5 AS numeric_column_count, missing_cells,
 round(missing_cells * 1e2 / (n * 11), 4) AS missing_percent, copies AS duplicate_rows, bytes,
 round(bytes / 1048576.0, 2) AS megabytes FROM a, d"""
    q["m_semantic_types"] = dirty + _semantic(EVENTS_DIRTY, ed)
    q["m_type_summary"] = dirty + (f"SELECT semantic_type, count(*) AS column_count "
                                   f"FROM ({_semantic(EVENTS_DIRTY, ed)}) GROUP BY semantic_type")
    q["m_numeric_stats"] = (
        f"SELECT column_name, nn AS count, {_r('mean', 'median', 'std', 'min', 'max', 'q25', 'q75')} FROM ("
        + _each(LINEITEM, "lineitem", _moments, _numbers(LINEITEM)) + ")")
    q["m_numeric_text_stats"] = dirty + f""", v AS (SELECT num_text::DOUBLE AS num_text, value FROM {ed})
SELECT column_name, nn AS count, {_r('mean', 'median', 'std', 'min', 'max', 'q25', 'q75')} FROM (""" + _each(
        {"num_text": "double", "value": "double"}, "v", _moments) + ")"
    lengths = "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS count, avg(length({c})) AS avg_length, max(length({c}))::INT AS max_length, "
        f"min(length({c}))::INT AS min_length FROM {ed}" for c in _texts(EVENTS_DIRTY))
    q["m_text_stats"] = dirty + f""", f AS ({_counts(EVENTS_DIRTY, ed)}),
m AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) = 1)
SELECT column_name, count, value AS most_frequent, n AS frequency, round(avg_length, 4) AS avg_length, max_length, min_length
 FROM ({lengths}) JOIN m USING (column_name) JOIN ({_semantic(EVENTS_DIRTY, ed)}) USING (column_name)
 WHERE semantic_type IN ('text', 'categorical')"""
    q["m_datetime_stats"] = dirty + f"""SELECT column_name, count, lo AS min_date, hi AS max_date,
 date_sub('day', lo, hi) AS range_days FROM (
 SELECT 'ts' AS column_name, count(ts) AS count, min(ts) AS lo, max(ts) AS hi FROM {ed} UNION ALL
 SELECT 'date_text', count(date_text), min(date_text::TIMESTAMP), max(date_text::TIMESTAMP) FROM {ed})"""

    # profile
    q["p_missing"] = _with(s) + f"""SELECT column_name, position, missing, round(missing * 1e2 / n, 4) AS missing_percent
 FROM ({_presence(SPARSE, cs)})"""
    q["p_completeness"] = _with(s) + f""" SELECT round(100 - ({sparse_missing}) * 1e2 / (count(*) * 6), 2) AS overall_completeness,
 ({" + ".join(f"(CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END)" for c in SPARSE)})::BIGINT AS columns_with_missing,
 count(*) FILTER (WHERE {_gaps(SPARSE)} > 0) AS rows_with_missing,
 ({" + ".join(f"(CASE WHEN count({c}) = 0 THEN 1 ELSE 0 END)" for c in SPARSE)})::BIGINT AS empty_columns,
 count(*) FILTER (WHERE {_gaps(SPARSE)} = 6) AS empty_rows FROM {cs}"""
    q["p_dtype_histogram"] = dirty + f"""SELECT dtype, count(*) AS column_count, sum(nn)::BIGINT AS filled_cells
 FROM ({_presence(EVENTS_DIRTY, ed)}) GROUP BY dtype"""
    q["p_uniqueness"] = dirty + f"""SELECT column_name, position, d AS unique_values,
 round(CASE WHEN nn > 0 THEN d * 1e0 / nn ELSE 0 END, 4) AS uniqueness_ratio, d = nn AS is_unique, d < nn AS has_duplicates
 FROM ({_presence(EVENTS_DIRTY, ed)})"""
    signs = _each(EVENTS_DIRTY, ed, lambda c: (
        f"count(*) FILTER (WHERE {c} = 0) AS zero_count, count(*) FILTER (WHERE {c} < 0) AS negative_count, "
        f"count(*) FILTER (WHERE {c} > 0) AS positive_count, count(*) FILTER (WHERE isinf({c}::DOUBLE)) AS infinite_count, "
        f"round((max({c}) - min({c}))::DOUBLE, 4) AS range"), _numbers(EVENTS_DIRTY))
    q["p_numeric_insights"] = dirty + f"SELECT * EXCLUDE (position, dtype) FROM ({signs})"
    q["p_categorical_insights"] = dirty + f""", f AS ({_counts(EVENTS_DIRTY, ed)}),
t AS (SELECT column_name, count(*) AS cardinality, sum(n) AS held FROM f GROUP BY column_name)
SELECT column_name, value AS most_frequent_value, n AS most_frequent_count, cardinality, round(n * 1e2 / held, 2) AS mode_frequency
 FROM f JOIN t USING (column_name) QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) = 1"""
    q["p_numeric_profile"] = _numeric_profile(LINEITEM, "lineitem")
    documents = {"doc_id": "bigint", **DOCUMENT_TEXTS}
    q["p_string_profile"] = f"""WITH f AS ({_counts(documents, 'documents')}),
m AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) = 1)
SELECT column_name, position, dtype, n1 AS count, missing AS missing_count, {_pct('missing', 'n1')} AS missing_percentage,
 d AS unique_count, lo AS min_length, hi AS max_length, mean_length, m.value AS mode FROM ({_each(
        documents, 'documents', lambda c: f"count(*) AS n1, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS d, "
        f"min(length({c}))::INT AS lo, max(length({c}))::INT AS hi, round(avg(length({c})), 2) AS mean_length",
        _texts(documents))}) JOIN m USING (column_name)"""
    q["p_top_values"] = f"""SELECT column_name, (row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value))::INT AS rank,
 value, n FROM ({_counts(documents, 'documents')}) QUALIFY rank <= 5"""
    summary = f""", d AS ({_duplicates(EVENTS_DIRTY, ed)}),
a AS (SELECT count(*) AS row_count, ({with_gap})::BIGINT AS columns_with_missing, ({total_missing})::BIGINT AS total_missing,
 count(*) * 11 AS total_cells, ({numeric_text})::BIGINT AS numeric_text_columns FROM {ed})"""
    q["p_quality_summary"] = dirty + summary + """
SELECT row_count, copies AS duplicate_rows, columns_with_missing, total_missing, total_cells::BIGINT AS total_cells,
 numeric_text_columns FROM a, d"""
    q["p_quality_score"] = dirty + summary + """, p AS (SELECT (1 - total_missing * 1e0 / total_cells) * 40 AS completeness,
 30 - least(copies * 1e0 / row_count * 30, 30) AS uniqueness, greatest(30 - numeric_text_columns * 5, 0)::DOUBLE AS consistency
 FROM a, d)
SELECT round(least(completeness + uniqueness + consistency, 100), 2) AS score, round(completeness, 2) AS completeness,
 round(uniqueness, 2) AS uniqueness, round(consistency, 2) AS consistency FROM p"""
    q["p_recommendations"] = dirty + f""", c AS ({_presence(EVENTS_DIRTY, ed)}), d AS ({_duplicates(EVENTS_DIRTY, ed)}),
t AS ({_each(EVENTS_DIRTY, ed, _parse, _texts(EVENTS_DIRTY))}),
g AS (SELECT count(*) AS k, list(column_name ORDER BY position) AS names FROM c WHERE missing > 0)
SELECT 1 AS step, 0 AS position, NULL AS column_name, 'Fill or drop missing values in ' || k || ' columns: '
 || array_to_string(names[1:3], ', ') || CASE WHEN k > 3 THEN '...' ELSE '' END AS advice FROM g WHERE k > 0
UNION ALL SELECT 2, 0, NULL, 'Drop ' || copies || ' duplicate rows' FROM d WHERE copies > 0
UNION ALL SELECT 3, position, column_name, 'Store this column as a number' FROM t WHERE num = nn
UNION ALL SELECT 4, position, column_name, 'Nearly every value differs: is this an identifier?' FROM t WHERE d * 1.0 / n > 0.9"""
    q["p_column_footprint"] = dirty + f""", a AS ({_each(EVENTS_DIRTY, ed, lambda c: (
        f"sum(strlen({c}))::BIGINT AS bytes" if EVENTS_DIRTY[c] == 'string'
        else f"(count(*) * {WIDTH[EVENTS_DIRTY[c]]})::BIGINT AS bytes"))})
SELECT column_name, position, bytes, (sum(bytes) OVER ())::BIGINT AS total_bytes, round(bytes / 1048576.0, 2) AS megabytes,
 row_number() OVER (ORDER BY bytes DESC, position) = 1 AS is_largest FROM a"""
    q["p_column_lookup"] = dirty + _numeric_profile(EVENTS_DIRTY, ed, only=["value"])
    basic = _each(ORDERS, "orders", lambda c: f"count(*) AS n, count(DISTINCT {c}) AS d, " + (
        _moments(c) if ORDERS[c] in NUMERIC else
        f"count({c}) AS nn, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS max, "
        "NULL::DOUBLE AS q25, NULL::DOUBLE AS median, NULL::DOUBLE AS q75"))
    q["p_basic_profile"] = f"""SELECT column_name, position, dtype, n AS count, n - nn AS missing_count,
 {_pct('(n - nn)', 'n')} AS missing_percentage, d AS unique_count, {_r('mean', 'median', 'std', 'min', 'max')} FROM ({basic})"""
    q["p_multi_table"] = "\nUNION ALL ".join(
        _numeric_profile(cols, t, f"'{t}' AS table_name, ")
        for t, cols in (("customer", CUSTOMER), ("supplier", SUPPLIER), ("part", PART), ("orders", ORDERS)))
    q["p_report_columns"] = "SELECT column_name, position, dtype, nn AS non_null, missing_percentage, d AS unique_count, sample_values FROM (" \
        + _each(ORDERS, "orders", lambda c: (
            f"count({c}) AS nn, {_pct(f'(count(*) - count({c}))', 'count(*)')} AS missing_percentage, count(DISTINCT {c}) AS d, "
            f"(SELECT string_agg(v, ', ' ORDER BY o_orderkey) FROM (SELECT o_orderkey, substring({c}::VARCHAR, 1, 20) AS v "
            f"FROM orders WHERE {c} IS NOT NULL ORDER BY o_orderkey LIMIT 3)) AS sample_values")) + ")"
    q["p_report_overview"] = _with(s) + f""", d AS ({_duplicates(SPARSE, cs)}),
a AS (SELECT count(*) AS n, ({sparse_missing})::BIGINT AS missing, ({sparse_bytes})::BIGINT AS bytes FROM {cs})
SELECT n AS row_count, 6 AS column_count, round(bytes / 1048576.0, 2) AS megabytes, round(missing * 1e2 / (n * 6), 4) AS missing_percent,
 copies AS duplicate_rows, 3 AS numeric_column_count FROM a, d"""

    # quality
    plain = "issue_type, severity, column_name, affected_rows, affected_percentage"
    gap = "missing * 1e2 / n"
    q["q_missing"] = dirty + f"""SELECT column_name, position, dtype,
 {_ladder(gap, (50, 'critical'), (20, 'high'), (5, 'medium'), otherwise='low')} AS severity, missing AS affected_rows,
 round({gap}, 2) AS affected_percentage, nn AS non_null_count FROM ({_presence(EVENTS_DIRTY, ed)}) WHERE missing > 0"""
    q["q_sparse_rows"] = _with(s, *_issues(SPARSE, cs)) + f""" SELECT {plain}, affected_rows AS rows_affected
 FROM issues WHERE detector = 2"""
    q["q_duplicate_rows"] = found + f"""SELECT {plain}, copies AS duplicate_count, distinct_rows AS unique_rows
 FROM issues, dups WHERE detector = 3"""
    q["q_duplicate_samples"] = dirty + f"""SELECT event_id FROM (SELECT event_id, row_number() OVER (
 PARTITION BY {", ".join(EVENTS_DIRTY)} ORDER BY event_id) AS copy FROM {ed}) WHERE copy > 1 ORDER BY event_id, copy LIMIT 10"""
    q["q_id_duplicates"] = _with(*_issues(LINEITEM, "lineitem")) + f" SELECT {plain} FROM issues WHERE issue_type = 'duplicates'"
    q["q_id_duplicate_samples"] = """SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, o_custkey, row_number() OVER (
 PARTITION BY o_custkey ORDER BY o_orderkey) AS copy FROM orders) WHERE copy > 1 ORDER BY o_orderkey LIMIT 10"""
    q["q_outliers"] = "\nUNION ALL ".join([
        _outlier_issues("events", EVENTS, "events"),
        _outlier_issues("documents", {"n_chars": "bigint"}, "documents"),
        _outlier_issues("labels", LABELS, "labels")])
    q["q_outlier_samples"] = "\nUNION ALL ".join(
        f"""SELECT '{c}' AS column_name, rank::INT AS rank, round({c}::DOUBLE, 4) AS value FROM (
 SELECT {c}, row_number() OVER (ORDER BY event_id) AS rank FROM events, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM events)
 WHERE abs({c} - m) / s > 3) WHERE rank <= 10""" for c in ("event_id", "user_id", "value"))
    q["q_type_issues"] = found + f"""SELECT {plain},
 CASE WHEN issue_type = 'mixed_types' THEN round(loose * 1e2 / nn, 2) END AS numeric_values_pct,
 CASE WHEN issue_type = 'mixed_types' THEN round((nn - loose) * 1e2 / nn, 2) END AS text_values_pct
 FROM issues JOIN stats USING (column_name) WHERE detector = 6"""
    q["q_sampled_types"] = dirty + "\nUNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) AS checked,
 count(*) FILTER (WHERE regexp_matches(replace(replace({c}, ',', ''), ' ', ''), '{NUMBER}')) AS numeric_loose
 FROM {ed} WHERE {c} IS NOT NULL""" for c in _texts(EVENTS_DIRTY))
    q["q_constant"] = found + f"SELECT {plain}, least AS constant_value FROM issues JOIN stats USING (column_name) WHERE issue_type = 'constant_column'"
    q["q_low_variance"] = found + f"""SELECT {plain}, {_r('mean', 'std')}, d AS unique_count FROM issues JOIN stats USING (column_name)
 WHERE issue_type = 'low_variance'"""
    q["q_high_cardinality"] = _with(*_issues(DOCUMENT_TEXTS, "documents")) + f""" SELECT {plain}, d AS unique_count,
 round(d * 1e0 / nn, 4) AS cardinality_ratio FROM issues JOIN stats USING (column_name) WHERE issue_type = 'high_cardinality'"""
    q["q_scores"] = found + f""", p AS (SELECT (1 - (SELECT sum(n - nn) FROM stats) * 1e0 / (SELECT sum(n) FROM stats)) * 100 AS completeness,
 distinct_rows * 1e2 / total AS uniqueness,
 greatest(0, 100 - 10 * (SELECT count(*) FROM issues WHERE detector = 6))::DOUBLE AS consistency,
 greatest(0, 100 - coalesce((SELECT sum(affected_percentage) FROM issues WHERE detector = 5), 0))::DOUBLE AS validity FROM dups)
SELECT round(completeness * 0.35 + uniqueness * 0.25 + consistency * 0.25 + validity * 0.15, 2) AS overall,
 {_r('completeness', 'uniqueness', 'consistency', 'validity', digits=2)} FROM p"""
    q["q_all_issues"] = found + f""", k AS (SELECT *, row_number() OVER (ORDER BY detector, position, part) AS number FROM issues)
SELECT 'QI-' || lpad(number::VARCHAR, 4, '0') AS issue_id, (row_number() OVER (ORDER BY {_SEVERITY}, number))::INT AS display_order,
 {plain} FROM k"""
    q["q_issue_summary"] = found + "SELECT count(*) AS total_issues, " + ", ".join(
        f"count(*) FILTER (WHERE severity = '{x}') AS {x}" for x in ("critical", "high", "medium", "low", "info")) + " FROM issues"
    q["q_prioritized"] = found + f""", a(issue_type, step, action) AS (VALUES ('missing_values', 1, 'Handle Missing Values'),
 ('duplicates', 2, 'Remove Duplicate Records'), ('type_inconsistency', 3, 'Fix Data Type Issues'),
 ('mixed_types', 4, 'Standardize Mixed Type Columns'), ('outliers', 5, 'Address Outliers'),
 ('constant_column', 6, 'Remove Constant Columns'), ('high_cardinality', 7, 'Review High Cardinality Columns'),
 ('low_variance', 8, 'Consider Low Variance Features')),
g AS (SELECT issue_type, count(*) AS issue_count, min({_SEVERITY}) AS top,
 coalesce(array_to_string((list(column_name ORDER BY {_SEVERITY}, detector, position, part) FILTER (WHERE column_name IS NOT NULL)), '|'), '')
 AS columns_affected FROM issues GROUP BY issue_type)
SELECT (row_number() OVER (ORDER BY step))::INT AS priority, action, issue_type, issue_count, columns_affected,
 issue_count::INT AS specific_recommendations, CASE top WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' WHEN 4 THEN 'low' ELSE 'info' END AS highest_severity
 FROM g JOIN a USING (issue_type)"""
    q["q_column_quality"] = found + f""", k AS (SELECT *, nn * 1e2 / n AS filled,
 CASE WHEN dtype = 'string' AND commas > 0 AND commas < nn THEN 60e0 ELSE 100e0 END AS type_quality FROM stats)
SELECT column_name, position, round(filled * 0.6 + type_quality * 0.4, 2) AS quality_score, round(filled, 2) AS completeness,
 type_quality, n - nn AS missing_count, {_pct('(n - nn)', 'n')} AS missing_percentage, d AS unique_count, dtype FROM k"""

    # transformations, with all columns of their tables
    low = "round(low_var, 4) AS low_var"
    price = "round(o_totalprice, 4) AS o_totalprice"
    q["t_impute_mean"] = dirty + f"""SELECT * REPLACE (round(coalesce(value, (SELECT avg(value) FROM {ed})), 4) AS value, {low}) FROM {ed}"""
    q["t_impute_median"] = dirty + f"""SELECT * REPLACE (round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM {ed})), 4) AS value, {low},
 round(coalesce(sparse_user::DOUBLE, (SELECT quantile_cont(sparse_user::DOUBLE, 0.5) FROM {ed})), 4) AS sparse_user) FROM {ed}"""
    q["t_impute_mode"] = dirty + f"""SELECT * REPLACE (coalesce(event_type, {_mode('event_type', ed)}) AS event_type, {low},
 round(coalesce(value, {_mode('value', ed)}), 4) AS value) FROM {ed}"""
    q["t_impute_constant"] = dirty + f"""SELECT * REPLACE (coalesce(event_type, 'Unknown') AS event_type, round(value, 4) AS value, {low}) FROM {ed}"""
    for name, f, frame in (("t_ffill", "last_value", "UNBOUNDED PRECEDING AND CURRENT ROW"),
                           ("t_bfill", "first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING")):
        over = f"OVER (ORDER BY event_id ROWS BETWEEN {frame})"
        q[name] = dedup + f"""SELECT * REPLACE (round({f}(value IGNORE NULLS) {over}, 4) AS value, {low},
 {f}(event_type IGNORE NULLS) {over} AS event_type) FROM u"""
    q["t_remove_z"] = """WITH a AS (SELECT * FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)
 WHERE NOT coalesce(abs(value - m) / s > 3, false)),
c AS (SELECT * FROM a, (SELECT avg(user_id) AS m2, stddev_samp(user_id) AS s2 FROM a)
 WHERE NOT coalesce(abs(user_id - m2) / s2 > 3, false))
SELECT * EXCLUDE (m, s, m2, s2) REPLACE (round(value, 4) AS value) FROM c"""

    def fences(table, c):
        return (f"(SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, "
                f"quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {table}))")

    q["t_remove_iqr"] = f"""SELECT * EXCLUDE (lo, hi) REPLACE (round(value, 4) AS value) FROM events, {fences('events', 'value')}
 WHERE value IS NULL OR (value >= lo AND value <= hi)"""
    q["t_remove_iqr_documents"] = f"""SELECT * EXCLUDE (lo, hi) FROM documents, {fences('documents', 'n_chars')}
 WHERE n_chars IS NULL OR (n_chars >= lo AND n_chars <= hi)"""
    clip = "round(CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END, 4) AS value"
    q["t_cap_z"] = f"""SELECT * EXCLUDE (lo, hi) REPLACE ({clip}) FROM events, (SELECT avg(value) - 3 * stddev_samp(value) AS lo,
 avg(value) + 3 * stddev_samp(value) AS hi FROM events)"""
    q["t_cap_iqr"] = f"SELECT * EXCLUDE (lo, hi) REPLACE ({clip}) FROM events, {fences('events', 'value')}"
    q["t_onehot"] = dirty + f"SELECT * EXCLUDE (event_type) REPLACE (round(value, 4) AS value, {low}), " + ", ".join(
        f"coalesce(event_type = '{v}', false) AS event_type_{v}" for v in ("error", "purchase", "signup", "view")) + f" FROM {ed}"
    codes = "(SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS code FROM (SELECT DISTINCT {c} FROM {t} WHERE {c} IS NOT NULL))"
    q["t_label"] = dirty + f"""SELECT {ed}.* REPLACE (coalesce(a.code, -1) AS event_type, coalesce(m.code, -1) AS mixed, round(value, 4) AS value, {low}) FROM {ed}
 LEFT JOIN {codes.format(c='event_type', t=ed)} a ON event_type = a.v LEFT JOIN {codes.format(c='mixed', t=ed)} m ON mixed = m.v"""
    q["t_freq_encode"] = dirty + f"""SELECT {ed}.* REPLACE (round(value, 4) AS value, {low}), round(share, 4) AS event_type_encoded FROM {ed} LEFT JOIN (
 SELECT event_type AS v, count(*) * 1e0 / sum(count(*)) OVER () AS share FROM {ed} WHERE event_type IS NOT NULL GROUP BY 1)
 ON event_type = v"""
    number = "CASE WHEN regexp_matches({c}, '" + NUMBER + "') THEN try_cast(trim({c}) AS {t}) END"
    q["t_convert_int"] = dirty + f"""SELECT * REPLACE ({number.format(c='num_text', t='BIGINT')} AS num_text, round(value, 4) AS value, {low},
 {number.format(c='mixed', t='BIGINT')} AS mixed) FROM {ed}"""
    q["t_convert_float"] = dirty + f"""SELECT * REPLACE (round({number.format(c='mixed', t='DOUBLE')}, 4) AS mixed, round(value, 4) AS value, {low}) FROM {ed}"""
    q["t_convert_str"] = dirty + f"""SELECT * REPLACE (sparse_user::VARCHAR AS sparse_user, round(value, 4) AS value, {low}) FROM {ed}"""
    q["t_convert_datetime"] = dirty + f"SELECT * REPLACE (round(value, 4) AS value, {low}, " + ", ".join(
        f"CASE WHEN regexp_matches({c}, '{DATE}') THEN try_cast({c} AS TIMESTAMP) END AS {c}" for c in ("date_text", "mixed")) + f") FROM {ed}"
    q["t_drop_column"] = "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice, o_orderpriority FROM orders"
    q["t_drop_rows"] = dirty + f"""SELECT * REPLACE (round(value, 4) AS value, {low}) FROM {ed}
 WHERE value IS NOT NULL AND event_type IS NOT NULL"""
    q["t_filter_rows"] = f"""SELECT * REPLACE ({price}) FROM orders
 WHERE o_orderstatus = 'F' AND o_totalprice > 100000"""
    q["t_dedup"] = dedup + "SELECT * REPLACE (round(value, 4) AS value, round(low_var, 4) AS low_var) FROM u"
    q["t_rename"] = f"SELECT * EXCLUDE (o_orderpriority) REPLACE ({price}), o_orderpriority AS priority FROM orders"
    scaled = ("l_quantity", "l_extendedprice")
    others = "round(l_discount, 4) AS l_discount, round(l_tax, 4) AS l_tax, "
    q["t_scale_standard"] = f"SELECT * REPLACE ({others}" + ", ".join(
        f"round(({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_samp({c}) FROM lineitem), 4) AS {c}" for c in scaled) + ") FROM lineitem"
    q["t_scale_minmax"] = f"SELECT * REPLACE ({others}" + ", ".join(
        f"round(({c} - (SELECT min({c}) FROM lineitem)) / (SELECT max({c}) - min({c}) FROM lineitem), 4) AS {c}" for c in scaled) + ") FROM lineitem"
    filled = f"(SELECT coalesce(value, (SELECT quantile_cont(value, 0.5) FROM {ed})) AS value FROM {ed})"
    q["t_before_after"] = dirty + "\nUNION ALL ".join(
        f"""SELECT '{phase}' AS phase, 'value' AS column_name, count(*) AS count, count(*) - count(value) AS missing,
 count(DISTINCT value) AS unique, {_r('mean', 'std', 'min', 'max', 'median')} FROM (SELECT value, avg(value) OVER () AS mean,
 stddev_samp(value) OVER () AS std, min(value) OVER () AS min, max(value) OVER () AS max,
 (SELECT quantile_cont(value, 0.5) FROM {source}) AS median FROM {source}) GROUP BY mean, std, min, max, median"""
        for phase, source in (("before", ed), ("after", filled)))
    q["t_preview"] = dirty + f"""SELECT * REPLACE (round(coalesce(value, (SELECT avg(value) FROM {ed})), 4) AS value, {low})
 FROM {ed} ORDER BY event_id LIMIT 10"""

    # recommendations
    numeric = "dtype IN ('bigint', 'int', 'double')"
    advice = [
        "skews AS (" + _each(EVENTS_DIRTY, ed, lambda c: f"skewness({c}) AS skew", _numbers(EVENTS_DIRTY)) + ")",
        f"nums AS ({_each(EVENTS_DIRTY, ed, lambda c: f'count(*) AS total, count(*) FILTER (WHERE regexp_matches({c}, {chr(39)}{NUMBER}{chr(39)})) AS num', _texts(EVENTS_DIRTY))})",
        """recs AS (SELECT 1 AS grp, st.position, st.column_name, 'imputation' AS rec_type,
 CASE WHEN (n - nn) * 1e2 / n > 50 THEN 'critical' WHEN (n - nn) * 1e2 / n > 20 THEN 'high' WHEN (n - nn) * 1e2 / n > 5 THEN 'medium' ELSE 'low' END AS priority,
 'Use ' || CASE WHEN """ + numeric.replace("dtype", "st.dtype") + """ THEN (CASE WHEN nn > 2 AND abs(skew) > 1 THEN 'median' ELSE 'mean' END) ELSE 'mode' END || ' imputation' AS suggested_action,
 n - nn AS affected_rows, (n - nn) * 1e2 / n AS affected_percentage FROM stats st LEFT JOIN skews sk USING (column_name) WHERE n > nn
UNION ALL SELECT 2, position, column_name, 'outlier_treatment',
 CASE WHEN fenced * 1e2 / nn > 10 THEN 'high' WHEN fenced * 1e2 / nn > 5 THEN 'medium' ELSE 'low' END, 'Cap outliers by IQR', fenced,
 fenced * 1e2 / nn FROM stats WHERE """ + numeric + """ AND nn >= 10 AND fenced > 0
UNION ALL SELECT 3, position, column_name, 'encoding', CASE WHEN d > 50 THEN 'medium' ELSE 'low' END,
 CASE WHEN d > 50 THEN 'Use target encoding' ELSE 'Use one-hot encoding' END, n, 1e2 FROM stats WHERE dtype = 'string'
UNION ALL SELECT 4, 0, NULL, 'scaling', 'medium', 'Use standard scaling', rows, 1e2 FROM (
 SELECT (SELECT max(n) FROM stats) AS rows, max(r) / CASE WHEN min(r) > 0 THEN min(r) ELSE 1 END AS ratio FROM (""" + "\nUNION ALL ".join(
            f"SELECT (max({c}) - min({c}))::DOUBLE AS r FROM {ed}" for c in _numbers(EVENTS_DIRTY)) + """)) WHERE ratio > 10
UNION ALL SELECT 5, 0, NULL, 'duplicate_handling', CASE WHEN copies * 1e2 / total > 5 THEN 'high' ELSE 'medium' END,
 'Remove duplicate rows', copies, copies * 1e2 / total FROM dups WHERE copies > 0
UNION ALL SELECT 6, position, column_name, 'type_conversion', 'medium', 'Convert to numeric', total, 1e2 FROM nums
 WHERE num * 1e2 / total > 90)""",
    ]
    recs = _with(e, *_issues(EVENTS_DIRTY, ed), *advice) + "\n"
    q["r_missing"] = recs + """SELECT column_name, priority, suggested_action, affected_rows,
 round(affected_percentage, 4) AS affected_percentage FROM recs WHERE grp = 1"""
    q["r_outliers"] = "\nUNION ALL ".join(
        f"""SELECT column_name, CASE WHEN p > 10 THEN 'high' WHEN p > 5 THEN 'medium' ELSE 'low' END AS priority,
 k AS affected_rows, round(p, 4) AS affected_percentage FROM (SELECT '{c}' AS column_name,
 count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS k, count(*) FILTER (WHERE {c} < lo OR {c} > hi) * 1e2 / count({c}) AS p
 FROM {t}, {fences(t, c)}) WHERE k > 0""" for t, c in (("events", "value"), ("documents", "n_chars")))
    q["r_encoding"] = recs + "SELECT column_name, priority, suggested_action, affected_rows FROM recs WHERE grp = 3"
    q["r_scaling"] = """SELECT 'scaling' AS rec_type, 'medium' AS priority, n AS affected_rows,
 'The widest range is ' || round(hi / CASE WHEN lo > 0 THEN lo ELSE 1 END)::BIGINT || ' times the narrowest' AS why FROM (
 SELECT (SELECT count(*) FROM lineitem) AS n, max(r) AS hi, min(r) AS lo FROM (""" + "\nUNION ALL ".join(
        f"SELECT (max({c}) - min({c}))::DOUBLE AS r FROM lineitem" for c in _numbers(LINEITEM)) + \
        ")) WHERE hi / CASE WHEN lo > 0 THEN lo ELSE 1 END > 10"
    q["r_duplicates"] = recs + "SELECT priority, affected_rows, round(affected_percentage, 4) AS affected_percentage FROM recs WHERE grp = 5"
    q["r_type_conversion"] = recs + "SELECT column_name, priority, affected_rows FROM recs WHERE grp = 6"
    by_priority = _SEVERITY.replace("severity", "priority")
    q["r_all"] = recs + f""", k AS (SELECT *, row_number() OVER (ORDER BY grp, position) AS number FROM recs)
SELECT 'rec_' || number AS rec_id, (row_number() OVER (ORDER BY {by_priority}, number))::INT AS display_order, column_name,
 rec_type, priority, affected_rows FROM k"""
    q["r_summary"] = recs + "SELECT priority, count(*) AS recommendations FROM recs GROUP BY priority"

    # charts
    ends = "(SELECT min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem)"
    q["v_histogram"] = f"""WITH e AS {ends}, c AS (SELECT {_bin('l_extendedprice', 'low', 'high')} AS bin, count(*) AS n
 FROM lineitem, e GROUP BY 1)
SELECT g.bin::INT AS bin, round(low + g.bin * (high - low) / 30, 4) AS bin_start, round(low + (g.bin + 1) * (high - low) / 30, 4) AS bin_end,
 coalesce(c.n, 0) AS n FROM range(30) g(bin), e LEFT JOIN c ON c.bin = g.bin"""
    q["v_box"] = _box("events", "value") + "\nUNION ALL " + _box("documents", "n_chars")
    q["v_bar"] = """SELECT (row_number() OVER (ORDER BY n DESC, label))::INT AS rank, label, n FROM (
 SELECT source AS label, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source) QUALIFY rank <= 20"""
    names = _numbers(LINEITEM)
    q["v_correlation"] = "\nUNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{c}' AS column_b, round(corr({a}, {c}), 4) AS r FROM lineitem" for a in names for c in names)
    pairs = [(a, c) for a in _numbers(EVENTS_DIRTY) for c in _numbers(EVENTS_DIRTY)]
    q["v_rank_correlation"] = dirty + "\nUNION ALL ".join(
        f"""SELECT '{a}' AS column_a, '{c}' AS column_b, round(corr(x, y), 4) AS r FROM (
 SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS x,
 rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS y
 FROM {ed} WHERE {a} IS NOT NULL AND {c} IS NOT NULL)""" for a, c in pairs)
    q["v_missing_matrix"] = dedup + """, m AS (SELECT * FROM u ORDER BY md5('42|' || event_id), event_id LIMIT 100),
l AS (""" + "\nUNION ALL ".join(
        f"SELECT event_id, '{c}' AS column_name, ({c} IS NULL)::INT AS is_missing FROM m" for c in EVENTS_DIRTY) + """)
SELECT * FROM l QUALIFY max(is_missing) OVER (PARTITION BY column_name) = 1"""
    q["v_missing_patterns"] = dirty + "SELECT " + " || ".join(
        f"({c} IS NULL)::INT::VARCHAR" for c in EVENTS_DIRTY) + f" AS pattern, count(*) AS n FROM {ed} GROUP BY 1"
    q["v_scatter_grid"] = f"""SELECT {_bin('l_quantity', 'xl', 'xh')} AS x_bin, {_bin('l_extendedprice', 'yl', 'yh')} AS y_bin,
 l_returnflag AS color, count(*) AS n FROM lineitem, (SELECT min(l_quantity) AS xl, max(l_quantity) AS xh,
 min(l_extendedprice) AS yl, max(l_extendedprice) AS yh FROM lineitem) GROUP BY ALL"""
    q["v_violin"] = f"""WITH b AS (SELECT event_type AS "group", {_bin('value', 'low', 'high')} AS bin, count(*) AS n
 FROM events, (SELECT min(value) AS low, max(value) AS high FROM events) GROUP BY ALL),
k AS (SELECT event_type AS "group", round(quantile_cont(value, 0.25), 4) AS q25, round(quantile_cont(value, 0.5), 4) AS median,
 round(quantile_cont(value, 0.75), 4) AS q75 FROM events GROUP BY ALL)
SELECT "group", bin, n, round(n * 1e0 / sum(n) OVER (PARTITION BY "group"), 4) AS density, q25, median, q75 FROM b JOIN k USING ("group")"""
    q["v_chart_plan"] = dirty + f""", c AS ({_presence(EVENTS_DIRTY, ed)}),
p AS (SELECT 0 AS block, position, 0 AS part, 'histogram' AS chart_type, column_name FROM c WHERE {numeric} AND nn > 0
UNION ALL SELECT 0, position, 1, 'box_plot', column_name FROM c WHERE {numeric} AND nn > 0
UNION ALL SELECT 1, position, 0, 'bar_chart', column_name FROM c WHERE dtype = 'string' AND d > 1 AND d <= 20
UNION ALL SELECT 2, 0, 0, 'correlation_matrix', NULL FROM c HAVING count(*) FILTER (WHERE {numeric}) >= 2
UNION ALL SELECT 3, 0, 0, 'missing_value_heatmap', NULL FROM c HAVING sum(missing) > 0)
SELECT 'chart-' || lpad((row_number() OVER (ORDER BY block, position, part))::VARCHAR, 4, '0') AS chart_id, chart_type, column_name FROM p"""

    # lifecycle and catalog
    q3 = dedup + """, m AS (SELECT * REPLACE (coalesce(value, (SELECT quantile_cont(value, 0.5) FROM u)) AS value) FROM u),
f AS """ + fences("m", "value") + """,
c AS (SELECT m.* REPLACE (CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END AS value) FROM m, f),
k AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT event_type AS v FROM c WHERE event_type IS NOT NULL))
"""
    q["l_replay_report"] = dedup + """SELECT 1 AS step, 'remove_duplicates' AS transformation, true AS success, count(*) AS rows_after FROM u
UNION ALL SELECT 2, 'impute_constant', false, NULL UNION ALL SELECT 3, 'filter_rows', false, NULL
UNION ALL SELECT 4, 'filter_rows', true, count(*) FROM u WHERE value > 20"""
    q["l_undo"] = q3 + "SELECT event_id, event_type, round(value, 4) AS value, mixed FROM c"
    q["l_pipeline_replay"] = q3 + """SELECT event_id, coalesce(code, -1) AS event_type, round(value, 4) AS value, mixed
 FROM c LEFT JOIN k ON event_type = v"""
    q["l_history"] = q3 + """SELECT s AS sequence_order, t AS transformation_type, cols AS columns, a::BIGINT AS affected_rows, n AS rows_after FROM (
SELECT 1 AS s, 'remove_duplicates' AS t, '' AS cols, (SELECT count(*) FROM events_dirty) - count(*) AS a, count(*) AS n FROM u
UNION ALL SELECT 2, 'impute_median', 'value', count(*) - count(value), count(*) FROM u
UNION ALL SELECT 3, 'cap_outliers_iqr', 'value', count(*) FILTER (WHERE value < lo OR value > hi), count(*) FROM m, f
UNION ALL SELECT 4, 'encode_label', 'event_type', count(*), count(*) FROM c)"""
    stored = """WITH r AS (SELECT p_brand AS dataset_id, (p_size % 3)::BIGINT AS dataset_version, p_type AS analysis_type,
 p_partkey::VARCHAR AS results, TIMESTAMP '2024-01-01' + to_minutes((p_partkey % 1500)::INT) AS created_at,
 CASE WHEN p_partkey % 7 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes((p_partkey % 1500)::INT) + INTERVAL 24 HOUR END AS expires_at
 FROM part)
"""
    q["l_cache_valid"] = stored + """, v AS (SELECT * FROM r WHERE expires_at IS NULL OR expires_at >= TIMESTAMP '2024-01-02 08:00:00')
SELECT * FROM v QUALIFY created_at = max(created_at) OVER (PARTITION BY dataset_id, dataset_version, analysis_type)"""
    q["l_cache_summary"] = stored + """SELECT dataset_id, analysis_type, dataset_version, max(created_at) AS created_at,
 max(expires_at) AS expires_at FROM r GROUP BY ALL"""
    rows = """WITH c AS (SELECT p_partkey AS pipeline_id, p_name AS pipeline_name, p_type AS description, p_brand AS category,
 p_partkey % 3 = 0 AS is_public, p_size AS usage_count FROM part)
"""
    q["c_browse"] = rows + """SELECT *, (SELECT count(*) FROM c WHERE category = 'Brand#2') AS total FROM c
 WHERE category = 'Brand#2' ORDER BY usage_count DESC, pipeline_id LIMIT 20 OFFSET 20"""
    q["c_search"] = rows + "SELECT * FROM c WHERE is_public AND (pipeline_name ILIKE '%ring%' OR description ILIKE '%ring%')"
    q["q_assessed_issues"], q["q_assessed_scores"], q["r_assessed"] = q["q_all_issues"], q["q_scores"], q["r_all"]
    q["l_step_log"] = q["l_history"]
    q["s_csv_many_charsets"] = """SELECT c_custkey, 'é' || c_name AS c_name, c_nationkey::BIGINT AS c_nationkey,
 round(c_acctbal, 4) AS c_acctbal, c_mktsegment FROM customer"""
    q["l_fingerprint"] = """SELECT kind, count(*) + (kind = 'repeated')::BIGINT AS row_count, kind = 'same' AS "equal"
 FROM documents, (VALUES ('same'), ('repeated'), ('changed')) k(kind) GROUP BY kind"""
    q["m_distinct_sketch"] = dirty + "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count, true AS near FROM {ed}" for c in EVENTS_DIRTY)
    q["m_merged_slices"] = "\nUNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) AS row_count, count({c}) AS non_null, {_r('mean', 'std', 'min', 'max', 'skewness')} FROM (
 SELECT {c}, avg({c}) OVER () AS mean, stddev_samp({c}) OVER () AS std, min({c}::DOUBLE) OVER () AS min, max({c}::DOUBLE) OVER () AS max,
 skewness({c}) OVER () AS skewness FROM orders) GROUP BY mean, std, min, max, skewness"""
        for c in ("o_orderkey", "o_custkey", "o_totalprice"))
    return q
