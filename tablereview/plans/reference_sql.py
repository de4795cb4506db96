"""The same results in plain SQL, for checking the registered queries."""

from __future__ import annotations

# Thresholds and report texts, stated here apart from the operators they check.
ADVICE = {
    "missing_values": (
        "Investigate an appropriate missing-value handling strategy (e.g. imputation, row removal, or "
        "model-based approaches) before proceeding with modeling."
    ),
    "duplicate_rows": (
        "Investigate whether these duplicates represent legitimate repeated observations or should be "
        "removed before modeling."
    ),
    "high_cardinality": (
        "This column may be an identifier or too high-cardinality for direct modeling. Review its role "
        "before feature engineering (e.g. consider grouping rare values, target encoding, or dropping it)."
    ),
    "constant_column": (
        "This column provides little or no predictive information and should be reviewed for removal "
        "before modeling (unless it is a deliberately constant flag or control column)."
    ),
}
IMBALANCE_MEANING = (
    "One target class represents a disproportionate share of the observations, which may indicate "
    "class imbalance."
)
IMBALANCE_IMPLICATION = (
    "Accuracy alone may be misleading for this target. Consider class-sensitive evaluation metrics and "
    "imbalance handling strategies (e.g. class weighting, resampling, or threshold tuning) during modeling."
)
DOMINANT_MEANING = (
    "' is heavily concentrated in a single category, which may indicate limited variation or a nearly "
    "constant column."
)
DOMINANT_IMPLICATION = (
    "' may contain limited variation. Evaluate its predictive usefulness before including it in models "
    "(e.g. consider grouping rare categories or dropping it if it does not provide meaningful signal)."
)

# Columns of the tables: name, type label.
LINEITEM = [
    ("l_orderkey", "int64"), ("l_partkey", "int64"), ("l_suppkey", "int64"),
    ("l_linenumber", "int64"), ("l_quantity", "float64"), ("l_extendedprice", "float64"),
    ("l_discount", "float64"), ("l_tax", "float64"), ("l_returnflag", "str"),
    ("l_linestatus", "str"), ("l_shipdate", "timestamp_ntz"),
]
DOCUMENTS = [
    ("doc_id", "int64"), ("text", "str"), ("lang", "str"), ("source", "str"), ("n_chars", "int64"),
]
DOCS_LABELS = [*DOCUMENTS, ("quality", "int64"), ("toxic", "int64")]
CUSTOMER = [
    ("c_custkey", "int64"), ("c_name", "str"), ("c_nationkey", "int64"), ("c_acctbal", "float64"),
    ("c_mktsegment", "str"),
]
CUSTOMER_CONST = [*CUSTOMER, ("k", "str")]
ORDERS = [
    ("o_orderkey", "int64"), ("o_custkey", "int64"), ("o_orderstatus", "str"),
    ("o_totalprice", "float64"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "str"),
]
ORDERS_GAPS = [
    ("o_orderkey", "int64"), ("o_custkey", "int64"), ("o_orderstatus", "str"),
    ("o_totalprice", "float64"), ("o_orderpriority", "str"),
]
PAGES = [("page_id", "int64"), ("url", "str"), ("html", "str")]
EVENTS = [
    ("event_id", "int64"), ("ts", "timestamp_ntz"), ("user_id", "int64"), ("event_type", "str"),
    ("value", "float64"), ("props", "str"),
]
EMBEDDINGS = [("vec_id", "int64"), ("embedding", "array<float>"), ("label", "int64")]
SHARES = [("even", "str"), ("two_thirds", "str"), ("most", "str"), ("nine_tenths", "str"), ("nearly_all", "str")]
REPEATS = [("few", "int64"), ("several", "int64"), ("many", "int64")]
LABEL_TEXTS = [("doc_id", "int64"), ("quality", "str"), ("toxic", "str")]

SEPARABLE = [*DOCS_LABELS, ("judged", "str")]

# Derived tables.
SOURCES = {
    "labelled_docs": (
        "SELECT doc_id, text, lang, source, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)"
    ),
    "separable_docs": (
        "SELECT doc_id, text, lang, source, n_chars, quality, toxic, 'class ' || quality AS judged "
        "FROM documents JOIN labels USING (doc_id)"
    ),
    "docs_labels": "SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)",
    "line_flags": "SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem",
    "flag_sets": "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem",
    "orders_gaps": (
        "SELECT o_orderkey, o_custkey, o_orderstatus, "
        "CASE WHEN o_totalprice >= 5000 THEN o_totalprice END AS o_totalprice, "
        "nullif(o_orderpriority, '5-LOW') AS o_orderpriority FROM orders"
    ),
    "customer_const": "SELECT *, 'x' AS k FROM customer",
    "label_texts": "SELECT doc_id, quality::VARCHAR AS quality, toxic::VARCHAR AS toxic FROM labels",
    "order_shares": (
        "SELECT "
        + ", ".join(
            f"CASE WHEN o_orderkey % 100 < {k} THEN 'a' ELSE 'b' END AS {c}"
            for c, k in (("even", 50), ("two_thirds", 66), ("most", 85), ("nine_tenths", 93), ("nearly_all", 97))
        )
        + " FROM orders"
    ),
    "order_repeats": (
        "SELECT "
        + ", ".join(
            f"CASE WHEN o_orderkey % 100 < {k} THEN -1 ELSE o_orderkey END AS {c}"
            for c, k in (("few", 1), ("several", 4), ("many", 20))
        )
        + " FROM orders"
    ),
    **{
        f"order_{c}": f"SELECT CASE WHEN o_orderkey % 100 < {k} THEN -1 ELSE o_orderkey END AS {c} FROM orders"
        for c, k in (("few", 1), ("several", 4), ("many", 20))
    },
    "order_dates": "SELECT o_custkey, o_orderdate FROM orders",
}


def source(name: str) -> str:
    return f"({SOURCES[name]})" if name in SOURCES else name


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


def number(label: str) -> bool:
    return label in ("int64", "float64", "float32")


def key(name: str, label: str) -> str:
    """Group key of a value: itself, or the digest of a long text."""
    if label == "str":
        return f"CASE WHEN strlen({name}) < 64 THEN {name} ELSE sha256({name}) END"
    return f"{name}::VARCHAR"


# -- profile ------------------------------------------------------------------


def counts(name: str, columns) -> str:
    every = ", ".join(c for c, _ in columns)
    return (
        f"SELECT '{name}' AS table_name, count(*) AS row_count, "
        f"{len(columns)}::BIGINT AS column_count, "
        f"(count(*) - (SELECT count(*) FROM (SELECT DISTINCT {every} FROM {source(name)})))::BIGINT "
        f"AS duplicate_row_count FROM {source(name)}"
    )


def missing(name: str, columns) -> str:
    return union(
        [
            f"SELECT '{name}' AS table_name, '{c}' AS column_name, "
            f"count(*) - count({c}) AS missing_count FROM {source(name)}"
            for c, _ in columns
        ]
    )


def nunique(name: str, columns) -> str:
    return union(
        [
            f"SELECT '{name}' AS table_name, '{c}' AS column_name, "
            f"count(DISTINCT {c}) AS unique_count FROM {source(name)}"
            for c, _ in columns
        ]
    )


def dtypes(name: str, columns) -> str:
    return union(
        [
            f"SELECT '{name}' AS table_name, '{c}' AS column_name, '{label}' AS data_type, "
            f"count(*) AS row_count FROM {source(name)}"
            for c, label in columns
        ]
    )


STATS = (
    "round(avg({c}), 6) AS mean, round(median({c}), 6) AS median, "
    "round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max"
)


def stats(name: str, columns) -> str:
    return union(
        [
            f"SELECT '{name}' AS table_name, '{c}' AS column_name, {STATS.format(c=c)} "
            f"FROM {source(name)}"
            for c, label in columns
            if number(label)
        ]
    )


def best(name: str, c: str, label: str) -> str:
    """One row: mode_value, mode_count."""
    return (
        f"(SELECT any_value({c})::VARCHAR AS mode_value, count(*) AS mode_count FROM {source(name)} "
        f"WHERE {c} IS NOT NULL GROUP BY {key(c, label)} "
        f"ORDER BY count(*) DESC, {key(c, label)} LIMIT 1)"
    )


def mode(name: str, columns) -> str:
    return union(
        [
            f"SELECT '{name}' AS table_name, '{c}' AS column_name, mode_value, mode_count "
            f"FROM {best(name, c, label)}"
            for c, label in columns
            if not number(label)
        ]
    )


def distribution(name: str, target: str) -> str:
    return (
        f"SELECT '{name}' AS table_name, coalesce({target}::VARCHAR, 'nan') AS target_value, "
        f"count(*) AS n FROM {source(name)} GROUP BY ALL"
    )


def column_summary(name: str, columns, target: str) -> str:
    rows = []
    for c, label in columns:
        if c == target:
            continue
        extremes = (
            f"round(avg({c}), 6) AS mean, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max"
            if number(label)
            else "NULL::DOUBLE AS mean, NULL::DOUBLE AS min, NULL::DOUBLE AS max"
        )
        rows.append(
            f"SELECT '{c}' AS column_name, '{label}' AS data_type, {number(label)} AS is_numeric, "
            f"count(*) - count({c}) AS missing_count, count(DISTINCT {c}) AS unique_count, "
            f"count(*) AS row_count, {extremes} FROM {source(name)}"
        )
    return union(rows)


def whole_profile(name: str, columns, target: str) -> str:
    rows = []
    for c, label in columns:
        head = (
            f"'{c}' AS column_name, '{label}' AS data_type, {number(label)} AS is_numeric, "
            f"(SELECT count(*) FROM {source(name)}) AS row_count, "
            f"(SELECT count(*) - count({c}) FROM {source(name)}) AS missing_count, "
            f"(SELECT count(DISTINCT {c}) FROM {source(name)}) AS unique_count"
        )
        empty = ", ".join(f"NULL::DOUBLE AS {s}" for s in ("mean", "median", "std", "min", "max"))
        no_mode = "NULL::VARCHAR AS mode_value, NULL::BIGINT AS mode_count"
        if number(label):
            rows.append(f"SELECT {head}, {STATS.format(c=c)}, {no_mode} FROM {source(name)}")
        elif c == target:
            rows.append(f"SELECT {head}, {empty}, {no_mode}")
        else:
            rows.append(
                f"SELECT {head}, {empty}, mode_value, mode_count FROM {best(name, c, label)}"
            )
    return union(rows)


# -- findings -----------------------------------------------------------------


def facts(name: str, columns, distinct: bool = True) -> str:
    """Rows (position, c, n, m, u, lo, hi, num) of a table's columns."""
    unique = "count(DISTINCT {c})" if distinct else "0"
    rows = []
    for i, (c, label) in enumerate(columns):
        low, high = (f"min({c})::DOUBLE", f"max({c})::DOUBLE") if number(label) else ("NULL", "NULL")
        rows.append(
            f"SELECT {i} AS position, '{c}' AS c, count(*) AS n, count(*) - count({c}) AS m, "
            f"{unique.format(c=c)} AS u, {low} AS lo, {high} AS hi, {number(label)} AS num "
            f"FROM {source(name)}"
        )
    return "(" + union(rows) + ")"


def graded(value: str, low: float, medium: float) -> str:
    return f"CASE WHEN {value} <= {low} THEN 'low' WHEN {value} <= {medium} THEN 'medium' ELSE 'high' END"


def finding(name, kind, severity, column, evidence, percent, table) -> str:
    return (
        f"SELECT '{name}' AS table_name, '{kind}' AS issue_type, {severity} AS severity, "
        f"{column} AS \"column\", {evidence} AS evidence, {text(ADVICE[kind])} AS recommendation, "
        f"round({percent}, 6) AS percent FROM {table}"
    )


def dq_missing(name, columns) -> str:
    share = "(m / n * 100.0)"
    evidence = (
        f"printf('Column ''%s'' has %d missing value(s), which is %.2f%% of the %d rows in the dataset.', "
        f"c, m, {share}, n)"
    )
    return finding(
        name, "missing_values", graded(share, 5, 20), "c",
        evidence, share, f"{facts(name, columns, False)} WHERE m > 0",
    )


def dq_duplicates(name, columns) -> str:
    share = "(duplicate_row_count / row_count * 100.0)"
    evidence = (
        f"printf('The dataset contains %d duplicate row(s), which is %.2f%% of the %d rows.', "
        f"duplicate_row_count, {share}, row_count)"
    )
    return finding(
        name, "duplicate_rows", graded(share, 2, 10),
        "NULL::VARCHAR", evidence, share, f"({counts(name, columns)}) WHERE duplicate_row_count > 0",
    )


def dq_cardinality(name, columns) -> str:
    share = "(u / n * 100.0)"
    evidence = (
        f"printf('Column ''%s'' has %d unique value(s) out of %d rows, which is %.2f%% of the dataset.', "
        f"c, u, n, {share})"
    )
    return finding(
        name, "high_cardinality", f"CASE WHEN {share} >= 99 THEN 'high' ELSE 'medium' END",
        "c", evidence, share, f"{facts(name, columns)} WHERE u / n >= 0.95",
    )


def dq_constant(name, columns) -> str:
    evidence = (
        "printf('Column ''%s'' contains only 1 unique non-null value across the %d rows in the dataset.', c, n)"
    )
    return finding(
        name, "constant_column", "'medium'", "c", evidence, "NULL::DOUBLE",
        f"{facts(name, columns)} WHERE u = 1",
    )


def dq_all(name, columns) -> str:
    """Findings in report order."""
    stages = [dq_missing, dq_duplicates, dq_cardinality, dq_constant]
    places = ", ".join(f"('{c}', {i})" for i, (c, _) in enumerate(columns))
    rows = union([f"SELECT {i} AS stage, * FROM ({f(name, columns)})" for i, f in enumerate(stages)])
    return (
        "SELECT table_name, row_number() OVER (ORDER BY stage, coalesce(p, 0))::INTEGER AS ordinal, "
        f'issue_type, severity, "column", percent FROM ({rows}) '
        f'LEFT JOIN (VALUES {places}) AS v(name, p) ON "column" = name'
    )


def dq_line(name, columns) -> str:
    return (
        f"SELECT '{name}' AS table_name, count(*) AS finding_count, CASE WHEN count(*) > 0 "
        f"THEN count(*)::VARCHAR || ' data-quality issue(s) detected.' ELSE 'No data-quality issues detected.' END AS summary "
        f"FROM ({dq_all(name, columns)})"
    )


def imbalance(name: str, table: str, target: str) -> str:
    top = (
        f"(SELECT coalesce({target}::VARCHAR, 'nan') AS v, count(*) AS k, "
        f"(SELECT count(*) FROM {source(table)}) AS total, count(*) OVER () AS classes "
        f"FROM {source(table)} GROUP BY {target} ORDER BY count(*) DESC, v LIMIT 1)"
    )
    ratio = "(k / total)"
    return (
        f"SELECT '{name}' AS table_name, 'target_imbalance' AS finding_type, "
        f"CASE WHEN {ratio} < 0.75 THEN 'low' "
        f"WHEN {ratio} < 0.9 THEN 'medium' ELSE 'high' END AS importance, "
        f"'{target}' AS columns, printf('The target class ''%s'' represents %d out of %d target "
        f"observations, which is %.2f%% of the dataset.', v, k, total, {ratio} * 100) AS evidence, "
        f"{text(IMBALANCE_MEANING)} AS interpretation, "
        f"{text(IMBALANCE_IMPLICATION)} AS modeling_implication, round({ratio} * 100, 6) AS percent "
        f"FROM {top} WHERE classes >= 2 AND {ratio} >= 0.6"
    )


def dominant(name: str, columns) -> str:
    ratio = "(mode_count / n)"
    rows = union(
        [
            f"SELECT {i} AS position, '{c}' AS c, mode_value, mode_count, "
            f"(SELECT count(*) FROM {source(name)}) AS n FROM {best(name, c, label)}"
            for i, (c, label) in enumerate(columns)
            if not number(label)
        ]
    )
    return (
        f"SELECT '{name}' AS table_name, 'dominant_category' AS finding_type, "
        f"CASE WHEN {ratio} >= 0.95 THEN 'high' "
        f"WHEN {ratio} >= 0.9 THEN 'medium' ELSE 'low' END AS importance, "
        f"c AS columns, printf('The categorical column ''%s'' is dominated by the value ''%s'', which "
        f"appears in %d out of %d rows (%.2f%% of the dataset).', c, mode_value, mode_count, n, {ratio} * 100) "
        f"AS evidence, 'The feature ''' || c || {text(DOMINANT_MEANING)} AS interpretation, "
        f"'The feature ''' || c || {text(DOMINANT_IMPLICATION)} AS modeling_implication, "
        f"round({ratio} * 100, 6) AS percent FROM ({rows}) WHERE {ratio} >= 0.8"
    )


def eda_all(name: str, columns, target: str) -> str:
    rows = (
        f"SELECT 0 AS stage, * FROM ({imbalance(name, name, target)}) "
        f"UNION ALL SELECT 1 AS stage, * FROM ({dominant(name, columns)})"
    )
    places = ", ".join(f"('{c}', {i})" for i, (c, _) in enumerate(columns))
    return (
        "SELECT row_number() OVER (ORDER BY stage, p)::INTEGER AS ordinal, finding_type, importance, "
        f"columns, percent, (count(*) OVER ())::VARCHAR || ' EDA finding(s) detected.' AS summary "
        f"FROM ({rows}) JOIN (VALUES {places}) AS v(name, p) ON columns = name"
    )


# -- planner ------------------------------------------------------------------


def log_rows(name, columns, target, prefix="log1p_") -> str:
    return (
        f"SELECT 0 AS stage, position AS a, 0 AS b, 0 AS k, '{prefix}' || c AS feature_name, "
        f"'log1p' AS transformation_type, c AS columns FROM {facts(name, columns, False)} "
        f"WHERE num AND c <> '{target}' AND (lo > 0 OR (lo >= 0 AND hi > 0))"
    )


def pair_rows(name, columns, target) -> str:
    ids = "('id', 'customer_id', 'user_id', 'account_id', 'client_id', 'customerid')"
    fit = (
        f"(SELECT position, c FROM {facts(name, columns, False)} WHERE num AND c <> '{target}' "
        f"AND c NOT IN {ids} AND (lo IS NULL OR lo >= 0))"
    )
    kinds = [
        ("'ratio_' || x.c || '_to_' || y.c", "ratio"),
        ("'diff_' || x.c || '_minus_' || y.c", "difference"),
        ("'product_' || x.c || '_times_' || y.c", "product"),
    ]
    return union(
        [
            f"SELECT 1 AS stage, x.position AS a, y.position AS b, {k} AS k, {shown} AS feature_name, "
            f"'{kind}' AS transformation_type, x.c || ',' || y.c AS columns "
            f"FROM {fit} x JOIN {fit} y ON x.position < y.position"
            for k, (shown, kind) in enumerate(kinds)
        ]
    )


def gap_rows(name, columns, target, stage=2, k=0) -> str:
    return (
        f"SELECT {stage} AS stage, position AS a, 0 AS b, {k} AS k, c || '_is_missing' AS feature_name, "
        f"'missing_indicator' AS transformation_type, c AS columns FROM {facts(name, columns, False)} "
        f"WHERE c <> '{target}' AND m > 0"
    )


def plan(rows: list[str], name: str | None = None) -> str:
    head = "" if name is None else f"'{name}' AS table_name, "
    return (
        f"SELECT {head}row_number() OVER (ORDER BY stage, a, b, k)::INTEGER AS ordinal, feature_name, "
        f"transformation_type, columns FROM ({union(rows)})"
    )


def full_plan(name, columns, target) -> str:
    return plan([f(name, columns, target) for f in (log_rows, pair_rows, gap_rows)])


def log_of_plan(name, columns, target) -> str:
    """Outcome of the planned specs plus two more (see ``catalog.fe_log``)."""
    planned = full_plan(name, columns, target)
    names = [c for c, _ in columns]
    if "c_acctbal" in names:
        negative = f"(SELECT min(c_acctbal) < 0 FROM {source(name)})"
        reason = (
            f"CASE WHEN {negative} THEN 'Source column ''c_acctbal'' contains negative values; "
            "log1p requires non-negative data.' END"
        )
    else:
        reason = "'Source column ''c_acctbal'' does not exist.'"
    n = f"(SELECT count(*) FROM ({planned}))"
    rows = union(
        [
            "SELECT ordinal, feature_name, transformation_type, CASE WHEN transformation_type IN "
            "('difference', 'product') THEN 'Unsupported transformation type: ' || transformation_type END "
            f"AS reason FROM ({planned})",
            f"SELECT {n} + 1, 'log1p_acct', 'log1p', {reason}",
            f"SELECT {n} + 2, '{target}', 'missing_indicator', 'Feature name ''{target}'' is the target column.'",
        ]
    )
    return (
        f"SELECT '{name}' AS table_name, ordinal::INTEGER AS ordinal, feature_name, transformation_type, "
        f"CASE WHEN reason IS NULL THEN 'applied' ELSE 'skipped' END AS status, reason FROM ({rows})"
    )


def report_of_plan(name, columns, target) -> str:
    planned = full_plan(name, columns, target)
    made = "transformation_type NOT IN ('difference', 'product')"
    return (
        f"SELECT (SELECT count(*) FROM {source(name)}) AS original_row_count, "
        f"{len(columns)}::BIGINT AS original_column_count, "
        f"(SELECT count(*) FROM {source(name)}) AS engineered_row_count, "
        f"({len(columns)} + count(*) FILTER ({made}))::BIGINT AS engineered_column_count, "
        f"coalesce(string_agg(feature_name, '|' ORDER BY ordinal) FILTER ({made}), '') AS features_created, "
        "coalesce(string_agg(feature_name || ': Unsupported transformation type: ' || transformation_type, "
        f"'|' ORDER BY ordinal) FILTER (NOT {made}), '') AS features_skipped, "
        f"'Applied ' || count(*) FILTER ({made}) || ' feature(s) and skipped ' || "
        f"count(*) FILTER (NOT {made}) || ' feature(s).' AS summary FROM ({planned})"
    )


# -- split and preparation ----------------------------------------------------


def split(name: str, target: str, id_column: str, seed: int = 42) -> str:
    """Every row with is_test: train quotas by largest remainder, rows by hash."""
    return f"""(
WITH src AS (SELECT * FROM {source(name)}),
 per AS (SELECT {target} AS t, count(*) AS n, (SELECT count(*) FROM src) AS total FROM src GROUP BY 1),
 sized AS (SELECT *, total - ceil(0.2 * total)::BIGINT AS train FROM per),
 shares AS (SELECT *, (n * train) // total AS whole, (n * train) % total AS part FROM sized),
 quotas AS (SELECT t, n - whole - CASE WHEN row_number() OVER (ORDER BY part DESC, t)
            <= train - (SELECT sum(whole) FROM shares) THEN 1 ELSE 0 END AS quota FROM shares)
SELECT src.*, row_number() OVER (PARTITION BY {target} ORDER BY md5('{seed}|' || {id_column})) <= quota
 AS is_test FROM src JOIN quotas ON {target} = t)"""


ORDER_SPLIT = split("orders_gaps", "o_orderstatus", "o_orderkey")


# -- predictions and experiments ----------------------------------------------

PREDICTIONS = (
    "(SELECT l_suppkey, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, "
    "l_quantity / 50 AS score, CASE WHEN l_quantity / 50 >= 0.7 THEN 1 ELSE 0 END AS prediction FROM lineitem)"
)
FLAG_PREDICTIONS = (
    "(SELECT l_suppkey, l_returnflag AS label, CASE WHEN l_quantity < 10 THEN 'A' "
    "WHEN l_quantity < 30 THEN 'N' ELSE 'R' END AS prediction FROM lineitem)"
)
PART_PREDICTIONS = (
    "(SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction FROM ("
    "SELECT l_partkey AS experiment, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS label, "
    "'baseline' AS variant, l_quantity / 50 AS score FROM lineitem UNION ALL "
    "SELECT l_partkey, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END, 'engineered', "
    "l_extendedprice * (1 - l_discount) / 120000 FROM lineitem))"
)


def f1(table: str, by: str) -> str:
    """Per group: weighted f1."""
    return (
        f"(SELECT {by}, sum(s * 2.0 * h / (s + g)) / sum(s) AS f1_score FROM ("
        f"SELECT {by}, c, sum(s) AS s, sum(g) AS g, sum(h) AS h FROM ("
        f"SELECT {by}, label AS c, 1 AS s, 0 AS g, CASE WHEN label = prediction THEN 1 ELSE 0 END AS h "
        f"FROM {table} UNION ALL SELECT {by}, prediction, 0, 1, 0 FROM {table}) GROUP BY {by}, c) "
        f"GROUP BY {by})"
    )


def auc(table: str, by: str) -> str:
    """Per group: area from average ranks; NULL with one class."""
    return (
        f"(SELECT {by}, (sum(r) FILTER (label = 1) - p * (p + 1) / 2) / nullif(p * q, 0) AS roc_auc FROM ("
        f"SELECT {by}, label, rank() OVER w + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2 AS r, "
        f"sum(label) OVER (PARTITION BY {by}) AS p, sum(1 - label) OVER (PARTITION BY {by}) AS q "
        f"FROM {table} WINDOW w AS (PARTITION BY {by} ORDER BY score)) GROUP BY {by}, p, q)"
    )


def part_results(digits: int = 15) -> str:
    keys = "experiment, variant"
    shown = ", ".join(f"round({m}, {digits}) AS {m}" for m in ("accuracy", "f1_score", "roc_auc"))
    measured = (
        f"(SELECT a.experiment, a.variant, {shown} FROM (SELECT {keys}, "
        f"avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy FROM {PART_PREDICTIONS} "
        f"GROUP BY {keys}) a JOIN {f1(PART_PREDICTIONS, keys)} f USING ({keys}) "
        f"JOIN {auc(PART_PREDICTIONS, keys)} r USING ({keys}))"
    )
    sides = ", ".join(
        f"{'b' if v == 'baseline' else 'e'}.{m} AS {v}_{m}"
        for v in ("baseline", "engineered")
        for m in ("accuracy", "f1_score", "roc_auc")
    )
    return (
        f"(SELECT b.experiment, {sides}, e.accuracy - b.accuracy AS accuracy_change, "
        "e.f1_score - b.f1_score AS f1_change, e.roc_auc - b.roc_auc AS roc_auc_change, "
        f"e.f1_score > b.f1_score AS improved FROM {measured} b JOIN {measured} e USING (experiment) "
        "WHERE b.variant = 'baseline' AND e.variant = 'engineered')"
    )


def decisions() -> str:
    return f"""
WITH r AS (SELECT experiment, round(accuracy_change, 12) AS a, round(f1_change, 12) AS f,
  round(roc_auc_change, 12) AS u, created, skipped FROM {part_results()} JOIN {FEATURE_LISTS} USING (experiment)),
 d AS (SELECT *, CASE WHEN len(created) = 0 THEN 'reject'
  WHEN a > 0 AND f > 0 AND coalesce(u, 0) >= 0 THEN 'accept'
  WHEN a <= 0 AND f <= 0 AND coalesce(u, 0) <= 0 THEN 'reject' ELSE 'review' END AS decision FROM r)
SELECT experiment, decision,
 CASE WHEN decision = 'reject' THEN '' ELSE array_to_string(created, '|') END AS accepted_features,
 array_to_string(CASE WHEN decision = 'reject' THEN list_concat(created, skipped) ELSE skipped END, '|')
  AS rejected_features,
 (CASE WHEN decision = 'reject' THEN 1 WHEN decision = 'accept' THEN CASE WHEN u > 0 THEN 2 ELSE 1 END
  ELSE CASE WHEN (a > 0 AND f <= 0) OR (f > 0 AND a <= 0) OR u < 0 THEN 2 ELSE 1 END END)::BIGINT AS reason_count,
 f > 0 AS performance_improved, FALSE AS leakage_warning FROM d"""


FEATURE_LISTS = (
    "(SELECT l_partkey AS experiment, list_filter([CASE WHEN min(l_discount) <= 0.01 THEN "
    "'log1p_l_discount' END, CASE WHEN max(l_quantity) >= 49 THEN 'ratio_l_tax_to_l_quantity' END], "
    "lambda x: x IS NOT NULL) AS created, list_filter([CASE WHEN max(l_tax) >= 0.08 THEN "
    "'diff_a: Unsupported transformation type: difference' END], lambda x: x IS NOT NULL) AS skipped "
    "FROM lineitem GROUP BY 1)"
)


def comparison_texts() -> str:
    both = "printf('accuracy Δ%+.4f, F1 Δ%+.4f.', a, f)"
    lead = (
        "CASE WHEN a > 0 AND f <= 0 THEN printf('accuracy improved by %+.4f but F1 declined by %+.4f', a, f) "
        "WHEN f > 0 AND a <= 0 THEN printf('F1 improved by %+.4f but accuracy declined by %+.4f', f, a) END"
    )
    tail = "CASE WHEN u < 0 THEN printf('ROC-AUC declined by %+.4f', u) END"
    return f"""
WITH r AS (SELECT *, accuracy_change AS a, f1_change AS f, roc_auc_change AS u
  FROM {part_results(12)} JOIN {FEATURE_LISTS} USING (experiment)),
 d AS (SELECT *, CASE WHEN len(created) = 0 THEN 'reject'
  WHEN a > 0 AND f > 0 AND coalesce(u, 0) >= 0 THEN 'accept'
  WHEN a <= 0 AND f <= 0 AND coalesce(u, 0) <= 0 THEN 'reject' ELSE 'review' END AS decision,
  concat_ws('; ', {lead}, {tail}) AS mixed FROM r),
 w AS (SELECT *, CASE WHEN len(created) = 0 THEN ['No engineered features were successfully created.']
  WHEN decision = 'accept' THEN ['Model performance improved: ' || {both},
   CASE WHEN u > 0 THEN printf('ROC-AUC Δ%+.4f.', u) END]
  WHEN decision = 'reject' THEN ['No performance improvement: ' || {both}]
  ELSE [CASE WHEN mixed <> '' THEN 'Mixed results: ' || mixed || '.' END,
   'Engineered features show some benefit but not uniformly positive.'] END AS why FROM d),
 k AS (SELECT *, list_filter(why, lambda x: x IS NOT NULL) AS reasons FROM w)
SELECT experiment,
 printf('Baseline model achieved accuracy %.4f and F1 %.4f. Engineered model achieved accuracy %.4f and F1 %.4f. ',
  baseline_accuracy, baseline_f1_score, engineered_accuracy, engineered_f1_score)
 || CASE WHEN u IS NULL THEN '' ELSE printf('ROC-AUC changed from %.4f to %.4f (Δ %+.4f). ',
  baseline_roc_auc, engineered_roc_auc, u) END
 || CASE WHEN improved THEN 'The engineered features improved model performance.' WHEN a > 0 THEN
  'Accuracy improved but F1 did not; some metrics improved while others declined.'
  ELSE 'The engineered features did not improve model performance.' END AS summary,
 array_to_string(reasons, '|') AS reasons,
 printf('Critic reviewed %d engineered feature(s). Decision: %s. Key reasons: ', len(created), upper(decision))
  || array_to_string(reasons, '; ') AS decision_summary FROM k"""


# -- suggestions --------------------------------------------------------------

INNER = """'{"conv": ' || conv_id || ', "turn": ' || turn || '}'"""
FENCED = f"""(SELECT conv_id, turn, CASE role
 WHEN 'user' THEN text || chr(10) || '```json' || chr(10) || {INNER} || chr(10) || '```' || chr(10) || text
 WHEN 'assistant' THEN '  ' || {INNER} || ' ' || chr(10) ELSE text END AS response FROM conversations)"""

TURNS = (
    "(SELECT conv_id, turn, role, text, length(text) AS n, length(text) - length(translate(text, CASE role "
    "WHEN 'user' THEN chr(10) WHEN 'assistant' THEN ' ' ELSE 'aeiou' END, '')) AS m, CASE WHEN role = 'system' THEN FALSE ELSE length(text) < 1000 END AS valid FROM conversations)"
)
MERGED = f"""(
SELECT conv_id, turn, 1 AS ordinal, 'deterministic' AS origin, 'missing_values' AS issue_type,
 {graded("(m / n * 100.0)", 5, 20)} AS severity, role AS "column",
 printf('Column ''%s'' has %d missing value(s), which is %.2f%% of the %d rows in the dataset.',
  role, m, m / n * 100.0, n) AS evidence FROM {TURNS} WHERE m > 0
UNION ALL SELECT conv_id, turn, CASE WHEN m > 0 THEN 2 ELSE 1 END, 'supplied', 'outlier', 'low', role, text
 FROM {TURNS} WHERE valid)"""

SPEC_RESPONSES = """(SELECT event_id, '{"specs": [{"feature_name": "f_' || event_id ||
 '", "transformation_type": "' || CASE event_type WHEN 'view' THEN 'ratio' WHEN 'click' THEN 'log1p'
 WHEN 'purchase' THEN 'sqrt' ELSE event_type END || '", "columns": ' ||
 CASE WHEN event_type = 'view' THEN '["value","user_id"]' WHEN value < 5 THEN '[]'
 WHEN value < 10 THEN '["nope"]' WHEN value < 15 THEN '[7]' WHEN value < 20 THEN '["value","event_type"]' ELSE '["value"]' END ||
 '}], "summary": "s"}' AS response FROM events)"""


def suggested() -> str:
    parsed = (
        "(SELECT event_id, response ->> '$.specs[0].feature_name' AS feature_name, "
        "response ->> '$.specs[0].transformation_type' AS transformation_type, "
        f"json_extract_string(response, '$.specs[0].columns[*]') AS columns FROM {SPEC_RESPONSES})"
    )
    names = ", ".join(f"'{c}'" for c, _ in EVENTS)
    return (
        "SELECT event_id, 1 AS ordinal, feature_name, transformation_type, array_to_string(columns, ',') "
        f"AS columns FROM {parsed} WHERE transformation_type IN ('ratio', 'log1p', 'sqrt') "
        f"AND len(columns) > 0 AND list_has_all([{names}], columns)"
    )


def line(expression: str) -> str:
    return f"SELECT {expression} FROM lineitem"


BOOLS = (
    "(SELECT l_orderkey, l_quantity > 25 AS a, CASE WHEN l_discount > 0 THEN l_tax > 0.04 END AS b FROM lineitem)"
)


def top(column: str, k: int) -> str:
    return f"(SELECT {column} FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {k})"


def supplied_plan() -> str:
    """Planned specs, then the two usable ones of ``inputs.label_specs``."""
    planned = full_plan("docs_labels", DOCS_LABELS, "quality")
    n, labels = f"(SELECT count(*) FROM ({planned}))", "(SELECT count(*) FROM labels)"
    return (
        f"{planned} UNION ALL SELECT ({n} + 1)::INTEGER, 'f' || {labels} || '_1', 'ratio', 'n_chars,doc_id' "
        f"UNION ALL SELECT ({n} + 4)::INTEGER, 'f' || {labels} || '_4', 'log1p', 'quality'"
    )


def explore_rows() -> str:
    """Rows of the exploratory report of label_texts, with evidence and implication."""
    rows = (
        f"SELECT 0 AS stage, * FROM ({imbalance('label_texts', 'label_texts', 'quality')}) "
        f"UNION ALL SELECT 1 AS stage, * FROM ({dominant('label_texts', LABEL_TEXTS)})"
    )
    places = ", ".join(f"('{c}', {i})" for i, (c, _) in enumerate(LABEL_TEXTS))
    return (
        "(SELECT row_number() OVER (ORDER BY stage, p) AS ordinal, finding_type, importance, columns, evidence, "
        f"modeling_implication FROM ({rows}) JOIN (VALUES {places}) AS v(name, p) ON columns = name)"
    )


def explore_merged() -> str:
    return (
        "SELECT ordinal::INTEGER AS ordinal, 'deterministic' AS origin, finding_type, importance, columns, "
        f"md5(evidence) AS evidence_md5, modeling_implication FROM {explore_rows()} UNION ALL "
        f"SELECT ((SELECT count(*) FROM {explore_rows()}) + row_number() OVER (ORDER BY quality))::INTEGER, "
        "'supplied', 'class_size', 'low', 'quality,toxic', md5('Rows: ' || count(*)), NULL "
        "FROM labels GROUP BY quality"
    )


# -- models on a table where one column tells the class ------------------------

DOC_SPLIT = split("labelled_docs", "quality", "doc_id")
TESTED = "ceil(0.2::DOUBLE * count(*))::BIGINT"


def gradient() -> str:
    """Every feature of the fitted model; the penalised loss is flat in each."""
    names = ["SELECT 'doc_id' AS feature", "SELECT 'n_chars'", "SELECT 'toxic'", "SELECT '(intercept)'"]
    names += [
        f"SELECT DISTINCT '{c}=' || CASE WHEN strlen({c}) < 64 THEN {c} ELSE sha256({c}) END "
        f"FROM {DOC_SPLIT} WHERE NOT is_test"
        for c in ("text", "lang", "source")
    ]
    return f"SELECT feature, 0::DOUBLE AS gradient FROM ({union(names)})"


def two_levels() -> str:
    """Newton's method for the intercept b and the coefficients w and -w of the two levels."""
    rows = split("(SELECT doc_id, quality, toxic FROM labels)", "quality", "doc_id")
    one, zero = "(n1 / (1 + exp(-b - w)) - y1 + w)", "(n0 / (1 + exp(w - b)) - y0 - w)"
    s1, s0 = (f"({n} * exp({x}) / pow(1 + exp({x}), 2))" for n, x in (("n1", "(-b - w)"), ("n0", "(w - b)")))
    size = f"({s1} * ({s0} + 1) + {s0} * ({s1} + 1))"
    return f"""
WITH RECURSIVE held AS (
  SELECT count(*) FILTER (toxic = 1)::DOUBLE AS n1, count(*) FILTER (toxic = 0)::DOUBLE AS n0,
    sum(quality) FILTER (toxic = 1)::DOUBLE AS y1, sum(quality) FILTER (toxic = 0)::DOUBLE AS y0
  FROM {rows} WHERE NOT is_test),
steps AS (
  SELECT 0 AS k, 0::DOUBLE AS b, 0::DOUBLE AS w
  UNION ALL
  SELECT k + 1, b - (({s0} + 1) * {one} + ({s1} + 1) * {zero}) / {size}, w - ({s0} * {one} - {s1} * {zero}) / {size}
  FROM steps, held WHERE k < 60)
SELECT feature, round(value, 4) AS coefficient
FROM (SELECT b, w FROM steps WHERE k = 60), (VALUES ('level=toxic 0', -1, 0), ('level=toxic 1', 1, 0), ('(intercept)', 0, 1))
  AS f(feature, of_w, of_b), LATERAL (SELECT of_w * w + of_b * b AS value)
"""


def separable_report() -> str:
    return (
        "SELECT 'LogisticRegression' AS model_name, 'binary_classification' AS task_type, 'quality' AS "
        "target_column, 1::DOUBLE AS accuracy, 1::DOUBLE AS f1_score, 1::DOUBLE AS roc_auc, "
        f"(count(*) - {TESTED})::BIGINT AS train_rows, {TESTED} AS test_rows, "
        f"'Baseline LogisticRegression model trained on ' || (count(*) - {TESTED}) || ' training rows and "
        f"evaluated on ' || {TESTED} || ' test rows. Numeric features: 3, Categorical features: 4.' AS notes "
        f"FROM {source('separable_docs')}"
    )


def separable_comparison() -> str:
    ones = ", ".join(
        f"1::DOUBLE AS {v}_{m}" for v in ("baseline", "engineered") for m in ("accuracy", "f1_score", "roc_auc")
    )
    return (
        f"SELECT 'quality' AS experiment, {ones}, 0::DOUBLE AS accuracy_change, 0::DOUBLE AS f1_change, "
        "0::DOUBLE AS roc_auc_change, FALSE AS improved, features_created, features_skipped, "
        "'Baseline model achieved accuracy 1.0000 and F1 1.0000. Engineered model achieved accuracy 1.0000 and "
        "F1 1.0000. ROC-AUC changed from 1.0000 to 1.0000 (Δ +0.0000). The engineered features did not improve "
        f"model performance.' AS summary FROM ({report_of_plan('separable_docs', SEPARABLE, 'quality')})"
    )


def separable_review() -> str:
    lists = report_of_plan("separable_docs", SEPARABLE, "quality")
    issues = f"(SELECT count(*) FROM ({dq_all('separable_docs', SEPARABLE)}))"
    found = f"(SELECT count(*) FROM ({eda_all('separable_docs', SEPARABLE, 'quality')}))"
    made, left = (f"len(string_split(features_{x}, '|'))" for x in ("created", "skipped"))
    return (
        f"SELECT 'quality' AS target_column, original_row_count AS row_count, original_column_count AS column_count, "
        f"{issues} AS quality_issues, {found} AS eda_findings, features_created, features_skipped, 'reject' AS "
        "decision, '' AS accepted_features, 'No performance improvement: accuracy Δ+0.0000, F1 Δ+0.0000.' AS reasons, "
        f"'Pipeline completed. Data quality: ' || {issues} || ' issue(s). EDA: ' || {found} || ' finding(s). "
        f"Features: ' || {made} || ' created, ' || {left} || ' skipped. Modeling: baseline accuracy 1.0000 → "
        f"engineered 1.0000. Critic decision: reject.' AS review_summary FROM ({lists})"
    )


SQL: dict[str, str] = {
    "model_gradient": gradient(),
    "model_two_levels": two_levels(),
    "model_test_rows": f"SELECT doc_id, quality::DOUBLE AS label FROM {DOC_SPLIT} WHERE is_test",
    "model_report_separable": separable_report(),
    "compare_separable": separable_comparison(),
    "review_separable": separable_review(),
    "target_distribution_present": (
        "SELECT quality::VARCHAR AS target_value, count(*) AS n FROM labels JOIN documents USING (doc_id) "
        "WHERE quality IS NOT NULL GROUP BY 1"
    ),
    "plan_supplied": supplied_plan(),
    "findings_merge_explore": explore_merged(),
    "findings_merge_explore_summary": (
        f"SELECT count(*) AS finding_count, count(*)::VARCHAR || ' EDA finding(s) detected.' AS summary "
        f"FROM ({explore_merged()})"
    ),
    "profile_counts": union(
        [
            counts("lineitem", LINEITEM),
            counts("line_flags", LINEITEM[8:10] + LINEITEM[4:5]),
            counts("docs_labels", DOCS_LABELS),
            counts("embeddings", EMBEDDINGS),
        ]
    ),
    "profile_missing": union(
        [
            missing("docs_labels", DOCS_LABELS),
            missing("orders_gaps", ORDERS_GAPS),
            missing("embeddings", EMBEDDINGS),
        ]
    ),
    "profile_nunique": union(
        [nunique("lineitem", LINEITEM), nunique("docs_labels", DOCS_LABELS), nunique("pages", PAGES)]
    ),
    "profile_dtypes": union([dtypes("lineitem", LINEITEM), dtypes("documents", DOCUMENTS)]),
    "profile_numeric_stats": union(
        [stats("lineitem", LINEITEM), stats("orders_gaps", ORDERS_GAPS), stats("customer", CUSTOMER)]
    ),
    "profile_mode": union(
        [
            mode("docs_labels", DOCS_LABELS),
            mode("orders", ORDERS),
            mode("pages", PAGES),
            mode("lineitem", LINEITEM),
        ]
    ),
    "target_distribution": union(
        [distribution("docs_labels", "quality"), distribution("lineitem", "l_returnflag")]
    ),
    "profile_column_summary": column_summary("docs_labels", DOCS_LABELS, "quality"),
    "profile_excl_target": whole_profile("lineitem", LINEITEM, "l_returnflag"),
    "dq_missing_values": union(
        [dq_missing("docs_labels", DOCS_LABELS), dq_missing("orders_gaps", ORDERS_GAPS)]
    ),
    "dq_duplicate_rows": union(
        [
            dq_duplicates("lineitem", LINEITEM),
            dq_duplicates("line_flags", LINEITEM[8:10] + LINEITEM[4:5]),
            dq_duplicates("order_dates", [ORDERS[1], ORDERS[4]]),
            *[dq_duplicates(f"order_{c}", [(c, "int64")]) for c, _ in REPEATS],
        ]
    ),
    "dq_high_cardinality": union(
        [
            dq_cardinality("lineitem", LINEITEM),
            dq_cardinality("documents", DOCUMENTS),
            dq_cardinality("customer", CUSTOMER),
            dq_cardinality("order_repeats", REPEATS),
        ]
    ),
    "dq_constant_column": union(
        [dq_constant("customer_const", CUSTOMER_CONST), dq_constant("lineitem", LINEITEM)]
    ),
    "dq_report": union(
        [dq_all("docs_labels", DOCS_LABELS), dq_all("customer_const", CUSTOMER_CONST)]
    ),
    "dq_summary": union(
        [
            dq_line("docs_labels", DOCS_LABELS),
            dq_line("flag_sets", LINEITEM[8:10] + LINEITEM[4:5]),
        ]
    ),
    "eda_target_imbalance": union(
        [
            imbalance("labels", "labels", "quality"),
            imbalance("toxic", "labels", "toxic"),
            imbalance("lineitem", "lineitem", "l_returnflag"),
            *[imbalance(f"share_{c}", "order_shares", c) for c, _ in SHARES],
        ]
    ),
    "eda_dominant_category": union(
        [
            dominant("label_texts", LABEL_TEXTS),
            dominant("customer_const", CUSTOMER_CONST),
            dominant("order_shares", SHARES),
        ]
    ),
    "eda_report": eda_all("label_texts", LABEL_TEXTS, "quality"),
    "plan_log1p": union(
        [
            plan([log_rows("customer", CUSTOMER, "c_mktsegment")], "customer"),
            plan([log_rows("lineitem", LINEITEM, "l_returnflag")], "lineitem"),
        ]
    ),
    "plan_pairs": union(
        [
            plan([pair_rows("customer", CUSTOMER, "c_mktsegment")], "customer"),
            plan([pair_rows("lineitem", LINEITEM, "l_returnflag")], "lineitem"),
            plan([pair_rows("events", EVENTS, "event_type")], "events"),
        ]
    ),
    "plan_missing_indicator": plan([gap_rows("docs_labels", DOCS_LABELS, "quality")]),
    "plan_full": full_plan("docs_labels", DOCS_LABELS, "quality"),
    "plan_default": plan(
        [
            log_rows("docs_labels", DOCS_LABELS, "quality", "log_"),
            gap_rows("docs_labels", DOCS_LABELS, "quality", 0, 1),
        ]
    ),
    "fe_log1p": line(
        "l_orderkey, l_extendedprice, l_discount, round(ln(1 + l_extendedprice), 6) AS log1p_price, "
        "round(ln(1 + l_discount), 6) AS log1p_discount"
    ),
    "fe_ratio": line("l_orderkey, l_tax, l_discount, round(l_tax / nullif(l_discount, 0), 6) AS r"),
    "fe_missing_indicator": (
        "SELECT *, (o_totalprice IS NULL)::BIGINT AS price_is_missing, "
        f"(o_orderpriority IS NULL)::BIGINT AS priority_is_missing FROM {source('orders_gaps')}"
    ),
    "fe_count_sum": (
        "SELECT doc_id, n_chars, quality, toxic, (coalesce(quality, 0) + coalesce(toxic, 0))::BIGINT AS flags, "
        f"(n_chars + coalesce(quality, 0) + coalesce(toxic, 0))::BIGINT AS all_of_it FROM {source('docs_labels')}"
    ),
    "fe_chain": (
        "SELECT l_orderkey, l_quantity, round(t, 6) AS l_tax, l_discount, round(log_qty, 6) AS log_qty, "
        "round(r, 6) AS r, round(r2, 6) AS r2, round(s, 6) AS s, round(ln(1 + s), 6) AS log_s FROM ("
        "SELECT *, coalesce(r, 0) + coalesce(r2, 0) AS s FROM (SELECT *, log_qty / nullif(l_tax, 0) AS r, "
        "t / nullif(log_qty, 0) AS r2 FROM (SELECT l_orderkey, l_quantity, l_tax, l_discount, "
        "ln(1 + l_quantity) AS log_qty, ln(1 + l_tax) AS t FROM lineitem)))"
    ),
    "fe_log": union(
        [
            log_of_plan("customer", CUSTOMER, "c_mktsegment"),
            log_of_plan("docs_labels", DOCS_LABELS, "quality"),
        ]
    ),
    "fe_report": report_of_plan("docs_labels", DOCS_LABELS, "quality"),
    "fx_log": "SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6) END AS f FROM customer",
    "fx_sqrt": "SELECT c_custkey, c_nationkey, c_acctbal, round(sqrt(c_nationkey), 6) AS f FROM customer",
    "fx_binary_to_int": line(
        "l_orderkey, l_linestatus, l_returnflag, "
        "CASE WHEN l_linestatus = (SELECT max(l_linestatus) FROM lineitem) THEN 1 ELSE 0 END::BIGINT AS f"
    ),
    "fx_map_values": (
        "SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' END AS f "
        "FROM orders"
    ),
    "fx_reduce_categories": (
        f"SELECT p_partkey, p_brand, p_type, CASE WHEN p_brand IN {top('p_brand', 5)} THEN p_brand ELSE 'Other' END "
        f"AS f, CASE WHEN p_type IN {top('p_type', 2)} THEN p_type ELSE 'Other' END AS g FROM part"
    ),
    "fx_ordinal_encode": (
        "SELECT c_custkey, c_mktsegment, c_name, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS f, "
        "dense_rank() OVER (ORDER BY c_name) - 1 AS g, CASE c_mktsegment WHEN 'MACHINERY' THEN 0 "
        "WHEN 'BUILDING' THEN 1 END::BIGINT AS h FROM customer"
    ),
    "fx_string_length": "SELECT doc_id, length(text) AS f FROM documents",
    "fx_datetime_extract": (
        "SELECT o_orderkey, "
        + ", ".join(
            f"extract({p} FROM o_orderdate)::BIGINT AS {p}"
            for p in ("year", "quarter", "month", "day", "hour", "isodow")
        )
        + " FROM orders"
    ),
    "fx_bool_and": f"SELECT *, a AND b AS f FROM {BOOLS}",
    "fx_bool_or": f"SELECT *, a OR b AS f FROM {BOOLS}",
    "fx_count_nonzero": line(
        "l_orderkey, l_discount, l_tax, ((l_discount <> 0)::BIGINT + (l_tax <> 0)::BIGINT) AS f"
    ),
    "fx_sum_squares": line(
        "l_orderkey, l_discount, l_tax, round(l_discount * l_discount + l_tax * l_tax, 6) AS f"
    ),
    "fx_difference": (
        "SELECT o_orderkey, o_totalprice, o_custkey, round(o_totalprice - o_custkey, 6) AS f "
        f"FROM {source('orders_gaps')}"
    ),
    "fx_product": line("l_orderkey, l_quantity, l_discount, round(l_quantity * l_discount, 6) AS f"),
    "fx_interaction": line("l_orderkey, l_quantity, l_tax, round(l_quantity * l_tax, 6) AS f"),
    "split_stratified": (
        f"SELECT o_orderkey, o_orderstatus, is_test FROM {split('orders', 'o_orderstatus', 'o_orderkey')}"
    ),
    "split_keyless": (
        "WITH c AS (SELECT l_returnflag, count(*) AS n, sum(count(*)) OVER () AS total FROM lineitem GROUP BY 1), "
        "k AS (SELECT *, total - CAST(ceil(CAST(0.2 AS DOUBLE) * total) AS BIGINT) AS tr FROM c), "
        "w AS (SELECT *, n * tr // total AS whole, n * tr % total AS rest FROM k), "
        "q AS (SELECT *, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, l_returnflag) "
        "<= tr - sum(whole) OVER () THEN 1 ELSE 0 END AS kept FROM w), "
        "f AS (SELECT l_returnflag, count(*) FILTER (WHERE n >= 60) AS frequent FROM (SELECT l_returnflag, "
        "count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity) GROUP BY 1) "
        'SELECT l_returnflag, n AS "rows", CAST(n - kept AS BIGINT) AS test_rows, frequent, '
        "frequent AS on_both_sides FROM q JOIN f USING (l_returnflag)"
    ),
    "impute_median": (
        f"WITH s AS (SELECT * FROM {ORDER_SPLIT}) SELECT o_orderkey, is_test, round(coalesce(o_totalprice, "
        "(SELECT median(o_totalprice) FROM s WHERE NOT is_test)), 6) AS o_totalprice FROM s"
    ),
    "impute_mode": (
        f"WITH s AS (SELECT * FROM {ORDER_SPLIT}) SELECT o_orderkey, is_test, coalesce(o_orderpriority, "
        "(SELECT o_orderpriority FROM s WHERE NOT is_test AND o_orderpriority IS NOT NULL GROUP BY 1 "
        "ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority FROM s"
    ),
    "standard_scale": (
        f"WITH s AS (SELECT * FROM {ORDER_SPLIT}), "
        "f AS (SELECT o_orderkey, is_test, o_custkey, coalesce(o_totalprice, (SELECT median(o_totalprice) "
        "FROM s WHERE NOT is_test)) AS p FROM s), m AS (SELECT avg(p) AS mp, stddev_pop(p) AS sp, "
        "avg(o_custkey) AS mc, stddev_pop(o_custkey) AS sc FROM f WHERE NOT is_test) "
        "SELECT o_orderkey, is_test, round((p - mp) / sp, 6) AS o_totalprice, "
        "round((o_custkey - mc) / sc, 6) AS o_custkey FROM f, m"
    ),
    "one_hot_wide": (
        f"WITH s AS (SELECT o_orderkey, is_test, 'order ' || o_orderkey AS v FROM {ORDER_SPLIT}), "
        "lv AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT v FROM s WHERE NOT is_test)) "
        "SELECT o_orderkey, (SELECT count(*) FROM lv) AS slots, i AS hot_slot FROM s LEFT JOIN lv USING (v)"
    ),
    "one_hot": (
        f"WITH s AS (SELECT * FROM {ORDER_SPLIT}), tr AS (SELECT * FROM s WHERE NOT is_test AND "
        "o_orderpriority IS DISTINCT FROM '1-URGENT'), lv AS (SELECT o_orderpriority AS v, "
        "row_number() OVER (ORDER BY o_orderpriority) - 1 AS i FROM (SELECT DISTINCT o_orderpriority FROM tr "
        "WHERE o_orderpriority IS NOT NULL)), f AS (SELECT o_orderkey, coalesce(o_orderpriority, "
        "(SELECT o_orderpriority FROM tr WHERE o_orderpriority IS NOT NULL GROUP BY 1 "
        "ORDER BY count(*) DESC, 1 LIMIT 1)) AS v FROM s) "
        "SELECT o_orderkey, (SELECT count(*) FROM lv) AS slots, i AS hot_slot FROM f LEFT JOIN lv USING (v)"
    ),
    "metric_accuracy": (
        "SELECT l_suppkey, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy, "
        f"count(*) AS rows FROM {PREDICTIONS} GROUP BY 1"
    ),
    "metric_weighted_f1": (
        f"SELECT l_suppkey, round(f1_score, 6) AS f1_score FROM {f1(FLAG_PREDICTIONS, 'l_suppkey')}"
    ),
    "metric_roc_auc": (
        f"SELECT l_suppkey, round(roc_auc, 6) AS roc_auc FROM {auc(PREDICTIONS, 'l_suppkey')} UNION ALL "
        "SELECT NULL, round(roc_auc, 6) FROM "
        + auc("(SELECT 1 AS g, label, score FROM " + PREDICTIONS + ")", "g")
    ),
    "compare_deltas": (
        "SELECT experiment, "
        + ", ".join(
            f"round({c}, 6) AS {c}"
            for c in (
                "baseline_accuracy", "baseline_f1_score", "baseline_roc_auc", "engineered_accuracy",
                "engineered_f1_score", "engineered_roc_auc", "accuracy_change", "f1_change", "roc_auc_change",
            )
        )
        + f", improved FROM {part_results()}"
    ),
    "decision_rules": decisions(),
    "comparison_texts": comparison_texts(),
    "suggest_extract_json": (
        "SELECT conv_id, turn, CASE WHEN json_valid(j) THEN j END AS json_text FROM (SELECT conv_id, turn, "
        "trim(CASE WHEN contains(response, '```json') THEN regexp_extract(response, '(?s)```json(.*)```', 1) "
        f"ELSE response END, ' ' || chr(10)) AS j FROM {FENCED})"
    ),
    "findings_merge": (
        "SELECT conv_id, turn, ordinal, origin, issue_type, severity, \"column\", md5(evidence) AS evidence_md5 "
        f"FROM {MERGED}"
    ),
    "findings_merge_summary": (
        "SELECT conv_id, turn, k AS finding_count, CASE WHEN NOT valid AND k > 0 THEN k || "
        f"' data-quality issue(s) detected. LLM reasoning was requested but the response could not be validated. "
        "Deterministic findings are preserved.' WHEN NOT valid THEN 'LLM reasoning was requested but the "
        "response could not be validated. Deterministic findings are preserved.' WHEN k > 0 THEN k || "
        f"' data-quality issue(s) detected.' ELSE 'No data-quality issues detected.' END AS summary FROM "
        f"(SELECT *, valid::BIGINT + (m > 0)::BIGINT AS k FROM {TURNS})"
    ),
    "suggest_specs": suggested(),
    "sink_profile_rows": (
        "SELECT o_orderkey::VARCHAR AS target_value, count(*) AS n, (SELECT count(*) FROM orders) AS row_count "
        "FROM orders GROUP BY 1"
    ),
    "source_csv": (
        f"SELECT *, o_custkey % 2 = 0 AS wide FROM {source('orders_gaps')}"
    ),
    "source_csv_text": "SELECT doc_id, md5(text) AS text, lang, source, n_chars FROM documents",
    "sink_profile_json": (
        f"SELECT row_count, column_count, duplicate_row_count, (SELECT count(DISTINCT l_quantity) FROM lineitem) "
        "AS quantities, (SELECT median(l_quantity) FROM lineitem) AS median_quantity, "
        "(SELECT l_linestatus FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_status, "
        "(SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS returned "
        f"FROM ({counts('line_flags', LINEITEM[8:10] + LINEITEM[4:5])})"
    ),
}
