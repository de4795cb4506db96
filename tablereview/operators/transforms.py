"""Whitelisted feature transforms: validate specs, then add columns row by row.

The outcome of validation is a ``FeaturePlan``: plain column expressions plus a
log. It needs data only for preconditions (is there a negative value, which two
values, which categories); those facts come from a few shared aggregates. The
plan can then be applied to any DataFrame with the same schema.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablereview.functions import types as ty
from tablereview.functions.expressions import col, nan_as_null, rows_as_table
from tablereview.operators.lookup import Dictionary, Wanted, look_up
from tablereview.operators.ranking import places

# Transform names.
CORE = ("log1p", "ratio", "missing_indicator", "count_sum")
EXTENDED = CORE + (
    "log",
    "sqrt",
    "binary_to_int",
    "map_values",
    "reduce_categories",
    "ordinal_encode",
    "string_length",
    "datetime_extract",
    "bool_and",
    "bool_or",
    "count_nonzero",
    "sum_squares",
    "difference",
    "product",
    "interaction",
)
DATE_PARTS = {
    "year": "YEAR",
    "quarter": "QUARTER",
    "month": "MONTH",
    "day": "DAY",
    "hour": "HOUR",
    "isodow": "DAYOFWEEK_ISO",
}
FEATURE_LOG = (
    "ordinal int, feature_name string, transformation_type string, columns array<string>, "
    "status string, reason string, result_column string"
)


@dataclass(frozen=True)
class Spec:
    feature_name: str
    transformation_type: str
    columns: tuple[str, ...]
    parameters: dict = field(default_factory=dict)


class Skip(Exception):
    """The reason why a spec cannot be applied."""


def as_specs(specs: DataFrame | Iterable) -> list[Spec]:
    """Specs from a planner table or from objects."""
    return [s for _, s in _with_ordinals(specs)]


def _with_ordinals(specs: DataFrame | Iterable) -> list[tuple[int, Spec]]:
    if isinstance(specs, DataFrame):
        specs = specs.orderBy("ordinal").collect()
    out = []
    for i, s in enumerate(specs):
        ordinal = s["ordinal"] if not isinstance(s, Spec) and "ordinal" in s else i + 1
        if not isinstance(s, Spec):
            parameters = s["parameters"] if "parameters" in s else None
            s = Spec(
                s["feature_name"], s["transformation_type"], tuple(s["columns"]), parameters or {}
            )
        out.append((ordinal, s))
    return out


def _unsupported(kind: Column) -> Column:
    return F.concat(F.lit("Unsupported transformation type: "), kind)


def _settled(specs: DataFrame, allowed: tuple[str, ...], target: str | None) -> tuple[DataFrame, DataFrame]:
    """(specs that have to be looked at, log rows of those that their own row rules out).

    A planner proposes three kinds for each pair of columns, two of which the core transforms leave
    out: those stay a table and are never brought together.
    """
    known = F.col("transformation_type").isin(*allowed)
    named = F.lit(False) if target is None else F.col("feature_name") == target
    reason = F.when(~known, _unsupported(F.col("transformation_type"))).otherwise(
        F.lit(f"Feature name '{target}' is the target column.")
    )
    out = specs.where(~known | named).select(
        "ordinal", "feature_name", "transformation_type", "columns", F.lit("skipped").alias("status"),
        reason.alias("reason"), F.lit(None).cast("string").alias("result_column"),
    )
    return specs.where(known & ~named), out


class _Facts:
    """Answers of the data to precondition questions, asked in batches.

    ``ask`` returns a known answer or raises ``KeyError``; unanswered questions
    of all coming specs go into one aggregate.
    """

    def __init__(self, facts: DataFrame | None = None) -> None:
        self.known: dict[tuple[str, str], object] = {}
        for r in [] if facts is None else facts.collect():  # one row per column
            if r.spec_numeric:
                self.known[("negative", r.column_name)] = r["min"] is not None and r["min"] < 0
            if "unique_count" in facts.columns and r.unique_count != 2:
                self.known[("two", r.column_name)] = None

    def forget(self, column: str) -> None:
        for key in [k for k in self.known if k[1] == column]:
            del self.known[key]

    def learn(self, df: DataFrame, questions: list[tuple[str, str]]) -> None:
        simple = [q for q in questions if q[0] == "negative"]
        pairs = [q for q in questions if q[0] == "two"]
        aggregates = [F.count_if(col(c).cast("double") < 0).alias(f"n{i}") for i, (_, c) in enumerate(simple)]
        for i, (_, c) in enumerate(pairs):
            aggregates += [F.min(col(c)).alias(f"lo{i}"), F.max(col(c)).alias(f"hi{i}")]
        if not aggregates:
            return
        row = df.agg(*aggregates).first()
        for i, q in enumerate(simple):
            self.known[q] = row[f"n{i}"] > 0
        if pairs:
            others = df.agg(
                *[
                    F.count_if((col(c) != F.lit(row[f"lo{i}"])) & (col(c) != F.lit(row[f"hi{i}"]))).alias(
                        f"o{i}"
                    )
                    for i, (_, c) in enumerate(pairs)
                ]
            ).first()
            for i, q in enumerate(pairs):
                low, high = row[f"lo{i}"], row[f"hi{i}"]
                self.known[q] = (low, high) if low != high and others[f"o{i}"] == 0 else None


@dataclass
class FeaturePlan:
    """Validated specs as select lists, one per dependency level, and their log.

    ``settled`` are the log rows of specs that were ruled out as a table.
    """

    levels: list[dict[str, Column]]
    lookups: dict[int, list[tuple[str, str, Dictionary]]]
    log_rows: list[tuple]
    original_columns: list[str]
    result_columns: list[str]
    settled: DataFrame | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        out = nan_as_null(df)
        for i, level in enumerate(self.levels):
            out = _select_level(out, level)
            for source, name, table in self.lookups.get(i, []):
                out = _join_rank(out, source, name, table)
        return out

    @property
    def created(self) -> list[str]:
        return [r[1] for r in self.log_rows if r[4] == "applied"]


def _select_level(df: DataFrame, level: dict[str, Column]) -> DataFrame:
    if not level:
        return df
    kept = [level[c].alias(c) if c in level else col(c) for c in df.columns]
    return df.select(*kept, *[e.alias(c) for c, e in level.items() if c not in df.columns])


def _join_rank(df: DataFrame, source: str, name: str, ranks: Dictionary) -> DataFrame:
    """Attach the rank of a value; a missing value has none and takes part in no join."""
    order = df.columns if name in df.columns else [*df.columns, name]
    joined = look_up(df, [Wanted(col(source), ranks, "_rank")])
    return joined.select(*[F.col("_rank").alias(name) if c == name else col(c) for c in order])


def _need(condition: bool, reason: str) -> None:
    if not condition:
        raise Skip(reason)


def _double(name: str, schema: dict[str, T.DataType]) -> Column:
    if isinstance(schema[name], T.BooleanType):
        return col(name).cast("int").cast("double")
    return col(name).cast("double")


def _tidy(value: Column) -> Column:
    """NaN (from infinite inputs) is missing."""
    return F.nullif(value, F.lit(float("nan")))


class _Builder:
    """Turns one spec into a column expression or a skip reason."""

    def __init__(self, schema: dict[str, T.DataType], facts: _Facts) -> None:
        self.schema = schema
        self.facts = facts

    def build(self, spec: Spec) -> tuple[Column | None, T.DataType]:
        return getattr(self, "_" + spec.transformation_type)(spec)

    def _one(self, spec: Spec, numeric: bool = False) -> str:
        kind = spec.transformation_type
        _need(len(spec.columns) == 1, f"{kind} requires exactly one source column.")
        (c,) = spec.columns
        self._exists(c)
        if numeric:
            self._numeric(c)
        return c

    def _exists(self, c: str, role: str = "Source") -> None:
        _need(c in self.schema, f"{role} column '{c}' does not exist.")

    def _numeric(self, c: str, role: str = "Source") -> None:
        _need(ty.is_number_or_bool(self.schema[c]), f"{role} column '{c}' is not numeric.")

    def _typed(self, c: str, kind: type | tuple, word: str) -> None:
        _need(isinstance(self.schema[c], kind), f"Source column '{c}' is not {word}.")

    def _two(self, spec: Spec, roles: tuple[str, str], hint: str = "") -> tuple[Column, Column]:
        _need(
            len(spec.columns) == 2,
            f"{spec.transformation_type} requires exactly two source columns{hint}.",
        )
        for c, role in zip(spec.columns, roles):
            self._exists(c, role)
            self._numeric(c, role)
        a, b = (_double(c, self.schema) for c in spec.columns)
        return a, b

    def _many(self, spec: Spec) -> None:
        kind = spec.transformation_type
        _need(len(spec.columns) >= 2, f"{kind} requires at least two source columns.")

    def _many_numbers(self, spec: Spec) -> list[Column]:
        self._many(spec)
        for c in spec.columns:
            self._exists(c)
            self._numeric(c)
        return [F.coalesce(_double(c, self.schema), F.lit(0.0)) for c in spec.columns]

    def _non_negative(self, c: str, kind: str) -> None:
        _need(
            not self.facts.known[("negative", c)],
            f"Source column '{c}' contains negative values; {kind} requires non-negative data.",
        )

    # -- core ---------------------------------------------------------------

    def _log1p(self, spec):
        c = self._one(spec, numeric=True)
        self._non_negative(c, "log1p")
        return F.log1p(_double(c, self.schema)), T.DoubleType()

    def _ratio(self, spec):
        a, b = self._two(spec, ("numerator", "denominator"), " (numerator, denominator)")
        return _tidy(F.try_divide(a, b)), T.DoubleType()

    def _missing_indicator(self, spec):
        c = self._one(spec)
        return col(c).isNull().cast("bigint"), T.LongType()

    def _count_sum(self, spec):
        terms = self._many_numbers(spec)
        whole = (*ty.INTEGRAL, T.BooleanType)
        if all(isinstance(self.schema[c], whole) for c in spec.columns):
            terms = [F.coalesce(col(c).cast("bigint"), F.lit(0)) for c in spec.columns]
            return reduce(F.try_add, terms), T.LongType()
        return reduce(lambda x, y: x + y, terms), T.DoubleType()

    # -- extended -----------------------------------------------------------

    def _log(self, spec):
        c = self._one(spec, numeric=True)
        x = _double(c, self.schema)
        return F.when(x > 0, F.ln(x)), T.DoubleType()

    def _sqrt(self, spec):
        c = self._one(spec, numeric=True)
        self._non_negative(c, "sqrt")
        return F.sqrt(_double(c, self.schema)), T.DoubleType()

    def _binary_to_int(self, spec):
        c = self._one(spec)
        _need(not ty.is_nested(self.schema[c]), f"Source column '{c}' is nested.")
        values = self.facts.known[("two", c)]
        _need(values is not None, f"Source column '{c}' does not have exactly two values.")
        low, high = values
        return (
            F.when(col(c) == F.lit(low), 0).when(col(c) == F.lit(high), 1).cast("bigint"),
            T.LongType(),
        )

    def _map_values(self, spec):
        c = self._one(spec)
        _need(bool(spec.parameters), "map_values requires a mapping in parameters.")
        pairs = [F.lit(str(x)) for kv in spec.parameters.items() for x in kv]
        mapped = F.try_element_at(F.create_map(*pairs), col(c).cast("string"))
        return mapped, T.StringType()

    def _reduce_categories(self, spec):
        c = self._one(spec)
        _need(not ty.is_nested(self.schema[c]), f"Source column '{c}' is nested.")
        kept = self.facts.known[(f"top{_top_k(spec)}", c)]
        text = col(c).cast("string")
        other = F.when(text.isNotNull(), "Other")
        return (F.when(text.isin(kept), text).otherwise(other) if kept else other), T.StringType()

    def _ordinal_encode(self, spec):
        c = self._one(spec)
        _need(not ty.is_nested(self.schema[c]), f"Source column '{c}' is nested.")
        order = spec.parameters.get("order")
        if order is None:
            return None, T.LongType()
        if isinstance(order, str):
            order = json.loads(order)
        pairs = [x for i, v in enumerate(order) for x in (F.lit(str(v)), F.lit(i).cast("bigint"))]
        return F.try_element_at(F.create_map(*pairs), col(c).cast("string")), T.LongType()

    def _string_length(self, spec):
        c = self._one(spec)
        self._typed(c, T.StringType, "text")
        return F.char_length(col(c)).cast("bigint"), T.LongType()

    def _datetime_extract(self, spec):
        c = self._one(spec)
        self._typed(c, (T.DateType, T.TimestampType, T.TimestampNTZType), "a date or time")
        part = spec.parameters.get("part")
        _need(part in DATE_PARTS, f"Unknown date part '{part}'.")
        return F.extract(F.lit(DATE_PARTS[part]), col(c)).cast("bigint"), T.LongType()

    def _flags(self, spec) -> list[Column]:
        self._many(spec)
        for c in spec.columns:
            self._exists(c)
            self._typed(c, T.BooleanType, "boolean")
        return [col(c) for c in spec.columns]

    def _bool_and(self, spec):
        return reduce(lambda x, y: x & y, self._flags(spec)), T.BooleanType()

    def _bool_or(self, spec):
        return reduce(lambda x, y: x | y, self._flags(spec)), T.BooleanType()

    def _count_nonzero(self, spec):
        terms = [(t != 0).cast("bigint") for t in self._many_numbers(spec)]
        return reduce(lambda x, y: x + y, terms), T.LongType()

    def _sum_squares(self, spec):
        return reduce(lambda x, y: x + y, [t * t for t in self._many_numbers(spec)]), T.DoubleType()

    def _difference(self, spec):
        a, b = self._two(spec, ("Source", "Source"))
        return _tidy(a - b), T.DoubleType()

    def _product(self, spec):
        a, b = self._two(spec, ("Source", "Source"))
        return _tidy(a * b), T.DoubleType()

    _interaction = _product


def _top_k(spec: Spec) -> int:
    return int(spec.parameters.get("top_k", 10))


def _question(spec: Spec, schema: dict[str, T.DataType]) -> tuple[str, str] | None:
    """What the data must answer before ``spec`` can be built."""
    if len(spec.columns) != 1 or spec.columns[0] not in schema:
        return None
    (c,) = spec.columns
    kind, dtype = spec.transformation_type, schema[spec.columns[0]]
    if kind in ("log1p", "sqrt") and ty.is_number_or_bool(dtype):
        return ("negative", c)
    if kind == "binary_to_int" and not ty.is_nested(dtype):
        return ("two", c)
    if kind == "reduce_categories" and not ty.is_nested(dtype):
        return (f"top{_top_k(spec)}", c)
    return None


def _top_values(df: DataFrame, c: str, k: int) -> list[str]:
    """The k most frequent values (ties: smallest first); k rows reach the driver."""
    counts = (
        df.select(col(c).cast("string").alias("v"))
        .where(F.col("v").isNotNull())
        .groupBy("v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return [r.v for r in counts.orderBy(F.col("n").desc(), "v").limit(k).collect()]


def value_ranks(df: DataFrame, c: str) -> Dictionary:
    """The place of each distinct value in sorted order, from 0."""
    values = df.select(col(c).alias("key")).where(F.col("key").isNotNull())
    counted = values.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return Dictionary.measured(places(counted, ["key"], "value"))


def plan_transforms(
    df: DataFrame,
    specs: DataFrame | Iterable,
    transforms: str = "core",
    target: str | None = None,
    facts: DataFrame | None = None,
) -> FeaturePlan:
    """Validate the specs in order against ``df``.

    Later specs may use columns that earlier ones made, and a name that exists
    is overwritten - but never ``target``. ``facts`` (``profile.table_facts`` or
    ``column_facts`` of ``df``) answer preconditions of its columns without asking the data.
    """
    if transforms not in ("core", "extended"):
        raise ValueError("transforms must be 'core' or 'extended'")
    allowed = CORE if transforms == "core" else EXTENDED
    settled = None
    if isinstance(specs, DataFrame):
        specs, settled = _settled(specs, allowed, target)
    numbered = _with_ordinals(specs)
    ordinals, todo = [n for n, _ in numbered], [s for _, s in numbered]
    current = nan_as_null(df)
    schema = {f.name: f.dataType for f in df.schema.fields}
    facts = _Facts(facts)
    plan = FeaturePlan([], {}, [], list(df.columns), list(df.columns), settled)
    pending: dict[str, Column] = {}

    def flush() -> None:
        nonlocal current, pending
        if pending:
            plan.levels.append(pending)
            current = _select_level(current, pending)
            pending = {}

    def answer(place: int) -> None:
        """Make sure the facts for ``todo[place]`` are known."""
        question = _question(todo[place], schema)
        if question is None or question in facts.known:
            return
        if question[1] in pending:
            flush()
        if question[0].startswith("top"):
            facts.known[question] = _top_values(current, question[1], int(question[0][3:]))
            return
        # everything the coming specs will ask about columns that exist by now
        batch, changed = [question], set()
        for later in todo[place:]:
            q = _question(later, schema) if later.transformation_type in allowed else None
            settled = q is not None and q[1] in current.columns and q[1] not in pending
            if settled and q[1] not in changed and q not in facts.known and q not in batch:
                batch.append(q)
            changed.add(later.feature_name)
        facts.learn(current, [q for q in batch if not q[0].startswith("top")])

    for i, spec in enumerate(todo):
        head = (ordinals[i], spec.feature_name, spec.transformation_type, list(spec.columns))
        try:
            _need(
                spec.transformation_type in allowed,
                f"Unsupported transformation type: {spec.transformation_type}",
            )
            _need(
                target is None or spec.feature_name != target,
                f"Feature name '{spec.feature_name}' is the target column.",
            )
            answer(i)
            expression, dtype = _Builder(schema, facts).build(spec)
        except Skip as skip:
            plan.log_rows.append((*head, "skipped", str(skip), None))
            continue
        name = spec.feature_name
        if any(c in pending for c in spec.columns) or name in pending:
            flush()
        if expression is None:  # ordinal_encode by sorted values: a join, its own level
            flush()
            if not plan.levels:
                plan.levels.append({})
            (source,) = spec.columns
            ranks = value_ranks(current, source)
            plan.lookups.setdefault(len(plan.levels) - 1, []).append((source, name, ranks))
            current = _join_rank(current, source, name, ranks)
        else:
            pending[name] = expression
        schema[name] = dtype
        facts.forget(name)
        plan.log_rows.append((*head, "applied", None, name))
    flush()
    plan.result_columns = list(current.columns)
    return plan


def feature_log(df: DataFrame, plan: FeaturePlan) -> DataFrame:
    """One row per spec: applied or skipped, with the reason."""
    log = rows_as_table(df.sparkSession, FEATURE_LOG, plan.log_rows)
    return log if plan.settled is None else log.unionByName(plan.settled)


def feature_lists(log: DataFrame) -> DataFrame:
    """One row: how many specs were applied and skipped, and the names and reasons in order."""
    made = F.col("status") == "applied"
    label = F.concat("feature_name", F.lit(": "), "reason")
    lists = log.agg(
        F.count_if(made).alias("applied"),
        F.count_if(~made).alias("skipped"),
        F.array_sort(F.collect_list(F.when(made, F.struct("ordinal", "feature_name")))).alias("made"),
        F.array_sort(F.collect_list(F.when(~made, F.struct("ordinal", label.alias("text"))))).alias("not_made"),
    )
    return lists.select(
        "applied",
        "skipped",
        F.col("made.feature_name").alias("features_created"),
        F.col("not_made.text").alias("features_skipped"),
    )


def feature_report(log: DataFrame, table: DataFrame, plan: FeaturePlan) -> DataFrame:
    """One row: counts before and after, names, summary. ``table`` has row_count."""
    rows = table.select("row_count").scalar()
    return feature_lists(log).select(
        rows.alias("original_row_count"),
        F.lit(len(plan.original_columns)).cast("bigint").alias("original_column_count"),
        rows.alias("engineered_row_count"),
        F.lit(len(plan.result_columns)).cast("bigint").alias("engineered_column_count"),
        "features_created",
        "features_skipped",
        F.concat(
            F.lit("Applied "), F.col("applied").cast("string"), F.lit(" feature(s) and skipped "),
            F.col("skipped").cast("string"), F.lit(" feature(s)."),
        ).alias("summary"),
    )


def apply_features(
    df: DataFrame,
    specs: DataFrame | Iterable,
    transforms: str = "core",
    target: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(table with the new columns, feature log)."""
    plan = plan_transforms(df, specs, transforms, target)
    return plan.apply(df), feature_log(df, plan)
