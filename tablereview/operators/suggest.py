"""Suggestions from outside: a table of response texts, checked and merged.

Each response is judged as a whole: one wrong field and none of its findings or
specs is used. Field types are checked on parsed values, so that a number where
text is due is not silently turned into text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablereview.functions.expressions import strip_text
from tablereview.operators import explore, quality
from tablereview.operators.transforms import EXTENDED

# Note on a response that cannot be used, names of specs.
NOTE = (
    "LLM reasoning was requested but the response could not be "
    "validated. Deterministic findings are preserved."
)
SPEC_TYPES = tuple(t for t in EXTENDED if t != "interaction")
FENCE = "```"
LANGUAGES = ("json", "javascript", "js")


def is_json(text: Column) -> Column:
    """Exactly one JSON value and nothing else.

    The parser stops after the first value. Whatever closes the array early does
    not fit into the object, and the other way round, so both must hold.
    """
    strict = {"allowSingleQuotes": "false"}
    inside = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", strict)
    field = F.from_json(
        F.concat(F.lit('{"v":'), text, F.lit("}")), "v string, _corrupt_record string", strict
    )
    return F.coalesce((F.size(inside) == 1) & field["_corrupt_record"].isNull(), F.lit(False))


def json_text(text: Column) -> Column:
    """The JSON inside a response text, between the outer code fences if any;
    NULL when there is none."""
    trimmed = strip_text(text)
    first = F.instr(trimmed, FENCE)
    last = F.char_length(trimmed) - F.instr(F.reverse(trimmed), FENCE) - 1
    inner = strip_text(
        F.substring(trimmed, first + 3, F.greatest(last - first - 3, F.lit(0)))
    )
    line = F.instr(inner, "\n")
    head = F.lower(strip_text(F.substring(inner, F.lit(1), F.greatest(line - 1, F.lit(0)))))
    body = F.when(
        (line > 0) & head.isin(*LANGUAGES), strip_text(F.substring(inner, line + 1, F.char_length(inner)))
    ).otherwise(inner)
    content = F.when((first > 0) & (last > first), body).otherwise(trimmed)
    return F.when(is_json(content), content)


def extract_json(responses: DataFrame, text: str = "response") -> DataFrame:
    """Add ``json_text``."""
    return responses.withColumn("json_text", json_text(F.col(text)))


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value) == kind, F.lit(False))


def _text(value: Column) -> Column:
    return _is(value, "STRING")


def _text_or_null(value: Column) -> Column:
    return value.isNull() | _is(value, "VOID") | _text(value)


def _texts(value: Column) -> Column:
    """An array of texts (an empty one too)."""
    items = F.try_variant_get(value, "$", "array<variant>")
    return F.coalesce(F.forall(items, _text), F.lit(False))


def _object_or_null(value: Column) -> Column:
    return (
        value.isNull()
        | _is(value, "VOID")
        | F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    )


def _string(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


_QUALITY = {
    "issue_type": _text,
    "severity": _text,
    "column": _text_or_null,
    "evidence": _text,
    "recommendation": _text,
}
_EXPLORE = {
    "finding_type": _text,
    "importance": _text,
    "columns": _texts,
    "evidence": _text,
    "interpretation": _text,
    "modeling_implication": _text_or_null,
}
_SPECS = {
    "feature_name": _text,
    "transformation_type": _text,
    "columns": _texts,
    "parameters": _object_or_null,
}


def _checked(responses: DataFrame, text: str, items: str, fields: dict, needs_summary: bool) -> DataFrame:
    """Add ``parsed`` (NULL when unusable) and ``valid``."""
    members = ", ".join(f"{name} variant" for name in fields)
    schema = f"{items} array<struct<{members}>>, summary variant"
    parsed = F.from_json(F.when(is_json(F.col(text)), F.col(text)), schema)
    table = responses.withColumn("parsed", parsed)

    def good(item: Column) -> Column:
        checks = [check(item[name]) for name, check in fields.items()]
        out = item.isNotNull()
        for check in checks:
            out = out & check
        return out

    summary = F.col("parsed.summary")
    tail = _text(summary) if needs_summary else summary.isNull() | _text(summary)
    valid = F.forall(F.col(f"parsed.{items}"), good) & tail
    return table.withColumn("valid", F.coalesce(valid, F.lit(False)))


def _value(item: str, name: str, check) -> Column:
    raw = F.col(f"{item}.{name}")
    if check is _texts:
        return F.try_variant_get(raw, "$", "array<string>").alias(name)
    if check is _object_or_null:
        return F.try_variant_get(raw, "$", "map<string,string>").alias(name)
    return _string(raw).alias(name)


def _parse(responses, text, keys, items, fields, needs_summary) -> DataFrame:
    checked = _checked(responses, text, items, fields, needs_summary)
    exploded = checked.where("valid").select(*keys, F.posexplode(f"parsed.{items}").alias("_i", "_x"))
    return exploded.select(
        *keys,
        (F.col("_i") + 1).alias("ordinal"),
        *[_value("_x", name, check) for name, check in fields.items()],
    )


def validity(responses: DataFrame, kind: str, text: str = "response") -> DataFrame:
    """Add ``valid``: the response is a usable report of findings."""
    fields = _QUALITY if kind == "quality" else _EXPLORE
    return _checked(responses, text, "findings", fields, True).drop("parsed")


def parse_findings(
    responses: DataFrame, kind: str, text: str = "response", keys: tuple[str, ...] = ()
) -> DataFrame:
    """Findings of all valid responses: keys, ordinal within the response, fields."""
    fields = _QUALITY if kind == "quality" else _EXPLORE
    return _parse(responses, text, keys, "findings", fields, True)


def merge_findings(
    findings: DataFrame,
    responses: DataFrame,
    kind: str,
    text: str = "response",
    keys: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """(merged findings, report summary) per review.

    ``keys`` names the columns that identify a review in both tables; each review
    has one response. Deterministic findings come first; a response that fails
    the check adds a note to the summary instead.
    """
    names = quality.FINDING_COLUMNS if kind == "quality" else explore.FINDING_COLUMNS
    noun = quality.NOUN if kind == "quality" else explore.NOUN
    none_found = quality.NONE_FOUND if kind == "quality" else explore.NONE_FOUND
    supplied = parse_findings(responses, kind, text, keys)
    both = findings.select(*keys, F.lit(0).alias("_s"), "ordinal", *names).unionByName(
        supplied.select(*keys, F.lit(1).alias("_s"), "ordinal", *names)
    )
    known = F.count_if(F.col("_s") == 0).over(Window.partitionBy(*keys))
    # deterministic ordinals run from 1, so supplied ones continue after them
    place = F.when(F.col("_s") == 0, F.col("ordinal")).otherwise(F.col("ordinal") + known)
    merged = both.select(
        *keys,
        place.cast("int").alias("ordinal"),
        F.when(F.col("_s") == 0, "deterministic").otherwise("supplied").alias("origin"),
        *names,
    )
    counted = merged.groupBy(*keys).agg(F.count(F.lit(1)).alias("finding_count"))
    judged = validity(responses, kind, text).select(*keys, "valid")
    if keys:
        rows = judged.join(counted, list(keys), "full_outer")
    else:
        rows = counted.withColumn("valid", judged.scalar())
    n = F.coalesce("finding_count", F.lit(0))
    some = F.concat(n.cast("string"), F.lit(f" {noun} detected."))
    failed = F.coalesce(~F.col("valid"), F.lit(False))
    summary = (
        F.when(failed & (n > 0), F.concat(some, F.lit(f" {NOTE}")))
        .when(failed, NOTE)
        .when(n > 0, some)
        .otherwise(none_found)
    )
    return merged, rows.select(*keys, n.alias("finding_count"), summary.alias("summary"))


def parse_specs(
    responses: DataFrame,
    columns: list[str],
    text: str = "response",
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """Usable feature specs of all valid responses.

    Dropped: types outside the vocabulary, empty column lists and columns that
    the table does not have. Specs that read the target are kept.
    """
    specs = _parse(responses, text, keys, "specs", _SPECS, False)
    allowed = F.array(*[F.lit(c) for c in columns])
    return specs.where(
        F.col("transformation_type").isin(*SPEC_TYPES)
        & (F.size("columns") > 0)
        & (F.size(F.array_except("columns", allowed)) == 0)
    )
