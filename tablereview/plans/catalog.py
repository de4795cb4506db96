"""Registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablereview.functions.expressions import col
from tablereview.functions.scratch import scratch_path
from tablereview.operators import compare, explore, metrics, model, planner, prep, quality, suggest
from tablereview.operators import profile as prof
from tablereview.operators import transforms as tr
from tablereview.operators.split import MARK, stratified_split
from tablereview.plans.inputs import Tables
from tablereview.plans.review import run_review
from tablereview.sources.csv import read_csv
from tablereview.sources.sinks import profile_document, write_profile, write_profile_json

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DIGITS = 6
CSV_AS_IS = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}

#: Records of a CSV file: more documents are more files, none of them larger.
CSV_RECORDS = 5_000


def register(function: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[function.__name__] = lambda spark, folder: function(Tables(spark, folder))
    return function


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round doubles, so that the order of summation does not show."""
    return df.select(
        *[F.round(col(n), digits).alias(n) if t == "double" else col(n) for n, t in df.dtypes]
    )


def stacked(parts: dict[str, DataFrame]) -> DataFrame:
    """Results of several tables under one another, with the table name."""
    tagged = [d.select(F.lit(n).alias("table_name"), "*") for n, d in parts.items()]
    return reduce(DataFrame.unionByName, tagged)


# -- profile ------------------------------------------------------------------


@register
def profile_counts(t: Tables) -> DataFrame:
    tables = {
        "lineitem": t.lineitem,
        "line_flags": t.line_flags(),
        "docs_labels": t.docs_labels(),
        "embeddings": t.embeddings,
    }
    return stacked({n: prof.table_profile(d) for n, d in tables.items()})


@register
def profile_missing(t: Tables) -> DataFrame:
    tables = {"docs_labels": t.docs_labels(), "orders_gaps": t.orders_gaps(), "embeddings": t.embeddings}
    return stacked({n: prof.missing_counts(d) for n, d in tables.items()})


@register
def profile_nunique(t: Tables) -> DataFrame:
    tables = {"lineitem": t.lineitem, "docs_labels": t.docs_labels(), "pages": t.pages}
    return stacked({n: prof.distinct_counts(d) for n, d in tables.items()})


@register
def profile_dtypes(t: Tables) -> DataFrame:
    tables = {"lineitem": t.lineitem, "documents": t.documents}
    return stacked(
        {
            n: prof.column_facts(d, medians=False).select("column_name", "data_type", "row_count")
            for n, d in tables.items()
        }
    )


@register
def profile_numeric_stats(t: Tables) -> DataFrame:
    tables = {"lineitem": t.lineitem, "orders_gaps": t.orders_gaps(), "customer": t.customer}
    return stacked({n: rounded(prof.numeric_stats(d)) for n, d in tables.items()})


@register
def profile_mode(t: Tables) -> DataFrame:
    tables = {"docs_labels": t.docs_labels(), "orders": t.orders, "pages": t.pages, "lineitem": t.lineitem}
    return stacked({n: prof.modes(d) for n, d in tables.items()})


@register
def target_distribution(t: Tables) -> DataFrame:
    parts = {
        "docs_labels": prof.target_distribution(t.docs_labels(), "quality"),
        "lineitem": prof.target_distribution(t.lineitem, "l_returnflag"),
    }
    return stacked(parts)


@register
def target_distribution_present(t: Tables) -> DataFrame:
    """Without the missing values of the target."""
    return prof.target_distribution(t.docs_labels(), "quality", missing=False)


@register
def profile_column_summary(t: Tables) -> DataFrame:
    return rounded(prof.planner_profile(t.docs_labels(), "quality")).drop("position")


@register
def profile_excl_target(t: Tables) -> DataFrame:
    return rounded(prof.column_profile(t.lineitem, exclude_target="l_returnflag")).drop("position")


# -- findings -----------------------------------------------------------------


def _findings(df: DataFrame) -> DataFrame:
    return rounded(df.select(*[c for c in df.columns if c != "position"]))


@register
def dq_missing_values(t: Tables) -> DataFrame:
    tables = {"docs_labels": t.docs_labels(), "orders_gaps": t.orders_gaps()}
    return stacked(
        {
            n: _findings(quality.missing_values(prof.column_facts(d, medians=False)))
            for n, d in tables.items()
        }
    )


@register
def dq_duplicate_rows(t: Tables) -> DataFrame:
    tables = {
        "lineitem": t.lineitem,
        "line_flags": t.line_flags(),
        "order_dates": t.orders.select("o_custkey", "o_orderdate"),
        **{f"order_{c}": t.order_repeats().select(c) for c in t.order_repeats().columns},
    }
    return stacked(
        {n: _findings(quality.duplicate_rows(prof.table_profile(d))) for n, d in tables.items()}
    )


def _counted(df: DataFrame) -> DataFrame:
    """Facts and exact distinct counts, without modes."""
    return prof.column_facts(df, medians=False).join(
        F.broadcast(prof.distinct_counts(df)), "column_name"
    )


@register
def dq_high_cardinality(t: Tables) -> DataFrame:
    tables = {
        "lineitem": t.lineitem,
        "documents": t.documents,
        "customer": t.customer,
        "order_repeats": t.order_repeats(),
    }
    return stacked({n: _findings(quality.high_cardinality(_counted(d))) for n, d in tables.items()})


@register
def dq_constant_column(t: Tables) -> DataFrame:
    tables = {"customer_const": t.customer_const(), "lineitem": t.lineitem}
    return stacked({n: _findings(quality.constant_column(_counted(d))) for n, d in tables.items()})


@register
def dq_report(t: Tables) -> DataFrame:
    parts = {}
    for name, df in {"docs_labels": t.docs_labels(), "customer_const": t.customer_const()}.items():
        found = quality.quality_findings(prof.table_profile(df), _counted(df))
        parts[name] = rounded(found.select("ordinal", "issue_type", "severity", "column", "percent"))
    return stacked(parts)


@register
def dq_summary(t: Tables) -> DataFrame:
    parts = {}
    for name, df in {"docs_labels": t.docs_labels(), "flag_sets": t.line_flags().distinct()}.items():
        found = quality.quality_findings(prof.table_profile(df), _counted(df))
        parts[name] = quality.report_summary(found)
    return stacked(parts)


@register
def eda_target_imbalance(t: Tables) -> DataFrame:
    targets = {"labels": "quality", "toxic": "toxic", "lineitem": "l_returnflag"}
    tables = {"labels": t.labels, "toxic": t.labels, "lineitem": t.lineitem}
    shares = t.order_shares()
    targets |= {f"share_{c}": c for c in shares.columns}
    tables |= {f"share_{c}": shares for c in shares.columns}
    parts = {}
    for name, df in tables.items():
        found = explore.target_imbalance(prof.target_distribution(df, targets[name]), targets[name])
        parts[name] = _findings(found.withColumn("columns", F.array_join("columns", ",")))
    return stacked(parts)


def _modes_with_rows(df: DataFrame) -> DataFrame:
    return prof.column_facts(df, medians=False).join(F.broadcast(prof.modes(df)), "column_name")


@register
def eda_dominant_category(t: Tables) -> DataFrame:
    tables = {
        "label_texts": t.label_texts(),
        "customer_const": t.customer_const(),
        "order_shares": t.order_shares(),
    }
    parts = {}
    for name, df in tables.items():
        found = explore.dominant_category(_modes_with_rows(df))
        parts[name] = _findings(found.withColumn("columns", F.array_join("columns", ",")))
    return stacked(parts)


@register
def eda_report(t: Tables) -> DataFrame:
    df = t.label_texts()
    found = explore.explore_findings(
        _modes_with_rows(df), prof.target_distribution(df, "quality"), "quality"
    )
    summary = quality.report_summary(found, explore.NOUN, explore.NONE_FOUND)
    return rounded(
        found.select(
            "ordinal", "finding_type", "importance", F.array_join("columns", ",").alias("columns"), "percent",
            summary.select("summary").scalar().alias("summary"),
        )
    )


# -- planner ------------------------------------------------------------------


def _specs(df: DataFrame) -> DataFrame:
    return df.select(
        "ordinal", "feature_name", "transformation_type", F.array_join("columns", ",").alias("columns")
    )


def _facts(df: DataFrame) -> DataFrame:
    return prof.column_facts(df, medians=False)


@register
def plan_log1p(t: Tables) -> DataFrame:
    parts = {
        "customer": planner.plan_log1p(_facts(t.customer), "c_mktsegment"),
        "lineitem": planner.plan_log1p(_facts(t.lineitem), "l_returnflag"),
    }
    return stacked({n: _specs(d) for n, d in parts.items()})


@register
def plan_pairs(t: Tables) -> DataFrame:
    parts = {
        "customer": planner.plan_pairs(_facts(t.customer), "c_mktsegment"),
        "lineitem": planner.plan_pairs(_facts(t.lineitem), "l_returnflag"),
        "events": planner.plan_pairs(_facts(t.events), "event_type"),
    }
    return stacked({n: _specs(d) for n, d in parts.items()})


@register
def plan_missing_indicator(t: Tables) -> DataFrame:
    return _specs(planner.plan_missing_indicator(_facts(t.docs_labels()), "quality"))


@register
def plan_full(t: Tables) -> DataFrame:
    return _specs(planner.plan_features(_facts(t.docs_labels()), "quality"))


@register
def plan_supplied(t: Tables) -> DataFrame:
    """Planned specs, then those of a supplied response that can be used."""
    df = t.docs_labels()
    supplied = suggest.parse_specs(t.label_specs(), df.columns)
    return _specs(planner.append_specs(planner.plan_features(_facts(df), "quality"), supplied))


@register
def plan_default(t: Tables) -> DataFrame:
    return _specs(planner.plan_simple(_facts(t.docs_labels()), "quality"))


# -- transforms ---------------------------------------------------------------


def spec(name: str, kind: str, *columns: str, **parameters) -> tr.Spec:
    return tr.Spec(name, kind, columns, parameters)


def _applied(df: DataFrame, *specs: tr.Spec, transforms: str = "core") -> DataFrame:
    return rounded(tr.apply_features(df, list(specs), transforms)[0])


def _extended(df: DataFrame, *specs: tr.Spec) -> DataFrame:
    return _applied(df, *specs, transforms="extended")


@register
def fe_log1p(t: Tables) -> DataFrame:
    df = t.lineitem.select("l_orderkey", "l_extendedprice", "l_discount")
    return _applied(
        df,
        spec("log1p_price", "log1p", "l_extendedprice"),
        spec("log1p_discount", "log1p", "l_discount"),
    )


@register
def fe_ratio(t: Tables) -> DataFrame:
    df = t.lineitem.select("l_orderkey", "l_tax", "l_discount")
    return _applied(df, spec("r", "ratio", "l_tax", "l_discount"))


@register
def fe_missing_indicator(t: Tables) -> DataFrame:
    df = t.orders_gaps()
    return _applied(
        df,
        spec("price_is_missing", "missing_indicator", "o_totalprice"),
        spec("priority_is_missing", "missing_indicator", "o_orderpriority"),
    )


@register
def fe_count_sum(t: Tables) -> DataFrame:
    df = t.docs_labels().select("doc_id", "n_chars", "quality", "toxic")
    return _applied(
        df,
        spec("flags", "count_sum", "quality", "toxic"),
        spec("all_of_it", "count_sum", "n_chars", "quality", "toxic"),
    )


@register
def fe_chain(t: Tables) -> DataFrame:
    df = t.lineitem.select("l_orderkey", "l_quantity", "l_tax", "l_discount")
    return _applied(
        df,
        spec("log_qty", "log1p", "l_quantity"),
        spec("r", "ratio", "log_qty", "l_tax"),
        spec("l_tax", "log1p", "l_tax"),
        spec("r2", "ratio", "l_tax", "log_qty"),
        spec("s", "count_sum", "r", "r2"),
        spec("log_s", "log1p", "s"),
    )


@register
def fe_log(t: Tables) -> DataFrame:
    parts = {}
    for name, df, target in (
        ("customer", t.customer, "c_mktsegment"),
        ("docs_labels", t.docs_labels(), "quality"),
    ):
        specs = tr.as_specs(planner.plan_features(_facts(df), target))
        specs.append(spec("log1p_acct", "log1p", "c_acctbal"))
        specs.append(spec(target, "missing_indicator", target))
        _, log = tr.apply_features(df, specs, target=target)
        parts[name] = log.drop("columns", "result_column")
    return stacked(parts)


@register
def fe_report(t: Tables) -> DataFrame:
    df = t.docs_labels()
    plan = tr.plan_transforms(df, planner.plan_features(_facts(df), "quality"))
    report = tr.feature_report(tr.feature_log(df, plan), prof.table_profile(df), plan)
    return report.select(
        *[
            F.array_join(col(c), "|").alias(c) if c.startswith("features_") else col(c)
            for c in report.columns
        ]
    )


@register
def fx_log(t: Tables) -> DataFrame:
    return _extended(t.customer.select("c_custkey", "c_acctbal"), spec("f", "log", "c_acctbal"))


@register
def fx_sqrt(t: Tables) -> DataFrame:
    return _extended(
        t.customer.select("c_custkey", "c_nationkey", "c_acctbal"),
        spec("f", "sqrt", "c_nationkey"),
        spec("g", "sqrt", "c_acctbal"),
    )


@register
def fx_binary_to_int(t: Tables) -> DataFrame:
    df = t.lineitem.select("l_orderkey", "l_linestatus", "l_returnflag")
    return _extended(
        df, spec("f", "binary_to_int", "l_linestatus"), spec("g", "binary_to_int", "l_returnflag")
    )


@register
def fx_map_values(t: Tables) -> DataFrame:
    df = t.orders.select("o_orderkey", "o_orderstatus")
    return _extended(df, spec("f", "map_values", "o_orderstatus", F="final", O="open"))


@register
def fx_reduce_categories(t: Tables) -> DataFrame:
    df = t.part.select("p_partkey", "p_brand", "p_type")
    return _extended(
        df,
        spec("f", "reduce_categories", "p_brand", top_k=5),
        spec("g", "reduce_categories", "p_type", top_k=2),
    )


@register
def fx_ordinal_encode(t: Tables) -> DataFrame:
    df = t.customer.select("c_custkey", "c_mktsegment", "c_name")
    order = ["MACHINERY", "BUILDING"]
    return _extended(
        df,
        spec("f", "ordinal_encode", "c_mktsegment"),
        spec("g", "ordinal_encode", "c_name"),
        spec("h", "ordinal_encode", "c_mktsegment", order=order),
    )


@register
def fx_string_length(t: Tables) -> DataFrame:
    made = tr.apply_features(
        t.documents.select("doc_id", "text"), [spec("f", "string_length", "text")], "extended"
    )[0]
    return made.drop("text")


@register
def fx_datetime_extract(t: Tables) -> DataFrame:
    df = t.orders.select("o_orderkey", "o_orderdate")
    parts = [spec(p, "datetime_extract", "o_orderdate", part=p) for p in tr.DATE_PARTS]
    return _extended(df, *parts).drop("o_orderdate")


def _line_bools(t: Tables) -> DataFrame:
    return t.lineitem.select(
        "l_orderkey",
        (F.col("l_quantity") > 25).alias("a"),
        F.when(F.col("l_discount") > 0, F.col("l_tax") > 0.04).alias("b"),
    )


@register
def fx_bool_and(t: Tables) -> DataFrame:
    return _extended(_line_bools(t), spec("f", "bool_and", "a", "b"))


@register
def fx_bool_or(t: Tables) -> DataFrame:
    return _extended(_line_bools(t), spec("f", "bool_or", "a", "b"))


@register
def fx_count_nonzero(t: Tables) -> DataFrame:
    df = t.lineitem.select("l_orderkey", "l_discount", "l_tax")
    return _extended(df, spec("f", "count_nonzero", "l_discount", "l_tax"))


@register
def fx_sum_squares(t: Tables) -> DataFrame:
    df = t.lineitem.select("l_orderkey", "l_discount", "l_tax")
    return _extended(df, spec("f", "sum_squares", "l_discount", "l_tax"))


@register
def fx_difference(t: Tables) -> DataFrame:
    df = t.orders_gaps().select("o_orderkey", "o_totalprice", "o_custkey")
    return _extended(df, spec("f", "difference", "o_totalprice", "o_custkey"))


@register
def fx_product(t: Tables) -> DataFrame:
    df = t.lineitem.select("l_orderkey", "l_quantity", "l_discount")
    return _extended(df, spec("f", "product", "l_quantity", "l_discount"))


@register
def fx_interaction(t: Tables) -> DataFrame:
    df = t.lineitem.select("l_orderkey", "l_quantity", "l_tax")
    return _extended(df, spec("f", "interaction", "l_quantity", "l_tax"))


# -- split and preparation ----------------------------------------------------

def _is_test() -> F.Column:
    return F.col(MARK).alias("is_test")


@register
def split_stratified(t: Tables) -> DataFrame:
    split = stratified_split(t.orders, "o_orderstatus", key="o_orderkey")
    return split.rows.select("o_orderkey", "o_orderstatus", _is_test())


@register
def split_keyless(t: Tables) -> DataFrame:
    """Without a key: rows per class and side, and whether each frequent row is on both."""
    rows = stratified_split(t.line_flags(), "l_returnflag").rows
    per_row = rows.groupBy("l_returnflag", "l_linestatus", "l_quantity").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(MARK).alias("test")
    )
    frequent = F.col("n") >= 60
    return per_row.groupBy("l_returnflag").agg(
        F.sum("n").alias("rows"),
        F.sum("test").alias("test_rows"),
        F.count_if(frequent).alias("frequent"),
        F.count_if(frequent & F.col("test").between(1, F.col("n") - 1)).alias("on_both_sides"),
    )


def _order_split(t: Tables):
    split = stratified_split(t.orders_gaps(), "o_orderstatus", key="o_orderkey")
    return split, prep.fit_prep(split.train, ["o_totalprice", "o_orderpriority", "o_custkey"])


@register
def impute_median(t: Tables) -> DataFrame:
    split, fitted = _order_split(t)
    return rounded(fitted.impute(split.rows).select("o_orderkey", _is_test(), "o_totalprice"))


@register
def impute_mode(t: Tables) -> DataFrame:
    split, fitted = _order_split(t)
    return fitted.impute(split.rows).select("o_orderkey", _is_test(), "o_orderpriority")


@register
def standard_scale(t: Tables) -> DataFrame:
    split, fitted = _order_split(t)
    return rounded(fitted.scale(split.rows).select("o_orderkey", _is_test(), "o_totalprice", "o_custkey"))


@register
def one_hot_wide(t: Tables) -> DataFrame:
    """The slot of a text column with a level for each row of the train side."""
    df = t.orders_gaps().withColumn("name", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")))
    split = stratified_split(df, "o_orderstatus", key="o_orderkey")
    fitted = prep.fit_prep(split.train, ["name"])
    return fitted.slots(split.rows, [F.col("o_orderkey")]).select(
        "o_orderkey", F.lit(fitted.width).cast("bigint").alias("slots"), F.col("s0").alias("hot_slot")
    )


@register
def one_hot(t: Tables) -> DataFrame:
    """Which slot of the encoded priority is hot; NULL when none is."""
    from pyspark.ml.functions import vector_to_array

    split = stratified_split(t.orders_gaps(), "o_orderstatus", key="o_orderkey")
    # the train side lacks one level, so that test rows hold an unseen one
    train = split.train.where(~F.col("o_orderpriority").eqNullSafe("1-URGENT"))
    fitted = prep.fit_prep(train, ["o_orderpriority"])
    hot = vector_to_array("h0")
    encoded = fitted.encode(split.rows, [F.col("o_orderkey")])
    place = F.nullif(F.array_position(hot, 1.0), F.lit(0)) - 1
    return encoded.select(
        "o_orderkey",
        F.size(hot).cast("bigint").alias("slots"),
        place.cast("bigint").alias("hot_slot"),
    )


# -- model --------------------------------------------------------------------


def _doc_model(t: Tables) -> tuple:
    df = t.labelled_docs()
    split = stratified_split(df, "quality", key="doc_id").stored()
    fitted = prep.fit_prep(split.train, model.feature_columns(df.columns, "quality"))
    return split, model.fit_predict(split, "quality", fitted, keep=(F.col("doc_id"),))


def _features(t: Tables, known: prep.Prep) -> DataFrame:
    """(feature, place): the text of each number and level, and its place in the features."""
    rows = [(n.name, i) for i, n in enumerate(known.numbers)]
    numbers = tr.rows_as_table(t.spark, "feature string, place int", rows)
    if not known.texts:
        return numbers
    starts = [(x.id, f"{x.name}=", start) for x, start in zip(known.texts, known.starts)]
    texts = tr.rows_as_table(t.spark, "c string, name string, start int", starts)
    levels = known.levels.join(texts, "c")
    place = (F.col("start") + F.col("slot")).cast("int").alias("place")
    return numbers.unionAll(levels.select(F.concat("name", "key").alias("feature"), place))


def _coefficients(t: Tables, fitted: model.Fitted) -> DataFrame:
    """(feature, coefficient), the intercept among them."""
    named = _features(t, fitted.prep).join(fitted.coefficients, "place")
    last = [("(intercept)", fitted.intercept)]
    return named.select("feature", F.col("weight").alias("coefficient")).unionAll(
        tr.rows_as_table(t.spark, "feature string, coefficient double", last)
    )


@register
def model_fit(t: Tables) -> DataFrame:
    """Coefficients by feature slot, and the intercept."""
    return _coefficients(t, _doc_model(t)[1])


@register
def model_gradient(t: Tables) -> DataFrame:
    """Slope of the penalised loss at the fitted coefficients, relative to what the rows hold of
    each feature (for a level: to its number of rows): zero at the optimum."""
    split, fitted = _doc_model(t)
    rows = model.class_label("quality", split.classes, split.rows)
    train = fitted.scored(rows.where(~F.col(MARK)), [F.col("_label").alias("label")], entries=True)
    one = F.struct(F.lit(fitted.prep.width).alias("place"), F.lit(1.0).alias("value"))
    scored = train.select(
        (F.col("score") - F.col("label")).alias("miss"),
        F.explode(F.array_append("entries", one)).alias("x"),
    )
    sums = scored.groupBy(F.col("x.place").alias("place")).agg(
        F.sum(F.col("miss") * F.col("x.value")).alias("sum"), F.sum(F.abs("x.value")).alias("held")
    )
    last = (fitted.prep.width, "(intercept)", 0.0)
    places = (
        _features(t, fitted.prep)
        .join(fitted.coefficients, "place")
        .select("place", "feature", "weight")
        .unionAll(tr.rows_as_table(t.spark, "place int, feature string, weight double", [last]))
    )
    slope = (F.col("sum") + F.col("weight")) / F.col("held")
    return places.join(sums, "place").select("feature", (F.round(slope, 4) + 0.0).alias("gradient"))


@register
def model_two_levels(t: Tables) -> DataFrame:
    """Coefficients of a model with one text column of two levels: SQL can find their optimum."""
    level = F.concat(F.lit("toxic "), F.col("toxic").cast("string")).alias("level")
    df = t.labels.select("doc_id", "quality", level)
    split = stratified_split(df, "quality", key="doc_id").stored()
    fitted = model.fit_predict(split, "quality", prep.fit_prep(split.train, ["level"]))
    return _coefficients(t, fitted).select("feature", F.round("coefficient", 4).alias("coefficient"))


@register
def model_test_rows(t: Tables) -> DataFrame:
    return _doc_model(t)[1].predictions.select("doc_id", "label")


@register
def model_predict(t: Tables) -> DataFrame:
    return _doc_model(t)[1].predictions


@register
def model_report(t: Tables) -> DataFrame:
    return stacked(
        {
            "labelled_docs": model.model_report(t.labelled_docs(), "quality", key="doc_id"),
            "lineitem": model.model_report(t.lineitem, "l_returnflag"),
        }
    )


@register
def model_report_separable(t: Tables) -> DataFrame:
    return rounded(model.model_report(t.separable_docs(), "quality", key="doc_id"))


@register
def compare_models(t: Tables) -> DataFrame:
    facts = _facts(t.lineitem)
    specs = planner.plan_features(facts, "l_linestatus")
    return compare.compare_models(t.lineitem, "l_linestatus", specs, facts=facts).metrics


@register
def review_result(t: Tables) -> DataFrame:
    return run_review(t.spark, t.labelled_docs(), "quality", planner.plan_features).result()


@register
def compare_separable(t: Tables) -> DataFrame:
    df = t.separable_docs()
    specs = planner.plan_features(_facts(df), "quality")
    result = compare.compare_models(df, "quality", specs, key="doc_id").result
    return rounded(_joined_lists(result, "features_created", "features_skipped"))


@register
def review_separable(t: Tables) -> DataFrame:
    review = run_review(t.spark, t.separable_docs(), "quality", planner.plan_features, key="doc_id")
    lists = ("features_created", "features_skipped", "accepted_features", "reasons")
    return _joined_lists(review.result(), *lists).select(
        "target_column", "row_count", "column_count", "quality_issues", "eda_findings", "decision",
        *lists, "review_summary",
    )


def _joined_lists(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.array_join(n, "|") for n in names})


# -- metrics and decisions ----------------------------------------------------


@register
def metric_accuracy(t: Tables) -> DataFrame:
    found = metrics.class_metrics(t.line_predictions(), ("l_suppkey",))
    return rounded(found.select("l_suppkey", "accuracy", "rows"))


@register
def metric_weighted_f1(t: Tables) -> DataFrame:
    found = metrics.class_metrics(t.flag_predictions(), ("l_suppkey",))
    return rounded(found.select("l_suppkey", "f1_score"))


@register
def metric_roc_auc(t: Tables) -> DataFrame:
    rows = t.line_predictions()
    whole = metrics.roc_auc(rows, F.col("label") == 1.0).select(
        F.lit(None).cast("bigint").alias("l_suppkey"), "roc_auc"
    )
    return rounded(
        metrics.roc_auc(rows, F.col("label") == 1.0, ("l_suppkey",)).unionByName(whole)
    )


def _part_results(t: Tables, digits: int = 15) -> DataFrame:
    measured = model.evaluate(t.part_experiments(), 2, ("experiment", "variant"))
    pairs = rounded(compare.pair_variants(measured), digits)
    return compare.deltas(pairs.join(t.part_features(), "experiment"))


@register
def compare_deltas(t: Tables) -> DataFrame:
    result = _part_results(t)
    return rounded(result.drop("features_created", "features_skipped", "summary"))


@register
def decision_rules(t: Tables) -> DataFrame:
    """Decisions on changes rounded to twelve digits, so that equal means equal."""
    changes = ("accuracy_change", "f1_change", "roc_auc_change")
    steady = _part_results(t).withColumns({c: F.round(c, 12) for c in changes})
    decided = compare.decide(steady.withColumn("improved", F.col("f1_change") > 0))
    return decided.select(
        "experiment",
        "decision",
        F.array_join("accepted_features", "|").alias("accepted_features"),
        F.array_join("rejected_features", "|").alias("rejected_features"),
        F.size("reasons").cast("bigint").alias("reason_count"),
        "performance_improved",
        "leakage_warning",
    )


@register
def comparison_texts(t: Tables) -> DataFrame:
    """Summaries and reasons; metrics are rounded first, so that equal means equal."""
    decided = compare.decide(_part_results(t, 12))
    return decided.select(
        "experiment", "summary", F.array_join("reasons", "|").alias("reasons"), "decision_summary"
    )


# -- suggestions --------------------------------------------------------------


@register
def suggest_extract_json(t: Tables) -> DataFrame:
    return suggest.extract_json(t.fenced_responses()).select("conv_id", "turn", "json_text")


_TURN = ("conv_id", "turn")


@register
def findings_merge(t: Tables) -> DataFrame:
    merged, _ = suggest.merge_findings(
        quality.missing_values(t.turn_rules(), keep=_TURN).withColumn("ordinal", F.lit(1)),
        t.finding_responses(),
        "quality",
        keys=_TURN,
    )
    return merged.select(
        *_TURN, "ordinal", "origin", "issue_type", "severity", "column", F.md5("evidence").alias("evidence_md5")
    )


@register
def findings_merge_summary(t: Tables) -> DataFrame:
    _, summary = suggest.merge_findings(
        quality.missing_values(t.turn_rules(), keep=_TURN).withColumn("ordinal", F.lit(1)),
        t.finding_responses(),
        "quality",
        keys=_TURN,
    )
    return summary


def _explore_merged(t: Tables) -> tuple[DataFrame, DataFrame]:
    df = t.label_texts()
    found = explore.explore_findings(
        _modes_with_rows(df), prof.target_distribution(df, "quality"), "quality"
    )
    return suggest.merge_findings(found, t.label_responses(), "explore")


@register
def findings_merge_explore(t: Tables) -> DataFrame:
    """Exploratory findings of the labels, then one of a supplied response."""
    merged, _ = _explore_merged(t)
    return merged.select(
        "ordinal", "origin", "finding_type", "importance", F.array_join("columns", ",").alias("columns"),
        F.md5("evidence").alias("evidence_md5"), "modeling_implication",
    )


@register
def findings_merge_explore_summary(t: Tables) -> DataFrame:
    return _explore_merged(t)[1]


@register
def suggest_specs(t: Tables) -> DataFrame:
    specs = suggest.parse_specs(t.spec_responses(), t.events.columns, keys=("event_id",))
    return specs.select(
        "event_id", "ordinal", "feature_name", "transformation_type", F.array_join("columns", ",").alias("columns")
    )


# -- sources and sinks --------------------------------------------------------


@register
def source_csv(t: Tables) -> DataFrame:
    """Orders with gaps out to CSV and back, types inferred."""
    path = scratch_path(t.spark, "csv")
    orders = t.orders_gaps().withColumn("wide", F.col("o_custkey") % 2 == 0)
    orders.write.options(**CSV_AS_IS).csv(path)
    return read_csv(t.spark, path)


@register
def source_csv_text(t: Tables) -> DataFrame:
    """Whole texts with quoted line breaks and quotes survive the CSV reader; some files have none."""
    path = scratch_path(t.spark, "csv")
    broken = F.coalesce(F.col("text").contains("\n"), F.lit(False))
    for rows in (t.documents.where(broken), t.documents.where(~broken)):
        # a file with line breaks is read whole by one task
        rows.write.options(**CSV_AS_IS, maxRecordsPerFile=CSV_RECORDS).mode("append").csv(path)
    back = read_csv(t.spark, path)
    return back.withColumn("text", F.md5("text"))


@register
def sink_profile_json(t: Tables) -> DataFrame:
    """Write a profile as JSON, read it back, pick some numbers."""
    df = t.line_flags()
    document = profile_document(
        prof.table_profile(df),
        prof.column_profile(df),
        "l_returnflag",
        prof.target_distribution(df, "l_returnflag"),
    )
    path = write_profile_json(document, scratch_path(t.spark, "profile"))
    text = t.spark.read.text(path, wholetext=True)

    def pick(where: str, kind: str) -> F.Column:
        return F.get_json_object("value", f"$.{where}").cast(kind)

    return text.select(
        pick("row_count", "bigint").alias("row_count"),
        pick("column_count", "bigint").alias("column_count"),
        pick("duplicate_row_count", "bigint").alias("duplicate_row_count"),
        pick("unique_values_by_column.l_quantity", "bigint").alias("quantities"),
        pick("numeric_statistics.l_quantity.median", "double").alias("median_quantity"),
        pick("categorical_statistics.l_linestatus.most_frequent_value", "string").alias("top_status"),
        pick("target_distribution.R", "bigint").alias("returned"),
    )


@register
def sink_profile_rows(t: Tables) -> DataFrame:
    """A profile with a target of as many values as rows, written as a document and rows."""
    df = t.orders
    document = profile_document(prof.table_profile(df), prof.column_profile(df), "o_orderkey")
    path = write_profile(
        document, prof.target_distribution(df, "o_orderkey"), scratch_path(t.spark, "profile")
    )
    count = F.get_json_object("value", "$.row_count").cast("bigint").alias("row_count")
    written = t.spark.read.text(f"{path}/profile", wholetext=True).select(count)
    rows = t.spark.read.schema("target_value string, n bigint").json(f"{path}/target_distribution")
    return rows.select("*", written.scalar().alias("row_count"))
