"""Tables the registered queries run on: given ones and simple derivations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablereview.operators import suggest


class Tables:
    """Tables of one folder by name; derived ones are methods."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def docs_labels(self) -> DataFrame:
        """Documents with labels where there are any: missing values."""
        return self.documents.join(self.labels, "doc_id", "left")

    def labelled_docs(self) -> DataFrame:
        """Labelled documents, text included: a model table."""
        return self.documents.join(self.labels, "doc_id")

    def separable_docs(self) -> DataFrame:
        """Labelled documents, text included, with a column that tells the class."""
        judged = F.concat(F.lit("class "), F.col("quality").cast("string")).alias("judged")
        return self.documents.join(self.labels, "doc_id").select("*", judged)

    def line_flags(self) -> DataFrame:
        """Three columns of lineitem: duplicate rows."""
        return self.lineitem.select("l_returnflag", "l_linestatus", "l_quantity")

    def orders_gaps(self) -> DataFrame:
        """Orders with missing priorities and prices."""
        return self.orders.select(
            "o_orderkey",
            "o_custkey",
            "o_orderstatus",
            F.when(F.col("o_totalprice") >= 5000, F.col("o_totalprice")).alias("o_totalprice"),
            F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"),
        )

    def customer_const(self) -> DataFrame:
        """Customers with a constant column."""
        return self.customer.withColumn("k", F.lit("x"))

    def label_texts(self) -> DataFrame:
        """Labels with both labels as text: dominant categories."""
        return self.labels.select(
            "doc_id", F.col("quality").cast("string").alias("quality"),
            F.col("toxic").cast("string").alias("toxic"),
        )

    def order_shares(self) -> DataFrame:
        """Texts whose top value has a share on either side of each limit."""
        limits = {"even": 50, "two_thirds": 66, "most": 85, "nine_tenths": 93, "nearly_all": 97}
        place = F.col("o_orderkey") % 100
        return self.orders.select(
            *[F.when(place < k, "a").otherwise("b").alias(c) for c, k in limits.items()]
        )

    def order_repeats(self) -> DataFrame:
        """Order keys, some of them replaced by one value: nearly unique columns."""
        place = F.col("o_orderkey") % 100
        return self.orders.select(
            *[
                F.when(place < k, -1).otherwise(F.col("o_orderkey")).alias(c)
                for c, k in {"few": 1, "several": 4, "many": 20}.items()
            ]
        )

    def line_predictions(self) -> DataFrame:
        """Lineitem read as predictions: label, score, prediction per supplier."""
        score = F.col("l_quantity") / 50
        return self.lineitem.select(
            "l_suppkey",
            F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("label"),
            score.alias("score"),
            F.when(score >= 0.7, 1.0).otherwise(0.0).alias("prediction"),
        )

    def flag_predictions(self) -> DataFrame:
        """Three classes: the return flag, guessed from quantity."""
        guess = (
            F.when(F.col("l_quantity") < 10, "A").when(F.col("l_quantity") < 30, "N").otherwise("R")
        )
        return self.lineitem.select(
            "l_suppkey", F.col("l_returnflag").alias("label"), guess.alias("prediction")
        )

    def part_experiments(self) -> DataFrame:
        """Predictions of two variants per part: one experiment per l_partkey."""
        label = F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.0)
        base = F.col("l_quantity") / 50
        tuned = F.col("l_extendedprice") * (1 - F.col("l_discount")) / 120000
        sides = F.array(
            F.struct(F.lit("baseline").alias("variant"), base.alias("score")),
            F.struct(F.lit("engineered").alias("variant"), tuned.alias("score")),
        )
        return self.lineitem.select(
            F.col("l_partkey").alias("experiment"), label.alias("label"), F.explode(sides).alias("s")
        ).select(
            "experiment", "label", "s.variant", "s.score",
            F.when(F.col("s.score") >= 0.5, 1.0).otherwise(0.0).alias("prediction"),
        )

    def part_features(self) -> DataFrame:
        """Features created and skipped per experiment, from its own rows."""
        per_part = self.lineitem.groupBy(F.col("l_partkey").alias("experiment")).agg(
            F.min("l_discount").alias("d"), F.max("l_tax").alias("t"), F.max("l_quantity").alias("q")
        )

        def names(*rules) -> F.Column:
            picked = F.array(*[F.when(cond, F.lit(name)) for cond, name in rules])
            return F.filter(picked, lambda x: x.isNotNull())

        return per_part.select(
            "experiment",
            names(
                (F.col("d") <= 0.01, "log1p_l_discount"), (F.col("q") >= 49, "ratio_l_tax_to_l_quantity")
            ).alias("features_created"),
            names(
                (F.col("t") >= 0.08, "diff_a: Unsupported transformation type: difference")
            ).alias("features_skipped"),
        )

    def fenced_responses(self) -> DataFrame:
        """Conversation turns as responses with JSON between fences, bare, or none."""
        inner = F.concat(
            F.lit('{"conv": '), F.col("conv_id").cast("string"), F.lit(', "turn": '),
            F.col("turn").cast("string"), F.lit("}"),
        )
        fenced = F.concat(
            F.col("text"), F.lit("\n```json\n"), inner, F.lit("\n```\n"), F.col("text")
        )
        response = (
            F.when(F.col("role") == "user", fenced)
            .when(F.col("role") == "assistant", F.concat(F.lit("  "), inner, F.lit(" \n")))
            .otherwise(F.col("text"))
        )
        return self.conversations.select("conv_id", "turn", response.alias("response"))

    def turn_rules(self) -> DataFrame:
        """Turns as profile rows: line breaks, spaces or vowels over characters."""
        rest = (
            F.when(F.col("role") == "user", F.translate("text", "\n", ""))
            .when(F.col("role") == "assistant", F.translate("text", " ", ""))
            .otherwise(F.translate("text", "aeiou", ""))
        )
        breaks = F.char_length("text") - F.char_length(rest)
        return self.conversations.select(
            "conv_id",
            "turn",
            F.lit(0).alias("position"),
            F.col("role").alias("column_name"),
            F.char_length("text").cast("bigint").alias("row_count"),
            breaks.cast("bigint").alias("missing_count"),
        )

    def finding_responses(self) -> DataFrame:
        """Turns as finding reports: valid, with a field missing, or plain text."""
        severity = F.when(F.char_length("text") < 1000, F.lit("low"))
        finding = F.struct(
            F.lit("outlier").alias("issue_type"),
            severity.alias("severity"),
            F.col("role").alias("column"),
            F.col("text").alias("evidence"),
            F.lit("check").alias("recommendation"),
        )
        report = F.to_json(F.struct(F.array(finding).alias("findings"), F.lit("ok").alias("summary")))
        response = F.when(F.col("role") == "system", F.col("text")).otherwise(report)
        return self.conversations.select("conv_id", "turn", response.alias("response"))

    def label_responses(self) -> DataFrame:
        """One exploratory report with a finding per class of the labels, in a fence."""
        finding = F.struct(
            F.lit("class_size").alias("finding_type"),
            F.lit("low").alias("importance"),
            F.array(F.lit("quality"), F.lit("toxic")).alias("columns"),
            F.concat(F.lit("Rows: "), F.col("n").cast("string")).alias("evidence"),
            F.lit("size").alias("interpretation"),
        )
        counts = self.labels.groupBy("quality").agg(F.count(F.lit(1)).alias("n"))
        found = F.transform(
            F.array_sort(F.collect_list(F.struct("quality", finding.alias("f")))), lambda x: x["f"]
        )
        report = F.to_json(F.struct(found.alias("findings"), F.lit("ok").alias("summary")))
        return counts.agg(F.concat(F.lit("```json\n"), report, F.lit("\n```")).alias("raw")).select(
            suggest.json_text(F.col("raw")).alias("response")
        )

    def label_specs(self) -> DataFrame:
        """One response with four specs named by the number of labels; two can be used."""
        name = F.concat(F.lit("f"), F.col("n").cast("string"))

        def one(number: int, kind: str, *columns: str) -> F.Column:
            return F.struct(
                F.concat(name, F.lit(f"_{number}")).alias("feature_name"),
                F.lit(kind).alias("transformation_type"),
                F.array(*[F.lit(c) for c in columns]).alias("columns"),
            )

        specs = F.array(
            one(1, "ratio", "n_chars", "doc_id"),
            one(2, "cube", "n_chars"),
            one(3, "log1p", "nope"),
            one(4, "log1p", "quality"),
        )
        return self.labels.agg(F.count(F.lit(1)).alias("n")).select(
            F.to_json(F.struct(specs.alias("specs"))).alias("response")
        )

    def spec_responses(self) -> DataFrame:
        """Events as suggested specs, some unusable."""
        kind = (
            F.when(F.col("event_type") == "view", "ratio")
            .when(F.col("event_type") == "click", "log1p")
            .when(F.col("event_type") == "purchase", "sqrt")
            .otherwise(F.col("event_type"))
        )
        columns = (
            F.when(F.col("event_type") == "view", '["value","user_id"]')
            .when(F.col("value") < 5, "[]")
            .when(F.col("value") < 10, '["nope"]')
            .when(F.col("value") < 15, "[7]")
            .when(F.col("value") < 20, '["value","event_type"]')
            .otherwise('["value"]')
        )
        response = F.concat(
            F.lit('{"specs": [{"feature_name": "f_'), F.col("event_id").cast("string"),
            F.lit('", "transformation_type": "'), kind, F.lit('", "columns": '), columns,
            F.lit('}], "summary": "s"}'),
        )
        return self.events.select("event_id", response.alias("response"))
