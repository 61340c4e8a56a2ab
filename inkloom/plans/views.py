"""Adapter views: the given tables seen as pages, regions, artifacts, texts and events.

``views_sql`` states the same views in SQL for the side-by-side check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.scale import table


def hundredths(value: Column) -> Column:
    return value.cast("double") / 100


class Views:
    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.directory, name)

    def pages(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.raw("orders").select(
            key.alias("page_id"),
            (F.col("o_custkey") % 50).alias("project_id"),
            F.concat(F.lit("Page "), key % 997).alias("title"),
            F.concat(F.lit("ch"), key % 20, F.lit("/p"), key % 137, F.lit("-"), key, F.lit(".png")).alias("rel_path"),
            (800 + 100 * (key % 5)).cast("int").alias("pixel_width"),
            (1200 + 100 * (key % 7)).cast("int").alias("pixel_height"),
        )

    def artifacts(self) -> DataFrame:
        key, status = F.col("o_orderkey"), F.col("o_orderstatus")
        mask = F.col("o_orderpriority") != "5-LOW"
        rules = [
            ("mask", 1, mask),
            ("background", 3, mask & (key % 11 != 0)),
            ("preview", 5, status.isin("F", "P")),
            ("output", 7, status == "F"),
        ]
        entries = [
            F.when(rule, F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("k"))) for kind, k, rule in rules
        ]
        return (
            self.raw("orders")
            .select(key.alias("page_id"), "o_orderdate", F.explode(F.array_compact(F.array(*entries))).alias("a"))
            .select(
                "page_id",
                F.col("a.kind").alias("kind"),
                F.timestamp_add("HOUR", (F.col("page_id") * F.col("a.k")) % 48, F.col("o_orderdate")).alias(
                    "modified_at"
                ),
            )
        )

    def _line_columns(self) -> list[Column]:
        part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
        return [
            F.col("l_orderkey").alias("page_id"),
            F.concat_ws("-", "l_orderkey", line, part, supp, F.col("l_quantity").cast("long")).alias("region_id"),
            line.alias("ord"),
            hundredths((part * 37) % 70).alias("x"),
            hundredths((supp * 53) % 70).alias("y"),
            hundredths(10 + F.col("l_quantity") % 21).alias("width"),
            hundredths(8 + part % 23).alias("height"),
            hundredths((part * 7 + line * 13) % 100).alias("confidence"),
            (supp % 4 != 0).alias("mask_complete"),
            part.alias("partkey"),
            supp.alias("suppkey"),
        ]

    def boxes(self) -> DataFrame:
        """Regions without their texts: no join, only the line table is read."""
        return self.raw("lineitem").select(*self._line_columns())

    def regions(self) -> DataFrame:
        # joined as stored: the columns made of the keys do not travel
        stored = self.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
        parts = self.raw("part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
        return stored.join(parts, "l_partkey").select(*self._line_columns(), "p_name").select(
            *[c for c in self.boxes().columns], *self._texts()
        )

    def _texts(self) -> list[Column]:
        part = F.col("partkey")
        spoken = F.concat(F.upper("p_name"), F.when(F.col("suppkey") % 10 == 0, F.lit(" 12")).otherwise(F.lit("")))
        return [
            F.when(F.col("ord") == 7, F.lit("")).otherwise(F.col("p_name")).alias("source_text"),
            F.when(part % 9 == 0, F.lit("")).otherwise(spoken).alias("translated_text"),
        ]

    def recalled(self, lines: DataFrame) -> DataFrame:
        """Rows with the keys of their part, if any, and the texts of their region; all rows stay."""
        parts = self.raw("part").select(F.col("p_partkey").alias("partkey"), "p_name", F.lit(True).alias("_known"))
        named = lines.join(parts, "partkey", "left")
        return named.select(*lines.columns, *[F.when(F.col("_known"), t).alias(n) for t, n in zip(self._texts(), ("source_text", "translated_text"))])

    def detections(self) -> DataFrame:
        left, top = F.col("x") + 0.03, F.col("y") - 0.02
        return (
            self.boxes()
            .where(F.col("suppkey") % 3 == 0)
            .select(
                "page_id",
                F.concat(F.lit("d"), "region_id").alias("det_id"),
                "ord",
                F.least(left, F.lit(1.0)).alias("x"),
                F.greatest(top, F.lit(0.0)).alias("y"),
                "width",
                "height",
                "confidence",
            )
        )

    def texts(self) -> DataFrame:
        """Conversation turns as regions; the following turn stands in for the translation."""
        turns = self.raw("conversations").select("conv_id", "turn", "role", "text")
        following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
        return turns.join(following, ["conv_id", "turn"], "left").select(
            F.col("conv_id").alias("page_id"),
            (F.col("conv_id") % 4).alias("project_id"),
            F.concat_ws("-", "conv_id", "turn").alias("region_id"),
            F.col("turn").alias("ord"),
            F.col("text").alias("source_text"),
            F.coalesce("next_text", F.lit("")).alias("translated_text"),
            F.col("role").alias("speaker"),
        )

    def glossary(self) -> DataFrame:
        """Every pair of words of every benchmark text is a term."""
        item = F.col("item_id")
        words = F.split("text", " ")
        pairs = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(words) - 1) / 2).cast("int")),
            lambda i: F.concat_ws(" ", F.get(words, 2 * i), F.get(words, 2 * i + 1)),
        )
        term = F.col("term")
        languages = F.array(*[F.lit(v) for v in ("zh-Hant", "zh", "en", "ja")])
        first = F.struct(F.get(languages, (item % 4).cast("int")).alias("lang"), F.concat(F.lit("to "), term).alias("translation"))
        second = F.when(
            item % 3 == 0,
            F.struct(F.lit("zh").alias("lang"), F.concat(term, F.lit("_zh")).alias("translation")),
        )
        return (
            self.raw("benchmark")
            .select("item_id", F.posexplode(pairs).alias("pos", "term"))
            .select(
                (item % 4).alias("project_id"),
                (item * 100_000 + F.col("pos")).alias("entry_id"),
                term.alias("source_term"),
                F.explode(F.array_compact(F.array(first, second))).alias("t"),
            )
            .select("project_id", "entry_id", "source_term", "t.lang", "t.translation")
        )

    def document_texts(self) -> DataFrame:
        return self.raw("documents").select(
            F.col("doc_id").alias("page_id"),
            (F.col("doc_id") % 4).alias("project_id"),
            F.col("doc_id").cast("string").alias("region_id"),
            F.col("text").alias("source_text"),
        )

    def truth(self) -> DataFrame:
        """Every document set in lines of up to 80 characters; the observed side carries typical reading errors."""
        set_lines = F.regexp_extract_all("text", F.lit(r"[^\n]{1,80}"), F.lit(0))
        lines = (
            self.raw("documents")
            .select("doc_id", "source", F.posexplode(set_lines).alias("line_no", "line"))
            .where(F.trim("line") != "")
            .select(F.col("source").alias("page"), "doc_id", "line_no", F.trim("line").alias("expected"))
        )
        text, kind = F.col("expected"), F.col("line_no") % 3
        observed = (
            F.when(kind == 0, F.replace(text, F.lit("e"), F.lit("c")))
            .when(kind == 1, F.substring(text, F.lit(1), F.length(text) - 1))
            .otherwise(text)
        )
        return lines.withColumn("observed", observed)

    def scores(self) -> DataFrame:
        return (
            self.raw("embeddings")
            .select(F.col("vec_id").alias("line_id"), F.posexplode("embedding").alias("pos", "score"))
            .select(
                "line_id",
                F.floor(F.col("pos") / 8).cast("int").alias("t"),
                (F.col("pos") % 8).alias("class"),
                F.col("score").cast("double").alias("score"),
            )
        )

    def cells(self) -> DataFrame:
        return (
            self.raw("lineitem")
            .select(
                F.col("l_suppkey").alias("group_id"),
                F.col("l_linenumber").cast("long").alias("y"),
                (F.col("l_partkey") % 60).alias("x"),
            )
            .distinct()
        )

    def components(self) -> DataFrame:
        part, supp = F.col("partkey"), F.col("suppkey")
        width, height = (F.col("width") * 1000).cast("decimal(10,0)"), (F.col("height") * 1000).cast("decimal(10,0)")
        return self.boxes().select(
            "page_id",
            F.concat(F.lit("k"), "region_id").alias("component_id"),
            ((part * 37) % 70 * 10).alias("min_x"),
            ((supp * 53) % 70 * 10).alias("min_y"),
            width.cast("long").alias("w"),
            height.cast("long").alias("h"),
            F.floor((width * height).cast("double") * (1 + part % 9) / 10).cast("long").alias("area"),
            "partkey",
            "suppkey",
        )

    def lines(self) -> DataFrame:
        even = F.col("partkey") % 2 == 0
        return self.boxes().select(
            F.col("page_id").alias("balloon_id"),
            F.col("region_id").alias("line_id"),
            "ord",
            "x",
            "y",
            F.when(even, F.col("width") / 4).otherwise(F.col("width")).alias("width"),
            F.when(even, F.col("height")).otherwise(F.col("height") / 4).alias("height"),
            "confidence",
        )

    def responses(self) -> DataFrame:
        """One model reply per conversation, with the faults real replies show."""
        conv, turn = F.col("conv_id"), F.col("turn")
        quoted = F.replace(F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
        item = F.concat(
            F.lit('{"id":"'), conv, F.lit("-"), turn, F.lit('","translatedText":"'), quoted,
            F.lit('","confidence":0.'), turn % 10, F.lit("}"),
        )
        rows = (
            self.raw("conversations")
            .where(~((conv % 7 == 0) & (turn == 1)))
            .groupBy("conv_id")
            .agg(F.array_sort(F.collect_list(F.struct("turn", item.alias("item")))).alias("items"))
        )
        body = F.concat(F.lit("["), F.array_join(F.transform("items", lambda s: s["item"]), ","), F.lit("]"))
        cut = F.when(conv % 5 == 0, F.substring(body, F.lit(1), F.length(body) - 10)).otherwise(body)
        lead = (
            F.when(conv % 11 == 0, F.lit("<think>checking names "))
            .when(conv % 3 == 0, F.lit("<think>two speakers [a]</think>\n"))
            .otherwise(F.lit("Here is the result: "))
        )
        return rows.select(
            F.col("conv_id").alias("request_id"),
            F.concat(F.lit("m"), conv % 3).alias("model"),
            F.concat(lead, cut).alias("text"),
        )

    def expected_ids(self) -> DataFrame:
        return self.raw("conversations").select(
            F.col("conv_id").alias("request_id"), F.concat_ws("-", "conv_id", "turn").alias("region_id")
        )

    def events(self) -> DataFrame:
        kinds = F.create_map(
            *[
                F.lit(v)
                for v in (
                    "signup", "started", "view", "activity", "click", "progress", "error", "failed",
                    "purchase", "completed",
                )
            ]
        )
        return self.raw("events").select(
            "event_id",
            "ts",
            F.col("user_id").alias("job_id"),
            (F.col("event_id") % 500).alias("page_id"),
            F.try_element_at(kinds, F.col("event_type")).alias("kind"),
            F.regexp_extract("props", r"[0-9]+", 0).cast("int").alias("k"),
            F.col("value"),
        )

    def edits(self) -> DataFrame:
        """Events as region patches; the patched field depends on the event type."""
        events = self.raw("events").select(
            "event_id",
            F.col("user_id").alias("page_id"),
            (1 + F.col("event_id") % 7).cast("int").alias("ord"),
            "event_type",
            F.regexp_extract("props", r"[0-9]+", 0).cast("int").alias("k"),
        )
        targets = self.boxes().select("page_id", "ord", "region_id")
        kind, k = F.col("event_type"), F.col("k")
        return events.join(targets, ["page_id", "ord"]).select(
            "region_id",
            "page_id",
            F.col("event_id").alias("seq"),
            F.when(kind.isin("signup", "purchase"), F.concat(F.lit("s"), k % 5)).alias("source_text"),
            F.when(kind.isin("view", "purchase"), F.concat(F.lit("t"), k % 5)).alias("translated_text"),
            F.when(kind == "click", hundredths(k)).alias("new_x"),
            (kind == "error").alias("clear_font_size"),
        )

    def samples(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_type").alias("model"),
            (F.col("user_id") % 4).alias("configuration"),
            "ts",
            "event_id",
            F.col("value").alias("ms"),
        )
