"""Views over the driver's tables in the shape of a review corpus; arithmetic on ids only, so any engine derives them alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.columns import ladder
from dossier.operators.replies import VERSION_FIELD
from dossier.operators.splits import assign_split

TASKS = ("exclusion", "power_analysis", "data_analysis")
SPLIT_SEED, ROUND_SEED = "dossier-split", "dossier-rounds"


class Corpus:
    """The views of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def labels(self) -> DataFrame:
        """paper_id, exclusion_reason, power, stats, citation_raw, stratum, split."""
        d = F.col("doc_id")
        good = F.col("quality") == 1
        rows = self.table("labels").select(
            d.cast("string").alias("paper_id"), "doc_id",
            F.when(F.col("quality") == 0, "low_quality").alias("exclusion_reason"),
            F.when(good, F.when(F.col("toxic") == 0, "yes").otherwise("no")).alias("power"),
            F.when(good, F.when(d % 3 == 0, "no").otherwise("yes")).alias("stats"),
            F.concat(F.lit("doc "), d.cast("string")).alias("citation_raw"),
            F.when(F.col("quality") == 0, "excluded").otherwise("survivor").alias("stratum"),
        )
        return assign_split(rows, SPLIT_SEED, 0.3)

    def judgments(self) -> DataFrame:
        """Three judgments per document and task, with holes."""
        docs = self.table("documents").select("doc_id", F.col("n_chars"))
        d, i, t = F.col("doc_id"), F.col("judgment_index"), F.col("t")
        grid = docs.where(d % 7 != 0).crossJoin(F.broadcast(self._grid()))
        version = F.when(i < 3, "v1").otherwise("v2")
        gate = ladder([(F.col("n_chars") < 600, "yes"), (F.col("n_chars") > 8000, "undecidable"), (d % 97 == 5, "wrong_text")], "no")
        other = ladder([((d + i + t) % 5 == 0, "yes"), ((d + i + t) % 11 == 0, "undecidable")], "no")
        run = F.when(d % 29 != 0, F.concat_ws("-", F.lit("run"), "task", version))
        rows = grid.where((d + i + t) % 4 != 0).select(
            d.cast("string").alias("paper_id"), "doc_id", "task", "judgment_index", version.alias("promptbook_version"),
            F.when(t == 0, gate).otherwise(other).alias("decision"),
            F.when(d % 41 != 0, (F.lit(50) + (d * 7 + i) % 50) / F.lit(100.0)).alias("confidence"), run.alias("run_id"),
        )
        return rows.withColumn("response_id", F.when(F.col("run_id").isNotNull(), F.concat_ws("-", F.lit("resp"), "task", "paper_id", F.col("judgment_index").cast("string"))))

    def _grid(self) -> DataFrame:
        """Nine rows: task, its number, judgment index."""
        return self.spark.createDataFrame([(name, t, i) for t, name in enumerate(TASKS) for i in (1, 2, 3)], "task string, t int, judgment_index int")

    def runs(self) -> DataFrame:
        """One row per task and promptbook version."""
        rows = self.spark.createDataFrame([(t, v) for t in TASKS for v in ("v1", "v2")], "task string, promptbook_version string")
        return rows.select(
            F.concat_ws("-", F.lit("run"), "task", "promptbook_version").alias("run_id"), "task", "promptbook_version",
            F.sha2(F.concat_ws("|", "task", "promptbook_version"), 256).alias("config_fingerprint"),
            F.when(F.col("promptbook_version") == "v1", "medium").otherwise("high").alias("effort"), F.lit("m-1").alias("model"),
        )

    def papers(self) -> DataFrame:
        """The manifest."""
        d = F.col("doc_id")
        labelled = self.table("labels").select("doc_id", F.lit(True).alias("labelled"))
        return self.table("documents").join(labelled, "doc_id", "left").select(
            d.cast("string").alias("paper_id"), "doc_id", F.when(F.col("labelled"), "human_labelled").otherwise("unlabelled").alias("set"), "source", "lang",
            F.substring("text", 1, 60).alias("title"), F.md5("text").alias("md5"), F.concat(F.lit("10.1000/"), F.md5("text")).alias("doi"), d.cast("string").alias("pmid"),
            ladder([(d % 13 == 0, "DROPPED"), (d % 17 == 0, "WEAK")], "VERIFIED").alias("verdict"), F.when(d % 31 == 0, "PDF_MISSING").otherwise("OK").alias("status"), "n_chars",
        )

    def label_sources(self) -> DataFrame:
        """Two institutes' rows, agreeing, disagreeing or alone."""
        base = self.labels().select("paper_id", "doc_id", F.coalesce("exclusion_reason", F.lit("")).alias("exclusion_reason"), F.coalesce("power", F.lit("")).alias("power"), F.coalesce("stats", F.lit("")).alias("stats"), "citation_raw")
        a = base.where("doc_id % 3 <> 0").withColumn("source", F.lit("A"))
        flipped = F.when((F.col("doc_id") % 11 == 0) & (F.col("power") != ""), F.when(F.col("power") == "yes", "no").otherwise("yes")).otherwise(F.col("power"))
        b = base.where("doc_id % 5 <> 0").withColumn("power", flipped).withColumn("source", F.lit("B"))
        return a.unionByName(b).withColumn("source_file", F.concat(F.lit("labels_"), F.lower("source"), F.lit(".csv")))

    def attempts(self) -> DataFrame:
        """Ledger of attempts from events: one per user and event, numbered by day."""
        from pyspark.sql import Window

        kind = ladder([(F.col("event_type") == "error", "process"), (F.col("event_type") == "signup", "parse"), (F.col("event_type") == "view", "semantic")], "")
        day = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
        return self.table("events").select(
            F.col("user_id").cast("string").alias("paper_id"), "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("started_at"), F.row_number().over(day).alias("attempt"),
            kind.alias("failure_kind"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("exit_code"), "event_type", "value",
        )

    def replies(self) -> DataFrame:
        """One stored reply per document and task, every tenth sound in another way or broken in another place."""
        d, k = F.col("doc_id"), F.col("doc_id") % 10
        tasks = self.spark.createDataFrame([("exclusion", "E"), ("power_analysis", "P")], "task string, prefix string")
        x = self.table("documents").select("doc_id").crossJoin(F.broadcast(tasks))
        rule = F.concat(F.when(d % 6 == 5, "D").otherwise(F.col("prefix")), (d % 4).cast("string"))
        evidence = ladder([(k == 8, ""), ((k == 7) & (d % 4 == 3), " wrong_text "), (d % 8 == 7, "no rule")], None)
        said = F.struct(
            ladder([(k == 3, "perhaps"), (k == 7, "wrong_text"), (k == 9, " YES ")], "yes").alias("decision"), ladder([(k == 5, "")], "because").alias("reasoning"),
            F.coalesce(evidence, F.concat(F.lit("rule "), rule)).alias("promptbook_evidence"), F.when(k == 4, 1.5).otherwise(0.5).alias("confidence"), F.when(k == 6, 1).alias("surprise"),
            F.when(d % 9 != 0, d.cast("string")).alias("paper_id"),
        )
        body = F.to_json(said)
        raw = F.when(k == 2, "I think yes").when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
        return x.select(d.cast("string").alias("paper_id"), "doc_id", "task", raw.alias("raw"))

    def reply_lines(self) -> DataFrame:
        """Event streams from conversations: an init, a text block per assistant turn, a result, and a broken line."""
        t = self.table("conversations").select(F.col("conv_id").cast("string").alias("stream_id"), "conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
        c, text = F.col("conv_id"), F.lit
        block = F.array(F.struct(F.lit("text").alias("type"), "text"))
        used = F.when(F.col("turn") % 2 == 1, F.struct((F.length("text")).cast("long").alias("input_tokens")))
        request = F.when(c % 11 != 0, F.concat(F.lit("req-"), "stream_id", F.lit("-"), F.col("turn").cast("string")))
        said = t.where("role = 'assistant'").select("stream_id", (F.col("turn") * 10 + 10).alias("line"), F.to_json(F.struct(text("assistant").alias("type"), request.alias("request_id"), F.struct(block.alias("content"), used.alias("usage")).alias("message"))).alias("raw"))
        each = t.groupBy("stream_id").agg(F.max("conv_id").alias("conv_id"), F.max("turn").alias("top"), F.sum(F.length("text")).alias("chars"))
        tools = F.when(c % 3 == 0, F.array().cast("array<string>")).when(c % 3 == 1, F.array(F.lit("web")))
        version = F.when(c % 17 != 0, F.concat(F.lit("2."), (c % 2).cast("string")))
        model = F.when(c % 19 != 0, F.when(c % 23 == 0, "m-2").otherwise("m-1"))
        init = each.select("stream_id", F.lit(0).cast("long").alias("line"), F.to_json(F.struct(text("system").alias("type"), text("init").alias("subtype"), model.alias("model"), version.alias(VERSION_FIELD), tools.alias("tools"))).alias("raw"))
        use = F.when(c % 4 != 0, F.struct(F.col("chars").alias("input_tokens"), F.when(c % 2 == 0, 5).cast("long").alias("cache_read_input_tokens"), F.lit(7).alias("output_tokens"), F.when(c % 37 == 0, "fast").otherwise("standard").alias("speed"), text("standard").alias("service_tier")))
        denied = F.when(c % 29 == 0, F.array(F.struct(text("t").alias("tool")))).otherwise(F.array().cast("array<struct<tool:string>>"))
        stop = F.when(c % 31 == 0, "max_tokens").otherwise("end_turn")
        result = each.where(c % 13 != 0).select("stream_id", (F.col("top") * 10 + 20).alias("line"), F.to_json(F.struct(
            text("result").alias("type"), F.concat(F.lit("s"), "stream_id").alias("session_id"), (F.col("chars") * 2).alias("duration_ms"), F.col("top").alias("num_turns"), stop.alias("stop_reason"), (F.col("chars") / 64).alias("total_cost_usd"), denied.alias("permission_denials"),
            text("done").alias("result"), use.alias("usage"))).alias("raw"))
        broken = each.select("stream_id", F.lit(5).cast("long").alias("line"), F.lit('{"type": "assist').alias("raw"))
        return said.unionByName(init).unionByName(result).unionByName(broken)

    def checked(self) -> DataFrame:
        """Checked responses of two tasks: accepted, failed, for papers with and without a label."""
        d = F.col("doc_id")
        tasks = self.spark.createDataFrame([("exclusion", 0, "E"), ("power_analysis", 1, "P")], "task string, t int, prefix string")
        x = self.table("documents").select("doc_id").crossJoin(F.broadcast(tasks))
        t = F.col("t")
        decision = ladder([((d + t) % 7 == 0, "undecidable"), (((d + t) % 11 == 0) & (t == 0), "wrong_text"), ((d + t) % 3 == 0, "yes")], "no")
        failed = (d + t) % 13 == 0
        return x.select(
            d.cast("string").alias("paper_id"), "doc_id", "task", F.concat(F.lit("tok"), d.cast("string")).alias("token"), F.when(failed, "failed").otherwise("ok").alias("status"), F.when(~failed, decision).alias("decision"),
            ladder([(d % 10 == 0, "n/a"), (d % 10 == 1, "")], ((F.lit(50) + d % 50) / F.lit(100.0)).cast("string")).alias("confidence"), F.when(~failed, F.concat(F.col("prefix"), (d % 4).cast("string"), F.when(d % 2 == 0, "; X9").otherwise(""))).otherwise("").alias("cited_rules"),
            F.when(failed, " none ").otherwise("").alias("promptbook_evidence"), ladder([(failed & (d % 2 == 0), "parse"), (failed, "process")], "").alias("failure_kind"), F.when(failed, F.repeat(F.lit("detail "), (d % 90).cast("int"))).otherwise("").alias("detail"),
            F.concat(F.lit("raw/"), d.cast("string"), F.lit("."), t.cast("string")).alias("raw_path"), F.lit("r1").alias("round"), (F.lit(1) + d % 3).cast("int").alias("attempt"), F.when(failed & (d % 2 == 1), 1).otherwise(0).alias("exit_code"),
        )
