"""The given tables as the library's tables: corpus, queries, vectors, events with sessions, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators.index import Index, build_index
from tracelake.operators.sessions import segment
from tracelake.sources.tables import exists, file_state

SESSION_GAP = 6 * 3600
PARENT_WINDOW = 3600
AS_OF = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, project (source), type (lang)."""
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("project"), F.col("lang").alias("type"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item, whole, as a query."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_INDEXES: dict[tuple, Index] = {}


def index(spark: SparkSession, sf_dir: str) -> Index:
    """Index of the documents as they are now, read by all queries of a session until a file of theirs changes."""
    docs = corpus(spark, sf_dir)
    key = (spark.sparkContext.applicationId, file_state(docs))
    known = _INDEXES.get(key)
    if known is None or not all(exists(spark, s.path) for s in known.segments):  # a cleared folder takes it along
        _INDEXES[key] = known = build_index(docs)
    return known


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a session (user and stretch without a gap over six hours) and a project (user modulo 7)."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("type"), "value", "props")
    cut = segment(e, "user_id", SESSION_GAP)
    session = F.concat_ws("-", F.col("user_id").cast("string"), F.col("segment").cast("string"))
    return cut.withColumn("session_id", session).withColumn("project", F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string"))).drop("segment")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages: usage grows with the text, two turns share a request, system rows are compactions."""
    c = table(spark, sf_dir, "conversations")
    n = F.length("text").cast("long")
    assistant, system = F.col("role") == "assistant", F.col("role") == "system"
    count = lambda v: F.when(assistant, v).otherwise(0).cast("long")
    kind = F.when(assistant, "assistant").otherwise("user")
    block = "array<struct<type:string,text:string,thinking:string,id:string,name:string,input:variant,tool_use_id:string,content:variant,is_error:boolean>>"
    return c.select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("ordinal"), F.concat_ws("-", "conv_id", "turn").alias("uuid"), kind.alias("type"), F.col("role"),
        F.lit(False).alias("isMeta"), F.lit(False).alias("isSidechain"), system.alias("isCompactSummary"), F.when(assistant, F.concat_ws("-", "conv_id", F.floor(F.col("turn") / 4))).alias("requestId"),
        F.lit("m").alias("model"), (F.timestamp_seconds(F.col("turn") * 30)).alias("ts"), count(n).alias("input_tokens"), count(F.floor(n / 2)).alias("output_tokens"), count(F.floor(n / 3)).alias("cache_read_input_tokens"), count(F.floor(n / 5)).alias("cache_creation_input_tokens"),
        F.when(~assistant, F.col("text")).alias("text"),
        F.when(assistant, F.from_json(F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text")))), block)).alias("blocks"),
    )


def live_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages of all kinds, by k = conv_id + turn.

    Assistants say their text, think it, call a tool or a task with it, answer a shutdown or
    leave plan mode (k modulo 6).  Users speak, answer the call before (meta; some rejected),
    repeat a reminder, mention files, or give a summary where the session was compacted (k
    modulo 5 after the first turn); some interrupt (k modulo 7).  Usage is that of `messages`.
    """
    base = messages(spark, sf_dir).drop("text", "blocks", "isMeta", "isCompactSummary")
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("ordinal"), F.coalesce("text", F.lit("")).alias("said"))
    c = base.join(own, ["session_id", "ordinal"])
    k, said, place = F.col("session_id") + F.col("ordinal"), F.col("said"), lambda n: F.concat_ws("-", F.lit("t"), "session_id", n)
    shape = {"type": "string", "text": "string", "thinking": "string", "id": "string", "name": "string", "input": "struct<command:string,description:string,type:string,approve:boolean>", "tool_use_id": "string", "content": "string"}

    def block(kind: str, **fields) -> Column:
        given = {"type": F.lit(kind), **fields}
        return F.struct(*(given.get(n, F.lit(None)).cast(t).alias(n) for n, t in shape.items()))

    def call(name: str, **given) -> Column:
        names = {"command": "string", "description": "string", "type": "string", "approve": "boolean"}
        return block("tool_use", id=place(F.col("ordinal").cast("string")), name=F.lit(name), input=F.struct(*(given.get(n, F.lit(None)).cast(t).alias(n) for n, t in names.items())))

    thinks, says = block("thinking", thinking=said), block("text", text=said)
    shutdown = call("SendMessage", type=F.lit("shutdown_response"), approve=F.lit(True))
    kinds = [[says], [thinks, call("Bash", command=said)], [thinks, says, call("Task", description=said)], [shutdown], [call("ExitPlanMode")], [thinks]]
    spoken = F.element_at(F.array(*(F.array(*b) for b in kinds)), (k % 6 + 1).cast("int"))
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    kind = F.when(user & (F.col("ordinal") > 0), F.when(k % 7 == 0, "interruption").otherwise(F.element_at(F.array(*map(F.lit, ("plain", "result", "reminder", "mention", "summary"))), (k % 5 + 1).cast("int"))))
    result = block("tool_result", tool_use_id=place((F.col("ordinal") - 1).cast("string")), content=said)
    blocks = F.when(assistant, spoken).when(kind == "result", F.array(result)).when(kind == "interruption", F.array(block("text", text=F.lit("[Request interrupted by user]"))))
    tagged = F.when(kind == "reminder", F.concat(F.lit("<system-reminder>"), said, F.lit("</system-reminder>"), said)).when(kind == "mention", F.concat(said, F.lit(" @src/app.py @docs/a-b.md @src/app.py"))).otherwise(said)
    variant = "array<struct<type:string,text:string,thinking:string,id:string,name:string,input:variant,tool_use_id:string,content:variant,is_error:boolean>>"
    rejected = (kind == "result") & (F.col("ordinal") % 4 == 1)
    return c.withColumns({
        "isMeta": F.coalesce(kind == "result", F.lit(False)), "isCompactSummary": (F.col("role") == "system") | F.coalesce(kind == "summary", F.lit(False)),
        "text": F.when(~assistant & blocks.isNull(), tagged), "blocks": F.from_json(F.to_json(blocks), variant), "toolUseResult": F.when(rejected, F.parse_json(F.lit('"User rejected tool use"'))),
    }).drop("said")
