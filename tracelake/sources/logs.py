"""Reading, merging and writing event logs and transcripts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.functions.text import present
from tracelake.functions.times import normalize_ts
from tracelake.sources.batches import write_batch
from tracelake.sources.tables import exists, stored

SOURCE_ORDER = ("changelog", "research", "milestones", "tool-use", "history")
DIFF_SHAPE = "struct<files_new:int,files_modified:int,files_deleted:int,lines_added:int,lines_removed:int,quadrant:string,commit_type:string>"
EVENT_FIELDS = (
    "event_id string, timestamp string, type string, session_id string, session string, sessionId string, project string, cwd string, summary string, "
    "description string, display string, prompt string, url string, query string, title string, category string, milestone string, deeplink string, "
    f"transcript_path string, related_ids array<string>, parent_event_id string, salience double, commit_type string, diff_shape {DIFF_SHAPE}"
)
USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>"
ENTRY_FIELDS = (
    "uuid string, parentUuid string, type string, timestamp string, requestId string, isSidechain boolean, isMeta boolean, isCompactSummary boolean, "
    f"cwd string, gitBranch string, agentId string, toolUseResult variant, message struct<role:string,model:string,content:variant,usage:{USAGE}>"
)
BLOCK = "struct<type:string,text:string,thinking:string,id:string,name:string,input:variant,tool_use_id:string,content:variant,is_error:boolean>"
ENTRY_TYPES = ("user", "assistant", "system", "summary", "file-history-snapshot", "queue-operation")


def read_log(spark: SparkSession, path: str, fields: str = EVENT_FIELDS) -> DataFrame:
    """One JSON object a line; blank and malformed lines are skipped."""
    return spark.read.schema(fields).option("mode", "DROPMALFORMED").json(path)


def tail_logs(spark: SparkSession, folder: str, offsets: DataFrame | None = None, fields: str = EVENT_FIELDS) -> tuple[DataFrame, DataFrame]:
    """Rows of the lines added to the logs (*.jsonl) under a folder since `offsets`, and the new offsets (path, read).

    Only files that grew or shrank are read; one that shrank starts anew.  A last line
    without its line end waits for the next call.  A file's new part is read by one task.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(folder)
    before = offsets if offsets is not None else spark.createDataFrame([], "path string, read long")
    state = files.select("path", "length").join(before.select("path", "read"), "path", "left").withColumn("read", F.when(F.col("read") <= F.col("length"), F.col("read")).otherwise(0))
    changed = stored(state.where("read < length").select("path", "read"), "changed-logs")
    new = files.select("path", "content").join(changed, "path").select("path", "read", F.substring("content", F.col("read").cast("int") + 1, F.octet_length("content")).alias("part"))
    whole = F.octet_length("part") - F.locate("\n", F.reverse(F.decode("part", "ISO-8859-1"))) + 1
    cut = stored(new.where(F.locate("\n", F.decode("part", "ISO-8859-1")) > 0).select("path", (F.col("read") + whole).alias("read"), F.decode(F.substring("part", F.lit(1), whole), "UTF-8").alias("text")), "tailed-logs")
    lines = cut.select(F.explode(F.split("text", "\n")).alias("value"))
    parsed = F.from_json("value", fields + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = lines.where("trim(value) <> ''").withColumn("p", parsed).where("p._corrupt_record is null").select("p.*").drop("_corrupt_record")
    done = cut.select("path", F.col("read").alias("now"))
    return rows, stored(state.join(done, "path", "left").select("path", F.coalesce("now", "read").alias("read")), "log-offsets")


def corrupt_lines(spark: SparkSession, path: str, fields: str = EVENT_FIELDS) -> DataFrame:
    """The lines that `read_log` skips, for an audit."""
    rows = spark.read.text(path).where("trim(value) <> ''")
    parsed = F.from_json("value", fields + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return rows.withColumn("p", parsed).where("p._corrupt_record is not null").select("value")


def union_logs(logs: dict[str, DataFrame]) -> DataFrame:
    """Logs one after the other, tagged with source and its place in the fixed order."""
    known = [*[s for s in SOURCE_ORDER if s in logs], *sorted(set(logs) - set(SOURCE_ORDER))]
    parts = [logs[s].withColumn("source", F.lit(s)).withColumn("source_ord", F.lit(i)) for i, s in enumerate(known)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merge_events(events: DataFrame, key: str = "event_id", order: str = "source_ord") -> DataFrame:
    """One row for each id: of each field the longest value, the earlier source on a tie.

    Rows without an id pass unmerged.  `source` becomes the last source other than
    changelog, if there is one.
    """
    def longest(c: str) -> Column:
        value = F.col(c)
        size = F.length(value) if isinstance(events.schema[c].dataType, T.StringType) else F.length(F.to_json(F.struct(value)))
        return F.max_by(value, F.when(value.isNotNull(), F.struct(size, -F.col(order)))).alias(c)

    plain = F.when(F.col("source") != "changelog", F.col(order))
    label = F.coalesce(F.max_by("source", plain), F.max_by("source", F.col(order))).alias("source")
    fields = [c for c in events.columns if c not in (key, "source", order)]
    has = F.coalesce(F.col(key).cast("string"), F.lit("")) != ""
    merged = events.where(has).groupBy(key).agg(*[longest(c) for c in fields], label, F.min(order).alias(order))
    return merged.select(*events.columns).unionByName(events.where(~has))


def normalize_fields(events: DataFrame, transcripts: DataFrame | None = None, root: str = "") -> DataFrame:
    """Common names: session_id, summary, type; transcript_path from project and session where a listing has the file."""
    c = events.columns
    out = events.withColumns({
        "session_id": F.coalesce(*[present(n, c) for n in ("session_id", "sessionId", "session")]),
        "summary": F.coalesce(present("summary", c), present("display", c)),
        "type": F.coalesce(present("type", c), present("source", c)),
    }).drop(*[n for n in ("sessionId", "session") if n in c])
    if transcripts is None:
        return out
    folder = F.replace(F.coalesce("project", F.lit("")), F.lit("/"), F.lit("-"))
    guess = F.concat(F.lit(root), F.when(folder == "", "-").otherwise(folder), F.lit("/"), F.col("session_id"), F.lit(".jsonl"))
    listed = transcripts.select(F.col("transcript_path").alias("listed")).distinct()
    own = F.nullif("transcript_path", F.lit("")) if "transcript_path" in out.columns else F.lit(None).cast("string")
    return out.withColumn("guess", guess).join(listed, F.col("guess") == F.col("listed"), "left").withColumn("transcript_path", F.coalesce(own, F.col("listed"))).drop("guess", "listed")


def with_time(events: DataFrame, column: str = "timestamp", mode: str = "jsonl") -> DataFrame:
    return events.withColumn("ts", normalize_ts(F.col(column), mode))


def order_events(events: DataFrame) -> DataFrame:
    """Newest first, for a result's edge."""
    return events.orderBy(F.col("ts").desc_nulls_last(), "event_id")


def scan_transcripts(spark: SparkSession, root: str, modified_after: str | None = None) -> DataFrame:
    """(transcript_path, project, session_id, modified) of the transcripts under root, without those of agents."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
    files = (reader.option("modifiedAfter", modified_after) if modified_after else reader).load(root)
    stem = F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)
    return files.where(~stem.startswith("agent-")).select(F.col("path").alias("transcript_path"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("project"), stem.alias("session_id"), F.col("modificationTime").alias("modified"))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Typed transcript entries with session_id, project and their line order within the file."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path).select("value", F.col("_metadata.file_path").alias("transcript_path"), place.alias("place"))
    return entry_rows(lines)


def entry_rows(lines: DataFrame) -> DataFrame:
    """Entries of transcript lines (value, transcript_path, place), place being the lines' order in their file."""
    parsed = lines.withColumn("session_id", F.regexp_extract("transcript_path", r"([^/]+)\.jsonl$", 1)).where(~F.col("session_id").startswith("agent-"))
    order = Window.partitionBy("transcript_path").orderBy("place")
    numbered = parsed.withColumn("ordinal", F.row_number().over(order).cast("long"))
    project = F.regexp_extract("transcript_path", r"([^/]+)/[^/]+$", 1).alias("project")
    entry = F.from_json("value", ENTRY_FIELDS)
    return numbered.select("transcript_path", "session_id", project, "ordinal", F.col("value").alias("raw"), entry.alias("e")).select("transcript_path", "session_id", "project", "ordinal", "raw", "e.*")


def parse_entries(entries: DataFrame) -> DataFrame:
    """Messages: entries of known types with a uuid, their usage and content laid out in columns."""
    kind = F.schema_of_variant("message.content")
    is_list = F.coalesce(kind.startswith("ARRAY"), F.lit(False))
    usage = {c: F.coalesce(F.col(f"message.usage.{c}"), F.lit(0)) for c in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")}
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("isSidechain", "isMeta", "isCompactSummary")}
    out = entries.where(F.coalesce(F.col("uuid"), F.lit("")) != "").where(F.col("type").isin(*ENTRY_TYPES))
    return out.withColumns({
        **usage, **flags,
        "has_usage": F.col("message.usage").isNotNull(),
        "ts": normalize_ts(F.col("timestamp")),
        "role": F.coalesce(F.col("message.role"), F.col("type")),
        "model": F.coalesce(F.col("message.model"), F.lit("")),
        "text": F.when(kind == "STRING", F.try_variant_get("message.content", "$", "string")),
        "blocks": F.when(is_list, F.try_variant_get("message.content", "$", f"array<{BLOCK}>")),
    })


def commit_events(commits: DataFrame) -> DataFrame:
    """Commits (hash, ts, subject, author, files array, remote) as events."""
    short = F.substring("hash", 1, 7)
    files = F.array_join(F.slice(F.coalesce("files", F.array().cast("array<string>")), 1, 20), ", ")
    base = F.regexp_replace(F.regexp_replace("remote", r"\.git$", ""), r"^git@([^:]+):", "https://$1/")
    summary = F.concat(F.lit("Commit "), short, F.lit(": "), F.col("subject"), F.when(files != "", F.concat(F.lit(" | files: "), files)).otherwise(""))
    return commits.select(
        F.concat(F.lit("git-"), short).alias("event_id"), "ts", F.lit("git_commit").alias("type"), summary.alias("summary"), F.col("hash").alias("commit_hash"), "author",
        F.when(F.coalesce(base, F.lit("")) != "", F.concat(base, F.lit("/commit/"), F.col("hash"))).otherwise("").alias("url"), files.alias("files_changed"),
    )


def memory_events(files: DataFrame) -> DataFrame:
    """Markdown notes (path, value, modified) with front matter as events; the body is cut at 500 characters."""
    front = F.regexp_extract("value", r"(?s)^---\n(.*?)\n---", 1)
    key = lambda k: F.nullif(F.trim(F.regexp_extract(front, rf"(?m)^{k}:\s*(.*)$", 1)), F.lit(""))
    body = F.trim(F.regexp_replace("value", r"(?s)^---\n.*?\n---\n?", ""))
    stem = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    name, kind = F.coalesce(key("name"), stem), F.coalesce(key("type"), F.lit("note"))
    return files.select(
        F.concat(F.lit("memory-"), stem).alias("event_id"), F.col("modified").alias("ts"), F.concat(F.lit("memory_"), kind).alias("type"), name.alias("memory_name"), kind.alias("memory_type"),
        F.concat(name, F.lit(": "), F.coalesce(key("description"), F.substring(body, 1, 120))).alias("summary"), F.substring(body, 1, 500).alias("body"),
        F.regexp_extract("path", r"([^/]+)/memory/[^/]+$", 1).alias("project"), F.col("path").alias("memory_path"),
    )


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Vectors with their payload and its defaults."""
    v = spark.read.parquet(path)
    salience = F.coalesce("salience", F.lit(0.5)) if "salience" in v.columns else F.lit(0.5)
    parent = F.col("parent_event_id") if "parent_event_id" in v.columns else F.lit(None).cast("string")
    return v.withColumn("salience", salience).withColumn("parent_event_id", parent)


def read_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Judged events (query_id, place, summary, grade, noise) and sessions (query_id, session, relevant, role)."""
    fields = "query string, intent string, events array<struct<summary:string,grade:int,noise:string>>, sessions map<string,struct<relevant:boolean,role:string>>"
    truth = spark.read.schema(fields).option("multiLine", True).json(path)
    events = truth.select(F.col("query").alias("query_id"), F.posexplode("events").alias("place", "e")).select("query_id", "place", "e.*")
    return events, truth.select(F.col("query").alias("query_id"), F.explode("sessions").alias("session", "s")).select("query_id", "session", "s.*")


def new_only(rows: DataFrame, existing: DataFrame, key: str = "event_id") -> DataFrame:
    """Rows whose id is not stored yet."""
    return rows.join(existing.select(key), key, "left_anti")


def envelope(events: DataFrame) -> DataFrame:
    """The common fields of a domain row, as the unified log holds them."""
    c = events.columns
    return events.select(*[present(n, c).alias(n) if n not in c else F.col(n) for n in ("event_id", "ts", "type", "session_id", "project", "summary", "transcript_path", "parent_event_id", "salience")])


def dual_sink(events: DataFrame, domain_path: str, unified_path: str) -> None:
    """Append new rows to a domain table and to the unified table; a repeated batch adds nothing."""
    spark = events.sparkSession
    for frame, path in ((events, domain_path), (envelope(events), unified_path)):
        (new_only(frame, spark.read.parquet(path)) if exists(spark, path) else frame).write.mode("append").parquet(path)


def dual_batch(events: DataFrame, domain_path: str, unified_path: str, number: int | str) -> None:
    """Append a numbered batch to a domain table and to the unified table, without a look at what they hold; a repeated batch changes nothing."""
    for frame, path in ((events, domain_path), (envelope(events), unified_path)):
        write_batch(frame, path, number)


def write_enriched(events: DataFrame, path: str, version: str) -> str:
    """Write an enriched log as a new version, never in place."""
    target = f"{path.rstrip('/')}/version={version}"
    events.write.mode("errorifexists").parquet(target)
    return target


def explode_search_results(events: DataFrame, response: str = "tool_response") -> DataFrame:
    """One row for each result with a url in a tool response (a list, or an object with links or results), linked to its search."""
    v = F.try_parse_json(F.col(response))
    item = "array<struct<url:string,title:string>>"
    found = F.coalesce(F.try_variant_get(v, "$", item), F.try_variant_get(v, "$.links", item), F.try_variant_get(v, "$.results", item))
    rows = events.withColumn("found", found).select("*", F.posexplode("found").alias("place", "hit")).where(F.coalesce(F.col("hit.url"), F.lit("")) != "")
    return rows.select(F.concat("event_id", F.lit("-r"), F.col("place").cast("string")).alias("event_id"), F.col("event_id").alias("parent_event_id"), F.lit("search_result").alias("type"), F.col("hit.url").alias("url"), F.col("hit.title").alias("title"), F.lit(0.3).alias("salience"))
