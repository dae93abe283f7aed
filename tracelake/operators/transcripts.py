"""Analytics of assistant transcripts, over messages as `parse_entries` lays them out.

A message has session_id, ordinal (its place), type, isMeta, isSidechain,
isCompactSummary, requestId, model, ts, four token counts, and its content either as
`text` or as `blocks`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.classify import noise_class, noise_summary
from tracelake.functions.text import estimate_tokens

# Names and marks that transcripts carry.
INJECTION_TAGS = ("system-reminder", "claude-md", "memory")
COORDINATION_TOOLS = ("Task", "SendMessage", "TeamCreate", "TeamDelete", "TaskCreate", "TaskUpdate", "TaskList", "TaskGet")
SYSTEM_OUTPUT = ("<local-command-stderr>", "<local-command-stdout>", "<local-command-caveat>", "<system-reminder>")
INTERRUPTED = "[Request interrupted by user"
REJECTED = "User rejected tool use"
HARVEST_KEYS = ("text", "content", "file_path", "command", "description", "prompt", "query", "url", "name", "pattern")
CATEGORIES = ("claude_md", "mentioned_files", "tool_outputs", "thinking_text", "task_coordination", "user_messages")
TURN_CHARS, RICH_CHARS = 50_000, 200_000
INPUT = ("input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")


def context_tokens() -> Column:
    return F.col("input_tokens") + F.col("cache_read_input_tokens") + F.col("cache_creation_input_tokens")


def text_content() -> Column:
    """A message's text: its string, or its text blocks joined by newlines."""
    blocks = F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit("")))
    return F.coalesce(F.col("text"), F.array_join(blocks, "\n"), F.lit(""))


def _starts(text: Column, marks) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | text.startswith(m)
    return out


def _interrupted_only() -> Column:
    b = F.col("blocks")[0]
    return F.coalesce((F.size("blocks") == 1) & (b["type"] == "text") & b["text"].startswith(INTERRUPTED), F.lit(False))


def is_user_chunk() -> Column:
    """What a user wrote: no tool results, tagged output or interruption."""
    string = (F.trim("text") != "") & ~_starts(F.trim("text"), SYSTEM_OUTPUT)
    listed = F.exists("blocks", lambda b: b["type"].isin("text", "image")) & ~_interrupted_only() & ~F.exists("blocks", lambda b: (b["type"] == "text") & F.coalesce(_starts(b["text"], SYSTEM_OUTPUT), F.lit(False)))
    return (F.col("type") == "user") & ~F.coalesce(F.col("isMeta"), F.lit(False)) & F.coalesce(string, listed, F.lit(False))


def is_hard_noise() -> Column:
    """Messages that no view shows."""
    t = F.trim("text")
    wrapped = F.lit(False)
    for tag in ("local-command-caveat", "system-reminder"):
        wrapped = wrapped | (t.startswith(f"<{tag}>") & t.endswith(f"</{tag}>"))
    empty = t.isin("<local-command-stdout></local-command-stdout>", "<local-command-stderr></local-command-stderr>")
    user = (F.col("type") == "user") & (F.coalesce(wrapped | empty | t.startswith(INTERRUPTED), F.lit(False)) | _interrupted_only())
    return F.col("type").isin("system", "summary", "file-history-snapshot", "queue-operation") | ((F.col("type") == "assistant") & (F.col("model") == "<synthetic>")) | user


def is_compact() -> Column:
    """Summaries that stand where a session was compacted."""
    return F.coalesce(F.col("isCompactSummary"), F.lit(False))


def harvest_text(raw: Column) -> Column:
    """String values of HARVEST_KEYS anywhere in an entry's JSON, key by key, joined by spaces.

    Escaped line ends and tabs become spaces, other escapes lose their backslash.
    """
    parts = [F.regexp_extract_all(raw, F.lit(f'"{k}"\\s*:\\s*"((?:[^"\\\\]|\\\\.)*)"'), F.lit(1)) for k in HARVEST_KEYS]
    joined = F.regexp_replace(F.array_join(F.concat(*parts), " "), r"\\\\", "\x00")  # a pair of backslashes is one, and escapes nothing after it
    return F.translate(F.regexp_replace(F.regexp_replace(joined, r"\\[ntr]", " "), r"\\(.)", "$1"), "\x00", "\\")


def turns(entries: DataFrame, body: Column, most: int = TURN_CHARS, least: int = 0) -> DataFrame:
    """(event_id, session_id, turn_idx, n_messages, body): each user entry opens a turn that the rest join.

    Entries before a session's first user entry belong to none.  Bodies stand in order,
    joined by newlines and cut at `most` characters; shorter ones than `least` go.
    """
    w = Window.partitionBy("session_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    placed = entries.where(F.col("type").isin("user", "assistant")).withColumn("turn_idx", F.sum((F.col("type") == "user").cast("long")).over(w)).where("turn_idx > 0")
    parts = F.array_sort(F.collect_list(F.struct("ordinal", body.alias("body"))))
    text = F.substring(F.array_join(F.filter(F.transform(parts, lambda p: p["body"]), lambda b: b != ""), "\n"), 1, most)
    out = placed.groupBy("session_id", "turn_idx").agg(F.count(F.lit(1)).alias("n_messages"), text.alias("body")).where(F.length("body") >= least)
    return out.select(F.concat(F.lit("turn-"), F.col("session_id").cast("string"), F.lit("-"), F.col("turn_idx").cast("string")).alias("event_id"), "session_id", "turn_idx", "n_messages", "body")


def rich_body() -> Column:
    """Text blocks and [Tool: argument] marks of a message."""
    argument = lambda b: F.coalesce(*[F.try_variant_get(b["input"], f"$.{k}", "string") for k in ("file_path", "command", "query", "url", "pattern", "description")], F.lit(""))
    part = F.transform("blocks", lambda b: F.when(b["type"] == "text", F.coalesce(b["text"], F.lit(""))).when(b["type"] == "tool_use", F.concat(F.lit("["), b["name"], F.lit(": "), argument(b), F.lit("]"))).otherwise(F.lit("")))
    return F.coalesce(F.col("text"), F.array_join(F.filter(part, lambda p: p != ""), "\n"), F.lit(""))


def turns_rich(messages: DataFrame) -> DataFrame:
    """Turns over messages with content, with tool marks; bodies of five characters or fewer go."""
    return turns(messages.where(F.length(rich_body()) > 0), rich_body(), RICH_CHARS, 6)


def blocks_of(messages: DataFrame) -> DataFrame:
    """One row for each content block, with its place."""
    keep = [c for c in ("session_id", "ordinal", "uuid", "type", "isMeta", "isSidechain", "toolUseResult", "cwd", "project", "ts") if c in messages.columns]
    return messages.select(*[F.col(c).alias("msg_type" if c == "type" else c) for c in keep], F.posexplode("blocks").alias("pos", "b")).select(*["msg_type" if c == "type" else c for c in keep], "pos", "b.*")


def tool_calls(messages: DataFrame) -> DataFrame:
    """tool_use blocks with id and name; tasks with their description and agent."""
    b = blocks_of(messages).where((F.col("type") == "tool_use") & (F.coalesce(F.col("id"), F.lit("")) != "") & (F.coalesce(F.col("name"), F.lit("")) != ""))
    task = F.col("name") == "Task"
    arg = lambda k: F.when(task, F.try_variant_get("input", f"$.{k}", "string")).alias(k)
    return b.select("session_id", "ordinal", "pos", F.col("id").alias("tool_use_id"), "name", "input", task.alias("is_task"), arg("description"), arg("subagent_type"))


def tool_results(messages: DataFrame) -> DataFrame:
    b = blocks_of(messages).where((F.col("type") == "tool_result") & (F.coalesce(F.col("tool_use_id"), F.lit("")) != ""))
    return b.select("session_id", "ordinal", "tool_use_id", F.col("content").alias("result"), F.coalesce("is_error", F.lit(False)).alias("is_error"))


def calls_with_results(messages: DataFrame) -> DataFrame:
    r = tool_results(messages).withColumnRenamed("ordinal", "result_ordinal")
    return tool_calls(messages).join(r, ["session_id", "tool_use_id"], "left")


def dedupe_requests(messages: DataFrame) -> DataFrame:
    """The last message of each requestId; messages without one stay."""
    has = F.coalesce(F.col("requestId"), F.lit("")) != ""
    w = Window.partitionBy("session_id", "requestId").orderBy(F.desc("ordinal"))
    last = messages.where(has).withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")
    return last.unionByName(messages.where(~has))


def session_metrics(messages: DataFrame) -> DataFrame:
    """Token sums after `dedupe_requests`, duration and message count before it."""
    names = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
    sums = dedupe_requests(messages).groupBy("session_id").agg(*[F.sum(n).alias(n) for n in names])
    millis = F.coalesce(F.unix_millis(F.max("ts")) - F.unix_millis(F.min("ts")), F.lit(0)).alias("duration_ms")
    all_rows = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("message_count"), millis)
    return all_rows.join(sums, "session_id").withColumn("total_tokens", sum((F.col(n) for n in names[1:]), F.col(names[0])))


def partition_messages(messages: DataFrame) -> DataFrame:
    """(session_id, counts by kind): user, real user, internal user, assistant, system, other, side and main thread."""
    user, meta = F.col("type") == "user", F.coalesce(F.col("isMeta"), F.lit(False))
    kinds = {"n_user": user, "n_real_user": is_user_chunk(), "n_internal_user": user & meta, "n_assistant": F.col("type") == "assistant", "n_system": F.col("type") == "system", "n_other": ~F.col("type").isin("user", "assistant", "system"), "n_sidechain": F.col("isSidechain"), "n_main": ~F.col("isSidechain")}
    return messages.groupBy("session_id").agg(*[F.count_if(c).alias(n) for n, c in kinds.items()])


def injected_tokens(text: Column) -> Column:
    """Tokens inside injected tags."""
    out = F.lit(0).cast("long")
    for tag in INJECTION_TAGS:
        inner = F.regexp_extract_all(text, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
        out = out + F.aggregate(F.coalesce(inner, F.array().cast("array<string>")), F.lit(0).cast("long"), lambda s, x: s + estimate_tokens(x))
    return out


def mention_tokens(text: Column) -> Column:
    """500 tokens for each file that is mentioned with @."""
    found = F.regexp_extract_all(text, F.lit(r"@([\w./~-]+\.\w+)"), F.lit(1))
    return F.coalesce(F.size(F.array_distinct(found)), F.lit(0)).cast("long") * 500


def _json(v: Column) -> Column:
    """Text of a variant: a string as it is, anything else as JSON."""
    return F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), F.to_json(v))


def token_attribution(messages: DataFrame) -> DataFrame:
    """(session_id, six token categories) of the main thread."""
    main = messages.where(~F.col("isSidechain"))
    real = (F.col("type") == "user") & ~F.col("isMeta")
    texts = F.when(F.col("text").isNotNull(), F.array("text")).otherwise(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))))
    words = main.where(real).select("session_id", F.explode(texts).alias("t"))
    part = words.select("session_id", injected_tokens(F.col("t")).alias("i"), mention_tokens(F.col("t")).alias("m"), estimate_tokens(F.col("t")).alias("e"))
    user = part.groupBy("session_id").agg(F.sum("i").alias("claude_md"), F.sum("m").alias("mentioned_files"), F.sum(F.greatest(F.col("e") - F.col("i"), F.lit(0))).alias("user_messages"))
    b = blocks_of(main)
    said = F.when((F.col("msg_type") == "assistant") & (F.col("type") == "thinking"), estimate_tokens(F.col("thinking"))).when((F.col("msg_type") == "assistant") & (F.col("type") == "text"), estimate_tokens(F.col("text")))
    task = F.when((F.col("msg_type") == "assistant") & (F.col("type") == "tool_use") & F.col("name").isin(*COORDINATION_TOOLS), estimate_tokens(_json(F.col("input"))))
    output = F.when((F.col("msg_type") == "user") & F.col("isMeta") & (F.col("type") == "tool_result"), estimate_tokens(_json(F.col("content"))))
    rest = b.groupBy("session_id").agg(F.sum(said).alias("thinking_text"), F.sum(task).alias("task_coordination"), F.sum(output).alias("tool_outputs"))
    out = messages.select("session_id").distinct().join(user, "session_id", "left").join(rest, "session_id", "left")
    return out.select("session_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in CATEGORIES])


def attribution_shares(attribution: DataFrame) -> DataFrame:
    """Add total, the share of each category (0 without tokens), and the largest category, the first of equals."""
    total = sum((F.col(c) for c in CATEGORIES[1:]), F.col(CATEGORIES[0]))
    best = F.greatest(*CATEGORIES)
    dominant = F.coalesce(*[F.when((F.col(c) == best) & (total > 0), c) for c in CATEGORIES])
    shares = {f"{c}_share": F.when(total > 0, F.round(F.col(c) / total, 6)).otherwise(0.0) for c in CATEGORIES}
    return attribution.withColumns({"total": total, **shares, "dominant": dominant})


def ongoing(messages: DataFrame) -> DataFrame:
    """(session_id, ongoing): whether an assistant still works, by its activity after the last ending."""
    b = blocks_of(messages)
    at = F.struct("ordinal", "pos")
    assistant, user = F.col("msg_type") == "assistant", F.col("msg_type") == "user"
    called = assistant & (F.col("type") == "tool_use") & (F.coalesce(F.col("id"), F.lit("")) != "")
    shutdown = called & (F.col("name") == "SendMessage") & F.coalesce((F.try_variant_get("input", "$.type", "string") == "shutdown_response") & F.try_variant_get("input", "$.approve", "boolean"), F.lit(False))
    closed = b.where(shutdown).groupBy("session_id", F.col("id").alias("tool_use_id")).agg(F.min("ordinal").alias("closed_at"))
    rows = b.withColumn("shutdown", shutdown).join(closed, ["session_id", "tool_use_id"], "left")
    rejected = F.coalesce(F.try_variant_get("toolUseResult", "$", "string") == REJECTED, F.lit(False)) if "toolUseResult" in b.columns else F.lit(False)
    result = user & (F.col("type") == "tool_result") & (F.coalesce(F.col("tool_use_id"), F.lit("")) != "")
    stopped = result & (rejected | F.coalesce(F.col("closed_at") < F.col("ordinal"), F.lit(False)))
    ending = (called & ((F.col("name") == "ExitPlanMode") | F.col("shutdown"))) | (assistant & (F.col("type") == "text") & (F.trim("text") != "")) | stopped | (user & (F.col("type") == "text") & F.col("text").startswith(INTERRUPTED))
    active = (assistant & (F.col("type") == "thinking") & (F.coalesce(F.col("thinking"), F.lit("")) != "")) | (called & ~ending) | (result & ~stopped)
    last = rows.groupBy("session_id").agg(F.max(F.when(F.coalesce(ending, F.lit(False)), at)).alias("end"), F.max(F.when(F.coalesce(active, F.lit(False)), at)).alias("act"))
    state = F.col("act").isNotNull() & (F.col("end").isNull() | (F.col("act") > F.col("end")))
    return messages.select("session_id").distinct().join(last.select("session_id", state.alias("on")), "session_id", "left").select("session_id", F.coalesce("on", F.lit(False)).alias("ongoing"))


def _phases(messages: DataFrame) -> DataFrame:
    """Boundaries (compact summaries of the main thread) with the context before and after each."""
    counted = (F.col("type") == "assistant") & (F.col("model") != "<synthetic>") & (context_tokens() > 0)
    main = messages.where(~F.col("isSidechain")).withColumn("used", F.when(counted, context_tokens()))
    back = Window.partitionBy("session_id").orderBy("ordinal")
    phase = F.sum(F.col("isCompactSummary").cast("long")).over(back.rowsBetween(Window.unboundedPreceding, 0))
    seen = main.withColumn("phase", phase).withColumn("pre", F.last("used", True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    first = seen.groupBy("session_id", "phase").agg(F.min_by("used", F.when(F.col("used").isNotNull(), F.col("ordinal"))).alias("post"))
    bound = seen.where("isCompactSummary").select("session_id", "uuid", "ordinal", "phase", F.coalesce("pre", F.lit(0)).alias("pre_tokens"))
    return bound.join(first, ["session_id", "phase"], "left").withColumn("post_tokens", F.coalesce("post", F.lit(0))).drop("post")


def compaction_events(messages: DataFrame) -> DataFrame:
    """(session_id, uuid, phase, pre_tokens, post_tokens, compression) of each compaction."""
    ratio = F.when(F.col("pre_tokens") > 0, F.round(1 - F.col("post_tokens") / F.col("pre_tokens"), 6))
    return _phases(messages).select("session_id", "uuid", "phase", "pre_tokens", "post_tokens", ratio.alias("compression"))


def compaction_phases(messages: DataFrame) -> DataFrame:
    """(session_id, phase, contribution, peak_tokens, post_tokens): what each phase between compactions added to the context.

    A session without counted usage has no phases.
    """
    counted = (F.col("type") == "assistant") & (F.col("model") != "<synthetic>") & (context_tokens() > 0) & ~F.col("isSidechain")
    final = messages.where(counted).groupBy("session_id").agg(F.max_by(context_tokens(), "ordinal").alias("last_tokens"))
    bounds = _phases(messages).join(final, "session_id")
    w = Window.partitionBy("session_id").orderBy("phase")
    done = bounds.select("session_id", "phase", (F.col("pre_tokens") - F.coalesce(F.lag("post_tokens").over(w), F.lit(0))).alias("contribution"), F.col("pre_tokens").alias("peak_tokens"), "post_tokens")
    last = bounds.groupBy("session_id").agg(F.max("phase").alias("phase"), F.max_by("post_tokens", "phase").alias("post"))
    tail = final.join(last, "session_id", "left")
    added = F.when(F.col("phase").isNull(), F.col("last_tokens")).when(F.col("post") > 0, F.col("last_tokens") - F.col("post")).otherwise(0)
    return done.union(tail.select("session_id", F.coalesce(F.col("phase") + 1, F.lit(1)).alias("phase"), added.alias("contribution"), F.col("last_tokens").alias("peak_tokens"), F.lit(None).cast("long").alias("post_tokens")))


def compaction_summary(messages: DataFrame) -> DataFrame:
    """(session_id, compactions, phases, consumption)."""
    p = compaction_phases(messages)
    return p.groupBy("session_id").agg((F.count(F.lit(1)) - 1).alias("compactions"), F.count(F.lit(1)).alias("phases"), F.sum("contribution").alias("consumption"))


def message_category(messages: DataFrame) -> DataFrame:
    """(session_id, ordinal, category) of the main thread's user and assistant messages."""
    text = text_content()
    reminders = F.regexp_extract_all(text, F.lit("(?s)(<system-reminder>.*?</system-reminder>)"), F.lit(1))
    inside = F.aggregate(reminders, F.lit(0).cast("long"), lambda s, x: s + estimate_tokens(x))
    category = (
        F.when(F.col("type") == "assistant", "thinking_text")
        .when((F.col("type") == "user") & F.col("isMeta"), "tool_outputs")
        .when((F.col("type") == "user") & ~F.col("isCompactSummary"), F.when(inside > estimate_tokens(text) * 0.5, "claude_md").otherwise("user_messages"))
    )
    return messages.where(~F.col("isSidechain")).select("session_id", "ordinal", category.alias("category")).where("category is not null")


def cache_timeline(messages: DataFrame) -> DataFrame:
    """(session_id, idx, ratio): share of the input read from the cache, for each counted assistant turn of the main thread."""
    rows = dedupe_requests(messages).where((F.col("type") == "assistant") & ~F.col("isSidechain") & (context_tokens() > 0))
    idx = F.row_number().over(Window.partitionBy("session_id").orderBy("ordinal")) - 1
    return rows.select("session_id", idx.cast("long").alias("idx"), F.round(F.col("cache_read_input_tokens") / context_tokens(), 6).alias("ratio"))


def session_summary(messages: DataFrame) -> DataFrame:
    """One row for each session: messages, context, dominant category, compactions, duration, tool calls, live state."""
    calls = tool_calls(messages).groupBy("session_id").agg(F.count(F.lit(1)).alias("tool_calls"))
    context = messages.where((F.col("type") == "assistant") & ~F.col("isSidechain") & (context_tokens() > 0)).groupBy("session_id").agg(F.max_by(context_tokens(), "ordinal").alias("context_tokens"))
    cache = cache_timeline(messages).groupBy("session_id").agg(F.round(F.avg("ratio"), 6).alias("cache_ratio"))
    out = session_metrics(messages).select("session_id", "message_count", "duration_ms", "total_tokens")
    for part in (context, attribution_shares(token_attribution(messages)).select("session_id", "dominant"), compaction_summary(messages), calls, cache, ongoing(messages)):
        out = out.join(part, "session_id", "left")
    return out.fillna(0, ["tool_calls", "compactions", "context_tokens"])


def synth_tool_events(messages: DataFrame) -> DataFrame:
    """Events of tool calls: searches, fetches, commands, files."""
    arg = lambda k: F.coalesce(F.try_variant_get("input", f"$.{k}", "string"), F.lit(""))
    name = F.col("name")
    file = F.coalesce(F.nullif(arg("file_path"), F.lit("")), F.nullif(arg("path"), F.lit("")), F.lit("file"))
    summary = F.when(name == "WebSearch", F.concat(F.lit("Search: "), arg("query"))).when(name == "WebFetch", F.concat(F.lit("Fetched: "), arg("url"))).when(name == "Bash", F.substring(F.concat(F.lit("Bash: "), arg("command")), 1, 300)).when(name.isin("View", "Edit", "Write", "Replace", "StrReplace"), F.concat(name, F.lit(": "), file))
    kind = F.when(name.isin("WebSearch", "WebFetch"), "research").otherwise("tool_use")
    b = blocks_of(messages).where((F.col("msg_type") == "assistant") & (F.col("type") == "tool_use"))
    out = b.select(F.concat(F.lit("synth-"), F.coalesce("id", F.lit(""))).alias("event_id"), "session_id", "ordinal", kind.alias("type"), summary.alias("summary"), F.when(name == "WebFetch", arg("url")).otherwise("").alias("url"))
    return out.where("summary is not null")


def session_bounds(messages: DataFrame, root: str = "/") -> DataFrame:
    """(session_id, hours, actions, project): a milestone for each session that lasts, with its commonest working folder."""
    from tracelake.functions.text import project_from_cwd

    hours = F.round((F.unix_millis(F.max("ts")) - F.unix_millis(F.min("ts"))) / 3_600_000.0, 1)
    times = messages.groupBy("session_id").agg(hours.alias("hours"), F.count_if(F.col("type").isin("user", "assistant")).alias("actions"), F.max("project").alias("folder"))
    own = messages.select("session_id", project_from_cwd(F.col("cwd"), root).alias("p")).where("p <> ''").groupBy("session_id", "p").agg(F.count(F.lit(1)).alias("n"))
    main = own.groupBy("session_id").agg(F.max_by("p", F.struct("n", "p")).alias("p"))
    return times.where("hours > 0").join(main, "session_id", "left").select("session_id", "hours", "actions", F.coalesce("p", "folder").alias("project"))


def viewer_messages(messages: DataFrame) -> DataFrame:
    """Rows that the viewer lists, with role, model, content and kind of noise."""
    out = messages.where(F.col("type").isin("user", "assistant", "progress")).withColumn("content", text_content()).where("content <> ''")
    out = out.withColumn("noise", noise_class(F.col("content")))
    return out.select("session_id", "ordinal", "type", "role", "model", "isSidechain", "content", "noise", noise_summary(F.col("content"), F.col("noise")).alias("noise_summary"))
