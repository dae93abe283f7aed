"""Queries over the given tables rendered as logs and transcripts, read back and parsed, and over what hooks emit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions import classify as cl
from tracelake.functions import links as li
from tracelake.functions.text import display_text
from tracelake.operators import fusion as fu
from tracelake.operators import index as ix
from tracelake.operators import transcripts as tr
from tracelake.plans import adapters as ad
from tracelake.plans.catalogue import query
from tracelake.sources import logs as lo
from tracelake.sources.tables import new_path, stored


def pick(names: list[str], number: str) -> Column:
    """The name at a number modulo how many there are."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.col(number) % len(names) + 1).cast("int"))


def sql_pick(names: list[str], number: str) -> str:
    return "([" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + f"])[{number} % {len(names)} + 1]"


# --- logs ------------------------------------------------------------------------------


@query("""SELECT event_id, CAST(user_id AS VARCHAR) AS session_id, event_type || ' by ' || user_id AS summary, event_type AS type, epoch_us(ts) // 1000 AS at FROM events WHERE event_id % 50 <> 7""")
def parsed_log(spark, sf_dir):
    """Events written as lines of JSON, one in fifty cut off, then read and brought to common names."""
    e = ad.table(spark, sf_dir, "events")
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    fields = F.struct(F.col("event_id").cast("string").alias("event_id"), stamp.alias("timestamp"), F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("sessionId"), F.concat_ws(" by ", "event_type", "user_id").alias("display"))
    path = new_path(spark, "rendered-log")
    e.select(F.when(F.col("event_id") % 50 == 7, F.substring(F.to_json(fields), 1, 20)).otherwise(F.to_json(fields)).alias("value")).write.text(path)
    rows = lo.with_time(lo.normalize_fields(lo.read_log(spark, path)))
    return rows.select(F.col("event_id").cast("long").alias("event_id"), "session_id", "summary", "type", F.unix_millis("ts").alias("at"))


@query("""SELECT event_id, n AS total FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS rank, count(*) OVER () AS n FROM events WHERE user_id % 7 = 1) WHERE rank > 50 AND rank <= 150""")
def list_page(spark, sf_dir):
    """The second page and a half of a project's listing: 100 rows from the 51st, with the total."""
    rows, total = fu.list_events(ad.events(spark, sf_dir), 100, 50, "p1")
    return rows.select("event_id", F.lit(total).cast("long").alias("total"))


# Types and labels that emitted events carry.
KINDS = ["fetch", "research_search", "search_result", "context_compaction", "session_end_clear", "bridge_query_sent", "tool_file_edit", "tool_bash", "git_commit", "git_push", "memory_note", "other", ""]
LABELS = ["fetch", "search", "result", "compaction", "session end", "bridge query", "edit", "bash", "commit", "push", "memory", None, None]


@query(f"""SELECT event_id, CASE WHEN event_id % 13 < 11 THEN {sql_pick([str(x) for x in LABELS], "event_id")} WHEN event_id % 2 = 0 THEN event_type WHEN event_id % 13 = 11 THEN 'other' ELSE '?' END AS category FROM events""")
def event_categories(spark, sf_dir):
    source = F.when(F.col("event_id") % 2 == 0, F.col("event_type"))
    return ad.table(spark, sf_dir, "events").select("event_id", cl.event_category(pick(KINDS, "event_id"), source).alias("category"))


HOSTS = {"example.net": "arxiv.org", "example.com": "github.com", "example.org": "medium.com"}
REWRITTEN = "url"
for _old, _new in HOSTS.items():
    REWRITTEN = f"replace({REWRITTEN}, '{_old}', '{_new}')"
RULES = " ".join(f"WHEN {' OR '.join(f'contains(lower(u), {n!r})' for n in needles)} THEN '{name}'" for name, needles in cl.URL_RULES)


@query(f"SELECT page_id, CASE {RULES} ELSE 'other' END AS category FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN url ELSE {REWRITTEN} END AS u FROM pages)")
def url_categories_default(spark, sf_dir):
    """The library's own rules, over urls whose hosts stand for known ones but for every fifth page."""
    moved = F.col("url")
    for old, new in HOSTS.items():
        moved = F.replace(moved, F.lit(old), F.lit(new))
    u = F.when(F.col("page_id") % 5 == 0, F.col("url")).otherwise(moved)
    return ad.table(spark, sf_dir, "pages").select("page_id", cl.url_category(u).alias("category"))


@query("""WITH x AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS h, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS p FROM pages),
s AS (SELECT page_id, h || CASE WHEN p = '' THEN '/' WHEN length(p) > 50 THEN p[1:50] || '...' ELSE p END AS short FROM x)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN short WHEN 1 THEN 'seen ' || page_id WHEN 2 THEN short ELSE 'asked ' || page_id END AS shown FROM s""")
def display_texts(spark, sf_dir):
    """Pages as events: a fetch with its url, a summary, a bare url, a prompt."""
    kind, number = F.col("page_id") % 4, F.col("page_id").cast("string")
    e = ad.table(spark, sf_dir, "pages").select(
        "page_id", F.when(kind == 2, F.col("url")).alias("url"),
        F.when(kind == 0, F.concat(F.lit("Fetched: "), "url")).when(kind == 1, F.concat(F.lit("seen "), number)).alias("summary"),
        F.when(kind == 3, F.concat(F.lit("asked "), number)).alias("prompt"),
    )
    return e.select("page_id", display_text(e.columns).alias("shown"))


TOOLS = ["Edit", "Write", "Bash", "Bash", "Bash", "Read"]
PATHS = ["/src/a.py", "/x/node_modules/b.js", "/repo/.git/config", "/docs/c.md"]
COMMANDS = ["git commit -m done", "git push origin", "make test", "ls -la", "cat notes"]
RESPONSES = ["[main abc1234] feat: add a table", "[main 0badcafe12] fix(core): repair it", "nothing was changed", "[main fedcba9] update the notes v1.2"]
RAW = f"r AS (SELECT event_id, {sql_pick(TOOLS, 'event_id')} AS tool, {sql_pick(PATHS, 'event_id')} AS path, {sql_pick(COMMANDS, 'event_id')} AS command, {sql_pick(RESPONSES, '(event_id // 5)')} AS response FROM events)"


@query(f"""WITH {RAW}, k AS (SELECT *, tool IN ('Edit', 'Write') AND path NOT LIKE '%node_modules%' AND path NOT LIKE '%/.git/%' AS edit, tool = 'Bash' AND command NOT LIKE 'ls%' AND command NOT LIKE 'cat %' AS bash, regexp_extract(response, '([a-f0-9]{{7,}})', 1) AS hash FROM r),
c AS (SELECT *, bash AND command LIKE '%git commit%' AND hash <> '' AS committed, regexp_extract(response, '\\] (.+)', 1) AS message FROM k WHERE edit OR bash),
t AS (SELECT *, CASE WHEN committed THEN CASE WHEN starts_with(message, 'feat') THEN 'feature' WHEN starts_with(message, 'fix') THEN 'fix' ELSE 'enhancement' END END AS ct FROM c)
SELECT event_id, CASE WHEN edit THEN 'tool_file_edit' WHEN committed THEN 'git_commit' WHEN command LIKE '%git push%' THEN 'git_push' ELSE 'tool_bash' END AS type,
CASE WHEN edit THEN 'Modified: ' || path WHEN committed THEN '[' || ct || '] Commit ' || hash || ': ' || message WHEN command LIKE '%git push%' THEN 'Pushed: ' || command ELSE 'Ran: ' || command END AS summary,
CASE WHEN committed THEN hash END AS commit_hash, ct AS commit_type,
CAST(CASE WHEN edit THEN 0.4 WHEN committed THEN CASE ct WHEN 'enhancement' THEN 0.6 ELSE 0.7 END WHEN command LIKE '%git push%' THEN 0.6 ELSE 0.2 END AS DOUBLE) AS salience FROM t""")
def tool_event_rows(spark, sf_dir):
    """Events as raw calls of tools; the last response names a version, which weighs a tenth more."""
    raw = ad.table(spark, sf_dir, "events").withColumn("fifth", F.floor(F.col("event_id") / 5)).select(
        "event_id", pick(TOOLS, "event_id").alias("tool"), pick(PATHS, "event_id").alias("file_path"), pick(COMMANDS, "event_id").alias("command"), pick(RESPONSES, "fifth").alias("response")
    )
    return cl.tool_events(raw).select("event_id", "type", "summary", "commit_hash", "commit_type", "salience")


STAGES = ["PreCompact", "SessionEnd", "SubagentStop", "SubagentStop", "Notification"]
AGENT_NAMES = ["Explore", "Plan", "general-purpose", "reviewer"]


@query(f"""WITH r AS (SELECT event_id, {sql_pick(STAGES, 'event_id')} AS stage, event_type AS how, {sql_pick(AGENT_NAMES, '(event_id // 5)')} AS agent FROM events)
SELECT event_id, CASE stage WHEN 'PreCompact' THEN 'compaction_' || how WHEN 'SessionEnd' THEN 'session_end_' || how ELSE 'agent_' || agent END AS milestone,
CASE stage WHEN 'PreCompact' THEN 'Context compaction (' || how || ') — session at peak density' WHEN 'SessionEnd' THEN 'Session ended (' || how || ')' ELSE agent || ' agent completed' END AS description,
CAST(CASE stage WHEN 'SessionEnd' THEN 0.5 ELSE 0.4 END AS DOUBLE) AS salience FROM r WHERE stage <> 'Notification' AND (stage <> 'SubagentStop' OR agent <> 'reviewer')""")
def milestone_rows(spark, sf_dir):
    """Events as lifecycle rows of sessions."""
    raw = ad.table(spark, sf_dir, "events").withColumn("fifth", F.floor(F.col("event_id") / 5)).select(
        "event_id", pick(STAGES, "event_id").alias("event"), F.col("event_type").alias("trigger"), F.col("event_type").alias("reason"), pick(AGENT_NAMES, "fifth").alias("agent_type")
    )
    return cl.milestone_events(raw).select("event_id", "milestone", "description", "salience")


@query(f"""WITH r AS (SELECT event_id, user_id, {sql_pick(STAGES, 'event_id')} AS stage, event_type AS how, {sql_pick(AGENT_NAMES, '(event_id // 5)')} AS agent, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'work-' || event_id % 3 END AS branch, event_id % 6 AS dirty FROM events),
n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), c AS (SELECT r.*, CASE WHEN event_id % 7 = 0 THEN 0 ELSE n END AS n FROM r JOIN n USING (user_id))
SELECT event_id, n AS session_event_count, CASE stage WHEN 'PreCompact' THEN 'Context compaction (' || how || ') — session at peak density' WHEN 'SessionEnd' THEN 'Session ended (' || how || ')' ELSE agent || ' agent completed' END
|| ' [' || CASE WHEN branch <> '' THEN branch || ', ' || dirty || ' dirty, ' ELSE '' END || n || ' events]' AS rich_summary FROM c WHERE stage <> 'Notification' AND (stage <> 'SubagentStop' OR agent <> 'reviewer')""")
def milestone_summaries(spark, sf_dir):
    """Lifecycle rows of users' sessions with branch, changed files and the events of the session; every seventh has no session, a half no branch."""
    e = ad.table(spark, sf_dir, "events").withColumns({"fifth": F.floor(F.col("event_id") / 5), "user": F.col("user_id").cast("string")})
    branch = F.when(F.col("event_id") % 4 == 1, "").when(F.col("event_id") % 4 > 1, F.concat_ws("-", F.lit("work"), (F.col("event_id") % 3).cast("string")))
    raw = e.select(
        "event_id", F.when(F.col("event_id") % 7 > 0, F.col("user")).alias("session_id"), pick(STAGES, "event_id").alias("event"), F.col("event_type").alias("trigger"), F.col("event_type").alias("reason"),
        pick(AGENT_NAMES, "fifth").alias("agent_type"), branch.alias("git_branch"), (F.col("event_id") % 6).alias("git_dirty_files"),
    )
    return cl.milestone_events(raw, e.select(F.col("user").alias("session_id"))).select("event_id", "session_event_count", "rich_summary")


@query("""SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '/own.jsonl' WHEN user_id % 3 > 0 THEN '/logs/' || CASE user_id % 4 WHEN 0 THEN '-' WHEN 1 THEN '-' ELSE '-work-app.' || user_id % 4 END || '/' || user_id || '.jsonl' END AS transcript_path FROM events""")
def transcript_paths(spark, sf_dir):
    """Paths of events' transcripts, from project and session where the listing has that file; every tenth event names its own."""
    user, fourth = F.col("user_id").cast("string"), F.col("user_id") % 4
    e = ad.table(spark, sf_dir, "events").select(
        "event_id", "user_id", user.alias("sessionId"), F.when(fourth == 1, "").when(fourth > 1, F.concat(F.lit("/work/app."), fourth.cast("string"))).alias("project"),
        F.when(F.col("event_id") % 10 == 0, "/own.jsonl").when(F.col("event_id") % 10 == 1, "").alias("transcript_path"),
    )
    folder = F.when(fourth < 2, "-").otherwise(F.concat(F.lit("-work-app."), fourth.cast("string")))
    listing = e.where("user_id % 3 > 0").select(F.concat(F.lit("/logs/"), folder, F.lit("/"), "sessionId", F.lit(".jsonl")).alias("transcript_path"))
    return lo.normalize_fields(e, listing, "/logs/").select("event_id", "transcript_path")


@query(f"""WITH x AS (SELECT event_id, '/logs/user ' || user_id || '/' || event_type || '.jsonl' AS p, user_id % 5 <> 0 AS there FROM events),
y AS (SELECT event_id, CASE WHEN event_id % 3 < 2 THEN p END AS path, there, CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 'm' || event_id END AS uuid FROM x)
SELECT event_id, path, path IS NOT NULL AND NOT there AS stale, uuid AS message_uuid, CASE WHEN uuid IS NOT NULL AND event_id % 4 = 0 THEN event_id END AS message_ordinal,
CASE WHEN path IS NOT NULL THEN '{li.SCHEME}' || replace(replace(path, '/', '%2F'), ' ', '%20') || CASE WHEN uuid IS NOT NULL THEN '?uuid=' || uuid ELSE '' END END AS link FROM y""")
def resolved_links(spark, sf_dir):
    """Events with a link to a message, with a transcript's path alone, or with neither; every fifth user's transcripts are gone."""
    path = F.concat(F.lit("/logs/user "), F.col("user_id").cast("string"), F.lit("/"), "event_type", F.lit(".jsonl"))
    own = ad.table(spark, sf_dir, "events").select("event_id", "user_id", path.alias("p"))
    suffix = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("?uuid=m"), F.col("event_id").cast("string"))).otherwise("")
    e = own.select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(li.build_link(F.col("p")), suffix)).alias("deeplink"), F.when(F.col("event_id") % 3 == 1, F.col("p")).alias("transcript_path"))
    entries = own.where("event_id % 4 = 0").select(F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("uuid"), F.col("event_id").alias("ordinal"))
    found = li.resolve_links(e, own.where("user_id % 5 <> 0").select(F.col("p").alias("transcript_path")), entries)
    return found.select("event_id", "path", "stale", "message_uuid", "message_ordinal", "link")


@query("SELECT event_id, 'p' || (user_id % 7) AS project FROM events WHERE user_id % 7 IN (1, 3)")
def project_filters(spark, sf_dir):
    """One project by a part of its name whatever the case, another by a pattern."""
    e = ad.events(spark, sf_dir)
    return li.project_filter(e, "P1").unionByName(li.project_filter(e, "^P3$", "regex")).select("event_id", "project")


@query("""SELECT 'git-' || md5(CAST(o_orderkey AS VARCHAR))[1:7] AS event_id, o_orderkey,
'Commit ' || md5(CAST(o_orderkey AS VARCHAR))[1:7] || ': ' || o_orderpriority || CASE WHEN o_orderkey % 3 > 0 THEN ' | files: ' || CASE o_orderkey % 3 WHEN 1 THEN o_orderstatus || '.py' ELSE o_orderstatus || '.py, b.py' END ELSE '' END AS summary,
CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'https://host.org/team/repo/commit/' || md5(CAST(o_orderkey AS VARCHAR)) END AS url FROM orders""")
def commit_event_rows(spark, sf_dir):
    """Orders as commits with no, one or two files, a quarter without a remote."""
    o = ad.table(spark, sf_dir, "orders")
    name = F.concat("o_orderstatus", F.lit(".py"))
    files = F.when(F.col("o_orderkey") % 3 == 1, F.array(name)).when(F.col("o_orderkey") % 3 == 2, F.array(name, F.lit("b.py")))
    commits = o.select(F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("hash"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderpriority").alias("subject"), F.col("o_orderkey").cast("string").alias("author"), files.alias("files"), F.when(F.col("o_orderkey") % 4 > 0, "git@host.org:team/repo.git").alias("remote"))
    return lo.commit_events(commits).select("event_id", F.col("author").cast("long").alias("o_orderkey"), "summary", "url")


@query("""WITH k AS (SELECT unnest([0, 1, 2]) AS place)
SELECT page_id || '-r' || place AS event_id, CAST(page_id AS VARCHAR) AS parent_event_id, url || '/' || place AS url, 'hit ' || place AS title FROM pages, k WHERE place < page_id % 4 AND NOT (place = 1 AND page_id % 5 = 0)""")
def search_result_rows(spark, sf_dir):
    """Pages as searches whose answer lists up to three results, as a list or under a name; some have no url."""
    hits = F.filter(F.transform(F.array(*[F.lit(i) for i in range(3)]), lambda i: F.struct(F.when((i == 1) & (F.col("page_id") % 5 == 0), "").otherwise(F.concat_ws("/", "url", i.cast("string"))).alias("url"), F.concat(F.lit("hit "), i.cast("string")).alias("title"), i.alias("i"))), lambda h: h["i"] < F.col("page_id") % 4)
    listed = F.to_json(hits)
    answer = F.when(F.col("page_id") % 3 == 0, listed).when(F.col("page_id") % 3 == 1, F.concat(F.lit('{"links": '), listed, F.lit("}"))).otherwise(F.concat(F.lit('{"results": '), listed, F.lit("}")))
    e = ad.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("event_id"), answer.alias("tool_response"))
    return lo.explode_search_results(e).select("event_id", "parent_event_id", "url", "title")


@query("""SELECT CAST(page_id AS VARCHAR) AS id, 'memory-note' || page_id AS event_id, CASE WHEN page_id % 3 = 0 THEN 'memory_note' ELSE 'memory_fact' END AS type,
CASE WHEN page_id % 3 = 0 THEN 'note' || page_id ELSE 'name ' || page_id END || ': ' || CASE WHEN page_id % 3 = 2 THEN 'about ' || page_id ELSE 'see ' || url END AS summary, 'see ' || url AS body, 'team' || (page_id % 4) AS project FROM pages""")
def memory_notes(spark, sf_dir):
    """Pages as notes without front matter, with a name and kind, and with a description too."""
    n = F.col("page_id").cast("string")
    third = F.col("page_id") % 3
    front = F.when(third == 0, "").otherwise(F.concat(F.lit("---\nname: name "), n, F.lit("\ntype: fact\n"), F.when(third == 2, F.concat(F.lit("description: about "), n, F.lit("\n"))).otherwise(""), F.lit("---\n")))
    path = F.concat(F.lit("/notes/team"), (F.col("page_id") % 4).cast("string"), F.lit("/memory/note"), n, F.lit(".md"))
    notes = ad.table(spark, sf_dir, "pages").select(path.alias("path"), F.concat(front, F.lit("see "), "url").alias("value"), F.lit(ad.AS_OF).cast("timestamp").alias("modified"))
    out = lo.memory_events(notes)
    return out.select(F.regexp_extract("memory_path", r"note(\d+)\.md$", 1).alias("id"), "event_id", "type", "summary", "body", "project")


@query("SELECT event_id, event_type AS type, CAST(user_id AS VARCHAR) AS session_id FROM events")
def dual_written(spark, sf_dir):
    """The unified table after the events were written in two overlapping parts, the second twice."""
    e = ad.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("session_id"), "value")
    domain, unified = new_path(spark, "domain"), new_path(spark, "unified")
    for part in (e.where("event_id % 3 < 2"), e.where("event_id % 3 > 0"), e.where("event_id % 3 > 0")):
        lo.dual_sink(part, domain, unified)
    return spark.read.parquet(unified).select("event_id", "type", "session_id")


@query("SELECT event_id, event_type AS type, CAST(0.5 AS DOUBLE) AS salience FROM events")
def enriched_log(spark, sf_dir):
    """A log written with a weight as a new version, and read back."""
    e = ad.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("type"), cl.salience(F.col("event_type")).alias("salience"))
    return spark.read.parquet(lo.write_enriched(e, new_path(spark, "enriched"), "2024-02-01")).select("event_id", "type", "salience")


@query("SELECT vec_id, CAST(CASE WHEN vec_id % 2 = 0 THEN 0.9 ELSE 0.5 END AS DOUBLE) AS salience, CAST(NULL AS VARCHAR) AS parent_event_id, len(embedding) AS size FROM embeddings")
def stored_vectors(spark, sf_dir):
    """Vectors written with a weight for every second one, read back with the defaults."""
    path = new_path(spark, "vectors")
    ad.vectors(spark, sf_dir).withColumn("salience", F.when(F.col("vec_id") % 2 == 0, 0.9)).write.parquet(path)
    return lo.read_vectors(spark, path).select("vec_id", "salience", "parent_event_id", F.size("embedding").cast("long").alias("size"))


@query("SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS place FROM events")
def ordered_events(spark, sf_dir):
    """The place of each event in the listing, newest first."""
    e = ad.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ordered = lo.order_events(e).select("event_id")
    # a sorted frame's partitions are ranges in order, so places are counts before each partition plus the row's own place
    numbered = ordered.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    numbered = stored(numbered, "ordered-events")
    sizes = numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row for each partition
    return numbered.join(before, "part").select("event_id", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("place"))


# --- transcripts -----------------------------------------------------------------------


def _json_text(c: str) -> Column:
    """A string as JSON."""
    whole = F.to_json(F.array(F.col(c)))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as lines of transcripts (value, transcript_path, place).

    An assistant thinks its text, says it and calls a tool with it; a user at an odd
    turn answers the call before, else speaks; others are system lines.
    """
    c = ad.table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    j, turn, conv = _json_text("text"), F.col("turn").cast("string"), F.col("conv_id").cast("string")
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    tool = join('{"type": "tool_use", "id": "t-', conv, "-", turn, '", "name": "', pick(["Bash", "WebSearch", "Task"], "turn"), '", "input": {"', pick(["command", "query", "description"], "turn"), '": ', j, "}}")
    said = join('[{"type": "thinking", "thinking": ', j, '}, {"type": "text", "text": ', j, "}, ", tool, "]")
    answer = join('[{"type": "tool_result", "tool_use_id": "t-', conv, "-", (F.col("turn") - 1).cast("string"), '", "content": ', j, ', "is_error": ', F.when(F.col("turn") % 3 == 0, "true").otherwise("false"), "}]")
    content = F.when(F.col("role") == "assistant", said).when((F.col("role") == "user") & (F.col("turn") % 2 == 1), answer).otherwise(j)
    usage = F.when(F.col("role") == "assistant", join(', "usage": {"input_tokens": ', F.length("text").cast("string"), ', "output_tokens": ', turn, "}")).otherwise(F.lit(""))
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 1800), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    value = join('{"uuid": "u-', conv, "-", turn, '", "type": "', F.col("role"), '", "timestamp": "', stamp, '", "cwd": "/work/app', (F.col("turn") % 3).cast("string"), '/src", "message": {"role": "', F.col("role"), '", "content": ', content, usage, "}}")
    path = F.concat(F.lit("/logs/team/"), conv, F.lit(".jsonl"))
    return c.select(value.alias("value"), path.alias("transcript_path"), F.col("turn").alias("place"))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lo.parse_entries(lo.entry_rows(transcript_lines(spark, sf_dir)))


T = """t AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal, role = 'assistant' AS a, role = 'user' AND turn % 2 = 1 AS answer FROM conversations),
c AS (SELECT *, 't-' || conv_id || '-' || turn AS tool_use_id, (['Bash', 'WebSearch', 'Task'])[turn % 3 + 1] AS name FROM t WHERE a)"""


@query(f"""WITH {T} SELECT session_id, ordinal, role AS type, role, CASE WHEN a THEN length(text) ELSE 0 END AS input_tokens, CASE WHEN a THEN turn ELSE 0 END AS output_tokens, a AS has_usage,
CASE WHEN a THEN 3 WHEN answer THEN 1 END AS n_blocks, CASE WHEN NOT a AND NOT answer THEN text END AS text, 1704067200000 + turn * 1800000 AS at FROM t""")
def transcript_messages(spark, sf_dir):
    """Messages parsed from rendered transcripts."""
    return parsed(spark, sf_dir).select("session_id", "ordinal", "type", "role", "input_tokens", "output_tokens", "has_usage", F.when(F.col("blocks").isNotNull(), F.size("blocks")).alias("n_blocks"), "text", F.unix_millis("ts").alias("at"))


@query(f"WITH {T} SELECT session_id, ordinal, tool_use_id, name, name = 'Task' AS is_task, CASE WHEN name = 'Task' THEN text END AS description FROM c")
def tool_call_rows(spark, sf_dir):
    return tr.tool_calls(parsed(spark, sf_dir)).select("session_id", "ordinal", "tool_use_id", "name", "is_task", "description")


@query(f"WITH {T} SELECT session_id, ordinal, 't-' || conv_id || '-' || (turn - 1) AS tool_use_id, text AS result, turn % 3 = 0 AS is_error FROM t WHERE answer")
def tool_result_rows(spark, sf_dir):
    return tr.tool_results(parsed(spark, sf_dir)).select("session_id", "ordinal", "tool_use_id", F.try_variant_get("result", "$", "string").alias("result"), "is_error")


@query(f"""WITH {T}, b AS (SELECT session_id, ordinal, role, CASE WHEN a THEN CASE WHEN text = '' THEN '' ELSE text || chr(10) END || '[' || (['Bash', 'WebSearch', 'Task'])[turn % 3 + 1] || ': ' || text || ']' WHEN answer THEN '' ELSE text END AS body FROM t WHERE role IN ('user', 'assistant')),
n AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ordinal) AS turn_idx FROM b WHERE body <> ''),
s AS (SELECT session_id, turn_idx, count(*) AS n_messages, string_agg(body, chr(10) ORDER BY ordinal)[1:200000] AS body FROM n WHERE turn_idx > 0 GROUP BY session_id, turn_idx)
SELECT session_id, CAST(turn_idx AS BIGINT) AS turn_idx, n_messages, body FROM s WHERE length(body) >= 6""")
def rich_turns(spark, sf_dir):
    return tr.turns_rich(parsed(spark, sf_dir)).select("session_id", "turn_idx", "n_messages", "body")


@query(f"""WITH {T} SELECT 'synth-' || tool_use_id AS event_id, session_id, CASE name WHEN 'Bash' THEN 'tool_use' ELSE 'research' END AS type, CASE name WHEN 'Bash' THEN ('Bash: ' || text)[1:300] ELSE 'Search: ' || text END AS summary FROM c WHERE name <> 'Task'""")
def synth_event_rows(spark, sf_dir):
    return tr.synth_tool_events(parsed(spark, sf_dir)).select("event_id", "session_id", "type", "summary")


@query(f"""WITH {T}, w AS (SELECT session_id, 'app' || (turn % 3) AS p, count(*) AS n FROM t GROUP BY ALL), m AS (SELECT session_id, arg_max(p, (n, p)) AS project FROM w GROUP BY session_id)
SELECT session_id, round((max(turn) - min(turn)) * 0.5, 1) AS hours, count(*) FILTER (WHERE role IN ('user', 'assistant')) AS actions, any_value(project) AS project FROM t JOIN m USING (session_id) GROUP BY session_id HAVING max(turn) > min(turn)""")
def session_milestones(spark, sf_dir):
    return tr.session_bounds(parsed(spark, sf_dir), "/work").select("session_id", "hours", "actions", "project")


@query(f"""WITH {T}, x AS (SELECT session_id, ordinal, replace(replace(replace(text, chr(10), ' '), chr(13), ' '), chr(9), ' ') AS s, a, answer, (['command', 'query', 'description'])[turn % 3 + 1] AS k, (['Bash', 'WebSearch', 'Task'])[turn % 3 + 1] AS name FROM t)
SELECT session_id, ordinal, CASE WHEN NOT a THEN s WHEN k = 'query' THEN s || ' ' || s || ' ' || name ELSE s || ' ' || s || ' ' || name END AS harvested FROM x""")
def harvested_texts(spark, sf_dir):
    e = lo.entry_rows(transcript_lines(spark, sf_dir))
    return e.select("session_id", "ordinal", tr.harvest_text(F.col("raw")).alias("harvested"))


WORDS = "tion the est of"


@query("""WITH w AS (SELECT conv_id AS session_id, turn AS ordinal, lower(coalesce(text, '')) AS s FROM conversations)
SELECT session_id, ordinal, contains(s, 'tion') OR contains(s, 'the') OR contains(s, 'est') AS matches, CAST(len(list_filter(regexp_extract_all(s, '[a-z0-9]+'), lambda x: x IN ('tion', 'the', 'est'))) AS INTEGER) AS n_spans,
coalesce(list_sum(list_transform(list_filter(range(1, length(s) + 1), lambda i: (s[i : i + 2] IN ('the', 'est') AND NOT regexp_matches(s[i + 3 : i + 3], '[a-z0-9]') OR s[i : i + 3] = 'tion' AND NOT regexp_matches(s[i + 4 : i + 4], '[a-z0-9]')) AND (i = 1 OR NOT regexp_matches(s[i - 1 : i - 1], '[a-z0-9]'))), lambda i: i)), 0)::BIGINT AS starts FROM w""")
def found_messages(spark, sf_dir):
    """Whether each message holds a term, how many whole words are terms, and the sum of their places."""
    m = ad.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("ordinal"), "text")
    found = ix.find_in_messages(m, WORDS, by_message=True)
    total = F.aggregate(F.transform("spans", lambda p: p["start"].cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select("session_id", "ordinal", "matches", F.size("spans").alias("n_spans"), total.alias("starts"))
