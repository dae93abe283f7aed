"""Queries over conversations as transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions.classify import noise_class, noise_summary
from tracelake.functions.text import estimate_tokens
from tracelake.operators import sessions as se
from tracelake.operators import transcripts as tr
from tracelake.plans import adapters as ad
from tracelake.plans.catalogue import query

M = """m AS (SELECT conv_id AS session_id, turn AS ordinal, role, text, role = 'assistant' AS a, role = 'system' AS compact, CASE WHEN role = 'assistant' THEN conv_id || '-' || (turn // 4) END AS request,
CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END AS i, CASE WHEN role = 'assistant' THEN length(text) // 2 ELSE 0 END AS o, CASE WHEN role = 'assistant' THEN length(text) // 3 ELSE 0 END AS r, CASE WHEN role = 'assistant' THEN length(text) // 5 ELSE 0 END AS c FROM conversations),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, request ORDER BY ordinal DESC) AS n FROM m) WHERE n = 1 OR request IS NULL)"""
TOK = "CAST(ceil(length({0}) / 4.0) AS BIGINT)"
SUM = "CAST(coalesce(sum({0}), 0) AS BIGINT)"
INJECT = "list_sum(list_transform(regexp_extract_all(text, '<{0}>(.*?)</{0}>', 1, 's'), lambda x: ceil(length(x) / 4.0)))"
INJECTED = "CAST(" + " + ".join(f"coalesce({INJECT.format(t)}, 0)" for t in tr.INJECTION_TAGS) + " AS BIGINT)"
MENTION = "CAST(len(list_distinct(regexp_extract_all(text, '@([\\w./~-]+\\.\\w+)', 1))) * 500 AS BIGINT)"
#: The messages of `live_messages`: kind of a user's message, what it says, and an assistant's kind.
LIVE = """l0 AS (SELECT *, conv_id + turn AS k, coalesce(text, '') AS said FROM conversations),
m AS (SELECT conv_id AS session_id, turn AS ordinal, role, role = 'assistant' AS a, k, k % 6 AS spoken, said, CASE WHEN role = 'user' AND turn > 0 THEN CASE WHEN k % 7 = 0 THEN 'interruption' ELSE (['plain', 'result', 'reminder', 'mention', 'summary'])[k % 5 + 1] END END AS kind,
role = 'system' OR (role = 'user' AND turn > 0 AND k % 7 <> 0 AND k % 5 = 4) AS compact,
CASE WHEN role = 'assistant' THEN '' WHEN role = 'user' AND turn > 0 AND k % 7 = 0 THEN '[Request interrupted by user]' WHEN role = 'user' AND turn > 0 AND k % 5 = 2 THEN '<system-reminder>' || said || '</system-reminder>' || said WHEN role = 'user' AND turn > 0 AND k % 5 = 3 THEN said || ' @src/app.py @docs/a-b.md @src/app.py' ELSE said END AS text,
CASE WHEN role = 'assistant' THEN length(said) ELSE 0 END AS i, CASE WHEN role = 'assistant' THEN length(said) // 2 ELSE 0 END AS o, CASE WHEN role = 'assistant' THEN length(said) // 3 ELSE 0 END AS r, CASE WHEN role = 'assistant' THEN length(said) // 5 ELSE 0 END AS c FROM l0)"""
ATTRIBUTION = f"""u AS (SELECT session_id, a OR coalesce(kind = 'result', false) AS other, {INJECTED} AS inj, {MENTION} AS men, {TOK.format("text")} AS said_tokens,
CASE WHEN a THEN {TOK.format("said")} * ([1, 1, 2, 0, 0, 1])[spoken + 1] ELSE 0 END AS thk, CASE WHEN kind = 'result' THEN {TOK.format("said")} ELSE 0 END AS res,
CASE WHEN a AND spoken = 2 THEN CAST(ceil(length('{{"description":' || CAST(to_json(said) AS VARCHAR) || '}}') / 4.0) AS BIGINT) WHEN a AND spoken = 3 THEN CAST(ceil(length('{{"approve":true,"type":"shutdown_response"}}') / 4.0) AS BIGINT) ELSE 0 END AS task FROM m),
t AS (SELECT session_id, {SUM.format("CASE WHEN other THEN 0 ELSE inj END")} AS claude_md, {SUM.format("CASE WHEN other THEN 0 ELSE men END")} AS mentioned_files, {SUM.format("res")} AS tool_outputs, {SUM.format("thk")} AS thinking_text, {SUM.format("task")} AS task_coordination,
{SUM.format("CASE WHEN other THEN 0 ELSE greatest(said_tokens - inj, 0) END")} AS user_messages FROM u GROUP BY session_id)"""
ONGOING = """w AS (SELECT session_id, ordinal, CASE WHEN a THEN CASE spoken WHEN 0 THEN [trim(said) <> ''] WHEN 1 THEN [false, false] WHEN 2 THEN [false, trim(said) <> '', false] WHEN 5 THEN [false] ELSE [true] END
WHEN kind = 'interruption' THEN [true] WHEN kind = 'result' THEN [ordinal % 4 = 1 OR coalesce(lag(a AND spoken = 3) OVER (PARTITION BY session_id ORDER BY ordinal), false)] END AS ends FROM m),
e AS (SELECT session_id, ordinal * 10 + generate_subscripts(ends, 1) AS pos, unnest(ends) AS ending FROM w WHERE ends IS NOT NULL),
g AS (SELECT session_id, coalesce(max(pos) FILTER (WHERE NOT ending), -1) > coalesce(max(pos) FILTER (WHERE ending), -1) AS ongoing FROM e GROUP BY session_id)"""


@query("""WITH n AS (SELECT conv_id, turn, text, sum(CASE WHEN role <> 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS turn_idx FROM conversations)
SELECT 'turn-' || conv_id || '-' || turn_idx AS event_id, conv_id AS session_id, CAST(turn_idx AS BIGINT) AS turn_idx, count(*) AS n_messages, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE text <> ''), '')[1:50000] AS body FROM n WHERE turn_idx > 0 GROUP BY conv_id, turn_idx""")
def conversation_turns(spark, sf_dir):
    return tr.turns(ad.messages(spark, sf_dir), tr.text_content())


@query(f"SELECT conv_id, turn, {TOK.format('text')} AS tokens FROM conversations")
def message_tokens(spark, sf_dir):
    return ad.table(spark, sf_dir, "conversations").select("conv_id", "turn", estimate_tokens(F.col("text")).alias("tokens"))


@query(f"WITH {LIVE}, {ATTRIBUTION} SELECT * FROM t")
def token_attribution(spark, sf_dir):
    return tr.token_attribution(ad.live_messages(spark, sf_dir))


@query(f"""WITH {LIVE}, {ATTRIBUTION}, s AS (SELECT *, claude_md + mentioned_files + tool_outputs + thinking_text + task_coordination + user_messages AS total, greatest(claude_md, mentioned_files, tool_outputs, thinking_text, task_coordination, user_messages) AS best FROM t)
SELECT session_id, total, {", ".join(f"CASE WHEN total > 0 THEN round({c} / total, 6) ELSE 0.0 END AS {c}_share" for c in tr.CATEGORIES)},
CASE WHEN total = 0 THEN NULL WHEN claude_md = best THEN 'claude_md' WHEN mentioned_files = best THEN 'mentioned_files' WHEN tool_outputs = best THEN 'tool_outputs' WHEN thinking_text = best THEN 'thinking_text' WHEN task_coordination = best THEN 'task_coordination' ELSE 'user_messages' END AS dominant FROM s""")
def attribution_shares(spark, sf_dir):
    return tr.attribution_shares(tr.token_attribution(ad.live_messages(spark, sf_dir))).drop(*tr.CATEGORIES)


@query(f"WITH {M} SELECT session_id, ordinal FROM k")
def dedupe_requests(spark, sf_dir):
    return tr.dedupe_requests(ad.messages(spark, sf_dir)).select("session_id", "ordinal")


@query(f"""WITH {M}, s AS (SELECT session_id, {SUM.format('i')} AS input_tokens, {SUM.format('o')} AS output_tokens, {SUM.format('r')} AS cache_read_input_tokens, {SUM.format('c')} AS cache_creation_input_tokens FROM k GROUP BY session_id),
d AS (SELECT session_id, count(*) AS message_count, (max(ordinal) - min(ordinal)) * 30000 AS duration_ms FROM m GROUP BY session_id)
SELECT *, input_tokens + output_tokens + cache_read_input_tokens + cache_creation_input_tokens AS total_tokens FROM d JOIN s USING (session_id)""")
def session_metrics(spark, sf_dir):
    return tr.session_metrics(ad.messages(spark, sf_dir))


@query(f"""WITH {LIVE} SELECT session_id, count(*) FILTER (WHERE NOT a) AS n_user, count(*) FILTER (WHERE NOT a AND trim(text) <> '' AND kind IS DISTINCT FROM 'result' AND kind IS DISTINCT FROM 'interruption' AND NOT starts_with(trim(text), '<system-reminder>')) AS n_real_user,
count(*) FILTER (WHERE kind = 'result') AS n_internal_user, count(*) FILTER (WHERE a) AS n_assistant, CAST(0 AS BIGINT) AS n_system, CAST(0 AS BIGINT) AS n_other, CAST(0 AS BIGINT) AS n_sidechain, count(*) AS n_main FROM m GROUP BY session_id""")
def message_partition(spark, sf_dir):
    return tr.partition_messages(ad.live_messages(spark, sf_dir))


@query(f"WITH {M} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ordinal) - 1 AS idx, round(r / (i + r + c), 6) AS ratio FROM k WHERE a AND i + r + c > 0")
def cache_timeline(spark, sf_dir):
    return tr.cache_timeline(ad.messages(spark, sf_dir))


@query(f"WITH {LIVE}, {ONGOING} SELECT session_id, coalesce(ongoing, false) AS ongoing FROM (SELECT DISTINCT session_id FROM m) LEFT JOIN g USING (session_id)")
def ongoing_sessions(spark, sf_dir):
    return tr.ongoing(ad.live_messages(spark, sf_dir))


PHASES = """b AS (SELECT *, sum(CASE WHEN compact THEN 1 ELSE 0 END) OVER w AS phase, CASE WHEN a AND i + r + c > 0 THEN i + r + c END AS used FROM m WINDOW w AS (PARTITION BY session_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING)),
x AS (SELECT session_id, ordinal, phase, coalesce((SELECT arg_max(used, y.ordinal) FROM b y WHERE y.session_id = b.session_id AND y.ordinal < b.ordinal AND used IS NOT NULL), 0) AS pre,
coalesce((SELECT arg_min(used, y.ordinal) FROM b y WHERE y.session_id = b.session_id AND y.phase = b.phase AND used IS NOT NULL), 0) AS post FROM b WHERE compact),
l AS (SELECT session_id, arg_max(used, ordinal) AS last FROM b WHERE used IS NOT NULL GROUP BY session_id)"""


@query(f"WITH {LIVE}, {PHASES} SELECT session_id, session_id || '-' || ordinal AS uuid, CAST(phase AS BIGINT) AS phase, pre AS pre_tokens, post AS post_tokens, CASE WHEN pre > 0 THEN round(1 - post / pre, 6) END AS compression FROM x")
def compaction_events(spark, sf_dir):
    return tr.compaction_events(ad.live_messages(spark, sf_dir))


@query(f"""WITH {LIVE}, {PHASES}, d AS (SELECT session_id, phase, pre - coalesce(lag(post) OVER (PARTITION BY session_id ORDER BY phase), 0) AS contribution, pre AS peak_tokens, post AS post_tokens FROM x JOIN l USING (session_id)),
z AS (SELECT session_id, max(phase) AS phase, arg_max(post, phase) AS post FROM x GROUP BY session_id)
SELECT session_id, CAST(phase AS BIGINT) AS phase, contribution, peak_tokens, post_tokens FROM d UNION ALL
SELECT session_id, CAST(coalesce(phase + 1, 1) AS BIGINT), CASE WHEN phase IS NULL THEN last WHEN post > 0 THEN last - post ELSE 0 END, last, NULL FROM l LEFT JOIN z USING (session_id)""")
def compaction_phases(spark, sf_dir):
    return tr.compaction_phases(ad.live_messages(spark, sf_dir))


@query(f"""WITH {LIVE}, {PHASES}, p AS (SELECT session_id, sum(pre) AS past FROM x GROUP BY session_id), y AS (SELECT session_id, CAST(coalesce(past, 0) + last AS BIGINT) AS total_tokens FROM l LEFT JOIN p USING (session_id))
SELECT session_id, total_tokens, round(total_tokens / 1000, 6) AS windows, CASE WHEN total_tokens / 1000 < 0.15 THEN 'light' WHEN total_tokens / 1000 < 0.5 THEN 'moderate' WHEN total_tokens / 1000 < 1.5 THEN 'heavy' ELSE 'extreme' END AS band FROM y""")
def context_gauge(spark, sf_dir):
    """Load of a context window of 1,000 tokens, as the conversations are short."""
    m = ad.live_messages(spark, sf_dir)
    last = m.where((F.col("type") == "assistant") & (tr.context_tokens() > 0)).groupBy("session_id").agg(F.max_by(tr.context_tokens(), "ordinal").alias("context_tokens"))
    return se.context_gauge(last, tr.compaction_events(m), 1000)


@query(f"WITH {M} SELECT session_id, ordinal, CASE WHEN a THEN 'thinking_text' ELSE 'user_messages' END AS category FROM m WHERE NOT compact")
def message_category(spark, sf_dir):
    return tr.message_category(ad.messages(spark, sf_dir))


@query(f"WITH {M} SELECT session_id, ordinal, CASE WHEN a THEN 'assistant' ELSE 'user' END AS type, role, text AS content FROM m WHERE text <> ''")
def viewer_messages(spark, sf_dir):
    return tr.viewer_messages(ad.messages(spark, sf_dir)).select("session_id", "ordinal", "type", "role", "content")


MARKS = ["<task-notification><status>done</status><summary>x y</summary>", "<command-name>/go</command-name>", "<local-command-caveat>", "<local-command-stdout> out </local-command-stdout>", "Launching skill: review", "This session is being continued", ""]


@query(f"""WITH t AS (SELECT conv_id, turn, CAST(turn % 7 AS INTEGER) AS i FROM conversations)
SELECT conv_id, turn, ([{", ".join(repr(x) for x in ["task-notification", "slash-command", "command-caveat", "command-output", "skill-launch", "compaction-summary"])}, NULL])[i + 1] AS noise,
(['agent done: x y', '/go', 'local command output follows', 'out', 'launching review', 'session continuation summary', NULL])[i + 1] AS label FROM t""")
def noise_classes(spark, sf_dir):
    """Messages with a machine's mark put before them, by turn."""
    mark = F.element_at(F.array(*[F.lit(m) for m in MARKS]), (F.col("turn") % len(MARKS) + 1).cast("int"))
    t = ad.table(spark, sf_dir, "conversations").select("conv_id", "turn", mark.alias("text"))
    kind = noise_class(F.col("text"))
    return t.select("conv_id", "turn", kind.alias("noise"), noise_summary(F.col("text"), kind).alias("label"))


@query("""SELECT c.conv_id AS session_id, 't-' || c.conv_id || '-' || (c.turn // 2) AS tool_use_id, 'Bash' AS name, c.text AS command, c.turn AS ordinal, r.turn AS result_ordinal
FROM conversations c LEFT JOIN conversations r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1 WHERE c.turn % 2 = 0""")
def tool_calls_join(spark, sf_dir):
    """User turns as calls of a tool and the assistant turns after them as results, rendered as blocks and joined."""
    c = ad.table(spark, sf_dir, "conversations")
    use = F.concat_ws("-", F.lit("t"), "conv_id", F.floor(F.col("turn") / 2))
    call = F.struct(F.lit("tool_use").alias("type"), use.alias("id"), F.lit("Bash").alias("name"), F.struct(F.col("text").alias("command")).alias("input"))
    result = F.struct(F.lit("tool_result").alias("type"), use.alias("tool_use_id"), F.col("text").alias("content"), F.lit(False).alias("is_error"))
    block = "array<struct<type:string,text:string,thinking:string,id:string,name:string,input:variant,tool_use_id:string,content:variant,is_error:boolean>>"
    odd = F.col("turn") % 2 == 1
    m = c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("ordinal"), F.when(odd, "user").otherwise("assistant").alias("type"), F.lit(False).alias("isMeta"), F.lit(False).alias("isSidechain"), F.from_json(F.when(odd, F.to_json(F.array(result))).otherwise(F.to_json(F.array(call))), block).alias("blocks"))
    joined = tr.calls_with_results(m)
    return joined.select("session_id", "tool_use_id", "name", F.try_variant_get("input", "$.command", "string").alias("command"), "ordinal", "result_ordinal")


@query(f"""WITH {LIVE}, {PHASES}, {ONGOING}, z AS (SELECT session_id, count(*) AS n FROM x GROUP BY session_id), n AS (SELECT session_id, count(*) AS message_count, (max(ordinal) - min(ordinal)) * 30000 AS duration_ms, count(*) FILTER (WHERE a AND spoken IN (1, 2, 3, 4)) AS tool_calls FROM m GROUP BY session_id)
SELECT session_id, message_count, duration_ms, tool_calls, coalesce(last, 0) AS context_tokens, CASE WHEN last IS NULL THEN 0 ELSE coalesce(z.n, 0) END AS compactions, coalesce(ongoing, false) AS ongoing FROM n LEFT JOIN l USING (session_id) LEFT JOIN z USING (session_id) LEFT JOIN g USING (session_id)""")
def session_summaries(spark, sf_dir):
    out = tr.session_summary(ad.live_messages(spark, sf_dir))
    return out.select("session_id", "message_count", "duration_ms", "tool_calls", "context_tokens", F.col("compactions").cast("long"), "ongoing")


@query(f"WITH {LIVE}, {PHASES}, k0 AS (SELECT session_id, phase, CAST(pre AS DOUBLE) AS pre FROM x WHERE pre > 0), z AS (SELECT session_id, sum(pre) AS past FROM k0 GROUP BY session_id) SELECT session_id, CAST(phase AS BIGINT) AS phase, round(sum(pre) OVER (PARTITION BY session_id ORDER BY phase ROWS UNBOUNDED PRECEDING) / (past + coalesce(last, 0)), 6) AS share FROM k0 JOIN z USING (session_id) LEFT JOIN l USING (session_id)")
def context_splits(spark, sf_dir):
    m = ad.live_messages(spark, sf_dir)
    last = m.where((F.col("type") == "assistant") & (tr.context_tokens() > 0)).groupBy("session_id").agg(F.max_by(tr.context_tokens(), "ordinal").alias("context_tokens"))
    return se.phase_splits(last, tr.compaction_events(m))


PREDICATE_TEXTS = ["hello", " ", "<system-reminder>x</system-reminder>", "<local-command-stdout></local-command-stdout>", "[Request interrupted by user]", "<local-command-stderr>oh"]


@query("""WITH p AS (SELECT conv_id AS session_id, turn AS ordinal, role, CAST((conv_id + turn) % 6 AS INTEGER) AS i, turn % 11 = 0 AS meta FROM conversations)
SELECT session_id, ordinal, role = 'user' AND NOT meta AND i IN (0, 4) AS user_chunk, role = 'system' OR (role = 'user' AND i IN (2, 3, 4)) OR (role = 'assistant' AND ordinal % 5 = 0) AS hard_noise, role = 'system' AS compact FROM p""")
def message_predicates(spark, sf_dir):
    """Messages whose text is one of six, some of them meta, some of a synthetic model."""
    number = ((F.col("conv_id") + F.col("turn")) % len(PREDICATE_TEXTS) + 1).cast("int")
    block = "array<struct<type:string,text:string>>"
    m = ad.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("ordinal"), F.col("role").alias("type"), (F.col("turn") % 11 == 0).alias("isMeta"), (F.col("role") == "system").alias("isCompactSummary"),
        F.when(F.col("turn") % 5 == 0, "<synthetic>").otherwise("m").alias("model"), F.element_at(F.array(*[F.lit(t) for t in PREDICATE_TEXTS]), number).alias("text"), F.lit(None).cast(block).alias("blocks"),
    )
    return m.select("session_id", "ordinal", tr.is_user_chunk().alias("user_chunk"), tr.is_hard_noise().alias("hard_noise"), tr.is_compact().alias("compact"))


@query(f"""WITH {LIVE}, {ATTRIBUTION}, {PHASES}, {ONGOING}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, a, ordinal // 4 ORDER BY ordinal DESC) AS n FROM m) WHERE n = 1 OR NOT a),
sm AS (SELECT session_id, {SUM.format('i + o + r + c')} AS total_tokens, round(avg(round(r / (i + r + c), 6)) FILTER (WHERE a AND i + r + c > 0), 6) AS cache_ratio FROM k GROUP BY session_id),
dm AS (SELECT *, greatest(claude_md, mentioned_files, tool_outputs, thinking_text, task_coordination, user_messages) AS best FROM t),
ph AS (SELECT session_id, phase, pre - coalesce(lag(post) OVER (PARTITION BY session_id ORDER BY phase), 0) AS contribution FROM x JOIN l USING (session_id)
  UNION ALL SELECT session_id, coalesce(phase + 1, 1), CASE WHEN phase IS NULL THEN last WHEN post > 0 THEN last - post ELSE 0 END FROM l LEFT JOIN (SELECT session_id, max(phase) AS phase, arg_max(post, phase) AS post FROM x GROUP BY session_id) USING (session_id)),
pc AS (SELECT session_id, count(*) AS phases, {SUM.format('contribution')} AS consumption FROM ph GROUP BY session_id)
SELECT session_id, total_tokens, cache_ratio, phases, consumption, CASE best WHEN 0 THEN NULL {" ".join(f"WHEN {c} THEN '{c}'" for c in tr.CATEGORIES)} END AS dominant FROM sm JOIN dm USING (session_id) LEFT JOIN pc USING (session_id)""")
def session_summary_tokens(spark, sf_dir):
    """The rest of a session's summary: tokens, cache, phases and dominant category."""
    out = tr.session_summary(ad.live_messages(spark, sf_dir))
    return out.select("session_id", "total_tokens", "cache_ratio", "phases", F.col("consumption").cast("long").alias("consumption"), "dominant")


@query(f"""WITH {M}, v AS (SELECT session_id, ordinal, a, role, CASE WHEN a THEN 6 ELSE ordinal % 7 END AS i, CASE WHEN a THEN '' ELSE ([{", ".join(repr(x) for x in MARKS)}])[ordinal % 7 + 1] END || coalesce(text, '') AS content FROM m)
SELECT session_id, ordinal, CASE WHEN a THEN 'assistant' ELSE 'user' END AS type, role, 'm' AS model, false AS side, content, ([{", ".join(repr(x) for x in ["task-notification", "slash-command", "command-caveat", "command-output", "skill-launch", "compaction-summary"])}, NULL])[i + 1] AS noise,
CASE i WHEN 0 THEN 'agent done: x y' WHEN 1 THEN '/go' WHEN 2 THEN 'local command output follows' WHEN 3 THEN trim(regexp_replace(content, '<[^>]+>', '', 'g'))[1:80] WHEN 4 THEN 'launching ' || regexp_extract(content, '^Launching skill:\\s*([^\n]+)', 1) WHEN 5 THEN 'session continuation summary' END AS label FROM v WHERE content <> ''""")
def viewer_rows(spark, sf_dir):
    """Whole rows of the viewer, where each user's or system's text follows a machine's mark, by turn."""
    mark = F.element_at(F.array(*[F.lit(m) for m in MARKS]), (F.col("ordinal") % len(MARKS) + 1).cast("int"))
    m = ad.messages(spark, sf_dir).withColumn("text", F.when(F.col("role") != "assistant", F.concat(mark, F.coalesce("text", F.lit("")))))
    return tr.viewer_messages(m).select("session_id", "ordinal", "type", "role", "model", F.col("isSidechain").alias("side"), "content", "noise", F.col("noise_summary").alias("label"))
