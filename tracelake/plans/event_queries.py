"""Queries over events, pages, orders and lineitem: merging, filters, classifiers, sessions, graph, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import classify as cl
from tracelake.functions import links as li
from tracelake.functions import times as ti
from tracelake.functions.text import embedding_text, search_text
from tracelake.operators import facets as fa
from tracelake.operators import fusion as fu
from tracelake.operators import evaluate as ev
from tracelake.operators import sessions as se
from tracelake.operators import vectors as vx
from tracelake.plans import adapters as ad
from tracelake.plans.catalogue import query
from tracelake.sources import logs as lo

US = "epoch_us(ts)"
EVENTS = f"""e0 AS (SELECT *, event_type AS type, CASE WHEN {US} - lag({US}) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 21600000000 THEN 1 ELSE 0 END AS jump FROM events),
e AS (SELECT event_id, ts, user_id, type, value, user_id || '-' || CAST(sum(jump) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_id, 'p' || (user_id % 7) AS project FROM e0)"""
ROLL = """n AS (SELECT session_id, min(epoch_us(ts)) AS start_us, max(epoch_us(ts)) AS end_us, count(*) AS n_events, min(project) AS project FROM e GROUP BY session_id HAVING count(*) >= 2)"""
ORPHANS = """w AS (SELECT session_id, min(ts) AS start_ts, max(ts) AS end_ts, list(DISTINCT project) AS projects FROM e WHERE event_id % 5 <> 0 GROUP BY session_id),
o AS (SELECT event_id, ts, project, type FROM e WHERE event_id % 5 = 0)"""


def micros(name: str):
    return F.unix_micros(F.col(name)).alias(name.replace("_ts", "_us"))


def windows(spark, sf_dir):
    e = ad.events(spark, sf_dir)
    return e, se.session_windows(e.where("event_id % 5 <> 0"))


@query("""WITH a AS (SELECT event_id, event_type AS summary, CAST(user_id AS VARCHAR) AS cwd, 'changelog' AS source, 0 AS o FROM events WHERE event_id % 3 < 2
UNION ALL SELECT event_id, event_type || ' ' || user_id, substring(CAST(user_id AS VARCHAR), 1, 1), 'research', 1 FROM events WHERE event_id % 3 > 0)
SELECT event_id, arg_max(summary, length(summary) * 10 - o) AS summary, arg_max(cwd, length(cwd) * 10 - o) AS cwd, coalesce(arg_max(source, o) FILTER (WHERE source <> 'changelog'), 'changelog') AS source FROM a GROUP BY event_id""")
def merge_event_logs(spark, sf_dir):
    """Two overlapping logs with fields of different lengths, merged by id."""
    e = ad.table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    first = e.where("event_id % 3 < 2").select(F.col("event_id").cast("string"), F.col("event_type").alias("summary"), user.alias("cwd"))
    second = e.where("event_id % 3 > 0").select(F.col("event_id").cast("string"), F.concat_ws(" ", "event_type", user).alias("summary"), F.substring(user, 1, 1).alias("cwd"))
    merged = lo.merge_events(lo.union_logs({"changelog": first, "research": second}))
    return merged.select(F.col("event_id").cast("long"), "summary", "cwd", "source")


@query("SELECT event_id, epoch_us(ts) // 1000 AS from_iso, (epoch_us(ts) // 1000000) * 1000 AS from_seconds, epoch_us(ts) // 1000 AS from_millis FROM events")
def normalize_timestamps(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    iso, sec, mil = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.unix_seconds("ts").cast("string"), F.unix_millis("ts").cast("string")
    at = lambda c, mode: F.unix_millis(ti.normalize_ts(c, mode))
    return e.select("event_id", at(iso, "jsonl").alias("from_iso"), at(sec, "jsonl").alias("from_seconds"), at(mil, "search").alias("from_millis"))


@query("SELECT event_id, event_type FROM events WHERE event_id % 3 <> 0")
def new_events_only(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events").select("event_id", "event_type")
    return lo.new_only(e, e.where("event_id % 3 = 0"))


@query("SELECT user_id, arg_min(event_id, epoch_us(ts)) AS event_id, arg_min(value, epoch_us(ts)) AS value FROM events GROUP BY user_id")
def dedupe_points(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.col("ts").cast("timestamp").alias("ord"))
    return vx.dedupe_points(e, "user_id").select("user_id", "event_id", "value")


NOISY = "CASE event_id % 6 WHEN 0 THEN 'bridge_ping_received' WHEN 1 THEN 'milestone_agent_x' WHEN 2 THEN 'bridge_ping9' ELSE event_type END"


@query(f"SELECT event_id, type FROM (SELECT event_id, {NOISY} AS type, CASE WHEN event_id % 12 = 5 THEN 'agent_Plan' ELSE '' END AS milestone FROM events) WHERE type = event_type_ok(type) AND milestone = ''".replace("type = event_type_ok(type)", "type NOT LIKE 'bridge%' AND type NOT LIKE 'milestone%'"))
def high_signal_events(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events").select("event_id", F.expr(NOISY).alias("type"), F.when(F.col("event_id") % 12 == 5, "agent_Plan").otherwise("").alias("milestone"))
    return cl.high_signal(e).select("event_id", "type")


@query("SELECT event_id, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-22' AND TIMESTAMP '2024-01-25'")
def time_window_events(spark, sf_dir):
    as_of = F.lit("2024-01-31 12:00:00").cast("timestamp")
    e = ad.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ti.time_window(e, ti.resolve_time(F.lit("last week"), as_of), ti.resolve_time(F.lit("2024-01-25"), as_of)).select("event_id", "event_type")


PHRASES = ("today", "yesterday", "this morning", "tonight", "this hour", "this week", "last week", "this month", "last month", "3d", "12h", "45m", "2w", "1mo", "1y", "2024-01-05", "soon")


@query("""WITH p AS (SELECT event_id, ts, (['today', 'yesterday', 'this morning', 'tonight', 'this hour', 'this week', 'last week', 'this month', 'last month', '3d', '12h', '45m', '2w', '1mo', '1y', '2024-01-05', 'soon'])[event_id % 17 + 1] AS phrase FROM events)
SELECT event_id, phrase, epoch_us(CASE phrase WHEN 'today' THEN date_trunc('day', ts) WHEN 'yesterday' THEN date_trunc('day', ts) - INTERVAL 1 DAY WHEN 'this morning' THEN date_trunc('day', ts) + INTERVAL 6 HOUR WHEN 'tonight' THEN date_trunc('day', ts) + INTERVAL 21 HOUR
WHEN 'this hour' THEN date_trunc('hour', ts) WHEN 'this week' THEN date_trunc('week', ts) WHEN 'last week' THEN date_trunc('week', ts) - INTERVAL 7 DAY WHEN 'this month' THEN date_trunc('month', ts) WHEN 'last month' THEN date_trunc('month', date_trunc('month', ts) - INTERVAL 1 DAY)
WHEN '3d' THEN ts - INTERVAL 3 DAY WHEN '12h' THEN ts - INTERVAL 12 HOUR WHEN '45m' THEN ts - INTERVAL 45 MINUTE WHEN '2w' THEN ts - INTERVAL 14 DAY WHEN '1mo' THEN ts - INTERVAL 30 DAY WHEN '1y' THEN ts - INTERVAL 365 DAY WHEN '2024-01-05' THEN TIMESTAMP '2024-01-05' END) // 1000 AS at_ms FROM p""")
def resolve_times(spark, sf_dir):
    """Each event's time as the moment of asking, with one of the phrases."""
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("event_id") % len(PHRASES) + 1).cast("int"))
    e = ad.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), phrase.alias("phrase"))
    return e.select("event_id", "phrase", F.unix_millis(ti.resolve_time(F.col("phrase"), F.col("ts"))).alias("at_ms"))


HOST_RULES = (("blog", ("blog.",)), ("mobile", ("//m.",)), ("site", ("www.",)))


@query("""WITH c AS (SELECT page_id, CASE WHEN contains(lower(url), 'blog.') THEN 'blog' WHEN contains(lower(url), '//m.') THEN 'mobile' WHEN contains(lower(url), 'www.') THEN 'site' ELSE 'other' END AS category FROM pages)
SELECT page_id, category, CAST(CASE category WHEN 'research' THEN 0.7 ELSE 0.4 END AS DOUBLE) AS salience FROM c""")
def url_categories(spark, sf_dir):
    p = ad.table(spark, sf_dir, "pages").select("page_id", cl.url_category(F.col("url"), HOST_RULES).alias("category"))
    return p.select("page_id", "category", cl.salience(F.lit("fetch"), F.col("category")).alias("salience"))


SUBJECT = "CASE o_orderkey % 6 WHEN 0 THEN 'feat: ' WHEN 1 THEN 'fix(core): ' WHEN 2 THEN 'Update ' WHEN 3 THEN 'docs!: ' WHEN 4 THEN 'release v1.2 ' ELSE '' END || o_orderpriority"


@query(f"""WITH s AS (SELECT o_orderkey, {SUBJECT} AS subject FROM orders), k AS (SELECT *, CASE o_orderkey % 6 WHEN 0 THEN 'feature' WHEN 1 THEN 'fix' WHEN 2 THEN 'enhancement' ELSE 'other' END AS hook FROM s)
SELECT o_orderkey, hook, CASE o_orderkey % 6 WHEN 0 THEN 'feat' WHEN 1 THEN 'fix' WHEN 3 THEN 'docs' END AS strict,
CAST(round(CASE hook WHEN 'feature' THEN 0.7 WHEN 'fix' THEN 0.7 ELSE 0.5 END + CASE WHEN o_orderkey % 6 = 4 THEN 0.1 ELSE 0 END, 2) AS DOUBLE) AS salience FROM k""")
def commit_types(spark, sf_dir):
    o = ad.table(spark, sf_dir, "orders").select("o_orderkey", F.expr(SUBJECT).alias("subject"))
    out = o.withColumn("hook", cl.commit_type(F.col("subject"))).withColumn("strict", cl.commit_type(F.col("subject"), "strict"))
    return out.select("o_orderkey", "hook", "strict", cl.commit_salience(F.col("hook"), F.lit(1), F.col("subject")).alias("salience"))


@query("""WITH c AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'N') AS files_new, count(*) FILTER (WHERE l_returnflag = 'R') AS files_modified, count(*) FILTER (WHERE l_returnflag = 'A') AS files_deleted,
CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS lines_added, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS lines_removed FROM lineitem GROUP BY l_orderkey)
SELECT *, CASE WHEN files_new > 0 THEN CASE WHEN lines_added < 100 THEN 'bootstrap' ELSE 'construct' END ELSE CASE WHEN lines_added + lines_removed < 50 THEN 'surgical' ELSE 'rework' END END AS quadrant FROM c""")
def diff_quadrants(spark, sf_dir):
    status = F.translate("l_returnflag", "NRA", "AMD")
    changes = ad.table(spark, sf_dir, "lineitem").select("l_orderkey", status.alias("status"), F.col("l_quantity").cast("long").alias("added"), F.round(F.col("l_discount") * 100).cast("long").alias("removed"))
    return cl.diff_shape(changes, "l_orderkey")


@query("""SELECT page_id, concat_ws(' ', html, url) AS text, array_to_string((regexp_split_to_array(concat_ws(' | ', html, url, 'project: ' || (page_id % 3)), '\\s+'))[1:200], ' ') AS embed FROM pages""")
def event_texts(spark, sf_dir):
    """Searchable and embeddable text of pages as fetch events; the html stands for the summary."""
    p = ad.table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("summary"), (F.col("page_id") % 3).cast("string").alias("project"))
    return p.select("page_id", search_text(p.columns).alias("text"), embedding_text(p.columns).alias("embed"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN html || ' ' || url || ' evt-' || page_id || ' /work/' || (page_id % 3) WHEN 1 THEN 'evt-' || page_id WHEN 2 THEN 'session_end' ELSE '' END AS text FROM pages""")
def event_texts_cli(spark, sf_dir):
    """Searchable text by the command line's fields: whole pages, bare ids, bare milestones, and nothing."""
    fourth, own = F.col("page_id") % 4, lambda c: F.when(F.col("page_id") % 4 == 0, c)
    p = ad.table(spark, sf_dir, "pages").select(
        "page_id", own(F.col("html")).alias("summary"), own(F.col("url")).alias("url"), F.when(fourth < 2, F.concat(F.lit("evt-"), F.col("page_id").cast("string"))).alias("event_id"),
        F.when(fourth == 2, "session_end").alias("milestone"), own(F.concat(F.lit("/work/"), (F.col("page_id") % 3).cast("string"))).alias("cwd"), F.col("url").alias("title"),
    )
    return p.select("page_id", search_text(p.columns, "cli").alias("text"))


@query(f"""WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ts DESC, event_id) AS rank, count(*) OVER (PARTITION BY project) AS total FROM e)
SELECT project, event_id, rank, total FROM r WHERE rank <= 500""")
def browse_project(spark, sf_dir):
    return fu.browse(ad.events(spark, sf_dir)).select("project", "event_id", "rank", "total")


@query(f"WITH {EVENTS} SELECT type, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY ts DESC, event_id) AS rank FROM e WHERE project IN ('p1', 'p2')) WHERE rank <= 20")
def focus_project(spark, sf_dir):
    registry = spark.createDataFrame([("pair", "p1"), ("pair", "p2")], "alias string, project string")
    asked = spark.createDataFrame([("pair",)], "project string")
    return fu.focus(ad.events(spark, sf_dir), li.expand_alias(asked, registry)).select("type", "event_id", "rank")


@query(f"WITH {EVENTS}, {ROLL} SELECT session_id, start_us, end_us, n_events, project FROM n")
def session_rollup(spark, sf_dir):
    out = se.session_rollup(ad.events(spark, sf_dir))
    return out.select("session_id", micros("start_ts"), micros("end_ts"), "n_events", "project")


@query(f"WITH {EVENTS}, {ROLL} SELECT a.session_id AS a, b.session_id AS b, greatest(a.start_us, b.start_us) AS start_us, least(a.end_us, b.end_us) AS end_us FROM n a JOIN n b ON a.session_id < b.session_id AND a.start_us < b.end_us AND b.start_us < a.end_us WHERE a.project = b.project")
def session_overlaps(spark, sf_dir):
    """Overlapping sessions of the same project."""
    s = se.session_rollup(ad.events(spark, sf_dir), most_events=0)
    pairs = se.session_overlaps(s, by="project")
    return pairs.select("a", "b", F.unix_micros("overlap_start").alias("start_us"), F.unix_micros("overlap_end").alias("end_us"))


@query(f"WITH {EVENTS}, {ROLL} SELECT a.session_id AS a, b.session_id AS b, greatest(a.start_us, b.start_us) AS start_us, least(a.end_us, b.end_us) AS end_us FROM n a JOIN n b ON a.session_id < b.session_id AND a.start_us < b.end_us AND b.start_us < a.end_us")
def session_overlaps_all(spark, sf_dir):
    """All pairs of overlapping sessions, of the same project or not."""
    pairs = se.session_overlaps(se.session_rollup(ad.events(spark, sf_dir), most_events=0))
    return pairs.select("a", "b", F.unix_micros("overlap_start").alias("start_us"), F.unix_micros("overlap_end").alias("end_us"))


@query(f"WITH {EVENTS}, {ORPHANS} SELECT event_id, arg_max(session_id, epoch_us(start_ts)) AS session_id FROM o JOIN w ON ts BETWEEN start_ts AND end_ts AND list_contains(projects, project) GROUP BY event_id")
def orphan_match(spark, sf_dir):
    e, w = windows(spark, sf_dir)
    return se.attach_orphans(e.where("event_id % 5 = 0").select("event_id", "ts", "project"), w)


@query(f"""WITH {EVENTS}, {ORPHANS}, m AS (SELECT event_id, w.session_id, list_contains(projects, project) AS same, row_number() OVER (PARTITION BY event_id ORDER BY NOT list_contains(projects, project), start_ts, w.session_id) AS i FROM o JOIN w ON ts BETWEEN start_ts AND end_ts)
SELECT e.event_id, CASE WHEN e.event_id % 5 <> 0 THEN e.session_id ELSE m.session_id END AS session_id, CASE WHEN e.event_id % 5 <> 0 THEN 'own' WHEN m.event_id IS NULL THEN 'none' WHEN same THEN 'project' ELSE 'time' END AS matched FROM e LEFT JOIN m ON m.event_id = e.event_id AND i = 1 AND e.event_id % 5 = 0""")
def enrich_sessions(spark, sf_dir):
    e, w = windows(spark, sf_dir)
    lost = e.withColumn("session_id", F.when(F.col("event_id") % 5 != 0, F.col("session_id")))
    return se.enrich_sessions(lost, w).select("event_id", "session_id", "matched")


@query(f"WITH {EVENTS}, {ORPHANS} SELECT session_id, epoch_us(start_ts) AS start_us, epoch_us(end_ts) AS end_us, len(projects) AS n_projects FROM w")
def session_windows(spark, sf_dir):
    return windows(spark, sf_dir)[1].select("session_id", micros("start_ts"), micros("end_ts"), F.size("projects").cast("long").alias("n_projects"))


@query(f"""WITH j AS (SELECT user_id, ts, event_id, CASE WHEN {US} - lag({US}) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 21600000000 THEN 1 ELSE 0 END AS jump FROM events),
s AS (SELECT *, CAST(sum(jump) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM j)
SELECT user_id, segment, min({US}) AS start_us, max({US}) AS end_us, count(*) AS n_events FROM s GROUP BY user_id, segment""")
def work_segments(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return se.work_segments(e, ad.SESSION_GAP, "user_id").select("user_id", "segment", micros("start_ts"), micros("end_ts"), "n_events")


@query(f"""WITH j AS (SELECT event_id, ts, CASE WHEN lag(event_type) OVER o IS DISTINCT FROM event_type OR {US} - lag({US}) OVER o >= 300000000 THEN 1 ELSE 0 END AS jump FROM events WINDOW o AS (ORDER BY ts, event_id)),
s AS (SELECT *, sum(jump) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM j) SELECT event_id, first_value(event_id) OVER (PARTITION BY g ORDER BY ts, event_id) AS group_id FROM s""")
def event_groups(spark, sf_dir):
    return fa.event_groups(ad.table(spark, sf_dir, "events"), F.col("event_type"))


@query(f"WITH {EVENTS} SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'Legacy: ' || project || ' (' || strftime(ts, '%Y-%m-%d') || ')' ELSE session_id END AS session_id FROM e")
def legacy_sessions(spark, sf_dir):
    e = ad.events(spark, sf_dir)
    return se.legacy_sessions(e.withColumn("session_id", F.when(F.col("event_id") % 4 == 0, "unknown").otherwise(F.col("session_id")))).select("event_id", "session_id")


@query(f"WITH {EVENTS} SELECT event_id, count(*) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n_so_far FROM e")
def session_event_count(spark, sf_dir):
    return se.session_event_count(ad.events(spark, sf_dir)).select("event_id", "n_so_far")


PARENTS = f"""l AS (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent_event_id, {US} - lag({US}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
p AS (SELECT event_id, parent_event_id FROM l WHERE gap BETWEEN 0 AND 3600000000)"""


@query(f"WITH {PARENTS} SELECT * FROM p")
def parent_links(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return se.link_parents(e, ad.PARENT_WINDOW, key="user_id")


@query(f"""WITH l AS (SELECT event_id, user_id, lag(user_id) OVER o AS pu, lag(event_id) OVER o AS parent_event_id, {US} - lag({US}) OVER o AS gap FROM events WINDOW o AS (ORDER BY ts, event_id))
SELECT event_id, parent_event_id FROM l WHERE pu = user_id AND gap BETWEEN 0 AND 3600000000""")
def parent_links_log_tail(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return se.link_parents(e, ad.PARENT_WINDOW, "log_tail", "user_id")


@query(f"""WITH RECURSIVE {PARENTS}, st AS (SELECT event_id AS start_id FROM events WHERE event_id % 20 = 0),
up AS (SELECT start_id, start_id AS event_id FROM st UNION SELECT start_id, parent_event_id FROM up JOIN p USING (event_id)),
down AS (SELECT start_id, start_id AS event_id FROM st UNION SELECT start_id, p.event_id FROM down JOIN p ON p.parent_event_id = down.event_id)
SELECT start_id, event_id, CASE WHEN start_id = event_id THEN 'start' ELSE 'ancestor' END AS role FROM up UNION ALL SELECT start_id, event_id, 'descendant' FROM down WHERE start_id <> event_id""")
def thread_arc(spark, sf_dir):
    """Arcs of the query set: every event whose id is divisible by 20."""
    e = ad.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return se.thread(se.link_parents(e, ad.PARENT_WINDOW, key="user_id"), e.where("event_id % 20 = 0"))


@query("WITH r AS (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS id FROM events) SELECT id, event_id FROM r WHERE id % 3 = 0")
def related_events(spark, sf_dir):
    from pyspark.sql import Window

    e = ad.table(spark, sf_dir, "events")
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return se.related(e.select("event_id", F.array_compact(F.array(before)).alias("related_ids")), e.where("event_id % 3 = 0").select(F.col("event_id").alias("id")))


@query("SELECT event_type AS type, count(*) AS n FROM events GROUP BY event_type")
def type_distribution(spark, sf_dir):
    return fa.type_distribution(ad.table(spark, sf_dir, "events").withColumnRenamed("event_type", "type"))


@query(f"WITH {EVENTS} SELECT DISTINCT project FROM e")
def projects(spark, sf_dir):
    return fa.projects(ad.events(spark, sf_dir))


@query(f"""WITH {EVENTS}, {ROLL}, f AS (SELECT 'project' AS dim, project AS value, count(*) AS n FROM n GROUP BY project UNION ALL SELECT 'type_counts', type, count(*) FROM e WHERE session_id IN (SELECT session_id FROM n) GROUP BY type)
SELECT * FROM (SELECT dim, value, n, row_number() OVER (PARTITION BY dim ORDER BY n DESC, value) AS rank FROM f) WHERE dim = 'project' OR rank <= 6""")
def session_facets(spark, sf_dir):
    return fa.session_facets(se.session_rollup(ad.events(spark, sf_dir), most_events=0))


@query("""WITH x AS (SELECT page_id, regexp_extract_all(url, '([/A-Za-z0-9_.-]+\\.[a-zA-Z0-9]{1,8})', 1) AS found FROM pages)
SELECT DISTINCT page_id, entity FROM (SELECT page_id, unnest(found) AS entity FROM x) WHERE NOT regexp_matches(entity, '^[0-9].*\\.[0-9]') AND NOT ends_with(entity, '.md') AND NOT ends_with(entity, '.')""")
def query_entities(spark, sf_dir):
    from tracelake.functions.text import query_entities as entities

    return ad.table(spark, sf_dir, "pages").select("page_id", F.explode(entities(F.col("url"))).alias("entity"))


@query("""WITH x AS (SELECT page_id, unnest(regexp_extract_all(url, '([/A-Za-z0-9_.-]+\\.[a-zA-Z0-9]{1,8})', 1)) AS entity FROM pages),
y AS (SELECT DISTINCT * FROM x WHERE NOT regexp_matches(entity, '^[0-9].*\\.[0-9]') AND NOT ends_with(entity, '.md') AND NOT ends_with(entity, '.')),
g AS (SELECT page_id, entity FROM y WHERE page_id % 2 = 1 AND entity NOT IN (SELECT entity FROM y WHERE page_id % 2 = 0))
SELECT 'gap-' || page_id AS event_id, len(list(entity)) AS n_entities, array_to_string(list_sort(list(entity)), ' ') AS entities FROM g GROUP BY page_id""")
def phantom_gaps(spark, sf_dir):
    """Urls of odd pages as queries without results, those of even pages as the log."""
    p = ad.table(spark, sf_dir, "pages").select(F.col("page_id").alias("query_id"), F.col("url").alias("query"))
    found = ev.phantoms(p.where("query_id % 2 = 1"), p.where("query_id % 2 = 0"), p.where("query_id % 2 = 0"), "query", within=False)
    return ev.gap_events(found).select("event_id", F.size("unknown_entities").cast("long").alias("n_entities"), F.array_join("unknown_entities", " ").alias("entities"))


@query("""WITH x AS (SELECT page_id, url, unnest(regexp_extract_all(url, '([/A-Za-z0-9_.-]+\\.[a-zA-Z0-9]{1,8})', 1)) AS entity FROM pages WHERE page_id % 2 = 1),
y AS (SELECT DISTINCT page_id, entity FROM x WHERE NOT regexp_matches(entity, '^[0-9].*\\.[0-9]') AND NOT ends_with(entity, '.md') AND NOT ends_with(entity, '.')),
g AS (SELECT * FROM y WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.page_id % 2 = 0 AND contains(p.url, y.entity)))
SELECT 'gap-' || page_id AS event_id, len(list(entity)) AS n_entities, array_to_string(list_sort(list(entity)), ' ') AS entities FROM g GROUP BY page_id""")
def phantom_gaps_within(spark, sf_dir):
    """The same, where a name that is part of a longer one in the log is known."""
    p = ad.table(spark, sf_dir, "pages").select(F.col("page_id").alias("query_id"), F.col("url").alias("query"))
    even = p.where("query_id % 2 = 0")
    found = ev.phantoms(p.where("query_id % 2 = 1"), even, even, "query")
    return ev.gap_events(found).select("event_id", F.size("unknown_entities").cast("long").alias("n_entities"), F.array_join("unknown_entities", " ").alias("entities"))


@query(f"""WITH {EVENTS}, {ROLL}, c AS (SELECT session_id, string_agg(type || ':' || k, ',' ORDER BY type) AS types FROM (SELECT session_id, type, count(*) AS k FROM e GROUP BY session_id, type) GROUP BY session_id),
l AS (SELECT session_id, list(event_id || ' ' || type || ' by ' || user_id ORDER BY ts, event_id)[1:200] AS lines FROM e GROUP BY session_id)
SELECT session_id, types, len(lines) AS n_listed, array_to_string(lines, ', ') AS lines, project AS projects FROM n JOIN c USING (session_id) JOIN l USING (session_id)""")
def session_rollup_details(spark, sf_dir):
    """Counts by type, projects and the first 200 events of each session."""
    e = ad.events(spark, sf_dir).withColumn("summary", F.concat_ws(" by ", "type", "user_id"))
    out = se.session_rollup(e)
    types = F.array_join(F.transform(F.map_entries("type_counts"), lambda t: F.concat_ws(":", t["key"], t["value"])), ",")
    lines = F.array_join(F.transform("events", lambda x: F.concat_ws(" ", x["event_id"], x["line"])), ", ")
    return out.select("session_id", types.alias("types"), F.size("events").cast("long").alias("n_listed"), lines.alias("lines"), F.array_join("projects", ",").alias("projects"))
