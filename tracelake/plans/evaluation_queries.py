"""Queries that score retrieval: labels are the truth, quality is relevance, toxicity is noise."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.operators import evaluate as ev
from tracelake.operators import index as ix
from tracelake.plans import adapters as ad
from tracelake.plans.catalogue import query
from tracelake.plans.search_queries import BM25, VECTORS, hits, near
from tracelake.sources import logs as lo
from tracelake.sources.tables import new_path

JUDGED = f"""{BM25}, {VECTORS}, h AS (SELECT query_id, doc_id, rank, 'bm25' AS mode FROM r WHERE rank <= 50 UNION ALL SELECT query_id, doc_id, rank, 'semantic' FROM k WHERE rank <= 50
UNION ALL SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id), 'scan' FROM benchmark JOIN documents ON contains(lower(documents.text), lower(benchmark.text)) WHERE benchmark.text <> ''),
j AS (SELECT h.*, quality AS grade, CASE WHEN toxic = 1 THEN 'toxic' END AS noise FROM h LEFT JOIN labels USING (doc_id)),
pr AS (SELECT mode, query_id, {", ".join(f"round(count(*) FILTER (WHERE rank <= {k} AND coalesce(grade, 0) > 0) / least({k}, count(*)), 6) AS p_at_{k}" for k in (5, 10, 20))}, count(*) AS hits FROM j GROUP BY mode, query_id)"""


def judged(spark, sf_dir):
    """The first hits of each mode with their labels; a scan's hits stand in order of their ids."""
    labels = ad.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("grade"), F.when(F.col("toxic") == 1, "toxic").alias("noise"))
    both = hits(spark, sf_dir, 50).select("query_id", "doc_id", "rank", F.lit("bm25").alias("mode")).union(near(spark, sf_dir).select("query_id", "doc_id", "rank", F.lit("semantic")))
    found = ix.substring_scan(ad.table(spark, sf_dir, "documents").select("doc_id", F.lit("scan").alias("source"), "text"), ad.queries(spark, sf_dir), per_source=None)
    every = both.union(found.select("query_id", "doc_id", "rank", F.col("source").alias("mode")))
    return every.join(labels, "doc_id", "left")


@query(f"WITH {JUDGED} SELECT * FROM pr")
def precision_at_k(spark, sf_dir):
    return ev.precision_at(judged(spark, sf_dir), by=("mode", "query_id"))


@query(f"WITH {JUDGED} SELECT mode, noise, n, rank FROM (SELECT mode, coalesce(noise, 'unlabeled') AS noise, count(*) AS n, row_number() OVER (PARTITION BY mode ORDER BY count(*) DESC, coalesce(noise, 'unlabeled')) AS rank FROM j WHERE coalesce(grade, 0) = 0 GROUP BY mode, coalesce(noise, 'unlabeled')) WHERE rank <= 20")
def noise_breakdown(spark, sf_dir):
    return ev.noise_breakdown(judged(spark, sf_dir))


@query(f"WITH {JUDGED} SELECT mode, {', '.join(f'round(avg(p_at_{k}), 6) AS p_at_{k}' for k in (5, 10, 20))}, count(*) AS queries FROM pr GROUP BY mode")
def compare_modes(spark, sf_dir):
    return ev.compare_modes(ev.precision_at(judged(spark, sf_dir), by=("mode", "query_id")))


@query(f"""WITH {BM25}, g AS (SELECT DISTINCT item_id AS query_id, source AS head FROM benchmark, documents JOIN labels USING (doc_id) WHERE quality = 1),
f AS (SELECT DISTINCT query_id, source AS head FROM r JOIN documents USING (doc_id) WHERE rank <= 10)
SELECT query_id, count(f.head) AS found, count(*) AS relevant, round(count(f.head) / count(*), 6) AS recall FROM g LEFT JOIN f USING (query_id, head) GROUP BY query_id""")
def session_recall(spark, sf_dir):
    """Sources as sessions; those with a good document are relevant to every benchmark query."""
    docs = ad.table(spark, sf_dir, "documents")
    good = docs.join(ad.table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi").select(F.col("source").alias("session")).distinct()
    asked = ad.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    sessions = asked.join(good, F.lit(True)).withColumn("relevant", F.lit(True))  # sources times queries, the truth table's own size; Spark checks what it broadcasts
    found = hits(spark, sf_dir, 10).join(docs.select("doc_id", F.col("source").alias("session")), "doc_id")
    return ev.session_recall(found, sessions)


SHARES = f"""{BM25}, w AS (SELECT item_id AS query_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\\s]', '', 'g'), '\\s+'), lambda x: length(x) > 2 AND x NOT IN ({", ".join(repr(x) for x in ev.STOP_WORDS)})) AS words FROM benchmark),
v AS (SELECT query_id, doc_id, rank, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\\s]', '', 'g'), '\\s+'), lambda x: length(x) > 2) AS words FROM r JOIN documents USING (doc_id) WHERE rank <= 20),
sh AS (SELECT v.query_id, doc_id, rank, len(list_filter(w.words, lambda x: list_contains(v.words, x))) / len(w.words) AS share FROM v JOIN w USING (query_id))"""


@query(f"""WITH {SHARES}
SELECT query_id, doc_id, rank, CASE WHEN share >= 0.5 THEN 2 END AS grade FROM sh""")
def truth_matches(spark, sf_dir):
    """Benchmark texts as judged events of grade 2, matched to the hits by their words."""
    truth = ad.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(0).alias("place"), F.col("text").alias("summary"), F.lit(2).alias("grade"), F.lit(None).cast("string").alias("noise"))
    found = hits(spark, sf_dir, 20).join(ad.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("summary")), "doc_id").withColumn("session", F.lit(""))
    return ev.match_truth(found, truth).select("query_id", "doc_id", "rank", "grade")


@query(f"""WITH {SHARES}, g AS (SELECT DISTINCT source, CASE WHEN md5(source)[1:1] < '6' THEN 3 WHEN md5(source)[1:1] < 'b' THEN 2 ELSE 1 END AS grade FROM documents WHERE md5(source)[2:2] > '2')
SELECT query_id, doc_id, rank, CASE WHEN share >= 0.5 THEN 2 ELSE g.grade END AS grade FROM sh JOIN documents USING (doc_id) LEFT JOIN g USING (source)""")
def truth_sessions(spark, sf_dir):
    """The same with sources as judged sessions, whose names meet in their first twelve characters; roles and relevance by the names' letters."""
    docs, name = ad.table(spark, sf_dir, "documents"), F.md5(F.col("source").cast("binary"))
    asked = ad.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("summary"))
    truth = asked.select("query_id", F.lit(0).alias("place"), "summary", F.lit(2).alias("grade"), F.lit(None).cast("string").alias("noise"))
    first = F.substring("name", 1, 1)
    judged = docs.select(name.alias("name")).where("name is not null").distinct().select(
        F.concat(F.substring("name", 1, 12), F.lit("-part")).alias("session"), (F.substring("name", 2, 1) > "2").alias("relevant"), F.when(first < "6", "primary").when(first < "b", "secondary").otherwise("other").alias("role")
    )
    sessions = asked.select("query_id").join(judged, F.lit(True))  # the truth table's own size: queries times sources
    found = hits(spark, sf_dir, 20).join(docs.select("doc_id", F.col("text").alias("summary"), name.alias("session")), "doc_id")
    return ev.match_truth(found, truth, sessions).select("query_id", "doc_id", "rank", "grade")


@query("""SELECT 'q' || item_id AS query_id, place, CASE place WHEN 0 THEN text ELSE 'other ' || item_id END AS summary, CAST(CASE place WHEN 0 THEN 2 ELSE 0 END AS INTEGER) AS grade, CASE place WHEN 1 THEN 'old' END AS noise,
's' || (item_id % 7) AS session, item_id % 3 > 0 AS relevant, CASE WHEN item_id % 2 = 0 THEN 'primary' ELSE 'secondary' END AS role FROM benchmark, (SELECT unnest([0, 1]) AS place)""")
def judged_truth(spark, sf_dir):
    """Benchmark items written as files of judged queries, 64 a file, and read back."""
    item = F.col("item_id")
    event = lambda text, grade, noise: F.struct(text.alias("summary"), F.lit(grade).alias("grade"), F.lit(noise).cast("string").alias("noise"))
    session = F.struct((item % 3 > 0).alias("relevant"), F.when(item % 2 == 0, "primary").otherwise("secondary").alias("role"))
    judged = ad.table(spark, sf_dir, "benchmark").select(
        F.floor(item / 64).alias("file"), F.concat(F.lit("q"), item.cast("string")).alias("query"), F.array(event(F.col("text"), 2, None), event(F.concat(F.lit("other "), item.cast("string")), 0, "old")).alias("events"),
        F.create_map(F.concat(F.lit("s"), (item % 7).cast("string")), session).alias("sessions"),
    )
    path = new_path(spark, "truth")
    judged.groupBy("file").agg(F.to_json(F.collect_list(F.struct("query", "events", "sessions"))).alias("value")).write.partitionBy("file").text(path)
    events, sessions = lo.read_truth(spark, path)
    return events.join(sessions, "query_id").select("query_id", "place", "summary", "grade", "noise", "session", "relevant", "role")
