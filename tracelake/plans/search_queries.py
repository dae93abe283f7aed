"""Queries over documents, benchmark and embeddings: index, ranking, fusion, facets, serving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.text import scrub, tokenize
from tracelake.functions.text import tokenize
from tracelake.operators import facets as fa
from tracelake.operators import fusion as fu
from tracelake.operators import index as ix
from tracelake.operators import vectors as vx
from tracelake.operators.scrubbing import scrub_table
from tracelake.plans import adapters as ad
from tracelake.plans.catalogue import query
from tracelake.sources.tables import stored

TOKENS = "list_filter(regexp_split_to_array(lower(strip_accents({0})), '[^a-z0-9]+'), lambda x: x <> '')"
DOCS, TEXT = TOKENS.format("text"), "documents"
INDEX = f"""d AS (SELECT doc_id, unnest({DOCS}) AS term FROM documents),
p AS (SELECT term, doc_id, count(*) AS tf FROM d GROUP BY term, doc_id),
dl AS (SELECT doc_id, sum(tf) AS dl FROM p GROUP BY doc_id),
t AS (SELECT term, count(*) AS df FROM p GROUP BY term),
c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl)"""
QTERMS = f"""q AS (SELECT item_id AS query_id, unnest({DOCS}) AS term FROM benchmark),
qt AS (SELECT query_id, term, count(*) AS qtf FROM q GROUP BY query_id, term)"""
SCORES = """s AS (SELECT query_id, p.doc_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
FROM qt JOIN t USING (term) CROSS JOIN c JOIN p USING (term) JOIN dl ON dl.doc_id = p.doc_id WHERE ln((n - df + 0.5) / (df + 0.5)) > 0 GROUP BY query_id, p.doc_id),
r AS (SELECT query_id, doc_id, round(score, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 5) DESC, doc_id) AS rank FROM s)"""
BM25 = f"{INDEX},\n{QTERMS},\n{SCORES}"
DOT = "list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])) / sqrt(list_dot_product(CAST({0} AS DOUBLE[]), CAST({0} AS DOUBLE[])) * list_dot_product(CAST({1} AS DOUBLE[]), CAST({1} AS DOUBLE[])))"
COSINE = DOT.format("a.embedding", "b.embedding")
VECTORS = f"""v AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round({COSINE}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id IN (SELECT item_id FROM benchmark)),
k AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM v WHERE score >= 0.2)"""


def hits(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """The first n documents of each benchmark item, stored, as most queries read them more than once."""
    return stored(ix.bm25_top(ad.index(spark, sf_dir), ix.query_terms(ad.queries(spark, sf_dir)), n).select("query_id", "doc_id", "score", "rank"), "hits")


def near(spark: SparkSession, sf_dir: str, k: int = 50, floor: float = 0.2) -> DataFrame:
    """Nearest vectors of the vectors whose ids are benchmark items'."""
    v = ad.vectors(spark, sf_dir)
    items = ad.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")).distinct()
    asked = v.join(items, "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "embedding")
    return vx.knn(asked, v, k, floor).withColumnRenamed("vec_id", "doc_id")


def results(spark: SparkSession, sf_dir: str, n: int = 50) -> DataFrame:
    """The first hits with their document's project, type, source and a day."""
    docs = ad.corpus(spark, sf_dir).select("doc_id", "project", "type")
    day = F.timestamp_seconds(F.lit(1704067200) + (F.col("doc_id") % 60) * 86400)
    return hits(spark, sf_dir, n).join(docs, "doc_id").withColumn("ts", day).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "bm25+semantic").otherwise("bm25"))


RESULTS = f"""{BM25},
x AS (SELECT r.query_id, r.doc_id, r.score, r.rank, source AS project, lang AS type, strftime(make_timestamp((1704067200 + (doc_id % 60) * 86400) * 1000000), '%Y-%m-%d') AS day,
      CASE WHEN doc_id % 3 = 0 THEN 'bm25+semantic' ELSE 'bm25' END AS source FROM r JOIN documents USING (doc_id) WHERE rank <= 50)"""
VALUES = """f AS (SELECT query_id, doc_id, 'project' AS dim, project AS value FROM x UNION ALL SELECT query_id, doc_id, 'type', type FROM x
UNION ALL SELECT query_id, doc_id, 'month', day[1:7] FROM x UNION ALL SELECT query_id, doc_id, 'day', day FROM x
UNION ALL SELECT query_id, doc_id, 'source', unnest(string_split(source, '+')) FROM x)"""
FACETS = """g AS (SELECT query_id, dim, value, count(*) AS n FROM f GROUP BY query_id, dim, value),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id, dim ORDER BY CASE WHEN dim IN ('month', 'day') THEN value END DESC NULLS LAST, n DESC, value) AS rank FROM g),
b AS (SELECT * FROM h WHERE rank <= CASE dim WHEN 'month' THEN 6 WHEN 'day' THEN 7 ELSE 5 END)"""


@query("""WITH t AS (SELECT doc_id, string_split_regex(lower(text), '[^a-z0-9]+') AS parts FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(parts) AS n_parts, len(list_filter(parts, lambda x: x = '')) AS n_empty, md5(array_to_string(parts, ' ')) AS parts_md5 FROM t""")
def tokens_cli(spark, sf_dir):
    """Documents cut as the command line does: letters as they are, and what splitting leaves at the ends counts."""
    parts = tokenize(F.col("text"), folded=False, keep_empty=True)
    d = ad.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", parts.alias("parts"))
    empty = F.size(F.filter("parts", lambda t: t == ""))
    return d.select("doc_id", F.size("parts").cast("long").alias("n_parts"), empty.cast("long").alias("n_empty"), F.md5(F.array_join("parts", " ").cast("binary")).alias("parts_md5"))


@query(f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return ix.bm25_top(ad.index(spark, sf_dir), ix.query_terms(ad.queries(spark, sf_dir)), 10)


@query(f"WITH {BM25.replace('FROM documents)', chr(39).join(['FROM documents WHERE lang = ', 'en', ')']), 1)} SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10")
def bm25_filtered_idf(spark, sf_dir):
    found = ix.search(ad.corpus(spark, sf_dir), ad.queries(spark, sf_dir), "filtered", F.col("type") == "en")
    return ix.rank_hits(found, 10)


@query(f"""WITH {INDEX}, w AS (SELECT item_id AS query_id, ({DOCS})[1][1:3] AS prefix FROM benchmark),
qt AS (SELECT DISTINCT query_id, coalesce(term, prefix) AS term, 1 AS qtf FROM w LEFT JOIN t ON starts_with(term, prefix) WHERE length(prefix) >= 2), {SCORES}
SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10""")
def bm25_wildcard(spark, sf_dir):
    index = ad.index(spark, sf_dir)
    wild = ad.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.substring(F.get(tokenize(F.col("text")), 0), 1, 3), F.lit("*")).alias("query"))
    return ix.bm25_top(index, ix.expand_wildcards(wild, index.terms), 10)


@query(f"WITH {INDEX} SELECT term, df FROM t")
def index_terms(spark, sf_dir):
    return ad.index(spark, sf_dir).terms


@query(f"WITH {INDEX} SELECT term, doc_id, tf FROM p")
def index_postings(spark, sf_dir):
    return ad.index(spark, sf_dir).postings


@query(f"WITH {INDEX} SELECT term, df FROM t")
def index_incremental(spark, sf_dir):
    docs = ad.corpus(spark, sf_dir)
    grown = ix.build_index(docs.where("doc_id % 5 = 0"))
    for part in range(1, 5):  # five segments; what came before is offered again
        grown = ix.update_index(grown, docs.where(F.col("doc_id") % 5 <= part))
    return grown.terms


@query(f"""WITH {INDEX}, w AS (SELECT DISTINCT ({DOCS})[1][1:2] AS prefix FROM benchmark)
SELECT * FROM (SELECT prefix, term, df, row_number() OVER (PARTITION BY prefix ORDER BY df DESC, term) AS rank FROM w JOIN t ON starts_with(term, prefix) AND length(term) > length(prefix) WHERE length(prefix) >= 2) WHERE rank <= 8""")
def autocomplete_prefix(spark, sf_dir):
    prefixes = ad.table(spark, sf_dir, "benchmark").select(F.substring(F.get(tokenize(F.col("text")), 0), 1, 2).alias("prefix"))
    return ix.autocomplete(ad.index(spark, sf_dir).terms, prefixes)


@query(f"""WITH {INDEX}, w AS (SELECT DISTINCT ({DOCS})[3] AS keyword FROM benchmark),
a AS (SELECT term, df FROM t, c WHERE length(term) > 2 AND df > 1 AND df < n * 0.05 AND term NOT IN ({", ".join(repr(x) for x in ix.STOP_WORDS)})),
co AS (SELECT keyword, p.term, sum(p.tf) AS co, max(df) AS df FROM w JOIN p k ON k.term = keyword JOIN p ON p.doc_id = k.doc_id JOIN a ON a.term = p.term WHERE p.term <> keyword GROUP BY keyword, p.term)
SELECT * FROM (SELECT keyword, term, co, round(co / log2(df + 1), 5) AS score, row_number() OVER (PARTITION BY keyword ORDER BY round(co / log2(df + 1), 5) DESC, term) AS rank FROM co) WHERE rank <= 6""")
def coterms_topk(spark, sf_dir):
    keywords = ad.table(spark, sf_dir, "benchmark").select(F.get(tokenize(F.col("text")), 2).alias("keyword"))
    return ix.coterms(ad.index(spark, sf_dir), keywords)


@query(f"""WITH v AS (SELECT a.vec_id AS query_id, b.vec_id, round({COSINE}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 10 = 0)
SELECT * FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM v WHERE score >= 0.3) WHERE rank <= 5""")
def knn_cosine(spark, sf_dir):
    """Five nearest vectors of the query set: every vector whose id is divisible by ten."""
    v = ad.vectors(spark, sf_dir)
    return vx.knn(v.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v, 5, 0.3)


GATE = "CASE WHEN best > 0.35 THEN 'duplicate' WHEN best >= 0.25 THEN 'refinement' ELSE 'novel' END AS verdict"


@query(f"WITH m AS (SELECT a.vec_id, max(round({COSINE}, 6)) AS best FROM embeddings a, embeddings b WHERE a.vec_id % 3 <> 0 AND b.vec_id % 3 = 0 GROUP BY a.vec_id) SELECT vec_id, best, {GATE} FROM m")
def novelty_existing(spark, sf_dir):
    v = ad.vectors(spark, sf_dir)
    return vx.novelty_gate(v.where("vec_id % 3 <> 0"), v.where("vec_id % 3 = 0"), 0.35, 0.25)


@query(f"WITH m AS (SELECT a.vec_id, max(round({COSINE}, 6)) AS best FROM embeddings a, embeddings b WHERE a.vec_id % 3 <> 0 AND (b.vec_id % 3 = 0 OR b.vec_id < a.vec_id) GROUP BY a.vec_id) SELECT vec_id, best, {GATE} FROM m")
def novelty_any_earlier(spark, sf_dir):
    v = ad.vectors(spark, sf_dir)
    return vx.novelty_gate(v.where("vec_id % 3 <> 0"), v.where("vec_id % 3 = 0"), 0.35, 0.25, "any_earlier")


@query()
def novelty_greedy(spark, sf_dir):
    v = ad.vectors(spark, sf_dir)
    return vx.novelty_gate(v.where("vec_id % 3 <> 0"), v.where("vec_id % 3 = 0"), 0.35, 0.25, "greedy")


@query()
def novelty_lsh(spark, sf_dir):
    """Repeats among vectors whose id is no multiple of three, found by bands of hyperplanes."""
    v = ad.vectors(spark, sf_dir)
    return vx.novelty_gate(v.where("vec_id % 3 <> 0"), v.where("vec_id % 3 = 0"), 0.35, 0.25, "lsh")


RRF = """u AS (SELECT query_id, doc_id, {w} / (60 + rank) AS part, {w} AS salience, 'bm25' AS name, 0 AS place FROM r WHERE rank <= 500 UNION ALL SELECT query_id, doc_id, {w} / (60 + rank), {w}, 'semantic', 1 FROM k WHERE rank <= 50),
z AS (SELECT query_id, doc_id, round(sum(part), 9) AS score, string_agg(name, '+' ORDER BY place) AS sources, max(salience) AS salience FROM u GROUP BY query_id, doc_id)"""
WEIGHT = "CAST(CASE WHEN doc_id % 10 = 0 THEN 0.5 ELSE greatest(0.05, least(1.0, (doc_id % 10) / 10.0)) END AS DOUBLE)"


@query(f"WITH {BM25}, {VECTORS}, {RRF.format(w='1.0')} SELECT query_id, doc_id, score, sources FROM z")
def rrf_two_lists(spark, sf_dir):
    return fu.rrf({"bm25": hits(spark, sf_dir, fu.DEPTH), "semantic": near(spark, sf_dir)})


@query(f"WITH {BM25}, {VECTORS}, {RRF.format(w=WEIGHT)} SELECT query_id, doc_id, score, sources, CAST(salience AS DOUBLE) AS salience FROM z")
def rrf_salience(spark, sf_dir):
    weigh = lambda h: h.withColumn("salience", (F.col("doc_id") % 10) / 10.0)
    return fu.rrf({"bm25": weigh(hits(spark, sf_dir, fu.DEPTH)), "semantic": weigh(near(spark, sf_dir))}, weight="salience")


@query(f"""WITH {BM25}, {VECTORS}, {RRF.format(w="1.0")}, has AS (SELECT query_id, bool_or(a) AS k, bool_or(NOT a) AS s FROM (SELECT query_id, true AS a FROM r UNION ALL SELECT query_id, false FROM k WHERE rank <= 50) GROUP BY query_id),
raw AS (SELECT query_id, doc_id, max(score) AS raw FROM (SELECT query_id, doc_id, score FROM r UNION ALL SELECT query_id, doc_id, score FROM k WHERE rank <= 50) GROUP BY query_id, doc_id),
o AS (SELECT query_id, doc_id, CASE WHEN has.k AND s THEN score ELSE raw END AS score, CASE WHEN has.k AND s THEN sources WHEN has.k THEN 'bm25' ELSE 'semantic' END AS sources FROM raw JOIN has USING (query_id) LEFT JOIN z USING (query_id, doc_id) WHERE NOT (has.k AND s) OR score IS NOT NULL),
a AS (SELECT query_id, doc_id, sources, round(CASE WHEN ts IS NULL THEN score ELSE score * exp(-0.001 * greatest(0.0, (epoch_us(TIMESTAMP '2024-02-01') // 1000 - epoch_us(ts) // 1000) / 3600000.0)) END, 6) AS score FROM o LEFT JOIN events ON event_id = doc_id),
m AS (SELECT query_id, max(score) AS best FROM a GROUP BY query_id)
SELECT query_id, doc_id, score, sources FROM a JOIN m USING (query_id) WHERE score >= best * 0.1""")
def hybrid_decay_tail(spark, sf_dir):
    times = ad.table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"))
    semantic, depth = stored(near(spark, sf_dir), "near"), fu.DEPTH
    first = hits(spark, sf_dir, depth)
    # fusion takes the first of a list; where nothing is near, all keyword hits count
    alone = ix.query_terms(ad.queries(spark, sf_dir).join(semantic.where("score >= 0.2").select("query_id").distinct(), "query_id", "left_anti"))
    rest = ix.rank_hits(ix.bm25(ad.index(spark, sf_dir), alone)).where(F.col("rank") > depth)
    out = fu.hybrid_search(first.unionByName(rest), semantic, times, F.lit(ad.AS_OF).cast("timestamp"), floor=0.2)
    return out.select("query_id", "doc_id", "score", "sources")


@query(f"WITH {RESULTS}, {VALUES}, {FACETS} SELECT query_id, dim, value, n, rank FROM b")
def search_facets(spark, sf_dir):
    return fa.facets(results(spark, sf_dir))


@query(f"""WITH {RESULTS.replace("rank <= 50", "rank <= 600")}, {VALUES.replace("FROM x", "FROM x WHERE rank <= 500")}, g AS (SELECT query_id, dim, value, count(*) AS n FROM f WHERE value <> '' AND value <> '?' GROUP BY query_id, dim, value),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id, dim ORDER BY CASE WHEN dim IN ('month', 'day') THEN value END DESC NULLS LAST, n DESC, value) AS rank, count(*) OVER (PARTITION BY query_id, dim) AS k, CASE dim WHEN 'month' THEN 6 WHEN 'day' THEN 7 WHEN 'source' THEN 1000000 ELSE 8 END AS most FROM g)
SELECT query_id, dim, value, n, rank, greatest(k - most, 0) AS more FROM h WHERE rank <= most""")
def search_facets_cli(spark, sf_dir):
    """Facets of the command line over the first 500 of 600 results."""
    return fa.facets(results(spark, sf_dir, 600), "cli")


@query(f"""WITH {RESULTS} SELECT query_id, min(day) AS oldest, max(day) AS newest, count(*) AS total FROM x GROUP BY query_id""")
def facet_spans(spark, sf_dir):
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return fa.facet_span(results(spark, sf_dir)).select("query_id", day("oldest"), day("newest"), "total")


@query(f"WITH {RESULTS} SELECT query_id, doc_id, score, rank, project, type, source FROM x WHERE type IN ('en', 'fr') AND source = 'bm25+semantic'")
def facet_drill(spark, sf_dir):
    return fa.drill(results(spark, sf_dir), {"type": ["en", "fr"], "source": ["semantic"]}).select("query_id", "doc_id", "score", "rank", "project", "type", "source")


@query(f"""WITH {RESULTS}, {VALUES}, {FACETS}, l AS (SELECT query_id, dim, value, count(*) AS live FROM f JOIN x USING (query_id, doc_id) WHERE type = 'en' GROUP BY query_id, dim, value)
SELECT query_id, dim, value, n, rank, coalesce(live, 0) AS live FROM b LEFT JOIN l USING (query_id, dim, value)""")
def facet_live_counts(spark, sf_dir):
    found = results(spark, sf_dir)
    return fa.live_counts(fa.facets(found), fa.drill(found, {"type": ["en"]}))


@query(f"WITH {BM25} SELECT query_id AS session_id, doc_id AS key, rank FROM r WHERE rank <= 20 AND rank > 10")
def delta_serving(spark, sf_dir):
    """Second round of serving: what the first round of ten has not shown."""
    top = hits(spark, sf_dir, 20).select(F.col("query_id").alias("session_id"), F.col("doc_id").alias("key"), "rank", F.lit(1).alias("served_at"))
    return fu.delta_serve(top, top.where("rank <= 10"))[0].select("session_id", "key", "rank")


@query(f"""WITH {BM25}, h AS (SELECT query_id, doc_id, CASE WHEN rank <= 10 THEN 1 ELSE 2 END AS served_at FROM r WHERE rank <= 20),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY served_at DESC, doc_id) AS i, count(*) FILTER (WHERE served_at = 1) OVER (PARTITION BY query_id) AS suppressed FROM h)
SELECT query_id AS session_id, doc_id AS key, served_at, suppressed FROM n WHERE i <= 12""")
def delta_history(spark, sf_dir):
    """History of twelve keys after a second round, and how many rows that round held back."""
    top = hits(spark, sf_dir, 20).select(F.col("query_id").alias("session_id"), F.col("doc_id").alias("key"), "rank", F.lit(2).alias("served_at"))
    _, history, held = fu.delta_serve(top, top.where("rank <= 10").withColumn("served_at", F.lit(1)), 12)
    return history.join(held, "session_id").select("session_id", "key", "served_at", "suppressed")


@query(f"""WITH {BM25} SELECT query_id, doc_id, rank FROM (SELECT query_id, doc_id, rank, text[1:120] AS head, row_number() OVER (PARTITION BY query_id, text[1:120], CASE WHEN text = '' THEN doc_id END ORDER BY rank, doc_id) AS i
FROM r JOIN documents USING (doc_id) WHERE rank <= 50) WHERE i = 1""")
def collapse_results(spark, sf_dir):
    text = ad.corpus(spark, sf_dir).select("doc_id", "text")
    return fu.collapse_by_text(hits(spark, sf_dir, 50).join(text, "doc_id")).select("query_id", "doc_id", "rank")


@query(f"WITH {BM25} SELECT query_id, CAST(floor(sum(length(text)) / 4) AS BIGINT) AS tokens, round(floor(sum(length(text)) / 4) * 100.0 / 200000, 4) AS percent FROM r JOIN documents USING (doc_id) WHERE rank <= 10 GROUP BY query_id")
def context_cost(spark, sf_dir):
    text = ad.corpus(spark, sf_dir).select("doc_id", "text")
    return fu.context_cost(hits(spark, sf_dir, 10).join(text, "doc_id"))


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '/(?:Users|home)/[A-Za-z0-9._-]+', '~', 'g'), 'tion', 'xxx', 'gi'), 'the', 'yy', 'gi') AS text FROM documents")
def scrub_text(spark, sf_dir):
    return ad.table(spark, sf_dir, "documents").select("doc_id", scrub(F.col("text"), {"the": "yy", "tion": "xxx"}).alias("text"))


SCRUBBED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '/(?:Users|home)/[A-Za-z0-9._-]+', '~', 'g'), 'assistant', 'a user', 'gi'), 'tion', 'Xx', 'gi'), 'user', 'QQ', 'gi')"


@query(f"SELECT conv_id, turn, {SCRUBBED.format('role')} AS role, {SCRUBBED.format('text')} AS text, {SCRUBBED.format('text')} AS again, 'user' AS kept FROM conversations")
def scrubbed_tables(spark, sf_dir):
    """Conversations as nested rows, scrubbed at every depth in one pass, one replacement holding another name."""
    c = ad.table(spark, sf_dir, "conversations")
    nested = c.select("conv_id", "turn", F.struct("role", F.array(F.struct("text")).alias("parts")).alias("message"), F.create_map(F.lit("user"), F.col("text")).alias("by_name"), F.lit("user").alias("kept"))
    clean = scrub_table(nested, {"tion": "Xx", "assistant": "a user", "user": "QQ"}, keep=("kept",))
    return clean.select("conv_id", "turn", "message.role", F.col("message.parts")[0]["text"].alias("text"), F.col("by_name")["user"].alias("again"), "kept")


@query("""WITH q AS (SELECT item_id AS query_id, lower(text) AS needle FROM benchmark),
h AS (SELECT query_id, source, doc_id, text, row_number() OVER (PARTITION BY query_id, source ORDER BY doc_id) AS rank FROM q JOIN documents ON contains(lower(text), needle) WHERE needle <> '')
SELECT query_id, source, doc_id, text[1:150] AS excerpt, rank FROM h WHERE rank <= 20""")
def substring_scan(spark, sf_dir):
    docs = ad.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return ix.substring_scan(docs, ad.queries(spark, sf_dir))
