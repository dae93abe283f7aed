"""The pipeline against a plain version of its stages; the classifier's decisions are taken from the operator."""

import sentencepiece
from test_text_operators import PIECES, _components, shingles

import corpus_pipeline
from tracelake.llm import quality


def _line_dedup(docs):
    seen, out = set(), {}
    for i in sorted(docs):
        text = docs[i]
        lines = text.split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            window = tuple(lines[k : k + 3])
            if not "".join(window).strip(" \t\n\r\x0b\x0c"):
                continue
            if window in seen:
                gone |= set(range(k, k + 3))
            seen.add(window)
        left = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        if not gone or left.strip(" \t\n\r\x0b\x0c"):
            out[i] = left
    return out


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    drawn = {r["doc_id"] for r in quality.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    left = _line_dedup({r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in drawn})
    groups = _components({i: shingles(t) for i, t in left.items()})
    left = {i: t for i, t in left.items() if groups[i] == i}
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left = {i: t for i, t in left.items() if not any(100 * len(s & shingles(t)) >= 80 * len(s) for s in items if s)}
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {i: len(model.encode(t)) for i, t in left.items()}


def test_null_and_repeated_ids_lose_only_copies(spark, sf_dir):
    words = lambda a: " ".join(f"w{a}x{i}" for i in range(60))
    rows = [(1, words("a")), (None, words("a") + " end"), (None, words("b")), (None, words("b") + " end"), (None, words("c")), (None, ""), (2, words("d")), (2, words("a") + " more"), (2, words("e")), (2, words("e")), (None, words("c"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted((r["doc_id"] or 0, r["text"].split(" ")[0]) for r in corpus_pipeline.ngram_jaccard(spark, docs, sf_dir).collect())
    assert left == [(0, ""), (0, "wbx0"), (0, "wcx0"), (1, "wax0"), (2, "wdx0"), (2, "wex0")]
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first()["text"]
    leaky = spark.createDataFrame([(None, item), (None, words("a")), (3, item), (3, words("b"))], "doc_id long, text string")
    assert sorted(r["text"] for r in corpus_pipeline.benchmark_decontamination(spark, leaky, sf_dir).collect()) == [words("a"), words("b")]


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
    assert len(corpus_pipeline.STAGES) == 5
