import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import both
from pyspark.sql import functions as F

from tracelake.llm import decontaminate, jaccard, lattice_lm, line_dedup, piece_codec, quality, queries, token_files

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PIECES, WORDS = queries.tokenizer_file("piece_bpe_32k.model"), queries.tokenizer_file("word_bpe_49k.json")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    (names, ours), (theirs, rows) = both(spark, sf_dir, queries.queries()[name], queries.oracle_sql()[name])
    assert names == theirs and ours == rows


def test_pieces_equal_the_library(spark, sf_dir, odd_docs, no_docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = {r["doc_id"]: r for r in queries.op1_piece_codec(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = model.encode(r["text"] or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest())
        got = found[r["doc_id"]]
        assert (got["n_tokens"], got["ids_sha256"], got["decoded_sha256"]) == want
    coded = piece_codec.encode_pieces(odd_docs, PIECES)
    assert coded.columns[-1] == "ids" and coded.count() == odd_docs.count()
    for r in piece_codec.decode_pieces(coded, PIECES).collect():
        assert r["ids"] == model.encode(r["text"] or "") and r["decoded"] == (r["text"] or "")
    assert piece_codec.encode_pieces(no_docs, PIECES).count() == 0


def test_pieces_on_odd_characters():
    import random

    import sentencepiece

    model, table = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_codec.piece_table(PIECES)
    rng = random.Random(1)
    signs = list("abcdefgin rtheo  \n\t▁ñé梦😀\x00!?.,AB")
    texts = ["", None, " ", "ngng" * 9, "aaaaaaa", " " * 77 + "x" + " " * 33, *["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(1500)]]
    flat, at = table.encode(texts)
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [model.encode(t or "") for t in texts]
    assert table.decode(flat, at) == [model.decode(model.encode(t or "")) for t in texts]


def test_pieces_of_a_megabyte_without_spaces():
    import base64
    import random
    import time

    import sentencepiece

    model, table = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_codec.PieceTable(PIECES)
    rng = random.Random(5)
    code = base64.b64encode(rng.randbytes(750_000)).decode()
    prose = "".join(w for w in "the quick brown fox jumps over a lazy dog and then some more of it follows here with other words".split() for _ in range(3)) * 30
    for text in (code, prose, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000)), "a" * 100_000, "=" * 100_000, "梦" * 5000 + code[:5000]):
        began = time.time()
        flat, at = table.encode([text])
        assert time.time() - began < 10
        assert flat.tolist() == model.encode(text) and table.decode(flat, at) == [text]


def test_line_dedup_cases(spark, odd_docs, no_docs):
    rows = line_dedup.dedup_lines(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = defaultdict(list)
    for r in rows:
        by_id[r["doc_id"]].append(r)
    assert by_id[9][0]["text"] == "x\ny" and by_id[9][0]["n_removed"] == 3
    assert by_id[8][0]["n_removed"] == 0 and by_id[2][0]["text"] is None and by_id[3][0]["n_lines"] == 0
    assert [r["text"] for r in by_id[7]] == ["solo", "solo"]  # repeated rows share their result
    assert by_id[None][0]["n_removed"] == 0 and by_id[1][0]["n_removed"] == 0 and by_id[6][0]["n_removed"] == 0  # one line is no window
    lines = [(2, "p\nq\nr\ns"), (None, "p\nq\nr"), (1, "q\nr\ns\nt"), (3, "p\nq"), (3, "p\nq")]
    got = {(r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(spark.createDataFrame(lines, "doc_id long, text string")).collect()}
    assert got == {(None, "p\nq\nr", 0), (1, "q\nr\ns\nt", 0), (2, "", 4), (3, "p\nq", 0)}  # a null id comes first
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_decontamination_cases(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "three w1x1 w2x2 w3x3 w4x4 w5x5 w6x6 w7x7 w8x8 w9x9 w10x10 w11x11"), (2, None), (3, "solo"), (4, "absent words only in this item here")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(odd_docs, items).collect()}
    assert got == {(5, 1), (7, 3), (10, 3)}
    short = spark.createDataFrame([(5, "W3x3"), (6, "six seven"), (7, "a b c d"), (8, "seven six"), (9, "three four five six"), (None, "w1x1  w2x2 w3x3")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["containment"]) for r in decontaminate.contaminated(odd_docs, short).collect()}
    assert got == {(5, 5, 1.0), (5, None, 1.0), (8, 7, 1.0), *((i, j, 1.0) for i in (1, 6, None) for j in (6, 9))}
    assert decontaminate.contaminated(no_docs, items).count() == 0 and decontaminate.contaminated(odd_docs, items.limit(0)).count() == 0


def _components(sets):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    owners = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for g in sets[i] for j in owners[g])
        for j, n in shared.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for g in sets[i]:
            owners[g].append(i)
    return {i: root(i) for i in sets}


def test_jaccard_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = [(10_000 + 100 * k + j, " ".join(f"t{k}_{i}" for i in range(n) if i != 3 * j)) for k, n in enumerate((6, 12, 40, 63, 64, 200)) for j in range(14)]
    docs = docs.union(spark.createDataFrame(extra, "doc_id long, text string"))
    sets = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert got == {i: (len(sets[i]), c) for i, c in _components(sets).items()}


def test_jaccard_of_a_licence_in_small_chunks(spark, monkeypatch):
    """60 documents that share a licence, more than a chunk holds, some of them near copies."""
    monkeypatch.setattr(jaccard, "CHUNK", 3)
    licence = " ".join(f"licence{i}" for i in range(40))
    texts = {i: licence + " " + " ".join(f"own{i // 2 if i < 20 else i}x{j}" for j in range(8 if i < 20 else 60)) + (f" last{i}" if i < 20 else "") for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = _components({i: shingles(t) for i, t in texts.items()})
    assert {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()} == want
    assert len(set(want.values())) < 60


def test_jaccard_cases(odd_docs, no_docs):
    rows = defaultdict(list)
    for r in jaccard.jaccard_components(odd_docs).collect():
        rows[r["doc_id"]].append((r["n_shingles"], r["component_id"], r["kept"]))
    assert rows[6] == [(3, 1, False)] and rows[None] == [(3, 1, False)] and rows[2] == [(0, 2, True)] and rows[4] == [(0, 4, True)]
    assert rows[7] == [(1, 7, True)] * 2 and rows[10] == [(1, 7, False)]
    assert jaccard.jaccard_components(no_docs).count() == 0


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    a, b = np.sort(pool[:300]), np.sort(pool[40:360])
    s = jaccard.narrow_sketch(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    assert sum(bin(int(x) & (2**64 - 1)).count("1") for x in s[0] ^ s[1]) <= len(np.setxor1d(a, b))


def test_lattice_scores(spark, sf_dir, odd_docs, no_docs):
    docs = [(r["doc_id"], words(r["text"])) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    count, end = Counter(), "\n"
    for i, w in docs:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update([*w, end])
    n, v = sum(count.values()), len(count)
    got = {r["doc_id"]: r for r in queries.op4_lattice_lm(spark, sf_dir).collect()}
    for i, w in docs:
        w = [*w, end]
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(count[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert -math.inf < r["score"] < 0
    assert lattice_lm.score_documents(odd_docs, PIECES).count() == odd_docs.count()
    assert lattice_lm.score_documents(no_docs, PIECES).count() == 0


def test_lattice_score_equals_enumeration(spark):
    """Whole texts: EM and scores by listing every segmentation of every word."""
    table = lattice_lm.pieces(PIECES)
    ids = {p: i for i, p in enumerate(table.text)}
    rows = [(0, "the cat sat on the mat"), (1, "The hat é sat"), (2, None), (3, "a\tthat hats"), (None, "cats sat"), (12, "that catß 梦 sat"), (1, "The hat é sat"), (16, ""), (19, "the brats")]

    def ways(rest):
        if not rest:
            yield ()
        for k in range(1, len(rest) + 1):
            one = (ids[rest[:k]],) if rest[:k] in ids else tuple(len(table.text) + b for b in rest.encode()[: len(rest[0].encode())]) if k == 1 else None
            if one is not None:
                yield from (one + more for more in ways(rest[k:]))

    train = [r for r in rows if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 7 != 2]
    assert 0 < len(train) < len(rows)
    count, ends = Counter(w for _, t in train for w in words(t)), len(train)
    kinds = set().union(*(words(t) for _, t in rows))
    paths = {w: list(ways("▁" + w)) for w in kinds}
    scores = table.first_scores
    for _ in range(lattice_lm.ROUNDS):
        uses = lattice_lm.PRIOR_TOKENS * np.exp(table.first_scores)
        uses[table.end] += ends
        for w, n in count.items():
            p = [math.exp(sum(scores[i] for i in path)) for path in paths[w]]
            for path, x in zip(paths[w], p, strict=True):
                for i in path:
                    uses[i] += n * x / sum(p)
        scores = np.log(uses / uses.sum())
    piece_p = {w: sum(math.exp(sum(scores[i] for i in path)) for path in paths[w]) for w in kinds}
    n, v = sum(count.values()) + ends, len(count) + 1
    opening = sum(math.exp(scores[i]) for p, i in ids.items() if p.startswith("▁"))
    end = (ends + v * math.exp(scores[-1]) / (math.exp(scores[-1]) + opening)) / (n + v)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row int, block string")
    got = sorted((str(r["doc_id"]), r["score"], r["piece_score"]) for r in lattice_lm.score_documents(frame, PIECES).collect())
    want = sorted((str(i), math.log10(end) + sum(math.log10((count[w] + v * piece_p[w]) / (n + v)) for w in words(t)), (scores[-1] + sum(math.log(piece_p[w]) for w in words(t))) / math.log(10)) for i, t in rows)
    assert [x[0] for x in got] == [x[0] for x in want]
    assert [y for x in got for y in x[1:]] == pytest.approx([y for x in want for y in x[1:]], rel=1e-9)


def test_lattice_without_training_text(spark):
    held = spark.createDataFrame([(i, "some words") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    rows = lattice_lm.score_documents(held, PIECES).collect()
    assert rows and all(r["held_out"] and r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in rows)


def test_forward_sums_all_segmentations():
    table = lattice_lm.pieces(PIECES)
    scores = table.first_scores
    ids = {p: i for i, p in enumerate(table.text)}
    word = "▁there"

    def total(rest):
        return 1.0 if not rest else sum(math.exp(scores[ids[rest[:k]]]) * total(rest[k:]) for k in range(1, len(rest) + 1) if rest[:k] in ids)

    assert lattice_lm.word_scores(["there"], table, scores)[0] == pytest.approx(math.log(total(word)), rel=1e-9)
    uses = lattice_lm.expected_counts(["there"], np.ones(1), table, scores)
    assert sum(uses[i] * len(p) for p, i in ids.items()) == pytest.approx(len(word))


def test_quality_on_held_out_labels(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    seen, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    kept = quality.resample(docs, seen).select("doc_id").withColumn("kept", F.lit(1))
    r = held.join(kept, "doc_id", "left").groupBy(((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")).agg(F.avg(F.coalesce("kept", F.lit(0))).alias("share")).collect()
    share = {x["good"]: x["share"] for x in r}
    assert share[True] > 0.97 and share[False] < 0.4


def test_quality_drops_held_out_toxic_texts(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    kept = quality.resample(docs, labels.where("doc_id % 2 = 0")).select("doc_id").distinct()
    toxic = labels.where("doc_id % 2 = 1 and quality = 1 and toxic = 1")
    assert toxic.join(kept, "doc_id").count() < 0.26 * toxic.count()


def test_quality_learns_words_of_few_documents(spark):
    """A word of three labelled documents, none of them target, is over three standard errors off where target is the rule."""
    rows = [(i, f"plain words number{i} and more of them again{i}" + (" vileword" if i >= 97 else "")) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i >= 97 or i % 6 == 0)) for i in range(100)], "doc_id long, quality int, toxic int")
    ratios, _ = quality.fit_ratio(docs, labels)
    data = np.frombuffer(b"vileword", np.uint8)
    bucket, _ = quality.features(data, np.array([0, len(data)]))
    assert (ratios[bucket[:1]] < -1.0).all()


def test_quality_cases(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    assert quality.resample(odd_docs, labels).count() == odd_docs.count()
    assert quality.resample(odd_docs, labels.limit(0)).count() == odd_docs.count()
    assert quality.resample(odd_docs, labels, k=5).count() == 5
    assert quality.resample(no_docs, labels).count() == 0


def _grams(text):
    """N-grams of a text as they are, without hashes."""
    w = [x.encode() for x in words(text)]
    pairs = [("same",) if a == b else ("pair", a, b) for a, b in zip(w, w[1:], strict=False)]
    runs = [r for x in w for r in [("open", x[:4]), *(("run", x[i : i + 5]) for i in range(len(x) - 4))]]
    return [*(("word", x) for x in w), *pairs, *runs]


def test_quality_weights_and_draw_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    good = "alpha beta gamma delta of and some fine plain words".split()
    bad = "junk spam! of and vile words buy now cheap deal".split()
    rows = [(i, " ".join(rng.choice(good if i % 3 else bad, 40 + i)) + f" {i}") for i in range(60)]
    rows += [(60, None), (61, " \n"), (None, "alpha beta"), (5, "spam! spam!"), (5, "spam! spam!")]
    labels = [(i, int(i % 3 > 0), 0) for i in range(40)] + [(41, 1, 1), (None, 1, 0), (43, None, 0)]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, row_key string, draw double")
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = quality.resample(docs, frame).collect()

    kind = {i: int(q == 1 and t == 0) for i, q, t in labels if i is not None and q is not None}
    fitted = {}
    for i, t in rows:  # of a labelled id with several texts each counts
        if i in kind:
            fitted.setdefault((i, t), kind[i])
    raw, target = Counter(), Counter()
    for (_, t), y in fitted.items():
        raw.update(_grams(t))
        if y:
            target.update(_grams(t))
    data = " ".join(t or "" for _, t in rows).encode()
    buckets, _ = quality.features(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert len(set(buckets.tolist())) == len(set(_grams(data.decode())))  # no two n-grams share a bucket here
    share = sum(target.values()) / sum(raw.values())

    def ratio(g):
        expected = raw[g] * share
        clear = raw[g] > 0 and abs(target[g] - expected) >= quality.SIGMAS * math.sqrt(expected * (1 - share))
        return math.log((target[g] + quality.SMOOTHING) / (expected + quality.SMOOTHING)) if clear else 0.0

    weight = {(i, t): sum(ratio(g) for g in _grams(t)) * quality.LENGTH / (quality.LENGTH + len(_grams(t))) for i, t in rows}
    keys = {(r["doc_id"], r["text"]): (r["k"], r["g"]) for r in docs.withColumn("k", F.xxhash64("doc_id", "text")).withColumn("g", F.xxhash64(F.lit("gumbel"), "k")).collect()}
    noise = {x: -math.log(-math.log((g % (1 << 52) + 0.5) / (1 << 52))) for x, (_, g) in keys.items()}
    least = min(weight[x] for x, y in fitted.items() if y)
    k = sum(weight[x] >= least for x in rows)
    assert 0 < k < len(rows)
    want = sorted(rows, key=lambda x: -(weight[x] + noise[x]))[:k]
    got = {(r["row_key"], round(r["log_weight"], 3), round(r["draw"], 3)) for r in found}
    assert len(found) == k and got == {(keys[x][0], round(weight[x], 3), round(weight[x] + noise[x], 3)) for x in want}


def test_gumbel_ties(spark):
    """Half of the rows have one draw: the number drawn is exact and sure rows are all there."""
    rows = spark.range(30_000, numPartitions=6).select(F.when(F.col("id") % 2 == 0, F.lit(1.5)).otherwise(F.col("id") / 10_000.0).alias("draw"), F.col("id").alias("row_key"), F.col("id").alias("row"))
    above = rows.where("draw > 1.5").count()
    for k in (0, 10, above, above + 1, above + 9000, 30_000, 40_000):
        drawn = quality.gumbel_top_k(rows, k)
        assert drawn.count() == min(k, 30_000) and drawn.where("draw > 1.5").count() == min(k, above)


def test_token_files_round_trip(spark, sf_dir, odd_docs, no_docs):
    from tokenizers import Tokenizer

    model, at = Tokenizer.from_file(WORDS), 0
    got = {r["doc_id"]: r for r in queries.op9_token_files(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*model.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[r["doc_id"]]["start"], got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    rows = token_files.token_index(odd_docs, WORDS).collect()
    assert len(rows) == odd_docs.count() and min(r["start"] for r in rows) == 0 and next(r for r in rows if r["doc_id"] is None)["start"] == 0
    assert token_files.token_index(no_docs, WORDS).count() == 0


def test_word_ids_equal_the_library_on_odd_characters():
    import random

    from tokenizers import Tokenizer

    model, encoder = Tokenizer.from_file(WORDS), token_files.word_encoder(WORDS)
    assert encoder.direct
    rng = random.Random(3)
    signs = [*"abcdefgin rtheo  \n\t▁ñéÉÜßÆ梦😀\x00\x1c\x85\xa0!?.,AB'<|>0129½²ªº$#&\u0301İŸſǅɐﬁ\u200b\u2003\u3000\x7f\xad", "'s", "'ll", "<|endoftext|>", "<|startoftext|>", "don't", "STRASSE"]
    texts = ["", None, " ", "<|endoftext|>", "a<|b", "|>", "x" * 3000, *["".join(rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(3000)]]
    for at in range(0, len(texts), 997):
        got = [np.frombuffer(g, encoder.type).tolist() for g in encoder.encode_each(texts[at : at + 997])]
        assert got == [[*model.encode(t or "", add_special_tokens=False).ids, 1] for t in texts[at : at + 997]]


def test_token_files_of_equal_and_null_ids_read_in_another_session(spark, tmp_path):
    rows = [(None if i % 3 == 0 else i % 5, f"text number {i} " + "and more " * (i % 7), i) for i in range(120)] + [(4, None, 1), (4, "", 2), (4, "", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    token_files.write_files(docs, WORDS, token_files.train_dictionary(docs, WORDS), chars_per_file=300, path=str(tmp_path / "t"))
    files, dictionary = token_files.open_files(spark.newSession(), str(tmp_path / "t"))
    content = [bytes(r["content"]) for r in files.orderBy("shard").collect()]
    assert len(content) > 5
    readers = [token_files.TokenFile(c, dictionary) for c in content]
    ids = [i for r in readers for i in r.doc_ids]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i) and len(ids) == len(rows)
    assert max(r.n for r in readers) < 40  # the 40 rows of one id are spread over files
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(WORDS)
    want = sorted((i or 0, tuple([*model.encode(t or "", add_special_tokens=False).ids, 1])) for i, t, _ in rows)
    assert sorted((i or 0, tuple(r.ids(k).tolist())) for r in readers for k, i in enumerate(r.doc_ids)) == want
    found = token_files.token_index(docs, WORDS).orderBy("start").collect()
    assert [r["start"] for r in found] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in found])[:-1]]).tolist()


def test_token_file_refuses_another_dictionary():
    content = token_files.file_bytes([5, None], [2, 1], [b"", b""], 2, b"d")
    with pytest.raises(ValueError, match="another dictionary"):
        token_files.TokenFile(content, b"other")
