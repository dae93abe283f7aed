"""Secret scans against a plain version, on given and on odd texts."""

import hashlib
import random
import re
import string

from tracelake.llm import secrets
from tracelake.llm.queries import op13_secret_scan, tokenizer_file

RANKS = tokenizer_file("byte_bpe_50k.tiktoken")
PLAIN = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def plain(text):
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PLAIN) for m in p.finditer(text or "") if ok(m)]
    return ",".join(f"{PLAIN[k][0]}:{a}:{b}" for a, k, b in sorted(found))


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), (r["doc_id"], base, r["spans"])
        assert ",".join(s for s in r["spans"].split(",") if s and not s.startswith("random")) == base
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [base.count(k + ":") for k in secrets.BASE]
        assert r["n_random"] == r["spans"].count("random:")


def test_given_documents_equal_the_plain_version(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.01")
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op13_secret_scan(spark, sf_dir).collect()
    check(rows, texts)
    assert sum(r["n_assign"] for r in rows)


def test_odd_texts(spark):
    key = "AKIA" + "Z9" * 8
    texts = {
        1: None, 2: "", 3: f"é ü {key} x", 4: "PassWord :  'abc-12' token=short passwd = \"12345\"", 5: "a" * 23 + " " + "b" * 24 + "g" + "c" * 30,
        6: f"api_key={key}" + "f" * 30, 7: "ſecret: abcdefgh toKen=abcdefgh", 8: "token = token = abcdef", 9: "x" * 300_000 + "0a" * 200_000 + "é" + "ab" * 12,
        10: "0123456789abcdef01234567", 11: "AKIA" + "A" * 15, 12: "secret" + " " * 50_000 + "=" + " " * 9 + "q.w=e/rty", 13: "89abcdef01234567abcdef01", 14: key, 15: "passwordpassword=secret=abcdef",
    }
    docs = spark.createDataFrame([(i, t, "x", 0, 1) for i, t in texts.items()], "doc_id long, text string, spans string, kind int, start int")
    check(secrets.find_secrets(docs.coalesce(1), RANKS).collect(), texts)
    twice = secrets.find_secrets(docs.union(docs), RANKS)
    assert twice.count() == 2 * len(texts) and secrets.find_secrets(docs.limit(0), RANKS).count() == 0
    nothing = docs.where("doc_id = 3").selectExpr("cast(null as long) as doc_id", "text")
    assert secrets.find_secrets(nothing, RANKS).first()["n_access"] == 1


def test_random_strings_are_found_and_names_are_left(spark):
    draw = random.Random(5)
    keys = ["".join(draw.choice(string.ascii_letters + string.digits) for _ in range(n)) for n in (20, 24, 32, 40, 64) for _ in range(40)]
    clean = [
        "9233A8ECF7C5B09FE5949719B6B82BC439E9329B", "550e8400-e29b-41d4-a716-446655440000", "keitstlichschenverpfein", "get_user_account_balance_v2", "2024-01-01_2024-12-31-0001", "4111111111111111111111111",
        "src/main/java/org/example/Reader", "InternationalizationSupportFactory", "sha256-47DEQpj8HBSa+/TImW+5JCeuQeRkm5NMpJWZG3hSuFU=", "-" * 40, "=" * 30 + "abc" + "=" * 30, "Donaudampfschifffahrtsgesellschaft",
    ]
    docs = spark.createDataFrame([(i, f"vor ü {w} nach") for i, w in enumerate(keys + clean)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in secrets.find_secrets(docs, RANKS).collect()}
    found = [rows[i]["n_random"] for i in range(len(keys))]
    assert sum(found) >= 0.98 * len(keys)
    assert [w for i, w in enumerate(clean) if rows[len(keys) + i]["n_random"]] == []
    hit = next(i for i, n in enumerate(found) if n)
    assert rows[hit]["spans"] == f"random:6:{6 + len(keys[hit])}"


def test_few_spans_beside_the_base_on_the_given_documents(spark, sf_dir):
    rows = op13_secret_scan(spark, sf_dir).collect()
    assert sum(r["n_random"] for r in rows) <= 0.002 * len(rows)
