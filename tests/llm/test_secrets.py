import hashlib
import re

from pyspark.sql import functions as F

from downfield.llm import secrets as S
from tests.llm import fixtures as X

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
HEX = "0123456789abcdef" * 3
TEXTS = X.AWKWARD + [
    "password=short token = 'abcdefgh1' SECRET:\"x/y+z=1234\"", "é\U0001f600 api_key: 12345678 apikey=123456789 API_KEY=12345678", "AKIA12345678 AKIA1234567890AB xAKIAAAAAAAAAAAAAAA",
    f"{HEX} {HEX[:31]} token={HEX}", 'token="secret:abcdefgh12', "token" * 500 + "=abcdefghij", "-----BEGIN RSA PRIVATE KEY----- https://u:pass@h/ ghp_" + "Z" * 36,
    "paſſword=abcdefghij toKen=abcdefghij", f"{HEX} {HEX[:31]} token={HEX}",
]


def base(t):
    t = t or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def test_equal_to_brute_force(spark):
    docs = X.docs(spark, TEXTS).withColumn("spans", F.lit(1)).withColumn("blob", F.lit(2))
    got = S.digest(S.scan_paths(docs)).collect()
    texts = {None if t == "no id" else i: t for i, t in enumerate(TEXTS)}
    assert len(got) == len(TEXTS)
    for r in got:
        want = base(texts[r["doc_id"]])
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[1] == k for x in want) for k in range(3))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in want).encode()).hexdigest()
        spans = [x for x in r["spans"].split(",") if x]
        assert [x for x in spans if x.split(":")[0] in S.BASE] == [f"{k}:{s}:{e}" for s, _, e, k in want]
    more = {r["doc_id"]: r["spans"] for r in got}[TEXTS.index(TEXTS[-3])]
    assert [x.split(":")[0] for x in more.split(",")] == ["private_key", "url_password", "vendor_token"]


def test_ledger_scans_each_pair_once(spark, tmp_path):
    path = str(tmp_path / "ledger")
    first = spark.createDataFrame([(1, "token=abcdefgh1"), (2, "token=abcdefgh1"), (3, "none")], "doc_id long, text string")
    assert {r["doc_id"]: len(r["spans"]) for r in S.scan_paths(first, ledger=path).collect()} == {1: 1, 2: 1, 3: 0}
    assert spark.read.parquet(path).count() == 2
    S.scan_paths(first, ledger=path).collect()
    assert spark.read.parquet(path).count() == 2
    second = spark.createDataFrame([(1, "token=abcdefgh1"), (4, "AKIA1234567890AB")], "doc_id long, text string")
    assert {r["doc_id"]: len(r["spans"]) for r in S.scan_paths(second, ledger=path).collect()} == {1: 1, 4: 1}
    assert spark.read.parquet(path).count() == 3
    newer = S.RULES | {"access": (2, r"AKIA[A-Z0-9]{13,}", 0, 17)}
    assert {r["doc_id"]: len(r["spans"]) for r in S.scan_paths(second, ledger=path, rules=newer).collect()} == {1: 1, 4: 0}
    last = spark.read.parquet(path).filter(F.array_contains("pairs", "access@2")).collect()
    assert len(last) == 2 and all(r["pairs"] == ["access@2"] for r in last)


def test_empty_and_plan(spark):
    assert S.scan_paths(X.empty(spark)).count() == 0
    out = S.scan_paths(X.docs(spark, ["a"]))
    assert "Python" not in out._jdf.queryExecution().toString()
