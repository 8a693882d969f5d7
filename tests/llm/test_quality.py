import re

from pyspark.sql import functions as F

from downfield.llm import quality as Q
from tests.llm import fixtures as X


def brute(t):
    t = t or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    on = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)} if len(w) < 5000 else None
    seen, dup, n_lines = set(), 0, 0
    for x in t.split("\n"):
        if re.search("[^\x20\x09-\x0d]", x):
            n_lines += 1
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), n_lines, dup, None if on is None else len(on)


def test_counts(spark):
    texts = X.AWKWARD + ["a b c d e f a b c d e", "z z z z z z z", "l1 x\nl1 x\n \nl2 #*$\nl1 x", "a b c d e\nq\na b c d e"]
    got = Q.quality(X.docs(spark, texts).drop("n_words")).orderBy("n_words", "word_chars").collect()
    assert len(got) == len(texts)
    want = sorted(brute(t) for t in texts if brute(t)[-1] is not None)
    have = sorted(tuple(r[c] for c in Q.COUNTS) for r in got if r["n_words"] < 5000)
    assert have == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and not r["host_rejected"])


def shrunk(hosts):
    """host -> (documents, failures): each host's rate under the beta-binomial prior of the moments, written out plainly."""
    total, failed, h = sum(n for n, _ in hosts.values()), sum(f for _, f in hosts.values()), len(hosts)
    p = failed / total
    if not 0 < p < 1:
        return dict.fromkeys(hosts, p)
    s = sum(n * (f / n - p) ** 2 for n, f in hosts.values())
    room = total - sum(n * n for n, _ in hosts.values()) / total - (h - 1)
    rho = (s / (p * (1 - p)) - (h - 1)) / room if room > 1e-9 else 0
    if rho <= 0:
        return dict.fromkeys(hosts, p)
    w = max((1 - rho) / rho, 0)
    return {k: (f + p * w) / (n + w) for k, (n, f) in hosts.items()}


def test_hosts_are_rejected_and_shrunk(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "too short"
    hosts = {"bad": (60, 48), "good": (60, 2), "mild": (50, 20), "tiny": (1, 1), "pair": (2, 1), None: (1, 0)} | {f"h{k}": (20, 3 + k % 4) for k in range(30)}
    rows, i = [], 0
    for name, (n, f) in hosts.items():
        for k in range(n):
            rows.append((i, bad if k < f else good, name))
            i += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = shrunk(hosts)
    verdicts = {r["host"]: r for r in Q.host_verdicts(Q.measure(docs, ["doc_id", "source"]).selectExpr("*", "n_words < 10 base_failed"), "source").collect()}
    assert verdicts.keys() == hosts.keys() and all(abs(verdicts[k]["rate_base"] - want[k]) < 1e-9 for k in hosts)
    assert {k for k in hosts if verdicts[k]["rejected"]} == {"bad"} and hosts["tiny"][1] / hosts["tiny"][0] > 0.5 > want["tiny"]
    got = {r["doc_id"]: r["kept"] for r in Q.quality(docs).collect()}
    assert got == {i: t == good and host != "bad" for i, t, host in rows}


def test_hosts_that_say_nothing_have_the_mean(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "too short"
    for sources, failed in ((["one"] * 20, 12), ([f"s{i}" for i in range(20)], 12), ([f"s{i % 4}" for i in range(20)], 0)):
        rows = [(i, bad if i < failed else good, x) for i, x in enumerate(sources)]
        got = Q.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
        assert all(r["host_rejected"] == (failed > 10) for r in got)


def test_repeated_rows_and_clashing_columns(spark):
    docs = X.docs(spark, X.AWKWARD).withColumn("base_failed", F.lit("x")).withColumn("host", F.lit(1)).withColumn("n", F.lit(2))
    got = Q.quality(docs.unionByName(docs)).collect()
    assert len(got) == 2 * len(X.AWKWARD)
    by = {}
    for r in got:
        by.setdefault((r["doc_id"], r["n_words"], r["word_chars"]), []).append(tuple(r))
    assert all(len(x) % 2 == 0 and len(set(x)) == 1 for x in by.values())


def test_empty(spark):
    assert Q.quality(X.empty(spark)).count() == 0
