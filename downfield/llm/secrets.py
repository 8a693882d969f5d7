"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text.  A ledger holds, for each blob, the rule-version pairs
it was scanned with and what they found.  A run scans each unseen pair once, whatever the number of paths and versions
that share the blob, appends to the ledger, and joins the findings back to all paths.

Defined results: a null text is the empty blob; repeated rows share a blob and each get its findings; very long texts are scanned
whole; spans that tie in their start come in the order of the rules; only the key and the text are read, so other columns clash
with nothing; an empty table appends nothing; the ledger may be read again after a run that was repeated, since equal pairs are taken once.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from downfield.llm.shared import cut, fresh_path
from downfield.llm.spans import count, joined, with_matches

#: kind -> (version, pattern, group whose length counts or 0, least length of it), in the order of ties.
#: The first three are the base kinds; a pattern that needs a length of the whole match says so itself where no other
#: match could begin inside a match that is too short.
RULES = {
    "assign": (1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    "access": (1, r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (1, r"[0-9a-f]{32,}", 0, 32),
    "private_key": (1, r"-----BEGIN (?:[A-Z0-9]{1,20} ){0,3}PRIVATE KEY-----", 0, 0),
    "jwt": (1, r"eyJ[A-Za-z0-9_-]{8,1000}\.[A-Za-z0-9_-]{8,1000}\.[A-Za-z0-9_-]{8,1000}", 0, 0),
    "vendor_token": (1, r"(?:gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,72}|sk_live_[0-9A-Za-z]{24}|AIza[0-9A-Za-z_-]{35})", 0, 0),
    "url_password": (1, r"[a-z][a-z0-9+.-]{1,15}://[^\s:/@]{1,64}:([^\s:/@]{3,64})@", 0, 0),
}
BASE = ("assign", "access", "hex")
LEDGER = "blob binary, pairs array<string>, spans array<struct<kind:string,version:int,start:int,end:int>>"


def pair(kind: str, rules: dict) -> str:
    return f"{kind}@{rules[kind][0]}"


def scan(blobs: DataFrame, rules: dict = RULES) -> DataFrame:
    """Ledger rows for blobs (blob, text, seen: pairs not to be scanned again)."""
    # a text is hidden from a rule whose pair was seen: null has no matches
    out = blobs
    for k in rules:
        out = out.withColumn(f"__t_{k}", F.when(~F.array_contains("seen", pair(k, rules)), F.col("text")))
    for k, (_, pattern, group, _) in rules.items():
        out = with_matches(out, f"__t_{k}", {k: pattern}, {k: group} if group else {}).drop(f"__t_{k}")
    none = F.array().cast(LEDGER.split("spans ")[1])

    def fitting(kind: str) -> Column:
        version, _, group, least = rules[kind]
        fits = F.filter(kind, lambda s: F.length(s["part"] if group else s["value"]) >= least)
        return F.coalesce(F.transform(fits, lambda s: F.struct(F.lit(kind).alias("kind"), F.lit(version).alias("version"), s["start"].alias("start"), s["end"].alias("end"))), none)

    lists = [fitting(k) for k in rules]
    return out.select("blob", F.array_except(F.array(*(F.lit(pair(k, rules)) for k in rules)), "seen").alias("pairs"), F.concat(*lists).alias("spans"))


def read_ledger(spark, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException:  # the first run
        return spark.createDataFrame([], LEDGER)


def update(versions: DataFrame, path: str, rules: dict = RULES) -> DataFrame:
    """Scan what the ledger at ``path`` has not seen of ``versions`` (blob, text), append it, and return the ledger."""
    spark = versions.sparkSession
    wanted = F.array(*(F.lit(pair(k, rules)) for k in rules))
    seen = read_ledger(spark, path).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("seen"))
    blobs = versions.dropDuplicates(["blob"]).join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    scan(blobs.filter(F.size(F.array_except(wanted, "seen")) > 0), rules).write.mode("append").parquet(path)
    return read_ledger(spark, path)


def findings(ledger: DataFrame, rules: dict = RULES) -> DataFrame:
    """A row for each blob: its spans under the present rule versions, by start, then kind."""
    present = [pair(k, rules) for k in rules]
    rank = F.create_map(*(x for i, k in enumerate(rules) for x in (F.lit(k), F.lit(i))))
    spans = F.array_distinct(F.flatten(F.collect_list("spans")))  # as many lists as runs that scanned the blob
    spans = F.filter(spans, lambda s: F.concat_ws("@", s["kind"], s["version"].cast("string")).isin(present))
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return ledger.groupBy("blob").agg(keyed.alias("spans"))


def scan_paths(docs: DataFrame, key: str = "doc_id", text: str = "text", ledger: str | None = None, rules: dict = RULES) -> DataFrame:
    """key and spans (start, rank, end, kind) for each row of ``docs``; without a ledger path, a new one in the shared folder."""
    path = ledger or fresh_path(docs.sparkSession, "ledger")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    versions = docs.select(F.col(key), F.unhex(F.sha2(body, 256)).alias("blob"), body.alias("text"))
    # as a table of its own: of two plain exchanges the skew join splits the paths of a blob that a third of them share
    found = cut(findings(update(versions.select("blob", "text"), path, rules), rules), "findings")
    return versions.select(key, "blob").join(found, "blob", "left").select(key, F.coalesce("spans", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")).alias("spans"))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    base: Column = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(key, *(count(F.col("spans"), k).alias(f"n_{k}") for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
