"""Personal data by candidate gradient boosting, in DataFrame functions only.

High-recall generators propose spans, which may overlap: the four base kinds and looser forms of them.  A candidate has
format features (digits, separators, groups, years, checksum) and context features (words before it that speak of personal
numbers or of other numbers, what it touches).  Trees are boosted on generated sentences in which personal data and look-alikes
(dates, versions, invoice and part numbers, measures) are planted, with and without such words around them, so that labels are
planted truth and no rule over the features.  The sentences' features come from the same functions as the corpus's.  Two folds
by sentence score each other, and the lowest score that reaches the wished precision on a kind's candidates is that kind's
threshold; a kind that never reaches it adds nothing.  Base spans are always redacted; a looser candidate is if its score reaches
its kind's threshold and it touches no base span.

Defined results: a null text is empty; repeated rows each get their spans; very long texts are searched whole; of spans that tie in
kind the one that starts first comes first, and of looser spans that overlap each other all are given; only the key and the
text are read, so other columns clash with nothing; an empty table gives no rows.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from downfield.llm import boosting
from downfield.llm.shared import cut
from downfield.llm.spans import count, joined, with_matches

#: Base kinds.  Lookbehind and possessive repeats only spare work: a match could not begin or go on otherwise.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms of the same and other personal numbers.
LOOSE = {
    "email_spoken": r"[A-Za-z0-9._%+-]{1,64}\x20?[\[({](?:at|AT|@)[\])}]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[({](?:dot|DOT)[\])}])\x20?[A-Za-z0-9-]{1,63}){1,5}",
    "phone_local": r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,5}\)?(?:[\x20./-][0-9]{2,5}){1,4}(?![0-9A-Za-z])",
    "id_number": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
}
KINDS = (*BASE, *LOOSE)
#: Words right before a candidate, in four languages, that speak of personal data and of other numbers.
PERSONAL_WORDS = "e-?mail mail phone tel mobile cell call fax text card visa account konto iban ssn security ip address contact kontakt telefon handy anrufen correo courriel llamar appeler teléfono téléphone write".split()
OTHER_WORDS = "invoice order version build release date dated since until from page pages fig figure table section chapter part item sku model serial isbn ref no nr room score ratio price lot batch ticket rechnung bestellung datum seite facture commande pedido fecha".split()
_BEFORE = r"(?i)(?:^|[^\p{{L}}])(?:{0})[^\p{{L}}]{{0,4}}$"
FEATURES = ("family", "digits", "seps", "groups", "letters", "upper", "checksum", "personal", "other", "first_sep", "first_group", "last_group", "year", "paren", "touch_before", "touch_after", "size")
PRECISION, SENTENCES = 0.95, 2400
CANDIDATE = "array<struct<kind:string,rank:int,start:int,end:int,valid:boolean," + ",".join(f"{f}:int" for f in FEATURES) + ">>"
#: kind -> family, of looser forms that of the base kind they resemble.
FAMILY = {"email": 0, "ip": 1, "card": 2, "phone": 3, "email_spoken": 0, "phone_local": 3, "id_number": 2, "iban": 2}

_DIGITS = "regexp_replace(s.value, '[^0-9]', '')"
_LUHN = f"""aggregate(transform(split(reverse({_DIGITS}), ''), (c, i) -> case when c = '' then 0 when i % 2 = 0 then int(c) when int(c) > 4 then int(c) * 2 - 9 else int(c) * 2 end), 0, (a, x) -> a + x) % 10 = 0"""
_PARTS = r"s.value rlike '^(0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(\\.|$)){4}$'"
_VALID = {
    "email": "true",
    "ip": _PARTS,
    "card": f"length({_DIGITS}) between 16 and 19 and {_LUHN}",
    "phone": f"length({_DIGITS}) between 8 and 15",
}


def _bucket(of: str, *tops: int) -> str:
    return "case " + " ".join(f"when {of} <= {t} then {i}" for i, t in enumerate(tops)) + f" else {len(tops)} end"


def _row(kind: str) -> Column:
    digits = f"length({_DIGITS})"
    features = {
        "family": f"{FAMILY[kind]}",
        "digits": _bucket(digits, 0, 6, 7, 9, 12, 15, 16, 19),
        "seps": _bucket("length(regexp_replace(s.value, '[A-Za-z0-9]', ''))", 0, 1, 2, 4, 8),
        "groups": _bucket("size(split(s.value, '[^A-Za-z0-9]+'))", 1, 2, 3, 4, 5),
        "letters": _bucket("length(regexp_replace(s.value, '[^A-Za-z]', ''))", 0, 2, 8),
        "upper": "int(s.value rlike '[A-Z]')",
        "checksum": f"int({digits} between 12 and 19 and {_LUHN})" if FAMILY[kind] == 2 else "0",
        "personal": f"int(s.before rlike '{_BEFORE.format('|'.join(PERSONAL_WORDS))}')",
        "other": f"int(s.before rlike '{_BEFORE.format('|'.join(OTHER_WORDS))}')",
        "first_sep": "case regexp_extract(s.value, '[^A-Za-z0-9(+]', 0) when '' then 0 when ' ' then 1 when '-' then 2 when '.' then 3 when '/' then 4 else 5 end",
        "first_group": _bucket("length(regexp_extract(s.value, '[A-Za-z0-9]+', 0))", 1, 2, 3, 4, 8),
        "last_group": _bucket("length(regexp_extract(s.value, '([A-Za-z0-9]+)[^A-Za-z0-9]*$', 1))", 1, 2, 3, 4, 8),
        "year": "int(s.value rlike '(^|[^0-9])(19|20)[0-9]{2}([^0-9]|$)')",
        "paren": "int(s.value rlike '[(]')",
        "touch_before": "int(s.before rlike '[A-Za-z0-9]$')",
        "touch_after": "int(s.after rlike '^[A-Za-z0-9]')",
        "size": _bucket("length(s.value)", 8, 12, 16, 20, 30, 60),
    }
    fields = ", ".join(f"'{k}', {v}" for k, v in features.items())
    return F.expr(f"""coalesce(transform(`{kind}`, s -> named_struct('kind', '{kind}', 'rank', {KINDS.index(kind)}, 'start', s.start, 'end', s.end,
        'valid', coalesce({_VALID.get(kind, "false")}, false), {fields})), cast(array() as {CANDIDATE}))""")


def candidates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key and all candidates of each row's whole text."""
    body = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    found = with_matches(body, "__text", BASE | LOOSE, before=24, after=4)
    return found.select(key, F.concat(*(_row(k) for k in KINDS)).alias("candidates"))


def _luhn(digits: str) -> str:
    """The digits with one more that makes the checksum right."""
    total = sum(2 * int(c) - 9 * (int(c) > 4) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits)))
    return digits + str(-total % 10)


def sentences(seed: int, n: int = SENTENCES) -> list[tuple[int, str, list[tuple[int, int]]]]:
    """Generated texts, each with the places (start, end) of the personal data planted in it, among look-alikes."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    nz = lambda k: r.choice("123456789") + d(k - 1)
    name = lambda: "".join(r.choice("abcdefghiklmnoprstuw") for _ in range(r.randint(3, 9)))
    cap = lambda k: "".join(r.choice("ABCDEFGHKLMNPRSTUVWXZ") for _ in range(k))
    year = lambda: str(r.randint(1950, 2039))
    day, month = (lambda: f"{r.randint(1, 28):02}"), (lambda: f"{r.randint(1, 12):02}")
    personal = [
        lambda: f"{name()}.{d(2)}@{name()}.{r.choice(('com', 'org', 'de'))}",
        lambda: f"{name()} {r.choice('[({')}at{r.choice('])}')} {name()} {r.choice(('[dot]', '(dot)', '.'))} {r.choice(('com', 'net', 'fr'))}",
        lambda: f"{nz(3)}-{d(3)}-{d(4)}", lambda: f"({nz(3)}) {d(3)}-{d(4)}", lambda: f"0{nz(2)} {d(4)} {d(4)}", lambda: f"0{nz(2)}/{d(4)} {d(2)}", lambda: ".".join(("0" + nz(1), d(2), d(2), d(2), d(2))),
        lambda: f"+{nz(2)} {nz(2)} {d(4)} {d(4)}", lambda: f"{nz(3)}-{d(2)}-{d(4)}", lambda: f"{r.choice(('DE', 'FR', 'GB', 'ES'))}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}",
        lambda: f"{cap(2)}{d(2)}{d(4)}{d(4)}{d(4)}{d(4)}", lambda: _luhn(nz(15)), lambda: ".".join(str(r.randint(1, 254)) for _ in range(4)),
    ]
    other = [
        lambda: f"{year()}-{month()}-{day()}", lambda: f"{day()}.{month()}.{year()}", lambda: f"{day()}/{month()}/{year()}", lambda: f"{r.randint(1, 20)}.{r.randint(0, 30)}.{d(2)}.{d(3)}", lambda: f"{year()}-{d(4)}-{d(2)}",
        lambda: f"{nz(2)}-{nz(2)}-{nz(2)}", lambda: f"{nz(3)}-{nz(3)}", lambda: f"{nz(2)} {d(3)} {d(3)}", lambda: f"{nz(2)}/{nz(2)}", lambda: f"{nz(4)}.{d(2)}", lambda: f"{cap(2)}{d(2)} {cap(4)} {cap(4)} {cap(4)}",
        lambda: f"{nz(16)}", lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"{nz(2)} {d(2)} {d(2)}", lambda: f"{nz(3)} {nz(3)}", lambda: f"{nz(3)}.{d(3)}.{d(2)}",
    ]
    out = []
    for i in range(n):
        text, places = " ".join(name() for _ in range(r.randint(0, 4))), []
        for _ in range(r.randint(1, 3)):
            mine = r.random() < 0.45
            # words speak of what follows most of the time, and now and then of the contrary
            cue = r.random()
            words = (PERSONAL_WORDS if mine == (cue < 0.55) else OTHER_WORDS) if cue < 0.62 else None
            text += " " + (r.choice([w for w in words if w.isalpha()]) + r.choice((" ", ": ", ". ")) if words else name() + " ")
            value = r.choice(personal if mine else other)()
            if mine:
                places.append((len(text), len(text) + len(value)))
            text += value + r.choice((" ", ", ", ". ")) + name()
        out.append((i, text, places))
    return out


def planted(spark: SparkSession, seed: int, n: int = SENTENCES) -> list[tuple[int, str, dict, int, int, int]]:
    """(fold, kind, features, start, end, label) of the candidates of generated sentences; no more of them than ``n`` allows."""
    made = sentences(seed, n)
    truth = {i: set(places) for i, _, places in made}
    found = candidates(spark.createDataFrame([(i, t) for i, t, _ in made], "doc_id long, text string"), "doc_id", "text")
    return [(r["doc_id"] % 2, c["kind"], {f: c[f] for f in FEATURES}, c["start"], c["end"], int((c["start"], c["end"]) in truth[r["doc_id"]])) for r in found.collect() for c in r["candidates"]]


def _table(rows: list) -> list[tuple[dict, int, float]]:
    counts: dict[tuple, float] = {}
    for _, _, x, _, _, y in rows:
        key = (tuple(x[f] for f in FEATURES), y)
        counts[key] = counts.get(key, 0.0) + 1.0
    return [(dict(zip(FEATURES, x)), y, n) for (x, y), n in counts.items()]


_TRAINED: dict[float, tuple[boosting.Boosted, dict[str, float]]] = {}


def train(spark: SparkSession, precision: float = PRECISION, seed: int = 11) -> tuple[boosting.Boosted, dict[str, float]]:
    """Trees, and the threshold of each looser kind (over 1 where no score is precise enough)."""
    if precision not in _TRAINED:
        rows = planted(spark, seed)
        names, scored = list(FEATURES), {k: [] for k in LOOSE}
        for fold in (0, 1):
            model = boosting.fit(_table([r for r in rows if r[0] != fold]), names)
            for f, kind, x, _, _, y in rows:
                if f == fold and kind in scored:
                    scored[kind].append((round(model.score(x), 6), y, 1.0))
        _TRAINED[precision] = boosting.fit(_table(rows), names), {k: boosting.threshold(v, precision, 1.1) for k, v in scored.items()}
    return _TRAINED[precision]


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text", precision: float = PRECISION) -> DataFrame:
    """key and spans (kind, start, end, score) in the order of kinds, then of starts."""
    model, least = train(docs.sparkSession, precision)
    found = cut(candidates(docs, key, text), "pii")
    base = ", ".join(f"'{k}'" for k in BASE)
    none = "cast(array() as array<struct<rank:int,start:int,end:int,kind:string,score:double>>)"
    score = model.sql("s.")
    limit = "case s.kind " + " ".join(f"when '{k}' then {v!r}D" for k, v in least.items()) + " end"
    found = found.withColumn("__sure", F.expr(f"filter(candidates, s -> s.kind in ({base}) and s.valid)"))
    # a document without looser candidates, as most are, needs no scores but those of its base spans
    found = found.withColumn("__more", F.expr(f"filter(candidates, s -> s.kind not in ({base}) and round({score}, 6) >= {limit} and not exists(__sure, b -> b.start < s.end and s.start < b.end))"))
    spans = F.expr(f"coalesce(transform(concat(__sure, __more), s -> named_struct('rank', s.rank, 'start', s.start, 'end', s.end, 'kind', s.kind, 'score', {score})), {none})")
    return found.select(key, F.array_sort(spans).alias("spans"))


def redact(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; of overlapping spans the first, then the longest, stands."""
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    done = F.expr(f"""aggregate(__spans, named_struct('at', 0, 'out', ''), (a, s) -> case when s.start < a.at then a else
        named_struct('at', -s.back, 'out', concat(a.out, substr(`{text}`, a.at + 1, s.start - a.at), '[', s.kind, ']')) end, a -> concat(a.out, substr(`{text}`, a.at + 1)))""")
    per_key = spans.dropDuplicates([key]).select(F.col(key).alias("__key"), order.alias("__spans"))
    out = docs.join(per_key, docs[key].eqNullSafe(F.col("__key")), "left")
    return out.withColumn(text, F.when(F.size("__spans") > 0, done).otherwise(F.col(text))).select(*docs.columns)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(key, *(count(F.col("spans"), k).alias(f"n_{k}") for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
