"""Personal data by weak supervision, in DataFrame operations only.

Candidates are the spans of four fixed patterns (email, ip, card, phone) and of looser ones
(secret, national phone numbers, person after a title).  Four labelers vote on each candidate, for, against or not at all: a
strict regex, a gazetteer, the words before it, and its shape.  Expectation-maximisation over the
counts of vote patterns (a table bounded by the numbers of kinds and votes) estimates how reliable each labeler is;
the resulting probabilities train a logistic span classifier on features of the span.
Base spans stay whatever it says; looser candidates stay if it gives them 0.5 or more and they overlap no base span.

Defined cases: null text counts as empty and has no span; offsets are in code points, end exclusive; matches of a
kind are leftmost and don't overlap, matches of different kinds may; rows are independent,
so ties and repeated rows need no rule; without candidates nothing is learned and nothing added; an empty table gives
no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, written

KINDS = ("email", "ip", "card", "phone", "secret", "person")
# Possessive repeats and the look-behinds keep long runs linear and leave the matches as they are: in a run of characters
# that may start a match, the first start succeeds if any does, unless a match has just ended there (\G).
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
SECRET = r"(?<![A-Za-z0-9_])(?=[A-Za-z_-]{0,64}[0-9])[A-Za-z0-9_-]{16,}+"
NATIONAL = r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
PERSON = r"(?<!\p{L})(?:Mr|Mrs|Ms|Dr|Herr|Frau|Señora?|Madame|Monsieur)\.? \p{Lu}\p{L}+(?: \p{Lu}\p{L}+)?"
#: Gazetteers.
GIVEN_NAMES = tuple(
    """adam agnes alan albert alejandro alexander alfred alice amy ana andrea andreas andrew angela anna anne antoine antonio arthur barbara beatriz ben bernard
    brian bruno camille carla carlos carmen caroline catherine cecilia charles charlotte christian christine claire claudia daniel david deborah denis diego dieter
    donald dorothy edward elena elisabeth elizabeth emily emma eric ernst eva felix fernando florian francis francisco franz frederic gabriel george gerhard gloria
    grace hans harry heinz helen helena henri henry hugo ines ingrid isabel jack jacques james jan jane jean jennifer joan johann john jorge josé joseph juan judith julia
    jürgen karen karl karin klaus laura léa linda louis louise lucas lucy luis manfred manuel marcel margaret maria marie mario martha martin mary matthias michael miguel
    monika nancy nicolas nina olga oliver oscar patricia paul paula pedro peter philip pierre rachel rafael renate richard robert rosa ruth sabine samuel sandra sarah
    simon sofia sophie stefan susan sylvie teresa theresa thomas tim ursula victor werner william wolfgang yves""".split()
)
TOP_DOMAINS = tuple("com org net edu gov mil int info biz name pro io ai app dev me tv co us uk de fr es it nl be ch at pt eu se no fi dk pl cz hu ro gr ie ru ua tr cn jp kr in au nz ca mx br ar cl za il".split())
CUES = {"email": "mail|contact|write", "ip": "ip|address|host|server", "card": "card|visa|credit|pay", "phone": "phone|call|tel|fax|mobile", "secret": "password|passwd|token|secret|key|auth", "person": "name|by|from|dear"}
AGAINST = "version|isbn|page|chapter|serial"
#: Characters before a span that its labelers look at, as far back as the match of the same pattern before it.
CONTEXT = 24
_SPANS = "array<struct<lo:int,hi:int,m:string,before:string>>"
#: Elements that one fold of a scan goes through.
_RUN = 64


def running(values: Column, zero: int, op: Callable[[Column, Column], Column]) -> Column:
    """Of an array of ints: op over all elements before each, and over all up to each, as an array of (before, upto).  op is associative.

    A fold copies its array whenever that grows, so runs of elements are folded by themselves, then their totals, and both put together.
    """
    n = F.size(values)
    grown = lambda items: F.aggregate(items, F.array(F.lit(zero)), lambda acc, v: F.concat(acc, F.array(op(F.element_at(acc, -1), v))))
    firsts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(_RUN))).otherwise(F.array().cast("array<int>"))
    runs = F.transform(firsts, lambda i: grown(F.slice(values, i, F.lit(_RUN))))

    def whole(runs: Column) -> Column:
        bases = grown(F.transform(runs, lambda r: F.element_at(r, -1)))
        one = lambda r, b: F.zip_with(F.slice(r, F.lit(1), F.size(r) - 1), F.slice(r, F.lit(2), F.size(r) - 1), lambda x, y: F.struct(op(b, x).alias("before"), op(b, y).alias("upto")))
        return F.flatten(F.zip_with(runs, F.slice(bases, F.lit(1), F.size(runs)), one))

    return _let(runs, whole)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spans(text: Column, pattern: str, valid: Callable[[Column], Column] | None = None) -> Column:
    """Where the pattern matches, as far as valid: what lies between the matches gives their places, and what stands before them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    both = F.zip_with(between, found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("len"), m.alias("m"), F.right(p, F.lit(CONTEXT)).alias("before")))

    def placed(both: Column) -> Column:
        ends = running(F.transform(both, lambda x: x["gap"] + x["len"]), 0, lambda a, b: a + b)
        out = F.zip_with(both, ends, lambda x, e: F.struct((e["upto"] - x["len"]).alias("lo"), e["upto"].alias("hi"), x["m"].alias("m"), x["before"].alias("before")))
        return out if valid is None else F.filter(out, lambda x: valid(x["m"]))

    return _let(both, placed)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _no_zeros(p: Column) -> Column:
    return F.regexp_replace(p, "^0+", "")


def _valid_ip(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: (F.length(_no_zeros(p)) <= 3) & (F.concat(F.lit("0"), F.substring(_no_zeros(p), 1, 3)).cast("int") <= 255))


_VALID = {
    "email": lambda m: F.lit(True),
    "ip": _valid_ip,
    "card": lambda m: F.length(_digits(m)).between(12, 19) & F.call_function("luhn_check", _digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}


def _candidate(kind: str, base: bool, x: Column) -> Column:
    """A span with the labelers' votes and its features."""
    m, low = x["m"], F.lower(x["m"])
    before = F.lower(x["before"])
    vote = lambda yes, no=F.lit(False): F.when(yes, 1).when(no, -1).otherwise(0).cast("int")
    digits = F.length(_digits(m))
    letters = F.length(F.regexp_replace(m, r"[^\p{L}]", ""))
    regex = {"secret": vote(m.rlike("^(AKIA[0-9A-Z]{16}|[0-9a-f]{18,})$")), "person": vote(F.lit(False))}.get(kind, vote(F.lit(base), F.lit(not base)) if kind != "phone" else vote(F.lit(base) | m.rlike(r"^\([0-9]{3}\) [0-9]{3}-[0-9]{4}$")))
    gazetteer = {
        "email": vote(F.regexp_extract(low, r"\.([a-z0-9-]+)$", 1).isin(*TOP_DOMAINS), F.lit(True)),
        "ip": vote(F.lit(False), m.rlike(r"^(0|10|127|192\.168)\.")),
        "card": vote(_digits(m).rlike("^(4|5[1-5]|3[47]|6011)"), F.lit(True)),
        "phone": vote(F.lit(False), _digits(m).rlike("^(.)\\1+$")),
        "secret": vote(low.rlike("^(akia|ghp_|sk-|xox)")),
        "person": vote(F.regexp_extract(low, r" (\p{L}+)", 1).isin(*GIVEN_NAMES)),
    }[kind]
    context = vote(before.rlike(CUES[kind]), before.rlike(AGAINST))
    shape = {
        "email": vote(F.instr(m, "@") > 2, F.lit(True)),
        "ip": vote(digits.between(6, 12), F.lit(True)),
        "card": vote(digits.isin(15, 16), F.lit(True)),
        "phone": vote(digits.between(10, 13), F.lit(True)),
        "secret": vote((digits >= 4) & (letters >= 2), F.lit(True)),
        "person": vote(m.rlike(r" \p{Lu}\p{L}+ \p{Lu}"), F.lit(False)),
    }[kind]
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), x["lo"].alias("lo"), x["hi"].alias("hi"), F.lit(base).alias("base"),
        regex.alias("v1"), gazetteer.alias("v2"), context.alias("v3"), shape.alias("v4"),
        F.least(F.floor(F.length(m) / 8), F.lit(4)).cast("int").alias("f1"), F.floor(4 * digits / F.greatest(F.length(m), F.lit(1))).cast("int").alias("f2"), before.rlike(r'[=:]\s*"?$').cast("int").alias("f3"),
    )


def _voted(found: Column, kind: str, base: bool) -> Column:
    return F.transform(found, lambda x: _candidate(kind, base, x))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and spans: every base span and looser candidate, with votes and features."""
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digit", text.rlike("[0-9]")).withColumn("at", F.contains(text, F.lit("@")))
    none = F.array().cast(_SPANS)
    gates = {"email": F.col("at"), "person": F.lit(True)}
    parts = [("email", EMAIL, True), ("ip", IP, True), ("card", CARD, True), ("phone", PHONE, True), ("secret", SECRET, False), ("phone", NATIONAL, False), ("person", PERSON, False)]
    for i, (kind, pattern, base) in enumerate(parts):
        gate = gates.get(kind, F.col("digit"))
        gate = gate & text.rlike("Mr|Ms|Dr|Herr|Frau|Señor|Madame|Monsieur") if kind == "person" else gate & F.contains(text, F.lit("+")) if pattern is PHONE else gate
        rows = rows.withColumn(f"s{i}", F.when(gate, spans(text, pattern, _VALID[kind] if base else None)).otherwise(none))
    cols = []
    for i, (kind, _, base) in enumerate(parts):
        cols.append(_voted(F.col(f"s{i}"), kind, base))
    return rows.select("doc_id", F.concat(*cols).alias("spans"))


VOTES, FEATURES = ("v1", "v2", "v3", "v4"), ("f1", "f2", "f3")


def reliabilities(counts: list[tuple[tuple[int, ...], int]], rounds: int = 30) -> tuple[dict[tuple[int, ...], float], list[dict[int, tuple[float, float]]]]:
    """EM over (votes, how often): the probability of each vote pattern, and each labeler's chance of each vote given personal data or not."""
    if not counts:
        return {}, []
    chance = [{1: (0.7, 0.2), 0: (0.2, 0.4), -1: (0.1, 0.4)} for _ in counts[0][0]]
    prior, post = 0.5, {}
    for _ in range(rounds):
        for votes, _ in counts:
            odds = log(prior / (1 - prior)) + sum(log(c[v][0] / c[v][1]) for c, v in zip(chance, votes))
            post[votes] = 1 / (1 + exp(-max(-30.0, min(30.0, odds))))
        yes = sum(post[v] * n for v, n in counts)
        no = sum((1 - post[v]) * n for v, n in counts)
        prior = min(0.99, max(0.01, (yes + 1) / (yes + no + 2)))
        chance = [
            {x: (((sum(post[v] * n for v, n in counts if v[i] == x) + 1) / (yes + 3)), ((sum((1 - post[v]) * n for v, n in counts if v[i] == x) + 1) / (no + 3))) for x in (1, 0, -1)}
            for i in range(len(chance))
        ]
    return post, chance


def span_classifier(rows: list[tuple[tuple, float, int]], rounds: int = 300) -> dict[tuple[int, object], float]:
    """Logistic weights of (feature number, value), from (feature values, probability, how often)."""
    weights: dict[tuple[int, object], float] = {}
    total = sum(n for *_, n in rows)
    for _ in range(rounds):
        slope: dict[tuple[int, object], float] = {}
        mass: dict[tuple[int, object], float] = {}
        for values, p, n in rows:
            z = sum(weights.get((i, v), 0.0) for i, v in enumerate(values))
            err = n * (1 / (1 + exp(-max(-30.0, min(30.0, z)))) - p)
            for key in enumerate(values):
                slope[key] = slope.get(key, 0.0) + err
                mass[key] = mass.get(key, 0.0) + n
        for key, g in slope.items():
            w = weights.get(key, 0.0)
            weights[key] = w - (g + 1e-3 * total / (1 + total) * w) / (0.25 * mass[key] * 2 + 1)
    return weights


def found(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of kind, lo, hi, base, by start and then kind."""
    rows = written(candidates(docs), "pii")
    x = F.explode("spans")
    seen = rows.select(x.alias("x")).select("x.*").groupBy("kind", *VOTES, *FEATURES).agg(F.count(F.lit(1)).alias("n")).collect()
    by_votes: dict[tuple[int, ...], int] = {}
    for r in seen:
        key = tuple(r[v] for v in VOTES)
        by_votes[key] = by_votes.get(key, 0) + r["n"]
    post, _ = reliabilities(sorted(by_votes.items()))
    weights = span_classifier([((r["kind"], *((r["kind"], r[f]) for f in FEATURES)), post[tuple(r[v] for v in VOTES)], r["n"]) for r in seen])
    if weights:
        table_of = F.create_map([F.lit(y) for k, w in sorted(weights.items(), key=repr) for y in (_name(*k), float(w))])
    else:
        table_of = F.create_map(F.lit(""), F.lit(0.0))

    def score(s: Column) -> Column:
        names = [F.concat_ws("/", F.lit("0"), s["kind"].cast("string"))]
        names += [F.concat_ws("/", F.lit(str(i + 1)), s["kind"].cast("string"), s[f].cast("string")) for i, f in enumerate(FEATURES)]
        return sum((F.coalesce(F.element_at(table_of, n), F.lit(0.0)) for n in names), F.lit(0.0))

    every = F.transform("spans", lambda s: F.struct(s["lo"].alias("lo"), s["kind"].alias("kind"), s["hi"].alias("hi"), s["base"].alias("base"), (s["base"] | (score(s) >= 0)).alias("good")))
    rows = rows.select("doc_id", F.array_sort(F.filter(every, lambda s: s["good"])).alias("spans"))
    return rows.select("doc_id", F.transform(_apart(F.col("spans")), lambda s: s.dropFields("good")).alias("spans"))


def _apart(spans: Column) -> Column:
    """The base spans, and the others that overlap none of them.  spans: in order.  Two scans instead of comparing all with all."""
    far = 1 << 30
    ends = running(F.transform(spans, lambda s: F.when(s["base"], s["hi"]).otherwise(0)), 0, lambda a, b: F.greatest(a, b))
    starts = F.reverse(running(F.reverse(F.transform(spans, lambda s: F.when(s["base"], s["lo"]).otherwise(far))), far, lambda a, b: F.least(a, b)))
    free = F.zip_with(spans, F.zip_with(ends, starts, lambda e, s: F.struct(e["before"].alias("end"), s["before"].alias("start"))), lambda s, o: F.struct(s.alias("s"), (s["base"] | ((o["end"] <= s["lo"]) & (o["start"] >= s["hi"]))).alias("ok")))
    return F.transform(F.filter(free, lambda x: x["ok"]), lambda x: x["s"])


def _name(i: int, value: object) -> str:
    return "/".join(map(str, (i, *(value if isinstance(value, tuple) else (value,)))))


def _shown(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["lo"].cast("string"), s["hi"].cast("string"))), ",")


def _of_kind(spans: Column, kind: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(_of_kind(base, i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return found(table(spark, sf_dir, "documents")).select("doc_id", *counts, F.sha2(_shown(base), 256).alias("base_sha256"), _shown(F.col("spans")).alias("spans"))
