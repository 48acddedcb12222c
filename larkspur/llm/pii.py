"""Personal data by weak supervision: labelers vote on spans, EM weighs them, a span classifier decides. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import scratch

KINDS = ("email", "ip", "card", "phone", "secret")
#: Spans of a kind. Repeats are possessive: what may follow them never begins inside, so they match the same and need no stack.
#: A span begins where its run of characters begins, or where the last span ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?=[0-9](?:[\x20-]?[0-9]){11})[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{16,}+",
}
GATES = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]", "secret": r"[0-9]"}
CONTEXT_CHARS, ROUNDS = 24, 50

# The gazetteers.
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu")
COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91")
CARD_FIRST = ("3", "4", "5", "6")
_NAMES = r"(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key)"
_SETS = _NAMES + r"[\x20\"']{0,3}[=:][\x20\"']{0,3}"
SECRET_NAMES = f"(?i){_SETS}$"
#: Texts that name a secret, and what follows such a name: candidates that the context alone proposes, whatever they look like.
NAMED = f"[=:](?<=(?i:{_NAMES})[\\x20\"']{{0,3}}[=:])[\\x20\"']{{0,3}}[^\\s\"'=:]"
VALUE = f"(?<=(?i:{_SETS}))[^\\s\"'=:,;<>()\\[\\]{{}}][^\\s\"',;<>()\\[\\]{{}}]{{7,}}+"


def pieces(text: Column, kind: str) -> Column:
    """What matches one kind's pattern, in order: (kind, gap, value, before, after), gap the code points since the match before."""
    pattern = PATTERNS[kind]
    if kind == "secret":
        found = F.when(text.rlike(NAMED), _cut(text, kind, f"{VALUE}|{pattern}")).when(text.rlike(GATES[kind]), _cut(text, kind, pattern))
    else:
        found = F.when(text.rlike(GATES[kind]), _cut(text, kind, pattern))
    return F.coalesce(found, F.array().cast("array<struct<kind:int,gap:int,value:string,before:string,after:string>>"))


def _cut(text: Column, kind: str, pattern: str) -> Column:
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    each = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"), F.slice(gaps, F.lit(2), F.size(hits)).alias("next"))
    one = lambda p: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), F.length(p["gap"]).alias("gap"), p["hit"].alias("value"),
        F.right(p["gap"], F.lit(CONTEXT_CHARS)).alias("before"), F.left(p["next"], F.lit(1)).alias("after"),
    )
    return F.transform(each, one)


def placed(found: DataFrame) -> DataFrame:
    """(rid, s) of every span, s: (start, kind, end, value, before, after); found: (rid, found), the pieces of each text.

    Places are running sums over a text's matches of one kind, so work is linear in the spans (but for their sorting).
    """
    each = found.select("rid", F.posexplode("found").alias("n", "p")).select("rid", "n", "p.*")
    so_far = Window.partitionBy("rid", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("value")).over(so_far).cast("int")
    s = F.struct((F.col("end") - F.length("value")).alias("start"), "kind", "end", "value", "before", "after")
    return each.withColumn("end", end).select("rid", s.alias("s"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1)))

    def worth(i: Column) -> Column:
        d = F.coalesce(F.substring(number, -i, F.lit(1)).try_cast("int"), F.lit(0))
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(places, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(s: Column) -> Column:
    """The regex labeler: whether a span meets its kind's own conditions. For the first four kinds these are the base rules."""
    part_ok = F.forall(F.split(s["value"], r"\."), lambda p: F.coalesce(F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))).try_cast("int")), F.lit(999)) <= 255)
    n = F.length(digits(s["value"]))
    return (
        F.when(s["kind"] == 0, F.lit(True))
        .when(s["kind"] == 1, part_ok)
        .when(s["kind"] == 2, F.when(n.between(12, 19), luhn(digits(s["value"]))).otherwise(False))
        .when(s["kind"] == 3, n.between(9, 15))
        .otherwise(s["value"].rlike("^(?:[0-9a-f]+|[0-9A-F]+|(?:AKIA|ASIA)[0-9A-Z]+)$"))
    )


def listed(s: Column) -> Column:
    """The gazetteer labeler: known top-level domains, routable first parts, issuers, country codes, names before a secret."""
    code = F.array(*[F.lit(f"+{c}") for c in COUNTRY_CODES])
    return (
        F.when(s["kind"] == 0, F.lower(F.element_at(F.split(s["value"], r"\."), -1)).isin(*TOP_DOMAINS))
        .when(s["kind"] == 1, ~s["value"].rlike(r"^(?:0+|25[5-9]|2[6-9][0-9]|[3-9][0-9]{2}|[0-9]{4,})\."))
        .when(s["kind"] == 2, F.left(s["value"], F.lit(1)).isin(*CARD_FIRST))
        .when(s["kind"] == 3, F.exists(code, lambda c: F.startswith(s["value"], c)))
        .otherwise(s["before"].rlike(SECRET_NAMES) | s["value"].rlike("^(?:AKIA|ASIA)"))
    )


def framed(s: Column) -> Column:
    """The context labeler: the span stands alone, between blanks, quotes, brackets or marks."""
    last = F.right(s["before"], F.lit(1))
    return last.rlike(r"^$|[\s=:\"'(<\[,;]") & s["after"].rlike(r"^$|[\s.,;:!?\"')>\]]")


LABELERS = (passes, listed, framed)


def features(s: Column) -> list[Column]:
    """What the span classifier sees: value, length, share of digits and the characters around, in a few classes each."""
    n = F.length(s["value"])
    share = F.floor(4 * F.length(digits(s["value"])) / F.greatest(n, F.lit(1)))
    kind_of = lambda c: F.when(c == "", "none").when(c.rlike(r"\s"), "blank").when(c.rlike("[A-Za-z0-9]"), "word").otherwise("mark")
    votes = [F.concat(F.lit(f"vote{i}="), f(s).cast("string")) for i, f in enumerate(LABELERS)]
    return [
        *votes,
        F.concat(F.lit("length="), F.least(F.floor(n / 4), F.lit(12)).cast("string")),
        F.concat(F.lit("digits="), share.cast("string")),
        F.concat(F.lit("before="), kind_of(F.right(s["before"], F.lit(1)))),
        F.concat(F.lit("after="), kind_of(s["after"])),
    ]


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = ROUNDS) -> dict[tuple[int, tuple[int, ...]], float]:
    """Expectation-maximisation per kind: (kind, votes, count) -> probability that spans with these votes are personal data.

    Each labeler has a rate of yes votes on true and on false spans; they start at 0.8 and 0.3 and votes are taken as independent.
    There are no more than 5 kinds times 8 patterns of votes, whatever the input's size.
    """
    out = {}
    for kind in {k for k, _, _ in patterns}:
        own = [(v, c) for k, v, c in patterns if k == kind]
        width = len(own[0][0])
        prior, yes, no = 0.7, [0.8] * width, [0.3] * width
        for _ in range(rounds):
            post = []
            for v, _ in own:
                t = prior * math.prod(yes[i] if x else 1 - yes[i] for i, x in enumerate(v))
                f = (1 - prior) * math.prod(no[i] if x else 1 - no[i] for i, x in enumerate(v))
                post.append(t / (t + f))
            true = sum(p * c for p, (_, c) in zip(post, own, strict=True))
            false = sum((1 - p) * c for p, (_, c) in zip(post, own, strict=True))
            prior = (true + 1) / (true + false + 2)
            yes = [(sum(p * c for p, (v, c) in zip(post, own, strict=True) if v[i]) + 4) / (true + 5) for i in range(width)]
            no = [(sum((1 - p) * c for p, (v, c) in zip(post, own, strict=True) if v[i]) + 1.5) / (false + 5) for i in range(width)]
        out |= {(kind, v): p for p, (v, _) in zip(post, own, strict=True)}
    return out


def labelled(spans: DataFrame) -> DataFrame:
    """rid, s, base, its votes v0.. and its features f, written; base: whether it is a span of the base rules."""
    votes = [f(F.col("s")).cast("int").alias(f"v{i}") for i, f in enumerate(LABELERS)]
    base = ((F.col("s.kind") < 4) & passes(F.col("s"))).alias("base")
    return scratch(spans.select("rid", "s", base, F.col("s.kind").alias("kind"), *votes, F.array(*features(F.col("s"))).alias("f")))


def trained(spans: DataFrame) -> Column:
    """The span classifier as a function of kind and f: log-odds of naive Bayes, fitted to the labelers' posteriors.

    Tables of votes and features leave the executors as counts; both are bounded by their classes.
    """
    names = [f"v{i}" for i in range(len(LABELERS))]
    counted = spans.groupBy("kind", *names).agg(F.count(F.lit(1)).alias("n")).collect()
    post = reliabilities([(r["kind"], tuple(r[v] for v in names), r["n"]) for r in counted])
    each = spans.select("kind", *names, F.explode("f").alias("feature"))
    rows = each.groupBy("kind", *names, "feature").agg(F.count(F.lit(1)).alias("n")).collect()
    weight: dict[tuple[int, str], list[float]] = {}
    total: dict[int, list[float]] = {}
    for r in counted:
        p = post[r["kind"], tuple(r[v] for v in names)]
        t = total.setdefault(r["kind"], [1.0, 1.0])
        t[0], t[1] = t[0] + p * r["n"], t[1] + (1 - p) * r["n"]
    for r in rows:
        p = post[r["kind"], tuple(r[v] for v in names)]
        w = weight.setdefault((r["kind"], r["feature"]), [0.5, 0.5])
        w[0], w[1] = w[0] + p * r["n"], w[1] + (1 - p) * r["n"]
    odds = {f"{k} {f}": math.log(w[0] / total[k][0]) - math.log(w[1] / total[k][1]) for (k, f), w in sorted(weight.items())}
    odds |= {str(k): math.log(t[0] / t[1]) for k, t in sorted(total.items())}
    if not odds:
        return F.lit(0.0)
    table = F.create_map(*[F.lit(x) for item in odds.items() for x in item])
    known = lambda key: F.coalesce(F.try_element_at(table, key), F.lit(0.0))
    kind = F.col("kind").cast("string")
    return F.aggregate("f", known(kind), lambda a, f: a + known(F.concat(kind, F.lit(" "), f)))


def written(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every row of docs (doc_id, text).

    Base spans (leftmost matches per kind that meet their kind's conditions) always stay. Matches that do not meet them, and
    secrets, are candidates: three labelers vote on every span, EM estimates how reliable each is without labels, and a
    classifier trained on the result adds the candidates it takes for personal data. Places are code points, end exclusive.

    A null text is empty and has no span. Rows that share a doc_id get a row each. Other columns are not read. An empty table
    gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    every = scratch(docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), F.concat(*[pieces(text, k) for k in KINDS]).alias("found")))
    spans = labelled(placed(every))
    chosen = spans.select("rid", "s.start", "s.kind", "s.end", "base", trained(spans).alias("odds")).where("base OR odds > 0")
    own = scratch(chosen.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "base"))).alias("all")))
    rows = every.select("doc_id", "rid").join(own.hint("merge"), "rid", "left")
    rows = rows.select("doc_id", F.coalesce("all", F.array().cast("array<struct<start:int,kind:int,end:int,base:boolean>>")).alias("all"))
    rows = rows.withColumn("base", F.filter("all", lambda s: s["base"]))
    count = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]  # noqa: B023
    return rows.select(
        "doc_id", *count, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("all")).alias("spans"),
        (F.size("all") - F.size("base")).cast("long").alias("n_added"),
    )
