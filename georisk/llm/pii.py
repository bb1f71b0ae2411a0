"""Personal data by weak supervision, with DataFrame operations only.

Candidate spans are the base matches of each kind and looser forms (bracketed
"at" addresses, national telephone numbers, card-like numbers that fail their
checksum). Four labelers vote on every candidate: format, gazetteer, context and
shape, each yes, no or abstain. Expectation-maximisation over the counts of all
vote patterns estimates how reliable each labeler is for each kind (Dawid-Skene,
two classes), and a logistic span classifier is trained on its posteriors. It sees
the votes and traits that no labeler looks at: a cue behind the span, words for
other numbers before it, blanks on both sides, a regular layout, placeholder digits.
Base matches always stay; of the others, those the classifier accepts are added where
they overlap no base match. The pattern table has at most kinds x 3**4 x 2**5 rows
however large the corpus is, so the driver may estimate from it.

Defined cases: null text counts as empty; repeated rows and null keys are rows
like any other; spans are code points, end exclusive; empty input -> empty
output; other columns are not read. Patterns use possessive loops, so long
texts neither overflow the matcher's stack nor make it backtrack.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from georisk.llm.common import table, written

KINDS = ["email", "ip", "card", "phone"]

# The base patterns.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: The same languages and matches, for the JVM's matcher: no backtracking into
#: runs, and a run that failed is not tried again from its middle.
JVM = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": PHONE,
}
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?(?:[(\[]dot[)\]]|\.) ?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+.(-])(?<!\+[0-9]{1,3} )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-]?[0-9])",
}
BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
# Gazetteers.
GENERIC = ("com|org|net|edu|gov|mil|int|info|biz|name|pro|aero|coop|museum|jobs|mobi|travel|tel|post|cat|asia|"
           "app|dev|web|online|shop|site|store|tech|cloud|blog|club|email|news|agency|company|group|xyz")
#: Two letters are a country's by the rule of the root zone.
DOMAIN = rf"(?i)[^A-Za-z0-9-](?:{GENERIC}|[a-z]{{2}})$"
DIALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
AREA = r"^\(?[2-9][0-8][0-9]\)?[ .-][2-9]"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[0689]|6[025])"
RESERVED = r"^(?:0|10|127|169\.254|172\.(?:1[6-9]|2[0-9]|3[01])|192\.168|2[2-5][0-9])\."
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|correo|courriel|write|reply)\b[^\n]{0,20}$",
    "ip": r"(?i)\b(?:ip|address|host|server|client|login)\b[^\n]{0,20}$",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta)\b[^\n]{0,20}$",
    "phone": r"(?i)\b(?:tel|telephone|phone|call|fax|mobile|cell|telefon|mobil)\b[^\n]{0,20}$",
}
#: Words that announce numbers of other sorts, and digits written as examples.
OTHER = r"(?i)(?:\b(?:order|invoice|version|build|ref|reference|isbn|issn|sku|serial|ticket|total|sum|part|item|model|id|no|nr)\b|#)[^\n]{0,12}$"
FILLER = r"(?:([0-9])\1{5}|0123456|1234567|9876543)"
AFTER = {
    "email": r"(?i)^[^\n]{0,20}\b(?:e-?mail|mail|inbox|correo|courriel)\b",
    "ip": r"(?i)^[^\n]{0,20}\b(?:port|address|host|server)\b",
    "card": r"(?i)^[^\n]{0,20}\b(?:cvv|cvc|exp|expires|expiry|card|valid)\b",
    "phone": r"(?i)^[^\n]{0,20}\b(?:ext|extension|mobile|cell|phone|fax|office|home)\b",
}
LAYOUT = {
    "email": r"^[A-Za-z0-9]+(?:[._+-][A-Za-z0-9]+)*[^A-Za-z0-9._+-]",
    "ip": r"^(?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*)){3}$",
    "card": r"^(?:[0-9]+|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})$",
    "phone": r"^(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]+\) ?)?[0-9]+(?:([ .-])[0-9]+(?:\1[0-9]+)*)?$",
}
NEARBY = 40
TRAITS = 5
LABELERS = 4
NO, ABSTAIN, YES = 0, 1, 2


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    back = F.split(F.reverse(number), "")
    values = F.transform(back, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """Whether a base match counts."""
    if kind == "ip":
        return m.rlike(rf"^(?:{BYTE}\.){{3}}{BYTE}$")
    n = F.length(digits(m))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits(m))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _vote(yes: Column | None = None, no: Column | None = None) -> Column:
    out = F.lit(ABSTAIN)
    if no is not None:
        out = F.when(no, NO).otherwise(out)
    return F.when(yes, YES).otherwise(out) if yes is not None else out


def votes(kind: str, m: Column, before: Column, after: Column, base: Column) -> Column:
    """The four labelers' votes as one number in base 3."""
    if kind == "email":
        known = _vote(m.rlike(DOMAIN))
    elif kind == "ip":
        known = _vote(no=m.rlike(RESERVED))
    elif kind == "card":
        known = _vote(digits(m).rlike(ISSUERS), ~digits(m).rlike(ISSUERS))
    else:
        known = _vote(m.rlike(DIALLING) | m.rlike(AREA))
    form = _vote(base, ~base if kind == "card" else None)
    context = _vote(before.rlike(CUES[kind]))
    shape = _vote(no=before.rlike(r"[A-Za-z0-9_=/#$-]$") | after.rlike(r"^[A-Za-z0-9_=/-]"))
    return form + known * 3 + context * 9 + shape * 27


def traits(kind: str, m: Column, before: Column, after: Column) -> Column:
    """What the classifier sees of a span besides the votes, as one number in base 2."""
    seen = [after.rlike(AFTER[kind]), before.rlike(OTHER), before.rlike(r"(?:^|[\s(,;:])$") & after.rlike(r"^(?:$|[\s),;:.!?])"),
            m.rlike(LAYOUT[kind]), (m if kind == "ip" else digits(m)).rlike(FILLER)]
    out = F.lit(0)
    for i, c in enumerate(seen):
        out = out + F.when(c, 1 << i).otherwise(0)
    return out


def _places(parts: Column, found: Column) -> Column:
    """Start of each match: text between matches and matches alternate. Sums are taken
    by chunks of 256, so that many matches in one text stay cheap."""
    sizes = F.zip_with(F.slice(parts, 1, F.size(found)), found, lambda p, m: F.length(p) + F.length(m))

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda s, x: s + x)

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / 256).cast("int")),
                         lambda c: total(F.slice(sizes, c * 256 + 1, 256)))
    at = F.transform(found, lambda m, i: F.struct(m.alias("m"), i.alias("i")))
    return F.transform(at, lambda x: total(F.slice(chunks, 1, F.floor(x["i"] / 256).cast("int"))) + total(
        F.slice(sizes, F.floor(x["i"] / 256).cast("int") * 256 + 1, x["i"] % 256)) + F.length(F.get(parts, x["i"])))


def _matches(df: DataFrame, name: str, pattern: str, sign: str) -> DataFrame:
    """Adds ``name``: array of (m, start) for the matches of ``pattern`` in column __t."""
    none = F.array().cast("array<string>")
    df = df.withColumn("__m", F.when(F.col("__t").rlike(sign), F.regexp_extract_all("__t", F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn("__p", F.when(F.size("__m") > 0, F.split("__t", pattern, -1)))
    df = df.withColumn("__at", F.when(F.size("__m") > 0, _places(F.col("__p"), F.col("__m"))).otherwise(
        F.array().cast("array<int>")))
    return df.withColumn(name, F.zip_with("__m", "__at", lambda m, s: F.struct(m.alias("m"), s.alias("s")))).drop("__m", "__p", "__at")


def _spans(kind: int, matches: str, base: bool) -> Column:
    name = KINDS[kind]

    def one(x: Column) -> Column:
        m, s = x["m"], x["s"]
        e = s + F.length(m)
        ok = valid(name, m) if base else F.lit(False)
        low = F.greatest(s - NEARBY, F.lit(0))
        before, after = F.substring(F.col("__t"), low + 1, s - low), F.substring(F.col("__t"), e + 1, F.lit(NEARBY))
        return F.struct(F.lit(kind).alias("kind"), s.alias("start"), e.alias("end"), ok.alias("base"), votes(
            name, m, before, after, ok).alias("votes"), traits(name, m, before, after).alias("traits"))

    found = F.transform(F.col(matches), one)
    if not base:
        return found
    # A base match that fails is no candidate, but for cards of the right length.
    return F.filter(found, lambda x: x["base"]) if name != "card" else F.filter(
        F.transform(F.col(matches), lambda x: F.when(F.length(digits(x["m"])).between(13, 19), one(x))), lambda x: x.isNotNull())


def candidates(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """``key`` columns and ``__found``: all candidate spans with their votes."""
    out = df.select(*key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__t"))
    signs = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][0-9 -]{11}[0-9]", "phone": r"\+[0-9]"}
    for kind in KINDS:
        out = _matches(out, f"__{kind}", JVM[kind], signs[kind])
    out = _matches(out, "__loose_email", LOOSE["email"], r"[(\[]at[)\]]")
    out = _matches(out, "__loose_phone", LOOSE["phone"], r"[0-9]{3}[ .-][0-9]{4}")
    sure = F.concat(*[_spans(i, f"__{kind}", True) for i, kind in enumerate(KINDS)])
    more = F.concat(_spans(0, "__loose_email", False), _spans(3, "__loose_phone", False))
    out = out.withColumn("__sure", sure).withColumn("__more", more)
    every = F.concat("__sure", "__more")
    return out.withColumn("__base", F.filter("__sure", lambda x: x["base"])).withColumn("__found", F.when(
        F.size(every) > F.size("__base"), F.concat("__base", F.filter(F.concat(F.filter(
            "__sure", lambda x: ~x["base"]), "__more"), lambda x: ~F.exists(
                "__base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))))).otherwise(F.col("__base"))
    ).select(*key, "__found")


def unpack(code: int) -> list[int]:
    return [code // 3**i % 3 for i in range(LABELERS)]


def estimate(counts: dict[tuple[int, int], int], rounds: int = 30) -> dict[tuple[int, int], float]:
    """Posterior of each (kind, vote pattern) by expectation-maximisation."""
    post = {}
    for kind, code in counts:
        v = unpack(code) + unpack(code)[:1]  # the format's vote counts twice at the start
        post[kind, code] = (1 + v.count(YES)) / (2 + v.count(YES) + v.count(NO))
    size = defaultdict(int)
    for (kind, _), n in counts.items():
        size[kind] += n
    for _ in range(rounds):
        mass = defaultdict(float)
        for (kind, code), n in counts.items():
            for y, w in ((1, post[kind, code]), (0, 1 - post[kind, code])):
                mass[kind, y] += n * w
                for i, v in enumerate(unpack(code)):
                    mass[kind, y, i, v] += n * w
        for kind, code in counts:
            log = []
            for y in (0, 1):
                # Prior counts say that a yes is likelier for personal data and a no for other
                # text; for the format, whose checksums are seldom wrong, they weigh as all spans,
                # and so they do for both classes, lest the commoner one decide alone.
                total = math.log(mass[kind, y] + size[kind])
                for i, v in enumerate(unpack(code)):
                    prior = {YES: (0.2, 0.4), ABSTAIN: (0.4, 0.4), NO: (0.4, 0.2)}[v][y]
                    weight = 5.0
                    if i == 0:
                        prior = {YES: (0.05, 0.9), ABSTAIN: (0.05, 0.05), NO: (0.9, 0.05)}[v][y]
                        weight += size[kind]
                    total += math.log((mass[kind, y, i, v] + weight * prior) / (mass[kind, y] + weight))
                log.append(total)
            post[kind, code] = 1 / (1 + math.exp(max(-700, min(700, log[0] - log[1]))))
    return post


def features(kind: int, code: int, seen: int) -> list[int]:
    """Indices of a span's features: its kind, and within the kind each labeler's vote and each trait."""
    at = [kind] + [len(KINDS) + (kind * LABELERS + i) * 3 + v for i, v in enumerate(unpack(code))]
    traits_from = len(KINDS) * (1 + LABELERS * 3) + kind * TRAITS
    return at + [traits_from + i for i in range(TRAITS) if seen >> i & 1]


def train(counts: dict[tuple[int, int, int], int], post: dict[tuple[int, int], float], steps: int = 400) -> list[float]:
    """Weights of the logistic span classifier, fitted to the posteriors over (kind, votes,
    traits); patterns are weighted by their share of the kind, so the corpus size does not matter."""
    w = [0.0] * (len(KINDS) * (1 + LABELERS * 3 + TRAITS))
    size = defaultdict(int)
    for (kind, _, _), n in counts.items():
        size[kind] += n
    rows = [(features(*p), n / size[p[0]], post[p[:2]]) for p, n in counts.items()]
    for _ in range(steps):
        grad = [-1e-4 * x for x in w]
        for at, share, want in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[j] for j in at)))))
            for j in at:
                grad[j] += share * (want - p)
        w = [x + 0.5 * g for x, g in zip(w, grad)]
    return w


def accepted(found: DataFrame) -> list[tuple[int, int, int]]:
    """The (kind, votes, traits) patterns that the trained classifier takes for personal data."""
    rows = found.select(F.explode("__found").alias("s")).groupBy("s.kind", "s.votes", "s.traits").count().collect()
    counts = {(r["kind"], r["votes"], r["traits"]): r["count"] for r in sorted(rows)}
    voted = defaultdict(int)
    for (kind, code, _), n in counts.items():
        voted[kind, code] += n
    w = train(counts, estimate(dict(voted)))
    return [p for p in counts if sum(w[j] for j in features(*p)) >= 0]


def detect(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """``key`` columns, ``__base`` and ``__spans``: arrays of (kind, start, end, base, votes, traits)
    by kind, then start; ``__spans`` holds the base spans and those the method adds."""
    found = written(candidates(df, key, text), "pii-candidates")
    good = [(k * 3**LABELERS + v << TRAITS) + t for k, v, t in accepted(found)]
    taken = F.filter("__found", lambda x: x["base"] | (
        (x["kind"] * 3**LABELERS + x["votes"]) * (1 << TRAITS) + x["traits"]).isin(good))
    return found.select(*key, F.array_sort(F.filter("__found", lambda x: x["base"])).alias("__base"),
                        F.array_sort(taken).alias("__spans"))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; overlapping spans become one."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("k"))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(ordered, begin, lambda a, s: F.struct(
        F.greatest(a["at"], s["e"]).alias("at"),
        F.when(s["s"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.array(
            F.substring(text, a["at"] + 1, s["s"] - a["at"]), F.get(names, s["k"])))).alias("out")))
    rest = F.substring(text, done["at"] + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(done["out"], ""), rest)).otherwise(text)


def op8_pii(spark, sf_dir):
    found = detect(table(spark, sf_dir, "documents"), ["doc_id"])
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    kinds = F.transform("__base", lambda s: s["kind"])
    n = [F.size(F.filter(kinds, lambda k: k == i)).cast("long").alias(f"n_{KINDS[i]}") for i in range(len(KINDS))]
    return found.select("doc_id", *n, F.sha2(joined("__base"), 256).alias("base_sha256"), joined("__spans").alias("spans"))


_BYTE_SQL = "0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_DIGITS_SQL = "regexp_replace(@v, '[^0-9]', '', 'g')"
_LUHN_SQL = (f"list_sum(list_transform(string_split(reverse({_DIGITS_SQL}), ''), lambda c, i: CASE WHEN i % 2 = 1 "
             "THEN CAST(c AS INT) WHEN CAST(c AS INT) > 4 THEN CAST(c AS INT) * 2 - 9 ELSE CAST(c AS INT) * 2 END)) % 10 = 0")
#: Conditions on the value of a base match.
SQL_KINDS = [
    ("email", EMAIL, "TRUE", 0),
    ("ip", IP, rf"regexp_full_match(@v, '({_BYTE_SQL}\.){{3}}{_BYTE_SQL}')", 0),
    ("card", CARD, f"length({_DIGITS_SQL}) BETWEEN 13 AND 19 AND {_LUHN_SQL}", 0),
    ("phone", PHONE, f"length({_DIGITS_SQL}) BETWEEN 9 AND 15", 0),
]
