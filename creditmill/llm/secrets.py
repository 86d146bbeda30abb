"""Secret scanning: three fixed patterns, and strings that look random to character Markov models.

Two models of successive characters are counted, one of random strings and one of ordinary ones (words, names, paths,
dates, numbers), each half from labelled samples in Spark and half from a fixed labelled list. A candidate string is scored by the difference of its log-likelihoods, as a column expression
over a table of one number per pair of characters.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditmill.llm.common import settled, text_of, written
from creditmill.llm.spans import joined, with_matches

_VALUE = "[A-Za-z0-9+/_.=-]+"
_ASSIGN = rf"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?({_VALUE})"""
#: kind: (pattern, group, least characters of the match or of the group). A run that is too short cannot hold one that
#: is long enough, so the two without group state their least length in the pattern.
BASE = {
    "assign": (_ASSIGN, 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", None, 20),
    "hex": (r"[0-9a-f]{24,}", None, 24),
}
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
#: Ordinary samples: runs of the same characters without letters or too short for a candidate, so that no secret to be
#: found is among them.
ORDINARY = r"(?<![A-Za-z0-9+/_-])(?:[0-9+/_-]{6,}+|[A-Za-z0-9+/_-]{6,15}+)(?![A-Za-z0-9+/_-])"
#: Different texts with and different texts without a base match from which labelled strings are taken: those with the
#: smallest hashes of all. It bounds what the classifier is fitted on, not what is scanned.
SAMPLE_DOCS = 1000
#: Least log-likelihood ratio (natural logarithm) in all, and for each character.
LEAST_TOTAL, LEAST_EACH = 3.0, 0.15
#: Pairs' worth of what the fixed list, or the second character alone, says.
PRIOR = 8
#: Words that the fixed ordinary strings are made of.
WORDS = """
account action admin archive backup batch billing branch buffer build cache client cluster commit config connection content
context counter customer daily data default delete deploy detail device document domain download element encoding error event
example export feature field file filter folder format frame global group handler header history image import index input
install instance internal item job key language latest layout library license limit linux list local lock log machine main
manager master maximum memory message method minimum mobile model module monitor name network node number object office open
option order output package page parameter parent partner path pattern payment people performance picture pipeline place plugin
policy pool port position price print private process product profile program project property protocol provider public query
queue quick range reader record region release remote report request resource response result retry review role root route rule
sample schema science screen script search section security select sequence server service session setting share short simple
size source special standard start state station status storage stream string style summary support system table target task
team template term test text thread time timeout title token tool total track transfer type understanding unit update upload
user value vector version video view virtual volume warning water weather window work world writer year
""".split()

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=."
_STATES = len(ALPHABET) + 1  # 0: the start, and any other character


def fixed_ordinary() -> Iterator[str]:
    """Ordinary strings in the forms that candidates take: names in all cases, paths, dates, numbers, rule lines."""
    for k in range(240):
        a, b, c, d = (WORDS[(k * step + at) % len(WORDS)] for step, at in ((7, 0), (13, 5), (29, 11), (31, 17)))
        n = int(hashlib.sha512(str(k).encode()).hexdigest(), 16)
        digits, year, month, day = str(n), 1980 + n % 50, f"{1 + n // 50 % 12:02}", f"{1 + n // 600 % 28:02}"
        hour, minute, second = (f"{n // by % most:02}" for by, most in ((16800, 24), (403200, 60), (24192000, 60)))
        yield from (f"{a}-{b}-{c}", f"{a}-of-the-{b}-{c}", f"{a}-{year}-{month}-{day}", f"{a}-v{n % 10}-{n // 10 % 20}-{n % 7}")
        yield from (f"{a}_{b}_{c}", f"{a}_{b}_{n % 1000}", f"{a}_{b}_{c}".upper(), f"{a}_{b}_{n % 100}".upper())
        yield from (a + b + c, a + b.title() + c.title(), a.title() + "IsA" + b.title() + c.title(), a + "OfThe" + b.title(),
                    a.title() + b.title() + c.title() + str(n % 10),
                    ("XML", "HTTP", "API", "URL", "JSON", "SQL", "ID", "IO")[k % 8] + a.title() + b.title())
        yield from (f"/{a}/{b}/{c}/{d}", f"{a}/{b}-{c}/{d}", f"/{a}/{b}_{c}/{year}/{month}/{day}", f"{a}/{b}{n % 10}/{c}")
        yield from (f"{year}-{month}-{day}T{hour}-{minute}", f"{year}-{month}-{day}", f"{year}{month}{day}",
                    f"{year}{month}{day}_{hour}{minute}{second}", f"{month}/{day}/{year}")
        yield from (digits[:8 + n % 17], digits[-80:], f"+{10 + n % 90}-{digits[:3]}-{digits[3:10]}",
                    f"{digits[:4]}-{digits[4:8]}-{digits[8:12]}")
        yield from ("-_/+"[k % 4] * (8 + n % 40), ALPHABET[k % 62] * (8 + n % 17))


def fixed_random() -> Iterator[str]:
    """Random strings over the alphabets of base64."""
    for k in range(400):
        digest = hashlib.sha512(str(k).encode()).digest()
        yield base64.b64encode(digest).decode()[:64]
        yield base64.urlsafe_b64encode(digest[::-1]).decode()[:64]


def labelled_samples(docs: DataFrame, n: int = SAMPLE_DOCS) -> DataFrame:
    """(value, random): values of base matches, and short runs of candidates' characters in documents without one."""
    texts = docs.select(text_of().alias("t")).withColumns({"h": F.xxhash64("t"), "n": F.length("t")})
    any_base = F.col("t").rlike("|".join(f"(?:{p})" for p, _, _ in BASE.values()))
    # copies of a text count once, so that a large group of them does not fill a class
    different = written(texts.select("h", "n", any_base.alias("random")).distinct(), "labels")
    chosen = [different.where(F.col("random") == label).orderBy("h", "n").limit(n) for label in (True, False)]
    strings = F.flatten(F.array(*[F.regexp_extract_all("t", F.lit(p), F.lit(g or 0)) for p, g, _ in BASE.values()]))
    words = F.regexp_extract_all("t", F.lit(ORDINARY), F.lit(0))
    taken = texts.join(F.broadcast(chosen[0].unionAll(chosen[1])), ["h", "n"]).dropDuplicates(["h", "n"])
    values = taken.select("random", F.explode(F.when(F.col("random"), F.filter(
        strings, lambda s: F.length(s) >= 16)).otherwise(words)).alias("value"))
    return values.select("value", "random")


def _states(value: Column) -> Column:
    """The start and the state of each character."""
    return F.concat(F.array(F.lit(0)), F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c)))


def _chance(counts: dict[tuple[int, int], int], known: list[list[float]] | None = None) -> list[list[float]]:
    """The chance of each state after each. Pairs seen rarely lean on ``known``, or else on how often their second
    character is seen at all, counted one more, so that none is impossible."""
    rows, seen = Counter(), Counter()
    for (a, b), n in counts.items():
        rows[a] += n
        seen[b] += n
    known = known or [[(seen[b] + 1) / (sum(seen.values()) + _STATES) for b in range(_STATES)]] * _STATES
    return [[(counts.get((a, b), 0) + PRIOR * known[a][b]) / (rows[a] + PRIOR) for b in range(_STATES)] for a in range(_STATES)]


def train(samples: DataFrame) -> list[float] | None:
    """The log-likelihood ratio of each pair of states, row by row; None unless both labels have samples.

    Counts are taken in Spark over all samples; at most two tables of 69 by 69 numbers come to the driver. The models of
    both labels are made alike: half the weight is on the samples, half on the fixed list, which shows all characters.
    """
    chains = samples.where(F.length("value") > 0).select("random", _states(F.col("value")).alias("s"))
    pairs = chains.select("random", F.explode(F.expr("transform(sequence(0, size(s) - 2), i -> s[i] * 1000 + s[i + 1])")).alias("p"))
    counts = {True: {}, False: {}}
    for r in pairs.groupBy("random", "p").agg(F.count("*").alias("n")).collect():
        counts[r.random][r.p // 1000, r.p % 1000] = r.n
    if not (counts[True] and counts[False]):
        return None
    sampled, fixed = {}, {}
    for label, strings in ((True, fixed_random()), (False, fixed_ordinary())):
        chained = ([0] + [ALPHABET.find(c) + 1 for c in value] for value in strings)
        fixed[label] = _chance(Counter(p for s in chained for p in zip(s, s[1:])))
        sampled[label] = _chance(counts[label], fixed[label])
    return [math.log((sampled[True][a][b] + fixed[True][a][b]) / (sampled[False][a][b] + fixed[False][a][b]))
            for a in range(_STATES) for b in range(_STATES)]


def scan(docs: DataFrame, model: list[float] | None) -> DataFrame:
    """doc_id, base and spans (arrays of start, rank, end, kind; end exclusive, in code points), one row per input row.

    A missing text is an empty one and has no spans; rows that repeat are scanned each; an empty table gives no rows.
    Without a model only base spans are found. Model spans that overlap a base span are left out.
    """
    df = docs.select("doc_id", text_of().alias("t"))
    for kind, (pattern, group, _) in BASE.items():
        df = with_matches(df, "t", pattern, kind, group)
    parts = []
    for rank, (kind, (_, group, least)) in enumerate(BASE.items()):
        measured = "x.value" if group else "x.hit"
        parts.append(f"transform(filter({kind}, x -> length({measured}) >= {least}),"
                     f" x -> struct(x.start AS start, {rank} AS rank, x.end AS end, '{kind}' AS kind))")
    if model is None:
        base = F.expr(f"concat({', '.join(parts)})")
        return settled(df, ["doc_id"], {"base": base, "spans": base})
    df = with_matches(df.select("doc_id", "t", F.expr(f"concat({', '.join(parts)})").alias("base")), "t", CANDIDATE, "c")
    df = df.select("doc_id", "base", F.expr(
        "filter(c, x -> NOT exists(base, b -> b.start < x.end AND x.start < b.end))").alias("c"))
    table = F.array(*[F.lit(x) for x in model])
    df = df.withColumn("states", F.transform("c", lambda x: _states(x["hit"])))
    if_any = F.when(F.size("c") > 0, table)  # the table is the same literal for every row
    df = df.withColumn("llr", if_any).withColumn("scores", F.expr(
        f"transform(states, s -> aggregate(sequence(1, size(s) - 1), 0D, (a, i) -> a + llr[s[i - 1] * {_STATES} + s[i]]))"))
    added = F.expr(
        f"transform(filter(transform(c, (x, i) -> struct(x.start AS start, x.end AS end, scores[i] AS score)),"
        f" x -> x.score >= {LEAST_TOTAL}D AND x.score >= {LEAST_EACH}D * (x.end - x.start)),"
        f" x -> struct(x.start AS start, {len(BASE)} AS rank, x.end AS end, 'random' AS kind))")
    return settled(df, ["doc_id"], {"base": F.col("base"), "spans": F.concat("base", added)})


def digest(docs: DataFrame) -> DataFrame:
    found = scan(docs, train(labelled_samples(docs)))
    counts = [F.expr(f"CAST(size(filter(base, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))
