"""Quality rules: a table of thresholds compiled into column expressions, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditmill.llm.common import WORD, fresh, settled, text_of

#: Frequent function words of the languages in the corpus (fixed values).
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "are", "as", "with", "be", "by", "this"],
    "de": ["der", "die", "und", "das", "in", "zu", "den", "nicht", "von", "ist", "mit", "im", "ein", "eine", "für", "auf"],
    "fr": ["le", "la", "les", "de", "des", "et", "un", "une", "du", "en", "que", "qui", "dans", "pour", "par", "est"],
    "es": ["el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "se", "por", "con", "para", "no", "del"],
}
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``part`` over ``of`` lies between ``low`` and ``high`` percent."""

    name: str
    part: str
    of: str
    low: int | None = None
    high: int | None = None


#: part / of in percent; all sides are counts, so the comparison is exact.
RULES = (
    Rule("word length", "word_chars", "n_words", 200, 1500),
    Rule("symbols", "n_symbols", "n_words", None, 30),
    Rule("stop words", "n_stop_words", "n_words", 3, None),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 50),
    Rule("short lines", "n_lines", "n_words", None, 50),
)

# A position in a text takes the low 30 bits of a window's key, its hash the others.
_LOW = (1 << 30) - 1


def _in_blanks(expression: str) -> str:
    return " ".join(expression.split())


def figures(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The counts behind the rules next to the columns ``keep`` (all by default).

    n_words, word_chars, n_symbols, n_stop_words, n_lines, n_dup_lines, n_repeat_words. A missing text has no words,
    and an empty one all zeros. Repeated 3-word windows are found by sorting hashes of all windows; windows that share
    a part of their hash with another one are then compared word by word, so the count is exact for any length.
    """
    keep = docs.columns if keep is None else keep
    stops = ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words}))
    text, words, lines = fresh(docs, "q_text"), fresh(docs, "q_words"), fresh(docs, "q_lines")
    windows, near, exact, hits = (fresh(docs, f"q_{n}") for n in ("windows", "near", "exact", "hits"))
    kept = [f"`{c}`" for c in keep]
    counts = ["n_words", "word_chars", "n_symbols", "n_stop_words", "n_lines", "n_dup_lines"]
    step = docs.select(*kept, text_of().alias(text)).select(
        *kept, text,
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias(words),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)).alias(lines))
    step = step.select(
        *kept, words,
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))).cast("long").alias("n_symbols"),
        F.expr(f"CAST(size(filter({words}, w -> lower(w) IN ({stops}))) AS BIGINT)").alias("n_stop_words"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.expr(_in_blanks(f"""
            CASE WHEN size({words}) < 3 THEN CAST(array() AS ARRAY<BIGINT>) ELSE sort_array(transform(
              sequence(0, size({words}) - 3),
              i -> (xxhash64({words}[i], {words}[i + 1], {words}[i + 2]) & {~_LOW}L) | CAST(i AS BIGINT))) END
        """)).alias(windows))
    step = step.select(*kept, words, *counts, F.expr(_in_blanks(f"""
        filter({windows}, (k, i) -> coalesce(((k ^ get({windows}, i + 1)) & {~_LOW}L) = 0, false)
                                 OR coalesce(((k ^ get({windows}, i - 1)) & {~_LOW}L) = 0, false))
    """)).alias(near))
    step = step.select(*kept, *counts, F.expr(_in_blanks(f"""
        sort_array(transform(transform({near}, k -> CAST(k & {_LOW}L AS INT)),
          p -> struct({words}[p] AS a, {words}[p + 1] AS b, {words}[p + 2] AS c, p AS p)))
    """)).alias(exact))
    same = "(x.a = get({0}, i {1} 1).a AND x.b = get({0}, i {1} 1).b AND x.c = get({0}, i {1} 1).c)"
    step = step.select(*kept, *counts, F.expr(
        f"sort_array(transform(filter({exact}, (x, i) -> coalesce({same.format(exact, '+')}, false)"
        f" OR coalesce({same.format(exact, '-')}, false)), x -> x.p))").alias(hits))
    repeats = F.expr(f"aggregate(transform({hits}, (p, i) -> least(3, coalesce(get({hits}, i + 1) - p, 3))), 0L,"
                     " (a, x) -> a + x)")
    return settled(step, keep, {c: F.col(c) for c in counts} | {"n_repeat_words": repeats})


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")


def _verdicts(rules: tuple[Rule, ...]) -> dict[str, str]:
    """SQL of each rule; a text without words has no ratio and passes none."""
    out = {}
    for rule in rules:
        bounds = [f"100 * {rule.part} >= {rule.low} * {rule.of}"] if rule.low is not None else []
        bounds += [f"100 * {rule.part} <= {rule.high} * {rule.of}"] if rule.high is not None else []
        out[rule.name] = f"({rule.of} > 0 AND {' AND '.join(bounds)})"
    return out


def passes(rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules of the table as one condition over the counts."""
    return F.expr(" AND ".join(_verdicts(rules).values()))


def digest(docs: DataFrame) -> DataFrame:
    """One row per input row, rows that repeat included."""
    found = figures(docs, ["doc_id"])
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & passes()).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass the base conditions and all rules, with all their columns.

    Columns of ``docs`` that are named like a count are carried under another name meanwhile.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    good = figures(packed, ["row"]).where(~base_failed() & passes())
    return good.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, rid, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT rid, p, ws[p] || chr(10) || ws[p + 1] || chr(10) || ws[p + 2] AS s
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS p FROM w)),
r AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, s) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, CAST(sum(least(3, coalesce(nxt - p, 3))) AS BIGINT) AS n
      FROM (SELECT rid, p, lead(p) OVER (PARTITION BY rid ORDER BY p) AS nxt FROM r) GROUP BY rid),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')) AS n_symbols,
             len(list_filter(ws, lambda x: list_contains([{", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))}], lower(x)))) AS n_stop_words,
             len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
      FROM w LEFT JOIN c USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND n_words > 0 AND word_chars >= 2 * n_words AND word_chars <= 15 * n_words
         AND 100 * n_symbols <= 30 * n_words AND 100 * n_stop_words >= 3 * n_words
         AND n_lines > 0 AND 100 * n_dup_lines <= 50 * n_lines AND 100 * n_lines <= 50 * n_words AS kept
FROM m
"""
