"""Mixing sources to target weights by nested hash thresholds, without sorting documents.

Every document has a hash. A source takes all its documents as often as its target holds them whole, and one time more
those with a hash up to a threshold. The threshold is found by summing sizes by source and hash bucket, taking whole
buckets while the budget lasts, and going on inside the one bucket where it ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditmill.llm.common import WORD, spread_join, text_of, written

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_TIMES = 2
SEED = 7
HASH_BITS, LEVEL_BITS = 60, 12
#: So many rows of one source each are broadcast.
SMALL = 10_000
KEYS = ["named", "name"]


def hash_of(doc_id: Column, seed: int = SEED) -> Column:
    """60 bits of MD5 over seed and doc_id, as SQL engines agree on it; a missing doc_id hashes as empty."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def sizes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, h) per row; size is the number of words, 0 for a missing text."""
    return docs.select("doc_id", "source", F.size(F.regexp_extract_all(text_of(), F.lit(WORD), F.lit(0))).cast("long").alias("size"),
                       hash_of(F.col("doc_id"), seed).alias("h"))


def _key_source(rows: DataFrame) -> DataFrame:
    """A key without missing values for the source."""
    return rows.withColumns({"named": F.col("source").isNotNull(), "name": F.coalesce(F.col("source").cast("string"), F.lit(""))})


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT,
            most_times: int = MOST_TIMES) -> DataFrame:
    """Adds target to (source, source_size, n), which has one row per source.

    Weights repeat over the sources by code point, the missing source last. Shares above ``most_times`` the source's
    size are cut there and the excess is shared again by weight. The sources that end up cut are those with the least
    room per weight, so running sums in that order give the result of all rounds at once. The two windows hold one row
    per source: sources are entries of a configuration, not data.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_room = Window.orderBy("room", F.col("source").isNull(), "source")
    weight = F.array(*[F.lit(w) for w in weights])[((F.row_number().over(by_name) - 1) % len(weights)).cast("int")]
    ranked = by_source.withColumn("weight", weight).withColumn(
        "most", (most_times * F.col("source_size")).cast("long")).withColumn(
        "room", F.col("most").cast("double") / F.col("weight"))
    ahead = by_room.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = ((F.sum("source_size").over(everything) * share_percent - 100 * F.coalesce(F.sum("most").over(ahead), F.lit(0)))
             .cast("double") / (100 * F.sum("weight").over(onward)))
    # the first source that need not be cut gives the share of one weight for itself and all after it
    filled = ranked.withColumns({"level": level, "nth": F.row_number().over(by_room)}).withColumn("share", F.min(
        F.when(F.col("level") <= F.col("room"), F.struct("nth", "level"))).over(everything)["level"])
    return filled.withColumn("target", F.when(F.col("room") <= F.coalesce("share", "room"), F.col("most").cast("double"))
                             .otherwise(F.col("share") * F.col("weight"))).select("source", "source_size", "n", "target")


def _with_small(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Join with one row per group: broadcast up to a checked number of them, beyond that a shuffle."""
    return rows.join(F.broadcast(groups) if groups.count() <= SMALL else groups, keys)


def thresholds(rows: DataFrame, budgets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., limit): of each group, rows (keys, size, h) with h <= limit hold about ``budget`` (keys, budget) in all.

    Rows are taken in order of h while they fit; those at which the budget ends are taken if that comes nearer. Rows
    with equal h go together. Each level sums only the rows of the bucket in which the last level ended.
    """
    state = written(budgets.select(*keys, "budget", F.lit(0).cast("long").alias("inside")), "budgets")
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        inside = F.shiftright("h", shift + LEVEL_BITS) == F.col("inside")
        sums = _with_small(rows, state, keys).where(inside).groupBy(
            *keys, "budget", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("s"))
        order = Window.partitionBy(*keys).orderBy("bucket")
        last = sums.withColumn("before", F.sum("s").over(order) - F.col("s")).where("before < budget").groupBy(*keys).agg(
            F.max(F.struct("bucket", "before", "s", "budget")).alias("e")).select(*keys, "e.*")
        state = written(last.select(*keys, (F.col("budget") - F.col("before")).alias("budget"),
                                    F.col("bucket").alias("inside"), "s"), "budgets")
    nearer = F.col("s") - F.col("budget") <= F.col("budget")
    return state.select(*keys, (F.col("inside") - (~nearer).cast("long")).alias("limit"))


def limits(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT,
           most_times: int = MOST_TIMES) -> DataFrame:
    """(named, name, n, source_size, target, times, limit), one row per source: every document is taken ``times``
    times, and once more if its hash is at most ``limit``."""
    totals = sized.groupBy("named", "name").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    aims = targets(totals.select(F.when(F.col("named"), F.col("name")).alias("source"), "source_size", "n"),
                   weights, share_percent, most_times)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    aims = written(_key_source(aims).drop("source").withColumn("times", F.least(times, F.lit(most_times))), "targets")
    rest = aims.select(*KEYS, (F.col("target") - F.col("times") * F.col("source_size")).alias("budget"))
    found = thresholds(sized, rest.where("budget > 0"), KEYS)
    return written(aims.join(found, KEYS, "left").withColumn("limit", F.coalesce("limit", F.lit(-1))), "limits")


def plan(docs: DataFrame, **shares) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, one row per input row.

    taken is a whole multiple of size, so a source misses its target by at most half a document (rows that share a
    doc_id and a source go together). Documents without words take 0. An empty table gives no rows.
    """
    sized = written(_key_source(sizes(docs)), "sizes")
    out = spread_join(sized, limits(sized, **shares), KEYS, "n", ["doc_id"])
    taken = F.col("size") * (F.col("times") + (F.col("h") <= F.col("limit")).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def digest(docs: DataFrame) -> DataFrame:
    return plan(docs).drop("source")


def take(docs: DataFrame, **shares) -> DataFrame:
    """The rows of the mix with all columns of ``docs``, each as often as it is taken; copies of a row are equal rows.

    Documents without words are not part of a mix. The texts are not shuffled: a row's own hash and its source's limit
    decide.
    """
    found = limits(written(_key_source(sizes(docs)), "sizes"), **shares)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                         F.col("source").alias("source"), hash_of(F.col("doc_id")).alias("h"),
                         text_of().rlike(WORD).alias("words"))
    packed = _key_source(packed.where("words")).drop("source")
    if found.count() <= SMALL:
        joined = packed.join(F.broadcast(found), KEYS)
    else:
        joined = spread_join(packed, found, KEYS, "n", ["h"])
    times = (F.col("times") + (F.col("h") <= F.col("limit")).cast("long")).cast("int")
    each = joined.withColumn("times", times).where("times > 0").select(
        "row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("nth"))
    return each.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
                  CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
           FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 2 * source_size AS most,
             ([5, 2, 1])[(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight FROM s),
r AS (SELECT *, CAST(most AS DOUBLE) / weight AS room FROM w),
l AS (SELECT *, CAST(CAST(150 * sum(source_size) OVER () - 100 * coalesce(sum(most) OVER (ORDER BY room, source IS NULL, source
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS DOUBLE)
             / CAST(100 * sum(weight) OVER (ORDER BY room, source IS NULL, source
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level,
             row_number() OVER (ORDER BY room, source IS NULL, source) AS nth FROM r),
f AS (SELECT *, (SELECT level FROM l WHERE level <= room ORDER BY nth LIMIT 1) AS share FROM l),
t AS (SELECT source, source_size, CASE WHEN room <= coalesce(share, room) THEN CAST(most AS DOUBLE) ELSE share * weight END AS target FROM f),
b AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 2) ELSE 0 END AS times FROM t),
c AS (SELECT d.*, source_size, target, times, target - times * source_size AS budget,
             CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h) AS BIGINT) AS upto,
             CAST(sum(size) OVER (PARTITION BY d.source, h) AS BIGINT) AS s
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       size * (times + CASE WHEN budget > 0 AND upto - s < budget AND upto - budget <= budget - (upto - s) THEN 1 ELSE 0 END) AS taken
FROM c
"""
