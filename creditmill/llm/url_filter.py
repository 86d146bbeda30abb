"""URL rules by a sort-merge range join over reversed-host keys.

Labels of a host in reverse order make a host and all its subdomains one interval of keys. Keys are cut into ranges of
about equal numbers of pages, and a rule goes to every range its interval meets. Each range is then sorted and swept
once: a rule is put on a stack where its interval begins and taken off where it ends, so the stack holds the nested
rules over a page's host, and the page takes the longest whose path starts its own.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path), fixed values.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/")]
DEFAULT = "allow"
#: Keys sampled per range to find where to cut.
SAMPLES = 64
PAGES_PER_RANGE = 1_000_000


def rule_table(spark: SparkSession, rules=None) -> DataFrame:
    return spark.createDataFrame(RULES if rules is None else rules, "verdict string, host string, path string")


def split_url(pages: DataFrame, url: str = "url") -> list:
    """host and path expressions; both empty without ``://``."""
    rest = F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return [F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), path.alias("path")]


def _key(host):
    """Labels in reverse, each ended by a blank, which sorts before whatever a label holds."""
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), " "), F.lit(" ")))


def _sweep(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    stack, current = [], None
    for batch in batches:
        rows = batch.to_pydict()
        rule, verdict, out = [], [], []
        for k, (part, key, kind) in enumerate(zip(rows["part"], rows["key"], rows["kind"])):
            if part != current:
                stack, current = [], part
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((key, rows["path"][k], rows["rule"][k], rows["verdict"][k]))
                continue
            fits = [r for r in stack if rows["path"][k].startswith(r[1])] if rows["host"][k] else []
            # the longest rule; of equally long ones the longer host, then the blocking one
            best = max(fits, key=lambda r: (len(r[2]), len(r[0]), r[3] == "block"), default=None)
            rule.append(best[2] if best else None)
            verdict.append(best[3] if best else default)
            out.append(k)
        out = pa.array(out, pa.int64())  # may be empty: a batch can hold rules alone
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id").take(out), batch.column("host").take(out), batch.column("path").take(out),
             pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
            names=["page_id", "host", "path", "rule", "verdict"])


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, ranges: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict; one row per input row.

    Pages without a url, or without ``://``, have an empty host and path and no rule. Rules with an empty host or
    without a path are left out. Rows that repeat are judged each; an empty table gives no rows.
    """
    spark = pages.sparkSession
    host, path = split_url(pages)
    keyed = pages.select("page_id", host, path).withColumn("key", _key(F.col("host")))
    # pages of one host differ in path and id, so that a range can end inside a host
    fine = F.concat("key", F.lit("\u0001"), F.xxhash64("path", "page_id").cast("string"))
    keyed = keyed.withColumn("fine", fine)
    count = keyed.count()
    if ranges is None:
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // PAGES_PER_RANGE))
    share = min(1.0, SAMPLES * ranges / max(1, count))
    sample = sorted(r.fine for r in keyed.select("fine").sample(share, seed=1).collect())
    cuts = sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)}) if sample else []

    @F.pandas_udf("int")
    def part_of(key: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(cuts, k) for k in key], dtype=np.int32)

    lines = rules.where("host <> '' AND path IS NOT NULL").select(
        F.lower("host").alias("h"), "path", "verdict").distinct().select(
        _key(F.col("h")).alias("key"), "path", F.concat("h", "path").alias("rule"), "verdict")
    spread = lines.withColumn("part", F.explode(F.sequence(
        part_of("key"), part_of(F.concat("key", F.lit("\U0010ffff"))))))
    none = {name: F.lit(None).cast(kind) for name, kind in (("rule", "string"), ("verdict", "string"))}
    events = keyed.withColumns({"part": part_of("fine"), "kind": F.lit(1), **none}).select(
        "part", "key", "kind", "page_id", "host", "path", "rule", "verdict").unionByName(
        spread.withColumns({"kind": F.lit(0), "host": F.lit(None).cast("string"),
                            "page_id": F.lit(None).cast(dict(keyed.dtypes)["page_id"])}).select(
            "part", "key", "kind", "page_id", "host", "path", "rule", "verdict"))
    swept = events.repartitionById(ranges, F.col("part")).sortWithinPartitions("part", "key", "kind")
    kind = dict(keyed.dtypes)["page_id"]
    return swept.mapInArrow(lambda batches: _sweep(batches, default),
                            f"page_id {kind}, host string, path string, rule string, verdict string")


def digest(pages: DataFrame) -> DataFrame:
    return judge(pages, rule_table(pages.sparkSession))


SQL = """
WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, h, q) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'),
                            ('allow', 'org', '/fr/')),
m AS (SELECT page_id, host, path, h || q AS rule, r.verdict,
             row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC) AS n
      FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""
