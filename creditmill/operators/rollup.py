"""Declarative roll-ups: one specification, one ``groupBy().agg()``, one shuffle.

Subsets (for example only approved applications) are conditional aggregates of the same pass, so no
second scan and no join is needed. All aggregates combine partial results, which is also what keeps a
single very large client harmless.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditmill.functions.names import aggregate_name, col, quoted, text

MISSING_SHARE = "nan"  # fixed value: name of the share of missing categories


def _statistic(stat: str, column: str, member: str | None, code: bool = False) -> str:
    """SQL of one statistic over the rows where ``member`` holds (all rows when it is None)."""
    value = quoted(column)
    kept = value if member is None else f"CASE WHEN {member} THEN {value} END"
    number = f"CAST({kept} AS DOUBLE)"
    if stat in ("min", "max"):
        return f"CAST({stat}({kept}) AS DOUBLE)"
    if stat in ("mean", "var"):
        # infinite inputs can make a NaN, which means missing; a mean shares its sum and count with other statistics
        found = {"mean": f"try_divide(sum({number}), count({number}))", "var": f"var_samp({number})"}[stat]
        return f"CASE WHEN NOT isnan({found}) THEN {found} END"
    # all-missing sums to 0, but only for a client that has rows in the subset
    out = {
        "sum": f"coalesce(sum({number}), 0D)",
        # 0 and -0 are one value, which adding 0 makes them for a set; NaN does not occur, readers make it missing
        "nunique": f"CAST({f'size(collect_set({kept} + 0))' if code else f'count(DISTINCT {kept})'} AS DOUBLE)",
        "size": f"CAST(count_if({member or 'true'}) AS DOUBLE)",
    }[stat]
    return out if member is None else f"CASE WHEN count_if({member}) > 0 THEN {out} END"


@dataclass(frozen=True)
class Rollup:
    """What to compute per key.

    numeric   column -> statistics
    shares    category column -> values; gives the share of each value and of missing
    carried   like numeric, listed after the shares
    subsets   prefix -> (column, value); repeats ``numeric`` over those rows only
    count     name of the row count, if wanted
    codes     numeric columns with few different values per key, such as version numbers: their distinct count is a set
              in the buffer of the roll-up, merged like any partial result. Other distinct counts are unbounded and cost
              a shuffle of their own.
    gather    bring the rows of a key together before aggregating. The aggregation buffer of a wide
              roll-up is many times larger than a row, so partial results of scattered rows would make the
              shuffle larger, not smaller. The gathering shuffle is a rebalance, which splits the partition
              of a very large client; its parts are merged by the partial results.
    """

    prefix: str
    numeric: Mapping[str, Sequence[str]] = field(default_factory=dict)
    shares: Mapping[str, Sequence[str]] = field(default_factory=dict)
    carried: Mapping[str, Sequence[str]] = field(default_factory=dict)
    subsets: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    count: str | None = None
    codes: Sequence[str] = ()
    gather: bool = True

    def _name(self, column: str, stat: str, prefix: str | None = None) -> str:
        prefix = self.prefix if prefix is None else prefix
        return aggregate_name(prefix, column, stat) if prefix else f"{column}_{stat.upper()}"

    def _numbers(self, spec: Mapping[str, Sequence[str]], prefix: str, member: str | None):
        for column, stats in spec.items():
            for stat in stats:
                yield self._name(column, stat, prefix), _statistic(stat, column, member, column in self.codes)

    def _shares(self):
        for column, values in self.shares.items():
            for value in values:
                hits = f"count_if({quoted(column)} <=> {text(value)})"
                yield self._name(f"{column}_{value}", "mean"), f"{hits} / count(1)"
            yield (self._name(f"{column}_{MISSING_SHARE}", "mean"),
                   f"count_if({quoted(column)} IS NULL) / count(1)")

    def aggregates(self) -> list[tuple[str, str]]:
        """(output name, SQL) of every aggregate, in output order."""
        out = list(self._numbers(self.numeric, self.prefix, None))
        out += self._shares()
        out += self._numbers(self.carried, self.prefix, None)
        for prefix, (column, value) in self.subsets.items():
            out += self._numbers(self.numeric, prefix, f"{quoted(column)} <=> {text(value)}")
        if self.count:
            out.append((self.count, "CAST(count(1) AS DOUBLE)"))
        return out

    def input_columns(self) -> list[str]:
        names = [*self.numeric, *self.shares, *self.carried, *(column for column, _ in self.subsets.values())]
        return list(dict.fromkeys(names))

    def output_columns(self) -> list[str]:
        names = [self._name(c, s) for c, stats in self.numeric.items() for s in stats]
        names += [self._name(f"{c}_{v}", "mean") for c, values in self.shares.items()
                  for v in [*values, MISSING_SHARE]]
        names += [self._name(c, s) for c, stats in self.carried.items() for s in stats]
        names += [self._name(c, s, prefix) for prefix in self.subsets
                  for c, stats in self.numeric.items() for s in stats]
        return names + ([self.count] if self.count else [])

    def apply(self, df: DataFrame, key: str, buckets: int | None = None, along: Sequence[str] = ()) -> DataFrame:
        """One row per non-missing key; every output column is a double. Columns ``along`` depend on the key and are
        grouped with it, so that the result lies as a join on key and ``along`` needs it; without ``gather`` and buckets.

        With ``buckets`` the rows are placed by key in so many partitions and aggregated there: no partial results are
        shuffled, and a table that lies in such buckets is not moved at all. Only for rows without a very large key.
        """
        rows = df.where(col(key).isNotNull())
        if buckets is not None:
            # the alias names the key after the filter: a union compares placements with what may be missing
            rows = (rows.select(col(key).alias(key), *[col(c) for c in self.input_columns() if c != key])
                    .repartition(buckets, col(key)))
        elif self.gather:
            rows = (rows.select(key, *[col(c) for c in self.input_columns() if c != key])
                    .withColumn("_near", F.xxhash64(col(key))).hint("rebalance", "_near"))
        return rows.groupBy(key, *along).agg(*[F.expr(f"{sql} AS {quoted(name)}") for name, sql in self.aggregates()])
