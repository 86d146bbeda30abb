"""Helpers the text operators share: names, written tables, joins with hot keys, connected components."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditmill.session import cut_lineage, new_table_path, passing_tables

#: A word is a run of anything but these six blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: A key that holds more than one part in so many of all rows is split.
HOT_SHARE = 1000
#: Size of a broadcast bit map, as a power of two: 2^26 bits are 8 MB, whatever the number of keys.
MAP_BITS = 26
_ROW_BITS = 15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The whole text; a missing one counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, so that a lost executor costs no more than the steps after it."""
    return cut_lineage(df, f"llm-{name}")


def kept_alone(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` gives, written; tables written on the way are deleted once it is there."""
    path = new_table_path(spark, f"llm-{name}")
    with passing_tables(spark):
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, keep: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    """``keep`` and ``columns``, computed once per row whatever is done with them later.

    A filter on a column is pushed below the projections that make it, which repeats nested expressions many times
    over; a generator of one row in between stops that.
    """
    name = fresh(df, "settled")
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias(name)
    return df.select(*[F.col(f"`{c}`") for c in keep], made).select(
        *[F.col(f"`{c}`") for c in keep], *[F.col(name).getField(n).alias(n) for n in columns])


def spread_join(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, by: Sequence[str],
                merge: bool = False) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, which has one row per key and, in ``size``, the rows of that key.

    A key over 1/1000 of all rows is cut into pieces of that size by a hash of ``by``, and its group row is repeated
    for each piece. At most 1000 keys can be that large, so their list is the one thing broadcast. ``groups`` should
    be a written table, as it is read three times. Keys must not be missing. With ``merge``, for groups nearly as many as
    the rows, the groups are never broadcast, so that a small input takes the same plan as a large one.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    least = int(total) // HOT_SHARE + 1
    pieces, piece = fresh(rows.join(groups.limit(0), list(keys)), "pieces"), fresh(rows, "piece")
    hot = groups.where(F.col(size) > least).select(*keys, F.ceil(F.col(size) / F.lit(least)).cast("long").alias(pieces))
    left = (
        rows.join(F.broadcast(hot), list(keys), "left")
        .withColumn(piece, F.coalesce(F.pmod(F.xxhash64(*by), F.col(pieces)), F.lit(0).cast("long")))
        .drop(pieces)
    )
    right = groups.withColumn(
        piece, F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col(size) / F.lit(least)), F.lit(1)) - 1))
    ).drop(size)
    return left.join(right.hint("merge") if merge else right, [*keys, piece]).drop(piece)


def numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``rows``, written, with ``name``: 0, 1, 2 ... by the columns ``order``, which must tell all rows apart.

    Range partitioning gives each task a stretch of the order, so one key may hold any share of the rows. What comes to
    the driver and is broadcast is a row count for each task. ``rows`` should be a written table, as it is sampled first.
    """
    at, part, start = (fresh(rows, f"{name}_{k}") for k in ("at", "part", "start"))
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = written(sorted_rows.withColumn(at, F.monotonically_increasing_id()), "ordered").withColumn(
        part, F.shiftrightunsigned(at, 33))  # the task; the lower bits count its rows
    sizes = sorted(map(tuple, kept.groupBy(part).count().collect()))
    starts = accumulate([n for _, n in sizes], initial=0)
    before = rows.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts)], f"{part} long, {start} long")
    return kept.join(F.broadcast(before), part).withColumn(
        name, F.col(start) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).drop(at, part, start)


def _slot(keys: Sequence[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << bits))


def bit_map(rows: DataFrame, keys: Sequence[str], bits: int = MAP_BITS) -> DataFrame:
    """(bucket, map): one bit for each hash of ``keys``, in at most 2^(bits - 15) rows of 4 KB."""
    slot = rows.select(_slot(keys, bits).alias("slot")).select(
        F.shiftright("slot", _ROW_BITS).alias("bucket"), F.col("slot").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("at"))
    return slot.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("map"))


def with_maybe(rows: DataFrame, keys: Sequence[str], found: DataFrame, name: str, bits: int = MAP_BITS) -> DataFrame:
    """``rows`` with a boolean ``name``: false if no row of ``found``, a ``bit_map``, has the row's keys.

    It spares rows a shuffle that would not find them. More keys than bits only make it true more often; an exact step
    must follow. Key columns need the types they had in ``bit_map``.
    """
    slot, bucket, held = (fresh(rows, f"{name}_{part}") for part in ("slot", "bucket", "map"))
    byte = F.conv(F.hex(F.substring(F.col(held), (F.shiftright(slot, 3).bitwiseAND(F.lit(4095)) + 1).cast("int"), F.lit(1))),
                  16, 10).cast("int")
    bit = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]),
                                       (F.col(slot).bitwiseAND(F.lit(7)) + 1).cast("int"))) != 0
    return (rows.withColumn(slot, _slot(keys, bits)).withColumn(bucket, F.shiftright(slot, _ROW_BITS))
            .join(F.broadcast(found.toDF(bucket, held)), bucket, "left")
            .withColumn(name, F.coalesce(bit, F.lit(False))).drop(slot, bucket, held))


def without(docs: DataFrame, dropped: DataFrame, keys: dict[str, Column], repeated: bool, bits: int = MAP_BITS) -> DataFrame:
    """The rows of ``docs`` whose keys (name in ``dropped``: expression over ``docs``) are not in ``dropped``.

    Missing keys match missing keys. With ``repeated``, one of several rows with equal keys stays. Rows that a bit map
    of the dropped keys tells apart stay where they are; only the others are shuffled to be compared. ``dropped``
    should be a written table, as it is read twice.
    """
    named = {fresh(docs, f"key_{k}"): v for k, v in keys.items()}
    left = docs.withColumns(named)
    maybe = fresh(left, "maybe")
    left = with_maybe(left, list(named), bit_map(dropped, list(keys), bits), maybe, bits)
    right = dropped.select(*[F.col(k).alias(f"{n}r") for k, n in zip(keys, named)])
    condition = [F.col(n).eqNullSafe(F.col(f"{n}r")) for n in named]
    left = left.where(~F.col(maybe)).union(left.where(maybe).join(right, condition, "left_anti")).drop(maybe)
    if repeated:
        left = left.dropDuplicates(list(named))
    return left.drop(*named)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b, both bigint): (node, root), root the smallest node of its component.

    Large-star and small-star rounds in turn: each hangs a node's neighbours on the smallest one, so components become
    stars in a logarithmic number of rounds. Nodes without an edge to another node are not returned.
    """
    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.union(pairs.select("b", "a")) if large else pairs.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = written(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
                        .withColumn("m", F.least("a", "m")), "least")
        hung = spread_join(both, least, ["a"], "n", ["b"])
        if large:
            out = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = hung.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
                least.select("a", F.col("m").alias("b")))
        return written(out.where("a <> b").distinct(), "star")

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    pairs = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .distinct(), "links")
    before, now = None, state(pairs)
    while now[0] and now != before:
        pairs = star(star(pairs, True), False)
        before, now = now, state(pairs)
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
