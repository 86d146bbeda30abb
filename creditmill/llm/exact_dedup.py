"""Exact duplicates by composable polynomial fingerprints, confirmed by comparing the texts chunk by chunk.

A text is cut into chunks of bytes. A chunk's hash is a polynomial in its bytes modulo a Mersenne prime; the hash of two
strings put together is the left hash times the base to the power of the right length, plus the right hash. So the
chunks of a huge document are hashed independently, as rows of their own, and a plain sum puts them together.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditmill.llm.common import bit_map, fresh, spread_join, text_of, with_maybe, without, written

PRIME = (1 << 61) - 1
BASE = 1_000_003
CHUNK = 1 << 16
_BLOCK, _LIMB = 4096, 21


@lru_cache(maxsize=4)
def _powers(base: int, prime: int) -> np.ndarray:
    """base**(n-1-i) for a block of n bytes, as limbs small enough for exact sums in doubles."""
    values, power = [], 1
    for _ in range(_BLOCK):
        values.append(power)
        power = power * base % prime
    values.reverse()
    mask = (1 << _LIMB) - 1
    return np.array([[(v >> (_LIMB * k)) & mask for k in range(3)] for v in values], dtype=np.float64)


def combine(left: int, right: int, right_length: int, base: int = BASE, prime: int = PRIME) -> int:
    """The hash of two strings put together."""
    return (left * pow(base, right_length, prime) + right) % prime


def polynomial(data: bytes, base: int = BASE, prime: int = PRIME) -> int:
    """The hash of ``data``; bytes count from 1, so that leading zero bytes matter."""
    powers, value = _powers(base, prime), 0
    for start in range(0, len(data), _BLOCK):
        block = np.frombuffer(data, np.uint8, min(_BLOCK, len(data) - start), start)
        limbs = (block.astype(np.float64) + 1.0) @ powers[_BLOCK - len(block):]
        own = sum(int(limb) << (_LIMB * k) for k, limb in enumerate(limbs)) % prime
        value = own if start == 0 else combine(value, own, len(block), base, prime)
    return value


def _chunks(bytes_column: str, chunk: int):
    """An array of (from, piece) over a binary column; an empty text has one empty piece."""
    last = F.greatest(F.octet_length(bytes_column) - 1, F.lit(0))
    return F.transform(
        F.sequence(F.lit(0), last, F.lit(chunk)),
        lambda at: F.struct(at.alias("at"), F.substring(F.col(bytes_column), at + 1, F.lit(chunk)).alias("piece")),
    )


def fingerprints(docs: DataFrame, base: int = BASE, prime: int = PRIME, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, sha, n_bytes, copies, fp): one row per different (doc_id, text); copies counts its rows."""

    @F.pandas_udf("bigint")
    def shifted(piece: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series([polynomial(p, base, prime) * pow(base, int(a), prime) % prime for p, a in zip(piece, after)],
                         dtype="int64")

    whole = docs.select("doc_id", text_of().alias("t")).select(
        "doc_id", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("sha"), F.col("t").cast("binary").alias("raw"))
    pieces = whole.select("doc_id", "sha", F.octet_length("raw").alias("n_bytes"),
                          F.explode(_chunks("raw", chunk)).alias("c"))
    terms = pieces.select(
        "doc_id", "sha", "n_bytes", F.col("c.at").alias("at"),
        shifted(F.col("c.piece"), F.col("n_bytes") - F.col("c.at") - F.octet_length("c.piece")).alias("term"))
    sums = terms.groupBy("doc_id", "sha", "n_bytes").agg(
        F.sum(F.col("term").cast("decimal(19,0)")).alias("s"), F.count_if(F.col("at") == 0).alias("copies"))
    # rows that repeat a (doc_id, text) add the same terms again, so the sum is a multiple of one text's
    own = (F.col("s") / F.col("copies").cast("decimal(10,0)")).cast("decimal(38,0)")
    return sums.select("doc_id", "sha", "n_bytes", "copies",
                       F.pmod(own, F.lit(prime).cast("decimal(38,0)")).cast("long").alias("fp"))


def _unequal(docs: DataFrame, marks: DataFrame, shared: DataFrame, base: int, prime: int, chunk: int) -> DataFrame:
    """(fp, n_bytes) of the ``shared`` fingerprints behind which the texts differ.

    A bit map of the digests behind shared fingerprints lets the scan pass over all other texts; those that remain get
    their fingerprint again where they are read, which is cheaper than joining it to them. At every chunk position the
    least and the greatest chunk of a group must agree; both are kept by each task before the shuffle, so a large
    group sends few rows.
    """
    @F.pandas_udf("bigint")
    def whole(raw: pd.Series) -> pd.Series:
        return pd.Series([polynomial(r, base, prime) for r in raw], dtype="int64")

    members = spread_join(marks, shared, ["fp", "n_bytes"], "n", ["doc_id", "sha"]).select("sha")
    known = written(bit_map(members, ["sha"]), "members")
    texts = docs.select(text_of().cast("binary").alias("raw")).withColumn("sha", F.unhex(F.sha2("raw", 256)))
    found = with_maybe(texts, ["sha"], known, "maybe").where("maybe").select("raw", whole("raw").alias("fp"))
    pieces = found.select("fp", F.octet_length("raw").alias("n_bytes"), F.explode(_chunks("raw", chunk)).alias("c")).select(
        "fp", "n_bytes", F.col("c.at").alias("at"), F.col("c.piece").alias("piece"))
    return (pieces.groupBy("fp", "n_bytes", "at").agg(F.min("piece").alias("low"), F.max("piece").alias("high"))
            .where("low <> high").select("fp", "n_bytes").distinct())


def duplicates(docs: DataFrame, base: int = BASE, prime: int = PRIME, chunk: int = CHUNK) -> DataFrame:
    """doc_id, sha, copies, keep_id, group_size, one row per different (doc_id, text).

    Of equal texts the largest doc_id stays; a missing text is an empty one, and empty texts are equal. A missing
    doc_id is smaller than any other. group_size counts all rows of the text. Texts behind an equal fingerprint that
    the comparison finds different are told apart by SHA-256. An empty table gives no rows.
    """
    marks = written(fingerprints(docs, base, prime, chunk), "fingerprints")
    shared = written(marks.groupBy("fp", "n_bytes").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    unequal = written(_unequal(docs, marks, shared, base, prime, chunk), "unequal")
    parted = marks.withColumn("part", F.lit(None).cast("binary"))
    if not unequal.isEmpty():
        parted = marks.join(unequal.withColumn("split", F.lit(True)), ["fp", "n_bytes"], "left").withColumn(
            "part", F.when(F.col("split"), F.col("sha"))).drop("split")
    parted = parted.withColumn("part", F.coalesce("part", F.lit(b"")))
    groups = written(parted.groupBy("fp", "n_bytes", "part").agg(
        F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"), F.count("*").alias("n")), "groups")
    return spread_join(parted, groups, ["fp", "n_bytes", "part"], "n", ["doc_id", "sha"], merge=True).select(
        "doc_id", "sha", "copies", "keep_id", "group_size")


def digest(docs: DataFrame) -> DataFrame:
    """One row per input row; of rows that repeat a kept (doc_id, text) the first is kept."""
    rows = duplicates(docs).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    found = written(duplicates(docs), "duplicates")
    repeated = not found.where("copies > 1").isEmpty()
    name = fresh(docs, "sha")
    dropped = written(found.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).withColumnRenamed("sha", name), "dropped")
    return without(docs, dropped, {"doc_id": F.col("doc_id"), name: F.unhex(F.sha2(text_of().cast("binary"), 256))}, repeated)
