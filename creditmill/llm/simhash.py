"""Near duplicates by SimHash, with tables of distances to reference fingerprints that discard pairs.

Distances to a fixed reference differ by at most the distance of two fingerprints (triangle inequality), so a pair
whose distances to any reference differ by more than the radius cannot link. One reference alone lets over half of all
random pairs through, which is no key to join on; candidates therefore come from blocks of bits that must agree
(of ``radius + k`` blocks at least ``k`` are untouched by ``radius`` differing bits), and inside each list of candidates
the table of distances discards, and an exact count of differing bits decides.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditmill.llm.common import components, spread_join, text_of, without, written

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42
#: Members of a candidate list that one task compares; longer lists are dealt out in blocks, each pair of blocks once.
LIST = 4096
_STEP = 65536


def _references(count: int = 12) -> np.ndarray:
    """Reference fingerprints: hashes of 0, 1, 2, ..., which differ from each other in about half their bits."""
    return np.array([xxhash.xxh64_intdigest(bytes([k]), SEED) for k in range(count)], dtype=np.uint64)


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is set if it is set in over half of the shingles' hashes; no words: zero."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: lower-cases and splits ASCII alone
    if not words:
        return 0
    joined = b" ".join(words)
    ends = (np.cumsum([len(w) for w in words]) + np.arange(len(words))).tolist()
    starts = [0, *[e + 1 for e in ends[:-1]]]
    ends = ends[min(shingle, len(words)) - 1:]
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(ends), _STEP):
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], seed)
                           for a, b in zip(starts[at:at + _STEP], ends[at:at + _STEP])], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(ends), bitorder="little")
    return int(bits.view("<u8")[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, t_hash, fp): t_hash tells apart rows with equal doc_id; fp as a signed number."""

    @F.pandas_udf("bigint")
    def marks(text: pd.Series) -> pd.Series:
        return pd.Series([_signed(fingerprint(t)) for t in text], dtype="int64")

    return docs.select("doc_id", text_of().alias("t")).select(
        "doc_id", F.xxhash64("t").alias("t_hash"), marks("t").alias("fp"))


def _masks(n: int, radius: int) -> list[int]:
    """Bit masks of which two linked fingerprints agree on at least one; more bits a mask for more fingerprints."""
    for agree in range(2, 5):
        blocks = radius + agree
        if n <= 8 << (BITS * agree // blocks):
            break
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    parts = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    return [sum(chosen) for chosen in combinations(parts, agree)]


def spanning_links(members: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect whatever fingerprints within ``radius`` connect, at most one less than there are members.

    Members are visited breadth first. Each takes out of those not yet reached the ones it links to: the first
    reference narrows them to a range, the others discard, the differing bits decide.
    """
    members = np.unique(members)
    table = np.bitwise_count(members[:, None] ^ _references()[None, :]).astype(np.int16)
    order = np.argsort(table[:, 0], kind="stable")
    members, table = members[order], table[order]
    first, left, links = table[:, 0], np.ones(len(members), dtype=bool), []
    for start in range(len(members)):
        if not left[start]:
            continue
        left[start], queue = False, [start]
        while queue:
            x = queue.pop()
            low, high = np.searchsorted(first, [first[x] - radius, first[x] + radius + 1])
            near = low + np.flatnonzero(left[low:high])
            if len(near):
                near = near[(np.abs(table[near] - table[x]) <= radius).all(axis=1)]
                near = near[np.bitwise_count(members[near] ^ members[x]) <= radius]
                left[near] = False
                queue.extend(near.tolist())
                links.extend((int(members[x]), int(members[y])) for y in near)
    return links


def links(fps: DataFrame, radius: int = RADIUS, at_once: int = LIST) -> DataFrame:
    """Links (a, b) between different fingerprints of ``fps`` (one column fp, no repeats) that connect all that link."""
    masks = _masks(fps.count(), radius)
    keys = F.array(*[F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                     for k, m in enumerate(masks)])
    parts = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.mask", "k.key")
    lists = written(parts.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1"), "lists")
    blocks = F.ceil(F.col("n") / F.lit(at_once)).cast("int")
    dealt = spread_join(parts, lists.withColumn("blocks", blocks), ["mask", "key"], "n", ["fp"], merge=True)
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = dealt.withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).groupBy(
        "mask", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(
        F.collect_list("fp").alias("fps"))

    @F.pandas_udf("array<struct<a:bigint,b:bigint>>")
    def connect(lists: pd.Series) -> pd.Series:
        return pd.Series([[{"a": _signed(a), "b": _signed(b)} for a, b in
                           spanning_links(np.asarray(x, dtype=np.int64).view(np.uint64), radius)] for x in lists])

    # a task of a pair of blocks also finds the links inside each block, which the distinct removes again
    return pairs.where(F.size("fps") > 1).select(F.explode(connect("fps")).alias("l")).select("l.a", "l.b").distinct()


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, t_hash, fp, component_id: one row per input row.

    Equal fingerprints are linked, among them all texts without words, missing ones included. component_id is the
    smallest doc_id that links reach; rows without doc_id do not count for it unless the group has no other.
    An empty table gives no rows.
    """
    marks = written(fingerprints(docs), "simhash")
    fps = written(marks.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "fingerprints")
    roots = components(links(fps.select("fp")))
    labelled = written(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                       .withColumn("root", F.coalesce("root", "fp")), "roots")
    firsts = written(labelled.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("m")), "firsts")
    named = written(spread_join(labelled.select("root", "fp", "n"), firsts, ["root"], "m", ["fp"])
                    .select("fp", "n", "component_id"), "named")
    return spread_join(marks, named, ["fp"], "n", ["doc_id", "t_hash"], merge=True)


def digest(docs: DataFrame) -> DataFrame:
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group, that of the smallest doc_id, with all columns of ``docs``.

    Of rows that share this doc_id the one with the smallest text hash stays.
    """
    found = written(groups(docs), "groups")
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_id").agg(
        F.min("t_hash").alias("t_hash"), F.count("*").alias("n"))
    kept = written(kept, "kept")
    dropped = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "t_hash")
    twice = kept.where("n > 1").select("component_id", F.col("t_hash").alias("stays"))
    repeated = not twice.isEmpty()
    if repeated:
        again = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).withColumnRenamed(
            "component_id", "c").join(twice, F.col("c").eqNullSafe(F.col("component_id")))
        dropped = dropped.union(again.where("t_hash <> stays").select("doc_id", "t_hash"))
    return without(docs, written(dropped, "dropped"), {"doc_id": F.col("doc_id"), "t_hash": F.xxhash64(text_of())}, repeated)
