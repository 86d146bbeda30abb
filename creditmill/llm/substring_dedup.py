"""Repeated token windows by Rabin-Karp hashes, merged into maximal intervals to remove.

Documents are dealt into blocks of successive doc_ids, cut by their bytes. A block computes the hash of every window; of equal windows
inside a block only those of the first document go on, the others are repeats already. What goes on is counted by hash,
packed as arrays: a window repeats if an earlier block has its hash. The answer goes back to the block, which merges
repeated windows into intervals. The shuffle of the documents into blocks serves both passes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditmill.llm.common import WORD, text_of, written

WINDOW = 13
#: Bytes of text of a block, and bytes of text whose windows share a bucket of hashes. On a large cluster with executors of
#: several GB, raise both: a block and a bucket pair up in one row, so fewer and larger ones move in longer rows.
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_KEPT_BYTES = 7  # of a hash; the bucket holds the leading byte or more
_WORDS_KNOWN = 500_000
_known: dict[bytes, int] = {}


def _word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_known) > _WORDS_KNOWN:
        _known.clear()
    for w in set(words).difference(_known):
        _known[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(_known.__getitem__, words), dtype=np.uint64, count=len(words))


def window_hashes(words: list[bytes], window: int = WINDOW) -> np.ndarray:
    """The polynomial hash, modulo 2**64, of every run of ``window`` words.

    Rolling in array form: differences of running sums of word hash times power are the windows' hashes times a power,
    which the inverse of the odd base takes away. A last mix spreads the bits.
    """
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    powers = np.full(len(words), _BASE, dtype=np.uint64)
    powers[0] = 1
    np.cumsum(_word_hashes(words) * np.cumprod(powers), out=sums[1:])
    back = np.full(n, inverse, dtype=np.uint64)
    back[0] = 1
    hashes = (sums[window:] - sums[:n]) * np.cumprod(back)
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    return hashes ^ (hashes >> np.uint64(32))


def _documents(block: pa.Table) -> list[tuple]:
    """(row, words) in the order that both passes use."""
    ids, texts = block.column("doc_id").to_pylist(), block.column("t").to_pylist()
    order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
    return [(ids[k], texts[k].encode("utf-8", "surrogatepass").split()) for k in order]


def _pack(ordinals: np.ndarray) -> bytes:
    """Ascending ordinals as differences."""
    steps = np.diff(ordinals, prepend=0)
    small = len(steps) == 0 or int(steps.max()) < 1 << 16
    return bytes([small]) + steps.astype("<u2" if small else "<u4").tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, "<u2" if data[0] else "<u4", offset=1), dtype=np.int64)


def _forward(block: pa.Table, window: int, buckets: int) -> pa.Table:
    schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("piece", pa.int64()), ("hashes", pa.binary()), ("at", pa.binary()),
                        ("known", pa.binary())])
    number, piece = block.column("block")[0].as_py(), block.column("piece")[0].as_py()
    out = {name: [] for name in schema.names}
    hashed, owners, rank, last = [], [], -1, object()
    for doc_id, words in _documents(block):
        rank, last = (rank, last) if doc_id == last else (rank + 1, doc_id)
        hashed.append(window_hashes(words, window))
        owners.append(np.full(len(hashed[-1]), rank, dtype=np.int32))
    hashes, owners = np.concatenate(hashed), np.concatenate(owners)
    order = np.argsort(hashes, kind="stable")  # equal hashes in document order
    starts = np.flatnonzero(np.diff(hashes[order], prepend=~hashes[order][:1])) if len(order) else order
    first = np.repeat(owners[order][starts], np.diff(np.append(starts, len(order))))
    repeated = np.zeros(len(hashes), dtype=bool)
    repeated[order] = owners[order] > first
    bucket = (hashes >> np.uint64(64 - int(math.log2(buckets)))).astype(np.uint32)
    by_bucket = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    edges = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)):
        at = by_bucket[edges[b]:edges[b + 1]]
        onward, known = at[~repeated[at]], at[repeated[at]]
        kept = hashes[onward].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_KEPT_BYTES]
        for name, value in zip(schema.names, (int(b), number, piece, kept.tobytes(), _pack(onward), _pack(known))):
            out[name].append(value)
    return pa.table(out, schema=schema)


def _answer(bucket: pa.Table) -> pa.Table:
    """For each piece of a block, the ordinals of its windows that an earlier document, so an earlier block, has."""
    blocks, pieces = bucket.column("block").to_pylist(), bucket.column("piece").to_pylist()
    hashes, owners, rows, at = [], [], [], []
    for row, (number, data, ordinals) in enumerate(
            zip(blocks, bucket.column("hashes").to_pylist(), bucket.column("at").to_pylist())):
        wide = np.zeros((len(data) // _KEPT_BYTES, 8), dtype=np.uint8)
        wide[:, :_KEPT_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, _KEPT_BYTES)
        hashes.append(wide.view("<u8").ravel())
        owners.append(np.full(len(wide), number, dtype=np.int64))
        rows.append(np.full(len(wide), row, dtype=np.int64))
        at.append(_unpack(ordinals))
    hashes, owners, rows, at = map(np.concatenate, (hashes, owners, rows, at))
    order = np.argsort(hashes)
    hashes, owners, rows, at = hashes[order], owners[order], rows[order], at[order]
    if len(hashes):
        starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        first = np.repeat(np.minimum.reduceat(owners, starts), np.diff(np.append(starts, len(hashes))))
        rows, at = rows[owners > first], at[owners > first]
    found = {row: [_unpack(data)] for row, data in enumerate(bucket.column("known").to_pylist()) if len(data) > 1}
    order = np.argsort(rows, kind="stable")
    rows, at = rows[order], at[order]
    for run in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(rows)) + 1):
        if len(run):
            found.setdefault(int(rows[run[0]]), []).append(at[run])
    return pa.table({"block": pa.array([blocks[r] for r in found], pa.int64()),
                     "piece": pa.array([pieces[r] for r in found], pa.int64()),
                     "at": pa.array([_pack(np.sort(np.concatenate(v))) for v in found.values()], pa.binary())})


def _remove(block: pa.Table, answers: pa.Table, window: int) -> pa.Table:
    out = {"doc_id": [], "n_words": [], "removed": [], "kept_text": []}
    documents = _documents(block) if block.num_rows else []
    found = [_unpack(a) for a in answers.column("at").to_pylist()]
    repeated = np.sort(np.concatenate(found)) if found else np.empty(0, dtype=np.int64)
    before = 0
    for doc_id, words in documents:
        windows = max(0, len(words) - window + 1)
        low, high = np.searchsorted(repeated, [before, before + windows])
        starts = repeated[low:high] - before
        before += windows
        spans = []
        if len(starts):  # windows that touch or overlap form one interval
            breaks = np.flatnonzero(np.diff(starts) > window) + 1
            spans = [(int(p[0]), int(p[-1]) + window) for p in np.split(starts, breaks)]
            kept, done = [], 0
            for start, end in spans:
                kept += words[done:start]
                done = end
            kept += words[done:]
        else:
            kept = words
        for name, value in zip(out, (doc_id, len(words), [{"start": a, "end": b} for a, b in spans], b" ".join(kept))):
            out[name].append(value)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table([pa.array(out["doc_id"], pa.int64()), pa.array(out["n_words"], pa.int64()),
                     pa.array(out["removed"], span), pa.array(out["kept_text"], pa.binary())], names=list(out))


def _cuts(sizes: DataFrame, block_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first doc_id of each block, doc_ids with more bytes than a block, their numbers of pieces).

    ``sizes`` (doc_id, bytes) is cut inside range partitions. What comes to the driver are at most three numbers for
    ``block_bytes`` bytes of the corpus, and one for each partition.
    """
    ranged = written(sizes.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "ranged")
    so_far = F.sum("bytes").over(Window.partitionBy("part").orderBy("doc_id")) - F.col("bytes")
    cut = ranged.withColumn("nth", F.floor(so_far / F.lit(block_bytes)))
    starts = [r["first"] for r in cut.groupBy("part", "nth").agg(F.min("doc_id").alias("first")).select("first").collect()]
    large = sorted(map(tuple, sizes.where(F.col("bytes") > block_bytes).select(
        "doc_id", F.ceil(F.col("bytes") / F.lit(block_bytes)).cast("long")).collect()))
    ids, pieces = (np.array([r[k] for r in large], dtype=np.int64) for k in (0, 1))
    after = ids[ids < np.iinfo(np.int64).max] + 1  # such a doc_id has its block to itself
    return np.unique(np.concatenate([np.array(starts, dtype=np.int64), ids, after])), ids, pieces


def remove_repeats(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
                   bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, removed (array of word intervals), kept_text (UTF-8 bytes), one row per input row.

    A word goes if a window over it also starts in a document with a smaller doc_id. Rows with equal doc_id do not
    count as repeats of each other; a row without doc_id is neither compared nor cut. A missing or empty text, or one
    shorter than a window, stays as it is. An empty table gives no rows. Windows are equal when 64-bit hashes are.

    A doc_id whose rows have more bytes than a block is a block of its own and is handled in pieces, by a hash of the
    text. One text is never divided. There are two tasks for each piece, so that few meet others by chance, and at
    least as many as Spark is set to.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t"))
    known = rows.where("doc_id IS NOT NULL")
    sizes = written(known.groupBy("doc_id").agg(F.sum(F.octet_length("t")).alias("bytes")), "sizes")
    size = sizes.agg(F.sum("bytes")).first()[0] or 0
    starts, large, pieces = _cuts(sizes, block_bytes)
    buckets = 1 << max(8, math.ceil(math.log2(max(1, size / bucket_bytes))))

    @F.pandas_udf("block bigint, pieces bigint")
    def place_of(doc_id: pd.Series) -> pd.DataFrame:
        ids = doc_id.to_numpy(dtype=np.int64)
        at = np.searchsorted(large, ids)
        divided = at < len(large)
        divided[divided] = large[at[divided]] == ids[divided]
        parts = np.ones(len(ids), dtype=np.int64)
        parts[divided] = pieces[at[divided]]
        return pd.DataFrame({"block": np.searchsorted(starts, ids, side="right"), "pieces": parts})

    placed = known.withColumn("place", place_of("doc_id")).select(
        "doc_id", "t", F.col("place.block").alias("block"), F.pmod(F.xxhash64("t"), F.col("place.pieces")).alias("piece"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * (len(starts) + int(pieces.sum())))
    dealt = placed.repartition(tasks, "block", "piece")
    sent = dealt.groupBy("block", "piece").applyInArrow(
        lambda t: _forward(t, window, buckets),
        "bucket long, block long, piece long, hashes binary, at binary, known binary").repartition(tasks, "bucket")
    answers = sent.groupBy("bucket").applyInArrow(_answer, "block long, piece long, at binary")
    cut = dealt.groupBy("block", "piece").cogroup(answers.groupBy("block", "piece")).applyInArrow(
        lambda left, right: _remove(left, right, window),
        "doc_id long, n_words long, removed array<struct<start:long,end:long>>, kept_text binary")
    words = F.regexp_extract_all("t", F.lit(WORD), F.lit(0))
    loose = rows.where("doc_id IS NULL").select(
        "doc_id", F.size(words).cast("long").alias("n_words"),
        F.array().cast("array<struct<start:long,end:long>>").alias("removed"),
        F.encode(F.array_join(words, " "), "UTF-8").alias("kept_text"))
    return cut.unionByName(loose)


def digest(docs: DataFrame) -> DataFrame:
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return remove_repeats(docs).select("doc_id", "n_words", gone.alias("n_removed"),
                                       F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS s
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM d)),
f AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS first FROM g) WHERE first < doc_id),
r AS (SELECT DISTINCT doc_id, p + k AS p FROM f, range(0, 13) AS t(k)),
x AS (SELECT doc_id, list(p) AS gone FROM r GROUP BY doc_id),
w AS (SELECT doc_id, p, ws[p] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM d)),
k AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.p) AS kept FROM w ANTI JOIN r ON w.doc_id = r.doc_id AND w.p = r.p
      GROUP BY w.doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN x ON d.doc_id = x.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""
