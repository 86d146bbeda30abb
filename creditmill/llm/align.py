"""Alignment of two tokenizers over the same bytes, as Arrow column operations.

Token ids of a batch are list columns. Flattened, with each token's document, their byte lengths are summed up within
documents to end offsets. A full outer join of both sides on (document, end) has one row for each stretch of bytes
between neighbouring ends; rows with both sides are the common boundaries that cut the tokens into groups, and filling
the gaps backward gives the two tokens that lie over a stretch: one link each. Tasks count in how many of their
documents an id pair is linked, Spark adds these counts up and brings them back to the documents.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditmill.llm.common import text_of, written
from creditmill.llm.packing import VOCABULARY, Encoder

PIECES = "piece_bpe_32k.model"
#: Documents that are aligned at once, and the bytes of text beyond which fewer are.
DOCS, BYTES = 256, 1 << 22
#: Different pairs a task counts before it passes the counts on.
PAIRS_HELD = 1 << 18
#: Pairs in one row of passed-on counts.
PAIRS_ROW = 8192
#: At most so many of the commonest pairs are broadcast; all others are joined.
HOT_PAIRS = 100_000
_SEPARATORS = (",", "|", ";", "")


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.path(PIECES)


class ByteSide(Encoder):
    """Byte-level ids of a space and the text; the strings of special tokens are ordinary text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.special = []
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        to_byte = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.bytes = pa.array([bytes(to_byte.get(c, 0) for c in t) for t in tokens], pa.large_binary())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self.ids(" " + t).astype(np.int64) for t in texts]


class PieceSide:
    """Ids of pieces; the tokenizer puts the space in front itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.pieces.get_piece_size()
        self.bytes = pa.array([bytes([int(self.pieces.id_to_piece(i)[3:5], 16)]) if self.pieces.is_byte(i)
                               else self.pieces.id_to_piece(i).replace("▁", " ").encode() for i in range(n)],
                              pa.large_binary())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(ids, dtype=np.int64) for ids in self.pieces.encode(texts, num_threads=1)]


@lru_cache(maxsize=4)
def sides(byte_file: str, piece_file: str) -> tuple[ByteSide, PieceSide, pa.Array]:
    """Both tokenizers, and the decimal of every id with each separator at 4 * id + separator."""
    a, b = ByteSide(byte_file), PieceSide(piece_file)
    most = max(len(a.bytes), len(b.bytes))
    return a, b, pa.array([f"{i}{s}" for i in range(most) for s in _SEPARATORS], pa.large_string())


def _offsets(lengths) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def _same_bytes(ids: list[np.ndarray], token_bytes: pa.Array, wanted: list[bytes]) -> list[bool]:
    """For each document whether its tokens' bytes, put together, are the wanted ones."""
    taken = token_bytes.take(pa.array(np.concatenate(ids)))
    ends = np.frombuffer(taken.buffers()[1], np.int64)[:len(taken) + 1]
    data = memoryview(taken.buffers()[2] or b"").cast("B")
    cuts = ends[_offsets([len(i) for i in ids])].tolist()
    return [data[x:y] == w for x, y, w in zip(cuts, cuts[1:], wanted)]


def _flat(ids: list[np.ndarray], token_bytes: pa.Array, name: str) -> tuple[pa.Table, np.ndarray]:
    """(doc, end, name) per token, name its place in the batch; and the ids."""
    lists = pa.LargeListArray.from_arrays(pa.array(_offsets([len(i) for i in ids])), pa.array(np.concatenate(ids)))
    flat, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
    upto = pc.cumulative_sum(pc.binary_length(token_bytes).take(flat))
    before = np.concatenate([[0], np.asarray(upto)])[np.asarray(lists.offsets)[:-1]]  # bytes before each document
    end = pc.subtract(upto, pa.array(before).take(doc))
    return pa.table({"doc": doc, "end": end, name: pa.array(np.arange(len(flat)))}), np.asarray(flat)


def align(texts: list[str | None], byte_file: str, piece_file: str) -> dict:
    """Arrays n_a, n_b, n_groups, n_links, sha of each text, and ``links``, a table (doc, a, b, n) of the id pairs."""
    a, b, decimals = sides(byte_file, piece_file)
    n, at = len(texts), [k for k, t in enumerate(texts) if t]
    ids_a, ids_b = a.encode([texts[k] for k in at]), b.encode([texts[k] for k in at])
    out = {k: np.zeros(n, dtype=np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")} | {
        "sha": [""] * n, "links": pa.table({k: pa.array([], pa.int64()) for k in ("doc", "a", "b", "n")})}
    if at:
        wanted = [(" " + texts[k]).encode("utf-8", "surrogatepass") for k in at]
        same = [x and y for x, y in zip(_same_bytes(ids_a, a.bytes, wanted), _same_bytes(ids_b, b.bytes, wanted))]
        at, ids_a, ids_b = ([v for v, s in zip(values, same) if s] for values in (at, ids_a, ids_b))
    if not at:
        return out
    table_a, flat_a = _flat(ids_a, a.bytes, "at_a")
    table_b, flat_b = _flat(ids_b, b.bytes, "at_b")
    rows = table_a.join(table_b, ["doc", "end"], join_type="full outer", use_threads=False).sort_by(
        [("doc", "ascending"), ("end", "ascending")]).combine_chunks()
    has_a, has_b = (np.asarray(pc.is_valid(rows.column(c).combine_chunks())) for c in ("at_a", "at_b"))
    doc, common = np.asarray(rows.column("doc")), has_a & has_b
    group = np.cumsum(common) - common
    group_a, group_b = group[has_a], group[has_b]  # rows with an end of a side are in the order of its tokens
    link_a, link_b = (flat[np.asarray(pc.fill_null_backward(rows.column(c).combine_chunks()))]
                      for c, flat in (("at_a", flat_a), ("at_b", flat_b)))

    last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
    cuts_a, cuts_b = _offsets([len(i) for i in ids_a]), _offsets([len(i) for i in ids_b])
    mark_b = np.where(last_b, 2, 0)
    mark_b[cuts_b[1:] - 1] = 3
    order = np.empty(len(flat_a) + len(flat_b), dtype=np.int64)
    order[np.arange(len(flat_a)) + np.searchsorted(group_b, group_a, "left")] = 4 * flat_a + last_a
    order[np.arange(len(flat_b)) + np.searchsorted(group_a, group_b, "right")] = 4 * flat_b + mark_b
    joined = decimals.take(pa.array(order))
    ends, data = np.frombuffer(joined.buffers()[1], np.int64), memoryview(joined.buffers()[2]).cast("B")
    cuts = ends[cuts_a + cuts_b].tolist()
    for k, x, y in zip(at, cuts, cuts[1:]):
        out["sha"][k] = hashlib.sha256(data[x:y]).hexdigest()
    out["n_a"][at], out["n_b"][at] = np.diff(cuts_a), np.diff(cuts_b)
    out["n_groups"][at] = np.bincount(doc[common], minlength=len(at))
    out["n_links"][at] = np.bincount(doc, minlength=len(at))
    links = pa.table({"doc": np.asarray(at)[doc], "a": link_a, "b": link_b}).group_by(["doc", "a", "b"], use_threads=False)
    out["links"] = links.aggregate([([], "count_all")]).rename_columns(["doc", "a", "b", "n"])
    return out


def _merged(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["a", "b", "n"])


ROW = ("doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
       " a array<int>, b array<int>, n array<long>")
_TYPES = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
_NAMES = [part.split()[0] for part in ROW.split(", ")]


def _lists(table: pa.Table, cuts) -> list[pa.Array]:
    offsets = pa.array(np.asarray(cuts), pa.int32())
    return [pa.ListArray.from_arrays(offsets, table.column(c).combine_chunks().cast(t))
            for c, t in (("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64()))]


def alignments(docs: DataFrame, byte_file: str | None = None, piece_file: str | None = None) -> DataFrame:
    """Written rows of two kinds: one per document with its linked id pairs (a, b, occurrences n), and, without
    ``row``, pairs with the number of documents of one task that hold them."""
    files = tuple(given or own for given, own in zip((byte_file, piece_file), default_files())) \
        if byte_file is None or piece_file is None else (byte_file, piece_file)

    def counts(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        table = _merged(held)
        cuts = [*range(0, table.num_rows, PAIRS_ROW), table.num_rows]
        n = len(cuts) - 1
        yield pa.RecordBatch.from_arrays([pa.nulls(n, t) for t in _TYPES[:7]] + _lists(table, cuts), names=_NAMES)

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        number, seen, held = TaskContext.get().partitionId() << 33, 0, []
        for batch in batches:
            sizes = _offsets(np.asarray(pc.fill_null(pc.binary_length(batch.column("t")), 0)))
            start = 0
            while start < batch.num_rows:
                stop = max(start + 1, min(start + DOCS, int(np.searchsorted(sizes, sizes[start] + BYTES, "right")) - 1))
                texts = batch.column("t").slice(start, stop - start).to_pylist()
                found = align(texts, *files)
                links = found["links"].sort_by("doc")
                cuts = _offsets(np.bincount(np.asarray(links.column("doc")), minlength=len(texts)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, stop - start), pa.array(number + seen + np.arange(len(texts))),
                     *(pa.array(found[k]) for k in ("n_a", "n_b", "n_groups", "n_links")), pa.array(found["sha"], pa.string()),
                     *_lists(links, cuts)], names=_NAMES)
                held.append(links.group_by(["a", "b"], use_threads=False).aggregate([("doc", "count")]).rename_columns(["a", "b", "n"]))
                start, seen = stop, seen + len(texts)
                if sum(t.num_rows for t in held) > PAIRS_HELD:
                    held = [_merged(held)]
                    if held[0].num_rows > PAIRS_HELD // 2:
                        yield from counts(held)
                        held = []
        if held:
            yield from counts(held)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t"))
    return written(rows.mapInArrow(per_partition, ROW), "alignments")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, count, best): in how many documents a pair is linked, and whether no pair of ``a`` is in more.

    An id has at most as many pairs as the other vocabulary has ids, so the groups by ``a`` are bounded.
    """
    counted = written(aligned.where("row IS NULL").select(F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("p.*")
                      .groupBy("a", "b").agg(F.sum("n").alias("count")), "pairs")
    most = counted.groupBy("a").agg(F.max("count").alias("most"))
    return written(counted.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best")), "pair-counts")


def _least_hot(counts: DataFrame, most: int) -> int:
    """The least power of two such that at most ``most`` pairs have that count or more."""
    level = F.floor(F.log2("count")).cast("int")
    levels = dict(counts.groupBy(level.alias("l")).agg(F.count("*")).collect())  # one row per power of two
    held, least = 0, 1 << (max(levels, default=0) + 1)
    for k in sorted(levels, reverse=True):
        held += levels[k]
        if held > most:
            break
        least = 1 << k
    return least


def scores(docs: DataFrame, byte_file: str | None = None, piece_file: str | None = None, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per row of ``docs``.

    Missing and empty texts, and those whose tokens do not spell a space and the text, have no tokens: zeros and an
    empty groups_sha256. Rows that repeat are documents of their own and count each. The commonest pairs, at most
    ``hot_pairs`` whatever the corpus, hold nearly all links and are broadcast; links of the others are shuffled to
    their counts. Columns beside doc_id and text do not matter; an empty table gives no rows.
    """
    aligned = alignments(docs, byte_file, piece_file)
    counts = pair_counts(aligned)
    least = _least_hot(counts, hot_pairs)
    links = aligned.where("row IS NOT NULL").select("row", F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("row", "p.*")
    hot, cold = counts.where(F.col("count") >= least), counts.where(F.col("count") < least)
    common = F.broadcast(hot)
    found = links.join(common, ["a", "b"]).unionByName(links.join(common, ["a", "b"], "left_anti").join(cold, ["a", "b"])) \
        if least > 1 else links.join(common, ["a", "b"])
    sums = found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"),
                                    F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    return aligned.where("row IS NOT NULL").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0).cast("long")).alias("n_best"),
        F.coalesce("count_sum", F.lit(0).cast("long")).alias("count_sum"), "groups_sha256")
