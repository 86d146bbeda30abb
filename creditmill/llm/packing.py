"""Packing token sequences with a bounded number of open windows per partition.

Each partition reads its documents once and keeps a fixed number of open windows. What a document leaves over after its
whole sequences goes into the open window it fills best. If it fits none and all are in use, the fullest is emitted: as
it is if little is missing, else filled up with a piece cut from the newcomer. At the end a partition's open windows
are merged by cutting, and the one that stays partly full is merged with those of other partitions.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditmill.llm.common import text_of, written

LENGTH = 1024
OPEN_WINDOWS = 64
#: A window with at most so many free places is emitted padded.
WASTE = 8
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
#: Partitions whose last windows one task merges.
MERGE = 256

#: Whatever is not a Latin letter or common mark.
_OTHER = re.compile("[^\x00-\u024f]")
_TOKENIZERS: dict[str, "Encoder"] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _ranks(path: str) -> dict[bytes, int] | None:
    """Ids of a byte-level vocabulary by their bytes, if successive merges have successive ids; else None."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    to_byte = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [model["vocab"].get("".join(m)) for m in merges]
    if None in ids or ids != sorted(ids) or not set("".join(a + b for a, b in merges)) <= set(to_byte):
        return None
    made = [*to_byte, *("".join(m) for m in merges)]
    return {bytes(to_byte[c] for c in token): model["vocab"][token] for token in made}


class Encoder:
    """Ids by a ``tokenizers`` file, as its ``encode(text, add_special_tokens=False)`` gives them.

    A byte-level vocabulary in merge order is also given to ``tiktoken``, which has the same ids several times faster.
    It gets the texts of Latin letters, where both cut alike; other texts, and those that hold a special token, go to
    ``tokenizers``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = _ranks(path)
        self.fast = ranks and tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                                special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast and not _OTHER.search(text) and not any(s in text for s in self.special):
            return self.fast.encode_to_numpy(text)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def encoder(path: str) -> Encoder:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Encoder(path)
    return _TOKENIZERS[path]


class Packer:
    """Open windows of one partition; ``done`` gathers (sequence, pieces) with pieces (doc, start, ids, total)."""

    def __init__(self, length: int, open_windows: int, waste: int):
        self.length, self.most, self.waste = length, open_windows, waste
        self.windows: list[list] = []  # [free places, pieces]
        self.done: list[list[tuple]] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.length:
            self.done.append([(doc_id, at, ids[at:at + self.length], total)])
            at += self.length
        while at < total:
            need = total - at
            best = min((w for w in self.windows if w[0] >= need), key=lambda w: w[0], default=None)
            if best is None and len(self.windows) < self.most:
                best = [self.length, []]
                self.windows.append(best)
            if best is None:
                fullest = min(self.windows, key=lambda w: w[0])
                if fullest[0] > self.waste:
                    fullest[1].append((doc_id, at, ids[at:at + fullest[0]], total))
                    at += fullest[0]
                self.windows.remove(fullest)
                self.done.append(fullest[1])
                continue
            best[1].append((doc_id, at, ids[at:], total))
            best[0] -= need
            at = total
            if best[0] == 0:
                self.windows.remove(best)
                self.done.append(best[1])

    def close(self) -> list[tuple]:
        """Merges the open windows by cutting; returns the pieces of the one that stays partly full."""
        rest, free = [], self.length
        for _, pieces in sorted(self.windows, key=lambda w: w[0]):
            for doc_id, start, ids, total in pieces:
                while len(ids):
                    cut = min(free, len(ids))
                    rest.append((doc_id, start, ids[:cut], total))
                    start, ids, free = start + cut, ids[cut:], free - cut
                    if free == 0:
                        self.done.append(rest)
                        rest, free = [], self.length
        self.windows = []
        return rest


PIECE = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
         ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long,"
          " ids array<int>, partition long")


def _rows(sequences: Iterable[tuple[int, list[tuple]]], with_ids: bool, partition: int | None = None) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in range(9)]
    for sequence, pieces in sequences:
        offset = 0
        for doc_id, start, ids, total in pieces:
            keep = with_ids or partition is not None
            values = (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset,
                      ids.astype(np.int32) if keep else None, partition)
            for column, value in zip(columns, values):
                column.append(value)
            offset += len(ids)
    types = [t for _, t in PIECE] + [pa.list_(pa.int32()), pa.int64()]
    names = [n for n, _ in PIECE] + ["ids", "partition"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, open_windows: int = OPEN_WINDOWS,
         waste: int = WASTE, with_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with ``with_ids``, ids; one row per piece.

    Each row of ``docs`` is tokenized whole and ends with id 0; a missing or empty text is that one id. Rows that
    repeat are packed each. Sequence ids are unique, not successive. An empty table gives no rows. Partitions follow
    the input's; their rows are written before the last windows are merged, so that a retried task changes nothing.
    """
    path = vocabulary or default_vocabulary()
    end = np.array([END_ID], dtype="<u4")

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, count = TaskContext.get().partitionId(), 0
        packer, encode = Packer(length, open_windows, waste), encoder(path)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), 256):
                for doc_id, text in zip(doc_ids[at:at + 256], texts[at:at + 256]):
                    packer.add(doc_id, np.concatenate([encode.ids(text), end]))
                if packer.done:
                    yield _rows([((number << 32) + count + k, s) for k, s in enumerate(packer.done)], with_ids)
                    count += len(packer.done)
                    packer.done = []
        rest = packer.close()
        yield _rows([((number << 32) + count + k, s) for k, s in enumerate(packer.done)], with_ids)
        if rest:
            yield _rows([(-1, rest)], with_ids, number)

    def merge(left: pa.Table) -> pa.Table:
        left = left.sort_by([("partition", "ascending"), ("offset", "ascending")])
        group = left.column("partition")[0].as_py() // MERGE
        packer = Packer(length, 1, 0)
        packer.windows = [[0, [(r["doc_id"], r["start"], np.array(r["ids"], dtype="<u4"), r["doc_tokens"])
                               for r in left.to_pylist()]]]
        rest = packer.close()
        done = packer.done + ([rest] if rest else [])
        return pa.Table.from_batches([_rows([((1 << 62) + (group << 32) + k, s) for k, s in enumerate(done)], with_ids)])

    placed = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t"))
                     .mapInArrow(per_partition, PIECES), "placed")
    merged = placed.where("partition IS NOT NULL").groupBy(
        F.floor(F.col("partition") / F.lit(MERGE)).alias("merge_group")).applyInArrow(merge, PIECES)
    out = placed.where("partition IS NULL").unionByName(merged).drop("partition")
    return out if with_ids else out.drop("ids")


def digest(docs: DataFrame) -> DataFrame:
    return pack(docs, with_ids=False)
