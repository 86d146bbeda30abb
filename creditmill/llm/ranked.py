"""Ranked lexical search: max-sketches of documents bound the scores, exact scores are taken in descending bound order.

A term's impact on a document's score grows with its occurrences there, for one document length. So a document's impacts
fold into one small sketch: terms are hashed to slots, and a slot keeps the most occurrences of any of its terms. A
query term's slot then bounds the term's impact from above, and the weighted slots of a query bound its score. Sketches
do not depend on the queries and are written once; a block of queries is looked up in all of them by one product of
matrices per batch. Exact scores of the documents with the highest bounds give each query a threshold, and only
documents whose bound reaches it are read and scored, highest bounds first.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditmill.llm.common import bit_map, text_of, with_maybe, written

TOP = 10
SLOTS = 4096
#: Occurrences a sketch can hold; this value stands for up to the document's length.
MANY = 65535
#: Query terms (repeated over queries) of one block; a query with more is a block of its own.
BLOCK_TERMS = 20_000
#: Documents a query's first threshold is taken from.
FIRST = 32
_SLICE = 512
#: A-Z to lower case, all other ASCII but digits and a-z to blanks.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    """Runs of ASCII letters and digits and of anything beyond ASCII, in UTF-8; only A-Z are lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def impact(tf, m):
    """What a term with ``tf`` occurrences adds per unit of weight; grows with ``tf``. Integers or arrays of them."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def length_factor(n, n_docs: int, n_terms: int):
    return 10 + 90 * n * n_docs // n_terms


def _marked(docs: DataFrame) -> DataFrame:
    """mark stands for a row; rows that share one are only read together, so chance equality changes no result."""
    t = text_of()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), t.alias("t"),
                       F.xxhash64(F.col("doc_id").cast("long"), t).alias("mark"))


def sketch(text: str, slots: int = SLOTS) -> tuple[int, np.ndarray, np.ndarray]:
    """(terms with repeats, slots in use, most occurrences of a term of each slot)."""
    counts = Counter(terms(text))
    fold = np.zeros(slots, dtype=np.uint16)
    at = np.fromiter((zlib.crc32(t) % slots for t in counts), np.int64, len(counts))
    tf = np.fromiter(counts.values(), np.int64, len(counts))
    np.maximum.at(fold, at, np.minimum(tf, MANY).astype(np.uint16))
    used = np.flatnonzero(fold)
    return int(tf.sum()), used.astype("<u2"), fold[used].astype("<u2")


def index(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(mark, doc_id, n, slots, most) of every row with at least one term, as a written table."""
    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(t.as_py(), slots) for t in batch.column("t")]
            keep = [k for k, (n, _, _) in enumerate(found) if n]
            yield pa.RecordBatch.from_arrays([
                batch.column("mark").take(pa.array(keep, pa.int64())), batch.column("doc_id").take(pa.array(keep, pa.int64())),
                pa.array([found[k][0] for k in keep], pa.int64()), pa.array([found[k][1].tobytes() for k in keep], pa.binary()),
                pa.array([found[k][2].tobytes() for k in keep], pa.binary())], names=["mark", "doc_id", "n", "slots", "most"])

    return written(_marked(docs).mapInArrow(per_partition, "mark long, doc_id long, n long, slots binary, most binary"),
                   "sketches")


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items in blocks of at most ``most`` terms; rows of one item_id are one query of all their terms."""
    block, held, last, found = [], 0, (), set()
    rows = items.select(F.col("item_id").cast("long"), text_of()).orderBy("item_id").toLocalIterator()
    for item, text in (*rows, ((), "")):
        if item != last:
            if last != () and found:
                if block and held + len(found) > most:
                    yield block
                    block, held = [], 0
                block.append((last, sorted(found)))
                held += len(found)
            last, found = item, set()
        found.update(terms(text))
    if block:
        yield block


def _frequencies(rows: DataFrame, words: dict[bytes, int]) -> dict[int, int]:
    """How many documents hold each of the block's terms; tasks count before the shuffle."""
    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(words), dtype=np.int64)
        for batch in batches:
            for t in batch.column(0):
                for term in words.keys() & set(terms(t.as_py())):
                    held[words[term]] += 1
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(held[some], pa.int64())], names=["term", "df"])

    return dict(rows.select("t").mapInArrow(per_partition, "term long, df long").groupBy("term").agg(F.sum("df")).collect())


class Block:
    """One block of queries with their weights, and the matrix that turns sketches into bounds."""

    def __init__(self, queries: list[tuple[int | None, list[bytes]]], df: dict[int, int], words: dict[bytes, int],
                 n_docs: int, n_terms: int, slots: int):
        self.n_docs, self.n_terms, self.slots = n_docs, n_terms, slots
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[k] + 1))) for t, k in words.items() if k in df}
        self.ids = [item for item, _ in queries]
        self.terms = [[(t, weight[t]) for t in query if weight.get(t)] for _, query in queries]
        used = sorted({zlib.crc32(t) % slots for query in self.terms for t, _ in query})
        self.column = np.full(slots, -1, dtype=np.int64)
        self.column[used] = np.arange(len(used))
        self.weights = np.zeros((len(used), len(queries)))
        for q, query in enumerate(self.terms):
            for t, w in query:
                self.weights[self.column[zlib.crc32(t) % slots], q] += w

    def bounds(self, batch: pa.RecordBatch) -> np.ndarray:
        """documents x queries; whole numbers, exact in doubles."""
        parts = [np.frombuffer(s.as_py(), "<u2") for s in batch.column("slots")]
        row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        column = self.column[np.concatenate(parts)]
        tf = np.concatenate([np.frombuffer(s.as_py(), "<u2") for s in batch.column("most")]).astype(np.int64)
        n = np.asarray(batch.column("n"))
        some = column >= 0
        row, column, tf = row[some], column[some], tf[some]
        tf = np.where(tf == MANY, n[row], tf)
        # the factor of a long document may pass 64 bits in the making, so it is computed in Python's integers
        m = np.array([length_factor(int(x), self.n_docs, self.n_terms) for x in n], dtype=np.int64)
        held = np.zeros((len(parts), self.weights.shape[0]))
        held[row, column] = impact(tf, m[row])
        return held @ self.weights

    def score(self, q: int, counts: dict[bytes, int], m: int) -> int:
        return sum(w * impact(counts[t], m) for t, w in self.terms[q] if t in counts)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            yield batch.slice(at, _SLICE)


PAIR = "query int, mark long, bound double"


def _pairs(query, mark, bound) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(mark, pa.int64()), pa.array(bound, pa.float64())],
                                      names=["query", "mark", "bound"])


def _highest(sketches: DataFrame, block: Block, k: int) -> DataFrame:
    """Of each task's documents the ``k`` with the highest bound for each query."""
    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((0, len(block.ids)))
        marks = np.zeros((0, len(block.ids)), dtype=np.int64)
        for batch in _slices(batches):
            best = np.vstack([best, block.bounds(batch)])
            own = np.asarray(batch.column("mark"))
            marks = np.vstack([marks, np.broadcast_to(own[:, None], (len(own), len(block.ids)))])
            if len(best) > k:
                top = np.argpartition(best, len(best) - k, axis=0)[-k:]
                best, marks = np.take_along_axis(best, top, 0), np.take_along_axis(marks, top, 0)
        _, query = np.nonzero(best > 0)
        yield _pairs(query, marks[best > 0], best[best > 0])

    return sketches.mapInArrow(per_partition, PAIR)


def _reaching(sketches: DataFrame, block: Block, least: np.ndarray) -> DataFrame:
    """All (query, document) whose bound reaches the query's threshold."""
    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            bounds = block.bounds(batch)
            row, query = np.nonzero(bounds >= least)
            yield _pairs(query, np.asarray(batch.column("mark"))[row], bounds[row, query])

    return sketches.mapInArrow(per_partition, PAIR)


def _rescored(rows: DataFrame, pairs: DataFrame, block: Block, least: np.ndarray, k: int) -> DataFrame:
    """(query, doc_id, score): each task's ``k`` best of ``pairs`` for each query, from the whole texts.

    A task takes its pairs in descending order of their bounds, and leaves a query at the first bound below the query's
    threshold or below its own k-th best score. A bit map of the marks keeps all other texts out of the shuffle.
    """
    by_doc = written(pairs.groupBy("mark").agg(F.collect_set(F.struct("query", "bound")).alias("asked")), "asked")
    texts = with_maybe(rows, ["mark"], bit_map(by_doc, ["mark"]), "maybe").where("maybe").drop("maybe").join(by_doc, "mark")

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        for batch in _slices(batches):
            ids, texts, asked = (batch.column(c).to_pylist() for c in ("doc_id", "t", "asked"))
            todo = sorted(((a["bound"], row, a["query"]) for row, some in enumerate(asked) for a in some), reverse=True)
            counted: dict[int, tuple] = {}
            for bound, row, q in todo:
                heap = best.setdefault(q, [])
                if bound < least[q] or (len(heap) == k and bound < heap[0][0]):
                    continue
                if row not in counted:
                    counts = Counter(terms(texts[row]))
                    counted[row] = counts, length_factor(counts.total(), block.n_docs, block.n_terms)
                score = block.score(q, *counted[row])
                if score > 0:  # of equal scores the least doc_id is best, a missing one worst
                    entry = (score, ids[row] is not None, -(ids[row] or 0))
                    (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, entry)
        found = [(q, -e[2] if e[1] else None, e[0]) for q, heap in best.items() for e in heap]
        columns = list(zip(*found)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()),
                                          pa.array(columns[2], pa.int64())], names=["query", "doc_id", "score"])

    return texts.select("doc_id", "t", "asked").mapInArrow(per_partition, "query int, doc_id long, score long")


def _best(found: DataFrame, order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each query; tasks have left at most k a query each."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, slots: int = SLOTS, block_terms: int = BLOCK_TERMS,
           first: int = FIRST) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` rows of ``docs`` with the highest scores above 0 for each item.

    Each row of ``docs`` is a document, also one that repeats another; missing and empty texts have no terms and are in
    no result and no count. Equal scores are ranked by ascending doc_id, a missing doc_id last. Rows of ``items`` with
    one item_id (a missing one too) are one query of all their terms; a query without terms has no rows. Columns beside
    doc_id, text and item_id, text do not matter. Empty tables give no rows.
    """
    spark = docs.sparkSession
    rows, sketches = _marked(docs), index(docs, slots)
    n_docs, n_terms = sketches.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    out = None
    for queries in _blocks(items, block_terms) if n_docs else ():
        words = {t: i for i, t in enumerate(sorted({t for _, query in queries for t in query}))}
        block = Block(queries, _frequencies(rows, words), words, n_docs, n_terms, slots)
        none = np.ones(len(queries))
        tried = _best(_highest(sketches, block, k), [F.desc("bound"), "mark"], first).drop("rank")
        scored = _best(_rescored(rows, tried, block, none, k), [F.desc("score")], k)
        least = none.copy()
        for q, n, score in scored.groupBy("query").agg(F.count("*"), F.min("score")).collect():
            least[q] = score if n == k else 1
        final = _rescored(rows, _reaching(sketches, block, least), block, least, k)
        ids = spark.createDataFrame([(q, item) for q, item in enumerate(block.ids)], "query int, item_id long")
        done = written(_best(final, [F.desc("score"), F.asc_nulls_last("doc_id")], k).join(F.broadcast(ids), "query").select(
            "item_id", "rank", "doc_id", "score"), "ranked")
        out = done if out is None else out.union(done)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
n AS (SELECT r, doc_id, len(ts) AS n, ts FROM d WHERE len(ts) > 0),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
f AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM n) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
      FROM (SELECT term, count(*) AS df FROM f GROUP BY term), s),
m AS (SELECT r, doc_id, 10 + (90 * n * docs) // terms AS m FROM n, s),
x AS (SELECT item_id, r, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN f USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY item_id, r)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM x WHERE score > 0 QUALIFY rank <= 10
"""
