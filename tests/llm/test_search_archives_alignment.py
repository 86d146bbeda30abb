"""Ranked search, WARC archives and token alignment against brute force, on missing, long, repeated and tied values."""

from __future__ import annotations

import gzip
import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from creditmill.llm import align, ranked, warc
from creditmill.session import new_table_path

SCHEMA = "doc_id long, text string, n string, query int, mark long, t string, row long, a string, bound double"
WORDS = [f"w{k}" for k in range(60)] + ["Straße", "ÄÖ", "日本語", "x-y", "don't", "tab\tbed", "naïve café", "\x00nul", "\U0001f600"]
LONG = " ".join(f"word{k * k % 7919}" for k in range(40_000))


def some_texts(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(k, " ".join(rng.choices(WORDS, [1 / (1 + j) for j in range(len(WORDS))], k=rng.randint(1, 80)))) for k in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, " .,;\n\t "), (n + 3, LONG), (n + 4, LONG + " tail W1 w1"), (None, rows[0][1]),
             (None, None), (3, rows[3][1]), (3, rows[3][1]), (7, "another text of a known id w1 w2"), (-5, rows[2][1]), (n + 5, "w9 " * 70_000)]
    return rows


def frame(spark, rows, schema=SCHEMA, parts=3):
    return spark.createDataFrame([(d, t, "x", 1, 2, "y", 3, "z", 0.5) for d, t in rows], schema).repartition(parts)


def counted(rows):
    return Counter(tuple(r) for r in rows)


# -- ranked search ---------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain_terms(text):
    return TERM.findall((text or "").translate(UPPER))


def plain_search(docs, items, k=10):
    held = [(d, Counter(plain_terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    queries = defaultdict(set)
    for item, text in items:
        queries[item] |= set(plain_terms(text))
    out = []
    for item, query in queries.items():
        found = []
        for d, c in held:
            m = 100 - 90 + 90 * c.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
                        for t in query & c.keys())
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


ITEMS = [(1, "w1 w2 w40 Straße"), (2, "W9 w9"), (3, None), (4, ""), (5, "nothing known here"), (6, " ".join(WORDS)),
         (2, "word4 tail"), (None, "w3 w5"), (None, "日本語"), (7, LONG), (8, "straße")]


def test_terms():
    for text in [*WORDS, "AbÇd 1_2", LONG[:500], "a\x7fb\x80c d"]:
        assert [t.decode() for t in ranked.terms(text)] == plain_terms(text)


@pytest.mark.parametrize("slots, block_terms", [(4096, 20_000), (8, 20_000), (64, 6)])
def test_search_matches_brute_force(spark, slots, block_terms):
    rows = some_texts(1, 120)
    items = spark.createDataFrame([(i, t, "d") for i, t in ITEMS], "item_id long, text string, doc_id string")
    got = ranked.search(frame(spark, rows), items, slots=slots, block_terms=block_terms)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [
        ("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert counted(got.collect()) == plain_search(rows, ITEMS)


def test_search_ties_and_few_results(spark):
    rows = [(k, "same words here") for k in range(40, 0, -1)] + [(None, "same words here"), (99, "other")]
    got = ranked.search(frame(spark, rows), spark.createDataFrame([(1, "words"), (2, "other")], "item_id int, text string"), first=10)
    assert [(r.rank, r.doc_id) for r in got.where("item_id = 1").orderBy("rank").collect()] == [(k, k) for k in range(1, 11)]
    assert [(r.rank, r.doc_id) for r in got.where("item_id = 2").collect()] == [(1, 99)]


def test_search_of_nothing(spark):
    none, items = frame(spark, [(1, None)]).limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.search(none, items).count() == 0 and ranked.search(frame(spark, [(1, None), (2, "")]), items).count() == 0
    assert ranked.search(frame(spark, [(1, "a")]), items.limit(0)).count() == 0


def test_bounds_never_fall_below_scores(spark):
    rows = some_texts(2, 60)
    sketches = ranked.index(frame(spark, rows), 16)
    n_docs, n_terms = sketches.selectExpr("count(*)", "sum(n)").first()
    query = sorted({t for _, text in rows[:5] for t in ranked.terms(text)})
    words = {t: k for k, t in enumerate(query)}
    block = ranked.Block([(1, query)], {k: 3 for k in range(len(query))}, words, n_docs, n_terms, 16)
    for batch in sketches.toArrow().to_batches():
        for bound, mark, n in zip(block.bounds(batch)[:, 0], batch.column("mark").to_pylist(), batch.column("n").to_pylist()):
            texts = [t for _, t in rows if t and len(ranked.terms(t)) == n]
            assert any(bound >= block.score(0, Counter(ranked.terms(t)), ranked.length_factor(n, n_docs, n_terms)) for t in texts), mark


# -- WARC ------------------------------------------------------------------------------------------------------------

BIG = "<p>" + "ä" * 700
PAGES = [(1, "http://a.example/x", BIG), (2, "http://b.example/ y\r\nWARC-Type: x", BIG), (3, None, BIG), (4, "http://c", "small"),
         (5, "http://d", "small"), (6, "http://e", None), (7, "http://f", ""), (8, "http://g", LONG), (8, "http://g", LONG),
         (None, "http://h", LONG), (None, "http://i", "b" * 999), (9, "http://i", "b" * 999), (10, "http://j", "c" * 1000),
         (11, "http://j", "c" * 1000), (12, "http://k", "\r\n\r\n" + "WARC/1.1\r\n" * 200), (13, "", "x\x00y" * 400)]


def pages(spark, rows, parts=3):
    return spark.createDataFrame([(i, u, h, "m", "r", 1) for i, u, h in rows],
                                 "page_id long, url string, html string, maybe string, refers_to string, n int").repartition(parts)


def plain_archive(rows):
    last = {}
    for i, _, h in rows:
        h = h or ""
        if i is not None:
            last[h] = max(i, last.get(h, i))
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 1000 and i != last.get(h)
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last[h] if again else None))
    return Counter(out)


def test_archive_round_trip(spark):
    assert counted(warc.digest(pages(spark, PAGES)).collect()) == plain_archive(PAGES)


def test_all_responses_come_back_whole(spark):
    files = warc.write(pages(spark, PAGES), new_table_path(spark, "warc-test"), file_bytes=2000)
    assert files.agg(F.sum("records")).first()[0] == len(PAGES) and files.count() > 3
    back = warc.read(files, with_payload=True, batch_rows=2).collect()
    assert all(r.error is None for r in back) and len(back) == len(PAGES)
    wanted = Counter((h or "") for (i, _, h), kind in zip(PAGES, [next(k for a, _, d, k, _ in plain_archive([p])) for p in PAGES]))
    got = Counter(r.payload.decode() for r in back if r.headers["warc-type"] == "response")
    assert set(got) == set(wanted) and got[BIG] == 1 and got["small"] == 2 and got[LONG] == 2
    targets = {r.headers.get("warc-target-uri") for r in back}
    assert "http://b.example/%20y%0D%0AWARC-Type:%20x" in targets and None in targets
    # every member is a record of its own that other tools can inflate
    path = files.first().path.removeprefix("file:")
    assert gzip.open(path).read().count(b"WARC-Block-Digest") == files.first().records


def test_archive_of_nothing(spark):
    assert warc.digest(pages(spark, PAGES).limit(0)).count() == 0


def archive(*payloads, **other):
    return [warc.member(k, f"http://{k}", p, len(p), hashlib.sha1(p).hexdigest(), False, None) for k, p in enumerate(payloads)]


@pytest.mark.parametrize("piece", [1, 7, 4096, 1 << 16])
def test_reader_frames_records_in_any_pieces(piece):
    payloads = [b"", b"a", b"\r\n\r\n" * 9, bytes(range(256)) * 30]
    got = list(warc.records(io.BytesIO(b"".join(archive(*payloads))), True, piece))
    assert [r.payload for r in got] == payloads and not any(r.error for r in got)
    offsets, at = [], 0
    for m in archive(*payloads):
        offsets.append(at)
        at += len(m)
    assert [r.offset for r in got] == offsets


def test_reader_reports_faults_and_goes_on():
    first, second, third = archive(b"one" * 500, bytes(random.Random(1).randbytes(3000)), b"three")
    plain = gzip.decompress(second)

    def again(data):
        packed = zlib.compressobj(6, zlib.DEFLATED, 31)
        return packed.compress(data) + packed.flush()

    faults = {
        "block differs": again(plain[:-50] + b"x" + plain[-49:]), "more bytes": again(plain + b"more"),
        "fewer bytes": again(plain[:-100]), "version": again(b"HTTP" + plain[4:]), "no Content-Length": again(plain.replace(b"Content-Length", b"X", 1)),
        "": second[:200] + b"\x00" * 60 + second[260:],
    }
    for text, bad in faults.items():
        got = list(warc.records(io.BytesIO(first + bad + third), True))
        assert [r.payload for r in got if r.error is None] == [b"one" * 500, b"three"], text
        assert any(text in (r.error or "-") for r in got if r.error)
    cut = list(warc.records(io.BytesIO(first + third[:-9]), True))
    assert [r.error for r in cut] == [None, "the archive ends within a member"]
    assert list(warc.records(io.BytesIO(b""))) == []


# -- alignment -------------------------------------------------------------------------------------------------------

ODD = ["<|endoftext|> <s> </s> <0x41> <unk>", "naïve café \U0001f600 x́", "  two  blanks  ", "\n\n\ttab\r\n", "▁ piece mark", "日本語テキスト",
       "a", " ", "\x00\x01", "1234567890 " * 20, "İstanbul ΣΑΣ ﬁ Å"]


def plain_alignment(texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, sha), from spans and a loop over all overlaps."""
    files = align.default_files()
    one = Tokenizer.from_file(files[0])
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=files[1])
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in visible]
    code = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(rest)}
    done = []
    for text in texts:
        if not text:
            done.append(None)
            continue
        ids_a, ids_b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
        bytes_a = [bytes(code[c] for c in one.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()
                   for i, p in ((i, two.id_to_piece(i)) for i in ids_b)]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            done.append(None)
            continue
        ends_a, ends_b = ([sum(map(len, x[:k + 1])) for k in range(len(x))] for x in (bytes_a, bytes_b))
        common = sorted(set(ends_a) & set(ends_b))
        groups = []
        for low, high in zip([0, *common], common):
            groups.append(",".join(str(i) for i, e in zip(ids_a, ends_a) if low < e <= high) + "|"
                          + ",".join(str(i) for i, e in zip(ids_b, ends_b) if low < e <= high))
        links = [(i, j) for i, e, x in zip(ids_a, ends_a, bytes_a) for j, f, y in zip(ids_b, ends_b, bytes_b)
                 if e - len(x) < f and f - len(y) < e]
        done.append((len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    held = Counter(pair for d in done if d for pair in set(d[3]))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    return [(0,) * 6 + ("",) if d is None else (d[0], d[1], d[2], len(d[3]), sum(held[p] == most[p[0]] for p in d[3]),
                                                 sum(held[p] for p in d[3]), d[4]) for d in done]


@pytest.mark.parametrize("hot", [100_000, 40, 0])
def test_alignment_matches_brute_force(spark, hot):
    rows = some_texts(3, 40)[:-6] + [(100 + k, t) for k, t in enumerate(ODD)] + [(100, ODD[0]), (None, ODD[1]), (7, "one more text")]
    rows = [(d, t[:2000] if t else t) for d, t in rows]
    got = align.scores(frame(spark, rows), hot_pairs=hot)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert counted(got.collect()) == Counter((d, *w) for (d, _), w in zip(rows, plain_alignment([t for _, t in rows])))
    assert any(w[0] for w in plain_alignment(ODD)) and not all(w[0] for w in plain_alignment(ODD))


def test_alignment_of_long_texts_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(align, "PAIRS_HELD", 50)
    rows = [(1, LONG), (2, LONG + " tail"), (3, "x" * 20_000), (4, "w9 " * 30_000), (5, "short")]
    got = {r.doc_id: r for r in align.scores(frame(spark, rows), hot_pairs=30).collect()}
    assert all(r.n_links == r.n_a + r.n_b - r.n_groups > 0 for r in got.values())
    assert got[1].n_best <= got[1].n_links and got[2].count_sum > got[5].count_sum
    assert align.scores(frame(spark, rows).limit(0)).count() == 0
    assert [tuple(r)[1:] for r in align.scores(frame(spark, [(1, None), (2, "")])).collect()] == [(0,) * 6 + ("",)] * 2
