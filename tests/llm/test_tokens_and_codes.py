"""Token alignment, packing and vector codes against plain loops, and on odd rows."""

import hashlib
import math
import random
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from stripcohort.llm import align, codebooks, packing, queries

A, B, W = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
ODD = [None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "a \n b", "\nword", "word\n", "tab\tone two", "it's we'll they'd", "<|endoftext|> end", "x <s> y </s>", "▁ under ▁", "ﬁne ①② ｆｕｌｌ", "é é", "日本語 テキスト", "emoji 😀😀 ok"]
ODD += ["nul \x00 in", "sep\x1cone \x1f two", "wide space  x", "12345 6,7.8 !!", "Éa leé. Ñu!ñ", "a.́b ≠ c", "CAPS <|ENDOFTEXT|> x", "word. word, word; again word.", "\r\n win\r\nlines", "ΑΣ ΣΑΣ ς", "x" * 3000, "la mer " * 4000]


def texts():
    r = random.Random(5)
    letters = ["a", "b", "é", "E", ".", ",", "'", "s", " ", " ", " ", "\n", "\t", " ", "́", "日", "7", "<", "|", "▁", "th", "ion", "\x1c", "😀"]
    return ODD + ["".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(300)] + ["a  b", None]


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), Tokenizer.from_file(W)


def plain_alignment(text, a, sp):
    """ids and byte ranges of both, or nothing."""
    if not text:
        return None
    table = align.byte_table()
    whole = f" {text}".encode()
    out = []
    for ids, say in ((a.encode(f" {text}", add_special_tokens=False).ids, lambda i: bytes(table[c] for c in a.id_to_token(i))), (sp.encode(text), lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode())):
        parts = [say(i) for i in ids]
        if b"".join(parts) != whole:
            return None
        ends = np.cumsum([len(p) for p in parts]).tolist()
        out.append(list(zip(ids, [0, *ends[:-1]], ends, strict=True)))
    return out


def test_alignment_equals_plain_loops(spark, tools):
    a, sp, _ = tools
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_a int, groups string").repartition(3)
    aligned = align.align(df, A, B)
    ends = {r["doc_id"]: r["ends"] for r in aligned.collect()}
    got = {r["doc_id"]: r for r in align.with_counts(aligned.withColumn("said", F.col("groups"))).collect()}
    want, links, count = {}, {}, {}
    for i, t in rows:
        if not (both := plain_alignment(t, a, sp)):
            want[i] = (0, 0, 0, 0, "", [])
            continue
        cuts = sorted({x[2] for x in both[0]} & {x[2] for x in both[1]})
        said, lo = [], 0
        for hi in cuts:
            said.append("|".join(",".join(str(k) for k, s, e in side if lo <= s and e <= hi) for side in both))
            lo = hi
        links[i] = [(x[0], y[0]) for x in both[0] for y in both[1] if x[1] < y[2] and y[1] < x[2]] if len(t) < 5000 else merged(*both)
        for k in links[i]:
            count[k] = count.get(k, 0) + 1
        want[i] = (len(both[0]), len(both[1]), len(cuts), len(links[i]), ";".join(said), cuts)
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    assert sum(1 for w in want.values() if w[0]) > 100 and sum(1 for i, t in rows if t and not want[i][0]) > 5
    for i, _ in rows:
        r = got[i]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["said"], ends[i]) == want[i], rows[i]
        mine = links.get(i, [])
        assert r["n_best"] == sum(count[k] == top[k[1]] for k in mine) and r["count_sum"] == sum(count[k] for k in mine)


def merged(a, b):
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        out.append((a[i][0], b[j][0]))
        x, y = a[i][2], b[j][2]
        i, j = i + (x <= y), j + (y <= x)
    return out


def test_rare_pairs_meet_their_counts_too(spark, monkeypatch):
    """With few pairs broadcast, the shuffled rest gives the same rows."""
    df = spark.createDataFrame([(i % 7, t) for i, t in enumerate(texts())], "doc_id long, text string")
    rows = lambda: sorted(tuple(r) for r in align.with_counts(align.align(df, A, B, spans=False)).collect())
    want = rows()
    monkeypatch.setattr(align, "BROADCAST_ROWS", 20)
    assert rows() == want and len(want) == df.count()


def test_alignment_and_packing_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert align.with_counts(align.align(empty, A, B)).collect() == []
    assert packing.pack(empty, W).collect() == []


def test_packed_pieces_are_the_documents(spark, tools):
    every = [*texts(), "Le chat noir. " * 3000, "un deux trois quatre " * 700]
    rows = [(i if i % 9 else None, t, i) for i, t in enumerate(every)] + [(1, "twice", -1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = packing.pack(df.repartition(3), W).collect()
    expected = sorted(((d, (*tools[2].encode(t or "", add_special_tokens=False).ids, 1)) for d, t, _ in rows), key=str)
    sequences = {}
    for r in got:
        assert r["length"] == len(r["ids"]) // 4 and r["length"] > 0
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0 and at < 2048  # no padding
    # pieces in order of start are whole documents; equal or null ids keep theirs apart by what they hold
    lone = {}
    for r in got:
        lone.setdefault(r["doc_id"], []).append((r["start"], struct.unpack(f"<{r['length']}I", r["ids"]), r["doc_tokens"]))
    for d, ids in expected:
        if d is not None and d != 1:
            joined, at = [], 0
            for start, piece, n in sorted(lone[d]):
                assert start == at and n == len(ids)
                joined += piece
                at += len(piece)
            assert tuple(joined) == ids
    assert sum(r["length"] for r in got) == sum(len(x) for _, x in expected)


def test_packing_query_gives_checksums(spark):
    rows = queries.op12_packing(spark, "/root/testdata/sf0.001").collect()
    made = packing.pack(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), W).collect()
    key = lambda r: (r["sequence_id"], r["offset"])
    assert {key(r): r["ids_crc32"] for r in rows} == {key(r): zlib.crc32(r["ids"]) for r in made}


def test_pieces_go_where_squares_grow_least():
    r, packer, open_ = random.Random(3), packing.Packer(64), []
    closed = 0
    for k in range(400):
        n = r.choice([7, 13, 21, 30, 33, 50, 63, r.randint(1, 63)])
        squares = lambda levels: sum(levels.count(h) ** 2 for h in set(levels) if h < 64)
        costs = [(squares([*open_, n]), 0)] + [(squares([*(open_[:i] + open_[i + 1 :]), h + n]), -h) for h in set(open_) if h + n <= 64 for i in [open_.index(h)]]
        cost, h = min(costs)
        full = list(packer.place((np.zeros(n, "<u4"), k, 0)))
        if h:
            open_.remove(-h)
        open_.append(-h + n)
        closed += len(full)
        open_ = [x for x in open_ if x < 64]
        assert sorted(open_) == sorted(h for h in range(1, 64) for _ in packer.open[h])
        assert [int(x) for x in packer.level[1:64]] == [len(packer.open[h]) for h in range(1, 64)]
    assert closed


def test_open_windows_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "MOST_OPEN", 8)
    packer, sizes = packing.Packer(64), []
    for k in range(200):  # no two of these fit together
        sizes += [sum(len(p[0]) for p in w) for w in packer.place((np.arange(40, dtype="<u4"), k, 0))]
        assert packer.held <= 9
    tail = [sum(len(p[0]) for p in w) for w in packer.last()]
    assert set(sizes) == {64} and all(n == 64 or n & (n - 1) == 0 for n in tail) and sum(sizes + tail) == 200 * 40


def plain_codes(rows, parts=8, k=16, rounds=6, scale=4096):
    kept = [(i, lab, [math.floor(scale * int(x)) if abs(x) > 1e300 else int(x) * scale if abs(x) > 2.0**60 else math.floor(scale * x) for x in v]) for i, lab, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:k]
    size = len(first[0][2]) // parts
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(r[2], p) for r in first] for p in range(parts)]
    near = lambda v, p: min((sum((x - y) ** 2 for x, y in zip(cut(v, p), e, strict=True)), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for _, _, v in kept:
                mine.setdefault(near(v, p)[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*mine[j], strict=True)] if j in mine else e for j, e in enumerate(books[p])]
    out = []
    for i, lab, v in kept:
        found = [near(v, p) for p in range(parts)]
        out.append((i, lab, [j for _, j in found], sum(d for d, _ in found)))
    return out, books


def coded(spark, rows, kind="float"):
    df = spark.createDataFrame([(i, lab, v, "x") for i, lab, v in rows], f"vec_id long, label int, embedding array<{kind}>, codes string")
    got, books = codebooks.compress(df.repartition(3))
    return got, books


@pytest.mark.parametrize("grid", [1, 3, 4096])
def test_codes_equal_plain_loops(spark, grid):
    """A coarse grid gives many ties and unused entries."""
    r = random.Random(grid)
    rows = [(k // 2 if k % 7 else None, k % 3 if k % 4 else None, [r.randint(-grid, grid) / 4096 for _ in range(16)]) for k in range(150)]
    rows += [(3, 1, None), (4, 1, [None] * 16), (5, 1, [float("nan")] * 16), (6, 1, [float("inf")] * 16), (7, 1, []), *rows[:20]]
    got, books = coded(spark, rows)
    want, want_books = plain_codes(rows)
    assert books == want_books
    kept = got.collect()
    assert sorted((str(x["vec_id"]), str(x["label"]), x["codes"], x["error"]) for x in kept) == sorted((str(i), str(lab), c, e) for i, lab, c, e in want)
    sums = {}
    for _, lab, _, e in want:
        sums[lab] = sums.get(lab, 0) + e
    assert {(x["label"], x["label_error"]) for x in codebooks.with_label_errors(got).collect()} == set(sums.items())


def test_codes_of_huge_numbers_are_exact(spark):
    r = random.Random(9)
    rows = [(k, k % 2, [r.choice([1e-3, 1.0, 3e4, 1e9, 1e25, 1e300]) * r.uniform(-1, 1) for _ in range(8)]) for k in range(60)]
    got, books = coded(spark, rows, "double")
    want, want_books = plain_codes(rows)
    assert books == want_books
    of = {x["vec_id"]: x for x in got.collect()}
    for i, _, codes, e in want:
        assert of[i]["codes"] == codes and of[i]["error"] == (e if e < 1 << 63 else None)
    assert {x["label_error"] for x in codebooks.with_label_errors(got).collect()} == {None}


def test_codes_of_few_rows(spark):
    got, books = coded(spark, [(1, 0, None)])
    assert books == [] and codebooks.with_label_errors(got).collect() == []
    got, books = coded(spark, [(5, 0, [1.0] * 8), (2, 0, [2.0] * 8)])
    assert books == [[[8192], [4096]]] * 8 and {r["vec_id"]: r["codes"] for r in got.collect()} == {2: [0] * 8, 5: [1] * 8}
    with pytest.raises(ValueError, match="6 components"):
        coded(spark, [(5, 0, [1.0] * 6)])
    with pytest.raises(ValueError, match="id 6 has 16"):
        coded(spark, [(5, 0, [1.0] * 8), (6, 0, [1.0] * 16)])


def test_code_query_equals_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{d}/embeddings.parquet'")
    got = queries.op13_vector_codes(spark, d)
    want = con.execute(f"select {', '.join(got.columns)} from ({queries.ORACLE_SQL['op13_vector_codes']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_alignment_query_hashes_groups(spark):
    d = "/root/testdata/sf0.001"
    rows = queries.op11_token_alignment(spark, d).collect()
    said = {r["doc_id"]: r["groups"] for r in align.align(spark.read.parquet(f"{d}/documents.parquet"), A, B).collect()}
    assert len(rows) == len(said) and all(r["groups_sha256"] == (hashlib.sha256(said[r["doc_id"]].encode()).hexdigest() if r["n_a"] else "") for r in rows)
