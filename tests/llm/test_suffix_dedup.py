"""Removal of repeated bytes against brute force, and the index against plain suffixes."""

import hashlib
import random

import numpy as np
import pytest
from gleanery.llm import suffix_dedup as S


def brute(rows, length):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i : i + length] = True
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def cases():
    r = random.Random(2)
    text = lambda n: "".join(r.choice("abcdeé \n") for _ in range(n))
    passage, other = text(300), text(130)
    rows = [(i, text(r.choice([0, 20, 99, 100, 400]))) for i in range(20)]
    for i in range(20, 50):
        a = r.randrange(150)
        rows.append((i, text(r.randrange(80)) + passage[a : a + r.randrange(60, 250)] + text(r.randrange(30)) + other[r.randrange(20) :]))
    rows += [(60, "Que " * 200), (61, "x" * 500), (62, "Que " * 150 + passage), (63, None), (64, ""), (65, rows[19][1] * 3), (None, passage)]
    rows += [(70 + i, rows[i][1]) for i in range(15, 35)]
    r.shuffle(rows)
    return rows


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(map(tuple, S.remove_repeats(df, with_text=False, **options).collect()), key=str)


@pytest.mark.parametrize(("length", "gram"), [(100, 24), (40, 12)])
def test_against_brute_force(spark, length, gram):
    rows = cases()
    assert run(spark, rows, length=length, gram=gram) == brute(rows, length)


@pytest.mark.parametrize(("hot", "windows"), [(10**6, 4), (1, 1), (1, 4), (3, 9)])
def test_split_anchors_full_filters_and_many_shards(spark, monkeypatch, hot, windows):
    monkeypatch.setattr(S, "PART_BITS", 8)
    monkeypatch.setattr(S, "FILTER_BITS", 64)  # most anchors pass
    monkeypatch.setattr(S, "SHARD_BYTES", 500)
    monkeypatch.setattr(S, "HOT_SEGMENTS", hot)
    monkeypatch.setattr(S, "PIECE_WINDOWS", windows)
    monkeypatch.setattr(S.pieces, "__defaults__", (windows,))
    rows = cases()
    assert run(spark, rows) == brute(rows, 100)


def test_the_edge_of_a_common_passage_fills_many_keys():
    """Segments at the edge of a passage: their pieces inside it are the same, those beside it are told apart by key."""
    r = random.Random(9)
    text = lambda n: "".join(r.choice("abcdefghij") for _ in range(n)).encode()
    passage, found = text(100), {}
    for i in range(300):
        data = np.frombuffer(text(200) + passage, np.uint8)
        row, begin, end, anchor, _ = S.segments(data, np.array([0, len(data)]), 100, 24)
        for s, e, a in zip(begin, end, anchor):
            for ps, pe, key, piece in S.pieces(data[s:e].tobytes(), int(a), 100, 24):
                found.setdefault(key, set()).add(piece)
    assert len(found) > 5000 and max(map(len, found.values())) < 300


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x" * 300, 1, "a", 5)], "doc_id long, text string, n_bytes int, N_SPANS string, _spans int")
    row = S.remove_repeats(df).first()
    assert (row.n_bytes, row.n_spans, row.n_removed, row._spans) == (300, 1, 299, 5)


def test_text_and_other_columns_stay(spark):
    df = spark.createDataFrame([(1, "é" * 120, "a", 3), (2, "b" + "é" * 120, "b", 4)], "doc_id int, text string, start string, n int")
    got = {r.doc_id: (r.text, r.start, r.n) for r in S.remove_repeats(df).collect()}
    # windows of 100 bytes repeat within the first text: its first 50 letters stay with the cut one's bytes
    assert got[2] == ("b", "b", 4)
    assert got[1][1:] == ("a", 3)


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_index_neighbours_are_those_of_the_suffix_array():
    r = np.random.default_rng(4)
    for n in [200, 90, 40] * 20:
        text = r.integers(1, 3, n).astype(np.int16)
        text[r.integers(0, n, 5)] = 0
        text[-1] = 0
        order = sorted(range(len(text)), key=lambda i: list(text[i:]))
        assert list(S.suffix_order(text)) == order
        index = S.RunLengthIndex(text)
        at = np.array(order[1:])
        assert list(index.neighbours(at)) == order[:-1]
        last = [text[i - 1] if i else -1 for i in order]
        assert list(np.repeat(index.symbols, index.lengths)) == last
