"""The FM-index operator against a brute-force search, and its edge cases."""

import random
import re

import numpy as np
import pytest
from gleanery.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(t):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))


def brute(docs, bench, window=13):
    out = []
    for doc_id, text in docs:
        w, hit, items = fold(text), set(), set()
        for item, t in bench:
            b = fold(t)
            for i in range(max(1, len(b) - window + 1)) if b else ():
                g = b[i : i + window]
                for j in range(len(w) - len(g) + 1):
                    if w[j : j + len(g)] == g:
                        hit.update(range(j, j + len(g)))
                        items.add(item)
        out.append((doc_id, len(w), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def cases():
    r = random.Random(5)
    words = ["the", "of", "Ä1", "b-c", "x", "naïve", "Q9", "end."]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    bench = [(i, text(r.choice([0, 1, 3, 13, 20, 30]))) for i in range(8)] + [(8, None), (3, "repeated the of")]
    docs = [(i, text(r.choice([0, 5, 60, 200]))) for i in range(30)]
    docs += [(100 + i, f"{text(40)} {bench[i % 8][1]} {text(3)}") for i in range(12)]
    docs += [(7, None), (8, ""), (9, "!!! ---"), (None, bench[4][1]), (101, docs[31][1])]
    docs += [(200 + i, docs[31][1]) for i in range(5)]
    return docs, bench


def run(spark, docs, bench, window=13):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = D.contamination(d, b, window).select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()
    return sorted([(x[0], x[1], x[2], list(x[3]), x[4]) for x in got], key=str)


@pytest.mark.parametrize("window", [4, 13])
def test_against_brute_force(spark, window):
    docs, bench = cases()
    assert run(spark, docs, bench, window) == brute(docs, bench, window)


def test_large_benchmark_takes_several_passes(spark, monkeypatch):
    docs, bench = cases()
    monkeypatch.setattr(D, "BLOCK_BYTES", 150)
    assert run(spark, docs, bench) == brute(docs, bench)


def test_empty_tables(spark):
    docs, bench = cases()
    assert run(spark, [], bench) == []
    assert run(spark, docs, []) == brute(docs, [])


def test_extra_columns_stay_and_spans_are_cut(spark):
    d = spark.createDataFrame([(1, "keep this  One Two, three keep", "a", 5)], "doc_id long, text string, item_id string, n int")
    b = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    row = D.remove_spans(D.find_contamination(d, b)).first()
    assert (row.text, row.item_id, row.n) == ("keep this   keep", "a", 5)


def test_index_ranges_are_those_of_all_suffixes():
    r = np.random.default_rng(3)
    seq = r.integers(1, 4, 300)
    seq[[40, 41, 150, 299]] = 0
    index = D.FMIndex(seq, 4)
    for n in (1, 2, 5):
        pats = r.integers(1, 4, (20, n))
        low, high = index.search(pats, np.full(20, n))
        for p, a, b in zip(pats, low, high):
            want = [i for i in range(len(seq)) if list(seq[i : i + n]) == list(p)]
            assert sorted(index.locate(np.arange(a, b))) == want


def test_null_item_ids_and_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a b c", 7, "s", 1, 2)], "doc_id long, text string, N_Words int, spans string, items int, n_hit int")
    b = spark.createDataFrame([(None, "b c"), (None, "a"), (4, "c")], "item_id long, text string")
    row = D.contamination(d, b).first()
    assert (row.n_words, row.n_hit, row.n_items, row["items"], row.contaminated) == (3, 3, 2, [None, 4], True)
    assert sorted(D.contamination(d, b).columns) == ["contaminated", "doc_id", "items", "n_hit", "n_items", "n_words", "spans", "text"]


def test_fifty_megabytes_of_benchmark(spark, monkeypatch):
    """Blocks bound what the driver holds, for any benchmark."""
    import resource

    r = np.random.default_rng(6)
    words = np.array([f"w{i:x}" for i in range(300_000)])
    texts = [" ".join(words[r.integers(0, len(words), 3000)]) for _ in range(2500)]
    assert sum(map(len, texts)) > 45e6
    b = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string").repartition(8)
    pick = [(i, "x y " + " ".join(texts[i].split()[100 : 100 + 13 + i % 3]) + " z") for i in range(0, 2500, 50)]
    d = spark.createDataFrame([*pick, (-1, "nothing of it")], "doc_id long, text string").repartition(4)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = {x.doc_id: (x.n_hit, list(x["items"])) for x in D.contamination(d, b).collect()}
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 700_000  # KB: peaks of one block of 8 MB
    assert got == {i: (13 + i % 3, [i]) for i, _ in pick} | {-1: (0, [])}
