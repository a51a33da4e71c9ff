"""The trie against plain dictionaries, the sharded scores against a brute-force model, and edge cases."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from gleanery.llm import lm_scoring as L
from gleanery.llm import ngram_trie as T
from pyspark.sql import functions as F


@pytest.mark.parametrize("top", [3, 100, 10**6, 2**40])
def test_elias_fano(top):
    r = np.random.default_rng(top % 97)
    v = np.sort(r.integers(0, top, 700))
    v = np.unique(v) if top > 100 else v
    ef = T.EliasFano(T.unpack(T.pack(T.EliasFano.build(v, "x."))), "x.")
    assert (ef.get(np.arange(len(v))) == v).all()
    x = np.concatenate([r.integers(0, top, 500), v[:300], [0, v[-1]]])
    at, found = ef.successor(x)
    assert (found == np.isin(x, v)).all()
    assert (v[at[found]] == x[found]).all()


def test_trie_from_a_mapped_file(tmp_path):
    r = np.random.default_rng(3)
    grams = np.unique(r.integers(0, [40, 30, 50], (900, 3)), axis=0)
    n = r.integers(1, 9, len(grams))
    with open(tmp_path / "trie", "w+b") as file:
        T.NgramTrie.write(file, *grams.T, n)
    levels = np.memmap(tmp_path / "trie", mode="r")
    trie = T.NgramTrie(T.unpack(levels))
    assert np.shares_memory(trie.three.high, levels)
    two, three = defaultdict(Counter), defaultdict(Counter)
    for (c, e, w), k in zip(grams.tolist(), n.tolist()):
        two[c][w] += k
        three[c, e][w] += k
    ask = r.integers(0, [45, 35, 55], (2000, 3))
    finished = r.integers(0, 2, len(ask)).astype(bool)
    got = trie.probability(*ask.T, np.full(len(ask), 0.01), finished)
    for (c, e, w), done, p in zip(ask.tolist(), finished, got):
        want = 0.01
        for m in ([] if done else [two.get(c)]) + [three.get((c, e))]:
            if m:
                want = max(m[w] - 0.75, 0) / sum(m.values()) + 0.75 * len(m) / sum(m.values()) * want
        assert p == pytest.approx(want, rel=0.05)


def docs():
    r = random.Random(8)
    words = ["the", "of", "a", "É", "x-y", "Cat", "dog."] + [f"w{i}" for i in range(60)]
    pick = lambda: words[min(int(r.expovariate(0.12)), len(words) - 1)]
    rows = [(i, " ".join(pick() for _ in range(r.choice([0, 1, 2, 30, 90])))) for i in range(70)]
    return [*rows, (70, None), (71, ""), (72, rows[5][1]), (72, rows[5][1]), (None, "the of zzz")]


def brute(rows):
    """One undivided trigram model over plain dictionaries."""
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows}
    split = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "").split() + [None]
    c = Counter(w for d, t in rows if not held[d] for w in split(t))
    n, v = sum(c.values()), len(c)
    two, three = defaultdict(Counter), defaultdict(Counter)
    for d, t in rows:
        s = [0, 0, *split(t)]
        for x, y, z in zip(s, s[1:], s[2:]):
            if not held[d]:
                two[y][z] += 1
                three[x, y][z] += 1
    out = []
    for d, t in rows:
        s, base, score = [0, 0, *split(t)], 0.0, 0.0
        for x, y, z in zip(s, s[1:], s[2:]):
            p = (c[z] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            for m in (two.get(y), three.get((x, y))):
                if m:
                    p = max(m[z] - 0.75, 0) / sum(m.values()) + 0.75 * len(m) / sum(m.values()) * p
            score += math.log10(p)
        out.append((d, held[d], len(s) - 2, sum(c[z] > 0 for z in s[2:]), n, base, score))
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return [tuple(r) for r in L.score_documents(df, F.crc32(F.col("doc_id").cast("string")) % 5 == 1).collect()]


@pytest.mark.parametrize("tokens", [None, 10_000, 150, 20])
def test_against_brute_force(spark, monkeypatch, tokens):
    if tokens:  # many blocks; with few tokens a shard, contexts are spread, and in the last case pairs and the texts' starts too
        monkeypatch.setattr(L, "BLOCK_BYTES", 100)
        monkeypatch.setattr(L, "SHARD_WORDS", 100)
        for k in ("PART_TOKENS", "SPREAD_TOKENS", "SETTLED_TOKENS"):
            monkeypatch.setattr(L, k, tokens)
    got, want = (sorted(x, key=lambda t: (str(t[0]), t[5])) for x in (run(spark, docs()), brute(docs())))
    assert [t[:5] for t in got] == [t[:5] for t in want]
    assert np.allclose([t[5] for t in got], [t[5] for t in want], rtol=1e-9)
    # stored values are quantised: within a fiftieth of the exact model's log probability
    assert np.allclose([t[6] for t in got], [t[6] for t in want], rtol=0.02)
    held = [t for t in got if t[1] and t[2] > 20]
    assert sum(t[6] for t in held) > sum(t[5] for t in held) * 1.3


def test_empty_tables_and_no_training_rows(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = L.score_documents(df, F.lit(True)).first()
    assert (row.train_tokens, row.n_known, row.n_tokens) == (0, 0, 3)
    assert row.score == pytest.approx(row.base_score) == pytest.approx(0.0)
