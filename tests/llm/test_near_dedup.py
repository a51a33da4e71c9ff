"""The inverted join against brute force over all pairs of sets."""

import random
import re

from gleanery.llm import near_dedup as N

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=5):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w)} - {()} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    out = []
    for i, (d, _) in enumerate(rows):
        c = least[find(i)] if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out)


def cases():
    r = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    rows, passage = [], text(60)
    for _ in range(40):
        rows.append(text(r.choice([3, 30, 120])))
    for base in [text(150), text(400), text(40)]:
        for _ in range(45):
            copy = list(base)
            for _ in range(r.randrange(0, 8)):
                at = r.randrange(len(copy))
                copy[at : at + r.choice([0, 1, 1, 3])] = text(r.choice([0, 1, 1, 2]))
            rows.append(copy[: r.choice([len(copy), len(copy), len(copy) - len(copy) // 8])])
    chain = text(200)
    for i in range(12):  # each linked to the next, ends far apart
        rows.append(list(chain))
        chain[i * 15 : i * 15 + 2] = text(2)
    rows += [text(5) + passage + text(5) for _ in range(10)]
    out = [(1000 - i, " ".join(w).upper() if i % 7 == 0 else "  ".join(w) + "\n") for i, w in enumerate(rows)]
    return [*out, (5, None), (6, ""), (7, " \t"), (8, "one two"), (9, "one TWO"), (9, "one two"), (2000, out[50][1]), (2000, out[50][1])]


def test_against_brute_force(spark):
    rows = cases()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, N.near_duplicates(df).collect())) == brute(rows)


def test_fewer_rounds_leave_the_rest_to_single_pairs(spark):
    rows = cases()[40:]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted(map(tuple, N.near_duplicates(df, rounds=1).collect())) == brute(rows)


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e F"), (4, "x"), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, N.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (3, 2, None, False), (4, 1, 4, True), (None, 0, None, True)], key=str)


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([], "doc_id long, text string, class long, part string, key int")
    assert N.near_duplicates(df).count() == 0


def test_long_lists_take_more_rounds(spark, monkeypatch):
    monkeypatch.setattr(N, "LONG_LIST", 1)
    monkeypatch.setattr(N, "MOST_ROUNDS", 4)
    rows = cases()[40:]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted(map(tuple, N.near_duplicates(df, rounds=1).collect())) == brute(rows)


def test_pairs_below_the_match_threshold_are_skipped(spark):
    keep, skip = list(range(64)), list(range(41)) + list(range(100, 123))
    sign = lambda v: [(j << 32) | x for j, x in enumerate(v)]
    signed = spark.createDataFrame([(1, sign(keep)), (1, sign(keep)), (2, sign(keep[:42] + [9] * 22)), (3, sign(skip))], "class long, posted array<long>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "p long, q long")
    assert [tuple(r) for r in N._retained(pairs, signed, 42).collect()] == [(1, 2)]
