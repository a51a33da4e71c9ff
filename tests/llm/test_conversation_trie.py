"""Burst tries against all prefixes in a dictionary, with containers so small that they burst, and edge cases."""

import hashlib
import zlib

import pytest
from gleanery.llm import conversation_trie as trie
from gleanery.llm.queries import rebuilt_conversations
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, head string, n int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA)


def sequences(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, members in nodes.items():
        below = [k for k in nodes if k[: len(node)] == node]
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(node))))
        out.append((
            min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), sum(len(k) == len(node) + 1 for k in below),
            sum(not any(len(j) == len(k) + 1 and j[: len(k)] == k for j in below) for k in below),
            sum((len(nodes[k]) - 1) * len(k[-1][1].encode()) for k in below if k), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def run(spark, rows, container=trie.CONTAINER, again=False):
    df = table(spark, rows)
    turns, named = rebuilt_conversations(df) if again else (trie.number_turns(df), df.where("conv_id is not null").select("conv_id").distinct())
    got = trie.prefix_trie(turns, named, container)
    assert got.columns == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=str)


def talk(c, *texts):
    return [(c, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]


MIXED = [r for c in range(40) for r in talk(c, *"abcdefgh"[: 1 + c % 8], *(["x" * (c % 3)] if c % 4 else []))]


@pytest.mark.parametrize("container", [1, 4, 4096])
def test_against_all_prefixes(spark, container):
    assert run(spark, MIXED, container) == brute(sequences(MIXED))


@pytest.mark.parametrize("container", [2, 4096])
def test_conversations_longer_than_a_cut(spark, container, monkeypatch):
    monkeypatch.setattr(trie, "CUT", 3)
    base = [f"t{i % 5}é" for i in range(14)]
    rows = [r for c in range(12) for r in talk(c, *base[: 4 + c], *([f"own{c % 2}"] if c % 3 else []))]
    rows += talk(90, *base[:3]) + talk(91, *base[:6]) + talk(92, *base[:6])
    assert run(spark, rows, container) == brute(sequences(rows))


def test_a_third_are_copies_and_a_long_conversation(spark):
    rows = [r for c in range(60) for r in (talk(c, "same", "same", "same") if c % 3 == 0 else talk(c, f"q{c % 7}", f"a{c}"))]
    rows += talk(100, *(f"turn {i}" for i in range(300)))
    got = run(spark, rows, 8)
    assert got == brute(sequences(rows))
    assert max(r[1] for r in got) == 300


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", None), (1, 0, "user", "b"), (1, 0, "user", "b"), (2, None, "", ""), (2, 5, "user", ""), (None, 1, "user", "lost"), (7, 3, "user", "x" * 100_000)]
    got = run(spark, rows)
    # equal turns of one conversation are ordered by a hash; here the two texts may come in either order
    either = [brute({**sequences(rows), 1: [("", ""), *order]}) for order in ([("user", ""), ("user", "b"), ("user", "b")], [("user", "b"), ("user", "b"), ("user", "")])]
    assert got in either
    assert run(spark, []) == [] == run(spark, [(None, 1, "user", "lost")])


def test_rebuilt_conversations(spark):
    rows = MIXED + talk(43, "late", "base") + talk(-7, "minus") + talk(1007, "no", "base")
    assert run(spark, rows, 4, again=True) == brute(rebuilt(sequences(rows)))
    alone = [r for c in range(1000, 1010) for r in talk(c, "only")]  # some lose their one turn and have none
    assert run(spark, alone, again=True) == brute(rebuilt(sequences(alone)))


def test_turn_ids_tell_role_and_text_apart(spark):
    rows = [(1, 0, "ab", "c"), (2, 0, "a", "bc"), (3, 0, "ab", "c")]
    assert trie.number_turns(table(spark, rows)).agg(F.count_distinct("turn_id")).first()[0] == 2
