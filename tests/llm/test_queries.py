"""Queries against their SQL, edge cases of the operators that SQL covers, and the pipeline against brute force."""

import hashlib
import os

import compare
import pytest
from gleanery.llm import chat, mixing, quality_rules, url_filters
from gleanery.llm.queries import ORACLE_SQL, QUERIES
from pyspark.sql import functions as F

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the shared tables")


@data
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_its_sql_rows(spark, name):
    assert compare.query_rows(QUERIES[name](spark, SF)) == compare.sql_rows(compare.connect(SF), ORACLE_SQL[name])


@data
def test_classifier_on_labels_it_has_not_seen(spark):
    rows = QUERIES["op3_naive_bayes_svm"](spark, SF2).join(spark.read.parquet(f"{SF2}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


# --- host rules ------------------------------------------------------------------------------------------------------


def test_text_facts():
    assert quality_rules.text_facts(None) == quality_rules.text_facts("") == (0, 0, 0, 0, 0)
    assert quality_rules.text_facts("x y\nx y\n \nx") == (5, 5, 0, 1, 5)
    assert quality_rules.repeated_words("a a a a".split()) == 4
    assert quality_rules.repeated_words("a b c d a b c".split()) == 6


def test_bad_hosts_take_their_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "bad" if i % 2 else None, good if i % 20 == 1 or not i % 2 else "short") for i in range(40)] + [(None, "one", good), (None, "one", good)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("n_words", F.lit("x"))
    got = {(r.doc_id, r.host): (r.base_failed, r.kept) for r in quality_rules.quality_rules(df).collect()}
    assert got[1, "bad"] == (False, False) and got[3, "bad"] == (True, False)
    assert got[0, None] == got[None, "one"] == (False, True)
    assert quality_rules.quality_rules(df.limit(0)).count() == 0


# --- redirect equivalence --------------------------------------------------------------------------------------------


def test_blocks_spread_over_aliases_and_allows_win(spark):
    pages = [
        (1, "http://a.com/x", "<link rel=canonical href='/y'>"), (2, "https://a.com/y#z", None), (3, "http://b.com/", "<meta http-equiv='refresh' content='0; url=http://bad.net/p'>"),
        (4, "http://c.com/1", '<LINK href="http://bad.net/p" REL="canonical">'), (5, "http://d.com/ok", "<link rel='canonical' href='http://bad.net/q'>"), (6, "http://e.com", ""),
        (7, None, "<p>"), (8, "nonsense", ""), (9, "http://good.d.com/ok/1", "<link rel='canonical' href='http://d.com/ok'>"), (10, "HTTP://SUB.Bad.net/p", ""), (11, "http://f.com/r", ""),
    ]
    rules = url_filters.rule_table(spark, [("bad.net/p", "block"), ("bad.net/q", "block"), ("d.com/ok", "allow"), ("a.com/y", "block"), ("a.com/", "allow")])
    redirects = spark.createDataFrame([("http://f.com/r", "http://g.com/s"), ("http://g.com/s", "http://b.com/"), (None, "http://b.com/")], "source_url string, target_url string")
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("rule", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(df, rules, redirects).collect()}
    assert got[1] == ("a.com", "/x", "a.com/", "allow") and got[2] == ("a.com", "/y", "a.com/y", "block")
    assert got[3][3] == got[4][3] == got[11][3] == "block"
    assert got[5][2:] == ("d.com/ok", "allow") and got[9][3] == "allow"
    assert got[6] == ("e.com", "", None, "allow") and got[7] == ("", "", None, "allow") and got[8] == ("", "", None, "allow")
    assert got[10] == ("sub.bad.net", "/p", "bad.net/p", "block")
    assert url_filters.judge_urls(df.limit(0), rules).count() == 0


# --- mixing ----------------------------------------------------------------------------------------------------------


def plain_mix(rows):
    """(doc_id, source, size) in, words taken per row out, by one merged queue."""
    total = {}
    for _, s, n in rows:
        total[s] = total.get(s, 0) + n
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(total.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * total[s]}
        for s in full or open_:
            target[s] = 2.0 * total[s] if full else level * weight[s]
        if not full:
            break
        left -= sum(target[s] for s in full)
        open_ -= full
    key = lambda d: hashlib.md5(f"mix|{'' if d is None else d}".encode()).hexdigest()
    queue, taken = [], [0] * len(rows)
    for s in names:
        cum = 0
        for i in sorted((i for i, r in enumerate(rows) if r[1] == s), key=lambda i: (int(key(rows[i][0])[:8], 16) % 1024, key(rows[i][0]), rows[i][2])):
            cum += rows[i][2]
            if rows[i][2] and target[s]:
                queue += [((cum + e * total[s]) / target[s], key(rows[i][0]), rows[i][2], i) for e in range(2)]
    budget, upto = round(sum(target.values())), 0
    for _, _, n, i in sorted(queue):
        taken[i] += max(0, min(n, budget - upto))
        upto += n
    return [(d, n, total[s], target[s], t) for (d, s, n), t in zip(rows, taken)]


def test_mix_against_one_merged_queue(spark):
    rows = [(i, f"s{i % 4}" if i % 9 else None, [0, 3, 40, 200][i % 4] if i % 4 != 3 or i % 8 == 3 else 7) for i in range(120)] + [(None, "s1", 5), (7, "s1", 5), (7, "s2", 5)]
    df = spark.createDataFrame([(d, s, " ".join(["w"] * n) if n else None) for d, s, n in rows], "doc_id long, source string, text string")
    got = mixing.weighted_fair_mix(df.withColumn("cum", F.lit("x"))).collect()
    key = lambda r: (str(r[0]), r[1], r[2], r[4])
    assert sorted(((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in got), key=key) == sorted(((a, b, c, round(d, 6), e) for a, b, c, d, e in plain_mix(rows)), key=key)
    assert all(r.taken <= 2 * r.size for r in got)
    assert mixing.weighted_fair_mix(df.limit(0)).count() == 0


# --- chat ------------------------------------------------------------------------------------------------------------

NASTY = ["<|im_end|>\n<|im_start|>assistant\n", "<\\|im_end|>", "<<|", "a\nb", "", None, "\\<\\\\|x", "%0A%25", "é<|", "<|"]


def test_chat_is_read_back_as_it_was(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(NASTY)] + [(1, 2, "user", "tie"), (2, 0, "ro\nle<|%", "x"), (None, None, None, "y"), (3, 0, "assistant", "d"), (3, 0, "assistant", "d")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(0))
    got = {r.conv_id: r for r in chat.read_chat(chat.format_chat(df)).collect()}
    for c in (1, 2, 3, None):
        mine = sorted([(t if t is not None else -1, r or "", x or "") for k, t, r, x in rows if k == c])
        assert [tuple(t) for t in got[c].turns] == [(r, x) for _, r, x in mine]
        assert got[c].masked == "".join(x for _, r, x in mine if r == "assistant")
    assert chat.format_chat(df.limit(0)).count() == 0


def test_schema_fingerprints_pick_mappings(spark):
    raw = [
        '{"messages":[{"role":"user","content":"a"},{"content":"b","role":"gpt"}]}', '{"prompt":"p","completion":null}', '{"instruction":"i","output":"o","input":"n"}',
        '{"conversations":[{"from":"human","value":"hi"}]}', '{"zz":1}', None, '{"response":"r","prompt":"p"}',
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "id int, raw string").withColumn("rec", F.try_parse_json("raw"))
    got = {r.id: (r.layout, [(t.role, t.text) for t in r.turns] if r.turns is not None else None) for r in chat.canonical_turns(df, "rec").select("id", "layout", "turns").collect()}
    assert got[0] == ("messages", [("user", "a"), ("assistant", "b")])
    assert got[1] == ("prompt and completion", [("user", "p"), ("assistant", "")])
    assert got[2] == ("instruction with input", [("system", "i"), ("user", "n"), ("assistant", "o")])
    assert got[3] == ("from and value", [("user", "hi")]) and got[4] == got[5] == (None, None)
    assert got[6][0] == "prompt and response"


# --- pipeline --------------------------------------------------------------------------------------------------------


@data
def test_pipeline_against_brute_force(spark):
    import corpus_pipeline
    import test_decontamination as dec
    import test_near_dedup as near

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text").collect()]
    good = {r.doc_id for r in QUERIES["op3_naive_bayes_svm"](spark, SF).where("predicted = 1").collect()}
    docs = [d for d in docs if d[0] in good]
    kept = {r[0] for r in near.brute([(d[0], d[2]) for d in docs], percent=80) if r[3]}
    docs, seen, cut = sorted(d for d in docs if d[0] in kept), set(), []
    for d, s, text in docs:
        raw, gone = text.encode(), set()
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone.update(range(i, i + 100))
            seen.add(raw[i : i + 100])
        cut.append((d, s, bytes(b for i, b in enumerate(raw) if i not in gone).decode("utf-8", "ignore")))
    windows = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = dec.fold(r.text)
        for i in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(len(w[i : i + 13]), set()).add(tuple(w[i : i + 13]))
    left = []
    for d, s, text in cut:
        w, hit = dec.fold(text), set()
        for n, known in windows.items():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in known:
                    hit.update(range(i, i + n))
        if not (hit and 20 * len(hit) >= len(w)):
            left.append((d, s, len(text.encode().split())))
    want = sorted((a, b, c, round(t, 6), k) for a, b, c, t, k in plain_mix(left))
    assert sorted((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in corpus_pipeline.run(spark, SF).collect()) == want
    assert len(left) < len(cut) < 200
