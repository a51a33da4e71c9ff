"""Labels, unbalanced markup, long pages, and templates by count against brute force."""

import random
import time
from collections import Counter, defaultdict

import pytest
from gleanery.llm import html_text as H

PAGES = [
    ('<article><div class="related-work">main text</div></article>', "main text"),
    ('<article><div class="post-header"><h1>T</h1></div><p>b</p></article>', "T\n\nb"),
    ('<article><div class="header"><h1>T</h1></div><p>b</p></article>', "T\n\nb"),
    ('<article><p>a</p><div class="related-posts">r</div><div class="social share-buttons">s</div></article>', "a"),
    ('<div class="sidebar"><article>teaser</article></div><article><h1>T</h1>main</article>', "T\n\nmain"),
    ('<div class="widget"><article>main</article></div>', "main"),
    ('<main><div class="widget"><article>main</article></div></main>', "main"),
    ('<div class="comments"><article class="comment">c</article></div><article>a</article>', "a"),
    ('<p title="x>hello</p>', "hello"),
    ('<p title="x>hello</p><a href="/y">link</a> end', "link end"),
    ("<p a='<b>\">'>t", "t"),
    ("<!-->a<!--->b<!-- c -- > d", "ab"),
    ("a</>b</ x>c<?php d?>e", "abce"),
    ("x <y", "x"),
    ("<script>1</script x>y</script", "y"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_text(page, text):
    assert H.extract(page) == text


@pytest.mark.parametrize("piece", ['<p a="', "<p a='\"", "</script", "<p ", "<", "<!", "</x>", "<div>", "<i>", "<div class=ad>", "<p a = ", "<a b='<p>"])
@pytest.mark.parametrize("end", ["", "'>", '">'])
def test_any_markup_takes_linear_time(piece, end):
    def seconds(n):
        page, began = "<div>" * (n // 50) + piece * (n // len(piece)) + end, time.process_time()
        H.extract(page, {1})
        return time.process_time() - began

    seconds(10_000)
    assert seconds(400_000) < 12 * seconds(100_000) + 0.5  # quadratic time would be minutes


def brute_key(node):
    """A subtree as nested tuples."""
    return (node.tag, *(() if node.chrome else (brute_key(p) if isinstance(p, H.Node) else H.clean(p) for p in node.parts)))


def brute(rows, least):
    """Templates by counting whole subtrees of each host in dictionaries, and the text left without them."""
    counts, hosts = defaultdict(Counter), Counter()

    def candidates(node, out):
        if node.parts and node.tag not in ("#", "html", "body") and not node.chrome and not (node.prose and node.tag in H.PROSE):
            out.add(brute_key(node))
        for p in () if node.chrome else node.parts:
            if isinstance(p, H.Node):
                candidates(p, out)
        return out

    for _, url, page in rows:
        host = url.split("://")[1].split("/")[0]
        hosts[host] += 1
        counts[host].update(candidates(H.parse(page), set()))
    found = {h: {k for k, n in c.items() if n >= least and n * n >= hosts[h]} for h, c in counts.items()}

    def text(node, gone, out, held):
        for p in node.parts:
            if isinstance(p, str):
                held.append(p)
            elif p.tag[0] != "#":
                flush(out, held)
                if not p.chrome and brute_key(p) not in gone:
                    text(p, gone, out, held)
                    flush(out, held)
        return out

    def flush(out, held):
        if block := H.clean("".join(held)):
            out.append(block)
        held.clear()

    got = {}
    for i, url, page in rows:
        out = []
        for n in H.main_nodes(H.parse(page)):
            held = []
            text(n, found[url.split("://")[1].split("/")[0]], out, held)
            flush(out, held)
        got[i] = "\n\n".join(out)
    return found, got


def site(r, n, pages):
    """A host whose menus carry no telling class, on all, most or few of its pages."""
    parts = [f"<div><a>{n} home</a><a>{n} about</a></div>", f"<ul><li>{n} contact<li>{n} imprint</ul>", f"<section><p>{n} box</p><div>deep</div></section>"]
    for _ in range(pages):
        body = "".join(f"<p>{r.random()}</p><div>{r.choice('abc')}{r.random()}</div>" for _ in range(r.randint(0, 3)))
        wrap = r.choice(["<main>{}</main>", "<article>{}</article>", "{}", "<div>{}</div>"])
        yield "".join(p for p in parts if r.random() < 0.7) + wrap.format(body + r.choice(["", parts[2], "<p>syndicated</p>"])) + r.choice(["", parts[0]])


def test_templates_and_text_against_brute_force(spark):
    r, rows = random.Random(5), []
    for n, pages in enumerate([3, 12, 40, 160]):
        rows += [(len(rows) + i, f"https://s{n}.org/{i}", p) for i, p in enumerate(site(r, n, pages))]
    found, want = brute(rows, 10)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    keys = Counter(t.host for t in H.site_templates(df).collect())
    assert keys == Counter({h: len(k) for h, k in found.items() if k}) and len(keys) == 3
    got = {x.page_id: x.text for x in H.extract_main_text(df).collect()}
    assert got == want
    assert sum("about" in t for t in got.values()) < 4 and any("syndicated" in t for t in got.values())


@pytest.mark.parametrize("joined", [False, True])
def test_clashing_columns_and_repeated_rows(spark, monkeypatch, joined):
    if joined:
        monkeypatch.setattr(H, "BROADCAST_TEMPLATES", 0)
    rows = [(1, "http://a.com/", "<p>x", 7, "h", 5)] * 3 + [(None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, TEXT int, _host string, _keys int")
    got = H.extract_main_text(df)
    assert got.columns == ["page_id", "url", "html", "_host", "_keys", "text"]
    assert sorted(r.text for r in got.collect()) == ["", "x", "x", "x"]


def test_a_page_of_five_megabytes():
    page = "<body><article><h1>T</h1>" + "<p>text <b>bold</b></p>" * 200_000 + "</article></body>"
    text = H.extract(page)
    assert len(page) > 4.5e6 and text.count("text bold") == 200_000
