"""Names in prominent text: marks, capitals, several words, the strict look-up, and links to a name's domains."""

import random
import re

from gleanery.operators import brands

MAP = [("AT&T", ["att.com"]), ("ING", ["ing.com"]), ("box", ["box.com"]), ("Facebook", ["facebook.com"]), ("home", ["home.example.com"]), ("Wells Fargo", ["wellsfargo.com", "wf.com"]), ("Société Générale", ["sg.fr"]), ("微软", ["microsoft.cn"]), ("!!", ["no.com"])]
PHISH = [("title", "AT&T - Login"), ("h1", "Welcome to at&t"), ("placeholder", "User ID")]


def look(spark, places, own="example.com", password=True, links=(), names=MAP, strict=False):
    texts = spark.createDataFrame([(1, p, t) for p, t in places], "page_id long, place string, text string")
    pages = spark.createDataFrame([(1, own, password)], "page_id long, own string, password boolean")
    to = spark.createDataFrame([(1, t) for t in links], "page_id long, to string")
    got = brands.lookup(texts, "page_id", spark.createDataFrame(names, "brand string, domains array<string>"), pages, to, strict)
    return [(r.brand, r.places, r.is_own, r.to_brand, r.anchors) for r in got.orderBy("place_no").collect()]


def test_a_name_with_a_mark_on_and_off_its_domain(spark):
    assert look(spark, PHISH, links=["att.com", None]) == [("AT&T", ["h1", "title"], False, 1, 2)]
    assert look(spark, PHISH, own="att.com") == [("AT&T", ["h1", "title"], True, 0, 0)]


def test_short_names_only_as_acronyms_in_capitals(spark):
    assert look(spark, [("title", "a box of tools"), ("h1", "Box"), ("h2", "ing")]) == []
    assert look(spark, [("title", "ING login"), ("h1", "PARKING")]) == [("ING", ["title"], False, 0, 0)]


def test_several_words_other_scripts_and_borders(spark):
    said = [("title", "At WELLS FARGO."), ("h1", "wells  fargo"), ("h2", "Wells-Fargo"), ("h3", "xwells fargo"), ("alt", "Chez Société Générale!"), ("button", "登录微软帐户")]
    assert look(spark, said) == [("Société Générale", ["alt"], False, 0, 0), ("Wells Fargo", ["title"], False, 0, 0)]  # two signs are shorter than four
    assert look(spark, said, names=[("微软公司部", ["m.cn"]), ("登录微软", ["m.cn"])]) == [("登录微软", ["button"], False, 0, 0)]
    assert look(spark, [("h1", "!! \\E (AT&T)")]) == [("AT&T", ["h1"], False, 0, 0)] and look(spark, []) == []


def test_three_names_by_places_then_by_name(spark):
    names = [(n, [f"{n}.com"]) for n in ("delta", "gamma", "beta1", "alpha")]
    said = [("title", "alpha beta1 gamma delta"), ("h1", "gamma"), ("h2", "delta, gamma"), ("alt", "gamma")]
    assert [(b, len(p)) for b, p, *_ in look(spark, said, names=names)] == [("gamma", 4), ("delta", 2), ("alpha", 1)]


def test_strict_look_up(spark):
    assert look(spark, [("title", "AT&T")], password=False, strict=True) == []
    assert look(spark, [("title", "AT&T"), ("h1", "at&t"), ("alt", "AT&T")], strict=True) == [("AT&T", ["title"], False, 0, 0)]
    assert look(spark, [("title", "home"), ("alt", "Facebook")], strict=True) == []
    assert look(spark, [("title", "home")]) == [("home", ["title"], False, 0, 0)]


def test_against_a_pattern_for_each_name(spark):
    rng = random.Random(3)
    words = ["one", "Two", "THREE", "at&t", "x", "AT", "T", "one-two", "two three", "&", "é"]
    names = [(" ".join(rng.sample(words, rng.randint(1, 3))), ["a.com"]) for _ in range(40)]
    names = [(n, d) for n, d in dict(names).items()] if isinstance(names, dict) else list({n: (n, d) for n, d in names}.values())
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(60)]
    df = spark.createDataFrame([(i, "title", t) for i, t in enumerate(texts)], "page_id long, place string, text string")
    got = {(r.page_id, r.brand) for r in brands.mentions(df, "page_id", spark.createDataFrame(names, "brand string, domains array<string>")).collect()}
    want = set()
    for n, _ in names:
        if len(n) < 4 and not (n.isupper() and n.isalpha()):
            continue
        rx = re.compile(r"(?<![A-Za-z0-9])" + re.escape(n) + r"(?![A-Za-z0-9])", 0 if len(n) < 4 else re.I)
        want |= {(i, n) for i, t in enumerate(texts) if rx.search(t)}
    assert got == want and len(want) > 50
