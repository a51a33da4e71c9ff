"""Page structure line by line, on literal pages."""

import pytest
from gleanery.functions import structure


def lines(spark, html, url="https://shop.example.com/a/b?x=1", **limits):
    pages = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
    return [r.line for r in structure.structure_lines(pages, **limits).orderBy("no").collect()]


END = ["password inputs: 0", "external hosts referenced: none"]

CASES = [
    (None, END),
    ("", END),
    ("<title> A &amp;\n B </title><p>x", ["title: A & B", *END]),
    (
        "<form action='/go' METHOD=POST><input type=text name=q placeholder='Your name'><select name=s></select></form><input name=out>",
        ["form 0: method=POST action='/go' action_host=shop.example.com cross_origin=False", "form 0 field: <input type=text name=q placeholder=Your name>", "form 0 field: <select type= name=s placeholder=>", *END],
    ),
    (  # a form's number counts the form lines before it; a second form closes the first
        '<form><input type="PASSWORD"><form action="https://evil.example.net/p"><textarea name="t">',
        [
            "form 0: method=get action='' action_host=shop.example.com cross_origin=False", "form 0 field: <input type=PASSWORD name= placeholder=>",
            "form 2: method=get action='https://evil.example.net/p' action_host=evil.example.net cross_origin=True", "form 2 field: <textarea type= name=t placeholder=>",
            "password inputs: 1", "external hosts referenced: evil.example.net(1)",
        ],
    ),
    (
        "<iframe src='/f' style='Display : none'></iframe><iframe width=1></iframe><iframe hidden src=\"it's\"></iframe><iframe width=10>",
        ["iframe src='/f' hidden=True", "iframe src='' hidden=True", "iframe src=\"it's\" hidden=True", "iframe src='' hidden=False", *END],
    ),
    ('<META content="0; URL=/x" HTTP-EQUIV=Refresh><meta name=refresh>', ["meta refresh content='0; URL=/x'", *END]),
    ("<script src=/s.js></script><script>var a = \"<form><iframe src='https://no.example.org/'>\";</script><!-- <iframe> -->", ["script src=/s.js", *END]),
    (  # by count, then as first seen; not by alphabet, and not what leads nowhere
        "<a href=//z.net/1>1</a><a href='http://b.net'>2</a><a href=//z.net:8080/2>3</a><img src=https://a.net/i><a href=#x><a href='mailto:me@c.net'><a href=/own><a href=javascript:void(0)><a href='tel:1'>",
        ["password inputs: 0", "external hosts referenced: z.net(2), b.net(1), a.net(1)"],
    ),
    ('<a data-href="//not.net/" href="//yes.net/?a>b">x</a><a href="//no.net" href="//last.net">', ["password inputs: 0", "external hosts referenced: yes.net(1), last.net(1)"]),
]


@pytest.mark.parametrize("html,want", CASES)
def test_lines(spark, html, want):
    assert lines(spark, html) == want


def test_ten_hosts_and_limits(spark):
    html = "".join(f"<a href=//h{i:02d}.net/>x</a>" * (13 - i if i < 12 else 1) for i in range(13))
    assert lines(spark, html)[-1] == "external hosts referenced: " + ", ".join(f"h{i:02d}.net({13 - i})" for i in range(10))
    many = "<script src=/a.js></script>" * 50
    assert lines(spark, many) == ["script src=/a.js"] * 40 and len(lines(spark, many, most=80)) == 52
    assert lines(spark, f"<title>{'t' * 300}</title>")[0] == "title: " + "t" * 192 + "…"
