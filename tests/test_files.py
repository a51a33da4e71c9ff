"""Listings, versions and checks of real files."""

import hashlib

from gleanery.operators import files
from gleanery.sources.shared import delete, new_path


def put(spark, path, text):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def store(spark, contents):
    path = new_path(spark, "files")
    for name, text in contents.items():
        put(spark, f"{path}/{name}", text)
    return path


CONTENTS = {"b/page.html": "<p>é</p>", "b/url.txt": "http://x", "a/page.html": "z", "a/empty": "", "manifest.jsonl": "{}\n", "c/d/page.html": "1", "c/d/url.txt": "2", "_tmp": "no"}


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_listing_and_version(spark):
    path = store(spark, CONTENTS)
    got = {r.path: (r.sha256, r.bytes) for r in files.listing(spark, path).collect()}
    kept = {n: t for n, t in CONTENTS.items() if n[0] != "_" and t}
    assert got == {n: (digest(t), len(t.encode())) for n, t in kept.items()}
    some = files.listing(spark, path, ("*.jsonl", "b/*", "b/page.html", "none/*"))
    assert sorted(r.path for r in some.collect()) == ["b/page.html", "b/url.txt", "manifest.jsonl"]
    lines = "\n".join(f"{digest(t)}  {n}" for n, t in sorted(kept.items()))
    assert tuple(files.version(files.listing(spark, path)).first()) == (digest(lines)[:16], 6)
    assert files.listing(spark, path, ("none/*",)).count() == 0 and files.version(files.listing(spark, path, ("none",))).count() == 0


def test_a_file_added_changed_and_removed(spark):
    path = store(spark, CONTENTS)
    before = spark.createDataFrame(files.listing(spark, path).collect())
    put(spark, f"{path}/b/url.txt", "http://y")
    put(spark, f"{path}/b/new.txt", "n")
    delete(spark, f"{path}/a/page.html")
    got = {r.path: r.state for r in files.verify(before, files.listing(spark, path)).collect()}
    assert got == {"b/page.html": "same", "b/url.txt": "modified", "b/new.txt": "added", "a/page.html": "missing", "manifest.jsonl": "same", "c/d/page.html": "same", "c/d/url.txt": "same"}
    assert files.version(before).first().version != files.version(files.listing(spark, path)).first().version


def test_complete_folders(spark):
    found = files.listing(spark, store(spark, CONTENTS))
    assert sorted(r.folder for r in files.complete(found, ["page.html", "url.txt"]).collect()) == ["b", "c/d"]
    assert [r.folder for r in files.complete(found, ["d"]).collect()] == ["c"]
