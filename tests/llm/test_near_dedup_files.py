"""What near-duplicate detection writes on the way goes once nothing reads it."""

import os

from gleanery.llm import near_dedup
from gleanery.sources.shared import shared_dir


def test_tables_go_when_nothing_reads_them(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(i, i, " ".join(words[i % 7 :][:60] + [f"x{i % 3}"])) for i in range(60)]
    folder = shared_dir(spark).removeprefix("file://") + "/gleanery"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, _row long, text string"), row="_row")
    kinds = [x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before]
    assert not {"signed", "entries", "compared"} & set(kinds) and kinds.count("sets") == 1 and kinds.count("lists") == 1
    assert sorted(r.doc_id for r in out.collect()) == list(range(60))
