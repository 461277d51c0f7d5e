"""Working tables: emptied once nothing reads them, and rounds of stars in two folders."""

from itertools import count
from pathlib import Path

from featherfold.llm import common
from featherfold.llm.common import Scratch
from featherfold.llm.op9_jaccard import components, jaccard_components


def test_scratch_is_emptied(spark):
    scratch = Scratch()
    made = scratch.write(spark.range(100), "numbers")
    assert made.count() == 100
    again = scratch.write(spark.range(7), "numbers", scratch.paths[0])
    assert again.count() == 7 and len(scratch.paths) == 1
    path = scratch.paths[0]
    scratch.clear(spark)
    assert spark.read.parquet(path).count() == 0 and scratch.paths == []


def test_stars_take_two_folders_however_long_the_chain(spark):
    scratch = Scratch()
    chain = spark.range(1, 200).selectExpr("id AS a", "id - 1 AS b")
    found = {(r["node"], r["component"]) for r in components(chain, scratch).collect()}
    assert found == {(k, 0) for k in range(200)} and len(scratch.paths) == 2


def test_join_leaves_what_its_result_reads(spark, monkeypatch, tmp_path):
    """The result may be read twice; tables that it doesn't read are empty by then."""
    number = count()
    monkeypatch.setattr(common, "shared_dir", lambda spark, name: str(tmp_path / f"{name}-{next(number)}"))
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(words[: 60 - k % 3])) for k in range(40)] + [(100, "a b c d e f"), (101, "")]
    found = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), block_size=8)
    want = sorted([(k, 0) for k in range(40)] + [(100, 100), (101, 101)])
    for _ in range(2):
        assert sorted((r["id"], r["component_id"]) for r in found.collect()) == want
    for name in ("prefixes", "stars", "links", "jaccard-shared", "jaccard-members", "jaccard-placed"):
        folders = list(Path(tmp_path).glob(f"{name}-*"))
        assert len(folders) >= 1 + (name == "stars") and all(spark.read.parquet(str(f)).count() == 0 for f in folders)
