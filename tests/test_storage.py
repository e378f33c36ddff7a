"""Tables that outlive a session: write-backs by key, and archives of pages."""

import os

import pytest

from accolade.operators import present
from accolade.sources.shared import latest, publish
from accolade.sources.sink import KeyedTable

ROW = "book long, awards array<string>, changed boolean"


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_published_states(spark, tmp_path):
    folder = f"{tmp_path}/s"
    assert latest(spark, folder) == (0, {})
    publish(spark, folder, 1, {"a": 1})
    publish(spark, folder, 2, {"a": 2})
    with pytest.raises(FileExistsError):
        publish(spark, folder, 2, {"a": 3})
    assert latest(spark, folder) == (2, {"a": 2}) and not [f for f in os.listdir(folder) if "draft" in f and not f.endswith(".crc")]


def test_write_backs(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", "book", 8)
    with pytest.raises(ValueError, match="nothing"):
        table.read()
    frame = lambda rows: spark.createDataFrame(rows, ROW)
    first = table.merge(frame([(i, ["A"], True) for i in range(50)]), batch=0)
    assert first.number == 1 and len(first.buckets) == 8
    before = files(tmp_path)
    # Nothing changed: no file is written, the batch is noted.
    assert table.merge(frame([(3, ["B"], False), (4, ["B"], None)]), batch=1).buckets == [] and files(tmp_path) == before
    # One changed row rewrites its own bucket only.
    one = table.merge(frame([(3, ["A", "B"], True), (99, None, False)]), batch=2)
    assert len(one.buckets) == 1 and len({os.path.dirname(f) for f in files(tmp_path) - before}) == 1
    after = files(tmp_path)
    again = table.merge(frame([(3, ["other"], True)]), batch=2)
    assert again.repeated and files(tmp_path) == after
    assert not table.merge(frame([(60, ["C"], True)]), batch=2, writer="another").repeated
    got = {r["book"]: r["awards"] for r in table.read().collect()}
    assert got == {i: ["A"] for i in range(50)} | {3: ["A", "B"], 60: ["C"]}
    for rows, told in (([(1, ["x"], True), (1, ["x"], True)], "two rows of key 1"), ([(None, [], True)], "no key")):
        with pytest.raises(ValueError, match=told):
            table.merge(frame(rows))
    with pytest.raises(ValueError, match="fit"):
        table.merge(spark.createDataFrame([(1, "x", True)], "book long, other string, changed boolean"))
    # From the write-back's own columns, with a second session's view of the table.
    asked = spark.createDataFrame([(3, ["b", "D"]), (4, ["a"])], "book long, new array<string>").join(KeyedTable(spark, f"{tmp_path}/t", "book").read(), "book")
    done = table.merge(present.write_back(asked, "awards", "new").select("book", present.F.col("values").alias("awards"), "changed"))
    assert len(done.buckets) == 1 and {r["book"]: r["awards"] for r in table.read().where("book in (3, 4)").collect()} == {3: ["A", "B", "D"], 4: ["A"]}
