"""Transactions plan each step by itself: what they stage is a scan, what they check is read once."""

import pytest
from pyspark.sql import functions as F

from quern.operators import views, writes
from quern.operators.spread import numbered
from quern.plans.declare import read_schema

from .test_writes import CATALOG, POST, logs, rows

#: Folders in a tree; a file goes with its folder, and forgets its backup.
TREE = read_schema("""
Folder { id: i64
  parent: ?Folder @on_delete(cascade) }
File { id: i64
  folder: *Folder @on_delete(cascade)
  backup: ?Folder @on_delete(set_null) }
""")
LOG = "_seq long, _deleted boolean, "
FOLDER, FILE = LOG + "id long, parent long", LOG + "id long, folder long, backup long"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def tree(spark):
    return {
        "Folder": spark.createDataFrame([(0, False, 1, None), (1, False, 2, 1), (2, False, 3, 2), (3, False, 4, 1), (4, False, 5, None), (5, False, 4, 5)], FOLDER),
        "File": spark.createDataFrame([(0, False, 10, 1, 5), (1, False, 11, 3, None), (2, False, 12, 4, 3), (3, False, 13, 5, 2), (4, False, 14, 2, 2), (5, False, 14, 5, None), (6, False, None, 3, 1)], FILE),
    }


def test_staged_versions_are_scans(spark):
    """Neither the levels above nor the numbering is planned again by what reads the staged versions."""
    t = writes.Transaction(TREE, tree(spark))
    t.delete("Folder", spark.createDataFrame([(1,)], "id long"))
    for versions in t.added.values():
        assert not [x for x in ("Join", "Window", "Aggregate", "Sort") if x in plan(versions)]
    assert rows(t.live("Folder"), "id", "parent") == [(4, 5), (5, None)]
    assert rows(t.live("File"), "id", "folder", "backup") == [(12, 4, None), (13, 5, None), (14, 5, None)]
    assert rows(t.added["File"].filter("_deleted"), "id") == [(10,), (11,)]
    for model, versions in t.added.items():
        start = views.length(t.logs[model])
        assert rows(versions, "_seq") == [(start + k,) for k in range(versions.count())]


def test_delete_of_nothing_and_again(spark):
    t = writes.Transaction(TREE, tree(spark))
    t.delete("Folder", spark.createDataFrame([(99,)], "id long"))
    t.delete("Folder", spark.createDataFrame([(5,), (5,), (None,)], "id long"))
    t.delete("Folder", spark.createDataFrame([(5,)], "id long"))
    t.validate()
    assert rows(t.live("Folder"), "id") == [(1,), (2,), (3,)]
    assert rows(t.live("File"), "id", "backup") == [(10, None), (11, None)]


@pytest.mark.parametrize("n", [0, 1, 3, 5000])
def test_numbers_without_a_second_shuffle(spark, n):
    out = numbered(spark.range(n).select((F.col("id") % 7).alias("a"), F.col("id").alias("b")), ["a", "b"], 40)
    assert "Window" not in plan(out) and "Join" not in plan(out)
    assert [tuple(r) for r in out.orderBy("_seq").collect()] == [(a, b, 40 + k) for k, (a, b) in enumerate(sorted((b % 7, b) for b in range(n)))]


def test_checks_read_staged_rows_alone(spark):
    """Staged versions come after the log's: the log behind them isn't read to find the rows to check."""
    old = logs(spark)
    t = writes.Transaction(CATALOG, old | {"Post": old["Post"].withColumn("editor", F.raise_error(F.lit("read")).cast("long"))})
    t.insert("Post", spark.createDataFrame([(13, 1, None)], "id long, author long, editor long"))
    t.validate()


def test_checks_of_ids_staged_twice(spark):
    post = "id long, author long, editor long"
    t = writes.Transaction(CATALOG, logs(spark))
    t.insert("Post", spark.createDataFrame([(13, 99, None), (14, 99, None)], post))
    t.update("Post", spark.createDataFrame([(13, 1, None)], post))
    t.delete("Post", spark.createDataFrame([(14,)], "id long"))
    t.validate()
    for versions, kind in (([(3, False, 13, 1, None), (3, False, 13, 1, None)], "unique"), ([(3, True, 10, 1, 2), (3, True, 10, 1, 2)], "conflict"), ([(3, False, 13, 99, None), (4, False, 14, 1, None)], "foreign_key"), ([(3, False, 13, None, None)], "constraint")):
        with pytest.raises(writes.Refused) as e:
            writes.Transaction(CATALOG, logs(spark), {"Post": spark.createDataFrame(versions, POST)}).validate()
        assert e.value.args[0] == kind
    writes.Transaction(CATALOG, logs(spark), {"Post": spark.createDataFrame([(3, True, 10, 99, 2)], POST)}).validate()
