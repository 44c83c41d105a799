from decimal import Decimal

import pytest

from quern.functions.predicates import loose, parse
from quern.operators import views
from quern.operators.access import Page, Table, descending, page_of
from quern.plans.catalog import SchemaError
from quern.plans.declare import read_schema

CATALOG = read_schema("""
enum Status { Draft, Published, Archived }
Post {
  id: u64
  title: &string
  views: ^u32
  rating: f64?
  status: ^Status?
  code: char(4)
  price: ^decimal
  note: ^string?
  @projection(card: title, views)
}
""")
SCHEMA = "_seq long, _deleted boolean, id decimal(20,0), title string, views long, rating double, status string, code string, price decimal(38,9), note string"
ROWS = [
    (0, False, 1, "a", 30, 1.0, "Archived", "ab", "1.00", None),
    (1, False, 2, "b", 10, None, "Draft", "abcd", "1.5", "null"),
    (2, False, 3, "c", 50, 3.0, "Published", "", "1", ""),
    (3, False, 4, "d", 20, float("nan"), None, "x", "2", "n"),
    (4, False, 1, "a2", 40, 1.0, "Archived", "ab", "1.00", None),
    (5, True, 2, "b", 10, None, "Draft", "abcd", "1.5", "null"),
    (6, False, 18446744073709551615, "e", 40, -0.0, "Draft", "x", "9", "z"),
]


@pytest.fixture(scope="module")
def post(spark):
    rows = [(a, b, Decimal(c), *r[:5], Decimal(r[5]), r[6]) for a, b, c, *r in ROWS]
    return Table(CATALOG, "Post", spark.createDataFrame(rows, SCHEMA).cache())


def ids(df):
    return [int(r.id) for r in df.collect()]


@pytest.mark.parametrize(
    "kind, text, value",
    [("u32", "12", 12), ("u32", " 12 ", None), ("u32", "-1", None), ("u32", "4294967296", None), ("i32", "+5", 5), ("f64", "3", 3.0), ("f64", "1e300", 1e300), ("f64", "x", None), ("bool", "true", True), ("bool", "yes", None),
     ("decimal", "1.00", Decimal("1.00")), ("decimal", "1.", None), ("uuid", "{6BA7B810-9DAD-11D1-80B4-00C04FD430C8}", "6ba7b810-9dad-11d1-80b4-00c04fd430c8"), ("uuid", "zz", None), ("u64", "18446744073709551615", 2**64 - 1)],
)
def test_parse(kind, text, value):
    assert parse(kind, text) == value


def test_loose():
    assert loose({"a": "12", "b": "01234", "c": "true", "d": "1e5", "e": "inf", "limit": "3", "f": "1.5"}) == {"a": 12.0, "b": "01234", "c": True, "d": "1e5", "e": "inf", "f": 1.5}


def test_live_and_snapshots(post):
    assert sorted(ids(post.all())) == [1, 3, 4, 18446744073709551615]
    assert sorted(ids(post.at(4).all())) == [1, 2, 3, 4]
    assert [r.title for r in post.at(4).get(Decimal(1)).collect()] == ["a"]
    assert [r.title for r in post.get(Decimal(1)).collect()] == ["a2"]
    assert views.read_at(post.log, 5).count() == 0 and views.read_at(post.log, 0).count() == 1
    assert post.physical_rows().first()[0] == 7 and post.live_rows().first()[0] == 4


@pytest.mark.parametrize(
    "params, want",
    [({"rating": "3"}, [3]), ({"rating": "NaN"}, []), ({"rating": "0"}, [18446744073709551615]), ({"code": "x"}, [4, 18446744073709551615]), ({"code": "abcde"}, []), ({"status": "Nope"}, []), ({"status": "Draft"}, [18446744073709551615]),
     ({"price": "1.0"}, [1, 3]), ({"views": "40", "status": "Archived"}, [1]), ({"unknown": "1", "views": "50"}, [3]), ({"id": "18446744073709551615"}, [18446744073709551615]), ({}, [1, 3, 4, 18446744073709551615])],
)
def test_filters(post, params, want):
    assert sorted(ids(post.filtered(params))) == want


def test_sorts(post):
    assert ids(post.list({"sort": "views", "order": "desc"})) == [3, 18446744073709551615, 1, 4]
    assert ids(post.list({"sort": "views"})) == [4, 1, 18446744073709551615, 3]
    assert ids(post.list({"sort": "status"})) == [4, 18446744073709551615, 3, 1]
    assert ids(post.list({"sort": "nope"})) == [3, 4, 1, 18446744073709551615]
    assert ids(post.list({"sort": "views", "limit": "2", "offset": "1"})) == [1, 18446744073709551615]


def test_envelope_and_projection(post):
    page = post.envelope({"sort": "views", "limit": "1"}, "card")
    assert page == {"data": [{"id": Decimal(4), "title": "d", "views": 20}], "total": 4, "limit": 1, "offset": 0}
    with pytest.raises(SchemaError):
        post.project("nope")


def test_pages():
    assert page_of({}) == Page(50, 0)
    assert page_of({"limit": "0", "offset": "-3"}) == Page(1, 0)
    assert page_of({"limit": "9999", "offset": "7"}) == Page(1000, 7)
    assert page_of({"limit": "x"}) == Page(50, 0)
    assert Page(10, 5).has_next(16) and not Page(10, 5).has_next(15)
    assert Page(10, 5).next_page() == Page(10, 15) and Page(10, 5).prev_page() == Page(10, 0)
    assert descending({"order": "DESC"}) and descending({"order": "Descending"}) and not descending({"order": "down"})


def test_probes(post):
    assert sorted(ids(post.find_by(note=None))) == [1]
    assert ids(post.find_by(note="")) == [3]
    assert ids(post.get_by(title="d")) == [4]
    assert ids(post.at(4).find_by(note="null")) == [2]
    with pytest.raises(SchemaError):
        post.find_by(rating=1.0)
    with pytest.raises(SchemaError):
        post.get_by(views=1)


def test_ranges(post):
    assert ids(post.range("views", descending=True)) == [3, 1, 18446744073709551615, 4]
    assert ids(post.range("views", 20, 40)) == [4, 1, 18446744073709551615]
    assert ids(post.range("views", 50, 20)) == []
    assert ids(post.range("views", limit=2, descending=True)) == [3, 1]
    with pytest.raises(SchemaError):
        post.range("note")


def test_statistics_and_compaction(post):
    s = views.statistics(post.log, ["id"]).first()
    assert (s.total_rows, s.active_rows, s.dead_rows, s.needs_compaction) == (7, 4, 3, True)
    assert [views.compaction_due(n) for n in (999, 1000, 4000)] == ["none", "deferred", "now"]
    rows = views.compact(post.log, ["id"]).orderBy("_seq").collect()
    assert [(r["_seq"], int(r.id)) for r in rows] == [(0, 3), (1, 4), (2, 1), (3, 18446744073709551615)]


@pytest.fixture(scope="module")
def stored(spark, post, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("logs") / "log")
    post.log.write.parquet(folder)
    return Table(CATALOG, "Post", spark.read.parquet(folder))


def scans(df):
    """The columns that each scan of a query reads, and the nodes of its plan."""
    plan = df._jdf.queryExecution().sparkPlan()
    read, names, todo = [], [], [plan]
    while todo:
        node = todo.pop()
        names.append(node.nodeName())
        if node.nodeName().startswith("Scan parquet"):
            read.append((set(node.requiredSchema().fieldNames()), node.dataFilters().mkString(" | ")))
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return read, names


SYSTEM = {"id", "_seq", "_deleted"}


@pytest.mark.parametrize(
    "ask, columns",
    [
        (lambda t: t.live_rows(), SYSTEM), (lambda t: t.all().select("id"), SYSTEM), (lambda t: t.project("card"), SYSTEM | {"title", "views"}), (lambda t: t.scan(["views"]), SYSTEM | {"views"}),
        (lambda t: t.scan(["views"], {"status": "Draft"}), SYSTEM | {"views", "status"}), (lambda t: t.total({"status": "Draft"}), SYSTEM | {"status"}), (lambda t: t.total({}), SYSTEM),
        (lambda t: t.find_by(status="Draft").select("id"), SYSTEM | {"status"}), (lambda t: t.get(Decimal(1)).select("title"), SYSTEM | {"title"}), (lambda t: t.export_column("views"), SYSTEM | {"views"}),
        (lambda t: t.range("views", 20, 40).select("id", "views"), SYSTEM | {"views"}), (lambda t: views.statistics(t.log, ["id"]), SYSTEM),
    ],
)
def test_reads_are_narrow(stored, ask, columns):
    """No scan reads more than id, _seq, _deleted and what was asked for; what aggregates does so by hashes."""
    for table in (stored, stored.at(4)):
        read, names = scans(ask(table))
        assert read and set.union(*(c for c, _ in read)) <= columns
        assert "SortAggregate" not in names and "HashAggregate" in names


def test_point_read_is_pushed_down(stored):
    read, _ = scans(stored.at(4).get(Decimal(1)).select("title"))
    assert len(read) == 2 and all("id" in f and "_seq" in f and " 4" in f for _, f in read)
    wide = [c for c, f in scans(stored.find_by(status="Draft"))[0] if "Draft" in f]
    assert len(wide) == 1 and "note" in wide[0]


def test_export_column(post):
    assert [r.views for r in post.export_column("views").collect()] == [50, 20, 40, 40]
    for name in ("note", "title", "status", "rating"):
        with pytest.raises(SchemaError):
            post.export_column(name)


def test_page_knobs(post):
    table = Table(CATALOG, "Post", post.log, default_limit=2, max_limit=3)
    assert ids(table.list({"sort": "views"})) == [4, 1] and len(ids(table.list({"limit": "50"}))) == 3 and table.envelope({})["limit"] == 2


def test_get_by_at_a_snapshot(post):
    assert ids(post.at(4).get_by(title="b")) == [2] and ids(post.get_by(title="b")) == [] and [r.id for r in post.at(4).get_projected("card", Decimal(2)).collect()] == []


def test_scans(post):
    assert [tuple(r) for r in post.scan(["title"]).collect()] == [("c",), ("d",), ("a2",), ("e",)]
    assert [tuple(r) for r in post.scan(["title"], {"views": "40"}).collect()] == [("a2",), ("e",)]
    assert views.totals(views.counts({"a": post.log, "b": post.log})).first() == (2, 14)
