import random

import pytest
from pyspark.sql import functions as F

from quern.operators import relations, views, writes
from quern.operators.access import Table
from quern.plans.declare import read_schema
from quern.plans.migrate import hop
from quern.sources import segments
from quern.streaming import feed

CATALOG = read_schema("""
User { id: i64
  email: &string @email
  age: i32 @min(0) @max(150)
  slug: string? @pattern("^[a-z-]+$") }
Post { id: i64
  author: *User @on_delete(cascade)
  editor: ?User @on_delete(set_null) }
Note { id: i64
  post: *Post @on_delete(restrict) }
""")
LOG = "_seq long, _deleted boolean, "
USER, POST, NOTE = LOG + "id long, email string, age int, slug string", LOG + "id long, author long, editor long", LOG + "id long, post long"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def logs(spark):
    return {
        "User": spark.createDataFrame([(0, False, 1, "a@x.y", 5, None), (1, False, 2, "b@x.y", 6, "b"), (2, False, 3, "c@x.y", 7, None)], USER),
        "Post": spark.createDataFrame([(0, False, 10, 1, 2), (1, False, 11, 1, None), (2, False, 12, 3, 2)], POST),
        "Note": spark.createDataFrame([(0, False, 20, 12)], NOTE),
    }


def test_constraints(spark):
    batch = spark.createDataFrame([(1, "a@x.y", 5, None), (2, "nope", -1, "A"), (3, None, 151, "ok")], "id long, email string, age int, slug string")
    found = rows(writes.broken_constraints(CATALOG, "User", batch), "rule", "key")
    assert found == [("age @max", "3"), ("age @min", "2"), ("email @email", "2"), ("email required", "3"), ("slug @pattern", "2")]


def test_unique(spark):
    live = views.live(logs(spark)["User"], ["id"])
    batch = spark.createDataFrame([(1, "a@x.y", 5, None), (4, "b@x.y", 1, None), (5, "n@x.y", 1, None), (6, "n@x.y", 1, None)], "id long, email string, age int, slug string")
    assert rows(writes.broken_unique(CATALOG, "User", batch, live), "rule", "key") == [("email &", "4"), ("email &", "6")]


def test_transaction(spark):
    t = writes.Transaction(CATALOG, logs(spark))
    t.insert("User", spark.createDataFrame([(4, "d@x.y", 1, None)], "id long, email string, age int, slug string"))
    t.insert("Post", spark.createDataFrame([(13, 4, None)], "id long, author long, editor long"))
    t.validate()
    assert rows(t.live("Post"), "id") == [(10,), (11,), (12,), (13,)]
    assert rows(t.added["User"], "_seq", "id") == [(3, 4)]
    t.insert("Post", spark.createDataFrame([(14, 99, None)], "id long, author long, editor long"))
    with pytest.raises(writes.Refused) as e:
        t.validate()
    assert e.value.status == 409 and e.value.args[0] == "foreign_key"


def test_on_delete(spark):
    t = writes.Transaction(CATALOG, logs(spark))
    t.delete("User", spark.createDataFrame([(1,)], "id long"))
    assert rows(t.live("Post"), "id") == [(12,)] and rows(t.live("User"), "id") == [(2,), (3,)]
    t = writes.Transaction(CATALOG, logs(spark))
    t.delete("User", spark.createDataFrame([(2,)], "id long"))
    assert rows(t.live("Post").filter("editor is null"), "id") == [(10,), (11,), (12,)]
    with pytest.raises(writes.Refused):
        writes.Transaction(CATALOG, logs(spark)).delete("User", spark.createDataFrame([(3,)], "id long"))


def test_conflicts_and_retries(spark):
    log = logs(spark)["User"]
    assert rows(writes.conflicts(log, 2, log.filter("id > 1"), ["id"]), "id") == [(3,)]
    tries = []

    def attempt():
        tries.append(1)
        raise writes.Refused("conflict", [])

    with pytest.raises(writes.Refused):
        writes.retrying(attempt)
    assert len(tries) == 4


def test_history_against_a_dict(spark):
    """Random inserts, updates and deletes: the log's views against a dict of versions."""
    rng, state, log, history = random.Random(3), {}, [], []
    for seq in range(200):
        key = rng.randrange(15)
        if key in state and rng.random() < 0.3:
            log.append((seq, True, key, state.pop(key)))
        else:
            state[key] = rng.randrange(100)
            log.append((seq, False, key, state[key]))
        history.append(dict(state))
    df = spark.createDataFrame(log, LOG + "id long, v long").cache()
    for w in (1, 17, 100, 200):
        assert dict(rows(views.as_of(df, ["id"], w), "id", "v")) == history[w - 1]
    changes = feed.live_query(df, ["id"], lambda d: d.filter("v > 30"), 100, 160)
    a, b = ({k: v for k, v in history[w - 1].items() if v > 30} for w in (100, 160))
    want = sorted([("Added", k) for k in b.keys() - a.keys()] + [("Removed", k) for k in a.keys() - b.keys()] + [("Updated", k) for k in a.keys() & b.keys() if a[k] != b[k]])
    assert rows(changes, "change", "id") == want
    events = feed.events(df, ["id"], "M")
    assert events.count() == 200
    tail = df.select((F.col("_seq") + 1).alias("offset"), F.when(F.col("_deleted"), "deleted").otherwise("updated").alias("kind"), "id", "v")
    assert dict(rows(feed.replay(df, tail, ["id"], 50, 120), "id", "v")) == history[119]


def test_junction(spark):
    j = spark.createDataFrame([(0, False, 1, 5), (1, False, 1, 6), (2, True, 1, 5), (3, False, 2, 5), (4, False, 1, 5), (5, True, 2, 5)], LOG + "l long, r long")
    assert rows(views.pairs(j, "l", "r"), "l", "r", "first_seq") == [(1, 5, 0), (1, 6, 1)]
    assert rows(views.pairs(j, "l", "r", 4), "l", "r") == [(1, 6), (2, 5)]
    out = writes.links(j, spark.createDataFrame([(1, 6), (9, 9)], "l long, r long"), "l", "r", unlink=True)
    assert rows(out, "_seq", "_deleted", "l", "r") == [(6, True, 1, 6)]


def test_cascade_depth(spark):
    chain = spark.createDataFrame([(i + 1, i) for i in range(5)], "child long, parent long")
    start = spark.createDataFrame([(0,)], "id long")
    assert rows(relations.cascade(start, chain), "id", "depth") == [(i, i) for i in range(6)]
    with pytest.raises(RecursionError):
        relations.cascade(start, chain, max_depth=3)
    loop = spark.createDataFrame([(1, 0), (0, 1)], "child long, parent long")
    assert rows(relations.cascade(start, loop), "id", "depth") == [(0, 0), (1, 1)]


def test_store_backup_and_stream(spark, tmp_path):
    store = segments.Store(spark, str(tmp_path / "s"))
    users = logs(spark)["User"]
    assert store.watermark("User") == 0
    store.commit({"User": users.filter("_seq < 2"), "Post": logs(spark)["Post"]})
    store.commit({"User": users.filter("_seq >= 2")})
    log = store.log("User", users.schema)
    assert store.watermark("User") == 3 and rows(log, "id") == [(1,), (2,), (3,)]
    segments.backup(log, str(tmp_path / "b"), 2)
    segments.backup(log, str(tmp_path / "b"), 3, 2)
    assert rows(segments.restore(spark, str(tmp_path / "b"), [(0, 2), (2, 3)], users.schema), "id") == [(1,), (2,), (3,)]
    with pytest.raises(ValueError):
        segments.restore(spark, str(tmp_path / "b"), [(0, 2), (3, 4)], users.schema)

    got = []
    stream = spark.readStream.schema(users.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s/User/*"))
    query = feed.watch(stream, lambda: store.log("User", users.schema), ["id"], lambda d: d.filter("age > 5"), lambda d, n: got.extend(rows(d, "change", "id")))
    running = query.option("checkpointLocation", str(tmp_path / "cp")).start()
    running.processAllAvailable()
    running.stop()
    assert sorted(got) == [("Added", 2), ("Added", 3)]
    seen, live = [], []
    watching = feed.watch_events(stream, lambda: store.log("User", users.schema), ["id"], "User", F.col("id") > 1, lambda d, n: seen.extend(rows(d, "offset", "kind", "id")))
    for writer, folder in ((watching, "cp2"), (feed.subscription(feed.raw_events(stream), F.col("age") > 5).writeStream.foreachBatch(lambda d, n: live.extend(rows(d, "offset", "id"))), "cp3")):
        running = writer.option("checkpointLocation", str(tmp_path / folder)).start()
        running.processAllAvailable()
        running.stop()
    assert sorted(seen) == [(2, "inserted", 2), (3, "inserted", 3)] and sorted(live) == [(2, 2), (3, 3)]
    store.compact("User", users.schema, ["id"])
    assert store.watermark("User") == 3 and store.log("User", users.schema).count() == 3


def test_events_carry_the_row_before(spark, monkeypatch):
    """Against a dict, in blocks of a few numbers: deleted events have what was, whatever the tombstone holds."""
    monkeypatch.setattr(feed, "BLOCK", 7)
    rng, state, log, want = random.Random(9), {}, [], []
    for seq in range(300):
        key = 1 if rng.random() < 0.4 else rng.randrange(12)
        if rng.random() < 0.3:
            log.append((seq, True, key, None))
            if key in state:
                want.append((seq + 1, "deleted", key, state.pop(key)))
        else:
            v = rng.choice([None, rng.randrange(50)])
            log.append((seq, False, key, v))
            want.append((seq + 1, "updated" if key in state else "inserted", key, v))
            state[key] = v
    df = spark.createDataFrame(log, LOG + "id long, v long").repartition(5)
    out = feed.events(df, ["id"], "M")
    assert sorted(map(tuple, out.select("offset", "kind", "id", "v").collect()), key=str) == sorted(want, key=str)
    assert rows(feed.subscription(out, F.col("v") > 25).filter("kind = 'deleted'"), "offset") == [(o,) for o, k, _, v in want if k == "deleted" and v is not None and v > 25]


def test_feed_store(spark, tmp_path):
    raw = spark.createDataFrame([(i, "updated", i % 3) for i in range(1, 21)], "offset long, kind string, id long")
    store = segments.FeedStore(spark, str(tmp_path / "f"), raw.schema)
    assert store.watermark() == 0 and store.earliest() == 1 and store.read_from(0).count() == 0
    assert store.append(raw.filter("offset <= 8")) == 8 and store.append(raw.filter("offset > 8")) == 20
    with pytest.raises(ValueError):
        store.append(raw.filter("offset > 12"))
    replayed, boundary = store.catch_up_from(5)
    assert boundary == 20 and rows(replayed, "offset") == [(i,) for i in range(6, 21)]
    store.prune_through(10)
    assert store.earliest() == 11 and store.watermark() == 20 and rows(store.read_from(10, 3), "offset") == [(11,), (12,), (13,)]
    with pytest.raises(segments.Lagging):
        store.catch_up_from(9)
    more = spark.createDataFrame([(21, "deleted", 0)], raw.schema)
    assert store.append(more) == 21 and rows(store.read_from(19), "offset") == [(20,), (21,)]
    store.prune_through(99)
    assert store.earliest() == 22 and store.read_from(21).count() == 0
    assert sum(1 for _ in (tmp_path / "f/feed").iterdir()) == 1


def begun(spark, tmp_path):
    store = segments.Store(spark, str(tmp_path / "s"))
    store.commit({m: log for m, log in logs(spark).items()})
    return store


def users(spark, *some):
    return spark.createDataFrame(list(some), "id long, email string, age int, slug string")


def test_first_committer_wins(spark, tmp_path):
    store = begun(spark, tmp_path)
    one, two, three = (writes.Transaction.begin(CATALOG, store) for _ in range(3))
    one.update("User", users(spark, (1, "one@x.y", 50, None)))
    two.update("User", users(spark, (1, "two@x.y", 60, None)))
    three.update("User", users(spark, (2, "b@x.y", 70, None)))
    three.insert("Post", spark.createDataFrame([(13, 2, None)], "id long, author long, editor long"))
    assert one.commit() == 2
    with pytest.raises(writes.Refused) as e:
        two.commit()
    assert e.value.args[0] == "conflict" and e.value.status == 409
    assert three.commit() == 3
    log = store.log("User", writes.log_schema(CATALOG, "User"))
    assert rows(log, "_seq", "id", "age") == [(0, 1, 5), (1, 2, 6), (2, 3, 7), (3, 1, 50), (4, 2, 70)]
    assert rows(views.live(store.log("Post", writes.log_schema(CATALOG, "Post")), ["id"]), "id") == [(10,), (11,), (12,), (13,)]


def test_later_commit_is_checked_over_what_others_wrote(spark, tmp_path):
    store = begun(spark, tmp_path)
    one, two = (writes.Transaction.begin(CATALOG, store) for _ in range(2))
    one.insert("User", users(spark, (8, "new@x.y", 1, None)))
    two.insert("User", users(spark, (9, "new@x.y", 1, None)))
    one.commit()
    with pytest.raises(writes.Refused) as e:
        two.commit()
    assert e.value.args[0] == "unique"
    assert store.watermark("User") == 4


def test_retried_transaction_and_group_commit(spark, tmp_path):
    store, tries = begun(spark, tmp_path), []

    def attempt():
        tx = writes.Transaction.begin(CATALOG, store)
        tx.update("User", users(spark, (1, "a@x.y", 40 + len(tries), None)))
        tries.append(1)
        if len(tries) == 1:
            other = writes.Transaction.begin(CATALOG, store)
            other.update("User", users(spark, (1, "a@x.y", 99, None)))
            other.commit()
        return tx.commit()

    assert writes.retrying(attempt) == 3 and len(tries) == 2
    tx = writes.Transaction.begin(CATALOG, store)
    tx.insert("User", spark.range(100, 600).select("id", F.concat(F.col("id").cast("string"), F.lit("@x.y")).alias("email"), F.lit(1).alias("age"), F.lit(None).cast("string").alias("slug")))
    tx.commit()
    assert Table(CATALOG, "User", store.log("User", writes.log_schema(CATALOG, "User"))).live_rows().first()[0] == 503
    bad = writes.Transaction.begin(CATALOG, store)
    bad.insert("User", users(spark, (700, "ok@x.y", 1, None), (701, "bad", 1, None)))
    with pytest.raises(writes.Refused):
        bad.commit()
    assert store.head().number == 4


def test_commit_between_read_and_compaction(spark, tmp_path):
    """A commit that another writer makes while a log is compacted stays, and one that read the old epoch is refused."""
    store, late, once = begun(spark, tmp_path), [], []
    old = writes.Transaction.begin(CATALOG, store)
    old.update("User", users(spark, (2, "b@x.y", 66, None)))

    def meanwhile():
        if not once:
            once.append(1)
            tx = writes.Transaction.begin(CATALOG, store)
            tx.update("User", users(spark, (3, "c@x.y", 77, None)))
            late.append(tx.commit())

    schema = writes.log_schema(CATALOG, "User")
    store.compact("User", schema, ["id"], meanwhile)
    assert rows(store.log("User", schema), "_seq", "id", "age") == [(0, 1, 5), (1, 2, 6), (2, 3, 77)]
    with pytest.raises(writes.Refused) as e:
        old.commit()
    assert e.value.args[0] == "conflict"
    head = store.head()
    store.commit({"User": spark.createDataFrame([(3, False, 4, "d@x.y", 1, None)], USER)}, head)
    with pytest.raises(segments.Overtaken):
        store.commit({"User": spark.createDataFrame([(3, False, 5, "e@x.y", 1, None)], USER)}, head)
    assert store.watermark("User") == 4 and store.log("User", schema).filter("id = 5").count() == 0


def test_maintenance_by_dead_rows(spark, tmp_path):
    store, schema = begun(spark, tmp_path), writes.log_schema(CATALOG, "User")
    assert store.maintain("User", schema, ["id"], soft=1) == "none"
    tx = writes.Transaction.begin(CATALOG, store)
    tx.update("User", users(spark, (1, "a@x.y", 9, None), (2, "b@x.y", 9, None)))
    tx.commit()
    assert store.maintain("User", schema, ["id"], soft=2, busy=True) == "deferred" and store.watermark("User") == 5
    assert store.maintain("User", schema, ["id"], soft=2) == "deferred" and store.watermark("User") == 3
    assert rows(store.log("User", schema), "_seq", "id", "age") == [(0, 3, 7), (1, 1, 9), (2, 2, 9)]


def test_folded_manifest(spark, tmp_path, monkeypatch):
    """Every third entry repeats the others: the same logs from two files as from seven."""
    monkeypatch.setattr(segments, "FOLD", 3)
    store = begun(spark, tmp_path)
    for k in range(4):
        store.commit({"User": spark.createDataFrame([(3 + k, False, 10 + k, f"{k}@x.y", 1, None)], USER)})
    store.compact("User", writes.log_schema(CATALOG, "User"), ["id"])
    store.commit({"User": spark.createDataFrame([(7, False, 99, "z@x.y", 1, None)], USER)})
    assert store.head().number == 7 and {r.commit for r in store.head().rows} == {1, 6, 7}
    assert rows(store.log("User", writes.log_schema(CATALOG, "User")), "id") == [(1,), (2,), (3,), (10,), (11,), (12,), (13,), (99,)]
    assert store.log("Post", writes.log_schema(CATALOG, "Post")).count() == 3


def test_segment_without_entry_is_not_seen(spark, tmp_path, monkeypatch):
    """A writer that dies between its segments and the manifest entry."""
    store = begun(spark, tmp_path)
    tx = writes.Transaction.begin(CATALOG, store)
    tx.update("User", users(spark, (1, "a@x.y", 9, None)))

    def die(*_):
        raise OSError("gone")

    monkeypatch.setattr(segments.Store, "_enter", die)
    with pytest.raises(OSError):
        tx.commit()
    monkeypatch.undo()
    assert store.head().number == 1 and store.watermark("User") == 3
    again = writes.Transaction.begin(CATALOG, store)
    again.update("User", users(spark, (1, "a@x.y", 10, None)))
    assert again.commit() == 2


def test_unlink_all_and_snapshot_traversal(spark):
    j = spark.createDataFrame([(0, False, 1, 5), (1, False, 1, 6), (2, True, 1, 5), (3, False, 2, 5), (4, False, 1, 5)], LOG + "l long, r long")
    gone = writes.unlink_all(j, spark.createDataFrame([(1,), (7,)], "l long"), "l", "l", "r")
    assert rows(gone, "_seq", "_deleted", "l", "r") == [(5, True, 1, 5), (6, True, 1, 6)]
    lefts = spark.createDataFrame([(1,), (2,)], "id long")
    rights = spark.createDataFrame([(0, False, 5, "five"), (1, False, 6, "six"), (2, False, 5, "fünf")], LOG + "id long, name string")
    at = lambda a, b: rows(relations.across_at(j, "l", "r", lefts, "id", rights, "id", a, b), "from_id", "id", "name")
    assert at(4, 2) == [(1, 6, "six"), (2, 5, "five")] and at(5, 3) == [(1, 5, "fünf"), (1, 6, "six"), (2, 5, "fünf")] and at(2, 1) == [(1, 5, "five")]


def test_follow_honours_deletes_and_reads_from(spark):
    log = spark.createDataFrame([(0, False, 1, 5)], LOG + "id long, v long")
    events = spark.createDataFrame([(1, "inserted", 1, 5), (2, "inserted", 2, 6), (3, "deleted", 1, 5)], "offset long, kind string, id long, v long")
    assert rows(feed.follow(log, ["id"], events, 1), "id", "v") == [(2, 6)]
    assert rows(segments.read_from(events, 1, 1), "offset") == [(2,)]
    assert rows(segments.prune_through(events, 2), "offset") == [(3,)]


def test_migration(spark):
    old = read_schema("M { id: i64\n a: i32\n gone: string\n keep: f64 }")
    new = read_schema("M { id: i64\n b: i32\n keep: f64\n extra: bool\n more: string? }")
    log = spark.createDataFrame([(0, False, 1, 2, "x", 1.5)], LOG + "id long, a int, gone string, keep double")
    with pytest.raises(ValueError):
        hop(log, old, new, "M")
    out = hop(log, old, new, "M", {"extra": True, "b": 7})
    assert out.columns == ["_seq", "_deleted", "id", "b", "keep", "extra", "more"] and tuple(out.first()) == (0, False, 1, 7, 1.5, True, None)
    renamed = hop(log, old, read_schema("M { id: i64\n a: i32\n other: string\n keep: f64 }"), "M")
    assert renamed.first().other == "x"
