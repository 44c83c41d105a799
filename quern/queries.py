"""The queries over the test tables, one for each read, relation, write and feed operator, with their SQL.

orders is a churned log: each order has an older version and the present one, and those below FLOOR a tombstone on top.
customer and nation are models with foreign keys; distinct (part, supplier) pairs of lineitem are a junction; events is a
versioned log: id user_id, _seq event_id, and an event of type error is a tombstone. Watermarks and offsets are shares of
a log's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.predicates import loose, loose_equals, matching
from .operators import relations, views, writes
from .operators.access import Table
from .operators.spread import scratch
from .plans import migrate
from .plans.catalog import Catalog
from .plans.declare import read_schema
from .sources import segments
from .streaming import feed

SCHEMA = """
enum Priority { Urgent, High, Medium, Unspecified, Low }

Nation {
  id: u32
  n_name: &string
  n_regionkey: u32
  customers: [Customer]
}

Customer {
  id: u64
  c_name: &string @length(1, 25)
  nation: *Nation
  c_acctbal: f64 @min(0) @max(9000)
  c_mktsegment: ^string @pattern("^(BUILDING|MACHINERY|AUTOMOBILE)$")
  orders: [Order]
  @projection(card: c_name, c_mktsegment)
}

Order {
  id: ^u64
  customer: *Customer @on_delete(restrict)
  o_orderstatus: ^string
  o_totalprice: f64
  o_orderdate: ^timestamp
  o_orderpriority: ^string
  @index(o_orderstatus, o_orderpriority)
  @projection(card: o_orderstatus, o_totalprice)
}

Event {
  id: u64
  event_type: ^string?
  value: f64
}

Typed {
  id: u64
  band: ^f64
  cents: ^i64
  exact: ^decimal
  open: ^bool
  mark: ^char(4)
  token: ^uuid
  placed: ^timestamp
  priority: ^Priority?
  clerk: ^string?
  level: ^i32
  small: ^u32
}
"""

#: The priorities of orders, by urgency, and their names as an enum.
PRIORITIES = {"1-URGENT": "Urgent", "2-HIGH": "High", "3-MEDIUM": "Medium", "4-NOT SPECIFIED": "Unspecified", "5-LOW": "Low"}
#: Orders below this price are deleted.
FLOOR = 50_000

_SCHEMAS: dict[str, T.StructType] = {}


def catalog() -> Catalog:
    return read_schema(SCHEMA)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; its schema is read from its files once, not for every query."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _as_log(df: DataFrame, seq: str) -> DataFrame:
    """A table that never was updated, as a log."""
    return df.withColumns({views.SEQ: F.col(seq).cast("long"), views.DELETED: F.lit(False)})


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "orders")
    named = t.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), "o_orderstatus", "o_totalprice", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("o_orderdate"), "o_orderpriority")
    version = lambda df, k, gone: df.withColumns({views.SEQ: F.col("id") * 3 + k, views.DELETED: F.lit(gone)})
    older = named.withColumns({"o_orderstatus": F.lit("O"), "o_totalprice": F.lit(0.0), "o_orderpriority": F.lit("1-URGENT")})
    below = named.filter(F.coalesce("o_totalprice", F.lit(0.0)) < FLOOR)
    return version(older, 0, False).unionByName(version(named, 1, False)).unionByName(version(below, 2, True))


def orders(spark: SparkSession, sf_dir: str) -> Table:
    return Table(catalog(), "Order", order_log(spark, sf_dir))


def typed(spark: SparkSession, sf_dir: str) -> Table:
    """The orders log as a model with a field of every filterable type."""
    log, k = order_log(spark, sf_dir), F.col("id")
    md5 = F.md5(k.cast("string"))
    name = F.col("o_orderpriority")
    for value, variant in PRIORITIES.items():
        name = F.when(F.col("o_orderpriority") == value, variant).otherwise(name)
    return Table(catalog(), "Typed", log.select(
        views.SEQ, views.DELETED, "id", F.floor(F.col("o_totalprice") / 100_000).cast("double").alias("band"), (k % 11 - 5).alias("cents"), ((k % 8).cast("decimal(38,9)") / 4).cast("decimal(38,9)").alias("exact"),
        (F.col("o_orderstatus") == "O").alias("open"), F.rpad("o_orderstatus", 4, "\0").alias("mark"),
        F.concat_ws("-", *[F.substring(md5, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]).alias("token"), (k % 10 * 86_400).alias("placed"),
        F.nullif(name, F.lit("Low")).alias("priority"), F.nullif(F.concat(F.lit("Clerk"), k % 7), F.lit("Clerk3")).alias("clerk"), (k % 5 - 2).cast("int").alias("level"), (k % 6).alias("small"),
    ))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log; the watermarks of the queries are row counts of it."""
    e = _table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias(views.SEQ), (F.col("event_type") == "error").alias(views.DELETED), F.col("user_id").alias("id"), "event_type", "value")


def _half(log: DataFrame) -> int:
    return views.length(log) // 2


def _events(spark: SparkSession, sf_dir: str) -> Table:
    return Table(catalog(), "Event", event_log(spark, sf_dir))


def _events_at_half(spark: SparkSession, sf_dir: str) -> Table:
    t = _events(spark, sf_dir)
    return t.at(_half(t.log))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), "c_name", F.col("c_nationkey").alias("nation"), "c_acctbal", "c_mktsegment")


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), "n_name", "n_regionkey")


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_name")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")


def _junction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link entry for each line; a returned line ('R') retracts its pair."""
    li = _table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias(views.SEQ), (F.col("l_returnflag") == "R").alias(views.DELETED))


def scan_aggregate(spark, sf_dir):
    rows = orders(spark, sf_dir).filtered({"o_orderstatus": "O"})
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("id").cast("decimal(38,0)")), F.lit(0)).cast("long").alias("s"))


def scan_narrow(spark, sf_dir):
    return orders(spark, sf_dir).scan(["id", "o_totalprice"], {"o_orderstatus": "F"})


def range_top10(spark, sf_dir):
    return orders(spark, sf_dir).range("o_orderdate", low=0, descending=True, limit=10).select("id", "o_orderdate", "o_totalprice")


def range_between(spark, sf_dir):
    return orders(spark, sf_dir).range("id", 100, 2000).select("id", "o_orderdate")


def range_empty(spark, sf_dir):
    return orders(spark, sf_dir).range("id", 2000, 100).select("id")


def find_by_status(spark, sf_dir):
    return orders(spark, sf_dir).find_by(o_orderstatus="F").select("id", "o_orderstatus")


def find_by_status_and_priority(spark, sf_dir):
    return orders(spark, sf_dir).find_by(o_orderstatus="O", o_orderpriority="1-URGENT").select("id", "customer")


def find_by_customer(spark, sf_dir):
    return orders(spark, sf_dir).find_by(customer=7).select("id", "customer")


def find_by_null(spark, sf_dir):
    e = event_log(spark, sf_dir).withColumn("event_type", F.nullif("event_type", F.lit("click"))).withColumn(views.DELETED, F.lit(False))
    return Table(catalog(), "Event", e).find_by(event_type=None).select("id", "value")


def get_by_id(spark, sf_dir):
    return orders(spark, sf_dir).get(42).select("id", "customer", "o_totalprice")


def get_by_unique(spark, sf_dir):
    log = _as_log(_customers(spark, sf_dir), "id")
    return Table(catalog(), "Customer", log).get_by(c_name="Customer#000000007").select("id", "c_name")


def filter_bad_value(spark, sf_dir):
    return orders(spark, sf_dir).filtered({"id": " 12 "}).select("id")


def filter_loose(spark, sf_dir):
    values = loose({"o_orderstatus": "F", "limit": "10", "o_totalprice": "01234"})
    out = orders(spark, sf_dir).all().filter(loose_equals(F.col("o_orderstatus"), "string", values["o_orderstatus"]))
    return out.select("id", "o_orderstatus")


#: A filter of each type, with values that parse and values that don't.
TYPED_FILTERS = {
    "f64": {"band": "3"}, "f64 point": {"band": "3.0"}, "f64 bad": {"band": "three"}, "f64 nan": {"band": "NaN"}, "i64": {"cents": "-5"}, "decimal": {"exact": "1.250"}, "decimal bad": {"exact": "1."}, "bool": {"open": "true"},
    "bool bad": {"open": "yes"}, "char": {"mark": "F"}, "char long": {"mark": "FFFFF"}, "uuid": {"token": "{A1D0C6E8-3F02-7327-D846-1063F4AC58A6}"}, "uuid bad": {"token": "a1d0"}, "timestamp": {"placed": "259200"},
    "enum": {"priority": "High"}, "enum bad": {"priority": "Low down"}, "string": {"clerk": "Clerk2"}, "i32": {"level": "-2"}, "i32 bad": {"level": "2147483648"}, "u32": {"small": "+4"}, "u32 bad": {"small": "-4"}, "two": {"open": "false", "level": "1"},
    "none": {"unknown": "1"},
}


def filter_typed(spark, sf_dir):
    """How many rows, and which (by the sum of their ids), each filter takes."""
    t = typed(spark, sf_dir)
    fits = F.array(*[F.when(matching(t.catalog, "Typed", params), F.lit(label)) for label, params in TYPED_FILTERS.items()])
    taken = t.rows().select("id", F.explode(F.array_compact(fits)).alias("filter"))
    return taken.groupBy("filter").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def find_typed(spark, sf_dir):
    """Probes of nullable and of typed fields."""
    t = typed(spark, sf_dir)
    some = [("clerk null", t.find_by(clerk=None)), ("priority null", t.find_by(priority=None)), ("level", t.find_by(level=2)), ("token", t.find_by(token="a1d0c6e8-3f02-7327-d846-1063f4ac58a6"))]
    out = None
    for label, rows in some:
        one = rows.select(F.lit(label).alias("probe"), "id")
        out = one if out is None else out.unionByName(one)
    return out


def range_typed(spark, sf_dir):
    t = typed(spark, sf_dir)
    return t.range("exact", "0.5", "1.25").select(F.lit("exact").alias("field"), "id").unionByName(t.range("cents", low=-1, high=1, descending=True).select(F.lit("cents").alias("field"), "id"))


def _ranked(spark: SparkSession, df: DataFrame, columns: list[str]) -> DataFrame:
    """A page's rows with their place, so that the order shows in an unordered comparison. A page has at most MAX_LIMIT rows."""
    page = df.select(*columns)
    return spark.createDataFrame([(i, *r) for i, r in enumerate(page.collect())], T.StructType([T.StructField("place", T.IntegerType()), *page.schema.fields]))


def list_page(spark, sf_dir):
    page = orders(spark, sf_dir).list({"o_orderstatus": "O", "sort": "o_orderdate", "order": "desc", "limit": "25", "offset": "50"})
    return _ranked(spark, page, ["id", "o_orderdate"])


def list_total(spark, sf_dir):
    return orders(spark, sf_dir).total({"o_orderstatus": "O"})


def list_clamped(spark, sf_dir):
    return _ranked(spark, orders(spark, sf_dir).list({"limit": "5000", "offset": "x", "sort": "o_totalprice"}), ["id"])


def list_knobs(spark, sf_dir):
    """Pages of at most 30 rows, 20 by default."""
    t = Table(catalog(), "Order", order_log(spark, sf_dir), default_limit=20, max_limit=30)
    return _ranked(spark, t.list({"sort": "id"}), ["id"]).unionByName(_ranked(spark, t.list({"sort": "id", "order": "desc", "limit": "99"}), ["id"]))


def enum_sort(spark, sf_dir):
    """By declaration, not by name; nulls come first."""
    return _ranked(spark, typed(spark, sf_dir).list({"sort": "priority", "limit": "1000"}), ["id", "priority"])


def list_nulls(spark, sf_dir):
    """Nulls come last in descending order; ties by scan order reversed."""
    return _ranked(spark, typed(spark, sf_dir).list({"sort": "clerk", "order": "desc", "level": "0", "limit": "1000"}), ["id", "clerk"])


def projection_card(spark, sf_dir):
    return orders(spark, sf_dir).project("card")


def projection_page(spark, sf_dir):
    return _ranked(spark, orders(spark, sf_dir).list({"sort": "id", "limit": "10"}, "card"), ["id", "o_orderstatus", "o_totalprice"])


def projected_point(spark, sf_dir):
    """Of the live view, though the table is read at a snapshot."""
    t = _events_at_half(spark, sf_dir)
    known = Table(catalog(), "Order", order_log(spark, sf_dir), t.watermark)
    return known.get_projected("card", 42)


def export_column(spark, sf_dir):
    return orders(spark, sf_dir).export_column("o_orderdate")


def order_customer(spark, sf_dir):
    out = relations.forward(orders(spark, sf_dir).all(), "customer", _customers(spark, sf_dir), "id", "parent")
    return out.select("id", "customer", F.col("parent.c_name").alias("c_name"))


def forward_optional(spark, sf_dir):
    """Customers without a nation where their balance is negative."""
    c = _customers(spark, sf_dir).withColumn("nation", F.when(F.col("c_acctbal") >= 0, F.col("nation")))
    return relations.forward(c, "nation", _nations(spark, sf_dir), "id", "home").select("id", "nation", F.col("home.n_name").alias("n_name"))


def customer_orders(spark, sf_dir):
    some = _customers(spark, sf_dir).filter("c_mktsegment = 'BUILDING'")
    return relations.reverse(some, "id", orders(spark, sf_dir).all(), "customer").select("id", "customer")


def order_with_relations(spark, sf_dir):
    nations = _nations(spark, sf_dir).select("id", "n_name")
    customers = relations.with_relations(_customers(spark, sf_dir), {"nation": (nations, "id")})
    out = relations.with_relations(orders(spark, sf_dir).all(), {"customer": (customers, "id")})
    return out.select("id", F.col("customer_row.c_name").alias("c_name"), F.col("customer_row.nation_row.n_name").alias("n_name"))


def part_suppliers(spark, sf_dir):
    linked = views.pairs(_junction(spark, sf_dir), "part", "supplier")
    return relations.across(linked, "part", "supplier", _parts(spark, sf_dir), "id", _suppliers(spark, sf_dir), "id").select("from_id", F.col("id").alias("s_suppkey"), "s_name")


def part_suppliers_at(spark, sf_dir):
    """Junction and suppliers both as of the middle of their logs."""
    j, s = _junction(spark, sf_dir), _as_log(_suppliers(spark, sf_dir), "id")
    out = relations.across_at(j, "part", "supplier", _parts(spark, sf_dir), "id", s, "id", _half(j), _half(s))
    return out.select("from_id", F.col("id").alias("s_suppkey"), "s_name")


def junction_pairs(spark, sf_dir):
    return views.pairs(_junction(spark, sf_dir), "part", "supplier")


def junction_pairs_at(spark, sf_dir):
    j = _junction(spark, sf_dir)
    return views.pairs(j, "part", "supplier", _half(j))


def dangling_orders(spark, sf_dir):
    """Customers with a negative balance are gone."""
    known = _customers(spark, sf_dir).filter("c_acctbal >= 0")
    return relations.dangling(orders(spark, sf_dir).all(), "customer", known, "id").select("id", "customer")


def restrict_children(spark, sf_dir):
    doomed = _customers(spark, sf_dir).filter("c_acctbal < 0")
    return relations.restricted(doomed, "id", orders(spark, sf_dir).all(), "customer").select("id")


def cascade_delete(spark, sf_dir):
    """What hangs below the nations of one region: customers, then their orders. Ids of levels are kept apart by sign and offset."""
    nations = _nations(spark, sf_dir).filter("n_regionkey = 0").select((-F.col("id").cast("long") - 1).alias("id"))
    c = _customers(spark, sf_dir).select((F.col("id") * 2).alias("child"), (-F.col("nation").cast("long") - 1).alias("parent"))
    o = orders(spark, sf_dir).all().select((F.col("id") * 2 + 1).alias("child"), (F.col("customer") * 2).alias("parent"))
    return relations.cascade(nations, c.unionByName(o)).select("id", "depth")


def set_null_children(spark, sf_dir):
    doomed = _customers(spark, sf_dir).filter("c_acctbal < 0")
    return relations.nulled(doomed, "id", orders(spark, sf_dir).all(), "customer").select("id", "customer", "o_orderstatus")


def constraint_violations(spark, sf_dir):
    return writes.broken_constraints(catalog(), "Customer", _customers(spark, sf_dir)).select("kind", "rule", "key")


def unique_violations(spark, sf_dir):
    """A batch that gives each customer of the segment BUILDING the name of the one before."""
    c = _customers(spark, sf_dir)
    names = c.select((F.col("id") + 1).alias("id"), F.col("c_name").alias("other"))
    batch = c.filter("c_mktsegment = 'BUILDING'").join(names, "id").drop("c_name").withColumnRenamed("other", "c_name").select(*c.columns)
    return writes.broken_unique(catalog(), "Customer", batch, c).select("kind", "rule", "key")


def key_violations(spark, sf_dir):
    """Orders of customers with a negative balance, which are gone."""
    parents = {"Customer": _customers(spark, sf_dir).filter("c_acctbal >= 0")}
    return writes.broken_keys(catalog(), "Order", orders(spark, sf_dir).all(), parents).select("kind", "rule", "key")


def write_conflicts(spark, sf_dir):
    """A transaction that wrote the keys of all purchases before its snapshot at half of the log."""
    log = event_log(spark, sf_dir)
    half = _half(log)
    return writes.conflicts(log, half, log.filter((F.col("_seq") < half) & (F.col("event_type") == "purchase")), ["id"])


def insert_versions(spark, sf_dir):
    """Customers with a negative balance, new to a log of all others."""
    c = _customers(spark, sf_dir)
    return writes.inserts(_as_log(c.filter("c_acctbal >= 0"), "id"), c.filter("c_acctbal < 0"), ["id"]).select("_seq", "id", "_deleted")


def update_versions(spark, sf_dir):
    """Updates of all ids of the log; those that aren't live leave no version."""
    log = event_log(spark, sf_dir)
    batch = log.select("id").distinct().select("id", F.lit("click").alias("event_type"), F.col("id").cast("double").alias("value"))
    return writes.updates(log, ["id"], batch)


def delete_versions(spark, sf_dir):
    """Deletes of all ids that ever had a purchase of more than 50."""
    log = event_log(spark, sf_dir)
    return writes.deletes(log, ["id"], log.filter("event_type = 'purchase' and value > 50").select("id")).select("_seq", "id", "value", "_deleted")


def link_versions(spark, sf_dir):
    """Links of all pairs that returned lines name."""
    j = _junction(spark, sf_dir)
    return writes.links(j, j.filter(views.DELETED).select("part", "supplier"), "part", "supplier").select("_seq", "part", "supplier", "_deleted")


def unlink_versions(spark, sf_dir):
    """All pairs of lineitem; those that aren't linked leave no entry."""
    j = _junction(spark, sf_dir)
    return writes.links(j, j.select("part", "supplier").distinct(), "part", "supplier", unlink=True).select("_seq", "part", "supplier", "_deleted")


def unlink_all_versions(spark, sf_dir):
    """Every link of the small parts."""
    small = _parts(spark, sf_dir).filter("p_size < 10").select(F.col("id").alias("part"))
    return writes.unlink_all(_junction(spark, sf_dir), small, "part", "part", "supplier").select("_seq", "part", "supplier", "_deleted")


def live_latest(spark, sf_dir):
    return _events(spark, sf_dir).rows()


def as_of_scan(spark, sf_dir):
    return _events_at_half(spark, sf_dir).rows()


def get_at(spark, sf_dir):
    """The live row of the least id at the middle of the log."""
    t = _events_at_half(spark, sf_dir)
    return t.get(t.rows(["id"]).agg(F.min("id")).first()[0])


def find_at(spark, sf_dir):
    return _events_at_half(spark, sf_dir).find_by(event_type="click").select("id", "value")


def read_physical(spark, sf_dir):
    return views.read_at(event_log(spark, sf_dir), 3)


def _models(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: _table(spark, sf_dir, t) for t in ("orders", "customer", "events")}


def metrics_counts(spark, sf_dir):
    return views.counts(_models(spark, sf_dir))


def metrics_totals(spark, sf_dir):
    return views.totals(views.counts(_models(spark, sf_dir)))


def live_count(spark, sf_dir):
    return _events(spark, sf_dir).live_rows()


def storage_stats(spark, sf_dir):
    return views.statistics(event_log(spark, sf_dir), ["id"])


def compacted(spark, sf_dir):
    return views.compact(event_log(spark, sf_dir), ["id"])


def change_feed(spark, sf_dir):
    return feed.events(event_log(spark, sf_dir), ["id"], "Event")


def subscription_filter(spark, sf_dir):
    return feed.subscription(feed.events(event_log(spark, sf_dir), ["id"], "Event"), matching(catalog(), "Event", {"event_type": "click"})).select("offset", "kind", "id", "value")


def live_query_delta(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return feed.live_query(log, ["id"], lambda rows: rows.filter(F.col("value") > 50), _half(log), views.length(log))


def live_query_init(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return feed.live_query(log, ["id"], lambda rows: rows.filter(F.col("value") > 50), 0, _half(log)).select("change", "id")


def pitr_replay(spark, sf_dir):
    """A backup of half of the log, and events up to three quarters of it."""
    log = event_log(spark, sf_dir)
    return feed.replay(log, feed.raw_events(log), ["id"], _half(log), views.length(log) * 3 // 4).select("id", "value")


def replication_page(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return segments.read_from(feed.raw_events(log), _half(log), 100)


def replication_tail(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return feed.tail(feed.raw_events(log), _half(log)).select("offset", "id")


def retention(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return segments.prune_through(feed.raw_events(log), _half(log)).select("offset", "kind")


def feed_caught_up(spark, sf_dir):
    """A durable feed of two appends, pruned through a quarter: what a follower at half of it still has to apply."""
    log = event_log(spark, sf_dir)
    raw, half = feed.raw_events(log), _half(log)
    store = segments.FeedStore(spark, scratch(spark), raw.schema)
    store.append(raw.filter(F.col("offset") <= half))
    store.append(raw.filter(F.col("offset") > half))
    store.prune_through(half // 2)
    return store.catch_up_from(half)[0].select("offset", "kind", "id", "value")


def follower_state(spark, sf_dir):
    log = event_log(spark, sf_dir)
    half = _half(log)
    return feed.follow(log.filter(F.col("_seq") < half), ["id"], feed.raw_events(log), half).select("_seq", "id", "value")


def backup_restored(spark, sf_dir):
    """The live view of a full backup of two thirds of the log and an increment of the rest."""
    log, folder = event_log(spark, sf_dir), scratch(spark)
    end = views.length(log)
    cut = end * 2 // 3
    segments.backup(log, folder, cut)
    segments.backup(log, folder, end, cut)
    return views.live(segments.restore(spark, folder, [(0, cut), (cut, end)], log.schema), ["id"])


def committed_log(spark, sf_dir):
    """Two commits that hold the log, read as of the store's watermark."""
    log, store = event_log(spark, sf_dir), segments.Store(spark, scratch(spark))
    half = _half(log)
    store.commit({"Event": log.filter(F.col("_seq") < half)})
    store.commit({"Event": log.filter(F.col("_seq") >= half)})
    return views.as_of(store.log("Event", log.schema), ["id"], store.watermark("Event"))


def store_compacted(spark, sf_dir):
    log, store = event_log(spark, sf_dir), segments.Store(spark, scratch(spark))
    store.commit({"Event": log})
    store.compact("Event", log.schema, ["id"])
    return store.log("Event", log.schema)


def store_maintained(spark, sf_dir):
    """A store that compacts the log as soon as a row of it is dead."""
    log, store = event_log(spark, sf_dir), segments.Store(spark, scratch(spark))
    store.commit({"Event": log})
    store.maintain("Event", log.schema, ["id"], soft=1)
    return store.log("Event", log.schema)


MOVED = SCHEMA.replace("c_name: &string @length(1, 25)", "label: &string @length(1, 25)").replace("card: c_name", "card: label")


def migrated_log(spark, sf_dir):
    """Customers under a schema that renames the name: found by the differ, carried over by the hop."""
    return migrate.hop(_as_log(_customers(spark, sf_dir), "id"), catalog(), read_schema(MOVED), "Customer").select(F.col("id").cast("long").alias("id"), "label", "c_mktsegment")


def schema_changes(spark, sf_dir):
    found = migrate.diff(catalog(), read_schema(MOVED))
    return spark.createDataFrame([(c.kind, c.model, c.name, c.to, c.breaking) for c in found], "kind string, model string, name string, renamed string, breaking boolean")


CASCADE = SCHEMA.replace("@on_delete(restrict)", "@on_delete(cascade)")


def transaction_cascade(spark, sf_dir):
    """Orders that stay when a transaction deletes the customers with a negative balance, and their orders with them."""
    tx = writes.Transaction(read_schema(CASCADE), {"Customer": _as_log(_customers(spark, sf_dir), "id"), "Order": order_log(spark, sf_dir)})
    tx.delete("Customer", _customers(spark, sf_dir).filter("c_acctbal < 0").select("id"))
    return tx.live("Order").select("id", "customer")


#: Events as a model that is written to: users, and visits of them.
VISITS = """
User { id: i64
  n: i64 @min(0) }
Visit { id: i64
  user: *User @on_delete(cascade)
  value: f64 }
"""


def transaction_committed(spark, sf_dir):
    """Users and their visits are inserted, users without a purchase deleted with their visits, by two transactions; the store's live visits."""
    c, e = read_schema(VISITS), _table(spark, sf_dir, "events")
    store = segments.Store(spark, scratch(spark))
    tx = writes.Transaction.begin(c, store)
    tx.insert("User", e.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n")))
    tx.insert("Visit", e.select(F.col("event_id").alias("id"), F.col("user_id").alias("user"), "value"))
    tx.commit()
    tx = writes.Transaction.begin(c, store)
    tx.delete("User", e.groupBy(F.col("user_id").alias("id")).agg(F.max(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("top")).filter("top is null or top < 150").select("id"))
    tx.commit()
    return views.live(store.log("Visit", writes.log_schema(c, "Visit")), ["id"]).select("id", "user", "value")


QUERIES = {f.__name__: f for f in (
    scan_aggregate, scan_narrow, range_top10, range_between, range_empty, find_by_status, find_by_status_and_priority, find_by_customer, find_by_null, get_by_id, get_by_unique,
    filter_bad_value, filter_loose, filter_typed, find_typed, range_typed, list_page, list_total, list_clamped, list_knobs, enum_sort, list_nulls, projection_card, projection_page, projected_point,
    export_column, order_customer, forward_optional, customer_orders, order_with_relations, part_suppliers, part_suppliers_at, junction_pairs, junction_pairs_at, dangling_orders, restrict_children,
    cascade_delete, set_null_children, constraint_violations, unique_violations, key_violations, write_conflicts, insert_versions, update_versions, delete_versions, link_versions, unlink_versions,
    unlink_all_versions, live_latest, as_of_scan, get_at, find_at, read_physical, metrics_counts, metrics_totals, live_count, storage_stats, compacted, change_feed, subscription_filter,
    live_query_delta, live_query_init, pitr_replay, replication_page, replication_tail, retention, feed_caught_up, follower_state, backup_restored, committed_log, store_compacted, store_maintained,
    migrated_log, schema_changes, transaction_cascade, transaction_committed,
)}

_SECONDS = "CAST(epoch(o_orderdate) AS BIGINT)"
_ORDERS = f"o AS (SELECT * FROM orders WHERE coalesce(o_totalprice, 0) >= {FLOOR})"
_LOG = "log AS (SELECT event_id AS _seq, event_type = 'error' AS _deleted, user_id AS id, event_type, value FROM events), h AS (SELECT (coalesce(max(_seq), -1) + 1) // 2 AS half, coalesce(max(_seq), -1) + 1 AS n FROM log)"
_BEFORE = "_seq < (SELECT half FROM h)"


def _view(name: str, where: str = "true", keep: str = "NOT _deleted") -> str:
    """SQL of a log's newest versions."""
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY _seq DESC) AS k FROM log WHERE {where}) WHERE k = 1 AND {keep})"


_JUNCTION = "j AS (SELECT l_partkey AS part, l_suppkey AS supplier, l_orderkey * 10 + l_linenumber AS _seq, bool_or(l_returnflag = 'R') AS _deleted FROM lineitem GROUP BY ALL), jh AS (SELECT (max(_seq) + 1) // 2 AS half, max(_seq) AS top FROM j)"
_PAIRS = "p AS (SELECT part, supplier, min(_seq) AS first_seq, arg_max(_deleted, _seq) AS gone FROM j WHERE {} GROUP BY part, supplier)"
_RANK = "CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 END"
_NAME = "CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium' WHEN '4-NOT SPECIFIED' THEN 'Unspecified' END"
_WAS = "lag(_deleted) OVER w AS was, lag(event_type) OVER w AS was_type, lag(value) OVER w AS was_value"
_FEED = f"b AS (SELECT *, {_WAS} FROM log WINDOW w AS (PARTITION BY id ORDER BY _seq)), f AS (SELECT _seq + 1 AS \"offset\", CASE WHEN _deleted THEN 'deleted' WHEN was = false THEN 'updated' ELSE 'inserted' END AS kind, id, CASE WHEN _deleted THEN was_type ELSE event_type END AS event_type, CASE WHEN _deleted THEN was_value ELSE value END AS value FROM b WHERE NOT _deleted OR was = false)"
_TOKEN = "'a1d0c6e8-3f02-7327-d846-1063f4ac58a6'"
_TYPED = (
    "t AS (SELECT o_orderkey AS id, floor(o_totalprice / 100000) AS band, o_orderkey % 11 - 5 AS cents, (o_orderkey % 8) / 4.0 AS exact, o_orderstatus AS mark, md5(CAST(o_orderkey AS VARCHAR)) AS token,"
    f" o_orderkey % 10 * 86400 AS placed, {_NAME} AS priority, nullif('Clerk' || (o_orderkey % 7), 'Clerk3') AS clerk, o_orderkey % 5 - 2 AS level, o_orderkey % 6 AS small FROM o)"
)
#: Filters that take any row, as SQL over t.
_TAKES = {
    "f64": "band = 3", "f64 point": "band = 3", "i64": "cents = -5", "decimal": "exact = 1.25", "bool": "mark = 'O'", "char": "mark = 'F'", "uuid": f"token = replace({_TOKEN}, '-', '')", "timestamp": "placed = 259200",
    "enum": "priority = 'High'", "string": "clerk = 'Clerk2'", "i32": "level = -2", "u32": "small = 4", "two": "mark <> 'O' AND level = 1", "none": "true",
}

ORACLE_SQL = {
    "scan_aggregate": f"WITH {_ORDERS} SELECT count(*) AS n, CAST(coalesce(sum(o_orderkey), 0) AS BIGINT) AS s FROM o WHERE o_orderstatus = 'O'",
    "scan_narrow": f"WITH {_ORDERS} SELECT o_orderkey AS id, o_totalprice FROM o WHERE o_orderstatus = 'F'",
    "range_top10": f"WITH {_ORDERS} SELECT o_orderkey AS id, {_SECONDS} AS o_orderdate, o_totalprice FROM o WHERE {_SECONDS} >= 0 ORDER BY {_SECONDS} DESC, o_orderkey LIMIT 10",
    "range_between": f"WITH {_ORDERS} SELECT o_orderkey AS id, {_SECONDS} AS o_orderdate FROM o WHERE o_orderkey BETWEEN 100 AND 2000",
    "range_empty": "SELECT o_orderkey AS id FROM orders WHERE false",
    "find_by_status": f"WITH {_ORDERS} SELECT o_orderkey AS id, o_orderstatus FROM o WHERE o_orderstatus = 'F'",
    "find_by_status_and_priority": f"WITH {_ORDERS} SELECT o_orderkey AS id, o_custkey AS customer FROM o WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'",
    "find_by_customer": f"WITH {_ORDERS} SELECT o_orderkey AS id, o_custkey AS customer FROM o WHERE o_custkey = 7",
    "find_by_null": "SELECT user_id AS id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1 AND nullif(event_type, 'click') IS NOT DISTINCT FROM NULL",
    "get_by_id": f"WITH {_ORDERS} SELECT o_orderkey AS id, o_custkey AS customer, o_totalprice FROM o WHERE o_orderkey = 42",
    "get_by_unique": "SELECT c_custkey AS id, c_name FROM customer WHERE c_name = 'Customer#000000007'",
    "filter_bad_value": "SELECT o_orderkey AS id FROM orders WHERE false",
    "filter_loose": f"WITH {_ORDERS} SELECT o_orderkey AS id, o_orderstatus FROM o WHERE o_orderstatus = 'F'",
    "filter_typed": f"WITH {_ORDERS}, {_TYPED} " + " UNION ALL ".join(f"SELECT '{k}' AS filter, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM t WHERE {c} HAVING count(*) > 0" for k, c in _TAKES.items()),
    "find_typed": f"WITH {_ORDERS}, {_TYPED} SELECT 'clerk null' AS probe, id FROM t WHERE clerk IS NULL UNION ALL SELECT 'priority null', id FROM t WHERE priority IS NULL UNION ALL SELECT 'level', id FROM t WHERE level = 2 UNION ALL SELECT 'token', id FROM t WHERE token = replace({_TOKEN}, '-', '')",
    "range_typed": f"WITH {_ORDERS}, {_TYPED} SELECT 'exact' AS field, id FROM t WHERE exact BETWEEN 0.5 AND 1.25 UNION ALL SELECT 'cents', id FROM t WHERE cents BETWEEN -1 AND 1",
    "list_page": f"WITH {_ORDERS} SELECT CAST(row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) - 51 AS INTEGER) AS place, o_orderkey AS id, {_SECONDS} AS o_orderdate FROM o WHERE o_orderstatus = 'O' ORDER BY place LIMIT 25 OFFSET 50",
    "list_total": f"WITH {_ORDERS} SELECT count(*) AS total FROM o WHERE o_orderstatus = 'O'",
    "list_clamped": f"WITH {_ORDERS} SELECT CAST(row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS INTEGER) AS place, o_orderkey AS id FROM o ORDER BY place LIMIT 1000",
    "list_knobs": f"WITH {_ORDERS}, a AS (SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS place, o_orderkey AS id FROM o), d AS (SELECT CAST(row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS INTEGER) AS place, o_orderkey AS id FROM o) SELECT * FROM a WHERE place < 20 UNION ALL SELECT * FROM d WHERE place < 30",
    "enum_sort": f"WITH {_ORDERS} SELECT CAST(row_number() OVER (ORDER BY {_RANK} NULLS FIRST, o_orderkey) - 1 AS INTEGER) AS place, o_orderkey AS id, {_NAME} AS priority FROM o ORDER BY place LIMIT 1000",
    "list_nulls": f"WITH {_ORDERS}, {_TYPED} SELECT CAST(row_number() OVER (ORDER BY clerk DESC NULLS LAST, id DESC) - 1 AS INTEGER) AS place, id, clerk FROM t WHERE level = 0 ORDER BY place LIMIT 1000",
    "projection_card": f"WITH {_ORDERS} SELECT o_orderkey AS id, o_orderstatus, o_totalprice FROM o",
    "projection_page": f"WITH {_ORDERS} SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS place, o_orderkey AS id, o_orderstatus, o_totalprice FROM o ORDER BY place LIMIT 10",
    "projected_point": f"WITH {_ORDERS} SELECT o_orderkey AS id, o_orderstatus, o_totalprice FROM o WHERE o_orderkey = 42",
    "export_column": f"WITH {_ORDERS} SELECT {_SECONDS} AS o_orderdate FROM o",
    "order_customer": f"WITH {_ORDERS} SELECT o_orderkey AS id, o_custkey AS customer, c_name FROM o LEFT JOIN customer ON o_custkey = c_custkey",
    "forward_optional": "SELECT c_custkey AS id, CASE WHEN c_acctbal >= 0 THEN c_nationkey END AS nation, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND c_acctbal >= 0",
    "customer_orders": f"WITH {_ORDERS} SELECT o_orderkey AS id, o_custkey AS customer FROM o WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "order_with_relations": f"WITH {_ORDERS} SELECT o_orderkey AS id, c_name, n_name FROM o LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey",
    "part_suppliers": f"WITH {_JUNCTION}, {_PAIRS.format('true')} SELECT part AS from_id, s_suppkey, s_name FROM p JOIN part ON part = p_partkey JOIN supplier ON supplier = s_suppkey WHERE NOT gone",
    "part_suppliers_at": f"WITH {_JUNCTION}, {_PAIRS.format('_seq < (SELECT half FROM jh)')} SELECT part AS from_id, s_suppkey, s_name FROM p JOIN part ON part = p_partkey JOIN supplier ON supplier = s_suppkey WHERE NOT gone AND s_suppkey < (SELECT (max(s_suppkey) + 1) // 2 FROM supplier)",
    "junction_pairs": f"WITH {_JUNCTION}, {_PAIRS.format('true')} SELECT part, supplier, first_seq FROM p WHERE NOT gone",
    "junction_pairs_at": f"WITH {_JUNCTION}, {_PAIRS.format('_seq < (SELECT half FROM jh)')} SELECT part, supplier, first_seq FROM p WHERE NOT gone",
    "dangling_orders": f"WITH {_ORDERS} SELECT o_orderkey AS id, o_custkey AS customer FROM o WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0)",
    "restrict_children": f"WITH {_ORDERS} SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0 AND EXISTS (SELECT 1 FROM o WHERE o_custkey = c_custkey)",
    "cascade_delete": f"WITH {_ORDERS}, n AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 0), c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n)) SELECT CAST(-n_nationkey - 1 AS BIGINT) AS id, 0 AS depth FROM n UNION ALL SELECT c_custkey * 2, 1 FROM c UNION ALL SELECT o_orderkey * 2 + 1, 2 FROM o WHERE o_custkey IN (SELECT c_custkey FROM c)",
    "set_null_children": f"WITH {_ORDERS} SELECT o_orderkey AS id, CAST(NULL AS BIGINT) AS customer, o_orderstatus FROM o WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "constraint_violations": "SELECT 'constraint' AS kind, rule, CAST(c_custkey AS VARCHAR) AS key FROM (SELECT c_custkey, 'c_name @length' AS rule FROM customer WHERE length(c_name) NOT BETWEEN 1 AND 25 UNION ALL SELECT c_custkey, 'c_acctbal @min' FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'c_acctbal @max' FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT c_custkey, 'c_mktsegment @pattern' FROM customer WHERE NOT regexp_matches(c_mktsegment, '^(BUILDING|MACHINERY|AUTOMOBILE)$'))",
    "unique_violations": "WITH b AS (SELECT a.c_custkey AS id, p.c_name AS name FROM customer a JOIN customer p ON p.c_custkey = a.c_custkey - 1 WHERE a.c_mktsegment = 'BUILDING'), t AS (SELECT id, name, 1 AS new FROM b UNION ALL SELECT c_custkey, c_name, 0 FROM customer WHERE c_custkey NOT IN (SELECT id FROM b)) SELECT 'unique' AS kind, 'c_name &' AS rule, CAST(max(id) AS VARCHAR) AS key FROM t GROUP BY name HAVING count(*) > 1 AND sum(new) > 0",
    "key_violations": f"WITH {_ORDERS} SELECT 'foreign_key' AS kind, 'customer *' AS rule, CAST(o_orderkey AS VARCHAR) AS key FROM o WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)",
    "write_conflicts": f"WITH {_LOG} SELECT DISTINCT id FROM log, h WHERE _seq < half AND event_type = 'purchase' AND id IN (SELECT id FROM log, h WHERE _seq >= half)",
    "insert_versions": "WITH t AS (SELECT coalesce(max(c_custkey) + 1, 0) AS s FROM customer WHERE c_acctbal >= 0) SELECT s + row_number() OVER (ORDER BY c_custkey) - 1 AS _seq, c_custkey AS id, false AS _deleted FROM customer, t WHERE c_acctbal < 0",
    "update_versions": f"WITH {_LOG}, {_view('v')} SELECT (SELECT max(_seq) FROM log) + row_number() OVER (ORDER BY id) AS _seq, false AS _deleted, id, 'click' AS event_type, CAST(id AS DOUBLE) AS value FROM v",
    "delete_versions": f"WITH {_LOG}, {_view('v')}, t AS (SELECT coalesce(max(_seq) + 1, 0) AS s FROM log) SELECT s + row_number() OVER (ORDER BY id) - 1 AS _seq, id, value, true AS _deleted FROM v, t WHERE id IN (SELECT id FROM log WHERE event_type = 'purchase' AND value > 50)",
    "link_versions": f"WITH {_JUNCTION}, r AS (SELECT DISTINCT l_partkey AS part, l_suppkey AS supplier FROM lineitem WHERE l_returnflag = 'R') SELECT (SELECT top FROM jh) + row_number() OVER (ORDER BY part, supplier) AS _seq, part, supplier, false AS _deleted FROM r",
    "unlink_versions": f"WITH {_JUNCTION}, {_PAIRS.format('true')} SELECT (SELECT top FROM jh) + row_number() OVER (ORDER BY part, supplier) AS _seq, part, supplier, true AS _deleted FROM p WHERE NOT gone",
    "unlink_all_versions": f"WITH {_JUNCTION}, {_PAIRS.format('true')} SELECT (SELECT top FROM jh) + row_number() OVER (ORDER BY part, supplier) AS _seq, part, supplier, true AS _deleted FROM p WHERE NOT gone AND part IN (SELECT p_partkey FROM part WHERE p_size < 10)",
    "live_latest": f"WITH {_LOG}, {_view('v')} SELECT _seq, id, event_type, value FROM v",
    "as_of_scan": f"WITH {_LOG}, {_view('v', _BEFORE)} SELECT _seq, id, event_type, value FROM v",
    "get_at": f"WITH {_LOG}, {_view('v', _BEFORE)} SELECT id, event_type, value FROM v WHERE id = (SELECT min(id) FROM v)",
    "find_at": f"WITH {_LOG}, {_view('v', _BEFORE)} SELECT id, value FROM v WHERE event_type = 'click'",
    "read_physical": f"WITH {_LOG} SELECT _seq, id, event_type, value FROM log WHERE _seq = 3 AND NOT _deleted",
    "metrics_counts": "SELECT 'customer' AS model, count(*) AS rows FROM customer UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'orders', count(*) FROM orders",
    "metrics_totals": "SELECT CAST(3 AS BIGINT) AS model_count, (SELECT count(*) FROM customer) + (SELECT count(*) FROM events) + (SELECT count(*) FROM orders) AS total_rows",
    "live_count": f"WITH {_LOG}, {_view('v')} SELECT count(*) AS count FROM v",
    "storage_stats": f"WITH {_LOG}, {_view('v')}, s AS (SELECT (SELECT count(*) FROM log) AS total_rows, (SELECT count(*) FROM v) AS active_rows) SELECT total_rows, active_rows, total_rows - active_rows AS dead_rows, (total_rows - active_rows) / total_rows AS dead_ratio, (total_rows - active_rows) / total_rows >= 0.3 AS needs_compaction FROM s",
    "compacted": f"WITH {_LOG}, {_view('v')} SELECT row_number() OVER (ORDER BY _seq) - 1 AS _seq, false AS _deleted, id, event_type, value FROM v",
    "change_feed": f"WITH {_LOG}, {_FEED} SELECT \"offset\", 'Event' AS model, kind, id, event_type, value FROM f",
    "subscription_filter": f"WITH {_LOG}, {_FEED} SELECT \"offset\", kind, id, value FROM f WHERE event_type = 'click'",
    "live_query_delta": f"WITH {_LOG}, {_view('v', _BEFORE, 'NOT _deleted AND value > 50')}, {_view('w', 'true', 'NOT _deleted AND value > 50')} SELECT CASE WHEN v.id IS NULL THEN 'Added' WHEN w.id IS NULL THEN 'Removed' ELSE 'Updated' END AS change, coalesce(w.id, v.id) AS id, CASE WHEN w.id IS NULL THEN v.event_type ELSE w.event_type END AS event_type, CASE WHEN w.id IS NULL THEN v.value ELSE w.value END AS value FROM v FULL JOIN w ON v.id = w.id WHERE v.id IS NULL OR w.id IS NULL OR v.event_type IS DISTINCT FROM w.event_type OR v.value IS DISTINCT FROM w.value",
    "live_query_init": f"WITH {_LOG}, {_view('w', _BEFORE, 'NOT _deleted AND value > 50')} SELECT 'Added' AS change, id FROM w",
    "pitr_replay": f"WITH {_LOG}, {_view('v', '_seq < (SELECT n * 3 // 4 FROM h)')} SELECT id, value FROM v",
    "replication_page": f"WITH {_LOG} SELECT _seq + 1 AS \"offset\", CASE WHEN _deleted THEN 'deleted' ELSE 'updated' END AS kind, id, event_type, value FROM log WHERE _seq >= (SELECT half FROM h) ORDER BY _seq LIMIT 100",
    "replication_tail": f"WITH {_LOG} SELECT _seq + 1 AS \"offset\", id FROM log WHERE _seq >= (SELECT half FROM h)",
    "retention": f"WITH {_LOG} SELECT _seq + 1 AS \"offset\", CASE WHEN _deleted THEN 'deleted' ELSE 'updated' END AS kind FROM log WHERE _seq >= (SELECT half FROM h)",
    "feed_caught_up": f"WITH {_LOG} SELECT _seq + 1 AS \"offset\", CASE WHEN _deleted THEN 'deleted' ELSE 'updated' END AS kind, id, value FROM log WHERE _seq >= (SELECT half FROM h)",
    "follower_state": f"WITH {_LOG}, {_view('v')} SELECT _seq, id, value FROM v",
    "backup_restored": f"WITH {_LOG}, {_view('v')} SELECT _seq, id, event_type, value FROM v",
    "committed_log": f"WITH {_LOG}, {_view('v')} SELECT _seq, id, event_type, value FROM v",
    "store_compacted": f"WITH {_LOG}, {_view('v')} SELECT row_number() OVER (ORDER BY _seq) - 1 AS _seq, false AS _deleted, id, event_type, value FROM v",
    "store_maintained": f"WITH {_LOG}, {_view('v')} SELECT row_number() OVER (ORDER BY _seq) - 1 AS _seq, false AS _deleted, id, event_type, value FROM v",
    "migrated_log": "SELECT c_custkey AS id, c_name AS label, c_mktsegment FROM customer",
    "schema_changes": "SELECT * FROM (VALUES ('change_projection', 'Customer', '', '', false), ('rename_field', 'Customer', 'c_name', 'label', true)) AS t(kind, model, name, renamed, breaking)",
    "transaction_cascade": f"WITH {_ORDERS} SELECT o_orderkey AS id, o_custkey AS customer FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "transaction_committed": "SELECT event_id AS id, user_id AS user, value FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING max(CASE WHEN event_type = 'purchase' THEN value END) >= 150)",
}
