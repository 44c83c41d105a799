"""Writes as batches: rows to append to a log, checked as a whole before they are.

A batch is checked against the live view and against itself with joins and groupings; whatever breaks a rule comes back
as rows, (rule, key). An empty result is the licence to append. Deletes and updates of ids that aren't live are left
out, as the row-wise interface answers them with "no such row".
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import violations
from ..plans.catalog import Catalog
from ..sources.segments import Head, Overtaken, Store
from . import relations, views
from .spread import kept, numbered

#: Kind of a failed check -> status of the wire interface.
STATUS = {"constraint": 422, "unique": 409, "foreign_key": 409, "restrict": 409, "conflict": 409}


def broken_constraints(catalog: Catalog, model: str, batch: DataFrame) -> DataFrame:
    """(kind, rule, key) for each rule that a row of batch breaks; one pass."""
    m = catalog.models[model]
    rules = [x for f in m.fields if f.stored for x in violations(f) if f.name in batch.columns]
    named = F.filter(F.array(*[F.when(broken, F.lit(rule)) for rule, broken in rules]) if rules else F.array().cast("array<string>"), lambda x: x.isNotNull())
    return batch.select(F.lit("constraint").alias("kind"), F.explode(named).alias("rule"), F.col(m.id).cast("string").alias("key"))


def broken_unique(catalog: Catalog, model: str, batch: DataFrame, live: DataFrame, distinct: bool = False) -> DataFrame:
    """(kind, rule, key): values of unique fields and ids that two rows of batch share, or one and a live row of another id.

    distinct says that the ids of batch are known to differ, which spares their grouping.
    """
    m = catalog.models[model]
    again = batch.groupBy(m.id).count().filter("count > 1") if not distinct else batch.filter(F.lit(False))
    out = again.select(F.lit("unique").alias("kind"), F.lit(f"{m.id} &").alias("rule"), F.col(m.id).cast("string").alias("key"))
    for f in m.fields:
        if f.unique and f.name != m.id:
            rest = live.join(batch.select(m.id), m.id, "left_anti").select(m.id, f.name)
            both = batch.select(m.id, f.name, F.lit(1).alias("new")).unionByName(rest.withColumn("new", F.lit(0))).filter(F.col(f.name).isNotNull())
            clash = both.groupBy(f.name).agg(F.count("*").alias("n"), F.sum("new").alias("new"), F.max(m.id).alias("key")).filter("n > 1 and new > 0")
            out = out.unionByName(clash.select(F.lit("unique").alias("kind"), F.lit(f"{f.name} &").alias("rule"), F.col("key").cast("string").alias("key")))
    return out


def broken_keys(catalog: Catalog, model: str, batch: DataFrame, parents: dict[str, DataFrame]) -> DataFrame:
    """(kind, rule, key): foreign keys of batch that find no live parent. parents: model -> live rows."""
    m, out = catalog.models[model], None
    for f in m.fields:
        if f.kind == "one":
            bad = relations.dangling(batch, f.name, parents[f.target], catalog.models[f.target].id)
            bad = bad.select(F.lit("foreign_key").alias("kind"), F.lit(f"{f.name} *").alias("rule"), F.col(m.id).cast("string").alias("key"))
            out = bad if out is None else out.unionByName(bad)
    return batch.sparkSession.createDataFrame([], "kind string, rule string, key string") if out is None else out


def inserts(log: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    """Versions of new rows, numbered from the log's end on in the given order."""
    return _versions(log, batch.withColumn(views.DELETED, F.lit(False)), order)


def _heads_of(log: DataFrame, keys: list[str], ids: DataFrame) -> DataFrame:
    """views.heads() of these ids; versions of other ids are left out before anything is looked at."""
    return views.heads(log.join(ids.select(*keys).distinct(), keys, "left_semi"), keys)


def updates(log: DataFrame, keys: list[str], batch: DataFrame) -> DataFrame:
    """Superseding versions of the rows whose id is live."""
    known = _heads_of(log, keys, batch).select(*keys)
    return _versions(log, kept(batch.join(known, keys, "left_semi").withColumn(views.DELETED, F.lit(False))), keys)


def deletes(log: DataFrame, keys: list[str], ids: DataFrame) -> DataFrame:
    """Tombstones: copies of the live rows of these ids, marked as deleted."""
    return _tombstones(log, keys, _heads_of(log, keys, ids))


def _tombstones(log: DataFrame, keys: list[str], heads: DataFrame) -> DataFrame:
    """deletes() of the rows that heads names. They are kept, as numbering reads them twice."""
    return _versions(log, kept(views.rows_of(log, keys, heads).drop(views.SEQ).withColumn(views.DELETED, F.lit(True))), keys)


def _versions(log: DataFrame, rows: DataFrame, order: list[str]) -> DataFrame:
    """rows numbered from the log's end on, in the log's columns and types."""
    return numbered(rows, order, views.length(log)).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in log.schema])


def links(junction: DataFrame, pairs: DataFrame, left: str, right: str, unlink: bool = False) -> DataFrame:
    """Entries that link the pairs, or that retract those of them that are linked."""
    wanted = pairs.select(left, right).distinct()
    if unlink:
        wanted = wanted.join(views.pairs(junction, left, right), [left, right], "left_semi")
    return _versions(junction, wanted.withColumn(views.DELETED, F.lit(unlink)), [left, right])


def unlink_all(junction: DataFrame, rows: DataFrame, side: str, left: str, right: str) -> DataFrame:
    """Entries that retract every linked pair of these rows, given by column side, which is left or right."""
    linked = views.pairs(junction.join(rows.select(side).distinct(), side, "left_semi"), left, right)
    return _versions(junction, linked.select(left, right).withColumn(views.DELETED, F.lit(True)), [left, right])


class Refused(Exception):
    """A transaction that breaks rules or conflicts; rows has up to 20 of the broken ones."""

    def __init__(self, kind: str, rows: list):
        super().__init__(kind, rows)
        self.status, self.rows = STATUS[kind], rows


@dataclass
class Transaction:
    """Staged versions of several models over fixed logs: all of them or none.

    logs are the committed logs; reads inside the transaction go to log(model), which has the staged versions too. Checks
    run over the staged state as a whole in validate(). A transaction that Transaction.begin() made on a store writes with
    commit(): one manifest entry for all models.
    """

    catalog: Catalog
    logs: dict[str, DataFrame]
    added: dict[str, DataFrame] = field(default_factory=dict)
    store: Store | None = None
    base: Head | None = None

    @classmethod
    def begin(cls, catalog: Catalog, store: Store) -> Transaction:
        """Over all models' logs as they are now; what others commit later is not seen until commit() checks against it."""
        base = store.head()
        return cls(catalog, {m: base.log(m, log_schema(catalog, m)) for m in catalog.models}, store=store, base=base)

    def commit(self, checked: bool = False) -> int:
        """Validates and writes all staged versions; the commit's number. The first committer wins.

        Others' commits since begin() are conflicts if they wrote an id that is written here, or compacted a log that is
        written here; else the staged versions are numbered on behind them, and checked again over the logs as they are then.
        The manifest entry is created under the next number only if nobody else has; if somebody has, it all
        begins again with what they wrote. A Refused transaction has left nothing that a reader could see.
        """
        if self.store is None or self.base is None:
            raise ValueError("begin() the transaction on a store")
        if not checked:
            self.validate()
        if not self.added:
            return self.base.number
        while True:
            now, moved = self.store.head(), {}
            for m, versions in self.added.items():
                if now.epoch(m) != self.base.epoch(m):
                    raise Refused("conflict", [(m, "compacted")])
                key, at = self.catalog.models[m].id, self.base.watermark(m)
                if now.watermark(m) > at and (bad := conflicts(now.log(m, log_schema(self.catalog, m)), at, versions, [key]).limit(20).collect()):
                    raise Refused("conflict", bad)
                moved[m] = versions.withColumn(views.SEQ, F.col(views.SEQ) + (now.watermark(m) - at))
            if now.number != self.base.number:
                logs = {m: now.log(m, log_schema(self.catalog, m)) for m in self.catalog.models}
                Transaction(self.catalog, logs, moved).validate()
            try:
                return self.store.commit(moved, head=now)
            except Overtaken:
                continue

    def log(self, model: str) -> DataFrame:
        return self.logs[model].unionByName(self.added[model]) if model in self.added else self.logs[model]

    def live(self, model: str) -> DataFrame:
        return views.live(self.log(model), [self.catalog.models[model].id]).drop(views.SEQ)

    def _ids(self, model: str) -> DataFrame:
        """The ids of live(model), without its rows."""
        key = self.catalog.models[model].id
        return views.narrow(self.log(model), [key], []).select(key)

    def stage(self, model: str, versions: DataFrame) -> None:
        """versions are numbered from the log's end on and stand in the shared folder, as inserts(), updates() and deletes() of log(model) give them."""
        self.added[model] = self.added[model].unionByName(versions) if model in self.added else versions

    def insert(self, model: str, batch: DataFrame) -> None:
        self.stage(model, inserts(self.log(model), batch, [self.catalog.models[model].id]))

    def update(self, model: str, batch: DataFrame) -> None:
        self.stage(model, updates(self.log(model), [self.catalog.models[model].id], batch))

    def delete(self, model: str, ids: DataFrame, depth: int = 0) -> None:
        """Deletes with what on_delete asks for: restrict refuses, set_null and cascade stage further versions."""
        key = [self.catalog.models[model].id]
        self._delete(model, kept(_heads_of(self.log(model), key, ids)), depth)

    def _delete(self, model: str, doomed: DataFrame, depth: int) -> None:
        """delete() of the live rows that doomed, of views.heads(), names. Each level's ids and numbers are kept, so no step plans the ones above it again."""
        if depth > relations.MAX_DEPTH:
            raise RecursionError(f"a cascade deeper than {relations.MAX_DEPTH}")
        parent_id, before = self.catalog.models[model].id, self.added.get(model)
        for child, f in self.catalog.children(model):
            log = self.log(child.name)
            rows = views.narrow(log, [child.id], [f.name])
            if f.on_delete == "restrict":
                if held := relations.restricted(doomed, parent_id, rows, f.name).select(parent_id).limit(20).collect():
                    raise Refused("restrict", held)
                continue
            below = kept(relations.reverse(doomed, parent_id, rows, f.name).select(child.id, views.SEQ))
            if below.isEmpty():
                continue
            if f.on_delete == "set_null":
                nulled = views.rows_of(log, [child.id], below).withColumns({f.name: F.lit(None).cast(log.schema[f.name].dataType), views.DELETED: F.lit(False)})
                self.stage(child.name, _versions(log, kept(nulled.drop(views.SEQ)), [child.id]))
            else:
                self._delete(child.name, below, depth + 1)
        log = self.log(model)
        self.stage(model, _tombstones(log, [parent_id], doomed) if self.added.get(model) is before else deletes(log, [parent_id], doomed))

    def validate(self) -> None:
        """Refused at the first kind of rule that staged live rows break.

        Staged versions come after all of the log, so the live rows of their ids are found among them alone; where no id is
        staged twice these are the versions themselves.
        """
        for model, versions in self.added.items():
            m = self.catalog.models[model]
            once = versions.groupBy(m.id).count().filter("count > 1").isEmpty()
            written = versions.filter(~F.col(views.DELETED) & F.col(m.id).isNotNull())
            if once and written.isEmpty():
                continue
            fresh = written.drop(views.SEQ, views.DELETED) if once else kept(views.live(versions, [m.id]).drop(views.SEQ))
            parents = {f.target: self._ids(f.target) for f in m.fields if f.kind == "one"}
            checks = [("constraint", broken_constraints(self.catalog, model, fresh)), ("unique", broken_unique(self.catalog, model, fresh, self.live(model), once)), ("foreign_key", broken_keys(self.catalog, model, fresh, parents))]
            if not once:
                checks.append(("conflict", versions.groupBy(m.id, views.SEQ).count().filter("count > 1")))
            for kind, rows in checks:
                if bad := rows.limit(20).collect():
                    raise Refused(kind, bad)


def log_schema(catalog: Catalog, model: str) -> T.StructType:
    """The columns of a model's log."""
    fields = [T.StructField(views.SEQ, T.LongType()), T.StructField(views.DELETED, T.BooleanType())]
    return T.StructType([*fields, *catalog.schema(model).fields])


def conflicts(log: DataFrame, snapshot: int, written: DataFrame, keys: list[str]) -> DataFrame:
    """First committer wins: of the keys that a transaction wrote those that others committed after its snapshot."""
    return written.select(*keys).distinct().join(log.filter(F.col(views.SEQ) >= snapshot).select(*keys), keys, "left_semi")


def retrying(attempt, retries: int = 3):
    """attempt() again after a conflict, so many times; other refusals pass through."""
    for left in range(retries, -1, -1):
        try:
            return attempt()
        except Refused as e:
            if e.args[0] != "conflict" or not left:
                raise
