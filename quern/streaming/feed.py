"""Change events, filtered subscriptions, live queries, replication and replay.

A feed is a log read as events: offset (1-based), model, kind (inserted, updated, deleted), and the row. Streams read the
log's segments with readStream; nothing is dropped for a slow reader.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import changed
from ..operators import views

#: Versions of an id are looked at in blocks of so many numbers.
BLOCK = 1 << 20


def events(log: DataFrame, keys: list[str], model: str) -> DataFrame:
    """offset, model, kind and the row of each version. A deleted event carries the row as it was before.

    The version before is looked up within blocks of BLOCK numbers of an id, and at a block's beginning in the last version
    of the id's block before, a row for each of them: an id of any number of versions is worked on by many tasks. Only the
    columns that are asked for take part.
    """
    fields, block = [views.DELETED, *views.fields_of(log)], F.floor(F.col(views.SEQ) / BLOCK).alias("__block")
    dealt = log.select("*", block)
    ends = dealt.groupBy(*keys, "__block").agg(F.max(views.SEQ).alias("__end"), *[F.max_by(c, views.SEQ).alias(f"__last_{c}") for c in fields if c not in keys])
    blocks, within = Window.partitionBy(*keys).orderBy("__block"), Window.partitionBy(*keys, "__block").orderBy(views.SEQ)
    carried = ends.select(*keys, "__block", F.lag("__end").over(blocks).alias("__known"), *[F.lag(f"__last_{c}").over(blocks).alias(f"__carry_{c}") for c in fields if c not in keys])
    first = F.col("__prior").isNull()
    laid = dealt.withColumns({"__prior": F.lag(views.SEQ).over(within), **{f"__was_{c}": F.lag(c).over(within) for c in fields if c not in keys}})
    known = laid.join(carried, [*keys, "__block"])
    was = lambda c: F.when(first, F.col(f"__carry_{c}")).otherwise(F.col(f"__was_{c}"))
    was_live = ~F.coalesce(was(views.DELETED), F.lit(True))
    gone = F.col(views.DELETED)
    kind = F.when(gone & was_live, "deleted").when(~gone & was_live, "updated").when(~gone, "inserted")
    row = [F.col(c) if c in keys else F.when(gone, was(c)).otherwise(F.col(c)).alias(c) for c in views.fields_of(log)]
    return known.withColumn("__kind", kind).filter("__kind is not null").select((F.col(views.SEQ) + 1).alias("offset"), F.lit(model).alias("model"), F.col("__kind").alias("kind"), *row)


def raw_events(log: DataFrame) -> DataFrame:
    """The log as a replication feed: an event for each version, row by row, so it works on streams too.

    Without a look at earlier versions kind tells updated (written in any way) from deleted.
    """
    return log.select((F.col(views.SEQ) + 1).alias("offset"), F.when(F.col(views.DELETED), "deleted").otherwise("updated").alias("kind"), *views.fields_of(log))


def watch_events(stream: DataFrame, read_log: Callable[[], DataFrame], keys: list[str], model: str, predicate: Column, sink: Callable[[DataFrame, int], None]):
    """A writer that hands sink each micro-batch's events() that pass predicate; only the batch's keys are looked up in the log."""

    def on_batch(batch: DataFrame, number: int) -> None:
        ends = batch.agg(F.min(views.SEQ).alias("low"), F.max(views.SEQ).alias("high")).first()
        if ends.high is not None:
            known = read_log().filter(F.col(views.SEQ) <= ends.high).join(batch.select(*keys).distinct(), keys, "left_semi")
            sink(subscription(events(known, keys, model).filter(F.col("offset") > ends.low), predicate), number)

    return stream.writeStream.foreachBatch(on_batch)


def subscription(feed: DataFrame, predicate: Column) -> DataFrame:
    """Events whose row passes the list predicate; works on streams as on tables."""
    return feed.filter(predicate)


def delta(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(change, keys, columns): Added and Updated rows as they are now, Removed ones as they were. One full outer join."""
    columns = [c for c in new.columns if c not in keys]
    a = old.select(*keys, F.struct(*columns).alias("o"))
    b = new.select(*keys, F.struct(*columns).alias("n"))
    change = F.when(F.col("o").isNull(), "Added").when(F.col("n").isNull(), "Removed").when(changed(columns, "o", "n"), "Updated")
    both = a.join(b, keys, "full").withColumn("change", change).filter("change is not null")
    return both.select("change", *keys, *[F.when(F.col("n").isNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in columns])


def live_query(log: DataFrame, keys: list[str], query: Callable[[DataFrame], DataFrame], low: int, high: int) -> DataFrame:
    """What query's result gains, changes and loses between two watermarks; from 0 all of it is Added: the initial state."""
    seen = lambda w: query(views.as_of(log, keys, w).drop(views.SEQ))
    return delta(seen(low), seen(high), keys)


def watch(stream: DataFrame, read_log: Callable[[], DataFrame], keys: list[str], query: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], row_wise: bool = True):
    """A writer that on each micro-batch of the log's stream hands sink the result's delta since the batch before.

    The watermark so far is the batch's own lower end, so a batch that is run again gives the same delta. A row_wise query
    (filters and columns of one row) is run over the versions of the batch's ids alone; any other one, with
    row_wise=False, over the whole log.
    """

    def on_batch(batch: DataFrame, number: int) -> None:
        ends = batch.agg(F.min(views.SEQ).alias("low"), F.max(views.SEQ).alias("high")).first()
        if ends.high is not None:
            log = read_log()
            if row_wise:
                log = log.join(batch.select(*keys).distinct(), keys, "left_semi")
            sink(live_query(log, keys, query, ends.low, ends.high + 1), number)

    return stream.writeStream.foreachBatch(on_batch)


def follow(log: DataFrame, keys: list[str], feed: DataFrame, boundary: int) -> DataFrame:
    """A follower's live rows: its log, then the feed's events after boundary by kind; events up to it are known."""
    rows = views.fields_of(log)
    tail = feed.filter(F.col("offset") > boundary).select(*rows, (F.col("offset") - 1).alias(views.SEQ), (F.col("kind") == "deleted").alias(views.DELETED))
    return views.live(log.select(*rows, views.SEQ, views.DELETED).filter(F.col(views.SEQ) < boundary).unionByName(tail), keys)


def replay(base: DataFrame, feed: DataFrame, keys: list[str], base_offset: int, target: int) -> DataFrame:
    """State at offset target: a backup's versions up to base_offset and the events after it, newest first."""
    return follow(base, keys, feed.filter(F.col("offset") <= target), base_offset)


def tail(feed: DataFrame, boundary: int) -> DataFrame:
    """What a resumed reader still has to see of a live stream: nothing up to the boundary it has replayed to."""
    return feed.filter(F.col("offset") > boundary)
