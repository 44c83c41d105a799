"""Traversal of foreign keys and junctions, and what deleting a parent does. Plain equi-joins, whole tables at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import views
from .spread import kept

MAX_DEPTH = 64


def forward(children: DataFrame, fk: str, parents: DataFrame, parent_id: str, name: str) -> DataFrame:
    """children with their parent as a struct; null where the key is null or dangles."""
    packed = parents.select(F.col(parent_id).alias("__id"), F.struct(*parents.columns).alias(name))
    return children.join(packed, children[fk] == packed["__id"], "left").drop("__id")


def reverse(parents: DataFrame, parent_id: str, children: DataFrame, fk: str) -> DataFrame:
    """The children of the given parents."""
    return children.join(parents.select(F.col(parent_id).alias("__id")).distinct(), children[fk] == F.col("__id"), "left_semi")


def across(pairs: DataFrame, left: str, right: str, lefts: DataFrame, left_id: str, rights: DataFrame, right_id: str) -> DataFrame:
    """(left, first_seq, the right row's columns) over linked pairs; links to rows that aren't there are dropped."""
    near = pairs.join(lefts.select(F.col(left_id).alias("__l")).distinct(), pairs[left] == F.col("__l"), "left_semi")
    return near.join(rights, near[right] == rights[right_id]).select(F.col(left).alias("from_id"), "first_seq", *[rights[c] for c in rights.columns])


def across_at(links: DataFrame, left: str, right: str, lefts: DataFrame, left_id: str, rights: DataFrame, right_id: str, links_mark: int, rights_mark: int) -> DataFrame:
    """across() as of a snapshot: links is the junction's log before links_mark, rights the other model's log before rights_mark."""
    linked = views.pairs(links, left, right, links_mark)
    return across(linked, left, right, lefts, left_id, views.as_of(rights, [right_id], rights_mark).drop(views.SEQ), right_id)


def with_relations(rows: DataFrame, refs: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """rows with each forward reference (fk -> parents, their id) as a struct fk_row."""
    for fk, (parents, parent_id) in refs.items():
        rows = forward(rows, fk, parents, parent_id, f"{fk}_row")
    return rows


def dangling(children: DataFrame, fk: str, parents: DataFrame, parent_id: str) -> DataFrame:
    """Rows whose key is set and finds no parent."""
    return children.filter(F.col(fk).isNotNull()).join(parents.select(F.col(parent_id).alias("__id")), children[fk] == F.col("__id"), "left_anti")


def restricted(doomed: DataFrame, parent_id: str, children: DataFrame, fk: str) -> DataFrame:
    """Of the rows to delete those that still have children."""
    return doomed.join(children.select(F.col(fk).alias("__fk")).distinct(), doomed[parent_id] == F.col("__fk"), "left_semi")


def nulled(doomed: DataFrame, parent_id: str, children: DataFrame, fk: str) -> DataFrame:
    """The children of doomed rows, their key set to null: the versions to append."""
    return reverse(doomed, parent_id, children, fk).withColumn(fk, F.lit(None).cast(children.schema[fk].dataType))


def cascade(doomed: DataFrame, child_links: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(id, depth) of doomed (id) and all that hangs below it over child_links (child, parent).

    One semi-join a level; levels are written to the shared folder. Deeper than max_depth is refused with
    RecursionError, and a row is visited once, so a cycle ends.
    """
    seen = kept(doomed.select("id").distinct().withColumn("depth", F.lit(0)))
    front, depth = seen, 0
    while True:
        below = child_links.join(front.select(F.col("id").alias("parent")), "parent", "left_semi").select(F.col("child").alias("id")).distinct()
        front = kept(below.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth + 1)))
        if not front.limit(1).count():
            return seen
        depth += 1
        if depth > max_depth:
            raise RecursionError(f"a cascade deeper than {max_depth}")
        seen = kept(seen.unionByName(front))
