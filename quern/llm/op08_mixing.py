"""Mixing sources to target weights by the cube method.

Each source has a target of words. With r = target / size of the source, each of its documents is taken floor(r) times,
and once more with probability r - floor(r). The cube method decides which: it moves the probabilities of three
documents at a time along the direction that keeps their number and their words, until one of them is 0 or 1, and goes
on with the next. So a source's expected words and documents are met but for the last few documents of a group.

Groups are blocks of about BLOCK documents of one source, so a source of any share of the rows is worked on by many
tasks. A block decides its longest documents first and leaves its OPEN shortest to the next level, with the two that
the flight left open, and so on until one block a source is left; its last documents are the landing problem: the
rounding that is nearest in words and documents, in the best of TRIALS draws of this last, small block, and then single
documents of it turned over as long as that brings words and documents nearer still.
Draws are seeded by source, level and block, and blocks are hashes of the rows' contents: reruns agree. Rows that are equal
in all columns are one with a number of copies; each copy is decided by itself. Sources are a table, never a list of
the driver's, so there may be any number of them.
"""

from __future__ import annotations

import hashlib
import itertools
import random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import K1, K2, cut, lookup, numbered, repeated_rows, row_keys
from .op04_fingerprint import words_of

BLOCK, OPEN, TRIALS = 1000, 10, 12
SHARE, MOST = 1.5, 2.0
WEIGHTS = [5.0, 2.0, 1.0]
NEAR = 1e-9
_SOURCE = ["__none", "__source"]


def targets_of(sized: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """(_SOURCE, n, words, target) for each source of sized (_SOURCE, size, copies), weighed in turn by code point, null last.

    share times all words is dealt by weight; a target stops at most times its source's words, and the excess is dealt
    again among the others until none is above. What is dealt to a weight of 1 grows with each round, so a round is one
    sum over the sources that are full at it.
    """
    sums = sized.groupBy(*_SOURCE).agg(F.sum("copies").alias("n"), F.sum(F.col("size") * F.col("copies")).alias("words"))
    places = numbered(sums, [F.col(c) for c in _SOURCE], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = cut(places.select(*_SOURCE, "n", "words", weight.alias("weight")))
    top, total = F.lit(most) * F.col("words"), share * (sources.agg(F.sum("words")).first()[0] or 0)
    unit, full, closed = 0.0, F.lit(False), -1
    while True:
        r = sources.agg(F.count(F.when(full, 1)).alias("closed"), F.coalesce(F.sum(F.when(full, top)), F.lit(0.0)).alias("held"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open")).first()
        if r.closed == closed or not r.open:
            break
        closed, unit = r.closed, (total - r.held) / r.open
        full = F.lit(unit) * F.col("weight") > top
    return sources.select(*_SOURCE, "n", "words", F.when(full, top).otherwise(F.lit(unit) * F.col("weight")).alias("target"))


def flight(p: list[float], size: list[int], rng: random.Random) -> list[float]:
    """Probabilities after the flight phase: all but two at most are 0 or 1, their sum and their words are kept."""
    p = list(p)
    active: list[int] = []
    for i in range(len(p)):
        if NEAR < p[i] < 1 - NEAR:
            active.append(i)
        while len(active) == 3:
            a, b, c = active
            u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            if not any(u):
                u = (1, -1, 0)
            up = min((1 - p[k]) / v if v > 0 else p[k] / -v for k, v in zip(active, u, strict=True) if v)
            down = min(p[k] / v if v > 0 else (1 - p[k]) / -v for k, v in zip(active, u, strict=True) if v)
            step = up if rng.random() * (up + down) < down else -down
            for k, v in zip(active, u, strict=True):
                p[k] += step * v
                p[k] = 0.0 if p[k] < NEAR else 1.0 if p[k] > 1 - NEAR else p[k]
            active = [k for k in active if 0 < p[k] < 1]
    return p


def land(p: list[float], size: list[int]) -> list[float]:
    """The OPEN + 2 open ones at most, rounded so that words, in mean sizes, and documents stay nearest."""
    open_ = [i for i, x in enumerate(p) if 0 < x < 1]
    want, many = sum(p[i] * size[i] for i in open_), sum(p[i] for i in open_)
    mean = sum(size[i] for i in open_) / len(open_) if open_ else 1
    far = lambda s: abs(sum(size[i] for x, i in zip(s, open_, strict=True) if x) - want) / mean + abs(sum(s) - many) / 20
    best = min(itertools.product((0, 1), repeat=len(open_)), key=lambda s: (far(s), s))
    out = list(p)
    for i, x in zip(open_, best, strict=True):
        out[i] = float(x)
    return out


def settle(p: list[float], size: list[int], words: float, many: float) -> list[float]:
    """A landed sample with single documents turned over, the best first, as long as words (in mean sizes) and documents come nearer."""
    out, mean = list(p), max(sum(size) / max(len(size), 1), 1e-9)
    over, extra = sum(x * n for x, n in zip(out, size, strict=True)) - words, sum(out) - many
    far = lambda a, b: abs(a) / mean + abs(b) / 20
    turn = lambda k: (1 if out[k] == 0 else -1)
    while out:
        i = min(range(len(out)), key=lambda k: far(over + turn(k) * size[k], extra + turn(k)))
        after = over + turn(i) * size[i], extra + turn(i)
        if far(*after) >= far(over, extra) - NEAR:
            break
        out[i] = 1 - out[i]
        over, extra = after
    return out


def _mixed_rows(docs: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """(K1, K2, doc_id, source, size, source_size, target, copies): each row of docs (doc_id, text, source), by its content key."""
    nothing = F.col("source").isNull().alias(_SOURCE[0]), F.coalesce("source", F.lit("")).alias(_SOURCE[1])
    # doc_id is without nulls on the way: pandas would turn it into floats
    some_id, no_id = F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.col("doc_id").isNull().alias("__no_id")
    keyed = docs.select(some_id, no_id, *nothing, F.size(words_of(F.col("text"))).cast("long").alias("size"), *[c.alias(k) for k, c in row_keys(docs).items()])
    columns = keyed.columns
    sized = cut(keyed.groupBy(*columns).agg(F.count("*").alias("copies")))
    sources = cut(targets_of(sized, weights, share, most))
    ends = sources.agg(F.max("n").alias("most"), F.sum("n").alias("total")).first()
    most_rows, total = ends.most or 0, ends.total or 0
    placed = lookup(repeated_rows(sized, "copies", "__nth"), sources, _SOURCE, ["n", "words", "target"], "n", total).withColumnRenamed("words", "source_size")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = placed.withColumn("ratio", ratio).withColumns({"base": F.floor("ratio").cast("int"), "p": F.when(F.col("size") > 0, F.col("ratio") - F.floor("ratio")).otherwise(0.0)})
    rows = cut(rows.withColumn("p", F.when(F.col("p") < NEAR, 0.0).when(F.col("p") > 1 - NEAR, 1.0).otherwise(F.col("p"))).drop("ratio"))
    done, left, level = [rows.filter("p = 0 or p = 1").drop("n")], rows.filter("p > 0 and p < 1"), 0
    while True:
        last = most_rows <= BLOCK
        blocks = F.lit(1) if last else F.greatest(F.ceil(F.col("n") / BLOCK), F.lit(1))
        keyed = left.withColumn("block", F.pmod(F.xxhash64(F.lit(level), K1, K2, "__nth"), blocks))
        flown = cut(keyed.groupBy(*_SOURCE, "block").applyInPandas(_flier(level, last), keyed.drop("block").schema))
        done.append(flown.filter("p = 0 or p = 1").drop("n"))
        if last:
            break
        most_rows = (OPEN + 2) * -(-most_rows // BLOCK)
        level, left = level + 1, flown.filter("p > 0 and p < 1").withColumn("n", (OPEN + 2) * F.ceil(F.col("n") / BLOCK))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    copies = F.when(F.col("size") > 0, F.col("base") + F.col("p").cast("int")).otherwise(0)
    return out.select(K1, K2, F.when(~F.col("__no_id"), F.col("doc_id")).alias("doc_id"), F.when(~F.col(_SOURCE[0]), F.col(_SOURCE[1])).alias("source"), "size", "source_size", "target", copies.alias("copies"))


def _flier(level: int, last: bool):
    def fly(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        seed = int.from_bytes(hashlib.sha256("|".join(map(str, (key[0], key[1], level, key[2]))).encode()).digest()[:8], "big")
        pdf = pdf.sort_values([K1, K2, "__nth"], kind="stable").reset_index(drop=True)
        p, size = pdf["p"].tolist(), pdf["size"].tolist()
        words, best = sum(x * n for x, n in zip(p, size, strict=True)), None
        for trial in range(TRIALS if last else 1):
            rng = random.Random(seed + trial)
            order = sorted(range(len(pdf)), key=lambda i: (-size[i], rng.random()))
            cut_at, sizes = max(0, len(order) - OPEN), [size[i] for i in order]
            out = flight([p[i] for i in order[:cut_at]], sizes[:cut_at], rng) + [p[i] for i in order[cut_at:]]
            if last:
                out = land(out, sizes)
            error = abs(sum(x * n for x, n in zip(out, sizes, strict=True)) - words)
            if best is None or error < best[0]:
                best = error, order, out
        _, order, out = best
        if last:
            out = settle(out, [size[i] for i in order], words, sum(p))
        back = [0.0] * len(order)
        for i, x in zip(order, out, strict=True):
            back[i] = x
        return pdf.assign(p=back).drop(columns="block", errors="ignore")

    return fly


def mix(docs: DataFrame, weights: list[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of each row of docs (doc_id, text, source).

    Null texts have no words; documents of size 0 are never taken. The null source is one source, the last. Repeated
    rows are rows of their own, and so are rows without doc_id. Draws depend on all columns of docs. An empty table gives
    an empty one.
    """
    return _mixed_rows(docs, weights, share, most).drop(K1, K2)


def mixed_documents(docs: DataFrame, weights: list[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mix itself: docs without what is not taken, and with what is taken twice twice. Rows that are equal in all columns share their copies."""
    copies = cut(_mixed_rows(docs, weights, share, most).groupBy(K1, K2).agg(F.sum("copies").alias("copies")).filter("copies > 0"))
    named = [F.col(c).alias(f"__c{i}") for i, c in enumerate(docs.columns)]
    keyed = docs.select(*named, *[c.alias(k) for k, c in row_keys(docs).items()])
    rows = keyed.groupBy(K1, K2).agg(*[F.first(f"__c{i}").alias(f"__c{i}") for i in range(len(named))])
    out = repeated_rows(rows.join(copies.withColumnRenamed("copies", "__copies").hint("merge"), [K1, K2]), "__copies")
    return out.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
