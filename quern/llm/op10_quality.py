"""Quality rules whose cutoffs are chosen under a bound on false rejection.

Base rules are fixed. Beyond them each rule has a score, a direction and a grid of cutoffs from mild to strict, fixed
beforehand; step t of the method rejects what any rule rejects by its t-th cutoff, so the steps are nested. On labelled
documents (quality 1 or 0) that pass the base rules, each stratum walks the steps from the mild end while an exact
binomial (Clopper-Pearson) upper bound on the share of good documents that the step rejects stays within RISK; it
keeps the strictest step before the first failure. Walking a fixed order spends no further error, and the strata share the
error by Bonferroni, so that with probability 1 - ERROR no stratum loses more than RISK of its good documents by the
rules together. A stratum with too few good labels to prove anything rejects nothing.

Labels are counted where they lie, bounds are worked out by tasks, and the steps are a table that documents join: any
number of strata will do, and one stratum may have most of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lookup

RISK, ERROR = 0.03, 0.05
SYMBOLS = "#*$%&|<>"
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: Rule -> (score from the features, cutoffs from mild to strict, as many for each rule); a score over its cutoff is rejected.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / n_words", [2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07]),
    "dup_lines": ("n_dup_lines / n_words", [0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.015, 0.01]),
    "repeat_words": ("n_repeat_words / n_words", [0.19, 0.18, 0.17, 0.16, 0.14, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03]),
    "long_words": ("word_chars / n_words", [40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 14.0, 13.0, 12.0, 11.0, 10.0, 9.0]),
    "short_words": ("- word_chars / n_words", [-1.25, -1.5, -1.75, -2.0, -2.25, -2.5, -2.75, -3.0, -3.25, -3.5, -4.0, -4.25]),
}


def text_features(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text; null counts as empty.

    bytes.split() splits at just the six characters that aren't part of words.
    """
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


def repeat_words(words: list[bytes], width: int = 5) -> int:
    """Words in windows of width words that are found twice or more. Words are numbered and windows packed into integers, both exactly."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    if len(number) == len(words):
        return 0
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    key, span = ids[:n].copy(), len(number)
    for j in range(1, width):
        if span * len(number) >= 1 << 62:
            key, span = np.unique(key, return_inverse=True)[1], n
        key = key * len(number) + ids[j : j + n]
        span *= len(number)
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    edge = np.zeros(len(words) + 1, np.int64)
    found = np.unique(np.concatenate([order[same], order[same + 1]]))
    edge[found] += 1
    edge[found + width] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without their text, and the features; columns of these names are replaced. One pass, no shuffle."""
    kept = [c for c in docs.columns if c not in {text, *FEATURES}]
    source = docs.select(*kept, F.col(text).alias("__text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_features(x.as_py()) for x in batch.column(len(kept))]
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], [*kept, *FEATURES])

    schema = source.drop("__text").schema
    for f in FEATURES:
        schema = schema.add(f, "long")
    return source.mapInArrow(task, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def upper_bound(k: int, n: int, error: float) -> float:
    """Clopper-Pearson: the p at which k or fewer of n have probability error. 1 if n is 0 or k is n."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        low, high = (low, p) if _binomial_cdf(k, n, p) < error else (p, high)
    return high


def _binomial_cdf(k: int, n: int, p: float) -> float:
    """Summed from the largest term down, so that far terms of a large n are left out."""
    if p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    mode = min(k, int((n + 1) * p))
    total = 0.0
    for steps in (range(mode, -1, -1), range(mode + 1, k + 1)):
        for i in steps:
            term = math.exp(log(i))
            total += term
            if term < 1e-18 * total:
                break
    return min(1.0, total)


def rejecting_step(rules: dict = RULES) -> Column:
    """The first step that rejects a document: that of the rule whose cutoffs its score passes first; the number of steps if none does."""

    def step(score: Column, cutoffs: list[float]) -> Column:
        return F.size(F.filter(F.array(*[F.lit(c) for c in cutoffs]), lambda c: score <= c))

    steps = [step(F.expr(score), cutoffs) for score, cutoffs in rules.values()]
    return F.least(*steps) if len(steps) > 1 else steps[0]


def choose_steps(labelled: DataFrame, stratum: str, good: str, rules: dict = RULES, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, step): the strictest proven step of each stratum that has one. labelled has doc_id, the features, the stratum and good (boolean).

    A document counts once in a stratum: as good if all its labels are, and as rejected by the strictest of its rows. The null
    stratum counts as one. A row for each stratum is what the tasks see after partial counts.
    """
    most = len(next(iter(rules.values()))[1])
    if any(len(cutoffs) != most for _, cutoffs in rules.values()):
        raise ValueError("rules need as many cutoffs each")
    one = labelled.filter(~base_failed()).groupBy("doc_id", F.col(stratum).alias("stratum")).agg(F.min(F.col(good).cast("int")).alias("good"), F.min(rejecting_step(rules)).alias("at"))
    counts = [F.count(F.when(F.col("at") <= t, 1)).alias(f"k{t}") for t in range(most)]
    strata = cut(one.filter("good = 1").groupBy("stratum").agg(F.count("*").alias("n"), *counts))
    each = error / max(strata.count(), 1)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, steps = [], []
            for row in batch.to_pylist():
                step = -1
                while step + 1 < most and upper_bound(row[f"k{step + 1}"], row["n"], each) <= risk:
                    step += 1
                if step >= 0:
                    names.append(row["stratum"])
                    steps.append(step)
            yield pa.RecordBatch.from_arrays([pa.array(names, batch.schema.field("stratum").type), pa.array(steps, pa.int32())], ["stratum", "step"])

    return strata.mapInArrow(walk, strata.select("stratum").schema.add("step", "integer"))


def apply_steps(featured: DataFrame, stratum: str, steps: DataFrame, rules: dict = RULES) -> DataFrame:
    """featured with base_failed and kept. A text without words fails the base rules. A stratum without a step keeps all others."""
    key = [F.col(stratum).isNull().alias("__none"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("__stratum")]
    sizes = featured.groupBy(*key).agg(F.count("*").alias("__n"))
    table = steps.select(F.col("stratum").isNull().alias("__none"), F.coalesce(F.col("stratum").cast("string"), F.lit("")).alias("__stratum"), "step").join(sizes, ["__none", "__stratum"])
    placed = lookup(featured.select("*", *key), table, ["__none", "__stratum"], ["step"], "__n", featured.count())
    failed = base_failed()
    rejected = F.coalesce(rejecting_step(rules) <= F.col("step"), F.lit(False))
    return placed.withColumns({"base_failed": failed, "kept": ~failed & ~rejected}).drop("__none", "__stratum", "step")


def quality(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """One row for each row of docs (doc_id, text, stratum); labels is (doc_id, quality 0 or 1).

    Null texts have no words and fail the base rules; labels that are null or of unknown documents are left out. A
    document with several labels counts once, as good if all of them are. Rows without doc_id have no label and are judged
    like others. Empty tables give empty results; without labels nothing but the base rules rejects.
    """
    featured = cut(with_features(docs.select("doc_id", "text", stratum)))
    good = labels.filter("quality is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    steps = cut(choose_steps(featured.join(good, "doc_id"), stratum, "good", risk=risk, error=error))
    return apply_steps(featured, stratum, steps)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality(docs, labels).select("doc_id", *FEATURES, "base_failed", "kept")
