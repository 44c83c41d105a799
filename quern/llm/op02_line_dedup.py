"""Line dedup by a suffix array over line ids, DataFrame functions only.

A line's id is a 128-bit hash. The suffix array is built by prefix doubling: the rank at depth 2h of a position comes from
the pair of its rank at depth h and that of the position h lines on; distinct pairs are counted, sorted and numbered.
Positions of equal rank form a longest-common-prefix interval of that depth, and the suffixes whose first L lines agree
(h <= L < 2h) are the interval of depth L that the two overlapping ranks at depth h name: that of its first h and of its
last h lines. Intervals of one position can't be part of a repeat and are dropped at each depth, so all rounds but the
first work on repeated lines only. Depths double until no rank is there twice or no run as long is in question.

A run of lines is a later copy if the same lines begin earlier, by document, then by line. Every line of a later copy of
min_words words or more is deleted, whatever the lengths of the run and its lines. To delete the lines of all maximal
later copies it is enough to look at two runs for each line: the shortest that begins with it and has min_words words, and
the shortest that ends with it. Each lies within every maximal copy of min_words words that holds its first (last) line
and enough words after (before) it, is a later copy itself, and together they cover that maximal copy: a line has the
words either after or before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import K1, K2, cut, lookup, numbered, row_keys
from .op04_fingerprint import words_of

MIN_WORDS = 5


def lines_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, line, h1, h2, n_words) of the \\n-split lines of docs (doc_id, text, K1, K2), and (K1, K2, doc).

    doc numbers the documents in the order of doc_id, nulls last, then of their keys; rows with equal keys are one
    document. A null text has no lines.
    """
    rows = docs.filter("text is not null").select("doc_id", K1, K2, F.posexplode(F.split("text", "\n", -1)).alias("line", "s"))
    raw = cut(rows.select("doc_id", K1, K2, "line", F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(1), "s").alias("h2"), F.size(words_of(F.col("s"))).alias("n_words")))
    ids = raw.filter("line = 0").select("doc_id", K1, K2).distinct()
    numbers = cut(numbered(ids, [F.col("doc_id").asc_nulls_last(), F.col(K1), F.col(K2)], "doc").select(K1, K2, "doc"))
    once = raw.join(numbers, [K1, K2]).groupBy(K1, K2, "line").agg(*[F.first(c).alias(c) for c in ("doc", "h1", "h2", "n_words")])
    return cut(once.select("doc", "line", "h1", "h2", "n_words")), numbers


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The repeated keys of rows, in order: rank, n (positions) and the first position (doc, line)."""
    names = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct("doc", "line")).alias("first")).filter("n > 1")
    return cut(names.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()))


def _intervals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows that share their keys with others, with rank and first."""
    return lookup(rows, _named(rows, keys), keys, ["rank", "first"], "n", rows.count()).filter("rank is not null")


def _at(column: str, step: int) -> Column:
    """column's value exactly step lines on, else null."""
    return F.max(column).over(Window.partitionBy("doc").orderBy("line").rangeBetween(step, step))


def shortest_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """(doc, s, e): for each of lines (doc, line, n_words) the shortest runs of min_words words that begin and that end with it.

    Runs lie within islands of consecutive lines. One sort by words so far finds where each run ends, another where it
    begins: lines and questions are rows of one order, and a running least (greatest) line answers.
    """
    island = (F.col("line") - F.row_number().over(Window.partitionBy("doc").orderBy("line"))).alias("island")
    laid = lines.select("doc", "line", "n_words", island)
    so_far = laid.withColumn("upto", F.sum("n_words").over(Window.partitionBy("doc", "island").orderBy("line")))
    so_far = cut(so_far.withColumn("before", F.col("upto") - F.col("n_words")))

    def answers(key: Column, question: Column, backwards: bool) -> DataFrame:
        both = so_far.select("doc", "island", "line", F.explode(F.array(F.struct(key.alias("k"), F.lit(0).alias("asks")), F.struct(question.alias("k"), F.lit(1).alias("asks")))).alias("x")).select("doc", "island", "line", "x.*")
        order = Window.partitionBy("doc", "island").orderBy(F.col("k").desc() if backwards else F.col("k"), "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        line = F.when(F.col("asks") == 0, F.col("line"))
        found = both.withColumn("other", (F.min(line) if backwards else F.max(line)).over(order)).filter("asks = 1 and other is not null")
        return found.select("doc", *([F.col("line").alias("s"), F.col("other").alias("e")] if backwards else [F.col("other").alias("s"), F.col("line").alias("e")]))

    begins = answers(F.col("upto"), F.col("before") + min_words, True)
    ends = answers(F.col("before"), F.col("upto") - min_words, False)
    return begins.unionByName(ends).distinct()


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(doc, s, e) of runs to delete that cover all lines to delete, and (K1, K2, doc). docs has doc_id, text, K1 and K2."""
    lines, numbers = lines_of(docs)
    now = cut(_intervals(lines, ["h1", "h2"]).select("doc", "line", "n_words", "rank", "first"))
    runs = cut(shortest_runs(now, min_words))
    found = [now.filter((F.col("n_words") >= min_words) & (F.col("first") < F.struct("doc", "line"))).select("doc", F.col("line").alias("s"), F.col("line").alias("e"))]
    longest, h = (runs.agg(F.max(F.col("e") - F.col("s") + 1)).first()[0] or 0), 1
    while longest >= 2 * h:
        pairs = cut(now.select("doc", "line", F.col("rank").alias("r1"), _at("rank", h).alias("r2")).filter("r2 is not null"))
        now, h = cut(_intervals(pairs, ["r1", "r2"]).select("doc", "line", "rank")), 2 * h
        if not now.limit(1).count():
            break
        mine = runs.withColumn("n_lines", F.col("e") - F.col("s") + 1).filter((F.col("n_lines") >= h) & (F.col("n_lines") < 2 * h))
        head = now.select("doc", F.col("line").alias("s"), F.col("rank").alias("r1"))
        tail = now.select("doc", (F.col("line") + h - 1).alias("e"), F.col("rank").alias("r2"))
        placed = cut(mine.join(head, ["doc", "s"]).join(tail, ["doc", "e"]).select("doc", F.col("s").alias("line"), "e", "n_lines", "r1", "r2"))
        found.append(_intervals(placed, ["n_lines", "r1", "r2"]).filter(F.col("first") < F.struct("doc", "line")).select("doc", F.col("line").alias("s"), "e"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out, numbers


def merged(runs: DataFrame) -> DataFrame:
    """(doc, runs): the maximal runs that runs (doc, s, e) cover, as an array of (s, e) in order."""
    before = Window.partitionBy("doc").orderBy("s", "e")
    reach = F.max("e").over(before.rowsBetween(Window.unboundedPreceding, -1))
    starts = runs.withColumn("new", F.when(reach.isNull() | (F.col("s") > reach + 1), 1).otherwise(0))
    grouped = starts.withColumn("run", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow))).groupBy("doc", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return grouped.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("runs"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs, text without the later copies, and n_lines, n_removed, n_runs; columns of these names are replaced.

    A null text stays null with 0 lines; an empty one has one line without words. Rows of one doc_id are documents of
    their own, and so are rows without doc_id, which come last; rows that are equal in all columns are one document and
    share its deletions. n_runs counts maximal runs of deleted lines. An empty table stays empty.
    """
    kept = docs.drop("n_lines", "n_removed", "n_runs")
    keyed = kept.withColumns(row_keys(kept))
    runs, numbers = later_copies(keyed.select("doc_id", "text", K1, K2), min_words)
    gone = cut(merged(runs).join(numbers, "doc").select(K1, K2, F.col("runs").alias("__gone")))
    # by shuffle at any size: the lists grow with the corpus
    out = keyed.join(gone.hint("merge"), [K1, K2], "left").drop(K1, K2)
    out = out.withColumns({"__gone": F.coalesce("__gone", F.array().cast(gone.schema["__gone"].dataType)), "__lines": F.split("text", "\n", -1)})
    lines, g, n = F.col("__lines"), F.col("__gone"), F.size("__gone")

    def between(i: Column) -> Column:
        begin = F.when(i == 0, 0).otherwise(F.get(g, i - 1)["e"] + 1)
        end = F.when(i == n, F.size(lines)).otherwise(F.get(g, i)["s"])
        return F.slice(lines, begin + 1, end - begin)

    stay = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), n), between)), "\n")
    removed = F.aggregate(g, F.lit(0), lambda a, x: a + x["e"] - x["s"] + 1)
    out = out.withColumns({"n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)), "n_removed": removed, "n_runs": n, "text": F.when(n > 0, stay).otherwise(F.col("text"))})
    return out.drop("__gone", "__lines")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("n_lines", "n_removed", "n_runs")], F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, i, s, len(regexp_extract_all(s, '[^\\x20\\x09-\\x0D]+')) AS w FROM (SELECT doc_id, unnest(x) AS s, unnest(range(len(x))) AS i FROM t)),
m AS (SELECT *, sum(w) OVER d AS upto, sum(w) OVER d - w AS pre FROM c WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT q.doc_id, q.i AS a, z.j AS b FROM (SELECT doc_id, i, pre + 5 AS want FROM m) q ASOF JOIN (SELECT doc_id, upto, min(i) AS j FROM m GROUP BY ALL) z ON q.doc_id = z.doc_id AND q.want <= z.upto),
g AS (SELECT q.doc_id, z.j AS a, q.i AS b FROM (SELECT doc_id, i, upto - 5 AS want FROM m) q ASOF JOIN (SELECT doc_id, pre, max(i) AS j FROM m GROUP BY ALL) z ON q.doc_id = z.doc_id AND q.want >= z.pre),
r AS (SELECT r.*, b - a AS n, md5(array_to_string(x[a + 1:b + 1], chr(10))) AS h FROM (SELECT * FROM f UNION SELECT * FROM g) r JOIN t ON t.doc_id = r.doc_id),
k AS (SELECT doc_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY n, h ORDER BY doc_id, a) AS k FROM r) WHERE k > 1),
o AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM k),
y AS (SELECT c.*, o.i IS NOT NULL AS gone FROM c LEFT JOIN o ON o.doc_id = c.doc_id AND o.i = c.i),
v AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM y)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE starts) AS n_runs,
       sha256(coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM v GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, 0, NULL FROM documents WHERE text IS NULL
"""
