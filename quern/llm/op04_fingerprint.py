"""Document fingerprints by one-permutation MinHash, DataFrame functions only.

Each shingle of five words is hashed once. The top bits of the hash name one of BINS bins, and each bin keeps its least
hash: the hashes are sorted together with a mark for each bin that is larger than any hash of the bin, and the first of
each bin stays. An empty bin takes over the value of a donor bin, picked by hashes of (bin, attempt) until the donor is
full (optimal densification); after TRIES attempts the full bin with the least hash of (bin, donor), which amounts
to going on without repeats. The low BITS of each value are the fingerprint. Of two fingerprints, a share m of
equal values estimates the likeness (m - c) / (1 - c), c = 2 ** -BITS being the share that agrees by chance.

A text of one to four words has its whole sequence as its only shingle. A text without words, or null, has an empty
fingerprint, which is like itself (1) and unlike all others (0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import K1, K2, cut, repeated_rows, row_keys

BIN_BITS, BITS, TRIES, WORDS = 7, 8, 6, 5
BINS = 1 << BIN_BITS
_SHIFT = 63 - BIN_BITS


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def _hash(*columns: Column) -> Column:
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << 63) - 1))


def _full(x: Column) -> Column:
    """Whether a bin's value is no mark."""
    return x.bitwiseAND(F.lit((1 << _SHIFT) - 1)) != F.lit((1 << _SHIFT) - 1)


def fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with out, an array of BINS integers below 2 ** BITS; empty for a text without words. Row by row, no shuffle."""
    w, h, m, full = (f"__{x}" for x in ("words", "hashes", "least", "full"))
    at = lambda i, j: F.get(F.col(w), i + j)
    shingles = F.transform(F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: _hash(*[at(i, j) for j in range(WORDS)]))
    marks = F.array(*[F.lit((b << _SHIFT) | ((1 << _SHIFT) - 1)) for b in range(BINS)])
    df = df.withColumn(w, words_of(F.col(text)))
    df = df.withColumn(h, F.when(F.size(w) >= WORDS, F.sort_array(F.concat(shingles, marks))).when(F.size(w) > 0, F.sort_array(F.concat(F.array(_hash(F.array_join(w, " "))), marks))).otherwise(F.array().cast("array<long>")))
    first = lambda x, i: (i == 0) | (F.shiftright(x, _SHIFT) != F.shiftright(F.get(F.col(h), i - 1), _SHIFT))
    df = df.withColumn(m, F.filter(F.col(h), first)).drop(w, h).withColumn(full, F.filter(F.col(m), _full))

    def donated(x: Column, b: Column) -> Column:
        donors = [F.get(F.col(m), F.pmod(F.xxhash64(F.lit(t), b), F.lit(BINS)).cast("int")) for t in range(TRIES)]
        tries = [F.when(_full(d), d) for d in donors]
        last = F.array_min(F.transform(F.col(full), lambda y: F.struct(F.xxhash64(b, F.shiftright(y, _SHIFT)).alias("k"), y.alias("v"))))["v"]
        return F.when(_full(x), x).otherwise(F.coalesce(*tries, last))

    low = F.transform(F.transform(F.col(m), donated), lambda x: x.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))
    return df.withColumn(out, low).drop(m, full)


def as_hex(print_: Column) -> Column:
    return F.array_join(F.transform(print_, lambda x: F.lower(F.lpad(F.hex(x), BITS // 4, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard index of two fingerprints, 0 to 1."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / BINS
    chance = 2.0**-BITS
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (same - chance) / (1 - chance))))


def following_rows(ids: DataFrame) -> DataFrame:
    """ids (doc_id, K1, K2 and more; K1 and K2 unique) with n1, n2: the keys of the row that follows in descending doc_id.

    Rows without doc_id come last; rows of one doc_id in the order of their keys. After the last comes the first. Rows are
    range-partitioned and looked at within a partition; of each partition only its first keys meet elsewhere, a row for
    each partition.
    """
    parts = max(int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    order = [F.col("doc_id").desc_nulls_last(), F.col(K1), F.col(K2)]
    ranged = cut(ids.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()))
    low = F.min(F.struct(F.col("doc_id").isNull(), -F.col("doc_id"), K1, K2)).alias("low")
    firsts = sorted((r["__p"], r.low[K1], r.low[K2]) for r in ranged.groupBy("__p").agg(low).collect())
    after = [(p, *firsts[(i + 1) % len(firsts)][1:]) for i, (p, _, _) in enumerate(firsts)]
    table = ids.sparkSession.createDataFrame(after, "__p int, __a1 long, __a2 long")
    within = Window.partitionBy("__p").orderBy(*order)
    out = ranged.withColumns({"__n1": F.lead(K1).over(within), "__n2": F.lead(K2).over(within)}).join(F.broadcast(table), "__p")
    return out.select(*ids.columns, F.coalesce("__n1", "__a1").alias("n1"), F.coalesce("__n2", "__a2").alias("n2"))


def edited_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, K1, K2, n1, n2, copies, same, text, edited): the last third of each text gives way to the next one's beginning.

    Every row of docs counts. Rows of equal doc_id and text can't be told apart, so they are one row here with the
    number of them: where a row is there c times, c - 1 of them are followed by their like (same is true) and the last by
    the next text, whose keys are n1 and n2. Null texts are empty. An empty table gives an empty one. Texts are shuffled
    once, by their keys; what travels besides is the beginnings alone.
    """
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = whole.withColumns(row_keys(whole))
    # its two uses ask for the same columns, so that they share one shuffle
    once = keyed.groupBy(K1, K2).agg(F.first("text").alias("text"))
    ids = keyed.groupBy(K1, K2).agg(F.first("doc_id").alias("doc_id"), F.first(F.length("text")).alias("n_chars"), F.count("*").alias("n"))
    order = cut(following_rows(ids))
    wanted = order.select("doc_id", F.col(K1).alias("__o1"), F.col(K2).alias("__o2"), F.floor(F.col("n_chars") / 3).cast("int").alias("take"), "n", F.col("n1").alias(K1), F.col("n2").alias(K2))
    heads = wanted.join(once, [K1, K2]).select("doc_id", F.col("__o1"), F.col("__o2"), F.col(K1).alias("n1"), F.col(K2).alias("n2"), "n", "take", F.substr("text", F.lit(1), F.col("take")).alias("head"))
    both = once.join(heads.withColumnsRenamed({"__o1": K1, "__o2": K2}), [K1, K2])
    last = F.struct(F.lit(False).alias("same"), F.lit(1).cast("long").alias("copies"))
    before = F.struct(F.lit(True).alias("same"), (F.col("n") - 1).alias("copies"))
    kinds = both.withColumn("__kind", F.explode(F.when(F.col("n") > 1, F.array(before, last)).otherwise(F.array(last))))
    head = F.when(F.col("__kind.same"), F.substr("text", F.lit(1), F.col("take"))).otherwise(F.col("head"))
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - F.col("take")), head)
    return kinds.select("doc_id", K1, K2, "n1", "n2", "__kind.copies", "__kind.same", "text", edited.alias("edited"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = edited_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    texts = texts.withColumns({"n_chars": F.length("text").cast("long"), "edited_sha256": F.sha2("edited", 256)})
    texts = fingerprint(fingerprint(texts, "text", "own"), "edited", "changed")
    prints = cut(texts.drop("text", "edited"))
    following = prints.filter("not same").select(F.col(K1).alias("n1"), F.col(K2).alias("n2"), F.col("own").alias("following"))
    near = prints.join(following, ["n1", "n2"]).withColumn("near_next", F.when(F.col("same"), 1.0).otherwise(likeness(F.col("own"), F.col("following"))))
    out = near.select(
        K1, K2, "copies", "doc_id", "n_chars", "edited_sha256", as_hex(F.col("own")).alias("fingerprint"), as_hex(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), "near_next",
    )
    return repeated_rows(out, "copies").drop(K1, K2)
