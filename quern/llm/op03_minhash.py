"""Near-duplicate documents by min-max hashing.

A document's set is its distinct five-word shingles, as 64-bit hashes. Under each of PERMUTATIONS hash functions both the
least and the greatest value are kept, two signature values for one evaluation; BANDS bands of four values from two
functions each make the buckets. Two documents of likeness s share no bucket with probability (1 - s^4)^BANDS, 5e-6 at
s = 0.75.

Equal sets are one class first, with the smallest doc_id as representative. Then:
1. Each bucket links its members to its smallest member. Links are confirmed on the full sets, and confirmed ones make
   components; a group of copies of any size costs a link a member.
2. Buckets whose members still belong to several components compare members across components: sizes and sketches of
   four bits or more a shingle, which bound the intersection from above, rule out most; the rest is confirmed on the full sets. Buckets of
   more than CHUNK members are compared by pairs of chunks in separate groups. So no link between bucket members is
   lost and no group's pairs are written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, cut, lookup, with_rows
from .components import components

WORDS, PERMUTATIONS, BANDS, CHUNK = 5, 64, 32, 512
SKETCH_BYTES = 256
WORD_CACHE = 1_000_000
SIGNATURES = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sketch binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of shingle hashes, with a table of the words met so far."""

    def __init__(self):
        self.words: dict[bytes, int] = {}

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes; the whole sequence is one shingle if there are fewer than five words."""
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.words) > WORD_CACHE:
            self.words.clear()
        table = self.words
        for w in set(words).difference(table):
            table[w] = xxhash.xxh3_64_intdigest(w)
        h = np.array([table[w] for w in words], np.uint64)
        n = max(1, len(h) - WORDS + 1)
        out = np.full(n, np.uint64(min(len(h), WORDS)))
        for j in range(min(len(h), WORDS)):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
        return np.unique(out)


class Signer:
    """Signature, buckets and sketch of a set."""

    def __init__(self):
        rng = np.random.default_rng(20240101)
        self.factors = rng.integers(1 << 62, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.terms = rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)

    def min_max(self, s: np.ndarray) -> np.ndarray:
        """PERMUTATIONS rows of (least, greatest)."""
        low, high = np.full(PERMUTATIONS, ~np.uint64(0)), np.zeros(PERMUTATIONS, np.uint64)
        for at in range(0, len(s), 2048):
            v = self.factors[:, None] * s[None, at : at + 2048] + self.terms[:, None]
            low, high = np.minimum(low, v.min(1)), np.maximum(high, v.max(1))
        return np.stack([low, high], 1)

    def bands(self, s: np.ndarray) -> np.ndarray:
        v = self.min_max(s).reshape(BANDS, -1)
        key = np.arange(BANDS, dtype=np.uint64)
        for j in range(v.shape[1]):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + v[:, j])
        return key.view(np.int64)

    def sketch(self, s: np.ndarray) -> bytes:
        """A bit for each value's remainder, in a number of bits that is a power of two; half as many are the halves or-ed."""
        width = max(SKETCH_BYTES * 8, 1 << (4 * len(s) - 1).bit_length()) if len(s) else SKETCH_BYTES * 8
        bits = np.zeros(width, np.uint8)
        bits[(s % np.uint64(width)).astype(np.int64)] = 1
        return np.packbits(bits).tobytes()


def signatures(docs: DataFrame) -> DataFrame:
    """SIGNATURES of docs (doc_id, text), in one pass. Documents without words have no buckets."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(), Signer()
        for batch in batches:
            out = []
            for doc_id, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingler.shingles(cell.as_py())
                h = xxhash.xxh3_128_digest(s.tobytes())
                h1, h2 = np.frombuffer(h, np.int64)
                out.append((doc_id, len(s), int(h1), int(h2), signer.bands(s) if len(s) else [], signer.sketch(s)))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_shingles", "h1", "h2", "bands", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(task, SIGNATURES)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, s): the full sets of docs (doc_id, text)."""

    def task(batches):
        shingler = Shingler()
        for batch in batches:
            sets = [shingler.shingles(c.as_py()).view(np.int64) for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "s"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, s array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets have a likeness of 0.75 or more.

    Either end may be the hub of any number of pairs: its set goes to each of at most 64 salts that its pairs use.
    """
    spread = pairs.withColumns({"of_b": F.pmod(F.xxhash64("b"), F.lit(64)), "of_a": F.pmod(F.xxhash64("a"), F.lit(64))})
    ends_a = spread.select("a", "of_b").distinct().join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a")
    ends_b = spread.select("b", "of_a").distinct().join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    placed = spread.join(ends_b, ["b", "of_a"]).join(ends_a, ["a", "of_b"])
    return placed.filter(100 * both >= 75 * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _sizes_fit(m: Column, n: Column) -> Column:
    return 100 * F.least(m, n) >= 75 * F.greatest(m, n)


def _cross_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Possible links between components, from rows sorted by (bucket, c1, c2): bucket, c1, c2, chunk, doc_id, component, n, sketch."""
    held = None
    for batch in batches:
        held = batch if held is None else pa.concat_batches([held, batch])
        keys = np.stack([held.column(i).to_numpy() for i in range(3)], 1)
        ends = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1 if len(keys) else []
        if len(ends):
            yield _pairs_of(held.slice(0, ends[-1]), ends)
            held = held.slice(ends[-1])
    if held is not None and held.num_rows:
        yield _pairs_of(held, [held.num_rows])


def _folded(sketches: np.ndarray) -> np.ndarray:
    """Sketches (rows of words) at half their width."""
    half = sketches.shape[-1] // 2
    return sketches[..., :half] | sketches[..., half:]


def _pairs_of(rows: pa.RecordBatch, ends) -> pa.RecordBatch:
    c1, c2, chunk, doc, comp, n = (rows.column(i).to_numpy() for i in range(1, 7))
    own = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column(7)]
    width = np.array([len(x) for x in own], np.int64)
    found, start = [], 0
    for end in ends:
        place, tables = np.zeros(end - start, np.int64), {}
        for w in np.unique(width[start:end]).tolist():
            mine = np.flatnonzero(width[start:end] == w)
            place[mine] = np.arange(len(mine))
            tables[w] = np.stack([own[start + k] for k in mine])
        halved = {w: _folded(t) for w, t in tables.items()}
        for i in range(start, end):
            # chunk pairs: rows of the first chunk meet those of the second; within one chunk, those after them
            j = np.arange(i + 1, end) if c1[i] == c2[i] else np.flatnonzero(chunk[start:end] == c2[i]) + start if chunk[i] == c1[i] else ()
            if not len(j):
                continue
            m, k = np.minimum(n[j], n[i]), np.maximum(n[j], n[i])
            j = j[(comp[j] != comp[i]) & (100 * m >= 75 * k)]
            # sets of such sizes have sketches of one width or of one and its double
            w = int(width[i])
            for theirs, table, sketch in ((w, tables, own[i]), (2 * w, halved, own[i]), (w // 2, tables, _folded(own[i]))):
                mine = j[width[j] == theirs]
                if not len(mine):
                    continue
                other = table[theirs][place[mine - start]]
                most = np.minimum(n[i] - np.bitwise_count(sketch & ~other).sum(1, dtype=np.int64), n[mine] - np.bitwise_count(other & ~sketch).sum(1, dtype=np.int64))
                mine = mine[100 * most >= 75 * (n[i] + n[mine] - most)]
                found += [(min(doc[i], d), max(doc[i], d)) for d in doc[mine].tolist()]
        start = end
    found = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])


def _components_of(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of docs (doc_id, text), whose doc_id is unique and not null."""
    spark = docs.sparkSession
    signed = cut(signatures(docs))
    total = signed.count()
    ids = signed.select("doc_id", "n_shingles", "h1", "h2")
    classes = ids.filter("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.count("*").alias("copies"))
    members = cut(lookup(ids, classes, ["h1", "h2"], ["owner", "copies"], "copies", total).select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("owner")).otherwise(F.col("doc_id")).alias("owner"), F.when(F.col("n_shingles") > 0, F.col("copies")).otherwise(F.lit(1)).alias("copies")))

    owners = members.filter("doc_id = owner and n_shingles > 0").select("doc_id").distinct()
    buckets = cut(signed.join(owners, "doc_id", "left_semi").select("doc_id", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket")))
    hubs = buckets.groupBy("bucket").agg(F.min(F.struct("doc_id", "n")).alias("hub"), F.count("*").alias("m")).filter("m > 1")
    shared = cut(lookup(buckets, hubs, ["bucket"], ["hub", "m"], "m", buckets.count()).filter("m is not null"))
    pairs = cut(shared.filter((F.col("hub.doc_id") < F.col("doc_id")) & _sizes_fit(F.col("hub.n"), F.col("n"))).select(F.col("hub.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct())
    meeting = cut(shared.select("doc_id").distinct())
    sets = cut(shingle_sets(docs.select("doc_id", "text").join(meeting.hint("merge"), "doc_id", "left_semi")))
    links = cut(confirmed(pairs, sets))
    labels = cut(components(links))

    label_of = cut(meeting.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component")))
    traits = label_of.join(signed.select("doc_id", F.col("n_shingles").alias("n"), "sketch"), "doc_id")
    placed = cut(shared.select("bucket", "m", "doc_id").join(label_of, "doc_id"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("*").alias("w")).filter("c1 < c2")
    rows = lookup(placed, mixed, ["bucket"], ["w"], "w", placed.count()).filter("w is not null")
    chunks = F.ceil(F.col("m") / CHUNK).cast("long")
    rows = rows.withColumns({"chunks": chunks, "chunk": F.pmod(F.xxhash64("doc_id"), chunks)}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("bucket", F.least("chunk", "other").cast("long").alias("c1"), F.greatest("chunk", "other").cast("long").alias("c2"), F.col("chunk").cast("long").alias("chunk"), "doc_id", "component")
    wide = rows.join(traits.select("doc_id", "n", "sketch"), "doc_id").select("bucket", "c1", "c2", "chunk", "doc_id", "component", "n", "sketch")
    dealt = wide.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket", "c1", "c2").sortWithinPartitions("bucket", "c1", "c2")
    more = cut(dealt.mapInArrow(_cross_pairs, "a long, b long").distinct())
    late = cut(confirmed(more, sets))
    if late.limit(1).count():
        labels = cut(components(links.unionByName(late)))

    final = labels.join(members.filter("doc_id = owner").select(F.col("doc_id").alias("node"), "copies").distinct(), "node").select(F.col("node").alias("owner"), "component", "copies")
    out = lookup(members.select("doc_id", "n_shingles", "owner"), final, ["owner"], ["component"], "copies", total)
    return out.select("doc_id", "n_shingles", F.coalesce("component", "owner").alias("component_id"))


def _grouped(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows with ROW their (ROW, doc_id, n_shingles, group), and of each group (group, n, component_id, keeper): its rows, smallest doc_id and the row that has it."""
    found = _components_of(rows.select(F.col(ROW).alias("doc_id"), "text")).select(F.col("doc_id").alias(ROW), "n_shingles", F.col("component_id").alias("group"))
    placed = cut(found.join(rows.select(ROW, "doc_id"), ROW))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("first")
    groups = placed.groupBy("group").agg(F.count("*").alias("n"), first)
    return placed, groups.select("group", "n", F.col("first.doc_id").alias("component_id"), F.col(f"first.{ROW}").alias("keeper"))


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs (doc_id, text; further columns are left out).

    Null and wordless texts have empty sets and are linked with nothing. Rows are told apart by themselves, not by doc_id:
    one row of each group is kept, of those with the smallest doc_id, whether that is repeated or not. Rows without doc_id
    are grouped by their text like others and come last; a group of them alone has no component_id. An empty table gives
    an empty one.
    """
    placed, groups = _grouped(with_rows(docs.select("doc_id", "text")))
    out = lookup(placed, groups, ["group"], ["component_id", "keeper"], "n", placed.count())
    return out.select("doc_id", "n_shingles", "component_id", (F.col(ROW) == F.col("keeper")).alias("kept"))


def dedup(docs: DataFrame) -> DataFrame:
    """docs, of each group of near-duplicates one row alone, that with the smallest doc_id; as near_groups."""
    rows = with_rows(docs)
    keepers = _grouped(rows)[1].select(F.col("keeper").alias(ROW))
    return rows.join(keepers.hint("merge"), ROW, "left_semi").select(*docs.columns)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
r AS (SELECT x FROM e GROUP BY x HAVING count(*) > 1),
c AS (SELECT doc_id, n, x FROM e WHERE x IN (SELECT x FROM r)),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM c a JOIN c b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL HAVING 100 * count(*) >= 75 * (max(a.n) + max(b.n) - count(*))),
g AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
t AS (SELECT a, b FROM g UNION SELECT t.a, g.b FROM t JOIN g ON t.b = g.a),
k AS (SELECT a, min(b) AS m FROM t GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(k.m, s.doc_id)) AS component_id, coalesce(k.m, s.doc_id) >= s.doc_id AS kept
FROM s LEFT JOIN k ON k.a = s.doc_id
"""
