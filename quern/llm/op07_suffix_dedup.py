"""Repeated byte strings by a distributed difference-cover suffix array, compared to the depth of one window.

A byte goes if a LENGTH-byte string that covers it also starts elsewhere. The suffixes to sort are cut down and dealt out
first, both exactly: the least hash among a window's K-byte pieces (its anchor) is equal for equal windows, so windows
whose anchor hash is found once repeat nowhere, and all others meet their equals in the bucket of their hash. A maximal
run of windows with one anchor is a context, the bytes that they cover; equal contexts are counted once, so a passage
with any number of copies is one row, all of whose windows repeat.

The contexts of many buckets, end to end, are then sorted as one text with the difference cover {1, 2} modulo 3: triples
of bytes at sampled positions are sorted and named, then triples of names, to 3, 9, 27 and 81 bytes, and to LENGTH - 2 by
three names; the recursion ends there, as no longer prefix is asked for. Other suffixes are merged in by the bytes before
a sampled one: windows i, j have some d in 0, 1, 2 for which i + d and j + d are both sampled, so each window takes part in
the two sorts, of d bytes, a name and 2 - d bytes, that its place modulo 3 allows. Equal neighbours in a sort repeat.

Buckets of more than HOT contexts or BATCH bytes don't go to one task; their windows are counted by 128-bit hashes,
which is exact as well. The README says why, with figures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import K1, K2, cut, lookup, row_keys

LENGTH, K, HOT, BATCH = 200, 48, 1000, 1_500_000
PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, by doubling."""
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        k = min(have, n - have)
        out[have : have + k] = out[:k] * np.uint64(pow(base, have, 1 << 64))
        have += k
    return out


class Anchors:
    """Least hashes of the windows of a text, worked out in pieces that overlap by a window."""

    def __init__(self, length: int = LENGTH, k: int = K):
        self.length, self.k = length, min(k, length)
        self.powers, self.inverse = _powers(_BASE, PIECE + length), _powers(pow(_BASE, -1, 1 << 64), PIECE + length)

    def least(self, b: np.ndarray) -> np.ndarray:
        """The least hash of each window of b, one for each start; none if b is shorter than a window."""
        n = len(b) - self.length + 1
        return np.concatenate([self._piece(b[at : at + PIECE + self.length - 1])[1] for at in range(0, n, PIECE)]) if n > 0 else np.zeros(0, np.uint64)

    def _piece(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each K-byte piece and the least of each window."""
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.powers[: len(b)], out=sums[1:])
        h = (sums[self.k :] - sums[: -self.k]) * self.inverse[: len(b) - self.k + 1]
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        return h, _extreme(np.minimum, h, self.length - self.k + 1, ~np.uint64(0))

    def places(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The anchor hashes of b, and at how many places each is the least of some window.

        A place is one if its hash is the greatest of the least hashes of the windows around it. Places where pieces
        overlap may count twice, which keeps a hash more and never one less.
        """
        n, found = len(b) - self.length + 1, [np.zeros(0, np.uint64)]
        for at in range(0, n, PIECE):
            h, least = self._piece(b[at : at + PIECE + self.length - 1])
            w = self.length - self.k + 1
            around = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
            found.append(h[h == _extreme(np.maximum, around, w, np.uint64(0))])
        return np.unique(np.concatenate(found), return_counts=True)


def _extreme(of: np.ufunc, x: np.ndarray, w: int, neutral: np.uint64) -> np.ndarray:
    """of (minimum or maximum) over each w neighbours, from running values within blocks of w."""
    n = len(x)
    padded = np.full(-(-n // w) * w, neutral)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    head, tail = of.accumulate(rows, 1).ravel(), of.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return of(tail[: n - w + 1], head[w - 1 : n])


def runs_of(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the maximal runs of equal values."""
    if not len(least):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return starts, np.diff(np.append(starts, len(least)))


def _names(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The places of the triples (a, b, c) in their sorted order without repeats. All are below 2 ** 32."""
    if max(int(x.max(initial=0)) for x in (a, b, c)) < 1 << 21:
        return np.unique((a << 42) | (b << 21) | c, return_inverse=True)[1]
    pair = np.unique((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64), return_inverse=True)[1]
    return np.unique((pair.astype(np.uint64) << np.uint64(32)) | c.astype(np.uint64), return_inverse=True)[1]


def repeated(text: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each start whether its window of text equals that of another start, by the difference cover modulo 3.

    length is at least 5. Windows lie within text; symbols are below 2 ** 9.
    """
    n, most = len(text), length - 2
    padded = np.concatenate([text.astype(np.int64), np.zeros(length + 3, np.int64)])
    at = np.flatnonzero(np.arange(n) % 3)  # the sampled positions
    name = np.zeros(n + length + 3, np.int64)
    name[at] = 1 + _names(padded[at], padded[at + 1], padded[at + 2])
    depth = 3
    while 3 * depth <= most:
        name[at] = 1 + _names(name[at], name[at + depth], name[at + 2 * depth])
        depth *= 3
    if depth < most:
        # three names that overlap, all at multiples of three, reach the depth that is divisible by three
        rest = (most - depth) // 3 * 3
        middle = min(depth, rest)
        name[at] = 1 + _names(name[at], name[at + middle], name[at + rest])
        depth += rest
    spare = most - depth  # 0 to 2 bytes that names leave open
    out = np.zeros(len(starts), bool)
    for d in range(3):
        mine = np.flatnonzero((starts + d) % 3 != 0)
        i = starts[mine]
        key = name[i + d]
        for j in [*range(d), *range(d + depth, length)]:
            key = np.unique((key << 10) | padded[i + j], return_inverse=True)[1] if spare and key.max(initial=0) >> 52 else (key << 10) | padded[i + j]
        order = np.argsort(key, kind="stable")
        same = np.flatnonzero(key[order][1:] == key[order][:-1])
        out[mine[order[same]]] = True
        out[mine[order[same + 1]]] = True
    return out


def _ranges(flags: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and lengths of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist()


def _bytes(cell) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), np.uint8) if cell.is_valid else np.zeros(0, np.uint8)


def anchor_counts(docs: DataFrame, length: int) -> DataFrame:
    """(K1, h, n): the anchor hashes of each document of (K1, text as binary), and their places."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length)
        for batch in batches:
            keys, hashes, counts = [], [], []
            for key, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                value, n = anchors.places(_bytes(cell))
                keys.append(np.full(len(value), key, np.int64))
                hashes.append(value.view(np.int64))
                counts.append(n)
            join = lambda x: np.concatenate([*x, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(join(x)) for x in (keys, hashes, counts)], [K1, "h", "n"])

    return docs.mapInArrow(task, f"{K1} long, h long, n long")


ROWS = f"kind string, {K1} long, {K2} long, doc_id long, at long, windows long, h long, c1 long, c2 long, n_bytes long, sha256 string, body binary"


def contexts(docs: DataFrame, length: int) -> DataFrame:
    """ROWS of docs (K1, K2, doc_id, text as binary, hs: its repeated anchor hashes or null).

    plain: a document without repeated anchors, done; text: any other; run: one of its contexts. A context of more than
    PIECE windows is cut into several, from its start on, so that equal ones are cut alike; all their windows stay.
    """
    import hashlib

    fields = ["kind", K1, K2, "doc_id", "at", "windows", "h", "c1", "c2", "n_bytes", "sha256", "body"]
    kinds = [pa.string(), *[pa.int64()] * 9, pa.string(), pa.binary()]

    def task(batches):
        anchors = Anchors(length)
        for batch in batches:
            rows, held = [], 0
            for k1, k2, doc_id, cell, hs in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), batch.column(4), strict=True):
                b, none = _bytes(cell), (None,) * 5
                if not hs.is_valid:
                    rows.append(("plain", k1, k2, doc_id, *none, len(b), hashlib.sha256(b.tobytes()).hexdigest(), None))
                    continue
                rows.append(("text", k1, k2, doc_id, *none, len(b), None, b.tobytes()))
                least = anchors.least(b)
                starts, lengths = runs_of(least)
                mine = np.isin(least[starts].view(np.int64), hs.values.to_numpy())
                pieces = [(a, min(PIECE, at + n - a)) for at, n in zip(starts[mine].tolist(), lengths[mine].tolist(), strict=True) for a in range(at, at + n, PIECE)]
                for at, n in pieces:
                    body = b[at : at + n + length - 1].tobytes()
                    c1, c2 = np.frombuffer(xxhash.xxh3_128_digest(body), np.int64)
                    rows.append(("run", k1, k2, None, at, n, int(least[at].view(np.int64)), int(c1), int(c2), None, None, body))
                held += len(b)
                if held > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], fields)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], fields)

    return docs.mapInArrow(task, ROWS)


RANGES = "c1 long, c2 long, starts array<long>, lengths array<long>"


def _range_batch(rows: list) -> pa.RecordBatch:
    ints = pa.list_(pa.int64())
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), ints, ints), strict=True)], ["c1", "c2", "starts", "lengths"])


def sorted_contexts(bodies: DataFrame, length: int) -> DataFrame:
    """RANGES of repeated windows, from rows (h, c1, c2, copies, body) that are dealt and sorted by h."""

    def task(batches):
        rows, size, last = [], 0, None
        for batch in batches:
            for h, c1, c2, copies, body in zip(*(batch.column(i) for i in range(5)), strict=True):
                h = h.as_py()
                if size >= BATCH and h != last:
                    yield _range_batch(_classify(rows, length))
                    rows, size = [], 0
                b = np.frombuffer(body.as_buffer(), np.uint8)
                rows.append((c1.as_py(), c2.as_py(), copies.as_py(), b))
                size, last = size + len(b), h
        if rows:
            yield _range_batch(_classify(rows, length))

    return bodies.mapInArrow(task, RANGES)


def _classify(rows: list, length: int) -> list:
    """A mark above all bytes stands between contexts; windows never hold one."""
    sizes = np.array([len(b) + 1 for *_, b in rows])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    text = np.full(int(sizes.sum()), 256, np.int64)
    for at, (*_, b) in zip(begins.tolist(), rows, strict=True):
        text[at : at + len(b)] = b
    windows = sizes - length
    starts = np.repeat(begins - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(int(windows.sum()))
    found, ends, out = repeated(text, starts, length), np.cumsum(windows), []
    for (c1, c2, copies, _), n, end in zip(rows, windows.tolist(), ends.tolist(), strict=True):
        a, k = ([0], [n]) if copies > 1 else _ranges(found[end - n : end])
        if a:
            out.append((c1, c2, a, k))
    return out


def hot_windows(bodies: DataFrame, length: int) -> DataFrame:
    """(c1, c2, j, copies, w1, w2): the windows of hot buckets' contexts, with their 128-bit hash."""

    def task(batches):
        for batch in batches:
            for c1, c2, copies, body in zip(*(batch.column(i) for i in range(4)), strict=True):
                b = body.as_py()
                n = len(b) - length + 1
                w = np.frombuffer(b"".join([xxhash.xxh3_128_digest(b[j : j + length]) for j in range(n)]), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, x.as_py(), np.int64)) for x in (c1, c2)] + [pa.array(np.arange(n)), pa.array(np.full(n, copies.as_py(), np.int64)), pa.array(w[:, 0].copy()), pa.array(w[:, 1].copy())], ["c1", "c2", "j", "copies", "w1", "w2"])

    return bodies.mapInArrow(task, "c1 long, c2 long, j long, copies long, w1 long, w2 long")


def dedup_bytes(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of docs (doc_id, text; further columns are left out).

    kept is what stays, as binary, and null where all of it stays. A null text counts as empty; texts shorter than length
    lose nothing. Every row is a document: rows of one doc_id or of none are told apart by their text, and of rows with
    equal doc_id and text each has the other's bytes elsewhere, so texts of length bytes go in all of them. An empty table
    gives an empty one.
    """
    import hashlib

    spark = docs.sparkSession
    raw = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    raw = raw.withColumns(row_keys(raw))
    # half of the key will do here: documents that share it by chance get each other's repeated anchors, which spares none
    counts = cut(anchor_counts(raw.select(K1, "text"), length))
    dup = counts.groupBy("h").agg(F.sum("n").alias("n"), F.count("*").alias("w")).filter("n > 1")
    shared = lookup(counts.select(K1, "h"), dup, ["h"], ["w"], "w", counts.count()).filter("w is not null")
    hs = shared.groupBy(K1).agg(F.collect_set("h").alias("hs"))
    rows = cut(contexts(raw.join(hs.hint("merge"), K1, "left").select(K1, K2, "doc_id", "text", "hs"), length))

    members = rows.filter("kind = 'run'").select(K1, K2, "at", "c1", "c2").distinct()
    n_members = members.count()
    bodies = cut(rows.filter("kind = 'run'").groupBy("c1", "c2").agg(F.first("h").alias("h"), F.count("*").alias("copies"), F.first("body").alias("body")))
    size = F.octet_length("body").cast("long")
    buckets = bodies.groupBy("h").agg(F.count("*").alias("kinds"), F.sum(size).alias("bytes"), F.min("copies").alias("least"))
    # a bucket whose contexts all have copies needs no sort
    open_ = lookup(bodies, buckets.filter("least = 1"), ["h"], ["kinds", "bytes"], "kinds", bodies.count()).filter("kinds is not null").select("h", "c1", "c2", "copies", "body", "kinds", "bytes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    small = (F.col("kinds") <= hot) & (F.col("bytes") <= BATCH)
    calm = open_.filter(small).select("h", "c1", "c2", "copies", "body").repartition(parts, "h").sortWithinPartitions("h")
    windows = cut(hot_windows(open_.filter(~small).select("c1", "c2", "copies", "body"), length))
    twice = windows.groupBy("w1", "w2").agg(F.sum("copies").alias("n"), F.count("*").alias("w")).filter("n > 1")
    apart = lookup(windows, twice, ["w1", "w2"], ["n"], "w", windows.count()).filter("n is not null").groupBy("c1", "c2").agg(F.array_sort(F.collect_set("j")).alias("starts"))
    apart = apart.select("c1", "c2", "starts", F.transform("starts", lambda _: F.lit(1).cast("long")).alias("lengths"))
    known = sorted_contexts(calm, length).unionByName(apart)
    sure = bodies.filter("copies > 1").select("c1", "c2", F.array(F.lit(0).cast("long")).alias("starts"), F.array((F.octet_length("body") - (length - 1)).cast("long")).alias("lengths"))
    ranges = cut(known.join(bodies.filter("copies = 1").select("c1", "c2"), ["c1", "c2"], "left_semi").withColumn("copies", F.lit(1).cast("long")).unionByName(sure.join(bodies.select("c1", "c2", "copies"), ["c1", "c2"])))
    placed = lookup(members, ranges, ["c1", "c2"], ["starts", "lengths"], "copies", n_members).filter("starts is not null")
    spans = placed.groupBy(K1, K2).agg(F.flatten(F.collect_list(F.transform("starts", lambda x: x + F.col("at")))).alias("starts"), F.flatten(F.collect_list("lengths")).alias("lengths"))

    def remove(batches):
        for batch in batches:
            out = []
            for doc_id, cell, starts, lengths in zip(batch.column(0).to_pylist(), *(batch.column(i) for i in (1, 2, 3)), strict=True):
                b = _bytes(cell)
                edge = np.zeros(len(b) + 1, np.int32)
                if starts.is_valid:
                    s, k = starts.values.to_numpy(), lengths.values.to_numpy()
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + k + length - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = b[~gone].tobytes()
                out.append((doc_id, len(b), int(gone.sum()), len(_ranges(gone)[0]), hashlib.sha256(kept).hexdigest(), kept if gone.any() else None))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [*[pa.int64()] * 4, pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    texts = rows.filter("kind = 'text'").select(K1, K2, "doc_id", "body")
    cut_texts = texts.join(spans.hint("merge"), [K1, K2], "left").select("doc_id", "body", "starts", "lengths").mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    plain = rows.filter("kind = 'plain'").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha256").alias("kept_sha256"), F.lit(None).cast("binary").alias("kept"))
    return plain.unionByName(cut_texts)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, b, unnest(range(0, n - 199)) AS p FROM d WHERE n >= 200),
h AS (SELECT doc_id, p, md5(b[p + 1 : p + 200]) AS h FROM w),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY h) AS k FROM h) WHERE k > 1),
i AS (SELECT doc_id, p, sum(CASE WHEN p <= q + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS island
      FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM r)),
s AS (SELECT doc_id, min(p) AS a, max(p) + 200 AS z FROM i GROUP BY doc_id, island),
k AS (SELECT s.doc_id, a, z, hex(d.b[coalesce(lag(z) OVER (PARTITION BY s.doc_id ORDER BY a), 0) + 1 : a]) AS head FROM s JOIN d ON d.doc_id = s.doc_id),
o AS (SELECT doc_id, sum(z - a) AS gone, count(*) AS spans, max(z) AS z, string_agg(head, '' ORDER BY a) AS heads FROM k GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(CASE WHEN o.doc_id IS NULL THEN b ELSE unhex(heads || hex(b[z + 1 : n])) END) AS kept_sha256
FROM d LEFT JOIN o ON o.doc_id = d.doc_id
"""
