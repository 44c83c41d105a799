"""near_dedup and mixing on rows whose doc_id is null or repeated."""

import random
from collections import Counter

import corpus_pipeline

from quern.llm import op03_minhash, op08_mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def text(seed, n=60):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def test_near_dedup_keeps_one_row_of_each_group(spark):
    a, b, c, d, e = map(text, range(5))
    rows = [(5, a), (5, a), (3, a), (3, a), (None, a), (7, b), (7, c), (None, d), (None, d), (None, e), (9, e + " tail")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS).repartition(3)
    kept = corpus_pipeline.near_dedup(spark, df, "")
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(3, a), (7, b), (7, c), (None, d), (9, e + " tail")])
    got = Counter(tuple(r) for r in op03_minhash.near_groups(df).select("doc_id", "component_id", "kept").collect())
    want = [(5, 3, False)] * 2 + [(3, 3, True), (3, 3, False), (None, 3, False)] + [(7, 7, True)] * 2 + [(None, None, True), (None, None, False), (None, 9, False), (9, 9, True)]
    assert got == Counter(want)


def test_mixing_counts_copies_by_row(spark, monkeypatch):
    monkeypatch.setattr(op08_mixing, "BLOCK", 40)
    big = 2**53 + 1
    ids = [[big + i, big + i // 3, None, 7][i % 4] for i in range(600)]
    rows = [(k, text(i, 20 + i % 50), "en", ["a", "b", None][i % 3], i) for i, k in enumerate(ids)]
    df = spark.createDataFrame(rows, DOCS)
    out = op08_mixing.mix(df).collect()
    assert Counter((r.doc_id, r.source) for r in out) == Counter((r[0], r[3]) for r in rows)
    taken, target = Counter(), {r.source: r.target for r in out}
    copies = Counter(tuple(r) for r in corpus_pipeline.mixing(spark, df, "").collect())
    assert set(copies) <= set(rows) and max(copies.values()) <= 2
    for r, n in copies.items():
        taken[r[3]] += n * len(r[1].split())
    assert all(abs(taken[s] - t) <= 0.01 * t for s, t in target.items())
    assert any(r[0] is None for r in copies)
