"""The pipeline's stages on real rows: what each keeps, and that decisions take effect."""

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tests.llm.test_ops import brute_groups

from quern.llm import op01_bpe
from quern.llm.common import cut

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(90001, None, "en", None, None), (90002, "123 456", None, "src0", 7), (90003, "", "de", "src1", 0)], docs.schema)
    docs = docs.unionByName(odd)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "bpe"]
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        at = cut(stage(spark, at, FOLDER))
        seen[name] = at
        if name != "bpe":
            assert at.columns == docs.columns
    assert seen["language_id"].count() == docs.count() - 3
    assert seen["line_dedup"].filter(~F.col("text").rlike(r"[^\x20\x09-\x0D]")).count() == 0
    assert seen["line_dedup"].filter(F.col("n_chars") != F.length("text")).count() == 0
    rows = [tuple(r) for r in seen["line_dedup"].select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in seen["near_dedup"].collect()) == sorted(i for i, x in brute_groups(rows).items() if x[2])
    assert seen["mixing"].groupBy("doc_id").count().agg(F.max("count")).first()[0] == 2
    own = op01_bpe.WordBpe(op01_bpe.load(op01_bpe.production_tokenizer()))
    text = {r.doc_id: r.text for r in seen["mixing"].collect()}
    got = seen["bpe"].collect()
    assert len(got) == seen["mixing"].count()
    assert all(r.ids == own.encode_batch([text[r.doc_id]])[0].tolist() and r.n_tokens == len(r.ids) for r in got)


ODD = "doc_id long, text string, lang string, source string, n_chars long, bands string, ids string, __more int, rank string, p double"


def odd_rows():
    some = ["a cat sat on the mat and then went home", "der Hund lief durch den Wald und kam nicht zurück", "le chat dort sur la table de la cuisine"]
    rows = [(i, f"{some[i % 3]} number {i} of {i * 7}", ["en", "de", "fr"][i % 3], [None, "s1", "s2"][i % 3]) for i in range(30)]
    rows += [(5, some[0] + " again", "en", "s1"), (5, some[1] + " wieder", None, "s1"), (None, some[2], "fr", None), (None, some[2], "fr", None), (None, None, None, None), (None, "", "en", "s1"), (40, "12 34", None, "s2")]
    rows += [(41, "long " * 30_000 + "text", "en", "s1"), (42, "\n".join(["a line of five words here"] * 2000), "en", "s2")] + [(43, "the same row of some words again", "en", "s1")] * 3
    return [(*r, len(r[1] or ""), "x", "y", 1, "z", 0.5) for r in rows]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_of_odd_rows(spark, name):
    """Null, repeated, empty, very long; columns that operators use for themselves; then nothing at all."""
    stage, rows = dict(corpus_pipeline.STAGES)[name], odd_rows()
    df = spark.createDataFrame(rows, ODD).repartition(3)
    out = stage(spark, df, FOLDER)
    got = out.collect()
    if name == "bpe":
        assert len(got) == len(rows) and [r.n_tokens for r in got if r.doc_id is None].count(0) == 2
        assert stage(spark, df.limit(0), FOLDER).count() == 0
        return
    assert out.columns == df.columns and all((r.bands, r.ids, r["__more"], r["rank"], r.p) == ("x", "y", 1, "z", 0.5) for r in got)
    texts = Counter((r.doc_id, r.text) for r in got)
    want = Counter(r[:2] for r in rows)
    if name == "language_id":
        assert texts == Counter({k: n for k, n in want.items() if k[1] and any(c.isalpha() for c in k[1])})
    if name == "line_dedup":
        assert texts[43, "the same row of some words again"] == 3 and texts[42, "a line of five words here"] == 1 and texts[None, None] == 1
        assert sum(texts.values()) == len(rows)
    if name == "near_dedup":
        assert texts[43, "the same row of some words again"] == 1 and sum(n for (i, t), n in texts.items() if t and t.startswith("le chat dort sur la table de la cuisine") and i is None) == 1
        assert texts[None, None] == texts[None, ""] == 1 and texts[5, rows[30][1]] == texts[5, rows[31][1]] == 1
    if name == "mixing":
        assert set(texts) <= set(want) and all(n <= 2 * want[k] for k, n in texts.items()) and not texts[None, None]
    empty = stage(spark, df.limit(0), FOLDER)
    assert empty.columns == df.columns and empty.count() == 0
