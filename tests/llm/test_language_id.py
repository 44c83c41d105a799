"""Clean documents pass language ID, whatever could be learned."""

import math
import zlib

import corpus_pipeline
import numpy as np
import pytest

from quern.llm import op09_language

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
HELD = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2)
LABELS = {"none": [None, None, None], "held out": ["en", None, None], "und": ["und", "und", "und"]}


@pytest.mark.parametrize("labels", LABELS)
def test_clean_documents_stay(spark, labels):
    texts = ["the cat and the dog", "le chat et le chien", "der Hund und die Katze", None, "12 34", ""]
    rows = [(HELD + 1000 * bool(i) + i, t, (LABELS[labels] + [None] * 3)[i], "s", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    out = corpus_pipeline.language_id(spark, df, "")
    assert out.columns == df.columns and {r.text for r in out.collect()} == set(texts[:3])


def test_all_languages_are_learned(spark):
    """More languages than the total leaves a full sample for; the rarest are learned too."""
    rows = [(1000 * k + i, f"{chr(0x4E00 + k)}{chr(0x5E00 + k)} " * 5, f"l{k:03}") for k in range(230) for i in range(3 if k else 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = op09_language.fit(df, total=230)
    assert len(model.langs) == 230
    got = op09_language.identify(df, model).select("lang", "lang_pred").distinct().collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 225


def test_prediction_by_plain_votes(spark):
    """Family by the highest one-against-all margin, then language by summed pairwise votes, from features counted one by one."""
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = op09_language.fit_on(small)
    letters = op09_language.letter_table()
    rows = small.select("doc_id", "text").limit(40).collect()
    got = {r.doc_id: r for r in op09_language.identify(spark.createDataFrame(rows), model).collect()}
    for r in rows:
        v = np.append(plain_features(r.text, letters), np.float32(1)).astype(np.float64)
        margins = [float(w.astype(np.float64) @ v) for w in model.of_family]
        names = model.members[model.families[margins.index(max(margins))]]
        votes = dict.fromkeys(names, 0.0)
        for (a, b), w in model.of_pair.items():
            if a in votes and b in votes:
                p = 1 / (1 + math.exp(-4 * float(w.astype(np.float64) @ v)))
                votes[a] += p
                votes[b] += 1 - p
        assert got[r.doc_id].lang_pred == max(names, key=lambda k: (votes[k], k)), r.doc_id


def plain_features(text, letters):
    """Letter 1-, 2- and 3-grams of the lower-cased text, one at a time."""
    m = 1 << 32
    c = [ord(x) if ord(x) > 0xFFFF or letters[ord(x)] else 32 for x in text.lower()]
    spread = lambda h, s: h ^ (h >> s)
    one = lambda x: x * 0x9E3779B1 % m
    two = lambda x, y: (spread(one(x), 15) * 0x85EBCA77 + one(y)) % m
    three = lambda x, y, z: (spread(two(x, y), 13) * 0xC2B2AE3D + one(z)) % m
    grams = [one(x) for x in c] + [two(x, y) for x, y in zip(c, c[1:], strict=False)] + [three(x, y, z) for x, y, z in zip(c, c[1:], c[2:], strict=False)]
    counts = np.zeros(op09_language.DIMS)
    for h in grams:
        counts[(spread(h, 16) * 0x27D4EB2F % m) >> 21] += 1
    v = np.log1p(counts)
    return v / max(np.linalg.norm(v), 1e-9)
