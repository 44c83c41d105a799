"""Language identification in two steps: the family, then one-versus-one linear SVMs between its languages.

Features are counts of hashed letter 1-, 2- and 3-grams of the whole lower-cased text, with what is no letter as
a space, log-scaled and of unit length. Families are a fixed table; a language that is not in it is a family of its own.
The models are fitted on the driver, on labelled texts that a hash of doc_id chooses: at most SAMPLE a language in
expectation, and fewer where there are so many languages that these would be over TOTAL; but every language has a text
or two, so none is left out. TOTAL vectors are some 65 MB. Prediction is one pass over the documents without a shuffle
and sees nothing but the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

SAMPLE, TOTAL, DIMS = 500, 8000, 2048
CHUNK = 1 << 20

#: Languages of the usual families, by ISO 639-1 code.
FAMILIES = {
    "germanic": "af da de en fy is lb nl nb nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "turkic": "az kk ky tk tr tt ug uz",
    "indic": "bn gu hi mr ne pa si ur",
    "semitic": "am ar he mt",
    "uralic": "et fi hu",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_LETTER = regex.compile(r"\p{L}")


def letter_table() -> np.ndarray:
    """For each code point of the basic plane whether it is a letter; all beyond count as letters."""
    return np.array([chr(c).isalpha() for c in range(0x10000)])


def features(text: str, letters: np.ndarray) -> np.ndarray:
    """The unit vector of a text, gathered from pieces that overlap by two characters."""
    counts = np.zeros(DIMS, np.int64)
    low = text.lower()
    for at in range(0, len(low), CHUNK):
        c = np.frombuffer(low[max(0, at - 2) : at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(letters[np.minimum(c, 0xFFFF)] | (c > 0xFFFF), c, np.uint32(32))
        skip = min(at, 2)
        h1 = c * np.uint32(0x9E3779B1)
        h2 = (h1[:-1] ^ (h1[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + h1[1:]
        h3 = (h2[:-1] ^ (h2[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + h1[2:]
        for h, lead in ((h1, skip), (h2, max(0, skip - 1)), (h3, 0)):
            h = h[lead:]
            counts += np.bincount(((h ^ (h >> np.uint32(16))) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - 11), minlength=DIMS)
    v = np.log1p(counts).astype(np.float32)
    return v / max(float(np.linalg.norm(v)), 1e-9)


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 12) -> np.ndarray:
    """L2-loss linear SVM by dual coordinate descent; y is -1 or 1. The last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, alpha, diagonal = np.zeros(x.shape[1]), np.zeros(len(x)), 0.5 / cost
    norms, rng = (x * x).sum(1) + diagonal, np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            step = max(alpha[i] - (y[i] * (x[i] @ w) - 1 + diagonal * alpha[i]) / norms[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
    return w.astype(np.float32)


class Model:
    """Weights for families (one against the rest) and for each pair of languages of a family."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        family = np.array([FAMILY_OF.get(v, v) for v in langs])
        lang = np.array(langs)
        self.families = sorted(set(family))
        self.members = {f: [v for v in self.langs if FAMILY_OF.get(v, v) == f] for f in self.families}
        zero = np.zeros(DIMS + 1, np.float32)
        self.of_family = np.array([fit_svm(x, np.where(family == f, 1, -1)) if len(self.families) > 1 else zero for f in self.families])
        self.of_pair = {}
        for names in self.members.values():
            for i, a in enumerate(names):
                for b in names[i + 1 :]:
                    rows = (lang == a) | (lang == b)
                    self.of_pair[a, b] = fit_svm(x[rows], np.where(lang[rows] == a, 1, -1))

    def predict(self, v: np.ndarray) -> tuple[str, float]:
        """Language and score: the family's share of a logistic vote times the language's mean vote."""
        v = np.append(v, np.float32(1))
        odds = 1 / (1 + np.exp(-4 * (self.of_family @ v)))
        best = int(np.argmax(odds))
        names = self.members[self.families[best]]
        votes = dict.fromkeys(names, 0.0)
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                p = 1 / (1 + float(np.exp(-4 * (self.of_pair[a, b] @ v))))
                votes[a] += p
                votes[b] += 1 - p
        lang = max(names, key=lambda k: (votes[k], k))
        within = votes[lang] / (len(names) - 1) if len(names) > 1 else 1.0
        share = float(odds[best] / odds.sum()) if len(odds) > 1 else 1.0
        return lang, min(1.0, max(0.0, share * within))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letters = letter_table()
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([features(t.as_py(), letters).tobytes() for t in batch.column(1)], pa.binary())], ["lang", "draw", "v"])


def fit(labelled: DataFrame, sample: int = SAMPLE, total: int = TOTAL) -> Model | None:
    """A model from labelled (doc_id, text, lang) of all its languages; None if it has no labelled text with a letter.

    A language of n texts gives each of them with probability quota / n, quota being the sample or what total leaves for
    it, and besides the one with the least hash, so that every language is learned. Repeated rows are as likely
    as their number says. Rows without doc_id are drawn by their text.
    """
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    draw = F.xxhash64(F.lit("language sample"), F.coalesce(F.col("doc_id").cast("string"), F.col("text"))).alias("draw")
    counts = cut(usable.select("lang", draw).groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("first")))
    languages = counts.count()
    if not languages:
        return None
    quota = min(sample, max(total // languages, 1))
    drawn = usable.select("lang", "text", draw).join(counts, "lang")
    share = F.pmod("draw", F.lit(1 << 30)) / float(1 << 30)
    drawn = drawn.filter((F.col("draw") == F.col("first")) | (share < quota / F.col("n"))).select("lang", "text", "draw")
    rows = sorted((r.lang, r.draw, bytes(r.v)) for r in drawn.mapInArrow(_vectors, "lang string, draw long, v binary").collect())
    kept: dict[str, list[bytes]] = {}
    for lang, _, v in rows:
        kept.setdefault(lang, []).append(v)
    pairs = [(lang, v) for lang, vs in kept.items() for v in vs[: 2 * quota]]
    return Model(np.frombuffer(b"".join(v for _, v in pairs), np.float32).reshape(len(pairs), DIMS), [lang for lang, _ in pairs])


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs with lang_pred and score, and with their text only if keep_text; columns of these names are replaced.

    A null text, one without a letter and any text under a model of None is 'und' with score 0. Rows are judged one by one, so
    repeated ones alike; an empty table stays empty.
    """
    others = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    source = docs.select(*others, text)
    kept = source.columns if keep_text else others

    def task(batches):
        letters = letter_table()
        for batch in batches:
            out = []
            for cell in batch.column(len(others)):
                t = cell.as_py()
                out.append(model.predict(features(t, letters)) if t and model and _LETTER.search(t) else ("und", 0.0))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], [*kept, "lang_pred", "score"])

    return source.mapInArrow(task, source.select(*kept).schema.add("lang_pred", "string").add("score", "double"))


def held_out(doc_id: Column) -> Column:
    """Documents that no model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit_on(docs: DataFrame) -> Model | None:
    return fit(docs.filter(~F.coalesce(held_out(F.col("doc_id")), F.lit(True))).select("doc_id", "text", "lang"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), fit_on(docs))
