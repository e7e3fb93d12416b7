"""Language identification with error-correcting output codes.

Each language gets a codeword of bits. For every bit a binary logistic classifier over hashed byte
n-grams is trained; a text's bit margins are then compared with all codewords, each bit's loss
weighted by how well the bit was learned, and the codeword with the least loss wins. Where the two
nearest codewords are about as near, the prediction is flagged as ambiguous.

Training uses a bounded sample: `per_language` texts of each language on average, `max_train` at
most in all (documented parameters; features of whole texts, gathered as sparse counts).
Prediction reads every whole text once and sees nothing else.

Defined results: null text or a text without a letter is `und` with score 0; no labelled rows: all
rows are `und`; one language only: it is predicted for all texts with letters. Rows with a null
doc_id are predicted but never trained on. Repeated rows are predicted alike. Extra columns pass
through `annotate` untouched (the operator's own columns replace columns of the same name).
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UND = "und"
BUCKETS = 4096
NGRAMS = (2, 3, 4)
CHUNK = 1 << 20
_LETTER = regex.compile(r"\p{L}")
_MULT = np.array([2654435761, 2246822519, 3266489917, 668265263], dtype=np.uint32)
#: ASCII that isn't a letter counts as a blank.
_BLANK = np.array([b if b > 127 or chr(b).isalpha() else 32 for b in range(256)], dtype=np.uint32)


def features(text: str) -> np.ndarray:
    """Unit vector of hashed byte n-gram counts (log scale) over the whole text, in chunks of bounded size."""
    raw = f" {text.lower()} ".encode("utf-8", "replace")
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(raw), CHUNK):
        b = _BLANK[np.frombuffer(raw[at : at + CHUNK + max(NGRAMS) - 1], dtype=np.uint8)]
        for n in NGRAMS:
            m = min(len(b) - n + 1, CHUNK)
            if m <= 0:
                continue
            h = np.full(m, n, dtype=np.uint32)
            for i in range(n):
                h = (h ^ b[i : i + m]) * _MULT[i]
                h ^= h >> np.uint32(15)
            counts += np.bincount(h % BUCKETS, minlength=BUCKETS)
    x = np.log1p(counts).astype(np.float32)
    return x / max(float(np.linalg.norm(x)), 1e-9)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +-1. Up to 7 languages: the exhaustive code. More: the best of seeded random codes by least row distance."""
    if n <= 1:
        return np.ones((n, 1), dtype=np.int8)
    if n <= 7:
        cols = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(cols, dtype=np.int8).T
    rng, best, far = np.random.default_rng(seed), None, -1
    width = 10 * math.ceil(math.log2(n))
    for _ in range(50):
        code = rng.choice(np.array([1, -1], dtype=np.int8), size=(n, width))
        agree = code.astype(int) @ code.T
        np.fill_diagonal(agree, -width)
        if (least := int((width - agree.max()) // 2)) > far:
            best, far = code, least
    return best


class Model:
    """Codewords, and weights, bias and reliability of each bit's classifier."""

    def __init__(self, langs: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.langs, self.code, self.weights, self.bias, self.trust = langs, code.astype(np.float32), weights, bias, trust

    def decode(self, x: np.ndarray) -> tuple[str, float, float]:
        """Language, its share of the likelihood, and the lead over the next codeword."""
        margin = self.weights @ x + self.bias
        loss = (np.logaddexp(0, -self.code * margin) * self.trust).sum(axis=1)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        lead = float(p[order[0]] - p[order[1]]) if len(p) > 1 else 1.0
        return self.langs[order[0]], float(min(1.0, p[order[0]])), lead


def fit(rows: list[tuple[str, np.ndarray]], steps: int = 250, rate: float = 0.3) -> Model | None:
    """All bits' classifiers at once, by full-batch Adam over the sample, in a fixed order of rows."""
    if not rows:
        return None
    langs = sorted({lang for lang, _ in rows})
    code = codewords(len(langs))
    x = np.stack([v for _, v in rows]).astype(np.float32)
    place = {lang: i for i, lang in enumerate(langs)}
    which = np.array([place[lang] for lang, _ in rows])
    y = code[which].astype(np.float32)
    balance = (1.0 / np.bincount(which, minlength=len(langs)))[which][:, None].astype(np.float32) / len(langs)
    w, b = np.zeros((code.shape[1], x.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    mw, vw, mb, vb = (np.zeros_like(a) for a in (w, w, b, b))
    for t in range(1, steps + 1):
        g = -y * balance / (1 + np.exp(np.clip(y * (x @ w.T + b), -30, 30)))
        gw, gb = g.T @ x + 1e-6 * w, g.sum(axis=0)
        for p, m, v, gr in ((w, mw, vw, gw), (b, mb, vb, gb)):
            m += 0.1 * (gr - m)
            v += 0.01 * (gr * gr - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    right = ((x @ w.T + b) * y > 0).mean(axis=0)
    return Model(langs, code, w, b, np.clip(2 * right - 1, 0.05, 1.0).astype(np.float32))


def sample(docs: DataFrame, per_language: int = 300, max_train: int = 6000) -> DataFrame:
    """(lang, features) of a deterministic sample of the labelled rows of `docs` (doc_id, text, lang)."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_train).collect()
    if not counts:
        return docs.sparkSession.createDataFrame([], "lang string, at array<int>, value array<float>")
    each = max(1, min(per_language, max_train // len(counts)))
    span = 1 << 30
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], int(span * min(1.0, each / r["count"])))])
    drawn = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(span)) < F.element_at(share, F.col("lang")))

    def sparse(batches):
        for batch in batches:
            langs, ats, values = [], [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text is not None and _LETTER.search(text):
                    x = features(text)
                    at = np.flatnonzero(x)
                    langs.append(lang)
                    ats.append(at.astype(np.int32))
                    values.append(x[at])
            yield pa.record_batch([pa.array(langs, pa.string()), pa.array(ats, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], names=["lang", "at", "value"])

    return drawn.select("lang", "text").mapInArrow(sparse, "lang string, at array<int>, value array<float>")


def train(docs: DataFrame, per_language: int = 300, max_train: int = 6000) -> Model | None:
    rows = []
    for r in sample(docs, per_language, max_train).collect():
        x = np.zeros(BUCKETS, np.float32)
        x[r["at"]] = r["value"]
        rows.append((r["lang"], x))
    rows.sort(key=lambda r: (r[0], r[1].tobytes()))
    return fit(rows)


def annotate(docs: DataFrame, model: Model | None, text: str = "text", ambiguous_lead: float = 0.1) -> DataFrame:
    """All rows and columns of `docs` plus lang_pred, score (0 to 1) and ambiguous (lead under `ambiguous_lead`)."""
    own = ["lang_pred", "score", "ambiguous"]
    kept = docs.drop(*own)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats a bit, whatever the input's size

    def predict(batches):
        m = shared.value
        for batch in batches:
            langs, scores, unsure = [], [], []
            for t in batch.column(text):
                t = t.as_py()
                if m is None or not t or not _LETTER.search(t):
                    langs.append(UND), scores.append(0.0), unsure.append(False)
                    continue
                lang, score, lead = m.decode(features(t))
                langs.append(lang), scores.append(score), unsure.append(lead < ambiguous_lead)
            columns = [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())]
            yield pa.record_batch(columns, names=[*batch.schema.names, *own])

    schema = T.StructType([*kept.schema.fields, T.StructField(own[0], T.StringType()), T.StructField(own[1], T.DoubleType()), T.StructField(own[2], T.BooleanType())])
    return kept.mapInArrow(predict, schema)


def held_out(doc_id: str = "doc_id"):
    """True for the fold that no model may learn from: crc32 of the id's text leaves 2 when divided by 4; null id: false."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, **train_options) -> DataFrame:
    """Trains on the rows of `docs` outside the held-out fold and predicts every row."""
    return annotate(docs, train(docs.filter(~held_out()).select("doc_id", "text", "lang"), **train_options))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out()))
    return annotate(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
