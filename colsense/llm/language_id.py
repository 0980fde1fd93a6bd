"""Language identification (operator 8): sparse multinomial logistic regression
on TF-IDF character n-grams, trained with follow-the-regularised-leader and
elastic-net penalties, then calibrated with one temperature.

Document frequencies are counted over all training documents (hashed n-grams,
BUCKETS of them).  The regression is fitted on a bounded sample of labelled
training rows: of each language the same number of distinct texts of smallest
hash, SAMPLE in all at most, copies once; their hashed counts, not their texts,
go to the driver.  Every fifth sampled row sets the temperature instead of the
weights.  Prediction is one scan
over whole texts, without a shuffle.

Cases: a null text or one without a letter is `und` with score 0; with no
training rows every text is; one learned language has score 1; null and repeated
ids are predicted row by row; training rows without a lang are not used; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, crc_mod, drawn_contents, table

BUCKETS = 1 << 14
MAX_N = 3
SAMPLE = 2400
HELD_OUT_MOD, HELD_OUT = 5, 0
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
EPOCHS = 3
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the 1..MAX_N-grams of the letters, runs of anything
    else as one blank; empty without letters."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    is_letter = _letters()[a]
    keep = is_letter.copy()
    keep[0] = True
    keep[1:] |= is_letter[:-1]
    if not is_letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a = np.where(is_letter, a, 32)[keep].astype(U64)
    h, parts = np.zeros(len(a), U64), []
    for n in range(1, MAX_N + 1):
        h = h[: len(a) - n + 1] * U64(0x9E3779B97F4A7C15) + a[n - 1 :]
        parts.append(((h * U64(0xD6E8FEB86659FD93)) >> U64(64 - 14)).astype(np.int64))
    counts = np.bincount(np.concatenate(parts), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def _weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf[at]
    return x / max(np.sqrt(x @ x), 1e-12)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for t in b.column(0):
            df[ngram_counts(t.as_py())[0]] += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_pydict({"bucket": at, "n": df[at]})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [ngram_counts(t.as_py()) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.int64()))],
                                         names=["lang", "at", "counts"])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class FtrlSoftmax:
    """Follow-the-regularised-leader (proximal, per coordinate) for softmax
    regression; weights are zero where |z| <= L1."""

    def __init__(self, classes: int):
        self.z = np.zeros((classes, BUCKETS + 1))
        self.n = np.zeros((classes, BUCKETS + 1))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = _softmax(w @ x)
        p[y] -= 1
        g = p[:, None] * x[None, :]
        n = self.n[:, at]
        self.z[:, at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[:, at] = n + g * g


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""
    def loss(t):
        return -np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()
    a, b, r = -4.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(rows: DataFrame, sample: int = SAMPLE) -> dict:
    """rows: (text, lang) of training documents.  The model's arrays."""
    rows = rows.where("lang is not null and text is not null")
    per = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(per)
    if not langs:
        return {"langs": []}
    idf = np.zeros(BUCKETS)
    for r in rows.select("text").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        idf[r.bucket] = r.n
    idf = np.log((1 + sum(per.values())) / (1 + idf)) + 1
    drawn = drawn_contents(rows.select("lang", "text"), ["text"], max(1, sample // len(langs)), 7, by="lang").select("lang", "text").mapInArrow(_counted, "lang string, at array<long>, counts array<long>")
    data = sorted(((r.lang, np.array(r["at"], np.int64), np.array(r["counts"], np.int64)) for r in drawn.collect()),
                  key=lambda r: (len(r[1]), r[0], r[2].tobytes()[:64]))
    rng = np.random.default_rng(5)
    rng.shuffle(data)
    bias = np.array([BUCKETS])
    xs = [(np.concatenate([at, bias]), np.append(_weighted(at, c, idf), 1.0), langs.index(lang)) for lang, at, c in data]
    learn, tune = [r for i, r in enumerate(xs) if i % 5], [r for i, r in enumerate(xs) if i % 5 == 0]
    model = FtrlSoftmax(len(langs))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(learn)):
            model.learn(*learn[i])
    w = model.weights()
    t = 1.0
    if len(tune) >= 10:
        t = _temperature(np.stack([w[:, at] @ x for at, x, _ in tune]), np.array([y for *_, y in tune]))
    return {"langs": langs, "idf": idf, "w": w.astype(np.float32), "t": t}


def predict(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """keep columns, lang_pred and score; docs has them and `text`."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for b in batches:
            pred, score = [], []
            for t in b.column(len(keep)):
                at, counts = ngram_counts(t.as_py()) if m["langs"] else ((), ())
                if not len(at):
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    continue
                p = _softmax((m["w"][:, at] @ _weighted(at, counts, m["idf"]) + m["w"][:, BUCKETS]) / m["t"])
                i = int(p.argmax())
                pred.append(m["langs"][i])
                score.append(min(1.0, float(p[i])))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                             names=[*keep, "lang_pred", "score"])

    src = docs.select(*keep, F.col("text").cast("string").alias("text"))
    types = {f.name: f.dataType.simpleString() for f in src.schema}
    return src.mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in keep), "lang_pred string, score double"]))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_mod("doc_id", HELD_OUT_MOD) == HELD_OUT)
    model = fit(docs.where("not held_out").select("text", "lang"))
    return predict(docs, model, ["doc_id", "held_out"])
