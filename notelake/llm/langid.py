"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is lower-cased, everything but letters becomes a space, and its byte 3- and 4-grams (spaces
mark word ends) are hashed to buckets. Each bucket has an embedding; a text is the average of its
buckets' embeddings, and a linear layer with a softmax gives a probability for each language.
Embeddings and the layer are trained together by stochastic gradient descent in numpy on a bounded
sample, whose rows stay sparse until they are in a step's batch. A temperature fitted on a part of that sample that took no part in the descent calibrates
the probability, and the same part gives the score below which a text is rejected.

Defined results: a null text, an empty one and one without a letter are ``und`` with score 0. Repeated
rows are each predicted. Without any labelled text everything is ``und``. Ids may be null or repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, id_split, keep_rows, stash

#: Documents that the model is fitted on, over all languages, and of each language at least, if there are so many.
SAMPLE_DOCS, LEAST_OF_EACH = 4096, 64
#: Rows of the sample's marks up to which they go to all tasks.
MOST_MARKS = 200_000
BUCKETS = 1 << 13
DIM = 16
UNKNOWN = "und"

_LETTERS = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))


def normalise(text: str | None) -> bytes:
    """Lower-cased UTF-8 in which every ASCII character that is no letter is a space."""
    return (text or "").lower().encode("utf-8", "replace").translate(_LETTERS)


def has_letter(text: str | None, norm: bytes) -> bool:
    if not text:
        return False
    if norm.isascii():
        return bool(norm.strip())
    return any(c.isalpha() for c in text)


def bucket_counts(norm: bytes) -> np.ndarray:
    """How often each bucket is hit by the 3- and 4-grams of the whole text."""
    a = np.frombuffer(b" " + norm + b"  ", np.uint8).astype(np.uint32)
    three = a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA6B) + a[2:] * np.uint32(0xC2B2AE35)
    four = three[:-1] + a[3:] * np.uint32(0x27D4EB2F)
    four ^= four >> np.uint32(15)
    four *= np.uint32(0x2C1B3C6D)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    return np.bincount(np.concatenate([three >> shift, four >> shift]), minlength=BUCKETS).astype(np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class LangModel:
    """``table``: a logit for each bucket and language (embedding times linear layer), as averaged."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, reject_below: float):
        self.langs, self.table, self.bias = langs, table, bias
        self.temperature, self.reject_below = temperature, reject_below

    def predict(self, text: str | None) -> tuple[str, float]:
        norm = normalise(text)
        if not self.langs or not has_letter(text, norm):
            return UNKNOWN, 0.0
        counts = bucket_counts(norm)
        z = (counts @ self.table) / counts.sum() + self.bias
        p = _softmax(z[None, :] / self.temperature)[0]
        k = int(p.argmax())
        return self.langs[k], float(p[k])

    def accepts(self, lang: str, score: float) -> bool:
        return lang != UNKNOWN and score >= self.reject_below


class Sparse:
    """Rows of average bucket counts, of which only those that aren't zero are kept."""

    def __init__(self, buckets: list[np.ndarray], shares: list[np.ndarray]):
        self.buckets, self.shares = buckets, shares

    def __len__(self) -> int:
        return len(self.buckets)

    def dense(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), BUCKETS), np.float32)
        for k, row in enumerate(rows):
            out[k, self.buckets[row]] = self.shares[row]
        return out


def fit_arrays(x: Sparse, y: np.ndarray, langs: list[str], epochs: int = 16, seed: int = 7) -> LangModel:
    """Stochastic gradient descent over rows of average bucket counts; every fifth row only calibrates."""
    n, c = len(x), len(langs)
    rng = np.random.default_rng(seed)
    held = np.zeros(n, bool)
    if n >= 20:
        held[::5] = True
    fit = np.flatnonzero(~held)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIM, c)).astype(np.float32)
    bias = np.zeros(c, np.float32)
    weight = (len(fit) / (c * np.maximum(np.bincount(y[fit], minlength=c), 1)))[y].astype(np.float32)
    weight = np.minimum(weight, 5)
    steps = max(1, epochs * len(fit) // 16)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(fit)
        for at in range(0, len(order), 16):
            rows = order[at : at + 16]
            rate = np.float32(1.0 * (1 - step / (steps + 1)) + 0.02)
            step += 1
            xb = x.dense(rows)
            h = xb @ emb
            g = _softmax(h @ out + bias)
            g[np.arange(len(rows)), y[rows]] -= 1
            g *= weight[rows, None] / len(rows)
            back = g @ out.T
            out -= rate * (h.T @ g)
            bias -= rate * g.sum(axis=0)
            emb -= (rate * 40) * (xb.T @ back)  # averages of many buckets give small gradients
    logits = emb @ out
    check = np.flatnonzero(held if held.any() else ~held)
    zc = np.concatenate([x.dense(check[at : at + 256]) @ logits + bias for at in range(0, len(check), 256)])
    yc = y[check]
    best = min(np.geomspace(0.2, 5, 33), key=lambda t: -np.log(_softmax(zc / t)[np.arange(len(yc)), yc] + 1e-9).mean())
    p = _softmax(zc / best)
    right = p.max(axis=1)[p.argmax(axis=1) == yc]
    # below every score of a rightly predicted text of that part, and never above one half
    reject = float(min(0.5, right.min() * 0.9)) if len(right) else 0.0
    return LangModel(langs, logits.astype(np.float32), bias, float(best), reject)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets that a text hits and their shares of all hits."""
    for batch in batches:
        buckets, shares = [], []
        for t in batch.column("text"):
            counts = bucket_counts(normalise(t.as_py()))
            buckets.append(np.flatnonzero(counts).astype("<u2").tobytes())
            shares.append((counts[counts > 0] / counts.sum()).astype("<f4").tobytes())
        yield pa.RecordBatch.from_pydict({"lang": batch.column("lang"), "place": batch.column("place"), "buckets": pa.array(buckets, pa.binary()), "shares": pa.array(shares, pa.binary())})


def fit(docs: DataFrame, learn=None) -> LangModel:
    """Fits on about ``SAMPLE_DOCS`` documents with a ``lang``, as many of each; ``learn`` is a condition on usable rows.

    Every language is learned. The sample is found in one pass over ids and hashes, by rank within the
    language, and a second pass fetches its texts; rows that repeat an id and a text count once. The driver
    has a row for each language, as the model has; the sample's marks are broadcast up to ``MOST_MARKS`` rows.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if learn is not None:
        rows = rows.filter(learn)
    rows = rows.select("doc_id", F.col("text").cast("string").alias("text"), "lang").withColumn("mark", F.xxhash64("doc_id", "text"))
    # a row for each language; with the number of its different documents, those with the least hashes are few from the start
    there = {r["lang"]: r["many"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("mark").alias("many")).collect()}
    langs = sorted(there)
    if not langs:
        return LangModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    quota = max(LEAST_OF_EACH, SAMPLE_DOCS // len(langs))
    least = [(lang, min(2**63 - 1, int(2**64 * min(1.0, 2 * quota / max(1, many))) - 2**63)) for lang, many in there.items()]
    below = docs.sparkSession.createDataFrame(least, "lang string, below long")
    few = rows.select("lang", "mark", F.xxhash64("mark", F.lit("sample")).alias("h")).join(F.broadcast(below) if len(langs) <= MOST_MARKS else below, "lang").filter(F.col("h") <= F.col("below")).select("lang", "h", "mark").distinct()
    marks = stash(few.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h", "mark"))).filter(F.col("place") <= quota), "marks")
    chosen = marks.select("lang", "mark", "place")
    sample = rows.join(F.broadcast(chosen) if len(langs) * quota <= MOST_MARKS else chosen, ["lang", "mark"])
    one = sample.groupBy("lang", "place").agg(F.first("text").alias("text"))  # equal marks: equal texts
    got = one.repartition(16).mapInArrow(_features, "lang string, place int, buckets binary, shares binary").toArrow()
    discard(marks)
    number = {lang: k for k, lang in enumerate(langs)}
    y, place = np.array([number[k] for k in got.column("lang").to_pylist()], np.int64), got.column("place").to_numpy()
    # rows come in any order: sort, then mix
    mixed = np.random.default_rng(3).permutation(np.lexsort((place, y)))
    cells = [(got.column(name).to_pylist(), kind) for name, kind in (("buckets", "<u2"), ("shares", "<f4"))]
    buckets, shares = ([np.frombuffer(values[k], kind) for k in mixed] for values, kind in cells)
    return fit_arrays(Sparse(buckets, shares), y[mixed], langs)


def identify(docs: DataFrame, model: LangModel) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` for every document, from its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "lang_pred": pa.array([k for k, _ in found], pa.string()),
                "score": pa.array([s for _, s in found], pa.float64()),
                "rejected": pa.array([not m.accepts(k, s) for k, s in found], pa.bool_()),
            })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: LangModel) -> DataFrame:
    """The documents that the model doesn't reject, with all their columns."""
    return keep_rows(docs, model, lambda m, text: m.accepts(*m.predict(text)))


def learn_rows():
    """Rows that may be learned from: crc32 of the id, modulo 4, is not 2."""
    return F.coalesce(id_split("doc_id", 4) != 2, F.lit(False))
