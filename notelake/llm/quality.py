"""Quality classifier: a generalised additive model with pairwise interactions.

Each text gives a few statistics. Quantile bins turn each into a small integer, and the model is a
lookup table for each statistic and for some pairs of them, plus a constant: a score is a sum of table
entries under a logistic function. The tables are learned by cyclic boosting: round after round, a
shallow tree over one statistic's bins (then over one pair's) is fitted to the remaining gradient and a
part of it is added to that table. Pairs are those whose trees would lessen the remaining loss most.

Defined results: null and empty texts have statistics of zero and a score like any other. Repeated rows
are each scored. Without labels of both classes the score is the share of label 1 (0.5 with none at all).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_split, labelled_texts, sample_ids

#: Most labelled documents of each class that the model is fitted on.
SAMPLE_ROWS = 4000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, RATE = 80, 0.15

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "marks", "odd_marks", "exclaims", "wide",
    "repeated_words", "repeated_lines", "line_length", "short_lines", "compression", "ends", "bars", "common",
)

_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_SPACE = b" \t\n\r\x0b\x0c"
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_ODD = b"#$%&*+<=>@\\^_`{|}~"
_WIDE = bytes(range(0x80, 0x100))


def features(text: str | None) -> list[float]:
    """Statistics of the whole text; all of them shares or means but the first two."""
    raw = (text or "").encode("utf-8", "replace")
    n = max(1, len(raw))
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    w, k = max(1, len(words)), max(1, len(lines))
    share = lambda drop: (len(raw) - len(raw.translate(None, drop))) / n
    longest = 1 << 16  # compression is measured piece by piece: memory stays bounded, and the whole text counts
    packed = sum(len(zlib.compress(raw[a : a + longest], 1)) for a in range(0, len(raw), longest))
    return [
        np.log1p(len(raw)), np.log1p(len(words)), (len(raw) - raw.count(b" ")) / w, share(_UPPER), share(_DIGITS), share(_MARKS), share(_ODD), raw.count(b"!") / w, share(_WIDE),
        1 - len(set(words)) / w if words else 0.0, 1 - len(set(lines)) / k if lines else 0.0, np.log1p(len(raw) / k), sum(len(x) < 30 for x in lines) / k,
        packed / n, (raw.count(b". ") + raw.count(b".\n") + raw.endswith(b".")) / w, raw.count(b"|") / w, sum(map(len, set(words))) / n,
    ]


class Gam:
    def __init__(self, cuts: list[np.ndarray], base: float, tables: list[np.ndarray], pair_cuts: list[np.ndarray], pairs: dict[tuple[int, int], np.ndarray]):
        self.cuts, self.base, self.tables, self.pair_cuts, self.pairs = cuts, base, tables, pair_cuts, pairs

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for k, t in enumerate(self.tables):
            z += t[np.searchsorted(self.cuts[k], x[:, k])]
        for (a, b), t in self.pairs.items():
            z += t[np.searchsorted(self.pair_cuts[a], x[:, a]), np.searchsorted(self.pair_cuts[b], x[:, b])]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def _split(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int]:
    """Best cut of a row of bins: gain, and how many bins go left (0: none)."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain = np.where((hl >= least) & (hr >= least), gain, -1.0)
    if not len(gain) or gain.max() <= 1e-9:
        return 0.0, 0
    return float(gain.max()), int(gain.argmax()) + 1


def _shallow_tree(g: np.ndarray, h: np.ndarray, least: float, depth: int = 2) -> np.ndarray:
    """A value for each bin: a tree of ``depth`` levels over sums of gradients and curvatures."""
    _, cut = _split(g, h, least) if depth and len(g) > 1 else (0, 0)
    if not cut:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.concatenate([_shallow_tree(g[:cut], h[:cut], least, depth - 1), _shallow_tree(g[cut:], h[cut:], least, depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, np.ndarray]:
    """Loss that the best tree saves and its values: one cut of a side, then one of the other side in each half."""
    best = (0.0, np.zeros_like(g))
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        for cut in range(1, len(gg)):
            out, total = np.zeros_like(gg), -(g.sum() ** 2) / (h.sum() + 1)
            for part in (slice(0, cut), slice(cut, None)):
                row_g, row_h = gg[part].sum(axis=0), hh[part].sum(axis=0)
                gain, at = _split(row_g, row_h, least)
                total += gain + row_g.sum() ** 2 / (row_h.sum() + 1)
                for cells in (slice(0, at), slice(at, None)) if at else (slice(None),):
                    out[part, cells] = row_g[cells].sum() / (row_h[cells].sum() + 1)
            if total > best[0]:
                best = (total, out.T if turned else out)
    return best


def fit_arrays(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Gam:
    n, m = x.shape
    share = float(np.average(y, weights=weight)) if n else 0.5
    base = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    if not n or share in (0.0, 1.0):
        return Gam([np.zeros(0)] * m, base, [np.zeros(1)] * m, [np.zeros(0)] * m, {})
    cuts = [_cuts(x[:, k], BINS) for k in range(m)]
    coarse = [_cuts(x[:, k], PAIR_BINS) for k in range(m)]
    at = [np.searchsorted(cuts[k], x[:, k]) for k in range(m)]
    rough = [np.searchsorted(coarse[k], x[:, k]) for k in range(m)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    z = np.full(n, base)
    least = max(2.0, 0.002 * n * share * (1 - share))

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return weight * (y - p), weight * p * (1 - p)

    for _ in range(ROUNDS):
        for k in range(m):
            g, h = gradients()
            step = RATE * np.clip(_shallow_tree(np.bincount(at[k], g, len(tables[k])), np.bincount(at[k], h, len(tables[k])), least), -4, 4)
            tables[k] += step
            z += step[at[k]]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(rough[a] * (len(coarse[b]) + 1) + rough[b], v, (len(coarse[a]) + 1) * (len(coarse[b]) + 1)).reshape(len(coarse[a]) + 1, -1)

    g, h = gradients()
    gains = {(a, b): _pair_tree(grid(a, b, g), grid(a, b, h), least)[0] for a in range(m) for b in range(a)}
    pairs = {k: np.zeros((len(coarse[k[0]]) + 1, len(coarse[k[1]]) + 1)) for k in sorted(gains, key=gains.get)[-PAIRS:] if gains[k] > 0}
    for _ in range(ROUNDS // 4):
        for (a, b), t in pairs.items():
            g, h = gradients()
            step = RATE * np.clip(_pair_tree(grid(a, b, g), grid(a, b, h), least)[1], -4, 4)
            t += step
            z += step[rough[a], rough[b]]
    return Gam(cuts, base, tables, coarse, pairs)


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fit(docs: DataFrame, labels: DataFrame) -> Gam:
    """Learns from labelled documents whose id's crc32, modulo 5, is not 0, at most ``SAMPLE_ROWS`` of a class."""
    usable = labels.filter(F.col("quality").isin(0, 1) & F.coalesce(id_split("doc_id", 5) != 0, F.lit(False)))
    labelled = usable.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["count"] for r in labelled.groupBy("quality").count().collect()}
    ids = sample_ids(labelled.filter("quality = 1"), "doc_id", SAMPLE_ROWS).unionByName(sample_ids(labelled.filter("quality = 0"), "doc_id", SAMPLE_ROWS))
    sample = labelled_texts(docs, ids, "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "x": pa.array([features(t.as_py()) for t in batch.column("text")], pa.list_(pa.float64())), "quality": batch.column("quality")})

    # at most two times SAMPLE_ROWS short rows come back
    got = sorted(sample.mapInArrow(run, "doc_id long, x array<double>, quality int").collect(), key=lambda r: (r["doc_id"], r["x"]))
    discard(sample)
    x = np.array([r["x"] for r in got], float).reshape(-1, len(FEATURES))
    y = np.array([r["quality"] for r in got], float)
    # a class that was cut to the sample's bound weighs as much as it would have uncut
    weight = np.array([counts[r["quality"]] for r in got], float) / np.maximum(1, np.array([np.sum(y == r["quality"]) for r in got])) if len(got) else np.zeros(0)
    return fit_arrays(x, y, weight / max(weight.mean(), 1e-9) if len(got) else weight)


def score_quality(docs: DataFrame, model: Gam) -> DataFrame:
    """``doc_id, score`` for every document, from its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column("text")], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(shared.value.scores(x))})

    return _source(docs).mapInArrow(run, "doc_id long, score double")
