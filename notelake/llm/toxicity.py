"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length.

Folding maps look-alike letters (Cyrillic, Greek, full width, accented) and digit substitutions to
plain Latin letters, character by character, so spans stay those of the text (without zero-width
characters). Terms match at the start of a word, those of fewer than four characters whole words only (they end
in a blank). A hit inside an exception phrase doesn't count. Terms and their weights (log odds) are learned in
Spark from a bounded sample of labelled documents: word starts and short words that are significantly commoner in toxic ones. The score is a logistic function, fitted
on the same sample, of the weight found and of the weight per 1000 words.

Defined results: null and empty texts have no hit and the lowest score. Repeated rows are each
scored. Without labels the lexicon is empty and every score is 0. Ids may be null or repeated.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, id_split, keep_rows, labelled_texts, sample_ids, stash

#: Most labelled documents of each class that lexicon and score are fitted on.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 8000
#: Fewest and most characters of a word start; shorter words are terms as a whole.
MIN_STEM, MAX_STEM = 4, 14
#: Toxic documents of the sample that a term occurs in at least, and how many times commoner it is there.
LEAST_TOXIC, TIMES = 4, 20
#: Harmless phrases that contain words used as insults.
EXCEPTIONS = (
    "class clown", "clown car", "clown fish", "loser bracket", "pathetic fallacy", "pond scum",
    "scum line", "soap scum", "trash bag", "trash bin", "trash can", "trash folder",
)

# Look-alike letters: fixed values, as text.
_CYRILLIC = ("абвгдеёзийіїјкмнопрстуухѕԁԛԝҽһӏ", "a6bгдee3nniijkmhonpctyyxsdqwehl")
_GREEK = ("αβεηικνορτυχω", "abenikvoptuxw")
_DIGITS = ("013457@$", "oieastas")
ZERO_WIDTH = dict.fromkeys((0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD))


def _fold_table() -> dict[int, str]:
    out: dict[int, str] = {}
    for c in range(0x80):
        ch = chr(c)
        out[c] = ch.lower() if ch.isalpha() else ch if ch.isdigit() else " "
    for c in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF00, 0xFF60)]:
        ch = chr(c)
        base = unicodedata.normalize("NFKD", ch)[0].lower()
        out[c] = base if len(base) == 1 and base.isalnum() else ch.lower()[0] if ch.isalpha() else " "
    for c in range(0x2000, 0x2070):
        out[c] = " "
    for source, target in (_CYRILLIC, _GREEK):
        for a, b in zip(source, target, strict=True):
            out[ord(a)] = b
            if len(a.upper()) == 1:
                out[ord(a.upper())] = b
    for a, b in zip(*_DIGITS, strict=True):
        out[ord(a)] = b
    for c in range(0xFF10, 0xFF1A):
        out[c] = out[ord(str(c - 0xFF10))]
    out[ord("ß")] = "s"
    return out


_FOLD = _fold_table()
_FOLD_ASCII = bytes(ord(_FOLD[c]) if c < 0x80 else c for c in range(256))


def fold(text: str | None) -> str:
    """Folded text of the same length (zero-width characters go first); what is no letter or digit is a space."""
    if not text:
        return ""
    if text.isascii():
        return text.encode().translate(_FOLD_ASCII).decode("ascii")
    if any(chr(c) in text for c in ZERO_WIDTH):
        text = text.translate(ZERO_WIDTH)
    return text.translate(_FOLD)


class ToxicModel:
    def __init__(self, terms: dict[str, float], logistic: tuple[float, float, float], exceptions=EXCEPTIONS):
        self.terms, self.logistic, self.exceptions = terms, logistic, tuple(exceptions)
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for term, weight in self.terms.items():
                a.add_word(" " + term, (len(term), weight))
            for phrase in self.exceptions:
                a.add_word(" " + fold(phrase), (len(fold(phrase)), 0.0))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def spans(self, folded: str) -> list[tuple[int, int, float]]:
        """``(start, end, weight)`` of the hits that no exception phrase covers; one for each word."""
        found: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton().iter(f" {folded} "):
            start = end - size  # one space stands before the text
            end = min(end, len(folded))  # and one after it
            if weight == 0.0:
                if end >= len(folded) or folded[end] == " ":
                    spared.append((start, end))
            elif weight > found.get(start, (0, 0.0))[1]:
                found[start] = (end - folded[start:end].endswith(" "), weight)
        return [(s, e, w) for s, (e, w) in sorted(found.items()) if not any(a <= s and e <= b for a, b in spared)]

    def features(self, text: str | None) -> tuple[float, float]:
        if not self.terms:
            return 0.0, 0.0
        folded = fold(text)
        total = sum(w for _, _, w in self.spans(folded))
        return math.log1p(total), math.log1p(1000 * total / max(1, folded.count(" ") + 1)) if total else 0.0

    def score(self, text: str | None) -> float:
        if not self.terms:
            return 0.0
        a, b = self.features(text)
        w0, w1, w2 = self.logistic
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, w0 + w1 * a + w2 * b))))


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class, in how many documents of these batches a word start occurs."""
    seen = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic"), strict=True):
            starts = set()
            for w in set(fold(text.as_py()).split()):
                starts.update([w[:k] for k in range(MIN_STEM, min(len(w), MAX_STEM) + 1)] or [w + " "])
            seen[toxic.as_py()].update(starts)
        if len(seen[0]) + len(seen[1]) > 1_000_000:
            yield _counted(seen)
            seen = (Counter(), Counter())
    yield _counted(seen)


def _counted(seen) -> pa.RecordBatch:
    keys = [*seen[1], *(k for k in seen[0] if k not in seen[1])]
    return pa.RecordBatch.from_pydict({"stem": pa.array(keys, pa.string()), "p": pa.array([seen[1][k] for k in keys], pa.int64()), "n": pa.array([seen[0][k] for k in keys], pa.int64())})


def _ratio(p: Column, n: Column, pos: int, neg: int) -> Column:
    """Log likelihood ratio of a term's counts against equal rates in both classes."""
    t, total = p + n, pos + neg
    part = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    rest = F.lit(total) - t
    return 2 * (part(p, t * (pos / total)) + part(n, t * (neg / total)) + part(F.lit(pos) - p, rest * (pos / total)) + part(F.lit(neg) - n, rest * (neg / total)))


def choose_terms(good: dict[str, tuple[int, int]], pos: int, neg: int) -> dict[str, float]:
    """Weights of significant word starts; of nested ones, the longest that is about as common as the shortest."""
    longer: dict[str, list[str]] = {}
    for stem in sorted(good):
        longer.setdefault(stem[:-1], []).append(stem)
    terms: dict[str, float] = {}
    for stem in sorted(good):
        if any(stem[:k] in good for k in range(MIN_STEM, len(stem))):
            continue
        best, step = "", stem
        while step:
            best, step = step, next((s for s in longer.get(step, ()) if good[s][0] >= 0.95 * good[stem][0]), "")
        p, n = good[best]
        terms[best] = math.log((p + 0.5) / (pos + 1)) - math.log((n + 0.5) / (neg + 1))
    return terms


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-3, 0.3, 0.3])
        w -= np.linalg.solve(h, a.T @ (p - y) + np.array([1e-3, 0.3, 0.3]) * w)
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """Learns from labelled documents whose id's crc32, modulo 4, is not 2, at most ``SAMPLE_*`` of a class."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.coalesce(id_split("doc_id", 4) != 2, F.lit(False)))
    labelled = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = sample_ids(labelled.filter("toxic = 1"), "doc_id", SAMPLE_TOXIC).unionByName(sample_ids(labelled.filter("toxic = 0"), "doc_id", SAMPLE_CLEAN))
    sample = labelled_texts(docs, ids, "toxic").select("text", F.col("toxic").cast("int").alias("toxic"))
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)
    terms: dict[str, float] = {}
    if pos and neg:
        counted = sample.mapInArrow(_starts, "stem string, p long, n long").groupBy("stem").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
        tested = stash(counted.filter((F.col("p") >= LEAST_TOXIC) & (F.col("p") * neg > F.col("n") * pos * TIMES)), "stems")
        # the more word starts are tested, the more significant each has to be; those that are, all come back
        limit = 2 * math.log(max(2, tested.count())) + 4
        good = tested.filter((F.col("p") * neg > (F.col("n") + 0.5) * pos * TIMES) & (_ratio(F.col("p"), F.col("n"), pos, neg) >= limit))
        terms = choose_terms({r["stem"]: (r["p"], r["n"]) for r in good.collect()}, pos, neg)
        discard(tested)
    model = ToxicModel(terms, (0.0, 0.0, 0.0))
    if not terms:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [shared.value.features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in f], pa.float64()), "b": pa.array([x[1] for x in f], pa.float64()), "toxic": batch.column("toxic")})

    # three numbers for each document of the sample
    got = sorted(sample.mapInArrow(run, "a double, b double, toxic int").collect())
    model.logistic = _fit_logistic(np.array([(r["a"], r["b"]) for r in got]), np.array([r["toxic"] for r in got], float))
    return model


def score_toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """``doc_id, score`` for every document, from its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array([m.score(t) for t in texts], pa.float64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def toxic_spans(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """A row for each hit: ``doc_id, start, end, weight``; positions in the folded text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            rows = [(i.as_py(), *s) for i, t in zip(batch.column("doc_id"), batch.column("text"), strict=True) for s in m.spans(fold(t.as_py()))]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "start": pa.array([r[1] for r in rows], pa.int64()), "end": pa.array([r[2] for r in rows], pa.int64()), "weight": pa.array([r[3] for r in rows], pa.float64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, end long, weight double")


def keep_clean(docs: DataFrame, model: ToxicModel, reject_from: float = 0.3) -> DataFrame:
    """The documents that score below ``reject_from``, with all their columns."""
    return keep_rows(docs, model, lambda m, text: m.score(text) < reject_from)
