"""Toxic passages by maximum-scoring segments of token log-odds.

Tokens are runs of letters, digits and non-ASCII bytes, A-Z lower-cased. Log-odds with an informative Dirichlet prior
compare how many toxic and clean labelled texts hold a token, or a prefix of one (which covers inflected and compound
forms); features whose likelihood ratio is high enough form the lexicon, and any other token costs ``gap``. A linear-time scan
over a text's tokens yields all maximal scoring segments. A segment of score S in a text of n tokens is judged by
extreme-value statistics, p = 1 - exp(-K n exp(-lambda S)), where lambda solves E[exp(lambda s)] = 1 over clean tokens
and K is the likeliest one for the best segments of clean texts. The text's evidence is the sum of -ln p over all its
segments, where those that chance explains add next to nothing, and a logistic curve fitted on the labelled sample
turns evidence into a probability. Segments with a low p are the passages that are reported.

Null and empty texts have no tokens and the score of no evidence; texts are scored whole; equal texts have equal
scores; null ids are scored and never held out; without labelled rows of both classes every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ruleweft.llm.bytesops import LETTERLIKE, LOWER, U, Hasher, mix, owners, runs
from ruleweft.llm.common import flat_bytes, ids_and_text, slices
from ruleweft.llm.sampling import fitted, held_out, parts

#: Lengths in bytes of the prefixes that are features besides the whole token (0).
PREFIXES = (0, 4, 5, 6, 7)
#: Likelihood ratio (G) of a feature's counts and log-odds from which it is in the lexicon, and the fewest toxic texts
#: that hold it. G is high enough for a million features to be tested; the log-odds keep out the plain words of a
#: language that merely has more toxic texts than others.
LIKELIHOOD, LOG_ODDS, LEAST_TEXTS = 23.0, 2.5, 4
#: Cost of a token outside the lexicon, and what the prior counts for, in texts.
GAP, PRIOR = 0.05, 4.0
#: p-value up to which a segment is a passage.
P_VALUE = 0.05
THRESHOLD = 0.7


def features(data: np.ndarray, offs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each length of PREFIXES the tokens' hashes (0 where the token isn't longer), and the rows' token offsets."""
    data = LOWER[data]
    starts, ends, at = runs(LETTERLIKE[data], offs)
    h, out = Hasher(data), []
    for k in PREFIXES:
        x = h.spans(starts, ends if not k else np.minimum(starts + k, ends))
        x = mix(x + U(k)) | U(1)
        if k:
            x[ends - starts <= k] = 0
        out.append(x)
    return out, at


def segments(scores: list[float], gaps: list[int], gap: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last) of a sequence of positive scores with gaps before them.

    ``gaps[i]`` tokens of cost ``gap`` lie before score i. Ruzzo and Tompa's scan: a candidate joins the latest
    earlier one whose left sum is lower than its own, provided that one's right sum isn't already as high.
    """
    found: list[tuple[float, float, int, int]] = []  # left sum, right sum, first, last
    total = 0.0
    for i, (s, g) in enumerate(zip(scores, gaps, strict=True)):
        left = total - gap * g
        total = left + s
        new = (left, total, i, i)
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= new[0]:
                j -= 1
            if j < 0 or found[j][1] >= new[1]:
                found.append(new)
                break
            new = (found[j][0], new[1], found[j][2], new[3])
            del found[j:]
    return [(r - left, a, b) for left, r, a, b in found]


@dataclass
class Model:
    """Lexicon (sorted hashes and scores by prefix length), extreme-value parameters, and the calibration curve."""

    keys: list[np.ndarray]
    scores: list[np.ndarray]
    lam: float
    k: float
    slope: float
    bias: float

    def hits(self, feats: list[np.ndarray]) -> np.ndarray:
        """Each token's highest score, 0 outside the lexicon."""
        out = np.zeros(len(feats[0]))
        for x, keys, scores in zip(feats, self.keys, self.scores, strict=True):
            if len(keys):
                i = np.searchsorted(keys, x)
                i[i == len(keys)] = 0
                np.maximum(out, np.where(keys[i] == x, scores[i], 0), out=out)
        return out

    def passages(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, float, float]]]:
        """Each row's evidence, and its significant segments (row, first token, last token, score, p-value)."""
        evidence, found = np.zeros(len(offs) - 1), []
        for r, n, i, j, s in self.maximal(data, offs):
            p = -np.expm1(-min(self.k * n * np.exp(-self.lam * s), 700.0))
            evidence[r] -= np.log(max(p, 1e-300))
            if p <= P_VALUE:
                found.append((r, i, j, s, float(p)))
        return evidence, found

    def maximal(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """All maximal segments: row, its tokens, first and last token, score."""
        feats, at = features(data, offs)
        hit = self.hits(feats)
        where = np.flatnonzero(hit)
        rows = owners(at)[where]
        cuts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rows)], strict=False):
            r = int(rows[a])
            pos = (where[a:b] - at[r]).tolist()
            n = int(at[r + 1] - at[r])
            gaps = [pos[0], *(y - x - 1 for x, y in zip(pos, pos[1:], strict=False))]
            for s, i, j in segments(hit[where[a:b]].tolist(), gaps, GAP):
                yield r, n, pos[i], pos[j], s

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * np.sqrt(evidence) + self.bias)))


def fit(texts: pa.Array, y: np.ndarray, counts: dict[int, int]) -> Model:
    """Fits the lexicon, lambda and the curve on labelled texts; ``counts``: rows of each class in all."""
    empty = Model([np.zeros(0, U)] * len(PREFIXES), [np.zeros(0)] * len(PREFIXES), 1.0, 1.0, 0.0, -800.0)
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    if not n1 or not n0:
        return empty
    held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in PREFIXES]
    for data, offs, own_y in parts(texts, y):
        feats, at = features(data, offs)
        own = owners(at)
        for x, found in zip(feats, held, strict=True):
            some = x != 0
            f, rows = _unique_pairs(x[some], own[some])
            found.append((f, own_y[rows] == 1))
    keys, scores = [], []
    for found in held:
        f, i = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
        pos = np.bincount(i, weights=np.concatenate([x for _, x in found]), minlength=len(f))
        neg = np.bincount(i, minlength=len(f)) - pos
        found.clear()
        prior = PRIOR * (pos + neg + 1) / (n1 + n0 + 2)
        a1, a0 = pos + prior * n1 / (n1 + n0), neg + prior * n0 / (n1 + n0)
        b1, b0 = n1 + PRIOR - a1, n0 + PRIOR - a0
        delta = np.log(a1 / np.maximum(b1, 0.5)) - np.log(a0 / np.maximum(b0, 0.5))
        part = lambda got, want: got * np.log(np.maximum(got, 1e-12) / want)
        g = 2 * (part(pos, (pos + neg) * n1 / (n1 + n0)) + part(neg, (pos + neg) * n0 / (n1 + n0)))
        keep = (g >= LIKELIHOOD) & (pos >= LEAST_TEXTS) & (delta >= LOG_ODDS)
        keys.append(f[keep])
        scores.append(delta[keep])
    model = Model(keys, scores, 1.0, 1.0, 0.0, 0.0)
    # lambda solves E[exp(lambda s)] = 1 over the tokens of clean texts, one token smoothing the lexicon's share
    every, clean, n = [np.zeros(0)], [np.zeros(0)], 1
    for data, offs, own_y in parts(texts, y):
        feats, at = features(data, offs)
        hit, ok = model.hits(feats), own_y[owners(at)] == 0
        every.append(hit[hit > 0])
        clean.append(hit[ok & (hit > 0)])
        n += int(ok.sum())
    every = np.concatenate(every)
    s = np.append(np.concatenate(clean), [float(np.median(every)) if len(every) else 1.0])
    lo, hi = 1e-6, 50.0
    for _ in range(80):
        lam = (lo + hi) / 2
        lo, hi = (lam, hi) if np.exp(np.minimum(lam * s, 600)).sum() / n + (1 - len(s) / n) * np.exp(-lam * GAP) < 1 else (lo, lam)
    model.lam = lo
    model.k = _location(model, texts, y)
    evidence = np.sqrt(np.concatenate([model.passages(data, offs)[0] for data, offs, _ in parts(texts, y)]))
    model.slope, model.bias = _logistic(evidence, y == 1)
    # the sample holds the classes in other shares than the labelled rows do
    model.bias += np.log(max(counts.get(1, n1), 1) / max(counts.get(0, n0), 1)) - np.log(n1 / n0)
    return model


def _location(model: Model, texts: pa.Array, y: np.ndarray) -> float:
    """The likeliest K for clean texts' best segments: texts without any count as below the lowest score; one text with
    that score smooths."""
    top, tokens = [np.zeros(0)], [np.zeros(0)]
    for data, offs, own_y in parts(texts, y):
        best, n = np.zeros(len(own_y)), np.diff(features(data, offs)[1])
        for r, _, _, _, s in model.maximal(data, offs):
            best[r] = max(best[r], s)
        top.append(best[own_y == 0])
        tokens.append(n[own_y == 0])
    best, n = np.concatenate(top), np.concatenate(tokens)
    least = min((float(x.min()) for x in model.scores if len(x)), default=1.0)
    seen = best > 0
    mean = float(n.mean()) if len(n) else 1.0
    return float((seen.sum() + 1) / max(1e-12, (n * np.exp(-model.lam * np.where(seen, best, least))).sum() + mean * np.exp(-model.lam * least)))


def _unique_pairs(x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((own, x))
    x, own = x[order], own[order]
    first = np.ones(len(x), bool)
    first[1:] = (x[1:] != x[:-1]) | (own[1:] != own[:-1])
    return x[first], own[first]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Slope (not below 0) and intercept by Newton's method with a small ridge on the slope."""
    a, b = 0.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([(x * (y - p)).sum() - ridge * a, (y - p).sum()])
        h = np.array([[(w * x * x).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        step *= min(1, 2 / max(1e-12, np.abs(step).max()))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 0.0), float(b)


def train(docs: DataFrame, labels: DataFrame, **options: int) -> Model:
    """Learns from labelled rows that are not held out; at most ``per_class`` of each class."""
    return fitted(docs, labels, "toxic", fit, ~held_out(), **options)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted, n_passages) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            evidence, found = model.passages(*flat_bytes(b.column(1)))
            p = model.probability(evidence)
            n = np.bincount([x[0] for x in found], minlength=len(p)) if found else np.zeros(len(p), np.int64)
            yield pa.record_batch([b.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(n.astype(np.int64))], ["doc_id", "score", "predicted", "n_passages"])

    return ids_and_text(docs).mapInArrow(run, "doc_id long, score double, predicted int, n_passages long")


def toxicity(docs: DataFrame, labels: DataFrame, **options: int) -> DataFrame:
    """Scores of all documents, with ``held_out``."""
    return score(docs, train(docs, labels, **options)).withColumn("held_out", held_out())


def without_toxic(docs: DataFrame, labels: DataFrame, **options: int) -> DataFrame:
    """The rows of ``docs`` whose text isn't predicted toxic, with all their columns."""
    model = train(docs, labels, **options)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            p = model.probability(model.passages(*flat_bytes(b.column(at)))[0])
            yield b.filter(pa.array(p < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
