"""Quality rules: a linear-chain conditional random field marks each line as content or boilerplate.

Exact counts come first (words, symbols, repeated lines and word windows) with two base rules on them. A Viterbi pass
over each text's lines with weights fitted on a bounded labelled sample then marks the lines; the share of words in
content lines decides whether the text stays. Labels are of texts, so for fitting the texts of both classes are glued
to sequences in which labels change where texts meet: that is what the weights of label pairs are learnt from, and it
lets a text that is part content and part boilerplate get both labels. All lines of the sampled texts are read.

Null and empty texts have no words, fail the base rules and aren't kept; texts of any length are judged whole; equal
texts have equal results; null ids are ids like all others; an empty table gives no rows; without labels of both classes every line counts as content.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ruleweft.llm.bytesops import CONTINUES, SPACE, U, Hasher, lines, mix, owners, per_row, repeated, later, windows, words
from ruleweft.llm.common import flat_bytes, ids_and_text, slices, spread
from ruleweft.llm.sampling import fitted, parts

SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
UPPER, LOWERCASE = np.isin(np.arange(256), range(65, 91)), np.isin(np.arange(256), range(97, 123))
DIGITS, MARKS = np.isin(np.arange(256), range(48, 58)), np.isin(np.arange(256), [ord(c) for c in ".,;:!?"])
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Share of words in content lines from which a text stays.
CONTENT_SHARE = 0.5
#: Sequences that the labelled texts are glued to for fitting.
CHAINS = 256
#: How often a text of the smaller class takes part, at most.
MOST_TIMES = 32
#: Labelled texts of each class that fitting reads, at most.
PER_CLASS = 2000
N_FEATURES = 12


def measure(data: np.ndarray, offs: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Counts by row; then line features, words of each line, and the rows' line offsets."""
    starts, ends, at = words(data, offs)
    h = Hasher(data)
    word = h.spans(starts, ends)
    row_of_word = owners(at)
    keys, wat = windows(word, at, WINDOW)
    twice = repeated(keys ^ mix(owners(wat).astype(U) + U(1)))
    # a word is covered if one of the windows that end or begin around it repeats
    delta = np.zeros(len(word) + 1, np.int64)
    first = np.repeat(at[:-1] - wat[:-1], np.diff(wat)) + np.arange(len(keys))
    np.add.at(delta, first[twice], 1)
    np.add.at(delta, first[twice] + WINDOW, -1)
    covered = np.cumsum(delta[:-1]) > 0

    ls, le, lat = lines(data, offs)
    wl = np.searchsorted(starts, ls), np.searchsorted(starts, le)  # words of each line
    n = wl[1] - wl[0]
    row_of_line = owners(lat)
    some = n > 0
    dup = np.zeros(len(ls), bool)
    dup[some] = later(h.spans(ls, le)[some] ^ mix(row_of_line[some].astype(U) + U(1)))
    counts = {
        "n_words": np.diff(at),
        "word_chars": per_row(~SPACE[data] & ~CONTINUES[data], offs),
        "n_symbols": per_row(SYMBOLS[data], offs),
        "n_dup_lines": per_row(dup, lat),
        "n_repeat_words": per_row(covered, at),
    }

    same = np.zeros(len(word), bool)  # equals the word before it in the row
    same[1:] = (word[1:] == word[:-1]) & (row_of_word[1:] == row_of_word[:-1])
    twice_apart = np.zeros(len(word), bool)
    twice_apart[2:] = (word[2:] == word[:-2]) & (row_of_word[2:] == row_of_word[:-2])
    mark_end = MARKS[data[ends - 1]] if len(ends) else np.zeros(0, bool)

    def share(flags: np.ndarray, a: np.ndarray, b: np.ndarray, of: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return (sums[b] - sums[a]) / np.maximum(of, 1)

    size = le - ls
    letters = share(UPPER[data] | LOWERCASE[data], ls, le, 1)
    f = np.zeros((len(ls), N_FEATURES))
    f[:, 0] = 1
    f[:, 1] = np.minimum(share(SYMBOLS[data], ls, le, n), 3)
    f[:, 2] = share(UPPER[data], ls, le, letters)
    f[:, 3] = share(same, *wl, n)
    f[:, 4] = share(twice_apart, *wl, n)
    f[:, 5] = share(covered, *wl, n)
    f[:, 6] = dup
    f[:, 7] = share(DIGITS[data], ls, le, size)
    f[:, 8] = share(mark_end, *wl, n)
    f[:, 9] = np.log1p(n) / 4
    f[:, 10] = np.minimum(share(data == 33, ls, le, n), 3)
    f[:, 11] = np.sqrt(np.minimum(f[:, 1], 1))  # few symbols tell much
    return counts, f, n, lat


@dataclass
class Crf:
    """Weights of the two labels (0 boilerplate, 1 content) for a line's features, and of label pairs in sequence."""

    emit: np.ndarray
    move: np.ndarray

    def viterbi(self, f: np.ndarray, lat: np.ndarray) -> np.ndarray:
        """The likeliest labels of all rows' lines: one step for all rows at once, longest rows first."""
        score, out = f @ self.emit, np.zeros(len(f), np.int64)
        n = np.diff(lat)
        order = np.argsort(-n, kind="stable")
        start, n = lat[:-1][order], n[order]
        back = np.zeros((len(f), 2), np.int64)
        best = np.zeros((len(n), 2))
        for t in range(int(n[0]) if len(n) else 0):
            live = int(np.searchsorted(-n, -t, "left"))  # rows with more than t lines
            at = start[:live] + t
            if not t:
                best[:live] = score[at]
                continue
            way = best[:live, :, None] + self.move[None]
            back[at] = way.argmax(1)
            best[:live] = way.max(1) + score[at]
        state = best.argmax(1)
        for t in range(int(n[0]) - 1 if len(n) else -1, -1, -1):
            live = int(np.searchsorted(-n, -t, "left"))
            at = start[:live] + t
            out[at] = state[:live]
            state[:live] = back[at, state[:live]]
        return out


def fit(texts: pa.Array, y: np.ndarray, steps: int = 100, rate: float = 0.2, ridge: float = 1e-3, chains: int = CHAINS) -> Crf:
    """Maximises the conditional likelihood of the labels of glued texts by gradient ascent; each line has its text's.

    The texts of the class with fewer lines take part several times, so that neither label is the likelier one.
    """
    crf = Crf(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)))
    crf.emit[0, 1] = 1.0  # without labels of both classes every line is content
    kept, sizes, labels = [np.zeros((0, N_FEATURES), np.float32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for data, offs, own_y in parts(texts, y):
        counts, f, _, lat = measure(data, offs)
        rows = np.flatnonzero(counts["n_words"] >= MIN_WORDS)
        size = np.diff(lat)[rows]
        kept.append(f[spread(rows, lat[:-1], np.diff(lat))].astype(np.float32))
        sizes.append(size)
        labels.append(own_y[rows])
    f, size, y = np.concatenate(kept), np.concatenate(sizes), np.concatenate(labels)
    if len(set(y.tolist())) < 2:
        return crf
    # texts meet in an order that has nothing to do with their ids
    lines_of = np.bincount(y, weights=size, minlength=2)
    few = int(lines_of[0] > lines_of[1])
    times = max(1, round(lines_of[1 - few] / max(1, lines_of[few])))
    order = np.random.default_rng(5).permutation(np.concatenate([np.arange(len(size)), np.repeat(np.flatnonzero(y == few), min(times, MOST_TIMES) - 1)]))
    at = spread(order, np.cumsum(size) - size, size)
    n, top = len(at), -(-len(at) // chains)
    pad = np.zeros(top * chains - n, np.int64)
    lay = lambda v: np.concatenate([v, pad.astype(v.dtype)]).reshape(chains, top).T
    where, line_y, on = lay(at), lay(np.repeat(y[order], size[order])), lay(np.ones(n, bool))
    x = f[where]
    theta = [np.zeros((N_FEATURES, 2)), np.zeros((2, 2))]
    m, v = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta]
    want = np.zeros((top, chains, 2))
    np.put_along_axis(want, line_y[:, :, None], 1.0, 2)
    weight, pairs = on / n, on[1:] / n
    seen = np.array([[(pairs * (line_y[:-1] == r) * (line_y[1:] == s)).sum() for s in (0, 1)] for r in (0, 1)])
    for step in range(1, steps + 1):
        e = x @ theta[0]
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[0] = e[0]
        for t in range(1, top):
            a[t] = np.where(on[t][:, None], np.logaddexp(a[t - 1][:, 0, None] + theta[1][0], a[t - 1][:, 1, None] + theta[1][1]) + e[t], a[t - 1])
        for t in range(top - 2, -1, -1):
            u = e[t + 1] + b[t + 1]
            b[t] = np.where(on[t + 1][:, None], np.logaddexp(theta[1][None, :, 0] + u[:, 0, None], theta[1][None, :, 1] + u[:, 1, None]), 0)
        z = np.logaddexp(a[-1][:, 0], a[-1][:, 1])
        p = np.exp(a + b - z[None, :, None])
        g_emit = np.einsum("tnk,tns->ks", x, (want - p) * weight[:, :, None])
        pair = np.exp(a[:-1, :, :, None] + theta[1][None, None] + (e[1:] + b[1:])[:, :, None, :] - z[None, :, None, None])
        g_move = seen - (pair * pairs[:, :, None, None]).sum((0, 1))
        for k, g in enumerate((g_emit - ridge * theta[0], g_move - ridge * theta[1])):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            theta[k] = theta[k] + rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Crf(*theta)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Crf:
    """Fits the weights on at most ``per_class`` labelled texts of each class."""
    return fitted(docs, labels, "quality", lambda texts, y, counts: fit(texts, y), per_class=per_class)


def judge(data: np.ndarray, offs: np.ndarray, crf: Crf, share: float = CONTENT_SHARE) -> dict[str, np.ndarray]:
    """Counts, base_failed, n_content_words and kept by row."""
    out, f, n, lat = measure(data, offs)
    good = crf.viterbi(f, lat) == 1
    out["n_content_words"] = per_row(np.where(good, n, 0), lat)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * out["n_words"])
    out["kept"] = ~out["base_failed"] & (out["n_content_words"] >= share * np.maximum(out["n_words"], 1))
    return out


NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality(docs: DataFrame, crf: Crf) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept and n_content_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            r = judge(*flat_bytes(b.column(1)), crf)
            yield pa.record_batch([b.column(0), *(pa.array(r[c].astype(np.int64)) for c in NUMBERS), pa.array(r["base_failed"]), pa.array(r["kept"]), pa.array(r["n_content_words"].astype(np.int64))], ["doc_id", *NUMBERS, "base_failed", "kept", "n_content_words"])

    return ids_and_text(docs).mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in NUMBERS)}, base_failed boolean, kept boolean, n_content_words long")


def only_good(docs: DataFrame, crf: Crf) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield b.filter(pa.array(judge(*flat_bytes(b.column(at)), crf)["kept"]))

    return docs.mapInArrow(run, docs.schema)
