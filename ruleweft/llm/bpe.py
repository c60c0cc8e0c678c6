"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

A batch's new words lie in one flat symbol array. Each round looks all neighbouring pairs up by binary search over the
sorted pair keys, takes the lowest rank in each word, and merges its occurrences from the left; words without a known
pair are done. A long word would need a round over all its symbols for each of its ranks, so its rounds visit only the
places where a rank occurs. Words seen before come from a bounded cache. Decoding gathers the ids' bytes.

Null is the empty text (no ids, hash of nothing); very long texts are whole rows, and the time for a long word without
blanks follows its length; equal rows give equal results, null ids are ids like all others; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ruleweft.llm.common import ids_and_text, slices, spread, strings
from ruleweft.llm.packing import BYTE_CHARS, tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
CACHE_WORDS = 400_000
#: Bytes of a word from which its merge rounds go by rank.
LONG = 1024
#: The byte-level pre-tokeniser's published pattern. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBPE:
    """Vocabulary and merges of a byte-level BPE file as arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, chars = spec["model"]["vocab"], {c: b for b, c in BYTE_CHARS.items()}
        self.size = max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]) + 1
        raw = [b""] * self.size
        for t, i in vocab.items():
            raw[i] = bytes(chars[c] for c in t) if all(c in chars for c in t) else t.encode()
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for t, i in self.special.items():
            raw[i] = t.encode()
        self.of_byte = np.zeros(256, np.int64)
        for c, b in chars.items():
            self.of_byte[b] = vocab[c]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.token_lens = np.array([len(x) for x in raw], np.int64)
        self.token_offs = np.cumsum(self.token_lens) - self.token_lens
        self.token_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.words = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; the number of merges for those that never merge."""
        pair = left * self.size + right
        at = np.searchsorted(self.keys, pair)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == pair, self.ranks[at], len(self.keys))

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one word: a round for each rank in turn, over the places where it occurs."""
        sym = self.of_byte[np.frombuffer(word, np.uint8)]
        n, none = len(sym), len(self.keys)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n, none)  # of the pair that begins at a place
        rank[:-1] = self.rank(sym[:-1], sym[1:])
        live = np.ones(n, bool)
        todo: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(places: np.ndarray) -> None:
            r = rank[places]
            order = np.argsort(r, kind="stable")
            places, r = places[order], r[order]
            cut = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, np.int64)
            for k, a, b in zip(r[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(r)], strict=False):
                if k == none:
                    break
                if k not in todo:
                    todo[k] = []
                    heapq.heappush(heap, k)
                todo[k].append(places[a:b])

        add(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            got = todo.pop(r)
            at = np.unique(np.concatenate(got)) if len(got) > 1 else got[0]
            at = at[rank[at] == r]  # places that changed since are out
            if not len(at):
                continue
            if len(at) > 1:  # of overlapping hits (x x x) every second one merges, from the left
                tied = np.r_[False, after[at[:-1]] == at[1:]]
                if tied.any():
                    run = np.arange(len(at)) - np.maximum.accumulate(np.where(tied, 0, np.arange(len(at))))
                    at = at[run % 2 == 0]
            gone = after[at]
            far = after[gone]
            sym[at], rank[gone], live[gone], after[at] = self.made[r], none, False, far
            inner = far < n
            before[far[inner]] = at[inner]
            rank[at] = none
            rank[at[inner]] = self.rank(sym[at[inner]], sym[far[inner]])
            prior = before[at]
            prior = prior[prior >= 0]
            rank[prior] = self.rank(sym[prior], sym[after[prior]])
            add(np.unique(np.concatenate([at[inner], prior])))
        return sym[live]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each has."""
        if any(len(w) >= LONG for w in words):
            out = [self.merge_long(w) if len(w) >= LONG else None for w in words]
            flat, lens = self.merge([w for w, x in zip(words, out, strict=True) if x is None])
            short = iter(np.split(flat, np.cumsum(lens)[:-1])) if len(lens) else iter(())
            out = [next(short) if x is None else x for x in out]
            return np.concatenate(out), np.array([len(x) for x in out])
        lens = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        own = np.repeat(np.arange(len(words)), lens)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = len(self.keys)
        while len(sym):
            pair = sym[:-1] * self.size + sym[1:]
            at = np.searchsorted(self.keys, pair)
            at[at == none] = 0
            rank = np.where((self.keys[at] == pair) & (own[:-1] == own[1:]), self.ranks[at], none)
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            low = np.minimum.reduceat(np.append(rank, none), starts)  # a word's last place never holds a pair
            sizes = np.diff(np.append(starts, len(sym)))
            live = np.repeat(low < none, sizes)
            done.append((own[~live], sym[~live]))
            hit = (rank == np.repeat(low, sizes)[:-1]) & live[:-1]
            # of overlapping hits (x x x) every second one merges, from the left
            run = np.arange(len(hit)) - np.maximum.accumulate(np.where(hit, -1, np.arange(len(hit))))
            hit &= run % 2 == 1
            left = np.flatnonzero(hit)
            sym[left] = self.made[rank[left]]
            live[left + 1] = False
            sym, own = sym[live], own[live]
        own, sym = (np.concatenate([x[i] for x in done]) if done else np.zeros(0, np.int64) for i in (0, 1))
        order = np.argsort(own, kind="stable")
        return sym[order], np.bincount(own, minlength=len(words))

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids' tokens; bytes that are no UTF-8 become U+FFFD."""
        out = self.token_bytes[spread(ids, self.token_offs, self.token_lens)].tobytes()
        return out.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


class Encoder(dict):
    """Encodes texts; remembers words' ids up to a bound."""

    def __init__(self, bpe: ByteBPE) -> None:
        self.bpe = bpe
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new: list[str] = []
        special = list(self.bpe.special.items())
        # special tokens take the first codes, under keys that no word can have
        self.flat = np.array([i for _, i in special], np.int64)
        self.lens = np.ones(len(special), np.int64)
        self.offs = np.arange(len(special))
        for k, (t, _) in enumerate(special):
            self[(t,)] = k

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = n = len(self)
        return n

    def codes(self, text: str) -> np.ndarray:
        get, find = self.__getitem__, self.bpe.words.findall
        if self.bpe.split is None or not any(t in text for t in self.bpe.special):
            return np.fromiter(map(get, find(text)), np.int64)
        out: list[int] = []
        for k, part in enumerate(self.bpe.split.split(text)):
            out += [get((part,))] if k % 2 else map(get, find(part))
        return np.array(out, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the n + 1 offsets of the texts."""
        if len(self) > CACHE_WORDS:
            self.reset()
        codes = [self.codes(t) for t in texts]
        if self.new:
            flat, lens = self.bpe.merge([w.encode() for w in self.new])
            self.offs = np.concatenate([self.offs, len(self.flat) + np.cumsum(lens) - lens])
            self.flat, self.lens, self.new = np.concatenate([self.flat, flat]), np.concatenate([self.lens, lens]), []
        sizes = np.array([self.lens[c].sum() for c in codes], np.int64)
        every = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        return self.flat[spread(every, self.offs, self.lens)], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of each row."""
    path = path or tokenizer_path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(load(path))
        for b in slices(batches, "text", 4 << 20):
            ids, offs = e.encode(strings(b.column(1)))
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return ids_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) to (doc_id, text); null ids give the empty text."""
    path = path or tokenizer_path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            texts = [bpe.decode(np.array(x or [], np.int64)).decode() for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def bpe_round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of each text's ids and of what they decode to: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = path or tokenizer_path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        e = Encoder(bpe)
        for b in slices(batches, "text", 4 << 20):
            ids, offs = e.encode(strings(b.column(1)))
            raw, n, a, z = ids.astype("<u4"), [], [], []
            for s, t in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                n.append(t - s)
                a.append(hashlib.sha256(raw[s:t].tobytes()).hexdigest())
                z.append(hashlib.sha256(bpe.decode(ids[s:t])).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(z)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return ids_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
