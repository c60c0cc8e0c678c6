"""Best-fit packing of tokenised documents by hierarchical residual packing.

Documents are cut into pieces of at most ``capacity`` tokens. Pieces are dealt by their place to groups of bounded
size; each group packs best-fit decreasing and emits its nearly full bins. All others are items of the next round,
which deals them to fewer groups, so that a tree of groups forms over what is left; it ends in one group, or in a round
that hardly merges any bins. No group grows with the corpus.

A tokenizer that lower-cases and splits at blanks as the default one does is run on words; any other on whole texts.

Nulls and empty texts are documents of the closing token alone; rows with a null ``doc_id`` are kept and packed like
any other; equal rows are packed once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleweft.llm.common import ids_and_text, remove, shared_dir, slices, spread, stash, strings

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Bins in a group, and pieces in a group of later rounds for each of them; on average.
GROUP_ITEMS, GROUP_PIECES = 50_000, 8
#: Share of bins that a later round has to merge for another one to follow.
PROGRESS = 0.02
#: Free tokens up to which a bin counts as nearly full.
SLACK = 8
#: Words whose ids a worker remembers.
CACHE_WORDS = 600_000


def byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


BYTE_CHARS = byte_chars()


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class ChunkIds(dict):
    """Ids of texts between blanks. The tokenizer drops blanks and no token spans one, so chunks are encoded apart.

    A chunk of letters, with or without one full stop or comma behind it, is its letters' ids (in lower case) and the
    mark's. Chunks and letter runs seen before come from bounded caches.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.cores: dict[str, int] = {"": 0, ".": 1, ",": 2}
        self.new: list[str] = []
        self.parts: list[int] = []  # of each new chunk: its core, and what is behind it
        self.known = np.zeros((0, 2), np.int64)
        marks = [e.ids for e in _tokenizer(self.path).encode_batch([".", ","], add_special_tokens=False)]
        self.flat = np.array([i for x in marks for i in x], np.uint32)
        self.lens = np.array([0, *map(len, marks)], np.int64)
        self.offs = np.cumsum(self.lens) - self.lens

    def __missing__(self, chunk: str) -> int:
        core, tail = chunk, 0
        if chunk[-1:] in (".", ",") and chunk[:-1].isalpha():
            core, tail = chunk[:-1], 1 if chunk[-1] == "." else 2
        if core.isalpha() and (core.isascii() or "\u03a3" not in core and is_normalized("NFC", core)):  # capital sigma's small form varies
            core = core.lower()
        if (k := self.cores.get(core)) is None:
            k = self.cores[core] = len(self.cores)
            self.new.append(core)
        self.parts += k, tail
        self[chunk] = n = len(self)
        return n

    def _encode_new(self) -> None:
        tok, found, rest = _tokenizer(self.path), [], []
        one = tok.model.tokenize
        for c in self.new:
            if c.isascii() and c.isalpha() and c.islower():  # stands for itself in the byte-level vocabulary
                found.append([t.id for t in one(c)])
            elif self.plain(c):
                found.append([t.id for t in one("".join(map(BYTE_CHARS.__getitem__, c.encode())))])
            else:
                rest.append(len(found))
                found.append(c)
        whole = tok.encode_batch([found[i] for i in rest], add_special_tokens=False)
        for i, e in zip(rest, whole, strict=True):
            found[i] = e.ids
        lens = np.fromiter(map(len, found), np.int64, len(found))
        self.offs = np.concatenate([self.offs, len(self.flat) + np.cumsum(lens) - lens])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.uint32, int(lens.sum()))])
        self.lens, self.new = np.concatenate([self.lens, lens]), []

    @staticmethod
    def plain(core: str) -> bool:
        """Letters that the normaliser and the pre-tokeniser leave as they are: one word for the merges alone."""
        return core.isalpha() and core.islower() and is_normalized("NFC", core) and core.lower() == core

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the n + 1 offsets of the texts."""
        if len(self) > CACHE_WORDS or len(self.cores) > CACHE_WORDS:
            self.reset()
        get, codes = self.__getitem__, []
        for t in texts:
            codes.append(np.fromiter(map(get, t.replace("\n", " ").split(" ")), np.int64))
        if self.new:
            self._encode_new()
        self.known = np.concatenate([self.known, np.array(self.parts, np.int64).reshape(-1, 2)])
        self.parts = []
        size = self.lens[self.known].sum(1)
        sizes = np.array([size[c].sum() for c in codes], np.int64)
        return self.flat[spread(self.known[np.concatenate(codes)].ravel(), self.offs, self.lens)], np.concatenate([[0], np.cumsum(sizes)])


#: What a tokenizer must have for texts to be encoded word by word. Fixed values.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
}


class WholeIds:
    """Ids of whole texts, by any tokenizer."""

    def __init__(self, path: str) -> None:
        self.path = path

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        own = [e.ids for e in _tokenizer(self.path).encode_batch(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        return np.fromiter(chain.from_iterable(own), np.uint32, int(sizes.sum())), np.concatenate([[0], np.cumsum(sizes)])


def encoder(path: str) -> ChunkIds | WholeIds:
    """Word by word if the tokenizer is of the kind that allows it."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == PRE_TOKENIZER and spec["post_processor"] is None
    alone = all(not (t["lstrip"] or t["rstrip"] or t["normalized"]) and " " not in t["content"] and not t["content"].isalpha() for t in spec["added_tokens"])
    return ChunkIds(path) if plain and alone and spec["model"]["type"] == "BPE" else WholeIds(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): each document's ids then ``end_id``, cut at ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = encoder(path)
        for b in slices(batches, "text", 4 << 20):
            ids, offs = cache.ids(strings(b.column(1)))
            out: tuple[list, ...] = ([], [], [], [], [])
            for d, s, e in zip(b.column(0).to_pylist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                own = np.append(ids[s:e], np.uint32(end_id)).astype("<u4")
                for k in range(0, len(own), capacity):
                    x = own[k : k + capacity]
                    for c, v in zip(out, (d, k // capacity, k, len(x), zlib.crc32(x.tobytes())), strict=True):
                        c.append(v)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return ids_and_text(docs).mapInArrow(run, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item, and the bins' free space. Ties keep the given order."""
    bins, offs = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    free: list[int] = []
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit f: a bin with f free tokens is open
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        fits = some >> n
        if fits:
            f = n + (fits & -fits).bit_length() - 1
            b = open_[f].pop()
            if not open_[f]:
                some ^= 1 << f
        else:
            b, f = len(free), capacity
            free.append(capacity)
        bins[i], offs[i], free[b] = b, capacity - f, f - n
        if f > n:
            open_[f - n].append(b)
            some |= 1 << (f - n)
    return bins, offs, np.array(free, np.int64)


NODE = f"node long, bin long, {PIECES}, offset long, final boolean"


def _pack_node(capacity: int, slack: int, first: bool, last: bool):
    def run(group: pa.Table) -> pa.Table:
        cols = {n: group.column(n).to_numpy() for n in ("bin", "length", "offset")}
        # each piece is a bin of its own at first
        own = np.arange(group.num_rows) if first else np.unique(cols["bin"], return_inverse=True)[1]
        sizes = np.bincount(own, weights=cols["length"]).astype(np.int64)
        to, base, free = best_fit(sizes, capacity)
        final = free <= slack if not last else np.ones(len(free), bool)
        out = group.set_column(group.schema.get_field_index("bin"), "bin", pa.array(to[own]))
        out = out.set_column(out.schema.get_field_index("offset"), "offset", pa.array(base[own] + cols["offset"]))
        return out.set_column(out.schema.get_field_index("final"), "final", pa.array(final[to[own]]))

    return run


def pack(items: DataFrame, where: str, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, slack: int = SLACK) -> DataFrame:
    """Packs pieces (a table written once) and adds sequence_id and offset. ``where``: a shared folder for the rounds,
    which the result reads."""
    bins, round_, done = items.count(), 0, None
    nodes = max(1, -(-bins // group_items))
    none = F.lit(0).cast("long")
    deal = lambda key: F.pmod(F.xxhash64(*key), F.lit(nodes))
    # by place, not by id: many rows may share one
    left = items.select(deal([F.monotonically_increasing_id()]).alias("node"), none.alias("bin"), *items.columns, none.alias("offset"), F.lit(False).alias("final"))
    while True:
        packed = stash(left.groupBy("node").applyInArrow(_pack_node(capacity, slack, not round_, nodes == 1), NODE), f"{where}/round{round_}")
        still = packed.where(~F.col("final"))
        pieces_left, bins_left = still.agg(F.count("*"), F.count_if(F.col("offset") == 0)).first()
        stuck = round_ > 0 and bins_left > (1 - PROGRESS) * bins
        ready = (packed if stuck or not bins_left else packed.where("final")).select(*items.columns, (F.lit(round_ << 58).cast("long") + F.shiftleft("node", 24) + F.col("bin")).alias("sequence_id"), "offset")
        done = ready if done is None else done.unionByName(ready)
        if stuck or not bins_left:
            return done
        bins, round_ = bins_left, round_ + 1
        nodes = max(1, -(-bins // group_items), -(-pieces_left // (GROUP_PIECES * group_items)))
        key = F.shiftleft("node", 24) + F.col("bin")
        left = still.withColumn("bin", key).withColumn("node", deal([F.col("bin"), F.lit(round_)]))


def best_fit_packing(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, **options: int) -> DataFrame:
    """Documents to (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    spark = docs.sparkSession
    where = shared_dir(spark)
    items = stash(pieces(docs, tokenizer or tokenizer_path(TOKENIZER), capacity, end_id), f"{where}/pieces")
    out = pack(items, where, capacity, **options)
    remove(spark, f"{where}/pieces")
    return out
