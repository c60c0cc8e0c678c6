"""Text operators against plain versions of what they compute."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import SCHEMA, WORD, clashing, documents, sentence, texts

from ruleweft.llm import bpe, licenses, minhash, packing, quality, sharding, suffix_dedup, toxicity
from ruleweft.llm.bytesops import lines


def rows(df, *cols) -> dict:
    return {r[0]: tuple(r)[1:] for r in df.select(*cols).collect()}


@pytest.fixture(scope="module")
def values():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, values):
    return documents(spark, values).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# byte pair encoding


def test_bpe(docs, values, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.tokenizer_path(bpe.TOKENIZER))
    got = rows(bpe.bpe_round_trip(clashing(docs)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for i, x in enumerate(values):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False).encode())), repr(x)[:80]
    assert bpe.bpe_round_trip(empty).count() == 0
    back = rows(bpe.decode(bpe.encode(docs)), "doc_id", "text")
    assert all(back[i][0] == (x or "") for i, x in enumerate(values))


def test_bpe_random():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path(bpe.TOKENIZER)
    t, e = Tokenizer.from_file(path), bpe.Encoder(bpe.load(path))
    word_path = packing.tokenizer_path(packing.TOKENIZER)
    w, c = Tokenizer.from_file(word_path), packing.ChunkIds(word_path)

    @given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
    @settings(max_examples=200, deadline=None)
    def check(xs):
        for own, theirs in ((e.encode, t), (c.ids, w)):
            ids, offs = own(xs)
            assert [ids[a:b].tolist() for a, b in zip(offs, offs[1:], strict=False)] == [theirs.encode(x, add_special_tokens=False).ids for x in xs]

    check()


def test_bpe_long_words():
    """Words of many letters, alike or not, against the library, in time that follows their length."""
    import time

    from tokenizers import Tokenizer

    path, rnd = bpe.tokenizer_path(bpe.TOKENIZER), random.Random(5)
    t, e = Tokenizer.from_file(path), bpe.Encoder(bpe.load(path))
    letters = lambda n, of: "".join(rnd.choices(of, k=n))
    words = [letters(n, of) for n in (1023, 1024, 3000, 20_000) for of in ("abcdefghijklmnopqrstuvwxyz", "ACGT", "ab", "éüß日本", "x")] + ["the" * 5000, "x" * 4097]
    for w in words:
        got = e.encode(["a short word " + w, w])[0].tolist()
        assert got == t.encode("a short word " + w, add_special_tokens=False).ids + t.encode(w, add_special_tokens=False).ids
    long = letters(1_000_000, "abcdefghijklmnopqrstuvwxyz")
    start = time.time()
    assert len(bpe.load(path).merge_long(long.encode())) == len(t.encode(long, add_special_tokens=False).ids)
    assert time.time() - start < 30  # some 5 s on an idle machine


# packing


def test_packing(docs, values, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path(packing.TOKENIZER))
    for options in ({}, {"group_items": 10}):
        got = packing.best_fit_packing(clashing(docs), **options).collect()
        want = {}
        for i, x in enumerate(values):
            ids = t.encode(x or "", add_special_tokens=False).ids + [1]
            for k in range(0, len(ids), packing.CAPACITY):
                p = ids[k : k + packing.CAPACITY]
                want[i, k // packing.CAPACITY] = (k, len(p), zlib.crc32(np.array(p, "<u4").tobytes()))
        assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
        by = defaultdict(list)
        for r in got:
            by[r["sequence_id"]].append((r["offset"], r["length"]))
        for own in by.values():
            end = 0
            for o, n in sorted(own):
                assert o == end
                end = o + n
            assert end <= packing.CAPACITY
        assert len(by) <= 1.1 * sum(n for _, n, _ in want.values()) / packing.CAPACITY + 1
    assert packing.best_fit_packing(empty).count() == 0
    null = docs.sparkSession.createDataFrame([(None, "a text without an id", "en", "s", 1)] * 40 + [(7, "one two", "en", "s", 1)] * 2, SCHEMA)
    got = packing.best_fit_packing(null, group_items=10).collect()
    assert len(got) == 42 and len({(r["sequence_id"], r["offset"]) for r in got}) == 42 and len({r["sequence_id"] for r in got}) == 1
    other = packing.tokenizer_path(bpe.TOKENIZER)  # of another kind: encoded as whole texts
    t = Tokenizer.from_file(other)
    got = {r["doc_id"]: r["length"] for r in packing.best_fit_packing(docs.where("doc_id < 20"), other).collect()}
    assert isinstance(packing.encoder(other), packing.WholeIds) and got == {i: len(t.encode(values[i] or "", add_special_tokens=False).ids) + 1 for i in range(20)}


def test_residual_rounds(spark, tmp_path):
    """Pieces that fill bins in pairs or not at all, in many small groups: almost as few bins as one group needs."""
    rnd = random.Random(3)
    sizes = [rnd.randint(2300, 2700) for _ in range(1500)] + [rnd.randint(1300, 1795) for _ in range(1500)]
    df = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(sizes)], packing.PIECES)
    df.write.parquet(str(tmp_path / "items"))
    got = packing.pack(spark.read.parquet(str(tmp_path / "items")), str(tmp_path / "rounds"), group_items=200)
    assert got.count() == 3000 and got.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= packing.CAPACITY
    whole = len(packing.best_fit(np.array(sizes), packing.CAPACITY)[2])
    assert got.select("sequence_id").distinct().count() <= 1.03 * whole  # groups of 200 fit a little worse
    alone = packing.pack(df.withColumn("length", F.lit(2500).cast("long")), str(tmp_path / "alone"), group_items=200)
    assert alone.select("sequence_id").distinct().count() == 3000


def test_best_fit():
    bins, offs, free = packing.best_fit(np.array([6, 5, 5, 3, 1]), 10)
    assert len(free) == 2 and free.sum() == 0 and offs.tolist() == [0, 0, 5, 6, 9] and np.bincount(bins, weights=[6, 5, 5, 3, 1]).tolist() == [10.0, 10.0]


# quality


def plain_quality(x: str | None) -> tuple:
    x = x or ""
    w, seen, dup = re.findall(WORD, x), set(), 0
    for line in x.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    k, covered = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), set()
    for i in range(len(w) - 7):
        if k[tuple(w[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_quality_counts(docs, values, empty, spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    crf = quality.train(docs, labels)
    got = rows(quality.quality(clashing(docs), crf), "doc_id", *quality.NUMBERS, "base_failed", "kept")
    for i, x in enumerate(values):
        assert got[i][:6] == plain_quality(x), repr(x)[:60]
        assert got[i][6] == (not got[i][5])  # without labels every line is content
    assert quality.quality(empty, crf).count() == 0
    kept = quality.only_good(clashing(docs), crf)
    assert kept.columns == clashing(docs).columns and {r["doc_id"] for r in kept.collect()} == {i for i in got if got[i][6]}


def test_quality_learns(spark):
    rnd = random.Random(1)
    good = ["\n".join(sentence(rnd, 12).capitalize() + "." for _ in range(4)) for _ in range(150)]
    bad = ["\n".join(" ".join(w + rnd.choice(["###", "$$$", " |", "!!"]) for w in sentence(rnd, 12).upper().split()) for _ in range(4)) for _ in range(150)]
    d = documents(spark, [x for p in zip(good, bad, strict=True) for x in p])
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(200)], "doc_id bigint, quality int, toxic int")
    crf = quality.train(d, labels)
    got = rows(quality.quality(d, crf), "doc_id", "kept")
    assert sum(got[i][0] == (i % 2 == 0) for i in range(200, 300)) >= 98


def test_quality_mixed_texts(spark):
    """Texts glued from a clean and a junk one get both labels, each in its place; null ids are rows like others."""
    rnd = random.Random(3)
    good = ["\n".join(sentence(rnd, 12).capitalize() + "." for _ in range(rnd.randint(2, 60))) for _ in range(160)]
    bad = ["\n".join(" ".join(w + rnd.choice(["###", "$$$", " |", "!!"]) for w in sentence(rnd, 12).upper().split()) for _ in range(rnd.randint(2, 6))) for _ in range(60)]
    labels = spark.createDataFrame([(i, int(i < 160), 0) for i in range(220)], "doc_id bigint, quality int, toxic int")
    crf = quality.train(documents(spark, good + bad), labels)
    right = 0
    for i in range(60):
        parts = [good[i], bad[i]][:: 1 if i % 2 else -1]
        data = np.frombuffer("\n".join(parts).encode(), np.uint8)
        _, f, _, lat = quality.measure(data, np.array([0, len(data)]))
        k = parts[0].count("\n") + 1
        v = crf.viterbi(f, lat)
        right += (v[:k] == i % 2).mean() >= 0.5 and (v[k:] != i % 2).mean() >= 0.5
    assert right >= 54
    null = spark.createDataFrame([(None, good[0], "en", "s", 1), (None, bad[0], "en", "s", 1), (1, good[0], "en", "s", 1), (1, good[0], "en", "s", 1)], SCHEMA)
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in quality.quality(null, crf).collect()) == [(0, False), (0, True), (1, True), (1, True)]


def test_viterbi():
    rnd = np.random.default_rng(2)
    crf = quality.Crf(rnd.normal(size=(quality.N_FEATURES, 2)), rnd.normal(size=(2, 2)))
    lat = np.array([0, 3, 3, 8, 9])
    f = rnd.normal(size=(9, quality.N_FEATURES))
    got = crf.viterbi(f, lat)
    for a, b in zip(lat, lat[1:], strict=False):
        best = max((np.array(list(np.binary_repr(m, b - a))).astype(int) for m in range(2 ** (b - a))), key=lambda y, a=a: sum(f[a + i] @ crf.emit[:, s] for i, s in enumerate(y)) + sum(crf.move[p, q] for p, q in zip(y, y[1:], strict=False))) if b > a else []
        assert got[a:b].tolist() == list(best)


def test_lines():
    data = np.frombuffer("a\n\nb".encode() + b"" + b"c\n", np.uint8)
    s, e, at = lines(data, np.array([0, 4, 4, 6]))
    assert [bytes(data[x:y]).decode() for x, y in zip(s, e, strict=True)] == ["a", "", "b", "", "c", ""] and at.tolist() == [0, 3, 4, 6]


# suffix dedup


def plain_repeats(values: list[str | None], length: int = 100) -> list[tuple]:
    seen, out = set(), []
    for x in values:
        b = (x or "").encode()
        cover = np.zeros(len(b) + 1, np.int64)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                cover[p] += 1
                cover[p + length] -= 1
            else:
                seen.add(w)
        c = np.cumsum(cover[:-1]) > 0
        out.append((len(b), int(c.sum()), int((c & ~np.r_[False, c[:-1]]).sum()) if len(c) else 0, hashlib.sha256(np.frombuffer(b, np.uint8)[~c].tobytes()).hexdigest()))
    return out


def suffix_cases(values: list) -> list:
    rnd = random.Random(8)
    values = [v for v in values if v is None or len(v) < 100_000]
    passage = sentence(rnd, 40)
    values += ["x" * 3000] + ["unlike start %d " % i + values[-5][:150] for i in range(12)]
    # letters that many different surroundings share, and pieces of a passage of many lengths
    values += [sentence(rnd, 8) + " these letters are shared by very many texts here " + sentence(rnd, 8) for _ in range(60)]
    values += [sentence(rnd, 3) + passage[rnd.randrange(60) : rnd.randrange(120, len(passage))] + sentence(rnd, 3) for _ in range(40)]
    return values


@pytest.mark.parametrize("small", [False, True])
def test_suffix_dedup(spark, values, empty, small, monkeypatch):
    if small:  # segments, slices and crowded letters all come into play
        for name, v in (("SEGMENT", 4096), ("SLICE", 8192), ("SLICE_SPANS", 2), ("ANCHOR_SPANS", 3)):
            monkeypatch.setattr(suffix_dedup, name, v)
    values = suffix_cases(values)
    d = documents(spark, values)
    want = plain_repeats(values)
    for batch in (suffix_dedup.BATCH_BYTES, 20_000):
        got = rows(suffix_dedup.suffix_dedup(clashing(d), batch), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert [got[i] for i in range(len(values))] == want
    if not small:
        cut = suffix_dedup.without_repeats(clashing(d))
        assert cut.columns == clashing(d).columns and cut.count() == len(values)
        assert all((r["text"] is None) == (values[r["doc_id"]] is None) for r in cut.collect())
        assert suffix_dedup.suffix_dedup(empty).count() == 0
        null = spark.createDataFrame([(None, "z" * 300, "en", "s", 300), (1, "z" * 99, "en", "s", 99), (2, "b" * 150, "en", "s", 1), (2, "ab" * 50 + "c", "en", "s", 1), (2, None, "en", "s", 1)], SCHEMA)
        assert {r["n_removed"] for r in suffix_dedup.suffix_dedup(null.where("text IS NOT NULL OR doc_id IS NULL")).collect()} == {0}
        assert suffix_dedup.without_repeats(clashing(null)).count() == 3


def test_suffix_hash_collisions(spark, values, monkeypatch):
    """With hashes of eight values everything that removes text is still confirmed by its bytes."""
    plain = suffix_dedup.Hasher.spans
    values = suffix_cases(values)[:60] + ["y" * 700]
    want = plain_repeats(values)
    rnd = np.random.default_rng(1)
    for _ in range(20):
        data = rnd.integers(97, 99, 3000).astype(np.uint8)
        data[1500:1700] = data[200:400]
        p = rnd.permutation(np.arange(2900))
        seen, late = {}, set()
        for x in range(2900):
            late.add(x) if data[x : x + 100].tobytes() in seen else seen.setdefault(data[x : x + 100].tobytes(), x)
        got = suffix_dedup.late_windows(data, p, np.zeros(2900, np.int64), p, plain(suffix_dedup.Hasher(data), p, p + 100) % np.uint64(8))
        assert set(p[got].tolist()) == late
    texts = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id bigint, text string").where("text IS NOT NULL").toPandas()
    # the functions that tasks run, in this process, where the hash can be changed
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup.Hasher, "spans", lambda self, a, b: plain(self, a, b) % np.uint64(8) << np.uint64(40))
    batch = pa.RecordBatch.from_pandas(texts, preserve_index=False)
    out = pa.Table.from_batches(suffix_dedup._index(3)(iter([batch]))).to_pylist()
    notes = defaultdict(list)
    for k in range(3):
        own = [r for r in out if r["bucket"] == k]
        table = pa.table({**{c: pa.array([r[c] for r in own], t) for c, t in suffix_dedup._TYPES}, "level": pa.array([0] * len(own), pa.int32()), "stays": pa.array([False] * len(own))})
        out += [r for r in suffix_dedup._merge_scan(table).to_pylist() if r["docs"] is not None] if own else []
    for r in out:
        for i, a, b in zip(r["docs"] or [], r["a"] or [], r["b"] or [], strict=True):
            notes[i].append({"a": a, "b": b})
    told = batch.filter(pa.array([i in notes for i in texts["doc_id"]]))
    told = told.append_column("notes", pa.array([notes[i] for i in told.column(0).to_pylist()], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))))
    out = pa.Table.from_batches(suffix_dedup._surroundings(3)(iter([told])))
    every = out.to_pylist()
    for k in range(3):
        own = out.filter(pa.compute.equal(out.column("bucket"), k))
        every += suffix_dedup._compare(own).to_pylist() if own.num_rows else []
    runs = defaultdict(list)
    for r in every:
        for i, a, b in zip(r["docs"] or [], r["a"] or [], r["b"] or [], strict=True):
            runs[i].append((a, b))
    for i, x in enumerate(values):
        pair = np.array(runs[i], np.int64).reshape(-1, 2)
        s, e = suffix_dedup.covered(len((x or "").encode()), pair[:, 0], pair[:, 1])
        assert (int((e - s).sum()), len(s)) == want[i][1:3]


def test_suffix_family(spark, values, tmp_path):
    """Ten batches in a kept family, opened anew for the last ones; levels are those of a binary counter."""
    values = [v or "" for v in suffix_cases(values)]
    d = documents(spark, values).select("doc_id", "text")
    step = -(-len(values) // 10)
    for k in range(10):
        family = suffix_dedup.Family(spark, str(tmp_path / "family"), 5) if k in (0, 7) else family  # noqa: F821
        family.add(d.where(f"doc_id >= {k * step} AND doc_id < {(k + 1) * step}"))
    assert [n for n, _ in family.state["levels"]] == [8, 2] and family.state["n"] == 10
    with pytest.raises(ValueError, match="above"):
        family.add(d.limit(3))
    family.add(documents(spark, ["a last one"], 10_000).select("doc_id", "text"), last=True)
    with pytest.raises(ValueError, match="last"):
        family.add(documents(spark, ["one more"], 10_001).select("doc_id", "text"))
    got = rows(family.repeats(d, str(tmp_path / "found")), "doc_id", "notes")
    want = plain_repeats(values)
    for i, x in enumerate(values):
        pair = np.array([(n["a"], n["b"]) for n in got[i][0]] if i in got else [], np.int64).reshape(-1, 2)
        s, e = suffix_dedup.covered(len(x.encode()), pair[:, 0], pair[:, 1])
        assert (int((e - s).sum()), len(s)) == want[i][1:3]


# minhash


def plain_components(values: list[str | None]) -> list[tuple[int, int]]:
    sets = []
    for x in values:
        w = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in x or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def test_minhash(spark, values, empty, monkeypatch):
    rnd = random.Random(9)
    base = sentence(rnd, 200).split(" ")
    chain = []
    for _ in range(25):  # a chain: neighbours are alike, the ends aren't
        for _ in range(2):
            base[rnd.randrange(len(base))] = sentence(rnd, 1)
        chain.append(" ".join(base))
    values = [v for v in values if v is None or len(v) < 30_000 or " " in v] + chain + chain[:3]
    # copies of one text that are like it, but hardly like each other; and texts just below the threshold
    star = sentence(rnd, 300).split(" ")
    for _ in range(60):
        w = list(star)
        for _ in range(rnd.choice([3, 4, 6, 9])):
            w[rnd.randrange(len(w))] = "changed"
        values.append(" ".join(w))
    want = plain_components(values)
    monkeypatch.setattr(minhash, "BUCKET_ROWS", 8)
    monkeypatch.setattr(minhash, "PIVOT_ROWS", 4)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    got = rows(minhash.minhash_near_dedup(clashing(documents(spark, values))), "doc_id", "n_shingles", "component_id", "kept")
    assert [got[i] for i in range(len(values))] == [(n, c, c == i) for i, (n, c) in enumerate(want)]
    assert minhash.minhash_near_dedup(empty).count() == 0
    d = documents(spark, values)
    assert {r["doc_id"] for r in minhash.one_of_each(clashing(d)).collect()} == {c for _, c in want}
    null = spark.createDataFrame([(None, chain[0], "en", "s", 1), (4, chain[0], "en", "s", 1), (4, chain[0], "en", "s", 1)], SCHEMA)
    assert sorted((r["component_id"] or -1, r["kept"]) for r in minhash.minhash_near_dedup(null).collect()) == [(-1, False), (4, True), (4, True)]


# toxicity


def test_segments():
    rnd = random.Random(4)

    def plain(x):  # all maximal segments, by definition: split at the best one, recursively
        best = max(((sum(x[i:j]), -(j - i), -i, i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=(0,))
        if best[0] <= 1e-12:
            return []
        i, j = best[3], best[4]
        return plain(x[:i]) + [sum(x[i:j])] + plain(x[j:])

    for _ in range(200):
        x = [rnd.choice([-0.5, -0.5, -0.5, 1.0, 2.25, 0.75]) for _ in range(rnd.randint(1, 14))]
        scores, gaps, g = [], [], 0
        for v in x:
            if v > 0:
                scores.append(v)
                gaps.append(g)
                g = 0
            else:
                g += 1
        got = [s for s, _, _ in toxicity.segments(scores, gaps, 0.5)]
        assert sorted(got) == pytest.approx(sorted(plain(x)))


def test_toxicity(spark, empty):
    rnd = random.Random(6)
    bad = ["vile", "wretch", "gromlike", "gromness", "gromless"]
    make = lambda t: " ".join([*(w := sentence(rnd, 60).split())[:30], *([rnd.choice(bad)] if t else []), *w[30:], *([rnd.choice(bad)] if t else [])])
    values = [make(i % 4 == 0) for i in range(600)] + [None, "", "vile", "vile " * 30_000]
    d = documents(spark, values)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)] + [(3, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = rows(toxicity.toxicity(clashing(d), labels), "doc_id", "held_out", "score", "predicted")
    assert all(got[i][0] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got) and all(0 <= v[1] <= 1 for v in got.values())
    own = [i for i in range(600) if got[i][0]]
    assert sum(got[i][2] == int(i % 4 == 0) for i in own) >= 0.98 * len(own)
    assert got[600] == (got[600][0], got[601][1], 0) and got[603][2] == 1
    null = toxicity.toxicity(documents(spark, ["x"]).selectExpr("cast(null as bigint) AS doc_id", "'vile vile wretch' AS text").unionByName(d.select("doc_id", "text")), labels)
    assert [(r["held_out"], r["predicted"]) for r in null.where("doc_id IS NULL").collect()] == [(False, 1)]
    kept = toxicity.without_toxic(clashing(d), labels)
    assert kept.columns == clashing(d).columns and {r["doc_id"] for r in kept.collect()} == {i for i in got if got[i][2] == 0}
    assert toxicity.toxicity(empty, labels).count() == 0
    assert {r["predicted"] for r in toxicity.toxicity(d, labels.limit(0)).collect()} == {0}


# shards and licences


def plain_shards(sizes: dict, arrival: int, target: int, fan_in: int) -> dict:
    """(shard, documents, bytes, version) by id, of ids with their bytes."""
    of, at, total = {}, 0, Counter()
    k = {}
    for i in sorted(sizes):
        k[i] = at // arrival
        at += sizes[i]
    place = {x: n for n, x in enumerate(sorted(set(k.values())))}
    for i in sizes:
        of[i] = place[k[i]]
        total[of[i]] += sizes[i]
    tiers = defaultdict(list)
    for s in sorted(total):
        if total[s] < target:
            tiers[(len(f"{total[s]:b}") - 1) // 2].append(s)
    groups, to = [], {}
    for t in sorted(tiers):
        if len(tiers[t]) >= fan_in:
            before, runs = 0, {}
            for s in tiers[t]:
                runs.setdefault(before // target, []).append(s)
                before += total[s]
            groups += [runs[r] for r in sorted(runs) if len(runs[r]) > 1]
    for n, g in enumerate(groups):
        to |= {s: max(total) + 1 + n for s in g}
    final = {i: to.get(s, s) for i, s in of.items()}
    docs_in, bytes_in = Counter(final.values()), Counter()
    for i, s in final.items():
        bytes_in[s] += sizes[i]
    return {i: (s, docs_in[s], bytes_in[s], 2 if groups else 1) for i, s in final.items()}


def test_sharding(spark, docs, values, empty):
    cols = ("doc_id", "shard", "shard_docs", "shard_bytes", "version")
    size = {i: len((v or "").encode()) for i, v in enumerate(values)}
    got = rows(sharding.size_tiered_shards(clashing(docs), 10_000, 60_000, 2), *cols)
    assert got == plain_shards(size, 10_000, 60_000, 2) and {v[3] for v in got.values()} == {2}
    assert sharding.size_tiered_shards(empty).count() == 0
    # ids far apart are cut by bytes all the same
    sparse = spark.createDataFrame([(i if i < 100 else 10**15, "x" * 500, "en", "s", 500) for i in range(101)], SCHEMA)
    got = rows(sharding.size_tiered_shards(sparse, 5_000, 4_000), *cols)
    assert got == plain_shards({i if i < 100 else 10**15: 500 for i in range(101)}, 5_000, 4_000, 2) and max(v[1] for v in got.values()) == 10
    null = spark.createDataFrame([(None, "y" * 900, "en", "s", 900)] * 3 + [(4, "z" * 1000, "en", "s", 1000), (4, "z" * 1000, "en", "s", 1000), (5, None, "en", "s", 0), (6, "w" * 50_000, "en", "s", 50_000)], SCHEMA)
    got = sharding.size_tiered_shards(null, 1_000, 1_000).collect()
    assert len(got) == 7 and sorted((r["doc_id"] or 0, r["shard_docs"]) for r in got) == [(0, 3)] * 3 + [(4, 2)] * 2 + [(5, 2), (6, 2)]


def test_manifest(spark, docs, tmp_path):
    data = sharding.Dataset(spark, str(tmp_path))
    assert data.version() == 0 and data.manifest().isEmpty() and data.read(docs.schema).count() == 0
    assert sharding.append(data, docs.where("doc_id < 30"), 2_000) == 1 and sharding.append(data, docs.where("doc_id >= 30"), 2_000) == 2
    assert data.read(docs.schema).count() == docs.count() and data.read(docs.schema, 1).count() == 30
    with pytest.raises(FileExistsError):
        data.commit(data.manifest(), 1)  # another writer was first
    before = data.manifest().count()
    assert sharding.compact(data, docs.schema, 50_000) == 3 and data.manifest().count() < before
    key = lambda df: sorted((r["doc_id"], r["text"] or "") for r in df.collect())
    assert key(data.read(docs.schema)) == key(docs) and data.read(docs.schema, 2).count() == docs.count()
    data.vacuum()
    assert data.version() == 3 and key(data.read(docs.schema)) == key(docs)


def test_torn_commits(spark, docs, tmp_path, monkeypatch):
    """A writer that dies at any step leaves the version before it; the next writer loses nothing."""
    data = sharding.Dataset(spark, str(tmp_path))
    assert sharding.append(data, docs.where("doc_id < 20")) == 1

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(sharding.Dataset, "_move", die)
        with pytest.raises(KeyboardInterrupt):
            sharding.append(data, docs.where("doc_id >= 20"))
    assert data.version() == 1 and data.read(docs.schema).count() == 20
    (tmp_path / "versions" / "v00000002").write_text("")  # an empty marker of another tool
    (tmp_path / "versions" / "v00000003").write_text("0" * 32)  # one whose manifest isn't there
    assert data.version() == 1 and data.read(docs.schema).count() == 20
    assert sharding.append(data, docs.where("doc_id >= 20")) == 4 and data.read(docs.schema).count() == docs.count()
    # two writers that read the same version: the place is taken for the second one
    draft = tmp_path / "versions" / ".draft-x"
    draft.write_text("1" * 32)
    path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(str(p))
    with pytest.raises(Exception, match="(?i)exist"):
        data._move(path(draft), path(tmp_path / "versions" / "v00000004"))
    data.vacuum()
    assert not [n for n in data._names("versions") if n.startswith(".draft")] and data.read(docs.schema).count() == docs.count()


HEADERS = {
    "GPL-3.0": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.",
    "Apache-2.0": "/*\n * Copyright 2020 Some Body\n *\n * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at\n *\n *     http://www.apache.org/licenses/LICENSE-2.0\n *\n */",
    "MPL-2.0": "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def wrapped(text: str, width: int = 72) -> str:
    import textwrap

    return textwrap.fill(text, width)


def test_licenses(spark, empty):
    from ruleweft.llm import license_templates as T

    mit = "MIT License\n\nCopyright (c) 2021 Jo Doe\n\n" + wrapped(T._MIT) + "\n\n" + wrapped(T._WARRANTY) + "\n"
    bsd = "Copyright (c) 2019, The Authors\nAll rights reserved.\n\n" + wrapped(T._BSD_OPENING) + "\n\n1. " + wrapped(T._BSD_TWO) + "\n\n3. " + wrapped(T._BSD_THREE) + "\n\n" + wrapped(T._BSD_WARRANTY)
    files = [
        (1, "a/LICENSE", mit), (2, "a/b/x.txt", "words and words"), (3, "a/b/c/LICENSE", bsd), (4, "a/b/c/d/y.txt", "more words"), (5, "z/w.txt", "a plain text\nThis work is licensed under the GNU General Public License, version 3.\n" + "word " * 50),
        (6, "z/v.txt", None), (7, "z/u.txt", ""), (8, "top.txt", "nothing here but the licensed bar"), (9, None, "a file without a path"), (10, "q/one", "Released under the MIT License."), (11, "q/one", "second text"), (11, "q/two", "second text"),
        (None, "a/n.txt", "no id"), (12, "v/long.txt", "blah blah\n" * 50_000 + "Released under the ISC License.\n" + "\n" * 50_000), (13, "t/t", "Licensed under the MIT License.\nReleased under the MIT License."),
        (14, "p/COPYING", "GNU GENERAL PUBLIC LICENSE\n  Version 2, June 1991\n\n Preamble\n\n" + "The licenses for most software are designed to take away your freedom to share and change it. " * 40), (15, "p/src/deep/main.c", "int main"),
    ]
    files += [(20 + i, f"h/{k}.c", h + "\n\nint main(void) { return 0; }\n" * 30) for i, (k, h) in enumerate(HEADERS.items())]
    got = defaultdict(set)
    for r in licenses.license_scan(clashing(spark.createDataFrame(files, "doc_id bigint, path string, text string"))).collect():
        got[r["doc_id"]].add((r["license"], r["origin"], r["from_doc_id"]))
    none = ("none", "none", None)
    want = {1: ("MIT", "own", 1), 2: ("MIT", "inherited", 1), 3: ("BSD-3-Clause", "own", 3), 4: ("BSD-3-Clause", "inherited", 3), 5: ("GPL-3.0", "own", 5), 6: none, 7: none, 8: none, 9: none, 10: ("MIT", "own", 10), 11: ("MIT", "inherited", 10), None: ("MIT", "inherited", 1), 12: ("ISC", "own", 12), 13: ("MIT", "own", 13), 14: ("GPL-2.0", "own", 14), 15: ("GPL-2.0", "inherited", 14)}
    want |= {20 + i: (k, "own", 20 + i) for i, k in enumerate(HEADERS)}
    assert got == {k: {v} for k, v in want.items()}
    assert licenses.license_scan(licenses.with_paths(empty)).count() == 0


def test_license_prefilter(spark):
    """Brute force over all files, without the filter on needed words, finds the same ones and no more."""
    rnd, forms = random.Random(4), licenses.templates()
    counts = [Counter(re.findall(licenses.WORD, v.lower())) for _, _, v, _ in forms]
    df = Counter(w for c in counts for w in c)
    pool, plain, files = sorted(df), sorted(set(df) - set(licenses.needed()[0])), []
    for i in range(400):
        w = list(counts[i % len(counts)].elements()) if i % 2 else []
        rnd.shuffle(w)
        files.append((i, " ".join(w[: rnd.randint(1, 200)] + [rnd.choice(pool if i % 3 else plain) for _ in range(rnd.randint(0, 20))]) or "x"))
    idf = lambda w: np.log((1 + len(forms)) / (1 + df[w])) + 1
    tf = lambda k: 1 + np.log(k)
    unit = lambda c: {w: tf(k) * idf(w) / np.sqrt(sum((tf(j) * idf(x)) ** 2 for x, j in c.items())) for w, k in c.items()}
    vectors = [unit(c) for c in counts]
    best = {i: max(sum(v * u.get(w, 0) for w, v in unit(Counter(re.findall(licenses.WORD, t.lower()))).items()) for u in vectors) for i, t in files}
    got = rows(licenses.scan(licenses.units(spark.createDataFrame(files, "doc_id bigint, text string"))), "doc_id", "score")
    want = {i: round(v, 6) for i, v in best.items() if round(v, 6) >= licenses.COSINE}
    assert 50 < len(want) < 350 and set(got) == set(want) and all(abs(got[i][0] - want[i]) < 2e-6 for i in want)


@pytest.mark.parametrize("name, want", [("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-3", "LGPL-3.0"), ("Apache-2.0", "Apache-2.0"), ("MPL-2.0", "MPL-2.0"), ("BSD", "BSD-3-Clause"), ("CC0-1.0", "CC0-1.0")])
def test_real_license_files(spark, name, want):
    import os

    path = f"/usr/share/common-licenses/{name}"
    if not os.path.exists(path):
        pytest.skip("no licence texts on this machine")
    files = spark.createDataFrame([(1, "d/LICENSE", open(path, encoding="utf-8", errors="replace").read()), (2, "d/e/f.txt", "a file")], "doc_id bigint, path string, text string")
    assert rows(licenses.license_scan(files), "doc_id", "license", "from_doc_id") == {1: (want, 1), 2: (want, 1)}
