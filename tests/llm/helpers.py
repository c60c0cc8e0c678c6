"""Small tables with the awkward cases: nulls, empty and blank texts, one very long text, ties, repeated rows."""

from __future__ import annotations

import random

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sentence(rnd: random.Random, n: int) -> str:
    return " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 8))) for _ in range(n))


def texts(seed: int = 3, n: int = 60) -> list[str | None]:
    """Prose with exact copies, near copies, shared passages and special cases."""
    rnd = random.Random(seed)
    base = [sentence(rnd, rnd.randint(30, 160)) for _ in range(n // 3)]
    out: list[str | None] = list(base)
    passage = sentence(rnd, 60)
    for i in range(n // 3):
        w = base[i % len(base)].split(" ")
        if i % 3 == 0:
            w[rnd.randrange(len(w))] = "edited"
        out.append(" ".join(w) if i % 3 < 2 else sentence(rnd, 20) + "\n" + passage + "\n" + sentence(rnd, 20))
    out += [None, "", "   \n\t ", "one", "one two three", "ONE TWO THREE", "é" * 300, "a b " * 40, "\n".join(["same line here"] * 30), sentence(rnd, 30_000), "x" * 120_000, "naïve Ünïcode 日本語 text \x85 with odd blanks", "<|endoftext|> special <|startoftext|> tokens", "'s 'LL don't I'M é É ΑΣ İ"]
    return out


def documents(spark, values: list[str | None], first: int = 0):
    return spark.createDataFrame([(first + i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(values)], SCHEMA)


def clashing(docs):
    """The same rows with columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ("id", "a", "b", "key", "bucket", "node", "bin", "offset", "final", "length", "piece", "component_id", "kept", "label", "score", "notes", "_n", "n_words", "_notes", "_shard", "_moved", "shard", "merged", "_kept", "folder", "docs", "bytes", "items", "n_shingles", "set1", "c0", "y", "all")
    return docs.withColumns({n: F.lit(-1) for n in names})
