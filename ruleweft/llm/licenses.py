"""Licences of files: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

A file's lines, its paragraphs (runs of lines between lines without letters, so comment marks don't matter) and its
whole text are compared with templates: whole licence texts, customary notices, and the titles that open long licences.
The file's own licence is that of its whole text, else that of the title it opens with, else that of the paragraph or
line of the highest cosine, where any licence goes before "all rights reserved". A file is a licence file if its whole text is like a
template, if it opens with a licence's title, or if most of its words lie in lines that are like one; it holds for its
directory and all below it, up to the next one. Inheritance is resolved for distinct directories by joining their
ancestor paths. DataFrame operations only.

What no template can be like is left out exactly: cosine ``c`` needs common words that carry ``c``**2 of the template's
squared weight, so a unit without any of a template's ``needed`` words, which carry more than the rest of it, can't
reach it. Texts are read once, and only units with such a word go on.

Null and empty texts have no licence of their own; texts are scanned whole; of equal scores paragraphs come before
lines, then the earlier unit, then the licence first by name; of licence files in one directory the
higher score, then the lower id; null paths count as files of the root; rows that share an id are one file, in as many
places as they have paths; rows without an id have no licence of their own; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweft.llm.common import remove, shared_dir, stash
from ruleweft.llm.license_templates import FULL, NOTICES, TITLES

WORD = "[a-z0-9]+(?:[.+-][a-z0-9]+)*"
#: Cosine from which a unit states a licence.
COSINE = 0.75
#: A line end, then lines without letters or digits.
BREAK = "\\n[^A-Za-z0-9]*\\n"
#: Plain words and numbers, which are needed only where a template has too few others.
PLAIN = frozenset(
    "1 2 3 19 29 a above act action all an and any anyone are as at basis be being benefit business but by c can charge code connection data deal direct do either even event except february file files following for form free from future general goods "
    "held how however if in information interest into is it its january june kind language large later law laws legal library list loss make marked materials may means met more must name names nor not notice november of on one option or origin "
    "original other otherwise our out particular performance person persons please present prior product products program provided public purpose reasonable regard required rights see services shall so source special specific such terms that the theory this to under use used "
    "v version versions was way we whether whom will with without work would writing written wrote you your".split()
)
#: The most common words of prose, German "mit" among them: the last resort.
COMMON = frozenset("a all an and are as at be but by c for from in is it mit no not of on or so that the this to we with you".split())
#: A licence that says least gives way to any other that a file states.
LAST = "Proprietary"
#: In how many parts licence files are dealt again, so that a directory above most others is no hot key.
SALT = 8


def templates() -> list[tuple[str, int, str, bool]]:
    """(license, number, statement, whether it opens a licence's text) of all templates."""
    every = [(k, v, t) for t, table in ((False, NOTICES), (False, FULL), (True, TITLES)) for k, vs in sorted(table.items()) for v in vs]
    return [(k, i, v, t) for i, (k, v, t) in enumerate(every)]


def needed(cosine: float = COSINE) -> tuple[list[str], list[tuple[str, list[str]]]]:
    """Words of which any unit that reaches ``cosine`` with some template holds one: those that weigh most in it.

    Where a template needs a very common word for that, its words make a pair instead: such a unit holds the word that
    weighs most, and one of the others, if it holds none of the list.
    """
    counts = [Counter(re.findall(WORD, v.lower())) for _, _, v, _ in templates()]
    df = Counter(w for c in counts for w in c)
    out: set[str] = set()
    pairs: list[tuple[str, list[str]]] = []
    for c in counts:
        weight = {w: ((1 + math.log(n)) * (math.log((1 + len(counts)) / (1 + df[w])) + 1)) ** 2 for w, n in c.items()}
        goal, have, own = (1 - (cosine - 1e-5) ** 2) * sum(weight.values()), 0.0, set()
        for w in sorted(c, key=lambda w: (w in COMMON, w in PLAIN, -weight[w], w)):
            if have > goal:
                break
            have += weight[w]
            own.add(w)
        if not own & COMMON:
            out |= own
            continue
        top = max(weight, key=weight.get)
        if weight[top] <= goal or sum(weight.values()) - weight[top] <= goal:
            out |= own
        else:
            pairs.append((top, sorted(set(c) - {top})))
    return sorted(out), sorted((a, [w for w in rest if w not in out]) for a, rest in pairs if a not in out)


def pattern(words: list[str]) -> str:
    """A pattern of any of the words in lower-case text, by first letter so that few are tried at each place."""
    by: dict[str, list[str]] = defaultdict(list)
    for w in words:
        by[w[0]].append(re.escape(w[1:]).replace("\\-", "-"))
    return r"\b(?:" + "|".join(f"{a}(?:{'|'.join(sorted(rest, reverse=True))})" for a, rest in sorted(by.items())) + r")\b"


def marked(text: Column, cosine: float = COSINE) -> Column:
    """True where a text may reach the cosine with some template."""
    words, pairs = needed(cosine)
    text = F.lower(text)
    return reduce(or_, (text.rlike(pattern([a])) & text.rlike(pattern(rest)) for a, rest in pairs), text.rlike(pattern(words)))


def _marked_sql(text: str) -> str:
    words, pairs = needed()
    has = lambda ws: f"regexp_matches(lower({text}), '{pattern(ws)}')"
    return "(" + " OR ".join([has(words), *(f"{has([a])} AND {has(rest)}" for a, rest in pairs)]) + ")"


def _templates_sql() -> str:
    return "(VALUES " + ", ".join("('{}', {}, '{}', {})".format(k, i, v.replace("'", "''"), str(t).lower()) for k, i, v, t in templates()) + ") AS t(license, form, statement, title)"


def _forms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(templates(), "license string, form int, statement string, title boolean")


def _vectors(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, word, n, tf): words with their number, and its logarithm plus one, so that no common word rules."""
    words = texts.select(*keys, F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))).alias("word"))
    return words.groupBy(*keys, "word").agg(F.count("*").alias("n")).withColumn("tf", F.log("n") + 1)


def units(files: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(doc_id, kind, at, body, n_all) of the units that hold a needed word: kind 0 is the whole text, 1 a paragraph of
    several, 2 a line of several; n_all: words of the whole text."""
    text = F.col("text")
    some = files.where(F.col("doc_id").isNotNull() & marked(text, cosine))
    part = lambda cut, kind: F.transform(F.split(text, cut), lambda body, at: F.struct(F.lit(kind).alias("kind"), at.alias("at"), body.alias("body")))
    several = lambda xs: F.when(F.size(xs) > 1, xs).otherwise(F.slice(xs, 1, 0))
    whole = F.array(F.struct(F.lit(0).alias("kind"), F.lit(0).alias("at"), text.alias("body")))
    every = F.concat(whole, several(part(BREAK, 1)), several(part("\n", 2)))
    n_all = F.size(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))
    return some.select("doc_id", n_all.alias("n_all"), F.explode(every).alias("u")).select("doc_id", "n_all", "u.*").where(marked(F.col("body"), cosine))


def scan(found: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(doc_id, license, score, holds) of files that state a licence of their own, from their ``units``."""
    table = _forms(found.sparkSession)
    n = len(templates())
    form_words = _vectors(table, ["form"], "statement")
    idf = form_words.groupBy("word").agg((F.log((1.0 + n) / (1.0 + F.count("*"))) + 1.0).alias("idf"))
    rare = math.log(n + 1.0) + 1.0
    weighed = form_words.join(idf, "word")
    norm = weighed.groupBy("form").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2))).alias("norm"))
    # the templates are a fixed, small list
    forms = F.broadcast(weighed.join(norm, "form").join(table.select("form", "license", "title"), "form").select("form", "license", "title", "word", (F.col("tf") * F.col("idf") / F.col("norm")).alias("weight")))
    key = ["doc_id", "kind", "at"]
    words = _vectors(found, key, "body").join(F.broadcast(idf), "word", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(rare)))
    size = words.groupBy(*key).agg(F.sqrt(F.sum(F.pow("w", 2))).alias("size"), F.sum("n").alias("n_words"))
    dot = words.join(forms, "word").groupBy(*key, "form", "license", "title").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dot.join(size, key).withColumn("score", F.round(F.col("dot") / F.col("size"), 6)).where(F.col("score") >= cosine)
    best = scored.groupBy(*key).agg(F.min(F.struct((-F.col("score")).alias("minus"), "license", F.col("title").alias("opens"), "n_words")).alias("x"))
    n_all = found.where("kind = 0").select("doc_id", "n_all").distinct().groupBy("doc_id").agg(F.max("n_all").alias("n_all"))
    # a whole text without a needed word has none in its parts either, so each file with a unit has its whole text there
    like_whole = F.max((F.col("kind") == 0).cast("int"))
    title = (F.col("kind") > 0) & (F.col("at") <= 1) & F.col("x.opens")
    opens = F.max(title.cast("int"))
    rank = F.when(F.col("kind") == 0, 0).when(title, 1).when(F.col("x.license") != LAST, 2).otherwise(3)
    in_lines = F.sum(F.when(F.col("kind") == 2, F.col("x.n_words")).otherwise(0))
    own = best.groupBy("doc_id").agg(F.min(F.struct(rank.alias("rank"), F.col("x.minus").alias("minus"), "kind", "at", F.col("x.license").alias("license"))).alias("y"), like_whole.alias("like_whole"), opens.alias("opens"), in_lines.alias("in_lines"))
    holds = (F.col("like_whole") + F.col("opens") > 0) | (F.col("in_lines") * 2 >= F.col("n_all"))
    return own.join(n_all, "doc_id").select("doc_id", F.col("y.license").alias("license"), (-F.col("y.minus")).alias("score"), holds.alias("holds"))


def license_scan(files: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Files (doc_id, path, text) to (doc_id, path, license, score, origin, from_doc_id).

    origin is own, inherited or none; score is the cosine of the statement that holds.
    """
    where = shared_dir(files.sparkSession)
    found = stash(units(files.select("doc_id", "text"), cosine), f"{where}/units")
    own = stash(scan(found, cosine), f"{where}/own")
    remove(files.sparkSession, f"{where}/units")
    folder = F.regexp_replace(F.coalesce("path", F.lit("")), "/?[^/]*$", "")
    placed = files.select("doc_id", "path", folder.alias("folder"))
    holds = own.where("holds").join(placed.select("doc_id", "folder"), "doc_id")
    holds = holds.groupBy("folder").agg(F.min(F.struct((-F.col("score")).alias("minus"), "doc_id", "license")).alias("x")).select("folder", F.col("x.license").alias("l"), (-F.col("x.minus")).alias("s"), F.col("x.doc_id").alias("d"))
    folders = placed.select("folder").distinct()
    parts = F.split("folder", "/")
    depth = F.explode(F.sequence(F.lit(0), F.when(F.col("folder") == "", F.lit(0)).otherwise(F.size(parts)))).alias("depth")
    above = folders.select("folder", depth).withColumn("ancestor", F.concat_ws("/", F.slice(parts, F.lit(1), F.col("depth")))).withColumn("salt", F.pmod(F.xxhash64("folder"), F.lit(SALT)).cast("int"))
    dealt = holds.withColumnRenamed("folder", "ancestor").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    near = above.join(dealt, ["ancestor", "salt"]).groupBy("folder").agg(F.max_by(F.struct("l", "s", "d"), "depth").alias("up"))
    out = placed.join(own, "doc_id", "left").join(near, "folder", "left")
    mine = F.col("license").isNotNull()
    return out.select(
        "doc_id",
        "path",
        F.coalesce("license", "up.l", F.lit("none")).alias("license"),
        F.when(mine, F.col("score")).otherwise(F.col("up.s")).alias("score"),
        F.when(mine, "own").when(F.col("up").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(mine, F.col("doc_id")).otherwise(F.col("up.d")).alias("from_doc_id"),
    )


def with_paths(docs: DataFrame) -> DataFrame:
    """``documents`` as files: a folder for each source, language and thousand of ids."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.concat_ws("/", part("source"), part("lang"), F.floor(F.col("doc_id") / 1000).cast("string"), part("doc_id")).alias("path"))


ORACLE_SQL = f"""
WITH files AS (SELECT doc_id, text, concat_ws('/', coalesce(source, ''), coalesce(lang, ''), CAST(doc_id // 1000 AS VARCHAR), CAST(doc_id AS VARCHAR)) AS path FROM documents),
placed AS (SELECT doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS folder FROM files),
table_ AS (SELECT * FROM {_templates_sql()}),
tw AS (SELECT form, word, 1 + ln(count(*)) AS tf FROM (SELECT form, unnest(regexp_extract_all(lower(statement), '{WORD}')) AS word FROM table_) GROUP BY ALL),
idf AS (SELECT word, ln((1.0 + {len(templates())}) / (1.0 + count(*))) + 1.0 AS idf FROM tw GROUP BY word),
wt AS (SELECT form, word, tf * idf AS w FROM tw JOIN idf USING (word)),
forms AS (SELECT form, license, title, word, w / sqrt(sum(w * w) OVER (PARTITION BY form)) AS weight FROM wt JOIN table_ USING (form)),
cand AS (SELECT doc_id, text, len(regexp_extract_all(lower(text), '{WORD}')) AS n_all FROM files WHERE {_marked_sql("text")}),
parts AS (SELECT doc_id, string_split_regex(text, '{BREAK}') AS ps, string_split(text, chr(10)) AS ls FROM cand),
units AS (SELECT doc_id, 0 AS kind, 0 AS place, text AS body FROM cand
UNION ALL SELECT doc_id, 1, place, ps[place + 1] FROM (SELECT doc_id, ps, unnest(range(len(ps))) AS place FROM parts WHERE len(ps) > 1)
UNION ALL SELECT doc_id, 2, place, ls[place + 1] FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS place FROM parts WHERE len(ls) > 1)),
words AS (SELECT doc_id, kind, place, word, count(*) AS n, 1 + ln(count(*)) AS tf FROM (SELECT doc_id, kind, place, unnest(regexp_extract_all(lower(body), '{WORD}')) AS word FROM units WHERE {_marked_sql("body")}) GROUP BY ALL),
ww AS (SELECT words.*, tf * coalesce(idf, ln({len(templates())} + 1.0) + 1.0) AS w FROM words LEFT JOIN idf USING (word)),
size AS (SELECT doc_id, kind, place, sqrt(sum(w * w)) AS size, sum(n) AS n_words FROM ww GROUP BY ALL),
dot AS (SELECT doc_id, kind, place, form, license, title, sum(w * weight) AS dot FROM ww JOIN forms USING (word) GROUP BY ALL),
scored AS (SELECT doc_id, kind, place, license, title, n_words, round(dot / size, 6) AS score FROM dot JOIN size USING (doc_id, kind, place) WHERE round(dot / size, 6) >= {COSINE}),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id, kind, place ORDER BY score DESC, license, title) = 1),
own AS (SELECT doc_id, license, score, max(CAST(kind = 0 AS INTEGER)) OVER w + max(CAST(kind > 0 AND place <= 1 AND title AS INTEGER)) OVER w > 0 OR sum(CASE WHEN kind = 2 THEN n_words ELSE 0 END) OVER w * 2 >= n_all AS holds
FROM best JOIN cand USING (doc_id) WINDOW w AS (PARTITION BY doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN kind = 0 THEN 0 WHEN place <= 1 AND title THEN 1 WHEN license <> '{LAST}' THEN 2 ELSE 3 END, score DESC, kind, place, license) = 1),
holds AS (SELECT folder, license, score, doc_id AS from_doc_id FROM own JOIN placed USING (doc_id) WHERE holds QUALIFY row_number() OVER (PARTITION BY folder ORDER BY score DESC, doc_id) = 1),
folders AS (SELECT DISTINCT folder FROM placed),
above AS (SELECT folder, depth, array_to_string(string_split(folder, '/')[1:depth], '/') AS ancestor FROM (SELECT folder, unnest(range(0, len(string_split(folder, '/')) + 1)) AS depth FROM folders)),
near AS (SELECT above.folder, license AS l, score AS s, from_doc_id AS d FROM above JOIN holds ON above.ancestor = holds.folder QUALIFY row_number() OVER (PARTITION BY above.folder ORDER BY depth DESC) = 1)
SELECT doc_id, path, coalesce(license, l, 'none') AS license, CASE WHEN license IS NOT NULL THEN score ELSE s END AS score,
CASE WHEN license IS NOT NULL THEN 'own' WHEN l IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, CASE WHEN license IS NOT NULL THEN doc_id ELSE d END AS from_doc_id
FROM placed LEFT JOIN own USING (doc_id) LEFT JOIN near USING (folder)
"""
