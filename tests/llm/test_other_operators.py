"""Embeddings, pages, components and the pipeline."""

from __future__ import annotations

import random
from itertools import product

import numpy as np
import pytest
from tests.llm.helpers import documents, sentence

from ruleweft.llm import embed_dedup, html_extract
from ruleweft.llm.components import components, forest


def plain_links(vecs: list, labels: list) -> tuple[list[int], list[int]]:
    def unit(v):
        if not v or any(x is None for x in v) or not np.isfinite(v).all() or not np.any(v):
            return None
        return np.array(v) / np.linalg.norm(v)

    us, up, n = [unit(v) for v in vecs], list(range(len(vecs))), [0] * len(vecs)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(us)):
        for j in range(i):
            if us[i] is not None and us[j] is not None and labels[i] is not None and labels[i] == labels[j] and len(us[i]) == len(us[j]) and us[i] @ us[j] >= 0.98:
                n[i] += 1
                n[j] += 1
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return n, [root(i) for i in range(len(us))]


def test_embeddings(spark):
    rnd = np.random.default_rng(3)
    vecs, labels = [], []
    centre = rnd.normal(size=16)
    for i in range(400):
        if i % 4 == 0:  # a crowd around one vector, larger than the window
            v = centre + 0.11 * rnd.normal(size=16)
        elif i % 4 == 1 and vecs:
            v = np.array(vecs[rnd.integers(len(vecs))]) + 0.01 * rnd.normal(size=16)
        else:
            v = rnd.normal(size=16)
        vecs.append([float(np.float32(x)) for x in v])
        labels.append(int(i % 3) if i % 4 else 1)
    vecs += [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] * 16, vecs[0], vecs[0], [1.0, 2.0], [2.0, 4.0]]
    labels += [1, 1, 1, 1, 1, 1, labels[0], None, 1, 1]
    df = spark.createDataFrame(list(zip(range(len(vecs)), vecs, labels, strict=True)), "vec_id bigint, embedding array<float>, label int")
    n, comp = plain_links(vecs, labels)
    for block in (embed_dedup.BLOCK, 20):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.embedding_near_dedup(df, block=block).collect()}
        assert got == {i: (n[i], comp[i], comp[i] == i) for i in range(len(vecs))}
    assert embed_dedup.embedding_near_dedup(df.limit(0)).count() == 0
    twice = df.limit(5).union(df.limit(5)).unionByName(spark.createDataFrame([(None, vecs[1], 1)], df.schema))
    assert embed_dedup.embedding_near_dedup(twice).count() == 6


def test_concentrated_embeddings(spark):
    """A label of mean cosine 0.9, which hash bits hardly split, with isolated pairs at cosine 0.9805."""
    rnd = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    mean = unit(rnd.normal(size=64))
    x = unit(np.sqrt(0.9) * mean + np.sqrt(0.1) * unit(rnd.normal(size=(4000, 64))))
    off = rnd.normal(size=(1000, 64))
    off = unit(off - (off * x[:1000]).sum(1, keepdims=True) * x[:1000])
    x = np.concatenate([x, 0.9805 * x[:1000] + np.sqrt(1 - 0.9805**2) * off]).astype(np.float32)
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<float>, label int")
    u = unit(x.astype(np.float64))
    want = (u @ u.T >= embed_dedup.COSINE).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embed_dedup.embedding_near_dedup(df).collect()}
    assert want.sum() >= 2000 and [got[i] for i in range(len(x))] == want.tolist()


def test_touching_crowds(spark):
    """Labels with two crowds each that one pair near the threshold joins, one crowd partly of equal vectors."""
    rnd = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x, labels = [], []
    for label in range(6):
        a = unit(rnd.normal(size=64))
        off = rnd.normal(size=64)
        off = unit(off - (off @ a) * a)
        b = 0.9803 * a + np.sqrt(1 - 0.9803**2) * off  # one member of each crowd lies that near
        around = lambda c: unit(c + 0.01 * rnd.normal(size=(400, 64)))
        far = unit(a - 0.3 * off)
        two = unit(b + 0.3 * off)
        crowd = np.concatenate([around(far), [a], around(two), [b]])
        crowd[50:150] = crowd[50]
        x.append(crowd)
        labels += [label] * len(crowd)
    x = np.concatenate(x).astype(np.float32)
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, v, y) for i, (v, y) in enumerate(zip(x.tolist(), labels, strict=True))], "vec_id bigint, embedding array<float>, label int")
    df = df.withColumns({n: F.lit(-1) for n in ("v", "n", "dim", "key", "pass", "component_id", "links", "kept", "size")})
    u, y = unit(x.astype(np.float64)), np.array(labels)
    near = (u @ u.T >= embed_dedup.COSINE) & (y[:, None] == y[None])
    comp = np.arange(len(x))
    while True:
        new = np.where(near, comp[None], len(x)).min(1)
        if (new == comp).all():
            break
        comp = new
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.embedding_near_dedup(df).collect()}
    assert [got[i] for i in range(len(x))] == list(zip((near.sum(1) - 1).tolist(), comp.tolist(), strict=True))


def test_threshold_is_one_formula():
    """The block's matrix product decides at the threshold as the windows do, also for exact ties."""
    rnd = np.random.default_rng(2)
    x = embed_dedup.units(rnd.normal(size=(200, 24)))
    for c in (embed_dedup.cosines(x[:50], x[50:100])).tolist():
        m = embed_dedup.linked(x, x, c)
        want = np.array([embed_dedup.cosines(np.repeat(x[i : i + 1], len(x), 0), x) >= c for i in range(len(x))])
        assert (m == want).all() and (m == m.T).all()


def test_passes():
    assert embed_dedup.n_passes(5_000) < embed_dedup.n_passes(5_000_000) < 100


def test_components(spark):
    rnd = random.Random(8)
    pairs = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(90)] + [(i, i + 1) for i in range(300, 420)] + [(5, 5)]
    up = list(range(500))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(pairs, "a bigint, b bigint").repartition(5)).collect()}
    assert got == {i: root(i) for a, b in pairs if a != b for i in (a, b)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    assert forest(np.array([1, 2, 1]), np.array([2, 3, 3])).tolist() == [True, True, False]


def test_min_cut():
    rnd = random.Random(2)
    for _ in range(150):
        n = rnd.randint(1, 7)
        net = [rnd.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rnd.uniform(0, 2)) for i in range(n) for j in range(i) if rnd.random() < 0.5]
        cut = lambda s: sum(-min(net[i], 0) if s[i] else max(net[i], 0) for i in range(n)) + sum(c for i, j, c in edges if s[i] != s[j])
        assert cut(html_extract.min_cut(net, edges)) == pytest.approx(min(cut(s) for s in product([False, True], repeat=n)))


PAGES = {
    "<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li><a href='/x'>Menu</a></li></ul></nav><div class='ad'>Buy this now, it is cheap.</div><article><h1>Head &amp; line</h1><p><b>First part of the text,<br>with more.<p>Second &lt;para&gt;  graph.</p></article><footer>&copy; us</footer>": "Head & line First part of the text, with more. Second <para> graph.",
    "<div class='sidebar'><p>Aside text of some length, which looks quite real.</p></div><main><p>The body of the page has a sentence here.</p><form><p>Your name:</p></form><section id='comments'><p>A reader liked the page a lot and says so.</p></section></main>": "The body of the page has a sentence here.",
    "<div id='cookie-notice'>We use cookies to make this page better for you.</div><div class='content'><p>Wo<i>rd</i>s join. <a href='x'>A link</a> stays in the text.</p><!-- <p>hidden</p> --></div>": "Words join. A link stays in the text.",
    "<div class='layout with-sidebar'><div class='sideBar'><p>Links of the side, which are long enough to fool.</p></div><article><p>The text is here, and it ends.</p><aside>Read more about this elsewhere.</aside><div class='share-box'>Share it!</div><pre>code  too</pre><table><tr><td>a<td>b</table></article></div>": "The text is here, and it ends. code too a b",
    "<div class='layout sidebar-left'><article><h1>T</h1><p>A text of the article, which goes on for a while.</p></article><div class='sidebar'>Side links here</div></div>": "T A text of the article, which goes on for a while.",
    "<form id='aspnetForm'><nav><a href=x>Menu</a></nav><div class='content'><p>A text of the article, which goes on for a while.</p></div><footer>foot</footer></form>": "A text of the article, which goes on for a while.",
    "<form><ul><li><a href=x>Menu</a></ul><div><p>A text of the article, which goes on for a while and then some more, until it ends.</p><p>A second paragraph follows, as one would expect here.</p></div></form>": "A text of the article, which goes on for a while and then some more, until it ends. A second paragraph follows, as one would expect here.",
    "<article><header><h1>The title here</h1></header><p>A text of the article, which goes on for a while.</p><p class='notice-of-award'>The notice of award was sent to the winners, who were happy to get it.</p><div class='notice'>This page has moved to another place, see there.</div></article>": "The title here A text of the article, which goes on for a while. The notice of award was sent to the winners, who were happy to get it.",
    "<article><h1>T</h1><p>Short text.</p></article><section id='comments'><article><p>A comment of great length, which goes on and on, much more than the article itself does. Really long one.</p></article><article class='comment'><p>And another comment of great length, more than the article.</p></article></section>": "T Short text.",
    "<article><p>Text one is here and it is good.</p><svg/><p>Text two is here and it is good.</p><button>Buy<p>Text three is here and it is good.</p></article>": "Text one is here and it is good. Text two is here and it is good. Text three is here and it is good.",
    "<aside class='related'><article><p>A teaser of another story, which is long too.</p></article></aside><article><p>The real one, with a text.</p></article>": "The real one, with a text.",
    "no tags but a sentence of plain words, which is all there is.": "no tags but a sentence of plain words, which is all there is.",
    "": "",
}


def test_pages(spark):
    cases = list(PAGES.items())
    df = spark.createDataFrame([(i, f"u{i}", h, 1) for i, (h, _) in enumerate(cases)] + [(90, None, None, 1), (91, "u", "<p>" * 3000 + "x", 1), (92, "u", "<article>" + "<p>One more sentence of text.</p>" * 5000 + "</article>", 1), (93, "u", '<a "' * 5000, 1), (None, None, cases[0][0], 1), (0, "u0", cases[0][0], 1)], "page_id bigint, url string, html string, text int")
    for costs in (None, html_extract.train(df)):
        check_pages(df, cases, costs)
    assert html_extract.extract(df.limit(0), html_extract.train(df.limit(0))).count() == 0


def check_pages(df, cases, costs):
    every = html_extract.extract(df, costs).collect()
    assert len(every) == df.count() and [r["text"] for r in every if r["page_id"] is None] == [cases[0][1]]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in every if r["page_id"] is not None}
    for i, (_, want) in enumerate(cases):
        assert got[i] == (want, len(want))
    assert got[90] == ("", 0) and got[92][1] == 5000 * 27 - 1 and set(got) == {*range(len(cases)), 90, 91, 92, 93}


def test_whole_labelling():
    """The labels of random pages cut as little as any labels do."""
    rnd = random.Random(7)
    tags = ["p", "div", "li", "h1", "h2", "section class=sidebar", "article", "nav", "div class=share-box", "td", "p class=notice-of-x"]
    for _ in range(120):
        html, n = "", 0
        for _ in range(rnd.randint(1, 9)):
            t = rnd.choice(tags)
            text = " ".join("word" for _ in range(rnd.randint(1, 14))) + rnd.choice([".", ""])
            html += f"<{t}>" + (f"<a href=x>{text}</a>" if rnd.random() < 0.3 else text) + (f"</{t.split()[0]}>" if rnd.random() < 0.7 else "")
        found, every = html_extract.blocks(html)
        marked = html_extract.weigh(found, every)
        net, edges = [html_extract.Costs().evidence(b, marked) for b in found], html_extract.edges(found)
        n = len(found)
        cut = lambda s: sum(-min(net[i], 0) if s[i] else max(net[i], 0) for i in range(n)) + sum(c for i, j, c in edges if s[i] != s[j])
        best = min(product([False, True], repeat=n), key=cut)
        got = html_extract.min_cut(net, edges)
        assert cut(got) == pytest.approx(cut(best))
        assert html_extract.main_text(html) == " ".join(b.text for b, g in zip(found, got, strict=True) if g)


def test_pages_in_linear_time():
    import time

    for html in ("<article>" + "<p>One more sentence of text.</p>" * 100_000 + "</article>", "<div>" * 100_000 + "x", "<button>" * 50_000, "<b>x" * 50_000, "<a>y" * 50_000):
        start = time.time()
        html_extract.main_text(html)
        assert time.time() - start < 15  # some 1 s each on an idle machine


def test_fitted_costs():
    cells = {(1, 12, 1, 0, 0): 500, (1, 3, 0, 0, 0): 100, (0, 2, 0, 10, 3): 700, (0, 9, 1, 0, 0): 40}
    c = html_extract.fit(cells)
    assert c.weights != html_extract.PRIOR and c.weights[3] < -2 and html_extract.fit({(1, 3, 1, 0, 0): 5}).weights == html_extract.PRIOR


def test_pipeline_near_threshold(spark):
    """Copies of a similarity between 0.80 and 0.85 go, those below 0.80 stay."""
    import corpus_pipeline as P

    from ruleweft.llm.minhash import n_collections

    rnd, values, stays = random.Random(21), [], []
    for i in range(60):
        w = sentence(rnd, 204).split(" ")
        n = 4 if i % 2 else 6  # edits far apart change five shingles each, of 200
        copy = ["edited" if k % 30 == 15 and k // 30 < n else x for k, x in enumerate(w)]
        sets = [{tuple(x[k : k + 5]) for k in range(200)} for x in (w, copy)]
        like = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        assert 0.80 <= like < 0.85 if n == 4 else like < 0.80
        stays += [2 * i] if n == 4 else [2 * i, 2 * i + 1]
        values += [" ".join(w), " ".join(copy)]
    assert [r["doc_id"] for r in P.near_duplicates(spark, documents(spark, values), "").orderBy("doc_id").collect()] == stays
    assert n_collections(85) == 10 and n_collections(80) > 10


def test_pipeline(spark, tmp_path):
    """Each stage against what it should keep; the packed pieces hold exactly what the stage before left."""
    import corpus_pipeline as P

    rnd = random.Random(12)
    clean = ["\n".join(sentence(rnd, 14).capitalize() + "." for _ in range(6)) for _ in range(120)]
    junk = ["\n".join(" ".join(w + "###" for w in sentence(rnd, 14).split()) for _ in range(6)) for _ in range(40)]
    toxic = [c.replace(".\n", " vile wretch.\n", 2) for c in clean[:40]]
    toxic = ["\n".join(sentence(rnd, 14).capitalize() + " vile wretch." for _ in range(6)) for _ in range(40)] or toxic
    words = clean[50].split(" ")
    words[10] = "changed"
    values = clean + junk + toxic + [clean[3], " ".join(words), sentence(rnd, 30) + "\n" + clean[60][:250] + "\n" + sentence(rnd, 30), None, ""]
    documents(spark, values).write.parquet(str(tmp_path / "documents.parquet"))
    n = len(clean)
    spark.createDataFrame([(i, int(not n <= i < n + 40), int(n + 40 <= i < n + 80)) for i in range(n + 80)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"s{i}"))
        docs = spark.read.parquet(str(tmp_path / f"s{i}"))
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        assert i == len(P.STAGES) - 1 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    last = n + 80
    assert kept[0] == {*range(n), *range(n + 40, last + 3)}
    assert kept[1] == kept[0] - {*range(n + 40, last)}
    assert kept[2] == kept[1] - {last, last + 1}
    assert kept[3] == kept[4] == kept[2]
    before = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "s2")).collect()}
    after = {r["doc_id"]: (r["text"], r["n_chars"]) for r in spark.read.parquet(str(tmp_path / "s3")).collect()}
    assert clean[60][:250] not in after[last + 2][0] and all(len(t) == c for t, c in after.values())
    assert all(after[i][0] == before[i] for i in after if i < n)
    assert {r["doc_id"] for r in P.run(spark, str(tmp_path)).collect()} == kept[4]
