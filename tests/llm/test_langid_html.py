"""Language ID by held-out accuracy and a plain parse; main text on written pages."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import htmltext, langid

WORDS = {"aa": "thing with that from water stone", "bb": "chose avec dans eau pierre où été", "cc": "ding mit das wasser stein für über"}


def text(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n)).capitalize() + "."


def labelled(n: int = 120):
    rng = random.Random(4)
    return [(k, text(rng, lang, rng.randint(2, 60)), lang) for k in range(n) for lang in [sorted(WORDS)[k % 3]]]


def test_automaton_knows_just_the_substrings():
    s = [2, 3, 2, 2, 3, 4, 2, 3]
    step = langid.suffix_automaton(s, 6)
    have = {tuple(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for n in (1, 2, 3, 4):
        for code in range(6**n):
            walk, state = tuple(code // 6**k % 6 for k in range(n)), 0
            for c in walk:
                state = int(step.take(np.array([state], dtype=np.uint32), np.array([c], dtype=np.uint32))[0])
                if not state:
                    break
            assert (state != 0) == (walk in have)


def plain_phrases(sample: str, row: str) -> int:
    n, at = 0, ""
    for c in row:
        if at and at + c in sample:
            at += c
        else:
            n += 1 if c in sample else 2
            at = c if c in sample else ""
    return n


def test_phrases_by_hand():
    model = langid.train({"aa": ["the cat sat on the mat"], "bb": ["der hund und die katze"]})
    texts = ["the mat on the cat", "und der kater", "x"]
    row, ends = langid.squeezed(texts, model.symbols)
    got = langid.phrases(model, row, ends)
    for k, s in enumerate((" the cat sat on the mat ", " der hund und die katze ")):
        assert [plain_phrases(s, f" {t} ") for t in texts] == got[:, k].tolist()


def test_long_texts_are_one_walk():
    rng = random.Random(3)
    sample = "".join(rng.choice("abc ") for _ in range(3000))
    model = langid.train({"aa": [sample], "bb": ["aab " * 400]})
    texts = [" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(n)) for n in (5, 900, 3, 2500)]
    texts += ["aab " * 1500 + "a", ""]
    texts = [" ".join(t.split()) for t in texts]
    row, ends = langid.squeezed(texts, model.symbols)
    got = langid.phrases(model, row, ends)
    for k, s in enumerate((" ".join(sample.split()), " ".join(["aab"] * 400))):
        assert [plain_phrases(f" {s} ", f" {t} " if t else " ") for t in texts] == got[:, k].tolist()


def test_scripts_of_many_letters():
    """Two languages of 300 letters each that share none, and one of 3,000, all told apart by any of their letters."""
    rng = random.Random(5)
    scripts = {"aa": range(0x4E00, 0x4E00 + 300), "bb": range(0x5000, 0x5000 + 300), "cc": range(0x6000, 0x6000 + 3000)}
    write = lambda name, n: "".join(chr(rng.choice(scripts[name])) for _ in range(n))
    model = langid.train({name: [write(name, 500) for _ in range(64)] for name in scripts})
    texts = [(name, write(name, n)) for name in scripts for n in (1, 2, 5, 40, 1200) for _ in range(8)]
    assert langid.predict(model, [t for _, t in texts])[0] == [name for name, _ in texts]


def test_a_header_shared_by_all():
    """Samples are spans anywhere in a text, so what leads every text of every language decides nothing."""
    rng = random.Random(6)
    header = "x" * 30 + " the same notice leads each text of the table and is long " * 10
    rows = [(header + text(rng, lang, 300), lang) for lang in WORDS for _ in range(30)]
    spans = {lang: [t[k : k + 500] for t, l in rows if l == lang for k in [rng.randrange(len(t) - 500)]] for lang in WORDS}
    model = langid.train(spans)
    found, _ = langid.predict(model, [t for t, _ in rows])
    assert found == [lang for _, lang in rows]


def test_fit_and_predict(spark):
    rows = labelled()
    df = spark.createDataFrame(rows + [(900, None, None), (901, "12 !?", "aa"), (902, "", "bb"), (903, "Thing with that " * 4000, None)], "doc_id long, text string, lang string")
    model = langid.fit(df.where(~langid.held_out()).select("text", "lang"), docs=20)
    assert model.languages == ["aa", "bb", "cc"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df.withColumn("score", F.lit("x")), model).collect()}
    assert sum(got[k][0] == lang for k, _, lang in rows) >= 0.97 * len(rows)
    assert got[900] == got[901] == got[902] == ("und", 0.0) and got[903][0] == "aa" and all(0 <= s <= 1 for _, s in got.values())


def test_nothing_learned(spark):
    df = spark.createDataFrame([(1, "some text")], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    model = langid.fit(df)
    assert langid.identify(df, model).first()["lang_pred"] == "und"
    assert langid.identify(df.limit(0), model).count() == 0


def test_samples_are_distinct_spans(spark, monkeypatch):
    rng = random.Random(8)
    texts = [f"A notice that leads. {text(rng, 'aa', 40)}" for _ in range(30)]
    rows = spark.createDataFrame([(t, "aa") for t in texts], "text string, lang string")
    first = rows.orderBy(F.xxhash64("text")).first()["text"]
    seen = {}
    monkeypatch.setattr(langid, "train", lambda samples: seen.update(samples))
    langid.fit(rows.unionByName(spark.createDataFrame([(first, "aa")] * 100, rows.schema)), docs=20, chars=20)
    assert len(seen["aa"]) == 20 and all(len(t) == 20 and any(t in x for x in texts) for t in seen["aa"])
    assert len(set(seen["aa"])) > 10 and sum(t.startswith("A notice") for t in seen["aa"]) < 5


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = langid.op5_langid(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 100 and right >= 0.98 * n


PAGE = """<!DOCTYPE html><html><head><title>No</title><script>var t = "<p>no</p>";</script><style>p{}</style></head><body><header>Top of the site</header>
<div class="sidebar"><p>Side text, with commas, and more. It even has sentences.</p></div><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> -->
<div id="main-text"><h1>Title &amp; more</h1><p>Hello <b>big</b>world,   this is
 text.</p><p>Short.<br>Second line, here<form>Your name <input></form><ul><li>item one, okay<li>item two</ul><table><tr><td>c1<td>c2</table><p>a &lt; b &#233;</div>
<div class="comments"><p>I think, this is, a long, comment. With lots of punctuation, really. Yes.</p></div><p class=cookie-notice>We use cookies.</p><footer>End</footer></body></html>"""


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><div class='social history'><p>One, two, and three.</p></div></article>", "One, two, and three."),
        ("<article><h1>Title</h1><section id='comment-on-policy'><p>One, two, and three.</p></section></article>", "Title One, two, and three."),
        ("<article><p>Body, of text. And more.</p><div class='comments'><p>" + "A longer comment, really. " * 9 + "</p></div></article>", "Body, of text. And more."),
        ("<article><p>Body, of text.</p><p><a href=a>One</a>, <a href=b>two</a> and <a href=c>three</a></p></article>", "Body, of text. One, two and three"),
        ("<article><p>Body, of text.</p><table class='related data'><tr><td>1<td>2</table><ol class=share><li>A share of all.</ol></article>", "Body, of text. 1 2 A share of all."),
        ("<article><p>Body, of text.</p><ul class=share><li><a href=a>Tell</a><li><a href=b>Mail</a></ul><ol class='commentlist'><li>No, never.</ol></article>", "Body, of text."),
        (PAGE, "Title & more Hello bigworld, this is text. Short. Second line, here item one, okay item two c1 c2 a < b é"),
        (None, ""),
        ("", ""),
        ("<html></html>", ""),
        ("<div class='ad'>Buy, now.</div>", ""),
        ("plain text only", "plain text only"),
        ("<body><article><h1>T</h1><p>One, two.<p>x<section class='comments'><p>no, no.</section><aside>no</aside></article><article class=comment>no</article>", "T One, two. x"),
        ("<body><nav>a</nav><h1>T</h1><p>Para one, ok.</p><div>bare div text here.</div>", "T Para one, ok. bare div text here."),
        ("<p>cut off <b>in the mid", "cut off in the mid"),
        ("<p>cut <a href='x", "cut"),
        ("<article><section>" + "<p>One, two, and three.</p>" * 6 + "</section><section>" + "<p>Four, five, and six.</p>" * 4 + "</section></article>", " ".join(["One, two, and three."] * 6 + ["Four, five, and six."] * 4)),
        ("<article><div><h1>Title</h1></div><div><p>Body, with words. And more of it.</p></div></article>", "Title Body, with words. And more of it."),
        ("<body><div><div><h1>Title</h1></div><div><p>Body, with words. And more of it.</p></div></div>", "Title Body, with words. And more of it."),
        ("<body><div>" + "<p>A long paragraph, with commas, and a stop. It goes on, and on.</p>" * 3 + "<ul><li>one<li>two</ul><table><tr><td>c</table><pre>x = 1</pre><blockquote>short</blockquote></div>", " ".join(["A long paragraph, with commas, and a stop. It goes on, and on."] * 3) + " one two c x = 1 short"),
        ("<body><div>Outside.</div><article>" + "<p>One, two, and three.</p>" * 7 + "</article><article>" + "<p>Four, five.</p>" * 3 + "</article>", " ".join(["One, two, and three."] * 7 + ["Four, five."] * 3)),
        ("<body><main><div><article><p>First, of two. It is long, and longer.</p></article></div><p>Second, of two.</p></main><div>Outside.</div>", "First, of two. It is long, and longer. Second, of two."),
        ("<article><p>We have <math><mi>x</mi><mo>+</mo><mn>1</mn></math> and more.<p class=legal>A legal matter.<p class='related work'>Related work.<p>foo<img src=x>bar</article>", "We have x+1 and more. A legal matter. Related work. foobar"),
        ("<article>" + "<p>long, text.</p>" * 5000 + "</article>", " ".join(["long, text."] * 5000)),
    ],
)
def test_main_text(page, want):
    assert htmltext.main_text(page) == want


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 5), (2, None, None, 6), (None, "u", "<p>A</p>", 7), (1, "u", PAGE, 8)], "page_id long, url string, html string, n_chars int").withColumn("extra", F.lit(1))
    rows = htmltext.extract(pages).collect()
    odd = htmltext.extract(pages.withColumnRenamed("n_chars", "N_Chars").withColumn("TEXT", F.lit("x")))
    assert odd.columns == ["page_id", "url", "extra", "text", "n_chars"] and odd.count() == 4
    assert len(rows) == 4 and htmltext.extract(pages).columns == ["page_id", "url", "extra", "text", "n_chars"]
    assert all(r["n_chars"] == len(r["text"]) for r in rows) and htmltext.extract(pages.limit(0)).count() == 0


def test_path_scores_prefer_long_punctuated_paths():
    nodes = [(1, "x")] * 5 + [(2, "A sentence, with commas, and a stop.")] * 5
    scores = htmltext.path_scores(nodes)
    assert scores[2] > scores[1] and htmltext.content_paths(scores, nodes) == {2}


def written_page(rng: random.Random, wrapped: bool) -> tuple[str, str]:
    """A page without telling names or tags, and its article; menus, a notice, a sidebar and comments are planted."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + rng.choice([".", ", indeed.", "!"])
    box = iter(rng.sample(range(100, 1000), 60))
    menu = lambda: f"<div class=k{next(box)}>" + "".join(f"<a href=/{k}>{word()}</a> " for k in range(rng.randint(3, 8))) + "</div>"
    blocks = [sentence(rng.randint(25, 80)) for _ in range(rng.randint(5, 12))]
    title = sentence(5)
    items = [word() for _ in range(3)]
    body = f"<h1>{title}</h1>" + "".join(f"<p>{b}</p>" for b in blocks) + "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>"
    side = f"<div class=k{next(box)}><p>{sentence(9)}</p></div>"
    notice = f"<div class=k{next(box)}>{sentence(6)}</div>"
    c = next(box)
    comments = f"<div class=k{next(box)}>" + "".join(f"<div class=k{c}><span>{word()}</span><p>{sentence(8)}</p></div>" for _ in range(rng.randint(1, 3))) + "</div>"
    inner = f"<div class=k{next(box)}>{body}</div>" if wrapped else body
    page = f"<html><body>{menu()}{notice}<div class=k{next(box)}>{menu()}{inner}{side}{comments}</div>{notice}{menu()}</body></html>"
    return page, " ".join([title, *blocks, *items])


def test_written_pages_without_telling_names(monkeypatch):
    """Each generated page gives just its article; with every path taken for content, hardly any would."""
    rng = random.Random(9)
    pages = [written_page(rng, k % 2 == 0) for k in range(200)]
    assert [htmltext.main_text(p) for p, _ in pages] == [a for _, a in pages]
    monkeypatch.setattr(htmltext, "content_paths", lambda scores, nodes: set(scores))
    monkeypatch.setattr(htmltext, "LESSER", 0.0)
    assert sum(htmltext.main_text(p) == a for p, a in pages) < 20


def test_deep_pages():
    import time
    import tracemalloc

    deep = "<div>" * 50_000 + "<p>Deep, but there.</p>" + "".join(f"<span>{k}" for k in range(20_000)) + "</b>" * 1000
    tracemalloc.start()
    began = time.perf_counter()
    got = htmltext.main_text(deep)
    assert got.startswith("Deep, but there. 0") and time.perf_counter() - began < 20
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()
