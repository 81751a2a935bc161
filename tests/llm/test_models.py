"""The page labeller and the quality classifier: gradients, held-out accuracy, edges."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import classifier, labeller
from ledgerlake.llm.blocks import blocks_of
from ledgerlake.llm.layouts import sample_page


@pytest.fixture(scope="module")
def model():
    return labeller.trained()


def test_blocks():
    page = """<!DOCTYPE html><head><title>T &amp; U</title><script>if (a<b) x="<p>no</p>"</script><style>p{}</style></head><body>
    <!-- <p>no</p> --><ul><li>one<li>two <b>bold</b></ul><p class='Big-fooBar' id=x>a<br>b&nbsp;c<p>d<br/><br>e<textarea>no</textarea><noscript>no</noscript>
    <table><tr><td>1<td>2</table>f &lt;p&gt; &#228;<hr>g <a href="/x?a>b">link</a></body>"""
    found = blocks_of(page)
    assert [b.text for b in found] == ["T & U", "one", "two bold", "a b c", "d", "e", "1", "2", "f <p> ä", "g link"]
    assert found[3].path == ("body", "p", ".big", ".foo", ".bar", ".x") and found[1].path == found[2].path == ("body", "ul", "li")
    assert found[-1].linked == 4 and found[0].path == ("head", "title")
    assert blocks_of(None) == blocks_of("") == blocks_of("<p> </p><!-- x") == [] and blocks_of("a <b")[0].text == "a <b"
    assert [b.text for b in blocks_of("<p>x</p>" * 3000)] == ["x"] * 3000


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    pages = [(labeller.numbers_of(blocks_of(h)), y) for h, y in (sample_page(rng) for _ in range(3))]
    xs, ys = [p for p, _ in pages], [y for _, y in pages]
    net = labeller.Labeller(1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}

    def loss():
        x, mask = net.padded(xs)
        chance = net.forward(x, mask)[0]
        total = 0.0
        for k, y in enumerate(ys):
            own = np.clip(chance[: len(y), k].astype(np.float64), 1e-9, 1 - 1e-9)
            total -= np.where(np.array(y) == 1, np.log(own), np.log(1 - own)).sum()
        return total / mask.sum()

    grads = net.gradients(xs, ys)
    for name in net.w:
        flat, g = net.w[name].reshape(-1), grads[name].reshape(-1)
        for k in np.argsort(-np.abs(g))[:4]:
            old = flat[k]
            flat[k] = old + 1e-2
            up = loss()
            flat[k] = old - 1e-2
            down = loss()
            flat[k] = old
            assert (up - down) / 2e-2 == pytest.approx(g[k], rel=0.08, abs=2e-4), name


def test_held_out_layouts(model):
    rng = np.random.default_rng(12345)
    pages = [(blocks_of(h), np.array(y, bool)) for h, y in (sample_page(rng) for _ in range(300))]
    pages = [(b, y) for b, y in pages if len(b) == len(y)]
    found = model.labels([b for b, _ in pages])
    wrong = sum((f != y).sum() for f, (_, y) in zip(found, pages))
    assert wrong / sum(len(y) for _, y in pages) < 0.01
    alone = [model.labels([b])[0] for b, _ in pages[:40]]
    assert sum((a != f).sum() for a, f in zip(alone, found)) == 0  # company in a batch doesn't matter


def test_written_pages(spark, model):
    body = "<h1>The title of it</h1><p>First paragraph with <a href='/a'>a link</a> and more words.</p><p>Second one.</p><ul><li>a point made</li></ul>"
    kept = "The title of it\nFirst paragraph with a link and more words.\nSecond one.\na point made"
    nav = "<nav><a href='/'>Home</a> <a href='/x'>News</a></nav>"
    pages = [
        f"<html><body><header><div class='logo'>Site</div>{nav}</header><div class='cookie-notice'><p>We use cookies here.</p><button>Accept</button></div>"
        f"<article>{body}</article><aside class='sidebar'><h3>Related</h3><ul><li><a href='/b'>Other story</a></li></ul></aside>"
        "<section id='comments'><h3>Comments</h3><div class='comment'><p>I do not agree with any of this at all.</p></div></section>"
        "<form><label>Your name</label><input><button>Send</button></form><footer><p>&copy; 2024 Example</p></footer></body></html>",
        f"<body>{nav}<main><div class='post-content'>{body}</div></main><div class='advert'>Buy the best thing now.</div><footer>About us</footer></body>",
        f"<title>x</title>{nav}<div class='ad'>Some advert text goes here.</div><article>{body}</article><footer>&copy; a.example.com &middot; Words.</footer>",
        None, "", "<nav><a href='/'>only a menu</a></nav>",
    ]
    rows = [(k, f"u{k}", h, "clash") for k, h in enumerate(pages)] + [(0, "u0", pages[0], "clash")]
    out = labeller.extracted(spark.createDataFrame(rows, "page_id int, url string, html string, text string"), model).collect()
    got = {r.page_id: r.text for r in out}
    assert len(out) == len(rows)
    assert got == {0: kept, 1: kept, 2: kept, 3: "", 4: "", 5: ""}


def test_given_pages(spark, model):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    right = 0
    for r in rows:
        blocks = blocks_of(r.html)
        want = [b.text for b in blocks if "article" in b.path]
        right += [b.text for b, y in zip(blocks, model.labels([blocks])[0]) if y] == want
    assert right >= 0.98 * len(rows)


# The classifier.


def test_rows_of_words_are_those_of_single_words():
    words = ["a", "Größe", "x" * 200, "wörd", "it's", "𝒳y", "a"]
    rows, owner = classifier.rows_of(words)
    for k, w in enumerate(words):
        alone, _ = classifier.rows_of([w])
        assert sorted(rows[owner == k]) == sorted(alone)
        assert len(alone) == 1 + sum(max(0, len(w) + 2 - n + 1) for n in (3, 4, 5))
    assert classifier.units("b b c b") == ["b", "\x02b", "c", "b"]


def quality(spark):
    rnd = random.Random(6)
    good = lambda: " ".join("".join(rnd.choice(["an", "the", "ti", "on"]) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(8, 60)))
    bad = [lambda t: t.upper() + "!!", lambda t: t.replace(" ", "*** "), lambda t: " ".join(w for w in t.split() for _ in range(4))]
    docs, labels = [], []
    for k in range(1500):
        y = int(rnd.random() < 0.8)
        docs.append((k, good() if y else rnd.choice(bad)(good()), 0.5, "L"))
        labels.append((k, y, 0))
    docs += [(5000, None, 0.1, "L"), (5001, "", 0.1, "L"), (None, "some text", 0.1, "L"), docs[3], (5002, "x" * 100_000, 0.1, "L")]
    labels += [(3, 1 - labels[3][1], 0), (7, None, 0), (None, 1, 0), (9999, 1, 1), (11, 7, 0)]
    return docs, labels


def test_classifier_on_held_out_documents(spark):
    docs, labels = quality(spark)
    df = spark.createDataFrame(docs, "doc_id bigint, text string, score double, Label string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    scorer = classifier.learn(df, marks, "quality", most=1000)
    out = classifier.scored(df, scorer).withColumn("held", classifier.is_held_out(F.col("doc_id"))).collect()
    assert len(out) == len(docs) and all(0 <= r.score <= 1 for r in out)
    truth = {k: y for k, y, _ in labels[:1500]}
    held = [r for r in out if r.held and r.doc_id in truth]
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    assert np.mean([(r.score >= 0.5) == bool(truth[r.doc_id]) for r in held]) > 0.97
    by_id = {r.doc_id: r.score for r in out}
    assert by_id[5000] == by_id[5001]
    again = classifier.learn(df.repartition(7), marks, "quality", most=1000)
    assert np.array_equal(scorer.weights, again.weights) and scorer.bias == again.bias
    nothing = classifier.learn(df, marks.limit(0), "quality")
    assert {r.score for r in classifier.scored(df, nothing).collect()} == {0.5}
    assert classifier.scored(df.limit(0), scorer).count() == 0


@pytest.mark.parametrize("page, want", [
    ("<p>first one</p><object data=x><p>two</p><p>third one here</p>", ["first one", "two", "third one here"]),
    ("<p>Energy is <math><mi>E</mi><mo>=</mo><msup><mi>m</mi><mn>2</mn></msup></math> here</p>", ["Energy is E=m2 here"]),
    ("<p>a <audio src=x>no sound</audio> b</p><video>plain text</video>", ["a no sound b", "plain text"]),
    ("<p class=it's>one</p><p title='a>b'>two</p><p x=\"a>b\" y=''>three</p><p \"q>four</p>", ["one", "two", "three", "four"]),
    ("<p>x</p><script>var a = 1</p><p>after", ["x", "var a = 1", "after"]),
    ("<p>x</p><script>var a = '<p>'</script><style>p {}</style><p>after<textarea>no</textarea>", ["x", "after"]),
])
def test_text_that_is_kept(page, want):
    assert [b.text for b in blocks_of(page)] == want


def test_labelled_rows_on_the_driver_are_bounded(spark, monkeypatch):
    """A labelled key with very many rows, repeats and long texts: the driver sees each text once, and no more than the bounds."""
    seen = []
    monkeypatch.setattr(classifier, "train", lambda samples: seen.append(len(samples)) or (np.zeros((classifier.BUCKETS, 2)), np.zeros((2, 2)), np.zeros(2)))
    rows = [(1, f"text number {k % 40} of one key") for k in range(400)] + [(k, f"own text {k}") for k in range(2, 60)] + [(61, None), (62, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(k, k % 2) for k in range(1, 63)], "doc_id long, quality int")
    free = {k for k in range(1, 63) if zlib.crc32(str(k).encode()) % 5}
    want = len({r for r in rows if r[0] in free})
    classifier.learn(docs, marks, "quality")
    classifier.learn(docs, marks, "quality", most=20)
    monkeypatch.setattr(classifier, "LABELLED_FEATURES", 600)
    classifier.learn(docs, marks, "quality")
    assert seen[0] == want and seen[1] <= 20 and 0 < seen[2] <= 600 / 6 / 10 + 2
