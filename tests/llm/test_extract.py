import random

import numpy as np

from veriframe.llm import op07_extract as op


def test_held_out_pages():
    field, rng, right, n = op.trained(), random.Random(999), 0, 0
    for _ in range(150):
        page, labels = op.labelled_page(rng)
        got = op.blocks(page)
        assert len(got) == len(labels)
        right += sum(a == b for a, b in zip(labels, field.decode(field.scores(got)), strict=True))
        n += len(labels)
    assert right / n > 0.99


def test_viterbi_against_all_labelings():
    rng = np.random.default_rng(2)
    for _ in range(50):
        f = op.Field({})
        f.step, f.first, n = rng.normal(size=(2, 2)), rng.normal(size=2), int(rng.integers(1, 8))
        s = rng.normal(size=(n, 2))
        best = max((([y >> i & 1 for i in range(n)]) for y in range(2**n)), key=lambda y: f.first[y[0]] + sum(s[i][y[i]] for i in range(n)) + sum(f.step[a][b] for a, b in zip(y, y[1:])))
        assert f.decode(s) == best


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<nav><ul><li><a href=/a>Menu</a><li><a href=/b>More</a></ul></nav><!-- <p>no</p> --><div class="cookie-notice"><p>We use cookies.</p></div>
<article><h1>Title &amp; more</h1><p><b>First  line<br>second.<br><p>Caf&eacute; &#169; 2020, a &lt; b.</p><p>The.</p></article>
<div class="comments"><p>Nice post, I think, really.</p></div><form><label>Mail</label><button>Go</button></form><footer>&copy; us</footer></body></html>"""


def test_page(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, None), (3, "v", "", ""), (None, "w", "plain < text", ""), (1, "u", PAGE, "x"), (4, "d", "<div>" * 3000 + "x" + "</p>" * 3000, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = op.extract(df).collect()
    assert len(out) == len(rows)
    want = "Title & more\nFirst line second.\nCafé © 2020, a < b.\nThe."
    assert [r["text"] for r in out if r["page_id"] == 1] == [want, want]
    assert [r["n_chars"] for r in out if r["page_id"] == 1] == [len(want)] * 2
    assert [r["text"] for r in out if r["page_id"] in (2, 3)] == ["", ""]
    assert op.extract(df.limit(0)).count() == 0


def test_corpus_pages(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in op.extract(pages).collect():
        art = re.search(r"<article>(.*?)</article>", source[r["page_id"]], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", q)).split()) for q in re.split(r"</?(?:h1|p)>", art))
        assert r["text"] == "\n".join(x for x in parts if x)


def test_formulas_are_text_and_depth_changes_nothing():
    field = op.trained()
    page = "<body><nav><a href=x>menu</a></nav><article><p>Let <math><mi>x</mi></math> be a number, and so on.</p></article></body>"
    assert op.main_text(page, field) == "Let x be a number, and so on."
    deep = f"<body><div class=cookie-notice><p>We use cookies.</p></div><article>{'<div><b>' * 40_000}<p>Some text, which is deep. It goes on.</p></article></body>"
    assert op.main_text(deep, field) == "Some text, which is deep. It goes on."
    many = "<body><article><p>Text.</p>" + "".join(f"<i class=n{k}>" for k in range(30_000)) + "x</b>" * 30_000 + "</article>"
    assert op.main_text(many, field).startswith("Text.")


def test_training_reaches_the_maximum_of_the_likelihood():
    """Against the sum over all labelings of short pages: no step away from the weights scores better."""
    rng = random.Random(8)
    tags = ("nav", "p", "aside", "li")
    pages, labels = [], []
    for _ in range(14):
        n = rng.randint(1, 5)
        own = [rng.choice(tags) for _ in range(n)]
        pages.append([((frozenset({f"in:{t}"}), t), "some text", 0) for t in own])
        labels.append([int(t in ("p", "li")) if rng.random() < 0.8 else rng.randint(0, 1) for t in own])
    decay = 0.05
    field = op.train(pages, labels, epochs=600, rate=0.05, decay=decay)

    def objective(emit, step, first):
        f = op.Field(field.vocabulary)
        f.emit, f.step, f.first = emit, step, first
        total = 0.0
        for p, y in zip(pages, labels, strict=True):
            s = f.scores(p)
            value = lambda z: first[z[0]] + sum(s[i][z[i]] for i in range(len(z))) + sum(step[a][b] for a, b in zip(z, z[1:]))  # noqa: B023, E731
            every = [value([k >> i & 1 for i in range(len(y))]) for k in range(2 ** len(y))]
            total += value(y) - np.logaddexp.reduce(every)
        return total / len(pages) - decay / 2 * sum((w**2).sum() for w in (emit, step, first))

    best, noise = objective(field.emit, field.step, field.first), np.random.default_rng(3)
    for _ in range(30):
        moved = [w + noise.normal(0, 0.05, w.shape) for w in (field.emit, field.step, field.first)]
        assert objective(*moved) < best + 1e-6


def test_broken_declarations_take_linear_time():
    """A megabyte of opened declarations is text, read once."""
    import time

    began = time.time()
    n = sum(1 for _ in op._TAG.finditer("<!" * 500_000 + "<p>end</p>"))
    assert n == 2 and time.time() - began < 2
