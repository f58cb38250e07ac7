"""Main-text extraction: broken mark-up, the field's exact labelling and gradient, and what an article keeps."""

import itertools
import time

import numpy as np
import pytest


@pytest.fixture(scope="module")
def model():
    from tabwise.llm.html_crf import layout_pages, train_tagger

    return train_tagger(layout_pages())


@pytest.mark.parametrize("piece", ["<a", '<a "', "<a '", "<div>x", "<x>", "<!", "</script", "<script></script", "<b>", "<i><b></i>", "<p>x<h1>", "<", "</p>",
                                   "<div class=w1 id=w2>x", "&", "<a<a\"'", "<!--", "<li>x<b>"])
def test_a_million_bytes_of_broken_markup(model, piece):
    from tabwise.llm.html_crf import leaf_blocks

    page = piece * (1_000_000 // len(piece))
    began = time.process_time()
    blocks = list(leaf_blocks(page))
    model.decode(blocks)
    model.extract("<article><p>Still " + page[:2000] + "</p></article>")
    assert time.process_time() - began < 60
    assert sum(len(b.text) for b in blocks) <= len(page)


def test_text_survives_broken_tags():
    from tabwise.llm.html_crf import leaf_blocks

    texts = lambda page: [b.text for b in leaf_blocks(page)]
    assert texts("<p>one < two <b c") == ["one < two <b c"]
    assert texts('<p title="a > b">one</p>') == ["one"]
    assert texts("<p>The formula <math><mi>x</mi> = <mn>2</mn></math> holds") == ["The formula x = 2 holds"]
    assert texts("<head><title>t</title><body><p>one<p>two") == ["one", "two"]
    assert texts("<ul><li>a<li>b <a href=x>c</a></ul>d<script>if (a < b) {}</script>e") == ["a", "b c", "d", "e"]
    assert texts("a<script>never closed") == ["a"]


def test_viterbi_is_the_best_of_all_labellings(model):
    from tabwise.llm.html_crf import layout_pages

    rng = np.random.default_rng(2)
    for page in layout_pages(2):
        blocks = [b for b, _ in page][:12]
        model.moves = rng.normal(size=(2, 2))
        e = model.emissions(blocks)

        def score(labels):
            return model.starts[labels[0]] + sum(x for x, y in zip(e, labels) if y) + sum(model.moves[a, b] for a, b in zip(labels, labels[1:]))

        best = max(itertools.product((0, 1), repeat=len(blocks)), key=score)
        assert score(tuple(map(int, model.decode(blocks)))) == pytest.approx(score(best))


def test_one_step_follows_the_numeric_gradient(monkeypatch):
    """From zero weights, one step on one page is the gradient of its conditional log likelihood."""
    from tabwise.llm import html_crf as H

    monkeypatch.setattr(H, "EPOCHS", 1)
    page = H.layout_pages(1)[2][:8]
    model = H.train_tagger([page])
    blocks, y = [b for b, _ in page], [int(m) for _, m in page]
    features = [b.path.features() + H.text_features(b, k, len(blocks)) for k, b in enumerate(blocks)]

    def likelihood(weights, moves, starts):
        def score(labels):
            return (starts[labels[0]] + sum(weights[features[k]].sum() for k, l in enumerate(labels) if l)
                    + sum(moves[a, b] for a, b in zip(labels, labels[1:])))
        return score(y) - np.logaddexp.reduce([score(l) for l in itertools.product((0, 1), repeat=len(y))])

    zero, rate, eps = [np.zeros(H.DIMENSIONS), np.zeros((2, 2)), np.zeros(2)], H.RATE / (1 + 1 / 2000), 1e-5
    for part, got in ((1, model.moves), (2, model.starts)):
        for at in np.ndindex(got.shape):
            up = [x.copy() for x in zero]
            up[part][at] += eps
            assert got[at] / rate == pytest.approx((likelihood(*up) - likelihood(*zero)) / eps, abs=1e-3)
    for at in sorted({f for fs in features for f in fs})[:40]:
        up = [x.copy() for x in zero]
        up[0][at] += eps
        want = (likelihood(*up) - likelihood(*zero)) / eps
        assert model.weights[at] / rate == pytest.approx(want, rel=0.05, abs=5e-3)      # repeated features decay within the step


def test_equal_pages_and_clashing_columns(spark):
    from tabwise.llm.html_crf import extract_main_text

    html = "<nav><a href=/>Home</a></nav><article><p>" + "A sentence of the article, long enough to tell. " * 8 + "</p></article>"
    rows = [(k, "u", html, 1) for k in range(40)] + [(None, None, html, 1), (90, "u", None, 1), (91, "u", "", 1)]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert len(got) == 43
    assert {r["text"] for r in got if r["page_id"] not in (90, 91)} == {("A sentence of the article, long enough to tell. " * 8).strip()}
    assert all(r["text"] == "" and r["n_chars"] == 0 for r in got if r["page_id"] in (90, 91))
