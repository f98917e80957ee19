import itertools

import numpy as np
import pytest

from spendlens.llm import html_text as H


@pytest.fixture(scope="module")
def field():
    return H.learned()


def random_field(seed=0):
    rng = np.random.default_rng(seed)
    f = H.Field()
    f.own = {k: rng.normal(size=2) for k in "abcd"}
    f.pair = rng.normal(size=(2, 2))
    return f, [["a"], ["b", "c"], ["d"], ["a", "d"], ["c"]]


def total(f, page, labels):
    e = f.emissions(page)
    return sum(e[i, y] for i, y in enumerate(labels)) + sum(f.pair[a, b] for a, b in zip(labels, labels[1:]))


def test_viterbi_and_likelihood_against_all_labellings():
    for seed in range(5):
        f, page = random_field(seed)
        every = list(itertools.product((0, 1), repeat=len(page)))
        scores = [total(f, page, y) for y in every]
        assert f.decode(page) == list(every[int(np.argmax(scores))])
        labels = [1, 0, 0, 1, 1]
        got, own, pair = f.likelihood(page, labels)
        assert got == pytest.approx(total(f, page, labels) - np.logaddexp.reduce(scores))
        f.pair[0, 1] += 1e-6
        assert (f.likelihood(page, labels)[0] - got) / 1e-6 == pytest.approx(pair[0, 1], abs=1e-4)
        f.pair[0, 1] -= 1e-6
        f.own["b"][1] += 1e-6
        assert (f.likelihood(page, labels)[0] - got) / 1e-6 == pytest.approx(own[1, 1], abs=1e-4)


def test_held_out_accuracy(field):
    pages = H.examples(150, seed=77)
    found = [(field.decode([s for _, s in H.leaves(p)]), y) for p, y in pages]
    blocks = [a == b for d, y in found for a, b in zip(d, y)]
    assert all(len(d) == len(y) for d, y in found)
    assert np.mean(blocks) > 0.99 and np.mean([d == y for d, y in found]) > 0.93


@pytest.mark.parametrize(
    "html, want",
    [
        ("<article><p>One &amp; two&nbsp;x<br>three\n four</p><p>Five.</p></article>", "One & two x three four Five."),
        ("<nav><a href=x>Home</a></nav><article><h1>T</h1><p>Body <b>bold text.<p>Next one.</article><footer>&copy; me</footer>", "T Body bold text. Next one."),
        ("<article><p>Keep this.</p><script>var t='</p>'; x</script><style>p{}</style></article>", "Keep this."),
        ("<article><p>Good text here.</p></article><section id='comments'><h3>Comments</h3><p>Nice post, I agree.</p></section>", "Good text here."),
        ("<div class='cookie-notice'><p>We use cookies.</p></div><article><p>Body.</p></article><aside class=sidebar><p>See also.</p></aside>", "Body."),
        ("<form><label>Search</label><input></form><article><p>Body of it.</p></article>", "Body of it."),
        ("<article><p>Cut &lt;here&gt; é &#233;</p><p>Last</p></artic", "Cut <here> é é Last"),
        ("", ""),
        (None, ""),
    ],
)
def test_pages(field, html, want):
    assert H.main_text(html, field) == want


def test_dataframe_contract(spark, field):
    rows = [(1, "u", "<article><p>é x</p></article>", "old"), (1, "u", "<article><p>é x</p></article>", "old"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = H.extract(df, field)
    assert out.columns == ["page_id", "url", "html", "text", "n_chars"]
    assert sorted((r["text"], r["n_chars"]) for r in out.collect()) == [("", 0), ("é x", 3), ("é x", 3)]
    assert H.extract(df.limit(0), field).count() == 0
    long = "<article>" + "<p>word word word.</p>" * 20_000 + "</article>"
    assert len(H.main_text(long, field)) == 20_000 * 16 - 1
