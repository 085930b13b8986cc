import itertools
import math
import random

import pytest

from tablewash.llm.page_model import N_FEATURES, PageModel, extract_pages, labelled_page, main_text, marginals, node_features, trained, training_page
from tablewash.llm.page_tree import Node, read


def test_marginals_against_all_labellings():
    pick = random.Random(3)
    for _ in range(30):
        n = pick.randint(1, 8)
        nodes = [Node("#root", -1)]
        for i in range(1, n):
            nodes.append(Node(pick.choice(["div", ""]), pick.randrange(i)))
        on = [tuple(pick.sample(range(N_FEATURES), 3)) for _ in nodes]
        model = PageModel(tuple(pick.uniform(-1, 1) for _ in range(N_FEATURES)), tuple(pick.uniform(-1, 1) for _ in range(8)))
        total, content, pairs = 0.0, [0.0] * n, [[0.0] * 4, [0.0] * 4]
        for y in itertools.product((0, 1), repeat=n):
            score = sum(model.weights[f] for own, v in zip(on, y, strict=True) if v for f in own)
            score += sum(model.edges[(0 if nodes[i].tag else 4) + 2 * y[nodes[i].parent] + y[i]] for i in range(1, n))
            p = math.exp(score)
            total += p
            for i in range(n):
                content[i] += p * y[i]
                if i:
                    pairs[0 if nodes[i].tag else 1][2 * y[nodes[i].parent] + y[i]] += p
        found: list[list[float]] = [[0.0] * 4, [0.0] * 4]
        assert marginals(nodes, on, model, found) == pytest.approx([c / total for c in content])
        for a, b in zip(found, pairs, strict=True):
            assert a == pytest.approx([x / total for x in b])


def test_held_out_pages():
    pick, model = random.Random(1234), trained()
    right = total = 0
    for _ in range(150):
        nodes, labels = labelled_page(training_page(pick))
        found = marginals(nodes, node_features(nodes), model)
        for node, label, p in zip(nodes, labels, found, strict=True):
            if node.text:
                total += 1
                right += (p >= 0.5) == label
    assert right > 0.97 * total


ARTICLE = "<article><h1>Title &amp; more</h1><p>First  <b>bold</b>\n text of it.</p><p>Second&nbsp;one, with a sentence.<p>Third &lt;p&gt; ends here.</article>"
WANTED = "Title & more\n\nFirst bold text of it.\n\nSecond one, with a sentence.\n\nThird <p> ends here."


def _page(inside):
    return (
        "<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var a='</p><p>no';</script></head><body>"
        "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><!-- <p>gone</p> -->"
        f"{inside}<footer>&copy; site &middot; All rights kept.</footer></body></html>"
    )


def test_texts():
    model = trained()
    boxes = {
        "": "",
        "ad": '<div class="ad">Buy the best things here now.</div>',
        "form": "<form><label>Your name</label><input><button>Send it</button></form>",
        "aside": "<aside><h3>Related</h3><ul><li><a href='#'>One more</a></li></ul></aside>",
        "comments": '<section class="comments"><h3>Comments</h3><div class="comment"><p>I do not agree with it at all.</p></div></section>',
        "notice": '<div class="cookie-notice"><p>We use cookies on this site.</p></div>',
    }
    for before, after in itertools.product(boxes.values(), repeat=2):
        assert main_text(_page(before + ARTICLE + after), model) == WANTED


def test_malformed_markup():
    assert [n.text for n in read("<p><b>one<br><p>two <a href='x>y'>l</a>&amp</p></div> tail < 3 <unclosed") if n.text] == ["one", "two l&", "tail < 3"]
    assert [n.text for n in read("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table>") if n.text] == list("abcdefg")
    assert [n.text for n in read("<script>x<p>y</script>z<!-- never closed <p>q") if n.text] == ["z"]
    deep = read("<div>" * 50_000 + "x" + "</div>" * 50_000)
    assert len(deep) == 50_002
    assert read("") == [Node("#root", -1)]
    for text in ("<", "<a", "<p class=\"", "</", "<!", "&#xD800;", "&#99999999;"):
        read(text)


def test_pages(spark):
    rows = [(1, "u", _page(ARTICLE), "t", 1), (1, "u", _page(ARTICLE), "t", 1), (None, None, None, None, 2), (3, "v", "", "t", 3), (4, "w", "<p>" + "long word. " * 60_000, "t", 4)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")
    out = sorted(extract_pages(pages, trained()).collect(), key=lambda r: r["page_id"] or 0)
    assert [(r["page_id"], r["url"]) for r in out] == [(None, None), (1, "u"), (1, "u"), (3, "v"), (4, "w")]
    assert [r["text"] for r in out[:4]] == ["", WANTED, WANTED, ""]
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert extract_pages(pages.limit(0), trained()).collect() == []
