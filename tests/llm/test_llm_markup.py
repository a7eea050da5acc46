"""Pages are read on behind odd declarations and self-closed drawings and formulas."""

import random

import pytest

from tintshelf.llm import dom


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>a</p><![x]><p>b</p>", ["a", "b"]),
        ("<p>in 1990 <![1]> he</p><p>b</p>", ["in 1990 he", "b"]),
        ("<p>a <![endif]--> b</p><p>c</p><p>d ]> e</p>", ["a b", "c", "d ]> e"]),
        ("<p>a</p><![if !IE]><p>b</p><![endif]><p>c</p>", ["a", "b", "c"]),
        ("<p>a</p><![CDATA[x]]><p>b</p><![CDATA[y", ["a", "b", "<![CDATA[y"]),
        ("<!DOCTYPE html><!-- x > y --><p>a</p><!ELEMENT z><p>b</p>", ["a", "b"]),
        ('<article><svg class="icon"/><p>a</p><p>b</p></article>', ["a", "b"]),
        ("<article><math/><p>a</p></article>", ["a"]),
        ('<article><svg><g/><path d="M0"/><title/></svg><p>a</p></article>', ["a"]),
        ("<svg><style><![CDATA[a > b]]></style><![CDATA[a > <p>]]></svg><p>b</p>", ["b"]),
        ("<div/><p>a</p><svg><foreignObject><div/>x</div></foreignObject></svg><p>b</p>", ["a", "b"]),
    ],
)
def test_text_behind_odd_markup(html, want):
    root = dom.parse(html)
    assert dom.block_texts(root, {id(n) for n in dom.nodes(root)}) == want


def test_any_markup_is_read_to_its_end():
    r = random.Random(1)
    bits = ["<![", "<!", "]>", "]]>", "-->", "<!--", "<svg/>", "<svg>", "</svg>", "<math/>", "<p>", "</p>", "<?x", ">", "<", "&#", "&am", "if", "CDATA[", "t ", "<b/>", "'", '"', "<script>", "</script>", "<a b="]
    for _ in range(3000):
        dom.parse("".join(r.choice(bits) for _ in range(r.randrange(20))))
