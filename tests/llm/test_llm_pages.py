"""Main text of hand-written pages: custom and inline wrappers, tables, text in div and br only, inline adverts, formulas."""

import pytest

from tintshelf.llm import extract

FOLDER = "/root/testdata/sf0.001"
SAMPLED = 1000  # all of the smallest table
S = [
    "The river rose again in the night, and by morning the lower road was gone.",
    "Nobody in the village had seen such water since the year of the long frost.",
    "We carried the books to the upper floor, one box after another, until noon.",
    "My sister counted them twice, because she did not trust my list at all.",
    "In the evening the baker brought bread, and his son told us about the bridge.",
    "It had held, he said, although two of the older pillars were badly cracked.",
]
P = "".join(f"<p>{s}</p>" for s in S)
WANT = "\n".join(S)
D = "".join(f"<div>{s}</div>" for s in S)
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact</a></li></ul></nav>'
MENU = '<div class="menu"><a href="/">Home</a> <a href="/b">News</a> <a href="/c">Shop</a></div>'
FOOT = "<footer><p>Copyright by the paper. All rights reserved.</p></footer>"
SIDE = '<aside class="sidebar"><h3>Related</h3><ul><li><a href="/1">Storm</a></li><li><a href="/2">Frost</a></li></ul></aside>'
TALK = '<section class="comments"><h3>Comments</h3><div class="comment"><p>Great story, thank you.</p></div><div class="comment"><p>I was there too.</p></div></section>'
COOKIE = '<div class="cookie-notice"><p>We use cookies. <a href="/p">More</a></p></div>'

PAGES = {
    "article": f"<body><article>{P}</article></body>",
    "custom element": f"<body><app-root><article>{P}</article></app-root></body>",
    "nested custom elements": f"<body><app-root><app-page><x-main>{P}</x-main></app-page></app-root></body>",
    "custom with menu": f"<body><app-root>{NAV}<article>{P}</article>{FOOT}</app-root></body>",
    "span around post": f'<body><span><div class="post">{P}</div></span></body>',
    "menu, font around article": f"<body>{NAV}<font><article>{P}</article></font></body>",
    "font around paragraphs": f'<body><font size="2">{P}</font></body>',
    "center and font": f"<body><center><font>{P}</font></center>{FOOT}</body>",
    "span around all": f"<body><span>{NAV}<main>{P}</main>{FOOT}</span></body>",
    "bold around article": f"<body><b><article>{P}</article></b>{TALK}</body>",
    "anchor around article": f"<body>{MENU}<a name='top'><article>{P}</article></a>{FOOT}</body>",
    "two inline wrappers": f"<body>{NAV}<span><font><div class='content'>{P}</div></font></span>{SIDE}</body>",
    "custom around parts": f"<body><site-header>{NAV}</site-header><site-body><article>{P}</article></site-body><site-footer>{FOOT}</site-footer></body>",
    "custom article tag": f"<body><header>{NAV}</header><news-article class='article'>{P}</news-article>{FOOT}</body>",
    "slots": f"<body><my-layout><div slot='main' class='main-content'>{P}</div><div slot='side'>{SIDE}</div></my-layout></body>",
    "table layout": f"<body><table><tr><td>{MENU}</td><td class='content'>{P}</td></tr></table></body>",
    "table in font": f"<body><font><table><tr><td>{P}</td></tr></table></font></body>",
    "nested tables": f"<body><table><tr><td><table><tr><td class='text'>{P}</td></tr></table></td></tr></table>{FOOT}</body>",
    "table body and menu row": f"<body><table><tbody><tr><td>{NAV}</td></tr><tr><td><div class='post'>{P}</div></td></tr></tbody></table></body>",
    "div only": f"<body><div class='content'>{D}</div></body>",
    "div only, wrapped": f"<body><div id='page'><div class='article-text'>{D}</div></div>{FOOT}</body>",
    "div in custom": f"<body><app-root><div class='post-body'>{D}</div></app-root></body>",
    "div and menu": f"<body>{MENU}<div class='entry-content'>{D}</div>{FOOT}</body>",
    "sections": f"<body><main><section>{P}</section></main>{FOOT}</body>",
    "cookie notice": f"<body>{COOKIE}<main><article>{P}</article></main></body>",
    "comments": f"<body><article>{P}</article>{TALK}{FOOT}</body>",
    "everything": f"<body><header>{NAV}</header><main><article>{P}</article></main>{SIDE}{TALK}{FOOT}{COOKIE}</body>",
    "form behind": f"<body><article>{P}</article><form class='newsletter'><p>Sign up for our letters</p><input><button>Go</button></form></body>",
    "script between": f"<body><article>{P}<script>var p='<p>no</p>'</script><style>p {{}}</style></article></body>",
    "noscript wrapper": f"<body><noscript><article>{P}</article></noscript></body>",
    "object wrapper": f"<body><object data='x.swf'><article>{P}</article></object></body>",
    "canvas wrapper": f"<body>{NAV}<canvas><article>{P}</article></canvas></body>",
    "no body tag": f"<article>{P}</article>{FOOT}",
    "unclosed": f"<body><app-root><article>{P.replace('</p>', '')}",
    "deep spans": f"<body>{'<span>' * 30}<div class='post'>{P}</div>{'</span>' * 30}</body>",
    "label and section": f"<body><label><section class='story-body'>{P}</section></label>{FOOT}</body>",
    "small around footer": f"<body><article>{P}</article><small>{FOOT}</small></body>",
    "inline around menu": f"<body><span>{MENU}</span><article>{P}</article></body>",
}
DIRECT = {
    "br only": ("<body><div class='content'>" + "<br><br>".join(S) + "</div></body>", " ".join(S)),
    "br only in font": ("<body><font><div class='text'>" + "<br>".join(S) + "</div></font></body>", " ".join(S)),
    "br in custom": ("<body><app-root><x-text class='article'>" + "<br>".join(S) + "</x-text></app-root></body>", " ".join(S)),
    "formula": (f"<body><article>{P}<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold, he wrote, and the sum is found at once.</p></article></body>", WANT + "\nLet x=2 hold, he wrote, and the sum is found at once."),
    "formula with source": (f"<body><article>{P}<p>Here <math><semantics><mi>y</mi><annotation encoding='t'>y_0</annotation></semantics></math> is free, as we have seen above.</p></article></body>", WANT + "\nHere y is free, as we have seen above."),
    "object text": (f"<body><article>{P}<p>A map, <object data='m'>of the lower valley</object>, lay open on the table.</p></article></body>", WANT + "\nA map, of the lower valley, lay open on the table."),
    "canvas text": (f"<body><article>{P}<p>It showed <canvas>a line that fell</canvas> from year to year, he said.</p></article></body>", WANT + "\nIt showed a line that fell from year to year, he said."),
    "emphasis": (f"<body><app-root><article>{P}<p>He <b>never</b> <span>came</span> <custom-x>back</custom-x> to the valley, as far as I know.</p></article></app-root></body>", WANT + "\nHe never came back to the valley, as far as I know."),
    "inline advert": (f"<body><article>{P}<p>The road was mended in the spring. <span class='advert'>Buy boots now at half the price!</span></p></article></body>", WANT + "\nThe road was mended in the spring."),
}


@pytest.fixture(scope="module")
def trees(spark):
    return extract.learn(spark.read.parquet(f"{FOLDER}/pages.parquet"))


@pytest.mark.parametrize("name", [*PAGES, *DIRECT])
def test_hand_written(trees, name):
    page, want = DIRECT[name] if name in DIRECT else (PAGES[name], WANT)
    assert extract.main_texts([f"<html>{page}</html>"], trees) == [want]


def test_sampled_pages_without_paragraphs(spark):
    """Pages whose text stands in div alone, in a partition of their own, and a table that has no other."""
    other = spark.createDataFrame([(10**6 + i, f"<html><body><div class='content'>{D}</div></body></html>") for i in range(3)], "page_id bigint, html string").coalesce(1)
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "html").union(other)
    got = {r.page_id: r.text for r in extract.extract_text(pages, extract.learn(pages, sample=SAMPLED)).collect()}
    assert all(got.values()) and all(got[10**6 + i] == WANT for i in range(3))
    # learned from six sentences alone, the trees may take one of them for something else, but find the article
    alone = {r.text for r in extract.extract_text(other, extract.learn(other)).collect()}
    assert all(len(set(t.split("\n")) & set(S)) >= 5 for t in alone)
