"""Main text of pages as they are found on the web, with expected texts."""

from __future__ import annotations

import re
import time
from collections import Counter

import pytest

from proofmill.llm import html_text
from tests.conftest import DATA

LONG = "Many words of the article stand here and go on for a while. " * 4
TEXT = LONG.strip()


@pytest.mark.parametrize(
    "page",
    [
        '<body class="single has-sidebar"><article><p>{}</p></article></body>',
        '<html class="no-banner"><body id="nav"><main class="overlay"><p>{}</p></main></body></html>',
        '<article id="legal-news"><p>{}</p></article>',
        '<article><div style="overflow:hidden"><p>{}</p></div></article>',
        '<article><div class="overflow-hidden content-with-sidebar"><p>{}</p></div></article>',
        '<article><div data-hidden="1" title="hidden" aria-hidden="false" hidden="false"><p>{}</p></div></article>',
    ],
)
def test_names_that_are_about_something_else_keep_the_article(page):  # noqa: ANN001, ANN201
    assert html_text.main_text(page.format(LONG)) == TEXT


@pytest.mark.parametrize(
    "attrs",
    ["hidden", 'hidden=""', 'hidden="hidden"', 'aria-hidden="true"', "style='color:red; display : none'", 'class="site-footer"', 'class="x cookie-banner"', 'id="comments"', 'id="sidebar-left"', 'class="ad-2"', "role=navigation", 'class="related_posts widget"'],
)
def test_named_and_hidden_containers_go(attrs):  # noqa: ANN001, ANN201
    assert html_text.main_text(f"<article><p>{LONG}</p><div {attrs}><p>Other {LONG}</p></div></article>") == TEXT


def plain(*sizes: int) -> list[str]:
    return [" ".join(f"word{i}x{j}" for j in range(n)) for i, n in enumerate(sizes)]


LINKS = "".join(f"<p><a href=/{i}>Link number {i}</a></p>" for i in range(5))


@pytest.mark.parametrize("sizes", [(12, 18, 14, 25), (26, 20, 30), (35, 40, 22, 38, 15), (80, 16), (60, 31, 12)])
@pytest.mark.parametrize("before, after", [("", ""), ("<nav>%s</nav>", "<footer><p>%s</p></footer>"), ("%s", "%s")])
def test_short_paragraphs_of_a_page_without_an_article(sizes, before, after):  # noqa: ANN001, ANN201
    paragraphs = plain(*sizes)
    around = [x.replace("%s", LINKS) for x in (before, after)]
    page = f"<body>{around[0]}<div>{''.join(f'<p>{x}</p>' for x in paragraphs)}</div>{around[1]}</body>"
    assert html_text.main_text(page) == "\n\n".join(paragraphs)


def test_lists_and_headings_of_a_page_without_an_article():  # noqa: ANN201
    first, one, two, three, last = plain(30, 7, 8, 9, 20)
    page = f"<body>{LINKS}<h1>What this page tells</h1><p>{first}</p><ul><li>{one}<li>{two}<li>{three}</ul><h2>And some more</h2><p>{last}</p>{LINKS}</body>"
    assert html_text.main_text(page) == "\n\n".join(["What this page tells", first, one, two, three, "And some more", last])


def test_links_and_footers_around_long_text_go():  # noqa: ANN201
    long, notice = plain(70, 28)
    many = "<p>" + " ".join(f"<a href=/{i}>Read story {i} as well</a>" for i in range(9)) + "</p>"
    page = f"<body>{LINKS}{many}<p>{long}</p>{many}<h3>More of our stories today</h3>{many}{LINKS}<footer><p>{notice}</p></footer></body>"
    assert html_text.main_text(page) == long


def test_text_after_a_block_of_links_stays():  # noqa: ANN201
    many = "<p>" + " ".join(f"<a href=/{i}>Read story {i} as well</a>" for i in range(9)) + "</p>"
    one, two, item = plain(40, 35, 7)
    for tag in ("div", "article"):
        page = f"<body>{many}<{tag}><p>{one}</p><p>{two}</p><h2>Two words</h2><ul><li>{item}<li>{item}</ul><p>{two}</p></{tag}></body>"
        assert html_text.main_text(page) == "\n\n".join([one, two, "Two words", item, item, two])


def test_the_tree_asks_for_own_and_neighbours_link_density():  # noqa: ANN201
    def asked(node) -> set[int]:  # noqa: ANN001
        return set() if isinstance(node, bool) else {node[0]} | asked(node[2]) | asked(node[3])

    assert 1 in asked(html_text.tree()) and {3, 5} & asked(html_text.tree())


@pytest.mark.parametrize("piece", ["<a ", "<a \"", "<a '\" ", "<script ", "<!", "<!x \"", "</a ", "<b\"'>", "<a x=\"'>", "<p a='>", "</script ", "<textarea", "<?"])
@pytest.mark.parametrize("end", ["", ">", "\">"])
def test_time_grows_as_the_page(piece, end):  # noqa: ANN001, ANN201
    def took(n: int) -> float:
        began = time.perf_counter()
        html_text.main_text("<p>text of the page</p>" + piece * n + end)
        return time.perf_counter() - began

    assert took(2_500_000 // len(piece)) < 15


def test_pages_that_break_off():  # noqa: ANN201
    for rest in ("<!-- to the end", "<!-- to the end <b>x</b>", "<script>var x = 1; <p>no</p>", "<style>p {}"):
        assert html_text.main_text(f"<article><p>{LONG}</p>{rest}</article>") == TEXT
    assert html_text.main_text(f"<article><p>{LONG} 1 < 2 and <b") == f"{TEXT} 1 < 2 and <b"
    assert html_text.main_text(f"<article><p title=\"a>b\">{LONG}</p><p title='>{LONG}</p></article>").startswith(TEXT)


def test_links_around_blocks_stay_links():  # noqa: ANN201
    cards = "".join(f"<a href=/{i}><h3>Another story number {i}</h3><div>What it tells in a few words</div></a>" for i in range(4))
    assert html_text.main_text(f"<body><div><p>{LONG}</p><p>{LONG}</p></div>{cards}</body>") == f"{TEXT}\n\n{TEXT}"
    found = html_text.blocks(f"<div><p><a href=x>not closed</p><p>{LONG}</p><a id=here>named only<p>{LONG}</p></div>")
    assert [b[2] for b in found] == [1.0, 0.0, 0.0, 0.0]


def test_two_short_paragraphs():  # noqa: ANN201
    page = "<div><h1>Title here</h1><p>First short paragraph of the story.</p><p>Second short paragraph of it.</p></div>"
    assert html_text.main_text(page) == "Title here\n\nFirst short paragraph of the story.\n\nSecond short paragraph of it."


def test_the_measures_find_the_text_without_names_of_containers(spark):  # noqa: ANN001, ANN201
    """Without any class, id or role, and with div in place of telling tags, words and link density must do."""
    names = re.compile(r"""\s(?:class|id|role)=("[^"]*"|'[^']*'|[^\s>]+)""")
    telling = re.compile(r"(</?)(nav|footer|aside|form|header|article|main|menu|dialog)\b")
    for bare in (lambda x: names.sub("", x), lambda x: telling.sub(r"\1div", names.sub("", x))):
        same = found = wanted = 0
        for (page,) in spark.read.parquet(f"{DATA}/pages.parquet").select("html").collect():
            a, b = (Counter(html_text.main_text(x).split()) for x in (bare(page or ""), page))
            same, found, wanted = same + (a & b).total(), found + a.total(), wanted + b.total()
        assert same >= 0.93 * found and same >= 0.98 * wanted
