"""Main text of pages without an article element, under misleading names, and broken at length."""

import random
import time

import pytest

from hyperloom.llm import html

BODY = "<p>" + "word and text here " * 30 + "</p>"
TEXT = " ".join(("word and text here " * 30).split())
AROUND = (
    "<html><body><header><h1>Site</h1></header><nav>Menu</nav><div class='cookie-notice'>We use cookies</div>{}"
    "<div class='comments'><p>" + "Nice post indeed " * 60 + "</p></div><div class=sidebar>" + "side things " * 20 + "</div><footer>foot</footer></body></html>"
)


@pytest.mark.parametrize(
    "inner",
    [
        "<div class='page with-sidebar'><article>{}</article></div>",
        "<div class='layout with-sidebar'><article>{}</article></div>",
        "<div class='post has-banner'>{}</div>",
        "<div class='entry comments-open'>{}</div>",
        "<div class='page no-header'><div>{}</div></div>",
        "<div class='alert-story'>{}</div>",
        "<div class='login-free story'>{}</div>",
        "<div class='main-content related-articles'>{}</div>",
        "<main><section class='notice'>{}</section></main>",
        "<form><article>{}</article></form>",
        "<form action='/x'><div class=x>{}</div></form>",
    ],
)
def test_names_of_wrappers_lose_no_article(inner):
    assert html.Page(AROUND.format(inner.format(BODY))).text(None) == TEXT


def test_split_bodies_and_titles_stay():
    page = AROUND.format(f"<main><h1>Title</h1><section class=intro><p>{'intro text ' * 6}</p></section><section class=body>{BODY}</section></main>")
    assert html.Page(page).text(None) == f"Title {' '.join(['intro text'] * 6)} {TEXT}"


def test_no_article_gives_no_text():
    assert html.Page("<body><nav>Menu</nav><div class='ad'>Buy this</div><article></article><footer>foot</footer></body>").text(None) == ""
    assert html.Page(AROUND.format("<article></article>")).text(None) == ""


def pages(seed, hosts=12, each=8):
    """Pages of hosts with templates of their own, none with an article element: (url, html, text)."""
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(n))
    for h in range(hosts):
        wrap = [rng.choice(["page", "wrap has-sidebar", "layout no-header", "site alert-open"]) for _ in range(rng.randrange(1, 4))]
        tag, name = rng.choice(["div", "section", "main"]), rng.choice(["post-{}", "story", "entry body-{}", "text"])
        side = rng.choice(["sidebar", "related-links", "newsletter", "share-bar"])
        for k in range(each):
            parts = [say(rng.randrange(3, 8))] + [say(rng.randrange(10, 200)) for _ in range(rng.randrange(1, 9))]
            body = f"<h1>{parts[0]}</h1>" + "".join(f"<p>{p}{rng.choice(['</p>', ''])}" for p in parts[1:])
            inner = f"<{tag} class='{name.format(k)}'>{body}<div class='{side}'><p>{say(20)}</p></div></{tag}><div class='comments'><p>{say(300)}</p></div>"
            inner = f"<nav><a href='/'>{say(5)}</a></nav><aside>{say(40)}</aside>{inner}<div class='{side}'>{say(15)}</div>"
            for w in wrap:
                inner = f"<div class='{w}'>{inner}</div>"
            yield f"http://h{h}.org/{k}", f"<html><body><header>{say(4)}</header>{inner}<footer>{say(9)}</footer></body></html>", " ".join(parts)


def test_consensus_finds_bodies_without_article_elements(spark):
    want = [(i, *x) for i, x in enumerate(pages(5))]
    df = spark.createDataFrame([w[:3] for w in want], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert got == {w[0]: w[3] for w in want}


@pytest.mark.parametrize(
    "page",
    ['<p "' * 250000, "<a b='" * 160000, "<span>" * 100000 + "</i>" * 100000, "<i><p>" + "<span>" * 100000 + "</i>" * 100000, '<p a="x>"' * 100000 + "'", "<" * 1000000, "<!--" * 200000, "<p '\"<q>" * 100000, "<div>" * 100000],
)
def test_broken_pages_take_linear_time(page):
    began = time.process_time()
    html.Page(page).text(None)
    assert time.process_time() - began < 8


def test_numbers_of_thousands_of_digits():
    assert html.Page("<p>a &#" + "9" * 100000 + "; b&amp;c").text(None) == "a � b&c"
