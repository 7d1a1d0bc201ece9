import html
import re

from foliant.llm import htmltext
from foliant.llm.htmltext import main_text

PROSE = "The cat is on the mat and it is in the house of the dog. " * 6


def test_articles_of_the_table(spark, small_dir):
    pages = spark.read.parquet(f"{small_dir}/pages.parquet")
    got = {r.page_id: r for r in htmltext.extracted(pages).collect()}
    for page in pages.collect():
        body = page["html"][page["html"].index("<article>") + 9 :].partition("</article>")[0]
        body = re.sub(r"<(?:br|/?p|/?h1)>", " ", body)
        expected = " ".join(html.unescape(re.sub(r"<[^>]*>?", "", body)).split())
        assert got[page["page_id"]].text == expected
        assert got[page["page_id"]].n_chars == len(expected)


def test_parts_around_the_article_go():
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body><header><h2>Site</h2></header><nav><a href=x>Home</a></nav>
    <div class="cookie-notice">We use the cookies of the site and that is all there is to it, so you can go on.</div>
    <div id=main><h1>Title</h1><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p></div>
    <aside><p>{PROSE}</p></aside><form><label>Name of the user</label></form>
    <div class="comments"><p>{PROSE}</p></div><script>if (a < b) {{ x = "<p>{PROSE}</p>" }}</script><footer><p>{PROSE}</p></footer></body></html>"""
    assert main_text(page) == " ".join(f"Title {PROSE}Short. {PROSE}".split())


def test_blocks_of_links_are_bad():
    links = "".join(f"<a href={k}>the news of the day and more of it</a> " for k in range(20))
    assert main_text(f"<div>{links}</div><p>{PROSE}</p>") == PROSE.strip()


def test_markup_details():
    assert main_text(f"<p>{PROSE}a&amp;b &lt;x&gt; caf&eacute;<b>s</b>&nbsp;&#x41;</p>") == PROSE + "a&b <x> cafés A"
    assert main_text(f"<article><p>{PROSE}<p>One<br>two\n\t three</article>") == PROSE.strip() + " One two three"
    assert main_text(f"<article><p>{PROSE}<!-- gone --><p>cut off <a href=") == PROSE.strip() + " cut off"


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<"), (4, "u", "</p></div><p"), (None, "u", f"<p>{PROSE}"), (6, "u", "<div>" * 20000 + PROSE)]
    got = {r.page_id: r for r in htmltext.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 6 and got[1].text == "" and got[2].text == "" and got[4].n_chars == 0
    assert got[None].text == PROSE.strip()
    assert htmltext.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrappers_keep_their_article():
    text = f"<p>{PROSE}</p><p>{PROSE}</p>"
    for page in (
        f'<article class="post-42 post hentry tag-politics tag-social">{text}</article>',
        f'<div class="layout has-sidebar"><div>{text}</div></div>',
        f'<div class="site-main no-sidebar">{text}</div>',
        f'<div class="post tag-news tag-menu">{text}</div>',
        f'<body class="sidebar"><main class="widget">{text}</main></body>',
        f'<div class="modal"><section id="notice"><article>{text}</article></section></div>',
        f'<form action="page.aspx"><div><nav><a href=x>Home</a></nav>{text}</div><footer><p>{PROSE}</p></footer></form>',
        f'<div class="comments"><p>{PROSE * 5}</p></div><form><div>{text}</div></form>',
        f'<p>{PROSE * 5}</p><form><main>{text}</main></form>',
    ):
        assert f"{PROSE}{PROSE}".strip() in main_text(page), page
    # what the wrappers must not bring back
    for part in ("sidebar", "site-footer", "cookie-notice", "related-posts", "x widget-area"):
        assert main_text(f'<div class="{part}"><p>{PROSE}</p></div>{text}') == f"{PROSE}{PROSE}".strip(), part
    assert main_text(f"<form><p>{PROSE}</p></form>{text}") == f"{PROSE}{PROSE}".strip()
    assert main_text("<form>" * 5000 + f"<p>{PROSE}") == PROSE.strip()


def test_many_unmatched_tags_take_linear_time():
    """A megabyte of open elements and end tags without a beginning."""
    import time

    from foliant.llm.htmltext import blocks

    for page in ("<b>" * 150_000 + "</i>" * 150_000, "<a>" + "<b>" * 100_000 + "<p>x" * 100_000, "<div><p>one</div></div></span>two"):
        start = time.perf_counter()
        blocks(page)
        assert time.perf_counter() - start < 10


def test_comments_notices_and_sidebars_go():
    text, other = f"<p>{PROSE}</p><p>{PROSE}</p>", f"<p>A reader said that {PROSE}</p>"
    kept = f"{PROSE}{PROSE}".strip()
    for part in ("comment-content", "comment-text", "comment__body", "cookie-notice-text", "sidebar-left", "left-sidebar", "newsletter-signup-form"):
        assert main_text(f'{text}<div class="{part}">{other}</div>') == kept, part
    comments = "".join(f'<article class="comment"><div class="comment-content">{other}{other}</div></article>' for _ in range(3))
    assert main_text(f'<article>{text}</article><section class="comments">{comments}</section>') == kept
    assert main_text(f'<main><article>{text}<section class="comments">{comments}</section></article></main>') == kept
    assert main_text(f"<article>{text}</article>{comments}") == kept
    assert main_text(f'<article>{text}</article><div class="related"><article>{other}</article></div>') == kept
    # a page of nothing else keeps its article, and names in the middle or denied say nothing
    assert main_text(f'<section class="comments"><article>{text}</article></section>') == kept
    for name in ("no-comments", "has-sidebar", "the-comments-page", "post-header", "sidebar-left"):
        assert main_text(f'<div class="{name}">{text}</div>') == kept, name


def test_languages_without_known_stop_words():
    russian = (
        "В начале года город жил тихо, и никто не думал о том, что скоро всё изменится. Люди ходили на работу, дети шли в школу, а по"
        " вечерам все собирались у реки. Но однажды утром на площади появился человек, и он сказал, что в городе больше нет хлеба."
    )
    turkish = (
        "Bu sabah deniz çok sakindi ve balıkçılar erkenden yola çıktı. Bir çocuk iskelede durup onlara el salladı. Akşam olunca hava"
        " bozdu, rüzgar sertleşti ve tekneler birer birer limana döndü. Herkes evine gitti, sokaklar boş kaldı."
    )
    chinese = "今天早上天气很好，我们决定去山上走一走。路上遇到了很多人，大家都很高兴。" * 8
    for text in (russian, turkish, chinese):
        assert main_text(f"<div><nav><a href=x>A</a></nav><div><p>{text}</p><p>{text}</p></div></div>") == f"{text} {text}"
    # a long list of words is no prose
    words = " ".join(f"слово{chr(1072 + i % 30)}{chr(1072 + i // 30)}" for i in range(80))
    assert main_text(f"<div>{words}</div><p>{russian}</p>") == russian


def test_quotes_count_behind_an_equals_sign_alone():
    text = f"<p>{PROSE}</p>"
    assert main_text(f"<div><p data-x=Don't>{PROSE}</p><p>It isn't so. {PROSE}</p></div>") == f"{PROSE}It isn't so. {PROSE}".strip()
    assert main_text(f"<p title='a > b' data-y = \"x > y\">{PROSE}</p>") == PROSE.strip()
    assert main_text(f'{text}<p data-x="open>{PROSE}') == f"{PROSE}{PROSE}".strip()


def test_many_quotes_take_linear_time():
    import time

    for page in ("<p a=" + "='" * 300_000, "<p " + "a=\"" * 200_001 + "x", "<p a='" * 150_001, '<article class="comment">' * 20_000 + PROSE):
        start = time.perf_counter()
        main_text(page)
        assert time.perf_counter() - start < 10
