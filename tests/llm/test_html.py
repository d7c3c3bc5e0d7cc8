import pyarrow.parquet as pq
import re
from html import unescape

from emberline.llm.html import extract_main_text, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><div>Site name</div></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy now, it is a very long advert text that goes on and on and on for long.</div>
<article><h1>Head  line &amp; more</h1><p><b>Bold.<br><p>One
  two&nbsp;three.<div class="cookie-notice">We use cookies</div></p><p></p><p>a<i>b</i>c</p><section id="comments"><p>first!</p></section><aside>side</aside><form><p>mail</p></form></article>
<div class="sidebar">links</div><footer>&copy; me</footer></body></html>"""


def test_article():
    assert main_text(PAGE) == "Head line & more\nBold.\nOne two three.\nabc"


def test_without_article():
    text = "A sentence that is long enough to count as running text in a page, twice over. "
    page = f"<html><body><nav>menu</nav><div class='x'><h1>Title</h1><p>{text}</p><p>Short.</p><p>{text}</p></div><footer>foot</footer></body>"
    assert main_text(page) == f"Title\n{text.strip()}\nShort.\n{text.strip()}"


def test_article_tag_is_a_weight():
    text = "A sentence that is long enough to count as running text in a page, twice over, and more. "
    card = "<article class='teaser'><p>Read this card.</p></article>"
    for page in (f"<div><p>{text}</p><p>{text}</p></div>{card}", f"{card}<div><p>{text}</p><p>{text}</p></div>"):
        assert f"{text.strip()}\n{text.strip()}" in main_text(page)
    said = "<section id='comments'><article class='comment-body'><p>First!</p></article></section>"
    assert main_text(f"<div><p>{text}</p><p>{text}</p></div>{said}") == f"{text.strip()}\n{text.strip()}"
    assert main_text(f"<form><article><p>{text}</p></article></form>") == text.strip()
    # outside an article that outweighs it, short text is no part of it
    assert main_text(f"<div>Shop</div><article><p>{text}</p><p>Short.</p></article><div>Imprint</div>") == f"{text.strip()}\nShort."


def test_blocks_without_article_stay_whole():
    text = "A sentence that is long enough to count as running text in a page, twice over, and more."
    rows = "".join(f"<tr><td>a{i}</td></tr><tr><td><p>b{i}</p></td></tr>" for i in range(4))
    page = f"<div><div><h1>Title</h1></div><div class='share'>Like</div><div><p>{text}</p></div><div class='ad'>Buy</div><div><p>Short.</p></div><div><table>{rows}</table></div><div class='ad'>Buy</div><p>{text}</p><p><a href='x'>Linked words</a></p><div class='ad'>Buy</div><div><p>The end.</p></div></div>"
    cells = [f"{c}{i}" for i in range(4) for c in "ab"]
    assert main_text(page).split("\n") == ["Title", text, "Short.", *cells, text, "Linked words", "The end."]
    # a menu after the text and what follows it are no part of it
    menu = "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(5))
    assert main_text(f"<div><p>{text}</p></div><ul>{menu}</ul><p>Imprint</p>") == text


def test_class_words_name_whole_classes():
    """A word within a class counts only with words that carry it."""
    text = "A sentence that is long enough to count as running text in a page, twice over, and more."
    for kept in ("id='related-work'", "class='menu-board'", "class='share-price'", "class='comment-driven design'"):
        assert main_text(f"<article><p>{text}</p><section {kept}><p>Kept.</p></section></article>") == f"{text}\nKept."
    for gone in ("class='related-posts'", "class='x site-menu'", "id='comments'", "class='cookie-banner'", "class='ad-slot-1'", "class='share-buttons'"):
        page = f"<article><p>{text}</p></article><section {gone}><p>{text} Gone.</p></section>"
        assert "Gone" not in main_text(page)


def test_edges():
    assert [main_text(x) for x in (None, "", "   ", "<p>", "<nav>a</nav>", "a < b", "<article>x", "<p a='>'>y</p>", "plain")] == ["", "", "", "", "", "a < b", "x", "y", "plain"]
    assert main_text("<nav>a<article><p>b") == "b"
    assert main_text("<article>" + "<p>w</p>" * 20000) == "\n".join(["w"] * 20000)
    main_text('<a b="' * 3000)


def test_given_pages():
    """The given pages hold their article as h1 and p elements."""
    rows = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    for r in rows:
        inside = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>|<br>", inside)]
        assert main_text(r["html"]) == "\n".join(b for b in blocks if b)


def test_given_pages_without_article_tags():
    """Line blocks alone find the article on all but few pages."""
    rows = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    same = sum(main_text(re.sub(r"</?article[^>]*>", "", r["html"])) == main_text(r["html"]) for r in rows)
    assert same >= 0.9 * len(rows)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, PAGE, "x")], "page_id long, html string, _html string")
    assert [(r.page_id, r._html, r.text) for r in extract_main_text(df).collect()] == [(1, "x", main_text(PAGE))]


def test_frame(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None)], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.n_chars, r.text) for r in extract_main_text(df).collect())
    assert got == [(1, 41, main_text(PAGE))] * 2 + [(2, 0, "")] and len(main_text(PAGE)) == 41
    assert extract_main_text(df.limit(0)).count() == 0


STORY = "<p>" + "Long sentence of the story with many words in it. " * 6 + "</p>"


def test_an_element_is_named_by_its_last_word():
    liked = "<p>" + "I liked this a lot, thanks for writing it. " * 6 + "</p>"
    for name in ("user-comments", "reader-comments", "article_comments", "story-menu"):
        text = main_text(f"<body><div>{STORY}{STORY}</div><div class='{name}'>{liked}</div></body>")
        assert text.count("story") == 12 and "liked" not in text, name
    for name in ("layout with-footer", "no-comments", "has-menu", "commentary", "menus-of-the-world"):
        assert main_text(f"<body><div class='{name}'>{STORY}{STORY}</div></body>").count("story") == 12, name


def test_an_unclosed_element_ends_where_it_must():
    links = "<a href='/'>Home</a> <a href='/n'>News</a>"
    last = "<p>" + "All rights reserved by the owners of this page. " * 5 + "</p>"
    for page in (
        f"<body><nav>{links}{STORY}{STORY}</body>",
        f"<body><nav><ul><li>{links}</li></ul><h1>Title</h1>{STORY}{STORY}</body>",
        f"<body><section><div class='menu'>{links}</section><div>{STORY}{STORY}</div></body>",
        f"<body><div><aside><p>{links}</p></div><div>{STORY}{STORY}</div></body>",
        f"<body><div>{STORY}{STORY}</div><footer>{last}</body>",
        f"<body><nav>{links}{STORY}{STORY}<footer>{last}</body>",
    ):
        text = main_text(page)
        assert text.count("story") == 12, page
        assert "News" not in text and "rights" not in text, page
    assert main_text(f"<body><nav>{links}<p>{links}</p></nav>{STORY}{STORY}</body>").count("News") == 0
    assert main_text("<nav>" * 3000 + STORY).count("story") == 6


def test_a_comment_in_its_own_article_tag_is_dropped():
    """The body lies in a div; reader comments are article elements themselves."""
    body = "".join(f"<p>Sentence {i} of the body is long enough to stand on its own, as it says much.</p>" for i in range(4))
    comment = "<article class='comment-body'><p>I liked this text a lot and write more than eighty-six characters about it, as readers do.</p></article>"
    text = "\n".join(f"Sentence {i} of the body is long enough to stand on its own, as it says much." for i in range(4))
    for page in (f"<div>{body}</div>{comment}{comment}", f"<article>{body}{comment}</article>", f"<div>{body}</div><section>{comment}</section>"):
        assert main_text(f"<html><body>{page}</body></html>") == text
    # other names of an article are as before
    assert main_text(f"<html><body><article class='post comments-open has-comments'>{body}</article></body></html>") == text
