"""Main text: block rules, known noise, and what the site's tree removes."""

import html
import random
import re

from panelgate.llm import site_style as ss

SCHEMA = "page_id long, url string, html string"


def texts_of(source):
    return [t for _, t in ss.Page(source).content()]


def test_blocks_and_noise():
    source = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body>
    <header>H</header><div id="content"><h1>T</h1><p>One <b>two<p>three&nbsp;&lt;x&gt; &eacute;
    <ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table><div class="userComments"><p>no</p></div>
    <form>q<input value="a>b"></form><!-- x --><script>if(a<b){"</p>"}</script><p hidden>z</p>tail</div>
    <aside>s</aside><div class=cookie-notice>c</div><div role="navigation">n</div>
    <header class="entry-header">x</header></body>"""
    assert texts_of(source) == ["T", "One two", "three <x> é", "a", "b", "1 2", "3", "tail"]


def test_articles_win_over_the_rest():
    source = "<p>a</p><article><p>q<br>r<div class='ad'>x</div></article><article>s &amp &am</article><p>z"
    assert texts_of(source) == ["q r", "s & &am"]


def test_broken_markup():
    assert texts_of("plain < text & more") == ["plain < text & more"]
    assert texts_of("") == []
    assert texts_of("<p>a</div></p>b<script>never closed") == ["a", "b"]
    assert texts_of("<p title='open>a</p><p>b") in (["a", "b"], ["b"], [])
    assert texts_of("<div>" * 3000 + "deep") == ["deep"]
    assert texts_of("<article>" + "<p>x " * 2000) == ["x"] * 2000


def page(title, paragraphs, rng):
    body = "".join(f"<p>{html.escape(p)}</p>" for p in paragraphs)
    return (f"<html><head><title>{title}</title></head><body><nav><ul><li>{rng.random()}</li></ul></nav>"
            f"<div class=\"ad\">{rng.random()}</div><article><h1>{title}</h1>{body}</article>"
            f"<footer>f {rng.random()}</footer></body></html>")


def test_articles_of_a_site_stay_whole(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for i in range(60):
        paragraphs = [f"paragraph {i} {k} & more" for k in range(rng.randint(1, 4))]
        if i % 4 == 0:
            paragraphs[0] = "a passage that many pages share"
        rows.append((i, f"http://host.example/{i}", page(f"title {i}", paragraphs, rng)))
        want[i] = "\n\n".join([f"title {i}", *paragraphs])
    rows += [(100, "http://host.example/x", rows[5][2]), (101, None, None), (102, "http://b/", "")]
    want |= {100: want[5], 101: "", 102: ""}
    found = ss.main_texts(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {r.page_id: r.text for r in found} == want
    assert all(r.n_chars == len(r.text) for r in found)


def test_site_wide_branches_go(spark):
    rows = []
    for i in range(40):
        more = f"<p>more {i * 7}</p>" * (i % 3)
        rows.append((i, f"http://h/{i}", f"<body><div class=x><p>Home</p><p>About us</p></div><div class=y>"
                     f"<p>Text {i}</p>{more}</div><div class=z><p>All of it is ours</p></div></body>"))
    rows.append((99, "http://alone/", rows[0][2]))
    found = {r.page_id: r.text for r in ss.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(40):
        assert found[i].split("\n\n") == [f"Text {i}"] + [f"more {i * 7}"] * (i % 3)
    assert found[99].startswith("Home")


def test_line_on_every_article_goes(spark):
    rows = [(i, f"http://h/{i}", f"<article><p>Read this in our app</p><p>Own {i}</p></article>") for i in range(30)]
    rows += [(i, f"http://g/{i}", f"<article><p>Shared</p><p>Own {i}</p></article>") for i in range(50, 55)]
    found = {r.page_id: r.text for r in ss.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[3] == "Own 3" and found[52] == "Shared\n\nOwn 52"


def test_quotation_of_two_pages_stays(spark):
    rows = []
    for i in range(40):
        last = "a quotation" if i in (3, 8) else f"fourth {i}"
        own = "".join(f"<p>{n} {i}</p>" for n in ("first", "second", "third"))
        rows.append((i, f"http://h/{i}", f"<body><div class=y>{own}<p>{last}</p></div></body>"))
    found = {r.page_id: r.text for r in ss.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[3] == "first 3\n\nsecond 3\n\nthird 3\n\na quotation"
    assert found[8].endswith("a quotation") and found[5].endswith("fourth 5")


def test_importance_decides_inside_and_outside_articles(spark):
    rows = []
    for i in range(60):
        body = "".join(f"<p>body {i} {k} of the page</p>" for k in range(2))
        # Templates: teaser cards beside the text, a note inside the article, and neither.
        page = [f"<div class=t>{body}</div><article>teaser {i}</article><div class=u><p>Our site</p></div>",
                f"<article><section><p>Open in our app</p>{body}</section></article>",
                f"<article>{body}</article>"][i % 3]
        rows.append((i, f"http://h/{i}", f"<body>{page}</body>"))
    rows.append((99, "http://alone/", rows[0][2]))
    found = {r.page_id: r.text for r in ss.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(60):
        want = [f"body {i} {k} of the page" for k in range(2)] + [f"teaser {i}"] * (i % 3 == 0)
        assert found[i].split("\n\n") == want
    assert found[99].startswith("body 0 0")


def test_small_hosts_are_judged(spark):
    rows = []
    for n in (2, 6, 8, 19):
        for i in range(n):
            rows.append((100 * n + i, f"http://h{n}/{i}", f"<body><div class=x><p>Our site</p></div>"
                         f"<article><p>Open in our app</p><p>Text {i}</p></article></body>"))
    found = {r.page_id: r.text for r in ss.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[200] == "Our site\n\nOpen in our app\n\nText 0"
    assert found[601] == "Open in our app\n\nText 1"
    assert found[803] == "Text 3" and found[1918] == "Text 18"


def test_odd_tables(spark):
    rows = [(1, "http://a/", "<p>x"), (1, "http://a/", "<p>x"), (None, None, "<p>y")]
    found = sorted(r.text for r in ss.main_texts(spark.createDataFrame(rows, SCHEMA)).collect())
    assert found == ["x", "x", "y"]
    assert ss.main_texts(spark.createDataFrame([], SCHEMA)).collect() == []
    assert re.fullmatch("[a-z.]+", ss.host_of("https://u@Ex.Ample.org:80/p"))


def test_names_that_only_mention_a_word_remove_nothing():
    for opened, closed in (
        ('<div class="content has-sidebar">', "</div>"), ('<div class="page no-header">', "</div>"),
        ('<section id="related-work">', "</section>"), ('<p class="share-price">', "</p>"),
        ('<div class="search-results-page">', "</div>"),
    ):
        assert texts_of(f"<p>First text</p>{opened}Whole article{closed}") == ["First text", "Whole article"]
    for name in ("ad", "comment-list", "userComments", "cookie-notice", "col sidebar-left", "site-footer"):
        assert texts_of(f'<p>First text, long enough</p><div class="{name}">gone</div>') == ["First text, long enough"]


def test_inline_noise_ends_at_its_own_end_tag():
    source = '<p>Hello <span class="share"><span>Icon</span> Tweet this</span> world</p>'
    assert texts_of(source) == ["Hello world"]
    assert texts_of("<p>a <button><b>x<i>y</b></button> b</p>") == ["a b"]


def test_a_name_cannot_take_the_larger_part_of_a_page():
    assert texts_of('<p>Home</p><div class="widget"><p>All of the text stands here</p></div>') == [
        "Home", "All of the text stands here"]


def test_importance_takes_doubts_in(spark):
    rows = []
    for i in range(40):
        rows.append((i, f"http://h/{i}", "<body><div class=x><p>Own text of the page, long "
                     f"enough, {i}</p></div><div class=ad><p>buy {i}</p></div>"
                     "<div class='box share-price'><p>Price</p></div>"
                     f"<div class='related-work'><p>work {i}</p></div></body>"))
    found = {r.page_id: r.text for r in ss.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[7] == "Own text of the page, long enough, 7\n\nwork 7"


def plain_low_blocks(sources):
    """Low blocks of every page of one host, importance by its definition on all pages."""
    import math

    pages = [ss.Page(s) for s in sources]

    def keyed(page):
        keys = {0: ()}
        style = [tuple(page.elements[c][1] for c in e[2]) for e in page.elements]
        for i, (_, _, children) in enumerate(page.elements):
            for nth, child in enumerate(children):
                keys[child] = (*keys[i], style[i], nth)
        return keys, style

    merged, texts, own = {}, {}, []
    for page in pages:
        keys, style = keyed(page)
        texts_here, nth, needed = {}, {}, set()
        for number, (owner, text) in enumerate(page.blocks):
            nth[owner] = nth.get(owner, -1) + 1
            place = (keys[owner], style[owner], nth[owner])
            texts_here[number] = place
            texts.setdefault(place, []).append(text)
            while owner >= 0:
                needed.add(owner)
                owner = page.elements[owner][0]
        for i in needed:
            merged.setdefault(keys[i], []).append(style[i])
        own.append((keys, texts_here, needed, nth))
    out = []
    for page, (keys, places, needed, nth) in zip(pages, own):
        def shrunk(n, value, inside, doubt):
            more = 0 if doubt == ss.NAMED else ss.KEEP + (ss.ARTICLE_KEEP * len(pages) if inside else 0)
            return (n * value + more) / (n * (1 + ss.DOUBT[doubt]) + more)

        def text_value(number):
            all_here = texts[places[number]]
            same = all_here.count(page.blocks[number][1])
            if len(all_here) < 2 or same < 2:
                return 1.0
            inside = page.within[number] is not None
            return shrunk(len(all_here), 1 - math.log(same) / math.log(len(all_here)), inside, 0)

        def inside_article(i):
            while i >= 0:
                if i in page.articles:
                    return True
                i = page.elements[i][0]
            return False

        value = {}
        for i in sorted(needed, reverse=True):
            styles = merged[keys[i]]
            n = len(styles)
            children = [text_value(k) for k, (o, _) in enumerate(page.blocks) if o == i]
            children += [value[c] for c in page.elements[i][2] if c in needed and page.doubts.get(c) != ss.NAMED]
            mean = sum(children) / len(children) if children else 1.0
            counts = [styles.count(s) for s in set(styles)]
            entropy = 1 - sum(c * math.log(c) for c in counts) / (n * math.log(n)) if n > 1 else 1.0
            share = ss.DAMPING ** len(counts)
            value[i] = shrunk(n, (1 - share) * entropy + share * mean, inside_article(i), page.doubts.get(i, 0)) if n > 1 else 1.0
        low = set()
        for number, (owner, _) in enumerate(page.blocks):
            gone = text_value(number) < ss.LOW
            while owner > 0:
                gone = gone or value[owner] < ss.LOW
                owner = page.elements[owner][0]
            if gone:
                low.add(number)
        out.append([t for _, t in page.without(low)])
    return out


def test_importance_equals_its_definition(spark):
    rng = random.Random(12)
    pool = ["Home", "About us", "Our price", "Terms"]
    for trial in range(3):
        sources = []
        for i in range(25):
            parts = []
            for _ in range(rng.randint(1, 4)):
                name = rng.choice(["a", "b", "share-price", "ad", "c"])
                inner = "".join(
                    f"<p>{rng.choice(pool) if rng.random() < 0.5 else f'own {i} {rng.random()}'}</p>"
                    for _ in range(rng.randint(1, 3)))
                parts.append(f"<div class='{name}'>{inner}</div>")
            sources.append(f"<body>{''.join(parts)}</body>")
        rows = [(i, f"http://h{trial}/{i}", s) for i, s in enumerate(sources)]
        found = {r.page_id: r.text for r in ss.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
        for i, blocks in enumerate(plain_low_blocks(sources)):
            assert found[i] == "\n\n".join(blocks), (trial, i)


def test_extra_columns_and_long_pages(spark):
    extra = "key int, low int, node int, value int, of int, of_key int, place int, text int, n_chars int"
    long_page = "<p>" + "word " * 200_000 + "</p>"
    rows = [(1, "http://a/", "<p>x", *[1] * 9), (2, "http://a/", long_page, *[2] * 9)]
    found = {r.page_id: r.n_chars for r in ss.main_texts(spark.createDataFrame(rows, f"{SCHEMA}, {extra}")).collect()}
    assert found == {1: 1, 2: 5 * 200_000 - 1}
