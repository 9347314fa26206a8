import random
from functools import lru_cache

from quillspark.llm import html_main as h


def test_regions():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
    <nav><ul><li>Menu</nav><!-- x > y --><div class="cookie-notice">We use cookies</div>
    <article class=post><header><h1>Head&amp;line</h1></header><p>One <b>bold</b>\n text&nbsp;here<p>Two<br>three <script>var a = "</p>";</script>
    <div class="adBox">Buy</div><form><input><label>Mail</label></form><aside>Side</aside>
    <a title="a > b" href=x>link</a><div id="comments"><p>Nice!</div></article><footer>&copy;</footer></body></html>"""
    assert h.lines(page) == (["Head&line", "One bold text here", "Two", "three", "link"], True)
    assert h.lines(None) == ([], False) and h.lines("plain  text < 3") == (["plain text < 3"], False)
    assert h.lines("<p>" * 50_000 + "x")[0] == ["x"] and h.lines("<" * 50_000 + "'\"")[0] != []


def test_longest_common_subsequence():
    rnd = random.Random(2)
    for _ in range(60):
        a, b = ([rnd.choice("abcdexy") for _ in range(rnd.randrange(0, 40))] for _ in range(2))

        @lru_cache(None)
        def best(i, j):
            if not i or not j:
                return 0
            return best(i - 1, j - 1) + 1 if a[i - 1] == b[j - 1] else max(best(i - 1, j), best(i, j - 1))

        got = h.common_lines(a, b)
        it = iter(b)
        assert len(got) == best(len(a), len(b)) and all(x in it for x in [a[i] for i in sorted(got)])


def test_differencing(spark):
    rows = []
    for host in ("a.example", "b.example"):
        for i in range(40):
            rows.append((len(rows), f"http://{host}/s{i % 4}/{i}", f"<body><div>Top of {host}</div><p>Story {host} {i}</p><p>More {i}.</p><div>End of {host}</div></body>"))
    rows += [(900, None, None), (901, "http://solo.example/", "<p>Alone</p>"), (902, "http://copy.example/1", "<p>Copy</p>"), (903, "http://copy.example/2", "<p>Copy</p>"), (904, "http://[bad", "")]
    df = spark.createDataFrame([(*r, "k", "t") for r in rows], "page_id long, url string, html string, host string, text string").repartition(3)
    got = {r.page_id: r for r in h.main_text(df).collect()}
    assert len(got) == len(rows)
    for i, url, _ in rows[:80]:
        host, n = url.split("/")[2], url.split("/")[-1]
        assert got[i].text == f"Story {host} {n} More {n}." and got[i].url == url and got[i].n_chars == len(got[i].text)
    assert [got[i].text for i in range(900, 905)] == ["", "Alone", "Copy", "Copy", ""]
    assert h.main_text(df.limit(0)).collect() == []


def body(*texts):
    return "<body>" + "".join(f"<div>{t}</div>" for t in texts) + "</body>"


def test_near_copies_stay(spark):
    story = [f"Sentence {i} of a story that was put up more than once." for i in range(6)]
    top, end = "Top of the site", "End of the site"
    rows = [(i, f"http://a.example/copy/{i}", body(top, *story, f"Printed on day {i}", end)) for i in range(4)]
    rows += [(10 + i, f"http://a.example/other/{i}", body(top, *(f"Page {i}, line {j}, has words of its own." for j in range(5)), end)) for i in range(30)]
    rows += [(90 + i, f"http://pair.example/{i}", body(*story, f"Printed on day {i}")) for i in range(2)]
    rows += [(100 + i, f"http://many.example/{i:02}", body(*story, f"Printed on day {i}")) for i in range(30)]
    got = {r.page_id: r.text for r in h.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert len(got) == len(rows)
    for first, n in ((0, 4), (90, 2), (100, 30)):
        assert [got[first + i] for i in range(n)] == [" ".join([*story, f"Printed on day {i}"]) for i in range(n)]
    assert all(got[10 + i] == " ".join(f"Page {i}, line {j}, has words of its own." for j in range(5)) for i in range(30))


def test_differencing_inside_articles(spark):
    page = lambda lines: "<body><nav>Menu</nav><article>" + "".join(f"<p>{x}</p>" for x in lines) + "</article></body>"
    own = lambda i: [f"Paragraph {j} of story {i}, which no other page has." for j in range(4)]
    rows = [(i, f"http://a.example/{i:02}", page(["By the staff of this site", *own(i), "Texts are free to share."])) for i in range(20)]
    rows += [(50 + i, f"http://copy.example/{i}", page(own(99))) for i in range(3)]
    got = {r.page_id: r.text for r in h.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert [got[i] for i in range(20)] == [" ".join(own(i)) for i in range(20)]
    assert [got[50 + i] for i in range(3)] == [" ".join(own(99))] * 3


def test_marks_drop_no_article():
    body = "".join(f"<p>Paragraph {i} of the story.</p>" for i in range(3))
    text = [f"Paragraph {i} of the story." for i in range(3)]
    assert h.lines(f"<main><h1>The <b>title</b></h1><article>{body}</article></main>") == (["The title", *text], True)
    assert h.lines(f"<main>{body}<article>A teaser</article></main>") == ([*text, "A teaser"], True)
    assert h.lines(f"<div class='content'>{body}</div><article>A teaser</article><p>Else</p>")[0] == [*text, "A teaser"]
    assert h.lines(f"{body}<article>A teaser</article>")[0] == [*text, "A teaser"]
    assert h.lines(f"<div class='post-meta'>By somebody</div>{body}")[0] == ["By somebody", *text]
    assert h.lines(f"<p>Else</p><div class='entry-content wide'>{body}</div>")[0] == text
    for name in ("has-sidebar", "hasSidebar", "no-ads", "widget", "page-header"):
        assert h.lines(f"<p>Else</p><div class='{name}'><p>Side</p><article>{body}</article></div>")[0] == text, name
        assert h.lines(f"<p>Else</p><div id='{name}'><main>{body}</main></div>")[0] == text, name
    assert h.lines(f"<div class='ads'>Buy<article>{body}</article></div>")[0] == text
    assert h.lines(f"<article>{body}</article><div class='comments'><article>Nice!</article></div>") == (text, True)
    assert h.lines(f"<article>{body}</article><nav><article>Menu</article></nav><div class='sidebar'>Side</div>") == (text, True)


def test_whole_query_against_brute_force(spark, tmp_path):
    """Sites with a line at the start and one at the end of each article, copies and near copies; plain pages without."""
    rnd = random.Random(5)
    rows, told = [], {}
    for host in ("a.org", "b.org", "c.org"):
        for n in range(40):
            own = [f"{host} page {n} line {k} {rnd.random()}" for k in range(rnd.randrange(2, 6))]
            site = [f"{host} says", *own, f"all about {host}"] if host != "c.org" else own
            tag = "article" if n % 2 else "div"
            rows.append((len(rows), f"http://{host}/{n % 3}/p{n:02}", f"<html><body><nav>menu</nav><{tag}>" + "".join(f"<p>{x}</p>" for x in site) + f"</{tag}></body></html>"))
            told[rows[-1][0]] = (own, site)
        copy = rows[-1]
        for c in range(2):
            rows.append((len(rows), copy[1] + f"copy{c}", copy[2].replace("</nav>", "</nav>" + "<p>dated</p>" * (copy[2].count("article") == 0)) if c else copy[2]))
            told[rows[-1][0]] = told[copy[0]]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.text for r in h.query(spark, str(tmp_path)).collect()}
    changed = 0
    for i, (own, site) in told.items():
        text = got[i].removeprefix("dated ")
        assert text == " ".join(own), (i, rows[i][1])
        changed += own != site
    assert len(got) == len(rows) and changed == 84


def test_nothing_of_a_main_element_is_lost():
    text = lambda src: " ".join(h.lines(src)[0])
    assert text("<main><h1>Head</h1><article>Body of it</article><p>tail</p></main>").startswith("Head Body of it")
    assert "Real body, longer than any teaser" in text("<article>Teaser</article><main>Real body, longer than any teaser</main>")
    assert "cell" in text("<article><p>Words.</p><table class='search-results'><tr><td>cell</td></tr></table></article>")
