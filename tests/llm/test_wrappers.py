import random
from functools import cache

import duckdb

from tallyforge.llm import wrappers


def page(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, text int, host string, skeleton string")


def texts(spark, rows):
    return {(r.page_id, r.url): r.text for r in wrappers.extract(page(spark, [(*r, 1, "x", "y") for r in rows])).collect()}


def plain_matching(a, b):
    (na, ka), (nb, kb) = wrappers.read_skeleton(a), wrappers.read_skeleton(b)

    @cache
    def most(x, y):
        if na[x] != nb[y]:
            return 0

        @cache
        def over(i, j):
            if i == len(ka[x]) or j == len(kb[y]):
                return 0
            return max(over(i + 1, j), over(i, j + 1), over(i + 1, j + 1) + most(ka[x][i], kb[y][j]))

        return 1 + over(0, 0)

    return most(0, 0)


def test_tree_matching_finds_the_most_nodes():
    rng = random.Random(2)

    def tree(depth):
        name = rng.choice("abc")
        inner = [tree(depth - 1) for _ in range(rng.randint(0, 4))] if depth else []
        return f"{name}({','.join(inner)})" if inner else name

    for _ in range(150):
        a, b = f"r({tree(3)},{tree(2)})", f"r({tree(3)},{tree(2)})"
        matched = wrappers.tree_matching(a, b)
        assert len(matched) == plain_matching(a, b)
        (na, ka), (nb, kb) = wrappers.read_skeleton(a), wrappers.read_skeleton(b)
        assert all(na[x] == nb[y] for x, y in matched.items()) and len(set(matched.values())) == len(matched)
        parent_a = {c: p for p, cs in enumerate(ka) for c in cs}
        parent_b = {c: p for p, cs in enumerate(kb) for c in cs}
        assert all(x == 0 or matched[parent_a[x]] == parent_b[y] for x, y in matched.items())


def test_plain_divs_are_told_apart_by_what_varies(spark):
    rows = []
    for i in range(12):
        related = "<div><a href=x>link %d here</a> <a href=y>and %d</a></div>" % (i, i) if i % 3 else ""
        rows.append((i, f"http://h.example/{i}", f"<html><body><div>Site name</div>{related}<div><p>Story number {i} &amp; more<p>Second\n\n part {i * 7}</div>"
                                                 "<div>All about us</div></body></html>"))
    got = texts(spark, rows)
    assert got == {(i, f"http://h.example/{i}"): f"Story number {i} & more\nSecond part {i * 7}" for i in range(12)}


ARTICLE = "<article><header><h1>Head {i}</h1></header><p>One <b>bold<p>two &lt;x&gt; {i}<br>three<ul><li>a{i}<li>b</ul><section class='comments'><p>me {i}</section></article>"
WHOLE = ("<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><body class='has-sidebar'><header>Top {i}</header>"
         "<nav><ul><li><a>m{i}</a></ul></nav><!-- <p>no --><div class='cookie-notice'>ok {i}?</div>" + ARTICLE +
         "<aside>side {i}</aside><form><p>name {i}</form><div id='ad-1'>buy {i}</div><footer>&copy; {i}</footer></body></html>")


def test_declared_roles(spark):
    rows = [(i, f"https://x.example/{i}", WHOLE.format(i=i)) for i in range(5)]
    assert texts(spark, rows) == {(i, f"https://x.example/{i}"): f"Head {i}\nOne bold\ntwo <x> {i} three\na{i}\nb" for i in range(5)}


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "not a url", ""), (3, "http://z.example/", "just text &eacute; &#x41;"), (None, "http://z.example/q", "<p>broken <a href='x>y</p> end"),
            (4, "http://deep.example/", "<div>" * 3000 + "down" + "</div>" * 3000), (5, "http://s.example/", "<p>seen<script>never closed <p>unseen"),
            (6, "http://long.example/", "<p>" + "word " * 200_000), (7, "http://c.example/", "<article><p>same</article>"), (8, "http://c.example/2", "<article><p>same</article>")]
    got = texts(spark, rows)
    assert len(got) == len(rows) and got[1, None] == got[2, "not a url"] == ""
    assert got[3, "http://z.example/"] == "just text é A" and "end" in got[None, "http://z.example/q"]
    assert got[4, "http://deep.example/"] == "down" and got[5, "http://s.example/"] == "seen"
    assert len(got[6, "http://long.example/"]) == 999_999 and got[7, "http://c.example/"] == got[8, "http://c.example/2"] == "same"


def test_empty(spark):
    assert texts(spark, []) == {}


def test_articles_of_the_test_table(spark, sf):
    sql = r"""SELECT page_id, array_to_string(list_filter(list_transform(regexp_split_to_array(
                regexp_extract(html, '<article>(.*)</article>', 1, 's'), '</?(p|h1)>'), lambda x: trim(regexp_replace(replace(replace(replace(replace(
                regexp_replace(x, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text
              FROM read_parquet('%s/pages.parquet')"""
    want = dict(duckdb.sql(sql % sf).fetchall())
    got = {r.page_id: r.text for r in wrappers.op3_wrappers(spark, sf).collect()}
    assert got == want
