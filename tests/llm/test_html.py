"""Main text of pages: markup, structure, and templates counted per host."""

from pyspark.sql import functions as F

from casegraph.llm import html_extraction as X
from casegraph.llm.html_tree import parse


def text(source, template=()):
    return X.main_text(source, set(template))


def test_blocks_and_white_space():
    assert text("<p>a &amp; b&nbsp; c\n d<p>e<br>f") == "a & b c d\ne f"
    assert text("x<div>y</div>z") == "x\ny\nz"
    assert text("<ul><li>1<li>2</ul><table><tr><td>3<td>4</table>") == "1\n2\n3\n4"
    assert text("<p>un<b>closed<p>next</b> end") == "unclosed\nnext end"
    assert text("") == "" and text("   ") == ""
    assert text("1 < 2 & 3 &lt; 4") == "1 < 2 & 3 < 4"


def test_dropped_parts():
    page = (
        "<head><title>t</title><style>p{}</style></head><body><nav>menu</nav><header>top</header>"
        "<div class='cookie-notice'>cookies</div><div id=sidebar>side</div><script>var a='<p>no</p>';</script>"
        "<article><h1>Head</h1><p>Body<!-- hidden --> text.</p><aside>aside</aside><form>f</form>"
        "<section class='comments'><article class=comment><p>reader</p></article></section></article>"
        "<div class=ad>buy</div><footer>foot</footer>"
    )
    assert text(page) == "Head\nBody text."
    assert text("<main><p>a</p><div class='related'>r</div></main><p>b</p>") == "a"
    assert text("<div class='has-sidebar'><article><p>kept</p></article></div>") == "kept"
    assert text("<article><header><h1>T</h1></header><p>x</p></article>") == "T\nx"


def test_torn_and_deep_markup():
    assert text("<p>a</p><p>b <a href='x") != ""
    assert text("<div>" * 20_000 + "deep") == "deep"
    assert text("<a 'b>m") == "m"
    assert parse("<!-- open").parts == []


def test_long_page():
    body = "".join(f"<p>paragraph {i}" for i in range(20_000))
    assert text(f"<article>{body}</article>").count("\n") == 19_999


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_templates_of_a_host(spark):
    rows = [
        (i, f"https://a.example/{i}", f"<div><p>Sign up for our letters!</p><p>Story {i} of the day.</p></div>")
        for i in range(20)
    ]
    rows += [(100 + i, "https://b.example/x", "<p>The same page.</p><p>Copied often.</p>") for i in range(20)]
    rows += [(200, None, "<p>no address</p>"), (201, "not a url", None), (202, "https://c.example/", "")]
    got = {r["page_id"]: r["text"] for r in X.extract(pages(spark, rows).withColumn("trees", F.lit("clash"))).collect()}
    assert all(got[i] == f"Story {i} of the day." for i in range(20))
    assert all(got[100 + i] == "The same page.\nCopied often." for i in range(20))
    assert got[200] == "no address" and got[201] == "" and got[202] == ""


def test_salted_join_gives_the_same(spark, sf_dir, monkeypatch):
    base = spark.read.parquet(f"{sf_dir}/pages.parquet").limit(60)
    rows = [
        (i, "https://a.example/", f"<div><p>Every page has this.</p><p>Story {i}.</p></div>") for i in range(1000, 1030)
    ]
    df = base.unionByName(pages(spark, rows))
    want = sorted(tuple(r) for r in X.extract(df).collect())
    monkeypatch.setattr(X, "BROADCAST_TEMPLATES", -1)
    assert sorted(tuple(r) for r in X.extract(df).collect()) == want
    assert [r for r in want if r[0] == 1000][0][2] == "Story 1000."


def test_pages(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = X.extract(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert r["n_chars"] == len(r["text"]) > 0
        assert "<" not in r["text"] and "track(" not in r["text"]
    assert X.extract(df.where("false")).count() == 0


def test_hosts(spark):
    urls = ["https://User@A.Example:8080/x", "http://b.example?q", "ftp://[::1]/", None, "nothing"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(X.host_of(F.col("u")).alias("h"))
    assert [r["h"] for r in df.collect()] == ["a.example", "b.example", "[::1]", "", ""]
