import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import html as H
from corvane.functions import text as T
from corvane.functions import urls as U


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_sentences():
    assert T.split_sentences("One. Two! Three?") == ["One.", "Two!", "Three?"]
    assert T.split_sentences("Dr. Khan met J. Smith today. Done.") == ["Dr. Khan met J. Smith today.", "Done."]
    assert T.split_sentences('He said "hi." Then left.') == ['He said "hi.', "Then left."]
    assert T.split_sentences("  ") == [] and T.split_sentences(None) == []
    assert T.split_sentences("Fig. ") == ["Fig."]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!?\"')\n", max_size=60))
def test_sentences_lose_no_word(text):
    # only closing quotes and brackets after an end may go
    keep = lambda x: [c for c in x if c in "ab"]
    assert keep("".join(T.split_sentences(text))) == keep(text)


def test_words_and_tokens(spark):
    assert column(spark, ["a  b", "", None, "x y"], T.word_count) == [2, 0, None, 2]
    assert column(spark, ["The Éaux of it, 24/7", ""], T.tokens) == [["aux", "24", "7"], []]
    assert column(spark, [" A  b\n", None], T.normalised) == ["a b", None]


def test_ngrams(spark):
    assert column(spark, ["a b c", "a", ""], T.ngrams) == [["a", "b", "c", "a b", "b c", "a b c"], ["a"], []]


def test_overlap_and_coverage(spark):
    df = spark.createDataFrame([("drain repair", "drain repair cost"), ("drain price", "the drain"), ("the", "x"), ("", "x")], "q string, p string")
    assert [r[0] for r in df.select(T.lexical_overlap(F.col("q"), F.col("p"))).collect()] == [1.0, 0.5, 0.0, 0.0]
    df = spark.createDataFrame([("a b c d", "x a b y"), ("a b c d", "c d e"), ("a b", "zz"), ("", "z")], "q string, p string")
    assert [r[0] for r in df.select(T.edge_coverage(F.col("q"), F.col("p"))).collect()] == [0.5, 0.5, 0.0, 0.0]


def test_ids(spark):
    df = spark.createDataFrame([(7, 12345, "t")], "d long, o int, t string")
    assert df.select(T.chunk_id(F.col("d"), F.lit("fixed"), F.col("o"), F.col("t"))).first()[0].startswith("7:fixed:12345:")
    assert column(spark, ["Acme Plumbing & Co.", "x", ""], T.slug) == ["acme-plumbing-co", "org", "org"]


def test_redaction(spark):
    df = spark.createDataFrame([({"Token": "abc", "n": "1"},)], "m map<string,string>")
    assert df.select(T.redacted_map(F.col("m"))).first()[0] == {"Token": "[redacted]", "n": "1"}


def test_canonical(spark):
    urls = ["https://a.example/page#frag", "https://a.example/page/", "https://A.Example/Page", "https://a.example", "https://a.example/p?x=1"]
    assert column(spark, urls, U.canonical) == ["https://a.example/page", "https://a.example/page", "https://a.example/Page", "https://a.example/", "https://a.example/p?x=1"]


def test_site(spark):
    assert column(spark, ["HTTPS://www.A.example:80/x", "http://u@b.test?q", None, ""], U.site_of) == ["a.example", "b.test", None, None]


def test_refusals_of_other_spellings(spark):
    urls = ["http://[::1]/", "http://[::ffff:10.0.0.1]/", "http://2130706433/", "http://0x7f.0.0.1/", "http://localhost/", "http://a.internal/", "http://u:p@a.example/", "http://[2606:4700::1111]/", "http://[64:ff9b::a00:1]/", "http://a1.example/", "http://[zz]/", "http://1.1.1.1/", None]
    want = ["blocked_address", "blocked_address", "bad_address", "bad_address", "blocked_host", "blocked_host", "credentials", None, "blocked_address", None, "bad_address", None, "scheme"]
    assert column(spark, urls, U.refusal) == want


def test_refusals(spark):
    urls = ["http://a.example/", "ftp://a.example/", "http:///x", "http://a.example:22/", "http://127.0.0.1/", "http://169.254.169.254/", "http://8.8.8.8/", "http://10.1.2.3:8080/"]
    assert column(spark, urls, U.refusal) == [None, "scheme", "missing_host", "port", "blocked_address", "blocked_address", None, "blocked_address"]


@pytest.mark.parametrize("host,blocked", [("::1", True), ("::ffff:127.0.0.1", True), ("2606:4700:4700::1111", False), ("1.1.1.1", False), ("192.168.0.9", True), ("name.example", False)])
def test_addresses(spark, host, blocked):
    assert column(spark, [host], U.blocked_address) == [blocked]


def test_joined(spark):
    df = spark.createDataFrame([("https://a.example/x/y", r) for r in ("/about", "z", "https://b.test/q", "//c.test/", "?p=1")], "b string, r string")
    assert [r[0] for r in df.select(U.joined(F.col("b"), F.col("r"))).collect()] == ["https://a.example/about", "https://a.example/x/z", "https://b.test/q", "https://c.test/", "https://a.example/x/y?p=1"]


PAGE = "<html><title>T &amp; U</title><nav>menu</nav>Lead<h1>A</h1>one<h2>B</h2>two<h3>C</h3>three<h2>D</h2>four<h2></h2>five</html>"


def test_html(spark):
    assert column(spark, [PAGE, "<h2>Head</h2>x", "x", None], H.title) == ["T & U", "Head", "", None]
    assert "menu" not in column(spark, [PAGE], H.text)[0]
    assert column(spark, ['<a href="/about">x</a><a href="mailto:x@y.z">m</a><a href="#t">t</a>'], H.hrefs) == [["/about"]]
    assert column(spark, ["a \t b\x0bc\n\n\n\nd ", ""], H.tidy) == ["a b c\n\nd", ""]


def test_point_ids(spark):
    import uuid

    names = ["7:fixed:0000:abc", "é", ""]
    from corvane.functions.security import point_id

    assert column(spark, [*names, None], point_id) == [*(str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names), None]


def test_signatures(spark):
    from corvane.functions import security

    df = spark.createDataFrame([("p", 100, 100, 400), ("p", 100, 100, 401), ("q", 100, 100, 100), (None, 100, 100, 100)], "p string, at long, signed_at long, now long")
    sig = security.signature("k")(F.lit("p"), F.col("signed_at"))
    got = df.select(security.verified("k")(F.col("p"), F.col("at"), sig, F.col("now"))).collect()
    assert [r[0] for r in got] == [True, False, False, False]


def test_sitemaps(spark):
    from corvane.operators.extraction import sitemaps

    df = spark.createDataFrame([("a", "User-agent: *\nSitemap: http://a/s.xml\r\n sitemap:http://a/t.xml"), ("b", None)], "host string, body string")
    assert sorted(r.sitemap for r in sitemaps(df).collect()) == ["http://a/s.xml", "http://a/t.xml"]
