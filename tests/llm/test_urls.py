import duckdb

from vellum.llm import urls

ODD = [
    None, "", "no scheme casino", "http://", "http://Example.ORG/es/x", "http://a.example.org/en/12", "http://example.org", "http://org/",
    "http://notorg/", "https://X.com/fr/a?b#c", "https://com/de/", "https://q.net?casino", "https://q.net#a://b", "http://casinos.net/", "http://casino.net/casino-casino",
    "http://a.net/sale/promo", "http://a.net/sale/promo/coupon/bonus", "http://a.net/dating/sale", "http://a.net/betting", "http://casinox.net/", "http://xcasino.net/", "http://casino", "casino://casino",
    "http://a.net/cheap/pills", "http://a.net/cheap-cheap", "http://é.net/bet/écheap", "http://a.net:80/x/free.win",
]


def rows(frame):
    return sorted((tuple(r) for r in frame), key=str)


def test_against_sql(spark):
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(ODD)] + [(0, ODD[4], None, "x")], "page_id long, url string, html string, host string")
    pages = pages.unionByName(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), allowMissingColumns=True)
    got = urls.filter_urls(pages)
    con = duckdb.connect()
    con.register("pages", pages.drop("html").toArrow())
    assert rows(got.collect()) == rows(con.sql(urls.oracle()).fetchall())
    assert urls.filter_urls(pages.limit(0)).count() == 0


def test_rules_and_terms(spark):
    pages = spark.createDataFrame(list(enumerate(ODD)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages).collect()}
    assert got[0] == ("", "", None, "allow") and got[2] == ("", "", None, "allow")
    assert got[4] == ("example.org", "/es/x", "example.org/es/", "block")
    assert got[5][2:] == ("example.org/en/1", "block") and got[6][2:] == (None, "allow") and got[7][2:] == ("org/", "allow")
    assert got[8][2] is None and got[9] == ("x.com", "/fr/a", "com/fr/", "allow") and got[10][2:] == ("com/de/", "block")
    assert got[11] == ("q.net", "", None, "block") and got[12] == ("q.net", "", None, "allow") and got[13][3] == "allow"
    said = {ODD[k]: got[k][3] for k in got if ODD[k]}
    assert said["http://a.net/cheap/pills"] == "block" and said["http://a.net/cheap-cheap"] == "allow"
    assert (said["http://a.net/sale/promo"], said["http://a.net/sale/promo/coupon/bonus"], said["http://a.net/dating/sale"], said["http://a.net/betting"]) == ("allow", "block", "block", "allow")
    assert (said["http://casinox.net/"], said["http://xcasino.net/"], said["http://casino"]) == ("allow", "allow", "block")


def test_vocabulary_from_a_table(spark):
    terms = spark.createDataFrame([("Foo", 12.0), ("bar", 1.0), ("baz", 1.0), ("bar", 0.5), ("", 3.0), (None, 1.0), ("qux", None)], "term string, weight double")
    known = urls.vocabulary_of(terms)
    assert known == {"foo": 12.0, "bar": 1.0, "baz": 1.0}
    pages = spark.createDataFrame([(1, "http://a/foo"), (2, "http://a/bar/baz"), (3, "http://a/bar/bar"), (4, "http://a/casino")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.filter_urls(pages, vocabulary=known).collect()} == {1: "block", 2: "block", 3: "allow", 4: "allow"}
    assert {r.verdict for r in urls.filter_urls(pages, vocabulary={}).collect()} == {"allow"}
