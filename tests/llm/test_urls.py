from pyspark.sql import functions as F

from longloom.llm import urls

RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow"}


def test_terms(spark):
    rows = spark.createDataFrame(
        [(None,), ("",), ("http://a.org/PORN/x",), ("http://pornographie.org",), ("http://sex.org/dating",),
         ("http://essex.org/sex-sex",), ("http://a.org/casino?casino=casino",), ("sex",), ("xxx",), ("éxxxé",)],
        "url string").select("url", urls.url_terms(F.col("url")).alias("t")).collect()
    got = {r["url"]: (r["t"]["strict"], r["t"]["soft"], r["t"]["weight"], r["t"]["rejected"]) for r in rows}
    assert got == {
        None: ([], [], 0, False), "": ([], [], 0, False), "http://a.org/PORN/x": (["porn"], [], 0, True),
        "http://pornographie.org": ([], [], 0, False), "http://sex.org/dating": ([], ["dating", "sex"], 3, True),
        "http://essex.org/sex-sex": ([], ["sex"], 4, False), "http://a.org/casino?casino=casino": ([], ["casino"], 3, False),
        "sex": ([], ["sex"], 2, False), "xxx": (["xxx"], [], 0, True), "éxxxé": (["xxx"], [], 0, True)}


def test_rules(spark):
    docs = spark.createDataFrame(
        [(1, "http://x.Example.com/en/a?b", "h"), (2, "https://www.example.com/en/", "h"), (3, "http://example.com", None),
         (4, "http://notexample.com/en/", "h"), (5, "example.com/en/", "h"), (6, None, "h"), (7, "a://b://c.com/x#y", "h"),
         (8, "http://b.org/xxx/", "h"), (8, "http://b.org/xxx/", "h"), (9, "HTTP://A.COM/xxx", "h")],
        "page_id long, url string, verdict string")
    rows = urls.judge_urls(docs, RULES).orderBy("page_id").collect()
    got = [(r["page_id"], r["judged"]["host"], r["judged"]["path"], r["judged"]["rule"], r["judged"]["verdict"]) for r in rows]
    assert got == [
        (1, "x.example.com", "/en/a", "example.com/en/", "block"), (2, "www.example.com", "/en/", "www.example.com/en/", "allow"),
        (3, "example.com", "", None, "allow"), (4, "notexample.com", "/en/", "com/", "allow"), (5, "", "", None, "allow"),
        (6, "", "", None, "allow"), (7, "b:", "//c.com/x", None, "allow"), (8, "b.org", "/xxx/", None, "block"),
        (8, "b.org", "/xxx/", None, "block"), (9, "a.com", "/xxx", "com/", "allow")]
    assert rows[0]["verdict"] == "h"


def test_no_rules_and_no_rows(spark):
    docs = spark.createDataFrame([], "url string")
    assert urls.judge_urls(docs, {}).count() == 0
