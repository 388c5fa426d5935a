import re

from tidemark.llm.url_filter import default_rules, judge

URLS = [
    None, "", "no scheme", "http://example.com", "http://example.com/", "HTTP://WWW.Example.COM/en/x?q#f", "https://example.com/en/a", "http://a.b.net/es/1",
    "http://net/fr/", "http://xnet/fr/", "http://x.net/EN/", "http://x.org/login", "http://x.org/login?next=1", "http://x.org/loginx", "http://ads.x.org/",
    "http://badads.x.org/", "http://x.org/a.zip", "http://x.org/a.zipper", "http://x.org/docs/a.zip", "http://x.org/?sessionid=3", "a://b://c/d?e",
    "http://example.com#/en/", "http://x.org/calendar/2020/day/5", "http://ünï.com/ß", "http://x.com:80/", "http://x.org/" + "a/" * 20_000 + "ads/", "http://x.org/a\nb/ads/", "http://x.org/wp-login.php",
]


def plain(url):
    url = url or ""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), url)
    m = re.match(r"(?s:.*?)://([^/?#]*)([^?#]*)", url)
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    rules = sorted(default_rules(), key=lambda r: (-len(r.text), r.text))
    base = next((r for r in rules if r.base and re.search(r.regex, host + path)), None)
    other = next((r for r in rules if not r.base and re.search(r.regex, low)), None)
    verdict = base.verdict if base else other.verdict if other else "allow"
    return host, path, base and base.text, verdict, other and other.text


def test_verdicts_equal_every_rule_tried(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(4, URLS[4]), (None, URLS[5])]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' as host", "'y' as rule").repartition(3)
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict, r.method_rule) for r in judge(df).collect()), key=str)
    assert got == sorted(((i, *plain(u)) for i, u in rows), key=str)


def test_empty_table(spark):
    assert judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
