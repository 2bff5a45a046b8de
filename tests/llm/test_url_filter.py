"""URL filter: the index gives what running every rule gives."""

import random

import pytest

from valueflow.llm import queries, url_filter as U

RULES = U.make_rules(queries.URL_RULES, queries.URL_PATTERNS + ["|http://a.b/x|", "*", "@@|https://ok.*"])


def every_rule(rules, url, host, path):
    place = host + path
    import re
    hosts = [r for r in rules if r.kind == "host" and host and re.compile(r.regex, re.S).match(place)]
    if hosts:
        best = max(hosts, key=lambda r: (len(r.text), -r.rank))
        return best.text, best.verdict, None
    found = [r for r in rules if r.kind == "pattern" and url and re.compile(r.regex, re.S).search(url)]
    best = min(found, key=lambda r: (r.verdict != "allow", r.rank), default=None)
    return None, best and best.verdict, best and best.text


@pytest.mark.parametrize("counts", [{}, {"example": 9, "org": 20, "en": 1, "com": 5, "utm": 2}])
def test_index_equals_every_rule(counts):
    rng = random.Random(5)
    index = U.Index(RULES, counts)
    for _ in range(2000):
        host = ".".join(rng.choices(["a", "example", "org", "com", "ads-track", "free-bets", "net", "b"], k=rng.randint(0, 4)))
        path = "".join(rng.choices(["/", "en", "/es/", "/fr/", "1", "index.php", "de/", "/en/1"], k=rng.randint(0, 4)))
        path = path if path.startswith("/") else "/" + path
        url = rng.choice(["http://", "https://"]) + host + path + rng.choice(["", "?utm_source=feed", "#x"])
        assert index.judge(url, host, path) == every_rule(RULES, url, host, path), url


def test_only_candidates_run():
    index = U.Index(U.make_rules([], ["||one.example^", "two"]), {"example": 100, "one": 1})
    assert [r.text for r, _ in index.candidates("pattern", {"one", "x"})] == ["||one.example^", "two"]  # "two" has no bounded token
    assert [r.text for r, _ in index.candidates("pattern", {"example"})] == ["two"]


def test_cases(spark):
    rows = [(1, "HTTP://M.Example.ORG/es/7?x=1", "a"), (2, "http://example.org/en/12", "b"), (3, "http://notexample.com/de/", "c"), (4, None, "d"),
            (5, "no scheme", "e"), (6, "", "f"), (7, "http://org", "g"), (8, "http://x.org/", "h"), (9, "http://example.com:80/fr/1", "i"),
            (10, "http://é.com/fr/" + "x" * 100_000, "j"), (10, "http://example.org/en/12", "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = [tuple(r) for r in U.filter_urls(df, U.make_rules(queries.URL_RULES)).select("page_id", "_url.host", "_url.path", "_url.rule", "_url.verdict", "verdict").collect()]
    assert got[0] == (1, "m.example.org", "/es/7", "example.org/es/", "block", "a")
    assert [g[3] for g in got[1:]] == ["example.org/en/1", "com/de/", None, None, None, None, "org/", None, "com/fr/", "example.org/en/1"]
    assert got[3][1:3] == ("", "") and got[4][1:3] == ("", "") and got[6][1:3] == ("org", "")
    assert [g[4] for g in got[3:7]] == ["allow"] * 4
    assert U.filter_urls(df.limit(0), RULES).count() == 0


def test_many_rule_tokens(spark):
    df = spark.createDataFrame([(1, "http://t7.com/a"), (2, "http://t9.com/t7")], "page_id long, url string")
    counts = U.token_counts(df, "url", U.make_rules([("block", f"t{i}.com", "/") for i in range(200)]))
    assert counts == {"t7": 2, "t9": 1, "com": 2}


def test_groups_of_rules_judge_alike_and_columns_stay(spark):
    rng = random.Random(9)
    urls = [f"http://{rng.choice(['a', 'ads-track', 'x.example'])}.{rng.choice(['org', 'com', 'net'])}/{rng.choice(['en/1', 'fr/', 'es/', ''])}x" for _ in range(300)] + [None, "", "x"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, __host string")
    whole, parts = U.filter_urls(df, RULES), U.filter_urls(df, RULES, group_rules=2)
    assert whole.columns == parts.columns == ["page_id", "url", "__host", "_url"]
    assert sorted(whole.collect()) == sorted(parts.collect())
    assert U.filter_urls(df, []).filter("_url.verdict <> 'allow'").count() == 0


def test_rules_are_compiled_when_fetched():
    index = U.Index(U.make_rules([], [f"||site{i}.example^" for i in range(5000)]), {"example": 9})
    assert index.judge("http://site7.example/", "site7.example", "/")[2] == "||site7.example^" and len(index.compiled) == 1
