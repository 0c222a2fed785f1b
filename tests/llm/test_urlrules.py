from itertools import combinations

import pytest

from factloom.llm import urlrules as u
from factloom.llm.queries import URL_RULES


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "action"),
    [
        ("https://Blog.Example.com/en/1?q#x", "blog.example.com", "/en/1", "example.com/en/", "block"),
        ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://a.www.example.com/en/x", "a.www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://a.net/es/", "a.net", "/es/", "net/es/", "block"),
        ("http://a.net/es", "a.net", "/es", None, None),
        ("http://a.com", "a.com", "", None, None),
        ("http://a.com?/x", "a.com", "", None, None),
        ("http://a.org/://b.com/", "a.org", "/://b.com/", None, None),
        ("a.com/x", "", "", None, None),
        ("", "", "", None, None),
        (None, "", "", None, None),
        ("x://ÉA.com/", "Éa.com", "/", "com/", "allow"),
    ],
)
def test_written_rules(url, host, path, rule, action):
    assert u.split_url(url) == (host, path)
    assert u.WrittenRules(URL_RULES).judge(host, path) == (None if rule is None else (rule, action))


def planted(n=400):
    pages, labels = [], []
    for i in range(n):
        spam = i % 4 == 0
        host = f"{'cheap' if spam else 'good'}-site{i % 3}.example.org"
        pages.append((i, f"http://{host}/{'en' if i % 2 else 'de'}/{i}", "clash"))
        if i % 3:
            labels.append((i, 0 if spam else 1, 0))
    return pages, labels


def frames(spark, pages, labels):
    return spark.createDataFrame(pages, "page_id long, url string, verdict string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_mined_rules_equal_brute_force_and_block(spark):
    pages, labels = planted()
    p, q = frames(spark, pages, [*labels, labels[0], (None, 0, 1), (5000, 0, 1), (2, None, None)])
    rules = u.mine(u.labelled_tokens(p, q)).collect()
    judged = dict((i, k == 0 or t == 1) for i, k, t in labels)
    sets = [(frozenset(u.tokens_of(url)), judged[i]) for i, url, _ in pages if i in judged]
    share, least = sum(b for _, b in sets) / len(sets), max(u.MIN_SUPPORT, u.MIN_COUNT / len(sets)) * len(sets)
    counts = {}
    for tokens, bad in sets:
        for k in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), k):
                n, b = counts.get(c, (0, 0))
                counts[c] = n + 1, b + bad
    want = {c for c, (n, b) in counts.items() if b >= least and b / n >= u.MIN_CONFIDENCE and b / n / share >= u.MIN_LIFT}
    assert {tuple(sorted(r["antecedent"])) for r in rules} == want and want
    found = u.judge_pages(p, URL_RULES, spark.createDataFrame(rules))
    for r in found.collect():
        assert r[u.VERDICT] == ("block" if "cheap" in r["url"] else "allow") and r["verdict"] == "clash"


def test_blocks_of_rules_agree(spark, monkeypatch):
    pages, labels = planted(200)
    p, q = frames(spark, pages, labels)
    rules = u.mine(u.labelled_tokens(p, q)).cache()
    once = {r["page_id"]: (r[u.VERDICT], r[u.MINED]) for r in u.judge_pages(p, URL_RULES, rules).collect()}
    monkeypatch.setattr(u, "BLOCK_RULES", 7)
    assert {r["page_id"]: (r[u.VERDICT], r[u.MINED]) for r in u.judge_pages(p, URL_RULES, rules).collect()} == once


def test_no_labels_nulls_and_long(spark):
    pages = [(1, None, "x"), (2, "http://a.com/" + "x/" * 50_000, "x"), (None, "http://a.net/fr/", "x"), (1, None, "x")]
    p, q = frames(spark, pages, [])
    rules = u.mine(u.labelled_tokens(p, q))
    found = sorted((str(r["page_id"]), r[u.HOST], r[u.VERDICT]) for r in u.judge_pages(p, URL_RULES, rules).collect())
    assert found == [("1", "", "allow"), ("1", "", "allow"), ("2", "a.com", "allow"), ("None", "a.net", "block")]
    assert u.judge_pages(p.limit(0), URL_RULES, rules).count() == 0
    assert len(u.tokens_of("http://" + "a." * 9999 + "com/?" + "&".join("q" * 9999))) <= 10


@pytest.mark.parametrize(
    ("url", "tokens"),
    [
        ("http://cheap-pills.example.org/x/adult/buy_now.html?page=2&ref=x", {"siteword=pills", "step=adult", "fileword=buy", "fileword=now", "query=ref"}),
        ("http://free-bets.org/a/b", {"word=free", "word=bets", "dir=a", "step=b"}),
        ("http://w.x.y.z.example.org/", {"sub=w", "label=x", "label=y", "site=z", "siteword=x"}),
        ("http://a.org/?#x?y", {"query="}),
    ],
)
def test_tokens_of_all_places(url, tokens):
    assert tokens <= set(u.tokens_of(url)) and "query=y" not in u.tokens_of(url)


PLACES = ["http://{}-pills.a.org/", "http://{}-bets.org/", "http://a.org/x{}/adult/1", "http://a.org/?{}=1&ref=2", "http://a.org/x/{}-buy.html"]


@pytest.mark.parametrize("long", [u.LONG, 2])
@pytest.mark.parametrize("place", PLACES)
def test_later_words_and_steps_block(spark, monkeypatch, place, long):
    monkeypatch.setattr(u, "LONG", long)
    plain = place.replace("pills", "tea").replace("bets", "tea").replace("adult", "tea").replace("ref", "tea").replace("buy", "tea")
    pages = [(i, (plain if i % 4 else place).format(f"w{i}"), "x") for i in range(120)]
    p, q = frames(spark, pages, [(i, 1 if i % 4 else 0, 0) for i in range(120)])
    judged = u.judge_pages(p, [], u.mine(u.labelled_tokens(p, q))).collect()
    assert {r["page_id"]: r[u.VERDICT] for r in judged} == {i: "allow" if i % 4 else "block" for i in range(120)}


def test_length_of_rules():
    assert u.rule_length({3: 10}) == 3 and u.rule_length({10: 100, 18: 20}) > 3
    assert u.rule_length({50: 1000}) == 1 and u.rule_length({50: 1, 10: 100_000}) >= 3 and u.rule_length({5000: 5}) == 1


def test_fragments_block(spark):
    pages = [(i, f"http://a{i}.org/{i}" + ("" if i % 4 else "#x"), "x") for i in range(120)]
    p, q = frames(spark, pages, [(i, 1 if i % 4 else 0, 0) for i in range(120)])
    judged = u.judge_pages(p, [], u.mine(u.labelled_tokens(p, q))).collect()
    assert {r["page_id"]: r[u.VERDICT] for r in judged} == {i: "allow" if i % 4 else "block" for i in range(120)}
    assert not any(t.startswith("fragment") for t in u.tokens_of("http://a.org/?x"))


@pytest.mark.parametrize("good", [30, 0])
def test_rules_where_most_pages_are_bad(spark, good):
    pages = [(i, f"http://{'tea' if i < good else 'pills'}-a.org/{i}", "x") for i in range(120)]
    p, q = frames(spark, pages, [(i, 1 if i < good else 0, 0) for i in range(120)])
    judged = u.judge_pages(p, [], u.mine(u.labelled_tokens(p, q))).collect()
    assert {r["page_id"]: r[u.VERDICT] for r in judged} == {i: "allow" if i < good else "block" for i in range(120)}


def test_equally_confident_rules_and_clashing_columns(spark):
    rules = spark.createDataFrame([(["b=1"], 0.9, 0.5), (["a=1"], 0.9, 0.5), (["c=1"], 0.9, 0.6)], "antecedent array<string>, confidence double, support double")
    mined = next(u.rule_blocks(rules))
    assert mined.match(["a=1", "b=1"]) == (0.9, "a=1") and mined.match(["a=1", "c=1"]) == (0.9, "c=1") and mined.match(["x"]) is None
    pages = spark.createDataFrame([(1, "http://a.net/fr/", "own")], f"page_id long, url string, {u.VERDICT} string")
    assert [r[u.VERDICT] for r in u.judge_pages(pages, URL_RULES, rules).collect()] == ["block"]


def test_planted_rules_of_the_registered_query_decide(spark):
    from factloom.llm.queries import planted_url_rules

    found = planted_url_rules(spark, "/root/testdata/sf0.01").collect()
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url").collect()}
    blocked = {r["page_id"] for r in found if r["verdict"] == "block"}
    assert blocked and all("://blog." in urls[p] and "/en/" in urls[p] for p in blocked)


def judged_as(spark, pages, labels):
    p, q = frames(spark, pages, labels)
    return {r["page_id"]: (r[u.VERDICT], r[u.CONFIDENCE]) for r in u.judge_pages(p, [], u.mine(u.labelled_tokens(p, q))).collect()}


def test_combinations_of_three_block_among_many_tokens(spark):
    # each pair of a, b, c is as often good as bad; 20 other tokens are in all urls
    always = "&".join(f"c{i}=1" for i in range(20))
    asked = ["a&b&c", "a&b", "a&c", "b&c"]
    pages = [(i, f"http://x.org/?{always}&{asked[i % 4]}", "x") for i in range(160)]
    found = judged_as(spark, pages, [(i, int(i % 4 > 0), 0) for i in range(160)])
    assert found == {i: ("allow", None) if i % 4 else ("block", 1.0) for i in range(160)}


def test_patterns_without_those_replaced_judge_as_all_do(spark, monkeypatch):
    import random

    random.seed(11)
    pages, labels = [], []
    for i in range(400):
        names = [x for x in "abcdef" if random.random() < 0.6]
        names += ["g"] * ("a" in names) + ["h"] * ("b" in names and "c" in names)
        pages.append((i, f"http://x.org/?{'&'.join(names)}", "x"))
        labels.append((i, int(random.random() > (0.9 if {"a", "b", "c", "d"} <= set(names) else 0.65 if "e" in names and "f" in names else 0.1)), 0))
    whole = judged_as(spark, pages, labels)
    assert len({c for _, c in whole.values()}) > 4
    monkeypatch.setattr(u, "LONG", 2)
    assert judged_as(spark, pages, labels) == whole
