import random

from trolley.llm import urlfilter as U

URLS = [None, "", "no scheme", "http://", "http://net/", "http://net", "https://A.Example.NET/en/x?q#f", "http://example.net/EN/", "x://example.net/de",
        "http://badexample.net/en/", "http://example.com/de/1", "http://www.example.com/de", "http://q.example.com/fr/", "http://x.org/fr/a?b=/de/",
        "http://x.org?/fr/", "http://x.org#/fr/", "http://casino-win.example.org/en/", "http://casino-win.example.org/fr/", "http://a.spam.example.com/",
        "http://spammer.example.com/", "a://b://c/d", "http://u@x.net:80/", "http://x.net:80/", "HTTP://X.NET/", "http://é.net/ü", "http://x.net/" + "y" * 5000,
        "http://a\nb.net/en/\nz"]


def expected(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, a) for a, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    bad = any(w in U.UNWANTED for label in host.split(".")[:-1] for w in label.split("-"))
    return host, path, None, "block" if bad else "allow"


def test_rules_and_list(spark):
    rows = list(enumerate(URLS)) + [(1, URLS[6]), (None, URLS[6])]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'k' as key", "'h' as host", "'r' as rule")
    got = sorted((tuple(r) for r in U.judge(pages).collect()), key=repr)
    assert got == sorted(((i, *expected(u)) for i, u in rows), key=repr)


def test_cascade_is_exact_over_its_universe(spark):
    rng = random.Random(3)
    keys = [f"host{rng.random()}.example" for _ in range(6000)]
    listed = set(keys[:700])
    frame = lambda ks: spark.createDataFrame([(k,) for k in ks], "key string")
    cascade = U.build_cascade(frame([*listed, "not in the corpus", None]), frame([*keys, keys[0], None]))
    assert len(cascade.levels) > 1
    # about 1.44 * 700 * (4 + log2(5300 / 700)) bits, then a sixteenth and less of the keys
    assert len(cascade.levels[0].words) * 64 < 1.45 * 700 * 7 + 64 and sum(len(x.words) for x in cascade.levels[1:]) * 64 < 1500
    assert [bool(x) for x in cascade.contains(U.hashes(keys))] == [k in listed for k in keys]


def test_empty(spark):
    assert U.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    none = spark.createDataFrame([], "key string")
    assert not U.build_cascade(none, none).contains(U.hashes(["a"])).any()


def test_a_list_beyond_the_bound_is_cut_into_shards(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    rules = spark.createDataFrame([*U.RULES, ("block", None, "/"), (None, "org", "/")], "action string, host string, path string") \
        .selectExpr("*", "1 as page_id")
    got = sorted((tuple(r) for r in U.judge(pages, rules, max_bytes=1).collect()), key=repr)
    assert got == sorted(((i, *expected(u)) for i, u in enumerate(URLS)), key=repr)


def test_level_zero_follows_the_list_not_the_universe():
    sizes = [U.filter_words(10**6, U.first_rate(10**6, m)) * 64 / 10**6 for m in (10**7, 10**9, 10**11)]
    assert sizes[0] < 12 and sizes[1] - sizes[0] < 10 and sizes[2] - sizes[1] < 10      # 1.44 log2(100) bits a key each
