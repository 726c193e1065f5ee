import random

from corpuscle.llm import entries, urlfilter

RULES = entries.URL_RULES + [("a.example.com", "/en/deep", "allow"), (None, "/", "block"), ("dup.org", "/", "allow"), ("dup.org", "/", "block")]


def brute(url, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fit = [(len(h + p), h + p, v) for h, p, v in RULES if h and host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        return host, path, max(fit)[1], max(fit)[2], False
    hit = bool(host) and (host, path.rstrip("/")) in listed
    return host, path, None, "block" if hit else "allow", hit


def test_verdicts_equal_brute_force_with_any_filter(spark):
    rng = random.Random(2)
    hosts = ["example.com", "www.example.com", "WWW.Example.COM", "xexample.com", "a.example.com", "x.net", "net", "y.org", "dup.org", "É.org", ""]
    paths = ["", "/", "/en", "/en/", "/en/deep/x", "/es/1", "/fr/", "/FR/", "/en/a?b=/es/", "#/es/", "?u=http://q.net/es/", "/a//", "/" + "x" * 5000]
    urls = [f"{rng.choice(['http', 'https', ''])}://{h}{p}" for h in hosts for p in paths] + [None, "", "example.com/en/", "http:/x", "a\n://x.net/es/"]
    urls += urls[:5]
    pages = spark.createDataFrame([(k if k % 50 else None, u, "v", "r") for k, u in enumerate(urls)], "page_id long, url string, verdict string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    listed = spark.createDataFrame([("http://y.org/a",), ("ftp://Y.org/a/?z",), ("https://É.org",), (None,), ("junk",)], "url string")
    want = [(str(k if k % 50 else None), *brute(u, {("y.org", "/a"), ("É.org", "")})) for k, u in enumerate(urls)]
    for most in (64 << 20, 32):  # a filter of one block passes nearly everything on to the join
        got = urlfilter.judge(pages, rules, listed, most_bytes=most).collect()
        rows = [(str(r.page_id), r.host, r.path, r.rule, r.verdict, r.listed) for r in got]
        assert sorted(map(repr, rows)) == sorted(map(repr, want))
    assert urlfilter.judge(pages.where("false"), rules).count() == 0
    none = urlfilter.judge(pages, rules.where("false")).collect()
    assert len(none) == len(urls) and {r.verdict for r in none} == {"allow"}


def test_the_filter_has_no_false_negatives_and_few_false_hits(spark):
    keys = spark.range(20_000).selectExpr("concat('host', id, '.com/') key")
    bloom = urlfilter.BlockedBloom.of(keys)
    assert bloom.may_hold([f"host{k}.com/".encode() for k in range(20_000)]).all()
    assert bloom.may_hold([f"other{k}.com/".encode() for k in range(20_000)]).mean() < 0.02
