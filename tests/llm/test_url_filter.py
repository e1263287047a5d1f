import random
import re

from brute import SF
from llm_oracle import same
from stratalens.llm import url_filter as U
from stratalens.llm.queries import oracle_sql, op7_url_filter


def glob_regex(glob):
    parts = {"**": r"[\s\S]*", "*": r"[^/]*", "?": r"[\s\S]"}
    return re.compile("".join(parts.get(p, re.escape(p)) for p in re.findall(r"\*\*|\*|\?|[\s\S]", glob)))


def test_automaton_against_regexes():
    rng = random.Random(3)
    globs = ["".join(rng.choice("ab/.?***") for _ in range(rng.randint(0, 12))) for _ in range(120)]
    globs = [g.replace("****", "**").replace("***", "**") for g in globs]
    texts = ["".join(rng.choice("ab/.é") for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    hit = U.Automaton(globs).matches(texts)
    for j, g in enumerate(globs):
        r = glob_regex(g)
        assert [bool(r.fullmatch(t)) for t in texts] == hit[:, j].tolist(), g


def plain(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for _, rule in U.DOMAIN_RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append(rule)
    return host, path, max(fits, key=len, default=None)


def test_odd_urls(spark):
    urls = [None, "", "x", "http://", "http://net", "http://NET/", "http://a.Net/x://y", "ftp://EXAMPLE.net/en/", "http://example.net/en", "http://myexample.net/en/",
            "://org/fr/?a", "http://a.org?/fr/", "http://xorg/fr/", "http://é.ORG/fr/é", "http://a.com/x.net/", "http://a.example.com/de/x#y", "a\nb://c.net/\nd", "http://h/" + "x" * 50_000]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] * 2, "page_id long, url string, host string, rule string")
    big = spark.createDataFrame([(None, "http://a.net/"), (2**62 + 1, "http://b.net/")], "page_id long, url string")
    assert {r.page_id for r in U.digest(big).collect()} == {None, 2**62 + 1}
    got = U.digest(pages).collect()
    assert len(got) == 2 * len(urls)
    verdicts = {rule: v for v, rule in U.DOMAIN_RULES}
    for r in got:
        assert (r.host, r.path, r.rule) == plain(urls[r.page_id]), urls[r.page_id]
        assert r.verdict == verdicts.get(r.rule, "allow")
    assert U.digest(pages.where("false")).count() == 0


def test_whole_table(spark):
    same(op7_url_filter(spark, SF), oracle_sql()["op7_url_filter"], SF)
