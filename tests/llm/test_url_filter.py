"""Rules by hand; the models against plain Python."""

from __future__ import annotations

import math
from collections import defaultdict

import pytest

from schemalign.llm import url_filter

URLS = [
    "http://a.net/x", "https://EXAMPLE.net/en/1?q", "http://www.example.net/enx", "http://example.com/de/9", "http://m.example.org/fr/7#t",
    "http://org/fr/", "http://example.com/fr/3", "http://notexample.net", "//no", None, "", "ftp://", "http://x.y?z/net/", "http://a.com/en/1://b",
    "http://a.com/en/1", "http://a.com/en/1", "http://É.example.org/es/ä\nb",
]


def parted(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest[: min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))]
    path = rest[len(host) :]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def ruled(host, path):
    fits = []
    for rule, verdict in url_filter.RULES:
        domain, start = rule.split("/", 1)
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def plain(urls):
    n, size = url_filter.ORDER, url_filter.ORDER + 1
    rows = [(*parted(u), *ruled(*parted(u))) for u in urls]
    padded = ["\x02" * n + h + p + "\x03" for h, p, _, _ in rows]
    grams = [[t[i : i + size] for i in range(len(t) - n)] for t in padded]
    counts = {v: defaultdict(int) for v in ("allow", "block")}
    for gs, (_, _, _, v) in zip(grams, rows, strict=True):
        if v:
            for g in gs:
                for k in range(1, size + 1):
                    counts[v][g[size - k :]] += 1

    def likely(v, g):
        p = 1 / 256
        for k in range(1, size + 1):
            after = {x: c for x, c in counts[v].items() if len(x) == k and x[:-1] == g[size - k : -1]}
            if after:
                p = (counts[v].get(g[size - k :], 0) + len(after) * p) / (sum(after.values()) + len(after))
        return p

    scores = [round(sum(math.log(likely("block", g) / likely("allow", g)) for g in gs) / len(gs), 9) for gs in grams]
    spread = {}
    for v in counts:
        own = [s for s, r in zip(scores, rows, strict=True) if r[3] == v]
        mean = sum(own) / len(own)
        spread[v] = mean, math.sqrt(max(sum(s * s for s in own) / len(own) - mean * mean, 0))
    (low, ls), (high, hs) = spread["allow"], spread["block"]
    bound = round((low * hs + high * ls) / (ls + hs), 9)
    return [(h, p, r, v or ("block" if s > bound else "allow")) for (h, p, r, v), s in zip(rows, scores, strict=True)]


@pytest.mark.parametrize("limit", [url_filter.BROADCAST_GRAMS, 0])
def test_against_plain_models(rows, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "BROADCAST_GRAMS", limit)
    df = rows([(k, u, "clash") for k, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judge(df).collect()}
    assert got == dict(enumerate(plain(URLS)))
    assert got[1] == ("example.net", "/en/1", "example.net/en/", "allow") and got[2][2] == "net/" and got[7][2] is None


def test_no_examples(rows):
    df = rows([(1, "http://a.com/x"), (None, None)], "page_id long, url string")
    assert {tuple(r)[1:] for r in url_filter.judge(df).collect()} == {("a.com", "/x", None, "allow"), ("", "", None, "allow")}
    assert url_filter.judge(rows([], "page_id long, url string")).collect() == []


def test_plan_is_native(rows):
    df = url_filter.judge(rows([(1, "http://a.net/x"), (2, "http://b.org/fr/x")], "page_id long, url string"))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert not any(word in text for word in ("Python", "Pandas", "Arrow", "Cartesian"))
