import re

from lithoframe.llm import urlfilter


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash") for i, u, h in rows], "page_id long, url string, html string, verdict string")


def parse(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def rule(host, path):
    best = None
    for verdict, h, p in urlfilter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (verdict, h + p)
    return best


def brute(rows):
    own = [(i, *parse(u), h) for i, u, h in rows]
    hosts = sorted({h for _, h, _, _ in own if h})
    share = {}
    for h in hosts:
        fits = [rule(h, p) for _, g, p, _ in own if g == h]
        share[h] = tuple(sum(f is not None and f[0] == v for f in fits) / len(fits) for v in ("allow", "block"))
    links = {}
    for _, h, _, html in own:
        for m in re.finditer(r"""(?:href|src)\s*=\s*["']?(https?://[^"'\s>]+)""", html or ""):
            t = parse(m[1])[0]
            if h and t and t != h:
                links[h, t] = links.get((h, t), 0) + 1

    def walk(seed, edges):
        total = {}
        for (a, _), n in edges.items():
            total[a] = total.get(a, 0) + n
        score = {h: 0.5 * seed.get(h, 0.0) for h in set(hosts) | {x for e in edges for x in e}}
        base = dict(score)
        for _ in range(urlfilter.ROUNDS if edges else 0):
            nxt = dict(base)
            for (a, b), n in edges.items():
                nxt[b] = nxt.get(b, 0.0) + 0.5 * n / total[a] * score.get(a, 0.0)
            score = nxt
        return score

    trust = walk({h: s[0] for h, s in share.items()}, links)
    distrust = walk({h: s[1] for h, s in share.items()}, {(b, a): n for (a, b), n in links.items()})
    out = {}
    for i, h, p, _ in own:
        fit = rule(h, p)
        lead = distrust.get(h, 0.0) - trust.get(h, 0.0) if h else 0.0
        out[i] = (h, p, fit[1] if fit else None, fit[0] if fit else ("block" if lead >= 0.125 else "allow"))
    return out


URLS = [
    None, "", "no scheme", "http://", "HTTPS://WWW.Example.NET/en/x?y#z", "http://net/", "http://net", "http://a.net?x=/en/", "https://example.net/de/", "http://notexample.net/en/", "http://example.com/de", "http://m.example.com/de/1",
    "http://org/fr/", "http://x.org/fr/a#/en/", "http://x.org/FR/", "http://É.org/fr/é", "a://b://c/d", "http://example.net/en", "http://h:80/p\nq", "http://e.example.com/" + "p" * 50000, "x\ny://h.org/fr/",
]


def test_verdicts_equal_brute_force_with_and_without_links(spark):
    rows = list(enumerate(URLS))
    plain = [(i, u, None) for i, u in rows]
    bad, good = "http://spam.example.com/de/", "http://fine.example.net/en/"
    link = lambda *to: " ".join(f'<a href="{t}">x</a> <a href="/local">y</a>' for t in to)
    web = plain + [(100, bad, ""), (101, good, link("http://friend.org/a", "http://friend.org/a", bad)), (102, "http://feeder.org/a", link(bad) * 3), (103, "http://friend.org/b", None), (104, "http://far.org/", link("http://feeder.org/z")), (105, "http://only.com/x", link("http://unseen.com/"))]
    for table in (plain, web):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages(spark, table)).collect()}
        assert got == brute(table)
    assert brute(web)[102][3] == "block" and brute(web)[103][3] == "allow"


def test_empty_and_repeats(spark):
    assert urlfilter.judge(pages(spark, [])).count() == 0
    assert urlfilter.judge(pages(spark, [(1, "http://a.net/", None)] * 3)).count() == 3
