import collections
import itertools
import math
import random
import re

import pytest

from creditgrain.llm import url_rules

URLS = [
    (1, "https://WWW.Example.org/es/x?a=1"),
    (2, "http://m.example.org/en/17#top"),
    (3, "http://example.org?q"),
    (4, "ftp://a.com/fr/"),
    (5, "http://b.example.com/de/5.html"),
    (6, None),
    (7, "no scheme"),
    (8, "http://notexample.org/es/"),
    (9, "http://x.net/a://b/c"),
    (9, "http://x.net/a://b/c"),
    (None, "http://bad.net/spam/1"),
]


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [
        (h + p, says)
        for h, p, says in url_rules.RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return (host, path, *max(fits, key=lambda f: len(f[0]), default=(None, None)))


def test_rules_and_empty_tables(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = url_rules.filter_urls(pages, labels).collect()
    assert len(got) == len(URLS)
    key = lambda x: (x[0] or -1, x[1:3])
    expected = sorted(((i, *plain(u)) for i, u in URLS), key=key)
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in got), key=key) == expected
    assert all(r.verdict == "allow" for r in got if not r.rule)
    assert url_rules.filter_urls(pages.limit(0), labels).count() == 0


def test_mining_matches_brute_force(spark):
    pages = spark.createDataFrame(
        [(i, f"http://{'bad' if i % 3 == 0 else 'good'}.net/{'spam' if i % 2 else 'news'}/{i}") for i in range(60)],
        "page_id long, url string",
    )
    labels = spark.createDataFrame([(i, 0 if i % 3 == 0 else 1, None if i % 5 else 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_rules.filter_urls(pages, labels, confidence=0.9).collect()}
    assert all((got[i].verdict == "block") == (i % 3 == 0) for i in range(60))


def plain_rules(rows, support, confidence, telling):
    """All combinations of the tokens that may be combined, counted one by one."""
    total, blocked = len(rows), sum(b for _, b in rows)
    pages, on = collections.Counter(), collections.defaultdict(set)
    for k, (tokens, block) in enumerate(rows):
        pages.update(tokens)
        for t in tokens if block else ():
            on[t].add(k)
    alone = {}
    for t, where in on.items():
        if len(where) >= support:
            key = frozenset(where)
            alone[key] = min(alone.get(key, (pages[t], t)), (pages[t], t))
    share = {t: len(where) / n for where, (n, t) in alone.items()}
    candidates = collections.Counter()
    for tokens, block in rows:
        if block:
            told = sorted((t for t in tokens if t in share), key=lambda t: (-share[t], t))[:telling]
            for k in range(1, len(told) + 1):
                candidates.update(itertools.combinations(sorted(told), k))
    out = set()
    for rule, seen in candidates.items():
        if seen < support:
            continue
        held = [b for tokens, b in rows if set(rule) <= set(tokens)]
        n, p, z = len(held), sum(held) / len(held), url_rules.Z
        low = (p + z * z / (2 * n) - z * math.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)
        if sum(held) >= support and p >= confidence and low > blocked / total:
            out.add((rule, n, sum(held)))
    return out


@pytest.mark.parametrize(("support", "confidence", "telling"), [(4, 0.6, 10), (2, 0.5, 3), (3, 0.9, 6)])
def test_rules_and_matches_are_those_of_brute_force(spark, support, confidence, telling):
    draw = random.Random(4)
    rows = []
    for _ in range(250):
        tokens = sorted(set(draw.choices("abcdefghij", k=draw.randint(0, 6))))
        if "c" in tokens:
            tokens += ["c1", "c2"]  # always together
        rows.append((sorted(tokens), ("a" in tokens and "b" in tokens) or draw.random() < 0.15))
    labelled = spark.createDataFrame([(t, b, 7919 * k + 1) for k, (t, b) in enumerate(rows)], "tokens array<string>, block boolean, page long").cache()
    rules = url_rules.mine(labelled, support, confidence, telling).cache()
    got = {(tuple(r.rule), r.pages, r.blocked) for r in rules.collect()}
    assert got == plain_rules(rows, support, confidence, telling) and got
    matched = {tuple(r.tokens) for r in url_rules.match(labelled, rules).collect()}
    assert matched == {tuple(t) for t, _ in rows if any(set(r) <= set(t) for r, _, _ in got)}


def test_long_urls_end(spark):
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)]
    # twelve urls of 200 words, each without another one
    urls = [(i, "http://bad.net/" + "/".join(w for k, w in enumerate(words) if k != i)) for i in range(12)]
    urls += [(100 + i, f"http://good.net/{i}/{words[i]}x") for i in range(50)]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in urls], "page_id long, url string, tokens string, block int")
    labels = spark.createDataFrame([(i, int(i >= 100), 0) for i, _ in urls], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in url_rules.filter_urls(pages, labels).collect()}
    assert all((got[i] == "block") == (i < 100) for i, _ in urls)


def whole_rules(rows, support, confidence):
    """All telling combinations, without those that hold a token which tells alone."""
    total, blocked = len(rows), sum(b for _, b in rows)
    seen = collections.defaultdict(lambda: [0, 0])
    for tokens, block in rows:
        for k in range(1, len(tokens) + 1):
            for rule in itertools.combinations(sorted(tokens), k):
                seen[rule][0] += 1
                seen[rule][1] += block
    z, out = url_rules.Z, {}
    for rule, (n, hits) in seen.items():
        p = hits / n
        low = (p + z * z / (2 * n) - z * math.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)
        if hits >= support and p >= confidence and low > blocked / total:
            out[rule] = (n, hits)
    return {(r, *c) for r, c in out.items() if len(r) == 1 or not any((t,) in out for t in r)}


def test_rules_of_all_tokens_are_those_of_brute_force(spark):
    draw = random.Random(6)
    rows = []
    for _ in range(300):
        tokens = sorted(set(draw.choices("abcdefgh", k=draw.randint(0, 5))))
        rows.append((tokens, ("a" in tokens and "b" in tokens) or "h" in tokens or draw.random() < 0.05))
    labelled = spark.createDataFrame([(t, b, 7919 * k + 1) for k, (t, b) in enumerate(rows)], "tokens array<string>, block boolean, page long").cache()
    got = {(tuple(r.rule), r.pages, r.blocked) for r in url_rules.mine(labelled).collect()}
    assert got == whole_rules(rows, url_rules.SUPPORT, url_rules.CONFIDENCE) and any(len(r) > 1 for r, _, _ in got)


def test_a_pair_behind_many_more_telling_tokens_is_found(spark):
    """Two words block only together, on urls of 14 words each of which says more (before: left out after 10)."""
    others = [f"w{chr(97 + k)}" for k in range(14)]
    urls = [f"http://a{i}.net/x{chr(97 + i)}/" + "/".join(w for k, w in enumerate(others) if k % 6 != i) + "/spam/mails" for i in range(6)]
    labels = [0] * 6
    for k in range(60):
        urls += [f"http://b{k}.net/spam/only", f"http://c{k}.net/mails/only"]
        labels += [1, 1]
    for w in others:  # on five blocked pages and four others: not telling enough by itself
        urls += [f"http://d{k}.net/{w}" for k in range(4)]
        labels += [1] * 4
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, "http://z.net/spam/mails"])], "page_id long, url string")
    marks = spark.createDataFrame([(i, q, 0) for i, q in enumerate(labels)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in url_rules.filter_urls(pages, marks).collect()}
    assert got[len(urls)] == "block"
    assert all(got[i] == ("allow" if q else "block") for i, q in enumerate(labels))


def test_tokens_of_the_same_pages_are_one_item(spark):
    """Long urls, blocked and not, whose words always stand together; a url with some of the words counts too."""
    words = "/".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60))
    urls = [f"http://bad.net/{words}/odd" for _ in range(6)] + [f"http://good.net/{words}" for _ in range(6)] + [f"http://good.net/{i}/odd" for i in range(20)]
    pages = spark.createDataFrame([*enumerate(urls), (90, "http://new.net/waf/odd"), (91, "http://new.net/waf")], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 6), 0) for i in range(len(urls))], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in url_rules.filter_urls(pages, labels).collect()}
    assert all((got[i] == "block") == (i < 6) for i in range(len(urls)))
    assert got[90] == "block" and got[91] == "allow"
