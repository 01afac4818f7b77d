"""Phrase mining against plain Python; the query itself is compared with its SQL."""

import collections
import random
import re

import numpy as np
import pytest

from creditgrain.llm import collocations as co

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, support, longest=5, percent=100, top=2000):
    counts, totals = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LETTERS)):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, words[i : i + k]] += 1
    frequent = {p: a for p, a in counts.items() if a >= support}
    out = []
    for (lang, words), a in frequent.items():
        if len(words) < 2:
            continue
        inside = False
        for (other, longer), f in frequent.items():
            if other == lang and len(longer) > len(words) and 100 * f >= percent * a:
                inside |= any(longer[i : i + len(words)] == words for i in range(len(longer) - len(words) + 1))
        if inside:
            continue
        n = totals[lang]
        score, _, l, r = min(
            (1000 * a * n // (counts[lang, words[:k]] * counts[lang, words[k:]]), k, counts[lang, words[:k]], counts[lang, words[k:]])
            for k in range(1, len(words))
        )
        out.append((lang, score, a, " ".join(words), l, r, n))
    ranked = []
    for lang in sorted({x[0] for x in out}):
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[1], -x[2], x[3].encode()))
        ranked += [(lang, k, p, a, l, r, n, s) for k, (_, s, a, p, l, r, n) in enumerate(own[:top], 1)]
    return ranked


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(8)
    words = [f"w{k}" for k in range(12)] + ["New", "york", "é", "tab x", "a'b"]
    fixed = ["new York city hall here", "one two", "é é é", "w1 w2 w3 w4 w5 w6"]
    made = []
    for i in range(300):
        parts = [draw.choice(fixed) if draw.random() < 0.4 else " ".join(draw.choices(words, k=draw.randint(1, 9))) for _ in range(6)]
        text = "".join(p + draw.choice([". ", ", ", " ", "\t", "\n", "!?", "\r\n", "  "]) for p in parts)
        made.append((i, text, draw.choice(["en", "en", "en", "de", None])))
    return made


@pytest.mark.parametrize(("support", "percent", "top", "longest"), [(20, 100, 2000, 5), (5, 80, 7, 5), (8, 50, 30, 3), (10**6, 100, 5, 5)])
def test_matches_plain_python(build, rows, support, percent, top, longest):
    found = co.collocations(build(rows), support, longest, percent, top, ranked=40)
    assert got(found) == plain(rows, support, longest, percent, top)


def test_odd_rows(odd, odd_rows, empty):
    assert got(co.collocations(odd, support=2)) == plain(odd_rows, 2)
    assert got(co.collocations(empty)) == []


def test_repeated_rows_and_one_language(build):
    rows = [(7, "salt and pepper, salt and pepper", None)] * 60 + [(8, "salt or pepper.", "und")] * 9
    assert got(co.collocations(build(rows), support=50)) == plain(rows, 50)


def test_blocks_change_nothing(build, rows, monkeypatch):
    monkeypatch.setattr(co, "BLOCK", 300)
    assert got(co.collocations(build(rows), 20)) == plain(rows, 20)


def test_equal_keys_start_again(build, rows, monkeypatch):
    salts, right = [], co._one_each

    def once(frequent):
        salts.append(1)
        if len(salts) == 2:
            raise co.SameKey
        return right(frequent)

    monkeypatch.setattr(co, "_one_each", once)
    assert got(co.collocations(build(rows), 20)) == plain(rows, 20)
    assert len(salts) > 3


def test_relation_records_keep_their_places():
    position, keys, which = np.array([1, 2, 3, 9, 10]), np.array([5, 7], np.uint64), np.array([0, 1, 1, 0, 1])
    ((again, held, number),) = co.records([co.kept_record(position, keys, which, np.array([False, True]))])
    assert again.tolist() == [2, 3, 10] and held.tolist() == [7] and number.tolist() == [0, 0, 0]
    at, left, right = co.neighbours(position, which)
    assert (at.tolist(), left.tolist(), right.tolist()) == ([1, 2, 9], [0, 1, 0], [1, 1, 1])
    for kind in (np.array([], np.int64), np.array([4])):
        ((again, *_),) = co.records([co.record(kind, keys, np.zeros(len(kind), np.int64))])
        assert again.tolist() == kind.tolist()


def test_filter_lets_all_its_keys_through(spark):
    keys = co.salted(np.arange(3000, dtype=np.uint64), 0)
    held = co.Filter.of(spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "key long"), 3000)
    assert held.holds(keys).all()
    assert held.holds(co.salted(np.arange(10**5, dtype=np.uint64), 1)).mean() < 0.01
