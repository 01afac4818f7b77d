"""Vector codes against plain assignment of every part to every entry."""

import hashlib
import math

import numpy as np
import pytest

from creditgrain.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, share int, n string"


@pytest.fixture(scope="module")
def table(spark):
    from creditgrain.llm.common import ship

    ship(spark)
    return lambda rows: spark.createDataFrame([(*r, "x", 7, "y") for r in rows], SCHEMA)


def plain(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[k * width : (k + 1) * width] for k in range(parts)] for _, v, _ in kept]
    books = [[c[k] for c in cut[:entries]] for k in range(parts)]

    def nearest(book, part):
        return min((sum((x - y) ** 2 for x, y in zip(part, e, strict=True)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for k in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(nearest(books[k], c[k])[1], []).append(c[k])
            for j, held in groups.items():
                books[k][j] = [sum(x) // len(held) for x in zip(*held, strict=True)]
    out, errors = [], {}
    for (i, _, label), c in zip(kept, cut, strict=True):
        found = [nearest(book, part) for book, part in zip(books, c, strict=True)]
        out.append((i, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), label))
        errors[label] = errors.get(label, 0) + out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((-1 if i is None else i, code, error, errors[label], sha) for i, code, error, label in out))


def got(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def vectors(n, width, seed, spread=1.0):
    draw = np.random.default_rng(seed)
    middle = draw.normal(0, 1, (9, width))
    return (middle[draw.integers(0, 9, n)] + draw.normal(0, spread, (n, width))).astype(np.float32).tolist()


def test_matches_plain_assignment(table):
    rows = [(i * 3, v, [0, 1, None][i % 3]) for i, v in enumerate(vectors(150, 8, 1, 0.3))]
    for limits in ({"entries": 16, "rounds": 4}, {"entries": 256, "rounds": 2}, {"entries": 5, "rounds": 0, "parts": 2}):
        df, books = vc.compress(table(rows), **limits)
        assert got(df) == plain(rows, **limits)
        back = vc.decode([r.code for r in df.orderBy("vec_id").collect()], books)
        whole = np.floor(np.array([v for _, v, _ in rows], np.float64) * 1024)
        assert ((whole - back) ** 2).sum(1).tolist() == [r.error for r in df.orderBy("vec_id").collect()]


def test_odd_rows(table):
    nan, inf = float("nan"), float("inf")
    base = [[0.5, -0.25, 0.001, -0.001], [0.0, 0.0, 0.0, 0.0], [0.5, -0.25, 0.001, -0.001], [3.0, 2.0, 1.0, 0.0]]
    rows = [(i, v, 1) for i, v in enumerate(base)] * 3 + [
        (None, base[0], 2),
        (None, base[3], None),
        (90, None, 1),
        (91, [nan, 0.0, 0.0, 0.0], 1),
        (92, [0.0, None, 0.0, 0.0], 1),
        (93, [0.0, 0.0, -inf, 0.0], 1),
        (-5, [9.0, 9.0, 9.0, 9.0], None),
    ]
    for limits in ({}, {"entries": 2}):
        assert got(vc.compress(table(rows), **limits)[0]) == plain(rows, **limits)
    empty = vc.compress(table([]))[0]
    assert empty.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"] and empty.count() == 0
    assert vc.compress(table([(1, None, 2)]))[0].count() == 0


@pytest.mark.parametrize("bad", [[(1, [0.0] * 8, 0), (2, [0.0] * 4, 0)], [(1, [0.0] * 6, 0)], [(1, [1e30] * 4, 0)]])
def test_vectors_that_cannot_be_cut_are_refused(table, bad):
    with pytest.raises(Exception, match="BadVector|components|beyond|differ in length"):
        vc.compress(table(bad))[0].collect()


def test_search_is_exact_and_measures_few_entries():
    draw = np.random.default_rng(2)
    for spread in (3, 40, 2000):
        entries = draw.integers(-spread, spread, (256, 4))
        entries[7] = entries[3]  # equal entries: the lower one
        parts = np.concatenate([entries[draw.integers(0, 256, 300)], draw.integers(-2 * spread, 2 * spread, (700, 4))])
        apart = ((parts[:, None] - entries) ** 2).sum(2)
        best, least = vc.Codebook.of(entries).nearest(parts)
        assert best.tolist() == apart.argmin(1).tolist() and least.tolist() == apart.min(1).tolist()


def test_hot_label_is_joined_once_a_row(table):
    rows = [(i, v, 3) for i, v in enumerate(vectors(500, 4, 5))]
    found = vc.compress(table(rows), entries=8)[0].collect()
    assert len(found) == 500 and {r.label_error for r in found} == {sum(r.error for r in found)}
