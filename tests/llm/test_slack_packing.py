"""Packing: every piece once, no gaps or overlaps, and nearly as few bins as can be."""

import collections
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from creditgrain.llm import slack_packing as sp
from creditgrain.llm.common import table
from creditgrain.session import store

DATA = "/root/testdata/sf0.01"


def plain_pieces(rows, size):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(public_tokenizers.path(sp.VOCABULARY))
    out = []
    for doc_id, text in rows:
        ids = known.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), size)):
            part = ids[at : at + size]
            out.append((-1 if doc_id is None else doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out)


def check(rows, size):
    """Sequences are gapless from 0 and within ``size``; returns their number."""
    held = collections.defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(held)


def got_pieces(rows):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)


@pytest.mark.parametrize("size", [2048, 16, 1])
def test_odd_rows(odd, odd_rows, empty, size):
    rows = sp.pack_documents(odd, size).collect()
    assert got_pieces(rows) == plain_pieces([r[:2] for r in odd_rows], size)
    used = check(rows, size)
    assert used >= -(-sum(r.length for r in rows) // size)
    assert sp.pack_documents(empty, size).count() == 0


def test_whole_sample_is_packed_to_the_bound(spark):
    docs = table(spark, DATA, "documents")
    rows = sp.op12_slack_packing(spark, DATA).collect()
    assert got_pieces(rows) == plain_pieces([(r.doc_id, r.text) for r in docs.collect()], 2048)
    bound = -(-sum(r.length for r in rows) // 2048)
    assert check(rows, 2048) <= bound + 1


def test_blocks_change_no_packing(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    pieces = store(sp.cut_pieces(docs, 64), "pieces")
    one, many = (sp.pack(pieces, 64, block_rows=n).collect() for n in (10**6, 3))
    assert got_pieces(one) == got_pieces(many) and check(one, 64) == check(many, 64)


def test_one_length_for_all(spark):
    pieces = store(spark.range(5000).selectExpr("id % 7 as doc_id", "cast(0 as int) as piece", "0L as start", "3L as length", "id as ids_crc32"), "pieces")
    rows = sp.pack(pieces, 10, block_rows=100).collect()
    assert len(rows) == 5000 and check(rows, 10) == -(-5000 // 3)


def test_lengths_are_counted_once_and_batches_are_small(spark):
    """Before: once for the plan and again for the places, with batches of 16 MB of text in every executor."""
    packed = sp.op12_slack_packing(spark, "/root/testdata/sf0.001")
    assert "HashAggregate" not in packed._jdf.queryExecution().sparkPlan().toString()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 1 << 22


def test_fullest_is_exact():
    draw = random.Random(5)
    for _ in range(300):
        counts = {draw.randint(1, 30): draw.randint(1, 4) for _ in range(draw.randint(0, 5))}
        room = draw.randint(0, 60)
        chosen = sp.fullest(counts, room)
        assert all(0 < k <= counts[n] for n, k in chosen.items())
        sums = {
            sum(n * k for n, k in zip(counts, take, strict=True))
            for take in itertools.product(*[range(c + 1) for c in counts.values()])
        }
        assert sum(n * k for n, k in chosen.items()) == max(s for s in sums if s <= room)


def test_plan_uses_every_piece_in_few_steps():
    draw = random.Random(6)
    counts = {n: draw.randint(0, 10**9) for n in range(1, 2049)}
    planned = sp.plan(counts)
    used = collections.Counter()
    for bins, chosen in planned:
        assert bins > 0 and sum(n * k for n, k in chosen.items()) <= 2048
        for n, k in chosen.items():
            used[n] += bins * k
    assert used == collections.Counter({n: c for n, c in counts.items() if c})
    assert len(planned) < 20_000
    # Neither the tokens nor the pieces of over half a bin fit into fewer.
    bound = max(-(-sum(n * c for n, c in counts.items()) // 2048), sum(c for n, c in counts.items() if n > 1024))
    assert sum(b for b, _ in planned) <= bound * 1.005
    assert sp.plan({}) == []
