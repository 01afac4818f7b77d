"""Every operator on odd rows, empty tables and the small sample, against plain Python."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from creditgrain.llm import (
    byte_bpe,
    context_mixing,
    decontamination,
    exact_dedup,
    language_gru,
    pairwise_quality,
    parity_join,
    substring_index,
    token_records,
)

DATA = "/root/testdata/sf0.001"


def sample(spark):
    from creditgrain.llm.common import table

    docs = table(spark, DATA, "documents")
    return docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def number(doc_id):
    return -1 if doc_id is None else doc_id


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def plain_groups(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * len(a | sets[j]):
                parent[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in groups.items()}
    return sorted(((number(rows[i][0]), len(sets[i]), number(least[root(i)])) for i in range(len(rows))))


def got_groups(df):
    return sorted((number(r.doc_id), r.n_shingles, number(r.component_id)) for r in df.collect())


def test_parity_join(spark, odd, odd_rows, empty):
    assert got_groups(parity_join.similar_groups(odd)) == plain_groups([r[:2] for r in odd_rows])
    assert parity_join.similar_groups(empty).count() == 0


def test_parity_join_of_near_copies(build):
    draw = random.Random(3)
    base = [f"w{draw.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(draw.randrange(5)):
            copy[draw.randrange(len(copy))] = f"x{i}"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, " ".join(base[:60] + [f"y{i}z{k}" for k in range(60)])) for i in range(20)]
    assert got_groups(parity_join.similar_groups(build(rows))) == plain_groups(rows)


def test_hamming_is_a_lower_bound():
    draw = np.random.default_rng(1)
    for _ in range(200):
        pool = draw.integers(0, 1 << 63, 400).astype(np.uint64)
        a, b = (np.unique(draw.choice(pool, draw.integers(1, 300))) for _ in range(2))
        difference = len(np.setxor1d(a, b))
        assert parity_join.hamming(parity_join.short_sketch(a), parity_join.short_sketch(b)) <= difference


def plain_removal(rows, window=20):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                gone[s : s + window] = [True] * window
            seen.add(k)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((number(doc_id), len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [2000, 1])
def test_substring_dedup(spark, odd, odd_rows, empty, monkeypatch, hot):
    monkeypatch.setattr(substring_index, "HOT", hot)
    monkeypatch.setattr(substring_index, "HOT_SHARE", 0)
    monkeypatch.setattr(substring_index, "SHARD_WORDS", 500)
    docs, rows = sample(spark)
    for df, plain in ((odd, [r[:2] for r in odd_rows]), (docs, rows)):
        got = sorted((number(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_index.remove_repeats(df).collect())
        assert got == plain_removal(plain)
    assert substring_index.remove_repeats(empty).count() == 0


def test_fm_index_counts_and_statistics():
    draw = np.random.default_rng(4)
    text = draw.integers(1, 5, 3000)
    text[::50] = 0
    index = substring_index.FMIndex(text, 4)
    patterns = draw.integers(1, 6, (500, 4))
    matched, low, high = index.search(patterns)
    whole = text.tolist()
    for p, m, a, b in zip(patterns.tolist(), matched.tolist(), low.tolist(), high.tolist(), strict=True):
        longest = next(k for k in range(4, -1, -1) if k == 0 or any(whole[i : i + k] == p[4 - k :] for i in range(len(whole) - k + 1)))
        assert m == longest
        if m == 4:
            places = [i for i in range(len(whole) - 3) if whole[i : i + 4] == p]
            assert sorted(index.suffixes[a:b].tolist()) == places and index.suffixes[a] == places[0]


def test_exact_dedup(odd, empty):
    for limits in ({}, {"capacity": 1, "max_depth": 6}):
        got = {(r.doc_id, r.row): r for r in exact_dedup.exact_dedup(odd, **limits).collect()}
        assert len(got) == 16
        by_id = collections.defaultdict(list)
        for (doc_id, _), r in got.items():
            by_id[doc_id].append(r)
        assert {(r.keep_id, r.group_size) for d in (1, 2) for r in by_id[d]} == {(2, 3)}
        assert sum(r.kept for d in (1, 2) for r in by_id[d]) == 1
        assert by_id[3][0].keep_id == 4 and by_id[3][0].group_size == 2
        assert by_id[None][0].kept and by_id[None][0].keep_id is None
        assert by_id[6][0].text_sha256 != by_id[7][0].text_sha256
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_directory_doubles():
    slots = exact_dedup.directory({0: 5, 1: 5, 7: 1}, capacity=6, max_depth=3)
    assert len(slots) == 8 and len(set(slots[:2])) == 2 and len(set(slots[4:])) == 1
    assert len(exact_dedup.directory({}, 4, 3)) == 1


def plain_tokens(text):
    import tiktoken

    bpe = byte_bpe.load(public_tokenizers.path(byte_bpe.RANKS))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    return known.encode_ordinary(text or "")


def test_byte_bpe(odd, odd_rows, empty):
    got = {r.doc_id: r for r in byte_bpe.bpe_round_trip(odd, keep_ids=True).collect()}
    for doc_id, text, _ in odd_rows:
        ids = plain_tokens(text)
        assert got[doc_id].ids == ids and got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert byte_bpe.bpe_round_trip(empty).count() == 0


def test_byte_bpe_random_strings_and_edits():
    bpe = byte_bpe.load(public_tokenizers.path(byte_bpe.RANKS))
    draw = random.Random(1)
    letters = "aábc's \n\t\r\x1c\x85\u00a0'tre0123!?.中é\u3000 😀 "
    for _ in range(3000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 25)))
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == plain_tokens(text)
    for _ in range(500):
        piece = bytes(draw.choice(b"abcdehilnorst\xc3\xa9") for _ in range(draw.randint(2, 90)))
        known = byte_bpe.PrefixTable(bpe, piece)
        low = draw.randint(0, len(piece))
        high = draw.randint(low, len(piece))
        known.edit(low, high, b"the")
        fresh = byte_bpe.PrefixTable(bpe, piece[:low] + b"the" + piece[high:])
        assert (known.last, known.bytes) == (fresh.last, fresh.bytes)
        known.append(b"ing")
        assert known.tokens() == byte_bpe.PrefixTable(bpe, known.bytes).tokens()


def test_new_words_of_a_block_are_encoded_together(monkeypatch):
    """None goes through a table of its own; words met again outlive a full memo."""
    bpe = byte_bpe.ByteBPE(public_tokenizers.path(byte_bpe.RANKS))
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice([*"abdeghilnorstuwáßñ日"], rng.integers(1, 14))) + ("", ",", ".", "$$$", "'s", "7")[k % 6] for k in range(600)]
    texts = [" ".join(words[k : k + 30]) for k in range(0, 600, 20)] + ["  ".join(words[:40]), "", " ", "x" * 200]
    parts = [bpe.split.findall(t) for t in texts]
    expected = [b"".join(np.array(bpe.encode_piece(p.encode()), "<u4").tobytes() for p in found) for found in parts]
    asked, one = [], byte_bpe.ByteBPE.encode_piece
    monkeypatch.setattr(byte_bpe.ByteBPE, "encode_piece", lambda self, piece: asked.append(piece) or one(self, piece))
    assert bpe.encode_all(texts) == expected
    assert not [p for p in asked if p.startswith(b" ")]  # but first words of a text, and very long ones
    bpe.encode_all(texts[:1])
    bpe.after_space.forget()
    assert set(bpe.after_space) == set(words[1:30])
    assert bpe.encode_all(texts) == expected


def test_token_records(odd, odd_rows, empty):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(public_tokenizers.path(token_records.VOCABULARY))
    got = sorted((r.start, number(r.doc_id), r.n_tokens, r.ids_crc32) for r in token_records.read_records(token_records.write_records(odd)).collect())
    start, expected = 0, []
    for doc_id, text, _ in sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = known.encode(text or "", add_special_tokens=False).ids + [1]
        expected.append((start, number(doc_id), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == expected
    assert token_records.read_records(token_records.write_records(empty)).count() == 0


def test_marks_after_a_word_are_no_new_word(monkeypatch):
    """Before: only one mark of six was told from its word; others were encoded with each word."""
    from tokenizers import Tokenizer

    words = [b + m for b in ("heat", "ñandú", "straße", "don't", "a1", "x—", "e\u0301", "") for m in ("", ".", "***", "$$$", ".***", "'", "'s", "_", "%,%", "§", "!é")]
    path = public_tokenizers.path(token_records.VOCABULARY)
    known = Tokenizer.from_file(path)
    asked = []
    whole = token_records._Words.one_by_one
    monkeypatch.setattr(token_records, "_loaded", {})
    monkeypatch.setattr(token_records._Words, "one_by_one", lambda self, words: asked.extend(words) or whole(self, words))
    packed, kind = token_records.encode([" ".join(words).encode(), *[w.encode() for w in words]], path)
    expected = [known.encode(t, add_special_tokens=False).ids + [token_records.END_ID] for t in (" ".join(words), *words)]
    assert [np.frombuffer(p, kind).tolist() for p in packed] == expected
    assert b"***" in asked and b"heat***" not in asked and "ñandú.***".encode() not in asked and b"don't***" in asked


def test_words_are_remembered_up_to_a_size_in_bytes(monkeypatch):
    """Not up to a number of words, which may be long."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_records.VOCABULARY)
    known = Tokenizer.from_file(path)
    monkeypatch.setattr(token_records, "_loaded", {})
    monkeypatch.setattr(token_records, "CACHED_BYTES", 100_000)
    for block in range(20):
        texts = [f"{block}-{k}-" + "x1y" * 500 for k in range(20)]
        packed, kind = token_records.encode([t.encode() for t in texts], path)
        assert [np.frombuffer(p, kind).tolist() for p in packed] == [known.encode(t, add_special_tokens=False).ids + [token_records.END_ID] for t in texts]
        memo = token_records._loaded[path]
        held = sum(len(word) + len(ids) for word, ids in memo.items())
        assert held <= memo.held <= 100_000 + sum(map(len, texts)) + sum(map(len, packed)) + token_records.ENTRY_BYTES * len(texts)


def test_token_records_of_added_tokens(build):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(public_tokenizers.path(token_records.VOCABULARY))
    texts = ["one <|endoftext|> two", "<|startoftext|>", "<|ENDOFTEXT|> x", "a <|endoftext|>b<|endoftext|>", "<|endof text|>", "plain"]
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_records.read_records(token_records.write_records(build(list(enumerate(texts))))).collect()}
    for k, text in enumerate(texts):
        ids = known.encode(text, add_special_tokens=False).ids + [1]
        assert got[k] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_broken_records_are_refused():
    (frame,) = token_records.frames([7], [np.arange(5, dtype="<u2").tobytes()], 2)
    index = np.array([[0, len(frame)]])
    ids, tokens = token_records.parse_frames(frame, index)
    assert ids == [7] and tokens[0].tolist() == [0, 1, 2, 3, 4]
    for at in range(len(frame)):
        broken = frame[:at] + bytes([frame[at] ^ 1]) + frame[at + 1 :]
        with pytest.raises(token_records.BrokenRecord):
            token_records.parse_frames(broken, index)


def test_decontamination(spark, odd, empty):
    from creditgrain.llm.common import table

    items = spark.createDataFrame(
        [(1, "THEN it sleeps."), (2, " ".join(f"shared{i}" for i in range(5, 40))), (3, None), (4, ""), (None, "one two"), (5, "not in any document of these at all")],
        "item_id long, text string",
    )
    got = {(r.doc_id, r.item_id) for r in decontamination.contained_items(odd, items).collect()}
    assert got == {(1, 1), (2, 1), (8, 2), (9, 2), (10, 2)}
    assert decontamination.contained_items(empty, items).count() == 0
    assert decontamination.contained_items(odd, items.limit(0)).count() == 0
    docs, rows = sample(spark)
    bench = table(spark, DATA, "benchmark")
    expected = set()
    wanted = [(r.item_id, shingles(r.text)) for r in bench.collect()]
    for doc_id, text in rows:
        have = shingles(text)
        expected |= {(doc_id, i) for i, s in wanted if s and len(s & have) >= 0.8 * len(s)}
    assert {(r.doc_id, r.item_id) for r in decontamination.contained_items(docs, bench).collect()} == expected


def test_context_mixing(odd, odd_rows, empty):
    counts = collections.Counter()
    for doc_id, text, _ in odd_rows:
        if zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 != 2:
            counts.update([*words(text), None])
    total, distinct = sum(counts.values()), len(counts)
    for r in context_mixing.mixing_scores(odd).collect():
        text = next(t for d, t, _ in odd_rows if d == r.doc_id)
        tokens = [*words(text), None]
        base = sum(math.log10((counts.get(w, 0) + 1) / (total + distinct + 1)) for w in tokens)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[w] > 0 for w in tokens), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.score < 0
    assert context_mixing.mixing_scores(empty).count() == 0


def test_context_mixing_learns_and_is_a_distribution(spark):
    docs, rows = sample(spark)
    size = {d: len((t or "").encode()) + 1 for d, t in rows}
    got = context_mixing.mixing_scores(docs).collect()
    held = [r for r in got if r.held_out]
    assert sum(r.bits for r in held) / sum(size[r.doc_id] for r in held) < 3.2  # bits a byte; 8 without a model
    windows = np.array([(b"abcde"[k % 5] << 8) | byte for k in range(1) for byte in range(256)], np.uint64)
    model = context_mixing.MixedModel.start(np.zeros((context_mixing.CONTEXTS, 1 << context_mixing.SLOT_BITS), np.uint32))
    model.learn(windows[:64], np.ones(64, np.int64))
    assert math.isclose((2.0 ** -model.bits(windows)).sum(), 1, rel_tol=1e-4)


def test_language(spark, odd, empty):
    docs, _ = sample(spark)
    got = language_gru.language_of(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.9 * len(got)
    found = {r.doc_id: r for r in language_gru.language_of(odd).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (3, 4, 5, 11))
    assert all(0 <= r.score <= 1 for r in found.values())
    assert language_gru.language_of(empty).count() == 0


def test_language_gradient():
    draw = np.random.default_rng(3)
    cell = language_gru.Direction(draw.normal(0, 0.5, (3, 256, 3)), draw.normal(0, 0.5, (3, 3, 3)))
    x, toward = draw.integers(97, 100, (6, 4)).astype(np.uint8), draw.normal(size=(6, 4, 3))
    alive = np.full(6, 4)
    states = cell.run(x, alive).astype(np.float64)
    slope = cell.learn(x, states, toward)
    for name, at in (("state", (0, 1, 2)), ("state", (1, 0, 0)), ("state", (2, 2, 1)), ("byte", (0, 97, 1)), ("byte", (2, 98, 2))):
        values, step = getattr(cell, name), 1e-2
        values[at] += step
        more = (cell.run(x, alive) * toward).sum()
        values[at] -= 2 * step
        less = (cell.run(x, alive) * toward).sum()
        values[at] += step
        assert math.isclose((more - less) / (2 * step), getattr(slope, name)[at], rel_tol=0.03, abs_tol=2e-3)


def test_quality(spark, odd, empty):
    from creditgrain.llm.common import table

    docs, _ = sample(spark)
    labels = table(spark, DATA, "labels")
    got = pairwise_quality.pairwise_quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.9 * len(got)
    kept = pairwise_quality.accepted(docs, labels)
    assert kept.columns == docs.columns
    few = spark.createDataFrame([(1, 1), (None, 0), (99, 0), (3, None)], "doc_id long, quality int")
    scores = pairwise_quality.pairwise_quality(odd, few).collect()
    assert len(scores) == 16 and all(0 <= r.score <= 1 and r.predicted == 1 for r in scores)
    assert pairwise_quality.pairwise_quality(empty, few).count() == 0


def test_quality_cut_covers_all_labelled_rows(spark, build):
    import random

    import numpy as np
    from pyspark.sql import functions as F

    from creditgrain.llm.common import crc_fold

    draw = random.Random(3)
    # Labels by chance, so that the scores of the two classes overlap.
    rows = [(i, " ".join(f"w{draw.randrange(900)}" for _ in range(draw.randrange(20, 90)))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(draw.random() > 0.15)) for i in range(400)], "doc_id long, quality int")
    training = labels.where(crc_fold(F.col("doc_id"), 4) != 2)
    bad = training.where("quality = 0").count()
    # The sample has as many good as bad rows, the table many more good ones.
    got = pairwise_quality.pairwise_quality(build(rows), labels, per_label=20).where("not held_out").collect()
    assert 20 < bad < len(got) / 4
    assert sum(r.predicted == 0 for r in got) == bad

    values = np.array([-3.5, -3.5, -0.0, 0.0, 1e-300, 2.0, 2.0, 2.0, 7.25, -1e9])
    keys = spark.createDataFrame([(int(k),) for k in pairwise_quality.sort_keys(values)], "key long")
    assert pairwise_quality.values_at(keys, list(range(10))).tolist() == np.sort(values).tolist()


def test_quality_sample_ranks_few_rows(spark, build):
    from pyspark.sql import functions as F

    ids = spark.range(40_000).select(F.col("id").alias("doc_id"), (F.col("id") % 4 > 0).cast("int").alias("quality"))
    left = pairwise_quality.smallest_hashes(ids, 30).withColumn("hash", F.xxhash64("doc_id")).collect()
    rows = ids.withColumn("hash", F.xxhash64("doc_id")).collect()
    for label in (0, 1):
        first = sorted(r.hash for r in rows if r.quality == label)[:30]
        got = sorted(r.hash for r in left if r.quality == label)
        assert got[:30] == first and len(got) < 40
    assert pairwise_quality.smallest_hashes(ids.limit(0), 30).count() == 0


def test_shuffle_files_of_a_finished_step_go_before_the_next(odd, monkeypatch):
    """Before: those of the part counts and of the repeated keys lay beside the members'."""
    done = []
    monkeypatch.setattr(parity_join, "sweep", lambda spark: done.append("sweep"))
    stored = parity_join.store
    monkeypatch.setattr(parity_join, "store", lambda df, name: done.append(name) or stored(df, name))
    parity_join._Join(parity_join.numbered_texts(odd))
    assert done[-7:] == ["sweep", "sets", "sweep", "members", "sweep", "nodes", "documents"]
