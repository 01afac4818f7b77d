"""Byte-level BPE by dynamic programming over prefixes.

The BPE encoding of every prefix of a piece ends in exactly one token. The table
keeps that token for each prefix: a vocabulary entry ending at a position is the
one if it may follow the last token of the prefix before it, which is so when
the merges of both, undone step by step, never meet a pair that BPE would have
merged earlier. Reading the table backwards gives the encoding. A prefix never
changes when bytes are appended, and after an edit only the entries up to the
point where the table agrees with the old one again are computed.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from struct import pack

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import id_and_text, release, table, text_blocks

RANKS = "byte_bpe_multi_50k.tiktoken"
CACHED_BYTES = 1 << 27  # of encodings, about, that a task remembers of a kind before it drops those met once
KEPT_BYTES = 1 << 25  # and that a worker keeps for its next task
ENTRY_BYTES = 200  # of an entry besides its texts
TOGETHER_BYTES = 64  # of pieces whose tables are made together
KNOWN_PLACES = 20  # log2 of the entries that they look up as arrays
PLAIN_ENDS = (",", ".", "!", "?", ";", ":")
TWO_SPACES = re.compile(r"\s\s")


class ByteBPE:
    """A rank file as tiktoken reads it, with the rule for which tokens may stand side by side."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.token = dict(zip(self.ranks.values(), self.ranks, strict=True))
        self.longest = max(map(len, self.ranks))
        self.split = regex.compile(pattern)
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for body, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            self.halves[rank] = (rank, rank)
            for cut in range(1, len(body)):
                left, right = self.ranks.get(body[:cut]), self.ranks.get(body[cut:])
                if left is None or right is None or max(left, right) >= rank:
                    continue
                if self.may_follow(left, right):
                    self.halves[rank] = (left, right)
                    self.merged[left, right] = rank
                    break
        self.starts = {body[:k] for body in self.ranks for k in range(len(body) + 1)}
        self.state_names, self.state_of = [b""], {b"": 0}
        self.ending_here: list[list[tuple[int, int]]] = [[]]
        self.step = _Steps(self)
        self.pairs, self.pieces = _Pairs(self), _Pieces(self)
        self.after_space, self.alone = _Memo(self, " "), _Memo(self, "")
        self.tables = _Tables(self)

    def forget(self) -> None:
        """Drop encodings beyond ``KEPT_BYTES``: workers go on to other tasks."""
        for memo in (self.pairs, self.pieces, self.after_space, self.alone):
            if memo.held > KEPT_BYTES:
                memo.forget()
            if memo.held > KEPT_BYTES:
                memo.forget()  # nothing was met again since
        release()

    def may_follow(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' bytes gives the two tokens again."""
        limit, merged, halves = 1 << 60, self.merged, self.halves
        while True:
            if merged.get((left, right), limit) < limit:
                return False
            # Undo the later merge; at equal ranks the left one came first.
            undo_left = left > right
            inner = halves[left][1] if undo_left else halves[right][0]
            if inner == (left if undo_left else right):
                undo_left = not undo_left
                inner = halves[left][1] if undo_left else halves[right][0]
                if inner == (left if undo_left else right):
                    return True
            if undo_left:
                limit, left = left, inner
            else:
                limit, right = right + 1, inner

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else PrefixTable(self, piece).tokens()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The same for each of the texts, whose new words are encoded together."""
        # Without a run of white space the pattern never matches across the front of a space.
        taken = [(True, self.split.findall(t)) if TWO_SPACES.search(t) else (False, t.split(" ")) for t in texts]
        self.learn(
            {w for by_pattern, words in taken if not by_pattern for w in words[1:]},
            {p for by_pattern, found in taken if by_pattern for p in found},
        )
        out = []
        for by_pattern, words in taken:
            if by_pattern:
                out.append(b"".join(map(self.pieces.__getitem__, words)))
            else:
                out.append(self.alone[words[0]] + b"".join(map(self.after_space.__getitem__, words[1:])))
        return out

    def learn(self, words: set[str], pieces: set[str]) -> None:
        """Have the memos know these words after a space, and these matches of the pattern."""
        for memo in (self.after_space, self.pieces):
            if memo.held > CACHED_BYTES:
                memo.forget()
        asked, words = words, words.difference(self.after_space)
        self.after_space.met |= asked - words
        letters = {w for w in words if w.isalpha()}  # one match
        marked = {w for w in words if w[-1:] in PLAIN_ENDS and w[:-1].isalpha()}  # two matches
        taken = {w: self.split.findall(" " + w) for w in words.difference(letters, marked)}
        letters |= {w[:-1] for w in marked}.difference(self.after_space)
        pieces = pieces.union(*taken.values()).difference(self.pieces)
        new = list({*[(" " + w).encode() for w in letters], *[p.encode() for p in pieces]})
        ids = dict(zip(new, self.encode_together(new), strict=True))
        self.pieces.keep({p: ids[p.encode()] for p in pieces})
        self.after_space.keep({w: ids[(" " + w).encode()] for w in letters})
        self.after_space.keep({w: self.after_space[w[:-1]] + self.pieces[w[-1]] for w in marked})
        self.after_space.keep({w: b"".join([self.pieces[p] for p in found]) for w, found in taken.items()})

    def encode_together(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, from tables that go on byte by byte together."""
        out: dict[bytes, bytes] = {}
        groups: dict[int, list[bytes]] = {}
        for piece in pieces:
            whole = self.ranks.get(piece)
            if whole is not None:
                out[piece] = pack("<I", whole)
            elif len(piece) > TOGETHER_BYTES:
                out[piece] = pack(f"<{len(ids := self.encode_piece(piece))}I", *ids)
            else:
                groups.setdefault(len(piece), []).append(piece)
        for group in groups.values():
            out.update(zip(group, self.tables.encode(group), strict=True))
        return [out[piece] for piece in pieces]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Steps(dict):
    """Moves of an automaton whose state is the longest end of the text that some token starts with.

    A state knows the tokens that end with it, longest first. Moves are made
    when first needed; there are at most as many as token beginnings times bytes.
    """

    def __init__(self, bpe: ByteBPE):
        self.bpe = bpe

    def __missing__(self, move: int) -> int:
        bpe = self.bpe
        name = bpe.state_names[move >> 8] + bytes([move & 255])
        while name not in bpe.starts:
            name = name[1:]
        state = bpe.state_of.get(name)
        if state is None:
            bpe.state_of[name] = state = len(bpe.state_names)
            bpe.state_names.append(name)
            ends = ((len(name) - k, bpe.ranks.get(name[k:])) for k in range(len(name)))
            bpe.ending_here.append([(n, r) for n, r in ends if r is not None and (n == 1 or bpe.halves[r][0] != r)])
        self[move] = state
        return state


class _Memo(dict):
    """Encodings already worked out. When full, only those ``met`` again stay, if they are not
    too many themselves, which changes no result."""

    def __init__(self, bpe: ByteBPE, before: str = ""):
        self.bpe, self.before, self.held, self.met = bpe, before, 0, set()

    def __missing__(self, key):
        if self.held > CACHED_BYTES:
            self.forget()
        self[key] = out = self.work(key)
        self.held += ENTRY_BYTES + self.texts(key, out)
        return out

    def keep(self, found: dict) -> None:
        self.update(found)
        self.held += ENTRY_BYTES * len(found) + sum(map(len, found)) + sum(map(len, found.values()))

    def forget(self) -> None:
        kept = {key: self[key] for key in self.met if key in self}
        for entries in (kept, {}):
            self.clear()
            self.held, self.met = 0, set()
            self.keep(entries)
            if 2 * self.held <= CACHED_BYTES:
                break

    def texts(self, key: str, out: bytes) -> int:
        return len(key) + len(out)

    def work(self, text: str) -> bytes:
        pieces = self.bpe.pieces
        if text.isalpha():  # letters only: one match
            return pieces[self.before + text]
        if text[-1:] in PLAIN_ENDS and text[:-1].isalpha():  # and one mark: two matches
            return self[text[:-1]] + pieces[text[-1]]
        return b"".join([pieces[m] for m in self.bpe.split.findall(self.before + text)])


class _Pieces(_Memo):
    def work(self, piece: str) -> bytes:
        return pack(f"<{len(ids := self.bpe.encode_piece(piece.encode()))}I", *ids)


class _Pairs(_Memo):
    def work(self, pair: int) -> bool:
        return self.bpe.may_follow(pair >> 32, pair & 0xFFFFFFFF)

    def texts(self, pair: int, out: bool) -> int:
        return 0


class _Known:
    """Values of a memo with integer keys, as arrays: each key has one place, which it may lose to another."""

    def __init__(self, memo: dict, kind: type):
        self.memo = memo
        self.keys, self.values = np.full(1 << KNOWN_PLACES, -1, np.int64), np.zeros(1 << KNOWN_PLACES, kind)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        place = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - KNOWN_PLACES)).astype(np.int64)
        values = self.values[place]
        missing = np.flatnonzero(self.keys[place] != keys)
        if len(missing):
            new = keys[missing]
            values[missing] = [self.memo[key] for key in new.tolist()]
            self.keys[place[missing]] = new
            # of keys with one place the last one has it, key and value alike
            self.values[place[missing]] = values[missing]
        return values


class _Tables:
    """Prefix tables of pieces of one length, a row each."""

    def __init__(self, bpe: ByteBPE):
        self.bpe = bpe
        self.step, self.pairs = _Known(bpe.step, np.int64), _Known(bpe.pairs, bool)
        self.sizes = np.zeros(max(bpe.token) + 1, np.int64)
        self.sizes[list(bpe.token)] = [len(body) for body in bpe.token.values()]
        self.first = np.zeros(1, np.int64)  # of a state's tokens, in ``ranks``
        self.counts = np.zeros(0, np.int64)
        self.ranks = np.zeros(0, np.int64)

    def _states(self) -> None:
        """Know the states that were made since the last time."""
        new = self.bpe.ending_here[len(self.counts) :]
        if new:
            counts = np.array([len(ends) for ends in new], np.int64)
            self.ranks = np.append(self.ranks, np.array([rank for ends in new for _, rank in ends], np.int64))
            self.first = np.append(self.first, self.first[-1] + np.cumsum(counts))
            self.counts = np.append(self.counts, counts)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        n, size = len(pieces), len(pieces[0])
        given = np.frombuffer(b"".join(pieces), np.uint8).reshape(n, size)
        last = np.full((size + 1, n), -1, np.int64)
        state = np.zeros(n, np.int64)
        for end in range(1, size + 1):
            state = self.step(state << 8 | given[:, end - 1])
            self._states()
            left, tried = np.arange(n), 0
            while len(left):  # the rows without an entry yet
                own = state[left]
                if (self.counts[own] <= tried).any():
                    raise ValueError("the vocabulary lacks a byte")
                rank = self.ranks[self.first[own] + tried]
                begins = end - self.sizes[rank]
                before = last[begins, left]
                fits = begins == 0
                later = np.flatnonzero(~fits)
                fits[later] = self.pairs(before[later] << 32 | rank[later])
                last[end, left[fits]] = rank[fits]
                left, tried = left[~fits], tried + 1
        # Backwards: the tokens of each row, its last one first.
        rows, at, found = np.arange(n), np.full(n, size), []
        while len(rows):
            rank = last[at, rows]
            found.append((rows, rank))
            at = at - self.sizes[rank]
            rows, at = rows[at > 0], at[at > 0]
        row, ids = (np.concatenate([f[k] for f in found[::-1]]) for k in (0, 1))
        order = np.argsort(row, kind="stable")
        data = ids[order].astype("<u4").tobytes()
        ends = (np.cumsum(np.bincount(row, minlength=n)) * 4).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class PrefixTable:
    """The last token of every prefix of a piece."""

    def __init__(self, bpe: ByteBPE, piece: bytes = b""):
        self.bpe, self.bytes, self.last, self.states = bpe, b"", [-1], [0]
        self.append(piece)

    def append(self, more: bytes) -> None:
        """Exact: the entries of the present prefixes stay as they are."""
        self.bytes += more
        step, ending, pairs, last, states = self.bpe.step, self.bpe.ending_here, self.bpe.pairs, self.last, self.states
        state, end = states[-1], len(last)
        for byte in more:
            state = step[state << 8 | byte]
            states.append(state)
            for length, rank in ending[state]:
                before = last[end - length]
                if before < 0 or pairs[before << 32 | rank]:
                    last.append(rank)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            end += 1

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replace ``bytes[start:stop]``; returns how many entries were computed anew.

        An entry depends on the entries and bytes of the ``longest`` positions
        before it, so once that many agree with the old table the rest does.
        """
        old, states, rest = self.last, self.states, self.bytes[stop:]
        shift = len(new) - (stop - start)
        self.bytes, self.last, self.states = self.bytes[:start], old[: start + 1], states[: start + 1]
        self.append(new)
        agreeing = 0
        for k in range(len(rest)):
            self.append(rest[k : k + 1])
            end = len(self.bytes)
            agreeing = agreeing + 1 if old[end - shift] == self.last[end] else 0
            if agreeing >= self.bpe.longest:
                self.bytes += rest[k + 1 :]
                self.last += old[end - shift + 1 :]
                self.states += states[end - shift + 1 :]
                return end - start
        return len(self.bytes) - start

    def tokens(self) -> list[int]:
        out, end = [], len(self.bytes)
        while end:
            rank = self.last[end]
            out.append(rank)
            end -= len(self.bpe.token[rank])
        return out[::-1]


_loaded: dict[str, ByteBPE] = {}  # a worker's


def load(path: str) -> ByteBPE:
    """The vocabulary, built once in a worker."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def _encode(path: str, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch, texts in text_blocks(batches):
            ids = bpe.encode_all([t.decode("utf-8", "replace") for t in texts])
            back = [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]
            arrays = [
                batch.column("doc_id"),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                pa.array(back),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)
        bpe.forget()

    return run


def bpe_round_trip(
    docs: DataFrame,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """Encode whole texts and decode them again.

    One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if
    asked for, the ids. A NULL text is empty: no tokens. Nothing is shuffled.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return id_and_text(docs, id_col, text_col).mapInArrow(
        _encode(path or public_tokenizers.path(RANKS), keep_ids), schema + (", ids array<int>" if keep_ids else "")
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"))
