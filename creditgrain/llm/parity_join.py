"""Similarity join of documents on word shingles by parity sketches.

Every shingle flips one bit of a sketch, so two sketches differ in at most as many
bits as the sets in shingles: Hamming distance is a lower bound of the symmetric
difference. Two sets of a Jaccard similarity of 0.8 differ in at most a ninth of the
sum of their sizes, for either at most a quarter of its size.

Candidates. The (long, sparse) sketch of a document is cut into parts, more for
larger size bands. At most d parts can differ, so by the pigeonhole principle linked
documents share one of the first d + 1 filled parts of each in any common order. The
order is by how often a part's content occurs (counted in a fixed table over all
documents), rarest first, so that passages that many documents share do not bring
documents together. Documents near the upper end of a band join the next one too.

Decisions. A candidate pair is dropped if the Hamming distance of its short sketches
(folded to one length) exceeds the bound, and else verified with the whole texts.

Large groups. Equal sets are one node. All members of a part are first compared with the
most central of them, the one whose other parts have the most members: of a text and its
many edited copies that is the text. After some such rounds, each with another leader for
those that found no link, only members of different components are paired with one
another, in a join that compares ``PROBE`` folded bits of the sketches as it goes. So a
group of near copies costs a pair for each document and not for each pair, while no link
between components is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditgrain.session import discard, store, sweep

from .bloom import bloom_of, may_hold
from .common import column, fresh, mix, numbered, numbered_texts, release, shingle_sets, table, text_blocks

WORDS = 5
PLACES = 19  # log2 of the table of part frequencies: a larger one costs each task more lines
LEAST_PARTS = 1024
STARS = 2
PROBE = 8  # words of 64 bits of each sketch that a join compares
LEADING = 20  # bits dropped from a key to see whether it is repeated


def parts_of(size: int) -> list[int]:
    """Numbers of parts, one for each band that documents of this size take part in."""
    own = LEAST_PARTS
    while size >= own // 2:
        own *= 4
    return [own, own * 4] if 5 * size >= 4 * (own // 2) else [own]


def filled_parts(shingles: np.ndarray, parts: int, salt: int) -> np.ndarray:
    """A key for each filled part of the sketch: of its number, content and band.

    A shingle's bit within its part has 64-bit coordinates, so no two shingles
    cancel; a part's content is kept as the sum over GF(2) of codes of its bits.
    """
    spread = mix(shingles ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    part = spread & np.uint64(parts - 1)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order], prepend=np.uint64(parts)))
    content = np.bitwise_xor.reduceat(mix(spread + np.uint64(1))[order], cuts)
    return mix(content + (part[order][cuts] << np.uint64(32)) + np.uint64(parts))


def sketch_of(shingles: np.ndarray, bits: int) -> np.ndarray:
    """Parities of the shingles' places among a power of two of bits, packed."""
    flips = np.bincount((shingles >> np.uint64(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little")


def short_sketch(shingles: np.ndarray) -> bytes:
    """Parities of at least twice as many bits as there are shingles."""
    return sketch_of(shingles, max(64, 2 << int(len(shingles)).bit_length())).tobytes()


def probe(shingles: np.ndarray) -> np.ndarray:
    """The same in ``PROBE`` words of 64 bits, however many shingles."""
    return sketch_of(shingles, 64 * PROBE).view(np.int64)


def hamming(one: bytes, two: bytes) -> int:
    """Of two sketches, the longer folded to the length of the shorter."""
    a, b = (np.frombuffer(x, np.uint64) for x in (one, two))
    if len(a) < len(b):
        a, b = b, a
    a = np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def linked(one: np.ndarray, two: np.ndarray, percent: int = 80) -> bool:
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(one) + len(two) - both)


def node_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    flat, sizes = shingle_sets(texts, WORDS)
    ends = np.cumsum(sizes)
    for size, end in zip(sizes.tolist(), ends.tolist(), strict=True):
        yield flat[end - size : end]


def _frequencies(salt: int, places: int = PLACES):
    """Counts of part keys by place; place -1 counts documents with too few filled parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, poor = np.zeros(1 << places, np.int64), 0
        for _, texts in text_blocks(batches):
            held = []
            for shingles in _sets(texts):
                for parts in parts_of(len(shingles)) if len(shingles) else []:
                    keys = filled_parts(shingles, parts, salt)
                    poor += len(keys) <= len(shingles) // 4
                    held.append(keys)
            if held:
                total += np.bincount((np.concatenate(held) >> np.uint64(64 - places)).astype(np.int64), minlength=1 << places)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(total[used], poor))], ["place", "n"]
        )

    return run


def _nodes(shared, salt: int, places: int = PLACES):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch, texts in text_blocks(batches):
            sizes, nodes, sketches, probes, keys, met = [], [], [], [], [], set()
            for shingles in _sets(texts):
                sizes.append(len(shingles))
                nodes.append(node_of(shingles) if len(shingles) else None)
                if not len(shingles) or nodes[-1] in met:
                    for column_ in (sketches, probes, keys):
                        column_.append(None)
                    continue
                met.add(nodes[-1])
                sketches.append(short_sketch(shingles))
                probes.append(probe(shingles))
                chosen = []
                for parts in parts_of(len(shingles)):
                    found = filled_parts(shingles, parts, salt)
                    order = np.lexsort((found, often[(found >> np.uint64(64 - places)).astype(np.int64)]))
                    chosen.append(found[order[: len(shingles) // 4 + 1]].view(np.int64))
                keys.append(np.concatenate(chosen))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("row"),
                    pa.array(sizes, pa.int64()),
                    pa.array(nodes, pa.int64()),
                    pa.array(sketches, pa.binary()),
                    pa.array(probes, pa.list_(pa.int64())),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["doc_id", "row", "size", "node", "sketch", "probe", "keys"],
            )
        release()

    return run


def _members(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("keys")
            key = lists.flatten().to_numpy(zero_copy_only=False)
            lengths = np.diff(lists.offsets.to_numpy())
            good = np.flatnonzero(may_hold(shared.value, (key >> LEADING).view(np.uint64)))
            owner = np.repeat(np.arange(len(batch)), lengths)[good]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[good]), batch.column("node").take(pa.array(owner)), batch.column("size").take(pa.array(owner))],
                ["key", "node", "size"],
            )

    return run


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bound = (column(batch, "size_a") + column(batch, "size_b")) // 9
        pairs = zip(batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist(), strict=True)
        good = [k for k, ((x, y), d) in enumerate(zip(pairs, bound.tolist(), strict=True)) if hamming(x, y) <= d]
        yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_blocks(batches, column="text_a"):
        others = batch.column("text_b").cast(pa.binary()).to_pylist()
        good = [k for k, (x, y) in enumerate(zip(_sets(texts), _sets(others), strict=True)) if linked(x, y)]
        yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))
    release()


def _picked(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(shared.value, column(batch, "row").view(np.uint64))))

    return run


# ------------------------------------------------------------------ components


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the edges (a, b); a component is its smallest node.

    Each round links every node and its neighbours to the smallest of them, first
    the larger neighbours and then the others, until nothing changes. Hot nodes
    are summed map-side before they are shuffled.
    """

    def star(edges: DataFrame, larger: bool) -> DataFrame:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not larger:
            both = both.where("b < a")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        found = both.join(least, "a")
        if larger:
            return found.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        return (
            found.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )

    mark = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    edges = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = mark(edges)
    while before[0]:
        following = store(star(star(edges, True), False), "edges")
        discard(edges)
        edges = following
        now = mark(edges)
        if now == before:
            break
        before = now
    # Every edge now leads from a node to the smallest of its component.
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


class _Join:
    """The state of one run: nodes, members of parts, links so far."""

    def __init__(self, rows: DataFrame, first_salt: int = 0):
        self.rows = rows
        self.context = rows.sparkSession.sparkContext
        often, salt = self.frequencies(first_salt)
        sweep(rows.sparkSession)  # here and below: the next step shuffles as much again
        sets = store(
            rows.mapInArrow(
                _nodes(self.context.broadcast(often), salt),
                "doc_id long, row long, size long, node long, sketch binary, probe array<long>, keys array<long>",
            ),
            "sets",
        )
        filled = sets.where("keys is not null")
        # Leading bits of keys and nodes say nearly as well which keys are repeated, in fewer bytes.
        repeated = (
            filled.select(F.shiftright("node", 24).alias("node"), F.explode("keys").alias("key"))
            .groupBy(F.shiftright("key", LEADING).alias("key"))
            .agg(F.min("node").alias("low"), F.max("node").alias("high"))
            .where("low < high")
            .select("key")
        )
        held = self.context.broadcast(bloom_of(repeated, "key"))
        sweep(rows.sparkSession)
        self.members = store(
            filled.select("keys", "node", "size").mapInArrow(_members(held), "key long, node long, size long").distinct(), "members"
        )
        sweep(rows.sparkSession)
        #: A row for each node; of its copies, the one with the smallest row.
        self.nodes = store(
            filled.groupBy("node").agg(
                F.min("row").alias("row"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("probe").alias("probe")
            ),
            "nodes",
        )
        #: A row for each document.
        self.sets = store(sets.select("doc_id", "row", "size", "node"), "documents")
        discard(sets)

    def frequencies(self, salt: int) -> tuple[np.ndarray, int]:
        """Counts by place, and a salt for which every document has more filled parts than may differ."""
        while True:
            sums = (
                self.rows.select("text").mapInArrow(_frequencies(salt), "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
            )  # at most 2**PLACES rows
            place, n = sums["place"].to_numpy(), sums["n"].to_numpy()
            if not n[place < 0].sum():
                out = np.zeros(1 << PLACES, np.int32)
                out[place[place >= 0]] = np.minimum(n[place >= 0], np.iinfo(np.int32).max)
                return out, salt
            salt += 1

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs (a, b) that link, stored."""
        side = lambda s: self.nodes.select(F.col("node").alias(s), F.col("size").alias(f"size_{s}"), F.col("sketch").alias(f"sketch_{s}"))
        near = store(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_near, "a long, b long"), "near")
        wanted = near.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(self.nodes.select("node", "row"), "node")
        wanted = store(wanted, "wanted")
        held = self.context.broadcast(bloom_of(wanted, "row"))
        texts = store(
            self.rows.select("row", "text").mapInArrow(_picked(held), "row long, text string").join(wanted, "row").select("node", "text"), "texts"
        )
        text = lambda s: texts.select(F.col("node").alias(s), F.col("text").alias(f"text_{s}"))
        found = store(near.join(text("a"), "a").join(text("b"), "b").mapInArrow(_verify, "a long, b long"), "links")
        discard(near, wanted, texts)
        return found

    def run(self) -> DataFrame:
        """(node, component) of all nodes with a link."""
        found, joined, tried = None, None, None
        for step in range(STARS + 1):
            members = self.members.withColumn("component", F.col("node"))
            if joined is not None:
                members = self.members.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
            spread = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
            members = store(members.join(spread.select("key"), "key"), "open")
            pairs = self.stars(members) if step < STARS else self.across(members)
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = store(pairs, "pairs")
            new = self.links(pairs)
            discard(members)
            tried = pairs if tried is None else tried.union(pairs)
            found = new if found is None else found.union(new)
            joined = components(found)
        return joined

    def stars(self, members: DataFrame) -> DataFrame:
        """Each node with the leader it shares most parts with. A part's leader is its most
        central member; nodes of the leader's component need no pair with it."""
        crowd = members.groupBy("key").agg(F.count(F.lit(1)).alias("crowd"))
        central = members.join(crowd, "key").groupBy("node").agg(F.sum("crowd").alias("central"))
        placed = members.join(central, "node")
        leaders = placed.groupBy("key").agg(F.max(F.struct("central", "node", "component")).alias("leader"))
        leaders = leaders.select("key", F.col("leader.node").alias("leader"), F.col("leader.component").alias("led"))
        shared = (
            members.join(leaders, "key")
            .where("component <> led")
            .groupBy("node", "leader")
            .agg(F.count(F.lit(1)).alias("n"))
            .groupBy("node")
            .agg(F.max(F.struct("n", "leader")).alias("best"))
        )
        return shared.select(F.least("node", "best.leader").alias("a"), F.greatest("node", "best.leader").alias("b")).distinct()

    def across(self, members: DataFrame) -> DataFrame:
        """All pairs that share a part, are of different components, and near in size and probe.

        Members of a part's largest component are paired with the others only, and those
        among themselves.
        """
        counted = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
        main = counted.groupBy("key").agg(F.max(F.struct("n", "component")).alias("m")).select("key", F.col("m.component").alias("main"))
        words = [F.col("probe")[k].alias(f"p{k}") for k in range(PROBE)]
        placed = members.join(main, "key").join(self.nodes.select("node", *words), "node")

        def side(rows: DataFrame, s: str) -> DataFrame:
            return rows.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "size", "component", *[f"p{k}" for k in range(PROBE)])])

        apart = sum((F.bit_count(F.col(f"p{k}_x").bitwiseXOR(F.col(f"p{k}_y"))) for k in range(PROBE)), F.lit(0))
        near = F.expr("5 * size_x >= 4 * size_y and 5 * size_y >= 4 * size_x") & (9 * apart <= F.col("size_x") + F.col("size_y"))
        rest = placed.where("component <> main")
        one = side(placed.where("component = main"), "x").join(side(rest, "y"), "key").where(near)
        two = side(rest, "x").join(side(rest, "y"), "key").where(near & F.expr("component_x < component_y"))
        pairs = one.select("node_x", "node_y").union(two.select("node_x", "node_y"))
        return pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def similar_groups(docs: DataFrame, row_col: str | None = None) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, row, group (NULL for empty sets).

    Sets are of 5-word shingles of lower-cased (A-Z) words, of the whole sequence
    if it is shorter; documents link from a Jaccard similarity of 0.8 on. A text
    that is NULL or without words has an empty set and is linked with nothing: its
    component is its own id. NULL ids are linked like others but never name a
    component unless it has no other id. ``row`` is that of ``row_col``, or as
    ``common.numbered`` gives it.
    """
    rows = numbered_texts(docs, row_col=row_col)
    work = _Join(rows)
    joined = work.run()
    per_node = work.sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"))
    named = per_node.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("low").alias("component_id"))
    by_node = named.select("node", "component").join(names, "component")
    return work.sets.join(by_node, "node", "left").select(
        "doc_id",
        F.col("size").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "row",
        F.col("component").alias("group"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, without those similar to a kept one by links:
    of each component the row with the smallest id stays (NULL ids last, then as stored)."""
    name = fresh(docs, "row")
    numbers = numbered(docs, name)
    found = similar_groups(numbers, name)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = found.where("group is not null").groupBy("group").agg(F.min(place).alias("first")).select("first.row")
    rows = first.union(found.where("group is null").select("row"))
    return numbers.join(rows.select(F.col("row").alias(name)), name, "left_semi").select(*docs.columns)


def op6_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents")).drop("row", "group")
