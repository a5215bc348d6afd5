"""SimHash near-duplicates by tiled exact comparison.

A document's fingerprint takes each bit from the majority of its word shingles' hashes: XXH64 with one seed for every 64 bits. Distinct
fingerprints are laid out in tiles. Of one 64-bit word, a tile has the population counts of its four 16-bit parts: fingerprints differ in at
least as many bits as their tiles' counts do in sum. Wider fingerprints, which bear larger radii, have bands of their whole population count, and classes of
documents' numbers of distinct shingles where a least similarity is asked for, as that bounds their ratio. Only pairs of tiles whose counts
differ by no more than the radius are compared, every pair in them, by exclusive-or and bit counts. A tile is compared in blocks of a bounded number
of fingerprints, however many it holds.

Each comparison keeps a spanning forest of the links it finds rather than all pairs; components of the forests'
union are those of all links.

Where a least similarity is asked for, pairs of near fingerprints are only candidates, and texts are linked when their sets of shingles are
that similar. Candidates are checked in two rounds, so that a large group of copies isn't written as all its pairs: first each block's forest of
nearest candidates, then every candidate between what the first round's true links left apart, in the block where the two meet, beside their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_bits, runs, settled, small_batches
from .components import components

#: Fingerprints in one block of a tile, and of visitors that are compared with it at once.
TILE = 1024
PARTS = 4


def shingled(text: str, words: int, width: int) -> tuple[list[int], np.ndarray]:
    """(``width`` words of 64 bits, sorted hashes of the distinct shingles): the majority of each bit over the hashes of the text's word shingles; zeros
    without words.

    A long text is hashed in runs; a run begins with the last words of the one before.
    """
    import xxhash

    digest = xxhash.xxh64_intdigest
    ones, n, seen, carried = np.zeros(64 * width, dtype=np.int64), 0, [], []
    for run in runs(text):
        w = carried + run.encode("utf-8", "surrogatepass").lower().split()
        carried = w[max(len(w) - words + 1, 0) :]
        shingles = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)]
        hashes = np.array([[digest(x, 42 + k) for x in shingles] for k in range(width)], dtype="<u8").reshape(width, -1)
        n += len(shingles)
        seen.append(np.unique(hashes[0]))
        for i in range(0, len(shingles), 1 << 16):  # the bits of one part of the hashes at a time
            part = np.ascontiguousarray(hashes[:, i : i + (1 << 16)].T)
            ones += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    if not n and carried:
        whole = [digest(b" ".join(carried), 42 + k) for k in range(width)]
        return whole, np.array(whole[:1], dtype="<u8")
    bits = np.packbits(2 * ones > n, bitorder="little").view("<u8")
    return bits.tolist(), seen[0] if len(seen) == 1 else np.unique(np.concatenate(seen))


def fingerprint(text: str, words: int = 3, width: int = 1) -> tuple[list[int], int]:
    """The fingerprint of a text and its number of distinct shingles."""
    bits, distinct = shingled(text, words, width)
    return bits, len(distinct)


def _fingerprints(words: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            prints, sizes, keys = [], [], []
            for t in batch.column("text"):
                bits, distinct = shingled(t.as_py() or "", words, width)
                prints.append(bits)
                sizes.append(len(distinct))
                keys.append(xxhash.xxh64_intdigest(distinct.tobytes(), 42))
            prints = np.array(prints, dtype=np.uint64).reshape(-1, width).view(np.int64)
            keys = np.array(keys, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(prints.tolist(), pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(keys)],
                ["doc_id", "text_key", "print", "shingles", "set_key"],
            )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in enumerate(batch.column("text")):
                distinct = shingled(t.as_py() or "", words, 1)[1].view(np.int64)
                own = pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), pa.array(distinct))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(i, 1), own], ["node", "set"])

    return run


def simhashes(docs: DataFrame, words: int = 3, width: int = 1) -> DataFrame:
    """doc_id, text_key (a hash of the text), print (the fingerprint of each row's whole text as ``width`` signed 64-bit numbers), shingles (how many are
    distinct) and set_key (a hash of those)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(_fingerprints(words, width), "doc_id bigint, text_key bigint, print array<bigint>, shingles bigint, set_key bigint")


def layout(radius: int, width: int = 1, similarity: float | None = None) -> tuple[list[tuple[Column, int]], list[tuple[int, ...]]]:
    """(for each coordinate of a tile its column and number of values; differences of coordinates between tiles that may hold a link, one of each
    opposite pair)."""
    if width == 1:
        counts = [F.bit_count(F.shiftright(F.col("print")[0], 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(PARTS)]
        axes, near = [(c, 17) for c in counts], [d for d in product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, d)) <= radius]
    else:
        whole = sum((F.bit_count(F.col("print")[k]) for k in range(1, width)), F.bit_count(F.col("print")[0]))
        size = F.floor(F.log(F.greatest("shingles", F.lit(1))) / -log(similarity) + 1e-9) if similarity else F.lit(0)
        axes, near = [(size, 256), (F.floor(whole / (radius + 1)), 64 * width // (radius + 1) + 1)], list(product((-1, 0, 1), repeat=2))
    return axes, [d for d in near if d > (0,) * len(axes)]


def _settle(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of both sides after spreading the smallest label over a matrix of links."""
    big = np.iinfo(np.int64).max
    while True:
        l2 = np.minimum(left, np.where(near, right[None, :], big).min(axis=1, initial=big))
        r2 = np.minimum(right, np.where(near, l2[:, None], big).min(axis=0, initial=big))
        if (l2 == left).all() and (r2 == right).all():
            return l2, r2
        left, right = l2, r2


def differing(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The number of differing bits of each pair of rows."""
    bits = np.zeros((len(left), len(right)), dtype=np.uint16)
    for k in range(right.shape[1]):
        bits += np.bitwise_count(left[:, k, None] ^ right[None, :, k])
    return bits


class Block:
    """A block at home and its links: a spanning forest within it and between it and each run of visitors.

    Prints are rows of 64-bit words; links name the nodes of prints. Labels are places in the block; a visitor takes the label of what it links to.
    """

    def __init__(self, prints: np.ndarray, nodes: np.ndarray, radius: int, *more: np.ndarray):
        self.prints, self.nodes, self.radius = prints, nodes, radius
        start = np.arange(len(prints))
        self.labels, _ = _settle(self.near(prints, *more), start, start)
        moved = np.flatnonzero(self.labels != start)
        self.found = list(zip(nodes[moved].tolist(), nodes[self.labels[moved]].tolist()))

    def near(self, others: np.ndarray, *more: np.ndarray) -> np.ndarray:
        return differing(others, self.prints) <= self.radius

    def links(self) -> list:
        return self.found

    def visit(self, prints: np.ndarray, nodes: np.ndarray, *more: np.ndarray) -> None:
        near = self.near(prints, *more)
        rows = near.any(axis=1)
        if not rows.any():
            return
        # homes of one label are one column, so all of them follow when it falls
        old, of = np.unique(self.labels, return_inverse=True)
        order = np.argsort(of, kind="stable")
        near = np.logical_or.reduceat(near[rows][:, order], np.searchsorted(of[order], np.arange(len(old))), axis=1)
        own, new = _settle(near, np.full(int(rows.sum()), len(self.nodes)), old)
        self.found += zip(nodes[rows].tolist(), self.nodes[own].tolist())
        fell = new != old
        self.found += zip(self.nodes[old[fell]].tolist(), self.nodes[new[fell]].tolist())
        self.labels = new[of]


#: More bits than any fingerprint has: no candidates.
FAR = np.uint16(0xFFFF)
#: Rows whose differing bits are counted, and visitors that are compared, at once.
STRIP = 256


def nearest_forest(bits: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that join all that a symmetric matrix of differing bits (FAR: no pair) joins: every part takes its nearest pair to another one, until there is none."""
    rows = np.flatnonzero((bits < FAR).any(axis=1))
    bits, part, out = bits[np.ix_(rows, rows)], np.arange(len(rows)), []
    while len(rows):
        outside = np.where(part[:, None] != part[None, :], bits, FAR)
        to = outside.argmin(axis=1)
        least = outside[np.arange(len(rows)), to]
        order = np.lexsort((least, part))
        own = order[np.flatnonzero(np.diff(part[order], prepend=-1))]
        own = own[least[own] < FAR]
        if not len(own):
            break
        out += zip(rows[own].tolist(), rows[to[own]].tolist())
        joined = part[own], part[to[own]]
        up = np.arange(len(rows))
        while True:  # parts that were joined take their smallest number
            low = np.minimum(up[joined[0]], up[joined[1]])
            new = up.copy()
            np.minimum.at(new, joined[0], low)
            np.minimum.at(new, joined[1], low)
            new = new[new]
            if (new == up).all():
                break
            up = new
        part = up[part]
    return out


class Candidates:
    """A block at home whose candidates are checked later; a pair's numbers of distinct shingles (the first fact) must not rule it out.

    Without ``rest``: a forest of nearest candidates within the block, the nearest home of each visitor, and the nearest visitor of each home. So what has a
    candidate at all is in a pair. With ``rest``: every candidate whose second facts (parts that are known to be linked) differ.
    """

    def __init__(self, prints: np.ndarray, nodes: np.ndarray, facts: np.ndarray, radius: int, similarity: float, rest: bool):
        self.prints, self.nodes, self.facts, self.radius, self.similarity, self.rest = prints, nodes, facts, radius, similarity, rest
        bits = self.bits(prints, facts)
        if rest:
            a, b = np.nonzero(np.triu(bits < FAR, 1))
        else:
            np.fill_diagonal(bits, FAR)
            a, b = np.array(nearest_forest(bits), dtype=np.int64).reshape(-1, 2).T
        self.own = np.stack([nodes[a], nodes[b]], axis=1)
        self.least, self.guest = np.full(len(nodes), FAR), np.zeros(len(nodes), dtype=np.int64)

    def bits(self, prints: np.ndarray, facts: np.ndarray) -> np.ndarray:
        out = np.empty((len(prints), len(self.prints)), dtype=np.uint16)
        for i in range(0, len(prints), STRIP):
            bits = out[i : i + STRIP]
            bits[:] = differing(prints[i : i + STRIP], self.prints)
            bits[bits > self.radius] = FAR
            # few pairs are left, so the rest is looked up for them only
            a, b = np.nonzero(bits < FAR)
            size, other = facts[i + a, 0], self.facts[b, 0]
            no = np.minimum(size, other) < self.similarity * np.maximum(size, other)
            if self.rest:
                no |= facts[i + a, 1] == self.facts[b, 1]
            bits[a[no], b[no]] = FAR
        return out

    def visit(self, prints: np.ndarray, nodes: np.ndarray, facts: np.ndarray) -> np.ndarray:
        bits = self.bits(prints, facts)
        if self.rest:
            a, b = np.nonzero(bits < FAR)
            return np.stack([nodes[a], self.nodes[b]], axis=1)
        first = bits.argmin(axis=0)
        least = bits[first, np.arange(len(self.nodes))]
        nearer = least < self.least
        self.least[nearer], self.guest[nearer] = least[nearer], nodes[first[nearer]]
        to = bits.argmin(axis=1)
        near = np.flatnonzero(bits[np.arange(len(nodes)), to] < FAR)
        return np.stack([nodes[near], self.nodes[to[near]]], axis=1)

    def links(self) -> np.ndarray:
        met = self.least < FAR
        return np.concatenate([self.own, np.stack([self.nodes[met], self.guest[met]], axis=1)])


def _marked(nodes: np.ndarray, mark: int) -> np.ndarray:
    return np.stack([nodes, np.full(len(nodes), mark)], axis=1)


class Remaining(Candidates):
    """A block that names its rows and visitors with a candidate of another part, with 1 if they visit, else 0, instead of the pairs."""

    def __init__(self, prints: np.ndarray, nodes: np.ndarray, facts: np.ndarray, radius: int, similarity: float):
        self.prints, self.nodes, self.facts, self.radius, self.similarity, self.rest = prints, nodes, facts, radius, similarity, True
        self.met = (self.bits(prints, facts) < FAR).any(axis=1)

    def visit(self, prints: np.ndarray, nodes: np.ndarray, facts: np.ndarray) -> np.ndarray:
        near = self.bits(prints, facts) < FAR
        self.met |= near.any(axis=0)
        return _marked(nodes[near.any(axis=1)], 1)

    def links(self) -> np.ndarray:
        return _marked(self.nodes[self.met], 0)


class Checked(Block):
    """A block whose links are candidates of different parts (as in `Remaining`) whose sets of shingles are similar: they are looked up in an
    index of the block's shingles, so neither pairs nor their sets are written."""

    rest = True
    bits = Candidates.bits

    def __init__(self, prints: np.ndarray, nodes: np.ndarray, facts: np.ndarray, sets: np.ndarray, radius: int, similarity: float):
        self.facts, self.similarity = facts, similarity
        self.sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
        shingles = np.concatenate(sets)
        order = np.argsort(shingles, kind="stable")
        self.shingles, self.owners = shingles[order], np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[order]
        super().__init__(prints, nodes, radius, facts, sets)

    def common(self, own: np.ndarray) -> np.ndarray:
        """How many of ``own`` each set of the block holds."""
        out = np.zeros(len(self.nodes), dtype=np.int64)
        for i in range(0, len(own), TILE):
            some = own[i : i + TILE]
            first = np.searchsorted(self.shingles, some)
            n = np.searchsorted(self.shingles, some, side="right") - first
            at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out += np.bincount(self.owners[at], minlength=len(out))
        return out

    def near(self, others: np.ndarray, facts: np.ndarray, sets: np.ndarray) -> np.ndarray:
        near = self.bits(others, facts) < FAR
        for i in np.flatnonzero(near.any(axis=1)):
            common = self.common(sets[i])
            near[i] &= common >= self.similarity * (len(sets[i]) + self.sizes - common)
        return near


def _stretches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """(tile and block, whether they visit, prints, nodes, facts, and sets where there are any) of rows that come one after another; facts are all
    further columns."""
    for batch in batches:
        if not batch.num_rows:
            continue
        tiles, blocks = batch.column("tile").to_numpy(), batch.column("block").to_numpy()
        visits, nodes = batch.column("visits").to_numpy(zero_copy_only=False), batch.column("node").to_numpy()
        prints = batch.column("print").flatten().to_numpy().reshape(-1, width).view(np.uint64)
        facts = np.array([batch.column(k).to_numpy() for k in batch.schema.names[5:] if k != "set"], dtype=np.int64).reshape(-1, len(nodes)).T
        more = []
        if "set" in batch.schema.names:
            ends, values = batch.column("set").offsets.to_numpy(), batch.column("set").values.to_numpy()
            more = [np.empty(len(nodes), dtype=object)]
            more[0][:] = [values[a:b] for a, b in zip(ends, ends[1:])]
        new = np.flatnonzero((np.diff(tiles) != 0) | (np.diff(blocks) != 0) | (np.diff(visits) != 0)) + 1
        for a, b in zip([0, *new], [*new, len(tiles)]):
            yield (tiles[a], blocks[a]), bool(visits[a]), prints[a:b], nodes[a:b], facts[a:b], *[m[a:b] for m in more]


def _compare(make, width: int, step: int):
    """Links of every block, with its tile and block; its rows come one after another, those at home first. ``make`` builds a block of its prints, nodes and facts; ``step``
    visitors are compared at once."""

    def pairs(found: list, of: tuple[int, int]) -> pa.RecordBatch:
        own = np.array(found, dtype=np.int64).reshape(-1, 2)
        where = [pa.array(np.full(len(own), x, dtype=np.int32)) for x in of]
        return pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1]), *where], ["a", "b", "tile", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, home, block = None, [], None

        def at_home():
            return make(*map(np.concatenate, zip(*home))) if home else None

        for of, visits, *rows in _stretches(batches, width):
            if of != key:
                if key is not None and (block := block or at_home()) and len(found := block.links()):
                    yield pairs(found, key)
                key, home, block = of, [], None
            if not visits:
                home.append(rows)
                continue
            block = block or at_home()
            for i in range(0, len(rows[1]) if block else 0, step):
                now = block.visit(*[x[i : i + step] for x in rows])
                if now is not None and len(now):
                    yield pairs(now, key)
        if key is not None and (block := block or at_home()) and len(found := block.links()):
            yield pairs(found, key)

    return run


def _dealt(prints: DataFrame, radius: int, width: int, similarity: float | None, tile: int, facts: list[str]) -> DataFrame:
    """tile, block, visits, node, print and ``facts``: the rows of each block, and after them those that visit it."""
    axes, near = layout(radius, width, similarity)
    number, scales = F.lit(0), []
    for column, size in axes:
        number = number * size + F.least(column, F.lit(size - 1))
        scales = [x * size for x in scales] + [1]
    tiles = prints.select("node", "print", *facts, number.cast("int").alias("tile"))
    # one row for each tile, and their number is bounded by the layout
    sizes = F.broadcast(settled(tiles.groupBy("tile").agg(F.ceil(F.count("*") / tile).cast("int").alias("blocks"))))
    tiles = tiles.join(sizes, "tile").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    columns = ["tile", "block", "visits", "node", "print", *facts]
    at_home = tiles.withColumn("visits", F.lit(False)).select(columns)
    own = tiles.filter("block > 0").withColumn("visits", F.lit(True)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("block") - 1))).select(columns)
    # neighbours by their coordinates; tiles without fingerprints fall away in the join
    steps = F.array(*[F.array(*map(F.lit, d)) for d in near])
    there, inside = F.col("tile"), F.lit(True)
    for k, (scale, (_, size)) in enumerate(zip(scales, axes)):
        there = there + F.col("d")[k] * scale
        inside = inside & (F.floor(F.col("tile") / scale) % size + F.col("d")[k]).between(0, size - 1)
    others = tiles.select("node", "print", *facts, "tile", F.explode(steps).alias("d")).filter(inside).select("node", "print", *facts, there.cast("int").alias("tile"))
    others = others.join(sizes, "tile").withColumn("visits", F.lit(True)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(columns)
    return _side_by_side(at_home.unionByName(own).unionByName(others))


def _side_by_side(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "tile", "block").sortWithinPartitions("tile", "block", "visits")


_LINKS = "a bigint, b bigint, tile int, block int"


def links(prints: DataFrame, radius: int = 2, width: int = 1, tile: int | None = None) -> DataFrame:
    """a, b: links between the nodes of distinct fingerprints (node, print) at ``radius`` or fewer differing bits.

    Links are a spanning forest of every comparison of blocks: no component is lost, and their number stays in proportion to the blocks compared.
    """
    tile = tile or TILE
    make = lambda own, nodes, facts: Block(own, nodes, radius)
    return _dealt(prints, radius, width, None, tile, []).mapInArrow(_compare(make, width, tile), _LINKS).select("a", "b")


def candidates(prints: DataFrame, radius: int, width: int, similarity: float, tile: int | None = None) -> DataFrame:
    """a, b: pairs of nodes (node, print, shingles) at ``radius`` or fewer differing bits whose numbers of distinct shingles allow ``similarity``: a part of
    them that names every node with a candidate (`Candidates`)."""
    tile = tile or TILE
    make = lambda own, nodes, facts: Candidates(own, nodes, facts, radius, similarity, False)
    return _dealt(prints, radius, width, similarity, tile, ["shingles"]).mapInArrow(_compare(make, width, min(tile, STRIP)), _LINKS).select("a", "b")


def remaining_links(parts: DataFrame, sets: DataFrame, radius: int, width: int, similarity: float, tile: int | None = None) -> DataFrame:
    """a, b: links between nodes (node, print, shingles, part) of different parts that are candidates and whose ``sets`` (node, set) are similar.

    First each block names the rows that have a candidate in it; only those come again, with their sets, and candidates are checked where they meet. What
    is written is a spanning forest of each comparison's links, so it grows with rows and blocks, not with pairs.
    """
    spark = parts.sparkSession
    tile, facts = min(tile or TILE, TILE), ["shingles", "part"]
    named = lambda own, nodes, known: Remaining(own, nodes, known, radius, similarity)
    small_batches(spark, 10_000)
    met = settled(_dealt(parts, radius, width, similarity, tile, facts).mapInArrow(_compare(named, width, min(tile, STRIP)), _LINKS).distinct())
    rows = met.select("tile", "block", (F.col("b") == 1).alias("visits"), F.col("a").alias("node")).join(parts, "node").join(sets, "node")
    check = lambda own, nodes, known, held: Checked(own, nodes, known, held, radius, similarity)
    rows = _side_by_side(rows.select("tile", "block", "visits", "node", "print", *facts, "set"))
    return settled(rows.mapInArrow(_compare(check, width, min(tile, STRIP)), _LINKS).select("a", "b"))


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets (node, set: distinct numbers) have at least ``similarity`` of their union in common."""
    of = lambda side: sets.select(F.col("node").alias(side), F.col("set").alias(f"set_{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
    return both.filter(F.col("common") >= similarity * (F.size("set_a") + F.size("set_b") - F.col("common"))).select("a", "b")


def verified_components(docs: DataFrame, distinct: DataFrame, words: int, radius: int, width: int, similarity: float, tile: int | None = None) -> DataFrame:
    """node, component of nodes (distinct: node, first, print, shingles) with candidates: those that all candidates with so similar shingles join.

    ``first`` names the row of ``docs`` that has a node's text.
    """
    spark = docs.sparkSession
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    small_batches(spark, 10_000)
    near = settled(ordered(candidates(distinct, radius, width, similarity, tile)))
    nodes = settled(near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct().join(distinct, "node"))
    # shingles of the texts that have candidates only
    small_batches(spark)
    named = nodes.select("node", F.col("first.doc_id").alias("_of"), F.col("first.text_key").alias("_key"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = rows.join(named, F.col("doc_id").eqNullSafe(F.col("_of")) & (F.xxhash64("text") == F.col("_key"))).select("node", "text")
    sets = settled(texts.mapInArrow(_sets(words), "node bigint, set array<bigint>").dropDuplicates(["node"]))
    small_batches(spark, 10_000)
    true = settled(similar(near, sets, similarity))
    # what the first round joined is one node of the second
    parts = nodes.join(components(true).withColumnRenamed("component", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    parts = settled(parts.select("node", "print", "shingles", "part"))
    rest = remaining_links(parts, sets, radius, width, similarity, tile)
    of = lambda side, part: parts.select(F.col("node").alias(side), F.col("part").alias(part))
    rest = rest.join(of("a", "x"), "a").join(of("b", "y"), "b")
    joined = components(rest.select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("node", "part")
    return parts.join(joined, "part", "left").select("node", F.coalesce("component", "part").alias("component"))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, width: int = 1, similarity: float | None = None, tile: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits for each 64 bits), component_id, text_key and keep_key of each row of ``docs`` (doc_id, text).

    Documents are linked when their fingerprints differ in ``radius`` bits or fewer and, with ``similarity``, their sets of distinct shingles have so much of
    their union in common (a text with fewer words has one shingle, one without words none; equal sets are alike); component_id is the smallest doc_id
    that links reach, and keep_key the text_key of one row that has it. A null, empty or blank text has the fingerprint zero and is linked like any
    other. Rows with a null doc_id take part and have the component they reach, null if it has no doc_id. An empty table gives no rows. Other
    columns are ignored. Fingerprints of more than 64 bits and sets of shingles are told apart by a 64-bit hash.
    """
    prints = simhashes(docs, words, width)
    node = F.xxhash64("print", "set_key") if similarity else F.col("print")[0] if width == 1 else F.xxhash64("print")
    prints = settled(prints.withColumn("node", node).drop("set_key"))
    bits = hash_bits(prints.count())
    # a fingerprint that very many documents share is counted down in shares first
    salted = prints.withColumn("salt", F.shiftright(F.xxhash64("doc_id", "text_key"), 64 - bits))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    by_salt = salted.groupBy("node", "salt").agg(F.min(first).alias("first"), F.first("print").alias("print"), F.max("shingles").alias("shingles"))
    distinct = settled(by_salt.groupBy("node").agg(F.min("first").alias("first"), F.first("print").alias("print"), F.max("shingles").alias("shingles")))
    small_batches(docs.sparkSession, 10_000)
    reached = verified_components(docs, distinct, words, radius, width, similarity, tile) if similarity else components(links(distinct, radius, width, tile))
    # a component's smallest doc_id; fingerprints without links are components of their own
    labelled = distinct.join(reached, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    least = labelled.groupBy("component").agg(F.min("first").alias("least"))
    named = labelled.join(least, "component").select("node", "least")
    joined = salted.join(by_salt.select("node", "salt").join(named, "node"), ["node", "salt"])
    digits = F.lower(F.concat_ws("", F.transform("print", lambda p: F.lpad(F.hex(p), 16, "0"))))
    return joined.select("doc_id", digits.alias("fingerprint"), F.col("least.doc_id").alias("component_id"), "text_key", F.col("least.text_key").alias("keep_key"))
