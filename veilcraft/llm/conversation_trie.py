"""The prefix trie of conversations, without ever walking it from the root.

A conversation owns a prefix if it is the smallest one that starts with it, so from some depth on it owns all of its own prefixes and
none before. Prefixes have digests that are sums of position-tagged digests of their turns, so they come from running sums however
long a conversation is. One grouping gives each digest's smallest conversation; the first owned depth is then found by binary search,
four levels of it in each batched join against those minima. What a conversation owns is a chain of nodes that hangs from
a node of a smaller conversation's chain. Totals of subtrees are aggregated chain by chain from the bottom up, and within a chain
by running sums from its end.

Only numbers and digests are shuffled, never texts. Rows of a conversation are dealt out by ranges of their order, nodes by
their prefix, and members of a prefix are counted and looked up in shares, so neither a conversation nor a first turn that
holds a third of all rows meets in one task. The numbers of the conversations that end in one node are joined in
runs by many tasks; one task then streams these runs through SHA-256, which has no other order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE_SPACE, hash_bits, settled, small_batches

#: Conversations whose numbers lie in one group of so many take turns from the group's first one, fewer than MOST.
GROUP, MOST = 20, 4
#: Parts that one batched join cuts an interval of depths into: four levels of a binary search.
PARTS = 16
#: Depths of a chain that are summed together.
RUN = 1024

_PIECES = 4
_MASK = 0xFFFFFFFF


def _sums_before(rows: DataFrame, keys: list[str], bucket: Column, order: Column, values: dict[str, Column]) -> DataFrame:
    """``rows`` and for each of ``values`` its sum over earlier rows of the same keys; the rows of one bucket meet in a task."""
    rows = rows.withColumn("_bucket", bucket).withColumns({f"_v_{k}": v for k, v in values.items()})
    sums = rows.groupBy(*keys, "_bucket").agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in values])
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "_bucket", *[F.coalesce(F.sum(f"_s_{k}").over(earlier), F.lit(0)).alias(f"_s_{k}") for k in values])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(starts, [*keys, "_bucket"])
    rows = rows.withColumns({k: F.col(f"_s_{k}") + F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0)) for k in values})
    return rows.drop("_bucket", *[f"_{x}_{k}" for x in "vs" for k in values])


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, part, pos, digest and words of each turn: its place in its conversation, and the part of the sorted table that holds it."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.regexp_count(text, F.lit(f"[^{WHITE_SPACE}]+")).cast("long").alias("words"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "words", F.monotonically_increasing_id().alias("seq"))
    ordered = settled(ordered).withColumn("part", F.shiftright("seq", 33))
    shares = ordered.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = shares.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).drop("n", "first")
    return ordered.join(starts, ["conv_id", "part"]).select("conv_id", "part", (F.col("start") + F.col("seq")).alias("pos"), "digest", "words")


def _taken(conv: str) -> Column:
    """How many first turns a conversation takes from the first one of its group."""
    return F.crc32(F.col(conv).cast("string")) % MOST


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, part, pos, digest, words) of the rebuilt conversations' turns, and (conv_id, length) of every conversation."""
    sizes = settled(turns.groupBy("conv_id").agg(F.count("*").alias("n")))
    first = F.col("conv_id") - F.col("conv_id") % GROUP
    firsts = sizes.filter(F.col("conv_id") == first).select(F.col("conv_id").alias("first"), F.col("n").alias("there"))
    convs = sizes.withColumn("first", first).withColumn("taken", _taken("conv_id")).join(firsts, "first", "left")
    convs = settled(convs.withColumn("got", F.least("taken", F.coalesce("there", F.lit(0)))).drop("there"))
    # a turn that is taken comes to at most GROUP conversations
    lent = turns.filter((F.col("pos") < MOST - 1) & (F.col("conv_id") % GROUP == 0)).select(F.col("conv_id").alias("first"), "pos", "digest", "words")
    lent = convs.select("conv_id", "first", "taken").join(lent, "first").filter(F.col("pos") < F.col("taken"))
    # own turns move where the group's first conversation is shorter than what is taken
    moved = convs.filter("got < taken").select("conv_id", (F.col("got") - F.col("taken")).alias("by"))
    parts = turns.groupBy("conv_id", "part").agg(F.count("*").alias("_n")).join(moved, "conv_id").drop("_n")
    own = turns.filter(F.col("pos") >= _taken("conv_id")).join(parts, ["conv_id", "part"], "left")
    own = own.select("conv_id", "part", (F.col("pos") + F.coalesce("by", F.lit(0))).alias("pos"), "digest", "words")
    lent = lent.select("conv_id", F.lit(-1).cast("long").alias("part"), "pos", "digest", "words")
    length = F.col("got") + F.greatest(F.col("n") - F.col("taken"), F.lit(0))
    return own.unionByName(lent), convs.select("conv_id", length.alias("length"))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, the digest (k1, k2) of the prefix that ends with this turn, its words, and a share by the conversation's hash."""
    tagged = F.sha2(F.concat_ws(":", F.col("pos").cast("string"), "digest"), 256)
    rows = turns.withColumn("tagged", tagged)
    pieces = {f"x{j}": F.conv(F.substring("tagged", 8 * j + 1, 8), 16, 10).cast("long") for j in range(_PIECES)}
    rows = rows.withColumns(pieces).drop("tagged", "digest")
    summed = _sums_before(rows, ["conv_id"], F.col("part"), F.col("pos"), {f"y{j}": F.col(f"x{j}") for j in range(_PIECES)})
    low = [(F.col(f"x{j}") + F.col(f"y{j}")).bitwiseAND(_MASK) for j in range(_PIECES)]
    key = lambda a, b: F.shiftleft(a, 32).bitwiseOR(b)
    share = F.xxhash64("conv_id", F.lit("share"))
    return summed.select("conv_id", (F.col("pos") + 1).alias("depth"), key(low[0], low[1]).alias("k1"), key(low[2], low[3]).alias("k2"), "words", share.alias("share"))


_PREFIX = ["depth", "k1", "k2"]


def minima(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The smallest conversation (owner) of each prefix: as nodes (with n_convs and words), and as a table to look up by prefix and share."""
    shares = settled(rows.groupBy(*_PREFIX, "share").agg(F.min("conv_id").alias("least"), F.count("*").alias("n"), F.max("words").alias("words")))
    nodes = settled(shares.groupBy(*_PREFIX).agg(F.min("least").alias("owner"), F.sum("n").alias("n_convs"), F.max("words").alias("words")))
    return nodes, settled(shares.select(*_PREFIX, "share").join(nodes.select(*_PREFIX, "owner"), _PREFIX))


def first_owned(convs: DataFrame, rows: DataFrame, owners: DataFrame, root: int) -> DataFrame:
    """``convs`` (conv_id, length) with first (its first owned depth below the root, or length + 1) and above (who owns the prefix before it)."""
    found = settled(convs.select("conv_id", "length", F.lit(1).cast("long").alias("low"), (F.col("length") + 1).alias("high"), F.lit(root).cast("long").alias("above")))
    keys = rows.select("conv_id", *_PREFIX, "share")
    while found.filter("low < high").limit(1).count():
        j = F.explode(F.expr(f"array_distinct(transform(sequence(0, {PARTS - 1}), j -> low + (high - low) * j div {PARTS}))"))
        probes = found.filter("low < high").select("conv_id", j.alias("depth")).join(keys, ["conv_id", "depth"])
        seen = probes.join(owners, [*_PREFIX, "share"])
        own = F.col("owner") == F.col("conv_id")
        cut = seen.groupBy("conv_id").agg(
            F.min(F.when(own, F.col("depth"))).alias("hit"),
            F.max(F.when(~own, F.struct(F.col("depth").alias("d"), F.col("owner").alias("o")))).alias("miss"),
        )
        found = settled(
            found.join(cut, "conv_id", "left").select(
                "conv_id", "length", F.coalesce(F.col("miss.d") + 1, F.col("low")).alias("low"), F.coalesce("hit", "high").alias("high"), F.coalesce(F.col("miss.o"), F.col("above")).alias("above")
            )
        )
    return found.select("conv_id", "length", F.col("low").alias("first"), "above")


def _chain_totals(chains: DataFrame) -> DataFrame:
    """conv_id, leaves and saved of each chain's whole subtree, from ``chains`` (conv_id, above, leaves, saved, waits for so many chains below)."""
    left, done = settled(chains), []
    while True:
        ready = left.filter("waits = 0")
        done.append(ready.select("conv_id", "leaves", "saved"))
        rest = left.filter("waits > 0")
        if not rest.limit(1).count():
            return reduce(DataFrame.unionByName, done)
        up = ready.groupBy(F.col("above").alias("conv_id")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"), F.count("*").alias("_n"))
        plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        left = settled(rest.join(up, "conv_id", "left").select("conv_id", "above", plus("leaves", "_leaves"), plus("saved", "_saved"), (F.col("waits") - F.coalesce("_n", F.lit(0))).alias("waits")))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (owner, depth, conv_id) as runs of one node: its first number and all of them, comma-joined."""
    for batch in batches:
        if not batch.num_rows:
            continue
        owner, depth, conv = (batch.column(c).to_numpy() for c in ("owner", "depth", "conv_id"))
        cuts = np.flatnonzero((owner[1:] != owner[:-1]) | (depth[1:] != depth[:-1])) + 1
        begins = np.concatenate([[0], cuts])
        texts = [",".join(map(str, x)) for x in np.split(conv, cuts)]
        yield pa.RecordBatch.from_arrays([pa.array(owner[begins]), pa.array(depth[begins]), pa.array(conv[begins]), pa.array(texts, pa.string())], ["owner", "depth", "least", "ends"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 for each node from its runs in order; only one run is held at a time."""
    node, state = None, None
    for batch in batches:
        out: list[tuple[int, int, str]] = []
        for owner, depth, ends in zip(batch.column("owner").to_pylist(), batch.column("depth").to_pylist(), batch.column("ends")):
            if (owner, depth) == node:
                state.update(b",")
            else:
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (owner, depth), hashlib.sha256()
            state.update(ends.as_buffer())
        if out:
            yield _hashes(out)
    if node:
        yield _hashes([(*node, state.hexdigest())])


def _hashes(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["owner", "depth", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """owner, depth and ends_sha256 of each node where a conversation ends, from ``ends`` (owner, depth, conv_id)."""
    order = ["owner", "depth", "conv_id"]
    runs = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_joined, "owner bigint, depth bigint, least bigint, ends string")
    dealt = runs.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "least")
    return dealt.mapInArrow(_hashed, "owner bigint, depth bigint, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each distinct prefix of the rebuilt ``conversations`` (conv_id, turn, role, text).

    Turns are ordered by turn, null first; turns of one number by role, then by the digest of role and text, so rows that are
    alike follow each other and each counts. A null role or text is empty. Rows without conv_id belong to no conversation and are left
    out. Of a conversation's turns the first ones come from the first conversation of its group, so one may
    have none; it is a member of the root. An empty table gives no rows. Other columns are ignored.

    Columns: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    small_batches(conversations.sparkSession)
    turns, convs = rebuilt(_turns(conversations))
    convs = settled(convs)
    total = convs.agg(F.min("conv_id").alias("root"), F.count("*").alias("n")).first()
    root = total["root"] or 0
    rows = settled(prefixes(turns))
    rows = rows.withColumn("share", F.shiftright("share", 64 - hash_bits(rows.count())))
    nodes, owners = minima(rows)
    owned = first_owned(convs, rows, owners, root)
    # the root's owner has the chain that begins with the root
    top = F.col("conv_id") == root
    owned = settled(owned.withColumn("first", F.when(top, 0).otherwise(F.col("first"))).withColumn("above", F.when(~top, F.col("above"))))
    chains = owned.filter("first <= length")

    hangs = chains.filter(~top).groupBy(F.col("above").alias("conv_id"), (F.col("first") - 1).alias("depth")).agg(F.count("*").alias("hang"))
    hangs = settled(hangs)
    base = nodes.select(F.col("owner").alias("conv_id"), "depth", "n_convs", "words")
    own = base.groupBy("conv_id").agg(F.sum((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    at_end = hangs.select("conv_id", F.col("depth").alias("length"), "hang")
    waits = hangs.groupBy("conv_id").agg(F.sum("hang").alias("waits"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    chain_rows = (
        chains.join(at_end, ["conv_id", "length"], "left").join(own, "conv_id", "left").join(waits, "conv_id", "left")
        .select("conv_id", "above", F.col("hang").isNull().cast("long").alias("leaves"), zero("saved"), zero("waits"))
    )
    totals = _chain_totals(chain_rows)

    # what each node gets from outside its chain: chains that hang from it, and where the chain begins and ends
    nothing = F.lit(0).cast("long")
    below = chains.filter(~top).join(totals, "conv_id").select(F.col("above").alias("conv_id"), (F.col("first") - 1).alias("depth"), F.lit(1).alias("kids"), "leaves", "saved", F.lit(None).cast("long").alias("parent"))
    begins = chains.filter(~top).select("conv_id", F.col("first").alias("depth"), F.lit(0).alias("kids"), nothing.alias("leaves"), nothing.alias("saved"), F.col("above").alias("parent"))
    ends = chains.select("conv_id", F.col("length").alias("depth"), F.lit(-1).alias("kids"), nothing.alias("leaves"), nothing.alias("saved"), F.lit(None).cast("long").alias("parent"))
    marks = below.unionByName(begins).unionByName(ends).groupBy("conv_id", "depth")
    marks = marks.agg(F.sum("kids").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("parent").alias("parent"))
    top_node = owned.filter(top).select("conv_id", nothing.alias("depth"), F.lit(total["n"]).cast("long").alias("n_convs"), nothing.alias("words"))
    rows = base.unionByName(top_node).join(marks, ["conv_id", "depth"], "left")
    n_children = 1 + F.coalesce("kids", F.lit(0))
    rows = rows.withColumn("n_children", n_children).withColumn("parent_conv_id", F.when((F.col("conv_id") != root) | (F.col("depth") > 0), F.coalesce("parent", "conv_id")))
    leaf = F.coalesce("leaves", F.lit(0)) + (F.col("n_children") == 0).cast("long")
    saved = F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("words")
    rows = rows.withColumns({"leaf": leaf, "save": saved}).drop("leaves", "saved", "kids", "parent")
    summed = _sums_before(rows, ["conv_id"], -F.floor(F.col("depth") / RUN), F.col("depth").desc(), {"leaves": F.col("leaf"), "saves": F.col("save")})

    owner = F.when(F.col("first") <= F.col("length"), F.col("conv_id")).otherwise(F.col("above"))
    hashes = ends_digests(owned.select(owner.alias("owner"), F.col("length").alias("depth"), "conv_id"))
    hashes = hashes.withColumnRenamed("owner", "conv_id")
    return summed.join(hashes, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), (F.col("leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("saves") + F.col("save")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
