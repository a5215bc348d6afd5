import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from veilcraft.llm import conversation_trie
from veilcraft.llm.conversation_trie import ends_digests, prefix_trie

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def turn_order(row):
    _, turn, role, text = row
    role, text = role or "", text or ""
    return turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows):
    convs = defaultdict(list)
    for row in sorted((r for r in rows if r[0] is not None), key=turn_order):
        convs[row[0]].append((row[2] or "", row[3] or ""))
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - int(c / 20) * 20  # the remainder has the sign of c
        made[c] = tuple(convs.get(c - first, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)

    def total(path):
        words = len(re.findall("[^\x20\x09-\x0d]+", path[-1][1])) if path else 0
        leaves, saved = int(not kids[path]), (len(members[path]) - 1) * words
        for kid in kids[path]:
            a, b = total(kid)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = set()
    for path, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(made[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.add((min(own), len(path), parent, len(own), len(kids[path]), *total(path), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def found(df):
    rows = [tuple(r) for r in prefix_trie(df).select(NAMES).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made(spark, rows):
    from pyspark.sql import functions as F

    clashes = ["part", "pos", "digest", "words", "share", "depth", "owner", "first", "n"]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(f"own {c}") for c in clashes}).repartition(3)


def test_odd_rows(spark):
    rows = [
        (0, 1, "user", "hello there"), (0, 2, "bot", "hi"), (0, 2, "bot", "hi"), (0, None, "system", "be kind"),
        (3, 0, None, "own start"), (3, 1, "user", None), (3, 1, "a", "tie"), (3, 1, "a", "tied"),
        (7, 1, "user", "hello there"), (7, 2, "bot", "hi"), (7, 2, "bot", "hi"), (7, None, "system", "be kind"),
        (25, 1, "user", "one"), (26, 1, "user", "one"), (27, 1, "user", "one"), (27, 5, "bot", "x" * 300_000 + " y"),
        (-21, 1, "user", "hello"), (-20, 3, "bot", "b"), (-3, 1, "u:1", ""), (-4, 1, "u", ":1"), (None, 1, "user", "no conversation"), (9_000_000_000, None, None, None),
    ]
    assert found(made(spark, rows)) == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PARTS", 3)
    monkeypatch.setattr(conversation_trie, "RUN", 2)
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-50, 200), 90):
        for t in range(rng.choice([1, 2, 3, 5, 40 if c % 9 == 0 else 4])):
            rows.append((c, t, rng.choice(["user", "bot"]), rng.choice(["a", "b c", "d  e f", ""]) if rng.random() < 0.4 else f"turn {t}"))
    assert found(made(spark, rows)) == brute(rows)


def test_chains_that_hang_from_chains(spark):
    # conversation 100 + i follows 100 + i - 1 for i turns and then leaves it, so each chain hangs from the one before
    rows = [(20 * (5 + i), t, "user", f"{t}" if t <= i else f"{t} of {i}") for i in range(9) for t in range(10)]
    assert found(made(spark, rows)) == brute(rows)


def test_one_long_conversation_and_many_alike(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "RUN", 30)
    rows = [(0, t, "user", f"turn {t} words") for t in range(200)] + [(20 + i, t, "user", f"turn {t} words") for i in range(400) for t in range(3)]
    assert found(made(spark, rows)) == brute(rows)


def test_ends_in_many_runs(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([(1, 2, i) for i in range(100)] + [(1, 3, -5), (2, 3, 9)], "owner bigint, depth bigint, conv_id bigint").repartition(5)
        out = {(r["owner"], r["depth"]): r["ends_sha256"] for r in ends_digests(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert out == {(1, 2): sha(",".join(map(str, range(100)))), (1, 3): sha("-5"), (2, 3): sha("9")}


def test_empty_table(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).collect() == []
