import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilcraft.llm import simhash
from veilcraft.llm.components import components
from veilcraft.llm.exact_dedup import BASES, PRIMES, exact_duplicates, polynomial, power_table
from veilcraft.llm.simhash import fingerprint, links, near_duplicates

from .conftest import ROWS

BIG = 2**63 - 1


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def expected_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in rows]
    best = {}
    for (i, t, *_), n in zip(rows, norm):
        k = (-len(t or ""), BIG if i is None else i)
        best[n] = min(best.get(n, k), k)
    ids = [BIG if r[0] is None else r[0] for r in rows]
    null = lambda x: None if x == BIG else x
    return sorted(
        (str(null(i)), str(null(best[n][1])), norm.count(n), i == best[n][1], hashlib.sha256(n.encode()).hexdigest()) for i, n in zip(ids, norm)
    )


# tiny primes make different texts share fingerprints
@pytest.mark.parametrize(("chunk", "primes"), [(1 << 15, PRIMES), (7, PRIMES), (16, (3, 2))])
def test_exact_against_brute_force(docs, chunk, primes):
    rows = [(str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact_duplicates(docs, chunk, primes).collect()]
    assert sorted(rows) == expected_exact(ROWS)


def test_chunk_hashes_add_up():
    data = bytes(random.Random(1).randrange(256) for _ in range(1000))
    for base, prime in zip(BASES, PRIMES):
        whole = sum(b * pow(base, i, prime) for i, b in enumerate(data)) % prime
        powers = power_table(base, prime, 100)
        parts = sum(pow(base, o, prime) * polynomial(data[o : o + 100], base, prime, powers) for o in range(0, 1000, 100)) % prime
        assert whole == parts


def test_exact_empty(empty):
    assert exact_duplicates(empty).count() == 0


def test_hot_group(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text")).otherwise(F.col("id").cast("string")).alias("text"))
    out = exact_duplicates(df).filter("group_size > 1").collect()
    assert len(out) == 167 and {r.keep_id for r in out} == {0} and sum(r.kept for r in out) == 1


def test_fingerprint_by_hand():
    import xxhash

    h = [xxhash.xxh64_intdigest(s, 42) for s in (b"a b c", b"b c d", b"a b c")]
    bits = sum(1 << k for k in range(64) if sum(x >> k & 1 for x in (h[0], h[1])) * 2 > 2)
    assert fingerprint("A  b\tC d") == ([bits], 2)
    assert fingerprint("One", width=2) == ([xxhash.xxh64_intdigest(b"one", s) for s in (42, 43)], 1) and fingerprint(" \n") == ([0], 0)


@pytest.mark.parametrize("words", [1, 3, 5])
def test_long_texts_are_hashed_in_runs(monkeypatch, words):
    from veilcraft.llm import common

    rnd = random.Random(words)
    texts = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(n)) for n in (0, 1, 4, 5, 6, 200, 999)]
    whole = [fingerprint(t, words, 2) for t in texts]
    monkeypatch.setattr(simhash, "runs", lambda text: common.runs(text, 7))
    assert [fingerprint(t, words, 2) for t in texts] == whole


def test_near_against_brute_force(docs):
    prints = [fingerprint(r[1] or "")[0][0] for r in ROWS]
    root = roots(len(ROWS), [(i, j) for i in range(len(ROWS)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    ids = lambda k: [ROWS[i][0] for i in range(len(ROWS)) if root[i] == root[k] and ROWS[i][0] is not None]
    want = sorted((str(r[0]), f"{p:016x}", str(min(ids(k), default=None))) for k, (r, p) in enumerate(zip(ROWS, prints)))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in near_duplicates(docs).collect()) == want


def test_near_empty(empty):
    assert near_duplicates(empty).count() == 0


@pytest.mark.parametrize("tile", [4, 1024])
def test_links_lose_no_component(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rnd = random.Random(tile)
    centres = [rnd.getrandbits(64) for _ in range(5)] + [0, 2**64 - 1]
    prints = set()
    for _ in range(600):
        x = rnd.choice(centres)
        for _ in range(rnd.randint(0, 7)):
            x ^= 1 << rnd.randrange(64)
        prints.add(x)
    signed = [int(np.uint64(x).view(np.int64)) for x in prints]
    found = links(spark.createDataFrame([(x, [x], 1) for x in signed], "node bigint, print array<bigint>, shingles bigint"))
    got = {r.node: r.component for r in components(found).collect()}
    all_ = list(prints)
    root = roots(len(all_), [(i, j) for i in range(len(all_)) for j in range(i) if (all_[i] ^ all_[j]).bit_count() <= 2])
    groups, want = {}, {}
    for i, x in enumerate(signed):
        groups.setdefault(got.get(x, x), set()).add(x)
        want.setdefault(root[i], set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def split(prints, pairs):
    at = {p: i for i, p in enumerate(prints)}
    return roots(len(prints), [(at[a], at[b]) for a, b in pairs])


def forest(home, blocks, radius):
    array = lambda x: np.array(x, dtype=np.uint64)
    block = simhash.Block(array(home)[:, None], array(home).view(np.int64), radius)
    for b in blocks:
        block.visit(array(b)[:, None], array(b).view(np.int64))
    return block.found


@pytest.mark.parametrize(("tile", "radius"), [(4, 30), (1024, 25)])
def test_wide_fingerprints_against_brute_force(spark, tile, radius):
    rnd = random.Random(tile)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(60, 250))]
        for _ in range(rnd.randint(1, 6)):
            own = list(base)
            for _ in range(rnd.choice([0, 1, 2, 3, 12])):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            rows.append((len(rows), " ".join(own)))
    found = [fingerprint(t, 5, 2) for _, t in rows]
    bits = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(found[a][0], found[b][0]))
    shingles = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    like = [(i, j) for i in range(len(rows)) for j in range(i) if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])]
    near = [(i, j) for i, j in like if bits(i, j) <= radius]
    wide = sum(bits(i, j) <= radius for i in range(len(rows)) for j in range(i))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, radius, 2, 0.8, tile).collect()
    assert [r.component_id for r in sorted(got)] == roots(len(rows), near)
    # candidates are not links, and few links are lost
    assert len(like) > 15 and len(near) >= 0.95 * len(like) and wide > len(near)


def test_similar_texts_of_one_group_are_parted(spark):
    # neighbours in a chain are alike, its ends are not; another text has a near fingerprint and is like none
    words = [f"w{i}" for i in range(120)]
    chain = [" ".join(f"x{j}" if j < 6 * k else w for j, w in enumerate(words)) for k in range(6)]
    far = " ".join("y" if j % 9 == 0 else w for j, w in enumerate(words))
    docs = spark.createDataFrame(list(enumerate([*chain, far])), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, 5, 60, 2, 0.8).collect()}
    assert got == {**{k: 0 for k in range(6)}, 6: 6}


@pytest.mark.parametrize("seed", range(5))
def test_candidates_lose_no_link(seed):
    rnd = np.random.default_rng(seed)
    prints = np.unique(rnd.integers(0, 1 << 9, 90, dtype=np.uint64))
    nodes, radius = np.arange(len(prints)), 1
    true = rnd.random((len(prints), len(prints))) < 0.5
    facts = np.ones((len(prints), 1), dtype=np.int64)
    near = {(i, j) for i in nodes for j in range(min(i, 40)) if (int(prints[i]) ^ int(prints[j])).bit_count() <= radius}

    def found(facts, rest):
        block = simhash.Candidates(prints[:40, None], nodes[:40], facts[:40], radius, 0.8, rest)
        pairs = [block.visit(prints[i : i + 7, None], nodes[i : i + 7], facts[i : i + 7]) for i in range(40, len(prints), 7)]
        return {(max(a, b), min(a, b)) for a, b in np.concatenate([*pairs, block.links()]).tolist()}

    first = found(facts, False)
    assert first <= near and {x for p in first for x in p} == {x for p in near for x in p}
    part = roots(len(prints), [p for p in first if true[p]])
    rest = found(np.column_stack([facts, part]), True)
    assert rest == {(i, j) for i, j in near if part[i] != part[j]}
    assert roots(len(prints), [p for p in first | rest if true[p]]) == roots(len(prints), [p for p in near if true[p]])


def test_links_when_a_label_falls(spark):
    # one chain a5-a7-v-a3, whose middle is a visitor of another tile
    bits = lambda *ks: sum(1 << k for k in ks)
    v, homes = bits(0, 16), [bits(0, 3, 16, 18), bits(1, 4, 16, 17), bits(0, 1, 16, 17)]
    for order in permutations(homes):
        found = forest(order, [[v]], 2)
        assert set(split([*order, v], found)) == {0} and len(found) == 3
    found = links(spark.createDataFrame([(p, [p], 1) for p in [*homes, v]], "node bigint, print array<bigint>, shingles bigint").coalesce(1)).collect()
    assert set(split([*homes, v], found)) == {0}


@pytest.mark.parametrize("seed", range(20))
def test_links_of_many_blocks_are_a_forest(seed):
    rnd = random.Random(seed)
    prints = rnd.sample(range(1 << 9), 110)
    home, blocks = prints[:50], [prints[i : i + 6] for i in range(50, 110, 6)]
    found = forest(home, blocks, 1)
    # visitors are compared with homes, not with one another
    near = [(i, j) for i in range(110) for j in range(min(i, 50)) if (prints[i] ^ prints[j]).bit_count() <= 1]
    assert split(prints, found) == roots(110, near) and len(found) == 110 - len(set(roots(110, near)))


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(5, i) for i in range(1000, 1200)]
    got = {r.node: r.component for r in components(spark.createDataFrame([*path, *star, (7, 7), (None, 3)], "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(1000, 1200)} == {5} and 7 not in got


@pytest.mark.parametrize("tile", [3, 1024])
def test_remaining_links_are_a_forest_of_similar_pairs(spark, tile):
    # all fingerprints are near, but only few sets are similar: neither all pairs nor all near ones may come out
    rnd = np.random.default_rng(tile)
    sets = [np.unique(rnd.integers(0, 60, 40)) for _ in range(60)]
    sets[1:4], sets[40] = [np.append(sets[0], 100 + i) for i in range(3)], np.append(sets[20], 200)
    rows = [(i * 7 - 100, [i % 4], 30, i // 2, x.tolist()) for i, x in enumerate(sets)]
    parts = spark.createDataFrame(rows, "node bigint, print array<bigint>, shingles bigint, part bigint, set array<bigint>")
    found = simhash.remaining_links(parts.drop("set"), parts.select("node", "set"), 4, 1, 0.8, tile).collect()
    like = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
    true = [(i, j) for i in range(60) for j in range(i) if i // 2 != j // 2 and like(sets[i], sets[j])]
    got = [((r.a + 100) // 7, (r.b + 100) // 7) for r in found]
    assert roots(60, got) == roots(60, true) and len(true) >= 5
    assert len(got) <= (30 if tile == 1024 else 20 * 60)


def test_second_round_makes_rows_in_proportion_to_a_group(spark, monkeypatch):
    # one group of texts with near fingerprints that aren't similar enough: its pairs must not be written
    words = [f"w{i}" for i in range(300)]
    rnd = random.Random(1)
    rows = [(k, " ".join("x%d_%d" % (k, i) if i in own else w for i, w in enumerate(words))) for k in range(120) for own in [set(rnd.sample(range(300), 12))]]
    made = []
    real = simhash.settled
    monkeypatch.setattr(simhash, "settled", lambda df: made.append(real(df)) or made[-1])
    pairs = []
    real_similar = simhash.similar
    monkeypatch.setattr(simhash, "similar", lambda near, *rest: pairs.append(near.count()) or real_similar(near, *rest))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, 60, 2, 0.8).collect()
    assert sorted(r.component_id for r in got) == list(range(120))
    assert sum(pairs) <= 4 * 120 and max(df.count() for df in made) <= 8 * 120
