import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from veilcraft.llm.common import TokenIds
from veilcraft.llm.packing import Complements, _intervals, pack_documents, plan
from veilcraft.llm.queries import tokenizer_file
from veilcraft.llm.token_store import EliasFano, token_store

from .conftest import ROWS

FILES = {"byte_bpe_50k.json": True, "word_bpe_49k.json": False}


def plain(name):
    tokenizer = Tokenizer.from_file(tokenizer_file(name))
    tokenizer.encode_special_tokens = True
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_cut_texts_have_the_ids_of_whole_texts(name):
    rnd = random.Random(3)
    alphabet = " \n\t\r\x0b\x1c  abXY09.,,..'s!_é́ΣßİŁ…”　  "
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(5000)] + [r[1] or "" for r in ROWS]
    texts += ["x, y.z ,q . r", "a.b,c 1,2 3.4", "a_,b", "<|endoftext|> a", " lead\n trail \n", "\n\n", "ends with a space "]
    tokens, encode = TokenIds(tokenizer_file(name), FILES[name], memo=2000), plain(name)
    for i in range(0, len(texts), 64):
        for t, ids in zip(texts[i : i + 64], tokens.batch(texts[i : i + 64])):
            assert np.frombuffer(ids, dtype="<u4").tolist() == encode(t), repr(t)


def test_elias_fano():
    rnd = np.random.default_rng(1)
    for n in (1, 2, 255, 256, 257, 3000):
        for top in (1, 50, 10**7):
            values = np.sort(rnd.integers(0, top, n))
            ef = EliasFano.encode(values)
            assert (ef.all() == values).all()
            assert [ef.select(i) for i in range(0, n, 5)] == values[::5].tolist()
    # near 2 + log2(u / n) bits an entry, against 64
    values = np.arange(0, 3_000_000, 300)
    ef = EliasFano.encode(values)
    assert (len(ef.low) + len(ef.high) + 8 * len(ef.samples)) * 8 / len(values) < 2 + np.log2(300) + 1


@pytest.mark.parametrize("shard_ids", [30, 4_000_000])
def test_token_store(docs, tmp_path, shard_ids):
    encode = plain("byte_bpe_50k.json")
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for r in rows:
        ids = np.array([*encode(r[1]), 2], dtype="<u4")
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = token_store(docs, tokenizer_file("byte_bpe_50k.json"), path=str(tmp_path / "s"), shard_ids=shard_ids).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_token_store_empty(empty, tmp_path):
    assert token_store(empty, tokenizer_file("byte_bpe_50k.json"), path=str(tmp_path / "s")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_index_of_complements_against_all_combinations(seed):
    rnd = random.Random(seed)
    free = np.array([0, *(rnd.choice([0, 0, 1, 2, 3]) for _ in range(24))])
    index = Complements(free)

    def exists(gap, n, least=1):
        if n == 0:
            return gap == 0
        for a in range(least, gap + 1):
            if free[a] > 0:
                free[a] -= 1
                found = exists(gap - a, n - 1, a)
                free[a] += 1
                if found:
                    return True
        return False

    while free.any():
        for gap in range(1, 25):
            for n, find in ((1, index.single), (2, index.pair), (3, index.triple)):
                got = find(gap)
                assert (got is not None) == exists(gap, n)
                if got:
                    assert sum(got) == gap and len(got) == n and all(free[x] >= got.count(x) for x in got)
        used = rnd.choice(np.flatnonzero(free).tolist())
        free[used] -= 1


@pytest.mark.parametrize("seed", range(12))
def test_plan_uses_every_piece_once(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([7, 50, 300, 2048])
    counts = {}
    for _ in range(rnd.choice([3, 60, 2000])):
        n = rnd.randint(1, capacity) if seed % 2 else min(capacity, max(1, int(rnd.gauss(capacity / 3, capacity / 6))))
        counts[n] = counts.get(n, 0) + rnd.choice([1, 1, 5])
    used = {}
    patterns = plan(counts, capacity)
    for pattern, times in patterns:
        assert sum(pattern) <= capacity and times > 0
        for n in pattern:
            used[n] = used.get(n, 0) + times
    assert used == counts
    # about as good as first-fit decreasing, or better
    bins = []
    for n in sorted((n for n, k in counts.items() for _ in range(k)), reverse=True):
        for i, left in enumerate(bins):
            if left >= n:
                bins[i] -= n
                break
        else:
            bins.append(capacity - n)
    assert sum(t for _, t in patterns) <= 1.005 * len(bins) + 1
    spans = {}
    for n, first, last, *_ in _intervals(patterns):
        spans.setdefault(n, []).append((first, last))
    assert all(sorted(s)[-1][1] == counts[n] for n, s in spans.items())


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing(docs, capacity):
    encode = plain("word_bpe_49k.json")
    want = []
    for r in ROWS:
        ids = np.array([*encode(r[1]), 0], dtype="<u4")
        want += [(str(r[0]), k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(ids[k : k + capacity].tobytes())) for k in range(0, len(ids), capacity)]
    got = pack_documents(docs, tokenizer_file("word_bpe_49k.json"), capacity=capacity).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


def test_packing_empty(empty):
    assert pack_documents(empty, tokenizer_file("word_bpe_49k.json")).count() == 0
