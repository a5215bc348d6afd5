import hashlib
import tarfile
import zlib
from collections import Counter

import pytest

from veilcraft.llm.media import decode_image, encode_image, features, image_header, media_columns, padded
from veilcraft.llm.mixing import mix_documents, mixed, schedule, shares
from veilcraft.llm.url_filter import judge_urls

from .conftest import ROWS


def test_media_round_trip(docs, tmp_path):
    want = []
    for i, t, *_ in ROWS:
        data = (t or "").encode()
        payload, image = padded(data), encode_image(data)
        want.append((str(i), len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest(), features(payload)))
    got = media_columns(docs, str(tmp_path), shard_bytes=1000).collect()
    assert sorted((str(r[0]), *r[1:8]) for r in got) == sorted(want)
    for r in got:
        with tarfile.open(tmp_path / r.shard) as tar:
            member = next(m for m in tar.getmembers() if m.offset_data == r.offset)
            assert member.name == f"{r.media_sha256}.png" and member.size == r.length


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_image(n):
    data = bytes(i * 7 % 256 for i in range(n))
    image = encode_image(data)
    assert decode_image(image) == padded(data) and image_header(image[:53]) == (64, max(1, -(-n // 64)), n)


def test_media_empty(empty, tmp_path):
    assert media_columns(empty, str(tmp_path)).count() == 0


def test_shares():
    mix = shares({"b": 100, "a": 1000, None: 10, "é": 0})
    assert [s.source for s in mix] == ["a", "b", "é", None]
    # 1665 to share by 5, 2, 1, 5: null and the empty source stop at 20 and 0, then b at 200
    assert [s.target for s in mix] == [1445.0, 200.0, 0.0, 20.0]


def test_mixing(docs):
    sizes = [len((r[1] or "").encode().split()) for r in ROWS]
    by = Counter()
    for r, n in zip(ROWS, sizes):
        by[r[3]] += n
    target = {s.source: s.target for s in shares(dict(by))}
    for block in (3, 1024):
        got = mix_documents(docs, block=block).collect()
        want = sorted((str(r[0]), n, by[r[3]], target[r[3]]) for r, n in zip(ROWS, sizes))
        assert sorted((str(r.doc_id), r["size"], r.source_size, r.target) for r in got) == want
        assert all(0 <= r.taken <= 2 * r["size"] for r in got)
        assert abs(sum(r.taken for r in got) - sum(target.values())) <= len(target)
        assert sorted(map(tuple, mix_documents(docs.repartition(5), block=block).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert mixed(docs).columns == docs.columns


def test_schedule_spreads_sources(spark):
    mix = shares({"a": 40_000, "b": 20_000, "c": 30_000})
    rows = schedule(spark, mix, 100).orderBy("slot").collect()
    for i, s in enumerate(mix):
        own = [r for r in rows if r.source_no == i]
        assert sum(r.tokens for r in own) == s.quota and sorted(r["rank"] for r in own) == list(range(len(own)))
    # every stretch holds the sources in nearly their proportions
    total = sum(s.target for s in mix)
    for at in range(0, len(rows) - 200, 100):
        got = Counter(r.source_no for r in rows[at : at + 100])
        assert all(abs(got[i] - 100 * s.target / total) < 8 for i, s in enumerate(mix))


def test_mixing_empty(empty):
    assert mix_documents(empty).count() == 0


URLS = [
    ("https://EN.Example.NET/en/1", "en.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://example.net/de/1?x=/en/", "example.net", "/de/1", "net/", "block"),
    ("http://example.net", "example.net", "", None, None),
    ("http://notexample.com/de/7#a", "notexample.com", "/de/7", None, None),
    ("http://a.b.org/fr/", "a.b.org", "/fr/", "org/fr/", "allow"),
    ("http://x.example.com/de/9.html", "x.example.com", "/de/9.html", "example.com/de/", "block"),
    ("no scheme/en/", "", "", None, None),
    ("a?b://h.org/fr/x://net/", "h.org", "/fr/x://net/", "org/fr/", "allow"),
    (None, "", "", None, None),
    ("http://bad.host.com/1/", "bad.host.com", "/1/", None, "block"),
    ("http://good.host.com/2", "good.host.com", "/2", None, "allow"),
]


def test_urls(spark):
    pages = [(i, u) for i, (u, *_) in enumerate(URLS)]
    pages += [(100 + i, f"http://{'bad' if i % 2 else 'good'}.host.com/{1000 + i}") for i in range(60)]
    outcomes = spark.createDataFrame([(1000 + i, (i + 1) % 2) for i in range(60)] + [(None, 1), (1, None)], "page_no bigint, good int")
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in pages], "page_id bigint, url string, host string, n int")
    got = {r.page_id: r for r in judge_urls(df, outcomes).collect()}
    assert len(got) == len(pages)
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert judge_urls(df.filter("false"), outcomes).count() == 0
    assert judge_urls(df, outcomes.filter("false")).count() == len(pages)
