import math
import struct
import zlib
from collections import Counter

import pytest
import xxhash

from kestrel.llm import sharding


def test_growth_moves_rows_only_into_the_new_shard(make):
    df = make([(i, f"text {i}") for i in range(2000)])
    a = {r.doc_id: r for r in sharding.shard_documents(df, 40).collect()}
    b = {r.doc_id: r.shard for r in sharding.shard_documents(df, 41).collect()}
    assert all(r.grown_shard == b[i] for i, r in a.items())
    assert all(r.grown_shard in (r.shard, 40) for r in a.values())
    assert 0 < sum(r.shard != r.grown_shard for r in a.values()) < 2000 * 3 / 41


def test_weights_are_followed(make):
    df = make([(i, "t") for i in range(6000)])
    n = Counter(r.shard for r in sharding.shard_documents(df, 3, weights=[1.0, 2.0, 0.0]).collect())
    assert set(n) == {0, 1} and abs(n[1] / n[0] - 2) < 0.2
    with pytest.raises(ValueError):
        sharding.shard_documents(df, 2, weights=[1.0])


def test_slots_have_no_gaps_and_place_is_stable(spark, make):
    df = make([(i, f"text {i}") for i in range(3000)] + [(7, "again")] * 500)
    out = sharding.shard_documents(df, 5, rows_per_group=50)
    rows = out.collect()
    for s in range(5):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    again = sharding.shard_documents(df.repartition(7), 5, rows_per_group=50).collect()
    key = lambda r: (r.doc_id, r.text_crc32, r.shard, r.slot)
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_a_key_with_many_texts_is_spread_over_groups(make):
    df = make([(7, f"text {i} " + "x" * (i % 50)) for i in range(3000)] + [(100 + i, "t") for i in range(3000)])
    rows = sharding.shard_documents(df, 4, rows_per_group=50).collect()
    hot = next(r.shard for r in rows if r.doc_id == 7)
    assert {r.shard for r in rows if r.doc_id == 7} == {hot}
    slots = sorted(r.slot for r in rows if r.doc_id == 7)
    assert slots[-1] - slots[0] + 1 > len(slots) + 500                  # other keys stand between them
    placed = sharding.assign(df, [1.0] * 4)
    assert sharding.with_groups(placed, 4, 50).groupBy("shard", "grp").count().agg({"count": "max"}).first()[0] < 150


def test_odd_rows(odd, empty):
    rows = sharding.shard_documents(odd, 40).collect()
    assert len(rows) == odd.count()
    texts = {r.doc_id: r.text or "" for r in odd.collect() if r.doc_id is not None}
    for r in rows:
        if r.doc_id is not None:
            assert r["size"] == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
    assert sharding.shard_documents(empty, 40).count() == 0


def test_native(make):
    plan = sharding.shard_documents(make([(1, "a")]), 4)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


MASK = (1 << 64) - 1


def spark_hash(*parts):
    """Spark's ``xxhash64`` of texts, ints and longs, as unsigned."""
    h = 42
    for x, kind in parts:
        raw = x.encode() if kind == "s" else struct.pack("<i" if kind == "i" else "<q", x)
        h = xxhash.xxh64(raw, seed=h).intdigest()
    return h


def brute(rows, weights, rows_per_group):
    """``(doc_id, size, crc, shard, slot)`` of all rows, one by one; ids are not null."""
    placed = []
    for doc_id, text in rows:
        raw, key = (text or "").encode(), f"id:{doc_id}"
        score = [(-w / math.log(((spark_hash((key, "s"), (s, "i")) >> 12) + 0.5) / (1 << 52)), -s) for s, w in enumerate(weights) if w > 0]
        placed.append((-max(score)[1], key, zlib.crc32(raw), len(raw) + 16, doc_id))
    out = []
    for s in range(len(weights)):
        mine = [p for p in placed if p[0] == s]
        groups = max(1, len(mine) // rows_per_group)

        def group(p):
            h = spark_hash(("slot", "s"), (p[1], "s"), (p[2], "l"), (p[3], "l"))
            return (h - (1 << 64) if h >> 63 else h) % groups
        for slot, p in enumerate(sorted(mine, key=lambda p: (group(p), p[1], p[2], p[3]))):
            out.append((p[4], p[3], p[2], s, slot))
    return out


@pytest.mark.parametrize("weights", [[1.0] * 7, [1.0, 3.0, 0.0, 0.5]])
def test_shards_and_slots_equal_brute_force(make, weights):
    rows = [(i, f"text {i % 90} é🎉" * (i % 4)) for i in range(700)] + [(7, "again")] * 130 + [(8, f"t{i}") for i in range(200)] + [(9, None)] * 3
    for rows_per_group in (20, 10_000):
        got = sharding.shard_documents(make(rows), len(weights), weights, rows_per_group=rows_per_group).collect()
        mean = sum(weights) / len(weights)
        moved = {i: s for i, _, _, s, _ in brute(rows, [*weights, mean], 20)}
        assert sorted((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got) == sorted(brute(rows, weights, rows_per_group))
        assert all(r.grown_shard == moved[r.doc_id] for r in got)
