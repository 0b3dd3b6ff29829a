"""K-d tree shards hold their law, and their edge cases."""

import random
import zlib

import pytest

from ledgerlark.llm import sharding


def check(rows, pairs, shards, tolerance):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows if r.doc_id is not None) == sorted(
        (k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in pairs if k is not None
    )
    assert len(rows) == len(pairs)
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r)
    for own in by_shard.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    assert set(by_shard) <= set(range(shards))
    assert {(r.law, r.grown_shard) for r in rows} <= {("bytes", None)}
    sizes = [sum(r.size for r in by_shard.get(k, [])) for k in range(shards)]
    mean = sum(sizes) / shards
    assert max(sizes) - min(sizes) <= tolerance * mean, sizes


@pytest.fixture(scope="module")
def pairs():
    choose = random.Random(1)
    return [(k * 3, "".join(choose.choices("abcdé ", k=choose.choice([0, 5, 80, 900])))) for k in range(3000)]


def test_bytes_are_near_equal(make_docs, pairs):
    rows = sharding.kd_shards(make_docs(pairs), 16).collect()
    check(rows, pairs, 16, 0.1)


def test_hot_group_and_strange_rows(make_docs, pairs):
    more = pairs[:1500] + [(10_000 + k, "hot text " * 60) for k in range(700)] + [(20_000 + k, "pair") for k in range(40)]
    more += [(None, "no id"), (None, None), (1 << 62, ""), (-5, "x"), (7, "same"), (7, "same")]
    rows = sharding.kd_shards(make_docs(more), 6).collect()
    check(rows, more, 6, 0.1)
    assert len({r.shard for r in rows if r.text_crc32 == zlib.crc32(b"pair")}) == 1


def test_few_rows(make_docs):
    assert sharding.kd_shards(make_docs([]), 16).collect() == []
    rows = sharding.kd_shards(make_docs([(1, "a"), (2, None)]), 4).collect()
    check(rows, [(1, "a"), (2, None)], 4, 10)


def test_main_path_has_no_python(make_docs, pairs):
    plan = sharding.kd_shards(make_docs(pairs[:50]), 4)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
