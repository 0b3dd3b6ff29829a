"""Range join and top-k against brute force, and their edge cases."""

import math

import numpy as np
import pytest

from ledgerlark.llm import metric_join, topk

NAN, INF = float("nan"), float("inf")


def linked(pairs, threshold):
    """n_links and component of each row by comparing all."""
    good = []
    for k, (_, v) in enumerate(pairs):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.append((k, np.pad(np.array(v, dtype=np.float32).astype(float), (0, 8 - len(v)))))
    links, root = [0] * len(pairs), list(range(len(pairs)))
    for a, (i, x) in enumerate(good):
        for j, y in good[:a]:
            if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[i] += 1
                links[j] += 1
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    least = {}
    for k, r in enumerate(root):
        if pairs[k][0] is not None:
            least[r] = min(least.get(r, pairs[k][0]), pairs[k][0])
    return sorted(((pairs[k][0], links[k], least.get(root[k])) for k in range(len(pairs))), key=str)


@pytest.fixture(scope="module")
def vectors():
    random = np.random.default_rng(5)
    centres = random.normal(size=(12, 8))
    pairs = [(1000 - k, (centres[k % 12] + random.normal(scale=0.02 + 0.3 * (k % 7), size=8)).astype(np.float32).tolist()) for k in range(300)]
    pairs += [(k, pairs[0][1]) for k in range(2000, 2040)]  # one common vector
    pairs += [(5, None), (6, [0.0] * 8), (7, [1.0, None] + [0.0] * 6), (8, [NAN] * 8), (9, [INF] + [0.0] * 7), (10, []), (11, [1.0, 2.0]), (12, [1.0, 2.0] + [0.0] * 6)]
    pairs += [(None, pairs[1][1]), (None, [0.0] * 7 + [-3.0]), (13, pairs[2][1]), (13, pairs[2][1])]
    return pairs


@pytest.mark.parametrize("pivots, block", [(5, 50), (1, 4096)])
def test_range_join_matches_brute_force(make_vectors, vectors, pivots, block):
    found = metric_join.near_vectors(make_vectors(vectors), 0.9, pivots, block).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in found), key=str) == linked(vectors, 0.9)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in found)


def test_no_vectors(make_vectors):
    assert metric_join.near_vectors(make_vectors([])).collect() == []
    assert topk.top_products(make_vectors([])).collect() == []
    assert [tuple(r) for r in metric_join.near_vectors(make_vectors([(1, None)])).collect()] == [(1, 0, 1, True)]


def test_top_products_match_brute_force(make_vectors, vectors, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 60)
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "SEED", 40)
    scaled = [(k, None if v is None else [x if x is None else x * (1 + (i % 9) ** 3 / 20) for x in v]) for i, (k, v) in enumerate(vectors)]
    found = topk.top_products(make_vectors(scaled), 6, 20, 1024).collect()
    good = [(k, [math.floor(1024 * float(np.float32(x))) for x in v] + [0] * (8 - len(v))) for k, v in scaled if k is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    wanted = []
    for q, x in good:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), k) for k, y in good if k != q)[:6]
            wanted += [(q, rank + 1, k, -score) for rank, (score, k) in enumerate(best)]
    assert sorted(tuple(r) for r in found) == sorted(wanted)


def test_large_and_few_candidates(make_vectors):
    rows = [(0, [3.0e38, 1.0]), (1, [3.0e38, 1.0]), (2, [1.0, -1.0])]
    found = sorted(tuple(r) for r in topk.top_products(make_vectors(rows)).collect())
    whole = int(np.float32(3.0e38)) * 1024
    assert found == [(0, 1, 1, (1 << 63) - 1), (0, 2, 2, min((1 << 63) - 1, whole * 1024 - 1024 * 1024))]


@pytest.mark.parametrize("threshold", [-0.5, 0.3, 0.7, 0.95, 1.0])
def test_coordinates_never_lose_a_candidate(threshold):
    random = np.random.default_rng(3)
    unit = random.normal(size=(3000, 4))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    for query in [*unit[:20], np.array([1.0, 0, 0, 0])]:
        keep = topk._in_reach(query, unit, threshold)
        assert not (unit @ query >= threshold)[~keep].any()


def test_buckets_out_of_reach_are_not_dealt(spark, make_vectors, monkeypatch):
    """Neither queries nor candidates go where lengths rule a result out, and nothing is lost."""
    random, dealt = np.random.default_rng(8), {}
    rows = [(k, (random.normal(size=8) * (100 if k < 60 else 1.05 ** (k % 40) / 50)).tolist()) for k in range(1200)]
    for name in ("_asking", "_offered"):
        monkeypatch.setattr(topk, name, lambda *given, name=name, own=getattr(topk, name): dealt.setdefault(name, own(*given)))
    found = sorted(tuple(r) for r in topk.top_products(make_vectors(rows), 5, 20).collect())
    whole = {k: [math.floor(1024 * float(np.float32(x))) for x in v] for k, v in rows}
    wanted = []
    for q in range(0, 1200, 20):
        best = sorted((-sum(a * b for a, b in zip(whole[q], y)), k) for k, y in whole.items() if k != q)[:5]
        wanted += [(q, rank + 1, k, -score) for rank, (score, k) in enumerate(best)]
    assert found == sorted(wanted)
    lengths = {k: math.sqrt(sum(x * x for x in v)) for k, v in whole.items()}
    many = len({math.floor(math.log(length) / math.log(topk.RATIO)) for length in lengths.values()})
    # sixty long vectors hold all results: short candidates stay where they are, and queries skip their buckets
    assert 60 <= dealt["_offered"].count() < 200
    assert dealt["_asking"].count() < 60 * many / 2
