"""Near-duplicates against brute force, and their edge cases."""

import random

import numpy as np
import pytest

from ledgerlark.llm import minhash
from ledgerlark.llm.components import components


def shingles(text, width):
    words = (text or "").encode().lower().split()
    return frozenset(zip(*[words[k:] for k in range(width)])) if len(words) >= width else frozenset([tuple(words)] if words else [])


def grouped(pairs, width):
    sets = [shingles(text, width) for _, text in pairs]
    root = list(range(len(pairs)))
    for i in range(len(pairs)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    least = {}
    for k, r in enumerate(root):
        if pairs[k][0] is not None:
            least[r] = min(least.get(r, pairs[k][0]), pairs[k][0])
    return sorted(((pairs[k][0], len(sets[k]), least.get(root[k]) if sets[k] else pairs[k][0]) for k in range(len(pairs))), key=str)


@pytest.fixture(scope="module")
def texts():
    choose = random.Random(4)
    vocabulary = [f"w{k}é" for k in range(400)]
    base = [" ".join(choose.choices(vocabulary, k=choose.choice([3, 8, 40, 200]))) for _ in range(40)]
    pairs = []
    for k in range(260):
        words = base[k % 40].split()
        for _ in range(choose.choice([0, 0, 1, 2, len(words) // 12])):
            words[choose.randrange(len(words))] = choose.choice(vocabulary)
        pairs.append((k + 1, choose.choice([" ", "\n", "\t \x0b"]).join(words).replace("w1", choose.choice(["w1", "W1"]))))
    pairs += [(900, ""), (901, None), (902, " \n"), (903, ""), (904, "word"), (905, "WORD"), (906, "two words"), (None, "two words"), (None, "alone here now")]
    pairs += [(3, base[0]), (3, base[0]), (950, "a b " * 30_000)]
    return pairs


@pytest.mark.parametrize("width", [2, 5])
def test_groups_match_brute_force(make_docs, texts, width):
    found = minhash.near_duplicates(make_docs(texts), width).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == grouped(texts, width)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in found)


def test_what_pivots_leave_is_compared_in_blocks(make_docs, monkeypatch):
    """Bands of one minimum put unlike texts into common buckets."""
    choose = random.Random(9)
    pairs = [(k, " ".join(["start of all"] + choose.choices([f"v{n}" for n in range(60)], k=30))) for k in range(60)]
    pairs += [(100 + k, pairs[k][1] + " end") for k in range(0, 60, 5)]
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "TEXT_BLOCK", 5)
    monkeypatch.setattr(minhash, "ROWS", 1)
    monkeypatch.setattr(minhash, "BANDS", 240)
    found = minhash.near_duplicates(make_docs(pairs), 2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(grouped(pairs, 2))


def test_no_documents(make_docs):
    assert minhash.near_duplicates(make_docs([])).collect() == []
    assert len(minhash.near_duplicates(make_docs([(1, None)])).collect()) == 1


def test_estimate_and_bits():
    random_sets = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        common = random_sets.integers(0, 1 << 63, 4000, dtype=np.uint64)
        own = random_sets.integers(0, 1 << 63, (2, int(4000 * (1 / share - 1) / 2)), dtype=np.uint64)
        left, right = (minhash.minima(np.unique(np.concatenate([common, own[k]]))) for k in (0, 1))
        x = (minhash.packed_bits(left) ^ minhash.packed_bits(right)).view(np.uint64)
        agree = sum(((x >> np.uint64(4 * k)) & np.uint64(15) == 0).sum() for k in range(16))
        estimate = (agree / 240 - 1 / 16) / (15 / 16)
        assert abs(estimate - share) < 0.15
        assert (agree >= minhash.least_agreeing(80)) == (share >= 0.8)


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 50), (70, 100), (5, 5), (None, 3)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(41)}, 50: 50, 70: 50, 100: 50}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
