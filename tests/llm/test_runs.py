"""Runs against a search over all starts and periods."""

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlark.llm import runs


def plain(words):
    """All maximal runs by trying every period."""
    n, found = len(words), {}
    for period in range(1, n // 4 + 1):
        at = 0
        while at < n - period:
            end = at
            while end < n - period and words[end] == words[end + period]:
                end += 1
            length = end - at + period
            if end > at and length >= max(6, 4 * period):
                found.setdefault((at, length), period)
            at = end + 1
    return sorted((start, length, period) for (start, length), period in found.items())


def found(words):
    return runs.periodic_runs(np.array(words, dtype=np.int64))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_small_alphabets(words):
    assert found(words) == plain(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 5), min_size=1, max_size=12), st.integers(1, 9)), max_size=8))
def test_powers_side_by_side(blocks):
    words = [word for block, times in blocks for word in block * times]
    assert found(words) == plain(words)


def test_nested_and_long_periods():
    rng = random.Random(3)
    for period in (1, 2, 3, 5, 8, 31, 32, 33, 100):
        unit = [rng.randrange(4) for _ in range(period)]
        inner = unit + [0] * 9 + [1, 2] * 7
        words = [9, 8] + inner * 5 + inner[: period // 2] + [7] * 11 + inner * 4
        assert found(words) == plain(words)
    fibonacci, before = [0, 1], [0]
    while len(fibonacci) < 800:
        fibonacci, before = fibonacci + before, fibonacci
    assert found(fibonacci) == plain(fibonacci)
    assert found([1] * 5000) == [(0, 5000, 1)]


def expected(doc_id, text):
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text or "").split(" ") if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    spans = plain(words)
    dropped = {i for start, length, period in spans for i in range(start + period, start + length)}
    best = min(spans, key=lambda r: (-r[1], r[0], r[2]), default=None)
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in spans)
    rest = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(spans), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(rest.encode()).hexdigest())


def test_query_equals_plain_search(spark, make_docs):
    rng = random.Random(4)
    pairs = [(None, "a b " * 9), (1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, "a " * 5), (5, "a " * 6), (5, "a " * 6), (6, "é b c\x0bd " * 8)]
    for k in range(7, 400):
        n = rng.randrange(0, 120)
        pairs.append((k, " ".join(f"w{rng.randrange(rng.choice([2, 3, 50]))}" for _ in range(n))))
    rows = sorted((tuple(r) for r in runs.run_table(make_docs(pairs)).collect()), key=str)
    assert rows == sorted((expected(*pair) for pair in pairs), key=str)
    assert any(r[1] > 1 for r in rows)
    assert runs.run_table(make_docs([])).collect() == []


def test_very_long_text(spark, make_docs):
    text = " ".join(["start"] + [f"w{k % 70_001}" for k in range(300_000)])
    (row,) = runs.run_table(make_docs([(21, text)])).collect()
    assert (row.n_runs, row.start, row.length, row.period) == (1, 1, 300_000, 70_001)
