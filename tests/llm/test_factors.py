"""Removed passages against a table of all 50-byte strings."""

import hashlib
import random

import numpy as np
import pytest

from ledgerlark.llm import factors


def expected(pairs, length=50):
    """By a dictionary from every string of ``length`` bytes to the least doc_id that has it."""
    texts = [(doc, (text or "").encode()) for doc, text in pairs]
    least = {}
    for doc, text in texts:
        for i in range(len(text) - length + 1) if doc is not None else ():
            key = text[i : i + length]
            least[key] = min(doc, least.get(key, doc))
    found = []
    for doc, text in texts:
        gone = [False] * (len(text) + 1)
        for i in range(len(text) - length + 1) if doc is not None else ():
            if least[text[i : i + length]] < doc:
                gone[i : i + length] = [True] * length
        spans = sum(b and not a for a, b in zip([False, *gone], gone))
        kept = bytes(c for c, out in zip(text, gone) if not out)
        found.append((doc, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(found, key=str)


def actual(table):
    return sorted((tuple(r) for r in table.collect()), key=str)


def passages(seed, documents, words=40):
    """Documents out of shared and own passages, copies, edits and edges."""
    rng = random.Random(seed)
    own = lambda n: " ".join(f"w{rng.randrange(words * 9)}" for _ in range(n))
    shared = [own(rng.randrange(3, 60)) for _ in range(12)] + ["é" * 40, "a" * 300, "ab" * 90, "x" * 49, "y" * 50, "z" * 51]
    pairs = []
    for doc in range(documents):
        text = " ".join(rng.choice(shared) if rng.random() < 0.5 else own(rng.randrange(1, 30)) for _ in range(rng.randrange(0, 9)))
        if pairs and rng.random() < 0.3:
            text = pairs[rng.randrange(len(pairs))][1] or ""
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(["", "#", "new words"]) + text[at + rng.randrange(3) :]
        pairs.append((doc, text))
    return pairs


def strange():
    line = "a line that stands in many texts and is longer than fifty bytes, "
    return [(None, line * 2), (1, None), (2, ""), (3, line), (3, line), (3, "own words before " + line), (4, line[:49]), (5, line[:50]), (5, line[:50]), (6, "é" + line), (2, line), (-7, "b" * 120)] + [(9 + k, f"{k} {'b' * 70} {line}{k}") for k in range(40)]


@pytest.mark.parametrize("hot", [None, "all"])
def test_query_equals_table_of_strings(spark, make_docs, hot):
    pairs = passages(1, 300) + [(doc and doc + 1000, text) for doc, text in strange()]
    docs = make_docs(pairs).repartition(5)
    if hot:
        texts = [text.encode() for _, text in pairs if text]
        keys = [factors.stretches(np.frombuffer(text, dtype=np.uint8), [len(text)], 50)[0] for text in texts]
        hot = np.unique(np.concatenate(keys).view(np.int64)[::2]).tolist()
    assert actual(factors.without_repeats(docs, 50, hot)) == expected(pairs)


def test_strange_rows(spark, make_docs):
    pairs = strange()
    assert actual(factors.without_repeats(make_docs(pairs))) == expected(pairs)
    assert factors.without_repeats(make_docs([])).collect() == []
    assert factors.without_repeats(make_docs([(None, None)])).collect()[0].n_bytes == 0


def test_other_lengths(spark, make_docs):
    pairs = passages(2, 120)
    for length in (20, 128):
        assert actual(factors.without_repeats(make_docs(pairs), length)) == expected(pairs, length)


def test_pieces_of_long_texts(spark, make_docs):
    rng = random.Random(8)
    text = " ".join(f"w{rng.randrange(10**9)}" for _ in range(250_000))
    cut = factors.BLOCK - 20
    pairs = [(5, text), (6, "head " + text[cut - 40 : cut + 90]), (7, text[:30] + "#" + text[30:])]
    rows = {r.doc_id: r for r in factors.without_repeats(make_docs(pairs)).collect()}
    assert (rows[5].n_removed, rows[6].n_removed, rows[7].n_removed) == (0, 130, len(text) - 30)
    assert rows[7].kept_sha256 == hashlib.sha256((text[:30] + "#").encode()).hexdigest()


def test_longest_previous_factor():
    """Against a comparison of all pairs."""
    rng = random.Random(9)
    rows = np.array([[rng.choice(b"ab") for _ in range(11)] for _ in range(200)], dtype=np.uint8)
    docs = np.array([rng.randrange(30) for _ in rows])
    available = np.array([rng.randrange(1, 12) for _ in rows])

    def shared(i, j):
        n = min(available[i], available[j])
        differ = np.flatnonzero(rows[i, :n] != rows[j, :n])
        return int(differ[0]) if len(differ) else int(n)

    wanted = [max((shared(i, j) for j in range(200) if docs[j] < docs[i]), default=0) for i in range(200)]
    assert factors.longest_previous(rows, docs, available).tolist() == wanted
