"""The pipeline stage by stage, and over strange rows."""

import hashlib
import random

import corpus_pipeline
from ledgerlark.llm import minhash, mixing, toxicity
from ledgerlark.llm.common import table
from ledgerlark.plans import lineage
from tests.llm.test_minhash import grouped

SF_DIR = "/root/testdata/sf0.001"


def test_stages_follow_their_operators(spark):
    docs = table(spark, SF_DIR, "documents")
    labels = table(spark, SF_DIR, "labels")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "mixing", "packing"]

    clean = lineage.cut(stages["toxicity"](spark, docs, SF_DIR))
    wanted = toxicity.toxicity(docs, labels).filter("predicted = 0")
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in wanted.collect()}

    single = lineage.cut(stages["near_duplicates"](spark, clean, SF_DIR))
    pairs = [(r.doc_id, r.text) for r in clean.collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted(k for k, _, least in grouped(pairs, 5) if k == least)
    assert single.schema == clean.schema

    mixed = lineage.cut(stages["mixing"](spark, single, SF_DIR))
    copies = mixing.mixing(single, labels, corpus_pipeline.TARGETS, corpus_pipeline.LEAST_RATE, most_growth=corpus_pipeline.MOST_GROWTH)
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {r.doc_id: r.copies for r in copies.collect()}
    assert mixed.columns == single.columns == clean.columns == docs.columns

    packed = stages["packing"](spark, mixed, SF_DIR).collect()
    tokens = {}
    for r in packed:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    times = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert tokens == {r.doc_id: r.doc_tokens * times[r.doc_id] for r in packed}


def plain_survivors(pairs):
    """One row of each group by comparing all pairs; rows without words or id all stay."""
    sets = []
    for _, text in pairs:
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    group = list(range(len(pairs)))
    for i in range(len(pairs)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    kept, best = [], {}
    for k, (doc_id, text) in enumerate(pairs):
        if doc_id is None or not sets[k]:
            kept.append((doc_id, text))
        else:
            row = (doc_id, hashlib.md5(text.encode()).digest(), text)
            best[group[k]] = min(best.get(group[k], row), row)
    return sorted(kept + [(doc_id, text) for doc_id, _, text in best.values()], key=str)


def test_repeated_ids_and_differing_texts(spark, make_docs):
    """Near-duplicates go by row, not by doc_id."""
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(60)) for _ in range(14)]
    pairs = [(1, texts[0]), (5, texts[0] + " tail"), (5, texts[1]), (5, texts[2]), (7, ""), (7, ""), (7, " \n"), (8, None), (None, texts[0]), (9, texts[3]), (9, texts[3]), (None, texts[4]), (11, texts[4])]
    for k in range(60):
        text = rng.choice(texts)
        pairs.append((rng.randrange(12, 30), text if rng.random() < 0.4 else text + f" more {rng.randrange(3)}" if rng.random() < 0.6 else text[:150]))
    found = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, make_docs(pairs), SF_DIR).collect()
    assert sorted(((r.doc_id, r.text) for r in found), key=str) == plain_survivors(pairs)


def test_strange_rows_pass(spark, make_docs):
    pairs = [(None, "no id at all here"), (None, None), (1, None), (2, ""), (3, "one two three four five six"), (3, "one two three four five six"), (4, "one two three four five six")]
    docs = make_docs(pairs)
    for name, stage in corpus_pipeline.STAGES[:3]:
        columns = docs.columns
        docs = lineage.cut(stage(spark, docs, SF_DIR), name)
        assert docs.columns == columns
    found = {r.doc_id for r in docs.collect()}
    assert found == {None, 1, 2, 3}
    empty = make_docs([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF_DIR).collect() == []
