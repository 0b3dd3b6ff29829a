"""Toxicity and mixing on labelled documents, and their edge cases."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from ledgerlark.llm import mixing, terms, toxicity
from ledgerlark.llm.tokens import Encoder


@pytest.fixture(scope="module")
def labelled():
    """Insults alone are mild, with a group's name they are toxic; junk is low in quality."""
    choose, pairs, labels = random.Random(6), [], []
    vocabulary = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in ("lt", "nd", "rs", "mp")]
    for k in range(900):
        words = choose.choices(vocabulary, k=choose.randint(5, 60))
        kind = k % 6
        words += {0: ["grouch", "martians"], 1: ["grouch"], 2: ["martians"]}.get(kind, [])
        choose.shuffle(words)
        text = " ".join(words) if kind != 5 else " ".join(word + "%$%$" for word in words)
        pairs.append((k, text))
        labels.append((k, int(kind != 5), int(kind == 0)))
    return pairs, labels


def frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def auc(scores, truth):
    """The part of pairs in the right order, equal scores counting half."""
    toxic, clean = scores[truth == 1][:, None], scores[truth == 0][None, :]
    return ((toxic > clean) + 0.5 * (toxic == clean)).mean()


def test_pairs_of_terms_are_learnt(spark, make_docs, labelled):
    pairs, labels = labelled
    edge = [(2000, None), (2001, ""), (None, "grouch martians"), (2002, "grouch martians " * 50_000), (5, pairs[5][1])]
    found = toxicity.toxicity(make_docs(pairs + edge), frame(spark, labels)).collect()
    assert len(found) == len(pairs) + len(edge)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    by_id = {r.doc_id: r for r in found}
    held = [(by_id[k].score, toxic) for k, _, toxic in labels if by_id[k].held_out]
    assert auc(np.array([s for s, _ in held]), np.array([t for _, t in held])) > 0.97
    assert by_id[2000].score == by_id[2001].score < 0.5
    assert by_id[None].predicted == by_id[2002].predicted == 1


def test_scores_and_posteriors_do_not_depend_on_neighbours(spark, make_docs, labelled):
    """Equal rows for three ways of dealing them out, to the last bit."""
    pairs, labels = labelled
    docs = make_docs(pairs + [(8000 + k, text) for k, text in pairs[:40]])
    model, domains = toxicity.fit(docs, frame(spark, labels)), mixing.fit_domains(docs, mixing.domain_of_labels(frame(spark, labels)))
    dealt = [docs, docs.repartition(7), docs.orderBy("text").coalesce(1)]
    scores = [{r.doc_id: r.score for r in toxicity.score(rows, model).collect()} for rows in dealt]
    parts = [{r.doc_id: tuple(r) for r in mixing.posteriors(rows, domains).collect()} for rows in dealt]
    assert scores[0] == scores[1] == scores[2] and parts[0] == parts[1] == parts[2]
    assert all(scores[0][8000 + k] == scores[0][k] and parts[0][8000 + k][1:] == parts[0][k][1:] for k in range(40))


def test_held_out_labels_are_not_learnt(spark, make_docs, labelled):
    pairs, labels = labelled
    turned = [(k, q, 1 - t if zlib.crc32(str(k).encode()) % 3 == 1 else t) for k, q, t in labels]
    own = [sorted((r.doc_id, r.score) for r in toxicity.toxicity(make_docs(pairs[:300]), frame(spark, x)).collect()) for x in (labels, turned)]
    assert own[0] == own[1]


def test_without_labels(spark, make_docs):
    docs = make_docs([(1, "a text"), (2, None), (7, "more")])
    assert all(r.score < 0.01 for r in toxicity.toxicity(docs, frame(spark, [])).collect())
    assert all(r.score > 0.99 for r in toxicity.toxicity(docs, frame(spark, [(7, 1, 1), (1, None, None), (None, 1, 1)])).collect())
    assert toxicity.toxicity(make_docs([]), frame(spark, [(2, 1, 1)])).collect() == []


def test_filter_keeps_all_columns(spark, make_docs, labelled):
    pairs, labels = labelled
    docs = make_docs(pairs[:60] + [(None, None)])
    model = toxicity.fit(make_docs(pairs), frame(spark, labels))
    kept = toxicity.keep_below(docs, model)
    assert kept.schema == docs.schema
    wanted = {r.doc_id for r in toxicity.score(docs, model).filter("predicted = 0").collect()}
    assert {r.doc_id for r in kept.collect()} == wanted and None in wanted


def totals(rows):
    n = sum(r.n_tokens for r in rows)
    return [sum(r.n_tokens * r.rate * r[f"p_{name}"] for r in rows) / n for name in mixing.DOMAINS]


def test_rates_meet_the_targets(spark, make_docs, labelled):
    pairs, labels = labelled
    rows = mixing.mixing(make_docs(pairs + [(None, "x y"), (3000, None)]), frame(spark, labels), {"low": 0.3, "clean": 0.6, "toxic": 0.1}).collect()
    assert len(rows) == len(pairs) + 2
    assert totals(rows) == pytest.approx([0.3, 0.6, 0.1], abs=0.01)
    assert all(r.rate >= 0 and abs(sum(r[f"p_{name}"] for name in mixing.DOMAINS) - 1) < 1e-9 and r.copies in (int(r.rate), int(r.rate) + 1) for r in rows)
    right = [max(range(3), key=lambda d: r[f"p_{mixing.DOMAINS[d]}"]) == (2 if r.doc_id % 6 == 0 else 0 if r.doc_id % 6 == 5 else 1) for r in rows if r.doc_id is not None and r.doc_id < 900]
    assert sum(right) > 0.9 * len(right)
    solved = descent(rows, [0.3, 0.6, 0.1])
    assert totals(rows) == pytest.approx(solved, abs=5e-3)


def descent(rows, wanted):
    """The same problem by many plain projected steps over all documents."""
    p = np.array([[r[f"p_{name}"] for name in mixing.DOMAINS] for r in rows])
    a = np.array([r.n_tokens for r in rows]) / sum(r.n_tokens for r in rows)
    rate, wanted = np.ones(len(rows)), np.array(wanted)
    for _ in range(4000):
        rate = np.maximum(0, rate - 0.05 * (p @ (((a * rate) @ p - wanted) / wanted) + mixing.NEAR_ONE * (rate - 1)))
    return (a * rate) @ p


def test_floor_and_growth(spark, make_docs, labelled):
    pairs, labels = labelled
    docs = make_docs(pairs)
    rows = mixing.mixing(docs, frame(spark, labels), {"low": 0.01, "clean": 0.99}, floor=1.0, most_growth=1.5).collect()
    assert all(r.rate >= 1 and r.copies >= 1 for r in rows)
    again = mixing.mixed(docs, frame(spark, labels), {"low": 0.01, "clean": 0.99}, floor=1.0, most_growth=1.5)
    assert again.columns == docs.columns
    assert {r.doc_id: r["count"] for r in again.groupBy("doc_id").count().collect()} == {r.doc_id: r.copies for r in rows}


def test_mixing_without_labels_or_documents(spark, make_docs):
    rows = mixing.mixing(make_docs([(1, "a b c"), (2, "d")]), frame(spark, []), {"clean": 1.0}).collect()
    assert len({r.rate for r in rows}) == 1
    assert mixing.mixing(make_docs([]), frame(spark, []), {"clean": 1.0}).collect() == []
    assert mixing.mixing(make_docs([(1, None)]), frame(spark, [(1, 0, 0)]), {"clean": 1.0}).count() == 1
    with pytest.raises(ValueError):
        mixing.mixing(make_docs([(1, "a")]), frame(spark, []), {})


def test_terms():
    words = terms.Terms()
    assert words.of("") == set() and words.of("%% 12") == set()
    assert words.of("Wort wort, WORT") == words.of("wort")
    assert words.of("inflected") & words.of("inflecting")


def test_over_represented_domains_shrink(spark, make_docs, labelled):
    pairs, labels = labelled
    hot = [(5000 + k, " ".join(word + "%$%$" for word in text.split())) for k, text in pairs[:360] if k % 6 in (3, 4)] + [(k, t) for k, t in pairs if k % 6 != 0]
    docs, targets = make_docs(hot), {"low": 0.05, "clean": 0.95}
    rows = mixing.mixing(docs, frame(spark, labels), targets, {"clean": 1.0}).collect()
    reached = np.array(totals(rows)) / sum(totals(rows))
    assert sum(r.n_tokens * r.p_low for r in rows) / sum(r.n_tokens for r in rows) > 0.3
    assert reached[0] == pytest.approx(0.05, abs=0.01)
    assert all(r.rate >= 1 for r in rows if r.p_clean > 0.5)


def test_tokens_are_those_of_the_vocabulary_and_posteriors_unrounded(spark, make_docs, labelled):
    import public_tokenizers
    from tokenizers import Tokenizer

    pairs, labels = labelled
    texts = ["x" * 400, "你好世界" * 50, "Two\nWords!", "", None, "A  b\tc <|endoftext|> é"]
    rows = {r.doc_id: r for r in mixing.mixing(make_docs(pairs + [(7000 + k, t) for k, t in enumerate(texts)]), frame(spark, labels), {"low": 0.3, "clean": 0.6, "toxic": 0.1}).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for k, text in [*enumerate(texts, 7000), *pairs[:20]]:
        assert rows[k].n_tokens == len(library.encode(text or "", add_special_tokens=False).ids)
    assert any(0 < r.p_toxic < 1 / 512 for r in rows.values())


def test_a_small_table_of_words_changes_nothing(monkeypatch):
    """Counts and terms are the same whatever words a worker's table still holds."""
    numbers = np.random.default_rng(5)
    texts = [" ".join(f"Wort{numbers.zipf(1.3) % 900}x{k % 3}," for k in range(40)) for _ in range(600)] + ["", "é ß" * 5]
    path, buckets = public_tokenizers.path(mixing.VOCABULARY), sorted({terms._hashed(f"wort{k}") for k in range(50)} | {terms._hashed("wort-")})

    def judged():
        words, found = mixing.Words(path, buckets), []
        for at in range(0, len(texts), 20):
            counts, (flat, starts) = words.of(texts[at : at + 20])
            found.append((counts.tolist(), flat.tolist(), starts.tolist()))
        return found, len(words.index)

    whole, most = judged()
    assert [n for counts, *_ in whole for n in counts] == [len(Encoder(path).ids(text)) // 4 for text in texts]
    for words, chars in ((most // 4, 10**6), (most, 2000)):
        monkeypatch.setattr(mixing, "TABLE_WORDS", words)
        monkeypatch.setattr(mixing, "TABLE_CHARS", chars)
        small, held = judged()
        assert small == whole and held < most
