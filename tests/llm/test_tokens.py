"""Token files, packing and counts against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from ledgerlark.llm import packing, token_counts, token_store
from ledgerlark.llm.tokens import Encoder
from ledgerlark.plans import lineage

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
LETTERS = "aA eE\n\t\r\x0b\x1c\x1d\x85\xa0 ​́ÀÉéßſΣσςİıǅKÅ'stvd0129²½ªº<|endoftext|>%$#&▁漢字ひカ😀🏽ẞ\xad\xb5"


def strange_texts(n):
    choose = random.Random(2)
    return ["".join(choose.choices(LETTERS, k=choose.randint(0, 50))) for _ in range(n)] + ["", "a<|ENDOFTEXT|>b", "<|startoftext|>", "can't 'S IT'LL"]


@pytest.fixture(scope="module")
def pairs():
    texts = strange_texts(60) + ["the cat sat " * 3000, "x" * 30_000]
    rows = [(7 * k % 1009, text) for k, text in enumerate(texts)]
    return rows + [(None, "no id"), (None, None), (4, "repeated"), (4, "repeated"), (2000, None)]


@pytest.fixture(scope="module")
def ids():
    tokenizer = Tokenizer.from_file(WORDS)
    return lambda text: np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_matches_library(name):
    path = public_tokenizers.path(name)
    own, library = Encoder(path), Tokenizer.from_file(path)
    for text in strange_texts(3000):
        assert own.ids(text) == np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(text)


def test_files_round_trip(spark, make_docs, pairs, ids, monkeypatch):
    monkeypatch.setattr(token_store, "FRAME_BYTES", 1 << 18)
    manifest = token_store.write_tokens(make_docs(pairs), lineage.scratch_path(spark, "files"), WORDS)
    found = token_store.read_tokens(manifest).collect()
    order = sorted(range(len(pairs)), key=lambda k: (pairs[k][0] is not None, pairs[k][0] or 0))
    wanted, start = [], 0
    for k in order:
        own = ids(pairs[k][1])
        wanted.append((pairs[k][0], start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    assert sorted(map(tuple, found), key=lambda r: r[1]) == wanted
    asked = spark.createDataFrame([(pairs[60][0],), (2000,), (99999,)], "doc_id long")
    some = {r.doc_id: r.ids for r in token_store.read_documents(manifest, asked).collect()}
    assert some == {pairs[60][0]: ids(pairs[60][1]).tolist(), 2000: [1]}


def test_frames_are_independent_and_checked(tmp_path):
    import io

    import zstandard

    out = token_store.TokenFile(str(tmp_path / "a.zst"))
    documents = [np.arange(k, k + size, dtype="<u4") for k, size in enumerate([3, 0, 200_000, 5])]
    for k, own in enumerate(documents):
        out.add(None if k == 1 else k, own.tobytes())
    out.close()
    data = (tmp_path / "a.zst").read_bytes()
    stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert stream == b"".join(own.tobytes() for own in documents)
    reader = token_store.TokenReader(str(tmp_path / "a.zst"))
    opened = []
    plain = reader.frame
    reader.frame = lambda k: opened.append(k) or plain(k)
    assert reader.document(3).tolist() == documents[3].tolist() and set(opened) == {len(reader.entries) - 2}
    broken = bytearray(data)
    broken[reader.places[1] + 40] ^= 1
    (tmp_path / "b.zst").write_bytes(broken)
    with pytest.raises(Exception):
        token_store.TokenReader(str(tmp_path / "b.zst")).document(2)


def test_pieces_hold_every_id_once(make_docs, pairs, ids):
    found = packing.pack_documents(make_docs(pairs).repartition(3), WORDS).collect()
    sequences, documents = {}, {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        documents.setdefault(r.doc_id, []).append(r)
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= 2048
    lengths = [sum(length for _, length in parts) for parts in sequences.values()]
    padded = sum(n if n & (n - 1) == 0 else 2048 for n in lengths)
    assert padded <= 1.01 * sum(lengths)
    for key, text in pairs:
        if sum(k == key for k, _ in pairs) == 1:
            own, at = ids(text), 0
            for r in sorted(documents[key], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(own)
                assert r.ids_crc32 == zlib.crc32(own[at : at + r.length].tobytes())
                at += r.length
            assert at == len(own)
    assert sum(lengths) == sum(len(ids(text)) for _, text in pairs)


def test_examples_keep_all_three_limits(spark):
    choose = random.Random(8)
    rows = [(k, choose.choice([0, 3, 40, 700, 5000]), choose.choice([0, 2, 30, 600, 9000])) for k in range(500)] + [(None, 10, 5), (1, 10, None), (2, None, 3), (3, -4, 2)]
    examples = spark.createDataFrame(rows, "example_id long, n_tokens long, n_loss long").repartition(2)
    found = packing.pack_examples(examples, max_tokens=1000, max_segments=6, max_loss=400).collect()
    sizes = {(k if 3 < (k or 0) else None): (n, min(loss, n)) for k, n, loss in rows if k and k > 3}
    sequences, placed = {}, {}
    for r in found:
        n, loss = sizes.get(r.example_id, (0, 0))
        own = max(0, min(n, r.start + r.length) - max(n - loss, r.start)) if n else 0
        total = sequences.setdefault(r.sequence_id, [0, 0, 0])
        total[0], total[1], total[2] = total[0] + r.length, total[1] + 1, total[2] + own
        placed[r.example_id] = placed.get(r.example_id, 0) + r.length
    assert all(a <= 1000 and b <= 6 and c <= 400 for a, b, c in sequences.values())
    assert all(placed.get(k, 0) == n for k, (n, _) in sizes.items())


def test_counts_match_library(make_docs, pairs):
    vocabulary = token_counts.unigram_vocabulary(PIECES)
    for fallback in (True, False):
        library = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=fallback))
        library.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
        own = token_counts.Counter(vocabulary, fallback)
        for text in [*strange_texts(1500), "x" * 5000, "é漢" * 900]:
            assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)
    counted = token_counts.token_counts(make_docs(pairs), PIECES).collect()
    counter = token_counts.counter(PIECES)
    assert sorted(map(tuple, counted), key=str) == sorted(((k, len(t or ""), counter.count(t or "")) for k, t in pairs), key=str)


def test_ties_go_to_the_earlier_start():
    vocabulary = [("<unk>", -20.0), ("▁", -1.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("▁a", -3.0), ("ba", -4.0)]
    library = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=False))
    library.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    own = token_counts.Counter(vocabulary, byte_fallback=False)
    for k in range(600):
        text = "".join(random.Random(k).choices("ab c?", k=9))
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_no_documents(spark, make_docs):
    none = make_docs([])
    manifest = token_store.write_tokens(none, lineage.scratch_path(spark, "files"), WORDS)
    assert token_store.read_tokens(manifest).collect() == []
    assert packing.pack_documents(none, WORDS).collect() == []
    assert token_counts.token_counts(none, PIECES).collect() == []
