"""Hashed terms of texts and the ones that tell classes apart.

Terms are a text's words, runs of letters in lower case, and their beginnings of
4 to 6 letters, which inflected and compounded forms share; a text holds a term
or not, however long it is. Shape terms describe the whole text in coarse steps.
A model is fitted on a bounded sample of labelled rows; its terms are those with
the highest chi-square over the classes in that sample.
"""

import math
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from ledgerlark.llm.common import arrow_schema, batch_of_rows, lists, pieces
from ledgerlark.llm.tokens import CACHE_PIECES, CACHE_WORDS, Cache, release
from ledgerlark.plans import lineage

#: Hash buckets, terms kept for a model, labelled rows fitted on.
BUCKETS, TERMS, LABELLED = 1 << 18, 2048, 20_000
#: Documents and chi-square that a kept term needs, so that chance finds few in a small sample.
LEAST_DOCS, LEAST_CHI = 4, 12.0
_WORD = re.compile(r"[^\W\d_]+")
#: Bytes that may belong to a letter; others end a word.
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
_LETTERS_AND_LINES = _LETTERS[:10] + b"\n" + _LETTERS[11:]
_BEGINNINGS = (4, 5, 6)


def _hashed(term):
    return xxhash.xxh3_64_intdigest(term) % BUCKETS


def letters(text):
    """The text in small letters as bytes, blank where no letter can be."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS)


def _beginnings(stem):
    """The buckets of the beginnings of a word's first letters."""
    return tuple(_hashed(f"{stem[:n]}-") for n in _BEGINNINGS if len(stem) >= n)


def shape_terms(text, letters):
    """Length, share of signs and digits, length of words and repetition of lines, in steps.
    ``letters`` is the text as bytes with blanks for what is no letter."""
    parts, lines = len(text.split()), text.split("\n")
    plain, size = len(letters) - letters.count(b" "), len(letters)
    shapes = (
        ("words", int(math.log2(parts + 1))),
        ("signs", round(10 * (1 - (plain + text.count(" ")) / max(1, size)))),
        ("letters", min(20, round(plain / max(1, parts)))),
        ("lines", round(5 * len(set(lines)) / len(lines))),
    )
    return tuple(_hashed(f"{name} {step}") for name, step in shapes)


class Terms:
    """of(text): the places among ``chosen`` buckets (or the buckets) of a text's terms."""

    def __init__(self, chosen=None, shapes=False):
        release()
        self.known = int if chosen is None else {bucket: k for k, bucket in enumerate(chosen)}.get
        self.shapes = shapes
        self.words, self.parts = Cache(self._places, CACHE_WORDS, 48), {}
        self.stems = Cache(lambda stem: self._known(_beginnings(stem)), CACHE_PIECES, 48)

    def _known(self, buckets):
        return tuple(place for place in map(self.known, buckets) if place is not None)

    def _places(self, raw):
        """Words share their beginnings, so a new word costs one hash mostly."""
        found = ()
        for word in (raw.decode(),) if raw.isascii() else _WORD.findall(raw.decode("utf-8", "replace")):
            own = self.known(_hashed(word))
            if own is not None:
                found += (own,)
            if len(word) >= _BEGINNINGS[0]:
                found += self.stems[word[: _BEGINNINGS[-1]]]
        return found

    def places_of(self, words):
        """Places of the terms of each of ``words``, which hold no line feeds; some more than once."""
        found, parts = [], self.parts
        for raw in "\n".join(words).lower().encode("utf-8", "surrogatepass").translate(_LETTERS_AND_LINES).split(b"\n"):
            of_word = ()
            for part in raw.split():
                places = parts.get(part)
                if places is None:
                    places = self._places(part)
                    if len(part) <= 48:
                        parts[part] = places
                of_word += places
            found.append(of_word)
        return found

    def shape_of(self, text):
        return self._known(shape_terms(text, letters(text)))

    def of(self, text):
        found = set()
        plain = letters(text)
        for places in map(self.words.__getitem__, set(plain.split())):
            if places:
                found.update(places)
        if self.shapes:
            found.update(self._known(shape_terms(text, plain)))
        return found


def labelled_terms(docs, labels, shapes=False, most=LABELLED):
    """Terms of a sample of at most ``most`` labelled rows in hash order: doc_id, label,
    terms. ``labels`` (doc_id, label) has one row a document; the sample's ids and labels
    are what a task gets, so ``most`` bounds them."""
    sample = labels.filter("doc_id is not null and label is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    out = "doc_id long, label int, terms array<long>"

    def extract(batches):
        terms = Terms(shapes=shapes)
        for records in pieces(batches):
            found = [(doc_id, label, sorted(terms.of(text))) for doc_id, label, text in zip(*lists(records, "doc_id", "label", "text"))]
            yield batch_of_rows(arrow_schema(out), found)

    return lineage.cut(rows.select("doc_id", F.col("label").cast("int").alias("label"), "text").mapInArrow(extract, out), "labelled-terms")


def choose(sample, classes, most=TERMS):
    """The buckets with the highest chi-square over ``classes``, and the sample as rows
    of places among them and labels: (buckets, [(places, label)])."""
    sizes = {row["label"]: row["count"] for row in sample.groupBy("label").count().collect()}
    total = sum(sizes.values())
    if len(sizes) < 2:
        return [], [], sizes
    held = sample.select("label", F.explode("terms").alias("bucket")).groupBy("bucket").pivot("label", classes).count().na.fill(0)
    seen = sum((F.col(str(c)) for c in classes), F.lit(0))
    chi = F.lit(0.0)
    for c in classes:
        if sizes.get(c):
            expected = seen * (sizes[c] / total)
            chi = chi + F.pow(F.col(str(c)) - expected, 2) / expected
    scored = held.filter(seen >= LEAST_DOCS).select("bucket", (chi / (1 - seen / (total + 1.0))).alias("chi"))
    top = scored.filter(F.col("chi") >= LEAST_CHI).orderBy(F.desc("chi"), "bucket").limit(most)
    buckets = [row["bucket"] for row in top.collect()]
    place = {bucket: k for k, bucket in enumerate(buckets)}
    out = "label int, places array<long>"

    def narrow(batches):
        for records in batches:
            found = [(label, [place[b] for b in terms if b in place]) for label, terms in zip(*lists(records, "label", "terms"))]
            yield batch_of_rows(arrow_schema(out), found)

    rows = sample.orderBy("doc_id").select("label", "terms").mapInArrow(narrow, out).collect()
    return buckets, [(row["places"], row["label"]) for row in rows], sizes


def joined(rows):
    """Places of many rows one after another, and where each row starts."""
    starts = np.concatenate([[0], np.cumsum([len(places) for places in rows])]).astype(np.int64)
    flat = np.array([p for places in rows for p in places], dtype=np.int64)
    return flat, starts


def row_sums(values, starts):
    """Sums over each row's slice, 0 for an empty row. A row's sum depends on its own values
    only, so equal texts score alike whatever rows stand beside them."""
    found = np.zeros((len(starts) - 1,) + values.shape[1:])
    some = np.flatnonzero(starts[1:] > starts[:-1])
    if len(some):
        found[some] = np.add.reduceat(values, starts[some], axis=0)
    return found
