"""Token counts of a unigram tokenizer without making the tokens.

An Aho-Corasick automaton over the vocabulary finds every piece that ends at a
character; dynamic programming carries, for each end, the best score and the number
of pieces that reach it. Ties follow the tokenizers library: of equal scores the
earlier start wins, a character without a piece of its own is unknown at the lowest
score less 10, and sums are taken from left to right. Words are counted once and
looked up afterwards.
"""

import functools

import ahocorasick
from pyspark.sql import functions as F

from ledgerlark.llm.common import arrow_schema, batch_of_rows, lists
from ledgerlark.llm.tokens import CACHE_WORDS, Cache, release

#: Fixed values of the library: the mark of a blank and the penalty of an unknown character.
MARK, UNKNOWN_PENALTY = "▁", 10.0


def unigram_vocabulary(model_file):
    """(piece, score) in id order from a vocabulary file of the sentencepiece library."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(pieces.id_to_piece(k), pieces.get_score(k)) for k in range(pieces.vocab_size())]


class Counter:
    """count(text): the tokens of a text, words set off by blanks, a blank before the first.

    ``byte_fallback``: an unknown character counts its bytes; otherwise a run of them
    counts one. Scores must not be positive."""

    def __init__(self, vocabulary, byte_fallback=True):
        self.automaton, self.single = ahocorasick.Automaton(), set()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
            if len(piece) == 1:
                self.single.add(piece)
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.longest = max(len(piece) for piece, _ in vocabulary)
        self.byte_fallback = byte_fallback
        self.words = Cache(self._word, CACHE_WORDS, 48)

    def count(self, text):
        if not text:
            return 0
        text = text.replace(MARK, " ")
        words = (text[1:] if text[0] == " " else text).split(" ")
        return sum(map(self.words.__getitem__, words))

    def _word(self, word):
        return self.pieces(MARK + word)

    def pieces(self, text):
        """The best path's number of pieces, over a window of ends as long as the longest piece."""
        size = self.longest + 1
        score, number, run = [0.0] * size, [0] * size, [False] * size
        found = self.automaton.iter(text)
        end, value = next(found, (len(text), None))
        for at, letter in enumerate(text):
            best = None
            while end == at:
                length, own = value
                start = (at + 1 - length) % size
                total = own + score[start]
                if best is None or total > best:
                    best, count, unknown = total, number[start] + 1, False
                end, value = next(found, (len(text), None))
            if letter not in self.single:
                start = at % size
                total = self.unknown + score[start]
                if best is None or total > best:
                    extra = len(letter.encode("utf-8", "surrogatepass")) if self.byte_fallback else int(not run[start])
                    best, count, unknown = total, number[start] + extra, True
            place = (at + 1) % size
            score[place], number[place], run[place] = best, count, unknown
        return number[len(text) % size]


@functools.lru_cache(maxsize=2)
def counter(model_file, byte_fallback=True):
    return Counter(unigram_vocabulary(model_file), byte_fallback)


def token_counts(docs, model_file, byte_fallback=True):
    """doc_id, n_chars, n_tokens for every row of ``docs`` (doc_id, text).

    A null text counts as empty: no tokens. Null and repeated ids are kept; an empty
    table gives no rows. Other columns are not read."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = "doc_id long, n_chars long, n_tokens long"

    def count(batches):
        release()
        tokens = counter(model_file, byte_fallback).count
        for records in batches:
            yield batch_of_rows(arrow_schema(out), [(doc_id, len(text), tokens(text)) for doc_id, text in zip(*lists(records, "doc_id", "text"))])

    return rows.mapInArrow(count, out)
