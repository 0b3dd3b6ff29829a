"""Token ids of whole texts, encoded word by word with a cache.

The vocabulary in use lower-cases, drops white space and never merges across
it, so the ids of a text are the ids of its blank-separated words in order.
Words repeat, so nearly every word is one dictionary lookup. Tokenizers whose
pre-tokenizer isn't of that kind encode each text in one call.
"""

import functools
import json

import numpy as np
import regex
from tokenizers import Tokenizer

#: Entries of a worker's caches of words and of their parts before the older half goes.
CACHE_WORDS, CACHE_PIECES = 250_000, 120_000
#: Longer words are encoded anew each time.
CACHE_CHARS = 48

#: Fixed value: the pre-tokenizer pattern of the word-level vocabulary.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Cache(dict):
    """Computes missing values; when full, keeps those of the last generation only."""

    def __init__(self, compute, limit, longest):
        super().__init__()
        self.compute, self.limit, self.longest, self.older = compute, limit, longest, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


#: The same over texts of Latin-1, with the white space that the library means.
_LATIN_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r\x20\x85\xA0\p{L}\p{N}]+")
#: Characters that no normal form changes and whose small letters stand alone.
_PLAIN = regex.compile(r"[\x00-\xFF]*+")


def _byte_letters():
    """The public byte-level alphabet: visible Latin-1 bytes are themselves, the others
    follow from 256 on in order."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)}


class Encoder:
    """ids(text): the text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path):
        self.tokenizer, self.by_word, self.special = _loaded(path)
        self.letters = _byte_letters()
        self.words = Cache(self._word, CACHE_WORDS, CACHE_CHARS)
        self.small = Cache(self._small_word, CACHE_WORDS, CACHE_CHARS)
        self.pieces = Cache(self._piece, CACHE_PIECES, CACHE_CHARS)

    def ids(self, text):
        if not self.by_word:
            return self._plain(text)
        # other white space stays inside a word, where the library treats it
        words = self.words
        if _PLAIN.fullmatch(text):
            small = text.lower()
            if not any(token in small for token in self.special):
                text, words = small, self.small
        return b"".join(map(words.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))

    def forget_counts(self):
        self.part_counts = {}

    def counts_of(self, words):
        """The number of ids of each of ``words``, which hold no ASCII white space, from the
        numbers of their parts; ``forget_counts`` comes first."""
        known, found, tokenize = self.part_counts, [], self.tokenizer.model.tokenize
        held = "\n".join(words)
        special = [token for token in self.special if token in held]
        for word in words:
            if not (word.isascii() or _PLAIN.fullmatch(word)) or special and any(token in word for token in special):
                found.append(len(self._word(word)) // 4)
                continue
            small, total = word.lower(), 0
            for part in (small,) if small.isalpha() else _LATIN_PATTERN.findall(small):
                count = known.get(part)
                if count is None:
                    count = len(tokenize(self._spelling(part)))
                    if len(part) <= CACHE_CHARS:
                        known[part] = count
                total += count
            found.append(total)
        return found

    def _plain(self, text):
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word):
        if not word:
            return b""
        if any(token in word for token in self.special):
            return self._plain(word)
        clean = self.tokenizer.normalizer.normalize_str(word)
        return b"".join([self._spelt(piece) for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(clean)])

    def _small_word(self, word):
        """A word in small letters of Latin-1, which normalisation leaves as it is."""
        if word.isalpha():
            return self._piece(word)
        return b"".join(map(self.pieces.__getitem__, _LATIN_PATTERN.findall(word)))

    def _spelling(self, piece):
        return piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)

    def _piece(self, piece):
        return self._spelt(self._spelling(piece))

    def _spelt(self, piece):
        return np.array([token.id for token in self.tokenizer.model.tokenize(piece)], dtype="<u4").tobytes()


def _drops_white_space(layout):
    steps = (layout.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return (
        steps[0].get("type") == "Split"
        and steps[0].get("pattern") == {"Regex": WORD_PATTERN}
        and steps[0].get("behavior") == "Removed"
        and not any(token["lstrip"] or token["rstrip"] or token["single_word"] for token in layout["added_tokens"])
        and [step["type"] for step in layout["normalizer"].get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
    )


@functools.lru_cache(maxsize=2)
def _loaded(path):
    """A vocabulary file: the library's tokenizer, whether its words stand alone, its added tokens.
    It stays in a worker, as it doesn't grow with the texts."""
    tokenizer = Tokenizer.from_file(path)
    layout = json.loads(tokenizer.to_str())
    return tokenizer, _drops_white_space(layout), [token["content"] for token in layout["added_tokens"]]


#: What this worker process holds from task to task: one entry.
_held = {}


def held(make, *key):
    """make(*key), which this worker keeps until other caches are asked for."""
    if (make, key) not in _held:
        release()
        _held[make, key] = make(*key)
    return _held[make, key]


def encoder(path):
    """The worker's encoder for a vocabulary file."""
    return held(Encoder, path)


def release():
    """Give up the caches held. Workers outlive a stage; other operators call this
    first, so that a worker holds the words of one operator at a time."""
    _held.clear()


def end_bytes(end_id):
    return np.array([end_id], dtype="<u4").tobytes()
