"""Periodic runs of words by string synchronising sets at dyadic scales.

A run of smallest period q and length of at least 4 q is found at the scale t with
t <= q < 2 t. At that scale a position synchronises if, among the positions up to t words
behind it, the least hash of t words stands at it or t words on. Whether it does depends
on the 2 t words from it alone, and any t neighbouring positions hold one unless
the words there repeat with a period of t / 4 or less. So inside such a run
some synchronising position s stands in the first t places, s + q is one too, and the next
position with the 2 t words of s is exactly s + q: equal-context neighbours at distance d
propose period d, which is then extended word by word to the maximal run and so verified.

Positions where t words repeat with a period of t / 4 or less never count as least, which
keeps the sets thin: those highly periodic regions are known from the runs of lower scales,
which also supply their small periods. A text without two equal contexts at one scale has
none at higher ones and is left there.

Words are the runs of bytes other than blank and 0x09 to 0x0D of the whole text. Null texts
have no words, nor have empty ones; a row without doc_id is analysed as it is, without planted
runs. Each row gives a row, repeated ones too. Further columns are ignored; an empty table gives no rows.
Memory grows with the longest single text, about 100 bytes a word.
"""

import hashlib
import zlib

import numpy as np

from ledgerlark.llm.common import arrow_schema, batch_of_rows, lists

#: A run's least length in words, and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Rows of a record batch that a task gives back.
ROWS_OUT = 2000

RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x):
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _windows_least(values, width):
    """The least of each ``width`` neighbouring values."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def _matches_from(codes, at, period):
    """How many words from ``at`` on equal the word a period later."""
    n, found, step = len(codes) - period, 0, 64
    while at + found < n:
        upto = min(at + found + step, n)
        differ = np.flatnonzero(codes[at + found : upto] != codes[at + found + period : upto + period])
        if len(differ):
            return found + int(differ[0])
        found, step = upto - at, step * 4
    return found


def _matches_before(codes, at, period):
    """How many words just before ``at`` equal the word a period later."""
    found, step = 0, 64
    while found < at:
        low = max(at - found - step, 0)
        differ = np.flatnonzero(codes[low : at - found] != codes[low + period : at - found + period])
        if len(differ):
            return found + at - found - 1 - low - int(differ[-1])
        found, step = at - low, step * 4
    return found


def _equal_neighbours(contexts, places):
    """Places whose context stands again at a later place, and the next such place."""
    order = np.lexsort((places, contexts))
    contexts, places = contexts[order], places[order]
    same = contexts[1:] == contexts[:-1]
    return places[:-1][same], places[1:][same]


def periodic_runs(codes):
    """All runs (start, length, period) of a sequence of word numbers, by start and period:
    smallest period q, at least ``LEAST_WORDS`` words and ``LEAST_PERIODS`` periods, maximal."""
    n, scale, runs = len(codes), 1, {}
    level = _mix((codes.astype(np.uint64) + np.uint64(1)) * _STEP)  # hashes of `scale` words
    while n >= LEAST_PERIODS * scale:
        contexts = _mix(level[:-scale] * _STEP + level[scale:])  # of 2 * scale words
        in_order = np.sort(contexts)
        if not (in_order[1:] == in_order[:-1]).any():
            break
        ids = level
        highly = [(start, length) for (start, length), period in runs.items() if LEAST_PERIODS * period <= scale <= length]
        if highly:
            ids = level.copy()
            for start, length in highly:
                ids[start : start + length - scale + 1] = _NONE
        least = _windows_least(ids, scale + 1)
        size = len(least)
        synchronises = ((least == ids[:size]) | (least == ids[scale : scale + size])) & (least != _NONE)
        places = np.flatnonzero(synchronises)
        first, second = _equal_neighbours(contexts[places], places)
        gaps = second - first
        fits = (gaps >= scale) & (gaps < 2 * scale)
        reached = {}
        for at, period in sorted(zip(first[fits].tolist(), gaps[fits].tolist())):
            if at < reached.get(period, 0):
                continue
            start = at - _matches_before(codes, at, period)
            end = at + _matches_from(codes, at, period) + period
            reached[period] = end - period
            if end - start >= max(LEAST_WORDS, LEAST_PERIODS * period):
                runs.setdefault((start, end - start), period)  # lower scales and periods come first
        level, scale = contexts, 2 * scale
    return sorted((start, length, period) for (start, length), period in runs.items())


def planted(words, doc_id):
    """The words of a text after the planted change: every tenth id by hash becomes periodic from
    some word on."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return (words[:a] + unit * (-(-(n - a) // p)))[:n]


def _analysed(doc_id, text):
    words = planted((text or "").encode("utf-8", "surrogatepass").split(), doc_id)
    numbers = {word: k for k, word in enumerate(dict.fromkeys(words))}
    runs = []
    if len(numbers) < len(words):
        runs = periodic_runs(np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words)))
    digest = hashlib.sha256("".join([f"{start},{length},{period}\n" for start, length, period in runs]).encode()).hexdigest()
    kept = words
    if runs:
        change = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        kept = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    collapsed = hashlib.sha256(b" ".join(kept)).hexdigest()
    longest = (None,) * 4
    if runs:
        start, length, period = min(runs, key=lambda run: (-run[1], run[0], run[2]))
        longest = (start, length, period, 1000 * length // period)
    return (doc_id, len(runs), *longest, digest, collapsed)


def _analyse(batches):
    schema, rows = arrow_schema(RESULT), []
    for records in batches:
        for at in range(0, records.num_rows, ROWS_OUT):
            for row in zip(*lists(records.slice(at, ROWS_OUT), "doc_id", "text")):
                rows.append(_analysed(*row))
            yield batch_of_rows(schema, rows)
            rows = []


def run_table(docs):
    """Runs of every text: their number, the longest one (ties: least start, then period), a
    digest of all of them and one of the text without their repeats."""
    return docs.select("doc_id", "text").mapInArrow(_analyse, RESULT)
