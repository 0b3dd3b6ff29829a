"""Removal of repeated passages by longest-previous-factor arrays.

A byte goes if a string of ``length`` bytes around it also starts in a document with a smaller
doc_id; equal ids never take from each other. The suffixes of the whole corpus are never
sorted in one place: they are dealt out so that suffixes with a common prefix of
``length`` bytes meet, and each task then sorts its own.

1. Among the grams (two fifths of ``length``) of every ``length`` bytes, the one with the least
   hash is the anchor of that start. Equal strings have equal anchors, so starts are dealt out
   by the hash of their anchor's gram. Neighbouring starts with one anchor form a stretch, which
   is one row: anchor, hash of all its bytes, document, place.
2. Equal stretches are one class, of which the first document stands for all; its later
   copies are covered as a whole (128 bits of hash are taken as the bytes). Copies inside one
   block of texts are found before the shuffle and leave their key for a spread one, so a
   passage that a third of all documents holds puts one row a block on its key. Only anchors
   with several classes and several documents are open and go on, with one class member's bytes.
3. The suffixes of open stretches are sorted, neighbours' common prefixes measured, and the
   previous and next suffix of a smaller document give the longest previous factor. Where it
   reaches ``length``, its bytes are covered.
4. Anchors that very many stretches share with ever new bytes around them (a line in many
   documents) would fill one task with classes. A sample of documents names them; their
   starts are keyed one by one by their own ``length`` bytes. The sample decides how rows are
   dealt, never what is found.

Texts are whole UTF-8; null and empty ones, and those below ``length`` bytes, lose nothing.
Rows without doc_id lose nothing and take nothing. Repeated rows give a row each and the same
result; rows of one id with different texts are told apart. Long texts are read in pieces
that overlap by ``length`` - 1 bytes. Further columns are ignored; an empty table gives no rows.
"""

import functools
import hashlib

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlark.llm.common import arrow_schema, batch, batch_of_rows, groups, lists
from ledgerlark.plans import lineage

#: Bytes of text that are hashed together, about.
BLOCK = 1 << 20
#: Every so manieth document is looked at for anchors that are shared by very many stretches; an
#: anchor is if the sample shows it so often. At most ``HOT_KEYS`` are known to the tasks.
SAMPLE, HOT, HOT_KEYS = 64, 32, 65_536
#: Stretches whose suffixes are sorted together, about.
SORTED = 8192

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_PLACES = np.uint64((1 << 24) - 1)

#: ``place`` holds the first start, the number of starts and whether it is a copy; narrow rows keep the shuffle small.
_STRETCHES = "key long, bytes_hash long, doc long, variant int, place long"
_START_BITS = 22
_RANGES = "doc long, variant int, start long, stop long"
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _mix(x):
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _gram_hashes(data, gram):
    """A hash of the ``gram`` bytes (8 or more) from each place."""
    size = len(data) - gram + 1
    eights = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    found = eights[:size] * _STEP
    for at in [*range(8, gram - 8, 8), gram - 8] if gram > 8 else []:
        found ^= found >> np.uint64(29)
        found *= _M1
        found += eights[at : at + size]
    return _mix(found)


def _windows_least(values, width):
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[:-rest], values[rest:]) if rest else values


@functools.lru_cache(maxsize=1)
def _powers(size):
    """Powers of an odd factor and of its inverse modulo 2^64."""
    inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
    found = []
    for factor in (_STEP, inverse):
        powers = np.full(size, factor, dtype=np.uint64)
        powers[0] = 1
        found.append(np.cumprod(powers))
    return found


def stretches(data, ends, length, hot=None):
    """Of texts that lie end to end in ``data`` and end at ``ends``: key, hash of the bytes, first
    start and number of starts of every stretch. Starts of ``hot`` keys come one by one."""
    gram = max(8, 2 * length // 5)
    size = len(data) - length + 1
    if size < 1:
        return (np.zeros(0, dtype=np.uint64),) * 2 + (np.zeros(0, dtype=np.int64),) * 2
    hashes = _gram_hashes(data, gram)
    placed = (hashes & ~_PLACES) | np.arange(len(hashes), dtype=np.uint64)
    anchors = (_windows_least(placed, length - gram + 1) & _PLACES).astype(np.int64)
    owner = np.zeros(size, dtype=np.int64)  # the text a start lies in, or none if it reaches over its end
    usable = np.ones(size, dtype=bool)
    for end in ends[:-1]:
        usable[max(0, end - length + 1) : end] = False
        if end < size:
            owner[end] = 1
    breaks = np.empty(size, dtype=bool)
    breaks[0] = True
    breaks[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] > 0) | (usable[1:] != usable[:-1])
    if hot is not None and len(hot):
        where = np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)
        at_hot = (hot[where] == hashes)[anchors]
        breaks |= at_hot
    else:
        at_hot = None
    starts = np.flatnonzero(breaks)
    counts = np.diff(np.append(starts, size))
    keep = usable[starts]
    starts, counts = starts[keep], counts[keep]
    powers, inverses = _powers(max(1 << 21, 1 << len(hashes).bit_length()))
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * powers[: len(hashes)], out=sums[1:])
    whole = (sums[starts + counts + (length - gram)] - sums[starts]) * inverses[starts]
    whole = _mix(whole + counts.astype(np.uint64) * _M2)
    keys = hashes[anchors[starts]]
    if at_hot is not None:
        keys = np.where(at_hot[starts], _mix(whole * _STEP + np.uint64(1)), keys)
    return keys, whole, starts, counts


def _blocks(batches, length):
    """Whole texts end to end up to about ``BLOCK`` bytes, or a piece of a longer one:
    bytes, ends of texts, their documents and the place in the text where they begin."""
    held, size = [], 0

    def block():
        data = np.frombuffer(b"".join(text for *_, text in held), dtype=np.uint8)
        ends = np.cumsum([len(text) for *_, text in held])
        return data, ends, np.array([doc for doc, *_ in held]), np.array([v for _, v, *_ in held]), np.array([at for _, _, at, _ in held])

    for records in batches:
        for at in range(0, records.num_rows, 512):
            for doc, variant, text in zip(*lists(records.slice(at, 512), "doc", "variant", "text")):
                text = text.encode("utf-8", "surrogatepass")
                for piece in range(0, max(1, len(text) - length + 1), BLOCK):
                    part = text[piece : piece + BLOCK + length - 1]
                    if len(part) < length:
                        continue
                    if size + len(part) > BLOCK and held:
                        yield block()
                        held, size = [], 0
                    held.append((doc, variant, piece, part))
                    size += len(part)
    if held:
        yield block()


def _found(batches, length, hot):
    """Stretches of all texts; those whose class stands in an earlier document of the block
    are marked as copies and get a key of their own."""
    schema = arrow_schema(_STRETCHES)
    hot = None if hot is None else np.array(hot, dtype=np.int64).view(np.uint64)
    for data, ends, docs, variants, places in _blocks(batches, length):
        keys, whole, starts, counts = stretches(data, ends, length, hot)
        text = np.searchsorted(ends, starts, side="right")
        doc = docs[text]
        order = np.lexsort((doc, whole, keys))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (keys[order][1:] != keys[order][:-1]) | (whole[order][1:] != whole[order][:-1])
        first = np.empty(len(order), dtype=np.int64)
        first[order] = doc[order][np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else 0
        copy = first < doc
        start = starts - np.concatenate([[0], ends[:-1]])[text] + places[text]
        # copies side by side are one stretch; what they held is known already
        joint = np.zeros(len(starts), dtype=bool)
        joint[1:] = copy[1:] & copy[:-1] & (text[1:] == text[:-1])
        heads = np.flatnonzero(~joint)
        counts = np.add.reduceat(counts, heads) if len(heads) else counts
        keys, whole, doc, text, start, copy = keys[heads], whole[heads], doc[heads], text[heads], start[heads], copy[heads]
        spread = _mix((doc.astype(np.uint64) + start.astype(np.uint64) * _M1) * _STEP)
        keys = np.where(copy, spread, keys)
        yield batch(schema, keys.view(np.int64), whole.view(np.int64), doc, variants[text], (start << _START_BITS) + 2 * counts + copy)


def _hot_keys(texts, length):
    """Keys of anchors that very many stretches share, from a sample of documents."""
    sample = texts.filter(F.pmod(F.xxhash64("doc", F.lit("hot")), F.lit(SAMPLE)) == 0)
    seen = sample.mapInArrow(functools.partial(_found, length=length, hot=None), _STRETCHES).filter("place % 2 = 0")
    often = seen.groupBy("key").agg(F.countDistinct("bytes_hash").alias("n")).filter(F.col("n") >= HOT)
    return sorted(row["key"] for row in often.orderBy(F.desc("n"), "key").limit(HOT_KEYS).collect())


def longest_previous(rows, docs, available):
    """For each suffix, given as a row of bytes of which ``available`` count: how many bytes it
    shares at most with a suffix of a smaller document."""
    width = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), width), dtype=np.uint8)
    padded[:, : rows.shape[1]] = rows
    padded[np.arange(width) >= available[:, None]] = 0
    words = padded.view(">u8").astype(np.uint64)
    order = np.lexsort((available, *words.T[::-1]))
    sorted_rows, reach = padded[order], available[order]
    differ = sorted_rows[1:] != sorted_rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common = np.minimum(common, np.minimum(reach[1:], reach[:-1])).tolist()
    order_docs = docs[order].tolist()
    best = [0] * len(order)
    for indices, links in ((range(len(order)), [0, *common]), (range(len(order) - 1, -1, -1), [*common, 0])):
        smaller = []  # documents of suffixes passed, rising, each with the bytes shared with the one below
        for k in indices:
            doc, shared = order_docs[k], links[k]
            while smaller and smaller[-1][0] >= doc:
                shared = min(shared, smaller.pop()[1])
            if smaller and shared > best[k]:
                best[k] = shared
            smaller.append((doc, shared))
    found = np.empty(len(order), dtype=np.int64)
    found[order] = best
    return found


def _covered(batches, length):
    """Ranges of open stretches that a longest previous factor of ``length`` or more covers."""
    schema = arrow_schema(_RANGES)
    held, size = [], 0
    for _, table in groups(batches, ["key"], ["doc", "variant", "start", "bytes"]):
        held.append(table)
        size += table.num_rows
        if size >= SORTED:
            yield _covered_of(held, length, schema)
            held, size = [], 0
    if held:
        yield _covered_of(held, length, schema)


def _covered_of(tables, length, schema):
    texts = [text for table in tables for text in table.column("bytes").to_pylist()]
    doc, variant, start = (np.concatenate([table.column(name).to_numpy() for table in tables]) for name in ("doc", "variant", "start"))
    sizes = np.array([len(text) for text in texts])
    begins = np.cumsum(sizes) - sizes
    counts = sizes - length + 1
    stretch = np.repeat(np.arange(len(texts)), counts)
    inside = np.arange(len(stretch)) - np.repeat(np.cumsum(counts) - counts, counts)
    width = int(sizes.max())
    data = np.frombuffer(b"".join(texts) + bytes(width), dtype=np.uint8)
    suffixes = np.lib.stride_tricks.sliding_window_view(data, width)[begins[stretch] + inside]
    factor = longest_previous(suffixes, doc[stretch], sizes[stretch] - inside)
    hit = np.flatnonzero(factor >= length)
    owner, first = np.unique(stretch[hit], return_index=True)
    # starts of a stretch lie closer than `length`, so what they cover is one range
    stop = np.maximum.reduceat((inside + factor)[hit], first) if len(hit) else hit
    return batch(schema, doc[owner], variant[owner], start[owner] + inside[hit[first]], start[owner] + stop)


def _open_bytes(batches, length):
    schema = arrow_schema("key long, doc long, variant int, start long, bytes binary")
    for records in batches:
        for at in range(0, records.num_rows, 256):
            rows = []
            for doc, variant, text, stretch in zip(*lists(records.slice(at, 256), "doc", "variant", "text", "open")):
                text = text.encode("utf-8", "surrogatepass")
                rows += [(s["key"], doc, variant, s["start"], text[s["start"] : s["start"] + s["length"] + length - 1]) for s in stretch]
            yield batch_of_rows(schema, rows)


def _kept(batches):
    schema = arrow_schema(_RESULT)
    for records in batches:
        for at in range(0, records.num_rows, 512):
            rows = []
            for doc_id, text, ranges in zip(*lists(records.slice(at, 512), "doc_id", "text", "ranges")):
                text = (text or "").encode("utf-8", "surrogatepass")
                kept, upto, removed, spans = [], 0, 0, 0
                for start, stop in sorted((r["start"], r["stop"]) for r in ranges or ()):
                    if start > upto or not spans:
                        kept.append(text[upto:start])
                        spans += 1
                        upto = start
                    removed += max(0, stop - upto)
                    upto = max(upto, stop)
                kept.append(text[upto:])
                rows.append((doc_id, len(text), removed, spans, hashlib.sha256(b"".join(kept)).hexdigest()))
            yield batch_of_rows(schema, rows)


def _with_variants(docs):
    """A number that tells different texts of one id apart, for ids that have several; stored, so
    that the planner knows how few they are."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    several = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b"))
    several = docs.join(several.filter("a <> b").select("doc_id"), "doc_id", "left_semi").select("doc_id", "text_hash").distinct()
    number = (F.row_number().over(Window.partitionBy("doc_id").orderBy("text_hash")) - 1).alias("variant")
    return lineage.cut(several.select("doc_id", "text_hash", number), "variants")


def covered_ranges(docs, length=50, hot=None):
    """Ranges of bytes (doc, variant, start, stop) that go; they may overlap. ``hot``: the keys to
    be dealt out start by start, as sampled if None."""
    texts = docs.filter("doc_id is not null").filter(F.octet_length("text") >= length).select(F.col("doc_id").alias("doc"), "variant", "text")
    hot = _hot_keys(texts, length) if hot is None else sorted(hot)
    rows = texts.mapInArrow(functools.partial(_found, length=length, hot=hot), _STRETCHES)
    by_key, by_class = Window.partitionBy("key"), Window.partitionBy("key", "bytes_hash")
    rows = rows.withColumns(
        {
            "first": F.min("doc").over(by_class),
            "least": F.min("doc").over(by_key),
            "most": F.max("doc").over(by_key),
            "classes": F.min("bytes_hash").over(by_key) != F.max("bytes_hash").over(by_key),
        }
    )
    rows = rows.withColumn("whole", (F.col("place") % 2 == 1) | (F.col("first") < F.col("doc")))
    rows = rows.filter(F.col("whole") | F.col("classes") & (F.col("least") < F.col("most")))
    start = F.shiftright("place", _START_BITS)
    starts = F.shiftright(F.col("place").bitwiseAND((1 << _START_BITS) - 1), 1)
    rows = lineage.cut(rows.select("key", "doc", "variant", start.alias("start"), starts.alias("length"), "whole"), "stretches")
    whole = rows.filter("whole").select("doc", "variant", "start", (F.col("start") + F.col("length") + F.lit(length - 1)).alias("stop"))

    opened = rows.filter("not whole").groupBy("doc", "variant").agg(F.collect_list(F.struct("key", "start", "length")).alias("open"))
    given = texts.join(opened, ["doc", "variant"]).mapInArrow(functools.partial(_open_bytes, length=length), "key long, doc long, variant int, start long, bytes binary")
    dealt = given.repartition("key").sortWithinPartitions("key", "doc", "start")
    return whole.union(dealt.mapInArrow(functools.partial(_covered, length=length), _RANGES))


def without_repeats(docs, length=50, hot=None):
    """What is left of every text: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and the
    digest of the remaining bytes."""
    numbers = _with_variants(docs)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(numbers, ["doc_id", "text_hash"], "left")
    docs = docs.select("doc_id", "text", F.coalesce("variant", F.lit(0)).alias("variant"))
    ranges = covered_ranges(docs, length, hot).groupBy("doc", "variant").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    ranges = ranges.withColumnsRenamed({"doc": "doc_id"})
    return docs.join(ranges, ["doc_id", "variant"], "left").select("doc_id", "text", "ranges").mapInArrow(_kept, _RESULT)
