"""Near-duplicate documents by b-bit MinHash with bands.

1. One pass over the texts: the set of word shingles, its minima under
   ``BANDS x ROWS`` hash functions, the low ``BITS`` bits of each minimum packed
   into a signature, and one key for each band of minima. Equal texts become one
   class before anything else is shuffled.
2. In each bucket (band, key) the classes are compared with one pivot, which is
   linear in the rows of the bucket. Bits that agree by chance are corrected for
   when the similarity of two signatures is estimated; estimates far below the
   threshold end here, all others are confirmed on the full shingle sets.
3. In buckets whose classes the pivots left in several components, those outside the
   bucket's largest component meet all others, in blocks of which a task holds two.
   Signatures first tell which classes have a partner of another component at all;
   their texts then meet in the same way, and each pair that may still join two
   components is confirmed on full sets in the one bucket that is its first. A task
   reports only links that join components, never all pairs.

Two texts of similarity 0.8 share no band with probability (1 - 0.8^6)^40, 5e-6,
and fail the estimate, set five standard deviations low, less often than that.
"""

import numpy as np
import xxhash
from pyspark.sql import functions as F

from ledgerlark.llm.common import arrow_schema, batch_of_rows, groups, lists, matrix, pieces
from ledgerlark.llm.components import components
from ledgerlark.llm.tokens import CACHE_WORDS, Cache, release
from ledgerlark.plans import lineage

BANDS, ROWS, BITS = 40, 6, 4
#: Signatures, and signatures with texts, on each side of a block that a task compares.
BLOCK, TEXT_BLOCK = 1024, 512
_HASHES = BANDS * ROWS
_LANES = 64 // BITS
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(20240229)
_FACTORS = (_SEEDS.integers(0, 1 << 32, _HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_OFFSETS = _SEEDS.integers(0, 1 << 32, _HASHES, dtype=np.uint64).astype(np.uint32)


def _mix(x):
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingles:
    """hashes(text, width): the distinct shingles of a text as sorted 64-bit hashes.

    Words are runs of bytes other than blank and 0x09 to 0x0D, A to Z lowered. A
    text of fewer words than ``width`` is one shingle, one without words has none."""

    def __init__(self):
        release()
        self.words = Cache(xxhash.xxh3_64_intdigest, CACHE_WORDS, 48)

    def hashes(self, text, width):
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        codes = np.fromiter(map(self.words.__getitem__, words), dtype=np.uint64, count=len(words))
        n = len(codes) - width + 1
        if n < 1:
            n, width = 1, len(codes)
        found = _mix(codes[:n] + np.uint64(width))
        for k in range(1, width):
            found = _mix(found * _STEP + codes[k : k + n])
        return np.unique(found)


def minima(hashes):
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    found = np.empty(_HASHES, dtype=np.uint32)
    for at in range(0, _HASHES, 16):
        values = np.multiply.outer(_FACTORS[at : at + 16], short)
        values += _OFFSETS[at : at + 16, None]
        found[at : at + 16] = values.min(axis=1)
    return found


def packed_bits(least):
    """The low bits of the minima, after mixing, in 64-bit words."""
    low = _mix(least.astype(np.uint64)) & np.uint64((1 << BITS) - 1)
    shifts = np.arange(_LANES, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(low.reshape(-1, _LANES) << shifts, axis=1).view(np.int64)


def band_keys(least):
    rows = least.astype(np.uint64).reshape(BANDS, ROWS)
    keys = _mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP)
    for k in range(ROWS):
        keys = _mix(keys * _STEP + rows[:, k])
    return keys.view(np.int64)


def least_agreeing(percent):
    """Bit groups that must agree for a pair to be confirmed: the expected number at
    the threshold, agreement by chance included, less five standard deviations."""
    s, chance = percent / 100, 2.0**-BITS
    agree = s + (1 - s) * chance
    return int(np.floor(_HASHES * agree - 5 * np.sqrt(_HASHES * agree * (1 - agree))))


def _agreeing(left, right):
    """A column: bit groups that agree in two packed signatures."""
    ones = sum(1 << (BITS * k) for k in range(_LANES))
    ones -= (1 << 64) if ones >= 1 << 63 else 0

    def differing(x):
        folded = x
        for k in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, k))
        return F.bit_count(folded.bitwiseAND(F.lit(ones)))

    words = F.zip_with(left, right, lambda x, y: x.bitwiseXOR(y))
    return F.lit(_HASHES) - F.aggregate(words, F.lit(0), lambda total, x: total + differing(x))


def _signatures(docs, width):
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.unhex(F.md5("text")).alias("text_key"))
    out = "doc_id long, text_key binary, n_shingles long, bits array<long>, keys array<long>"

    def sign(batches):
        shingles, last = Shingles(), (None, None)
        for records in pieces(batches):
            found = []
            for doc_id, text, key in zip(*lists(records, "doc_id", "text", "text_key")):
                if key != last[0]:
                    hashes = shingles.hashes(text, width)
                    least = minima(hashes) if len(hashes) else None
                    last = key, (len(hashes),) + ((packed_bits(least), band_keys(least)) if len(hashes) else ([], []))
                found.append((doc_id, key, *last[1]))
            yield batch_of_rows(arrow_schema(out), found)

    return rows.mapInArrow(sign, out)


def _texts(need, classes, docs):
    """class and text of the classes in ``need`` (class)."""
    keys = need.distinct().join(classes.select("class", "text_key"), "class")
    text = F.coalesce("text", F.lit(""))
    found = docs.select(F.unhex(F.md5(text)).alias("text_key"), text.alias("text")).join(keys, "text_key")
    return lineage.cut(found.groupBy("class").agg(F.first("text").alias("text")), "pair-texts")


def _similar(left, right, percent):
    shared = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * shared >= percent * (len(left) + len(right) - shared)


def _confirmed(pairs, classes, docs, width, percent):
    """The pairs (a, b) of classes whose full shingle sets are similar enough."""
    texts = _texts(pairs.select(F.col("a").alias("class")).union(pairs.select("b")), classes, docs)
    both = pairs.join(texts.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b"
    )

    def confirm(batches):
        shingles, held = Shingles(), {}

        def hashes(number, text):
            if number not in held:
                if len(held) >= 64:
                    held.clear()
                held[number] = shingles.hashes(text, width)
            return held[number]

        for records in batches:
            found = []
            for a, b, text_a, text_b in zip(*lists(records, "a", "b", "text_a", "text_b")):
                if _similar(hashes(a, text_a), hashes(b, text_b), percent):
                    found.append((a, b))
            yield batch_of_rows(arrow_schema("a long, b long"), found)

    return lineage.cut(both.select("a", "b", "text_a", "text_b").mapInArrow(confirm, "a long, b long"), "links")


def _estimated(pairs, classes, percent):
    side = classes.select("class", "n_shingles", "bits")
    left = side.select(*[F.col(c).alias(c2) for c, c2 in (("class", "a"), ("n_shingles", "n_a"), ("bits", "bits_a"))])
    right = side.select(*[F.col(c).alias(c2) for c, c2 in (("class", "b"), ("n_shingles", "n_b"), ("bits", "bits_b"))])
    close = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return pairs.join(left, "a").join(right, "b").filter(close & (_agreeing(F.col("bits_a"), F.col("bits_b")) >= least_agreeing(percent))).select("a", "b")


def _in_blocks(members, size):
    """``members`` (bucket, class, label) of buckets with several labels, dealt to units
    (bucket, part, block): the block's members as they are (asks 0), and a part of those
    outside the bucket's most common label (asks 1), who look for partners among them."""
    labels = members.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    counts = labels.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most")).filter("n > most.n")
    open_buckets = counts.select(
        "bucket",
        F.col("most.label").alias("common"),
        F.ceil(F.col("n") / size).cast("int").alias("blocks"),
        F.ceil((F.col("n") - F.col("most.n")) / size).cast("int").alias("parts"),
    )
    placed = members.join(open_buckets, "bucket")

    def dealt(rows, own, count, other, others, asks):
        one = F.pmod(F.xxhash64("class"), F.col(count)).cast("int").alias(own)
        each = F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(other)
        return rows.select("bucket", "class", "label", one, each, F.lit(asks).alias("asks")).select("bucket", "part", "block", "asks", "class", "label")

    return dealt(placed, "block", "blocks", "part", "parts", 0).union(
        dealt(placed.filter("label <> common"), "part", "parts", "block", "blocks", 1)
    )


def _compared(blocks, columns, compare, out):
    by = ["bucket", "part", "block"]

    def run(batches):
        shingles = Shingles()
        for key, unit in groups(batches, by, columns):
            yield batch_of_rows(arrow_schema(out), compare(key, unit, shingles))

    return blocks.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, out)


class _Block:
    """The signatures of a unit: near(i) are the members that the asking row i may be similar to,
    most similar first. Of two rows that may ask each other the smaller class does."""

    _ONES = np.uint64(sum(1 << (BITS * k) for k in range(_LANES)))

    def __init__(self, unit, percent):
        self.number, self.label, self.asks, self.size = (unit.column(name).to_numpy() for name in ("class", "label", "asks", "n_shingles"))
        self.label = self.label.copy()
        self.bits = matrix(unit.column("bits")).view(np.uint64)
        self.percent, self.least = percent, least_agreeing(percent)
        self.asking, self.members = np.flatnonzero(self.asks == 1), np.flatnonzero(self.asks == 0)
        # members whose own asking row is in this unit too
        self.mutual = np.isin(self.number[self.members], self.number[self.asking])

    def near(self, i):
        other = self.members[(self.label[self.members] != self.label[i]) & (~self.mutual | (self.number[self.members] > self.number[i]))]
        other = other[100 * np.minimum(self.size[other], self.size[i]) >= self.percent * np.maximum(self.size[other], self.size[i])]
        x = self.bits[other] ^ self.bits[i]
        folded = x
        for k in range(1, BITS):
            folded = folded | (x >> np.uint64(k))
        agree = _HASHES - np.bitwise_count(folded & self._ONES).sum(axis=1, dtype=np.int64)
        order = np.argsort(-agree, kind="stable")
        return other[order][agree[order] >= self.least]


def _doubtful(members, labels, classes, percent):
    """The members whose signature comes near one of another component in their bucket: bucket, class, label."""
    labelled = members.join(labels.select(F.col("node").alias("class"), "root"), "class", "left").select("bucket", "class", F.coalesce("root", "class").alias("label"))
    # a pair alone in its bucket has met as class and pivot
    large = members.groupBy("bucket").count().filter("count > 2").select("bucket")
    blocks = _in_blocks(labelled.join(large, "bucket"), BLOCK).join(classes.select("class", "n_shingles", "bits"), "class")

    def compare(key, unit, _):
        block, found = _Block(unit, percent), set()
        for i in block.asking:
            near = block.near(i)
            if len(near):
                found.update((i, *near))
        return [(key[0], block.number[k], block.label[k]) for k in found]

    out = "bucket long, class long, label long"
    return lineage.cut(_compared(blocks, ["class", "label", "asks", "n_shingles", "bits"], compare, out).distinct(), "doubtful")


def _joining(doubtful, classes, docs, width, percent):
    """Confirmed links (a, b) between different components, enough to join them, inside buckets."""
    texts = _texts(doubtful.select("class"), classes, docs)
    blocks = _in_blocks(doubtful, TEXT_BLOCK).join(classes.select("class", "n_shingles", "bits", "keys"), "class").join(texts, "class")

    def compare(key, unit, shingles):
        block, found = _Block(unit, percent), []
        keys, texts = matrix(unit.column("keys")), unit.column("text")
        held = {}

        def hashes(k):
            if k not in held:
                held[k] = shingles.hashes(texts[k].as_py(), width)
            return held[k]

        for i in block.asking:
            for j in block.near(i):
                # a pair is looked at in its first common bucket only
                if block.label[i] == block.label[j] or keys[i][(keys[i] == keys[j]).argmax()] != key[0]:
                    continue
                if _similar(hashes(i), hashes(j), percent):
                    found.append(tuple(sorted((block.number[i], block.number[j]))))
                    block.label[block.label == block.label[j]] = block.label[i]
        return found

    columns = ["class", "label", "asks", "n_shingles", "bits", "keys", "text"]
    return lineage.cut(_compared(blocks, columns, compare, "a long, b long"), "links")


def _grouped(docs, width, percent):
    """doc_id, text_key (md5), n_shingles, group and component of every row of ``docs``: rows of one
    group are near-duplicates of each other, a row without words is in none. Two groups have one
    component if rows of one doc_id differ and each is the smallest of its group."""
    signed = lineage.cut(_signatures(docs, width), "signatures")
    classes = lineage.cut(
        signed.filter("n_shingles > 0")
        .groupBy("text_key")
        .agg(F.min("doc_id").alias("least_id"), *[F.first(name).alias(name) for name in ("n_shingles", "bits", "keys")])
        .withColumn("class", F.monotonically_increasing_id()),
        "classes",
    )
    spread = classes.select("class", F.posexplode("keys").alias("band", "bucket"))
    # pivots by one of four orders, so that classes which one pivot misses meet another
    pivot = F.min(F.struct(F.xxhash64("class", F.col("band") % 4).alias("order"), "class"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("n"), pivot.alias("pivot")).filter("n > 1")
    members = lineage.cut(spread.join(shared.select("bucket", F.col("pivot.class").alias("pivot")), "bucket").select("bucket", "class", "pivot"), "buckets")
    pairs = members.filter("class <> pivot").select(F.least("class", "pivot").alias("a"), F.greatest("class", "pivot").alias("b")).distinct()
    tested = lineage.cut(_estimated(pairs, classes, percent), "pairs")
    links = _confirmed(tested, classes, docs, width, percent)
    labels = lineage.cut(components(links), "labels")
    doubtful = _doubtful(members, labels, classes, percent)
    if not doubtful.isEmpty():
        labels = lineage.cut(components(links.union(_joining(doubtful, classes, docs, width, percent))), "labels")
    known = classes.join(labels.select(F.col("node").alias("class"), "root"), "class", "left").select("text_key", "least_id", F.coalesce("root", "class").alias("root"))
    roots = known.groupBy("root").agg(F.min("least_id").alias("component"))
    named = known.join(roots, "root").select("text_key", "component", F.col("root").alias("group"))
    return signed.select("doc_id", "n_shingles", "text_key").join(named, "text_key", "left")


def near_duplicates(docs, width=5, percent=80):
    """Groups of near-duplicate ``docs`` (doc_id, text): doc_id, n_shingles,
    component_id, kept. Links join texts with 100 x intersection >= percent x union
    of their word shingles.

    Texts without words, null ones among them, have no shingles and are linked with
    nothing. Equal texts are linked. Rows with one doc_id stay rows of their own and
    count for what their texts are; null ids name no component: a group's component
    is its smallest id that isn't null, null if there is none. An empty table gives
    no rows. Other columns are not read."""
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return (
        _grouped(docs, width, percent)
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def one_of_each(docs, width=5, percent=80):
    """``docs``, with all their columns, without all but one row of each group of near-duplicates: the
    row of the smallest doc_id, of several with it that of the smallest md5 of the text, of equal
    rows any. Rows without words and rows without doc_id all stay."""
    key = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    rows = _grouped(docs, width, percent).filter("n_shingles > 0 and doc_id is not null")
    least = rows.groupBy("group").agg(F.min(F.struct("doc_id", "text_key")).alias("least"))
    chosen = lineage.cut(least.select(F.col("least.doc_id").alias("kept_id"), F.col("least.text_key").alias("kept_key")), "kept-rows")
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("kept_id"), key.alias("kept_key"))
    # what `bytes.split` of the shingles sees as a word
    wordless = ~F.coalesce(F.col("row.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    always = F.col("kept_id").isNull() | wordless
    single = whole.filter(~always).join(chosen, ["kept_id", "kept_key"], "left_semi").dropDuplicates(["kept_id", "kept_key"])
    return single.select("row.*").unionByName(whole.filter(always).select("row.*"))
