"""Shards of nearly equal bytes by a K-d tree over document metadata.

Documents of one text form a group that stays together. The groups are points
with four coordinates: document id, size, source and language. The tree halves
its shards level by level: each node takes its widest coordinate and cuts at the
weighted median, found by narrowing a histogram over all nodes of a level at
once, so no point is sorted and only histogram cells reach the driver, at most
``CELLS`` a node. Ties in a coordinate are ordered by a hash of the text.

A group that is large against a shard would unbalance any cut. Such groups, a
bounded number since each holds a fixed part of a shard, are given to shards
first, those above ``PIECE_SHARE`` of a shard in pieces; the tree then cuts in
proportion to what its shards still lack.
"""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlark.plans import lineage

#: Histogram cells of a node in one pass.
CELLS = 4096
#: Groups above this part of a shard are placed first; above the other, in pieces.
HEAVY_SHARE, PIECE_SHARE = 1 / 16, 1 / 2
#: A cut ends when its cell holds less than this part of a shard.
CUT_SHARE = 1 / 4096
#: Documents numbered in one task.
SLOT_ROWS = 50_000
COORDINATES = ("at_id", "at_size", "at_source", "at_lang")
_BITS = 31


def _per_node(pairs, default=None):
    """A column that has each node's own value."""
    column = None
    for node, value in pairs.items():
        value = value if hasattr(value, "cast") else F.lit(value)
        column = F.when(F.col("node") == node, value) if column is None else column.when(F.col("node") == node, value)
    return column if default is None else column.otherwise(default)


def _scaled(value, low, high):
    width = max(float(high or 0) - float(low or 0), 1e-9)
    return F.floor((value.cast("double") - F.lit(float(low or 0))) / width * ((1 << _BITS) - 1)).cast("long")


def _rows(docs):
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(text).alias("text_key"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.monotonically_increasing_id().alias("row"),
    )


def _place_heavy(units, shards, target):
    """Largest first, each to the shard with the least so far."""
    load, place = [0] * shards, []
    for key, piece, size in sorted(units, key=lambda unit: (-unit[2], unit[0], unit[1])):
        shard = min(range(shards), key=lambda k: (load[k], k))
        load[shard] += size
        place.append((key, piece, shard))
    return [max(0.0, target - part) for part in load], place


class _Tree:
    """Nodes are ranges of shards; ``node`` is the number of the range's first shard."""

    def __init__(self, shards, lack):
        self.lack, self.nodes = lack, {0: shards}

    def _part(self, first, count):
        total = sum(self.lack[first : first + count])
        left = sum(self.lack[first : first + count // 2])
        return left / total if total else (count // 2) / count

    @staticmethod
    def key(coordinate):
        return F.shiftleft(F.col(coordinate), _BITS) + F.col("at_text")

    def split_level(self, points, close):
        """Cut every node of two shards or more; returns the points with their new nodes."""
        measures = [f(name).alias(f"{kind}_{name}") for name in COORDINATES for kind, f in (("low", F.min), ("high", F.max))]
        wide = {row["node"]: row for row in points.groupBy("node").agg(F.sum("bytes").alias("bytes"), *measures).collect()}
        open_nodes, chosen = {}, {}
        for first, count in self.nodes.items():
            if count < 2:
                continue
            row = wide.get(first)
            spread = {name: row[f"high_{name}"] - row[f"low_{name}"] for name in COORDINATES} if row else {}
            chosen[first] = max(COORDINATES, key=lambda name: spread.get(name, 0))
            low = row[f"low_{chosen[first]}"] << _BITS if row else 0
            high = (row[f"high_{chosen[first]}"] + 1) << _BITS if row else 1
            open_nodes[first] = {"low": low, "high": high, "want": self._part(first, count) * (row["bytes"] if row else 0)}
        bounds = {}
        key = _per_node({first: self.key(name) for first, name in chosen.items()}, F.lit(0))
        keyed = points.select("node", "bytes", key.alias("key"))
        while open_nodes:
            step = {k: -(-(v["high"] - v["low"]) // CELLS) for k, v in open_nodes.items()}
            low, high = _per_node({k: v["low"] for k, v in open_nodes.items()}), _per_node({k: v["high"] for k, v in open_nodes.items()})
            inside = keyed.filter(F.col("node").isin(list(open_nodes))).filter((F.col("key") >= low) & (F.col("key") < high))
            cell = F.call_function("div", F.col("key") - low, _per_node(step))
            cells = {}
            for row in inside.groupBy("node", cell.alias("cell")).agg(F.sum("bytes").alias("bytes")).collect():
                cells.setdefault(row["node"], []).append((row["cell"], row["bytes"]))
            for first, state in list(open_nodes.items()):
                below, end = 0, None
                for number, size in sorted(cells.get(first, [])):
                    if below + size >= state["want"]:
                        end = (number, size)
                        break
                    below += size
                if end is None:
                    bounds[first] = state["high"]
                elif end[1] <= close or step[first] == 1:
                    after = state["want"] - below > end[1] / 2
                    bounds[first] = state["low"] + step[first] * (end[0] + after)
                else:
                    at = state["low"] + step[first] * end[0]
                    open_nodes[first] = {"low": at, "high": min(at + step[first], state["high"]), "want": state["want"] - below}
                    continue
                del open_nodes[first]
        sides, nodes = {}, dict(self.nodes)
        for first, bound in bounds.items():
            count = nodes[first]
            right = first + count // 2
            nodes[first], nodes[right] = count // 2, count - count // 2
            sides[first] = F.when(key >= bound, right).otherwise(first)
        self.nodes = nodes
        return lineage.cut(points.withColumn("node", _per_node(sides, F.col("node"))), "shard-level")


def kd_shards(docs, shards=16):
    """Put ``docs`` (doc_id, text, source, lang) into shards 0 to shards - 1 of
    nearly equal bytes; returns doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A size is the text's UTF-8 bytes plus 1, a null text counts as empty. Null ids,
    sources and languages are values like others (id: the smallest). Equal texts share
    a shard unless they fill more than half of one. Repeated rows are kept. An empty
    table gives no rows. Other columns are not read."""
    rows = lineage.cut(_rows(docs), "shard-rows")
    total = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max("size").alias("size")).first()
    target = (total["bytes"] or 0) / shards
    groups = lineage.cut(
        rows.groupBy("text_key").agg(
            F.sum("size").alias("bytes"),
            F.coalesce(_scaled(F.min("doc_id"), total["low"], total["high"]), F.lit(0)).alias("at_id"),
            _scaled(F.log(F.max("size").cast("double")), 0, _log(total["size"])).alias("at_size"),
            F.shiftright(F.crc32(F.min("source").cast("binary")), 1).alias("at_source"),
            F.shiftright(F.crc32(F.min("lang").cast("binary")), 1).alias("at_lang"),
            F.shiftrightunsigned(F.xxhash64("text_key"), 64 - _BITS).alias("at_text"),
        ),
        "shard-groups",
    )
    # at most shards / HEAVY_SHARE groups
    heavy = {row["text_key"]: row["bytes"] for row in groups.filter(F.col("bytes") > target * HEAVY_SHARE).select("text_key", "bytes").collect()}
    pieces = {key: int(-(-size // (target * HEAVY_SHARE))) for key, size in heavy.items() if size > target * PIECE_SHARE}
    spark = docs.sparkSession
    heavy_keys = spark.createDataFrame([(key, pieces.get(key, 1)) for key in heavy], "text_key string, pieces int")
    marked = rows.join(F.broadcast(heavy_keys), "text_key", "left").withColumn(
        "piece", F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int")).otherwise(F.when(F.col("pieces") == 1, 0))
    )
    units = [tuple(row) for row in marked.filter("pieces is not null").groupBy("text_key", "piece").agg(F.sum("size")).collect()] if heavy else []
    lack, place = _place_heavy(units, shards, target)
    tree, light = _Tree(shards, lack), groups.filter(F.col("bytes") <= target * HEAVY_SHARE).withColumn("node", F.lit(0))
    while any(count > 1 for count in tree.nodes.values()):
        light = tree.split_level(light, max(1.0, target * CUT_SHARE))
    leaves = light.select("text_key", F.col("node").alias("leaf"))
    places = spark.createDataFrame(place, "text_key string, piece int, heavy_shard int")
    sharded = lineage.cut(
        marked.drop("pieces")
        .join(F.broadcast(places), ["text_key", "piece"], "left")
        .join(leaves, "text_key", "left")
        .select("doc_id", "size", "text_crc32", "row", F.coalesce("heavy_shard", "leaf").cast("int").alias("shard")),
        "sharded",
    )
    return _slots(sharded, total["rows"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _log(size):
    return math.log(size) if size else 1.0


def _slots(sharded, rows):
    """Number each shard's rows from 0: a shard's rows are dealt to blocks of about
    ``SLOT_ROWS``, numbered inside a block, after the rows of earlier blocks."""
    blocks = sharded.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(max(1, rows // SLOT_ROWS))))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.groupBy("shard", "block").count().select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "block").orderBy("doc_id", "row")
    return blocks.withColumn("place", F.row_number().over(within) - 1).join(starts, ["shard", "block"]).withColumn("slot", F.col("first") + F.col("place"))
