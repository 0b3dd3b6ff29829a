"""Random forests on all rows, grown node by node where the rows of a node fit one task.

Features are cut into at most ``BINS`` bins of equal counts, found by exact running counts over all
rows. Every tree draws its own weights of the rows (Poisson of mean 1) and every node its own
features, both by hashes: the trees depend neither on partitions nor on row order. A node with more
than ``NODE_ROWS`` rows is split by counts that tasks add up; the rows of any other go to one task,
which grows all that is below. Splits lower the Gini impurity most; a node that no split of its
features makes purer is a leaf.

Trees are rows of a stored table and never meet on the driver, which gets their depths, sizes and
gains. Scoring deals blocks of rows and groups of trees over a grid of tasks. Values of leaves are
whole multiples of 1 / ``UNIT``, so that their sums do not depend on the grid.
"""

from math import ceil, exp, sqrt

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import functions as F

from ledgerlark.operators import boosting
from ledgerlark.plans.lineage import cut

#: Bins of a feature; codes are bytes.
BINS = 255
#: Weights of rows that one task grows a node of.
NODE_ROWS = 1 << 20
#: Rows that one task scores, bytes of rows that it grows nodes of, and bytes of trees that it scores by.
SCORED_ROWS, GROWN_BYTES, TREE_BYTES = 1 << 19, 32 << 20, 16 << 20
#: Rows of one block of sums.
BLOCK_ROWS = 1 << 16
#: Tasks for each core, as trees and nodes differ in size.
SHARE = 4
#: Leaf values are whole multiples of 1 / UNIT.
UNIT = 1 << 30
#: What stands for the feature of a leaf, and of a node that another task grew.
LEAF, ELSEWHERE = -1, -2
#: Column whose values tell rows apart for the weights, besides their features and label.
KEY = "customer_id"

PIECES = "tree int, root bigint, feature binary, cut binary, value binary, elsewhere binary, depth int, gains array<double>"

_M64 = (1 << 64) - 1


# ---- chance ----------------------------------------------------------------------


def _mixed(numbers):
    """Well mixed bits of an array of unsigned 64-bit numbers."""
    numbers = (numbers ^ (numbers >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    numbers = (numbers ^ (numbers >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return numbers ^ (numbers >> np.uint64(31))


def _stream(seed, tree, use):
    """The number that sets one use of one tree apart."""
    start = int(_mixed(np.array([seed & _M64], dtype=np.uint64))[0]) + (2 * tree + use + 1) * 0x9E3779B97F4A7C15
    return _mixed(np.array([start & _M64], dtype=np.uint64))[0]


def _poisson_limits():
    limits, share, upto = [], exp(-1.0), 0.0
    for count in range(20):
        upto += share
        share /= count + 1
        limits.append(min(int(upto * 2.0**64), _M64))
    return np.array(limits, dtype=np.uint64)


_LIMITS = _poisson_limits()


def weights(hashes, seed, tree):
    """How often a tree draws each row: Poisson of mean 1, by the row's hash."""
    return np.searchsorted(_LIMITS, _mixed(hashes ^ _stream(seed, tree, 0)), side="right").astype(np.uint8)


def picked(ids, seed, tree, features, take):
    """The features that each node may split by, a row for each of its ids."""
    numbers = ids.astype(np.uint64)[:, None] * np.uint64(features) + np.arange(features, dtype=np.uint64)
    return np.argsort(_mixed(numbers ^ _stream(seed, tree, 1)), axis=1, kind="stable")[:, :take]


# ---- splits ----------------------------------------------------------------------

#: Weight of a row by its byte (weight * 2 + label), with that of label 1 in the high half.
_BOTH = np.array([(b >> 1) | ((b >> 1) * (b & 1) << 32) for b in range(256)], dtype=np.int64)
_LOW = (1 << 32) - 1


def _purity(left, left_ones, rows, ones, least):
    """What splits win, as a multiple of n^2 / 2 of the Gini impurity; 0 for those that win nothing or leave too few rows."""
    right = rows - left
    cross = (left_ones * rows - ones * left).astype(float)
    win = cross * cross / (np.maximum(left, 1).astype(float) * np.maximum(right, 1))
    return np.where((left >= least) & (right >= least), win, 0.0)


def _best_splits(codes, drawn, node, rows, ones, picks, least):
    """For each node the win, feature, bin, and left rows and ones of its best split. ``node`` has the number of each row's."""
    nodes, features = len(rows), codes.shape[1]
    found = [np.zeros(nodes)] + [np.zeros(nodes, dtype=np.int64) for _ in range(4)]
    before, before_ones = np.cumsum(rows) - rows, np.cumsum(ones) - ones
    flat, place = codes.reshape(-1), np.arange(0, codes.size, features)
    kind = np.uint32 if nodes <= 1 << 16 else np.uint64  # short keys sort faster
    low, byte = (node << 16 | drawn).astype(kind), kind(8)
    for draw in range(picks.shape[1]):
        feature = picks[:, draw]
        keys = low | flat.take(place + feature.take(node)).astype(kind) << byte
        keys.sort()
        cells = keys >> byte
        ends = np.flatnonzero(cells[1:] != cells[:-1])
        upto = np.cumsum(_BOTH.take(keys.astype(np.uint8))).take(ends)
        after, cells = cells.take(ends + 1).astype(np.int64) >> 8, cells.take(ends).astype(np.int64)
        inner = np.flatnonzero(after == cells >> 8)  # no split leaves all rows on one side
        if not len(inner):
            continue
        upto, cells = upto.take(inner), cells.take(inner)
        owner = cells >> 8
        left, left_ones = (upto & _LOW) - before.take(owner), (upto >> 32) - before_ones.take(owner)
        win = _purity(left, left_ones, rows.take(owner), ones.take(owner), least)
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        most, owners = np.maximum.reduceat(win, first), owner.take(first)
        at = np.flatnonzero(win == np.repeat(most, np.diff(np.append(first, len(win)))))
        at = at[np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])]
        better = most > found[0].take(owners)
        owners, at = owners[better], at[better]
        for values, new in zip(found, (win[at], feature[owners], cells[at] & 255, left[at], left_ones[at])):
            values[owners] = new
    return found


def _values(ones, rows, share):
    """Shares of label 1 in units of 1 / ``UNIT``; ``share`` where there are no rows."""
    known = np.maximum(rows, 1)
    return np.where(rows > 0, (2 * ones * UNIT + known) // (2 * known), share).astype(np.int32)


def grown(codes, drawn, root, seed, tree, take, least, depth, share):
    """All nodes from ``root`` down, level by level: features, bins of the splits, values of the leaves,
    the deepest level and what each feature won. Rows are their codes and bytes (weight * 2 + label)."""
    features = codes.shape[1]
    drawn = drawn.astype(np.int64)
    both = int(_BOTH.take(drawn).sum())
    ids, rows, ones = np.array([root], dtype=np.int64), np.array([both & _LOW]), np.array([both >> 32])
    node, level, gains = np.zeros(len(drawn), dtype=np.int64), root.bit_length() - 1, np.zeros(features)
    kinds, cuts, values = [], [], []
    while len(ids):
        kind = np.full(len(ids), LEAF, dtype=np.int8)
        mixed = (ones > 0) & (ones < rows) & (rows >= 2 * least) & (level < depth)
        opened = np.flatnonzero(mixed)
        # the rows of nodes that are leaves by now have no more say
        inside = np.flatnonzero(mixed.take(node))
        codes, drawn, node = codes.take(inside, axis=0), drawn.take(inside), (np.cumsum(mixed) - 1).take(node.take(inside))
        picks = picked(ids[opened], seed, tree, features, take)
        win, feature, bound, left, left_ones = _best_splits(codes, drawn, node, rows[opened], ones[opened], picks, least)
        split = win > 0
        kind[opened[split]] = feature[split]
        kinds.append(kind)
        cuts.append(bound[split].astype(np.uint8))
        values.append(_values(ones[kind == LEAF], rows[kind == LEAF], share))
        gains += np.bincount(feature[split], weights=2 * win[split] / rows[opened[split]], minlength=features)
        inside = np.flatnonzero(split.take(node))
        codes, drawn, node = codes.take(inside, axis=0), drawn.take(inside), node.take(inside)
        code = codes.reshape(-1).take(np.arange(0, codes.size, features) + feature.take(node))
        node = 2 * (np.cumsum(split) - 1).take(node) + (code > bound.take(node))
        parents, left, left_ones = opened[split], left[split], left_ones[split]
        ids = np.column_stack([2 * ids[parents], 2 * ids[parents] + 1]).reshape(-1)
        rows = np.column_stack([left, rows[parents] - left]).reshape(-1)
        ones = np.column_stack([left_ones, ones[parents] - left_ones]).reshape(-1)
        level += 1
    return np.concatenate(kinds), np.concatenate(cuts), np.concatenate(values), level - 1, gains


# ---- large nodes -----------------------------------------------------------------


class _Top:
    """The nodes of a tree that are too large for one task: splits by id, leaves, and ids left to be grown."""

    def __init__(self, rows, ones):
        self.splits, self.leaves, self.opened, self.gains = {}, {}, {1: (rows, ones)}, {}

    def nodes_of(self, codes):
        """The id of the open node or leaf that each row is in."""
        ids = np.ones(len(codes), dtype=np.int64)
        if not self.splits:
            return ids
        known = np.array(sorted(self.splits))
        feature, bound = np.array([self.splits[i] for i in known.tolist()]).T
        moving = np.arange(len(codes))
        while len(moving):
            at = np.minimum(np.searchsorted(known, ids[moving]), len(known) - 1)
            inside = known[at] == ids[moving]
            moving, at = moving[inside], at[inside]
            ids[moving] = 2 * ids[moving] + (codes[moving, feature[at]] > bound[at])
        return ids

    def piece(self, tree, features, share):
        """The nodes as a row of the table of trees."""
        kinds, cuts, values, elsewhere, depth, queue = [], [], [], [], 0, [1]
        for node in queue:  # grows on the way
            depth = max(depth, node.bit_length() - 1)
            if node in self.splits:
                feature, bound = self.splits[node]
                kinds.append(feature)
                cuts.append(bound)
                queue += [2 * node, 2 * node + 1]
            elif node in self.leaves:
                kinds.append(LEAF)
                rows, ones = self.leaves[node]
                values.append(int(_values(np.array([ones]), np.array([rows]), share)[0]))
            else:
                kinds.append(ELSEWHERE)
                elsewhere.append(node)
        gains = [float(self.gains.get(k, 0.0)) for k in range(features)]
        return _row(tree, 0, np.array(kinds), np.array(cuts), np.array(values), np.array(elsewhere), depth, gains)


def _row(tree, root, kinds, cuts, values, elsewhere, depth, gains):
    return (
        tree, int(root), kinds.astype(np.int8).tobytes(), cuts.astype(np.uint8).tobytes(), values.astype(np.int32).tobytes(),
        elsewhere.astype(np.int64).tobytes(), int(depth), [float(g) for g in gains],
    )


def _split_large(blocks, tops, large, features, seed, take, least):
    """Split the ``large`` nodes, ``{tree: ids}``, one level down by counts over all blocks."""
    tops_now = {tree: tops[tree] for tree in large}

    def counted(block):
        codes, labels, hashes = block
        for tree, nodes in large.items():
            known = np.array(sorted(nodes))
            drawn = weights(hashes, seed, tree)
            at = tops_now[tree].nodes_of(codes)
            number = np.minimum(np.searchsorted(known, at), len(known) - 1)
            mine = np.flatnonzero((known[number] == at) & (drawn > 0))
            number, weight, ones = number[mine], drawn[mine], drawn[mine] * labels[mine]
            picks, counts = picked(known, seed, tree, features, take), np.zeros((len(known), take, 2, 256), dtype=np.int64)
            for draw in range(take):
                cells = number << 8 | codes[mine, picks[number, draw]]
                for kind, sums in enumerate((weight, ones)):
                    counts[:, draw, kind] = np.bincount(cells, weights=sums, minlength=len(known) << 8).reshape(-1, 256)
            for node, own in zip(known.tolist(), counts):
                yield (tree, node), own

    def chosen(entry):
        (tree, node), counts = entry
        upto = counts.cumsum(axis=2)
        left, left_ones = upto[:, 0], upto[:, 1]
        rows, ones = int(left[0, -1]), int(left_ones[0, -1])
        win = _purity(left, left_ones, np.full(left.shape, rows), np.full(left.shape, ones), least)
        draw, bound = divmod(int(win.argmax()), 256)
        feature = int(picked(np.array([node]), seed, tree, features, take)[0, draw])
        return tree, node, feature, bound, float(win[draw, bound]), rows, ones, int(left[draw, bound]), int(left_ones[draw, bound])

    # one split for each large node
    for tree, node, feature, bound, win, rows, ones, left, left_ones in blocks.flatMap(counted).reduceByKey(np.add).map(chosen).collect():
        top = tops[tree]
        del top.opened[node]
        if win <= 0:
            top.leaves[node] = (rows, ones)
            continue
        top.splits[node] = (feature, bound)
        top.gains[feature] = top.gains.get(feature, 0.0) + 2 * win / rows
        top.opened |= {2 * node: (left, left_ones), 2 * node + 1: (rows - left, ones - left_ones)}


# ---- fitting ---------------------------------------------------------------------


def _blocks(dataset, features, edges, label):
    """Rows as blocks of bytes: codes, labels and hashes."""
    bounds = [np.array(edges[name]) for name in edges]
    told_apart = [F.col(KEY)] if KEY in dataset.columns else []
    columns = [features[k].alias(name) for k, name in enumerate(edges)]
    rows = dataset.select(F.col(label).cast("int").alias("label"), F.xxhash64(*told_apart, features, label).alias("hash"), *columns)
    names = list(edges)

    def pack(frames):
        for frame in frames:
            codes = boosting._codes(frame[names].to_numpy(dtype=float), bounds)
            labels, hashes = frame["label"].to_numpy(dtype=np.uint8), frame["hash"].to_numpy(dtype=np.int64)
            yield pd.DataFrame({"codes": [codes.tobytes()], "labels": [labels.tobytes()], "hashes": [hashes.tobytes()]})

    return rows.mapInPandas(pack, "codes binary, labels binary, hashes binary")


def fit_forest(dataset, features, label, trees, depth, take, least, seed, bins=BINS):
    """The edges of the bins and the table of trees of a forest on all rows; ``features`` is an array column."""
    spark = dataset.sparkSession
    total, wrong, ones, width = dataset.agg(
        F.count(F.lit(1)), F.count_if(F.col(label).isNull() | ~F.col(label).isin(0.0, 1.0)), F.sum(label), F.max(F.size(features))
    ).first()
    if not total or wrong:
        raise ValueError(f"a forest needs rows with labels 0 and 1: {total} rows, {wrong} of them with another label")
    names = [f"f{k}" for k in range(width)]
    take, share = take(width), round(ones / total * UNIT)
    edges = boosting.bin_edges(dataset.select(*[features[k].alias(name) for k, name in enumerate(names)]), names, bins)
    stored = cut(_blocks(dataset, features, edges, label), "forest-rows")

    def opened(row):
        codes = np.frombuffer(row.codes, dtype=np.uint8).reshape(-1, width)
        return codes, np.frombuffer(row.labels, dtype=np.uint8), np.frombuffer(row.hashes, dtype=np.uint64)

    blocks = stored.rdd.map(opened)
    tops = {tree: _Top(total, int(ones)) for tree in range(trees)}
    for level in range(depth):
        large = {tree: [node for node, (rows, _) in top.opened.items() if rows > NODE_ROWS] for tree, top in tops.items()}
        large = {tree: nodes for tree, nodes in large.items() if nodes}
        if not large:
            break
        _split_large(blocks, tops, large, width, seed, take, least)

    places = [(tree, node) for tree, top in tops.items() for node in top.opened]
    numbers = {place: number for number, place in enumerate(places)}
    weighed = sum(rows for top in tops.values() for rows, _ in top.opened.values())
    tasks = max(SHARE * spark.sparkContext.defaultParallelism, ceil(weighed * (width + 1) / GROWN_BYTES))
    tasks = max(1, min(tasks, len(places)))

    def dealt(block):
        codes, labels, hashes = block
        for tree, top in tops.items():
            drawn = weights(hashes, seed, tree)
            hit = np.flatnonzero(drawn)
            mine, drawn = codes[hit], (drawn[hit] << 1 | labels[hit])
            at = top.nodes_of(mine)
            for node in np.unique(at).tolist() if top.splits else [1]:
                if (tree, node) in numbers:
                    inside = at == node
                    yield numbers[tree, node], (mine[inside].tobytes(), drawn[inside].tobytes())

    def grow(task, records):
        held = {}
        for number, parts in records:
            held.setdefault(number, []).append(parts)
        for number in range(task, len(places), tasks):
            tree, node = places[number]
            parts = held.pop(number, [])
            codes = np.frombuffer(b"".join(part[0] for part in parts), dtype=np.uint8).reshape(-1, width)
            drawn = np.frombuffer(b"".join(part[1] for part in parts), dtype=np.uint8)
            kinds, cuts, values, deepest, gains = grown(codes, drawn, node, seed, tree, take, least, depth, share)
            yield _row(tree, node, kinds, cuts, values, np.array([]), deepest, gains)

    pieces = blocks.flatMap(dealt).partitionBy(tasks, lambda number: number % tasks).mapPartitionsWithIndex(grow)
    table = spark.createDataFrame(pieces, PIECES)
    large = [top.piece(tree, width, share) for tree, top in tops.items() if 1 not in top.opened]
    if large:
        table = table.unionByName(spark.createDataFrame(large, PIECES))
    return [edges[name] for name in names], cut(table, "forest")


class ForestClassifier(RandomForestClassifier):
    """The library's settings of a forest of two classes; the fit is that of this module. Other settings than
    those of the trees, bins, features, columns and seed are refused, as the fit would not follow them."""

    def _fit(self, dataset):
        strategies = {"sqrt": lambda width: ceil(sqrt(width)), "all": lambda width: width}
        followed = {
            "numTrees", "maxDepth", "minInstancesPerNode", "maxBins", "seed", "cacheNodeIds", "featureSubsetStrategy",
            "featuresCol", "labelCol", "predictionCol", "probabilityCol", "rawPredictionCol",
        }
        others = [param.name for param in self.params if param.name not in followed and self.isSet(param)]
        if others or self.getFeatureSubsetStrategy() not in strategies or not 2 <= self.getMaxBins() <= BINS:
            raise ValueError(f"settings that the forest does not follow: {others or [self.getFeatureSubsetStrategy(), self.getMaxBins()]}")
        edges, pieces = fit_forest(
            dataset, vector_to_array(self.getFeaturesCol()), self.getLabelCol(), self.getNumTrees(), self.getMaxDepth(),
            strategies[self.getFeatureSubsetStrategy()], self.getMinInstancesPerNode(), self.getSeed(), self.getMaxBins(),
        )
        return self._copyValues(ForestModel(edges, pieces))


# ---- scoring ---------------------------------------------------------------------


def _walkable(pieces):
    """A tree as one array: the left child, the right one being next to it, the bin and the feature of each node, a leaf
    being its own left child; values; and the levels to walk. ``pieces`` are (root, feature, cut, value, elsewhere, depth)."""
    nodes, values, first, open_nodes, start = [], [], {}, [], 0
    for root, feature, bound, value, elsewhere, _ in pieces:
        kinds = np.frombuffer(feature, dtype=np.int8)
        inner = kinds >= 0
        left = np.arange(start, start + len(kinds))
        left[inner] = start + 1 + 2 * np.arange(np.count_nonzero(inner))
        bounds = np.full(len(kinds), 255, dtype=np.int64)
        bounds[inner] = np.frombuffer(bound, dtype=np.uint8)
        nodes.append(left << 16 | bounds << 8 | np.where(inner, kinds, 0))
        held = np.zeros(len(kinds), dtype=np.int64)
        held[kinds == LEAF] = np.frombuffer(value, dtype=np.int32)
        values.append(held)
        first[root] = start
        open_nodes += zip((start + np.flatnonzero(kinds == ELSEWHERE)).tolist(), np.frombuffer(elsewhere, dtype=np.int64).tolist())
        start += len(kinds)
    nodes, values = np.concatenate(nodes), np.concatenate(values)
    for node, root in open_nodes:
        nodes[node], values[node] = nodes[first[root]], values[first[root]]
        if nodes[node] >> 16 == first[root]:  # a leaf is its own child
            nodes[node] = node << 16 | 255 << 8
    return nodes, values, first.get(0, first.get(1)), max(piece[5] for piece in pieces)


def _leaf_values(codes, pieces):
    """The value of the leaf that each row of codes ends in."""
    nodes, values, root, levels = _walkable(pieces)
    flat, place = codes.reshape(-1), np.arange(0, codes.size, codes.shape[1])
    node = np.full(len(codes), root, dtype=np.int64)
    for _ in range(levels):
        here = nodes.take(node)
        node = (here >> 16) + (flat.take(place + (here & 255)) > (here >> 8 & 255))
    return values.take(node)


def _sums(table, row, edges, pieces, trees, tree_bytes):
    """Sums of leaf values for each row of the stored ``table``: columns ``row`` and ``votes``."""
    spark = table.sparkSession
    bounds = [np.array(values) for values in edges]
    names = [f"f{k}" for k in range(len(edges))]
    stripes = max(1, ceil(table.count() / SCORED_ROWS))
    groups = min(trees, max(ceil(tree_bytes / TREE_BYTES), ceil(SHARE * spark.sparkContext.defaultParallelism / stripes)))

    def pack(frames):
        for frame in frames:
            codes = boosting._codes(frame[names].to_numpy(dtype=float), bounds)
            yield pd.DataFrame({"ids": [frame["row"].to_numpy(dtype=np.int64).tobytes()], "codes": [codes.tobytes()]})

    packed = table.select(F.col(row).alias("row"), *names).mapInPandas(pack, "ids binary, codes binary")

    def rows_dealt(numbered):
        block, number = numbered
        stripe = number % stripes
        return [(group * stripes + stripe, (None, bytes(block.ids), bytes(block.codes))) for group in range(groups)]

    def trees_dealt(piece):
        held = (piece.tree, piece.root, bytes(piece.feature), bytes(piece.cut), bytes(piece.value), bytes(piece.elsewhere), piece.depth)
        return [(piece.tree % groups * stripes + stripe, held) for stripe in range(stripes)]

    def scored(cell, records):
        ids, codes, held = [], [], {}
        for _, record in records:
            if record[0] is None:
                ids.append(record[1])
                codes.append(record[2])
            else:
                held.setdefault(record[0], []).append(record[1:])
        ids = np.frombuffer(b"".join(ids), dtype=np.int64)
        order = np.argsort(ids)
        codes = np.frombuffer(b"".join(codes), dtype=np.uint8).reshape(-1, len(bounds))[order]
        ids, votes = ids[order], np.zeros(len(ids), dtype=np.int64)
        while held:
            votes += _leaf_values(codes, held.popitem()[1])
        for start in range(0, len(ids), BLOCK_ROWS):
            yield (cell % stripes, start), (ids[start : start + BLOCK_ROWS], votes[start : start + BLOCK_ROWS])

    cells = spark.sparkContext.union([packed.rdd.zipWithIndex().flatMap(rows_dealt), pieces.rdd.flatMap(trees_dealt)])
    summed = (
        cells.partitionBy(groups * stripes, lambda cell: cell)
        .mapPartitionsWithIndex(scored)
        .reduceByKey(lambda a, b: (a[0], a[1] + b[1]), max(1, min(stripes * SHARE, groups * stripes)))
        .map(lambda entry: (entry[1][0].tobytes(), entry[1][1].tobytes()))
    )

    def unpack(frames):
        for frame in frames:
            for ids, votes in zip(frame["ids"], frame["votes"]):
                yield pd.DataFrame({row: np.frombuffer(ids, dtype=np.int64), "votes": np.frombuffer(votes, dtype=np.int64)})

    return spark.createDataFrame(summed, "ids binary, votes binary").mapInPandas(unpack, f"{row} bigint, votes bigint")


class _Tree:
    def __init__(self, depth, nodes):
        self.depth, self.numNodes = depth, nodes


class ForestModel(Model, HasFeaturesCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, MLWritable, MLReadable):
    """A fitted forest: edges of the bins, and a stored table of its trees."""

    def __init__(self, edges, pieces):
        super().__init__()
        self.edges, self.pieces = edges, pieces
        sizes = [F.octet_length(F.col(name)).alias(name) for name in ("feature", "cut", "value", "elsewhere")]
        found = pieces.select("tree", "root", *sizes, "depth", "gains").collect()  # no nodes
        count = 1 + max(row.tree for row in found)
        depths, nodes, gains = [0] * count, [0] * count, np.zeros((count, len(edges)))
        for row in sorted(found, key=lambda row: (row.tree, row.root)):
            depths[row.tree] = max(depths[row.tree], row.depth)
            nodes[row.tree] += row.feature - row.elsewhere // 8
            gains[row.tree] += row.gains
        self.trees = [_Tree(*pair) for pair in zip(depths, nodes)]
        self._bytes = sum(row.feature + row.cut + row.value + row.elsewhere for row in found)
        # each tree counts the same
        sums = gains.sum(axis=1, keepdims=True)
        shares = np.divide(gains, sums, out=np.zeros_like(gains), where=sums > 0).sum(axis=0)
        self.featureImportances = Vectors.dense(shares / shares.sum() if shares.sum() else shares)

    @property
    def getNumTrees(self):
        return len(self.trees)

    @property
    def totalNumNodes(self):
        return sum(tree.numNodes for tree in self.trees)

    def _transform(self, dataset):
        """The rows are stored under numbers of their own, scored over a grid of tasks, and joined to the stored sums."""
        row, kept = "_forest_row", dataset.columns
        stored = cut(dataset.withColumn(row, F.monotonically_increasing_id()), "forest-input")
        features = vector_to_array(self.getFeaturesCol())
        inputs = stored.select(row, *[features[k].alias(f"f{k}") for k in range(len(self.edges))])
        sums = cut(_sums(inputs, row, self.edges, self.pieces, len(self.trees), self._bytes), "forest-votes")
        one, all_votes = F.col("votes"), len(self.trees) * UNIT
        share = one / F.lit(float(all_votes))
        return stored.join(sums, row).select(
            *[F.col(f"`{name}`") for name in kept],
            array_to_vector(F.array(F.lit(float(len(self.trees))) - one / F.lit(float(UNIT)), one / F.lit(float(UNIT)))).alias(self.getRawPredictionCol()),
            array_to_vector(F.array(1.0 - share, share)).alias(self.getProbabilityCol()),
            F.when(2 * one > all_votes, 1.0).otherwise(0.0).alias(self.getPredictionCol()),
        )

    def write(self):
        return _ForestWriter(self)

    @classmethod
    def read(cls):
        return _ForestReader()


class _ForestWriter(MLWriter):
    def __init__(self, model):
        super().__init__()
        self.model = model

    def saveImpl(self, path):
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"edges": self.model.edges})
        self.model.pieces.write.parquet(f"{path}/trees")


class _ForestReader(MLReader):
    def load(self, path):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = ForestModel(metadata["edges"], self.sparkSession.read.schema(PIECES).parquet(f"{path}/trees"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
