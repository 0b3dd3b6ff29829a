"""Boosted trees of the second order on distributed histograms.

Features are cut into at most ``BINS`` bins of equal counts, found by exact running counts. A
fit keeps blocks of rows (bin codes, label, hash, margins); each level of a tree is one
aggregation of gradient and hessian sums by node, for the features and bins that it may split by.
Tasks meet by node, choose its split, and only that reaches the driver. Rows that one task holds
grow a whole tree there. Several fits that differ in settings or rows grow in lockstep, so
a sweep over settings and folds costs the jobs of its deepest fit.

Gradients are rounded to 2^-30 and summed as whole numbers: the trees depend neither on the
order of rows nor on how they are partitioned. A tree samples rows by a hash of the customer
and columns by its number, a child needs a least hessian sum, and nulls go to the side that gains more.

Margins are written to the shared folder every ``STORED_EVERY`` trees, so that a lost
executor costs at most that many additions of a tree.
"""

import json
import random
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.functions import ranking
from ledgerlark.plans.lineage import cut

#: Bins of a feature that has values, and the code of a null.
BINS, MISSING = 255, 255
#: Gradients are whole multiples of 1 / UNIT; up to 2^33 rows a histogram cell then fit in 64 bits.
UNIT = 1 << 30
#: Squared-weight penalty on leaf values.
PENALTY = 1.0
#: Gains below this are no split.
LEAST_GAIN = 1e-6
STORED_EVERY = 50
#: Rows that one task sums; a level of a tree is so short that smaller tasks cost more than they share.
TASK_ROWS = 1 << 17
#: Nodes whose splits one task chooses.
TASK_NODES = 8
_M32 = (1 << 32) - 1


# ---- bins ----------------------------------------------------------------------


def bin_edges(table, names, bins=BINS):
    """The upper bounds of each feature's bins but the last: ``{name: rising floats}``.

    A value belongs to bin ``ceil(bins * rows up to it / rows)``; bins that no value ends in
    do not exist. Rows are counted by value, the counts cut into ranges, and running totals taken
    over ranges and inside them.
    """
    entries = [F.struct(F.lit(name).alias("name"), F.col(name).cast("double").alias("value")) for name in names]
    values = table.select(F.inline(F.array(*entries))).where("value is not null")
    counted = ranking.in_ranges(values.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n")), "name", "value")
    sums = counted.groupBy("name", "range").agg(F.sum("n").alias("range_n"))
    before = Window.partitionBy("name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each feature and range
    ranges = sums.select(
        F.col("name").alias("of"),
        F.col("range").alias("in_range"),
        F.coalesce(F.sum("range_n").over(before), F.lit(0)).alias("below"),
        F.sum("range_n").over(Window.partitionBy("name")).alias("rows"),
    )
    inside = Window.partitionBy("name", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    upto = counted.withColumn("upto", F.sum("n").over(inside)).join(ranges, (F.col("name") == F.col("of")) & (F.col("range") == F.col("in_range")))
    place = F.call_function("div", (F.col("below") + F.col("upto")) * F.lit(bins) + F.col("rows") - 1, F.col("rows"))
    ends = upto.groupBy("name", place.alias("place")).agg(F.max("value").alias("value"))
    found = {name: [] for name in names}
    for row in ends.collect():  # at most ``bins`` a feature
        found[row.name].append(row.value)
    return {name: sorted(values)[:-1] for name, values in found.items()}


def _codes(values, edges):
    """Bin codes of a matrix of feature values; NaN is a null."""
    codes = np.empty(values.shape, dtype=np.uint8)
    for k, bounds in enumerate(edges):
        codes[:, k] = np.searchsorted(bounds, values[:, k], side="left")
    codes[np.isnan(values)] = MISSING
    return codes


def _blocks(table, part, names, edges, label, key, seed):
    """Rows as blocks of bytes: codes, labels and hashes of some thousand rows each."""
    bounds = [np.array(edges[name]) for name in names]
    columns = [F.col(name).cast("double").alias(f"f{k}") for k, name in enumerate(names)]
    rows = table.select(F.col(label).cast("int").alias("label"), ranking.portable_hash(F.col(key), seed).alias("hash"), *columns)

    def pack(frames):
        for frame in frames:
            codes = _codes(frame[[f"f{k}" for k in range(len(names))]].to_numpy(dtype=float), bounds)
            labels, hashes = frame["label"].to_numpy(dtype=np.int8), frame["hash"].to_numpy(dtype=np.uint32)
            yield pd.DataFrame({"part": [part], "codes": [codes.tobytes()], "labels": [labels.tobytes()], "hashes": [hashes.tobytes()]})

    return rows.mapInPandas(pack, "part int, codes binary, labels binary, hashes binary")


# ---- trees ---------------------------------------------------------------------


class Tree:
    """Nodes as lists; node 0 is the root. A row goes left if its value is at most ``threshold``
    (its code at most ``bin``), and with a null if ``null_left``. ``cover`` is the hessian sum."""

    FIELDS = ("feature", "bin", "threshold", "null_left", "left", "right", "value", "cover", "gain")

    def __init__(self, **fields):
        for name in self.FIELDS:
            setattr(self, name, fields.get(name, []))

    def add(self, value, cover):
        for name, item in zip(self.FIELDS, (-1, 0, 0.0, False, 0, 0, value, cover, 0.0)):
            getattr(self, name).append(item)
        return len(self.value) - 1

    def split(self, node, found, threshold):
        self.feature[node], self.bin[node], self.null_left[node] = found["feature"], found["bin"], found["null_left"]
        self.threshold[node], self.gain[node] = threshold, found["gain"]
        self.left[node], self.right[node] = (self.add(side["value"], side["hessian"]) for side in found["sides"])
        return self.left[node], self.right[node]

    @property
    def depth(self):
        depths = [0] * len(self.value)
        for node, feature in enumerate(self.feature):
            if feature >= 0:
                depths[self.left[node]] = depths[self.right[node]] = depths[node] + 1
        return max(depths)

    def _walk(self, columns, bounds, null, rows):
        feature, bounds = np.array(self.feature), np.array(bounds)
        null_left, left, right = np.array(self.null_left), np.array(self.left), np.array(self.right)
        node, every = np.zeros(rows, dtype=np.int64), np.arange(rows)
        for _ in range(self.depth):
            inner = feature[node] >= 0
            value = columns[every, np.maximum(feature[node], 0)]
            go_left = np.where(null(value), null_left[node], value <= bounds[node])
            node = np.where(inner, np.where(go_left, left[node], right[node]), node)
        return node

    def nodes_of_codes(self, codes):
        return self._walk(codes, self.bin, lambda value: value == MISSING, len(codes))

    def nodes_of_values(self, values):
        return self._walk(values, self.threshold, np.isnan, len(values))


def _leaf(gradient, hessian, rate):
    return -rate * gradient / (hessian + PENALTY)


def best_split(sums, columns, config):
    """The split of largest gain of one node, or None. ``sums``: gradient and hessian by
    (feature, bin), nulls in the last bin; ties go to the first column, the lowest bin, nulls left."""
    gradient, hessian = sums[0] / UNIT, sums[1] / UNIT
    total = gradient[columns[0]].sum(), hessian[columns[0]].sum()
    best = None
    for feature in columns:
        null = gradient[feature, MISSING], hessian[feature, MISSING]
        below = np.cumsum(gradient[feature, :MISSING]), np.cumsum(hessian[feature, :MISSING])
        for null_left in (True, False):
            left = (below[0] + null[0], below[1] + null[1]) if null_left else below
            right = total[0] - left[0], total[1] - left[1]
            fits = (left[1] >= config["min_child"]) & (right[1] >= config["min_child"])
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = left[0] ** 2 / (left[1] + PENALTY) + right[0] ** 2 / (right[1] + PENALTY) - total[0] ** 2 / (total[1] + PENALTY)
            gain = np.where(fits, gain, -np.inf)
            place = int(np.argmax(gain))
            if gain[place] > max(LEAST_GAIN, best["gain"] if best else 0.0):
                sides = [{"value": _leaf(g[place], h[place], config["rate"]), "hessian": float(h[place])} for g, h in (left, right)]
                best = {"feature": feature, "bin": place, "null_left": null_left, "gain": float(gain[place]), "sides": sides}
    return best


def tree_columns(config, number, features, seed):
    """The columns that a tree may split by."""
    wanted = max(1, int(config.get("columns", 0.8) * features))
    return sorted(random.Random(seed * 1_000_003 + number).sample(range(features), wanted))


def row_sample(number):
    """Factor and offset of the hash that samples a tree's rows, modulo 2^32."""
    draw = random.Random(number)
    return draw.randrange(1 << 32) | 1, draw.randrange(1 << 32)


def _sampled(hashes, number, share):
    factor, offset = row_sample(number)
    mixed = (hashes.astype(np.uint64) * np.uint64(factor) + np.uint64(offset)) & np.uint64(_M32)
    return mixed < np.uint64(int(share * (1 << 32)))


def histograms(codes, labels, margins, sampled, nodes, slots, features):
    """Gradient sums, hessian sums and rows by (slot, feature, bin) as whole numbers. ``nodes`` is the
    node of each row, ``slots`` the place of each node in the result, -1 for those not grown."""
    slot = np.asarray(slots)[nodes]
    used = np.flatnonzero(sampled & (slot >= 0))
    probability = 1.0 / (1.0 + np.exp(-margins[used]))
    gradient = np.rint((probability - labels[used]) * UNIT)
    hessian = np.rint(probability * (1.0 - probability) * UNIT)
    size = (max(slots) + 1) * 256
    found = np.empty((max(slots) + 1, 3, features, 256), dtype=np.int64)
    for k in range(features):
        place = slot[used] * 256 + codes[used, k]
        for kind, weights in enumerate((gradient, hessian, None)):
            found[:, kind, k] = np.bincount(place, weights, size).astype(np.int64).reshape(-1, 256)
    return found


class _Fit:
    """One model while it grows; ``place`` is its row of margins in the blocks of ``part``."""

    def __init__(self, name, part, place, config, base, edges, seed):
        self.name, self.part, self.place, self.config, self.base, self.edges, self.seed = name, part, place, config, base, edges, seed

    def start(self, number):
        self.tree, self.open = Tree(), [0]
        self.tree.add(0.0, 0.0)
        self.columns = tree_columns(self.config, number, len(self.edges), self.seed)

    def wish(self):
        """What a task needs to sum for this model."""
        slots = [-1] * len(self.tree.value)
        for slot, node in enumerate(self.open):
            slots[node] = slot
        return self.part, self.place, self.tree, slots, self.config.get("rows", 0.8)

    def grow(self, choices):
        following = []
        for (gradient, hessian, found), node in zip(choices, self.open):
            if node == 0:
                self.tree.value[0], self.tree.cover[0] = _leaf(gradient, hessian, self.config["rate"]), hessian
            if found:
                bounds = self.edges[found["feature"]]  # the last bin has none: all values part from the nulls
                threshold = bounds[found["bin"]] if found["bin"] < len(bounds) else float("inf")
                following += self.tree.split(node, found, threshold)
        self.open = following


def choose(sums, columns, config):
    """Gradient and hessian of one node, and its best split, of sums by (kind, column, bin)."""
    gradient, hessian = (float(sums[kind, 0].sum()) / UNIT for kind in (0, 1))
    found = best_split(sums, range(len(columns)), config)
    return gradient, hessian, found and {**found, "feature": columns[found["feature"]]}


def _grown(fits, choices_of):
    """One more tree of each fit, level by level; ``choices_of`` gives ``choose`` for the nodes of a level."""
    for level in range(max(fit.config["depth"] for fit in fits)):
        asked = [fit for fit in fits if fit.open and level < fit.config["depth"]]
        if asked:
            choices = choices_of(asked)
            for k, fit in enumerate(asked):
                fit.grow([choices[k, slot] for slot in range(len(fit.open))])
    return [fit.tree for fit in fits]


def _sum_blocks(blocks, wishes, number, features):
    found = {}
    for part, codes, labels, hashes, margins in blocks:
        for k, (of, place, tree, slots, share) in enumerate(wishes):
            if of == part:
                sums = histograms(codes, labels, margins[place], _sampled(hashes, number, share), tree.nodes_of_codes(codes), slots, features)
                found[k] = found[k] + sums if k in found else sums
    yield found


def _node_sums(blocks, wishes, columns, number, features):
    """``((model, slot), sums)`` of a task's rows: gradients and hessians of the columns a tree may split by."""
    for k, sums in next(_sum_blocks(blocks, wishes, number, features)).items():
        for slot, node in enumerate(sums):
            yield (k, slot), node[:2, columns[k]]


def _asked(fits):
    return [fit.wish() for fit in fits], [fit.columns for fit in fits], [fit.config for fit in fits]


def _grown_here(blocks, fits, number, features):
    def choices(asked):
        wishes, columns, configs = _asked(asked)
        return {key: choose(sums, columns[key[0]], configs[key[0]]) for key, sums in _node_sums(blocks, wishes, columns, number, features)}

    return _grown(fits, choices)


def _grown_apart(state, fits, number, features, tasks):
    """The same on rows of several tasks: sums meet by node, where its split is chosen."""

    def choices(asked):
        wishes, columns, configs = _asked(asked)
        nodes = sum(len(fit.open) for fit in asked)
        parts = state.mapPartitions(lambda blocks: _node_sums(blocks, wishes, columns, number, features))
        sums = parts.reduceByKey(np.add, min(tasks, -(-nodes // TASK_NODES)))
        return dict(sums.map(lambda pair: (pair[0], choose(pair[1], columns[pair[0][0]], configs[pair[0][0]]))).collect())

    return _grown(fits, choices)


def _merged(left, right):
    for k, sums in right.items():
        left[k] = left[k] + sums if k in left else sums
    return left


def _with_trees(blocks, trees):
    for part, codes, labels, hashes, margins in blocks:
        margins = margins.copy()
        for of, place, tree in trees:
            if of == part:
                margins[place] += np.array(tree.value)[tree.nodes_of_codes(codes)]
        yield part, codes, labels, hashes, margins


def _stored(spark, state, features, tasks):
    """Margins written with their rows; later jobs read them instead of adding trees again."""
    rows = state.map(lambda b: (b[0], b[1].tobytes(), b[2].tobytes(), b[3].tobytes(), b[4].tobytes()))
    frame = spark.createDataFrame(rows, "part int, codes binary, labels binary, hashes binary, margins binary")
    return _opened(cut(frame, "margins").coalesce(tasks), features, None)


def _opened(frame, features, bases):
    """Stored blocks as arrays; without margins they begin at each model's base."""

    def block(row):
        codes = np.frombuffer(bytes(row.codes), dtype=np.uint8).reshape(-1, features)
        if bases is None:
            margins = np.frombuffer(bytes(row.margins), dtype=np.float64).reshape(-1, len(codes))
        else:
            margins = np.repeat(np.array(bases[row.part])[:, None], len(codes), axis=1)
        return row.part, codes, np.frombuffer(bytes(row.labels), dtype=np.int8), np.frombuffer(bytes(row.hashes), dtype=np.uint32), margins

    return frame.rdd.map(block)


def fit_boosted(parts, configs, names, label="churned", key="customer_id", seed=42, task_rows=TASK_ROWS):
    """Boosted models ``{(part, config): (base margin, trees, edges)}`` of every table in ``parts`` with
    every setting in ``configs`` (trees, depth, rate, min_child), grown in lockstep.

    ``names`` are numeric columns; nulls are a value of their own. Labels are 0 and 1.
    """
    fits, models, bases, frames, rows = {}, {}, {}, [], 0
    for part, (part_name, table) in enumerate(parts.items()):
        share, size = table.agg(F.avg(F.col(label).cast("double")), F.count(F.lit(1))).first()
        if share is None:
            raise ValueError("no rows to fit")
        rows += size
        inside = min(max(share, 1e-6), 1 - 1e-6)
        base = float(np.log(inside / (1 - inside)))
        edges = bin_edges(table, names)
        bases[part] = [base] * len(configs)
        frames.append(_blocks(table, part, names, edges, label, key, seed))
        for place, (config_name, config) in enumerate(configs.items()):
            name = part_name, config_name
            models[name] = []
            fits[name] = _Fit(name, part, place, config, base, [edges[name] for name in names], seed)
    spark = frames[0].sparkSession
    tasks = -(-rows // task_rows)
    state = _opened(cut(reduce(lambda a, b: a.union(b), frames), "blocks").coalesce(tasks), len(names), bases).persist(StorageLevel.MEMORY_AND_DISK)
    held = [state]
    for number in range(max(config["trees"] for config in configs.values())):
        growing = [fit for fit in fits.values() if number < fit.config["trees"]]
        for fit in growing:
            fit.start(number)
        if tasks == 1:  # one task holds all rows and so all sums: it grows the whole tree in one job
            trees = state.mapPartitions(lambda blocks, g=growing, n=number: [_grown_here(list(blocks), g, n, len(names))]).first()
        else:
            trees = _grown_apart(state, growing, number, len(names), tasks)
        for fit, tree in zip(growing, trees):
            models[fit.name].append(tree)
        added = [(fit.part, fit.place, tree) for fit, tree in zip(growing, trees)]
        state = state.mapPartitions(lambda blocks, t=added: _with_trees(blocks, t))
        if (number + 1) % STORED_EVERY == 0:
            state = _stored(spark, state, len(names), tasks)
        held.append(state.persist(StorageLevel.MEMORY_AND_DISK))
        if len(held) > 2:
            held.pop(0).unpersist()
    for left in held:
        left.unpersist()
    return {name: (fit.base, models[name]) for name, fit in fits.items()}


def root_histogram(table, names, label="churned", key="customer_id", seed=42):
    """What the first tree's root sees: by feature and bin (null: -1) the rows in its sample, and the
    sums of gradients and hessians in units of 1 / ``UNIT``."""
    share = table.agg(F.avg(F.col(label).cast("double"))).first()[0]
    edges = bin_edges(table, names)
    blocks = _opened(_blocks(table, 0, names, edges, label, key, seed), len(names), {0: [float(np.log(share / (1 - share)))]})
    root = Tree()
    root.add(0.0, 0.0)
    wishes = [(0, 0, root, [0], 0.8)]
    sums = blocks.mapPartitions(lambda b: _sum_blocks(b, wishes, 0, len(names))).treeReduce(_merged)[0][0]
    rows = [
        (name, -1 if code == MISSING else code, *(int(sums[kind, k, code]) for kind in (2, 0, 1)))
        for k, name in enumerate(names)
        for code in np.flatnonzero(sums[2, k]).tolist()
    ]
    return table.sparkSession.createDataFrame(rows, "feature string, bin int, rows bigint, gradient bigint, hessian bigint")


# ---- models --------------------------------------------------------------------


class BoostedModel:
    """A fitted model: SQL texts that prepare its inputs, the base margin, and trees."""

    def __init__(self, expressions, base, trees):
        self.expressions, self.base, self.trees = expressions, base, trees

    @property
    def stages(self):
        return [self]

    @property
    def getNumTrees(self):
        return len(self.trees)

    def first(self, trees):
        """The model after that many trees."""
        return BoostedModel(self.expressions, self.base, self.trees[:trees])

    def prepare(self, df):
        """``df`` with the inputs as ``model_*`` columns."""
        return df.withColumns({f"model_{name}": F.expr(text).cast("double") for name, text in self.expressions.items()})

    def margins(self, values, after=None):
        """Margins of a matrix of inputs, NaN for null; ``after``: a column for each of these numbers of trees."""
        total, columns, wanted = np.full(len(values), self.base), {}, set(after or ())
        if 0 in wanted:
            columns[0] = total
        for number, tree in enumerate(self.trees, 1):
            total = total + np.array(tree.value)[tree.nodes_of_values(values)]
            if number in wanted:
                columns[number] = total
        return total if after is None else np.column_stack([columns[number] for number in after])

    def _scored(self, df, after):
        model, inputs = self, [f"model_{name}" for name in self.expressions]

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def probabilities(frame: pd.DataFrame) -> pd.Series:
            margins = model.margins(frame.to_numpy(dtype=float), after)
            return pd.Series(list(1.0 / (1.0 + np.exp(-margins))))

        return self.prepare(df).withColumn("probability", probabilities(F.struct(*inputs))).drop(*inputs)

    def transform(self, df):
        """``probability`` (of both classes) and ``prediction``, 1 above a half."""
        scored = self._scored(df, [len(self.trees)])
        one = F.col("probability")[0]
        return scored.withColumn("prediction", F.when(one > 0.5, 1.0).otherwise(0.0)).withColumn("probability", F.array(1 - one, one))

    def staged(self, df, after):
        """A row for each of ``df``'s and number of trees in ``after``: ``trees`` and the probability then."""
        pairs = F.arrays_zip(F.array(*[F.lit(number) for number in after]).alias("trees"), F.col("probability").alias("churn_probability"))
        return self._scored(df, list(after)).select(*df.columns, F.inline(pairs))

    def importances(self):
        """Each feature's mean gain, as a share."""
        gains, counts = np.zeros(len(self.expressions)), np.zeros(len(self.expressions))
        for tree in self.trees:
            for feature, gain in zip(tree.feature, tree.gain):
                if feature >= 0:
                    gains[feature] += gain
                    counts[feature] += 1
        means = np.divide(gains, counts, out=np.zeros_like(gains), where=counts > 0)
        return (means / means.sum() if means.sum() else means).tolist()

    def text(self):
        trees = [{name: getattr(tree, name) for name in Tree.FIELDS} for tree in self.trees]
        return json.dumps({"expressions": self.expressions, "base": self.base, "trees": trees})

    @classmethod
    def of_text(cls, text):
        stored = json.loads(text)
        return cls(stored["expressions"], stored["base"], [Tree(**tree) for tree in stored["trees"]])
