"""Near-duplicate vectors by an exact range join in cosine distance.

Pivots cut the unit sphere into cells, a vector's home being its nearest pivot's.
If x at home in cell i and y at home in cell h have cosine t or more, the
triangle inequality bounds how far y can lie beyond the plane between the two
pivots: y . (p_h - p_i) / |p_h - p_i| <= sqrt(1 - t^2). So y is also sent to each
cell i before its own that it is that near to, and every pair of links meets in
exactly one cell. Cells join on their own; a large cell is dealt to blocks, and a
task holds two of them. Inside, blocks whose distances to the pivot lie further
apart than linked vectors can are not multiplied.

Equal vectors are one class with a count. A task reports, for each of its classes,
how many vectors it links to and the smallest class of its links' component, so
neither pairs of a group nor all links of a class ever become rows.
"""

import numpy as np
from pyspark.sql import functions as F

from ledgerlark.llm.common import arrow_schema, batch, groups, lists, matrix
from ledgerlark.llm.components import components
from ledgerlark.llm.vectors import padded, usable
from ledgerlark.plans import lineage

#: Pivots, and rows that they are chosen from; neither changes a result.
PIVOTS, PIVOT_SAMPLE = 16, 2048
#: Vectors of a cell on each side of a task, and rows multiplied at once.
BLOCK, STEP = 8192, 512
_SLACK = 1e-9


def _unit(vectors):
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def choose_pivots(sample, count):
    """Far apart: each next pivot is the row furthest from those before it."""
    if not len(sample):
        return np.zeros((0, 0))
    unit = _unit(sample)
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < min(count, len(unit)):
        furthest = int(nearest.argmin())
        if nearest[furthest] > 1 - _SLACK:
            break
        chosen.append(furthest)
        nearest = np.maximum(nearest, unit @ unit[furthest])
    return unit[chosen]


def _cells(classes, pivots, threshold):
    """class, n, vector, cell, away (1 for a copy sent across a border), gap (distance to the cell's pivot)."""
    out = "class long, cell long, away long, gap double"
    apart = np.sqrt(np.maximum(0, ((pivots[:, None] - pivots[None]) ** 2).sum(axis=2)))
    reach = np.sqrt(1 - threshold * threshold) + _SLACK

    def assign(batches):
        for records in batches:
            if not records.num_rows:
                continue
            unit = _unit(matrix(records.column("vector")))
            near = unit @ pivots.T
            home = near.argmax(axis=1)
            own = near[np.arange(len(home)), home]
            beyond = own[:, None] - near
            sent = (beyond <= reach * apart[home]) & (np.arange(len(pivots))[None] < home[:, None])
            row, cell = np.nonzero(sent)
            number = np.array(lists(records, "class")[0])
            everyone = np.concatenate([np.arange(len(home)), row])
            cells = np.concatenate([home, cell])
            gap = np.sqrt(np.maximum(0, 2 - 2 * near[everyone, cells]))
            yield batch(arrow_schema(out), number[everyone], cells, (np.arange(len(cells)) >= len(home)).astype(int), gap)

    return classes.select("class", "vector").mapInArrow(assign, out)


def _merge(root, left, right):
    """Join the components of ``left`` and ``right`` in ``root``, an array of smallest members."""
    pairs = np.unique(np.stack([root[left], root[right]]), axis=1)
    parent = {}

    def top(x):
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    for a, b in pairs.T.tolist():
        a, b = top(a), top(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    if parent:
        moved = np.arange(len(root))
        for x in parent:
            moved[x] = top(x)
        root[:] = moved[root]


def _links_of_block(vectors, gap, counts, left, right, same, threshold):
    """Links of the rows ``left`` with the rows ``right``: for each row how many vectors
    it links to, and the smallest row of its component."""
    links, root = np.zeros(len(vectors), dtype=np.int64), np.arange(len(vectors))
    unit = _unit(vectors)
    norm = np.sqrt((vectors * vectors).sum(axis=1))
    width = np.sqrt(2 - 2 * threshold) + _SLACK
    left, right = left[np.argsort(gap[left], kind="stable")], right[np.argsort(gap[right], kind="stable")]
    ordered = gap[right]
    for at in range(0, len(left), STEP):
        rows = left[at : at + STEP]
        low, high = np.searchsorted(ordered, [gap[rows[0]] - width, gap[rows[-1]] + width], side="left")
        for start in range(int(low), int(high), BLOCK):
            others = right[start : min(start + BLOCK, int(high))]
            near = unit[rows] @ unit[others].T
            i, j = np.nonzero(near >= threshold - 1e-12)
            if not len(i):
                continue
            value, i, j = near[i, j], rows[i], others[j]
            keep = value >= threshold
            for k in np.flatnonzero(np.abs(value - threshold) < 1e-12):
                keep[k] = np.dot(vectors[i[k]], vectors[j[k]]) / (norm[i[k]] * norm[j[k]]) >= threshold
            if same:
                keep &= i < j
            i, j = i[keep], j[keep]
            if len(i):
                np.add.at(links, i, counts[j])
                np.add.at(links, j, counts[i])
                _merge(root, i, j)
    return links, root


def near_vectors(vectors, threshold=0.9, pivots=PIVOTS, block=BLOCK):
    """Links of ``vectors`` (vec_id, embedding) with cosine >= threshold: one row a
    vector with vec_id, n_links, component_id, kept. The threshold lies between 0 and 1.

    Null, zero and empty vectors and those with null or non-finite parts link with
    nothing. Shorter vectors count as filled up with zeros. Rows with one vec_id, or
    with none, stay vectors of their own; a component's id is its smallest vec_id
    that isn't null. An empty table gives no rows. Other columns are not read."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
    square = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    linked = F.coalesce(usable(rows) & (square > 0) & (square < float("inf")), F.lit(False))
    marked = lineage.cut(rows.select("vec_id", F.when(linked, F.col("embedding")).alias("embedding")), "vectors")
    whole, _ = padded(marked.filter("embedding is not null"))
    whole = whole.select("vec_id", F.col("embedding").alias("vector"), F.xxhash64("embedding").alias("part"))
    classes = lineage.cut(
        whole.groupBy("part", "vector").agg(F.count("*").alias("n"), F.min("vec_id").alias("least_id")).withColumn("class", F.monotonically_increasing_id()), "vector-classes"
    )
    sample = classes.select("vector", "class").orderBy(F.xxhash64("class"), "class").limit(PIVOT_SAMPLE).collect()
    centres = choose_pivots(np.array([row["vector"] for row in sample], dtype=float), pivots)
    result = "class long, links long, root long"
    if len(centres):
        placed = lineage.cut(_cells(classes, centres, threshold), "cells")
        counts = placed.groupBy("cell").agg(F.count(F.when(F.col("away") == 0, 1)).alias("homes"), F.sum("away").alias("away_rows"))
        # one row a pivot
        counts = counts.select("cell", F.ceil(F.col("homes") / block).cast("int").alias("home_blocks"), F.ceil(F.col("away_rows") / block).cast("int").alias("away_blocks"))
        own = F.pmod(F.xxhash64("class"), F.greatest("home_blocks", F.lit(1))).cast("int")
        foreign = F.col("home_blocks") + F.pmod(F.xxhash64("class"), F.greatest("away_blocks", F.lit(1))).cast("int")
        partners = F.when(F.col("away") == 0, F.col("home_blocks") + F.col("away_blocks")).otherwise(F.col("home_blocks"))
        dealt = (
            placed.join(F.broadcast(counts), "cell")
            .filter("home_blocks > 0")
            .withColumn("own", F.when(F.col("away") == 0, own).otherwise(foreign))
            .withColumn("other", F.explode(F.sequence(F.lit(0), partners - 1)))
            .select("cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "class", "gap")
            .join(classes.select("class", "n", "vector"), "class")
        )

        def compare(batches):
            for (_, low, high), unit in groups(batches, ["cell", "low", "high"], ["own", "class", "gap", "n", "vector"]):
                own, number, gap, n = (unit.column(name).to_numpy() for name in ("own", "class", "gap", "n"))
                left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
                if len(left) and len(right):
                    links, root = _links_of_block(matrix(unit.column("vector")), gap, n, left, right, low == high, threshold)
                    found = np.flatnonzero(links)
                    yield batch(arrow_schema(result), number[found], links[found], number[root[found]])

        by = ["cell", "low", "high"]
        found = lineage.cut(dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(compare, result), "vector-links")
    else:
        found = vectors.sparkSession.createDataFrame([], result)
    labels = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    totals = found.groupBy("class").agg(F.sum("links").alias("links"))
    known = classes.join(totals, "class", "left").join(labels.withColumnRenamed("node", "class"), "class", "left")
    known = known.select("part", "vector", "least_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "class").alias("root"))
    roots = known.groupBy("root").agg(F.min("least_id").alias("component"))
    named = known.join(roots, "root").select("part", "vector", "links", "component")
    alone = marked.filter("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return (
        whole.join(named, ["part", "vector"])
        .select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
        .union(alone)
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
