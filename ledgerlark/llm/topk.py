"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are grouped by length into buckets whose lengths differ by a twentieth at
most; a bucket is dealt to blocks. Every query starts from a score that k candidates of
a bounded seed reach (the longest ones and a hashed sample), so the seed decides how
much is pruned, never what is found. For a query of length |q| and a block whose
longest vector has length l, a candidate counts only if its cosine reaches
score / (|q| l), the local threshold:

* above 1 the block is skipped; by the longest vector of its bucket the query is not even
  sent there, nor a candidate to queries that its length cannot serve;
* high thresholds prune by coordinates: on the query's largest coordinates, a unit
  vector of such a cosine lies in a known interval;
* low ones prune by length: of the candidates in falling length, a prefix remains.

What remains is verified by exact integer products.
"""

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlark.llm.common import arrow_schema, batch, groups, matrix
from ledgerlark.llm.vectors import padded, usable
from ledgerlark.plans import lineage

#: Ratio of lengths inside a bucket; candidates and queries that a task holds.
RATIO, BLOCK, QUERIES = 1.05, 8192, 4096
#: Candidates in the seed, half of them the longest.
SEED = 2048
#: Local thresholds from here on prune by coordinates, and by this many of them.
BY_COORDINATE, COORDINATES = 0.6, 4
_EXACT = 2.0**53
RESULT = "query_id long, rank int, vec_id long, score long"
_SLACK = 1e-9


def products(left, right):
    """Exact integer products of rows of whole numbers, as Python or 64-bit integers."""
    bound = np.sqrt((left * left).sum(axis=1)).max(initial=0) * np.sqrt((right * right).sum(axis=1)).max(initial=0)
    if bound < _EXACT:
        return (left @ right.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in left], dtype=object) @ np.array([[int(x) for x in row] for row in right], dtype=object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _in_reach(query, unit, threshold):
    """Candidates (unit vectors) whose parts on the query's largest coordinates allow the
    cosine ``threshold``: their angle to an axis is the query's own, plus or minus arccos."""
    keep, angle = np.ones(len(unit), dtype=bool), math.acos(threshold)
    for f in np.argsort(-np.abs(query))[:COORDINATES]:
        own = math.acos(min(1.0, max(-1.0, query[f])))
        low, high = math.cos(min(math.pi, own + angle)), math.cos(max(0.0, own - angle))
        keep &= (unit[:, f] >= low - _SLACK) & (unit[:, f] <= high + _SLACK)
    return keep


def _best(scores, ids, k):
    """Places of the k best: highest score, then smallest id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= least)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))][:k]


def _search(queries, floor, query_ids, candidates, ids, k):
    """For each query the places and scores of the k best candidates that reach its floor."""
    length = np.sqrt((candidates * candidates).sum(axis=1))
    order = np.argsort(-length, kind="stable")
    candidates, ids, length = candidates[order], ids[order], length[order]
    unit = candidates / np.where(length > 0, length, 1)[:, None]
    size = np.sqrt((queries * queries).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(floor == -np.inf, -np.inf, np.where(size * length[0] > 0, floor / (size * length[0]), np.where(floor > 0, np.inf, -np.inf)))
    wanted = np.flatnonzero(local <= 1 + _SLACK)
    by_coordinate = wanted[local[wanted] >= BY_COORDINATE]
    by_length = wanted[local[wanted] < BY_COORDINATE]
    for q in by_coordinate:
        keep = np.flatnonzero(_in_reach(queries[q] / size[q], unit, min(1.0, local[q])))
        if len(keep):
            yield q, ids[keep], products(queries[q : q + 1], candidates[keep])[0]
    for at in range(0, len(by_length), 256):
        rows = by_length[at : at + 256]
        # negative floors hold for all lengths
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(floor[rows] > 0, floor[rows] / size[rows], 0)
        stop = int(np.searchsorted(-length, -need.min() * (1 - _SLACK), side="right"))
        scores = products(queries[rows], candidates[:stop])
        for q, row in zip(rows, scores):
            yield q, ids[:stop], row


def _in_reach_of(need, length):
    """Whether vectors of a length reach a need: a floor by the query's length."""
    return need <= length * (1 + _SLACK)


def _need():
    return F.when(F.col("floor") <= 0, F.lit(0.0)).when(F.col("length") > 0, F.col("floor") / F.col("length")).otherwise(float("inf"))


def _needs(floors, parts):
    """The least need among the queries of each part."""
    least = {row["part"]: row["need"] for row in floors.groupBy("part").agg(F.min(_need()).alias("need")).collect()}
    return [least.get(part, math.inf) for part in range(parts)]


def _asking(floors, sizes):
    """Queries dealt to the blocks of the buckets whose longest vector reaches their need;
    ``sizes`` has one row for each ratio of lengths."""
    buckets = F.array(*[F.struct(*[F.lit(row[name]).alias(name) for name in ("bucket", "blocks", "longest")]) for row in sizes])
    return (
        floors.withColumn("own", F.explode(buckets))
        .filter(_in_reach_of(_need(), F.col("own.longest")))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("own.blocks") - 1)))
        .select("part", "own.bucket", "block", F.lit(1).alias("asks"), "vec_id", "row", "floor", "vector")
    )


def _offered(stored, sizes, needs):
    """Candidates dealt to a block of their bucket, once for each part of the queries with a
    need, out of ``needs``, that their length reaches."""
    return (
        stored.join(F.broadcast(sizes), "bucket")
        .select("*", F.posexplode(F.array(*[F.lit(float(need)) for need in needs])).alias("part", "need"))
        .filter(_in_reach_of(F.col("need"), F.col("length")))
        .select("part", "bucket", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("asks"), "vec_id", "row", F.lit(0.0).alias("floor"), "vector")
    )


def top_products(vectors, k=10, every=100, scale=1024):
    """For each query, a row of ``vectors`` (vec_id, embedding) whose id is divisible by
    ``every``, the k rows with the highest inner products: query_id, rank, vec_id, score.
    Parts count as floor(scale x part); rows with the query's own id are no candidates;
    ties go to the smaller id. Scores beyond 64 bits end at their limits.

    Rows without an id and null, empty or non-finite vectors take no part. Shorter vectors
    count as filled up with zeros. A query with fewer candidates gets them all. Repeated
    rows are candidates each; rows that share a query's id are queries each. An empty
    table gives no rows. Other columns are not read."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull())
    whole, _ = padded(rows.filter(usable(rows)))
    # floor() of a double would end at 64 bits; what is larger is whole already
    part = lambda x: F.when(F.abs(x * scale) < float(1 << 52), F.floor(x * scale).cast("double")).otherwise(x * scale)
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    stored = lineage.cut(
        whole.select("vec_id", F.transform("embedding", part).alias("vector"))
        .withColumn("length", F.sqrt(square))
        .withColumn("bucket", F.when(F.col("length") > 0, F.floor(F.log("length") / math.log(RATIO)).cast("int")).otherwise(-100_000))
        .withColumn("row", F.monotonically_increasing_id()),
        "whole-vectors",
    )
    sizes = stored.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.max("length").alias("longest"))
    queries = stored.filter(F.col("vec_id") % every == 0)
    parts = max(1, math.ceil(queries.count() / QUERIES))
    longest = stored.orderBy(F.desc("length"), "row").limit(SEED // 2)
    sampled = stored.orderBy(F.xxhash64("row"), "row").limit(SEED // 2)
    seed = longest.union(sampled).select("vec_id", "vector", "row").dropDuplicates(["row"]).collect()
    seed_ids = np.array([row["vec_id"] for row in seed], dtype=np.int64)
    seed_vectors = np.array([row["vector"] for row in seed], dtype=float)
    asked = "vec_id long, row long, part int, floor double"

    def begin(batches):
        for records in batches:
            if not records.num_rows:
                continue
            ids, own = records.column("vec_id").to_numpy(), matrix(records.column("vector"))
            floor = np.full(len(ids), -np.inf)
            scores = products(own, seed_vectors)
            for q in range(len(ids)):
                rest = scores[q][seed_ids != ids[q]]
                if len(rest) >= k:
                    floor[q] = float(np.partition(rest, len(rest) - k)[len(rest) - k])
            yield batch(arrow_schema(asked), ids, records.column("row"), records.column("part"), floor)

    if not seed:
        return vectors.sparkSession.createDataFrame([], RESULT)
    floors = queries.select("vec_id", "row", "vector", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part")).mapInArrow(begin, asked)
    floors = lineage.cut(floors.join(queries.select("row", "length", "vector"), "row"), "query-floors")
    asking, offered = _asking(floors, sizes.collect()), _offered(stored, sizes, _needs(floors, parts))
    out = "query_row long, query_id long, vec_id long, score long"

    def search(batches):
        for _, unit in groups(batches, ["part", "bucket", "block"], ["asks", "vec_id", "row", "floor", "vector"]):
            asks, ids, row, floor = (unit.column(name).to_numpy() for name in ("asks", "vec_id", "row", "floor"))
            own, rest = np.flatnonzero(asks == 1), np.flatnonzero(asks == 0)
            if not len(own) or not len(rest):
                continue
            values = matrix(unit.column("vector"))
            for q, found, scores in _search(values[own], floor[own], ids[own], values[rest], ids[rest], k):
                keep = (found != ids[own[q]]) & (scores >= floor[own[q]])
                found, scores = found[keep], scores[keep]
                best = _best(scores, found, k)
                n = len(best)
                yield batch(arrow_schema(out), np.full(n, row[own[q]]), np.full(n, ids[own[q]]), found[best], scores[best])

    by = ["part", "bucket", "block"]
    found = asking.union(offered).repartition(*by).sortWithinPartitions(*by).mapInArrow(search, out)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
