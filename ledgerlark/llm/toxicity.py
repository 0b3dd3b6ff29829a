"""Toxicity by a factorization machine over hashed terms.

The log-odds of a text are a bias, a weight for each of its terms, and for each
pair of its terms the product of their factor vectors, so that an insult next to a
group's name can weigh more than the two alone. The pairs are summed by the square
of the sum less the sum of squares, linear in the terms.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerlark.llm import terms
from ledgerlark.llm.common import arrow_schema, batch, lists, pieces

#: Factors of a term, passes over the sample, rows a step, step size, penalties.
FACTORS, PASSES, STEP_ROWS, RATE, PENALTY, PAIR_PENALTY = 4, 12, 128, 0.15, 1e-4, 1e-3
#: Part of each term's own log-odds that its weight starts from.
START = 0.3


class Machine:
    """Bias, weights and factors; fit() learns them from rows of places and 0/1 labels."""

    def __init__(self, size, factors=FACTORS, seed=7):
        self.bias, self.weight = 0.0, np.zeros(size)
        self.factor = np.random.default_rng(seed).normal(0, 0.02, (size, factors))

    def margin(self, flat, starts):
        sums = terms.row_sums(self.factor[flat], starts)
        squares = terms.row_sums((self.factor[flat] ** 2).sum(axis=1), starts)
        linear = terms.row_sums(self.weight[flat], starts)
        return self.bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def score(self, flat, starts):
        return 1 / (1 + np.exp(-np.clip(self.margin(flat, starts)[0], -30, 30)))

    def fit(self, rows, labels, passes=PASSES, seed=7):
        labels = np.asarray(labels, dtype=float)
        share = labels.mean()
        self.bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        flat, starts = terms.joined(rows)
        owner = np.repeat(labels, np.diff(starts))
        with_term = [np.bincount(flat, weight, len(self.weight)) for weight in (owner, 1 - owner)]
        self.weight = START * (np.log((with_term[0] + 0.5) / (labels.sum() + 1)) - np.log((with_term[1] + 0.5) / ((1 - labels).sum() + 1)))
        random = np.random.default_rng(seed)
        seen_bias, seen_weight, seen_factor = 1.0, np.ones_like(self.weight), np.ones_like(self.factor)
        for _ in range(passes):
            order = random.permutation(len(rows))
            for at in range(0, len(order), STEP_ROWS):
                chosen = order[at : at + STEP_ROWS]
                flat, starts = terms.joined([rows[k] for k in chosen])
                margin, sums = self.margin(flat, starts)
                error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[chosen]
                owner = np.repeat(np.arange(len(chosen)), np.diff(starts))
                places, inverse = np.unique(flat, return_inverse=True)
                grad_weight = np.bincount(inverse, error[owner], len(places)) + PENALTY * len(chosen) * self.weight[places]
                pulled = error[owner, None] * (sums[owner] - self.factor[flat])
                grad_factor = np.stack([np.bincount(inverse, pulled[:, f], len(places)) for f in range(pulled.shape[1])], axis=1)
                grad_factor += PAIR_PENALTY * len(chosen) * self.factor[places]
                seen_bias += error.sum() ** 2
                seen_weight[places] += grad_weight**2
                seen_factor[places] += grad_factor**2
                self.bias -= RATE * error.sum() / np.sqrt(seen_bias)
                self.weight[places] -= RATE * grad_weight / np.sqrt(seen_weight[places])
                self.factor[places] -= RATE * grad_factor / np.sqrt(seen_factor[places])
        return self


def held_out_fold(column="doc_id"):
    """Whether a document's labels may not be learnt from: crc32(doc_id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs, labels, most=terms.LABELLED):
    """(buckets, machine) from at most ``most`` labelled rows outside the held-out fold."""
    known = labels.filter(~held_out_fold()).filter("toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label"))
    buckets, rows, sizes = terms.choose(terms.labelled_terms(docs, known, most=most), [0, 1])
    machine = Machine(len(buckets))
    if rows:
        machine.fit([places for places, _ in rows], [label for _, label in rows])
    elif sizes:
        machine.bias = 30.0 if 1 in sizes else -30.0
    else:
        machine.bias = -30.0
    return buckets, machine


def _scores(buckets, machine):
    """The scores of a list of texts, for a task."""
    known = terms.Terms(buckets)
    return lambda texts: machine.score(*terms.joined([sorted(known.of(text or "")) for text in texts]))


def keep_below(docs, model, at_least=0.7):
    """The rows of ``docs``, with all their columns, that score below ``at_least``. Rows are
    judged where they are; nothing is shuffled."""

    def keep(batches):
        scores = _scores(*model)
        for records in pieces(batches):
            yield records.filter(pa.array(scores(lists(records, "text")[0]) < at_least))

    return docs.mapInArrow(keep, docs.schema)


def score(docs, model, at_least=0.7):
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text)."""
    out = "doc_id long, score double"

    def judge(batches):
        scores = _scores(*model)
        for records in pieces(batches):
            ids, texts = lists(records, "doc_id", "text")
            yield batch(arrow_schema(out), ids, scores(texts))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(judge, out).select("doc_id", held_out_fold().alias("held_out"), "score", (F.col("score") >= at_least).cast("int").alias("predicted"))


def toxicity(docs, labels, most=terms.LABELLED, at_least=0.7):
    """Score ``docs`` (doc_id, text) after learning from ``labels`` (doc_id, toxic).

    A null or empty text has no terms and gets the bias alone. A null id is in no fold;
    repeated rows are scored each. Labels other than 0 and 1 don't count, of several
    for one id the highest does. Without labels the scores are near 0, with labels of
    one class near that class. An empty table gives no rows. Other columns are not read."""
    return score(docs, fit(docs, labels, most), at_least)
