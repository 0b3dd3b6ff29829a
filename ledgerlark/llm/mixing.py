"""Mixing to target weights with soft membership of documents in domains.

A softmax classifier, fitted on the labelled rows, gives each document a posterior
over the domains, so a document adds a part of its tokens to each. Rates r >= floor
are fitted by projected gradients with momentum to minimise

    sum_d (sum_i a_i r_i p_id - t_d)^2 / (2 s_d)  +  rho / 2  sum_i a_i (r_i - 1)^2

where a_i is the document's part of all tokens, p_id its posterior and t_d the target
of the domain as a part of all tokens; the second term keeps rates near 1 where the
targets leave a choice. The gradient of a rate depends on the posterior alone, so
documents are first summed into cells of nearly equal posteriors, whose number a grid
bounds; a cell keeps its sums unrounded. An iteration is one sum over the cells;
a cell's rate is replayed from the residuals of all iterations, a short list, so
nothing is written in between and the documents get their rates by the same formula.
Tokens are counted with the vocabulary that the texts are packed with.
"""

import itertools
import logging

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.llm import terms
from ledgerlark.llm.common import lists, pieces
from ledgerlark.llm.tokens import Encoder, held
from ledgerlark.plans import lineage

#: Steps of a posterior's square root for the cells, iterations, weight of rates near 1.
GRID, ITERATIONS, NEAR_ONE = 256, 40, 1e-3
#: An end to the iterations: no domain's part of all tokens moves by more.
SETTLED = 1e-5
#: A domain that misses its weight by more is worth a warning.
MISS = 0.01
PASSES, STEP_ROWS, RATE, PENALTY = 8, 128, 0.3, 1e-3

#: Words of a worker's table, and their characters.
TABLE_WORDS, TABLE_CHARS = 400_000, 16_000_000

DOMAINS = ("low", "clean", "toxic")
VOCABULARY = "word_bpe_49k.json"


def domain_of_labels(labels):
    """``labels`` (doc_id, quality, toxic) as one domain a document: toxic, else by quality."""
    known = labels.filter("quality in (0, 1) or toxic in (0, 1)")
    one = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    number = F.when(F.col("toxic") == 1, DOMAINS.index("toxic")).when(F.col("quality") == 0, DOMAINS.index("low")).otherwise(DOMAINS.index("clean"))
    return one.select("doc_id", number.cast("int").alias("label"))


class Words:
    """of(texts): the number of each text's ids under a vocabulary and the places of its terms
    among ``buckets``, from one table of words that serves both.

    A blank-separated word that the table lacks is put together from what is known of its parts,
    which are far fewer. The different words of a piece of the rows are found by a dictionary encoding, so
    that each is looked up once. The table holds at most ``TABLE_WORDS`` words, or ``TABLE_CHARS``
    characters of them, before a piece of the rows; then the words that several pieces had stay,
    half a table at most, and the parts start anew. A worker keeps the table for its later tasks."""

    def __init__(self, path, buckets):
        self.encoder = Encoder(path)
        self.terms = terms.Terms(buckets, shapes=True)
        self.size = max(1, len(buckets))
        self.encoder.forget_counts()
        self._clear()

    def _clear(self):
        self.index, self.chars = {}, 0  # word: its row in the arrays
        self.counts, self.places, self.starts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)
        self.pieces = np.zeros(0, dtype=np.int32)  # pieces of the rows that had the word

    def _thin(self):
        """Keep the words of most pieces."""
        kept = np.flatnonzero(self.pieces > 1)
        kept = np.sort(kept[np.argsort(-self.pieces[kept], kind="stable")[: TABLE_WORDS // 2]])
        chosen = np.zeros(len(self.index), dtype=bool)
        chosen[kept] = True
        words = list(itertools.compress(self.index, chosen))
        chars, counts, starts, places = sum(map(len, words)), self.counts[kept], self.starts, self.places
        self._clear()
        if 2 * chars > TABLE_CHARS:
            return
        lengths = starts[kept + 1] - starts[kept]
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.places = places[np.arange(lengths.sum()) + np.repeat(starts[kept] - self.starts[:-1], lengths)]
        self.counts, self.chars, self.pieces = counts, chars, np.zeros(len(kept), dtype=np.int32)
        self.index = dict(zip(words, range(len(words))))

    def _learn(self, words):
        """Add words to the table."""
        counts = np.array(self.encoder.counts_of(words), dtype=np.int64)
        places = self.terms.places_of(words)
        first = len(self.index)
        self.chars += sum(map(len, words))
        self.pieces = np.concatenate([self.pieces, np.zeros(len(words), dtype=np.int32)])
        self.counts = np.concatenate([self.counts, counts])
        lengths = np.fromiter(map(len, places), dtype=np.int64, count=len(places))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        self.places = np.concatenate([self.places, np.fromiter(itertools.chain.from_iterable(places), dtype=np.int64, count=int(lengths.sum()))])
        self.index.update(zip(words, range(first, first + len(words))))

    def of(self, texts):
        """Numbers of ids, and the places of all texts one after another with where each text starts."""
        if not self.encoder.by_word:
            return [len(self.encoder._plain(text)) // 4 for text in texts], terms.joined([sorted(self.terms.of(text)) for text in texts])
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.index) > TABLE_WORDS or self.chars > TABLE_CHARS:
            self._thin()
        if max(len(self.terms.parts), len(self.encoder.part_counts)) > TABLE_WORDS:
            self.terms.parts.clear()
            self.encoder.forget_counts()
        rows = list(map(self.index.get, words))
        unknown = [k for k, row in enumerate(rows) if row is None]
        if unknown:
            first = len(self.index)
            self._learn([words[k] for k in unknown])
            for row, k in enumerate(unknown, first):
                rows[k] = row
        rows = np.array(rows, dtype=np.int64)
        self.pieces[rows] += 1
        row = rows[coded.indices.to_numpy()]
        owner = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
        counts = np.bincount(owner, self.counts[row], len(texts)).astype(np.int64)
        held = np.zeros((len(texts), self.size), dtype=bool)
        lengths = self.starts[row + 1] - self.starts[row]
        some = np.flatnonzero(lengths)
        row, owner, lengths = row[some], owner[some], lengths[some]
        offset = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        held[np.repeat(owner, lengths), self.places[np.repeat(self.starts[row], lengths) + offset]] = True
        for k, text in enumerate(texts):
            held[k, list(self.terms.shape_of(text))] = True
        owner, flat = np.nonzero(held)
        return counts, (flat, np.searchsorted(owner, np.arange(len(texts) + 1)))


class Softmax:
    """Log-linear posteriors over classes from places of terms."""

    def __init__(self, size, classes):
        self.weight, self.bias = np.zeros((size, classes)), np.zeros(classes)

    def posterior(self, flat, starts):
        margin = self.bias + terms.row_sums(self.weight[flat], starts)
        power = np.exp(margin - margin.max(axis=1, keepdims=True))
        return power / power.sum(axis=1, keepdims=True)

    def fit(self, rows, labels, seed=11):
        labels = np.eye(len(self.bias))[labels]
        self.bias = np.log((labels.sum(axis=0) + 0.5) / (len(labels) + 0.5 * len(self.bias)))
        random, seen, seen_bias = np.random.default_rng(seed), np.ones_like(self.weight), np.ones_like(self.bias)
        for _ in range(PASSES):
            order = random.permutation(len(rows))
            for at in range(0, len(order), STEP_ROWS):
                chosen = order[at : at + STEP_ROWS]
                flat, starts = terms.joined([rows[k] for k in chosen])
                error = self.posterior(flat, starts) - labels[chosen]
                owner = np.repeat(np.arange(len(chosen)), np.diff(starts))
                places, inverse = np.unique(flat, return_inverse=True)
                grad = np.stack([np.bincount(inverse, error[owner, c], len(places)) for c in range(error.shape[1])], axis=1)
                grad += PENALTY * len(chosen) * self.weight[places]
                seen[places] += grad**2
                seen_bias += error.sum(axis=0) ** 2
                self.weight[places] -= RATE * grad / np.sqrt(seen[places])
                self.bias -= RATE * error.sum(axis=0) / np.sqrt(seen_bias)
        return self


def fit_domains(docs, labels, most=terms.LABELLED):
    """(buckets, classifier) from at most ``most`` labelled rows (doc_id, label)."""
    classes = list(range(len(DOMAINS)))
    buckets, rows, sizes = terms.choose(terms.labelled_terms(docs, labels, shapes=True, most=most), classes)
    model = Softmax(len(buckets), len(DOMAINS))
    if rows:
        model.fit([places for places, _ in rows], [label for _, label in rows])
    elif sizes:
        model.bias = np.log([sizes.get(c, 0) + 0.5 for c in classes])
    return buckets, model


def _judged(rows, model, kept):
    """``rows`` (a column ``kept`` and text) with the text gone: ``kept``, n_tokens, and the
    posterior of each domain."""
    buckets, classifier = tuple(model[0]), model[1]
    path = public_tokenizers.path(VOCABULARY)
    names = [f"p_{name}" for name in DOMAINS]
    schema = T.StructType([rows.schema[kept], T.StructField("n_tokens", T.LongType()), *(T.StructField(name, T.DoubleType()) for name in names)])

    def judge(batches):
        known = held(Words, path, buckets)
        for records in pieces(batches):
            counts, places = known.of([text or "" for text in lists(records, "text")[0]])
            columns = [records.column(records.schema.get_field_index(kept)), pa.array(counts, pa.int64())]
            columns += [pa.array(part) for part in classifier.posterior(*places).T]
            yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    return rows.mapInArrow(judge, schema)


def posteriors(docs, model):
    """doc_id, n_tokens and p_<domain> for every row of ``docs`` (doc_id, text)."""
    return _judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, "doc_id")


def _parts():
    return [F.col(f"p_{name}") for name in DOMAINS]


def least_rate(floor):
    """A column: the lowest rate of a document, ``floor`` or, if that is a mapping, its
    entry for the document's main domain, 0 if it has none."""
    if not isinstance(floor, dict):
        return F.lit(float(floor))
    parts, found = _parts(), F.lit(0.0)
    for part, name in zip(parts, DOMAINS):
        found = F.when(part == F.greatest(*parts), F.lit(float(floor.get(name, 0)))).otherwise(found)
    return found


def rate(history, step, floor, near_one=NEAR_ONE):
    """A column: the rate that the iterations in ``history`` (pull for each domain, momentum)
    lead to for a document's posterior."""
    start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("before"))
    least = floor if isinstance(floor, Column) else least_rate(floor)
    if not history:
        return F.greatest(F.lit(1.0), least)
    steps = F.array(*[F.struct(*[F.lit(float(q)).alias(f"q{d}") for d, q in enumerate(pull)], F.lit(float(beta)).alias("beta")) for pull, beta in history])
    parts = _parts()

    def move(state, one):
        ahead = state["r"] + one["beta"] * (state["r"] - state["before"])
        pull = sum((parts[d] * one[f"q{d}"] for d in range(len(parts))), F.lit(0.0))
        return F.struct(F.greatest(least, ahead - F.lit(step) * (pull + F.lit(near_one) * (ahead - 1))).alias("r"), state["r"].alias("before"))

    return F.aggregate(steps, start, move)["r"]


def fit_rates(rows, targets, floor=0.0, budget=None, most_growth=None):
    """The iterations and step that fit ``rows`` (n_tokens and posteriors) to ``targets``, the
    weight of each domain: (history, step, now, wanted, reached), the last three as parts of
    all present tokens.

    ``budget`` is the total as a multiple of the present tokens. If it isn't given it is 1,
    with a mapping as ``floor`` the smallest at which no domain with a floor has to shrink,
    and with ``most_growth`` the smallest at which no domain at all has to, up to that."""
    weight = np.array([max(0.0, float(targets.get(name, 0))) for name in DOMAINS])
    if not weight.sum():
        raise ValueError("targets name no domain")
    weight = weight / weight.sum()
    parts, names, many = _parts(), [f"p_{name}" for name in DOMAINS], range(len(DOMAINS))
    near = [F.floor(F.sqrt(part) * GRID).alias(f"near_{d}") for d, part in enumerate(parts)]
    summed = [F.sum(F.col("n_tokens") * part).alias(name) for part, name in zip(parts, names)]
    found = rows.filter("n_tokens > 0").groupBy(*near, least_rate(floor).alias("least")).agg(F.sum("n_tokens").alias("n"), *summed)
    cells = lineage.cut(found.select("least", F.col("n").alias("n_tokens"), *[(F.col(name) / F.col("n")).alias(name) for name in names]), "mixing-cells")
    pairs = [(d, e) for d in many for e in many]
    sums = cells.agg(F.sum("n_tokens").alias("n"), *[F.sum(F.col("n_tokens") * p).alias(f"s{d}") for d, p in enumerate(parts)], *[F.sum(F.col("n_tokens") * F.col("least") * p).alias(f"h{d}") for d, p in enumerate(parts)], *[F.sum(F.col("n_tokens") * parts[d] * parts[e]).alias(f"m{d}{e}") for d, e in pairs]).first()
    total = float(sums["n"] or 0)
    if not total:
        return [], 1.0, np.zeros(len(DOMAINS)), weight, np.zeros(len(DOMAINS))
    now = np.array([sums[f"s{d}"] / total for d in range(len(DOMAINS))])
    if most_growth:
        needed = max((n / w for n, w in zip(now, weight) if w > 0), default=1.0)
        budget = min(max(needed, 1.0), most_growth)
    elif budget is None and isinstance(floor, dict):
        budget = max([1.0, *(sums[f"h{d}"] / total / weight[d] for d in many if weight[d] and floor.get(DOMAINS[d]))])
    wanted = weight * (budget or 1.0)
    scale = np.maximum(wanted, 1e-3)
    moments = np.array([[sums[f"m{d}{e}"] / total for e in range(len(DOMAINS))] for d in range(len(DOMAINS))])
    step = 1.0 / (np.linalg.eigvalsh(moments / np.sqrt(np.outer(scale, scale))).max() + NEAR_ONE)
    history, momentum, before, here = [], 1.0, now, now
    for _ in range(ITERATIONS):
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        beta, momentum = (momentum - 1) / after, after
        ahead = here + beta * (here - before)
        history.append(((ahead - wanted) / scale, beta))
        own = cells.withColumn("rate", rate(history, step, F.col("least")))
        found = own.agg(*[F.sum(F.col("n_tokens") * F.col("rate") * p).alias(f"s{d}") for d, p in enumerate(parts)]).first()
        before, here = here, np.array([found[d] / total for d in range(len(DOMAINS))])
        if np.abs(here - before).max() < SETTLED and np.abs(here - ahead).max() < SETTLED:
            break
    told = [f"{name} {now[d]:.4f} -> {here[d] / here.sum():.4f}, wanted {weight[d]:.4f}" for d, name in enumerate(DOMAINS)] if here.sum() else []
    logging.getLogger(__name__).log(logging.WARNING if told and np.abs(here / here.sum() - weight).max() > MISS else logging.INFO, "parts of the tokens: %s", "; ".join(told))
    return history, float(step), now, wanted, here


def mixing(docs, labels, targets, floor=0.0, budget=None, most_growth=None, most=terms.LABELLED):
    """Rates for ``docs`` (doc_id, text) by which the domains' expected tokens come to
    ``targets``, as near as the rates' ``floor`` lets them (a number, or one for each main
    domain; a miss is logged): doc_id, n_tokens, p_<domain> for each domain, rate, copies. Copies are
    the rate's whole part, and one more for that part of the ids that its rest says.

    ``labels`` (doc_id, quality, toxic) teach the domains low, clean and toxic; without
    usable labels all documents get one posterior. Null and empty texts have no tokens
    and the posterior of a text without terms. Null ids and repeated rows get rows of
    their own, equal ids equal copies. An empty table gives no rows. Other columns are
    not read."""
    rows = lineage.cut(posteriors(docs, fit_domains(docs, domain_of_labels(labels), most)), "posteriors")
    history, step, *_ = fit_rates(rows, targets, floor, budget, most_growth)
    rated = rows.withColumn("rate", F.round(rate(history, step, floor), 6))
    return rated.select("doc_id", "n_tokens", *[f"p_{name}" for name in DOMAINS], "rate", _copies(F.col("doc_id")).alias("copies"))


def _copies(doc_id):
    chance = F.pmod(F.xxhash64(doc_id, F.lit("mixing")), F.lit(1 << 20)) / float(1 << 20)
    return (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")).cast("int")


def mixed(docs, labels, targets, floor=0.0, budget=None, most_growth=None, most=terms.LABELLED):
    """The rows of ``docs``, with all their columns, as often as ``mixing`` gives copies. Each
    text is judged once and stored next to its count and posterior."""
    model = fit_domains(docs, domain_of_labels(labels), most)
    whole = docs.select(F.struct(*docs.columns).alias("row"), "text")
    rows = lineage.cut(_judged(whole, model, "row"), "judged-rows")
    history, step, *_ = fit_rates(rows.drop("row"), targets, floor, budget, most_growth)
    rated = rows.withColumn("rate", F.round(rate(history, step, floor), 6))
    copies = _copies(F.col("row.doc_id").cast("long"))
    return rated.select("row", F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).select("row.*")
