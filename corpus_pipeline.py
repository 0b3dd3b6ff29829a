"""Corpus preparation: toxic documents go, one document of each near-duplicate group stays,
sources are mixed to target weights, and what remains is packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns rows with the columns of ``docs``, the
last one the pieces of sequences. Texts without words pass all filters, repeated ones too; rows
without an id stay, since no group can name them; repeated rows with words are near-duplicates
of each other, and rows of one id with different texts are documents of their own.
"""

import public_tokenizers

from ledgerlark.llm import minhash, mixing, packing, toxicity
from ledgerlark.llm.common import table
from ledgerlark.plans import lineage

#: Weights of the domains; no document's rate falls below 1, and the tokens grow by half at most,
#: so a domain with too many tokens may miss its weight, which the stage logs.
TARGETS = {"low": 0.05, "clean": 0.94, "toxic": 0.01}
LEAST_RATE, MOST_GROWTH = 1.0, 1.5
VOCABULARY, END_ID = "word_bpe_49k.json", 1


def reject_toxic(spark, docs, sf_dir):
    """The documents that score below the threshold."""
    return toxicity.keep_below(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return minhash.one_of_each(docs, width=5, percent=80)


def mix_domains(spark, docs, sf_dir):
    """Documents repeated so that the domains' tokens come near the target weights."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"), TARGETS, LEAST_RATE, most_growth=MOST_GROWTH)


def pack_sequences(spark, docs, sf_dir):
    """The pieces of sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path(VOCABULARY), END_ID)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_domains),
    ("packing", pack_sequences),
]
#: Trained models, hashed minima and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = lineage.cut(stage(spark, docs, sf_dir), name)
    return docs
