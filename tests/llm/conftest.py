"""Small tables for the training-data operators."""

import os
from pathlib import Path

import pytest

# worker processes import the package, wherever pytest was started
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(Path(__file__).resolve().parents[2]), os.environ.get("PYTHONPATH")]))

#: Names that operators use inside or return.
CLASHING = ["row", "score", "kept", "n_links", "component_id", "class", "text_key", "shard", "label", "rank", "n_tokens", "copies", "host"]


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with further columns of clashing names."""

    def make(pairs):
        schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{name} string" for name in CLASHING)
        rows = [(k, text, None if k == 3 else "en", "src0" if (k or 0) % 3 else None, None, *["x"] * len(CLASHING)) for k, text in pairs]
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture
def make_vectors(spark):
    """Vectors from (vec_id, list) pairs, with further columns of clashing names."""

    def make(pairs):
        schema = "vec_id long, embedding array<float>, label int, class string, n string, part string, length string, row string"
        return spark.createDataFrame([(k, v, None, "x", "x", "x", "x", "x") for k, v in pairs], schema)

    return make
