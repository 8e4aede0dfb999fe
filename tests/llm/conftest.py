import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, kept string"


@pytest.fixture(scope="session")
def spark():
    from assayer.session import local_session

    from assayer.llm.common import ready

    session = ready(local_session(8, app="tests"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty and long texts, ties, repeated rows, null ids, and columns named like the operators' own."""
    words = np.random.default_rng(5).integers(0, 400, 6000)
    long = " ".join(f"w{i}" for i in words)
    near = long.replace("w7 ", "v7 ")
    passage = " ".join(f"passage{i}" for i in range(60))
    texts = [
        None, "", "   \n\t ", "one", "one two three", long, long, near, long + " tail",
        f"before {passage} after", f"other words first {passage}", passage, "a" * 5000, "ab" * 4000,
        "été über ñandú 漢字 🙂 fin", "été über ñandú 漢字 🙂 fin", "x <|endoftext|> y", "tab\tand  two spaces \n\n x", "\x00 zero",
    ]
    rows = [(i, t, "en", "src0" if i % 3 else None, len(t or ""), 7, "other") for i, t in enumerate(texts)]
    rows += [rows[5], rows[1], (None, long, None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark):
    """The smallest given documents, over several partitions."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
