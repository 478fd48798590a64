import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests"), os.path.dirname(os.path.abspath(__file__))]

from trackloom.session import local_session  # noqa: E402

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
COPY = "one of the many copied texts that stand here twice and are long enough to be seen as such by all of the operators"
# Nulls in every column, empty and very long texts, repeated rows and ids, and column names the operators use themselves.
ODD_ROWS = [
    (1, "Plain words in a short text.", "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, COPY, "en", None), (5, COPY, "en", "b"),
    (6, LONG, "de", "a"), (6, LONG, "de", "a"), (7, "tie", "en", "a"), (7, "other text of the same id", "fr", "a"), (None, "no id here", "en", "a"),
    (None, None, None, None), (8, "#### $$$$ !!!!", "en", "a"), (9, " \t\n\r ", "en", "b"), (10, "é ü ß 漢字 😀 token=abcdef123", "de", "b"), (11, "x" * 5000, "en", "b"),
]


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "llm-tests", "6g")
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")  # state must carry over batches
    yield session
    session.stop()


@pytest.fixture(scope="session")
def odd(spark):
    clashes = ", ".join(f"`{c}` string" for c in ("mark", "own_id", "hit_id", "key", "size", "quality_score", "shard", "term", "fp", "mix_copies", "Slot"))
    rows = [(*r, len(r[1] or ""), *["x"] * 11) for r in ODD_ROWS]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {clashes}")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
