import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

LONG = " ".join(f"word{k % 977}" for k in range(60_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today\nA line that is repeated here\nshort"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today\nA line that is repeated here\nshort"),
    (3, "  a LINE that is repeated here\t\nThe quick brown fox jumps over the lazy dog near the river bank  tonight\n\n"),
    (4, None),
    (5, ""),
    (6, "one two"),
    (7, "One  two"),
    (8, "one\ttwo"),
    (9, "Größe übermütig ﷽ 日本語 naïve 1234567 !!! \u00a0\u2003x \x1c y's they'll 'S\r\n\r\n"),
    (10, LONG),
    (11, LONG + " more"),
    (12, " \n\t "),
    (None, "one two"),
    (None, None),
    (6, "one two"),
    (13, "tie tie tie tie tie tie"),
    (14, "tie tie tie tie tie"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, long and repeated rows, and columns whose names clash with those of operators."""
    rows = [(i, t, "en" if n % 2 else "de", None if n % 3 == 0 else f"s{n % 2}", n, "row", n) for n, (i, t) in enumerate(TEXTS)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string, cell int"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
