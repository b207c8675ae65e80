import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def edge(spark):
    """Null ids and texts, empty and long texts, repeated rows, and columns named like the operators' own."""
    long = " ".join(f"wörd{i % 997} and" for i in range(30_000))
    line = "The same long line stands in many documents."
    rows = [(1, None, "en"), (2, "", "en"), (3, "   \n\t", None), (4, long, "en"), (4, long, "en"), (None, "text without an id", "en"),
            (5, f"{line}\nfirst", "en"), (6, f"  {line.upper()} \nsecond\n", "en"), (7, f"third\n{line}", "fr"), (8, "x" * 450, None),
            (9, "x" * 450, "fr"), (10, "aaaa\n" * 200, "de"), (11, "mail a.b@c.example.com or +49 170 1234567", "en"), (12, "é ü 漢字", "fr")]
    return spark.createDataFrame(
        [(i, t, g, "s1", 0, "row", 1.0, "x", 2) for i, t, g in rows],
        "doc_id long, text string, lang string, source string, n_chars long, row string, rank double, _drop string, h int")


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)
