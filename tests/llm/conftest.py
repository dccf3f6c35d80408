import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, an extra column with a clashing name."""
    base = " ".join(f"word{i}" for i in range(60))
    lines = "\n".join(f"line {i} of the text" for i in range(6))
    rows = [
        (1, base, "s0"),
        (2, base, "s0"),
        (2, base, "s0"),
        (3, base.replace("word7", "other"), "s1"),
        (4, None, "s1"),
        (5, "", None),
        (6, "  \n\t ", "s1"),
        (7, "One two", "s1"),
        (8, "one  TWO", "s1"),
        (None, base, "s2"),
        (None, None, None),
        (9, lines + "\n" + lines, "s2"),
        (10, lines, "s2"),
        (11, "a b c " * 30_000, "s2"),
        (12, "All rights reserved. CC BY 4.0 and the GNU General Public License", "s3"),
        (13, "x " + base + " y", "s3"),
        (14, "naïve café — ünïcode " * 5, "s3"),
    ]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")
    return df.withColumns({"kept": F.lit("x"), "d": F.lit(1), "key": F.lit("k"), "score": F.lit(2), "n_lines": F.lit(3)})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
