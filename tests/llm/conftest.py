import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


DOCS = "doc_id long, text string, lang string, source string, bucket int, row string"


def rows_of():
    """Nulls anywhere, empty and long texts, ties, repeated rows; ``bucket`` and ``row`` clash with operators' own names."""
    import random

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    texts = [" ".join(word() for _ in range(r.randint(1, 60))) for _ in range(40)]
    long = " ".join(word() for _ in range(30_000))
    out = [(i, t, "en" if i % 3 else "fr", f"s{i % 4}", i, "x") for i, t in enumerate(texts)]
    near = texts[7].split() * 3
    for k in range(12):
        out.append((100 + k, " ".join([*near[: 20 + k], "odd", *near[20 + k :]]), "en", "s0", None, None))
    out += [(200, None, None, None, 1, None), (201, "", "en", "s1", 1, "y"), (202, "  \n\t ", "fr", None, 2, "z"), (203, long, "en", "s2", 3, "w"), (None, texts[3], "en", "s1", 1, "q"), (None, None, None, None, None, None)]
    out += [(5, texts[5], "en", "s1", 5, "x")] * 2 + [(6, texts[9], "en", "s1", 5, "x"), (300, "Ünïcode wörd ÀÉ\nsame line of text here\nsame line of text here", "fr", "s3", 1, "u"), (301, "x\nSAME line of text here  \nother", "fr", "s3", 1, "u"), (302, "123 456 !!", "fr", "s3", 1, "u")]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows_of(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
