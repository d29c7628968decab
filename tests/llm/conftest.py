import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


LONG = ("the quick brown fox jumps over the lazy dog and then " * 400) + "z" * 3000
ODD = [
    (1, "the cat sat on the mat and looked at the dog in the garden", "en"),
    (2, "the cat sat on the mat and looked at the dog in the garden", "en"),  # a copy
    (2, "the cat sat on the mat and looked at the dog in the garden", "en"),  # a repeated row
    (3, None, "en"),
    (4, "", None),
    (5, "12345 --- !!! \t\n  ", "fr"),
    (6, LONG, "en"),
    (7, "der hund und die katze sind im garten und nicht im haus", "de"),
    (8, "le chat est sur la table et le chien est dans le jardin", "fr"),
    (None, "mail me at jo.doe@example.com or +1 (555) 010-2345 from 10.0.0.1", None),
    (9, "a  b   c\n\n d é日本語🎉 <|endoftext|> \x1c x\x85y", "de"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents, with extra columns whose names clash with working ones."""
    rows = [(i, t, lang, 1.0, "k", i) for i, t, lang in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, key string, row long")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
