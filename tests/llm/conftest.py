"""Documents with every odd case at once."""

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "many words make a long text and 4111111111111111 is a card " * 20_000
#: Names that operators use for their own columns.
CLASHES = (
    "made", "found", "held_out", "score", "quality_score", "quality_kept", "quality_features", "pii_found", "mix_probability", "mix_source", "chance", "id",
    "label", "order", "shard", "depth", "hash", "bytes", "fp", "component_id", "node", "n_bytes", "media", "payload", "lang_pred", "tokens", "topic", "rows", "own",
)


@pytest.fixture(scope="session")
def odd_documents(spark: SparkSession) -> DataFrame:
    rows = [
        (1, "a text of some words that is like others of its kind", "en", "src0", 52), (1, "a text of some words that is like others of its kind", "en", "src0", 52),
        (2, "", "en", "src0", 0), (3, None, None, None, None), (None, "a text without an id", "de", "src1", 20), (4, LONG, "en", "src0", len(LONG)),
        (5, "naïve ßtraße 日本語 😀", "xx", "", None), (6, "12.5 ... !!", "en", None, 11), (7, None, "en", "src0", 0), (8, "one", "de", "src2", 3),
        (9, "one", "de", "src2", 3),
    ]
    return spark.createDataFrame(rows, DOCUMENTS).withColumns({name: F.lit("clash") for name in CLASHES})


@pytest.fixture(scope="session")
def no_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCUMENTS)
