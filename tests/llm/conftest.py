import os

import pytest

os.environ.setdefault("OMP_NUM_THREADS", "1")

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns that operators use inside, as strangers in their input.
STRANGERS = ["fp", "cell", "slice", "digest", "row", "part", "place", "length", "slot", "shard", "label", "features", "_slice"]


@pytest.fixture
def docs_of(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, lang), with further columns of clashing names."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, SCHEMA).repartition(3)
        for name in STRANGERS:
            df = df.selectExpr("*", f"'stranger' AS {name}")
        return df

    return make
