import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with a column whose name clashes with internal ones."""

    def make(rows, extra="key string, block string, db int, rep long"):
        names = [c.split()[0] for c in extra.split(", ")]
        values = {"key": "k", "block": "b", "db": 3, "rep": 9}
        return spark.createDataFrame([(i, t, *[values[n] for n in names]) for i, t in rows], f"doc_id long, text string, {extra}")

    return make
