import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) pairs, with a column whose name operators use inside."""

    def make(rows, **more):
        data = [(i, t, more.get("lang", "en"), more.get("sources", {}).get(i, "src0") if "sources" in more else "src0", len(t or ""), "x") for i, t in rows]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, size string")

    return make
