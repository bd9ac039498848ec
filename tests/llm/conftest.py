import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """documents from (doc_id, text[, source]) tuples, with extra columns named like ones the operators use inside."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        for c in ("_size", "_blob", "fp", "_of", "target", "p_toxic", "node"):
            df = df.selectExpr("*", f"'x' AS `{c}`")
        return df

    return make
