import pytest


@pytest.fixture(scope="session")
def make(spark):
    """A table from rows, whatever is null in them."""
    kinds = {
        "documents": "doc_id long, text string, lang string, source string, n_chars long",
        "labels": "doc_id long, quality int, toxic int",
        "benchmark": "item_id long, text string",
        "pages": "page_id long, url string, html string",
    }

    def build(kind, rows):
        schema = kinds[kind]
        width = schema.count(",") + 1
        full = [tuple(r) + (None,) * (width - len(r)) for r in rows]
        return spark.createDataFrame(full, schema)

    return build

