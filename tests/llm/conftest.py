import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, h string, pieces string, hits string, n_words string, finds string, decoded string, kept string, target string, tokens string, key string"


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """Write documents (and other tables) as a data folder: folder(documents=[(id, text, lang, source)], ...)."""

    def make(documents=(), labels=(), benchmark=(), pages=(), embeddings=()):
        d = str(tmp_path_factory.mktemp("data"))
        rows = [(i, t, lang, src, len(t) if t is not None else None, *["extra"] * 11) for i, t, lang, src in documents]
        spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
        more = lambda rows, names: [(*r, *["extra"] * len(names.split())) for r in rows]
        for name, rows, columns, extra in (
            ("labels", labels, "doc_id long, quality int, toxic int", "text lang n_words kept target"), ("benchmark", benchmark, "item_id long, text string", "h window len doc_id n_words row"),
            ("pages", pages, "page_id long, url string, html string", "host path text n_chars frame skeleton rule"),
            ("embeddings", embeddings, "vec_id long, embedding array<float>, label int", "id v cluster distance compared"),
        ):
            spark.createDataFrame(more(rows, extra), ", ".join([columns, *(f"{c} string" for c in extra.split())])).write.parquet(f"{d}/{name}.parquet")
        return d

    return make
