"""The registered queries: columns, types and one row for each of the table's, on tables with nulls, repeats and clashing extra columns, and on empty ones."""

import zlib

import pytest

from skerry.llm.queries import queries

COLUMNS = {
    "op1": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op3": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op4": {"doc_id": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op5": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op6": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op7": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op8": {"doc_id": "bigint", "class_id": "bigint"},
    "op9": {"doc_id": "bigint", "removed": "array<int>", "text": "string"},
    "op10": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
}
DOCS = [(1, "one two three four five six", "en"), (1, "one two three four five six", "en"), (2, None, None), (3, "", "en"), (None, "uno dos tres cuatro cinco seis siete", "es"), (5, "uno dos tres\ncuatro", "es"), (6, "long " * 9000, None)]


@pytest.fixture(scope="module", params=["rows", "none"])
def folder(request, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp(request.param))
    few = 10**6 if request.param == "rows" else 0
    docs = spark.createDataFrame([(d, t, x, "s", 0, 1, "c", None, 2) for d, t, x in DOCS], "doc_id long, text string, lang string, source string, n_chars long, score int, node string, bands string, place int")
    labels = spark.createDataFrame([(1, 1, 0), (3, None, None), (5, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([(i * 50, [float(i), 1.0], i) for i in range(1, 6)] + [(7, None, None)], "vec_id long, embedding array<float>, label int")
    pages = spark.createDataFrame([(1, "u", "<p>Some words here.</p>"), (None, None, None)], "page_id long, url string, html string")
    for name, df in (("documents", docs), ("labels", labels), ("embeddings", vectors), ("pages", pages)):
        df.limit(few).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", sorted(queries()))
def test_contract(spark, folder, name):
    df = queries()[name](spark, folder)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name.split("_")[0]]} == COLUMNS[name.split("_")[0]]
    rows = df.collect()
    if "/none" in folder:
        assert not rows
    elif name.startswith("op5"):
        assert len(rows) == 2 * 4
    elif name.startswith("op6"):
        assert len(rows) == 2
    elif name.startswith("op2"):
        assert sorted({r.doc_id or 0 for r in rows}) == [0, 1, 2, 3, 5, 6] and len(rows) == len(DOCS) + 2
    else:
        assert sorted(r.doc_id or 0 for r in rows) == sorted(d or 0 for d, *_ in DOCS)
    if name.startswith(("op1_", "op7_")) and rows:
        mod, left = (4, 2) if name.startswith("op1_") else (5, 0)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == left) for r in rows if r.doc_id is not None) and all(0 <= r.score <= 1 for r in rows)
