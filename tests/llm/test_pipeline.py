import random

import corpus_pipeline
from test_text_models import labelled


def test_stages(spark, tmp_path):
    r = random.Random(8)
    toxic = labelled()
    known = sorted({w for _, t, y in toxic if not y for w in t.split()})
    words = lambda r, n: [r.choice(known) for _ in range(n)]
    passage = " ".join(words(r, 60))
    rows = [(i, t) for i, t, _ in toxic] + [(1000, passage + "\n" + toxic[1][1]), (1001, " ".join(words(r, 50)) + "\n" + passage), (1002, "12 34"), (1003, None), (1004, " ".join(words(r, 80))), (None, " ".join(words(r, 30)))]
    near = rows[-2][1].split()
    rows += [(1005, " ".join(near)), (1006, " ".join([*near[:40], "x", *near[41:]])), (1004, rows[-2][1])]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1.5) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, _, t in toxic], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
        at.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = at.collect()
    ids = {n: [x.doc_id for x in v] for n, v in kept.items()}
    assert len(ids["language_id"]) == len(rows) - 2 and not {1002, 1003} & set(ids["language_id"])
    clean = {i for i, _, t in toxic if not t}
    assert len(clean - set(ids["toxicity"])) <= 0.03 * len(clean) and sum(i in ids["toxicity"] for i, _, t in toxic if t) <= 2
    assert {1000, 1001, 1004, None} <= set(ids["near_duplicates"]) and not {1005, 1006} & set(ids["near_duplicates"]) and ids["near_duplicates"].count(1004) == 1
    text = {x.doc_id: x.text for x in kept["repeated_paragraphs"]}
    assert passage in text[1000] and passage not in text[1001] and toxic[1][1] not in text[1000]
    packed = corpus_pipeline.packed(spark, at, str(tmp_path)).collect()
    assert {x.doc_id for x in packed} == set(text)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((x.doc_id or -1, x.ids_crc32) for x in whole) == sorted((x.doc_id or -1, x.ids_crc32) for x in packed)
    assert corpus_pipeline.run(spark, str(empty(docs, tmp_path))).count() == 0


def test_passages_are_cut_once(spark):
    passage, head, tail = (" ".join(f"{x}{k}" for k in range(n)) for x, n in (("w", 70), ("a", 40), ("b", 40)))
    docs = spark.createDataFrame([(1, passage), (2, f"{head} {passage} {tail}"), (3, passage), (4, None), (5, " ")], "doc_id long, text string")
    left = corpus_pipeline.without_repeated_paragraphs(spark, docs, "")
    assert left._jdf.queryExecution().executedPlan().toString().count("BatchEvalPython") == 1
    assert {r.doc_id: r.text for r in left.collect()} == {1: passage, 2: f"{head} {tail}", 4: None, 5: " "}


def empty(docs, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    docs.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    return tmp_path / "none"
