import glob

import pytest

from skerry.llm import paragraphs, passages
from skerry.llm.common import SLICE, Memo, checkpoint, release, shared_dir, written


def folders(spark):
    return set(glob.glob(shared_dir(spark).removeprefix("file:") + "/*-*"))


def test_release_deletes_only_what_was_written(spark):
    base, before = spark.range(10), folders(spark)
    table = written(base, "some")
    kept = checkpoint(table.filter("id > 6"))
    release(base, table)
    assert {f for f in folders(spark) - before if "/some-" in f} == set()
    assert sorted(r.id for r in kept.collect()) == [7, 8, 9]
    release(table)  # nothing is left to delete
    with pytest.raises(Exception, match="(?i)exist|not found"):
        table.count()


def test_large_tables_go_once_they_are_used(spark):
    long = " ".join(f"w{k}" for k in range(70))
    head, tail = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    docs = spark.createDataFrame([(1, f"{long}\nend one"), (2, f"{long}\nend two"), (3, f"{head} {long} {tail}"), (4, None)], "doc_id long, text string")
    before = folders(spark)
    cut = passages.without_passages(paragraphs.without_repeats(docs))
    assert {r.doc_id: r.text for r in cut.collect()} == {1: f"{long}\nend one", 2: "end two", 3: f"{head} {tail}", 4: None}
    assert not [f for f in folders(spark) - before if any(f"/{kind}-" in f for kind in ("signed", "met", "texts", "prints"))]


def test_memory_of_words_learns_in_slices_and_starts_anew():
    sizes = []
    memo = Memo(lambda words: sizes.append(len(words)) or [len(w) for w in words], 2 * SLICE)
    memo.learn(f"w{k}" for k in range(SLICE + 5))
    assert sorted(sizes) == [5, SLICE] and memo["w7"] == 2 and len(memo) == SLICE + 5
    memo.learn(["w7"])
    assert len(sizes) == 2
    memo.learn(f"x{k}" for k in range(SLICE))
    assert len(memo) == SLICE and "w7" not in memo and memo["x10"] == 3
