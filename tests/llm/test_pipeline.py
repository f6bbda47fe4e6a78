"""The pipeline's stages on small tables, against plain Python: nulls, repeats, clashing columns, empty tables, decisions."""

from __future__ import annotations

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm.test_contracts import plain_tiles
from tests.llm.test_results import LOWER, words_of

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
CLASH = ["lang_pred", "score", "bits_per_byte", "kept", "keep_id", "component_id", "id", "same", "node", "coverage", "label", "__id", "__row", "__text"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark, docs):
    rows = [(1000, None, None, None, None), (1001, "123 .", "en", "src0", 5), (1002, "The", None, None, 3), (1003, "", "en", "src1", 0), (None, "The other text here", "en", "src1", 0)]
    some = docs.unionByName(spark.createDataFrame(rows, docs.schema)).unionByName(docs.filter("doc_id < 5"))
    return some.withColumns({c: F.lit(f"mine {c}") for c in CLASH}).repartition(3).cache()


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_columns_and_empty_tables(spark, odd, name):
    kept = STAGES[name](spark, odd, SF)
    assert kept.columns == odd.columns and kept.schema["doc_id"].dataType == odd.schema["doc_id"].dataType
    for r in kept.limit(20).collect():
        assert all(r[c] == f"mine {c}" for c in CLASH)
    # no row is changed or made up
    before = {tuple(r) for r in odd.collect()}
    assert {tuple(r) for r in kept.collect()} <= before
    empty = STAGES[name](spark, odd.limit(0), SF)
    assert empty.columns == odd.columns and empty.count() == 0


def test_languages(spark, odd, docs):
    letters = {r.doc_id for r in odd.collect() if re.search(r"[^\W\d_]", r.text or "")}
    assert {r.doc_id for r in STAGES["language_id"](spark, odd, SF).collect()} == letters
    # the code length decides: a text of bytes that no learned language has goes, though it has letters
    foreign = spark.createDataFrame([(2000, "\u4f60\u597d\u4e16\u754c\u8fd9\u662f\u4e00\u4e2a\u5f88\u957f\u7684\u53e5\u5b50" * 5, None, "src0", 1), (2001, "\u041f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440 " * 9, None, "src0", 1)], docs.schema)
    kept = {r.doc_id for r in STAGES["language_id"](spark, docs.unionByName(foreign), SF).collect()}
    assert not kept & {2000, 2001} and len(kept) == docs.count()
    # nothing was learned: texts with a letter stay
    unlabelled = docs.unionByName(foreign).withColumn("lang", F.lit(None).cast("string"))
    assert STAGES["language_id"](spark, unlabelled, SF).count() == docs.count() + 2


def test_exact_copies(spark, odd):
    best: dict = {}
    for r in odd.collect():
        best[r.text or ""] = max(best.get(r.text or "", -1), -1 if r.doc_id is None else r.doc_id)
    rows = STAGES["exact_dedup"](spark, odd, SF).collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in rows) == sorted(best.values())


def test_near_copies(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and sets[i]:
                common = len(sets[i] & sets[j])
                if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common) and label[i] != label[j]:
                    low, high = sorted((label[i], label[j]))
                    label = {k: low if x == high else x for k, x in label.items()}
    kept = {r.doc_id for r in STAGES["jaccard_join"](spark, docs, SF).collect()}
    assert kept == {i for i, x in label.items() if i == x} and len(kept) < len(rows)


def test_benchmark(spark, docs):
    split = lambda t: re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", (t or "").translate(LOWER))
    items = [split(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in items]

    def leaks(text):
        words = split(text)
        have = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        return any(have & g and plain_tiles(words, w, 5) >= 0.5 * len(w) for w, g in zip(items, grams))

    kept = {r.doc_id for r in STAGES["decontaminate"](spark, docs, SF).collect()}
    assert kept == {r.doc_id for r in docs.collect() if not leaks(r.text)}


def test_mix(spark, odd):
    rows = STAGES["mix_sources"](spark, odd, SF).collect()
    assert len(rows) == odd.count() and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    assert STAGES["mix_sources"](spark, odd.limit(0), SF).count() == 0


def test_run(spark, docs):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {"doc_id", "size", "source_size", "target", "taken"} <= set(rows[0].asDict())
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
    assert {r.doc_id for r in rows} == {r.doc_id for r in kept.select("doc_id").collect()} and len({r.doc_id for r in rows}) == len(rows)


def test_the_drivers_garbage_goes_between_steps(spark, docs):
    """What a step leaves on the heap of the driver's JVM is collected before the next one, not when the heap is full."""
    from latticeq.llm import shared

    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    used = lambda: (runtime.totalMemory() - runtime.freeMemory()) >> 20
    work = shared.Workspace(spark, "garbage")
    shared._settled = 0.0
    for _ in range(8):
        spark.sparkContext._gateway.new_array(spark._jvm.long, 2 << 20)
    before = used()
    work.table(docs.select("doc_id"))
    assert used() < before - 64
