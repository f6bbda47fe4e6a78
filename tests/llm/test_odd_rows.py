"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import importlib

import pytest
from pyspark.sql import functions as F

from latticeq.llm.decontaminate import contamination, decontaminate
from latticeq.llm.exact_dedup import drop_copies, exact_dedup
from latticeq.llm.hmm import score_texts
from latticeq.llm.jaccard_join import drop_near_copies, jaccard_join
from latticeq.llm.language import identify_languages, trained_trees
from latticeq.llm.line_dedup import dedup_lines
from latticeq.llm.mixing import mix_sources
from latticeq.llm.pii import find_personal_data
from latticeq.llm.secrets import find_secrets
from latticeq.llm.url_filter import filter_urls

exact = importlib.import_module("latticeq.llm.exact_dedup")
LONG = "very long text of words that go on " * 20_000
PASSAGE = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, None, "en", "a", 0), (2, "", None, "a", 0), (3, " \t\n ", "en", None, 3), (4, "12 34 !", "en", None, 7),
    (5, LONG, "en", "b", len(LONG)), (6, LONG, "de", "b", None), (6, LONG, "de", "b", None), (None, "text without an identifier", "en", "b", 1),
    (None, None, None, None, None), (7, PASSAGE, "fr", "c", 1), (8, "other line\n" + PASSAGE, None, "c", 1), (9, "é\U0001f600 ça va", "fr", "\U0001f600", 1),
]
CLASH = ["id", "node", "n", "label", "kept", "size", "token", "row", "same", "target", "words", "a", "b", "idx", "block", "hashes", "held_out", "base", "spans", "many", "bits"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in CLASH}).repartition(3).cache()


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, PASSAGE), (None, PASSAGE), (2, None), (3, "too short"), (4, "")], "item_id long, text string")


def test_exact(odd):
    got = exact_dedup(odd, keep="largest").collect()
    assert len(got) == len(ROWS) and sum(r.kept for r in got) == len({r[1] or "" for r in ROWS})
    six = [r for r in got if r.doc_id == 6]
    assert [r.group_size for r in six] == [3, 3] and sum(r.kept for r in six) == 1
    assert {r.keep_id for r in got if r.doc_id in (1, 2)} == {2}
    small = {r.doc_id: r for r in exact_dedup(odd, keep="smallest").collect()}
    assert small[1].kept and not small[2].kept and not small[6].kept
    assert exact_dedup(odd.limit(0)).count() == 0
    one = drop_copies(odd, keep="largest")
    assert one.columns == odd.columns and drop_copies(odd.limit(0)).count() == 0
    rows = one.collect()
    assert len(rows) == len({r[1] or "" for r in ROWS}) and {r.doc_id for r in rows} >= {2, 3, 4, 6, 7, 8, 9}


def test_hot_copies_in_pieces(spark, monkeypatch):
    """A text that holds most rows, under repeated and null identifiers, is cut and settled from its pieces."""
    monkeypatch.setattr(exact, "PIECE_ROWS", 16)
    rows = [(i % 50 if i % 7 else None, "hot") for i in range(2000)] + [(i, f"t{i}") for i in range(100)] + [(200, None), (201, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for keep, best in (("largest", 49), ("smallest", 0)):
        got = exact_dedup(df, keep=keep).collect()
        hot = [r for r in got if r.group_size > 2]
        assert len(got) == len(rows) and len(hot) == 2000 and {(r.keep_id, r.group_size) for r in hot} == {(best, 2000)} and sum(r.kept for r in hot) == 1
        assert all(r.doc_id == best for r in hot if r.kept)
        assert sum(r.kept for r in got) == 102 and drop_copies(df, keep=keep).count() == 102


def test_language(odd):
    trees = trained_trees(odd)
    got = identify_languages(odd, trees)
    rows = got.collect()
    assert got.columns == [*odd.columns, "lang_pred", "score", "bits_per_byte"] and len(rows) == len(ROWS)
    for r in rows:
        if r.doc_id in (1, 2, 3, 4):
            assert r.lang_pred == "und" and r.score == 0
        assert 0 <= r.score <= 1
    assert identify_languages(odd.limit(0), trees).count() == 0
    nothing = trained_trees(odd.limit(0))
    assert {r.lang_pred for r in identify_languages(odd, nothing).collect()} == {"und"}


def test_jaccard(odd):
    got = jaccard_join(odd).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[1].component_id == 1
    assert by[5].component_id == by[6].component_id == 5
    assert by[7].component_id == by[8].component_id == 7
    assert by[4].n_shingles == by[9].n_shingles == 1
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert jaccard_join(odd.limit(0)).count() == 0
    left = drop_near_copies(odd)
    assert left.columns == odd.columns and drop_near_copies(odd.limit(0)).count() == 0
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [1, 2, 3, 4, 5, 7, 9]


def test_near_copies_under_one_identifier(spark):
    other = PASSAGE.replace("word59", "changed")
    rows = [(1, "a b c d e f"), (5, PASSAGE), (5, "quite another text of some words"), (5, other), (3, PASSAGE + " more"), (None, PASSAGE)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in drop_near_copies(df).collect()) == sorted([("1", rows[0][1]), ("3", rows[4][1]), ("5", rows[2][1]), ("None", PASSAGE)])
    two = spark.createDataFrame([(5, PASSAGE), (5, other)], "doc_id long, text string")
    assert drop_near_copies(two).count() == 1


def test_lines(odd):
    got = dedup_lines(odd)
    rows = got.collect()
    assert got.columns[: len(odd.columns)] == odd.columns and len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    assert by[8].text == "other line" and by[8].removed == "1-1" and by[7].n_removed == 0
    assert by[1].text is None and by[1].n_lines == 0 and by[2].n_lines == 1
    assert by[5].n_removed == 0 and by[6].text == "" and sum(r.doc_id == 6 for r in rows) == 2
    assert dedup_lines(odd.limit(0)).count() == 0


def test_text_of_very_many_lines(spark):
    lines = [f"line {i} has some words of its own {i * 7919} {i * 104729} {i * 1299709}" for i in range(100_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["new"] + lines[10:50_000] + ["old"] + lines[60_000:]))]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0 and got[1].text == rows[0][1]
    assert got[2].text == "new\nold" and got[2].removed == "1-49990,49992-89991" and got[2].n_removed == 89_990


def test_contamination(odd, benchmark):
    got = contamination(odd, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(7, 1), (7, None), (8, 1), (8, None)}
    clean = decontaminate(odd, benchmark)
    assert clean.columns == odd.columns and clean.count() == len(ROWS) - 2
    assert contamination(odd.limit(0), benchmark).count() == 0
    assert decontaminate(odd, benchmark.limit(0)).count() == len(ROWS)


def test_private_and_secret(odd):
    for operator in (find_personal_data, find_secrets):
        rows = operator(odd).collect()
        assert len(rows) == len(ROWS) and all(r.spans == "" for r in rows)
        assert operator(odd.limit(0)).count() == 0


def test_scores(odd):
    rows = score_texts(odd, held=F.col("doc_id") == 9, rounds=1).collect()
    assert len(rows) == len(ROWS)
    assert all(r.n_tokens == 1 and r.n_known == 1 for r in rows if r.doc_id in (1, 2, 3))
    nine = next(r for r in rows if r.doc_id == 9)
    assert (nine.n_tokens, nine.n_known) == (4, 1)
    assert score_texts(odd.limit(0)).count() == 0
    nothing = score_texts(odd, held=F.lit(True)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score < 0 for r in nothing)


def test_mix(odd):
    rows = mix_sources(odd).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mix_sources(odd.repartition(5)).collect()), key=str)
    assert mix_sources(odd.limit(0)).count() == 0


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no host"), (4, "http://"), (5, "http://A.Example.COM"), (6, "x://org/es/1"), (6, "x://org/es/1"), (None, "http://a.b?c#d"), (7, "://" + "a" * 50_000), (8, "http://xorg/es/1"), (9, "http://é.net/de/\n?x")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "id", "p", "rule", "verdict", "won")})
    got = filter_urls(df).collect()
    assert len(got) == len(rows) and all(r.verdict in ("allow", "block") for r in got)
    by = {r.page_id: r for r in got}
    assert (by[1].host, by[1].path, by[3].host, by[4].host) == ("", "", "", "") and by[5].host == "a.example.com"
    assert (by[6].rule, by[6].verdict, by[8].rule) == ("org/es/", "block", None) and by[9].path == "/de/\n" and by[9].rule == "net/de/"
    assert filter_urls(df.limit(0)).count() == 0
