"""Odd texts, ties, repeated rows, empty tables and clashing columns, for every operator on documents."""

import hashlib

import pytest
from conftest import SF

import corpus_pipeline
from trivane.llm.decontaminate import contamination, decontaminate
from trivane.llm.embeddings import near_vectors
from trivane.llm.jaccard import jaccard_groups
from trivane.llm.licenses import scan_licenses
from trivane.llm.mixing import mix_sources
from trivane.llm.pii import pseudonymise
from trivane.llm.quality import score_quality
from trivane.llm.quality import train as train_quality
from trivane.llm.substrings import remove_repeats
from trivane.llm.toxicity import score_toxicity
from trivane.llm.toxicity import train as train_toxicity
from trivane.llm.warc import read_bundles, write_bundles

#: Texts that every operator has to take: null, empty, blank, very long, odd bytes, repeated rows.
ODD = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "word " * 30_000), (6, "a\u00a0b \U0001f600 \x00 c"), (7, "same text here for all of us"), (8, "same text here for all of us"), (8, "same text here for all of us"), (None, "no identifier at all on this row"), (9, "x" * 200_000)]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd documents with extra columns whose names operators use themselves."""
    rows = [(i, t, "en" if i else None, None if i in (3, 7) else f"s{(i or 0) % 3}", len(t or ""), 5, "x", 0.5, 1, 7, "z") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, key string, score double, n int, target int, _row string").repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def models(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return train_toxicity(docs, labels), train_quality(docs, labels)


def test_toxicity_and_quality(odd, empty, models):
    for score, model in ((score_toxicity, models[0]), (score_quality, models[1])):
        got = score(odd, model)
        rows = got.collect()
        assert len(rows) == odd.count() and got.columns == [c for c in odd.columns if c != "score"] + ["score", "predicted"]
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
        by = {}
        for r in rows:
            by.setdefault(r.text or "", set()).add(r.score)
        assert all(len(s) == 1 for s in by.values())  # null scores like empty, repeated rows alike
        assert score(empty, model).count() == 0


def test_training_without_labels(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(4, 1, 1), (5, 1, 1), (None, 0, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        assert score_toxicity(odd, train_toxicity(odd, labels)).count() == odd.count()
        assert score_quality(odd, train_quality(odd, labels)).count() == odd.count()
    assert score_quality(odd, train_quality(empty, one)).count() == odd.count()


def test_licenses(odd, empty):
    got = {r.doc_id: r for r in scan_licenses(odd).collect()}
    assert got[1].n_words == got[2].n_words == got[3].n_words == 0 and got[5].n_words == 30_000
    assert got[1].labels == "" and got[1].first_word is None and got[1].score == 0
    assert scan_licenses(empty).count() == 0


def test_mixing(odd, empty):
    rows = mix_sources(odd).collect()
    assert len(rows) == odd.count() and mix_sources(empty).count() == 0
    assert sum(r.size for r in rows) == sum(len((r.text or "").encode().split()) for r in odd.collect())
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mix_sources(odd.repartition(5)).collect()), key=repr)


def test_jaccard(odd, empty):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups(odd).collect()), key=repr)
    want = {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 5), 6: (1, 6), 7: (4, 7), 8: (4, 7), 9: (1, 9), None: (4, None)}
    assert got == sorted(((r.doc_id, *want[r.doc_id]) for r in odd.collect()), key=repr)
    assert jaccard_groups(empty).count() == 0


def test_near_copies_stage(spark, odd, empty):
    more = [(None, "same text here for all of us"), (8, "another text under an identifier that is taken"), (None, "no identifier at all on this row")]
    extra = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in more], "doc_id long, text string, lang string, source string, n_chars long")
    docs = odd.select(*corpus_pipeline.COLUMNS).union(extra).repartition(4)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, SF).collect()), key=repr)
    # Of (7, 8, 8, null) "same text ..." 7 stays, of two rows without identifier one; 8's other text stays.
    want = [x for x in ODD if x[0] != 8] + [more[1]]
    assert got == sorted(want, key=repr)
    assert corpus_pipeline.near_copies(spark, empty.select(*corpus_pipeline.COLUMNS), SF).count() == 0


def test_repeats(odd, empty):
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(odd, 4).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (1, 0, 0, sha("")) in got and (8, 7, 7, sha("")) in got and (7, 7, 0, sha("same text here for all of us")) in got
    assert remove_repeats(odd, 4).count() == odd.count() and remove_repeats(empty).count() == 0


def test_decontamination(spark, odd, empty):
    items = spark.createDataFrame([(1, "same text here for all of us"), (2, None), (3, ""), (1, "same text here for all of us"), (4, "one")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.containment) for r in contamination(odd, items).collect()}
    assert got == {(7, 1, 1.0), (8, 1, 1.0), (4, 4, 1.0)}
    assert decontaminate(odd, items).count() == odd.count() - 4
    assert contamination(empty, items).count() == 0 and contamination(odd, items.where("false")).count() == 0


def test_pseudonyms(odd, empty):
    got = pseudonymise(odd)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(((r.doc_id, r.text) for r in odd.collect()), key=repr)
    assert pseudonymise(empty).count() == 0


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, []), (9, [1.0, 0.0, 0.0]), (None, [0.0, 1.0]), (10, [1e-30, 0.0]), (11, [3e38, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as label", "2 as node", "3 as v")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(v).collect()), key=repr)
    linked = [(i, 4, 1, i == 1) for i in (1, 2, 2, 10, 11)]
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, None)]
    assert got == sorted(linked + alone, key=repr)
    assert near_vectors(v.where("false")).count() == 0 and near_vectors(v.where("vec_id = 3")).count() == 1


def test_warc(spark, tmp_path):
    long = "y" * 700_000
    rows = [(1, None, None), (2, "http://a/\r\nb", "x" * 99), (3, "u", "x" * 99), (4, "u", "z" * 100), (5, "u", "z" * 100), (5, "u", "z" * 100), (None, "u", "z" * 100), (6, "", long), (7, None, long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as refers_to", "3 as bytes")
    got = read_bundles(write_bundles(pages, f"file://{tmp_path}/w")).collect()
    want = {1: ("response", None, 0), 2: ("response", None, 99), 3: ("response", None, 99), 4: ("response", None, 100), 5: ("revisit", 4, 100), None: ("revisit", 4, 100), 6: ("response", None, 700_000), 7: ("revisit", 6, 700_000)}
    assert len(got) == len(rows) and all((r.record_type, r.refers_to, r.payload_bytes) == want[r.page_id] for r in got)
    assert write_bundles(pages.where("false"), f"file://{tmp_path}/e").count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_every_stage_takes_odd_rows(spark, odd, empty, name):
    """Null, empty, blank and very long texts, repeated rows and a missing identifier, on each stage alone."""
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = odd.select(*corpus_pipeline.COLUMNS)
    got = stage(spark, docs, SF).collect()
    assert stage(spark, empty.select(*corpus_pipeline.COLUMNS), SF).count() == 0
    rows = sorted(((r.doc_id, r.text) for r in got), key=repr)
    if name == "n-gram Jaccard join":
        assert len(rows) == len(ODD) - 2 and {i for i, _ in rows} == {i for i, _ in ODD} - {8}
    elif name == "mixing sources":
        assert {i for i, _ in rows} <= {i for i, _ in ODD} and all(0 < r.copies <= 3 for r in got)
    else:  # none is toxic, holds an item or personal data: all stay as they are
        assert rows == sorted(ODD, key=repr)


def test_decontamination_by_row(spark, odd):
    """Of rows that share an identifier only those with an item go; columns may have any name."""
    item = "one two three four five six seven"
    rows = [(1, f"start {item} end", 1), (1, "other text", 2), (None, item, 3), (None, "clean text", 4), (2, item.upper(), 5), (2, item.upper(), 6), (3, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _bad int").selectExpr("*", "1 as _t", "2 as _row", "3 as h")
    items = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = decontaminate(docs, items)
    assert got.columns == docs.columns and sorted(r._bad for r in got.collect()) == [2, 4, 7]
