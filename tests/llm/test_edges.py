"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from topolith.llm import chains, decontaminate, html, licenses, merkle, pieces, pii, quality, simhash, suffixes
from topolith.llm.settings import PIECE_MODEL, PII_KEY

PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak near the quiet river bank"
PASSAGE = " ".join(f"passage{i} word{i % 7}" for i in range(40))
LONG = " ".join(f"w{i * 7919 % 99991}" for i in range(150_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, ord string, key int, fp string, tag double, kinds int, score string, _row int"

ROWS = [
    (1, PROSE),
    (2, PROSE),  # an exact copy
    (3, ""),
    (4, None),
    (5, LONG),
    (6, f"{PASSAGE} and then something else"),
    (7, f"before it {PASSAGE}"),
    (None, PROSE),
    (None, None),
    (8, "mail a.b@example.com, card 4111111111111111"),
    (8, "mail a.b@example.com, card 4111111111111111"),  # a repeated row
    (9, " \n\t "),
    (9, "another text of the same id"),
    (-5, "ab\0c \U0001f600 ▁ end"),
]


def _docs(spark, rows=ROWS):
    full = [(i, t, None, "src0", None if t is None else len(t), 7, "x", 1, "y", 0.5, 3, "s", None) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def _labels(spark):
    rows = [(1, 1, 0), (2, 1, 0), (3, 0, 0), (5, None, 0), (None, 0, 1), (7, 1, None), (7, 0, 0), (100, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def _benchmark(spark):
    rows = [(0, PASSAGE), (1, None), (2, ""), (3, "x"), (4, PASSAGE)]
    return spark.createDataFrame(rows, "item_id long, text string")


OPERATORS = {
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "chains": lambda s, d: chains.duplicate_passages(d),
    "quality": lambda s, d: quality.scores(d, _labels(s)),
    "decontaminate": lambda s, d: decontaminate.contamination(d, _benchmark(s)),
    "pii": lambda s, d: pii.pseudonymise(d, PII_KEY),
    "pieces": lambda s, d: pieces.encode_documents(d, PIECE_MODEL),
    "suffixes": lambda s, d: suffixes.remove_repeated(d),
    "merkle": lambda s, d: merkle.compare_with_next(d),
    "licenses": lambda s, d: licenses.scan(d),
    "html": lambda s, d: html.extract_main_text(d, "text", ("doc_id", "source")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_input_row(spark, name):
    found = OPERATORS[name](spark, _docs(spark)).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(i) for i, _ in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](spark, _docs(spark).where("false")).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_tables_of_nothing_but_nulls(spark, name):
    assert OPERATORS[name](spark, _docs(spark, [(None, None), (None, None)])).count() == 2


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, tmp_path, name, stage):
    folder = str(tmp_path)
    _labels(spark).write.parquet(f"{folder}/labels.parquet")
    _benchmark(spark).write.parquet(f"{folder}/benchmark.parquet")
    docs = _docs(spark)
    out = stage(spark, docs, folder)
    if stage is not corpus_pipeline.encode:
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert {r["doc_id"] for r in out.select("doc_id").collect()} <= {i for i, _ in ROWS}
    assert stage(spark, docs.where("false"), folder).count() == 0


def test_defined_results(spark):
    docs = _docs(spark)
    at = lambda df: {(r["doc_id"]): r for r in df.collect() if r["doc_id"] is not None}
    near = at(simhash.near_duplicates(docs))
    assert near[2]["component_id"] == 1 and near[3]["fingerprint"] == "0" * 16 and near[4]["component_id"] == 3
    cut = at(suffixes.remove_repeated(docs))
    assert cut[2]["n_removed"] == len(PROSE) and cut[1]["n_removed"] == 0 and cut[4]["n_bytes"] == 0 and cut[5]["n_removed"] == 0
    assert cut[8]["n_removed"] == 0  # rows of one id don't remove each other
    nameless = [r for r in suffixes.remove_repeated(docs).collect() if r["doc_id"] is None]
    assert sorted(r["n_removed"] for r in nameless) == [0, len(PROSE)]
    leaks = at(decontaminate.contamination(docs, _benchmark(spark)))
    assert leaks[6]["items"] == [0, 4] and not leaks[1]["contaminated"] and leaks[4]["items"] == []
    linked = at(chains.duplicate_passages(docs))
    assert linked[7]["class_id"] == 6 and linked[7]["n_links"] == 1 and linked[6]["passages"] == [] and linked[3]["class_id"] == 3
    held = at(pii.pseudonymise(docs, PII_KEY))
    assert held[8]["kinds"] == ["card", "email"] and held[4]["text"] is None and held[1]["text"] == PROSE
    ids = at(pieces.encode_documents(docs, PIECE_MODEL))
    assert ids[3]["ids"] == [] and all(r["round_trip"] for r in ids.values())
    scored = at(quality.scores(docs, _labels(spark)))
    assert all(0 <= r["score"] <= 1 for r in scored.values())


def test_one_of_each_group_stays(spark):
    kept = simhash.keep_one(_docs(spark))
    found = sorted(str(r["doc_id"]) for r in kept.collect())
    # 2 copies 1, and 7 is like 6; 4 and a null text are as empty as 3, so is one row of 9, the other stays; 8 comes twice
    assert found == sorted(map(str, [1, 3, 5, 6, 8, 9, -5]))
    only = simhash.keep_one(_docs(spark, [(None, PROSE), (None, PROSE), (None, "other words here")]))
    assert sorted(r["text"] for r in only.collect()) == sorted([PROSE, "other words here"])


def test_labels_without_two_classes(spark):
    labels = _labels(spark).withColumn("quality", F.lit(1))
    assert quality.scores(_docs(spark), labels).where("score <= 0.9").count() == 0
    none = quality.scores(_docs(spark), labels.where("false"))
    assert {r["score"] for r in none.collect()} == {0.5}
