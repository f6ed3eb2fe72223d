"""The whole pipeline on a small corpus, each stage against what it must keep."""

import random

import pytest

import corpus_pipeline
from topolith.llm import decontaminate, pieces, pii, quality
from topolith.llm.settings import PIECE_MODEL, PII_KEY
from tests.llm.test_similar import _components


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(11)
    nouns = ["river", "stone", "garden", "window", "letter", "harbour", "valley", "orchard", "market", "winter", "teacher", "castle"]
    verbs = ["crossed", "followed", "remembered", "painted", "carried", "opened", "described", "repaired"]

    def prose(n):
        return " ".join(f"the {r.choice(nouns)} {r.choice(verbs)} a {r.choice(nouns)} near {r.choice(nouns)}{r.randrange(60)}" for _ in range(n))

    good = [prose(r.randrange(6, 14)) for _ in range(50)]
    junk = [" ".join(r.choice(["BUY!!!", "$$$", "CLICK", "####", "FREE"]) for _ in range(40)) for _ in range(30)]
    items = [prose(7) for _ in range(4)]
    texts = list(good)
    for k in range(10):  # near copies
        w = good[k].split()
        w[-1] = f"end{k}"
        texts.append(" ".join(w))
    texts += [good[0], good[1]]
    leaking = len(texts)
    texts += [f"{prose(4)} {items[k]} {prose(4)}" for k in range(4)]
    texts += junk
    texts += [f"{prose(8)} write to jane.doe{k}@example.com or pay with 4111111111111111" for k in range(5)]
    r.shuffle(texts)
    labels = [(k, int("$$$" not in t and "CLICK" not in t), 0) for k, t in enumerate(texts)]
    return texts, labels, items


def test_run_equals_its_stages_by_hand(spark, tmp_path, corpus):
    texts, labels, items = corpus
    folder = str(tmp_path)
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    score = model.scorer()
    kept = [k for k, t in enumerate(texts) if score(t.encode()) >= 0.3]
    assert sum("CLICK" in texts[k] for k in kept) == 0 and sum("CLICK" not in t for t in texts) == len(kept)
    label = _components([texts[k] for k in kept])
    kept = [k for i, k in enumerate(kept) if label[i] == i]
    index = decontaminate.Index(list(enumerate(items)))
    kept = [k for k in kept if not index.leaks([decontaminate.normal(texts[k])])[0]]
    assert not any(item in texts[k] for k in kept for item in items)
    assert sorted(found) == kept
    clean = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs.where(docs["doc_id"].isin(kept)), PII_KEY).collect()}
    assert not any("4111111111111111" in t or "jane" in t for t in clean.values())
    encoder = pieces.Encoder(pieces.Vocabulary.load(PIECE_MODEL))
    for k in kept:
        ids, _ = encoder.encode([clean[k]])
        assert found[k]["ids"] == ids.tolist() and found[k]["round_trip"]


def test_what_a_stage_stores_goes_with_it(spark, tmp_path, corpus):
    from topolith.operators.materialize import Stored, scratch

    made = []
    with scratch():
        held = Stored(spark.range(3)).keep()
        made.append(Stored(spark.range(4)))
    fs = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p))
    assert fs(held.path) and not fs(made[0].path) and held.df.count() == 3
    held.drop()
    assert not fs(held.path)
