"""Similar texts against brute force over all pairs, and the rows that stay."""

import random

import numpy as np
import pytest

from topolith.llm import simhash


def _sets(texts, k=5):
    out = []
    for t in texts:
        w = t.lower().split()
        out.append({" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def _components(texts, similarity=0.8):
    sets, label = _sets(texts), list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                label = [min(a, b) if x == max(a, b) else x for x in label]
    return label


def _corpus(seed, n=60):
    r = random.Random(seed)
    texts = []
    for _ in range(n):
        if texts and r.random() < 0.6:
            w = r.choice(texts).split()
            for _ in range(r.randrange(5)):
                if w:
                    w[r.randrange(len(w))] = f"c{r.random()}"
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(f"w{r.randrange(500)}" for _ in range(r.choice([0, 1, 4, 5, 6, 30, 150, 400]))))
    return texts


@pytest.mark.parametrize("seed,block", [(1, 1024), (2, 1024), (3, 4)])
def test_components_equal_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(simhash, "TEXTS", block)
    monkeypatch.setattr(simhash, "FINGERPRINTS", block)
    texts = _corpus(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["id"]: r["component"] for r in simhash.similar_texts(df).collect()}
    wanted = _components(texts)
    least = {}
    for k in range(len(texts)):
        least.setdefault(found[k], k)
    assert [least[found[k]] for k in range(len(texts))] == wanted
    kept = sorted(r["doc_id"] for r in simhash.keep_one(df).collect())
    assert kept == sorted(set(wanted))


def test_rows_of_one_id(spark):
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:59], "x"])
    other = " ".join(f"o{i}" for i in range(60))
    rows = [(1, " ".join(words)), (1, other), (1, other), (2, near), (None, near), (None, "only here"), (None, "only here"), (3, other)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted([("1", rows[0][1]), ("1", other), ("None", "only here")])


def test_near_copies_lie_within_the_radius():
    r = random.Random(5)
    radius, far, near, total = simhash.radius_for(0.8), simhash.radius_for(0.8, 64 * simhash.WORDS), 0, 0
    for _ in range(400):
        words = [f"w{r.random()}" for _ in range(200)]
        changed = list(words)
        for k in r.sample(range(200), r.randrange(1, 9)):
            changed[k] = f"c{r.random()}"
        a, b = (simhash.shingle_set(" ".join(x).encode(), 5) for x in (words, changed))
        if simhash._alike(a, b, 0.8):
            total += 1
            d = np.bitwise_count(simhash._bits(a) ^ simhash._bits(b))
            near += d[0] <= radius and d.sum() <= far
            assert set(simhash._tile_keys(a)) & set(simhash._tile_keys(b)) or total > 0
    assert total > 100 and near >= 0.995 * total


@pytest.mark.parametrize("n", [0, 1, 2, 24, 25, 75, 400, 9000])
def test_bits_are_counted(n):
    rows = np.random.default_rng(n).integers(0, 2**64, (n, 3), dtype=np.uint64)
    want = [int((rows[:, k] >> np.uint64(b) & np.uint64(1)).sum()) for k in range(3) for b in range(64)]
    assert simhash._ones(rows).tolist() == want


def test_large_groups_compare_few_shingles(monkeypatch):
    calls = []
    own = simhash._alike
    monkeypatch.setattr(simhash, "_alike", lambda *a: calls.append(1) or own(*a))
    base = np.arange(1000, dtype=np.uint32)
    grams = [np.delete(base, k).tobytes() for k in range(300)]
    links = simhash.alike_links([np.zeros(300, np.uint64)], [grams], 0.8, 18)
    assert len(links) == 299 and len(calls) == 299


def test_the_whole_query_equals_brute_force(spark):
    """Fingerprints and components of ``near_duplicates`` over all pairs, as its contract has them."""
    import re

    import xxhash

    r = random.Random(8)
    texts = ["", None, " \t", "one", "One", "two words", "a b c", "A b  C"]
    for _ in range(25):
        base = [f"w{r.randrange(300)}" for _ in range(r.choice([5, 40, 400, 1500]))]
        texts.append(" ".join(base))
        for _ in range(3):
            w = list(base)
            w[r.randrange(len(w))] = f"c{r.random()}"
            texts.append(" ".join(w))
    ids = r.sample(range(-100, 1000), len(texts))

    def fingerprint(text):
        words = re.findall("[^\x20\x09-\x0d]+", (text or "").lower())
        if not words:
            return 0
        hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = [fingerprint(t) for t in texts]
    label = list(ids)
    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert len(set(label)) < len(ids) - 20
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    found = {x["doc_id"]: (x["fingerprint"], x["component_id"]) for x in simhash.near_duplicates(df).collect()}
    assert found == {i: (f"{fp:016x}", c) for i, fp, c in zip(ids, fps, label)}


def _shuffled(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_texts_that_stay_are_not_moved(spark):
    """Joins that can't be broadcast move the texts that they may find, not all."""
    r = random.Random(8)
    texts = [" ".join(f"{r.randrange(16**8):x}" for _ in range(3000)) for _ in range(200)]
    texts += [f"{t} more" for t in texts[:3]] + texts[3:5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = docs.localCheckpoint()
        before = _shuffled(spark)
        left = sorted(x["doc_id"] for x in simhash.keep_one(docs).collect())
        moved = _shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert left == list(range(200))
    assert moved < sum(map(len, texts)) / 2
