"""Leaks of items against brute force: long, short and odd items, blocks of items, and nothing else found."""

import random

import numpy as np
import pytest

from topolith.llm import decontaminate
from topolith.llm.decontaminate import Rule


def _least_edits(window, text):
    """Fewest edits between a window and any stretch of a text."""
    row = np.zeros(len(text) + 1, int)
    a = np.frombuffer(text, np.uint8)
    for i, c in enumerate(window, 1):
        step = np.minimum(row[:-1] + (a != c), row[1:] + 1)
        new = np.concatenate(([i], step))
        for j in range(1, len(new)):
            new[j] = min(new[j], new[j - 1] + 1)
        row = new
    return int(row.min())


def _leaks(item, text, rule):
    w = min(len(item), rule.window)
    e = max(0, min(int(w * rule.rate), (w - decontaminate.Q) // decontaminate.Q))
    return any(_least_edits(item[k : k + w], text) <= e for k in range(len(item) - w + 1))


@pytest.mark.parametrize("seed", range(4))
def test_found_items_equal_brute_force(seed):
    r = random.Random(seed)
    rule = Rule(window=40, rate=0.1)
    word = lambda n: "".join(r.choice("abcd") for _ in range(n))
    items = [" ".join(word(r.randrange(1, 6)) for _ in range(r.randrange(4, 20))) for _ in range(12)]
    index = decontaminate.Index(list(enumerate(items)), rule)
    for _ in range(12):
        source = r.choice(items)
        a = r.randrange(len(source))
        piece = list(source[a : a + r.randrange(10, 70)])
        for _ in range(r.randrange(6)):
            piece[r.randrange(len(piece))] = r.choice("wxyz")
        text = decontaminate.normal(" ".join(word(4) for _ in range(8)) + " " + "".join(piece) + " " + word(5))
        found = {i for i, *_ in index.leaks([text])[0]}
        assert found == {k for k, item in enumerate(index.texts) if _leaks(item, text, rule)}


def test_short_items_are_found_as_whole_words():
    index = decontaminate.Index([(0, "x"), (1, "Yes, no"), (2, "..."), (3, ""), (4, "x")])
    found = index.leaks([decontaminate.normal(t) for t in ("a fox", "an X here", "say yes no more", "yes and no", "")])
    assert [sorted(i for i, *_ in f) for f in found] == [[], [0, 4], [1], [], []]
    assert found[2][0] == (1, 0, 4, 10)


def test_long_items_are_aligned_in_parts():
    r = random.Random(7)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(20_000)]
    index = decontaminate.Index([(0, " ".join(words))])
    copy = words[9000:9030]
    copy[11] = "other"
    noise = ["".join(r.choice("klmnopq") for _ in range(6)) for _ in range(300)]
    texts = [" ".join(noise[:100] + copy + noise[100:]), " ".join(words[100:6000]), " ".join(noise), " ".join(words[5:9])]
    found = index.leaks([decontaminate.normal(t) for t in texts])
    assert [[i for i, *_ in f] for f in found] == [[0], [0], [], []]
    (_, edits, begin, end) = found[0][0]
    assert edits <= 6 and begin <= 700 + 8 and end >= 700 + 29 * 7 - 8
    assert found[1][0] == (0, 0, 0, len(texts[1]))


@pytest.mark.parametrize("kind", ["smallint", "int", "long", "string", "date", "decimal(10,2)"])
def test_ids_of_any_kind(spark, kind):
    items = spark.createDataFrame([("2020-01-02", "the quick brown fox jumps over it")], "d string, text string")
    value = "cast(d as date)" if kind == "date" else "d" if kind == "string" else f"cast(7 as {kind})"
    items = items.selectExpr(f"{value} as item_id", "text")
    docs = spark.createDataFrame([(1, "see the quick brown fox jumps over it all"), (2, None)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in decontaminate.contamination(docs, items).collect()}
    assert found[1]["items"] == [items.first()["item_id"]] and not found[2]["contaminated"]


def test_blocks_give_what_one_block_gives(spark, monkeypatch):
    r = random.Random(9)
    items = [" ".join("".join(r.choice("abcdef") for _ in range(5)) for _ in range(20)) for _ in range(9)]
    docs = [(k, f"some words {items[k % 9]} and more {items[(k + 1) % 9] if k % 2 else ''}") for k in range(12)] + [(99, "none")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    told = lambda: {x["doc_id"]: (x["items"], sorted(map(tuple, x["leaks"]))) for x in decontaminate.contamination(*frames).collect()}
    whole = told()
    monkeypatch.setattr(decontaminate, "BLOCK", 300)
    assert told() == whole and len(whole[1][0]) == 2
