"""The methods themselves, against brute force, exact round trips and known facts."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from topolith.llm import chains, decontaminate, html, licenses, merkle, pieces, pii, quality, simhash, suffixes
from topolith.llm.settings import PIECE_MODEL


def _texts(seed, n=40, words=120, vocabulary=60):
    r = random.Random(seed)
    names = [f"w{i}" for i in range(vocabulary)]
    out = []
    for _ in range(n):
        t = [r.choice(names) for _ in range(r.randrange(words))]
        if out and r.random() < 0.5:
            old = r.choice(out).split(" ")
            a = r.randrange(len(old))
            t[r.randrange(len(t) + 1) : 0] = old[a : a + r.randrange(60)]
        out.append(" ".join(t))
    return out


def _frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


# html


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body>
    <header>Site</header><nav><ul><li><a href=x>Menu one</a><li>Menu two</ul></nav><div class="cookie-notice">We use cookies</div>
    <div id=main><h1>Title &amp; more</h1><p>First   paragraph<br>goes on with enough words to count as content here.<p>Second&nbsp;one, &#169; 2020
    follows with <b>bold <i>and</i></b> plain words in a row.<div class="ad">Buy now</div><p>Short.</p></div>
    <aside>Side</aside><section class="comments"><p>A reader's long comment that goes on and on, much longer than anything else here.</p></section>
    <form><input value=x><label>Name</label></form><footer>&copy; us</footer></body></html>"""
    assert html.extract(page).split("\n\n") == [
        "Title & more",
        "First paragraph goes on with enough words to count as content here.",
        "Second one, © 2020 follows with bold and plain words in a row.",
        "Short.",
    ]


@pytest.mark.parametrize("page,text", [("", ""), ("<p>", ""), ("plain", "plain"), ("<p>a &am", "a"), ("<article><p>x</article>", "x"), ("a<br><br>b", "a\n\nb"), ("<p>1 < 2 & 3</p>", "1 < 2 & 3"), ("<div class='nav'>m</div>", ""), ("<p>cut <a hre", "cut")])
def test_odd_pages(page, text):
    assert html.extract(page) == text


LONG = [f"Sentence {k} of the text goes on with enough plain words to count as content of the page." for k in range(6)]


def test_dropped_siblings_do_not_cut_an_article():
    dropped = "<div class=share>Share</div><div class=advert>Buy</div><form>Mail</form>"
    before, after = ("".join(f"<p>{x}</p>" for x in part) for part in (LONG[:2], LONG[2:]))
    page = f"<body><div id=a>{before}{dropped}{after}{dropped}<p>Last.</p></div>{dropped}<div>Imprint of the site</div></body>"
    assert html.extract(page).split("\n\n") == [*LONG, "Last."]
    bare = f"<body>{before}{dropped}{after}{dropped}</body>"
    assert html.extract(bare).split("\n\n") == LONG


def test_small_articles_do_not_replace_the_text_outside():
    cards = "".join(f"<article><h3>Card {k}</h3><p>A teaser.</p></article>" for k in range(3))
    body = "".join(f"<p>{x}</p>" for x in LONG)
    assert html.extract(f"<body><div id=a>{body}</div><div>{cards}</div></body>").split("\n\n") == LONG
    # an article that holds most of the text wins
    assert html.extract(f"<body><article>{body}</article><div><p>{LONG[0]} Again.</p></div></body>").split("\n\n") == LONG
    # many articles against one text that is larger than each: both stay
    many = "".join(f"<article><p>{x}</p></article>" for x in LONG)
    assert html.extract(f"<body><div><p>{'More. ' * 30}</p></div>{many}</body>").split("\n\n") == [("More. " * 30).strip(), *LONG]
    # an article within the text's own container is part of it
    assert html.extract(f"<body><div>{body}<article><p>Quoted.</p></article><p>{LONG[0]}</p></div></body>").split("\n\n") == [*LONG, "Quoted.", LONG[0]]


@given(st.text(alphabet="<>/p a&;\"'div!-=brscript", max_size=80))
@settings(max_examples=300, deadline=None)
def test_any_markup_is_survived(page):
    html.extract(page)


# simhash


def _plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@given(st.lists(st.sampled_from(["a", "B", "é", "\n", " ", "\t", "Ç", "word"]), max_size=40))
@settings(max_examples=200, deadline=None)
def test_fingerprints(parts):
    text = "".join(parts)
    assert simhash.simhash(text.encode()) == _plain_fingerprint(text)


@pytest.mark.parametrize("block", [4, 2048])
def test_links_give_the_components_of_all_pairs(spark, block):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = {f for b in base for f in (b, b ^ (1 << r.randrange(64)), b ^ (3 << r.randrange(60)), b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))} | {0, 2**64 - 1}
    fps = np.array(sorted(fps), np.uint64)
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)):
        a, b = find(int(i)), find(int(j))
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = simhash.tile_links(df, block=block).collect()
    mine = list(range(len(fps)))
    at = {int(x): k for k, x in enumerate(fps.view(np.int64))}

    def home(x):
        while mine[x] != x:
            x = mine[x]
        return x

    for l in links:
        a, b = home(at[l["src"]]), home(at[l["dst"]])
        mine[max(a, b)] = min(a, b)
    assert [home(k) for k in range(len(fps))] == [find(k) for k in range(len(fps))]


# suffixes


def _removed(texts, length=50):
    first, out = {}, []
    for i, t in enumerate(texts):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if first.setdefault(b[s : s + length], i) < i:
                gone[s : s + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed,length", [(1, 50), (2, 50), (3, 20), (4, 120)])
def test_repeated_bytes_equal_brute_force(spark, seed, length):
    texts = _texts(seed) + ["aaaa" * 60, "aaaa" * 50 + "b", "é" * 90, "x" + "é" * 80, "z" * length, "z" * length]
    found = suffixes.remove_repeated(_frame(spark, texts), length=length).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in found] == _removed(texts, length)


@given(st.lists(st.binary(min_size=16, max_size=24).map(lambda b: bytes(x & 1 for x in b)), max_size=30))
@settings(max_examples=150, deadline=None)
def test_suffix_order(strings):
    buffer = np.frombuffer(b"".join(strings) + b"\0", np.uint8)
    size = np.array([len(s) for s in strings], np.int64)
    order, common = suffixes.sort_suffixes(buffer, np.cumsum(size) - size, size)
    got = [strings[i] for i in order]
    assert got == sorted(strings)
    for a, b, n in zip(got, got[1:], common[1:]):
        assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


@given(st.lists(st.tuples(*[st.sampled_from([0, 1, 2, 2**63, 2**64 - 1])] * 3), max_size=40))
@settings(max_examples=200, deadline=None)
def test_multikey_quicksort(rows):
    order = suffixes.multikey_quicksort(np.array(rows, np.uint64).reshape(-1, 3))
    assert order.tolist() == sorted(range(len(rows)), key=lambda i: rows[i])


def test_groups_of_documents_are_alike_in_columns_and_arrays(spark):
    ids = [0, 1, -1, 7, 2**62, -(2**63), 2**63 - 1, *range(0, 4096 * 64, 4096)]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "ord long, text string").withColumn("tag", suffixes.tag_column())
    rows = df.select("ord", "tag", suffixes.group_column(13).alias("g")).collect()
    got = suffixes.group_of(np.array([r["ord"] for r in rows]), np.array([r["tag"] for r in rows]), 13)
    assert got.tolist() == [r["g"] for r in rows] and len(set(got.tolist())) == 13


@given(st.lists(st.binary(max_size=12).map(lambda b: bytes(x & 1 for x in b)), min_size=1, max_size=40, unique=True))
@settings(max_examples=200, deadline=None)
def test_blind_trie(strings):
    order, shared = suffixes.BlindTrie(strings).order()
    assert [strings[i] for i in order] == sorted(strings)
    for a, b, n in zip(sorted(strings), sorted(strings)[1:], shared[1:]):
        assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


def test_spans_and_texts(spark):
    shared = "the very same fifty and more bytes stand in both of these texts, no less"
    df = _frame(spark, [f"one {shared} end", f"two {shared} fin"])
    found = suffixes.remove_repeated(df, outputs=("kept_text", "spans")).orderBy("doc_id").collect()
    assert found[0]["spans"] == [] and found[1]["kept_text"] == "twofin"


# chains


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_exact_passages_are_joined(spark, seed):
    texts = _texts(seed, n=50, words=150, vocabulary=5000)
    r = random.Random(seed)
    for k in range(0, 40, 4):
        src = texts[k].split(" ")
        if len(src) > 60:
            texts.append(" ".join([f"n{r.random()}" for _ in range(9)] + src[3:58] + ["tail"] * 3))
    found = {x["doc_id"]: x for x in chains.duplicate_passages(_frame(spark, texts)).collect()}
    words = [t.encode().lower().split() for t in texts]
    first = {}
    for i, w in enumerate(words):
        for s in range(len(w) - 49):
            j = first.setdefault(tuple(w[s : s + 50]), i)
            assert found[i]["class_id"] == found[j]["class_id"]
            if j != i:
                assert found[i]["n_links"] > 0


def test_fuzzy_passages_are_found_with_their_places(spark):
    r = random.Random(5)
    base = [f"p{i}" for i in range(80)]
    changed = list(base)
    changed[30] = "other"
    del changed[55]
    texts = [" ".join([f"a{r.random()}" for _ in range(40)] + base), " ".join([f"b{r.random()}" for _ in range(7)] + changed + ["end"] * 5), " ".join(f"c{r.random()}" for _ in range(200))]
    found = {x["doc_id"]: x for x in chains.duplicate_passages(_frame(spark, texts)).collect()}
    (p,) = found[1]["passages"]
    assert (p["earlier"], p["begin"], p["stop"], p["from_begin"], p["from_stop"], p["equal"]) == (0, 7, 86, 40, 120, 78)
    assert found[2]["n_links"] == 0 and found[2]["class_id"] == 2


@pytest.mark.parametrize("sizes", [(1000, 100, 300), (100, 20, 60), (100, 20, 60, 15, 50), (60, 200, 70)])
def test_stretches_after_a_stretchs_best_point_are_kept(sizes):
    x = np.arange(sum(sizes), dtype=np.uint32)
    y, ends = x.copy(), np.cumsum(sizes)
    for end, n in zip(ends[1::2], sizes[1::2]):
        y[end - n : end] += 10**6
    spots = np.array([(i, i) for end, n in zip(ends[::2], sizes[::2]) for i in (end - n, end - 1)])
    expected = [(end - n, end, end - n, end, n) for end, n in zip(ends[::2].tolist(), sizes[::2])]
    assert chains.passages(x, y, spots, chains.Passages()) == expected


def test_short_common_phrases_do_not_link(spark):
    r = random.Random(6)
    phrase = " ".join(f"q{i}" for i in range(30))
    texts = [" ".join([f"{k}x{r.random()}" for _ in range(60)]) + " " + phrase for k in range(12)]
    assert all(x["n_links"] == 0 for x in chains.duplicate_passages(_frame(spark, texts)).collect())


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=14, unique=True))
@settings(max_examples=200, deadline=None)
def test_best_chain_equals_brute_force(spots):
    spots = sorted(spots)
    best = {}
    for i, (a, b) in enumerate(spots):
        best[i] = chains.WORTH
        for j in range(i):
            c, d = spots[j]
            if c < a and d < b:
                best[i] = max(best[i], best[j] + chains.WORTH - chains.GAP * (a - c + b - d))
    a, b = (np.array(x) for x in zip(*spots))
    (first, *_) = chains.chains(a, b, 0.0)
    got = len(first) * chains.WORTH - chains.GAP * (first[-1] - first[0]).sum()
    assert abs(got - max(best.values())) < 1e-9
    assert all((np.diff(first, axis=0) > 0).all(axis=1)) if len(first) > 1 else True


# quality


def test_held_out_accuracy():
    r = random.Random(1)
    good = [" ".join(r.choice(["river", "stone", "garden", "window", "letter"]) + r.choice(["s", "ed", ""]) for _ in range(40)) for _ in range(150)]
    bad = [" ".join(r.choice(["BUY!!", "###", "$$$ now", "CLICK!!"]) for _ in range(40)) for _ in range(75)] + ["same " * 60 + x for x in map(str, range(75))]
    texts, labels = good + bad, [1] * 150 + [0] * 150
    order = r.sample(range(300), 300)
    model = quality.train([texts[k].encode() for k in order[:200]], [labels[k] for k in order[:200]])
    score = model.scorer()
    assert sum((score(texts[k].encode()) >= 0.3) == labels[k] for k in order[200:]) >= 95
    again = quality.train([texts[k].encode() for k in order[:200]], [labels[k] for k in order[:200]])
    assert (again.weight == model.weight).all()


def test_folding_the_layer_changes_no_score():
    s = quality.Settings(bits=10, epochs=2)
    texts, labels = [b"aa bb cc", b"dd ee dd", b"aa aa", b"ee"], [1, 0, 1, 0]
    model, features = quality.train(texts, labels, s), quality.Features(s)
    for t in texts:
        ids, counts = features.counted(t)
        z = model.bias + float(model.weight[ids] @ counts) / counts.sum()
        assert abs(model.scorer()(t) - 1 / (1 + np.exp(-z))) < 1e-6


# decontamination


def test_copies_within_the_edit_budget_are_found():
    r = random.Random(2)
    item = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(30))
    index = decontaminate.Index([(7, item), (8, "short item text")])
    noise = " ".join("".join(r.choice("ijklmnop") for _ in range(6)) for _ in range(200))
    words = item.split()
    words[4], words[20] = "zzzzzz", "yyy"
    for text, hit in ((item.upper(), True), (" ".join(words), True), (" ".join(words[:8]), False), (" ".join(words[5:21]), True), ("", False)):
        found = index.leaks([decontaminate.normal(f"{noise} {text}! {noise}")])[0]
        assert any(i == 0 for i, *_ in found) == hit
    assert index.leaks([b"so this short item text is here"])[0][0][0] == 1


@given(st.lists(st.sampled_from("abc "), min_size=40, max_size=60), st.integers(0, 3), st.randoms(use_true_random=False))
@settings(max_examples=60, deadline=None)
def test_no_copy_within_the_budget_is_lost(letters, edits, r):
    item = decontaminate.normal("".join(letters))
    rule = decontaminate.Rule(window=30, rate=0.1)
    index = decontaminate.Index([(0, item.decode())], rule)
    if len(item) < 30:
        return
    a = r.randrange(len(item) - 29)
    piece = bytearray(item[a : a + 30])
    for _ in range(min(edits, int(index.edits[0]))):
        k = r.randrange(len(piece))
        r.choice([lambda: piece.__setitem__(k, 120), lambda: piece.insert(k, 121), lambda: piece.pop(k)])()
    assert index.leaks([b"q" * 20 + bytes(piece) + b"r" * 20])[0]


# pii


def test_pseudonyms_are_valid_linked_and_distinct(spark):
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    r = random.Random(4)
    cards = set()
    while len(cards) < 60:
        body = "4" + "".join(r.choice("0123456789") for _ in range(14))
        cards.add(next(body + c for c in "0123456789" if luhn(body + c)))
    dates = [f"{y}-{m:02}-{d:02}" for y in (1900, 1999, 2024, 2099) for m in (1, 2, 12) for d in (1, 28)]
    ips = [f"{r.randrange(256)}.{r.randrange(256)}.{k}.{r.randrange(256)}" for k in range(40)]
    ssns = [f"{a:03}-{g:02}-{s:04}" for a in (1, 665, 667, 899) for g in (1, 99) for s in (1, 9999)]
    given_ = sorted(cards) + dates + ips + ssns
    rows = [(k, f"x {v} y", v) for k, v in enumerate(given_)]
    found = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string, v string"), "k").collect()
    images = {x["v"]: x["text"][2:-2] for x in found}
    assert all(x["n_replaced"] == 1 for x in found)
    assert len(set(images.values())) == len(given_)  # one to one
    assert all(luhn(images[c]) and images[c][0] == "4" and len(images[c]) == 16 for c in cards)
    import datetime

    assert all(1900 <= datetime.date.fromisoformat(images[d]).year <= 2099 for d in dates)
    assert all(all(0 <= int(o) < 256 for o in images[i].split(".")) for i in ips)
    assert all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", images[s]) for s in ssns)


def test_equal_values_stay_linked_and_keys_matter(spark):
    rows = [(0, "4111111111111111"), (1, "4111-1111-1111-1111 then 4111 1111 1111 1111"), (2, "DE89 3704 0044 0532 0130 00 and DE89370400440532013000"), (3, "4111111111111112 1.2.3.400 2021-02-30 000-12-3456"), (4, "Ann@Example.com ann@example.com")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = ({r["doc_id"]: r["text"] for r in pii.pseudonymise(df, k).collect()} for k in ("a", "b"))
    assert {re.sub(r"\D", "", x) for x in one[1].split(" then ")} == {one[0]} and one[0] != two[0]
    a, b = one[2].split(" and ")
    assert a.replace(" ", "") == b and b[:2] == "DE"
    assert int("".join(str(int(c, 36)) for c in b[4:] + b[:4])) % 97 == 1
    assert one[3] == rows[3][1]
    x, y = one[4].split(" ")
    assert x.lower() == y


def test_native(spark):
    df = spark.createDataFrame([(0, "a@b.co")], "doc_id long, text string")
    for out in (pii.pseudonymise(df, "k"), licenses.scan(df)):
        plan = out._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan)


# pieces


def test_ids_equal_those_of_the_public_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    m = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    encoder = pieces.Encoder(pieces.Vocabulary.load(PIECE_MODEL))
    r = random.Random(1)
    texts = ["", " ", "   a  ", "Hello  wörld\n\tx y é", "a" * 3000, " " * 70, "0" * 40, "漢字😀\n\n", "\x00", *_texts(9)]
    texts += ["".join(r.choice("aabbcethino  \n\té漢😀.,-_=/012") for _ in range(r.randrange(80))) for _ in range(800)]
    ids, stops = encoder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(stops, stops[1:])] == m.encode(texts)
    assert [encoder.v.decode(ids[a:b].tolist()) for a, b in zip(stops, stops[1:])] == texts


def test_decoding_a_frame(spark):
    texts = ["one two", "", "drei\nvier"]
    encoded = pieces.encode_documents(_frame(spark, texts), PIECE_MODEL)
    back = pieces.decode_documents(encoded, PIECE_MODEL)
    assert [r["text"] for r in back.orderBy("doc_id").collect()] == texts


# merkle


def test_edits_are_located():
    a = "one line. two parts.\nsecond line\n\nnext section\nits end"
    assert merkle.differing(a, a) == []
    assert merkle.differing(a, a.replace("second", "2nd")) == [(0, 1)]
    assert merkle.differing(a, a.replace("its end", "")) == [(1, 1)]
    assert merkle.fingerprint(a) == merkle.fingerprint(str(a))
    assert merkle.fingerprint(a) != merkle.fingerprint(a + " ")


@given(st.one_of(st.text(max_size=400), st.text(alphabet=" \n\tab.e\r\x0b", max_size=200)))
@settings(max_examples=300, deadline=None)
def test_blocks_lose_nothing(text):
    cut = merkle.paragraphs(text)
    assert "".join(line + after for line, after in cut) == text
    for line, _ in cut:
        assert "".join(merkle.blocks(line)) == line and "\n" not in line


@given(st.lists(st.text(alphabet=" \nae.", max_size=40), min_size=2, max_size=12, unique=True))
@settings(max_examples=200, deadline=None)
def test_roots_tell_texts_apart_by_the_tree_alone(texts):
    roots = [merkle.tree(t)[0] for t in texts]
    assert len(set(roots)) == len(texts)
    for t, root in zip(texts, roots):
        nodes = [h for h, _ in merkle.tree(t)[1]]
        assert root == hashlib.sha256("/".join(nodes).encode()).hexdigest()[: merkle.ROOT]


@pytest.mark.parametrize("seed", range(6))
def test_likeness_down_the_tree_equals_that_of_all_blocks(seed):
    from collections import Counter

    r = random.Random(seed)
    lines = [" ".join(r.choice(["stone", "river", "and", "of", "light.", "tree"]) for _ in range(r.randrange(1, 30))) for _ in range(12)]
    a, b = ("".join(x + r.choice(["\n", "\n\n", "\n \n\n"]) for x in r.choices(lines, k=r.randrange(1, 14))) for _ in range(2))
    x, y = (Counter(block for line, _ in merkle.paragraphs(t) for block in merkle.blocks(line)) for t in (a, b))
    both = sum((x & y).values())
    assert merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(b)) == both / (sum(x.values()) + sum(y.values()) - both)
    assert merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(a)) == 1.0
    assert merkle.likeness(merkle.fingerprint(a), merkle.fingerprint("")) == 0.0


def test_a_single_sentence_is_like_its_first_half():
    text = "The stone near the old river gate had been set there by hands that nobody could name"
    changed = merkle.edited(text, "Quite another document begins with words of its own, all of them unlike the first")
    assert 0.1 < merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(changed)) < 0.7


@pytest.mark.parametrize("partitions", [1, 3, 9])
def test_edited_texts_follow_descending_ids(spark, partitions):
    texts = _texts(8, n=25)
    ids = random.Random(2).sample(range(-50, 400), 25)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
        found = {r["doc_id"]: r for r in merkle.compare_with_next(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    order = sorted(zip(ids, texts), reverse=True)
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        changed = t[: len(t) - half] + n[:half]
        assert found[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert found[i]["near_edited"] == merkle.likeness(merkle.fingerprint(t), merkle.fingerprint(changed))
        assert 0 <= found[i]["near_next"] <= 1


# licenses


def test_scan_equals_brute_force(spark):
    r = random.Random(3)
    noise = [f"n{i}" for i in range(300)]
    texts = []
    for name, t in licenses.TEMPLATES.items():
        words = t.split()
        cut = list(words)
        for k in r.sample(range(len(cut)), max(1, len(cut) // 40)):
            cut[k] = "changed"
        for body in (words, cut, words[: int(len(words) * 0.9)], words[: len(words) // 2]):
            texts.append(" ".join([r.choice(noise) for _ in range(r.randrange(90))] + body + [r.choice(noise) for _ in range(r.randrange(90))]))
    texts += ["license software copyright " * 30, ""]
    found = licenses.scan(_frame(spark, texts)).orderBy("doc_id").collect()
    for t, row in zip(texts, found):
        words = re.findall("[a-z0-9]+", t.lower())
        want = []
        for name, template in licenses.TEMPLATES.items():
            parts = re.findall("[a-z0-9]+", template.lower())
            k = min(5, len(parts))
            shingles = {tuple(parts[i : i + k]) for i in range(len(parts) - k + 1)}
            span = 2 << (len(shingles) - 1).bit_length()
            held = max((len(shingles & {tuple(words[j : j + k]) for j in range(s, min(s + span, len(words) - k + 1))}) for s in range(0, max(1, len(words) - k + 1), span // 2)), default=0)
            if held >= 0.8 * len(shingles):
                want.append(name)
        assert row["licenses"] == sorted(want)


DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op8_suffix_array_dedup", "op10_license_scan"])
def test_registered_queries_equal_their_sql(spark, name):
    import os

    from topolith.llm import registry

    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect(config={"temp_directory": ""})
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = registry.queries()[name](spark, DATA)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
