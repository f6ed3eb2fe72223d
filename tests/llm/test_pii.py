"""Pseudonyms: one-to-one on whole domains, and what is found."""

import datetime
import itertools
import re

import pytest
from pyspark.sql import functions as F

from topolith.llm import pii


def _images(spark, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "doc_id long, text string").repartition(4)
    return {values[r["doc_id"]]: (r["text"], r["n_replaced"]) for r in pii.pseudonymise(df, "key").collect()}


@pytest.mark.parametrize("kinds", ["dd", "nd", "zn", "dzd", "hdh", "ldn"])
def test_characters_are_permuted_one_to_one_within_their_alphabets(spark, kinds):
    sets = [[chr(pii.ALPHABETS[k][0] + i) for i in range(pii.ALPHABETS[k][1])] for k in kinds]
    rows = ["".join(x) for x in itertools.product(*sets)]
    marked = F.transform(F.filter(F.split("v", ""), lambda c: c != ""), lambda c, i: F.struct(c.alias("c"), F.get(F.array(*map(F.lit, kinds)), i).alias("k")))
    found = spark.createDataFrame([(x,) for x in rows], "v string").select(pii.permute_characters(marked, "key", "t").alias("w")).collect()
    assert sorted(r["w"] for r in found) == sorted(rows)


def test_pairs_are_permuted_one_to_one(spark):
    df = spark.range(17 * 23).select(F.expr("id % 17").alias("a"), F.expr("id div 17").alias("b"))
    found = df.select(pii.permute_pair(F.col("a"), F.col("b"), 17, 23, "key", "t").alias("p")).select("p.*").distinct()
    assert found.where("a between 0 and 16 and b between 0 and 22").count() == 17 * 23


def test_dates_with_slashes_are_one_to_one_in_both_orders(spark):
    days = [datetime.date(1900, 1, 1) + datetime.timedelta(n) for n in range(73049)]
    values = [f"{d.month:02}/{d.day:02}/{d.year}" for d in days] + [f"{d.day:02}/{d.month:02}/{d.year}" for d in days if d.day > 12]
    images = _images(spark, values)
    assert all(n == 1 for _, n in images.values())
    assert {v for v, _ in images.values()} == set(values)


def test_phones_stay_apart(spark):
    values = [f"+1 {a} {b} {c}" for a in ("212", "012", "112", "999") for b in ("555", "055", "155") for c in range(1000, 10000, 13)]
    images = _images(spark, values)
    assert all(n == 1 for _, n in images.values()) and len({v for v, _ in images.values()}) == len(values)
    assert all((v[3] > "1") == (k[3] > "1") and (v[7] > "1") == (k[7] > "1") for k, (v, _) in images.items())


def test_long_halves_repeat_no_turn(spark):
    name = "a" * 60
    (image,) = (v for v, _ in _images(spark, [f"{name}@example.com"]).values())
    local = image.split("@")[0]
    assert len(local) == 60 and local[:15] != local[15:30] != local[30:45]


@pytest.mark.parametrize(
    "text,rest",
    [
        ("pay BE68 5390 0754 7034 ASAP", r"pay BE\d\d \d{4} \d{4} \d{4} ASAP"),
        ("pay BE68539007547034 ASAP", r"pay BE\d{14} ASAP"),
        ("pay NO93 8601 1117 947 now", r"pay NO\d\d \d{4} \d{4} \d{3} now"),
        ("to _john@x.com", r"to _[a-z]{4}@[a-z]\.com"),
        ("to .bob@x.com", r"to \.[a-z]{3}@[a-z]\.com"),
        ("call 030 12345678 today", r"call 0\d\d \d{8} today"),
        ("at 2001:db8::ff00:42:8329 here", r"at \d{4}:[a-f]{2}\d::[a-f]{2}\d{2}:\d\d:\d{4} here"),
        ("at fe80:0:0:0:1:2:3:4a.", r"at [a-f]{2}\d\d(:\d){6}:\d[a-f]\."),
    ],
)
def test_found(spark, text, rest):
    ((image, n),) = _images(spark, [text]).values()
    assert n == 1 and re.fullmatch(rest, image) and image != text


@pytest.mark.parametrize("text", ["std::cout", "a :: b", "dead::beef", "12:30:45", "ZZ68 5390 0754 7034", "BE68 5390 0754 7035", "13/13/2020", "30/02/2020", "000 123456", "@x.com"])
def test_left_alone(spark, text):
    assert list(_images(spark, [text]).values()) == [(text, 0)]
