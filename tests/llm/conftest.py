"""A table of awkward rows: nulls in any column, empty and long texts, repeated rows, clashing extra columns."""

import re

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, start int, key string"


def words(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="session")
def odd_rows():
    prose = "the quick brown fox jumps over the lazy dog and runs into the deep green wood near the old stone mill by the river "
    long = " ".join(f"word{i * 7919 % 1013}" for i in range(30_000))
    texts = [None, "", " \n\t", "one", "!!! 123 ###", prose, prose, prose * 4, long, "éàü ÉÀÜ ñ", "a b c", "\x00\x1c mixed 😀 text", "same same same same same same same same same"]
    rows = [(i, t, ["en", None, "fr"][i % 3], None, None, 0.5, 7, "k") for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, prose, "en", "s", 3, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.01"


def ids(frame):
    return sorted((r["doc_id"] for r in frame.select("doc_id").collect()), key=lambda x: (x is None, x))
