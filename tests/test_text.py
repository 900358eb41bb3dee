import difflib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomstack.functions import text as X
from loomstack.operators.chunking import Limits, cut_words, pack


@pytest.mark.parametrize(
    ("name", "key"),
    [("The Board, Inc.", "board"), ("Café-Noir", "cafe noir"), ("the a an", ""), ("Acme  Co. Ltd", "acme"), ("Straße", "strasse"), ("x_b", "x b"), ("X/Y\\Z", "x y z"), ("", "")],
)
def test_name_keys(name, key):
    assert X._key(name) == key


def test_slugs_are_cut_and_never_empty():
    assert X._slug("Élan  Vital!") == "elan-vital"
    assert X._slug("...") == "node"
    assert X._slug("a" * 71 + " b") == "a" * 71


def test_half_containment_agrees_with_the_longest_block(spark):
    rng, rows = random.Random(4), []
    for _ in range(120):
        quote = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 14)))
        chunk = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 30)))
        rows.append((quote, chunk))
    rows += [(None, "x"), ("x", None), ("", ""), ("abcd", "ab"), ("abcd", "a"), ("abcd", "ab" * 20)]
    got = spark.createDataFrame(rows, "q string, c string").select("q", "c", X.contains_half(F.col("c"), F.col("q")).alias("half"), X.longest_run("q", "c").alias("run")).collect()
    for q, c, half, run in got:
        a, b = " ".join((q or "").split()), " ".join((c or "").split())
        size = difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match().size if q is not None and c is not None else 0
        assert run == size
        assert half == (len(a) > 0 and c is not None and 2 * size >= len(a))


def test_spaces_snakes_and_labels(spark):
    row = spark.createDataFrame([("\x1c a  b\u0085 ", " Sent Back-to! ")], "t string, v string").select(
        X.spaced(F.col("t")), X.snake(F.col("v")), X.page_label(F.lit(1), F.lit(1)), X.page_label(F.lit(1), F.lit(3)), X.document_of(F.lit("a:b:0001")), X.masked(F.lit("token=abcdefghij")),
        X.backoff(F.lit(9), F.lit(None)), X.backoff(F.lit(1), F.lit(5)),
    ).first()
    assert list(row) == ["a b", "sent_back_to", "page 1", "pages 1-3", "a:b", "token=***", 60.0, 5.0]


@given(st.lists(st.tuples(st.integers(1, 1098), st.booleans()), max_size=60))
@settings(max_examples=150, deadline=None)
def test_packed_chunks_cover_all_units_within_limits(units):
    sizes, breaks = [u[0] for u in units], [u[1] for u in units]
    limits, ranges = Limits(), pack([u[0] for u in units], [u[1] for u in units])
    width = lambda a, b: sum(sizes[a:b]) + sum(2 if x else 1 for x in breaks[a + 1 : b])
    assert all(width(a, b) <= limits.most for a, b in ranges)
    covered = 0
    for a, b in ranges:
        assert a <= covered < b
        covered = b
        assert width(a, b) >= limits.least or a == 0
    assert covered == len(units)


@given(st.text("ab ", max_size=200), st.integers(3, 20))
@settings(max_examples=100, deadline=None)
def test_cut_words_keep_every_word_character(text, limit):
    text = " ".join(text.split())
    pieces = cut_words(text, limit)
    assert all(len(p) <= limit for p in pieces)
    assert "".join(pieces).replace(" ", "") == text.replace(" ", "")
