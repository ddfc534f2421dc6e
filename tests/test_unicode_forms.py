"""Which texts go through compatibility normalisation, and what finding them costs."""

from __future__ import annotations

import time
import unicodedata

from pyspark.sql import functions as F

from tidewatch.functions.text import _MAY_CHANGE, nfkc


def test_ascii_costs_little_before_normalisation(spark):
    texts = spark.range(0, 4, 1, 4).select(F.repeat(F.lit("plain words, no more. "), 500_000).alias("t"))

    def took(pattern):
        begun = time.time()
        assert texts.filter(F.col("t").rlike(pattern)).count() == 0
        return time.time() - begun

    # The same class without the step that passes over ASCII; the quickest of three runs each.
    plain = _MAY_CHANGE[_MAY_CHANGE.index("[^"):]
    slow, quick = zip(*[(took(plain), took(_MAY_CHANGE)) for _ in range(3)], strict=True)
    assert min(quick) < 0.75 * min(slow)


def test_every_character_that_normalisation_changes_is_sent_to_it(spark):
    letters = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(f"a {x} b",) for x in letters if unicodedata.normalize("NFKC", x) != x], "t string")
    assert rows.filter(~F.col("t").rlike(_MAY_CHANGE)).count() == 0
    assert {r.n for r in rows.limit(50).select(nfkc(F.col("t")).alias("n")).collect()} == {unicodedata.normalize("NFKC", r.t) for r in rows.limit(50).collect()}
