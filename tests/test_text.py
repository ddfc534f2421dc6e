from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import labels, text, urls
from tidewatch.operators.answers import is_small_talk
from tidewatch.operators.search import query_terms


def values(spark, inputs, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_canonical_url(spark):
    cases = {
        "https://www.Example.com/a//b/?utm_source=x&b=2&a=1#top": "https://example.com/a/b?a=1&b=2",
        "http://example.com:80/": "http://example.com",
        "https://example.com:8443/x/": "https://example.com:8443/x",
        "example.com/post": "https://example.com/post",
        "//www.example.com/post": "https://example.com/post",
        "https://user:pw@example.com/p?q=a+b&Q=%C3%A9": "https://example.com/p?q=a+b&Q=%C3%A9",
        "https://example.com/a/../b/./c": "https://example.com/b/c",
        "https://example.com/caf é": "https://example.com/caf%20%C3%A9",
        "https://example.com/?UTM_medium=1&gclid=2": "https://example.com",
        "ftp://example.com/x": None,
        "localhost:8080/x": None,
        "mailto:a@b.c": None,
        "   ": None,
        "https://exa mple.com/": None,
        "https://example.com:99999/": None,
    }
    got = values(spark, list(cases), urls.canonical_url)
    assert dict(zip(cases, got)) == cases


def test_content_hash_folds_forms(spark):
    same = ["Ｆｕｌｌ  width text", "full width text", "FULL\nwidth​ text"]
    hashes = values(spark, same, lambda c: text.content_hash(F.lit("T"), c))
    assert len(set(hashes)) == 1
    assert values(spark, ["full width text!"], lambda c: text.content_hash(F.lit("T"), c))[0] != hashes[0]


def test_entities_single_pass(spark):
    got = values(spark, ["&amp;lt; &#65;&#x42; &nope; &hellip; & x", "&#x110000; &#128512;"], text.decode_entities)
    assert got == ["&lt; AB &nope; … & x", "&#x110000; 😀"]


def test_html_to_text(spark):
    html = "<p>One&nbsp;two</p><script>var t='</p>';</script><ul><li>a</li><li>b</li></ul><br/>end<!-- x -->"
    assert values(spark, [html], text.html_to_text) == ["One two\n\n- a\n- b\n\nend"]


def test_sentences_and_quotes(spark):
    assert values(spark, ["A b. C!\n\nD e\nf? "], text.sentences) == [["A b.", "C!", "D e", "f?"]]
    assert values(spark, ["Hi. Then a longer sentence follows. End."], lambda c: text.leading_quote(F.lit("t"), c)) == [
        "Hi. Then a longer sentence follows. End."
    ]
    assert values(spark, ["v1.2 ships now. More"], text.first_sentence) == ["v1.2 ships now."]


def test_truncate_and_snippet(spark):
    assert values(spark, ["x" * 10 + "   y"], lambda c: text.truncate(c, 12)) == ["x" * 10 + "…"]
    words = " ".join(["word"] * 40)
    assert values(spark, [words], text.snippet)[0] == " ".join(["word"] * 24)[:119] + "…"


def test_dates(spark):
    got = values(spark, ["Mon, 01 Jan 2024 10:00:00 GMT", "2024-01-01T10:00:00Z", "January 1, 2024", "soon", ""], lambda c: F.unix_micros(text.parse_date(c)))
    assert got == [1704103200000000, 1704103200000000, 1704067200000000, None, None]


def test_repo_and_hops(spark):
    assert values(spark, ["a/b", "https://github.com/a/b.git", "http://www.github.com/a/b/", "just"], urls.repo_locator) == ["a/b"] * 3 + [None]
    assert values(spark, ["1.1.1.1, 2.2.2.2 ", " , "], urls.last_hop) == ["2.2.2.2", "local"]


def test_vendor_from_first_string(spark):
    got = values(spark, ['["A"]', '[1,"A"]', "[]", "oops", '{"a":1}', "null"], lambda c: labels.resolve_vendor(labels.string_array(c), F.lit("src")))
    assert got == ["A", "A", "src", "src", "src", "src"]


def test_small_talk(spark):
    got = values(spark, ["Heyyy!!", "good morning assistant", "hey, what's the latest?", "", "thanks a lot"], is_small_talk)
    assert got == [True, True, False, False, False]


def test_query_terms_keep_repeats_and_phrases(spark):
    q = spark.createDataFrame([(1, "What about CVE-2026-3199 and the the exploit exploit?")], "query_id long, text string")
    assert {(r.phrase, r.weight) for r in query_terms(q).collect()} == {("cve 2026 3199", 1), ("exploit", 2)}


@pytest.mark.parametrize("score,label", [(5, "Act now"), (1, "Noise"), (9, "Unscored")])
def test_impact_label(spark, score, label):
    assert spark.range(1).select(labels.impact_label(F.lit(score))).first()[0] == label
