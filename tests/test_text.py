from pyspark.sql import functions as F

from mailvane.functions import text as tx
from mailvane.functions.redact import truncate


def ev(spark, col_fn, value):
    return spark.createDataFrame([(value,)], "t string").select(col_fn(F.col("t")).alias("r")).first()["r"]


def test_html_golden(spark):
    html = "<html><body><h1>Hello</h1><p>World &amp; Team</p></body></html>"
    out = ev(spark, lambda c: tx.normalize_text(tx.html_to_text(c)), html)
    assert out == "Hello World & Team"
    assert ev(spark, lambda c: truncate(tx.normalize_text(tx.html_to_text(c)), 12), html) == "Hello World "


def test_script_removed_before_paragraph_rule(spark):
    html = '<script>var t="</p>";x()</script><p>A</p><br/>B<style>p{}</style>C &lt;d&gt;'
    assert ev(spark, lambda c: tx.normalize_text(tx.html_to_text(c)), html) == "A\nB C <d>"


def test_every_entity_is_decoded(spark):
    import html
    from html.entities import html5

    s = " ".join(f"&{name}x" for name in sorted(html5)) + " &#233; &#x27; &#8217; &amp;quot; &nbsp;x &unknown;"
    assert ev(spark, tx.html_unescape, s) == html.unescape(s)
    assert ev(spark, tx.html_unescape, None) is None


def test_normalize_matches_python(spark):
    s = "  a \t b  \r\n\r\n c\x0bd\x1f e f\x85 \n\n"
    expected = "\n".join(x for x in (" ".join(line.split()) for line in s.splitlines()) if x).strip()
    assert ev(spark, tx.normalize_text, s) == expected


def test_shorten(spark):
    assert ev(spark, tx.shorten, "  a\n b  ") == "a b"
    long = ("word " * 200).strip()
    out = ev(spark, tx.shorten, long)
    assert out.endswith("...") and len(out) <= 503 and not out[:-3].endswith(" ")


def test_fold_and_terms(spark):
    assert ev(spark, tx.index_terms, "Résumé foo_bar ÜBER Straße 42") == ["resume", "foo", "bar", "uber", "straße", "42"]
    assert ev(spark, tx.query_tokens, "foo_bar, ½ é!") == ["foo_bar", "½", "é"]
    assert tx.fold_python("Résumé") == "resume"
    # decomposed letters, letters of later blocks, and a script without Latin bases
    assert ev(spark, tx.index_terms, "re\u0301sume\u0301 ẽ ế 한국어") == ["resume", "e", "e", "한국어"]


def test_casefold(spark):
    assert ev(spark, tx.casefold, "Straße ΣΑΣ ABC") == "strasse σασ abc"


def test_policy_folds_both_sides(spark):
    from mailvane.functions.policy import contains_keyword

    for subject, keyword in (("Straße Plan", "STRASSE"), ("strasse plan", "Straße"), ("ΛΟΓΟΣ", "λόγος".replace("ό", "ο")), ("연봉 안내", "연봉")):
        assert ev(spark, lambda c: contains_keyword(c, [keyword]), subject) is True
