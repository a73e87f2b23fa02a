import math

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import analysis
from millrace.functions import text as X
from millrace.functions import vector as V


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("q", "want"),
    [("What's the state-of-the-art in RAG?", "Whats stateoftheart RAG"), ('"exact phrase" AND foo*', '"exact phrase" foo*'), ("THE OF", ""), ("naïve café", "nave caf"), ("a\vb c", "ab c"), (None, None)],
)
def test_sanitize_query(spark, q, want):
    assert one(spark, X.sanitize_query(F.lit(q).cast("string"))) == want


@pytest.mark.parametrize(("url", "want"), [("http://a.b/c.", "http://a.b/c"), ("http://a.b/c?.", "http://a.b/c"), ("http://a.b/c.?", "http://a.b/c."), ("http://a.b/c!!", "http://a.b/c!"), ("", "")])
def test_clean_url(spark, url, want):
    assert one(spark, X.clean_url(F.lit(url))) == want


def test_urls(spark):
    t = F.lit("go to http://a.b/c. or https://x.y/z?!\nhttp then ftp://q")
    assert one(spark, X.extract_urls(t)) == ["http://a.b/c", "https://x.y/z!", "http then ftp://q"][:1] + ["https://x.y/z"] + ["http then ftp://q"]
    assert one(spark, X.remove_urls(F.lit("a http://b c http://bb"))) == "a  c b"
    assert one(spark, X.is_unwanted_url(F.lit("https://latest.com/x")))
    assert one(spark, X.hrefs(F.lit("<a href='http://a'>x</a><!-- <a href=\"http://b\"> --><A class=k HREF=http://c>y</A><a href=/d>")) ) == ["http://a", "http://c"]


def test_page_markdown(spark):
    want = "## INTRO\n\n- item one\nSome text\n\n## 2024\n\n## * B\n\n"
    assert one(spark, X.page_markdown(F.lit("INTRO\n\n - item one\nSome text\n2024\n* B"))) == want
    assert one(spark, X.page_markdown(F.lit(""))) == ""


def test_small_texts(spark):
    assert one(spark, X.close_code_fence(F.lit("a ``` b"))) == "a ``` b\n```"
    assert one(spark, X.close_code_fence(F.lit("``` ```"))) == "``` ```"
    assert one(spark, X.remove_empty_rows(F.lit(" a \n\t\n b"))) == "a\nb"
    assert one(spark, X.fill_template(F.lit("{a}{b}"), {"b": 2, "a": "{b}"})) == "22"
    assert one(spark, X.inside_braces(F.lit("x {a {b}} y"))) == "a {b}"
    assert one(spark, X.file_ext(F.lit("/a.b/c"))) == "" and one(spark, X.file_ext(F.lit("c.tar.gz"))) == ".gz"
    assert one(spark, X.relative_path(F.lit("/r/a/b"), "/r")) == "a/b"
    assert one(spark, X.enabled_label(F.lit(False))) == "disabled"
    assert one(spark, X.lite_url(F.lit("https://cnn.com/cnn.com"))) == "https://lite.cnn.com/cnn.com"
    assert one(spark, X.pretty_html(F.lit("<div><p>x</p></div>"))) == "\n<div>\n<\np>x</p>\n</div>\n".replace("<\np", "<p")


def test_html_text():
    assert X.plain_text("<head><title>t</title></head><p>a <b>b</b><br>c<script>x</script>&amp;") == "a b\nc&"


@pytest.mark.parametrize("a,b,want", [([1, 2], [2, 1], 0.8), ([1, 0], [0, 1], 0.0), ([0, 0], [1, 1], 0.0), ([1], [1, 2], 0.0)])
def test_cosine_lenient(spark, a, b, want):
    assert one(spark, V.cosine(V.literal(a), V.literal(b), lenient=True)) == pytest.approx(want)


def test_cosine_strict(spark):
    assert math.isnan(one(spark, V.cosine(V.literal([0, 0]), V.literal([1, 1]))))
    with pytest.raises(Exception, match="differ in length"):
        one(spark, V.cosine(V.literal([1]), V.literal([1, 2])))
    with pytest.raises(Exception, match="expected 3"):
        one(spark, V.checked(V.literal([1]), 3))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e3, 1e3), min_size=1, max_size=6))
def test_vector_laws(spark, v):
    c, n = one(spark, V.cosine(V.literal(v), V.literal(v[::-1]), lenient=True)), one(spark, V.norm(V.l2_normalize(V.literal(v))))
    assert -1.0000001 <= c <= 1.0000001
    assert math.isnan(n) or n == pytest.approx(1)
    assert one(spark, V.from_blob(V.to_blob(V.literal(v)))) == v


@pytest.mark.parametrize(
    ("word", "want"),
    [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("is", "is"), ("é", "é")],
)
def test_stem(word, want):
    assert analysis.stem(word) == want


def test_stems_of_packed_lists():
    """Lists stay packed: only a batch's different words become Python strings."""
    got = analysis.stems.func(pa.array([["things", "thing", None], None, [], ["things"] * 3, ["é"]], pa.list_(pa.string())).slice(0, 5))
    assert got.to_pylist() == [["thing", "thing", None], None, [], ["thing"] * 3, ["é"]]
    assert analysis.stems.func(pa.array([["a"], ["things"]]).slice(1)).to_pylist() == [["thing"]]
