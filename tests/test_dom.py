import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftloom.functions import dom, similarity
from driftloom.operators import drift
from driftloom.params import DriftParams
from tests import pages


def skeletons(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, html string")
    rows = df.select("i", dom.skeleton_lines(F.col("html")).alias("l")).collect()
    return [r.l for r in sorted(rows)]


def test_skeleton_details(spark):
    text = (
        '<HTML><body><div class="b a" id=\'x\' title="a>b"><img id="q"><input type=text name=n name="m" disabled>'
        '<svg/><a CLASS="" href="a>b" id=z></a><script>var a="<div>";</script><!-- <b> --></div>'
        '<span ROLE="main" data-testid="d"></span><svg><path/></svg><STYLE>x</STYLE ><i id></i></body></HTML>'
    )
    assert skeletons(spark, text, "", "no tags") == [
        [
            "html:{}",
            "body:{}",
            'div:{"class": ["a", "b"], "id": "x"}',
            'input:{"name": "n", "type": "text"}',
            'a:{"id": "z"}',
            'span:{"data-testid": "d", "role": "main"}',
            'i:{"id": ""}',
        ],
        [],
        [],
    ]


def test_hash_is_of_the_joined_lines(spark):
    (lines,) = skeletons(spark, pages.SIMPLE)
    df = spark.createDataFrame([(pages.SIMPLE,)], "html string")
    row = drift.fingerprint(df).first()
    assert row.structural_hash == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def similarity_of(spark, left, right):
    df = spark.createDataFrame([(0, left), (1, right)], "i int, html string")
    a, b = drift.fingerprint(df, text_shingles=True).orderBy("i").collect()
    pair = spark.createDataFrame(
        [(a.structural_hash, a.shingles, b.structural_hash, b.shingles)],
        "h string, s array<string>, ph string, ps array<string>",
    )
    score = similarity.structural_similarity(*[F.col(c) for c in ("h", "s", "ph", "ps")])
    return pair.select(score).first()[0]


def test_similarity_of_pages(spark):
    assert similarity_of(spark, pages.SIMPLE, pages.OTHER_TEXT) == 1.0
    assert similarity_of(spark, pages.SIMPLE, pages.OTHER_PAGE) == 0.0
    assert 0.0 < similarity_of(spark, pages.DESIGN_ONE, pages.DESIGN_TWO) < 0.5


@pytest.mark.parametrize(
    "left,right,expected",
    [([], [], 1.0), (["a"], [], 0.0), (["a", "b"], ["b", "c"], 1 / 3), (["a"], ["a"], 1.0)],
)
def test_jaccard(spark, left, right, expected):
    df = spark.createDataFrame([(left, right)], "l array<string>, r array<string>")
    assert df.select(similarity.jaccard(F.col("l"), F.col("r"))).first()[0] == expected


def test_short_pages_have_single_line_shingles(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],), (["a", "b", "a", "b"],)], "l array<string>")
    rows = [sorted(r[0]) for r in df.select(dom.shingles(F.col("l"), 3)).collect()]
    assert rows == [["a", "b"], [], ["a\nb\na", "b\na\nb"]]
    hashes = [len(r[0]) for r in df.select(dom.shingle_hashes(F.col("l"), 3)).collect()]
    assert hashes == [2, 0, 2]


@given(st.lists(st.tuples(st.lists(st.sampled_from("abcd")), st.lists(st.sampled_from("abcd"))), min_size=1, max_size=20))
@settings(max_examples=5, deadline=None)
def test_jaccard_is_symmetric_and_bounded(spark, pairs):
    df = spark.createDataFrame(
        [(sorted(set(a)), sorted(set(b))) for a, b in pairs], "l array<string>, r array<string>"
    )
    both = df.select(
        "l", "r", similarity.jaccard(F.col("l"), F.col("r")).alias("x"), similarity.jaccard(F.col("r"), F.col("l")).alias("y")
    )
    for left, right, x, y in both.collect():
        a, b = set(left), set(right)
        assert x == y == (len(a & b) / len(a | b) if a | b else 1.0)


@pytest.mark.parametrize(
    "left,right,expected",
    [
        ("ffffffffffffffff", "0000000000000000", 0.0),
        ("ffffffffffffffff", "FFFFFFFFFFFFFFFF", 1.0),
        ("8000000000000000", "0000000000000000", 1 - 1 / 64),
        (None, "0000000000000000", 1.0),
        ("", "0000000000000000", 1.0),
        ("xyz", "0000000000000000", 1.0),
    ],
)
def test_visual_similarity(spark, left, right, expected):
    df = spark.createDataFrame([(left, right)], "l string, r string")
    assert df.select(similarity.visual_similarity(F.col("l"), F.col("r"))).first()[0] == expected


def test_severity_bands_and_thresholds(spark):
    scores = [(0.49, 1.0), (0.5, 1.0), (0.79, 1.0), (0.8, 1.0), (0.84, 1.0), (0.85, 1.0), (1.0, 0.79), (1.0, 0.8)]
    df = spark.createDataFrame(scores, "structural_similarity double, visual_similarity double")
    rows = df.withColumns(similarity.verdict_columns(DriftParams())).select("drift_severity", "has_drift").collect()
    assert [r.drift_severity for r in rows] == [
        "major", "moderate", "moderate", "minor", "minor", "none", "minor", "none",
    ]
    assert [r.has_drift for r in rows] == [True] * 5 + [False, True, False]


def test_baseline_cases(spark):
    visits = spark.createDataFrame(
        [("new", pages.SIMPLE), ("same", pages.SIMPLE), ("bare", pages.SIMPLE), ("equal", pages.SIMPLE)],
        "key string, html string",
    )
    printed = drift.fingerprint(visits).filter("key = 'same'").first()
    stored = spark.createDataFrame(
        [
            ("same", printed.structural_hash, printed.shingles, None),
            ("bare", "other", None, None),
            ("equal", printed.structural_hash, None, None),
        ],
        "key string, structural_hash string, shingles array<bigint>, visual_hash string",
    )
    report = {r.key: r for r in drift.drift_vs_registry(visits, stored, "key").collect()}
    assert report["new"].structural_similarity == 1.0 and not report["new"].has_drift
    assert report["new"].previous_structural_hash is None
    assert report["same"].structural_similarity == 1.0
    assert report["bare"].structural_similarity == 0.0 and report["bare"].drift_severity == "major"
    assert report["equal"].structural_similarity == 1.0 and not report["equal"].has_drift


def test_thresholds_are_parameters(spark):
    visits = spark.createDataFrame(
        [(1, "k", pages.DESIGN_ONE), (2, "k", pages.DESIGN_TWO)], "n int, key string, html string"
    )
    lenient = drift.drift_vs_previous(visits, "key", ["n"], DriftParams(structural_threshold=0.0))
    assert not lenient.filter("has_drift").count()
    strict = drift.drift_vs_previous(visits, "key", ["n"])
    assert strict.filter("has_drift").select("drift_severity").first()[0] == "major"


def test_removed_elements_inside_their_own_kind(spark):
    (lines,) = skeletons(spark, pages.NESTED)
    assert [x.split('"')[3] for x in lines] == ["a", "b", "c", "d"]
    deep = "<svg><path id='x'/>" * 30 + "</svg>" * 30 + '<p id="z">'
    (lines,) = skeletons(spark, deep)
    assert len(lines) == 1 and '"z"' in lines[0]
