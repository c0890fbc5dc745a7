"""What a page costs: read once, in one task, and by the short way where that gives the same."""

import random
import threading
import time

import pyarrow as pa
from pyspark.sql import functions as F

from driftloom.functions import columns, markup, skeleton
from driftloom.operators import drift, extraction, matching
from driftloom.operators.replay import fold_input
from driftloom.params import DriftParams
from tests import pages
from tests.test_ordered import ANSWER, VISIT

PARTS = (
    '<p>', '<b id="x">', "<i ID = 'x y'>", '<div class="b a  b" href="q">', "<a class=''>", "<p class=z role>", "</p>", "</div>", "text", "&amp;",
    "<!-- <b id='no'> -->", "<script>if (a < b) '<i>'</script>", '<svg><path id="no"/>', "</svg>", "<img id=no>", '<li data-x="1" NAME="n">',
    "<x'class=v>", "<a =id x>", "<a id\x0b=x class=\x0bk>", "<br/>", "<unclosed", "<option type=\"a>b\">",
)


def test_lines_of_unusual_tags():
    texts = ("<x'class=v>", "<a =id x>", "<a id\x0b=x class=\x0bk>", '<B Id="1" id=2 CLASS="b a">', "<i id>", "<br/>", '<p data-id="x">')
    assert [skeleton.skeleton_lines(t) for t in texts] == [
        ['x\'class=v:{"class": ["v"]}'],
        ["a:{}"],
        ['a:{"class": ["k"]}'],
        ['b:{"class": ["a", "b"], "id": "1"}'],
        ['i:{"id": ""}'],
        ["br:{}"],
        ["p:{}"],
    ]
    assert skeleton.skeleton_lines(None) is None and skeleton.skeleton_lines("") == []


def test_columns_read_at_once_equal_those_read_value_by_value():
    texts, numbers = ["a", None, "ä€😀", ""], [1, None, 1 << 60, -1]
    for column in (
        pa.array(texts), pa.array(numbers), pa.array(numbers[2:]), pa.array([True, False]), pa.array([None] * 3, pa.string()), pa.array([], pa.int64()),
        pa.array([[1, 2], None, [], [3]], pa.list_(pa.int64())), pa.array([["a", None], None, ["b"]], pa.list_(pa.string())),
        pa.array([[("a", "b"), ("c", None)], None, []], pa.map_(pa.string(), pa.string())), pa.array([0.5, None]), pa.array([1, None], pa.timestamp("us")),
    ):
        for low in range(len(column) + 1):
            assert columns.values(column.slice(low)) == column.slice(low).to_pylist()


def test_attributes_read_at_once_equal_those_read_one_by_one(monkeypatch):
    rng = random.Random(11)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    quick = [markup.read_page(t) for t in texts]
    monkeypatch.setattr(markup, "_ONE_ATTRIBUTE", markup.re.compile(r"(?!)"))
    assert quick == [markup.read_page(t) for t in texts]


def test_a_broken_text_is_read():
    page = pa.array([b'<p id="a">\xff</p>'], pa.binary()).view(pa.string())
    assert skeleton.lines_of(page).to_pylist() == [['p:{"id": "a"}']]


def test_a_page_is_read_once_for_its_fingerprint(spark):
    frame = spark.createDataFrame([(1, pages.SIMPLE)], "n int, html string")
    plan = drift.fingerprint(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1


def test_only_responses_to_the_visits_are_parsed(spark):
    visits = spark.createDataFrame([], VISIT)
    answers = spark.createDataFrame([(1, "{}", 7, 5)], ANSWER)
    plan = fold_input(visits, answers, DriftParams()).filter(F.col("kind") == 0)._jdf.queryExecution().analyzed().toString()
    assert plan.index("try_parse_json") < plan.index("Join Inner")


def test_pages_become_elements_by_arrow_batches(spark):
    extraction.register_page_nodes(spark, "nodes_in_test")
    frame = spark.createDataFrame([(1, "<b id='x' class='p q'>a<i>c</i></b><i/>"), (2, None), (3, "<script>1 < 2</script>")], "n int, html string")
    found = spark.sql("SELECT v.n, e.* FROM {v} AS v, LATERAL nodes_in_test(v.html) AS e", v=frame)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and "BatchEvalPythonUDTF" not in plan and "Exchange" not in plan
    rows = [(r.n, r.pos, r.parent, r.last, r.tag, r.id, r.classes, r.attrs, r.text, r.rank, r.type_rank) for r in found.collect()]
    assert sorted(rows, key=lambda r: r[:2]) == [
        (1, 0, -1, 1, "b", "x", ["p", "q"], {"id": "x", "class": "p q"}, "a c", 1, 1),
        (1, 1, 0, 1, "i", None, [], {}, "c", 1, 1),
        (1, 2, -1, 2, "i", None, [], {}, None, 2, 1),
        (3, 0, -1, 0, "script", None, [], {}, "1 < 2", 1, 1),
    ]


def test_elements_are_read_out_of_pages_once(spark):
    selectors = F.create_map(F.lit("a"), F.lit("div > #x"), F.lit("b"), F.lit("i"))
    frame = spark.createDataFrame([(1, "<div><b id='x'>t</b><i>u</i></div>")], "n int, html string").withColumn("selectors", selectors)
    found = matching.selector_match(frame, "n")
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "inline(nodes" not in plan
    assert sorted(map(tuple, found.collect())) == [(1, "a", "t"), (1, "b", "u")]


def test_groups_of_pages_are_called_side_by_side(spark, tmp_path, monkeypatch):
    own, lock, now, most = extraction._answers, threading.Lock(), [0], [0]

    class Counted:
        """Writes like the frame it holds, and counts how many do."""

        def __init__(self, frame):
            self.frame = frame

        def select(self, *names):
            with lock:
                now[0] += 1
                most[0] = max(most[0], now[0])
            time.sleep(0.5)
            with lock:
                now[0] -= 1
            return self.frame.select(*names)

    monkeypatch.setattr(extraction, "_answers", lambda frame, function: Counted(own(frame, function)))
    queue = spark.createDataFrame([(i, f"u{i}", f"page {i}") for i in range(60)], "visit_id long, url string, html string")
    found = extraction.run_extractor_resumably(queue, lambda html, url: ({"title": html}, {}, 1, 1), str(tmp_path / "kept"), group_rows=10)
    assert found.count() == 60 and 1 < most[0] <= extraction.GROUPS_AT_ONCE


def test_pages_without_a_section_are_read_once(monkeypatch):
    read, reads = markup.read_page, []
    monkeypatch.setattr(markup, "read_page", lambda html: reads.append(html) or read(html))
    assert markup.content_section("<script>x</script><p>a</p>", 100, 1) == ("<p>a</p>", None, "<p>a</p>")
    assert len(reads) == 1
    hidden = "<script>x</script><div id='&#112;dp'>abc</div>"
    assert markup.content_section(hidden, 100, 1)[1] == "#pdp" and len(reads) == 3


def test_every_section_has_its_sign():
    for selector, sign in zip(markup.SECTION_SELECTORS, markup._SECTION_SIGNS, strict=True):
        tag, name, value = "div", "x", "y"
        for kind, first, second in markup.compile_selector(selector)[0][0][1]:
            tag, name, value = (first, "x", "y") if kind == "tag" else ("div", first, second)
        page = f"<{tag.upper()} {name.upper()}='{value}'>abc</{tag}>"
        assert markup.content_section(page, 100, 1)[1] == selector and sign in page.lower()
