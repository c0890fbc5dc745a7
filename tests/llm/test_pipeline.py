"""Every stage of the pipeline on what its predecessor kept, against brute force."""

import pytest

import corpus_pipeline
from driftloom.llm import mixing, toxicity
from driftloom.storage import settle
from tests.llm.conftest import ODD_TEXTS
from tests.llm.test_lines import expected as expected_lines
from tests.llm.test_simhash import one_of_each
from tests.llm.test_tokens import check_pieces


def texts(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def follow(spark, docs, folder):
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(settle(stage(spark, kept[-1], folder)))
        assert kept[-1].columns == docs.columns
    return kept, corpus_pipeline.STAGES[-1][1](spark, kept[-1], folder)


def check(spark, kept, pieces, folder, exact_lines):
    docs, clean, lines, single, mixed = kept
    model = toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rejected = sum(r["predicted"] for r in toxicity.score(docs, model).collect())
    assert clean.count() == docs.count() - rejected
    got, want = sorted(texts(lines), key=str), expected_lines(texts(clean))
    assert got == want if exact_lines else sum(a == b for a, b in zip(got, want)) >= 0.99 * len(want)
    assert sorted(texts(single), key=str) == one_of_each(texts(lines))
    copies = {}
    for r in mixing.chosen(single).collect():
        copies[r["id"]] = copies.get(r["id"], 0) + r["copies"]
    found = {}
    for i, _ in texts(mixed):
        found[i] = found.get(i, 0) + 1
    assert found == {i: n for i, n in copies.items() if n}
    check_pieces(pieces.drop("ids").collect(), texts(mixed))


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "mixing", "packing"]


def test_documents(spark, folder):
    kept, pieces = follow(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    check(spark, kept, pieces, folder, False)
    assert corpus_pipeline.run(spark, folder).count() == pieces.count()


@pytest.mark.parametrize("rows", [ODD_TEXTS, []])
def test_odd_rows(spark, folder, odd, rows):
    docs = odd if rows else odd.limit(0)
    kept, pieces = follow(spark, docs, folder)
    check(spark, kept, pieces, folder, True)
