"""Lines that stay, against all pairs of lines."""

import random

import pytest

from driftloom.llm import line_dedup
from driftloom.llm.queries import op3_fuzzy_line_dedup
from tests.llm.conftest import ODD_TEXTS


def expected(rows):
    every = [(doc if doc is not None else line_dedup.NO_ID, i, x.strip()) for doc, t in rows for i, x in enumerate((t or "").split("\n")) if x.strip()]
    distinct = sorted({x for *_, x in every})
    sets = [line_dedup.shingles(x) for x in distinct]
    parent = list(range(len(distinct)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    order = sorted(range(len(distinct)), key=lambda i: len(sets[i]))
    for n, i in enumerate(order):
        for j in order[n + 1 :]:
            if len(sets[i]) < 0.8 * len(sets[j]):
                break
            both = len(sets[i] & sets[j])
            if both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
                parent[root(i)] = root(j)
    kind = {x: root(i) for i, x in enumerate(distinct)}
    first = {}
    for doc, place, x in sorted(every):
        first.setdefault(kind[x], (doc, place))
    out = []
    for doc, t in rows:
        if t is not None:
            own = doc if doc is not None else line_dedup.NO_ID
            t = "\n".join(x for i, x in enumerate(t.split("\n")) if not x.strip() or first[kind[x.strip()]] == (own, i))
        out.append((doc, t))
    return sorted(out, key=str)


def test_odd_rows(spark, odd, empty):
    found = line_dedup.deduplicate(odd)
    assert found.columns == odd.columns
    assert sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=str) == expected(ODD_TEXTS)
    assert line_dedup.deduplicate(empty).count() == 0


def test_edited_lines(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    bases = [[rng.choice(words) for _ in range(rng.randint(8, 40))] for _ in range(25)]
    rows = []
    for doc in range(120):
        lines = []
        for _ in range(rng.randint(0, 5)):
            line = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                line[rng.randrange(len(line))] = rng.choice(words)
            lines.append(" ".join(line))
        rows.append((doc, "\n".join(lines)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r["doc_id"], r["text"]) for r in line_dedup.deduplicate(frame).collect()), key=str)
    want = expected(rows)
    same = sum(a == b for a, b in zip(got, want))
    # Bands find 99.5 % of the pairs at the limit; chains of copies find nearly all the rest.
    assert same >= 0.98 * len(want)


def shared(a, b):
    keys, whom = line_dedup.band_keys([a, b])
    return bool(set(keys[whom == 0].tolist()) & set(keys[whom == 1].tolist()))


def test_pairs_across_the_border_of_signatures(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz "
    pairs = []
    for small in range(130, 200):
        for _ in range(4):
            long = "".join(rng.choice(letters) for _ in range(small + rng.randint(2, small // 5))).replace(" ", "_")
            pairs.append((long[:small], long))
    sets = [[line_dedup.shingles(x) for x in p] for p in pairs]
    pairs = [p for p, (a, b) in zip(pairs, sets) if len(a & b) / len(a | b) >= 0.8]
    across = [p for p in pairs if len(p[0]) < 167 <= len(p[1])]
    assert len(across) > 50
    assert sum(shared(*p) for p in pairs) >= 0.98 * len(pairs) and sum(shared(*p) for p in across) >= 0.98 * len(across)
    # Equal sets of shingles of lines of any length.
    assert shared(("word " * 20).strip(), ("word " * 200).strip())
    rows = [(i, x) for i, x in enumerate([*across[0], "word " * 20, "word " * 200])]
    got = sorted((r["doc_id"], r["text"]) for r in line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, across[0][0]), (1, ""), (2, "word " * 20), (3, "")]


def test_similarities():
    rng = random.Random(1)
    lines = ["".join(rng.choice("ab é") for _ in range(rng.randint(1, 60))) for _ in range(60)] + ["a", "aaaaaaaaa", "漢字🙂"]
    left, right = [rng.choice(lines) for _ in range(500)], [rng.choice(lines) for _ in range(500)]
    sets = [(line_dedup.shingles(a), line_dedup.shingles(b)) for a, b in zip(left, right)]
    assert line_dedup.similarities(left, right).tolist() == [len(a & b) / len(a | b) for a, b in sets]


@pytest.mark.parametrize("block", [4, 512])
def test_large_buckets_in_blocks(spark, monkeypatch, block):
    """Lines in one bucket that are linked in chains, whatever the blocks."""
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", block)
    rng = random.Random(14)
    words = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(400)]
    lines = []
    for _ in range(6):
        line = [rng.choice(words) for _ in range(40)]
        for _ in range(12):
            lines.append(" ".join(line))
            line[rng.randrange(40)] = rng.choice(words)
            line[rng.randrange(40)] = rng.choice(words)
    sets = [line_dedup.shingles(x) for x in lines]
    near = [(i, j) for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    rest = spark.createDataFrame([(b, i, i) for b in (1, 2) for i in range(len(lines))], "bucket long, line long, component long")
    texts = spark.createDataFrame(list(enumerate(lines)), "line long, content string")
    links = [(r["a"], r["b"]) for r in line_dedup._linked(rest, texts, 0.8).collect()]
    assert {frozenset(x) for x in links} <= {frozenset(x) for x in near}

    def groups(pairs):
        parent = list(range(len(lines)))
        for a, b in pairs:
            old, new = parent[a], parent[b]
            parent = [new if p == old else p for p in parent]
        return {frozenset(i for i, p in enumerate(parent) if p == q) for q in parent}

    assert groups(links) == groups(near) and len(groups(near)) >= 6


def test_rows_without_ids_and_versions_of_a_document(spark):
    same, other = "the quick brown fox jumps over the lazy dog", "something else entirely"
    rows = [(None, f"{same}\nx"), (None, f"{same}\ny"), (None, None), (3, f"{same}\n\n{other}"), (3, f"z\n{other}"), (5, f"{other}\n{other}")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = [(r["doc_id"], r["text"]) for r in line_dedup.deduplicate(frame).collect()]
    assert sorted((t or "").replace(same, "S") for i, t in found if i is None) in (["", "S\nx", "y"], ["", "S\ny", "x"])
    # Equal lines of a document's versions count once: the first place is that of the second version.
    assert sorted(t for i, t in found if i is not None) == ["", "", f"z\n{other}"]


def test_a_line_and_a_component_that_most_documents_have(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    base = " ".join(words)
    rows = []
    for i in range(400):
        near = words[:]
        near[rng.randrange(60)] = f"w{i:05d}"
        rows.append((i, "\n".join(["the very same line", " ".join(near), f"own {i * 7919} {'x' * (i % 37)} {i * 104729}"])))
    frame = spark.createDataFrame([*rows, (400, base)], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicate(frame).collect()}
    assert got[0] == rows[0][1] and got[400] == ""
    assert all("same line" not in got[i] and words[30] not in got[i] and f"{i * 104729}" in got[i] for i in range(1, 400))


def test_documents(spark, folder, documents):
    rows = op3_fuzzy_line_dedup(spark, folder).collect()
    want = {doc: (len(t.split("\n"))) for doc, t in documents}
    assert {r["doc_id"]: r["n_lines"] for r in rows} == want
    kept = {doc: len((t or "").split("\n")) for doc, t in expected(documents)}
    assert sum(r["n_kept"] == kept[r["doc_id"]] for r in rows) >= 0.99 * len(rows)
