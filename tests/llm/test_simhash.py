"""SimHash groups against all pairs."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from driftloom.llm import simhash
from driftloom.llm.components import components
from driftloom.llm.queries import op10_simhash_near_dedup
from tests.llm.conftest import ODD_TEXTS


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(rows):
    """Fingerprint and component (some row's number) of every row."""
    prints = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    return [(p, root(i)) for i, p in enumerate(prints)]


def expected(rows):
    groups, smallest = groups_of(rows), {}
    for (doc, _), (_, group) in zip(rows, groups):
        if doc is not None:
            smallest[group] = min(smallest.get(group, doc), doc)
    return sorted(((doc, f"{p:016x}", smallest.get(group)) for (doc, _), (p, group) in zip(rows, groups)), key=str)


def one_of_each(rows):
    """The row that stays of every component: least id (none last), then fingerprint, then text."""
    kept = {}
    for (doc, text), (p, group) in zip(rows, groups_of(rows)):
        own = (doc is None, doc or 0, p - (1 << 64) if p >> 63 else p, text is not None, text or "")
        kept[group] = min(kept.get(group, own), own)
    return sorted(((None if none else doc, text if there else None) for none, doc, _, there, text in kept.values()), key=str)


def test_groups_of_documents(spark, folder, documents):
    assert sorted(map(tuple, op10_simhash_near_dedup(spark, folder).collect()), key=str) == expected(documents)


def test_groups_of_odd_rows(spark, odd, empty):
    assert sorted(map(tuple, simhash.near_duplicates(odd).collect()), key=str) == expected(ODD_TEXTS)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.first_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == one_of_each(ODD_TEXTS)


def test_rows_without_ids_and_repeated_rows(spark, monkeypatch):
    # Fingerprints 0, 15 and 255: the outer ones are linked only through the one without an id.
    prints = {"a": 0, "b": 15, "c": 255, "d": 1 << 40 | (1 << 20) - 1, "e": -1}
    def plain(docs):
        known = F.create_map(*[F.lit(x) for pair in prints.items() for x in pair])
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), known[F.col("text")].cast("long").alias("fp"))

    monkeypatch.setattr(simhash, "fingerprints", plain)
    rows = [(5, "a"), (None, "b"), (3, "c"), (None, "d"), (None, "d"), (7, "e"), (7, "e"), (7, "c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(frame).collect())
    assert got == Counter({(5, 3): 1, (None, 3): 1, (3, 3): 1, (None, None): 2, (7, 7): 2, (7, 3): 1})
    assert sorted(map(tuple, simhash.first_of_each(frame).collect()), key=str) == sorted([(3, "c"), (None, "d"), (7, "e")], key=str)


def test_columns_of_kinds_without_an_order(spark):
    rows = [(1, "one two", {"a": 1}), (1, "one  two", {"a": 2}), (None, "one two", {}), (2, "else", None)]
    kept = simhash.first_of_each(spark.createDataFrame(rows, "doc_id long, text string, more map<string,int>"))
    assert sorted((r["doc_id"], r["text"], r["more"]) for r in kept.collect()) == [(1, "one  two", {"a": 2}), (2, "else", None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_links_connect_all_pairs_within_the_radius(spark, seed):
    rng = np.random.default_rng(seed)
    fps = set()
    for centre in rng.integers(0, 1 << 63, 12):
        at = int(centre)
        for _ in range(25):
            fps.add(at)
            for bit in rng.integers(0, 64, rng.integers(1, 6)):
                at ^= 1 << int(bit)
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    found = simhash.links(spark.createDataFrame([Row(fp=f) for f in fps])).collect()
    near = [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4]
    assert all((r["a"], r["b"]) in set(near) for r in found)
    want = {r["v"]: r["component"] for r in components(spark.createDataFrame(near, "a long, b long")).collect()}
    got = {r["v"]: r["component"] for r in components(spark.createDataFrame([tuple(r) for r in found], "a long, b long")).collect()}
    assert got == want


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["v"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
