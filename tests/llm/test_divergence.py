"""The audit against dense arithmetic on whole tables, in plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from driftloom.llm import divergence
from tests.llm.conftest import ODD_TEXTS

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def expected(rows, min_df=30, top=50):
    """rows: text, lang, source."""
    docs = [(TERM.findall((t or "").translate(FOLD)), g or "", s or "") for t, g, s in rows]
    frequency, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for terms, lang, source in docs:
        frequency[lang].update(set(terms))
        groups[lang].add(source)
    for terms, lang, source in docs:
        for group in ((lang, source), (lang, None)):
            counts[group].update(t for t in terms if frequency[lang][t] >= min_df)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in frequency[lang].items() if n >= min_df]

        def p(source, term):
            own = counts[lang, source]
            return 1 + 10**9 * (own[term] + 5) // (sum(own.values()) + 5 * len(kept))

        known = {s: {t: p(s, t) for t in kept} for s in [*sources, None]}
        for s in sources:
            pairs = [(o, sum(abs(known[s][t] - known[o][t]) for t in kept)) for o in sources - {s}]
            terms = [(t, known[s][t] - known[None][t]) for t in kept if counts[lang, s][t] and known[s][t] > known[None][t]]
            for part, found, last in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(found[:last], 1)]
    return sorted(out)


def audited(frame, **how):
    return sorted(tuple(r) for r in divergence.audit(frame, **how).collect())


@pytest.mark.parametrize("min_df", [1, 2, 30])
def test_odd_rows(spark, odd, empty, min_df):
    rows = [(t, None if i == 2 else "en", None if i == 3 else "s") for i, t in ODD_TEXTS]
    assert audited(odd, min_df=min_df) == expected(rows, min_df)
    assert divergence.audit(empty, min_df=min_df).columns == ["lang", "source", "part", "item", "value", "rank"]
    assert audited(empty, min_df=min_df) == []


def test_many_groups_and_ties(spark):
    rng = random.Random(4)
    words = ["Über", "über", "ΣΑΣ", "σας", "İx", "ab", "AB", "é", "É", "Ⓐ", "ⓐ", "漢", "🙂", "zz", "it's", "a1b", "Ꟁq", *(f"{c}{d}" for c in "cdef" for d in "ghij")]
    rows = []
    for i in range(300):
        lang, source = rng.choice(["x", "y", "", None, "x\x00y"]), rng.choice(["s1", "S1", "", None, "é", "s\x00"])
        text = rng.choice([None, "", "12 !"]) if i % 9 == 0 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))
        rows.append((text, lang, source))
    # One source has half of all rows; its language has others. One language has no kept term.
    rows += [("ab cg " * 3, "x", "hot")] * 300 + [("once", "z", "a"), ("upon", "z", "b"), (None, "z", "c")]
    frame = spark.createDataFrame([(t, g, s, 1, "clash") for t, g, s in rows], "text string, lang string, source string, at int, terms string").repartition(4)
    for min_df, top in ((3, 50), (20, 2)):
        found = expected(rows, min_df, top)
        assert audited(frame, min_df=min_df, top=top) == found
        assert sum(part == "pair" and value == 0 for _, _, part, _, value, _ in found) >= 6

