"""Budgets and prefixes against a plain recursion."""

import hashlib
import random

from driftloom.llm import mixing
from tests.llm.conftest import ODD_TEXTS

WEIGHTS = ({"a": 3, "b": 1}, {"x": 2}, {"s1": 5})


def divide(whole, children):
    """children: (name, weight, capacity); shortages go to the siblings."""
    spent, left = {}, list(children)
    while left:
        total = sum(w for _, w, _ in left)
        full = [c for c in left if c[2] * total <= whole * c[1]]
        if not full:
            return spent | {n: w * whole // total for n, w, _ in left}
        # All that are full now stay full, since what is left per weight only grows.
        spent |= {n: c for n, _, c in full}
        whole -= sum(c for *_, c in full)
        left = [c for c in left if c not in full]
    return spent


def plain(leaves, percent, epochs):
    def under(*path):
        return sum(s * epochs for leaf, s in leaves.items() if leaf[: len(path)] == path)

    whole = min(sum(leaves.values()) * percent // 100, sum(leaves.values()) * epochs)
    out = {}
    top = divide(whole, [(d, WEIGHTS[0].get(d, 1), under(d)) for d in sorted({k[0] for k in leaves})])
    for d, budget in top.items():
        middle = divide(budget, [(x, WEIGHTS[1].get(x, 1), under(d, x)) for x in sorted({k[1] for k in leaves if k[0] == d})])
        for x, own in middle.items():
            low = divide(own, [(s, WEIGHTS[2].get(s, 1), under(d, x, s)) for s in sorted({k[2] for k in leaves if k[:2] == (d, x)})])
            out |= {(d, x, s): b for s, b in low.items()}
    return out


def test_budgets(spark):
    rng = random.Random(6)
    for percent, epochs in ((50, 1), (80, 2), (150, 2), (500, 3)):
        leaves = {(d, x, s): rng.choice([0, 3, 50, 1000, 90_000]) for d in "abc" for x in "xyz" for s in ("s1", "s2", "s3") if rng.random() < 0.8}
        frame = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "domain string, language string, origin string, supply long")
        got = {tuple(r[:3]): r["budget"] for r in mixing.budgets(frame, percent, epochs, WEIGHTS).select("domain", "language", "origin", "budget").collect()}
        assert got == plain(leaves, percent, epochs)


def test_prefix_of_a_leaf(spark, monkeypatch):
    rows = [(i, "w " * (i % 7), "en", "s", "clash") for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens string")
    monkeypatch.setattr(mixing, "_PREFIX_DIGITS", 1)
    supply = sum(i % 7 for i in range(300))
    budget = supply * 130 // 100
    order = sorted(range(300), key=lambda i: hashlib.md5(f"{mixing.SEED}:1:{i}".encode()).hexdigest())
    want, left = {i: 1 for i in range(300)}, budget - supply
    for i in order:
        if left <= 0:
            break
        want[i] += 1
        left -= i % 7
    picked = mixing.chosen(frame, percent=130, max_epochs=2).collect()
    assert {r["id"]: r["copies"] for r in picked} == want
    mixed = mixing.mix(frame, percent=130, max_epochs=2)
    assert mixed.columns == frame.columns and mixed.count() == sum(want.values())


def test_odd_rows(odd, empty):
    rows = mixing.plan_of(odd).collect()
    assert len(rows) == len(ODD_TEXTS)
    assert all(0 <= r["taken"] <= mixing.MAX_EPOCHS * r["n_tokens"] for r in rows)
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.mix(odd).count() == sum(r["copies"] for r in rows)
    assert mixing.plan_of(empty).count() == mixing.mix(empty).count() == 0
