"""The decision list goes on after a rejected rule and tries edges at high values."""

import numpy as np


def test_rejected_rule_does_not_end_learning():
    from stillframe.llm.quality import _covers, learn_rules

    rng = np.random.default_rng(3)
    x = rng.random((3000, 2))
    noisy = (x[:, 0] > 0.5) & (rng.random(3000) < 0.9)
    pure = (x[:, 1] > 0.45) & (x[:, 1] < 0.5) & (x[:, 0] < 0.3)
    fold = rng.random(3000) < 0.66
    said = np.zeros(3000, dtype=bool)
    for r in learn_rules(x, noisy | pure, ["a", "b"], fold):
        said |= _covers(list(r.conditions), x, ["a", "b"])
    assert (said & pure).sum() >= 0.9 * pure.sum()


def test_high_edges_are_tried():
    from stillframe.llm.quality import learn_rules

    rng = np.random.default_rng(4)
    x = rng.permutation(20_000)[:, None] / 20_000
    bad = (x[:, 0] > 0.9905) | (x[:, 0] < 0.9) & (rng.random(20_000) < 0.01)
    rules = learn_rules(x, bad, ["a"], rng.random(20_000) < 0.66, most_conditions=1)
    assert any(lower and 0.990 < bound < 0.991 for r in rules for _, lower, bound in r.conditions)
