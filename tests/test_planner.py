import math

import pytest

from helixion.plans import planner as P


def test_golden_plan():
    p = P.plan(47, 119157843, 16506371070, alpha=0.00234)
    assert (p.mean, p.initial_rounds, p.rounds, p.qb, p.hb) == (124, 67, 8, 29, 37)
    assert p.slots == pytest.approx(326015690, abs=4) and p.trigger == pytest.approx(310381209, abs=4)
    assert p.true_total == pytest.approx(14785360770, abs=100) and p.upper_rounds == 0


def test_recipe():
    r = P.recipe(1810841770, 16506371070, 1665561610, 26122317, 47)
    assert r.n_true == 119157843 and r.error == pytest.approx(0.0023354, abs=5e-8)


def test_error_profile():
    assert P.true_windows([0.01] * 10, 4) == pytest.approx(6.72417207)
    assert P.true_to_false([0.01] * 10, 4) == pytest.approx(24.37814064)
    assert P.true_to_false([0.01, 0.02, 0.0, 0.05, 0.03, 0.01], 3) == pytest.approx(14.09348527)
    assert math.isinf(P.true_to_false([0.0] * 5, 3))
    with pytest.raises(ValueError):
        P.true_to_false([0.1], 3)


def test_poisson_forms():
    assert P.poisson_cdf(3, 2.0) == pytest.approx(math.exp(-2) * (1 + 2 + 2 + 4 / 3))
    assert P.truncated_cdf(0, 2.0) == pytest.approx(0)
    assert sum(P.truncated_pdf(x, 2.0) for x in range(1, 60)) == pytest.approx(1)


def test_false_removal_is_the_sum_over_subsets():
    blocks, mean = [3, 5, 2, 7], 4.0
    share = [b / 17 for b in blocks]
    want = sum(math.factorial(x) * sum(math.prod(share[i] for i in c) for c in P.block_subsets(4, x)) * P.poisson_pdf(x, mean) for x in range(1, 5))
    assert P.false_removal(mean, blocks) == pytest.approx(want)


def test_given_rounds_and_errors():
    assert P.plan(21, 1000, 50_000, alpha=0.01, rounds=0).rounds == 0
    with pytest.raises(ValueError):
        P.plan(21, 1000, 50_000)
