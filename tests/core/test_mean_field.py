import itertools
import math

import pytest

from credograph.functions.potentials import EPSILON
from credograph.operators import mean_field, router
from tests.core.test_beliefs import by_component, frames, value


def test_fixed_point_bound_and_router(spark):
    variables = [("a", 0.3, None), ("b", None, None), ("c", 0.7, None), ("d", None, 1), ("lone", 0.2, None)]
    factors = [("f1", "pairwise", ["a"], "b", None, None, [1.3, 0.8, 0.7, 1.2]), ("f2", "conditional", ["b", "c"], "d", None, None, [0.2, 0.4, 0.5, 0.9]), ("f3", "pairwise", ["a"], "c", None, None, [1.1, 0.9, 0.9, 1.1])]
    v, f = frames(spark, variables, factors)
    turn = {r.variable: r["class"] for r in mean_field.classes(f).collect()}
    assert all(turn[x] != turn[y] for _, _, ins, c, *_ in factors for x, y in itertools.combinations([*ins, c], 2))
    beliefs, _, converged = mean_field.run(v, f)
    mu = {r.variable: r.belief for r in beliefs.collect()}
    assert converged and mu["lone"] == pytest.approx(0.2) and mu["d"] == pytest.approx(1 - EPSILON)
    prior = {x: p for x, p, h in variables if p is not None and h is None}

    def expected(fixed):
        total = 0.0
        for fac in factors:
            own = [*fac[2], fac[3]]
            for bits in itertools.product((0, 1), repeat=len(own)):
                x = dict(zip(own, bits))
                w = math.prod((fixed.get(u, mu[u]) if x[u] else 1 - fixed.get(u, mu[u])) for u in own)
                total += w * math.log(max(value(fac, x, strict=True), 1e-10))
        return total

    for x in "abc":
        odds = expected({x: 1.0}) - expected({x: 0.0}) + (math.log(prior[x] / (1 - prior[x])) if x in prior else 0)
        assert mu[x] == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-5)
    elbo = expected({}) + sum(mu[x] * math.log(p) + (1 - mu[x]) * math.log(1 - p) for x, p in prior.items()) - sum(m * math.log(m) + (1 - m) * math.log(1 - m) for m in mu.values())
    assert mean_field.bound(v, f, beliefs) == pytest.approx(elbo, abs=1e-9)
    found, method = router.infer(v, f)
    want = by_component(variables, factors)
    assert method == "junction_tree" and all(r.belief == pytest.approx(want[r.variable][0], abs=1e-9) for r in found.collect())
    with pytest.raises(ValueError):
        router.infer(v, f, "guess")
