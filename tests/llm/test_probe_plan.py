"""Probe keys of fingerprints: the driver holds the plan, which must not grow with the keys of a row."""

from itertools import combinations
from math import comb

import numpy as np

from ledgerspark.llm import simhash


def test_plan_does_not_grow_with_the_keys(spark):
    parts = [(list(range(0, 64, 2)), 2), (list(range(1, 64, 2)), 1)]
    prints = [0, -1, 0x123456789ABCDEF, -0x7EDCBA9876543210]
    got = simhash.probes(spark.createDataFrame([(p,) for p in prints], "fp long"), parts)
    value = lambda p, bits: sum(((p >> (63 - b)) & 1) << i for i, b in enumerate(bits))
    want = set()
    for p in prints:
        for part, (bits, t) in enumerate(parts):
            for chosen in combinations(range(len(bits)), t):
                masked = sum(1 << b for b in chosen)
                want.add((p, part, masked, value(p, bits) & ~masked))
    rows = [(r.fp, r.part, r.masked, r.key) for r in got.select("fp", "part", "masked", "key").collect()]
    assert len(rows) == len(prints) * (comb(32, 2) + 32) and set(rows) == want
    # Before, the bits of a part were taken apart once for each of its keys, which at 6 GB filled the driver's memory.
    assert got._jdf.queryExecution().optimizedPlan().toString().count("shiftrightunsigned") <= 64


def test_threshold_costs_the_keys_it_makes(spark, monkeypatch):
    """Before, two dropped bits of a part were reckoned as one key a bit, not as one for each pair of bits."""
    costs = []
    monkeypatch.setattr(simhash, "allocate", lambda rows, total: costs.append(rows) or (0.0, [0] * len(rows)))
    simhash.plan_parts(spark.createDataFrame([(int(x),) for x in np.random.default_rng(1).integers(-2**62, 2**62, 200)], "fp long"))
    two = costs[0][0]  # two parts of 32 bits: not probed, then thresholds 0, 1, 2
    assert two[3] >= 50.0 * 200 * comb(32, 2) > two[2]
