"""The linear-time gap search against an exhaustive search over gap combinations."""

import itertools
import random

from colsense.operators import align

MISSING = "MISSING"


def brute(truth, pred, cap):
    """By the definition: of all sets of gap positions, the one with the most
    matches (a null truth always matches), of equal ones the smallest tuple.
    Position j of the list with gaps is MISSING on a gap, else the item that as
    many places before it as there are gaps before j; past its end MISSING."""
    n, k = max(len(truth), len(pred)), min(abs(len(truth) - len(pred)), cap)

    def item(items, gaps, j):
        at = j - sum(g < j for g in gaps)
        return MISSING if j in gaps or at >= len(items) else items[at]

    def pairs(gaps):
        on_truth, on_pred = (gaps, ()) if len(truth) < len(pred) else ((), gaps)
        return [(item(truth, on_truth, j), item(pred, on_pred, j)) for j in range(n)]

    best = min((-sum(t is None or t == p for t, p in pairs(gaps)), gaps) for gaps in itertools.combinations(range(n), k))[1]
    return tuple(map(list, zip(*pairs(best)))) if n else ([], [])


def test_random_alignments_match_bruteforce(spark):
    rng = random.Random(7)
    labels = ["a", "b", "c", "d", MISSING]
    cases = []
    for i in range(300):
        nt, np_ = rng.randint(0, 8), rng.randint(0, 8)
        truth = [rng.choice(labels + [None]) for _ in range(nt)]
        pred = [rng.choice(labels) for _ in range(np_)]
        cases.append((i, truth, pred, ["d"] * nt))
    df = spark.createDataFrame(cases, "table_id int, true_types array<string>, pred_types array<string>, "
                                      "data_types array<string>")
    for cap in (1, 2, 3):
        got = {r["table_id"]: r["pairs"] for r in align.align(df, "adjusted", cap).collect()}
        for i, truth, pred, _ in cases:
            t, p = brute(truth, pred, cap)
            assert [x["true_type"] for x in got[i]] == t, (cap, truth, pred)
            assert [x["pred_type"] for x in got[i]] == p, (cap, truth, pred)
