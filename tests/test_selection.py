"""Selection under a budget from requests of any length, against a plain fold over all candidates."""

import random

from loomctx.operators import pack
from loomctx.plans import catalogue

COLUMNS = "request_id string, id string, kind int, path string, byte_start long, byte_end long, tokens long, reason string, detail string, score double, sig_id string, sig_tokens long"


def plain(items, budget):
    used, ranges, out = 0, [], []
    for _, i, kind, path, start, end, tokens, reason, _, _, sig, small in sorted(items, key=lambda c: (-round(c[9] / max(c[6], 1), 12), c[1])):
        if kind == 2 and any(p == path and start < e and s < end for p, s, e in ranges):
            continue
        if used + tokens <= budget:
            used += tokens
            ranges.append((path, start, end))
            out.append((i, False, used))
        elif reason != "anchor" and kind == 2 and sig is not None and used + small <= budget:
            used += small
            out.append((sig, True, used))
    return out


def test_long_requests(spark):
    rng = random.Random(8)
    rows = []
    for r in range(12):
        for n in range(rng.choice([3, 60, 400])):
            start, tokens = rng.randint(0, 4) * 10, rng.choice([0, 1, 2, 5, 9, 30] if r % 2 else [3, 5, 9])
            rows.append((f"r{r}", f"i{n:04}", rng.choice([2, 2, 2, 4]), f"f{rng.randint(0, 3)}", start, start + rng.randint(0, 12), tokens, rng.choice(["anchor", "calls"]), "", round(rng.random() * (tokens or 1), 2), rng.choice([None, f"s{n:04}"]), rng.choice([1, 2])))
    budgets = {f"r{r}": (40, 7, 0, 90)[r % 4] for r in range(12)}
    got = pack.select_budget(spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(list(budgets.items()), "request_id string, token_budget long")).collect()
    for r, budget in budgets.items():
        assert sorted(((x["id"], x["substituted"], x["used"]) for x in got if x["request_id"] == r), key=lambda x: (x[2], x[0])) == sorted(plain([x for x in rows if x[0] == r], budget), key=lambda x: (x[2], x[0])), r


def test_a_request_has_all_parts_of_a_brand(spark, sf):
    brands = {r[0] for r in spark.read.parquet(f"{sf}/part.parquet").select("p_brand").distinct().collect()}
    for name in ("select_budget", "select_budget_substitution", "select_overlap"):
        assert {r["request_id"] for r in catalogue.QUERIES[name](spark, sf).select("request_id").collect()} == brands


def test_items_that_no_selection_can_reach_are_dropped(spark):
    rows = [("r", f"i{n:05}", 2, "", 0, 0, 5, "calls", "", 1.0, None, None) for n in range(5000)]
    c = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "0.0D as d", "60L as token_budget")
    assert sorted(r["id"] for r in pack.selectable(c).collect()) == [f"i{n:05}" for n in range(12)]
