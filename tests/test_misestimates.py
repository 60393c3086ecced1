from test_plans import log_of, node

from planloom.operators import analyze
from planloom.plans import flatten


def test_first_child_gives_the_condition(spark):
    plan = {
        "Plan": node("Aggregate", 1, 100, kids=[
            node("Sort", 1000, 1000, side="Outer", kids=[
                node("Seq Scan", 1000, 1000, side="Outer", Filter="(a = 1)"),
            ]),
            node("Seq Scan", 5, 5, side="InitPlan", Filter="(z = 9)"),
        ])
    }
    sort = {"Plan": node("Sort", 1, 100, kids=[node("Seq Scan", 100, 100, side="Outer", Filter="(a = 1)"), node("Seq Scan", 5, 5, side="SubPlan", Filter="(z = 9)")])}
    own = {"Plan": node("Gather", 1, 100, Filter="(b = 2)", kids=[node("Seq Scan", 1, 100, side="Outer", Filter="(a < 1)")])}
    rows = lambda t: {r.node_no: r.conditions for r in analyze.misestimates(flatten.plan_nodes(log_of(spark, t))).collect()}
    assert rows(plan) == {1: []}  # one step down only
    assert rows(sort) == {1: ["Filter: (a = 1)"]}
    assert rows(own) == {1: ["Filter: (b = 2)"], 2: []}
