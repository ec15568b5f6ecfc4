"""Rules and row security against plain versions."""

import random
from collections import defaultdict

import pytest

from weftgraph.operators import rules as R


def passes(c, actual):
    if actual is None:
        return False
    if c.operator in ("==", "!="):
        return (actual.lower() == str(c.value).lower()) == (c.operator == "==")
    try:
        a, b = float(actual), float(c.value)
    except ValueError:
        return False
    return {">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[c.operator]


def test_rules(spark):
    rng = random.Random(1)
    known = {(f"e{k}", s, f): rng.choice(["1", "2.5", "-3", "Panic", "calm"]) for k in range(30) for s in ("sensor", "state") for f in "ab" if rng.random() < 0.8}
    df = spark.createDataFrame([(*k, v) for k, v in known.items()], "entity string, source string, field string, value string")
    rules = []
    for n in range(25):
        conditions = tuple(R.Condition(rng.choice(["sensor", "state", "none"]), rng.choice("ab"), rng.choice(R.COMPARATORS), rng.choice([1, 2.5, "panic", 0]), rng.choice([None, "AND", "or"])) for _ in range(rng.randrange(1, 4)))
        rules.append(R.UniversalRule(f"r{n}", f"rule {n}", conditions, rng.choice(["AND", "OR"]), entities=() if n % 5 else ("e1", "e2"), message="{rule}: {entity}"))
    got = {(r.rule_id, r.entity): (list(r.passed), r.message) for r in R.evaluate(rules, df).collect()}
    want = {}
    for r in rules:
        for e in {k[0] for k in known}:
            ok = [passes(c, known.get((e, c.source, c.field))) for c in r.conditions]
            fired = ok[0]
            for k, v in enumerate(ok[1:]):
                fired = (fired or v) if (r.conditions[k].connector or r.operator).upper() == "OR" else (fired and v)
            if fired and (not r.entities or e in r.entities):
                want[r.rule_id, e] = (ok, f"{r.name}: {e}")
    assert got == want and len(got) > 20


def test_triggers_and_bad_rules(spark):
    df = spark.createDataFrame([("e", "s", "f", "1")], "entity string, source string, field string, value string")
    yes = (R.Condition("s", "f", ">", 0),)
    rules = [R.UniversalRule("a", "a", yes, when=("on_schedule",)), R.UniversalRule("b", "b", yes, enabled=False), R.UniversalRule("c", "c", ())]
    ids = lambda trigger: [r.rule_id for r in R.evaluate(rules, df, trigger).collect()]
    assert ids("on_demand") == ids("on_schedule") == ["a"] and ids("on_data_ingest") == []
    assert R.evaluate(rules, df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        R.load("- {rule_id: x, name: x, conditions: [{source: s, field: f, operator: between, value: 1}]}")


def test_who_sees_what(spark):
    rng = random.Random(2)
    users = [(n, rng.choice(["admin", "operations", "analyst", None]), rng.choice(["t", "u"]), rng.sample(["1", "2", "3", "4"], rng.randrange(3))) for n in range(12)]
    rows = [(n, rng.choice(["t", "u"]), rng.randrange(5), rng.randrange(5), rng.randrange(12)) for n in range(60)] + [(99, "t", None, None, None)]
    u = spark.createDataFrame(users, "user_id int, role string, tenant string, scoped_ids array<string>")
    r = spark.createDataFrame(rows, "id int, tenant string, client_id int, portfolio_id int, recipient_id int")
    for resource in ("clients", "invoices", "portfolios", "notifications"):
        roles, columns = R.RESOURCES[resource]
        want = defaultdict(set)
        for user, role, tenant, scope in users:
            for row in rows:
                named = {"client_id": row[2], "portfolio_id": row[3]}
                inside = row[4] == user if resource == "notifications" else any(str(named[c]) in scope for c in columns if named[c] is not None)
                if row[1] == tenant and (role in roles or inside):
                    want[user].add(row[0])
        found = R.visible(r, u, resource).collect()
        got = defaultdict(set)
        for x in found:
            got[x.user_id].add(x.id)
        assert got == want and len(found) == sum(map(len, want.values())), resource
    granted = spark.createDataFrame([("a", "read"), ("b", "write"), ("b", "read")], "role string, permission string")
    holders = spark.createDataFrame([(1, ["a"]), (2, ["b", "a"]), (3, ["c"]), (4, None)], "user_id int, roles array<string>")
    assert sorted(x.user_id for x in R.permitted(holders, granted, "read").collect()) == [1, 2]
    assert [x.user_id for x in R.permitted(holders, granted, "write").collect()] == [2]
