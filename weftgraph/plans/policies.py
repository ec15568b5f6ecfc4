"""Rules over facts of several tables, and rows that users may see."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.catalog import Catalog
from weftgraph.operators import rules as R
from weftgraph.session import table

CATALOG = Catalog()
q = CATALOG.add

RULES = """
- {rule_id: debt, name: Debt and many orders, message: "{entity} owes", conditions: [{source: sensor, field: balance, operator: "<", value: 0}, {source: datasource, field: orders, operator: ">=", value: 12}]}
- {rule_id: either, name: Builders or rich, operator: OR, conditions: [{source: behavioral, field: state, operator: "==", value: Building}, {source: sensor, field: balance, operator: ">", value: 9500}]}
- {rule_id: mixed, name: In turn, conditions: [{source: sensor, field: balance, operator: "<", value: -900, connector: OR}, {source: datasource, field: orders, operator: ">", value: 20, connector: AND}, {source: behavioral, field: state, operator: "!=", value: machinery}]}
- {rule_id: later, name: Not now, when: [on_schedule], conditions: [{source: sensor, field: balance, operator: ">", value: 0}]}
- {rule_id: off, name: Disabled, enabled: false, conditions: [{source: sensor, field: balance, operator: ">", value: 0}]}
"""
FACTS = "f AS (SELECT c_custkey AS k, c_acctbal AS b, c_mktsegment AS s, n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey)"


@q(
    "universal_rules",
    f"WITH {FACTS} SELECT 'debt' AS rule_id, k::VARCHAR AS entity, k || ' owes' AS message FROM f WHERE b < 0 AND n >= 12 UNION ALL SELECT 'either', k::VARCHAR, '' FROM f WHERE lower(s) = 'building' OR b > 9500 UNION ALL SELECT 'mixed', k::VARCHAR, '' FROM f WHERE (b < -900 OR coalesce(n > 20, false)) AND lower(s) <> 'machinery'",
    "Q6 Q7 Q5",
)
def universal_rules(spark, d):
    """Rules with lists of conditions over balances, segments and order counts, for a trigger."""
    c = table(spark, d, "customer")
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    known = R.facts(c, "c_custkey", "sensor", {"balance": "c_acctbal"}).unionByName(R.facts(c, "c_custkey", "behavioral", {"state": "c_mktsegment"})).unionByName(R.facts(orders, "o_custkey", "datasource", {"orders": "n"}))
    active = [r for r in R.load(RULES) if r.rule_id != "later"]
    return R.evaluate(active, known).select("rule_id", "entity", "message")


USERS = "u AS (SELECT s_suppkey AS user_id, CASE s_suppkey % 20 WHEN 0 THEN 'admin' WHEN 1 THEN 'operations' ELSE 'analyst' END AS role, 't' || s_suppkey % 2 AS tenant, [s_nationkey::VARCHAR, ((s_nationkey + 5) % 25)::VARCHAR] AS scope FROM supplier), r AS (SELECT c_custkey, c_nationkey AS client_id, c_custkey % 25 AS portfolio_id, 't' || c_custkey % 2 AS tenant FROM customer)"


@q(
    "row_security",
    f"WITH {USERS} SELECT 'clients' AS resource, user_id, count(*) AS rows, sum(c_custkey)::BIGINT AS total FROM u JOIN r ON u.tenant = r.tenant WHERE role IN ('admin', 'operations') OR list_contains(scope, client_id::VARCHAR) GROUP BY user_id UNION ALL SELECT 'invoices', user_id, count(*), sum(c_custkey)::BIGINT FROM u JOIN r ON u.tenant = r.tenant WHERE role = 'admin' OR list_contains(scope, client_id::VARCHAR) OR list_contains(scope, portfolio_id::VARCHAR) GROUP BY user_id",
    "Q11 P26",
)
def row_security(spark, d):
    """What each user sees of two resources, by tenant, role and scope."""
    s = table(spark, d, "supplier")
    role = F.when(F.col("s_suppkey") % 20 == 0, "admin").when(F.col("s_suppkey") % 20 == 1, "operations").otherwise("analyst")
    scope = F.array(F.col("s_nationkey").cast("string"), ((F.col("s_nationkey") + 5) % 25).cast("string"))
    users = s.select(F.col("s_suppkey").alias("user_id"), role.alias("role"), F.concat(F.lit("t"), F.col("s_suppkey") % 2).alias("tenant"), scope.alias("scoped_ids"))
    c = table(spark, d, "customer")
    rows = c.select("c_custkey", F.col("c_nationkey").alias("client_id"), (F.col("c_custkey") % 25).alias("portfolio_id"), F.concat(F.lit("t"), F.col("c_custkey") % 2).alias("tenant"))
    # rows that agree in all that decides who sees them are seen by the same users, so their sums meet the users
    alike = rows.groupBy("client_id", "portfolio_id", "tenant").agg(F.count("*").alias("rows"), F.sum("c_custkey").alias("total"))
    counts = lambda name: R.visible(alike, users, name).groupBy("user_id").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total")).select(F.lit(name).alias("resource"), "user_id", "rows", "total")
    return counts("clients").unionByName(counts("invoices"))
