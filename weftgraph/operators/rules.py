"""Rules over facts of several sources, and who may see which rows: all rules for all entities, all users for all rows, in one plan.

Facts are a long table (entity, source, field, value as text) put together from sensors, states, data sources or graph counts.
A rule has conditions on (source, field), joined by AND or OR, or one after the other by each condition's own connector, from left
to right. A condition without a fact fails. Numbers are compared as numbers, and fail where one isn't a number; `==` and
`!=` compare texts without regard to case. Rules are few and come from a file; they are broadcast, facts are not.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Conditions of all rules together; more are an error, as they are broadcast.
MOST = 100_000
COMPARATORS = (">", "<", ">=", "<=", "==", "!=")


@dataclass(frozen=True)
class Condition:
    source: str
    field: str
    operator: str
    value: str | float
    connector: str | None = None


@dataclass(frozen=True)
class UniversalRule:
    rule_id: str
    name: str
    conditions: tuple[Condition, ...]
    operator: str = "AND"
    when: tuple[str, ...] = ("on_demand",)
    entities: tuple[str, ...] = ()
    category: str = "custom"
    message: str = ""
    enabled: bool = True
    actions: tuple[str, ...] = field(default=("alert",))


def load(text: str) -> list[UniversalRule]:
    """Rules from YAML; conditions are mappings with the fields of Condition."""
    import yaml

    out = []
    for r in yaml.safe_load(text):
        r = {k: tuple(v) if isinstance(v, list) else v for k, v in r.items()}
        r["conditions"] = tuple(Condition(**c) for c in r["conditions"])
        unknown = [c.operator for c in r["conditions"] if c.operator not in COMPARATORS]
        if unknown:
            raise ValueError(f"{r['rule_id']}: no operator {unknown[0]}")
        out.append(UniversalRule(**r))
    return out


def facts(df: DataFrame, entity: str, source: str, fields: dict[str, str]) -> DataFrame:
    """(entity, source, field, value) from columns of a table, one row an entity; fields: name -> column or expression."""
    pairs = F.array(*[F.struct(F.lit(name).alias("field"), F.expr(e).cast("string").alias("value")) for name, e in fields.items()])
    rows = df.select(F.col(entity).cast("string").alias("entity"), F.explode(pairs).alias("p"))
    return rows.select("entity", F.lit(source).alias("source"), "p.field", "p.value").filter(F.col("value").isNotNull())


def _passes(operator: Column, actual: Column, expected: Column) -> Column:
    a, b = actual.try_cast("double"), expected.try_cast("double")
    text = F.lower(actual) == F.lower(expected)
    found = F.when(operator == ">", a > b).when(operator == "<", a < b).when(operator == ">=", a >= b).when(operator == "<=", a <= b).when(operator == "==", text).otherwise(~text)
    return F.coalesce(found, F.lit(False))


def evaluate(rules: list[UniversalRule], known: DataFrame, trigger: str = "on_demand") -> DataFrame:
    """(rule_id, name, category, entity, passed, message) of the rules that fire: passed tells each condition's outcome, in order.

    A rule is evaluated for a trigger that it names, and all are on demand; one without entities is for all that have facts."""
    spark = known.sparkSession
    active = [r for r in rules if r.enabled and r.conditions and (trigger in r.when or trigger == "on_demand")]
    if sum(len(r.conditions) for r in active) > MOST:
        raise ValueError(f"more than {MOST} conditions")
    listed = [(r.rule_id, n, c.source, c.field, c.operator, str(c.value)) for r in active for n, c in enumerate(r.conditions)]
    conditions = F.broadcast(spark.createDataFrame(listed, "rule_id string, n int, source string, field string, operator string, expected string"))
    heads = [(r.rule_id, r.name, r.category, r.message, list(r.entities), [(c.connector or r.operator).upper() == "OR" for c in r.conditions]) for r in active]
    about = F.broadcast(spark.createDataFrame(heads, "rule_id string, name string, category string, message string, entities array<string>, either array<boolean>"))
    one = known.join(conditions, ["source", "field"]).withColumn("ok", _passes(F.col("operator"), F.col("value"), F.col("expected")))
    # an entity has a row for each of a rule's conditions at most
    held = one.groupBy("rule_id", "entity").agg(F.collect_set(F.when(F.col("ok"), F.col("n"))).alias("hits"))
    rows = held.join(about, "rule_id").filter((F.size("entities") == 0) | F.array_contains("entities", F.col("entity")))
    passed = F.transform("either", lambda _, n: F.array_contains("hits", n))
    rows = rows.withColumn("passed", passed)
    # condition n joins the next by its own connector
    steps = F.arrays_zip(F.slice("passed", 2, F.size("passed")).alias("ok"), F.slice("either", 1, F.greatest(F.size("passed") - 1, F.lit(0))).alias("either"))
    fired = F.aggregate(steps, F.get("passed", 0), lambda so_far, s: F.when(s["either"], so_far | s["ok"]).otherwise(so_far & s["ok"]))
    shown = F.replace(F.replace("message", F.lit("{entity}"), F.col("entity")), F.lit("{rule}"), F.col("name"))
    return rows.filter(fired).select("rule_id", "name", "category", "entity", "passed", shown.alias("message"))


# -- who sees what -----------------------------------------------------------------------------------------------

# Roles that see all rows of a resource, and the columns of a row one of which has to be in a user's scope.
GLOBAL_ROLES = ("admin", "compliance_officer")
RESOURCES = {
    "portfolios": (GLOBAL_ROLES, ("portfolio_id",)), "schemes": (GLOBAL_ROLES, ("scheme_id",)), "trades": (GLOBAL_ROLES, ("portfolio_id",)),
    "clients": ((*GLOBAL_ROLES, "operations"), ("client_id",)), "folios": (GLOBAL_ROLES, ("scheme_id",)), "invoices": (GLOBAL_ROLES, ("portfolio_id", "client_id")),
    "settlements": (GLOBAL_ROLES, ("portfolio_id",)), "notifications": (("admin",), ()),
}


def visible(rows: DataFrame, users: DataFrame, resource: str) -> DataFrame:
    """(user_id, and the row's columns): the rows of each user's tenant that the user may see.

    users: user_id, role, tenant, scoped_ids; rows: tenant, and the resource's scope columns (notifications: recipient_id). Users
    of roles that see all meet the rows of their tenant, the others only rows in their scope, by equal keys."""
    roles, scopes = RESOURCES[resource]
    everything = users.filter(F.col("role").isin(*roles)).select("user_id", F.col("tenant").alias("_tenant"))
    parts = [rows.join(everything, F.col("tenant") == F.col("_tenant")).drop("_tenant")]
    others = users.filter(~F.coalesce(F.col("role").isin(*roles), F.lit(False)))
    if resource == "notifications":
        own = others.select(F.col("user_id"), F.col("tenant").alias("_tenant"))
        parts.append(rows.join(own, (F.col("tenant") == F.col("_tenant")) & (F.col("recipient_id") == F.col("user_id"))).drop("_tenant"))
    else:
        scoped = others.select("user_id", F.col("tenant").alias("_tenant"), F.explode(F.array_distinct("scoped_ids")).alias("_id"))
        found = [rows.join(scoped, (F.col("tenant") == F.col("_tenant")) & (F.col(c).cast("string") == F.col("_id"))).drop("_tenant", "_id") for c in scopes]
        some = reduce(DataFrame.unionByName, found)
        parts.append(some if len(found) == 1 else some.distinct())  # a row may be in scope by two columns
    return reduce(DataFrame.unionByName, parts)


def permitted(users: DataFrame, granted: DataFrame, permission: str) -> DataFrame:
    """The users one of whose roles has a permission. users: user_id, roles; granted: role, permission."""
    holders = granted.filter(F.col("permission") == permission).select("role").distinct()
    return users.select("*", F.explode(F.array_distinct("roles")).alias("role")).join(holders, "role", "left_semi").drop("role").distinct()
