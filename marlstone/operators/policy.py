"""Access-policy evaluation: requests joined with statements, then a ladder over per-request flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P

# The names of the condition operators.
OPERATORS = (
    "StringEquals", "StringNotEquals", "StringLike", "StringNotLike", "NumericEquals", "NumericNotEquals", "NumericLessThan", "NumericGreaterThan",
    "DateLessThan", "DateGreaterThan", "IpAddress", "NotIpAddress", "Bool", "ArnEquals", "ArnLike", "Null",
)


def _numeric(a: Column, b: Column, test, strings) -> Column:
    """Both as numbers where both are, else as strings (SCL-15)."""
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.when(x.isNotNull() & y.isNotNull(), test(x, y)).otherwise(strings(a, b))


def _date(a: Column, b: Column, test) -> Column:
    """SCL-16."""
    x, y = F.try_to_timestamp(a), F.try_to_timestamp(b)
    return F.when(x.isNotNull() & y.isNotNull(), test(x, y)).otherwise(test(a, b))


def name_match(pattern: Column, arn: Column) -> Column:
    """Equal, or matched as a pattern, or without wildcards equal but for case (SCL-18)."""
    return (pattern == arn) | F.when(pattern.contains("*") | pattern.contains("?"), P.glob_match(arn, pattern)).otherwise(F.lower(pattern) == F.lower(arn))


def one_condition(operator: Column, actual: Column, expected: Column) -> Column:
    """A condition operator on one expected value (POL-07); a missing key is the empty string, an unknown operator tests equality."""
    eq, lt, gt = (lambda a, b: a == b), (lambda a, b: a < b), (lambda a, b: a > b)
    like = P.glob_match(actual, expected)
    ip = P.ip_in_range_v4(actual, expected)
    cases = {
        "StringNotEquals": actual != expected,
        "StringLike": like,
        "StringNotLike": ~like,
        "NumericEquals": _numeric(actual, expected, eq, eq),
        "NumericNotEquals": ~_numeric(actual, expected, eq, eq),
        "NumericLessThan": _numeric(actual, expected, lt, lt),
        "NumericGreaterThan": _numeric(actual, expected, gt, gt),
        "DateLessThan": _date(actual, expected, lt),
        "DateGreaterThan": _date(actual, expected, gt),
        "IpAddress": ip,
        "NotIpAddress": ~ip,
        "Bool": F.lower(actual) == F.lower(expected),
        "ArnEquals": name_match(expected, actual),
        "ArnLike": name_match(expected, actual),
        "Null": F.when(F.lower(expected) == "true", actual == "").otherwise(actual != ""),
    }
    out = actual == expected
    for name, test in cases.items():
        out = F.when(operator == name, test).otherwise(out)
    return out


def condition_matches(operator: Column, key: Column, expected: Column, context: Column) -> Column:
    """``expected`` is an array: any value may match, for negated operators too (D19)."""
    actual = F.coalesce(F.try_element_at(context, key), F.lit(""))
    return F.exists(expected, lambda e: one_condition(operator, actual, e))


def substituted(value: Column, context: Column, names: list[str]) -> Column:
    """``${name}`` replaced by the context's value, an unknown one by nothing (SCL-14)."""
    for n in names:
        value = F.replace(value, F.lit("${" + n + "}"), F.coalesce(F.try_element_at(context, F.lit(n)), F.lit("")))
    return F.regexp_replace(value, r"\$\{[^}]*\}", "")


def any_glob(value: Column, globs: Column) -> Column:
    return F.exists(globs, lambda g: P.glob_match(value, g))


def statement_matches(principal: Column, action: Column, resource: Column, s: dict[str, Column]) -> Column:
    """POL-06: s has principals, actions, not_actions, resources and not_resources (arrays; null where the statement has none)."""
    who = s["principals"].isNull() | any_glob(principal, s["principals"])
    what = F.when(s["not_actions"].isNotNull(), ~any_glob(action, s["not_actions"])).otherwise(any_glob(action, s["actions"]))
    where = F.when(s["not_resources"].isNotNull(), ~any_glob(resource, s["not_resources"])).otherwise(any_glob(resource, s["resources"]))
    return who & what & where


def evaluate(requests: DataFrame, statements: DataFrame, request_id: str = "request_id", with_scp: bool = True) -> DataFrame:
    """(request_id, decision, matched_by): POL-01 to POL-05, POL-08, JON-08, JON-09.

    Statements (policy_type: identity, resource, scp or boundary; effect; ordinal; sid; owner: null for all or the principal) are configuration: one
    row that holds them all, the first in order first, is broadcast to the requests and matched within each. It is no join condition, since from one with
    lambdas Spark 4.1 infers filters on the statements that name the requests' columns, which fail. The flags (places of the first statements that match) are one partial
    aggregation per request, then the ladder: organisation gate, explicit deny, identity allow bounded by the boundary, resource allow, implicit deny.
    Requests without any match keep their row."""
    fields = ("policy_type", "effect", "owner", "principals", "actions", "not_actions", "resources", "not_resources")
    listed = statements.agg(F.sort_array(F.collect_list(F.struct((-F.col("ordinal")).alias("o"), "sid", *fields)), asc=False).alias("__statements"))

    def matched(s: Column, place: Column) -> Column:
        # The owner first: what it turns down needs no patterns.
        hit = (s["owner"].isNull() | (s["owner"] == F.col("principal"))) & statement_matches(F.col("principal"), F.col("action"), F.col("resource"), {c: s[c] for c in fields})
        return F.when(hit, F.struct(place.alias("place"), s["policy_type"].alias("policy_type"), s["effect"].alias("effect")))

    both = requests.crossJoin(F.broadcast(listed)).select(request_id, "principal", F.transform("__statements", matched).alias("__hits"))
    flags = {
        "scp_deny": (["scp"], "Deny"), "scp_allow": (["scp"], "Allow"), "deny": (["identity", "resource"], "Deny"), "identity": (["identity"], "Allow"),
        "resource": (["resource"], "Allow"), "boundary": (["boundary"], "Allow"), "boundary_deny": (["boundary"], "Deny"),
    }
    first = lambda kinds, effect: F.array_min(F.transform(F.filter("__hits", lambda h: h["policy_type"].isin(*kinds) & (h["effect"] == effect)), lambda h: h["place"]))
    per = both.select(request_id, "principal", *[first(*v).alias(k) for k, v in flags.items()]).groupBy(request_id, "principal").agg(*[F.min(k).alias(k) for k in flags])
    per = per.crossJoin(F.broadcast(listed)).withColumns({
        "any_scp": F.exists("__statements", lambda s: s["policy_type"] == "scp"),
        "bounded": F.exists("__statements", lambda s: (s["policy_type"] == "boundary") & s["owner"].eqNullSafe(F.col("principal"))),
    })
    on = lambda c: F.col(c).isNotNull()
    ladder = []
    if with_scp:
        ladder += [(F.col("any_scp") & on("scp_deny"), "deny", "scp", "scp_deny"), (F.col("any_scp") & ~on("scp_allow"), "deny", "scp", None)]
    ladder += [
        (on("deny"), "deny", "explicit", "deny"),
        (on("identity") & F.coalesce(F.col("bounded"), F.lit(False)) & (on("boundary_deny") | ~on("boundary")), "deny", "boundary", None),
        (on("identity"), "allow", "identity", "identity"),
        (on("resource"), "allow", "resource", "resource"),
    ]
    decision, by = F.lit("implicit_deny"), F.lit("none")
    for test, result, kind, source in reversed(ladder):
        decision = F.when(test, F.lit(result)).otherwise(decision)
        by = F.when(test, F.concat(F.lit(kind + ":"), F.get("__statements", F.col(source))["sid"]) if source else F.lit(kind)).otherwise(by)
    return per.select(request_id, decision.alias("decision"), by.alias("matched_by"))


def evaluate_temporary(requests: DataFrame, statements: DataFrame, inline: DataFrame, request_id: str = "request_id") -> DataFrame:
    """POL-04: temporary credentials have the role's identity statements and their own inline ones, both together (not only what both allow), and the
    resource's; neither the organisation's gate nor a boundary applies."""
    both = statements.where(F.col("policy_type").isin("identity", "resource")).unionByName(inline.where("policy_type = 'identity'"))
    return evaluate(requests, both, request_id, with_scp=False)
