"""Relational dispatch: methods whose parameters accept the arguments, and the most specific of those.

selectors: method, selector; params: method, role, restriction, position; delegates: child, parent (any further columns
are left alone). Identities are strings. An argument meets a restriction that is equal to it, reachable from it by
delegation, the prototype of its kind or reachable from that, or ANYTHING; FROB_ONLY:x asks for a frob whose delegate
is or reaches x.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import closure

ANYTHING, FROB_ONLY, FROB = "*", "frob:", "Frob"


def reach(delegates: DataFrame) -> DataFrame:
    """child, ancestor: the delegation closure. Derive it once for many calls."""
    return closure(delegates.select(delegates.columns[0], delegates.columns[1])).toDF("child", "ancestor")


def accepted(arguments: DataFrame, ancestors: DataFrame) -> DataFrame:
    """role (or position), accepts: every restriction that each argument meets. arguments: call, role, value, prototype, delegate
    (the last null but for frobs)."""
    own = arguments.select("call", "role", "value", "prototype", "delegate")
    starts = [
        own.select("call", "role", F.col("value").alias("at"), F.lit("").alias("mark")).filter(F.col("delegate").isNull()),
        own.select("call", "role", F.col("prototype").alias("at"), F.lit("").alias("mark")).filter(F.col("delegate").isNull()),
        own.filter(F.col("delegate").isNotNull()).select("call", "role", F.col("delegate").alias("at"), F.lit("").alias("mark")),
        own.filter(F.col("delegate").isNotNull()).select("call", "role", F.col("delegate").alias("at"), F.lit(FROB_ONLY).alias("mark")),
        own.filter(F.col("delegate").isNotNull()).select("call", "role", F.lit(FROB).alias("at"), F.lit("").alias("mark")),
    ]
    all_ = starts[0]
    for s in starts[1:]:
        all_ = all_.union(s)
    up = all_.join(ancestors, F.col("at") == F.col("child")).select("call", "role", F.col("ancestor").alias("at"), "mark")
    found = all_.union(up).select("call", "role", F.concat("mark", "at").alias("accepts"))
    plain = own.filter(F.col("delegate").isNotNull()).select("call", "role", F.col("value").alias("accepts"))
    return found.union(plain).union(own.select("call", "role", F.lit(ANYTHING).alias("accepts"))).distinct()


def applicable(selectors: DataFrame, params: DataFrame, calls: DataFrame, arguments: DataFrame, ancestors: DataFrame, by: str = "role", exact: bool = False) -> DataFrame:
    """call, method: methods of a call's selector of which every parameter accepts its argument. calls: call, selector. by: role, or
    position for positional calls, which with exact also need as many arguments as parameters."""
    p = params.select("method", F.col(by).alias("role"), "restriction")
    total = p.groupBy("method").agg(F.count("*").alias("n"))
    candidates = calls.join(selectors, "selector").select("call", "method").distinct()
    met = candidates.join(p, "method").join(accepted(arguments, ancestors), ["call", "role"]).filter(F.col("restriction") == F.col("accepts")).groupBy("call", "method").agg(F.count_distinct("role").alias("met"))
    out = candidates.join(total, "method", "left").join(met, ["call", "method"], "left").filter(F.coalesce("n", F.lit(0)) == F.coalesce("met", F.lit(0)))
    if exact:
        size = arguments.groupBy("call").agg(F.count_distinct("role").alias("given"))
        out = out.join(size, "call", "left").filter(F.coalesce("given", F.lit(0)) == F.coalesce("n", F.lit(0)))
    return out.select("call", "method")


def implies(params: DataFrame, ancestors: DataFrame) -> DataFrame:
    """strict, loose: pairs of different restrictions of which the first implies the second."""
    r = params.select("restriction").distinct()
    up = ancestors.select(F.col("child").alias("strict"), F.col("ancestor").alias("loose"))
    frobs = up.select(F.concat(F.lit(FROB_ONLY), "strict").alias("strict"), F.concat(F.lit(FROB_ONLY), "loose").alias("loose"))
    any_ = r.filter(F.col("restriction") != ANYTHING).select(F.col("restriction").alias("strict"), F.lit(ANYTHING).alias("loose"))
    return up.union(frobs).union(any_).filter("strict <> loose").distinct()


def most_specific(found: DataFrame, params: DataFrame, ancestors: DataFrame, by: str = "role") -> DataFrame:
    """call, method: found without methods that another one of the call dominates; ties stay. A method dominates another if it has a
    parameter for each of the other's, as strict or stricter, and is stricter in one or has more."""
    p = params.select("method", F.col(by).alias("role"), "restriction")
    size = p.groupBy("method").agg(F.count("*").alias("n"))
    own = found.join(size, "method", "left").select("call", "method", F.coalesce("n", F.lit(0)).alias("n"))
    rule = implies(params, ancestors)
    a, b = p.toDF("other", "role", "strict"), p.toDF("method", "role", "loose")
    weak = F.col("strict") == F.col("loose")
    shared = b.join(a, "role").filter("other <> method").join(rule.withColumn("implied", F.lit(True)), ["strict", "loose"], "left").filter(weak | F.col("implied"))
    cover = shared.groupBy("other", "method").agg(F.count("*").alias("covered"), F.max(~weak).alias("stricter"))
    pairs = own.alias("m").join(own.select("call", F.col("method").alias("other"), F.col("n").alias("others")), "call").filter("other <> method").join(cover, ["other", "method"], "left")
    dominated = pairs.filter((F.coalesce("covered", F.lit(0)) == F.col("n")) & (F.coalesce("stricter", F.lit(False)) | (F.col("others") > F.col("n")))).select("call", "method").distinct()
    return own.select("call", "method").join(dominated, ["call", "method"], "left_anti")


def ordered_arguments(found: DataFrame, params: DataFrame, arguments: DataFrame) -> DataFrame:
    """call, method, args: the arguments by the method's positions."""
    rows = found.join(params.select("method", "role", "position"), "method").join(arguments.select("call", "role", "value"), ["call", "role"])
    return rows.groupBy("call", "method").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda x: x["value"]).alias("args"))


def programs(found: DataFrame, method_programs: DataFrame) -> DataFrame:
    """call, method, program. method_programs: method, program."""
    return found.join(method_programs, "method").select("call", "method", "program")
