"""Robots files as relations: parse to rules, decide by arg-max."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BODY_CAP = 512_000
CACHE_SECONDS = 900
RULES = "array<struct<specificity: int, allow: boolean, segments: array<string>, anchored: boolean>>"
POLICY = f"origin string, block_all boolean, rules {RULES}, delay_ms long"


def lines_of(files: DataFrame) -> DataFrame:
    """``files(origin, body)`` to ``(origin, pos, key, value)`` of its directives."""
    line = F.trim(F.split_part(F.col("line"), F.lit("#"), F.lit(1)))
    cut = F.instr("line", ":")
    raw = files.select("origin", F.posexplode(F.split(F.coalesce("body", F.lit("")), r"\R")).alias("pos", "line"))
    raw = raw.withColumn("line", line).where(cut > 0)
    return raw.select("origin", "pos", F.lower(F.trim(F.substr("line", F.lit(1), cut - 1))).alias("key"), F.trim(F.substr("line", cut + 1)).alias("value"))


def groups_of(files: DataFrame) -> DataFrame:
    """Directives with the number of their group within the origin's file.

    A User-agent line after any rule line opens a new group. Rule lines before
    the first agent belong to none.
    """
    rule = F.col("key").isin("allow", "disallow", "crawl-delay")
    known = lines_of(files).where(rule | (F.col("key") == "user-agent"))
    w = W.partitionBy("origin").orderBy("pos")
    named = F.max(F.when((F.col("key") == "user-agent") & (F.col("value") != ""), 1).otherwise(0)).over(w) == 1
    known = known.withColumn("named", named).where("named")
    opens = ((F.col("key") == "user-agent") & (F.lag("key").over(w) != "user-agent")).cast("int")
    return known.withColumn("grp", F.sum(F.coalesce(opens, F.lit(0))).over(w)).drop("named")


def selected_groups(files: DataFrame, agent: str) -> DataFrame:
    """Directives of the groups that hold for ``agent``.

    A group's agent token must occur in the lower-cased agent string; only if
    no group names it do the wildcard groups hold.
    """
    g = groups_of(files)
    is_agent = (F.col("key") == "user-agent") & (F.col("value") != "")
    token = F.lower("value")
    by_group = W.partitionBy("origin", "grp")
    g = g.withColumn("specific", F.max((is_agent & F.lit(agent.lower()).contains(token)).cast("int")).over(by_group))
    g = g.withColumn("wild", F.max((is_agent & (token == "*")).cast("int")).over(by_group))
    any_specific = F.max("specific").over(W.partitionBy("origin"))
    return g.withColumn("any_specific", any_specific).where("specific = 1 or (any_specific = 0 and wild = 1)").drop("specific", "wild", "any_specific")


def rules_of(files: DataFrame, agent: str) -> DataFrame:
    """``(origin, allow, path, segments, anchored, specificity)`` of the rules for ``agent``.

    ``segments``: the literal texts between the stars.
    """
    rules = selected_groups(files, agent).where(is_rule())
    return rules.select("origin", F.col("value").alias("path"), rule_of(F.col("value")).alias("r")).select("origin", "r.allow", "path", "r.segments", "r.anchored", "r.specificity")


def is_rule() -> Column:
    return F.col("key").isin("allow", "disallow") & (F.col("value") != "")


def rule_of(value: Column) -> Column:
    """Struct of a rule line; structs sort by specificity, then allow."""
    anchored = value.endswith("$")
    body = F.when(anchored, F.substr(value, F.lit(1), F.length(value) - 1)).otherwise(value)
    return F.struct(
        F.length(F.replace(body, F.lit("*"), F.lit(""))).alias("specificity"), (F.col("key") == "allow").alias("allow"),
        F.split(body, r"\*", -1).alias("segments"), anchored.alias("anchored"),
    )


def delay_of(value: Column) -> Column:
    """Milliseconds of a delay line; null if it is no number."""
    return F.greatest(F.lit(0), F.floor(value.try_cast("double") * 1000 + 0.5)).cast("long")


def delays_of(files: DataFrame, agent: str) -> DataFrame:
    """``(origin, delay_ms)``: the longest delay of the groups for ``agent``.

    In a group the last valid delay counts.
    """
    ms = delay_of(F.col("value"))
    d = selected_groups(files, agent).where((F.col("key") == "crawl-delay") & F.col("value").try_cast("double").isNotNull())
    last = d.groupBy("origin", "grp").agg(F.max_by(ms, "pos").alias("ms"))
    return last.groupBy("origin").agg(F.max("ms").alias("delay_ms"))


def policies_of(fetches: DataFrame, agent: str, cap: int = BODY_CAP) -> DataFrame:
    """``fetches(origin, status, body)`` to one policy row for each origin.

    ``block_all`` for server errors, 429, oversized files and failed fetches
    (null status); other unsuccessful answers allow all.
    """
    status = F.col("status")
    block = status.isNull() | (status >= 500) | (status == 429) | (status.between(200, 299) & (F.octet_length("body") > cap))
    body = F.when(status.between(200, 299) & ~block, F.coalesce("body", F.lit(""))).otherwise("")
    rows = fetches.select("origin", block.alias("block_all"), body.alias("body")).withColumn("file", F.sha2("body", 256))
    # many origins serve the same file: each is read once
    files = rows.where("body <> ''").groupBy(F.col("file").alias("origin")).agg(F.any_value("body").alias("body"))
    is_delay = (F.col("key") == "crawl-delay") & F.col("value").try_cast("double").isNotNull()
    known = selected_groups(files, agent).groupBy(F.col("origin").alias("file")).agg(
        F.sort_array(F.collect_list(F.when(is_rule(), rule_of(F.col("value")))), asc=False).alias("rules"),
        F.sort_array(F.collect_list(F.when(is_delay, F.struct("grp", "pos", delay_of(F.col("value")).alias("ms"))))).alias("_delays"),
    )
    following = lambda k: F.get("_delays", k + 1)["grp"]
    last_ones = F.filter("_delays", lambda d, k: ~following(k).eqNullSafe(d["grp"]))
    known = known.withColumn("delay_ms", F.array_max(F.transform(last_ones, lambda d: d["ms"]))).drop("_delays")
    out = rows.select("origin", "block_all", "file").join(known, "file", "left")
    return out.select("origin", "block_all", F.coalesce("rules", F.array().cast(RULES)).alias("rules"), F.coalesce("delay_ms", F.lit(0)).alias("delay_ms"))


def fits(rule: Column, target: Column) -> Column:
    """Whether a rule's segments stand in the target in turn: the first at its start, an anchored rule's last at its end.

    The leftmost place of each segment leaves the most room for the next, so
    one pass decides, without a regular expression.
    """
    segments = rule["segments"]
    n, head, tail = F.size(segments), F.get(segments, F.lit(0)), F.element_at(segments, -1)
    place = lambda segment, at: F.position(segment, target, at)
    found = lambda segment, at: F.when(place(segment, at) > 0, place(segment, at) + F.length(segment)).otherwise(0)
    step = lambda at, segment: F.when((at == 0) | (segment == ""), at).otherwise(found(segment, at))
    at = F.aggregate(F.slice(segments, F.lit(2), F.greatest(n - 2, F.lit(0))), F.length(head) + 1, step)
    last = F.when(rule["anchored"], (at > 0) & target.endswith(tail) & (F.length(target) - F.length(tail) + 1 >= at)).otherwise((at > 0) & ((tail == "") | (place(tail, at) > 0)))
    alone = F.when(rule["anchored"], target == head).otherwise(True)
    return target.startswith(head) & F.when(n == 1, alone).otherwise(last)


def winner(rules: Column, target: Column) -> Column:
    """The rule with the greatest specificity that fits; allow wins ties: the first, as rules are sorted so."""
    return F.get(F.filter(rules, lambda r: fits(r, target)), F.lit(0))


def allows(policy_block: Column, rules: Column, target: Column) -> Column:
    """Decision of a policy; no policy and no matching rule allow."""
    return ~F.coalesce(policy_block, F.lit(False)) & F.coalesce(winner(F.coalesce(rules, F.array().cast(RULES)), target)["allow"], F.lit(True))


def fresh(cache: DataFrame, as_of: Column, ttl: int = CACHE_SECONDS) -> DataFrame:
    """Latest cached row of each origin that is not older than the limit."""
    live = cache.where(F.col("fetched_at") > as_of - F.make_interval(secs=F.lit(ttl)))
    newest = W.partitionBy("origin").orderBy(F.desc("fetched_at"))
    return live.withColumn("r", F.row_number().over(newest)).where("r = 1").drop("r")
