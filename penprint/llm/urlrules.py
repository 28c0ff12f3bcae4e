"""Allow and block rules on URLs by a sort-merge range join on reversed hosts.

A host is written label by label from the right, each label followed by a dot, so a rule's
host and all its subdomains are one interval of keys. Rule intervals nest. Their starts and
ends are events on the key line, each carrying the stack of rules that are open after it;
hosts are swept in key order and take the stack of the last event before them. Paths are
then matched against that stack alone.

The sweep runs over distinct hosts, so one host with a third of all pages is one row. Keys
are range-partitioned; what is open at a partition's start is carried from the partitions
before it. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from ..session import materialize

RANGES = 64
STACK = "array<struct<length:int,host:string,path:string,rule:string,verdict:string>>"


def url_host(url: Column) -> Column:
    """From behind the first ``://`` to the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = _behind_scheme(url)
    return F.translate(
        F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )


def url_path(url: Column) -> Column:
    """What follows the host, to the next ``?``, ``#`` or the end."""
    return F.regexp_extract(_behind_scheme(url), r"^[^/?#]*(/[^?#]*)", 1)


def _behind_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_key(host: Column) -> Column:
    """``a.b.c`` as ``c.b.a.``."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_events(rules: DataFrame) -> DataFrame:
    """``(key, kind, stack)``: an interval's end (0) or start (1) and the rules open after it.

    ``rules`` has ``host, path, verdict``. The parents of a host are its own suffixes, so a
    stack is as deep as a host has labels, and holds the rules of each.
    """
    entry = F.struct(
        F.length(F.concat("host", "path")).alias("length"),
        "host",
        "path",
        F.concat("host", "path").alias("rule"),
        "verdict",
    )
    by_host = rules.groupBy("host").agg(F.sort_array(F.collect_set(entry)).alias("own"))
    labels = F.split("host", r"\.")
    depth = F.size(labels)
    ancestors = F.transform(
        F.sequence(F.lit(1), depth),
        lambda k: F.struct(
            F.array_join(F.slice(labels, depth - k + 1, k), ".").alias("above"),
            (k == depth).alias("itself"),
        ),
    )
    stacked = (
        by_host.select("host", F.explode(ancestors).alias("a"))
        .select("host", "a.*")
        .join(by_host.select(F.col("host").alias("above"), "own"), "above")
        .groupBy("host")
        .agg(
            F.flatten(F.collect_list("own")).alias("open"),
            F.flatten(F.collect_list(F.when(~F.col("itself"), F.col("own")))).alias("closed"),
        )
    )
    start = host_key(F.col("host"))
    # The interval of a prefix that ends in a dot ends where that dot is a slash.
    end = F.concat(F.substring(start, F.lit(1), F.length(start) - 1), F.lit("/"))
    events = F.array(
        F.struct(end.alias("key"), F.lit(0).alias("kind"), F.col("closed").cast(STACK).alias("stack")),
        F.struct(start.alias("key"), F.lit(1).alias("kind"), F.col("open").cast(STACK).alias("stack")),
    )
    return stacked.select(F.explode(events).alias("e")).select("e.*")


def host_stacks(hosts: DataFrame, rules: DataFrame, ranges: int = RANGES) -> DataFrame:
    """``(host, stack)``: the rules open at each of the distinct ``hosts``."""
    queries = hosts.select(
        host_key(F.col("host")).alias("key"), F.lit(2).alias("kind"), F.lit(None).cast(STACK).alias("stack"), "host"
    )
    line = rule_events(rules).withColumn("host", F.lit(None).cast("string")).unionByName(queries)
    # Written once: partition numbers must be the same for the sweep and the carry.
    placed = materialize(
        line.repartitionByRange(ranges, "key").withColumn("part", F.spark_partition_id())
    )
    event = F.when(F.col("kind") < 2, F.struct("stack"))
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = placed.withColumn("last", F.last(event, ignorenulls=True).over(sweep))
    # One row per partition that has an event.
    ends = placed.where("kind < 2").groupBy("part").agg(
        F.max_by(F.struct("stack"), F.struct("key", "kind")).alias("carry")
    )
    parts = placed.select("part").distinct().join(ends, "part", "left")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("part", F.last("carry", ignorenulls=True).over(before).alias("carry"))
    return (
        swept.where("kind = 2")
        .join(carried, "part")
        .select("host", F.coalesce("last", "carry")["stack"].alias("stack"))
    )


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    otherwise: str = "allow",
    ranges: int = RANGES,
) -> DataFrame:
    """One row per page: ``(id_col, host, path, rule, verdict)``.

    A rule fits its host and all subdomains when the page's path starts with the rule's. The
    rule with the longest text wins, then the one with the longest host. Without a rule the
    verdict is ``otherwise`` and the rule null.

    A null url, or one without ``://``, has an empty host and path and fits no rule. Repeated
    rows and null ids are judged each. An empty rule table gives ``otherwise`` everywhere.
    Rule hosts are non-empty, in lower case; ``path`` starts with a slash.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    parsed = pages.select(F.col(id_col).alias("id"), url_host(url).alias("host"), url_path(url).alias("path"))
    stacks = host_stacks(parsed.select("host").distinct(), rules, ranges)
    fitting = F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(r["length"], F.length(r["host"]), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return (
        parsed.join(stacks, "host", "left")
        .select("id", "host", "path", best.alias("best"))
        .select(
            F.col("id").alias(id_col),
            "host",
            "path",
            F.col("best.rule").alias("rule"),
            F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"),
        )
    )
