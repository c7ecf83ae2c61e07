"""URL filters as a sort-merge range join (DataFrame functions only).

A rule names a host and a path prefix and fits that host and its subdomains. With the labels of a host
reversed (``org.example.www.``) a rule host is a key prefix, hence an interval of sorted keys, and the
intervals of all rule hosts are nested or apart. ``sweep`` sorts interval ends and probed keys together and
keeps the stack of the intervals that are open at each key. It runs twice: distinct hosts against rule
hosts, then distinct (rule host, path) against the rules' paths. The longest rule found wins.

The sorted order is dealt out by ranges of the key; what a range must know of the ranges before it (how
many intervals are open, and the last one opened on each level) is one row per range. Hosts and paths are
made distinct first, so a hot host is one row in the sweeps.

Defined results: NULL urls and urls without ``://`` have an empty host and path and fit no rule; no rule:
rule NULL and the default verdict. Of rules of equal length the one with the longer host wins, then the
one that blocks, then the smaller text. Rules given twice count once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardlens.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys are hexadecimal, so this sorts after every extension of a key.
PAST = "g"


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each followed by a dot, as hexadecimal."""
    return F.hex(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def path_key(rule_host_key: Column, path: Column) -> Column:
    """Paths under one rule host; the mark sorts before every hexadecimal digit."""
    return F.concat(rule_host_key, F.lit("!"), F.hex(path))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows as a table; large rule lists are better read from a file."""
    rows = [F.struct(*[F.lit(v).alias(n) for v, n in zip(r, ("host", "path", "verdict"))]) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def sweep(points: DataFrame, prefixes: DataFrame) -> DataFrame:
    """For each distinct ``key`` of points: ``stack``, all prefixes of it, the outermost first.

    Both tables have one column ``key``. A prefix p is the interval from p to p + PAST.
    """
    prefixes = prefixes.distinct()
    parts = [
        prefixes.select(F.concat("key", F.lit(PAST)).alias("key"), F.lit(0).alias("kind"), F.lit(-1).alias("step")),
        prefixes.select("key", F.lit(1).alias("kind"), F.lit(1).alias("step")),
        points.distinct().select("key", F.lit(2).alias("kind"), F.lit(0).alias("step")),
    ]
    events = cut_lineage(
        reduce(DataFrame.unionByName, parts)
        .repartitionByRange("key", "kind")
        .withColumn("part", F.spark_partition_id())
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    totals = events.groupBy("part").agg(F.sum("step").alias("sum"))
    open_before = totals.select("part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("open"))
    placed = events.join(open_before, "part").withColumn("depth", F.col("open") + F.sum("step").over(inside))
    placed = cut_lineage(placed.select("part", "key", "kind", "depth"))
    deepest = placed.where("kind = 1").agg(F.max("depth")).first()[0] or 0
    levels = [f"level{d}" for d in range(1, deepest + 1)]
    opened = {n: F.when((F.col("kind") == 1) & (F.col("depth") == d), F.col("key")) for d, n in enumerate(levels, 1)}
    stacks = placed.select("*", *[F.last(v, ignorenulls=True).over(inside).alias(n) for n, v in opened.items()])
    ends = placed.groupBy("part").agg(
        F.lit(0).alias("none"), *[F.max_by(v, F.when(v.isNotNull(), F.col("key"))).alias(n) for n, v in opened.items()]
    )
    carried = ends.select("part", *[F.last(n, ignorenulls=True).over(before).alias(f"{n}_before") for n in levels])
    return (
        stacks.where("kind = 2")
        .join(carried, "part")
        .select(
            "key",
            F.slice(
                F.array(*[F.coalesce(n, f"{n}_before") for n in levels]).cast("array<string>"), F.lit(1), F.col("depth").cast("int")
            ).alias("stack"),
        )
    )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to the rows (columns of these names are replaced)."""
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parsed = pages.select(
        *kept,
        F.coalesce(url_host(F.col(url)), F.lit("")).alias("host"),
        F.coalesce(url_path(F.col(url)), F.lit("")).alias("path"),
    )
    known = rules.select(
        F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "verdict"
    ).withColumn("host_key", host_key(F.col("rule_host")))
    known = known.withColumn("rule_key", path_key(F.col("host_key"), F.col("rule_path")))
    rule_of = known.groupBy("rule_key").agg(
        F.max(
            F.struct(
                (F.length("rule_host") + F.length("rule_path")).alias("size"),
                F.length("rule_host").alias("host_size"),
                (F.col("verdict") == "block").alias("blocks"),
                F.concat("rule_host", "rule_path").alias("rule"),
                "verdict",
            )
        ).alias("found")
    )
    targets = parsed.select("host", "path").distinct()
    hosts = targets.select("host").distinct().withColumn("key", host_key(F.col("host")))
    under = (
        sweep(hosts.select("key"), known.select(F.col("host_key").alias("key")))
        .where(F.size("stack") > 0)
        .join(hosts, "key")
        .select("host", F.explode("stack").alias("host_key"))
    )
    tried = targets.join(under, "host").withColumn("key", path_key(F.col("host_key"), F.col("path")))
    fits = (
        sweep(tried.select("key"), known.select(F.col("rule_key").alias("key")))
        .where(F.size("stack") > 0)
        .select("key", F.try_element_at("stack", F.lit(-1)).alias("rule_key"))
        .join(rule_of, "rule_key")
    )
    best = tried.join(fits, "key").groupBy("host", "path").agg(F.max("found").alias("found"))
    return parsed.join(best, ["host", "path"], "left").select(
        *kept,
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), F.lit(default)).alias("verdict"),
    )
