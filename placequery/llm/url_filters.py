"""URL filters by a sort-merge range join.

A host is written backwards by labels (www.example.com is com.example.www.), so a rule's host
and all its subdomains are one interval of keys, and intervals of rules nest. Hosts and rules are
sorted together; the last rule that began at or before a host carries the stack of rules that
enclose it, and every rule that covers the host is in that stack. The rule then is the longest of
the stack whose host covers the url's and whose path its path begins with.

DataFrame functions only. The sweep runs over distinct hosts, cut into ranges of keys; between
ranges only the last rule of each is handed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

# Rules of the query: host, path, verdict.
QUERY_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]
DEFAULT_VERDICT = "allow"
_ROW_BITS = 33
_RULE, _STACK = "_rule", "_stack"


def lower_ascii(c: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the end of the host to the next ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each followed by a full stop."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    names = ("rule_host", "rule_path", "rule_verdict")
    rows = [F.struct(*(F.lit(v).alias(n) for n, v in zip(names, rule, strict=True))) for rule in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _with_stacks(rules: DataFrame) -> DataFrame:
    """One row per key of a rule, with all rules of that key and of the keys that enclose it.

    An enclosing rule's key is one of the key's own prefixes by label, so this is an equality join.
    """
    keyed = (
        rules.where(F.col("rule_host").isNotNull() & F.col("rule_path").isNotNull())
        .select(
            host_key(lower_ascii(F.col("rule_host"))).alias("key"),
            F.struct(
                F.length(F.concat("rule_host", "rule_path")).alias("size"), host_key(lower_ascii(F.col("rule_host"))).alias("key"),
                F.col("rule_path").alias("path"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"),
            ).alias(_RULE),
        )
        .distinct()
    )
    own = keyed.groupBy("key").agg(F.collect_set(_RULE).alias("_own"))
    labels = F.split(F.col("key"), r"\.")
    above = own.select("key", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit("."))
    )).alias("_above"))
    return (
        above.join(own.select(F.col("key").alias("_above"), "_own"), "_above")
        .groupBy("key").agg(F.sort_array(F.flatten(F.collect_list("_own")), asc=False).alias(_STACK))
    )


def active_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host and the stack of rules that cover it, longest first, for each distinct host."""
    events = hosts.select(host_key(F.col("host")).alias("key"), F.col("host"), F.lit(1).alias("_kind"), F.lit(None).alias(_STACK))
    events = events.unionByName(_with_stacks(rules).select("key", F.lit(None).cast("string").alias("host"), F.lit(0).alias("_kind"), _STACK))
    swept = stored(events.orderBy("key", "_kind").withColumn("_slot", F.monotonically_increasing_id()))
    swept = swept.withColumn("_part", F.shiftright("_slot", _ROW_BITS))
    # The last rule of each range of keys, carried to the ranges after it: one row per range.
    lasts = swept.groupBy("_part").agg(F.max_by(_STACK, F.when(F.col("_kind") == 0, F.col("_slot"))).alias("_last"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("_part", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    sweep = Window.partitionBy("_part").orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    stack = F.coalesce(F.last(_STACK, ignorenulls=True).over(sweep), F.col("_carried"))
    return (
        swept.join(F.broadcast(carried), "_part").withColumn("_open", stack).where(F.col("_kind") == 1)
        .select("host", F.filter("_open", lambda r: F.startswith(F.col("key"), r["key"])).alias(_STACK))
    )


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """Add host, path, rule and verdict to every row.

    The longest rule wins, equally long ones by their text. Null urls and urls without :// have an
    empty host and path, which no rule fits; rows without a rule have a null rule and the default
    verdict. Rules with a null host or path are left out, repeated rules count once. Columns of the
    names added are replaced, others stay. Rows of one host are split by the skew join.
    """
    out = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    stacks = active_rules(out.select("host").distinct(), rules)
    joined = out.join(stacks, "host", "left")
    fits = F.filter(_STACK, lambda r: F.startswith(F.col("path"), r["path"]))
    chosen = joined.withColumn(_RULE, F.get(fits, F.lit(0)))
    names = [c for c in out.columns if c not in ("rule", "verdict")]
    return chosen.select(*names, F.col(f"{_RULE}.rule").alias("rule"), F.coalesce(F.col(f"{_RULE}.verdict"), F.lit(default)).alias("verdict"))


def page_verdicts(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url"), rules_table(pages.sparkSession, QUERY_RULES)).select(
        "page_id", "host", "path", "rule", "verdict"
    )


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in QUERY_RULES)
VERDICTS_SQL = f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULE_ROWS}), parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), fits AS (
  SELECT host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    max_by(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
  FROM (SELECT DISTINCT host, path FROM parts) JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.rule_verdict, '{DEFAULT_VERDICT}') AS verdict
FROM parts p LEFT JOIN fits f ON p.host = f.host AND p.path = f.path
"""
