"""Allow and block rules on urls, by a sort-merge range join.

A rule names a host and a path prefix, and fits that host and all its subdomains. Hosts are
reversed label by label, so ``www.example.com`` becomes ``com.example.www``; a url then has
one probe key for every ending of its host that some rule names, the reversed ending and the
path. A rule covers exactly the interval of probe keys that begin with its own key, and
such intervals are nested or apart. Sorted by key, the start of a rule pushes it on the
stack of active rules and its end pops it: the value of an end is the rule that encloses
it, so the newest start or end before a probe is the top of the stack.

Range partitions are swept side by side. What is active where a partition begins is the
newest start or end of the partitions before it, one row for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowscope.sizing import stored

#: ends the host in a key; sorts before every character that a host or path may hold
MARK = "\u0001"
#: sorts after every other character, so it closes the interval of a prefix
TOP = "\U0010ffff"
AZ, az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column | str) -> Column:
    """After the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), AZ, az)


def url_path(url: Column | str) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column | str) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def host_endings(reversed_key: Column | str) -> Column:
    """Of ``com.example.www``: ``com``, ``com.example`` and itself."""
    labels = F.split(reversed_key, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, F.lit(1), i), "."))


def _rule_events(rules: DataFrame) -> DataFrame:
    """Two rows for each rule: its start makes it active, its end the rule around it.

    The enclosing rule is found by an equi-join on the prefixes of the rule's own key.
    """
    keyed = (
        rules.select(
            F.concat_ws("", reversed_host("host"), F.lit(MARK), "path").alias("key"),
            F.concat("host", "path").alias("rule"), "verdict")
        .filter(F.col("key").isNotNull() & F.col("rule").isNotNull())
        # of rules with one key the blocking one holds
        .groupBy("key").agg(F.min("rule").alias("rule"), F.max("verdict").alias("verdict"))
        .withColumn("active", F.struct(F.length("rule").alias("length"), "rule", "verdict")))
    prefixes = keyed.select(
        F.col("key").alias("inner"),
        F.explode(F.transform(
            F.sequence(F.instr("key", MARK), F.greatest(F.length("key") - 1, F.instr("key", MARK))),
            lambda i: F.substring(F.col("key"), F.lit(1), i))).alias("key"),
    ).filter(F.col("inner") != F.col("key"))
    around = (
        prefixes.join(keyed.select("key", "active"), "key")
        .groupBy("inner").agg(F.max_by("active", F.length("key")).alias("around")))
    both = keyed.join(around, F.col("key") == F.col("inner"), "left")
    starts = both.select("key", F.lit(0).alias("turn"), F.length("key").alias("nth"), "active")
    ends = both.select(
        F.concat("key", F.lit(TOP)).alias("key"), F.lit(2).alias("turn"),
        (-F.length("key")).alias("nth"), F.col("around").alias("active"))
    return starts.unionByName(ends)


def judge_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow",
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict`` (``allow`` or ``block``). Of the rules
    that fit, the one whose host and path together are longest wins, on equal length the
    later in order; without one the verdict is ``default`` and the rule null. A null url, or
    one without ``://``, has an empty host and path and fits no rule. Rules with a null host
    or path are ignored; of rules that repeat a host and path a block wins. Columns of
    ``pages`` with the names of the four results are replaced. Rows keep their multiplicity.

    Each different host and path is judged once, so one url on many pages is no hot key of
    the sweep; its verdict comes back by a join that adaptive execution splits.
    """
    keyed = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))}).drop("rule", "verdict")
    urls = keyed.select("host", "path").filter(F.col("host") != "").distinct()
    hosts = rules.filter(F.col("path").isNotNull()).select(reversed_host("host").alias("ending")).distinct()
    probes = (
        urls.select("host", "path", F.explode(host_endings(reversed_host("host"))).alias("ending"))
        .join(hosts, "ending", "left_semi")
        .select(F.concat("ending", F.lit(MARK), "path").alias("key"), F.lit(1).alias("turn"),
                F.lit(0).alias("nth"), "host", "path"))
    events = _rule_events(rules).withColumn("event", F.lit(True))
    mixed = probes.unionByName(events, allowMissingColumns=True)
    partitions = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(
        mixed.repartitionByRange(partitions, "key", "turn", "nth")
        .withColumn("slice", F.spark_partition_id()))
    order = F.struct("key", "turn", "nth")
    ends = ranged.groupBy("slice").agg(
        F.max_by(F.struct("active"), F.when(F.col("event"), order)).alias("last"))
    before = W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select("slice", F.last("last", ignorenulls=True).over(before).alias("carried"))
    swept = W.partitionBy("slice").orderBy("key", "turn", "nth").rowsBetween(W.unboundedPreceding, 0)
    top = F.last(F.when(F.col("event"), F.struct("active")), ignorenulls=True)
    judged = (
        ranged.withColumn("top", top.over(swept)).filter(F.col("event").isNull())
        .join(F.broadcast(carried), "slice")  # one row for each partition of the shuffle
        .withColumn("winner", F.coalesce("top", "carried")["active"])
        .groupBy("host", "path").agg(F.max("winner").alias("winner"))
        .filter(F.col("winner").isNotNull())
        .select("host", "path", F.col("winner.rule").alias("rule"), F.col("winner.verdict").alias("verdict")))
    return keyed.join(judged, ["host", "path"], "left").select(
        *[F.col(f"`{c}`") for c in keyed.columns], "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
