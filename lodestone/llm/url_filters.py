"""URL filters as a sort-merge range join on reversed-host canonical keys.

A host ``a.example.net`` has the key ``net.example.a.``; the hosts under ``example.net`` are then the keys from
``net.example.`` up to ``net.example/``, and a path prefix is an interval of paths. Rules become interval events. A sorted
sweep over the events keeps a stack of active nested rules: after each event, ``depth`` is the number of open intervals and
the top of the stack is the last opened interval that reached this depth, so the sweep is a running sum and a window per
depth. Urls are then sorted among the events, and each takes the stack that the last event before it has left.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, written

#: (host, path, verdict)
CONTRACT_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DEFAULT_VERDICT = "allow"
#: Urls per bucket of the sweep; a bucket also gets every rule, so it has at least as many urls as there are events.
BUCKET_ROWS = 500_000
_AFTER = b"\xff"  # above every byte of UTF-8: the end of a prefix interval


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty for null and without ``://``."""
    rest = F.substring_index(url, "://", 1)
    tail = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.when(F.contains(url, F.lit("://")), ascii_lower(F.regexp_extract(tail, r"^[^/?#]*", 0))).otherwise("")


def url_path(url: Column) -> Column:
    """After the host up to ``? #`` or the end; empty for null and without ``://``."""
    rest = F.substring_index(url, "://", 1)
    tail = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(tail, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def host_key(host: Column) -> Column:
    """``a.example.net`` -> ``net.example.a.`` as bytes."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")).cast("binary")


def rules_frame(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = CONTRACT_RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _swept(events: DataFrame, name: str, within: list[str]) -> DataFrame:
    """Run the stack over nested intervals ``(pos, kind, name)``, kind 0 an end and 1 a begin: ``top`` after each event (null: empty)."""
    order = Window.partitionBy(*within).orderBy("pos", "kind")
    deep = events.withColumn("depth", F.sum(F.when(F.col("kind") == 1, 1).otherwise(-1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    level = Window.partitionBy(*within, "depth").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    top = F.last(F.when(F.col("kind") == 1, F.col(name)), ignorenulls=True).over(level)
    return deep.withColumn("top", F.when(F.col("depth") > 0, top)).drop("depth")


def _host_events(hosts: DataFrame) -> DataFrame:
    """(pos, kind, stack): from pos on, the rule hosts that hold the place, those of the stack from its top down."""
    keyed = hosts.withColumns({"hkey": host_key(F.col("host")), "label": F.substring_index("host", ".", -1)})
    begin = keyed.select("label", "host", F.col("hkey").alias("pos"), F.lit(1).alias("kind"))
    # the hosts under "net.example." end before "net.example/": a slash follows a dot and is in no host
    end = keyed.select("label", "host", F.concat(F.expr("substring(hkey, 1, length(hkey) - 1)"), F.lit(b"/")).alias("pos"), F.lit(0).alias("kind"))
    swept = _swept(begin.unionByName(end), "host", ["label"])
    # below a host on the stack lie those of its own suffixes that are rule hosts: as many as it has labels at most
    labels = F.split("host", r"\.", -1)
    suffixes = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).alias("under"))
    chains = suffixes.join(hosts.select(F.col("host").alias("under")), "under").groupBy("host").agg(F.collect_list("under").alias("stack")).withColumnRenamed("host", "top")
    return swept.join(chains, "top", "left").select("pos", "kind", F.coalesce("stack", F.array().cast("array<string>")).alias("stack"))


def _path_events(rules: DataFrame) -> DataFrame:
    """(rule_host, pos, kind, rule): from pos on within the host, the rule with the longest path that holds the place."""
    rule = F.struct("host", "path", "verdict").alias("rule")
    begin = rules.select(F.col("host").alias("rule_host"), F.col("path").cast("binary").alias("pos"), F.lit(1).alias("kind"), rule)
    end = rules.select(F.col("host").alias("rule_host"), F.concat(F.col("path").cast("binary"), F.lit(_AFTER)).alias("pos"), F.lit(0).alias("kind"), rule)
    return _swept(begin.unionByName(end), "rule", ["rule_host"]).select("rule_host", "pos", "kind", F.col("top").alias("rule"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict, rule_host, rule_path``.

    A rule fits its host and all subdomains if the url's path starts with the rule's. The longest rule string wins; of two
    equally long ones the one with the longer host. Of rules equal in host and path one stays, ``block`` before ``allow``. A
    rule without a host is ignored, as is one with a null. Where no rule fits, rule is null and the verdict ``default``.
    A null url, or one without ``://``, has an empty host and path. Null ids and repeated rows stay as they are; an empty
    table gives no rows and no rules give the default everywhere; other columns are not read.

    Urls are dealt to buckets by row, whatever their host, and each bucket sorts them among a copy of the rules' events:
    a hot host is spread like any other, and the copies never outnumber the urls.
    """
    spark = pages.sparkSession
    clean = rules.where("host is not null and host <> '' and path is not null and verdict is not null").select(ascii_lower(F.col("host")).alias("host"), "path", "verdict")
    clean = written(clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict")), "url-rules")
    n_events, n_urls = max(1, 2 * clean.count()), pages.select(url_col).count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, min(4 * parts, n_urls // n_events), n_urls // max(BUCKET_ROWS, n_events))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))

    url = F.col(url_col)
    urls = pages.select(F.col(id_col).alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"), F.monotonically_increasing_id().alias("uid"))
    urls = urls.withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)).cast("int"))
    hosts = clean.select("host").distinct()
    on_host = urls.select("bucket", host_key(F.col("host")).alias("pos"), F.lit(2).alias("kind"), "uid", "page_id", "host", "path")
    mixed = on_host.unionByName(_host_events(hosts).withColumn("bucket", everywhere), allowMissingColumns=True)
    sweep = Window.partitionBy("bucket").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    active = mixed.withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 2")

    on_path = active.select("bucket", "uid", "page_id", "host", "path", F.explode_outer("stack").alias("rule_host"), F.col("path").cast("binary").alias("pos"), F.lit(2).alias("kind"))
    mixed = on_path.unionByName(_path_events(clean).withColumn("bucket", everywhere), allowMissingColumns=True)
    sweep = Window.partitionBy("bucket", "rule_host").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    # the state after an event may be "no rule", so the last event's whole state is taken, not the last non-null rule
    state = F.last(F.when(F.col("kind") < 2, F.struct(F.col("rule").alias("r"))), ignorenulls=True).over(sweep)
    met = mixed.withColumn("state", state).where("kind = 2").withColumn("r", F.col("state.r"))
    text = F.concat("r.host", "r.path")
    best = F.max(F.when(F.col("r").isNotNull(), F.struct(F.length(text).alias("a"), F.length("r.host").alias("b"), text.alias("rule"), F.col("r.host").alias("rule_host"), F.col("r.path").alias("rule_path"), F.col("r.verdict").alias("verdict")))).alias("best")
    one = met.groupBy("bucket", "uid").agg(*(F.first(c).alias(c) for c in ("page_id", "host", "path")), best)
    return one.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.col("best.rule_host").alias("rule_host"), F.col("best.rule_path").alias("rule_path"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"), rules_frame(spark)).drop("rule_host", "rule_path")


OP1_ORACLE = r"""
WITH u AS (SELECT page_id, url, strpos(url, '://') AS cut FROM pages),
p AS (SELECT page_id,
  CASE WHEN cut > 0 THEN translate(regexp_extract(substring(url, cut + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN cut > 0 THEN regexp_extract(substring(url, cut + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
r(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT p.page_id, p.host, p.path, r.rh || r.rp AS rule, r.v, length(r.rh || r.rp) AS n FROM p LEFT JOIN r ON (p.host = r.rh OR ends_with(p.host, '.' || r.rh)) AND starts_with(p.path, r.rp))
SELECT page_id, any_value(host) AS host, any_value(path) AS path, arg_max(rule, n) AS rule, coalesce(arg_max(v, n), 'allow') AS verdict FROM m GROUP BY page_id
"""
