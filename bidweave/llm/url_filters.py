"""URL filters: host-suffix and path-prefix expressions, short hash prefixes, full digests, rule precedence.

Each URL becomes its host's suffixes, which meet the rules' hosts, and for each host that is met its path's prefixes of the
lengths that this host's rules have. Hosts, and expressions of a host suffix and a path prefix, meet in equi-joins on the first
hexadecimal digits of their SHA-256 digests; equal full digests confirm a meeting, and the most specific confirmed rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rules up to this many are broadcast to the expressions; more are joined by shuffling both sides.
BROADCAST_RULES = 100_000


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def host_of(url: Column) -> Column:
    """Between the first `://` and `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rules: (host, path, verdict)."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def joint_digest(host: Column, path: Column) -> Column:
    """Of both, with the host's length in front, so that no other host and path are the same text."""
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", prefix_digits: int = 8) -> DataFrame:
    """One row (id, host, path, rule, verdict) for each row of pages.

    A rule fits its host and all subdomains where the URL's path starts with the rule's path. Of several, the longest
    (host and path together) wins, then the longer host, then `block` over `allow`. URLs that no rule fits get the
    default verdict and a null rule. Null URLs and those without `://` have an empty host and path, which only rules
    with an empty host fit. Repeated pages give repeated rows; rules with a null host, path or verdict are ignored;
    other columns of pages and rules, whatever their names, are left out.
    """
    urls = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rules = rules.select(lower_ascii(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).dropna().distinct()
    small = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES

    def sized(df: DataFrame) -> DataFrame:
        """Broadcast where there are few rules."""
        return F.broadcast(df) if small else df

    def met(df: DataFrame, table: DataFrame, digest: Column) -> DataFrame:
        """df joined by the digest's first digits to the table (with r_digest), where full digests are equal."""
        both = df.withColumn("digest", digest).withColumn("prefix", F.substring("digest", 1, prefix_digits))
        found = both.join(sized(table.withColumn("r_prefix", F.substring("r_digest", 1, prefix_digits))), F.col("prefix") == F.col("r_prefix"))
        return found.where(F.col("digest") == F.col("r_digest")).drop("digest", "prefix", "r_digest", "r_prefix")

    # A host's rules have as many lengths of paths as are written here, however many rules there are in all.
    hosts = rules.groupBy("r_host").agg(F.collect_set(F.length("r_path")).alias("lengths")).select(F.sha2("r_host", 256).alias("r_digest"), "lengths")
    full = rules.select(
        joint_digest(F.col("r_host"), F.col("r_path")).alias("r_digest"), F.concat("r_host", "r_path").alias("rule"), "r_verdict",
        F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), (F.col("r_verdict") == "block").cast("int"), F.concat("r_host", "r_path")).alias("rank"),
    )
    # A host itself, and what follows each of its dots; a rule's empty host fits empty hosts and those that end with a dot.
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda depth: F.array_join(F.slice(labels, -depth, depth), "."))
    # Equal URLs are judged once, so a host or URL that holds many rows costs no more than another.
    expanded = met(urls.select("host", "path").distinct().select("host", "path", F.explode(F.array_distinct(suffixes)).alias("suffix")), hosts, F.sha2("suffix", 256))
    fitting = F.filter("lengths", lambda n: n <= F.length("path"))
    expressions = expanded.select("host", "path", "suffix", F.explode(F.transform(fitting, lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("beginning"))
    judged = (
        met(expressions, full, joint_digest(F.col("suffix"), F.col("beginning")))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("rule", "r_verdict"), "rank").alias("best"))
        .select(joint_digest(F.col("host"), F.col("path")).alias("url_key"), "best")
    )
    keyed = urls.withColumn("url_key", joint_digest(F.col("host"), F.col("path")))
    return keyed.join(judged, "url_key", "left").select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))


#: The rules that the query applies.
QUERY_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark, QUERY_RULES))


OP9_SQL = """
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(r_host, r_path, r_verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
SELECT page_id, host, path,
       (SELECT arg_max(r_host || r_path, length(r_host) + length(r_path)) FROM r WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)) AS rule,
       coalesce((SELECT arg_max(r_verdict, length(r_host) + length(r_path)) FROM r WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)), 'allow') AS verdict
FROM u
"""
