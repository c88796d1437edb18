"""URL filters: URLs expand into host-suffix and path-prefix expressions that meet the rules on short hash prefixes.

The rules' expressions are hashed; a URL's expressions join on the first 8 hex digits of the hash, the full digest
confirms, and the longest rule that fits decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules up to which their table is broadcast; more are joined by shuffle.
BROADCAST_RULES = 100_000
#: Distinct lengths of rules' paths up to which each is an expression of the plan; beyond, all prefixes up to the longest are tried.
FEW_LENGTHS = 64
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first :// up to / ? # or the end, A-Z lower-cased; then up to ? # or the end. Without ://: both empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"\A[^?#]*", 0)
    return F.translate(F.coalesce(host, F.lit("")), _UPPER, _LOWER), F.coalesce(path, F.lit(""))


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row.

    rules: (verdict, host, path), path "" or starting with /. A rule fits its host (whole labels) and all subdomains if the
    path starts with the rule's, character by character. The longest rule that fits (host and path
    together) decides; of equally long ones the one with the longer host, and of repeated rules a block. Without a
    fitting rule ``rule`` is null and the verdict ``default``.

    Null URLs and URLs without :// have an empty host and path. Rules with a null host, or an empty one, fit
    nothing; a null path counts as empty. Repeated rows and null ids each give a row, other columns are not
    read, an empty table (of pages or rules) is no error.
    """
    clean = rules.where("coalesce(host, '') <> ''").select("verdict", F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"))
    expression = F.concat(F.col("rule_host"), F.lit("\n"), F.col("rule_path"))
    keyed = clean.groupBy("rule_host", "rule_path").agg(F.min(F.struct((F.col("verdict") != "block").alias("k"), F.col("verdict").alias("verdict")))["verdict"].alias("rule_verdict"))
    keyed = keyed.withColumn("full", F.sha2(expression, 256)).withColumn("short", F.substring("full", 1, 8)).withColumn("rank", F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host")))
    bound = clean.agg(F.max(F.size(F.split("rule_host", r"\.", -1))).alias("labels"), F.max(F.length("rule_path")).alias("path"), F.count_distinct(F.length("rule_path")).alias("lengths")).first()
    few = keyed.count() <= BROADCAST_RULES
    host, path = url_parts(F.col("url"))
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    # no rule has more labels or a longer path than the longest, so no longer suffix or prefix can meet one
    labels = F.split("host", r"\.", -1)
    most = F.least(F.size(labels), F.lit(bound["labels"] or 0))
    suffixes = F.when((F.col("host") == "") | (most < 1), F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda i: F.array_join(F.slice(labels, -i, i), ".")))
    if bound["lengths"] <= FEW_LENGTHS:
        lengths = [r.n for r in clean.select(F.length("rule_path").alias("n")).distinct().orderBy("n").limit(FEW_LENGTHS).collect()]
        prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda p: p.isNotNull()) if lengths else F.array().cast("array<string>")
    else:
        prefixes = F.transform(F.sequence(F.lit(0), F.least(F.length("path"), F.lit(bound["path"]))), lambda n: F.substring(F.col("path"), F.lit(1), n))
    both = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit("\n"), p))))
    distinct = base.groupBy("host", "path").agg(F.count("*").alias("_n")).select("host", "path", F.explode(both).alias("expression"))
    asked = distinct.withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, 8))
    met = asked.join(F.broadcast(keyed) if few else keyed, "short").where(F.col("digest") == F.col("full"))
    best = met.groupBy("host", "path").agg(F.max(F.struct("rank", "rule_verdict", "rule_host", "rule_path")).alias("b"))
    out = base.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.concat("b.rule_host", "b.rule_path").alias("rule"), F.coalesce("b.rule_verdict", F.lit(default)).alias("verdict"))
