"""URL filters, in DataFrame functions only.

Every rule is a host, with all its subdomains, and the beginning of a path. It has a set of literal tokens, the labels
of its host and the whole segments of its path, and is indexed by the one of these that is rarest over all URLs. The
tokens of the distinct URLs fetch the rules to try by a join, whatever their number, and only those run their
expressions; the longest rule that fits decides. Verdicts go back to the pages by URL: pages of URLs that no rule fits
are found by a bit map and stay where they are, and URLs of more than one page in HOT_SHARE, of which there are fewer
than HOT_SHARE, are broadcast, so no frequent URL is dealt to one task.

Cases: a null url, or one without "://", has an empty host and path and meets no rule; an empty host is met by none. A
url that no rule fits gets the default verdict. Very long urls are as others. Of equally long rules that fit, the last
by code point decides. Repeated rows are judged one by one. An empty table gives no rows; without rules all pages get
the default. Other columns may have any names: they go along in one struct.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrum.llm.common import BitMap, as_row, checkpoint, table

HOT_SHARE = 1000
#: Bytes of rules that may be broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 8 << 20


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        """Over the host: the rule's own, or a name below it."""
        return r"(?:^|\.)" + re.sub(r"([^A-Za-z0-9_])", r"\\\1", self.host) + r"\z"

    @property
    def tokens(self) -> list[str]:
        whole = self.path.split("/")[1:-1]  # the last piece may go on in a url
        return [f"h:{x}" for x in self.host.split(".") if x] + [f"p:{x}" for x in whole if x]


#: Fixed values.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def url_host(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def url_tokens(host: Column, path: Column) -> Column:
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, segments))


def rule_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of rules, to be broadcast if their bytes are few."""
    out = spark.createDataFrame(rows, schema)
    return F.broadcast(out) if sum(len(str(x)) * 4 + 16 for r in rows for x in r) <= BROADCAST_BYTES else out


def rarest_tokens(urls: DataFrame, rules: list[Rule]) -> dict[Rule, str]:
    """The token that each rule is indexed by. urls: host, path, n (pages). Counts of the rules' own tokens come to the driver."""
    mine = rule_table(urls.sparkSession, sorted({(t,) for r in rules for t in r.tokens}), "token string")
    tokens = urls.select("n", F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
    counts = {r["token"]: r["n"] for r in tokens.join(mine, "token").groupBy("token").agg(F.sum("n").alias("n")).collect()}
    return {r: min(r.tokens, key=lambda t: (counts.get(t, 0), t)) for r in rules}


def judge_urls(pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """(row, host, path, rule, verdict): pages' rows, each as one struct, and their verdicts; rule is null if none fits."""
    if any(not r.tokens for r in rules):
        raise ValueError("a rule needs a host")
    spark = pages.sparkSession
    rows = pages.select(as_row(pages).alias("row"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    judged = F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    if not rules:
        return rows.select("row", "host", "path", judged["rule"].alias("rule"), F.lit(default).alias("verdict"))
    urls = checkpoint(rows.where("host <> ''").groupBy("host", "path").agg(F.count("*").alias("n")))
    index = rule_table(spark, [(t, r.name, r.pattern, r.path, r.verdict) for r, t in rarest_tokens(urls, rules).items()], "token string, rule string, pattern string, start string, verdict string")
    tried = urls.select("host", "path", "n", F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token")).join(index, "token")
    fits = tried.where(F.regexp_like("host", F.col("pattern")) & F.startswith(F.col("path"), F.col("start")))
    best = F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best")
    found = checkpoint(fits.groupBy("host", "path").agg(F.first("n").alias("n"), best))

    url = F.xxhash64("host", "path")
    totals = found.agg(F.count("*").alias("urls"), F.sum("n").alias("pages")).first()
    rows = BitMap(found.select(url.alias("b")), "b", totals["urls"]).flag(rows, url, "met")
    hot = found.where(F.col("n") > (totals["pages"] or 0) / HOT_SHARE).select("host", "path", "best")
    met = rows.where("met").drop("met").join(F.broadcast(hot), ["host", "path"], "left")
    few = met.where("best IS NULL").drop("best").join(found.select("host", "path", "best"), ["host", "path"], "left")
    out = rows.where("NOT met").drop("met").withColumn("best", judged).unionByName(met.where("best IS NOT NULL")).unionByName(few)
    return out.select("row", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), list(RULES))
    return out.select("row.page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), r(verdict, rhost, rpath) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), best AS (
  SELECT page_id, host, path, max({'n': length(rhost || rpath), 'rule': rhost || rpath, 'verdict': verdict}) AS b
  FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY ALL
)
SELECT u.page_id, u.host, u.path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict
FROM u LEFT JOIN best USING (page_id, host, path)
"""

QUERIES = {"op9_url_filter": op9_url_filter}
ORACLES = {"op9_url_filter": ORACLE}
