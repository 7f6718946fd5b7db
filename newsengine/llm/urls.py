"""URL filters: stated host and path rules, and association rules mined from labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsengine.llm.frames import cut, fresh

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """A verdict for a host with all its subdomains, below a path prefix without its first slash."""

    verdict: str
    host: str
    path: str = ""

    @property
    def text(self) -> str:
        return f"{self.host}/{self.path}"


@dataclass(frozen=True)
class MiningLimits:
    """A rule needs so large a share of its verdict's URLs, so many of them, and so high a confidence."""

    min_share: float = 0.005
    min_rows: int = 5
    min_confidence: float = 0.6


#: Most URLs are allowed, so a rule that allows needs more.
ALLOW_LIMITS = MiningLimits(0.02, 20, 0.9)


def url_host(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), ASCII_UPPER, ASCII_LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def stated_rule(host: Column, path: Column, rules: list[UrlRule]) -> Column:
    """STRUCT of the longest fitting rule (size, rule, verdict), null if none fits."""
    fitting = [
        F.when(((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(f"/{r.path}"), F.struct(F.lit(len(r.text)).alias("size"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")))
        for r in rules
    ]
    return F.array_max(F.array_compact(F.array(*fitting))) if rules else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def url_tokens(url: Column) -> Column:
    """Distinct tokens: host labels ``h:``, path segments ``p:`` and query parts ``q:``; digits become ``#``."""
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    part = lambda text, at, mark: F.transform(F.filter(F.split(text, at), lambda x: x != ""), lambda x: F.concat(F.lit(mark), F.regexp_replace(x, "[0-9]+", "#")))
    return F.array_distinct(F.concat(part(url_host(url), r"\.", "h:"), part(url_path(url), "[/.]", "p:"), part(query, "[&=]", "q:")))


def mine_rules(labelled: DataFrame, limits: MiningLimits = MiningLimits(), url_col: str = "url", blocked_col: str = "blocked", verdict: str = "block") -> DataFrame:
    """Rules (rule_id, items, anchor, support, rows, confidence, verdict) that tell URLs of one verdict, block or allow.

    FP-growth finds the token sets that are frequent among that verdict's
    URLs; one inverted-index pass over all labelled URLs counts the rows each
    set fits, so that confidence is support / rows. Rules under the limits go,
    and so do rules with a part that is as confident. Null URLs and labels
    count for nothing; without URLs of the verdict there are no rules.
    Repeated rows count as often as they occur.
    """
    told = F.col(blocked_col).cast("boolean") == F.lit(verdict == "block")
    known = labelled.where(F.col(url_col).isNotNull() & F.col(blocked_col).isNotNull())
    rows = cut(known.select(url_tokens(F.col(url_col)).alias("items"), told.alias("told")).groupBy("items", "told").count().where(F.size("items") > 0))
    blocked = rows.where("told")
    n = blocked.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).first()["n"]
    least = max(limits.min_rows, limits.min_share * n)
    spread = blocked.select("items", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))))
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, least / n) if n else 1.0, minConfidence=1.0).fit(spread).freqItemsets if n else spread.sparkSession.createDataFrame([], "items array<string>, freq bigint")
    sets = sets.select(F.array_sort("items").alias("items"), F.col("freq").alias("support")).where(F.col("support") >= least)
    single = sets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), F.col("support").alias("times"))
    keyed = sets.withColumn("rule_id", F.concat_ws(" ", "items"))
    anchors = keyed.select("rule_id", F.explode("items").alias("token")).join(single, "token").groupBy("rule_id").agg(F.min_by("token", F.struct("times", "token")).alias("anchor"))
    index = keyed.join(anchors, "rule_id")
    fits = matches(rows.withColumnRenamed("items", "tokens"), index).groupBy("rule_id").agg(F.sum("count").alias("rows"))
    rules = index.join(fits, "rule_id").withColumn("confidence", F.col("support") / F.col("rows")).where(F.col("confidence") >= limits.min_confidence)
    wide, part = rules.alias("w"), rules.select("anchor", F.col("items").alias("part"), F.col("confidence").alias("part_confidence"))
    useless = (
        wide.select("rule_id", "items", "confidence", F.explode("items").alias("anchor"))
        .join(part, "anchor")
        .where((F.size("part") < F.size("items")) & (F.col("part_confidence") >= F.col("confidence")) & (F.size(F.array_except("part", "items")) == 0))
        .select("rule_id")
        .distinct()
    )
    return rules.join(useless, "rule_id", "left_anti").select("rule_id", "items", "anchor", "support", "rows", "confidence", F.lit(verdict).alias("verdict"))


def matches(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Pairs of a row, with its ``tokens``, and a rule whose items are all among them.

    The inverted index lists each rule under its rarest token only, so a row
    meets only rules of tokens that it holds.
    """
    found = rows.withColumn("anchor", F.explode("tokens")).join(rules, "anchor")
    return found.where(F.size(F.array_except("items", "tokens")) == 0)


def judge_urls(pages: DataFrame, rules: list[UrlRule], mined: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict, mined_rule and confidence.

    A stated rule decides first, the longest one; else a mined rule that the
    URL fits, the most confident of those that block, or if none does of those
    that allow; else it is allowed. Null URLs and
    those without ``://`` have an empty host and path. Every row is judged,
    repeated ones alike; equal URLs are matched once. Clashing columns are
    replaced. ``rules`` is a stated list; ``mined`` is joined, never collected.
    """
    url, stated, mined_col = fresh(pages, "__url", "__rule", "__mined")
    urls = pages.where(F.col(url_col).isNotNull()).select(F.col(url_col).alias(url)).distinct().select(url, url_tokens(F.col(url)).alias("tokens"))
    best = matches(urls, mined).groupBy(url).agg(F.max_by(F.struct("rule_id", "confidence", "verdict"), F.struct(F.col("verdict") == "block", "confidence", "support", "rule_id")).alias(mined_col))
    own = [c for c in pages.columns if c.lower() not in {"host", "path", "rule", "verdict", "mined_rule", "confidence"}]
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    judged = pages.select(*own, host.alias("host"), path.alias("path"), stated_rule(host, path, rules).alias(stated), F.col(url_col).alias(f"{url}_of"))
    judged = judged.join(best, F.col(f"{url}_of") == F.col(url), "left")
    return judged.select(
        *own,
        "host",
        "path",
        F.col(stated)["rule"].alias("rule"),
        F.coalesce(F.col(stated)["verdict"], F.col(mined_col)["verdict"], F.lit("allow")).alias("verdict"),
        F.col(mined_col)["rule_id"].alias("mined_rule"),
        F.col(mined_col)["confidence"].alias("confidence"),
    )
