"""URL filters by propagation over the host graph.

Rules judge what they fit. All other hosts are judged by two personalised PageRanks over host edges: trust flows along links from
hosts that rules mostly allow, distrust against them from hosts that rules mostly block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvloom.llm import shared

DAMPING = 0.85
#: Walks go on until a round changes all scores together by no more than this share of the least seed's.
TOLERANCE = 1e-4
#: Rounds between tables of the shared folder, which cut the lineage, and the most of these before a walk that doesn't settle is an error.
CUT, CUTS = 5, 100
#: A host is blocked if its distrust is more than so many times its trust.
RATIO = 2.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Links with a host, and a host that a footer names after a copyright sign.
LINKS = r"""(?i)(?:href|src)\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""
CREDITS = r"(?i)(?:&copy;|©)\s*((?:[a-z0-9-]+\.)+[a-z]{2,})"


@dataclass(frozen=True)
class Rule:
    allow: bool
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule(True, "org", "/"), Rule(False, "example.org", "/es/"), Rule(False, "example.org", "/en/1"), Rule(True, "com", "/fr/"), Rule(False, "com", "/de/"))


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, with A to Z in lower case; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host to the next ? or #."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting(rules: tuple[Rule, ...], host: Column, path: Column, what) -> Column:
    """what(rule) of the longest rule that fits, of equally long ones the first by text; null if none fits. Rules stand in the plan, so some thousand at most."""
    out = F.lit(None)
    by_text = sorted(rules, key=lambda r: r.text, reverse=True)
    for r in sorted(by_text, key=lambda r: len(r.text)):  # the last is asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(what(r))).otherwise(out)
    return out


def edges(pages: DataFrame) -> DataFrame:
    """(source, target, n): how many pages of a host name another host. Each page counts a target once."""
    linked = F.transform(F.regexp_extract_all("html", F.lit(LINKS), 1), lambda u: host_of(F.concat(F.lit("x:"), F.regexp_replace(u, r"^[^/]*//", "//"))))
    credited = F.transform(F.regexp_extract_all("html", F.lit(CREDITS), 1), lambda h: F.translate(h, UPPER, LOWER))
    named = F.concat(linked, credited)
    rows = pages.select(host_of(F.col("url")).alias("source"), F.explode(F.array_distinct(named)).alias("target"))
    return rows.filter("source <> '' AND target <> '' AND source <> target").groupBy("source", "target").agg(F.count("*").alias("n"))


def personalised(links: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """(host, score) from links (source, target, n) and seeds (host, weight): random walks that start at seeds in proportion to their weight, and end
    with chance 1 - damping at each step, or where a host has no links. Hosts that no walk reaches don't come up; walks of any length count, as far as
    they move scores by more than the tolerance."""
    with shared.scratch():
        return shared.written(_walked(links, seeds, tolerance, damping), "ranks", keep=True)


def _walked(links: DataFrame, seeds: DataFrame, tolerance: float, damping: float) -> DataFrame:
    out_weight = links.groupBy("source").agg(F.sum("n").alias("total"))
    steps = shared.written(links.join(out_weight, "source").select("source", "target", (F.col("n") / F.col("total")).alias("share")), "steps")
    total, least = seeds.agg(F.sum("weight"), F.min("weight")).first()
    start = shared.written(seeds.select("host", (F.col("weight") / F.lit(float(total or 1))).alias("start")), "seeds")
    enough = tolerance * (least or 0) / float(total or 1)
    score = start.select("host", F.col("start").alias("score"))
    for _ in range(CUTS):
        for _ in range(CUT):
            before = score
            moved = before.join(steps, before["host"] == steps["source"]).select(F.col("target").alias("host"), (damping * F.col("score") * F.col("share")).alias("score"))
            begun = start.select("host", ((1 - damping) * F.col("start")).alias("score"))
            score = moved.unionByName(begun).groupBy("host").agg(F.sum("score").alias("score"))
        # a host that is reached in one round is reached in the next, but for seeds, which are in all
        both = score.join(before.withColumnRenamed("score", "before"), "host", "full")
        both = shared.written(both.select("host", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("before", F.lit(0.0)).alias("before")), "scores")
        score = both.filter("score > 0").select("host", "score")
        if (both.agg(F.sum(F.abs(F.col("score") - F.col("before")))).first()[0] or 0.0) <= enough:
            return score
    raise RuntimeError("the walk did not settle")


#: Digits of scores that count, whatever their size: sums may differ in the last ones from run to run.
SHOWN = "cast(format_string('%.6e', coalesce({0}, 0D)) as double)"


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, ratio: float = RATIO) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict, trust, distrust.

    A host is a trusted seed by as many pages as rules allow more than they block, a blocked seed the other way round. A page no rule fits is
    blocked if its host's distrust is more than `ratio` times its trust, so hosts that no links reach are allowed. A null url, or one
    without ://, has an empty host and path and is allowed. Pages without html have no links; html of any length is searched whole. Other
    columns are not read, whatever their names; repeated rows give repeated rows and count as pages of their own. An empty table gives no rows.
    """
    url = F.col("url")
    sites = pages.select("page_id", F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"))
    host, path = F.col("host"), F.col("path")
    sites = sites.withColumn("rule", fitting(rules, host, path, lambda r: r.text)).withColumn("by_rule", fitting(rules, host, path, lambda r: r.allow))
    balance = F.sum(F.when(F.col("by_rule"), 1).when(~F.col("by_rule"), -1).otherwise(0))
    with shared.scratch():
        hosts = shared.written(sites.filter("host <> ''").groupBy("host").agg(balance.alias("balance")), "hosts")
        links = shared.written(edges(pages.select("url", "html")), "edges")
        trust = personalised(links, hosts.filter("balance > 0").select("host", F.col("balance").alias("weight")))
        back = links.select(F.col("target").alias("source"), F.col("source").alias("target"), "n")
        distrust = personalised(back, hosts.filter("balance < 0").select("host", (-F.col("balance")).alias("weight")))
        scores = hosts.select("host").join(trust.withColumnRenamed("score", "trust"), "host", "left").join(distrust.withColumnRenamed("score", "distrust"), "host", "left")
        scores = shared.written(scores.select("host", F.expr(SHOWN.format("trust")).alias("trust"), F.expr(SHOWN.format("distrust")).alias("distrust")), "verdicts", keep=True)
    judged = sites.join(scores, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    allow = F.coalesce(F.col("by_rule"), distrust <= ratio * trust)
    verdict = F.when(allow, "allow").otherwise("block")
    return judged.select("page_id", "host", "path", F.col("rule").cast("string").alias("rule"), verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
