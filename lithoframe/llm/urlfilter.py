"""URL verdicts: explicit rules first, then trust and distrust propagated over the host graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Written, small

#: (verdict, host, path): a rule fits its host and all subdomains where the url's path starts with its own.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Share of a host's score that its neighbours give, rounds of propagation, and the lead of distrust that blocks.
DAMPING, ROUNDS, THRESHOLD = 0.5, 8, 0.25


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule (host and path together) that fits, as struct (verdict, rule); null where none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r))
    table = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit("." + h).alias("tail"), F.lit(p).alias("path"), F.lit(h + p).alias("rule")) for v, h, p in ordered])
    fits = F.filter(table, lambda r: ((host == r["host"]) | host.endswith(r["tail"])) & path.startswith(r["path"]))
    return F.get(F.transform(fits, lambda r: F.struct(r["verdict"], r["rule"])), F.lit(0))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, score): personalised PageRank from seeds (host, seed) over edges (src, dst, share), the shares of a src
    adding up to 1. score = (1 - damping) * seed + damping * sum of share * score over edges into the host.

    Both sides hold one row per host or edge, aggregated before any join; the scores are written after every round."""
    now = Written(seeds.select("host", ((1 - damping) * F.col("seed")).alias("score")), "scores")
    base = now
    for _ in range(rounds):
        moved = edges.join(small(now.df), edges["src"] == now.df["host"]).groupBy("dst").agg(F.sum(damping * F.col("share") * F.col("score")).alias("score"))
        both = moved.select(F.col("dst").alias("host"), "score").unionAll(base.df.select("host", "score"))
        nxt = Written(both.groupBy("host").agg(F.sum("score").alias("score")), "scores")
        if now is not base:
            now.drop()
        now = nxt
    return now.df


def shares(links: DataFrame, src: str, dst: str) -> DataFrame:
    """(src, dst, share) of links (from_host, to_host, n), in either direction."""
    out = links.groupBy(F.col(src).alias("_s")).agg(F.sum("n").alias("all"))
    return links.join(out, links[src] == out["_s"]).select(F.col(src).alias("src"), F.col(dst).alias("dst"), (F.col("n") / F.col("all")).alias("share"))


def judge(pages: DataFrame, rules: tuple = RULES, damping: float = DAMPING, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, trust, distrust.

    A host's trust seed is the share of its pages that rules allow, its distrust seed the share they block. Trust flows
    along the links of its pages, distrust against them. A page that no rule fits is blocked where its host's distrust
    leads its trust by threshold * (1 - damping) or more, and allowed otherwise, as are pages with an empty host.
    Links are absolute http(s) references in html to other hosts, one row per pair of hosts however often they repeat.
    Null html has no links; repeated page_ids are judged one by one; other columns are ignored. Of rules of equal length
    the one whose verdict, then host, then path is first by code point wins; a tie of trust and distrust allows. Urls and
    html of any length are searched whole; an empty table gives no rows."""
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    own = own.withColumn("_fit", rule_of(F.col("host"), F.col("path"), rules))
    hosts = Written(
        own.where("host <> ''").groupBy("host").agg(
            F.avg(F.when(F.col("_fit.verdict") == "allow", 1.0).otherwise(0.0)).alias("allowed"),
            F.avg(F.when(F.col("_fit.verdict") == "block", 1.0).otherwise(0.0)).alias("blocked"),
        ),
        "hosts",
    ).df
    target = F.explode(F.regexp_extract_all(F.col("html"), F.lit(r"""(?:href|src)\s*+=\s*+["']?(https?://[^"'\s>]++)"""), F.lit(1)))
    links = pages.where("html LIKE '%http%'").select(host_of(F.col("url")).alias("from_host"), target.alias("to_url"))
    links = links.select("from_host", host_of(F.col("to_url")).alias("to_host")).where("from_host <> '' AND to_host <> '' AND from_host <> to_host")
    links = Written(links.groupBy("from_host", "to_host").agg(F.count("*").alias("n")), "links").df
    trust, distrust = hosts.select("host", F.col("allowed").alias("seed")), hosts.select("host", F.col("blocked").alias("seed"))
    steps = 0 if links.isEmpty() else rounds
    trust = propagate(trust, shares(links, "from_host", "to_host"), damping, steps).select("host", F.col("score").alias("trust"))
    distrust = propagate(distrust, shares(links, "to_host", "from_host"), damping, steps).select("host", F.col("score").alias("distrust"))
    scores = Written(hosts.select("host").join(trust, "host", "left").join(distrust, "host", "left"), "host-scores").df.select(F.col("host").alias("_host"), "trust", "distrust")
    lead = F.coalesce(F.col("distrust") - F.col("trust"), F.lit(0.0))
    method = F.when(lead >= threshold * (1 - damping), "block").otherwise("allow")
    return own.join(small(scores), own["host"] == scores["_host"], "left").select(
        "page_id", "host", "path", F.col("_fit.rule").alias("rule"), F.coalesce(F.col("_fit.verdict"), method).alias("verdict"), "trust", "distrust",
    )
