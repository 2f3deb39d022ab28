"""URL filter: longest-match rules, and link-graph propagation for what no rule covers.

Host edges come from the absolute links of the pages. Personalised PageRank from trusted hosts runs along the
edges, distrust from blocked hosts against them. A host whose distrust exceeds its trust and the threshold,
told in blocked pages and so free of the table's size, is blocked. Edges are aggregated before they are used; each iteration is one join on the source host (a
sort-merge join that AQE may split) and one partially aggregated sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import written

#: (verdict, host, path); a rule fits its host and all subdomains if the path starts with the rule's
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url) -> object:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://`` gives an empty host."""
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url) -> object:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host, path, rules=RULES) -> object:
    """``struct(rule, verdict)`` of the longest fitting rule, or null. Rules are few configuration entries."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    fits = [(host.endswith(f".{h}") | (host == h)) & path.startswith(p) for _, h, p in order]
    return F.coalesce(*[F.when(f, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for f, (v, h, p) in zip(fits, order)])


def host_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst, n)``: absolute links between different hosts, counted."""
    links = F.regexp_extract_all("html", F.lit("(?i)href\\s*=\\s*[\"']?((?:https?:)?//[^\"'\\s>]+)"), F.lit(1))
    cut = pages.select(host_of(F.col("url")).alias("src"), F.explode(links).alias("link"))
    full = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    return cut.select("src", host_of(full).alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-3, floor: float = 1e-9) -> DataFrame:
    """``(host, trust, distrust)``; ``seeds(host, trust, distrust)`` are the teleport weights.

    Rounds go on until no host's figure changes by more than ``tolerance`` of itself; changes below ``tolerance * floor``
    don't count. The rule looks at each host alone, so the rest of the graph doesn't end it early.

    Mass at hosts without links leaves the graph. Hosts that nothing reaches are absent.
    """
    both = edges.select("src", "dst", "n", F.lit(True).alias("forward")).union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n", F.lit(False).alias("forward")))
    out = both.groupBy("src", "forward").agg(F.sum("n").alias("all"))
    weighted = written(both.join(out, ["src", "forward"]).select("src", "dst", "forward", (F.col("n") / F.col("all")).alias("w")), "edges")
    start = written(seeds.select("host", "trust", "distrust"), "seeds")
    if not weighted.limit(1).count():
        return start.select("host", ((1 - damping) * F.col("trust")).alias("trust"), ((1 - damping) * F.col("distrust")).alias("distrust"))
    rank, k, zero = start, 0, F.lit(0.0)
    kept = start.select("host", ((1 - damping) * F.col("trust")).alias("trust"), ((1 - damping) * F.col("distrust")).alias("distrust"), zero.alias("trust_before"), zero.alias("distrust_before"))
    moved = lambda c: F.abs(F.col(c) - F.col(f"{c}_before")) > tolerance * F.greatest(F.col(c), F.lit(floor))
    while True:
        sent = weighted.join(rank.withColumnRenamed("host", "src"), "src").select(F.col("dst").alias("host"), F.when(F.col("forward"), damping * F.col("w") * F.col("trust")).otherwise(0.0).alias("trust"), F.when(~F.col("forward"), damping * F.col("w") * F.col("distrust")).otherwise(0.0).alias("distrust"), zero.alias("trust_before"), zero.alias("distrust_before"))
        before = rank.select("host", zero, zero, "trust", "distrust")
        both_rounds = written(sent.union(kept).union(before).groupBy("host").agg(*[F.sum(c).alias(c) for c in ("trust", "distrust", "trust_before", "distrust_before")]), f"rank{k}")
        rank, k = both_rounds.select("host", "trust", "distrust"), k + 1
        if not both_rounds.where(moved("trust") | moved("distrust")).limit(1).count():
            return rank


def url_filter(pages: DataFrame, rules=RULES, threshold: float = 1e-6, damping: float = 0.85, tolerance: float = 1e-3) -> DataFrame:
    """Per row of ``pages(page_id, url, html, ...)``: ``page_id, host, path, rule, verdict``.

    Hosts most of whose rule-judged pages are allowed are trusted seeds, those most of whose are blocked are blocked
    seeds, each weighted by its share of such pages. Pages without a rule get their host's verdict; a host that
    distrust doesn't reach, and an empty host, is allowed. ``threshold`` is distrust in blocked pages of the seeds. Null urls have empty host and path, null html has no link.
    Repeated rows repeat their result; an empty table gives an empty result.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("judged", rule_of(F.col("host"), F.col("path"), rules))
    votes = judged.where("host <> ''").groupBy("host").agg(F.count(F.when(F.col("judged.verdict") == "allow", 1)).alias("yes"), F.count(F.when(F.col("judged.verdict") == "block", 1)).alias("no"))
    votes = written(votes.where("yes + no > 0"), "votes")
    total = votes.agg(F.coalesce(F.sum(F.when(F.col("yes") > F.col("no"), F.col("yes"))), F.lit(1)).alias("y"), F.coalesce(F.sum(F.when(F.col("no") > F.col("yes"), F.col("no"))), F.lit(1)).alias("n")).first()
    seeds = votes.select("host", F.when(F.col("yes") > F.col("no"), F.col("yes") / float(total.y)).otherwise(0.0).alias("trust"), F.when(F.col("no") > F.col("yes"), F.col("no") / float(total.n)).otherwise(0.0).alias("distrust"))
    least = threshold / float(total.n)
    rank = propagate(written(host_edges(pages), "host_edges"), seeds, damping, tolerance, least)
    blocked = written(rank.where((F.col("distrust") > F.col("trust")) & (F.col("distrust") > least)).select("host", F.lit(True).alias("bad")), "blocked_hosts")
    out = judged.where("judged is null").join(blocked, "host", "left").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("bad"), "block").otherwise("allow").alias("verdict"))
    return judged.where("judged is not null").select("page_id", "host", "path", "judged.rule", "judged.verdict").union(out)
