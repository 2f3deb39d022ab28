"""Secret scan with a trigram inverted index.

Each rule's whole regex gives a Boolean trigram query (``trigrams``), as an OR of ANDs. The index holds the postings (trigram, row) of the trigrams that some rule needs, over lower-cased
texts. Intersecting postings gives each rule's candidate rows, and the regex verifies them. A rule whose matches need
not hold any trigram scans every row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spans import spans
from ._store import written
from .trigrams import ANY, Query, trigram_query


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    query: Query
    group: int = 0  # the group whose length counts
    least: int = 1


def mandatory(pattern: str) -> tuple[str, ...]:
    """For reports: the alternative literals that begin ``pattern``, of its leading group or its leading literal run.

    Only what is certain is derived: an optional character ends or forks a literal, anything else ends it.
    Literals under three characters give no trigram, and then the rule has none.
    """
    body = re.sub(r"^\(\?i\)", "", pattern)
    grouped = re.match(r"\((?:\?i:|\?:)?([A-Za-z0-9_?|.\\-]+)\)", body)
    alternatives = grouped.group(1).split("|") if grouped else [re.match(r"[A-Za-z0-9_-]*", body).group(0)]
    out: list[str] = []
    for x in alternatives:
        forks = [""]
        for c, optional in re.findall(r"(\\?[^?])(\??)", x):
            c = c[-1]
            forks = [f + c for f in forks] + (forks if optional else [])
        out += [f.lower() for f in forks]
    return tuple(dict.fromkeys(out)) if out and all(len(f) >= 3 for f in out) else ()


def rule(kind: str, pattern: str, group: int = 0, least: int = 1) -> Rule:
    return Rule(kind, pattern, trigram_query(pattern), group, least)


BASE_RULES = (
    rule("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    rule("access", "AKIA[A-Z0-9]+", 0, 16),
    rule("hex", "[0-9a-f]+", 0, 32),
)

#: beside the base: well-known token prefixes and private key headers
MORE_RULES = (
    rule("github", "ghp_[A-Za-z0-9]+", 0, 40),
    rule("slack", "xoxb-[A-Za-z0-9-]+", 0, 24),
    rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)


def candidates(keyed: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(doc_id, doc_key, rules)``: for each row key of ``keyed(doc_id, doc_key, text)`` the numbers of the indexed rules that its postings allow."""
    clauses = [(k, sorted(clause)) for k, r in enumerate(rules) if r.query != ANY for clause in r.query]
    needed = sorted({t for _, ts in clauses for t in ts})
    low = F.lower("text")
    held = F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(k)) for k, t in enumerate(needed)])
    postings = keyed.select("doc_id", "doc_key", F.explode(F.array_compact(held)).alias("trigram")).distinct()
    number = {t: k for k, t in enumerate(needed)}
    # every clause counts the postings it needs: an AND is a full count, an OR is any clause of the rule
    counts = [F.count(F.when(F.col("trigram").isin([number[t] for t in ts]), 1)) == len(ts) for _, ts in clauses]
    met = postings.groupBy("doc_id", "doc_key").agg(F.array_compact(F.array(*[F.when(c, F.lit(k)) for c, (k, _) in zip(counts, clauses)])).alias("rules"))
    return met.where(F.size("rules") > 0).select("doc_id", "doc_key", F.array_distinct("rules").alias("rules"))


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """Per row of ``docs(doc_id, text, ...)``: ``doc_id, found`` = array of (start, kind number, end, kind), in order.

    Positions are code points, end exclusive; each kind's matches are leftmost and non-overlapping, and a match whose
    counted group is too short is dropped. Spans of one start are in the order of the rules. Null texts count as empty,
    very long ones are scanned whole. Rows are told apart by doc_id and a hash of the text, so repeated rows repeat their
    results, and a null doc_id is kept. An empty table gives an empty result. Other columns are not looked at.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text")).withColumn("doc_key", F.xxhash64("doc_id", "text"))

    def matches(within, k):
        r = rules[k]
        # scanning for runs of the needed length gives the same spans as scanning for all runs and dropping the short ones
        pattern = f"{r.pattern[:-1]}{{{r.least},}}" if r.kind == "hex" else r.pattern
        size = (lambda x: F.length(F.regexp_extract(x["match"], r.pattern, r.group))) if r.group else (lambda x: x["end"] - x["start"])
        long = F.filter(spans(within, pattern), lambda x: size(x) >= r.least)
        return F.transform(long, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind_no"), x["end"].alias("end"), F.lit(r.kind).alias("kind")))

    def verified(numbers, allowed=None):
        parts = [matches(F.col("text") if allowed is None else F.when(F.array_contains(allowed, k), F.col("text")).otherwise(""), k) for k in numbers]
        return F.concat(*parts) if parts else F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint,kind:string>>")

    indexed = [k for k, r in enumerate(rules) if r.query != ANY]
    scanned = [k for k, r in enumerate(rules) if r.query == ANY]
    allowed = written(candidates(keyed, rules), "candidates") if indexed else None
    none = F.array().cast("array<struct<start:bigint,kind_no:int,end:bigint,kind:string>>")
    whole = keyed.select("doc_id", "doc_key", verified(scanned).alias("scanned"))
    if allowed is None:
        return whole.select("doc_id", F.array_sort("scanned").alias("found"))
    named = allowed.select(F.col("doc_id").alias("own_id"), F.col("doc_key").alias("own_key"), "rules")
    same = (F.col("doc_key") == F.col("own_key")) & F.col("doc_id").eqNullSafe(F.col("own_id"))
    picked = keyed.join(named, same).select("own_id", "own_key", verified(indexed, F.col("rules")).alias("looked"))
    looked = picked.dropDuplicates(["own_id", "own_key"])
    return whole.join(looked, same, "left").select("doc_id", F.array_sort(F.concat("scanned", F.coalesce("looked", none))).alias("found"))
