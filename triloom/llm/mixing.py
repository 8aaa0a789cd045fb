"""Documents of several sources mixed to target shares of a total number of tokens.

Weighted fair queueing: the documents of a source are shuffled; a document's virtual
finish time is the number of tokens of its source up to and including it, divided by the
source's target share. Taking all documents in the order of their finish times serves
every source in proportion to its share at any moment. The order is range-sorted over
the whole mixture and cut at the total budget. A source that runs out is shuffled again
and repeated, at most ``max_repeats`` times altogether; if it runs out for good, the
others share what is left in the proportion of their targets.

Both running sums (tokens inside a source, tokens of the mixture) are formed in small
random or range buckets, so a source that holds a third of all rows is no single task.

Defined results: source names are compared without case, blanks and punctuation; a
document without source, of a source without target, or without tokens is not used; a
target without documents, or with a share that is not positive, or with less than one
use, gets nothing and its share goes to the others; the share reached is reported with
every row and in ``mixture_shares``; empty tables give empty tables.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triloom.functions.naming import squeeze
from triloom.functions.prefix import bucketed_running_sum
from triloom.llm.tokens import deal_copies, token_count
from triloom.runtime import settle

BUCKET_TOKENS = 2_000_000
MOST_SOURCES = 10_000


class Share(NamedTuple):
    source: str
    key: str
    weight: float
    repeats: int
    tokens: int
    documents: int
    longest: int


def measured(documents: DataFrame, seed: int = 17, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, source_key, n_tokens and a random place of every document, written down once."""
    rows = documents.select("doc_id", squeeze("source").alias("source_key"), "text")
    rows = rows.where("source_key IS NOT NULL AND text IS NOT NULL AND text <> ''")
    sized = rows.select("doc_id", "source_key", token_count("text", tokenizer_path).alias("n_tokens"), F.xxhash64("text").alias("text_hash"))
    told = deal_copies(sized.where("n_tokens > 0"), ["doc_id", "source_key", "n_tokens", "text_hash"])
    return settle(told.select("doc_id", "source_key", "n_tokens", F.xxhash64(F.lit(seed), "doc_id", "text_hash", "copy").alias("place")))[0]


def source_totals(sized: DataFrame, targets: DataFrame) -> list[Share]:
    """The targets with the size of their documents: a setting of at most ``MOST_SOURCES`` rows."""
    t = targets.select("source", squeeze("source").alias("source_key"), "target_share", "max_repeats")
    sums = sized.groupBy("source_key").agg(
        F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("n_tokens").alias("longest")
    )
    rows = t.join(sums, "source_key", "left").orderBy("source_key", "source").take(MOST_SOURCES + 1)
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    seen: set[str] = set()
    out = []
    for r in rows:
        if r["source_key"] is None or r["source_key"] in seen:
            continue  # a name that is listed twice counts once
        seen.add(r["source_key"])
        share = r["target_share"]
        weight = float(share) if share is not None and share > 0 and math.isfinite(share) else 0.0
        out.append(Share(r["source"], r["source_key"], weight, max(0, r["max_repeats"] or 0), r["tokens"] or 0, r["documents"] or 0, r["longest"] or 0))
    return out


def virtual_end(shares: Sequence[Share], budget: int) -> float:
    """The virtual time at which the sources together have given ``budget`` tokens."""
    live = sorted((s for s in shares if s.weight and s.tokens and s.repeats), key=lambda s: s.repeats * s.tokens / s.weight)
    given, weight = 0.0, sum(s.weight for s in live)
    for s in live:
        end = s.repeats * s.tokens / s.weight
        if given + weight * end >= budget:
            return (budget - given) / weight
        given += s.repeats * s.tokens
        weight -= s.weight
    return math.inf


def mix(sized: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 17) -> DataFrame:
    """The mixture in its order: source, doc_id, pass_no, n_tokens, finish_time, running_tokens.

    ``budget`` is the total number of tokens; by default as many as the documents of the
    listed sources have.
    """
    spark: SparkSession = sized.sparkSession
    shares = source_totals(sized, targets)
    live = [s for s in shares if s.weight and s.tokens and s.repeats]
    if budget is None:
        budget = sum(s.tokens for s in live)
    budget = min(budget, sum(s.tokens * s.repeats for s in live))
    end = virtual_end(live, budget)
    if math.isinf(end):
        end = max((s.repeats * s.tokens / s.weight for s in live), default=0.0)
    still = [s for s in live if s.repeats * s.tokens / s.weight >= end * (1 - 1e-9)]
    # beyond the ideal end less than one document of each source can still fit
    limit = end + (sum(s.longest for s in live) + 1) / max(1e-12, sum(s.weight for s in still)) if live else 0.0
    passes = {s.key: min(s.repeats, max(1, math.ceil(s.weight * limit / s.tokens))) for s in live}
    table = spark.createDataFrame(
        [(s.key, s.source, s.weight, s.tokens, passes[s.key], max(1, -(-s.tokens // BUCKET_TOKENS))) for s in live],
        "source_key string, source string, weight double, tokens bigint, passes int, buckets bigint",
    )
    docs = sized.join(F.broadcast(table), "source_key")  # at most MOST_SOURCES rows
    docs = docs.withColumn("pass_no", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    u = F.xxhash64(F.lit(seed), F.col("pass_no"), F.col("place"))
    docs = docs.withColumn("u", u).withColumn("slot", F.floor((F.col("u") / F.lit(2.0**64) + 0.5) * F.col("buckets")))
    docs = bucketed_running_sum(docs, "n_tokens", "slot", ["u", "doc_id", "place"], "inside", by=["source_key", "pass_no"])
    finish = ((F.col("pass_no") - 1) * F.col("tokens") + F.col("inside")) / F.col("weight")
    timed = docs.withColumn("finish_time", finish).where(F.col("finish_time") <= F.lit(float(limit)))
    ranges = max(1, -(-int(budget) // BUCKET_TOKENS))
    step = max(limit, 1e-12) / ranges
    timed = timed.withColumn("slot", F.floor(F.col("finish_time") / F.lit(step)))
    ordered, _ = settle(
        timed.select("source", "source_key", "doc_id", "place", "pass_no", "n_tokens", "finish_time", "slot")
        .repartitionByRange("slot")
    )
    order = ["finish_time", "source_key", "pass_no", "doc_id", "place"]
    summed = bucketed_running_sum(ordered, "n_tokens", "slot", order, "running_tokens")
    return summed.where(F.col("running_tokens") <= F.lit(int(budget))).select(
        "source", "doc_id", "pass_no", "n_tokens", "finish_time", "running_tokens"
    )


def mixture_shares(mixture: DataFrame, sized: DataFrame, targets: DataFrame, budget: int | None = None) -> DataFrame:
    """Of every listed source: target, feasible and actual share, shortfall, tokens, documents, most uses, the longest document.

    The feasible share is what the target comes to when sources that run out for good leave
    their rest to the others. ``shortfall`` is what the actual share lacks of it; it is
    within ``share_bound``, since a source may stop short of its time by one document only.
    """
    spark = mixture.sparkSession
    shares = source_totals(sized, targets)
    live = [s for s in shares if s.weight and s.tokens and s.repeats]
    if budget is None:
        budget = sum(s.tokens for s in live)
    budget = min(budget, sum(s.tokens * s.repeats for s in live))
    end = virtual_end(live, budget)
    total = max(1, mixture.agg(F.sum("n_tokens")).first()[0] or 0)
    longest, weight = sum(s.longest for s in live), sum(s.weight for s in live if s.repeats * s.tokens >= end * s.weight * (1 - 1e-9)) or 1.0
    rows = []
    for s in shares:
        given = min(s.weight * end, float(s.repeats * s.tokens)) if s in live else 0.0
        bound = (s.longest + longest * s.weight / weight) / total + abs(1 - max(1, budget) / total) if s in live else 0.0
        rows.append((s.source, s.weight, given / max(1, budget), bound, s.repeats, s.tokens, s.documents, s.longest))
    table = spark.createDataFrame(
        rows,
        "source string, target_share double, feasible_share double, share_bound double, max_repeats int, tokens_available bigint, documents_available bigint, longest_document bigint",
    )
    got = mixture.groupBy("source").agg(
        F.sum("n_tokens").alias("tokens_used"), F.count(F.lit(1)).alias("documents_used"), F.max("pass_no").alias("passes_used")
    )
    actual = F.coalesce("tokens_used", F.lit(0)) / F.lit(float(total))
    return table.join(got, "source", "left").select(
        "source", "target_share", "feasible_share", actual.alias("actual_share"), (F.col("feasible_share") - actual).alias("shortfall"), "share_bound",
        F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"), F.coalesce("documents_used", F.lit(0)).alias("documents_used"),
        F.coalesce("passes_used", F.lit(0)).alias("passes_used"), "max_repeats", "tokens_available", "documents_available", "longest_document",
    )
