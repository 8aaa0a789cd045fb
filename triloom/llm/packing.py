"""Documents of varying length in containers of fixed capacity, at little unused space and balanced cost.

Cost-balanced packing: the cost of a document in training is estimated as
``linear * n + quadratic * n * n`` (the quadratic part is attention inside the document).
Documents are assigned in descending length, each to the sequence of lowest cost that
still has room; only if none has room is another sequence opened.

The documents are dealt at random into shards of ``shard_tokens`` tokens, and each shard
is packed by itself; a shard wastes at most the slack of its last sequences, so the
waste shrinks with the shard size, not with the number of shards. A document is dealt by
its id, its text and the number of the copy, so copies of one document are spread as
well, and the result does not depend on where a row stands.

Defined results: a document longer than the capacity is split into full pieces, each a
container of its own, and a rest that is packed like a document; null and empty texts
take no space and are in no container; repeated rows are packed as often as they stand
there; a capacity that is null or below 1 packs nothing; empty tables give empty tables.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triloom.llm.tokens import deal_copies, token_count
from triloom.runtime import settle

SHARD_TOKENS = 4_000_000
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: A table of capacities is a setting; more rows than this are an error.
MOST_PACKS = 1000

_PLACED = "pack_name string, shard int, seq bigint, doc_id bigint, piece_no int, start_token bigint, n_tokens bigint"


def measured(documents: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, text_hash, copy and a random deal ``u`` of every document with tokens, written down once."""
    rows = documents.select("doc_id", "text").where("text IS NOT NULL AND text <> ''")
    sized = rows.select("doc_id", token_count("text", tokenizer_path).alias("n_tokens"), F.xxhash64("text").alias("text_hash"))
    told = deal_copies(sized.where("n_tokens > 0"), ["doc_id", "n_tokens", "text_hash"])
    return settle(told.withColumn("u", F.xxhash64("doc_id", "text_hash", "copy")))[0]


def assign_sequences(lengths: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> np.ndarray:
    """Sequence number of each document of one shard (lengths between 1 and the capacity).

    A heap holds the sequences with room for the length at hand by cost; those with less
    room wait by their room until the lengths have come down to it.
    """
    order = np.argsort(-lengths, kind="stable")
    out = np.empty(len(lengths), dtype=np.int64)
    if not len(lengths):
        return out
    room = [capacity] * max(1, -(-int(lengths.sum()) // capacity))
    heap = [(0.0, i) for i in range(len(room))]
    waiting: dict[int, list[tuple[float, int]]] = {}
    now = capacity
    for k in order.tolist():
        n = int(lengths[k])
        while now > n:
            now -= 1
            for x in waiting.pop(now, ()):
                heapq.heappush(heap, x)
        if heap:
            cost, i = heapq.heappop(heap)
        else:
            cost, i = 0.0, len(room)
            room.append(capacity)
        out[k] = i
        room[i] -= n
        cost += linear * n + quadratic * n * n
        if room[i] >= n:
            heapq.heappush(heap, (cost, i))
        elif room[i] > 0:
            waiting.setdefault(room[i], []).append((cost, i))
    return out


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["n_tokens", "u", "doc_id", "piece_no"], ascending=[False, True, True, True], kind="stable")
    n = pdf["n_tokens"].to_numpy(np.int64)
    seq = assign_sequences(n, int(pdf["capacity_tokens"].iloc[0]))
    start = np.zeros(len(n), dtype=np.int64)
    by = np.argsort(seq, kind="stable")
    total = np.cumsum(n[by]) - n[by]
    first = np.r_[True, seq[by][1:] != seq[by][:-1]] if len(n) else np.array([], dtype=bool)
    start[by] = total - np.maximum.accumulate(np.where(first, total, 0))
    return pd.DataFrame(
        {
            "pack_name": pdf["pack_name"].to_numpy(),
            "shard": pdf["shard"].to_numpy(np.int32),
            "seq": seq,
            "doc_id": pdf["doc_id"].to_numpy(),
            "piece_no": pdf["piece_no"].to_numpy(np.int32),
            "start_token": start,
            "n_tokens": n,
        }
    )


def _capacities(packs: DataFrame) -> F.Column:
    """The settings as an array of (pack_name, capacity_tokens)."""
    caps = packs.where("capacity_tokens >= 1").select("pack_name", F.col("capacity_tokens").cast("bigint")).take(MOST_PACKS + 1)
    if len(caps) > MOST_PACKS:
        raise ValueError(f"more than {MOST_PACKS} capacities")
    kinds = [F.struct(F.lit(c[0]).alias("pack_name"), F.lit(c[1]).alias("capacity_tokens")) for c in caps]
    return F.array(*kinds) if kinds else F.lit(None).cast("array<struct<pack_name:string,capacity_tokens:bigint>>")


def pack(sized: DataFrame, packs: DataFrame, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Every piece of every document with its container, for each capacity.

    ``sized`` is that of ``measured``; ``packs`` pack_name and
    capacity_tokens, a table of a few settings. ``container_id`` is unique within a
    capacity, ``start_token`` the piece's place in its container.
    """
    total = sized.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    items = sized.select("*", F.inline(_capacities(packs)))
    full = F.floor(F.col("n_tokens") / F.col("capacity_tokens")).cast("int")
    full = F.when(F.col("n_tokens") > F.col("capacity_tokens"), full).otherwise(F.lit(0))
    items = items.withColumn("full", full).withColumn("rest", F.col("n_tokens") - F.col("full") * F.col("capacity_tokens"))
    alone = items.where("full > 0").select(
        "pack_name", "doc_id", F.col("n_tokens").alias("n_tokens_of_document"), "text_hash", "copy", "capacity_tokens", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece_no")
    )
    alone = alone.select(
        "pack_name",
        F.concat_ws("-", F.lit("full"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "n_tokens_of_document", "text_hash", "copy", "piece_no").alias("container_id"),
        "doc_id", F.col("piece_no").cast("int").alias("piece_no"), F.lit(0).cast("bigint").alias("start_token"),
        F.col("capacity_tokens").alias("n_tokens"),
    )
    rest = items.where("rest > 0").select(
        "pack_name", "capacity_tokens", F.pmod("u", F.lit(shards)).cast("int").alias("shard"), "doc_id", "u",
        F.col("full").cast("int").alias("piece_no"), F.col("rest").alias("n_tokens"),
    )
    shared = rest.groupBy("pack_name", "shard").applyInPandas(_pack, _PLACED)
    shared = shared.withColumn("container_id", F.concat_ws("-", "shard", "seq")).drop("shard", "seq")
    return shared.unionByName(alone)


def packing_report(placed: DataFrame, packs: DataFrame) -> DataFrame:
    """For each capacity: containers, tokens, share of unused space and the fewest containers there could be."""
    used = placed.groupBy("pack_name", "container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("pieces"))
    used = used.groupBy("pack_name").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.sum("pieces").alias("pieces"), F.max("used").alias("fullest")
    )
    r = used.join(packs.select("pack_name", "capacity_tokens"), "pack_name")
    return r.select(
        "pack_name", "capacity_tokens", "containers", "pieces", "tokens", "fullest",
        F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("fewest_possible"),
        (1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("unused_share"),
    )


def packing_check(placed: DataFrame, sized: DataFrame, packs: DataFrame) -> DataFrame:
    """For each capacity, all 0 if right: containers over it, containers whose pieces leave gaps or overlap, tokens that are
    missing, and pieces beyond the fewest (a document is split only if it exceeds the capacity)."""
    caps = packs.where("capacity_tokens >= 1").select("pack_name", "capacity_tokens")
    boxes = placed.groupBy("pack_name", "container_id").agg(
        F.sum("n_tokens").alias("used"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"), F.count(F.lit(1)).alias("pieces"), F.count_distinct("start_token").alias("starts")
    )
    boxes = boxes.join(F.broadcast(caps), "pack_name").groupBy("pack_name", "capacity_tokens").agg(  # MOST_PACKS rows at most
        F.count_if(F.col("used") > F.col("capacity_tokens")).alias("over_capacity"),
        F.count_if((F.col("used") != F.col("end")) | (F.col("pieces") != F.col("starts"))).alias("with_gaps"),
        F.sum("used").alias("tokens"), F.sum("pieces").alias("pieces"),
    )
    sizes = sized.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("c"))
    want = sizes.select("*", F.inline(_capacities(packs))).groupBy("pack_name").agg(
        F.sum(F.col("n_tokens") * F.col("c")).alias("all_tokens"), F.sum(F.ceil(F.col("n_tokens") / F.col("capacity_tokens")) * F.col("c")).alias("fewest"),
    )
    return boxes.join(want, "pack_name").select(
        "pack_name", "over_capacity", "with_gaps", (F.col("all_tokens") - F.col("tokens")).alias("tokens_missing"), (F.col("pieces") - F.col("fewest")).alias("pieces_extra")
    )
