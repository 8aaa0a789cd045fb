"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The folder of the vocabulary files; it must be there on every executor.
TOKENIZER_DIR = os.environ.get("TRILOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: So many copies of a row are made in one task.
COPIES = 100_000


@lru_cache(maxsize=4)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str) -> int:
    return len(encoding(path).encode_ordinary(text.encode("utf-8", "replace").decode("utf-8")))


def token_count(text: Column | str, path: str | None = None) -> Column:
    """Number of tokens of each text; null for null, 0 for an empty text.

    The text is tokenized whole. ``path`` is the vocabulary file.
    """
    path = path or f"{TOKENIZER_DIR}/{VOCABULARY}"

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([None if t is None else count_tokens(t, path) for t in b], dtype="Int64")

    # so that a filter on the number is not moved below it, which would count twice
    return count.asNondeterministic()(text)


def deal_copies(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The columns ``keys`` of every row and ``copy``, which tells equal rows apart: 0, 1, ...

    Equal rows are counted (with a partial count before the shuffle) and made again from
    their number, in blocks, so neither a row's place in a file nor the hottest row matters.
    """
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c"))
    blocks = counted.withColumn("__block", F.explode(F.sequence(F.lit(0), F.expr(f"(__c - 1) div {COPIES}"))))
    dealt = blocks.repartition(*keys, "__block")
    first = F.col("__block") * F.lit(COPIES)
    copies = F.sequence(first, F.least(first + F.lit(COPIES - 1), F.col("__c") - 1))
    return dealt.select(*keys, F.explode(copies).alias("copy"))
