"""Percentiles of very large numeric columns with a bounded error, from sketches that add up.

Deterministic buffer collapsing (Manku, Rajagopalan, Lindsay 1998). Values fill buffers
of ``k`` sorted values of weight 1. When ``FAN`` buffers stand on one level of the tree,
they are collapsed to one on the next: of the weighted merged sequence, k evenly spaced
positions are kept, and the weights add up. A collapse to weight w moves no rank by more
than w / 2, so the sum of these (``err``) and the largest weight bound the rank error of
every percentile. Buffers of any parts, batches or days are collapsed together in the
same tree, so sketches of parts combine to the sketch of the whole.

``k`` follows from the wanted error ``eps`` (a share of the number of values) for up to
``MOST`` values. Every task builds the buffers of the groups in its rows, so what is
shuffled is bounded by k values per level, group and task; sketches are merged in rounds
of at most ``merge_values`` values per task, which is at least four whole sketches, so
every round leaves a quarter or so, and no task sees an unbounded group. Buffers are
dealt by what they hold, not by where they stand.

Defined results: null and NaN values have no rank and are not counted; infinities are
values; a group without values has no row; up to k * FAN values of a group the result is
exact; the percentile q is the value of rank ceil(q * n), at least 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triloom.runtime import settle

FAN = 16
MOST = 10**12
EPS = 0.001
MERGE_VALUES = 2_000_000


def buffer_size(eps: float = EPS, most: int = MOST) -> int:
    """The k that keeps the rank error of ``most`` values within ``eps`` of their number.

    Every level adds at most n / (2 k), the last weight at most n / (k * FAN) or so.
    """
    k = 64
    while error_share(k, most) > eps:
        k = math.ceil(k * 1.1)
    return k


def error_share(k: int, most: int = MOST) -> float:
    """The bound of the rank error of ``most`` values as a share of their number."""
    return (max(1, math.ceil(math.log(most / k, FAN))) / 2 + 1) / k


def sketch_values(k: int, most: int = MOST) -> int:
    """The values a sketch of ``most`` values has at most."""
    return k * FAN * (max(1, math.ceil(math.log(most / k, FAN))) + 1)


def collapse(buffers: Sequence[np.ndarray], weights: Sequence[int], k: int, odd_turn: bool) -> tuple[np.ndarray, int]:
    """k values at evenly spaced positions of the weighted merge, and their weight."""
    total = int(sum(weights))
    values = np.concatenate(buffers)
    w = np.repeat(np.asarray(weights, dtype=np.int64), [len(b) for b in buffers])
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(w[order])
    first = (total + 1) // 2 if total % 2 or odd_turn else total // 2 + 1
    at = np.searchsorted(upto, np.arange(k, dtype=np.int64) * total + first, side="left")
    return values[order][at], total


class Sketch:
    """Buffers by level, the values not yet in a buffer, and the error so far."""

    def __init__(self, k: int):
        self.k, self.err, self.turn = k, 0.0, True
        self.levels: dict[int, list[tuple[np.ndarray, int]]] = {}
        self.rest: list[np.ndarray] = []
        self.n_rest = 0

    def add(self, values: np.ndarray) -> None:
        self.rest.append(values)
        self.n_rest += len(values)
        if self.n_rest >= self.k * FAN:
            v = np.concatenate(self.rest)
            whole = len(v) // self.k * self.k
            for part in v[:whole].reshape(-1, self.k):
                self.put(0, np.sort(part), 1)
            self.rest, self.n_rest = [v[whole:]], len(v) - whole

    def put(self, level: int, values: np.ndarray, weight: int) -> None:
        here = self.levels.setdefault(level, [])
        here.append((values, weight))
        if len(here) == FAN:
            self.levels[level] = []
            merged, w = collapse([b for b, _ in here], [x for _, x in here], self.k, self.turn)
            self.turn = not self.turn
            self.err += w / 2
            self.put(level + 1, merged, w)

    def rows(self) -> list[tuple[int, int, float, list]]:
        """(level, weight, err, values); level -1 are single values. The error stands in the first row."""
        out = [(lv, w, 0.0, v) for lv, bs in sorted(self.levels.items()) for v, w in bs]
        if self.n_rest:
            out.append((-1, 1, 0.0, np.sort(np.concatenate(self.rest))))
        if out and self.err:
            out[0] = (out[0][0], out[0][1], self.err, out[0][3])
        return out


_BUFFER = "level int, weight bigint, err double, vals array<double>"


def build(rows: DataFrame, by: Sequence[str], metrics: Sequence[str], k: int) -> DataFrame:
    """Buffers of every group and metric in each task's rows: ``by``, metric, level, weight, err, vals."""
    by, metrics = list(by), list(metrics)
    schema = ", ".join([*[f"`{c}` {t}" for c, t in rows.select(*by).dtypes], "metric string", _BUFFER])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, Sketch] = {}
        kinds = None
        for b in batches:
            kinds = [b.schema.field(c).type for c in by]
            pdf = b.to_pandas(date_as_object=True)
            for key, g in pdf.groupby(by, dropna=False, sort=False) if by else [((), pdf)]:
                key = tuple(None if pd.isna(x) else x for x in key)
                for m in metrics:
                    v = g[m].to_numpy(dtype=np.float64)
                    v = v[~np.isnan(v)]
                    if len(v):
                        found.setdefault((*key, m), Sketch(k)).add(v)
        out = [(*key, *r) for key, s in found.items() for r in s.rows()]
        if out:
            cols = list(zip(*out))
            types = [*kinds, pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64())]
            names = [*by, "metric", "level", "weight", "err", "vals"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return rows.select(*by, *[F.col(m).cast("double").alias(m) for m in metrics]).mapInArrow(run, schema)


def merge_buffers(levels, weights, errs, vals, k: int) -> Sketch:
    s = Sketch(k)
    s.err = float(sum(errs))
    order = sorted(range(len(levels)), key=lambda i: (levels[i], weights[i], len(vals[i]), vals[i][0], vals[i][-1]))
    for i in order:
        v = np.asarray(vals[i], dtype=np.float64)
        if levels[i] < 0:
            s.add(v)
        else:
            s.put(int(levels[i]), v, int(weights[i]))
    return s


def combine(buffers: DataFrame, by: Sequence[str], k: int, merge_values: int = MERGE_VALUES) -> DataFrame:
    """The buffers of any parts to those of the groups ``by`` (a subset of the columns) and metric.

    ``buffers`` is read twice and should be settled. In rounds: a group with more than
    ``merge_values`` values is dealt to several tasks first, which collapse what they have.
    A smaller ``merge_values`` than four sketches counts as that.
    """
    by = list(by)
    keys = [*by, "metric"]
    merge_values = max(merge_values, 4 * sketch_values(k))
    schema = ", ".join([*[f"`{c}` {t}" for c, t in buffers.select(*by).dtypes], "metric string", _BUFFER])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = merge_buffers(pdf["level"].tolist(), pdf["weight"].tolist(), pdf["err"].tolist(), pdf["vals"].tolist(), k)
        rows = s.rows()
        head = [pdf[c].iloc[0] for c in keys]
        return pd.DataFrame([(*head, *r) for r in rows], columns=[*keys, "level", "weight", "err", "vals"])

    now = buffers.select(*keys, "level", "weight", "err", "vals")
    while True:
        size = now.groupBy(*keys).agg(F.sum(F.size("vals")).alias("c")).agg(F.max("c")).first()[0] or 0
        if size <= merge_values:
            return now.groupBy(*keys).applyInPandas(run, schema)
        deals = F.pmod(F.xxhash64("level", "weight", "err", "vals"), F.lit(math.ceil(size / merge_values)))
        now, _ = settle(now.withColumn("deal", deals).groupBy(*keys, "deal").applyInPandas(run, schema))


def percentiles(combined: DataFrame, by: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """``by``, metric, q, value, n and the bound of the rank error, from combined buffers."""
    keys = [*by, "metric"]
    qs = list(qs)
    schema = ", ".join([*[f"`{c}` {t}" for c, t in combined.select(*by).dtypes], "metric string, q double, value double, n bigint, max_rank_error double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.concatenate([np.asarray(v, dtype=np.float64) for v in pdf["vals"]])
        w = np.repeat(pdf["weight"].to_numpy(np.int64), [len(v) for v in pdf["vals"]])
        order = np.argsort(values, kind="stable")
        upto = np.cumsum(w[order])
        n = int(upto[-1])
        err = float(pdf["err"].sum())
        bound = err + (float(w.max()) if err else 0.0)
        head = [pdf[c].iloc[0] for c in keys]
        out = []
        for q in qs:
            r = min(n, max(1, math.ceil(q * n - 1e-9)))
            out.append((*head, q, float(values[order][np.searchsorted(upto, r, side="left")]), n, bound))
        return pd.DataFrame(out, columns=[*keys, "q", "value", "n", "max_rank_error"])

    return combined.groupBy(*keys).applyInPandas(run, schema)
