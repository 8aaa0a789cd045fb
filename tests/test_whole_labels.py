"""Label propagation settles or says that it did not; the listener hears its 20 rounds."""

import inspect
import random
from collections import Counter

import pytest

from triloom.operators import baselines as B
from triloom.operators.graph import canonical_edges
from triloom.plans import graph_queries as Q


@pytest.mark.parametrize("kind", ["star pair", "random"])
def test_labels_settle(spark, kind):
    r = random.Random(3)
    pairs = [(i, j) for i in range(6) for j in range(6, 12)] if kind == "star pair" else [(i, j) for i in range(40) for j in range(i) if r.random() < 0.08]
    label = {x["node"]: x["community_id"] for x in B.label_propagation(canonical_edges(spark.createDataFrame(pairs, "src bigint, dst bigint"))).collect()}
    heard = {v: Counter([label[v]]) for v in label}
    for i, j in pairs:
        heard[i][label[j]] += 1
        heard[j][label[i]] += 1
    assert all(h[label[v]] == max(h.values()) for v, h in heard.items())


def test_an_early_stop_is_told(spark):
    e = canonical_edges(spark.createDataFrame([(i, i + 1) for i in range(12)], "src bigint, dst bigint"))
    with pytest.warns(UserWarning, match="before it settled"):
        B.label_propagation(e, rounds=1)


def test_queries_take_the_default_rounds(spark, monkeypatch):
    said = {}
    monkeypatch.setattr(Q, "part_graph", lambda *_: "edges")
    for name in ("label_propagation", "speaker_listener"):
        kind = inspect.signature(getattr(B, name))

        def fake(*a, _name=name, _kind=kind, **k):
            bound = _kind.bind(*a, **k)
            bound.apply_defaults()
            said[_name] = bound.arguments["rounds"]

        monkeypatch.setattr(B, name, fake)
        getattr(Q, name)(spark, "")
    assert said == {"label_propagation": None, "speaker_listener": 20}
