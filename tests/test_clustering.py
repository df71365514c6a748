"""Settings, ranked candidates and the log of clustering."""

from __future__ import annotations

import json
import math
from datetime import datetime, timedelta

import pandas as pd
import pytest
from tessera.operators import clustering
from tessera.operators.clustering import Settings

DAY = datetime(2024, 1, 1)
SCHEMA = "item_id long, at timestamp, source_id string, title string, ident string"


def test_settings(spark, tmp_path):
    assert clustering.settings_of("{}") == Settings()
    (tmp_path / "s.json").write_text('{"timeWindowDays": 3, "thresholds": {"attachScore": 1, "singleTokenGuard": false, "minTokenOverlap": 1}, "stopwords": ["der"], "more": 1}')
    how = clustering.read_settings(spark, str(tmp_path / "s.json"))
    assert (how.window_days, how.attach, how.fewest, how.stopwords, how.candidates) == (3, 1.0, 1, ("der",), 200)
    for bad in ('{"timeWindowDays": "3"}', '{"scoringWeights": {"titleJaccard": -1}}', '{"thresholds": {"singleTokenGuard": 1}}'):
        with pytest.raises(ValueError):
            clustering.settings_of(bad)


def test_best_ranked_candidates_are_scored(spark):
    titles = ["heron pond one two", "heron one two pond", "pond two one heron", "heron pond"]
    df = spark.createDataFrame([(k, DAY + timedelta(hours=k), "s", t, None) for k, t in enumerate(titles)], SCHEMA)
    how = Settings(candidates=1, attach=0.5, least_overlap=2, least_jaccard=0.2)
    rows = {r.item_id: r for r in clustering.cluster(df, how, logged=True).collect()}
    # three titles hold both words; they stand next to each other in the first
    assert rows[3].scored == [0] and rows[3].cluster_id == 0 and rows[3].overlap == 2
    wide = {r.item_id: r for r in clustering.cluster(df, Settings(candidates=5, attach=0.99), logged=True).collect()}
    assert wide[3].decision == "new" and len(wide[3].scored) == 3


def test_equal_scores_go_to_the_better_ranked():
    at = 0.0
    rows = [(0, at, "a", None, ["heron", "one", "pond"], True), (1, at, "a", None, ["heron", "pond", "one"], True), (2, at, "a", None, ["pond", "one", "heron"], True), (3, at, "a", None, ["heron", "pond"], False)]
    found = clustering.assign(pd.DataFrame(rows, columns=["item_id", "at", "source_id", "ident", "tokens", "founder"]).assign(words=lambda d: d["tokens"]), Settings(attach=0.3)).set_index("item_id")
    assert found.cluster_id[3] == 1 and list(found.scored[3]) == [0, 1, 2]


def test_log(spark):
    titles = [("Grey herons nest by city ponds", None), ("Grey herons nest by city ponds", None), ("Other words here entirely", "2401.1"), ("No match at all", "2401.1"), ("", None)]
    df = spark.createDataFrame([(k, DAY + timedelta(hours=k), f"s{k}", t, i) for k, (t, i) in enumerate(titles)], SCHEMA)
    log = {r.item_id: r for r in clustering.assignment_log(clustering.cluster(df, logged=True)).collect()}
    assert [log[k].decision for k in range(5)] == ["created_new", "attached_existing", "created_new", "attached_existing", "created_new"]
    parts = json.loads(log[1].score_breakdown)
    near = math.exp(-1 / 24 / 7)
    assert parts["overlap"] == 5 and parts["jaccard"] == 1.0 and math.isclose(parts["total_score"], 0.65 + 0.25 * near + 0.1 * 5 / 6 + 0.04)
    assert log[1].candidate_cluster_ids == "[0]" and log[1].threshold_used == 0.72 and log[0].score_breakdown == "{}"
    assert log[3].score_breakdown == '{"external_id_match":true}' and log[3].threshold_used is None and log[3].decided_cluster_id == 2


def test_logging_changes_no_decision(spark):
    import random

    rng = random.Random(3)
    words = ["heron", "pond", "gate", "weir", "silt", "barley", "field"]
    rows = [(k, DAY + timedelta(hours=rng.randrange(500)), f"s{rng.randrange(3)}", " ".join(rng.sample(words, rng.randrange(1, 6))), None) for k in range(150)]
    df = spark.createDataFrame(rows, SCHEMA)
    told = clustering.cluster(df, logged=True).collect()
    assert {(r.item_id, r.cluster_id) for r in told} == {(r.item_id, r.cluster_id) for r in clustering.cluster(df).collect()}
    # the whole loop over all items at once tells the same candidates
    whole = clustering.assign(pd.DataFrame([(k, (at - DAY).total_seconds(), s, i, t.split(), t.split(), False) for k, at, s, t, i in rows], columns=["item_id", "at", "source_id", "ident", "tokens", "words", "founder"]))
    assert {(r.item_id, tuple(r.scored)) for r in told} == {(r.item_id, tuple(r.scored)) for r in whole.itertuples()}


def test_groups(spark):
    import random

    rng = random.Random(6)
    up = list(range(900))
    edges = [(k, k + 1) for k in range(300)] + [(400, k) for k in range(401, 460)] + [(500 + rng.randrange(300), 500 + rng.randrange(300)) for _ in range(220)]
    edges += [(840 + (k * 37) % 53, 840 + ((k + 1) * 37) % 53) for k in range(40)]

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        up[high] = low
    nodes = spark.range(900).select(clustering.F.col("id").alias("node"))
    found = clustering.groups(spark.createDataFrame(edges, "u long, v long"), nodes, rounds=12).collect()
    assert len(found) == 900 and {r.node: r.group for r in found} == {k: root(k) for k in range(900)}
    assert clustering.groups(spark.createDataFrame([], "u long, v long"), nodes).count() == 900


class Moment(float):
    """A time that counts how often it is compared with an earlier one."""

    seen = 0

    def __sub__(self, other):
        Moment.seen += 1
        return float(self) - float(other)


def test_items_meet_the_clusters_of_their_window_alone():
    """600 days with a story that is never joined and an item whose tokens all of them hold; 14 days are looked at."""
    rows = []
    for day in range(600):
        rows.append((2 * day, Moment(86400 * day), "s", None, ["heron", "pond", *[f"w{day}x{k}" for k in range(8)]], True))
        rows.append((2 * day + 1, Moment(86400 * day + 3600), "s", None, ["heron", "pond"], False))
    frame = pd.DataFrame(rows, columns=["item_id", "at", "source_id", "ident", "tokens", "founder"], dtype=object)
    Moment.seen = 0
    found = clustering.assign(frame.assign(words=frame.tokens))
    assert found[found.decision == "attached"].shape[0] > 0 and found[found.item_id % 2 == 0].decision.eq("new").all()
    assert 0 < Moment.seen < 40 * len(rows)
    joined = clustering.assign(frame.assign(tokens=frame.tokens.str.join(" "), words=frame.tokens.str.join(" ")))
    assert found.equals(joined)


def test_items_without_links_found_their_own(spark):
    df = spark.createDataFrame([(1, DAY, "s", "heron pond", None), (2, DAY, "s", None, None), (3, DAY + timedelta(hours=1), "t", "heron pond", None), (4, DAY, "s", None, "i"), (5, DAY, "s", None, "i")], SCHEMA)
    got = {r.item_id: (r.cluster_id, r.decision, r.by_identifier, r.overlap, r.scored) for r in clustering.cluster(df, logged=True).collect()}
    assert got == {1: (1, "new", False, None, []), 2: (2, "new", False, None, []), 3: (1, "attached", False, 2, [1]), 4: (4, "new", False, None, []), 5: (4, "attached", True, None, [4])}
