"""Conflict resolution against the rule carried out literally, and at size."""

from __future__ import annotations

import random
import time

import pytest

from posegrid.operators import conflicts, reid


def literal(nodes, edges):
    """Component by component and video by video, everything built anew after each removal."""
    edges = list(edges)

    def components():
        sets = reid.Sets(nodes)
        for _, a, b in edges:
            sets.join(a, b)
        out: dict = {}
        for n in nodes:
            out.setdefault(sets.find(n), []).append(n)
        return out

    while True:
        for own in components().values():
            videos = sorted({v for v, _ in own if sum(w == v for w, _ in own) > 1})
            if videos:
                clash = {n for n in own if n[0] == videos[0]}
                k = min((s, k) for k, (s, a, b) in enumerate(edges) if a in clash or b in clash)[1]
                del edges[k]
                break
        else:
            return {n: min(own) for own in components().values() for n in own}


def test_an_example_where_the_rules_differ():
    nodes = [(1, 1), (1, 2), (2, 3), (2, 4), (3, 5)]
    edges = [(0.5, (1, 1), (2, 4)), (0.8, (1, 2), (2, 3)), (0.9, (1, 1), (3, 5)), (0.4, (2, 3), (3, 5))]
    assert len(set(reid.resolve(nodes, edges).values())) == 2
    got = conflicts.resolve_in_order(nodes, edges)
    assert got == literal(nodes, edges) and len(set(got.values())) == 3


@pytest.mark.parametrize("ties", [False, True])
def test_random_graphs(ties):
    r = random.Random(ties)
    for _ in range(400):
        videos, people = r.randrange(2, 6), r.randrange(1, 5)
        nodes = [(v, p) for v in range(videos) for p in range(people)]
        share = r.choice([0.1, 0.3, 0.8])
        edges = [(float(r.randrange(3)) if ties else r.random(), a, b) for a in nodes for b in nodes if a[0] < b[0] and r.random() < share]
        r.shuffle(edges)
        assert conflicts.resolve_in_order(nodes, edges) == literal(nodes, edges)


@pytest.mark.parametrize("kind", ["sparse", "chain", "dense"])
def test_large_scenes_end_in_seconds(kind):
    r = random.Random(5)
    videos, n = 50, 100_000
    if kind == "chain":
        nodes = [(k % videos, k) for k in range(n)]
        edges = [(r.random(), nodes[k], nodes[k + 1]) for k in range(n - 1)]
    else:
        nodes = [(k % videos, k) for k in range(n if kind == "sparse" else 3000)]
        edges = [(r.random(), a, b) for a, b in ((r.choice(nodes), r.choice(nodes)) for _ in range(n)) if a[0] != b[0]]
    began = time.process_time()
    roots = conflicts.resolve_in_order(nodes, edges)
    assert time.process_time() - began < 60
    members: dict = {}
    for node, root in roots.items():
        members.setdefault(root, []).append(node[0])
    assert all(len(set(own)) == len(own) for own in members.values())


def test_both_rules_over_tables(spark):
    gallery = spark.createDataFrame([("s", v, p) for v, p in [(1, 1), (1, 2), (2, 3), (2, 4), (3, 5)]] + [("t", 1, 1)], "scene_id string, video_id int, person_id long")
    found = spark.createDataFrame([("s", 1, 1, 2, 4, 0.5), ("s", 1, 2, 2, 3, 0.8), ("s", 1, 1, 3, 5, 0.9), ("s", 2, 3, 3, 5, 0.4)], "scene_id string, video_a int, person_a long, video_b int, person_b long, sim double")
    rows = lambda rule: {(r["scene_id"], r["video_id"], r["person_id"]): r["global_id"] for r in reid.global_ids(gallery, found, rule).collect()}
    assert len(set(rows("in_order").values())) == 3 and len({v for k, v in rows("pooled").items() if k[0] == "s"}) == 2
    assert reid.global_ids(gallery, found).collect() and rows("in_order") == {(r["scene_id"], r["video_id"], r["person_id"]): r["global_id"] for r in reid.global_ids(gallery, found).collect()}
    with pytest.raises(ValueError):
        reid.global_ids(gallery, found, "other")
