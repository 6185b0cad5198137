"""Rubrics of uneven depth, walks with paths, and batches to a fixpoint, against plain recursion."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stratograph.operators import budget, trees
from stratograph.sources.model import Graph


def climbed(tree, scores, single):
    kids = {}
    for n, p, _ in tree:
        kids.setdefault(p, []).append(n)
    weight = {n: w for n, _, w in tree}

    def of(n):
        if n not in kids:
            s, u, failed = scores.get(n, (0.0, 0.0, False))
            return (0.0 if single else None) if failed else s, u, 0
        rows = [(*of(c), weight[c]) for c in kids[n]]
        height = 1 + max(r[2] for r in rows)
        rows = [r for r in rows if r[0] is not None]
        total = sum(r[3] for r in rows)
        if total <= 0:
            return 0.0, 0.0, height
        return sum(r[3] * r[0] for r in rows) / total, math.sqrt(sum((r[3] * r[1]) ** 2 for r in rows)) / total, height

    return {n: of(n) for n in weight}


@pytest.mark.parametrize("single", [False, True])
def test_rubric_of_any_depth(spark, single):
    r = random.Random(4)
    tree = [(0, None, 1.0)] + [(i, max(0, i - r.choice([1, 1, 2, 5, 30])), r.choice([0.0, 1.0, 2.5])) for i in range(1, 80)] + [(100, None, 1.0)]
    inner = {p for _, p, _ in tree}
    scores = {n: (r.uniform(0, 100), r.random(), r.random() < 0.2) for n, _, _ in tree if n not in inner and r.random() < 0.9}
    want = climbed(tree, scores, single)
    looped = [(200, 201, 1.0), (201, 200, 1.0), (202, 201, 1.0)]  # a cycle, and a leaf below it
    found = trees.rolled_up(spark.createDataFrame(tree + looped, "node_id long, parent_id long, weight double"), spark.createDataFrame([(n, *s) for n, s in scores.items()], "node_id long, score double, uncertainty double, failed boolean"), single)
    got = {x["node_id"]: (x["score"], x["uncertainty"], x["height"]) for x in found.collect()}
    assert set(got) == set(want) | {202} and max(h for *_, h in got.values()) > 8
    for n, (s, u, h) in want.items():
        assert got[n][2] == h and (got[n][0] == pytest.approx(s) if s is not None else got[n][0] is None)
        if h:
            assert got[n][1] == pytest.approx(u)


def test_rubric_without_nodes(spark):
    assert trees.rolled_up(spark.createDataFrame([], "node_id long, parent_id long, weight double"), spark.createDataFrame([], "node_id long, score double, uncertainty double, failed boolean")).count() == 0


def by_levels(arcs, root, depth):
    seen, level, out = {root: (root,)}, [root], set()
    for k in range(1, depth + 1):
        rows = sorted({(s, d) for s, d in arcs if s in level})
        new = {}
        for s, d in rows:
            if d not in seen and d not in new:
                new[d] = s
        for s, d in rows:
            out.add((d, s, k, (*seen[s], d), new.get(d) != s))
        seen |= {d: (*seen[s], d) for d, s in new.items()}
        level = list(new)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_walk_with_cycles(spark, seed):
    r = random.Random(seed)
    arcs = [(f"n{r.randrange(25)}", f"n{r.randrange(25)}") for _ in range(60)] + [("n0", "n1"), ("n1", "n0"), ("n0", "n0"), ("n0", "n1")]
    found = trees.walk(spark.createDataFrame(arcs, "src string, dst string"), spark.createDataFrame([("n0",)], "node_id string"), 6).filter("depth > 0").collect()
    assert len(found) == len(set(map(str, found))) and {(x["node_id"], x["parent_id"], x["depth"], tuple(x["path"]), x["again"]) for x in found} == by_levels(arcs, "n0", 6)
    assert any(x["again"] for x in found)


def test_tree_of_a_name(spark):
    nodes = spark.createDataFrame([("b.cs::Shop.Run",), ("a.cs::Shop.Run",), ("c.cs::Log",)], "node_id string")
    edges = spark.createDataFrame([("a.cs::Shop.Run", "c.cs::Log", "Call"), ("b.cs::Shop.Run", "a.cs::Shop.Run", "MethodCall"), ("c.cs::Log", "a.cs::Shop.Run", "Dependency")], "src string, dst string, type string")
    g = Graph(nodes, edges, edges.select("src", "dst"))
    got = {(r["node_id"], r["direction"], tuple(r["path"])) for r in trees.hierarchy_tree(g, "shop.run", ("Calls",), "both", 5).collect()}
    assert got == {("c.cs::Log", "out", ("a.cs::Shop.Run", "c.cs::Log")), ("b.cs::Shop.Run", "in", ("a.cs::Shop.Run", "b.cs::Shop.Run"))}
    assert trees.hierarchy_tree(g, "nobody", ("Calls",), "out", 5).count() == 0


def synthesis(lengths, context):
    room, out, level = context - budget.RESPONSE - 300, [], 0
    rows = list(enumerate(lengths))
    while True:
        total = (sum(n for _, n in rows) + 7 * (len(rows) - 1)) // 4
        if total <= room * 0.8 or level > 5:
            return out + [(level, s, n, -1, total > room * 0.8) for s, n in rows]
        batches = [[]]
        for s, n in rows:
            if batches[-1] and sum(m // 4 for _, m in batches[-1]) + n // 4 > room * 0.7:
                batches.append([])
            batches[-1].append((s, n))
        out += [(level, s, n, i, False) for i, b in enumerate(batches) for s, n in b]
        rows = [(i, min(math.ceil((sum(n for _, n in b) + 2 * (len(b) - 1)) / 2), int(room * 0.4) * 4)) for i, b in enumerate(batches)]
        level += 1


def test_synthesis_to_the_end(spark):
    r = random.Random(9)
    keys = {k: [r.choice([0, 3, 80, 400, 5000]) for _ in range(r.randint(1, 60))] for k in range(12)}
    keys[99] = [10**6] * 40  # compacted to the most a batch may keep, so it never fits
    rows = spark.createDataFrame([(k, i, n) for k, v in keys.items() for i, n in enumerate(v)], "key long, seq int, length int")
    most = lambda length, tokens: F.least(F.ceil(length / 2), F.lit(tokens * 4))
    got = {}
    for x in budget.synthesis_levels(rows, 2600, most).collect():
        got.setdefault(x["key"], set()).add((x["level"], x["seq"], x["length"], x["batch"], x["forced"]))
    assert got == {k: set(synthesis(v, 2600)) for k, v in keys.items()}
    assert max(x[0] for v in got.values() for x in v) > 2


def passes(turns, context, other):
    room = context - budget.RESPONSE
    rows = [(len(role), n, i, i, False) for i, (role, n) in enumerate(turns)]
    fits = lambda: sum(x[1] // 4 for x in rows) + other < room
    if len(rows) <= 10 or sum(x[1] // 4 for x in rows) <= room:
        return [(p, *x[2:4], x[1], x[4], 0, False) for p, x in enumerate(rows, 1)]
    done = 0
    while not fits() and done < 5:
        done += 1
        size, new = max(3, len(rows) // 3), []
        for i in range(0, len(rows), size):
            b = rows[i : i + size]
            if i + size >= len(rows):
                new += b
                break
            new.append((9, len(f"[Summary of {len(b)} messages]: ") + min(200, sum(x[0] + 2 + x[1] for x in b) + 2 * (len(b) - 1)), b[0][2], b[-1][3], True))
        rows = new
    cut = not fits()
    rows = rows[-5:] if cut else rows
    return [(p, *x[2:4], x[1], x[4], done, cut) for p, x in enumerate(rows, 1)]


def test_history_to_the_end(spark):
    r = random.Random(11)
    keys = {k: [(r.choice(["user", "assistant"]), r.choice([0, 40, 300, 2000])) for _ in range(r.choice([1, 10, 11, 12, 30, 200]))] for k in range(14)}
    rows = spark.createDataFrame([(k, i, role, n) for k, v in keys.items() for i, (role, n) in enumerate(v)], "key long, pos int, role string, length int")
    for context, other in ((2600, 0), (2200, 30)):
        got = {}
        for x in budget.reduced_history(rows, context, other).collect():
            got.setdefault(x["key"], []).append((x["pos"], x["first"], x["last"], x["length"], x["summarised"], x["passes"], x["truncated"]))
        assert {k: sorted(v) for k, v in got.items()} == {k: passes(v, context, other) for k, v in keys.items()}
