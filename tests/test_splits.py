"""Modules split in stages, against plain loops on small graphs."""

import random

import pytest

from stratograph.operators import folds, splits
from stratograph.sources.model import Graph


def graph(spark, nodes, arcs):
    n = spark.createDataFrame(nodes, "node_id string, file_path string, line_count int, complexity int")
    e = spark.createDataFrame([(i, a, b, "Dependency", 1.0) for i, (a, b) in enumerate(arcs)], "seq int, src string, dst string, type string, strength double")
    return Graph(n, e.select("src", "dst", "type", "strength"), e.select("src", "dst"))


def shared(paths):
    out = []
    for column in zip(*paths):
        if len(set(column)) > 1:
            break
        out.append(column[0])
    return out


def loops(nodes, arcs, members):
    path = {n: [s for s in p.split("/") if s] for n, p, *_ in nodes}
    out = set()
    for module in {m for m, _ in members}:
        own = sorted({n for m, n in members if m == module and n in path})
        if not own:
            continue
        common = len(shared([path[n][:-2] for n in own]))
        parts = {n: (path[n][:-1][common] if common and len(path[n]) - 1 > common else "Root") for n in own}
        if len(set(parts.values())) > 1:
            out |= {(module, n, "directory", p) for n, p in parts.items()}
            continue
        label = {n: n for n in own}
        while True:
            new = dict(label)
            for a, b in arcs:
                if a in new and b in new:
                    new[a] = new[b] = min(new[a], new[b])
            if new == label:
                break
            label = new
        firsts = sorted(set(label.values()))
        if len(firsts) > 1:
            out |= {(module, n, "dependencies", f"Cluster_{firsts.index(v)}") for n, v in label.items()}
        else:
            out |= {(module, n, "size", f"Part_{i // max(2, len(own) // 3)}") for i, n in enumerate(own)}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_delegation_in_stages(spark, seed):
    r = random.Random(seed)
    where = ["src/a/x.cs", "src/a/b/x.cs", "src/c/x.cs", "x.cs", "src/x.cs", "lib/d/e/x.cs"]
    nodes = [(f"n{i:02}", r.choice(where), 1, 1) for i in range(40)]
    arcs = [(f"n{r.randrange(40):02}", f"n{r.randrange(40):02}") for _ in range(30)]
    members = [(f"m{r.randrange(8)}", f"n{r.randrange(40):02}") for _ in range(70)] + [("m0", "gone"), ("alone", "n01"), ("m1", "n01"), ("m1", "n01")]
    members += [("flat", n) for n, p, *_ in nodes if p == "src/a/x.cs"] + [("star", f"n{i:02}") for i in range(12)]
    arcs += [("n00", f"n{i:02}") for i in range(12)]
    g = graph(spark, nodes, arcs)
    found = [tuple(x) for x in splits.delegated(g, spark.createDataFrame(members, "module string, node_id string")).collect()]
    assert len(found) == len(set(found)) and set(found) == loops(nodes, arcs, members)
    assert {f[2] for f in found} >= {"dependencies"} and splits.delegated(g, spark.createDataFrame([], "module string, node_id string")).count() == 0


def test_modules_within_the_limit(spark):
    r = random.Random(3)
    nodes = [(f"n{i:03}", f"src/{'ab'[i % 2]}/{'xyz'[i % 3]}/f{i % 7}.cs", r.randint(1, 200), r.randint(1, 20)) for i in range(90)]
    nodes += [(f"c{i:02}", "lib/one.cs", 300, 30) for i in range(16)] + [("huge", "app/huge.cs", 9000, 9)]
    arcs = [(f"c{a:02}", f"c{b:02}") for a in range(16) for b in range(16) if a < b and a // 4 == b // 4] + [("c00", "c04"), ("c04", "c08"), ("c08", "c12")]  # four groups that hang together
    g = graph(spark, nodes, arcs)
    members = [(p.split("/")[0], n) for n, p, *_ in nodes]
    tokens = {n: ln * 1.3 + c * 10 for n, _, ln, c in nodes}
    found = splits.within_limit(g, spark.createDataFrame(members, "module string, node_id string"), 3000.0).collect()
    assert sorted(x["node_id"] for x in found) == sorted(tokens)
    parts = {}
    for x in found:
        parts.setdefault(x["module"], []).append(x)
    for module, rows in parts.items():
        total = sum(tokens[x["node_id"]] for x in rows)
        assert all(x["tokens"] == pytest.approx(total) for x in rows) and len({x["indivisible"] for x in rows}) == 1
        assert total <= 3000 or rows[0]["indivisible"]
    assert parts["app"][0]["indivisible"] and len(parts["app"]) == 1
    groups = {frozenset(x["node_id"] for x in rows) for m, rows in parts.items() if m.startswith("lib")}
    assert groups == {frozenset(f"c{i:02}" for i in range(a, a + 4)) for a in (0, 4, 8, 12)}
    assert all(m.startswith(("src_a", "src_b")) for m in parts if m.startswith("src")) and not any(m in parts for m in ("src", "lib"))


def test_places_of_a_large_key(spark):
    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 'a', 'b') k", "id * 7919 % 5003 v")
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (r["k"], r["v"])):
        want[r["k"], r["v"]] = want.setdefault(("n", r["k"]), 0)
        want["n", r["k"]] += 1
    got = {(r["k"], r["v"]): r["nth"] for r in folds.ranked(rows, "k", "v").collect()}
    assert got == {k: v for k, v in want.items() if k[0] != "n"}
