"""Roots and reached labels against plain Python, and on long chains."""

import random

from factloom.operators import graph


def reached(edges, start):
    down = {}
    for p, c in edges:
        if p != c:
            down.setdefault(p, set()).add(c)
    out, todo = set(), [start]
    while todo:
        for c in down.get(todo.pop(), ()):
            if c not in out:
                out.add(c)
                todo.append(c)
    return out


def plain_roots(edges):
    edges = {(p, c) for p, c in edges if p != c}
    nodes = {x for e in edges for x in e}
    below = {n: reached(edges, n) for n in nodes}
    has_parent = {c for _, c in edges}
    out = set()
    for n in nodes:
        above = {a for a in nodes if n in below[a]}
        tops = {a for a in above if a not in has_parent and a != n}
        out |= {(n, t) for t in tops}
        if n in has_parent and not tops:
            low = min(a for a in above if a in below[a])
            if low != n:
                out.add((n, low))
    return out


def test_roots_equal_plain_search(spark):
    rng = random.Random(5)
    for seed in range(3):
        edges = [(rng.randrange(60), rng.randrange(60)) for _ in range((35, 55, 80)[seed])]
        edges += [(100 + i, 100 + (i + 1) % 7) for i in range(7)] + [(103, 120), (120, 121)]  # a cycle and what hangs below it
        edges += [(200, 201), (201, 202), (202, 200), (202, 203), (203, 204), (204, 203), (204, 199), (202, 203)]  # cycles below a cycle
        edges += [(301, 302), (302, 303), (303, 301), (304, 303), (303, 304), (302, 302)]  # a cycle with a chord
        table = spark.createDataFrame(edges, "parent int, child int")
        got = [(r.node, r.root) for r in graph.roots_of(table).collect()]
        assert set(got) == plain_roots(edges) and len(got) == len(set(got))
        labels = [(rng.randrange(60), rng.randrange(5)) for _ in range(12)] + [(103, 9), (201, 8), (999, 7)]
        got = [(r.node, r.label) for r in graph.pushed(table, spark.createDataFrame(labels, "node int, label int")).collect()]
        assert set(got) == {(n, x) for s, x in labels for n in {s, *reached(edges, s)}} and len(got) == len(set(got))
    none = graph.roots_of(table.limit(0))
    assert none.count() == 0


def test_a_long_chain_takes_linear_rows_and_few_rounds(spark):
    chain = [(i, i + 1) for i in range(10_000)] + [(20_000 + i, 20_000 + (i + 1) % 5000) for i in range(5000)] + [(24_000, 30_000)]
    table = spark.createDataFrame(chain, "parent int, child int")
    found = graph.roots_of(table).collect()
    assert len(found) == 10_000 + 4999 + 1
    assert all(r.root == (0 if r.node <= 10_000 else 20_000) for r in found)
