"""Graph algorithms on small graphs with known results."""

import pytest
from pyspark.sql import functions as F

from quillon.graph import algorithms as A
from quillon.graph import bsp
from quillon.sources import files


def _web(extra=()):
    """Two groups of ten: v leads to 1..v+1 of its own group; 9 leads on to 10, and 19 back to 0."""
    lines = [f"{v} " + " ".join(str(x) for x in range(v // 10 * 10 + 1, v + 2)) for v in range(19)]
    lines.append("19 0 " + " ".join(map(str, range(11, 20))))
    for v, more in extra:
        lines[v] = lines[v] + more
    return lines


WEB = _web()
#: The same with edges to ids without a line, and vertices without edges.
HOLES = [*_web([(0, " 50"), (10, " 99"), (11, " 101")]), "21 22 23 24", "25", "27"]
CLIQUE = ["1 2 3 4", "2 1 3 4 5", "3 1 2 4 5", "4 1 2 3", "5 6 7", "6 5 7", "7 5 6"]
CLIQUE_2 = ["1 2 3 4", "2 1 3", "3 1 2 4 5", "4 1 3", "5 3 6", "6 5"]


@pytest.fixture
def graph(spark):
    return lambda lines: files.parse_adjacency(spark.createDataFrame([(x,) for x in lines], "value string"))


def _values(df):
    return {r.id: r.value for r in df.collect()}


def _ranks(lines, updates, n):
    near = {int(x.split()[0]): [int(y) for y in x.split()[1:]] for x in lines}
    rank = dict.fromkeys(near, 1 / n)
    for _ in range(updates):
        new = dict.fromkeys(near, 0.15 / n)
        for v, out in near.items():
            for w in out:
                if w in new:
                    new[w] += 0.85 * rank[v] / len(out)
        rank = new
    return rank


def test_page_rank(graph):
    got = _values(A.page_rank(*graph(WEB), 10))
    # Known ranks of this graph.
    assert got[0] == pytest.approx(0.008290140026154316, abs=1e-12)
    assert got[1] == pytest.approx(0.15351528192471653, abs=1e-12)
    assert got[13] == pytest.approx(0.08125113985998214, abs=1e-12)
    assert got == pytest.approx(_ranks(WEB, 9, 20), abs=1e-12)


def test_page_rank_drops_messages_to_missing_vertices(graph):
    assert _values(A.page_rank(*graph(HOLES), 10)) == pytest.approx(_ranks(HOLES, 9, 23), abs=1e-12)


def test_shortest_paths(graph):
    assert _values(A.shortest_paths(*graph(WEB), 0)) == {v: float(v) for v in range(20)}
    got = _values(A.shortest_paths(*graph(HOLES), 0))
    assert got[19] == 19.0 and got[25] == A.UNREACHED and 50 not in got


def test_components(graph):
    assert set(_values(A.connected_components(*graph(WEB))).values()) == {0}
    got = _values(A.connected_components(*graph(HOLES)))
    assert got == {**dict.fromkeys(range(20), 0), 21: 21, 25: 25, 27: 27}


def test_reachability(graph):
    got = _values(A.reachability(*graph(HOLES), 1, 10))
    assert got == {0: 0, **dict.fromkeys(range(1, 10), 1), 10: 3, **dict.fromkeys(range(11, 20), 2), 21: 0, 25: 0, 27: 0}


def test_triangles(graph):
    assert _values(A.triangles(*graph(CLIQUE))) == {1: 3, 2: 2, 3: 0, 4: 0, 5: 1, 6: 0, 7: 0}


def test_largest_cliques(graph):
    got = {r.id: r.cliques for r in A.largest_cliques(*graph(CLIQUE)).collect()}
    assert got[1] == "1,2,3,4;" and got[3] == "3,4;3,5;" and got[4] == "" and got[5] == "5,6,7;"
    got = {r.id: r.cliques for r in A.largest_cliques(*graph(CLIQUE_2)).collect()}
    assert got == {1: "1,2,3;1,3,4;", 2: "2,3;", 3: "3,4;3,5;", 4: "", 5: "5,6;", 6: ""}


def test_mutation(spark):
    v = spark.range(20).select("id", F.lit(0.0).alias("value"))
    assert sorted(_values(A.mutate(v))) == [1, 5, 7, 11, 13, 17, 19, 100, 500, 700, 1100, 1300, 1700]
    without = spark.createDataFrame([(7, 1.0), (1900, 2.0)], "id long, value double")
    assert _values(A.mutate(without)) == {7: 1.0, 700: 1.0, 1900: 2.0}


def test_message_counts(graph):
    got = _values(A.message_counts(*graph(CLIQUE), 10_000))
    assert got == {v: 10_000 * n for v, n in {1: 3, 2: 3, 3: 3, 4: 3, 5: 4, 6: 2, 7: 2}.items()}


def test_ring_and_scaling(spark):
    v, e = files.ring(spark, 5)
    assert [(r.id, r.value) for r in v.orderBy("id").collect()] == [(i, 10.0 * i) for i in range(5)]
    assert sorted((r.src, r.dst, r.weight) for r in e.collect()) == [(i, (i + 1) % 5, 100.0 * i) for i in range(5)]
    v, e = files.scale_graph(v, e, 3)
    assert v.count() == 15 and sorted(r.dst for r in e.where("src = 14").collect()) == [10]


def test_python_program_with_mutations(spark):
    v = spark.range(20).select("id", F.lit(0.0).alias("value"))
    none = spark.createDataFrame([], "src long, dst long")

    def compute(vertex, messages):
        if vertex.superstep == 1 and vertex.id < 100:
            if vertex.id % 2 == 0 or vertex.id % 3 == 0:
                vertex.delete_vertex(vertex.id)
            else:
                vertex.add_vertex(vertex.id * 100, vertex.value)
                vertex.send(vertex.id * 100, 1.0)
        elif vertex.id == 1900:
            vertex.delete_vertex(1900)
        vertex.vote_to_halt()

    got = _values(bsp.run_python(v, none, compute))
    assert sorted(got) == [1, 5, 7, 11, 13, 17, 19, 100, 500, 700, 1100, 1300, 1700]


def test_python_program_delivers_all_messages(graph):
    def compute(vertex, messages):
        if vertex.superstep == 1:
            vertex.send_to_all(float(vertex.id))
        else:
            vertex.value = float(sum(messages))
        vertex.vote_to_halt()

    got = _values(bsp.run_python(*graph(CLIQUE), compute))
    assert got[4] == 1 + 2 + 3 and got[5] == 2 + 3 + 6 + 7


def test_python_errors_come_through(graph):
    def compute(vertex, messages):
        vertex.send_to_all(None)

    with pytest.raises(Exception, match="a message is null"):
        bsp.run_python(*graph(CLIQUE), compute).collect()


def test_supersteps_are_reported_and_bounded(graph):
    seen = []
    v, e = graph(WEB)
    A_prog = bsp.Program(start=lambda value, s: F.lit(0.0), compute=lambda value, m, s: m, message=lambda v, w, d: v + 1, combine=F.max, aggregators={"top": lambda: F.max("value")})
    out = bsp.run(v, e, A_prog, 4, on_superstep=lambda n, state: seen.append(n))
    assert seen == [1, 2, 3, 4] and max(_values(out).values()) == 3.0


def test_all_plans_agree(graph):
    program = bsp.Program(start=lambda value, s: F.col("id").cast("double"), compute=lambda value, m, s: F.least(value, m), message=lambda v, w, d: v, combine=F.min)
    got = [_values(bsp.run(*graph(HOLES), program, 3, plan=p)) for p in bsp.PLANS]
    assert all(x == got[0] for x in got)


def test_keyed_table(spark):
    from quillon.graph.store import KeyedTable

    t = KeyedTable(spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "id long, s string"))
    assert [tuple(r) for r in t.range().collect()] == [(1, "a"), (2, "b"), (3, "c")] and t.search(2).first().s == "b"
    t.insert(spark.createDataFrame([(2, "x"), (4, "d"), (4, "d")], "id long, s string"))
    t.update(F.col("id") == 1, s=F.lit("z"))
    t.delete(spark.createDataFrame([(3,)], "id long"))
    assert [tuple(r) for r in t.range(1, 4).collect()] == [(1, "z"), (2, "b"), (4, "d")]
    t.reload(spark.createDataFrame([(9, "n")], "id long, s string"))
    assert t.range(low=5).count() == 1
    t.drop()
    assert t.rows.count() == 0


def test_missing_vertices_can_be_created(graph):
    v, e = graph(HOLES)
    program = bsp.Program(start=lambda value, s: F.lit(1.0), compute=lambda value, m, s: F.coalesce(value, F.lit(0.0)) + m, message=lambda v, w, d: F.lit(1.0), combine=F.sum)
    assert 50 in _values(bsp.run(v, e, program, 2, create_missing=True)) and 50 not in _values(bsp.run(v, e, program, 2))


def test_empty_graph(spark):
    v, e = spark.createDataFrame([], "id long"), spark.createDataFrame([], "src long, dst long")
    assert A.page_rank(v, e).count() == 0 and A.triangles(v, e).count() == 0 and A.connected_components(v, e).count() == 0


def _plain_cliques(pairs):
    """The largest cliques of each smallest vertex, grown vertex by vertex."""
    near = {}
    for a, b in pairs:
        near.setdefault(min(a, b), set()).add(max(a, b))
    out = {}
    for c, larger in near.items():
        level = [[c, p] for p in sorted(larger)]
        while more := [[*k, v] for k in level for v in sorted(set.intersection(*(near.get(u, set()) for u in k)))]:
            level = more
        out[c] = len(level[0]), "".join(",".join(map(str, k)) + ";" for k in sorted(level))
    return out


def test_cliques_and_triangles_of_a_random_graph_with_a_hub(spark):
    """Sizes 1 to 6, a hub with thousands of edges, edges both ways, twice, to itself, to null and to ids without a vertex."""
    import random
    from itertools import combinations

    r = random.Random(7)
    pairs = {tuple(sorted(r.sample(range(60), 2))) for _ in range(250)} | set(combinations((3, 17, 29, 41, 55, 58), 2))
    pairs |= {(0, v) for v in range(1, 3000)} | {(2999, 5000), (5000, 5001), (2999, 5001)}
    rows = [*pairs, *[(b, a) for a, b in list(pairs)[::3]], *list(pairs)[::5], (7, 7), (9, None)]
    vertices, edges = spark.range(3002).select("id"), spark.createDataFrame(rows, "src long, dst long")
    want = _plain_cliques(pairs)
    got = {x.id: (x.size, x.cliques) for x in A.largest_cliques(vertices, edges).collect()}
    assert got == {v: want.get(v, (1, "")) for v in range(3002)} and {1, 2, 3, 6} <= {n for n, _ in got.values()}
    near = {v: {b for a, b in pairs if a == v} for v in want}
    assert _values(A.triangles(vertices, edges)) == {v: sum(len(near[v] & near.get(p, set())) for p in near.get(v, ())) for v in range(3002)}


def test_cliques_start_no_group_in_python_for_each_vertex(graph):
    """A group in pandas costs milliseconds a vertex; triangles go to Python in order, by batches."""
    plan = A.largest_cliques(*graph(CLIQUE))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan


def test_largest_cliques_are_found_without_all_maximal_ones():
    """The 5 * 4 ** 12 maximal cliques of a graph of twelve fours and a clique of 14 beside it; only that one is asked for."""
    near = {v: {w for w in range(48) if w // 4 != v // 4} for v in range(48)}
    near |= {v: {w for w in range(100, 114) if w != v} for v in range(100, 114)}
    assert max(map(len, A._maximal(near))) == 14


def test_messages_to_all_make_no_rows_in_python(spark):
    """One vertex with 300,000 edges sends along all: one message leaves Python, and no edge becomes an object there."""
    vertices = spark.range(300_001).select("id")
    edges = vertices.where("id > 0").select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))

    def compute(vertex, messages):
        if vertex.superstep == 1 and vertex.id == 0:
            vertex.send_to_all(5)
            assert vertex.sent == [] and vertex.sent_to_all == [5] and not vertex.looked_at_edges
        vertex.value = sum(messages)
        vertex.vote_to_halt()

    got = bsp.run_python(vertices, edges, compute, value_type="bigint", message_type="bigint")
    assert [tuple(r) for r in got.groupBy("value").count().orderBy("value").collect()] == [(0, 1), (5, 300_000)]


def test_edges_changed_after_a_message_to_all(graph):
    """Messages go along the edges that are there when they are sent, and edges that were changed stay so."""

    def compute(vertex, messages):
        if vertex.superstep == 1:
            assert vertex.value is None
            vertex.send_to_all(1)
            if vertex.id == 1:
                vertex.remove_edge(2)
                vertex.add_edge(7, 2.5)
                vertex.send_to_all(10)
            if vertex.id == 5:
                vertex.edges = [(1, 0.5)]
            vertex.value = 0
        else:
            vertex.value = vertex.value * 1000 + sum(messages)
            if vertex.superstep == 2:
                vertex.send_to_all(100)
        if vertex.superstep > 1:
            vertex.vote_to_halt()

    got = _values(bsp.run_python(*graph(CLIQUE), compute, value_type="bigint", message_type="bigint"))
    # From 1 in the first superstep 1 to 2, 3, 4 and then 10 to 3, 4, 7; in the second 100 along what is left.
    assert got == {1: 3_400, 2: 3_200, 3: 13_300, 4: 13_300, 5: 4_400, 6: 2_100, 7: 12_200}


def test_triangles_make_no_rows_of_paths(spark, monkeypatch):
    """A fan of 2,000 over a path: the lists that meet hold each edge once, and none is longer than the root of all allows."""
    pairs = [(0, v) for v in range(1, 2001)] + [(v, v + 1) for v in range(1, 2000)]
    kept = []
    materialize = A.materialize
    monkeypatch.setattr(A, "materialize", lambda df, label: kept.append((label, materialize(df, label))) or kept[-1][1])
    edges, vertices = spark.createDataFrame(pairs, "src long, dst long"), spark.range(2001)
    assert _values(A.triangles(vertices, edges)) == {v: 1999 * (v == 0) for v in range(2001)}
    fans = dict(kept)["fans"]
    assert fans.agg(F.sum(F.size("ys"))).first()[0] == len(pairs) and fans.agg(F.max(F.size("ys"))).first()[0] <= 2 * len(pairs) ** 0.5


def test_supersteps_move_lists_of_edges(spark, monkeypatch):
    """A row a vertex and no more than about 1,000 edges in it; weights and repeated edges stay, with ranks as before."""
    kept = []
    materialize = bsp.materialize
    monkeypatch.setattr(bsp, "materialize", lambda df, label: kept.append((label, materialize(df, label))) or kept[-1][1])
    vertices = spark.range(5001).select("id")
    edges = vertices.where("id > 0").select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    edges = edges.union(edges.select("dst", "src")).union(spark.createDataFrame([(1, 0), (1, 0), (2, None), (None, 3), (4, 9999)], "src long, dst long"))
    got = _values(A.page_rank(vertices, edges, 3))
    links = dict(kept)["links"]
    sizes = [r[0] for r in links.select(F.size("links")).collect()]
    assert len(sizes) < 5020 and max(sizes) < 2 * bsp.LINKS and links.where("src = 0").agg(F.max("degree")).first()[0] == 5000
    near = {v: [0] for v in range(1, 5001)} | {0: range(1, 5001), 1: [0, 0, 0], 2: [0, None], 4: [0, 9999]}
    rank = dict.fromkeys(range(5001), 1 / 5001)
    for _ in range(2):
        new = dict.fromkeys(rank, 0.15 / 5001)
        for v, out in near.items():
            for w in out:
                if w in new:
                    new[w] += 0.85 * rank[v] / len(out)
        rank = new
    assert got == pytest.approx(rank, abs=1e-12)
    assert [label for label, _ in kept] == ["links"] + 3 * ["superstep"]

    weighted = spark.createDataFrame([(0, 1, 2.0), (0, 1, 5.0), (1, 2, 0.5), (0, 2, 9.0)], "src long, dst long, weight double")
    assert _values(A.shortest_paths(spark.range(4), weighted, 0)) == {0: 0.0, 1: 2.0, 2: 2.5, 3: A.UNREACHED}
