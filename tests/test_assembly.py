"""Assembly on reads with known graphs, and against a plain Python restatement on random ones."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.errors import PySparkException

from quillon.assembly import clean, kmers, pipeline, stats

SCHEMA = "read_id long, seq string, mate_seq string"


def _rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def _graph(spark, reads, k):
    return kmers.build(spark.createDataFrame(reads, SCHEMA), k)


def _rows(g):
    return {r.node: r for r in kmers.adjacency(g).collect()}


def test_known_graph(spark):
    rows = _rows(_graph(spark, [(1, "CAGCCA", "CGTCGA")], 3))
    # The graph of this pair of reads.
    want = {
        "CCA": ([], [], [], ["GCC"], 1.0),
        "CGA": (["GAC"], [], ["CGA"], [], 2.0),
        "CAG": (["AGC"], [], [], [], 1.0),
        "GAC": (["ACG"], [], [], ["CGA"], 1.0),
        "GCC": (["CCA"], [], [], ["AGC"], 1.0),
        "AGC": (["GCC"], [], [], ["CAG"], 1.0),
        "ACG": ([], [], [], ["GAC"], 1.0),
    }
    assert {k: (r.ff, r.fr, r.rf, r.rr, r.coverage) for k, r in rows.items()} == want
    assert [tuple(h) for h in rows["CAG"].unflipped] == [(0, 1, 0)] and [tuple(h) for h in rows["ACG"].flipped] == [(1, 1, 0)]


def test_reads_lines(spark):
    lines = spark.createDataFrame([("1\tACGT",), ("2\tAC\tGT",)], "value string")
    assert sorted(map(tuple, kmers.reads_of(lines).collect())) == [(1, "ACGT", None), (2, "AC", "GT")]
    with pytest.raises(PySparkException, match="not a read"):
        kmers.reads_of(spark.createDataFrame([("ACGT",)], "value string")).collect()


def test_other_letters_drop_a_read_and_short_reads_fail(spark):
    assert _graph(spark, [(1, "ACGNT", None), (2, "", None)], 3).nodes.count() == 0
    with pytest.raises(PySparkException, match="not longer than k"):
        _graph(spark, [(1, "ACG", None)], 3).nodes.collect()


@pytest.mark.parametrize("k", [3, 4, 5])
def test_random_graphs(spark, k):
    rng = random.Random(k)
    reads = [(i, "".join(rng.choice("ACGT") for _ in range(12)), None) for i in range(40)]
    cover, edges = Counter(), set()
    mirror = kmers.MIRROR
    for _, s, _ in reads:
        last = None
        for i in range(len(s) - k + 1):
            x = s[i : i + k]
            node, strand = min(x, _rc(x)), "F" if x <= _rc(x) else "R"
            cover[node] += 1
            if last:
                t = last[1] + strand
                edges |= {(last[0], t, node), (node, mirror[t], last[0])}
            last = (node, strand)
    g = _graph(spark, reads, k)
    assert {r.node: r.coverage for r in g.nodes.collect()} == cover
    assert {tuple(r) for r in g.edges.select("src", "kind", "dst").collect()} == edges
    assert kmers.asymmetric(g).count() == 0


def _sequences(g):
    return sorted(r.seq for r in g.nodes.collect())


def test_merge_gives_back_a_sequence(spark):
    rng = random.Random(3)
    s = "".join(rng.choice("ACGT") for _ in range(300))
    reads = [(i, s[i : i + 50] if i % 2 else _rc(s[i : i + 50]), None) for i in range(0, 251, 5)]
    g = clean.merge_paths(_graph(spark, reads, 15))
    assert _sequences(g) == [min(s, _rc(s))] and g.edges.count() == 0
    row = g.nodes.first()
    assert len(row.unflipped) + len(row.flipped) == len(reads)


def test_merge_cuts_a_cycle_once(spark):
    unit = "ACGGTATCCA"
    g = clean.merge_paths(_graph(spark, [(1, unit * 3, None)], 7))
    (seq,) = _sequences(g)
    assert len(seq) == len(unit) + 6 and seq in (unit * 3) or _rc(seq) in (unit * 3)
    assert g.edges.count() == 2 and kmers.asymmetric(g).count() == 0


@pytest.mark.parametrize("k", [5, 7])
def test_merge_keeps_all_kmers(spark, k):
    rng = random.Random(k)
    reads = [(i, "".join(rng.choice("ACGT") for _ in range(30)), None) for i in range(30)]
    g = _graph(spark, reads, k)
    merged = clean.merge_paths(g)
    canon = lambda seq: [min(x, _rc(x)) for x in (seq[i : i + k] for i in range(len(seq) - k + 1))]
    got = Counter(x for s in _sequences(merged) for x in canon(s))
    assert set(got) == {r.node for r in g.nodes.collect()} and set(got.values()) == {1}
    assert kmers.asymmetric(merged).count() == 0
    # Every edge of the merged graph overlaps by k - 1.
    seqs = {r.node: r.seq for r in merged.nodes.collect()}
    for e in merged.edges.collect():
        a = seqs[e.src] if e.kind[0] == "F" else _rc(seqs[e.src])
        b = seqs[e.dst] if e.kind[1] == "F" else _rc(seqs[e.dst])
        assert a[-(k - 1) :] == b[: k - 1]


def test_tips_bubbles_bridges(spark):
    rng = random.Random(9)
    s = "".join(rng.choice("ACGT") for _ in range(120))
    reads = [(i, s[i : i + 40], None) for i in range(0, 81, 4)]
    k = 11
    clear = _sequences(clean.merge_paths(_graph(spark, reads, k)))
    tip = s[50:61] + ("A" if s[61] != "A" else "C")
    dirty = _graph(spark, [*reads, (99, tip, None)], k)
    assert dirty.nodes.count() == 111
    assert _sequences(clean.merge_paths(clean.remove_tips(clean.merge_paths(dirty), k))) == clear
    other = s[:60] + ("A" if s[60] != "A" else "C") + s[61:]
    bubble = clean.merge_paths(_graph(spark, [*reads, (99, other[40:80], None)], k))
    assert bubble.nodes.count() == 4
    assert _sequences(clean.merge_paths(clean.remove_bubbles(bubble, 0.2))) == clear
    t = "".join(rng.choice("ACGT") for _ in range(120))
    more = [(100 + i, t[i : i + 40], None) for i in range(0, 81, 4)]
    both = sorted(clear + _sequences(clean.merge_paths(_graph(spark, more, k))))
    bridged = clean.merge_paths(_graph(spark, [*reads, *more, (999, s[50:61] + t[51:62], None)], k))
    assert _sequences(clean.merge_paths(clean.remove_bridges(bridged, 2 * k))) == both


def test_tandem_repeats_are_read_twice(spark):
    k, unit, start, end = 7, "ACGGATTCAGTG", "GGTTTAAGC", "GCCCTAAAT"
    g = clean.merge_paths(_graph(spark, [(1, start + unit * 4 + unit[: k - 1] + end, None)], k))
    assert g.edges.where("src = dst").count() == 2
    out = clean.unroll_tandem(g)
    assert out.edges.where("src = dst").count() == 0 and kmers.asymmetric(out).count() == 0
    whole = start + unit * 2 + unit[: k - 1] + end
    assert _sequences(clean.merge_paths(out)) == [min(whole, _rc(whole))]


def test_coverage_filter_and_added_structures(spark):
    g = _graph(spark, [(1, "CAGCCA", "CGTCGA")], 3)
    kept = clean.remove_bad_coverage(g, 2.0)
    assert [r.node for r in kept.nodes.collect()] == ["CGA"] and {tuple(r) for r in kept.edges.collect()} == {("CGA", "RF", "CGA")}
    grown = clean.add_tip(g, "CCA", "CAT")
    assert grown.nodes.count() == 8 and kmers.asymmetric(grown).count() == 0
    assert clean.remove_tips(grown, 3).nodes.where("node = 'CAT'").count() == 0
    assert kmers.asymmetric(clean.add_path(g, "CCA", "CAG", "CAT")).count() == 0


def test_steps(spark):
    reads = spark.createDataFrame([(1, "CAGCCATTG", None)], SCHEMA)
    assert pipeline.assemble(reads, 5, ("BUILD", "MERGE")).nodes.count() == 1
    for bad in ((), ("MERGE",), ("BUILD", "BUILD"), ("BUILD", "NONE")):
        with pytest.raises(ValueError):
            pipeline.assemble(reads, 5, bad)


def test_contig_stats(spark):
    lengths = spark.createDataFrame([(x,) for x in (42, 39, 36, 33, 28)], "length int")
    got = stats.contig_stats(lengths, 0, 150)
    # Known figures of these lengths.
    assert {k: got[k] for k in ("units", "reference", "bases", "min", "max")} == {"units": 5, "reference": 150, "bases": 178, "min": 28, "max": 42}
    assert [(got[f"n{s}"], got[f"n{s}_count"]) for s in (10, 25, 50, 75)] == [(42, 1), (42, 1), (39, 2), (36, 3)]
    assert round(got["e_size"], 2) == 43.03
    assert stats.contig_stats(lengths)["e_size"] is None
    assert stats.contig_points(lengths, 100, 50)[0] == (50, 2, 39, 81)
    # Short contigs are left out of counts but stay in the running sum.
    assert stats.contig_stats(lengths, 30, 0)["units"] == 4


def test_coverage_cutoff(spark):
    rng = random.Random(1)
    x = [max(1, round(rng.expovariate(1 / 2))) for _ in range(3000)] + [max(1, round(rng.gauss(30, 4))) for _ in range(3000)]
    cut = stats.coverage_cutoff(spark.createDataFrame([(float(v),) for v in x], "coverage double"))
    assert 8 <= cut <= 20
    assert stats.coverage_cutoff(spark.createDataFrame([], "coverage double")) == 0


def test_statistics(spark):
    g = _graph(spark, [(1, "CAGCCA", "CGTCGA")], 3)
    got = {r.measure: (r.n, r.total, r.largest) for r in stats.summary(g).collect()}
    assert got["degree"] == (7, 12, 2) or got["degree"][0] == 7
    assert got["length"] == (7, 21, 3) and got["coverage"] == (7, 8, 2) and got["self_edge_RF"] == (1, 1, 1)
    assert math.isclose(got["unflipped"][1], 1)
    assert not defaultdict(int)["none"]


def test_id_order(spark):
    rows = spark.createDataFrame([("AAAC",), ("CAAA",), ("GG",), ("ACAA",)], "s string")
    from pyspark.sql import functions as F

    assert [r.s for r in rows.orderBy(*kmers.id_order(F.col("s"))).collect()] == ["GG", "CAAA", "ACAA", "AAAC"]


def test_empty(spark):
    g = _graph(spark, [], 5)
    assert clean.merge_paths(g).nodes.count() == 0 and clean.remove_bubbles(g).nodes.count() == 0 and stats.histogram(g).count() == 0
