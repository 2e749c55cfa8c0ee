"""Assembly as a list of named steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from quillon.assembly import clean, kmers
from quillon.assembly.kmers import Graph

STEPS: dict[str, Callable[[Graph], Graph]] = {
    "MERGE": clean.merge_paths,
    "TIP_SINGLE_NODE": clean.remove_tips,
    "TIP": clean.tips,
    "BUBBLE": clean.remove_bubbles,
    "BRIDGE": clean.remove_bridges,
    "UNROLL_TANDEM": clean.unroll_tandem,
    "REMOVE_BAD_COVERAGE": clean.remove_bad_coverage,
}
DEFAULT = ("BUILD", "MERGE", "TIP", "MERGE", "BUBBLE", "MERGE", "BRIDGE", "MERGE")


def assemble(reads: DataFrame, k: int, steps=DEFAULT, **options: dict) -> Graph:
    """Runs the steps over ``read_id, seq, mate_seq``; ``options`` are keyword arguments by step.

    The first step, and only the first, is BUILD.
    """
    if not steps or steps[0] != "BUILD" or "BUILD" in steps[1:]:
        raise ValueError("BUILD comes first, and once")
    unknown = [s for s in steps[1:] if s not in STEPS]
    if unknown:
        raise ValueError(f"no steps {unknown}")
    g = kmers.build(reads, k, **options.get("BUILD", {}))
    for s in steps[1:]:
        g = STEPS[s](g, **options.get(s, {}))
    return g
