"""Vertex programs in supersteps, each superstep one relational plan.

A superstep joins the vertices with the messages that were combined for them, computes new values,
and sends messages along edges.  Vertices without messages keep their row; messages to ids without a
vertex are dropped unless ``create_missing`` asks for the vertex.  Programs written as column
expressions stay in the JVM; ``python_superstep`` runs a Python ``compute`` for any other program.

Every superstep is written to the shared folder: plans do not grow, and a lost executor costs one
superstep.  Edges are put into lists by source once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quillon.session import materialize, ship


@dataclass
class Step:
    """What the expressions of a program may use besides the columns."""

    superstep: int
    vertices: int
    aggregates: dict[str, object] = field(default_factory=dict)


@dataclass
class Program:
    """A vertex program over ``id, value, message`` (null without messages), as expressions.

    ``start`` is the value in superstep 1.  ``compute`` gives the new value, ``sends`` says which
    vertices send, ``message`` what goes along an edge (columns ``value``, ``weight``, ``degree``),
    ``combine`` aggregates the messages of one receiver.  A vertex is active if it has messages or
    has not voted to halt by ``halts``.  ``aggregators`` are global aggregates of each superstep,
    which the next can read; ``stop`` ends the job after a superstep.
    """

    start: Callable[[Column, Step], Column]
    compute: Callable[[Column, Column, Step], Column]
    message: Callable[[Column, Column, Column], Column]
    combine: Callable[[Column], Column]
    first_sends: Callable[[Column, Step], Column] = lambda value, step: F.lit(True)
    sends: Callable[[Column, Column, Step], Column] = lambda old, new, step: ~old.eqNullSafe(new)
    halts: Callable[[Column, Step], Column] = lambda value, step: F.lit(True)
    aggregators: dict[str, Callable[[], Column]] = field(default_factory=dict)
    stop: Callable[[Step], bool] = lambda step: False


# The names.
#: Join strategies of a superstep by name; all give the same answer, and None leaves the choice to the optimizer.
PLANS = {"OUTER_JOIN": None, "INNER_JOIN": "shuffle_hash", "OUTER_JOIN_SORT": "merge", "OUTER_JOIN_SINGLE_SORT": "merge"}

#: Edges in a list of links.
LINKS = 1000


def run(
    vertices: DataFrame,
    edges: DataFrame,
    program: Program,
    max_supersteps: int = 100,
    n_vertices: int | None = None,
    checkpoint: Callable[[int], bool] = lambda superstep: True,
    on_superstep: Callable[[int, DataFrame], None] | None = None,
    create_missing: bool = False,
    until_quiet: bool = True,
    plan: str = "OUTER_JOIN",
) -> DataFrame:
    """``id, value`` when all vertices have halted and no message is left, or after ``max_supersteps``.

    ``vertices`` has ``id`` and may have ``value``; ``edges`` has ``src, dst`` and may have
    ``weight``.  ``checkpoint`` says after which supersteps to write the state; jobs that count
    active vertices need it every time.  A program that runs a fixed number of supersteps need not
    count: with ``until_quiet`` false supersteps chain up in one plan between checkpoints.
    """
    if "value" not in vertices.columns:
        vertices = vertices.withColumn("value", F.lit(None).cast("double"))
    links = materialize(_link_lists(edges), "links")
    to = (F.col("to")["dst"].alias("dst"), F.col("to")["weight"].alias("weight")) if "weight" in edges.columns else (F.col("to").alias("dst"), F.lit(1.0).alias("weight"))
    step = Step(1, n_vertices if n_vertices is not None else vertices.count())

    state = vertices.select("id", "value")
    state = state.withColumn("value", program.start(F.col("value"), step))
    state = state.select("id", "value", program.first_sends(F.col("value"), step).alias("sends"), program.halts(F.col("value"), step).alias("halted"))
    state = materialize(state, "superstep")
    while True:
        quiet = False
        if until_quiet or program.aggregators:
            totals = _totals(state, program)
            step.aggregates = {k: totals[k] for k in program.aggregators}
            quiet = until_quiet and not (totals["__send"] or totals["__awake"])
        if on_superstep:
            on_superstep(step.superstep, state)
        if step.superstep >= max_supersteps or program.stop(step) or quiet:
            return state.select("id", "value")
        step = Step(step.superstep + 1, step.vertices, step.aggregates)
        sent = state.where("sends").select(F.col("id").alias("src"), "value").join(links, "src")
        sent = sent.select("value", "degree", F.explode("links").alias("to")).select("value", "degree", *to)
        inbox = sent.select("dst", program.message(F.col("value"), F.col("weight"), F.col("degree")).alias("m")).where("m is not null")
        inbox = inbox.groupBy(F.col("dst").alias("id")).agg(program.combine(F.col("m")).alias("message"))
        if PLANS[plan]:
            inbox = inbox.hint(PLANS[plan])
        joined = state.select("id", "value", "halted").join(inbox, "id", "full" if create_missing else "left")
        active = F.col("message").isNotNull() | ~F.coalesce("halted", F.lit(False))
        new = F.when(active, program.compute(F.col("value"), F.col("message"), step)).otherwise(F.col("value"))
        state = joined.select("id", F.col("value").alias("old"), new.alias("value"), active.alias("active"), "halted").select(
            "id",
            "value",
            (F.col("active") & program.sends(F.col("old"), F.col("value"), step)).alias("sends"),
            F.when(F.col("active"), program.halts(F.col("value"), step)).otherwise(F.coalesce("halted", F.lit(True))).alias("halted"),
        )
        if checkpoint(step.superstep):
            state = materialize(state, "superstep")


def _link_lists(edges: DataFrame) -> DataFrame:
    """``src, degree, links``: the edges of a vertex in lists of about ``LINKS``, which a superstep sorts and moves as one row each.

    ``links`` has targets, or targets with weights if ``edges`` have them.
    """
    link = F.struct("dst", "weight") if "weight" in edges.columns else F.col("dst")
    of = edges.join(edges.groupBy("src").agg(F.count("*").alias("degree")), "src")
    part = F.pmod(F.xxhash64("dst"), F.ceil(F.col("degree") / LINKS))
    return of.groupBy("src", "degree", part.alias("part")).agg(F.collect_list(link).alias("links")).drop("part")


def _totals(state: DataFrame, program: Program) -> dict:
    counts = [F.count_if("sends").alias("__send"), F.count_if(~F.col("halted")).alias("__awake")]
    return state.agg(*counts, *[make().alias(k) for k, make in program.aggregators.items()]).first().asDict()


# -- programs in Python ------------------------------------------------------------------------------
class Vertex:
    """What a Python ``compute`` sees and does; mutations take effect between supersteps.

    Edges are made into Python objects when they are first looked at.  A message to all of them
    stays one until then, and Spark takes it along the edges.
    """

    def __init__(self, id, value, edges: Callable[[], list[tuple]], superstep: int, n_vertices: int):
        self.id, self.value, self.superstep, self.n_vertices = id, value, superstep, n_vertices
        self.halted, self.sent, self.sent_to_all, self.added, self.deleted = False, [], [], [], []
        self._load, self._edges = edges, None

    @property
    def edges(self) -> list[tuple]:
        if self._edges is None:
            self._edges = self._load()
            for message in self.sent_to_all:
                self.sent += [(to, message) for to, _ in self._edges]
            self.sent_to_all = []
        return self._edges

    @edges.setter
    def edges(self, edges: list[tuple]) -> None:
        self.edges  # what was sent goes along the edges that were there
        self._edges = edges

    @property
    def looked_at_edges(self) -> bool:
        return self._edges is not None

    def send(self, to, message) -> None:
        if message is None:
            raise ValueError("a message is null")
        self.sent.append((to, message))

    def send_to_all(self, message) -> None:
        if message is not None and not self.looked_at_edges:
            self.sent_to_all.append(message)
            return
        for to, _ in self.edges:
            self.send(to, message)

    def vote_to_halt(self) -> None:
        self.halted = True

    def activate(self) -> None:
        self.halted = False

    def add_edge(self, to, weight=1.0) -> None:
        self.edges.append((to, weight))

    def remove_edge(self, to) -> None:
        self.edges = [e for e in self.edges if e[0] != to]

    def sort_edges(self) -> None:
        self.edges.sort()

    def add_vertex(self, id, value) -> None:
        self.added.append((id, value))

    def delete_vertex(self, id) -> None:
        self.deleted.append(id)


def run_python(
    vertices: DataFrame,
    edges: DataFrame,
    compute: Callable[[Vertex, list], None],
    combine: Callable[[Column], Column] = F.collect_list,
    id_type: str = "bigint",
    value_type: str = "double",
    message_type: str = "double",
    max_supersteps: int = 100,
) -> DataFrame:
    """``id, value`` of a program ``compute(vertex, messages)``.

    Vertices, edges and messages meet by id in Arrow batches; a vertex is one row on its way out,
    with what it sends, adds and deletes.  ``combine`` aggregates messages in
    Spark before they are delivered; its default delivers them all as a list.  When one superstep
    deletes and inserts the same id, it is deleted, then inserted.
    """
    spark = vertices.sparkSession
    ship(spark)
    n = vertices.count()
    if "weight" not in edges.columns:
        edges = edges.withColumn("weight", F.lit(1.0))
    near = edges.groupBy(F.col("src").cast(id_type).alias("id")).agg(F.collect_list(F.struct(F.col("dst").cast(id_type).alias("dst"), F.col("weight").cast("double").alias("weight"))).alias("edges"))
    value = F.col("value").cast(value_type) if "value" in vertices.columns else F.lit(None).cast(value_type)
    state = materialize(vertices.select(F.col("id").cast(id_type).alias("id"), value.alias("value"), F.lit(False).alias("halted")).join(near, "id", "left"), "superstep")
    inbox = spark.createDataFrame([], f"id {id_type}, messages array<{message_type}>")
    edge_type = f"array<struct<dst:{id_type},weight:double>>"
    state_schema = f"id {id_type}, value {value_type}, halted boolean, edges {edge_type}"
    schema = f"{state_schema}, sent array<struct<id:{id_type},message:{message_type}>>, sent_to_all array<{message_type}>, added array<struct<id:{id_type},value:{value_type}>>, deleted array<{id_type}>"
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    for superstep in range(1, max_supersteps + 1):

        def step(batches: Iterable[pa.RecordBatch], superstep=superstep) -> Iterable[pa.RecordBatch]:
            for batch in batches:
                links = batch.column("edges")
                counts = batch.column("messages").value_lengths().fill_null(0).to_pylist()
                messages = iter(batch.column("messages").flatten().to_pylist())
                run_here = []
                for i, (id, value, halted, n_got) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "value", "halted")), counts)):
                    v = Vertex(id, value, lambda i=i: _links(links[i]), superstep, n)
                    if halted and not n_got:
                        v.halted = True
                    else:
                        compute(v, list(islice(messages, n_got)))
                    run_here.append(v)
                if any(v.looked_at_edges for v in run_here):
                    links = _lists([v.edges if v.looked_at_edges else _links(links[i]) for i, v in enumerate(run_here)], arrow.field("edges").type)
                else:
                    links = links.cast(arrow.field("edges").type)
                flat = [_typed([getattr(v, c) for v in run_here], arrow.field(c).type) for c in ("id", "value", "halted")]
                nested = [_lists([getattr(v, c) for v in run_here], arrow.field(c).type) for c in ("sent", "sent_to_all", "added", "deleted")]
                yield pa.RecordBatch.from_arrays([*flat, links, *nested], schema=arrow)

        done = materialize(state.join(inbox, "id", "left").mapInArrow(step, schema), "superstep")
        n_sent, n_awake, n_added, n_deleted = done.agg(
            F.count_if((F.size("sent") > 0) | ((F.size("sent_to_all") > 0) & (F.size("edges") > 0))), F.count_if(~F.col("halted")), F.count_if(F.size("added") > 0), F.count_if(F.size("deleted") > 0)
        ).first()
        state = done.select("id", "value", "halted", "edges")
        if n_deleted:
            state = state.join(done.select(F.explode("deleted").alias("id")), "id", "left_anti")
        if n_added:
            added = done.select(F.inline("added")).groupBy("id").agg(F.max("value").alias("value")).select("id", "value", F.lit(False).alias("halted"), F.lit(None).cast(edge_type).alias("edges"))
            state = state.union(added.join(state.select("id"), "id", "left_anti"))
        to_all = done.where(F.size("sent_to_all") > 0).select("sent_to_all", F.explode("edges.dst").alias("id")).select("id", F.explode("sent_to_all").alias("message"))
        inbox = done.select(F.inline("sent")).union(to_all).groupBy("id").agg(combine(F.col("message")).alias("messages"))
        if inbox.schema["messages"].dataType.typeName() != "array":
            inbox = inbox.withColumn("messages", F.array("messages"))
        if not (n_sent or n_awake or n_added):
            break
    return state.select("id", "value")


def _links(edges: pa.Scalar) -> list[tuple]:
    return [(e["dst"], e["weight"]) for e in edges.as_py() or []]


def _typed(values: list, kind: pa.DataType) -> pa.Array:
    try:
        return pa.array(values, kind)
    except (pa.ArrowInvalid, pa.ArrowTypeError):  # numbers of another kind
        return pa.array(values).cast(kind)


def _lists(rows: list[list], kind: pa.ListType) -> pa.Array:
    """Rows of values or, for structs, of tuples."""
    flat, of = [x for row in rows for x in row], kind.value_type
    if pa.types.is_struct(of):
        columns = zip(*flat) if flat else [()] * of.num_fields
        values = pa.StructArray.from_arrays([_typed(list(c), f.type) for c, f in zip(columns, of)], fields=list(of))
    else:
        values = _typed(flat, of)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), values, type=kind)
