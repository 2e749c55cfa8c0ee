"""Chat formatting by schema fingerprints, in built-in functions only.

A layout is a set of nested field paths with a mapping to canonical turns.  The paths that a table
or a JSON record has, as far as any layout knows them, are sorted and hashed; the hash selects the
mapping.  Turns are rendered with markers for their start, role and end.  Inside roles and texts
every ``<`` + backslashes + ``|`` gets one more backslash, so that no marker can arise there, and
reading back takes one away.
"""

from __future__ import annotations

import hashlib
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import running

# The markers.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
TURNS = "array<struct<role:string,text:string>>"

#: Layouts: the nested paths of each, and how its turns come about, in the paths' own names.
LAYOUTS: dict[str, tuple[str, ...]] = {
    "turn_rows": ("conv_id", "role", "text", "turn"),
    "messages": ("messages[].content", "messages[].role"),
    "from_value": ("conversations[].from", "conversations[].value"),
    "instruction": ("input", "instruction", "output"),
    "instruction_only": ("instruction", "output"),
    "prompt_response": ("prompt", "response"),
    "prompt_completion": ("completion", "prompt"),
    "question_answer": ("answer", "question"),
}
#: Other names that roles have in such data.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


KNOWN = {p for paths in LAYOUTS.values() for p in paths}
#: Paths of layouts that single records can have.
IN_RECORDS = sorted({p for name, paths in LAYOUTS.items() if name != "turn_rows" for p in paths})


def layout_of(paths) -> str | None:
    """The layout of a set of known paths: the largest that it holds whole, the first of equally large ones."""
    return max((n for n, own in LAYOUTS.items() if set(own) <= set(paths)), key=lambda n: len(LAYOUTS[n]), default=None)


@cache
def by_fingerprint() -> dict[str, str]:
    """The layout for the fingerprint of every set of paths that a record can have and that holds a layout."""
    sets = (tuple(p for i, p in enumerate(IN_RECORDS) if bits >> i & 1) for bits in range(1 << len(IN_RECORDS)))
    return {fingerprint(s): name for s in sets if (name := layout_of(s))}


def field_paths(kind: T.DataType, prefix: str = "") -> set[str]:
    """Nested field paths of a schema; ``[]`` stands for the elements of an array."""
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, prefix + "[]")
    if isinstance(kind, T.StructType):
        return {p for f in kind.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)}
    return {prefix}


def _turn(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _turns_of(layout: str, get) -> Column:
    """Turns of one record; ``get(path)`` gives a string, or an array of strings for a path through ``[]``."""
    if layout in ("messages", "from_value"):
        role, text = ("messages[].role", "messages[].content") if layout == "messages" else ("conversations[].from", "conversations[].value")
        names = F.create_map(*[F.lit(x) for kv in ROLE_NAMES.items() for x in kv])
        turns = F.zip_with(get(role), get(text), lambda r, t: F.struct(F.coalesce(F.try_element_at(names, F.coalesce(r, F.lit(""))), r, F.lit("")).alias("role"), F.coalesce(t, F.lit("")).alias("text")))
        return F.coalesce(turns, F.array().cast(TURNS)).cast(TURNS)
    if layout == "instruction":
        extra = F.coalesce(get("input"), F.lit(""))
        ask = F.concat(F.coalesce(get("instruction"), F.lit("")), F.when(extra != "", F.concat(F.lit("\n\n"), extra)).otherwise(F.lit("")))
        return F.array(_turn("user", ask), _turn("assistant", get("output"))).cast(TURNS)
    ask, answer = {
        "instruction_only": ("instruction", "output"),
        "prompt_response": ("prompt", "response"),
        "prompt_completion": ("prompt", "completion"),
        "question_answer": ("question", "answer"),
    }[layout]
    return F.array(_turn("user", get(ask)), _turn("assistant", get(answer))).cast(TURNS)


def canonical(df: DataFrame, id_col: str | None = None) -> DataFrame:
    """``conv_id, turns`` of a table whose schema is one of the layouts; other columns are ignored.

    Rows by turn are gathered by conversation in the order of (turn, role, text); null turns come
    first, null roles and texts are empty, rows of a null conversation form one, repeated rows are
    repeated turns.  For other layouts ``id_col`` names the id.  An unknown schema raises ValueError.
    """
    has = field_paths(df.schema) & KNOWN
    rows = set(LAYOUTS["turn_rows"])
    layout = "turn_rows" if fingerprint(has & rows) == fingerprint(rows) else by_fingerprint().get(fingerprint(has - rows))
    if layout is None:
        raise ValueError(f"no layout for the paths {sorted(field_paths(df.schema))}")
    if layout == "turn_rows":
        row = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        grouped = df.select(F.col("conv_id").alias("conv_id"), row.alias("row")).groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
        return grouped.select("conv_id", F.transform("rows", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).cast(TURNS).alias("turns"))

    def get(path: str) -> Column:
        head, _, leaf = path.partition("[].")
        return F.transform(F.col(head), lambda x: x[leaf].cast("string")) if leaf else F.col(path).cast("string")

    conv = F.col(id_col) if id_col else F.monotonically_increasing_id()
    return df.select(conv.alias("conv_id"), _turns_of(layout, get).alias("turns"))


def canonical_json(df: DataFrame, json_col: str, id_col: str) -> DataFrame:
    """``conv_id, layout, turns`` of JSON records of mixed layouts, fingerprinted row by row.

    A path counts as present if the record has the field with a value, or a list of turns of which any
    element has it.  Records that are null, are no JSON, or have no known layout get a null layout and
    no turns.
    """
    v = F.try_parse_json(F.col(json_col))

    def get(path: str) -> Column:
        head, _, leaf = path.partition("[].")
        if not leaf:
            return F.try_variant_get(v, f"$.{path}", "string")
        return F.transform(F.try_variant_get(v, f"$.{head}", "array<variant>"), lambda x: F.try_variant_get(x, f"$.{leaf}", "string"))

    def present(path: str) -> Column:
        got = get(path)
        return F.exists(got, lambda x: x.isNotNull()) if "[]." in path else got.isNotNull()

    found = F.array(*[F.when(F.coalesce(present(p), F.lit(False)), F.lit(p)) for p in IN_RECORDS])
    mark = F.substring(F.sha2(F.array_join(F.array_compact(found), "\n"), 256), 1, 16)
    marked = df.select(F.col(id_col).alias("conv_id"), F.col(json_col), mark.alias("mark"))
    table = df.sparkSession.createDataFrame(list(by_fingerprint().items()), "mark string, layout string")
    known = marked.join(F.broadcast(table), "mark", "left")  # at most 2 ** len(IN_RECORDS) rows
    turns = F.lit(None).cast(TURNS)
    for name in LAYOUTS:
        if name != "turn_rows":
            turns = F.when(F.col("layout") == name, _turns_of(name, get)).otherwise(turns)
    return known.select("conv_id", "layout", F.coalesce(turns, F.array().cast(TURNS)).alias("turns"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def render(df: DataFrame, train_on: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_spans``: the text, and the stretches of it, in code points with the end exclusive, that count for the loss."""
    pieces = F.transform(
        "turns",
        lambda x: F.struct(
            F.concat(F.lit(START), escape(x["role"]), F.lit(SEP)).alias("head"),
            escape(x["text"]).alias("body"),
            (x["role"] == train_on).alias("learn"),
        ),
    )
    span = "struct<start:bigint,end:bigint>"
    upto = lambda pos, x: pos + F.length(x["head"]) + F.length(x["body"])
    spans = running(
        F.col("pieces"),
        F.lit(0).cast("long"),
        lambda pos, x: upto(pos, x) + len(END),
        lambda pos, x: F.when(x["learn"], F.array(F.struct((pos + F.length(x["head"])).alias("start"), upto(pos, x).alias("end")).cast(span))).otherwise(F.array().cast(f"array<{span}>")),
        span,
    )
    text = F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    return df.select("conv_id", pieces.alias("pieces")).select("conv_id", text.alias("formatted"), spans.alias("loss_spans"))


def _quoted(marker: str) -> str:
    return marker.replace("|", r"\|")


def read_back(formatted: Column) -> Column:
    """The canonical turns of a formatted text."""
    rows = F.split(formatted, _quoted(END), -1)
    rows = F.slice(rows, F.lit(1), F.size(rows) - 1)  # after the last end stands nothing
    cut = F.transform(rows, lambda x: F.split(x, _quoted(SEP), 2))
    return F.transform(cut, lambda x: F.struct(unescape(F.substring(x[0], len(START) + 1, 1 << 30)).alias("role"), unescape(x[1]).alias("text"))).cast(TURNS)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
