"""Secret scan with multipart credential linking, in built-in functions only.

Strong kinds are found by themselves.  Weak parts (a bare identifier, a bare key, an endpoint) say
little alone; they are reported only where complementary parts lie in one scope.  The scope is a
block of text without a blank line, and two parts link when at most ``max_gap`` code points lie
between them.  Both sides of that interval join come from one text, so it runs as a sort-merge sweep
over the row's own sorted spans, once forwards and once backwards: each sweep keeps the nearest
identifier, secret and endpoint of the scope, so a part finds its mate in one step, whatever the
number of parts.  No shuffle, no pairs, and no key that could be hot.

Offsets come from cutting the text at the matches: what lies between the matches, and the matches,
have lengths that add up to the starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bound, in_blocks, running

# The patterns of the base kinds, in the order that breaks ties between equal starts.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # AKIA[A-Z0-9]+ of 18 and more: a shorter run can hold no longer match
HEX = r"[0-9a-f]{16,}"  # [0-9a-f]+ of 16 and more, for the same reason
MIN_ASSIGN = 12

# The weak kinds.  A token has 12 or more code points, a digit among them; what stands
# before it may be "=" or ":" or "?", as in environment files, JSON and query strings.
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{12,}={0,2}(?![A-Za-z0-9+/_=-])"
ENDPOINT = r"(?:https?|postgres(?:ql)?|mysql|redis|amqps?|mongodb(?:\+srv)?|s3|ftp)://[^\x20\x09-\x0D\"'<>?]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]+)?(?![0-9.])"
BLANK = r"\n[\x20\t\r]*\n"
ID = r"^[A-Z][A-Z0-9]{11,}$"
KEY = r"^(?=.*[a-z])(?=.*[A-Z]).{24,}$"

KINDS = ("assign", "access", "hex", "weak_id", "weak_key", "endpoint")
#: What each kind can be part of.  Digits in hex alone, as a checksum has, are no part of a credential.
ROLE = {"id": ("access", "weak_id"), "secret": ("assign", "weak_key"), "endpoint": ("endpoint",)}

_SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string>"
_MATE = "struct<start:bigint,end:bigint>"
LINKED = "struct<start:bigint,rank:int,end:bigint,kind:string,mate_start:bigint,mate_end:bigint>"


def _spans(text: Column, pattern: str, kind, keep=None, group: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches; ``keep(group of the match)`` may drop some, ``kind(match)`` gives rank and kind."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # The last piece of the text follows the last match and is cut off.
    gaps = lambda found: F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    sized = bound(found, lambda found: F.zip_with(gaps(found), found, lambda b, m: F.struct(F.length(b).cast("long").alias("gap"), F.length(m).cast("long").alias("size"), m.alias("m"))))
    if group:
        sized = F.zip_with(sized, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x, g: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), x["m"].alias("m"), g.alias("g")))
    else:
        sized = F.transform(sized, lambda x: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), x["m"].alias("m"), x["m"].alias("g")))
    span = lambda pos, x: F.struct((pos + x["gap"]).alias("start"), kind(x["m"])[0].alias("rank"), (pos + x["gap"] + x["size"]).alias("end"), kind(x["m"])[1].alias("kind")).cast(_SPAN)
    none = F.array().cast(f"array<{_SPAN}>")
    emit = lambda pos, x: F.when(keep(x["g"]), F.array(span(pos, x))).otherwise(none) if keep else F.array(span(pos, x))
    walked = running(sized, F.lit(0).cast("long"), lambda pos, x: pos + x["gap"] + x["size"], emit, _SPAN)
    return F.when(text.rlike(pattern), walked).otherwise(none)


def _only(kind: str):
    return lambda m: (F.lit(KINDS.index(kind)), F.lit(kind))


def _weak(text: Column) -> Column:
    """Spans of weak parts, and of the blank lines between scopes as ``break``; none where no token can be a part."""
    sort = lambda m: F.when(m.rlike(ID), "weak_id").when(m.rlike(r"^\n"), "break").when(m.rlike(r"://|^[0-9.:]+$"), "endpoint").otherwise("weak_key")
    kind = lambda m: (F.when(sort(m) == "break", 9).when(sort(m) == "weak_id", 3).when(sort(m) == "weak_key", 4).otherwise(5), sort(m))
    like = lambda m: m.rlike(r"^\n|://|^(?:[0-9]{1,3}\.){3}") | m.rlike(ID) | m.rlike(KEY)
    return F.when(text.rlike(TOKEN), _spans(text, f"{ENDPOINT}|{BLANK}|{TOKEN}", kind, keep=like)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _sweep(parts: Column, max_gap: int, back: bool) -> Column:
    """Parts with the nearest id, secret and endpoint before them in their scope (after them, backwards).

    Forwards, weak parts inside a strong span are left out: they are that span.
    """
    roles = tuple(ROLE)
    flagged = f"struct<span:{_SPAN},{','.join(f'{r}:{_MATE}' for r in roles)}>"
    item = (lambda x: x["span"]) if back else (lambda x: x)

    def near(mate, x):
        gap = mate["start"] - x["end"] if back else x["start"] - mate["end"]
        return F.when(gap <= max_gap, mate)

    def step(s, x):
        span = item(x)
        is_break = span["kind"] == "break"
        here = F.struct(span["start"].alias("start"), span["end"].alias("end")).cast(_MATE)
        out = []
        for r in roles:
            # Of overlapping spans the one that reaches farther is kept.
            farther = s[r].isNull() | ((span["start"] <= s[r]["start"]) if back else (span["end"] >= s[r]["end"]))
            out.append(F.when(is_break, F.lit(None).cast(_MATE)).when(span["kind"].isin(*ROLE[r]) & farther & ~covered(s, span), here).otherwise(s[r]).alias(r))
        cover = s["cover"] if back else F.when(span["rank"] <= 2, F.greatest(s["cover"], span["end"])).otherwise(s["cover"])
        return F.struct(*out, cover.alias("cover"))

    def covered(s, span):
        return F.lit(False) if back else (span["rank"].between(3, 5) & (span["end"] <= s["cover"]))

    def emit(s, x):
        span = item(x)
        if not back:
            found = F.struct(span.alias("span"), *[near(s[r], span).alias(r) for r in roles]).cast(flagged)
            return F.when(covered(s, span), F.array().cast(f"array<{flagged}>")).otherwise(F.array(found))
        return _link(span, {r: _nearer(x[r], near(s[r], span), span) for r in roles})

    start = F.struct(*[F.lit(None).cast(_MATE).alias(r) for r in roles], F.lit(0).cast("long").alias("cover"))
    return running(parts, start, step, emit, LINKED if back else flagged)


def _nearer(before, after, span):
    return F.when(after.isNull(), before).when(before.isNull(), after).when(span["start"] - before["end"] <= after["start"] - span["end"], before).otherwise(after)


def _link(span, mates) -> Column:
    """The part with its mate, if it has what it needs: ids and keys each other, endpoints both (the secret is their mate)."""
    kind = span["kind"]
    mate = F.when(kind == "weak_id", mates["secret"]).when(kind == "weak_key", mates["id"]).when((kind == "endpoint") & mates["id"].isNotNull(), mates["secret"])
    linked = F.struct(*[span[c].alias(c) for c in ("start", "rank", "end", "kind")], mate["start"].alias("mate_start"), mate["end"].alias("mate_end")).cast(LINKED)
    return F.when(mate.isNotNull(), F.array(linked)).otherwise(F.array().cast(f"array<{LINKED}>"))


def scan(df: DataFrame, text_col: str = "text", max_gap: int = 1000, base_col: str = "secret_base", linked_col: str = "secret_linked") -> DataFrame:
    """``df`` with two arrays of spans ``(start, rank, end, kind)`` in code points, ends exclusive.

    ``base_col`` has the strong kinds, ``linked_col`` the weak parts that complementary parts confirm,
    with the nearest of these as ``mate_start, mate_end``; both are sorted by start, then kind.  Null
    and empty texts have none.  Rows are handled alone, so that ties, repeated rows and any other
    columns stay as they are; columns named ``base_col`` or ``linked_col`` are replaced.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    base = F.array_sort(
        F.concat(
            _spans(t, ASSIGN, _only("assign"), keep=lambda g: F.length(g) >= MIN_ASSIGN, group=1),
            _spans(t, ACCESS, _only("access")),
            _spans(t, HEX, _only("hex")),
        )
    )
    out = df.withColumn(base_col, base).withColumn(linked_col, _weak(t))
    parts = F.array_sort(F.concat(F.col(base_col), F.col(linked_col)))
    any_weak = F.exists(F.col(linked_col), lambda x: x["kind"] != "break")
    linked = F.reverse(_sweep(F.reverse(_sweep(parts, max_gap, False)), max_gap, True))
    return out.withColumn(linked_col, F.when(any_weak, linked).otherwise(F.array().cast(f"array<{LINKED}>")))


def all_spans(base: Column, linked: Column) -> Column:
    """The spans of both columns of ``scan`` in one order."""
    return F.array_sort(F.concat(base, F.transform(linked, _plain)))


def _plain(x: Column) -> Column:
    return F.struct(*[x[c].alias(c) for c in ("start", "rank", "end", "kind")]).cast(_SPAN)


def digest(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with each stretch covered by spans replaced by ``mask``; overlapping spans give one mask.

    What is left of the text is cut off block by block of spans, and inside a block span by span.
    """
    blocks = bound(F.array_sort(spans), in_blocks)
    whole = 1 << 30
    cut = lambda t, n: F.substr(t, F.lit(1), F.greatest(n, F.lit(0)).cast("int"))
    rest = lambda t, n: F.substr(t, (F.greatest(n, F.lit(0)) + 1).cast("int"), F.lit(whole))
    reach = lambda pos, block: F.greatest(pos, F.array_max(F.transform(block, lambda x: x["end"])))

    def one(s, x):
        ahead = x["start"] >= s["pos"]
        gone = F.greatest(x["end"], s["pos"]) - s["pos"]
        piece = F.when(ahead, F.array(cut(s["text"], x["start"] - s["pos"]), F.lit(mask))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(s["pos"], x["end"]).alias("pos"), rest(s["text"], gone).alias("text"), F.concat(s["out"], piece).alias("out"))

    walked = F.aggregate(
        blocks,
        F.struct(F.lit(0).cast("long").alias("pos"), text.alias("text"), F.array().cast("array<string>").alias("out")),
        lambda done, block: F.aggregate(
            block,
            F.struct(done["pos"].alias("pos"), cut(done["text"], reach(done["pos"], block) - done["pos"]).alias("text"), F.array().cast("array<string>").alias("out")),
            one,
            lambda s: F.struct(s["pos"].alias("pos"), rest(done["text"], s["pos"] - done["pos"]).alias("text"), F.concat(done["out"], F.array(F.array_join(s["out"], ""))).alias("out")),
        ),
        lambda done: F.concat(F.array_join(done["out"], ""), done["text"]),
    )
    return F.when(F.size(spans) > 0, walked).otherwise(text)
