"""Operator 12: cheapest repair of conversation structure, by weighted interval parsing.

A sound conversation is empty or an optional system turn and then pairs of user and assistant turns.
Rows may be kept (cost 0), given the role user or assistant (2) or deleted (3; blank rows and repeats
must be), empty turns may be inserted (2), and a row cut off before its end costs 1 more if it stays.

The grammar is in Chomsky normal form. Its symbols X(p, q) derive the row fragments that lead from
point p of a sound conversation to point q: 0 nothing said, 1 after the system turn, 2 after a user
turn, 3 after an assistant turn. Rules are X(p, q) -> X(p, r) X(r, q), and one row or an insertion as
terminals. A cell holds the least (cost, audit) of a span and symbol; audits of one cost are compared
as ASCII. Neither is a prefix of the other, since more insertions cost more, so the least whole is made
of least parts. Insertions are closed over: at most two in a row can be of use. As the symbols cover
every fragment, any one cut of a span finds its best parse, and spans are combined bottom-up by length
1, 2, 4, ... instead of all of them.

Conversations are numbered without gathering them and cut into spans of ``SPAN`` rows, whose parses
are combined ``FAN`` at a time until one is left; the choice then goes down the same way. A
conversation of any length so spreads over tasks; only its audit, one letter a row, is one value.

Defined results: rows are taken by turn, NULL first, equal ones by role, then by a hash of the text.
NULL role and text stand for one space. NULL ``conv_id`` is a conversation like any other. A role
without characters can't be kept. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from canopyframe.llm.text import SPACE_CHARS
from canopyframe.operators.ordered import ordinal
from canopyframe.session import cut

#: Rows of a span that is parsed at once, and spans combined at once.
SPAN, FAN = 256, 64

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1

#: Where a role's initial leads from each point, and the points a conversation may end at.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)

Cells = dict[tuple[int, int], tuple[int, str]]


def best(cells: Cells, at: tuple[int, int], cell: tuple[int, str]) -> None:
    if at not in cells or cell < cells[at]:
        cells[at] = cell


def combined(left: Cells, right: Cells) -> Cells:
    """Cells of two neighbouring spans: X(p, q) -> X(p, r) X(r, q)."""
    out: Cells = {}
    for (p, r), (c, a) in left.items():
        for (r2, q), (d, b) in right.items():
            if r == r2:
                best(out, (p, q), (c + d, a + b))
    return out


def insertions() -> Cells:
    """The closure of insertions: least cells of fragments without rows."""
    one: Cells = {(p, p): (0, "") for p in range(4)}
    for (p, role), q in STEPS.items():
        if role != "s":
            best(one, (p, q), (INSERT, "I"))
    return combined(one, one)


INSERTED = insertions()


@lru_cache(maxsize=64)
def row_cells(code: str) -> Cells:
    """Cells of one row, insertions before it included.

    ``code`` is the role's initial (s, u, a, else x), upper case if the row is cut off, or d if it
    must be deleted.
    """
    cells: Cells = {(p, p): (DELETE, "D") for p in range(4)}
    if code != "d":
        more = CUT_OFF if code.isupper() else 0
        for (p, role), q in STEPS.items():
            if role == code.lower():
                best(cells, (p, q), (KEEP + more, "K"))
            if role != "s":
                best(cells, (p, q), (REROLE + more, "R"))
    return combined(INSERTED, cells)


@lru_cache(maxsize=50_000)
def parse(codes: str) -> Cells:
    """Cells of a span of rows, combined bottom-up by span length."""
    spans = [row_cells(c) for c in codes]
    while len(spans) > 1:
        spans = [combined(*spans[i : i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
    return spans[0]


def edits(audit: str, p: int, codes: str) -> list[str]:
    """What happens to each row of a span entered at point ``p``.

    A row's word has the initials of the turns inserted before it, then K, D, or R with the initial
    of its new role. ``codes`` are the span's rows as for ``row_cells``.
    """
    out: list[str] = []
    word = ""
    for letter in audit:
        role = "a" if p == 2 else "u"
        if letter == "I":
            word += role
        else:
            if letter == "K":
                role = codes[len(out)].lower()
            out.append(word + (letter + role if letter == "R" else letter))
            word = ""
        if letter != "D":
            p = STEPS[p, role]
    return out


_CELLS = "array<struct<p:int,q:int,cost:bigint,audit:string,path:string>>"
_SPAN = f"key string, span bigint, illegal bigint, first string, last string, codes string, cells {_CELLS}"
_NAMES = ["key", "span", "illegal", "first", "last", "codes", "cells"]
_ARROW = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("path", pa.string())]))
_LEGAL = ("su", "ua", "au")


def _leaves(rows: DataFrame) -> DataFrame:
    """Parsed spans of at most ``SPAN`` rows each."""
    row = F.struct("n", "code", "kind")
    spans = rows.groupBy("key", "span").agg(F.array_sort(F.collect_list(row)).alias("rows")).select(
        "key", "span", F.array_join(F.transform("rows", lambda r: r["code"]), "").alias("codes"), F.array_join(F.transform("rows", lambda r: r["kind"]), "").alias("kinds"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                codes, kinds = part.column(2).to_pylist(), part.column(3).to_pylist()
                cells = [[{"p": p, "q": q, "cost": c, "audit": a, "path": ""} for (p, q), (c, a) in parse(x).items()] for x in codes]
                illegal = [sum(k[i : i + 2] not in _LEGAL for i in range(len(k) - 1)) for k in kinds]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(illegal, pa.int64()), pa.array([k[0] for k in kinds]), pa.array([k[-1] for k in kinds]),
                    part.column(2), pa.array(cells, _ARROW)], _NAMES)

    return spans.mapInArrow(run, _SPAN)


def _parents(spans: DataFrame) -> DataFrame:
    """Up to ``FAN`` neighbouring spans combined; a cell's path names the points between them."""
    one = F.struct("span", "illegal", "first", "last", "cells")
    groups = spans.groupBy("key", F.floor(F.col("span") / FAN).cast("bigint").alias("up")).agg(F.array_sort(F.collect_list(one)).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                parts = b.column(2)[i].as_py()
                illegal = sum(x["illegal"] for x in parts) + sum(x["last"] + y["first"] not in _LEGAL for x, y in zip(parts, parts[1:]))
                found = {(c["p"], c["q"]): (c["cost"], c["audit"], f"{c['p']}{c['q']}") for c in parts[0]["cells"]}
                for x in parts[1:]:
                    step: dict = {}
                    for (p, r), (cost, audit, path) in found.items():
                        for c in x["cells"]:
                            if c["p"] == r:
                                new = (cost + c["cost"], audit + c["audit"], path + str(c["q"]))
                                if (p, c["q"]) not in step or new < step[p, c["q"]]:
                                    step[p, c["q"]] = new
                    found = step
                cells = [{"p": p, "q": q, "cost": c, "audit": a, "path": w} for (p, q), (c, a, w) in found.items()]
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([illegal], pa.int64()), pa.array([parts[0]["first"]]), pa.array([parts[-1]["last"]]),
                    pa.array([""]), pa.array([cells], _ARROW)], _NAMES)

    return groups.mapInArrow(run, _SPAN)


def _chosen(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """(key, span, p, audit, codes) of the spans of the lowest level, from the conversations' (key, q)."""
    at = top.select("key", F.lit(0).cast("bigint").alias("span"), F.lit(0).alias("p"), "q")
    for spans in levels[:0:-1]:
        here = at.join(spans.select("key", "span", "cells"), ["key", "span"])
        cell = F.filter("cells", lambda c: (c["p"] == F.col("p")) & (c["q"] == F.col("q")))[0]
        path = here.select("key", "span", cell["path"].alias("path")).withColumn("i", F.explode(F.sequence(F.lit(1), F.length("path") - 1)))
        at = path.select("key", (F.col("span") * FAN + F.col("i") - 1).alias("span"), F.substring("path", F.col("i"), F.lit(1)).cast("int").alias("p"),
                         F.substring("path", F.col("i") + 1, F.lit(1)).cast("int").alias("q"))
    cell = F.filter("cells", lambda c: (c["p"] == F.col("p")) & (c["q"] == F.col("q")))[0]
    return at.join(levels[0].select("key", "span", "codes", "cells"), ["key", "span"]).select("key", "span", "p", cell["audit"].alias("audit"), "codes")


@F.pandas_udf(ArrayType(StringType()))
def _words(audit: pd.Series, p: pd.Series, codes: pd.Series) -> pd.Series:
    return pd.Series([edits(*row) for row in zip(audit, p, codes)])


def _rows_of(role: Column, text: Column) -> tuple[Column, Column, Column]:
    """(blank, truncated, initial s, u, a or x) of a row."""
    bare = F.rtrim(text, F.lit(SPACE_CHARS))
    blank = bare == ""
    first = F.substring(role, 1, 1)
    return blank, ~F.substring(bare, -1, 1).isin(".", "!", "?"), F.when(first.isin("s", "u", "a"), first).otherwise("x")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports, repaired turns) of the conversations of (conv_id, turn, role, text).

    Reports: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. Repaired turns: conv_id,
    at (their order), edit (K, R or I), role, text. Conversations without rows are in neither.
    """
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    kind = turns.schema["conv_id"].dataType
    whole = turns.select(F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n")).alias("key"),
                         F.col("turn").isNotNull().alias("has"), F.coalesce(F.col("turn").cast("bigint"), F.lit(0)).alias("turn"),
                         role.alias("role"), F.unhex(F.sha2(text, 256)).alias("sig"), text.alias("text"))
    blank, truncated, initial = _rows_of(F.col("role"), F.col("text"))
    slim = whole.select("key", "has", "turn", "role", "sig", blank.alias("blank"), truncated.alias("open"), initial.alias("kind"))
    same = ["key", "role", "sig"]
    flags = [F.first(c).alias(c) for c in ("blank", "open", "kind")]
    equal = slim.groupBy("key", "has", "turn", "role", "sig").agg(F.count(F.lit(1)).alias("m"), *flags)
    # The first of the rows of equal role and text is found by aggregation and put beside the counts: no join on a hot text.
    first = slim.groupBy(*same).agg(F.min(F.struct("has", "turn")).alias("at"), *flags).select(
        "key", "at.has", "at.turn", "role", "sig", F.lit(0).cast("bigint").alias("m"), "blank", "open", "kind", F.lit(1).alias("first"))
    rows = equal.withColumn("first", F.lit(0)).unionByName(first).groupBy("key", "has", "turn", "role", "sig").agg(
        F.sum("m").alias("m"), F.max("first").alias("first"), *flags)
    rows = cut(rows)
    faults = rows.groupBy("key").agg(
        F.sum(F.when(F.col("blank"), F.col("m")).otherwise(0)).alias("blank"),
        F.sum(F.when(~F.col("blank"), F.col("m") - F.col("first")).otherwise(0)).alias("duplicate"),
        F.sum(F.when(~F.col("blank") & F.col("open"), F.col("first")).otherwise(0)).cast("bigint").alias("truncated"))
    seen = rows.filter("has").groupBy("key", "turn").agg(F.lit(1)).groupBy("key").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("m")))).withColumn(
        "code", F.when(F.col("blank") | (F.col("first") == 0) | (F.col("copy") > 1), "d").when(F.col("open"), F.upper("kind")).otherwise(F.col("kind")))
    numbered = ordinal(copies.select("key", "has", "turn", "role", "sig", "copy", "code", "kind"), ["key"], ["has", "turn", "role", "sig", "copy"], "n")
    numbered = cut(numbered.withColumn("span", F.floor((F.col("n") - 1) / SPAN).cast("bigint")))

    levels = [cut(_leaves(numbered))]
    while (levels[-1].agg(F.max("span")).first()[0] or 0) > 0:
        levels.append(cut(_parents(levels[-1])))
    # Insertions after the last row close the parse.
    ends = {q: min(INSERTED[q, e] for e in ENDS if (q, e) in INSERTED) for q in range(4)}
    tail = F.array(*[F.struct(F.lit(ends[q][0]).alias("cost"), F.lit(ends[q][1]).alias("audit")) for q in range(4)])
    finals = F.transform(F.filter("cells", lambda c: c["p"] == 0), lambda c: F.struct(
        (c["cost"] + tail[c["q"]]["cost"]).alias("cost"), F.concat(c["audit"], tail[c["q"]]["audit"]).alias("audit"), c["q"].alias("q")))
    top = cut(levels[-1].select("key", "illegal", F.array_min(finals).alias("cell")).select("key", "illegal", "cell.*"))
    plain = F.when(F.col("key") != "n", F.expr("substring(key, 2)")).cast(kind)
    reports = top.join(faults, "key").join(seen, "key", "left").select(
        plain.alias("conv_id"), F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("cost").cast("bigint"), "audit")

    words = cut(_chosen(levels, top).select("key", "span", _words("audit", "p", "codes").alias("words")))
    edited = numbered.join(words, ["key", "span"]).withColumn("word", F.expr(f"words[int((n - 1) % {SPAN})]"))
    edited = edited.select("key", "n", "has", "turn", "role", "sig", F.regexp_extract("word", "^[ua]*", 0).alias("before"),
                           F.regexp_extract("word", "([KDR])", 1).alias("edit"), F.regexp_extract("word", "R([ua])", 1).alias("new"))
    named = F.when(F.col("role") == "u", "user").otherwise("assistant")
    # Kept rows are the only ones of their role and text in a conversation.
    texts = whole.groupBy("key", "has", "turn", "role", "sig").agg(F.first("text").alias("text"))
    kept = edited.filter("edit != 'D'").join(texts, ["key", "has", "turn", "role", "sig"]).select(
        "key", (F.col("n") * 4 + 3).alias("at"), "edit", F.when(F.col("edit") == "K", F.col("role")).when(F.col("new") == "u", "user").otherwise("assistant").alias("role"), "text")
    last = numbered.groupBy("key").agg(F.max("n").alias("n"))
    closing = top.join(last, "key").select("key", (F.col("n") + 1).alias("n"), F.when(F.col("q") == 1, "ua").when(F.col("q") == 2, "a").otherwise("").alias("before"))
    inserted = edited.select("key", "n", "before").unionByName(closing).filter("before != ''").select(
        "key", "n", F.posexplode(F.split("before", "")).alias("j", "role")).filter("role != ''").select(
        "key", (F.col("n") * 4 + F.col("j")).alias("at"), F.lit("I").alias("edit"), named.alias("role"), F.lit("").alias("text"))
    return reports, kept.unionByName(inserted).select(plain.alias("conv_id"), "at", "edit", "role", "text")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults planted by a checksum of conversation and turn; NULLs become one space."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.filter("fate != 0").select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "fate")
    return rows.withColumn("copy", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("fate", "copy")
