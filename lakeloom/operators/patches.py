"""Applying unified diffs: hunks as rows, merged with their file in one ordered pass."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

HEADER = r"^@@ -([0-9]+)(,0+(?= ))?(?:,[0-9]+)? \+[0-9]+(?:,[0-9]+)? @@"
PATCHED = "path string, text string, applied boolean, hunks int, added int, removed int, error string"


def hunk_lines(diffs: DataFrame) -> DataFrame:
    """``path, hunk, pos, start, line`` of diffs ``path, diff``: each line with its hunk's number (from 1) and the first old line the hunk speaks of.
    A hunk of no old lines goes behind the line it names.

    What precedes the first hunk, and notes on a missing last newline, are left out. ``line`` is null for a hunk's own header, and
    ``start`` if the header is none.
    """
    rows = diffs.select("path", F.posexplode(F.split(F.coalesce("diff", F.lit("")), "\r?\n")).alias("pos", "line"))
    header = F.col("line").startswith("@@")
    order = Window.partitionBy("path").orderBy("pos")
    rows = rows.where(~F.col("line").startswith("\\")).withColumn("hunk", F.sum(header.cast("int")).over(order).cast("int")).where("hunk > 0")
    start = F.when(header, F.regexp_extract("line", HEADER, 1).try_cast("int") + (F.regexp_extract("line", HEADER, 2) != "").cast("int"))
    rows = rows.withColumn("start", F.max(start).over(Window.partitionBy("path", "hunk")))
    return rows.select("path", "hunk", "pos", "start", F.when(~header, F.col("line")).alias("line"))


def merged(lines: list[str], hunks: list[tuple[int, int | None, list[str]]]) -> list[str]:
    """The lines with the hunks (number, first line, lines) applied; a hunk that does not fit is a ValueError."""
    out: list[str] = []
    at = 0
    for number, start, body in hunks:
        if start is None:
            raise ValueError(f"hunk {number}: bad header")
        first = max(start - 1, 0)
        if first < at:
            raise ValueError(f"hunk {number} overlaps the one before at line {first + 1}")
        if first > len(lines):
            raise ValueError(f"hunk {number} starts beyond the end at line {first + 1}")
        out += lines[at:first]
        at = first
        for line in body:
            sign, text = (line[0], line[1:]) if line else (" ", "")
            if sign not in " +-":
                raise ValueError(f"hunk {number}: bad prefix {sign}")
            if sign == "+":
                out.append(text)
                continue
            if at >= len(lines):
                raise ValueError(f"hunk {number}: the file ends before line {at + 1}")
            if lines[at] != text:
                raise ValueError(f"hunk {number}: line {at + 1} differs")
            if sign == " ":
                out.append(text)
            at += 1
    return out + lines[at:]


def apply_patches(files: DataFrame, diffs: DataFrame) -> DataFrame:
    """``path, text, applied, hunks, added, removed, error`` of every path in ``files`` (``path, text``) or ``diffs`` (``path, diff``).

    Files and hunks of a path meet in one task; nothing else does. A diff without its file makes a new one; a file without hunks stays as it is.
    A diff that does not fit changes nothing and says why in ``error``, as do two files or diffs of one path. Lines end with ``\\n``; a file
    keeps whether its last line does.
    """
    ones = diffs.groupBy("path").agg(F.count("*").alias("n"), F.first("diff").alias("diff"))
    hunks = hunk_lines(ones.where("n = 1"))
    twice = ones.where("n > 1").select("path", F.lit(0).alias("hunk"), F.lit(0).alias("pos"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("string").alias("line"))
    names = [c.split()[0] for c in PATCHED.split(", ")]

    def patch(old: pa.Table, new: pa.Table) -> pa.Table:
        path = (old if old.num_rows else new).column("path")[0].as_py()
        text = old.column("text")[0].as_py() or "" if old.num_rows else ""
        rows = sorted(new.select(["hunk", "pos", "start", "line"]).to_pylist(), key=lambda r: (r["hunk"], r["pos"]))
        found: dict[int, tuple[int, int | None, list[str]]] = {}
        for r in rows:
            body = found.setdefault(r["hunk"], (r["hunk"], r["start"], []))[2]
            if r["line"] is not None:
                body.append(r["line"])
        signs = [line[:1] for *_, body in found.values() for line in body]
        error = "several files" if old.num_rows > 1 else "several diffs" if 0 in found else None
        after = text
        if error is None:
            last = "\n" if text.endswith("\n") else ""
            before = text.removesuffix("\n").split("\n") if text else []
            try:
                after = "\n".join(merged(before, list(found.values()))) + last
            except ValueError as e:
                error = str(e)
        row = (path, None if error else after, not error and after != text, len(found), signs.count("+"), signs.count("-"), error)
        kinds = [pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    return files.select("path", "text").groupBy("path").cogroup(hunks.unionByName(twice).groupBy("path")).applyInArrow(patch, PATCHED)
