"""Functions and variables defined at the left margin of Python and Scala cells."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_body
from .cells import cells

# Fixed values.
PY_DEF, PY_SET = re.compile(r"^def\s+(\w+)\s*\("), re.compile(r"^(\w+)\s*=\s*(?!=)(.+)$")
_SIGNATURE = r"^def\s+(\w+)\s*\([^)]*\)(?:\s*:\s*[\w\[\],\s.]+)?\s*=\s*"
SCALA_BLOCK, SCALA_LINE = re.compile(_SIGNATURE + r"\{", re.M), re.compile(_SIGNATURE + r"(.+)$", re.M)
SCALA_VALUE = re.compile(r"^(?:val|var)\s+(\w+)\s*(?::\s*[\w\[\],\s.]+)?=\s*(.+)$", re.M)
SCHEMA = "array<struct<name:string,kind:string,raw:string>>"


def python_defs(source: str) -> list[tuple[str, str, str]]:
    """(name, kind, text): a function with its indented and blank lines, a variable with its first line."""
    out: list[tuple[str, str, str]] = []
    open_def: list[str] | None = None
    name = ""

    def close() -> None:
        if open_def is not None:
            out.append((name, "function", "\n".join(open_def)))

    for line in source.split("\n"):
        if open_def is not None and (not line.strip() or line[0] in " \t"):
            open_def.append(line)
            continue
        close()
        open_def = None
        if m := PY_DEF.match(line):
            name, open_def = m[1], [line]
        elif m := PY_SET.match(line):
            out.append((m[1], "variable", line))
    close()
    return out


def scala_defs(source: str) -> list[tuple[str, str, str]]:
    """Functions with a block, then one-line functions, then values; of what is inside a block only further blocks.

    One walk over the starts of lines; a block that nothing closes goes to the end.
    """
    finds: list[tuple[int, int, tuple[str, str, str]]] = []
    inside, taken, at = -1, [0, 0, 0], 0  # the last place of a block so far; how far each pattern has read
    while at < len(source):
        if at >= taken[0] and (m := SCALA_BLOCK.match(source, at)):
            taken[0] = end = m.end()
            depth = 1
            while depth and end < len(source):
                depth += (source[end] == "{") - (source[end] == "}")
                end += 1
            finds.append((0, at, (m[1], "function", source[at:end])))
            inside = max(inside, end - 1)
        for rank, kind, pattern in ((1, "function", SCALA_LINE), (2, "variable", SCALA_VALUE)):
            if at > inside and at >= taken[rank] and (m := pattern.match(source, at)):
                taken[rank] = m.end()
                finds.append((rank, at, (m[1], kind, m[0])))
        at = source.find("\n", at) + 1 or len(source)
    return [found for _, _, found in sorted(finds)]


def code_defs(notebooks: DataFrame) -> DataFrame:
    """(nb_ord, path, cell_index, def_idx, name, kind, normal, raw). The scanner runs on Arrow batches."""
    rows = cells(notebooks).where(F.col("language").isin("python", "scala"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanners = {"python": python_defs, "scala": scala_defs}
        for b in batches:
            found = [
                (r.nb_ord, r.path, r.cell_index, i, *d, "#" if r.language == "python" else "//") for r in b.itertuples() for i, d in enumerate(scanners[r.language](r.source))
            ]
            yield pd.DataFrame(found, columns=["nb_ord", "path", "cell_index", "def_idx", "name", "kind", "raw", "mark"])

    shape = "nb_ord int, path string, cell_index int, def_idx int, name string, kind string, raw string, mark string"
    return rows.mapInPandas(scan, shape).select("nb_ord", "path", "cell_index", "def_idx", "name", "kind", normal_body(F.col("raw"), F.col("mark")).alias("normal"), "raw")
