"""Text of documents, slides, sheets and notebooks, read from their files in parallel.

Files are discovered recursively by Spark's binary source; each is opened where it was read. One row per paragraph, slide, cell
or notebook output. A file that cannot be opened gives one row with its error, so nothing is lost silently.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path, modificationTime, length, content of all files below ``root`` whose names fit the pattern."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _texts(node: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x.tag) == "t")


def docx_rows(data: bytes) -> Iterator[tuple[int, str, str]]:
    """Paragraphs with text, then the tables' rows with their cells joined by ' | '."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(iter(ElementTree.fromstring(z.read("word/document.xml"))))
    n = 0
    for child in body:
        if _local(child.tag) == "p" and (text := _texts(child).strip()):
            yield (n := n + 1), "paragraph", text
    for child in body:
        if _local(child.tag) == "tbl":
            for row in (x for x in child.iter() if _local(x.tag) == "tr"):
                yield (n := n + 1), "table_row", " | ".join(_texts(cell).strip() for cell in row if _local(cell.tag) == "tc")


def pptx_rows(data: bytes) -> Iterator[tuple[int, str, str]]:
    """The texts of each slide, slides in the order of their numbers."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((int(m[1]), m[0]) for name in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", name)))
        for number, name in slides:
            found = [x.text for x in ElementTree.fromstring(z.read(name)).iter() if _local(x.tag) == "t" and x.text]
            if found:
                yield number, "slide", "\n".join(found)


_REFERENCE = re.compile(r"\"[^\"]*\"|'[^']*'|(?<![A-Za-z0-9_.])(\$?)([A-Z]{1,3})(\$?)(\d+)(?![A-Za-z0-9_(])")


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def _letters(column: int) -> str:
    out = ""
    while column > 0:
        column, rest = divmod(column - 1, 26)
        out = chr(65 + rest) + out
    return out


def shifted(formula: str, columns: int, rows: int) -> str:
    """A formula as it reads so many columns and rows further on: references without $ move, those that leave the sheet are #REF!."""

    def move(m: re.Match) -> str:
        if m[2] is None:
            return m[0]
        column, row = _column(m[2]) + (0 if m[1] else columns), int(m[4]) + (0 if m[3] else rows)
        return f"{m[1]}{_letters(column)}{m[3]}{row}" if column > 0 and row > 0 else "#REF!"

    return _REFERENCE.sub(move, formula)


def xlsx_rows(data: bytes) -> Iterator[tuple[str, str, str | None, str | None]]:
    """Sheet, cell, formula and cached value of each cell that has one. Cells that share a formula get it as it reads for them."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = ["".join(_texts(s)) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(s.tag) == "si"] if "xl/sharedStrings.xml" in z.namelist() else []
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in (x for x in book.iter() if _local(x.tag) == "sheet"):
            sharing: dict[str, tuple[str, int, int]] = {}
            target = links[next(v for k, v in sheet.attrib.items() if _local(k) == "id")].lstrip("/")
            for cell in (x for x in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter() if _local(x.tag) == "c"):
                parts = {_local(x.tag): x for x in cell}
                value = parts["v"].text if "v" in parts else _texts(parts["is"]) if "is" in parts else None
                if value is not None and cell.get("t") == "s":
                    value = shared[int(value)]
                formula = None
                if "f" in parts:
                    written, group = parts["f"].text or "", parts["f"].get("si") if parts["f"].get("t") == "shared" else None
                    if group is not None:
                        at = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r"))
                        here = (_column(at[1]), int(at[2]))
                        if written:
                            sharing[group] = (written, *here)
                        elif group in sharing:
                            first, column, row = sharing[group]
                            written = shifted(first, here[0] - column, here[1] - row)
                    formula = "=" + written
                if value is not None or formula is not None:
                    yield sheet.get("name"), cell.get("r"), formula, value


def _mapped(reader: Callable, columns: list[str], empty: tuple) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows = [(path, *row, None) for row in reader(bytes(content))]
                except Exception as error:  # one broken file must not end the job
                    rows = [(path, *empty, f"{type(error).__name__}: {error}")]
                if rows:
                    yield pd.DataFrame(rows, columns=["path", *columns, "error"])

    return read


def read_docx(spark: SparkSession, root: str) -> DataFrame:
    """path, part, kind ('paragraph' or 'table_row'), text, error."""
    return files(spark, root, "*.docx").select("path", "content").mapInPandas(_mapped(docx_rows, ["part", "kind", "text"], (None, None, None)), "path string, part int, kind string, text string, error string")


def read_pptx(spark: SparkSession, root: str) -> DataFrame:
    """path, part (the slide's number), kind, text, error."""
    return files(spark, root, "*.pptx").select("path", "content").mapInPandas(_mapped(pptx_rows, ["part", "kind", "text"], (None, None, None)), "path string, part int, kind string, text string, error string")


def read_xlsx(spark: SparkSession, root: str) -> DataFrame:
    """path, sheet, cell, formula, value, error."""
    return files(spark, root, "*.xlsx").select("path", "content").mapInPandas(_mapped(xlsx_rows, ["sheet", "cell", "formula", "value"], (None, None, None, None)), "path string, sheet string, cell string, formula string, value string, error string")


def sheet_size(cells: DataFrame) -> DataFrame:
    """path, sheet, max_row, max_column of the cells of ``read_xlsx``."""
    letters = F.split(F.regexp_extract("cell", "^([A-Z]+)", 1), "")
    column = F.aggregate(letters, F.lit(0), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 64))
    return cells.where("error is null").groupBy("path", "sheet").agg(F.max(F.regexp_extract("cell", r"(\d+)$", 1).cast("int")).alias("max_row"), F.max(column).alias("max_column"))


def first_cells(cells: DataFrame, n: int = 12) -> DataFrame:
    """path, sheet, row, cells of ``read_xlsx``: of each row of a sheet the first ``n`` cells that hold something, as 'A1=value' texts."""
    letters = F.regexp_extract("cell", "^([A-Z]+)", 1)
    held = cells.where("error is null").select("path", "sheet", F.regexp_extract("cell", r"(\d+)$", 1).cast("int").alias("row"), F.struct(F.length(letters).alias("w"), letters.alias("l"), F.concat_ws("=", "cell", F.coalesce("value", "formula")).alias("t")).alias("c"))
    return held.groupBy("path", "sheet", "row").agg(F.transform(F.slice(F.array_sort(F.collect_list("c")), 1, n), lambda c: c["t"]).alias("cells"))


NOTEBOOK = "cells array<struct<cell_type:string, source:variant, outputs:array<struct<output_type:string, text:variant, data:map<string,variant>>>>>"


def notebook_cells(df: DataFrame, path: str, text: str) -> DataFrame:
    """path, cell, kind ('MARKDOWN', 'CODE', 'OUTPUT'), text of notebooks given as JSON texts, by built-in functions."""
    lines = lambda v: F.coalesce(F.array_join(F.try_variant_get(v, "$", "array<string>"), ""), F.try_variant_get(v, "$", "string"))
    parsed = df.select(F.col(path).alias("path"), F.posexplode(F.from_json(F.col(text), NOTEBOOK)["cells"]).alias("cell", "_c"))
    source = F.struct(F.upper(F.coalesce("_c.cell_type", F.lit(""))).alias("kind"), lines(F.col("_c.source")).alias("text"))
    outputs = F.transform(F.coalesce("_c.outputs", F.array()), lambda o: F.struct(F.lit("OUTPUT").alias("kind"), F.coalesce(F.nullif(lines(o["text"]), F.lit("")), lines(o["data"]["text/plain"])).alias("text")))
    return parsed.select("path", (F.col("cell") + 1).alias("cell"), F.inline(F.concat(F.array(source), outputs))).where(F.length(F.trim("text")) > 0)


def read_notebooks(spark: SparkSession, root: str) -> DataFrame:
    whole = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.ipynb").text(root)
    return notebook_cells(whole.select(F.col("_metadata.file_path").alias("path"), "value"), "path", "value")
