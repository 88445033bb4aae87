"""Binary scans: kinds and sizes of images and PDF pages from their bytes, with typed errors."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Paper sizes in millimetres, short side first; and limits of a scan.
SHEETS = [("A0", 841, 1189), ("A1", 594, 841), ("A2", 420, 594), ("A3", 297, 420), ("A4", 210, 297), ("LETTER", 216, 279), ("LEGAL", 216, 356), ("TABLOID", 279, 432)]
LEAST_SIDE, MOST_PIXELS, LEAST_DPI, MOST_DPI = 100, 200_000_000, 72, 300


def _number(content: Column, at: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(content, at + 1, size)), 16, 10).cast("long")


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, width, height and error of every file. Sizes of PNG, GIF and BMP come from their headers."""
    c = F.col("content")
    head = F.hex(F.substring(c, 1, 8))
    kind = F.when(head == "89504E470D0A1A0A", "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("47494638"), "gif").when(head.startswith("424D"), "bmp").when(head.startswith("25504446"), "pdf")
    little = lambda at: _number(c, at, 1) + _number(c, at + 1, 1) * 256
    width = F.when(F.col("kind") == "png", _number(c, 16, 4)).when(F.col("kind") == "gif", little(6)).when(F.col("kind") == "bmp", little(18))
    height = F.when(F.col("kind") == "png", _number(c, 20, 4)).when(F.col("kind") == "gif", little(8)).when(F.col("kind") == "bmp", little(22))
    rows = spark.read.format("binaryFile").load(path).select("path", "length", kind.alias("kind"), c).select("path", "kind", width.alias("width"), height.alias("height"))
    error = (
        F.when(F.col("kind").isNull(), "unknown").when(F.least("width", "height") < LEAST_SIDE, "too_small").when(F.col("width") * F.col("height") > MOST_PIXELS, "too_large")
    )
    return rows.withColumn("error", error)


def sheet_name(width_mm: Column, height_mm: Column, tolerance: float = 0.03) -> Column:
    """The named sheet nearest to a size within the tolerance, either way up; else null."""
    short, long = F.least(width_mm, height_mm), F.greatest(width_mm, height_mm)
    off = lambda a, b: F.greatest(F.abs(short - a) / a, F.abs(long - b) / b)
    fits = F.array_compact(F.array(*[F.when(off(a, b) <= tolerance, F.struct(off(a, b).alias("off"), F.lit(n).alias("name"))) for n, a, b in SHEETS]))
    return F.array_min(fits)["name"]


def planned_dpi(width_pt: Column, height_pt: Column, target: Column, most_pixels: int = 25_000_000) -> Column:
    """The target held to 72 to 300, and lower where the page would exceed the pixels."""
    cap = F.sqrt(F.lit(float(most_pixels)) / (width_pt / 72 * height_pt / 72))
    return F.floor(F.least(F.greatest(target, F.lit(LEAST_DPI)), F.lit(MOST_DPI), cap))


_PAGE = re.compile(rb"/Type\s*/Page(?![a-zA-Z])")
_BOX = re.compile(rb"/MediaBox\s*\[\s*([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)")
_TURN = re.compile(rb"/Rotate\s+(-?\d+)")


def pdf_pages(files: DataFrame) -> DataFrame:
    """One row for each page of (path, content): page, width_pt, height_pt, rotation; or one row with an error.

    Reads page objects that stand plainly in the file; pages inside compressed object streams are not seen and give
    ``no_pages``.
    """

    def pages(path: str, content: bytes) -> list[dict]:
        if not content.startswith(b"%PDF"):
            return [{"path": path, "error": "not_pdf"}]
        if b"/Encrypt" in content:
            return [{"path": path, "error": "encrypted"}]
        out = []
        for block in re.split(rb"\bendobj\b", content):
            if _PAGE.search(block):
                box, turn = _BOX.search(block) or _BOX.search(content), _TURN.search(block)
                if not box:
                    return [{"path": path, "error": "corrupt"}]
                a, b, c, d = map(float, box.groups())
                out.append({"path": path, "page": len(out) + 1, "width_pt": abs(c - a), "height_pt": abs(d - b), "rotation": int(turn[1]) % 360 if turn else 0})
        return out or [{"path": path, "error": "no_pages"}]

    schema = pa.schema([("path", pa.string()), ("page", pa.int32()), ("width_pt", pa.float64()), ("height_pt", pa.float64()), ("rotation", pa.int32()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist(pages(path, content or b""), schema=schema)

    return files.select("path", "content").mapInArrow(run, "path string, page int, width_pt double, height_pt double, rotation int, error string")


def page_list(text: Column, pages: Column) -> Column:
    """ "3, 4, 7-9" as distinct page numbers in the order they are first named, within 1 to pages."""
    parts = F.split(F.regexp_replace(text, r"\s", ""), ",")
    low = lambda p: F.regexp_extract(p, r"^(\d{1,6})(?:-(\d{1,6}))?$", 1).try_cast("int")
    high = lambda p: F.coalesce(F.regexp_extract(p, r"^(\d{1,6})-(\d{1,6})$", 2).try_cast("int"), low(p))
    spans = F.transform(F.filter(parts, lambda p: low(p).isNotNull() & (high(p) >= low(p))), lambda p: F.sequence(low(p), F.least(high(p), F.greatest(pages, low(p)))))
    return F.array_distinct(F.filter(F.flatten(spans), lambda n: (n >= 1) & (n <= pages)))


def path_segments(rows: DataFrame, key: str, path: str) -> DataFrame:
    """Straight and curved pieces of SVG path data with M, L, C and Z: key, n, kind, x0, y0, x1, y1."""
    steps = F.regexp_extract_all(F.col(path), F.lit(r"([MLCZ])([^MLCZ]*)"), 0)
    last = r"(-?[\d.]+)[ ,]+(-?[\d.]+)\s*$"
    parts = rows.select(key, F.posexplode(steps).alias("n", "s")).select(
        key, "n", F.substring("s", 1, 1).alias("kind"), F.regexp_extract("s", last, 1).try_cast("double").alias("x"), F.regexp_extract("s", last, 2).try_cast("double").alias("y")
    )
    line = Window.partitionBy(key).orderBy("n")
    start = lambda c: F.last(F.when(F.col("kind") == "M", F.col(c)), ignorenulls=True).over(line)
    ended = parts.withColumns({"ex": F.when(F.col("kind") == "Z", start("x")).otherwise(F.col("x")), "ey": F.when(F.col("kind") == "Z", start("y")).otherwise(F.col("y"))})
    moved = ended.withColumns({"x0": F.lag("ex").over(line), "y0": F.lag("ey").over(line)})
    return moved.where("kind <> 'M'").select(key, "n", F.when(F.col("kind") == "C", "curve").otherwise("line").alias("kind"), "x0", "y0", F.col("ex").alias("x1"), F.col("ey").alias("y1"))
