"""Matrix Market text: banner, sizes, entries to (i, j, v) from 0, and writers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.sources import lines

OBJECTS, FORMATS = ("matrix", "vector"), ("coordinate", "array")
FIELDS, SYMMETRIES = ("real", "complex", "pattern", "integer"), ("general", "symmetric", "hermitian", "skew-symmetric")


@dataclass(frozen=True)
class Banner:
    format: str = "coordinate"
    field: str = "real"
    symmetry: str = "general"

    @property
    def code(self) -> str:
        """Four letters: M, C or A, R C P or I, G S H or K."""
        return "M" + self.format[0].upper() + self.field[0].upper() + {"skew-symmetric": "K"}.get(self.symmetry, self.symmetry[0].upper())

    def line(self) -> str:
        return f"%%MatrixMarket matrix {self.format} {self.field} {self.symmetry}"


def parse_banner(line: str) -> Banner:
    parts = line.lower().split()
    if len(parts) != 5 or parts[0] != "%%matrixmarket" or parts[1] != "matrix":
        raise ValueError(f"no Matrix Market banner: {line[:80]!r}")
    _, _, form, field, symmetry = parts
    if form not in FORMATS or field not in FIELDS or symmetry not in SYMMETRIES:
        raise ValueError(f"unknown kind of matrix: {line[:80]!r}")
    if field == "pattern" and form == "array":
        raise ValueError("a dense pattern matrix has no entries")
    return Banner(form, field, symmetry)


def header(spark: SparkSession, path: str) -> tuple[Banner, tuple[int, ...]]:
    """Banner and sizes (rows, columns and, for coordinate files, entries)."""
    begin = spark.read.text(lines.first_file(spark, path)).select(F.trim("value").alias("line"))
    first = begin.first()
    if first is None:
        raise ValueError("an empty file")
    banner = parse_banner(first[0])
    sizes = begin.where("line not like '\\%%' and line <> ''").first()
    numbers = tuple(map(int, sizes["line"].split()))
    if len(numbers) != (3 if banner.format == "coordinate" else 2):
        raise ValueError(f"bad size line: {sizes['line']!r}")
    return banner, numbers


def read(spark: SparkSession, path: str, expand: bool = True, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Entries (i, j, v) counted from 0. Symmetric kinds are mirrored if ``expand``; a pattern's values are 1; a complex
    matrix keeps its real part. ``fields`` limits what is accepted (loaders differ in what they reject)."""
    banner, sizes = header(spark, path)
    if banner.field not in fields:
        raise ValueError(f"{banner.field} matrices are not accepted here")
    text = lines.placed(spark, path).where("line not like '\\%%' and line <> ''")
    parts = F.split("line", r"\s+")
    if banner.format == "array":
        return _read_array(spark, text, sizes, banner, expand)
    # the size line is the one that equals it and comes first; an entry has 2 to 4 numbers, the size line 3 whole ones
    size_line = " ".join(map(str, sizes))
    with_parts = text.select(parts.alias("p"), F.struct(*lines.PLACE).alias("n"))
    first = with_parts.where(F.array_join("p", " ") == size_line).agg(F.min("n").alias("n")).first()["n"]
    body = with_parts.where(~((F.col("n._file") == first["_file"]) & (F.col("n._block") == first["_block"]) & (F.col("n._n") == first["_n"])))
    value = F.lit(1.0) if banner.field == "pattern" else F.col("p")[2].cast("double")
    entries = body.select((F.col("p")[0].cast("long") - 1).alias("i"), (F.col("p")[1].cast("long") - 1).alias("j"), value.alias("v"))
    return _expanded(entries, banner) if expand else entries


def _expanded(entries: DataFrame, banner: Banner) -> DataFrame:
    if banner.symmetry == "general":
        return entries
    sign = -1.0 if banner.symmetry == "skew-symmetric" else 1.0
    return entries.unionByName(entries.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), (F.col("v") * sign).alias("v")))


def _read_array(spark: SparkSession, text: DataFrame, sizes: tuple[int, ...], banner: Banner, expand: bool) -> DataFrame:
    """Column-major values, one a line; their order is the text's."""
    rows, cols = sizes
    placed = lines.numbered(text).where("at > 0").select((F.col("at") - 1).alias("k"), F.split("line", r"\s+")[0].cast("double").alias("v"))
    if banner.symmetry == "general":
        return placed.select((F.col("k") % rows).alias("i"), F.floor(F.col("k") / rows).alias("j"), "v")
    # the lower triangle only: column j starts at j * rows - j (j - 1) / 2 (one later each time without a diagonal); the
    # root of that is the column, give or take one for rounding
    skew = int(banner.symmetry == "skew-symmetric")
    start = lambda j: j * (rows - skew) - F.floor(j * (j - 1) / 2)
    wide = 2.0 * (rows - skew) + 1.0
    root = F.floor((wide - F.sqrt(F.greatest(F.lit(wide * wide) - 8.0 * F.col("k"), F.lit(0.0)))) / 2.0).cast("long")
    near = placed.withColumn("j", root).withColumn("j", F.when(start(F.col("j")) > F.col("k"), F.col("j") - 1).when(start(F.col("j") + 1) <= F.col("k"), F.col("j") + 1).otherwise(F.col("j")))
    entries = near.select((F.col("k") - start(F.col("j")) + F.col("j") + skew).cast("long").alias("i"), "j", "v")
    return _expanded(entries, banner) if expand else entries


def write(a: DataFrame, path: str, rows: int, cols: int, banner: Banner | None = None) -> None:
    """Text files that follow each other by name, together what the format asks: banner, sizes, and by row and column the entries counted from 1 or, for the array format, all
    values down the columns (no entry is 0). Of a symmetric kind the lower triangle is written (without the diagonal if skew)."""
    banner = banner or Banner()
    spark = a.sparkSession
    if banner.symmetry != "general":
        a = a.where("i > j" if banner.symmetry == "skew-symmetric" else "i >= j")
    number = F.col("v").cast("long").cast("string") if banner.field == "integer" else F.col("v").cast("string")
    if banner.field == "complex":
        number = F.concat(number, F.lit(" 0.0"))
    if banner.format == "array":
        every = spark.range(rows * cols).select((F.col("id") % rows).alias("i"), F.floor(F.col("id") / rows).alias("j"))
        if banner.symmetry != "general":
            every = every.where("i > j" if banner.symmetry == "skew-symmetric" else "i >= j")
        cells = every.join(a.groupBy("i", "j").agg(F.sum("v").alias("v")), ["i", "j"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
        sizes, body = f"{rows} {cols}", cells.select(F.col("j").alias("x"), F.col("i").alias("y"), number.alias("value"))
    else:
        text = F.concat_ws(" ", (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"), *([] if banner.field == "pattern" else [number]))
        sizes, body = f"{rows} {cols} {a.count()}", a.select(F.col("i").alias("x"), F.col("j").alias("y"), text.alias("value"))
    lines.write([banner.line(), sizes], body, ["x", "y"], path)
