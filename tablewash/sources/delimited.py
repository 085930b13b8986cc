"""Delimited text in and out, on Spark's own reader and writer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablewash.functions.text import WHITESPACE, WS
from tablewash.operators.table import RID, cell_text, col, data_columns

# Candidates in order of preference, and the size of the sample.
DELIMITERS = (",", "\t", ";", "|")
SAMPLE_LINES = 20
SAMPLE_CHARS = 64 * 1024

_PARTITION_BITS = 33  # of monotonically_increasing_id, below the partition
_FILE_BITS = 42  # of the place in a file, in bytes; the file's rank is above
_QUOTED = r'"[^"]*("|\z)'


def _first_lines(spark: SparkSession, path: str) -> DataFrame:
    """Whole first lines of the first file: ``(n, line)``, at most SAMPLE_LINES."""
    first = spark.read.option("lineSep", "\n").text(first_file(spark, path))
    return first.limit(SAMPLE_LINES).select(
        F.monotonically_increasing_id().alias("n"), F.regexp_replace("value", r"\r\z", "").alias("line")
    )


def _sample(spark: SparkSession, path: str) -> DataFrame:
    """The first lines cut to SAMPLE_CHARS in all, for telling the delimiter."""
    lines = _first_lines(spark, path)
    before = F.sum(F.length("line") + 1).over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    room = F.lit(SAMPLE_CHARS) - F.coalesce(before, F.lit(0))
    return lines.select("n", F.substring("line", F.lit(1), F.greatest(room, F.lit(0)).cast("int")).alias("line"))


def field_count(line: Column, delimiter: str) -> Column:
    """Fields of a line; delimiters between quotes do not count."""
    return F.length(F.regexp_replace(F.regexp_replace(line, _QUOTED, ""), f"[^{_in_class(delimiter)}]", "")) + 1


def _in_class(delimiter: str) -> str:
    return "\\" + delimiter if delimiter in "\\]^-[" else delimiter


def delimiter_scores(spark: SparkSession, path: str) -> DataFrame:
    """How well each candidate cuts the sample into even rows."""
    candidates = F.array(
        *[
            F.struct(F.lit(i).alias("preference"), F.lit(d).alias("delimiter"), field_count(F.col("line"), d).alias("fields"))
            for i, d in enumerate(DELIMITERS)
        ]
    )
    counted = (
        _sample(spark, path)
        .where(F.btrim("line", F.lit(WHITESPACE)) != "")
        .select(F.inline(candidates))
        .groupBy("preference", "delimiter")
        .agg(F.array_sort(F.collect_list("fields")).alias("counts"))
    )
    size = F.size("counts")
    middle = F.get("counts", F.floor(size / 2).cast("int"))
    even = F.size(F.filter("counts", lambda c: c == F.col("middle"))) / size
    return (
        counted.withColumn("middle", middle)
        .where("middle >= 2")
        .select("preference", "delimiter", (even * 10 + F.col("middle") * 0.1).alias("score"))
    )


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    best = delimiter_scores(spark, path).orderBy(F.desc("score"), "preference").first()
    return best["delimiter"] if best else DELIMITERS[0]


def header_names(cells: list[str | None]) -> list[str]:
    """Trimmed names; blank ones are numbered, repeated ones suffixed.

    No two names agree without regard to case, and none is the row order's.
    """
    names: list[str] = []
    taken = {RID}
    for i, cell in enumerate(cells):
        base = (cell or "").lstrip("\ufeff").strip(WHITESPACE) or f"column_{i + 1}"
        name, again = base, 1
        while name.lower() in taken:
            again += 1
            name = f"{base}_{again}"
        taken.add(name.lower())
        names.append(name)
    return names


def _scan(
    spark: SparkSession, path: str, delimiter: str, multi_line: bool, header: bool, width: int, names: list[str] | None = None
) -> DataFrame:
    """The file's cells as ``_c0``, ``_c1``, ...; with ``names`` a file whose header differs from them fails the read."""
    fields = names or [f"_c{i}" for i in range(width)]
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    return (
        spark.read.schema(schema)
        .option("sep", delimiter)
        .option("header", header)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("enforceSchema", names is None)
        .csv(path)
    )


def _cells(width: int) -> list[Column]:
    return [F.nullif(F.col(f"_c{i}"), F.lit("")) for i in range(width)]


def _file_ranks(spark: SparkSession, files: list[str]) -> DataFrame:
    return spark.createDataFrame([(f, i) for i, f in enumerate(sorted(files))], "_path string, _file bigint")


def _in_file_order(scan: DataFrame, files: list[str]) -> DataFrame:
    """Row ids that follow file name, then place in the file.

    A task reads at most as many bytes as lie between the starts of two blocks
    of a file, and a row has a byte at least. So start of the block plus count
    in the task never reaches the next block: no block has to be looked up.
    """
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _PARTITION_BITS) - 1))
    if len(files) < 2:
        return scan.select(F.monotonically_increasing_id().alias(RID), "*")
    place = F.col("_metadata.file_block_start") + inside
    placed = scan.select(place.alias("_place"), F.input_file_name().alias("_path"), "*")
    # One row per file; Spark broadcasts it if its measured size allows.
    ranked = placed.join(_file_ranks(scan.sparkSession, files), "_path")
    return ranked.select(F.shiftleft("_file", _FILE_BITS).bitwiseOR(F.col("_place")).alias(RID), *scan.columns)


def read_delimited(
    spark: SparkSession, path: str, delimiter: str | None = None, multi_line: bool = True, parallel: bool = False
) -> DataFrame:
    """A CSV or TSV as text columns with row ids; empty cells are null.

    A folder is read as files that each carry the header; one with another
    header fails the read (headers with blank or repeated names are not compared).
    ``multi_line=False`` lets Spark split large files that hold no line break
    inside quotes. ``parallel=True`` splits files that do hold them, too, if quotes
    only enclose whole fields and are doubled within: then their number tells
    whether a block of a file begins inside a field.
    """
    delimiter = delimiter or sniff_delimiter(spark, path)
    first = (
        _first_lines(spark, path)
        .select(
            "n",
            F.regexp_replace("line", "\ufeff", "").alias("line"),
            field_count(F.col("line"), delimiter).alias("fields"),
        )
        .orderBy("n")
        .collect()
    )
    width = max((r["fields"] for r in first), default=1)
    raw = _scan(spark, first_file(spark, path), delimiter, multi_line, False, width)
    named = raw.where(F.coalesce(*_cells(width)).isNotNull()).first()
    if named is None:
        raise ValueError("No columns found. Load a CSV or TSV with a header row.")
    # The header is as wide as its line, or as its last filled cell if broken.
    lead = next((r for r in first if r["line"].strip('"' + delimiter + WHITESPACE)), None)
    filled = max(i for i, c in enumerate(named) if c)
    fields = max(lead["fields"] if lead else 0, filled + 1)
    names = header_names(list(named)[:fields])

    # Spark skips blank lines before the header, but not a row of empty cells.
    plain = lead is not None and all(not r["line"].strip(WHITESPACE) for r in first if r["n"] < lead["n"])
    files = _files(spark, path)
    written = [(c or "").lstrip("\ufeff") for c in list(named)[:fields]]
    if parallel:
        header = next((r["line"] for r in first if r["line"].strip(WHITESPACE)), "")
        rows = _parallel_rows(spark, path, files, delimiter, fields, header)
        plain = True
    else:
        # Names that Spark can compare with every file's header: none blank, none twice.
        checked = written if plain and len(files) > 1 and all(written) and len({w.lower() for w in written}) == fields else None
        # The names of helper columns begin so.
        checked = None if any(w.startswith("_") for w in written) else checked
        rows = _in_file_order(_scan(spark, path, delimiter, multi_line, plain, fields, checked), files)
    positions = [F.nullif(col(c), F.lit("")) for c in rows.columns if c != RID]
    cells = rows.select(RID, *[c.alias(f"_c{i}") for i, c in enumerate(positions)])
    kept = cells.where(F.coalesce(*[F.col(f"_c{i}") for i in range(fields)]).isNotNull())
    if not plain:
        kept = kept.where(F.col(RID) > kept.agg(F.min(RID)).scalar())
    return kept.select(RID, *[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)])


def _files(spark: SparkSession, path: str) -> list[str]:
    return sorted(spark.read.text(path).inputFiles() or [path])


def first_file(spark: SparkSession, path: str) -> str:
    return _files(spark, path)[0]


def _assembled(header: str, opened_blocks):
    """Lines of blocks, in order, to records: ``(path, start, at, kind, text)``.

    Kinds: 0 a whole record; 1 lines that end a record begun in an earlier block,
    or lie within it; 2 lines that begin one and do not end it. ``at`` counts lines of the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, inside, joins, held, begun, at, titled = None, False, False, [], 0, 0, True
        opened = opened_blocks.value
        out: list[tuple] = []

        def flush(kind: int) -> None:
            nonlocal titled
            text = "\n".join(held)
            held.clear()
            if not titled and kind != 1 and text.strip(WHITESPACE):
                titled = True
                if text.lstrip("\ufeff") != header.lstrip("\ufeff"):
                    raise ValueError(f"The header of {block[0]} differs from that of the first file.")
                return
            out.append((*block, begun, kind, text))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "start", "at", "kind", "text"]
            )

        for batch in batches:
            for line, path, start, name, turns in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if block != (path, start):
                    if held:  # the block before ends inside a field
                        flush(1 if joins else 2)
                    block, inside, titled = (path, start), name in opened, start > 0
                    joins = inside  # whether what is held continues an earlier block
                if not held:
                    begun = at
                held.append(line[:-1] if line.endswith("\r") else line)
                at += 1
                inside ^= turns
                if not inside:
                    flush(1 if joins else 0)
                    joins = False
            if len(out) >= 4096:
                yield batch_of(out)
                out = []
        if held:
            flush(1 if joins else 2)
        if out:
            yield batch_of(out)

    return run


def _parallel_rows(spark: SparkSession, path: str, files: list[str], delimiter: str, width: int, header: str) -> DataFrame:
    """Records of files in which quotes only enclose fields, read block by block; cells as ``_c0``, ``_c1``, ..."""
    text = spark.read.option("lineSep", "\n").text(path)
    odd = F.pmod(F.length("value") - F.length(F.replace("value", F.lit('"'))), F.lit(2)) == 1
    lines = text.select(
        "value", F.input_file_name().alias("path"), F.col("_metadata.file_block_start").alias("start"), odd.alias("odd")
    )
    # One row per block: how many lines turn the quotes over, and whether the block begins inside them.
    blocks = lines.groupBy("path", "start").agg(F.sum(F.col("odd").cast("bigint")).alias("turns"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    turned = blocks.select("path", "start", (F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2 == 1).alias("opened"))
    # 8 bytes for each block that begins inside quotes: at most 6 MB for 100 TB of text.
    opened = turned.where("opened").select(F.xxhash64("path", "start").alias("h")).toLocalIterator()
    shared = spark.sparkContext.broadcast(frozenset(r["h"] for r in opened))
    asked = lines.select("value", "path", "start", F.xxhash64("path", "start"), "odd")
    parts = asked.mapInArrow(_assembled(header, shared), "path string, start bigint, at bigint, kind int, text string")
    whole = parts.where("kind = 0").select("path", (F.col("start") + F.col("at")).alias("place"), "text")
    # Two at most of a block: what is begun in one block goes on in the next ones.
    order = Window.partitionBy("path").orderBy("start", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = parts.where("kind > 0").withColumn("record", F.sum((F.col("kind") == 2).cast("bigint")).over(order))
    pieces = F.array_sort(F.collect_list(F.struct("start", "at", "text")))
    mended = cut.groupBy("path", "record").agg(pieces.alias("pieces"))
    mended = mended.select(
        "path",
        (F.col("pieces")[0]["start"] + F.col("pieces")[0]["at"]).alias("place"),
        F.array_join(F.transform("pieces", lambda x: x["text"]), "\n").alias("text"),
    )
    records = whole.unionByName(mended)
    if len(files) > 1:
        ranked = records.join(_file_ranks(spark, files), F.col("path") == F.col("_path"))
        records = ranked.select(F.shiftleft("_file", _FILE_BITS).bitwiseOR(F.col("place")).alias("place"), "text")
    schema = ", ".join(f"_c{i} string" for i in range(width))
    options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    return records.select(F.col("place").alias(RID), F.from_csv("text", schema, options).alias("r")).select(RID, "r.*")


def _written(df: DataFrame) -> DataFrame:
    """Cells as the text a file holds."""
    return df.select(RID, *[cell_text(df, c).alias(c) for c in data_columns(df)])


def write_delimited(df: DataFrame, path: str, delimiter: str = ",", mode: str = "overwrite") -> None:
    """CSV parts in row order, each with the header; one range shuffle."""
    (
        _written(df)
        .orderBy(RID)
        .drop(RID)
        .write.mode(mode)
        .option("sep", delimiter)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def csv_cell(text: Column) -> Column:
    """A cell as written: quoted when it holds a comma, quote or line break."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\\r\\n]'), quoted).otherwise(F.coalesce(text, F.lit("")))


def csv_line(df: DataFrame) -> Column:
    return F.concat_ws(",", *[csv_cell(cell_text(df, c)) for c in data_columns(df)])


def export_summary(df: DataFrame, filename: str) -> DataFrame:
    """``(filename, bytes, rows, columns)`` of the table as one CSV text."""
    columns = data_columns(df)
    header = F.octet_length(F.concat_ws(",", *[csv_cell(F.lit(c)) for c in columns]))
    # Every row adds its line and the line break before it.
    body = F.coalesce(F.sum(F.octet_length(csv_line(df)) + 1), F.lit(0))
    return df.agg(body.alias("body"), F.count(F.lit(1)).alias("rows")).select(
        F.lit(filename).alias("filename"),
        (F.col("body") + header).cast("bigint").alias("bytes"),
        "rows",
        F.lit(len(columns)).alias("columns"),
    )
