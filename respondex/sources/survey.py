"""The wide survey as CSV."""

from __future__ import annotations

import csv
import io
from collections import Counter
from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Name of the column that says where in the source a row stood.
SOURCE_ORDER = "source_order"

# Quotes inside a quoted answer are doubled; answers may hold line breaks.
_CSV = {"header": True, "quote": '"', "escape": '"'}


_FIELD = '(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
_REGULAR = f"(?s)^{_FIELD}(?:,{_FIELD})*+$"


def _headers(spark: SparkSession, path: str | Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """The files under each header, a header being its column names in order.

    One distributed read finds the first line of every file, whatever their number. Only if
    a header runs over several lines, these files are looked at once more. A row for each
    file comes to the driver, as many as the plan lists anyway.
    """
    lines = (
        spark.read.text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
            "value",
        )
        .where((F.col("block") == 0) & (F.trim("value") != ""))
    )
    first = lines.groupBy("file").agg(F.min_by("value", "line").alias("record"))
    records = {r["file"]: r["record"] for r in first.collect()}
    open_files = [f for f, record in records.items() if record.count('"') % 2]
    if open_files:
        records |= _long_headers(lines.where(F.col("file").isin(open_files)))
    found: dict[tuple[str, ...], list[str]] = {}
    for file in sorted(records):
        # Spark gives paths in the form of URLs and takes them as they are.
        found.setdefault(_column_names(records[file]), []).append(unquote(file))
    return found


def _long_headers(lines: DataFrame) -> dict[str, str]:
    """First records that go on until their quotes are closed."""
    in_file = Window.partitionBy("file").orderBy("line")
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    so_far = F.sum(quotes).over(in_file.rowsBetween(Window.unboundedPreceding, 0))
    counted = lines.select("*", so_far.alias("quotes"))
    closed = counted.groupBy("file").agg(F.min(F.when(F.col("quotes") % 2 == 0, F.col("line"))).alias("last"))
    parts = counted.join(closed, "file").where(F.col("last").isNull() | (F.col("line") <= F.col("last")))
    whole = parts.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("line", "value"))).alias("parts"))
    record = F.array_join(F.transform("parts", lambda p: p["value"]), "\n")
    return {r["file"]: r["record"] for r in whole.select("file", record.alias("record")).collect()}


def _column_names(record: str) -> tuple[str, ...]:
    """Names as Spark's CSV reader gives them: empty ones are numbered, and so are repeated
    ones, in which case doesn't count."""
    names = next(csv.reader(io.StringIO(record.lstrip("\ufeff"), newline="")))
    counts = Counter(n.lower() for n in names)
    return tuple(
        f"_c{i}" if not n else f"{n}{i}" if counts[n.lower()] > 1 else n for i, n in enumerate(names)
    )


def survey_columns(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    """All column names of the files, in the order in which they are met."""
    return list(dict.fromkeys(c for header in _headers(spark, path) for c in header))


def _file_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _finish(
    rows: DataFrame,
    columns: Sequence[str],
    types: Mapping[str, str] | None,
    extra: Sequence[Column],
) -> DataFrame:
    """Empty means NULL; everything else stays text unless ``types`` says otherwise."""
    kinds = types or {}
    wanted = [
        F.nullif(F.col(_quoted(c)), F.lit("")).cast(kinds.get(c, "string")).alias(c)
        for c in columns
    ]
    return rows.select(*wanted, *extra)


def _by_name(parts: Sequence[DataFrame], columns: Sequence[str] | None) -> DataFrame:
    """Files with other columns, or the same ones in another order, as one table."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if columns is None:
        return rows
    extra = [SOURCE_ORDER] if SOURCE_ORDER in rows.columns else []
    return rows.select(*[F.col(_quoted(c)) for c in columns], *extra)


def read_survey(
    spark: SparkSession,
    path: str | Sequence[str],
    *,
    columns: Sequence[str] | None = None,
    types: Mapping[str, str] | None = None,
    source_order: bool = False,
) -> DataFrame:
    """Read survey CSV files, one task per file.

    Columns are found by name in each file; one that a file lacks is NULL there. A record
    with more or fewer fields than its file's header fails the query. Values are text: a
    key must not turn into a number on the way. ``types`` casts further attributes,
    ``columns`` chooses some. A file whose answers hold line breaks cannot be cut at any
    line, so a huge single file is better read by ``read_survey_split``.
    """
    order = F.struct(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row")
    )
    extra = [order.alias(SOURCE_ORDER)] if source_order else []
    reader = spark.read.options(multiLine=True, mode="FAILFAST", **_CSV)
    parts = [
        _finish(reader.schema(_file_schema(header)).csv(files), header, types, extra)
        for header, files in _headers(spark, path).items()
    ]
    return _by_name(parts, columns)


def write_survey(survey: DataFrame, path: str) -> None:
    survey.write.mode("overwrite").options(**_CSV).csv(path)


def read_survey_split(
    spark: SparkSession,
    path: str | Sequence[str],
    *,
    columns: Sequence[str] | None = None,
    types: Mapping[str, str] | None = None,
    source_order: bool = False,
) -> DataFrame:
    """Read survey CSV files in parallel inside each file, line breaks in answers included.

    A line starts a record if the number of quotes before it in the file is even. Each
    block of a file is read on its own, and a running sum over the blocks' quote counts
    (one small row per block) tells whether a block starts inside an answer. Records that
    cross a block border are put together from their pieces. Quotes must be regular: a
    field with a quote in it is quoted and the inner quotes are doubled. Where they aren't,
    the query fails: an odd number of quotes in a file, a quote inside a field without
    quotes, and a record of more or fewer fields than the header are errors.
    """
    parts = [
        _split_files(spark, files, header, types, source_order)
        for header, files in _headers(spark, path).items()
    ]
    return _by_name(parts, columns)


def _split_files(
    spark: SparkSession,
    files: Sequence[str],
    columns: Sequence[str],
    types: Mapping[str, str] | None,
    source_order: bool,
) -> DataFrame:
    pieces = _pieces(spark, files)
    crossing = (F.col("_number") == 0) | F.col("_runs_on")
    whole = pieces.filter(~crossing).select(
        "_file", F.struct("_block", "_number").alias("_record"), "_text"
    )
    parts = pieces.filter(crossing).select("_file", "_record", "_block", "_text")
    joined = (
        parts.groupBy("_file", "_record")
        .agg(F.sort_array(F.collect_list(F.struct("_block", "_text"))).alias("_parts"))
        .select("_file", "_record", _join_lines(F.col("_parts")).alias("_text"))
    )
    records = whole.unionByName(joined)
    header = (F.col("_record._block") == 0) & (F.col("_record._number") == 1)
    text = F.rtrim(F.col("_text"), F.lit("\r"))
    body = records.filter(~header & (text != ""))
    # Quotes may only open a field, close it, or be doubled inside one.
    regular = text.rlike(_REGULAR)
    stray = F.raise_error(F.concat(F.lit("stray quote in "), F.col("_file"))).cast("string")
    schema = ", ".join(f"{_quoted(c)} string" for c in columns)
    options = {"quote": '"', "escape": '"', "mode": "FAILFAST"}
    parsed = F.from_csv(F.when(regular, text).otherwise(stray), schema, options)
    order = F.struct(
        F.col("_file").alias("file"),
        F.col("_record._block").alias("block"),
        F.col("_record._number").alias("row"),
    )
    rows = body.select(parsed.alias("_row"), order.alias("_order")).select("_row.*", "_order")
    extra = [F.col("_order").alias(SOURCE_ORDER)] if source_order else []
    return _finish(rows, columns, types, extra)


def _join_lines(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda part: part["_text"]), "\n")


def _pieces(spark: SparkSession, path: Sequence[str]) -> DataFrame:
    """Records, or their pieces, as they lie in each block of each file.

    ``_number`` counts the records that start in the block; piece 0 continues the record
    of an earlier block, which ``_record`` names. ``_runs_on`` marks a record that the
    next block continues.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
        F.col("value").alias("_text"),
    )
    quotes = F.length("_text") - F.length(F.replace(F.col("_text"), F.lit('"'), F.lit("")))
    in_block = Window.partitionBy("_file", "_block").orderBy("_line")
    earlier = in_block.rowsBetween(Window.unboundedPreceding, -1)
    counted = lines.withColumn("_quotes", quotes).withColumn(
        "_odd", F.coalesce(F.sum("_quotes").over(earlier), F.lit(0)) % 2
    )
    blocks = _block_states(
        counted.groupBy("_file", "_block").agg(
            (F.sum("_quotes") % 2).alias("_flips"),
            F.count_if(F.col("_odd") == 0).alias("_even"),
            F.count_if(F.col("_odd") == 1).alias("_uneven"),
        )
    )
    starts = (F.col("_odd") == F.col("_open")).cast("long")
    numbered = counted.join(blocks, ["_file", "_block"]).withColumn(
        "_number", F.sum(starts).over(in_block.rowsBetween(Window.unboundedPreceding, 0))
    )
    line = F.struct("_line", "_text")
    pieces = numbered.groupBy(
        "_file", "_block", "_number", "_starts", "_next_open", "_before"
    ).agg(F.sort_array(F.collect_list(line)).alias("_lines"))
    own = F.struct("_block", "_number")
    return pieces.select(
        "_file",
        "_block",
        "_number",
        F.when(F.col("_number") == 0, F.col("_before")).otherwise(own).alias("_record"),
        ((F.col("_number") == F.col("_starts")) & F.col("_next_open")).alias("_runs_on"),
        _join_lines(F.col("_lines")).alias("_text"),
    )


def _block_states(blocks: DataFrame) -> DataFrame:
    """Per block: does it start inside a quoted field, which record is open there, how
    many records start in it, and does the next block start inside a field."""
    by_place = Window.partitionBy("_file").orderBy("_block")
    earlier = by_place.rowsBetween(Window.unboundedPreceding, -1)
    odd = F.sum("_flips").over(Window.partitionBy("_file")) % 2 == 1
    message = F.concat(F.lit("an odd number of quotes in "), F.col("_file"))
    opened = blocks.withColumn(
        "_open",
        F.when(odd, F.raise_error(message).cast("bigint")).otherwise(
            F.coalesce(F.sum("_flips").over(earlier), F.lit(0)) % 2
        ),
    ).withColumn("_starts", F.when(F.col("_open") == 0, F.col("_even")).otherwise(F.col("_uneven")))
    last_record = F.when(
        F.col("_starts") > 0,
        F.struct(F.col("_block"), F.col("_starts").alias("_number")),
    )
    return opened.select(
        "_file",
        "_block",
        "_open",
        "_starts",
        F.coalesce(F.lead("_open").over(by_place) == 1, F.lit(False)).alias("_next_open"),
        F.last(last_record, ignorenulls=True).over(earlier).alias("_before"),
    )
