"""Dense record numbers without pulling the table through one task."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F

from reqweave.storage import materialize

ROW = "_row_idx"


def _file_counts(files: DataFrame) -> DataFrame:
    """``_file, _rows, _last``: rows and last row number of every file of a parquet scan."""
    placed = files.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    return materialize(placed.groupBy("_file").agg(F.count("*").alias("_rows"), F.max("_at").alias("_last")), "file-counts")


def _with_starts(files: DataFrame, counts: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Row number = rows of the files before, in ``order``, plus the place in the file."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    # short keys keep the joined table small enough to be sent to every task with very many files
    starts = materialize(starts.select(F.xxhash64("_file").alias("_key"), "_file", "_start"), "file-starts")
    columns, path = files.columns, F.col("_metadata.file_path")
    placed = files.select("*", path.alias("_path"), F.xxhash64(path).alias("_key"), F.col("_metadata.row_index").alias("_at"))
    total, distinct = starts.agg(F.count("*"), F.countDistinct("_key")).first()
    joined = placed.join(starts.drop("_file"), "_key") if total == distinct else placed.join(starts, F.col("_path") == F.col("_file"))
    return joined.select(*columns, (F.col("_start") + F.col("_at")).alias(name))


def number_files(files: DataFrame, name: str = ROW) -> DataFrame:
    """Number the rows of a parquet-backed frame in order of its parts, without a shuffle.

    Each row knows its place inside its file; adding the row counts of the files
    before it gives the number. Only the per-file counts are ordered globally, and
    they are written down so that Spark plans the join with their true size.
    """
    part = F.regexp_extract("_file", r"part-(\d+)", 1).cast("long")
    return _with_starts(files, _file_counts(files), [part, F.col("_file")], name)


def number_arrival(df: DataFrame, name: str = ROW) -> DataFrame:
    """Number records in order of their files' names and their places there.

    Frames that carry ``_src, _block, _place`` (records of text files) are range-partitioned by them.
    Whole parquet files are numbered where they lie. Rows of other files carry file, block
    and place in the block, and are range-partitioned by them. Any other frame is written
    and numbered in order of arrival.
    """
    if {"_src", "_block", "_place"} <= set(df.columns):
        return row_index(df, ["_src", "_block", "_place"], name, unique=True).drop("_src", "_block", "_place")
    try:
        df.select("_metadata.row_index")
    except AnalysisException:
        pass
    else:
        counts = _file_counts(df)
        if counts.where(F.col("_rows") != F.col("_last") + 1).isEmpty():
            return _with_starts(df, counts, [F.col("_file")], name)
        return number_files(materialize(df, "input"), name)
    try:
        placed = df.select("*", F.col("_metadata.file_path").alias("_src"), F.col("_metadata.file_block_start").alias("_block"))
    except AnalysisException:
        return number_files(materialize(df, "input"), name)
    return row_index(placed.withColumn("_place", F.monotonically_increasing_id()), ["_src", "_block", "_place"], name, unique=True).drop("_src", "_block", "_place")


def _placed(df: DataFrame) -> DataFrame:
    """Adds file and position, the repeatable mark that tells copies of a row apart.

    Frames that are not a plain parquet scan are written first.
    """
    mark = [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_pos")]
    try:
        return df.select("*", *mark)
    except AnalysisException:
        return materialize(df, "unordered").select("*", *mark)


def row_index(df: DataFrame, order_by: list[str | Column], name: str = ROW, unique: bool = False) -> DataFrame:
    """0-based position of every row under ``order_by``, arrival order among equals. ``unique`` keys need no arrival place.

    The rows are range-partitioned, sorted inside the partitions and written, so
    part files follow each other in order. The key ends with the arrival place, so
    rows with equal keys, copies included, spread over several partitions.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order_by]
    if not unique:
        df, keys = _placed(df), [*keys, F.col("_path"), F.col("_pos")]
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_path", "_pos")
    return number_files(materialize(ordered, "ordered"), name)


def number_in_group(df: DataFrame, group: str, order_by: list[str], name: str = "_group_idx") -> DataFrame:
    """0-based position inside each group. A large group spans many partitions."""
    numbered = row_index(df, [group, *order_by], "_all_idx")
    first = materialize(numbered.groupBy(group).agg(F.min("_all_idx").alias("_first")), "group-starts")
    joined = numbered.join(first, numbered[group].eqNullSafe(first[group])).drop(first[group])
    return joined.withColumn(name, F.col("_all_idx") - F.col("_first")).drop("_all_idx", "_first")


#: Rows whose running sum is made together when parts are bounded by bytes.
RUN_ROWS = 4096


def parts_in_group(
    df: DataFrame, group: str, order_by: list[str], size: Column, most_bytes: int, most_rows: int, name: str = "_part"
) -> DataFrame:
    """Position inside the group (``_group_idx``) and a part of rows that follow each other.

    A part has ``most_rows`` rows at most, and fewer bytes (``size``) than ``most_bytes`` and its first row together. The
    running sum is a prefix over runs of rows and a sum inside each, over row numbers and sizes only.
    """
    numbered = number_in_group(df.withColumn("_size", size), group, order_by)
    # of the two bounds the one that a row uses up more of counts
    weight = F.greatest(F.col("_size") * most_rows, F.lit(most_bytes)).cast("decimal(20,0)")
    narrow = numbered.select(F.col(group).alias("_g"), "_group_idx", F.floor(F.col("_group_idx") / RUN_ROWS).alias("_run"), weight.alias("_w"))
    narrow = materialize(narrow, "sizes")
    runs = narrow.groupBy("_g", "_run").agg(F.sum("_w").alias("_sum"))
    before = Window.partitionBy("_g").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = materialize(runs.select("_g", "_run", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")), "runs")
    inside = Window.partitionBy("_g", "_run").orderBy("_group_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = narrow.withColumn("_upto", F.sum("_w").over(inside)).withColumnsRenamed({"_g": "_h", "_run": "_r"})
    placed = summed.join(runs, summed["_h"].eqNullSafe(runs["_g"]) & (summed["_r"] == runs["_run"]))
    part = F.expr(f"CAST((_before + _upto - 1) DIV CAST({most_bytes * most_rows} AS DECIMAL(20,0)) AS BIGINT)")
    # a run has few parts: where each begins is all that the rows themselves need to know
    starts = placed.groupBy("_h", "_r", part.alias("_p")).agg(F.min("_group_idx").alias("_from"))
    starts = starts.groupBy("_h", "_r").agg(F.collect_list(F.struct("_from", "_p")).alias("_starts"))
    starts = materialize(starts, "part-starts")
    rows = numbered.withColumn("_run", F.floor(F.col("_group_idx") / RUN_ROWS))
    joined = rows.join(starts, rows[group].eqNullSafe(starts["_h"]) & (rows["_run"] == starts["_r"]))
    own = F.array_max(F.filter("_starts", lambda s: s["_from"] <= F.col("_group_idx")))["_p"]
    return joined.withColumn(name, own).drop("_size", "_run", "_h", "_r", "_starts")


def ordered_emit(df: DataFrame, name: str = ROW) -> DataFrame:
    """Input order again: range partitions, each sorted."""
    return df.orderBy(name)


def preview_limit(df: DataFrame, n: int = 10, name: str = ROW) -> DataFrame:
    """First ``n`` records."""
    return df.orderBy(name).limit(n)


def latest_results(df: DataFrame, n: int = 20, name: str = ROW) -> DataFrame:
    return df.orderBy(F.desc(name)).limit(n)


def exclude_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop listed columns; unknown names are ignored."""
    return df.drop(*names)


def skip_blank_rows(df: DataFrame) -> DataFrame:
    """Keep rows with at least one non-empty text cell."""
    cells = F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns])
    return df.where(F.exists(cells, lambda c: c != ""))
