"""Sources: tables, parquet files, sniffed CSV imports and import validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from pulseframe.functions.semantics import to_ts
from pulseframe.operators.reshape import latest_per_key

# ==========================================================================
# FIXED VALUES (must equal the original importer's to give the same results)
# ==========================================================================

# Terms that mark the header line of an import file.
HEADER_TERMS = ("Participant ID", "participant_id", "User ID", "ID,", '"id"', "COPY ", "INSERT INTO")
HEADER_SEPARATORS = (",", ";", "\t")

# Import column name -> table column name.
IMPORT_ALIASES = {
    "Participant ID": "id",
    "participant_id": "id",
    "ID": "id",
    "User ID": "user_id",
    "user_id": "user_id",
    "Pmo ID": "pmo_id",
    "pmo_id": "pmo_id",
    "Datum": "created_at",
    "Aangemaakt": "created_at",
    "Created At": "created_at",
    "created_at": "created_at",
    "Bijgewerkt": "updated_at",
    "Updated At": "updated_at",
    "updated_at": "updated_at",
    "Datum invullen": "completion_created_at",
    "Geboortedatum": "date_of_birth",
    "Geslacht": "gender",
    "Postcode": "postal_code",
    "Leefstijlscore": "rec_ls_lifestyle_score",
    "leefstijlscore": "rec_ls_lifestyle_score",
    "BMI": "rec_med_bmi",
    "bmi": "rec_med_bmi",
    "Stress Score": "rec_ls_stress_sum",
    "stress_score": "rec_ls_stress_sum",
    "Hartrisico": "rec_heartrisk",
    "hartrisico": "rec_heartrisk",
    "Heartrisk": "rec_heartrisk",
    "Slaapscore": "rec_ls_sleep_psqi_sum",
    "slaapscore": "rec_ls_sleep_psqi_sum",
    "Sleep score": "rec_ls_sleep_psqi_sum",
    "Veerkracht": "rec_resilience_score",
    "veerkracht": "rec_resilience_score",
    "Resilience": "rec_resilience_score",
    "Beweegscore": "rec_ls_score_exercise",
    "beweegscore": "rec_ls_score_exercise",
    "Exercise score": "rec_ls_score_exercise",
}

# Date columns parsed day-first on import.
IMPORT_DATE_COLUMNS = ("created_at", "updated_at", "date_of_birth", "completion_created_at")

# ==========================================================================


def read_table(spark: SparkSession, location: str, fmt: str = "parquet", options: Mapping[str, str] | None = None,
               columns: Sequence[str] | None = None) -> DataFrame:
    """Read a whole table. Missing or unreadable tables raise (no silent empty
    frame). ``columns`` prunes at the scan."""
    df = spark.read.format(fmt).options(**(options or {})).load(location)
    return df.select(*columns) if columns else df


def read_jdbc(spark: SparkSession, url: str, table: str, properties: Mapping[str, str] | None = None,
              partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
              num_partitions: int | None = None) -> DataFrame:
    """Optional relational source; partitioned reads when a numeric column and
    bounds are given (needs the JDBC driver on the classpath)."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    if partition_column and num_partitions:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
              .option("upperBound", upper).option("numPartitions", num_partitions))
    return r.load()


def read_parquet_unique(spark: SparkSession, path: str, key: str = "user_id", order: str | None = None) -> DataFrame:
    """Parquet file(s) reduced to one row per ``key`` (the row with the
    largest ``order`` value, or the largest file position when none)."""
    df = spark.read.parquet(path)
    if order is None:
        df = df.withColumn("_pos", F.monotonically_increasing_id())
        order = "_pos"
    out = latest_per_key(df.where(F.col(key).isNotNull()), [key], order, tiebreak=())
    return out.drop("_pos") if "_pos" in out.columns else out


def _numbered_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines with their position: (file, start of the split, line within it)."""
    lines = spark.read.text(path if isinstance(path, str) else list(path)).select(
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                 F.monotonically_increasing_id().alias("line")).alias("at"),
        F.regexp_replace("value", "^\ufeff", "").alias("value"))
    return lines


def sniff_header(spark: SparkSession, path: str | Sequence[str], terms: Sequence[str] = HEADER_TERMS,
                 separators: Sequence[str] = HEADER_SEPARATORS) -> DataFrame:
    """One row per file: the position ``at`` and text ``header`` of its first
    line holding a known term and a separator, wherever it stands; the first
    line where none does. A ``min_by`` aggregate, so only one line per task
    and file moves."""
    lines = _numbered_lines(spark, path)
    has_term, has_sep = F.lit(False), F.lit(False)
    for t in terms:
        has_term = has_term | F.col("value").contains(t)
    for s in separators:
        has_sep = has_sep | F.col("value").contains(s)
    order = F.struct((~(has_term & has_sep)).alias("miss"), F.col("at"))
    return (lines.groupBy(F.col("at.file").alias("file"))
            .agg(F.min_by(F.struct("at", "value"), order).alias("h"))
            .select("file", F.col("h.at").alias("at"), F.col("h.value").alias("header")))


def _joined_records(body: DataFrame) -> DataFrame:
    """(at, sep, value) lines -> (at, value) records: a quoted field may run on over
    the following lines.

    A quote opens a field only at its start (after the line's start or a
    separator). Inside, two quotes stand for one, and any other quote ends the
    quoted part, as the parser takes it. A line is thus a function of the state
    it begins in (outside or inside a quoted field); it either leaves the state
    as it is, swaps it, or sets it. Where no line begun outside ends inside
    there is nothing to join and the lines pass as they are. Otherwise the
    functions are chained per split, the states before a split follow from the
    (few) splits of its file, and a window over the lines of one split tells
    which of them start a record; only the lines of records that span several
    are gathered. A field still open at the end of its file was never closed:
    its lines stay records of their own."""
    # Before a piece between quotes: 0 within an unquoted field, 1 at the start
    # of a field or after a quote inside one, 2 inside.
    ends = lambda start: (f"CASE WHEN NOT contains(value, '\"') THEN {start - 1} ELSE cast(aggregate(slice(_x, 1, size(_x) - 1), {start}, (s, x) -> "  # noqa: E731
                          f"CASE WHEN s = 2 THEN 1 WHEN (s = 1 AND x = '') OR endswith(x, sep) THEN 2 ELSE 0 END) = 2 AS int) END")
    q = (body.select("at", F.col("at.file").alias("file"), F.col("at.split").alias("split"), "value", "sep", F.split("value", '"', -1).alias("_x"))
         .select("at", "file", "split", "value", F.expr(ends(1)).alias("_out"), F.expr(ends(2)).alias("_in")))
    if q.where("_out = 1").isEmpty():
        return body.select("at", "value")
    lines = Window.partitionBy("file", "split").orderBy("at")
    upto = lines.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    splits = Window.partitionBy("file").orderBy("split")
    so_far = splits.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = splits.rowsBetween(Window.unboundedPreceding, -1)
    # The state after a line: that of the last line that set it (or the start
    # of the split), swapped as often as lines swapped it since.
    q = q.withColumn("_swaps", F.sum(((F.col("_out") == 1) & (F.col("_in") == 0)).cast("int")).over(upto))
    q = q.withColumn("_set", F.last(F.when(F.col("_out") == F.col("_in"), (F.col("_out") + F.col("_swaps")) % 2), True).over(upto))
    ahead = (q.groupBy("file", "split").agg(F.max_by(F.struct("_swaps", "_set"), "at").alias("e")).select("file", "split", "e.*")
             .withColumn("_s", F.sum(F.when(F.col("_set").isNull(), F.col("_swaps")).otherwise(0)).over(so_far))
             .withColumn("_c", F.last(F.when(F.col("_set").isNotNull(), (F.col("_set") + F.col("_swaps") + F.col("_s")) % 2), True).over(so_far))
             .withColumn("_after", (F.coalesce("_c", F.lit(0)) + F.col("_s")) % 2)
             .select("file", "split", F.coalesce(F.lag("_after").over(splits), F.lit(0)).alias("_before"),
                     F.last("_after").over(splits.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_unclosed")))
    told = (q.join(ahead, ["file", "split"])
            .withColumn("_after", (F.coalesce("_set", "_before") + F.col("_swaps")) % 2)
            .withColumn("_open", F.coalesce(F.lag("_after").over(lines), "_before") == 1)
            .withColumn("_start", F.when(~F.col("_open"), F.col("at"))))
    # A split may begin inside a record: its start is the last one before the split.
    last = (told.groupBy("file", "split").agg(F.max("_start").alias("_last"))
            .withColumn("_carried", F.max("_last").over(earlier))
            .withColumn("_tail", F.max("_last").over(Window.partitionBy("file"))).drop("_last"))
    told = (told.join(last, ["file", "split"])
            .withColumn("_record", F.coalesce(F.max("_start").over(upto), "_carried", "at")))
    whole = (~F.col("_open") & (F.col("_after") == 0)) | ((F.col("_unclosed") == 1) & (F.col("_record") == F.col("_tail")))
    pieces = (told.where(~whole).groupBy("_record").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("_p"))
              .select(F.col("_record").alias("at"), F.array_join(F.transform("_p", lambda x: x["value"]), "\n").alias("value")))
    return told.where(whole).select("at", "value").unionByName(pieces)


def sniff_layouts(headers: DataFrame, separators: Sequence[str] = HEADER_SEPARATORS) -> list[tuple[str, list[str]]]:
    """The distinct (separator, column names) of header lines, in file order.

    Only distinct header lines reach the driver, at most one per file. A name
    that a header repeats gets its place added, so no column is lost."""
    firsts = headers.groupBy("header").agg(F.min("file").alias("file")).orderBy("file").collect()
    layouts = []
    for row in firsts:
        sep = max(separators, key=row.header.count)
        names = [c.strip().strip('"') for c in row.header.split(sep)]
        names = [n if names.index(n) == i else f"{n}_{i + 1}" for i, n in enumerate(names)]
        layouts.append((row.header, sep, names))
    return layouts


def read_csv_sniffed(spark: SparkSession, path: str | Sequence[str], schema: StructType | None = None,
                     terms: Sequence[str] = HEADER_TERMS, separators: Sequence[str] = HEADER_SEPARATORS) -> DataFrame:
    """Distributed CSV read after sniffing every file's header line and separator.

    The files are read as text in parallel; every line up to and including the
    header of its file goes by position, however often its text returns as
    data, and blank lines go; the rest is parsed with ``from_csv`` under its
    own file's layout, in one pass (a CASE over the distinct layouts), and
    aligned by column name. Columns stand in the order of the first file, then
    those that later files add; a column that a file lacks is NULL there. All
    are strings unless a ``schema`` is given. A BOM on the first line is
    tolerated. A quoted field may hold line breaks (``_joined_records``) and
    doubled quotes.
    """
    headers = sniff_header(spark, path, terms, separators)
    layouts = sniff_layouts(headers, separators)
    if not layouts:
        raise ValueError(f"no lines in {path}")
    kinds = list(dict.fromkeys((sep, tuple(names)) for _, sep, names in layouts))
    columns = list(dict.fromkeys(n for _, names in kinds for n in names))
    which = F.create_map(*[x for h, sep, names in layouts for x in (F.lit(h), F.lit(kinds.index((sep, tuple(names)))))])
    seps = F.array(*[F.lit(sep) for sep, _ in kinds])
    # One short row per file of the import; a broadcast keeps the lines in file order.
    after = F.broadcast(headers.select("file", F.col("at").alias("_header_at"), which[F.col("header")].alias("_layout")))
    lines = _numbered_lines(spark, path)
    body = (lines.join(after, lines["at.file"] == after["file"]).where(F.col("at") > F.col("_header_at"))
            .select("at", seps[F.col("_layout")].alias("sep"), "value"))
    records = _joined_records(body).where(F.length(F.trim("value")) > 0)
    records = records.join(after.select("file", "_layout"), records["at.file"] == after["file"])
    parsed = records.select("_layout", *[
        F.when(F.col("_layout") == i, F.from_csv("value", ", ".join(f"`{n}` string" for n in names), {"sep": sep, "escape": '"'}))
        .alias(f"_r{i}") for i, (sep, names) in enumerate(kinds)])
    parsed = parsed.select(*[F.coalesce(*[F.col(f"_r{i}")[n] for i, (_, names) in enumerate(kinds) if n in names]).alias(n)
                             for n in columns])
    if schema is not None:
        parsed = parsed.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields
                                 if f.name in columns])
    return parsed


def upload_validate(df: DataFrame, table_columns: Sequence[str], aliases: Mapping[str, str] = IMPORT_ALIASES,
                    date_columns: Sequence[str] = IMPORT_DATE_COLUMNS, now: str | None = None) -> DataFrame:
    """Validate and clean an import frame against the target table's columns:
    rename by ``aliases``; fill user_id from id; parse date columns day-first
    (unparsable -> NULL); fill created_at with ``now`` (the import time);
    keep only the table's columns; keep the last row per id (file order)."""
    renames = {c: aliases[c] for c in df.columns if c in aliases}
    out = df.withColumn("_pos", F.monotonically_increasing_id()).withColumnsRenamed(renames)
    cols = set(out.columns)
    if "user_id" in table_columns:
        if "user_id" not in cols and "id" in cols:
            out = out.withColumn("user_id", F.col("id"))
        elif "user_id" in cols and "id" in cols:
            out = out.withColumn("user_id", F.coalesce(F.col("user_id"), F.col("id")))
    for c in date_columns:
        if c in out.columns:
            out = out.withColumn(c, to_ts(c, dayfirst=True))
    if "created_at" in table_columns:
        stamp = F.lit(now).cast("timestamp_ntz") if now else F.localtimestamp()
        out = out.withColumn("created_at", F.coalesce(F.col("created_at"), stamp) if "created_at" in out.columns
                             else stamp)
    keep = [c for c in out.columns if c in table_columns]
    if not keep:
        keep = [v for v in aliases.values() if v in out.columns]
    out = out.select(*dict.fromkeys(keep), "_pos")
    if "id" in out.columns:
        # NULL ids form one group, as a keep-last drop of duplicates treats them
        out = latest_per_key(out, ["id"], "_pos", tiebreak=())
    return out.drop("_pos")


def row_counts(frames: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table with its row count (one job per table, unioned)."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
             for name, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
