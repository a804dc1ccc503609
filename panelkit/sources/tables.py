"""File sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.functions.labels import CLASS_YEARS
from panelkit.functions.semantics import nan_to_null
from panelkit.operators.keys import match_keys
from panelkit.session import keep, settle

# fixed values: column names of the input files
ANNUAL_SCHEMA = "Year INT, Petrolina DOUBLE, Juazeiro DOUBLE, GLDAS2_0 DOUBLE, GLDAS2_1 DOUBLE"
MONTHLY_SCHEMA = (
    "Year INT, Month STRING, Petrolina DOUBLE, Juazeiro DOUBLE, GLDAS2_0 DOUBLE, GLDAS2_1 DOUBLE"
)
GRID_FILE = r"([^/]+)/([0-9]{10})\.[^/]*$"
# Size that packed files are given.
FILE_BYTES = 128 << 20
SCENARIO_FILE = r"([^/]+?)(?:\.[A-Za-z0-9]+)?$"


def read_wide_series(spark: SparkSession, path: str, schema: str = ANNUAL_SCHEMA) -> DataFrame:
    """CSV with a header and one column per source; ``NA`` and empty fields are NULL.

    Column order is free, as fields are matched to the schema by name, but several files must agree on
    it: a header that differs from the first one raises an error.
    """
    wanted = T.StructType.fromDDL(schema)
    raw = spark.read.csv(path, header=True, nullValue="NA", enforceSchema=False)
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted.fields])


def read_schedule(
    spark: SparkSession, path: str, slots: int | None = None, scenario_column: bool = False
) -> DataFrame:
    """Headerless schedule, one line per scenario and one field per simulated year: ``scen, X1, X2, ...``.

    With ``scenario_column`` the first field names the scenario. Without it the line number does, and
    the file is read as one record so that line numbers are well defined; a schedule is a design
    document with one line per scenario, not data. Blank lines do not count. There are as many columns as
    the longest line has years; with ``slots``, a longer line raises an error.
    """
    text = spark.read.text(path, wholetext=True)
    filled = F.filter(F.split("value", r"\s*\n\s*"), lambda line: F.trim(line) != "")
    lines = text.select(F.posexplode(filled).alias("_row", "_line"))
    fields = F.split(F.trim("_line"), r"\s*,\s*")
    number = F.concat(F.lit("scen_"), F.lpad((F.col("_row") + 1).cast("string"), 2, "0"))
    if scenario_column:
        rows = lines.select(F.get(fields, 0).alias("scen"), F.slice(fields, 2, F.size(fields)).alias("_f"))
    else:
        rows = lines.select(number.alias("scen"), fields.alias("_f"))
    longest = rows.agg(F.max(F.size("_f"))).first()[0] or 0
    if slots is not None and longest > slots:
        raise ValueError(f"a line has {longest} years, more than {slots}")
    years = [F.get("_f", i) for i in range(longest if slots is None else slots)]
    missing = F.array(F.lit(""), F.lit("NA"))
    return rows.select(
        "scen",
        *[
            F.when(~F.array_contains(missing, y), y).cast("int").alias(f"X{i + 1}")
            for i, y in enumerate(years)
        ],
    )


def scenario_from_path(df: DataFrame) -> DataFrame:
    """Add ``scenario``, the name of the file each row came from, without folder and extension."""
    return df.select("*", F.regexp_extract("_metadata.file_path", SCENARIO_FILE, 1).alias("scenario"))


def grid_file_keys(df: DataFrame, path: Column | None = None) -> DataFrame:
    """Add ``scenario`` and ``ts`` from files named ``<scenario>/<YYYYMMDDHH>.<anything>``."""
    path = F.col("_metadata.file_path") if path is None else path
    stamp = F.regexp_extract(path, GRID_FILE, 2)
    return df.select(
        "*",
        F.regexp_extract(path, GRID_FILE, 1).alias("scenario"),
        F.to_timestamp_ntz(stamp, F.lit("yyyyMMddHH")).alias("ts"),
    )


def read_grids(spark: SparkSession, path: str, values: Sequence[str]) -> DataFrame:
    """Gridded Parquet files in one folder per scenario; only the wanted arrays are read."""
    return grid_file_keys(spark.read.parquet(path)).select("scenario", "ts", *values)


def grid_years(files: DataFrame) -> DataFrame:
    """Distinct years per scenario of a grid dataset."""
    return files.select("scenario", F.year("ts").alias("year")).distinct()


# fixed values: columns of the yearly panel; tables written with fewer columns read NULL for the others
PANEL_SCHEMA = (
    "scenario STRING, x INT, y INT, time DATE, precip DOUBLE, gpp DOUBLE, scen_code STRING, "
    "drought_intensity STRING, recovery_intensity STRING, drought_duration INT, lat DOUBLE, lon DOUBLE, "
    "id BIGINT, soil_type INT, veg_type INT"
)


def read_panel(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet table with NaN read as NULL in its double columns.

    ``schema`` (for instance ``PANEL_SCHEMA``) fixes names and types. Without it they come from the
    files, but a ``scenario`` that is a folder name is always text, also where all folders are numbers.
    """
    reader = spark.read
    if schema is None:
        found = reader.parquet(path).schema
        fields = [
            T.StructField(f.name, T.StringType()) if f.name == "scenario" else f for f in found.fields
        ]
        df = reader.schema(T.StructType(fields)).parquet(path)
    else:
        df = reader.schema(schema).parquet(path)
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: nan_to_null(F.col(c)) for c in doubles}) if doubles else df


def write_by_scenario(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet, one folder per scenario.

    The rebalance hint lets adaptive execution split a scenario that holds much of the data over many
    tasks and join small ones, so folders get few files of a good size.
    """
    df.hint("rebalance", "scenario").write.mode(mode).partitionBy("scenario").parquet(path)


def replace_scenarios(df: DataFrame, path: str) -> None:
    """Write scenarios over those of the same name; the folders of all others stay as they are.

    New files are complete before the old ones of their scenario go, and a scenario without rows in
    ``df`` is not touched, so one scenario can be run again and the rest of the table kept.
    """
    writer = df.hint("rebalance", "scenario").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("scenario").parquet(path)


def scenario_files(spark: SparkSession, path: str) -> DataFrame:
    """Number of files and bytes of each scenario of a written table; no column is read."""
    files = read_panel(spark, path).select(
        "scenario", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")
    )
    one = files.groupBy("scenario", "file").agg(F.max("bytes").alias("bytes"))
    return one.groupBy("scenario").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def pack_by_scenario(
    spark: SparkSession, source: str, path: str, file_bytes: int = FILE_BYTES, mode: str = "errorifexists"
) -> None:
    """Rewrite a table that was written by scenario into files of about ``file_bytes`` each.

    A scenario gets as many files as its bytes ask for, and every file is written by a task of its own,
    so neither many small files nor one that holds most of the data stay. Rows are dealt to the files of
    their scenario by a hash of the whole row; a task that runs again deals them alike. ``path`` must be
    a new folder, so the old table stays whole until the new one is complete.
    """
    wanted = F.greatest(F.ceil(F.col("bytes") / file_bytes), F.lit(1)).cast("bigint")
    sizes = keep(scenario_files(spark, source).select("scenario", wanted.alias("_files")))
    total = sizes.agg(F.sum("_files")).first()[0] or 1
    # one row for each scenario, so the running sum is over a table of the design's size
    before = Window.orderBy("scenario").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("_first", F.coalesce(F.sum("_files").over(before), F.lit(0)))
    placed, _ = settle(placed)
    rows = spark.read.schema(read_panel(spark, source).schema).parquet(source)
    dealt = match_keys(rows, placed, ["scenario"])
    at = F.col("_first") + F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.col("_files"))
    dealt = dealt.repartitionById(int(total), at.cast("int")).drop("_first", "_files")
    dealt.write.mode(mode).partitionBy("scenario").parquet(path)


def store(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it back, so that later results start from the files."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def class_table(spark: SparkSession, years: dict[str, int] | None = None) -> DataFrame:
    """Chosen year of each class as a table."""
    chosen = CLASS_YEARS if years is None else years
    return spark.createDataFrame(list(chosen.items()), "Class STRING, Year INT")


def variable_pairs(spark: SparkSession, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Regression pairs as a table with their formula text."""
    rows = [(dep, ind, f"{dep} ~ {ind}") for dep, ind in pairs]
    return spark.createDataFrame(rows, "dependent STRING, independent STRING, formula STRING")
