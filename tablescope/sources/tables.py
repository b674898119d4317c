"""Table input and output."""

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.functions.schema import nan_to_null, quoted

MIN_ROWS, MIN_COLUMNS = 10, 2


def read_table(spark: SparkSession, path: str, fmt: str = "parquet",
               schema=None, **options) -> DataFrame:
    """A table with NaN already read as missing.

    CSV is read with a header; without a `schema` the types are inferred, which
    costs one extra pass over the files, so pass a schema for large inputs.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
    if schema is not None:
        reader = reader.schema(schema)
    return nan_to_null(reader.options(**options).load(path))


#: Name of the column that holds a record which the schema does not fit.
BAD = "_bad_record"


def read_checked(spark: SparkSession, path: str, schema: str, fmt: str = "csv", **options) -> tuple[DataFrame, DataFrame]:
    """(good rows, status) of CSV or JSON files: records that do not fit the schema are a result, not an error.

    Status has one row a file with a record: file, rows, bad_rows, sample (the least bad record, null where none is bad)
    and status (`ok`, `bad records`, `no good rows`). A path that cannot be listed has one row: its path, no rows, null and
    `unreadable`; the good rows are empty then. Records are counted and kept on the executors; good rows are those
    of the status, and each frame reads the files once. A file without a record has no row.
    """
    if fmt not in ("csv", "json"):
        raise ValueError("csv and json records can be checked")
    want = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if BAD in want.names:
        raise ValueError(f"{BAD} is the name of bad records")
    reader = spark.read.format(fmt).schema(T.StructType([*want.fields, T.StructField(BAD, T.StringType())]))
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", True)
    try:
        rows = reader.options(**options).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return (spark.createDataFrame([], want),
                spark.createDataFrame([(path, 0, 0, None, "unreadable")], "file string, rows long, bad_rows long, sample string, status string"))
    # always true, and asks for every column: a pruned reader would not see what is wrong with the others
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file")) \
        .where(F.pmod(F.hash(*[F.col(quoted(c)) for c in want.names]), F.lit(2)) < 2)
    counts = rows.groupBy(F.col("_file").alias("file")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(BAD).isNotNull()).alias("bad_rows"), F.min(BAD).alias("sample"))
    status = F.when(F.col("bad_rows") == 0, "ok").when(F.col("bad_rows") < F.col("rows"), "bad records").otherwise("no good rows")
    good = nan_to_null(rows.where(F.col(BAD).isNull()).select(*[F.col(quoted(c)) for c in want.names]))
    return good, counts.select("file", "rows", "bad_rows", "sample", status.alias("status"))


def load_tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """Parquet tables `<folder>/<name>.parquet` by name."""
    return {n: read_table(spark, f"{folder}/{n}.parquet") for n in names}


def load_labelled(df: DataFrame, label: str) -> DataFrame:
    """The numeric features of a table with its label column named `target`."""
    rest = [F.col(quoted(c)) for c in df.columns if c != label]
    return df.select(*rest, F.col(quoted(label)).alias("target"))


def ingest_check(df: DataFrame) -> DataFrame:
    """One row saying whether the table is large enough to audit (reads 10 rows at most)."""
    n_cols = len(df.columns)
    return df.limit(MIN_ROWS).agg(
        (F.count(F.lit(1)) >= MIN_ROWS).alias("enough_rows"),
        F.lit(n_cols >= MIN_COLUMNS).alias("enough_columns"))


def ingest_guard(df: DataFrame) -> DataFrame:
    """The table itself, or ValueError when it has under 10 rows or 2 columns."""
    if len(df.columns) < MIN_COLUMNS or len(df.select(F.lit(1)).take(MIN_ROWS)) < MIN_ROWS:
        raise ValueError(f"need at least {MIN_ROWS} rows and {MIN_COLUMNS} columns")
    return df


def preview(df: DataFrame, order_by: list[str], n: int = 8) -> DataFrame:
    return df.orderBy(*[F.col(quoted(c)) for c in order_by]).limit(n)


def write_cleaned(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """Write a table (CSV with header by default) as one file per task."""
    writer = df.write.mode("errorifexists").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        writer = writer.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    writer.save(path)
    return path


def write_findings(findings: DataFrame, path: str) -> str:
    """Persist a long findings table, one folder per section."""
    findings.repartition("section").write.mode("errorifexists").partitionBy("section").parquet(path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster names in `spark.checkpoint.dir`.

    Without that setting only a local session may go on, in a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.gettempdir() + "/tablescope"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write the frame to the shared folder and read it back.

    Cuts the lineage: later passes read only the columns they need and survive
    the loss of executors without repeating the work that led here.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
