"""Tables written once in the folder that all executors share."""

import tempfile
import uuid
import zipfile
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; only a local session may go without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tablescope-"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the frame and read it back: later passes are cheap and outlive the executors that made it.

    The shuffle files of the job are deleted as soon as it has ended, not when the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that `written` made, as soon as nothing that is still to be computed reads them."""
    for table in tables:
        base = f"/{table.sparkSession.sparkContext.applicationId}/"
        for folder in {unquote(f).rsplit("/", 1)[0] for f in table.inputFiles() if base in f}:
            _delete(table.sparkSession, folder)


def keyed(df: DataFrame, name: str) -> DataFrame:
    """The frame, written with a number of its own for each row."""
    return written(df.withColumn(name, F.monotonically_increasing_id()), "keyed-rows")


def release(spark: SparkSession) -> None:
    """Delete every table that `written` made in this application; call it when the results are stored."""
    _delete(spark, f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once per application, through Spark's own file server."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="tablescope-")) / "tablescope_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)
