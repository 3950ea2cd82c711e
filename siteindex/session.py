"""Session settings and tables kept in the cluster's shared folder."""

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ARROW_ROWS = 256  # pages per Arrow batch; pages are large, the default of 10,000 is for narrow rows
LISTINGS = 4  # tasks for each core that list the folders of a table


def configure(spark: SparkSession, folder: str | None = None) -> SparkSession:
    """Runtime settings the page parser wants; everything else stays with the cluster.

    ``folder`` is where steps are kept; without it ``spark.checkpoint.dir`` names it. The
    Python workers import the parser from this package, so it is sent to them.
    """
    _ship_package(spark)
    if folder:
        spark.conf.set("spark.checkpoint.dir", folder)
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    # folders are listed by some tasks for each core; the default is a task for each folder
    spark.conf.set(
        "spark.sql.sources.parallelPartitionDiscovery.parallelism",
        str(LISTINGS * max(spark.sparkContext.defaultParallelism, 1)),
    )
    return spark


_shipped: set[str] = set()


def _ship_package(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(package):
        # the driver serves the archive while it runs; it goes with the driver
        folder = tempfile.mkdtemp(prefix="siteindex-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = shutil.make_archive(
            os.path.join(folder, "siteindex"),
            "zip",
            root_dir=os.path.dirname(package),
            base_dir=os.path.basename(package),
        )
        context.addPyFile(archive)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application in that named by ``spark.checkpoint.dir``.

    Where none is named it stands in the warehouse, which executors share as well.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/kept-steps"
    return f"{folder.rstrip('/')}/siteindex-{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Remove the kept steps of this application; call it when results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mounted(spark: SparkSession, path: str) -> str | None:
    """The folder that Spark means by a path, if it is in the file system of the machines."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = system.makeQualified(place).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def keep(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage like ``checkpoint()`` and survives lost executors; unlike it,
    later reads fetch only the columns they need and the planner knows the size, so
    a broadcast is chosen by measured bytes.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
