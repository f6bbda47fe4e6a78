"""Intermediate tables in the folder that driver and executors share.

A lineage that is read more than once, or grows in a loop, is cut by writing it as Parquet below
``spark.checkpoint.dir``. Such a table survives the loss of any executor, which cached blocks do not.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset, and Spark runs on this machine alone, a folder of our own."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="latticeq-")
        atexit.register(shutil.rmtree, root, True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Bytes of an Arrow batch between Spark and Python: what a task holds then doesn't grow with the rows' length.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Give this package's modules to the executors, once for each application, and bound the session's Arrow batches."""
    context = spark.sparkContext
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.match(r"(\d+)([kmgt]?)", spark.conf.get(key).lower()).groups()
    if int(number) << 10 * " kmgt".index(unit or " ") > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    if getattr(context, "_latticeq_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="latticeq-")  # the driver serves it until it ends
    atexit.register(shutil.rmtree, folder, True)
    name = f"{folder}/latticeq-modules.zip"
    with zipfile.ZipFile(name, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(name)
    context._latticeq_shipped = True


class Workspace:
    """Named Parquet tables of one operator call.

    ``drop`` frees those that later tables replace; the folder goes when the session's Python process ends, since a lazy
    result may read its tables until then.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        ship(spark)
        self.spark = spark
        # these outlive a stopped session
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        self.made = 0

    def table(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return it as a scan of what was written."""
        path = self.folder()
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._latticeq_path = path
        return out

    def folder(self) -> str:
        """A path here that nothing has been written to, for files of other formats."""
        if not self.made:
            atexit.register(self.clear)
        self.made += 1
        return f"{self.root}/{self.made:03d}"

    def _delete(self, path: str) -> None:
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self._conf).delete(where, True)

    def drop(self, df: DataFrame) -> None:
        """Delete a table made here that nothing still to be evaluated reads."""
        with contextlib.suppress(AttributeError):
            self._delete(df._latticeq_path)

    def clear(self) -> None:
        """Delete all tables made here."""
        with contextlib.suppress(Exception):  # the gateway may be gone already
            self._delete(self.root)
