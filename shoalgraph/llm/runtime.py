"""Session helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalgraph.session import shared_folder

_shipped: set[str] = set()
HOT, MOST = 100, 10_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """Makes the package importable on executors and sees to a checkpoint folder.

    The folder named in ``spark.checkpoint.dir`` is used as it is. Where none is set, a local session (tests) gets a temporary
    one; on a cluster that would be a folder of the driver alone, so there it is an error.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        shared_folder(spark)
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        target = os.path.join(tempfile.mkdtemp(prefix="shoalgraph-code-"), "shoalgraph_code.zip")
        with zipfile.ZipFile(target, "w") as z:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.join("shoalgraph", os.path.relpath(path, root)))
        sc.addPyFile(target)
        _shipped.add(sc.applicationId)
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and cuts its lineage, so that a lost executor costs no recomputation.

    The shuffle files it was made from are deleted once it is written, as nothing reads them again.
    """
    conf = df.sparkSession.conf
    was = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        conf.set(CLEANUP, was)


def join_by_size(left: DataFrame, right: DataFrame, on: str, size: str, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row for a value of ``on`` and in ``size`` how many rows of left have that value.

    Values of very many rows (at least HOT, and so many that there can be no more than MOST of them) are joined by broadcast, so that
    none of them lands in one task; the others by shuffle. right is read several times.
    """
    total = right.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) >= max(HOT, total // MOST)
    often = F.broadcast(right.where(hot).drop(size))
    rest = left.join(F.broadcast(right.where(hot).select(on)), on, "left_anti").join(right.where(~hot).drop(size), on, how)
    return left.join(often, on).unionByName(rest)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
