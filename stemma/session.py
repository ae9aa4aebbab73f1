"""Session helpers: configuration, reading tables, and tables that cut lineage.

Intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir`` (shared by all executors, so a lost executor loses
nothing).  Only where that setting is absent, as in tests on one machine, a
local temporary folder is used instead.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def build_session(app: str = "stemma", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; extra keys use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the cluster, or a local one where none is set."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="stemma-")
    return _FALLBACK[app]


_WRITTEN: list[Materialized] = []


def drop_written() -> None:
    """Remove every intermediate table of this process; called at its end."""
    while _WRITTEN:
        try:
            _WRITTEN.pop().drop()
        except Exception:  # noqa: BLE001 - the session may be gone already
            return


class Materialized:
    """A written intermediate table; ``drop`` removes its files once nothing reads them."""

    def __init__(self, spark: SparkSession, path: str, schema) -> None:
        self.spark, self.path = spark, path
        self.df = spark.read.schema(schema).parquet(path)

    def drop(self) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str) -> Materialized:
    """Write ``df`` to the shared folder and read it back: each part is computed once and kept."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/stemma-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = Materialized(spark, path, df.schema)
    if not _WRITTEN:
        atexit.register(drop_written)
    _WRITTEN.append(out)
    return out
