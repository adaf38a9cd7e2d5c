"""Session helpers: tables, shared checkpoint folder, time columns."""
from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def get_spark(app: str = "opweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every plan here assumes (UTC, AQE)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by checkpoint() in the shared folder the session names.

    Only where the session names none (tests, a laptop) is a local folder set."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            shared = os.path.join(tempfile.gettempdir(), f"opweave-checkpoint-{os.getuid()}")
        sc.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def micros(c: Column | str) -> Column:
    """Epoch microseconds (UTC) of a timestamp with or without zone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp"))


def seconds(c: Column | str) -> Column:
    """Epoch seconds as DOUBLE."""
    return micros(c) / F.lit(1e6)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors' Python workers, once an application (they may not share the driver's path)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    staged = Path(tempfile.mkdtemp(prefix="opweave-")) / "opweave.zip"  # the driver's file server hands it out
    staged.write_bytes(held.getvalue())
    sc.addPyFile(str(staged))
    _SHIPPED.add(sc.applicationId)
