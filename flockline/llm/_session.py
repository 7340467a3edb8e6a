"""What operators ask of the session: sizes to plan by, and a shared place to cut lineage."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP_BYTES = 8 << 20
#: Bytes of text that a map task holds at once with all that it derives from them.
SEGMENT = 8 << 20


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_buckets(docs: DataFrame, text: str = "text", group_bytes: int = GROUP_BYTES) -> int:
    """How many groups to deal texts into, so that each holds about `group_bytes` at most.

    Groups send blocks to each other; at hundreds of GB they grow with the root of the input, so
    that blocks do not become single rows.
    """
    total = int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)
    size = max(group_bytes, int((64 * total) ** 0.5))
    return max(shuffle_partitions(docs.sparkSession), -(-total // size))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share.

    The cluster names it in spark.checkpoint.dir; a temporary one is set only where that is unset,
    nothing else has set one, and all runs on one machine, as in tests.  Elsewhere it must be named.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="flockline-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder, and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    have = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name.lower() in have:
        name += "_"
    return name


def same_columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns that docs has, by name, whatever characters they hold."""
    return out.select(*["`{}`".format(c.replace("`", "``")) for c in docs.columns])


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="flockline-")) / "flockline_workers.zip"
    with zipfile.ZipFile(archive, "w") as z:
        z.write(top / "__init__.py", f"{top.name}/__init__.py")
        for f in sorted((top / "llm").glob("*.py")):
            z.write(f, f"{top.name}/llm/{f.name}")
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)
