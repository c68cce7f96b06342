"""Session helpers: table access, the shared folder and written intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table, as the driver lays it out: ``<sf_dir>/<name>.parquet``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(app: str = "stratalens", cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench share."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share.

    It is read from ``spark.checkpoint.dir``. Where that is unset (tests on one
    machine) a temporary folder is made once and set on the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="stratalens-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage with a table that outlives lost executors. The files go
    when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stratalens-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a table that is broadcast; a row of the tables concerned is below 200 bytes.
BROADCAST_ROWS = 500_000


def sized_broadcast(df: DataFrame, most: int = BROADCAST_ROWS, written: bool = False) -> tuple[DataFrame, bool]:
    """``df`` written once (if it isn't yet), and whether it has no more than ``most`` rows; if so it is marked for broadcast."""
    held = df if written else materialize(df, "sized")
    small = held.limit(most + 1).count() <= most
    return (F.broadcast(held) if small else held), small


#: Parts a hot key of the larger side is split into where the other side can't be broadcast.
SALTS = 16


def lookup_join(rows: DataFrame, held: DataFrame, on: list[str], how: str, spread: str, condition: Column | None = None, most: int = BROADCAST_ROWS, written: bool = False) -> DataFrame:
    """``rows`` joined to the smaller table ``held`` on null-safe equal ``on``, and ``condition`` if given.

    ``held`` is broadcast where it has no more than ``most`` rows. Beyond that
    both are shuffled by the keys and a salt of ``spread``, which splits a hot
    key of ``rows`` among tasks and repeats ``held``. The columns of ``on`` come
    from ``rows``. ``how`` is one of inner, left, left_semi and left_anti.
    ``written`` says that ``held`` is a written table.
    """
    other, small = sized_broadcast(held, most, written)
    named = other.select(*[F.col(c).alias(f"__{c}") for c in on], *[c for c in held.columns if c not in on])
    equal = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on]
    if small:
        named = F.broadcast(named)
    else:
        rows = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
        named = named.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        equal.append(F.col("__salt") == F.col("__part"))
    whole = equal[0]
    for more in equal[1:] + ([] if condition is None else [condition]):
        whole = whole & more
    return rows.join(named, whole, how).drop("__salt", "__part", *[f"__{c}" for c in on])


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path).getParent()
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may already be gone
        pass
