"""Tables written to shared storage between jobs, and joins whose broadcast is size-checked."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A side of a join is broadcast only when it has no more rows than this.
BROADCAST_ROWS = 100_000

#: Rows of a key on each side that meet in one group of a dealt join, and its most tasks.
CELL, MOST_TASKS = 4096, 20_000

#: Bytes of a batch that goes to a Python worker; one row may have more.
BATCH_BYTES = 2 << 20
_BATCH, _USUAL = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

#: Tables of the scopes that are open in this thread or task.
_scopes: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("scopes", default=())
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, else, in local mode, one beside the warehouse."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not is_local(spark):
        raise ValueError("spark.checkpoint.dir is not set: on a cluster it has to name a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_hashloom"


def is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def check_warehouse(spark: SparkSession) -> None:
    """On a cluster tables of the session need a warehouse that all executors share: its setting must name another place than Spark's own, the working folder."""
    told = spark.sparkContext.getConf().get("spark.sql.warehouse.dir", None) or spark.sparkContext.getConf().get("spark.hadoop.hive.metastore.warehouse.dir", None)
    if not told and not is_local(spark):
        raise ValueError("spark.sql.warehouse.dir is not set: on a cluster it has to name a folder that all executors share")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of a cluster, once a session's context; in local mode workers find it as the driver does."""
    context = spark.sparkContext
    if is_local(spark) or context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = os.path.dirname(os.path.abspath(__file__))
    at = os.path.join(tempfile.mkdtemp(), "hashloom.zip")  # the driver serves it from there
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.join("hashloom", os.path.relpath(os.path.join(folder, n), root)))
    context.addPyFile(at)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts the lineage: what follows is recomputed from files, not from the plan,
    when executors are lost. Unlike checkpoint() the plan runs once only. The
    files stay until discard() or the end of a scope().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hashloom/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    if _scopes.get():
        _scopes.get()[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables; nothing may read them any more."""
    for table in tables:
        if path := vars(table).get("written_to"):
            jvm = table.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
            table.written_to = None


@contextmanager
def scope() -> Iterator[None]:
    """Tables materialized inside, by this thread, are deleted at the end, so results have to be written or collected within."""
    own: list[DataFrame] = []
    before = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(before)
        discard(*own)


def tidy(tag: str) -> Callable:
    """Of an operator whose result is narrow: it is materialized, and what it was made from is deleted."""

    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(operator)
        def run(*args, **kwargs) -> DataFrame:
            own: list[DataFrame] = []
            before = _scopes.set((*_scopes.get(), own))
            try:
                made = operator(*args, **kwargs)
            except BaseException:
                discard(*own)
                raise
            finally:
                _scopes.reset(before)
            out = materialize(made, tag)
            discard(*own)
            return out

        return run

    return wrap


def sized(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it holds at most max_rows rows, else as it is.

    df should be a materialized table, as its rows are counted. Beyond the
    bound the join is a shuffle join whose large partitions adaptive execution
    splits.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def dealt_join(left: DataFrame, right: DataFrame, on: list[str], cell: int = CELL) -> DataFrame:
    """left joined with right on the named columns, where a key may have many rows on both sides.

    A key's rows are dealt by their hashes into parts of about cell rows on
    each side, and every part of one side meets every part of the other in a
    group of its own, so that no task makes a hot key's pairs alone. Tasks are
    as many as the pairs ask for, as adaptive execution would go by the bytes
    that are read. Both sides are read twice, so they should be materialized.
    """
    n = lambda df, name: df.groupBy(*on).agg(F.count("*").alias(name))
    both = n(left, "_l").join(n(right, "_r"), on)
    parts = lambda name: F.ceil(F.col(name) / cell).cast("int")
    counted = materialize(both.select(*on, parts("_l").alias("_l"), parts("_r").alias("_r"), (F.col("_l").cast("double") * F.col("_r")).alias("_pairs")), "dealt")
    pairs = counted.agg(F.sum("_pairs")).first()[0] or 0
    tasks = min(max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(pairs / cell / cell) + 1), MOST_TASKS)
    hot = sized(materialize(counted.filter("_l > 1 OR _r > 1").drop("_pairs"), "hot"))

    def deal(df: DataFrame, own: str, other: str) -> DataFrame:
        names = df.columns
        rows = df.join(hot, on, "left").withColumns({x: F.coalesce(x, F.lit(1)) for x in ("_l", "_r")})
        rows = rows.withColumn(own, F.pmod(F.xxhash64(*names), F.col(own)).cast("int"))
        rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return rows.select(*names, "_l", "_r").repartition(tasks, *on, "_l", "_r")

    return deal(left, "_l", "_r").join(deal(right, "_r", "_l"), [*on, "_l", "_r"]).drop("_l", "_r")


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose rows go to Python workers BATCH_BYTES at a time, unless the session has a bound of its own.

    An executor holds a batch several times for each of its tasks, outside
    the heap as well, and Spark's default is 64 MB. The bound is a setting of
    the session, as Spark has it for no single plan: it holds for all that the
    session sends to Python workers from then on, until usual_batches().
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == _USUAL:
        conf.set(_BATCH, str(BATCH_BYTES))
    return df


def usual_batches(spark: SparkSession) -> None:
    """Give the session back Spark's own bound of a batch."""
    spark.conf.unset(_BATCH)


def quoted(name: str) -> str:
    """A column's name as an expression, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality of the named columns of both sides."""
    out = F.lit(True)
    for n in names:
        out = out & left[n].eqNullSafe(right[n])
    return out
