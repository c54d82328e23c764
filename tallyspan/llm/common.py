"""What several operators share: tables in the shared folder, bounded id filters, salted joins, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the filter in ``keep_likely``: a table of at most 256 rows of 4 KiB.
FILTER_BITS = 1 << 23
#: A key is hot that holds more than this part of a table's rows, so at most as many keys are; and the fewest rows of a hot key.
HOT_PART, HOT_ROWS = 1000, 256
#: Rows that one task may join: a table with no more is joined as it is, as no key can hold more.
TASK_ROWS = 1 << 18
#: Rows of an Arrow batch of texts, so that neither the JVM nor Python holds many texts at once.
ARROW_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, one of our own, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    found = found or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tallyspan-")
    return found


def small_batches(spark: SparkSession) -> str:
    """Let Arrow batches of this session hold ARROW_ROWS rows at most; the setting before."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, ARROW_ROWS if int(was) <= 0 else min(int(was), ARROW_ROWS))
    return was


@contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """A new folder in the shared one for working tables, deleted at the end. Meanwhile Arrow batches hold ARROW_ROWS rows at most."""
    folder = f"{shared_dir(spark)}/tallyspan-{uuid.uuid4().hex}"
    was = small_batches(spark)
    try:
        yield folder
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Compute now and cut the lineage: the rows are written as a table in ``folder``, else in the shared one, and read back."""
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores after it, such that ``df`` has no column of that name in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def salted(many: DataFrame, one: DataFrame, on: str, how: str = "inner", task_rows: int | None = None) -> DataFrame:
    """many join one on a key that is unique in ``one``, though a few keys may hold a large part of ``many``.

    Keys with more than one in HOT_PART of the rows are hot. There are fewer than HOT_PART of them, so their list is broadcast. Their rows are dealt
    over so many salts that each has about that part, and their row of ``one`` is repeated once a salt. ``many`` is read
    several times, so it should be a table. Null keys join nothing. A table of at most ``task_rows`` rows (TASK_ROWS if not given) is
    joined without salts.
    """
    rows = many.count()
    if rows <= (TASK_ROWS if task_rows is None else min(task_rows, TASK_ROWS)):
        return many.join(one, on, how)
    most = max(HOT_ROWS, rows // HOT_PART)
    hot = many.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("salt_rows")).where(F.col("salt_rows") > most)
    hot = hot.select(on, F.ceil(F.col("salt_rows") / most).cast("int").alias("salts")).hint("broadcast")
    left = many.join(hot, on, "left").withColumn("salt", F.pmod(F.xxhash64(*many.columns), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    right = one.join(hot, on, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return left.join(right, [on, "salt"], how).drop("salt")


def keep_likely(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key may be in the one column of ``wanted``: all that are, and few others.

    A bitmap of FILTER_BITS hashed keys, at most 1 MB whatever the number of keys, is broadcast; a later join drops the
    rest. With very many keys more rows pass, so the result stays right and only the saving shrinks.
    """
    slot = F.pmod(F.xxhash64(F.col(wanted.columns[0]).cast("long")), F.lit(FILTER_BITS))
    bits = wanted.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("filter_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("filter_bits"))
    bits = bits.hint("broadcast")
    mine = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(FILTER_BITS))
    cols = df.columns
    place = F.bitmap_bit_position(mine)
    byte = F.expr("cast(conv(hex(substring(filter_bits, cast(filter_place div 8 as int) + 1, 1)), 16, 10) as int)")
    joined = df.withColumn("filter_slot", F.bitmap_bucket_number(mine)).withColumn("filter_place", place)
    joined = joined.join(bits, F.col("filter_slot") == F.col("filter_part"))
    return joined.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(filter_place % 8 as int))")) != 0).select(*cols)


def components(links: DataFrame, folder: str | None = None) -> DataFrame:
    """(node, label): for each node of the links (a, b) the smallest node that links lead to, itself included.

    Minimum labels spread along links and are then looked up in each other, which halves the distance to the minimum in
    each round; a node with very many links receives one partial minimum from each task. Rounds go on until nothing
    changes, and each is written as a table in ``folder``, or in the shared folder.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), folder)
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    labels = cut(labels, folder)
    while True:
        near = salted(both, labels.select(F.col("node").alias("b"), F.col("label").alias("m")), "b").groupBy("a").agg(F.min("m").alias("m"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "m").alias("to"), F.col("label").alias("was"))
        step = cut(step, folder)
        far = labels.select(F.col("node").alias("to"), F.col("label").alias("far"))
        step = cut(salted(step, far, "to", "left").select("node", F.least("to", F.coalesce("far", "to")).alias("label"), "was"), folder)
        labels = step.select("node", "label")
        if step.where("label <> was").isEmpty():
            return labels


def slices[T: (pa.Array, pa.RecordBatch)](parts: Iterator[T], rows: int = 256) -> Iterator[T]:
    """The arrays or batches of an Arrow function in pieces of a few rows, so that Python objects of whole batches never stand side by side."""
    for part in parts:
        yield from (part.slice(a, rows) for a in range(0, max(1, len(part)), rows))
