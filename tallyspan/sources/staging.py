"""Tables in the folder that driver and executors share, digests of tables whatever their order, and a sink that verifies what it wrote."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import identity

#: Hexadecimal digits of a limb of a row's hash: sums of limbs fit a long up to 2^47 rows.
LIMB = 4
LIMBS = 64 // LIMB
#: Limbs that are read as one number, which a long holds.
AT_ONCE = 3


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, a new one, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tallyspan-")
    return found


def place(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """The rows as a table in the shared folder, computed now."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_hash(df: DataFrame) -> Column:
    """SHA-256 of a row: its columns in order of name, each with its length, nulls apart from texts. Other types count as their text."""
    fields = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in sorted(df.columns)]
    return F.sha2(identity.preimage(*fields), 256)


def _reads(hashed: Column) -> dict[str, Column]:
    """A row's hash as numbers of AT_ONCE limbs each; a column each, so that what several limbs read is worked out once."""
    size = AT_ONCE * LIMB
    return {f"staging_read{i}": F.conv(F.substring(hashed, i * size + 1, size), 16, 10).cast("long") for i in range(-(-LIMBS // AT_ONCE))}


def _limbs() -> list[Column]:
    """The sums of each limb of the numbers that ``_reads`` gives."""

    def at(i: int) -> Column:
        read, place = divmod(i, AT_ONCE)
        after = min(AT_ONCE, LIMBS - read * AT_ONCE) - 1 - place
        return F.shiftright(f"staging_read{read}", 4 * LIMB * after).bitwiseAND(F.lit((1 << 4 * LIMB) - 1).cast("long"))

    return [F.coalesce(F.sum(at(i)), F.lit(0)).alias(f"limb{i}") for i in range(LIMBS)]


def _digest(rows: int, limbs: list[int]) -> str:
    import hashlib

    return hashlib.sha256(",".join(map(str, [rows, *limbs])).encode()).hexdigest()


def digest(df: DataFrame) -> DataFrame:
    """One row (rows, digest) of a table as a multiset: it doesn't change with the order of rows or tasks, and with any row, column or copy it does.

    Each row's hash is cut into limbs, and their sums are hashed; so it is an ordinary aggregate that combines before the shuffle.
    """
    return digests(df.withColumn("tag", F.lit("all")), "tag", {"all": ("all",)}).drop("run")


def digests(df: DataFrame, tag: str, runs: dict[str, tuple[str, ...]]) -> DataFrame:
    """(run, rows, digest) of tables that share rows, in one pass: ``runs`` names the tags of each one's rows. The column ``tag`` is not digested."""
    hashed = df.select(tag, row_hash(df.drop(tag)).alias("h"))
    sums = hashed.select(tag, *[c.alias(name) for name, c in _reads(F.col("h")).items()]).groupBy(tag).agg(F.count("*").alias("rows"), *_limbs())
    names = ["rows", *[f"limb{i}" for i in range(LIMBS)]]
    of = lambda tags, c: F.coalesce(F.sum(F.when(F.col(tag).isin(*tags), F.col(c))), F.lit(0)).alias(c)
    whole = sums.agg(*[F.struct(F.lit(run).alias("run"), *[of(tags, c) for c in names]).alias(f"run{i}") for i, (run, tags) in enumerate(runs.items())])
    told = whole.select(F.explode(F.array(*whole.columns)).alias("x")).select("x.*")
    return told.select("run", "rows", F.sha2(F.concat_ws(",", *names).cast("binary"), 256).alias("digest"))


class NotVerified(RuntimeError):
    """What was read back is not what was written."""


def publish(df: DataFrame, path: str, replace: bool = False) -> str:
    """Write df as the table at path, or nothing at all; its digest.

    The rows go to a folder beside path and are digested as they are written; that folder is read back and digested again. Only if both agree is
    it renamed to path, else it is deleted and NotVerified raised. An existing table makes it fail before anything is
    written, unless ``replace``; then the old one is moved aside and deleted after the rename.
    """
    spark = df.sparkSession
    whole = spark._jvm.org.apache.hadoop.fs.Path
    folder, staged, old = whole(path), whole(f"{path}.staged-{uuid.uuid4().hex}"), whole(f"{path}.old-{uuid.uuid4().hex}")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(folder) and not replace:
        raise FileExistsError(path)
    seen = Observation()
    reads = _reads(F.col("staging_row_hash"))
    hashed = df.withColumn("staging_row_hash", row_hash(df)).withColumns(reads)
    sums = [F.count("*").alias("rows"), *_limbs()]
    try:
        hashed.observe(seen, *sums).drop("staging_row_hash", *reads).write.parquet(staged.toString())
        got = seen.get
        written = _digest(got["rows"], [got[f"limb{i}"] for i in range(LIMBS)])
        back = digest(spark.read.schema(df.schema).parquet(staged.toString())).first()
        if back["digest"] != written:
            raise NotVerified(path)
        if fs.exists(folder) and not fs.rename(folder, old):
            raise NotVerified(path)
        if not fs.rename(staged, folder):
            fs.rename(old, folder)
            raise NotVerified(path)
    finally:
        for gone in (staged, old):
            fs.delete(gone, True)
    return written
