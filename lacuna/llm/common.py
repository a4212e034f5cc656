"""What several operators of this subpackage share: cut lineage, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark's setting by which a finished query's shuffle files are deleted.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode, where it is unset,
    a folder of this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    at = tempfile.mkdtemp(prefix="lacuna-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def free_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lacuna-{uuid.uuid4().hex}"


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends here, a lost executor
    costs nothing that was written, and later readers prune columns. With a path, df's rows are further ones of that table."""
    spark = df.sparkSession
    path = path or free_path(spark)
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")  # what was shuffled for the table goes once it is written, not when the driver next collects garbage
    try:
        df.write.mode("append").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table of a frame that cut() returned, once nothing reads it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    path = jvm.org.apache.hadoop.fs.Path(df.cut_path)
    path.getFileSystem(conf).delete(path, True)


def free_name(name: str, taken: list[str]) -> str:
    """`name`, with underscores before it until no column of `taken` has it (case aside)."""
    while name.lower() in {c.lower() for c in taken}:
        name = f"_{name}"
    return name


def crc_fold(id_col) -> F.Column:
    """crc32 of the id written as text, modulo 4."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi join in which null keys are equal; the keys come once, from the left."""
    right = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = F.lit(True)
    for c in keys:
        on &= F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(right, on, how).drop(*[f"_r_{c}" for c in keys])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges` (u, v: any orderable type) -> (node, root), root the smallest node.

    Alternating large-star and small-star steps: each step replaces a node's links by links to the smallest
    neighbour, so the number of edges never grows and long chains halve. A step is one grouped minimum
    (combined before the shuffle) and one equi join, which adaptive execution splits where a root holds very
    many links. Every step is written to the shared folder. Null ends and self links are ignored; no edges
    give no rows.
    """
    now = cut(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )

    def stamp(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = stamp(now)
    if not before[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = cut(small)
        after = stamp(now)
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
