"""Saved versions of records: each batch is committed once, however often it is tried, and earlier versions can be had again.

A place holds rows/batch=N, the records that batch N wrote, and commits/batch=N, written last. A batch without its commit doesn't count: trying
it again writes it over. A batch that has its commit is left alone, so a stream that replays a batch changes nothing. Before the commit the
rows are read back and held against what was to be written. Nothing is ever overwritten that counts, so the state of every batch stays.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


class NotSaved(Exception):
    """What was read back is not what was written."""


def _exists(spark: SparkSession, place: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def _mark(spark: SparkSession, place: str, batch: int) -> None:
    spark.range(1).write.mode("overwrite").parquet(f"{place}/commits/batch={batch}")


def committed(spark: SparkSession, place: str, batch: int) -> bool:
    return _exists(spark, f"{place}/commits/batch={batch}/_SUCCESS")


def commit(rows: DataFrame, place: str, batch: int, id: str) -> bool:
    """Save rows as a batch, if it isn't saved yet; whether it was. rows: one for each id, all columns; ids are not null."""
    spark = rows.sparkSession
    if committed(spark, place, batch):
        return False
    own, names = f"{place}/rows/batch={batch}", rows.columns
    code = F.xxhash64(*[F.col(c) for c in names])
    sums = [F.count("*").alias("n"), F.bit_xor(code).alias("x"), F.sum(code.cast("decimal(38,0)")).alias("s")]
    rows.write.mode("overwrite").parquet(own)
    found = spark.read.schema(rows.schema).parquet(own).agg(*sums, F.count_distinct(id).alias("ids")).first().asDict()
    wanted, ids = rows.agg(*sums).first().asDict(), found.pop("ids")  # worked out anew, so it doesn't come from the write
    if found != wanted or ids != found["n"]:
        raise NotSaved(f"batch {batch}: {wanted} was to be written, {found} is read, of {ids} ids")
    _mark(spark, place, batch)
    return True


def rows_of(spark: SparkSession, place: str, schema, until: int | None = None) -> DataFrame:
    """All saved rows with their batch, of commits up to batch until."""
    done = spark.read.schema("id long, batch long").parquet(f"{place}/commits").select("batch").distinct()
    done = done.where(F.col("batch") <= until) if until is not None else done
    rows = spark.read.schema(schema).option("basePath", f"{place}/rows").parquet(f"{place}/rows").withColumn("batch", F.col("batch").cast("long"))
    return rows.join(done, "batch", "left_semi")


def state(spark: SparkSession, place: str, schema, id: str, until: int | None = None) -> DataFrame:
    """The last saved row of each id, up to batch until. The partition column is pruned by it, and maxima combine before the shuffle."""
    names = [f.name for f in schema.fields]
    full = type(schema)([*schema.fields]).add("batch", "long") if "batch" not in names else schema
    rows = rows_of(spark, place, full, until)
    return rows.groupBy(id).agg(F.max_by(F.struct(*[c for c in names if c != id]), "batch").alias("_r")).select(id, "_r.*").select(*names)


def restored(spark: SparkSession, place: str, schema, id: str, ids: DataFrame, before: int) -> DataFrame:
    """The rows of ids (column id) as they were before batch before; to be committed as a batch of their own."""
    return state(spark, place, schema, id, before - 1).join(ids.select(id).distinct(), id, "left_semi")


def save(stream: DataFrame, place: str, id: str) -> DataStreamWriter:
    """A stream's micro-batches as versions, each committed once. A batch has the last row of each id by _seq, which isn't saved."""

    def write(batch: DataFrame, number: int) -> None:
        names = [c for c in batch.columns if c not in (id, "_seq")]
        last = batch.groupBy(id).agg(F.max_by(F.struct(*names), "_seq").alias("_r")).select(id, "_r.*")
        commit(last, place, number, id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{place}/log")
