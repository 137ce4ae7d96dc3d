"""A service over an upload folder: files arrive as a stream; searchable files, texts and progress are its tables."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quire import engine
from quire.sources import sinks
from quire.sources.documents import Rasterizer, landing

#: A job over documents, given what keeps its intermediate tables.
Job = Callable[[DataFrame, Callable[[DataFrame], DataFrame]], engine.Result]

EVENTS = "array<struct<stage:string,current:int,total:int,message:string>>"


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system, if it exists."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _events(docs: DataFrame, told: list[tuple[str, int, int, str]]) -> DataFrame:
    steps = F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(t, ("stage", "current", "total", "message")))) for t in told)).cast(EVENTS)
    return docs.select(F.col("doc_id").alias("job_id"), F.posexplode(steps).alias("seq", "e")).select("job_id", "seq", "e.*")


def serve(
    spark: SparkSession, folder: str, out: str, job: Job, rasterizer: Rasterizer | None = None, dpi: int = 200, per_batch: int = 100, remove: bool = True
) -> DataStreamWriter:
    """The stream that works on files as they arrive in `folder`; the caller sets its trigger and starts it.

    Below `out` it writes files (doc_id, content), texts (doc_id, text) and events (job_id, seq, stage, current, total,
    message), a folder for each batch, overwritten if the batch is repeated. If a batch fails its documents are tried one
    by one; those that fail have an event with the error and no file. Intermediate tables go when their batch is done,
    uploads (with `remove`) once a later batch is.
    """

    def batch(docs: DataFrame, n: int) -> None:
        session = docs.sparkSession
        docs = docs.persist()

        def tables(part: int) -> dict[str, str]:
            return {name: f"{out}/{name}/batch={n}/part={part}" for name in ("files", "texts", "events")}

        def attempt(some: DataFrame, part: int) -> None:
            work, number, to = f"{out}/work/{n}-{part}", count(), tables(part)

            def keep(df: DataFrame) -> DataFrame:
                path = f"{work}/{next(number)}"
                df.write.mode("overwrite").parquet(path)
                return session.read.schema(df.schema).parquet(path)

            try:
                result = job(some, keep)
                engine.output_files(result, some, rasterizer, dpi).write.mode("overwrite").parquet(to["files"])
                sinks.job_texts(result.lines).write.mode("overwrite").parquet(to["texts"])
                _events(some, result.progress).write.mode("overwrite").parquet(to["events"])
            except Exception:
                for path in to.values():
                    removed(session, path)
                raise
            finally:
                removed(session, work)

        try:
            try:
                attempt(docs, 0)
            except Exception:
                # at most per_batch of them
                for part, row in enumerate(docs.select("doc_id").collect(), 1):
                    one = docs.where(F.col("doc_id") == F.lit(row.doc_id))
                    try:
                        attempt(one, part)
                    except Exception as e:
                        _events(one, [("convert", 0, 0, f"Error: {e}")]).write.mode("overwrite").parquet(tables(part)["events"])
        finally:
            docs.unpersist()

    stream = landing(spark, folder, per_batch, remove)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/checkpoint")
