"""Admission of files as they arrive: every file gets one verdict, and a refused one is moved to quarantine.

The stream carries names and sizes alone; contents are read in ``foreachBatch``, and only of files within the size limit. A micro-batch's verdicts
and events are one commit under the batch's own name, so a batch that runs again after a crash finds its verdicts, reads no file a second
time and merely finishes its moves. A move that was done before is no error. What goes through the driver is the names of one
micro-batch, at most ``files_per_batch``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text
from ..operators import versions
from ..sources import admission
from ..sources.commits import Store

FILE = "path string, modificationTime timestamp, length bigint, content binary"
VERDICT = "path string, name string, length bigint, checksum string, pages int, pdf_version string, verdict string"


def verdicts(files: DataFrame, max_bytes: int = admission.MAX_BYTES, max_pages: int = admission.MAX_PAGES) -> DataFrame:
    """A verdict for each of (path, name, declared_mime, length, content); what is refused has no checksum, pages or version."""
    judged = admission.admit(files, max_bytes, max_pages)
    ok = F.col("verdict") == "ok"
    told = lambda c: F.when(ok, c)
    return judged.select("path", "name", F.col("length").cast("bigint").alias("length"), told(text.checksum(F.col("content"))).alias("checksum"), told(admission.page_count(F.col("content")).cast("int")).alias("pages"), told(admission.pdf_version(F.col("content"))).alias("pdf_version"), "verdict")


def events(found: DataFrame) -> DataFrame:
    """What admitted files append to the log, by their path; refused files append one event of audit."""
    rows = found.select(F.col("path").alias("document_id"), "verdict")
    refused = rows.where("verdict != 'ok'").select("document_id", F.lit("audit").alias("entity"), F.concat(F.lit("REFUSED "), "verdict").alias("event"))
    return versions.uploads(rows).unionByName(refused)


class Sink:
    """``foreachBatch`` function that commits verdicts and events of a micro-batch, then hands on the refused paths."""

    def __init__(self, store: Store, judge: Callable[[DataFrame], DataFrame], move: Callable[[str], None] | None = None, name: str = "intake") -> None:
        self.store, self.judge, self.move, self.name = store, judge, move, name

    def __call__(self, batch: DataFrame, number: int) -> None:
        name = f"{self.name}-{number}"
        if self.store.committed(name) is None:
            found = self.judge(batch).persist()
            try:
                self.store.commit(name, {"verdicts": found.withColumn("batch", F.lit(name)), "events": events(found)})
            finally:
                found.unpersist()
        if self.move is not None:
            done = self.store.read("verdicts").where((F.col("batch") == name) & (F.col("verdict") != "ok"))
            for r in done.select("path").toLocalIterator():
                self.move(r["path"])


def mover(spark: SparkSession, source: str, quarantine: str) -> Callable[[str], None]:
    """Moves a file below ``source`` to its quarantine key below ``quarantine``; one that is gone was moved before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root = fs.makeQualified(path(source)).toUri().getPath().rstrip("/") + "/"

    def move(name: str) -> None:
        inner = path(name).toUri().getPath().removeprefix(root)
        target = path(f"{quarantine.rstrip('/')}/quarantine/{inner}")
        fs.mkdirs(target.getParent())
        if fs.exists(path(name)) and not fs.rename(path(name), target):
            raise OSError(f"{name} could not be moved to {target}")

    return move


def empty_files(spark: SparkSession, source: str) -> list[str]:
    """Files of no byte below a folder, which Spark's file sources pass over."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed, out = fs.listFiles(path(source), True), []
    while listed.hasNext():
        f = listed.next()
        if f.getLen() == 0:
            out.append(f.getPath().toString())
    return sorted(out)


def refuse_empty(spark: SparkSession, source: str, store: Store, move: Callable[[str], None]) -> None:
    """Give files of no byte their verdict and move them; those that had it before are only moved."""
    names = empty_files(spark, source)
    if not names:
        return
    had = {r["path"] for r in store.read("verdicts", f"{VERDICT}, batch string").where("verdict = 'EMPTY'").select("path").collect()}
    new = [(n,) for n in names if n not in had]
    if new:
        batch = "empty-" + uuid.uuid4().hex
        rows = spark.createDataFrame(new, "path string").select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(0).cast("bigint").alias("length"), F.lit(None).cast("string").alias("checksum"), F.lit(None).cast("int").alias("pages"), F.lit(None).cast("string").alias("pdf_version"), F.lit("EMPTY").alias("verdict"))
        store.commit(batch, {"verdicts": rows.withColumn("batch", F.lit(batch)), "events": events(rows)})
    for n in names:
        move(n)


def watch(spark: SparkSession, source: str, store: Store, checkpoint: str, quarantine: str, files_per_batch: int = 1000, max_bytes: int = admission.MAX_BYTES, max_pages: int = admission.MAX_PAGES, move: Callable[[str], None] | None = None) -> StreamingQuery:
    """Judge the files of a folder as they arrive; stops when all that are there have been judged."""
    arrived = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").load(source)

    def judge(batch: DataFrame) -> DataFrame:
        known = batch.select("path", F.col("length").alias("size")).collect()
        small = [r["path"] for r in known if r["size"] <= max_bytes]
        sizes = spark.createDataFrame([(r["path"], r["size"]) for r in known if r["size"] > max_bytes], "path string, length bigint")
        shape = lambda rows, verdict: rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", *verdict)
        none = [F.lit(None).cast(kind).alias(c) for c, kind in (("checksum", "string"), ("pages", "int"), ("pdf_version", "string"))]
        found = shape(sizes, [*none, F.lit("TOO_LARGE").alias("verdict")])
        if small:
            read = spark.read.format("binaryFile").load(small).withColumn("declared_mime", F.lit(None).cast("string"))
            found = verdicts(shape(read, ["declared_mime", "content"]), max_bytes, max_pages).unionByName(found)
        return found

    move = move or mover(spark, source, quarantine)
    refuse_empty(spark, source, store, move)
    sink = Sink(store, judge, move)
    return arrived.select("path", "length").writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
