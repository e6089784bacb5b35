"""The change stream: JSON entries in a spool folder, applied batch by batch with Structured Streaming."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = "struct<id:string,text:string,meta:string>"
ENTRY = f"op string, path string, chunks array<{CHUNK}>, _corrupt_record string"


def spool_stream(spark: SparkSession, folder: str, files_per_batch: int = 100, clean: str = "off", archive: str | None = None) -> DataFrame:
    """Entries of the folder's JSON files as a stream, with the file's name and the place of the part that was read. Consumed files may be archived."""
    reader = spark.readStream.schema(ENTRY).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    reader = reader.option("maxFilesPerTrigger", files_per_batch).option("cleanSource", clean)
    if archive:
        reader = reader.option("sourceArchiveDir", archive)
    return reader.json(folder).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("at"))


def valid(entries: DataFrame) -> DataFrame:
    """Entries that can be applied; malformed lines, unknown operations and entries without a path are left out."""
    return entries.where("_corrupt_record is null and path is not null and (op = 'remove' or op = 'file' and chunks is not null)")


def poison(entries: DataFrame) -> DataFrame:
    """What ``valid`` leaves out, for a dead-letter table."""
    return entries.where("not coalesce(_corrupt_record is null and path is not null and (op = 'remove' or op = 'file' and chunks is not null), false)")


def latest(entries: DataFrame) -> DataFrame:
    """The last entry of each path, in order of file name and place: earlier ones of a batch have no effect."""
    order = Window.partitionBy("path").orderBy(F.col("file").desc(), F.col("at").desc(), F.col("line").desc())
    placed = entries.withColumn("line", F.monotonically_increasing_id())
    return placed.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n", "line")


def applied(table: DataFrame, entries: DataFrame) -> DataFrame:
    """``table(path, id, text, meta)`` after a batch: a path's chunks are replaced or, by ``remove``, dropped.

    Applying a batch twice gives the same table, so a batch that is run again after a failure does no harm.
    """
    last = latest(valid(entries))
    kept = table.join(last.select("path"), "path", "left_anti")
    new = last.where("op = 'file'").select("path", F.explode("chunks").alias("c")).select("path", "c.id", "c.text", "c.meta")
    return kept.select("path", "id", "text", "meta").unionByName(new)


def counts(entries: DataFrame) -> DataFrame:
    """``action, n`` of a batch: files, removes and skipped entries."""
    kind = F.when(F.col("_corrupt_record").isNotNull() | F.col("path").isNull(), "skipped").when(F.col("op").isin("file", "remove"), F.col("op")).otherwise("skipped")
    return entries.groupBy(kind.alias("action")).agg(F.count("*").alias("n"))


def drain(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]):
    """Apply what is in the spool now, batch by batch. An error leaves its batch pending for the next call."""
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def file_entries(chunks: DataFrame) -> DataFrame:
    """Change events ``op, path, chunks`` of ``chunks(path, id, text, meta)``."""
    return chunks.groupBy("path").agg(F.lit("file").alias("op"), F.collect_list(F.struct("id", "text", "meta")).alias("chunks")).select("op", "path", "chunks")


def remove_entries(paths: DataFrame) -> DataFrame:
    return paths.select(F.lit("remove").alias("op"), "path", F.lit(None).cast(f"array<{CHUNK}>").alias("chunks"))


def names_in_order(folder: str | Path) -> list[str]:
    """Pending files by name, which is the order they were written in."""
    return sorted(p.name for p in Path(folder).glob("*.jsonl"))


def write(folder: str | Path, entries: list[dict]) -> Path | None:
    """Put entries into the spool as one file, which is there whole or not at all. No entries, no file.

    Names begin with the time in UTC down to microseconds, so they sort in the order of writing. A file's modification
    time is its name's, so that a stream, which goes by that, takes files in the same order.
    """
    if not entries:
        return None
    Path(folder).mkdir(parents=True, exist_ok=True)
    now = time.time_ns() // 1000
    while True:
        stamp = datetime.fromtimestamp(now / 1e6, UTC).strftime("%Y%m%dT%H%M%S%f")
        path = Path(folder, f"{stamp}.jsonl")
        if not path.exists():
            break
        now += 1
    temp = path.with_suffix(".tmp")
    with temp.open("w", encoding="utf-8") as f:
        f.writelines(json.dumps(e, ensure_ascii=False) + "\n" for e in entries)
        f.flush()
        os.fsync(f.fileno())
    os.utime(temp, ns=(now * 1000, now * 1000))
    os.replace(temp, path)
    return path


def done(folder: str | Path, name: str) -> None:
    """Mark a file as applied."""
    os.replace(Path(folder, name), Path(folder, name + ".done"))


def swept(folder: str | Path, seconds: float = 24 * 3600.0, now: float | None = None) -> int:
    """Delete files that were applied so long ago; gives their number."""
    before, n = (time.time() if now is None else now) - seconds, 0
    for p in Path(folder).glob("*.done"):
        if p.stat().st_mtime <= before:
            p.unlink()
            n += 1
    return n


def ids_by_path(table: DataFrame) -> DataFrame:
    """``path, ids``: the state that changes are held against, derived from the table, so that it is never out of step."""
    return table.groupBy("path").agg(F.array_sort(F.collect_set("id")).alias("ids"))
