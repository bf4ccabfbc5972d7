"""Text log files as a stream: lines numbered in each session, across files and micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PLACED = "session_id long, file string, block long, i long, line string"


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the lines of each block of a file; a block is read by one task, in order."""
    now, i = None, 0
    for batch in batches:
        at = []
        for key in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()):
            now, i = (key, 0) if key != now else (now, i + 1)
            at.append(i)
        yield pa.RecordBatch.from_arrays([batch.column("session_id"), batch.column("file"), batch.column("block"), pa.array(at, pa.int64()), batch.column("line")], [c.split()[0] for c in _PLACED.split(", ")])


class Number(StatefulProcessor):
    """How many lines a session has had; a micro-batch's lines follow in the order of files, blocks, places."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("lines", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        held = self.count.get()
        n = held[0] if held else 0
        # bounded by the files of a trigger
        for r in sorted(rows, key=lambda r: (r["file"], r["block"], r["i"])):
            yield Row(session_id=key[0], seq=n, line=r["line"])
            n += 1
        self.count.update((n,))

    def close(self) -> None:
        pass


def text_stream(spark: SparkSession, path: str, options: dict[str, str], session: Column, line: Column | None = None) -> DataFrame:
    """raw_logs of the text files that arrive in ``path``; the session needs ``use_rocksdb``. Files of one
    trigger are taken by name, those of later triggers after them, so ``seq`` is what ``read_logs`` gives for
    all of them where names rise with arrival. A file must be whole when it appears. ``session`` and ``line`` are
    made of a text line's columns file, block and line; the number of a line is that among its session's."""
    lines = spark.readStream.format("text").options(lineSep="\n", **options).load(path)
    keyed = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    placed = keyed.select(session.alias("session_id"), "file", "block", (F.col("line") if line is None else line).alias("line")).mapInArrow(_placed, _PLACED)
    return placed.groupBy("session_id").transformWithState(Number(), "session_id long, seq long, line string", "Append", "None")
