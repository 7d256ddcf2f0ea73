"""Table extraction as a Structured Streaming job.

New report files arriving under ``root/<doc>/`` are parsed as they come
(``readStream.format("binaryFile")``). Each file is handled on its own: the
unit carry-over (D5) only looks at the tables of one file, so it doesn't
matter which files arrive together. A micro-batch is written to its own
``batch=<id>`` folder of the slots table and overwrites it when it is run
again, so a batch that fails half-way leaves no rows twice. Where files of
different batches have the same table id, ``extract.last_files`` over the
slots read back keeps the last file's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridwork.operators.extract import extract_tables, parse_pages
from gridwork.operators.units import normalize_tables
from gridwork.sources.io import stream_corpus


def start_extraction(spark: SparkSession, root: str, out_path: str, checkpoint: str,
                     normalize: bool = True, trigger_once: bool = False, ext: str = ".html"):
    """Start the stream; returns the ``StreamingQuery``."""
    pages = stream_corpus(spark, root, ext)
    raw = parse_pages(pages, kinds=["slot"])

    def sink(batch: DataFrame, epoch_id: int):
        out = extract_tables(batch)
        if normalize:
            out, _ = normalize_tables(out)
        out.write.mode("overwrite").partitionBy("doc_id").parquet(f"{out_path}/batch={epoch_id}")

    w = raw.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()
