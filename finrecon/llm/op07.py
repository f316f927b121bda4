"""Query op7: audio columns of documents, as digests."""

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from finrecon.llm import media
from finrecon.llm.frames import in_arrow, table

SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def described(stream: bytes, runs: list[dict]) -> str:
    """Frames, mean and deviation of the stored bands, and the time spans of the segments."""
    mel = media.bands_of(stream)
    spans = ",".join(f"{r['start_s']:.3f}-{r['end_s']:.3f}" for r in runs)
    return f"frames={len(mel)};mean={','.join(f'{v:.3f}' for v in mel.mean(axis=0))};deviation={','.join(f'{v:.3f}' for v in mel.std(axis=0))};segments={spans}"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for stored, stream, runs, n in zip(*(batch.column(c).to_pylist() for c in ("media", "log_mel", "segments", "n_bytes")), strict=True):
            _, back = media.samples_of(stored)
            rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-media.UNIT :]), len(stored), hashlib.sha256(stored).hexdigest(), described(stream, runs)))
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [c.split()[0] for c in SCHEMA.split(", ")])


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_arrow(media.media_columns(table(spark, sf_dir, "documents")), _digests, SCHEMA)
