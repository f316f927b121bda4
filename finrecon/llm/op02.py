"""Query op2: sampled segmentations of documents and their round trip, as digests."""

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from finrecon.llm import segmentation as sg
from finrecon.llm.frames import in_arrow, own, table

SEED = 20
SCHEMA = "doc_id long, n_pieces long, n_bytes long, ids_crc32 long, decoded_sha256 string, lossless boolean"


def _digests(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = sg.lattices_of(model)
        for batch in batches:
            texts = batch.column(1)
            for first, ids, size in sg.encoded(texts, sg.row_seeds(batch.column(0), SEED), lattices):
                back = sg.decoded_texts(ids, size, lattices)
                given = [(texts[first + i].as_py() or "").encode("utf-8", "surrogatepass") for i in range(len(size))]
                stop = np.cumsum(size)
                sums = [zlib.crc32(ids[b - n : b].astype("<u4").tobytes()) for b, n in zip(stop.tolist(), size.tolist(), strict=True)]
                columns = (size, [len(t) for t in back], sums)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(size)), *(pa.array(c, pa.int64()) for c in columns), pa.array([hashlib.sha256(t).hexdigest() for t in back]), pa.array([a == b for a, b in zip(back, given, strict=True)])],
                    [c.split()[0] for c in SCHEMA.split(", ")],
                )

    return run


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_arrow(own(table(spark, sf_dir, "documents"), "doc_id", "text"), _digests(public_tokenizers.path("piece_bpe_32k.model")), SCHEMA)
