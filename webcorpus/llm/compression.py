"""What operators 8 and 9 share: zstandard raw-content dictionaries and the size of a text compressed with each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, text_of

LEVEL = 3
#: Bytes of labelled text in a dictionary, and bytes that one text may add to it (from a place that its hash picks).
DICTIONARY_BYTES = 96 << 10
EXCERPT_BYTES = 1 << 10
#: Times as many texts as are needed that a first look at a label should give.
SPARE = 8


def excerpts(rows: DataFrame, label: str, per_label: int, counts: dict[str, int]) -> dict[str, list[bytes]]:
    """Up to ``per_label`` excerpts of each label of ``rows`` (label, doc_id, text), collected: of its texts with the least hashes.

    Documented bound: the dictionaries are fitted on these only. ``counts``: about how many rows a label has. Only texts
    whose hash is in the lowest share that should hold SPARE times as many leave their task, copies of a text being one row; where a label has many
    copies and too few texts come, the share grows until there are enough or all were seen.
    """
    size = F.octet_length("text")
    start = F.when(size > EXCERPT_BYTES, F.pmod(F.xxhash64("text"), F.greatest(size - EXCERPT_BYTES, F.lit(1)))).otherwise(0).cast("int")
    cut = rows.filter("text IS NOT NULL AND length(text) > 0 ").select(
        F.col(label).alias("label"), F.substring(F.col("text").cast("binary"), start + 1, F.lit(EXCERPT_BYTES)).alias("excerpt"), F.xxhash64("text").alias("h")
    )
    out: dict[str, list[bytes]] = {}
    share = {k: SPARE * per_label / max(1, n) for k, n in counts.items()}
    while share:
        least = [F.when((F.col("label") == k) & ((F.lit(x >= 1.0)) | (F.col("h") < F.lit(_bound(x)))), True) for k, x in share.items()]
        some = cut.filter(F.coalesce(*least, F.lit(False))).groupBy("label", "h").agg(F.min("excerpt").alias("excerpt"))
        best = Window.partitionBy("label").orderBy("h")  # few rows by now
        found: dict[str, list[bytes]] = {}
        for row in some.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= per_label).orderBy("label", "h").collect():
            found.setdefault(row["label"], []).append(bytes(row["excerpt"]))
        done = {k for k, x in share.items() if x >= 1.0 or len(found.get(k, [])) >= per_label}
        out |= {k: found[k] for k in done if k in found}
        share = {k: SPARE * x for k, x in share.items() if k not in done}
    return out


def _bound(share: float) -> int:
    """The 64-bit hash that about ``share`` of all are below."""
    return int(-(2**63) + min(1.0, share) * (2**64 - 1)) if share < 1.0 else 2**63 - 1


def dictionaries(found: dict[str, list[bytes]]) -> dict[str, bytes]:
    """Per label, its excerpts one after another up to DICTIONARY_BYTES."""
    return {k: b"\n".join(v)[:DICTIONARY_BYTES] for k, v in sorted(found.items())}


def compressors(contents: list[bytes]) -> list[zstandard.ZstdCompressor]:
    made = []
    for content in contents:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False))
    return made


def sizes(texts: DataFrame, contents: list[bytes], column: str = "text", chunk_bytes: int | None = None) -> DataFrame:
    """doc_id, n_bytes and sizes (array: the whole text compressed with each dictionary); map-only.

    With ``chunk_bytes``, consecutive chunks of so many bytes are compressed one by one and their sizes summed.
    """

    def size(compressor, text) -> int:
        step = chunk_bytes or max(1, len(text))
        return sum(len(compressor.compress(text[i : i + step])) for i in range(0, max(1, len(text)), step))

    def run(batches):
        made = compressors(contents)
        for batch in slices(batches, column):
            rows = [memoryview(x.as_buffer()) for x in pc.cast(text_of(batch, column), pa.binary())]
            found = np.array([[size(c, x) for c in made] for x in rows], np.int32).reshape(-1)
            offsets = np.arange(len(rows) + 1, dtype=np.int32) * len(made)
            n = pa.array([len(x) for x in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, pa.ListArray.from_arrays(offsets, pa.array(found, pa.int32()))], ["doc_id", "n_bytes", "sizes"])

    return texts.select("doc_id", column).mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, n_bytes long, sizes array<int>")
