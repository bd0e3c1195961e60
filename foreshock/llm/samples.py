"""Labelled rows to learn from: a bounded sample with the texts they label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreshock.sources.tables import cut_lineage

#: Largest number of labelled rows that a classifier is fitted on.
SAMPLE = 20_000


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> DataFrame:
    """``label, text`` of at most ``sample`` labelled rows, the first ones in the order of a digest of the id, without those whose
    crc32 of the id leaves 0 when divided by 5 (held out). Rows without id or label do not count; of several labels
    of one id the largest holds. Only the chosen ids, a bounded number, are sent to the tasks that read the texts."""
    known = labels.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", f"CAST(`{label}` AS INT) AS label").dropna()
    known = known.where("crc32(CAST(doc_id AS STRING)) % 5 <> 0").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = cut_lineage(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    texts = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    return texts.join(F.broadcast(chosen), "doc_id")
