"""Near duplicates by SimHash, found with multi-index hashing.

A fingerprint has 64 bits; a bit is set if it is set in more than half of the hashes of a text's word shingles. Each fingerprint is cut
into two segments of 32 bits. Two fingerprints that differ in at most three bits differ in at most one bit of one segment, so
each fingerprint is entered in a table under both segments, looks up the Hamming ball of radius one around both of its
own (of two segments one bit apart, the one with the bit set looks up the other), and every match is verified on all bits.

Equal fingerprints are one entry, whatever the number of texts. A segment shared by more than ``CROWD`` different fingerprints would
give a number of matches that grows with the square, so such crowds, with all fingerprints one bit away from them, go another exact
way whose work is in proportion to their size: fingerprints that share a point of their balls of radius one (65 points) are at most
two bits apart and are linked to the smallest of them; what is then still in different components of a crowd looks up
the points two bits away in the same table. No match is capped or dropped.

Defined results: a null text and a text without words have fingerprint zero and are linked like any other; fewer words than a shingle are
one shingle; rows with equal ids are taken as they come; a row without id has its fingerprint's component but names none (null if no row of the
component has an id). Other columns play no part. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foreshock.llm.components import contract
from foreshock.llm.hot import lookup, sized_broadcast
from foreshock.sources.tables import cut_lineage

#: Largest number of differing bits of linked fingerprints; the two segments, their balls and the points are made for it.
BITS = 3
SEED = 42
#: Different fingerprints under one segment beyond which they are compared by points instead of one by one.
CROWD = 128
#: Shingles hashed at once.
_PIECE = 1 << 15

_SEGMENT_BALL = [0, *(1 << p for p in range(32))]
_BIT_MASKS = [(1 << p) - (1 << 64) * (p == 63) for p in range(64)]


def fingerprint(text: bytes, n: int = 3) -> int:
    """The fingerprint of a text's ``n``-word shingles, repeats included; A-Z count as a-z."""
    words = text.lower().split()  # of bytes: ASCII letters, and runs of the six ASCII spaces
    if not words:
        return 0
    joined, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    begins = ends - size
    k = min(n, len(words))
    begins, ends = begins[: len(words) - k + 1], ends[k - 1 :]
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(begins), _PIECE):
        cuts = zip(begins[at : at + _PIECE].tolist(), ends[at : at + _PIECE].tolist())
        h = np.array([digest(joined[a:b], SEED) for a, b in cuts], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(begins), bitorder="little")
    return int(bits.view(np.uint64)[0])


def _printer(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            prints = [fingerprint(t.as_py(), n) if t.is_valid else 0 for t in texts]
            fp = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fp], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, n: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp`` of every row, whole texts; the 64 bits of ``fp`` as a signed number."""
    plain = docs.selectExpr(f"CAST(`{doc_id}` AS BIGINT) AS doc_id", f"CAST(`{text}` AS STRING) AS text")
    return plain.mapInArrow(_printer(n), "doc_id BIGINT, fp BIGINT")


def _entries(prints: DataFrame) -> DataFrame:
    """Each fingerprint under both of its segments: ``key, fp``. The second segment's keys are told apart by bit 32."""
    keys = F.expr("array(shiftrightunsigned(fp, 32), (fp & 4294967295) | 4294967296)")
    return prints.select(F.explode(keys).alias("key"), "fp")


def _ball(of: str, masks: list[int]) -> F.Column:
    return F.explode(F.array(*[F.lit(m).cast("bigint") for m in masks])).alias(of)


def _matches(entries: DataFrame) -> DataFrame:
    """Verified links between fingerprints that meet in a segment or one bit beside it."""
    probes = entries.select("key", "fp", _ball("mask", _SEGMENT_BALL)).where("mask = 0 OR key & mask <> 0")
    probes = probes.selectExpr("key ^ mask AS key", "fp AS a", "mask")
    met = probes.join(entries.withColumnRenamed("fp", "b"), "key")
    return met.where(f"(mask <> 0 OR a < b) AND bit_count(a ^ b) <= {BITS}").select("a", "b")


def _crowd_points(crowd: DataFrame) -> DataFrame:
    """Points within one bit of a fingerprint of a crowd: ``z`` and the fingerprints around it, 65 at most."""
    points = crowd.select("fp", _ball("mask", [0, *_BIT_MASKS])).selectExpr("fp ^ mask AS z", "fp")
    return points.groupBy("z").agg(F.collect_list("fp").alias("around"))


def _crowd_rest(members: DataFrame, labels: DataFrame, points: DataFrame) -> DataFrame:
    """Links of three bits between components of a crowd. Of two such fingerprints one is outside the crowd's largest component;
    that one looks up the points two bits away."""
    placed = cut_lineage(members.join(labels.withColumnRenamed("node", "fp"), "fp"))
    sizes = placed.groupBy("crowd", "comp").agg(F.count("*").alias("size"))
    main = sizes.groupBy("crowd").agg(F.max(F.struct("size", "comp")).alias("main"), F.count("*").alias("comps"))
    main = main.where("comps > 1").selectExpr("crowd", "main.comp AS main")
    outside = placed.join(sized_broadcast(main), "crowd").where("comp <> main").select("fp").distinct()
    flips = F.array(*[F.lit(m).cast("bigint") for m in _BIT_MASKS])
    two = outside.select("fp", F.posexplode(flips).alias("p1", "m1")).select("fp", "p1", "m1", F.posexplode(flips).alias("p2", "m2"))
    two = two.where("p1 < p2")
    met = two.selectExpr("fp ^ m1 ^ m2 AS z", "fp AS a").join(points.selectExpr("z", "around[0] AS b"), "z")
    return met.where("a <> b").select("a", "b")


def linked(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Components of different fingerprints ``fp`` linked at ``BITS`` or fewer differing bits: ``node, comp`` for all that
    have a link."""
    entries = cut_lineage(_entries(prints))
    crowds = cut_lineage(entries.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("key"))
    if crowds.isEmpty():
        links = cut_lineage(_matches(entries))
        return contract(_labels(links), links)

    spare = entries.join(sized_broadcast(crowds), "key", "left_anti")
    near = crowds.select(F.col("key").alias("crowd"), _ball("mask", _SEGMENT_BALL)).selectExpr("crowd ^ mask AS key", "crowd")
    members = cut_lineage(entries.join(sized_broadcast(near), "key").select("crowd", "fp"))
    points = cut_lineage(_crowd_points(members.select("fp").distinct()))
    stars = points.where("size(around) > 1").selectExpr("explode(around) AS a", "array_min(around) AS b").where("a <> b")
    links = cut_lineage(_matches(spare).unionByName(stars.distinct()))
    labels = _labels(links.unionByName(members.selectExpr("fp AS a", "fp AS b")))
    labels = contract(labels, links)
    return contract(labels, cut_lineage(_crowd_rest(members, labels, points)))


def _labels(links: DataFrame) -> DataFrame:
    return cut_lineage(links.selectExpr("explode(array(a, b)) AS node").distinct().selectExpr("node", "node AS comp"))


def simhash_components(docs: DataFrame, n: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id``, the smallest id that links reach."""
    rows = cut_lineage(fingerprints(docs, n, doc_id, text))
    prints = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    labels = linked(prints.select("fp")).withColumnRenamed("node", "fp")
    classes = cut_lineage(prints.join(labels, "fp", "left").selectExpr("fp", "first", "n", "coalesce(comp, fp) AS comp"))
    smallest = classes.groupBy("comp").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    named = lookup(classes.select("fp", "comp", F.col("n").alias("size")), smallest, "comp")
    named = cut_lineage(named.selectExpr("fp", "component_id", "size AS n"))
    out = lookup(rows, named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
