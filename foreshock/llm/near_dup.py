"""Near duplicates by min-max hashing: every permutation gives a minimum and a maximum, so a signature of ``2 * k``
values costs ``k`` hash evaluations. Bands of the values propose pairs; each link is confirmed on the full sets.

Texts with equal shingle sets form one node, so thousands of copies cost one row each. In a bucket of the bands,
nodes are first compared with one hub, the node that shares buckets with most others; that joins true copies without listing
their pairs. Buckets that then still hold several components are gone through in blocks: nodes outside a bucket's largest component
meet all its nodes, a bounded number of each per block, and every pair of different components whose signatures are near enough is
compared on the full sets, in the first bucket that both share. Blocks give out links between components, never pairs. No pair
that could join two components is left out, and none inside a component is compared.

At the default parameters a pair exactly at the threshold shares no band with a probability below 1e-6, and falls below
the share of equal signature values asked for in blocks with one below 1e-8.

Defined results: texts without words have an empty set and are linked with nothing; fewer words than a shingle make
one element; rows with equal ids are taken as they come; a row without id keeps its own text's class but names no
component itself (its component is the smallest id there is, or null, and it is kept when none has one). Empty
tables give empty results. Sets are held as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foreshock.llm.components import contract
from foreshock.llm.hot import lookup
from foreshock.llm.words import Texts, grams, mix, seeds, slices
from foreshock.sources.tables import cut_lineage

#: Shingles compared in one task's group at most, beyond the hub's and one text's own.
GROUP_SHINGLES = 200_000

#: Nodes of a block on either side, about.
BLOCK = 256
#: Signature values that may differ before a pair of a block is not compared, in shares of the threshold.
SLACK = 0.75

SIGNATURES = "doc_id BIGINT, text_hash BIGINT, n_shingles BIGINT, node BIGINT, bands ARRAY<BIGINT>, marks BINARY"


def shingle_sets(texts: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, one text after another, and where each text's begin."""
    words = texts.hashes()
    runs = grams(words, n)
    sets = []
    for low, high in zip(texts.bounds[:-1].tolist(), texts.bounds[1:].tolist()):
        if high - low >= n:
            sets.append(np.unique(runs[low : high - n + 1]))
        elif high > low:
            sets.append(grams(words[low:high], high - low) ^ np.uint64(high - low))
        else:
            sets.append(words[:0])
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else words), np.concatenate([[0], np.cumsum(sizes)])


def nodes(shingles: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A hash of each text's set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingles ^ np.uint64(0x5DEECE66D)), dtype=np.uint64)])
    return mix(total[begins[1:]] - total[begins[:-1]] + np.diff(begins).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def min_max_bands(shingles: np.ndarray, begins: np.ndarray, rows: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys of each non-empty set, half the bands from minima and half from maxima of the same permutations, and a
    byte of each signature value."""
    filled = begins[:-1][np.diff(begins) > 0]
    k = rows * bands // 2
    factor, shift = seeds(k, 11) | np.uint64(1), seeds(k, 12)
    low, high = np.empty((k, len(filled)), np.uint64), np.empty((k, len(filled)), np.uint64)
    for j in range(k if len(filled) else 0):
        value = shingles * factor[j] + shift[j]
        low[j], high[j] = np.minimum.reduceat(value, filled), np.maximum.reduceat(value, filled)
    step, out = seeds(1, 13)[0] | np.uint64(1), []
    for side in (low, high):
        for band in range(bands // 2):
            key = np.full(len(filled), len(out), np.uint64)
            for row in side[band * rows : (band + 1) * rows]:
                key = mix(key * step + row)
            out.append(key)
    marks = (np.concatenate([low, high]) * step >> np.uint64(56)).astype(np.uint8)
    return np.stack(out, axis=1), np.ascontiguousarray(marks.T)


def _signer(n: int, rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column("text")):
                shingles, begins = shingle_sets(texts, n)
                sizes = np.diff(begins)
                filled = sizes > 0
                keys, marks = min_max_bands(shingles, begins, rows, bands)
                bytes_ = np.concatenate([[0], np.cumsum(np.where(filled, marks.shape[1], 0))]).astype(np.int32)
                ends = np.concatenate([[0], np.cumsum(np.where(filled, keys.shape[1], 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(texts)),
                        batch.column("text_hash").slice(at, len(texts)),
                        pa.array(sizes),
                        pa.array(nodes(shingles, begins).view(np.int64), mask=~filled),
                        pa.ListArray.from_arrays(ends, keys.ravel().view(np.int64)),
                        pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(bytes_), pa.py_buffer(marks.ravel())]),
                    ],
                    ["doc_id", "text_hash", "n_shingles", "node", "bands", "marks"],
                )

    return run


def _keyer(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column("text")):
                shingles, begins = shingle_sets(texts, n)
                keys, rows = pa.array(nodes(shingles, begins).view(np.int64)), batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(np.diff(begins)), keys, rows.column("text")], ["doc_id", "n_shingles", "node", "text"]
                )

    return run


def _known(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id), F.lit(-(2**63)))


def grouped(keys: list[str], run, schema: pa.Schema):
    """Calls ``run`` on the rows of each key of partitions sorted by keys; many small groups cost one batch."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for k in keys:
                column = batch.column(k).to_numpy(zero_copy_only=False)
                new[1:] |= column[1:] != column[:-1]
                new[0] |= bool(held) and column[0] != held[-1].column(k)[-1].as_py()
            cuts, at, out = np.flatnonzero(new).tolist(), 0, []
            for cut in cuts:
                held += [batch.slice(at, cut - at)] if cut > at else []
                if held:
                    out.append(run(pa.Table.from_batches(held)))
                held, at = [], cut
            held.append(batch.slice(at))
            yield from _batches(out, schema)
        if held:
            yield from _batches([run(pa.Table.from_batches(held))], schema)

    return over


def _batches(parts: list, schema: pa.Schema) -> list[pa.RecordBatch]:
    parts = [p for p in parts if p is not None and p.num_rows]
    return pa.concat_tables(parts).cast(schema).combine_chunks().to_batches() if parts else []


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _sets(table: pa.Table, n: int) -> dict[int, np.ndarray]:
    sets = {}
    for _, texts in slices(table.column("text")):
        shingles, begins = shingle_sets(texts, n)
        found = nodes(shingles, begins).view(np.int64)
        for i in range(len(texts)):
            sets.setdefault(int(found[i]), shingles[begins[i] : begins[i + 1]])
    return sets


def _near(own: np.ndarray, other: np.ndarray, percent: int) -> bool:
    if not len(own) or not len(other) or 100 * min(len(own), len(other)) < percent * max(len(own), len(other)):
        return False
    place = np.minimum(np.searchsorted(other, own), len(other) - 1)
    common = int((other[place] == own).sum())
    return 100 * common >= percent * (len(own) + len(other) - common)


def _star(n: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Nodes of the group that are near enough to its hub."""
        sets, hub = _sets(table, n), table.column("hub")[0].as_py()
        links = [x for x in set(table.column("node").to_pylist()) - {hub} if _near(sets[x], sets[hub], percent)]
        return pa.table({"a": pa.array(links, pa.int64()), "b": pa.array([hub] * len(links), pa.int64())})

    return run


def _links(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (node, hub) whose full sets are similar enough. A hub with many partners is dealt over groups of
    bounded size, each with one copy of the hub's text."""
    sizes = texts.select("node", "n_shingles")
    load = pairs.join(sizes, "node").groupBy("hub").agg(F.sum("n_shingles").alias("load"), F.count("*").alias("n"))
    dealt = lookup(pairs, load, "hub").selectExpr(
        "hub", "node", f"CAST(pmod(xxhash64(node), ceil(load / {GROUP_SHINGLES})) AS BIGINT) AS part"
    )
    both = dealt.unionByName(dealt.selectExpr("hub", "hub AS node", "part").distinct())
    rows = _together(both.join(texts.select("node", "text"), "node"), ["hub", "part"])
    return cut_lineage(rows.mapInArrow(grouped(["hub", "part"], _star(n, percent), _LINK), "a BIGINT, b BIGINT"))


def _together(rows: DataFrame, keys: list[str]) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys)


_BLOCK_KEYS = ["band", "part", "side"]
_WANTED = pa.schema([("band", pa.int64()), ("part", pa.int64()), ("side", pa.int64()), ("node", pa.int64()), ("comp", pa.int64()), ("outer", pa.bool_())])


def _pick(percent: int):
    def run(table: pa.Table) -> pa.Table | None:
        """Nodes of a block that have a partner to be compared with there."""
        outer = table.column("outer").to_numpy(zero_copy_only=False)
        node, comp, size = (table.column(c).to_numpy() for c in ("node", "comp", "n_shingles"))
        bands = np.stack(table.column("bands").to_numpy(zero_copy_only=False))
        marks = np.stack([np.frombuffer(m, np.uint8) for m in table.column("marks").to_pylist()])
        a, b = np.flatnonzero(outer), np.flatnonzero(~outer)
        near = comp[a][:, None] != comp[b][None, :]
        near &= 100 * np.minimum(size[a][:, None], size[b][None, :]) >= percent * np.maximum(size[a][:, None], size[b][None, :])
        x, y = np.nonzero(near)
        x, y = a[x], b[y]
        keep = np.zeros(len(x), bool)
        for i in range(0, len(x), 1 << 14):
            p, q = x[i : i + (1 << 14)], y[i : i + (1 << 14)]
            same = bands[p] == bands[q]
            keep[i : i + (1 << 14)] = bands[p, same.argmax(axis=1)] == table.column("band")[0].as_py()
            keep[i : i + (1 << 14)] &= (marks[p] == marks[q]).mean(axis=1) >= SLACK * percent / 100
        rows = np.unique(np.concatenate([x[keep], y[keep]]))
        return table.take(pa.array(rows)).select(_WANTED.names) if len(rows) else None

    return run


def _block(n: int, percent: int):
    def run(table: pa.Table) -> pa.Table | None:
        """Links of a block, one for each node outside and each component that it is near to."""
        sets = _sets(table, n)
        outer = table.column("outer").to_numpy(zero_copy_only=False)
        node, comp = table.column("node").to_numpy(), table.column("comp").to_numpy()
        links = []
        for i in np.flatnonzero(outer).tolist():
            joined = {int(comp[i])}
            for j in np.flatnonzero(~outer).tolist():
                if int(comp[j]) not in joined and _near(sets[int(node[i])], sets[int(node[j])], percent):
                    joined.add(int(comp[j]))
                    links.append((int(node[i]), int(node[j])))
        return pa.table({"a": [x for x, _ in links], "b": [x for _, x in links]}, schema=_LINK) if links else None

    return run


def _rest(members: DataFrame, labels: DataFrame, info: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links between components that still share a bucket."""
    placed = cut_lineage(members.select("band", "node").join(labels, "node"))
    sizes = placed.groupBy("band", "comp").agg(F.count("*").alias("size"))
    split = sizes.groupBy("band").agg(
        F.max(F.struct("size", "comp")).alias("main"), F.count("*").alias("comps"), F.sum("size").alias("total")
    )
    split = split.where("comps > 1").selectExpr(
        "band", "main.comp AS main", f"ceil(total / {BLOCK}) AS parts", f"ceil((total - main.size) / {BLOCK}) AS sides"
    )
    open_ = placed.join(split, "band")
    inner = open_.selectExpr(
        "band", "pmod(xxhash64(node, 1), parts) AS part", "explode(sequence(0L, sides - 1)) AS side", "node", "comp", "false AS outer"
    )
    outer = open_.where("comp <> main").selectExpr(
        "band", "explode(sequence(0L, parts - 1)) AS part", "pmod(xxhash64(node, 2), sides) AS side", "node", "comp", "true AS outer"
    )
    rows = inner.unionByName(outer).join(info, "node")
    schema = "band BIGINT, part BIGINT, side BIGINT, node BIGINT, comp BIGINT, outer BOOLEAN"
    wanted = _together(rows, _BLOCK_KEYS).mapInArrow(grouped(_BLOCK_KEYS, _pick(percent), _WANTED), schema)
    wanted = _together(cut_lineage(wanted).join(texts.select("node", "text"), "node"), _BLOCK_KEYS)
    return cut_lineage(wanted.mapInArrow(grouped(_BLOCK_KEYS, _block(n, percent), _LINK), "a BIGINT, b BIGINT"))


def near_duplicates(
    docs: DataFrame, n: int = 5, percent: int = 80, rows: int = 4, bands: int = 30, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept, text_hash``. Texts are linked when ``100 *
    intersection >= percent * union`` of their sets of ``n``-word shingles."""
    plain = docs.selectExpr(f"CAST(`{doc_id}` AS BIGINT) AS doc_id", f"CAST(`{text}` AS STRING) AS text")
    signed = cut_lineage(plain.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_signer(n, rows, bands), SIGNATURES))
    distinct = signed.where("node IS NOT NULL").select("node", F.explode("bands").alias("band")).distinct()
    shared = distinct.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    members = cut_lineage(distinct.join(shared, "band"))

    known = members.groupBy("node").agg(F.sum("size").alias("met"))
    hubs = members.join(known, "node").groupBy("band").agg(F.max(F.struct("met", "node")).alias("hub")).selectExpr("band", "hub.node AS hub")
    pairs = cut_lineage(members.join(hubs, "band").where("node <> hub").select("node", "hub").distinct())

    info = signed.where("node IS NOT NULL").groupBy("node").agg(
        F.min(_known("doc_id")).alias("doc_id"), F.max("n_shingles").alias("n_shingles"), F.max("marks").alias("marks"), F.max("bands").alias("bands")
    )
    info = cut_lineage(info.join(known.select("node"), "node"))
    keyed = plain.mapInArrow(_keyer(n), "doc_id BIGINT, n_shingles BIGINT, node BIGINT, text STRING")
    held = keyed.withColumn("doc_id", _known("doc_id")).join(info.select("node", "doc_id"), ["node", "doc_id"])
    # one doc_id a node, so groups are those of nodes and lie where the join has put them
    one = held.groupBy("node", "doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("text").alias("text"))
    texts = cut_lineage(one.drop("doc_id"))

    labels = contract(info.selectExpr("node", "node AS comp"), _links(pairs, texts, n, percent))
    labels = contract(labels, _rest(members, labels, info.select("node", "n_shingles", "marks", "bands"), texts, n, percent))

    first = signed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    classes = first.join(labels, "node", "left").selectExpr("node", "coalesce(comp, node) AS comp", "first", "n")
    smallest = classes.groupBy("comp").agg(F.min("first").alias("component_id"))
    named = classes.join(smallest, "comp").select("node", "component_id", "n")
    signs = signed.select("doc_id", "text_hash", "n_shingles", "node")
    empty = signs.where("node IS NULL").withColumn("component_id", F.lit(None).cast("bigint"))
    out = lookup(signs.where("node IS NOT NULL"), named, "node").unionByName(empty)
    return out.selectExpr(
        "doc_id",
        "n_shingles",
        "CASE WHEN node IS NULL THEN doc_id ELSE component_id END AS component_id",
        "coalesce(node IS NULL OR doc_id = component_id, component_id IS NULL) AS kept",
        "text_hash",
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, the one with the smallest id; all columns stay. Repeated rows with
    that id and text count as one, rows without words are all kept."""
    flags = near_duplicates(docs).groupBy("doc_id", "text_hash").agg(
        F.max("kept").alias("kept"), F.count("*").alias("n"), F.max("n_shingles").alias("n_shingles")
    )
    some = cut_lineage(flags.where("NOT kept OR n > 1 AND n_shingles > 0").selectExpr("doc_id AS _id", "text_hash AS _hash", "kept AS _kept"))
    key = F.xxhash64(F.col("text").cast("string"))
    same = (key == F.col("_hash")) & F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id"))
    single = docs.join(some, same, "left_anti")
    repeated = some.where("_kept")
    if repeated.isEmpty():
        return single
    first = docs.join(repeated, same, "left_semi").withColumn("_key", key).dropDuplicates(["doc_id", "_key"]).drop("_key")
    return single.unionByName(first)


def op4_min_max_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, n=3, percent=85, rows=5, bands=24).drop("text_hash")


ORACLE_OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
                                          WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
comp AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(comp.low, w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(comp.low, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN comp ON comp.doc_id = w.doc_id
"""
