"""A Merkle manifest of a dataset: one tree of sha256 digests per source, one tree over the sources' roots, and a proof per row.

Checkpoint and recompute. Of the levels of a tree only every second one is written (``STORED``): a stored node stands for an
aligned subtree of ``FAN ** STORED`` nodes of the stored level below. The level between is never kept. Proofs are taken from
the top down: the stored nodes of a subtree meet the path of their root, the missing level is computed again from them, each node's siblings
are given out, and the level is dropped. So a proof's rows are read once, no task holds more than one subtree, and what is stored
beside the leaves is a 256th of them.

Leaves are numbered within their source by a range partitioning on (source, doc_id, leaf), so a source that holds a third of all rows
is spread over tasks like any other; offsets are sums over one row per partition and source.

Digests are lowercase hex, inputs are concatenated as text. A leaf is the digest of its fields, each ``-`` if null, else its number of UTF-8
bytes, ``:`` and the value.

Defined results: a row without id comes before all others of its source; rows with equal ids are ordered by their leaf, and equal rows are
leaves of their own, which of them takes which place makes no difference to the set of results; null sources are a
source of their own, the first; a null or empty text is a field like any other; other columns play no part. A single leaf is its own subroot, a single
subroot is the root; without siblings a proof is the digest of no bytes. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foreshock.llm.near_dup import grouped
from foreshock.sources.tables import cut_lineage

#: Nodes that make one node of the next level.
FAN = 16
#: Levels from one stored level to the next.
STORED = 2
SUBTREE = FAN**STORED

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ---- leaves ----------------------------------------------------------------------------------------------


def leaf_hash(values: dict[str, str]) -> str:
    """SQL for the leaf of a row whose fields are the given expressions."""
    parts = [f"coalesce(concat(octet_length(CAST({v} AS STRING)), ':', CAST({v} AS STRING)), '-')" for v in values.values()]
    return f"sha2(concat({', '.join(parts)}), 256)"


def leaves(docs: DataFrame, tampered: str | None = None) -> DataFrame:
    """``doc_id, source, leaf`` of every row, and with the SQL condition ``tampered`` the leaf that rows for which it holds have after
    their text is lower-cased (null for others)."""
    plain = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(source AS STRING) AS source", "lang", "n_chars", "CAST(text AS STRING) AS text")
    own = {f: f for f in FIELDS}
    changed = "CAST(NULL AS STRING)"
    if tampered:
        changed = f"CASE WHEN {tampered} THEN {leaf_hash(own | {'text': f"translate(text, '{UPPER}', '{LOWER}')"})} END"
    return plain.selectExpr("doc_id", "source", f"{leaf_hash(own)} AS leaf", f"{changed} AS changed")


# ---- places ----------------------------------------------------------------------------------------------


def _count_runs(key: str):
    """Numbers the runs of equal ``key`` of a sorted partition, and the rows within each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run_no, at, last = TaskContext.get().partitionId(), -1, 0, object()
        for batch in batches:
            runs, places = [], []
            for value in batch.column(key).to_pylist():
                if value != last:
                    run_no, at, last = run_no + 1, 0, value
                runs.append(run_no)
                places.append(at)
                at += 1
            columns = [*batch.columns, pa.array([part] * len(runs), pa.int64()), pa.array(runs, pa.int64()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "part", "run", "at"])

    return run


def placed(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """``rows`` with ``p``, their place from 0 among those of equal ``key`` in the given order (nulls first), ``n``, the number
    of those, and ``tree``, the place of the key among all keys. Equal rows are kept apart by the partition they are read from."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names, columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), rows.columns
    keyed = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranged = keyed.repartitionByRange(parts, key, *order, "_tie").sortWithinPartitions(key, *order).select(*columns)
    written = cut_lineage(ranged.mapInArrow(_count_runs(key), f"{names}, part BIGINT, run BIGINT, at BIGINT"))

    runs = cut_lineage(written.groupBy("part", "run").agg(F.first(key).alias(key), F.count("*").alias("rows")))
    whole = Window.partitionBy(key)
    before = F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("part", "run", key, F.coalesce(before, F.lit(0)).alias("before"), F.sum("rows").over(whole).alias("n"))
    # a key begins in one partition only, so keys are numbered by the partitions' numbers of beginnings
    runs = runs.withColumn("begins", F.when(F.col("before") == 0, 1).otherwise(0))
    heads = runs.groupBy("part").agg(F.sum("begins").alias("heads"))  # a row per partition
    earlier = F.sum("heads").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    heads = heads.select("part", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    # inside a partition only the first run may have begun before
    first = F.min(F.when(F.col("run") == 0, F.col("begins"))).over(Window.partitionBy("part"))
    tree = F.col("earlier") + F.col("run") - 1 + first
    numbered = cut_lineage(runs.join(heads, "part").select("part", "run", "before", "n", tree.alias("tree")))
    return written.join(numbered, ["part", "run"]).select(*columns, (F.col("before") + F.col("at")).alias("p"), "n", "tree")


# ---- subtrees --------------------------------------------------------------------------------------------


class Step(NamedTuple):
    """One level of a proof: the siblings before and after the node, their digests one after another."""

    left: str
    right: str


def climb(nodes: list[str], n: int) -> tuple[list[list[str]], int]:
    """The levels of a subtree from its lowest stored nodes up to its root, and the number of nodes of the whole tree at the root's
    level; ``n`` is that number at the lowest. A whole tree ends at its root."""
    levels = [nodes]
    for _ in range(STORED):
        if n == 1:
            break
        below = levels[-1]
        levels.append([digest(*below[i : i + FAN]) for i in range(0, len(below), FAN)])
        n = -(-n // FAN)
    return levels, n


def siblings(levels: list[list[str]], i: int) -> list[Step]:
    """Steps of node ``i`` of the lowest level to the root of the subtree."""
    steps = []
    for level in levels[:-1]:
        low = i - i % FAN
        steps.append(Step("".join(level[low:i]), "".join(level[i + 1 : low + FAN])))
        i //= FAN
    return steps


def fold(node: str, steps: list[Step]) -> str:
    """The root that a node and its siblings give."""
    for step in steps:
        node = digest(step.left, node, step.right)
    return node


_NODE = pa.schema([("tree", pa.int64()), ("p", pa.int64()), ("n", pa.int64()), ("hash", pa.string())])
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
NODE = "tree BIGINT, p BIGINT, n BIGINT, hash STRING"
PATH = "path ARRAY<STRUCT<left: STRING, right: STRING>>"


def _together(rows: DataFrame, *order: str) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "tree", "g").sortWithinPartitions("tree", "g", *order)


def _root(table: pa.Table) -> pa.Table:
    levels, n = climb(table.column("hash").to_pylist(), table.column("n")[0].as_py())
    return pa.table([table.column("tree")[:1], table.column("g")[:1], [n], levels[-1]], schema=_NODE)


def stored_levels(nodes: DataFrame) -> list[DataFrame]:
    """The stored levels above ``nodes`` (tree, p, n, hash; a written table), each with the roots of trees that end there
    (n = 1), until all have ended. ``nodes`` are the first."""
    levels = [nodes]
    while not (open_ := levels[-1].where("n > 1")).isEmpty():
        subtrees = _together(open_.select("tree", F.expr(f"p div {SUBTREE}").alias("g"), "p", "n", "hash"), "p")
        levels.append(cut_lineage(subtrees.mapInArrow(grouped(["tree", "g"], _root, _NODE), NODE)))
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """``tree, hash`` of the root of every tree."""
    found = [level.where("n = 1").select("tree", "hash") for level in levels]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


# ---- proofs ----------------------------------------------------------------------------------------------


def _expander(columns: list[str], emit: Callable, schema: pa.Schema):
    """Subtrees with the path of their root; ``emit(row, steps, base)`` makes a result row of each node's row, its proof and the
    root of its tree."""

    def run(table: pa.Table) -> pa.Table | None:
        above = [Step(s["left"], s["right"]) for s in table.column("path")[0].as_py()]  # the path comes first
        base = table.column("base")[0].as_py()
        rows = table.slice(1)
        levels, _ = climb(rows.column("hash").to_pylist(), rows.column("n")[0].as_py())
        out = [emit(row, siblings(levels, i) + above, base) for i, row in enumerate(rows.select(columns).to_pylist())]
        return pa.Table.from_pylist(out, schema=schema)

    return grouped(["tree", "g"], run, schema)


def _expand(nodes: DataFrame, paths: DataFrame, emit: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
    """``emit``'s rows for ``nodes``; ``paths`` (tree, g, path, base) has one row for each of their subtrees."""
    columns = nodes.columns
    rows = nodes.withColumn("g", F.expr(f"p div {SUBTREE}")).withColumn("path", F.lit(None).cast(PATH.split(" ", 1)[1])).withColumn("kind", F.lit(1))
    above = paths.withColumn("kind", F.lit(0))
    both = _together(rows.unionByName(above, allowMissingColumns=True), "kind", "p")
    return both.mapInArrow(_expander(columns, emit, schema), ddl)


_PATHS = pa.schema([("tree", pa.int64()), ("g", pa.int64()), ("path", _PATH), ("base", pa.string())])
PATHS = f"tree BIGINT, g BIGINT, {PATH}, base STRING"


def _path_of(row: dict, steps: list[Step], base: str) -> dict:
    return {"tree": row["tree"], "g": row["p"], "path": [s._asdict() for s in steps], "base": base}


def proofs(levels: list[DataFrame], lowest: DataFrame, above: DataFrame, emit: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
    """``emit``'s rows for all of ``lowest``, the rows behind ``levels[0]`` with columns of their own. ``above`` (tree, path, base) is what
    follows each tree's root, and that root."""
    paths = None
    for k in range(len(levels) - 1, -1, -1):
        ends = levels[k].where("n = 1").select("tree", F.lit(0).cast("bigint").alias("g")).join(above, "tree")
        paths = ends if paths is None else ends.unionByName(paths)
        if k:
            paths = cut_lineage(_expand(levels[k], paths, _path_of, _PATHS, PATHS))
    return _expand(lowest, paths, emit, schema, ddl)


class Manifest(NamedTuple):
    """A dataset's tree: ``rows`` (doc_id, source, leaf, changed, tree, p, n), the stored levels of the sources' trees, those of the tree
    over the sources, and the root (None for an empty dataset)."""

    rows: DataFrame
    levels: list[DataFrame]
    top: list[DataFrame]
    root: str | None


def manifest(docs: DataFrame, tampered: str | None = None) -> Manifest:
    """Builds and stores the tree of ``docs``."""
    rows = cut_lineage(placed(cut_lineage(leaves(docs, tampered)), "source", "doc_id", "leaf"))
    levels = stored_levels(rows.selectExpr("tree", "p", "n", "leaf AS hash"))
    subroots = cut_lineage(roots(levels))
    count = subroots.count()
    top = stored_levels(cut_lineage(subroots.selectExpr("0L AS tree", "tree AS p", f"{count}L AS n", "hash")))
    root = roots(top).first()
    return Manifest(rows, levels, top, root["hash"] if root else None)


def dataset_proofs(m: Manifest, emit: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
    """``emit(row, steps, subroot)`` for every row of the dataset, with its steps to the root."""
    start = m.rows.sparkSession.createDataFrame([(0, [], m.root)], f"tree BIGINT, {PATH}, base STRING")
    over = proofs(m.top, m.top[0], start, _path_of, _PATHS, PATHS).select(F.col("g").alias("tree"), "path")
    above = cut_lineage(over.join(m.top[0].selectExpr("p AS tree", "hash AS base"), "tree"))
    lowest = m.rows.withColumnRenamed("leaf", "hash")
    return proofs(m.levels, lowest, above, emit, schema, ddl)


def _proof(row: dict, steps: list[Step], subroot: str) -> dict:
    return {"doc_id": row["doc_id"], "leaf": row["hash"], "proof": [s._asdict() for s in steps]}


def merkle_proofs(docs: DataFrame) -> DataFrame:
    """Every row's proof: ``doc_id, leaf, proof``, the siblings before and after its node at each level, from its leaf to the root."""
    schema = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("proof", _PATH)])
    return dataset_proofs(manifest(docs), _proof, schema, "doc_id BIGINT, leaf STRING, " + PATH.replace("path", "proof", 1))


# ---- the query -------------------------------------------------------------------------------------------

_CHECKED = pa.schema(
    [("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())]
)


def _checked(row: dict, steps: list[Step], subroot: str) -> dict:
    """Digest of a proof, and the root that it gives for the leaf as it is found."""
    return {
        "doc_id": row["doc_id"], "leaf": row["hash"], "subroot": subroot,
        "proof_sha256": digest(*(x for s in steps for x in s)), "folded_root": fold(row["changed"] or row["hash"], steps),
    }


def verified(docs: DataFrame, tampered: str) -> DataFrame:
    """Every row with its leaf, subroot, the root, the digest of its proof, the root folded from its leaf (after the change, where the
    SQL condition ``tampered`` holds) and whether it is the dataset's."""
    m = manifest(docs, tampered)
    rows = dataset_proofs(m, _checked, _CHECKED, "doc_id BIGINT, leaf STRING, subroot STRING, proof_sha256 STRING, folded_root STRING")
    out = rows.withColumn("root", F.lit(m.root).cast("string"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return verified(docs, "crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0")


ORACLE_OP12 = r"""
WITH RECURSIVE
fields AS (
  SELECT row_number() OVER () AS row_no, doc_id, source, lang, n_chars, text,
         list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ord(substr(doc_id::VARCHAR, i::INT, 1))::UBIGINT)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
             lambda a, k: xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))) AS crc
  FROM documents),
parts AS (
  SELECT row_no, doc_id, source, doc_id IS NOT NULL AND xor(crc, 4294967295::UBIGINT) % 5 = 0 AS hit,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS body,
         coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS low
  FROM fields),
hashed AS (
  SELECT row_no, doc_id, source, sha256(head || body) AS leaf,
         CASE WHEN hit THEN sha256(head || low) ELSE sha256(head || body) END AS found FROM parts),
-- DuckDB orders text bytewise
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, row_no) - 1 AS p, count(*) OVER (PARTITION BY source) AS n,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM hashed),
low_tree(tree, lvl, i, n, h) AS (
  SELECT tree, 0, p, n, leaf FROM placed
  UNION ALL
  SELECT tree, lvl + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM low_tree WHERE n > 1 GROUP BY tree, lvl, i // 16, n),
subs AS (SELECT tree, h, lvl FROM low_tree WHERE n = 1),
top_tree(lvl, i, n, h) AS (
  SELECT 0, tree, (SELECT count(*) FROM subs), h FROM subs
  UNION ALL
  SELECT lvl + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM top_tree WHERE n > 1 GROUP BY lvl, i // 16, n),
steps AS (
  SELECT tree, lvl, i, i // 16 AS up, coalesce(string_agg(h, '') OVER (PARTITION BY tree, lvl, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER (PARTITION BY tree, lvl, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM low_tree WHERE n > 1),
top_steps AS (
  SELECT lvl, i, i // 16 AS up, coalesce(string_agg(h, '') OVER (PARTITION BY lvl, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER (PARTITION BY lvl, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM top_tree WHERE n > 1),
climb(row_no, tree, lvl, i, h, proof) AS (
  SELECT row_no, tree, 0, p, found, '' FROM placed
  UNION ALL
  SELECT c.row_no, c.tree, c.lvl + 1, s.up, sha256(s.l || c.h || s.r), c.proof || s.l || s.r FROM climb c JOIN steps s ON s.tree = c.tree AND s.lvl = c.lvl AND s.i = c.i),
reached AS (SELECT c.row_no, c.tree, c.h, c.proof, s.h AS subroot FROM climb c JOIN subs s ON s.tree = c.tree AND s.lvl = c.lvl),
over(row_no, lvl, i, h, proof) AS (
  SELECT row_no, 0, tree, h, proof FROM reached
  UNION ALL
  SELECT c.row_no, c.lvl + 1, s.up, sha256(s.l || c.h || s.r), c.proof || s.l || s.r FROM over c JOIN top_steps s ON s.lvl = c.lvl AND s.i = c.i),
root AS (SELECT lvl, h FROM top_tree WHERE n = 1)
SELECT p.doc_id, p.leaf, q.subroot, root.h AS root, sha256(o.proof) AS proof_sha256, o.h AS folded_root, o.h = root.h AS verified
FROM placed p JOIN reached q ON q.row_no = p.row_no JOIN over o ON o.row_no = p.row_no JOIN root ON root.lvl = o.lvl
"""
