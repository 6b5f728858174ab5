"""A Merkle manifest of a dataset: a digest of every row, of every source and of the whole, with proofs.

Rows are leaves; in each source they stand by id, and every ``FAN`` consecutive nodes become one of the next level until one is left. The
roots of the sources become the root of the dataset in the same way.

Positions come from a range partitioning: rows are dealt out and sorted by source, id and digest, counted by source and partition, and
each partition starts where those before it end, so no task ranks a whole source. Nodes are cut into aligned buckets of ``FAN ** levels``.
A task holds some whole buckets as one Arrow table and runs the levels in DuckDB, as ordered ``string_agg`` with ``sha256``. The bucket roots are the
nodes of the next round, of which there are few: a billion rows need three. Then the proofs go down the same way: each round joins the proof of a bucket's
root (one row, sorted in front of its bucket) to the siblings within the bucket.

Edge cases: null fields are ``-`` in a leaf. A null source is a source of its own, the first. Rows without an id come first in their source and are not
tampered with. Rows that share an id stand in order of their leaves; equal rows are a leaf each, next to each other, and any order of them gives the same digests.
A very long text is one digest. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactdq.llm.common import Scratch

FAN = 3
LEVELS = 7
HELD = 16_384  # rows from which a task hands its whole buckets to DuckDB
HEX = 64

_PATH = "array<struct<l:string,r:string>>"
_PATH_TYPE = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))


def digest(*fields: Column) -> Column:
    """sha256, in hex, of some fields, each as byte count, colon and value, or ``-`` if null."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*told), 256)


def depth(n: np.ndarray) -> np.ndarray:
    """Levels above n nodes until one is left."""
    out, reach = np.zeros(len(n), np.int64), np.ones(len(n), np.int64)
    while (more := reach < n).any():
        out += more
        reach = np.where(more, reach * FAN, reach)
    return out


def placed(scratch: Scratch, nodes: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``nodes`` with ``pos``, their place in their group by ``order``, and ``n``, the size of the group."""
    by = [F.col(group), *map(F.col, order)]
    dealt = scratch.keep(nodes.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("row", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("row", 33)
    counts = dealt.groupBy(F.col(group).alias("_g"), part.alias("_part")).agg(F.count("*").alias("k"), F.min("row").alias("first"))
    one = Window.partitionBy("_g")
    before = F.coalesce(F.sum("k").over(one.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = scratch.keep(counts.select("_g", "_part", (before - F.col("first")).alias("shift"), F.sum("k").over(one).alias("n")), "counts")
    met = dealt.withColumn("_part", part).alias("d").join(counts.alias("c"), F.col(f"d.{group}").eqNullSafe(F.col("c._g")) & (F.col("d._part") == F.col("c._part")))
    out = scratch.keep(met.select(*[f"d.{c}" for c in nodes.columns], (F.col("row") + F.col("shift")).alias("pos"), F.col("c.n").alias("n")), "placed")
    scratch.drop(dealt, counts)
    return out


class _Engine:
    """DuckDB for the buckets of one task: one thread, in memory."""

    def __init__(self, levels: int):
        self.levels = levels
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})

    def climb(self, nodes: pa.Table) -> None:
        """Tables ``level_0`` (the nodes: bucket ``b``, place ``p`` in it, digest ``h``, levels to go ``up``) to ``level_k``, with the run of each node."""
        self.db.register("held", nodes)
        self.db.execute("CREATE OR REPLACE TEMP TABLE level_0 AS SELECT * FROM held")
        for k in range(1, self.levels + 1):
            self.db.execute(
                f"""CREATE OR REPLACE TEMP TABLE level_{k} AS SELECT b, p, run, sha256(run) AS h, up FROM
                (SELECT b, p // {FAN} AS p, string_agg(h, '' ORDER BY p) AS run, any_value(up) AS up FROM level_{k - 1} WHERE up >= {k} GROUP BY b, p // {FAN})"""
            )

    def roots(self) -> list[str]:
        """The digest of each bucket, in order of their numbers."""
        every = " UNION ALL ".join(f"SELECT b, h FROM level_{k} WHERE up = {k}" for k in range(self.levels + 1))
        return [h for _, h in self.db.execute(f"SELECT b, h FROM ({every}) ORDER BY b").fetchall()]

    def _siblings(self, k: int) -> tuple[str, str]:
        """SQL for what stands left and right of a node of level k - 1 in its run; every digest has HEX characters."""
        at = f"{HEX} * ((c.p // {FAN ** (k - 1)}) % {FAN})"
        return f"left(n.run, {at})", f"substr(n.run, {at} + {HEX + 1})"

    def paths(self, outer: pa.Table) -> pa.Table:
        """For each node, in order: its siblings up to the root of its bucket and from there on (``outer``: ``b, path``)."""
        self.db.register("outer_paths", outer)
        sql = "SELECT b, p, [] :: STRUCT(l VARCHAR, r VARCHAR)[] AS path FROM level_0"
        for k in range(1, self.levels + 1):
            left, right = self._siblings(k)
            sql = f"SELECT c.b, c.p, CASE WHEN n.run IS NULL THEN path ELSE list_append(path, {{'l': {left}, 'r': {right}}}) END AS path FROM ({sql}) c LEFT JOIN level_{k} n ON n.b = c.b AND n.p = c.p // {FAN**k}"
        return self.db.sql(f"SELECT list_concat(c.path, o.path) AS path FROM ({sql}) c JOIN outer_paths o USING (b) ORDER BY c.b, c.p").to_arrow_table()

    def folded(self, outer: pa.Table, changed: pa.Table, longest: int) -> pa.Table:
        """For each node, in order: a digest of its whole proof, and the root that a changed node (``b, p, f``) leads to with the siblings as they were."""
        self.db.register("outer_paths", outer)
        self.db.register("changed", changed)
        sql = "SELECT b, p, f, '' AS proof FROM changed"
        for k in range(1, self.levels + 1):
            left, right = self._siblings(k)
            sql = f"SELECT c.b, c.p, CASE WHEN n.run IS NULL THEN f ELSE sha256({left} || f || {right}) END AS f, CASE WHEN n.run IS NULL THEN proof ELSE proof || {left} || {right} END AS proof FROM ({sql}) c LEFT JOIN level_{k} n ON n.b = c.b AND n.p = c.p // {FAN**k}"
        sql = f"SELECT c.*, o.path FROM ({sql}) c JOIN outer_paths o USING (b)"
        for m in range(1, longest + 1):
            step = f"path[{m}]"
            sql = f"SELECT b, p, path, CASE WHEN len(path) >= {m} THEN sha256({step}.l || f || {step}.r) ELSE f END AS f, CASE WHEN len(path) >= {m} THEN proof || {step}.l || {step}.r ELSE proof END AS proof FROM ({sql})"
        return self.db.sql(f"SELECT sha256(proof) AS proof, f FROM ({sql}) ORDER BY b, p").to_arrow_table()


def _whole_buckets(batches: Iterator[pa.RecordBatch], starts) -> Iterator[pa.Table]:
    """Rows of whole buckets together, from ``HELD`` rows on; ``starts`` says of a batch where buckets start."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        first = np.flatnonzero(starts(batch))
        # What stands before the last bucket of the batch is whole.
        cut = int(first[-1]) if len(first) else 0
        if len(first) and size + cut >= HELD:
            held.append(batch.slice(0, cut))
            if size + cut:
                yield pa.Table.from_batches(held)
            held, size, batch = [], 0, batch.slice(cut)
        held.append(batch)
        size += batch.num_rows
    if size:
        yield pa.Table.from_batches(held)


def _numbers(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(table.column(table.schema.get_field_index(name)).to_numpy(zero_copy_only=False))


def _nodes(table: pa.Table, levels: int) -> tuple[pa.Table, np.ndarray]:
    """The nodes of whole buckets for the engine, and where buckets start."""
    p = _numbers(table, "pos") % FAN**levels
    up = np.minimum(depth(_numbers(table, "n")), levels)
    bucket = np.cumsum(p == 0)
    return pa.table({"b": bucket, "p": p, "h": table.column("h"), "up": up}), np.flatnonzero(p == 0)


def _bucket_roots(levels: int):
    size = FAN**levels

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = _Engine(levels)
        for table in _whole_buckets(batches, lambda b: _numbers(b, "pos") % size == 0):
            nodes, first = _nodes(table, levels)
            engine.climb(nodes)
            heads = table.take(pa.array(first))
            n = _numbers(heads, "n")
            yield pa.RecordBatch.from_arrays([heads.column("g").combine_chunks(), pa.array(_numbers(heads, "pos") // size), pa.array(-(-n // size)), pa.array(engine.roots(), pa.string())], ["g", "pos", "n", "h"])

    return climb


def _with_paths(levels: int, fold: bool):
    """Buckets with the path of their root in front: the path of every node, or its proof and the root that its changed digest leads to."""

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = _Engine(levels)
        for table in _whole_buckets(batches, lambda b: _numbers(b, "pos") < 0):
            head = _numbers(table, "pos") < 0
            heads, table = table.filter(pa.array(head)), table.filter(pa.array(~head))
            nodes, _ = _nodes(table, levels)
            engine.climb(nodes)
            outer = pa.table({"b": np.arange(1, heads.num_rows + 1), "path": heads.column("path")})
            of_bucket = pa.array(nodes.column("b").to_numpy() - 1)
            subroots = heads.column("subroot").take(of_bucket).combine_chunks()
            if fold:
                longest = max((len(x) for x in heads.column("path").to_pylist()), default=0)
                told = engine.folded(outer, pa.table({"b": nodes.column("b"), "p": nodes.column("p"), "f": table.column("changed")}), longest)
                cols = [table.column("doc_id"), table.column("h"), pa.chunked_array([subroots]), told.column("proof"), told.column("f")]
                kinds, names = [pa.int64(), *[pa.string()] * 4], ["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"]
            else:
                told = engine.paths(outer)
                cols, kinds, names = [table.column("g"), table.column("pos"), told.column("path"), pa.chunked_array([subroots])], [pa.string(), pa.int64(), _PATH_TYPE, pa.string()], ["g", "pos", "path", "subroot"]
            whole = pa.table([c.cast(k) for c, k in zip(cols, kinds)], names=names)
            yield from whole.combine_chunks().to_batches()

    return descend


def _rounds(scratch: Scratch, leaves: DataFrame, levels: int) -> list[DataFrame]:
    """Tables of nodes ``g, pos, n, h``, from the leaves to one node for each group; every one holds the bucket roots of the one before."""
    size, rounds = FAN**levels, [leaves]
    while True:
        dealt = rounds[-1].select("g", "pos", "n", "h").withColumn("bucket", F.expr(f"pos DIV {size}")).repartition("g", "bucket").sortWithinPartitions("g", "bucket", "pos")
        rounds.append(scratch.keep(dealt.drop("bucket").mapInArrow(_bucket_roots(levels), "g string, pos long, n long, h string"), "roots"))
        if rounds[-1].filter("n > 1").isEmpty():
            return rounds


def _downward(nodes: DataFrame, outer: DataFrame, levels: int, fold: bool) -> DataFrame:
    """Paths of nodes from those of their buckets' roots (``g, pos, path, subroot``)."""
    size, extra = FAN**levels, ["doc_id", "changed"] if fold else []
    heads = outer.select("g", F.col("pos").alias("bucket"), F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("h"), "path", "subroot")
    own = nodes.select("g", F.expr(f"pos DIV {size}").alias("bucket"), "pos", "n", "h", F.lit(None).cast(_PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), *extra)
    every = own.unionByName(heads, allowMissingColumns=True).repartition("g", "bucket").sortWithinPartitions("g", "bucket", "pos").drop("bucket")
    schema = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string" if fold else f"g string, pos long, path {_PATH}, subroot string"
    return every.mapInArrow(_with_paths(levels, fold), schema)


_COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def manifest(docs: DataFrame, levels: int = LEVELS, tampered: Column | None = None) -> DataFrame:
    """One row for each document: its leaf, the roots of its source and of all, its proof, and what a check of the (tampered) row with that proof finds.

    ``docs`` has ``doc_id, source, lang, n_chars, text``. Tampering deletes the line ends of a text; ``tampered`` says of which rows, by default
    those whose crc32 of the id is even.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    doc_id, source, lang, n_chars, text = (F.col(f"`{c}`") for c in ("doc_id", "source", "lang", "n_chars", "text"))
    touched = F.coalesce(tampered if tampered is not None else F.crc32(doc_id.cast("string")) % 2 == 0, F.lit(False)) & F.coalesce(text.contains("\n"), F.lit(False))
    leaf = digest(doc_id, source, lang, n_chars, text)
    hashed = docs.select(doc_id.cast("long").alias("doc_id"), source.cast("string").alias("g"), leaf.alias("h"), F.when(touched, digest(doc_id, source, lang, n_chars, F.regexp_replace(text, "\n", ""))).alias("changed"))
    hashed = scratch.keep(hashed.withColumns({"changed": F.coalesce("changed", "h"), "tie": F.monotonically_increasing_id()}), "leaves")
    leaves = placed(scratch, hashed, "g", ["doc_id", "h", "tie"])
    scratch.drop(hashed)
    if leaves.isEmpty():
        return leaves.select("doc_id", *[F.lit(None).cast("boolean" if c == "verified" else "string").alias(c) for c in _COLUMNS[1:]])
    rounds = _rounds(scratch, leaves, levels)
    sources = placed(scratch, rounds[-1].select(F.lit(None).cast("string").alias("all"), F.col("g").alias("name"), "h"), "all", ["name"])
    upper = _rounds(scratch, sources.select(F.col("all").alias("g"), "pos", "n", "h"), levels)
    root = upper[-1].first()["h"]
    paths = upper[-1].select("g", "pos", F.array().cast(_PATH).alias("path"), F.lit(root).alias("subroot"))
    for nodes in reversed(upper[:-1]):
        paths = scratch.keep(_downward(nodes, paths, levels, False), "paths")
    named = sources.select("name", "h", F.col("pos").alias("at")).join(paths.select(F.col("pos").alias("at"), "path"), "at")
    paths = scratch.keep(named.select(F.col("name").alias("g"), F.lit(0).cast("long").alias("pos"), "path", F.col("h").alias("subroot")), "paths")
    for nodes in reversed(rounds[1:-1]):
        paths = scratch.keep(_downward(nodes, paths, levels, False), "paths")
    told = _downward(leaves, paths, levels, True)
    return told.withColumns({"root": F.lit(root), "verified": F.col("folded_root") == root}).select(*_COLUMNS)
