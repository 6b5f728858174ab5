"""Near-duplicate documents by SetSketch registers.

Documents with one shingle set are one item from the start. Items meet in buckets of equal register bands; pairs are
estimated jointly from all registers by likelihood, and what the estimate cannot rule out is decided on the full sets.
Components of the confirmed links give the classes.

No bucket is ever expanded into pairs. In star rounds each item is tried against the bucket centre that it shares most bands
with, which is one pair for each item; what links joins one component. First centres are the items with the most company in
their buckets, as the original among edited copies is; later ones are drawn by hash. Buckets whose members all belong to one component
are done. Star rounds go on while each halves the number of pairs that share a bucket and lie in two components. The items
of buckets that are open then meet by a prefix-filtered join of their sets, with size and position bounds, which is exact:
it finds every pair of them, in two components, that can reach the threshold. So no link between classes that shares a bucket is lost,
and copies that were edited each in its own way, which fill buckets without being similar enough, do not even become pairs.

What shares a key of that join with more than a few others, such as texts that each keep a random part of one template, makes no pairs either: such
items form groups, groups are dealt into blocks of bounded size, and a task counts the common shingles of all items of two blocks from an inverted
list. It gives the links that join components, at most one for each item. The work in a group still grows with its square where
no text is far from the threshold (no exact way that avoids this is known), but nothing that is written, shuffled as pairs or held by a task does.

Recall: a pair at similarity 0.75 shares a bucket with probability 1 - (1 - 0.75**5)**48 > 1 - 3e-6. The estimate drops a
pair only if its likeliest similarity is e**25 times likelier than the threshold.

Edge cases: a text with fewer words than a shingle is one shingle; a null, empty or blank text has no shingles and is linked
with nothing. Rows are the nodes, so repeated rows are linked to each other. A row without an id takes part and gets the
smallest id of its class, null if there is none; of equal ids in a class the row read first is its head. A very long text is one set, held by
one task at a time. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactdq.llm import setsketch as S
from contactdq.llm.common import SPACES, Scratch, slices, whole_row
from contactdq.llm.components import components
from contactdq.llm.wordhash import mixed, run_hashes, spaced, word_hashes

SHINGLE = 5
LEAST = 75  # percent
MARGIN = 25.0  # natural log of the likelihood ratio that drops a pair
HOT = 16  # items of a key from which they are compared by blocks
BLOCK_ITEMS, BLOCK_SHINGLES = 1024, 1 << 20
BITS = (16, 28)  # least and most leading bits of a row's hash in the bitmap of rows whose sets are needed


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text with A-Z lower-cased; of all words if there are fewer."""
    hashes = word_hashes(spaced(text, lower=True))
    if not len(hashes):
        return np.zeros(0, np.uint64)
    return np.unique(run_hashes(hashes, k) if len(hashes) >= k else mixed(run_hashes(hashes, len(hashes)) + np.uint64(len(hashes))))


def _sketch(k: int):
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("regs", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            counts, prints, regs = [], [], []
            for text in batch.column(2).to_pylist():
                own = shingle_set(text, k)
                counts.append(len(own))
                prints.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                regs.append(S.registers(own).tobytes())
            ids = pa.array(range(rid, rid + len(counts)), pa.int64())
            rid += len(counts)
            yield pa.RecordBatch.from_arrays([ids, batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(prints, pa.binary()), pa.array(regs, pa.binary())], schema=schema)

    return cut


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, S.REGISTERS)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2048):
        if batch.num_rows:
            keys = S.band_keys(_regs(batch.column(1))).view(np.int64)
            items = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), S.BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(items, pa.int64())], ["key", "item"])


def _plausible(least: float, margin: float):
    """Pairs that the likelihood cannot rule out, with their estimate."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            if batch.num_rows:
                sizes = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (2, 3)]
                j, lead = S.estimate(_regs(batch.column(4)), _regs(batch.column(5)), *sizes, least)
                chosen = pa.array(lead <= margin)
                out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(j)], ["a", "b", "estimate"])
                yield out.filter(chosen)

    return keep


def _sets(k: int, bits: int, bitmap):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = bitmap.value
        for batch in slices(batches):
            at = (batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)).view(np.int64)
            some = batch.filter(pa.array((wanted[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            own = [shingle_set(t, k) for t in some.column(1).to_pylist()]
            prints = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in own]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(prints, pa.binary()), pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))], ["at", "fp", "shingles"])

    return cut


def _bitmap(rows: DataFrame, n: int):
    """The leading bits of ``at`` as a bitmap, broadcast, and their number: 16 places or more for each of ``n`` rows, up to 32 MB.

    Beyond that the bitmap fills up and lets more rows through to the join behind it, which decides.
    """
    bits = min(max((16 * n).bit_length(), BITS[0]), BITS[1])
    words = (
        rows.select(F.shiftrightunsigned("at", 64 - bits).alias("p"))
        .groupBy(F.shiftright("p", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("bits"))
        .toPandas()
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return rows.sparkSession.sparkContext.broadcast(out.view(np.uint8)), bits


class _Matcher:
    """Decides pairs of items; holds the tables of sketches, sets and links."""

    def __init__(self, scratch: Scratch, sketches: DataFrame, sets: DataFrame, least: int, margin: float):
        self.scratch, self.sketches, self.sets, self.least, self.margin = scratch, sketches, sets, least, margin
        self.links: list[DataFrame] = []
        self.tried: list[DataFrame] = []

    def try_pairs(self, pairs: DataFrame) -> bool:
        """Estimate and verify distinct pairs ``a, b``, those tried before left out; whether any of them is a link."""
        for old in self.tried:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        pairs = self.scratch.keep(pairs, "pairs")
        a, b = (self.sketches.select(F.col("item").alias(c), F.col("n").alias(f"n_{c}"), F.col("regs").alias(f"regs_{c}")) for c in "ab")
        joined = pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "regs_a", "regs_b")
        likely = joined.mapInArrow(_plausible(self.least / 100, self.margin), "a long, b long, estimate double")
        a, b = (self.sets.select(F.col("item").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
        common = F.size(F.array_intersect("set_a", "set_b"))
        full = likely.select("a", "b").join(a, "a").join(b, "b").withColumn("common", common)
        linked = full.filter(F.expr(f"100 * common >= {self.least} * (size(set_a) + size(set_b) - common)")).select("a", "b")
        self.links.append(self.scratch.keep(linked, "links"))
        self.tried.append(pairs)
        return not self.links[-1].isEmpty()

    def add(self, links: DataFrame) -> bool:
        """Take pairs known to be links; whether there are any."""
        self.links.append(self.scratch.keep(links, "links"))
        return not self.links[-1].isEmpty()

    def labels(self) -> DataFrame:
        every = self.links[0]
        for more in self.links[1:]:
            every = every.unionByName(more)
        return self.scratch.keep(components(every, "a", "b").select(F.col("node").alias("item"), F.col("component").alias("c")), "labels")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _best(tries: DataFrame) -> DataFrame:
    """For each item the centre that it meets most often."""
    counts = tries.groupBy("item", "center").agg(F.count("*").alias("n"))
    return _ordered(counts.groupBy("item").agg(F.max_by("center", F.struct("n", "center")).alias("y")).select(F.col("item").alias("x"), "y")).distinct()


def open_pairs(scratch: Scratch, live: DataFrame, least: int, hot: int = HOT) -> tuple[DataFrame, DataFrame | None]:
    """Distinct pairs ``a, b`` of items of two components that may reach the threshold, and links ``a, b`` among items that share a key with many.

    ``live`` has ``item, c`` (component) ``, n`` and ``shingles``. Shingles are ordered by rarity, those of one component alone
    before all others, as no pair sought shares them. Two sets that reach the threshold share ``least / (100 + least)`` of
    both sizes, so their first common shingle stands early enough in both for as many to follow. An item enters with its early shingles
    only, under classes of the sizes that a partner can have; an item whose own shingles alone are too many does not enter. Every pair
    that reaches the threshold is among the pairs or is joined by the links; links are None where no key has more than ``hot`` items.
    """
    each = live.select("item", "c", "n", F.explode("shingles").alias("s"))
    shared = each.groupBy("s").agg(F.count("*").alias("df"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("s", "df")
    owned = each.join(shared, "s").groupBy("item", "c", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("own")).filter(f"100 * size(own) >= {least} * n")
    owned = scratch.keep(owned, "owned")
    places = owned.select("item", "c", "n", F.size("own").alias("m"), F.posexplode("own").alias("p", "own"))
    places = places.select("item", "c", "n", F.col("own.s").alias("s"), (F.col("m") - F.col("p")).alias("rest")).filter(f"100 * rest >= {least} * n")
    places = scratch.keep(places, "places")
    size_class = lambda x: f"int(floor(ln({x}) * 20))"
    smallest, largest = f"({least} * n + 99) DIV 100", f"least(n, {100 + least} * rest DIV {least} - n)"
    probing = places.filter(f"{largest} >= {smallest}").withColumn("size", F.explode(F.expr(f"sequence({size_class(smallest)}, {size_class(largest)})")))
    listed = places.filter(f"{100 + least} * rest >= {2 * least} * n").withColumn("size", F.expr(size_class("n")))
    # In each key one component, the most frequent, need not meet itself: the others meet all.
    both = probing.select("s", "size", "c").unionByName(listed.select("s", "size", "c")).groupBy("s", "size", "c").agg(F.count("*").alias("k"))
    keys = both.groupBy("s", "size").agg(F.count("*").alias("comps"), F.sum("k").alias("k"), F.max_by("c", F.struct("k", "c")).alias("major")).filter("comps > 1").drop("comps")
    keys = scratch.keep(keys, "keys")
    light = keys.filter(f"k <= {hot}")
    few_p, few_l = (t.join(light, ["s", "size"]).withColumn("minor", F.expr("c <> major")).select("s", "size", "item", "c", "n", "rest", "minor") for t in (probing, listed))
    fits = f"x.s = y.s AND x.size = y.size AND x.c <> y.c AND x.n >= y.n AND {100 + least} * least(x.rest, y.rest) >= {least} * (x.n + y.n)"
    met = None
    for one, other in (("minor", "true"), ("NOT minor", "minor")):
        some = few_p.filter(one).alias("x").join(few_l.filter(other).alias("y"), F.expr(fits)).select(F.col("x.item").alias("x"), F.col("y.item").alias("y"))
        met = some if met is None else met.unionByName(some)
    heavy = keys.filter(f"k > {hot}").select("s", "size")
    if heavy.isEmpty():
        return _ordered(met).distinct(), None
    entries = scratch.keep(probing.select("s", "size", "item").unionByName(listed.select("s", "size", "item")).join(heavy, ["s", "size"]), "entries")
    heads = entries.groupBy("s", "size").agg(F.min("item").alias("head"))
    groups = components(entries.join(heads, ["s", "size"]).select("item", "head").distinct(), "item", "head").select(F.col("node").alias("item"), F.col("component").alias("g"))
    return _ordered(met).distinct(), _links_in_groups(scratch, owned.join(groups, "item"), least, size_class("n"))


def _links_in_groups(scratch: Scratch, members: DataFrame, least: int, size_class: str) -> DataFrame:
    """Links ``a, b`` that join the components of all similar items of each group ``g``, found block by block.

    Blocks are classes of sizes, dealt by hash into as many parts as bound their items and shingles; only blocks whose sizes are near enough meet.
    """
    members = scratch.keep(members.select("g", "item", "c", "n", F.expr("transform(own, x -> x.s)").alias("shingles"), F.expr(size_class).alias("size")), "members")
    parts = members.groupBy("g", "size").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ITEMS, F.sum(F.size("shingles")) / BLOCK_SHINGLES)).cast("int").alias("parts"))
    parts = scratch.keep(parts, "parts")
    dealt = members.join(parts, ["g", "size"]).withColumn("part", F.expr("int(pmod(xxhash64(item), parts))")).drop("parts")
    blocks = parts.select("g", "size", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    far = int(np.ceil(20 * np.log(100 / least)))
    near = F.expr(f"x.g = y.g AND y.size BETWEEN x.size - {far} AND x.size AND (y.size < x.size OR y.part <= x.part)")
    pairs = blocks.alias("x").join(blocks.alias("y"), near).select("x.g", F.struct("x.size", "x.part").alias("x"), F.struct("y.size", "y.part").alias("y")).withColumn("pair", F.xxhash64("g", "x", "y"))
    sides = pairs.select("g", "pair", F.posexplode(F.expr("CASE WHEN x = y THEN array(x) ELSE array(x, y) END")).alias("side", "block")).select("g", "pair", "side", "block.size", "block.part")
    sent = dealt.join(sides, ["g", "size", "part"]).select("pair", "side", "item", "c", "n", "shingles").repartition("pair").sortWithinPartitions("pair", "side", "item")
    return sent.mapInArrow(_block_links(least), "a long, b long")


def _block_links(least: int):
    """Items of two blocks, or of one, arrive together."""

    def find(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in slices(pairs, 256):
            own = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if own[a] != now and held:
                    yield _joining(held, least)
                    held = []
                now = own[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield _joining(held, least)

    return find


def _joining(rows: list[pa.RecordBatch], least: int) -> pa.RecordBatch:
    """Links among the items of a pair of blocks that join their components, as far as these are not joined by others before."""
    table = pa.Table.from_batches(rows).combine_chunks()
    side, items, comps, sizes = (table.column(i).to_numpy() for i in (1, 2, 3, 4))
    lists = table.column(5).combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths)
    # The inverted list is that of the second block, or of the only one.
    second = np.flatnonzero(side == side.max())
    of = np.repeat(np.arange(len(items)), lengths)
    in_second = side[of] == side.max()
    order = np.argsort(flat[in_second], kind="stable")
    listed, owner = flat[in_second][order], of[in_second][order] - second[0]
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.get(c, c) != c:
            c = parent[c] = parent.get(parent[c], parent[c])
        return c

    found: tuple[list[int], list[int]] = ([], [])
    for i in np.flatnonzero(side == side.min()).tolist():
        own = flat[ends[i] - lengths[i] : ends[i]]
        low, high = np.searchsorted(listed, own, "left"), np.searchsorted(listed, own, "right")
        n = high - low
        common = np.bincount(owner[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], minlength=len(second))
        linked = (100 * common >= least * (sizes[i] + sizes[second] - common)) & (comps[second] != comps[i])
        for j in second[np.flatnonzero(linked)].tolist():
            a, b = root(int(comps[i])), root(int(comps[j]))
            if a != b:
                parent[a] = b
                found[0].append(min(int(items[i]), int(items[j])))
                found[1].append(max(int(items[i]), int(items[j])))
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, least: int = LEAST, margin: float = MARGIN) -> DataFrame:
    """One row for each document: ``doc_id, n_shingles, component_id``, and ``rid, at`` which name the row."""
    scratch = Scratch(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    doc_id = F.col(f"`{id_col}`").cast("long")
    base = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, F.coalesce(text, F.lit(""))).alias("at"), text.alias("text"))
    rows = scratch.keep(base.mapInArrow(_sketch(k), "rid long, doc_id long, at long, n long, fp binary, regs binary"), "sketches")
    items = scratch.keep(rows.filter("n > 0").groupBy("fp").agg(F.min(F.struct("rid", "at")).alias("m"), F.min("n").alias("n")).select("fp", F.col("m.rid").alias("item"), F.col("m.at").alias("at"), "n"), "items")
    sketches = rows.select(F.col("rid").alias("item"), "n", "regs").join(items.select("item"), "item", "left_semi")
    bands = sketches.select("item", "regs").mapInArrow(_banded, "key long, item long")
    shared = bands.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members = scratch.keep(bands.join(shared, "key").select("key", "item", "size"), "members")
    # The item with the most company over all its bands is the likeliest original of a group of edited copies.
    company = scratch.keep(members.groupBy("item").agg(F.sum("size").alias("company")), "company")
    met = items.join(company.select("item"), "item", "left_semi")
    bitmap, bits = _bitmap(met, company.count())
    found = base.select("at", "text").mapInArrow(_sets(k, bits, bitmap), "at long, fp binary, shingles array<long>")
    sets = scratch.keep(found.join(met.select("fp", "at", "item"), ["fp", "at"]).dropDuplicates(["fp", "at"]).select("item", "shingles"), "sets")
    sketches = scratch.keep(sketches.join(company.select("item"), "item", "left_semi"), "met")
    matcher = _Matcher(scratch, sketches, sets, least, margin)

    centers = members.join(company, "item").groupBy("key").agg(F.max_by("item", F.struct("company", "item")).alias("center"))
    matcher.try_pairs(_best(members.join(centers, "key").filter("item <> center")))
    labels, before, turn = matcher.labels(), None, 0
    while True:
        turn += 1
        told = members.select("key", "item").join(labels, "item", "left").withColumn("c", F.coalesce("c", "item"))
        # Pairs that could still join two components: those in a bucket, less those within one component.
        parts = told.groupBy("key", "c").agg(F.count("*").alias("n"), F.min_by("item", F.xxhash64("item", F.lit(turn))).alias("m"))
        bucket = parts.groupBy("key").agg((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("cross"), F.count("*").alias("k"), F.min_by(F.struct("m", "c"), F.xxhash64("m", F.lit(turn))).alias("m"))
        bucket = scratch.keep(bucket.filter("k > 1").select("key", "cross", F.col("m.m").alias("center"), F.col("m.c").alias("cc")), "buckets")
        cross = bucket.agg(F.sum(F.col("cross").cast("double"))).first()[0]
        if not cross:
            break
        live = told.join(bucket.select("key", "center", "cc"), "key")
        if before is not None and 2 * cross > before:
            # Star rounds no longer pay: the rest is decided by the sets themselves.
            some = live.groupBy("item", "c").agg(F.lit(1).alias("one")).select("item", "c").join(sets, "item").withColumn("n", F.size("shingles"))
            pairs, links = open_pairs(scratch, some, least)
            new = matcher.try_pairs(pairs)
            if (links is not None and matcher.add(links)) or new:
                labels = matcher.labels()
            break
        before = cross
        if matcher.try_pairs(_best(live.filter("c <> cc").select("item", "center"))):
            labels = matcher.labels()
        scratch.drop(bucket)
    named = rows.select("rid", "doc_id", "at", "n", "fp").join(items.select("fp", "item"), "fp", "left").join(labels, "item", "left").withColumn("c", F.coalesce("c", "item", "rid"))
    named = scratch.keep(named.select("rid", "doc_id", "at", "n", "c"), "named")
    scratch.drop(rows, items, members, company, sets, sketches, *matcher.links, *matcher.tried)
    # Written, so that the join below reads it on its own and a hot class can be split.
    low = scratch.keep(named.groupBy("c").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("head")), "classes")
    return named.join(low, "c").select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("rid") == F.col("head.rid")).alias("is_head"), "rid", "at")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with one row (that of the smallest id) for each class.

    Rows of one id and one text are one class, whatever their other columns: the one that stays has the least hash of all its columns.
    """
    heads = classes(docs, id_col, text_col, **options).filter("is_head").select(F.col("at").alias("_at"), F.col("doc_id").alias("_id"))
    text, doc_id = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.col(f"`{id_col}`").cast("long")
    empty = F.btrim(text, F.lit(SPACES)) == ""
    marked = docs.filter(~empty).select(whole_row(docs), F.xxhash64(doc_id, text).alias("_at"), doc_id.alias("_id"))
    kept = marked.alias("d").join(heads.alias("h"), F.expr("d._at = h._at AND d._id <=> h._id"), "left_semi")
    hashed = [F.col("_row").getField(c) for c, kind in docs.dtypes if "map<" not in kind]  # maps have no hash
    # Equal rows share the key of their head: one of them stays. Each task keeps its least row of a key, so a key that repeats costs a row for each task.
    one = kept.withColumn("_order", F.xxhash64(*hashed)).groupBy("_at", "_id").agg(F.min_by("_row", "_order").alias("_row"))
    return docs.filter(empty).unionByName(one.select("_row.*"))
