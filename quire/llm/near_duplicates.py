"""MinHash near-duplicates with sequential Bayesian verification.

1. Equal word sequences form classes, and a class is a node. Every node has a set of distinct shingles and SIZE minima, of which one byte each
   is kept as signature, and BANDS band keys of ROWS minima.
2. Nodes that share a bucket of some band are candidates. First each bucket's members meet its hub, the smallest node. Signatures are compared batch by batch, and a pair goes if the posterior
   probability that its similarity reaches the threshold, given the matches so far, is below MISS. Survivors are confirmed on their full sets. Many members of one hub are dealt to several tasks.
3. Links make components. Only buckets in which members of several components are left need more: there, those outside the bucket's largest component meet all others with whom nothing connects them yet.
   A task holds a block of the former, bounded by its bytes, and streams the latter past it: once with the signatures alone, then, for nodes with a survivor, with the sets.
   So pairs are never listed, and a bucket in which all is connected costs nothing.
4. Components of all links are found by alternating large-star and small-star steps over tables in the shared folder. No bucket, component or partner is capped.

Nulls: null and empty texts have no shingles and stay alone. A null doc_id is above all others;
component_id is null unless a document with an id is in the component. Rows are documents of their own: those of one doc_id are linked only by their texts. A text of
under five words has its whole sequence as its only shingle; a very long one is a set like others. Equal rows are one node. An empty table gives no rows; extra columns are ignored by op6 and kept by keep_one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, small_batches
from .shingles import MinHash, hashes, words

#: At similarity 0.75 a pair shares no band with probability (1 - 0.75**5)**40 = 2e-5; at 0.8 with 1e-7.
ROWS, BANDS, BATCH, MISS, SEED = 5, 40, 20, 1e-5, 606
SIZE = ROWS * BANDS
#: Members of one hub or bucket in a task, and bytes of a block that a task holds.
CHUNK, BLOCK_BYTES = 4096, 1 << 23
NO_ID = 1 << 62
_made: dict[int, MinHash] = {}


def thresholds(percent: int) -> list[int]:
    """The least matches after each batch of BATCH signature bytes at which P(similarity >= percent / 100 | matches) is at least MISS.

    The prior is uniform; bytes of unequal minima agree by chance in 1 of 256 cases.
    """
    s = (np.arange(2000) + 0.5) / 2000
    p = s + (1 - s) / 256
    out = []
    for n in range(BATCH, SIZE + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            like = np.exp(log - log.max())
            if like[s >= percent / 100].sum() / like.sum() >= MISS:
                break
        out.append(m)
    return out


def survivors(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Rows of two signature matrices that no batch rules out."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int32)
    for k, m in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (a[alive, part] == b[alive, part]).sum(axis=1, dtype=np.int32)
        keep = matches >= m
        alive, matches = alive[keep], matches[keep]
    return alive


ROW = ("row1", "row2")


def _row() -> tuple[Column, Column]:
    """Two hashes that tell rows apart by doc_id and text."""
    return F.xxhash64("doc_id", "text").alias("row1"), F.xxhash64(F.lit(7), "text", "doc_id").alias("row2")


def _sketches(d: DataFrame) -> DataFrame:
    """doc_id, row, class key, number of shingles, signature and band keys of each document; keys are null without words."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mh = _made.setdefault(SIZE, MinHash(SIZE, SEED))
        salt = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mult = np.array([3, 5, 7, 11, 13], dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for batch in batches:
            keys, sizes, sigs, bands = [], [], [], []
            for text in batch.column(3).to_pylist():
                w = words(text)
                h = np.unique(hashes(w))
                sizes.append(len(h))
                if not len(h):
                    keys.append(None), sigs.append(None), bands.append(None)
                    continue
                m = mh.minima(h)
                keys.append(xxhash.xxh3_128_digest(b" ".join(w)))
                sigs.append(((m * np.uint32(0x85EBCA6B)) >> np.uint32(24)).astype(np.uint8).tobytes())
                wide = m.reshape(BANDS, ROWS).astype(np.uint64)
                key = salt.copy()
                for r in range(ROWS):
                    key = (key ^ wide[:, r]) * mult[r]
                    key ^= key >> np.uint64(31)
                bands.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", *ROW, "key", "n_shingles", "sig", "bands"],
            )

    return d.select("doc_id", *_row(), "text").mapInArrow(sketch, "doc_id long, row1 long, row2 long, key binary, n_shingles long, sig binary, bands array<long>")


def _nodes(sketches: DataFrame, scratch: Scratch) -> DataFrame:
    """node, key, row1, row2, n_shingles, first (the class's smallest doc_id), sig, bands; one for each class. A node is numbered by its smallest doc_id, or, if
    that is null or another class has it, by a number above all ids made of its words."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), *ROW)
    g = sketches.filter("key IS NOT NULL").groupBy("key").agg(F.min(place).alias("at"), F.min_by(F.struct("n_shingles", "sig", "bands"), place).alias("v"))
    classes = scratch.save(g.select("key", F.col("at.doc_id").alias("first"), *(F.col(f"at.{r}").alias(r) for r in ROW), "v.*"), "classes")
    stand_in = F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("key"), 3)
    shared = scratch.save(classes.filter("first IS NOT NULL").groupBy("first").agg(F.count("*").alias("n"), F.min("key").alias("owner")).filter("n > 1").select("first", "owner"), "shared")
    if shared.isEmpty():
        return classes.withColumn("node", F.coalesce("first", stand_in))
    named = classes.join(shared, "first", "left").withColumn("node", F.when(F.coalesce(F.col("owner") == F.col("key"), F.col("first").isNotNull()), F.col("first")).otherwise(stand_in))
    return scratch.save(named.drop("owner"), "nodes")


def _sets(d: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and shingles of the wanted nodes (node, row1, row2)."""

    def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(hashes(words(t)).view(np.int64)) for t in batch.column(1).to_pylist()]  # ascending as signed numbers
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    texts = d.select(*_row(), "text").join(wanted, list(ROW)).dropDuplicates(["node"])
    return texts.select("node", "text").mapInArrow(shingle_sets, "node long, shingles array<long>")


def components(links: DataFrame, scratch: Scratch, step: str) -> DataFrame:
    """id, component (the smallest id that is reachable) for every id in a link (a, b)."""
    edges = scratch.save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{step}-0")
    state, k = None, 0
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        k += 1
        edges = scratch.save(small, f"{step}-{k}")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        scratch.drop(f"{step}-{k - 1}")
        if (now["n"], now["h"]) == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state = (now["n"], now["h"])


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), SIZE)


def similar(a: np.ndarray, sets: pa.Array, percent: int) -> np.ndarray:
    """Which of ``sets`` reach the threshold with the set a. Sets are ascending, and none is empty."""
    n = sets.value_lengths().to_numpy().astype(np.int64)
    fits = np.flatnonzero((100 * np.minimum(n, len(a)) >= percent * np.maximum(n, len(a))) & (n > 0))  # sizes too unlike rule it out
    out = np.zeros(len(n), dtype=bool)
    if len(fits):
        n = n[fits]
        values = (sets if len(fits) == len(sets) else sets.take(pa.array(fits))).flatten().to_numpy()
        hit = a[np.minimum(np.searchsorted(a, values), len(a) - 1)] == values
        both = np.add.reduceat(hit, np.cumsum(n) - n, dtype=np.int64)
        out[fits] = 100 * both >= percent * (len(a) + n - both)
    return out


def _with_hubs(pairs: DataFrame, what: DataFrame, name: str, test) -> DataFrame:
    """The pairs (node, hub) that pass ``test(hub's value, members' values)``. what: node and the column ``name``. A hub's members are dealt to tasks by CHUNK."""
    counts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("lots"))
    dealt = pairs.join(counts, "hub").withColumn("lot", F.pmod(F.xxhash64("node", F.lit(3)), F.col("lots")).cast("int"))
    members = dealt.join(what, "node").select("hub", "lot", F.lit(1).alias("role"), "node", name)
    hubs = counts.withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).join(what.withColumnRenamed("node", "hub"), "hub")
    rows = members.unionByName(hubs.select("hub", "lot", F.lit(0).alias("role"), F.col("hub").alias("node"), name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, value = None, None
        for batch in batches:
            hub, role, node = (batch.column(i).to_numpy() for i in (0, 2, 3))
            start = np.flatnonzero(np.concatenate([[True], (hub[1:] != hub[:-1]) | (role[1:] < role[:-1])])) if len(hub) else np.zeros(0, dtype=np.int64)
            for a, b in zip(start.tolist(), [*start[1:].tolist(), len(hub)], strict=True):
                if role[a] == 0:
                    now, value, a = hub[a], batch.column(4)[a], a + 1
                if a < b and now == hub[a]:
                    hit = test(value, batch.column(4).slice(a, b - a))
                    if len(hit):
                        yield pa.RecordBatch.from_arrays([pa.array(node[a:b][hit]), pa.array(np.full(len(hit), now))], ["node", "hub"])

    return rows.repartition("hub", "lot").sortWithinPartitions("hub", "lot", "role", "node").mapInArrow(run, "node long, hub long")


def _rest(chained: DataFrame, labels: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """What the hubs have left: key, node, label and whether it is outside its bucket's largest component, for the buckets with several components; each set of members once."""
    named = scratch.save(chained.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label")), "labelled")
    mixed = named.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a < b").select("key")
    named = named.join(mixed, "key")
    by_label = named.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(5))).alias("y"))
    buckets = by_label.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.sum("n").alias("n"), F.sum("x").alias("x"), F.bit_xor("y").alias("y"))
    buckets = buckets.groupBy("n", "x", "y").agg(F.min(F.struct("key", "most")).alias("one")).select("one.*", "n")
    return scratch.save(named.join(buckets, "key").select("key", "node", "label", (F.col("label") != F.col("most")).alias("outside"), "n"), "rest")


def _past_blocks(rest: DataFrame, what: DataFrame, least: list[int], percent: int | None) -> DataFrame:
    """Members outside their bucket's largest component against all of the bucket with other labels.

    what: node, sig (and shingles). Without percent: node of every member that has a surviving partner, by signatures alone. With it: links (a, b), confirmed on the sets; what a link has joined is not compared again.
    """
    names = ["sig"] if percent is None else ["sig", "shingles"]
    bytes_ = F.lit(SIZE + 64) if percent is None else F.lit(SIZE + 64) + 8 * F.size("shingles")
    held = rest.filter("outside").join(what, "node")
    sizes = held.groupBy("key").agg(F.ceil(F.sum(bytes_) / BLOCK_BYTES).cast("int").alias("blocks"))
    lots = F.ceil(F.col("n") / CHUNK).cast("int")
    left = held.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    left = left.withColumn("lot", F.explode(F.sequence(F.lit(0), lots - 1))).withColumn("role", F.lit(0))
    right = rest.join(sizes, "key").join(what, "node").withColumn("lot", F.pmod(F.xxhash64("node", F.lit(2)), lots).cast("int"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("role", F.lit(1))
    columns = ["key", "block", "lot", "role", "node", "label", "outside", *names]
    rows = left.select(*columns).unionByName(right.select(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, found = None, [], set()
        node = label = sig = None
        joined: dict[int, int] = {}
        tables: list[tuple[range, np.ndarray, np.ndarray]] = []

        def root(x: int) -> int:
            while x in joined:
                x = joined[x]
            return x

        def tabulated() -> None:
            """The held sets as a few tables: which of their shingles each has. So a set that passes by is looked up once for many."""
            tables.clear()
            sets, first = [h[8].values.to_numpy() for h in held], 0
            while first < len(sets):
                last, size = first + 1, len(sets[first])
                while last < len(sets) and (last + 1 - first) * (size + len(sets[last])) <= BLOCK_BYTES:
                    size += len(sets[last])
                    last += 1
                every = np.unique(np.concatenate(sets[first:last]))
                has = np.zeros((last - first, len(every) + 1), dtype=bool)
                for k in range(first, last):
                    has[k - first, np.searchsorted(every, sets[k])] = True
                tables.append((range(first, last), every, has))
                first = last

        def meet(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
            other, mark, out = batch.column(4).to_numpy(), batch.column(5).to_numpy(), batch.column(6).to_numpy(zero_copy_only=False)
            theirs = _signatures(batch.column(7))

            def partners(k: int) -> np.ndarray:
                at = np.flatnonzero((mark != label[k]) & ((other > node[k]) | ~out))  # two members outside meet once
                return at[survivors(np.broadcast_to(sig[k], (len(at), SIZE)), theirs[at], least)] if len(at) else at

            if percent is None:
                for k in range(len(node)):
                    alive = partners(k)
                    if len(alive):
                        found.add(int(node[k]))
                        found.update(other[alive].tolist())
                return
            sizes = batch.column(8).value_lengths().to_numpy().astype(np.int64)
            values, begins = batch.column(8).flatten().to_numpy(), np.cumsum(sizes) - sizes
            for block, every, has in tables:
                place = None
                for k in block:
                    alive = partners(k)
                    if not len(alive):
                        continue
                    if place is None:
                        place = np.minimum(np.searchsorted(every, values), len(every) - 1)
                        place[every[place] != values] = len(every)
                    both = np.add.reduceat(has[k - block.start][place], begins, dtype=np.int64)[alive]
                    mine = int(has[k - block.start].sum())
                    for c in alive[100 * both >= percent * (mine + sizes[alive] - both)].tolist():
                        a, b = root(int(label[k])), root(int(mark[c]))
                        if a != b:
                            joined[max(a, b)] = min(a, b)
                            yield int(node[k]), int(other[c])

        for batch in batches:
            n = batch.num_rows
            place = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            role = batch.column(3).to_pylist()
            a = 0
            while a < n:
                b = a + 1
                while b < n and place[b] == place[a] and role[b] == role[a]:
                    b += 1
                if place[a] != now:
                    now, held = place[a], []
                    joined.clear()
                part = batch.slice(a, b - a)
                if role[a] == 0:
                    held += [tuple(part.column(i)[k] for i in range(len(columns))) for k in range(b - a)]
                    node, label = (np.array([h[i].as_py() for h in held]) for i in (4, 5))
                    sig = np.frombuffer(b"".join(h[7].as_py() for h in held), dtype=np.uint8).reshape(len(held), SIZE)
                    tables.clear()
                elif held:
                    if percent is not None and not tables:
                        tabulated()
                    links = list(meet(part))
                    if links:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b"])
                    if len(found) > 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int64())], ["node"])
                        found.clear()
                a = b
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int64())], ["node"])

    dealt = rows.repartition("key", "block", "lot").sortWithinPartitions("key", "block", "lot", "role", "node")
    return dealt.select(*columns).mapInArrow(run, "node long" if percent is None else "a long, b long")


def _linked(d: DataFrame, nodes: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """id (a node) and component of every node with a link."""
    least = thresholds(percent)
    banded = nodes.select("node", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub < last").select("key", "hub")
    chained = scratch.save(banded.join(buckets, "key"), "chained")
    sigs = nodes.select("node", "sig")
    pairs = scratch.save(chained.filter("node <> hub").select("node", "hub").distinct(), "pairs")
    by_signature = lambda hub, members: survivors(np.broadcast_to(_signatures(pa.array([hub.as_py()], pa.binary())), (len(members), SIZE)), _signatures(members), least)
    alive = scratch.save(_with_hubs(pairs, sigs, "sig", by_signature), "alive")
    rows = nodes.select("node", *ROW)
    some = alive.select("node").union(alive.select("hub")).distinct()
    sets = scratch.save(_sets(d, rows.join(some, "node")), "sets")
    by_set = lambda hub, members: np.flatnonzero(similar(hub.values.to_numpy(), members, percent))
    links = scratch.save(_with_hubs(alive, sets, "shingles", by_set).select(F.col("node").alias("a"), F.col("hub").alias("b")), "links")
    found = scratch.save(components(links, scratch, "first"), "components-0")
    rest = _rest(chained.select("key", "node"), found.withColumnRenamed("id", "node"), nodes, scratch)
    if not rest.isEmpty():
        some = scratch.save(_past_blocks(rest, sigs, least, None).distinct(), "left")
        if not some.isEmpty():
            more = rest.join(some, "node")
            mixed = more.groupBy("key").agg(F.count("*").alias("n"), F.max("outside").alias("any")).filter("n > 1 AND any").select("key", "n")
            more = scratch.save(more.drop("n").join(mixed, "key"), "more")
            what = scratch.save(_sets(d, rows.join(some, "node")).join(sigs, "node"), "more-sets")
            late = scratch.save(_past_blocks(more, what, least, percent), "more-links")
            if not late.isEmpty():  # links between the components found so far
                label = lambda x: found.select(F.col("id").alias(x), F.col("component").alias(f"_{x}"))
                between = late.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
                merged = scratch.save(components(between, scratch, "second"), "components-1")
                lower = merged.select(F.col("id").alias("_old"), F.col("component").alias("_low"))
                moved = found.join(lower, F.col("component") == F.col("_old"), "left").select("id", F.coalesce("_low", "component").alias("component"))
                found = moved.union(merged.join(found.select("id"), "id", "left_anti"))
    scratch.drop("chained", "pairs", "alive", "sets", "labelled", "rest", "more", "more-sets")
    return found


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id (the smallest id with the same words), and the row's hashes with the number of its component."""
    small_batches(spark)
    scratch, d = Scratch(spark, "near"), documents(docs)
    sketches = scratch.save(_sketches(d), "sketches")
    nodes = _nodes(sketches, scratch)
    found = _linked(d, nodes, scratch, percent)
    labelled = nodes.select("node", F.col("key").alias("_key"), "first").join(found.withColumnRenamed("id", "node"), "node", "left")
    labelled = labelled.select("node", "_key", "first", F.coalesce("component", "node").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    labelled = scratch.save(labelled.join(smallest, "component"), "labels")
    light = sketches.select("doc_id", *ROW, "key", "n_shingles")
    out = light.join(labelled, F.col("key") == F.col("_key"), "left")
    alone = F.col("key").isNull()
    kept = F.when(alone, F.lit(True)).when(F.col("component_id").isNull(), F.col("node") == F.col("component")).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return out.select(
        "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), kept.alias("kept"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("first")).alias("class_id"), *ROW, "component", "node",
    )


def op6(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return near_duplicates(spark, docs).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def keep_one(spark: SparkSession, docs: DataFrame, percent: int = 75) -> DataFrame:
    """One document of each component, with the columns it came with: of the rows with its smallest doc_id the one with the smallest node and hashes; of rows without words, all that differ."""
    found = near_duplicates(spark, docs, percent).filter("kept").select("component", "node", *ROW)
    best = found.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("node", *ROW)).alias("one")).select("one.row1", "one.row2")
    kept = Scratch(spark, "kept").save(best.union(found.filter("component IS NULL").select(*ROW).distinct()), "rows")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return packed.select("_row", *_row()).join(kept, list(ROW), "left_semi").dropDuplicates(list(ROW)).select("_row.*")


#: Links by exact similarity and their components, for comparison.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN coalesce(len(ws), 0) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), k AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a),
g AS (SELECT a AS doc_id, min(b) AS twin FROM (SELECT doc_id AS a, doc_id AS b FROM documents UNION ALL SELECT a.doc_id, b.doc_id FROM w a JOIN w b ON a.ws = b.ws AND len(a.ws) > 0) GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, k.component_id, d.doc_id = k.component_id AS kept, g.twin AS class_id
FROM documents d JOIN k ON k.doc_id = d.doc_id JOIN g ON g.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
