"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A byte goes if a string of LENGTH bytes that covers it also starts earlier in the corpus. Suffixes are compared to LENGTH bytes.

1. Texts equal to an earlier one go as a whole. The others are read once for their anchors: of the GRAM-byte strings in each window of LENGTH bytes,
   the one with the least hash. Equal windows have equal anchors at the same place, so a window can only be repeated if its anchor is.
   Anchors are range-sorted by (hash, document), and those with an equal neighbour are kept.
2. Each text that has kept anchors yields one piece for each run of windows with the same anchor: the run's bytes, about 35 suffixes long. The anchor is the piece's
   suffix bucket. Pieces are range-sorted by (bucket, bytes, place); a piece equal to its neighbour before is repeated as a whole.
3. What remains, distinct pieces of buckets that hold several, goes through the difference-cover sort, a few buckets at a time: positions are
   counted from the anchor, so that equal windows agree modulo the period V. The ranks of cover-sample strings are found by doubling; suffixes are
   sorted by their bucket and the ranks of the samples that follow, ties by the first and last 8 bytes, which the samples may leave open, and the first of each run of equals stays.
   A bucket with more than CROWD pieces would not fit a block: it is refined. Its pieces are cut where the distance from the anchor passes a multiple of REFINE[0], all windows between two
   cuts share a core of bytes around the anchor, and (anchor, distance, core) is the new bucket. Equal windows have equal cores, so steps 2 and 3 are simply taken again
   with the refined buckets; those that are still crowded are cut to single windows, whose core is the whole window. Memory is bounded by the block, not by the corpus or a bucket.
4. The repeated ranges of each document are merged and cut out.

Range sorts split a hot key over partitions: order includes the place. Where a partition begins, the neighbour is unknown, and the row is kept as
if it were new; step 3 sees it beside its twin. Nulls: a null text is empty; null doc_ids come last, in order of their texts. Rows that share
doc_id and text are one document (the first occurrence stays in each); rows that share only doc_id are ordered by text hash. Texts of under LENGTH
bytes are kept as they are; very long ones are read in chunks and their pieces sent on in batches of some MB. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, small_batches

LENGTH, GRAM, CROWD, BLOCK_BYTES, CHUNK, OUT_BYTES = 100, 40, 4000, 1 << 20, 1 << 15, 1 << 21
#: Windows are this far apart, seen from the anchor, when they part company as a crowded bucket is refined.
REFINE = (16, 1)
#: Differences of these residues cover all residues modulo V.
V, COVER = 16, (0, 1, 2, 5, 8)
NULL_ID = (1 << 63) - 1


_MULTIPLIERS = [np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1) ** 3) % (1 << 64)) for k in range(8)]


def anchors(t: np.ndarray, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of LENGTH bytes with the same anchor: hash, the anchor's place, first window and number of windows.

    t may hold several texts on end, which end at ``ends``; windows lie inside one of them.
    """
    ends = np.array([len(t)]) if ends is None else ends
    if len(t) < LENGTH:
        return (np.zeros(0, dtype=np.int64),) * 4
    parts = [_anchors(t[at : at + CHUNK + LENGTH - 1], at, ends) for at in range(0, len(t) - LENGTH + 1, CHUNK)]
    h, place, first, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])[: len(place)])  # runs that a chunk's end has cut are joined
    return h[new], place[new], first[new], np.add.reduceat(count, new) if len(new) else count


def _anchors(t: np.ndarray, at: int, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    h = t.astype(np.uint64) + np.uint64(1)
    n, mult = 1, _MULTIPLIERS[0]
    by = {1: h}
    while 2 * n <= GRAM:
        h = (h[:-n] * mult) ^ (h[n:] + (h[n:] >> np.uint64(27)))
        n *= 2
        mult = _MULTIPLIERS[n.bit_length() - 1]
        by[n] = h
    rest = GRAM - n
    size = 1 << (rest.bit_length() - 1) if rest else 0
    while rest:  # GRAM as a sum of powers of two
        h = h[: len(t) - n - size + 1] * mult ^ by[size][n : n + len(t) - n - size + 1]
        n, rest = n + size, rest - size
        size = 1 << (rest.bit_length() - 1) if rest else 0
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    least = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
    width, n = LENGTH - GRAM + 1, 1
    while 2 * n <= width:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    windows = len(t) - LENGTH + 1
    least = np.minimum(least[:windows], least[width - n : width - n + windows])
    place = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
    inside = np.ones(windows, dtype=bool)  # windows that cross no text's end
    for end in ends[np.searchsorted(ends, at, "right") : np.searchsorted(ends, at + len(t))].tolist():
        inside[max(0, end - at - LENGTH + 1) : max(0, end - at)] = False
    kept = np.flatnonzero(inside)
    place = place[kept]
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])[: len(place)])
    return h[place[new]].view(np.int64), place[new] + at, kept[new] + at, np.diff(np.append(new, len(place)))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings on end, and where each begins and the last ends."""
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, dtype=wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    t = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return t[at[0] : at[-1]], at - at[0]


def _binary(t: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Stretches of t as values of their own."""
    upto = np.cumsum(sizes)
    total = int(upto[-1]) if len(upto) else 0
    data = t[np.repeat(first - (upto - sizes), sizes) + np.arange(total)]
    offsets = np.concatenate([[0], upto]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _ranks(key: np.ndarray) -> np.ndarray:
    """Dense ranks."""
    order = np.argsort(key)
    s = key[order]
    new = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])]) if len(s) else np.zeros(0, dtype=np.int64)
    out = np.empty(len(key), dtype=np.uint64)
    out[order] = new.astype(np.uint64)
    return out


def _words(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number in the order of the bytes; zeros behind the end."""
    padded = np.concatenate([t, np.zeros(8, dtype=np.uint8)])
    out = np.zeros(len(t), dtype=np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(t)]
    return out


def repeated_suffixes(data: np.ndarray, sizes: np.ndarray, phase: np.ndarray, windows: np.ndarray, bucket: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For every window of every piece, in turn: whether an equal one comes earlier. The difference-cover sort of one block.

    data: the pieces' bytes on end; sizes: how many each has. phase: the anchor's place in the piece. order: rank of (document, place) of each piece's first window in the corpus, so that
    the order of two equal windows is that of their pieces (they lie equally far from their anchors).
    """
    # Every piece starts where its anchor falls on a multiple of V; a gap of zeros parts it from the one before.
    lead = (-phase) % V
    room = (lead + sizes + V + 7) // V * V + V
    base = np.concatenate([[0], np.cumsum(room)[:-1]]) + lead
    t = np.zeros(int(room.sum()) + 2 * LENGTH, dtype=np.uint8)
    t[np.repeat(base - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(len(data))] = data
    word = _words(t)
    # Ranks of the 80 bytes from each cover sample on that a suffix refers to: 16 bytes, doubled to 32 and 64, then 64 + 16. Each is kept at the sample's place.
    used = np.zeros(len(t) + 1, dtype=np.int32)
    np.add.at(used, base, 1)
    np.add.at(used, base + windows + LENGTH - 80, -1)
    cover = np.resize(np.isin(np.arange(V), COVER), len(t))
    in80 = (np.cumsum(used)[:-1] > 0) & cover
    in32 = in80.copy()
    in32[32:] |= in80[:-32]
    in16 = in32.copy()
    in16[16:] |= in32[:-16]
    in16[64:] |= in80[:-64]

    def ranked(where: np.ndarray, a: np.ndarray, b: np.ndarray, far: int) -> np.ndarray:
        """Ranks, at the places ``where``, of a there followed by b ``far`` behind."""
        out = np.zeros(len(t), dtype=np.uint64)
        out[where] = _ranks((a[where] << np.uint64(32)) | b[where + far])
        return out

    at = np.flatnonzero(in16)
    by = np.lexsort((word[at + 8], word[at]))
    w, next_ = word[at[by]], word[at[by] + 8]
    r16 = np.zeros(len(t), dtype=np.uint64)
    r16[at[by]] = np.concatenate([[0], np.cumsum((w[1:] != w[:-1]) | (next_[1:] != next_[:-1]))])[: len(at)].astype(np.uint64)
    r32 = ranked(np.flatnonzero(in32), r16, r16, 16)
    r64 = ranked(np.flatnonzero(in80), r32, r32, 32)
    r80 = ranked(np.flatnonzero(in80), r64, r16, 64)
    # Suffixes. The nearest sample is less than 8 bytes away, and the farthest that ends within LENGTH leaves less than 8 bytes behind it.
    which = np.repeat(np.arange(len(sizes)), windows)
    start = np.repeat(base, windows) + np.arange(len(which)) - np.repeat(np.concatenate([[0], np.cumsum(windows)[:-1]]), windows)
    residue = start % V
    near = np.array([min(d for d in range(V) if (r + d) % V in COVER) for r in range(V)])
    far = np.array([max(d for d in range(LENGTH - 80 + 1) if (r + d) % V in COVER) for r in range(V)])
    # Bucket and residue, then the two ranks, in one number; where they need more bits than it has, what comes first is ranked.
    lot, one, two = (_ranks(bucket.view(np.uint64))[which] << np.uint64(4)) | residue.astype(np.uint64), r80[start + near[residue]], r80[start + far[residue]]
    bits = [int(x.max()).bit_length() if len(x) else 0 for x in (lot, one, two)]
    if sum(bits) > 64:
        lot = _ranks((lot << np.uint64(bits[1])) | one)
        key = (lot << np.uint64(bits[2])) | two
    else:
        key = (((lot << np.uint64(bits[1])) | one) << np.uint64(bits[2])) | two
    sorted_ = np.argsort(key)
    s = key[sorted_]
    twin = s[1:] == s[:-1]
    tied = np.concatenate([[False], twin]) | np.concatenate([twin, [False]]) if len(s) else np.zeros(0, dtype=bool)
    sorted_, group = sorted_[tied], np.cumsum(np.concatenate([[True], ~twin])[: len(s)])[tied]
    # Ties only: the bytes before the near and behind the far sample, then the order in the corpus.
    keys = [group, word[start[sorted_]], word[start[sorted_] + LENGTH - 8]]
    again = np.lexsort((order[which[sorted_]], *reversed(keys)))
    same = np.ones(max(0, len(again) - 1), dtype=bool)
    for k in keys:
        s = k[again]
        same &= s[1:] == s[:-1]
    out = np.zeros(len(which), dtype=bool)
    out[sorted_[again[1:][same]]] = True
    return out


def _runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of True."""
    edge = np.diff(np.concatenate([[0], flag.astype(np.int8), [0]]))
    start = np.flatnonzero(edge == 1)
    return start, np.flatnonzero(edge == -1) - start


def _adjacent(df: DataFrame) -> DataFrame:
    """Of rows (hash, id, text_hash) sorted by hash, those with an equal neighbour; a partition's first and last row too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        held_flag, first = False, True
        for batch in batches:
            if not batch.num_rows:
                continue
            table = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            h = table.column(0).to_numpy()
            equal = h[1:] == h[:-1]
            flag = np.concatenate([[held_flag if held is not None else first], equal]) | np.concatenate([equal, [False]])
            first = False
            yield table.slice(0, len(h) - 1).filter(pa.array(flag[:-1]))
            held, held_flag = table.slice(len(h) - 1), bool(flag[-1])
        if held is not None:
            yield held

    return df.mapInArrow(run, df.schema)


PIECE = "hash long, id long, text_hash long, place long, windows long, phase long, piece binary"
RANGE = "id long, text_hash long, place long, windows long"


NUMBERS = ("hash", "id", "text_hash", "place", "windows", "phase")


def _batched(t: np.ndarray, numbers: tuple[np.ndarray, ...], begin: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pieces in batches of about OUT_BYTES. numbers: NUMBERS; begin: where each piece begins in t."""
    sizes = numbers[4] + LENGTH - 1
    upto = np.cumsum(sizes)
    cuts = np.flatnonzero(np.diff(upto // OUT_BYTES)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)], strict=True):
        if a < b:
            yield pa.RecordBatch.from_arrays([*(pa.array(x[a:b]) for x in numbers), _binary(t, begin[a:b], sizes[a:b])], [*NUMBERS, "piece"])


def _pieces(df: DataFrame) -> DataFrame:
    """df: id, text_hash, text, shared (hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, at = _flat(batch.column(2))
            h, place, first, count = anchors(t, at[1:])
            text = np.searchsorted(at, first, "right") - 1
            lists = batch.column(3)
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            mine = lambda hashes, of: hashes ^ (of * 0x9E3779B97F4A7C1)  # noqa: E731 -- equal numbers by chance only add a piece
            hit = np.flatnonzero(np.isin(mine(h, text), mine(lists.flatten().to_numpy(), owner)))
            h, place, first, count, text = (x[hit] for x in (h, place, first, count, text))
            ids, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield from _batched(t, (h, ids[text], th[text], first - at[text], count, place - first), first)

    return df.mapInArrow(run, PIECE)


def _refined(df: DataFrame, width: int) -> DataFrame:
    """The pieces cut where their windows' distance from the anchor passes a multiple of ``width``; a bucket holds those with the same anchor, distance and core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, ids, th, place, windows, phase = (batch.column(n).to_numpy() for n in NUMBERS)
            t, at = _flat(batch.column("piece"))
            level, low = phase // width, (phase - windows + 1) // width  # a piece's windows lie phase, phase - 1, ... before the anchor
            n = level - low + 1
            of = np.repeat(np.arange(len(h)), n)
            level = np.repeat(level, n) - (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n))
            top = np.minimum(phase[of], (level + 1) * width - 1)
            bottom = np.maximum(phase[of] - windows[of] + 1, level * width)
            skip = phase[of] - top
            # What all windows of the level have in common: from the latest one's start to the earliest one's end.
            core = at[of] + phase[of] - level * width
            bucket = _hashed(t, core, LENGTH - width + 1) ^ (h[of].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (level.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            yield from _batched(t, (bucket.view(np.int64), ids[of], th[of], place[of] + skip, top - bottom + 1, top), at[of] + skip)

    return df.mapInArrow(run, PIECE)


def _hashed(t: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from each begin on. Different bytes with equal hashes share a bucket and are told apart there."""
    out = np.zeros(len(begin), dtype=np.uint64)
    for k in range(size):
        out = (out ^ (t[begin + k].astype(np.uint64) + np.uint64(1))) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out


def _first_pieces(df: DataFrame) -> DataFrame:
    """Sorted pieces: ``repeated`` is set where the piece before is equal; pieces that are seen to be alone in their bucket are left out."""
    schema = T.StructType([*df.schema.fields, T.StructField("repeated", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            both = now if before is None else pa.concat_tables([before, now])
            same = np.ones(len(both) - 1, dtype=bool)
            for name in ("hash", "phase", "piece"):
                column = both[name].combine_chunks()
                same &= pc.equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            twin = same if before is not None else np.concatenate([[False], same])
            h = now["hash"].to_numpy()
            bucket = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])])
            # Inside the batch a bucket is whole; its first and last one may go on beyond, so they are kept.
            alone = np.bincount(bucket, weights=~twin)[bucket] == 1
            alone &= (bucket > 0) & (bucket < bucket[-1]) & ~twin
            piece = pc.if_else(pa.array(twin), pa.scalar(None, pa.binary()), now["piece"].combine_chunks())
            out = now.set_column(now.column_names.index("piece"), "piece", piece).append_column("repeated", pa.array(twin))
            yield from out.filter(pa.array(~alone)).combine_chunks().to_batches()
            before = now.slice(len(now) - 1)

    return df.mapInArrow(run, schema)


def _sorted_blocks(df: DataFrame) -> DataFrame:
    """Whole buckets are gathered to blocks of about BLOCK_BYTES and go through the difference-cover sort; gives repeated ranges."""

    def block(rows: pa.Table) -> pa.RecordBatch:
        ids, th, place, windows, phase, bucket = (rows[n].to_numpy() for n in ("id", "text_hash", "place", "windows", "phase", "hash"))
        order = np.empty(len(rows), dtype=np.int64)
        order[np.lexsort((place, th, ids))] = np.arange(len(rows))
        piece = rows["piece"].combine_chunks()
        sizes = pc.binary_length(piece).to_numpy().astype(np.int64)
        data = np.frombuffer(b"".join(piece.to_pylist()), dtype=np.uint8)
        flag = repeated_suffixes(data, sizes, phase, windows, bucket, order)
        at = np.concatenate([[0], np.cumsum(windows)])
        which = np.repeat(np.arange(len(rows)), windows)
        inner = np.arange(len(flag)) - at[which]
        begins = np.flatnonzero(flag & ((inner == 0) | ~np.concatenate([[False], flag[:-1]])))
        last = np.concatenate([which[1:] != which[:-1], [True]]) if len(flag) else flag
        ends = np.flatnonzero(flag & (last | ~np.concatenate([flag[1:], [False]])))
        w = which[begins]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[w], th[w], place[w] + inner[begins], ends - begins + 1)], ["id", "text_hash", "place", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= BLOCK_BYTES:
                rows = pa.Table.from_batches(held).combine_chunks()
                h = rows["hash"].to_numpy()
                cut = int(np.flatnonzero(h != h[-1])[-1]) + 1 if (h != h[-1]).any() else 0
                if cut:
                    yield block(rows.slice(0, cut))
                held = rows.slice(cut).combine_chunks().to_batches()
                size = sum(b.nbytes for b in held)
        if sum(b.num_rows for b in held):
            yield block(pa.Table.from_batches(held).combine_chunks())

    return df.repartition("hash").sortWithinPartitions("hash").mapInArrow(run, RANGE)


def repeated_ranges(spark: SparkSession, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """id, text_hash, place, windows of the repeated windows of distinct texts. docs: id, text_hash, text."""
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def tidy(*steps: str) -> None:
        scratch.drop(*steps)
        gc.collect()  # the driver frees shuffle files of plans that nothing holds any more
        spark._jvm.System.gc()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, at = _flat(batch.column(2))
            h, _, first, _ = anchors(t, at[1:])
            text = np.searchsorted(at, first, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(h), *(pa.array(batch.column(i).to_numpy()[text]) for i in (0, 1))], ["hash", "id", "text_hash"])

    every = scratch.save(docs.select("id", "text_hash", "text").mapInArrow(find, "hash long, id long, text_hash long"), "anchors")
    shared = _adjacent(every.repartitionByRange(files, "hash", "id", "text_hash").sortWithinPartitions("hash"))
    shared = scratch.save(shared.groupBy("id", "text_hash").agg(F.collect_set("hash").alias("shared")), "shared")
    tidy("anchors")
    pieces = scratch.save(_pieces(docs.join(shared, ["id", "text_hash"]).select("id", "text_hash", "text", "shared")), "pieces-0")
    tidy("shared")
    order, found = ["hash", "phase", "piece", "id", "text_hash", "place"], []
    for level, width in enumerate((*REFINE, 0)):
        first = scratch.save(_first_pieces(pieces.repartitionByRange(files, *order).sortWithinPartitions(*order)), f"first-{level}")
        tidy(f"pieces-{level}")
        found.append(first.filter("repeated").select("id", "text_hash", "place", "windows"))
        rest = first.filter("NOT repeated").drop("repeated")
        sizes = scratch.save(rest.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1"), f"sizes-{level}")
        fit = sizes.filter(F.col("n") <= CROWD) if width else sizes  # single windows in a bucket are all equal, but for chance
        found.append(scratch.save(_sorted_blocks(rest.join(fit.select("hash"), "hash", "left_semi")), f"sorted-{level}"))
        crowded = sizes.filter(F.col("n") > CROWD).select("hash")
        if not width or crowded.isEmpty():
            break
        pieces = scratch.save(_refined(rest.join(crowded, "hash", "left_semi"), width), f"pieces-{level + 1}")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _cut(df: DataFrame) -> DataFrame:
    """df: doc_id, id, text_hash, text, ranges (null: none), copy. Gives the counts and the digest of what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, at = _flat(batch.column(1))
            sizes = np.diff(at)
            lists, copy = batch.column(2), batch.column(3).to_numpy(zero_copy_only=False) & (sizes >= LENGTH)
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
            ranges = lists.flatten()
            place, windows = (ranges.field(n).to_numpy() for n in ("place", "windows"))
            begin = np.concatenate([at[owner] + place, at[:-1][copy]])
            end = np.concatenate([at[owner] + place + windows + LENGTH - 1, at[1:][copy]])
            gone = np.cumsum(np.bincount(begin, minlength=len(t) + 1) - np.bincount(end, minlength=len(t) + 1))[:-1] > 0
            upto = np.concatenate([[0], np.cumsum(gone)])
            removed = upto[at[1:]] - upto[at[:-1]]
            starts = gone.copy()
            starts[1:] &= ~gone[:-1]
            heads = at[:-1][sizes > 0]
            starts[heads] = gone[heads]
            upto = np.concatenate([[0], np.cumsum(starts)])
            spans = upto[at[1:]] - upto[at[:-1]]
            kept = np.ascontiguousarray(t[~gone])
            edge = np.concatenate([[0], np.cumsum(sizes - removed)])
            view = memoryview(kept)
            digests = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            rest = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(kept)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(removed), pa.array(spans), pa.array(digests, pa.string()), rest], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])

    return df.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")


def deduplicate(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes of every document."""
    small_batches(spark)
    scratch = Scratch(spark, "substrings")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("id", F.coalesce("doc_id", F.lit(NULL_ID))).withColumn("text_hash", F.xxhash64("text"))
    keys = d.select("id", "text_hash", F.octet_length("text").alias("size"), F.sha2("text", 256).alias("sha"))
    keys = scratch.save(keys.filter(F.col("size") >= LENGTH), "keys")
    heads = keys.groupBy("sha").agg(F.min(F.struct("id", "text_hash")).alias("head")).select("head.*").distinct()
    copies = scratch.save(keys.select("id", "text_hash").distinct().join(heads, ["id", "text_hash"], "left_anti").withColumn("copy", F.lit(True)), "copies")
    marked = d.join(copies, ["id", "text_hash"], "left")
    distinct = marked.filter("copy IS NULL").filter(F.octet_length("text") >= LENGTH).select("id", "text_hash", "text")
    again = scratch.save(keys.groupBy("id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "again")
    if not again.isEmpty():  # rows that are one document go in once; the other texts need no shuffle for that
        once = distinct.join(again, ["id", "text_hash"], "left_semi").dropDuplicates(["id", "text_hash"])
        distinct = distinct.join(again, ["id", "text_hash"], "left_anti").unionByName(once)
    found = repeated_ranges(spark, distinct, scratch)
    ranges = found.groupBy("id", "text_hash").agg(F.collect_list(F.struct("place", "windows")).alias("ranges"))
    final = marked.join(ranges, ["id", "text_hash"], "left").select("doc_id", "text", "ranges", F.coalesce("copy", F.lit(False)).alias("copy"))
    return _cut(final)


def op7(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return deduplicate(spark, docs).drop("kept_bytes")
