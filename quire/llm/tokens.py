"""Token ids in binary files of independent zstandard frames with a trailing seek table.

A file holds the token ids of consecutive documents as little-endian unsigned 32-bit integers. A frame holds whole documents, about FRAME_IDS
ids of them. The last frame is the index: document ids, token counts and frame numbers. Behind it stands the seek table of the zstandard
seekable format: a skippable frame that gives the compressed and plain size and a 32-bit checksum of every frame. A reader takes the
seek table and the index, and decompresses only the frames of the documents that are asked for, checking each frame's sum.

Documents are put in order of doc_id (null first, then by text) over range partitions, one file each. A file is written under the attempt's own name and then
renamed, so that a task that is run again replaces it by the same bytes.

Nulls: a null text is empty; its document has the end id alone. Repeated rows are documents of their own. An empty table gives files without documents.
A text of any length is one document of one frame. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, documents, small_batches

#: Ids of a frame, zstandard's level, pieces that a generation remembers, bytes of text that are encoded together.
#: Bytes of text of a file at most, on average; the sizes in a file's index are 32-bit.
FILE_BYTES = 1 << 30
FRAME_IDS, LEVEL, PIECES, TEXT_BYTES = 1 << 16, 3, 700_000, 1 << 23
#: So many new pieces are given to the tokenizer at a time at most; what it returns takes many times their bytes.
LEARN = 20_000
SKIPPABLE, SEEKABLE, WITH_SUMS = 0x184D2A5E, 0x8F92EAB1, 0x80

#: White space other than spaces and newlines, and those next to each other: there, pieces can't be told apart simply.
_UNEVEN = tuple(x.encode() for x in (*(chr(i) for i in range(0x3001) if chr(i).isspace() and chr(i) not in " \n"), "  ", " \n", "\n ", "\n\n"))
#: Signs that are cut off a new piece's end, so that fewer pieces are new; no more than MOST_TAIL of them, which bounds how many ends there are.
_TAIL, MOST_TAIL = b".,;:!?#$%&*|<>()", 3


class Encoder:
    """Whole texts to ids with the tokenizers library, by way of pieces that begin with a single space or newline.

    A byte-level tokenizer that splits by its regular expression never joins what stands before a space that a word follows with what comes after it, nor across a single newline,
    nor letters or digits with the signs that follow; so a piece has the same ids in every text. The distinct pieces of many texts are looked up among those seen before; new ones are
    encoded together. Texts with other white space, or with the text of one of the tokenizer's added tokens, are encoded at once, as are all texts with another kind of tokenizer. What is
    remembered comes in two generations of ``most`` pieces each (PIECES, if not said) and those of one call: a full one becomes the older, and what is used again moves to the younger.
    """

    _made: dict[tuple[str, int | None], Encoder] = {}

    def __init__(self, path: str, most: int | None = None) -> None:
        from tokenizers import Tokenizer

        self.most = most
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        split = made["pre_tokenizer"] or {}
        self.splits = made["normalizer"] is None and split.get("type") == "ByteLevel" and bool(split.get("use_regex")) and not split.get("add_prefix_space")
        size = self.tokenizer.get_vocab_size()
        self.starts = np.array([(self.tokenizer.id_to_token(i) or "")[:1] in ("Ġ", "Ċ") for i in range(size)])
        self.odd = _UNEVEN + tuple(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.tails: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str, most: int | None = None) -> Encoder:
        if (path, most) not in cls._made:
            cls._made[path, most] = cls(path, most)
        return cls._made[path, most]

    def _ids(self, texts: list[bytes]) -> np.ndarray:
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return np.concatenate([np.array(x.ids, dtype="<u4") for x in found])

    def _recall(self, pieces: list[bytes]) -> tuple[dict[bytes, bytes | None], list[bytes]]:
        """What is known of distinct ``pieces``, and those that aren't known."""
        found = list(map(self.young.get, pieces))
        out = dict(zip(pieces, found, strict=True))
        missing = [x for x, ids in zip(pieces, found, strict=True) if ids is None] if None in found else []
        if missing and self.old:
            again = {x: ids for x, ids in zip(missing, map(self.old.get, missing), strict=True) if ids is not None}
            self.young.update(again)
            out.update(again)
            missing = [x for x in missing if x not in again]
        return out, missing

    def _learn(self, pieces: list[bytes], into: dict[bytes, bytes]) -> None:
        for k in range(0, len(pieces), LEARN):
            self._learn_some(pieces[k : k + LEARN], into)

    def _learn_some(self, new: list[bytes], into: dict[bytes, bytes]) -> None:
        ids = self._ids([b"".join(new[i : i + 200]) for i in range(0, len(new), 200)])
        starts = np.flatnonzero(self.starts[ids])
        if len(starts) != len(new):
            raise ValueError("the tokenizer joins words; it is not one that this encoder knows")
        raw, at = ids.tobytes(), (4 * starts).tolist()
        found = dict(zip(new, (raw[a:b] for a, b in zip(at, [*at[1:], len(raw)], strict=True)), strict=True))
        into.update(found)
        self.young.update(found)

    def _tail(self, tail: bytes) -> bytes:
        if tail not in self.tails:
            self.tails[tail] = self._ids([tail]).tobytes()
        return self.tails[tail]

    def _known(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each of ``pieces``, which are distinct and begin with a space or newline."""
        if len(self.young) > (self.most or PIECES):
            self.old, self.young = self.young, {}
        out, missing = self._recall(pieces)
        cut, whole = [], []
        for x in missing:
            stem = x.rstrip(_TAIL)
            if stem is not x and len(x) - len(stem) <= MOST_TAIL and (stem[-1:].isalnum() or (stem[-1] > 127 and stem.decode()[-1].isalnum())):
                cut.append((x, stem))
            else:
                whole.append(x)
        self._learn(whole, out)
        stems, new = self._recall(list({stem for _, stem in cut}))
        self._learn(new, stems)
        joined = {x: stems[stem] + self._tail(x[len(stem) :]) for x, stem in cut}
        self.young.update(joined)
        out.update(joined)
        return list(map(out.__getitem__, pieces))

    def _pieces(self, flat: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Where each piece of ``flat`` begins, which of the distinct ones it is, and the ids of these."""
        t = np.frombuffer(flat, dtype=np.uint8)
        at = np.flatnonzero((t == 32) | (t == 10))
        offsets = np.append(at, len(t)).astype(np.int32)
        array = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).dictionary_encode()
        return at, array.indices.to_numpy(), self._known(array.dictionary.to_pylist())

    @staticmethod
    def _sizes(known: list[bytes]) -> np.ndarray:
        return np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4

    def _pieced(self, flat: bytes, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of ids of even texts; flat holds them one after another with a newline before each, counts their bytes with it."""
        at, which, known = self._pieces(flat)
        ids = np.frombuffer(b"".join(known), dtype="<u4")
        sizes = self._sizes(known)
        begins = np.cumsum(sizes) - sizes
        n = sizes[which]
        upto = np.cumsum(n)
        first = np.searchsorted(at, np.cumsum(counts) - counts)  # each text's first piece
        of_text = np.diff(np.append(upto[first] - n[first], upto[-1]))
        keep = np.ones(int(upto[-1]), dtype=bool)
        keep[upto[first] - n[first]] = False  # the newline that was put before the text
        return ids[np.repeat(begins[which] - (upto - n), n) + np.arange(int(upto[-1]))][keep], of_text - 1

    def _parted(self, texts: pa.Array) -> tuple[list[bytes], list[bool], bytes]:
        """The texts' bytes, whether each is even and has any, and the even ones one after another with a newline before each."""
        parts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts]
        flat = b"\n".join([b"", *filter(None, parts)])
        even = [bool(p) for p in parts]
        if not self.splits or any(x in flat for x in self.odd) or flat[-1:] in (b" ", b"\n"):
            even = [bool(p) and self.splits and p[0] not in b" \n" and p[-1] not in b" \n" and not any(x in p for x in self.odd) for p in parts]
            flat = b"\n".join([b"", *(p for p, e in zip(parts, even, strict=True) if e)])
        return parts, even, flat

    def count(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has; they are not put together."""
        parts, even, flat = self._parted(texts)
        counts = np.array([0 if e or not p else len(self._ids([p])) for p, e in zip(parts, even, strict=True)], dtype=np.int64)
        if any(even):
            at, which, known = self._pieces(flat)
            sizes = np.array([len(p) + 1 for p, e in zip(parts, even, strict=True) if e])
            first = np.searchsorted(at, np.cumsum(sizes) - sizes)  # each text's first piece
            counts[even] = np.add.reduceat(self._sizes(known)[which], first) - 1  # without the newline that was put before the text
        return counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has; null texts have none."""
        parts, even, flat = self._parted(texts)
        counts = np.zeros(len(parts), dtype=np.int64)
        ids = np.zeros(0, dtype="<u4")
        if any(even):
            ids, counts[even] = self._pieced(flat, np.array([len(p) + 1 for p, e in zip(parts, even, strict=True) if e]))
        if all(e or not p for p, e in zip(parts, even, strict=True)):
            return ids, counts
        rest, out = iter(np.split(ids, np.cumsum(counts[even])[:-1]) if any(even) else ()), []
        for k, (p, e) in enumerate(zip(parts, even, strict=True)):
            if e or p:
                out.append(next(rest) if e else self._ids([p]))
                counts[k] = len(out[-1])
        return np.concatenate(out), counts


def gathered(batches: Iterator[pa.RecordBatch], text: int, size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts (column number ``text``) have about ``size`` bytes; a longer text makes a batch."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.column(text).nbytes
        if n >= size:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


class ShardWriter:
    """Writes one file; documents come in order."""

    def __init__(self, sink) -> None:
        self.sink, self.zstd = sink, zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.seek: list[bytes] = []
        self.part: list[bytes] = []
        self.held = self.tokens = 0
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        self.frames: list[int] = []

    def _frame(self, plain: bytes) -> None:
        packed = self.zstd.compress(plain)
        self.sink.write(packed)
        self.seek.append(struct.pack("<III", len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, raw: bytes) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(raw) // 4)
        self.frames.append(len(self.seek))
        self.part.append(raw)
        self.held += len(raw) // 4
        self.tokens += len(raw) // 4
        if self.held >= FRAME_IDS:
            self.flush()

    def flush(self) -> None:
        if self.part:
            self._frame(b"".join(self.part))
            self.part, self.held = [], 0

    def close(self) -> None:
        self.flush()
        index = pa.RecordBatch.from_arrays([pa.array(self.ids, pa.int64()), pa.array(self.counts, pa.int64()), pa.array(self.frames, pa.int64())], ["doc_id", "n_tokens", "frame"])
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, index.schema) as writer:
            writer.write_batch(index)
        self._frame(out.getvalue().to_pybytes())
        body = b"".join(self.seek) + struct.pack("<IBI", len(self.seek), WITH_SUMS, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


class ShardReader:
    """Random access to the documents of one file; ``source`` can seek, read and tell its size."""

    def __init__(self, source) -> None:
        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or not flags & WITH_SUMS:
            raise ValueError("no seek table with checksums")
        entries = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), dtype="<u4").reshape(n, 3).astype(np.int64)
        self.sizes, self.sums = entries[:, 0], entries[:, 2]
        self.places = np.concatenate([[0], np.cumsum(self.sizes)])
        with pa.ipc.open_stream(self.frame(n - 1)) as stream:
            index = stream.read_all()
        self.ids, self.counts, self.frames = index["doc_id"].to_pylist(), index["n_tokens"].to_numpy(), index["frame"].to_numpy()
        before = np.concatenate([[0], np.cumsum(self.counts)])
        first = {}
        for i, f in enumerate(self.frames.tolist()):
            first.setdefault(f, i)
        self.offsets = [int(before[i] - before[first[f]]) for i, f in enumerate(self.frames.tolist())]

    def _at(self, place: int, n: int) -> bytes:
        self.source.seek(int(place))
        return self.source.read(int(n))

    def frame(self, k: int) -> bytes:
        plain = self.zstd.decompress(self._at(self.places[k], self.sizes[k]))
        if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} doesn't match its checksum")
        return plain

    def document(self, doc_id: int) -> np.ndarray:
        i = self.ids.index(doc_id)
        raw = self.frame(int(self.frames[i]))
        return np.frombuffer(raw, dtype="<u4", count=int(self.counts[i]), offset=4 * self.offsets[i])

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        """All documents in order; one frame is held at a time."""
        now, raw = -1, b""
        for i, f in enumerate(self.frames.tolist()):
            if f != now:
                now, raw = f, self.frame(f)
            yield self.ids[i], raw[4 * self.offsets[i] : 4 * (self.offsets[i] + int(self.counts[i]))]


def _place(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


def drop_unnamed(manifest: DataFrame, folder: str) -> int:
    """Deletes files below the folder that the manifest doesn't name, such as those of attempts that were run again; gives their number. The names, one a file, are held by the driver."""
    fs, base = _place(folder)
    named = {r["path"] for r in manifest.select("path").collect()}
    gone = [f.path for f in fs.get_file_info(pa.fs.FileSelector(base)) if f.path.endswith(".ids.zst") and f.path not in named]
    for path in gone:
        fs.delete_file(path)
    return len(gone)


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, folder: str, files: int) -> DataFrame:
    """Writes the files below ``folder``, a URI that all executors reach; gives file_no, path, n_docs, n_tokens of each. Run it once: save the result."""
    d = documents(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Ties of doc_id are ordered by text; the start of the text splits many rows of one doc_id, or of none, over ranges in the same order.
    d = d.repartitionByRange(files, "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        encoder = Encoder.of(tokenizer)
        fs, base = _place(folder)
        fs.create_dir(base, recursive=True)
        # A name of its own for each attempt: one that is run again leaves a file that no manifest names, and nothing is renamed onto what is there.
        path = f"{base}/part-{number:06d}-{uuid.uuid4().hex}.ids.zst"
        with fs.open_output_stream(path, compression=None) as sink:  # the name must not add a layer of compression
            out = ShardWriter(sink)
            for batch in gathered(batches, 1, TEXT_BYTES):
                ids, counts = encoder.encode(batch.column(1))
                raw, at = memoryview(ids.tobytes()), 0
                for doc_id, n in zip(batch.column(0).to_pylist(), (4 * counts).tolist(), strict=True):
                    out.add(doc_id, bytes(raw[at : at + n]) + end)
                    at += n
            out.close()
        yield pa.RecordBatch.from_pydict({"file_no": [number], "path": [path], "n_docs": [len(out.ids)], "n_tokens": [out.tokens]}, schema=pa.schema([("file_no", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return d.mapInArrow(write, "file_no long, path string, n_docs long, n_tokens long")


def read_shards(manifest: DataFrame, folder: str, files: int) -> DataFrame:
    """Every document of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32, file_no."""
    run = F.sum("n_tokens").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1))  # one row a file
    jobs = manifest.select("file_no", "path", F.coalesce(run, F.lit(0)).alias("start")).repartitionByRange(files, "file_no")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _place(folder)
        for batch in batches:
            for job in batch.to_pylist():
                at, rows = job["start"], []
                with fs.open_input_file(job["path"]) as source:
                    for doc_id, raw in ShardReader(source).documents():
                        rows.append((doc_id, at, len(raw) // 4, zlib.crc32(raw), job["file_no"]))
                        at += len(raw) // 4
                        if len(rows) >= 10_000:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    return jobs.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file_no long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32", "file_no")
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    small_batches(spark)
    scratch = Scratch(spark, "tokens")
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    folder = scratch.path("ids")
    manifest = scratch.save(write_shards(docs, tokenizer or default_tokenizer(), end_id, folder, files), "manifest")
    return read_shards(manifest, folder, files)
