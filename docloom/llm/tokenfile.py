"""Token ids in Arrow files of equal-length sequences, each with its mask.

A file is an Arrow stream file (IPC file format: a footer has every batch's place) with two
columns of fixed-size lists: ``ids`` (LENGTH unsigned ids, of 16 bits where the vocabulary has
no more, else of 32) and ``mask`` (a bit for each id, not set for padding). All its batches but the last have BATCH sequences, so sequence k is
row k % BATCH of batch k // BATCH, and a mapped file gives it as a view of numpy's without
copying or reading anything else (``Shard``). Documents stand one after the other in ascending
doc_id order, each with its end id, over the ends of sequences; a file's last sequence alone is
padded.

Texts are sorted by range over the cluster. Each task encodes its range and writes it into
files of about FILE_IDS ids, closing a file where the next document would go over that, so a
document lies in one file and a task holds a batch and a document. A task that runs again writes
files of other names; the index, a table with a row for each document that Spark commits, names
the files that count. Numbers of ids before a document add up from the tasks' sums (one row a
task). Files go to the folder through Arrow's file systems, by the folder's URI.

Encoding: the ids of the tokenizers library. Its pattern never matches over white space and its
normal form changes no character by a neighbour beyond it, so a text can be encoded in parts,
and parts that come again are remembered: runs without white space, and their pieces. Runs of
a text of ASCII and Latin-1 letters alone are cut into pieces by the pattern itself (the normal
form there is lower case), and the library's model gives a piece's ids; of any other text the
library encodes each run, and one with a special token's string as a whole. A test holds all of
these equal to whole texts' ids.

Cases: a null text is an empty one, whose only id is the end. A null doc_id sorts first, rows of
one doc_id by a hash of their text; rows that repeat both are equal, and numbers deal them out.
The strings of the vocabulary's special tokens have those ids, as the library gives them. An
empty table gives no rows and no files. Other columns are not read.
"""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary, materialise, scratch_dir, table

LENGTH = 2048
BATCH = 64
FILE_IDS = 1 << 24
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
#: Parts of up to so many bytes or characters are remembered, so many of them in either of two generations.
SHORT, REMEMBERED = 32, 1 << 18
#: What the vocabulary's pattern matches in lower case, of ASCII and the letters of Latin-1.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t-\ra-zß-öø-ÿ0-9]+")
OTHER = re.compile(r"[^\x00-\x7FÀ-ÖØ-öø-ÿ]")


class Remembered(dict):
    """A part of a text, as bytes or characters -> its ids as bytes.

    When it is full it becomes the old generation and begins anew; what is still asked for moves over.
    """

    def __init__(self, ids):
        self.ids, self.old = ids, {}

    def __missing__(self, part: bytes | str) -> bytes:
        found = self.old.get(part)
        if found is None:
            found = self.ids(part)
        if len(part) <= SHORT:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[part] = found
        return found


class Encoder:
    """text (UTF-8 bytes) -> its ids, end to end in ``kind``."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.pieces, self.latin, self.runs = Remembered(self._piece), Remembered(self._latin), Remembered(lambda run: self._whole(run.decode("utf-8", "replace")))

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isprintable()):
            return self._whole(piece)
        return np.array([t.id for t in self.library.model.tokenize(piece)], self.kind).tobytes()

    def _latin(self, run: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, PIECES.findall(run.decode().lower())))

    def __call__(self, data: bytes) -> bytes:
        text = data.decode("utf-8", "replace")
        if any(t in text for t in self.special):
            return self._whole(text)
        if text.isascii() or not OTHER.search(text):
            return b"".join(map(self.latin.__getitem__, data.lower().split()))
        return b"".join(map(self.runs.__getitem__, data.split()))  # bytes are split at ASCII's white space alone


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """Made once a worker."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def schema(length: int, kind: np.dtype) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])


def file_system(uri: str):
    """Arrow's file system of a URI or an absolute path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Writer:
    """Writes ids into one file: whole batches as they fill, the padded rest at the end."""

    def __init__(self, uri: str, length: int, batch: int, kind: np.dtype):
        system, path = file_system(uri)
        self.uri, self.shape, self.length, self.size = uri, schema(length, kind), length, length * batch
        self.sink = system.open_output_stream(path)
        self.file = pa.ipc.new_file(self.sink, self.shape)
        self.held, self.waiting, self.n = [], 0, 0

    def add(self, ids: np.ndarray) -> int:
        """Where the ids begin in the file."""
        start = self.n
        self.held.append(ids)
        self.waiting += len(ids)
        self.n += len(ids)
        if self.waiting >= self.size:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.size * self.size
            for at in range(0, whole, self.size):
                self._write(flat[at : at + self.size], self.size)
            self.held, self.waiting = [flat[whole:].copy()], len(flat) - whole
        return start

    def _write(self, ids: np.ndarray, n: int) -> None:
        mask = np.arange(len(ids)) < n
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(a), self.length) for a in (ids, mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.shape))

    def close(self) -> None:
        if self.waiting:
            flat = np.concatenate(self.held)
            padded = np.zeros(-(-len(flat) // self.length) * self.length, flat.dtype)
            padded[: len(flat)] = flat
            self._write(padded, len(flat))
        self.file.close()
        self.sink.close()


class Shard:
    """Random access to a file's sequences; those of a local file are views of its mapped pages."""

    def __init__(self, uri: str):
        from pyarrow import fs

        system, path = file_system(uri)
        self.source = pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.batch = len(self._batch(0)[0]) // self.length if self.file.num_record_batches else 1
        self.last: tuple = (None, None)

    def _batch(self, number: int) -> tuple[np.ndarray, pa.BooleanArray]:
        batch = self.file.get_batch(number)
        return batch.column(0).flatten().to_numpy(zero_copy_only=True), batch.column(1).flatten()

    def __len__(self) -> int:
        n = self.file.num_record_batches
        return (n - 1) * self.batch + len(self._batch(n - 1)[0]) // self.length if n else 0

    def sequence(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence k."""
        ids, mask = self._batch(k // self.batch)
        at = k % self.batch * self.length
        return ids[at : at + self.length], mask.slice(at, self.length)

    def parts(self, start: int, n: int):
        """The n ids from start on, as one view for each batch that they lie in."""
        size = self.batch * self.length
        while n > 0:
            number, at = divmod(start, size)
            if self.last[0] != number:
                self.last = (number, self._batch(number)[0])
            view = self.last[1][at : at + n]
            if not len(view):
                raise EOFError(f"the file has no ids at {start}")
            yield view
            start, n = start + len(view), n - len(view)

    def close(self) -> None:
        self.last = (None, None)
        self.source.close()


INDEX = "doc_id bigint, file string, first bigint, n_tokens bigint, task int, before bigint"


def write(docs: DataFrame, folder: str, length: int = LENGTH, batch: int = BATCH, file_ids: int = FILE_IDS, vocabulary: str = VOCABULARY, end: int = END_ID) -> DataFrame:
    """Writes docs' ids under the folder; the index: doc_id, file, first (its place there), n_tokens and start (ids of all documents before)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row_no"))
    order = ["doc_id", F.xxhash64("text"), "row_no"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches):
        encode, task, before = encoder(vocabulary), TaskContext.get().partitionId(), 0
        last, attempt, number = np.array([end], encode.kind).tobytes(), uuid.uuid4().hex[:12], 0
        out = None
        for rows in batches:
            found: list[tuple] = []
            for doc, text in zip(rows.column("doc_id").to_pylist(), binary(rows, "text"), strict=True):
                ids = np.frombuffer(encode(text) + last, encode.kind)
                if out is not None and out.n + len(ids) > file_ids:
                    out.close()
                    out = None
                if out is None:
                    out, number = Writer(f"{folder}/{task:06d}-{number:04d}-{attempt}.arrow", length, batch, encode.kind), number + 1
                found.append((doc, out.uri, out.add(ids), len(ids), task, before))
                before += len(ids)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            columns = zip(*found, strict=True) if found else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "file", "first", "n_tokens", "task", "before"])
        if out is not None:
            out.close()

    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    index = materialise(ranged.mapInArrow(run, INDEX), "tokenindex")
    base, plan = 0, []
    for r in index.groupBy("task").agg(F.sum("n_tokens").alias("n")).orderBy("task").collect():
        plan.append((r["task"], base))
        base += r.n
    bases = docs.sparkSession.createDataFrame(plan, "task int, base bigint")
    return index.join(F.broadcast(bases), "task").select("doc_id", "file", "first", "n_tokens", (F.col("base") + F.col("before")).alias("start"))


def read(index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of the index's documents, from the files."""

    def run(batches):
        shard, name = None, None
        for rows in batches:
            sums = []
            for file, first, n in zip(*(rows.column(c).to_pylist() for c in ("file", "first", "n_tokens")), strict=True):
                if file != name:
                    if shard is not None:
                        shard.close()
                    shard, name = Shard(file), file
                crc = 0
                for part in shard.parts(first, n):
                    crc = zlib.crc32(part.astype("<u4").data, crc)
                sums.append(crc)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("start"), rows.column("n_tokens"), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
        if shard is not None:
            shard.close()

    return index.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def sequences(index: DataFrame) -> DataFrame:
    """file, sequence (its number there), ids and mask: every sequence of the index's files."""
    shape = "file string, sequence bigint, ids array<bigint>, mask array<boolean>"

    def run(batches):
        for rows in batches:
            for uri in rows.column("file").to_pylist():
                shard, done = Shard(uri), 0
                for number in range(shard.file.num_record_batches):
                    got = shard.file.get_batch(number)
                    k = got.num_rows
                    ids, mask = (got.column(c).cast(pa.list_(t)) for c, t in ((0, pa.int64()), (1, pa.bool_())))
                    yield pa.RecordBatch.from_arrays([pa.array([uri] * k), pa.array(range(done, done + k), pa.int64()), ids, mask], names=["file", "sequence", "ids", "mask"])
                    done += k
                shard.close()

    return index.select("file").distinct().mapInArrow(run, shape)


def op13_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    return read(write(table(spark, sf_dir, "documents"), folder))


QUERIES = {"op13_tokenfile": op13_tokenfile}
ORACLES: dict[str, str] = {}
