"""Token ids in binary files of patched frame-of-reference blocks.

Documents are range-sorted by id, so that a task holds a stretch of them. It encodes their texts, ends each with the end id
and writes one file: blocks of ``BLOCK`` ids (a parameter), then the lengths and the ids of its documents in blocks of the same kind, then
the index of block starts and a footer. A block keeps its minimum, packs what is above it at the width that ``SHARE`` of its
values need, and lists the others: their places and the bits that did not fit. Tasks report files in a manifest that Spark
writes and commits: files of lost or doubled attempts are in no manifest and are never read.

A reader task streams a file block by block; ``read_range`` opens only the blocks that the index names for a stretch of the
global sequence. Files are opened through ``pyarrow.fs``, so the folder may be in any store that it knows (file, hdfs, s3, gs, abfs).

The tokenizer is a parameter. One that drops blanks and cuts at them (``apart``) encodes each different word once for a
process, which keeps up to ``WORDS_HELD`` words; others get whole texts. Words are known by 64-bit hashes. Where its file says
that it folds cases and cuts between letters, digits and the rest (``FOLDS``, ``CUTS``), words of ASCII and Latin-1 letters are
folded and cut so first, and their parts are what is encoded once; words with other characters, apostrophes or characters of
special tokens stay whole.

Defined cases: a null text is empty and has the end id alone; documents without id come first; those of one id keep the order
in which they are read; repeated rows are documents of their own; strings of special tokens become these tokens, as the
tokenizer does by itself; further columns are ignored; an empty table makes a manifest without files and no rows. Texts of
any length are encoded whole and written block by block, and read as chunks that end with a block.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import text_batches
from kinfold.llm.tokens import U, Words, buffers, lists, pieces
from kinfold.session import materialize, scratch, shared_path

VOCABULARY, END = "word_bpe_49k.json", 1
#: Values of a block, and the share of them that the packed width must hold.
BLOCK, SHARE = 1 << 14, 0.9
#: Bytes of text that are encoded at once, and words whose ids a process keeps.
TEXT_BYTES, WORDS_HELD = 8 << 20, 1 << 20
RULE = Words(fold=False)
#: The normalizer and the cuts of a tokenizer whose words may be cut before it sees them.
FOLDS = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
CUTS = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: What a byte is to these cuts.
BLANK, LETTER, DIGIT, REST, WHOLE = range(5)
#: Parts that are encoded as one text, and strings that are encoded at once.
JOINED, AT_ONCE = 256, 1 << 16
MAGIC = b"KFTOKENS"
#: Values, minimum, packed width, exceptions, width of their upper bits.
HEAD = struct.Struct("<IqBIB")
#: Values of a block, documents, ids, blocks of ids, of lengths and of document ids, start of the index.
FOOT = struct.Struct("<IQQIIIQ8s")
MANIFEST = "part int, file string, documents long, ids long, bytes long"
CHUNKS = "doc_id long, start long, n_tokens long, chunk_no int, ids array<int>"


def _spread(values: np.ndarray, kind: type) -> np.ndarray:
    """Values in eight rows, those of a group of eight in a column; zeros fill the last group."""
    out = np.zeros((-(-len(values) // 8), 8), kind)
    out.ravel()[: len(values)] = values
    return np.ascontiguousarray(out.T)


def pack(values: np.ndarray, width: int) -> bytes:
    """The lower ``width`` bits of unsigned values, most significant first, without gaps."""
    # Eight values fill ``width`` bytes; a byte takes bits of the values that meet in it.
    rows = _spread(values, np.uint32 if width <= 32 else U)
    out = np.zeros((width, rows.shape[1]), np.uint8)
    for k in range(width):
        for j in range(8 * k // width, (8 * k + 7) // width + 1):
            shift = (j + 1) * width - 8 * k - 8
            out[k] |= (rows[j] >> shift if shift > 0 else rows[j] << -shift).astype(np.uint8)
    return out.T.tobytes()[: -(-len(values) * width // 8)]


def unpack(data: memoryview, n: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(n, U)
    kind = np.uint32 if width <= 32 else U
    raw = np.zeros(-(-n // 8) * width, np.uint8)
    raw[: -(-n * width // 8)] = np.frombuffer(data, np.uint8, -(-n * width // 8))
    raw = np.ascontiguousarray(raw.reshape(-1, width).T).astype(kind)
    out = np.zeros((8, raw.shape[1]), kind)
    for j in range(8):
        for k in range(j * width // 8, ((j + 1) * width - 1) // 8 + 1):
            shift = (j + 1) * width - 8 * k - 8
            out[j] |= raw[k] << shift if shift > 0 else raw[k] >> -shift
    return (out & kind(2**width - 1)).T.ravel()[:n].astype(U)


def encode_block(values: np.ndarray, share: float = SHARE) -> bytes:
    """A block of signed 64-bit values."""
    low = int(values.min())
    above = values.astype(np.int64).view(U) - U(low % 2**64)
    width = int(np.partition(above, k := max(0, int(np.ceil(share * len(above))) - 1))[k]).bit_length()
    upper = above >> U(width) if width < 64 else np.zeros(len(above), U)
    odd = np.flatnonzero(upper)
    upper = upper[odd]
    more = int(upper.max(initial=0)).bit_length()
    kept = above & U(2**width - 1)
    return HEAD.pack(len(values), low, width, len(odd), more) + pack(kept, width) + odd.astype("<u4").tobytes() + pack(upper, more)


def block_bytes(head: bytes) -> int:
    """Length of a block from its first bytes."""
    n, _, width, odd, more = HEAD.unpack(head[: HEAD.size])
    return HEAD.size + -(-n * width // 8) + 4 * odd + -(-odd * more // 8)


def decode_block(data: bytes) -> np.ndarray:
    n, low, width, odd, more = HEAD.unpack(data[: HEAD.size])
    view = memoryview(data)
    at = HEAD.size + -(-n * width // 8)
    above = unpack(view[HEAD.size : at], n, width)
    if odd:
        place = np.frombuffer(view[at : at + 4 * odd], "<u4")
        above[place] |= unpack(view[at + 4 * odd :], odd, more) << U(width)
    return (above + U(low % 2**64)).view(np.int64)


def byte_kinds(vocabulary: str) -> np.ndarray | None:
    """What each byte is, for a tokenizers file with FOLDS and CUTS; None for others."""
    spec = json.loads(vocabulary)
    if spec["normalizer"] != FOLDS or spec["pre_tokenizer"] != CUTS:
        return None
    out = np.full(256, WHOLE, np.uint8)
    out[33:127] = REST
    out[48:58], out[65:91], out[97:123] = DIGIT, LETTER, LETTER
    out[~RULE.inside] = BLANK
    out[ord("'")] = WHOLE
    for token in spec["added_tokens"]:
        found = np.frombuffer(token["content"].encode(), np.uint8)
        found = found[out[found] >= REST]
        if not (found < 128).any():
            return None
        out[found] = WHOLE
    return out


class Encoder:
    """Ids of texts, the words of which, or the parts that these are cut into, are encoded once."""

    held: tuple[tuple, Encoder] | None = None

    def __init__(self, vocabulary: str, apart: bool, words_held: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.apart, self.most = apart, words_held
        self.kinds = byte_kinds(vocabulary) if apart else None
        found = self.tokenizer.get_vocab()
        suffix = json.loads(vocabulary)["model"].get("end_of_word_suffix")
        #: Ids that end a part, if the tokenizer marks them.
        self.ends = np.zeros(max(found.values(), default=0) + 1, bool)
        self.ends[[i for w, i in found.items() if suffix and w.endswith(suffix)]] = True
        self.clear()

    @classmethod
    def of(cls, vocabulary: str, apart: bool, words_held: int) -> Encoder:
        """The encoder of this process; it outlives its task."""
        key = vocabulary, apart, words_held
        if not cls.held or cls.held[0] != key:
            cls.held = key, cls(*key)
        return cls.held[1]

    def clear(self) -> None:
        self.size, self.ids = 0, np.zeros(0, np.int32)
        self._slots(1024)

    def _slots(self, n: int) -> None:
        """An empty table; a slot has the hash of a word or 0, where its ids begin and how many they are, and whether it was met again."""
        self.hash, self.begin, self.count, self.again = np.zeros(n, U), np.zeros(n, np.int64), np.zeros(n, np.int32), np.zeros(n, bool)

    def _find(self, words: np.ndarray) -> np.ndarray:
        """The slot of each word, or the free one where it belongs."""
        last = len(self.hash) - 1
        at = (words & U(last)).view(np.int64)
        found = self.hash[at]
        open_ = np.flatnonzero((found != words) & (found != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & last
            found = self.hash[at[open_]]
            open_ = open_[(found != words[open_]) & (found != 0)]
        return at

    def _put(self, words: np.ndarray, begin: np.ndarray, count: np.ndarray) -> None:
        """Distinct words that the table does not have, into at most half of its slots."""
        if 2 * (self.size + len(words)) > len(self.hash):
            old = np.flatnonzero(self.hash)
            kept = self.hash[old], self.begin[old], self.count[old]
            again = self.again[old]
            self._slots(1 << (2 * (self.size + len(words)) - 1).bit_length())
            self.size = 0
            self._put(*kept)
            self.again[self._find(kept[0])] = again
        self.size += len(words)
        left = np.arange(len(words))
        while len(left):
            # Of words that meet in a free slot the last one takes it.
            at = self._find(words[left])
            self.hash[at] = words[left]
            won = self.hash[at] == words[left]
            self.begin[at[won]], self.count[at[won]] = begin[left[won]], count[left[won]]
            left = left[~won]

    def _shrink(self) -> None:
        """Keep the words that were met again since the last call, or none if these are more than half of what may be held."""
        old = np.flatnonzero(self.again)
        if len(old) > self.most // 2:
            old = old[:0]
        words, begin, count = self.hash[old], self.begin[old], self.count[old].astype(np.int64)
        ids = self.ids
        self.clear()
        self.ids = _gather(ids, begin, count)
        self._put(words, np.cumsum(count) - count, count)

    def _raw(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after the other, and the number of each."""
        found = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for i in range(0, len(texts), AT_ONCE):
            lists_of = [e.ids for e in self.tokenizer.encode_batch_fast(texts[i : i + AT_ONCE], add_special_tokens=False)]
            found[1].append(np.fromiter(map(len, lists_of), np.int64, len(lists_of)))
            found[0].append(np.fromiter(chain.from_iterable(lists_of), np.int32, int(found[1][-1].sum())))
        return np.concatenate(found[0]), np.concatenate(found[1])

    def _parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts that are one part each: many go as one, and their last ids tell them apart."""
        if not self.ends.any():
            return self._raw(texts)
        ids, count = self._raw([" ".join(texts[i : i + JOINED]) for i in range(0, len(texts), JOINED)])
        end = np.flatnonzero(self.ends[ids])
        # A part has one such id at most, its last one, so none lacks it if they are as many.
        if len(end) != len(texts) or (len(ids) and end[-1] != len(ids) - 1):
            return self._raw(texts)
        return ids, np.diff(end, prepend=-1)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a binary column, row after row, each ended by END, and the number of ids of every row."""
        data, offsets = buffers(column)
        if self.apart:
            begin, end, whole, data = self._cut(data, offsets)
            ids, n = self._words(data, begin, end, whole)
            count = np.diff(np.append(0, np.cumsum(n))[np.searchsorted(begin, offsets)])
        else:
            ids, count = self._raw([data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        return np.insert(ids, np.cumsum(count), END), count + 1

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of every word or part, where words begin that are not cut, and the bytes, folded in words that are."""
        begin, end, _ = RULE.spans(data, offsets)
        if self.kinds is None or not len(begin):
            return begin, end, begin, data
        kind = self.kinds[data]
        # U+00C0 to U+00FF are letters but for two signs.
        lead = np.flatnonzero(data == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = LETTER
        whole = np.zeros(len(begin), bool)
        whole[np.searchsorted(begin, np.flatnonzero(kind == WHOLE), "right") - 1] = True
        folded = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
        folded[lead + 1] += (data[lead + 1] < 0x9F).astype(np.uint8) * np.uint8(32)
        if whole.any():
            turned = np.flatnonzero(folded != data)
            turned = turned[whole[np.searchsorted(begin, turned, "right") - 1]]
            folded[turned] = data[turned]
        cut = np.flatnonzero(((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)) & (kind[1:] != BLANK) & (kind[:-1] != BLANK)) + 1
        word = np.searchsorted(begin, cut, "right") - 1
        cut = cut[~whole[word] & (begin[word] != cut)]
        return np.sort(np.concatenate([begin, cut]), kind="stable"), np.sort(np.concatenate([end, cut]), kind="stable"), begin[whole], folded

    def _words(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and parts in turn, and how many each has. whole: where words begin that are not cut."""
        words = RULE.hashes(data, begin, end)
        words[words == 0] = 1
        at = self._find(words)
        new = np.flatnonzero(self.hash[at] == 0)
        self.again[at] = True
        self.again[at[new]] = False
        fresh, first = np.unique(words[new], return_index=True)
        if self.size + len(fresh) > self.most:
            self._shrink()
            new = np.flatnonzero(self.hash[self._find(words)] == 0)
            fresh, first = np.unique(words[new], return_index=True)
        if len(fresh):
            place = new[first]
            alone = np.isin(begin[place], whole)
            for ways, encode in ((place[alone], self._raw), (place[~alone], self._parts)):
                ids, count = encode([data[a:b].tobytes().decode() for a, b in zip(begin[ways], end[ways], strict=True)])
                self._put(words[ways], len(self.ids) + np.cumsum(count) - count, count)
                self.ids = np.concatenate([self.ids, ids])
            at = self._find(words)
        n = self.count[at].astype(np.int64)
        out = _gather(self.ids, self.begin[at], n)
        if self.size > self.most:
            self.clear()
        return out, n


def _gather(values: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Stretches of ``values``, one after the other."""
    return values[np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())]


class _File:
    """A token file that is being written."""

    def __init__(self, path: str, name: str, block: int):
        fs, folder = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(folder, recursive=True)
        self.out = fs.open_output_stream(f"{folder}/{name}", compression=None)
        self.block = block
        self.out.write(MAGIC)
        self.size, self.starts = len(MAGIC), []
        self.waiting, self.n_waiting, self.ids = [], 0, 0
        self.lengths, self.doc_ids, self.missing = [], [], 0

    def _block(self, values: np.ndarray) -> None:
        data = encode_block(values)
        self.starts.append(self.size)
        self.out.write(data)
        self.size += len(data)

    def add(self, ids: np.ndarray, counts: np.ndarray, doc_ids: pa.Array) -> None:
        self.lengths.append(counts)
        # A copy, for the column would keep its whole batch.
        self.doc_ids.append(np.array(doc_ids.fill_null(0).to_numpy(), np.int64))
        self.missing += doc_ids.null_count
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block:
            ready = np.concatenate(self.waiting)
            whole = len(ready) // self.block * self.block
            for i in range(0, whole, self.block):
                self._block(ready[i : i + self.block])
            self.waiting, self.n_waiting = [ready[whole:].copy()], len(ready) - whole
            self.ids += whole

    def close(self) -> tuple[int, int, int]:
        """Documents, ids and bytes of the file."""
        if self.n_waiting:
            self._block(np.concatenate(self.waiting))
            self.ids += self.n_waiting
        blocks = [len(self.starts)]
        lengths = np.concatenate(self.lengths)
        for values in (lengths, np.concatenate(self.doc_ids)):
            for i in range(0, len(values), self.block):
                self._block(values[i : i + self.block])
            blocks.append(len(self.starts) - sum(blocks))
        # Documents without id come first: their number is all that there is to know of them.
        tail = np.array([*self.starts, self.missing], "<u8").tobytes()
        self.out.write(tail + FOOT.pack(self.block, len(lengths), self.ids, *blocks, self.size, MAGIC))
        self.out.close()
        return len(lengths), self.ids, self.size + len(tail) + FOOT.size


class _Read:
    """A token file that is being read."""

    def __init__(self, path: str, name: str):
        fs, folder = pyarrow.fs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(f"{folder}/{name}")
        size = self.file.size()
        self.size, self.documents, self.ids, self.id_blocks, length_blocks, doc_blocks, index, magic = FOOT.unpack(self.file.read_at(FOOT.size, size - FOOT.size))
        if magic != MAGIC:
            raise ValueError(f"{name} is not a token file")
        starts = np.frombuffer(self.file.read_at(size - FOOT.size - index, index), "<u8")
        self.starts, missing = np.append(starts[:-1], np.uint64(index)).astype(np.int64), int(starts[-1])
        a, b = self.id_blocks, self.id_blocks + length_blocks
        self.lengths = self._stream(a, b)
        self.doc_ids = pa.array(self._stream(b, b + doc_blocks), pa.int64(), mask=np.arange(self.documents) < missing)

    def block(self, k: int) -> np.ndarray:
        return decode_block(self.file.read_at(int(self.starts[k + 1] - self.starts[k]), int(self.starts[k])))

    def _stream(self, a: int, b: int) -> np.ndarray:
        return np.concatenate([self.block(k) for k in range(a, b)] or [np.zeros(0, np.int64)])

    def chunks(self, base: int) -> Iterator[pa.RecordBatch]:
        """Rows of CHUNKS, a batch for each block; a document's chunks follow each other."""
        ends = np.cumsum(self.lengths)
        for k in range(self.id_blocks):
            ids = self.block(k)
            low, high = k * self.size, k * self.size + len(ids)
            # Documents that have ids in this block; every document has one at least.
            a, b = int(np.searchsorted(ends, low, "right")), int(np.searchsorted(ends, high, "left")) + 1
            start, end = (ends - self.lengths)[a:b], ends[a:b]
            cut = np.append(np.maximum(start, low), high) - low
            number = np.maximum(k - start // self.size, 0)
            yield pa.record_batch(
                [self.doc_ids[a:b], pa.array(base + start), pa.array(end - start), pa.array(number.astype(np.int32)), lists(ids.astype(np.int32), cut)],
                ["doc_id", "start", "n_tokens", "chunk_no", "ids"],
            )


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, apart: bool = True, block: int = BLOCK, words_held: int = WORDS_HELD) -> None:
    """Write the texts of ``docs`` (doc_id, text), in order of doc_id, as token files and a manifest under ``path``.

    vocabulary: path of a tokenizers file, read by the driver. apart: it drops blanks and never joins what they part.
    """
    spark = docs.sparkSession
    text_batches(spark)
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    shared = spark.sparkContext.broadcast(Path(vocabulary).read_text())

    def write(batches):
        part, out, encoder = TaskContext.get().partitionId(), None, Encoder.of(shared.value, apart, words_held)
        name = f"part-{part:05d}-{uuid.uuid4().hex}.tokens"
        for batch in pieces(batches, "text", TEXT_BYTES):
            out = out or _File(path, name, block)
            out.add(*encoder.encode(batch.column("text")), batch.column("doc_id"))
        if out:
            yield pa.record_batch([pa.array([x], t) for x, t in zip((part, name, *out.close()), (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["part", "file", "documents", "ids", "bytes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_no"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    # Rows of one id may be many: their numbers let them lie in several ranges.
    ordered = rows.repartitionByRange(F.asc_nulls_first("doc_id"), "row_no").sortWithinPartitions(F.asc_nulls_first("doc_id"), "row_no").select("doc_id", "text")
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")


def files(spark: SparkSession, path: str) -> list[tuple]:
    """part, file, documents, ids, bytes and first id of every file of the set, in order: as many as write tasks had rows."""
    out, base = [], 0
    for r in sorted(spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect(), key=lambda r: r.part):
        out.append((*r, base))
        base += r.ids
    return out


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, chunk_no and ids of the chunks of all documents; those of one follow each other in a task."""
    text_batches(spark)
    named = [(f[0], f[1], f[5]) for f in files(spark, path)]

    def read(batches):
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                yield from _Read(path, name).chunks(base)

    rows = spark.createDataFrame(named, "part int, file string, base long")
    return rows.repartitionByRange(max(1, len(named)), "part").mapInArrow(read, CHUNKS)


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """first (place in the whole sequence) and ids of the blocks' parts that lie in [start, stop); no other block is opened."""
    text_batches(spark)
    named = [(f[0], f[1], f[5]) for f in files(spark, path) if f[5] < stop and start < f[5] + f[3]]

    def read(batches):
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                source = _Read(path, name)
                for k in range(max(0, start - base) // source.size, -(-(min(stop - base, source.ids)) // source.size)):
                    ids, first = source.block(k).astype(np.int32), base + k * source.size
                    a, b = max(0, start - first), min(len(ids), stop - first)
                    yield pa.record_batch([pa.array([first + a], pa.int64()), lists(ids[a:b], np.array([0, b - a]))], ["first", "ids"])

    rows = spark.createDataFrame(named, "part int, file string, base long")
    return rows.repartitionByRange(max(1, len(named)), "part").mapInArrow(read, "first long, ids array<int>")


def digests(chunks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the rows of ``read_chunks``."""

    def check(batches):
        crc = seen = 0
        for batch in batches:
            ids = batch.column("ids")
            flat, at = ids.flatten().to_numpy().astype("<u4"), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])
            length, ended, out = batch.column("n_tokens").to_numpy(), [], []
            for i, number in enumerate(batch.column("chunk_no").to_pylist()):
                if not number:
                    crc = seen = 0
                crc = zlib.crc32(flat[at[i] : at[i + 1]].tobytes(), crc)
                seen += at[i + 1] - at[i]
                if seen == length[i]:
                    ended.append(i)
                    out.append(crc)
            whole = pa.array(ended, pa.int64())
            yield pa.record_batch([*(batch.column(c).take(whole) for c in ("doc_id", "start", "n_tokens")), pa.array(out, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return chunks.mapInArrow(check, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the files that the texts of ``docs`` were written to with the ``parameters`` of ``write_tokens``; the files go."""
    spark = docs.sparkSession
    with scratch(spark):
        path = shared_path(spark, "tokens")
        write_tokens(docs, path, **parameters)
        return materialize(digests(read_chunks(spark, path)), "read", outlive=True)


def digest(docs: DataFrame) -> DataFrame:
    return round_trip(docs.select("doc_id", "text"))
