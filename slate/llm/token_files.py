"""Token ids in binary files of bit-plane shuffled, compressed blocks.

Texts are put in the order of their ids by one range partitioning, encoded in
that order, and each task streams its ids into files:

    magic | block | block | ... | index | length of the index | magic

A block holds a fixed number of ids (the last one may be shorter).  Its ids are
transposed into planes: ``byte`` planes hold the first bytes of all ids, then the
second ones and so on, ``bit`` planes one bit of all ids each.  Planes are
compressed one by one with zstandard, so the high planes of small ids take next
to nothing.  The index (two Arrow tables) has each block's place, the size and
checksum of its planes, and the documents with their number of ids; a reader
seeks to the blocks that it needs.

A file belongs to a corpus only if the corpus' table of files names it.  That
table is written by Spark after all tasks have ended, so files of lost or
repeated attempts are never read.  Folders are reached through ``pyarrow.fs``:
a local or mounted path, or any store it knows.
"""

from __future__ import annotations

import io
import json
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slate.session import planned_bytes

MAGIC = b"SLTOK001"
END_ID = 1
#: Ids in a block, and ids in a file before the next one begins.
BLOCK, FILE_IDS = 1 << 16, 1 << 24
#: Bytes of input (as planned) for a task, and the most tasks.
PART_BYTES, MOST_PARTS = 8 << 20, 20_000
LEVEL = 3
#: Bits of an id in each kind of plane.
PLANES = {"byte": 8, "bit": 1}
#: Runs and words whose ids a task remembers (and as many of the time before), those encoded together,
#: and characters of the texts that are worked on together; a longer text is cut at blanks.
REMEMBERED, TOGETHER, LONG_TEXT = 1 << 19, 1000, 1 << 23
#: Printable characters without combining marks, blanks or letters whose small form hangs on their
#: neighbours or has two characters (the dotted capital I); and what texts of them, blanks and line ends do not have.
LATIN = re.compile("[!-~\u00a1-\u012f\u0131-\u017f]+")
BEYOND_LATIN = "[^ -~\n\u00a1-\u012f\u0131-\u017f]"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of ids (32-bit), lowest first."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k]).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path in it; ``file:`` with one slash or three and bare paths are local."""
    if re.match(r"file:/", path):
        path = "/" + path[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path)


class Remembered:
    """Ids of texts that were encoded before: those of the last ``limit`` and of as many before them."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int):
        self.encode, self.limit = encode, limit
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def of(self, texts: list[str]) -> Callable[[str], bytes]:
        """A function that gives the ids of each of ``texts`` (distinct)."""
        new = [t for t in texts if t not in self.known]
        if len(self.known) + len(new) > self.limit:
            self.older, self.known, new = self.known, {}, texts
        unseen = []
        for t in new:
            if (ids := self.older.get(t)) is not None:
                self.known[t] = ids
            else:
                unseen.append(t)
        for at in range(0, len(unseen), TOGETHER):
            part = unseen[at : at + TOGETHER]
            self.known.update(zip(part, self.encode(part), strict=True))
        return self.known.__getitem__


class Encoder:
    """Texts to ids (4 bytes each) by a public tokenizer whose words never span a blank or a line end.

    Its words are found within runs without white space and its normal form
    does not reach over them, so the ids of a text are those of its runs.  Where
    the vocabulary has a pattern for words and marks their ends, Latin runs are cut
    into words in the same way (small letters and the pattern are all that matters
    there).  Texts are worked on in groups: only the distinct runs of a group are
    looked up, and only words that are not remembered are encoded, together.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.runs, self.words = Remembered(self._encoded_runs, REMEMBERED), Remembered(self._encoded_words, REMEMBERED)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "$^a")
        rules = json.loads(self.tokenizer.to_str())
        self.pattern = self._word_pattern(rules)
        suffix = rules["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if suffix and t.endswith(suffix)]] = True

    @staticmethod
    def _word_pattern(rules: dict) -> regex.Pattern | None:
        """Pattern of the words, if the vocabulary takes small letters and all matches of one pattern, and ends words visibly."""
        normal = [n.get("type") for n in (rules.get("normalizer") or {}).get("normalizers", [])]
        steps = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if normal != ["NFC", "Replace", "Lowercase"] or [s.get("type") for s in steps] != ["Split", "ByteLevel"]:
            return None
        split, to_bytes = steps
        plain = split["behavior"] == "Removed" and split["invert"] and not to_bytes["add_prefix_space"] and not to_bytes["use_regex"]
        return regex.compile(split["pattern"]["Regex"]) if plain and rules["model"].get("end_of_word_suffix") else None

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded_words(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(cuts) != len(words):
            return self._whole(words)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]

    def _encoded_runs(self, runs: list[str]) -> list[bytes]:
        if self.pattern is None or self.special.search("\n".join(runs)):
            return self._whole(runs)
        words = [None if not LATIN.fullmatch(r) else [r] if r.isalpha() and r.islower() else self.pattern.findall(r.lower()) for r in runs]
        ids = self.words.of(list({w for found in words if found for w in found}))
        others = iter(self._whole([r for r, found in zip(runs, words, strict=True) if found is None]))
        return [next(others) if found is None else b"".join(map(ids, found)) for found in words]

    def _runs(self, texts: pa.Array) -> pa.ListArray:
        """The runs of each text, in small letters where these are all that matters; some are empty."""
        if self.pattern is not None:
            beyond = pc.or_(pc.match_substring_regex(texts, BEYOND_LATIN), pc.match_substring_regex(texts, f"(?i){self.special.pattern}"))
            texts = pc.if_else(beyond, texts, pc.utf8_lower(texts))
        return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")

    def _group(self, texts: list[str]) -> list[bytes]:
        runs = self._runs(pa.array(texts, pa.string()))
        words = runs.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        of = self.runs.of(distinct)
        ids = [of(r) for r in distinct]
        ends = np.cumsum([len(x) // 4 for x in ids], dtype=np.int32)
        lists = pa.ListArray.from_arrays(np.concatenate([np.zeros(1, np.int32), ends]), np.frombuffer(b"".join(ids), "<u4"))
        found = lists.take(words.indices)
        at = 4 * found.offsets.to_numpy()[runs.offsets.to_numpy()].astype(np.int64)
        raw = found.flatten().to_numpy(zero_copy_only=False).tobytes()
        return [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    @staticmethod
    def _pieces(text: str) -> Iterator[str]:
        """A very long text piece by piece, each up to a blank."""
        at = 0
        while len(text) - at > LONG_TEXT:
            cut = text.find(" ", at + LONG_TEXT)
            if cut < 0:
                break
            yield text[at:cut]
            at = cut
        yield text[at:]

    def __call__(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text; so many texts as make up a piece are held at a time."""
        group, held = [], 0
        for text in texts:
            text = text or ""
            if len(text) > LONG_TEXT:
                yield from self._group(group)
                group, held = [], 0
                yield b"".join(ids for piece in self._pieces(text) for ids in self._group([piece]))
                continue
            group.append(text)
            held += len(text)
            if held > LONG_TEXT:
                yield from self._group(group)
                group, held = [], 0
        yield from self._group(group)


@dataclass
class FileWriter:
    """One file: ids are added document by document, full blocks go out as they come."""

    out: io.RawIOBase
    kind: str = "byte"
    block: int = BLOCK
    doc_ids: list = field(default_factory=list)
    counts: list[int] = field(default_factory=list)
    n_ids: int = 0
    blocks: list[dict] = field(default_factory=list)

    def __post_init__(self):
        self.pending = bytearray()
        self.at = self.out.write(MAGIC)
        self.compressor = zstandard.ZstdCompressor(LEVEL)

    def add(self, doc_id, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.n_ids += len(ids) // 4
        self.pending += ids
        size = 4 * self.block
        full = len(self.pending) // size * size
        for k in range(0, full, size):
            self._put(bytes(self.pending[k : k + size]))
        if full:
            del self.pending[:full]

    def _put(self, raw: bytes) -> None:
        planes = [self.compressor.compress(p) for p in to_planes(np.frombuffer(raw, "<u4"), self.kind)]
        self.blocks.append({"at": self.at, "n": len(raw) // 4, "crc32": zlib.crc32(raw), "planes": list(map(len, planes))})
        self.at += self.out.write(b"".join(planes))

    def close(self, id_type: pa.DataType) -> int:
        """Last block and index; returns the size of the file."""
        if self.pending:
            self._put(bytes(self.pending))
        index = io.BytesIO()
        blocks = pa.Table.from_pylist(self.blocks, pa.schema([("at", pa.int64()), ("n", pa.int64()), ("crc32", pa.uint32()), ("planes", pa.list_(pa.int32()))]))
        blocks = blocks.replace_schema_metadata({"kind": self.kind, "block": str(self.block)})
        docs = pa.table({"doc_id": pa.array(self.doc_ids, id_type), "n_tokens": pa.array(self.counts, pa.int64())})
        for table in (blocks, docs):
            with pa.ipc.new_stream(index, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(table)
        tail = index.getvalue()
        self.at += self.out.write(tail + len(tail).to_bytes(8, "little") + MAGIC)
        self.out.close()
        return self.at


class TokenFile:
    """Reader of one file: its documents, and ids of any range by way of the chunk index."""

    def __init__(self, path: str):
        fs, place = opened(path)
        self.file = fs.open_input_file(place)
        size = self.file.size()
        end = self.file.read_at(16, size - 16)
        if end[8:] != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{path} is no token file")
        length = int.from_bytes(end[:8], "little")
        index = io.BytesIO(self.file.read_at(length, size - 16 - length))
        blocks, self.docs = (pa.ipc.open_stream(index).read_all() for _ in range(2))
        self.kind, self.block = blocks.schema.metadata[b"kind"].decode(), int(blocks.schema.metadata[b"block"])
        self.blocks = blocks.to_pylist()
        self.n_ids = sum(b["n"] for b in self.blocks)

    def ids_of_block(self, k: int) -> np.ndarray:
        b = self.blocks[k]
        raw, planes, at = self.file.read_at(sum(b["planes"]), b["at"]), [], 0
        for size in b["planes"]:
            planes.append(zstandard.decompress(raw[at : at + size]))
            at += size
        ids = from_planes(planes, b["n"], self.kind)
        if zlib.crc32(ids) != b["crc32"]:
            raise ValueError(f"block {k} is damaged")
        return ids

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` (exclusive) of the file; only their blocks are read."""
        start, stop = max(0, start), min(stop, self.n_ids)
        if start >= stop:
            return np.empty(0, "<u4")
        first = start // self.block
        found = np.concatenate([self.ids_of_block(k) for k in range(first, (stop - 1) // self.block + 1)])
        return found[start - first * self.block : stop - first * self.block]

    def documents(self) -> Iterator[tuple[object, int, int]]:
        """(doc_id, number of ids, crc32 of the ids) of each document, block by block."""
        k, ids, at = 0, np.empty(0, "<u4"), 0
        for doc_id, n in zip(self.docs.column("doc_id").to_pylist(), self.docs.column("n_tokens").to_pylist(), strict=True):
            crc, left = 0, n
            while left:
                if at == len(ids):
                    ids, at, k = self.ids_of_block(k), 0, k + 1
                part = ids[at : at + left]
                crc, at, left = zlib.crc32(part, crc), at + len(part), left - len(part)
            yield doc_id, n, crc


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, kind: str = "byte",
                 block: int = BLOCK, file_ids: int = FILE_IDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into token files under the new folder ``path``; returns the table of files.

    Every text is encoded whole and ends with ``end_id``; a null or empty text has
    that id only.  Documents follow each other in ascending order of their ids
    (null first); rows with equal ids are ordered by a hash of the text, and rows
    that agree in both lie together.  An empty table gives a corpus without files.
    ``docs`` should be read from a table, so that a repeated task sees its rows
    in the same order.  Other columns of ``docs`` are not read.

    The table of files (``path/files``): file, start (ids before it), n_docs, n_ids, bytes.
    """
    if kind not in PLANES:
        raise ValueError(f"kind must be one of {sorted(PLANES)}")
    vocabulary = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    parts = max(1, min(MOST_PARTS, round(planned_bytes(rows) / part_bytes)))
    # the row's number spreads copies that agree in id and text over the ranges
    rows = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(parts, F.asc_nulls_first("doc_id"), "tie", "row").sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie", "row")
    ending = np.array([end_id], "<u4").tobytes()

    def written(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, n, writer, place, id_type = Encoder(vocabulary), TaskContext.get().partitionId(), 0, None, "", pa.null()
        fs, folder = opened(f"{path}/data")

        def done() -> pa.RecordBatch:
            size = writer.close(id_type)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "number": pa.array([n], pa.int32()), "file": [place],
                                               "n_docs": [len(writer.counts)], "n_ids": [writer.n_ids], "bytes": [size]})

        for batch in batches:
            id_type = batch.column("doc_id").type
            texts = (t.as_py() for t in batch.column("text"))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(texts), strict=True):
                if writer is None:
                    place = f"{part:06d}-{n:04d}-{uuid.uuid4().hex}.tok"
                    fs.create_dir(folder, recursive=True)
                    writer = FileWriter(fs.open_output_stream(f"{folder}/{place}"), kind, block)
                writer.add(doc_id, ids + ending)
                if writer.n_ids >= file_ids:
                    yield done()
                    writer, n = None, n + 1
        if writer is not None:
            yield done()

    files = rows.select("doc_id", "text").mapInArrow(written, "part int, number int, file string, n_docs long, n_ids long, bytes long")
    files.write.parquet(f"{path}/written")
    files = spark.read.schema(files.schema).parquet(f"{path}/written")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # a row per file, not per document
    files.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"), "n_docs", "n_ids", "bytes").write.parquet(f"{path}/files")
    return token_files(spark, path)


def token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("file string, start long, n_docs long, n_ids long, bytes long").parquet(f"{path}/files")


def read_documents(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files of ``path``.

    ``start`` counts the ids of all documents before it, ``n_tokens`` its own with the end id.
    """
    files = token_files(spark, path)
    # a file is a task's work; its blocks are decoded one at a time
    files = files.repartition(max(1, min(MOST_PARTS, files.count()))).select("file", "start")

    def decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                found = TokenFile(f"{path}/data/{name}")
                counts = np.array(found.docs.column("n_tokens"))
                starts = start + np.cumsum(counts) - counts
                crcs = np.fromiter((crc for _, _, crc in found.documents()), np.int64, len(counts))
                table = pa.table({"doc_id": found.docs.column("doc_id"), "start": starts, "n_tokens": counts, "ids_crc32": crcs})
                yield from table.combine_chunks().to_batches(max_chunksize=65_536)

    return files.mapInArrow(decoded, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write ``docs`` as token files and give what the files hold."""
    write_tokens(docs, path, **options)
    return read_documents(docs.sparkSession, path, docs.schema["doc_id"].dataType.simpleString())
