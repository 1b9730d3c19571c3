"""Token ids in binary files with one shared zstandard dictionary.

A dictionary is trained on the serialized id arrays of some short documents. Every document is then one
compressed frame of its own, so that a short document is read without its neighbours, and still profits
from what all documents have in common. A folder holds:

* ``manifest.json``: id width, end id, hash of the dictionary, and the shards in key order;
* ``dictionary.zstd``;
* ``shard-*.tok``: a mark, the hash of the dictionary it needs, and the frames one after the other;
* ``shard-*.idx``: an Arrow stream with key, offset, size and number of ids for each frame.

Shards are written by the tasks of one range-partitioned sort. A shard's name is new in each attempt and
the manifest, written last, names those of the attempts that counted; so files of lost tasks are never read.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.llm.batches import short_batches
from assayloom.llm.bpe import Bpe, byte_letters

MARK = b"IDFRAME1"
MANIFEST, DICTIONARY = "manifest.json", "dictionary.zstd"
#: Id appended to each document.
END_ID = 1
#: Words of lower-case ASCII as the tokenizer's pattern cuts them.
ASCII_WORD = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9\s]+")
#: Chunks and words remembered in a worker before the memory starts anew.
KNOWN_PIECES = 1_000_000
#: Documents the dictionary is trained on, the longest text among them, and the size of the dictionary.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 1000, 8192, 1 << 15
LEVEL = 3


class _Memo(dict):
    """Values made when they are first asked for."""

    def __init__(self, make: Callable[[bytes], bytes]) -> None:
        self.make = make

    def __missing__(self, key: bytes) -> bytes:
        value = self[key] = self.make(key)
        return value


class Encoder:
    """Encodes texts piece by piece with the tokenizers library, each distinct piece once.

    No token crosses ASCII white space, so a text is its chunks between them; chunks are cut into words as the
    tokenizer cuts them, and the library's BPE model encodes the words not met before.
    """

    def __init__(self, definition: str, width: int) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(definition).model
        self.width = width
        added = {t["content"]: t["id"] for t in json.loads(definition)["added_tokens"]}
        self.special = {k.encode(): pack([v], width) for k, v in added.items()}
        self.splitter = re.compile(b"(" + b"|".join(map(re.escape, self.special)) + b")") if added else None
        self.letters = dict(enumerate(byte_letters()))
        self.chunks, self.words = _Memo(self._chunk), _Memo(self._word)

    def _word(self, word: bytes) -> bytes:
        lettered = word.decode("latin-1")
        if not word.isalnum():  # letters and digits of ASCII stand for themselves
            lettered = lettered.translate(self.letters)
        return pack([t.id for t in self.model.tokenize(lettered)], self.width)

    def _chunk(self, chunk: bytes) -> bytes:
        if chunk.isalpha():
            return self.words[chunk.lower()]
        if chunk.isascii():
            words = ASCII_WORD.findall(chunk.lower())
        else:
            words = [w.encode("utf-8", "surrogatepass") for w in Bpe._words(chunk.decode("utf-8", "surrogatepass"))]
        return b"".join(map(self.words.__getitem__, words))

    def encode(self, text: str | None) -> bytes:
        if len(self.chunks) + len(self.words) > KNOWN_PIECES:
            self.chunks.clear()
            self.words.clear()
        content = (text or "").encode("utf-8", "surrogatepass")
        if not any(s in content for s in self.special):
            return b"".join(map(self.chunks.__getitem__, content.split()))
        out = []
        for part in self.splitter.split(content):
            out += [self.special[part]] if part in self.special else map(self.chunks.__getitem__, part.split())
        return b"".join(out)


def pack(ids: Sequence[int], width: int) -> bytes:
    """Ids as little-endian unsigned numbers of two or four bytes."""
    return struct.pack(f"<{len(ids)}{'H' if width == 2 else 'I'}", *ids)


def train_dictionary(samples: Sequence[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary of the samples; few or alike samples cannot be trained on and are the dictionary themselves."""
    try:
        return zstandard.train_dictionary(size, list(samples)).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:] or bytes(8)


def as_dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(content)


def store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the path in it."""
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def _read_file(folder: str, name: str) -> bytes:
    system, path = store(folder)
    with system.open_input_stream(f"{path}/{name}") as file:
        return file.read()


def _write_file(folder: str, name: str, content: bytes) -> None:
    system, path = store(folder)
    with system.open_output_stream(f"{path}/{name}") as file:
        file.write(content)


def _key_text(value) -> str:
    return json.dumps(value if isinstance(value, (int, str, type(None))) else str(value))


def _shard_writer(folder: str, content: bytes, width: int, end_id: int | None, key_type: pa.DataType, make: Callable[[], Encoder]):
    """A task that writes its sorted rows (key, text) as one shard and returns one row about it."""
    end = b"" if end_id is None else pack([end_id], width)
    shape = pa.schema([("key", key_type), ("offset", pa.int64()), ("size", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = index = None
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if data is None:
                    system, path = store(folder)
                    part = TaskContext.get().partitionId()
                    stem = f"shard-{part:06d}-{uuid.uuid4().hex}"
                    data = system.open_output_stream(f"{path}/{stem}.tok")
                    beside = system.open_output_stream(f"{path}/{stem}.idx")
                    index = pa.ipc.new_stream(beside, shape)
                    data.write(MARK + hashlib.sha256(content).digest())
                    at, tokens, rows, first = len(MARK) + 32, 0, 0, batch.column(0)[0].as_py()
                    encoder, packer = make(), zstandard.ZstdCompressor(level=LEVEL, dict_data=as_dictionary(content))
                frames, sizes, counts = [], [], []
                for text in batch.column(1).to_pylist():
                    ids = encoder.encode(text) + end
                    frames.append(packer.compress(ids))
                    sizes.append(len(frames[-1]))
                    counts.append(len(ids) // width)
                data.write(b"".join(frames))
                offsets = at + np.cumsum([0, *sizes[:-1]])
                keys = batch.column(0).cast(key_type)
                index.write_batch(pa.RecordBatch.from_arrays([keys, pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], schema=shape))
                at, tokens, rows, last = at + sum(sizes), tokens + sum(counts), rows + len(sizes), batch.column(0)[batch.num_rows - 1].as_py()
        finally:
            if data is not None:
                if index is not None:
                    index.close()
                    beside.close()
                data.close()
        if data is not None:
            made = {"part": part, "stem": stem, "documents": rows, "tokens": tokens, "bytes": at, "first_key": _key_text(first), "last_key": _key_text(last)}
            yield pa.RecordBatch.from_pylist([made], schema=_SHARD)

    return run


_SHARD = pa.schema([("part", pa.int64()), ("stem", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64()), ("first_key", pa.string()), ("last_key", pa.string())])
_SHARD_DDL = "part bigint, stem string, documents bigint, tokens bigint, bytes bigint, first_key string, last_key string"


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int | None = END_ID, sample_docs: int = SAMPLE_DOCS) -> dict:
    """Encode whole texts and write them to ``folder``, a new folder on storage all executors share, in ascending key order.

    Returns the manifest, which holds one entry per shard. A null text counts as empty and holds the end id only.
    Null keys come first; rows with one key come by the hash of their text, and equal rows, which may fill several
    shards, are all written. An empty table makes a manifest without shards. Keys are integers or strings.

    The dictionary learns from at most ``sample_docs`` texts of at most ``SAMPLE_CHARS`` characters, those with the
    smallest hash; it sets how small the files are, never what is in them. Tokenizer and dictionary are sent to
    the tasks: their sizes are fixed.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = file.read()
    model = json.loads(definition)
    top = max([*model["model"]["vocab"].values(), *[t["id"] for t in model["added_tokens"]], end_id or 0])
    width = 2 if top < 1 << 16 else 4
    shared = spark.sparkContext.broadcast({"definition": definition})

    def make() -> Encoder:
        # A worker that runs several tasks keeps the value, and with it the pieces that it has met.
        held = shared.value
        if "encoder" not in held:
            held["encoder"] = Encoder(held["definition"], width)
        return held["encoder"]

    rows = short_batches(docs).select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").cast("string").alias("__text"))
    if rows.schema["__key"].dataType.typeName() not in ("byte", "short", "integer", "long", "string"):
        raise ValueError("keys must be integers or strings")
    # Twice the sample is expected below this hash, so what tasks send to the driver does not grow with their number.
    share = min(1.0, 2 * sample_docs / max(1, docs.count()))
    draw = F.xxhash64("__text", "__key")
    short = rows.filter(F.length("__text").between(1, SAMPLE_CHARS)).select("__text", draw.alias("__hash")).filter(F.col("__hash") <= int(2.0**63 * (2 * share - 1)) - (share == 1)).orderBy("__hash", "__text").limit(sample_docs)
    encoder = Encoder(definition, width)
    content = train_dictionary([encoder.encode(r["__text"]) for r in short.collect()])

    system, path = store(folder)
    system.create_dir(path, recursive=True)
    _write_file(folder, DICTIONARY, content)
    key_type = pa.string() if rows.schema["__key"].dataType.typeName() == "string" else pa.int64()
    run = _shard_writer(folder, content, width, end_id, key_type, make)
    order = [F.col("__key").asc_nulls_first(), F.col("__hash")]
    # The row number splits a key or text that fills much of the table; it is no part of the result.
    dealt = rows.select("__key", "__text", F.xxhash64("__text").alias("__hash"), F.monotonically_increasing_id().alias("__row")).repartitionByRange(*order, "__row")
    shards = dealt.sortWithinPartitions(*order, "__row").select("__key", "__text").mapInArrow(run, _SHARD_DDL).collect()
    shards = sorted((r.asDict() for r in shards), key=lambda r: r["part"])
    before = 0
    for shard in shards:
        shard["start"], before = before, before + shard["tokens"]
    manifest = {"id_bytes": width, "end_id": end_id, "dictionary_sha256": hashlib.sha256(content).hexdigest(), "key": str(key_type), "tokens": before, "shards": shards}
    _write_file(folder, MANIFEST, json.dumps(manifest).encode())
    return manifest


def read_manifest(folder: str) -> dict:
    return json.loads(_read_file(folder, MANIFEST))


def _checked_dictionary(folder: str, manifest: dict) -> bytes:
    content = _read_file(folder, DICTIONARY)
    if hashlib.sha256(content).hexdigest() != manifest["dictionary_sha256"]:
        raise ValueError("the dictionary is not the one the files were written with")
    return content


def _check_head(head: bytes, content: bytes) -> None:
    if head != MARK + hashlib.sha256(content).digest():
        raise ValueError("the shard needs another dictionary or is no shard")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``key``, ``start`` (ids of all documents before), ``n_tokens`` and ``token_ids`` (little-endian unsigned 32-bit) of each document."""
    manifest = read_manifest(folder)
    content, width = _checked_dictionary(folder, manifest), manifest["id_bytes"]
    key_ddl, key_type = ("string", pa.string()) if manifest["key"] == "string" else ("bigint", pa.int64())
    shape = pa.schema([("key", key_type), ("start", pa.int64()), ("n_tokens", pa.int64()), ("token_ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor(dict_data=as_dictionary(content))
        system, path = store(folder)
        for batch in batches:
            for stem, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_input_stream(f"{path}/{stem}.idx") as beside, system.open_input_stream(f"{path}/{stem}.tok") as data:
                    _check_head(data.read(len(MARK) + 32), content)
                    for part in pa.ipc.open_stream(beside):
                        ids = [unpacker.decompress(data.read(size)) for size in part.column(2).to_pylist()]
                        if width != 4:
                            ids = [np.frombuffer(x, dtype=f"<u{width}").astype("<u4").tobytes() for x in ids]
                        counts = part.column(3).to_numpy()
                        if [len(x) // 4 for x in ids] != counts.tolist():
                            raise ValueError(f"{stem}: index and frames differ")
                        starts = start + np.cumsum(counts) - counts
                        start += int(counts.sum())
                        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(starts, pa.int64()), part.column(3), pa.array(ids, pa.binary())], schema=shape)

    named = spark.createDataFrame([(s["stem"], s["start"]) for s in manifest["shards"]], "stem string, start bigint")
    return named.repartition(max(1, len(manifest["shards"]))).mapInArrow(run, f"key {key_ddl}, start bigint, n_tokens bigint, token_ids binary")


def read_document(folder: str, key: int | str | None) -> list[np.ndarray]:
    """The ids of the documents with this key, by the index: only their frames are read from the data files."""
    manifest = read_manifest(folder)
    content = _checked_dictionary(folder, manifest)
    unpacker = zstandard.ZstdDecompressor(dict_data=as_dictionary(content))
    system, path = store(folder)

    def place(value) -> tuple:
        # Strings stand in the order of their UTF-8 bytes.
        return (value is not None, value.encode("utf-8", "surrogatepass") if isinstance(value, str) else value or 0)

    found = []
    for shard in manifest["shards"]:
        if place(json.loads(shard["first_key"])) <= place(key) <= place(json.loads(shard["last_key"])):
            with system.open_input_stream(f"{path}/{shard['stem']}.idx") as beside, system.open_input_file(f"{path}/{shard['stem']}.tok") as data:
                _check_head(data.read(len(MARK) + 32), content)
                for part in pa.ipc.open_stream(beside):
                    for row in (i for i, k in enumerate(part.column(0).to_pylist()) if k == key):
                        data.seek(part.column(1)[row].as_py())
                        found.append(np.frombuffer(unpacker.decompress(data.read(part.column(2)[row].as_py())), dtype=f"<u{manifest['id_bytes']}").astype("<u4"))
    return found


def crc_of(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
