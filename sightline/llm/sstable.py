"""Token-ID output as sorted-string-table shards.

Documents are range-partitioned and sorted by identifier; each task encodes its
documents and streams them into one immutable shard:

    data blocks   entries (shared key length, rest length, value length: varints; key
                  rest; value) - keys are prefix-compressed within a block
    block index   one entry a block: first key, offset, length, entries, tokens
    Bloom filter  over the keys
    footer        fixed size, locates the three sections, ends with the magic

A key is the identifier as eight big-endian bytes with the sign bit flipped (so bytes
sort as numbers); a null identifier has the empty key and sorts first. Repeated keys
are kept, side by side, in the order of their texts' hashes. A value is the token ids,
little-endian, two bytes each while the vocabulary fits, else four.

Nulls and empty texts give the end token alone. A lost task is simply run again: it
writes under a new name and only the manifest row of the attempt that Spark accepted
names a file, so half-written shards are never read. An empty table gives no shards.
Very long texts are encoded one at a time; columns beside doc_id and text play no part.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import uuid
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, materialize, mix64, open_fs, scratch, small_batches

MAGIC = b"SSTTOK01"
FOOTER = struct.Struct("<QQQQQQIIB7x8s")  # index off/len, bloom off/len, docs, tokens, blocks, bloom hashes, id width, magic
MANIFEST = "shard int, path string, n_docs long, n_tokens long, n_blocks long, n_bytes long"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


# ---------------------------------------------------------------- encoding

#: Classes of bytes: white space, letters, digits, marks, and all that only the library may judge.
BLANK, LETTER, DIGIT, MARK, ODD = range(5)
_CLASS = np.full(256, ODD, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = BLANK
_CLASS[0x21:0x7F] = MARK
_CLASS[[0x27, 0x3C]] = ODD  # an apostrophe may begin an ending, an angle bracket a special token
_CLASS[0x30:0x3A] = DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _CLASS[0xC3] = _CLASS[0x80:0xC0] = LETTER  # 0xC3 leads U+00C0 to U+00FF
_LOW = np.arange(256, dtype=np.uint8)
_LOW[0x41:0x5B] += 32
#: The normalizer and the splits for which units can be cut on byte arrays.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITS = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
#: Bytes of text that are encoded together.
CHUNK = 4 << 20
#: Distinct units that the library gets in one call.
WORDS = 1 << 12


class WordEncoder:
    """Whole texts through the tokenizers library, each distinct unit of a chunk once.

    The vocabulary splits texts into runs of letters, single digits and runs of marks,
    drops white space, and never joins across these. Such units are cut, lower-cased and
    made distinct on whole byte arrays, and the library gets the distinct ones in one call;
    each unit's ids end with its only token that ends a word. Words with anything but
    ASCII and the letters U+00C0 to U+00FF go to the library as they are. Nothing is kept
    from chunk to chunk, so memory is bounded by CHUNK and the longest text. A tokenizer
    file with another normalizer, other splits or no word ends gets whole texts instead.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            plain = json.load(f)
        splits = (plain["pre_tokenizer"] or {}).get("pretokenizers") or [None]
        self.cuts = plain["normalizer"] == NORMALIZER and splits[0] == SPLITS and plain["model"].get("end_of_word_suffix") == "</w>" and plain["post_processor"] is None
        # the same model, held once, for units that are normal already
        self.units = Tokenizer(self.lib.model)
        self.units.add_tokens([t for _, t in sorted(self.lib.get_added_tokens_decoder().items())])
        self.units.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)])
        self.ends = np.zeros(self.lib.get_vocab_size(), bool)
        for token, i in self.lib.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_all(pa.array([text], pa.string())))

    def encode_all(self, texts: pa.StringArray, end_id: int | None = None):
        """Ids of each text in turn, ``end_id`` behind them."""
        texts = texts if texts.offset == 0 else pa.concat_arrays([texts])
        for a, b in chunks(np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1] if len(texts) else np.zeros(1, np.int32)):
            ids, bounds = self._chunk(pa.concat_arrays([texts.slice(a, b - a)]), end_id)
            for k in range(b - a):
                yield ids[bounds[k] : bounds[k + 1]]

    def _chunk(self, texts: pa.StringArray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, and where each text's begin."""
        n = len(texts)
        if not self.cuts:
            parts = self._each([t or "" for t in texts.to_pylist()])
            parts = parts if end_id is None else [np.append(p, np.uint32(end_id)) for p in parts]
            return np.concatenate([np.empty(0, np.uint32), *parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[: n + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: offsets[-1]]
        codes, starts, names, odd = cut_units(raw, offsets)
        ids, at = self._distinct(names, odd)
        bounds = np.searchsorted(starts, offsets).astype(np.int64)
        if end_id is not None:  # one more unit, at the end of every text
            ids, at = np.append(ids, np.uint32(end_id)), np.append(at, at[-1] + 1)
            codes = np.insert(codes, bounds[1:], len(names))
            bounds = bounds + np.arange(n + 1)
        size = np.diff(at)[codes]
        to = np.concatenate([[0], np.cumsum(size)])
        return ids[np.repeat(at[codes] - to[:-1], size) + np.arange(to[-1])], to[bounds]

    def _distinct(self, names: list[str], odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units, and where each unit's begin."""
        plain = np.flatnonzero(~odd)
        parts = [np.empty(0, np.uint32)] * len(names) if odd.any() else None
        some = [names[i] for i in plain.tolist()] if odd.any() else names
        # the library's account of a text takes some hundred bytes a token: WORDS at a time
        told = (self.units.encode_batch_fast([" ".join(some[a : a + WORDS])], add_special_tokens=False)[0].ids for a in range(0, len(some), WORDS))
        ids = np.concatenate([np.empty(0, np.uint32), *(np.asarray(x, np.uint32) for x in told)])
        at = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
        if len(at) != len(plain) + 1 or at[-1] != len(ids):  # not a vocabulary with word ends
            parts = self._each(names)
        elif not odd.any():
            return ids, at
        else:
            for i, part in zip(plain.tolist(), np.split(ids, at[1:-1]), strict=False):
                parts[i] = part
            left = np.flatnonzero(odd).tolist()
            for i, part in zip(left, self._each([names[i] for i in left]), strict=True):
                parts[i] = part
        return np.concatenate([np.empty(0, np.uint32), *parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def _each(self, words: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.lib.encode_batch_fast(words, add_special_tokens=False)]


@functools.lru_cache(1)
def encoder(path: str) -> WordEncoder:
    """The process's encoder for a tokenizer file."""
    return WordEncoder(path)


def chunks(offsets: np.ndarray):
    """(first, end) of runs of texts of CHUNK bytes at most, or of one text."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, int(offsets[a]) + CHUNK, side="right")) - 1)
        yield a, b
        a = b


def cut_units(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Units of texts laid end to end: the number of each, where it begins, the distinct ones, and which of these are whole odd words."""
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int64), [], np.empty(0, bool)
    kind, low = _CLASS[raw], _LOW[raw]
    lead = np.flatnonzero(raw == 0xC3)
    second = raw[lead + 1]
    kind[lead[(second == 0x97) | (second == 0xB7)]] = ODD  # the signs of multiplication and division
    upper = lead[(second <= 0x9E) & (second != 0x97)] + 1
    low[upper] += 32
    fresh = np.zeros(len(raw) + 1, bool)
    fresh[offsets] = True
    fresh = fresh[:-1]
    if (kind == ODD).any():
        full = kind != BLANK
        begin = np.flatnonzero(full & (fresh | np.concatenate([[True], ~full[:-1]])))
        strange = np.logical_or.reduceat(kind == ODD, begin)
        size = np.diff(np.append(begin, len(raw)))
        whole = np.zeros(len(raw), bool)
        whole[begin[0] :] = np.repeat(strange, size)
        whole &= full
        kind[whole], low[whole] = ODD, raw[whole]
    first = kind != BLANK
    first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT) | fresh[1:]
    starts = np.flatnonzero(first)
    used = kind != BLANK
    lengths = np.cumsum(used, dtype=np.int32)
    ends = np.append((lengths[starts] - 1)[0:], lengths[-1]).astype(np.int32)
    units = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(low[used]))
    told = units.dictionary_encode()
    codes = told.indices.to_numpy()
    odd = np.zeros(len(told.dictionary), bool)
    odd[codes[kind[starts] == ODD]] = True
    return codes, starts, told.dictionary.to_pylist(), odd


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _take_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_slots(keys: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    a, b = mix64(keys), mix64(keys ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (a[:, None] + b[:, None] * np.arange(hashes, dtype=np.uint64)) % np.uint64(bits)


def _bloom_key(key: bytes) -> int:
    return int.from_bytes(key, "big") if key else 0x0123456789ABCDEF


class ShardWriter:
    """Streams sorted (key, ids) into one file; holds a block and the keys' hashes."""

    def __init__(self, uri: str, vocab: int, block_bytes: int = 1 << 16, bits_per_key: int = 10, hashes: int = 7):
        self.fs, self.path = open_fs(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out, self.uri = self.fs.open_output_stream(self.path), uri
        self.width = 2 if vocab <= 1 << 16 else 4
        self.block_bytes, self.bits_per_key, self.hashes = block_bytes, bits_per_key, hashes
        self.at = self.docs = self.tokens = 0
        self.index: list[bytes] = []
        self.keys: list[int] = []
        self._open()

    def _open(self) -> None:
        self.block, self.size, self.last, self.first, self.held, self.held_tokens = [], 0, b"", None, 0, 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.first is None:
            self.first = key
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        value = ids.astype(f"<u{self.width}").tobytes()
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.block += [entry, value]
        self.size += len(entry) + len(value)
        self.last, self.held, self.held_tokens = key, self.held + 1, self.held_tokens + len(ids)
        self.keys.append(_bloom_key(key))
        if self.size >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            data = b"".join(self.block)
            self.out.write(data)
            self.out.write(struct.pack("<I", zlib.crc32(data)))
            self.index.append(struct.pack("<B8sQIII", len(self.first), self.first, self.at, len(data) + 4, self.held, self.held_tokens))
            self.at, self.docs, self.tokens = self.at + len(data) + 4, self.docs + self.held, self.tokens + self.held_tokens
            self._open()

    def close(self) -> dict:
        self._flush()
        index, bits = b"".join(self.index), max(64, self.bits_per_key * len(self.keys))
        bloom = np.zeros((bits + 7) // 8 * 8, np.uint8)
        if self.keys:
            bloom[_bloom_slots(np.array(self.keys, np.uint64), bits, self.hashes).ravel()] = 1
        packed = struct.pack("<Q", bits) + np.packbits(bloom).tobytes()
        self.out.write(index + packed)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), self.docs, self.tokens, len(self.index), self.hashes, self.width, MAGIC))
        self.out.close()
        return {"path": self.uri, "n_docs": self.docs, "n_tokens": self.tokens, "n_blocks": len(self.index), "n_bytes": self.at + len(index) + len(packed) + FOOTER.size}


class Shard:
    """Reads one shard: a scan in key order, or point lookups by Bloom filter and binary search."""

    INDEX = struct.Struct("<B8sQIII")

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        foot = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if foot[-1] != MAGIC:
            raise ValueError(f"{uri} isn't a token shard")
        at, n, self.bloom_at, self.bloom_n, self.docs, self.tokens, _, self.hashes, self.width = foot[:9]
        raw = self.file.read_at(n, at)
        self.blocks = [(k[:used], off, length, held, toks) for used, k, off, length, held, toks in self.INDEX.iter_unpack(raw)]
        self.firsts = [b[0] for b in self.blocks]

    def entries(self, block: int):
        _, off, length, held, _ = self.blocks[block]
        raw = self.file.read_at(length, off)
        data = raw[:-4]
        if zlib.crc32(data) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("a block's checksum differs")
        at, key = 0, b""
        for _ in range(held):
            shared, at = _take_varint(data, at)
            rest, at = _take_varint(data, at)
            size, at = _take_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, np.frombuffer(data, f"<u{self.width}", size // self.width, at)
            at += size

    def scan(self):
        for k in range(len(self.blocks)):
            yield from self.entries(k)

    def may_hold(self, key: bytes) -> bool:
        raw = self.file.read_at(self.bloom_n, self.bloom_at)
        bits = struct.unpack("<Q", raw[:8])[0]
        bloom = np.unpackbits(np.frombuffer(raw, np.uint8, offset=8))
        return bool(bloom[_bloom_slots(np.array([_bloom_key(key)], np.uint64), bits, self.hashes)].all())

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Token ids of all documents with this identifier (none: an empty list)."""
        key = key_of(doc_id)
        if not self.blocks or not self.may_hold(key):
            return []
        k = max(0, bisect_right(self.firsts, key) - 1)
        while k > 0 and self.firsts[k] == key:  # a repeated key may begin in an earlier block
            k -= 1
        found = []
        while k < len(self.blocks) and self.firsts[k] <= key:
            found += [ids for got, ids in self.entries(k) if got == key]
            k += 1
        return found


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 1, docs_per_shard: int = 8192, most: int = 1 << 15) -> DataFrame:
    """Write ``docs`` (doc_id, text) as shards; the manifest, a row a shard in key order, with the tokens before it in ``start``.

    There are ``most`` shards at most: beyond docs_per_shard * most documents shards grow.
    """
    out = scratch(docs.sparkSession, "sst")

    def write(batches):
        give_back()
        own, writer = encoder(tokenizer), None
        for batch in batches:
            texts = own.encode_all(batch.column(1), end_id)
            for doc_id, ids in zip(batch.column(0).to_pylist(), texts, strict=True):
                if writer is None:
                    writer = ShardWriter(f"{out}/{uuid.uuid4().hex}.sst", max(own.lib.get_vocab_size(), end_id + 1))
                writer.add(key_of(doc_id), ids)
        if writer is not None:
            row = {"shard": TaskContext.get().partitionId()} | writer.close()
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), *((k, pa.int64()) for k in list(row)[2:])]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = rows.count()
    shards = max(1, -(-n // max(docs_per_shard, -(-n // most))))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    with small_batches(docs.sparkSession):
        done = materialize(rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).mapInArrow(write, MANIFEST), "sst-manifest")
    # a row a shard, of which there are ``most``: one ordered running sum is enough
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return done.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def read_shards(manifest: DataFrame) -> DataFrame:
    """A row a document, from the files: doc_id, start (ids before it), n_tokens, ids_crc32."""

    def read(batches):
        give_back()
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                for key, ids in Shard(path).scan():
                    rows.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    n = max(1, manifest.count())
    return manifest.select("path", "start").repartition(n, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])
