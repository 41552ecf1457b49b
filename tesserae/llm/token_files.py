"""Token-id files: every document's ids compressed on their own with a shared zstandard dictionary.

A file holds documents in ascending doc_id order:

    magic "TIDZ0001" | dictionary hash (first 8 bytes of SHA-256) | id width, 1 byte (2 or 4) | 7 zero bytes
    one zstandard frame for each document
    index: doc_id int64, offset uint64, size uint32, n_tokens uint32 for each document, as four columns
    footer: index offset uint64, documents uint64, of these without doc_id (they are first) uint64, magic

The dictionary file lies beside them and is named by its hash. One document is read with its index entry and one
range read. All numbers are little-endian.

Plan: texts are tokenized where they are read, compressed, and only the compressed documents are shuffled, to
partitions of ascending doc_id ranges whose bounds come from quantiles of doc_id alone. Rows of equal doc_id (repeats,
nulls first) may meet in one partition: a frame is a fraction of its text, and writers stream.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, let_go, shared_dir, small_batches, table, tidy, written
from .files import Output, open_input

MAGIC = b"TIDZ0001"
END_ID = 1
#: The dictionary is trained on about so many documents, chosen by the hash of doc_id, of which those of at most so many characters count.
SAMPLE_ROWS, SAMPLE_CHARS = 1500, 20_000
DICTIONARY_BYTES = 32_768
LEVEL = 3
#: Rows that one file holds, about; and the most files (each then holds more rows), so that their bounds stay small.
FILE_ROWS, MAX_FILES = 20_000, 20_000
#: Distinct words whose ids a worker remembers; then it starts anew.
CACHE = 600_000
#: The settings of the vocabulary that Words is written for (fixed values); texts of others go to the library whole.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}

#: The lower-case letters, numbers and white space of Latin-1, and the pre-tokens of the vocabulary in such a text (fixed values).
_L, _N, _S = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


class Words:
    """A tokenizer that lower-cases and drops white space, applied to the distinct words of many texts.

    In a Latin-1 text the library's normalizer only lower-cases and turns white space to spaces, and its pre-tokenizer
    cuts the pieces of _PIECE; the library's model encodes each distinct piece. Other texts, and those that may hold a special
    token, are cut at spaces and newlines, which end every pre-token; the library encodes each distinct part. Vocabularies of other
    settings than these are not taken apart: the library encodes each whole text.
    """

    def __init__(self, data: str):
        import tokenizers

        self.source, self.tokenizer = data, tokenizers.Tokenizer.from_str(data)
        self.model = self.tokenizer.model
        d = json.loads(data)
        own = d.get("normalizer") == _NORMALIZER and d.get("pre_tokenizer") == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}
        plain_model = d["model"].get("type") == "BPE" and not d["model"].get("dropout") and not d.get("post_processor") and not d.get("truncation") and not d.get("padding")
        special = all(t["content"].startswith("<|") and t["special"] and not t["normalized"] and not t["single_word"] for t in d.get("added_tokens") or ())
        self.known = own and plain_model and special
        # the byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from 256 in order
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = [b for b in range(256) if b not in plain]
        self.alphabet = {b: 256 + i for i, b in enumerate(rest)}
        self.cache: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece if piece.isalpha() and piece.isascii() else piece.encode("utf-8").decode("latin-1").translate(self.alphabet))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        if not self.known:
            return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if len(self.cache) > CACHE:
            self.cache = {}
        cache, split, whole = self.cache, [], set()
        for t in texts:
            try:
                t.encode("latin-1")
                simple = "<|" not in t
            except UnicodeEncodeError:
                simple = False
            split.append(_PIECE.findall(t.lower()) if simple else t.replace("\n", " ").split(" "))
            if not simple:
                whole.update(split[-1])
        for w in set().union(*split).difference(cache, whole):
            cache[w] = self._piece(w)
        rest = list(whole.difference(cache))
        for a in range(0, len(rest), 20_000):
            part = rest[a : a + 20_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                cache[w] = struct.pack(f"<{len(e.ids)}I", *e.ids)
        get = cache.__getitem__
        return [b"".join(map(get, words)) for words in split]


def _tokenizer(data: str) -> Words:
    words = kept("words", lambda: Words(data))
    if words.source != data:
        let_go()
        words = kept("words", lambda: Words(data))
    return words


def _ids(data: str, texts: list[str | None]) -> Iterator[np.ndarray]:
    """Ids of each text with the end id; texts in groups of bounded number."""
    end = struct.pack("<I", END_ID)
    for a in range(0, len(texts), 200):
        for ids in _tokenizer(data).encode([t or "" for t in texts[a : a + 200]]):
            yield np.frombuffer(ids + end, "<u4")


def train(docs: DataFrame, tokenizer: str, width: int) -> bytes:
    """A dictionary from the serialized ids of the documented sample: trained, or where the sample is too small for that, its own bytes."""
    n = docs.count()
    if n > SAMPLE_ROWS:
        docs = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < (SAMPLE_ROWS << 40) // n)
    # ids may repeat, so the sample is bounded besides
    texts = [r.text for r in docs.where(F.length("text") <= SAMPLE_CHARS).select("text").limit(4 * SAMPLE_ROWS).collect()]
    samples = [x.astype(f"<u{width}").tobytes() for x in _ids(tokenizer, texts)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (ValueError, zstandard.ZstdError):  # too few bytes
        return b"".join(samples)[:DICTIONARY_BYTES]


def _bounds(docs: DataFrame, files: int) -> list[int]:
    """Upper bounds of the doc_id ranges of all files but the last."""
    if files < 2:
        return []
    got = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / files for i in range(1, files)], 100 * files)).first()[0]
    return sorted(set(got or []))


def write(docs: DataFrame, tokenizer_path: str, uri: str, file_rows: int = FILE_ROWS) -> DataFrame:
    """Writes docs (doc_id, text) as token-id files below uri; returns a small table (file, first_doc_id, n_docs, n_tokens) of them.

    Null texts count as empty and have the end id alone; null doc_ids sort first. Rows of equal doc_id keep an order
    by their ids' bytes. Other columns are not read. An empty table makes no file.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        data = f.read()
    import tokenizers

    width = 2 if tokenizers.Tokenizer.from_str(data).get_vocab_size() <= 1 << 16 else 4
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    trained = train(docs, data, width)
    digest = hashlib.sha256(trained).digest()[:8]
    out = Output(f"{uri}/{digest.hex()}.dict")
    out.write(trained)
    out.close()
    bounds = _bounds(docs, min(MAX_FILES, max(1, -(-docs.count() // file_rows))))
    shared = spark.sparkContext.broadcast((data, trained, np.array(bounds, np.int64)))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, trained, bounds = shared.value
        d = zstandard.ZstdCompressionDict(trained) if trained else None
        if d:
            d.precompute_compress(LEVEL)
        c = zstandard.ZstdCompressor(level=LEVEL, dict_data=d)
        for b in batches:
            n, frames = [], []
            for ids in _ids(data, b.column(1).to_pylist()):
                n.append(len(ids))
                frames.append(c.compress(ids.astype(f"<u{width}").tobytes()))
            # the first range whose upper bound is not below doc_id; nulls in the first
            place = np.searchsorted(bounds, b.column(0).fill_null(-(1 << 63)).to_numpy()).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(place), b.column(0), pa.array(n, pa.int64()), pa.array(frames, pa.binary())], names=["place", "doc_id", "n", "frame"])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: list[Output] = []
        try:
            yield from one_file(batches, opened)
        except BaseException:
            for out in opened:
                out.abandon()
            raise

    def one_file(batches: Iterator[pa.RecordBatch], opened: list[Output]) -> Iterator[pa.RecordBatch]:
        index, name, nulls = tuple(array(kind) for kind in "qQII"), "", 0
        for b in batches:
            for doc, n, frame in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if not opened:
                    first = doc
                    name = "without.tid" if doc is None else f"{doc + (1 << 63):020d}.tid"
                    opened.append(Output(f"{uri}/{name}"))
                    opened[0].write(MAGIC + digest + bytes([width]) + bytes(7))
                nulls += doc is None
                for column, x in zip(index, (doc or 0, opened[0].tell(), len(frame), n), strict=True):
                    column.append(x)
                opened[0].write(frame)
        if not opened:
            return
        out, at = opened[0], opened[0].tell()
        for column, kind in zip(index, ("<i8", "<u8", "<u4", "<u4"), strict=True):
            out.write(np.array(column, kind).tobytes())
        out.write(struct.pack("<QQQ", at, len(index[0]), nulls) + MAGIC)
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first], pa.int64()), pa.array([len(index[0])], pa.int64()), pa.array([sum(index[3])], pa.int64())], names=["file", "first_doc_id", "n_docs", "n_tokens"])

    small_batches(spark)
    frames = docs.mapInArrow(tidy(compress, "words"), "place int, doc_id long, n long, frame binary").repartitionById(len(bounds) + 1, "place").drop("place")
    return written(frames.sortWithinPartitions("doc_id", "frame").mapInArrow(tidy(save), "file string, first_doc_id long, n_docs long, n_tokens long"), "token-files")


def read_index(f) -> tuple[bytes, int, list[np.ndarray], int]:
    """Dictionary hash, id width, index columns and number of documents without doc_id of an open file, by range reads of its header, footer and index."""
    size = f.size()
    head = f.read_at(24, 0)
    at, n, nulls = struct.unpack("<QQQ", f.read_at(32, size - 32)[:24])
    if head[:8] != MAGIC or f.read_at(8, size - 8) != MAGIC:
        raise ValueError("not a token-id file")
    raw, out, p = f.read_at(24 * n, at), [], 0
    for kind in ("<i8", "<u8", "<u4", "<u4"):
        step = n * int(kind[2])
        out.append(np.frombuffer(raw[p : p + step], kind))
        p += step
    return head[8:16], head[16], out, nulls


def _decompressor(uri: str, digest: bytes) -> zstandard.ZstdDecompressor:
    with open_input(f"{uri}/{digest.hex()}.dict") as f:
        trained = f.read()
    if hashlib.sha256(trained).digest()[:8] != digest:
        raise ValueError("the dictionary does not have the hash of the file")
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)


def read_documents(uri: str, file: str, doc_ids: list[int]) -> list[np.ndarray]:
    """Ids of single documents of one file: its index, then one range read each."""
    with open_input(f"{uri}/{file}") as f:
        digest, width, (docs, offsets, sizes, _), nulls = read_index(f)
        d, out = _decompressor(uri, digest), []
        for doc in doc_ids:
            i = nulls + int(np.searchsorted(docs[nulls:], doc))
            if i == len(docs) or docs[i] != doc:
                raise KeyError(doc)
            out.append(np.frombuffer(d.decompress(f.read_at(int(sizes[i]), int(offsets[i]))), f"<u{width}"))
        return out


def read(files: DataFrame, uri: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary: little-endian unsigned 32-bit) of every document of the files.

    files: what write() returned, of one row a file. Starts follow from the totals of the files before, which are
    summed over that small table.
    """
    return _read(files, uri, False)


def _read(files: DataFrame, uri: str, digest_only: bool) -> DataFrame:
    spark = files.sparkSession
    before = "coalesce(sum(n_tokens) over (order by first_doc_id nulls first rows between unbounded preceding and 1 preceding), 0)"
    todo = files.selectExpr("file", f"{before} as start").repartition(max(1, files.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, start in zip(*(x.to_pylist() for x in b.columns), strict=True):
                with open_input(f"{uri}/{file}") as f:
                    digest, width, (docs, offsets, sizes, counts), nulls = read_index(f)
                    d = _decompressor(uri, digest)
                    starts = start + np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                    for a in range(0, len(docs), 500):
                        z = min(a + 500, len(docs))
                        raw = f.read_at(int(offsets[z - 1]) + int(sizes[z - 1]) - int(offsets[a]), int(offsets[a]))
                        out = []
                        for i in range(a, z):
                            p = int(offsets[i]) - int(offsets[a])
                            ids = np.frombuffer(d.decompress(raw[p : p + int(sizes[i])]), f"<u{width}").astype("<u4").tobytes()
                            if len(ids) != 4 * counts[i]:
                                raise ValueError(f"{file}: document {docs[i]} does not have the ids its index counts")
                            out.append(zlib.crc32(ids) if digest_only else ids)
                        doc = pa.array(docs[a:z], pa.int64(), mask=np.arange(a, z) < nulls)
                        last = pa.array(out, pa.int64() if digest_only else pa.binary())
                        yield pa.RecordBatch.from_arrays([doc, pa.array(starts[a:z]), pa.array(counts[a:z].astype(np.int64)), last], names=["doc_id", "start", "n_tokens", "last"])

    name = "ids_crc32 long" if digest_only else "ids binary"
    out = todo.mapInArrow(tidy(run), f"doc_id long, start long, n_tokens long, last {name.split()[1]}")
    return out.withColumnRenamed("last", name.split()[0])


def digests(files: DataFrame, uri: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    return _read(files, uri, True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    uri = shared_dir(spark, "tids")
    files = write(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), uri)
    return digests(files, uri)
