"""Byte-level BPE: recursive DuckDB queries encode each partition's words, ordered aggregation decodes.

Each Arrow batch of texts is split by the pre-token pattern; its distinct words go to an in-process DuckDB. A word that
is a token is that token. Others start as one token per byte; the recursive query joins the adjacent tokens of every position to the merge
table, contracts the leftmost pair of minimum rank of each word and stops where no pair merges.

Longer words than WINDOW bytes are cut into windows that overlap by half, which the same query encodes at once. Tokens in a row are a text's
encoding if every two neighbours are the encoding of their own bytes, and all neighbours in a window's encoding are. So two windows are joined at any
token that both have at the same place; where they have none, a window that begins at a token of the one before takes the second one's place.
Time and memory grow with a word's length, not with its square.

The merge table is a function of the vocabulary file, whose size is fixed; nothing else is broadcast, there is no shuffle, and DuckDB writes no
files.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, let_go, small_batches, table, tidy

#: Bytes of a word, or of a window of a longer one, that is contracted at once. Windows are four times the longest token at least.
WINDOW = 256
#: Distinct words whose tokens a worker remembers; then it starts anew.
CACHE = 600_000
#: Bytes of words in one recursive query, and characters of texts handled together: these bound memory.
QUERY_BYTES = 1_000_000
GROUP_CHARS = 1_500_000
#: Ids that one decoding query aggregates.
DECODE_IDS = 150_000

_CONTRACT = """
WITH RECURSIVE r(w, toks) USING KEY (w) AS (
    SELECT w, toks FROM start
    UNION
    SELECT r.w, list_concat(list_append(r.toks[:x.k % 1048576 - 1], CAST(x.k // 1048576 AS INTEGER)), r.toks[x.k % 1048576 + 2:])
    FROM r JOIN (
        SELECT q.w, min(m.rank * 1048576 + q.i) AS k
        FROM (SELECT w, unnest(toks[:-2]) AS a, unnest(toks[2:]) AS b, unnest(range(1, len(toks))) AS i FROM r) q
        JOIN merge m ON m.ab = CAST(q.a AS BIGINT) * 16777216 + q.b
        GROUP BY q.w
    ) x ON x.w = r.w
)
SELECT w, toks FROM r
"""

def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank a line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Codec:
    """Encodes and decodes with one vocabulary, in an in-process DuckDB."""

    def __init__(self, data: bytes, pattern: str):
        import duckdb
        import regex

        self.source = (data, pattern)
        self.ranks = ranks = read_ranks(data)
        self.pattern = regex.compile(pattern)
        self.byte = [ranks[bytes([b])] for b in range(256)]
        rows = []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    rows.append((a * 16777216 + b, rank))
        merges = pd.DataFrame(rows, columns=["ab", "rank"])
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(ranks.values())] = [len(t) for t in ranks]
        self.window = max(WINDOW, 4 * int(self.sizes.max()))
        tokens = pd.DataFrame({"id": list(ranks.values()), "hex": [t.hex() for t in ranks]})
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        for name, df in (("merge", merges), ("token", tokens)):
            self.db.register("given", df)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.cache: dict[str, bytes] = {}

    def words(self, words: list[str]) -> list[bytes]:
        """The tokens of each word of the pattern, as little-endian unsigned 32-bit numbers."""
        if len(self.cache) > CACHE:
            self.cache = {}
        out = list(map(self.cache.get, words))
        todo, size = [], 0
        for i in [i for i, x in enumerate(out) if x is None]:
            raw = words[i].encode("utf-8", "surrogatepass")
            rank = self.ranks.get(raw)
            if rank is not None:
                out[i] = self.cache[words[i]] = rank.to_bytes(4, "little")
                continue
            if len(raw) > self.window:
                out[i] = self._long(raw)
                continue
            todo.append((i, raw))
            size += len(raw)
            if size > QUERY_BYTES:
                self._short(todo, words, out)
                todo, size = [], 0
        self._short(todo, words, out)
        return out

    def _short(self, todo: list[tuple[int, bytes]], words: list[str], out: list[bytes | None]) -> None:
        for (i, _), ids in zip(todo, self._contract([raw for _, raw in todo]), strict=True):
            out[i] = self.cache[words[i]] = ids.astype("<u4").tobytes()

    def _contract(self, parts: list[bytes]) -> list[np.ndarray]:
        """The tokens of each part, by the recursive query."""
        if not parts:
            return []
        ends = np.cumsum([len(raw) for raw in parts])
        toks = np.array(self.byte, np.int32)[np.frombuffer(b"".join(parts), np.uint8)]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(toks))
        got = self._run("start", pa.table({"w": pa.array(np.arange(len(parts), dtype=np.int64)), "toks": lists}), _CONTRACT)
        lists = got.column("toks").combine_chunks()
        flat, cuts = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))[:-1]
        out: list = [None] * len(parts)
        for w, ids in zip(got.column("w").to_pylist(), np.split(flat, cuts), strict=True):
            out[w] = ids
        return out

    def _at(self, raw: bytes, places: list[int], size: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The tokens of the windows that begin at places, and where each begins and the last ends."""
        out = []
        for a in range(0, len(places), max(1, QUERY_BYTES // size)):
            own = places[a : a + max(1, QUERY_BYTES // size)]
            out += [(ids, x + np.concatenate([[0], np.cumsum(self.sizes[ids])])) for x, ids in zip(own, self._contract([raw[x : x + size] for x in own]), strict=True)]
        return out

    def _long(self, raw: bytes) -> bytes:
        """The tokens of a word of any length, from windows."""
        n, step = len(raw), self.window // 2
        windows = self._at(raw, list(range(0, max(1, n - step), step)), self.window)
        done, (ids, at), i = [], windows[0], 1
        while at[-1] < n:
            while i + 1 < len(windows) and windows[i + 1][1][0] < at[-1] - step:
                i += 1
            size, joint = self.window, None
            if i < len(windows):
                joint, right = _common(at, windows[i][1]), windows[i]
                i += 1
            while joint is None:
                if size >= n:  # no two windows agree anywhere
                    return self._contract([raw])[0].astype("<u4").tobytes()
                middle = int(at[len(ids) // 2])
                right = self._at(raw, [middle], size + int(at[-1]) - middle)[0]
                joint = _common(at, right[1])
                size *= 2
            k, j = joint
            done.append(ids[:k])
            ids, at = right[0][j:], right[1][j:]
        return np.concatenate([*done, ids]).astype("<u4").tobytes()

    def _run(self, name: str, start: pa.Table, sql: str) -> pa.Table:
        self.db.register(name, start)
        try:
            got = self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister(name)
        return got

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        pieces, counts = [], []
        for t in texts:
            found = self.pattern.findall(t)
            counts.append(len(found))
            pieces += found
        if not pieces:
            return [np.empty(0, "<u4") for _ in texts]
        codes, distinct = pd.factorize(np.array(pieces, dtype=object))
        del pieces
        ids = self.words(list(distinct))
        lens = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, first = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(lens) - lens
        n = lens[codes]
        ends = np.cumsum(n)
        all_ids = flat[np.repeat(first[codes] - (ends - n), n) + np.arange(ends[-1])]
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return [all_ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each array of ids: tokens joined to the vocabulary, then aggregated in order."""
        lens = np.array([len(x) for x in ids], np.int64)
        if len(ids) > 1 and lens.sum() > DECODE_IDS:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        out = [b""] * len(ids)
        if not lens.sum():
            return out
        start = pa.table({"d": np.repeat(np.arange(len(ids), dtype=np.int64), lens), "p": np.arange(lens.sum()), "id": np.concatenate(ids).astype(np.int64)})
        got = self._run("given", start, "SELECT d, count(hex) AS n, string_agg(hex, '' ORDER BY p) AS h FROM given LEFT JOIN token USING (id) GROUP BY d")
        for d, n, h in zip(*(got.column(c).to_pylist() for c in ("d", "n", "h")), strict=True):
            if n != lens[d]:
                raise ValueError("an id is not in the vocabulary")
            out[d] = bytes.fromhex(h)
        return out


def _common(left: np.ndarray, right: np.ndarray) -> tuple[int, int] | None:
    """The numbers of a token that begins and ends at the same places in both windows, the last such; none if they share none."""
    both, k, j = np.intersect1d(left, right, assume_unique=True, return_indices=True)
    whole = np.nonzero((np.diff(k) == 1) & (np.diff(j) == 1))[0]
    return (int(k[whole[-1]]), int(j[whole[-1]])) if len(whole) else None


def _codec(data: bytes, pattern: str) -> Codec:
    codec = kept("bpe", lambda: Codec(data, pattern))
    if codec.source != (data, pattern):
        let_go()
        codec = kept("bpe", lambda: Codec(data, pattern))
    return codec


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of GROUP_CHARS characters at most, single longer texts apart."""
    a = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > a and size + n > GROUP_CHARS:
            yield a, i
            a, size = i, 0
        size += n
    if a < len(texts):
        yield a, len(texts)


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>), one row per row of docs: the tokens of its whole text; null counts as empty.

    vocabulary: path of a rank file that the driver can read. Texts of any length and repeated rows are fine; other
    columns are not read; an empty table gives an empty result.
    """
    return _run(docs, vocabulary, pattern, False)


def decode(tokens: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, bytes binary) from (doc_id, ids); null ids count as none. An unknown id is an error."""
    shared = tokens.sparkSession.sparkContext.broadcast(_read(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.array(x or [], "<u4") for x in b.column(1).to_pylist()]
            out = _codec(shared.value, pattern).decode(ids)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    small_batches(tokens.sparkSession)
    return tokens.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(tidy(run, "bpe"), "doc_id long, bytes binary")


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def round_trip(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row per row of docs: texts encoded, then decoded from the ids.

    Null texts count as empty: no ids, and the hash of nothing. Repeated rows each come back.
    """
    return _run(docs, vocabulary, pattern, True)


def _run(docs: DataFrame, vocabulary: str, pattern: str, digest: bool) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_read(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codec, texts = _codec(shared.value, pattern), batch.column(1).to_pylist()
            for a, b in _groups(texts):
                ids = codec.encode([t or "" for t in texts[a:b]])
                doc = batch.column(0).slice(a, b - a)
                if not digest:
                    lists = pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([doc, lists], names=["doc_id", "ids"])
                    continue
                back = codec.decode(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        doc,
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    small_batches(spark)
    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids array<int>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run, "bpe"), out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
