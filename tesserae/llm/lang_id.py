"""Language identification of mixed-language text.

Script ranges narrow the candidate languages of every word to those that use its script; hashed character n-grams give
each word a log likelihood in each candidate; Viterbi over the words, with a penalty for switching, labels spans. A
document's language is the one with most words in its spans, its score the share of those words.

Training: n-gram and script counts by language over a sample of labelled rows of about TRAIN_ROWS rows, chosen by the
hash of doc_id; the counts are summed by Spark, and the model (BUCKETS numbers a language) goes to the executors.
Prediction is one pass over the texts without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from .common import small_batches, table, tidy, with_columns_from

#: About so many labelled rows are learned from; all if there are fewer.
TRAIN_ROWS = 20_000
#: Hashed n-grams of 1 to GRAMS characters, word boundaries included.
BUCKETS, GRAMS = 1 << 15, 4
#: A language uses a script if this share of its words in the sample is written in it.
SCRIPT_SHARE = 0.01
#: In nats: least log likelihood ratio of one word, and cost of a switch.
FLOOR, PENALTY = -12.0, 10.0
GROUP_CHARS = 2_000_000
_NONE = "und"
_WORD = re.compile(r"[^\W\d_]+")

#: First code points of script ranges, and the scripts' names (fixed values of the Unicode block chart).
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x323B0, "other"),
)
_STARTS = np.array([a for a, _ in SCRIPTS], np.int64)
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT = np.array([_NAMES.index(n) for _, n in SCRIPTS], np.int64)


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct lower-case words with a letter; the number of each word of all texts in a row; each text's first."""
    words, counts = [], []
    for t in texts:
        found = _WORD.findall((t or "").lower())
        counts.append(len(found))
        words += found
    if not words:
        return np.empty(0, object), np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    real = np.fromiter((w.isalpha() or any(c.isalpha() for c in w) for w in distinct), bool, len(distinct))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    if not real.all():
        keep = real[codes]
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes, distinct = (np.cumsum(real) - 1)[codes[keep]], distinct[real]
    return distinct, codes, offsets


def features(distinct: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length: buckets of all n-grams, and the number of the word that each belongs to (ascending)."""
    c = np.frombuffer(("\0" + "\0".join(distinct) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    gap = c == 0
    word = np.minimum(np.cumsum(gap) - 1, len(distinct) - 1)
    h = np.zeros(len(c), np.uint64)
    for n in range(1, GRAMS + 1):
        m = len(c) - n + 1
        if m <= 0:
            return
        h = (h[:m] * np.uint64(0x100000001B3)) ^ (c[n - 1 :] + np.uint64(0x9E37))
        ok = ~gap[:m] if n == 1 else np.ones(m, bool)  # the first and last character may be a boundary, none between
        for k in range(1, n - 1):
            ok &= ~gap[k : k + m]
        if n == 2:
            ok &= ~(gap[:m] & gap[1 : 1 + m])
        x = h[ok] * np.uint64(0x9E3779B97F4A7C15)
        yield (x >> np.uint64(64 - 15)).astype(np.int64), word[:m][ok]


def scripts_of(distinct: np.ndarray) -> np.ndarray:
    """The script of each word's first letter."""
    first = np.fromiter((ord(w[0]) for w in distinct), np.int64, len(distinct))
    return _SCRIPT[np.searchsorted(_STARTS, first, "right") - 1]


class Model:
    def __init__(self, langs: list[str], grams: np.ndarray, scripts: np.ndarray):
        """grams: counts by bucket and language; scripts: counts by script and language."""
        self.langs = langs
        self.weights = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * BUCKETS)).astype(np.float32)
        self.uses = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=0))

    def emissions(self, distinct: np.ndarray) -> np.ndarray:
        """Log likelihood ratio of each word to its best candidate; FLOOR for languages that don't use its script."""
        out = np.zeros((len(distinct), len(self.langs)))
        for bucket, word in features(distinct):
            sums = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(self.weights[bucket], axis=0, dtype=np.float64)])
            ends = np.searchsorted(word, np.arange(len(distinct) + 1))
            out += sums[ends[1:]] - sums[ends[:-1]]
        can = self.uses[scripts_of(distinct)]
        known = can.any(axis=1)
        out = np.where(can, out, -np.inf)
        out[~known] = 0
        return np.maximum(out - out.max(axis=1, keepdims=True), FLOOR)

    def paths(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The language number of every word of all texts, and each text's first word."""
        return self._paths(*words_of(texts))

    def _paths(self, distinct: np.ndarray, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi over all texts side by side."""
        lens = np.diff(offsets)
        labels = np.zeros(len(codes), np.int64)
        if not len(codes):
            return labels, offsets
        e = self.emissions(distinct)
        order = np.argsort(-lens, kind="stable")
        first, lens = offsets[:-1][order], lens[order]
        active = np.searchsorted(-lens, -np.arange(lens[0]), "left")  # texts of more than t words
        v, back, state = e[codes[first[: active[0]]]], [], np.zeros(len(lens), np.int64)
        for t in range(1, lens[0]):
            n = active[t]
            if n < len(v):
                state[n : len(v)] = v[n:].argmax(axis=1)
                v = v[:n]
            best = v.argmax(axis=1)
            switch = v.max(axis=1, keepdims=True) - PENALTY
            back.append((v >= switch, best.astype(np.int16)))
            v = np.maximum(v, switch) + e[codes[first[:n] + t]]
        state[: len(v)] = v.argmax(axis=1)
        for t in range(lens[0] - 1, -1, -1):
            n = active[t]
            labels[first[:n] + t] = state[:n]
            if t:
                stay, best = back[t - 1]
                state[:n] = np.where(stay[np.arange(n), state[:n]], state[:n], best)
        return labels, offsets

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text; und and 0 for a text without a letter, or if no language is known."""
        return self.judge(texts)[:2]

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language and score of each text, and the share of its words that some language's scripts allow; und and zeros as in predict."""
        if not self.langs:
            return [_NONE] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        distinct, codes, offsets = words_of(texts)
        labels, _ = self._paths(distinct, codes, offsets)
        n = len(self.langs)
        text = np.repeat(np.arange(len(texts)), np.diff(offsets))
        share = np.bincount(text * n + labels, minlength=n * len(texts)).reshape(len(texts), n)
        total = share.sum(axis=1)
        best = share.argmax(axis=1)
        can = self.uses[scripts_of(distinct)].any(axis=1)
        known = np.bincount(text, can[codes].astype(float), len(texts))
        return (
            [self.langs[b] if k else _NONE for b, k in zip(best, total, strict=True)],
            [float(share[i, b] / k) if k else 0.0 for i, (b, k) in enumerate(zip(best, total, strict=True))],
            [float(x / k) if k else 0.0 for x, k in zip(known, total, strict=True)],
        )

    def spans(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """(language, first word, words) of every span of every text."""
        if not self.langs:
            return [[] for _ in texts]
        labels, offsets = self.paths(texts)
        out = []
        for a, z in zip(offsets[:-1], offsets[1:], strict=True):
            own = labels[a:z]
            cuts = np.concatenate([[0], np.nonzero(np.diff(own))[0] + 1, [len(own)]]) if z > a else np.zeros(1, np.int64)
            out.append([(self.langs[own[i]], int(i), int(j - i)) for i, j in zip(cuts[:-1], cuts[1:], strict=True)])
        return out


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 1 by 3; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    a = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > a and size + n > GROUP_CHARS:
            yield a, i
            a, size = i, 0
        size += n
    if a < len(texts):
        yield a, len(texts)


def learn(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from (doc_id, text, lang); rows with a null among them are not learned from. No row: a model of no language."""
    spark = labelled.sparkSession
    small_batches(spark)
    known = labelled.select(F.col("doc_id"), F.col("text").cast("string"), F.col("lang").cast("string")).where("doc_id is not null and lang is not null and text is not null")
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * rows / n) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), dtype=object)
            for a, z in _groups(texts):
                distinct, codes, offsets = words_of(texts[a:z])
                if not len(codes):
                    continue
                grams, scripts = list(features(distinct)), scripts_of(distinct)
                of = np.repeat(langs[a:z], np.diff(offsets))
                for lang in set(langs[a:z]):
                    own = np.bincount(codes[of == lang], minlength=len(distinct)).astype(float)
                    into = sums.setdefault(lang, np.zeros(BUCKETS + len(_NAMES)))
                    for bucket, word in grams:
                        into[:BUCKETS] += np.bincount(bucket, own[word], BUCKETS)
                    into[BUCKETS:] += np.bincount(scripts, own, len(_NAMES))
        for lang, into in sums.items():
            at = np.nonzero(into)[0]
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "k": pa.array(at, pa.int32()), "n": into[at]})

    counts = known.select("text", "lang").mapInArrow(tidy(run), "lang string, k int, n double").groupBy("lang", "k").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(counts["lang"]) - {_NONE})
    all_ = np.zeros((BUCKETS + len(_NAMES), len(langs)))
    counts = counts[counts["lang"] != _NONE]
    all_[counts["k"].to_numpy(int), counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int)] = counts["n"]
    return Model(langs, all_[:BUCKETS], all_[BUCKETS:])


def identify(docs: DataFrame, model: Model, names: tuple[str, str, str] = ("_lang", "_score", "_known")) -> DataFrame:
    """All columns of docs with _lang (the predicted language), _score and _known (0 to 1) added, by these names; only text is an input.

    docs must have no column of these names (common.unused gives free ones).

    _known is the share of words in a script that a learned language uses. Null texts and texts without a letter get und and zeros. Repeated rows each come back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs, scores, known = batch.column(text).to_pylist(), [], [], []
            for a, z in _groups(texts):
                got = shared.value.judge(texts[a:z])
                langs += got[0]
                scores += got[1]
                known += got[2]
            added = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(known, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[f"c{i}" for i in range(len(batch.columns) + 3)])

    return with_columns_from(docs, tidy(run), dict(zip(names, (StringType(), DoubleType(), DoubleType()), strict=True)))


def label_spans(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, spans array<struct<lang, first_word, n_words>>): the labelled spans of each text, words with a letter counted from 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column(1).to_pylist(), []
            for a, z in _groups(texts):
                out += [[dict(zip(("lang", "first_word", "n_words"), x, strict=True)) for x in own] for own in shared.value.spans(texts[a:z])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "spans"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, spans array<struct<lang:string,first_word:long,n_words:long>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    out = identify(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
