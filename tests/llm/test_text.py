"""Tokens, languages, personal data and leaks, against libraries and brute force."""

import hashlib
import itertools
import json
import random
import re
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.llm import bpe, decontaminate, lang_id, licenses, pii, token_files
from tesserae.llm.common import shared_dir

from .conftest import LONG


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def tiktoken_encoding():
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})


def test_bpe_equals_the_library(spark, docs, edge_docs, tiktoken_encoding):
    vocabulary = P.path("byte_bpe_multi_50k.tiktoken")
    for df in (docs, edge_docs):
        want = sorted((str(r.doc_id), tuple(tiktoken_encoding.encode_ordinary(r.text or ""))) for r in df.collect())
        ids = bpe.encode(df, vocabulary, P.PATTERN)
        assert sorted((str(r.doc_id), tuple(r.ids)) for r in ids.collect()) == want
    back = bpe.decode(bpe.encode(edge_docs, vocabulary, P.PATTERN), vocabulary, P.PATTERN).collect()
    assert sorted(bytes(r.bytes) for r in back) == sorted((r.text or "").encode() for r in edge_docs.collect())
    got = {r.doc_id: r for r in bpe.round_trip(edge_docs, vocabulary, P.PATTERN).collect()}
    assert got[5].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest() and got[4].n_tokens == 0


def test_bpe_long_words(tiktoken_encoding):
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        codec = bpe.Codec(f.read(), P.PATTERN)
    rng = np.random.default_rng(3)
    hard = ["a" * 700, "ab" * 300, "".join(rng.choice(list("abcdefghij"), 1500)), "=-=" * 300, "é中" * 200, "", "\n\n  x", *("".join(rng.choice(list("thereaonis "), 200)) for _ in range(20))]
    for text, ids in zip(hard, codec.encode(hard), strict=True):
        assert ids.tolist() == tiktoken_encoding.encode_ordinary(text)


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "ACGT", "a", "ab", "=-"])
def test_bpe_of_one_endless_word(tiktoken_encoding, letters):
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        codec = bpe.Codec(f.read(), P.PATTERN)
    rng, start = np.random.default_rng(4), time.monotonic()
    text = "".join(rng.choice(list(letters), 100_000 if len(letters) > 9 else 20_000))
    assert codec.encode([text])[0].tolist() == tiktoken_encoding.encode_ordinary(text)
    assert time.monotonic() - start < 60
    for n in rng.integers(codec.window - 2, 3 * codec.window, 10):
        text = "".join(rng.choice(list(letters), n))
        assert codec.encode([text])[0].tolist() == tiktoken_encoding.encode_ordinary(text)


def test_bpe_empty(spark, no_docs):
    assert bpe.encode(no_docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def _token_rows(df):
    import tokenizers

    t = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    out = []
    for r in df.collect():
        ids = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        out.append((r.doc_id, len(ids), zlib.crc32(ids.tobytes())))
    return sorted(out, key=str)


def test_token_files(spark, docs, edge_docs):
    for df in (docs, edge_docs):
        uri = shared_dir(spark, "test-tids")
        files = token_files.write(df, P.path("word_bpe_49k.json"), uri, file_rows=64)
        got = token_files.digests(files, uri).collect()
        assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == _token_rows(df)
        at = 0
        for r in sorted(got, key=lambda r: r.start):
            assert r.start == at
            at += r.n_tokens
        ids = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
        assert ids == sorted(ids)
    first = files.orderBy("first_doc_id").first()
    assert token_files.read(files, uri).where("doc_id = 7").first().n_tokens == 2
    assert len(token_files.read_documents(uri, first.file, [7])[0]) == 2
    with pytest.raises(KeyError):
        token_files.read_documents(uri, first.file, [99])


def test_token_files_of_few_and_odd_rows(spark):
    """The dictionary is there however small the table is; null and least ids are told apart."""
    df = spark.createDataFrame([(-(1 << 63), "the least"), (None, "no id"), (None, None), (4, "four")], "doc_id long, text string")
    uri = shared_dir(spark, "test-tids")
    files = token_files.write(df, P.path("word_bpe_49k.json"), uri)
    got = [(r.doc_id, r.n_tokens) for r in token_files.digests(files, uri).orderBy("start").collect()]
    assert [d for d, _ in got] == [None, None, -(1 << 63), 4] and sorted(n for _, n in got) == [1, 2, 3, 3]
    file = files.first().file
    with token_files.open_input(f"{uri}/{file}") as f:
        digest = token_files.read_index(f)[0]
    assert digest != hashlib.sha256(b"").digest()[:8]
    assert len(token_files.read_documents(uri, file, [-(1 << 63)])[0]) == 3
    with pytest.raises(KeyError):
        token_files.read_documents(uri, file, [0])


def test_token_words_of_another_vocabulary():
    """A vocabulary with another normalizer is left to the library."""
    import tokenizers

    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        data = json.load(f)
    data["normalizer"]["normalizers"].pop()
    data = json.dumps(data)
    words, texts = token_files.Words(data), ["A b  C", "it's", "", "ABC abc"]
    assert not words.known
    library = tokenizers.Tokenizer.from_str(data)
    assert [np.frombuffer(x, "<u4").tolist() for x in words.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_words():
    import tokenizers

    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        data = f.read()
    words, library = token_files.Words(data), tokenizers.Tokenizer.from_str(data)
    rng = np.random.default_rng(1)
    texts = ["it's WE'LL !'s 'S", "<|endoftext|> a", "“curly” ’s Ελλ é", "a..b,,c ... ''", "x\x00y\x7f\xad"]
    texts += ["".join(rng.choice(list("ab'sStT .,!<|>é½É\n\t\x1c\x85\xa0²9_-ÿŸ"), 60)) for _ in range(300)]
    for t, got in zip(texts, words.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_token_files_empty(spark, no_docs):
    uri = shared_dir(spark, "test-tids")
    files = token_files.write(no_docs, P.path("word_bpe_49k.json"), uri)
    assert files.count() == 0 and token_files.digests(files, uri).count() == 0


def test_language_accuracy_and_edges(spark, docs, edge_docs, no_docs):
    known = docs.where(~lang_id.held_out(F.col("doc_id")))
    model = lang_id.learn(known)
    r = lang_id.identify(docs.where(lang_id.held_out(F.col("doc_id"))), model).selectExpr("avg(cast(lang = _lang as double)) a").first()
    assert r.a > 0.95
    got = [(r.doc_id, r._lang, r._score) for r in lang_id.identify(edge_docs, model).collect()]
    assert len(got) == edge_docs.count()
    assert {(a, b, c) for a, b, c in got if a in (3, 4, 6)} == {(3, "und", 0.0), (4, "und", 0.0), (6, "und", 0.0)}
    assert all(0 <= s <= 1 for *_, s in got)
    assert lang_id.identify(no_docs, model).count() == 0
    nothing = lang_id.learn(no_docs)
    assert {r._lang for r in lang_id.identify(edge_docs, nothing).collect()} == {"und"}
    mixed = spark.createDataFrame([(1, "the and of that with was on the in for from this " * 3 + "der die und das ist nicht ein mit auf für von den " * 3)], "doc_id long, text string")
    spans = lang_id.label_spans(mixed, model).first().spans
    assert sum(s.n_words for s in spans) == 72 and [s.lang for s in spans] == ["en", "de"]


def test_viterbi_is_optimal():
    rng = np.random.default_rng(4)
    model = lang_id.Model(["a", "b", "c"], rng.random((lang_id.BUCKETS, 3)) * 50, np.ones((len(lang_id._NAMES), 3)))
    texts = [" ".join("".join(rng.choice(list("abcdefg"), 3)) for _ in range(n)) for n in (1, 5, 7, 0, 6)]
    labels, offsets = model.paths(texts)
    for i, text in enumerate(texts):
        words = text.split()
        if not words:
            continue
        e = model.emissions(np.array(words, object))
        cost = lambda p, e=e: sum(e[j, k] for j, k in enumerate(p)) + lang_id.PENALTY * -sum(a != b for a, b in zip(p, p[1:], strict=False))
        best = max(cost(p) for p in itertools.product(range(3), repeat=len(words)))
        assert cost(labels[offsets[i] : offsets[i + 1]].tolist()) == pytest.approx(best)


def _luhn(d):
    return sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def _base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and _luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text) if ok(m.group())]


def test_pii_against_brute_force(spark, edge_docs, no_docs):
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("a@b.c-1 2+9()0\U0001f600é,\n"), 300)) for _ in range(150)]
    texts += [
        "a@b.c@d.e x_a@b.c_x@d.ef", "1.2.3.4.5.6.7.8 001.002.003.255 1.2.3.256", "4111 1111-1111 1111 and 4111111111111112", "+1 (555) 010-9999 or +49 30 901820", "9" * 9000, "a" * 9000 + "@" + "b." * 4000 + "c",
        "IBAN DE89 3704 0044 0532 0130 00 here", "GB82WEST12345698765432", "XX00 1234 5678 9012 345", "my ssn is 123-45-6789.", "part 123-45-6789 no", "1.1.1.1 " * 700,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(df).collect():
        want = _base_spans(texts[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), texts[r.doc_id][:80]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in want) for x in pii.BASE)
        extra = {s.split(":")[0] for s in r.spans.split(",") if s} - set(pii.BASE)
        expected = {"IBAN": {"iban"}, "GB82": {"iban"}, "my s": {"ssn"}}.get(texts[r.doc_id][:4], set())
        if r.doc_id >= 150:
            assert extra == expected
    assert pii.find(edge_docs).count() == edge_docs.count() and pii.find(no_docs).count() == 0
    hidden = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert hidden[152] == "[CARD] and 4111111111111112" and hidden[153] == "[PHONE] or [PHONE]"
    assert [r.text for r in pii.redact(edge_docs).where("doc_id = 4").collect()] == [None]
    assert pii.redact(edge_docs).columns == edge_docs.columns


def test_pii_context_reaches_over_matches(spark):
    """The context is 40 characters of the text on either side, whatever other matches lie in it."""
    texts = [
        "SSN: 123-45-6789, 234-56-7890", "123-45-6789, 234-56-7890 (SSN)", "SSN: 000-45-6789 234-56-7890", "SSN: 123-45-6789, 234-56-7890, 345-67-8901, 456-78-9012",
        "SSN" + " " * 37 + "123-45-6789", "SSN" + " " * 38 + "123-45-6789", "SSN 123-45-6789" + "x" * 25 + "234-56-7890", "SSN 123-45-6789" + "x" * 26 + "234-56-7890", "123-45-6789123-45-6789 ssn", "part 123-45-6789, 234-56-7890",
    ]
    words = re.compile(pii.KINDS["ssn"][2], re.I)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {}
    for i, t in enumerate(texts):
        found = [m for m in re.finditer(pii.KINDS["ssn"][0], t) if not re.search("^(000|666|9)|-00-|0000$", m[0])]
        want[i] = [f"ssn:{m.start()}:{m.end()}" for m in found if words.search(t[max(0, m.start() - 40) : m.start()] + "\n" + t[m.end() : m.end() + 40])]
    assert {r.doc_id: [s for s in r.spans.split(",") if s.startswith("ssn")] for r in pii.find(df).collect()} == want
    assert [len(want[i]) for i in range(10)] == [2, 2, 1, 3, 1, 0, 2, 1, 2, 0]
    assert pii.redact(df).where("doc_id = 0").first().text == "SSN: [SSN], [SSN]"


@pytest.mark.parametrize("n", [*range(5, 21), 25])
def test_seeds_hit_every_pattern(n):
    """n aligned words of which any fifth differ share a masked window; longer runs hold a shorter one of that share."""
    masks = decontaminate.SHORT_MASKS if n < decontaminate.OVERLAP else decontaminate.LONG_MASKS
    ends = 0 if n < decontaminate.OVERLAP else 1  # a run begins and ends with an equal word
    places = [sum(1 << (o + i) for i, c in enumerate(m) if c == "1") for m in masks for o in range(n - len(m) + 1)]
    for gone in itertools.combinations(range(ends, n - ends), n // 5):
        bits = sum(1 << x for x in gone)
        assert any(not p & bits for p in places)


def test_best_runs_are_longest():
    rng = np.random.default_rng(8)
    sames = [rng.random(rng.integers(0, 25)) < 0.7 for _ in range(300)]
    starts, ends = decontaminate.best_runs(np.concatenate(sames), np.concatenate([[0], np.cumsum([len(x) for x in sames])]))
    for same, s, e in zip(sames, starts, ends, strict=True):
        runs = [(z - a) for a in range(len(same)) for z in range(a + 1, len(same) + 1) if same[a] and same[z - 1] and same[a:z].sum() * 100 >= 80 * (z - a)]
        assert e - s == max(runs, default=0) and (e == s or same[s] and same[e - 1])


def _all_diagonals(items, texts):
    """Every leak by all diagonals of all texts and items, without seeds."""
    out, words = set(), lambda t: decontaminate._WORD.findall((t or "").lower())
    for t, w in enumerate(map(words, texts)):
        for i, v in ((i, words(x)) for i, x in items):
            best, n = None, len(v)
            for d in range(-n + 1, len(w)) if n >= decontaminate.LEAST_WORDS else ():
                lo, hi = max(d, 0), min(d + n, len(w))
                same = np.array([w[k] == v[k - d] for k in range(lo, hi)], bool)
                s, e = (int(x[0]) for x in decontaminate.best_runs(same, np.array([0, len(same)])))
                if e > s and (e - s >= min(decontaminate.OVERLAP, n) or same.sum() >= 0.8 * n):
                    row = (e - s, int(same[s:e].sum()), -(lo + s), -(lo - d + s))
                    best = max(best or row, row)
            if best:
                out.add((t, i, best[0], best[1], -best[2], -best[3]))
    return out


def test_leaks_with_changed_words(monkeypatch):
    """The seeds find what all diagonals do, whatever words repeat or are replaced, in one step or many."""
    rng, found = np.random.default_rng(9), 0
    for trial in range(40):
        monkeypatch.setattr(decontaminate, "STEP", 1 << 21 if trial % 2 else 50)
        vocabulary = [f"w{k}" for k in range(rng.integers(2, 60))]
        items = [(k, " ".join(rng.choice(vocabulary, rng.integers(3, 30)))) for k in range(5)]
        texts = [None, ""]
        for _ in range(5):
            w = list(rng.choice([f"x{j}" for j in range(30)], rng.integers(0, 40)))
            for _ in range(2):
                at = int(rng.integers(0, len(w) + 1))
                w[at:at] = ["other" if rng.random() < 0.15 else x for x in items[rng.integers(5)][1].split()]
            texts.append(" ".join(w))
        got, want = set(decontaminate.Block(items).find(*decontaminate.word_hashes(texts))), _all_diagonals(items, texts)
        assert got == want
        found += len(want)
    assert found > 100


def test_leaks_of_repeated_words():
    start = time.monotonic()
    for item, text, want in [("a " * 10_000, "a " * 100_000, (10_000, 10_000, 0, 0)), ("a b c " * 1000, "c a b " * 40_000, (3000, 3000, 1, 0)), ("a " * 500 + "b " + "a " * 500, "a " * 5000, (1001, 1000, 0, 0))]:
        assert decontaminate.Block([(7, item)]).find(*decontaminate.word_hashes([text])) == [(0, 7, *want)]
    assert time.monotonic() - start < 60


def test_leaks(spark, docs, edge_docs, no_docs, sf_dir, monkeypatch):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    words = lambda t: decontaminate._WORD.findall((t or "").lower())
    items = {r.item_id: " ".join(words(r.text)) for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if f" {t} " in f" {' '.join(words(r.text))} "}
    assert want == {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    item = bench.where("item_id = 1").first().text.split()
    changed = [w if i % 7 else "replaced" for i, w in enumerate(item)]
    texts = ["before " + " ".join(changed) + " after", " ".join(item[:5]), " ".join(reversed(item))]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(made, bench).collect()} == {(0, 1)}
    assert [r.doc_id for r in decontaminate.clean(made, bench).orderBy("doc_id").collect()] == [1, 2]
    odd = spark.createDataFrame([(None, "einzeln steht dieser satz hier"), (1, None), (2, ""), (3, "the quick brown fox jumps over the lazy dog"), (4, "one")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.leaks(edge_docs, odd).collect()) == [1, 1, 2]
    kept = decontaminate.clean(edge_docs, odd)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count() - 3
    assert decontaminate.leaks(no_docs, odd).count() == 0 and decontaminate.leaks(edge_docs, odd.where("false")).count() == 0
    # several blocks give the same
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 100)
    assert len(list(decontaminate._blocks(bench))) > 3
    assert want == {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    # rows of one doc_id are judged apart
    leak = "the quick brown fox jumps over the lazy dog"
    rows = spark.createDataFrame([(5, leak, 1), (5, "nothing of the kind stands here at all", 2), (6, "nothing of the kind stands here at all", 3), (None, leak, 4), (None, None, 5)], "doc_id long, text string, __leaked long")
    assert sorted(r["__leaked"] for r in decontaminate.clean(rows, odd).collect()) == [2, 3, 5]


def test_licenses(spark, edge_docs, no_docs):
    lead = "some words before it " * 30
    texts = [t for *_, t in licenses.TEMPLATES]
    rows = [(i, lead + t.upper() + " " + lead) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(texts)] + [(200, "licensed under nothing at all"), (201, "Released, under the: MIT -- License")]
    got = {(r.doc_id, r.template) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (name, _, _) in enumerate(licenses.TEMPLATES):
        assert (i, name) in got and (100 + i, name) in got
    assert not any(d == 200 for d, _ in got) and (201, "mit-line") in got
    assert licenses.scan(edge_docs).count() == 0 and licenses.scan(no_docs).count() == 0 and licenses.scan(edge_docs, ()).count() == 0


@pytest.mark.parametrize(("scale", "common"), [(1, 3), (2, 11), (2, 13)])
def test_licenses_collide_as_stated(spark, scale, common):
    size, _, bands, rows = licenses.SCALES[scale]
    n, rng = 2000, random.Random(scale * 100 + common)
    draw = lambda k: [rng.getrandbits(63) for _ in range(k)]
    pairs = []
    for _ in range(n):
        both = draw(common)
        pairs.append((both + draw(size - common), draw(size - common) + both))
    df = spark.createDataFrame(pairs, "a array<long>, b array<long>")
    keys = [licenses._keys(F.col(c), {scale: size}) for c in "ab"]
    met = df.where(F.arrays_overlap(*keys)).count() / n
    p = licenses.collision(common / (2 * size - common), bands, rows)
    assert abs(met - p) < 4 * (p * (1 - p) / n) ** 0.5 + 0.002


def test_licenses_changed_repeated_and_in_blocks(spark, monkeypatch):
    rng, lead = random.Random(4), "some words before it " * 9
    texts = dict((name, text.split()) for name, _, text in licenses.TEMPLATES)
    rows = []
    for name in ("mit-text", "bsd-2-text", "zlib-text", "gpl-notice", "mit-grant"):
        for i in range(12):  # one word in thirty differs, at least one
            ws = list(texts[name])
            for at in rng.sample(range(len(ws)), max(1, len(ws) // 30)):
                ws[at] = f"other{i}"
            rows.append((len(rows), " ".join([lead[rng.randrange(80) :], *ws, lead])))
    rows += [(len(rows), " ".join([*texts["mit-line"], lead, *texts["mit-text"]] * 40)), (len(rows) + 1, rows[0][1]), (len(rows) + 1, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, licenses.scan(docs).collect()))
    duck = duckdb.connect()
    duck.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}))
    want = duck.execute(f"SELECT doc_id, template, license, first_word, containment FROM ({licenses.ORACLE})").fetchall()
    assert len(want) > 60 and got == sorted(want)
    monkeypatch.setattr(licenses, "BLOCK_CHARS", 600)
    assert len(list(licenses._blocks(licenses.TEMPLATES))) > 5
    assert got == sorted(map(tuple, licenses.scan(docs).collect()))
