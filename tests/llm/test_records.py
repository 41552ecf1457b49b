"""Archives, URL rules, fingerprints, similarity and vectors, against brute force."""

import io
import struct
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.llm import lattice, similar, simhash, url_rules, warc
from tesserae.llm.common import connected_components, shared_dir


def _roots(links):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        p, q = root(a), root(b)
        up[max(p, q)] = min(p, q)
    return {x: root(x) for x in list(up)}


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 50)]
    got = connected_components(spark.createDataFrame([*links, (5, 5), (None, 3)], "u long, v long")).collect()
    want = _roots([(a, b) for a, b in links if a != b])
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_fingerprint_hash_is_sparks(spark):
    import xxhash

    text = "a b ü"
    assert spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] == xxhash.xxh64_intdigest(text.encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest(text.encode(), 42) >> 63)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ("a b c", "b c d", "c d a")]
    want = sum(1 << i for i in range(64) if sum(x >> i & 1 for x in h) * 2 > 3)
    assert simhash.fingerprint("A  b\tC\nd a") == want and simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("bucket", [64, 2])
def test_fingerprint_links(spark, bucket):
    """All pairs of at most two bits, whichever way a bucket takes."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 60, dtype=np.int64)
    fps = set(base.tolist())
    for b in base[:40]:
        for _ in range(6):
            x = int(b)
            for i in rng.integers(0, 63, rng.integers(1, 5)):
                x ^= 1 << int(i)
            fps.add(x)
    fps = sorted(fps)
    got = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), bucket).collect()
    near = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 2]
    assert all((r.u ^ r.v).bit_count() <= 2 for r in got)
    assert _roots([(r.u, r.v) for r in got]) == _roots(near)


def test_near_duplicates_edges(spark, edge_docs, no_docs):
    got = simhash.near_duplicates(edge_docs).collect()
    assert len(got) == edge_docs.count()
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    assert {v for (d, _), v in by.items() if d in (1, 2)} == {1}
    assert by[3, "0" * 16] == by[4, "0" * 16] == by[None, "0" * 16] == 3
    assert simhash.near_duplicates(no_docs).count() == 0


def _grouped(df):
    """{id: least id of its group} of documents with ids and different texts."""
    found = similar.groups(df)[1].collect()
    least = {}
    for r in found:
        least[r.root] = min(least.get(r.root, r.id), r.id)
    return {r.id: least[r.root] for r in found}


def test_similar_groups(spark, edge_docs, no_docs):
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefghijkl"), 5)) for _ in range(900)]
    docs, n = [], 0
    for _ in range(12):
        words = rng.choice(vocabulary, 150).tolist()
        for changes in (0, 1, 2, 3, 40):
            own = list(words)
            for i in rng.integers(0, 150, changes):
                own[i] = "other"
            docs.append((n, " ".join(own)))
            n += 1
    words = rng.choice(vocabulary, 200).tolist()
    for i in range(150):  # a large group of near copies
        docs.append((n + i, " ".join([*words[:i], f"own{i}", *words[i + 1 :]])))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in docs}
    near = [(a, b) for a in sets for b in sets if a > b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert _grouped(spark.createDataFrame(docs, "doc_id long, text string")) == {i: i for i in sets} | _roots(near)
    kept = similar.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted((r.doc_id, r.text is None) for r in kept.collect() if r.doc_id is not None) == [(1, False), (3, False), (5, False), (6, False), (7, False)]
    assert [r.text for r in kept.where("doc_id is null").collect()] == ["einzeln steht dieser satz hier"]
    assert similar.keep_one(no_docs).count() == 0


def test_similar_by_the_thousand(spark):
    """Copies of one text with none to thirty changed words each, many of them just above or below the threshold, beside texts that hold a part of it."""
    rng = np.random.default_rng(14)
    base, texts = [f"b{x}" for x in rng.integers(0, 1 << 30, 160)], []
    for i in range(2400):
        words = list(base)
        for at in rng.integers(0, 160, rng.integers(0, 31) if i % 3 else rng.integers(2, 5)):
            words[at] = f"n{rng.integers(0, 1 << 30)}"
        if i % 5 == 0:
            words = [*words[: rng.integers(20, 160)], *(f"u{x}" for x in rng.integers(0, 1 << 30, rng.integers(1, 100)))]
        texts.append(" ".join(words))
    sets = similar.shingle_sets(texts)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    where = np.zeros((len(texts), codes.max() + 1), np.float32)
    where[np.repeat(np.arange(len(texts)), [len(x) for x in sets]), codes] = 1
    common, n = where @ where.T, where.sum(axis=1)
    near = np.argwhere(np.tril(common * 5 >= (n[:, None] + n[None] - common) * 4, -1))
    want = dict(enumerate(range(len(texts)))) | _roots([tuple(x) for x in near.tolist()])
    assert len(near) > 50_000 and 100 < len(set(want.values())) < 2000
    got = _grouped(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8))
    assert got == {texts.index(t): want[i] for i, t in enumerate(texts)}


def test_one_of_each_group(spark):
    a, b, c = ("one two three four five six seven eight", "quite another text of eight words stands here", "a third one that is like neither of them")
    rows = [(1, a, 1), (5, a, 2), (5, b, 3), (5, b, 4), (7, b, 5), (None, c, 6), (None, c, 7), (8, c, 8), (None, None, 9), (None, "", 10), (9, f"{c}!", 11), (9, f"{c}!", 11), (-(1 << 62) - 5, "x", 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __gone long").withColumns({x: F.lit("clash") for x in ("__id", "nameless", "named", "h1", "H2", "node", "root")})
    kept = similar.keep_one(df)
    assert kept.columns == df.columns
    got = [r["__gone"] for r in kept.collect()]
    assert len(got) == len(set(got)) == 6 and {1, 8, 11, 12} < set(got) and {3, 4} & set(got) and {9, 10} & set(got)


def _at_threshold(rng, kind, n, name):
    """Two texts of n words and more, whose five-word shingles have a similarity of 0.8 or little more; one contiguous edit apart."""
    words = [f"{name}w{x}" for x in rng.integers(0, 1 << 30, n)]
    shingles = n - 4
    if kind == "cut":
        return words, words[: n - shingles // 5]
    if kind == "added":
        return words, [*words, *(f"{name}n{i}" for i in range(shingles // 4))]
    gone = max(1, shingles // 9 - 4)  # kills gone + 4 shingles within the text
    at = int(rng.integers(5, n - gone - 5))
    return words, [*words[:at], *(f"{name}n{i}" for i in range(gone)), *words[at + gone :]]


def test_similar_at_the_threshold(spark):
    rng, docs = np.random.default_rng(12), []
    for kind, n in [("cut", 300), ("added", 300), ("replaced", 300), ("cut", 24), ("added", 24), ("cut", 9), ("added", 8)]:
        for k in range(60):
            docs += [(kind, n, " ".join(t)) for t in _at_threshold(rng, kind, n, f"{kind}{n}x{k}")]
    for (_, _, a), (_, _, b) in zip(docs[::2], docs[1::2], strict=True):
        s, t = (set(zip(*(x.split()[i:] for i in range(5)), strict=False)) for x in (a, b))
        assert 0.8 * len(s | t) <= len(s & t) < 0.83 * len(s | t)
    got = _grouped(spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(docs)], "doc_id long, text string"))
    assert got == {i: i - i % 2 for i in range(len(docs))}


def test_filters_lose_no_similar_pair():
    """Whatever two sets of similarity 0.8 are, they meet within their first shingles and differ in few parities; fingerprints of long ones are near."""
    rng = np.random.default_rng(2)
    for n in [1, 4, 5, 9, 20, 40, *rng.integers(41, 2000, 300).tolist()]:
        own = [f"w{x}" for x in rng.integers(0, 1 << 40, n + 4)]
        a, b = similar.shingle_sets([" ".join(own), " ".join([*own, *(f"n{i}" for i in range(n // 4))])])
        assert 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
        first = [x[: similar.prefix_length(len(x))] for x in (a, b)]
        assert np.intersect1d(*first).size
        apart = np.bitwise_count(similar.parities(a) ^ similar.parities(b)).sum()
        assert apart * 9 <= len(a) + len(b) and apart <= len(np.setxor1d(a, b))
        if n > similar.SHORT:
            prints = np.stack([similar.fingerprint(a), similar.fingerprint(b)])
            assert np.bitwise_count(prints[0] ^ prints[1]).sum() <= similar.FAR
            assert np.abs(np.diff(similar.distances(prints).astype(int), axis=0)).max() <= similar.FAR


def test_fingerprint_tables_meet_two_bits():
    """Fingerprints that differ in two bits of a word at most share a key of its tables, whatever the other words are."""
    rng = np.random.default_rng(21)
    a = rng.integers(0, 1 << 63, (500, 4), dtype=np.int64).view(np.uint64)
    b = rng.integers(0, 1 << 63, (500, 4), dtype=np.int64).view(np.uint64)
    for i in range(500):
        x, y = rng.integers(0, 64, 2)
        b[i, i % 4] = a[i, i % 4] ^ np.uint64(1 << int(x)) ^ np.uint64(1 << int(y))
    same = similar.table_keys(a) == similar.table_keys(b)
    assert same.shape == (500, 24)
    assert all(same[i, 6 * (i % 4) : 6 * (i % 4) + 6].any() for i in range(500))
    assert same.reshape(500, 4, 6)[np.arange(500), (np.arange(500) + 1) % 4].mean() < 0.01


def test_similar_by_fingerprints_alone(spark, monkeypatch):
    """The pivot tables find near copies by themselves; the exact search after them is for the rest."""
    monkeypatch.setattr(similar, "prefix_length", lambda n: 0)
    rng, docs = np.random.default_rng(22), []
    for g in range(60):
        words = [f"w{x}" for x in rng.integers(0, 1 << 30, 300)]
        for i in range(3):
            docs.append((3 * g + i, " ".join([*words[: 50 * i], *([f"n{g}x{i}"] if i else []), *words[50 * i + (i > 0) :]])))
    got = _grouped(spark.createDataFrame(docs, "doc_id long, text string"))
    found = sum(got[i] == i - i % 3 for i in got)
    assert found >= 0.95 * len(docs) and all(got[i] // 3 == i // 3 for i in got)


def test_sieve(spark):
    """All numbers that are looked for pass, and hardly any other; none passes an empty one."""
    numbers = spark.range(40_000).select(F.xxhash64("id").alias("x"), "id").repartition(7)
    for wanted in (0, 1, 5000):
        passed = {r.id for r in numbers.where(similar.sieve(numbers.where(f"id < {wanted}").select("x"))(F.col("x"))).select("id").collect()}
        assert set(range(wanted)) <= passed and len(passed) - wanted < 100


def test_whole_texts_are_not_dealt(spark, tmp_path):
    """What the stage deals of texts are those that may be similar, not the table: the shuffled rows that hold a text are few."""
    rng = np.random.default_rng(23)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 1 << 30, 60)) for _ in range(400)]
    docs = spark.createDataFrame([*enumerate(texts), (400, texts[7]), (401, f"{texts[9]} end")], "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = similar.keep_one(docs)
        assert sorted(r.doc_id for r in kept.collect()) == list(range(400))
        plans, most = [kept._jdf.queryExecution().executedPlan()], 0
        while plans:
            p = plans.pop()
            if p.nodeName() == "AdaptiveSparkPlan":
                plans.append(p.executedPlan())
            elif "QueryStage" in p.nodeName():
                plans.append(p.plan())
            else:
                if p.nodeName() == "Exchange" and "text" in p.output().toString():
                    most = max(most, p.metrics().apply("shuffleRecordsWritten").value())
                plans += [p.children().apply(i) for i in range(p.children().size())]
        assert 2 <= most < 40
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lattice_points():
    rng = np.random.default_rng(5)
    near = lattice.minimal_vectors()
    assert len(near) == 240 and np.allclose((near**2).sum(axis=1), 2)
    x = rng.normal(0, 3, (500, 8))
    c = lattice.e8(x)
    assert ((c * 2) % 1 == 0).all() and (c.sum(axis=1) % 2 == 0).all()
    own = ((x - c) ** 2).sum(axis=1)
    assert (own[:, None] <= ((x[:, None] - c[:, None] - near[None]) ** 2).sum(axis=2) + 1e-9).all()


def test_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 64))
    a = np.concatenate([x, x[:100] + 0.25 * rng.normal(size=(100, 64)), np.repeat(x[5:6], 250, 0) + 0.12 * rng.normal(size=(250, 64)), np.repeat(x[7:8], 60, 0) * 2]).astype(np.float32)
    odd = [(None, [1.0] * 64), (9001, None), (9002, []), (9003, [0.0] * 64), (9004, [float("nan")] * 64), (9005, [None] * 64), (9006, [1.0] * 8)]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(a)] + odd
    got = lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit(1))).collect()
    u = a.astype(float) / np.linalg.norm(a.astype(float), axis=1)[:, None]
    c = u @ u.T >= 0.95
    np.fill_diagonal(c, False)
    mine = {r.vec_id: r for r in got if r.vec_id is not None and r.vec_id < 9000}
    assert all(mine[i].n_links <= c[i].sum() for i in mine)
    assert sum(r.n_links for r in mine.values()) >= 0.99 * c.sum()
    want = {i: i for i in mine} | _roots([(int(i), int(j)) for i, j in zip(*np.nonzero(c), strict=True)])
    assert sum(mine[i].component_id == want[i] for i in mine) >= 0.99 * len(mine)
    assert {(r.vec_id, r.n_links, r.kept) for r in got if r.vec_id is None or r.vec_id > 9000} == {(None, 0, None), *((i, 0, True) for i in range(9001, 9007))}
    assert lattice.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_at_the_threshold(spark):
    """Pairs on both sides of the threshold by a hair, in sparse and in full cells: the same cosine decides, and nothing below it links."""
    rng = np.random.default_rng(16)
    def pair(c):
        a, b = rng.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        return a, c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b)
    rows = [v for k in range(150) for v in pair(0.95 + (k % 3 - 1) * 1e-13)]
    base, _ = pair(1.0)
    for _ in range(300):  # a full cell
        away = rng.normal(size=64)
        away -= (base @ away) * base
        rows.append(base + rng.choice([0.01, 0.2, 0.23]) * away / np.linalg.norm(away))
    x = np.array(rows)
    got = {r.vec_id: r for r in lattice.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    u = x / np.abs(x).max(axis=1, keepdims=True)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    c = np.array([lattice._cosine(np.broadcast_to(v, u.shape), u) for v in u]) >= lattice.THRESHOLD
    np.fill_diagonal(c, False)
    n = np.array([got[i].n_links for i in range(len(x))])
    assert (n <= c.sum(axis=1)).all() and n.sum() >= 0.99 * c.sum()


PAGES = [
    (1, "http://a.net/x", "<p>one</p>"), (2, "http://b.org/fr/", "<p>one</p>"), (3, None, "<p>one</p>"), (4, "http://c.com/\n x", ""), (5, "c", None), (6, "http://d.com", "é" * 70_000),
    (6, "http://d.com", "é" * 70_000), (None, "http://e.com", "alone"),
]


def test_archives(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("row", F.lit("clash"))
    uri = shared_dir(spark, "test-wacz")
    files = warc.write(pages, uri)
    got = warc.read(files, uri).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=str) == sorted(
        [(1, 10, "revisit", 3), (2, 10, "revisit", 3), (3, 10, "response", None), (4, 0, "revisit", 5), (5, 0, "response", None), (6, 140_000, "response", None), (6, 140_000, "revisit", 6), (None, 5, "response", None)], key=str
    )
    assert {bytes(r.payload).decode() for r in got if r.record_type == "response"} == {h or "" for _, _, h in PAGES}
    assert all(len(r.payload_digest) == 32 for r in got)
    alone = warc.write(pages, shared_dir(spark, "test-wacz"), min_bytes=1)
    assert alone.selectExpr("sum(n_records) n").first().n == 8
    empty = warc.write(pages.where("false"), uri)
    assert empty.count() == 0 and warc.read(empty, uri).count() == 0


def test_zip64_and_members_without_index(tmp_path):
    data = b"".join(__import__("gzip").compress(warc.record(f"urn:x-page:{i}:{i}", "http://x", b"p%d" % i, "D" * 32, None)) for i in range(5))
    path = tmp_path / "a.wacz"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo(warc.MEMBER), "w", force_zip64=True) as f:
            f.write(data)
    raw = path.read_bytes()
    for big in (False, True):
        if big:  # the same file with a ZIP64 end of central directory
            end = raw.rfind(warc._EOCD)
            count, length, start = struct.unpack("<HII", raw[end + 10 : end + 20])
            wide = warc._EOCD64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, length, start)
            locator = warc._LOCATOR + struct.pack("<IQI", 0, end, 1)
            path.write_bytes(raw[:end] + wide + locator + warc._EOCD + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
        with pa.OSFile(str(path)) as f:
            found = warc.members(f)
            method, at, size = found[warc.MEMBER]
            assert (method, size) == (0, len(data)) and f.read_at(size, at) == data
            parts = list(warc._scan(f, at, size))
            assert len(parts) == 5 and sum(n for _, n in parts) == len(data)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc.MEMBER, data * 50)
    (tmp_path / "b.wacz").write_bytes(packed.getvalue())
    with pa.OSFile(str(tmp_path / "b.wacz")) as f, pytest.raises(ValueError, match="compressed"):
        warc._need_stored(warc.members(f), warc.MEMBER)


def test_url_rules(spark):
    urls = ["http://X.Net/a", "http://example.net/en/1", "https://www.example.com/de/?q", "http://a.org/fr/", "http://a.org/f", "http://net", "nothing", None, "http://notnet/x", "ftp://h:80#/net/"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, "http://q.org/x")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("key", F.lit(1))
    labels = spark.createDataFrame([(None, 1), (1, None), (2, 0)], "doc_id long, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, labels).collect()}
    assert got[0] == ("x.net", "/a", "net/", "block") and got[1][2:] == ("example.net/en/", "allow")
    assert got[2] == ("www.example.com", "/de/", "example.com/de/", "block") and got[3][2:] == ("org/fr/", "allow")
    assert got[4][2:] == (None, "allow") and got[5] == ("net", "", None, "allow") and got[6] == ("", "", None, "allow") == got[7]
    assert got[8][2] is None and got[9][:2] == ("h:80", "") and len(got) == 11
    assert url_rules.judge(pages.where("false"), labels).count() == 0 and url_rules.judge(pages, labels.where("false")).count() == 11


def test_mined_rules(spark):
    """Bad pages share a pair of tokens that good ones have only singly."""
    rows = [(i, f"http://{'win' if i % 2 else 'calm'}.com/{'casino' if i % 3 == 0 else 'news'}/{i}") for i in range(240)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 2 == 1 and i % 3 == 0)) for i, _ in rows if i < 180], "doc_id long, toxic int")
    got = {r.page_id: r.verdict for r in url_rules.judge(pages, labels).collect()}
    assert got == {i: "block" if i % 2 and i % 3 == 0 else "allow" for i, _ in rows}


def test_mined_rules_of_many_tokens(spark):
    """A rule of four tokens, none of three; twenty tokens that always stand together are one to the miner."""
    rows, bad = [], []
    for i in range(480):
        has = [i >> k & 1 for k in range(4)]
        path = "/".join(f"{'yes' if h else 'no'}{'abcd'[k]}" for k, h in enumerate(has))
        rows.append((i, f"http://{'x.' * 3}site.com/{path}/" + "/".join(f"fixed{c}" for c in "abcdefghijklmnopqrst")))
        bad.append((i, int(all(has))))
    rows += [(500, "http://yesa.org/yesb/yesc/yesd"), (501, "http://other.org/yesa/yesb/yesc/yesd"), (502, "http://other.org/yesa/yesb/yesc")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_rules.judge(pages, spark.createDataFrame(bad, "doc_id long, toxic int")).collect()}
    want = {i: "block" if b else "allow" for i, b in bad} | {500: "allow", 501: "block", 502: "allow"}
    assert got == want
