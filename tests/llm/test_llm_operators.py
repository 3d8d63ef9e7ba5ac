"""Each training-data operator against brute force, on the driver's smallest tables and on awkward rows."""

import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import regex

from tidewright.llm import common, decontaminate, fingerprint, graph, jaccard_join, line_dedup, packing, pii, quality, registry, substring_dedup, suffix_dedup, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
# columns whose names the operators use inside
CLASH = ("chunk", "bucket", "body", "digest", "vertex", "n", "hash", "key", "doc", "lines", "words", "rank", "kept", "evidence", "codes", "base", "size", "salt", "first_id")


def words(t):
    return WORD.findall(t or "")


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


LONG = prose(99, 30_000, 5_000)
BASE = prose(1, 200)


def _rows():
    near = BASE.split()
    near[50] = near[120] = "changed"
    swapped = "  ".join(x.upper() if i % 7 == 0 else x for i, x in enumerate(BASE.split()))
    run = "x " * 36
    texts = [None, "", " \n\t ", "one", "one two three", "One TWO three", BASE, BASE, " ".join(near), swapped, run, "x " * 35, "y " * 17 + "z " * 60, "q " + "y " * 20 + "z " * 60, LONG, LONG[:60_000] + " tail", "é" * 120, "é" * 120 + "ü", "a" * 500, "a" * 90, "\x1c \x85 \xa0 odd spaces", "line one of eleven words here to be counted as enough\n" + BASE, BASE + "\nline one of eleven words here to be counted as enough\nlast"]
    return [(i, t, "src0" if i % 3 else None, None if i % 5 == 0 else "en") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [*_rows(), (None, BASE, None, None), (None, None, "s", "en"), _rows()[6], _rows()[14]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    for c in CLASH:
        df = df.selectExpr("*", f"'clash' AS {c}")
    return df.repartition(3).cache()


@pytest.fixture(scope="module")
def table(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


# --- 1


def _cut_windows(docs, k):
    seen = Counter(tuple(w[p : p + k]) for _, t in docs for w in [words(t)] for p in range(len(w) - k + 1))
    for i, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - k + 1):
            if seen[tuple(w[p : p + k])] > 1:
                gone[p : p + k] = [True] * k
        yield i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()


def thue_morse(n, a="a", b="b"):
    """Two strings of n symbols that collide in every polynomial hash modulo 2**64 from n = 1024 on."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return [(a, b)[x] for x in bits], [(b, a)[x] for x in bits]


@pytest.mark.parametrize("n", [1024, 2048, 8192])
def test_equal_hashes_mean_equal_contents(spark, n):
    one, two = ("".join(x) for x in thue_morse(n))
    left, right = [prose(k, 34, 9000) for k in (1, 2)]
    texts = [f"{left} {one} {right}", f"{left} {two} {right}", one, two, *(" ".join(x) for x in thue_morse(n, "ab", "ba"))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = list(enumerate(texts))
    for crowded in (None, (1, 0)):
        got = substring_dedup.deduplicate(df, 35, chunks=2, crowded=crowded).collect()
        same([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], _cut_windows(docs, 35))
        got = suffix_dedup.deduplicate(df, chunks=2, crowded=crowded).collect()
        same([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], _cut_bytes(docs, 50))
    got = jaccard_join.join(df, chunks=2).collect()
    same([(r.doc_id, r.n_shingles, r.component_id) for r in got], _components(docs))


@pytest.mark.parametrize(("source", "chunks", "window", "crowded"), [("edge", None, 35, None), ("edge", 4, 5, (2, 0)), ("table", 3, 35, None), ("table", 3, 35, (2, 1))])
def test_substrings(request, source, chunks, window, crowded):
    df = request.getfixturevalue(source)
    got = substring_dedup.deduplicate(df, window, chunks=chunks, crowded=crowded).collect()
    same([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], _cut_windows(pairs_of(df), window))
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_symbols_of_equal_windows_agree():
    rng = np.random.default_rng(5)
    block = rng.integers(0, 4, 60).astype(np.uint64)
    for _ in range(50):
        stream = np.concatenate([rng.integers(0, 4, 30).astype(np.uint64), block, rng.integers(0, 4, 30).astype(np.uint64)])
        mark = np.zeros(len(stream), bool)
        mark[[0, -1]] = True
        name, at, to, left, right, m = substring_dedup.recompress(stream + np.uint64(9), mark)
        inside = {(n, a - 30, b - 30) for n, a, b, x, y in zip(name, at, to, left, right, strict=True) if x >= 30 and y <= 90}
        alone = np.concatenate([[np.uint64(77)], block, [np.uint64(78)]])
        mark = np.zeros(len(alone), bool)
        mark[[0, -1]] = True
        name, at, to, left, right, m = substring_dedup.recompress(alone + np.uint64(9), mark)
        assert inside == {(n, a - 1, b - 1) for n, a, b, x, y in zip(name, at, to, left, right, strict=True) if x >= 1 and y <= 61}


# --- 8


def _cut_bytes(docs, k):
    docs = [(i, (t or "").encode()) for i, t in docs]
    order = lambda i: float("inf") if i is None else i
    least = {}
    for i, b in docs:
        for p in range(len(b) - k + 1):
            s = b[p : p + k]
            least[s] = min(least.get(s, float("inf")), order(i))
    for i, b in docs:
        level = np.zeros(len(b) + 1, int)
        for p in range(len(b) - k + 1):
            if least[b[p : p + k]] < order(i):
                level[p] += 1
                level[p + k] -= 1
        gone = np.cumsum(level)[: len(b)] > 0
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        yield i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()


@pytest.mark.parametrize(("source", "chunks", "crowded", "shard"), [("edge", None, None, 2 << 20), ("edge", 4, (2, 0), 2_000), ("table", 3, None, 50_000), ("table", 3, (2, 1), 3_000)])
def test_suffixes(request, source, chunks, crowded, shard):
    df = request.getfixturevalue(source)
    got = suffix_dedup.deduplicate(df, chunks=chunks, crowded=crowded, sorted_bytes=shard).collect()
    same([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], _cut_bytes(pairs_of(df), 50))
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_suffix_array():
    rng = random.Random(3)
    for _ in range(200):
        b = bytes(rng.choice([0, 97, 98, 255]) for _ in range(rng.randrange(1, 80)))
        order, _ = suffix_dedup.suffix_array(np.frombuffer(b, np.uint8))
        assert order.tolist() == sorted(range(len(b)), key=lambda i: b[i:])


def test_kasai_and_merging(monkeypatch):
    rng = random.Random(4)
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    for lanes in (1, 7, 4096):
        monkeypatch.setattr(suffix_dedup, "LANES", lanes)
        for n in (1, 2, 9, 60, 400):
            b = bytes(rng.choice([0, 97, 98]) for _ in range(n)) + b"ab" * (n % 7)
            data = np.frombuffer(b, np.uint8)
            order, _ = suffix_dedup.suffix_array(data)
            got = suffix_dedup.kasai(data, order, suffix_dedup.words8(data), 12)
            assert got.tolist() == [0] + [min(12, common(b[i:], b[j:])) for i, j in zip(order[:-1].tolist(), order[1:].tolist(), strict=True)]
    # windows of one key over several shards
    for _ in range(30):
        merger, seen, told = suffix_dedup.Merger(10), {}, []
        for shard in range(5):
            data = np.frombuffer(bytes(rng.choice([0, 97]) for _ in range(40)), np.uint8)
            windows = np.arange(31)
            part, owner = np.sort(np.full(31, shard // 3)), np.array([rng.randrange(9) for _ in windows])
            told.append((data, windows, part, merger.add(data, windows, owner, part)))
            for w, o, p in zip(windows, owner, part, strict=True):
                k = (int(p), data[w : w + 10].tobytes())
                seen[k] = min(seen.get(k, 99), int(o))
        least = merger.owners()
        assert all(least[m] == seen[int(p), d[w : w + 10].tobytes()] for d, ws, ps, ms in told for w, p, m in zip(ws, ps, ms, strict=True))


# --- 2


def test_patience():
    a, b = [1, 2, 3, 4, 5, 6], [9, 1, 2, 7, 4, 5, 6]
    assert line_dedup.patience(a, b) == [(0, 1), (1, 2), (3, 4), (4, 5), (5, 6)]
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(12))] for _ in range(2))
        found = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in found) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:], strict=False))
    assert line_dedup.patience(a, a) == [(i, i) for i in range(len(a))]


def _aligned(a, b):
    """Patience alignment by recursion: equal ends, then unique common lines in their longest increasing order."""
    if not a or not b:
        return []
    if a[0][1] == b[0][1]:
        return [(a[0][0], b[0][0]), *_aligned(a[1:], b[1:])]
    if a[-1][1] == b[-1][1]:
        return [*_aligned(a[:-1], b[:-1]), (a[-1][0], b[-1][0])]
    once = lambda xs: {x: k for k, (_, x) in enumerate(xs) if Counter(y for _, y in xs)[x] == 1}
    in_a, in_b = once(a), once(b)
    both = [(in_a[x], in_b[x]) for x in in_a if x in in_b]
    best = []
    for k, (_, y) in enumerate(both):
        before = max((best[j] for j in range(k) if both[j][1] < y), key=len, default=[])
        best.append([*before, both[k]])
    chain = max(best, key=len, default=[])
    if not chain:
        return []
    out, i, j = [], 0, 0
    for x, y in [*chain, (len(a), len(b))]:
        out += _aligned(a[i:x], b[j:y])
        if x < len(a):
            out.append((a[x][0], b[y][0]))
        i, j = x + 1, y + 1
    return out


def _clean(t):
    return [re.sub(r"[\x09-\x0D]", " ", x).strip(" ") for x in (t or "").split("\n")]


def _lost(a, b, least):
    """Lines of b that go, given a."""
    pairs = set(_aligned(list(enumerate(a)), list(enumerate(b))))
    gone, block = set(), []
    for x, y in sorted(pairs):
        if not block or (x - 1, y - 1) != block[-1]:
            block = []
        block.append((x, y))
        if (x + 1, y + 1) not in pairs and sum(len(words(b[j])) for _, j in block) >= least:
            gone.update(j for _, j in block)
    return gone


def _all_pairs(docs, least):
    """Of each distinct document, the lines that go by alignment with every earlier one that shares a line."""
    order = lambda d: (d[0] is None, d[0] or 0)
    clean = {d: _clean(d[1]) for d in {(i, t or "") for i, t in docs}}
    have = {d: {x for x in ls if x} for d, ls in clean.items()}
    return {d: set().union(*(_lost(clean[o], clean[d], least) for o in clean if order(o) < order(d) and have[o] & have[d])) for d in clean}


def check_lines(docs, kept, least):
    """``kept``: text after deletion by (id, text).  Lines go only if an earlier document has them, and nearly all go that alignment
    with any overlapping earlier document deletes (where alignments tie, a line that is left may be another one)."""
    want, clean = _all_pairs(docs, least), {d: _clean(d[1]) for d in {(i, t or "") for i, t in docs}}
    first = {}
    for d in sorted(clean, key=lambda d: (d[0] is None, d[0] or 0)):
        for x in clean[d]:
            first.setdefault(x, d[0])
    asked = caught = 0
    for d, ls in clean.items():
        left = Counter(_clean(kept[d])) if kept[d] is not None and (kept[d] or not d[1]) else Counter()
        gone = Counter(ls) - left
        assert not left - Counter(ls)
        assert all(not x or first[x] != d[0] for x in gone)
        size = lambda c: sum(n * len(words(x)) for x, n in c.items())
        asked += size(Counter(ls[k] for k in want[d]))
        caught += min(size(Counter(ls[k] for k in want[d])), size(gone))
    assert caught >= 0.99 * asked - 20  # a line or two in small tables: ties
    return asked


@pytest.mark.parametrize("least", [1, 10])
def test_recall_of_lines_against_all_overlapping_pairs(spark, least):
    docs = pairs_of(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    rng = random.Random(9)
    pool = [f"line {k} " + prose(k, rng.randrange(1, 14)) for k in range(60)]
    footer = [f"footer {k} of the site that all of them carry along with them" for k in range(5)]
    for k in range(60):
        docs.append((100_000 + k, "\n".join([f"own {k}", *(rng.choice(pool) for _ in range(rng.randrange(12))), *footer[: rng.choice([0, 5])], f"shared by two {k // 2}"])))
    got = line_dedup.deduplicate(spark.createDataFrame(docs, "doc_id long, text string"), least).select("doc_id", "text").collect()
    text = dict(docs)
    assert check_lines(docs, {(r.doc_id, text[r.doc_id]): r.text for r in got}, least) > 4_000


def test_a_shared_footer_goes_whatever_else_is_shared(spark):
    footer = "\n".join(f"footer {k} of the site that all of them carry along with them" for k in range(5))
    texts = [f"own {k}\npair {k // 2} has a line of its own that two of them share and no other\n{footer}" for k in range(20)]
    got = line_dedup.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sum("footer" not in r.text for r in got) == 19


@pytest.mark.parametrize("source", ["edge", "table"])
def test_lines(request, source):
    df = request.getfixturevalue(source)
    got = line_dedup.deduplicate(df.withColumn("was", line_dedup.F.col("text")), min_words=1)
    rows = got.select("doc_id", "was", "text").collect()
    check_lines(pairs_of(df), {(r.doc_id, r.was or ""): r.text or "" for r in rows}, 1)
    assert all((r.was is None) == (r.text is None) for r in rows)
    assert set(df.columns) <= set(got.columns) and got.count() == df.count()
    assert line_dedup.stage(df).columns == df.columns


def test_frequent_lines_have_partners_too(spark):
    common = [f"common line {i} of the corpus that many documents hold word for word" for i in range(3)]
    texts = ["\n".join(common + [f"own {i} a"]) for i in range(12)]
    texts += ["a rare line that this document is the first to hold as far as known\n" + "\n".join(common)]
    texts += ["something else\na rare line that this document is the first to hold as far as known"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.deduplicate(df).collect()}
    assert got[12] == "a rare line that this document is the first to hold as far as known" and got[13] == "something else"


def test_blocks_meet_a_document_that_holds_them(spark):
    a, b, c = "one two three four five six", "seven eight nine", "ten eleven twelve"
    texts = [f"{a}\nx", f"y\n{b}", f"{c}\nz", f"{a}\n\n{b}", f"{b}\n{c}", f"{a}\n\n{b}\n{c}", f"p\n{a}\n\n{b}\n{c}\nq"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.deduplicate(df).collect()}
    assert got == {**dict(enumerate(texts)), 6: "p\nq"}
    rng = random.Random(3)
    for _ in range(300):
        lines = [rng.randrange(4) for _ in range(rng.randrange(14))]
        size = [0 if x == 0 else rng.randrange(1, 6) for x in lines]
        found = line_dedup.spans_of(lines, size, {1, 2}, 8)
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                if all(x < 3 for x in lines[i : j + 1]) and sum(size[i : j + 1]) >= 8:
                    assert all(any(i <= u <= k <= v <= j and sum(size[u : v + 1]) >= 8 for u, v in found) for k in range(i, j + 1) if lines[k])


def test_the_query_deletes_blocks_of_any_size(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet")
    want = {r.doc_id: (r.text or "", r.n_removed) for r in line_dedup.deduplicate(table, min_words=1).collect()}
    got = {r.doc_id: (r.kept_sha256, r.n_removed) for r in line_dedup.op2_line_dedup(spark, small).collect()}
    assert got == {i: (hashlib.sha256(t.encode()).hexdigest(), n) for i, (t, n) in want.items()}
    df = spark.createDataFrame([(1, "a b c\nfirst"), (2, "second\na b c")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.stage(df).collect()} == {1: "a b c\nfirst", 2: "second"}


# --- 3


@pytest.mark.parametrize(("limit", "size"), [(0, 200), (0, 1 << 20), (100, 1000)])
def test_warc(spark, small, limit, size):
    body = "<p>" + "page " * 50
    odd = [(1000, "u\r\nv", body), (1001, None, None), (1002, "u", ""), (1003, "u", body), (None, "u", body), (1004, "u", "é\x1f" + "\x08" * 5), (1005, "u", "WARC/1.1\r\n\r\n")]
    df = spark.read.parquet(f"{small}/pages.parquet").union(spark.createDataFrame(odd, "page_id long, url string, html string"))
    for c in CLASH:
        df = df.selectExpr("*", f"'clash' AS {c}")
    got = warc.round_trip(df, limit, size).collect()
    pages = [(r.page_id, (r.html or "").encode()) for r in df.collect()]
    first = {}
    for i, b in sorted((x for x in pages if x[0] is not None)):
        first.setdefault(b, i)
    want = []
    for i, b in pages:
        lead = first.get(b) if len(b) >= limit else i
        alone = lead is None or lead == i
        want.append((i, len(b), warc.base32_sha1(b), "response" if alone else "revisit", None if alone else lead))
    same([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], want)


def _archive():
    rec = lambda i, body: warc.member(warc.record("response", f"urn:page:{i}", "u", warc.base32_sha1(body), len(body), None, body), 0)
    inner = rec(9, b"inner")  # stored, not compressed: its magic is in plain sight
    deep = rec(8, b"x" * 30 + inner + b"y" * 200 + inner)
    return rec(1, b"x" * 40 + inner + b"y" * 40) + warc.EMPTY + b"junk" + rec(2, b"two") + rec(3, inner + deep + inner) + b"\x1f\x8b\x08 more junk" + rec(4, b"") + rec(5, deep * 3)


@pytest.mark.parametrize("size", [1, 7, 64, 300, 301, 1000, 10**6])
def test_no_range_size_adds_or_loses_a_record(size):
    data = _archive()
    f = io.BytesIO(data)
    spots = [(lo, min(lo + size, len(data))) for lo in range(0, len(data), size)]
    found = [(lo, hi, *warc.survey(f, lo, hi)) for lo, hi in spots]
    told = warc.settle(found, lambda lo, hi: warc.survey(f, lo, hi, chained=True))
    got = [(at, x["warc-record-id"]) for _, hi, lo, chained in told for at, x, _ in warc.read_range(f, lo, hi, chained)]
    want = [(at, x["warc-record-id"]) for at, x, _ in warc.read_range(f, 0, len(data))]
    assert got == want and [x for _, x in want] == [f"<urn:page:{i}>" for i in range(1, 6)]


def test_archives_of_others(spark, tmp_path):
    def rec(head, block, size=None):
        lines = ["WARC/1.0", *head, f"Content-Length: {len(block) if size is None else size}"]
        return warc.member("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    http = b"HTTP/1.1 200 OK\r\n\r\nhello"
    sha = hashlib.sha1(b"hello")
    data = b"".join([
        rec(["WARC-Type: warcinfo"], b"software: x"), rec(["WARC-Type: response"], http), rec(["WARC-Type: response", "WARC-Payload-Digest: md5:0"], http),
        rec(["WARC-Type: response", f"WARC-Payload-Digest: sha1:{sha.hexdigest()}"], http, "many"), rec(["WARC-Type: response", "WARC-Payload-Digest: sha1:" + "A" * 32], http), rec(["WARC-Type: revisit"], b""), rec(["WARC-Type: resource"], b"plain"), rec([], b""),
    ])
    (tmp_path / "a.warc.gz").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(_archive())
    got = sorted(warc.read(spark, str(tmp_path), 90).collect(), key=lambda r: (r.file, r.offset))
    digest = warc.base32_sha1(b"hello")
    assert [(r.record_type, r.payload, r.payload_bytes, r.digest_ok) for r in got if "a.warc" in r.file] == [
        ("warcinfo", b"software: x", 11, None), ("response", b"hello", 5, None), ("response", b"hello", 5, None), ("response", b"hello", 5, True),
        ("response", b"hello", 5, False), ("revisit", None, None, None), ("resource", b"plain", 5, None), ("", b"", 0, None),
    ]
    assert all(r.payload_digest == digest for r in got if r.payload == b"hello")
    assert [r.record_id for r in got if "b.warc" in r.file] == [f"urn:page:{i}" for i in range(1, 6)]


# --- 4


def test_packing(edge, table):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for df in (edge.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), table):
        ids = {i: np.array([*exact.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in pairs_of(df)}
        got = packing.public_pack(df, keep_ids=True).collect()
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in got:
            part = ids[r.doc_id][r.start : r.start + r.length]
            assert (len(part), zlib.crc32(part.tobytes()), len(ids[r.doc_id])) == (r.length, r.ids_crc32, r.doc_tokens) and part.tolist() == r.ids
            pieces[r.doc_id].append((r.start, r.length))
            sequences[r.sequence_id].append((r.offset, r.length))
        gapless = lambda xs: [x[0] for x in sorted(xs)] == [0, *np.cumsum([x[1] for x in sorted(xs)])[:-1]]
        assert pieces.keys() == ids.keys() and all(gapless(v) and sum(n for _, n in v) == len(ids[i]) for i, v in pieces.items())
        sizes = [sum(n for _, n in v) for v in sequences.values()]
        assert all(map(gapless, sequences.values())) and all(n <= 1024 and (n == 1024 or n & (n - 1) == 0) for n in sizes)
    assert packing.public_pack(edge).count() >= edge.count()


def test_ranks_give_the_ids_of_the_tokenizer():
    import public_tokenizers as P

    enc = packing.encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    letters = [chr(i) for i in range(0x250)]
    for c in letters:
        for t in (f"a{c}b", f" {c} {c}{c}1", f"'s{c}'ll {c}\n {c}", f"{c}<|endoftext|>{c}", f"漢{c}"):
            assert enc.ids(t).tolist() == enc.slow.encode(t, add_special_tokens=False).ids


def test_level_minimises_the_sum_of_squares():
    rng = random.Random(4)
    p = packing.Packer(64, 0)
    for _ in range(500):
        size = rng.randrange(1, 64)
        counts = p.count.copy()

        def after(h, counts=counts, size=size):
            c = counts.copy()
            if h:
                c[h] -= 1
            if h + size < 64:
                c[h + size] += 1
            return int((c**2).sum())

        allowed = [0] + [h for h in range(1, 64 - size + 1) if counts[h]]
        assert after(p.level(size)) == min(map(after, allowed))
        p.add(1, np.zeros(size, "<u4"))


# --- 6


def test_fingerprints(edge, table):
    def shingles(t):
        w = words(t)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for df in (edge, table):
        docs = sorted({(i is not None, i or 0, t or "") for i, t in pairs_of(df)})
        got = fingerprint.with_edits(df).collect()
        assert len(got) == df.count()
        by_text = {t: r.fingerprint for r in fingerprint.fingerprints(df).collect() for i, t in [(r.doc_id, None)]}
        del by_text
        if df is table:
            after = {x: docs[k - 1] for k, x in enumerate(docs)}
            text = {i: t for _, i, t in docs}
            errors = []
            for r in got:
                t, following = text[r.doc_id], after[(True, r.doc_id, text[r.doc_id])][2]
                half = len(t) // 2
                changed = t[: len(t) - half] + following[:half]
                assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
                errors += [r.near_edited - like(shingles(t), shingles(changed)), r.near_next - like(shingles(t), shingles(following))]
            assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05
    same_text = defaultdict(set)
    for r in fingerprint.fingerprints(edge).join(edge.select("doc_id", "text"), "doc_id").collect():
        same_text[" ".join(words(r.text))].add(r.fingerprint)
    assert all(len(v) == 1 for v in same_text.values()) and same_text[""] == {""}


def test_codes_by_hand(spark, edge):
    """One permutation, bins, optimal densification and low bits in plain Python; Spark's xxhash64 is the common one, chained."""
    import xxhash

    def chain(*parts):
        seed = 42
        for x in parts:
            seed = xxhash.xxh64(x, seed=seed).intdigest()
        return seed - (1 << 64) if seed >> 63 else seed

    def codes(t):
        w = words(t)
        hashes = {chain(*(x.encode() for x in w[i : i + 5])) for i in range(max(1, len(w) - 4))} if w else set()
        bins = {}
        for h in hashes:
            bins[h >> 57] = min(bins.get(h >> 57, h), h)
        pick = lambda j, b: bins[b] & 255 if b in bins else min((chain(j.to_bytes(4, "little"), k.to_bytes(8, "little", signed=True)) & -256) | (bins[k] & 255) for k in bins) & 255
        return "".join(f"{pick(j, b):02X}" for j, b in enumerate(range(-64, 64))) if bins else ""

    texts = {t or "" for _, t in pairs_of(edge)} | {prose(k, 5 + 3 * k, 10**6) for k in range(60)}
    df = spark.createDataFrame(list(enumerate(sorted(texts))), "doc_id long, text string")
    assert {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(df).collect()} == {i: codes(t) for i, t in enumerate(sorted(texts))}


# --- 7

MAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def _spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    checks = (("email", MAIL, lambda s: True), ("ip", IP, lambda s: all(int(x) <= 255 for x in s.split("."))), ("card", CARD, lambda s: 13 <= len(digits(s)) <= 19 and _luhn(digits(s))), ("phone", PHONE, lambda s: 9 <= len(digits(s)) <= 15))
    return [[f"{k}:{m.start()}:{m.end()}" for m in r.finditer(t or "") if ok(m.group())] for k, r, ok in checks]


def test_base_spans(spark, edge, table):
    hard = ["a@b.c_d@e.f x@y", "é a.b+c@d-e.f.g. z@@q.r", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1.2.3 1.0000000000300.1.1", "4111 1111 1111 1111 4111-1111-1111-1111-1 4111111111111111", "+1 (706) 555-3138 +12 +1--------2 +1234567890123456", "7" * 40, "5500 0000 0000 0004\n378282246310005", "@ . + 1", "😀 a@b.co 😀😀 10.0.0.1\n😀 +1 202 555 0123", "x" * 3000 + "@", "1 " * 2000, "a@b.c@d.e"]
    rng = random.Random(8)
    hard += ["".join(rng.choice("a1 .@+-()0259\n") for _ in range(120)) for _ in range(300)]
    made = spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")
    for df in (made, edge, table):
        got = df.select("text", pii.base_spans(pii.F.coalesce("text", pii.F.lit(""))).alias("spans"))
        got = got.select("text", pii.joined_spans(pii.F.col("spans")).alias("j")).collect()
        for r in got:
            assert r.j == ",".join(x for kind in _spans(r.text) for x in kind), r.text
    assert pii.analyse(edge).count() == edge.count() and pii.sanitise(edge).count() == edge.count()


def _with_terms(texts, threshold):
    """The spans of each text by the same definitions, in plain Python."""
    letters = regex.compile(r"\p{L}{3,}")

    def entities(line):
        return {(x.split(":")[0], line[int(x.split(":")[1]) : int(x.split(":")[2])].lower()) for kind in _spans(line) for x in kind}

    blank = lambda line: MAIL.sub(lambda m: "\x01" * len(m[0]), line)
    said = lambda line: set(letters.findall(blank(line).lower()))
    found = defaultdict(set)
    whole = Counter(texts)
    lines = Counter(x for t in texts for x in t.split("\n"))
    grains = [([(x, n, entities(x), said(x)) for x, n in lines.items()], sum(lines.values()), lambda x: set(letters.findall(x.lower())))]
    grains.append(([(t, n, set().union(*map(entities, t.split("\n"))), set().union(*map(said, t.split("\n")))) for t, n in whole.items()], len(texts), lambda x: set(letters.findall(x.lower()))))
    for contexts, total, plain in grains:
        c_t, c_e, both, different, stood = Counter(), Counter(), Counter(), Counter(), Counter()
        for x, n, es, ws in contexts:
            c_t.update({w: n for w in plain(x)})
            for e in es:
                c_e[e] += n
                stood[e] += 1
                both.update({(e, w): n for w in ws})
                different.update((e, w) for w in ws)
        for (e, w), n in both.items():
            k = different[e, w]
            if k > 1 and stood[e] > 1 and c_e[e] < total and c_t[w] <= c_e[e] * (total / c_e[e]) ** (1 - threshold):
                p = min(1.0, n / c_t[w])
                size, z = k / p, pii.Z
                low = (p + z * z / (2 * size) - z * math.sqrt(max(0.0, p * (1 - p)) / size + z * z / (4 * size * size))) / (1 + z * z / size)
                if 1 + math.log(low) / math.log(total / c_e[e]) >= threshold:
                    found[e].add(w)
    out = []
    for t in texts:
        bad = set().union(*(found[e] for x in t.split("\n") for e in entities(x)))
        spans, at = [x for kind in _spans(t) for x in kind], 0
        for line in t.split("\n"):
            spans += [f"term:{at + m.start()}:{at + m.end()}" for m in letters.finditer(blank(line)) if m[0].lower() in bad]
            at += len(line) + 1
        out.append(",".join(spans))
    return out


def _disclosing():
    near = [f"Write to Zanzibar Quux at zq@example.org about case {i} of the report" for i in range(6)]
    return near, [f"the report of case {i} at hand about things to write" for i in range(400)]


def test_terms_that_disclose(spark):
    near, rest = _disclosing()
    rows = near + rest
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.spans) for r in pii.sanitise(df).collect()}
    assert got[0][0].split() == "Write to at [email] about case 0 of the report".split()
    assert got[0][1] == "email:26:40,term:9:17,term:18:22"
    assert got[50] == (rows[50], "")
    copies = spark.createDataFrame(list(enumerate([near[0]] * 9 + rows[6:])), "doc_id long, text string")
    assert "term" not in "".join(r.spans for r in pii.sanitise(copies).collect())


def test_terms_are_marked_on_every_line_of_the_document(spark):
    near, rest = _disclosing()
    rows = [f"{near[0]}\nthe report\n😀 Quux is at hand", *near[1:], *rest, "Quux without the address"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.text.split("\n") for r in pii.sanitise(df, threshold=0.8).collect()}
    assert [x.split() for x in got[0]] == ["Write to at [email] about case 0 of the report".split(), ["the", "report"], ["😀", "is", "at", "hand"]]
    assert got[406] == ["Quux without the address"]


@pytest.mark.parametrize("threshold", [0.9, 0.6])
def test_terms_by_hand(spark, edge, table, threshold):
    near, rest = _disclosing()
    rng = random.Random(12)
    texts = [t or "" for _, t in pairs_of(edge) + pairs_of(table)] + near + rest[:100]
    people = [(f"p{i}@mail.example", f"+1 202 555 01{i:02}", prose(500 + i, 6, 10**6)) for i in range(8)]
    for k in range(60):
        mail, phone, hints = rng.choice(people)
        some = [mail, phone, *hints.replace("w", "hint").split(), "é😀", "Ünï", *prose(600 + k, 5).split()]
        rng.shuffle(some)
        texts.append("\n".join(" ".join(some[i : i + 5]) for i in range(0, len(some), 5)))
    texts += texts[-9:]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.spans for r in pii.analyse(spark.createDataFrame(rows, "doc_id long, text string"), threshold).select("doc_id", pii.joined_spans(pii.F.concat("base", "terms")).alias("spans")).collect()}
    want = _with_terms(texts, threshold)
    assert got == dict(enumerate(want)) and any("term" in x for x in want)


def test_very_long_lines(spark):
    """5 MB on one line with 100,000 addresses, twice with a different end."""
    import time

    text = " ".join(f"word{i} person{i % 90_000}@mail{i}.example and more" for i in range(100_000))
    df = spark.createDataFrame([(1, text), (2, text + " end"), (3, "short")], "doc_id long, text string").repartition(3)
    began = time.time()
    got = {r.doc_id: (r.b, r.spans) for r in pii.analyse(df).selectExpr("doc_id", "size(base) AS b", "substring(cast(get(base, 99999) AS string), 1, 200) AS spans").collect()}
    assert got[1][0] == got[2][0] == 100_000 and "person9999@mail99999.example" in got[1][1] and got[3][0] == 0
    assert time.time() - began < 60
    [r] = pii.sanitise(df.where("doc_id = 1")).collect()
    assert r.text.count("[email]") == 100_000 and "@" not in r.text and r.text.startswith("word0 [email] and more word1")


# --- 9


def test_benchmark(spark, small, edge, table):
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{small}/benchmark.parquet'")
    want = con.execute(decontaminate.ORACLE["op9_decontaminate"]).fetchall()
    same([tuple(r) for r in decontaminate.contained(table, bench).collect()], want)
    items = spark.createDataFrame([(1, " ".join(BASE.split()[20:60])), (2, None), (3, "one two three"), (4, prose(5, 50)), (5, " ".join([*BASE.split()[20:50], *"nothing of that".split()])), (None, "one two three"), (None, " ".join(BASE.split()[:40])), (3, "one two three")], "item_id long, text string")
    sets = lambda t: {tuple(w[i : i + 5]) for w in [words((t or "").lower())] for i in range(max(1, len(w) - 4)) if w}
    reached = lambda t, u: bool(sets(u)) and 100 * len(sets(t) & sets(u)) >= 80 * len(sets(u))
    asked = set(pairs_of(items.withColumnRenamed("item_id", "doc_id")))
    want = [(i, j, len(sets(t) & sets(u)), len(sets(u))) for i, t in set(pairs_of(edge)) for j, u in asked if reached(t, u)]
    same([(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontaminate.contained(edge, items).collect()], want)
    left = decontaminate.clean(edge, items)
    assert left.columns == edge.columns
    same(pairs_of(left), [(i, t) for i, t in pairs_of(edge) if not any(reached(t, u) for _, u in asked)])
    # of the rows without an id, the one without text stays
    assert [r.text for r in left.where("doc_id IS NULL").collect()] == [None]
    assert decontaminate.clean(edge, items.where("false")).count() == edge.count()


def test_the_sieve_stays_below_the_join(spark, table):
    """Only rows that pass the sieve are shuffled: the optimiser must not move the exact join below it."""
    keys = table.limit(5).selectExpr("xxhash64(doc_id) AS k")
    rows = table.selectExpr("doc_id", "text", "xxhash64(doc_id) AS h")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        passed = common.sifted(rows, "h", keys, "k")
        for made in (passed.join(keys, passed["h"] == keys["k"]), common.without(passed, keys, passed["h"] == keys["k"], "k")):
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert plan.index("SortMergeJoin") < plan.index("BroadcastHashJoin")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_the_sketch_decides_what_is_verified(spark):
    """Candidates are found by the sketch alone, and a sieve loses no row and stays small."""
    item = prose(71, 60, 10_000)
    docs = spark.createDataFrame([(1, prose(72, 300) + " " + item + " " + prose(73, 300)), (2, " ".join(item.split()[:30]) + " " + prose(74, 90)), (3, prose(75, 400))], "doc_id long, text string")
    sought = decontaminate.sketches(decontaminate.keyed(spark.createDataFrame([(7, item)], "item_id long, text string"), "item_id", "text", "item_id", "item"), 80)
    sketch = {r.hash for r in sought.where("in_sketch").collect()}
    assert len(sketch) == 64 - 52 + 1 and sought.count() == 56
    rows = decontaminate.keyed(docs, "doc_id", "text", "doc_id", "doc")
    held = {r.doc: r.doc_id for r in rows.collect()}
    found = {held[r.doc] for r in decontaminate.candidates(rows, sought).collect()}
    have = {r.doc_id for r in rows.select("doc_id", decontaminate.F.explode(decontaminate._set()).alias("h")).collect() if r.h in sketch}
    assert found == have and 1 in found and 3 not in found
    many = spark.range(300_000).selectExpr("xxhash64(id) AS h")
    assert common.sifted(many, "h", many.limit(1000), "h").count() >= 1000
    picked = many.where("h % 7 = 0")
    passed = common.sifted(many, "h", picked, "h")
    assert passed.join(picked, "h").count() == picked.count() and passed.count() < 1.2 * picked.count()
    assert passed.count() + common.sifted(many, "h", picked, "h", among=False).count() == many.count()


# --- 10


def _components(docs, percent=80):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = []
    for _, t in docs:
        w = words(lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            held[x].append(i)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in held[x] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(docs):
        if i is not None:
            ids[find(k)].append(i)
    return [(i, len(sets[k]), i if not sets[k] else min(ids[find(k)], default=None)) for k, (i, _) in enumerate(docs)]


@pytest.fixture(scope="module")
def family(spark):
    """A group of near copies: some link to the original only, some to each other in chains."""
    rng, rows = random.Random(6), []
    for g in range(3):
        original = prose(100 + g, 150, 3_000).split()
        for k in range(40):
            t = list(original)
            for _ in range(rng.randrange(0, 7)):
                t[rng.randrange(len(t))] = f"edit{rng.randrange(10_000)}"
            rows.append((len(rows), " ".join(t[: rng.choice([150, 150, 130])])))
            del k
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize(("source", "rows", "block", "paired", "levels"), [("edge", 256, 128, 2048, 6), ("table", 256, 128, 2048, 6), ("family", 256, 128, 2048, 6), ("family", 4, 7, 2048, 6), ("family", 9, 5, 9, 1), ("edge", 1, 2, 1, 1), ("mixed", 8, 6, 8, 2)])
def test_jaccard(request, monkeypatch, source, rows, block, paired, levels):
    monkeypatch.setattr(jaccard_join, "BLOCK", (block, 20_000))
    monkeypatch.setattr(jaccard_join, "PAIRED", paired)
    monkeypatch.setattr(jaccard_join, "LEVELS", levels)
    df = request.getfixturevalue(source)
    got = jaccard_join.join(df, chunks=3, region_rows=rows).collect()
    same([(r.doc_id, r.n_shingles, r.component_id) for r in got], _components(pairs_of(df)))


@pytest.fixture(scope="module")
def mixed(spark):
    """One region of mostly outsiders: all share rare passages, few are linked, some form clusters of their own."""
    rng, rows = random.Random(16), []
    passages = [prose(300 + i, 40, 5_000) for i in range(3)]
    for g in range(40):
        body = prose(400 + g, rng.choice([12, 90]), 9_000).split()
        for k in range(rng.choice([1, 1, 1, 4])):
            t = list(body)
            if k:
                t[rng.randrange(len(t))] = f"edit{k}"
            rows.append((len(rows), " ".join([passages[g % 3], *t, passages[(g + 1) % 3]])))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_copies_of_an_id_are_told_apart_by_their_texts(spark):
    a, b = prose(31, 80), prose(32, 80)
    rows = [(1, a), (1, b), (1, a), (2, a + " end"), (None, b + " end"), (None, prose(33, 60)), (None, prose(34, 60)), (None, prose(34, 60)), (3, "  "), (3, ""), (3, "")]
    got = jaccard_join.representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    same(pairs_of(got), [(1, a), (1, b), (None, prose(33, 60)), (None, prose(34, 60)), (3, "  "), (3, "")])


def test_one_of_each_component_stays(edge):
    got = jaccard_join.representatives(edge)
    assert got.columns == edge.columns
    docs = pairs_of(edge)
    lead = {(i, c) for i, n, c in _components(docs) if i is not None and i == c}
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == sorted(i for i, _ in lead)
    assert [r.text for r in got.collect() if r.doc_id is None] == [None]


@pytest.mark.parametrize("few", [10_000, 0])
def test_components(spark, few):
    rng = random.Random(21)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    label = {v: v for e in edges if e[0] != e[1] for v in e}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = graph.components(spark.createDataFrame(edges, "a long, b long"), few)
    assert {r.v: r.c for r in got.collect()} == label and got.count() == len(label)
    assert graph.components(spark.createDataFrame([], "a long, b long"), few).count() == 0


def test_join_in_memory_is_exact():
    rng = random.Random(7)
    for percent in (50, 80):
        sets = []
        for _ in range(6):
            core = rng.sample(range(10_000), 60)
            sets += [np.unique(np.array(core[: rng.randrange(40, 60)] + rng.sample(range(10_000), rng.randrange(0, 25)), np.uint64)) for _ in range(30)]
        join = jaccard_join.Join(sets, percent)
        join.run(np.arange(len(sets)))
        plain = jaccard_join.Join(sets, percent)
        for i in range(len(sets)):
            plain.against(i, np.arange(i + 1, len(sets))) if i + 1 < len(sets) else None
        assert join.roots(np.arange(len(sets))).tolist() == plain.roots(np.arange(len(sets))).tolist()


# --- 5


def test_quality(spark, edge):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    half = "pmod(xxhash64(doc_id), 2) = "
    made = quality.classify(docs, quality.fit(docs, labels.where(half + "0"))).join(labels.where(half + "1"), "doc_id").selectExpr("quality = 0 OR toxic = 1 AS bad", "rejected").groupBy("bad", "rejected").count().collect()
    n = {(r.bad, r.rejected): r["count"] for r in made}
    assert n[(True, True)] / (n[(True, True)] + n.get((True, False), 0)) > 0.93
    assert n[(False, False)] / (n[(False, False)] + n.get((False, True), 0)) > 0.99
    model = quality.fit(docs, labels.where("false"))
    told = quality.classify(edge, model).collect()
    assert len(told) == edge.count() and all(r.evidence == 0 for r in told if not words(r.text))
    odd = spark.createDataFrame([(None, 1, 0), (6, None, 0), (7, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.stage(edge, odd).columns == edge.columns


def test_sparse_sites_are_shrunk(spark):
    rows = [(i, "good words in here", "big", "a") for i in range(200)] + [(1000, "good words in here", "tiny", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")

    class Fixed(quality.Model):
        def evidence(self, shapes, hits):
            return np.full(len(shapes), -1.0)

    got = {r.source: r for r in quality.classify(df, Fixed(None, np.zeros(1), np.ones(1), {}, None)).collect()}
    assert abs(got["tiny"].path_posterior - got["big"].host_posterior) < 0.01


def test_posteriors_by_hand(spark):
    """Shrunken sites and posteriors in plain Python, for given evidence."""
    rng = random.Random(3)
    rows = [(i, str(rng.uniform(-4, 4) - 2 * (i % 7 == 0)), rng.choice(["a", "a", "a", "b", "c", None]), rng.choice(["x", "y", None])) for i in range(300)] + [(900, "1.5", "rare", "x"), (901, "-1.5", "rare too", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")

    class Given(quality.Model):
        def evidence(self, shapes, hits):
            return hits

        def hits(self, text):
            return float(text)

    got = {r.doc_id: r for r in quality.classify(df, Given(None, np.zeros(1), np.ones(1), {}, None)).collect()}
    p = {i: 1 / (1 + math.exp(-float(t))) for i, t, _, _ in rows}
    mean = sum(p.values()) / len(p)

    def strength(groups):
        many = [(n, s, q) for n, s, q in groups if n > 1]
        total = sum(n for n, _, _ in many)
        excess = (sum(n * (s / n - q) ** 2 for n, s, q in many) - sum(q * (1 - q) for _, _, q in many)) / total
        return min(1e6, max(1.0, sum(n * q * (1 - q) for n, _, q in many) / total / max(excess, 1e-9)))

    host, path = defaultdict(list), defaultdict(list)
    for i, _, h, q in rows:
        host[h or ""].append(p[i])
        path[h or "", q or ""].append(p[i])
    k = strength([(len(v), sum(v), mean) for v in host.values()])
    shrunk = {h: (sum(v) + k * mean) / (len(v) + k) for h, v in host.items()}
    j = strength([(len(v), sum(v), shrunk[h]) for (h, _), v in path.items()])
    logit = lambda x: math.log(x / (1 - x))
    for i, t, h, q in rows:
        v = path[h or "", q or ""]
        site = min(1 - 1e-6, max(1e-6, (sum(v) - p[i] + j * shrunk[h or ""]) / (len(v) - 1 + j)))
        want = 1 / (1 + math.exp(-(float(t) + logit(site) - logit(mean))))
        assert got[i].posterior == pytest.approx(want) and got[i].host_posterior == pytest.approx(shrunk[h or ""]) and got[i].rejected == (want >= 0.5)


def test_the_sample_of_labels_is_stable(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    one, two = (quality.fit(docs, labels.repartition(n), max_labelled=150) for n in (1, 7))
    assert one.lexicon == two.lexicon and np.allclose(one.junk, two.junk, rtol=1e-6)


# --- all


def test_empty_tables(spark, edge):
    none = edge.where("false")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    made = [substring_dedup.deduplicate(none), line_dedup.deduplicate(none), warc.round_trip(pages), packing.public_pack(none), quality.classify(none, quality.fit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"))), fingerprint.with_edits(none), pii.analyse(none), suffix_dedup.deduplicate(none), decontaminate.contained(none, spark.createDataFrame([], "item_id long, text string")), jaccard_join.join(none)]
    assert [df.count() for df in made] == [0] * len(made)


def test_registry_names_all_ten():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in registry.queries() if n != "pipeline"} == set(range(1, 11))


@pytest.mark.parametrize("name", sorted(n for n in registry.oracle_sql()))
def test_sql(spark, small, name):
    import glob
    import os

    con = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = registry.queries()[name](spark, small)
    cols = ", ".join(df.columns)
    same([tuple(r) for r in df.collect()], con.execute(f"SELECT {cols} FROM ({registry.oracle_sql()[name]})").fetchall())
