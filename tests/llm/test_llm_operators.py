"""Operators of the training-data subpackage against brute force, and on odd rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from oreweave.llm import bpe, covertree, licenses, lm, minhash, multiindex, packing, pseudonyms, quality, repeats, suffixes
from oreweave.llm.components import components

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, piece string, component_id string"


def words_of(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows(seed=0):
    """Nulls, empty, blank and very long texts, repeated rows, copies, columns with clashing names."""
    rng = random.Random(seed)
    base = words_of(rng, 200)
    edited = " ".join(w if k % 40 else "changed" for k, w in enumerate(base.split()))
    rows = [
        (0, base), (1, base), (2, edited), (2, edited), (3, None), (4, ""), (5, " \n\t"), (6, "one"), (7, "One"),
        (None, base), (None, None), (8, words_of(rng, 6000)), (9, "x" * 30_000), (10, "é😀" * 4000), (11, "two words"),
        (2**60 + 1, base + " tail"),
    ]
    rows += [(20 + k, words_of(rng, rng.randrange(1, 120))) for k in range(25)]
    rows += [(60 + k, words_of(rng, 30) + " " + base[100:400] + " " + words_of(rng, 30)) for k in range(5)]
    return [(i, t, None if k % 3 else "en", "clash", None) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def sets_of(rows, width):
    out = {}
    for i, text, *_ in rows:
        w = text.encode().lower().split() if text else []
        n = min(width, len(w))
        out[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset()
    return out


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# byte-level encoding --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = bpe.load_ranks(open(BYTE_RANKS, "rb").read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer_equals_library(library):
    encoder = bpe.Encoder(bpe.load_ranks(open(BYTE_RANKS, "rb").read()), public_tokenizers.PATTERN)
    rng = random.Random(1)
    signs = "abcdefghijklmnop éèüß  \n\t\r\x1c\x85　　'st're0189.,!#<|>中文字😀́ABC"
    for k in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(60)))
        text = text.replace("b", " the").replace("c", "ing") if k % 3 else text
        assert encoder.encode(text) == library.encode_ordinary(text)
    for text in ("a" * 5000, " " * 300 + "x", "ab" * 3000, "=-" * 700, "é" * 2500, ""):
        assert encoder.encode(text) == library.encode_ordinary(text)


def test_transducer_with_toy_merges():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cab": 259, b"aa": 260, b"aaa": 261}
    t = bpe.MergeTransducer(ranks)
    rng = random.Random(2)
    for _ in range(3000):
        piece = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 14)))
        assert list(t.encode(piece)) == [ranks[p] for p in t.merged(piece)]


@pytest.mark.parametrize("step", [1, 2, 3, 1000])
def test_stream_decoder_cuts_between_characters(library, step):
    text = "naïve 😀😀 中文 résumé \x00" * 20
    ids = library.encode_ordinary(text)
    decoder = bpe.StreamDecoder({i: t for t, i in bpe.load_ranks(open(BYTE_RANKS, "rb").read()).items()})
    parts = [decoder.feed(ids[k : k + step]) for k in range(0, len(ids), step)]
    for part in parts:
        part.decode()
    assert b"".join(parts) + decoder.close() == text.encode()


def test_round_trip_on_odd_rows(odd, empty, library):
    got = [tuple(r) for r in bpe.round_trip(odd, BYTE_RANKS, public_tokenizers.PATTERN).collect()]
    want = []
    for i, text, *_ in odd_rows():
        ids = library.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe.round_trip(empty, BYTE_RANKS, public_tokenizers.PATTERN).count() == 0


def test_encode_and_decode_columns(odd):
    out = bpe.encode(odd, BYTE_RANKS, public_tokenizers.PATTERN, into="piece")
    back = bpe.decode(out, BYTE_RANKS, ids="piece", into="again").select("text", "again").collect()
    assert all(r.again == (r.text or "") for r in back)


# packing ---------------------------------------------------------------------------------------


def test_word_ids_equal_library():
    from tokenizers import Tokenizer

    model = open(WORD_MODEL, encoding="utf-8").read()
    library, ids = Tokenizer.from_str(model), packing.WordIds(model)
    library.encode_special_tokens = True
    rng = random.Random(3)
    signs = "abcdefg  '\n\t\x1c\x85　éÉßΣİﬁ́012.,!<|>中😀ABCst"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(50))) for _ in range(1500)] + ["<|endoftext|> don't we'LL"]
    for text in texts:
        assert np.frombuffer(ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_packing_is_whole_gapless_and_tight(odd, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_MODEL)
    library.encode_special_tokens = True
    got = packing.pack_documents(odd, WORD_MODEL, size=256, packer_sequences=64).collect()
    docs = collections.Counter()
    for i, text, *_ in odd_rows():
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            docs[i, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter(tuple(r)[:5] for r in got) == docs
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == np.cumsum([0, *[n for _, n in held]])[:-1].tolist()
        assert sum(n for _, n in held) <= 256
    least = math.ceil(sum(r.length for r in got) / 256)
    assert len(bins) <= least + math.ceil(least / 64)  # each packer may leave one bin open
    assert packing.pack_documents(empty, WORD_MODEL).count() == 0


def test_added_tokens_in_texts_have_their_ids(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_MODEL)
    texts = ["end <|endoftext|> start", "<|startoftext|>", "a<|endoftext|><|endoftext|>É b", "<|EndOfText|> <|endoftext|", "plain é", None]
    got = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), WORD_MODEL, with_ids=True).collect()
    assert 49407 in next(r.ids for r in got if r.doc_id == 0)
    for r in got:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [1]
        assert (r.ids, r.length, r.ids_crc32) == (ids, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_fullest_bin_closes_first():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (7, 5, 6)] == [(0, 0), (1, 0), (2, 0)]  # bin 0 had least space left
    assert bins.place(3) == (2, 6) and bins.place(5) == (1, 5) and bins.place(3) == (3, 0)


def test_the_bound_of_open_bins_acts_and_costs_little():
    rng = random.Random(5)
    lengths = [4096 if rng.random() < 0.05 else min(4096, 1 + int(rng.lognormvariate(6, 1.2))) for _ in range(12_000)]
    bins, fill = packing.OpenBins(4096, packing.OPEN_BINS), collections.Counter()
    for need in lengths:
        found, offset = bins.place(need)
        assert offset == fill[found]
        fill[found] += need
        assert bins.open <= packing.OPEN_BINS
    assert bins.closed > 0 and max(fill.values()) <= 4096 and bins.made == len(fill)
    assert bins.made <= 1.02 * math.ceil(sum(lengths) / 4096)


# near duplicates -------------------------------------------------------------------------------


@pytest.mark.parametrize(("width", "percent", "block"), [(3, 85, 192), (5, 80, 4)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, width, percent, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(7)
    rows = odd_rows()
    base = words_of(rng, 150, 5000).split()
    for k in range(40):  # a group in which only some pairs link
        text = list(base)
        for place in rng.sample(range(150), rng.randrange(0, 12)):
            text[place] = f"e{rng.randrange(10**6)}"
        rows.append((200 + k, " ".join(text), None, None, None))
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(4), width, percent).collect()
    sets = sets_of([r for r in rows if r[0] is not None], width)
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[b]
    ]
    root = roots(sets, links)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert (r.component_id, r.kept) == (None, True)
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root[r.doc_id], root[r.doc_id] == r.doc_id)


def test_near_duplicates_of_nothing(empty):
    assert minhash.near_duplicates(empty, 3, 85).count() == 0


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, 600).astype(np.uint64)
    b = np.r_[a[:450], rng.integers(0, 2**63, 150).astype(np.uint64)]
    sets = [np.unique(a), np.unique(b), a[:1], a[:0]]
    signs = minhash.super_minhash(sets, 200)
    assert abs((signs[0] == signs[1]).mean() - 450 / 750) < 0.1
    assert sorted(np.floor(signs[2]).tolist()) == list(range(200)) and np.isinf(signs[3]).all()


def test_components_of_paths_stars_and_rings(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 240)] + [(300, 301), (301, 302), (302, 300), (5, 5)]
    rng = random.Random(5)
    links += [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(70)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links for n in (a, b) if a != b}
    want = roots(nodes, [(a, b) for a, b in links if a != b])
    assert got == want


# repeated passages -------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(12))
def test_suffix_array_and_prefixes(seed):
    rng = random.Random(seed)
    text = bytes(rng.choice(b"ab " if seed % 2 else b"abcdefgh \xff") for _ in range(rng.randrange(1, 500)))
    if seed % 4 == 0:
        text += b"ab" * 70 + b"aaaa" * 40 + b"\xff" + b"ab" * 30 + b"\xff\xff"
    data = np.frombuffer(text, np.uint8)
    words = suffixes.words_at(data, ">")
    order = suffixes.suffix_array(data, words)
    keys = [(text[i:] + b"\xff" * suffixes.DEPTH)[: suffixes.DEPTH] for i in order.tolist()]
    assert sorted(order.tolist()) == list(range(len(text))) and keys == sorted(keys)
    same = [next((k for k in range(suffixes.DEPTH) if a[k] != b[k]), suffixes.DEPTH) for a, b in zip(keys, keys[1:])]
    assert suffixes.common_prefixes(order, words).tolist() == same


def removed_by_brute_force(rows):
    starts = {}
    for i, text, *_ in rows:
        data = (text or "").encode()
        order = math.inf if i is None else i
        for k in range(len(data) - 49):
            starts[data[k : k + 50]] = min(order, starts.get(data[k : k + 50], math.inf))
    out = []
    for i, text, *_ in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - 49):
            if starts[data[k : k + 50]] < (math.inf if i is None else i):
                gone[k : k + 50] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("block", [4 << 20, 20_000])
def test_removal_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block)
    rng = random.Random(11)
    rows = odd_rows(1)
    shared = [words_of(rng, 40, 10**6) for _ in range(6)]
    for k in range(60):
        parts = [words_of(rng, rng.randrange(0, 60), 10**6), rng.choice(shared)[rng.randrange(60) :], words_of(rng, 20, 10**6)]
        rows.append((100 + k * 7 % 60, " ".join(parts), None, None, None))
    rows += [(500, "ab" * 400, None, None, None), (499, "ba" * 300 + "z", None, None, None)]
    got = repeats.removal_digests(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(removed_by_brute_force(rows), key=str)


def test_hot_keys_meet_in_parts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 10_000)
    monkeypatch.setattr(repeats, "HOT_SEGMENTS", 50, raising=False)
    rng = random.Random(19)
    line = "permission is granted to all of them all"  # shorter than a window, in every document
    ends = [words_of(rng, 12, 10**6) for _ in range(40)]
    rows = [(k * 7 % 301, f"{rng.choice(ends)} {line} {rng.choice(ends)}") for k in range(300)]
    rows += [(1000 + k, f"{words_of(rng, 12, 10**6)} {line} {rng.choice(ends)}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = repeats.removal_digests(docs).collect()
    assert sorted(map(tuple, got)) == sorted(removed_by_brute_force(rows))
    buckets = -(-repeats.text_bytes(docs) // repeats.BLOCK_BYTES)
    table = repeats.stored(repeats.blocks(docs))
    states = repeats.stored(repeats._met_keys(repeats._keys(table, buckets)))
    texts = repeats._open_texts(repeats._with_replies(table.select("block", "ids", "sizes", "data"), states, "states"), buckets).collect()
    together = collections.Counter()
    for r in texts:
        if len(r["count"]):
            together[r.bucket] += len(repeats.unpack(r["count"], np.uint8))
    assert max(r.bucket for r in texts) >= buckets and max(together.values(), default=0) < 300


def test_cut_texts_keep_columns_and_characters(spark, odd, empty):
    out = repeats.without_repeats(odd)
    assert out.columns == odd.columns and out.dtypes == odd.dtypes
    rows = {r.doc_id: r for r in out.where("doc_id is not null").collect()}
    assert rows[0].text == odd_rows()[0][1] and rows[1].text == "" and rows[1].piece == "clash"
    assert out.count() == len(odd_rows()) and repeats.without_repeats(empty).count() == 0
    pair = spark.createDataFrame([(1, "é" * 40 + "x" * 60), (2, "zé" * 3 + "é" * 40 + "x" * 60)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in repeats.without_repeats(pair).collect()}[2].startswith("zézé")


# vectors -----------------------------------------------------------------------------------------


def vector_rows(seed=0, n=400, size=16):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, size))
    for k in range(0, 120, 3):
        points[k + 1] = points[k] + rng.normal(size=size) * 0.03
        points[k + 2] = points[k] + rng.normal(size=size) * 0.09
    rows = [(k, [float(np.float32(x)) for x in p], int(k % 4 if k >= 120 else 1)) for k, p in enumerate(points)]
    rows += [(1000, rows[0][1], 1), (1001, rows[0][1], 1), (1002, rows[0][1], 2), (1002, rows[5][1], 2), (1003, rows[9][1], None)]
    rows += [(1050, None, 1), (1100, [], 1), (1150, [None] * size, 1), (1200, [float("nan")] * size, 1), (1250, [float("inf")] + [1.0] * (size - 1), 1)]
    rows += [(1300, [0.0] * size, 1), (1350, [1.0, 2.0], 1), (1351, [1.0, 2.1], 1), (None, rows[3][1], 1)]
    return rows


VECTORS = "vec_id long, vector array<double>, label int"


@pytest.mark.parametrize(("block", "leaf"), [(2048, 48), (64, 4)])
def test_top_k_equals_brute_force(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(covertree, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(covertree, "QUERY_BLOCK", 16)
    monkeypatch.setattr(covertree, "LEAF", leaf)
    rows = [(i, v and [None if x is None else math.floor(x * 3) if math.isfinite(x) else x for x in v], s) for i, v, s in vector_rows()]
    rows = [(i, v and [None if x is None else float(x) for x in v], s) for i, v, s in rows]
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = sorted(map(tuple, covertree.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()))
    able = [(i, v) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in able:
        if q % 50 == 0:
            scores = sorted((-int(sum(x * y for x, y in zip(v, w))), i) for i, w in able if i != q and len(w) == len(v))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    assert got == sorted(want)


def test_top_k_of_few_and_huge(spark):
    rows = [(0, [1e6, -3e12]), (1, [2e6, 5e12]), (50, [1.0, 1.0])]
    got = sorted(map(tuple, covertree.top_k(spark.createDataFrame(rows, "vec_id long, vector array<double>"), F.col("vec_id") % 50 == 0, 5).collect()))
    assert got == [(0, 1, 50, 10**6 - 3 * 10**12), (0, 2, 1, -(2**63)), (50, 1, 1, 2 * 10**6 + 5 * 10**12), (50, 2, 0, 10**6 - 3 * 10**12)]
    assert covertree.top_k(spark.createDataFrame([], "vec_id long, vector array<double>"), F.col("vec_id") == 0, 5).count() == 0


@pytest.mark.parametrize("block", [1024, 8])
def test_near_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(multiindex, "BLOCK", block)
    monkeypatch.setattr(multiindex, "CELL", 16)
    rows = vector_rows()
    got = multiindex.near_vectors(spark.createDataFrame(rows, VECTORS).repartition(3), 0.93, target=0.9999).collect()
    able = [
        (k, i, np.array(v), s) for k, (i, v, s) in enumerate(rows)
        if i is not None and s is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    links, counts = [], collections.Counter()
    for k, i, v, s in able:
        for m, j, w, t in able:
            if k < m and s == t and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                links.append((i, j))
                counts[k] += 1
                counts[m] += 1
    root = roots({i for i, _, _ in rows if i is not None}, links)
    want = collections.Counter((i, counts[k], root.get(i), i is None or root[i] == i) for k, (i, _, _) in enumerate(rows) if i != 1002)
    mine = collections.Counter(tuple(r) for r in got if r.vec_id != 1002)
    found = sum((mine & want).values())
    assert len(got) == len(rows) and found >= 0.97 * sum(want.values())
    assert sum(r.n_links for r in got) >= 0.97 * 2 * len(links)
    over = {(r.vec_id, r.n_links) for r in got if r.vec_id not in (1002, None)}
    assert all(n <= max(c for k, c in ((k, counts[k]) for k, (j, _, _) in enumerate(rows) if j == i)) for i, n in over)
    assert multiindex.near_vectors(spark.createDataFrame([], VECTORS), 0.93).count() == 0


# quality -----------------------------------------------------------------------------------------


def test_quality_learns_noise_and_ignores_nulls(spark, odd):
    rng = random.Random(13)
    rows, labels = [], []
    for k in range(600):
        good = k % 3 > 0
        text = words_of(rng, 60, 3000) if good else "!! ".join(words_of(rng, 60, 3000).upper().split())
        rows.append((k, text))
        labels.append((k, int(good)))
    labels += [(5, None), (None, 1), (7, 1), (7, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    truth = dict(labels[:600])
    model = quality.Model(docs, spark.createDataFrame(labels, "doc_id long, label int"), F.col("doc_id") % 4 != 2)
    scored = {r.doc_id: r.score for r in docs.select("doc_id", model.score(spark).alias("score")).collect()}
    held = [(scored[k], truth[k]) for k in scored if k % 4 == 2]
    assert np.mean([(s >= 0.7) == y for s, y in held]) > 0.95
    out = [r[0] for r in odd.select(model.score(spark)).collect()]
    assert len(out) == len(odd_rows()) and all(0 <= s <= 1 for s in out)


def test_quality_tells_words_of_one_shape_apart(spark):
    import xxhash

    rng = random.Random(17)
    classes = [{}, {}]  # one word for each remainder of the hash by 128: both classes look alike in a table of 128 words
    while min(map(len, classes)) < 128:
        word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
        rest = xxhash.xxh64_intdigest(word.encode()) % 128
        next((c for c in classes if rest not in c), {}).setdefault(rest, word)
    rows = [(k, " ".join(rng.choices(list(classes[k // 2 % 2].values()), k=40))) for k in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, k // 2 % 2) for k in range(800)], "doc_id long, label int")
    model = quality.Model(docs, labels, F.col("doc_id") % 5 != 0)
    held = docs.where("doc_id % 5 = 0").select("doc_id", model.score(spark).alias("score")).collect()
    assert np.mean([(r.score >= 0.5) == (r.doc_id // 2 % 2 == 1) for r in held]) > 0.95


def test_quality_without_labels(spark, empty):
    model = quality.Model(empty, spark.createDataFrame([], "doc_id long, label int"), F.lit(True))
    rows = spark.createDataFrame([("a b",), (None,), ("",)], "text string").select(model.score(spark)).collect()
    assert [r[0] for r in rows] == pytest.approx([0.5] * 3)


# language model ----------------------------------------------------------------------------------


@pytest.mark.parametrize("tokens", [1 << 20, 500])
def test_scores_equal_a_plain_model(spark, monkeypatch, tokens):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", tokens)
    rows = odd_rows(2)
    held = {}
    original = lm.Weights.__init__

    def kept(self, *args, **named):
        original(self, *args, **named)
        held["table"] = self.table

    monkeypatch.setattr(lm.Weights, "__init__", kept)
    part = lm.fold("doc_id", 7)
    got = lm.score(spark.createDataFrame(rows, DOCS).repartition(3), part != 2, part == 6).collect()
    fold = lambda i: 0 if i is None else zlib.crc32(str(i).encode()) % 7
    texts = [(i, (t.encode().lower().split() if t else []) + [None]) for i, t, *_ in rows]
    train = [w for i, w in texts if fold(i) != 2]
    word = collections.Counter(x for w in train for x in w)
    pair = collections.Counter(p for w in train for p in zip([None, *w], w))
    total, distinct = sum(word.values()), len(word)
    want = []
    for i, w in texts:
        base = sum(math.log10((word[x] + 1) / (total + distinct + 1)) for x in w)
        full = 0.0
        for before, x in zip([None, *w], w):
            a, b, c = held["table"][0 if not word[before] else int(math.log2(word[before])) + 1]
            full += math.log10((a * pair[before, x] / word[before] if word[before] else 0) + b * word[x] / total + c / (distinct + 1))
        want.append((i, fold(i) == 2, len(w), sum(word[x] > 0 for x in w), total, round(base, 6), round(full, 6)))
    assert sorted(((*tuple(r)[:5], round(r[5], 6), round(r[6], 6)) for r in got), key=str) == sorted(want, key=str)


def test_expectation_maximisation_finds_the_mixture():
    cells = np.array([[3, 1, 9, 700.0], [3, 0, 5, 200.0], [3, 0, 0, 100.0], [0, 0, 5, 10.0]])
    table = lm.Weights(cells, 1e-3).table
    assert np.allclose(table.sum(axis=1), 1) and table[0, 0] == 0
    assert table[3] == pytest.approx([0.7, 0.2, 0.1], abs=0.1)


def test_scores_of_nothing(empty):
    part = lm.fold("doc_id", 7)
    assert lm.score(empty, part != 2, part == 6).count() == 0


def test_scores_without_training_rows(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = lm.score(df, F.lit(False), F.lit(False)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and math.isfinite(row.score)


# pseudonyms --------------------------------------------------------------------------------------


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms_keep_format_and_links(spark):
    texts = [
        "a 4539 5787 6362 1486 b", "a 4539578763621486.", "a 4539578763621487.", "97.51.17.173 999.1.1.1", "+1 (017) 555-7713", "123-45-6789 666-12-1234",
        "1987-03-05 05.03.1987 03/05/1987 2021-02-30", "DE89 3704 0044 0532 0130 00 DE88370400440532013000", "und.34@mail7.example.com.",
        'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "plain text, 42 of them", None, "", "x" * 50_000 + " 97.51.17.173",
    ]
    df = spark.createDataFrame([(k, t, "n") for k, t in enumerate(texts)], "doc_id long, text string, n string")
    rows = {r.doc_id: r for r in pseudonyms.pseudonymised(df, "key", count="found").collect()}
    spaced, plain = rows[0].text, rows[1].text
    assert spaced[2:21].replace(" ", "") == plain[2:18] != "4539578763621486" and luhn(plain[2:18])
    assert rows[2].text == texts[2] and rows[2].found == 0
    assert rows[3].text.endswith(" 999.1.1.1") and rows[3].text.split()[0] == rows[13].text.split()[1] != "97.51.17.173"
    assert len(rows[4].text) == 17 and rows[4].text[:4] == "+1 (" and rows[4].text != texts[4]
    assert rows[5].text.split()[1] == "666-12-1234" and rows[5].text[:11] != "123-45-6789"
    iso, dotted, slashed, bad = rows[6].text.split()
    assert iso.split("-") == dotted.split(".")[::-1] and slashed == "/".join((iso[5:7], iso[8:], iso[:4])) and bad == "2021-02-30"
    assert rows[7].found == 1 and rows[7].text.endswith("DE88370400440532013000")
    assert "mail7" not in rows[8].text and "04dbebab" not in rows[9].text and len(rows[9].text) == len(texts[9])
    assert [rows[k].text for k in (10, 11, 12)] == [texts[10], None, ""] and rows[0].n == "n"
    bare = spark.createDataFrame([("no digits but jane.doe@mail.example.org here",)], "text string")
    assert "jane" not in pseudonyms.pseudonymised(bare, "key").first()[0]


def test_numbers_beside_numbers_go(spark):
    es, card, spaced = "ES91 2100 0418 4502 0005 1332", "4111111111111111", "4111 1111 1111 1111"
    cases = [  # text, what must go, what must stay, replaced values
        (f"pay {spaced} 12/27", [spaced], " 12/27", 1), (f"{card} 123", [card], " 123", 1), (f"qty 2 {card}", [card], "qty 2 ", 1),
        ("room 12 4111-1111-1111-1111", ["4111-1111-1111-1111"], "room 12 ", 1), (f"{card} {spaced} 7", [card, spaced], " 7", 2),
        (f"{spaced} 97.51.17.173", [spaced, "97.51.17.173"], "", 2), (f"2 2024-05-05 {card}", ["2024-05-05", card], "2 ", 2),
        (f"+1 (017) 555-7713 {spaced}", ["555-7713", spaced], "+1 (", 2), (f"+49 30 1234 5678 {spaced}", ["1234 5678", spaced], "+49 ", 2),
        (f"7 123-45-6789 {card}", ["123-45-6789", card], "7 ", 2),
        (f"{es} THE", [es], " THE", 1), (f"{es} 2024", [es], " 2024", 1), (f"PL12 {es}", [es], "PL12 ", 1), (f"AB12 {es} {card}", [es, card], "AB12 ", 2),
        ("SE45 5000 0000 0583 9825 7466 2024", ["SE45 5000 0000 0583 9825 7466"], " 2024", 1),
        ("at 2024-05-05T10:30:00Z", ["2024-05-05"], "T10:30:00Z", 1), ("4539 5787 6362 1487", [], "4539 5787 6362 1487", 0),
        ("9" * 40, [], "9" * 40, 0), (f"{'8 ' * 20000}x {card}", [card], "", None),
    ]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pseudonyms.pseudonymised(df, "key", count="n").collect()}
    alone = {v: t for v, t in pseudonyms.pseudonymised(spark.createDataFrame([(v, v) for v in (es, card, spaced)], "v string, text string"), "key").collect()}
    for k, (text, gone, stays, n) in enumerate(cases):
        got = rows[k].text
        assert stays in got and n in (None, rows[k].n), (text[-60:], got[-60:], rows[k].n)
        for value in gone:
            assert value not in got and alone.get(value, "") in got, (text[-60:], got[-60:])


def test_permutations_are_one_to_one(spark):
    df = spark.range(10_000).select(
        pseudonyms.permuted_digits(F.lpad(F.col("id").cast("string"), 4, "0"), "k", "t").alias("digits"),
        F.struct(*pseudonyms.feistel(F.floor(F.col("id") / 73), F.col("id") % 73, F.lit(137), F.lit(73), "k", "t")).alias("pair"),
    )
    assert df.where("length(digits) = 4").select("digits").distinct().count() == 10_000
    assert df.select("pair").distinct().count() == 10_000
    other = spark.range(10).select(pseudonyms.permuted_digits(F.lpad(F.col("id").cast("string"), 4, "0"), "other", "t"))
    assert [r[0] for r in other.collect()] != [r[0] for r in df.where("id < 10").select("digits").collect()]


def test_pseudonyms_plan_has_no_python(odd, empty):
    out = pseudonyms.pseudonymised(odd, "k")
    assert "Python" not in out._jdf.queryExecution().toString() and out.columns == odd.columns
    assert out.count() == len(odd_rows()) and pseudonyms.pseudonymised(empty, "k").count() == 0


# licences ----------------------------------------------------------------------------------------


def test_licences_by_canonical_text(spark, odd, empty):
    notices = spark.createDataFrame(licenses.NOTICES, "licence string, text string")
    texts = [
        "Copyright (c) 2020 A. Author\nlicensed under the APACHE Licence -- v2.0!", "Intro\n\nReleased under the MIT License.\nMore", "MIT License", None, "", "!!\n...",
        "Released under the MIT License. And more",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {tuple(r) for r in licenses.scan(df, notices).collect()}
    assert got == {(0, "text", 1, "Apache-2.0"), (0, "line", 2, "Apache-2.0"), (0, "paragraph", 1, "Apache-2.0"), (1, "line", 3, "MIT")}
    assert licenses.scan(odd, notices).count() == 0 and licenses.scan(empty, notices).count() == 0


def test_memory_of_shared_windows_follows_the_text():
    import tracemalloc

    from oreweave.llm.repeats import WINDOW, shared_windows

    rng = np.random.default_rng(5)
    counts = rng.integers(1, 33, 12_000)
    text = rng.integers(97, 123, int((counts + WINDOW - 1).sum()), dtype=np.uint8).tobytes()
    tracemalloc.start()
    shared_windows(counts, np.arange(len(counts)), text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 * len(text)


def test_a_tokenising_worker_remembers_few_pieces():
    ids_of = packing.WordIds(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    assert ids_of._piece.most <= 200_000 and ids_of._word.most <= 600_000
