"""Whitening, token alignment and language identification against brute force; registered queries on odd tables."""

import datetime
import hashlib
import os
import random
from collections import Counter
from decimal import Decimal
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from oreweave.llm import alignment, common, covertree, language, licenses, packing, pseudonyms, queries, whitening  # noqa: F401
from oreweave.llm.common import QUERIES

BYTE_MODEL = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
INF, NAN = float("inf"), float("nan")


# whitening -----------------------------------------------------------------------------------------


def test_scatter_is_exact():
    draw = np.random.default_rng(1)
    for most in (5, 2**17, 2**18, 2**40, 2**63 - 1):
        x = draw.integers(-most, most, (50, 4))
        x[0] = [-(2**63), 2**63 - 1, 0, -1] if most > 2**62 else x[0]
        whole = x.astype(object)
        assert (whitening.scatter(x) == whole.T @ whole).all()
        assert whitening.column_sums(x).tolist() == whole.sum(axis=0).tolist()


def exact_polynomial(matrix):
    """Faddeev-LeVerrier in fractions."""
    n = len(matrix)
    a = [[Fraction(int(v)) for v in row] for row in matrix]
    m, out = [[Fraction(int(i == j)) for j in range(n)] for i in range(n)], [Fraction(1)]
    for k in range(1, n + 1):
        am = [[sum(a[i][l] * m[l][j] for l in range(n)) for j in range(n)] for i in range(n)]
        out.append(-sum(am[i][i] for i in range(n)) / k)
        m = [[am[i][j] + (out[-1] if i == j else 0) for j in range(n)] for i in range(n)]
    return [int(c) for c in reversed(out)]


def test_characteristic_polynomial(spark):
    draw = np.random.default_rng(2)
    cases = [np.zeros((3, 3)), np.eye(4) * 7, np.diag([0, 5, 0, 5, 9]), np.ones((5, 5)), np.array([[4]])]
    for n, rank, most in ((2, 2, 9), (6, 6, 10**6), (7, 3, 50), (9, 9, 3)):
        x = draw.integers(-most, most, (rank, n))
        cases.append(x.T @ x)
    x = np.zeros((6, 6), int)  # blocks: zero pivots on the way to Hessenberg form
    x[:2, :2], x[3:5, 3:5], x[5, 5] = [[2, 1], [1, 2]], [[5, 2], [2, 5]], 3
    for case in [*cases, x]:
        whole = np.array(case.astype(np.int64).tolist(), object)
        assert whitening.characteristic_polynomial(spark, whole) == exact_polynomial(whole.tolist())


def test_roots_with_multiplicity():
    def polynomial(roots):
        out = [1]
        for r in roots:
            out = [a - r * b for a, b in zip([0, *out], [*out, 0])]
        return out

    roots = whitening.RealRoots(polynomial([0, 0, 3, 3, 10**30, 10**30 + 1, 17]))
    found = [roots.largest(k) for k in range(1, 8)]
    assert [(v.to_integral_value(), at, n) for v, at, n in found] == [
        (10**30 + 1, 0, 1), (10**30, 0, 1), (17, 0, 1), (3, 0, 2), (3, 1, 2), (0, 0, 2), (0, 1, 2)]
    two = whitening.RealRoots([-2, 0, 1])  # one root is negative: only the counts above zero are used
    two.positive, two.sum = 1, 2
    assert abs(two.largest(1)[0] - Decimal(2).sqrt()) < Decimal("1e-25")


def whitened_by_hand(rows, k):
    """vec_id, component -> (n, deviation, |whitened|, explained) for one length."""
    fit = sorted({x for _, x in rows})
    n, size = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(size)]
    v = np.array(fit, float) - np.array(s) / n
    values, vectors = np.linalg.eigh(v.T @ v / n)
    out = {}
    for i, x in rows:
        for c in range(min(k, size)):
            e, u = values[::-1][c], vectors[:, ::-1][:, c]
            w = (np.array(x, float) - np.array(s) / n) @ u / e**0.5 if e > 1e-9 else 0.0
            out[i, c + 1] = (n, sum((n * a - b) ** 2 for a, b in zip(x, s)), abs(w), e / values.sum() if values.sum() > 1e-9 else 0.0)
    return out


@pytest.mark.parametrize("size,n", [(8, 60), (3, 40), (12, 6), (5, 1)])
def test_whitening_equals_float_eigenvectors(spark, size, n):
    draw = np.random.default_rng(size)
    scale = np.geomspace(300, 3, size)
    rows = [(i, tuple((draw.normal(0, 1, size) * scale).astype(int).tolist())) for i in range(n)]
    rows += [(100 + i, rows[0][1]) for i in range(20)]  # copies are fitted once
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    fits = whitening.fit_whitening(df, 4)
    got = {(r.vec_id, r.component): r for r in whitening.whitened(df, fits).collect()}
    want = whitened_by_hand(rows, 4)
    assert got.keys() == want.keys()
    for key, (count, deviation, w, explained) in want.items():
        r = got[key]
        assert (r.n, r.deviation) == (count, deviation) and r.identity_error < 1e-9
        assert abs(r.whitened) == pytest.approx(w, abs=1e-7) and r.explained == pytest.approx(explained, abs=1e-9)


def test_whitening_of_equal_eigenvalues(spark):
    rows = [(2 * k + (s > 0), [s * 7 * int(i == k) for i in range(5)]) for k in range(5) for s in (-1, 1)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    fit = whitening.fit_whitening(df, 4)[5]
    assert np.allclose(fit.components.T @ fit.components, np.eye(4), atol=1e-14)
    assert fit.identity_error < 1e-12 and np.allclose(fit.explained, 0.2)


def test_whitening_query_on_odd_vectors(spark, tmp_path):
    rows = [(k, [float((k * j) % 7) / 8 for j in range(1, 6)], k, "x") for k in range(40)]
    rows += [(50, None, 1, "x"), (51, [0.5, None, 0.1, 0.1, 0.1], 1, "x"), (52, [NAN] * 5, 1, "x"), (53, [INF, 0.0, 0.0, 0.0, 0.0], 1, None), (54, [], 1, "x")]
    rows += [(None, rows[3][1], 1, "x"), (3, rows[3][1], 1, "x"), (60, [0.25, 0.5], 2, "x"), (61, [0.75, 0.1], 2, "x"), (62, [-0.0, 0.0], 2, "x")]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, component string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op11_whitening"](spark, str(tmp_path)).collect()
    assert Counter(r.vec_id for r in got if r.vec_id is None or r.vec_id >= 40 or r.vec_id == 3) == {None: 4, 3: 8, 60: 2, 61: 2, 62: 2}
    assert {r.n for r in got if r.vec_id is not None and r.vec_id >= 60} == {3} and all(np.isfinite(r.whitened) and r.identity_error < 1e-6 for r in got)
    exact = [tuple(int(np.floor(256 * float(np.float32(v)))) for v in x) for _, x, *_ in rows[:40]]
    want = whitened_by_hand(list(enumerate(exact)), 4)
    assert all((r.n, r.deviation) == want[r.vec_id, r.component][:2] for r in got if r.vec_id is not None and r.vec_id < 40)
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/empty/embeddings.parquet")
    assert QUERIES["op11_whitening"](spark, f"{tmp_path}/empty").count() == 0


# alignment -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(open(BYTE_MODEL, encoding="utf-8").read(), open(PIECE_MODEL, "rb").read())


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    byte = Tokenizer.from_file(BYTE_MODEL)
    byte.encode_special_tokens = True
    return byte, SentencePieceProcessor(model_file=PIECE_MODEL)


def aligned_by_hand(libraries, aligner, text):
    """n_a, n_b, groups as text, links as (a, b) ids, from whole texts and all pairs of a group."""
    if not text:
        return 0, 0, [], []
    a = libraries[0].encode(" " + text, add_special_tokens=False).ids
    b = libraries[1].encode(text)
    parts_a, parts_b, data = [aligner.a_bytes[i] for i in a], [aligner.b_bytes[i] for i in b], (" " + text).encode()
    if b"".join(parts_a) != data or b"".join(parts_b) != data:
        return 0, 0, [], []
    ends_a, ends_b = np.cumsum([len(p) for p in parts_a]).tolist(), np.cumsum([len(p) for p in parts_b]).tolist()
    place_a, place_b = {e: k for k, e in enumerate(ends_a)}, {e: k for k, e in enumerate(ends_b)}
    found, links, i, j = [], [], 0, 0
    for end in sorted(place_a.keys() & place_b.keys()):
        x, y = place_a[end] + 1, place_b[end] + 1
        found.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
        for p in range(i, x):
            for q in range(j, y):
                if max(ends_a[p - 1] if p else 0, ends_b[q - 1] if q else 0) < min(ends_a[p], ends_b[q]):
                    links.append((a[p], b[q]))
        i, j = x, y
    return len(a), len(b), found, links


def test_alignment_of_random_texts(aligner, libraries):
    rng = random.Random(3)
    signs = "abcdefghijklmnop éèüß  \n\t\r\x1c\x85 　's're0189.,!#<|>中文字😀́ABC▁\x00​﻿"
    zeros = 0
    for k in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(60)))
        text = text.replace("b", " the").replace("c", "ing").replace("▁", "x") if k % 3 else text
        if k % 7 == 0:
            text = text.replace("d", "<|endoftext|>").replace("e", "<s>").replace("f", "</s><unk>")
        n_a, n_b, found, links = aligned_by_hand(libraries, aligner, text)
        got = alignment.Aligned(aligner, text)
        assert (got.n_a, got.n_b, got.n_groups) == (n_a, n_b, len(found)), text
        assert got.digest == (hashlib.sha256(";".join(found).encode()).hexdigest() if n_a else "")
        assert sorted(got.links.tolist()) == sorted(a * len(aligner.b_bytes) + b for a, b in links)
        zeros += bool(text) and not n_a
    assert zeros > 100


def test_runs_are_jumped():
    rng = random.Random(5)
    for _ in range(400):
        size = rng.randrange(1, 200)
        a = sorted(rng.sample(range(1, 400), size))
        b = sorted({*(e for e in a if rng.random() < 0.9), *(rng.randrange(1, 400) for _ in range(rng.randrange(5))), a[-1]})
        b = [e for e in b if e <= a[-1]]
        entries, links_a, links_b = alignment.align(a, b)
        groups = []
        for i, end_a, j, end_b in entries:
            groups += [(p, p + 1, q, q + 1) for p, q in zip(range(i, end_a), range(j, end_b))] if i >= 0 else [(~i, end_a, j, end_b)]
        assert [a[g[1] - 1] for g in groups] == [b[g[3] - 1] for g in groups] == sorted(set(a) & set(b))
        span = lambda ends, k: (ends[k - 1] if k else 0, ends[k])
        want = [(p, q) for p in range(len(a)) for q in range(len(b)) if max(span(a, p)[0], span(b, q)[0]) < min(span(a, p)[1], span(b, q)[1])]
        assert list(zip(links_a.tolist(), links_b.tolist())) == want
        if a == b:
            assert len(entries) == 1


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_alignment_query_on_odd_texts(spark, tmp_path, aligner, libraries, monkeypatch, block_bytes):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block_bytes)
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeé ") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    texts = [None, "", " ", "  two  blanks ", "▁", "a▁b", "x" * 20_000, "é😀" * 3000, "same text", "same text", "\x00\n\t"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 200))) for _ in range(40)]
    texts += [" ".join(rng.choice(words) for _ in range(60_000))]
    rows = [(k if k % 5 else None if k == 10 else k, t, "de", "clash") for k, t in enumerate(texts)] + [(8, "same text", "de", "clash")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, block string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    by_hand = [(i, *aligned_by_hand(libraries, aligner, t)) for i, t, *_ in rows]
    count = Counter(pair for *_, links in by_hand for pair in links)
    most = Counter()
    for (a, b), n in count.items():
        most[b] = max(most[b], n)
    want = [
        (i, n_a, n_b, len(found), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links),
         hashlib.sha256(";".join(found).encode()).hexdigest() if n_a else "")
        for i, n_a, n_b, found, links in by_hand
    ]
    got = [tuple(r) for r in QUERIES["op12_token_alignment"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_alignment_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignment(none, BYTE_MODEL, PIECE_MODEL).count() == 0
    bare = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, alignment.alignment(bare, BYTE_MODEL, PIECE_MODEL).collect())) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


# languages -----------------------------------------------------------------------------------------


def bayes_by_hand(learned, text):
    """Language and log odds with plain dictionaries over the same buckets."""
    table = language.letter_table()

    def buckets(t):
        codes = language.letters(table, t)
        return None if codes is None else Counter(language.grams(codes, len(codes)).tolist())

    counts, texts = {}, Counter()
    for lang, t in learned:
        found = buckets(t)
        if lang is not None and found:
            counts.setdefault(lang, Counter()).update(found)
            texts[lang] += 1
    asked = buckets(text)
    if asked is None or not counts:
        return "und", 0.0
    total = sum(texts.values())
    score = {}
    for lang in sorted(counts):
        size = sum(counts[lang].values()) + language.SMOOTH * language.BUCKETS
        score[lang] = np.log(texts[lang] / total) + sum(n * np.log((counts[lang][b] + language.SMOOTH) / size) for b, n in asked.items())
    best = max(score, key=lambda k: (score[k], [-ord(c) for c in k]))
    return best, float(1 / sum(np.exp(v - score[best]) for v in score.values()))


def test_letters_and_grams():
    table = language.letter_table()
    text = lambda t: "".join(map(chr, language.letters(table, t)))
    assert text("  Ab,,c9 É\n") == " ab c é "
    assert [language.letters(table, t) for t in (None, "", "12 \n!", "́")] == [None] * 4
    codes = language.letters(table, "abcdefgh" * 9)
    whole = language.grams(codes, len(codes))
    assert len(whole) == sum(len(codes) - n for n in range(4))
    cut = [language.grams(codes[at : at + 13], 10) for at in range(0, len(codes), 10)]
    assert sorted(np.concatenate(cut).tolist()) == sorted(whole.tolist())


@pytest.mark.parametrize("piece", [1 << 18, 50])
def test_language_query_equals_plain_bayes(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(language, "SLICE", piece)
    monkeypatch.setattr(language, "CELLS", 4 * piece)
    rng = random.Random(11)
    sounds = {"aa": "abc de", "bb": "cde fg", "cc": "xyz ab", None: "abcdef "}
    rows = [(k, "".join(rng.choice(sounds[lang]) for _ in range(rng.randrange(1, 60))), lang, None) for k, lang in enumerate([*sounds] * 25)]
    rows += [(200, None, "aa", "s"), (201, "", "bb", "s"), (202, "12,3", "cc", "s"), (203, "12,3", "dd", "s"), (None, "abc", "aa", "s"), (204, "ÀB ж 中", None, "s"), (7, rows[7][1], "aa", "s")]
    rows += [(205, "fg edc " * 4000, None, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    import zlib

    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 0
    learned = [(lang, t) for i, t, lang, _ in rows if not held(i)]
    got = sorted(map(tuple, QUERIES["op13_language_id"](spark, str(tmp_path)).collect()), key=str)
    want = sorted(((i, held(i), *bayes_by_hand(learned, t)) for i, t, *_ in rows), key=str)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=2e-3)


def test_language_without_anything(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language.learn(none)
    assert language.predict(none, model).count() == 0
    some = spark.createDataFrame([(1, "words"), (2, None)], "doc_id long, text string")
    assert {tuple(r.language) for r in language.predict(some, model).collect()} == {("und", 0.0)}


def test_language_accuracy_on_held_out_documents(spark, small_dir):
    found = QUERIES["op13_language_id"](spark, small_dir).where("held_out")
    truth = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "lang")
    assert found.join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


# registered queries and stages on tables with odd rows and columns named like helpers ---------------

CLASHING = "_found string, _gaps string, _pairs string, _score double, _first int, _row int, _packer int, rest string, at timestamp, price decimal(9,2)"
WHEN = datetime.datetime(2024, 1, 2, 3, 4, 1, 123456)


def clashing(spark, rows):
    extra = ("f", "g", "p", 0.5, 1, 2, 3, "r", WHEN, Decimal("12.30"))
    kinds = "doc_id long, text string, lang string, source string, n_chars long, "
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *extra) for i, t in rows], kinds + CLASHING)


def test_every_stage_keeps_clashing_columns(spark, tmp_path):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(words) for _ in range(40))) for k in range(8)]
    rows += [(1, rows[1][1]), (2, "other words under the same number 4111 1111 1111 1111"), (None, "no number"), (None, None), (20, None), (21, "")]
    docs = clashing(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1) for k in range(8)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, docs.where("false")):
            out = stage(spark, df, str(tmp_path))
            if name != "packing":
                assert out.dtypes == docs.dtypes, name
                others = out.select("_found", "_gaps", "_pairs", "_score", "_first", "_row", "_packer", "rest", "at", "price").distinct().collect()
                assert all(tuple(r) == ("f", "g", "p", 0.5, 1, 2, 3, "r", WHEN, Decimal("12.30")) for r in others), name
            assert out.count() <= len(rows)
    kept = corpus_pipeline.near_dups(spark, docs, str(tmp_path)).select("doc_id", "text").collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter({*rows})


def test_packing_with_clashing_columns(spark):
    df = spark.createDataFrame([(k, 1 + k % 7, "a", "b") for k in range(50)], "k int, length long, _row string, _packer string")
    out = packing.best_fit(df, 10, 4, 8)
    assert out.columns == [*df.columns, "sequence_id", "offset"] and {(r._row, r._packer) for r in out.collect()} == {("a", "b")}


def test_top_k_query_leaves_out_non_finite_vectors(spark, tmp_path):
    rows = [(k, [k / 10, 1 - k / 10]) for k in range(12)] + [(100, [0.5, 0.5]), (150, [NAN, 1.0]), (13, [INF, 1.0]), (14, [-INF, 0.0]), (15, [1.0, None]), (16, None), (17, [])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op4_exact_top_k"](spark, str(tmp_path)).collect()
    assert {r.query_id for r in got} == {0, 100} and not {r.vec_id for r in got} & {150, 13, 14, 15, 16, 17}
    floors = {i: [int(np.floor(256 * float(np.float32(v)))) for v in x] for i, x in rows[:13]}
    for q in (0, 100):
        want = sorted((-sum(a * b for a, b in zip(floors[q], x)), i) for i, x in floors.items() if i != q)[:5]
        assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == want


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2)], "_A int, b int")
    assert common.free_names(df, "_a", "_a", "B", "c") == ["_a_", "_a__", "B_", "c"]


# entire licence texts -------------------------------------------------------------------------------


def test_entire_licences(spark):
    mit, bsd = licenses._MIT_GRANT, licenses._BSD_HEAD + "\n\n" + licenses._BSD_TAIL
    texts = [
        f"MIT License\n\nCopyright (c) 2022 A. Author, Inc.\n\n{mit}\n", f"intro\n\n{bsd.split(chr(10) + chr(10))[0]}", "# SPDX-License-Identifier: BSD-3-Clause\ncode()",
        "Copyright 2020 X. Released under the MIT License.", f"© 2011 Foo. All rights reserved.\n\n{bsd.replace(' and ', '  and' + chr(10))}", "copyright notice, this list",
        "// Copyright (C) 2020 Y\n// Licensed under the Apache License, Version 2.0.\n\nint x;", f"{mit} and more", "Copyright 2020 X",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {tuple(r) for r in licenses.scan_known(df, licenses.built_in(spark)).collect()}
    assert got == {
        (0, "text", 1, "MIT"), (2, "line", 1, "BSD-3-Clause"), (3, "text", 1, "MIT"), (3, "paragraph", 1, "MIT"), (3, "line", 1, "MIT"),
        (4, "text", 1, "BSD-2-Clause"), (6, "line", 2, "Apache-2.0"), (6, "paragraph", 1, "Apache-2.0"),
    }


def test_licences_of_a_folder(spark, tmp_path):
    for name, text in (("Own-1.0.txt", "Own licence\n\nall of it"), ("Other", "Another text.")):
        (tmp_path / name).write_text(text)
    docs = spark.createDataFrame([(1, "OWN license -- all of it"), (2, "x\nanother TEXT")], "doc_id long, text string")
    got = {tuple(r) for r in licenses.scan(docs, licenses.text_folder(spark, str(tmp_path))).collect()}
    assert got == {(1, "text", 1, "Own-1.0"), (1, "paragraph", 1, "Own-1.0"), (1, "line", 1, "Own-1.0"), (2, "line", 2, "Other")}


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts on this machine")
def test_digests_of_long_licences(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "LGPL-2.1": "LGPL-2.1"}
    rows = [(k, open(f"/usr/share/common-licenses/{f}", encoding="utf-8").read(), licence) for k, (f, licence) in enumerate(names.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, want string")
    got = {(r.doc_id, r.licence) for r in licenses.scan_known(docs, licenses.built_in(spark)).where("unit = 'text'").collect()}
    assert got == {(k, want) for k, _, want in rows}
