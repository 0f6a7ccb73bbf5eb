"""The corpus pipeline against a brute-force version of its stages."""

import collections
import math
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    if not os.path.isdir(SMALL):
        pytest.skip("input tables not available")
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in C.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, docs, SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return spark.read.parquet(f"{SMALL}/documents.parquet"), *out


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_columns_are_kept(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes
        assert not df.where(F.col("n_chars") != F.length("text")).count()


def test_quality_keeps_labelled_good_documents(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    before, after = by_id(stages[0]), by_id(stages[1])
    assert all(after[i] == before[i] for i in after)
    good = [i in after for i, q in labels.items() if q == 1]
    assert np.mean(good) > 0.95


def test_near_duplicates_leave_one_of_each_group(stages):
    before, after = by_id(stages[1]), by_id(stages[2])
    sets = {}
    for i, row in before.items():
        w = row["text"].encode().lower().split()
        n = min(5, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    assert set(after) == {i for i, r in root.items() if i == r}
    assert all(after[i] == before[i] for i in after)


def test_passages_of_earlier_documents_go(stages):
    before, after = by_id(stages[2]), by_id(stages[3])
    seen, want = set(), {}
    for i in sorted(before):
        data = before[i]["text"].encode()
        gone = np.zeros(len(data), bool)
        windows = [data[k : k + 50] for k in range(len(data) - 49)]
        for k, window in enumerate(windows):
            if window in seen:
                gone[k : k + 50] = True
        seen.update(windows)
        head = [k for k, b in enumerate(data) if b & 0xC0 != 0x80] + [len(data)]
        kept = b"".join(data[a:b] for a, b in zip(head, head[1:]) if not gone[a:b].all())
        if kept:
            want[i] = kept.decode()
    assert {i: r["text"] for i, r in after.items()} == want


def test_personal_data_goes_and_the_rest_stays(stages):
    before, after = by_id(stages[3]), by_id(stages[4])
    assert before.keys() == after.keys()
    private = re.compile(r"\w+\.\d+@mail\d+\.example\.com|\+1 \(\d{3}\) 555-\d{4}|(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w.])")
    for i, row in before.items():
        values = private.findall(row["text"])
        assert not [v for v in values if v in after[i]["text"]]
        if not values and not re.search(r"\d|@", row["text"]):
            assert after[i] == row


def test_packing_holds_every_token_once(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    want = collections.Counter()
    for i, row in by_id(stages[4]).items():
        ids = library.encode(row["text"], add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            want[i, piece, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())] += 1
    rows = [tuple(r) for r in stages[5].collect()]
    assert collections.Counter(r[:5] for r in rows) == want
    assert len({r[5] for r in rows}) <= math.ceil(sum(r[3] for r in rows) / 4096) + 1


def test_run_gives_the_last_stage(spark, stages):
    got = C.run(spark, SMALL)
    assert sorted(map(tuple, got.drop("sequence_id", "offset").collect())) == sorted(map(tuple, stages[5].drop("sequence_id", "offset").collect()))


def test_odd_rows_pass_every_stage(spark):
    rows = [(1, "some text " * 30, None, "s", None, "x"), (2, None, "en", None, 0, "x"), (None, "some text " * 30, "en", "s", 3, None), (2, None, "en", None, 0, "x"), (3, "", "en", "s", 0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, piece string")
    for name, stage in C.STAGES[1:]:
        for df in (docs, docs.where("false")):
            out = stage(spark, df, SMALL)
            assert name == "packing" or out.columns == docs.columns
            assert out.count() <= 5
