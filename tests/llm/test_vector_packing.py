import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratafold.llm import vector_packing as vp

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_tokenizers_own(model):
    own, rng = vp.ByteTokenizer(PATH), random.Random(1)
    assert own.merger is not None
    some = ["a", "b", "É", "́", "漢", "1", "²", "'", "'s", "'t", " ", "  ", "\n", "\t", "\r\n", "\v", "\f", "\x1c", "\x85", "\xa0", "　", " ", "!", "...", "<|", "|>", "<|endoftext|>", "\x00", "​", "😀", "the", "_", "﻿"]
    for _ in range(150):
        texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 30))) for _ in range(8)] + ["x" * rng.randint(900, 1200), " " * rng.randint(0, 1200)]
        ids, begin = own.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[begin[i] : begin[i + 1]].tolist() == model.encode(t, add_special_tokens=False).ids, t


def test_forgotten_chunks_are_encoded_again(model, monkeypatch):
    monkeypatch.setattr(vp, "REMEMBERED", 40)
    own, rng = vp.ByteTokenizer(PATH), np.random.default_rng(1)
    for _ in range(20):
        texts = [" ".join(f"w{n}o'k{chr(97 + n % 26)}," for n in rng.integers(0, 60, 12)) for _ in range(3)]
        ids, begin = own.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:])] == [model.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("weights", [(1.0, 1e-4, 1e-4), (0.3, 0.9, 0.6), (0.0, 1.0, 1.0)])
def test_the_best_sequence_of_all_with_room_is_chosen(rule, weights):
    rng = np.random.default_rng(3)
    own, open_ = vp.VectorBestFit(64, 5, 2000, rule, weights), []  # open_: [tokens, documents, attention] left
    for size in rng.integers(1, 45, 400).tolist():
        fits = [b for b in open_ if b[0] >= size and b[1] >= 1 and b[2] >= size * size]
        score = (lambda b: sum(w * x * x for w, x in zip(weights, ((b[0] - size) / 64, (b[1] - 1) / 5, (b[2] - size * size) / 2000)))) if rule == "norm" else (lambda b: -sum(w * x for w, x in zip(weights, (size * b[0] / 64**2, b[1] / 25, size * size * b[2] / 2000**2))))
        found = own.choose(size)
        assert (found is None) == (not fits)
        sequence, offset = own.place(size)
        if found:
            state = [found[0], *found[1]]
            assert state in fits and score(state) == pytest.approx(min(map(score, fits)), abs=1e-12) and offset == 64 - found[0]
            open_.remove(state)
        else:
            state = [64, 5, 2000]
        open_.append([state[0] - size, state[1] - 1, state[2] - size * size])


def pieces(rows, capacity=2048, **more):
    return sorted((r.sequence_id, r.offset, r.doc_id, r.piece, r.start, r.length) for r in rows)


def test_pieces_of_the_smallest_tables(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows, sequences = vp.pack(docs).collect(), {}
    got = {(r.doc_id, r.piece): r for r in rows}
    assert len(got) == len(rows)
    want = 0
    for d in docs.collect():
        ids = np.array([*model.encode(d.text, add_special_tokens=False).ids, 0], "<u4")
        many = -(-len(ids) // 2048)
        for p in range(many):
            start = 0 if p == 0 else len(ids) - (many - p) * 2048
            length = len(ids) - (many - 1) * 2048 if p == 0 else 2048
            r = got[d.doc_id, p]
            assert (r.start, r.length, r.ids_crc32) == (start, length, zlib.crc32(ids[start : start + length].tobytes()))
            want += 1
    assert want == len(rows)
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(sequences) <= -(-total // 2048) + 1 + docs.rdd.getNumPartitions()


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds_and_ids_come_back(spark, model, rule):
    texts = ["word " * n for n in (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 300)] * 4
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOCS).coalesce(1)
    rows = vp.pack(docs, capacity=100, documents=3, attention=5000, rule=rule, ids=True).collect()
    by, whole = {}, {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
        whole.setdefault(r.doc_id, []).append(r)
    for parts in by.values():
        assert sum(r.length for r in parts) <= 100 and len(parts) <= 3 and sum(r.length**2 for r in parts) <= 5000
    for i, t in enumerate(texts):
        ids = [x for r in sorted(whole[i], key=lambda r: r.piece) for x in r.ids]
        assert ids == [*model.encode(t, add_special_tokens=False).ids, 0]
        assert all(r.length == len(r.ids) == 70 for r in whole[i] if r.piece)  # 70 * 70 <= 5000


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "word " * 9000), (3, "word " * 9000), (None, "no id"), (5, "nbsp  here<|endoftext|>")]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS).withColumn("length", F.lit("clash")).withColumn("piece", F.lit("clash"))
    got = vp.pack(docs).toPandas()
    assert got.groupby("doc_id", dropna=False).length.sum().tolist()[:3] == [1, 1, 2 * 9002]
    assert (got[got.doc_id == 2].ids_crc32 == zlib.crc32(np.array([0], "<u4").tobytes())).all()
    by = got.sort_values(["sequence_id", "offset"])
    assert ((by.groupby("sequence_id").length.cumsum() - by.length) == by.offset).all()
    assert vp.pack(docs.limit(0)).count() == 0
    for bad in ({"rule": "first"}, {"documents": -1}, {"weights": (1, -1, 1)}):
        with pytest.raises(ValueError):
            vp.pack(docs, **bad)
