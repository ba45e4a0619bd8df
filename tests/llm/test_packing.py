import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratafold.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_ids_are_the_tokenizers_own():
    texts = ["", " \n", "It's THE end. Ünïcode ǅ ß İstanbul", "a\x01b \x01 c", "<|endoftext|> x<|startoftext|>", "word " * 50, "é é ﬁ nbsp", "x" * 5000, "漢字 かな 123 4.5%", "<|ENDOFTEXT|> a x<|StartOfText|>y A", "İs Σας ΣΑΣ क़लम e\u0301t\u0301 don't 'tis rock'n' ok!!! ..a.. <|"]
    own, model = packing.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    for _ in range(2):
        ids, begin = own.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[begin[i] : begin[i + 1]].tolist() == model.encode(t, add_special_tokens=False).ids, t


def test_forgotten_words_are_encoded_again(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED_WORDS", 40)
    own, model = packing.WordTokenizer(PATH), Tokenizer.from_file(PATH)
    rng = np.random.default_rng(1)
    for _ in range(20):
        texts = [" ".join(f"w{n}o'k{chr(97 + n % 26)}, " + "letters" * (n % 3) for n in rng.integers(0, 60, 12)) for _ in range(3)]
        ids, begin = own.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:])] == [model.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(own.known) == len(own.met) == len(own.begin) - 1 <= 40 + 120


@pytest.mark.parametrize("seed", range(5))
def test_each_id_lies_in_one_piece_and_only_powers_of_two_are_short(seed):
    rng = np.random.default_rng(seed)
    out = []
    windows = packing.SumOfSquares(64, out.append)
    docs = {d: rng.integers(0, 999, int(rng.integers(1, 200))).astype(np.uint32) for d in range(int(rng.integers(1, 300)))}
    for d, ids in docs.items():
        windows.add(d, ids)
        if d % 97 == 96:
            windows.settle()
            assert windows.count.sum() <= 1
    windows.close()
    seen = {d: np.zeros(len(v), int) for d, v in docs.items()}
    for parts in out:
        total = sum(len(p[2]) for p in parts)
        assert total == 64 or total & (total - 1) == 0
        for d, start, ids, n in parts:
            assert n == len(docs[d]) and (docs[d][start : start + len(ids)] == ids).all()
            seen[d][start : start + len(ids)] += 1
    assert all((s == 1).all() for s in seen.values())
    assert sum(sum(len(p[2]) for p in parts) < 64 for parts in out) <= 6


def test_the_level_minimises_the_sum_of_squares():
    rng = np.random.default_rng(0)
    w = packing.SumOfSquares(16, lambda parts: None)
    for _ in range(300):
        size = int(rng.integers(1, 16))
        costs = {}
        for h in range(0, 17 - size):
            if h == 0 or w.count[h]:
                n = w.count.copy()
                n[h] -= h > 0
                n[h + size] += h + size < 16
                costs[h] = (n**2).sum()
        level = w.level_for(size)
        assert costs[level] == min(costs.values()) and level == max(h for h in costs if costs[h] == costs[level])
        w.place((0, 0, np.zeros(size, np.uint32), size))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "word " * 9000), (3, "word " * 9000), (None, "no id")]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS).withColumn("length", F.lit("clash"))
    got = packing.pack(docs).toPandas()
    assert got.groupby("doc_id", dropna=False).length.sum().tolist() == [1, 1, 2 * 9001, 3]
    one = got[got.doc_id == 2].iloc[0]
    assert one.ids_crc32 == zlib.crc32(np.array([2], "<u4").tobytes()) and one.doc_tokens == 1
    by = got.sort_values(["sequence_id", "offset"])
    assert ((by.groupby("sequence_id").length.cumsum() - by.length) == by.offset).all()
    assert packing.pack(docs.limit(0)).count() == 0


def test_the_smallest_tables_through_pack(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = Tokenizer.from_file(PATH)
    want = {r.doc_id: np.array([*model.encode(r.text, add_special_tokens=False).ids, 2], "<u4") for r in docs.collect()}
    rows = packing.pack(docs).toPandas()
    for doc, pieces in rows.groupby("doc_id"):
        ids, at = want.pop(doc), 0
        for r in pieces.sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not want
    for _, parts in rows.sort_values("offset").groupby("sequence_id"):
        assert (parts.offset == parts.length.cumsum() - parts.length).all()
        total = int(parts.length.sum())
        assert total == 4096 or (total < 4096 and total & (total - 1) == 0)
