import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from stratafold.llm import phrases
from stratafold.llm.arrowtext import word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def counted(rows):
    """f by (lang, phrase) and n by lang, by loops."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, " ".join(words[i : i + k])] += 1
    return f, n


def best(rows, least, top):
    f, n = counted(rows)
    by_lang = defaultdict(list)
    candidates = {key: a for key, a in f.items() if a >= least and " " in key[1]}
    for (lang, phrase), a in candidates.items():
        words = phrase.split(" ")
        inside = [x for (other, longer), x in candidates.items() if other == lang and longer.count(" ") > phrase.count(" ") and f" {phrase} " in f" {longer} "]
        if any(100 * x >= 80 * a for x in inside):
            continue
        cuts = [(2000000 * a // (f[lang, " ".join(words[:k])] + f[lang, " ".join(words[k:])]), k, f[lang, " ".join(words[:k])], f[lang, " ".join(words[k:])]) for k in range(1, len(words))]
        score, _, l, r = min(cuts)
        by_lang[lang].append((-score, -a, phrase.encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in by_lang.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


def made(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0) for i, (lang, t) in enumerate(rows)], DOCS)


def random_rows(seed, words="a b c d E f".split(), n=60):
    rng = np.random.default_rng(seed)
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "! "]
    text = lambda: "".join(str(rng.choice(words)) + str(rng.choice(marks)) for _ in range(int(rng.integers(0, 40))))
    return [(str(rng.choice(["en", "de"])) if rng.random() < 0.9 else None, text()) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("filter_bits", [1 << 27, 64])  # a filter of 64 bits is full and stops nothing
def test_collocations_are_those_of_loops(spark, seed, filter_bits):
    rows = random_rows(seed)
    got = phrases.collocations(made(spark, rows), least=5, top=40, filter_bits=filter_bits).collect()
    assert sorted(map(tuple, got)) == best(rows, 5, 40) != []


def test_collocations_are_those_of_the_sql(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = phrases.collocations(spark.read.parquet(f"{sf}/documents.parquet"))
    found = duck.execute(phrases.ORACLE)
    places = [[d[0] for d in found.description].index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in places) for r in found.fetchall())


def test_odd_rows_and_empty_tables(spark):
    rows = [(None, "one two " * 40), ("und", "one two"), ("en", None), ("en", ""), ("en", " . \t\n"), ("en", "É É. É É x É É " * 20), ("en", ". lead lead " * 30), ("en", "long-word-" * 500 + " end")]
    docs = made(spark, rows + rows[:1]).selectExpr("*", "1 as f", "2 as words", "3 as phrase", "4 as key")
    assert sorted(map(tuple, phrases.collocations(docs).collect())) == best(rows + rows[:1], 30, 2000)
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(made(spark, [("en", "too few words")])).count() == 0


def test_more_than_a_count_can_hold(spark):
    rows = [("en", "x y " * 100 + "z")] * 3
    assert sorted(map(tuple, phrases.collocations(made(spark, rows), least=200).collect())) == best(rows, 200, 2000)


def nodes(automaton, k):
    return automaton.phrases(k, np.arange(len(automaton.levels[k - 1].key))).to_pylist()


@pytest.mark.parametrize("seed", range(4))
def test_states_are_the_classes_of_ends(seed):
    texts = [t for _, t in random_rows(seed, n=12)]
    tokens = phrases.tokens_of(pa.array(texts))
    group = np.zeros(len(tokens.index), np.int64)
    automaton = phrases.SuffixAutomaton(tokens, group, word_hashes(pa.array(["en"]), 1), 4, None, 0)
    f = {p: a for (_, p), a in counted([("en", t) for t in texts])[0].items()}
    ends = defaultdict(set)
    words = tokens.distinct.take(pa.array(tokens.index)).to_pylist()
    for e in range(len(words)):
        for k in range(1, 5):
            if e >= k - 1 and tokens.piece[e - k + 1] == tokens.piece[e]:
                ends[" ".join(words[e - k + 1 : e + 1])].add(e)
    for k, level in enumerate(automaton.levels, 1):
        own = nodes(automaton, k)
        assert dict(zip(own, level.count.tolist())) == {p: a for p, a in f.items() if p.count(" ") == k - 1}
        if k > 1:
            above = nodes(automaton, k - 1)
            assert [above[i] for i in level.link] == [p.split(" ", 1)[1] for p in own]
            assert [above[i] for i in level.prefix] == [p.rsplit(" ", 1)[0] for p in own]
    classes = defaultdict(list)
    for p, where in ends.items():
        classes[frozenset(where)].append(p)
    want = sorted((max(c, key=lambda p: p.count(" ")), min(p.count(" ") for p in c) + 1) for c in classes.values())
    got = sorted((p, int(s)) for k, shortest, found in automaton.states() for p, s in zip(automaton.phrases(k, found).to_pylist(), shortest))
    assert got == want


@pytest.mark.parametrize("limit", [1, 7, 30, 1000])
def test_shards_of_a_long_text_count_each_phrase_once(limit):
    texts = [t for _, t in random_rows(5, n=8)] + ["", "wordwithoutend" * 20, " \t. x y z w v.   u t\t"]
    total = Counter()
    for rows, tokens in phrases.shards(pa.array(texts), limit):
        assert len(tokens.text) == 0 or tokens.text.max() < len(rows)
        automaton = phrases.SuffixAutomaton(tokens, np.zeros(len(tokens.index), np.int64), word_hashes(pa.array(["en"]), 1), 4, None, 0)
        for k, level in enumerate(automaton.levels, 1):
            total.update({p: int(a) for p, a in zip(nodes(automaton, k), level.count)})
    assert +total == Counter({p: a for (_, p), a in counted([("en", t) for t in texts])[0].items()})


def test_long_texts_through_the_query(spark, monkeypatch):
    rows = [("en", " ".join(f"w{i % 7} x{i % 11}" for i in range(1_200_000)))]
    got = phrases.collocations(made(spark, rows), top=5).collect()
    f, n = Counter(), 2_400_000
    words = rows[0][1].split(" ")
    for k in range(1, 5):
        f.update(zip(*(words[i:] for i in range(k))))
    assert len(rows[0][1]) > phrases.SHARD // 2 and len(got) == 5
    for r in got:
        assert r.n == n and r.a == f[tuple(r.phrase.split(" "))]
