import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from stratafold.llm import similar_sets as ss
from stratafold.llm import simhash_pivot as sp
from stratafold.llm.components import components, spanning_forest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(rows):
    ids, fps = [r[0] for r in rows], [brute_fingerprint(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    best = {}
    for i in range(len(rows)):
        best.setdefault(root(i), []).append(ids[i])
    return [(d, f"{f:016x}", min(best[root(i)])) for i, (d, f) in enumerate(zip(ids, fps))]


TEXTS = ["", None, " \t\n", "One", "one two three", "ONE two  three\nfour", "one two three four", "é " * 40, "a b c d e f g h i j k l m n o p q r s t " * 30]


def test_fingerprints_and_classes_match_brute_force(spark):
    rng = np.random.default_rng(1)
    base = [" ".join(rng.choice([f"w{i}" for i in range(50)], 60)) for _ in range(30)]
    near = [" ".join([*t.split()[:-1], "other"]) for t in base[:15]]
    rows = [(i, t) for i, t in enumerate([*TEXTS, *base, *near, *base[:5], base[0] * 200])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = sorted(map(tuple, sp.near_duplicates(docs).collect()))
    assert got == sorted(brute_classes(rows))


def test_matches_brute_force_on_the_smallest_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, sp.near_duplicates(docs).collect())) == sorted(brute_classes(rows))


@pytest.mark.parametrize("blocks", [5, 6, 7, 8])
def test_every_number_of_blocks_finds_every_link(spark, blocks, monkeypatch):
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = {int(c) for c in centre}
    for c in centre[:20]:
        for k in (1, 3, 4, 5):
            fps.add(int(c) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)))
    monkeypatch.setattr(sp, "blocks_for", lambda count, radius=4: blocks)
    monkeypatch.setattr(sp, "CHUNK", 8)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    found = sp.links(spark.createDataFrame(signed, "fp long"))
    got = components(found).collect()
    root = {r.node: r.root for r in got}
    labels = {f[0]: root.get(f[0], f[0]) for f in signed}
    up = {f[0]: f[0] for f in signed}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for (x,) in signed:
        for (y,) in signed:
            if ((x ^ y) & (2**64 - 1)).bit_count() <= 4:
                a, b = top(x), top(y)
                up[max(a, b)] = min(a, b)
    assert labels == {f: top(f) for f in up}


def test_a_bucket_over_the_chunk_size_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(sp, "CHUNK", 5)
    fps = [(1 << 40) | i for i in range(64)]
    found = sp.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    assert {r.root for r in components(found).collect()} == {fps[0]}


def test_one_document_of_each_class_stays(spark):
    rows = [(5, "same words here " * 20), (3, "same words here " * 20), (3, "same words here " * 20), (9, "quite another text " * 20), (None, "third thing stands alone " * 20)]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], DOCS).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))
    kept = sp.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "9", "None"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert sp.near_duplicates(docs).count() == 0
    assert sp.without_near_duplicates(docs).count() == 0


def test_a_forest_spans_what_its_links_do():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 60, 90), rng.integers(0, 60, 90)
    kept = spanning_forest(60, a, b)
    assert len(set(kept.tolist())) == len(kept)
    label = {}
    for some in (range(90), kept):
        up = list(range(60))
        for i in some:
            x, y = (up.index(up[v]) and up[v] for v in (a[i], b[i]))
            up = [min(x, y) if v in (x, y) else v for v in up]
        label[len(label)] = up
    assert label[0] == label[1] and len(kept) == 60 - len(set(label[0]))


def test_shingle_sets_are_those_of_the_words():
    texts = [*(t or "" for t in TEXTS), "A b\tc d e f", "a b c d e  f", "a b c d e", "e d c b a"]
    sets = ss.shingle_sets(pa.array(texts))
    words = [tuple(" ".join(t.lower().split()).split()) for t in texts]
    want = [{w[i : i + 5] for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    assert [len(s) for s in sets] == [len(w) for w in want]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(np.intersect1d(sets[i], sets[j])) == len(want[i] & want[j])


@pytest.mark.parametrize("at_once", [1 << 20, 40])
def test_asking_counts_shared_shingles(spark, at_once, monkeypatch):
    """Answers are what a count of sets by shingle gives, whatever runs the sets come in; hot shingles are listed."""
    monkeypatch.setattr(ss, "AT_ONCE", at_once)
    monkeypatch.setattr(ss, "HOT", 5)
    rng = np.random.default_rng(4)
    vocabulary = rng.integers(0, 2**63, 300, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sets = [np.unique(np.append(rng.choice(vocabulary, 12), vocabulary[0])) for _ in range(60)]
    rows = spark.createDataFrame([(i, [int(x) for x in s.view(np.int64)]) for i, s in enumerate(sets)], "sig long, s array<long>")
    of = lambda batch: ((i, np.asarray(s.as_py(), np.int64).view(np.uint64)) for i, s in zip(batch.column("sig").to_pylist(), batch.column("s")))
    got = ss._asked(rows, 8, of, ["sig", "s"]).collect()
    seen = {}
    for s in sets:
        for x in s.tolist():
            seen[x] = seen.get(x, 0) + 1
    shared = {}
    for r in got:
        if r.hot is None:
            shared[r.sig] = shared.get(r.sig, 0) + r.shared
    assert shared == {i: sum(seen[x] > 1 for x in s.tolist()) for i, s in enumerate(sets)}
    hot = {int(ss.short_key(np.array([x], np.uint64), 8)[0]): n for x, n in seen.items() if n > 5}
    assert {r.hot % 2**64: r.shared for r in got if r.hot is not None} == hot and len(hot) >= 1


def test_similar_texts_join_and_others_stay(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(25):
        base = list(rng.choice(words, 300))
        rows.append((10 * i, " ".join(base)))
        near = list(base)
        for at in rng.choice(300, 5, replace=False):
            near[at] = "changed"
        rows.append((10 * i + 1, " ".join(near)))
        rows.append((10 * i + 2, " ".join(base[:100] + list(rng.choice(words, 200)))))
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], DOCS)
    kept = {r.doc_id for r in sp.without_near_duplicates(docs).collect()}
    assert kept == {10 * i + k for i in range(25) for k in (0, 2)}


def shingle_set(text):
    words = text.split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    """doc_ids of the first rows of the classes by all pairs, linked by fingerprints or similarity."""
    hashed = ss.shingle_sets(pa.array([t for _, t in rows]))
    fps = [sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own)) for own in map(np.ndarray.tolist, hashed)]
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if (fps[i] ^ fps[j]).bit_count() <= 4 or (common and 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common)):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(rows)):
        least.setdefault(root(i), []).append(rows[i][0])
    return sorted(min(x) for x in least.values())


def kept_ids(spark, rows):
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], DOCS)
    return sorted(r.doc_id for r in sp.without_near_duplicates(docs).collect())


@pytest.mark.parametrize("piece", [1 << 22, 5000])
def test_a_dense_family_around_the_threshold_matches_all_pairs(spark, piece, monkeypatch):
    monkeypatch.setattr(ss, "PIECE", piece)
    monkeypatch.setattr(ss, "PIECE_SETS", 70 if piece > 5000 else 1 << 12)
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(304)]
    rows = []
    for i in range(200):
        words = list(base)
        for at in rng.choice(304, int(rng.integers(2, 7)), replace=False):
            words[at] = f"v{rng.integers(40)}"
        rows.append((i, " ".join(words)))
    want = brute_kept(rows)
    assert 1 < len(want) < 200
    assert kept_ids(spark, rows) == want


@pytest.mark.parametrize("most, broadcast", [(1_000_000, True), (300, False)])
def test_fingerprints_by_table_are_broadcast_only_if_few(spark, monkeypatch, most, broadcast):
    """100 fingerprints are 500 rows by table, though their file is small."""
    monkeypatch.setattr(sp, "BROADCAST_ROWS", most)
    found = sp.links(sp.saved(spark.range(100).selectExpr("shiftleft(id, id % 50) AS fp").distinct()))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in plan) == broadcast


def test_a_common_shingle_makes_families_of_like_sizes_only(spark):
    """Sizes 20, 22 and 27 follow one another within the similarity, 40 and 42 as well; 9 is alone, and 27 to 40 is a gap."""
    sizes = {1: 20, 2: 22, 3: 27, 4: 40, 5: 42, 6: 9, 7: 42}
    rows = [(k, n, [7, *range(1000 * k, 1000 * k + n - 1)]) for k, n in sizes.items()]
    found = {}
    for r in ss.families(spark.createDataFrame(rows, "sig long, n long, s array<long>")).collect():
        found.setdefault(r.family, set()).add(r.sig)
    assert sorted(map(sorted, found.values())) == [[1, 2, 3], [4, 5, 7]]


def test_rounds_of_pieces_meet_each_pair_once_and_copy_no_set_often(spark):
    """However many pieces a family has, a round writes a set at most 2 * OFFSETS times."""
    for pieces in (1, 2, 3, 8, 9, 40):
        owns = spark.range(pieces).selectExpr("cast(id AS int) AS own", f"{pieces} AS pieces")
        met = {}
        for first in (0, *range(1, pieces // 2 + 1, ss.OFFSETS)):
            rows = owns.selectExpr("own", f"inline({ss.meetings(first)})").collect()
            assert max(sum(r.own == own for r in rows) for own in range(pieces)) <= 2 * ss.OFFSETS
            for r in rows:
                assert r.own in (r.i, r.j) and r.side == (2 if r.i == r.j else r.own == r.j)
                met.setdefault((r.i, r.j), []).append(r.own)
        assert {k: sorted(v) for k, v in met.items()} == {(i, j): [i, j] if i < j else [i] for i in range(pieces) for j in range(i, pieces)}


@pytest.mark.parametrize("changes, whole", [(1, True), (7, False)])
def test_a_cut_family_meets_in_rounds_until_it_is_one_class(spark, monkeypatch, changes, whole):
    monkeypatch.setattr(ss, "PIECE", 5000)
    monkeypatch.setattr(ss, "OFFSETS", 1)
    rounds, old = [], ss._links
    monkeypatch.setattr(ss, "_links", lambda sets, dealt, first: rounds.append(first) or old(sets, dealt, first))
    rng = np.random.default_rng(15)
    rows = []
    for i in range(150):
        words = [f"b{k}" for k in range(304)]
        for at in rng.choice(304, changes, replace=False):
            words[at] = f"v{rng.integers(40)}"
        rows.append((i, " ".join(words)))
    want = brute_kept(rows)
    assert (len(want) == 1) == whole
    assert kept_ids(spark, rows) == want
    assert rounds == ([0, 1] if whole else [0, 1, 2, 3, 4])


@pytest.mark.parametrize("at_once", [1 << 19, 50])
def test_rows_of_bits_and_lookups_find_the_same_links(at_once, monkeypatch):
    """Two buckets of dense families in one call, verified by rows of bits and shingle by shingle; pairs that failed in a step don't come back."""
    monkeypatch.setattr(ss, "PAIRS_AT_ONCE", at_once)
    rng = np.random.default_rng(14)
    sets = [np.unique(np.concatenate([100 * (i % 2) + rng.choice(60, 56, replace=False), 1000 * (i + 1) + np.arange(3)])) for i in range(60)]
    size, flat = np.asarray([len(s) for s in sets]), np.concatenate(sets)
    arguments = (np.arange(60, dtype=np.uint64) % 2, np.full(60, 2), np.arange(60), flat, size)
    assert ss.shared_bits(arguments[0], np.repeat(np.arange(60), size), np.unique(flat, return_inverse=True)[1], np.unique(flat, return_counts=True)[1], 60) is not None

    def classes():
        root = list(range(60))
        for a, b in zip(*(x.tolist() for x in ss.similar_in_buckets(*arguments))):
            old, new = root[a], root[b]
            root = [new if r == old else r for r in root]
        return {frozenset(i for i in range(60) if root[i] == r) for r in root}

    dense = classes()
    monkeypatch.setattr(ss, "shared_bits", lambda *_: None)
    assert dense == classes()
    near = [(a, b) for a in range(60) for b in range(a) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]
    assert near and all(any({a, b} <= c for c in dense) for a, b in near)
    assert sum(len(c) - 1 for c in dense) <= len(near)


def test_similar_sets_join_whatever_their_fingerprints(spark):
    """A passage that is repeated moves the votes, not the set."""
    rows = []
    for i in range(20):
        words = [f"w{i}x{k}" for k in range(204)]
        again = words[:24] * 12
        rows += [(10 * i, " ".join(words)), (10 * i + 1, " ".join(again + words))]
    assert kept_ids(spark, rows) == brute_kept(rows) == [10 * i for i in range(20)]


def test_every_distinct_text_of_a_class_may_join(spark):
    """A text like the second of a class, not like its first."""
    rng = np.random.default_rng(10)
    rows = []
    for i in range(12):
        words = [f"w{i}x{k}" for k in range(304)]
        for n in range(4):
            words = list(words)
            for at in rng.choice(304, 5, replace=False):
                words[at] = f"v{n}x{at}"
            rows.append((10 * i + n, " ".join(words)))
    assert kept_ids(spark, rows) == brute_kept(rows)


def test_a_common_passage_joins_no_others(spark, monkeypatch):
    monkeypatch.setattr(ss, "HOT", 3)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, passage + " " + " ".join(f"w{i // 2}x{k if k != 9 or i % 2 else 'other'}" for k in range(90))) for i in range(40)]
    assert kept_ids(spark, rows) == brute_kept(rows) == list(range(0, 40, 2))


def test_rows_of_one_key_and_different_texts_stay(spark):
    rows = [(None, "first text stands alone " * 20), (None, "second thing stands apart " * 20), (None, "second thing stands apart " * 20), (None, None), (4, "one of a shared key " * 20), (4, "another one under it " * 20)]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], DOCS)
    kept = [(r.doc_id, r.text) for r in sp.without_near_duplicates(docs).collect()]
    assert sorted(kept, key=str) == sorted(set(rows), key=str)


def test_the_stage_matches_all_pairs_on_the_smallest_table(spark):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    lower = [(i, "".join(c.lower() if c.isascii() else c for c in t)) for i, t in rows]
    assert kept_ids(spark, rows) == brute_kept(lower)


def test_pivots_discard_pairs_of_a_bucket_that_do_not_link():
    """16 distances discard nearly all random pairs beyond the radius, one leaves most of what its window meets."""
    rng = np.random.default_rng(12)
    fp = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.triu_indices(3000, 1)
    far = np.bitwise_count(fp[a] ^ fp[b]) > 4
    distance = np.bitwise_count(fp[:, None] ^ sp._pivots()[None, :]).astype(int)
    near = np.abs(distance[a] - distance[b]) <= 4
    assert (~near.all(axis=1))[far].mean() > 0.99 > 0.6 > (~near[:, 0])[far].mean()
    assert near.all(axis=1)[~far].all()


def test_a_very_long_text_and_a_repetitive_one(spark):
    rng = np.random.default_rng(13)
    words = " ".join(f"w{i}" for i in rng.integers(0, 10**6, 120_000))
    rows = [(1, words), (2, words + " one more"), (3, "the " * 200_000), (4, "the " * 100), (5, words[: len(words) // 2])]
    assert kept_ids(spark, rows) == [1, 3, 5]
