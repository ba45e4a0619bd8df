import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratafold.llm import language as lang

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return lang.train(docs.filter("doc_id % 2 = 0"))


def test_trigrams_of_small_texts():
    bucket, begin = lang.letter_trigrams(pa.array(["Ab", "", "12", "ab x", "é"]).slice(0))
    assert np.diff(begin).tolist() == [2, 0, 0, 3, 2]
    assert (bucket[:2] == bucket[2:4]).all()


def test_held_out_text_is_told(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id % 2 = 1 AND n_chars > 40").toPandas()
    got = np.array(model.languages)[model.evidence(pa.array(docs.text)).argmax(axis=1)]
    assert (got == docs.lang).mean() > 0.97


def brute_fuse(rows, evidence, languages):
    """rows: (host, declared)."""
    n, k = len(languages), lang.SMOOTHING
    p = np.exp(evidence - evidence.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    even = (p.sum(axis=0) + k / n) / (len(rows) + k)
    groups = lambda key: {v: p[[i for i, r in enumerate(rows) if r[0] and key(r[0]) == v]].sum(axis=0) for v in {key(r[0]) for r in rows if r[0]}}
    suffix, domain, host = (groups(f) for f in (lambda h: h.split(".")[-1], lambda h: ".".join(h.split(".")[-2:]), lambda h: h))
    smooth = lambda s, up: (s + k * up) / (s.sum() + k)
    tags = {t: p[[i for i, r in enumerate(rows) if r[1] == t]].sum(axis=0) for t in {r[1] for r in rows if r[1]}}
    every = sum(tags.values()) if tags else np.zeros(n)
    out = []
    for i, (h, d) in enumerate(rows):
        prior = even
        if h:
            up = smooth(domain[".".join(h.split(".")[-2:])], smooth(suffix[h.split(".")[-1]], even))
            prior = (np.maximum(0, host[h] - p[i]) + k * up) / (host[h].sum() - 1 + k)
        log = evidence[i] + np.log(prior) + (np.log((np.maximum(0, tags[d] - p[i]) + 1) / (np.maximum(0, every - p[i]) + len(tags) + 1)) if d else 0)
        q = np.exp(log - log.max())
        out.append(q / q.sum())
    return np.array(out)


def test_fusion_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    languages = ["a", "b", "c"]
    rows = [(rng.choice(["x.p.com", "y.p.com", "z.q.org", "solo", None]), rng.choice(["a", "b", "zz", None])) for _ in range(60)]
    logs = rng.normal(size=(60, 3)) * 2
    df = spark.createDataFrame([(i, h, d, logs[i].tolist()) for i, (h, d) in enumerate(rows)], "id long, host string, declared string, text_log array<double>")
    want = brute_fuse(rows, logs, languages)
    for r in lang.fuse(df, languages).collect():
        assert r.lang == languages[want[r.id].argmax()] and abs(r.chance - want[r.id].max()) < 1e-9


def test_pages(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = lang.identify_pages(pages, model).collect()
    assert len(got) == pages.count() and all(r.host.endswith(("com", "net", "org")) for r in got)
    assert sum(r.lang == r.declared for r in got) >= 0.95 * len(got)


def test_markup_and_address_decide_where_text_cannot(spark, model):
    own = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    odd = [(-1, "http://h.example.com/x", '<html lang="fr"><body>123</body></html>'), (-2, None, None), (-3, "relative/path", ""), (-4, "http://h.example.com/x", '<html lang="fr"><script>the and of</script></html>')]
    got = {r.page_id: r for r in lang.identify_pages(own.unionByName(spark.createDataFrame(odd, PAGES)), model).filter("page_id < 0").collect()}
    assert got[-1].lang == "fr" and got[-4].lang == "fr" and got[-2].host is None and got[-3].host is None
    assert all(0 < r.chance <= 1 for r in got.values())


def test_documents_with_letters_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("chance", F.lit("clash"))
    extra = spark.createDataFrame([(-1, None, "en", "src0", 0), (-2, "123 $$$", None, None, 0), (-3, "the and of", None, None, 0), (-3, "the and of", None, None, 0)], DOCS).withColumn("chance", F.lit("c"))
    kept = lang.known_language_documents(docs.unionByName(extra))
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert kept.columns == docs.columns and sorted(i for i in ids if i < 0) == [-3, -3]
    assert len(ids) >= 0.99 * docs.count()


def test_a_documents_own_trigrams_do_not_judge_it(spark):
    """`evidence_without` is the evidence of a model that was trained without the text."""
    rows = [("the cat and the hat", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr"), ("a hat on the mat", "en"), ("un chien", "fr"), ("the dog", "de"), ("", "en"), ("the dog", None)]
    frame = lambda some: spark.createDataFrame([(t, v) for t, v in some], "text string, lang string")
    model = lang.train(frame(rows), unknown=True)
    got = model.evidence_without(pa.array([t for t, _ in rows]), [v for _, v in rows])
    assert model.languages == ["de", "en", "fr", "und"]
    for i, (t, _) in enumerate(rows):
        rest = lang.train(frame(rows[:i] + rows[i + 1 :]), unknown=True)
        own = rest.evidence(pa.array([t]))
        raw = dict(zip(rest.languages, own[0]))
        assert set(raw) == set(model.languages)
        assert np.allclose(got[i], [raw[v] for v in model.languages], atol=1e-4)


def test_a_mislabelled_document_is_corrected_and_unknown_languages_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = np.random.default_rng(0)
    russian = " ".join("".join(rng.choice(list("абвгдежзиклмнопрстуфхц"), 6)) for _ in range(80))
    letters = " ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 6)) for _ in range(80))
    english = docs.filter("lang = 'en' AND n_chars > 500").orderBy("doc_id").limit(5).collect()
    wrong = [(-i - 1, r.text[:400] + f" {i}", "fr" if i % 2 else None, r.source, 1) for i, r in enumerate(english)]
    more = spark.createDataFrame([*wrong, (-90, russian, "en", "src0", 1), (-91, letters, None, "src1", 1)], DOCS)
    got = {r.doc_id: r.lang for r in lang.known_language_documents(docs.unionByName(more)).filter("doc_id < 0").collect()}
    assert got == {w[0]: "en" for w in wrong}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert lang.known_language_documents(docs).count() == 0
    none = lang.train(docs)
    one = spark.createDataFrame([(1, "http://a.b/", "<p>x")], PAGES)
    assert lang.identify_pages(one, none).first().lang is None and lang.identify_pages(one.limit(0), none).count() == 0


def test_a_language_declared_after_a_long_preamble_counts():
    licence = "<!-- " + "a licence, with <html lang='de'> in it. " * 200 + "-->"
    assert lang.declared_language(licence + "\n" * 5000 + '<!DOCTYPE html><HTML class="x" lang="FR-ca"><body>') == "fr"
    assert lang.declared_language(licence) is None and lang.declared_language("<html><body>" + "x" * 5000) is None


def test_clashing_names_and_a_very_long_page(spark, model):
    long = '<html lang="de"><body>' + "der hund und die katze " * 60_000 + "</body></html>"
    pages = spark.createDataFrame([(1, "http://a.example.com/x", long), (1, "http://a.example.com/x", long), (None, None, "<p>the cat and the dog</p>")], PAGES)
    for name in ("host", "declared", "lang", "chance", "text_log", "p", "sums"):
        pages = pages.withColumn(name, F.lit("clash"))
    got = sorted(lang.identify_pages(pages, model).collect(), key=str)
    assert [(r.page_id, r.lang) for r in got] == [(1, "de"), (1, "de"), (None, "en")]
