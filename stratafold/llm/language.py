"""Language identification by Bayesian evidence fusion.

Evidence, with independent errors assumed given the language:
- text: a multinomial model of hashed byte trigrams inside words, counted over
  all labelled documents; its log-likelihood is tempered, as trigrams overlap,
  and bounded, as no model deserves endless trust;
- the declared markup language: how often pages of each language (by their text)
  declare each tag, by grouped counts with smoothing, less the row's own share;
- the address: priors of the host, smoothed towards its registered domain, that
  towards the address suffix, and that towards all rows; each from grouped sums of
  text posteriors, less the row's own share.

Rows without an address or a declared language go without that evidence.

For documents the model also has an unknown language, UNKNOWN, under which all
trigrams are alike; text of no trained language falls to it. A document's own
trigrams, which were counted for its declared language, are left out of that
language's counts before they judge it.

Defined cases: null text and text without letters have a flat likelihood, and
what else is known decides; a null, relative or host-less address is no
evidence; repeated rows are rows of their own; without training rows the language
is null and the chance 0; ties go to the language first by code; an empty table
gives no rows; other columns are kept by `known_language_documents` only.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.llm.arrowtext import bound_batches, segment_sums, slices, text_column
from stratafold.llm.shared import checked_broadcast, saved

BUCKETS = 1 << 15
#: Weight of a trigram's log-likelihood, and the most that text can weigh between two languages.
TEMPER, MOST = 0.25, 30.0
#: Rows' worth of trust in the level above, and in an even chance of tags.
SMOOTHING = 5.0
LEAST_CHANCE = 0.5
UNKNOWN = "und"
SLICE = 1 << 20


def letter_trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each byte trigram of letters, with a word's edges, where each text's trigrams begin)."""
    data = pc.ascii_lower(texts)
    if data.offset:
        data = pa.concat_arrays([data])
    ends = np.frombuffer(data.buffers()[1], np.int32)[: len(data) + 1].astype(np.int64)
    raw = np.frombuffer(data.buffers()[2], np.uint8)[ends[0] : ends[-1]] if data.buffers()[2] is not None else np.empty(0, np.uint8)
    ends = ends - ends[0]
    # every byte that is no letter becomes a space; texts are parted by one
    letter = np.zeros(256, np.uint32)
    letter[97:123], letter[128:] = np.arange(97, 123), np.arange(128, 256)
    spread = np.zeros(len(raw) + len(texts) + 2, np.uint32)
    spread[np.arange(len(raw)) + np.repeat(np.arange(len(texts)), np.diff(ends)) + 1] = letter[raw]
    middle = spread[1:-1] > 0
    code = (spread[:-2] * np.uint32(0x9E3779B1)) ^ (spread[1:-1] * np.uint32(0x85EBCA77)) ^ (spread[2:] * np.uint32(0xC2B2AE3D))
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    bucket = (code >> np.uint32(17)).astype(np.int64)[middle]
    before = np.concatenate(([0], np.cumsum(middle)))
    return bucket, before[np.minimum(ends + np.arange(len(texts) + 1), len(middle))]


class TextModel:
    """Log-likelihoods of trigrams by language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.counts = languages, counts
        self.table = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)).astype(np.float32)

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """Tempered log-likelihood of each language, the best 0 and none below -MOST, for each text."""
        bucket, begin = letter_trigrams(texts)
        own = np.stack([segment_sums(row[bucket].astype(np.float64), begin) for row in self.table], axis=1) * TEMPER if len(self.languages) else np.zeros((len(texts), 0))
        return np.maximum(own - own.max(axis=1, keepdims=True), -MOST) if own.shape[1] else own

    def evidence_without(self, texts: pa.Array, counted: list[str | None]) -> np.ndarray:
        """`evidence` of texts that were counted for a language, each less its own trigrams."""
        bucket, begin = letter_trigrams(texts)
        own = np.stack([segment_sums(row[bucket].astype(np.float64), begin) for row in self.table], axis=1) if len(self.languages) else np.zeros((len(texts), 0))
        size = np.diff(begin)
        key, times = np.unique(np.repeat(np.arange(len(texts)), size) * BUCKETS + bucket, return_counts=True)
        text, bucket = key // BUCKETS, key % BUCKETS
        for k, name in enumerate(self.languages):
            mine = np.asarray([c == name for c in counted], bool)
            if mine.any():
                part = mine[text]
                logs = times[part] * np.log(np.maximum(self.counts[k][bucket[part]] - times[part], 0) + 0.5)
                total = np.maximum(self.counts[k].sum() - size, 0) + 0.5 * BUCKETS
                own[mine, k] = (np.bincount(text[part], logs, len(texts)) - size * np.log(total))[mine]
        own *= TEMPER
        return np.maximum(own - own.max(axis=1, keepdims=True), -MOST) if own.shape[1] else own


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", unknown: bool = False) -> TextModel:
    """Count the trigrams of all rows whose language is given; with `unknown`, UNKNOWN is a language too, if there is any."""
    bound_batches(docs.sparkSession)
    rows = docs.filter(F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, lang = text_column(batch), batch.column("lang").dictionary_encode()
            code, names = lang.indices.to_numpy(zero_copy_only=False), lang.dictionary.to_pylist()
            for first, n in slices(texts, SLICE):
                bucket, begin = letter_trigrams(texts.slice(first, n))
                owner = np.repeat(code[first : first + n], np.diff(begin)).astype(np.int64)
                counts = np.bincount(owner * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for i, name in enumerate(names):
                    total[name] = total.get(name, 0) + counts[i]
        for name, counts in total.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used), pa.array(counts[used])], ["lang", "bucket", "n"])

    found = rows.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted({*found["lang"], *([UNKNOWN] if unknown and len(found) else [])})
    counts = np.zeros((len(languages), BUCKETS))
    counts[found["lang"].map({v: i for i, v in enumerate(languages)}).to_numpy(int), found["bucket"].to_numpy(int)] = found["n"]
    return TextModel(languages, counts)


_DROP = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", re.DOTALL | re.IGNORECASE)
_OPENING = re.compile(r"<!--.*?(?:-->|\Z)|<html\b[^>]*", re.DOTALL | re.IGNORECASE)
_DECLARED = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.IGNORECASE)


def page_text(source: str | None) -> str:
    """What a page shows: no comments, scripts, styles or tags, and its entities read."""
    return entities.unescape(_DROP.sub(" ", source or ""))


def declared_language(source: str | None) -> str | None:
    """The language of the first html tag outside comments, wherever it is."""
    tag = next((m[0] for m in _OPENING.finditer(source or "") if not m[0].startswith("<!--")), "")
    found = _DECLARED.search(tag)
    return found[1].lower() if found else None


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)), F.lit(""))


def evidence(rows: DataFrame, model: TextModel, source: str, markup: bool, counted: bool = False) -> DataFrame:
    """`rows` (keys, host, declared, source text) with `text_log` by language; from markup the declared language is read too. With `counted` the texts were counted for their declared language. The source column goes."""
    bound_batches(rows.sparkSession)
    keep = [c for c in rows.columns if c != source]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch, source)
            declared = batch.column("declared")
            if markup:
                pages = texts.to_pylist()
                texts, declared = pa.array(map(page_text, pages), pa.string()), pa.array(map(declared_language, pages), pa.string())
            said = declared.to_pylist() if counted else []
            parts = [model.evidence_without(texts.slice(a, n), said[a : a + n]) if counted else model.evidence(texts.slice(a, n)) for a, n in slices(texts, SLICE)]
            logs = np.concatenate(parts) if parts else np.zeros((0, len(model.languages)))
            yield pa.RecordBatch.from_arrays([*(declared if c == "declared" else batch.column(c) for c in keep), pa.array(list(logs), pa.list_(pa.float64()))], [*keep, "text_log"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(keep).schema) + ", text_log array<double>"
    return rows.mapInArrow(run, schema)


def _softmax(logs: str) -> str:
    top = f"array_max({logs})"
    return f"transform(array(transform({logs}, x -> exp(x - {top}))), e -> transform(e, x -> x / aggregate(e, 0D, (s, y) -> s + y)))[0]"


def fuse(marked: DataFrame, languages: list[str], smoothing: float = SMOOTHING) -> DataFrame:
    """`marked` (host, declared, text_log, keys) with lang, chance, text_lang and text_chance.

    Every grouped sum combines before it shuffles; what is joined back has a row
    per host or per tag.
    """
    n = len(languages)
    if not n:
        return marked.drop("text_log").selectExpr("*", "CAST(NULL AS STRING) AS lang", "0D AS chance", "CAST(NULL AS STRING) AS text_lang", "0D AS text_chance")
    rows = marked.withColumn("p", F.expr(_softmax("text_log")))
    sums = [F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(n)]
    vector = F.array(*(F.col(f"s{i}") for i in range(n)))
    over = lambda df, *keys: df.groupBy(*keys).agg(*sums).select(*keys, vector.alias("sums"))
    total = lambda v: f"aggregate({v}, 0D, (s, x) -> s + x)"

    def raised(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(*(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(n))).select(*keys, vector.alias("sums"))

    hosts = saved(over(rows.filter("host IS NOT NULL"), "host").withColumns({"suffix": F.element_at(F.split("host", r"\."), -1), "domain": F.substring_index("host", ".", -2)}))
    whole = [r or 0.0 for r in rows.agg(*sums).first()]
    even = [(w + smoothing / n) / (sum(whole) + smoothing) for w in whole]
    base = f"array({', '.join(f'{e!r}D' for e in even)})"
    smooth = lambda up: f"transform(zip_with(sums, {up}, (x, q) -> x + {smoothing}D * q), x -> x / ({total('sums')} + {smoothing}D))"
    suffixes = raised(hosts, "suffix").selectExpr("suffix", f"{smooth(base)} AS suffix_prior")
    domains = raised(hosts, "domain", "suffix").join(suffixes, "suffix").selectExpr("domain", f"{smooth('suffix_prior')} AS domain_prior")
    priors = saved(hosts.join(domains, "domain").selectExpr("host AS known_host", "sums", "domain_prior"))
    tags = over(rows.filter("declared IS NOT NULL"), "declared")
    tags = saved(tags)
    number, all_tags = tags.count(), [r or 0.0 for r in tags.agg(*(F.sum(F.col("sums")[i]) for i in range(n))).first()]
    said = tags.selectExpr("declared AS tag", "sums AS tag_sums")
    others = f"zip_with(array({', '.join(f'{t!r}D' for t in all_tags)}), p, (t, y) -> greatest(0D, t - y) + {number}D + 1D)"
    tag_log = f"zip_with(zip_with(tag_sums, p, (x, y) -> greatest(0D, x - y) + 1D), {others}, (x, t) -> ln(x / t))"
    met = rows.join(checked_broadcast(priors), F.col("host") == F.col("known_host"), "left").join(checked_broadcast(said, number), F.col("declared") == F.col("tag"), "left")
    own = "zip_with(zip_with(sums, p, (x, y) -> greatest(0D, x - y)), domain_prior, (x, q) -> x + 5D * q)".replace("5D", f"{smoothing}D")
    prior = f"coalesce(transform({own}, x -> ln(x / ({total('sums')} - 1D + {smoothing}D))), transform({base}, x -> ln(x)))"
    joined = f"zip_with(zip_with(text_log, {prior}, (a, b) -> a + b), coalesce({tag_log}, array_repeat(0D, {n})), (a, b) -> a + b)"
    fused = met.withColumn("fused", F.expr(_softmax(joined)))
    names = f"array({', '.join(repr(v) for v in languages)})"
    best = lambda v: f"element_at({names}, CAST(array_position({v}, array_max({v})) AS INT))"
    keep = [c for c in marked.columns if c != "text_log"]
    return fused.selectExpr(*(f"`{c}`" for c in keep), f"{best('fused')} AS lang", "array_max(fused) AS chance", f"{best('p')} AS text_lang", "array_max(p) AS text_chance")


def identify_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, host, declared, lang, chance, text_lang and text_chance of each page (page_id, url, html)."""
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), host_of(pages["url"]).alias("host"), F.lit(None).cast("string").alias("declared"), pages["html"].cast("string").alias("html"))
    return fuse(saved(evidence(rows, model, "html", markup=True)), model.languages)


def identify_documents(docs: DataFrame, model: TextModel) -> DataFrame:
    """row_key, lang, chance, text_lang, text_chance and whether there is any letter, of each document; its declared language is `lang`, its host `source`."""
    rows = docs.select(F.xxhash64(docs["doc_id"], docs["text"]).alias("row_key"), docs["source"].cast("string").alias("host"), docs["lang"].cast("string").alias("declared"), F.coalesce(docs["text"], F.lit("")).rlike(r"\p{L}").alias("lettered"), docs["text"].cast("string").alias("text"))
    return fuse(saved(evidence(rows, model, "text", markup=False, counted=True)), model.languages)


def known_language_documents(docs: DataFrame, model: TextModel | None = None, least_chance: float = LEAST_CHANCE) -> DataFrame:
    """The rows of `docs` that hold letters and whose language is known with at least `least_chance`, with that language as their `lang`."""
    found = saved(identify_documents(docs, model or train(docs, unknown=True)))
    stays = f"lettered AND chance >= {least_chance} AND lang <> '{UNKNOWN}'"
    gone = saved(found.filter(f"NOT coalesce({stays}, false)").select(F.col("row_key").alias("_gone")).distinct())
    other = saved(found.filter(f"{stays} AND NOT lang <=> declared").groupBy(F.col("row_key").alias("_other"), F.col("declared").alias("_was")).agg(F.min("lang").alias("_lang")))
    key = F.xxhash64(docs["doc_id"], docs["text"])
    kept = docs.withColumn("_row_key", key).join(checked_broadcast(gone), F.col("_row_key") == F.col("_gone"), "left_anti")
    met = (F.col("_row_key") == F.col("_other")) & F.col("lang").cast("string").eqNullSafe(F.col("_was"))
    corrected = kept.join(checked_broadcast(other), met, "left").withColumn("lang", F.coalesce("_lang", F.col("lang").cast("string")).cast(docs.schema["lang"].dataType))
    return corrected.select(*docs.columns)
