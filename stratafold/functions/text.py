"""Scalar text functions as Columns: titles, slugs, labels, markdown blocks and images, embedded scripts.

Built-ins throughout. Python is used where Spark has no built-in: Unicode
normal forms (texts of ASCII alone pass by) and balanced braces.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

IMAGE = r"!\[\]\(/images/(?:[^()/\s]+/)*([0-9A-Za-z]+)\.[A-Za-z]+\)"


def _lit(value: str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def trimmed(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^[\s﻿]+|[\s﻿]+$", "")


def text(c: Column) -> Column:
    """The trimmed text; null for null and for nothing but white space."""
    return F.nullif(trimmed(c), F.lit(""))


def _normalizer(form: str):
    @pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else unicodedata.normalize(form, x))

    return run


def normalized(c: Column, form: str = "NFC") -> Column:
    """Unicode normal form; a text of ASCII alone isn't sent to Python."""
    ascii_ = c.rlike(r"^[\x00-\x7F]*$")
    return F.when(ascii_, c).otherwise(_normalizer(form)(F.when(~ascii_, c)))


def title_key(c: Column, ascii_only: bool = False) -> Column:
    """A title without apostrophes, its quotes straight and its letters composed; case stays."""
    c = c if ascii_only else normalized(c, "NFC")
    return F.regexp_replace(F.translate(c, "“”", '""'), "[‘’ʼ']", "")


def title_text(value: str) -> str:
    """`title_key` of a text that is at hand."""
    return re.sub("[‘’ʼ']", "", unicodedata.normalize("NFC", value).translate(str.maketrans("“”", '""')))


def slug(c: Column, ascii_only: bool = False) -> Column:
    """Lower-case runs of a-z and 0-9 joined by hyphens, after compatibility decomposition."""
    c = c if ascii_only else normalized(c, "NFKD")
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def alnum_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def _capitalised(words: Column) -> Column:
    return F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2))))


def title_case(c: Column, by: str = "-") -> Column:
    """Words parted by `by`, each with a capital first, by spaces; the rest of a word stays as it is."""
    return F.concat_ws(" ", _capitalised(F.split(c, f"[{by}]")))


def pretty_name(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """The alias, or the name with spaces before inner capitals and a capital at each word."""
    plain = F.concat_ws(" ", _capitalised(F.split(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"), " ")))
    if not aliases:
        return plain
    table = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    return F.coalesce(F.element_at(table, c), plain)


def clean_name(c: Column) -> Column:
    """The last part of a path without a trailing parenthesis and without 'token' or 'counter'."""
    return trimmed(F.regexp_replace(F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\s*\([^()]*\)\s*$", ""), r"(?i)\s+(token|counter)s?$", ""))


def doc_family(c: Column) -> Column:
    """The part before the first hyphen."""
    return F.split(c, "-")[0]


def singular(word: Column) -> Column:
    """A word in -ves with f, any other longer word in -s without it."""
    return F.when(word.rlike("ves$"), F.regexp_replace(word, "ves$", "f")).when(word.rlike("(?s).s$"), F.regexp_replace(word, "s$", "")).otherwise(word)


def name_variants(c: Column) -> Column:
    """The name as `title_key` has it, and that with one word at a time made singular."""

    def of(key: Column) -> Column:
        words = F.split(key, " ")
        each = F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.concat_ws(" ", F.transform(words, lambda w, j: F.when(i == j, singular(w)).otherwise(w))))
        return F.array_distinct(F.concat(F.array(key), each))

    return F.get(F.transform(F.array(title_key(c)), of), F.lit(0))  # the key is made once


def heads(c: Column) -> Column:
    """The name's first word, first two words, ..., the whole name."""
    words = F.split(c, " ")
    return F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))


def title_or_prefix_key(c: Column) -> Column:
    """The beginnings in whole words of a title's key, in lower case."""
    return F.get(F.transform(F.array(F.lower(title_key(c))), heads), F.lit(0))


def title_forms(c: Column) -> Column:
    """Variants, and the plural by s."""
    return F.array_distinct(F.concat(name_variants(c), F.array(F.concat(title_key(c), F.lit("s")))))


def first_mapped(c: Column, table: dict[str, str], default: str | None = None) -> Column:
    """The value of the first array element that the table holds."""
    known = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.get(F.filter(F.transform(c, lambda x: F.element_at(known, x)), lambda v: v.isNotNull()), F.lit(0)), F.lit(default))


def case_map(c: Column, contains: dict[str, str], exact: dict[str, str] | None = None, strict: bool = False) -> Column:
    """The value of the first substring rule that holds, then of an equal name; with `strict` an unknown name is an error."""
    out = None
    for k, v in contains.items():
        out = (F if out is None else out).when(F.contains(F.lower(c), F.lit(k.lower())), F.lit(v))
    for k, v in (exact or {}).items():
        out = (F if out is None else out).when(c == k, F.lit(v))
    last = F.raise_error(F.concat(F.lit("unknown name: "), F.coalesce(c, F.lit("null")))).cast("string") if strict else F.lit(None).cast("string")
    return last if out is None else out.otherwise(last)


def count_label(n: Column, thing: str, plural: str | None = None) -> Column:
    """'1 thing', '2 things'; null for 0."""
    return F.when(n > 0, F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, F.lit(thing)).otherwise(F.lit(plural or thing + "s"))))


def join_labels(*labels: Column, by: str = " · ") -> Column:
    """Labels that aren't null, joined."""
    return F.concat_ws(by, *labels)


def positive_only(m: Column) -> Column:
    """A sparse record's positive numbers."""
    return F.map_filter(m, lambda _, v: v > 0)


# -- Replacing --------------------------------------------------------------


def replace_first(c: Column, find: str | Column, to: str | Column) -> Column:
    """The first occurrence replaced; in `to`, $& is what was found, $` what stands before, $' what follows, $$ a dollar."""
    find, to = _lit(find), _lit(to)
    at = F.position(find, c)
    before, after = F.substr(c, F.lit(1), at - 1), F.substr(c, at + F.length(find))
    mark = F.lit("\0")
    filled = F.replace(F.replace(to, F.lit("$$"), mark), F.lit("$&"), find)
    filled = F.replace(F.replace(filled, F.lit("$`"), before), F.lit("$'"), after)
    return F.when((at > 0) & (F.length(find) > 0), F.concat(before, F.replace(filled, mark, F.lit("$")), after)).otherwise(c)


def squeezed(c: Column) -> Column:
    """Three and more line ends as two, without white space at the ends."""
    return trimmed(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def image_hashes(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(IMAGE), 1)


def _one_image(h: str) -> str:
    return rf"!\[\]\(/images/(?:[^()/\s]+/)*{h}\.[A-Za-z]+\)"


def strip_images(c: Column, hashes: list[str]) -> Column:
    """Without references to these images; a text without any stays as it is."""
    pattern = _one_image(f"(?:{'|'.join(hashes)})")
    return F.when(c.rlike(pattern), squeezed(F.regexp_replace(c, pattern, ""))).otherwise(c)


def dedupe_images(c: Column, hashes: list[str]) -> Column:
    """Only the first reference to each of these images."""
    out = c
    for h in hashes:
        one = _one_image(h)
        whole = F.regexp_extract(out, f"({one})", 1)
        end = F.position(whole, out) + F.length(whole)
        rest = F.substr(out, end)
        out = F.when(rest.rlike(one) & (whole != ""), squeezed(F.concat(F.substr(out, F.lit(1), end - 1), F.regexp_replace(rest, one, "")))).otherwise(out)
    return out


# -- Blocks -----------------------------------------------------------------


def blocks(c: Column) -> Column:
    """Markdown blocks: what blank lines part, without empty ones."""
    return F.filter(F.split(c, r"\n{2,}"), lambda b: trimmed(b) != "")


def content_nodes(c: Column) -> Column:
    """Blocks as nodes (kind, markdown, images): image (nothing but images), mediaAside (images first), markdown."""
    lead = rf"^((?:{IMAGE}\s*)+)"

    def node(b: Column) -> Column:
        images = F.regexp_extract(b, lead, 1)
        rest = trimmed(F.substr(b, F.length(images) + 1))
        kind = F.when(images == "", F.lit("markdown")).when(rest == "", F.lit("image")).otherwise(F.lit("mediaAside"))
        return F.struct(kind.alias("kind"), rest.alias("markdown"), image_hashes(images).alias("images"))

    return F.transform(blocks(c), node)


def nodes_to_markdown(nodes: Column) -> Column:
    """The inverse of content_nodes for png images."""
    one = lambda n: F.trim(F.concat_ws("\n", F.array_join(F.transform(n["images"], lambda h: F.concat(F.lit("![](/images/"), h, F.lit(".png)"))), "\n"), n["markdown"]), F.lit("\n"))
    return F.array_join(F.transform(nodes, one), "\n\n")


def block_anchor(b: Column) -> Column:
    """The slug of a block's bold label, numbered phrase or capitalised label before a colon; null without one."""
    bold = F.regexp_extract(b, r"^\*\*([^*]+?)[:.]?\*\*", 1)
    number = F.regexp_extract(b, r"^\d+[.)]\s+([^.:\n]+)", 1)
    label = F.regexp_extract(b, r"^(\p{Lu}[^.:\n]{0,40}):", 1)
    return F.coalesce(*(F.when(x != "", slug(x, ascii_only=True)) for x in (bold, number, label)))


def anchored_slice(c: Column, anchor: str) -> Column:
    """Blocks from the one with this anchor up to the next that has any."""
    marked = F.transform(blocks(c), lambda b, i: F.struct(i.alias("i"), b.alias("b"), block_anchor(b).alias("a")))
    first = F.array_min(F.transform(F.filter(marked, lambda m: F.startswith(m["a"], F.lit(anchor))), lambda m: m["i"]))
    next_ = F.array_min(F.transform(F.filter(marked, lambda m: m["a"].isNotNull() & (m["i"] > first)), lambda m: m["i"]))
    return F.transform(F.filter(marked, lambda m: (m["i"] >= first) & (next_.isNull() | (m["i"] < next_))), lambda m: m["b"])


def block_range(c: Column, start: int, end: int) -> Column:
    """Blocks start..end, both included, in either order of bounds."""
    low, high = sorted((start, end))
    return F.slice(blocks(c), low + 1, high - low + 1)


def footer_split(c: Column, legal: str = r"(?i)copyright|©|all rights reserved") -> Column:
    """(body, footer): the footer is the trailing run of two or more images, or of one beside legal words; null without one."""
    tail = F.regexp_extract(c, rf"((?:{IMAGE}\s*)+(?:[^!]*)?)$", 1)
    images = F.size(image_hashes(tail))
    hit = (images >= 2) | ((images == 1) & tail.rlike(legal))
    return F.struct(F.when(hit, trimmed(F.substr(c, F.lit(1), F.length(c) - F.length(tail)))).otherwise(c).alias("body"), F.when(hit, tail).alias("footer"))


def link_preview(c: Column, children: Column | None = None) -> Column:
    """(icons, markdown): leading images become icons; children (title, content) follow under '### title'."""
    lead = F.regexp_extract(c, rf"^((?:{IMAGE}\s*)+)", 1)
    rest = trimmed(F.substr(c, F.length(lead) + 1))
    parts = F.array(rest) if children is None else F.concat(F.array(rest), F.transform(children, lambda x: F.concat(F.lit("### "), x["title"], F.lit("\n\n"), x["content"])))
    return F.struct(image_hashes(lead).alias("icons"), F.array_join(F.filter(parts, lambda p: p != ""), "\n\n").alias("markdown"))


# -- Embedded scripts -------------------------------------------------------


@pandas_udf(StringType())
def _braced(s: pd.Series, name: pd.Series) -> pd.Series:
    def one(source: str | None, key: str) -> str | None:
        at = (source or "").find(key)
        at = source.find("{", at) if at >= 0 else -1
        depth, end = 0, at
        while 0 <= end < len(source):
            depth += (source[end] == "{") - (source[end] == "}")
            end += 1
            if not depth:
                return source[at:end]
        return None

    return pd.Series([one(a, b) for a, b in zip(s, name)])


def braced_table(c: Column, name: str) -> Column:
    """The brace-balanced table that follows `name` in a script."""
    return _braced(c, F.lit(name))


def function_body(c: Column, name: str) -> Column:
    """From 'function name' to the next function at a line's beginning."""
    return F.regexp_extract(c, rf"(?s)(function {name}\b.*?)(?=\nfunction |\z)", 1)


def assignments(c: Column) -> Column:
    """name -> number for lines 'name = number', later lines first to last, zeros dropped."""
    rows = F.regexp_extract_all(c, F.lit(r"(?m)^\s*\w+\s*=\s*-?\d+"), 0)
    pairs = F.transform(rows, lambda r: F.struct(trimmed(F.split(r, "=")[0]).alias("k"), F.split(r, "=")[1].cast("int").alias("v")))
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"] != 0))


def calls(c: Column, name: str) -> Column:
    """Arguments of each call of a function, in order, as arrays of trimmed strings."""
    return F.transform(F.regexp_extract_all(c, F.lit(rf"{name}\(([^()]*)\)"), 1), lambda a: F.transform(F.split(a, ","), lambda x: F.regexp_replace(trimmed(x), "^\"|\"$", "")))
