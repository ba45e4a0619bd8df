"""Queries of the library's own operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.functions import text as tx
from stratafold.operators import aggregates as ag
from stratafold.operators import derived, entities, hierarchy, joins, layout, ordered, pages, rules, tree
from stratafold.plans import target as tg
from stratafold.session import ship
from stratafold.sources import sinks, web

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "derived_grouped"


class Tables:
    """The driver's tables by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(Tables(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# -- A section table of the geography: regions, nations, customers ----------


def sections(t: Tables) -> DataFrame:
    """source, ord, id, level, title, content, tags: a document per region."""
    none = "CAST(NULL AS array<string>) AS tags"
    top = t.region.selectExpr("r_name AS source", "CAST(r_regionkey + 1 AS BIGINT) * 1000000000000 AS ord", "CAST(r_regionkey + 1 AS STRING) AS id", "1 AS level", "r_name AS title", "'' AS content", none)
    nation = t.nation.join(t.region, F.expr("n_regionkey = r_regionkey"))
    middle = nation.selectExpr("r_name AS source", "CAST(r_regionkey + 1 AS BIGINT) * 1000000000000 + CAST(n_nationkey + 1 AS BIGINT) * 1000000000 AS ord", "concat_ws('.', r_regionkey + 1, n_nationkey + 1) AS id", "2 AS level", "n_name AS title", "concat('nation of ', r_name) AS content", "array('nation') AS tags")
    low = t.customer.join(nation, F.expr("c_nationkey = n_nationkey")).selectExpr("r_name AS source", "CAST(r_regionkey + 1 AS BIGINT) * 1000000000000 + CAST(n_nationkey + 1 AS BIGINT) * 1000000000 + c_custkey + 1 AS ord", "concat_ws('.', r_regionkey + 1, n_nationkey + 1, c_custkey) AS id", "3 AS level", "c_name AS title", "c_mktsegment AS content", "array('customer', lower(c_mktsegment)) AS tags")
    return top.unionByName(middle).unionByName(low)


SECTIONS_SQL = """
nations AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey),
sections AS (
  SELECT r_name AS source, CAST(r_regionkey + 1 AS BIGINT) * 1000000000000 AS ord, CAST(r_regionkey + 1 AS VARCHAR) AS id, 1 AS level, r_name AS title, '' AS content, CAST(NULL AS VARCHAR[]) AS tags FROM region
  UNION ALL SELECT r_name, CAST(r_regionkey + 1 AS BIGINT) * 1000000000000 + CAST(n_nationkey + 1 AS BIGINT) * 1000000000, concat_ws('.', r_regionkey + 1, n_nationkey + 1), 2, n_name, 'nation of ' || r_name, ['nation'] FROM nations
  UNION ALL SELECT r_name, CAST(r_regionkey + 1 AS BIGINT) * 1000000000000 + CAST(n_nationkey + 1 AS BIGINT) * 1000000000 + c_custkey + 1, concat_ws('.', r_regionkey + 1, n_nationkey + 1, c_custkey), 3, c_name, c_mktsegment, ['customer', lower(c_mktsegment)]
  FROM customer JOIN nations ON c_nationkey = n_nationkey
)
"""


def _shown(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ",").alias("tags"))


_SHOWN = "array_to_string(coalesce(tags, []), ',') AS tags"

# -- Selectors --------------------------------------------------------------


@query(f"WITH {SECTIONS_SQL} SELECT id, title FROM sections WHERE regexp_matches(title, '[13]$') AND level IN (2, 3)")
def target_leaf_regex_level(t):
    return tg.select(sections(t), tg.Leaf(title="[13]$", levels=(2, 3))).select("id", "title")


@query(f"WITH {SECTIONS_SQL} SELECT id FROM sections WHERE source = 'ASIA' AND list_contains(tags, 'customer') AND list_contains(tags, 'building')")
def target_doc_gate_and_tags(t):
    return tg.select(sections(t), tg.Leaf(doc="ASIA", tags=("customer", "building"))).select("id")


@query(f"WITH {SECTIONS_SQL} SELECT count(*) AS n FROM sections")
def target_all(t):
    return tg.select(sections(t), tg.All()).agg(F.count("*").alias("n"))


@query(f"WITH {SECTIONS_SQL} SELECT id, content FROM sections WHERE level = 3 AND NOT regexp_matches(content, 'BUILDING|MACHINERY')")
def target_and_not(t):
    return tg.select(sections(t), tg.And((tg.Leaf(levels=(3,)), tg.Not(tg.Leaf(content="BUILDING|MACHINERY"))))).select("id", "content")


@query(f"WITH {SECTIONS_SQL} SELECT CAST(0 AS BIGINT) AS empty_and, CAST(0 AS BIGINT) AS not_doc, count(*) FILTER (WHERE level <> 2) AS not_level, count(*) AS not_and FROM sections")
def target_empty_and_not_doc(t):
    s = sections(t)
    asked = {"empty_and": tg.And(), "not_doc": tg.Not(tg.Leaf(doc="ASIA")), "not_level": tg.Not(tg.Leaf(levels=(2,))), "not_and": tg.Not(tg.And())}
    for name, target in asked.items():
        s = tg.matching(s, target, name)
    return s.agg(*(F.count_if(F.col(n)).alias(n) for n in asked))


@query(f"WITH {SECTIONS_SQL} SELECT s.id, s.title FROM sections s WHERE EXISTS (SELECT 1 FROM sections p WHERE p.source = s.source AND p.title = 'NATION_3' AND starts_with(s.id, p.id || '.')) AND NOT regexp_matches(s.content, 'HOUSEHOLD')")
def target_children_of(t):
    return tg.select(sections(t), tg.And((tg.ChildrenOf(tg.Leaf(title="^NATION_3$")), tg.Not(tg.Leaf(content="HOUSEHOLD"))))).select("id", "title")


@query(f"WITH {SECTIONS_SQL} SELECT s.id FROM sections s WHERE s.level = 1 OR EXISTS (SELECT 1 FROM sections p WHERE p.source = s.source AND p.title = 'NATION_5' AND starts_with(s.id, p.id || '.'))")
def target_or_existence(t):
    return tg.select(sections(t), tg.Or((tg.Leaf(levels=(1,)), tg.ChildrenOf(tg.Leaf(title="^NATION_5$"))))).select("id")


@query(f"WITH {SECTIONS_SQL} SELECT s.id FROM sections s WHERE EXISTS (SELECT 1 FROM sections p WHERE p.source = s.source AND p.level = 2 AND starts_with(s.id, p.id || '.'))")
def target_nested_children(t):
    return tg.select(sections(t), tg.ChildrenOf(tg.ChildrenOf(tg.Leaf(levels=(1,))))).select("id")


# -- Hierarchy --------------------------------------------------------------


@query("""
WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber * 1000000000000 + l_partkey AS l_linenumber, CAST(1 + l_partkey % 4 AS INTEGER) AS level FROM lineitem),
g AS (SELECT *, sum((level < 1)::INT) OVER w AS g1, sum((level < 2)::INT) OVER w AS g2, sum((level < 3)::INT) OVER w AS g3, sum((level < 4)::INT) OVER w AS g4 FROM l
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
n AS (SELECT *, sum((level = 1)::INT) OVER (PARTITION BY l_orderkey, g1 ORDER BY l_linenumber) AS n1, sum((level = 2)::INT) OVER (PARTITION BY l_orderkey, g2 ORDER BY l_linenumber) AS n2,
  sum((level = 3)::INT) OVER (PARTITION BY l_orderkey, g3 ORDER BY l_linenumber) AS n3, sum((level = 4)::INT) OVER (PARTITION BY l_orderkey, g4 ORDER BY l_linenumber) AS n4 FROM g)
SELECT l_orderkey, l_linenumber, level, array_to_string(list_slice([n1, n2, n3, n4], 1, level), '.') AS id FROM n
""")
def assign_ids(t):
    rows = t.lineitem.selectExpr("l_orderkey", "l_linenumber * 1000000000000 + l_partkey AS l_linenumber", "CAST(1 + l_partkey % 4 AS INT) AS level").distinct()
    return hierarchy.numbered(rows, "l_orderkey", "l_linenumber", levels=4)


@query(f"""WITH {SECTIONS_SQL} SELECT c.id, c.title FROM sections a JOIN sections b ON b.source = a.source AND starts_with(b.id, a.id || '.') JOIN sections c ON c.source = b.source AND starts_with(c.id, b.id || '.')
WHERE a.title IN ('ASIA', 'EUROPE') AND b.title IN ('NATION_2', 'NATION_3', 'NATION_7') AND regexp_matches(c.title, '^Customer#00000[01][0-9]{{3}}$')""")
def heading_path(t):
    names = "|".join(f"Customer#{n:09d}" for n in range(2000))
    return hierarchy.heading_path(sections(t), ["ASIA|EUROPE", "NATION_2|NATION_3:|NATION_7.", names]).select("id", "title")


@query("SELECT l_orderkey, CAST(floor(least(8, greatest(1, sum(l_quantity) / 20))) AS INTEGER) AS level FROM lineitem GROUP BY 1")
def level_clamp(t):
    return t.lineitem.groupBy("l_orderkey").agg((F.sum("l_quantity") / 20).alias("x")).select("l_orderkey", F.floor(hierarchy.clamp_level(F.col("x"))).cast("int").alias("level"))


# -- Rules ------------------------------------------------------------------


@query(f"""WITH {SECTIONS_SQL}, a AS (SELECT * REPLACE (CASE WHEN level = 3 AND regexp_matches(content, 'BUILDING') THEN list_concat(tags, ['built']) ELSE tags END AS tags) FROM sections),
b AS (SELECT * REPLACE (CASE WHEN list_contains(coalesce(tags, []), 'built') THEN 'Builder' ELSE title END AS title) FROM a),
c AS (SELECT * REPLACE (CASE WHEN title = 'Builder' AND strpos(content, 'BUILD') > 0 THEN 'made' || substr(content, strpos(content, 'BUILD') + 5) ELSE content END AS content) FROM b)
SELECT id, title, content, {_SHOWN} FROM c""")
def rule_pipeline(t):
    ordered_rules = [rules.add_tag(tg.Leaf(levels=(3,), content="BUILDING"), "built", "customer"), rules.replace_title(tg.Leaf(tags=("built",)), "Builder"), rules.replace_text(tg.Leaf(title="^Builder$"), "BUILD", "made")]
    return _shown(rules.apply(sections(t), ordered_rules), "id", "title", "content")


@query(f"""WITH {SECTIONS_SQL}, r AS (SELECT * REPLACE (CASE title WHEN 'NATION_1' THEN 'Red Spells' WHEN 'NATION_2' THEN 'Blue Spells' ELSE title END AS title) FROM sections)
SELECT s.id, array_to_string(CASE WHEN p.title IS NULL THEN coalesce(s.tags, []) ELSE list_concat(s.tags, ['spell', CASE p.title WHEN 'Red Spells' THEN 'redMagic' ELSE 'blueMagic' END]) END, ',') AS tags
FROM r s LEFT JOIN r p ON p.title IN ('Red Spells', 'Blue Spells') AND p.source = s.source AND starts_with(s.id, p.id || '.')""")
def rule_generator_children_tags(t):
    named = sections(t).withColumn("title", F.expr("CASE title WHEN 'NATION_1' THEN 'Red Spells' WHEN 'NATION_2' THEN 'Blue Spells' ELSE title END"))
    return _shown(rules.apply(named, rules.colour_rules(["Red", "Blue"])), "id")


@query("SELECT doc_id, CASE WHEN strpos(text, ' the ') > 0 THEN substr(text, 1, strpos(text, ' the ') - 1) || '[ the ]$' || substr(text, strpos(text, ' the ') + 5) ELSE text END AS text FROM documents")
def replace_first(t):
    return t.documents.select("doc_id", tx.replace_first(F.col("text"), " the ", "[$&]$$").alias("text"))


@query("""WITH b AS (SELECT user_id, min(event_id) AS f FROM events WHERE event_type = 'purchase' GROUP BY 1), e AS (SELECT b.user_id, min(f) AS f, min(event_id) AS l FROM b JOIN events USING (user_id) WHERE event_type = 'error' AND event_id >= f GROUP BY 1)
SELECT events.user_id, event_id, CASE WHEN event_id = f THEN 'placeholder' ELSE event_type END AS event_type FROM events LEFT JOIN e ON e.user_id = events.user_id WHERE l IS NULL OR event_id <= f OR event_id > l""")
def replace_range(t):
    rows = t.events.select("user_id", "event_id", "event_type")
    return ordered.replace_range(rows, "user_id", "event_id", F.col("event_type") == "purchase", F.col("event_type") == "error", {"event_type": F.lit("placeholder")})


_IMAGES = "concat(p_name, '\n\n![](/images/a1.png)\n\n', p_brand, ' ![](/images/x/b2.png)\n\n![](/images/a1.png) end')"
_IMAGES_SQL = "p_name || chr(10) || chr(10) || '![](/images/a1.png)' || chr(10) || chr(10) || p_brand || ' ![](/images/x/b2.png)' || chr(10) || chr(10) || '![](/images/a1.png) end'"


@query(f"SELECT p_partkey, replace(replace({_IMAGES_SQL}, chr(10) || chr(10) || '![](/images/a1.png)' || chr(10) || chr(10), chr(10) || chr(10)), '![](/images/a1.png)', '') AS text FROM part")
def strip_images(t):
    return t.part.select("p_partkey", tx.strip_images(F.expr(_IMAGES), ["a1"]).alias("text"))


@query(f"SELECT p_partkey, substr({_IMAGES_SQL}, 1, length({_IMAGES_SQL}) - 23) || ' end' AS text FROM part")
def dedupe_images(t):
    return t.part.select("p_partkey", tx.dedupe_images(F.expr(_IMAGES), ["a1", "b2"]).alias("text"))


@query("""SELECT CAST(event_id % 10 AS BIGINT) AS source, CAST(sum((event_type = 'error')::INT) AS BIGINT) AS changed FROM events GROUP BY 1""")
def changed_rows(t):
    rows = t.events.selectExpr("event_id % 10 AS source", "event_id AS ord", "event_type")
    return rules.changed_rows(rows, rows.withColumn("event_type", F.when(F.col("event_type") == "error", "fault").otherwise(F.col("event_type"))))


# -- Derived relations ------------------------------------------------------


@query(f"WITH {SECTIONS_SQL} SELECT row_number() OVER (ORDER BY title, source, ord) AS place, id, title FROM sections WHERE level = 2")
def derived_flat(t):
    return derived.flat(sections(t), tg.Leaf(levels=(2,))).select("place", "id", "title")


@query(f"""WITH {SECTIONS_SQL}, p AS (SELECT *, row_number() OVER (ORDER BY title, source, ord) AS k FROM sections WHERE level = 2 AND regexp_matches(title, '_1$|_2$')),
r AS (SELECT k, 0 AS own, id, ord FROM p UNION ALL SELECT p.k, 1, s.id, s.ord FROM p JOIN sections s ON s.source = p.source AND starts_with(s.id, p.id || '.'))
SELECT row_number() OVER (ORDER BY k, own, ord) AS place, id FROM r""")
def derived_flat_with_children(t):
    return derived.flat(sections(t), tg.Leaf(levels=(2,), title="_1$|_2$"), with_children=True).select("place", "id")


@query(f"""WITH {SECTIONS_SQL}, g(n, h) AS (VALUES (0, 'ASIA'), (1, 'AFRICA')), r AS (SELECT n, 0 AS part, source, ord, title, 1 AS level FROM g JOIN sections ON title = h UNION ALL SELECT n, 1, source, ord, title, 2 FROM g JOIN sections ON source = h AND sections.level = 2)
SELECT row_number() OVER (ORDER BY n, part, title, source, ord) AS place, title, level FROM r""")
def derived_grouped(t):
    groups = [derived.Group(tg.Leaf(title=f"^{r}$"), tg.Leaf(doc=r, levels=(2,))) for r in ("ASIA", "AFRICA")] + [derived.Group(tg.Leaf(title="^none$"), tg.Leaf(levels=(2,)))]
    return derived.grouped(sections(t), groups).select("place", "title", "level")


@query(f"""WITH {SECTIONS_SQL}, m AS (SELECT *, regexp_matches(title, '^ASIA$|^NATION_[0-9]$') AS hit FROM sections), r AS (
  SELECT 0 AS g, -1 AS i, NULL AS ms, NULL AS mo, 0 AS k, 0 AS ord, 'player-aid' AS source, '1' AS id, 'First' AS title, 1 AS level, 'syntheticHeader' AS tag UNION ALL SELECT 1, -1, NULL, NULL, 0, 0, 'player-aid', '2', 'Second', 1, 'syntheticHeader'
  UNION ALL SELECT 0, 0, source, ord, 0, ord, source, id, title, 2, array_to_string(tags, ',') FROM m WHERE hit
  UNION ALL SELECT 0, 0, p.source, p.ord, 1, s.ord, s.source, s.id, s.title, 2 + s.level - p.level, array_to_string(s.tags, ',') FROM sections s JOIN m p ON p.hit AND p.source = s.source AND starts_with(s.id, p.id || '.')
  UNION ALL SELECT 1, 0, source, ord, 0, ord, source, id, title, 2, array_to_string(tags, ',') FROM sections WHERE level = 2),
o AS (SELECT *, row_number() OVER (PARTITION BY source, id ORDER BY g, i, ms, mo, k, ord) AS n FROM r)
SELECT row_number() OVER (ORDER BY g, i, ms NULLS FIRST, mo NULLS FIRST, k, ord) AS place, source, id, title, level, coalesce(tag, '') AS tag FROM o WHERE n = 1""")
def player_aid_keep_first(t):
    aid = [derived.AidGroup("First", (derived.Pick(tg.Leaf(title="^ASIA$|^NATION_[0-9]$"), True),)), derived.AidGroup("Second", (derived.Pick(tg.Leaf(levels=(2,))),))]
    return derived.player_aid(sections(t), aid).select("place", "source", "id", "title", "level", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ",").alias("tag"))


@query("""WITH d AS (SELECT lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS k, list_sort(list(DISTINCT l_shipmode)) AS decks FROM part JOIN (SELECT l_partkey, l_returnflag AS l_shipmode FROM lineitem) ON l_partkey = p_partkey WHERE p_size < 10 GROUP BY 1),
s AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 3 = 0 THEN ['treasure', p_type] ELSE [p_type] END AS tags FROM part)
SELECT p_partkey, array_to_string(CASE WHEN d.k IS NOT NULL AND list_contains(tags, 'treasure') THEN list_concat([x for x in tags if x <> 'treasure'], decks) ELSE tags END, ',') AS tags FROM s LEFT JOIN d ON d.k = lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g'))""")
def tag_reclassify(t):
    items = t.part.selectExpr("p_partkey", "p_brand AS title", "CASE WHEN p_partkey % 3 = 0 THEN array('treasure', p_type) ELSE array(p_type) END AS tags")
    decks = t.lineitem.join(t.part.filter("p_size < 10"), F.expr("l_partkey = p_partkey")).selectExpr("p_brand AS title", "l_returnflag AS deck")
    return derived.reclassified(items, decks, ["treasure"]).select("p_partkey", F.array_join("tags", ",").alias("tags"))


# -- Grouping ---------------------------------------------------------------


@query("""WITH l AS (SELECT *, printf('%012d.%02d.%09d', l_orderkey, l_linenumber, l_suppkey) AS ord FROM lineitem), p AS (SELECT l_partkey, l_returnflag, count(*) AS c, min(ord) AS o FROM l GROUP BY ALL)
SELECT l_partkey, copies, first_supp, locations FROM (SELECT l_partkey, count(*) AS copies, arg_min(l_suppkey, ord) AS first_supp FROM l GROUP BY 1) JOIN (SELECT l_partkey, string_agg(l_returnflag || ':' || c, ',' ORDER BY o) AS locations FROM p GROUP BY 1) USING (l_partkey)""")
def dedup_merge_counts(t):
    rows = t.lineitem.withColumn("ord", F.format_string("%012d.%02d.%09d", "l_orderkey", "l_linenumber", "l_suppkey"))
    out = ag.merged(rows, ["l_partkey"], "ord", first=["l_suppkey"], place="l_returnflag")
    return out.select("l_partkey", "copies", F.col("l_suppkey").alias("first_supp"), F.array_join(F.transform("locations", lambda x: F.concat(x["value"], F.lit(":"), x["count"].cast("string"))), ",").alias("locations"))


@query("""WITH d AS (SELECT l_orderkey, l_returnflag, min(l_linenumber) AS o FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY o, l_returnflag) AS flags FROM d GROUP BY 1""")
def group_into_buckets(t):
    out = ag.bucketed(t.lineitem, "l_orderkey", ["l_returnflag"], "l_linenumber")
    return out.select("l_orderkey", F.array_join(F.transform("rows", lambda r: r["l_returnflag"]), ",").alias("flags"))


@query("SELECT o_custkey, CAST(sum(n) AS BIGINT) AS n, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS tags FROM (SELECT o_custkey, 1 AS n, [o_orderstatus] AS tags FROM orders UNION ALL SELECT c_custkey, 2, [c_mktsegment] FROM customer) GROUP BY 1")
def cross_source_merge(t):
    a = t.orders.selectExpr("o_custkey", "1 AS n", "array(o_orderstatus) AS tags")
    b = t.customer.selectExpr("c_custkey AS o_custkey", "2 AS n", "array(c_mktsegment) AS tags")
    return ag.united(a, b, "o_custkey", ["n"], ["tags"]).select("o_custkey", "n", F.array_join("tags", ",").alias("tags"))


@query("SELECT user_id, arg_min(event_type, event_id) FILTER (WHERE event_type <> 'view') AS first_type FROM events GROUP BY 1")
def fill_first_non_null(t):
    rows = t.events.withColumn("kind", F.when(F.col("event_type") != "view", F.col("event_type")))
    return rows.groupBy("user_id").agg(ordered.first_non_null("kind", "event_id").alias("first_type"))


@query("SELECT l_returnflag, l_linestatus, n, round(n * 100 / sum(n) OVER (PARTITION BY l_returnflag), 6) AS pct FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)")
def ratio_within_group(t):
    return ag.share(t.lineitem, ["l_linestatus"], ["l_returnflag"])


@query("SELECT event_type, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM events), 6) AS pct FROM events GROUP BY 1")
def ratio_to_total(t):
    return ag.share(t.events, ["event_type"], [])


@query("SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS flag FROM lineitem GROUP BY 1")
def unique_value(t):
    return t.lineitem.groupBy("l_orderkey").agg(ag.unique_value(F.col("l_returnflag")).alias("flag"))


@query("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_quantity > 10)")
def relational_division(t):
    return ag.every(t.lineitem, "l_orderkey", F.col("l_quantity") > 10)


@query("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'R') AND NOT bool_and(l_returnflag = 'R')")
def exists_not_all(t):
    return ag.some_not_all(t.lineitem, "l_orderkey", F.col("l_returnflag") == "R")


@query("SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_quantity > 25) AS large FROM lineitem GROUP BY 1")
def conditional_counts(t):
    return ag.conditional_counts(t.lineitem, "l_suppkey", {"returned": F.col("l_returnflag") == "R", "large": F.col("l_quantity") > 25})


@query("SELECT p_brand, string_agg(p_type || ':' || n, ',' ORDER BY p_type) AS entries, count(*) AS cards, CAST(sum(n) AS BIGINT) AS copies FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY 1")
def per_group_subtotals(t):
    out = ag.nested_subtotals(t.part.withColumn("copies", F.lit(1)), "p_brand", "p_type", "copies")
    return out.select("p_brand", F.array_join(F.transform("entries", lambda e: F.concat(e["p_type"], F.lit(":"), e["copies"].cast("string"))), ",").alias("entries"), "cards", "copies")


@query("""WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents), p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY 1), b AS (SELECT source, line FROM l JOIN p USING (source) GROUP BY source, line, pages HAVING count(DISTINCT doc_id) > pages * 0.02)
SELECT doc_id, count(*) AS lines FROM l WHERE (source, line) NOT IN (SELECT (source, line) FROM b) GROUP BY 1""")
def frequency_filter(t):
    lines = t.documents.select("doc_id", "source", F.explode(F.split("text", "\n")).alias("line"))
    return ag.frequent_removed(lines, "line", "doc_id", ["source"], most_share=0.02).groupBy("doc_id").agg(F.count("*").alias("lines"))


@query("""WITH p AS (SELECT n_name AS pack FROM nation UNION SELECT r_name FROM region) SELECT pack, coalesce(s, '') AS suppliers, coalesce(c, '') AS segments FROM p
LEFT JOIN (SELECT n_name, string_agg(DISTINCT s_name, ',' ORDER BY s_name) AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) a ON a.n_name = pack
LEFT JOIN (SELECT n_name, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) b ON b.n_name = pack""")
def mega_rollup(t):
    s = t.supplier.join(t.nation, F.expr("s_nationkey = n_nationkey"))
    c = t.customer.join(t.nation, F.expr("c_nationkey = n_nationkey"))
    out = ag.pack_rollup([(t.nation, "n_name"), (t.region, "r_name")], {"suppliers": (s, "n_name", "s_name"), "segments": (c, "n_name", "c_mktsegment")})
    return out.select("pack", F.array_join("suppliers", ",").alias("suppliers"), F.array_join("segments", ",").alias("segments"))


@query("SELECT l_returnflag, round(median(l_quantity), 6) AS l_quantity, round(median(l_extendedprice), 6) AS l_extendedprice FROM lineitem GROUP BY 1")
def median_features(t):
    return layout.medians(t.lineitem, ["l_returnflag"], ["l_quantity", "l_extendedprice"])


@query("SELECT sha1(text) AS hash, count(*) AS seen, count(DISTINCT doc_id) AS pages, max(CAST(n_chars AS DOUBLE)) AS coverage, min(doc_id) AS first_page FROM documents GROUP BY 1")
def content_hash_dedup(t):
    return sinks.content_addressed(t.documents.withColumn("c", F.col("n_chars").cast("double")), "text", "doc_id", "c")


# -- Order ------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM (SELECT p_partkey, base, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS n FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS base FROM part))")
def dup_slug_suffix(t):
    rows = t.part.select("p_partkey", tx.slug(F.col("p_type"), ascii_only=True).alias("base"))
    return ordered.suffixed(rows, "base", ["p_partkey"]).select("p_partkey", "slug")


@query("SELECT s_nationkey, arg_min(s_suppkey, (CASE WHEN s_acctbal > 5000 THEN 0 ELSE 1 END) * 1000000000 + s_suppkey) AS s_suppkey FROM supplier GROUP BY 1")
def preferred_first(t):
    return ordered.preferred_first(t.supplier.select("s_nationkey", "s_suppkey", "s_acctbal"), ["s_nationkey"], F.col("s_acctbal") > 5000, "s_suppkey").select("s_nationkey", "s_suppkey")


@query("SELECT user_id, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type FROM events GROUP BY 1")
def keep_first_keep_last(t):
    e = t.events.select("user_id", "event_id", "event_type")
    a = ordered.first_by(e, ["user_id"], "event_id").select("user_id", F.col("event_type").alias("first_type"))
    return a.join(ordered.last_by(e, ["user_id"], "event_id").select("user_id", F.col("event_type").alias("last_type")), "user_id")


@query("SELECT user_id, min(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def map_from_pairs(t):
    return ordered.last_value_at_first_place(t.events.select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_brand = 'Brand#22' THEN 0 ELSE 1 END, lower(p_brand), p_brand, p_partkey) AS place FROM part")
def pinned_collated_sort(t):
    return ordered.placed(t.part.select("p_partkey", "p_brand"), [*ordered.pinned_first(F.col("p_brand"), "Brand#22"), "p_partkey"]).select("p_partkey", "place")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS carried, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pending FROM events")
def carry_forward(t):
    rows = t.events.withColumn("mark", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return rows.select("event_id", ordered.carried_forward("mark", ["user_id"], "event_id").alias("carried"), ordered.pending_to_next("mark", ["user_id"], "event_id").alias("pending"))


@query("SELECT p_partkey, CASE WHEN p_type = 'Leader' THEN 0 ELSE coalesce(TRY_CAST(nullif(regexp_extract(p_brand, '(\\d+)\\s*$', 1), '') AS INTEGER), 1000) END AS rank FROM part")
def ranked_domain(t):
    return t.part.select("p_partkey", ordered.domain_rank(F.col("p_brand")).alias("rank"))


# -- Joins ------------------------------------------------------------------


@query("SELECT o_orderkey, n.kind FROM orders LEFT JOIN (SELECT c_custkey, arg_max(c_mktsegment, o) AS kind FROM (SELECT c_custkey % 1000 AS c_custkey, c_mktsegment, c_custkey AS o FROM customer) GROUP BY 1) n ON n.c_custkey = o_custkey")
def lookup_last_wins(t):
    names = t.customer.selectExpr("c_custkey % 1000 AS o_custkey", "c_mktsegment AS kind", "c_custkey AS ord")
    return joins.lookup(t.orders, names, ["o_custkey"], "ord").select("o_orderkey", "kind")


_CASCADE = """
WITH i AS (SELECT CASE WHEN p_size % 2 = 0 THEN upper(p_type || ' ' || p_brand) ELSE p_type || ' ' || p_brand END AS k, p_partkey FROM part),
a AS (SELECT DISTINCT p_type || ' ' || p_brand AS name, p_type || ' ' || p_brand AS key FROM part UNION SELECT DISTINCT p_name || chr(39) || 's', p_name || 's' FROM part UNION SELECT 'Promos', 'Promos'),
l AS (SELECT p_name || 's' AS key, lower(min(p_type || ' ' || p_brand)) AS target, 1 AS o FROM part GROUP BY p_name UNION ALL SELECT p_name || 's', upper(max(p_type || ' ' || p_brand)), 2 FROM part GROUP BY p_name),
d AS (SELECT name, 0 AS o, k = key AS exact, 0 AS via, p_partkey FROM a JOIN i ON lower(k) = lower(key)),
v AS (SELECT name, l.o, k = target AS exact, 1 AS via, p_partkey FROM a JOIN l USING (key) JOIN i ON lower(k) = lower(target) WHERE name NOT IN (SELECT name FROM d)),
f AS (SELECT *, bool_or(exact) OVER (PARTITION BY name, o) AS any_exact FROM (SELECT * FROM d UNION ALL SELECT * FROM v))
SELECT name, CASE WHEN via = 1 THEN 3 WHEN exact THEN 1 ELSE 2 END AS match_rank, o AS alias_ord, p_partkey FROM f WHERE exact = any_exact
UNION ALL SELECT 'Promos', 4, 0, p_partkey FROM i WHERE starts_with(k, 'PROMO ')
"""


@query(_CASCADE)
def title_cascade(t):
    whole = "concat(p_type, ' ', p_brand)"
    index = t.part.selectExpr(f"CASE WHEN p_size % 2 = 0 THEN upper({whole}) ELSE {whole} END AS name", "p_partkey")
    names = t.part.selectExpr(f"{whole} AS name").unionByName(t.part.select(F.concat("p_name", F.lit("'s")).alias("name"))).unionByName(t.spark.createDataFrame([("Promos",)], "name string"))
    by_name = t.part.select(F.concat("p_name", F.lit("’s")).alias("alias"), F.expr(whole).alias("w")).groupBy("alias").agg(F.min("w").alias("a"), F.max("w").alias("b"))
    aliases = by_name.selectExpr("alias", "inline(array(struct(lower(a) AS target, 1 AS ord), struct(upper(b) AS target, 2 AS ord)))")
    return joins.cascade(names, index, aliases, categories={"Promos": "PROMO "}).select("name", "match_rank", "alias_ord", "p_partkey")


@query("SELECT coalesce(c_custkey, o_custkey) AS custkey, coalesce(n, 0) AS cards, c_custkey IS NOT NULL AS listed FROM (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def manifest_full_outer(t):
    return joins.manifest(t.customer.filter("c_custkey % 2 = 0").selectExpr("c_custkey AS custkey"), t.orders.selectExpr("o_custkey AS custkey"), "custkey", both=True)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN p_brand ELSE s_name END AS name FROM lineitem LEFT JOIN part ON l_partkey * 2 = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey")
def preferred_key_no_fallback(t):
    left = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "CASE WHEN l_returnflag = 'R' THEN l_partkey * 2 END AS p_partkey", "l_suppkey AS s_suppkey")
    out = joins.preferred_key(left, t.part.select("p_partkey", "p_brand"), "p_partkey", t.supplier.select("s_suppkey", "s_name"), "s_suppkey")
    return out.selectExpr("l_orderkey", "l_linenumber", "CASE WHEN p_partkey IS NOT NULL THEN p_brand ELSE s_name END AS name")


@query("WITH b AS (SELECT min(p_partkey) AS b, upper(p_brand) AS n FROM part GROUP BY p_brand) SELECT p_partkey AS a, b FROM part JOIN b ON lower(p_brand) = lower(n)")
def any_key_join(t):
    b = t.part.groupBy("p_brand").agg(F.min("p_partkey").alias("b")).selectExpr("b", "upper(p_brand) AS m")
    return joins.any_key(t.part.selectExpr("p_partkey AS a", "p_brand AS n"), b, "a", "b", joins.name_keys(F.col("n")), joins.name_keys(F.col("m")))


@query("""WITH w AS (SELECT p_partkey, p_brand, p_size % 3 AS k, split_part(p_name, ' ', 2) AS word FROM part),
a AS (SELECT DISTINCT word || CASE k WHEN 0 THEN 's' WHEN 1 THEN 'ves' ELSE 'ss' END AS head, word || CASE k WHEN 0 THEN 's' WHEN 1 THEN 'ves' ELSE 'ss' END || ' of ' || p_brand AS name FROM w),
g AS (SELECT DISTINCT word AS grp, 3 AS pr FROM w UNION SELECT DISTINCT word || 'f', 2 FROM w UNION SELECT DISTINCT word || 's', 1 FROM w),
f AS (SELECT name, unnest([head, CASE WHEN head LIKE '%ves' THEN left(head, length(head) - 3) || 'f' ELSE left(head, length(head) - 1) END]) AS form FROM a),
h AS (SELECT grp, pr, unnest(CASE WHEN grp LIKE '%s' THEN [grp, left(grp, length(grp) - 1)] ELSE [grp] END) AS form FROM g)
SELECT name, arg_min(grp, pr) AS grp FROM f JOIN h USING (form) GROUP BY name""")
def fuzzy_names(t):
    word = "element_at(split(p_name, ' '), 2)"
    groups = t.part.selectExpr(f"inline(array(struct({word} AS grp, 3 AS pr), struct(concat({word}, 'f') AS grp, 2 AS pr), struct(concat({word}, 's') AS grp, 1 AS pr)))").distinct()
    return joins.fuzzy_names(t.part.selectExpr(f"concat({word}, CASE p_size % 3 WHEN 0 THEN 's' WHEN 1 THEN 'ves' ELSE 'ss' END, ' of ', p_brand) AS name"), groups, "name", "grp", "pr")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
def semi_join_nested(t):
    nested = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set("o_orderpriority").alias("p"))
    keys = t.orders.filter("o_orderpriority LIKE '1%'").selectExpr("o_orderpriority AS k").distinct()
    return joins.with_nested_key(nested, F.col("p"), keys, "k", "c_custkey").join(t.customer.select("c_custkey"), "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
def anti_join(t):
    return joins.without(t.customer.select("c_custkey"), t.orders.filter("o_orderpriority LIKE '1%'").selectExpr("o_custkey AS c_custkey"), "c_custkey")


@query("SELECT k, kind FROM (SELECT DISTINCT l_suppkey AS k FROM lineitem) JOIN LATERAL (SELECT CASE WHEN k IN (SELECT n_nationkey FROM nation) THEN 'nation' WHEN k IN (SELECT r_regionkey FROM region) THEN 'region' WHEN k IN (SELECT s_suppkey FROM supplier) THEN 'supplier' END AS kind) ON true WHERE kind IS NOT NULL")
def polymorphic_target(t):
    asked = t.lineitem.selectExpr("l_suppkey AS k").distinct()
    return joins.resolved(asked, [("nation", t.nation.withColumn("n", F.col("n_nationkey").cast("bigint")), "n"), ("region", t.region.withColumn("r", F.col("r_regionkey").cast("bigint")), "r"), ("supplier", t.supplier, "s_suppkey")], "k")


@query("SELECT p_brand, p_size, false AS made_up FROM (SELECT p_brand, min(p_size) AS p_size FROM part WHERE p_size > 40 GROUP BY 1) UNION ALL SELECT p_brand, arg_min(p_size, p_partkey), true FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 40) GROUP BY 1")
def derived_row_injection(t):
    rows = t.part.filter("p_size > 40").groupBy("p_brand").agg(F.min("p_size").alias("p_size"))
    return joins.injected(rows, t.part, t.part.select("p_brand", "p_partkey", "p_size"), "p_brand", "p_partkey")


@query("SELECT s_suppkey, s_nationkey, CAST(n.n_nationkey AS INTEGER) AS found, n.n_nationkey IS NULL AS missing FROM (SELECT s_suppkey, s_nationkey FROM supplier) LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 > 0) n ON n.n_nationkey = s_suppkey % 25 WHERE s_nationkey IS DISTINCT FROM n.n_nationkey")
def audit_mismatches(t):
    expected = t.supplier.select("s_suppkey", "s_nationkey", (F.col("s_suppkey") % 25).alias("k"))
    actual = t.nation.filter("n_nationkey % 3 > 0").selectExpr("CAST(n_nationkey AS BIGINT) AS k", "n_nationkey AS s_nationkey")
    return joins.audit(expected, actual, "k", "s_nationkey").select("s_suppkey", "s_nationkey", "found", "missing")


@query("SELECT n_name, coalesce((SELECT string_agg(s_name, ',' ORDER BY s_name) FROM supplier WHERE s_nationkey = n_nationkey), '') AS suppliers, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers FROM nation")
def detail_assembly(t):
    s, c = t.supplier.withColumnRenamed("s_nationkey", "n_nationkey"), t.customer.withColumnRenamed("c_nationkey", "n_nationkey")
    out = joins.detail(t.nation, "n_nationkey", {"s": (s, ["s_name"]), "c": (c, ["c_custkey"])})
    return out.select("n_name", F.array_join(F.transform("s", lambda x: x["s_name"]), ",").alias("suppliers"), F.size("c").cast("bigint").alias("customers"))


@query("WITH f AS (SELECT l_orderkey, string_agg(l_returnflag || l_linestatus, ',' ORDER BY l_returnflag, l_linestatus) AS k FROM lineitem GROUP BY 1), l AS (SELECT k, min(l_orderkey) AS twin FROM f GROUP BY 1 HAVING count(*) > 1) SELECT l_orderkey, twin FROM f LEFT JOIN l USING (k)")
def layout_by_multiset(t):
    flags = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.concat("l_returnflag", "l_linestatus")).alias("items"))
    layouts = flags.groupBy(F.array_sort("items").alias("row")).agg(F.min("l_orderkey").alias("twin"), F.count("*").alias("n")).filter("n > 1").select("twin", F.array("row").alias("rows"))
    met = joins.layout_match(flags, layouts.select("rows"))
    return met.join(layouts, "rows", "left").select("l_orderkey", "twin")


# -- Scalars ----------------------------------------------------------------


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, string_split(p_name, ' ')[1] AS head, nullif(trim(p_name), '') AS text FROM part")
def scalar_keys(t):
    n = F.col("p_name")
    return t.part.select("p_partkey", tx.alnum_key(n).alias("key"), tx.slug(n).alias("slug"), tx.doc_family(F.replace(n, F.lit(" "), F.lit("-"))).alias("head"), tx.text(n).alias("text"))


@query("SELECT doc_id, i AS block, b AS text FROM (SELECT doc_id, unnest(l) AS b, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, [x for x in string_split_regex(replace(text, '.' || chr(10), chr(10) || chr(10)), '\\n{2,}') if trim(x, ' ' || chr(10) || chr(9) || chr(13)) <> ''] AS l FROM documents))")
def markdown_blocks(t):
    return t.documents.select("doc_id", F.posexplode(tx.blocks(F.replace("text", F.lit(".\n"), F.lit("\n\n")))).alias("block", "text")).select("doc_id", F.col("block").cast("bigint"), "text")


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'markdown,image,mediaAside' WHEN 1 THEN 'markdown,markdown' ELSE 'mediaAside' END AS kinds, CASE p_size % 3 WHEN 0 THEN '|a1|b2' WHEN 1 THEN '|' ELSE 'a1+b2' END AS images FROM part")
def content_nodes(t):
    c = F.expr("CASE p_size % 3 WHEN 0 THEN concat(p_name, '\n\n![](/images/a1.png)\n\n![](/images/b2.png) ', p_brand) WHEN 1 THEN concat(p_name, '\n\n', p_brand, ' ![](/images/a1.png)') ELSE concat('![](/images/a1.png)\n![](/images/x/b2.jpg) ', p_name) END")
    nodes = tx.content_nodes(c)
    return t.part.select("p_partkey", F.array_join(F.transform(nodes, lambda n: n["kind"]), ",").alias("kinds"), F.array_join(F.transform(nodes, lambda n: F.array_join(n["images"], "+")), "|").alias("images"))


@query("SELECT event_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) > 1 THEN json_extract_string(props, '$.k') || ' things' WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) = 1 THEN '1 thing' END AS label FROM events")
def json_extract_label(t):
    return t.events.select("event_id", tx.count_label(F.get_json_object("props", "$.k").cast("int"), "thing").alias("label"))


@query("SELECT p_partkey, CASE WHEN contains(lower(p_type), 'brass') THEN 'metal' WHEN contains(lower(p_type), 'steel') THEN 'metal' WHEN p_type = 'PROMO' THEN 'promo' ELSE NULL END AS kind FROM part")
def case_map(t):
    return t.part.select("p_partkey", tx.case_map(F.col("p_type"), {"brass": "metal", "steel": "metal"}, {"PROMO": "promo"}).alias("kind"))


@query("""SELECT p_partkey, 'http://h.com/d/i/' || p_size || '.png' AS image FROM part UNION SELECT p_partkey, 'http://h.com/' || p_type || '.jpg?z=1' FROM part WHERE p_size % 2 = 0 UNION SELECT p_partkey, 'http://c.d/q.gif' FROM part""")
def html_image_links(t):
    html = F.expr("concat('<p><IMG alt=x src=\"./i/', p_size, '.png\"><a href=\"/', p_type, CASE WHEN p_size % 2 = 0 THEN '.jpg?z=1' ELSE '.html' END, '\">t</a><img src=\"i/', p_size, '.png\"><div style=\"background-image:url(//c.d/q.gif)\">')")
    pages = t.part.select("p_partkey", F.lit("http://h.com/d/e.html").alias("url"), html.alias("html"))
    return web.image_links(pages, "p_partkey", "url", "html").select("p_partkey", "image")


# -- Geometry and trees -----------------------------------------------------


@query("""WITH e AS (SELECT user_id, CAST(event_id AS DOUBLE) AS lo, event_id + value * 3 AS hi FROM events), w AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
g AS (SELECT user_id, lo - reach AS gap, reach FROM w WHERE lo > reach AND lo - reach >= 20), b AS (SELECT user_id, gap, reach + gap / 2 AS middle, row_number() OVER (PARTITION BY user_id ORDER BY gap DESC, reach) AS n FROM g)
SELECT a.user_id, round(gap, 6) AS gap, round(middle, 6) AS middle FROM (SELECT DISTINCT user_id FROM events) a LEFT JOIN b ON a.user_id = b.user_id AND n = 1""")
def gutter_gap(t):
    rows = t.events.selectExpr("user_id", "CAST(event_id AS DOUBLE) AS lo", "event_id + value * 3 AS hi")
    return layout.gaps(rows, ["user_id"], "lo", "hi", 20.0).select("user_id", F.round("gap", 6).alias("gap"), F.round("middle", 6).alias("middle"))


@query("WITH s AS (SELECT label, embedding FROM embeddings WHERE vec_id < 8), d AS (SELECT e.vec_id, v.vec_id AS i, v.label, list_sum([(CAST(e.embedding[k] AS DOUBLE) - CAST(v.embedding[k] AS DOUBLE)) ** 2 for k in range(1, len(e.embedding) + 1)]) AS far FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id < 8) v) SELECT vec_id, arg_min(label, far) AS label FROM d GROUP BY 1")
def nearest_prototype(t):
    samples = t.embeddings.filter("vec_id < 8").orderBy("vec_id").collect()  # eight named samples
    named = [(str(r.label), [float(x) for x in r.embedding]) for r in samples]
    return t.embeddings.select("vec_id", layout.nearest_label(None, named, F.transform("embedding", lambda x: x.cast("double"))).cast("int").alias("label"))


def _saves(t: Tables) -> DataFrame:
    """Orders as object trees: a bag per order, its lines as cards, nested once more by return flag."""
    card = F.struct(F.lit("Card").alias("Name"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("Nickname"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("GUID"))
    bags = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", card.alias("c")))).alias("cards"))
    bag = F.struct(F.lit("Bag").alias("Name"), F.col("l_returnflag").alias("Nickname"), F.concat_ws("-", F.lit("b"), "l_orderkey", "l_returnflag").alias("GUID"), F.transform("cards", lambda c: c["c"]).alias("ContainedObjects"))
    roots = bags.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(bag)).alias("bags"))
    root = F.struct(F.lit("Bag").alias("Name"), F.lit(" ").alias("Nickname"), F.concat_ws("-", F.lit("o"), "l_orderkey").alias("GUID"), F.col("bags").alias("ContainedObjects"))
    return roots.select(F.col("l_orderkey").cast("string").alias("source"), F.to_json(F.struct(F.array(root).alias("ObjectStates"))).alias("save"))


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS source, l_orderkey || '-' || l_linenumber AS guid, l_returnflag AS ancestry, CAST(2 AS INTEGER) AS depth FROM lineitem
UNION ALL SELECT DISTINCT CAST(l_orderkey AS VARCHAR), 'b-' || l_orderkey || '-' || l_returnflag, '', 1 FROM lineitem UNION ALL SELECT DISTINCT CAST(l_orderkey AS VARCHAR), 'o-' || l_orderkey, '', 0 FROM lineitem""")
def tree_flatten(t):
    return tree.flatten(_saves(t)).select("source", tree.field("GUID").alias("guid"), F.array_join("ancestry", "/").alias("ancestry"), "depth")


@query("SELECT l_orderkey || '-' || l_linenumber AS guid, 'b-' || l_orderkey || '-' || l_returnflag AS ancestor_guid, l_returnflag AS ancestor FROM lineitem")
def nearest_typed_ancestor(t):
    return tree.nearest_ancestor(tree.named(tree.flatten(_saves(t)))).filter("kind = 'Card'").select("guid", "ancestor_guid", "ancestor")


@query("SELECT 'part ' || l_partkey AS key, count(*) AS copies, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS places FROM lineitem GROUP BY 1")
def tree_extract_entities(t):
    nodes = tree.named(tree.flatten(_saves(t)))
    out = tree.extracted(nodes, F.col("kind") == "Card", F.col("nickname"), ["kind"], {"A": "a", "N": "n"})
    return out.select("key", "copies", F.array_join(F.array_sort(F.transform("locations", lambda x: F.array_join(x["value"], " / "))), ",").alias("places"))


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'assistant') AS answers, arg_min(role, turn) AS opens, arg_max(role, turn) AS closes FROM conversations GROUP BY 1")
def turn_path(t):
    ends = [F.min_by("role", "turn").alias("opens"), F.max_by("role", "turn").alias("closes")]
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "assistant").alias("answers"), *ends)


# -- Entities and pages -----------------------------------------------------


@query("""WITH o AS (SELECT c_nationkey || '-' || c_custkey % 50 AS site, c_name AS monster, CASE WHEN c_acctbal > 9000 THEN 0 WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 2 END AS n FROM customer)
SELECT site, monster FROM (SELECT *, min(n) OVER (PARTITION BY site) AS best FROM o) WHERE n = best""")
def source_precedence(t):
    rows = t.customer.selectExpr("concat(c_nationkey, '-', c_custkey % 50) AS site", "c_name AS monster", "CASE WHEN c_acctbal > 9000 THEN 0 WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 2 END AS n")
    return entities.monsters(rows.filter("n = 1"), rows.filter("n = 2"), rows.filter("n = 0"))


@query("""WITH u AS (SELECT 0 AS n, s_nationkey AS location, 'g' AS "group", s_suppkey AS ord, s_name AS name FROM supplier WHERE s_acctbal > 6000 UNION ALL SELECT 1, c_nationkey, 'g', c_custkey, c_name FROM customer)
SELECT location, name FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY n, ord) AS r FROM u) WHERE r = 1""")
def keep_first_across_sources(t):
    a = t.supplier.filter("s_acctbal > 6000").selectExpr("s_nationkey AS location", "'g' AS `group`", "s_suppkey AS ord", "s_name AS name")
    b = t.customer.selectExpr("c_nationkey AS location", "'g' AS `group`", "c_custkey AS ord", "c_name AS name")
    return entities.natives([a, b]).select("location", "name")


@query("""WITH l AS (SELECT user_id AS doc, event_id // 40 AS page, event_id // 10 % 2 AS col, event_id AS ord, event_type = 'view' AS image, event_type = 'purchase' AS head FROM events),
m AS (SELECT *, count(*) FILTER (WHERE head) OVER (PARTITION BY doc ORDER BY ord ROWS UNBOUNDED PRECEDING) AS s, min(CASE WHEN NOT image THEN ord END) OVER (PARTITION BY doc, page, col) AS f FROM l),
h AS (SELECT doc, ord AS f, head AS first_head FROM l)
SELECT m.doc, m.ord, s + CASE WHEN image AND m.ord < m.f AND h.first_head THEN 1 ELSE 0 END AS section FROM m LEFT JOIN h ON h.doc = m.doc AND h.f = m.f""")
def figure_sections(t):
    lines = t.events.selectExpr("user_id AS doc", "event_id div 40 AS page", "event_id div 10 % 2 AS col", "event_id AS ord", "CASE WHEN event_type = 'view' THEN 'image' ELSE 'text' END AS kind", "CASE WHEN event_type = 'purchase' THEN 1 END AS level")
    return pages.figure_sections(lines).select("doc", "ord", "section")


@query("SELECT CAST(p_partkey AS VARCHAR) AS guid, 'f' || p_partkey % 3 AS face, CAST((p_partkey % 100) // (5 + p_size % 3) AS INTEGER) AS row, CAST((p_partkey % 100) % (5 + p_size % 3) AS INTEGER) AS col FROM part WHERE (p_partkey % 100) // (5 + p_size % 3) < 7")
def sprite_cells(t):
    deck = F.create_map(F.expr("CAST(p_partkey div 100 AS STRING)"), F.struct(F.expr("concat('f', p_partkey % 3)").alias("FaceURL"), F.lit("b").alias("BackURL"), F.expr("5 + p_size % 3").alias("NumWidth"), F.lit(7).alias("NumHeight")))
    card = F.struct(F.col("p_partkey").cast("string").alias("GUID"), F.col("p_partkey").alias("CardID"), deck.alias("CustomDeck"))
    saves = t.part.select(F.col("p_partkey").cast("string").alias("source"), F.to_json(F.struct(F.array(card).alias("ObjectStates"))).alias("save"))
    return tree.sprite_cell(tree.named(tree.flatten(saves))).select("guid", "face", "row", "col")


@query("SELECT l_suppkey, string_agg('+' || n || ' ' || l_returnflag || CASE WHEN n > 1 THEN 's' ELSE '' END, ',' ORDER BY l_returnflag) AS labels FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def reward_labels(t):
    counts = t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n")).groupBy("l_suppkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "n"))).alias("m"))
    return counts.select("l_suppkey", F.array_join(entities.reward_labels(F.col("m")), ",").alias("labels"))


@query("""SELECT image, line FROM (SELECT a.event_id AS image, b.event_id AS line, row_number() OVER (PARTITION BY a.event_id ORDER BY least(a.event_id + a.value, b.event_id + b.value) - greatest(a.event_id, b.event_id) DESC, b.event_id) AS n
FROM events a JOIN events b ON a.event_type = 'view' AND b.event_type <> 'view' AND a.event_id // 1000 = b.event_id // 1000 AND b.event_id < a.event_id + a.value AND a.event_id < b.event_id + b.value) WHERE n = 1""")
def best_overlap(t):
    boxes = t.events.selectExpr("event_id div 1000 AS page", "event_id", "CAST(event_id AS DOUBLE) AS y0", "event_id + value AS y1", "event_type")
    images = boxes.filter("event_type = 'view'").withColumnRenamed("event_id", "image")
    return layout.best_overlap(images.select("page", "image", "y0", "y1"), boxes.filter("event_type <> 'view'").select("page", F.col("event_id").alias("line"), "y0", "y1")).select("image", "line")


from stratafold import queries_more  # noqa: E402, F401  registers its queries too
