"""Search, listing and link-harvest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellsight.functions import text as T
from cellsight.operators import search as S
from cellsight.registry import query
from cellsight.sources import scans

PLACES_SQL = """places AS (SELECT 'part' AS type, 'p' || p_partkey AS id, p_name AS name_en, p_type AS name_ti FROM part
  UNION ALL SELECT 'supplier', 's' || s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN 'Ring ' || s_suppkey END FROM supplier UNION ALL SELECT 'nation', 'n' || n_nationkey, n_name, NULL FROM nation)"""


def places(t):
    part = t.raw("part").select(F.lit("part").alias("type"), F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name_en"), F.col("p_type").alias("name_ti"))
    alt = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Ring "), "s_suppkey"))
    supplier = t.raw("supplier").select(F.lit("supplier").alias("type"), F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name_en"), alt.alias("name_ti"))
    nation = t.raw("nation").select(F.lit("nation").alias("type"), F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name_en"), F.lit(None).cast("string").alias("name_ti"))
    return part.unionByName(supplier).unionByName(nation)


@query(
    "place_search",
    "WITH " + PLACES_SQL + """, r AS (SELECT *, CASE WHEN lower(name_en) = 'ring' OR lower(name_ti) = 'ring' THEN 1 WHEN lower(name_en) LIKE 'ring%' OR lower(name_ti) LIKE 'ring%' THEN 2 WHEN lower(name_en) LIKE '%ring%' OR lower(name_ti) LIKE '%ring%' THEN 3 END AS rank FROM places)
    SELECT type, id, name_en, name_ti, rank FROM r WHERE rank IS NOT NULL ORDER BY rank, name_en, type, id LIMIT 15""",
)
def place_search(t):
    return S.search_places(places(t), " Ring ", S.name_rank("Ring", F.col("name_en"), F.col("name_ti")))


@query(
    "literal_place_search",
    "WITH " + PLACES_SQL + """, r AS (SELECT *, CASE WHEN lower(name_en) = 'nation_1' OR coalesce(lower(name_ti), '') = 'nation_1' THEN 1 WHEN starts_with(lower(name_en), 'nation_1') OR starts_with(coalesce(lower(name_ti), ''), 'nation_1') THEN 2
      WHEN contains(lower(name_en), 'nation_1') OR contains(coalesce(lower(name_ti), ''), 'nation_1') THEN 3 END AS rank FROM places) SELECT type, id, name_en, name_ti, rank FROM r WHERE rank IS NOT NULL ORDER BY rank, name_en, type, id LIMIT 15""",
)
def literal_place_search(t):
    """``_`` is an ordinary character here."""
    return S.search_places(places(t), "nation_1", S.literal_rank("NATION_1", F.col("name_en"), F.col("name_ti")))


@query(
    "batch_place_search",
    "WITH " + PLACES_SQL + """, asked AS (SELECT DISTINCT substr(p_name, 2, 6) AS query FROM part UNION SELECT n_name FROM nation UNION SELECT unnest(['re', 'g', 'no such name', '', ' ', '_1'])),
    r AS (SELECT query AS query_id, p.*, CASE WHEN lower(name_en) = lower(query) OR coalesce(lower(name_ti), '') = lower(query) THEN 1 WHEN starts_with(lower(name_en), lower(query)) OR starts_with(coalesce(lower(name_ti), ''), lower(query)) THEN 2
      WHEN contains(lower(name_en), lower(query)) OR contains(coalesce(lower(name_ti), ''), lower(query)) THEN 3 END AS rank FROM asked CROSS JOIN places p WHERE trim(query) <> '')
    SELECT query_id, type, id, name_en, name_ti, rank FROM r WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, name_en, type, id) <= 15""",
)
def batch_place_search(t):
    """Many search texts at once, through the rarest run of characters of each."""
    asked = t.raw("part").select(F.substring("p_name", 2, 6).alias("query")).union(t.raw("nation").select("n_name"))
    fixed = t.raw("nation").limit(1).select(F.explode(F.array(*[F.lit(q) for q in ("re", "g", "no such name", "", " ", "_1")])))
    asked = asked.union(fixed).distinct().select(F.col("query").alias("query_id"), "query")
    names = ["name_en", "name_ti"]
    return S.search_many(places(t), S.postings(places(t), names), asked, names)


@query(
    "scored_search",
    """WITH n AS (SELECT p_partkey, p_name, lower(p_name) AS nn, lower(p_type || ' ' || p_brand) AS al FROM part),
    s AS (SELECT *, CASE WHEN starts_with(nn, 're') THEN 100 WHEN starts_with(al, 're') THEN 80 WHEN contains(nn, 're') THEN 60 WHEN contains(al, 're') THEN 40 ELSE CASE WHEN len(list_filter(string_split(nn, ' '), lambda x: starts_with(x, 're'))) > 0 THEN 30 END END AS score FROM n)
    SELECT 'p' || p_partkey AS id, p_name AS name, score, CASE score WHEN 100 THEN 'name-prefix' WHEN 80 THEN 'alias-prefix' WHEN 60 THEN 'name-contains' WHEN 40 THEN 'alias-contains' ELSE 'token-match' END AS match_type
    FROM s WHERE score IS NOT NULL ORDER BY score DESC, p_name, 'p' || p_partkey LIMIT 20""",
)
def scored_search(t):
    p = t.raw("part")
    index = S.search_index(p.select(F.lit("part").alias("type"), F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.array(F.concat_ws(" ", "p_type", "p_brand")).alias("aliases")))
    return S.score_search(index, " Re! ".replace("!", "."), 20).select("id", "name", "score", "match_type")


@query(
    "normalised_names",
    r"""SELECT c_custkey, trim(regexp_replace(regexp_replace(trim(lower(c_name || ' (' || c_mktsegment || ')')), '[''"(),.;:/\\-]', ' ', 'g'), '\s+', ' ', 'g')) AS name_norm,
      regexp_replace(regexp_replace(lower(c_name || ' / ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, len(string_split(trim(lower(c_name || ' ' || c_mktsegment)), ' ')) AS tokens FROM customer""",
)
def normalised_names(t):
    c = t.raw("customer")
    name = T.query_name(F.concat(F.col("c_name"), F.lit(" ("), F.col("c_mktsegment"), F.lit(")")))
    return c.select(
        "c_custkey", name.alias("name_norm"), T.slug(F.concat_ws(" / ", "c_name", "c_mktsegment")).alias("slug"),
        F.size(T.tokens(T.index_name(F.concat_ws(" ", "c_name", "c_mktsegment")))).alias("tokens"),
    )


@query("index_names", None)
def index_names(t):
    """Compatibility decomposition over whole texts (no SQL twin; compared with Python in the tests)."""
    return t.raw("documents").select("doc_id", T.index_name(F.col("text")).alias("name_norm"))


@query(
    "release_id_checks",
    "SELECT o_orderstatus, count(*) FILTER (WHERE o_orderkey % 4 <> 3) AS valid_ids, count(*) AS ids FROM orders GROUP BY 1",
)
def release_id_checks(t):
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HHmmss'Z'")
    ident = F.when(F.col("o_orderkey") % 4 == 3, F.concat(stamp, F.lit("-Bad"))).when(F.col("o_orderkey") % 4 == 2, F.concat(stamp, F.lit("-r2"))).otherwise(stamp)
    return t.raw("orders").groupBy("o_orderstatus").agg(F.count_if(T.is_release_id(ident)).alias("valid_ids"), F.count(F.lit(1)).alias("ids"))


TAG_SQL = r"""tags AS (SELECT page_id, url, array_to_string(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\b([^>]*)>.*?</script\s*>', '<script\1>', 'g'), '(?is)<style\b([^>]*)>.*?</style\s*>', '<style\1>', 'g'), '<[a-zA-Z][^>]*>'), chr(10)) AS tags FROM pages),
raw AS (SELECT page_id, url, regexp_extract_all(tags, '(?i)\s(?:href|button-url|src)\s*=\s*(?:"([^"]+)"|''([^'']+)'')', 1) AS links FROM tags),
pos AS (SELECT page_id, url, unnest(links) AS link, generate_subscripts(links, 1) - 1 AS position FROM raw),
full_ AS (SELECT page_id, position, CASE WHEN regexp_matches(link, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN link WHEN starts_with(link, '//') THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1) || ':' || link
   WHEN starts_with(link, '/') THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || link END AS link_url FROM pos)"""


@query("harvested_links", "WITH " + TAG_SQL + " SELECT page_id, link_url, CAST(min(position) AS INTEGER) AS position FROM full_ GROUP BY 1, 2")
def harvested_links(t):
    return scans.harvest_links(t.raw("pages"))


@query("harvested_targets", "WITH " + TAG_SQL + ", d AS (SELECT DISTINCT page_id, link_url FROM full_) SELECT count(*) FILTER (WHERE regexp_matches(link_url, '(?i)/ethiopia-(?:acute-)?food-insecurity-classification-')) AS publications, count(*) FILTER (WHERE regexp_matches(regexp_replace(link_url, '[?#].*$', ''), '(?i)//[^/]*/.*\\.(geojson|json|zip|kml)$')) AS data_files, count(*) AS links FROM d")
def harvested_targets(t):
    links = scans.harvest_links(t.raw("pages"))
    is_file = scans.data_files(links).withColumn("kind", F.lit("file"))
    is_publication = scans.publications(links).withColumn("kind", F.lit("publication"))
    both = links.withColumn("kind", F.lit("link")).unionByName(is_file).unionByName(is_publication)
    return both.agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in (("publication", "publications"), ("file", "data_files"), ("link", "links"))])


@query(
    "pentad_listing",
    "SELECT o_custkey, year(o_orderdate) AS \"year\", month(o_orderdate) AS \"month\", least((day(o_orderdate) - 1) // 5 + 1, 6) AS pentad FROM orders GROUP BY ALL",
)
def pentad_listing(t):
    """Listing text of two file names per row, parsed back from the text."""
    from cellsight.functions.dates import pentad_of

    o = t.raw("orders")
    name = F.concat(F.lit("chirps-v3.0."), F.date_format("o_orderdate", "yyyy.MM"), F.lit("."), pentad_of(F.to_date("o_orderdate")), F.lit(".tif"))
    listing = o.select("o_custkey", F.concat(F.lit('<a href="'), name, F.lit('">'), name, F.lit("</a> <a>chirps-v3.0.2001.13.9.tif</a>")).alias("body"))
    return scans.pentad_listing(listing, "o_custkey", "body")


@query(
    "catalogue_items",
    """SELECT 'item-' || l_partkey AS item_id, strftime(min(CASE WHEN l_linenumber % 3 = 0 THEN l_shipdate ELSE l_shipdate + INTERVAL 1 DAY END), '%Y-%m-%d') AS stamp FROM lineitem GROUP BY 1""",
)
def catalogue_items(t):
    """Search responses as JSON text, one per order; the same item comes in many of them."""
    li = t.raw("lineitem")
    day = F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    later = F.date_format(F.date_add("l_shipdate", 1), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    third = F.col("l_linenumber") % 3 == 0
    properties = F.struct(F.when(third, day).alias("datetime"), F.when(~third, later).alias("end_datetime"), day.alias("start_datetime"))
    item = F.struct(F.concat(F.lit("item-"), "l_partkey").alias("id"), F.lit("c").alias("collection"), properties.alias("properties"))
    documents = li.select(F.to_json(F.struct(F.array(item).alias("features"))).alias("body"))
    return scans.catalogue_items(documents).select("item_id", F.date_format("stamp", "yyyy-MM-dd").alias("stamp"))


@query(
    "feature_rows",
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'f' || page_id WHEN page_id % 3 = 1 THEN 'p' || page_id ELSE 'sha' END AS feature_id FROM pages""",
)
def feature_rows(t):
    """Feature id: own id, else the property, else a hash of the geometry."""
    p = t.raw("pages")
    key = F.col("page_id")
    own = F.when(key % 3 == 0, F.concat(F.lit("f"), key))
    properties = F.to_json(F.struct(F.when(key % 3 == 1, F.concat(F.lit("p"), key)).alias("id"), F.col("url")))
    geometry = F.concat(F.lit('{"type":"Point","coordinates":['), key, F.lit(",1]}"))
    ident = scans.feature_id(own, properties, geometry)
    shown = F.when((key % 3 == 2) & (F.length(ident) == 16) & (ident == F.substring(F.sha1(geometry), 1, 16)), "sha").otherwise(ident)
    return p.select("page_id", shown.alias("feature_id"))


@query("season_labels", "SELECT DISTINCT o_custkey, CASE month(o_orderdate) % 3 WHEN 0 THEN 'JFM' WHEN 1 THEN 'OND - ' ELSE 'MAM-' END || CASE WHEN month(o_orderdate) % 3 = 0 THEN ' - ' ELSE '' END || (year(o_orderdate) + 20) AS season_label FROM orders")
def season_labels(t):
    season = F.month("o_orderdate") % 3
    label = F.concat(F.when(season == 0, "JFM - ").when(season == 1, "OND - ").otherwise("MAM-"), F.year("o_orderdate") + 20)
    text = F.concat(F.lit("<p>Outlook "), label, F.lit(" issued; XJFM - 2020, JFM - 1999 and "), label, F.lit("</p>"))
    return scans.season_labels(t.raw("orders").select("o_custkey", text.alias("body")), "o_custkey", "body")
