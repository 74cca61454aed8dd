"""Document, manifest, freshness, release-gate and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellsight.operators import quality as Q
from cellsight.plans import release as R
from cellsight.registry import query
from cellsight.registry.inputs import AREAS_SQL, EDGES_SQL, EVIDENCE_SQL, RUNS_SQL, with_
from cellsight.sources import scans, sinks

DAY = "yyyy-MM-dd"

PAGE_SQL = "CAST('0x' || substr(md5({id}), 1, 8) AS BIGINT) % greatest(CAST(ceil({n} / {size}.0) AS BIGINT), 1)"


@query(
    "geojson_documents",
    with_(
        AREAS_SQL, EDGES_SQL,
        """rt AS (SELECT area_id, area_key, ring, '[' || string_agg('[' || x1 || ',' || y1 || ']', ',' ORDER BY seq) || ',' || min(CASE WHEN seq = 0 THEN '[' || x1 || ',' || y1 || ']' END) || ']' AS txt FROM edges GROUP BY 1, 2, 3)""",
        """ft AS (SELECT a.area_id, district_key, '{"type":"Feature","id":"' || a.area_id || '","geometry":{"type":"' || CASE WHEN g.two THEN 'MultiPolygon' ELSE 'Polygon' END || '","coordinates":[' || g.txt || ']},"properties":{"area_id":"' || a.area_id || '","name_en":"' || name_en || '","source_key":' || coalesce('"' || source_key || '"', 'null') || '}}' AS feature
          FROM areas a JOIN (SELECT area_id, any_value(area_key % 8 = 5) AS two, string_agg(CASE WHEN area_key % 8 = 5 THEN '[' || txt || ']' ELSE txt END, ',' ORDER BY ring) AS txt FROM rt GROUP BY 1) g USING (area_id) WHERE district_key <> 3)""",
        f"""pg AS (SELECT *, count(*) OVER (PARTITION BY district_key) AS total, {PAGE_SQL.format(id='area_id', n='count(*) OVER (PARTITION BY district_key)', size=3)} AS page FROM ft)""",
        """dc AS (SELECT n_nationkey AS district_key, coalesce(page, 0) AS page, count(area_id) AS feature_count, coalesce(max(total), 0) AS feature_total, '{"type":"FeatureCollection","features":[' || coalesce(string_agg(feature, ',' ORDER BY area_id), '') || ']}' AS document FROM nation LEFT JOIN pg ON district_key = n_nationkey GROUP BY 1, 2)""",
        then="SELECT district_key, page, CAST(feature_count AS INTEGER) AS feature_count, feature_total, md5(document) AS document_md5 FROM dc",
    ),
)
def geojson_documents(t):
    """FeatureCollections per district in pages of about three features; a district without areas gets an empty one."""
    features = sinks.features_json(t.areas().where("district_key <> 3"), "area_id", ["area_id", "name_en", "source_key"])
    groups = t.raw("nation").select(F.col("n_nationkey").alias("district_key"))
    docs = sinks.feature_collections(groups, features, "district_key", "area_id", page_size=3)
    return docs.select("district_key", "page", "feature_count", "feature_total", F.md5("document").alias("document_md5"))


@query(
    "row_payloads",
    with_(
        EVIDENCE_SQL, RUNS_SQL,
        "kept AS (SELECT run_id, indicator, status FROM runs WHERE boundary_set_version = 'areas-v1')",
        "one AS (SELECT run_id, area_id, max(coverage_pct) AS coverage_pct, min(quality_status) AS quality_status FROM evidence GROUP BY 1, 2)",
        f"""pg AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS total, {PAGE_SQL.format(id='area_id', n='count(*) OVER (PARTITION BY run_id)', size=2)} AS page FROM one)""",
        """dc AS (SELECT k.run_id, coalesce(page, 0) AS page, coalesce(max(total), 0) AS row_total, '{"run":{"run_id":"' || k.run_id || '","indicator":"' || indicator || '","status":"' || status || '"},"rows":[' ||
          coalesce(string_agg('{"area_id":"' || area_id || '","coverage_pct":' || coverage_pct || ',"quality_status":"' || quality_status || '"}', ',' ORDER BY area_id), '') || ']}' AS payload FROM kept k LEFT JOIN pg p ON p.run_id = k.run_id GROUP BY k.run_id, 2, indicator, status)""",
        then="SELECT run_id, page, row_total, md5(payload) AS payload_md5 FROM dc",
    ),
)
def row_payloads(t):
    runs = t.runs().where("boundary_set_version = 'areas-v1'").select("run_id", "indicator", "status")
    rows = t.evidence().groupBy("run_id", "area_id").agg(F.max("coverage_pct").alias("coverage_pct"), F.min("quality_status").alias("quality_status"))
    out = sinks.row_payloads(runs, rows, "run_id", "area_id", ["coverage_pct", "quality_status"], page_size=2)
    return out.select("run_id", "page", "row_total", F.md5("payload").alias("payload_md5"))


@query("page_manifest", "SELECT page_id AS asset, strlen(html) AS byte_size, sha256(html) AS sha256 FROM pages")
def page_manifest(t):
    return sinks.text_manifest(t.raw("pages"), "page_id", "html")


DECLARED_SQL = """declared AS (SELECT '2001-01-01T000000Z' || CASE WHEN page_id % 50 = 7 THEN '-BAD' ELSE '' END AS release_id, CASE WHEN page_id % 40 = 9 THEN page_id - 1 ELSE page_id END AS asset, html, page_id,
  strlen(html) + CASE WHEN page_id % 30 = 1 THEN 1 ELSE 0 END AS byte_size, page_id % 20 = 3 AS bad_sha, page_id % 25 = 4 AS bad_dates FROM pages)"""


@query(
    "asset_findings",
    with_(
        DECLARED_SQL,
        "stored AS (SELECT page_id AS asset, strlen(html) AS size, sha256(html) AS sha FROM pages WHERE page_id % 33 <> 5)",
        "j AS (SELECT d.*, s.size, s.sha, sha256(d.html) AS own FROM declared d LEFT JOIN stored s USING (asset))",
        then="""SELECT release_id, asset, rule FROM (SELECT release_id, asset, CASE WHEN size IS NULL THEN 'missing_file' END AS rule FROM j UNION ALL SELECT release_id, asset, CASE WHEN size <> byte_size THEN 'byte_size' END FROM j
          UNION ALL SELECT release_id, asset, CASE WHEN sha <> CASE WHEN bad_sha THEN 'x' ELSE own END THEN 'sha256' END FROM j UNION ALL SELECT release_id, asset, CASE WHEN bad_dates THEN 'date_order' END FROM j
          UNION ALL SELECT release_id, asset, CASE WHEN release_id LIKE '%BAD' THEN 'release_id' END FROM j UNION ALL SELECT release_id, asset, 'duplicate_asset' FROM declared GROUP BY 1, 2 HAVING count(*) > 1) v WHERE rule IS NOT NULL""",
    ),
)
def asset_findings(t):
    p = t.raw("pages")
    k = F.col("page_id")
    start = F.lit("2001-01-10").cast("date")
    declared = p.select(
        F.concat(F.lit("2001-01-01T000000Z"), F.when(k % 50 == 7, "-BAD").otherwise("")).alias("release_id"),
        F.when(k % 40 == 9, k - 1).otherwise(k).alias("asset"),
        (F.octet_length("html") + F.when(k % 30 == 1, 1).otherwise(0)).alias("byte_size"),
        F.when(k % 20 == 3, "x").otherwise(F.sha2(F.encode("html", "UTF-8"), 256)).alias("sha256"),
        start.alias("observation_start"),
        F.when(k % 25 == 4, F.date_sub(start, 1)).otherwise(start).alias("observation_end"),
    )
    return R.asset_findings(declared, sinks.text_manifest(p.where("page_id % 33 <> 5"), "page_id", "html"))


@query(
    "content_fingerprints",
    """WITH h AS (SELECT l_suppkey, md5(concat_ws(chr(31), CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), coalesce(CASE WHEN l_linenumber <> 4 THEN l_returnflag END, chr(0)))) AS h FROM lineitem),
    s AS (SELECT l_suppkey, count(*) AS rows, sum(CAST('0x' || substr(h, 1, 7) AS HUGEINT)) AS a, sum(CAST('0x' || substr(h, 8, 7) AS HUGEINT)) AS b, sum(CAST('0x' || substr(h, 15, 7) AS HUGEINT)) AS c, sum(CAST('0x' || substr(h, 22, 7) AS HUGEINT)) AS d FROM h GROUP BY 1)
    SELECT l_suppkey, rows, sha256(rows || '|' || a || '|' || b || '|' || c || '|' || d) AS fingerprint FROM s""",
)
def content_fingerprints(t):
    li = t.raw("lineitem").withColumn("flag", F.when(F.col("l_linenumber") != 4, F.col("l_returnflag")))
    return sinks.fingerprint(li, ["l_orderkey", "l_partkey", "l_linenumber", "flag"], ["l_suppkey"])


# ---- freshness

CONTRACT_SQL = "contract(source_key, label, e, s, automation) AS (VALUES " + ", ".join(f"('{k}', '{n}', {e}, {s}, '{m}')" for k, n, e, s, m in R.FRESHNESS) + ")"
KEY_CASE = "CASE o_orderkey % 7 " + " ".join(f"WHEN {i} THEN '{row[0]}'" for i, row in enumerate(R.FRESHNESS)) + " END"
FACTS_SQL = f"""latest AS (SELECT o_custkey % 200 AS release, {KEY_CASE} AS source_key, CAST(max(o_orderdate) AS DATE) AS ended FROM orders GROUP BY 1, 2),
facts AS (SELECT l.*, label, ended + e AS expected_next, ended + s AS stale_after, automation FROM latest l JOIN contract USING (source_key))"""


def facts(t):
    key = F.element_at(F.array(*[F.lit(row[0]) for row in R.FRESHNESS]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    latest = t.raw("orders").groupBy((F.col("o_custkey") % 200).alias("release"), key.alias("source_key")).agg(F.to_date(F.max("o_orderdate")).alias("source_observation_end"))
    return R.freshness(latest, R.contract(t.spark))


@query(
    "freshness_facts",
    with_(
        CONTRACT_SQL, FACTS_SQL,
        then="""SELECT release, source_key, strftime(expected_next, '%Y-%m-%d') AS expected_next, strftime(stale_after, '%Y-%m-%d') AS stale_after,
          'Data as of ' || ended || ' · ' || CASE WHEN DATE '2001-07-01' > stale_after THEN 'STALE' ELSE 'within declared window' END || ' · ' || CASE automation WHEN 'automatic' THEN 'automatic source refresh' WHEN 'replacement-required' THEN 'source replacement required' ELSE 'manual acquisition pending' END || '. Expected next: ' || expected_next || '.' AS text FROM facts""",
    ),
)
def freshness_facts(t):
    day = lambda c: F.date_format(c, DAY).alias(c)
    return facts(t).select("release", "source_key", day("expected_next"), day("stale_after"), R.freshness_text(F.lit("2001-07-01").cast("date")).alias("text"))


@query(
    "freshness_alarms",
    with_(
        CONTRACT_SQL, FACTS_SQL,
        then="""SELECT release, coalesce(string_agg(CASE WHEN stale_after < DATE '2001-07-01' THEN source_key || ' (as of ' || ended || '; stale after ' || stale_after || ')' END, '; ' ORDER BY source_key), '') AS stale_sources,
          CASE WHEN count(DISTINCT source_key) <> 7 THEN 'invalid' WHEN count(*) FILTER (WHERE stale_after < DATE '2001-07-01') > 0 THEN 'stale' ELSE 'current' END AS state FROM facts GROUP BY 1""",
    ),
)
def freshness_alarms(t):
    out = R.alarm(facts(t), R.contract(t.spark), F.lit("2001-07-01").cast("date"), ["release"])
    return out.select("release", F.array_join("stale_sources", "; ").alias("stale_sources"), "state")


@query(
    "freshness_findings",
    with_(
        CONTRACT_SQL, FACTS_SQL,
        then="""SELECT rule, count(*) AS facts FROM (SELECT CASE WHEN release % 9 = 0 THEN 'label' END AS rule FROM facts UNION ALL SELECT CASE WHEN release % 11 = 0 THEN 'expected_next' END FROM facts UNION ALL SELECT CASE WHEN release % 13 = 0 THEN 'unknown_source' END FROM facts
          ) v WHERE rule IS NOT NULL GROUP BY 1""",
    ),
)
def freshness_findings(t):
    f = facts(t).withColumn("label", F.when(F.col("release") % 9 == 0, F.concat("label", F.lit("!"))).otherwise(F.col("label")))
    f = f.withColumn("expected_next", F.when(F.col("release") % 11 == 0, F.date_add("expected_next", 1)).otherwise(F.col("expected_next")))
    lost = f.where("release % 13 = 0").withColumn("source_key", F.lit("unheard_of"))
    found = R.freshness_findings(f.unionByName(lost), R.contract(t.spark))
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("facts"))


@query(
    "release_regressions",
    with_(
        f"a AS (SELECT o_custkey % 500 AS release, {KEY_CASE} AS source_key, max(o_orderdate) AS e FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2)",
        f"b AS (SELECT o_custkey % 500 AS release, {KEY_CASE} AS source_key, max(o_orderdate) AS e FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2)",
        then="SELECT coalesce(a.release, b.release) AS release, coalesce(a.source_key, b.source_key) AS source_key, CASE WHEN a.e IS NULL OR b.e IS NULL THEN 'incomplete' ELSE 'regressed' END AS finding FROM a FULL JOIN b ON a.release = b.release AND a.source_key = b.source_key WHERE a.e IS NULL OR b.e IS NULL OR b.e < a.e",
    ),
)
def release_regressions(t):
    key = F.element_at(F.array(*[F.lit(row[0]) for row in R.FRESHNESS]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    side = lambda s: t.raw("orders").where(F.col("o_orderstatus") == s).groupBy((F.col("o_custkey") % 500).alias("release"), key.alias("source_key")).agg(F.max("o_orderdate").alias("source_observation_end"))
    return R.regressions(side("F"), side("O"), ["release"]).select("release", "source_key", "finding")


LATEST_SQL = "latest AS (SELECT run_id, indicator FROM (SELECT *, row_number() OVER (PARTITION BY indicator ORDER BY obs_end DESC, created_at DESC, run_id DESC) AS rn FROM runs WHERE run_id IN (SELECT run_id FROM evidence)) r WHERE rn = 1)"


@query("public_workspace", with_(EVIDENCE_SQL, RUNS_SQL, LATEST_SQL, then="SELECT indicator, run_id, area_id, value, coverage_pct, quality_status FROM evidence JOIN latest USING (run_id)"))
def public_workspace(t):
    held = t.runs().join(t.evidence().select("run_id"), "run_id", "left_semi")
    return R.workspace(held, t.evidence())


@query(
    "release_completeness",
    with_(
        EVIDENCE_SQL, RUNS_SQL,
        "c AS (SELECT indicator, run_id, status, count(*) AS areas, count(*) FILTER (WHERE quality_status = 'ok' AND coverage_pct >= 90) AS approved FROM evidence JOIN runs USING (run_id) GROUP BY 1, 2, 3)",
        then="SELECT indicator, run_id, areas, approved, CASE WHEN indicator = 'ndvi' AND areas <> 4 THEN 'not a full run over all areas' WHEN approved = 0 THEN 'no quality-approved area summaries' END AS problem FROM c",
    ),
)
def release_completeness(t):
    rows = t.evidence().join(t.runs().select("run_id", "indicator"), "run_id")
    return R.completeness(rows, t.runs(), ["ndvi"], 4).select("indicator", "run_id", "areas", "approved", "problem")


@query(
    "exposure_gaps",
    with_(AREAS_SQL, then="SELECT area_id, 'missing' AS finding, 'population' AS measure FROM areas WHERE area_key % 6 = 0 UNION ALL SELECT 'area-' || c_custkey, 'unexpected', 'population' FROM customer WHERE c_custkey >= (SELECT count(*) FROM supplier) AND c_custkey % 6 <> 0"),
)
def exposure_gaps(t):
    exposure = t.raw("customer").where("c_custkey % 6 <> 0").select(F.concat(F.lit("area-"), "c_custkey").alias("area_id"))
    return R.exposure_gaps(exposure, t.areas(), "population")


@query(
    "forbidden_fields",
    """SELECT rule, count(*) AS features FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'forbidden_field' END AS rule FROM orders UNION ALL SELECT CASE WHEN o_orderstatus <> 'P' THEN 'no_neutral_code' END FROM orders UNION ALL SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'planning_wording' END FROM orders) v WHERE rule IS NOT NULL GROUP BY 1""",
)
def forbidden_fields(t):
    o = t.raw("orders")
    s = F.col("o_orderstatus")
    note = F.when(F.col("o_orderkey") % 10 == 0, "Immediate verification needed").otherwise("none")
    properties = F.to_json(F.struct(F.when(s == "F", "x").alias("priority_class"), F.when(s == "P", "C1").alias("retrospective_draft_code"), note.alias("note")))
    found = R.forbidden_fields(o.select("o_orderkey", properties.alias("properties")), ["o_orderkey"], "properties")
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("features"))


# ---- relational effect of the sinks


@query(
    "upsert_merge",
    """SELECT l_orderkey, l_suppkey, q, 'new' AS origin FROM (SELECT l_orderkey, l_suppkey, sum(l_quantity) AS q FROM lineitem WHERE year(l_shipdate) = 2001 GROUP BY 1, 2) n
    UNION ALL SELECT l_orderkey, l_suppkey, q, 'old' FROM (SELECT l_orderkey, l_suppkey, sum(l_quantity) AS q FROM lineitem WHERE year(l_shipdate) < 2001 GROUP BY 1, 2) o WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE year(x.l_shipdate) = 2001 AND x.l_orderkey = o.l_orderkey AND x.l_suppkey = o.l_suppkey)""",
)
def upsert_merge(t):
    key = ["l_orderkey", "l_suppkey"]
    side = lambda where, name: t.raw("lineitem").where(where).groupBy(*key).agg(F.sum("l_quantity").alias("q")).withColumn("origin", F.lit(name))
    return sinks.merged(side("year(l_shipdate) < 2001", "old"), side("year(l_shipdate) = 2001", "new"), key)


@query(
    "update_columns",
    """SELECT c_custkey, CASE WHEN n.o_custkey IS NOT NULL THEN n.total ELSE c_acctbal END AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, CASE WHEN o_custkey % 3 <> 0 THEN max(o_totalprice) END AS total FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) n ON n.o_custkey = c_custkey""",
)
def update_columns(t):
    values = t.raw("orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("m"))
    values = values.select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("m")).alias("c_acctbal"))
    return sinks.update_columns(t.raw("customer").select("c_custkey", "c_acctbal"), values, ["c_custkey"], ["c_acctbal"])


@query(
    "resume_remaining",
    with_(
        AREAS_SQL, EVIDENCE_SQL,
        then="""SELECT area_id, 'remaining' AS state FROM areas WHERE area_id NOT IN (SELECT area_id FROM evidence WHERE value = 50 AND coverage_pct = 98)
        UNION ALL SELECT area_id, 'duplicate' FROM evidence WHERE value = 50 AND coverage_pct = 98 GROUP BY 1 HAVING count(*) > 1
        UNION ALL SELECT DISTINCT area_id, 'unexpected' FROM evidence WHERE value = 50 AND coverage_pct = 98 AND area_id NOT IN (SELECT area_id FROM areas WHERE source_key IS NOT NULL)""",
    ),
)
def resume_remaining(t):
    done = t.evidence().where("value = 50 AND coverage_pct = 98")
    areas = t.areas().select("area_id", "source_key")
    rest = scans.remaining(areas.select("area_id"), done).withColumn("state", F.lit("remaining"))
    problems = scans.checkpoint_problems(done, areas.where("source_key IS NOT NULL").select("area_id"))
    return rest.unionByName(problems.withColumnRenamed("problem", "state"))


@query(
    "grid_contract",
    """WITH g AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS bands, min(CASE WHEN l_suppkey % 20 = 0 THEN 32637 ELSE 4326 END) AS c0, max(CASE WHEN l_suppkey % 20 = 0 THEN 32637 ELSE 4326 END) AS c1, min(l_quantity * 10000) AS bytes, min(l_partkey % 60) AS lo, max(l_partkey % 60) + 5 AS hi FROM lineitem GROUP BY 1)
    SELECT 'run-' || l_orderkey AS run_id, rule FROM (SELECT l_orderkey, CASE WHEN bands <> 3 THEN 'band_count' END AS rule FROM g UNION ALL SELECT l_orderkey, CASE WHEN c0 <> 4326 OR c1 <> 4326 THEN 'crs' END FROM g
      UNION ALL SELECT l_orderkey, CASE WHEN bytes < 20000 THEN 'byte_size' END FROM g UNION ALL SELECT l_orderkey, CASE WHEN hi <= 10 OR lo >= 40 THEN 'outside_extent' END FROM g) v WHERE rule IS NOT NULL""",
)
def grid_contract(t):
    li = t.raw("lineitem")
    grids = li.select(
        F.concat(F.lit("run-"), "l_orderkey").alias("run_id"), F.concat(F.lit("p"), F.col("l_orderkey") % 2).alias("product"), F.col("l_linenumber").alias("band"), F.when(F.col("l_suppkey") % 20 == 0, 32637).otherwise(4326).alias("crs"),
        (F.col("l_quantity") * 10000).alias("byte_size"), (F.col("l_partkey") % 60).cast("double").alias("x0"), F.lit(15.0).alias("y0"), F.lit(0.5).alias("dx"), F.lit(-0.5).alias("dy"), F.lit(10).alias("width"), F.lit(10).alias("height"),
    )
    expected = t.raw("region").where("r_regionkey < 2").select(F.concat(F.lit("p"), "r_regionkey").alias("product"), F.lit(3).alias("expected_bands"))
    return Q.grid_contract(grids, expected, (10.0, 5.0, 40.0, 20.0), 20000)


@query(
    "manifest_violations",
    """SELECT rule, count(*) AS manifests FROM (SELECT CASE WHEN o_orderkey % 6 = 0 THEN 'missing_member' END AS rule FROM orders UNION ALL SELECT CASE WHEN o_orderstatus = 'O' THEN 'status' END FROM orders
      UNION ALL SELECT CASE WHEN o_orderkey % 8 = 0 THEN 'no_receipt' END FROM orders UNION ALL SELECT CASE WHEN o_orderkey % 8 <> 0 AND o_orderkey % 5 = 0 THEN 'receipt_not_confirmed' END FROM orders) v WHERE rule IS NOT NULL GROUP BY 1""",
)
def manifest_violations(t):
    o = t.raw("orders")
    k = F.col("o_orderkey")
    receipt = F.when(k % 8 == 0, "[]").when(k % 5 == 0, '[{"url":"u","http_status":404}]').otherwise('[{"url":"u","http_status":200}]')
    status = F.when(F.col("o_orderstatus") == "F", "development").when(F.col("o_orderstatus") == "P", "validated").otherwise("degraded")
    fixed = ",".join(f'"{m}":"x"' for m in Q.RAINFALL_MANIFEST if m not in ("status", "source_acquisition", "method"))
    document = F.concat(
        F.lit("{" + fixed + ',"status":"'), status, F.lit('"'), F.when(k % 6 != 0, ',"method":"m"').otherwise(""), F.lit(',"source_acquisition":{"current_period_files":'), receipt, F.lit("}}")
    )
    found = Q.check_rows(o.select("o_orderkey", document.alias("manifest")), Q.manifest_rules(), ["o_orderkey"])
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("manifests"))


@query(
    "geometry_joined_once",
    with_(
        AREAS_SQL, EVIDENCE_SQL,
        "k AS (SELECT area_id, area_key FROM areas WHERE source_key IS NOT NULL)",
        "e AS (SELECT area_id, count(*) AS n FROM evidence WHERE quality_status = 'ok' GROUP BY 1)",
        then="SELECT k.area_id, coalesce(n, 0) AS rows, n IS NOT NULL AS has_rows FROM k LEFT JOIN e ON e.area_id = k.area_id",
    ),
)
def geometry_joined_once(t):
    released = t.areas().where("source_key IS NOT NULL")
    rows = t.evidence().where("quality_status = 'ok'").groupBy("area_id").agg(F.count(F.lit(1)).alias("rows"))
    everything = R.with_geometry(rows, released, keep_all_areas=True)
    inner = R.with_geometry(rows, released).select("area_id", F.lit(True).alias("has_rows"))
    return everything.join(inner, "area_id", "left").select("area_id", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("has_rows", F.lit(False)).alias("has_rows"))


@query(
    "public_exposure",
    "SELECT 'area-' || c_custkey AS area_id, c_name AS name_en, c_acctbal AS population_total, 'ok' AS quality_status FROM customer",
)
def public_exposure(t):
    """Allow-listed columns only: the segment is not one of them."""
    rows = t.raw("customer").select(F.concat(F.lit("area-"), "c_custkey").alias("area_id"), F.col("c_name").alias("name_en"), F.col("c_acctbal").alias("population_total"), F.lit("ok").alias("quality_status"), "c_mktsegment")
    return R.public_exposure(rows, "population")


@query(
    "observation_windows",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') ELSE '2001-09-09' END AS window_start,
      CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '2001-09-09' END AS window_end, round(date_diff('second', o_orderdate, TIMESTAMP '2001-12-31 06:00:00') / 86400.0, 6) AS age_days FROM orders""",
)
def observation_windows(t):
    """First present alternative of the window fields, and the fractional age."""
    from cellsight.functions.dates import age_days_fractional, observation_window

    o = t.raw("orders")
    k = F.col("o_orderkey") % 3
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    first, second = F.when(k == 0, stamp).when(k == 1, ""), F.when(k == 1, F.date_format(F.date_add("o_orderdate", 1), "yyyy-MM-dd"))
    window = observation_window([first, second], [first], F.lit("2001-09-09"))
    age = age_days_fractional(F.col("o_orderdate").cast("timestamp"), F.lit("2001-12-31 06:00:00").cast("timestamp"))
    return o.select("o_orderkey", window["start"].alias("window_start"), window["end"].alias("window_end"), F.round(age, 6).alias("age_days"))
