"""Deterministic stand-ins for the engine's inputs, as views over the star-schema tables (see FIXTURES.md).

The texts below are fixed values: SQL that Spark and DuckDB both accept.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_buildings": """SELECT o_orderkey AS id, 60.0E0 + ((o_orderkey*7919) % 20000)/10000.0E0 + 0.00003E0 AS lon, 24.0E0 + ((o_orderkey*6151) % 10000)/10000.0E0 + 0.00003E0 AS lat,
 20.0E0 + (CAST(floor(o_totalprice) AS BIGINT) % 3000) AS area_m2, 0.5E0 + (o_orderkey % 50)/100.0E0 AS bf_confidence FROM orders""",
    "fx_candidates": """SELECT p_partkey AS cand_id, 60.0E0 + ((p_partkey*7*7919) % 20000)/10000.0E0 + (p_partkey % 5)*0.0002E0 + 0.00005E0 AS lon, 24.0E0 + ((p_partkey*7*6151) % 10000)/10000.0E0 + 0.00005E0 AS lat,
 CASE p_partkey % 6 WHEN 0 THEN 60.0E0 WHEN 1 THEN 250.0E0 WHEN 2 THEN 750.0E0 WHEN 3 THEN 2500.0E0 WHEN 4 THEN 12000.0E0 ELSE 70000.0E0 END + (p_partkey % 40) AS area_m2,
 p_size/50.0E0 AS confidence, CAST(p_partkey % 5 AS INT) AS glint_consistent FROM part""",
    "fx_mapped": """SELECT c_custkey AS osm_id, 60.0E0 + ((c_custkey*4*7*7919) % 20000)/10000.0E0 + (c_custkey % 7)*0.0003E0 + 0.00005E0 AS lon, 24.0E0 + ((c_custkey*4*7*6151) % 10000)/10000.0E0 + 0.00005E0 AS lat,
 50.0E0 + (CAST(floor(abs(c_acctbal)) AS BIGINT) % 9000) AS area_m2, CASE c_nationkey % 3 WHEN 0 THEN 'rooftop' WHEN 1 THEN 'ground' ELSE 'small' END AS placement FROM customer""",
    "fx_pixels": """SELECT ix, iy, r, c, max(prob_u8) AS prob_u8 FROM (SELECT CAST(l_orderkey % 20 AS INT) AS ix, CAST(l_suppkey % 10 AS INT) AS iy, CAST((l_partkey*31+l_linenumber) % 64 AS INT) AS r, CAST((l_orderkey*17+l_linenumber*5) % 64 AS INT) AS c,
 CAST(floor(l_quantity*5.0E0) AS INT) AS prob_u8 FROM lineitem) t GROUP BY ix, iy, r, c""",
    "fx_scenes": """SELECT user_id % 40 AS pid, event_id AS item, ts AS time, CAST(event_id*37 % 100 AS DOUBLE) AS cloud, CAST(event_id % 7 AS INT) AS npx,
 1500.0E0 + (event_id % 17)*15.0E0 + CASE WHEN event_id % 23 = 0 THEN 4000.0E0 ELSE 0.0E0 END AS p98_b03, 2200.0E0 + (event_id % 19)*15.0E0 + CASE WHEN event_id % 23 = 0 THEN 4500.0E0 ELSE 0.0E0 END AS p98_b08, 1400.0E0 + value AS p98_b04,
 1400.0E0 + (event_id % 11)*10.0E0 + CASE WHEN event_id % 29 = 0 THEN 3000.0E0 ELSE 0.0E0 END AS ring_b03, 1900.0E0 + (event_id % 13)*10.0E0 + CASE WHEN event_id % 29 = 0 THEN 3000.0E0 ELSE 0.0E0 END AS ring_b08,
 25.0E0 + (event_id % 30) AS sun_zen, 120.0E0 + (event_id % 40) AS sun_az, 2.0E0 + (event_id % 9) AS view_zen, 100.0E0 + (event_id % 2)*180.0E0 AS view_az FROM events""",
    "fx_regions": """SELECT r_regionkey AS region_id, r_name AS name, 'region' AS level, 60.0E0 + r_regionkey*0.4E0 AS xmin, 24.0E0 AS ymin, 60.0E0 + (r_regionkey+1)*0.4E0 AS xmax, 25.0E0 AS ymax FROM region
 UNION ALL SELECT n_nationkey AS region_id, n_name AS name, 'county' AS level, 60.0E0 + (n_nationkey % 5)*0.4E0 AS xmin, 24.0E0 + floor(n_nationkey/5.0E0)*0.2E0 AS ymin, 60.0E0 + (n_nationkey % 5 + 1)*0.4E0 AS xmax, 24.0E0 + (floor(n_nationkey/5.0E0)+1)*0.2E0 AS ymax FROM nation""",
    "fx_register": """SELECT o_orderkey AS unit_id, lpad(CAST(o_custkey % 25 AS VARCHAR(8)), 8, '0') AS ags, CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'building' WHEN o_orderpriority = '5-LOW' THEN 'balcony' ELSE 'ground' END AS art,
 o_totalprice/10000.0E0 AS kw, CASE o_orderstatus WHEN 'F' THEN 'decommissioned' ELSE 'operating' END AS status, CAST(o_orderdate AS DATE) AS commissioned, CASE WHEN o_orderstatus = 'F' THEN make_date(year(o_orderdate)+2, month(o_orderdate), 1) END AS decommissioned FROM orders""",
    "fx_reviews": """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '<100' WHEN 1 THEN '100-500' WHEN 2 THEN '500-1k' WHEN 3 THEN '1k-5k' WHEN 4 THEN '5k-50k' ELSE '>50k' END AS bin_label, CASE WHEN toxic = 1 THEN '' WHEN quality = 1 THEN 'yes' ELSE 'no' END AS verdict FROM labels""",
    "fx_tiles": """SELECT CAST(s_suppkey AS BIGINT) AS tile_seq, CASE WHEN s_suppkey % 3 = 0 THEN concat(lpad(CAST(s_suppkey % 20 AS VARCHAR(4)),4,'0'),'_',lpad(CAST(s_nationkey % 10 AS VARCHAR(4)),4,'0')) ELSE concat('old_',lpad(CAST(s_suppkey AS VARCHAR(8)),6,'0')) END AS file,
 CAST(s_suppkey % 20 AS INT) AS ix, CAST(s_nationkey % 10 AS INT) AS iy FROM supplier""",
    "fx_osm": """SELECT c_custkey AS el_id, CASE c_custkey % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END AS el_type, CASE WHEN c_custkey % 4 = 0 THEN '{"plant:source":"solar"}' WHEN c_custkey % 4 = 1 THEN '{"generator:source":"solar","location":"roof"}' WHEN c_custkey % 4 = 2 THEN '{"generator:source":"solar","generator:place":"rooftop"}' ELSE '{"generator:source":"solar"}' END AS tags FROM customer""",
    "fx_bins": """SELECT * FROM (VALUES (0,'<100',0.0E0,100.0E0,80,2), (1,'100-500',100.0E0,500.0E0,80,7), (2,'500-1k',500.0E0,1000.0E0,80,13), (3,'1k-5k',1000.0E0,5000.0E0,85,26), (4,'5k-50k',5000.0E0,50000.0E0,82,24), (5,'>50k',50000.0E0,1.0E12,92,24)) AS t(bin, label, lo, hi, sens_n, sens_k)""",
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view's rows."""
    sql = VIEWS[name]
    tables = sorted(set(re.findall(r"FROM ([a-z]+)\b", sql)))
    for t in tables:
        sql = re.sub(rf"FROM {t}\b", f"FROM parquet.`{sf_dir}/{t}.parquet`", sql)
    return spark.sql(sql)


def with_views(*names: str, sql: str) -> str:
    """SQL with the views in front of it as common table expressions."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + (", " + sql[5:] if sql.lstrip().upper().startswith("WITH ") else " " + sql)
