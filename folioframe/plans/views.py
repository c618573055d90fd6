"""Record tables derived from the star schema and the text tables, in SQL that Spark and DuckDB read alike.

{name} stands for a table or another view. Only integer arithmetic, CASE and concat are used.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "v_documents": """SELECT c_custkey AS document_id, concat('record_', c_custkey, '.pdf') AS original_filename,
        CASE c_custkey % 6 WHEN 0 THEN 'UPLOADED' WHEN 1 THEN 'processing' WHEN 2 THEN 'PROCESSED' WHEN 3 THEN 'VALIDATION_REQUIRED' WHEN 4 THEN 'VERIFIED' ELSE 'FAILED' END AS status,
        (c_custkey * 7919) % 100003 AS created_at FROM {customer}""",
    "v_runs": """SELECT o_orderkey AS run_id, o_custkey AS document_id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END AS status,
        o_orderdate AS created_at, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS completed_at FROM {orders}""",
    "v_pages": "SELECT o_orderkey AS page_id, o_custkey AS document_id, CAST(o_orderkey % 9 AS INT) AS page_number FROM {orders}",
    "v_fields": """SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', CAST(round(l_extendedprice * 100) AS BIGINT)) AS field_id,
        o_custkey AS document_id, l_orderkey AS run_id, l_orderkey AS page_id, l_linenumber AS page_number,
        CASE l_linenumber WHEN 1 THEN 'village' WHEN 2 THEN 'taluka' WHEN 3 THEN 'district' WHEN 4 THEN 'survey_number' WHEN 5 THEN 'khata_number' WHEN 6 THEN 'area'
          ELSE CASE l_suppkey % 3 WHEN 0 THEN 'mutation' WHEN 1 THEN 'registration' ELSE 'owner' END END AS field_name,
        CASE WHEN l_partkey % 29 = 0 THEN '' WHEN l_partkey % 31 = 0 THEN NULL WHEN l_partkey % 23 = 0 THEN 'Name' ELSE
        CASE l_linenumber
          WHEN 1 THEN CASE l_partkey % 6 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'Automobile' WHEN 2 THEN 'machinery ' WHEN 3 THEN 'HOUSEHOLD.' WHEN 4 THEN 'FURNITURE' ELSE 'Nowhere' END
          WHEN 2 THEN concat('Nation_', l_partkey % 26)
          WHEN 3 THEN CASE l_partkey % 5 WHEN 0 THEN 'Africa' WHEN 1 THEN 'AMERICA' WHEN 2 THEN 'asia' WHEN 3 THEN 'EUROPE' ELSE 'Middle East' END
          WHEN 4 THEN concat(l_partkey % 200, CASE WHEN l_suppkey % 4 = 0 THEN '-' ELSE '/' END, l_suppkey % 9)
          WHEN 5 THEN CASE WHEN l_suppkey % 5 = 0 THEN concat(l_partkey % 50, ' x') ELSE concat(l_partkey % 50, '') END
          WHEN 6 THEN concat(l_partkey % 4, CASE WHEN l_suppkey % 2 = 0 THEN ',' ELSE '.' END, l_suppkey % 7, ' ha')
          ELSE CASE l_suppkey % 3 WHEN 2 THEN concat('Owner ', l_partkey % 40) ELSE concat('No. ', l_partkey, ' of ', 1 + l_partkey % 31, '/', 1 + l_suppkey % 13, '/', 1990 + l_partkey % 30) END END END AS value,
        CAST(NULL AS VARCHAR(10)) AS normalized_value,
        CASE WHEN l_suppkey % 10 = 3 THEN NULL ELSE l_quantity * 2 END AS confidence,
        CASE WHEN l_partkey % 17 = 0 THEN 'spatial_label_value_suspect' WHEN l_partkey % 3 = 0 THEN 'regex_label' ELSE 'owner_table_row' END AS method,
        CASE l_returnflag WHEN 'R' THEN 'REVIEW' WHEN 'A' THEN 'WARNING' ELSE 'PASS' END AS validation_status,
        l_shipdate AS created_at FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    # What a field reads as once its marks are out of the way: absent in a quarter of the runs, blank in another.
    "v_normalized": """SELECT field_id, document_id, run_id, field_name, value, CASE run_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE
        CASE field_name WHEN 'survey_number' THEN replace(value, '-', '/') WHEN 'khata_number' THEN replace(value, ' x', '') WHEN 'area' THEN replace(value, ' ha', '')
          WHEN 'owner' THEN CASE WHEN document_id % 5 = 0 THEN 'name' ELSE lower(value) END ELSE lower(value) END END AS normalized_value, confidence, method, created_at FROM {v_fields}""",
    "v_results": """SELECT field_id, document_id, run_id, field_name, concat('rule_', page_number % 3) AS rule_name,
        CASE WHEN page_number = 6 THEN 'FAIL' ELSE validation_status END AS status, 'as read' AS message, confidence FROM {v_fields}""",
    "v_reference": """SELECT concat('D', r_regionkey) AS district_code, r_name AS district_name, concat('T', n_nationkey) AS taluka_code, n_name AS taluka_name, c_mktsegment AS village_name,
        CASE WHEN n_nationkey % 2 = 0 THEN concat('Old ', c_mktsegment) ELSE NULL END AS local_name
        FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM {customer}) s JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "v_claims": """SELECT c_custkey AS claim_id, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment WHEN 1 THEN concat(' Old  ', lower(c_mktsegment), '.') WHEN 2 THEN 'Unknown place' ELSE c_mktsegment END AS village,
        CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN n_name ELSE 'NATION_99' END AS taluka, CASE WHEN c_custkey % 5 = 0 THEN r_name ELSE NULL END AS district
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "v_records": """SELECT c_custkey AS record_id, c_custkey AS document_id, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END AS owner, concat(c_custkey % 50, '/', c_custkey % 3) AS survey_number, concat(c_custkey % 17, '') AS khata_number,
        c_mktsegment AS village, n_name AS taluka, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE r_name END AS district, concat(CAST(abs(floor(c_acctbal / 100)) AS BIGINT), '.5') AS area
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "v_actions": """SELECT event_id AS action_id, user_id AS document_id, concat('f', user_id) AS field_id, CASE event_type WHEN 'click' THEN 'ACCEPT' WHEN 'view' THEN 'VERIFY' WHEN 'error' THEN 'FLAG' WHEN 'signup' THEN 'REJECT' ELSE 'EDIT' END AS action,
        CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 9 = 0 THEN ' ' ELSE concat(' Value ', event_id, ' ') END ELSE NULL END AS new_value, CASE WHEN event_id % 2 = 0 THEN 'checked' ELSE NULL END AS reason, ts FROM {events}""",
    "v_review_fields": "SELECT DISTINCT concat('f', user_id) AS field_id, concat('Start ', user_id) AS value, concat('start ', user_id) AS normalized_value, 'PENDING' AS validation_status FROM {events}",
    "v_pairs": """SELECT conv_id, turn, lower(text) AS ref, lower(lead(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS pred FROM {conversations}""",
    "v_uploads": """SELECT page_id AS file_id, CASE page_id % 8 WHEN 0 THEN '' WHEN 1 THEN 'a.exe' WHEN 2 THEN 'scan.PDF' WHEN 3 THEN 'scan.jpeg' ELSE concat('p', page_id, '.pdf') END AS name,
        CASE WHEN page_id % 11 = 0 THEN 'text/html' ELSE 'application/pdf' END AS content_type, CASE WHEN page_id % 13 = 0 THEN '' WHEN page_id % 3 = 0 THEN html ELSE concat('%PDF-1.7 ', html) END AS body FROM {pages}""",
    "v_incoming": "SELECT doc_id AS file_id, text AS body FROM {documents}",
    "v_grids": """SELECT o_orderkey AS doc_id, concat('<p>x</p><table><tr><th>भूमापन क्रमांक</th><th>खाते क्रमांक</th><th>holder &amp; name &#8377;</th></tr><tr><td>', o_custkey, '/', o_orderkey % 9, '</td><td>', o_custkey * 3, '</td><td>', o_orderpriority, '<br/>', 'c', '</td></tr></table>') AS html, o_custkey AS n, o_orderpriority AS tenure
        FROM {orders}""",
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or a view over tables."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
    return spark.sql(VIEWS[name], **{n: frame(spark, sf_dir, n) for n in needs})


def sql(body: str, *names: str) -> str:
    """DuckDB SQL: the views that ``names`` need, then ``body``."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in order:
            for n in re.findall(r"\{(\w+)\}", VIEWS[name]):
                add(n)
            order.append(name)

    for n in names:
        add(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in order) + ("," if body.lstrip().startswith(",") else "\n") + body.lstrip(" ,\n")
