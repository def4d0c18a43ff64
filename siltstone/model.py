"""The domain's tables, derived from the test tables.

Each view is defined once as SQL text that both Spark and DuckDB run, so a query and its
counterpart start from the same rows. Views are chained as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.session import spread, table

#: (name, tables it reads, SQL). Integer arithmetic only, so that both engines agree.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "project": (
        ("part",),
        """SELECT p_partkey AS project_id, p_name AS name, p_brand AS developer, p_type AS product_type, p_size AS units, p_retailprice AS price,
             CAST(p_partkey % 7 AS INT) AS status_rank, CAST(p_partkey % 5 AS INT) AS market_id, CAST(p_partkey % 25 AS INT) AS jurisdiction_id,
             33.9 + CAST((p_partkey * 37) % 1000 AS DOUBLE) / 20000 AS lat, -118.4 + CAST((p_partkey * 91) % 1000 AS DOUBLE) / 20000 AS lng,
             CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE concat(CAST(100 + p_partkey % 300 AS VARCHAR(10)), ' ', upper(p_brand), ' STREET LOS ANGELES CA ', CAST(90001 + p_partkey % 40 AS VARCHAR(10))) END AS address
           FROM part""",
    ),
    "evidence": (
        ("lineitem", "orders"),
        """SELECT l_orderkey * 10 + l_linenumber AS evidence_id, l_partkey AS project_id,
             CASE WHEN l_returnflag = 'A' THEN 'city_permit' WHEN l_returnflag = 'R' THEN 'news_article' WHEN l_linestatus = 'O' THEN 'vendor_a' ELSE 'vendor_b' END AS source_type,
             CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN 3 ELSE 2 END AS tier,
             CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS evidence_date, o_orderdate AS collected_at, CAST(l_quantity AS INT) AS units,
             l_suppkey AS developer_id, CAST(l_linenumber % 7 AS INT) AS status_rank, l_orderkey % 17 = 0 AS superseded
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    ),
    "review_item": (
        ("orders",),
        """SELECT o_orderkey AS item_id, o_custkey AS project_id, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'staged' ELSE 'committed' END AS state,
             CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS priority,
             CASE o_orderkey % 4 WHEN 0 THEN 'field_change' WHEN 1 THEN 'new_candidate' WHEN 2 THEN 'possible_match' ELSE 'status_regression' END AS item_type,
             CAST(o_orderkey % 25 AS INT) AS jurisdiction_id, o_orderdate AS created_at, o_totalprice AS amount
           FROM orders""",
    ),
    "fielded": (
        ("lineitem", "orders"),
        """SELECT l_orderkey * 10 + l_linenumber AS evidence_id, l_partkey AS project_id,
             CASE WHEN l_returnflag = 'A' THEN 'city_permit' WHEN l_returnflag = 'R' THEN 'news_article' WHEN l_linestatus = 'O' THEN 'vendor_a' ELSE 'vendor_b' END AS source_type,
             CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN 3 ELSE 2 END AS tier,
             CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS evidence_date, o_orderdate AS collected_at, l_orderkey % 17 = 0 AS superseded,
             CASE WHEN (l_orderkey + l_linenumber) % 10 = 0 THEN 'n/a' WHEN (l_orderkey + l_linenumber) % 10 < 5 THEN CAST(1 + l_suppkey % 12 AS VARCHAR(9)) END AS stories,
             CASE (l_orderkey + l_suppkey) % 7 WHEN 0 THEN 'Condos' WHEN 1 THEN 'apartment' WHEN 2 THEN 'townhomes' WHEN 3 THEN 'warehouse' WHEN 4 THEN '  ' END AS product_type,
             CASE l_suppkey % 5 WHEN 0 THEN 'Senior' WHEN 1 THEN 'student' WHEN 2 THEN 'Non Age-Restricted' WHEN 3 THEN 'adults' END AS age_restriction,
             CASE WHEN l_linenumber % 3 = 0 THEN concat('Developer ', CAST(l_suppkey % 50 AS VARCHAR(9)), ', LLC') END AS developer,
             CASE WHEN l_linenumber % 4 = 0 THEN CAST(CAST(l_shipdate AS DATE) AS VARCHAR(10)) WHEN l_linenumber % 4 = 1 THEN 'soon' END AS delivery,
             CAST(l_quantity AS INT) AS units, CAST(l_linenumber % 7 AS INT) AS status_rank, concat('R', CAST(l_orderkey % 500 AS VARCHAR(9))) AS record_id
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    ),
    "reference": (
        ("orders",),
        """SELECT o_orderkey AS reference_id, o_custkey AS article_id, CAST(1 + o_orderkey % 200 AS INT) AS project_id, CAST(o_orderkey % 3 AS INT) AS extraction_id, CAST(o_custkey % 3 AS INT) AS current_extraction_id,
             CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % 130 AS INT) END AS units, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('Brand#', CAST(o_orderkey % 25 AS VARCHAR(9))) END AS developer,
             CASE o_orderkey % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS confidence, CASE o_orderkey % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'possible' WHEN 2 THEN 'new_candidate' ELSE 'discarded' END AS match_status,
             CAST(o_orderkey % 3 AS INT) AS candidates, CAST(o_orderkey % 7 AS INT) AS status_rank, CAST(o_totalprice AS DOUBLE) / 500000 AS score, o_orderdate AS created_at
           FROM orders""",
    ),
    "decision": (
        ("orders",),
        """SELECT o_orderkey AS item_id, o_custkey AS project_id, CASE o_orderkey % 5 WHEN 0 THEN 'accept_new' WHEN 1 THEN 'keep_old' WHEN 2 THEN 'custom' WHEN 3 THEN 'candidate_2' ELSE 'defer' END AS decision_type,
             CASE o_orderkey % 4 WHEN 0 THEN 'field_change' WHEN 1 THEN 'new_candidate' WHEN 2 THEN 'override_contradiction' ELSE 'status_regression' END AS item_type, CASE WHEN o_orderkey % 3 = 0 THEN 'units' END AS field_column,
             CASE o_orderkey % 6 WHEN 0 THEN 'staged' WHEN 1 THEN 'staged' WHEN 2 THEN 'open' ELSE 'committed' END AS state, CAST(o_orderkey % 25 AS INT) AS jurisdiction_id, o_orderdate AS decided_at,
             concat(chr(123), '"current_value":"', CAST(o_orderkey % 90 AS VARCHAR(9)), '"', CASE WHEN o_orderkey % 4 = 1 THEN ',"field_name":"stories"' ELSE '' END, CASE WHEN o_orderkey % 8 = 0 THEN concat(',"current_override":', chr(123), '"value":"kept"', chr(125)) ELSE '' END,
               CASE WHEN o_orderkey % 8 = 2 THEN concat(',"changes":[', chr(123), '"field":"developer","old":"was"', chr(125), ']') ELSE '' END, chr(125)) AS payload
           FROM orders""",
    ),
    "feed": (
        ("orders",),
        """SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 11 = 0 THEN '--' ELSE concat(CAST(o_orderkey % 100 AS VARCHAR(9)), '-', CAST(o_orderkey % 90000 AS VARCHAR(9)), '-', CAST(10000 + o_orderkey % 500 AS VARCHAR(9))) END AS permit,
             CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat('C', CAST(o_orderkey AS VARCHAR(20))) END AS cofo_number, CASE o_orderkey % 3 WHEN 0 THEN 'CofO Issued' WHEN 1 THEN ' cofo issued ' ELSE 'Pending' END AS latest_status,
             CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE concat(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)), 'T00:00:00.000') END AS issue_date,
             CASE o_orderkey % 4 WHEN 0 THEN 'Apartment' WHEN 1 THEN 'Duplex' WHEN 2 THEN 'Retail' END AS use_desc, CAST(o_orderkey % 9999 AS VARCHAR(9)) AS book, CAST(o_orderkey % 999 AS VARCHAR(9)) AS page, CASE WHEN o_orderkey % 6 = 0 THEN 'x' ELSE CAST(o_custkey % 999 AS VARCHAR(9)) END AS parcel,
             CASE o_orderkey % 5 WHEN 0 THEN 'Approved' WHEN 1 THEN 'Partial Approval' WHEN 2 THEN 'Not Ready' ELSE 'Completed' END AS result, CASE o_orderkey % 3 WHEN 0 THEN 'Issued' WHEN 1 THEN 'Expired' ELSE 'Pending CofO' END AS permit_status,
             concat('  ', CAST(o_custkey % 900 AS VARCHAR(9)), ' Main St ') AS address, 33.5 + CAST(o_orderkey % 100 AS DOUBLE) / 64 AS lat, -118.5 + CAST(o_orderkey % 100 AS DOUBLE) / 64 AS lng, o_orderdate AS updated_at, CAST(o_custkey % 4 AS INT) AS source_id, CAST(o_totalprice AS DOUBLE) AS amount
           FROM orders""",
    ),
    "article": (
        ("orders",),
        """SELECT o_orderkey AS article_id, CAST(o_custkey % 5 AS INT) AS market_id, concat('News of ', CAST(200 + o_orderkey % 700 AS VARCHAR(9)), ' Oak Avenue') AS title, o_orderdate AS published,
             concat('The developer filed plans for a ', CAST(20 + o_orderkey % 900 AS VARCHAR(9)), '-unit senior housing project at ', CAST(100 + o_custkey % 800 AS VARCHAR(9)), ' North Main Street, Los Angeles, CA 900', CAST(10 + o_custkey % 80 AS VARCHAR(9)),
               '. It has ', CAST(1 + o_orderkey % 90 AS VARCHAR(9)), ' affordable homes and townhomes under case CPC-20', CAST(10 + o_orderkey % 10 AS VARCHAR(9)), '-', CAST(1000 + o_orderkey % 9000 AS VARCHAR(9)), '. ',
               CASE o_orderkey % 3 WHEN 0 THEN 'Crews broke ground on 2023-05-14. ' WHEN 1 THEN 'It is now leasing. ' ELSE '' END, 'Completion is expected in Q', CAST(1 + o_orderkey % 4 AS VARCHAR(9)), ' 20', CAST(24 + o_orderkey % 5 AS VARCHAR(9)),
               '. Parcel ', CAST(1000 + o_custkey % 9000 AS VARCHAR(9)), '-', CAST(100 + o_orderkey % 900 AS VARCHAR(9)), '-', CAST(100 + o_custkey % 900 AS VARCHAR(9)), ' has permit 19010-10000-', CAST(10000 + o_orderkey % 90000 AS VARCHAR(9)), ' and fees of $250 rooms.') AS body
           FROM orders""",
    ),
    "override": (
        ("part",),
        """SELECT p_partkey AS project_id, CASE p_partkey % 3 WHEN 0 THEN 'units' WHEN 1 THEN 'stories' ELSE 'developer' END AS field,
             CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS VARCHAR(9)) WHEN 1 THEN CAST(p_size % 12 AS VARCHAR(9)) ELSE p_brand END AS value,
             p_partkey % 4 = 0 AS by_system, CASE WHEN p_partkey % 2 = 0 THEN 'until_newer_evidence' ELSE 'keep' END AS mode, p_partkey % 9 = 0 AS cleared,
             CAST('1997-01-01' AS DATE) AS base_date, CAST(p_partkey % 3 + 1 AS INT) AS base_tier
           FROM part""",
    ),
    "activity": (
        ("events",),
        """SELECT event_id, ts AS occurred_at, user_id AS source_id, event_type, value, CAST(ts AS DATE) AS day FROM events""",
    ),
}


def views(spark: SparkSession, sf_dir: str, *names: str, spread_by: str | None = None) -> list[DataFrame]:
    """The named views as DataFrames; with `spread_by`, a column of their one table, this table is dealt out to all cores first (see `spread`)."""
    out = []
    for name in names:
        tables, sql = VIEWS[name]
        rows = {t: table(spark, sf_dir, t) for t in tables}
        if spread_by:
            rows = {t: spread(r, spread_by) for t, r in rows.items()}
        out.append(spark.sql(_parameterised(sql, tables), **rows))
    return out


def _parameterised(sql: str, tables: tuple[str, ...]) -> str:
    """The view's SQL with its tables as parameters, so that nothing is registered in the session."""
    words = []
    previous = ""
    for word in sql.split(" "):
        bare = word.strip("\n,")
        words.append(word.replace(bare, "{" + bare + "}") if bare in tables and previous in ("FROM", "JOIN") else word)
        previous = bare or previous
    return " ".join(words)


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL that begins with the named views."""
    head = ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"
