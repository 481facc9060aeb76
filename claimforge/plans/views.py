"""Patent-shaped inputs made from the generic tables, by one SQL text that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.judges import specification
from ..operators.search import Brief

SPEC = (
    "The assembly has an economy housing and a standard housing.\n"
    "A small ring or a red widget holds brand 17 parts. The size 11 carrier moves along the rail.\n"
    "A blue bolt and hot plates hold brand 12 gears. Brand 2 carriers of size 7 move.\n"
    "Medium rods are arranged in the frame."
)
QUERY = "The and for anthe of thing er edit. En la de thion that ering heth"
BRIEF = Brief(name="watch", description=QUERY, keywords=(("thion", "the"), ("nder", "ering")), cpc=("SRC1", "SRC2/3"), countries=("EN", "DE"), date_from="2001-01-01", limit=5000)

#: Text of each view; {table} stands for a table. Only functions that both engines have.
VIEWS = {
    "v_numbers": """
        SELECT p_partkey, CASE CAST(p_partkey % 8 AS INT)
            WHEN 0 THEN concat('US 8,', substr(CAST(1000000 + p_partkey AS STRING), 2, 3), ',', substr(CAST(1000000 + p_partkey AS STRING), 5, 3), ' B2')
            WHEN 1 THEN concat('US2021', CAST(1000000 + p_partkey AS STRING), 'A1')
            WHEN 2 THEN concat('EP 1 ', substr(CAST(1000000 + p_partkey AS STRING), 2, 3), ' ', substr(CAST(1000000 + p_partkey AS STRING), 5, 3), CASE WHEN p_partkey % 3 = 0 THEN ' B1' ELSE ' A1' END)
            WHEN 3 THEN concat('WO2020/', substr(CAST(1000000 + p_partkey AS STRING), 2, 6), CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'A2' END)
            WHEN 4 THEN concat('特開2003-', substr(CAST(1000000 + p_partkey AS STRING), 2, 6))
            WHEN 5 THEN concat('特開平10-', CAST(100 + p_partkey AS STRING))
            WHEN 6 THEN concat('特許第4', substr(CAST(1000000 + p_partkey AS STRING), 2, 6), '号')
            ELSE CASE WHEN p_partkey % 3 = 0 THEN '  ' ELSE CAST(900000000 + p_partkey AS STRING) END END AS raw
        FROM {part}""",
    "v_records": """
        SELECT p_partkey, concat('US-', CAST(8000000 + p_partkey AS STRING), '-B2') AS canonical, 'US' AS office,
            CAST(8000000 + p_partkey AS STRING) AS number, p_name AS title, p_brand AS assignee, p_type AS abstract,
            CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(floor(p_partkey / 3) AS STRING) END AS family_id,
            CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE '2001-02-03' END AS pub_date,
            CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'UNKNOWN' END AS legal_status,
            CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE concat('1. A ', p_name, ' assembly comprising: a ', lower(p_type), ' housing; a ', p_name,
                ' configured to hold ', p_brand, '; and a size ', CAST(p_size AS STRING), ' carrier arranged to move') END AS claim
        FROM {part}""",
    "v_legal": """
        SELECT CAST(user_id AS STRING) AS canonical, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS pos,
            substr(CAST(ts AS STRING), 1, 10) AS date,
            CASE event_type WHEN 'signup' THEN 'GRANT' WHEN 'error' THEN 'MM4A' WHEN 'click' THEN 'EXP' WHEN 'purchase' THEN 'RESTORE' ELSE 'PGFP' END AS code,
            CASE event_type WHEN 'signup' THEN 'PATENT GRANTED' WHEN 'error' THEN 'LAPSE DUE TO NON-PAYMENT' WHEN 'click' THEN 'PATENT EXPIRED'
                WHEN 'purchase' THEN 'RIGHTS REINSTATED' ELSE 'ANNUAL FEE PAID' END AS description
        FROM {events} WHERE user_id % 5 > 0 OR event_type IN ('signup', 'view')""",
    "v_snapshots": """
        SELECT CAST(o_custkey AS STRING) AS canonical, concat(substr(CAST(o_orderdate AS STRING), 1, 10), 'T', CAST(1000000000 + o_orderkey AS STRING)) AS fetched_at,
            o_orderstatus AS legal_status, substr(o_orderpriority, 1, 1) AS family_id
        FROM {orders}""",
    "v_runs": """
        SELECT event_type AS theme, substr(CAST(ts AS STRING), 1, 10) AS run_date, CAST(user_id AS STRING) AS pub FROM {events}""",
}

#: Tables of short rows, of which a small file has so many that one or two tasks would do all the work on them; they are
#: dealt by a key, to as many tasks as a shuffle has.
DEALT = {"part": "p_partkey"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    table = text[text.index("{") + 1 : text.index("}")]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if table in DEALT:
        rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), DEALT[table])
    return spark.sql(text, **{table: rows})


def cte(*names: str) -> str:
    """``WITH`` clause of the views for the other engine."""
    out = []
    for n in names:
        text = VIEWS[n]
        table = text[text.index("{") + 1 : text.index("}")]
        out.append(f"{n} AS ({text.replace('{' + table + '}', table)})")
    return "WITH " + ", ".join(out)


def spec(spark: SparkSession) -> DataFrame:
    return specification(spark, SPEC)
