"""Domain tables from the tables at hand, as SQL that Spark and DuckDB both take.

``{name}`` stands for a table; ``view`` fills in DataFrames, ``cte`` plain names for the SQL twin of a query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from camloom.operators.running import numbered
from camloom.sources.shared import scratch

ADAPTERS = {
    "frames": """
select 'cam-' || lpad(cast(user_id % 16 as string), 2, '0') as camera,
       cast(row_number() over (partition by user_id % 16 order by ts, event_id) as bigint) as seq,
       event_id as src_id, ts, cast(round(value * 100e0) as bigint) as byte_count, event_type = 'signup' as is_keyframe
from {events}""",
    "plain_frames": """
select 'cam-' || lpad(cast(user_id % 16 as string), 2, '0') as camera, event_id as src_id, ts, cast(round(value * 100e0) as bigint) as byte_count, event_type = 'signup' as is_keyframe
from {events}""",
    "raw_events": """
select lpad(cast(event_id as string), 26, '0') as event_id, 'site-' || cast(user_id % 3 as string) as site,
       'cam-' || lpad(cast(user_id % 16 as string), 2, '0') as camera, cast(user_id % 16 as int) as cam_id, ts,
       case event_type when 'error' then 'idr_burst' when 'signup' then 'scene_change' else 'motion' end as type,
       value / 10e0 as z_score, (event_id % 41) / 8e0 as intra_ratio, (event_id * 7919) % 9000 as bytes,
       case when event_id % 50 = 0 then 0e0 else 400e0 + (user_id % 16) * 150e0 end as bpf_slow,
       case when event_type = 'error' then 'unexpected_idr'
            else 'z=' || cast(cast((zt - zt % 1000) / 1000 as bigint) as string) || '.' || lpad(cast(zt % 1000 as string), 3, '0')
              || case when event_id % 5 = 0 then ',intra_ratio=' || cast(cast((it - it % 1000) / 1000 as bigint) as string)
                                                || '.' || lpad(cast(it % 1000 as string), 3, '0') else '' end end as reason,
       cast(case event_type when 'click' then 5 when 'view' then 130 else 0 end as smallint) as target_class_mask
from (select *, cast(round(value * 100e0) as bigint) as zt, (event_id % 41) * 125 as it from {events}) e""",
    "event_labels": """
select lpad(cast(doc_id as string), 26, '0') as event_id,
       case when toxic = 1 then 'reference' when quality = 1 then 'tp' else 'fp' end as label
from {labels}""",
    "clips": """
select 'cam-' || lpad(cast(o_custkey % 16 as string), 2, '0') as camera,
       'clip_' || lpad(cast(o_orderkey as string), 10, '0') ||
         case o_orderpriority when '1-URGENT' then '.ts' when '2-HIGH' then '.mpegts' when '3-MEDIUM' then '.mp4'
                              when '4-NOT SPECIFIED' then '.mkv' else '.json' end as filename,
       lpad(cast(o_orderkey as string), 26, '0') as event_id,
       cast(round(o_totalprice * 100e0) as bigint) as size, o_orderdate as mod_time
from {orders}""",
    "nal": """
select 'cam-' || lpad(cast(l_suppkey % 16 as string), 2, '0') as camera,
       cast(row_number() over (partition by l_suppkey % 16
         order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity,
                  l_discount, l_tax, l_returnflag, l_linestatus) as bigint) as seq,
       l_orderkey * 3003 as pts_90khz, cast(round(l_extendedprice) as bigint) as length,
       cast(case l_returnflag when 'A' then 5 when 'R' then 7 else 1 end as smallint) as nal_type,
       cast((case l_returnflag when 'A' then 1 when 'R' then 2 else 0 end) + (case when l_returnflag = 'N' and l_linenumber = 4 then 8 else 0 end) as smallint) as flags
from {lineitem}""",
    "camera_config": """
select 'cam-' || lpad(cast(n_nationkey as string), 2, '0') as camera,
       3e0 + (n_nationkey % 4) * 5e-1 as motion_z_high, 25e-1 as intra_ratio_high,
       cast(2 + n_nationkey % 2 as smallint) as on_threshold, cast(5 + n_nationkey % 5 as smallint) as off_threshold,
       1e2 as bpf_floor, cast(case when n_nationkey % 3 = 0 then 2000 else 0 end as bigint) as min_bytes_threshold,
       cast(6 as bigint) as pre_roll_seconds, cast(8 as bigint) as post_roll_seconds
from {nation} where n_nationkey < 16""",
    "macroblocks": """
select camera, frame, cast((ay + (k - k % 4) / 4) * 16 + ax + k % 4 as int) as cell, mv_x, mv_y, skipped, intra, residual
from (select 'cam-' || lpad(cast(l_suppkey % 16 as string), 2, '0') as camera, cast((l_orderkey - l_orderkey % 48) / 48 as bigint) as frame,
             l_partkey % 5 * 3 as ax, l_linenumber % 4 * 3 as ay, round(l_discount * 100e0) - 3e0 as mv_x, round(l_tax * 100e0) as mv_y,
             l_returnflag = 'N' and l_linenumber = 4 as skipped, l_returnflag = 'A' as intra, l_linestatus = 'O' as residual from {lineitem}) l
cross join (values (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13), (14), (15)) as t(k)""",
    # macroblocks as squares of four by four, which have all but the cell in common
    "block_squares": """
select 'cam-' || lpad(cast(l_suppkey % 16 as string), 2, '0') as camera, cast((l_orderkey - l_orderkey % 48) / 48 as bigint) as frame,
       cast(l_linenumber % 4 * 3 * 16 + l_partkey % 5 * 3 as int) as cell, round(l_discount * 100e0) - 3e0 as mv_x, round(l_tax * 100e0) as mv_y,
       l_returnflag = 'N' and l_linenumber = 4 as skipped, l_returnflag = 'A' as intra, l_linestatus = 'O' as residual
from {lineitem}""",
}
TABLES = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables whose rows are numbered along an order: the table, the key, ranges that never fall along the order, and the order.
ORDERED = {
    "frames": ("events", "user_id % 16", "floor(unix_micros(cast(ts as timestamp)) / 86400000000)", ["ts", "event_id"]),
    "nal": ("lineitem", "l_suppkey % 16", "floor(l_orderkey / 65536)", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]),
}
NUMBER = re.compile(r"cast\(row_number\(\) over \(.*?\) as bigint\)", re.S)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table. One whose rows are numbered is numbered in two levels and written once, as its users read it more than once."""
    text = ADAPTERS[name]
    if name in ORDERED:
        source, key, range_, order = ORDERED[name]
        rows = table(spark, sf_dir, source).withColumns({"q_key": F.expr(key), "q_range": F.expr(range_)})
        return scratch(spark.sql(NUMBER.sub("q_seq", text), **{source: numbered(rows, "q_key", order, "q_seq")}), name)
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in set(TABLES.findall(text))})


def cte(*names: str) -> str:
    """``name as (...)`` for each domain table, to follow WITH."""
    return ", ".join(f"{n} as ({TABLES.sub(lambda m: m[1], ADAPTERS[n])})" for n in names)
