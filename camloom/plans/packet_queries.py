"""Queries on RTP packets, made of the columns of records: with extensions, padding, sources, aggregates, fragments and losses."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from camloom.functions.bitstream import byte_at, nal_flags, nal_type, reordered, rtp_header, rtp_payload, slice_type, unwrapped, with_parsed
from camloom.operators.depacketize import depacketized, packet_kind
from camloom.operators.slices import slice_headers
from camloom.plans.registry import query
from camloom.sources.adapters import cte, view
from camloom.sources.shared import dropped

#: Four records are seven packets: one alone, one in three fragments, one as an aggregate of two, one in two fragments.
PLACE, PARTS = (0, 1, 4, 5), (1, 3, 1, 2)
LOST = 23
TYPES = {"h264": {1: 1, 5: 5, 7: 7}, "h265": {1: 1, 5: 19, 7: 33}}


def packets_of(nal: DataFrame, codec: str) -> DataFrame:
    """camera, arrival, packet: what is sent for each record, less each packet whose number leaves 7 by LOST; neighbours change places."""
    h265 = codec == "h265"
    two = lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))
    kind = F.when(F.col("nal_type") == 5, TYPES[codec][5]).when(F.col("nal_type") == 7, TYPES[codec][7]).otherwise(TYPES[codec][1])
    group = (F.col("seq") - 1) % 4
    rows = nal.withColumns({"j": group, "kind": kind, "body": F.md5(F.concat_ws(":", "camera", "seq"))})
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("j").cast("int") + 1)
    rows = rows.withColumns({"base": (F.col("seq") - 1 - F.col("j")) / 4 * 7 + of(PLACE), "m": of(PARTS)}).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    rows = rows.withColumn("p", (F.col("base") + F.col("i")).cast("long"))
    head = F.concat(two(F.col("kind") * 2), F.lit("01")) if h265 else two(F.col("kind") + 96)
    fragment = F.concat(F.lit("6201" if h265 else "7c"), two(F.col("kind") + F.when(F.col("i") == 0, 128).otherwise(0) + F.when(F.col("i") == F.col("m") - 1, 64).otherwise(0)))
    # 16 bytes in three parts are 6, 5 and 5, in two 8 and 8.
    cut = F.when(F.col("m") == 2, F.col("body").substr(F.col("i") * 16 + 1, F.lit(16))).when(F.col("i") == 0, F.col("body").substr(1, 12)).otherwise(F.col("body").substr(F.col("i") * 10 + 3, F.lit(10)))
    half = lambda at: F.concat(F.lit("000a" if h265 else "0009"), head, F.col("body").substr(at, 16))
    payload = F.when(F.col("j") == 0, F.concat(head, "body")).when(F.col("j") == 2, F.concat(F.lit("6001" if h265 else "78"), half(1), half(17))).otherwise(F.concat(fragment, cut))
    extended, padded, sources = F.col("p") % 3 == 1, F.col("p") % 5 == 2, F.col("p") % 2
    first = F.lit(128) + F.when(extended, 16).otherwise(0) + F.when(padded, 32).otherwise(0) + sources
    wide = lambda c, n: F.lpad(F.hex(c.cast("long")), n, "0")
    packet = F.concat(
        two(first), two(F.lit(96) + F.when(F.col("i") == F.col("m") - 1, 128).otherwise(0)), wide(F.col("p") % 65536, 4), wide(F.col("pts_90khz") % (1 << 32), 8), F.lit("0000002a"),
        F.when(sources == 1, "0badcafe").otherwise(""), F.when(extended, "bede0001cafebabe").otherwise(""), payload, F.when(padded, "000003").otherwise(""),
    )
    sent = rows.where(F.col("p") % LOST != 7)
    return sent.select("camera", (F.col("p") + F.when(F.col("p") % 2 == 0, 1).otherwise(-1)).alias("arrival"), F.unhex(packet).alias("packet"))


def parsed(nal: DataFrame, codec: str, *columns: Column | str) -> DataFrame:
    """Packets as they arrive, with these columns of theirs; what is not asked for is not moved."""
    h = rtp_header(F.col("packet"))
    packets = packets_of(nal, codec).select("camera", "arrival", h.alias("h"), rtp_payload(F.col("packet")).alias("payload"))
    return packets.select("camera", "arrival", "h.seq", *columns)


def _sent(codec: str) -> str:
    """The records as packets: base is the number of the first, m how many, head the unit's header."""
    kinds = " ".join(f"when {k} then {v}" for k, v in TYPES[codec].items())
    head = "printf('%02x', k * 2) || '01'" if codec == "h265" else "printf('%02x', k + 96)"
    return f"""with {cte('nal')}, r as (select camera, pts_90khz, (seq - 1) % 4 as j, (seq - 1) // 4 * 7 + [0, 1, 4, 5][(seq - 1) % 4 + 1] as base, [1, 3, 1, 2][(seq - 1) % 4 + 1] as m, case nal_type {kinds} end as k, md5(camera || ':' || seq) as body from nal),
s as (select *, {head} as head, m > 0 and not exists (select 1 from range(3) as t(i) where i < m and (base + i) % {LOST} = 7) as whole from r)"""


def _units(codec: str) -> str:
    return f"""{_sent(codec)}
select camera, cast(base + m - 1 as bigint) as seq_long, cast(0 as bigint) as part, cast(pts_90khz % 4294967296 as bigint) as timestamp, true as marker, head || body as nal from s where whole and j != 2
union all select camera, base, part, pts_90khz % 4294967296, part = 1, head || body[part * 16 + 1 : part * 16 + 16] from s, (values (0), (1)) as t(part) where whole and j = 2"""


def _depacketized(spark, d, codec: str) -> DataFrame:  # noqa: ANN001
    nal = view(spark, d, "nal")
    packets = unwrapped(parsed(nal, codec, "h.timestamp", "h.marker", "payload"))
    dropped(nal)
    out = depacketized(packets, codec, order="arrival")
    dropped(packets)
    return out.withColumn("nal", F.lower(F.hex("nal")))


@query(_units("h264"))
def depacketized_h264(spark, d):
    """Units of all records, after packets with extensions and padding that came out of order, and some not at all."""
    return _depacketized(spark, d, "h264")


@query(_units("h265"))
def depacketized_h265(spark, d):
    return _depacketized(spark, d, "h265")


@query(f"""{_sent("h264")}, p as (select camera, j, base + i as p from s, range(3) as t(i) where i < m and (base + i) % {LOST} != 7),
b as (select *, p - coalesce(lag(p) over (partition by camera order by p), p - 1) - 1 as lost from p)
select camera, case j when 0 then 'single' when 2 then 'aggregate' else 'fragment' end as kind, count(*) as n, cast(sum(lost) as bigint) as lost from b group by 1, 2""")
def packet_kinds(spark, d):
    """Packets of each kind, and how many were missing before them."""
    heads = reordered(parsed(view(spark, d, "nal"), "h264", F.substring("payload", 1, 8).alias("payload")))  # a kind is told by fewer bytes
    rows = heads.select("camera", packet_kind(F.col("payload"), "h264").alias("kind"), "lost")
    return rows.groupBy("camera", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("lost").alias("lost"))


def _ue(value: Column) -> Column:
    """The Exp-Golomb code of a small number, as text of bits."""
    return F.element_at(F.array(*(F.lit(bin(k + 1)[2:].rjust(2 * (k + 1).bit_length() - 1, "0")) for k in range(16))), value.cast("int") + 1)


def coded(nal: DataFrame) -> DataFrame:
    """camera, seq, nal: records as slices, and of type 7 as picture parameter sets, whose fields are made of the columns."""
    seq, length = F.col("seq"), F.col("length")
    bit = lambda c: F.when(c, "1").otherwise("0")
    # id, sequence set 0, the entropy coding flag, no field order, one slice group, one reference each, no weights, QP 26 and the end
    pps = F.concat(_ue(seq % 3), F.lit("1"), bit(length % 3 == 0), F.lit("0"), F.lit("111"), F.lit("000"), F.lit("11"))
    head = F.concat(_ue(seq % 4), _ue(length % 10), _ue(length % 3), F.lpad(F.conv((seq % 16).cast("string"), 10, 2), 4, "0"), F.when(F.col("nal_type") == 1, _ue(seq % 7)).otherwise(""), F.lit("1"))
    bits = F.rpad(F.when(F.col("nal_type") == 7, pps).otherwise(head), 40, "0")
    first = F.when(F.col("nal_type") == 7, 0x68).when(F.col("nal_type") == 5, 0x65).otherwise(0x61)
    return nal.select("camera", "seq", F.unhex(F.concat(F.hex(first), F.lpad(F.conv(bits, 2, 16), 10, "0"))).alias("nal"))


@query(f"""with {cte('nal')}, sets as (select camera, seq % 3 as id, seq, length % 3 = 0 as cabac from nal where nal_type = 7), s as (select camera, seq, nal_type, length, length % 3 as pps_id from nal where nal_type <> 7),
a as (select s.*, coalesce(p.cabac, false) as cabac from s asof left join sets p on p.camera = s.camera and p.id = s.pps_id and p.seq <= s.seq)
select camera, seq, nal_type = 5 as idr, length % 10 as slice_type, pps_id, seq % 16 as frame_num, cabac, case when nal_type = 1 and not cabac then seq % 7 end as skip_run from a""")
def slice_fields(spark, d):
    """Headers of all slices, read from their bytes under the parameter set that was active."""
    return slice_headers(coded(view(spark, d, "nal")))


@query(f"""with {cte('nal')} select camera, seq, case when nal_type = 5 then 1 when nal_type = 7 then 2 when length % 10 % 5 = 1 then 8 else 0 end as flags from nal""")
def coded_flags(spark, d):
    """Key frames, parameter sets and B frames, told from the bytes alone."""
    rows = with_parsed(coded(view(spark, d, "nal")), "nal", "kind", slice_type, "int", pa.int32())
    h264 = F.lit("h264")
    return rows.select("camera", "seq", nal_flags(nal_type(byte_at(F.col("nal"), 0), h264), h264, F.col("kind")).alias("flags"))
