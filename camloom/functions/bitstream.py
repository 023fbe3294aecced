"""Bitstream functions: packets, NAL units, parameter sets. Column expressions where bits suffice, else Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from camloom.operators.running import SPAN, ranged
from camloom.sources.shared import scratch

KEYFRAME, PARAMSET, BFRAME = 1, 2, 8


def byte_at(data: Column, k: int) -> Column:
    """The k-th byte (from 0) as a whole number; null beyond the end."""
    return F.when(F.octet_length(data) > k, F.conv(F.hex(F.substring(data, k + 1, 1)), 16, 10).cast("int"))


def number_at(data: Column, k: int, n: int) -> Column:
    return F.when(F.octet_length(data) >= k + n, F.conv(F.hex(F.substring(data, k + 1, n)), 16, 10).cast("long"))


def rtp_header(packet: Column) -> Column:
    """A struct of a version-2 packet's header, payload_start and padding; null for anything else."""
    b0, b1 = byte_at(packet, 0), byte_at(packet, 1)
    bit = lambda b, shift, n: F.shiftright(b, shift).bitwiseAND(F.lit((1 << n) - 1))
    start = 12 + 4 * bit(b0, 0, 4)
    ext = bit(b0, 4, 1) == 1
    words = F.conv(F.hex(packet.substr(start + 3, F.lit(2))), 16, 10).cast("int")
    after = F.when(ext, start + 4 + 4 * words).otherwise(start)
    pad = F.when(bit(b0, 5, 1) == 1, F.conv(F.hex(packet.substr(F.octet_length(packet), F.lit(1))), 16, 10).cast("int")).otherwise(0)
    header = F.struct(
        (bit(b1, 7, 1) == 1).alias("marker"), bit(b1, 0, 7).alias("payload_type"), number_at(packet, 2, 2).cast("int").alias("seq"), number_at(packet, 4, 4).alias("timestamp"),
        number_at(packet, 8, 4).alias("ssrc"), after.alias("payload_start"), pad.alias("padding"),
    )
    return F.when((F.octet_length(packet) >= 12) & (bit(b0, 6, 2) == 2) & (after + pad <= F.octet_length(packet)), header)


def rtp_payload(packet: Column) -> Column:
    h = rtp_header(packet)
    return packet.substr(h["payload_start"] + 1, F.octet_length(packet) - h["payload_start"] - h["padding"])


def seq_after(a: Column, b: Column) -> Column:
    """a is later than b among 16-bit numbers that wrap."""
    return (a - b + 98304) % 65536 - 32768 > 0


def unwrapped(packets: DataFrame, by: str = "camera", order: str = "arrival", span: int = SPAN) -> DataFrame:
    """with seq_long: 16-bit numbers made to go on past each wrap, by the signed step from packet to packet in a whole-numbered order.

    Steps run inside ranges of the order, and the rows are written with them, so packets are made and moved once; then ranges go on from each other.
    What ranges begin with is written as well, so that Spark sees how small it is and does not move the rows for it. ``dropped`` deletes the rows.
    """
    inside, over = Window.partitionBy(by, "q_range").orderBy(order), Window.partitionBy(by).orderBy("q_range")
    step = lambda a, b: ((a - b + 98304) % 65536 - 32768).cast("long")
    before = ranged(packets, order, span).withColumn("q_last", F.lag("seq").over(inside))
    rows = scratch(before.withColumn("q_steps", F.sum(F.coalesce(step(F.col("seq"), F.col("q_last")), F.lit(0))).over(inside)).drop("q_last"), "unwrapped")
    ends = rows.groupBy(by, "q_range").agg(F.min_by("seq", order).alias("q_first"), F.max_by("seq", order).alias("q_last"), F.max_by("q_steps", order).alias("q_all"))
    opens = F.row_number().over(over) == 1
    entry = F.when(opens, F.col("q_first").cast("long")).otherwise(step(F.col("q_first"), F.lag("q_last").over(over)) + F.lag("q_all").over(over))
    begun = scratch(ends.select(by, "q_range", F.coalesce(entry, F.lit(0)).alias("q_entry")).select(by, "q_range", F.sum("q_entry").over(over).alias("q_begin")), "begun")
    out = rows.join(begun, [by, "q_range"]).select(*packets.columns, (F.col("q_begin") + F.col("q_steps")).alias("seq_long"))
    out.camloom_path = rows.camloom_path
    return out


def reordered(packets: DataFrame, by: str = "camera", order: str = "arrival", span: int = SPAN) -> DataFrame:
    """Packets in sequence, each once (as it came first), with lost: how many are missing just before it."""
    placed = ranged(unwrapped(packets, by, order, span), "seq_long", span)
    inside, over = Window.partitionBy(by, "q_range").orderBy("seq_long", order), Window.partitionBy(by).orderBy("q_range")
    before = placed.groupBy(by, "q_range").agg(F.max("seq_long").alias("q_end")).select(by, "q_range", F.lag("q_end").over(over).alias("q_before"))
    rows = placed.withColumn("q_last", F.lag("seq_long").over(inside)).join(before, [by, "q_range"]).withColumn("q_last", F.coalesce("q_last", "q_before"))
    lost = F.coalesce(F.col("seq_long") - F.col("q_last") - 1, F.lit(0)).cast("long")
    return rows.withColumn("lost", lost).where("lost >= 0").select(*packets.columns, "seq_long", "lost")


def delivered(packets: DataFrame, window: int = 32, by: str = "camera", order: str = "arrival") -> DataFrame:
    """(by, order, seq) as a live receiver passes packets on: by, order, seq, place, lost.

    A packet that is next goes out, with those waiting behind it; one fewer than ``window`` ahead waits; one older than the next is
    discarded; one farther ahead sends out all that wait, then itself, and ``lost`` counts the numbers up to it. What waits at the
    end of a stream is not passed on. A stream is one task, with a window's packets in memory.
    """
    placed = packets.select(by, order, "seq").repartition(by).sortWithinPartitions(by, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, due, place, waiting = None, None, 0, {}
        for b in batches:
            out = []
            for key, at, seq in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if due is None or key != stream:
                    stream, due, place, waiting = key, seq, 0, {}
                ahead, lost, ready = (seq - due + 32768) % 65536 - 32768, 0, []
                if ahead < 0:
                    continue
                if 0 < ahead < window:
                    waiting[seq] = at
                    continue
                if ahead:
                    ready = sorted(waiting.items(), key=lambda x, due=due: (x[0] - due) % 65536)
                    waiting, lost = {}, ahead - 1
                ready.append((seq, at))
                due = (seq + 1) % 65536
                while due in waiting:
                    ready.append((due, waiting.pop(due)))
                    due = (due + 1) % 65536
                for s, a in ready:
                    place += 1
                    out.append((key, a, s, place, lost if s == seq else 0))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[by, order, "seq", "place", "lost"])

    schema = StructType([*placed.schema.fields, StructField("place", LongType()), StructField("lost", LongType())])
    kinds = [to_arrow_type(f.dataType) for f in schema]
    return placed.mapInArrow(run, schema)


def nal_type(first_byte: Column, codec: Column) -> Column:
    return F.when(codec == "h265", F.shiftright(first_byte, 1).bitwiseAND(F.lit(0x3F))).otherwise(first_byte.bitwiseAND(F.lit(0x1F)))


def nal_flags(kind: Column, codec: Column, slice_type: Column | None = None) -> Column:
    """Key frame, parameter set, or with the slice's type B frame (of H.264 slices 1 and 6 in NAL type 1, of H.265 0 in types 0 to 9)."""
    key = F.when(codec == "h265", kind.between(19, 21)).otherwise(kind == 5)
    param = F.when(codec == "h265", kind.between(32, 34)).otherwise(kind.isin(7, 8))
    flags = F.when(key, KEYFRAME).when(param, PARAMSET)
    if slice_type is None:
        return flags.otherwise(0)
    b = F.when(codec == "h265", kind.between(0, 9) & (slice_type == 0)).otherwise((kind == 1) & (slice_type % 5 == 1))
    return flags.when(b, BFRAME).otherwise(0)


def sdp_parameter_sets(text: Column) -> Column:
    """Two parameter sets, base64, split at the first comma."""
    return F.transform(F.split(text, ",", 2), lambda x: F.unbase64(x))


# ---------------------------------------------------------------- bytes in Python


def unescaped(nal: bytes) -> bytes:
    """Without emulation prevention: the 3 of 0 0 3 x goes where x is at most 3 (or the end)."""
    out, zeros = bytearray(), 0
    for i, b in enumerate(nal):
        if zeros >= 2 and b == 3 and (i + 1 >= len(nal) or nal[i + 1] <= 3):
            zeros = 0
            continue
        out.append(b)
        zeros = zeros + 1 if b == 0 else 0
    return bytes(out)


class Bits:
    """Reads bits from the most significant on; beyond the end it raises EOFError."""

    def __init__(self, data: bytes) -> None:
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def u(self, n: int) -> int:
        if n > self.left:
            raise EOFError
        self.left -= n
        return (self.value >> self.left) & ((1 << n) - 1)

    def ue(self) -> int:
        zeros = 0
        while self.u(1) == 0:
            zeros += 1
            if zeros > 32:
                raise EOFError
        return (1 << zeros) - 1 + self.u(zeros)

    def se(self) -> int:
        k = self.ue()
        return (k + 1) // 2 if k % 2 else -(k // 2)


HIGH_PROFILES = {100, 110, 122, 244, 44, 83, 86, 118, 128, 138, 139, 134, 135}


def h264_sps(nal: bytes) -> dict | None:
    """profile, level, width and height (cropped), and fps where timing is given; null if it is not a whole SPS."""
    try:
        if not nal or nal[0] & 0x1F != 7:
            return None
        r = Bits(unescaped(nal[1:]))
        profile, _, level, _ = r.u(8), r.u(8), r.u(8), r.ue()
        chroma = 1
        if profile in HIGH_PROFILES:
            chroma = r.ue()
            if chroma == 3:
                r.u(1)
            r.ue(), r.ue(), r.u(1)
            if r.u(1):
                for k in range(8 if chroma != 3 else 12):
                    if r.u(1):
                        last = now = 8
                        for _ in range(16 if k < 6 else 64):
                            if now:
                                now = (last + r.se()) % 256
                            last = now or last
        r.ue()
        order = r.ue()
        if order == 0:
            r.ue()
        elif order == 1:
            r.u(1), r.se(), r.se()
            for _ in range(r.ue()):
                r.se()
        r.ue(), r.u(1)
        width, height = 16 * (r.ue() + 1), r.ue() + 1
        frames_only = r.u(1)
        if not frames_only:
            r.u(1)
        height *= 16 * (2 - frames_only)
        r.u(1)
        if r.u(1):
            left, right, top, bottom = r.ue(), r.ue(), r.ue(), r.ue()
            across, down = (1, 1) if chroma == 0 else (2 if chroma in (1, 2) else 1, 2 if chroma == 1 else 1)
            width -= across * (left + right)
            height -= down * (2 - frames_only) * (top + bottom)
        fps = None
        if r.u(1):
            if r.u(1) and r.u(8) == 255:
                r.u(32)
            if r.u(1):
                r.u(1)
            if r.u(1):
                r.u(4)
                if r.u(1):
                    r.u(24)
            if r.u(1):
                r.ue(), r.ue()
            if r.u(1):
                units, scale = r.u(32), r.u(32)
                fps = scale / (2 * units) if units else None
        return {"profile": profile, "level": level, "width": width, "height": height, "fps": fps}
    except EOFError:
        return None


def slice_type(nal: bytes) -> int | None:
    """0 P, 1 B, 2 I, 3 SP, 4 SI of an H.264 slice; null for others."""
    try:
        if not nal or nal[0] & 0x1F not in (1, 5):
            return None
        r = Bits(unescaped(nal[1:17]))
        r.ue()
        return r.ue() % 5
    except EOFError:
        return None


def crc32_mpeg(data: bytes) -> int:
    """CRC-32 as in transport streams: polynomial 0x04C11DB7, no reflection, start all ones, no final inversion."""
    crc = 0xFFFFFFFF
    for b in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ _crc_table()[(crc >> 24) ^ b]
    return crc


_TABLE: list[int] = []


def _crc_table() -> list[int]:
    if not _TABLE:
        for k in range(256):
            c = k << 24
            for _ in range(8):
                c = ((c << 1) ^ 0x04C11DB7 if c >> 31 else c << 1) & 0xFFFFFFFF
            _TABLE.append(c)
    return _TABLE


def annex_b(data: bytes) -> list[bytes]:
    """NAL units between start codes of three or four bytes."""
    out, at = [], data.find(b"\0\0\1")
    while at >= 0:
        nxt = data.find(b"\0\0\1", at + 3)
        unit = data[at + 3 : nxt if nxt >= 0 else len(data)].rstrip(b"\0") if nxt >= 0 else data[at + 3 :]
        if unit:
            out.append(unit)
        at = nxt
    return out


SPS_DDL = "profile int, level int, width int, height int, fps double"


def with_parsed(df: DataFrame, column: str, name: str, function, ddl: str, kind: pa.DataType) -> DataFrame:  # noqa: ANN001
    """df and ``name``: function of each value's bytes, by Arrow batches; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [function(x.as_py()) if x.is_valid else None for x in b.column(b.schema.get_field_index(column))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, kind)], names=[*b.schema.names, name])

    from pyspark.sql.types import StructType

    schema = StructType(df.schema.fields + StructType.fromDDL(f"{name} {ddl}").fields)
    return df.mapInArrow(run, schema)


def with_sps(df: DataFrame, column: str = "payload") -> DataFrame:
    kind = pa.struct([("profile", pa.int32()), ("level", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("fps", pa.float64())])
    return with_parsed(df, column, "sps", h264_sps, f"struct<{SPS_DDL.replace(' int', ': int').replace(' double', ': double')}>", kind)


def with_crc(df: DataFrame, column: str = "payload") -> DataFrame:
    return with_parsed(df, column, "crc", crc32_mpeg, "long", pa.int64())


def rtcp_sender_report(packet: Column) -> Column:
    """ssrc, NTP seconds and fraction, RTP time, packets and bytes of a sender report; null for other packets."""
    fields = [("ssrc", 4), ("ntp_seconds", 8), ("ntp_fraction", 12), ("rtp_time", 16), ("n_packets", 20), ("n_bytes", 24)]
    report = F.struct(*(number_at(packet, at, 4).alias(name) for name, at in fields))
    return F.when((F.octet_length(packet) >= 28) & (F.shiftright(byte_at(packet, 0), 6) == 2) & (byte_at(packet, 1) == 200), report)


def h264_pps(nal: bytes) -> dict | None:
    """id, sps_id, whether entropy coding is arithmetic, and the first QP of an H.264 picture parameter set."""
    try:
        if not nal or nal[0] & 0x1F != 8:
            return None
        r = Bits(unescaped(nal[1:]))
        pps, sps, cabac = r.ue(), r.ue(), r.u(1)
        r.u(1)
        if r.ue():
            return {"id": pps, "sps_id": sps, "cabac": bool(cabac), "init_qp": None}  # slice groups: what follows depends on their kind
        r.ue(), r.ue(), r.u(3)
        return {"id": pps, "sps_id": sps, "cabac": bool(cabac), "init_qp": 26 + r.se()}
    except EOFError:
        return None


def h265_sps(nal: bytes) -> dict | None:
    """id, width and height (cropped) of an H.265 sequence parameter set."""
    try:
        if len(nal) < 3 or (nal[0] >> 1) & 0x3F != 33:
            return None
        r = Bits(unescaped(nal[2:]))
        r.u(4)
        layers = r.u(3)
        r.u(1)
        r.u(88), r.u(8)  # general profile, tier, level
        present = [(r.u(1), r.u(1)) for _ in range(layers)]
        if layers:
            r.u(2 * (8 - layers))
        for profile, level in present:
            r.u(88 * profile + 8 * level)
        sps, chroma = r.ue(), r.ue()
        if chroma == 3:
            r.u(1)
        width, height = r.ue(), r.ue()
        if r.u(1):
            left, right, top, bottom = r.ue(), r.ue(), r.ue(), r.ue()
            width -= (2 if chroma in (1, 2) else 1) * (left + right)
            height -= (2 if chroma == 1 else 1) * (top + bottom)
        return {"id": sps, "width": width, "height": height}
    except EOFError:
        return None


def latest_parameter_sets(sets: DataFrame, id_column: str = "id") -> DataFrame:
    """Of each camera and id the parameter set with the greatest seq: what a decoder holds."""
    return sets.groupBy("camera", id_column).agg(F.max_by(F.struct(*(c for c in sets.columns if c not in ("camera", id_column))), "seq").alias("s")).select("camera", id_column, "s.*")
