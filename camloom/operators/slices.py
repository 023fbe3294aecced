"""Slice headers read under the parameter set that is active: the last one of its id before the slice.

Headers are read where the bytes are. What depends on the parameter set is decided afterwards: slices and parameter sets are merged in one order
for each (camera, id), and the newest set so far runs along it in two levels, as a decoder's cache would hold it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from camloom.functions.bitstream import Bits, h264_pps, unescaped
from camloom.operators.running import SPAN, ranged, running
from camloom.sources.shared import scratch

#: Bytes of a unit that hold its header, however long the slice.
HEADER = 48


def h264_slice(nal: bytes) -> dict | None:
    """idr, slice_type (0 to 9), pps_id, frame_num (its first four bits) and, as it is without arithmetic coding, skip_run. None for units that are no slice."""
    try:
        if not nal or nal[0] & 0x1F not in (1, 5):
            return None
        r = Bits(unescaped(nal[1:HEADER]))
        r.ue()
        head = {"idr": nal[0] & 0x1F == 5, "slice_type": r.ue(), "pps_id": r.ue(), "frame_num": r.u(4), "skip_run": None}
    except EOFError:
        return None
    try:
        head["skip_run"] = None if head["idr"] else r.ue()
    except EOFError:
        pass
    return head


def h265_slice(nal: bytes) -> dict | None:
    """first (of its picture), pps_id and, but for key pictures, poc_lsb (eight bits) of an H.265 slice; None for other units."""
    try:
        kind = (nal[0] >> 1) & 0x3F if len(nal) > 2 else 99
        if not (kind <= 9 or 16 <= kind <= 21):
            return None
        r = Bits(unescaped(nal[2:HEADER]))
        key, first = 19 <= kind <= 21, r.u(1) == 1
        if key:
            r.u(1)
        pps = r.ue()
        if not first:
            r.u(1)
        return {"first": first, "pps_id": pps, "poc_lsb": None if key else r.u(8)}
    except EOFError:
        return None


def h265_vps(nal: bytes) -> dict | None:
    """id, layers and temporal layers of an H.265 video parameter set."""
    try:
        if len(nal) < 5 or (nal[0] >> 1) & 0x3F != 32:
            return None
        r = Bits(unescaped(nal[2:]))
        vps = r.u(4)
        r.u(2)
        return {"id": vps, "layers": r.u(6) + 1, "sub_layers": r.u(3) + 1}
    except EOFError:
        return None


def h265_pps(nal: bytes) -> dict | None:
    """id, sps_id and the first QP of an H.265 picture parameter set."""
    try:
        if len(nal) < 3 or (nal[0] >> 1) & 0x3F != 34:
            return None
        r = Bits(unescaped(nal[2:]))
        pps, sps = r.ue(), r.ue()
        r.u(7), r.ue(), r.ue()
        return {"id": pps, "sps_id": sps, "init_qp": 26 + r.se()}
    except EOFError:
        return None


READ = {"pps": pa.struct([("id", pa.int64()), ("cabac", pa.bool_())]), "slice": pa.struct([("idr", pa.bool_()), ("slice_type", pa.int64()), ("pps_id", pa.int64()), ("frame_num", pa.int64()), ("skip_run", pa.int64())])}
READ_DDL = "pps struct<id: long, cabac: boolean>, slice struct<idr: boolean, slice_type: long, pps_id: long, frame_num: long, skip_run: long>"


def slice_headers(units: DataFrame, span: int = SPAN) -> DataFrame:
    """(camera, seq, nal) of H.264 -> camera, seq, idr, slice_type, pps_id, frame_num, cabac, skip_run of each slice.

    cabac is the active parameter set's, false where none came before. skip_run is null for key slices and where coding is arithmetic. Units that
    are neither slices nor parameter sets, null ones and cut headers give nothing. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nals = [x or b"" for x in b.column(2).to_pylist()]
            sets = [{"id": p["id"], "cabac": p["cabac"]} if (p := h264_pps(n)) else None for n in nals]
            columns = [pa.array(sets, READ["pps"]), pa.array([h264_slice(n) for n in nals], READ["slice"])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["camera", "seq", "pps", "slice"])

    heads = units.select("camera", "seq", F.substring("nal", 1, 256).alias("nal"))
    kinds = dict(heads.dtypes)
    read = heads.mapInArrow(run, f"camera {kinds['camera']}, seq {kinds['seq']}, {READ_DDL}").where("pps is not null or slice is not null")
    keyed = scratch(read, "headers").withColumn("q_key", F.struct("camera", F.coalesce("pps.id", "slice.pps_id").alias("id")))
    found = running(ranged(keyed, "seq", span), {"active": ("max", F.when(F.col("pps").isNotNull(), F.struct("seq", "pps.cabac")))}, "q_key", ["seq"])
    cabac = F.coalesce("active.cabac", F.lit(False))
    rows = found.where("slice is not null")
    return rows.select("camera", "seq", "slice.idr", "slice.slice_type", "slice.pps_id", "slice.frame_num", cabac.alias("cabac"), F.when(~cabac, F.col("slice.skip_run")).alias("skip_run"))
