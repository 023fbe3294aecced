"""Column functions of the domain: masks, reasons, ids, names, paths, sizes, bands, validation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CLASSES = (("person", 0), ("vehicle", 1), ("animal", 2), ("other", 7))
BASE32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def mask_classes(mask: Column) -> Column:
    """The class names of a bit mask, in fixed order."""
    return F.array_compact(F.array(*(F.when(mask.bitwiseAND(F.lit(1 << bit).cast("smallint")) > 0, name) for name, bit in CLASSES)))


def classes_mask(classes: Column) -> Column:
    """The mask of class names; unknown ones are ignored."""
    return sum((F.when(F.array_contains(classes, name), 1 << bit).otherwise(0) for name, bit in CLASSES), F.lit(0)).cast("smallint")


def z_of_reason(reason: Column) -> Column:
    """The number after z= at the start, else 0."""
    return F.coalesce(F.regexp_extract(reason, r"^z=([-+]?[0-9]*\.?[0-9]+)", 1).try_cast("double"), F.lit(0.0))


def reason_map(reason: Column) -> Column:
    """k=v and flags of a reason; flags map to null."""
    return F.str_to_map(reason, F.lit(","), F.lit("="))


def event_type(code: Column) -> Column:
    return F.when(code == 1, "motion").when(code == 2, "scene_change").when(code == 3, "idr_burst").otherwise("none")


def codec(code: Column, strict: bool = False) -> Column:
    """2 is h265; all else h264, or if strict 1 is h264 and all else unknown."""
    return F.when(code == 2, "h265").when(code == 1, "h264").otherwise("unknown") if strict else F.when(code == 2, "h265").otherwise("h264")


def subject(kind: str, site: Column, camera: Column) -> Column:
    return F.concat_ws(".", F.lit("events"), F.lit(kind), site, camera)


def ulid_millis(id_: Column) -> Column:
    """Epoch milliseconds in the first ten base-32 letters; null if one is not a letter of it."""
    letters = F.split(F.substring(F.upper(id_), 1, 10), "")
    place = lambda c: F.call_function("instr", F.lit(BASE32), c)
    good = F.forall(letters, lambda c: (c != "") & (place(c) > 0)) & (F.size(letters) == 10)
    return F.when(good, F.aggregate(letters, F.lit(0).cast("long"), lambda n, c: n * 32 + (place(c) - 1)))


def ulid_time_letters(millis: Column) -> Column:
    """The ten base-32 letters of epoch milliseconds."""
    return F.concat(*(F.substring(F.lit(BASE32), (F.shiftright(millis, 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for k in reversed(range(10))))


def clip_filename(camera: Column, ts: Column, event_id: Column, ext: Column) -> Column:
    return F.concat(camera, F.lit("_"), F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit("_"), F.substring(event_id, 1, 8), F.lit("."), ext)


def clip_filename_time(filename: Column) -> Column:
    return F.try_to_timestamp(F.regexp_extract(filename, r"_(\d{8}_\d{6})_", 1), F.lit("yyyyMMdd_HHmmss"))


def clip_url(camera: Column, filename: Column) -> Column:
    """Transport streams are served as playlists."""
    return F.concat(F.lit("/api/clips/"), camera, F.lit("/"), F.regexp_replace(filename, r"\.(ts|mpegts)$", ".m3u8"))


def mime_type(filename: Column) -> Column:
    ext = F.regexp_extract(filename, r"\.([^./]*)$", 1)
    return F.when(ext.isin("ts", "mpegts"), "video/mp2t").when(ext.isin("mp4", "fmp4"), "video/mp4").when(ext == "mkv", "video/x-matroska").when(ext == "m3u8", "application/vnd.apple.mpegurl").otherwise("application/octet-stream")


def unsafe_path(path: Column) -> Column:
    return F.contains(path, F.lit(".."))


def percent(used: Column, total: Column) -> Column:
    """To one decimal; 0 of nothing."""
    return F.when(total > 0, F.round(used / total * 1000) / 10).otherwise(0.0)


def duration_estimate(size: Column) -> Column:
    """Seconds of a clip of so many bytes at 3 Mbit/s; under one: 8."""
    s = size * 8 / (3 * 1024 * 1024)
    return F.when(s < 1, 8.0).otherwise(s)


def playlist(filename: Column, size: Column) -> Column:
    """A playlist of one segment. Its duration has three decimals; ties (sixteenths of a second) go to the even one."""
    s = duration_estimate(size)
    thousandths = F.bround(s.cast("decimal(38,18)"), 3).cast("decimal(38,3)").cast("string")
    lines = F.format_string("#EXTM3U\n#EXT-X-VERSION:3\n#EXT-X-TARGETDURATION:%d\n#EXT-X-MEDIA-SEQUENCE:0\n#EXTINF:%s,\n", F.floor(s) + 1, thousandths)
    return F.concat(lines, filename, F.lit("\n#EXT-X-ENDLIST\n"))


def size_text(size: Column) -> Column:
    """B, KB, MB or GB to two decimals, without zeros at the end."""
    k = F.when(size <= 0, 0).otherwise(F.least(F.lit(3), F.floor(F.log(1024.0, size.cast("double") + 1e-9))))
    scaled = F.round(size / F.pow(F.lit(1024.0), k), 2)
    short = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", scaled), "0+$", ""), r"\.$", "")
    return F.when(size <= 0, "0 B").otherwise(F.concat(short, F.lit(" "), F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), (k + 1).cast("int"))))


def age_text(seconds: Column) -> Column:
    return F.when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m ago"))).when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h ago"))).otherwise(
        F.concat(F.floor(seconds / 86400).cast("string"), F.lit("d ago"))
    )


def z_band(z: Column) -> Column:
    return F.when(z < 3.5, "ok").when(z < 6, "warn").otherwise("crit")


def percent_band(p: Column) -> Column:
    return F.when(p < 70, "ok").when(p < 85, "warn").otherwise("crit")


def segment_z(z: Column, before: Column) -> Column:
    return (z + before) / 2


def object_key(prefix: str, site: Column, camera: Column, ts: Column) -> Column:
    return F.concat(F.lit(prefix), site, F.lit("/"), camera, F.lit("/"), F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'"), F.lit(".ts"))


def bitrate(width: Column, height: Column, fps: Column) -> Column:
    return F.floor(width * height * F.coalesce(fps, F.lit(15)) * 0.07)


def off_threshold(fps: Column) -> Column:
    return F.greatest(F.lit(10), F.floor(F.coalesce(fps, F.lit(15)) * 1.5))


def ring_bytes(seconds: Column, bits_per_second: Column) -> Column:
    """Room for so many seconds and a quarter more, as the next power of two."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), seconds * bits_per_second / 8 * 5 / 4)))).cast("long")


def parse_duration(text: str) -> float:
    """Seconds of 7d, 1.5d, 24h, 90m, 30s, 250ms and sums such as 1h30m."""
    text = text.strip()
    if m := re.fullmatch(r"([0-9]*\.?[0-9]+)d", text):
        return float(m[1]) * 86400
    units = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "µs": 1e-6, "ns": 1e-9}
    parts = re.findall(r"([0-9]*\.?[0-9]+)(ms|us|µs|ns|h|m|s)", text)
    if text == "0":
        return 0.0
    if not parts or "".join(a + b for a, b in parts) != text.lstrip("+-"):
        raise ValueError(f"not a duration: {text!r}")
    return (-1 if text.startswith("-") else 1) * sum(float(a) * units[b] for a, b in parts)


RULES = (
    ("motion_z_high", lambda c: c.between(0, 100), "motion_z_high must be 0 to 100"),
    ("intra_ratio_high", lambda c: c.between(0, 100), "intra_ratio_high must be 0 to 100"),
    ("on_threshold", lambda c: c.between(1, 255), "on_threshold must be 1 to 255"),
    ("off_threshold", lambda c: c.between(1, 255), "off_threshold must be 1 to 255"),
)


def violations(columns: list[str]) -> Column:
    """Messages of the rules that a configuration's columns break; unset ones break none."""
    return F.array_compact(F.array(*(F.when(~rule(F.col(name)), text) for name, rule, text in RULES if name in columns)))


def merged(patch: Column, current: Column) -> Column:
    return F.coalesce(patch, current)


def frames_median(values: Column) -> Column:
    return F.element_at(F.array_sort(values), F.greatest(F.lit(1), F.ceil(F.size(values) / 2)).cast("int"))
