"""What a media probe prints as JSON, as columns: duration and streams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEMA = """streams array<struct<index int, codec_name string, codec_long_name string, codec_type string, pix_fmt string, width int, height int,
sample_rate string, channel_layout string, channels int, bit_rate string, r_frame_rate string, color_transfer string,
disposition struct<attached_pic int>, tags struct<language string>, side_data_list array<struct<side_data_type string>>>>,
format struct<duration string, bit_rate string>"""


def duration(text: Column) -> Column:
    """Whole seconds from a number of seconds or from [days.]hours:minutes[:seconds]; null if neither."""
    part = lambda n: F.coalesce(F.try_to_number(F.regexp_extract(text, r"^(?:(\d+)\.)?(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.\d+)?)?$", n), F.lit("999999999")).cast("double"), F.lit(0.0))
    clock = F.when(text.rlike(r"^(\d+\.)?\d{1,2}:\d{1,2}(:\d{1,2}(\.\d+)?)?$"), ((part(1) * 24 + part(2)) * 60 + part(3)) * 60 + part(4))
    seconds = text.try_cast("double")
    return F.coalesce(F.when(seconds >= 0, F.floor(seconds).cast("double")), clock)


def hdr_format(transfer: Column, side_data: Column) -> Column:
    """Name of the high dynamic range format from the transfer curve and the types of side data."""
    has = lambda word: F.coalesce(F.exists(side_data, lambda s: F.contains(F.upper(s["side_data_type"]), F.lit(word))), F.lit(False))
    curve = F.lower(transfer)
    pq = F.when(has("DOVI"), "Dolby Vision").when(has("SMPTE2094"), "HDR10+").otherwise("HDR10")
    return F.when(curve == "arib-std-b67", "HLG").when(curve == "smpte2084", pq).otherwise("")


def _rate(text: Column) -> Column:
    parts = F.split(text, "/")
    a, b = F.try_element_at(parts, F.lit(1)).try_cast("int"), F.try_element_at(parts, F.lit(2)).try_cast("int")
    return F.when((F.size(parts) != 2) | a.isNull() | b.isNull(), 0.0).otherwise(F.when((a > 0) & (b > 0), a / b).otherwise(-1.0)).cast("float")


def media_info(text: Column) -> Column:
    """A struct of duration_s and streams; null for text that is not JSON. Numbers that are missing are 0, a missing language is empty.

    If no stream has a bit rate the first one gets that of the whole file.
    """
    info = F.from_json(text, _SCHEMA)
    none_has = ~F.exists(info["streams"], lambda s: s["bit_rate"].try_cast("long").isNotNull())
    whole = info["format"]["bit_rate"].try_cast("long")

    def stream(s: Column, i: Column) -> Column:
        language = F.lower(F.trim(s["tags"]["language"]))
        return F.struct(
            *[s[n] for n in ("index", "codec_name", "codec_long_name", "codec_type", "channel_layout")],
            s["pix_fmt"].alias("pixel_format"),
            *[F.coalesce(s[n], F.lit(0)).alias(n) for n in ("width", "height", "channels")],
            F.coalesce(s["sample_rate"].try_cast("int"), F.lit(0)).alias("sample_rate"),
            F.coalesce(s["bit_rate"].try_cast("long"), F.when(none_has & (i == 0), whole), F.lit(0).cast("long")).alias("bit_rate"),
            F.coalesce(_rate(s["r_frame_rate"]), F.lit(0.0).cast("float")).alias("frame_rate"),
            hdr_format(s["color_transfer"], s["side_data_list"]).alias("hdr_format"),
            F.coalesce(s["disposition"]["attached_pic"] != 0, F.lit(False)).alias("is_attached_picture"),
            F.coalesce(F.when(language != "und", language), F.lit("")).alias("language"),
        )

    return F.struct(duration(info["format"]["duration"]).alias("duration_s"), F.transform(info["streams"], stream).alias("streams"))
