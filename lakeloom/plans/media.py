"""Queries of media files, byte ranges and patched files. The files are written from the tables' columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import ranges
from .base import query, table
from .streams import shared


def be(n: Column, size: int) -> Column:
    """A number as ``size`` bytes in hex, the highest first."""
    return F.lpad(F.hex(n.cast("long")), 2 * size, "0")


def le(n: Column, size: int) -> Column:
    """A number as ``size`` bytes in hex, the lowest first."""
    whole = be(n, size)
    return F.concat(*(F.substring(whole, 2 * k + 1, 2) for k in reversed(range(size))))


def ascii_hex(text: str) -> Column:
    return F.lit(text.encode().hex())


def box(name: str, content: Column) -> Column:
    return F.concat(be(F.length(content) / 2 + 8, 4), ascii_hex(name), content)


def media_files(spark, d: str) -> DataFrame:
    """``path, content``: documents as a PNG, JPEG, WAV, MP4 or text file by their id; sizes and durations follow from id and text."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    body, i = F.hex(F.encode("text", "UTF-8")), F.col("doc_id")
    n = F.octet_length("text")
    wide, high = i % 1900 + 16, i % 1000 + 9
    zero = lambda k: F.lit("00" * k)
    png = F.concat(F.lit("89504e470d0a1a0a0000000d49484452"), be(wide, 4), be(high, 4), F.lit("0802000000"), zero(4), be(n, 4), ascii_hex("tEXt"), body, zero(4), F.lit("0000000049454e4400000000"))
    said = F.substring(body, 1, 2 * 60000)
    jpeg = F.concat(F.lit("ffd8ffe000104a46494600010100000100010000fffe"), be(F.length(said) / 2 + 2, 2), said, F.lit("ffc0001108"), be(high, 2), be(wide, 2), F.lit("03"), zero(9), F.lit("ffd9"))
    rate, channels = F.lit(8000) + (i % 3) * 4000, i % 2 + 1
    wav = F.concat(ascii_hex("RIFF"), le(n + 36, 4), ascii_hex("WAVEfmt "), F.lit("100000000100"), le(channels, 2), le(rate, 4), le(rate * channels, 4), le(channels, 2), F.lit("0800"), ascii_hex("data"), le(n, 4), body)
    mvhd = box("mvhd", F.concat(zero(12), be(F.lit(1000), 4), be(n, 4), zero(80)))
    tkhd = box("tkhd", F.concat(zero(76), be(wide * 65536, 4), be(high * 65536, 4)))
    track = box("trak", F.concat(tkhd, box("mdia", box("hdlr", F.concat(zero(8), ascii_hex("vide"), zero(13))))))
    mp4 = F.concat(box("ftyp", F.concat(ascii_hex("isom"), zero(4))), box("mdat", body), box("moov", F.concat(mvhd, track)))
    kind = i % 5
    content = F.when(kind == 0, png).when(kind == 1, jpeg).when(kind == 2, wav).when(kind == 3, mp4).otherwise(F.concat(ascii_hex("text: "), body))
    return docs.select(F.concat(kind.cast("string"), F.lit("/"), i.cast("string"), F.lit(".bin")).alias("path"), F.unhex(content).alias("content"))


def written(spark, files: DataFrame) -> str:
    """The folder that the files were written to."""
    ranges.register(spark)
    to = shared(spark)
    files.write.format("lakeloom_files").mode("append").option("path", to).save()
    return to


BODY = "SELECT doc_id AS i, strlen(coalesce(text, '')) AS n FROM documents"


@query("s30_media_headers", f"""SELECT i AS doc_id, CASE i % 5 WHEN 2 THEN 'audio' WHEN 3 THEN 'video' WHEN 4 THEN 'text' ELSE 'image' END AS kind, CASE i % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'audio/x-wav' WHEN 3 THEN 'video/mp4' ELSE 'text/plain' END AS mime,
CAST(CASE i % 5 WHEN 0 THEN n + 57 WHEN 1 THEN least(n, 60000) + 45 WHEN 2 THEN n + 44 WHEN 3 THEN n + 281 ELSE n + 6 END AS BIGINT) AS size,
CAST(CASE WHEN i % 5 IN (0, 1, 3) THEN i % 1900 + 16 END AS INTEGER) AS width, CAST(CASE WHEN i % 5 IN (0, 1, 3) THEN i % 1000 + 9 END AS INTEGER) AS height,
CASE i % 5 WHEN 2 THEN round(n / ((8000 + (i % 3) * 4000) * (i % 2 + 1)), 6) WHEN 3 THEN round(n / 1000, 6) END AS seconds, CAST(NULL AS VARCHAR) AS error FROM ({BODY})""")
def s30_media_headers(spark, d):
    """Kind, size, frame and duration of media files from their headers alone."""
    found = spark.read.format("lakeloom_media").option("path", written(spark, media_files(spark, d))).load()
    doc_id = F.regexp_extract("path", r"([0-9]+)\.bin$", 1).cast("long").alias("doc_id")
    return found.select(doc_id, "kind", "mime", "size", "width", "height", F.round("seconds", 6).alias("seconds"), "error")


@query("s30_byte_ranges", "SELECT doc_id, CAST(n AS BIGINT) AS bytes, CAST(greatest(1, ceil(n / 1000)) AS BIGINT) AS ranges, md5(text) AS digest FROM (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS n FROM documents)")
def s30_byte_ranges(spark, d):
    """Files read in ranges of a thousand bytes and put together again."""
    docs = table(spark, d, "documents")
    to = written(spark, docs.select(F.concat("doc_id", F.lit(".txt")).alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content")))
    parts = spark.read.format("lakeloom_ranges").option("path", to).option("block", "1000").load()
    name = F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("long").alias("doc_id")
    whole = parts.groupBy(name).agg(F.sum(F.octet_length("content")).alias("bytes"), F.count("*").alias("ranges"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offset", F.hex("content").alias("h")))), lambda p: p["h"]), "").alias("h"))
    return whole.select("doc_id", "bytes", "ranges", F.md5(F.unhex("h")).alias("digest"))
