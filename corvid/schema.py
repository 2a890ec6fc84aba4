"""Schemas of the engine's tables, and fixed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

ORIGIN = T.StructType([T.StructField("importer", T.StringType()), T.StructField("params", T.MapType(T.StringType(), T.StringType()))])

#: One media item a row; ``ord`` keeps the order of the source.
CLIPS = T.StructType(
    [
        T.StructField("clip_id", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("md5", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("clip_bytes", T.BinaryType()),
        T.StructField("clip_string", T.StringType()),
        T.StructField("media_path", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("origin", ORIGIN),
        T.StructField("origin_name", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("word_count", T.IntegerType()),
        T.StructField("character_count", T.IntegerType()),
        T.StructField("frequency", T.IntegerType()),
        T.StructField("ord", T.LongType()),
    ]
)

LABELS = T.StructType(
    [
        T.StructField("md5", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("origin", ORIGIN),
        T.StructField("origin_name", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("category", T.StringType()),
    ]
)

#: The vote log: label is good, bad or unlabel.
HISTORY = T.StructType([T.StructField("seq", T.LongType()), T.StructField("clip_id", T.LongType()), T.StructField("label", T.StringType()), T.StructField("ts", T.TimestampType())])

DETECTORS = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("media_type", T.StringType()),
        T.StructField("w0", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("b0", T.ArrayType(T.DoubleType())),
        T.StructField("w2", T.ArrayType(T.DoubleType())),
        T.StructField("b2", T.DoubleType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

# File extensions by media type, their MIME types, and folder names.
EXTENSIONS = {
    "audio": ["wav", "mp3", "ogg", "flac", "m4a"],
    "image": ["jpg", "jpeg", "png", "gif", "bmp", "webp"],
    "paragraph": ["txt", "md"],
    "video": ["mp4", "avi", "mov", "mkv", "webm"],
}
FOLDERS = {"sounds": "audio", "images": "image", "paragraphs": "paragraph", "videos": "video"}
MIME = {
    "avi": "video/x-msvideo", "bmp": "image/bmp", "flac": "audio/flac", "gif": "image/gif", "jpeg": "image/jpeg", "jpg": "image/jpeg", "m4a": "audio/mp4",
    "md": "text/plain", "mkv": "video/x-matroska", "mov": "video/quicktime", "mp3": "audio/mpeg", "mp4": "video/mp4", "ogg": "audio/ogg", "png": "image/png",
    "txt": "text/plain", "wav": "audio/wav", "webm": "video/webm", "webp": "image/webp",
}
GOOD, BAD, UNLABEL = "good", "bad", "unlabel"
