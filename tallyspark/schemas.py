"""Row types of the ledger, its enumerations and the strength dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

STATUSES = ["done", "skipped", "failed"]
MODES = ["replace", "export"]
STRENGTHS = ["pristine", "identical", "compact"]

# Skip reasons and their labels in the CSV log.
SKIP_LABELS = {
    "alreadyOptimized": "already optimized",
    "noGain": "no meaningful gain",
    "unsupported": "not a supported photo",
    "cmyk": "CMYK JPEG",
    "exoticJpeg": "unsupported JPEG variant",
    "tooLarge": "too large",
    "hdrGainMap": "HDR gain map",
    "embeddedMedia": "embedded video or media",
    "hdrPhoto": "HDR photo (PQ/HLG) a JPEG cannot hold",
    "spatialPhoto": "spatial (stereo) photo",
    "conversionOff": "HEIC conversion is off",
}

# Targets, quality range, prior and ceiling margins of each strength.
STRENGTH_ROWS = [
    ("pristine", 94.0, 91.0, 55, 98, 88, 0.5, 1.0),
    ("identical", 91.5, 86.5, 45, 97, 78, 1.5, 3.0),
    ("compact", 89.0, 82.5, 35, 95, 72, 3.0, 6.0),
]
STRENGTH_SCHEMA = "strength string, target_global double, target_worst double, min_q int, max_q int, prior int, margin_global double, margin_worst double"


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


S, L, B, D, I = T.StringType(), T.LongType(), T.BooleanType(), T.DoubleType(), T.IntegerType()

SESSIONS = _struct(
    ("id", S, False), ("started_at", L, False), ("finished_at", L, False), ("photos", L, False), ("optimized", L, False), ("skipped", L, False), ("failed", L, False),
    ("original_bytes", L, False), ("output_bytes", L, False), ("saved_bytes", L, False), ("output_mode", S, False), ("strength", S, False), ("can_undo", B, False), ("undone", B, False),
)
FILES = _struct(
    ("session_id", S, False), ("idx", L, False), ("path", S, False), ("status", S, False), ("original_bytes", L, False), ("output_bytes", L, False),
    ("skip_reason", S, True), ("error", S, True), ("result", S, False),
)
WRITTEN = _struct(("bytes", L, True), ("modifiedMs", L, True))
BACKUPS = _struct(("session_id", S, False), ("idx", L, False), ("original", S, False), ("backup", S, False), ("output", S, True), ("written", WRITTEN, True))
JOURNAL = _struct(("original", S, True), ("backup", S, True), ("output", S, True), ("written", WRITTEN, True))
OUTPUT = _struct(("path", S, True), ("bytes", L, True), ("width", I, True), ("height", I, True), ("sizeLabel", S, True))
RESULT = _struct(
    ("id", L, True), ("path", S, True), ("name", S, True), ("status", S, True), ("originalBytes", L, True), ("outputBytes", L, True), ("outputs", T.ArrayType(OUTPUT), True),
    ("originalPath", S, True), ("width", I, True), ("height", I, True), ("score", D, True), ("quality", I, True), ("skipReason", S, True), ("error", S, True), ("millis", L, True),
    ("previewPath", S, True), ("lossless", B, True), ("converted", B, True),
)
#: Fields without which a stored result is not a result.
RESULT_REQUIRED = ["id", "path", "name", "status", "originalBytes", "outputBytes", "outputs", "width", "height", "millis"]


def camel(name: str) -> str:
    """A column's name in JSON documents."""
    first, *rest = name.split("_")
    return first + "".join(part.capitalize() for part in rest)


#: A whole record as earlier versions kept it, one JSON document a session.
RECORD = _struct(("summary", T.StructType([T.StructField(camel(f.name), f.dataType, True) for f in SESSIONS.fields]), True), ("files", T.ArrayType(RESULT), True), ("backups", T.ArrayType(JOURNAL), True))
EVENT = _struct(
    ("kind", S, False), ("session_id", S, False), ("seq", L, False), ("total", L, True), ("status", S, True), ("converted", B, True), ("original_bytes", L, True), ("output_bytes", L, True),
)


def strengths(spark: SparkSession) -> DataFrame:
    """The three strengths; small enough to be broadcast by its nature."""
    return spark.createDataFrame(STRENGTH_ROWS, STRENGTH_SCHEMA)
