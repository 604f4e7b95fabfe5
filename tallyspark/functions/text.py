"""Text and path functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SKIP_LABELS, STRENGTHS

JPEG, HEIC, VIDEO = ["jpg", "jpeg", "jpe", "jfif"], ["heic", "heif", "hif"], ["mov"]


def known_or(value: Column, known: list[str], default: str) -> Column:
    return F.when(value.isin(known), value).otherwise(default)


def strength_of(value: Column) -> Column:
    return known_or(value, STRENGTHS, "identical")


def extension(path: Column) -> Column:
    """ASCII lower-cased extension of the last component, '' if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def media_kind(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin(JPEG), "jpeg").when(ext.isin(HEIC), "heic").when(ext.isin(VIDEO), "video").otherwise("other")


def file_name(path: Column) -> Column:
    """Last component of a path with either slash; the path itself if that is empty."""
    name = F.regexp_extract(path, r"[^/\\]*$", 0)
    return F.when(name == "", path).otherwise(name)


def is_hidden(path: Column) -> Column:
    return file_name(path).startswith(".")


def converted_name(path: Column) -> Column:
    """The JPEG's path: JPG where the old extension is all upper case, else jpg."""
    ext = F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)
    new = F.when((ext != "") & (F.upper(ext) == ext) & (F.lower(ext) != ext), "JPG").otherwise("jpg")
    return F.concat(F.when(ext == "", path).otherwise(F.regexp_replace(path, r"\.[^./]+$", "")), F.lit("."), new)


def safe_label(label: Column) -> Column:
    """A label as a folder name: odd characters are dashes, blanks and dots at the ends go, nothing left is ``Size``."""
    dashed = F.regexp_replace(label, r'[\x00-\x1F\x7F-\x9F/\\:*?"<>|]', "-")
    trimmed = F.regexp_replace(F.regexp_replace(F.trim(dashed), r"^\.+", ""), r"[. ]+$", "")
    return F.when(trimmed == "", "Size").otherwise(trimmed)


def export_path(path: Column, root: Column, directory: str | None, label: Column, sizes: int, name: Column | None = None, folder: str = "Exported") -> Column:
    """Where a copy goes: under ``directory`` mirroring the root's name, flat without a root, else in a folder beside the file."""
    parent = F.regexp_replace(path, "/[^/]*$", "")
    name = F.regexp_extract(path, "[^/]*$", 0) if name is None else name
    if directory is None:
        base = F.concat_ws("/", parent, F.lit(folder))
    else:
        below = F.when(parent.startswith(F.concat(root, F.lit("/"))), F.expr("NULL")).otherwise(F.lit(""))
        below = F.coalesce(below, F.substring(parent, F.length(root) + 2, F.length(parent)))
        mirrored = F.concat_ws("/", F.lit(directory), F.regexp_extract(root, "[^/]*$", 0), F.when(below != "", below))
        base = F.when(root.isNull(), F.lit(directory)).otherwise(mirrored)
    return F.concat_ws("/", base, safe_label(label), name) if sizes > 1 else F.concat_ws("/", base, name)


def csv_field(value: Column) -> Column:
    """Always quoted; formulas are made text."""
    safe = F.when(value.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


def one_decimal(value: Column) -> Column:
    """%.1f of a double, ties to even."""
    return F.bround(value.cast("decimal(38,18)"), 1).cast("decimal(38,1)").cast("string")


def skip_label(reason: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in SKIP_LABELS.items() for x in kv])
    return F.coalesce(labels[reason], F.lit(""))


def csv_log(files: DataFrame) -> DataFrame:
    """Lines of a session's log: path, status, sizes, saved percent, quality, score, reason, outputs."""
    o, r = F.col("original_bytes"), F.col("output_bytes")
    percent = F.when(o > 0, F.lit(100.0) * (F.lit(1.0) - r.cast("double") / o.cast("double"))).otherwise(F.lit(0.0))
    reason = F.coalesce("error", skip_label(F.col("skip_reason")))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    score = F.when(F.col("score").isNotNull(), one_decimal(F.col("score"))) if "score" in files.columns else F.lit(None).cast("string")
    line = F.concat_ws(",", csv_field(F.col("path")), csv_field(F.col("status")), text(o), text(r), one_decimal(percent), text(F.col("quality")), text(score), csv_field(reason), csv_field(F.concat_ws(" | ", "outputs")))
    return files.select("session_id", "idx", line.alias("line"))


CSV_HEADER = "file,status,original_bytes,output_bytes,saved_percent,quality,score,reason,output"


def bytes_text(value: Column, base: int = 1000) -> Column:
    """Size as KB without, MB with one and GB with two decimals; negative counts as 0."""
    b = F.greatest(value, F.lit(0).cast("long"))
    k, m, g = base, base**2, base**3

    def text(unit: int, decimals: int) -> Column:
        scale = 10**decimals
        q = ((b * F.lit(scale) + F.lit(unit // 2)) - ((b * F.lit(scale) + F.lit(unit // 2)) % F.lit(unit))) / F.lit(unit)
        q = q.cast("long")
        if not decimals:
            return q.cast("string")
        head = ((q - q % scale) / scale).cast("long")
        return F.concat(head.cast("string"), F.lit("."), F.lpad((q % scale).cast("string"), decimals, "0"))

    return F.when(b >= g, F.concat(text(g, 2), F.lit(" GB"))).when(b >= m, F.concat(text(m, 1), F.lit(" MB"))).otherwise(F.concat(text(k, 0), F.lit(" KB")))


def duration_text(ms: Column) -> Column:
    """Milliseconds below a second, one decimal below a minute, else minutes and rounded seconds (which may say 60)."""
    tenths = F.floor((ms + 50) / 100).cast("long")
    seconds = F.concat(F.floor(tenths / 10).cast("string"), F.when(tenths % 10 != 0, F.concat(F.lit("."), (tenths % 10).cast("string"))).otherwise(""), F.lit(" s"))
    minutes = F.concat(F.floor(ms / 60000).cast("string"), F.lit(" min "), F.floor((ms % 60000 + 500) / 1000).cast("string"), F.lit(" s"))
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit(" ms"))).when(ms < 60000, seconds).otherwise(minutes)


def saved_permille(original: Column, output: Column) -> Column:
    """Fraction saved in thousandths, never negative, 0 without an original."""
    return F.when(original <= 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(0).cast("long"), F.floor((original - output) * 1000 / original).cast("long")))


def strip_property(text: Column, name: str) -> Column:
    """Removes the attributes and elements of a property: attributes first, then empty elements, then elements with content."""
    step = F.regexp_replace(text, rf"""\s+{name}\s*=\s*("[^"]*"|'[^']*')""", "")
    step = F.regexp_replace(step, rf"<{name}[^>]*/>", "")
    return F.regexp_replace(step, rf"(?s)<{name}[^>]*>.*?</{name}>", "")


#: GPS properties of an XMP packet.
GPS = "exif:GPS[A-Za-z]+"


def language(tags: Column) -> Column:
    """The first tag whose primary subtag is en or es, else en."""
    primary = F.transform(tags, lambda t: F.lower(F.split(t, "[-_]")[0]))
    return F.coalesce(F.try_element_at(F.filter(primary, lambda t: t.isin("en", "es")), F.lit(1)), F.lit("en"))


def unique_names(names: DataFrame, folder: str, name: str, order: str) -> DataFrame:
    """names with ``unique``: the first of equal names in a folder stays, the k-th other one is ``stem n.ext``.

    n is the k-th number from 2 on that no literal name of the folder takes.
    """
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    from ..operators.ranks import ranked as place

    ranked = place(names, [folder, name], [order], "__k").withColumns({"__stem": stem, "__ext": ext, "__k": F.col("__k") - 1})
    literal = names.select(folder, name).distinct().withColumns({"__base": F.regexp_extract(stem, r"^(.*) ([0-9]+)$", 1), "__ext": ext, "__n": F.expr(f"try_cast(regexp_extract(regexp_extract({name}, '^(.*?)([.][^.]*)?$', 1), '^(.*) ([0-9]+)$', 2) AS INT)")})
    taken = literal.filter("__n >= 2").groupBy(folder, F.col("__base").alias("__stem"), "__ext").agg(F.array_sort(F.collect_set("__n")).alias("__taken"))
    joined = ranked.join(taken, [folder, "__stem", "__ext"], "left")
    number = F.aggregate(F.coalesce("__taken", F.array().cast("array<int>")), F.col("__k") + 1, lambda x, t: F.when(t <= x, x + 1).otherwise(x))
    made = F.concat(F.col("__stem"), F.lit(" "), number.cast("string"), F.col("__ext"))
    return joined.withColumn("unique", F.when(F.col("__k") == 0, F.col(name)).otherwise(made)).select(*names.columns, "unique")


def noise(number: Column) -> Column:
    """A number between 0 and 1 that looks random and is the same everywhere."""
    x = F.sin(number * F.lit(12.9898)) * F.lit(43758.5453)
    return x - F.floor(x)
