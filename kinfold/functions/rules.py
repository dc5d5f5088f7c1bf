"""Rules over items: validation, bands, classes, priorities, names and formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted types and extensions.
MIME_TYPES = ("image/jpeg", "image/png", "image/webp", "image/gif", "image/heic", "image/heif", "image/bmp", "image/tiff")
EXTENSIONS = ("jpg", "jpeg", "png", "webp", "gif", "heic", "heif", "bmp", "tif", "tiff")
MOST_BYTES = 20 * 1024 * 1024
LEAST_SIDE = 100
# Thresholds and adjustments by class, time factors by format.
CLASS_THRESHOLDS = {"portrait": 92, "landscape": 85, "document": 95, "text": 97, "graphical": 90, "artwork": 87, "other": 90}
CLASS_ADJUSTMENTS = {"portrait": 5, "landscape": -5, "text": 8, "document": 8, "artwork": -3}
FORMAT_FACTORS = {"heic": 3.0, "raw": 4.0, "tiff": 2.0, "gif": 1.5}
ERROR_CATEGORIES = {"missing": "INPUT_ERROR", "too_large": "PHOTO_SIZE_ERROR", "empty": "PHOTO_LOAD_ERROR", "bad_format": "PHOTO_FORMAT_ERROR", "too_small": "PHOTO_FORMAT_ERROR", "corrupt": "PHOTO_LOAD_ERROR"}


def lookup(key: Column, values: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))


def validation_error(name: Column, mime: Column, size: Column, width: Column | None = None, height: Column | None = None) -> Column:
    """The first rule that an item breaks, or null: missing, too_large, empty, bad_format, corrupt, too_small."""
    out = F.when(name.isNull() | size.isNull(), "missing").when(size > MOST_BYTES, "too_large").when(size <= 0, "empty")
    out = out.when(~F.coalesce(mime.isin(*MIME_TYPES), F.lit(False)) & ~extension(name).isin(*EXTENSIONS), "bad_format")
    if width is not None:
        out = out.when(width.isNull() | height.isNull(), "corrupt").when((width < LEAST_SIDE) | (height < LEAST_SIDE), "too_small")
    return out


def error_category(error: Column) -> Column:
    return lookup(error, ERROR_CATEGORIES)


def mime_of(name: Column) -> Column:
    ext = extension(name)
    return F.when(ext == "png", "image/png").when(ext == "gif", "image/gif").when(ext == "webp", "image/webp").when(ext == "heic", "image/heic").otherwise("image/jpeg")


def quality_band(score: Column) -> Column:
    return F.when(score >= 80, "high").when(score >= 60, "medium").otherwise("low")


def predicate(spec: list[dict]) -> Column:
    """A condition from filters {type: quality, date, tag, category or name; operator: gt, lt or eq; value}, all of which hold."""

    def one(f: dict) -> Column:
        kind, value = f["type"], f["value"]
        if kind == "tag":
            return F.array_contains("tags", value)
        if kind == "name":
            return F.contains(F.lower(F.col("name")), F.lower(F.lit(value)))
        c = F.col(kind)
        return {"gt": c > value, "lt": c < value, "eq": c == value}[f.get("operator", "eq")]

    return reduce(lambda a, b: a & b, (one(f) for f in spec), F.lit(True))


def image_class(edge: Column, skin: Column, r: Column, g: Column, b: Column, aspect: Column) -> Column:
    """Category, confidence and threshold from edge and skin ratios and mean colours."""
    portrait = (skin > 0.15) & aspect.between(0.5, 1.5) & (edge < 0.3)
    landscape = ((b > r) & (g > r)) | ((g > r * 1.1) & (g > b) & (edge < 0.2) & (skin < 0.1))
    document = (edge > 0.2) & (r > 200) & (g > 200) & (b > 200) & (skin < 0.05)
    text = (edge > 0.3) & (F.abs(r - g) < 30) & (F.abs(r - b) < 30) & (skin < 0.02)
    drawn = (edge > 0.15) & (F.greatest(r, g, b) - F.least(r, g, b) > 50)
    category = F.when(portrait, "portrait").when(landscape, "landscape").when(document, "document").when(text, "text").when(drawn, F.when(r > F.greatest(g, b) * 1.2, "artwork").otherwise("graphical")).otherwise("other")
    confidence = F.when(portrait, F.least(F.lit(0.9), skin * 2)).when(landscape, 0.7 + F.least(g, b) / F.greatest(r, F.lit(1.0)) * 0.2)
    confidence = confidence.when(document, 0.6 + edge * 0.4).when(text, 0.7 + edge * 0.3).when(drawn, 0.6 + edge * 0.2).otherwise(0.5)
    return F.struct(category.alias("category"), confidence.alias("confidence"), lookup(category, CLASS_THRESHOLDS).alias("threshold"))


def adaptive_threshold(base: Column, category: Column, confidence: Column, edge: Column, faces: Column) -> Column:
    """The base moved by class, edges and faces, as far as the confidence goes, within 70 and 98."""
    move = F.coalesce(lookup(category, CLASS_ADJUSTMENTS), F.lit(0)) + F.when(edge > 0.1, -3).when(edge < 0.03, 3).otherwise(0) + F.when(faces > 0, 5).otherwise(0)
    return F.greatest(F.lit(70.0), F.least(F.lit(98.0), base + move * confidence))


def priority(size: Column, fmt: Column, complexity: Column, pixels: Column, preferred: tuple[str, ...] = ("jpg", "jpeg", "png"), complex_from: int = 70) -> Column:
    out = F.lit(5) + F.when(size > 10 * 1024 * 1024, -2).when(size < 100 * 1024, 1).otherwise(0) + F.when(fmt.isin(*preferred), 2).otherwise(0)
    return out + F.when(pixels > 4000 * 3000, -1).otherwise(0) + F.when(complexity > complex_from, -1).otherwise(0)


def estimated_time(size: Column, complexity: Column, fmt: Column) -> Column:
    factor = F.coalesce(lookup(fmt, FORMAT_FACTORS), F.lit(1.0))
    return F.greatest(F.lit(50), F.least(F.lit(10000), F.floor(size / 1024 / 10 * (0.5 + complexity / 100 * 1.5) * factor + 0.5))).cast("int")


def fixed(c: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", c.cast("double"))


def rounded(c: Column, digits: int) -> Column:
    """The double rounded; one below zero that rounds to zero keeps its sign, as it does in SQL engines that scale and round."""
    value = F.round(c, digits)
    return F.when(value == 0, c * F.lit(0.0)).otherwise(value)


def format_bytes(n: Column) -> Column:
    k = 1024.0
    return F.when(n < k, F.concat(n.cast("string"), F.lit(" B"))).when(n < k**2, F.concat(fixed(n / k), F.lit(" KB"))).when(n < k**3, F.concat(fixed(n / k**2), F.lit(" MB"))).otherwise(F.concat(fixed(n / k**3), F.lit(" GB")))


def format_seconds(s: Column) -> Column:
    """Seconds below a minute, else minutes and seconds."""
    whole = F.floor(s).cast("long")
    return F.when(whole < 60, F.concat(whole.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(whole / 60).cast("string"), F.lit("m "), (whole % 60).cast("string"), F.lit("s")))


def new_name(taken: Column, number: Column, name: Column, prefix: str = "IMG") -> Column:
    """IMG_YYYYMMDD_0001.ext"""
    return F.concat(F.lit(f"{prefix}_"), F.date_format(taken, "yyyyMMdd"), F.lit("_"), F.lpad(number.cast("string"), 4, "0"), F.lit("."), F.element_at(F.split(name, r"\."), -1))


def folder(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - 1)), "/")


def cache_key(name: Column, size: Column, modified: Column) -> Column:
    return F.concat_ws("_", name, size.cast("string"), modified.cast("string"))


def object_size(vector: Column, *texts: Column) -> Column:
    """Bytes of a record: 8 for each number, 2 for each character."""
    return reduce(lambda a, b: a + b, (F.coalesce(F.length(t), F.lit(0)) * 2 for t in texts), F.coalesce(F.size(vector), F.lit(0)) * 8).cast("long")


def stride_sample(vector: Column, ratio: float) -> Column:
    """Every k-th component, so that the share ``ratio`` of them stays."""
    step = max(1, int(1 / ratio))
    return F.filter(F.transform(vector, lambda x, i: F.when(i % step == 0, x)), lambda x: x.isNotNull())


def average_pool(vector: Column, dims: int) -> Column:
    """Means of runs of ceil(n / dims) components; an empty tail is left out."""
    n = F.size(vector)
    width = F.ceil(n / dims).cast("int")
    runs = F.sequence(F.lit(0), F.ceil(n / width).cast("int") - 1)
    return F.transform(runs, lambda i: F.aggregate(F.slice(vector, i * width + 1, width), F.lit(0.0), lambda a, x: a + x.cast("double")) / F.least(width, n - i * width))


def gradient_sample(vector: Column, length: int) -> Column:
    """Both ends and the components before the greatest changes, ``length`` at most, in order; ties take the first."""
    last = F.size(vector) - 1
    steps = F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.struct((-F.abs(F.get(vector, i + 1).cast("double") - F.get(vector, i).cast("double"))).alias("s"), i.alias("i")))
    keys = F.transform(F.slice(F.array_sort(steps), 1, length - 2), lambda s: s["i"])
    places = F.array_sort(F.array_distinct(F.concat(keys, F.array(F.lit(0), last))))
    return F.transform(places, lambda i: F.get(vector, i))


def region_weight(weight: Column, confidence: Column, box: tuple[Column, Column, Column, Column], picture: tuple[Column, Column]) -> Column:
    """A region's weight by its share of the picture, its distance to the centre and its confidence, from 0.5 to 2.

    ``box``: x, y, width, height; ``picture``: width, height. Null where a part is null.
    """
    x, y, wide, high = (c.cast("double") for c in box)
    width, height = (c.cast("double") for c in picture)
    share = wide * high / (width * height)
    far = F.sqrt(F.pow(x + wide / 2 - width / 2, 2) + F.pow(y + high / 2 - height / 2, 2)) / F.sqrt(F.pow(width / 2, 2) + F.pow(height / 2, 2))
    # Fixed values.
    by_area = F.when(share > 0.1, 1.5).when(share > 0.05, 1.3).otherwise(1.0)
    by_place = F.when(far < 0.2, 1.4).when(far < 0.4, 1.2).otherwise(1.0)
    value = weight * by_area * by_place * (0.8 + 0.4 * confidence)
    return F.when(value.isNotNull(), F.least(F.lit(2.0), F.greatest(F.lit(0.5), value)))


def large_enough(width: Column, height: Column, least: int = 500) -> Column:
    """Whether regions of a picture are looked for; pictures of unknown size are."""
    return ~(F.coalesce(width < least, F.lit(False)) | F.coalesce(height < least, F.lit(False)))


def batch_parameters(mean_bytes: Column, cores: Column, memory_gb: Column) -> Column:
    """Struct of batch_size and delay (ms) for items of a mean size on a machine; null sizes give null."""
    mb = mean_bytes / 1048576
    size = F.greatest(F.lit(1), F.least(F.lit(20), F.floor(cores * 1.5)))
    size = F.when(mb > 5, F.greatest(F.lit(1), F.floor(size * 0.5))).when(mb > 2, F.greatest(F.lit(1), F.floor(size * 0.7))).otherwise(size)
    size = F.when(memory_gb < 4, F.greatest(F.lit(1), F.floor(size * 0.6))).when(memory_gb > 8, F.floor(size * 1.3)).otherwise(size)
    return F.when(mean_bytes.isNotNull(), F.struct(size.cast("int").alias("batch_size"), F.floor(50 + mb * 10 + 0.5).cast("int").alias("delay")))


def released(vector: Column, idle_seconds: Column, most: int = 600) -> Column:
    """The vector, emptied where nothing has asked for it for longer; one that was never asked for stays."""
    return F.when(idle_seconds > most, F.slice(vector, 1, 0)).otherwise(vector)


def with_tag(tags: Column, name: Column) -> Column:
    """Tags and one more, its name trimmed; blank names add none. A tag that is there is added again, as in the original."""
    trimmed = F.trim(name)
    old = F.coalesce(tags, F.array().cast("array<string>"))
    return F.when(F.length(trimmed) > 0, F.concat(old, F.array(trimmed))).otherwise(old)
