"""Column helpers: hashes, missing values, paths, numbers, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "<MISSING>"
#: Splits in order of priority, methods' families by slug.
SPLITS = ("train", "validation", "test")
#: The suffixes of images and videos.
IMAGE_SUFFIXES = (".bmp", ".jpeg", ".jpg", ".png", ".tif", ".tiff", ".webp")
VIDEO_SUFFIXES = (".avi", ".m4v", ".mkv", ".mov", ".mp4", ".webm")


def text_of(c: Column | str) -> Column:
    """The value as text, null as the empty string."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def missing_token(c: Column | str) -> Column:
    """The value as text; null and empty become ``<MISSING>``."""
    return F.when(text_of(c) == "", F.lit(MISSING)).otherwise(text_of(c))


def digest(*parts: Column | str) -> Column:
    """SHA-256, in hex, of the parts as text joined by NUL."""
    return F.sha2(F.concat_ws("\0", *(text_of(p) for p in parts)), 256)


def short_digest(n: int, *parts: Column | str) -> Column:
    """The first ``n`` hex digits of ``digest``."""
    return F.substring(digest(*parts), 1, n)


def hash_split(seed: str, *keys: Column | str) -> Column:
    """``validation`` if the digest of the seed and keys starts below 8, else ``test``."""
    return F.when(F.substring(digest(F.lit(seed), *keys), 1, 1) < "8", F.lit("validation")).otherwise(F.lit("test"))


def group_key(columns: list[str], fallback: str) -> Column:
    """The first non-empty of the columns, as ``column:value``; else the fallback column's."""
    named = [F.when(F.trim(text_of(c)) != "", F.concat(F.lit(f"{c}:"), F.trim(text_of(c)))) for c in columns]
    return F.coalesce(*named, F.concat(F.lit(f"{fallback}:"), text_of(fallback)))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    """The name without its last suffix, in lower case."""
    return F.lower(F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", ""))


def file_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]*)$", 1))


def media_kind(path: Column) -> Column:
    """``image`` or ``video`` by the file's suffix; others are an error."""
    unsupported = F.raise_error(F.concat(F.lit("unsupported media type: "), F.coalesce(file_name(path), F.lit("null")))).cast("string")
    return F.when(file_suffix(path).isin(*IMAGE_SUFFIXES), "image").when(file_suffix(path).isin(*VIDEO_SUFFIXES), "video").otherwise(unsupported)


def unsafe_path(path: Column) -> Column:
    """Whether a relative path leaves its root, is absolute or has empty or reserved parts."""
    return F.coalesce(
        (path == "") | path.startswith("/") | path.rlike(r"[\\:*?\"<>|\x00]")
        | F.exists(F.split(path, "/"), lambda p: p.isin("", ".", "..")), F.lit(True))


def frame_index(name: Column, position: Column) -> Column:
    """Trailing digits of the stem as a number, else the position."""
    return F.coalesce(F.regexp_extract(file_stem(name), r"(\d+)$", 1).try_cast("bigint"), position)


def frame_order(frame: Column) -> list[Column]:
    """Ordering of frame names: numbers first, by value, then text."""
    number = F.trim(text_of(frame)).try_cast("decimal(38,10)")
    return [number.isNull(), number, text_of(frame)]


def logit(p: Column, clip: float = 1e-7) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.log(q / (1 - q))


def sigmoid(x: Column, clamp: float = 80.0) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-clamp)), F.lit(clamp))))


def identity_tokens(name: Column) -> Column:
    """``id`` and digits, not after a letter or digit."""
    return F.array_distinct(F.regexp_extract_all(name, F.lit(r"(?<![A-Za-z0-9])(id[0-9]+)"), F.lit(1)))


def lineage_tokens(domain: Column, video: Column, explicit: Column) -> Column:
    """Sorted distinct ``domain:token``: an explicit pipe list, its parts trimmed, else the parts of an
    ``ff`` video, else the video itself. White space alone is no list."""
    listed = F.transform(F.split(F.trim(text_of(explicit)), r"\|"), lambda t: F.trim(t))
    parts = F.when(F.trim(text_of(explicit)) != "", listed).when(domain == "ff", F.split(video, "_")).otherwise(F.array(video))
    return F.array_sort(F.array_distinct(F.transform(F.filter(parts, lambda t: t != ""), lambda t: F.concat(domain, F.lit(":"), t))))


def source_entities(domain: Column, video: Column) -> Column:
    """Who is in a video, by its name without the domain: identity tokens of ``cdf``, which may be none;
    one or two leading numbers of ``ff``, or else the video itself; any other domain's video itself."""
    prefix = F.concat(domain, F.lit(":"))
    name = F.when(F.startswith(video, prefix), F.substring(video, F.char_length(prefix) + 1, F.char_length(video))).otherwise(video)
    numbers = F.filter(F.array(F.regexp_extract(name, r"^(\d+)", 1), F.regexp_extract(name, r"^\d+_(\d+)", 1)), lambda t: t != "")
    alone = F.array(F.when(domain == "ff", F.concat(F.lit("video:"), name)).otherwise(name))
    entities = F.when(domain == "cdf", F.array_sort(identity_tokens(name))).when((domain == "ff") & (F.size(numbers) > 0), numbers).otherwise(alone)
    return F.transform(entities, lambda t: F.concat(prefix, t))


def even_positions(n: Column, limit: int) -> Column:
    """Positions of ``limit`` evenly spaced of ``n`` rows: all if there are no more, the middle one
    for a limit of 1, else i (n - 1) / (limit - 1) rounded half to even."""
    if limit == 1:
        spaced = F.array((n / 2).cast("long"))
    else:
        spaced = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.bround(i * (n - 1) / F.lit(float(limit - 1)), 0).cast("long"))
    every = F.when(n > 0, F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.when(n <= limit, every).otherwise(F.array_distinct(spaced))


def uniform(seed: str, *keys: Column | str) -> Column:
    """A number in [0, 1) from the first 12 hex digits of the digest."""
    return F.conv(short_digest(12, F.lit(seed), *keys), 16, 10).cast("double") / F.lit(float(16**12))


def sign_hash(vector: Column) -> Column:
    """Bits of whether each component exceeds the next, first bit highest, as 0 and 1."""
    return F.array_join(F.transform(F.sequence(F.lit(1), F.size(vector) - 1), lambda i: F.when(
        F.element_at(vector, i) > F.element_at(vector, i + 1), "1").otherwise("0")), "")


def run_seed(name: Column, markers: tuple[str, ...]) -> Column:
    """The seed in a run's name: eight digits that begin with 20, after one of the markers and before a dash or
    the end. A name without one is an error when its row is read."""
    found = F.regexp_extract(name, f"(?:{'|'.join(markers)})(20[0-9]{{6}})(?:-|$)", 1)
    return F.when(found != "", found.cast("long")).otherwise(F.raise_error(F.concat(F.lit("no seed in a run's name: "), text_of(name))).cast("long"))
