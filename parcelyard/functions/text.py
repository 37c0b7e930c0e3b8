"""Names, keys and identifiers built from text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The host suffix of stored photos, the characters a file name may
# not keep, and the extension of stored pictures.
STORAGE_HOST = ".amazonaws.com"
FORBIDDEN_IN_NAMES = r'[:<>|?*"]'
PICTURE_EXTENSION = ".webp"


# Characters an address may hold raw but its path keeps encoded.
ENCODED_IN_PATHS = {
    " ": "%20",
    '"': "%22",
    "<": "%3C",
    ">": "%3E",
    "`": "%60",
    "{": "%7B",
    "}": "%7D",
}

# Characters a path keeps as they are, but Spark's parser refuses: they pass it as
# private-use characters, the last of which stands for a lone percent sign.
_KEPT_IN_PATHS = "|[]^%"
_STAND_INS = "\ue000\ue001\ue002\ue003\ue004"


# Path parts that stand for the folder itself and the one above.
_HERE = (".", "%2e")
_ABOVE = ("..", ".%2e", "%2e.", "%2e%2e")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _without_dots(path: Column) -> Column:
    """The path behind its first slash, with the parts ``.`` and ``..`` carried out."""
    parts = F.split(F.regexp_replace(path, r"^/", ""), "/", -1)

    def step(done: Column, part: Column) -> Column:
        low = F.lower(part)
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return (
            F.when(low.isin(*_ABOVE), up)
            .when(low.isin(*_HERE), done)
            .otherwise(F.concat(done, F.array(part)))
        )

    walked = F.aggregate(parts, F.array().cast("array<string>"), step)
    # A path that ends in a folder ends in a slash.
    ends = F.lower(F.element_at(parts, -1)).isin(*_HERE, *_ABOVE)
    walked = F.when(ends, F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    # Few paths have a part that begins with a dot; the others are not taken apart.
    dotted = F.contains(path, F.lit("/.")) | F.contains(F.lower(path), F.lit("%2e"))
    return F.when(dotted, F.array_join(walked, "/")).otherwise(F.regexp_replace(path, r"^/", ""))


def _encoded(key: Column) -> Column:
    """Characters outside ASCII percent-encoded."""
    letters = F.transform(
        F.regexp_extract_all(key, F.lit("(?s)."), F.lit(0)),
        lambda c: F.when(F.octet_length(c) > 1, F.url_encode(c)).otherwise(c),
    )
    return F.when(F.octet_length(key) > F.char_length(key), F.array_join(letters, "")).otherwise(key)


def object_key(url: Column) -> Column:
    """Object key behind a storage URL; NULL for other hosts and broken URLs.

    Spaces, some punctuation and characters outside ASCII appear percent-encoded.
    Tabs and line ends are left out, and ``.`` and ``..`` in the path are resolved.
    """
    clean = F.regexp_replace(F.translate(url, "\t\n\r", ""), r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    clean = F.replace(clean, F.lit("\\"), F.lit("/"))
    for raw, encoded in ENCODED_IN_PATHS.items():
        clean = F.replace(clean, F.lit(raw), F.lit(encoded))
    clean = F.regexp_replace(clean, "%(?![0-9A-Fa-f]{2})", _STAND_INS[-1])
    clean = F.translate(clean, _KEPT_IN_PATHS[:-1], _STAND_INS[:-1])

    def parsed(text: Column) -> Column:
        return F.struct(
            F.lower(F.try_parse_url(text, F.lit("HOST"))).alias("host"),
            F.try_parse_url(text, F.lit("PATH")).alias("path"),
        )

    def key(address: Column) -> Column:
        found = F.translate(_without_dots(address["path"]), _STAND_INS, _KEPT_IN_PATHS)
        return F.when(address["host"].endswith(STORAGE_HOST), _once(found, _encoded))

    return F.nullif(_once(_once(clean, parsed), key), F.lit(""))


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, FORBIDDEN_IN_NAMES, "_")


def with_picture_extension(name: Column) -> Column:
    """Swap the extension; a name without one stays as it is."""
    return F.regexp_replace(name, r"\.[^/.]+\z", PICTURE_EXTENSION)


def base_name(path: Column) -> Column:
    """Last path part without its extension; a leading dot is no extension."""
    name = F.regexp_extract(path, r"([^/]*)/*\z", 1)
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*\z", "")


def box_identifier(sender: Column, at: Column) -> Column:
    return F.concat(sender, F.lit("_"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))
