"""Names, paths, hashes and search as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions that count as images, those that extraction reads, and their MIME types.
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "gif", "webp", "bmp", "tiff", "tif", "avif", "svg"]
EXTRACT_EXTENSIONS = ["jpg", "jpeg", "png", "webp"]
MIME_TYPES = {
    "html": "text/html",
    "js": "application/javascript",
    "css": "text/css",
    "json": "application/json",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "gif": "image/gif",
    "webp": "image/webp",
    "bmp": "image/bmp",
    "tiff": "image/tiff",
    "tif": "image/tiff",
    "avif": "image/avif",
    "svg": "image/svg+xml",
}


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """With its dot; names that begin with their only dot have none."""
    return F.regexp_extract(base_name(name), r"^.+(\.[^.]*)$", 1)


def stem(name: Column) -> Column:
    base = base_name(name)
    return F.substring(base, F.lit(1), F.length(base) - F.length(extension(base)))


def title(name: Column) -> Column:
    """What follows the number of a numbered name, with its separator; else empty."""
    return F.regexp_extract(stem(name), r"^\d+(\s*-\s*.+)$", 1)


def padded(number: Column, total: Column) -> Column:
    """Zero-padded to the digits of the total, three at least."""
    text = number.cast("string")
    width = F.greatest(F.lit(3), F.length(total.cast("string")))
    return F.lpad(text, F.greatest(width, F.length(text)), "0")


def numbered_name(number: Column, total: Column, name: Column) -> Column:
    return F.concat(padded(number, total), title(name), F.lower(extension(name)))


def strip_number(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"^\d+\s*-\s*", ""))


def is_image(name: Column, extensions: list[str] | None = None) -> Column:
    return ~name.startswith(".") & F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*(extensions or IMAGE_EXTENSIONS))


def deletable(name: Column) -> Column:
    return ~(name.contains("/") | name.contains("..") | name.startswith("."))


def natural_key(name: Column) -> Column:
    """Sorts digits by value, letters without case; for ASCII names. Runs of digits are padded, so one string compare is enough."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d+$"), F.lpad(F.regexp_replace(r, r"^0+(?=\d)", ""), F.lit(24), F.lit("0"))).otherwise(r)), "")


def scope_key(ids: Column) -> Column:
    return F.substring(F.sha2(F.array_join(F.array_sort(ids), "\n"), 256), 1, 16)


def batch_hash(names: Column) -> Column:
    return F.substring(F.sha1(F.array_join(F.array_sort(names), "\n")), 1, 8)


def safe_name(name: Column) -> Column:
    return F.substring(F.regexp_replace(name, "[^a-zA-Z0-9_-]", "_"), 1, 80)


def middle_cut(text: Column, most: Column) -> Column:
    """Of a text longer than ``most`` 55 % of what may stay from the left, an ellipsis, the rest from the right."""
    left = F.ceil((most - 1) * F.lit(0.55)).cast("int")
    right = (most - 1 - left).cast("int")
    n = F.length(text)
    return F.when(n <= most, text).otherwise(F.concat(F.substring(text, F.lit(1), left), F.lit("…"), F.when(right > 0, F.substring(text, n - right + 1, right)).otherwise("")))


def label_width(cell_width: Column) -> Column:
    """Characters that a label over a cell of so many pixels may have."""
    return F.greatest(F.lit(12), F.floor((cell_width - 20) / 9)).cast("int")


def xml_escape(text: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(name))
    return text


def path_format(folder: Column, name: Column, at_prefix: bool = False) -> Column:
    """A quoted path for a prompt, with an @ before it if asked for."""
    return F.concat(F.lit('@"' if at_prefix else '"'), folder, F.lit("/"), name, F.lit('"'))


def mime_type(path: Column) -> Column:
    found = F.create_map(*(F.lit(x) for kv in MIME_TYPES.items() for x in kv))[F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1))]
    return F.coalesce(found, F.lit("application/octet-stream"))


def weak_etag(inode: Column, size: Column) -> Column:
    return F.concat(F.lit('W/"'), inode.cast("string"), F.lit("-"), size.cast("string"), F.lit('"'))


def thumbnail_key(inode: Column, size: Column) -> Column:
    return F.concat(inode.cast("string"), F.lit("-"), size.cast("string"), F.lit(".webp"))


def contains_text(text: Column, query: str) -> Column:
    """Case-insensitive; a blank query finds nothing, and the query isn't trimmed."""
    return F.lower(text).contains(query.lower()) if query.strip() else F.lit(False)


def fuzzy(text: Column, query: str) -> Column:
    """Whether the query's characters stand in the text in order."""
    pattern = "(?s)" + ".*".join("\\Q" + c + "\\E" for c in query.lower())
    return F.lower(text).rlike(pattern) if query else F.lit(True)
