"""Text and file-name column functions. All of them stay inside the JVM."""

from __future__ import annotations

import mimetypes
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryline.functions.binding import bind

# The characters a Unicode-aware strip() and split() treat as blank.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regex class body; understood by Java and by RE2.
BLANK_CLASS = r"\x09-\x0D\x1C-\x20\x{85}\p{Z}"
# Blanks that do not end a line.
INLINE_BLANK_CLASS = r"\x09\x0B-\x0D\x1C-\x20\x{85}\p{Z}"

# Characters not allowed in a stored file name.
UNSAFE_FILENAME_CHARS = '<>:"/\\|?*'
DEFAULT_MIME_TYPE = "application/octet-stream"
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def strip(text: Column) -> Column:
    """Remove blanks of any kind from both ends."""
    return F.trim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def truthy(text: Column) -> Column:
    """The string itself, or null where it is empty."""
    return F.nullif(text, F.lit(""))


def words(text: Column) -> Column:
    """Blank-separated words, case kept."""
    return F.filter(F.split(text, f"[{BLANK_CLASS}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANK_CLASS}]+")), F.lit(0))


def checksum(content: Column, algorithm: str = "sha256") -> Column:
    """Hex digest of bytes or text."""
    if algorithm == "md5":
        return F.md5(content)
    if algorithm == "sha1":
        return F.sha1(content)
    if algorithm in ("sha224", "sha256", "sha384", "sha512"):
        return F.sha2(content, int(algorithm[3:]))
    raise ValueError(f"unsupported checksum algorithm: {algorithm}")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*\z", 1)


def file_extension(filename: Column) -> Column:
    """Lower-cased last suffix with its dot; empty for dotfiles and trailing dots."""
    return F.lower(F.regexp_extract(base_name(filename), r"(?s).(\.[^.]+)\z", 1))


def mime_type(filename: Column, types: dict[str, str] | None = None) -> Column:
    """MIME type by extension, looking below a compression suffix."""
    known = mimetypes.MimeTypes(filenames=())
    table = dict(types) if types is not None else dict(known.types_map[True])
    for short, full in known.suffix_map.items():
        inner = full.rsplit(".", 1)[0]
        if inner in table:
            table.setdefault(short, table[inner])
    name = base_name(filename)
    packed = "|".join(re.escape(e) for e in sorted(known.encodings_map))
    plain = F.regexp_replace(name, rf"(?s)(?<=[^.])(?:{packed})\z", "")
    suffix = F.lower(F.regexp_extract(plain, r"(?s)[^.].*?(\.[^.]*)\z", 1))
    lookup = F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair])
    return F.coalesce(F.try_element_at(lookup, suffix), F.lit(DEFAULT_MIME_TYPE))


def sanitize_filename(filename: Column) -> Column:
    return F.translate(filename, UNSAFE_FILENAME_CHARS, "_" * len(UNSAFE_FILENAME_CHARS))


def format_bytes(size: Column) -> Column:
    """Size as text with one decimal, halves to even."""
    value = size.cast("double")
    ladder = None
    for power, unit in enumerate(SIZE_UNITS):
        scaled = value / F.lit(float(1024**power))
        text = F.format_string(f"%.1f {unit}", F.bround(scaled, 1))
        if ladder is None:
            ladder = F.when(scaled < 1024.0, text)
        elif unit == SIZE_UNITS[-1]:
            ladder = ladder.otherwise(text)
        else:
            ladder = ladder.when(scaled < 1024.0, text)
    return F.when(size.isNotNull(), ladder)


def truncate_text(text: Column, max_length: int, suffix: str = "...") -> Column:
    """Cut to `max_length` characters, the suffix included."""
    keep = max_length - len(suffix)
    kept = F.substring(text, 1, keep) if keep >= 0 else F.left(text, F.length(text) + keep)
    return F.when(F.length(text) <= max_length, text).otherwise(F.concat(kept, F.lit(suffix)))


def split_on_boundary(text: Column, boundary: str = " ") -> Column:
    """Parts between literal boundaries, stripped, blank ones dropped."""
    parts = F.transform(F.split(text, re.escape(boundary)), strip)
    return F.filter(parts, lambda part: part != "")


def is_valid_uuid(text: Column) -> Column:
    """Hyphens optional, braces and the urn:uuid: prefix allowed."""
    bare = F.replace(F.replace(text, F.lit("urn:"), F.lit("")), F.lit("uuid:"), F.lit(""))
    digits = F.replace(F.trim(bare, F.lit("{}")), F.lit("-"), F.lit(""))
    hexadecimal = r"\A\+?(0[xX]_?)?[0-9a-fA-F]+(_[0-9a-fA-F]+)*\z"
    return F.coalesce((F.length(digits) == 32) & digits.rlike(hexadecimal), F.lit(False))


def search_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}\p{M}]+"), lambda w: w != "")


def stem(word: Column) -> Column:
    """A light English stem of a lower-cased word: plurals and -ed, -ing, -e endings go.

    It only has to map the forms of a word to one term, not to a word.
    """
    rules = (
        (r"^(.{2,})ies$", "$1y"),
        (r"^(.+(?:ss|sh|ch|x|z))es$", "$1"),
        (r"^(.{2,}[^siu])s$", "$1"),
        (r"^([^aeiouy]*[aeiouy].*?[^aeiou])(?:ing|ed)$", "$1"),
        (r"^(.{2,})([bdgmnprt])\2$", "$1$2"),
        (r"^(.{3,})e$", "$1"),
    )
    for pattern, kept in rules:
        word = F.regexp_replace(word, pattern, kept)
    return word


def run_starts(ordered: Column, key=lambda x: x) -> Column:
    """Indexes at which a sorted array's key changes, the first included."""
    numbers = F.transform(ordered, lambda _, i: i)
    return F.filter(
        numbers, lambda i: (i == 0) | (key(F.get(ordered, i)) != key(F.get(ordered, i - 1)))
    )


def run_length(ordered: Column, starts: Column, start: Column, number: Column) -> Column:
    """Length of the run that begins at `start`, the `number`-th of `starts`."""
    return F.coalesce(F.get(starts, number + 1), F.size(ordered)) - start


def word_counts(spoken: Column) -> Column:
    """Counts of a word array as (word, tf) structs, sorted by word; linear after sorting."""

    def counted(ordered: Column) -> Column:
        return bind(
            run_starts(ordered),
            lambda starts: F.transform(
                starts,
                lambda s, i: F.struct(
                    F.get(ordered, s).alias("word"),
                    run_length(ordered, starts, s, i).alias("tf"),
                ),
            ),
        )

    return bind(F.array_sort(spoken), counted)
