from __future__ import annotations

import mimetypes
from pathlib import PurePosixPath
from uuid import UUID

import pytest
from pyspark.sql import functions as F

from quarryline.functions import text as fx

C = F.col("x")


@pytest.mark.parametrize(
    "name", ["a.pdf", "A.PDF", "dir.d/file", ".profile", "x.", "a.tar.gz", "..a", "p/q.TXT", "no", "a.b/"]
)
def test_extension_is_the_path_suffix(one, name):
    assert one(fx.file_extension(C), x=name) == PurePosixPath(name).suffix.lower()


@pytest.mark.parametrize("name", ["a.pdf", "b.TXT", "c.tar.gz", "d.tgz", "e.unknownext", "f", "g.gz", ".csv", "h.svgz"])
def test_mime_type_is_the_library_guess(one, name):
    guess = mimetypes.MimeTypes(filenames=()).guess_type(name)[0]
    assert one(fx.mime_type(C), x=name) == (guess or "application/octet-stream")


@pytest.mark.parametrize(
    "size, text",
    [(0, "0.0 B"), (1023, "1023.0 B"), (1024, "1.0 KB"), (1280, "1.2 KB"), (1331, "1.3 KB"), (5 * 2**40, "5.0 TB"), (3 * 2**50, "3.0 PB"), (2**62, "4096.0 PB")],
)
def test_readable_sizes(one, size, text):
    assert one(fx.format_bytes(C), x=F.lit(size).cast("long")) == text


def test_sanitize_and_truncate(one):
    assert one(fx.sanitize_filename(C), x='a<b>:"/\\|?*c') == "a_b________c"
    assert one(fx.truncate_text(C, 5), x="abcdef") == "ab..."
    assert one(fx.truncate_text(C, 6), x="abcdef") == "abcdef"
    assert one(fx.truncate_text(C, 2), x="abcdef") == "abcdef"[: 2 - 3] + "..."


def test_split_on_boundary_takes_the_boundary_literally(one):
    assert one(fx.split_on_boundary(C, "."), x=" a . b..\xa0 ") == ["a", "b"]


@pytest.mark.parametrize("text", ["", "  ", "a b", " a\tb\nc ", "x\xa0y", "\x1ca\x85b ", "é ü"])
def test_words_and_strip_are_unicode_aware(one, text):
    assert one(fx.word_count(C), x=text) == len(text.split())
    assert one(fx.words(C), x=text) == text.split()
    assert one(fx.strip(C), x=text) == text.strip()


HEX = "0123456789abcdef0123456789abcdef"


@pytest.mark.parametrize(
    "text", [HEX, "{" + HEX + "}", "urn:uuid:" + HEX, HEX[:8] + "-" + HEX[8:], HEX[:-1], HEX + "0", HEX[:-1] + "g", "", "x" * 32]
)
def test_uuid_forms(one, text):
    try:
        UUID(text)
        valid = True
    except ValueError:
        valid = False
    assert one(fx.is_valid_uuid(C), x=text) is valid


def test_checksums(one):
    import hashlib

    for name in ("md5", "sha1", "sha256", "sha512"):
        assert one(fx.checksum(C, name), x="abc") == hashlib.new(name, b"abc").hexdigest()
    with pytest.raises(ValueError):
        fx.checksum(C, "crc32")


def test_word_counts(one):
    counted = one(fx.word_counts(fx.words(C)), x="b a b c a b")
    assert [tuple(r) for r in counted] == [("a", 2), ("b", 3), ("c", 1)]


def test_pieces_of_a_batch_are_python_objects_a_few_at_a_time():
    import tracemalloc

    import pyarrow as pa

    from quarryline.functions import splitter

    def peak(rows):
        texts = pa.array([None, "", *("word " * 400 + str(i) for i in range(rows))])
        tracemalloc.start()
        found = splitter.split_texts(texts)
        held = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return held, found.to_pylist()

    few, _ = peak(200)
    many, pieces = peak(4000)
    assert many < 2 * few
    assert pieces[:2] == [None, []] and pieces[-1] == splitter.split_text("word " * 400 + "3999")
    assert splitter.split_texts(pa.array([], pa.string())).to_pylist() == []
