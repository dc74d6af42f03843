"""Text of attached documents, read as binary files by Spark and opened inside tasks.

A file that is broken or of another kind has a null text; it never fails the job. PDF needs a library that is not assumed.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the compound file and of the records within.
MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
END, FREE, PARAGRAPH = 0xFFFFFFFE, 0xFFFFFFFF, 67
#: Control codes that take eight characters' place, and those that stand for one.
WIDE, PLAIN = {*range(1, 10), 11, 12, *range(14, 24)}, {9: "\t", 10: "\n", 13: "\n", 24: "-", 30: " ", 31: " "}
INLINE = {"lineBreak": "\n", "tab": "\t", "fwSpace": " ", "nbSpace": " ", "hwpSpace": " "}


def file_kind(name: Column) -> Column:
    """hwp, hwpx, pdf or docx by the last such ending in a name, which a size may follow; null for others."""
    return F.try_element_at(F.regexp_extract_all(F.lower(name), F.lit(r"\.(hwpx?|pdf|docx)\b"), 1), F.lit(-1))


def compound_streams(data: bytes) -> dict[str, bytes]:
    """The streams of a compound file by path."""
    if data[:8] != MAGIC:
        raise ValueError("no compound file")
    shift, small_shift = struct.unpack_from("<HH", data, 30)
    n_fat, first_dir, _, cutoff, first_small, _, first_difat, n_difat = struct.unpack_from("<I I I I I I I I", data, 44)
    size = 1 << shift
    sector = lambda i: data[(i + 1) * size : (i + 2) * size]
    words = lambda b: struct.unpack(f"<{len(b) // 4}I", b[: len(b) // 4 * 4])
    listed = list(words(data[76:512]))
    for _ in range(n_difat):
        if first_difat >= END:
            break
        *more, first_difat = words(sector(first_difat))
        listed += more
    fat = [x for i in listed[:n_fat] if i < END for x in words(sector(i))]

    def chain(at: int, table: list[int], read) -> bytes:
        parts, seen = [], 0
        while at < END and seen <= len(table):
            parts.append(read(at))
            at, seen = table[at], seen + 1
        return b"".join(parts)

    table = list(words(chain(first_small, fat, sector))) if first_small < END else []
    entries = chain(first_dir, fat, sector)
    nodes = []
    for at in range(0, len(entries) - 127, 128):
        length, kind, _, left, right, child = struct.unpack_from("<HBBIII", entries, at + 64)
        start, total = struct.unpack_from("<IQ", entries, at + 116)
        nodes.append((entries[at : at + max(length - 2, 0)].decode("utf-16-le", "replace"), kind, left, right, child, start, total))
    ministream = chain(nodes[0][5], fat, sector)
    small = 1 << small_shift
    found: dict[str, bytes] = {}
    todo = [(nodes[0][4], "")]
    while todo and len(found) <= len(nodes):
        i, above = todo.pop()
        if i >= len(nodes):
            continue
        name, kind, left, right, child, start, total = nodes[i]
        todo += [(left, above), (right, above)]
        if kind == 1:
            todo.append((child, f"{above}{name}/"))
        elif kind == 2:
            body = chain(start, table, lambda k: ministream[k * small : (k + 1) * small]) if total < cutoff else chain(start, fat, sector)
            found[above + name] = body[:total]
    return found


def _paragraph(record: bytes) -> str:
    out, at = [], 0
    units = struct.unpack(f"<{len(record) // 2}H", record[: len(record) // 2 * 2])
    while at < len(units):
        code = units[at]
        at += 8 if code in WIDE else 1
        if at > len(units):
            break
        out.append(struct.pack("<H", code).decode("utf-16-le", "surrogatepass") if code >= 32 else PLAIN.get(code, ""))
    return "".join(out).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _records(body: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 4 <= len(body):
        (head,) = struct.unpack_from("<I", body, at)
        at, size = at + 4, head >> 20
        if size == 0xFFF:
            if at + 4 > len(body):
                return
            (size,) = struct.unpack_from("<I", body, at)
            at += 4
        if at + size > len(body):
            return
        yield head & 0x3FF, body[at : at + size]
        at += size


def _lines(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", text.strip())


def hwp_text(data: bytes) -> str:
    streams = compound_streams(data)
    packed = struct.unpack_from("<I", streams.get("FileHeader", b"").ljust(40, b"\x01"), 36)[0] & 1
    numbers = sorted(int(m[1]) for name in streams if (m := re.fullmatch(r"BodyText/Section(\d+)", name)))
    out = []
    for n in numbers:
        body = streams[f"BodyText/Section{n}"]
        try:
            body = zlib.decompressobj(-15).decompress(body) if packed else body
        except zlib.error:
            continue
        out += [t for tag, record in _records(body) if tag == PARAGRAPH and (t := _lines(_paragraph(record)))]
    return "\n".join(out)


def _local(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def hwpx_text(data: bytes) -> str:
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        sections = [n for n in z.namelist() if re.search(r"section\d+\.xml$", n, re.IGNORECASE)]
        for name in sorted(sections, key=lambda n: (len(n), n)):
            text = []
            for e in ElementTree.fromstring(z.read(name)).iter():
                if _local(e) == "t":
                    text += [e.text or "", *(s for c in e for s in (INLINE.get(_local(c), ""), c.tail or ""))]
                elif _local(e) in ("p", "subList"):
                    text.append("\n")
            out.append(_lines("".join(text)))
    return "\n".join(x for x in out if x)


def docx_text(data: bytes) -> str:
    """Paragraphs, then table rows with cells between tabs."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(e for e in ElementTree.fromstring(z.read("word/document.xml")) if _local(e) == "body")
    marks = {"tab": "\t", "br": "\n", "cr": "\n"}
    said = lambda e: "".join(x.text or "" if _local(x) == "t" else marks.get(_local(x), "") for x in e.iter())
    out = [t for e in body if _local(e) == "p" and (t := said(e)).strip()]
    for table in (e for e in body if _local(e) == "tbl"):
        out += ["\t".join("\n".join(said(p) for p in c if _local(p) == "p") for c in row if _local(c) == "tc") for row in table if _local(row) == "tr"]
    return "\n".join(out).strip()


READERS = {"hwp": hwp_text, "hwpx": hwpx_text, "docx": docx_text}


def text_of(kind: str | None, data: bytes | None) -> str | None:
    if kind not in READERS or not data:
        return None
    try:
        return READERS[kind](bytes(data))
    except (ValueError, KeyError, IndexError, StopIteration, struct.error, zipfile.BadZipFile, ElementTree.ParseError, zlib.error, NotImplementedError, RuntimeError):
        return None


@F.pandas_udf(StringType())
def attachment_text(kinds: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([text_of(k, d) for k, d in zip(kinds, data, strict=True)], dtype=object)


def read_attachments(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, text) of the documents below a folder. Few rows a batch, since one may be large."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", file_kind(F.col("path")).alias("kind"), "content").select("path", "kind", attachment_text("kind", "content").alias("text"))
