"""Attached documents, built here byte by byte."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

from pyspark.sql import functions as F

from lathework.sources import attachments as a


def compound(streams):
    """A small compound file: 512-byte sectors, all streams long enough for them, one storage."""
    names = ["Root Entry", "FileHeader", "BodyText", *[f"Section{i}" for i in range(len(streams) - 1)]]
    bodies = [b.ljust(4096, b"\0") for b in streams]
    data, starts = b"", []
    dirs = 1 if len(names) <= 4 else 2
    fat = [0xFFFFFFFD, *range(2, dirs + 1), 0xFFFFFFFE]
    for b in bodies:
        starts.append(len(fat))
        n = len(b) // 512 + (len(b) % 512 > 0)
        fat += [*range(len(fat) + 1, len(fat) + n), 0xFFFFFFFE]
        data += b.ljust(n * 512, b"\0")
    fat += [0xFFFFFFFF] * (128 - len(fat))
    none = 0xFFFFFFFF

    def entry(name, kind, left, right, child, start, size):
        raw = name.encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw) + 2, kind, 1, left, right, child) + b"\0" * 36 + struct.pack("<IQ", start, size)

    rows = [entry(names[0], 5, none, none, 1, 0xFFFFFFFE, 0), entry(names[1], 2, none, 2, none, starts[0], len(streams[0])), entry(names[2], 1, none, none, 3, 0, 0)]
    for i, s in enumerate(starts[1:]):
        rows.append(entry(names[3 + i], 2, none, 4 + i if i + 2 < len(streams) else none, none, s, len(bodies[1 + i])))
    head = a.MAGIC + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<IIIIIIII", 1, 1, 0, 0, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<109I", 0, *[none] * 108)
    return head + struct.pack("<128I", *fat) + b"".join(rows).ljust(512 * dirs, b"\0") + data


def record(text, tag=67):
    raw = text if isinstance(text, bytes) else text.encode("utf-16-le")
    return struct.pack("<I", tag | (min(len(raw), 0xFFF) << 20)) + (struct.pack("<I", len(raw)) if len(raw) >= 0xFFF else b"") + raw


def hwp():
    header = b"HWP".ljust(36, b"\0") + struct.pack("<I", 1)
    control = struct.pack("<H", 11) + b"\x41\x4e" * 7
    one = record("x", 66) + record("가온".encode("utf-16-le") + control + "기업😀".encode("utf-16-le")) + record("l" * 3000)
    pack = lambda b: zlib.compress(b, wbits=-15)
    return compound([header, pack(one), pack(record("둘째" + chr(30) + "줄\r"))])


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


HWPX = zipped({f"Contents/section{i}.xml": f'<s xmlns:hp="u"><hp:p><hp:t>’26.<hp:fwSpace/>{i}.(목)</hp:t></hp:p><hp:p><hp:t>끝</hp:t></hp:p></s>' for i in (0, 2, 10)})
DOCX = zipped({"word/document.xml": '<w:document xmlns:w="u"><w:body><w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/></w:body></w:document>'})


def test_texts():
    assert a.text_of("hwp", hwp()) == "가온기업😀\n" + "l" * 3000 + "\n둘째 줄"
    assert a.text_of("hwpx", HWPX) == "’26. 0.(목)\n끝\n’26. 2.(목)\n끝\n’26. 10.(목)\n끝"
    assert a.text_of("docx", DOCX) == "one\ttwo\na\tb"


def test_broken_files():
    whole = hwp()
    for kind, data in (("hwp", whole), ("hwpx", HWPX), ("docx", DOCX)):
        for n in range(0, len(data), 97):
            assert isinstance(a.text_of(kind, data[:n]), str | None)
    assert a.text_of("pdf", b"x") is a.text_of(None, b"x") is a.text_of("hwp", None) is None


def test_folder(spark, tmp_path):
    for name, data in {"a.hwp": hwp(), "b.HWPX [178.7 KB]": HWPX, "c.docx": b"broken", "d.txt": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.text and r.text[:2]) for r in a.read_attachments(spark, str(tmp_path)).collect()}
    assert [got[k] for k in sorted(got)] == [("hwp", "가온"), ("hwpx", "’2"), ("docx", None), (None, None)]
    names = spark.createDataFrame([("x.pdf",), ("a.docx.hwpx [1 KB]",), ("x.doc",), (None,)], "n string")
    assert [r[0] for r in names.select(a.file_kind(F.col("n"))).collect()] == ["pdf", "hwpx", None, None]
