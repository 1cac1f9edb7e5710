import zlib

import pytest

from lectern.sources.files import parse_files
from lectern.sources.pdf import BrokenPdf, page_texts

CMAP = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0001> <0633> endbfchar 2 beginbfrange <0002> <0003> <0061> <0004> <0005> [<0644> <fb01>] endbfrange"


def _pdf(contents, fonts=b"<< /F1 10 0 R /F2 11 0 R >>", extra=b"", packed=True):
    objects = [b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj", b"10 0 obj << /Type /Font /BaseFont /Helvetica >> endobj"]
    objects += [b"11 0 obj << /Type /Font /Subtype /Type0 /ToUnicode 12 0 R >> endobj", b"12 0 obj << /Length 0 >> stream\n" + CMAP + b"\nendstream endobj"]
    kids = b" ".join(b"%d 0 R" % (20 + i) for i in range(len(contents)))
    objects.append(b"2 0 obj << /Type /Pages /Kids [" + kids + b"] /Resources << /Font " + fonts + b" >> >> endobj")
    for i, content in enumerate(contents):
        objects.append(b"%d 0 obj << /Type /Page /Parent 2 0 R /Contents %d 0 R >> endobj" % (20 + i, 40 + i))
        body = zlib.compress(content) if packed else content
        head = b"/Filter /FlateDecode" if packed else b""
        objects.append(b"%d 0 obj << %s /Length %d >> stream\n" % (40 + i, head, len(body)) + body + b"\nendstream endobj")
    return b"%PDF-1.7\n" + b"\n".join(objects) + extra + b"\ntrailer << /Root 1 0 R >>"


ONE = rb"BT /F1 12 Tf 72 700 Td (Hello \(big\) w\157rld) Tj 0 -14 Td [(Sec) -20 (ond) -300 (line)] TJ T* (third) Tj ET"
TWO = rb"BT /F2 12 Tf <000100020003> Tj 5 0 Td <00040005> Tj ET"


@pytest.mark.parametrize("packed", [True, False])
def test_pages_in_order(packed):
    assert page_texts(_pdf([ONE, b"", TWO], packed=packed)) == ["Hello (big) world\nSecond line\nthird", "", "سab لﬁ"]


def test_object_streams():
    inside = b"1 0 2 49 " + b"<< /Type /Catalog /Pages 2 0 R >>".ljust(49) + b"<< /Kids [3 0 R] >>"
    packed = zlib.compress(inside)
    data = b"%PDF-1.5\n9 0 obj << /Type /ObjStm /N 2 /First 9 /Filter /FlateDecode >> stream\n" + packed + b"\nendstream endobj\n"
    data += b"3 0 obj << /Type /Page /Contents [4 0 R] >> endobj 4 0 obj << >> stream\nBT (x) Tj ET\nendstream endobj"
    assert page_texts(data) == ["x"]


def test_broken_and_encrypted_files():
    for data in (b"", b"%PDF-1.7", _pdf([ONE]).replace(b"/Root", b"/Encrypt 5 0 R /Root"), _pdf([ONE]).replace(zlib.compress(ONE), b"junk")):
        with pytest.raises(BrokenPdf):
            page_texts(data)


def test_files(spark):
    rows = [("a.pdf", _pdf([TWO, ONE])), ("scan.pdf", _pdf([b"q 1 0 0 1 0 0 cm /Im1 Do Q"])), ("bad.pdf", b"%PDF-1.7 x")]
    got = {r.filename: r for r in parse_files(spark.createDataFrame([(n, bytearray(d)) for n, d in rows], "filename string, content binary")).collect()}
    assert {k: v.error_code for k, v in got.items()} == {"a.pdf": None, "scan.pdf": "NO_TEXT_LAYER", "bad.pdf": "PARSE_ERROR"}
    assert got["a.pdf"].text == "سab لfi\nHello (big) world\nSecond line\nthird"
    assert [(s.page_start, s.section_path) for s in got["a.pdf"].sections] == [(1, ["a", "page 1"]), (2, ["a", "page 2"])]
