"""Text layer of PDF files: pages in order, the strings of their content streams, decoded by the fonts' maps.

A reader for files of the usual kind: objects and object streams found by scanning, streams plain, deflated or in hexadecimal. An
encrypted or broken file is an error; a file without any text has none. Nothing is recognised from images.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)endobj", re.S)
STREAM = re.compile(rb"(.*?)stream\r?\n(.*?)\r?\n?endstream", re.S)
REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R")
TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*][A-Za-z0-9*]*", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: Units of a thousandth of the font size, taken back between two strings, from which the gap counts as a space.
GAP = 200


class BrokenPdf(ValueError):
    """A file that is encrypted or can't be taken apart."""


@dataclass
class _Font:
    codes: dict[int, str] = field(default_factory=dict)
    width: int = 1

    def text(self, raw: bytes) -> str:
        """Characters of a string of codes; without a map they are those of Windows' Latin."""
        if not self.codes:
            return raw.decode("cp1252", "replace")
        numbers = (int.from_bytes(raw[i : i + self.width], "big") for i in range(0, len(raw) - self.width + 1, self.width))
        return "".join(self.codes.get(n, "") for n in numbers)


def _stream(body: bytes) -> bytes:
    m = STREAM.match(body)
    if not m:
        return b""
    data = m[2]
    for kind in re.findall(rb"/(FlateDecode|ASCIIHexDecode|LZWDecode|DCTDecode|ASCII85Decode)", m[1]):
        try:
            if kind == b"FlateDecode":
                data = zlib.decompressobj().decompress(data)
            elif kind == b"ASCIIHexDecode":
                data = bytes.fromhex(re.sub(rb"[\s>]", b"", data).decode())
            else:
                return b""
        except (zlib.error, ValueError) as problem:
            raise BrokenPdf("a stream can't be decoded") from problem
    return data


def _objects(data: bytes) -> dict[int, bytes]:
    found = {int(m[1]): m[2] for m in OBJECT.finditer(data)}
    for body in list(found.values()):
        if b"/ObjStm" in body.split(b"stream", 1)[0]:
            inside = _stream(body)
            first = int(re.search(rb"/First\s+(\d+)", body)[1])
            numbers = list(map(int, inside[:first].split()))
            ends = [first + at for at in numbers[1::2]] + [len(inside)]
            for number, start, end in zip(numbers[::2], ends, ends[1:]):
                found.setdefault(number, inside[start:end])
    return found


def _value(body: bytes, name: bytes, objects: dict[int, bytes]) -> bytes:
    """What stands behind a name in a dictionary: a reference's object, a nested dictionary or array, or a plain value."""
    m = re.search(rb"/" + name + rb"(?![A-Za-z])\s*", body)
    if not m:
        return b""
    rest = body[m.end() :]
    if ref := REFERENCE.match(rest):
        return objects.get(int(ref[1]), b"")
    for start, end in ((b"<<", b">>"), (b"[", b"]")):
        if rest.startswith(start):
            depth = 0
            for t in re.finditer(re.escape(start) + b"|" + re.escape(end), rest):
                depth += 1 if t[0] == start else -1
                if not depth:
                    return rest[: t.end()]
    plain = re.match(rb"/?[^\s/<>\[\]]+", rest)
    return plain[0] if plain else b""


def _pages(node: bytes, objects: dict[int, bytes], given: bytes, seen: set[int]) -> list[tuple[bytes, bytes]]:
    """(page, resources) of the tree below a node, in order."""
    resources = _value(node, b"Resources", objects) or given
    kids = _value(node, b"Kids", objects)
    if not kids:
        return [(node, resources)]
    out = []
    for m in REFERENCE.finditer(kids):
        if int(m[1]) not in seen:
            seen.add(int(m[1]))
            out += _pages(objects.get(int(m[1]), b""), objects, resources, seen)
    return out


def _font(body: bytes, objects: dict[int, bytes]) -> _Font:
    cmap = _stream(_value(body, b"ToUnicode", objects))
    codes, width = {}, 1
    text = lambda h: bytes.fromhex(re.sub(rb"\s", b"", h).decode()).decode("utf-16-be", "replace")
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for a, b in re.findall(rb"<([^>]*)>\s*<([^>]*)>", part):
            codes[int(a, 16)], width = text(b), max(width, len(a) // 2)
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, c, many in re.findall(rb"<([^>]*)>\s*<([^>]*)>\s*(?:<([^>]*)>|\[(.*?)\])", part, re.S):
            low, high, width = int(a, 16), int(b, 16), max(width, len(a) // 2)
            shown = [text(h) for h in re.findall(rb"<([^>]*)>", many)] if many else []
            for i in range(min(high - low + 1, 0x10000)):
                if shown:
                    codes[low + i] = shown[min(i, len(shown) - 1)]
                else:
                    codes[low + i] = text(c)[:-1] + chr(ord(text(c)[-1]) + i)
    return _Font(codes, width)


def _string(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"[\s<>]", b"", token)
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    plain = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else ESCAPES.get(m[1], b"" if m[1] in b"\r\n" else m[1])
    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", plain, token[1:-1], flags=re.S)


def _content_text(content: bytes, fonts: dict[bytes, _Font]) -> str:
    """Strings shown, with line ends where the position moves down and spaces where it moves on."""
    out: list[str] = []
    font, operands = _Font(), []

    def line() -> None:
        if out and out[-1] != "\n":
            out.append("\n")

    for m in TOKEN.finditer(content):
        token = m[0]
        if not (token[:1].isalpha() or token in (b"'", b'"', b"T*")):
            operands.append(token)
            continue
        if token == b"Tf" and len(operands) > 1:
            font = fonts.get(operands[-2][1:], _Font())
        elif token in (b"T*", b"'", b'"', b"BT", b"Tm"):
            line()
        elif token in (b"Td", b"TD") and len(operands) > 1:
            if float(operands[-1]):
                line()
            elif out and not out[-1].endswith((" ", "\n")):
                out.append(" ")
        if token in (b"Tj", b"TJ", b"'", b'"'):
            for part in operands:
                if part[:1] in b"(<":
                    out.append(font.text(_string(part)))
                elif token == b"TJ" and part not in (b"[", b"]") and part[:1] != b"/" and float(part) < -GAP:
                    out.append(" ")
        operands = []
    return "".join(out).strip()


def page_texts(data: bytes) -> list[str]:
    """Text of every page, in order; an empty string for a page without."""
    if not data.startswith(b"%PDF-") or re.search(rb"/Encrypt\s", data):
        raise BrokenPdf("no PDF, or an encrypted one")
    try:
        objects = _objects(data)
        roots = [b for b in objects.values() if re.search(rb"/Type\s*/Catalog\b", b)]
        if not roots:
            raise BrokenPdf("no catalog")
        out = []
        for page, resources in _pages(_value(roots[-1], b"Pages", objects), objects, b"", set()):
            fonts = _value(resources, b"Font", objects)
            known = {m[1]: _font(objects.get(int(m[2]), b""), objects) for m in re.finditer(rb"/([^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R", fonts)}
            held = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
            parts = [_stream(objects.get(int(r[1]), b"")) for r in REFERENCE.finditer(held[1])] if held else []
            out.append(_content_text(b"\n".join(parts), known))
        return out
    except BrokenPdf:
        raise
    except (ValueError, IndexError, TypeError, RecursionError) as problem:
        raise BrokenPdf("the file can't be taken apart") from problem
