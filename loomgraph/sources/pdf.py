"""Text of PDF files without a library: classic and object-stream files, plain and Flate streams, simple and mapped fonts.

Pages come in the order of the page tree, joined by newlines; a page without text gives an empty line of its own. A line
begins where the text position moves down. What isn't read: encrypted files, other filters, fonts without a map whose
codes aren't Latin.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_TOKEN = re.compile(
    rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+.\d]+|[A-Za-z'\"*]+", re.S
)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r?\n|.)", re.S)
# What the letters after a backslash stand for.
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A gap in an array of strings, in thousandths of the font size, that stands for a space.
GAP = 180


def _literal(raw: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        x = m.group(1)
        if x.isdigit():
            return bytes([int(x, 8) & 255])
        return b"" if x.endswith(b"\n") else _ESCAPES.get(x, x)

    return _ESCAPE.sub(one, raw[1:-1])


class Pdf:
    def __init__(self, data: bytes):
        if not data.startswith(b"%PDF"):
            raise ValueError("not a PDF file")
        if re.search(rb"/Encrypt\b", data):
            raise ValueError("an encrypted PDF file")
        self.objects = {int(n): body for n, body in _OBJECT.findall(data)}
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm\b", body):
                self._unpack(body)
        roots = re.findall(rb"/Root\s+(\d+)", data) or [b"%d" % n for n, b in self.objects.items() if re.search(rb"/Type\s*/Catalog\b", b)]
        if not roots or int(roots[-1]) not in self.objects:
            raise ValueError("a PDF file without a catalog")
        self.root = self.objects[int(roots[-1])]

    def _unpack(self, body: bytes) -> None:
        raw = self.stream(body)
        n, first = (int(re.search(rb"/%s\s+(\d+)" % k, body).group(1)) for k in (b"N", b"First"))
        heads = list(map(int, raw[:first].split()[: 2 * n]))
        for i in range(n):
            end = heads[2 * i + 3] if i + 1 < n else len(raw) - first
            self.objects.setdefault(heads[2 * i], raw[first + heads[2 * i + 1] : first + end])

    def stream(self, body: bytes) -> bytes:
        m = _STREAM.search(body)
        if not m:
            return b""
        named = re.search(rb"/Filter\s*(?:\[(.*?)\]|(/\w+))", body[: m.start()], re.S)
        filters = re.findall(rb"/(\w+)", named.group(1) or named.group(2) or b"") if named else []
        if filters in ([b"FlateDecode"], [b"Fl"]):
            return zlib.decompressobj().decompress(m.group(1))
        if filters:
            raise ValueError(f"a PDF stream behind {', '.join(f.decode() for f in filters)}, which can't be read")
        return m.group(1)

    def referred(self, body: bytes, key: bytes) -> list[int]:
        """The objects that a key names: one, or those of an array."""
        m = re.search(rb"/%s\s*(?:(\d+)\s+\d+\s+R|\[(.*?)\])" % key, body, re.S)
        if not m:
            return []
        return [int(m.group(1))] if m.group(1) else [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m.group(2))]

    def pages(self) -> list[bytes]:
        out: list[bytes] = []
        seen: set[int] = set()

        def walk(n: int) -> None:
            body = self.objects.get(n, b"")
            if n in seen:
                return
            seen.add(n)
            if re.search(rb"/Kids\b", body):
                for kid in self.referred(body, b"Kids"):
                    walk(kid)
            elif body:
                out.append(body)

        for n in self.referred(self.root, b"Pages"):
            walk(n)
        return out

    def fonts(self, page: bytes) -> dict[bytes, dict[int, str]]:
        """Of each font with a map, text by code; codes of two bytes are above 65535."""
        resources = page + b"".join(self.objects.get(n, b"") for n in self.referred(page, b"Resources"))
        resources += b"".join(self.objects.get(n, b"") for n in self.referred(resources, b"Font"))
        out = {}
        for name, n in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", resources):
            for ref in self.referred(self.objects.get(int(n), b""), b"ToUnicode"):
                out[name] = cmap(self.stream(self.objects.get(ref, b"")))
        return out

    def text(self) -> str:
        return "\n".join(page_text(b"\n".join(self.stream(self.objects.get(n, b"")) for n in self.referred(p, b"Contents")), self.fonts(p)) for p in self.pages())


def cmap(raw: bytes) -> dict[int, str]:
    """Text by code of a ToUnicode map; key 0x10000 is set if codes have two bytes."""
    out: dict[int, str] = {}
    said = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    wide = False
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", raw, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[int(a, 16)], wide = said(b), wide or len(a) > 2
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", raw, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            first, wide = said(c), wide or len(a) > 2
            for i in range(int(a, 16), min(int(b, 16), int(a, 16) + 0xFFFF) + 1):
                out[i] = first[:-1] + chr(ord(first[-1]) + i - int(a, 16)) if first else ""
    if wide:
        out[0x10000] = ""
    return out


def page_text(content: bytes, fonts: dict[bytes, dict[int, str]]) -> str:
    """The strings that a content stream shows, with new lines where the position moves down."""
    out: list[str] = []
    stack: list = []
    font: dict[int, str] = {}

    def show(token: bytes) -> None:
        raw = bytes.fromhex((x := re.sub(rb"\s", b"", token[1:-1]).decode()) + "0" * (len(x) % 2)) if token[:1] == b"<" else _literal(token)
        if not font:
            out.append(raw.decode("cp1252", "replace"))
        elif 0x10000 in font:
            out.append("".join(font.get(int.from_bytes(raw[i : i + 2], "big"), "") for i in range(0, len(raw), 2)))
        else:
            out.append("".join(font.get(b, chr(b)) for b in raw))

    def line() -> None:
        if out and out[-1] != "\n":
            out.append("\n")

    for m in _TOKEN.finditer(content):
        token = m.group()
        if token[:1] in (b"(", b"<", b"[", b"]", b"/") or re.fullmatch(rb"[-+.\d]+", token):
            stack.append(token)
            continue
        if token == b"Tf":
            font = next((fonts.get(x[1:], {}) for x in reversed(stack) if x[:1] == b"/"), {})
        elif token in (b"Tj", b"'", b'"', b"TJ"):
            if token in (b"'", b'"'):
                line()
            for x in stack:
                if x[:1] in (b"(", b"<"):
                    show(x)
                elif token == b"TJ" and re.fullmatch(rb"[-+]?\d*\.?\d+", x) and float(x) < -GAP and out and not out[-1].endswith((" ", "\n")):
                    out.append(" ")
        elif token == b"T*" or (token in (b"Td", b"TD") and len(stack) > 1 and _number(stack[-1]) != 0) or token in (b"Tm", b"BT"):
            line()
        stack.clear()
    return "".join(out).strip("\n")


def _number(token: bytes) -> float:
    try:
        return float(token)
    except ValueError:
        return 0.0
