"""Text of PDF pages without a PDF library: objects, compressed streams, the page tree, and the text operators of contents.

Reads what most text PDFs hold: plain and object streams, Flate data, simple fonts and fonts with a ToUnicode table.
Encrypted files and other filters give pages without text, which then count as too little native text.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REFERENCE = rb"/%s\s*(\d+)\s+\d+\s+R"
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+.\d]+|[A-Za-z'\"*]+", re.S)
#: Escapes in strings.
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Pdf:
    def __init__(self, raw: bytes):
        self.objects = {int(n): body for n, body in _OBJECT.findall(raw)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body:
                self._unpack(body)
        self.maps: dict[int, dict[bytes, str]] = {}

    def _unpack(self, body: bytes) -> None:
        """Objects that are held in a compressed stream."""
        data, first = self.data(body), re.search(rb"/First\s+(\d+)", body)
        if not first:
            return
        numbers = [int(x) for x in data[: int(first[1])].split()]
        starts = [int(first[1]) + x for x in numbers[1::2]]
        for n, a, b in zip(numbers[::2], starts, [*starts[1:], len(data)]):
            self.objects.setdefault(n, data[a:b])

    def data(self, body: bytes) -> bytes:
        found = _STREAM.search(body)
        if not found:
            return b""
        head, raw = body[: found.start()], found[1]
        if b"FlateDecode" not in head:
            return b"" if b"/Filter" in head else raw
        try:
            return zlib.decompressobj().decompress(raw)
        except zlib.error:
            return b""

    def references(self, body: bytes, name: bytes) -> list[int]:
        """The objects that an entry names, alone or in an array."""
        one = re.search(_REFERENCE % name, body)
        if one:
            held = self.objects.get(int(one[1]), b"").strip()
            return self.references(b"/x " + held, b"x") if held.startswith(b"[") else [int(one[1])]
        many = re.search(rb"/%s\s*\[(.*?)\]" % name, body, re.S)
        return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", many[1])] if many else []

    def pages(self) -> list[int]:
        roots = [n for n, body in self.objects.items() if re.search(rb"/Type\s*/Catalog\b", body)]
        out, seen = [], set()
        wait = [x for n in roots[-1:] for x in self.references(self.objects[n], b"Pages")]
        while wait:
            n = wait.pop(0)
            if n in seen or n not in self.objects:
                continue
            seen.add(n)
            if re.search(rb"/Type\s*/Pages\b", self.objects[n]):
                wait = self.references(self.objects[n], b"Kids") + wait
            else:
                out.append(n)
        return out

    def fonts(self, page: bytes) -> dict[bytes, dict[bytes, str]]:
        """The code tables of a page's fonts by name; its parents' where it has none."""
        held = page
        for _ in range(20):
            linked = re.search(_REFERENCE % b"Resources", held)
            where = held + (self.objects.get(int(linked[1]), b"") if linked else b"")
            font = re.search(_REFERENCE % b"Font", where)
            where = self.objects.get(int(font[1]), b"") if font else (re.search(rb"/Font\s*<<(.*?)>>", where, re.S) or [b"", b""])[1]
            if where:
                return {name: self.codes(int(n)) for name, n in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", where)}
            above = re.search(_REFERENCE % b"Parent", held)
            if not above:
                break
            held = self.objects.get(int(above[1]), b"")
        return {}

    def codes(self, font: int) -> dict[bytes, str]:
        if font not in self.maps:
            table: dict[bytes, str] = {}
            for n in self.references(self.objects.get(font, b""), b"ToUnicode"):
                data = self.data(self.objects.get(n, b""))
                read = lambda x: bytes.fromhex(x.decode()).decode("utf-16-be", "replace")
                for part in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
                    table |= {bytes.fromhex(a.decode()): read(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)}
                for part in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
                    for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
                        base = read(c)
                        for k in range(min(int(b, 16) - int(a, 16) + 1, 1 << 16)):
                            table[(int(a, 16) + k).to_bytes(len(a) // 2, "big")] = base[:-1] + chr(ord(base[-1]) + k)
            self.maps[font] = table
        return self.maps[font]

    def text(self, page: int) -> str:
        body = self.objects[page]
        fonts, table = self.fonts(body), {}
        out: list[str] = []
        held: list[bytes] = []
        for token in _TOKEN.findall(b"\n".join(self.data(self.objects.get(n, b"")) for n in self.references(body, b"Contents"))):
            if token[:1] in b"(<[]/" or token[:1] in b"+-.0123456789":
                held.append(token)
                continue
            if token == b"Tf" and len(held) > 1:
                table = fonts.get(held[-2][1:], {})
            elif token in (b"Tj", b"TJ", b"'", b'"'):
                out += ["\n"] * (token in (b"'", b'"'))
                for x in held:
                    if x[:1] in b"(<":
                        out.append(_string(x, table))
                    elif re.fullmatch(rb"-\d+(?:\.\d*)?", x) and float(x) < -200 and token == b"TJ":
                        out.append(" ")
            elif token in (b"Td", b"TD", b"Tm", b"T*", b"ET"):
                out.append("\n")
            held = []
        return "".join(out)


def _string(token: bytes, table: dict[bytes, str]) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: b"" if m[1] in (b"\n", b"\r\n") else bytes([int(m[1], 8) & 255]) if m[1].isdigit() and int(m[1][:1]) < 8 else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    if table:
        size = max(map(len, table))
        return "".join(table.get(raw[i : i + size], "") for i in range(0, len(raw), size))
    return raw.decode("cp1252", "replace")


def pages(raw: bytes) -> list[str]:
    """The text of each page, in the order of the page tree."""
    pdf = Pdf(raw)
    return [pdf.text(n) for n in pdf.pages()]
