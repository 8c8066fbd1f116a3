"""Images by their headers: size, EXIF of JPEG, text chunks of PNG.  OCR and QR codes are seams."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

# EXIF tags that hold text, and the largest image.
EXIF_TAGS = {
    0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0131: "Software", 0x013B: "Artist", 0x8298: "Copyright",
    0x9286: "UserComment", 0x9C9B: "XPTitle", 0x9C9C: "XPComment", 0x9C9D: "XPAuthor", 0x9C9E: "XPKeywords", 0x9C9F: "XPSubject",
}
MOST_PIXELS = 25_000_000
MOST_TEXT = 1 << 20

#: Seams: bytes to text, bytes to payloads, and a PDF's bytes to an image of each page; without a library nothing
#: is read.
ocr: Callable[[bytes], str] = lambda content: ""
qr_codes: Callable[[bytes], list[str]] = lambda content: []
pages: Callable[[bytes], list[bytes]] = lambda content: []


def png_chunks(content: bytes):
    at = 8
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        yield kind, content[at + 8 : at + 8 + size]
        at += 12 + size


def _inflate(data: bytes) -> bytes:
    unpack = zlib.decompressobj()
    out = unpack.decompress(data, MOST_TEXT)
    if unpack.unconsumed_tail or unpack.decompress(b"", 1):
        raise ValueError("too much compressed text")
    return out


def png(content: bytes) -> tuple[int, int, dict[str, str]]:
    width = height = 0
    found: dict[str, str] = {}
    for kind, data in png_chunks(content):
        if kind == b"IHDR":
            width, height = struct.unpack(">II", data[:8])
        elif kind in (b"tEXt", b"zTXt", b"iTXt"):
            key, _, rest = data.partition(b"\0")
            if kind == b"tEXt":
                text = rest.decode("latin-1")
            elif kind == b"zTXt":
                text = _inflate(rest[1:]).decode("latin-1")
            else:
                packed, body = rest[0], rest[2:].split(b"\0", 2)[2]
                text = (_inflate(body) if packed else body).decode("utf-8", "replace")
            if text.strip():
                found[key.decode("latin-1")] = text.strip()
    return width, height, found


def exif(data: bytes) -> dict[str, str]:
    """Text tags of a TIFF block, those of the Exif directory included."""
    order = "<" if data[:2] == b"II" else ">"
    found: dict[str, str] = {}
    todo, seen = [struct.unpack(order + "I", data[4:8])[0]], set()
    while todo:
        at = todo.pop()
        if at in seen or at + 2 > len(data):
            continue
        seen.add(at)
        for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
            entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
            if len(entry) < 12:
                break
            tag, kind, count = struct.unpack(order + "HHI", entry[:8])
            if tag == 0x8769:
                todo.append(struct.unpack(order + "I", entry[8:])[0])
            elif tag in EXIF_TAGS and kind in (1, 2, 7):
                start = struct.unpack(order + "I", entry[8:])[0]
                raw = entry[8 : 8 + count] if count <= 4 else data[start : start + count]
                text = raw.split(b"\0")[0].decode("utf-8", "replace") if kind == 2 else raw.decode("utf-16-le", "replace").rstrip("\0")
                if text.strip():
                    found[EXIF_TAGS[tag]] = text.strip()
    return found


def jpeg(content: bytes) -> tuple[int, int, dict[str, str]]:
    at, width, height, found = 2, 0, 0, {}
    while at + 4 <= len(content) and content[at] == 0xFF:
        mark, size = content[at + 1], struct.unpack(">H", content[at + 2 : at + 4])[0]
        body = content[at + 4 : at + 2 + size]
        if mark == 0xE1 and body.startswith(b"Exif\0\0"):
            found = exif(body[6:])
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", body[1:5])
        if mark == 0xDA:
            break
        at += 2 + size
    return width, height, found


def size(content: bytes) -> tuple[int, int]:
    """Width and height by the header of a PNG, JPEG or GIF; zeros for others."""
    try:
        if content[:4] == b"\x89PNG":
            return png(content)[:2]
        if content[:2] == b"\xff\xd8":
            return jpeg(content)[:2]
        if content[:3] == b"GIF":
            return struct.unpack("<HH", content[6:10])
    except (struct.error, IndexError, zlib.error):
        pass
    return 0, 0


def extract(content: bytes) -> dict:
    """What an image shows counts as visible text and as an ocr_only hidden entry, as both are read."""
    width, height, found = png(content) if content[:4] == b"\x89PNG" else jpeg(content)
    if width * height > MOST_PIXELS:
        raise ValueError("image too large")
    hidden = [{"location": "image", "content": x, "method": "qr_code"} for x in qr_codes(content)]
    if text := ocr(content).strip():
        hidden.append({"location": "image", "content": text, "method": "ocr_only"})
    return {"visible_text": text, "ocr_text": text, "hidden_text": hidden, "metadata": [{"key": k, "value": v} for k, v in found.items()]}
