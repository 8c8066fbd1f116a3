"""PDF as far as the standard library goes: content streams, plain or deflated, dictionaries and object streams.

A content stream's operators are followed with their graphics state, so that text is told apart by how it is
drawn.  Fonts with encodings of their own, encrypted files, layers and rendering need a library;
`spans.classify_spans` takes such a library's spans as a table.
"""

from __future__ import annotations

import re
import zlib

from inkwarden.sources import image
from inkwarden.sources.spans import LEAST_ALPHA, WHITE

# Fixed value: the most pages.
MOST_PAGES = 500
MOST_STREAM = 1 << 26

_STREAM = re.compile(rb"<<(.{0,4096}?)>>\s*stream\r?\n(.*?)\r?\nendstream", re.DOTALL)
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|[\[\]]|/[^\s/\[\]()<>]*|[^\s/\[\]()<>]+", re.DOTALL)
_DRAWS = re.compile(rb"[\])>]\s*(?:T[jJ]|['\"])(?:\s|$)")
_BOX = re.compile(rb"/MediaBox\s*\[\s*([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s*\]")
# In an array of strings, a step back by more than this many thousandths of the font's size parts words.
_WORD_STEP = -200
_STRING = rb"\s*(\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>)"
_INFO = re.compile(rb"/(Title|Author|Subject|Keywords|Creator|Producer|CreationDate|ModDate)" + _STRING, re.DOTALL)
_SCRIPT = re.compile(rb"/JS" + _STRING, re.DOTALL)
_XMP = re.compile(rb"<x:xmpmeta.*?</x:xmpmeta>", re.DOTALL)
_OBJECT = re.compile(rb"\bobj\b(.{0,65536}?)\bendobj\b", re.DOTALL)
_OUTLINE, _CONTENTS, _NAME, _VALUE = (re.compile(rb"/" + k + _STRING, re.DOTALL) for k in (b"Title", b"Contents", b"T", b"V"))
_STATES = re.compile(rb"/ExtGState\s*<<((?:<<.*?>>|[^<>])*)>>", re.DOTALL)
_STATE = re.compile(rb"/([^\s/\[\]()<>]+)\s*(?:<<(.*?)>>|(\d+)\s+\d+\s+R)", re.DOTALL)
_OPACITY = re.compile(rb"/ca\s+([\d.]+)")
_KEYS = {"CreationDate": "creationDate", "ModDate": "modDate"}


def _escaped(m: re.Match) -> bytes:
    code = m[1]
    return bytes([int(code, 8) & 255]) if code.isdigit() else {b"n": b"\n", b"r": b"\r", b"\n": b""}.get(code, code)


def _raw(token: bytes) -> bytes:
    """The bytes of a string in parentheses, escapes resolved, or of one in hexadecimal digits."""
    if token[:1] == b"(":
        return re.sub(rb"\\([0-7]{1,3}|.)", _escaped, token[1:-1], flags=re.DOTALL)
    digits = re.sub(rb"\s", b"", token[1:-1])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def text_of(token: bytes) -> str:
    """A dictionary's text string: UTF-16 or UTF-8 by its mark, else one byte a character."""
    raw = _raw(token)
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    return raw[3:].decode("utf-8", "replace") if raw[:3] == b"\xef\xbb\xbf" else raw.decode("latin-1")


def _bodies(content: bytes) -> list[tuple[bytes, bytes]]:
    """(dictionary, decoded body) of all streams that are plain or deflated."""
    out = []
    for head, body in _STREAM.findall(content):
        if b"/FlateDecode" in head:
            try:
                unpack = zlib.decompressobj()
                body = unpack.decompress(body, MOST_STREAM)
                more = unpack.unconsumed_tail or unpack.decompress(b"", 1)
            except zlib.error:
                continue
            if more:
                raise ValueError("too large a stream")
        elif b"/Filter" in head:
            continue
        out.append((head, body))
    return out


def streams(content: bytes) -> list[bytes]:
    return [body for _, body in _bodies(content)]


def unpacked(content: bytes) -> bytes:
    """content, and after it the objects of its object streams as if they stood by themselves."""
    out = [content]
    for head, body in _bodies(content):
        first = re.search(rb"/First\s+(\d+)", head)
        if b"/ObjStm" not in head or not first:
            continue
        at = int(first[1])
        numbers = [int(x) for x in body[:at].split() if x.isdigit()]
        starts = [at + x for x in numbers[1::2]]
        for number, start, end in zip(numbers[::2], starts, [*starts[1:], len(body)], strict=False):
            out.append(b"%d 0 obj\n%s\nendobj" % (number, body[start:end]))
    return b"\n".join(out)


def opacities(content: bytes) -> dict[bytes, float]:
    """Name of a graphics state to its fill opacity; a name that stands for several is left out."""
    found: dict[bytes, set[float]] = {}
    for states in _STATES.findall(content):
        for name, own, number in _STATE.findall(states):
            body = re.search(rb"\b%s\s+\d+\s+obj\b(.*?)\bendobj\b" % number, content, re.DOTALL) if number else None
            if alpha := _OPACITY.search(body[1] if body else own):
                found.setdefault(name, set()).add(_number(alpha[1]))
    return {name: alphas.pop() for name, alphas in found.items() if len(alphas) == 1}


def _number(token: bytes) -> float:
    try:
        return float(token)
    except ValueError:
        return 0.0


def _string(token: bytes) -> str:
    raw = _raw(token)
    # Two-byte codes are taken for UTF-16, which most subsets of one plane's letters agree with.
    wide = token[:1] == b"<" and raw[:1] in (b"\0", b"\xfe") and len(raw) % 2 == 0
    return raw.decode("utf-16-be", "replace").lstrip("\ufeff") if wide else raw.decode("latin-1")


def _joined(items: list) -> str:
    """Text of an array of strings and steps."""
    return "".join((" " if x < _WORD_STEP else "") if isinstance(x, float) else _string(x) for x in items)


def _white(color: list[float]) -> bool:
    if len(color) == 4:  # cyan, magenta, yellow, black
        color = [(1 - c) * (1 - color[3]) for c in color[:3]]
    return bool(color) and all(abs(c - 1) <= WHITE for c in color)


def drawn(stream: bytes, box: tuple[float, float, float, float] | None = None, alphas: dict[bytes, float] | None = None) -> tuple[list[tuple[str | float, str]], list[list[str]]]:
    """((method, text) of all text outside of clips without area, texts of each block with such a clip).

    method is 'visible' or how the text is hidden, by the order of spans.span_method.  Text that a block draws before
    its clip is drawn, and is reported with the block too.  Positions count only where the page isn't transformed.
    Text of too little opacity has its opacity in place of a method.
    """
    state = {"size": 12.0, "render": 0, "color": [0.0], "moved": False, "clip": None, "alpha": 1.0}
    levels: list[tuple[dict, list[str]]] = []
    own: list[str] = []  # texts that this level has drawn
    out, clipped = [], []
    operands: list = []
    array: list | None = None
    rect = None
    x = y = scale = 0.0

    def show(text: str) -> None:
        if not (text := text.strip()):
            return
        own.append(text)
        if state["clip"] is not None:
            state["clip"].append(text)
            return
        inside = box is None or state["moved"] or box[0] <= x <= box[2] and box[1] <= y <= box[3]
        size = state["size"] * (scale or 1.0)
        method = (
            "zero_font" if abs(size) < 1 and size else "invisible_render" if state["render"] == 3 else "clip_render" if state["render"] == 7
            else "off_page" if not inside else state["alpha"] if state["alpha"] < LEAST_ALPHA else "color_match" if _white(state["color"]) else "visible"
        )
        out.append((method, text))

    for match in _TOKEN.finditer(stream):
        token = match[0]
        first = token[:1]
        if token == b"[":
            array = []
        elif token == b"]":
            operands.append(array or [])
            array = None
        elif first in (b"(", b"<") and token not in (b"<<", b">>"):
            (operands if array is None else array).append(token)
        elif first == b"/" or first in b"+-.0123456789" or token in (b"<<", b">>"):
            value = token if first in (b"/", b"<", b">") else _number(token)
            if array is None:
                operands.append(value)
            elif isinstance(value, float):
                array.append(value)
        else:
            numbers = [v for v in operands if isinstance(v, float)]
            last = operands[-1] if operands else None
            if token == b"q":
                levels.append((dict(state), own))
                own = []
            elif token == b"Q" and levels:
                state, own = levels.pop()
            elif token == b"cm":
                state["moved"] = True
            elif token == b"re" and len(numbers) >= 4:
                rect = numbers[-4:]
            elif token in (b"W", b"W*"):
                if rect is not None and rect[2] == rect[3] == 0 and state["clip"] is None:
                    state["clip"] = list(own)
                    clipped.append(state["clip"])
            elif token in (b"n", b"f", b"F", b"f*", b"S", b"s", b"B", b"B*", b"b", b"b*"):
                rect = None
            elif token == b"BT":
                x = y = scale = 0.0
            elif token in (b"Td", b"TD") and len(numbers) >= 2:
                x, y = x + numbers[-2], y + numbers[-1]
            elif token == b"Tm" and len(numbers) >= 6:
                x, y = numbers[-2:]
                scale = (numbers[-4] ** 2 + numbers[-3] ** 2) ** 0.5
            elif token == b"Tf" and numbers:
                state["size"] = numbers[-1]
            elif token == b"gs" and isinstance(last, bytes):
                state["alpha"] = (alphas or {}).get(last[1:], 1.0)
            elif token == b"Tr" and numbers:
                state["render"] = int(numbers[-1])
            elif token in (b"g", b"rg", b"k", b"sc", b"scn") and numbers:
                state["color"] = numbers
            elif token in (b"Tj", b"'", b'"') and isinstance(last, bytes) and last[:1] in (b"(", b"<"):
                show(_string(last))
            elif token == b"TJ" and isinstance(last, list):
                show(_joined(last))
            operands = []
    return out, [c for c in clipped if c]


def extract(content: bytes) -> dict:
    """What a document holds; one that is encrypted is an error, as nothing of it can be told."""
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R|/Encrypt\s*<<", content):
        raise ValueError("encrypted")
    file, content = content, unpacked(content)
    if len(re.findall(rb"/Type\s*/Page\b", content)) > MOST_PAGES:
        raise ValueError("too many pages")
    visible, hidden, clipped, faint = [], [], [], []
    alphas = opacities(content)
    boxes = {tuple(map(_number, x)) for x in _BOX.findall(content)}
    box = boxes.pop() if len(boxes) == 1 else None  # of several, it isn't known which a stream's page has
    for page, stream in enumerate((body for head, body in _bodies(file) if b"/ObjStm" not in head and _DRAWS.search(body)), 1):
        texts, gone = drawn(stream, box, alphas)
        visible.append(" ".join(t for method, t in texts if method == "visible"))
        hidden += [{"location": f"page{page}", "content": t, "method": method} for method, t in texts if isinstance(method, str) and method != "visible"]
        faint += [{"page": page, "content": t, "alpha": alpha} for alpha, t in texts if isinstance(alpha, float)]
        clipped += [{"page": page, "content": " ".join(x)} for x in gone]
    metadata = [{"key": _KEYS.get(k, k.lower()), "value": v} for k, v in ((k.decode(), text_of(raw).strip()) for k, raw in _INFO.findall(content)) if v]
    annotations, fields, outline = [], {}, []
    scripts = []
    for body in _OBJECT.findall(content):
        script = [t for raw in _SCRIPT.findall(body) if (t := text_of(raw).strip())]
        if b"/FT" in body and (name := _NAME.search(body)):
            if (value := _VALUE.search(body)) and text_of(value[1]):
                fields[text_of(name[1])] = text_of(value[1])  # of fields of one name the last counts
            annotations += [f"[widget_script:{text_of(name[1])}] {x}" for x in script]
        else:
            scripts += script
        if b"/Annot" in body and (note := _CONTENTS.search(body)) and (text := text_of(note[1]).strip()):
            annotations.append(text)
        if b"/Parent" in body and b"/FT" not in body and (title := _OUTLINE.search(body)):
            outline.append({"level": 1, "title": text_of(title[1])})
    if xmp := _XMP.search(content):
        metadata.append({"key": "_xmp", "value": xmp[0].decode("utf-8", "replace")})
    if outline:
        metadata.append({"key": "_outline", "value": str(outline)})
    loose = _OBJECT.sub(b"", content)
    if scripts := scripts + [s for raw in _SCRIPT.findall(loose) if (s := text_of(raw).strip())]:
        metadata.append({"key": "_embedded_js", "value": "\n".join(scripts)})
    read = []
    for page, picture in enumerate(image.pages(file), 1):
        read.append(image.ocr(picture))
        hidden += [{"location": f"page{page}", "content": x, "method": "qr_code"} for x in image.qr_codes(picture)]
    return {
        "ocr_text": "\n".join(read).strip(), "visible_text": "\n".join(visible).strip(), "hidden_text": hidden, "clipped_text": clipped, "transparent_text": faint, "metadata": metadata, "annotations": annotations,
        "form_field_defaults": [{"key": k, "value": v} for k, v in fields.items()],
    }
