"""Word documents by the standard library's zip and XML readers."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

from inkwarden.sources import image

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# Limits of an archive; smallest and largest image, images per document.
MOST_ENTRIES = 1000
MOST_ENTRY_BYTES = 100 * 1024 * 1024
MOST_IMAGES = 20
LEAST_AREA = 10_000
IMAGE_ENDINGS = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp", ".tiff")


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    """A part's root.  The size limit holds for every entry; parts that declare entities are refused."""
    if archive.getinfo(name).file_size > MOST_ENTRY_BYTES:
        raise ValueError("archive entry too large")
    data = archive.read(name)
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise ValueError("document type declarations are not accepted")
    return ElementTree.fromstring(data)


def _texts(node: ElementTree.Element, tag: str = "t") -> list[str]:
    return [t.text for t in node.iter(W + tag) if t.text]


def _paragraph(p: ElementTree.Element) -> str:
    out = []
    for node in p.iter():
        if node.tag == W + "t":
            out.append(node.text or "")
        elif node.tag == W + "tab":
            out.append("\t")
        elif node.tag in (W + "br", W + "cr"):
            out.append("\n")
    return "".join(out)


def run_method(vanish: bool, size: str | None, color: str | None) -> str | None:
    """Why a run is hidden: flagged so, under 2 half-points, or white."""
    if vanish:
        return "vanish"
    try:
        if size is not None and int(size) < 2:
            return "tiny_font"
    except ValueError:
        pass
    return "color_match" if (color or "").upper() == "FFFFFF" else None


def runs(body: ElementTree.Element):
    """(text, vanish, size, color) of each run with properties and text."""
    for run in body.iter(W + "r"):
        props = run.find(W + "rPr")
        text = "".join(t.text for t in run.findall(W + "t") if t.text).strip()
        if props is not None and text:
            value = lambda tag: None if (x := props.find(W + tag)) is None else x.get(W + "val")  # noqa: B023, E731
            yield text, props.find(W + "vanish") is not None, value("sz"), value("color")


def media(archive: zipfile.ZipFile):
    """(location, ending, bytes) of the images in an archive, those beyond the size limit left out."""
    for info in archive.infolist():
        ending = "." + info.filename.rpartition(".")[2].lower()
        if info.filename.startswith("word/media/") and ending in IMAGE_ENDINGS and info.file_size <= MOST_ENTRY_BYTES:
            yield f"docx_image:{info.filename.rpartition('/')[2]}", ending, archive.read(info)


def images(content: bytes) -> list[dict]:
    """The first images whose header tells a size within the limits: location, ext, width, height, content."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for location, ending, data in media(archive):
            width, height = image.size(data)
            if LEAST_AREA <= width * height <= image.MOST_PIXELS and len(out) < MOST_IMAGES:
                out.append({"location": location, "ext": ending, "width": width, "height": height, "content": data})
    return out


def extract(content: bytes) -> dict:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = archive.namelist()
        if len(names) > MOST_ENTRIES:
            raise ValueError("too many archive entries")
        metadata = []
        for part in ("core", "app"):
            if f"docProps/{part}.xml" in names:
                metadata += [{"key": f"{part}:{c.tag.rpartition('}')[2]}", "value": c.text} for c in _xml(archive, f"docProps/{part}.xml") if c.text]
        annotations = []
        if "word/comments.xml" in names:
            for comment in _xml(archive, "word/comments.xml").iter(W + "comment"):
                if text := " ".join(_texts(comment)).strip():
                    annotations.append(f"[comment:{comment.get(W + 'author', 'unknown')}] {text}")
        root = _xml(archive, "word/document.xml")
        codes = [{"location": where, "content": x, "method": "qr_code"} for where, _, data in media(archive) for x in image.qr_codes(data)]
        edges = [" ".join(_texts(_xml(archive, n))) for n in names if n.startswith(("word/header", "word/footer")) and n.endswith(".xml")]
    body = root.find(W + "body")
    body = root if body is None else body
    visible = [_paragraph(p) for p in body.findall(W + "p")]
    visible += ["\n".join(_paragraph(p) for p in cell.findall(W + "p")) for table in body.findall(W + "tbl") for row in table.findall(W + "tr") for cell in row.findall(W + "tc")]
    hidden = codes + [{"location": "docx_body", "content": text, "method": m} for text, *how in runs(root) if (m := run_method(*how))]
    changes = [
        {"type": kind, "content": text, "author": node.get(W + "author", "unknown")}
        for kind, tag in (("del", "delText"), ("ins", "t")) for node in root.iter(W + kind) if (text := " ".join(_texts(node, tag)).strip())
    ]
    fields = [{"instruction": t} for node in root.iter(W + "instrText") if (t := (node.text or "").strip())]
    return {
        "visible_text": "\n".join(visible + edges), "hidden_text": hidden, "metadata": metadata, "annotations": annotations,
        "tracked_changes": changes, "field_codes": fields, "macro_present": "word/vbaProject.bin" in names,
    }
