"""Parsers of single files: bytes in, blocks out.  They use the standard library only and know nothing of Spark.

A block is a dict with type, text, rows (tables), and place (where in the file it stands).
"""

from __future__ import annotations

import html
import io
import json
import re
import stat
import struct
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from pathlib import PurePosixPath
from urllib.parse import parse_qs, urljoin, urlsplit
from xml.etree import ElementTree

# Limits of archives and the rows of a sheet's block.
MAX_DEPTH, MAX_FILES, MAX_BYTES, MAX_RATIO, SHEET_ROWS = 3, 5000, 2 << 30, 300, 500
# First bytes of file types.
SIGNATURES = ((b"%PDF-", "pdf"), (b"\x89PNG\r\n\x1a\n", "png"), (b"\xff\xd8\xff", "jpg"), (b"II*\x00", "tiff"), (b"MM\x00*", "tiff"), (b"Rar!\x1a\x07", "rar"))
SUFFIXES = {"jpeg": "jpg", "tif": "tiff", "htm": "html"}
IMAGES = ("png", "jpg", "tiff", "bmp", "gif", "webp")
# Fixed value: pixels below which an embedded image is not read.
LEAST_PIXELS = 40_000

#: Readers of kinds that the standard library can't read, by kind ("pdf", "xls", "doc", "rar" ...): bytes to blocks.  The
#: one named "image" is an OCR engine: bytes to text and confidences; it serves image files and images within others.
Adapters = dict[str, Callable]

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_DROPPED = {"script", "style", "noscript", "svg", "nav", "footer"}
_BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "dt", "dd", "pre"}
_INNER = {"p", "table", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6"}
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


def normalise(value) -> str:
    """X-14 for one value."""
    text = html.unescape("" if value is None else str(value)).translate({0xA0: " ", 0x3000: " ", 0x200B: None, 0xFEFF: None})
    lines = [re.sub(r"[\t\x0b\x0c\r ]+", " ", line).strip() for line in text.splitlines()]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def trim(rows) -> list[list[str]]:
    """X-15 for one table."""
    clean = [[normalise(c) for c in row] for row in rows]
    kept = [i for i, row in enumerate(clean) if any(row)]
    if not kept:
        return []
    clean = clean[kept[0] : kept[-1] + 1]
    width = 1 + max(i for row in clean for i, c in enumerate(row) if c)
    return [(row + [""] * width)[:width] for row in clean]


def markdown(rows: list[list[str]]) -> str:
    """SNK-09 for one table."""
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(c.replace("|", "\\|").replace("\n", "<br>") for c in row + [""] * (width - len(row))) + " |" for row in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def table_block(rows: list[list[str]], place: str) -> dict:
    return {"type": "table", "text": markdown(rows), "rows": rows, "place": place}


def text_block(kind: str, text: str, place: str) -> dict:
    return {"type": kind, "text": normalise(text), "rows": None, "place": place}


def decode(data: bytes) -> str:
    """SRC-14: a detector, if there is one, then the usual encodings."""
    for encoding in ("utf-8-sig",):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            pass
    try:
        from charset_normalizer import from_bytes

        best = from_bytes(data).best()
        if best is not None:
            return str(best)
    except ImportError:
        pass
    for encoding in ("gb18030", "big5", "latin1"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", errors="replace")


def detect(name: str, data: bytes) -> str:
    """SRC-01: type by signature, then by suffix; archives by their members."""
    suffix = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    for mark, kind in SIGNATURES:
        if data.startswith(mark):
            return kind
    if data[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        try:
            members = set(zipfile.ZipFile(io.BytesIO(data)).namelist())
        except zipfile.BadZipFile:
            members = set()
        return "docx" if "word/document.xml" in members else "xlsx" if "xl/workbook.xml" in members else "zip"
    if data.startswith(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"):
        return "xls" if suffix in ("xls", "xlt") else "doc"
    head = data[:8192].lower().lstrip()[:1024]
    if suffix in ("html", "htm") or any(tag in head for tag in (b"<!doctype html", b"<html", b"<body")):
        return "html"
    return SUFFIXES.get(suffix, suffix or "binary")


class _Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: _Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        stack = [c for c in reversed(self.children) if isinstance(c, _Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, _Node))

    def text(self) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                out.append(item)
            else:
                stack.extend(reversed(item.children))
        return "".join(out)

    def within(self, tag: str) -> bool:
        node = self.parent
        while node is not None:
            if node.tag == tag:
                return True
            node = node.parent
        return False

    def drop(self) -> None:
        self.parent.children = [c for c in self.parent.children if c is not self]


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        closes = _CLOSES.get(tag)
        node = self.at
        while closes and node is not None and node.tag not in ("table", "ul", "ol", "dl", "div", "body"):
            if node.tag in closes:
                self.at = node.parent
                if tag != "tr" or node.tag == "tr":
                    break
            node = node.parent
        child = _Node(tag, dict(attrs), self.at)
        self.at.children.append(child)
        if tag not in _VOID:
            self.at = child

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def _span(cell: _Node, name: str) -> int:
    return max(1, int(cell.attrs.get(name) or "1"))


def html_table(table: _Node) -> list[list[str]]:
    """SRC-03: a grid with spans written out; rows of inner tables do not count."""
    grid: list[dict[int, str]] = []
    held: dict[tuple[int, int], str] = {}
    rows = [n for n in table.walk() if n.tag == "tr" and _owner(n) is table]
    for y, row in enumerate(rows):
        line, x = {}, 0
        for cell in (c for c in row.children if isinstance(c, _Node) and c.tag in ("td", "th")):
            while (y, x) in held:
                line[x] = held[y, x]
                x += 1
            try:
                down, across = _span(cell, "rowspan"), _span(cell, "colspan")
            except ValueError:
                down = across = 1
            value = normalise(cell.text())
            for i in range(x, x + across):
                line[i] = value
                held |= {(y + d, i): value for d in range(1, min(down, len(rows) - y))}
            x += across
        line |= {i: v for (r, i), v in held.items() if r == y and i not in line}
        grid.append(line)
    return trim([[line.get(i, "") for i in range(max(line, default=-1) + 1)] for line in grid])


def _owner(node: _Node) -> _Node | None:
    node = node.parent
    while node is not None and node.tag != "table":
        node = node.parent
    return node


def parse_html(data: bytes) -> list[dict]:
    """SRC-02: headings, paragraphs and tables of a page's main part, in document order."""
    tree = _Tree()
    tree.feed(decode(data))
    tree.close()
    root = tree.root
    for node in list(root.walk()):
        if node.tag in _DROPPED:
            node.drop()
    nodes = list(root.walk())
    classes = lambda n: (n.attrs.get("class") or "").split()
    main = [n for n in nodes if "vF_detail_main" in classes(n)] or [n for n in nodes if n.tag in ("main", "article") or n.attrs.get("id") in ("content", "main-content")] or [n for n in nodes if n.tag == "body"] or [root]
    main = main[0]
    for node in list(main.walk()):
        name = (node.attrs.get("class") or "").lower()
        if node.tag == "aside" or any(word in name for word in ("footer", "sidebar", "related")):
            node.drop()
    out, tables, texts = [], 0, 0
    for node in main.walk():
        if node.within("table"):
            continue
        if node.tag == "table":
            rows = html_table(node)
            if rows:
                tables += 1
                out.append(table_block(rows, f"table {tables}"))
        elif node.tag in _BLOCKS or node.tag in ("div", "section", "article") and not any(n.tag in _INNER for n in node.walk()):
            text = normalise(node.text())
            if text:
                texts += 1
                out.append(text_block("heading" if node.tag.startswith("h") else "paragraph", text, f"paragraph {texts}"))
    if not out and normalise(main.text()):
        out.append(text_block("paragraph", main.text(), "paragraph 1"))
    return out


_FILE = re.compile(r"\.(?:docx?|xlsx?|pdf|zip|rar|7z|jpe?g|png|gif|bmp|tiff?|txt|csv)(?:\?|$)", re.I)


def _flat(node: _Node | None) -> str:
    return " ".join(node.text().split()) if node is not None else ""


def parse_detail(data: bytes, url: str) -> dict:
    """SRC-23: title, text, summary table and attachments of a stored detail page.

    Attachments: name, uuid, url (an address on the page, joined to the page's), kind; the last of an address counts.
    """
    tree = _Tree()
    tree.feed(decode(data))
    tree.close()
    nodes = list(tree.root.walk())
    named = lambda part: [n for n in nodes if n.tag == "div" and part in (n.attrs.get("class") or "")]
    below = lambda tops, tag: (n for top in tops for n in top.walk() if n.tag == tag)
    places = [below(named("vF_detail_header"), "h2"), below(named("vF_detail"), "h1"), *((n for n in nodes if n.tag == tag) for tag in ("h1", "h2", "title"))]
    title = next((t for t in (_flat(next(iter(found), None)) for found in places) if t), None)
    mains = [next(iter(named(part)), None) for part in ("vF_detail_content", "vT_detail_content", "vF_detail")] + [next((n for n in nodes if n.tag == "body"), None)]
    content = next((t for t in map(_flat, mains) if t), "")
    meta: dict[str, str] = {}
    for table in below(named("vF_detail"), "table"):
        rows = [[c for c in row.children if isinstance(c, _Node) and c.tag == "td"] for row in table.walk() if row.tag == "tr"]
        pairs = [(_flat(r[0]).rstrip("：:"), _flat(r[1])) for r in rows if len(r) > 1] if len(rows) <= 8 else []
        meta = {k: v for k, v in pairs if 2 <= len(k) <= 20 and v}
        if meta:
            break
    found: dict[str, dict] = {}
    links = [n for n in nodes if n.tag == "a"]
    for a in links:
        uuid = (a.attrs.get("id") or "").strip()
        if "bizDownload" in (a.attrs.get("class") or "") and uuid not in ("", "null"):
            found[uuid] = {"name": _flat(a), "uuid": uuid, "url": None, "kind": "bizDownload"}
    for a in links:
        href = a.attrs.get("href") or ""
        low, parts = href.lower(), urlsplit(href)
        name = _flat(a) or PurePosixPath(parts.path).name
        if not href or low.startswith(("javascript", "#", "mailto")):
            continue
        if "/oss/download" in low:
            uuid = parse_qs(parts.query).get("uuid", [""])[0].strip() or None
            found[uuid or urljoin(url, href)] = {"name": name, "uuid": uuid, "url": None if uuid else urljoin(url, href), "kind": "oss_direct"}
        elif _FILE.search(low) and "/cggg/" not in low:
            found[urljoin(url, href)] = {"name": name, "uuid": None, "url": urljoin(url, href), "kind": "direct"}
    return {"title": title, "content": content[:200_000], "meta": meta, "attachments": list(found.values())}


def sheet_blocks(sheet: str, rows: list[list], most: int = SHEET_ROWS) -> list[dict]:
    """SRC-07: blocks of ``most`` rows; later ones repeat the first row before theirs."""
    clean = trim(rows)
    return [table_block(part if not at else [clean[0], *part], f"sheet {sheet} rows {at + 1}-{at + len(part)}") for at in range(0, len(clean), most) for part in [clean[at : at + most]]]


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def pixels(data: bytes) -> int | None:
    """Size of an image, from the heads of PNG, GIF and BMP files; None for others."""
    if data.startswith(b"\x89PNG\r\n\x1a\n") and len(data) >= 24:
        wide, high = struct.unpack(">II", data[16:24])
    elif data.startswith((b"GIF87a", b"GIF89a")) and len(data) >= 10:
        wide, high = struct.unpack("<HH", data[6:10])
    elif data.startswith(b"BM") and len(data) >= 26:
        wide, high = (abs(x) for x in struct.unpack("<ii", data[18:26]))
    else:
        return None
    return wide * high


def image_blocks(data: bytes, place: str, engine: Callable | None, least: int = 0) -> list[dict]:
    """SRC-12: one ``ocr_text`` block whose place tells its state, and a warning where it has no text for no good reason."""
    size = pixels(data)
    text, state = "", "unavailable"
    if size is not None and size < least:
        state = "skipped_small_image"
    elif engine is not None:
        try:
            text, confidences = engine(data)
            state = f"ok {round(sum(confidences) / len(confidences), 4)}" if text and confidences else "ok" if text else "empty"
        except Exception as problem:  # whatever an engine raises is that image's outcome
            state = f"failed {str(problem)[:200]}"
    found = [{"type": "ocr_text", "text": normalise(text), "rows": None, "place": f"{place} ({state})".strip()}]
    return found if text or state == "skipped_small_image" else [*found, {"type": "warning", "text": f"ocr_unavailable_or_empty: {place or 'image'}: {state}", "rows": None, "place": ""}]


def parse_docx(data: bytes, engine: Callable | None = None) -> list[dict]:
    """SRC-04: paragraphs and tables in body order, heading styles make headings; then the embedded images by name."""
    book = zipfile.ZipFile(io.BytesIO(data))
    body = ElementTree.fromstring(book.read("word/document.xml")).find(f"{_W}body")
    words = lambda node: "".join(t.text or "" if t.tag == f"{_W}t" else "\n" if t.tag == f"{_W}br" else "\t" for t in node.iter() if t.tag in (f"{_W}t", f"{_W}br", f"{_W}tab"))
    out, tables, texts = [], 0, 0
    for node in body:
        if node.tag == f"{_W}p":
            text = normalise(words(node))
            style = node.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val", "") if style is not None else ""
            if text:
                texts += 1
                out.append(text_block("heading" if name.startswith(("Heading", "heading", "标题")) else "paragraph", text, f"paragraph {texts}"))
        elif node.tag == f"{_W}tbl":
            rows = []
            for row in node.findall(f"{_W}tr"):
                cells = []
                for cell in row.findall(f"{_W}tc"):
                    wide = cell.find(f"{_W}tcPr/{_W}gridSpan")
                    cells += ["\n".join(words(p) for p in cell.findall(f"{_W}p"))] * (int(wide.get(f"{_W}val", "1")) if wide is not None else 1)
                rows.append(cells)
            if trim(rows):
                tables += 1
                out.append(table_block(trim(rows), f"table {tables}"))
    for name in sorted(n for n in book.namelist() if n.startswith("word/media/") and not n.endswith("/")):
        out += image_blocks(book.read(name), name, engine, LEAST_PIXELS)
    return out or [{"type": "warning", "text": "docx_no_content", "rows": None, "place": ""}]


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def parse_xlsx(data: bytes) -> list[dict]:
    """SRC-05: every sheet with cached values; merged cells repeat their first value."""
    book = zipfile.ZipFile(io.BytesIO(data))
    names = set(book.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in item.iter(f"{_S}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_S}sheet"):
        target = targets[sheet.get(f"{_R}id")].lstrip("/")
        root = ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}"))
        cells: dict[tuple[int, int], str] = {}
        for y, row in enumerate(root.iter(f"{_S}row")):
            y = int(row.get("r", y + 1)) - 1
            for x, cell in enumerate(row):
                x = _column(cell.get("r")) if cell.get("r") else x
                value, inline = cell.find(f"{_S}v"), cell.find(f"{_S}is")
                text = "".join(t.text or "" for t in inline.iter(f"{_S}t")) if inline is not None else value.text or "" if value is not None else ""
                cells[y, x] = shared[int(text)] if cell.get("t") == "s" and text else text
        for merge in root.iter(f"{_S}mergeCell"):
            (a, b), (c, d) = ((_column(p), int(re.search(r"\d+", p)[0]) - 1) for p in merge.get("ref").split(":"))
            cells |= {(y, x): cells.get((b, a), "") for y in range(b, d + 1) for x in range(a, c + 1)}
        high, wide = max((y for y, _ in cells), default=-1), max((x for _, x in cells), default=-1)
        out += sheet_blocks(sheet.get("name"), [[cells.get((y, x), "") for x in range(wide + 1)] for y in range(high + 1)])
    return out


def parse_text(name: str, data: bytes) -> list[dict]:
    """SRC-13: JSON printed out, or as it stands with a warning; other text is a paragraph."""
    text = decode(data)
    if name.lower().endswith(".json"):
        try:
            return [{"type": "metadata", "text": json.dumps(json.loads(text), ensure_ascii=False, indent=2), "rows": None, "place": ""}]
        except ValueError:
            return [text_block("metadata", text, ""), {"type": "warning", "text": "invalid JSON", "rows": None, "place": ""}]
    return [text_block("paragraph", text, "")] if normalise(text) else []


def safe_name(name: str) -> str:
    """SRC-17: a member's path; ValueError if it leaves the archive."""
    path = PurePosixPath(name.replace("\\", "/"))
    parts = name.replace("\\", "/").split("/")
    if path.is_absolute() or any(p in ("", ".", "..") for p in parts) or re.fullmatch(r"[A-Za-z]:", parts[0]):
        raise ValueError(f"member leaves its archive: {name!r}")
    return str(path)


def volumes(names: list[str]) -> list[str]:
    """SRC-16: multi-volume archives by their first volume; the order is by name."""
    groups: dict[tuple, list[tuple[int, str]]] = {}
    out = []
    for name in names:
        found = re.fullmatch(r"(.+)\.part(\d+)\.rar", PurePosixPath(name).name, re.I)
        if found:
            groups.setdefault((str(PurePosixPath(name).parent).lower(), found[1].lower()), []).append((int(found[2]), name))
        else:
            out.append(name)
    out += [min(parts, key=lambda p: (p[0], p[1].lower()))[1] for parts in groups.values()]
    return sorted(out, key=str.lower)


def error_block(code: str, message: str) -> dict:
    return {"type": "error", "text": f"{code}: {message}", "rows": None, "place": ""}


def parse(name: str, data: bytes, path: str = "", depth: int = 0, adapters: Adapters | None = None) -> list[dict]:
    """P-06, SRC-15: blocks of a file with the path it was found under; archives open up to a depth.  A file that cannot
    be read is one error block and leaves its siblings alone.

    SRC-06, SRC-08, SRC-16, SRC-18: kinds without a reader go to their adapter; without one they are ``unsupported``.
    """
    here = f"{path}/{name}" if path else name
    kind, adapters = detect(name, data), adapters or {}
    try:
        if kind == "zip":
            return _archive(data, here, depth, adapters)
        if kind in adapters:
            found = list(adapters[kind](data))
        elif kind in IMAGES:
            found = image_blocks(data, "", adapters.get("image"))
        elif kind == "docx":
            found = parse_docx(data, adapters.get("image"))
        elif kind in ("html", "xlsx"):
            found = {"html": parse_html, "xlsx": parse_xlsx}[kind](data)
        elif kind in ("json", "txt"):
            found = parse_text(name, data)
        else:
            found = [{"type": "unsupported", "text": kind, "rows": None, "place": ""}]
    except Exception as problem:  # the format's own errors differ by library; each becomes a row
        found = [error_block("parse_failed", str(problem)[:500])]
    return [b | {"path": here, "file_type": kind} for b in found]


def _archive(data: bytes, here: str, depth: int, adapters: Adapters) -> list[dict]:
    fail = lambda code, text, where=here: [error_block(code, text) | {"path": where, "file_type": "zip"}]
    if depth >= MAX_DEPTH:
        return fail("too_deep", f"more than {MAX_DEPTH} archives within each other")
    book = zipfile.ZipFile(io.BytesIO(data))
    members = [m for m in book.infolist() if not m.is_dir()]
    if len(members) > MAX_FILES or sum(m.file_size for m in members) > MAX_BYTES:
        return fail("too_large", f"{len(members)} files, {sum(m.file_size for m in members)} bytes")
    out = []
    by_name = {m.filename: m for m in members}
    for name in volumes(list(by_name)):
        member = by_name[name]
        try:
            safe = safe_name(name)
        except ValueError as problem:
            out += fail("unsafe_path", str(problem))
            continue
        if stat.S_ISLNK(member.external_attr >> 16):
            out += fail("symlink", safe)
        elif member.flag_bits & 1:
            out += fail("encrypted_archive_member", safe, f"{here}/{safe}")
        elif member.compress_size and member.file_size / member.compress_size > MAX_RATIO:
            out += fail("suspicious_compression_ratio", safe, f"{here}/{safe}")
        else:
            out += parse(PurePosixPath(safe).name, book.read(member), f"{here}/{PurePosixPath(safe).parent}".removesuffix("/."), depth + 1, adapters)
    return out
