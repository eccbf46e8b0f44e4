"""Readers of office and flat files, archives and web pages as DataFrames of lines, with standard-library parsers in Arrow batches."""

from __future__ import annotations

import html
import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from functools import lru_cache, partial
from html.entities import html5
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions.markup import Reader

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
Line = tuple[str, str]


R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _related(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Targets of a part's relationships by id, as names in the archive."""
    folder, _, name = part.rpartition("/")
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in z.namelist():
        return {}
    found = {e.get("Id"): e.get("Target", "") for e in ElementTree.fromstring(z.read(rels)) if e.get("TargetMode") != "External"}
    return {k: t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join(folder, t)) for k, t in found.items()}


def docx_lines(data: bytes) -> list[Line]:
    """(kind, text) of paragraphs and table rows in document order, embedded web parts and the names of pictures among them, then
    headers, footers, notes and comments. A table inside a cell follows the row of that cell."""
    out: list[Line] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = ["word/document.xml", *sorted(n for n in z.namelist() if re.fullmatch(r"word/(header|footer|footnotes|endnotes|comments)\d*\.xml", n))]
        for name in names:
            if name not in z.namelist():
                continue
            related = _related(z, name)
            part = "body" if name.endswith("document.xml") else re.sub(r"\d*\.xml", "", name.split("/")[1])

            def text(e: ElementTree.Element) -> str:
                if e.tag == f"{W}tbl":
                    return ""
                return (e.text or "") if e.tag == f"{W}t" else "\t" if e.tag == f"{W}tab" else "".join(map(text, e))

            def walk(e: ElementTree.Element, part: str = part, related: dict = related) -> None:
                if e.tag == f"{W}tr":
                    cells = list(dict.fromkeys(text(c).strip() for c in e.findall(f"{W}tc")))
                    if any(cells):
                        out.append(("table", " | ".join(cells)))
                    for inner in (t for c in e.findall(f"{W}tc") for t in c.findall(f"{W}tbl")):
                        walk(inner)
                    return
                if e.tag == f"{W}p" and text(e).strip():
                    out.append((part, text(e).strip()))
                if e.tag == f"{W}altChunk" and (target := related.get(e.get(f"{R}id"), "")) in z.namelist():
                    out.extend(("web", x) for _, x in html_lines(z.read(target)))
                if e.tag == f"{A}blip" and (target := related.get(e.get(f"{R}embed"), "")):
                    out.append(("picture", target.rsplit("/", 1)[-1]))
                for c in e:
                    walk(c)

            walk(ElementTree.fromstring(z.read(name)))
    return out


def pptx_lines(data: bytes) -> list[Line]:
    """(slide, text) in reading order: titles, then by row and place, those of groups where the group puts them; table rows cell by cell; then notes."""
    out: list[Line] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.split("/")[-1])[0]))
        for k, name in enumerate(slides, 1):
            try:
                root = ElementTree.fromstring(z.read(name))
            except (ElementTree.ParseError, zipfile.BadZipFile):
                out.append((f"slide {k} damaged", name))  # the others are read all the same
                continue
            related, shapes = _related(z, name), []
            para = lambda e: "\n".join(filter(None, ("".join(t.text or "" for t in p.iter(f"{A}t")).strip() for p in e.iter(f"{A}p"))))

            def walk(e: ElementTree.Element, dx: int, dy: int, related: dict = related, shapes: list = shapes) -> None:
                for sp in e:
                    kind = sp.tag.rpartition("}")[2]
                    if kind not in ("sp", "grpSp", "graphicFrame", "pic", "cSld", "spTree"):
                        continue
                    off, child = (next((x for x in sp.iter(f"{A}{n}")), None) if kind not in ("cSld", "spTree") else None for n in ("off", "chOff"))
                    x, y = (dx + int(off.get("x", 0)), dy + int(off.get("y", 0))) if off is not None else (dx, dy)
                    if kind in ("grpSp", "cSld", "spTree"):
                        walk(sp, *((x - int(child.get("x", 0)), y - int(child.get("y", 0))) if child is not None else (dx, dy)))
                        continue
                    title = any(e.get("type") in ("title", "ctrTitle") for e in sp.iter() if e.tag.endswith("}ph"))
                    rows = [" | ".join(para(c).replace("\n", " ") for c in r.findall(f"{A}tc")) for r in sp.iter(f"{A}tr")]
                    blip = next(sp.iter(f"{A}blip"), None)
                    text = "\n".join(rows) if rows else para(sp)
                    if kind == "pic" and blip is not None:
                        text = f"[IMAGE: {related.get(blip.get(f'{R}embed'), '').rsplit('/', 1)[-1]}]"
                    if text.strip(" |\n"):
                        shapes.append((not title, y // 50_000, x, text))

            walk(root, 0, 0)
            out += [(f"slide {k}", s[-1]) for s in sorted(shapes)]
            for target in related.values():
                if "notesSlide" in target and target in z.namelist():
                    notes = ElementTree.fromstring(z.read(target))
                    out += [(f"notes {k}", t) for sp in notes.iter() if sp.tag.endswith("}sp") and not any(e.get("type") in ("sldNum", "sldImg") for e in sp.iter() if e.tag.endswith("}ph")) and (t := para(sp))]
    return out


#: Numbers of the built-in formats that show a date or time.
DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])


CELL, VALUE, TEXT = f"{S}c", f"{S}v", f"{S}t"


def xlsx_cells(data: bytes) -> list[tuple[str, int, int, str]]:
    """(sheet, row, col, value) of cells that hold something: sheets by their names, dates as ISO 8601, the value of a merged
    range in all its cells; hidden columns are left out."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{S}si")]
        dates = _date_styles(z) if "xl/styles.xml" in names else []
        sheets = sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        titles, since = {}, 0
        if "xl/workbook.xml" in names:
            book, related = ElementTree.fromstring(z.read("xl/workbook.xml")), _related(z, "xl/workbook.xml")
            titles = {related.get(s.get(f"{R}id"), ""): s.get("name") for s in book.iter(f"{S}sheet")}
            since = 1462 if any(p.get("date1904") in ("1", "true") for p in book.iter(f"{S}workbookPr")) else 0
        for name in sheets:
            root = ElementTree.fromstring(z.read(name))
            title = titles.get(name) or name.split("/")[-1][:-4]
            hidden = {c for col in root.iter(f"{S}col") if col.get("hidden") in ("1", "true") for c in range(int(col.get("min")), int(col.get("max")) + 1)}
            held: dict[tuple[int, int], str] = {}
            for c in root.iter(CELL):
                kind = c.get("t")
                if kind == "inlineStr":
                    value = "".join([t.text or "" for t in c.iter(TEXT)])
                else:
                    v = c.find(VALUE)
                    value = (v.text or "") if v is not None else ""
                if kind == "s" and value:
                    value = shared[int(value)]
                elif kind in (None, "n") and value and (style := int(c.get("s", 0))) < len(dates) and dates[style]:
                    moment = datetime(1899, 12, 30) + timedelta(days=float(value) + since)
                    value = (moment + timedelta(microseconds=500_000)).replace(microsecond=0).isoformat()
                    value = value.removesuffix("T00:00:00")
                if value:
                    held[_place(c.get("r"))] = value
            for m in root.iter(f"{S}mergeCell"):
                (r0, c0), (r1, c1) = map(_place, m.get("ref").split(":"))
                if (r0, c0) in held:
                    held |= {(r, c): held[r0, c0] for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)}
            out += [(title, r, c, v) for (r, c), v in sorted(held.items()) if c not in hidden]
    return out


@lru_cache(1 << 16)
def _place(name: str) -> tuple[int, int]:
    letters, row = re.fullmatch(r"([A-Z]+)(\d+)", name).groups()
    col = 0
    for ch in letters:
        col = col * 26 + ord(ch) - 64
    return int(row), col


def _date_styles(z: zipfile.ZipFile) -> list[bool]:
    """For each cell style whether it shows a date."""
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")) for f in root.iter(f"{S}numFmt")}
    styles = root.find(f"{S}cellXfs")
    numbers = [int(x.get("numFmtId", 0)) for x in styles] if styles is not None else []
    return [n in DATE_FORMATS or bool(re.search("[ymdhs]", own.get(n, ""), re.I)) for n in numbers]


def flat_lines(data: bytes) -> list[Line]:
    """Stripped lines that are not blank; a text of fewer than 50 characters counts as empty and raises."""
    for coding in ("utf-8-sig", "utf-16", "cp1252"):
        try:
            if coding == "utf-16" and data[:2] not in (b"\xff\xfe", b"\xfe\xff"):
                continue
            text = data.decode(coding)
            break
        except UnicodeDecodeError:
            continue
    else:
        text = data.decode("latin1")
    if len(text.strip()) < 50:
        raise ValueError("the file is empty")
    return [("body", x.strip()) for x in text.splitlines() if x.strip()]


#: Elements of a page that are no text, and those that begin a line.
ASIDE = frozenset(("script", "style", "nav", "header", "footer", "aside", "form", "noscript"))
LINES = frozenset(("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article"))


#: A character reference with its semicolon.
REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _ended(text: str) -> str:
    """text with those character references decoded that end in a semicolon; what only begins like one stays."""
    return REFERENCE.sub(lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], text)


def html_lines(data: bytes, loose: bool = True) -> list[Line]:
    """Lines of a page's text; scripts, styles and menus that are closed are left out, with what they hold.

    ``loose``: references to characters that HTML 5 knows without a semicolon are decoded as well, as browsers do.
    """
    page = data.decode("utf-8", "replace")
    reader, low = Reader(page), page.lower()
    ends = {tag: low.rfind(f"</{tag}") for tag in ASIDE}
    parts: list[str] = []
    within, depth, at = "", 0, 0
    while True:
        found = reader.tag(at)
        if not within:
            parts.append(page[at : found[0] if found else len(page)])
        if not found:
            break
        start, at, tag, _ = found
        name = tag.lstrip("/")
        if within:
            depth += (name == within) * (-1 if tag[0:1] == "/" else 1)
            within = within if depth and start < ends[within] else ""  # at the last end at the latest
            parts.append("" if within else " ")
        elif tag in ("script", "style") and ends[tag] > start:
            at = reader.after(tag, at)
            parts.append(" ")
        elif tag in ASIDE and ends[tag] > start:
            within, depth = tag, 1
        elif tag in LINES:
            parts.append("\n")
    decoded = html.unescape if loose else _ended
    lines = (" ".join(decoded(x).split()) for x in "".join(parts).split("\n"))
    return [("body", x) for x in lines if x]


HEADINGS = {f"h{k}": "#" * k for k in range(1, 7)}


class _Markdown(HTMLParser):
    """Headings, paragraphs, lists and tables of a page as Markdown; boilerplate is left out."""

    SKIPPED = frozenset(("script", "style", "nav", "header", "footer", "aside", "form", "noscript", "template"))

    def __init__(self) -> None:
        super().__init__()
        self.out: list[str] = []
        self.parts: list[str] = []
        self.skip, self.mark, self.row = 0, "", None
        self.rows: list[list[str]] = []

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if self.row is not None:
            if text:
                self.row[-1:] = [f"{self.row[-1]} {text}".strip()] if self.row else [text]
        elif text:
            self.out.append(f"{self.mark} {text}".strip())

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIPPED:
            self.skip += 1
        elif tag in HEADINGS or tag in ("p", "div", "li", "br", "section", "article", "table"):
            self.flush()
            self.mark = HEADINGS.get(tag, "-" if tag == "li" else "" if tag in ("p", "div", "table") else self.mark)
        elif tag == "tr":
            self.flush()
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.flush()
            self.row.append("")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "tr" and self.row is not None:
            self.flush()
            self.rows.append(self.row)
            self.row = None
        elif tag == "table":
            self.flush()
            self.out += markdown_table(self.rows)
            self.rows = []
        elif tag in HEADINGS or tag in ("p", "div", "li"):
            self.flush()
            self.mark = ""

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.parts.append(data)


def markdown_table(rows: list[list[str]]) -> list[str]:
    """Rows under the first one as header; short rows are filled up, bars in cells escaped."""
    rows = [r for r in rows if any(x.strip() for x in r)]
    width = max(map(len, rows), default=0)
    line = lambda r: "| " + " | ".join(x.replace("|", "\\|") for x in [*r, *[""] * (width - len(r))]) + " |"
    return [line(rows[0]), "|" + " --- |" * width, *map(line, rows[1:])] if rows else []


def html_markdown(data: bytes) -> str:
    p = _Markdown()
    p.feed(data.decode("utf-8", "replace"))
    p.close()
    p.flush()
    return "\n\n".join(p.out).replace(" |\n\n|", " |\n|")


def markdown(path: str, data: bytes) -> str:
    """A file as Markdown: sheets and table rows as tables, slides and sheet names as headings."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending in ("html", "htm"):
        return html_markdown(data)
    out: list[str] = []
    if ending == "xlsx":
        grid: dict[str, dict[int, dict[int, str]]] = {}
        for sheet, r, c, v in xlsx_cells(data):
            grid.setdefault(sheet, {}).setdefault(r, {})[c] = v
        for sheet, rows in grid.items():
            first, last = min(min(r) for r in rows.values()), max(max(r) for r in rows.values())
            out += [f"## {sheet}", "\n".join(markdown_table([[r.get(c, "") for c in range(first, last + 1)] for _, r in sorted(rows.items())]))]
        return "\n\n".join(out)
    rows: list[list[str]] = []
    for kind, text in [*READERS[ending](data), ("end", "")]:
        if kind == "table":
            rows.append(text.split(" | "))
            continue
        if rows:
            out.append("\n".join(markdown_table(rows)))
            rows = []
        if kind.startswith("slide") and f"## {kind.capitalize()}" not in out:
            out.append(f"## {kind.capitalize()}")
        if text:
            out.append(text)
    return "\n\n".join(out)


READERS: dict[str, Callable[[bytes], list[Line]]] = {
    "docx": docx_lines,
    "pptx": pptx_lines,
    "xlsx": lambda d: [(s, f"{r},{c}: {v}") for s, r, c, v in xlsx_cells(d)],
    "html": html_lines,
    "htm": html_lines,
    "txt": flat_lines,
    "md": flat_lines,
    "csv": flat_lines,
}


def suffix(name: Column) -> Column:
    return F.lower(F.element_at(F.split(name, "[.]"), -1))


def wanted(name: Column) -> Column:
    """Members worth reading: not hidden, not of the system, not archives themselves."""
    base = F.element_at(F.split(name, "/"), -1)
    return ~(base.startswith(".") | base.startswith("~$") | name.contains("__MACOSX") | base.isin("Thumbs.db", "desktop.ini") | (suffix(name) == "zip") | (base == ""))


def read_lines(files: DataFrame, loose: bool = True) -> DataFrame:
    """(path, line_no, kind, text, error) of binary files (path, content); unknown or damaged ones give one row with the error. loose: of html_lines()."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    read = READERS[path.rsplit(".", 1)[-1].lower()]
                    if read is html_lines and not loose:
                        read = partial(html_lines, loose=False)
                    rows += [(path, k, kind, text, None) for k, (kind, text) in enumerate(read(bytes(data)))]
                except Exception as e:  # noqa: BLE001  a damaged file is a row, not a failed job
                    rows.append((path, 0, "error", None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "line_no", "kind", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, line_no int, kind string, text string, error string")


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def to_markdown(files: DataFrame) -> DataFrame:
    """(path, markdown, error) of binary files (path, content); unknown or damaged ones give the error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows.append((path, markdown(path, bytes(data)), None))
                except Exception as e:  # noqa: BLE001  a damaged file is a row, not a failed job
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "markdown", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, markdown string, error string")


def wanted_name(name: str) -> bool:
    """``wanted`` for one name, before its bytes are read."""
    base = name.rsplit("/", 1)[-1]
    return bool(base) and not (base.startswith((".", "~$")) or "__MACOSX" in name or base in ("Thumbs.db", "desktop.ini") or base.lower().endswith(".zip"))


def archive_members(files: DataFrame) -> DataFrame:
    """(archive, path, content, supported, error) of the wanted members of zip files (path, content); a damaged archive or member gives the error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = lambda archive, path=None, content=None, error=None: pd.DataFrame({"archive": [archive], "path": [path], "content": [content], "supported": [bool(path) and path.rsplit(".", 1)[-1].lower() in READERS], "error": [error]})
        for pdf in parts:
            for archive, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                        names = list(filter(wanted_name, z.namelist()))
                        for n in names:
                            try:
                                yield row(archive, n, z.read(n))
                            except Exception as e:  # noqa: BLE001
                                yield row(archive, n, error=f"{type(e).__name__}: {e}")
                except zipfile.BadZipFile as e:
                    yield row(archive, error=f"{type(e).__name__}: {e}")

    return files.select("path", "content").mapInPandas(run, "archive string, path string, content binary, supported boolean, error string")


def write_report(df: DataFrame, path: str) -> None:
    """CSV with all fields quoted."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)
