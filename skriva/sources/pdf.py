"""PDF in and out without a library: text with places from content streams, and plain reports as PDF and DOCX.

The reader knows Flate and ASCII-hex streams, object streams, simple fonts (Windows Latin) and fonts with a ToUnicode map. Text that it cannot decode is left
out; encrypted files raise. A scan runs one file per row in an Arrow-batched UDF; a broken page falls back to the plain strings of its content."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R\b")
TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+[\d*]*", re.S)
ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r?\n|.)", re.S)
# Escapes in the strings of a PDF.
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def unescaped(raw: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x[:1].isdigit() else b"" if x.endswith(b"\n") else ESCAPES.get(x, x)

    return ESCAPE.sub(one, raw[1:-1])


@dataclass
class Font:
    """Codes of ``width`` bytes; ``names`` maps them to text, else they are Windows Latin."""

    width: int = 1
    names: dict[int, str] | None = None
    shift: list[tuple[int, int, int]] = field(default_factory=list)

    def decode(self, raw: bytes) -> str:
        if self.names is None:
            return raw.decode("cp1252", "replace")
        units = b""
        for i in range(0, len(raw) - self.width + 1, self.width):
            code = int.from_bytes(raw[i : i + self.width], "big")
            if code in self.names:
                units += self.names[code].encode("utf-16-be", "surrogatepass")
            else:
                units += next((int.to_bytes(to + code - low, 2, "big") for low, high, to in self.shift if low <= code <= high), b"")
        return units.decode("utf-16-be", "replace")


class File:
    """The objects of a PDF file."""

    def __init__(self, content: bytes):
        if not content.startswith(b"%PDF-"):
            raise ValueError("no PDF header")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", content):
            raise ValueError("encrypted")
        self.objects = {int(n): body for n, body in OBJECT.findall(content)}
        for body in [b for b in self.objects.values() if b"/ObjStm" in b]:
            data, first = self.stream(body), int(re.search(rb"/First\s+(\d+)", body)[1])
            heads = list(map(int, data[:first].split()))
            for (n, at), end in zip(zip(heads[::2], heads[1::2], strict=False), [*heads[3::2], len(data) - first], strict=False):
                self.objects.setdefault(n, data[first + at : first + end])
        info = re.search(rb"/Info\s+(\d+)\s+\d+\s+R", content)
        self.info = self.objects.get(int(info[1]), b"") if info else b""

    def stream(self, body: bytes) -> bytes:
        m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
        if not m:
            return b""
        data, head = m[1], body[: m.start()]
        if b"ASCIIHexDecode" in head:
            data = bytes.fromhex(re.sub(rb"[\s>]", b"", data).decode())
        return zlib.decompressobj().decompress(data) if b"FlateDecode" in head else data

    def resolve(self, value: bytes) -> bytes:
        m = REFERENCE.match(value.strip())
        return self.objects.get(int(m[1]), b"") if m else value

    def entry(self, body: bytes, name: bytes) -> bytes:
        m = re.search(rb"/" + name + rb"\b\s*(\d+\s+\d+\s+R|<<.*|\[[^\]]*\]|\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f]*>|[^/\s>]+)", body, re.S)
        return m[1] if m else b""

    def title(self, name: bytes) -> str | None:
        raw = self.entry(self.info, name)
        raw = bytes.fromhex(raw[1:-1].decode()) if raw[:1] == b"<" else unescaped(raw) if raw[:1] == b"(" else b""
        return (raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")) or None

    def pages(self) -> list[bytes]:
        """The page objects in the order of the tree."""
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog", b)), b"")
        out, todo, seen = [], [self.entry(root, b"Pages")], set()
        while todo:
            ref = todo.pop(0)
            if ref in seen:
                continue
            seen.add(ref)
            body = self.resolve(ref)
            kids = self.entry(body, b"Kids")
            if kids:
                todo = [m[0] for m in REFERENCE.finditer(kids)] + todo
            elif body:
                out.append(body)
        return out

    def fonts(self, page: bytes) -> dict[bytes, Font]:
        resources = self.resolve(self.entry(page, b"Resources"))
        found = self.resolve(self.entry(resources, b"Font"))
        out = {}
        for name, ref in re.findall(rb"/([^\s/<>]+)\s+(\d+\s+\d+\s+R)", found):
            body = self.resolve(ref)
            font = Font()
            if b"/ToUnicode" in body:
                cmap = self.stream(self.resolve(self.entry(body, b"ToUnicode")))
                font = Font(2 if b"/Type0" in body else 1, {})
                number = lambda x: int(x, 16)
                for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
                    for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
                        font.names[number(a)] = bytes.fromhex(b.decode()).decode("utf-16-be", "replace")
                for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
                    font.shift += [(number(a), number(b), number(c)) for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)]
            out[name] = font
        return out

    def lines(self, page: bytes) -> list[tuple[float, float, float, float, float, str]]:
        """(x, y from the top, size, dx, dy, text) of each piece of text in the order of the content."""
        box = [float(x) for x in re.findall(rb"[-\d.]+", self.entry(page, b"MediaBox"))] or [0, 0, 612, 792]
        data = b"\n".join(self.stream(self.resolve(m[0])) for m in REFERENCE.finditer(self.entry(page, b"Contents")))
        fonts, out, held, stack = self.fonts(page), [], [], []
        font, size, leading, line, at = Font(), 10.0, 0.0, (1, 0, 0, 1, 0.0, 0.0), (1, 0, 0, 1, 0.0, 0.0)
        move = lambda m, x, y: (*m[:4], m[4] + x * m[0] + y * m[2], m[5] + x * m[1] + y * m[3])
        for m in TOKEN.finditer(data):
            t = m[0]
            if t[:1] in b"(<" and t != b"<":
                raw = unescaped(t) if t[:1] == b"(" else bytes.fromhex((s := re.sub(rb"\s", b"", t[1:-1]).decode()) + "0" * (len(s) % 2))
                held.append(font.decode(raw))
            elif t[:1].isdigit() or t[:1] in b"+-.":
                stack.append(float(t))
                if held and stack[-1] < -200:  # a wide gap in a TJ array is a space
                    held.append(" ")
            elif t[:1] == b"/":
                stack.append(t[1:])
            elif t not in (b"[", b"]"):
                if t == b"Tf" and len(stack) >= 2:
                    font, size = fonts.get(stack[-2], Font()), stack[-1]
                elif t == b"BT":
                    line = at = (1, 0, 0, 1, 0.0, 0.0)
                elif t == b"Tm" and len(stack) >= 6:
                    line = at = tuple(stack[-6:])
                elif t in (b"Td", b"TD") and len(stack) >= 2:
                    line = at = move(line, stack[-2], stack[-1])
                    leading = -stack[-1] if t == b"TD" else leading
                elif t == b"TL" and stack:
                    leading = stack[-1]
                elif t in (b"T*", b"'", b'"'):
                    line = at = move(line, 0, -leading)
                if t in (b"Tj", b"TJ", b"'", b'"') and held:
                    norm = (at[0] ** 2 + at[1] ** 2) ** 0.5 or 1.0
                    out.append((at[4], box[3] - at[5], size * norm, at[0] / norm, at[1] / norm, "".join(held)))
                stack, held = [], []
        return out


PAGES = "path string, page int, n_pages int, title string, author string, text string, extraction_method string, lines array<struct<x:double,y:double,size:double,dx:double,dy:double,text:string>>, error string"


def page_rows(path: str, content: bytes) -> Iterator[tuple]:
    try:
        f = File(content)
        pages = f.pages()
    except Exception as e:
        yield path, None, 0, None, None, None, None, [], f"{type(e).__name__}: {e}"
        return
    for n, page in enumerate(pages, 1):
        try:
            lines = f.lines(page)
            upright = sorted((x for x in lines if abs(x[3] - 1) < 0.05 and abs(x[4]) < 0.05 and x[5].strip()), key=lambda x: (round(x[1], 2), round(x[0], 2)))
            text, method = "\n".join(x[5] for x in upright), "layout"
        except Exception:
            lines, text, method = [], "\n".join(re.findall(r"\(([^()]*)\)\s*Tj", page.decode("latin-1"))), "legacy_fallback"
        text = text.replace("\0", "").strip()
        yield path, n, len(pages), f.title(b"Title"), f.title(b"Author"), text, method if text else "empty", lines, None


def pages(files: DataFrame) -> DataFrame:
    """SRC1-3: PAGES from (path, content) as the binary file source gives them; a file that cannot be read is one row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                yield pd.DataFrame(page_rows(path, bytes(content)), columns=[c.split()[0] for c in PAGES.split(", ")])

    return files.select("path", "content").mapInPandas(run, PAGES)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: all pages of the PDF files under a path."""
    return pages(spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path))


def text_pages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """SRC2: plain text as pages: form feeds part them; NULs and outer white space go."""
    p = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\f", -1)).alias("n", "t"))
    return p.select(key, (F.col("n") + 1).alias("page"), T.strip(F.col("t")).alias("text"))


# --- Out -----------------------------------------------------------------------------------------------------------------

CMAP = b"/CIDInit /ProcSet findresource begin begincmap 1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfrange <0000> <ffff> <0000> endbfrange endcmap end"


def write_pdf(lines: list[str], title: str | None = None, per_page: int = 40) -> bytes:
    """Lines of text as a PDF; a text's UTF-16 units are its codes, so any script can be read back."""
    parts = [lines[i : i + per_page] for i in range(0, len(lines), per_page)] or [[]]
    packed = lambda data, extra=b"": b"<< /Filter /FlateDecode" + extra + b" /Length %d >>\nstream\n%s\nendstream" % (len(z := zlib.compress(data)), z)
    name = "<" + ("\ufeff" + (title or "")).encode("utf-16-be").hex() + ">"
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % (7 + 2 * i) for i in range(len(parts))), len(parts)),
               b"<< /Type /Font /Subtype /Type0 /BaseFont /Helvetica /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R >>",
               b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Helvetica /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> >>", packed(CMAP), b"<< /Title " + name.encode() + b" >>"]
    for i, part in enumerate(parts):
        body = b"BT /F1 11 Tf\n" + b"".join(b"1 0 0 1 50 %d Tm <%s> Tj\n" % (800 - 18 * k, line.encode("utf-16-be", "surrogatepass").hex().encode()) for k, line in enumerate(part)) + b"ET"
        objects += [b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (8 + 2 * i), packed(body)]
    out, places = io.BytesIO(b"%PDF-1.5\n"), []
    out.seek(0, 2)
    for n, body in enumerate(objects, 1):
        places.append(out.tell())
        out.write(b"%d 0 obj\n%s\nendobj\n" % (n, body))
    table = out.tell()
    out.write(b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places))
    out.write(b"trailer << /Size %d /Root 1 0 R /Info 6 0 R >>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, table))
    return out.getvalue()


def write_docx(lines: list[str]) -> bytes:
    """Lines as paragraphs of a DOCX file; a line that begins with # is a heading."""
    escape = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    body = "".join(
        (f'<w:p><w:pPr><w:pStyle w:val="Heading{len(s) - len(s.lstrip("#"))}"/></w:pPr>' if s.startswith("#") else "<w:p>") + f'<w:r><w:t xml:space="preserve">{escape(s.lstrip("# ") if s.startswith("#") else s)}</w:t></w:r></w:p>' for s in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        files = {
            "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
            "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="word/document.xml" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"/></Relationships>',
            "word/document.xml": f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'}
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()


def docx_text(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        xml = z.read("word/document.xml").decode()
    texts = re.findall(r"<w:p>.*?</w:p>", xml, re.S)
    return "\n".join("".join(re.findall(r"<w:t[^>]*>(.*?)</w:t>", p, re.S)) for p in texts).replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&")


def artefacts(reports: DataFrame, key: str = "report_id", text: str = "markdown") -> DataFrame:
    """SNK2-3: (key, pdf, docx) of reports in Markdown, as bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            lines = [(t or "").split("\n") for t in f[text]]
            yield pd.DataFrame({key: f[key], "pdf": [write_pdf(x) for x in lines], "docx": [write_docx(x) for x in lines]})

    kind = reports.schema[key].dataType.simpleString()
    return reports.select(key, text).mapInPandas(run, f"`{key}` {kind}, pdf binary, docx binary")


def numbered_lines(pages_: DataFrame, key: str = "path") -> DataFrame:
    """The lines of scanned pages as rows (key, page_number, line, kind, dx, dy, text, size, x0, y0, x1, y1) for the layout operators; widths are estimated from
    the size."""
    x = pages_.select(key, F.col("page").alias("page_number"), F.posexplode("lines").alias("line", "l"))
    wide = F.col("l.x") + F.col("l.size") * 0.5 * F.length("l.text")
    return x.select(key, "page_number", "line", F.col("line").alias("source_index"), F.lit("text").alias("kind"), F.col("l.dx").alias("dx"), F.col("l.dy").alias("dy"), F.col("l.text").alias("text"), F.col("l.size").alias("size"),
                    F.col("l.x").alias("x0"), F.col("l.y").alias("y0"), wide.alias("x1"), (F.col("l.y") + F.col("l.size")).alias("y1"))


