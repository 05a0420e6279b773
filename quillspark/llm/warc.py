"""WARC derivative builder: responses to linked metadata and plain-text conversion records.

Each response record is parsed into its WARC headers, HTTP headers and body. Two records are
built from it: a metadata record (JSON with the source's headers, digests and links) and a
conversion record (the page's plain text). Both carry the response's identifier in
WARC-Refers-To, its target and date, and digests of their own block; the metadata record also
names the conversion record. Identifiers are name-based, so a repeated run gives the same ones.

Defined cases: a null page or URL counts as empty; bytes that are no WARC record give no
derivative and are reported in read_records() with kind "invalid"; a body that is not UTF-8
is read with replacement characters; text of any length is kept whole and read in linear time,
whatever its markup; repeated rows give repeated records; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATE = "2020-01-01T00:00:00Z"

#: Elements whose content is no text, and elements that end a line.
HIDDEN = {"script", "style", "noscript", "template"}
BREAKING = set("p div br li ul ol table tr h1 h2 h3 h4 h5 h6 article section nav header footer title blockquote pre hr dd dt dl form main aside".split())
LINKING = {"a", "img", "link", "script", "iframe", "form"}

_NAME = re.compile(r"</?([A-Za-z!][^\s/>]*)")
_CLOSE = {k: re.compile(rf"</{k}\s*>", re.I) for k in HIDDEN}
_ATTRIBUTE = re.compile(r"""\b(href|src|action)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


def markup(page: str) -> Iterator[tuple[str, str, str]]:
    """(text before, name, tag) of each tag in turn, and of the end with an empty name; every character is read once.

    A tag goes from "<" and a letter to the next ">"; without one the rest is text. Comments
    ("!--") and the content of HIDDEN elements belong to their tag; without an end they go on
    to the page's end.
    """
    at = look = 0
    while (i := page.find("<", look)) >= 0:
        if page.startswith("<!--", i):
            j = page.find("-->", i + 4)
            end = j + 3 if j >= 0 else len(page)
            yield page[at:i], "!--", ""
        elif not (m := _NAME.match(page, i)):
            look = i + 1
            continue
        else:
            j = page.find(">", m.end())
            if j < 0:
                break
            name, end = m[1].lower(), j + 1
            if name in HIDDEN and page[i + 1] != "/":
                close = _CLOSE[name].search(page, end)
                end = close.end() if close else len(page)
            yield page[at:i], name, page[i : j + 1]
        at = look = end
    yield page[at:], "", ""


def plain_text(page: str) -> str:
    """The visible text: a line for each block element, white space within a line as one space."""
    out = []
    for text, name, _ in markup(page):
        out += (text, "\n" if name in BREAKING else " " if name in HIDDEN or name == "!--" else "")
    lines = (" ".join(line.split()) for line in html.unescape("".join(out)).split("\n"))
    return "\n".join(line for line in lines if line)


def links(page: str) -> list[dict]:
    """The first target of each tag outside comments and hidden content."""
    found = ((name, _ATTRIBUTE.search(tag)) for _, name, tag in markup(page) if name in LINKING and tag[1] != "/")
    return [{"path": f"{name.upper()}@/{m[1].lower()}", "url": html.unescape(m[2] or m[3] or m[4] or "")} for name, m in found if m]


def title_of(page: str) -> str | None:
    """The text of the first title element that ends."""
    held = None
    for text, name, tag in markup(page):
        if held is not None:
            held.append(text)
            if name == "title":
                return " ".join(html.unescape("".join(held)).split())
        elif name == "title" and tag[1] != "/":
            held = []
    return None


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def identifier(*names) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, names)))}>"


def serialise(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.0", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _header_lines(raw: bytes) -> list[list[str]]:
    out: list[list[str]] = []
    for line in raw.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1][1] += " " + line.strip()  # a folded line
        elif ":" in line:
            k, _, v = line.partition(":")
            out.append([k.strip(), v.strip()])
    return out


def read_record(data: bytes, at: int = 0) -> tuple[list[list[str]], bytes] | None:
    """(headers, block) of the record at a place of data; None if there is none."""
    found = find_record(data, at)
    return (found[0], data[found[1] : found[2]]) if found else None


def find_record(data: bytes, at: int) -> tuple[list[list[str]], int, int] | None:
    """(headers, start and end of the block) of the record at a place of data, of which nothing but the headers is copied."""
    gap = data.find(b"\r\n\r\n", at)
    if gap < 0 or not data.startswith(b"WARC/", at):
        return None
    headers = _header_lines(data[at:gap].partition(b"\r\n")[2])
    size = next((v for k, v in headers if k.lower() == "content-length"), "")
    return (headers, gap + 4, min(gap + 4 + int(size), len(data))) if size.isascii() and size.isdigit() and len(size) < 19 else None


def response_record(key, url: str, page: str, date: str = DATE) -> bytes:
    """A response record as a crawler would write it."""
    url = re.sub(r"[\r\n]+", " ", url)
    body = page.encode("utf-8", "replace")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    headers = [
        ("WARC-Record-ID", identifier("response", key, url)), ("WARC-Target-URI", url), ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(http + body)),
    ]
    return serialise("response", headers, http + body)


def derive(record: bytes) -> list[tuple[str, str, str, str, str, bytes]]:
    """(kind, record id, refers-to, target, digest of the block, record) of both derivatives."""
    parsed = read_record(record)
    if parsed is None:
        return []
    headers, block = parsed
    get = lambda name, found=headers: next((v for k, v in found if k.lower() == name), "")
    if get("warc-type") != "response":
        return []
    source, target, date = get("warc-record-id"), get("warc-target-uri"), get("warc-date")
    top, _, body = block.partition(b"\r\n\r\n")
    status, _, rest = top.partition(b"\r\n")
    http = _header_lines(rest)
    charset = re.search(r"charset=([\w-]+)", get("content-type", http), re.I)
    try:
        page = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    text = plain_text(page).encode("utf-8", "replace")
    conversion, metadata = identifier("conversion", source), identifier("metadata", source)
    about = {
        "source": {"record-id": source, "headers": headers, "block-digest": get("warc-block-digest"), "payload-digest": get("warc-payload-digest"), "computed-payload-digest": digest(body)},
        "http": {"status": status.decode("latin-1"), "headers": http},
        "html": {"title": title_of(page), "links": links(page)},
        "conversion": conversion,
    }
    described = json.dumps(about, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "replace")
    out = []
    for kind, key, mime, own in (("metadata", metadata, "application/json", described), ("conversion", conversion, "text/plain; charset=utf-8", text)):
        given = [("WARC-Record-ID", key), ("WARC-Refers-To", source), ("WARC-Target-URI", target), ("WARC-Date", date), ("Content-Type", mime), ("WARC-Block-Digest", digest(own))]
        out.append((kind, key, source, target, digest(own), serialise(kind, given, own)))
    return out


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, record): pages as response records."""

    def write(batches):
        for b in batches:
            rows = zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([response_record(i, u or "", h or "") for i, u, h in rows], pa.binary())], names=["id", "record"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(write, f"id {kind}, record binary").withColumnRenamed("id", id_col)


_FIELDS = ("kind", "record_id", "refers_to", "target_uri", "block_digest")


def derivatives(records: DataFrame, id_col: str = "page_id", record_col: str = "record") -> DataFrame:
    """Two rows for each response record: (id_col, kind, record_id, refers_to, target_uri, block_digest, content_length, record)."""

    def build(batches):
        for b in batches:
            for start in range(0, b.num_rows, 512):
                cut = b.slice(start, 512)
                rows = [(i, *d) for i, r in zip(cut.column(0).to_pylist(), cut.column(1).to_pylist(), strict=True) for d in derive(r or b"")]
                columns = [pa.array([r[0] for r in rows], cut.schema[0].type), *(pa.array([r[k] for r in rows], pa.string()) for k in range(1, 6))]
                sizes = [len(r[6]) - r[6].index(b"\r\n\r\n") - 8 for r in rows]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array([r[6] for r in rows], pa.binary())], names=["id", *_FIELDS, "content_length", "record"])

    kind = records.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, {', '.join(f'{f} string' for f in _FIELDS)}, content_length long, record binary"
    return records.select(F.col(id_col).alias("id"), F.col(record_col).alias("record")).mapInArrow(build, schema).withColumnRenamed("id", id_col)


def read_records(files: DataFrame, content_col: str = "content") -> DataFrame:
    """(kind, record_id, target_uri, start, end, record) of all records in uncompressed files."""

    def read(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                data, at, rows = data or b"", 0, []
                while at < len(data):
                    parsed = find_record(data, at)
                    if parsed is None:
                        rows.append(("invalid", "", "", at, len(data), data[at:]))
                        break
                    headers, _, end = parsed
                    end = min(end + 4, len(data))
                    get = lambda name, found=headers: next((v for k, v in found if k.lower() == name), "")
                    rows.append((get("warc-type"), get("warc-record-id"), get("warc-target-uri"), at, end, data[at:end]))
                    at = end
                types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["kind", "record_id", "target_uri", "start", "end", "record"])

    return files.select(F.col(content_col).cast("binary")).mapInArrow(read, "kind string, record_id string, target_uri string, start long, end long, record binary")
