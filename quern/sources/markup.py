"""Pages and Markdown into titles, sections and code blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from quern.sources.tables import spread

SCHEMA = "title string, sections array<struct<heading: string, level: int, content: string, code_blocks: array<struct<language: string, code: string, caption: string>>, order_num: int>>"
_DROP = {"script", "style", "nav", "header", "footer", "aside", "noscript", "template", "iframe", "form", "svg", "dialog", "button"}
_BLOCK = {"p", "div", "li", "ul", "ol", "tr", "table", "section", "article", "main", "blockquote", "br", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "figure", "figcaption"}


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.sections = "", []
        self.open = {"heading": None, "level": 1, "content": [], "code_blocks": []}
        self.skip = 0
        self.buffer: list[str] | None = None
        self.mode = ""
        self.language = self.caption = None

    def _close(self) -> None:
        text = re.sub(r"[ \t]+", " ", "".join(self.open["content"]))
        text = re.sub(r" ?\n\s*", "\n", text).strip()
        if self.open["heading"] or text or self.open["code_blocks"]:
            self.sections.append({"heading": self.open["heading"], "level": self.open["level"], "content": text, "code_blocks": self.open["code_blocks"], "order_num": len(self.sections)})
        self.open = {"heading": None, "level": 1, "content": [], "code_blocks": []}

    def handle_starttag(self, tag, attrs) -> None:
        if tag in _DROP:
            self.skip += 1
        if self.skip:
            return
        if tag == "pre":
            self.mode, self.buffer, self.language = "pre", [], None
        elif tag == "code" and self.mode == "pre":
            m = re.search(r"(?:language|lang)-([\w+#-]+)", dict(attrs).get("class") or "")
            self.language = m[1] if m else None
        elif tag == "title" or re.fullmatch(r"h[1-6]", tag):
            self.mode, self.buffer = tag, []
        elif tag == "figcaption":
            self.mode, self.buffer = "figcaption", []
        elif tag in _BLOCK:
            self.open["content"].append("\n")

    def handle_endtag(self, tag) -> None:
        if tag in _DROP:
            self.skip = max(self.skip - 1, 0)
            return
        if self.skip or self.buffer is None or tag != self.mode:
            return
        text = "".join(self.buffer)
        if tag == "pre":
            if text.strip():
                self.open["code_blocks"].append({"language": self.language, "code": text.strip("\n"), "caption": self.caption})
            self.caption = None
        elif tag == "figcaption":
            self.caption = " ".join(text.split())
        elif tag == "title":
            self.title = self.title or " ".join(text.split())
        else:
            text = " ".join(text.split())
            if tag == "h1" and text:
                self.title = text
            self._close()
            self.open["heading"], self.open["level"] = text, int(tag[1])
        self.mode, self.buffer = "", None

    def handle_data(self, data) -> None:
        if self.skip:
            return
        if self.buffer is not None:
            self.buffer.append(data)
        else:
            self.open["content"].append(data)


def parse_html(source: str | None) -> tuple[str | None, list[dict]]:
    """Title and sections of a page; untidy mark-up is read as far as it goes."""
    if not source:
        return None, []
    page = _Page()
    page.feed(source)
    page.close()
    page._close()
    return page.title or None, page.sections


_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([\w+#-]*)\s*(.*)$")
_ATX = re.compile(r"^ {0,3}(#{1,6})\s+(.*?)\s*#*\s*$")


def front_matter(lines: list[str]) -> tuple[dict[str, str], list[str]]:
    """Keys of a leading block between dashes, and the lines behind it."""
    if not lines or lines[0].strip() != "---":
        return {}, lines
    for i, line in enumerate(lines[1:], 1):
        if line.strip() == "---":
            pairs = (x.split(":", 1) for x in lines[1:i] if ":" in x)
            return {k.strip(): v.strip().strip("\"'") for k, v in pairs}, lines[i + 1 :]
    return {}, lines


def parse_markdown(source: str | None) -> tuple[str | None, list[dict]]:
    """Title and sections of Markdown: fences first, then headings; inline marks are taken out."""
    if not source:
        return None, []
    meta, lines = front_matter(source.replace("\r\n", "\n").split("\n"))
    title = meta.get("title")
    sections: list[dict] = []
    now: dict = {"heading": None, "level": 1, "content": [], "code_blocks": []}
    fence = None
    code: list[str] = []
    info = ("", "")

    def close() -> None:
        text = re.sub(r"\n{3,}", "\n\n", "\n".join(now["content"])).strip()
        if now["heading"] or text or now["code_blocks"]:
            sections.append({**now, "content": text, "order_num": len(sections)})

    for line in lines:
        m = _FENCE.match(line)
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2]:
                now["code_blocks"].append({"language": info[0] or None, "code": "\n".join(code), "caption": info[1] or None})
                fence, code = None, []
            else:
                code.append(line)
            continue
        if m:
            fence, info = m[1], (m[2], re.sub(r"[{}\"]|title=", "", m[3]).strip())
            continue
        if line.startswith(":::"):
            continue
        if h := _ATX.match(line):
            text = _inline(h[2])
            if len(h[1]) == 1 and title is None:
                title = text
            close()
            now = {"heading": text, "level": len(h[1]), "content": [], "code_blocks": []}
            continue
        now["content"].append(_inline(line))
    if code:
        now["code_blocks"].append({"language": info[0] or None, "code": "\n".join(code), "caption": info[1] or None})
    close()
    return title, sections


def _inline(line: str) -> str:
    line = re.sub(r"!\[([^\]]*)\]\([^)]*\)", r"\1", line)
    line = re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", line)
    line = re.sub(r"(\*\*|__)(.+?)\1", r"\2", line)
    line = re.sub(r"(?<!\w)[*_]([^*_]+)[*_](?!\w)", r"\1", line)
    return re.sub(r"`([^`]*)`", r"\1", line)


_BLOCKS = pa.list_(pa.struct([("language", pa.string()), ("code", pa.string()), ("caption", pa.string())]))
_SECTIONS = pa.list_(pa.struct([("heading", pa.string()), ("level", pa.int32()), ("content", pa.string()), ("code_blocks", _BLOCKS), ("order_num", pa.int32())]))


def pages(rows: DataFrame, id_col: str, column: str, markdown: bool = False) -> DataFrame:
    """``id, title, sections`` of every row's mark-up; null gives a null title and no sections."""
    parse = parse_markdown if markdown else parse_html

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(x) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([t for t, _ in found], pa.string()), pa.array([s for _, s in found], _SECTIONS)], names=[id_col, "title", "sections"])

    chosen = rows.select(id_col, column)
    return spread(chosen).mapInArrow(run, f"`{id_col}` {chosen.schema[id_col].dataType.simpleString()}, {SCHEMA}")
