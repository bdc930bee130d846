"""The main body of web pages, by tree scoring.

A tolerant reader turns mark-up into a tree of block elements. Every paragraph gives points, for its
length and its commas, to its parent and half as many to its grandparent; a container's points are
discounted by the share of its text that lies in links, and the page's own heading adds to what holds it.
The best container is kept with those siblings that score like it; inside it, nested blocks that are
furniture (by element, by link density, or by what they say in full) are left out again.

The text dump of the same page has no tree. Its lines are aligned with the tree's lines in order and take
their verdicts; where there is no mark-up, the heading and the phrases that open a page's tail bound it.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.unify import _CYRILLIC, _GREEK
from quern.sources import spread

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template|head)\b[^>]*>.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
_INLINE = {"a", "abbr", "b", "big", "cite", "code", "em", "font", "i", "img", "input", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "td", "th", "time", "tt", "u", "var", "wbr"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "wbr"}
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "option": ("option",)}
_SCOPE = {"ul", "ol", "dl", "table", "body", "html"}
_SCORED = {"p", "pre", "li", "blockquote", "tr", "dd", "h1", "h2", "h3", "h4", "h5", "h6"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_FURNITURE = {"aside", "nav", "header", "footer", "dialog", "form", "menu", "button", "select", "iframe"}
_NAMED = re.compile(r"""(?:class|id|role)\s*=\s*["']?[^"'>]*\b(?:crumbs?|breadcrumbs?|menu|nav|navigation|sidebar|footer|banner|consent|cookies?|advert\w*|share|social|comments?|related|toc|btm)\b""", re.I)
_PATH = re.compile(r"\S [>»›] \S")

#: What furniture inside and after a body says, as whole lines. A parameter: pass other phrases for other sites.
PHRASES = (
    r"advertisement|advertising|sponsored|anzeige|werbung|publicité|publicidad|реклама|広告",
    r"(?:join|subscribe to) (?:our|the) newsletter\b.*|abonniere unseren\b.*|abonnieren sie\b.*|recevez nos nouvelles\b.*|abonnez-vous\b.*",
    r"enjoying the docs\?.*|support the team with\b.*|server hosting from\b.*",
    r"(?:we use cookies|cookies help us|this site (?:uses|stores)|your privacy matters|before you go on:|nous utilisons des cookies|diese seite (?:speichert|verwendet)|wir verwenden cookies).*",
    r"was this page helpful\b.*|war diese seite hilfreich\b.*|cette page vous a-t-elle aidée?\b.*",
    r"\d+ (?:people|readers) found this useful|\d+ leser fanden das nützlich|\d+ (?:personnes|lecteurs) .*",
    r"last updated .{0,40}|zuletzt geändert .{0,40}|mis à jour (?:il y a|le) .{0,40}",
    r"report a problem(?: with this page)?|edit this page|seite bearbeiten|modifier cette page|share this|teilen|partager|skip to content|back to top|nach oben|haut de page",
    r"(?:previous|next|zurück|weiter|vorherige|nächste|précédent|suivant)\s*:.*",
    r"on this page|table of contents|auf dieser seite|inhalt|sur cette page|sommaire",
    r"related articles|you may also like|popular this week|ähnliche artikel|articles liés|beliebt diese woche|populaire cette semaine",
    r"\d+ (?:comments?|kommentare?|commentaires?)|\S+ (?:wrote|schrieb|a écrit)\s*:|reply|antworten|répondre",
    r"\((?:c)\) \d{4}\b.*|© ?\d{4}\b.*|all trademarks belong\b.*|built with a static site generator|all rights reserved\.?",
)
#: Phrases that stand inside a body too; the others only before or after it.
_WITHIN = 4


class Phrases:
    """Compiled phrases; ``any`` matches furniture lines, ``tail`` those after which no body follows."""

    def __init__(self, phrases: tuple[str, ...] = PHRASES, within: int = _WITHIN):
        self.any = re.compile("|".join(f"(?:{p})" for p in phrases), re.I | re.S)
        self.tail = re.compile("|".join(f"(?:{p})" for p in phrases[within:]), re.I | re.S)


class _Node:
    __slots__ = ("chars", "commas", "cues", "furniture", "headings", "lines", "links", "parent", "score", "tag")

    def __init__(self, tag: str, parent: int, furniture: bool):
        self.tag, self.parent, self.furniture = tag, parent, furniture
        self.chars = self.links = self.commas = self.cues = self.headings = self.lines = 0
        self.score = 0.0


def _tree(source: str) -> tuple[list[_Node], list[list]]:
    """Block nodes, and the text entries as [node, text, chars in links, [(start, end) in the source]]."""
    nodes = [_Node("body", -1, False)]
    stack: list[tuple[str, int]] = [("body", 0)]  # open elements; inline ones carry the node around them
    entries: list[list] = []
    entry: list | None = None
    link = pre = 0
    at = 0
    current = 0
    for m in _TOKEN.finditer(source):
        start = m.start()
        if start > at:
            text = source[at:start]
            if not text.isspace():
                if pre:
                    place = at
                    for line in text.split("\n"):
                        if line and not line.isspace():
                            entries.append([current, line, 0, [(place, place + len(line))]])
                        place += len(line) + 1
                else:
                    if entry is None:
                        entry = [current, "", 0, []]
                        entries.append(entry)
                    entry[1] += text
                    entry[3].append((at, start))
                    if link:
                        entry[2] += len(text)
            elif entry is not None:
                entry[1] += " "
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            if tag == "a":
                link = max(link - 1, 0)
                continue
            if tag in _INLINE:
                if tag in ("td", "th"):
                    if entry is not None:
                        entry[1] += " "
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == tag:
                            del stack[k:]
                            break
                        if stack[k][0] == "table":
                            break
                    current = stack[-1][1]
                continue
            entry = None
            link = 0
            if stack[-1][0] == tag and len(stack) > 1:
                stack.pop()
                if tag == "pre":
                    pre = 0
                current = stack[-1][1]
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    if pre and any(t == "pre" for t, _ in stack[k:]):
                        pre = 0
                    del stack[k:]
                    break
                if stack[k][0] == "table":
                    break
            current = stack[-1][1]
            continue
        if tag in _VOID:
            if tag in ("br", "hr"):
                entry = None
            continue
        if tag == "a":
            link = 1
            continue
        if tag in _INLINE and tag not in ("td", "th"):
            continue
        if pre and tag not in ("pre",):
            # a block inside preformatted text means that its end tag is missing
            pre = 0
            while stack[-1][0] != "pre":
                stack.pop()
            stack.pop()
        if tag in ("td", "th"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ("td", "th"):
                    del stack[k:]
                    entry = None if not (entry is not None and nodes[entry[0]].tag == "tr") else entry
                    break
                if stack[k][0] in ("tr", "table"):
                    break
            if entry is not None:
                entry[1] += " "
            current = stack[-1][1]
            stack.append((tag, current))
            continue
        entry = None
        link = 0
        if stack[-1][0] == "p":
            stack.pop()
        closes = _CLOSES.get(tag)
        if closes:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in closes:
                    del stack[k:]
                    break
                if stack[k][0] in _SCOPE:
                    break
        if tag in ("body", "html"):
            continue
        parent = stack[-1][1]
        attrs = m[4]
        nodes.append(_Node(tag, parent, tag in _FURNITURE or bool(attrs and _NAMED.search(attrs))))
        current = len(nodes) - 1
        stack.append((tag, current))
        if tag == "pre":
            pre = 1
    text = source[at:]
    if text and not text.isspace():
        entries.append([current, text, 0, [(at, len(source))]])
    return nodes, entries


_DEFAULT = Phrases()


def body(source: str, title: str | None = None, phrases: Phrases = _DEFAULT) -> tuple[list[list], list[bool]]:
    """The text entries of a page in order (their texts made plain), and which of them belong to its body."""
    nodes, entries = _tree(source)
    cue: list[bool] = []
    for entry in entries:
        node, text, links, _ = entry
        entry[1] = text = " ".join((html.unescape(text) if "&" in text else text).split())
        n = nodes[node]
        hit = n.tag not in _HEADINGS and n.tag != "pre" and bool(phrases.any.fullmatch(text) or ((" > " in text or " » " in text or " › " in text) and _PATH.search(text) and (title is None or text.endswith(title))))
        cue.append(hit)
        length = len(text)
        n.lines += 1
        n.cues += hit
        n.chars += length
        n.links += min(links, length)
        if n.tag == "h1":
            n.headings += 1
        if not hit and n.tag in _SCORED and length >= 3:
            points = 1 + text.count(",") + text.count("、") + min(length / 100, 3) if length >= 25 or n.tag == "pre" else 0.2
            if n.tag == "h1":
                points += 25
            points *= 1 - min(links, length) / max(length, 1)
            parent = n.parent
            if n.tag in ("li", "tr") and nodes[parent].tag in ("ul", "ol", "table", "tbody"):
                parent = nodes[parent].parent
            if parent >= 0:
                nodes[parent].score += points
                if nodes[parent].parent >= 0:
                    nodes[nodes[parent].parent].score += points / 2
    if not entries:
        return entries, []
    for k in range(len(nodes) - 1, 0, -1):  # children come after their parents
        n, p = nodes[k], nodes[nodes[k].parent]
        p.chars += n.chars
        p.links += n.links
        p.lines += n.lines
        p.cues += n.cues
        p.headings += n.headings + (n.tag in _HEADINGS)
    final = [0.0 if n.furniture and n.tag != "header" else n.score * (1 - n.links / max(n.chars, 1)) for n in nodes]
    best = max(range(len(nodes)), key=lambda k: (final[k], -k))
    keep = [False] * len(nodes)
    keep[best] = True
    for k, n in enumerate(nodes):
        if k != best and n.parent == nodes[best].parent and best and not n.furniture and final[k] >= max(10.0, final[best] * 0.5) and not n.cues:
            keep[k] = True
    state = [0] * len(nodes)  # 1 inside the body, -1 furniture inside it
    for k, n in enumerate(nodes):
        above = state[n.parent] if n.parent >= 0 else 0
        if keep[k]:
            state[k] = 1
        elif above == -1:
            state[k] = -1
        elif above == 1:
            nested = n.tag not in _SCORED and n.tag not in ("ul", "ol", "dl", "table", "tbody", "thead")
            drop = n.furniture or (nested and n.cues and not n.headings) or (n.tag in ("ul", "ol", "section", "div") and n.lines >= 2 and n.links > 0.8 * n.chars)
            state[k] = -1 if drop else 1
    return entries, [state[e[0]] == 1 and not c for e, c in zip(entries, cue, strict=True)]


_SIGNS = bytes(c for c in range(128) if not chr(c).isalnum() and c != 10)
_LATIN = str.maketrans({**{own: latin for table in (_CYRILLIC, _GREEK) for own, latin in table.items()}, **dict.fromkeys(map(ord, "\u00ad\u200b\u200c\u200d\u2060\ufeff"))})


def plain(text: str, full: bool = True) -> str:
    """A text in which what looks alike is alike, line by line; for comparisons only. Not ``full``: its forms alone."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKC", text)
    return text.translate(_LATIN) if full else text


def _keys(text: str) -> list[bytes]:
    """Letters and digits of every line of a plain text, in one case."""
    return text.lower().encode("utf-8", "replace").translate(None, _SIGNS).split(b"\n")


def _line_starts(text: str) -> list[int]:
    out, at = [0], text.find("\n")
    while at >= 0:
        out.append(at + 1)
        at = text.find("\n", at + 1)
    return out


def html_lines(source: str, entries: list[list], kept: list[bool]) -> list[int]:
    """Numbers of the source's lines that hold text of kept entries."""
    starts = _line_starts(source)
    out: set[int] = set()
    for (_, _, _, spans), ok in zip(entries, kept, strict=True):
        if not ok:
            continue
        for a, b in spans:
            line = bisect_right(starts, a)
            for part in source[a:b].split("\n"):
                if part and not part.isspace():
                    out.add(line)
                line += 1
    return sorted(out)


def _align(lines: list[bytes], keys: list[bytes]) -> list[int]:
    """For each line the place of its partner among ``keys``, or -1; partners are in order.

    Keys that occur once on both sides are matched first (the longest increasing run of them), the
    gaps between are filled from left to right.
    """
    once: dict[bytes, int] = {}
    for k, key in enumerate(keys):
        once[key] = -1 if key in once else k
    mine: dict[bytes, int] = {}
    for i, line in enumerate(lines):
        mine[line] = -1 if line in mine else i
    pairs = [(i, once[line]) for i, line in enumerate(lines) if line and mine[line] == i and once.get(line, -1) >= 0]
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for n, (_, k) in enumerate(pairs):
        at = bisect_right(tails, k)
        if at == len(tails):
            tails.append(k)
            ends.append(n)
        else:
            tails[at], ends[at] = k, n
        back.append(ends[at - 1] if at else -1)
    out = [-1] * len(lines)
    n = ends[-1] if ends else -1
    while n >= 0:
        out[pairs[n][0]] = pairs[n][1]
        n = back[n]
    low = -1
    i = 0
    while i < len(lines):
        if out[i] >= 0:
            low = out[i]
            i += 1
            continue
        j = i
        while j < len(lines) and out[j] < 0:
            j += 1
        high = out[j] if j < len(lines) else len(keys)
        for x in range(i, j):
            if lines[x]:
                for k in range(low + 1, high):
                    if keys[k] == lines[x]:
                        out[x], low = k, k
                        break
        i = j
    return out


def _walk(lines: list[bytes], keys: list[bytes], kept: list[bool], reach: int = 8) -> list[int] | None:
    """The same for the body alone, in one walk from its first line on; None unless every body line finds its partner."""
    wanted = [k for k, ok in enumerate(kept) if ok and keys[k]]
    if not wanted:
        return None
    k, last = wanted[0], wanted[-1]
    try:
        i = lines.index(keys[k])
    except ValueError:
        return None
    out = [-1] * len(lines)
    n, found = len(lines), 0
    while i < n and k <= last:
        line, key = lines[i], keys[k]
        if not line:
            i += 1
        elif not key:
            k += 1
        elif line == key:
            out[i] = k
            found += kept[k]
            i += 1
            k += 1
        elif line in keys[k + 1 : k + reach]:
            k = keys.index(line, k + 1)
        elif key in lines[i + 1 : i + reach]:
            i = lines.index(key, i + 1)
        else:
            i += 1
            k += 1
    return out if found == len(wanted) else None


def content_lines(content: str, title: str | None, entries: list[list] | None, kept: list[bool] | None, phrases: Phrases = _DEFAULT) -> list[int]:
    """Numbers of the text dump's lines that belong to the body."""
    lines = content.split("\n")
    text = [bool(x and not x.isspace()) for x in lines]
    if entries:
        joined = "\n".join([e[1] for e in entries])
        places = _walk(_keys(plain(content, False)), _keys(plain(joined, False)), kept)
        if places is None:
            form = plain(content)
            lines, keys, others = form.split("\n"), _keys(form), _keys(plain(joined))
            places = _walk(keys, others, kept) or _align(keys, others)
        else:
            keys = _keys(content)
        verdict: list[bool | None] = [kept[k] if k >= 0 else None for k in places]
        if any(verdict):
            after: list[bool | None] = [None] * len(lines)
            following: bool | None = None
            for i in range(len(lines) - 1, -1, -1):
                after[i] = following
                following = verdict[i] if verdict[i] is not None else following
            before: bool | None = None
            out = []
            for i, v in enumerate(verdict):
                if v is None:
                    # signs only: as the line before; else of the body if between two lines of it that say so
                    v = bool(before and (after[i] or not keys[i])) and not phrases.any.fullmatch(plain(lines[i]).strip())
                else:
                    before = v
                if v and text[i]:
                    out.append(i + 1)
            return out
    form = plain(content)
    lines, keys, wanted = form.split("\n"), _keys(form), _keys(plain(title or ""))[0]
    start = next((i for i, k in enumerate(keys) if wanted and k == wanted), None)
    if start is None:
        start = next((i for i, x in enumerate(lines) if text[i] and len(x) >= 60 and not phrases.any.fullmatch(x.strip())), len(lines))
    stop = next((i for i in range(start + 1, len(lines)) if text[i] and phrases.tail.fullmatch(lines[i].strip())), len(lines))
    if stop == len(lines):
        # without a tail's opening phrase the last run of short lines with middle dots is the site's foot
        while stop > start + 1 and (not text[stop - 1] or " · " in lines[stop - 1] or phrases.any.fullmatch(lines[stop - 1].strip())):
            stop -= 1
    return [i + 1 for i in range(start, stop) if text[i] and not phrases.any.fullmatch(lines[i].strip())]


def body_lines(pages: DataFrame, phrases: tuple[str, ...] = PHRASES) -> DataFrame:
    """``document_id, field_name, line_no``: the lines of raw_html and of content that hold body text.

    A null or empty field gives no row; a page without mark-up is judged by its text dump alone, one
    without a title by its own heading. Rows are judged one by one, so nothing is shuffled and equal rows
    give equal results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Phrases(phrases)
        for batch in batches:
            ids: list[int] = []
            names: list[str] = []
            numbers: list[int] = []
            for key, title, content, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                entries = kept = None
                if source:
                    entries, kept = body(source, title, compiled)
                    found = html_lines(source, entries, kept)
                    ids.extend([key] * len(found))
                    names.extend(["raw_html"] * len(found))
                    numbers.extend(found)
                if content:
                    found = content_lines(content, title, entries, kept, compiled)
                    ids.extend([key] * len(found))
                    names.extend(["content"] * len(found))
                    numbers.extend(found)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(numbers, pa.int64())], names=["document_id", "field_name", "line_no"])

    chosen = pages.select("document_id", "title", "content", "raw_html")
    return spread(chosen).mapInArrow(run, "document_id bigint, field_name string, line_no bigint")
