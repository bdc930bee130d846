"""One consistent form for text that looks alike but differs in its characters.

A batch of Arrow strings is copied once into a numpy array of code points. Everything after that is
table look-ups over the array (gathers), expansions by offsets, and comparisons of neighbours; no
string method is called per row. The tables are made from the Unicode data of the running Python.

Steps: presentation forms (full-width, half-width, mathematical, positional, ligatures) are expanded,
odd spaces become U+0020, invisible characters are dropped, twins of other characters (Angstrom, Ohm) become
those, base letters are composed with the marks that follow them and Hangul letters to syllables, and inside words of mixed scripts look-alike letters take the script of the word.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources import spread

#: What a text was found to hold; the bits of ``findings``.
PRESENTATION, MARK, INVISIBLE, SPACE, LOOKALIKE, SIGN = 1, 2, 4, 8, 16, 32
#: A value counts as found by any of these; SIGN (a full-width sign, say) is only brought into form.
COUNTED = PRESENTATION | MARK | INVISIBLE | SPACE | LOOKALIKE

LATIN, CYRILLIC, GREEK, OTHER = 1, 2, 4, 8

# Letters that look like a Latin one, by script.
_CYRILLIC = dict(zip("АВЕКМНОРСТУХЅІЈаеорсухѕіјһԁԛԝ", "ABEKMHOPCTYXSIJaeopcyxsijhdqw", strict=True))
#: Of these, letters so rare that their Latin twins speak for a Latin word.
_RARE = frozenset("ЅІЈѕіјһԁԛԝ")
_GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρ", "ABEZHIKMNOPTYXovp", strict=True))
_FORMS = {"<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}
_LINE_ENDS = {0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029}
_TOP = 0x110000


def _invisible(cp: int, category: str) -> bool:
    if category == "Cf":
        return not 0x0600 <= cp <= 0x0605 and cp not in (0x06DD, 0x070F, 0x08E2, 0x110BD, 0x110CD)  # those are drawn
    if category == "Cc":
        return cp not in _LINE_ENDS
    return cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= cp <= 0x180F or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF


class _Tables:
    """Look-up tables by code point."""

    def __init__(self) -> None:
        self.flag = np.zeros(_TOP, np.uint8)
        self.script = np.zeros(_TOP, np.uint8)
        self.mark = np.zeros(_TOP, np.uint8)  # canonical combining class, 255 for marks of class 0
        self.pictograph = np.zeros(_TOP, bool)
        self.composite = np.zeros(_TOP, bool)  # has a canonical decomposition
        self.length = np.ones(_TOP, np.uint8)
        self.place = np.zeros(_TOP, np.int32)  # where the expansion of a code point begins in self.pool
        self.to = {LATIN: np.arange(_TOP, dtype=np.uint32), CYRILLIC: np.arange(_TOP, dtype=np.uint32), GREEK: np.arange(_TOP, dtype=np.uint32)}
        self.resembles = np.zeros(_TOP, np.uint8)
        self.unsure = np.zeros(_TOP, bool)  # letters that tell nothing of a word's script
        pool: list[int] = []
        pairs: dict[int, int] = {}
        for cp in range(0x80, _TOP):
            if 0xD800 <= cp < 0xE000 or 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xD7A4 or 0x20000 <= cp < 0x2F800 or 0x30000 <= cp < 0xE0000 or cp >= 0xF0000:
                continue  # ideographs, Hangul syllables, private use: letters without another form
            ch = chr(cp)
            category = unicodedata.category(ch)
            if category == "Cn":
                continue
            decomposition = unicodedata.decomposition(ch)
            self.composite[cp] = bool(decomposition) and decomposition[0] != "<"
            form = decomposition.split(" ", 1)[0] if decomposition.startswith("<") else ""
            if _invisible(cp, category):
                self.flag[cp], self.length[cp] = INVISIBLE, 0
            elif category == "Zs":
                self.flag[cp] = SPACE
                self._expand(cp, " ", pool)
            elif form in _FORMS or form == "<compat>" and "LIGATURE" in unicodedata.name(ch, ""):
                plain = unicodedata.normalize("NFKD", ch) if form in ("<wide>", "<narrow>") else unicodedata.normalize("NFKC", ch)
                self.flag[cp] = PRESENTATION if any(unicodedata.category(x)[0] in "LN" for x in plain) else SIGN
                self._expand(cp, plain, pool)
            elif decomposition and (not form and unicodedata.normalize("NFC", ch) != ch or form == "<compat>" and category == "Nl"):
                self.flag[cp] = SIGN  # twins of other characters (Angstrom, Ohm, compatibility ideographs), letters as numerals
                self._expand(cp, unicodedata.normalize("NFKC", ch), pool)
            if category[0] == "M":
                self.mark[cp] = unicodedata.combining(ch) or 255
            elif category[0] == "L":
                name = unicodedata.name(ch, "")
                self.script[cp] = LATIN if name.startswith(("LATIN ", "FULLWIDTH LATIN")) else CYRILLIC if name.startswith("CYRILLIC") else GREEK if name.startswith("GREEK") else OTHER
            elif category == "So" or 0x1F3FB <= cp <= 0x1F3FF:
                self.pictograph[cp] = True
            if decomposition and not form and " " in decomposition and unicodedata.normalize("NFC", ch) == ch:
                base, mark = (int(x, 16) for x in decomposition.split(" "))
                pairs[base << 21 | mark] = cp
        for start, stop in ((0x3400, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x2F800), (0x30000, 0x33480)):
            self.script[start:stop] = OTHER
        for ch in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
            self.script[ord(ch)] = LATIN
        for cp in range(0x20):
            if cp not in _LINE_ENDS:
                self.flag[cp], self.length[cp] = INVISIBLE, 0
        self.flag[0x7F], self.length[0x7F] = INVISIBLE, 0
        for script, table in ((CYRILLIC, _CYRILLIC), (GREEK, _GREEK)):
            for own, latin in table.items():
                self.resembles[ord(own)] |= LATIN
                self.resembles[ord(latin)] |= script
                self.to[LATIN][ord(own)] = ord(latin)
                self.to[script][ord(latin)] = ord(own)
                self.unsure[ord(own)] = True
                if own not in _RARE:
                    self.unsure[ord(latin)] = True
        self.pool = np.array([*pool, 0], np.uint32)
        self.pairs = np.array(sorted(pairs), np.int64)
        self.composed = np.array([pairs[k] for k in sorted(pairs)], np.uint32)

    def _expand(self, cp: int, plain: str, pool: list[int]) -> None:
        self.length[cp], self.place[cp] = len(plain), len(pool)
        pool.extend(map(ord, plain))

    def compose(self, base: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """The composed character of each pair, 0 where there is none."""
        key = base.astype(np.int64) << 21 | mark.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.composed[at], 0).astype(np.uint32)


@functools.lru_cache(maxsize=1)
def _tables() -> _Tables:
    return _Tables()


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each text begins (one more for the end). Nulls are empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return points, before[offsets - offsets[0]].astype(np.int64)


def to_arrow(points: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The inverse of code_points."""
    data = points.astype("<u4").tobytes().decode("utf-32-le", "replace").encode()
    width = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(width[starts]), pa.py_buffer(data)])


def _by_text(values: np.ndarray, at: np.ndarray, starts: np.ndarray, out: np.ndarray) -> None:
    """Or the bits ``values``, found at positions ``at``, into ``out`` of the text that holds each."""
    if len(at):
        np.bitwise_or.at(out, np.searchsorted(starts, at, "right") - 1, values)


def _drop(points: np.ndarray, starts: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return points[keep], np.concatenate([[0], np.cumsum(keep)])[starts]


def _hangul(points: np.ndarray, starts: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Syllables for the letters they are made of: a leading consonant and a vowel first, then the final one."""
    if not ((points >= 0x1100) & (points < 0x1200)).any():
        return points, starts
    for final in (False, True):
        syllable = (points >= 0xAC00) & (points < 0xD7A4) & ((points - np.uint32(0xAC00)) % 28 == 0)
        left = syllable if final else (points >= 0x1100) & (points <= 0x1112)
        right = (points >= 0x11A8) & (points <= 0x11C2) if final else (points >= 0x1161) & (points <= 0x1175)
        right[starts[:-1][starts[:-1] < len(points)]] = False
        at = np.flatnonzero(left[:-1] & right[1:])
        if at.size:
            points = points.copy()
            if final:
                points[at] += points[at + 1] - np.uint32(0x11A7)
            else:
                points[at] = 0xAC00 + ((points[at] - np.uint32(0x1100)) * 21 + points[at + 1] - np.uint32(0x1161)) * 28
            _by_text(np.full(len(at), SIGN, np.uint8), at, starts, found)
            keep = np.ones(len(points), bool)
            keep[at + 1] = False
            points, starts = _drop(points, starts, keep)
    return points, starts


def unify(texts: pa.Array, forms: bool = True) -> tuple[np.ndarray, pa.Array | None]:
    """Findings of each text (bits) and, if ``forms``, its consistent form; nulls have no findings and stay null."""
    t = _tables()
    points, starts = code_points(texts)
    found = np.zeros(len(texts), np.uint8)
    if len(points) and (special := np.flatnonzero((points > 0x7E) | (points < 0x20))).size:
        flags = t.flag[points[special]]
        hit = flags != 0
        at, flags = special[hit], flags[hit].copy()
        # joiners and selectors inside emoji belong to them
        joins = (points[at] == 0x200D) | (points[at] == 0xFE0F) | (points[at] == 0xFE0E)
        if joins.any():
            k = np.flatnonzero(joins)
            before = points[np.maximum(at[k] - 1, 0)]
            fits = t.pictograph[before] | (before == 0xFE0F) | ((points[at[k]] != 0x200D) & np.isin(before, np.frombuffer("0123456789#*".encode("utf-32-le"), np.uint32)))
            fits &= ~np.isin(at[k], starts)
            after = points[np.minimum(at[k] + 1, len(points) - 1)]
            fits &= (points[at[k]] != 0x200D) | t.pictograph[after]
            drop = np.zeros(len(at), bool)
            drop[k[fits]] = True
            at, flags = at[~drop], flags[~drop]
        _by_text(flags, at, starts, found)

        # expansion of forms and removal of what can't be seen
        if len(at):
            length = np.ones(len(points), np.int64)
            length[at] = t.length[points[at]]
            begin = np.concatenate([[0], np.cumsum(length)])
            out = np.repeat(points, length)
            shift = np.repeat(t.place[points[at]].astype(np.int64) - begin[at], length[at])
            total = int(length[at].sum())
            inner = np.arange(total) - np.repeat(np.cumsum(length[at]) - length[at], length[at])
            where = np.repeat(begin[at], length[at]) + inner
            out[where] = t.pool[shift + where]
            points, starts = out, begin[starts]

        # composition of letters with the marks behind them
        marked = np.flatnonzero(t.mark[points] > 0)
        if marked.size:
            points = points.copy()
            first = np.concatenate([[True], np.diff(marked) != 1]) | np.isin(marked, starts)
            begin = marked[first]  # where each run of marks begins; its base stands before
            size = np.diff(np.append(np.flatnonzero(first), len(marked)))
            head = begin - 1
            based = (head >= 0) & ~np.isin(begin, starts)
            head = np.maximum(head, 0)
            letters = t.script[points[head]] > 0
            gone = np.zeros(len(points), bool)
            simple = based & (size == 1) & ~t.composite[points[head]]
            single = np.where(simple, t.compose(points[head], points[begin]), 0)
            k = np.flatnonzero(single)
            points[head[k]] = single[k]
            gone[begin[k]] = True
            counted = [head[k[letters[k]]]]
            # several marks may have to change places first: runs of one length are rows, every different row is normalised once
            runs = np.flatnonzero(~simple & (based | (size > 1)))
            left = np.where(based[runs], head[runs], begin[runs])
            width = begin[runs] + size[runs] - left
            for w in np.unique(width).tolist():
                mine = np.flatnonzero(width == w)
                where = left[mine][:, None] + np.arange(w)
                kinds, which = np.unique(points[where], axis=0, return_inverse=True)
                new, long = kinds.copy(), np.full(len(kinds), w)
                for k, row in enumerate(kinds):
                    form = np.frombuffer(unicodedata.normalize("NFC", row.tobytes().decode("utf-32-le")).encode("utf-32-le"), np.uint32)
                    if len(form) <= w:
                        new[k, : len(form)], long[k] = form, len(form)
                which = which.reshape(-1)
                points[where] = new[which]
                gone[where] = np.arange(w) >= long[which][:, None]
                counted.append(left[mine][(long[which] < w) & letters[runs[mine]] & based[runs[mine]]])
            at = np.concatenate(counted)
            _by_text(np.full(len(at), MARK, np.uint8), at, starts, found)
            points, starts = _drop(points, starts, ~gone)

        points, starts = _hangul(points, starts, found)

        # look-alike letters in words of several scripts
        script = t.script[points]
        foreign = np.flatnonzero((script == CYRILLIC) | (script == GREEK))
        if foreign.size:
            letter = (script > 0) | (t.mark[points] > 0)
            edge = letter & ~np.concatenate([[False], letter[:-1]])
            edge[starts[:-1][starts[:-1] < len(points)]] |= letter[starts[:-1][starts[:-1] < len(points)]]
            word = np.cumsum(edge)
            mine = np.unique(word[foreign])
            inside = np.flatnonzero(letter & np.isin(word, mine)) if len(mine) < len(points) else np.flatnonzero(letter)
            number = np.searchsorted(mine, word[inside])
            kind = script[inside]
            count = {s: np.bincount(number[kind == s], minlength=len(mine)) for s in (LATIN, CYRILLIC, GREEK)}
            like = t.resembles[points[inside]]
            sure = {s: np.bincount(number[(kind == s) & ~t.unsure[points[inside]]], minlength=len(mine)) for s in (LATIN, CYRILLIC, GREEK)}
            stack = np.stack([sure[s] * 10_000 + count[s] for s in (LATIN, CYRILLIC, GREEK)])
            own = np.array([LATIN, CYRILLIC, GREEK], np.uint8)[np.argmax(stack, axis=0)]

            def swaps(own: np.ndarray) -> np.ndarray:
                target = own[number]
                out = (kind != target) & (kind != 0) & (kind != OTHER) & ((like & target) != 0)
                # a sign such as Delta before a single Latin letter is no word of that script
                return out & ~((kind == LATIN) & (target == GREEK) & (count[GREEK][number] < 2))

            swap = swaps(own)
            # a word that keeps its mixture in the script chosen may be one of Latin look-alikes
            left = (np.bincount(number[swap], minlength=len(mine)) == 0) & (count[LATIN] > 0)
            if left.any():
                own = np.where(left, LATIN, own).astype(np.uint8)
                swap = swaps(own)
            target = own[number]
            if swap.any():
                _by_text(np.full(int(swap.sum()), LOOKALIKE, np.uint8), inside[swap], starts, found)
                points = points.copy()
                for s in (LATIN, CYRILLIC, GREEK):
                    k = inside[swap & (target == s)]
                    points[k] = t.to[s][points[k]]
    if texts.null_count:
        found[np.asarray(texts.is_null())] = 0
    if not forms:
        return found, None
    form = to_arrow(points, starts)
    if texts.null_count:
        form = pa.compute.if_else(texts.is_null(), None, form)
    return found, form


def consistent(rows: DataFrame, id_col: str, fields: list[str], forms: bool = True, rows_at_once: int = 512) -> DataFrame:
    """``record_id``, ``field_name``, ``findings`` and, if ``forms``, ``form`` of each value that holds anything.

    One row per value with findings; values without any are in form already. Null values, empty ones
    and those of an empty table give no row; repeated rows give repeated ones. Arrays are made of
    ``rows_at_once`` values, which bounds their memory by the texts and not by the batch.
    """
    import pyarrow.compute  # noqa: F401

    names = ["record_id", "field_name", "findings", *["form"] * forms]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for whole in batches:
            for start in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(start, rows_at_once)
                for k, field in enumerate(fields, 1):
                    found, form = unify(batch.column(k), forms)
                    hit = np.flatnonzero(found)
                    if len(hit):
                        at = pa.array(hit)
                        columns = [batch.column(0).take(at), pa.array([field] * len(hit)), pa.array(found[hit].astype(np.int32))]
                        yield pa.record_batch([*columns, *([form.take(at).cast(pa.string())] if forms else [])], names=names)

    chosen = rows.select(F.col(id_col).cast("string"), *(F.col(f) for f in fields))
    return spread(chosen).mapInArrow(run, "record_id string, field_name string, findings int" + ", form string" * forms)
