"""Personal information in free text, found by a skip-chain conditional random field.

The nodes of the field are tokens and its labels begin and continue a kind (B-NAME, I-NAME, ...). Patterns
say which tokens can be part of anything at all: those of stretches shaped like an e-mail address, a number
or a postal address, runs of capitalised words, names in greetings, and single capitalised words that a run
of the same text holds too. Every other token is known to be outside, which cuts the chain into segments
without changing its marginals. Tokens of a segment are linked in a chain, and tokens of different segments
that are equal or similar (case, accents, possessive and parts of double names aside) are linked by skip
edges, so that a name clear in one place is seen in another. Labels come from loopy message passing over
both kinds of edges, for all documents of a batch at once, until nothing moves.

Features are shapes, the tokens' surroundings word by word, and what pattern a token lies in. Words that
occur in names of the sample are no features, so names are known by where they stand, by their shape and by
their other mentions. Weights lie in pii_weights.json; ``train`` fits them on a bounded sample (``SAMPLE``
texts at most) whose labels ``silver`` finds from a distance: surnames are those that e-mail addresses of
the sample end in.
"""

from __future__ import annotations

import functools
import json
import pkgutil
import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.sources import spread

KINDS = ("EMAIL", "PHONE", "ID", "ADDRESS", "NAME")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Class of each label: outside or a kind, whether it begins or continues.
_CLASS = np.array([0, *(1 + k for k in range(len(KINDS)) for _ in "BI")])
_MAY = {"email": ("EMAIL",), "number": ("PHONE", "ID"), "address": ("ADDRESS",), "name": ("NAME",)}
_NEVER = -1e4
_MASK = {what: np.array([0.0 if i == 0 or x[2:] in kinds else _NEVER for i, x in enumerate(LABELS)]) for what, kinds in _MAY.items()}
#: A kind is continued only behind itself.
_CHAIN = np.array([[_NEVER if b[0] == "I" and a[2:] != b[2:] else 0.0 for b in LABELS] for a in LABELS])
_START = np.array([_NEVER if b[0] == "I" else 0.0 for b in LABELS])
SAMPLE = 4000
TOGETHER = 512

_AT = r"(?:@|＠|\s?[(\[{<]\s?(?:at|AT|@)\s?[)\]}>]\s?|\s(?:at|AT)\s(?=[\w-]+\s(?:dot|DOT)\s))"
_DOT = r"(?:\.|\s?[(\[{<]\s?(?:dot|DOT|\.)\s?[)\]}>]\s?|\s(?:dot|DOT)\s)"
_EMAIL = re.compile(rf"(?<![\w.+@-])[A-Za-z0-9][\w.+-]*{_AT}[A-Za-z0-9][A-Za-z0-9-]*(?:{_DOT}[A-Za-z0-9][A-Za-z0-9-]*)*{_DOT}[A-Za-z]{{2,}}(?![\w-])")
_NUMBER = re.compile(
    r"(?<![\w.+/:@-])(?:\+\d[\d ()/.-]{6,}\d|\(\d{2,5}\)[ \d/.-]{5,}\d|\d[\d /.-]{5,}\d|[A-Z]{2}-\d{4}-\d{4}|[A-Z]{1,3}\d{6,9}|\d{7,9}-?[A-Z])(?![\w@])(?!\.\d)(?!-\w)"
)
_IBAN = re.compile(r"[A-Z]{2}\d{2} $")
_UP = "A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢĤĦĨĪĬĮİĶĹĻĽŁŃŅŇŌŎŐŒŔŖŘŚŜŞŠŢŤŨŪŬŮŰŲŴŶŸŹŻŽΑ-ΩЁА-Я"
_CAP = rf"[{_UP}][\w’'-]*"
#: A town has one word or two; of two, the second isn't the first of exactly two more, which are a name.
_TOWN = rf"{_CAP}+(?: {_CAP}+(?! {_CAP}+(?! {_CAP})))?"
_STREET = r"(?:Street|Road|Lane|Avenue|Ave|St|Rd|Drive|Dr|Court|Way|Boulevard|Blvd|Square|Terrace|Place|Close|Crescent|Row)\b\.?"
_UNIT = r"(?:Flat|Apt|Apartment|Unit|Suite)\.? \w+"
_ADDRESS = re.compile(
    rf"(?<![\w.-])(?:(?:{_UNIT}, )?\d{{1,5}}[A-Za-z]? (?:{_CAP} ){{1,3}}{_STREET}(?:, {_UNIT})?(?:, {_TOWN}(?: \d{{4,5}}\b)?)?"
    rf"|P\.?O\.? ?Box \d+(?:, {_TOWN})?|(?:Postfach|Apartado|BP) \d+(?:, (?:\d{{4,5}} )?{_TOWN})?"
    rf"|\d{{1,4}}(?: bis| ter)?,? (?:rue|avenue|boulevard|chemin|impasse|allée|quai|place)(?: (?:de la|des|du|de|d['’]))? {_CAP}(?:[ -]{_CAP})*(?:, \d{{4,5}} {_TOWN})?"
    rf"|{_CAP}(?:weg|straße|strasse|gasse|allee|platz|ring|damm|ufer|str\.) \d{{1,4}}[a-z]?\b(?:, \d{{4,5}} {_TOWN})?"
    rf"|(?:Calle|Avenida|Plaza) (?:{_CAP} ?){{1,3}},? \d{{1,4}}(?:, \d{{4,5}} {_TOWN})?)"
)
_PART = rf"(?:[{_UP}]\.|{_CAP})"
_NAMES = re.compile(rf"(?<![\w.#/@$-]){_PART}(?:(?:, | ){_PART})+")
_ALONE = re.compile(rf"(?<![\w.#/@$-]){_CAP}(?![\w@#/$(])")
#: Names that chat writes in lower case, where a greeting opens and something closes them.
_GREETED = re.compile(r"(?<![^\W_])(?:hi|hello|hey|hallo|bonjour|salut|hola|ciao|my name is|i am|i'm|ich bin|je suis|soy),? ([^\W\d_]+(?:-[^\W\d_]+)?(?: [^\W\d_]\.?)? [^\W\d_]+(?:-[^\W\d_]+)?)(?=,? (?:here|speaking|again)\b)", re.I)
_TOKENS = re.compile(r"[^\W_]+|[^\w\s]")
_PIECES = re.compile(r"[^\W_]+")
_WORDS = re.compile(r"[^\s,]+")
_DIGIT = re.compile(r"\d")
_LETTERS = re.compile(r"[^\W\d_]{4,}")

# What a text must hold for a pattern above to match anywhere; cheap tests that spare most texts the patterns.
_NUMBER_HINT = re.compile(r"\d[\d ()/.-]{5}")
_STREET_HINT = re.compile(rf"\d[A-Za-z]? [{_UP}]")
_RING_HINT = re.compile(r"ring \d")
_ADDRESS_WORDS = ("Box", "Postfach ", "Apartado ", "BP ", "rue ", "avenue ", "boulevard ", "chemin ", "impasse ", "allée ", "quai ", "place ", "Calle ", "Avenida ", "Plaza ", "weg ", "straße ", "strasse ", "gasse ", "allee ", "platz ", "damm ", "ufer ", "str. ")
_AT_WORDS = tuple(f"at{gap}{sign}" for gap in ("", " ", "\t", "\n") for sign in ")]}>")


def _may_hold_email(text: str, low: str) -> bool:
    return "@" in text or "＠" in text or any(map(low.__contains__, _AT_WORDS)) or "dot" in low and re.search(r"\sat\s[\w-]+\sdot\s", low) is not None


def _may_hold_address(text: str) -> bool:
    return any(map(text.__contains__, _ADDRESS_WORDS)) or _STREET_HINT.search(text) is not None or "ring " in text and _RING_HINT.search(text) is not None


@functools.lru_cache(maxsize=65536)
def _fold(word: str) -> str:
    """A word without case, accents and possessive."""
    word = word.casefold()
    if word.endswith(("'s", "’s")):
        word = word[:-2]
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    return word


class Segment:
    """Neighbouring tokens that may be personal information, as (start, end) each; what lies around is outside."""

    __slots__ = ("end", "greeted", "start", "tokens", "what")

    def __init__(self, what: str, tokens: list[tuple[int, int]], greeted: bool = False):
        self.what, self.tokens, self.greeted = what, tokens, greeted
        self.start, self.end = tokens[0][0], tokens[-1][1]


def segments(text: str) -> list[Segment]:
    """The segments of a text in order; none overlaps another."""
    starts: list[int] = []  # of the stretches taken, in order, with their ends
    ends: list[int] = []
    out: list[Segment] = []

    def free(a: int, b: int) -> bool:
        k = bisect_left(starts, b)
        return k == 0 or ends[k - 1] <= a

    def add(a: int, b: int, what: str, greeted: bool = False) -> None:
        if free(a, b):
            k = bisect_left(starts, a)
            starts.insert(k, a)
            ends.insert(k, b)
            if greeted:
                out.append(Segment(what, [(m.start(), m.end()) for m in _WORDS.finditer(text, a, b)], True))
                return
            pieces = [(m.start(), m.end()) for m in _PIECES.finditer(text, a, b)]
            pieces[0], pieces[-1] = (a, pieces[0][1]), (pieces[-1][0] if len(pieces) > 1 else a, b)
            out.append(Segment(what, pieces))

    low = text.lower()
    if _may_hold_email(text, low):
        for m in _EMAIL.finditer(text):
            add(m.start(), m.end(), "email")
    if _may_hold_address(text):
        for m in _ADDRESS.finditer(text):
            add(m.start(), m.end(), "address")
    if _NUMBER_HINT.search(text):
        for m in _NUMBER.finditer(text):
            if len(_DIGIT.findall(m[0])) >= 7 and not _IBAN.search(text, max(0, m.start() - 5), m.start()):
                add(m.start(), m.end(), "number")
    if " here" in low or " speaking" in low or " again" in low:
        for m in _GREETED.finditer(text):
            add(m.start(1), m.end(1), "name", True)
    held: set[str] = set()
    for m in _NAMES.finditer(text):
        run: list[tuple[int, int]] = []
        for x in _WORDS.finditer(text, m.start(), m.end()):
            a, b = x.start(), x.end()
            if free(a, b):
                if text[b - 2 : b] in ("'s", "’s"):
                    b -= 2
                run.append((a, b))
                continue
            if len(run) > 1:
                out.append(Segment("name", run))
            run = []
        if len(run) > 1:
            out.append(Segment("name", run))
    names = [s for s in out if s.what == "name"]
    for s in names:
        held.update(text[a:b] for a, b in s.tokens if b - a >= 4)
        for a, b in s.tokens:
            if "-" in text[a:b]:
                held.update(w for w in text[a:b].split("-") if len(w) >= 4)
    if held:
        names.sort(key=lambda s: s.start)
        begin, stop = [s.start for s in names], [s.end for s in names]
        for m in _ALONE.finditer(text):
            word = m[0][:-2] if m[0].endswith(("'s", "’s")) else m[0]
            if word in held and free(m.start(), m.end()):
                k = bisect_left(begin, m.end())
                if k == 0 or stop[k - 1] <= m.start():
                    out.append(Segment("name", [(m.start(), m.start() + len(word))]))
    out.sort(key=lambda s: s.start)
    return out


@functools.lru_cache(maxsize=65536)
def _form(word: str) -> str:
    """Kind of a token by its characters."""
    if not word[:1].isalnum():
        return word[:1]
    if word[0].isdigit():
        return "9"
    if len(word) == 1 or len(word) == 2 and word[1] == ".":
        return "I"
    if not word[0].isupper():
        return "l"
    if any(c.isdigit() or c == "_" for c in word):
        return "D"
    if word.isupper():
        return "U"
    if "-" in word:
        return "H"
    return "C" if word[1:].islower() else "M"


def _shape(text: str) -> str:
    return re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", text)))


def _around(text: str, a: int, b: int) -> tuple[list[str], list[str]]:
    before = _TOKENS.findall(text[max(0, a - 40) : a].rpartition("\n")[2])
    after = _TOKENS.findall(text[b : b + 40].partition("\n")[0])
    return ["^", "^", "^", *before][-3:], [*after[:3], "$", "$", "$"][:3]


def features(text: str, s: Segment) -> list[list[str]]:
    """Names of the features of each token of a segment."""
    before, after = _around(text, s.start, s.end)
    if s.what != "name":
        k = s.what
        whole = text[s.start : s.end]
        head = [f"{k} B", *(f"{k} p{3 - i}={w.lower()}" for i, w in enumerate(before)), *(f"{k} n{i + 1}={w.lower()}" for i, w in enumerate(after))]
        if k == "email":
            local, _, domain = re.split(r"(@|＠|\s?[(\[{<]\s?(?:at|AT|@)\s?[)\]}>]\s?|\s(?:at|AT)\s)", whole, maxsplit=1)
            head.append("email short" if len(local) < 5 else "email long")
            head.append("email camel" if local[:1].isupper() and not local.isupper() else "email plain")
            head.append(f"email touch={text[s.end : s.end + 1]}" if text[s.end : s.end + 1] in ("(", ":", "/", "#") else "email free")
            head.append("email numbered" if local[-1:].isdigit() else "email parts" if any(c in local for c in "._+") else "email word")
        elif k == "number":
            shape = _shape(whole)
            head.append(f"number shape={shape}")
            head.append(f"number groups={' '.join(str(min(len(x), 5)) for x in _PIECES.findall(whole)[:5])}")
            head.append("number plus" if whole[0] == "+" else "number bracket" if whole[0] == "(" else "number 00" if whole[:2] == "00" else "number 0" if whole[0] == "0" else "number bare")
        else:
            head.append("address town" if "," in whole else "address bare")
        return [head, *([f"{k} I"] for _ in s.tokens[1:])]
    row: list[str] = list(before)
    at = []
    for a, b in s.tokens:
        at.append(len(row))
        row.append(text[a:b])
        if text[b : b + 1] == ",":
            row.append(",")
    if row[-1] == ",":
        row.pop()
    row += after
    forms = [_form(w) for w in row]
    words = [w.lower() for w in row]
    line = text.rfind("\n", 0, s.start) + 1
    code = text.startswith("    ", line)
    out = []
    n = len(at)
    for j, i in enumerate(at):
        f = forms[i]
        out.append([
            f"f={f}", f"w={words[i]}", f"p1={words[i - 1]}", f"p2={words[i - 2]}", f"p3={words[i - 3]}", f"n1={words[i + 1]}", f"n2={words[i + 2]}",
            f"n3={words[i + 3]}" if i + 3 < len(words) else "n3=$", f"pf={forms[i - 1]}{f}", f"nf={f}{forms[i + 1]}", f"ff={forms[i - 1]}{f}{forms[i + 1]}",
            f"size={min(n, 4)} {min(j, 3)}", "code" if code else "text", *(["greeted"] if s.greeted else []),
        ])
    return out


def links(text: str, s: Segment) -> list[list[str]]:
    """Under what each token of a segment is linked with tokens of other segments."""
    if s.what == "number":
        return [["#" + "".join(c for c in text[s.start : s.end] if c.isalnum())], *([] for _ in s.tokens[1:])]
    if s.what != "name":
        return [[] for _ in s.tokens]
    out = []
    for a, b in s.tokens:
        word = _fold(text[a:b])
        out.append([w for w in (word.split("-") if "-" in word else (word,)) if len(w) >= 4])
    return out


class Doc:
    """A text's segments with the features and links of their tokens."""

    __slots__ = ("features", "links", "segments", "text")

    def __init__(self, text: str):
        self.text = text
        self.segments = segments(text)
        self.features = [features(text, s) for s in self.segments]
        self.links = [links(text, s) for s in self.segments]


class Graph:
    """Nodes, masks and edges of several documents at once; an edge always goes to a later node."""

    def __init__(self, docs: list[Doc]):
        mask, chain, skip, first, last, of = [], [], [], [], [], []
        n = 0
        for d, doc in enumerate(docs):
            holders: dict[str, int] = {}
            joined: set[tuple[int, int]] = set()
            for s, keys in zip(doc.segments, doc.links, strict=True):
                first.append(n)
                for j, ks in enumerate(keys):
                    if j:
                        chain.append((n - 1, n))
                    for k in ks:
                        # to the nearest before it: the chain of equal ones connects them all
                        at = holders.get(k, -1)
                        if 0 <= at < first[-1] and (at, n) not in joined:
                            joined.add((at, n))
                            skip.append((at, n))
                        holders[k] = n
                    mask.append(_MASK[s.what])
                    of.append(d)
                    n += 1
                last.append(n - 1)
        self.size = n
        self.doc = np.array(of, np.int64)
        self.mask = np.array(mask).reshape(n, len(LABELS))
        self.first, self.last = np.array(first, np.int64), np.array(last, np.int64)
        self.edges = np.array(chain + skip, np.int64).reshape(-1, 2)
        self.is_skip = np.arange(len(self.edges)) >= len(chain)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


class Model:
    """Weights of features by label, of neighbouring labels, of ends of segments, and of classes over skip edges."""

    def __init__(self, names: dict[str, int], unary: np.ndarray, chain: np.ndarray, ends: np.ndarray, skip: np.ndarray):
        self.names, self.unary, self.chain, self.ends, self.skip = names, unary, chain, ends, skip

    @classmethod
    def load(cls, data: bytes) -> Model:
        raw = json.loads(data)
        names = {n: i for i, n in enumerate(raw["unary"])}
        return cls(names, np.array(list(raw["unary"].values()), float).reshape(-1, len(LABELS)), *(np.array(raw[k], float) for k in ("chain", "ends", "skip")))

    def ids(self, docs: list[Doc]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the known features of all nodes in a row, and where each node's begin; every node has the bias."""
        flat: list[int] = []
        at: list[int] = []
        get = self.names.get
        for doc in docs:
            for segment in doc.features:
                for feats in segment:
                    at.append(len(flat))
                    flat.append(0)
                    flat.extend([i for i in map(get, feats) if i is not None])
        return np.array(flat, np.int64), np.array(at, np.int64)

    def scores(self, ids: tuple[np.ndarray, np.ndarray], graph: Graph) -> np.ndarray:
        if not graph.size:
            return np.zeros((0, len(LABELS)))
        out = graph.mask + np.add.reduceat(self.unary[ids[0]], ids[1])
        out[graph.first] += _START + self.ends[0]
        out[graph.last] += self.ends[1]
        return out

    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        return np.exp(np.maximum(_CHAIN + self.chain, -60.0)), np.exp(self.skip[np.ix_(_CLASS, _CLASS)])

    def beliefs(self, scores: np.ndarray, graph: Graph, tolerance: float = 1e-3, rounds: int = 24) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of nodes and edges by loopy sum-product message passing.

        All documents' messages move together at first; a document whose messages stand still drops out. What
        moves after ``rounds`` rounds is swept edge by edge from the first token to the last and back, so that
        a label reaches any distance in one sweep, and swept again until it stands still; if it circles, later
        sweeps are damped ever more, which ends it.
        """
        top = scores.max(axis=1, keepdims=True)
        node = np.exp(np.maximum(scores - top, -60.0))
        edges, size = graph.edges, len(LABELS)
        if not len(edges):
            return _unit(node), np.zeros((0, size, size))
        chain, skip = self.factors()
        factor = np.where(graph.is_skip[:, None, None], skip, chain)
        ahead, back = np.full((len(edges), size), 1 / size), np.full((len(edges), size), 1 / size)
        la, lb = np.log(ahead), np.log(back)
        into = np.zeros((len(scores), size))
        np.add.at(into, edges[:, 1], la)
        np.add.at(into, edges[:, 0], lb)
        of = graph.doc[edges[:, 0]]
        act = np.arange(len(edges))
        for _ in range(rounds):
            a, b = edges[act, 0], edges[act, 1]
            new_a = _unit(np.einsum("ei,eij->ej", node[a] * np.exp(_level(into[a] - lb[act])), factor[act]))
            new_b = _unit(np.einsum("ej,eij->ei", node[b] * np.exp(_level(into[b] - la[act])), factor[act]))
            moved = np.maximum(np.abs(new_a - ahead[act]).max(axis=1), np.abs(new_b - back[act]).max(axis=1)) > tolerance
            ahead[act], back[act] = new_a, new_b
            fresh_a, fresh_b = np.log(new_a + 1e-30), np.log(new_b + 1e-30)
            np.add.at(into, b, fresh_a - la[act])
            np.add.at(into, a, fresh_b - lb[act])
            la[act], lb[act] = fresh_a, fresh_b
            live = np.zeros(graph.doc[-1] + 1, bool)
            live[of[act][moved]] = True
            act = act[live[of[act]]]
            if not len(act):
                break
        if len(act):
            self._sweep(act[np.lexsort((edges[act, 1], edges[act, 0]))], edges, factor, node, la, lb, into, tolerance)
        belief = _unit(node * np.exp(_level(into)))
        out_a = node[edges[:, 0]] * np.exp(_level(into[edges[:, 0]] - lb))
        out_b = node[edges[:, 1]] * np.exp(_level(into[edges[:, 1]] - la))
        both = out_a[:, :, None] * factor * out_b[:, None, :]
        return belief, both / both.sum(axis=(1, 2), keepdims=True)

    @staticmethod
    def _sweep(order: np.ndarray, edges: np.ndarray, factor: np.ndarray, node: np.ndarray, la: np.ndarray, lb: np.ndarray, into: np.ndarray, tolerance: float) -> None:
        backwards = order[np.argsort(-edges[order, 1], kind="stable")]
        keep = 0.0
        for turn in range(1, 200):
            most = 0.0
            for way, these in ((0, order), (1, backwards)):
                mine, other = (la, lb) if way == 0 else (lb, la)
                for e in these.tolist():
                    a, b = edges[e, way], edges[e, 1 - way]
                    out = node[a] * np.exp(_level(into[a] - other[e]))
                    new = out @ factor[e] if way == 0 else factor[e] @ out
                    new = (1 - keep) * new / new.sum() + keep * np.exp(mine[e])
                    fresh = np.log(new + 1e-30)
                    most = max(most, float(np.abs(new - np.exp(mine[e])).max()))
                    into[b] += fresh - mine[e]
                    mine[e] = fresh
            if most <= tolerance:
                return
            keep = max(0.0, 1 - 10 / turn)

    def labels(self, docs: list[Doc], skips: bool = True, chain: bool = True) -> list[np.ndarray]:
        """The most probable label of every node, by document; without ``skips`` or ``chain`` as if there were none."""
        graph = Graph(docs)
        if not skips or not chain:
            kept = (graph.is_skip & skips) | (~graph.is_skip & chain)
            graph.edges, graph.is_skip = graph.edges[kept], graph.is_skip[kept]
        best = self.beliefs(self.scores(self.ids(docs), graph), graph)[0].argmax(axis=1) if graph.size else np.zeros(0, np.int64)
        stops = np.cumsum([0, *(sum(len(s.tokens) for s in doc.segments) for doc in docs)])
        return [best[a:b] for a, b in zip(stops, stops[1:], strict=False)]

    def label_all(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """Kind, start and end of each piece of personal information of each text."""
        out: list[list[tuple[str, int, int]]] = []
        for i in range(0, len(texts), TOGETHER):
            docs = [Doc(t) for t in texts[i : i + TOGETHER]]
            out.extend(_pieces(doc, best.tolist()) for doc, best in zip(docs, self.labels(docs), strict=True))
        return out

    def label(self, text: str) -> list[tuple[str, int, int]]:
        return self.label_all([text])[0]


def _level(x: np.ndarray) -> np.ndarray:
    return np.maximum(x - x.max(axis=-1, keepdims=True), -60.0)


def _pieces(doc: Doc, best: list[int]) -> list[tuple[str, int, int]]:
    """Runs of one kind. A single word is a name only as another mention of the first two words of one that has more."""
    out: list[tuple[str, int, int]] = []
    single: list[tuple[int, list[str]]] = []
    whole: set[str] = set()
    at = 0
    for s, keys in zip(doc.segments, doc.links, strict=True):
        k, n = 0, len(s.tokens)
        while k < n:
            label = best[at + k]
            if not label:
                k += 1
                continue
            kind, j = LABELS[label][2:], k + 1
            while j < n and best[at + j] and LABELS[best[at + j]] == f"I-{kind}":
                j += 1
            if kind == "NAME":
                full = [ks for ks in keys[k:j] if ks]
                if j - k > 1:
                    whole.update(w for ks in full[:2] for w in ks)
                else:
                    single.append((len(out), [w for ks in full for w in ks]))
            out.append((kind, s.tokens[k][0], s.tokens[j - 1][1]))
            k = j
        at += n
    drop = {i for i, held in single if not whole.intersection(held)}
    return [hit for i, hit in enumerate(out) if i not in drop] if drop else out


@functools.lru_cache(maxsize=2)
def _model(path: str | None = None) -> Model:
    """The weights of a file, or those of the package, which may lie in an archive."""
    return Model.load(Path(path).read_bytes() if path else pkgutil.get_data("quern.llm", "pii_weights.json"))


# ---- training -----------------------------------------------------------------------------------

#: Shapes of public identity numbers: fixed values.
_ID_SHAPES = frozenset(("999-99-9999", "999999-9999", "AA-9999-9999", "99 999 999 999", "A9999999", "AA9999999", "99999999A", "99999999-A"))
_PHONE_SHAPES = re.compile(r"\+\d|\(\d{2,5}\) ?\d|00\d{9,}|0\d{2,4}[/ ]\d|\d{3}-\d{3}-\d{4}$|0\d(?:\.\d\d){4}")
_NO_NUMBER = re.compile(r"(?i)\b(?:slots?|builds?|crash(?: id)?|commit|released on|code|version|revision|port)\s*[#:]?\s*$")


def surnames(docs: list[Doc], least: int = 2) -> set[str]:
    """Words in which several e-mail addresses end before their sign, without case and accents."""
    seen: dict[str, int] = defaultdict(int)
    for doc in docs:
        for s in doc.segments:
            if s.what == "email" and doc.text[s.end : s.end + 1] not in ("(", ":", "/", "#"):
                local = re.split(r"\+|@|＠|\s?[(\[{<]|\s", doc.text[s.start : s.end], maxsplit=1)[0]
                last = re.findall(r"[^\W\d_]+", local)[-1:]
                if last and len(last[0]) >= 5:
                    seen[_fold(last[0])] += 1
    return {w for w, n in seen.items() if n >= least}


def silver(doc: Doc, known: set[str]) -> list[int]:
    """A label for every node by rules of high precision; ``known`` are surnames."""
    out: list[int] = []
    text = doc.text
    code = {x: i for i, x in enumerate(LABELS)}
    for s, keys in zip(doc.segments, doc.links, strict=True):
        before, after = text[max(0, s.start - 40) : s.start], text[s.end : s.end + 2]
        whole, n = text[s.start : s.end], len(s.tokens)
        if s.what != "name":
            if s.what == "email":
                kind = None if whole.lower().startswith("git@") or after[:1] in ("(", ":", "/", "#") else "EMAIL"
            elif s.what == "address":
                kind = "ADDRESS"
            else:
                kind = None if _NO_NUMBER.search(before) else "ID" if _shape(whole) in _ID_SHAPES else "PHONE" if _PHONE_SHAPES.match(whole) else None
            out.extend([code[f"B-{kind}"]] + [code[f"I-{kind}"]] * (n - 1) if kind else [0] * n)
            continue
        sure = [any(w in known for w in ks) for ks in keys]
        short = [b - a == 1 or b - a == 2 and text[b - 1] == "." for a, b in s.tokens]
        comma = [text[b : b + 1] == "," for _, b in s.tokens]
        labels, j = [0] * n, 0
        while j < n:
            size = 0
            if n == 1:
                size = int(sure[j])
            elif sure[j] and comma[j] and j + 1 < n:  # surname first
                size = 3 if j + 2 < n and short[j + 2] and not comma[j + 1] else 2
            elif not comma[j] and j + 1 < n and sure[j + 1] and not short[j + 1]:
                size = 2
            elif not comma[j] and j + 2 < n and short[j + 1] and sure[j + 2]:
                size = 3
            if size:
                labels[j : j + size] = [code["B-NAME"]] + [code["I-NAME"]] * (size - 1)
            j += size or 1
        out.extend(labels)
    return out


_CONTEXT = re.compile(r"(?:p\d|n\d)=")


def mentions(texts: list[str], share: float, rng: np.random.Generator) -> list[str]:
    """Texts in a share of which one capitalised word gives way to a further mention of a name the text holds.

    Where it lands is chance, so its surroundings say nothing and only the first mention tells what it is. In
    half as many texts the name of another text follows one of its own without a sign between.
    """
    docs = [Doc(t) for t in texts]
    known = surnames(docs)
    out = []
    earlier: list[str] = []
    for doc in docs:
        labels, at, names = silver(doc, known), 0, []
        for s in doc.segments:
            n = len(s.tokens)
            if s.what == "name" and n == 2 and not s.greeted and labels[at] and labels[at + 1]:
                names.append(s)
            at += n
        if names and earlier and rng.random() < share / 2:
            s = names[rng.integers(len(names))]
            out.append(f"{doc.text[: s.end]} {earlier[rng.integers(len(earlier))]}{doc.text[s.end :]}")
            continue
        earlier.extend(doc.text[s.start : s.end] for s in names if "," not in doc.text[s.start : s.end])
        words = [m for m in _ALONE.finditer(doc.text) if not any(s.start < m.end() and m.start() < s.end for s in doc.segments)] if names else []
        if not words or rng.random() >= share:
            out.append(doc.text)
            continue
        s, m = names[rng.integers(len(names))], words[rng.integers(len(words))]
        a, b = s.tokens[1] if rng.random() < 0.5 else (s.start, s.end)
        out.append(doc.text[: m.start()] + doc.text[a:b] + doc.text[m.end() :])
    return out


def train(texts: list[str], epochs: int = 12, rate: float = 0.25, ridge: float = 2e-3, least: int = 3, seed: int = 7, hide: float = 0.2, again: float = 0.5) -> dict:
    """Weights from at most SAMPLE texts: maximum likelihood with marginals of loopy message passing.

    Words that stand in names of the sample are left out of the features. The surroundings of a share
    ``hide`` of the name segments are hidden in each epoch, and a share ``again`` of the texts with names
    gets a further mention in a place of chance, so that skip edges learn to carry a label.
    """
    rng = np.random.default_rng(seed)
    docs = [d for d in map(Doc, mentions(texts[:SAMPLE], again, rng)) if d.segments]
    known = surnames(docs)
    gold = [np.array(silver(d, known)) for d in docs]
    named: set[str] = set()
    for d, y in zip(docs, gold, strict=True):
        at = 0
        for s in d.segments:
            for a, b in s.tokens:
                if LABELS[y[at]][2:] == "NAME":
                    named.update(w.lower() for w in _LETTERS.findall(d.text[a:b]))
                    named.add(d.text[a:b].lower())
                at += 1
    named |= known
    counts: dict[str, int] = defaultdict(int)
    for d in docs:
        for f in {f for seg in d.features for feats in seg for f in feats}:
            counts[f] += 1
    usable = sorted(f for f, n in counts.items() if n >= least and not ("=" in f and f[f.index("=") + 1 :] in named and f[0] in "wpnea"))
    names = {"bias": 0} | {f: i + 1 for i, f in enumerate(usable)}
    hidden = np.array([bool(_CONTEXT.match(f)) for f in names])
    size = len(LABELS)
    model = Model(names, np.zeros((len(names), size)), np.zeros((size, size)), np.zeros((2, size)), np.zeros((len(KINDS) + 1,) * 2))
    parts = (model.unary, model.chain, model.ends, model.skip)
    sums = [np.full(p.shape, 1e-6) for p in parts]
    groups = [rng.permutation(len(docs)) for _ in range(epochs)]
    for order in groups:
        for k in range(0, len(order), 16):
            chosen = [docs[i] for i in order[k : k + 16]]
            graph = Graph(chosen)
            y = np.concatenate([gold[i] for i in order[k : k + 16]])
            flat, at = model.ids(chosen)
            owner = np.repeat(np.arange(graph.size), np.diff([*at, len(flat)]))
            segment = np.zeros(graph.size, np.int64)
            segment[graph.first] = 1
            off = rng.random(len(graph.first)) < hide
            keep = ~(hidden[flat] & off[np.cumsum(segment) - 1][owner])
            flat, owner = flat[keep], owner[keep]
            at = np.searchsorted(owner, np.arange(graph.size))
            belief, both = model.beliefs(model.scores((flat, at), graph), graph)
            gap = -belief
            gap[np.arange(len(y)), y] += 1
            grads = [np.zeros_like(p) for p in parts]
            np.add.at(grads[0], flat, gap[owner])
            grads[2][0], grads[2][1] = gap[graph.first].sum(axis=0), gap[graph.last].sum(axis=0)
            if len(graph.edges):
                ya, yb = y[graph.edges[:, 0]], y[graph.edges[:, 1]]
                c, s = ~graph.is_skip, graph.is_skip
                grads[1] -= both[c].sum(axis=0)
                np.add.at(grads[1], (ya[c], yb[c]), 1)
                fold = np.eye(len(KINDS) + 1)[_CLASS]
                grads[3] -= np.einsum("eij,ik,jl->kl", both[s], fold, fold)
                np.add.at(grads[3], (_CLASS[ya[s]], _CLASS[yb[s]]), 1)
            for p, g, q in zip(parts, grads, sums, strict=True):
                if p is model.unary:
                    rows = np.unique(flat)
                    g = g[rows] - ridge * p[rows]
                    q[rows] += g * g
                    p[rows] += rate * g / np.sqrt(q[rows])
                else:
                    g = g - ridge * p
                    q += g * g
                    p += rate * 0.3 * g / np.sqrt(q)
    r = lambda x: np.round(x, 3).tolist()
    return {"unary": {f: r(model.unary[i]) for f, i in names.items()}, "chain": r(model.chain), "ends": r(model.ends), "skip": r(model.skip)}


# ---- DataFrames ---------------------------------------------------------------------------------


def found(documents: DataFrame, weights: str | None = None) -> DataFrame:
    """``doc_id, kind, start_pos, end_pos`` of each piece of personal information.

    Null, empty and blank texts hold none; whole texts are read, and equal rows count once. Documents are
    judged by themselves, so nothing is shuffled but the result. ``weights`` is a file all executors can
    read; without it the package's own are taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(weights)
        for batch in batches:
            kept = [(key, text) for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) if text]
            rows = [(key, *hit) for (key, _), hits in zip(kept, model.label_all([t for _, t in kept]), strict=True) for hit in hits]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "kind", "start_pos", "end_pos"])

    chosen = documents.select("doc_id", "text").where("text is not null")
    return spread(chosen).mapInArrow(run, "doc_id bigint, kind string, start_pos bigint, end_pos bigint")


def mask(text: str, hits: list[tuple[str, int, int]]) -> str:
    """The text with each stretch replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, start, end in sorted(hits, key=lambda h: h[1]):
        out.append(text[at:start])
        out.append(f"<{kind}>")
        at = end
    return "".join([*out, text[at:]])


def masked(documents: DataFrame, weights: str | None = None) -> DataFrame:
    """``doc_id, text`` of every document with placeholders; null stays null, the rest of the text is unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(weights)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            hits = iter(model.label_all([t for t in texts if t]))
            yield pa.record_batch([batch.column(0), pa.array([mask(t, next(hits)) if t else t for t in texts], pa.string())], names=["doc_id", "text"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, text string")
