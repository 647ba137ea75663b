"""Personal information in free text: a skip-chain conditional random field over words and candidate chunks, and redaction."""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.runtime import spread

LABELS = ("O", "B", "I", "email", "phone", "id_number", "address")
KINDS = ("email", "phone", "id_number", "address", "name")
MODEL = Path(__file__).with_name("pii_model.json")
#: A model file larger than this is refused, as it is broadcast.
MAX_MODEL_BYTES = 8 << 20
#: Unary scores this far below the best one count as impossible; such words take no part in message passing.
PRUNE = 9.0
ROUNDS = 8

# looks ahead below pass over places at which what follows them can't match
_SEP = r"[    .\-/‐‑–]"
_CAP = r"[A-ZÀ-ÖØ-ÞŒ][\w’']*"
_TOWN = rf"{_CAP}(?:-[\w’']+)*(?:[  ](?:(?:de|del|la|las|los|sur|sous|am|an|der|im|bei|le|les|du|des)[  ])*{_CAP}(?:-[\w’']+)*)*"
_EMAIL = (
    r"(?<![\w.+'%-])[\w][\w.+'%-]*(?:[  ]?(?:@|＠|\(at\)|\[at\]|\{at\})[  ]?|[  ]AT[  ])"
    r"[\w-]+(?:(?:[  ]?(?:\[dot\]|\(dot\)|\{dot\})[  ]?|[  ]DOT[  ]|\.)[\w-]+)*(?:[  ]?(?:\[dot\]|\(dot\)|\{dot\})[  ]?|[  ]DOT[  ]|\.)[^\W\d_]{2,}(?![\w-])"
)
_US = (
    r"\d{1,6}[A-Za-z]?[  ](?:(?:N|S|E|W|North|South|East|West)\.?[ ])?(?:[A-Z][\w’']+\.?[ ]){1,3}(?i:Street|Avenue|Road|Lane|Boulevard|Drive|Court|Way|Place|Terrace|Circle|Square|Parkway|Highway|(?:St|Ave|Rd|Ln|Blvd|Dr|Ct|Pl|Ter|Cir|Sq|Pkwy|Hwy)\b)(?![\w])(?:(?<=[trdnlevy])\.(?=[,;\"'\n]|[ ]*(?:(?i:Apt|Unit|Suite|Flat)\b|\#)|\.))?"
    r"(?:(?:,[  ]?|\r?\n|[ ])(?:(?i:Apt|Unit|Suite|Flat|Ste|Floor|Room|Apartment)\.?[  ]?|\#[  ]?)\d+[A-Za-z]?\b)?"
    rf"(?:(?:,[  ]?|\r?\n)(?!(?:END|TEL|EMAIL|ADR|FN|N|ORG)\b){_TOWN}(?:,[  ]?[A-Z]{{2}}[  ]\d{{5}}(?:-\d{{4}})?\b|(?=[ ]*(?:[,.;:\"'|)]|\r?\n|$))))?"
)
_POST = rf"(?:(?:,[  ]?|\r?\n|[ ])(?:[A-Z]{{1,2}}-)?\d{{4,5}}[  ]{_TOWN})"
_DE = (
    r"(?:(?:(?:Große|Kleine|Alte|Neue|Obere|Untere|Hintere|Vordere|Lange|Kurze)[rsn]?[ ])?(?=[A-ZÄÖÜ][^\W\d]*+\.?\s?\d)[A-ZÄÖÜ][\wäöüß]*(?i:straße|strasse|str\.|weg|platz|allee|gasse|ring|damm|ufer|steig)|(?=[gG][rR]|[kK\u212a][lL]|[aA][lL]|[nN][eE]|[oO][bB]|[uU][nN]|[hH]\w|[lL][aA])(?i:Große|Kleine|Alte|Neue|Obere|Untere|Hintere|Lange)[rsn]?[ ](?i:Straße|Strasse|Gasse|Allee)"
    rf"|(?:Am|An[ ]der|An[ ]den|Im|In[ ]der|Zum|Zur|Auf[ ]dem|Auf[ ]der|Beim|Unter[ ]den|Hinter[ ]dem|AM|IM|ZUM|ZUR)[ ](?:{_CAP})(?:[ ]{_CAP})?)[  ]?\d{{1,4}}(?:[ ]?[A-Za-z]\b)?(?!\d)" + _POST + "?"
)
_FR = (
    r"\d{1,4}(?:[  ]?(?i:bis|ter|quater))?,?[  ](?:rue|avenue|av\.|boulevard|bd|impasse|chemin|place|quai|allée|route|cours|square|passage|sentier|ruelle|montée|faubourg)[ ](?:(?i:de[ ]la|de[ ]l[’']|du|des|de|d[’']|la|le|les|l[’'])[ ]?)?"
    rf"{_CAP}(?:-[\w’']+)*(?:[ ](?:(?:de|la|du|des|le|les)[ ])*{_CAP}(?:-[\w’']+)*)*" + _POST + "?"
)
_ES = (
    r"(?=[cC][aA/]|[aA][vV]|[pP][lLzZaA.]|[rR][oO]|[tT][rR]|[gG][lL])(?i:Calle|C/|Avda\.|Avenida|Av\.|Plaza|Pza\.|Paseo|P\.º|Camino|Ronda|Travesía|Carretera|Callejón|Glorieta)[ ](?:(?i:de[ ]la|de[ ]los|de[ ]las|del|de)[ ])?"
    rf"{_CAP}(?:[ ](?:(?:de|la|del|los|las)[ ])*{_CAP})*,?[  ](?:(?i:nº|n\.º|núm\.|número|n°)[  ]?)?\d{{1,4}}\b(?:,?[  ]?\d{{1,2}}\.?º[  ]?(?:[A-Z]\b|izq\.?|dcha\.?)?)?" + _POST + "?"
)
_ID = (
    rf"[12]{_SEP}?\d\d{_SEP}?(?:0\d|1[0-2]|[2-9]\d){_SEP}?(?:\d\d|2[ABab]){_SEP}?\d{{3}}{_SEP}?\d{{3}}{_SEP}?\d\d"
    rf"|\d{{2}}{_SEP}?\d{{3}}{_SEP}?\d{{3}}{_SEP}?\d{{3}}|\d{{3}}{_SEP}?\d{{2}}{_SEP}?\d{{4}}"
    rf"|\d{{2}}\.?\d{{3}}\.?\d{{3}}{_SEP}?[A-Za-z]|[XYZxyz]{_SEP}?\d\.?\d{{3}}\.?\d{{3}}{_SEP}?[A-Za-z]"
    rf"|[A-Za-z]{{2}}{_SEP}?\d{{2}}{_SEP}?\d{{2}}{_SEP}?\d{{2}}{_SEP}?[A-Da-d]|[CFGHJKLMNPRTVWXYZ][CFGHJKLMNPRTVWXYZ0-9]{{2}}{_SEP}?[CFGHJKLMNPRTVWXYZ0-9]{{5,6}}\d"
)
_PHONE = (
    rf"1{_SEP}\(?\d{{3}}\)?{_SEP}\d{{3}}{_SEP}\d{{4}}|(?:\(\+?\d{{1,3}}\)|\+\d{{1,3}}|00\d\d){_SEP}?(?:\(0\)|\(\d{{1,4}}\))?(?:{_SEP}?\d){{7,11}}"
    rf"|\(0\d{{1,4}}\){_SEP}?\d(?:{_SEP}?\d){{5,9}}|\(\d{{3}}\){_SEP}?\d{{3}}{_SEP}?\d{{4}}"
    rf"|0\d{{1,4}}{_SEP}\d(?:{_SEP}?\d){{5,9}}|0\d{{9,10}}|\d{{3}}{_SEP}?\d{{3}}{_SEP}?\d{{4}}|[6789]\d{{2}}{_SEP}?\d{{3}}{_SEP}?\d{{3}}|[6789]\d{{2}}{_SEP}?\d\d{_SEP}?\d\d{_SEP}?\d\d"
)
_NUMBER = re.compile(rf"(?<![\w@#$%])(?=[\d(+]|[A-Za-z]{{1,2}}{_SEP}?\d|[A-Z][A-Z\d]{{2}})(?<![\d][.,:/-])(?:(?P<p>{_PHONE})(?![\w])|(?P<d>{_ID})(?![\w]))(?![.,:/-]\d)")
_ONLY_ID = re.compile(rf"(?:{_ID})\Z")
_ONLY_PHONE = re.compile(rf"(?:{_PHONE})\Z")
_EMAILS = re.compile(_EMAIL)
#: One of these is in every e-mail address, and an address lies in one line.
_AT = ("@", "＠", "(at)", "[at]", "{at}", *(f"{a}AT{b}" for a in " \xa0" for b in " \xa0"))
_START = r"(?=[\dA-ZÄÖÜ\u212a]|a[lLvV]|c[aA/]|g[lLrR]|h\w|k[lL]|l[aA]|n[eE]|o[bB]|p[aAlLzZ.]|r[oO]|t[rR]|u[nN])"
_STREETS = re.compile(rf"(?<![\w]){_START}(?:{_US}|{_DE}|{_FR}|{_ES})(?![\w])")
_STREET_HINT = re.compile(r"\d")
_CODE = r"[\w.-]*+(?<=\w)/[\w./-]+|\w+_\w[\w.]*(?:\(\))?|\w++\(\)"
# most words are plain: nothing that could make them code, initials or compounds follows
_PLAIN = r"(?:[A-Za-z]{2,}+|[^\W\d_]{2,}+)(?![\w/(’'-]|\.\w)"
_TOKEN = (
    rf"{_PLAIN}|[^\w\s.\-\x00]|\n|\x00+|{_CODE}|[^\W\d_]\.(?=[  ]?[^\W\d_])|[^\W\d_]+(?:[-’'](?!s\b)[^\W\d_]+)*|\w+|[^\w\s]"
)
_WORDS = re.compile(_TOKEN)
#: The same with the blanks before them; the end is an empty word.
_BLANKS_WORDS = re.compile(rf"[^\S\n]*+({_TOKEN}|\Z)")
_SPACE_LABELS = {"word": (True, True, True, False, False, False, False), "comma": (True, False, True, False, False, False, False), "other": (True, False, False, False, False, False, False)}


_ABBREVIATED = re.compile(r"(?i)\b(?:St|Ave|Rd|Ln|Blvd|Dr|Ct|Pl|Ter|Cir|Sq|Pkwy|Hwy|str)\.\Z")


def _street_end(text: str, start: int, end: int) -> int:
    """A last point belongs to the address if it shortens a street word and doesn't rather end a sentence (a line's end, but in fields)."""
    if text[end - 1] != ".":
        return end
    if not _ABBREVIATED.search(text, start, end):
        return end - 1
    return end - 1 if text[end : end + 1] in ("\n", "\r") and text[max(0, start - 4) : start] != "ADR:" else end


def chunks(text: str) -> list[tuple[int, int, str, str]]:
    """Candidate spans that are no names: (start, end, possible labels, form), without overlaps; e-mails before addresses before numbers."""
    out: list[tuple[int, int, str, str]] = []
    lines = set()
    for sign in _AT:
        at = text.find(sign)
        while at >= 0:
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            lines.add((text.rfind("\n", 0, at) + 1, end))
            at = text.find(sign, end)
    for begin, end in sorted(lines):
        out += [(m.start(), m.end(), "E", "") for m in _EMAILS.finditer(text, begin, end)]
    taken = [(s, e) for s, e, _, _ in out]
    if _STREET_HINT.search(text):
        for m in _STREETS.finditer(text):
            if not any(s < m.end() and m.start() < e for s, e in taken):
                out.append((m.start(), _street_end(text, m.start(), m.end()), "A", ""))
        taken = sorted((s, e) for s, e, _, _ in out)
        starts = [s for s, _ in taken]
        for m in _NUMBER.finditer(text):
            k = bisect_right(starts, m.start()) - 1
            if (k >= 0 and taken[k][1] > m.start()) or (k + 1 < len(taken) and taken[k + 1][0] < m.end()):
                continue
            span = m.group()
            kinds = ("P" if _ONLY_PHONE.match(span) else "") + ("D" if _ONLY_ID.match(span) else "")
            out.append((m.start(), m.end(), kinds, re.sub(r"[A-Za-z]", "A", re.sub(r"\d", "9", span)).replace(" ", " ").replace(" ", " ")))
    return sorted(out)


def _lines(masked: str) -> Iterator[tuple[int, int]]:
    at = 0
    while at <= len(masked):
        end = masked.find("\n", at)
        end = len(masked) if end < 0 else end
        if end > at:
            yield at, end
        at = end + 1


_LETTERS = re.compile(r"[^\W\d_]{2,}")


def candidate(line: str, vocabulary: frozenset[str]) -> bool:
    """Whether a line holds a chunk, a word with a capital that isn't in the vocabulary, or a common given name.

    A rough choice: it passes over other names in lower case and words linked to a name elsewhere. ``find_in`` doesn't use it: it reads every line.
    """
    if "\x00" in line:
        return True
    return any((w.lower() not in vocabulary and not w.islower()) or w.lower() in GIVEN for w in _LETTERS.findall(line))


def masked_of(text: str, found: list[tuple[int, int, str, str]]) -> str:
    """The text with zero characters in place of its chunks."""
    if not found:
        return text
    parts, at = [], 0
    for s, e, _, _ in found:
        parts += [text[at:s], "\x00" * (e - s)]
        at = e
    return "".join(parts) + text[at:]


def _class(w: str) -> str:
    return "comma" if w == "," else "word" if w[0].isalpha() and "_" not in w and "/" not in w and "(" not in w else "other"


def _link(w: str, kind: str) -> str:
    return w.lower() if kind == "word" and (len(w) >= 4 or (len(w) >= 2 and w[0].isupper())) else ""


def _chunk_link(span: str) -> str:
    return re.sub(r"[\W_]+", "", span).lower()


def tokens(text: str, vocabulary: frozenset[str] | None = None) -> tuple[list[tuple[int, int]], list[str], list[str], list[str]]:
    """(spans, word keys, label classes, links): chunks are one token each, then words, initials with their point, code, line ends and signs.

    Tokens with equal links in a text tell of each other: a word in any case, a chunk's letters and digits. Lines end in two line ends, as
    nothing in one tells of the next but by links. All lines are read, unless a vocabulary is given (see ``candidate``).
    """
    found = chunks(text)
    masked = masked_of(text, found)
    return _tokens(text, found, masked, [(b, e) for b, e in _lines(masked) if vocabulary is None or candidate(masked[b:e], vocabulary)])


def _tokens(text: str, found: list[tuple[int, int, str, str]], masked: str, lines: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[str], list[str], list[str]]:
    """``tokens`` of some lines, in order."""
    spans, keys, classes, links, k = [], [], [], [], 0
    add_s, add_k, add_c, add_l = spans.append, keys.append, classes.append, links.append
    for begin, end in lines:
        for m in _WORDS.finditer(masked, begin, end):
            w = m.group()
            if w[0] == "\x00":
                at = m.start()
                while k < len(found) and found[k][0] < at:
                    k += 1
                while k < len(found) and found[k][0] < m.end():
                    s, e, kinds, form = found[k]
                    k += 1
                    add_s((s, e))
                    add_k(f"<{kinds}>{form}")
                    add_c(kinds)
                    add_l(_chunk_link(text[s:e]))
                if at == m.start() and not (spans and spans[-1][1] == m.end()):
                    add_s((m.start(), m.end()))
                    add_k("\x00")
                    add_c("other")
                    add_l("")
                continue
            add_s(m.span())
            add_k(w)
            kind = _class(w)
            add_c(kind)
            add_l(_link(w, kind))
        for _ in range(2):
            add_s((end, end))
            add_k("\n")
            add_c("other")
            add_l("")
    return spans, keys, classes, links


#: Common given names of English, French, German and Spanish speaking countries and beyond: one feature, not an identity (fixed values).
GIVEN = frozenset("""
adam alan albert alex alexander alice alicia amanda amy ana andrea andreas andrew angela anita anna anne anthony antonio arthur barbara
ben benjamin bernd björn brian bruno camille carlos carmen carol caroline catherine cécile charles charlotte chloé chris christian christine
claire claudia claus craig dana daniel david deborah diana diego dieter dominik donald edward elena elisabeth elizabeth emily emma enrique
eric erik esther eva fatima felix fernando françois frank frédéric gabriel george gerhard grace günther hannah hans harry heather heike
helen helena henry hugo ian ines ingrid isabel jack jacques james jan jane javier jean jennifer jessica joão johannes john jorge josé joseph
juan judith julia julie jürgen karen karl katharina kevin klaus kumar laura lena leonard li linda lisa louis lucas lucía luis luke manuel marc
marcus margaret maria marie mario mark marta martin mary matthias max mei michael michel miguel mohammed monika nadia nancy nicolas nicole
nina noah nora olga oliver olivier oscar pablo patricia patrick paul paula pedro peter philip pierre priya rachel rafael ravi rebecca
renate richard robert roberto rosa ruth sabine samuel sandra sara sarah sebastian simon sofia sophie stefan stephen susan sven teresa thomas
tim uwe victor walter wei william wolfgang xavier yuki yves zoe
""".split())
#: Titles before a name and particles inside of it (fixed values).
TITLES = frozenset("mr mrs ms miss dr prof professor sir madam m mme mlle monsieur madame herr herrn frau hr fr sr sra srta señor señora don doña".split())
PARTICLES = frozenset("de la von zu zur van der den del y e le du di da dos bin al el".split())


_LETTER_RUNS, _DIGIT_RUNS, _SMALL_RUNS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile("x+")
#: Of ASCII letters and digits only the kind; words of equal kinds have one shape, however long their runs of small letters are.
_FACES = {c: "X" if chr(c).isupper() else "x" if chr(c).islower() else "9" for c in range(128) if chr(c).isalnum()}


def _cased(w: str) -> str:
    return "X" if w.isupper() and len(w) > 1 else ("XxX" if any(c.isupper() for c in w[2:]) else "Xx") if w[0].isupper() else "x"


@lru_cache(65_536)
def _shape(key: str) -> str:
    return _LETTER_RUNS.sub(lambda m: _cased(m.group()), _DIGIT_RUNS.sub("9", key))


def word_features(key: str, vocabulary: frozenset[str] = frozenset()) -> list[str]:
    """Features of one token by itself; with an offset they serve its neighbours.

    Only words of the vocabulary, those that texts write in lower case, count as themselves. Any other is known by its shape, its length
    and whether it is a common given name: not by its letters, so a surname seen in training is no better known than another.
    """
    if key[0] == "<" and ">" in key:
        kinds, form = key[1:].split(">", 1)
        return [f"k={kinds}", f"form={form}", f"lead={form[:4]}"]
    low = key.lower()
    shape = _shape(_SMALL_RUNS.sub("x", key.translate(_FACES))) if key.isascii() else _shape.__wrapped__(key)
    if not key[0].isalpha():
        return [f"w={key}" if len(key) == 1 else "w=9", f"s={shape[:12]}"]
    what = "t=" + ("given" if low in GIVEN else "title" if low.rstrip(".") in TITLES else "part" if low in PARTICLES else "known" if low in vocabulary else "new")
    length = min(len(key), 9) // 3
    return [f"w={low}" if low in vocabulary or what in ("t=title", "t=part") else what, f"s={shape[:12]}", f"{what}{shape[:4]}", f"n={length}{shape[:4]}"]


#: Offsets at which a token's features speak about another, and which features do so.
OFFSETS = (-2, -1, 0, 1, 2)


def offset_features(key: str, offset: int, vocabulary: frozenset[str] = frozenset()) -> list[str]:
    return _at_offset(word_features(key, vocabulary), offset)


def _at_offset(f: list[str], offset: int) -> list[str]:
    return [f"0{x}" for x in f] if offset == 0 else [f"{offset:+d}{x}" for x in (f[:2] if abs(offset) == 2 else f[:3])]


def allowed(cls: str) -> tuple[bool, ...]:
    known = _SPACE_LABELS.get(cls)
    return known if known is not None else (True, False, False, "E" in cls, "P" in cls, "D" in cls, "A" in cls)


class _Words(dict):
    """Numbers of words, given as they are met, with the score row and the link of each, whether it stands for chunks, the code of the vocabulary's
    word that it is in any case (0: none) and whether it is that word in lower case."""

    def __init__(self, scorer: Scorer) -> None:
        super().__init__()
        self.scorer = scorer
        self.rows, self.codes = np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.masked, self.plain = np.zeros(1024, bool), np.zeros(1024, bool)
        self.links: list[str] = []
        self.parts: dict[int, list[int]] = {}

    def __missing__(self, w: str) -> int:
        i = self[w] = len(self)
        if i >= len(self.rows):
            self.rows, self.codes, self.masked, self.plain = (np.concatenate([x, np.zeros_like(x)]) for x in (self.rows, self.codes, self.masked, self.plain))
        kind = _class(w)
        self.rows[i] = self.scorer.row(w, kind)
        self.masked[i] = w[0] == "\x00"
        link, code = _link(w, kind), self.scorer.codes.get
        self.links.append(link)
        if link:
            self.codes[i] = code(link, 0)
            self.plain[i] = self.codes[i] > 0 and w.islower() and "-" not in w
            if "-" in link:
                self.parts[i] = [code(p) for p in link.split("-") if code(p)]
        return i


class Scorer:
    """Score rows of every distinct token at each offset, filled as tokens are met; a document's unary scores are sums of such rows.
    Tokens of equal features share a row."""

    def __init__(self, model: dict, most: int = 300_000) -> None:
        self.weights = {k: np.array(v, np.float32) for k, v in model["features"].items()}
        self.transition = np.array(model["transition"], np.float64)
        self.skip = float(model["skip"])
        self.vocabulary = frozenset(model["vocabulary"])
        self.codes = {w: i for i, w in enumerate(model["vocabulary"], 1)}
        self.most = most
        self._reset()

    def _reset(self) -> None:
        self.index: dict[tuple[str, str], int] = {}
        self.same: dict[tuple, int] = {}
        self.table = np.zeros((1024, len(OFFSETS), len(LABELS)), np.float32)
        self.mask = np.zeros((1024, len(LABELS)), bool)
        self.words = _Words(self)
        self.row("\n", "other")

    def fresh(self) -> None:
        """Forget all tokens once there are many."""
        if max(len(self.index), len(self.words)) > self.most:
            self._reset()

    def row(self, key: str, cls: str) -> int:
        features = word_features(key, self.vocabulary)
        alike = (cls, *features)
        i = self.same.get(alike)
        return self._add(features, cls, alike) if i is None else i

    def _row(self, key: str, cls: str) -> int:
        i = self.index[key, cls] = self.row(key, cls)
        return i

    def _add(self, features: list[str], cls: str, alike: tuple) -> int:
        i = self.same[alike] = len(self.same)
        if i >= len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.mask = np.concatenate([self.mask, np.zeros_like(self.mask)])
        for j, o in enumerate(OFFSETS):
            for f in _at_offset(features, o):
                w = self.weights.get(f)
                if w is not None:
                    self.table[i, j] += w
        self.mask[i] = allowed(cls)
        return i

    def ids(self, keys: list[str], classes: list[str]) -> np.ndarray:
        get, row = self.index.get, self._row
        return np.fromiter((get(kc, -1) if kc in self.index else row(*kc) for kc in zip(keys, classes, strict=True)), np.int64, len(keys))

    def unary(self, ids: np.ndarray) -> np.ndarray:
        """Scores of all labels; ids is one long run, in which documents are parted by line ends."""
        u = np.zeros((len(ids), len(LABELS)), np.float32)
        for j, o in enumerate(OFFSETS):
            # the row of the token at -o, read for its effect on this one
            if o == 0:
                u += self.table[ids, j]
            elif o > 0:
                u[:-o] += self.table[ids[o:], j] if len(ids) > o else 0
            else:
                u[-o:] += self.table[ids[:o], j] if len(ids) > -o else 0
        u[~self.mask[ids]] = -1e9
        return u


def _pass(into: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """Messages (log, at most 0) through one matrix of potentials exp(score): sums in the plain domain, so one product serves all links."""
    out = np.log(np.exp(into - into.max(1, keepdims=True)) @ strength + 1e-300)
    return out - out.max(1, keepdims=True)


def skip_pairs(links: list[str], docs: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between each occurrence of a word or chunk and its next one in the document (repeated, in any case or as part of a double
    name): one link an occurrence and part, never all pairs."""
    last: dict[tuple[int, str], int] = {}
    a, b = [], []
    for n, (t, d) in enumerate(zip(nodes.tolist(), docs[nodes].tolist(), strict=True)):
        link = links[t]
        if not link:
            continue
        for part in {link, *link.split("-")} if "-" in link else (link,):
            if len(part) >= 2:
                k = (d, part)
                if k in last:
                    a.append(last[k])
                    b.append(n)
                last[k] = n
    return np.array(a, np.int64), np.array(b, np.int64)


#: Linked tokens agree on what they are: nothing, part of a name (which part is left to the chain), or a kind of chunk.
_PART = np.array([0, 1, 1, 2, 3, 4, 5])
_AGREE = (_PART[:, None] == _PART[None, :]).astype(float)


def _best(unary: np.ndarray) -> np.ndarray:
    """The best score of each token's labels but 'O'."""
    return np.maximum.reduce([unary[:, k] for k in range(1, len(LABELS))])


def _open(unary: np.ndarray, links: list[str], docs: np.ndarray) -> np.ndarray:
    """The tokens that take part in message passing: those that may be a mention by themselves, and all that are linked to one."""
    free = _best(unary) > unary[:, 0] - PRUNE
    hot = {(d, part) for t, d in zip(np.flatnonzero(free).tolist(), docs[free].tolist(), strict=True) if links[t] for part in (links[t], *links[t].split("-"))}
    rest = np.array([t for t, link in enumerate(links) if link], np.int64)
    rest = rest[~free[rest]]
    rescued = [t for t, d in zip(rest.tolist(), docs[rest].tolist(), strict=True) if (d, links[t]) in hot or ("-" in links[t] and any((d, part) in hot for part in links[t].split("-")))]
    free[rescued] = True
    return np.flatnonzero(free)


def beliefs(scorer: Scorer, unary: np.ndarray, links: list[str], docs: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, their log beliefs) after loopy message passing over chain and skip links of many documents at once.

    Words whose labels are all more than PRUNE below 'O', and that no link ties to a more likely one, are fixed at 'O'; their
    neighbours keep the transition from it.
    """
    n = len(unary)
    nodes = _open(unary, links, docs) if n else np.zeros(0, np.int64)
    if not len(nodes):
        return nodes, np.zeros((0, len(LABELS)))
    t = scorer.transition
    node = unary[nodes].astype(np.float64)
    at = np.full(n + 1, -1, np.int64)
    at[nodes] = np.arange(len(nodes))
    before, after = nodes - 1, nodes + 1
    fixed_before = (before < 0) | (at[before] < 0)
    fixed_after = (after >= n) | (at[np.minimum(after, n)] < 0)
    node[fixed_before] += t[0][None, :]
    node[fixed_after] += t[:, 0][None, :]
    left = np.flatnonzero(~fixed_after)
    a, b = skip_pairs(links, docs, nodes) if scorer.skip else (np.zeros(0, np.int64),) * 2
    src = np.concatenate([left, a])
    dst = np.concatenate([at[nodes[left] + 1], b])
    chain, skip, nc = np.exp(t), np.exp(scorer.skip * _AGREE), len(left)
    fwd, bwd = np.zeros((len(src), len(LABELS))), np.zeros((len(src), len(LABELS)))
    belief = node.copy()
    ends = np.concatenate([dst, src])
    cells = (ends[:, None] * len(LABELS) + np.arange(len(LABELS))).ravel()
    for _ in range(rounds if len(src) else 0):
        into, back = belief[src] - bwd, belief[dst] - fwd
        new_f = np.concatenate([_pass(into[:nc], chain), _pass(into[nc:], skip)]) if nc < len(src) else _pass(into, chain)
        new_b = np.concatenate([_pass(back[:nc], chain.T), _pass(back[nc:], skip.T)]) if nc < len(src) else _pass(back, chain.T)
        moved = max(np.abs(new_f - fwd).max(), np.abs(new_b - bwd).max())
        fwd, bwd = 0.7 * new_f + 0.3 * fwd, 0.7 * new_b + 0.3 * bwd
        belief = node + np.bincount(cells, np.concatenate([fwd, bwd]).ravel(), node.size).reshape(node.shape)
        if moved < 1e-2:
            break
    return nodes, belief


def infer(scorer: Scorer, unary: np.ndarray, links: list[str], docs: np.ndarray) -> np.ndarray:
    """Most probable label of every token (see ``beliefs``)."""
    labels = np.zeros(len(unary), np.int64)
    nodes, belief = beliefs(scorer, unary, links, docs)
    labels[nodes] = belief.argmax(1)
    return labels


def _mentions(spans: list[tuple[int, int]], labels: np.ndarray, keys: list[str]) -> Iterator[tuple[int, int, str]]:
    """Spans from labels; the exact check afterwards trims a name's edges to letters (and the point of an initial)."""
    i, n = 0, len(labels)
    while i < n:
        x = labels[i]
        if x == 0:
            i += 1
        elif x in (1, 2):
            j = i + 1
            while j < n and labels[j] == 2:
                j += 1
            k = j
            while k > i and keys[k - 1] in (",", "\n"):
                k -= 1
            if k > i and any(sum(map(str.isalpha, w)) > 1 for w in keys[i:k]):  # more than initials
                yield spans[i][0], spans[k - 1][1], "name"
            i = j
        else:
            yield spans[i][0], spans[i][1], LABELS[x]
            i += 1


_MARK, _MARKS = re.compile("[\u0300-\u036f]"), re.compile("[^\\W\\d_][\u0300-\u036f]+")


def composed(text: str) -> tuple[str, list[int] | None]:
    """The text with letters and their combining marks made one, and the old place of every character (None: nothing changed)."""
    if text.isascii() or not _MARK.search(text) or not _MARKS.search(text):
        return text, None
    parts, places, at = [], [], 0
    for m in _MARKS.finditer(text):
        one = unicodedata.normalize("NFC", m.group())
        one = one if len(one) == 1 else one[0]
        parts += [text[at : m.start()], one]
        places += [*range(at, m.start()), m.start()]
        at = m.end()
    return "".join([*parts, text[at:]]), [*places, *range(at, len(text) + 1)]


def _back(mentions: list[tuple[int, int, str]], places: list[int] | None) -> list[tuple[int, int, str]]:
    return mentions if places is None else [(places[s], places[e], kind) for s, e, kind in mentions]


class Run:
    """All tokens of many texts (``tokens``) as one run with two line ends before it: the score row, line and text of each, both from 1.

    Every word of every line is read, and looked up as a number; only spans are read again, of the lines with mentions (``mentions``).
    """

    def __init__(self, scorer: Scorer, texts: list[str]) -> None:
        self.texts, self.known = texts, scorer.words
        self.found = [chunks(t) for t in texts]
        self.masked = [masked_of(t, f) for t, f in zip(texts, self.found, strict=True)]
        whole, known = "\n".join(self.masked), scorer.words
        sizes = np.array([len(x) for x in whole.split("\n")])
        self.doc = np.repeat(np.arange(len(texts)), [t.count("\n") + 1 for t in self.masked]) if texts else np.zeros(1, np.int64)
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.end = np.cumsum(sizes + 1) - 1 - starts[self.doc]
        self.begin = self.end - sizes
        end = known["\n"]
        numbers = [np.full(1, end)]
        at = 0
        while at <= len(whole):
            to = whole.find("\n", at + CHUNK_CHARS)
            to = len(whole) if to < 0 else to
            words = _BLANKS_WORDS.findall(whole, at, to)
            while words and not words[-1]:
                words.pop()
            numbers += [np.fromiter(map(known.__getitem__, words), np.int32, len(words)), np.full(1, end)]
            at = to + 1
        numbers = np.concatenate(numbers)
        ends, masked = numbers == end, known.masked[numbers]
        times = 1 + ends
        counts, keys, classes, links = self._chunks(whole, starts)
        times[masked] = counts
        at = np.repeat(np.arange(len(numbers), dtype=np.int32), times)
        self.lines = (np.cumsum(ends) - ends)[at]
        self.docs = np.concatenate([[0], self.doc + 1])[self.lines]
        self.numbers = numbers[at]
        self.rows = known.rows[self.numbers]
        places = np.flatnonzero(masked[at])
        self.rows[places] = scorer.ids(keys, classes)
        self.chunk_links = dict(zip(places.tolist(), links, strict=True))

    def links(self, unary: np.ndarray) -> list[str]:
        """Links of all tokens. A word of the vocabulary that a text has in lower case only, nowhere likelier a mention than nothing by itself, has none:
        its occurrences have nothing to tell each other, and the two labels of a name would outweigh the one of nothing by mere repetition."""
        known, numbers = self.known, self.numbers
        plain, codes, base = known.plain[numbers], known.codes[numbers], self.docs * (len(known.scorer.codes) + 1)
        telling = np.flatnonzero(~plain | (_best(unary) > unary[:, 0]))
        kept = (base + codes)[telling]
        double = telling[np.isin(numbers[telling], list(known.parts))]
        parts = [int(base[i]) + c for i in double.tolist() for c in known.parts[int(numbers[i])]]
        silent = plain & ~np.isin(base + codes, np.unique(np.concatenate([kept, np.array(parts, np.int64)])))
        links = list(map(known.links.__getitem__, np.where(silent, known["\n"], numbers).tolist()))
        for i, link in self.chunk_links.items():
            links[i] = link
        return links

    def _chunks(self, whole: str, starts: np.ndarray) -> tuple[list[int], list[str], list[str], list[str]]:
        """Tokens of each run of zero characters (more than one if chunks touch), and all their keys, classes and links."""
        found = [(a + s, a + e, kinds, form, _chunk_link(t[s:e])) for a, t, f in zip(starts.tolist(), self.texts, self.found) for s, e, kinds, form in f]
        counts, keys, classes, links, k = [], [], [], [], 0
        for m in re.finditer("\x00+", whole):
            n, last = len(keys), -1
            while k < len(found) and found[k][0] < m.end():
                _, last, kinds, form, link = found[k]
                keys.append(f"<{kinds}>{form}")
                classes.append(kinds)
                links.append(link)
                k += 1
            if last != m.end():
                keys.append("\x00")
                classes.append("other")
                links.append("")
            counts.append(len(keys) - n)
        return counts, keys, classes, links

    def mentions(self, labels: np.ndarray) -> list[list[tuple[int, int, str]]]:
        """Mentions of each text by the labels of all tokens; none goes on over a line end."""
        out: list[list[tuple[int, int, str]]] = [[] for _ in self.texts]
        some = np.unique(self.lines[labels > 0])
        for line, at in zip((some - 1).tolist(), np.searchsorted(self.lines, some).tolist(), strict=True):
            d = int(self.doc[line])
            spans, keys, _, _ = _tokens(self.texts[d], self.found[d], self.masked[d], [(int(self.begin[line]), int(self.end[line]))])
            out[d] += _mentions(spans, labels[at : at + len(keys)], keys)
        return out


def find_in(scorer: Scorer, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
    """Mentions of each text, as (start, end, kind) in code points."""
    scorer.fresh()
    whole = [composed(text or "") for text in texts]
    run = Run(scorer, [text for text, _ in whole])
    unary = scorer.unary(run.rows)
    labels = infer(scorer, unary, run.links(unary), run.docs)
    return [_back(found, places) for found, (_, places) in zip(run.mentions(labels), whole, strict=True)]


_scorers: dict[int, Scorer] = {}


def _scorer(raw: bytes) -> Scorer:
    key = hash(raw)
    if key not in _scorers:
        _scorers[key] = Scorer(json.loads(raw))
    return _scorers[key]


def load_model(path: str | Path = MODEL) -> bytes:
    raw = Path(path).read_bytes()
    if len(raw) > MAX_MODEL_BYTES:
        raise ValueError(f"{path}: larger than {MAX_MODEL_BYTES} bytes")
    return raw


#: Characters of text handled in one go by a task.
CHUNK_CHARS = 1_000_000


def _groups(ids: list, texts: list[str | None]) -> Iterator[tuple[list, list]]:
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK_CHARS:
            yield ids[at : i + 1], texts[at : i + 1]
            at, size = i + 1, 0
    yield ids[at:], texts[at:]


def find(documents: DataFrame, model: bytes | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_pos, end_pos, pii_kind): every mention in every row, in code points of the stored text, end exclusive.

    Candidate chunks (anything written like an e-mail address, street address, phone or identity number) and words are the nodes of
    a chain; a word's occurrences in a document are linked besides. Labels come from loopy message passing with the trained
    weights, so a chunk of the right form may still be nothing, and a name found once helps to find it again. Null and empty texts
    have no mentions; repeated rows give theirs again; texts are read whole; other columns are ignored. Narrow: no shuffle.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model or load_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(sent.value)
        for batch in batches:
            for ids, texts in _groups(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(i, *m) for i, ms in zip(ids, find_in(scorer, texts), strict=True) for m in ms]
                cols = list(zip(*rows, strict=True)) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(cols[0]), batch.schema.field(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], names=[id_col, "start_pos", "end_pos", "pii_kind"])

    source = spread(documents.select(id_col, text_col))
    return source.mapInArrow(run, f"{id_col} {source.schema[id_col].dataType.simpleString()}, start_pos int, end_pos int, pii_kind string")


def redact_text(text: str, mentions: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for s, e, kind in sorted(mentions):
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, model: bytes | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): every row with [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] and [NAME] in place of its mentions, all else unchanged."""
    sent = documents.sparkSession.sparkContext.broadcast(model or load_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(sent.value)
        for batch in batches:
            for ids, texts in _groups(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                clean = [None if t is None else redact_text(t, m) for t, m in zip(texts, find_in(scorer, texts), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(clean, pa.string())], names=[id_col, text_col])

    source = spread(documents.select(id_col, text_col))
    return source.mapInArrow(run, f"{id_col} {source.schema[id_col].dataType.simpleString()}, {text_col} string")


def counts(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("pii_kind").agg(F.count("*").alias("n_mentions"), F.countDistinct("doc_id").alias("n_documents"))

