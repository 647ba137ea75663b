"""Training of the personal-information model on a bounded sample of texts labelled from general cues.

    python -m tracemill.llm.pii_train DOCUMENTS.parquet [SAMPLE_DOCUMENTS]

No labelled rows exist. Cues that hold in any text (greetings, titles, name fields of records and mails, sign-offs, an e-mail address
spelt like the words beside it, common given names) give parts of names; runs of such parts in the sample are then labelled, and numbers
by the words around them. These lists serve the labels only: the field itself never sees who a capitalised word is (see
``pii.word_features``), so it learns how names look and stand. It is fitted by stochastic gradients of the chain's exact log-likelihood;
the weight of the skip links by the pseudo-likelihood of whole documents left out.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections import Counter

import numpy as np

from tracemill.llm import pii

#: Documents at most that the model is fitted on.
SAMPLE_DOCUMENTS = 25_000
EPOCHS, RATE, L2, LEAST_COUNT, KEEP = 4, 0.25, 1e-6, 3, 0.05
#: Lines that the field is fitted on, with and without mentions.
LINES = (9_000, 5_000)

#: A word belongs to the vocabulary if so many documents have it and this share of its occurrences is in lower case.
VOCABULARY_DOCUMENTS, VOCABULARY_SHARE, VOCABULARY = 6, 0.4, 12_000
SKIPS = (0.0, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)

_NP = r"([^\W\d_][\w.’' \xa0-]{1,50}?(?:, [^\W\d_][\w.’' -]{1,30}?)?)"
#: Cues that a name follows, in four languages.
CUES = [re.compile(p, re.M) for p in (
    rf"\b(?:Hi|Hello|Hey|Dear|Thanks|Thank you|Bonjour|Salut|Merci|Chère?|Hallo|Liebe[r]?|Danke|Hola|Gracias|Estimad[oa]),? {_NP}[,!.:]",
    rf"(?i:^[ >*#-]*(?:FN|name|full name|author|from|to|cc|reviewed-by|signed-off-by|co-authored-by|reporter|reported by|assignee|owner|contact|nom|nombre)):[ ]*{_NP}[ ]*(?:<|\(|,|;|\r?$)",
    rf"(?i:\"(?:name|full_?name|reporter|author|assignee|owner|user|contact|customer)\"): ?\"{_NP}\"", rf"\bname=\"{_NP}\"", rf"\b(?:by|from|von|par|por) {_NP} \(", rf"^-- ?{_NP}(?:,|\r?$)",
    rf"\b(?:Mrs?|Ms|Dr|Prof|Herrn?|Frau|Monsieur|Madame|Mme|Sra?|Señora?)\.? {_NP}(?:[,.;:!?)]| [a-z])",
)]
_ARTICLE = re.compile(r"(?i)(?:\b(?:the|a|an|this|that|our|your|each|le|la|les|un|une|ce|cette|der|die|das|den|dem|des|ein|eine|einen|el|los|las|una|este|esta)|\bl[’'])[ \xa0]?\Z")
_ID_WORDS = re.compile(r"(?i)ssn|security number|id number|insee|sociale|dni|nie\b|documento|steuer|ausweis|national_id|insurance")
_NO_NUMBER = re.compile(r"(?i)(?:epoch|build|version|offset|stride|budget=?|port|shape|lines?|commit|timeout=?|request id \S+)\W*(?:\d+\W+)*$")
_SMALL = {"de", "la", "von", "zu", "zur", "van", "der", "den", "del", "y", "e", "d'", "le"}


#: Words that stand with a capital though they are no names (fixed values): greetings, days, months and the like.
COMMON = frozenset("""
hi hello hey dear thanks thank please regards bonjour salut merci cher chère hallo danke liebe lieber bitte hola gracias estimado estimada saludos
monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december
lundi mardi mercredi jeudi vendredi samedi dimanche montag dienstag mittwoch donnerstag freitag samstag sonntag lunes martes miércoles jueves viernes
english french german spanish python java docker linux windows google microsoft github slack new york london paris berlin madrid null true false none error warning
i you he she it we they sie er ich wir ihr il elle nous vous yo usted él ella
""".split())
#: A word of any case that so many documents have, and no cue calls part of a name, belongs to the vocabulary too.
FREQUENT = 12


def vocabulary_of(texts: list[str], names: frozenset[str] = frozenset()) -> frozenset[str]:
    """Words that texts write in lower case, and frequent ones that aren't ``names``; given names and what stands in addresses of any kind left out."""
    documents, low, all_ = Counter(), Counter(), Counter()
    for t in texts:
        parts, at = [], 0
        for s, e, _, _ in pii.chunks(t):
            parts.append(t[at:s])
            at = e
        words = re.findall(r"(?<![\w/])[^\W\d_]+(?:[-’'][^\W\d_]+)*(?![\w/])", " ".join([*parts, t[at:]]))
        all_.update(w.lower() for w in words)
        low.update(w for w in words if w.islower())
        documents.update({w.lower() for w in words})
    usual = lambda w, n: n >= VOCABULARY_DOCUMENTS and low[w] >= VOCABULARY_SHARE * all_[w]
    fit = [w for w, n in documents.items() if (usual(w, n) or (names and n >= FREQUENT and w not in names)) and w not in pii.GIVEN]
    return frozenset(sorted(fit, key=lambda w: (-documents[w], w))[:VOCABULARY]) | (COMMON - pii.GIVEN)


def _name_words(phrase: str, vocabulary: frozenset[str]) -> list[str] | None:
    """The words of a phrase after a cue, first name first; None if it can't be a name."""
    phrase = phrase.strip(" ,.")
    if "," in phrase:
        last, _, first = phrase.partition(",")
        phrase = f"{first.strip()} {last.strip()}"
    words = re.split(r"[ \xa0]+", phrase)
    if not 1 <= len(words) <= 5 or any(ch.isdigit() or ch == "_" for ch in phrase):
        return None
    good = all(w[0].isupper() or w.lower() in pii.PARTICLES or w.lower()[:2] in ("d'", "d’") for w in words if w)
    return words if good and not any(w.lower() in vocabulary and w.lower() not in pii.PARTICLES for w in words) else None


def parts_of_names(texts: list[str], vocabulary: frozenset[str]) -> tuple[Counter, Counter]:
    """(first parts, other parts) seen after cues or spelt out in an e-mail address of the line, lower case."""
    given, family = Counter({w: 2 for w in pii.GIVEN}), Counter()

    def note(words: list[str], sure: int = 1) -> None:
        whole = [w for w in words if len(w.strip(".")) > 1 and w.lower() not in _SMALL]
        if not whole:
            return
        if len(words[0].strip(".")) > 1:
            given[whole[0].lower()] += sure
            family.update({w.lower(): sure for w in whole[1:]})
        else:
            family.update({w.lower(): sure for w in whole})

    for t in texts:
        for pattern in CUES:
            for m in pattern.finditer(t):
                words = _name_words(m.group(1), vocabulary)
                if words:
                    note(words)
        for s, _, kinds, _ in pii.chunks(t):
            if kinds != "E":
                continue
            local = re.split(r"[@＠(\[{ ]", t[s:])[0].lower()
            line = t[t.rfind("\n", 0, s) + 1 : s]
            for m in re.finditer(r"([A-ZÀ-Þ][\w’'-]+)[ \xa0]([A-ZÀ-Þ][\w’'-]+)", line):
                if all(len(w) > 2 and unicodedata.normalize("NFKD", w.lower()).encode("ascii", "ignore").decode()[:6] in local for w in m.groups()):
                    note(list(m.groups()), 2)
    g = {w for w, c in given.items() if c >= 2 and not w.endswith(".")}
    _grow(texts, g, family)
    return given, family


def _grow(texts: list[str], given: set[str], family: Counter, rounds: int = 2) -> None:
    """Add capitalised words that mostly follow a first name, an initial or another family name."""
    pair = re.compile(r"(?<![\w’'])([^\W\d_][\w’'-]*|[^\W\d_]\.)[ \xa0](?=([A-ZÀ-Þ][\w’']*(?:-[A-ZÀ-Þ][\w’']*)*))")
    follows: Counter = Counter()
    after: dict[str, Counter] = {}
    for t in texts:
        for m in pair.finditer(t):
            after.setdefault(m.group(2).lower(), Counter())[m.group(1).lower()] += 1
    for t in texts:
        follows.update(w.lower() for w in re.findall(r"(?<![\w’'./-])[A-ZÀ-Þ][\w’']*(?:-[A-ZÀ-Þ][\w’']*)*", t))
    for _ in range(rounds):
        known = set(family)
        for w, before in after.items():
            if w in known or w in given or len(w) < 5:
                continue
            good = sum(c for b, c in before.items() if b in given or b in known or (len(b) == 2 and b[1] == "."))
            if good >= 1 and good >= 0.25 * follows[w]:
                family[w] += good


def silver(text: str, given: set[str], family: set[str], vocabulary: frozenset[str] = frozenset()) -> tuple[list, list[str], list[str], list[int]]:
    """Tokens of a text and their labels."""
    spans, keys, classes, _ = pii.tokens(text)
    n, labels = len(keys), [0] * len(keys)
    kind = [""] * n
    for i, (k, c) in enumerate(zip(keys, classes, strict=True)):
        if c in ("comma", "other"):
            continue
        if c != "word":
            before = text[max(0, spans[i][0] - 60) : spans[i][0]].rpartition("\n")[2]
            if c == "E":
                labels[i] = 3
            elif c == "A":
                labels[i] = 6
            elif not _NO_NUMBER.search(before):
                span = text[spans[i][0] : spans[i][1]]
                after = text[spans[i][1] : spans[i][1] + 1]
                is_id = c == "D" or (c == "PD" and (_ID_WORDS.search(before[-45:]) or (after == ";" and ";" in before) or span[:3] in ("000", "666")))
                labels[i] = 5 if is_id else 4
            continue
        # what an article stands before and a plain word follows is a thing called so
        if i + 1 < n and keys[i + 1].islower() and _ARTICLE.search(text, max(0, spans[i][0] - 12), spans[i][0]):
            continue
        low = k.lower()
        parts = [p for p in re.split(r"[-]|(?<=^[dlo])[’']", low) if p not in ("d", "l", "o")]
        first = low in given or (len(parts) > 1 and all(p in given for p in parts))
        whole = low in family or (bool(parts) and all(p in family or p in given for p in parts))
        kind[i] = "g" if first else "f" if whole else "i" if re.fullmatch(r"[^\W\d_]\.", k) else "s" if low in _SMALL else "c" if k[0].isupper() and not any(p in vocabulary for p in parts) or re.fullmatch(r"d[’']\w+", low) else ""
    i = 0
    near = lambda a, b: text[spans[a][1] : spans[b][0]] in (" ", "\xa0", "")
    while i < n:
        # a capitalised word of no vocabulary belongs to a name that it stands beside
        reversed_ = kind[i] == "c" and i + 2 < n and keys[i + 1] == "," and kind[i + 2] == "g"
        if reversed_:
            kind[i] = "f"
        if kind[i] in ("g", "f") or (kind[i] in ("i", "s") and i + 1 < n and kind[i + 1] in ("g", "f", "i", "s")):
            j = i + 1
            while j < n and ((kind[j] and near(j - 1, j)) or (keys[j] == "," and j + 1 < n and kind[j - 1] == "f" and kind[j + 1] in ("g", "i") and text[spans[j][1] : spans[j + 1][0]] in (" ", "\xa0") and not any(kind[x] in ("g", "i") for x in range(i, j)))):
                j += 1
            while j > i and kind[j - 1] in ("s", "", "i") and not (kind[j - 1] == "i" and "," in keys[i:j]):
                j -= 1
            kinds = {kind[x] for x in range(i, j)}
            start = i
            while start < j and kind[start] == "s" and kind[start + 1 if start + 1 < j else start] not in ("f", "s"):
                start += 1
            cased = any(keys[x][0].isupper() for x in range(start, j) if kind[x] in "gf" and kind[x]) or {"g", "f"} <= kinds
            single_ok = j - start > 1 or kind[start] == "g" or kind[start] == "f"
            kinds = {"f" if x == "c" else x for x in kinds}
            if kinds & {"g", "f"} and cased and single_ok and j > start:
                labels[start] = 1
                for x in range(start + 1, j):
                    labels[x] = 2
            i = max(j, i + 1)
        else:
            i += 1
    return spans, keys, classes, labels


def sequences(text: str, given: set[str], family: set[str], vocabulary: frozenset[str]) -> list[tuple[list[str], list[str], list[int]]]:
    """Lines of a text as (keys, classes, labels), each with the line ends around it."""
    _, keys, classes, labels = silver(text, given, family, vocabulary)
    out, at = [], 0
    for i in [*[i for i, k in enumerate(keys) if k == "\n"], len(keys)]:
        if i - at >= 2:
            out.append((["\n", "\n", *keys[at:i], "\n", "\n"], ["other"] * 2 + classes[at:i] + ["other"] * 2, [0, 0, *labels[at:i], 0, 0]))
        at = i + 1
    return out


def _forward_backward(u: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of one chain: single and pairwise summed."""
    n, k = u.shape
    w = np.exp(t - t.max())
    e = np.exp(u - u.max(1, keepdims=True))
    a, b = np.empty((n, k)), np.ones((n, k))
    a[0] = e[0] / e[0].sum()
    for i in range(1, n):
        x = (a[i - 1] @ w) * e[i]
        a[i] = x / x.sum()
    for i in range(n - 2, -1, -1):
        x = w @ (b[i + 1] * e[i + 1])
        b[i] = x / x.sum()
    m = a * b
    m /= m.sum(1, keepdims=True)
    pair = a[:-1, :, None] * w[None] * (b[1:] * e[1:])[:, None, :]
    pair /= pair.sum((1, 2), keepdims=True)
    return m, pair.sum(0)


def train(texts: list[str], seed: int = 7, most: int = SAMPLE_DOCUMENTS) -> tuple[dict, set[str], set[str]]:
    """The model, and the first and other parts of names behind its labels.

    It is fitted twice: the names that the first model finds in the sample give parts that no cue stood before, for the second's labels.
    """
    texts = [pii.composed(t)[0] for t in texts[:most] if t]
    vocabulary = vocabulary_of(texts)
    given, family = parts_of_names(texts, vocabulary)
    g = {w for w, c in given.items() if c >= 2 and not w.endswith(".")}
    f = {w for w in family if len(w) > 2 and w not in vocabulary} - g
    model = _fitted(texts, vocabulary, g, f, seed)
    seen, firsts, heads = Counter(), Counter(), Counter()
    scorer = pii.Scorer(model)
    for at in range(0, len(texts), 200):
        for text, found in zip(texts[at : at + 200], pii.find_in(scorer, texts[at : at + 200]), strict=True):
            for s, e, kind in found:
                words = _name_words(text[s:e], vocabulary) if kind == "name" else None
                for k, w in enumerate(words if words and len(words) > 1 else ()):
                    low = w.lower()
                    if len(low.strip(".")) > 2 and low not in _SMALL:
                        seen[low] += 1
                        (firsts if k == 0 and len(words) > 1 else heads)[low] += 1
    g |= {w for w, n in firsts.items() if n >= 3 and n >= 2 * heads[w] and w not in f and w not in vocabulary}
    f |= {w for w, n in seen.items() if n >= 2 and w not in vocabulary} - g
    parts = frozenset(p for w in g | f | set(seen) for p in (w, *w.split("-")))
    return _fitted(texts, vocabulary_of(texts, parts), g, f, seed), g, f


#: Words that say what number follows, in four languages, and words before numbers that are nobody's.
ID_CUES = ("SSN", "ssn", "DNI", "NIE", "insee", "NIR", "Steuer-ID", "Ausweisnummer", "national", "security", "id", "ID", "documento", "identidad", "sociale", "Steuernummer")
PHONE_CUES = ("phone", "tel", "Tel", "call", "mobile", "Mobil", "text", "Telefon", "téléphone", "teléfono", "móvil", "appelez", "llame", "at", "fax")
NO_CUES = ("offset", "version", "stride", "shape", "build", "port", "line", "epoch", "size", "timeout", "seed", "step")


def _strange(word: str) -> str:
    """A word that no vocabulary has, of the same length and case."""
    turned = word.lower()[::-1]
    return turned.upper() if word.isupper() and len(word) > 1 else turned.capitalize() if word[0].isupper() else turned


def _other_names(keys: list[str], classes: list[str], labels: list[int], rng: np.random.Generator, share: float) -> list[str]:
    """The tokens with given names exchanged for others and surnames made strange, at random: whose name it is must not matter."""
    out = list(keys)
    for i, (k, c, y) in enumerate(zip(keys, classes, labels, strict=True)):
        low = k.lower()
        if c != "word" or y not in (1, 2) or len(k.strip(".")) < 3 or low in pii.PARTICLES or rng.random() > share:
            continue
        if low in pii.GIVEN:
            new = _GIVEN[int(rng.integers(0, len(_GIVEN)))]
            out[i] = new if k.islower() else new.upper() if k.isupper() else new.capitalize()
        else:
            out[i] = "-".join(_strange(p) for p in k.split("-"))
    return out


_GIVEN = sorted(pii.GIVEN)


def masked_copies(rows: list[tuple], rng: np.random.Generator, share: float = 0.35) -> list[tuple]:
    """Copies of lines in which words outside of mentions are made strange, and names others, so that the field doesn't rest on the corpus' own."""
    out = []
    for keys, classes, labels in rows:
        turn = rng.random(len(keys)) < share
        keys = _other_names(keys, classes, labels, rng, 0.5)
        out.append(([_strange(k) if t and c == "word" and y == 0 and len(k) > 2 else k for k, c, y, t in zip(keys, classes, labels, turn, strict=True)], classes, labels))
    return out


def strange_lines(rows: list[tuple], rng: np.random.Generator, n: int = 8_000) -> list[tuple]:
    """Mentions of the labelled lines among strange and plain words: what a sentence of any other subject looks like."""
    mentions, words = [], []
    for keys, classes, labels in rows:
        i = 0
        while i < len(keys):
            if labels[i]:
                j = i + 1
                while j < len(keys) and labels[i] == 1 and labels[j] == 2:
                    j += 1
                mentions.append((keys[i:j], classes[i:j], labels[i:j]))
                i = j
            else:
                if classes[i] == "word" and keys[i].islower() and len(keys[i]) > 1:
                    words.append(keys[i])
                i += 1
    out = []
    for _ in range(n if mentions and words else 0):
        some = [_strange(w) if rng.random() < 0.6 and len(w) > 2 else w for w in (words[i] for i in rng.integers(0, len(words), int(rng.integers(2, 12))))]
        cut = int(rng.integers(0, len(some) + 1))
        keys, classes, labels = mentions[int(rng.integers(0, len(mentions)))]
        keys, labels = _other_names(keys, classes, labels, rng, 0.7), list(labels)
        before, after = some[:cut], some[cut:]
        if before:
            before[0] = before[0].capitalize()
        kinds = classes[0]
        if kinds in ("D", "PD", "P") and rng.random() < 0.75:
            no = rng.random() < 0.4
            cues = NO_CUES if no else ID_CUES if labels[0] == 5 else PHONE_CUES
            before += [cues[int(rng.integers(0, len(cues)))], *([":"], ["is"], [], [])[int(rng.integers(0, 4))]]
            labels = [0] if no else labels
        if rng.random() < 0.15 and labels[0] == 1:
            if rng.random() < 0.6 and keys[-1][0].isalpha():
                keys, classes, labels = keys[-1:], classes[-1:], [1]
            before += [(("Mr", "."), ("Dr", "."), ("Mrs",), ("Herr",), ("Frau",), ("Mme",), ("Señora",), ("Monsieur",))[int(rng.integers(0, 8))]]
            before[-1:] = before[-1]
        end = ([], ["."], [","], ["!"], ["?"], [":"])[int(rng.integers(0, 6))]
        line = [*before, *keys, *(end if rng.random() < 0.5 else []), *after, *end]
        marks = [0] * len(before) + labels + [0] * (len(line) - len(before) - len(labels))
        kind = ["word" if w[0].isalpha() else "comma" if w == "," else "other" for w in line]
        kind[len(before) : len(before) + len(keys)] = classes
        out.append((["\n", "\n", *line, "\n", "\n"], ["other"] * 2 + kind + ["other"] * 2, [0, 0, *marks, 0, 0]))
    return out


def _fitted(texts: list[str], vocabulary: frozenset[str], g: set[str], f: set[str], seed: int) -> dict:
    rng = np.random.default_rng(seed)
    seen: dict[tuple, int] = {}
    rows = []
    for t in texts:
        for s in sequences(t, g, f, vocabulary):
            # lines that differ in code and numbers only are one example; lines without labels are thinned once there are many alike
            shape = tuple(re.sub(r"\d+", "9", "P" if ("_" in k or "/" in k) else k) for k in s[0])
            seen[shape] = seen.get(shape, 0) + 1
            if seen[shape] <= (6 if any(s[2]) else 1):
                rows.append(s)
    busy = [r for r in rows if any(r[2])]
    idle = [r for r in rows if not any(r[2])]
    rng.shuffle(idle)
    rng.shuffle(busy)
    busy, idle = busy[: LINES[0]], idle[: LINES[1]]
    data = busy + idle
    data += masked_copies(busy, rng) + masked_copies(idle[: len(idle) // 2], rng) + strange_lines(busy, rng)
    print(len(texts), "texts", len(g), "given", len(f), "family;", len(busy), "lines with mentions,", len(idle), "without")
    count: Counter = Counter()
    for keys, _, _ in data:
        for j, o in enumerate(pii.OFFSETS):
            del j
            for k in keys:
                count.update(pii.offset_features(k, o, vocabulary))
    index = {x: i for i, (x, c) in enumerate(sorted(count.items())) if c >= LEAST_COUNT}
    index = {x: i for i, x in enumerate(index)}
    memo: dict[tuple[str, int], np.ndarray] = {}

    def fids(k: str, o: int) -> np.ndarray:
        if (k, o) not in memo:
            memo[k, o] = np.array([index[x] for x in pii.offset_features(k, o, vocabulary) if x in index], np.int64)
        return memo[k, o]

    L = len(pii.LABELS)
    W, G = np.zeros((len(index), L), np.float32), np.full((len(index), L), 1e-2, np.float32)
    T, GT = np.zeros((L, L)), np.full((L, L), 1e-2)
    built = []
    for keys, classes, labels in data:
        n = len(keys)
        fi = [np.concatenate([fids(keys[i + o], o) for o in pii.OFFSETS if 0 <= i + o < n]) for i in range(n)]
        flat = np.concatenate(fi)
        off = np.concatenate(([0], np.cumsum([len(x) for x in fi])))
        mask = np.array([pii.allowed(c) for c in classes])
        y = np.array(labels)
        bad = ~mask[np.arange(n), y]
        y[bad] = 0
        built.append((flat, off, mask, y))
    order, hard = np.arange(len(built)), np.ones(len(built), bool)
    for epoch in range(EPOCHS):
        rng.shuffle(order)
        wrong = total = 0
        for at in order:
            if not hard[at] and rng.random() > 0.05:  # learned already
                continue
            flat, off, mask, y = built[at]
            u = np.add.reduceat(W[flat], off[:-1], axis=0).astype(float)
            u[~mask] = -1e9
            m, pair = _forward_backward(u, T)
            wrong += int((m.argmax(1) != y).sum())
            total += len(y)
            d = -m
            d[np.arange(len(y)), y] += 1
            hard[at] = np.abs(d).max() > 0.02
            if hard[at]:
                g_rows = np.repeat(d, np.diff(off), axis=0).astype(np.float32)
                uniq, inv = np.unique(flat, return_inverse=True)
                grad = np.zeros((len(uniq), L), np.float32)
                np.add.at(grad, inv, g_rows)
                grad -= L2 * W[uniq]
                G[uniq] += grad * grad
                W[uniq] += RATE * grad / np.sqrt(G[uniq])
                gold = np.zeros((L, L))
                np.add.at(gold, (y[:-1], y[1:]), 1)
                gt = gold - pair
                GT += gt * gt
                T += RATE * gt / np.sqrt(GT)
        print("epoch", epoch, "wrong", wrong, "of", total)
    keep = np.abs(W).max(1) > KEEP
    features = {x: [round(float(v), 2) for v in W[i]] for x, i in index.items() if keep[i]}
    return {"labels": list(pii.LABELS), "features": features, "transition": [[round(float(v), 3) for v in r] for r in T], "skip": 0.0, "vocabulary": sorted(vocabulary)}


def main(path: str, most: int = SAMPLE_DOCUMENTS) -> None:
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(path, columns=["text"]).column("text").to_pylist() if t][: most * 11 // 10]
    held = texts[most * 10 // 11 :]
    model, g, f = train(texts[: most * 10 // 11], most=most)
    scores = skip_likelihood(pii.Scorer(model), held, g, f)
    print("pseudo-likelihood by skip weight", scores)
    model["skip"] = max(scores, key=scores.get)
    print("agreement with the labels on texts left out", evaluate(pii.Scorer(model), held, g, f))
    pii.MODEL.write_text(json.dumps(model, ensure_ascii=False, separators=(",", ":")))
    print("kept", len(model["features"]), "features,", pii.MODEL.stat().st_size, "bytes")


def skip_likelihood(scorer: pii.Scorer, texts: list[str], g: set[str], f: set[str]) -> dict[float, float]:
    """Mean log-probability of a linked token's label given its chain and its partner's label, for each weight tried, over whole documents."""
    total, n = dict.fromkeys(SKIPS, 0.0), 0
    for text in texts:
        text = pii.composed(text)[0]
        _, keys, classes, labels = silver(text, g, f, scorer.vocabulary)
        links = pii.tokens(text)[3]
        docs = np.zeros(len(keys), np.int64)
        nodes, belief = pii.beliefs(scorer, scorer.unary(scorer.ids(keys, classes)), links, docs)
        a, b = pii.skip_pairs(links, docs, nodes)
        y = np.array(labels, np.int64)[nodes]
        for i, j in ((a, b), (b, a)):
            n += len(i)
            for s in SKIPS if len(i) else ():
                x = belief[i] + s * pii._AGREE[:, y[j]].T
                x -= x.max(1, keepdims=True)
                x -= np.log(np.exp(x).sum(1, keepdims=True))
                total[s] += float(np.maximum(x[np.arange(len(i)), y[i]], -20).sum())
    return {s: round(v / max(1, n), 5) for s, v in total.items()}


def evaluate(scorer: pii.Scorer, texts: list[str], g: set[str], f: set[str]) -> dict:
    """F1 by kind of found mentions against the labels from contexts."""
    hit, said, true = Counter(), Counter(), Counter()
    for at in range(0, len(texts), 200):
        part = [pii.composed(t)[0] for t in texts[at : at + 200]]
        for t, found in zip(part, pii.find_in(scorer, part), strict=True):
            spans, keys, _, labels = silver(t, g, f, scorer.vocabulary)
            want = set(pii._mentions(spans, np.array(labels, np.int64), keys))
            got = set(found)
            for x in got:
                said[x[2]] += 1
            for x in want:
                true[x[2]] += 1
            for x in got & want:
                hit[x[2]] += 1
    f1 = {k: round(2 * hit[k] / max(1, said[k] + true[k]), 4) for k in pii.KINDS}
    return f1 | {"all": 2 * sum(hit.values()) / max(1, sum(said.values()) + sum(true.values()))}


if __name__ == "__main__":
    main(sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else SAMPLE_DOCUMENTS)
