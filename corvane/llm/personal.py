"""Problem 9: personal data in free text by a semi-Markov conditional random field.

A line is a sequence of tokens that segments cover: a segment is one token that is nothing, or a span of one of five kinds, of
bounded length. Every span that the definition of a kind allows (its first, inner and last tokens; ``NAME_TOKENS`` and so on)
is scored by features of the whole span: forms of its tokens, word endings, known names, the words beside it. Tokens that are
nothing have scores of their own and neighbouring segments have transition scores. Bounded dynamic programming picks the best
segmentation, so boundaries and kinds are chosen together. No list of names is needed: known names are features only.
Weights come from ``train_personal``.
"""

from __future__ import annotations

import functools
import json
import re
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.runtime import spread

MODEL = str(Path(__file__).with_name("models") / "personal.json")
KINDS = ("email", "phone", "id_number", "address", "name")
#: Names that are read to the driver and sent to the executors; a larger table is refused, never cut.
MOST_NAMES = 100_000
#: Bounds of the segments, in tokens (phones, addresses, numbers, names) or labels (emails).
NAME_TOKENS, ADDRESS_TOKENS, NUMBER_GROUPS, DOMAIN_LABELS = 9, 26, 8, 8

_HIDDEN = "​‌‍⁠﻿­"
_PLAIN = {ord(c): " " for c in "\t\u000b\u000c\r                 　"}
_ODD = [chr(c) for c in _PLAIN]
_ANY_HIDDEN = re.compile(f"[{_HIDDEN}]")

_UP, _LOW = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĖĘĚĞĢĪİĶŁŃŅŇŌŐŘŚŞŠŢŤŪŮŰŲŹŻŽ", "a-zß-öø-ÿāăąćčďđēėęěğģīıķłńņňōőřśşšţťūůűųźżž"
#: What follows the first letter of a capitalised word, taken whole: no shorter part of a word can stand before a mark or a blank.
_WORD = f"[{_UP}{_LOW}]*+(?:['’][{_UP}{_LOW}]++)*+"
_CAP = f"[{_UP}]{_WORD}"
#: Small words inside family names and street names.
PARTICLES = ("van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "des", "la", "le", "los", "las", "el", "al", "bin", "ibn", "ten", "ter", "zu", "y")
_SMALL = "|".join(PARTICLES)
#: Kinds of ways, units and boxes in addresses, as forms of tokens.
WAYS = set(
    "road rd lane ln street st avenue ave yard drive dr close court ct terrace way place pl square sq crescent boulevard blvd row gardens walk mews parkway pkwy highway hwy circle trail hill "
    "rue place impasse quai route cours chemin allée calle c plaza avda avenida paseo camino ronda carrer straße strasse str platz allee weg gasse ring ufer damm via viale piazza corso vicolo largo rua praça "
    "straat laan plein gata gatan vej gade ulica ul".split()
)
#: Ways that are written small before their name.
_LOWWAYS = "rue|avenue|place|boulevard|chemin|allée|impasse|quai|route|cours|calle|plaza|avenida|paseo|camino|ronda|carrer|via|viale|piazza|corso|largo|rua|praça"
#: Patterns that begin with a set of characters skip fast to the next of them; what may not stand before is asked after it.
_NAME_RUN = re.compile(rf"[{_UP}](?<![\w'’@][{_UP}]){_WORD}(?:(?:\.? {{1,3}}|\. ?|-|, {{1,2}}|\.-)(?:(?:{_SMALL}) {{1,2}}){{0,3}}(?:[dl]['’])?{_CAP})+")
_NUMBER_RUN = re.compile(r"(?<![\w@])(?:\+ ?|\({1,2})?(?:[A-Za-z]{1,2}[ -]{1,2}(?=\d))?[A-Za-z]{0,4}\d\w*(?:[ ().\-/]{1,4}(?:[A-Za-z]{0,2}\d\w*|[A-Za-z]{1,2}(?!\w)))*")
#: Six digits as a number run has them, which holds in every run that is read further; lines without them need no search for runs.
_SIX_DIGITS = re.compile(r"\d(?:[^\W\d]*+(?:[ ().\-/]{1,4}(?:[A-Za-z]{1,2}(?!\w)[ ().\-/]{1,4})*[A-Za-z]{0,2})?\d){5}")
_ADDRESS_RUN = re.compile(
    rf"[{_UP}\d](?<![\w'’@][{_UP}\d])(?:(?<=\d)\d{{0,4}}[A-Za-z]?(?!\w)|(?<!\d){_WORD})(?:(?:[.]?,? {{1,3}}| - |[-/]|\.º ?|º ?|\. ?)(?:(?:{_LOWWAYS}|{_SMALL}|dell|bis|n|nº) ?[.'’]?º? ?){{0,3}}(?:[{_UP}][{_UP}{_LOW}]*(?:['’][{_UP}{_LOW}]+)*\d{{0,2}}(?:(?<=\d)[A-Z])?(?!\w)|\d{{1,5}}(?:[A-Za-z]{{1,2}})?(?!\w)|[a-z](?!\w)))+"
)
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+|[^\w\s]|_")
_DIGIT = re.compile(r"\d")
_SIDE = re.compile(r"[^\W_]+(?:['’.-][^\W_]+)*|[^\w\s]")
_AT = re.compile(r" {0,2}(?:@|[(\[{] ?[aA][tT] ?[)\]}]) {0,2}|(?<=\w) {1,2}(?:at|AT|At) {1,2}(?=[\w-]+ {1,2}(?:dot|DOT|Dot) )")
_LOCAL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._+%-]*$")
_DOT = r"(?:\.| {0,2}[(\[{] ?[dD][oO][tT] ?[)\]}] {0,2}| {1,2}(?:dot|DOT|Dot) {1,2})"
_DOMAIN = re.compile(rf"[A-Za-z0-9][\w-]*(?:{_DOT}[A-Za-z0-9][\w-]*)+")
_DOTS = re.compile(_DOT)
_WAY_END = re.compile(r"(?:stra(?:ß|ss)e|str|weg|platz|gasse|allee|ring|ufer|damm|straat|laan|gatan|vej|gade)$")
UNITS = set("flat unit suite apt apartment room floor appartement piso puerta wohnung interno ste".split())
BOXES = set("box pobox postfach casella apartado bp".split())


def clean(text: str) -> tuple[str, list[int] | None]:
    """Text without invisible characters and with plain blanks; where anything was taken out, the old position of each character."""
    where = None
    if not text.isascii() and _ANY_HIDDEN.search(text):
        where, at = [], 0
        for m in _ANY_HIDDEN.finditer(text):
            where += range(at, m.start())
            at = m.end()
        where += range(at, len(text))
        text = _ANY_HIDDEN.sub("", text)
    for c in _ODD[:4] if text.isascii() else _ODD:
        if c in text:
            text = text.replace(c, " ")
    return text, where


class Names:
    """Known given and family names and the endings that several known family names share; features, never a condition."""

    def __init__(self, given, family):
        self.given = {x.lower() for x in given}
        self.family = {x.lower() for x in family}
        ends: dict[str, int] = {}
        for x in self.family:
            ends[x[-3:]] = ends.get(x[-3:], 0) + 1
        self.ends = {k for k, n in ends.items() if n > 1}


def _before(t: str, a: int) -> list[str]:
    """Three lower-case tokens before a place, nearest first; ^ beyond the start of the line."""
    return [x.lower() for x in _SIDE.findall(t[max(0, a - 36) : a])[:-4:-1] + ["^", "^", "^"]][:3]


def _after(t: str, e: int) -> str:
    """The lower-case token after a place; $ at the end of the line."""
    right = _SIDE.search(t, e, e + 24)
    return right.group().lower() if right else "$"


def _sides(t: str, a: int, e: int) -> list[str]:
    left = _before(t, a)
    return ["l:" + left[0], "l2:" + left[1] + " " + left[0], "r:" + _after(t, e)]


@functools.lru_cache(maxsize=1 << 16)
def _letters(s: str) -> str:
    return re.sub(r"\d", "d", re.sub(r"[^\W\d_]", "A", re.sub(r" +", " ", s)))


def _name_class(w: str, names: Names) -> str:
    low = w.lower()
    if len(w) == 1:
        return "I"
    if low in names.given:
        return "B" if low in names.family else "K"
    if low in names.family or low[2:] in names.family and low[1] in "'’":
        return "F"
    return "C"


def _name_spans(t: str, names: Names, cased: str, out: list) -> None:
    for m in _NAME_RUN.finditer(t):
        base = m.start()
        toks = [(base + x.start(), base + x.end(), x.group()) for x in _TOKEN.finditer(m.group())]
        kinds = [_name_class(w, names) if w[0].isalpha() and w[0].isupper() else "p" if w[0].isalpha() else w for _, _, w in toks]
        n = len(toks)
        ends: dict[int, tuple] = {}  # what a span's features say of its last token
        run = "".join(kinds)
        for i in range(n):
            if kinds[i] not in "IKBFC" or (i and kinds[i - 1] in "-'" and kinds[i - 1] != "."):
                continue
            a = toks[i][0]
            if a and (t[a - 1].isalnum() or t[a - 1] in "-'’"):
                continue
            parts, comma, at_comma = 1, 0, 0
            left: list[str] = []
            for j in range(i + 1, min(n, i + NAME_TOKENS)):
                k = kinds[j]
                if k == ",":
                    comma += 1
                    if comma > 1:
                        break
                    at_comma = j
                    continue
                if k == "." and kinds[j - 1] != "I" and len(toks[j - 1][2]) > 3:
                    break  # the end of a sentence, not of an initial or a shortened word
                if k not in "IKBFC" and not (k == "." and kinds[j - 1] == "I" and comma):
                    continue
                if k in "IKBFC":
                    parts += 1
                e = toks[j][1]
                if e < len(t) and (t[e].isalnum() or t[e] in "-’" and e + 1 < len(t) and t[e + 1].isalnum()):
                    continue
                if k == "I" and not comma:
                    continue  # a family name is no single letter
                form = run[i : j + 1]
                if parts > 6 or not form.strip("I.,"):
                    continue
                if not left:
                    left = _before(t, a)
                    first = toks[i][2].lower()
                    more = ["more<" + kinds[i - 1]] if i and kinds[i - 1] in "IKBFCp" else []
                    sides = ["l:" + left[0], "l2:" + left[1] + " " + left[0]]
                    by_form = "lf:" + left[0] + " "
                if j not in ends:
                    right = _after(t, e)
                    ends[j] = ["more>" + kinds[j + 1]] if j + 1 < n and kinds[j + 1] in "IKBFCp" and toks[j + 1][0] - e < 3 else [], "r:" + right, "rf:" + right + k, "last:" + toks[j][2].lower()
                after, beside, by_end, last_token = ends[j]
                last = toks[at_comma - 1 if comma else j][2]
                given = toks[at_comma + 1][2].lower() if comma else first
                fam = last.lower()
                known = "1" if fam in names.family else "2" if fam[-3:] in names.ends else "0"
                out.append((a, e, "name", [
                    "form:" + form, "end" + known, "e3:" + fam[-3:], "e2:" + fam[-2:], "first:" + first, last_token, f"size:{min(12, len(toks[at_comma + 1 if comma else i][2]))}",
                    f"fl:{min(14, len(last))}", cased, "fe:" + form + known, "g2:" + given[-2:], *more, *after, *sides, beside, by_form + form, by_end,
                ]))


def _email_spans(t: str, out: list) -> None:
    for m in _AT.finditer(t):
        left, right = _LOCAL.search(t, max(0, m.start() - 64), m.start()), _DOMAIN.match(t, m.end())
        if not left or not right:
            continue
        local = left.group()
        starts = [left.start()] + [left.start() + i + 1 for i, c in enumerate(local[:-1]) if c in "._+%-"]
        stops = [right.start() + d.start() for d in _DOTS.finditer(right.group())][1:] + [right.end()]
        for a in starts[:DOMAIN_LABELS]:
            for k, e in enumerate(stops[:DOMAIN_LABELS]):
                tail = re.split(r"[^A-Za-z0-9-]+", t[right.start() : e])[-1].lower()
                f = ["whole" if a == left.start() else "cutleft", "toend" if e == right.end() else "cutright", "mark:" + m.group().strip().lower(), "tail" + str(min(8, len(tail))), "tail:" + tail, "labels" + str(k + 2)]
                out.append((a, e, "email", f + _sides(t, a, e)))


def _number_spans(t: str, out: list) -> None:
    if not _SIX_DIGITS.search(t):
        return
    for m in _NUMBER_RUN.finditer(t):
        s = m.group()
        if len(s) < 6 or len(_DIGIT.findall(s)) < 6:
            continue
        base = m.start()
        groups = [(base + x.start(), base + x.end()) for x in re.finditer(r"\w+", s)]
        n = len(groups)
        for i in range(n):
            a = groups[i][0]
            starts = [a]
            if a and t[a - 1] == "(":
                starts.append(a - 1)
            left: list[str] = []
            k = starts[-1]
            if k and t[k - 1] == "+":
                starts.append(k - 1)
            elif k > 1 and t[k - 2 : k] == "+ ":
                starts.append(k - 2)
            for j in range(i, min(n, i + NUMBER_GROUPS)):
                e = groups[j][1]
                digits = len(_DIGIT.findall(t, a, e))
                if digits < 6:
                    continue
                if digits > 15:
                    break
                cut = ["more<"] if i else []
                if j + 1 < n:
                    cut.append("more>" + t[e : e + 1])
                left = left or _before(t, starts[-1])
                side = ["l:" + left[0], "l2:" + left[1] + " " + left[0], "l3:" + left[2] + " " + left[1] + " " + left[0], "b:" + left[1], "r:" + _after(t, e)]
                span = t[a:e]
                shape = _letters(span)
                if not any(c.isalpha() for c in span):
                    for b in starts:
                        form = _letters(t[b:e])
                        whole = "open" if b != starts[-1] else "full"
                        f = ["shape:" + form, f"digits{digits}", "first:" + t[b] + (t[a : a + 1] if b != a else t[a + 1 : a + 2]), f"groups{j - i + 1}", whole, *cut, *side, "ls:" + left[0] + form]
                        if t[e : e + 1] == ")" and "(" not in t[b:e]:
                            f.append("unbalanced")
                        out.append((b, e, "phone", f))
                if j - i < 6:
                    before = t[a - 1 : a] if a else "^"
                    out.append((a, e, "id_number", ["shape:" + shape, f"digits{digits}", "before:" + before, *cut, *side, "ls:" + left[0] + shape]))


_WORDY = {"C", "S", "T", "U", "B"}


@functools.lru_cache(maxsize=1 << 16)
def _address_class(w: str) -> str:
    low = w.lower().rstrip(".")
    if w[0].isdigit():
        return "D5" if len(w) == 5 else "D1" if len(w) == 1 else "D"
    if not w[0].isalpha():
        return w
    if low in UNITS:
        return "U"
    if low in BOXES:
        return "B"
    if low in WAYS and len(low) > 1:
        return "S"
    if w[0].islower():
        return "p" if len(w) > 1 else "a"
    if len(w) <= 2 and w.isupper():
        return f"L{len(w)}"
    return "T" if _WAY_END.search(low) else "C"


def _address_spans(t: str, cased: str, out: list) -> None:
    for m in _ADDRESS_RUN.finditer(t):
        s = m.group()
        if len(s) < 9 or not _DIGIT.search(s):
            continue
        base = m.start()
        toks = [(base + x.start(), base + x.end(), x.group()) for x in _TOKEN.finditer(s)]
        n = len(toks)
        if n < 3:
            continue
        cls = [_address_class(w) for _, _, w in toks]
        if sum(x in _WORDY for x in cls) < 2 and not ("T" in cls or "S" in cls):
            continue  # one word and a number: a model, a date, a count
        joined = [False] + [toks[i][0] == toks[i - 1][1] for i in range(1, n)]
        # a phrase starts at a digit, after a mark or at the run's start; it ends before a mark or at the run's end
        begins = [i for i in range(n) if toks[i][2][0].isalnum() and not (joined[i] and toks[i - 1][2].isalnum()) and (i == 0 or cls[i][0] == "D" or cls[i] in "UBS" or not toks[i - 1][2][-1].isalnum() or cls[i - 1][0] == "D")]
        stops = [j for j in range(n) if toks[j][2][0].isalnum() and (j + 1 == n or not joined[j + 1] or not toks[j + 1][2].isalnum()) and (j + 1 == n or not toks[j + 1][2][0].isalnum() or cls[j][0] in "DL" or cls[j + 1][0] == "D" or cls[j] in "SC")]
        pairs = ["p:" + cls[k - 1] + cls[k] if k else "" for k in range(n)]
        ends: dict[int, tuple] = {}  # what a span's features say of what follows it
        for i in begins:
            a = toks[i][0]
            digit = False
            pair: set[str] = set()
            at = i
            left: list[str] = []
            for j in stops:
                if j < i + 2:
                    continue
                if j >= i + ADDRESS_TOKENS:
                    break
                digit = digit or any(x[0] == "D" for x in cls[at : j + 1])
                pair.update(pairs[max(at, i + 1) : j + 1])
                at = j + 1
                if not digit:
                    continue
                e = toks[j][1]
                if not left:
                    left = _before(t, a)
                    head = "head:" + "".join(cls[i : i + 3])
                    sides = ["l:" + left[0], "l2:" + left[1] + " " + left[0]]
                    first = "first:" + toks[i][2].lower()
                    more = ["more<" + cls[i - 1]] if i and toks[i - 1][2][0].isalnum() else []
                if j not in ends:
                    ends[j] = _after(t, e), ["more>" + "".join(cls[j + 1 : j + 3]), "gap>" + ("0" if joined[j + 1] else "1")] if j + 1 < n else []
                right, after = ends[j]
                inside = cls[i : j + 1]
                form = "".join(inside)
                tail = "".join(inside[-5:])
                has = ["has" + x for x in ("S", "T", "B", "U") if x in inside]
                if not has or has == ["hasU"]:
                    has.append("noway")
                out.append((a, e, "address", ["form:" + form, head, "tail:" + tail, f"n{min(16, j - i + 1)}", *sides, "r:" + right, "tr:" + tail + right, first, cased, *has, f"commas{min(5, form.count(','))}", *more, *after, *sorted(pair)]))


_TWO = re.compile(rf"[{_UP}]\S*[ \-]+(?:\S+ +){{0,3}}[{_UP}]")


def spans_of(line: str, names: Names) -> tuple[str, list[tuple[int, int, str, list[str]]]]:
    """The line as it is read (a line without case is given initial capitals), and all allowed spans with their features."""
    out: list[tuple[int, int, str, list[str]]] = []
    low = line.lower()
    cased = "asis"
    t = line
    if len(line) > 6 and (line == low or line == line.upper()):
        x = line.title()
        if len(x) == len(line) and x != line:
            t, cased = x, "cased"
    if "@" in low or " dot " in low or any(x in low for x in ("at)", "at]", "at}", "at )", "at ]", "at }")):
        _email_spans(line, out)
    digit = _DIGIT.search(t)
    if digit or _TWO.search(t):
        _name_spans(t, names, cased, out)
    if digit:
        _number_spans(line, out)
        _address_spans(t, cased, out)
    return t, out


@functools.lru_cache(maxsize=1 << 16)
def nothing(w: str) -> str:
    """Feature of a token that belongs to no personal data."""
    if w[0].isdigit():
        return f"d{min(9, len(w))}"
    if not w[0].isalpha():
        return "m" + w
    return ("U" if w[0].isupper() else "u") + w.lower()[-3:]


def clusters(t: str, spans: list) -> list[tuple[list[tuple[int, int, str]], list[tuple[int, int, int]]]]:
    """Runs of overlapping or touching spans as (tokens, [(first token, token after the last, number of the span)])."""
    order = sorted(range(len(spans)), key=lambda i: (spans[i][0], spans[i][1]))
    out, k = [], 0
    while k < len(order):
        a, e = spans[order[k]][0], spans[order[k]][1]
        m = k + 1
        while m < len(order) and (spans[order[m]][0] <= e or not t[e : spans[order[m]][0]].strip()):
            e = max(e, spans[order[m]][1])
            m += 1
        toks = [(a + x.start(), a + x.end(), x.group()) for x in _TOKEN.finditer(t[a:e])]
        first = {x[0]: i for i, x in enumerate(toks)}
        last = {x[1]: i + 1 for i, x in enumerate(toks)}
        out.append((toks, [(first[spans[i][0]], last[spans[i][1]], i) for i in order[k:m] if spans[i][0] in first and spans[i][1] in last]))
        k = m
    return out


@functools.lru_cache(maxsize=2)
def model(path: str) -> dict[str, float]:
    return json.loads(Path(path).read_text())


def score(kind: str, feats: list[str], weights: dict[str, float]) -> float:
    """Weight of a span that is of a kind."""
    get = weights.get
    s = get(kind, 0.0)
    for f in feats:
        s += get(kind + "|" + f, 0.0)
    return s


STATES = ("O", *KINDS)


def transitions(weights: dict[str, float]) -> dict[tuple[str, str], float]:
    return {(p, q): weights.get(f"T|{p}|{q}", 0.0) for p in STATES for q in STATES}


def best_segmentation(toks, segments, spans, weights, trans, own_features=None) -> list[int]:
    """Numbers of the spans of the best segmentation of a cluster (Viterbi over segments)."""
    n = len(toks)
    get = weights.get
    ending: list[list] = [[] for _ in range(n + 1)]
    for s, e, i in segments:
        ending[e].append((s, i))
    v: list[dict[str, tuple]] = [{"O": (0.0, None)}]
    for p in range(1, n + 1):
        here: dict[str, tuple] = {}
        own = get("O|" + (own_features[p - 1] if own_features else nothing(toks[p - 1][2])), 0.0)
        for q, (x, _) in v[p - 1].items():
            z = x + trans[q, "O"] + own
            if "O" not in here or z > here["O"][0]:
                here["O"] = (z, (p - 1, q, -1))
        for s, i in ending[p]:
            kind = spans[i][2]
            own = score(kind, spans[i][3], weights)
            for q, (x, _) in v[s].items():
                z = x + trans[q, kind] + own
                if kind not in here or z > here[kind][0]:
                    here[kind] = (z, (s, q, i))
        v.append(here)
    out, p = [], n
    q = max(v[n], key=lambda y: v[n][y][0])
    while p:
        s, before, i = v[p][q][1]
        if i >= 0:
            out.append(i)
        p, q = s, before
    return out[::-1]


class Finder:
    """Finds personal data with a model; what short lines hold is remembered."""

    def __init__(self, names: Names, weights: dict[str, float]):
        self.names, self.weights, self.seen = names, weights, {}
        t = self.transitions = transitions(self.weights)
        self.by_kind = {k: {f.split("|", 1)[1]: w for f, w in weights.items() if f.startswith(k + "|")} for k in STATES}
        self.empty = t["O", "O"]
        self.most = {k: weights.get(k, 0.0) + max(t[q, k] for q in STATES) + max(0.0, *(t[k, q] for q in STATES)) - self.empty for k in KINDS}

    def hopeless(self, toks, segments, spans) -> bool:
        """Whether no span can be in the best segmentation: each gains nothing over tokens that are nothing, whatever stands beside it."""
        own, total = self.by_kind["O"], [0.0]
        for x in toks:
            total.append(total[-1] + own.get(nothing(x[2]), 0.0) + self.empty)
        for s, e, i in segments:
            kind = spans[i][2]
            get = self.by_kind[kind].get
            gain = self.most[kind] - total[e] + total[s] + abs(self.empty)
            for f in spans[i][3]:
                gain += get(f, 0.0)
            if gain > 0:
                return False
        return True

    def line(self, line: str) -> list[tuple[int, int, str]]:
        got = self.seen.get(line)
        if got is None:
            t, spans = spans_of(line, self.names)
            got = []
            for toks, segments in clusters(t, spans):
                if not self.hopeless(toks, segments, spans):
                    got += [spans[i][:3] for i in best_segmentation(toks, segments, spans, self.weights, self.transitions)]
            if len(line) < 200:
                if len(self.seen) > 50_000:
                    self.seen.clear()
                self.seen[line] = got
        return got

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) of the personal data of a text, in code points of the text itself."""
        t, where = clean(text)
        out, at = [], 0
        for line in t.split("\n"):
            if len(line) > 5:
                out += [(at + a, at + e, k) for a, e, k in self.line(line)]
            at += len(line) + 1
        return out if where is None else [(where[a], where[e - 1] + 1, k) for a, e, k in out]


def find(text: str, names: Names, weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal data of one text."""
    return Finder(names, weights).find(text)


def _names(table: DataFrame) -> Names:
    rows = table.where("name is not null and kind is not null").select("name", "kind").distinct().limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names")
    return Names([r[0] for r in rows if r[1] == "given"], [r[0] for r in rows if r[1] == "family"])


def personal_spans(docs: DataFrame, person_names: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, kind, start_char, end_char of each span (code points of text, end excluded).

    Spans of a document do not overlap and lie within a line. A null or empty text has none; repeated rows give their
    spans once; a row without doc_id is left out; an empty table of names is allowed.
    """
    names = docs.sparkSession.sparkContext.broadcast(_names(person_names))  # at most MOST_NAMES

    def spans(batches):
        finder = Finder(names.value, model(path))
        for b in batches:
            ids, kinds, starts, ends = [], [], [], []
            for i, x in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                for a, e, k in finder.find(x or ""):
                    ids.append(i), kinds.append(k), starts.append(a), ends.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "kind", "start_char", "end_char"])

    return spread(docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")).mapInArrow(spans, "doc_id long, kind string, start_char int, end_char int").distinct()


def redacted(docs: DataFrame, person_names: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, text with each span replaced by its kind in brackets ([EMAIL], [ID_NUMBER], ...), n_spans. Null text stays null."""
    names = docs.sparkSession.sparkContext.broadcast(_names(person_names))

    def replace(batches):
        finder = Finder(names.value, model(path))
        for b in batches:
            texts, n = [], []
            for x in b.column("text").to_pylist():
                got = finder.find(x) if x else []
                parts, at = [], 0
                for a, e, k in got:
                    parts += [x[at:a], f"[{k.upper()}]"]
                    at = e
                texts.append("".join(parts) + x[at:] if x is not None else None), n.append(len(got))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), pa.array(n, pa.int32())], names=["doc_id", "text", "n_spans"])

    return spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(replace, "doc_id long, text string, n_spans int")
