"""Problem 5: main body of a page by a linear-chain conditional random field over its lines.

The pages here are text, so a line is the leaf block; there are no tags. States: main content, no content, and entry of a
list of other pages (also no content). Emissions are weights of features of the whole line (its words, length, marks, parts,
digits) and of its place; no list of phrases is asked. Transitions depend on whether a line carries the same list mark as
the one before. Weights come from ``train_blocks``; decoding is Viterbi.
"""

from __future__ import annotations

import functools
import json
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.runtime import spread

MODEL = str(Path(__file__).with_name("models") / "blocks.json")
S = 3
INVISIBLE = re.compile("[​‌‍﻿­⁠]")
SPACE = re.compile(r"\s+")
DECORATION = re.compile(r"^(?:[-*•→»·#|]\s+)+|(?:\s*(?:»|…|\*{3}|\(\d+\)|→))+$")
WORDS = re.compile(r"[^\W\d_]+(?:[-'][^\W\d_]+)*")
MARK = re.compile(r"\s*([-*•→»]|\d+[.)])\s")
CJK = re.compile("[぀-ヿ一-鿿]")
#: First character of features made of words; all others are forms of the line.
LEXICAL = "="
_FORMS = re.compile(r"@|\(at\)|\[at\]|©|[|·/»>]|\d")
_PARTS = re.compile(r"\s*[|·•»>/\[\]]+\s*|\s{2,}")
_STOP = re.compile(r"[.!?。](?=\s|$|[^\x00-\x7f])")


def plain(line: str) -> str:
    """Lower case, no invisible characters, single spaces, no list marks or trailing ornaments."""
    s = SPACE.sub(" ", INVISIBLE.sub("", line)).strip()
    return DECORATION.sub("", s).strip().lower()


def _steps(n: int) -> int:
    """Half powers of two, the same for all beyond 4,096."""
    k = min(n, 4096).bit_length()
    return 2 * k + (4096 > n > (3 << k) // 4)


def line_forms(line: str) -> tuple[list[str], list[str], str, str]:
    """Features of a whole line by itself but for its single words, its words, its list mark ("" if none), and the line as ``plain`` gives it."""
    m = MARK.match(line)
    mark = "" if not m else ("1" if m.group(1)[0].isdigit() else m.group(1))
    ascii_ = line.isascii()
    bare = (line if ascii_ else INVISIBLE.sub("", line)).strip()
    s = DECORATION.sub("", " ".join(bare.split())).strip()
    n = s.lower()
    size = len(n)
    cased = WORDS.findall(s)
    w = [x.lower() for x in cased]
    end = n[-1:] if n[-1:] in ".!?。:,;" else ""
    length = f"{_steps(size)}"
    stops = len(_STOP.findall(n))
    f = ["len" + length, "mark" + mark, "end" + end, f"le{length}{end}", f"words{_steps(len(w))}", f"stops{min(6, stops)}"]
    signs = [] if ascii_ else CJK.findall(n)
    if signs:
        cjk = "".join(signs)
        f += {"=j" + cjk[i : i + 3] for i in range(len(cjk) - 2)}
        f += ["=k" + n[-3:], "=j0" + n[:4], "=j2" + n[:2], f"cjk{_steps(len(signs))}{end}"]
    f += ["=a" + " ".join(w[:1]), "=b" + " ".join(w[:2]), "=c" + " ".join(w[:3]), "=z" + " ".join(w[-2:])]
    forms = set(_FORMS.findall(n))
    digits = sum(x.isdigit() for x in forms)
    f += ["f" + x for x in forms if not x.isdigit()]
    if digits:
        f.append(f"digits{min(4, digits)}")
    if not forms.isdisjoint("|·/»>") or "  " in bare or "[" in bare or "•" in bare or "]" in bare or (not ascii_ and _PARTS.search(bare)):
        parts = [x for x in _PARTS.split(bare) if x]
        if len(parts) > 1:
            longest = max(len(x) for x in parts)
            f += [f"parts{min(8, len(parts))}", f"part{_steps(longest)}", f"pp{min(8, len(parts))}{_steps(longest) // 2}"]
    if w:
        big = sum([x[0].isupper() for x in cased])
        f.append(f"big{4 * big // len(w)}{min(3, len(w))}")
    if n[:1] == "/" and " " not in n:
        f.append("path")
    if size < 110 and not end:
        f.append("titled")
    return f, w, mark, n


def line_features(line: str) -> tuple[list[str], str, str]:
    """All features of a line, its list mark, and the line as ``plain`` gives it."""
    f, w, mark, n = line_forms(line)
    return f + ["=w" + x for x in set(w)], mark, n


def page_features(lines: list[str], title: str, cache: dict) -> tuple[list[int], list[list[str]], np.ndarray]:
    """Numbers of the non-blank lines, their features, and whether each repeats the list mark before it (0 no, 1 yes)."""
    at, own = [], []
    for i, x in enumerate(lines):
        if not INVISIBLE.sub("", x).strip():
            continue
        got = cache.get(x)
        if got is None:
            got = cache[x] = line_features(x)
        at.append(i), own.append(got)
    name = plain(title or "")
    n = len(at)
    out = []
    for k in range(n):
        extra = [f"top{min(k, 6)}", f"bottom{min(n - 1 - k, 8)}"]
        if name and len(own[k][2]) > 8 and name.startswith(own[k][2]):
            extra.append("title")
        out.append(own[k][0] + extra)
    same = np.array([0] + [int(bool(own[k][1]) and own[k][1] == own[k - 1][1]) for k in range(1, n)], np.int8) if n else np.zeros(0, np.int8)
    return at, out, same


@functools.lru_cache(maxsize=2)
def model(path: str) -> tuple[dict[str, tuple], np.ndarray, np.ndarray]:
    m = json.loads(Path(path).read_text())
    return {k: tuple(v) for k, v in m["emission"].items()}, np.array(m["transition"]), np.array(m["start"])


def viterbi(e: np.ndarray, same, transition: np.ndarray, start: np.ndarray) -> list[int]:
    """Best states; e is (n, S), transition (2, S, S) by whether the list mark repeats."""
    v = (start + e[0]).tolist()
    t0, t1 = transition.tolist()
    back = []
    el = e.tolist()
    for k in range(1, len(el)):
        t = t1 if same[k] else t0
        nxt, ptr = [], []
        for j in range(S):
            a, b, c = v[0] + t[0][j], v[1] + t[1][j], v[2] + t[2][j]
            if a >= b and a >= c:
                nxt.append(a + el[k][j]), ptr.append(0)
            elif b >= c:
                nxt.append(b + el[k][j]), ptr.append(1)
            else:
                nxt.append(c + el[k][j]), ptr.append(2)
        v = nxt
        back.append(ptr)
    s = int(np.argmax(v))
    out = [s]
    for ptr in reversed(back):
        s = ptr[s]
        out.append(s)
    return out[::-1]


class Tagger:
    """Tags pages with a model; what a short line adds by itself is remembered."""

    def __init__(self, path: str = MODEL):
        self.weights, self.transition, self.start = model(path)
        self.words = {k[2:]: v for k, v in self.weights.items() if k.startswith("=w")}
        self.cache: dict = {}

    def _own(self, line: str) -> tuple[np.ndarray, str, str] | None:
        got = self.cache.get(line)
        if got is None:
            if not line.isascii() and not INVISIBLE.sub("", line).strip():
                return None
            feats, words, mark, n = line_forms(line)
            got = (self._sum(feats, self.weights) + self._sum(set(words), self.words), mark, n)
            if len(line) < 120:
                if len(self.cache) > 50_000:
                    self.cache.clear()
                self.cache[line] = got
        return got

    @staticmethod
    def _sum(feats, weights: dict[str, tuple]) -> np.ndarray:
        a = b = c = 0.0
        get = weights.get
        for f in feats:
            x = get(f)
            if x is not None:
                a, b, c = a + x[0], b + x[1], c + x[2]
        return np.array((a, b, c))

    def states(self, text: str, title: str) -> list[tuple[int, int]]:
        """(line number, state) of the non-blank lines of a page."""
        at, own = [], []
        for i, x in enumerate(text.split("\n")):
            if x and not x.isspace():
                got = self._own(x)
                if got is not None:
                    at.append(i), own.append(got)
        n = len(at)
        if not n:
            return []
        name = plain(title or "")
        e = np.stack([x[0] for x in own])
        for k in {*range(min(6, n)), *range(max(0, n - 8), n)}:
            e[k] += self._sum([f"top{min(k, 6)}", f"bottom{min(n - 1 - k, 8)}"], self.weights)
        if n > 14:
            e[6 : n - 8] += self._sum(["top6", "bottom8"], self.weights)
        if name:
            for k in range(n):
                if len(own[k][2]) > 8 and name.startswith(own[k][2]):
                    e[k] += self._sum(["title"], self.weights)
        same = [0] + [int(bool(own[k][1]) and own[k][1] == own[k - 1][1]) for k in range(1, n)]
        return list(zip(at, viterbi(e, same, self.transition, self.start)))


def boilerplate_lines(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, line_no (from 0, blank lines counted) of lines that are not main content.

    A null or empty text has no lines; a null title is as an empty one. Repeated rows give their lines once.
    """

    def tag(batches):
        t = Tagger(path)
        for b in batches:
            ids, at = [], []
            for i, text, title in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("title").to_pylist()):
                for k, s in t.states(text or "", title or ""):
                    if s:
                        ids.append(i), at.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int32())], names=["doc_id", "line_no"])

    return spread(docs.select(F.col("doc_id").cast("long"), "text", "title").where("doc_id is not null and text is not null")).mapInArrow(tag, "doc_id long, line_no int").distinct()


def main_bodies(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, body (main content lines joined by line breaks), n_removed. Null text gives a null body and 0."""

    def strip(batches):
        t = Tagger(path)
        for b in batches:
            bodies, gone = [], []
            for text, title in zip(b.column("text").to_pylist(), b.column("title").to_pylist()):
                if text is None:
                    bodies.append(None), gone.append(0)
                    continue
                drop = {k for k, s in t.states(text, title or "") if s}
                bodies.append("\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop).strip("\n")), gone.append(len(drop))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(bodies, pa.string()), pa.array(gone, pa.int32())], names=["doc_id", "body", "n_removed"])

    return spread(docs.select(F.col("doc_id").cast("long"), "text", "title")).mapInArrow(strip, "doc_id long, body string, n_removed int")
