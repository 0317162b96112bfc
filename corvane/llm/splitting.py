"""Problem 1: cutting texts above a size limit at natural boundaries, with an overlap.

A recursive separator hierarchy gives cut points (section, paragraph or list item, sentence, word, character);
pieces are packed greedily up to the limit and each next piece starts a few words before the end of the last.
Texts within the limit never leave the JVM.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_WORDS, MAX_CHARS, OVERLAP_WORDS = 256, 2000, 30
#: A text without spaces gets its overlap in characters.
OVERLAP_CHARS = 240
WORD = re.compile(r"\S+")
SECTION = re.compile(r"\n(?:[ \t]*\n){2,}|\n(?=#{1,6} )")
PARAGRAPH = re.compile(r"\s*\n\s*")
SENTENCE = re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？][」』）]*\s*")
#: Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = {
    "fig", "no", "nr", "vol", "cf", "i.e", "e.g", "z.b", "bzw", "dr", "mr", "mrs", "ms", "prof", "st", "p.ej", "art",
    "núm", "ca", "approx", "etc", "vs", "d.h", "u.a", "sr", "sra", "mme", "av", "inc", "ltd", "co", "pp", "p", "ed",
}


def too_large(text: Column, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS) -> Column:
    """Whether a text is above the limit; a word is a run of characters that are no Unicode white space."""
    return (F.char_length(text) > max_chars) | (F.regexp_count(text, F.lit(r"(?U)\S+")) > max_words)


def _sentence_ends(text: str) -> list[int]:
    ends = []
    for m in SENTENCE.finditer(text):
        if text[m.start()] == ".":
            k = m.start()
            while k > 0 and not text[k - 1].isspace():
                k -= 1
            last = text[k : m.start()].lstrip("(\"'“«[").lower()
            nxt = text[m.end() : m.end() + 1]
            if last in ABBREVIATIONS or (len(last) == 1 and last.isalpha()) or nxt.islower():
                continue
        ends.append(m.end())
    return ends


def split_text(text: str, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_WORDS) -> list[tuple[int, int]]:
    """Spans (start, end) of the pieces of ``text``; edges carry no white space, all words are covered.

    A text of white space only gives one empty piece."""
    words = [m.span() for m in WORD.finditer(text)]
    if not words:
        return [(0, 0)]
    starts = [a for a, _ in words]
    levels = [sorted({m.end() for m in SECTION.finditer(text)}), sorted({m.end() for m in PARAGRAPH.finditer(text)}), _sentence_ends(text)]
    out: list[tuple[int, int]] = []
    begin = words[0][0]
    last = words[-1][1]
    while True:
        w = bisect.bisect_right(starts, begin) - 1
        # the furthest end that the limit allows, on a word's edge where one word fits
        top = min(begin + max_chars, words[w + max_words - 1][1] if w + max_words <= len(words) else last)
        if top >= last:
            out.append((begin, last))
            return out
        floor = out[-1][1] if out else begin  # a piece must reach beyond the last one
        least = begin + (top - begin) // 3
        cut = 0
        for ends in levels:
            k = bisect.bisect_right(ends, top + 1) - 1
            while k >= 0 and _trim(text, ends[k]) > top:
                k -= 1
            if k >= 0 and ends[k] > max(least, floor):
                cut = _trim(text, ends[k])
                if cut > max(least, floor):
                    break
                cut = 0
        if not cut:
            k = bisect.bisect_right(starts, top) - 1  # word edge
            while k >= 0 and words[k][1] > top:
                k -= 1
            cut = words[k][1] if k >= 0 and words[k][1] > max(floor, begin) else top
        out.append((begin, cut))
        begin = _overlap_start(text, words, starts, levels, begin, cut, overlap)


def _trim(text: str, end: int) -> int:
    while end > 0 and text[end - 1].isspace():
        end -= 1
    return end


def _overlap_start(text, words, starts, levels, begin, cut, overlap) -> int:
    """Where the next piece begins: a sentence's start between two thirds and four thirds of the overlap, else a word's."""
    k = bisect.bisect_left(starts, cut) - 1  # last word of the piece
    if overlap <= 0:
        return starts[k + 1] if words[k][1] <= cut else cut
    first = max(0, k - overlap + 1)
    low, high = max(0, k - overlap * 4 // 3 + 1), max(0, k - overlap * 2 // 3 + 1)
    at = starts[first]
    if cut - at > OVERLAP_CHARS * 2:  # hardly any spaces
        near = [e for e in levels[2] if cut - OVERLAP_CHARS * 4 // 3 <= e < cut - OVERLAP_CHARS // 3]
        at = near[0] if near else cut - OVERLAP_CHARS
        while at < cut and text[at].isspace():
            at += 1
    else:
        for ends in (levels[1], levels[2]):
            i = bisect.bisect_left(ends, starts[low])
            near = [e for e in ends[i : i + 8] if starts[low] <= e <= starts[high]]
            if near:
                at = min(near, key=lambda e: abs(e - starts[first]))
                break
    if at <= begin:  # a very short piece has no room for the overlap
        return starts[k + 1] if k + 1 < len(starts) and words[k][1] <= cut else cut
    return at


def split_oversized(chunks: DataFrame, max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_WORDS) -> DataFrame:
    """chunk_id, doc_id, piece_no, text, start_char, end_char, heading_path, oversized.

    A text within the limit (null and empty ones too) passes as piece 0 and is not oversized. Repeated rows come out
    once. Offsets count code points of the document (start_char of the chunk; 0 where it is null); heading_path is the
    chunk's, null where that is null. Other columns, whatever their names, are left behind.
    """
    cols = ["chunk_id", "doc_id", "text", F.coalesce("start_char", F.lit(0)).alias("start_char"), "end_char", "heading_path"]
    base = chunks.select(*cols).withColumn("oversized", F.coalesce(too_large(F.col("text"), max_words, max_chars), F.lit(False)))
    fits = base.where("not oversized").dropDuplicates(["chunk_id", "start_char", "end_char", "text"]).select(
        "chunk_id", "doc_id", F.lit(0).alias("piece_no"), "text", "start_char", "end_char", "heading_path", F.lit(False).alias("oversized")
    )
    schema = "chunk_id string, doc_id long, piece_no int, text string, start_char int, end_char int, heading_path array<string>, oversized boolean"

    def cut(batches):
        for b in batches:
            src, no, texts, a, z = [], [], [], [], []
            for i, (text, start) in enumerate(zip(b.column("text").to_pylist(), b.column("start_char").to_pylist())):
                for k, (s, e) in enumerate(split_text(text, max_words, max_chars, overlap)):
                    src.append(i), no.append(k), texts.append(text[s:e]), a.append(start + s), z.append(start + e)
            take = pa.array(src, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("chunk_id").take(take), b.column("doc_id").take(take), pa.array(no, pa.int32()), pa.array(texts, pa.string()),
                 pa.array(a, pa.int32()), pa.array(z, pa.int32()), b.column("heading_path").take(take), pa.array([True] * len(no))],
                names=["chunk_id", "doc_id", "piece_no", "text", "start_char", "end_char", "heading_path", "oversized"],
            )

    large = base.where("oversized").dropDuplicates(["chunk_id", "start_char", "end_char", "text"]).select(
        F.col("chunk_id").cast("string"), F.col("doc_id").cast("long"), "text", "start_char", "heading_path"
    )
    return fits.unionByName(large.mapInArrow(cut, schema))
