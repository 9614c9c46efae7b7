"""Do two texts read off pictures say the same: words compared by shape, misreadings forgiven, numbers never."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least confidences of a word, of a box and of a difference that counts; share of common words and least
#: number of words for another document; letters forgiven in all and as a share of the text; letters compared at most.
WORD, BOX, SURE, SHARE, WORDS, FORGIVEN, FORGIVEN_SHARE, LETTERS = 0.5, 0.75, 0.9, 0.5, 5, 3, 0.05, 2000
#: Shapes that a reader confuses.
ALIKE = str.maketrans({"0": "o", "1": "l", "i": "l", "5": "s", "$": "s", "8": "b", "2": "z", "6": "g", "£": "e", "€": "e"})
ALIKE_PAIRS = (("rn", "m"), ("vv", "w"))
MARK = "\x1f"


def shape(word: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", word) if unicodedata.category(c) != "Mn").lower().translate(ALIKE)
    out = "".join(filter(str.isalnum, plain))
    for pair, one in ALIKE_PAIRS:
        out = out.replace(pair, one)
    return out


def is_number(word: str) -> bool:
    letters = [c for c in word if c.isalnum()]
    digits = sum(c.isdecimal() for c in letters)
    return 0 < digits and len(letters) <= 2 * digits


def kept_words(reading: str | None) -> list[tuple[str, float, bool]]:
    """(shape, confidence, number) of the words worth comparing. Boxes end at tabs and line ends, a word's percent follows its mark."""
    out = []
    for box in (reading or "").replace("\n", "\t").split("\t"):
        words = []
        for token in filter(None, box.split(" ")):
            text, mark, percent = token.rpartition(MARK)
            words.append((text, int(percent) / 100 if percent.lstrip("-").isdecimal() else 1.0) if mark else (token, 1.0))
        size = sum(len(t) for t, _ in words)
        if size and sum(len(t) * c for t, c in words) / size >= BOX - 1e-9:
            own = [(s, c, is_number(t)) for t, c in words if c >= WORD and (s := shape(t))]
            out += own if sum(len(s) for s, _, _ in own) >= 2 else []
    return out


def edits(a: str, b: str) -> int:
    """Levenshtein's distance, a row at a time: insertions along a row are a running minimum."""
    x, along = np.frombuffer(b.encode("utf-32-le"), np.uint32), np.arange(len(b) + 1)
    row = along.copy()
    for i, c in enumerate(a, 1):
        step = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (x != ord(c)))])
        row = np.minimum.accumulate(step - along) + along
    return int(row[-1])


def anchors(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence; where either side may be passed over, the first one is.

    Of the table of what is left to gain only each ``step``-th row is kept; the walk makes the rows between two of them again when
    it comes there. That is twice the work in the room of about twice the square root of ``a`` rows, for the same places, ties included.
    """
    code = {w: k for k, w in enumerate(dict.fromkeys(a + b))}
    left, right = (np.array([code[w] for w in words], np.int64) for words in (a, b))

    def above(i: int, below: np.ndarray) -> np.ndarray:
        row = np.zeros(len(b) + 1, np.int32)
        row[:-1] = np.maximum(below[:-1], np.where(right == left[i], below[1:] + 1, 0))
        return np.maximum.accumulate(row[::-1])[::-1]

    step = max(1, int(len(a) ** 0.5))
    row, kept = np.zeros(len(b) + 1, np.int32), {len(a): np.zeros(len(b) + 1, np.int32)}
    for i in range(len(a) - 1, -1, -1):
        row = above(i, row)
        if i % step == 0:
            kept[i] = row
    out, i, j, rows = [], 0, 0, {}
    while i < len(a) and j < len(b):
        if i + 1 not in rows:
            # the rows from here to the next that is kept
            end = min(len(a), (i // step + 1) * step)
            rows = {end: kept[end]}
            for k in range(end - 1, i - 1, -1):
                rows[k] = above(k, rows[k + 1])
        if left[i] == right[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif rows[i + 1][j] >= rows[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def compare(a: str | None, b: str | None) -> tuple[str, int, int, int]:
    """Verdict (same, differs, unrelated), stretches that differ, words of each."""
    x, y = kept_words(a), kept_words(b)
    text = lambda words: "".join(w[0] for w in words)
    common = anchors([w[0] for w in x], [w[0] for w in y]) if text(x) != text(y) else []
    stretches = letters = 0
    at = (-1, -1)
    for end in [*common, (len(x), len(y))] if text(x) != text(y) else []:
        u, v = x[at[0] + 1 : end[0]], y[at[1] + 1 : end[1]]
        at = end
        s, t = text(u), text(v)
        if s == t or max(w[1] for w in u + v) < SURE:
            continue
        far = edits(s, t)
        if any(w[2] for w in u + v) or far > max(1, max(len(s), len(t)) // 4):
            stretches += 1
        else:
            letters += far
    stretches += letters > max(FORGIVEN, FORGIVEN_SHARE * min(len(text(x)), len(text(y))))
    fewer = min(len(x), len(y))
    if not stretches:
        return "same", 0, len(x), len(y)
    other = fewer >= WORDS and len(common) < SHARE * fewer
    if other:
        s, t = text(x)[:LETTERS], text(y)[:LETTERS]
        other = edits(s, t) > SHARE * max(len(s), len(t))
    return "unrelated" if other else "differs", stretches, len(x), len(y)


def compared(a: Column, b: Column) -> Column:
    """A struct of verdict, stretches, words_a, words_b for two readings; null and empty readings have no words."""

    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([compare(x, y) for x, y in zip(a, b, strict=True)], columns=["verdict", "stretches", "words_a", "words_b"])

    return F.pandas_udf(run, "verdict string, stretches int, words_a int, words_b int")(a, b)
