"""Personal data: exact patterns, and a character-level bidirectional LSTM with CRF transitions beside them.

The patterns find the regular spellings of e-mail and IP addresses, cards and phone numbers. The tagger is trained on
labelled spans (``spans_for_training``: sentences with regular and irregular spellings and with numbers
that are nothing personal) and adds what the patterns miss, such as "jo (at) host.org", "10[.]0[.]0[.]7",
"4111.1111.1111.1111" or "(743) 555-3824". A text is read in windows of ``WIDTH`` characters, each half
over the next. Decoded spans of one kind that meet are joined; of those that overlap the set of the largest
total weight is kept over the whole text. A span of the tagger counts if it passes its kind's checks (digits, Luhn,
parts) and touches no span of a pattern. Such a span has digits or an "@" that no pattern took, so windows
without any can be passed over without changing the result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bilstm_crf import BiLstmCrf

#: The kinds in their order.
KINDS = ["email", "ip", "card", "phone"]
WIDTH, HALF = 64, 32
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_CUE = re.compile(r"[0-9]+|@|[\[(]at[\])]")
_MARKS = " @.-+()[]:_/%#=\"',\n"
_OWN = "atdo"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def valid(kind: str, text: str) -> bool:
    """The checks on a candidate of a kind, in any spelling."""
    if kind == "email":
        return ("@" in text or "(at)" in text or "[at]" in text) and "." in text.replace("(dot)", ".").replace("[dot]", ".").strip(".")
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 18 and int(p) <= 255 for p in parts)
    digits = _digits(text)
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the exact patterns, leftmost and not overlapping in each kind, in order."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:  # the part before an @ is the run of its characters that no earlier match took
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
        last = m.end() if m else at + 1
        at = text.find("@", last)
    if _DIGIT.search(text):
        # a run of digits is taken whole, so a match begins where a run does and nothing is tried twice
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def _class_table() -> np.ndarray:
    table = np.zeros(0x250, np.int64)
    first = len(_MARKS) + len(_OWN)
    for i in range(0x250):
        c = chr(i)
        if c.isdigit():
            table[i] = first + 1
        elif c.isalpha():
            table[i] = first + (2 if c.islower() else 3)
        else:
            table[i] = first + 4
    for i, c in enumerate(_MARKS + _OWN):
        table[ord(c)] = i + 1
    table[0], table[-1] = 0, first + 2
    return table


_CLASS = _class_table()
CLASSES = int(_CLASS.max()) + 1


def coded(windows: list[str]) -> np.ndarray:
    """Classes of the characters of windows of at most WIDTH characters; 0 after their ends."""
    joined = "".join(w.replace("\0", " ").ljust(WIDTH, "\0") for w in windows)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CLASS[np.minimum(points, 0x24F)].reshape(-1, WIDTH)


def spans_for_training(count: int = 12_000, seed: int = 31) -> tuple[list[str], np.ndarray]:
    """Windows of text and their tags: labelled spans in made-up sentences."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    digits = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    letters = "eeetaoinshrdlucmfwygpbvkäößéèçñíó"
    word = lambda: "".join(letters[i] for i in rng.integers(0, len(letters), rng.integers(2, 10)))
    plain = lambda: "".join(letters[i] for i in rng.integers(0, 22, rng.integers(2, 9)))

    def card() -> str:
        body = pick("4", "5", "3", "6") + digits(int(rng.choice([12, 13, 14, 14, 14, 15])))
        body += next(d for d in "0123456789" if luhn(body + d))
        mark = pick("", "", " ", "-", ".", "/", "_", " - ", "  ", ". ")
        return mark.join(body[i : i + 4] for i in range(0, len(body), 4))

    def email() -> str:
        name = plain() + pick("", "." + plain(), "." + digits(2), digits(2), "_" + plain())
        host = plain() + pick("", digits(1)), plain(), pick("com", "org", "net", "de", "fr", "io")
        host = host[:: pick(1, 1)] if pick(True, False) else (host[0], host[2])
        dot = pick(".", ".", ".", " (dot) ", "[dot]", " . ")
        return name + pick("@", "@", "@", " (at) ", "(at)", "[at]", " [at] ", " @ ") + dot.join("".join(h) for h in host)

    def ip() -> str:
        return pick(".", ".", "[.]", "(.)", " . ", ",", "[dot]", "-").join(str(int(n)) for n in rng.integers(0, 256, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick(
            f"+{pick('1', '44', '49', '33')} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1/{a}/{b}/{c}", f"001 {a} {b} {c}",
            f"00{pick('33', '49', '34')} {digits(1)} {' '.join(digits(2) for _ in range(4))}", f"+{digits(11)}", f"({a}){b}.{c}", f"1-{a}-{b}-{c}", f"+1_{a}_{b}_{c}",
        )

    def other() -> str:
        return pick(
            "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, pick(8, 32, 40, 64))), f"20{digits(2)}-{pick('01', '11')}-{digits(2)}", f"{digits(2)}/{digits(2)}/20{digits(2)}", f"{digits(1)}.{digits(1)}",
            f"{digits(1)}.{digits(2)}.{digits(1)}", digits(int(rng.integers(1, 9))), f"{digits(3)},{digits(3)}.{digits(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"20{digits(2)}", digits(int(rng.integers(20, 30))), f"AB-{digits(5)}",
            " ".join(digits(int(rng.integers(1, 3))) for _ in range(int(rng.integers(3, 9)))), f"{digits(2)}%", f"@{plain()}", f"20{digits(2)}-01-{digits(2)} {digits(2)}:{digits(2)}:{digits(2)}", f"#{digits(6)}", f"{plain()} @ {digits(2)}.{digits(2)}",
            f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"{digits(int(rng.integers(9, 19)))}", f"/{plain()}/{digits(4)}/{digits(2)}",
            pick(" ", ",", ".").join([digits(int(rng.integers(1, 4))), *(digits(3) for _ in range(int(rng.integers(1, 5))))]) + pick("", "", f" (20{digits(2)})", f" (19{digits(2)})"), f"{digits(1)}-{digits(1)}-{digits(1)}", f"-{digits(2)}.{digits(1)} to {digits(2)}.{digits(1)}",
        )

    texts, tags = [], np.zeros((count, WIDTH), np.int64)
    for n in range(count):
        made = [(0, card), (1, ip), (2, card), (3, phone), (0, email)][int(rng.integers(5))]
        kind = {card: 2, ip: 1, phone: 3, email: 0}[made[1]]
        text, marks = " ".join(word() for _ in range(int(rng.integers(0, 10)))), []
        for _ in range(2):
            text += pick(" ", " ", ". ", ", ", "\n", ": ", ' = "', " (")
            new = rng.random() < 0.6
            own = made[1]() if new else other()
            if new:
                marks.append((len(text), len(text) + len(own)))
            text += own + pick("", "", ".", ",", '"', "###", "!!", ")", " ") + " " + " ".join(word() for _ in range(int(rng.integers(1, 5))))
        start = int(rng.integers(0, max(1, len(text) - WIDTH)))
        texts.append(text[start : start + WIDTH])
        for a, b in marks:
            a, b = max(a - start, 0), min(b - start, WIDTH)
            if a < b:
                tags[n, a:b] = 2 * kind + 2
                tags[n, a] = 2 * kind + 1
    return texts, tags


@lru_cache(maxsize=1)
def trained() -> BiLstmCrf:
    """The tagger: it learns from generated spans only, so it is the same for every table."""
    texts, tags = spans_for_training()
    return BiLstmCrf(CLASSES, len(KINDS), hidden=20).fit(coded(texts), tags, steps=900)


class Taken:
    """Spans (kind, start, end), joined where they meet, so one bisection tells whether a stretch meets any of them."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted((s, e) for _, s, e in spans):
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b) - 1
        return i >= 0 and self.ends[i] > a


def _windows(text: str, taken: list[tuple[int, int, int]]) -> list[int]:
    """Starts of the windows that hold four digits, or an @, that no span of a pattern took."""
    digits: dict[int, int] = {}
    spans = Taken(taken)
    for m in _CUE.finditer(text):
        a, b = m.span()
        if not spans.meets(a, b):
            for cell in range(a // HALF, (b - 1) // HALF + 1):
                digits[cell] = digits.get(cell, 0) + (min(b, (cell + 1) * HALF) - max(a, cell * HALF) if m[0][0].isdigit() else 4)
    last = max(0, -(-len(text) // HALF) - 2)
    return sorted({w * HALF for cell in digits for w in (cell - 1, cell) if 0 <= w <= last and digits.get(w, 0) + digits.get(w + 1, 0) >= 4})


def reconciled(found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """Of (kind, start, end, weight) from all windows: those of a kind that meet joined, then the best set without overlaps."""
    joined: list[list] = []
    for k in range(len(KINDS)):
        own: list[list] = []
        for _, s, e, w in sorted(f for f in found if f[0] == k):
            if own and s < own[-1][2]:
                own[-1][2], own[-1][3] = max(own[-1][2], e), max(own[-1][3], w)
            else:
                own.append([k, s, e, w])
        joined += own
    joined.sort(key=lambda f: (f[2], f[1]))
    best: list[tuple[float, int, int]] = []  # weight so far, the span taken or -1, where to go on
    ends = [f[2] for f in joined]
    for i, (_, s, _, w) in enumerate(joined):
        before = bisect_right(ends, s, 0, i) - 1
        take, leave = w + (best[before][0] if before >= 0 else 0.0), best[i - 1][0] if i else 0.0
        best.append((take, i, before) if take > leave else (leave, -1, i - 1))
    out, i = [], len(joined) - 1
    while i >= 0:
        if best[i][1] >= 0:
            out.append(tuple(joined[best[i][1]][:3]))
        i = best[i][2]
    return out[::-1]


class PersonalData:
    """Spans of personal data in whole texts; see the module's text.

    Null, empty and blank texts have none. Repeated rows are read one by one, a null doc_id stays null; an
    empty table gives an empty result. Other columns are ignored, or kept as they are by ``redact``.
    """

    def __init__(self, model: BiLstmCrf | None = None):
        self.model = model or trained()

    def spans(self, texts: list[str | None]) -> list[tuple[list, list]]:
        """Of each text the patterns' spans and all spans, both (kind, start, end) in order."""
        base = [base_spans(t) if t else [] for t in texts]
        places, windows = [], []
        for d, t in enumerate(texts):
            if t:
                for start in _windows(t, base[d]):
                    places.append((d, start))
                    windows.append(t[start : start + WIDTH])
        found: dict[int, list] = {}
        for lo in range(0, len(windows), 1024):
            codes, back = np.unique(coded(windows[lo : lo + 1024]), axis=0, return_inverse=True)
            tags, gain = self.model.decode(codes)
            # only windows with a tag matter
            for i in np.flatnonzero((tags > 0).any(1)[back.ravel()]):
                row, weight = tags[back.ravel()[i]], gain[back.ravel()[i]]
                d, start = places[lo + i]
                size = len(windows[lo + i])
                firsts = np.flatnonzero((row[:size] > 0) & ((row[:size] % 2 == 1) | (np.concatenate([[0], row[: size - 1]]) == 0)))
                for a in firsts:
                    kind, b = (int(row[a]) - 1) // 2, a + 1
                    while b < size and row[b] == 2 * kind + 2:
                        b += 1
                    found.setdefault(d, []).append((kind, start + int(a), start + int(b), float(weight[a:b].sum())))
        out = []
        for d, t in enumerate(texts):
            # an opening bracket whose other side is in the span belongs to it
            own = [(k, s - (s > 0 and t[s - 1] == "(" and t.count(")", s, e) > t.count("(", s, e)), e) for k, s, e in reconciled(found[d])] if d in found else []
            taken = Taken(base[d]) if own else None
            more = [(k, s, e) for k, s, e in own if not taken.meets(s, e) and valid(KINDS[k], t[s:e])]
            out.append((base[d], sorted(base[d] + more)))
        return out

    def find(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: a row per row of ``docs``."""
        model = self.model

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tagger = PersonalData(model)
            told = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    rows = tagger.spans(part.column(1).to_pylist())
                    counts = [pa.array([sum(s[0] == k for s in b) for b, _ in rows], pa.int64()) for k in range(len(KINDS))]
                    digest = pa.array([hashlib.sha256(told(b).encode()).hexdigest() for b, _ in rows], pa.string())
                    yield pa.RecordBatch.from_arrays([part.column(0), *counts, digest, pa.array([told(a) for _, a in rows], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")

    def redact(self, docs: DataFrame) -> DataFrame:
        """The documents with each span replaced by its kind, as "[EMAIL]"; n_chars, if there, follows the text."""
        model, at = self.model, docs.columns.index("text")
        length = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tagger = PersonalData(model)
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    texts = part.column(at).to_pylist()
                    new = [redacted(t, a) if a else t for t, (_, a) in zip(texts, tagger.spans(texts), strict=True)]
                    columns = list(part.columns)
                    columns[at] = pa.array(new, part.column(at).type)
                    if length is not None:
                        old = part.column(length).to_pylist()
                        columns[length] = pa.array([n if a is b else len(b) for n, a, b in zip(old, texts, new, strict=True)], part.column(length).type)
                    yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

        return docs.mapInArrow(run, docs.schema)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with the union of overlapping spans replaced by the kind of the first of them."""
    out, last = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= last:
            out += [text[last:s], f"[{KINDS[k].upper()}]"]
        last = max(last, e)
    return "".join(out) + text[last:]
