"""Toxicity by a gap-weighted subsequence string kernel, Nyström landmarks and a linear SVM.

A text is toxic through expressions in it, so the instances are its words: runs without white space, lower case,
letters only, look-alike digits read as letters, with a mark at either end; three or more single characters
in a row are read together as one word ("i d i o t"). Two words are compared by the subsequences of three
letters that they share, each weighted by ``DECAY`` to the length it spans (at most ``SPAN`` letters), so
inserted letters weaken a match and do not end it.

Training sees labelled texts, not labelled words: words of toxic texts are positive if pieces of words that
they hold are surely more frequent in toxic texts than in clean ones, and if the word itself is not known to
be harmless (multiple-instance learning); words of clean texts are negative, the hardest ones found in turn.
Positives also come with inserted letters, and so do negatives. The kernel against the landmarks, whitened
(Nyström), feeds a squared-hinge SVM solved by Newton steps. As the map is linear in the subsequences, the fitted
machine folds into one weight for each three letters; a word's margin gathers those weights. A text's score
is a logistic function of its largest margin and of the share of its words that have positive margins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, labelled

DECAY, SPAN, LONGEST, CACHE = 0.7, 8, 24, 400_000
#: Characters that stand for letters inside a word, and letters told apart beside a-z.
LOOKALIKE = str.maketrans("@$!0134578", "asioieastb")
ACCENTED = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœß"
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_SPELT = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")
_TRIPLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Codes of letters: a-z, the marks at the ends, the accented ones, and one for all others.
WIDTH = 29 + len(ACCENTED)
_CODE = np.full(0x180, WIDTH - 1, np.int32)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz^$" + ACCENTED):
    _CODE[ord(_c)] = _i


def folded(word: str) -> str:
    """Letters of a word, those without a code of their own as '{'; other characters go."""
    word = word.strip(_EDGE)
    if word.isalpha() and word.isascii():
        return word
    if not any(map(str.isalpha, word)):
        return ""
    return "".join(c if c in ACCENTED or "a" <= c <= "z" else "{" for c in word.translate(LOOKALIKE) if c.isalpha())


def units(text: str) -> set[str]:
    """The distinct words of a text, as they stand, and its spelt-out ones."""
    text = text.lower()
    found = set(text.split())
    for m in _SPELT.finditer(text):
        found.add("".join(m[0].split()))
    return found


def pieces(word: str) -> list[str]:
    """The folded word between its marks; if long, overlapping parts of it."""
    word = folded(word)
    if len(word) < 2:
        return [""]
    word = f"^{word}$"
    if len(word) <= LONGEST:
        return [word]
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _TRIPLES:
        at = [(i, j, k) for i in range(n) for j in range(i + 1, min(n, i + SPAN)) for k in range(j + 1, min(n, i + SPAN))]
        at = np.array(at, int).reshape(-1, 3)
        _TRIPLES[n] = at, (DECAY ** (at[:, 2] - at[:, 0] + 1)).astype(np.float32)
    return _TRIPLES[n]


def coded(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For words of one length at a time: their places, subsequence codes (words x triples) and weights."""
    length = np.fromiter(map(len, words), int, len(words))
    for n in np.unique(length):
        if n < 3:
            continue
        at, weight = _triples(int(n))
        own = np.flatnonzero(length == n)
        for part in np.array_split(own, len(own) * len(at) // 400_000 + 1):
            c = _CODE[np.frombuffer("".join(words[i] for i in part).encode("utf-32-le"), np.uint32)].reshape(-1, n)
            yield part, (c[:, at[:, 0]] * WIDTH + c[:, at[:, 1]]) * WIDTH + c[:, at[:, 2]], weight


def norms(codes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Square root of the kernel of each word with itself."""
    order = np.argsort(codes, 1)
    codes, w = np.take_along_axis(codes, order, 1), weight[order]
    flat = codes.astype(np.int64) + np.arange(len(codes))[:, None] * WIDTH**3
    start = np.flatnonzero(np.diff(flat.ravel(), prepend=-1))
    sums = np.add.reduceat(w.ravel(), start) ** 2
    return np.sqrt(np.bincount(start // codes.shape[1], sums, len(codes)))


def dense(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The codes that a few words hold, sorted, and their unit feature vectors over these (words x codes)."""
    seen = np.unique(np.concatenate([np.zeros(0, np.int32), *(c.ravel() for _, c, _ in coded(words))]))
    out = np.zeros((len(words), len(seen)), np.float32)
    for part, codes, weight in coded(words):
        np.add.at(out, (part[:, None], np.searchsorted(seen, codes)), weight)
    return seen, out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class Machine:
    """Fitted on words; ``margin`` of a word is bias plus its weighted subsequences over its norm."""

    def __init__(self, landmarks: int = 320, penalty: float = 3e-6, seed: int = 7):
        self.landmarks, self.penalty, self.seed = landmarks, penalty, seed
        self.codes, self.values, self.bias = np.zeros(0, np.int32), np.zeros(0, np.float32), -1.0

    def fit(self, words: list[str], y: np.ndarray, cost: np.ndarray) -> None:
        rng = np.random.default_rng(self.seed)
        pos, neg = ([w for w, v in zip(words, y, strict=True) if (v > 0) == side] for side in (True, False))
        by_word: dict[str, list[tuple[float, float]]] = {}
        for w, v, c in zip(words, y, cost, strict=True):
            by_word.setdefault(w, []).append((v, c))
        pick = lambda xs, n: [xs[i] for i in sorted(rng.permutation(len(xs))[:n])]
        weightiest = sorted(set(pos), key=lambda w: (-max(c for v, c in by_word[w]), w))[: self.landmarks // 2]
        marks = list(dict.fromkeys(weightiest + pick(sorted(set(neg)), self.landmarks // 2)))
        seen, base = dense(marks)
        values, vectors = np.linalg.eigh((base @ base.T).astype(float))
        keep = values > 1e-3 * values.max()
        white = vectors[:, keep] / np.sqrt(values[keep])  # the Nyström map is k(word, landmarks) @ white
        z = np.zeros((len(words), keep.sum() + 1))
        z[:, -1] = 1
        across = np.concatenate([base.T, np.zeros((1, len(base)), np.float32)])
        place = np.full(WIDTH**3, len(seen), np.int32)
        place[seen] = np.arange(len(seen))
        for part, codes, weight in coded(words):
            kernel = np.stack([weight @ across[c] for c in place[codes]]) / norms(codes, weight)[:, None]
            z[part, :-1] = kernel @ white
        ridge = np.eye(z.shape[1]) * self.penalty * cost.sum()
        ridge[-1, -1] *= 1e-3
        loss = lambda w: 0.5 * w @ ridge @ w + 0.5 * (cost * np.maximum(1 - y * (z @ w), 0) ** 2).sum()
        w = np.zeros(z.shape[1])
        for _ in range(40):
            slack = 1 - y * (z @ w)
            on = slack > 0
            zc = z[on] * cost[on, None]
            step = np.linalg.solve(ridge + zc.T @ z[on], ridge @ w - zc.T @ (y[on] * slack[on]))
            now, size = loss(w), 1.0
            while size > 1e-4 and loss(w - size * step) > now:
                size /= 2
            w -= size * step
            if np.abs(size * step).max() < 1e-6:
                break
        self.codes, self.values, self.bias = seen, (base.T @ (white @ w[:-1])).astype(np.float32), float(w[-1])

    def margins(self, words: list[str]) -> np.ndarray:
        """Margin of each word, at least the bias (that of a word without a subsequence)."""
        alpha = np.zeros(WIDTH**3, np.float32)
        alpha[self.codes] = self.values
        out = np.full(len(words), self.bias)
        for part, codes, weight in coded(words):
            total = alpha[codes] @ weight
            up = np.flatnonzero(total > 0)
            if len(up):
                out[part[up]] += total[up] / norms(codes[up], weight)
        return out


def _with_insertions(words: list[str], rng: np.random.Generator) -> list[str]:
    out = []
    for w in words:
        for _ in range(int(rng.integers(1, 3))):
            at = int(rng.integers(2, max(3, len(w) - 1)))
            w = w[:at] + chr(97 + int(rng.integers(26))) + w[at:]
        out.append(w[:LONGEST])
    return out


def _grams(word: str) -> set[str]:
    return {word[i : i + n] for n in (4, 5, 6) for i in range(max(1, len(word) - n + 1))}


def witnesses(toxic: Counter, clean: Counter, sure: float = 2.0, least: int = 5) -> set[str]:
    """Words that make texts toxic, by how many toxic and clean texts hold them and their pieces.

    A piece tells if its rate in toxic texts over that in clean ones, less one and a half standard errors, is above
    exp(``sure``). A word with such a piece counts unless clean texts hold it itself about as often.
    """
    n1, n0 = sum(toxic.values()) + 1, sum(clean.values()) + 1
    g1: Counter = Counter()
    g0: Counter = Counter()
    for w, n in toxic.items():
        for g in _grams(w):
            g1[g] += n
    for w, n in clean.items():
        for g in _grams(w):
            if g in g1:
                g0[g] += n
    odds = lambda a, b, errors: np.log((a + 0.3) / n1 * n0 / (b + 0.3)) - errors * np.sqrt(1 / (a + 0.3) + 1 / (b + 1))
    telling = {g for g, a in g1.items() if a > 1 and odds(a, g0[g], 1.5) > sure}
    return {w for w, a in toxic.items() if len(w) >= least and not telling.isdisjoint(_grams(w)) and (clean[w] < 2 or odds(a, clean[w], 0) > sure)}


class Toxicity:
    """``fit`` on at most ``most`` labelled rows outside the held-out fold, then ``score`` any texts.

    Null, empty and blank texts score as a text without any toxic subsequence. With labels of one kind only,
    every score is 0 (or 1 if all were toxic). Repeated rows score alike; very long texts are read whole; other columns,
    whatever their names, are ignored; an empty table gives an empty result.

    The parameters bound what the machine is trained on, not what it scores: ``least_letters`` of a word that may be an
    instance (with its two marks), ``landmarks`` of the Nyström map, ``hard`` negatives nearest to the positives by
    common pieces, ``easy`` ones by chance, ``harder`` ones by the margin of the first turn, ``changed`` easy ones with
    inserted letters, and about ``grown`` positives with inserted letters.
    """

    def __init__(self, cut: float = 0.7, folds: int = 3, held: int = 1, most: int = 3000, landmarks: int = 320, least_letters: int = 5, hard: int = 2500, easy: int = 6000, harder: int = 1500, changed: int = 2000, grown: int = 300):
        self.cut, self.folds, self.held, self.most = cut, folds, held, most
        self.least_letters, self.hard, self.easy, self.harder, self.changed, self.grown = least_letters, hard, easy, harder, changed, grown
        self.machine, self.curve = Machine(landmarks), (0.0, 0.0, -40.0)

    def fit(self, docs: DataFrame, labels: DataFrame) -> Toxicity:
        train = crc_fold("doc_id", self.folds) != self.held
        rows = labelled(docs, labels, "toxic", train, self.most)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bags = [sorted({p for u in units(t) for p in pieces(u)}) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([" ".join(b) for b in bags])], names=["doc_id", "y", "bag"])

        found = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "y").mapInArrow(run, "doc_id long, y int, bag string").toPandas().sort_values(["doc_id", "bag"])
        return self.fit_bags([b.split() for b in found["bag"]], found["y"].to_numpy())

    def fit_bags(self, bags: list[list[str]], y: np.ndarray) -> Toxicity:
        """``bags`` has the distinct pieces of each text."""
        if len(set(y.tolist())) < 2:
            self.curve = (0.0, 0.0, 40.0 if len(y) and y[0] else -40.0)
            return self
        rng = np.random.default_rng(11)
        toxic, clean = (Counter(w for b, v in zip(bags, y, strict=True) if v == side for w in b) for side in (1, 0))
        known = witnesses(toxic, clean, least=self.least_letters)
        pos = sorted(known)
        if pos:
            neg_all = sorted(w for w in clean if len(w) >= self.least_letters and w not in known)
            stems = {g for w in pos for g in _grams(w)}
            near = np.array([len(stems & _grams(w)) / (len(w) + 1) for w in neg_all])
            hard = {neg_all[i] for i in np.argsort(-near, kind="stable")[: self.hard]}
            easy = [neg_all[i] for i in rng.permutation(len(neg_all))[: self.easy]]
            for turn in range(2):
                more = _with_insertions(pos * (1 + self.grown // len(pos)), rng)
                neg = sorted({*hard, *easy})
                words = pos + more + neg + _with_insertions(easy[: self.changed], rng)
                sign = np.where(np.arange(len(words)) < len(pos) + len(more), 1.0, -1.0)
                cost = np.ones(len(words))
                cost[: len(pos)] = [min(toxic[w], 20) for w in pos]
                cost[len(pos) : len(pos) + len(more)] = 0.6
                cost[sign > 0] *= 0.25 * (sign < 0).sum() / cost[sign > 0].sum()
                self.machine.fit(words, sign, cost)
                if turn == 0:
                    hard |= {neg_all[i] for i in np.argsort(-self.machine.margins(neg_all), kind="stable")[: self.harder]}
        # logistic curve on the training texts, targets drawn in as Platt does; toxic texts whose label no word explains teach nothing here
        use = [v <= 0 or not known.isdisjoint(b) for b, v in zip(bags, y, strict=True)] if pos else [True] * len(bags)
        bags, y = [b for b, u in zip(bags, use, strict=True) if u], y[np.array(use)]
        every = sorted({w for b in bags for w in b})
        margin = dict(zip(every, self.machine.margins(every).tolist(), strict=True))
        x = np.stack([self._features(np.array([margin[w] for w in b])) for b in bags])
        n1, n0 = int((y > 0).sum()), int((y <= 0).sum())
        target, ab = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2)), np.zeros(3)
        centre = np.append(x[:, :2].mean(0), 0.0)
        z = x - centre
        loss = lambda v: np.logaddexp(0, z @ v).sum() - target @ (z @ v) + 5e-3 * v @ v
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(z @ ab, -40, 40)))
            h = (z * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ z + 1e-2 * np.eye(3)
            step, size = np.linalg.solve(h, z.T @ (p - target) + 1e-2 * ab), 1.0
            while size > 1e-6 and loss(ab - size * step) > loss(ab):
                size /= 2
            ab = ab - size * step
            if np.abs(size * step).max() < 1e-6:
                break
        ab[2] -= centre @ ab
        self.curve = (float(ab[0]), float(ab[1]), float(ab[2]))
        return self

    def _features(self, margins: np.ndarray) -> np.ndarray:
        """Largest margin, logarithm of the share of words like the witnesses, 1."""
        likely = 1 / (1 + np.exp(-np.clip(8 * (margins - 0.4), -40, 40)))
        likely[likely < 0.05] = 0
        return np.array([max(margins.max(initial=self.machine.bias), -1.5), np.log((likely.sum() + 0.1) / (len(margins) + 20)), 1.0])

    def probabilities(self, texts: list[str | None], cache: dict[str, float]) -> np.ndarray:
        bags = [units(t) if t else () for t in texts]
        fresh = {u for b in bags for u in b if u not in cache}
        if fresh:
            if len(cache) + len(fresh) > CACHE:
                cache.clear()
                fresh = {u for b in bags for u in b}
            own = sorted(fresh)
            parts = [pieces(u) for u in own]
            first = np.cumsum([0] + [len(p) for p in parts])
            margin = np.maximum.reduceat(self.machine.margins([p for ps in parts for p in ps]), first[:-1])
            cache.update(zip(own, margin.tolist(), strict=True))
        x = np.stack([self._features(np.fromiter(map(cache.__getitem__, b), float, len(b))) for b in bags])
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.curve), -40, 40)))

    def scorer(self):
        """Probabilities of an Arrow column of texts, a few at a time, with one cache of words' margins."""
        cache: dict[str, float] = {}

        def run(texts: pa.Array) -> np.ndarray:
            parts = [self.probabilities(texts[i : i + 64].to_pylist(), cache) for i in range(0, len(texts), 64)]
            return np.concatenate(parts) if parts else np.zeros(0)

        return run

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, held_out, score, predicted: a row per row of ``docs``; a null doc_id is not held out."""
        cut, model = self.cut, self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = model.scorer()
            for batch in batches:
                p = scorer(batch.column(2))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_fold("doc_id", self.folds) == self.held).alias("held_out"), F.col("text").cast("string").alias("text"))
        return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")

    def filter(self, docs: DataFrame) -> DataFrame:
        """The documents that are not predicted toxic, with all their columns."""
        at, cut, model = docs.columns.index("text"), self.cut, self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = model.scorer()
            for batch in batches:
                yield batch.filter(pa.array(scorer(batch.column(at)) < cut))

        return docs.mapInArrow(run, docs.schema)
