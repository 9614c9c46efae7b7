import itertools
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kindred.llm import pii
from kindred.llm.bilstm_crf import BiLstmCrf

from .pii_sentences import CLEAN, SPANS

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 13 <= len(d) <= 19 and pii.luhn(d) or k == 3 and 9 <= len(d) <= 15:
                out.append((k, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "@", ".", "-", "+", " ", "1", "4111111111111111", "b.c", "10.0.0.7", "(743)", "5553824", "é", "_", "25", "\n"]), max_size=14).map("".join))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_long_runs_take_no_square_time():
    for c in ("a", "1", "1.", "+1 ", "1-", "a@", "."):
        pii.base_spans(c * 200_000)


def test_tagger_adds_irregular_spellings_and_leaves_numbers_alone():
    finder = pii.PersonalData()
    texts = ["the card 4111.1111.1111.1111 was used", "host 10[.]20[.]30[.]40 is down", "on 2024-01-31 at 12:30:45 version 2.0", None, "", "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" in text"]
    found = [[(pii.KINDS[k], t[s:e]) for k, s, e in a] if t else a for t, (_, a) in zip(texts, finder.spans(texts), strict=True)]
    assert found == [[("card", "4111.1111.1111.1111")], [("ip", "10[.]20[.]30[.]40")], [], [], [], []]


def test_held_out_spans():
    texts, tags = pii.spans_for_training(800, seed=1234)
    got, _ = pii.trained().decode(pii.coded(texts))
    assert (got == tags)[tags > 0].mean() > 0.85 and (got == tags)[got > 0].mean() > 0.85


def test_find_and_redact(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cc now", 15, "x"), (None, None, None, "y"), (2, "4111 1111 1111 1111", 19, "z")], "doc_id long, text string, n_chars long, spans string")
    out = {r.doc_id: r for r in pii.PersonalData().find(docs).collect()}
    assert (out[1].n_email, out[1].spans, out[2].n_card, out[None].spans) == (1, "email:5:11", 1, "")
    new = {r.doc_id: r for r in pii.PersonalData().redact(docs).collect()}
    assert (new[1].text, new[1].n_chars, new[1].spans) == ("mail [EMAIL] now", 16, "x") and new[2].text == "[CARD]" and new[None].text is None


def test_sentences_from_outside_the_generator():
    """Precision and recall of 0.9 for each kind, on spans that the patterns do not find and on clean sentences."""
    finder = pii.PersonalData()
    hit, found = dict.fromkeys(pii.KINDS, 0), dict.fromkeys(pii.KINDS, 0)
    for kind, rows in SPANS.items():
        for text, span in rows:
            base, own = finder.spans([text])[0]
            assert not any(pii.KINDS[k] == kind and (s, e) == (text.index(span), text.index(span) + len(span)) for k, s, e in base)
            hit[kind] += (pii.KINDS.index(kind), text.index(span), text.index(span) + len(span)) in own
            for k, *_ in own:
                found[pii.KINDS[k]] += 1
    for _, own in finder.spans(CLEAN):
        for k, *_ in own:
            found[pii.KINDS[k]] += 1
    assert all(hit[k] >= 0.9 * len(SPANS[k]) and hit[k] >= 0.9 * found[k] for k in pii.KINDS), (hit, found)


def test_windows_passed_over_change_nothing(monkeypatch):
    texts = [t for rows in SPANS.values() for t, _ in rows] + CLEAN
    texts += [" ".join(texts[i::7]) for i in range(7)]
    finder = pii.PersonalData()
    gated = finder.spans(texts)
    monkeypatch.setattr(pii, "_windows", lambda text, taken: list(range(0, max(1, len(text) - pii.HALF), pii.HALF)))
    assert finder.spans(texts) == gated


@pytest.fixture(scope="module")
def small():
    model = BiLstmCrf(5, 1, hidden=3, seed=1)
    rng = np.random.default_rng(2)
    for k in model.p:
        model.p[k] = rng.normal(0, 0.5, model.p[k].shape)
    return model, rng.integers(0, 5, (3, 5)), np.array([[0, 1, 2, 0, 1], [1, 2, 2, 0, 0], [0, 0, 0, 1, 2]])


def _score(model, emit, path):
    step = model.p["step"] + model.barred
    return emit[0][path[0]] + model.first_barred[path[0]] + sum(step[a, b] + emit[k + 1][b] for k, (a, b) in enumerate(itertools.pairwise(path)))


def _emissions(model, codes):
    """A plain loop over characters, one window and one direction at a time."""
    n, p, out = model.hidden, model.p, []
    sig = lambda x: 1 / (1 + np.exp(-x))
    for row in codes:
        sides = []
        for d, own in enumerate((row, row[::-1])):
            h, c, states = np.zeros(n), np.zeros(n), []
            for x in own:
                z = p["table"][d][x] + h @ p["loop"][d]
                i, f, o, g = sig(z[:n]), sig(z[n : 2 * n]), sig(z[2 * n : 3 * n]), np.tanh(z[3 * n :])
                c = f * c + i * g
                h = o * np.tanh(c)
                states.append(h @ p["out"][d])
            sides.append(states if d == 0 else states[::-1])
        out.append(np.array(sides[0]) + np.array(sides[1]) + p["bias"])
    return out


def test_decoding_is_the_best_of_all_paths(small):
    model, codes, _ = small
    got, _ = model.decode(codes)
    for emit, tags in zip(_emissions(model, codes), got, strict=True):
        best = max(itertools.product(range(3), repeat=5), key=lambda path: _score(model, emit, path))
        assert tuple(tags) == best


def test_gradients_are_those_of_differences(small):
    model, codes, tags = small
    loss, grad = model.gradients(codes, tags)
    want = 0.0
    for emit, path in zip(_emissions(model, codes), tags, strict=True):
        every = [_score(model, emit, p) for p in itertools.product(range(3), repeat=5)]
        want += (np.logaddexp.reduce(every) - _score(model, emit, tuple(path))) / len(tags)
    assert loss == pytest.approx(want, rel=1e-4)
    rng = np.random.default_rng(3)
    for name, value in model.p.items():
        for _ in range(4):
            at = tuple(int(rng.integers(n)) for n in value.shape)
            old, losses = value[at], []
            for move in (1e-2, -1e-2):
                value[at] = old + move
                losses.append(model.gradients(codes, tags)[0])
            value[at] = old
            assert grad[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-2, abs=2e-3)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 12), st.integers(1, 5), st.integers(1, 9)), max_size=6))
def test_reconciled_spans_have_the_largest_weight(rows):
    found = [(k, s, s + n, float(w)) for k, s, n, w in rows]
    out = pii.reconciled(found)
    assert all(a[2] <= b[1] for a, b in itertools.pairwise(out))
    joined = []
    for k in range(4):
        for s, e, w in sorted((s, e, w) for x, s, e, w in found if x == k):
            if joined and joined[-1][0] == k and s < joined[-1][2]:
                joined[-1] = (k, joined[-1][1], max(e, joined[-1][2]), max(w, joined[-1][3]))
            else:
                joined.append((k, s, e, w))
    best = 0.0
    for n in range(len(joined) + 1):
        for some in itertools.combinations(sorted(joined, key=lambda x: x[1]), n):
            if all(a[2] <= b[1] for a, b in itertools.pairwise(some)):
                best = max(best, sum(x[3] for x in some))
    weight = {x[:3]: x[3] for x in joined}
    assert sum(weight[x] for x in out) == best


def test_an_empty_table(spark):
    assert pii.PersonalData().find(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_very_many_spans_take_no_square_time():
    """100,000 addresses, a cue after each: windows and joined spans by bisection."""
    text = " ".join(f"u{i}@mail.org 12-34" for i in range(100_000))
    base = pii.base_spans(text)
    began = time.time()
    assert len(base) >= 100_000 and len(pii._windows(text, base)) > 1000
    found = [(i % 3, 10 * i, 10 * i + 12, 1.0) for i in range(100_000)]
    assert len(pii.reconciled(found)) >= 50_000
    assert time.time() - began < 20


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.just(0), st.integers(0, 40), st.integers(1, 9)), max_size=8), st.integers(0, 45), st.integers(1, 9))
def test_taken_stretches(spans, a, size):
    spans = [(k, s, s + n) for k, s, n in spans]
    assert pii.Taken(spans).meets(a, a + size) == any(s < a + size and a < e for _, s, e in spans)
