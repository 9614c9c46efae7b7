"""Small cases and brute-force versions of the other operators of the subpackage."""

import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from kindred.llm import bpe, html_text, packing, warc
from kindred.llm.pivot_search import PivotSearch
from kindred.llm.quality_gam import QualityClassifier
from kindred.llm.quality_rules import QualityRules
from kindred.llm.queries import tokenizer_path
from kindred.llm.toxicity import Toxicity

TEXTS = [None, "", " ", "Hello  world! It's 12 o'clock\n\n", "Élan vital — ça va? 日本語 😀", "<|endoftext|> x <|endoftext|>", "a" * 3000, "naïvé \x00 tab\there", "word " * 2500]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", "y")], "doc_id long, text string, ids string")


@pytest.fixture(scope="module")
def labelled(spark):
    """Marked texts: good ones are sentences, bad ones symbols; toxic ones hold an insult."""
    rng = np.random.default_rng(4)
    words = [f"{a}{b}{c}" for a in "bdglm" for b in ("ar", "el", "on", "ur") for c in ("ta", "ne", "so", "lik", "dum")]
    rows = []
    for i in range(400):
        body = [words[k] for k in rng.integers(0, len(words), 80)]
        toxic, good = int(i % 4 == 0), int(i % 3 != 0)
        if toxic:
            for _ in range(4):
                body[int(rng.integers(80))] = ("idiot", "moron", "scumbag")[int(rng.integers(3))]
        text = ". ".join(" ".join(body[k : k + 8]).capitalize() for k in range(0, 80, 8)) if good else " ### ".join(body[:70]) + " $$$ &&&"
        rows.append((i, text, good, toxic))
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    return frame.select("doc_id", "text").cache(), frame.select("doc_id", "quality", "toxic").cache()


def test_bpe_agrees_with_the_library(docs):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    out = {r.doc_id: r for r in bpe.digests(docs, path).collect()}
    for i, t in enumerate(TEXTS):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_packing_agrees_with_the_library_and_has_no_gaps(docs):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    rows = packing.Packer(path).packed(docs).collect()
    want = {}
    for i, t in enumerate([*TEXTS, "null id"]):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            want[(i if i < len(TEXTS) else None, k // 2048)] = (k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_trades_of_bins_with_very_many_documents():
    """Two-for-one trades are found in bins of hundreds of short documents."""
    lengths = [6] * 200 + [11, 5, 9]
    low, high = list(range(200)), [200, 201, 202]
    assert packing._trade(low, high, lengths, 1) == ([0, 1], [200]) or packing._trade(low, high, lengths, 1) == ([0], [201])
    brute = max((sum(lengths[i] for i in out) - lengths[j] for n in (1, 2) for out in [low[:n]] for j in high if sum(lengths[i] for i in out) - lengths[j] <= 3), default=0)
    out, back = packing._trade(low, high, lengths, 3)
    assert sum(lengths[i] for i in out) - sum(lengths[j] for j in back) == brute == 3


def test_rows_without_an_id_are_packed_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 100)
    docs = spark.range(1000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same words again").alias("text"))
    rows = packing.Packer(tokenizer_path("word_bpe_49k.json")).packed(docs).collect()
    assert len(rows) == 1000 and len({r.sequence_id >> 24 for r in rows}) > 5
    assert len({(r.sequence_id, r.offset) for r in rows}) == 1000


def test_local_search_beats_best_fit():
    rng = np.random.default_rng(1)
    lengths = rng.integers(500, 900, 400).tolist()
    first = packing.best_fit(lengths, 2048)
    better = packing.local_search([list(b) for b in first], lengths, 2048)
    assert sorted(i for b in better for i in b) == list(range(400)) and len(better) <= len(first)
    assert all(sum(lengths[i] for i in b) <= 2048 for b in better)


def test_warc_round_trip_and_broken_archives(spark, tmp_path):
    big = "é" * 600
    pages = spark.createDataFrame([(1, "http://a", big), (7, "http://b", big), (3, None, None), (4, "u", "small"), (5, "u", "small"), (None, "n", big)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/warc"
    assert sum(r.n_records for r in warc.write_archives(warc.planned(pages), folder).collect()) == 6
    out = {r.page_id: r for r in warc.read_archives(spark, folder).collect()}
    assert (out[1].record_type, out[1].refers_to, out[1].payload_bytes) == ("revisit", 7, 1200)
    assert bytes(out[7].payload).decode() == big and out[3].payload_bytes == 0 and out[5].record_type == "response" and out[None].record_type == "response"
    (tmp_path / "warc" / "part-999999-9-0000.warc.zst").write_bytes(b"left over by a failed attempt")
    long = spark.createDataFrame([(1, "http://" + "a" * 70_000, big), (1, "http://b", big), (2, "c", big)], "page_id long, url string, html string")
    archives = warc.written(warc.write_archives(warc.planned(long), folder), "archives")
    rows = warc.read_written(archives, folder).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to, len(r.url)) for r in rows) == [(1, "revisit", 2, 8), (1, "revisit", 2, 70_007), (2, "response", None, 1)]
    assert warc.read_written(archives.limit(0), folder).collect() == []
    again = warc.written(warc.write_archives(warc.planned(long), folder), "archives")
    names = [{r.archive for r in a.collect()} for a in (archives, again)]
    assert not names[0] & names[1]  # a later attempt replaces nothing
    assert len(warc.read_written(archives, folder).collect()) == 3
    assert warc.read_written(warc.written(warc.write_archives(warc.planned(long.limit(0)), folder), "archives"), folder).collect() == []
    record = warc.record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", "<x>"), ("WARC-Date", "2024-01-01T00:00:00Z")], b"body")
    assert warc.parsed(record)[1] == b"body"
    for broken in (record[:-1], record.replace(b"Content-Length: 4", b"Content-Length: 5"), record.replace(b"WARC-Date", b"WARC Date"), b"x"):
        with pytest.raises(warc.WarcError):
            warc.parsed(broken)
    writer = warc.Writer([record] * 20)
    writer.add(record)
    assert len(list(warc.records(writer.done()))) == 1
    with pytest.raises(warc.WarcError):
        list(warc.records(writer.done()[:-2]))


def test_search_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=12)]) for i in range(300)] + [(300, None), (301, [float("nan")] * 12), (302, [None] + [1.0] * 11)]
    rows += [(400 + i, rows[0][1]) for i in range(8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {(r.query_id, r.rank): (r.vec_id, r.score) for r in PivotSearch(pivots=6).search(vectors, F.col("vec_id") % 50 == 0).collect()}
    usable = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    want = {}
    for q in (i for i in usable if i % 50 == 0):
        scored = sorted(((-sum(a * b for a, b in zip(usable[q], v, strict=True)), i) for i, v in usable.items() if i != q))[:5]
        want |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(scored)}
    assert out == want
    assert PivotSearch().search(vectors.where("vec_id = 300"), F.lit(True)).collect() == []


def test_search_stops_where_bounds_fall_and_takes_repeated_ids(spark):
    """In clustered vectors few pairs are compared; results are those of all pairs, with repeated ids and ties."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 4
    rows = [(i, [float(x) for x in centres[i % 40] + 0.05 * rng.normal(size=16)]) for i in range(2000)]
    rows += [(7, rows[8][1]), (7, rows[9][1]), (50, rows[50][1]), (3000, rows[1][1]), (2999, rows[1][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    search = PivotSearch(pivots=48, first=64)
    out = [(r.query_id, r.rank, r.vec_id, r.score) for r in search.search(vectors, F.col("vec_id") % 50 == 0).collect()]
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    want = []
    for n, (q, v) in enumerate(whole):
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for m, (i, w) in enumerate(whole) if m != n)[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    assert sorted(out) == sorted(want)
    assert search.share < 0.2


def test_search_asks_every_query_row_and_takes_empty_vectors(spark):
    """Rows that share a vec_id are queries and candidates of their own; an empty vector is all zeros."""
    rows = [(50, [1.0, 2.0]), (50, [2.0, -1.0]), (50, [1.0, 2.0]), (100, []), (1, []), (2, [0.5]), (None, [9.0, 9.0]), (3, None)]
    vectors = spark.createDataFrame([(*r, 1, True) for r in rows], "vec_id long, embedding array<double>, row int, asked boolean")
    out = [(r.query_id, r.rank, r.vec_id, r.score) for r in PivotSearch(k=3).search(vectors, F.col("vec_id") % 50 == 0).collect()]
    whole = [(i, [int(256 * x) for x in v] + [0] * (2 - len(v))) for i, v in rows if i is not None and v is not None]
    want = []
    for n, (q, v) in enumerate(whole):
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for m, (i, w) in enumerate(whole) if m != n)[:3]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    assert sorted(out) == sorted(want)
    only = spark.createDataFrame([(50, []), (51, [])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in PivotSearch().search(only, F.col("vec_id") == 50).collect()] == [(50, 1, 51, 0)]
    assert PivotSearch().search(only.limit(0), F.lit(True)).collect() == []


ARTICLE = "<p>First, a paragraph of the article, which goes on.</p><p>Then, as it must, a second one, with commas.</p>"
ITS_TEXT = "First, a paragraph of the article, which goes on.\n\nThen, as it must, a second one, with commas."


@pytest.mark.parametrize(
    "attributes",
    ['data-title="The hidden valley"', 'title="hidden gem"', 'data-hidden="false"', "data-role=banner", 'data-id="sidebar"', 'data-style="display: none"', 'class="overflow-hidden"', 'class="layout has-sidebar"', 'class="sidebar"', 'class="no-ads text-register"'],
)
@pytest.mark.parametrize("tag", ["div", "section"])
def test_html_attributes_that_do_not_hide_the_article(tag, attributes):
    assert html_text.main_text(f"<body><{tag} {attributes}>{ARTICLE}</{tag}></body>") == ITS_TEXT
    assert html_text.main_text(f'<body><div class="ad">Buy now</div><div><{tag} {attributes}>{ARTICLE}</{tag}></div></body>') == ITS_TEXT


@pytest.mark.parametrize("attributes", ["hidden", "HIDDEN=''", 'class="x" hidden', 'aria-hidden="true"', "style='display:none'", "role=banner", 'class="ad"', 'class="site-footer"', "id=commentsArea", 'class="post-comments"'])
def test_html_attributes_that_name_what_is_no_article(attributes):
    assert html_text.main_text(f"<body><div>{ARTICLE}<div {attributes}><p>Buy this, now, here.</p></div></div></body>") == ITS_TEXT


def test_html_long_comments_do_not_outdo_the_article():
    assert html_text.main_text(f'<body><article>{ARTICLE}</article><div id="comments">{"<p>Well, I see, so it goes, they say.</p>" * 6}</div></body>') == ITS_TEXT


def test_html_keeps_the_article():
    page = """<html><head><title>t</title><script>var a = "</p>";</script></head><body><nav><a href=x>Home</a></nav><div class="ad">Buy now</div>
    <article><h1>Head</h1><p>First &amp; long,  paragraph<br>goes on, here.<p>Second <b>one</b>.</p></article><div id="comments"><p>Nice post, thanks, all of you, really.</p></div><footer>&copy; x</footer></body></html>"""
    assert html_text.main_text(page) == "Head\n\nFirst & long, paragraph goes on, here.\n\nSecond one."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<div></div>") == ""


def test_base_counts_of_quality_rules(spark):
    texts = ["a b c a b c a b c\nx\nx\n\n", None, "", "#a |b $c", "one two three four"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in QualityRules().score(docs).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (out[i].n_words, out[i].word_chars, out[i].n_symbols, out[i].n_dup_lines, out[i].n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert out[i].base_failed and not out[i].kept


def test_learners_on_held_out_rows(labelled):
    docs, labels = labelled
    for model, label, least in ((Toxicity(), "toxic", 0.9), (QualityClassifier(), "quality", 0.95)):
        out = {r.doc_id: r for r in model.fit(docs, labels).score(docs).collect()}
        marks = {r.doc_id: r[label] for r in labels.collect()}
        held = [i for i in marks if out[i].held_out]
        assert held and np.mean([out[i].predicted == marks[i] for i in held]) >= least
    texts = [r.text for r in docs.collect()]
    rules = QualityRules(least_words=5).fit(docs, labels)
    assert len(texts) > rules.filter(docs).count() > 0


def test_gam_scores_are_sums_of_its_tables():
    """Against a plain loop over features and pairs; a pure interaction is learnt by the pair tables."""
    from kindred.llm.quality_gam import Gam

    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 4))
    y = ((x[:, 0] > 0) != (x[:, 1] > 0)).astype(float)
    model = Gam(rounds=40, pairs=2).fit(x, y)
    assert {(a, b) for a, b, _ in model.pair_tables} >= {(0, 1)}
    got = model.probability(x)
    assert np.mean((got >= 0.5) == (y == 1)) > 0.9
    bin_of = lambda edges, v: sum(v >= e for e in edges)
    for row, p in zip(x[:50], got[:50], strict=True):
        score = model.bias + sum(t[bin_of(model.edges[f], row[f])] for f, t in enumerate(model.tables))
        score += sum(t[bin_of(model.coarse[a], row[a]), bin_of(model.coarse[b], row[b])] for a, b, t in model.pair_tables)
        assert p == pytest.approx(1 / (1 + np.exp(-score)))


def test_a_pair_tree_is_the_best_of_all_first_cuts():
    from kindred.llm.quality_gam import Gam

    rng = np.random.default_rng(7)
    shape = (5, 4)
    cells, g, h = rng.integers(0, 20, 200), rng.normal(size=200), rng.random(200)
    table, gain = Gam(cuts=1)._shallow_pair(cells, g, h, shape)
    value = lambda m: g[m].sum() ** 2 / (h[m].sum() + 4)
    place = np.stack(np.divmod(cells, 4))
    cuts = [(axis, k) for axis in (0, 1) for k in range(1, shape[axis])]
    gains = {c: value(place[c[0]] < c[1]) + value(place[c[0]] >= c[1]) - value(cells >= 0) for c in cuts}
    best = max(gains, key=gains.get)
    assert gain == pytest.approx(gains[best])
    side = place[best[0]] < best[1]
    assert table[tuple(place[:, side][:, 0])] == pytest.approx(-g[side].sum() / (h[side].sum() + 4))


def test_trees_are_monotonic():
    from kindred.llm import trees

    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 3))
    y = (x[:, 0] + 0.5 * np.sin(4 * x[:, 0]) + x[:, 1] + rng.normal(size=900) * 0.3 > 0).astype(float)
    forest = trees.fit(x, y, {0: 1})
    grid = np.repeat(rng.normal(size=(40, 3)), 60, 0)
    grid[:, 0] = np.tile(np.linspace(-3, 3, 60), 40)
    assert (np.diff(forest.raw(grid).reshape(40, 60), axis=1) >= -1e-12).all()


def test_the_subsequence_kernel_against_plain_loops():
    """Codes, weights and norms of words against three nested loops; margins against the kernel with each landmark."""
    from kindred.llm import toxicity as tx

    def features(word):
        out = Counter()
        for i, j, k in ((i, j, k) for i in range(len(word)) for j in range(i + 1, len(word)) for k in range(j + 1, len(word))):
            if k - i < tx.SPAN:
                out[word[i] + word[j] + word[k]] += tx.DECAY ** (k - i + 1)
        return out

    words = ["^idiot$", "^banana$", "^aaaa$", "^ok$", "^stupendous$", "^moron$"]
    kernel = lambda a, b: sum(v * b[t] for t, v in a.items())
    own = [features(w) for w in words]
    for part, codes, weight in tx.coded(words):
        for row, i in enumerate(part):
            sums = Counter()
            for c, w in zip(codes[row], weight, strict=True):
                sums[int(c)] += float(w)
            assert sorted(sums.values()) == pytest.approx(sorted(own[i].values()), rel=1e-5)
        assert tx.norms(codes, weight) == pytest.approx([kernel(own[i], own[i]) ** 0.5 for i in part], rel=1e-5)
    seen, base = tx.dense(words)
    gram = np.array([[kernel(a, b) / (kernel(a, a) * kernel(b, b)) ** 0.5 for b in own] for a in own])
    assert base @ base.T == pytest.approx(gram, abs=1e-5)
    machine = tx.Machine(landmarks=6)
    machine.fit(words, np.array([1, -1, -1, -1, -1, 1.0]), np.ones(6))
    value = dict(zip(machine.codes.tolist(), machine.values.tolist(), strict=True))
    code = lambda t: (int(tx._CODE[ord(t[0])]) * tx.WIDTH + int(tx._CODE[ord(t[1])])) * tx.WIDTH + int(tx._CODE[ord(t[2])])
    plain = [machine.bias + max(0.0, sum(v * value.get(code(t), 0.0) for t, v in f.items())) / kernel(f, f) ** 0.5 for f in own]
    assert machine.margins(words) == pytest.approx(plain, abs=1e-4)
    assert min(plain[0], plain[5]) > max(plain[1:5])


def test_flattened_trees_are_walked_as_plain_ones(labelled):
    """The verdict of quality rules against a walk node by node."""
    rules = QualityRules(least_words=5).fit(*labelled)
    from kindred.llm import docstats
    import pyarrow as pa

    texts = [r.text for r in labelled[0].orderBy("doc_id").limit(60).collect()]
    x, f = docstats.batches_of(pa.array(texts))[1], rules.forest
    for row, p in zip(x, f.probability(x), strict=True):
        score = f.bias
        for at in f.roots:
            while f.child[at] != at:
                at = f.child[at] + int(row[f.feature[at]] > f.threshold[at])
            score += f.value[at]
        assert p == pytest.approx(1 / (1 + np.exp(-score)))
    kept = {r.doc_id: r.kept for r in rules.score(labelled[0].orderBy("doc_id").limit(60)).collect()}
    base = docstats.batches_of(pa.array(texts))[0]
    assert list(kept.values()) == [bool(b[0] >= 5 and 100 * b[4] <= 50 * b[0] and p >= 0.5) for b, p in zip(base, f.probability(x), strict=True)]


@pytest.mark.parametrize("model", [Toxicity, QualityClassifier, QualityRules])
def test_models_on_hard_rows(spark, labelled, model):
    """Null, empty, very long and repeated texts, repeated and null ids, clashing names."""
    rows = [(1, None, 0.5, "x"), (2, "", 0.5, "x"), (None, "null id", 0.5, "x"), (3, "same text", 0.5, "x"), (3, "same text", 0.5, "x"), (4, "other text of this id", 0.1, "y"), (4, "same text", 0.1, "y"), (5, "word " * 400_000, 0.1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, label string")
    out = model().fit(*labelled).score(docs).collect()
    assert sorted(r.doc_id or 0 for r in out) == [0, 1, 2, 3, 3, 4, 4, 5]
    column = "probability" if model is QualityRules else "score"
    assert all(0 <= r[column] <= 1 for r in out)
    assert len({r[column] for r in out if r.doc_id in (1, 2)}) == 1 and len({r[column] for r in out if r.doc_id == 3}) == 1


def test_fitting_rows_are_bounded_by_rows(spark):
    from kindred.llm.common import labelled as bounded

    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(i, "t") for i in range(2, 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 30)], "doc_id long, quality int")
    assert bounded(docs, labels, "quality", None, 10).count() <= 10
    assert bounded(docs, labels, "quality", None, 100).count() == 29


def test_toxicity_tolerates_gaps_and_insertions(labelled):
    model = Toxicity().fit(*labelled)
    clean = labelled[0].where("doc_id = 1").first().text
    p = lambda word: model.probabilities([clean + f" {word} {word}x {word}"], {})[0]
    assert min(p("idiot"), p("i.d.i.o.t"), p("id*iot")) > p("lantern") and p("idiot") >= 0.7 > p("lantern")


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for model in (Toxicity(), QualityClassifier(), QualityRules()):
        assert model.fit(empty, none).score(empty).collect() == []
    assert packing.Packer(tokenizer_path("word_bpe_49k.json")).packed(empty).collect() == []
    assert bpe.digests(empty, tokenizer_path("byte_bpe_50k.json")).collect() == []
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.planned(pages).collect() == []
    assert html_text.extracted(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_pipeline_against_its_parts(spark):
    """Each stage's result follows from its input by a plain version of what it decides."""
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in p.STAGES[:-1]:
        seen.append(p.written(stage(spark, seen[-1], sf), name))
        assert seen[-1].columns == columns
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] == ids[4]
    from .test_near_dedup import brute

    rows = sorted((r.doc_id, r.text) for r in seen[2].collect())
    roots, _ = brute([t for _, t in rows], 80)
    assert ids[3] == {rows[r][0] for r in set(roots)}
    packed = p.STAGES[-1][1](spark, seen[4], sf).collect()
    assert {r.doc_id for r in packed} == ids[4]
    assert {(r.doc_id, r.piece) for r in __spark_entry__.queries()["pipeline"](spark, sf).collect()} == {(r.doc_id, r.piece) for r in packed}
