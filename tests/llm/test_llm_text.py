from __future__ import annotations

import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from quillgrid.llm import decontaminate, lm, pages, pieces, quality

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def samples() -> list[str]:
    draw = random.Random(4)
    alphabet = ["the ", " of", "ing", "é", "ß", "  ", "   ", "\n", "\t", "日本", "😀", "don't", "123", "▁", " ", "aaaa", "ABC", "tion", ".", ", "]
    return ["", " ", "  a", "a  ", "\n\n", "Hello world"] + ["".join(draw.choice(alphabet) for _ in range(draw.randint(1, 40))) for _ in range(400)]


def test_bpe_pieces_are_the_librarys():
    with open(pieces.MODEL, "rb") as f:
        proto = f.read()
    own, texts = pieces.Pieces(proto), samples()
    ids, offsets = own.encode(pa.array(texts))
    want = sentencepiece.SentencePieceProcessor(model_proto=proto).encode(texts)
    got = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
    assert got == want, [(t, g, w) for t, g, w in zip(texts, got, want) if g != w][:3]
    back, at = own.decode(ids, offsets)
    for t, a, b in zip(texts, at, at[1:]):
        assert back[a:b].tobytes().decode() == t.replace("▁", " ")


def test_unigram_pieces_have_the_librarys_score():
    model = pb.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = pieces.UNIGRAM
    for k, p in enumerate(model.pieces):
        if p.type == pieces.NORMAL:
            p.score = -5.0 - (k % 977) / 100
    proto = model.SerializeToString()
    own, library = pieces.Pieces(proto), sentencepiece.SentencePieceProcessor(model_proto=proto)
    texts = [t for t in samples() if "日" not in t and "😀" not in t]
    ids, offsets = own.encode(pa.array(texts))
    for t, w, a, b in zip(texts, library.encode(texts), offsets, offsets[1:]):
        worth = lambda x: sum(model.pieces[i].score for i in x)
        assert ids[a:b].tolist() == w or math.isclose(worth(ids[a:b].tolist()), worth(w), abs_tol=1e-3), t


def test_pieces_edges(spark, docs, no_docs, odd_docs):
    assert pieces.encoded(no_docs).count() == 0
    got = pieces.encoded(docs, carry=["doc_id", "text"])
    assert got.where("not round_trip").count() == 0
    back = pieces.decoded(got).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert pieces.encoded(odd_docs, carry=["fp", "kept"]).columns == ["fp", "kept", "ids", "n_pieces", "round_trip"]


def test_quality_ranks_held_out(spark):
    draw = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 8))) for _ in range(draw.randint(20, 120))]
        bad = i % 4 == 0
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in words), "x"))
        labels.append((i, 0 if bad else 1))
    docs = spark.createDataFrame([*rows, (None, None, "x"), (401, "", "x")], "doc_id long, text string, score string")
    got = quality.predicted(docs, spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, quality int")).collect()
    assert len(got) == 402
    held = [r for r in got if r.held_out and r.doc_id is not None]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert all(r.predicted == (0 if r.doc_id % 4 == 0 else 1) for r in held if r.doc_id < 400)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    untrained = quality.predicted(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {r.predicted for r in untrained} == {1}
    assert quality.predicted(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0


def test_decontamination_tolerates_substitutions(spark):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    items = [[word() for _ in range(n)] for n in (13, 15, 40, 59, 8, 3)]
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(98, None), (99, "")], "item_id long, text string")
    rows, want = [(-1, None), (-2, "")], {}
    for k, x in enumerate(items):
        for changed in range(0, 9):
            own = list(x)
            for p in draw.sample(range(len(own)), min(changed, len(own))):
                own[p] = word()
            rows.append((len(rows), " ".join([word() for _ in range(30)] + own + [word() for _ in range(30)])))
            same = np.array([a == b for a, b in zip(x, own)])
            if len(x) < 13:
                want[rows[-1][0]] = len(x) >= 4 and bool(same.all())
            else:
                want[rows[-1][0]] = any(same[a:b].mean() >= 0.8 for a in range(len(x)) for b in range(a + 13, len(x) + 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("overlaps", pytest.importorskip("pyspark.sql.functions").lit("clash"))
    got = {r.doc_id: r.contaminated for r in decontaminate.judged(docs, bench).collect()}
    assert {k: v for k, v in got.items() if k >= 0} == want and not got[-1] and not got[-2]
    blocks = {r.doc_id: len(r.overlaps) > 0 for r in decontaminate.overlapping(docs, bench, block=20).collect()}
    assert blocks == got
    assert decontaminate.judged(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.judged(docs.limit(0), bench).count() == 0


def test_decontamination_finds_clustered_substitutions(spark):
    items = [[f"w{n}x{p}" for p in range(n)] for n in range(20, 26)]
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    rows, want = [], {}
    for x in items:
        for width in range(3, 8):
            for first in range(len(x) - width + 1):
                own = [f"new{p}" if first <= p < first + width else w for p, w in enumerate(x)]
                same = np.array([a == b for a, b in zip(x, own)])
                rows.append((len(rows), " ".join(["before"] * 9 + own + ["after"] * 9)))
                want[rows[-1][0]] = any(5 * same[a:b].sum() >= 4 * (b - a) for a in range(len(x)) for b in range(a + 13, len(x) + 1))
    got = {r.doc_id: r.contaminated for r in decontaminate.judged(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == want and len(set(want.values())) == 2


def test_decontamination_masks_hit_all_short_stretches():
    for n in range(13, 26):
        for gone in itertools.combinations(range(n), n // 5):
            x = (1 << n) - 1 - sum(1 << p for p in gone)
            assert x & x >> 1 & x >> 2 & x >> 3 or x & x >> 1 & x >> 2 & x >> 4 & x >> 5 & x >> 6, (n, gone)


def test_language_model_is_brute_force(spark, docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + [(None, "null id here")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    own = [[w.decode() for w in WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))] + [None] for _, t in rows]
    train = [i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    uni: dict = {}
    pairs: dict = {}
    for t, w in zip(train, own):
        for a, b in zip(["<s>", *w], w):
            if t:
                uni[b] = uni.get(b, 0) + 1
                pairs.setdefault(a, {}).setdefault(b, 0)
                pairs[a][b] += 1
    n, v = sum(uni.values()), len(uni)
    for pack, share in ((6 << 20, 1 / 256), (3000, 1 / 256), (3000, 0.02)):
        got = {r.doc_id: r for r in lm.scored(frame, pack_bytes=pack, share=share).collect()}
        for (i, _), w, t in zip(rows, own, train):
            r = got[i]
            base = sum(math.log10((uni.get(x, 0) + 1) / (n + v + 1)) for x in w)
            score = 0.0
            for a, b in zip(["<s>", *w], w):
                low, succ = (uni.get(b, 0) + 1) / (n + v + 1), pairs.get(a, {})
                total = sum(succ.values())
                score += math.log10(max(succ.get(b, 0) - lm.DISCOUNT, 0) / total + lm.DISCOUNT * len(succ) / total * low if total else low)
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not t, len(w), sum(x in uni for x in w), n)
            assert math.isclose(r.base_score, base, rel_tol=1e-9)
            assert math.isclose(r.score, score, rel_tol=0.02, abs_tol=0.3), (i, r.score, score, pack, share)
    assert lm.scored(no_docs).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T{k}</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="x"><nav><ul><li><a href="/a{k}">menu {k}</a></li></ul>{nav}
<header>Site header</header><div class="cookie-notice">We use cookies</div><{tag}><h1>Head {k} &amp; more</h1><p><b>First {k}<br>line   two {k}</b><p>Second {k} &eacute; <i>in{k}</i>line {k}</p><form><input value="q"><button>Go</button></form>
<aside>aside {k}</aside></{tag}><section id="comments"><p>nice {k}</p></section><div class="ad">buy {k}</div><footer>&copy; host {k}</footer></body></html>"""


def test_pages_keep_the_article(spark):
    rows = [(k, f"http://h{k % 2}.example/{k}", PAGE.format(k=k, tag="article" if k % 2 else "div", nav="" if k % 4 == 1 else "</nav>")) for k in range(12)]
    rows += [(90, None, None), (91, "http://h1.example/x", ""), (92, "not a url", "<p>plain &lt;b&gt; text"), (93, "http://lone.example", "<body><div><p>only  one</p></div></body>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in pages.main_text(frame).collect()}
    for k in range(12):
        assert got[k].text == f"Head {k} & more First {k} line two {k} Second {k} é in{k}line {k}", got[k].text
    assert got[90].text == "" and got[91].n_chars == 0 and got[92].text == "plain <b> text" and got[93].text == "only one"
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert pages.main_text(frame.limit(0)).count() == 0


def page_texts(spark, bodies: list[str]) -> list[str]:
    rows = [(k, f"http://one.example/{k}", b and f"<html><body>{b}</body></html>") for k, b in enumerate(bodies)]
    return [r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).orderBy("page_id").collect()]


def test_pages_use_the_deduced_slot_before_tags(spark):
    body = "<p>Site line</p><article>card {k}</article><div class='story'><div class='inner'><p>" + "word " * 30 + "number {k}</p></div></div>"
    want = " ".join(["word"] * 30)
    assert page_texts(spark, [body.format(k=k) for k in range(6)]) == [f"{want} number {k}" for k in range(6)]


def test_pages_nest_two_layouts_past_odd_pages(spark):
    story = "word " * 30
    one = "<p>Site line</p><div class='story'><div class='inner'><p>" + story + "one {k}</p></div></div>"
    two = "<p>Site line</p><div class='report'><div class='chapter'><p>" + story + "two {k}</p></div></div>"
    bodies = [(one if k % 2 else two).format(k=k) for k in range(12)] + [None, "", "<b>error</b>"]
    got = page_texts(spark, bodies)
    assert got == [f"{story}{'one' if k % 2 else 'two'} {k}" for k in range(12)] + ["", "", "error"]


def test_pages_keep_text_that_all_share(spark):
    for tag in ("article", "main", "div"):
        for n in (7, 8, 12):
            body = f"<{tag} class='story'><h1>Shared head</h1><p>Licence sentence of all</p><p>own {{k}} " + "word " * 5 + f"</p></{tag}>"
            own = " ".join(["word"] * 5)
            assert page_texts(spark, [body.format(k=k) for k in range(n)]) == [f"Shared head Licence sentence of all own {k} {own}" for k in range(n)], (tag, n)
    assert page_texts(spark, ["<p>Same text of all copies</p><p>and more</p>"] * 9) == ["Same text of all copies and more"] * 9


def test_decontamination_with_a_hot_seed_stays_small():
    """Hundreds of items and a long text share one run of five words: 65 million pairs of seeds, at most 2 ** 18 in hand."""
    import resource

    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    hot = "one run of five words"
    own = decontaminate.Block(list(range(200)), [" ".join([word(), word(), hot, word(), word(), *(word() for _ in range(8))]) for _ in range(200)])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert own.overlaps(pa.array([" ".join(f"{hot} x{k} y{k} z{k}" for k in range(20_000))]), 13, 0.8) == [[]]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000


def auc(score: np.ndarray, label: np.ndarray) -> float:
    place = np.argsort(np.argsort(score))
    good, bad = (label == 1).sum(), (label == 0).sum()
    return (place[label == 1].sum() - good * (good - 1) / 2) / (good * bad)


def test_quality_by_words_where_ratios_do_not_tell():
    """Good and bad documents differ in a tenth of their words alone, which are made of the same letters."""
    draw = random.Random(21)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    common, topic = [word() for _ in range(300)], [[word() for _ in range(12)] for _ in range(2)]
    label = np.array([draw.randrange(2) for _ in range(1200)])
    texts = [" ".join(draw.choice(topic[y]) if draw.random() < 0.1 else draw.choice(common) for _ in range(80)) for y in label]
    x = quality.features(pa.array(texts))
    full = quality.bradley_terry(x[:800], label[:800]).strength(x[800:])
    plain = x.copy()
    plain[:, quality.SURFACE :] = 0
    ratios = quality.bradley_terry(plain[:800], label[:800]).strength(plain[800:])
    assert auc(full, label[800:]) > 0.93 and auc(ratios, label[800:]) < 0.65


def test_quality_features_are_of_each_text_alone():
    texts = [None, "", "a", "ab cd", "words  of\na text, of words", "x" * 300, "Ünï códe !! 123"]
    together = quality.features(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert np.allclose(together[k], quality.features(pa.array([t], pa.string()))[0], atol=1e-6), t


def test_quality_of_ties_and_repeated_rows(spark):
    rows = [(i, "Some plain words of a text" if i % 2 else "SHOUTING!!! $$$ @@@") for i in range(60)] + [(3, "Some plain words of a text")] * 3
    labels = [(i, i % 2) for i in range(60)] + [(5, 0), (7, 1), (7, 1)]
    got = quality.predicted(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == 63 and len({r.score for r in got}) == 2 and all(r.predicted == r.doc_id % 2 for r in got)


def test_quality_weighs_every_pair():
    """The weights are where the gradient over all pairs, listed, is zero; the threshold is numpy's quantile of all strengths."""
    draw = np.random.default_rng(4)
    x = draw.normal(size=(1100, quality.N_FEATURES)).astype(np.float32)
    label = (x[:, 0] + x[:, 1] + draw.normal(size=1100) > 0).astype(int)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    got = quality.bradley_terry(x, label)
    z = (x - x.mean(0, dtype=float)) / x.std(0, dtype=float)
    s = z @ got.weight
    p = 1 / (1 + np.exp(s[bad][None, :] - s[good][:, None]))
    pull = z[good].T @ (1 - p).sum(1) - z[bad].T @ (1 - p).sum(0)
    penalty = np.where(np.arange(x.shape[1]) < quality.SURFACE, 1.0, 100.0)
    assert len(good) * len(bad) > 200_000
    assert np.abs(pull * 100_000 / (len(good) * len(bad)) - penalty * got.weight).max() < 0.01
    assert np.isclose(got.threshold, np.quantile(got.strength(x), len(bad) / len(label)), rtol=1e-12, atol=1e-12)


def test_quality_learns_from_every_labelled_row(spark):
    draw = random.Random(9)
    rows = [(i, " ".join(draw.choice(("a", "Bc", "d!", "$", "ef.", "7")) for _ in range(draw.randint(0, 4)))) for i in range(28_000)]
    labels = [(i, int(draw.random() < (0.2 if "$" in t else 0.7))) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    use = np.array([zlib.crc32(str(i).encode()) % 4 != 2 for i, _ in rows])
    x, label = quality.features(pa.array([t for _, t in rows]))[use], np.array([y for _, y in labels])[use]
    assert len(x) > 20_000
    want, got = quality.bradley_terry(x, label), quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert np.allclose(got.mean, x.mean(0, dtype=float), atol=1e-9) and np.allclose(got.weight, want.weight, atol=1e-5)
    assert np.isclose(got.threshold, np.quantile(got.strength(x), (label == 0).mean()), rtol=1e-9, atol=1e-9)
    packs = quality.labelled(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    once, twice = (quality.totals(packs, 4, direct)(lambda x, label: {"x": x.sum(0, dtype=float)})["x"] for direct in (64, 1))
    assert np.allclose(once, x.sum(0, dtype=float)) and np.allclose(twice, once)
