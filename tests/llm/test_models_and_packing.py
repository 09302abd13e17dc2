"""Mixing, packing, language-model scores, classifiers and the rollup."""

from __future__ import annotations

import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilframe.llm import common, lm_scoring, mixing, packing, quality, queries, textnum, toxicity
from vigilframe.llm.token_rollup import TokenRollup, counted, deletes, inserts, revisions

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def targets_brute(sizes, weights, share, most):
    """Repeats the resharing until no target is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left, total = budget - sum(capped.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s] + 1e-9]
        if not over:
            return capped | {s: left * weight[s] / total for s in free}
        capped |= {s: most * sizes[s] for s in over}


def test_mixing(make_docs, odd):
    rng = random.Random(4)
    rows = [(i, t, "a") for i, t in odd]
    rows += [(1000 + i, "w " * rng.randrange(0, 60), rng.choice(["a", "b", "c", "d", None, "hot", "hot", "hot"])) for i in range(3000)]
    docs = make_docs(rows)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    assert sorted(((r.doc_id, r.taken) for r in got), key=str) == sorted(((r.doc_id, r.taken) for r in mixing.mix_sources(docs.repartition(7)).collect()), key=str)
    sizes: Counter = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = targets_brute(dict(sizes), (3, 1, 2), 1.5, 2.0)
    taken: Counter = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        if s != "a":  # "a" holds one text of 50,000 words
            assert abs(taken[s] - t) <= 60
    assert mixing.mix_sources(make_docs([])).count() == 0
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in got if r.size)


def test_rounding_is_fair(make_docs):
    """Each document is taken with its fraction as probability, over many seeds."""
    docs = make_docs([(i, "w " * (5 + i % 7), "b" if i < 20 else "a") for i in range(40)], extra=False).persist()
    runs = [{r.doc_id: (r.copies, r.target / r.source_size) for r in mixing.mix_sources(docs, seed=s, share=0.8).collect()} for s in range(12)]
    shares = {i: p for i, (_, p) in runs[0].items()}
    mean = np.mean([[run[i][0] - shares[i] for i in range(40)] for run in runs])
    assert abs(mean) < 0.05


def test_best_fill_against_all_subsets():
    rng = random.Random(2)
    for _ in range(60):
        counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(5)}
        room = rng.randrange(0, 90)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        used = packing.best_fill(counts, room)
        assert all(used[n] <= counts[n] for n in used)
        assert sum(n * k for n, k in used.items()) == max(s for s in sums if s <= room)


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def test_packing_round_trip(documents, make_docs, odd, tokenizer):
    path, tok = tokenizer
    odd += [(50, "two  spaces\t tab \n line <|endoftext|> x"), (51, " lead and trail "), (52, "nbsp  x   y")] + [(60 + i, "same length here") for i in range(500)]
    rows = odd + [(r.doc_id + 2000, r.text) for r in documents.collect()]
    got = packing.pack_documents(make_docs(rows), path, emit={"ids": F.col("ids"), "crc": F.crc32("ids")}).toPandas()
    whole = Counter()
    for (doc, total), g in got.groupby(["doc_id", "doc_tokens"], dropna=False):
        for start in sorted(set(g["start"])):
            assert (g["start"] == start).sum() >= 1
        whole[None if doc != doc else int(doc)] += int(g["length"].sum())
        assert g["length"].sum() % total == 0
    assert whole == Counter({d: sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for x, t in rows if x == d) for d in {d for d, _ in rows}})
    texts = dict(rows)
    once = [d for d, n in Counter(d for d, _ in rows).items() if n == 1 and d is not None]
    for doc, g in got[got["doc_id"].isin(once)].groupby("doc_id"):
        g = g.sort_values("start")
        want = np.array([*tok.encode(texts[doc] or "", add_special_tokens=False).ids, 0], "<u4")
        assert b"".join(g["ids"]) == want.tobytes() and (g["start"] == g["length"].cumsum() - g["length"]).all()
        assert [zlib.crc32(x) for x in g["ids"]] == g["crc"].tolist()
    s = got.sort_values(["sequence_id", "offset"])
    assert (s.groupby("sequence_id")["length"].cumsum() - s["length"] == s["offset"]).all()
    assert (s.groupby("sequence_id")["length"].sum() < 1024).sum() <= 1 and s.groupby("sequence_id")["length"].sum().max() == 1024
    assert packing.pack_documents(make_docs([]), path).count() == 0


def test_encoder_falls_back_for_other_files(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    t.save(str(tmp_path / "t.json"))
    e = packing._Encoder(str(tmp_path / "t.json"))
    assert e.fast is None
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(["a b a", ""])] == [[0, 1, 0], []]


def test_word_hashes_follow_words(monkeypatch):
    monkeypatch.setattr(textnum, "CHUNK", 64)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abA é\n\t ") for _ in range(rng.randrange(200))) for _ in range(60)] + [None, "", "x" * 300, "y " * 300]
    seen: dict = {}
    n = 0
    for first, doc, h in textnum.word_hashes([None if t is None else t.encode() for t in texts]):
        for i in np.unique(doc):
            words = WORD.findall(low(texts[first + i]))
            assert len(words) == (doc == i).sum()
            for w, x in zip(words, h[doc == i], strict=True):
                assert seen.setdefault(w, x) == x
                n += 1
    assert n == sum(len(WORD.findall(t or "")) for t in texts) and len(set(seen.values())) == len(seen)


def test_lm_scores(spark, make_docs, documents, odd):
    rows = odd + [(r.doc_id + 100, r.text) for r in documents.collect()]
    docs = make_docs(rows)
    out = common.held_out(F.col("doc_id"), 1)
    for head in (50, 1 << 18):  # most words by join, then all by broadcast
        model = lm_scoring.fit(spark, docs.where(~out), head_words=head)
        got = lm_scoring.score(docs, model, held_out=out).collect()
        is_out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
        tokens = [[*WORD.findall(low(t)), "\n"] for _, t in rows]
        c = Counter(w for (i, _), x in zip(rows, tokens, strict=True) if not is_out(i) for w in x)
        n, v = sum(c.values()), len(c)
        want = sorted(((i, is_out(i), len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), 4)) for (i, _), x in zip(rows, tokens, strict=True)), key=str)
        assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got), key=str) == want
        assert all(r.score <= 0 and math.isfinite(r.score) for r in got)
        assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    assert lm_scoring.score(docs.limit(0), model).count() == 0
    empty = lm_scoring.fit(spark, docs.limit(0))
    assert [r.base_score for r in lm_scoring.score(make_docs([(1, None)]), empty).collect()] == [0.0]


def test_filter_reads_counts_back(spark):
    rng = np.random.default_rng(3)
    grams = np.unique(rng.integers(0, 2**63, 4000, np.uint64))
    counts = rng.integers(1, 500, len(grams))
    seg, rest = lm_scoring._segment(grams), lm_scoring._rest(grams)
    rows = [(int(s), bytearray(rest[seg == s].astype("<u4").tobytes()), bytearray(counts[seg == s].astype("<u4").tobytes())) for s in np.unique(seg)]
    bits = lm_scoring.build_filter(spark.createDataFrame(rows, "segment int, grams binary, counts binary"))
    read = lm_scoring.probe(bits, grams)
    level = np.floor(np.log2(counts))
    assert (read >= 2**level * 0.99).all()  # nothing is lost
    assert np.mean(read <= 2 ** (level + 1)) > 0.9
    other = rng.integers(0, 2**63, 4000, np.uint64)
    assert np.mean(lm_scoring.probe(bits, other) > 0) < 0.2


def test_long_regular_words_have_hashes_of_their_own(spark, make_docs):
    """Two words that sums of powers can't tell apart (each letter stands at the other's places)."""
    turn = "a"
    while len(turn) < 2048:
        turn += turn.translate(str.maketrans("ab", "ba"))
    other = turn.translate(str.maketrans("ab", "ba"))
    docs = make_docs([(1, turn), (2, turn), (3, other)])
    got = {r.doc_id: r.base_score for r in lm_scoring.score(docs, lm_scoring.fit(spark, docs)).collect()}
    n, v = 6, 3
    want = {i: math.log10((c + 0.5) / (n + 0.5 * (v + 1))) + math.log10(3.5 / (n + 0.5 * (v + 1))) for i, c in ((1, 2), (2, 2), (3, 1))}
    assert got == pytest.approx(want)


def lm_brute(rows, trained):
    """Scores by exact counts that are cut to their levels."""
    tokens = {i: [*WORD.findall(low(t)), "\n"] for i, t in rows}
    words = Counter(w for i in trained for w in tokens[i])
    pairs = Counter(p for i in trained for p in zip([None, *tokens[i]], tokens[i]))  # noqa: B905
    spread = sum(words.values()) + 0.5 * (len(words) + 1)

    def log(before, w):
        c, context = pairs[before, w], len(trained) if before is None else words[before]
        middle = c if c < 2 else 0.75 * 2.0 ** c.bit_length() - 0.5
        return math.log10((min(middle, context, words[w]) + lm_scoring.PRIOR * (words[w] + 0.5) / spread) / (context + lm_scoring.PRIOR))

    return {i: sum(log(b, w) for b, w in zip([None, *x], x)) for i, x in tokens.items()}  # noqa: B905


@pytest.mark.parametrize("block", [4_000, lm_scoring.BLOCK])
def test_lm_scores_against_exact_counts(spark, make_docs, documents, block):
    """The same scores whether the filter is broadcast or asked by segment; false hits alone raise a score."""
    rows = [(r.doc_id, r.text) for r in documents.collect()] + [(100_000 + i, t) for i, t in enumerate([None, "", " \t", "x" * 5000, "word " * 3000])]
    trained = [i for i, _ in rows if i % 3]
    docs = make_docs(rows)
    want = lm_brute(rows, trained)
    runs = {}
    for most in (0, lm_scoring.MAX_BROADCAST):
        model = lm_scoring.fit(spark, docs.where("doc_id % 3 <> 0"), head_words=100, max_broadcast=most)
        assert (model.filter is None) == (most == 0)
        runs[most] = {r.doc_id: r.score for r in lm_scoring.score(docs, model, block_bytes=block).collect()}
    few = lm_scoring.fit(spark, docs.where("doc_id % 3 <> 0"), head_words=100, head_pairs=2000, max_broadcast=0)
    assert len(few.pairs.value[0]) <= 2048 < len(model.filter.value[0])
    assert {r.doc_id: r.score for r in lm_scoring.score(docs, few, block_bytes=block).collect()} == pytest.approx(runs[0], abs=1e-9)
    first, second = runs.values()
    assert first == pytest.approx(second, abs=1e-9)
    assert all(first[i] >= want[i] - 1e-6 for i in want)
    assert np.mean([first[i] - want[i] < 0.01 * abs(want[i]) for i in want]) > 0.9
    sparse = lm_scoring.fit(spark, docs.where("doc_id % 3 <> 0"), head_words=100, max_broadcast=0, bits_per_level=400)  # hardly a false hit
    exact = lm_scoring.score(docs, sparse).collect()
    assert {r.doc_id: r.score for r in exact} == pytest.approx(want, rel=1e-6)


@pytest.mark.parametrize("n", [3_000, 60_000, 600_000])
def test_filter_is_as_full_at_every_size(spark, n):
    rng = np.random.default_rng(n)
    grams = np.unique(rng.integers(0, 2**63, n, np.uint64))
    counts = np.minimum(rng.zipf(1.7, len(grams)), 10**6)
    seg, rest = lm_scoring._segment(grams), lm_scoring._rest(grams).astype("<u4")
    cut = np.searchsorted(seg, np.arange(lm_scoring.SEGMENTS + 1))
    pdf = [(s, bytearray(rest[i:j].tobytes()), bytearray(counts[i:j].astype("<u4").tobytes())) for s, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]
    bits = lm_scoring.build_filter(spark.createDataFrame(pdf, "segment long, grams binary, counts binary")).persist()
    whole = np.concatenate([np.frombuffer(r["bits"], np.uint8) for r in bits.collect()])
    assert np.bitwise_count(whole).sum() / (8 * len(whole)) <= 0.55
    other = rng.integers(2**63, 2**64, 40_000, np.uint64) ^ np.uint64(1 << 63)
    assert np.mean(lm_scoring.probe(bits, other) > 0) < 0.02
    read, level = lm_scoring.probe(bits, grams), np.floor(np.log2(counts))
    assert (read >= 2**level * 0.99).all() and np.mean(read <= 2 ** (level + 1)) > 0.95


def test_segments_follow_the_text():
    assert lm_scoring.segments_for(0) == lm_scoring.segments_for(16 << 30) == 1024
    assert lm_scoring.segments_for((16 << 30) + 1) == 2048
    h = np.array([0, 2**63, 2**64 - 1], np.uint64)
    assert lm_scoring._segment(h, 2048).tolist() == [0, 1024, 2047]


def test_filter_grows_with_the_grams(spark, make_docs):
    """False hits are as rare for 60 times the grams: nothing caps the filter."""
    rng = np.random.default_rng(4)
    size = {}
    for n in (5_000, 300_000):
        grams = np.unique(rng.integers(0, 2**63, n, np.uint64))
        seg, rest = lm_scoring._segment(grams), lm_scoring._rest(grams)
        cut = np.searchsorted(seg, np.arange(lm_scoring.SEGMENTS + 1))
        rows = [(s, bytearray(rest[i:j].astype("<u4").tobytes()), bytearray(np.full(j - i, 3, "<u4").tobytes())) for s, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]
        bits = lm_scoring.build_filter(spark.createDataFrame(rows, "segment int, grams binary, counts binary"))
        size[n] = bits.selectExpr("sum(length(bits))").first()[0]
        assert np.mean(lm_scoring.probe(bits, rng.integers(0, 2**63, 4000, np.uint64)) > 0) < 0.05
    assert size[300_000] > 15 * size[5_000]


def test_rare_words_have_exact_counts(spark, make_docs):
    """Words outside the head are counted exactly, so only pairs depend on the filter."""
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(30)) for _ in range(40)]
    docs = make_docs(list(enumerate(texts)))
    few, all_ = (sorted((r.doc_id, r.n_known, round(r.score, 9)) for r in lm_scoring.score(docs, lm_scoring.fit(spark, docs, head_words=k)).collect()) for k in (1, 1000))
    assert few == all_


def test_very_long_texts(spark, make_docs):
    """Texts above the bytes that are worked on at once give what their words give."""
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(400_000))
    assert len(long) > 2 * textnum.CHUNK
    docs = make_docs([(1, long), (2, "w1 w2 w3"), (3, long + "\n"), (4, "x" * (textnum.CHUNK + 5))])
    got = {r.doc_id: r for r in lm_scoring.score(docs, lm_scoring.fit(spark, docs)).collect()}
    c = Counter(WORD.findall(long))
    n, v = 2 * sum(c.values()) + 3 + 1 + 4, len(set(c) | {"w1", "w2", "w3"}) + 2
    p = lambda w: math.log10((2 * c[w] + (w in ("w1", "w2", "w3")) + 0.5) / (n + 0.5 * (v + 1)))
    end = math.log10(4.5 / (n + 0.5 * (v + 1)))
    assert got[1].base_score == pytest.approx(sum(k * p(w) for w, k in c.items()) + end) and got[1].n_tokens == 400_001
    assert got[3].base_score == pytest.approx(got[1].base_score) and got[4].n_known == 2
    table = quality._pooling_table(*quality.word_vectors(docs))
    pooled = quality.pool([long.encode(), None, b"w1 w2 w3"], table)
    words = np.array([h for _, _, x in textnum.word_hashes([long.encode()[: textnum.CHUNK // 2 * 2]], lower=False) for h in x])
    assert pooled[0, -1] == pytest.approx(np.log1p(400_000)) and len(words) and not pooled[1].any()
    doc, word = toxicity.word_sets([long.encode(), b"w1"])
    assert len(set(word[doc == 0])) == (doc == 0).sum() and set(word[doc == 1]) <= set(word[doc == 0])
    assert len(toxicity._few(np.arange(9000))) == toxicity.MAX_WORDS


def planted(n, odd_words, share, seed):
    """(texts, labels): labelled texts hold some of odd_words among common ones."""
    rng = random.Random(seed)
    common_words = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(n):
        y = rng.random() < share
        words = [rng.choice(common_words) for _ in range(rng.randrange(20, 80))]
        if y:
            for _ in range(max(3, len(words) // 3)):
                words[rng.randrange(len(words))] = rng.choice(odd_words)
        out.append((" ".join(words), int(y)))
    return out


def test_quality(spark, make_docs, odd):
    data = planted(700, [f"junk{i}%%" for i in range(200)], 0.4, 1)
    docs = make_docs([(i, t) for i, (t, _) in enumerate(data)])
    labels = spark.createDataFrame([(i, 1 - y) for i, (_, y) in enumerate(data)] + [(3, None), (None, 1), (99999, 0)], "doc_id long, quality int")
    model = quality.fit(spark, docs, labels, learn_from=lambda i: ~common.held_out(i, 0))
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    held = [i for i in range(len(data)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (data[i][1] == 0) for i in held]) > 0.95
    extra = quality.score(make_docs(odd), model).collect()
    assert len(extra) == len(odd) and all(0 <= r.score <= 1 for r in extra)
    assert quality.score(docs.limit(0), model).count() == 0
    none = quality.fit(spark, docs.limit(0), labels.limit(0))
    assert {r.score for r in quality.score(make_docs(odd), none).collect()} == {0.5}


def test_risk_gradient_by_finite_differences():
    rng = np.random.default_rng(5)
    fp, fu = rng.normal(size=7), rng.normal(size=11) + 1
    assert toxicity.negative_risk(fp, fu, 0.3) > 0
    f, g = np.concatenate([fp, fu]), toxicity.risk_gradient(fp, fu, 0.3)
    for k in range(len(f)):
        step = np.zeros(len(f))
        step[k] = 1e-6
        up, down = (toxicity.risk((f + s)[:7], (f + s)[7:], 0.3) for s in (step, -step))
        assert g[k] == pytest.approx((up - down) / 2e-6, abs=1e-6)
    # Below zero the step goes back on the negative part.
    fu = fu - 9
    assert toxicity.negative_risk(fp, fu, 0.3) < 0
    f, g = np.concatenate([fp, fu]), toxicity.risk_gradient(fp, fu, 0.3)
    for k in range(len(f)):
        step = np.zeros(len(f))
        step[k] = 1e-6
        up, down = (toxicity.negative_risk((f + s)[:7], (f + s)[7:], 0.3) for s in (step, -step))
        assert g[k] == pytest.approx(-(up - down) / 2e-6, abs=1e-6)


def test_gathered_rows():
    flat, ends = np.arange(10), np.array([3, 3, 7, 10])
    starts = np.concatenate([[0], ends[:-1]])
    words, owner = toxicity.gathered(flat, starts, ends, np.array([2, 1, 0, 2]))
    assert words.tolist() == [3, 4, 5, 6, 0, 1, 2, 3, 4, 5, 6] and owner.tolist() == [0, 0, 0, 0, 2, 2, 2, 3, 3, 3, 3]


def test_word_vectors_against_plain_sums(spark, make_docs, odd):
    rows = [r for r in odd if len(r[1] or "") < 1000] + [(70, "the cat The dog the cat ,  sat")]
    vectors, counts = quality.word_vectors(make_docs(rows).repartition(3))
    want, seen = np.zeros_like(vectors), np.zeros_like(counts)
    for _, t in rows:
        words = WORD.findall(t or "")
        hashes = [h for _, _, h in textnum.word_hashes([" ".join(words).encode()], lower=False)]
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        bucket, entries = quality._bucket(h), list(quality._entries(h))
        for i in range(len(h)):
            seen[bucket[i]] += 1
            for j in range(max(0, i - quality.REACH), min(len(h), i + quality.REACH + 1)):
                for dim, sign in entries if j != i else ():
                    want[bucket[i], dim[j]] += sign[j]
    assert (counts == seen).all() and np.allclose(vectors, want)


def test_tables_are_added_in_a_tree(spark, monkeypatch):
    """Every task's table counts once, sums leave 32 bits whole, and no group holds more than FAN rows."""
    monkeypatch.setattr(quality, "FAN", 4)
    width, each = quality.BUCKETS * quality.DIM // quality.SPANS, quality.BUCKETS // quality.SPANS
    vectors, counts = bytearray(quality._packed(np.full(width, -(1 << 29)))), bytearray(quality._packed(np.full(each, 1 << 40)))
    assert (vectors[0], counts[0]) == (4, 8)
    rows = [(t, s, vectors, counts) for t in range(4**quality.LEVELS - 3) for s in (0, 5)]
    got = quality.combine(spark.createDataFrame(rows, quality.PARTS).repartition(7)).collect()
    n = 4**quality.LEVELS - 3
    assert sorted(r.span for r in got) == [0, 5]
    assert all((quality._unpacked(r.vectors) == -(1 << 29) * n).all() and (quality._unpacked(r.counts) == (1 << 40) * n).all() for r in got)
    sent = spark.createDataFrame(rows, quality.PARTS).select("span", "task")
    for level in range(quality.LEVELS):
        assert sent.groupBy("span", (F.col("task") / 4 ** (level + 1)).cast("int")).agg(F.countDistinct((F.col("task") / 4**level).cast("int")).alias("n")).agg(F.max("n")).first()[0] <= 4


def test_network_gradient_and_temperature():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 5))
    p = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (rng.random(400) < p).astype(float)
    net = quality.train_network(x, y)
    aside = np.arange(400) % 5 == 4
    loss = lambda t: np.mean(np.logaddexp(0, np.where(y[aside] > 0.5, -1, 1) * net.logits(x[aside]) / t))
    assert all(loss(net.temperature) <= loss(t) + 1e-12 for t in np.geomspace(0.5, 8, 41))
    # Calibrated: mean probability and mean label agree within noise.
    assert abs(net.probability(x).mean() - y.mean()) < 0.08
    assert np.corrcoef(net.probability(x), p)[0, 1] > 0.9


def test_toxicity(spark, make_docs, odd):
    data = planted(1200, ["vile", "nasty", "rotten", "foul"], 0.15, 2)
    docs = make_docs([(i, t) for i, (t, _) in enumerate(data)])
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(data) if i % 3] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(spark, docs, labels, learn_from=lambda i: ~common.held_out(i, 0))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(len(data)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i] >= 0.5 for i in held if data[i][1]]) > 0.9
    assert np.mean([got[i] >= 0.5 for i in held if not data[i][1]]) < 0.03
    extra = toxicity.score(make_docs(odd), model).collect()
    assert len(extra) == len(odd) and all(0 <= r.score <= 1 for r in extra)
    none = toxicity.fit(spark, docs, labels.limit(0))
    assert max(r.score for r in toxicity.score(make_docs(odd), none).collect()) < 0.01


def test_samples_are_bounded_in_rows(spark, make_docs, monkeypatch):
    """An id with very many rows doesn't fill the driver; equal rows of op7 train once."""
    seen = {}
    for module, name in ((toxicity, "train_nnpu"), (quality, "train_network")):
        train = getattr(module, name)
        monkeypatch.setattr(module, name, lambda x, y, *rest, f=train, name=name: (seen.__setitem__(name, len(y)), f(x, y, *rest))[1])
    rows = [(i, f"{'foul' if i % 2 else 'fair'} words number {i % 7} stand here") for i in range(60)] + [(1, "foul words number 1 stand here")] * 3000 + [(3, f"foul other {k}") for k in range(3000)]
    docs, labels = make_docs(rows), spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(spark, docs, labels, max_positive=30, max_unlabelled=60).prior == 0.5
    model = quality.fit(spark, docs, labels, max_train=500)
    assert quality.score(docs.limit(5), model).count() == 5 and seen == {"train_nnpu": 90, "train_network": 500}


def test_rollup(spark, make_docs, tmp_path):
    docs = make_docs([(1, "a b c", "x"), (2, "d", "x"), (3, None, None)])
    count = {("words", "1"): common.word_count(F.col("text"))}
    r = TokenRollup(spark, f"file://{tmp_path}/r")
    assert r.totals().count() == 0
    assert r.commit("one", inserts(counted(docs, count)))
    assert not r.commit("one", inserts(counted(docs, count)))
    total = lambda: {x.source: (x.documents, x.tokens) for x in r.totals().collect()}
    assert total() == {"x": (2, 4), None: (1, 0)}
    change = spark.createDataFrame([("x", "en", "words", "1", 3, 10)], "source string, lang string, tokenizer string, version string, old_tokens long, new_tokens long")
    r.commit("two", revisions(change))
    r.commit("three", deletes(counted(docs.where("source is null"), count)))
    r.commit("none", inserts(counted(docs.limit(0), count)))
    assert total() == {"x": (2, 11)}
    # An attempt that never got its commit record shows nothing.
    inserts(counted(docs, count)).write.parquet(f"file://{tmp_path}/r/deltas/attempt=lost")
    assert total() == {"x": (2, 11)}
    with pytest.raises(ValueError):
        r.commit("", inserts(counted(docs, count)))
    # Totals stay through folds, and ids that paths would change are ids.
    assert r.fold() and total() == {"x": (2, 11)} and not r.fold()
    for name in ("a/b", "a b", "a%20b", "=", "_x", "é" * 200):
        assert r.commit(name, inserts(counted(docs.where("doc_id = 2"), count))) and not r.commit(name, inserts(counted(docs, count)))
    assert total() == {"x": (8, 17)} and r.fold() and total() == {"x": (8, 17)}
    # Repeated rows count each.
    r.commit("twice", inserts(counted(docs.union(docs).where("doc_id = 1"), count)))
    assert total() == {"x": (10, 23)}


def test_rollup_of_two_writers(spark, make_docs, tmp_path, monkeypatch):
    """Both find no record and write their deltas; the first record counts."""
    docs, count = make_docs([(1, "a b c", "x")]), {("words", "1"): common.word_count(F.col("text"))}
    one, two = (TokenRollup(spark, f"file://{tmp_path}/r") for _ in range(2))
    create = one._create

    def second_comes_first(name, content):
        monkeypatch.setattr(one, "_create", create)
        assert two.commit("b", deletes(counted(docs, count)))
        return create(name, content)

    monkeypatch.setattr(one, "_create", second_comes_first)
    assert not one.commit("b", inserts(counted(docs, count)))
    assert [(x.documents, x.tokens) for x in two.totals().collect()] == [(-1, -3)]
    monkeypatch.setattr(one, "_create", lambda name, content: two.fold() and create(name, content))
    assert not one.fold()
    assert [(x.documents, x.tokens) for x in one.totals().collect()] == [(-1, -3)]


class _Killed(Exception):
    pass


def _dies(*_):
    raise _Killed


def test_rollup_recovers_from_writers_that_die(spark, make_docs, tmp_path, monkeypatch):
    """A writer that ends before its record has its name leaves nothing behind; the batch, or the fold, is done again."""
    docs, count = make_docs([(1, "a b c", "x")]), {("words", "1"): common.word_count(F.col("text"))}
    new = lambda: TokenRollup(spark, f"file://{tmp_path}/r")
    total = lambda: [(x.documents, x.tokens) for x in new().totals().collect()]
    dying = new()
    monkeypatch.setattr(dying, "_publish", _dies)
    with pytest.raises(_Killed):
        dying.commit("b", inserts(counted(docs, count)))
    assert total() == []
    assert new().commit("b", inserts(counted(docs, count))) and total() == [(1, 3)]
    with pytest.raises(_Killed):
        dying.fold()
    assert total() == [(1, 3)] and new().fold() and total() == [(1, 3)] and not new().fold()
    # One that dies while it writes its record, before it has a name.
    monkeypatch.setattr(json, "dumps", _dies)
    with pytest.raises(_Killed):
        new().commit("c", inserts(counted(docs, count)))
    monkeypatch.undo()
    assert new().commit("c", inserts(counted(docs, count))) and total() == [(2, 6)]
    assert not new().commit("c", inserts(counted(docs, count))) and total() == [(2, 6)]
    # A name that is taken stays as it is.
    assert not new()._create("pointers/p000000000001.json", {"number": 1, "snapshot": "other"}) and total() == [(2, 6)]


def test_rollup_folds_by_itself(spark, make_docs, tmp_path):
    docs, count = make_docs([(1, "a b c", "x")]), {("words", "1"): common.word_count(F.col("text"))}
    r = TokenRollup(spark, f"file://{tmp_path}/r", fold_every=3)
    for k in range(7):
        assert r.commit(f"b{k}", inserts(counted(docs, count)))
        assert r._unfolded(r._snapshot()[1]).count() == (k + 1) % 3
    assert [(x.documents, x.tokens) for x in r.totals().collect()] == [(7, 21)] and r._snapshot()[0] == 2


def test_token_rollup_against_the_tokenizer(spark, sf_dir, documents, tokenizer):
    want: Counter = Counter()
    for r in documents.collect():
        n = len(tokenizer[1].encode(r.text or "", add_special_tokens=False).ids)
        for key, tokens in ((("byte_bpe", "50k"), n), (("words", "1"), len(WORD.findall(r.text or "")))):
            want[r.source, r.lang, *key, "documents"] += 1
            want[r.source, r.lang, *key, "tokens"] += tokens
    got = {(r.source, r.lang, r.tokenizer, r.version, c): r[c] for r in queries.op1_token_rollup(spark, sf_dir).collect() for c in ("documents", "tokens")}
    assert got == dict(want)
