"""Exact, line, SimHash and embedding dedup against plain Python."""

from __future__ import annotations

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from vigilframe.llm import common, embedding_dedup, line_dedup, mixing, shingle_dedup, simhash
from vigilframe.llm.components import connected_components, forest
from vigilframe.llm.exact_dedup import content_sort_dedup
from vigilframe.llm.line_dedup import EVERY, SPAN

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact_brute(rows, keep):
    norm = [(i, (t or "").translate(LOWER)) for i, t in rows]
    groups: dict = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    out = []
    for i, t in norm:
        ids = [x for x in groups[t] if x is not None]
        out.append((i, (min if keep == "min" else max)(ids) if ids else None, len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact(make_docs, odd, keep):
    rows = odd + [(100 + i, "hot copy") for i in range(60)]  # more than a partition's fair share
    got = content_sort_dedup(make_docs(rows), keep=keep).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == exact_brute(rows, keep)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in kept})


def test_exact_tables(documents, make_docs):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = content_sort_dedup(documents, keep="max").collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == exact_brute(rows, "max")
    assert content_sort_dedup(make_docs([])).count() == 0


def rotl(x, j):
    return ((x << j) | (x >> (64 - j))) & (2**64 - 1) if j else x


def chunks(text):
    lines = text.split("\n")
    h, out, start = [xxhash.xxh64_intdigest(x, 42) for x in lines], [], 0
    for i in range(len(lines)):
        roll = 0
        for j in range(SPAN):
            roll ^= rotl(h[i - j] if i >= j else 0, j)
        signed = roll - 2**64 if roll >= 2**63 else roll
        if signed % EVERY == 0 or i == len(lines) - 1:
            out.append(lines[start : i + 1])
            start = i + 1
    return out


def line_brute(rows):
    seen, done, out = set(), {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if t is None or (i, t) in done:
            out.append((i, done.get((i, t), t)))
            continue
        left = []
        for c in chunks(t):
            if len(c) > 1 and tuple(c) in seen:
                continue
            if len(c) > 1:
                seen.add(tuple(c))
            left += c
        done[i, t] = "\n".join(left)
        out.append((i, done[i, t]))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [64, 3])
def test_lines(make_docs, odd, bits):
    """With 3-bit keys most chunks clash, so the byte comparison decides."""
    rng = random.Random(5)
    passage = "\n".join(f"shared {i}" for i in range(40))
    rows = [r for r in odd if r[0] is not None or r[1] is None] + [(20 + i, "\n".join([f"own {i} {rng.random()}", passage, f"end {i}"])) for i in range(12)]
    rows += [(50 + i, "\n".join(rng.choice("pqrs") for _ in range(30))) for i in range(20)]
    docs = make_docs(rows)
    got = line_dedup.line_dedup(docs, key_bits=bits)
    assert got.columns == docs.columns
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=str) == line_brute(rows)


def test_lines_tables(documents, make_docs):
    got = line_dedup.line_dedup(documents, detail_col="d").collect()
    assert sorted([(r.doc_id, r.text) for r in got], key=str) == line_brute([(r.doc_id, r.text) for r in documents.collect()])
    assert sum(r.d.removed_lines for r in got) > 0
    assert line_dedup.line_dedup(make_docs([])).count() == 0


def pieces_of(lines):
    """(first, lines as a tuple): pairs of neighbouring lines that aren't both blank, and long lines."""
    out = [(k, tuple(lines[k : k + 2])) for k in range(len(lines) - 1) if any(x.strip(" ") for x in lines[k : k + 2])]
    return out + [(k, (x,)) for k, x in enumerate(lines) if len(x.split()) > line_dedup.LONG_LINE]


def passages_brute(rows):
    """A piece goes if an earlier place has it whose own lines no later piece holds; n lines that stay."""
    texts = [(i, t.split("\n")) for i, t in sorted(rows)]
    first = {}
    for n, (_, lines) in enumerate(texts):
        for k, p in pieces_of(lines):
            first[p] = min(first.get(p, (n, k)), (n, k))
    later = [(n, k, p) for n, (_, lines) in enumerate(texts) for k, p in pieces_of(lines) if first[p] != (n, k) and not (first[p][0] == n and k < first[p][1] + len(p))]
    may_go = {(n, k + j) for n, k, p in later for j in range(len(p))}
    gone = {(n, k + j) for n, k, p in later if not any((first[p][0], first[p][1] + j) in may_go for j in range(len(p))) for j in range(len(p))}
    return [(i, "\n".join(x for k, x in enumerate(lines) if (n, k) not in gone), sum((n, k) in gone for k in range(len(lines)))) for n, (i, lines) in enumerate(texts)]


def assert_nothing_is_lost(rows, got):
    """Whatever is removed stands whole in some result: each line that is gone lies in a pair, or is a long line, that does."""
    standing = {p for t in got.values() for _, p in pieces_of(t.split("\n"))}
    for i, t in rows:
        before, after = t.split("\n"), got[i].split("\n") if got[i] or not t else []
        # What stays is a subsequence; lines that may have gone are those outside some way to find it.
        taken, k = [], 0
        for x in before:
            taken.append(k < len(after) and after[k] == x)
            k += taken[-1]
        assert k == len(after)
        for n, stays in enumerate(taken):
            assert stays or any(a <= n < a + len(p) and p in standing for a, p in pieces_of(before)), (i, before[n])


@pytest.mark.parametrize("bits", [64, 2])
def test_overlapping_passages_stay_somewhere(make_docs, bits):
    """Chains of passages that overlap, and repeats inside a text."""
    rows = [(1, "aa\nbb"), (5, "aa\nbb\ncc"), (9, "bb\ncc"), (11, "x x\nx x\nx x"), (12, "\n".join(["y"] * 40)), (13, "y\ny\nz")]
    rng = random.Random(2)
    rows += [(100 + i, "\n".join(rng.choice("pqrst") for _ in range(rng.randrange(2, 9)))) for i in range(60)]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(make_docs(rows), min_lines=1, key_bits=bits, pieces=line_dedup.passages_of).collect()}
    assert sorted(got.items()) == [(i, t) for i, t, _ in passages_brute(rows)]
    assert_nothing_is_lost(rows, got)
    assert got[1] == "aa\nbb" and got[5] == "cc" and got[9] == "bb\ncc" and got[12] == "y\ny" and got[13] == "z"


def test_documents_lose_no_passage(documents):
    rows = [(r.doc_id, r.text or "") for r in documents.collect()]
    got = {r.doc_id: r.text or "" for r in line_dedup.line_dedup(documents, min_lines=1, pieces=line_dedup.passages_of).collect()}
    assert_nothing_is_lost(rows, got)


def test_clashing_names_raise(make_docs):
    with pytest.raises(ValueError):
        line_dedup.line_dedup(make_docs([(1, "a")]).withColumn("__line_x", F.lit(1)))


@pytest.mark.parametrize("bits", [64, 3])
def test_passages_go_wherever_they_lie(spark, make_docs, bits):
    """Repeated passages of 2 to 10 lines and long single lines are removed whole."""
    rng = random.Random(9)
    passages = [[f"p{n}-{k}" for k in range(n)] for n in (2, 3, 4, 6, 10)] + [[" ".join(f"long{i}" for i in range(60))]]
    rows = [(i, "\n".join([f"own {rng.random()}", *p, "", "", f"end {rng.random()}"])) for i, p in enumerate(passages * 4)]
    rows += [(100 + i, "\n".join(rng.choice("pqrs") for _ in range(20))) for i in range(8)]
    rows += [(200, "a single line"), (201, "a single line"), (202, "")]
    got = line_dedup.line_dedup(make_docs(rows), min_lines=1, detail_col="d", key_bits=bits, pieces=line_dedup.passages_of).collect()
    assert sorted((r.doc_id, r.text, r.d.removed_lines) for r in got) == passages_brute(rows)
    assert not any("p" in r.text or "long" in r.text for r in got if len(passages) <= r.doc_id < 100)


@pytest.mark.parametrize("pieces, least", [(line_dedup.chunks_of, 2), (line_dedup.passages_of, 1)])
def test_time_grows_with_the_lines(make_docs, pieces, least):
    """Two equal texts of 100,000 lines: lines times marks would take hours."""
    text = "\n".join(f"line {i}" for i in range(100_000))
    began = time.time()
    rows = [(1, text), (2, text), (3, text + "\nend")]
    got = [(r.doc_id, r.text) for r in line_dedup.line_dedup(make_docs(rows), min_lines=least, pieces=pieces).collect()]
    assert time.time() - began < 60
    want = line_brute(rows) if least == 2 else [(i, x) for i, x, _ in passages_brute(rows)]
    assert sorted(got) == want and len(want[1][1]) < len(text) / 5


def fp_brute(text, n):
    words = (text or "").translate(LOWER)
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in words).split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_brute(ids, links):
    label = dict(zip(ids, ids, strict=True))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return {x: root(x) for x in ids}


def test_simhash(spark, make_docs, odd, documents):
    rows = odd + [(r.doc_id + 1000, r.text) for r in documents.collect()]
    got = simhash.simhash_groups(make_docs(rows), shingle=3, budget=3).collect()
    expected = {t: fp_brute(t, 3) for _, t in rows}
    order = list(range(len(rows)))
    fps = [expected[t] for _, t in rows]
    label = components_brute(order, [(i, j) for i in order for j in order[:i] if (fps[i] ^ fps[j]).bit_count() <= 3])
    low: dict = {}
    for i in order:
        if rows[i][0] is not None:
            low[label[i]] = min(low.get(label[i], 10**9), rows[i][0])
    want = sorted([(rows[i][0], f"{fps[i]:016x}", low.get(label[i])) for i in order], key=str)
    assert sorted([tuple(r) for r in got], key=str) == want
    assert simhash.simhash_groups(make_docs([])).count() == 0


def test_similar_pairs_against_sets():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 300, np.uint64)
    sets = [np.unique(np.where(rng.random(300) < p, rng.integers(0, 2**63, 300, np.uint64), base)) for p in rng.uniform(0, 0.3, 60)] + [np.empty(0, np.uint64), base[:1], base[:1]]
    alike = {(i, j) for j in range(len(sets)) for i in range(j) if shingle_dedup.similarity_of(sets[i], sets[j]) >= 0.8}
    assert set(zip(*(x.tolist() for x in shingle_dedup.similar_pairs(sets, 0, 0.8)), strict=True)) == alike and len(alike) > 100
    assert set(zip(*(x.tolist() for x in shingle_dedup.similar_pairs(sets, 20, 0.8)), strict=True)) == {(i, j) for i, j in alike if i < 20 <= j}


def test_rows_are_told_apart_by_id_and_hash(make_docs, monkeypatch):
    """All hashes are equal: the ids still tell documents apart."""
    for module in (common, simhash, shingle_dedup, mixing):
        monkeypatch.setattr(module, "row_hash", lambda *columns: F.lit(7).cast("long"))
    docs = make_docs([(i, f"text number {i} of its own kind {i * i} {i + 77}") for i in range(20)] + [(None, "alone here")])
    assert simhash.near_duplicates(docs, shingle=3).count() == simhash.near_duplicates(docs, shingle=3, similarity=0.8).count() == 21
    drawn = {r.doc_id: r.copies for r in mixing.mix_sources(docs, share=1.0).collect()}
    assert Counter(r.doc_id for r in mixing.mixed_documents(docs, share=1.0).collect()) == {i: n for i, n in drawn.items() if n}


def test_near_duplicates_keep_one_row(make_docs, odd):
    docs = make_docs(odd)
    out = simhash.near_duplicates(docs, shingle=3)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 10, 3, 6, 7, 9]


@pytest.mark.parametrize("part", [512, 7])
def test_pipeline_finds_all_pairs_at_08(spark, make_docs, odd, monkeypatch, part):
    """Chains and groups of edited copies against all pairs of shingle sets."""
    monkeypatch.setattr(shingle_dedup, "PART", part)  # buckets are split
    monkeypatch.setattr(shingle_dedup, "LARGE", 3 if part == 7 else 20_000)  # further rounds
    rng = random.Random(8)
    rows = list(odd)
    for base in range(12):
        words = [f"b{base}w{rng.randrange(500)}" for _ in range(120)]
        for _ in range(8):
            if rng.random() < 0.5:
                words = list(words)
            copy = words if rng.random() < 0.5 else list(words)
            for _ in range(rng.randrange(1, 4)):
                copy[rng.randrange(120)] = f"e{rng.random()}"
            rows.append((1000 + len(rows), " ".join(copy)))
    sets = [set(shingle_dedup.shingles((t or "").encode(), 5).tolist()) for _, t in rows]
    order = range(len(rows))
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    label = components_brute(order, [(i, j) for i in order for j in range(i) if alike(sets[i], sets[j])])
    kept: dict = {}
    for i in order:
        kept[label[i]] = min(kept.get(label[i], (True, 0)), (rows[i][0] is None, rows[i][0] or 0))
    got = corpus_pipeline.drop_near_copies(spark, make_docs(rows), "").collect()
    assert sorted(r.doc_id for r in got) == sorted(i for _, i in kept.values())
    assert len(kept) < len(rows) / 2


@pytest.mark.parametrize("spread", [3, 12, 40])
def test_trie_join_against_all_pairs(spark, spread):
    rng = np.random.default_rng(spread)
    base = rng.integers(0, 2**63, 4, np.uint64)
    codes = np.unique([int(rng.choice(base)) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, spread), replace=False)) for _ in range(700)]).astype(np.uint64)
    links = [(i, j) for i in range(len(codes)) for j in range(i) if int(codes[i] ^ codes[j]).bit_count() <= 3]
    want = components_brute(range(len(codes)), links)
    a, b = simhash.trie_join(codes, 0, 3)
    assert components_brute(range(len(codes)), zip(a.tolist(), b.tolist(), strict=True)) == want
    fps = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    at = {int(c): i for i, c in enumerate(codes.view(np.int64))}
    found = [(at[r.src], at[r.dst]) for r in simhash.fingerprint_links(fps, 3).collect()]
    assert components_brute(range(len(codes)), found) == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5001), (5001, 5000), (7, 7)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(5)).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)} | {5000: 5000, 5001: 5000}
    a, b = forest(np.array([3, 2, 9]), np.array([2, 1, 8]))
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {2: 1, 3: 1, 9: 8}


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 24))
    x = [list(map(float, centres[rng.integers(30)] + rng.normal(size=24) * rng.choice([0.01, 0.2, 0.35]))) for _ in range(400)]
    rows = list(enumerate(x)) + [(400, x[0]), (401, [v * 7 for v in x[0]]), (402, [0.0] * 24), (403, None), (404, []), (405, [None] + x[1][1:]), (406, [float("nan")] + x[1][1:]), (407, [float("inf")] + x[1][1:]), (408, [1.0, 2.0]), (409, [2.0, 4.0])]
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)  # buckets are split
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'l' as label", "1 as m", "2 as v")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df, 0.9).collect()}
    ok = [i for i, v in rows if v and len(v) == 24 and None not in v and np.isfinite(v).all() and any(v)]
    unit = np.array([rows[i][1] for i in ok])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    true, found = near.sum(), sum(got[i].n_links for i in ok)
    assert found <= true and found >= 0.999 * true
    label = components_brute(ok, [(ok[i], ok[j]) for i, j in zip(*np.nonzero(near), strict=True)])
    assert np.mean([got[i].component_id == label[i] for i in ok]) > 0.99
    for i in (402, 403, 404, 405, 406, 407):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[408].n_links, got[409].component_id, got[409].kept) == (1, 408, False)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    u = rng.normal(size=(600, 63))
    v = u + rng.normal(size=u.shape) * 0.4
    u, v = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (u, v))
    mine, other = embedding_dedup.encoded(u, np.arange(600)), embedding_dedup.encoded(v, np.arange(600, 1200))
    guess, least = embedding_dedup.estimate(mine, other, 63, 0.9)
    true = (u * v).sum(axis=1)
    ours, bound = np.diagonal(guess), np.diagonal(least)
    assert abs((ours - true).mean()) < 0.01
    assert (ours >= bound)[true >= 0.9].all()
    # Far pairs are left out by the codes alone.
    assert (guess >= least).mean() < 0.05
    # Again and again the same codes, whatever the batch.
    assert embedding_dedup.encoded(u[5:9], np.arange(5, 9)).equals(mine.iloc[5:9].reset_index(drop=True))


def test_tiny_vectors_are_vectors(spark):
    """Squares of the components underflow; the vectors are not zero."""
    rows = [(1, [1e-170, 2e-170]), (2, [1e-170, 2e-170]), (3, [1.0, 2.0]), (4, [0.0, 0.0]), (5, [0.0, 5e-324])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5)}


def test_links_of_the_table(spark, sf_dir):
    """Recall by link on the embeddings table, for the vectors whose id is divisible by 20."""
    table = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = dict(zip((i for i, _ in rows), ((x @ x.T >= 0.9).sum(axis=1) - 1).tolist(), strict=True))
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(table).collect()}
    asked = [i for i, _ in rows if i % 20 == 0]
    assert all(got[i] <= want[i] for i in want)
    assert sum(got[i] for i in asked) >= 0.999 * sum(want[i] for i in asked)
