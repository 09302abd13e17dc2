"""Repeated strings, aligned tokenizers and the filter audit against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest

from vigilframe.llm import filter_audit, queries, suffix_dedup, token_alignment

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeats_brute(texts, length):
    """(spans, kept) of each text by comparing all strings as they are."""
    whole = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in whole for i in range(len(b) - length + 1))
    out = []
    for b in whole:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0]))
        out.append((list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)), np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


def repeats(docs, length):
    rows = suffix_dedup.repeated_strings(docs, length).collect()
    return sorted(((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in rows), key=repr)


def check_repeats(make_docs, rows, length):
    want = [(r[0], len((r[1] or "").encode()), spans, kept) for r, (spans, kept) in zip(rows, repeats_brute([r[1] for r in rows], length), strict=True)]
    assert repeats(make_docs(rows), length) == sorted(want, key=repr)


def _woven(rng, alphabet, n, passages):
    """Texts of random letters with shared passages, cut at random places, and repeats inside a text."""
    shared = ["".join(rng.choices(alphabet, k=rng.randrange(20, 90))) for _ in range(passages)]
    rows = []
    for i in range(n):
        parts = ["".join(rng.choices(alphabet, k=rng.randrange(0, 60))) for _ in range(rng.randrange(1, 5))]
        for p in rng.choices(shared, k=rng.randrange(0, 4)):
            at = rng.randrange(0, len(p) // 2)
            parts.insert(rng.randrange(0, len(parts)), p[at : at + rng.randrange(5, len(p))] * rng.choice([1, 1, 2]))
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize(("alphabet", "length", "seed"), [("abcdefgh", 20, 1), ("ab", 16, 2), ("aé\n ", 33, 3), ("abc", 4, 4)])
def test_repeated_strings(make_docs, alphabet, length, seed):
    rng = random.Random(seed)
    rows = _woven(rng, alphabet, 120, 6)
    rows += [(500 + i, rows[5][1]) for i in range(4)] + [(600, None), (601, ""), (None, rows[7][1]), (None, None), (7, rows[7][1]), (602, alphabet[0] * 300), (603, "xyz" * 80)]
    check_repeats(make_docs, rows, length)


def test_repeated_strings_across_blocks(make_docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 50)
    monkeypatch.setattr(suffix_dedup, "_powers", {})
    for x, y in zip(suffix_dedup.anchors(b := np.frombuffer(b"abracadabra, the cat sat on the mat; " * 9 + b"z" * 90, np.uint8), 24), ([], [], [], []), strict=True):
        y.append(x.tolist())
    cut = suffix_dedup.anchors(b, 24)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1 << 18)
    monkeypatch.setattr(suffix_dedup, "_powers", {})
    assert all((x == y).all() for x, y in zip(cut, suffix_dedup.anchors(b, 24), strict=True))
    at, first, last, _ = cut
    assert first[0] == 0 and (first[1:] == last[:-1] + 1).all() and last[-1] == len(b) - 24
    assert ((at >= last) & (at <= first + 12)).all()


def test_repeated_strings_odd_input(make_docs, odd):
    check_repeats(make_docs, odd, 12)
    assert suffix_dedup.repeated_strings(make_docs([])).count() == 0
    assert suffix_dedup.repeated_strings(make_docs(odd)).columns == ["doc_id", "n_bytes", "spans", "kept"]
    with pytest.raises(ValueError):
        suffix_dedup.repeated_strings(make_docs(odd), length=2)


def test_op11_equals_brute_force(spark, sf_dir, documents):
    docs = documents.select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op11_suffix_dedup(spark, sf_dir).collect()}
    for r, (spans, kept) in zip(docs, repeats_brute([r.text for r in docs], 400), strict=True):
        size = len((r.text or "").encode())
        assert got[r.doc_id] == (size, size - len(kept), len(spans), hashlib.sha256(kept).hexdigest())


def test_op11_planted_passages(spark, make_docs, tmp_path):
    """A passage of over 50 words goes from both documents if it has 400 bytes; n_bytes is the size of the input either way."""
    rng = random.Random(11)
    some = lambda n, size, letters="abcdefgh": " ".join("".join(rng.choices(letters, k=size)) for _ in range(n))
    passages = [some(60, 7), some(52, 6, "éèàç"), some(55, 5), ""]
    assert [len(p.split()) > 50 for p in passages] == [True, True, True, False] and [len(p.encode()) >= 400 for p in passages] == [True, True, False, False]
    rows, want = [], {}
    for i in range(8):
        # Digits of their own, so that no two documents agree right beside a passage.
        before, passage, after = f"{some(90, 6)} {i}", passages[i // 2], f"{i} {some(90, 6)}"
        text, size = before + passage + after, len(passage.encode()) if i < 4 else 0
        rows.append((i, text))
        want[i] = (len(text.encode()), size, int(size > 0), hashlib.sha256((before + after if size else text).encode()).hexdigest())
    make_docs(rows, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op11_suffix_dedup(spark, str(tmp_path)).collect()} == want


def align_brute(texts):
    """The contract's columns from whole texts, by offsets alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    side_a = Tokenizer.from_file(A_PATH)
    side_a.encode_special_tokens = True
    side_b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    docs, holds = [], Counter()
    for t in texts:
        a = side_a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = side_b.encode(t) if t else []
        bytes_a = [bytes(byte[c] for c in side_a.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if side_b.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [side_b.id_to_piece(i)]]
        if not t or b"".join(bytes_a) != (" " + t).encode() or b"".join(bytes_b) != (" " + t).encode():
            docs.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
        both = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        groups, lo = [], 0
        for end in both:
            groups.append(",".join(str(i) for i, e in zip(a, ends_a, strict=True) if lo < e <= end) + "|" + ",".join(str(i) for i, e in zip(b, ends_b, strict=True) if lo < e <= end))
            lo = end
        links = [(x, y) for x, ex, lx in zip(a, ends_a, map(len, bytes_a), strict=True) for y, ey, ly in zip(b, ends_b, map(len, bytes_b), strict=True) if ex - lx < ey and ey - ly < ex]
        holds.update(set(links))
        docs.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = defaultdict(int)
    for (x, _), n in holds.items():
        most[x] = max(most[x], n)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else (*d[:3], len(d[3]), sum(holds[p] == most[p[0]] for p in d[3]), sum(holds[p] for p in d[3]), d[4]) for d in docs]


HARD = [
    "the cat sat on the mat", "the cat sat on a mat", "Ünïcode — naïve café 東京タワー 🙂🙂", "two  spaces\tand\n\nlines \r\n end ", " leading", "<|endoftext|> and </s> <s> are text <0x0A>", "a▁b", " 　 odd spaces x", "1234567890 12,345.67 e=mc²",
    "x" * 700, "aб" * 90, "\x00\x01 control", "don't can't I'LL", "|" * 40 + " " + "--- " * 9, None, "", " ", "\n",
]


@pytest.mark.parametrize("head", [token_alignment.HEAD, 7])
def test_alignment(make_docs, head):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(None, HARD[2]), (3, HARD[3])]
    got = token_alignment.align_tokenizers(make_docs(rows), A_PATH, B_PATH, head=head).collect()
    want = [(r[0], *x) for r, x in zip(rows, align_brute([r[1] for r in rows]), strict=True)]
    assert sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got), key=repr) == sorted(want, key=repr)
    assert sum(w[1] > 0 for w in want) >= 15


def test_alignment_of_documents(spark, sf_dir, documents, monkeypatch):
    docs = documents.select("doc_id", "text").orderBy("n_chars").limit(150).collect()
    want = {r.doc_id: x for r, x in zip(docs, align_brute([r.text for r in docs]), strict=True)}
    some = spark.createDataFrame(docs, "doc_id long, text string")
    got = token_alignment.align_tokenizers(some, A_PATH, B_PATH).collect()
    assert {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got} == want


def test_alignment_odd_input(make_docs, odd):
    assert token_alignment.align_tokenizers(make_docs([]), A_PATH, B_PATH).count() == 0
    assert token_alignment.align_tokenizers(make_docs(odd), A_PATH, B_PATH).count() == len(odd)


def test_transducer_remembers_and_forgets(monkeypatch):
    t = token_alignment.Transducer({0: b"ab", 1: b"c", 2: b"abc"}, {0: b"a", 1: b"bc", 2: b"b"})
    assert t.align([0, 1], [0, 1]) == ([([0, 1], [0, 1])], [(0, 0), (0, 1), (1, 1)])
    assert t.align([2, 0], [0, 1, 0, 2]) == ([([2], [0, 1]), ([0], [0, 2])], [(2, 0), (2, 1), (0, 0), (0, 2)])
    assert t.align([0], [0]) is None and t.align([1], [0]) is None and t.align([], []) == ([], [])
    monkeypatch.setattr(token_alignment, "STEPS", 1)
    assert t.align([0, 1], [0, 1])[0] == [([0, 1], [0, 1])]


def test_words_are_forgotten_by_halves(monkeypatch):
    tool = token_alignment.aligner(A_PATH, B_PATH)
    before = tool.words(["one two three", "four"])
    monkeypatch.setattr(token_alignment, "WORDS", 2)
    for texts in (["five six"], ["one two three", "four"]):
        again = tool.words(texts)
    assert again == before and len(tool.young) <= 8


def audit_brute(rows, labels):
    """The contract by applying the filters one after another."""
    def fails(i, text):
        words = WORD.findall(text)
        out = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
        return out | {"E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in rows)}

    failed = [(r[2] or "", fails(r[0], r[1] or ""), labels.get(r[0], (0, 0))) for r in rows]
    out = {}
    for part in {f[0] for f in failed}:
        for order in permutations("ABCDE"):
            left = [f for f in failed if f[0] == part]
            for step, name in enumerate(order, 1):
                gone, stay = [f for f in left if f[1][name]], [f for f in left if not f[1][name]]
                all_ = [f for f in failed if f[0] == part and f[1][name]]
                out[part, "".join(order), step] = [len(stay), len(gone), len(all_) - len(gone), sum(sum(f[1].values()) == 1 for f in all_), sum(f[2][0] == 1 for f in gone), sum(f[2][1] == 1 for f in gone)]
                left = stay
    total = Counter()
    for (part, order, step), v in out.items():
        total[part, order[step - 1]] += v[1]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(spark, make_docs, odd):
    rng = random.Random(8)
    rows = [(i, t, "a") for i, t in odd]
    for i in range(400):
        words = rng.choices(["w%d" % k for k in range(rng.choice([5, 40, 400]))], k=rng.randrange(30, 90)) + ["CAPITALS"] * rng.choice([0, 0, 9]) + rng.choice([[], [], ["|"]])
        rows.append((100 + i, rng.choice([" ", "\n", "\x0b"]).join(words) if rng.random() < 0.8 else rows[rng.randrange(len(rows))][1], rng.choice(["a", "b", "", None, "hot", "hot", "hot"])))
    labels = {i: (rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 500, 2)}
    table = spark.createDataFrame([(i, *v, "x") for i, v in labels.items()] + [(None, 1, 1, "x")], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.audit_documents(make_docs(rows), table).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in filter_audit.COUNTS) for r in got} == audit_brute(rows, labels)
    assert len(got) == 4 * 600
    assert filter_audit.audit_documents(make_docs([]), table).count() == 0
    assert filter_audit.audit_documents(make_docs(rows), table.limit(0)).count() == 4 * 600


def test_outcome_matrices():
    m = filter_audit.outcome_matrices(5)
    assert all(x.shape == (32, 600) and x.dtype == np.int64 and set(np.unique(x)) == {0, 1} for x in m.values())
    # Every document that fails a filter is removed once in each order.
    assert (m["removed"].reshape(32, 120, 5).sum(axis=2)[1:] == 1).all() and not m["removed"][0].any()
    with pytest.raises(ValueError):
        filter_audit.audit(None, "AA")
