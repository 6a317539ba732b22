"""Alignment of two vocabularies, nearest vectors and spelling variants against brute force, with odd input."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxplan.llm import alignment, neighbours, variants

ODD = "doc_id long, text string, lang string, run long, word string, n long, radix int, vec_id long"


def odd_documents(spark, texts):
    rows = [(i, t, "en", 7, "w", 1, 0, 0) for i, t in enumerate(texts)]
    rows += [rows[0], (None, texts[0], None, None, None, None, None, None)]  # a repeated row, and one without an id
    return spark.createDataFrame(rows, ODD).repartition(3)


# Alignment

TEXTS = [
    "The river ran, and ran; the RIVER ran.", None, "", " ", "x", "  two  spaces\n\nand\ttabs ", "naïve über 漢字 🎉 <|endoftext|> <s> </s> <unk>", "already▁marked", "word " * 3000, "z" * 5000,
    "The river ran, and ran; the RIVER ran.", "3.14159 + 2,718 = ?", "\u0000 null byte", "é" * 300,
]


def linked(text):
    """(A ids, B ids, [(end, a, b)]) by the definition, with the tokenizers library for A."""
    import public_tokenizers
    from tokenizers import Tokenizer

    _, a_bytes, encode_b, b_bytes = alignment.vocabularies()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    if not text:
        return [], [], []
    a, b, whole = tokenizer.encode(" " + text, add_special_tokens=False).ids, encode_b(text), (" " + text).encode()
    if b"".join(a_bytes[x] for x in a) != whole or b"".join(b_bytes[x] for x in b) != whole:
        return [], [], []
    ends, at = {}, 0
    for x in a:
        at += len(a_bytes[x])
        ends[at] = x
    out, at = [], 0
    for x in b:
        at += len(b_bytes[x])
        if at in ends:
            out.append((at, ends[at], x))
    return a, b, out


def grouped(ids, sizes, cuts):
    out, at = [[]], 0
    for x in ids:
        out[-1].append(str(x))
        at += sizes[x]
        if at in cuts:
            out.append([])
    return [",".join(g) for g in out[:-1]]


@pytest.mark.parametrize("sizes", [(1 << 21, 64, 64), (50, 3, 2)])
def test_alignment_is_that_of_the_definition(spark, sizes):
    docs = odd_documents(spark, TEXTS)
    run, radices, fanin = sizes
    got = alignment.align(docs, run=run, radices=radices, fanin=fanin).collect()
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    made = [(i, *linked(t)) for i, t in texts]
    counts = collections.Counter((a, b) for _, _, _, links in made for _, a, b in links)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    size_a, size_b = ([len(x) for x in alignment.vocabularies()[k]] for k in (1, 3))
    want = []
    for i, a, b, links in made:
        cuts = {e for e, *_ in links}
        text = ";".join(f"{x}|{y}" for x, y in zip(grouped(a, size_a, cuts), grouped(b, size_b, cuts)))
        of = [counts[x, y] for _, x, y in links]
        want.append((i, len(a), len(b), len(links), len(links), hashlib.sha256(text.encode()).hexdigest() if links else "", sum(n == most[y] for n, (_, _, y) in zip(of, links)), sum(of)))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert sorted((tuple(r[c] for c in names) for r in got), key=str) == sorted(want, key=str)
    assert sum(not w[1] for w in want) >= 3 and got[0].__fields__ == [*names[:6], "n_best", "count_sum"]


def test_pair_counts_and_no_rows(spark):
    docs = odd_documents(spark, TEXTS)
    spilled = alignment.spill(docs, run=50, radices=3)
    rows = alignment.pair_counts(alignment.count_pairs(spilled, fanin=2)).collect()
    counts = collections.Counter((a, b) for r in docs.collect() for _, a, b in linked(r["text"])[2])
    assert {(r["a"], r["b"]): r["links"] for r in rows} == counts and len(rows) == len(counts)
    assert all(r["best"] == (r["links"] == max(n for (_, b), n in counts.items() if b == r["b"])) for r in rows)
    assert alignment.align(docs.limit(0)).count() == 0
    assert [tuple(r)[1:5] for r in alignment.align(docs.where("text is null")).collect()] == [(0, 0, 0, 0)]


@given(st.lists(st.lists(st.tuples(st.integers(0, 1 << 40), st.integers(1, 9)), max_size=20), max_size=6))
@settings(max_examples=50, deadline=None)
def test_heap_merge_adds_up(runs):
    blocks, want = [], collections.Counter()
    for run in runs:
        own = collections.Counter()
        for k, n in run:
            own[k] += n
        want += own
        keys = np.array(sorted(own), np.int64)
        blocks.append(alignment.packed(np.diff(keys, prepend=0), np.array([own[k] for k in keys.tolist()], np.int64)))
    pairs, counts = alignment.merged(blocks)
    assert dict(zip(pairs.tolist(), counts.tolist())) == dict(want) and pairs.tolist() == sorted(want)


# Nearest vectors


def exact(rows, is_query, many):
    """[(query, rank, vec_id, score)] by comparing everything; equal rows count once."""
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and ok(v)})
    out = []
    for own in rows:
        if is_query(own[0]):
            s = sorted((-float((np.array(v) * np.array(own[1])).sum()), i, v) for i, v in rows if (i, v) != own and len(v) == len(own[1]))
            out += [(own[0], k + 1, i, -x) for k, (x, i, _) in enumerate(s[:many])]
    return out


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, "x", 1.0, 2) for i, v in rows], f"vec_id long, embedding array<{kind}>, vector string, score double, rank int").repartition(3)


def test_neighbours_with_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(60)]
    rows += [(i, rows[5][1]) for i in range(100, 160)] + [(i, rows[20][1]) for i in range(200, 230)]  # ties beyond the list
    rows += [(300, None), (320, []), (340, [0.0] * 6), (360, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (380, [float("nan")] * 6), (400, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(500, [1.0, 2.0]), (520, [2.0, 1.0]), (540, [3.0]), rows[0], rows[0], (20, [float(x) for x in range(6)]), (600, [1e3] * 6), (620, [float(np.float32(1e-20))] * 6)]
    got = neighbours.nearest(vectors(spark, rows), lambda i: i % 20 == 0, block=40, chunk=3, sample=50).collect()
    want = exact(rows, lambda i: i % 20 == 0, 20)
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == sorted(w[:3] for w in want)
    np.testing.assert_array_equal(sorted((r["query_id"], r["rank"], r["score"]) for r in got), sorted((w[0], w[1], w[3]) for w in want))
    assert neighbours.nearest(vectors(spark, rows).limit(0), lambda i: i % 20 == 0).count() == 0
    assert neighbours.nearest(vectors(spark, [(40, [1.0])]), lambda i: i % 20 == 0).count() == 0


@pytest.mark.parametrize("shape", ["sphere", "clusters", "lengths"])
def test_neighbours_recall(spark, shape):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 32))
    if shape == "sphere":
        x /= np.linalg.norm(x, axis=1)[:, None]
    elif shape == "clusters":
        x = rng.normal(size=(30, 32))[rng.integers(0, 30, 3000)] * 3 + x * 0.3
    else:
        x *= rng.lognormal(size=3000)[:, None]
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    got = neighbours.nearest(vectors(spark, rows, "double"), lambda i: i % 50 == 0, block=700, sample=500).collect()
    want = {w[:3:2] for w in exact(rows, lambda i: i % 50 == 0, 20)}
    assert len(want) == len(got) == 1200
    assert len({(r["query_id"], r["vec_id"]) for r in got} & want) >= 0.95 * len(want)


def test_a_window_grows_without_counting_twice():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 8))
    index = neighbours.SortedArrays(x, float(np.linalg.norm(x, axis=1).max()))
    centre = neighbours.projections(9) @ np.append(x[0], 0)
    for width in (0.01, 0.2, 1.0, 9.0):
        lo = [int(a.searchsorted(c - width, "left")) for a, c in zip(index.at, centre)]
        hi = [int(a.searchsorted(c + width, "right")) for a, c in zip(index.at, centre)]
        rest = np.sqrt(np.maximum(index.longest**2 - (x * x).sum(axis=1), 0))
        near = np.abs(np.column_stack([x, rest]) @ neighbours.projections(9).T - centre) <= width
        assert (index._met(lo, hi) == near.sum(axis=1)).all()


# Spelling variants


def expected_variants(rows, drop=97):
    seen = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            seen[run if h % drop else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in seen.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        a, b = sorted((a, b), key=len)
        k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k + 1 :]

    out, form = [], {}
    for w in n:
        around = [v for v in n if near(w, v)]
        best = min(around, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
        out.append((w, n[w], len(around)))
    last = lambda w: w if form[w] is None else last(form[w])
    return sorted((w, form[w], last(w), c, k, n[form[w]] if form[w] else None) for w, c, k in out)


def variant_rows(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


@pytest.mark.parametrize("sizes", [(8192, 1024), (2, 1), (3, 2)])
def test_variants_are_those_of_all_pairs(spark, sizes):
    rng = np.random.default_rng(6)
    base = ["stones", "aaaaa", "aaaaaa", "aaaaaaa", "abababab", "Émilie", "émilie", "über×über", "naïveté", "RIVER", "rivers", "shorelines", "x" * 40, "x" * 41, "ÿÿÿÿÿ"]
    words = []
    for _ in range(900):
        w = base[rng.integers(len(base))] if rng.random() < 0.7 else "".join(rng.choice(list("abé"), 5 + rng.integers(3)))
        if rng.random() < 0.4:
            k = int(rng.integers(len(w)))
            w = [w[:k] + w[k + 1 :], w[:k] + "b" + w[k:], w[:k] + "a" + w[k + 1 :]][rng.integers(3)]
        words.append(w)
    texts = [" ".join(words[k : k + 60]) for k in range(0, 900, 60)] + [None, "", "1234 ---", "tiny at so", "日本語 テキスト", "stones" * 2000]
    docs = odd_documents(spark, texts)
    want = expected_variants([(r["doc_id"], r["text"]) for r in docs.collect()], 7)
    assert variant_rows(variants.variants(docs, 7, large=sizes[0], wide=sizes[1])) == want
    assert any(w[1] for w in want) and any(w[1] != w[2] for w in want if w[1])
    assert variants.variants(docs.limit(0)).count() == 0 and variants.variants(docs.where("text is null")).count() == 0


@given(st.sets(st.text("abc", min_size=0, max_size=6), max_size=40))
@settings(max_examples=60, deadline=None)
def test_composition_accepts_the_near_pairs(words):
    words = sorted(words)

    def near(a, b):
        return any(a[:i] + c + a[j:] == b for i in range(len(a) + 1) for j in (i, i + 1) for c in ("", "a", "b", "c") if j <= len(a))

    got = [(x, y) for x, y, _ in variants.near_pairs(words)]
    assert sorted(map(sorted, got)) == sorted([a, b] for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b))


def test_acceptor_is_minimal():
    words = sorted(a + b for a in ("x", "yy", "zab", "zac") for b in ("ing", "ed", "s"))
    machine = variants.Acceptor(words)
    states, todo = set(), [0]
    while todo:
        s = todo.pop()
        if s not in states:
            states.add(s)
            todo += machine.edges[s].values()
    rights = {}

    def right(s):
        if s not in rights:
            rights[s] = frozenset([""] * machine.final[s] + [c + r for c, t in machine.edges[s].items() for r in right(t)])
        return rights[s]

    assert right(0) == set(words) and len({right(s) for s in states}) == len(states)
