import random
from collections import defaultdict

import pytest

from brassloom.llm import op8_jaccard
from brassloom.llm.op8_jaccard import jaccard_components


def _brute(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset([tuple(w[k : k + size]) for k in range(len(w) - size + 1)] or ([tuple(w)] if w else []))
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    at = defaultdict(set)
    for i, s in sets.items():
        for g in s:
            at[g].add(i)
    for i, s in sets.items():
        for j in {j for g in s for j in at[g] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def _near_copies(seed, n=150):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(60))
    texts = []
    for k in range(n):
        if texts and r.random() < 0.6:
            w = r.choice(texts).split()
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = word()
            texts.append(" ".join(w).upper() if r.random() < 0.1 else " ".join(w))
        else:
            texts.append(" ".join(word() for _ in range(r.choice((1, 2, 3, 9, 10, 11, 30, 90, 200)))) + (" " + passage if r.random() < 0.5 else ""))
    return list(enumerate(texts))


@pytest.mark.parametrize(("size", "percent", "chunk", "common"), [(3, 90, 512, 3), (5, 80, 512, 3), (3, 90, 8, 2), (5, 80, 8, 10_000)])
def test_against_brute_force(docs, monkeypatch, size, percent, chunk, common):
    monkeypatch.setattr(op8_jaccard, "CHUNK", chunk)
    monkeypatch.setattr(op8_jaccard, "COMMON", common)
    rows = _near_copies(size * percent + chunk)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs([(i, t, "en", "s") for i, t in rows]), size, percent).collect()}
    assert got == _brute(rows, size, percent)


def test_links_run_through_rows_without_a_doc_id(docs, spark):
    base = [f"w{k}" for k in range(60)]
    one, middle, other = " ".join(base), " ".join(base[:-1] + ["x"]), " ".join(["y"] + base[1:-1] + ["x"])
    far = " ".join(f"v{k}" for k in range(60))
    rows = [(1, one), (None, middle), (9, other), (None, far), (None, far), (None, far + " z"), (4, "alone here now")]
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_components(docs([(i, t, "en", "s") for i, t in rows])).collect()), key=str)
    assert got == sorted([(1, 1), (None, 1), (9, 1), (None, None), (None, None), (None, None), (4, 4)], key=str)


def test_repeated_ids_with_other_texts(docs):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(1, base), (1, "something else entirely stands here"), (2, base), (2, base), (3, "something else entirely stands here")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs([(i, t, "en", "s") for i, t in rows])).collect())
    assert got == [(1, 3, 1), (1, 58, 1), (2, 58, 1), (2, 58, 1), (3, 3, 1)]


def test_joins_by_shuffle_agree(docs, monkeypatch):
    monkeypatch.setattr(op8_jaccard, "FEW_IDS", 0)
    rows = _near_copies(17, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs([(i, t, "en", "s") for i, t in rows])).collect()}
    assert got == _brute(rows, 3, 90)


def test_edge_cases(edge):
    rows = jaccard_components(edge).collect()
    assert len(rows) == 8
    by = {r.doc_id: r for r in rows}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and [by[i].component_id for i in (1, 2, 3)] == [1, 2, 3]
    assert by[4].n_shingles == 1 and by[5].n_shingles == 1 and by[None].n_shingles == 3
    assert jaccard_components(edge.limit(0)).collect() == []


def _quoting(n, seed=5):
    """Texts of passages that many others quote, few of which link: they chain into one cluster."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passages = [" ".join(word() for _ in range(20)) for _ in range(n // 4)]
    texts = [" ".join([*r.sample(passages, 3), *(word() for _ in range(r.choice((0, 5, 40))))]) for _ in range(n)]
    for k in range(0, n, 10):
        w = r.choice(texts).split()
        w[r.randrange(len(w))] = word()
        texts[k] = " ".join(w)
    return list(enumerate(texts))


def test_meetings_grow_with_the_sets(docs, monkeypatch):
    """Chunks of a cluster that quotes chain together don't all meet, and no link is lost."""
    meets, write = [], op8_jaccard.save

    def save(df, name, *a):
        out = write(df, name, *a)
        if name == "jaccard-meets":
            meets.append(out.count())
        return out

    monkeypatch.setattr(op8_jaccard, "save", save)
    monkeypatch.setattr(op8_jaccard, "CHUNK", 8)
    monkeypatch.setattr(op8_jaccard, "COMMON", 10_000)
    rows = _quoting(400)
    for kept in (op8_jaccard.KEPT, 50):
        monkeypatch.setattr(op8_jaccard, "KEPT", kept)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs([(i, t, "en", "s") for i, t in rows]), 5, 80).collect()}
        want = _brute(rows, 5, 80)
        assert got == want and any(i != c for i, (_, c) in want.items())
    assert len(meets) == 2 and max(meets) < 200, meets
