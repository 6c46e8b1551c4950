import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from brassloom.llm import op11_ranked
from brassloom.llm.op11_ranked import Best, Documents, Items, ranked, search, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _brute(docs, items, k):
    bags = [(i, Counter(_terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, length, df = len(bags), sum(sum(b.values()) for _, b in bags), Counter(w for _, b in bags for w in b)
    out = []
    for item, text in set(items):
        scored = []
        for i, b in bags:
            m = 75 + (25 * sum(b.values()) * n) // length
            s = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * b[w] // (1000 * b[w] + 12 * m)) for w, c in Counter(_terms(text)).items() if w in b)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return Counter(out)


def _got(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize(("rows", "cells", "entries"), [(7, 300, 60), (1024, 2_000_000, 500_000)])
def test_against_brute_force_with_small_chunks_and_slices(spark, docs, monkeypatch, rows, cells, entries):
    for name, value in (("ROWS", rows), ("CELLS", cells), ("ENTRIES", entries)):
        monkeypatch.setattr(op11_ranked, name, value)
    r = random.Random(3)
    words = ["the", "of", "É", "naïve", "x1", *(f"w{k}" for k in range(60))]
    text = lambda n: " ".join(r.choice(words[: r.choice((5, 20, 65))]) for _ in range(n))
    given = [(k, text(r.randint(1, 60))) for k in range(220)]
    given += [(k, given[k % 9][1]) for k in range(300, 360)] + [(None, given[0][1])] * 3 + [given[1]] * 4
    items = [(k, text(r.randint(1, 12))) for k in range(25)] + [(30, given[0][1]), (31, "the the the w1"), (30, "w1 w2"), (31, "the the the w1"), (32, "unknown"), (33, None), (34, " ,.")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = ranked(docs([(i, t, "en", "a") for i, t in given]), asked, 5)
    assert _got(found) == _brute(given, items, 5)


def test_terms_are_the_pattern():
    r = random.Random(1)
    for _ in range(300):
        text = "".join(chr(r.choice((r.randrange(128), r.randrange(0x80, 0x3000), 0xA0, 0x2003, 0x130, 0x212A))) for _ in range(40))
        assert [t.decode() for t in terms(text)] == _terms(text)


def test_bounds_exclude_whole_batches():
    r = np.random.default_rng(5)
    items = Items([(np.arange(10 * k, 10 * k + 10), np.full(10, 100, np.int64)) for k in range(16)])
    ids = list(range(512))
    counts = np.full(512, 10, np.uint8)
    at = np.concatenate([np.sort(r.choice(np.arange(10 * (d // 32), 10 * (d // 32) + 10), 10, replace=False)) for d in ids]).astype(np.uint8)
    row = {"ids": ids, "entries": len(at), "totals": np.full(512, 10, np.uint8).tobytes(), "counts": counts.tobytes(), "terms": at.tobytes(), "tfs": np.ones(len(at), np.uint8).tobytes()}
    docs = Documents(row, 512, 5120, items)
    looked = []

    class Counted(Best):
        def add(self, item, null, ids, scores):
            looked.append(len(ids))
            super().add(item, null, ids, scores)

    best = Counted(np.zeros(16, np.int64), 5)
    search(items, docs, best)
    assert sum(looked) == 512 and len(best.found) == 16  # of 16 * 512 pairs
    assert all(sorted(best.found[k][1]) == list(range(32 * k, 32 * k + 5)) for k in range(16))


def test_edge_cases(edge, spark, docs):
    asked = spark.createDataFrame([(0, "one word", 1, 2), (1, "a b no", 3, 4)], "item_id long, text string, rank int, doc_id int")
    given = [(r.doc_id, r.text) for r in edge.collect()]
    assert _got(ranked(edge, asked)) == _brute(given, [(0, "one word"), (1, "a b no")], 20)
    assert ranked(edge.limit(0), asked).collect() == [] and ranked(edge, asked.limit(0)).collect() == []
    assert ranked(docs([(1, None, "en", "a"), (2, "", "en", "a")]), asked).collect() == []
