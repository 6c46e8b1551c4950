import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from brassloom.llm import op13_variants
from brassloom.llm.op13_variants import Grams, runs, variants, words


def _near(found):
    """All pairs, by the words that a replaced or deleted letter leaves."""
    rest, out = defaultdict(set), defaultdict(set)
    for w in found:
        for k in range(len(w)):
            less = w[:k] + w[k + 1 :]
            rest[less, k].add(w)
            if less in found:
                out[w].add(less)
                out[less].add(w)
    for group in rest.values():
        for w in group:
            out[w] |= group - {w}
    return out


def _brute(found):
    near, form, out = _near(found), {}, {}
    for w, n in found.items():
        best = min(near[w], key=lambda x: (-found[x], x), default=None)
        if best is not None and found[best] >= 2 * n:
            form[w] = best
    for w, n in found.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), found[form[w]] if w in form else None)
    return out


def _got(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def _vocabulary(r, n, letters="abcdeé", longest=16):
    base = ["".join(r.choice(letters) for _ in range(r.randint(5, longest))) for _ in range(n // 4)]
    out = set(base)
    while len(out) < n:
        w = r.choice(base)
        for _ in range(r.randint(1, 2)):
            k = r.randrange(len(w))
            w = r.choice((w[:k] + w[k + 1 :], w[:k] + r.choice(letters) + w[k:], w[:k] + r.choice(letters) + w[k + 1 :]))
        if len(w) >= 5:
            out.add(w)
    return {w: r.choice((3, 5, 9, 20, 100)) for w in out}


@pytest.mark.parametrize(("frequent", "long", "letters"), [(1, 1000, "abcdeé"), (5, 8, "abc"), (40, 3, "ab"), (10**6, 1000, "abcdeé")])
def test_against_brute_force(spark, monkeypatch, frequent, long, letters):
    monkeypatch.setattr(op13_variants, "FREQUENT", frequent)
    monkeypatch.setattr(op13_variants, "SHARE", 0.0)
    monkeypatch.setattr(op13_variants, "LONG", long)
    monkeypatch.setattr(op13_variants, "CELLS", 500)
    found = _vocabulary(random.Random(frequent), 700, letters) | {"x" * k: k for k in (5, 6, 7, 300, 301)} | {"stem" + c + "aaaaaa": 4 for c in "abcdefghijklmnop"}
    df = spark.createDataFrame(list(found.items()), "word string, n long").repartition(5)
    assert _got(variants(df)) == _brute(found)


def test_an_edit_affects_no_more_grams_than_stated():
    """Every edit of one letter leaves at least so many grams at the same place from the left or the right."""
    r = random.Random(4)
    for trial in range(150):
        letters = r.choice(("ab", "abc", "abcdef"))
        texts = ["".join(r.choice(letters) for _ in range(r.randint(5, 14))) for _ in range(40)]
        counts = Counter(t[p : p + q] for t in texts for q in range(2, 6) for p in range(len(t) - q + 1))
        grams = Grams({g: n for g, n in counts.items() if n > r.choice((1, 3, 8, 30)) and all(counts[g[:k]] > 3 for k in range(2, len(g)))})
        grams.frequent = {g: n for g, n in grams.frequent.items() if all(g[:k] in grams.frequent for k in range(2, len(g)))}
        grams = Grams(grams.frequent)
        w = r.choice(texts)
        for c in (len(w), len(w) - 1):
            cap = max(2, c // 2)
            mine = grams.of(w, cap)
            least = len(mine) - grams.affected(w, cap, mine)
            for k in range(len(w) + 1):
                others = [w[:k] + x + w[k:] for x in letters] if c == len(w) else []
                if k < len(w):
                    others += [w[:k] + x + w[k + 1 :] for x in letters] + [w[:k] + w[k + 1 :]]
                for o in others:
                    theirs = {(o[p:e], p) for p, e in grams.of(o, cap)} | {(o[p:e], p - len(o)) for p, e in grams.of(o, cap)}
                    same = sum((w[p:e], p) in theirs and p <= k or (w[p:e], p - len(w)) in theirs and p >= k for p, e in mine)
                    assert same >= least, (w, o, cap)


RUN = re.compile("[A-Za-zÀ-ÿ]+")


def _count(docs):
    out = Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            out[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def test_words_of_documents_with_damage(docs, monkeypatch):
    monkeypatch.setattr(op13_variants, "FLUSH", 50)
    r = random.Random(6)
    some = ["naïveté", "Straße", "x÷y×zab", "ÀÉÎÕÜ", "œuvre", "WORDS", "wordsmith", "中文abcdef", "letter's", "hyphen-ated", *("".join(r.choice("aeioulnr") for _ in range(r.randint(4, 8))) for _ in range(150))]
    given = [(k if k % 7 else None, " ".join(r.choice(some) for _ in range(r.randint(1, 80)))) for k in range(300)]
    given += given[5:9] * 2
    found = words(docs([(i, t, "en", "a") for i, t in given]), damage=True)
    want = _count(given)
    assert {x.word: x.n for x in found.collect()} == want and len(want) > 100
    assert _got(variants(found)) == _brute(want)


def test_runs_are_the_pattern():
    r = random.Random(1)
    for _ in range(300):
        text = "".join(chr(r.choice((r.randrange(256), r.randrange(0x3000), 0x130, 0x17F, 0x1E9E))) for _ in range(50))
        assert [x.decode("latin-1") for x in runs(text)] == [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in RUN.findall(text)]


def test_edge_cases(edge, docs):
    given = [(x.doc_id, x.text) for x in edge.collect()] + [(9, "again again again agian agian agian")] * 2
    df = edge.unionByName(docs([(i, t, "en", "a") for i, t in given[-2:]]))
    found = words(df, damage=True)
    assert {x.word: x.n for x in found.collect()} == _count(given)
    assert _got(variants(found)) == _brute(_count(given))
    assert words(edge.limit(0)).collect() == [] and variants(words(edge.limit(0))).collect() == []
