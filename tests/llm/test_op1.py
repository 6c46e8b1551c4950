import random

from brassloom.llm.op1_langid import fit, predict, train

EN, DE = "the quick and lazy house with thing that", "der schnelle und faule haus mit das nicht"


def _texts(n=120, seed=3):
    r = random.Random(seed)
    return [(" ".join(r.choice((EN, DE)[k % 2].split()) for _ in range(12)), ("en", "de")[k % 2]) for k in range(n)]


def test_held_out_accuracy_and_calibration():
    model = train(*map(list, zip(*_texts())))
    found = [(model.predict(t), lang) for t, lang in _texts(seed=9)]
    assert sum(p[0] == lang for p, lang in found) >= 0.98 * len(found)
    assert all(0 <= p[1] <= 1 for p, _ in found) and 0 <= model.accept <= 1


def test_edge_cases(docs, edge):
    model = fit(docs([(i, t, lang, "s") for i, (t, lang) in enumerate(_texts(40))]))
    rows = predict(edge, model).collect()
    assert len(rows) == 8
    for r in rows:
        assert (r.lang_pred == "und") == (r.doc_id in (1, 2, 3)) and r.n == "x"
    assert predict(edge.limit(0), model).collect() == []
    assert {r.lang_pred for r in predict(edge, fit(docs([]))).collect()} == {"und"}


def test_slices_give_the_same_answer(monkeypatch):
    from brassloom.llm import op1_langid

    model = train(*map(list, zip(*_texts())))
    text = _texts(1)[0][0] * 5
    whole = model.predict(text)
    monkeypatch.setattr(op1_langid, "SLICE", 37)
    assert model.predict(text)[0] == whole[0] and abs(model.predict(text)[1] - whole[1]) < 0.05


def test_rare_languages_are_learned(docs):
    rows = [(i, t, "en", "s") for i, (t, lang) in enumerate(_texts(1600)) if lang == "en"] + [(5000 + i, t, "de", "s") for i, (t, lang) in enumerate(_texts(60, 5)) if lang == "de"]
    model = fit(docs(rows), sample=120)
    assert model.langs == ["de", "en"]
    assert sum(model.predict(t)[0] == lang for t, lang in _texts(seed=9)) >= 110


def test_average_of_embeddings_is_what_votes_give():
    import numpy as np

    from brassloom.llm.op1_langid import grams

    model = train(*map(list, zip(*_texts())))
    text = _texts(1)[0][0]
    ids = np.concatenate([*grams(text)])
    want = np.mean([model.votes[i] for i in ids.tolist()], axis=0) + model.bias
    assert np.allclose(model.logits(text), want)
    # words of two letters: each letter with its ends, and the pairs and triples over them
    assert len(np.concatenate([*grams("ab")])) == len(np.concatenate([*grams("  ab ")]))


def test_labelled_rows_without_ids_are_drawn_by_their_texts(docs):
    rows = [(None, t, lang, "s") for t, lang in _texts(800)] + [(None, "the same text of a row that is repeated", "en", "s")] * 400
    model = fit(docs(rows), sample=100)
    assert model.langs == ["de", "en"]
    assert sum(model.predict(t)[0] == lang for t, lang in _texts(seed=9)) >= 115
