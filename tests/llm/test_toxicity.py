"""Automata against plain edit distance, and scores on planted, misspelt and quoted terms."""

import random
import zlib

import numpy as np
import pytest

from siteindex.llm import toxicity
from siteindex.llm.toxicity import Automaton, Words

TERMS = ["loser", "lose", "idiot", "scum", "bad", "worthless", "disgusting", "disgustful", "été"]


def edits(a, b):
    """Insertions, deletions, replacements and swaps of neighbours, each place edited once."""
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    d[:, 0], d[0] = range(len(a) + 1), range(len(b) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return int(d[-1, -1])


@pytest.mark.parametrize("states", [toxicity.STATES, 3])
def test_automaton(monkeypatch, states):
    monkeypatch.setattr(toxicity, "STATES", states)
    automaton = Automaton(TERMS)
    rng = random.Random(3)
    said = list(TERMS)
    for _ in range(3000):
        word = list(rng.choice(TERMS))
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(word) + 1)
            kind = rng.randrange(4)
            if kind == 0:
                word.insert(at, rng.choice("abdiloé7"))
            elif kind == 1 and at < len(word):
                del word[at]
            elif kind == 2 and at < len(word):
                word[at] = rng.choice("abdiloé7")
            elif at + 1 < len(word):
                word[at], word[at + 1] = word[at + 1], word[at]
        said.append("".join(word) or "x")
    for part in (said[:1500], said[1500:]):
        words = Words([" ".join(part)])
        assert [words.text(i) for i in range(len(part))] == part
        got = dict(zip(*(x.tolist() for x in automaton.match(words)[:1]),
                       zip(*(x.tolist() for x in automaton.match(words)[1:]), strict=True), strict=True))
        for i, word in enumerate(part):
            near = [(edits(word, t), n) for n, t in enumerate(TERMS)
                    if edits(word, t) <= automaton.allowed[n]]
            best = min(near)[::-1] if near else None
            assert got.get(i) == best, word


def test_words_and_quotation():
    text = 'He said "you IDIOT, m*ron***" $tupid...\n> quoted line\nplain "open idiot\n«été» no7 7'
    words = Words([None, text, "", "last"])
    said = [words.text(i) for i in range(len(words.starts))]
    assert said == ["he", "said", "you", "idiot", "m*ron", "$tupid", "quoted", "line", "plain",
                    "open", "idiot", "été", "no7", "7", "last"]
    assert words.doc.tolist() == [1] * 14 + [3]
    quoted = words.quoted(np.arange(len(said)))
    assert [w for w, q in zip(said, quoted, strict=True) if q] == [
        "you", "idiot", "m*ron", "quoted", "line", "été"]


def planted(n, seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choices("bcdfgkmpvz", k=5)) for _ in range(400)]
    bad = ["idiot", "scum", "worthless", "moron", "loser"]
    rows = []
    for i in range(n):
        text = rng.choices(pool, k=60)
        kind = i % 5
        if kind == 0:
            for _ in range(3):
                text.insert(rng.randrange(60), rng.choice(bad))
        if kind == 1:
            text.insert(30, f'they "said {rng.choice(bad)}" once')
        rows.append((i, " ".join(text), int(kind == 0)))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rows = planted(600, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    return toxicity.fit(docs, labels)


def test_learned_terms_and_scores(model):
    assert set(model.terms) >= {"idiot", "scum", "worthless", "moron", "loser"}
    scorer = toxicity.Scorer(model)
    other = planted(300, 2)
    scores = scorer.scores([t for _, t, _ in other])
    assert all((s >= toxicity.THRESHOLD) == bool(y) for s, (*_, y) in zip(scores, other, strict=True))
    clean = "bcdfg kmpvz zbcdf " * 20
    misspelt = scorer.scores([clean + " idoit " + clean + " scuum worthles", clean + "m0ron, l*ser idi0t"])
    assert (misspelt >= toxicity.THRESHOLD).all()
    quoted = scorer.scores([clean + '\nthey "said idiot" once\n' + clean, clean, None, ""])
    assert (quoted < toxicity.THRESHOLD).all()
    assert scorer.scores([clean * 30_000 + " idiot scum worthless moron loser"])[0] > scorer.scores([None])[0]


def test_score_column(spark, model, documents):
    rows = [(1, None), (None, "you idiot, worthless scum"), (2, ""), (1, "loser moron idiot"), (3, "fine")]
    docs = documents(rows)
    got = docs.select("doc_id", toxicity.score(docs, model).alias("p")).collect()
    want = toxicity.Scorer(model).scores([t for _, t in rows])
    assert [r.p for r in got] == pytest.approx(want.tolist())
    assert [r.p >= toxicity.THRESHOLD for r in got] == [False, True, False, True, False]
    assert docs.where("false").select(toxicity.score(docs, model)).collect() == []


def test_only_labelled_rows_outside_the_fold_are_learned(spark):
    rows = planted(200, 4)
    out = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    docs = spark.createDataFrame([(i, t, 0) for i, t, _ in rows] + [(5, "x", 0)] * 3,
                                 "doc_id long, text string, toxic int")
    shape = "doc_id long, toxic int"
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7, None)], shape)
    turned = spark.createDataFrame([(i, 1 - y if i in out else y) for i, _, y in rows], shape)
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert a.terms == b.terms and (a.layer == b.layer).all() and a.forms == b.forms
    assert {r.doc_id for r in docs.where(toxicity.held_out()).collect()} == out


def test_without_labels(spark, documents):
    docs = documents([(1, "idiot"), (2, None)])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert [r[0] for r in docs.select(toxicity.score(docs, model)).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert toxicity.Scorer(toxicity.fit(docs, one)).scores(["idiot"])[0] < toxicity.THRESHOLD
