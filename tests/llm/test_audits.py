"""The divergence audit and the prefix trie against brute force."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from siteindex.llm import divergence, prefix_trie, words

ODD = [None, "", " ", "1 2 3", "É é ÉTÉ été", "aA aa AA", "a" * 40, "x" * 8, "x" * 9, "日本 語"]


def terms(text):
    found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in found]


@pytest.mark.parametrize("small", [words.SMALL, 16])
def test_pointers_are_sorted(monkeypatch, small):
    monkeypatch.setattr(words, "SMALL", small)
    rng = random.Random(4)
    pool = ["the"] * 20 + ["".join(rng.choices("abé", k=rng.randint(1, 20))) for _ in range(300)]
    pool += ["common" * 3, "common" * 3 + "x", "common" * 4]
    rows = [" ".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(80)] + ["", "end"]
    data, ends = words.buffer_of(pa.array(["skipped", *rows]).slice(1))
    starts, lengths, row = words.word_pointers(data, ends)
    pointers = words.PointerSort(data, starts, lengths)
    at, new = pointers.sorted()
    found = [(w.encode(), int(r)) for w, r in zip(pointers.texts(at).to_pylist(), row[at], strict=True)]
    assert found == sorted((w.encode(), n) for n, t in enumerate(rows) for w in t.split())
    runs = [i for i, (w, _) in enumerate(found) if i == 0 or found[i - 1][0] != w]
    assert np.flatnonzero(new).tolist() == runs


def audit_truth(rows, min_docs=3, top=200):
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in ((x or "", y or "", z) for x, y, z in rows):
        held[lang].update(set(terms(text)))
        counts[lang, source].update(terms(text))
    out = []
    for lang, of in held.items():
        kept = {t for t, n in of.items() if n >= min_docs}
        mine = {s: c for (x, s), c in counts.items() if x == lang}
        total = {s: sum(c[t] for t in kept) for s, c in mine.items()}
        whole = Counter()
        for c in mine.values():
            whole.update(c)
        share = lambda n, of_all: 1 + 10**9 * (n + 1) // (of_all + len(kept))  # noqa: B023, E731
        for s, c in mine.items():
            p = {t: share(c[t], total[s]) for t in kept}
            pair, term = [], []
            for o, d in mine.items():
                if o != s:
                    q = {t: share(d[t], total[o]) for t in kept}
                    pair.append((o, sum((p[t] - q[t]) ** 2 // q[t] for t in kept)))
            for t in kept:
                q = share(whole[t], sum(total.values()))
                if c[t] and p[t] > q:
                    term.append((t, (p[t] - q) ** 2 // q))
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda iv: (-iv[1], iv[0].encode()))
                out += [(lang, s, part, i, v, n + 1) for n, (i, v) in enumerate(found)
                        if part == "pair" or n < top]
    return sorted(out)


def audit_rows():
    rng = random.Random(8)
    pool = [f"{a}{b}" for a in "abcdefg" for b in ("", "x", "Yz", "é", "longerthaneight")]
    rows = []
    for i in range(150):
        mine = pool[i % 3 :: 2] if i % 2 else pool
        rows.append((rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "", None, "ß"]),
                     " ".join(rng.choices(mine, k=rng.randint(0, 40)))))
    rows += [("xx", "only", "nothing kept here"), ("yy", "a", None), ("yy", "b", "1 2")]
    rows += [("en", "s1", t) for t in ODD] + [rows[0]] * 3
    rows.append(("en", "long", " ".join(rng.choices(pool, k=300_000))))
    return rows


@pytest.mark.parametrize("slice_bytes", [divergence.SLICE_BYTES, 2_000])
def test_audit(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(divergence, "SLICE_BYTES", slice_bytes)
    rows = audit_rows()
    assert max(len(t or "") for *_, t in rows) > 1_000_000
    df = spark.createDataFrame([(*r, i, 0, 0) for i, r in enumerate(rows)],
                               "lang string, source string, text string, term long, n long, p long")
    got = divergence.audit(df)
    assert sorted(map(tuple, got.collect())) == audit_truth(rows)
    few = sorted(map(tuple, divergence.audit(df, min_docs=5, top=2).collect()))
    assert few == audit_truth(rows, 5, 2)


def runs_of(rows):
    """Sums of the runs of one batch, its peak of numpy memory, and the most runs sent at once."""
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)],
                                       ["lang", "source", "text"])
    sums, most = defaultdict(lambda: [0, 0]), 0
    tracemalloc.start()
    try:
        for runs in divergence._runs(iter([batch])):
            most = max(most, runs.num_rows)
            for r in runs.to_pylist():
                of = sums[r["lang"], r["source"], r["term"]]
                of[0], of[1] = of[0] + r["n"], of[1] + r["docs"]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    return dict(sums), peak, most


def runs_truth(rows):
    sums = defaultdict(lambda: [0, 0])
    for lang, source, text in rows:
        for term, n in Counter(terms(text)).items():
            of = sums[lang, source, term]
            of[0], of[1] = of[0] + n, of[1] + 1
    return dict(sums)


def test_slices_take_bounded_memory(monkeypatch):
    size = 1 << 19
    monkeypatch.setattr(divergence, "SLICE_BYTES", size)
    monkeypatch.setattr(divergence, "RUNS", 1000, raising=False)
    rng = random.Random(5)
    pool = ["the"] * 500 + ["".join(rng.choices("abcé", k=rng.randint(2, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choices(pool, k=n))
    rows = [("en", f"s{i % 3}", text(15_000)) for i in range(24)]
    whole, few = [*rows, ("en", "s0", text(300_000))], rows[:4]
    one_slice = sum(len(t.encode()) for *_, t in few)
    assert size / 2 < one_slice <= size < len(whole[-1][2])
    got, peak, most = runs_of(few)
    assert got == runs_truth(few) and peak < 16 * one_slice and most <= 1000
    got, peak, most = runs_of(whole)  # one batch of many slices, and a text of many
    assert got == runs_truth(whole) and peak < 24 * size and most <= 1000


def test_short_rows_take_bounded_memory():
    rows = [("en", "s", "a")] * 200_000
    got, peak, _ = runs_of(rows)
    assert got == {("en", "s", "a"): [200_000, 200_000]} and peak < 30_000_000


def test_texts_are_cut_between_words():
    rng = random.Random(6)
    for text in ["", "a", "a" * 50, " " * 50, "é" * 30 + " x", "b " + "日" * 40,
                 *("".join(rng.choices("ab é", k=rng.randint(0, 90))) for _ in range(60))]:
        data = np.frombuffer(text.encode(), np.uint8)
        for size in (1, 2, 7, 1000):
            pieces = list(words.cut(data, size))
            parts = [text.encode()[a:b].decode() for a, b in pieces]
            assert "".join(parts) == text and [t for p in parts for t in terms(p)] == terms(text)
            assert all(b - a <= size + max(map(len, (w.encode() for w in terms(text))), default=0)
                       for a, b in pieces)


def test_audit_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert divergence.audit(empty).collect() == []


def trie_truth(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said = (role or "", text or "")
            tie = hashlib.md5("\n".join(said).encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, tie, said))
    own = {c: [s for *_, s in sorted(o)] for c, o in own.items()}
    built = {}
    for c, o in own.items():
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(base, [])[:h] + o[h:])
    nodes = defaultdict(list)
    for c, said in built.items():
        for d in range(len(said) + 1):
            nodes[said[:d]].append(c)
    children = Counter(n[:-1] for n in nodes if n)
    leaves, saved = Counter(), Counter()
    for n, of in nodes.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(of) - 1) * len(n[-1][1]) if n else 0
    out = []
    for n, of in nodes.items():
        ends = ",".join(str(c) for c in sorted(of) if len(built[c]) == len(n))
        out.append((min(of), len(n), min(nodes[n[:-1]]) if n else None, len(of), children[n],
                    leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations():
    rng = random.Random(2)
    said = [("user", "héllo"), ("assistant", "yes"), ("user", None), (None, "no"), ("", "no")]
    rows = []
    for c in [*range(0, 40), *range(200, 260), *range(-130, -90), 3_000_000_000, None]:
        for t in range(rng.choice([1, 2, 3, 7, 9])):
            rows.append((c, t if rng.random() < 0.9 else None, *rng.choice(said[: 1 + t % 5])))
    for t in range(90):  # a long one, two that leave it late, and turns of one number
        rows += [(c, t if c < 502 else 5, "user", f"turn {t if t < 60 else (t, c % 2)}")
                 for c in (500, 501, 502)]
    for c in range(600, 640):  # equal ones
        rows += [(c, t, "user", f"copy {t}") for t in range(6)]
    return rows + rows[:30]


@pytest.mark.parametrize("local_nodes", [prefix_trie.LOCAL_NODES, 8])
def test_trie(spark, monkeypatch, local_nodes):
    monkeypatch.setattr(prefix_trie, "BLOCK_TURNS", 16)
    monkeypatch.setattr(prefix_trie, "BLOCK_IDS", 7)
    rows = conversations()
    df = spark.createDataFrame([(*r, 0, 0) for r in rows],
                               "conv_id long, turn long, role string, text string, depth int, x1 int")
    got = sorted(map(tuple, prefix_trie.trie(df, local_nodes).collect()), key=str)
    assert got == trie_truth(rows)


def test_rounds_of_a_chain_grow_with_the_logarithm():
    for n in (1, 2, 3, 1000, 20_000):
        parent = np.maximum(np.arange(n) - 1, 0)
        weight = np.arange(n, 0, -1)
        got = prefix_trie._numpy_rounds(parent, weight, np.ones((n, 1), np.int64))
        assert (got[:, 0] == weight).all()
    rng = np.random.default_rng(1)
    parent = np.r_[0, [rng.integers(0, i) for i in range(1, 500)]]
    size = np.ones(500, np.int64)
    for i in range(499, 0, -1):
        size[parent[i]] += size[i]
    got = prefix_trie._numpy_rounds(parent, size, np.ones((500, 1), np.int64))
    assert (got[:, 0] == size).all()


def test_trie_of_nothing(spark):
    shape = "conv_id long, turn long, role string, text string"
    for rows in ([], [(None, 1, "user", "x")]):
        assert prefix_trie.trie(spark.createDataFrame(rows, shape)).collect() == []
    one = prefix_trie.trie(spark.createDataFrame([(7, 0, "user", "x")], shape)).collect()
    assert sorted(map(tuple, one), key=str) == trie_truth([(7, 0, "user", "x")])
