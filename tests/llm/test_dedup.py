"""Line dedup, SimHash and substring dedup against brute force, odd inputs included."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from siteindex.llm import line_dedup, simhash, substring
from siteindex.llm.components import components

BLANK = " \t\n\x0b\f\r"
ODD = [None, "", " ", "\n\n", "\t x \r\n", "Émile ß Ω", "a" * 30, "word " * 25, "é" * 20]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def line_truth(rows):
    holders = {}
    for doc, text in rows:
        for line in lowered(text).split("\n"):
            holders.setdefault(line.strip(BLANK), set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        keep = []
        for line in lines:
            key = lowered(line).strip(BLANK)
            shared = len(key) >= 20 and len(holders[key]) >= 3
            if not shared or doc == max(holders[key]):
                keep.append(line)
        out.append((doc, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out)


def line_rows():
    rng = random.Random(1)
    pool = [f"  Shared LINE number {i} of the pool{' ' * (i % 3)}" for i in range(12)] + ODD[1:]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 9))) or None) for i in range(60)]
    rows.append((60, "\n".join(f"Shared line number {i % 12} of the pool" for i in range(300))))
    return rows + [rows[5], rows[5]] + [(100 + i, t) for i, t in enumerate(ODD)]


def test_lines(documents):
    rows = line_rows()
    got = line_dedup.drop_shared_lines(documents(rows)).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got) == line_truth(rows)


def test_hot_lines_are_dealt_out(documents, monkeypatch):
    monkeypatch.setattr(line_dedup, "SAMPLE_OF", 1)
    rows = [(i, f"the very same line everywhere\nown line of document number {i}") for i in range(200)]
    got = line_dedup.drop_shared_lines(documents(rows)).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got) == line_truth(rows)


def test_bitmaps_leave_full_words_out(documents):
    line = "a line that three documents have"
    rows = [(i, "\n".join(["x"] * 130 + [line])) for i in range(3)]
    bitmaps = line_dedup.keep_bitmaps(documents(rows)).collect()
    assert [[(w.w, w.keep) for w in b.words] for b in bitmaps] == [[(2, ~4)]] * 2


def test_null_ids_come_first(documents):
    line = "a line that three documents have"
    rows = [(None, line), (1, line), (2, line)]
    got = {r.doc_id: r.n_dropped for r in line_dedup.drop_shared_lines(documents(rows)).collect()}
    assert got == {None: 1, 1: 1, 2: 0}


def print_truth(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("paired", [256, 1])
def test_simhash(documents, paired):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=120))) for i in range(0, 60, 2)]
    for i in range(30):
        parts = rng.choice(rows[:30])[1].split()
        parts[rng.randrange(120)] = "new"
        rows.append((200 - i, " ".join(parts).upper() if i % 2 else " ".join(parts)))
    rows += [rows[0], (300, rows[3][1])] + [(400 + i, t) for i, t in enumerate(ODD)]
    prints = [print_truth(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    truth = sorted((d, f"{p:016x}", least[find(i)]) for i, ((d, _), p) in enumerate(zip(rows, prints)))
    got = simhash.near_duplicates(documents(rows), paired=paired).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == truth


def test_masks_and_pairs_find_the_same_components():
    rng = np.random.default_rng(4)
    shared, open_bits = simhash._masks(8, 2)[3]
    places = [i for i in range(64) if open_bits >> i & 1]
    fps = np.unique(
        [sum(1 << p for p in rng.choice(places, 4, replace=False)) for _ in range(120)]
    ).astype(np.uint64)

    def groups(links):
        root = {int(f): int(f) for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in np.concatenate(links, axis=1).T.tolist():
            root[find(a)] = find(b)
        found = {}
        for f in root:
            found.setdefault(find(f), set()).add(f)
        return {frozenset(g) for g in found.values()}

    pairs = groups(simhash._group_links(fps, open_bits, 2))
    assert groups(simhash._group_links(fps, open_bits, 2, paired=1)) == pairs


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 130)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def repeat_truth(rows, window):
    seen, out = set(), []
    for doc, text in rows:
        words = (text or "").encode().split()
        covered = [False] * len(words)
        for a in range(len(words) - window + 1):
            key = tuple(words[a : a + window])
            if key in seen:
                covered[a : a + window] = [True] * window
            seen.add(key)
        kept = b" ".join(w for w, c in zip(words, covered) if not c)
        out.append((doc, len(words), sum(covered), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("alphabet", "window"), [(2, 20), (3, 20), (6, 20), (40, 20), (3, 9)])
def test_repeats(documents, alphabet, window):
    rng = random.Random(alphabet)
    words = [f"w{i}" for i in range(alphabet)]
    rows = []
    for i in range(40):
        text = rng.choices(words, k=rng.randint(0, 90))
        if i % 3 == 0:
            text += [rng.choice(words)] * rng.randint(0, 70)
        if i % 4 == 0:
            text += rng.choices(words, k=2) * rng.randint(0, 40)
        if rows and i % 2:
            other = rng.choice(rows)[1].split()
            cut = rng.randint(0, len(other))
            text += other[cut : cut + 45]
        rows.append((i * 2, " \n".join(text)))
    rows += [(100 + i, t) for i, t in enumerate(ODD)] + [(200, "x y " * 3000)]
    got = substring.drop_repeats(documents(rows[::-1]), window).collect()
    found = sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in got)
    assert found == sorted(repeat_truth(rows, window))


def test_repeats_without_memory_of_sent_rows(documents):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, text) for i in range(30)]
    got = substring.drop_repeats(documents(rows), remembered=0).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(0, 0)] + [(i, 60) for i in range(1, 30)]


def test_windows_whose_names_agree_in_part_stay(documents):
    line = [f"w{i}" for i in range(19)]
    texts = [[*line, f"x{i}"] for i in range(300_000)]
    words = np.array([xxhash.xxh64_intdigest(w.encode()) for t in texts for w in t], np.uint64)
    lengths = np.full(len(texts), 20, np.int64)
    begin, _, name, windows = substring.filed_windows(lengths, words, 20)
    of = np.lexsort((windows[begin] >> np.uint64(32), name))
    half, name = (windows[begin] >> np.uint64(32))[of], name[of]
    same = np.flatnonzero((half[1:] == half[:-1]) & (name[1:] == name[:-1]))
    assert len(same)
    rows = [(int(begin[of[i + n]]), " ".join(texts[begin[of[i + n]] // 20])) for i in same for n in (0, 1)]
    got = substring.drop_repeats(documents(rows)).collect()
    assert [r.n_removed for r in got] == [0] * len(rows)


def test_hot_names_are_split(documents):
    rng = random.Random(8)
    line = [f"line{i}" for i in range(12)]
    words = [f"w{i}" for i in range(500)]
    rows = [(i, " ".join(rng.choices(words, k=15) + line + rng.choices(words, k=15))) for i in range(90)]
    rows += [(100 + i, rows[i][1] + " more words") for i in range(0, 90, 9)]
    docs = documents(rows)
    hot = substring.hot_names(docs, 20, 50, 1)
    largest = lambda hot: (
        substring.window_rows(docs, 20, hot=hot).groupBy("k").sum("n").agg({"sum(n)": "max"}).first()[0]
    )
    assert largest(None) > 50 >= largest(hot)
    got = substring.drop_repeats(docs, hot=50, sample_of=1).collect()
    found = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in got]
    assert sorted(found) == sorted(repeat_truth(rows, 20))


def test_repeated_rows_of_one_document(documents):
    text = " ".join(f"w{i}" for i in range(30))
    got = substring.drop_repeats(documents([(1, text), (1, text), (None, text)])).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, 0), (1, 30), (1, 30)]


def test_one_of_each(documents):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(2000)]
    base = [" ".join(rng.choices(words, k=400)) for _ in range(20)]
    rows = list(enumerate(base))
    for i, text in enumerate(base[:10]):
        rows += [(100 + i, text + " more"), (200 + i, text), (None, text)]
    rows += [(300, None), (301, ""), (302, "one two"), (303, "one two"), (302, "one two")]
    rows += [(5, base[12]), (7, base[7] + " last"), (None, "only once"), (None, "only once")]
    rows += [(12, base[12])]
    table = documents(rows)
    got = simhash.one_of_each(table)
    prints = [simhash.fingerprint(text or "") % (1 << 64) for _, text in rows]
    stay = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2 and stay[i] != stay[j]:
            old, new = stay[j], stay[i]
            stay = [new if s == old else s for s in stay]
    least = {}
    for i, (doc, _) in enumerate(rows):
        name = (doc is None, doc or 0)
        least[stay[i]] = min(name, least.get(stay[i], name))
    kept = [(r.doc_id is None, r.doc_id or 0) for r in got.collect()]
    assert sorted(kept) == sorted(least.values())
    assert got.columns == table.columns
    assert (True, 0) in kept


@pytest.mark.parametrize("operator", [line_dedup.drop_shared_lines, simhash.near_duplicates,
                                      substring.drop_repeats, simhash.one_of_each])
def test_empty_tables(documents, operator):
    assert operator(documents([(1, "x")]).where("false")).collect() == []
