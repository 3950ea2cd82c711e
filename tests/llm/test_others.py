"""The other operators against brute force or round trips, odd inputs included."""

import collections
import math
import random
import zlib

import numpy as np
import pytest

from siteindex.llm import ann, chat, decontaminate, mixing, quality, sharding, tokens
from siteindex.llm.queries import tokenizer_file

ODD = [None, "", " ", "\n", "Émile's ß Ω", "<|endoftext|> x", "word " * 2000, "a" * 3000, "x\x1cy \xa0z"]


# --- token files ---------------------------------------------------------------


def test_encoder_agrees_with_the_tokenizer():
    encode = tokens.TextEncoder(tokenizer_file("word_bpe_49k.json"), cached=50)
    assert encode.by_word
    rng = random.Random(1)
    letters = "aAbsStT'\n\t\r  .,;!12éÉßÜſŁ\xa0\x85\x1c漢Σ<|>ª²½µİı́"
    texts = [x for x in ODD if x] + ["".join(rng.choices(letters, k=40)) for _ in range(500)]
    assert [encode(t) for t in texts] == [encode.whole(t) for t in texts]


def test_packing_round_trip():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 30, 50)
    ranks = (2 ** rng.uniform(0, 32, lengths.sum())).astype(np.uint32)
    control, data = tokens.packed(ranks, lengths)
    assert len(control) == ((lengths + 3) // 4).sum()
    back = tokens.unpacked(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), lengths)
    assert (back == ranks).all()


def test_token_files(documents):
    path = tokenizer_file("word_bpe_49k.json")
    rows = [(1000 - i, t) for i, t in enumerate(ODD)] + [(5, "the of and"), (5, "the of and"), (None, "x")]
    manifest = tokens.write_tokens(documents(rows), path)
    got = tokens.read_tokens(manifest, with_ids=True).collect()
    got.sort(key=lambda r: r.start)
    whole = tokens.TextEncoder(path).whole
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(-1 if d is None else d for d, _ in rows)
    start, texts = 0, collections.defaultdict(list)
    for d, t in rows:
        texts[d].append(t or "")
    for r in got:
        ids = np.append(np.frombuffer(whole(texts[r.doc_id].pop()), "<u2"), tokens.END_ID).astype("<u4")
        assert (r.start, r.n_tokens, r.ids_crc32, r.ids) == (
            start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist())
        start += len(ids)
    assert tokens.read_tokens(tokens.write_tokens(documents(rows).where("false"), path)).count() == 0


# --- decontamination -----------------------------------------------------------


def plain_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_bit_vectors():
    rng = random.Random(3)
    for _ in range(300):
        p = "".join(rng.choices("abc", k=rng.randint(1, 80)))
        t = "".join(rng.choices("abc", k=rng.randint(0, 120)))
        bits = collections.defaultdict(int)
        for i, c in enumerate(p):
            bits[c] |= 1 << i
        assert decontaminate.distance(dict(bits), len(p), t)[0] == plain_distance(p, t)


def test_contamination(spark, documents, monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(8, 40)))) for i in range(12)]
    items += [(50, items[0][1].upper()), (51, None), (52, "Short one!"), (53, words[0]),
              (54, "abc"), (55, "..."), (None, items[1][1] + " more words here")]
    rows = []
    for i in range(40):
        text = rng.choices(words, k=60)
        if i % 2:
            item = list(rng.choice(items[:12])[1])
            for _ in range(rng.randint(0, len(item) // 10)):
                item[rng.randrange(len(item))] = rng.choice("xyz")
            text[30:30] = ["".join(item)]
        rows.append((i, ("\n" if i % 3 else " ").join(text)))
    rows += [(100 + i, t) for i, t in enumerate(ODD)]
    rows += [(200, "a very short-one"), (201, "shorter ones, shortone"), (202, "Short\none"), (203, "xabc abcx"), (204, "ABC")]
    rows += [(205, "long " * 300_000 + items[3][1] + " short one")]
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 400)
    truth = {(205, 3, 0), (205, 52, 0)}
    for doc, text in rows[:-1]:
        for item, sought in items:
            a, b = decontaminate.compared(sought or ""), decontaminate.compared(text or "")
            if a and len(a) < 24:
                if f" {a} " in f" {b} ":
                    truth.add((doc, item, 0))
            elif a and (d := plain_distance(a, b)) <= int(len(a) * decontaminate.ERROR_RATE):
                truth.add((doc, item, d))
    table = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(rows)
    assert len(list(decontaminate._blocks(table))) > 2
    got = decontaminate.contamination(docs, table)
    assert {(r.doc_id, r.item_id, r.distance) for r in got.collect()} == truth and truth
    found = docs.where(decontaminate.is_contaminated(docs, table)).collect()
    assert {r.doc_id for r in found} == {d for d, _, _ in truth}
    none = table.where("false")
    assert decontaminate.contamination(docs, none).count() == 0
    assert docs.where(decontaminate.is_contaminated(docs, none)).count() == 0


# --- chat ----------------------------------------------------------------------


def test_chat(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK_TURNS", 2)
    rng = random.Random(5)
    talks = [[(rng.choice(["user", None, ""]), rng.choice(["hi", None, "", "yes\n"])) for _ in range(9)]
             for _ in range(5)]
    rows = []
    for conv in range(60):
        said = rng.choice(talks)[: rng.randint(1, 9)]
        rows += [(conv, t * 3, r, x) for t, (r, x) in enumerate(said)]
    rows += rows[:7] + [(None, 0, "user", "only here"), (None, None, "user", "first")]
    wholes = collections.defaultdict(dict)
    for c, t, r, x in rows:
        wholes[c][-1 if t is None else t] = (r, x)
    wholes = {c: tuple(v for _, v in sorted(w.items())) for c, w in wholes.items()}
    truth = {}
    for c in sorted(wholes, key=lambda c: -1 if c is None else c):
        w = wholes[c]
        longer = any(len(o) > len(w) and o[: len(w)] == w for o in wholes.values())
        if not longer and w not in {wholes[k] for k in truth}:
            text = "".join(f"<|{'unknown' if r is None else r}|>\n{x or ''}<|end|>\n" for r, x in w)
            truth[c] = (len(w), sum(o == w for o in wholes.values()), text)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = chat.chat_texts(table.withColumn("place", table.turn), part_turns=4).collect()
    got = collections.defaultdict(list)
    for r in sorted(parts, key=lambda r: r.part):
        got[r.conv_id].append(r)
    assert {c: (p[0].n_turns, p[0].n_equal, "".join(x.text for x in p)) for c, p in got.items()} == truth
    assert chat.chat_texts(table.where("false")).collect() == []


# --- neighbours ----------------------------------------------------------------


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 3000)] + 0.4 * rng.normal(size=(3000, 16))
    x *= rng.uniform(0.5, 2, (3000, 1))
    x[1000:1400] = x[7]
    x = x.astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(4000, None), (4020, [0.0] * 16), (4040, [float("nan")] * 16), (4060, [1.0] * 15),
           (4080, [None] * 16), (4100, [float("inf")] * 16), (4120, [])]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    table = table.withColumn("list", table.vec_id).withColumn("rank", table.vec_id)
    got = collections.defaultdict(list)
    for r in ann.nearest(table, table.vec_id % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    d = x.astype(np.float64)
    hits = 0
    assert set(got) == set(range(0, 3000, 20))
    for q, found in got.items():
        scores = (d * d[q]).sum(1)
        scores[q] = -np.inf
        best = np.lexsort((np.arange(3000), -scores))[:20].tolist()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(abs(s - scores[v]) < 1e-9 for _, v, s in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        hits += len(set(best) & {v for _, v, _ in found})
    assert hits / (20 * len(got)) >= 0.95
    few = ann.nearest(table.where("vec_id < 5"), table.vec_id == 0).collect()
    assert [r.rank for r in few] == [1, 2, 3, 4]
    assert ann.nearest(table.where("vec_id >= 4000"), table.vec_id == 4000).count() <= 1
    assert ann.nearest(table.where("false"), table.vec_id == 0).count() == 0


# --- mixing --------------------------------------------------------------------


def test_recall_with_many_lists():
    x = np.random.default_rng(7).standard_normal((16_000, 64))
    top = (x**2).sum(1).max()
    longer = np.c_[x, np.sqrt(np.maximum(0.0, top - (x**2).sum(1)))]
    centroids = ann.Centroids.of(ann.bisected(longer, 1_000))
    homes = [h for a in range(0, len(x), 500) for h in centroids.homes(longer[a : a + 500])]
    sizes = np.bincount(np.concatenate(homes), minlength=1_000)
    queries = x[:50]
    wanted = centroids.lists_for(np.c_[queries, np.zeros(50)], sizes, 20 * ann.ENOUGH)
    hits = 0
    for n, lists in enumerate(wanted):
        scores = x @ queries[n]
        scores[n] = -np.inf
        hits += sum(bool(np.isin(homes[i], lists).any()) for i in np.argsort(-scores)[:20])
    assert hits >= 0.9 * 20 * 50


def test_mixing(spark, documents):
    rng = random.Random(7)
    pools = {d: [f"{d}{i}" for i in range(40)] for d in "ab"}
    kinds = ["a"] * 150 + ["b"] * 50
    rows = [(i, " ".join(rng.choices(pools[k], k=rng.randint(5, 60)))) for i, k in enumerate(kinds)]
    rows += [(500 + i, t) for i, t in enumerate(ODD)] + [rows[0], (None, rows[1][1])]
    marks = [(i, kinds[i]) for i in range(0, 200, 3)] + [(1, "other"), (2, None), (None, "a")]
    labelled = spark.createDataFrame(marks, "doc_id long, domain string")
    targets = {"a": 0.4, "b": 0.6}
    mixed = mixing.mixture(documents(rows), labelled, targets).collect()
    assert len(mixed) == len({(d, t or "") for d, t in rows})
    total = sum(r.n_tokens for r in mixed)
    for j, share in enumerate(targets.values()):
        assert abs(sum(r.rate * r.n_tokens * r.p[j] for r in mixed) / total - share) < 0.01
    assert all(r.rate >= 0 and abs(sum(r.p) - 1) < 1e-9 and abs(r.copies - r.rate) < 1 for r in mixed)
    sure = [r.p["ab".index(kinds[r._key])] for r in mixed if 0 <= r._key < 200]
    assert sum(p > 0.5 for p in sure) > 190
    copies = {(r._key, r._version): r.copies for r in mixed}
    out = mixing.mixed_documents(documents(rows), labelled, targets)
    assert out.columns == documents(rows).columns
    assert out.count() == sum(copies.values()) + copies[next(k for k in copies if k[0] == 0)]
    assert mixing.mixture(documents(rows).where("false"), labelled, targets).collect() == []
    even = mixing.mixture(documents(rows), labelled.where("false"), targets).collect()
    assert all(math.isfinite(r.rate) and math.isclose(r.p[0], 0.5) for r in even)


MEMBERS = "_key long, _version long, n_tokens long, p array<double>"


def nearest_rates(n, p, goal):
    """Dense: of the nonnegative rates whose totals are the goal, those nearest to 1 (by tokens)."""
    pull = np.zeros(len(goal))
    for _ in range(200):  # Newton steps on one multiplier for each domain
        r = np.maximum(0, 1 + p @ pull)
        live = (n * (r > 0))[:, None] * p
        pull += np.linalg.solve(live.T @ p + 1e-9 * np.eye(len(goal)), goal - (n * r) @ p)
    return np.maximum(0, 1 + p @ pull)


@pytest.mark.parametrize("shares", [(0.7, 0.2, 0.1), (0.9, 0.05, 0.05), (0.3, 0.4, 0.3)])
def test_rates_reach_far_targets(spark, shares, recwarn):
    rng = np.random.default_rng(3)
    n, p = rng.integers(1, 400, 300), rng.dirichlet((1.0, 0.3, 0.2), 300)
    rows = [(i, 0, int(n[i]), p[i].tolist()) for i in range(300)]
    targets = dict(zip("abc", shares, strict=True))
    members = spark.createDataFrame(rows, MEMBERS)
    rates = mixing.fitted_rates(members, targets)
    got = np.array([r.rate for r in rates.orderBy("_key").collect()])
    goal = n.sum() * np.array(shares)
    assert not [w for w in recwarn if "targets" in str(w.message)]
    assert (np.abs((n * got) @ p - goal) < 3 * mixing.TOLERANCE * goal).all() and (got >= 0).all()
    best = nearest_rates(n, p, goal)
    assert np.allclose((n * best) @ p, goal)
    assert n @ (got - 1) ** 2 < 1.1 * (n @ (best - 1) ** 2) + 0.01 * n.sum()
    shown = {r.domain: (r.target, r.expected) for r in mixing.expected_shares(rates, targets).collect()}
    for d, j in zip("abc", range(3), strict=True):
        assert math.isclose(shown[d][0], shares[j])
        assert math.isclose(shown[d][1], (n * got) @ p[:, j] / n.sum())


def test_targets_out_of_reach(spark):
    members = spark.createDataFrame([(i, 0, 10, [0.5, 0.5]) for i in range(20)], MEMBERS)
    targets = {"a": 0.9, "b": 0.1}
    with pytest.warns(UserWarning, match="no rates meet the targets"):
        rates = mixing.fitted_rates(members, targets)
    # (x - 0.9) / 0.9 + (x - 0.1) / 0.1 = 0 holds for x = 0.18 of each domain
    assert all(abs(r.expected - 0.18) < 2e-3 for r in mixing.expected_shares(rates, targets).collect())
    assert mixing.expected_shares(rates.where("false"), targets).first().expected is None


def test_unreachable_is_a_proof():
    rng = np.random.default_rng(5)
    found = 0
    for _ in range(300):
        p, shares = rng.dirichlet((4, 1, 1), 6), rng.dirichlet((1, 1, 1))
        n = rng.dirichlet(np.ones(6))
        slopes = (n @ p - shares) / shares
        if mixing._unreachable(list(shares), list(slopes), (p @ slopes).min()):
            found += 1  # then many mixtures of the documents all miss
            mixtures = rng.dirichlet(np.full(6, 0.3), 2000) @ p
            assert (np.abs(mixtures - shares) / shares).max(axis=1).min() > mixing.TOLERANCE
        reached = n @ p  # a mixture of the documents is never called out of reach
        any_slopes = rng.normal(size=3)
        assert not mixing._unreachable(list(reached), list(any_slopes), (p @ any_slopes).min())
    assert found > 20


# --- quality -------------------------------------------------------------------


def test_quality(spark, documents):
    rng = random.Random(8)
    good = ["the", "river", "runs", "slowly", "past", "old", "houses", "and", "trees"]
    rows = []
    for i in range(400):
        words = rng.choices(good, k=rng.randint(20, 60))
        if i % 4 == 0:
            words = [w + "!!!" for w in words] if i % 8 else [words[0]] * 40
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "the river")]
    marks = [(i, int(i % 4 > 0)) for i in range(400)] + [(7, None), (None, 0), (9999, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    docs = documents(rows)
    model = quality.fit(docs, labels)
    scored = docs.select(
        "doc_id", quality.held_out().alias("held"), quality.score(docs, model).alias("score")
    ).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    for r in scored:
        assert r.held == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in scored if r.held and r.doc_id < 400]
    assert sum((r.score >= quality.THRESHOLD) == (r.doc_id % 4 > 0) for r in held) >= 0.9 * len(held)
    blank = quality.fit(docs, labels.where("false"))
    assert {round(r[0], 6) for r in docs.select(quality.score(docs, blank)).collect()} == {0.5}


def test_held_out_labels_are_not_learned(spark, documents):
    rows = [(i, f"word{i % 2} other") for i in range(100)]
    fold = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0]
    labels = spark.createDataFrame([(i, i % 2) for i in fold], "doc_id long, quality int")
    assert not quality.fit(documents(rows), labels).layer.any()


# --- sharding ------------------------------------------------------------------


def test_sharding(documents, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 16)
    rng = random.Random(9)
    rows = [(rng.randrange(150), rng.choice(ODD + ["same", "texts"])) for _ in range(203)]
    rows += [(None, "x"), (None, None), (3, "x"), (3, "x")]
    docs = documents(rows)
    got = sharding.assign_shards(docs).collect()
    truth = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sorted((r["size"], r.text_crc32) for r in got) == truth
    counts = collections.Counter(r.shard for r in got)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for shard in range(16):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(counts[shard]))
    for source, n in collections.Counter(r.source for r in got).items():
        held = collections.Counter(r.shard for r in got if r.source == source)
        assert all(abs(held[s] - n / 16) < 2 for s in range(16))
    whole = sharding.sharded_documents(docs).collect()
    assert sorted((r.doc_id or -1, r.text or "", r.source or "") for r in whole) == sorted(
        (r.doc_id or -1, r.text or "", r.source or "") for r in docs.collect())
    assert collections.Counter((r.shard, r.slot) for r in whole) == collections.Counter(
        (r.shard, r.slot) for r in got)
    assert sharding.assign_shards(docs.where("false")).collect() == []


# --- pipeline ------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline
    from siteindex.llm.common import table

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns[:5] == before.columns[:5]
        assert 0 < docs.count() <= before.count() * 1.2
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}, name
    assert docs.columns == [*before.columns, "shard", "slot"]
    assert stage(spark, before.where("false"), "/root/testdata/sf0.001").collect() == []


@pytest.mark.parametrize("name", ["quality", "near_duplicates", "decontamination", "mixing", "sharding"])
def test_stages_take_empty_tables(spark, name):
    import corpus_pipeline
    from siteindex.llm.common import table

    docs = table(spark, "/root/testdata/sf0.001", "documents").where("doc_id < 0")
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, docs, "/root/testdata/sf0.001").collect() == []
