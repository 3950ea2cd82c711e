"""Toxicity: learned terms, found with misspellings, weighed by their surroundings.

The lexicon is learned from labelled documents: the words that toxic ones hold far more often than
chance allows. Its trie is intersected with Levenshtein automata: a state is a set of trie nodes
with the edits spent so far (a swap of neighbours is one edit), made when a word first needs it,
so that all words of a batch step through one table by numpy. A word matches the nearest term
within the term's budget of edits.

Each match has a score: the log-odds of toxic documents among those that hold this form of the
term, so that a word of clean texts which looks like a term says nothing. A form not seen before
has the odds of the forms seen once at that distance from its term and those that begin like it. Matches inside quotation marks of a
line, or in a line quoted by ``>``, add what quotation changes in labelled text, and the
``CONTEXT`` words on either side what such words speak for. A logistic layer over the matches of a
document, fitted in numpy, gives its score.

Everything is learned from at most ``FIT_ROWS`` labelled rows, those with the smallest hash of their
id, outside the held-out fold; scoring takes every whole text. The driver gets at most ``LEXICON``
terms and the ``FORMS`` most frequent other forms, counts of these and of ``BUCKETS`` kinds of
surroundings, and a few numbers a fitted row.

Defined cases: null and empty texts match nothing; a null id is scored and never labelled; null
labels are left out; several labels of an id are a row each; of several texts of an id the one
with the smallest hash is learned from. Without any label every score is one half.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteindex.llm.common import id_key, whole_text, written

FIT_ROWS, SEED = 16_000, 13
LEXICON, FORMS, MIN_DOCS = 512, 20_000, 3
CONTEXT, BUCKETS = 5, 4096
HELD_OUT_FOLD, FOLDS, THRESHOLD = 2, 4, 0.3
#: Edits that a term of at least so many characters allows.
BUDGETS = ((10, 2), (4, 1), (1, 0))
#: What counts as seen of a term at each distance before any text is, and its toxic share.
PRIOR_DOCS, PRIOR_SHARE = 2.0, (0.95, 0.95, 0.85)
#: Terms that begin with so many equal characters share what is known of forms not seen before.
KIN_CHARS = 3
#: Documents that the odds of the forms seen once weigh in the odds of a form.
FORM_DOCS = 0.5
#: The same for matches in quotation marks.
QUOTED_DOCS, QUOTED_SHARE = 2.0, 0.1
#: Characters of a text that are looked at together, and states after which a table starts anew.
SLICE, STATES = 1 << 22, 50_000

_QUOTES = np.array([ord(c) for c in '"“”„«»'], np.uint32)
_INNER, _TRAILING = "*@$'", "*@$'"
_CHAR = np.zeros(0x3000, bool)  # characters of words, beyond this table all are
_CHAR[[*map(ord, "abcdefghijklmnopqrstuvwxyz0123456789" + _INNER)]] = True
_CHAR[0xC0:0x2000] = True
_CHAR[0x2C00:] = True
_EDGE = np.zeros(0x3000, bool)  # those that do not begin or end a word
_EDGE[[*map(ord, _TRAILING)]] = True


def _in(table: np.ndarray, codes: np.ndarray, beyond: bool) -> np.ndarray:
    return np.where(codes < len(table), table[np.minimum(codes, len(table) - 1)], beyond)


class Words:
    """The words of some texts, in lower case, as places in an array of characters."""

    def __init__(self, texts: Sequence[str | None]):
        lowered = [(t or "").lower() for t in texts]
        joined = "\n".join(lowered).encode("utf-32-le", "surrogatepass")
        self.codes = np.frombuffer(joined, np.uint32)
        sizes = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1
        begins = np.cumsum(sizes) - sizes
        inside = _in(_CHAR, self.codes, True)
        edge = np.diff(np.r_[0, inside.astype(np.int8), 0])
        starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        core = np.flatnonzero(inside & ~_in(_EDGE, self.codes, False))
        first = np.searchsorted(core, starts)
        last = np.searchsorted(core, stops) - 1
        full = last >= first
        lead = self.codes[starts] if len(starts) else starts
        # a word may begin with @ or $, which stand for letters
        stands = full & np.isin(lead, [ord("@"), ord("$")])
        begin = np.where(stands, starts, core[np.minimum(first, len(core) - 1)] if len(core) else 0)
        self.starts = begin[full]
        self.lengths = core[last[full]] + 1 - self.starts
        self.doc = np.searchsorted(begins, self.starts, "right") - 1
        self.docs = len(lowered)

    def text(self, word: int) -> str:
        start = self.starts[word]
        found = self.codes[start : start + self.lengths[word]].tobytes()
        return found.decode("utf-32-le", "surrogatepass")

    def quoted(self, at: np.ndarray) -> np.ndarray:
        """Whether these words are in quotation marks of their line, or the line is quoted."""
        if not len(at):
            return np.zeros(0, bool)
        places = self.starts[at]
        marks = np.flatnonzero(np.isin(self.codes, _QUOTES))
        breaks = np.flatnonzero(self.codes == ord("\n"))
        line = np.searchsorted(breaks, places)
        begin = np.r_[0, breaks + 1][line]
        end = np.r_[breaks, len(self.codes)][line]
        before = np.searchsorted(marks, places) - np.searchsorted(marks, begin)
        after = np.searchsorted(marks, end) - np.searchsorted(marks, places)
        return (before % 2 == 1) & (after > 0) | (self.codes[begin] == ord(">"))


class Automaton:
    """Levenshtein automata of the terms in their trie, as one table of lazily made states."""

    def __init__(self, terms: Sequence[str]):
        self.terms = list(terms)
        chars = sorted(set("".join(self.terms)))
        self.classes = {ord(c): n + 1 for n, c in enumerate(chars)}
        top = max(self.classes, default=0) + 1
        self.class_of = np.zeros(top + 1, np.int32)
        self.class_of[list(self.classes)] = list(self.classes.values())
        self.kids: list[dict[int, int]] = [{}]
        self.term_at: dict[int, int] = {}
        self.budget = [0]
        self.allowed = [next(k for size, k in BUDGETS if len(t) >= size) for t in self.terms]
        for number, term in enumerate(self.terms):
            node = 0
            self.budget[0] = max(self.budget[0], self.allowed[number])
            for c in term:
                label = self.classes[ord(c)]
                if label not in self.kids[node]:
                    self.kids[node][label] = len(self.kids)
                    self.kids.append({})
                    self.budget.append(0)
                node = self.kids[node][label]
                self.budget[node] = max(self.budget[node], self.allowed[number])
            self.term_at[node] = number
        self.width = len(chars) + 1
        self._clear()

    def _clear(self) -> None:
        self.names: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.table = np.full((1024, self.width), -1, np.int32)
        self.found = np.full((1024, 2), -1, np.int32)  # term and distance at a word's end
        self._state({})  # 0: nothing can match any more
        self._state({(0, -1): 0})

    def _state(self, items: dict[tuple[int, int], int]) -> int:
        """The number of a state; ``items`` maps node and awaited character to edits."""
        stack = [key for key in items if key[1] < 0]
        while stack:  # characters of the term left out of the word
            node, _ = key = stack.pop()
            edits = items[key] + 1
            for child in self.kids[node].values():
                if edits <= self.budget[child] and edits < items.get((child, -1), 9):
                    items[child, -1] = edits
                    stack.append((child, -1))
        name = frozenset((*key, edits) for key, edits in items.items())
        if name in self.names:
            return self.names[name]
        number = self.names[name] = len(self.sets)
        self.sets.append(name)
        if number == len(self.table):
            self.table = np.r_[self.table, np.full_like(self.table, -1)]
            self.found = np.r_[self.found, np.full_like(self.found, -1)]
        ends = [
            (edits, self.term_at[node])
            for node, awaited, edits in name
            if awaited < 0 and node in self.term_at and edits <= self.allowed[self.term_at[node]]
        ]
        if ends:
            edits, term = min(ends)
            self.found[number] = term, edits
        if not name:
            self.table[number] = number
        return number

    def _step(self, state: int, label: int) -> int:
        items: dict[tuple[int, int], int] = {}

        def add(node: int, awaited: int, edits: int) -> None:
            if edits <= self.budget[node] and edits < items.get((node, awaited), 9):
                items[node, awaited] = edits

        for node, awaited, edits in self.sets[state]:
            if awaited >= 0:
                if awaited == label:
                    add(node, -1, edits)
                continue
            add(node, -1, edits + 1)
            for other, child in self.kids[node].items():
                add(child, -1, edits + (other != label))
                if other != label and label in self.kids[child]:
                    add(self.kids[child][label], other, edits + 1)
        return self._state(items)

    def match(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the words that match, their terms and distances."""
        if not self.terms or not len(words.starts):
            return (np.zeros(0, np.int64),) * 3
        if len(self.sets) > STATES:
            self._clear()
        labels = self.class_of[np.minimum(words.codes, len(self.class_of) - 1)]
        at, state = np.arange(len(words.starts)), np.ones(len(words.starts), np.int32)
        found, place = [], 0
        while len(at):
            ended = words.lengths[at] == place
            hit = ended & (self.found[state, 0] >= 0)
            found.append((at[hit], state[hit], self.found[state[hit]]))
            at, state = at[~ended], state[~ended]
            label = labels[words.starts[at] + place]
            after = self.table[state, label]
            new = after < 0
            if new.any():
                pairs = np.unique(state[new].astype(np.int64) * self.width + label[new])
                for pair in pairs.tolist():
                    made = self._step(*divmod(pair, self.width))
                    self.table[divmod(pair, self.width)] = made
                after = self.table[state, label]
            goes_on = after > 0
            at, state = at[goes_on], after[goes_on]
            place += 1
        at = np.concatenate([a for a, *_ in found])
        of = np.concatenate([f for *_, f in found])
        order = np.argsort(at)
        return at[order], of[order, 0].astype(np.int64), of[order, 1].astype(np.int64)


def surroundings(words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words around each match, and which of them are in the same document."""
    near = at[:, None] + np.r_[-CONTEXT:0, 1 : CONTEXT + 1]
    inside = (near >= 0) & (near < len(words.starts))
    near = np.where(inside, near, at[:, None])
    inside &= words.doc[near] == words.doc[at][:, None]
    name = words.lengths[near].astype(np.uint64)
    for place in range(12):  # letters of longer words beyond these do not count
        code = words.codes[np.minimum(words.starts[near] + place, len(words.codes) - 1)]
        code = np.where(place < words.lengths[near], code, 0).astype(np.uint64)
        name = name * np.uint64(0x100000001B3) + code
    name = (name ^ (name >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (name >> np.uint64(40)).astype(np.int64) % BUCKETS, inside


def slices(texts: Sequence[str | None]) -> Iterator[list[str | None]]:
    """Whole texts in groups of about ``SLICE`` characters."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text or "")
        if size >= SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


@dataclass
class ToxicityModel:
    """Terms, scores of matches, and the layer over a document's matches."""

    terms: list[str]
    weights: np.ndarray  # of forms not seen before: term by distance
    forms: dict[str, float]  # of others
    quotation: float
    context: np.ndarray
    layer: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


class Scorer:
    def __init__(self, model: ToxicityModel):
        self.model, self.automaton = model, Automaton(model.terms)

    def features(self, texts: Sequence[str | None], further: int = 0) -> np.ndarray:
        """What the layer sees of each text: sums, the best and the number of its matches.

        With ``further`` each match counts as if its word had so many more misspelt characters,
        where the term allows them.
        """
        words, model = Words(texts), self.model
        at, term, distance = self.automaton.match(words)
        score = np.zeros(len(at))
        if len(at):
            allowed = np.array(self.automaton.allowed)[term]
            moved = np.maximum(distance, np.minimum(distance + further, allowed))
            score = model.weights[term, moved]
            known = model.forms
            for i in np.flatnonzero((moved == distance)).tolist():
                form = model.terms[term[i]] if not distance[i] else words.text(at[i])
                score[i] = known.get(form, score[i])
        counts = score > 0  # others say nothing
        at, term, score = at[counts], term[counts], score[counts]
        if len(at):
            buckets, inside = surroundings(words, at)
            around = np.where(inside, model.context[buckets], 0).sum(axis=1)
            score = score + around / np.maximum(1, inside.sum(axis=1))
            score = np.maximum(0, score + model.quotation * words.quoted(at))
        doc, n = words.doc[at], words.docs
        total = np.bincount(doc, weights=score, minlength=n)
        best = np.zeros(n)
        np.maximum.at(best, doc, score)
        strong = score > 1
        pairs = np.unique(np.stack([doc[strong], term[strong]]), axis=1)
        different = np.bincount(pairs[0], minlength=n)
        size = np.bincount(words.doc, minlength=n)
        return np.stack(
            [np.ones(n), np.log1p(total), best, np.log1p(different), 100 * total / (size + 100)], axis=1
        )

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        some = [self.features(part) @ self.model.layer for part in slices(texts)]
        return 1 / (1 + np.exp(-np.concatenate([np.zeros(0), *some])))


def held_out(doc_id: str = "doc_id") -> Column:
    fold = F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(FOLDS))
    return F.coalesce(fold == HELD_OUT_FOLD, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``toxic, text`` of the labelled rows to learn from, as a written table."""
    order = F.xxhash64(F.lit(SEED), F.col("_id"))
    marks = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
        .select(F.col("doc_id").cast("bigint").alias("_id"), (F.col(label) == 1).alias("toxic"))
        .orderBy(order, "_id", "toxic")
        .limit(rows)
    )
    texts = docs.select(id_key().alias("_id"), whole_text().alias("text"))
    one = F.min_by("text", F.xxhash64("text")).alias("text")
    sample = texts.join(F.broadcast(marks), "_id").groupBy("_id", "toxic").agg(one)
    return written(sample.select("toxic", "text"), "toxicity-sample")


def _both(toxic: str = "toxic") -> list[Column]:
    return [F.count_if(F.col(toxic)).alias("pos"), F.count_if(~F.col(toxic)).alias("neg")]


def _surprise(base: float) -> Column:
    return F.expr(
        f"pos * ln(pos / ((pos + neg) * {base!r}D))"
        f" + if(neg > 0, neg * ln(neg / ((pos + neg) * {1 - base!r}D)), 0D)"
    )


def _first_terms(wanted: frozenset[str] | None):
    """Each term of each text with a hash of its first neighbours: all terms, or those wanted."""

    def terms(batches):
        for batch in batches:
            marks, found = batch.column("toxic").to_pylist(), ([], [], [])
            for toxic, text in zip(marks, batch.column("text").to_pylist(), strict=True):
                words = Words([text])
                said = [words.text(i) for i in range(len(words.starts))]
                first = {}
                for i, term in enumerate(said):
                    if len(term) > 2 and term not in first and (wanted is None or term in wanted):
                        first[term] = i
                for term, i in first.items():
                    found[0].append(term)
                    found[1].append(toxic)
                    near = " ".join(said[max(0, i - 1) : i] + said[i + 1 : i + 2])
                    found[2].append(zlib.crc32(near.encode("utf-8", "surrogatepass")))
            types = [pa.string(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(found, types, strict=True)],
                ["term", "toxic", "near"],
            )

    return terms


def learn_lexicon(sample: DataFrame, size: int = LEXICON, min_docs: int = MIN_DOCS) -> list[str]:
    """The terms whose share of toxic documents chance explains least, at most ``size``.

    By Chernoff's bound a term is found among so many toxic documents by chance with probability
    ``exp(-surprise)`` at most; terms stay that would not be expected once in the vocabulary.
    Documents where the neighbours of its first place agree count as one for a term, so that
    copies of a toxic document do not make its words suspect.
    """
    shape = "term string, toxic boolean, near long"
    counts = written(
        sample.mapInArrow(_first_terms(None), shape).groupBy("term").agg(*_both()), "toxicity-terms"
    )
    vocabulary = counts.count()
    all_pos, all_neg = sample.agg(*_both()).first()
    if not vocabulary or not all_pos or not all_neg:
        return []
    base = all_pos / (all_pos + all_neg)

    def best(counted: DataFrame, most: int) -> list[str]:
        likely = counted.where((F.col("pos") >= min_docs) & (F.expr("pos / (pos + neg)") > base))
        sure = likely.withColumn("surprise", _surprise(base)).where(
            F.col("surprise") >= float(np.log(vocabulary))
        )
        rows = sure.orderBy(F.desc("surprise"), "term").limit(most).select("term").collect()
        return [row.term for row in rows]

    likely = best(counts, 8 * size)
    places = sample.mapInArrow(_first_terms(frozenset(likely)), shape).distinct()
    return best(places.groupBy("term").agg(*_both()), size)


def _matches(terms: list[str]):
    def count(batches):
        automaton = Automaton(terms)
        for batch in batches:
            rows = []
            marks, texts = batch.column("toxic").to_pylist(), batch.column("text").to_pylist()
            for toxic, text in zip(marks, texts, strict=True):
                words = Words([text])
                at, term, distance = automaton.match(words)
                forms = [
                    (words.text(i) if d else terms[t], t * 3 + d)
                    for i, t, d in zip(at.tolist(), term.tolist(), distance.tolist(), strict=True)
                ]
                rows += [("form", form, key, toxic) for form, key in set(forms)]
                quoted = set(words.quoted(at).tolist())
                rows += [("quoted", None, int(q), toxic) for q in quoted]
                buckets, inside = surroundings(words, at)
                rows += [("context", None, b, toxic) for b in np.unique(buckets[inside]).tolist()]
            types = [pa.string(), pa.string(), pa.int64(), pa.bool_()]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ["kind", "form", "key", "toxic"],
            )

    return count


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Coefficients by Newton's method; the first column, the bias, is not held back."""
    layer = np.zeros(x.shape[1])
    hold = np.full(x.shape[1], ridge)
    hold[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ layer)))
        pull = x.T @ (y - p) - hold * layer
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(hold)
        step = np.linalg.solve(curve, pull)
        layer = layer + step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-9:
            break
    return layer


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS,
    size: int = LEXICON,
) -> ToxicityModel:
    """Learn terms, weights and layer from labelled rows outside the held-out fold."""
    sample = labelled_sample(docs, labels, label, rows)
    terms = learn_lexicon(sample, size)
    all_pos, all_neg = sample.agg(*_both()).first()
    scale = all_pos / all_neg if all_pos and all_neg else 1.0  # as if there were as many of both
    context, quotes = np.ones((BUCKETS, 2)), np.zeros((2, 2))
    shape = "kind string, form string, key long, toxic boolean"
    found = written(
        sample.mapInArrow(_matches(terms), shape).groupBy("kind", "form", "key").agg(*_both()),
        "toxicity-matches",
    )
    for kind, key, pos, neg in found.where("kind <> 'form'").select("kind", "key", "pos", "neg").collect():
        (context if kind == "context" else quotes)[key] += pos, neg * scale
    once = found.where("kind = 'form' and pos + neg = 1").groupBy("key").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    prior = PRIOR_DOCS * np.array([[share, 1 - share] for share in PRIOR_SHARE])
    kin = [term[:KIN_CHARS] for term in terms]
    of_kin = {k: prior.copy() for k in kin}
    for key, pos, neg in once.collect():
        of_kin[kin[key // 3]][key % 3] += pos, neg * scale
    seen = np.array([of_kin[k] for k in kin]).reshape(-1, 3, 2)
    weights = np.log(seen[:, :, 0] / seen[:, :, 1])
    often = found.where("kind = 'form' and pos + neg > 1").orderBy(F.desc(F.col("pos") + F.col("neg")), "form")
    forms = {}
    for form, key, pos, neg in often.select("form", "key", "pos", "neg").limit(size + FORMS).collect():
        share = seen[key // 3, key % 3] / seen[key // 3, key % 3].sum()
        toxic, clean = [pos, neg * scale] + FORM_DOCS * share
        forms[form] = float(np.clip(np.log(toxic / clean), -6, 6))
    plain = quotes[0] + 1
    quoted = quotes[1] + QUOTED_DOCS * np.array([QUOTED_SHARE, 1 - QUOTED_SHARE])
    quotation = float(np.log(quoted[0] / quoted[1]) - max(0.0, np.log(plain[0] / plain[1])))
    lean = np.log(context[:, 0] / context[:, 1])
    met = context.sum(axis=1) > 2
    lean = np.where(met, np.clip(lean - (lean[met].mean() if met.any() else 0), -1, 1), 0)
    model = ToxicityModel(terms, np.clip(weights, -6, 6), forms, quotation, lean, np.zeros(5))

    def features(batches):
        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
            bad = [text for text, mark in zip(texts, toxic, strict=True) if mark]
            # a toxic text stays toxic with its terms misspelt: it is learned both ways
            seen = [scorer.features(part) for part in slices(texts)]
            seen += [scorer.features(part, 1) for part in slices(bad)]
            columns = np.concatenate([np.zeros((0, 5)), *seen])
            marks = np.r_[toxic, np.ones(len(bad), bool)]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c) for c in columns.T), pa.array(marks)],
                [*(f"f{i}" for i in range(5)), "toxic"],
            )

    shape = ", ".join(f"f{i} double" for i in range(5)) + ", toxic boolean"
    rows_seen = sample.mapInArrow(features, shape).collect()
    data = np.array(sorted(map(tuple, rows_seen)), float).reshape(-1, 6)
    if len(data):
        model.layer = logistic(data[:, :5], data[:, 5])
    return model


_scorers: dict[str, Scorer] = {}


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> Column:
    """Probability that each text is toxic, a column of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    name = model.name

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if name not in _scorers:
            _scorers.clear()
            _scorers[name] = Scorer(sent.value)
        for batch in texts:
            yield pd.Series(_scorers[name].scores(batch.tolist()), dtype="float64")

    return scored(F.col(text))
