"""Licence scans with a trained paragraph classifier.

Paragraphs (lines) are read in windows of words, and so is text that runs on over line ends, up to a blank line.  A logistic regression over sparse word n-grams names the licence
family of a window or the class "unknown"; it is trained on edited licence wordings and on windows of a bounded sample
of the corpus.  A prediction counts above a probability that held-out unknown windows do not reach, and if the window
also agrees with a wording of the predicted family.  A wording of fewer than ``PAIRS`` word pairs ("All rights reserved.",
"MIT License", "SPDX-License-Identifier: MIT") counts as a line of its own, word for word, with or without comment marks, or
as the end of a copyright line.  Words that are punctuation alone are no words here.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listing_lifecycle_spark.llm.arrow_text import mix, slices, spread, words
from listing_lifecycle_spark.llm.licence_texts import TEMPLATES, short_notices
from listing_lifecycle_spark.llm.rules import least_hashes

WINDOW, STRIDE = 24, 12
BITS = 14
FAMILIES = ["unknown", *sorted(TEMPLATES)]
#: Share of the shorter side's word pairs that a window and a wording have in common, at least, and their number.
ALIKE, PAIRS = 0.6, 3
#: Words of the wordings that any text has; a pair with another word of theirs hints at a licence.
COMMON = frozenset("a above all an and any are as at be by can either except for from has have if in into is it its may no nor not of on or other shall that the their they this to under use with without you your".split())


def every_wording() -> list[tuple[str, str]]:
    """Family and text of all wordings, the short ones among them."""
    return [(family, t) for family, texts in sorted(TEMPLATES.items()) for t in [*texts, *short_notices(family)]]


@cache
def vocabulary() -> pa.Array:
    """Words of all wordings, lower-case and without outer punctuation."""
    found = {w.lower().strip(string.punctuation) for _, t in every_wording() for w in t.split()}
    return pa.array(sorted(found - {""}))


def tokens(distinct: pa.Array) -> np.ndarray:
    """The number of each distinct word in the vocabulary from 1 on; 0 for any other word."""
    plain = pc.ascii_trim(pc.ascii_lower(distinct), characters=string.punctuation)
    return pc.fill_null(pc.index_in(plain, value_set=vocabulary()), -1).to_numpy().astype(np.int64) + 1


def template_tokens(text: str) -> list[int]:
    return tokens(pa.array(text.split())).tolist()


def pairs(row) -> set[tuple[int, int]]:
    """Neighbouring words that are both known."""
    return {(a, b) for a, b in zip(row, row[1:]) if a and b}


@cache
def wordings() -> list[tuple[str, frozenset]]:
    return [(family, frozenset(pairs(template_tokens(t)))) for family, t in every_wording()]


@cache
def pair_table(telling: bool = False) -> np.ndarray:
    """Whether a wording has the pair, by the numbers of its words; with ``telling``, those of two common words left out."""
    size = len(vocabulary()) + 1
    table = np.zeros((size, size), bool)
    for _, wording in wordings():
        for a, b in wording:
            table[a, b] = True
    if telling:
        common = np.array([True, *[w in COMMON for w in vocabulary().to_pylist()]])
        table &= ~(common[:, None] & common)
    return table


@cache
def short() -> dict[tuple[int, ...], str]:
    """Families of the wordings that have too few pairs to be told inside other text, by their tokens."""
    known = {tuple(template_tokens(t)): family for family, t in every_wording()}
    return {row: family for row, family in known.items() if len(pairs(row)) < PAIRS}


def agreement(row, family: str) -> float:
    """How far a window agrees with the nearest wording of the family; 0 with fewer than ``PAIRS`` common pairs, unless
    the window is a short wording and nothing else (so few words are a window only if they are all of a line)."""
    return agreements(row).get(family, 0.0)


def agreements(row) -> dict[str, float]:
    """:func:`agreement` by family, those without any left out."""
    own, best = pairs(row), {}
    for name, wording in wordings():
        if len(both := own & wording) >= PAIRS:
            best[name] = max(best.get(name, 0.0), len(both) / min(len(own), len(wording)))
    if family := short().get(tuple(row)):
        best[family] = 1.0
    return best


def buckets(row) -> np.ndarray:
    """Distinct buckets of a window's words, pairs and triples; those of unknown words alone are left out but for one."""
    row = np.asarray(row, np.uint64)
    out = []
    for n in (1, 2, 3):
        if len(row) >= n:
            key, any_ = np.full(len(row) - n + 1, n, np.uint64), np.zeros(len(row) - n + 1, bool)
            for k in range(n):
                part = row[k : len(row) - n + 1 + k]
                key, any_ = key * np.uint64(1 << 16) + part, any_ | (part > 0)
            out.append(key[any_ | (n == 1)])
    return np.unique(mix(np.concatenate(out)) >> np.uint64(64 - BITS)).astype(np.int64) if out else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Model:
    """Weights by bucket and family, biases, the least probability, and the pairs of words that wordings have."""

    weights: np.ndarray
    bias: np.ndarray
    least: float
    cues: np.ndarray

    def chances(self, row) -> np.ndarray:
        own = buckets(row)
        logits = self.weights[own].sum(axis=0) / np.sqrt(max(len(own), 1)) + self.bias
        value = np.exp(logits - logits.max())
        return value / value.sum()

    def find(self, row) -> tuple[str, float, float] | None:
        """Family, probability and agreement of a window, or nothing."""
        alike = agreements(row)
        if max(alike.values(), default=0.0) < ALIKE:
            return None
        chance = self.chances(row)
        k = int(chance.argmax())
        if k and chance[k] >= self.least and alike.get(FAMILIES[k], 0.0) >= ALIKE:
            return FAMILIES[k], float(chance[k]), alike[FAMILIES[k]]
        return None


def windows(batch_text: pa.Array):
    """Paragraphs as tokens, and windows in them: tokens, and for each window row, paragraph, first word, end.

    Windows are ``WINDOW`` words at steps of ``STRIDE``; the last one ends with the paragraph."""
    return _windows(*_lines(batch_text))


def _lines(batch_text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line of each row, tokens, first word of each line."""
    lines = pc.split_pattern(batch_text, "\n")
    at = lines.offsets.to_numpy().astype(np.int64) - lines.offsets[0].as_py()
    codes, distinct, edges = words(lines.flatten())
    if len(codes):
        marks = pc.equal(pc.ascii_trim(distinct, characters=string.punctuation), "").to_numpy(zero_copy_only=False)
        keep = ~marks[codes]
        edges, codes = np.concatenate([[0], np.cumsum(keep)])[edges], codes[keep]
    return at, tokens(distinct)[codes] if len(codes) else codes, edges


def _steps(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows in stretches of words: stretch, first word, end."""
    size = end - begin
    n = np.where(size == 0, 0, 1 + np.maximum(0, -(-(size - WINDOW) // STRIDE)))
    own = np.repeat(np.arange(len(size)), n)
    step = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    first = begin[own] + np.minimum(step * STRIDE, np.maximum(size[own] - WINDOW, 0))
    return own, first, np.minimum(first + WINDOW, end[own])


def _copyright_lines(token: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Lines that begin with the word "copyright"."""
    filled = np.flatnonzero(np.diff(edges) > 0)
    return filled[token[edges[:-1][filled]] == template_tokens("copyright")[0]]


def _windows(at: np.ndarray, token: np.ndarray, edges: np.ndarray):
    line, first, stop = _steps(edges[:-1], edges[1:])
    owner = _copyright_lines(token, edges)
    for size in sorted({len(t) for t in short()}):  # the end of a copyright line may be a short notice
        own = owner[np.diff(edges)[owner] > size]
        line, first, stop = np.concatenate([line, own]), np.concatenate([first, edges[own + 1] - size]), np.concatenate([stop, edges[own + 1]])
    row = np.searchsorted(at, line, side="right") - 1
    return token, row, line - at[row], first, stop, edges[:-1][line]


def _line_of(word: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges, word, side="right") - 1


def crossing(at: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that run over an end of line, in stretches of lines of a row without a blank one: first word, end."""
    filled = np.diff(edges) > 0
    opens = filled.copy()
    opens[1:] &= ~filled[:-1]
    opens[at[:-1][at[:-1] < len(filled)]] = filled[at[:-1][at[:-1] < len(filled)]]
    begin = edges[:-1][opens]
    _, first, stop = _steps(begin, np.append(begin[1:], edges[-1])[: len(begin)])
    over = _line_of(first, edges) < _line_of(stop - 1, edges)
    return first[over], stop[over]


def span(row, family: str) -> tuple[int, int, int]:
    """The shortest part of a window with all pairs that it shares with the nearest wording of the family: first word,
    end, number of pairs."""
    own = pairs(row)
    shared = max((own & wording for name, wording in wordings() if name == family), key=len)
    places = [(i, p) for i, p in enumerate(zip(row, row[1:])) if p in shared]
    best, last = (0, len(row)), {}
    for i, p in places:
        last[p] = i
        if len(last) == len(shared) and i + 2 - min(last.values()) <= best[1] - best[0]:
            best = (min(last.values()), i + 2)
    return *best, len(shared)


def _negatives(batches: Iterator[pa.RecordBatch], each: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        token, row, _, first, stop, _ = windows(batch.column(1))
        known = np.concatenate([[0], np.cumsum(token > 0)])
        order = np.lexsort((mix(first.astype(np.uint64)), row))  # some of each text, from anywhere in it
        place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        some = order[place < each]
        some = some[known[stop[some]] > known[first[some]]]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(stop[some] - first[some])]), pa.int32()), pa.array(token[spread(first[some], stop[some] - first[some])].astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[some])), pa.array(first[some] - first[np.searchsorted(row, row[some])]), lists], ["doc_id", "place", "tokens"])


def edited(text: str, random: np.random.Generator, other: list[list[int]]) -> list[int]:
    """A licence wording as it may stand in a window: cut, words lost, other words (of the corpus) around it."""
    row = template_tokens(text)
    if tuple(row) in short():
        return row
    if len(row) > 10 and random.random() < 0.5:
        size = int(random.integers(10, len(row) + 1))
        begin = int(random.integers(0, len(row) - size + 1))
        row = row[begin : begin + size]
    if len(row) > 6:
        row = [t if random.random() > 0.05 else 0 for t in row]
    room = max(0, WINDOW - len(row))
    before = int(random.integers(0, room + 1)) if random.random() < 0.5 else 0
    after = int(random.integers(0, room - before + 1))
    noise = other[int(random.integers(len(other)))] if other else []
    noise = [*noise, *[0] * WINDOW]
    return noise[:before] + row + noise[before : before + after]


def descend(rows: list[tuple[np.ndarray, int]], epochs: int, rate: float, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    weights, bias = np.zeros((1 << BITS, len(FAMILIES))), np.zeros(len(FAMILIES))
    for epoch in range(epochs):
        now = rate / (1 + epoch)
        for i in random.permutation(len(rows)):
            own, y = rows[i]
            scale = 1 / np.sqrt(max(len(own), 1))
            logits = weights[own].sum(axis=0) * scale + bias
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[y] -= 1
            weights[own] -= now * scale * error
            bias -= 0.1 * now * error
    return weights, bias


def fit(docs: DataFrame, sample: int = 2000, each: int = 4, copies: int = 60, epochs: int = 6, rate: float = 1.0, seed: int = 5) -> Model:
    """Train on edited wordings and on windows of at most ``sample`` documents (those with the least hash of their id),
    ``each`` from a text; windows that agree with a wording, or have a pair of a wording beyond common words, are not
    taken as unknown: however many notes of licences a corpus has, none is learned from as a text without.

    A fifth of the windows is held out: the least probability is above all but one in a thousand of the unknown ones
    there, and 0.5 at least.
    """
    random = np.random.default_rng(seed)
    chosen = least_hashes(docs.where("doc_id IS NOT NULL").select("doc_id").distinct(), sample, 3)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text")
    found = texts.mapInArrow(partial(_negatives, each=each), "doc_id bigint, place bigint, tokens array<int>").dropDuplicates(["doc_id", "place"]).orderBy("doc_id", "place").collect()
    telling = pair_table(telling=True)
    unknown = [r.tokens for r in found if not telling[r.tokens[:-1], r.tokens[1:]].any() and max(agreements(r.tokens).values(), default=0.0) < ALIKE]
    known = [(edited(t, random, unknown), FAMILIES.index(family)) for family, t in every_wording() for _ in range(copies)]
    rows = [(buckets(r), y) for r, y in [(r, 0) for r in unknown] + known]
    order = random.permutation(len(rows))
    held = {int(i) for i in order[: len(rows) // 5]}
    weights, bias = descend([rows[i] for i in range(len(rows)) if i not in held], epochs, rate, random)
    model = Model(weights, bias, 0.0, pair_table())
    top = sorted(float(model.chances(unknown[i])[1:].max()) for i in held if i < len(unknown))
    least = max(0.5, top[min(len(top) - 1, int(len(top) * 0.999))]) if top else 0.5
    return Model(weights, bias, least, pair_table())


SCHEMA = "doc_id bigint, paragraph int, first_word int, n_words int, family string, probability double, agreement double"


def _worth(token: np.ndarray, first: np.ndarray, stop: np.ndarray, model: Model) -> np.ndarray:
    """Windows that may agree with a wording: that takes ``PAIRS`` different pairs of it, or a short wording and nothing else."""
    cue = np.concatenate([[0], np.cumsum(model.cues[token[:-1], token[1:]])])
    some = cue[np.maximum(stop - 1, first)] - cue[first]
    return np.flatnonzero((some >= PAIRS) | ((some > 0) & (stop - first <= max(map(len, short()), default=0))))


def _add_crossing(best: dict[tuple[int, int, str], tuple], at: np.ndarray, token: np.ndarray, edges: np.ndarray, model: Model) -> None:
    """Add notices that run over line ends to those of single lines: words that are part of one already don't count
    again, and a line's notice that is a piece of a longer one of another family gives way to it."""
    first, stop = crossing(at, edges)
    hits = []
    for i in _worth(token, first, stop, model):
        own = token[first[i] : stop[i]].tolist()
        if hit := model.find(own):
            hits.append((-span(own, hit[0])[2], int(first[i]), own, hit))
    if not hits:
        return
    def words_of(key: tuple[int, int, str]) -> list[int]:
        begin = int(edges[at[key[0]] + key[1]]) - best[key][1]
        return token[begin : begin + best[key][2]].tolist()

    taken = {(int(at[key[0]]) + key[1], key[2]): [(int(edges[at[key[0]] + key[1]]), int(edges[at[key[0]] + key[1] + 1]))] for key in best if tuple(words_of(key)) not in short()}
    for _, begin, own, hit in sorted(hits, key=lambda h: h[:2]):
        row = int(np.searchsorted(at, _line_of(begin, edges), side="right")) - 1
        lines = range(int(_line_of(begin, edges)), int(_line_of(begin + len(own) - 1, edges)) + 1)
        used = [(max(a - begin, 0), min(b - begin, len(own))) for k in lines for a, b in taken.get((k, hit[0]), ()) if a < begin + len(own) and b > begin]
        if used:
            own = list(own)
            for a, b in used:
                own[a:b] = [0] * (b - a)
            again = model.find(own)
            if again is None or again[0] != hit[0]:
                continue
            hit = again
        a, b, n = span(own, hit[0])
        line = int(_line_of(begin + a, edges))
        for key in [(row, k - int(at[row]), f) for k in lines for f in FAMILIES[1:] if (row, k - int(at[row]), f) in best]:
            own_words = words_of(key)
            if key[2] == hit[0] and tuple(own_words) not in short():
                continue
            start = int(edges[at[row] + key[1]]) - best[key][1]
            c, d, m = span(own_words, key[2])
            if m < n and begin + a <= start + c and start + d <= begin + b:
                del best[key]
        key, value = (row, line - int(at[row]), hit[0]), (hit[1] * hit[2], -(begin + a - int(edges[line])), b - a, *hit[1:])
        best[key] = max(best.get(key, value), value)
        for k in lines:
            taken.setdefault((k, hit[0]), []).append((begin + a, begin + b))


def _scan(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        at, token, edges = _lines(batch.column(1))
        _, row, line, first, stop, begin = _windows(at, token, edges)
        best: dict[tuple[int, int, str], tuple] = {}
        for i in _worth(token, first, stop, model):
            own = token[first[i] : stop[i]].tolist()
            if hit := model.find(own):
                key, value = (int(row[i]), int(line[i]), hit[0]), (hit[1] * hit[2], -int(first[i] - begin[i]), int(stop[i] - first[i]), *hit[1:])
                best[key] = max(best.get(key, value), value)
        _add_crossing(best, at, token, edges, model)
        keys = sorted(best)
        values = [best[k] for k in keys]
        columns = [batch.column(0).take(pa.array([k[0] for k in keys], pa.int64())), pa.array([k[1] for k in keys], pa.int32()), pa.array([-v[1] for v in values], pa.int32()), pa.array([v[2] for v in values], pa.int32())]
        columns += [pa.array([k[2] for k in keys], pa.string()), pa.array([v[3] for v in values], pa.float64()), pa.array([v[4] for v in values], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "paragraph", "first_word", "n_words", "family", "probability", "agreement"])


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """Licences in whole texts: doc_id, paragraph (line from 0), first_word, n_words, family, probability, agreement.

    A row for each paragraph and family that a window of it is found to name, with the window that does so best; a notice
    that runs on over line ends is a row of the line where it begins, and its n_words go on into the next lines.  Texts
    without any give no row, nor do null, empty or blank ones.  Rows with a null doc_id keep it; repeated rows give
    repeated results; an empty table gives none.
    """
    return docs.select("doc_id", "text").mapInArrow(partial(_scan, model=model), SCHEMA)
