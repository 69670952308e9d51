"""Language-model scoring: a hashed maximum-entropy model with class-factored softmax.

Counts of all words of the training texts give the vocabulary.  The most frequent words and bands of the others are
"slots", sixteen to a class; the model gives the chance of the class and of the slot in it from hashed features of the
context: the word before, the pair before, and the word before that alone (skip).  Inside a band, and for words outside
the shared vocabulary, counts share the chance out, so all chances of a place add up to one; a word that no training
text has is one type of its own, as in the base score.

Weights are trained by distributed gradient updates: in each round, every task walks down the gradient over its share of
all training texts, and the changes are averaged by bucket, weighted by how often a task has met it.  Words outside the
shared vocabulary are too many to send to every task; their counts are joined by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listing_lifecycle_spark.llm.arrow_text import mix, slices, stored, sums, words

SHARED = 65_536  # words that every task knows
SIDE = 16  # classes, and slots in a class
BANDS = 16
BITS = 14
BATCH = 8192
BLOCK = 1024  # buckets of weights in a row of the update
FAN = 16  # updates that are added up at once
FEATURES = 3
SPAN = 500.0  # exp(-SPAN) is still a normal number
END = ""  # no word is empty


@dataclass(frozen=True)
class Model:
    """Shared words with their counts and slots, totals, and weights.

    ``words[0]`` is the end of a text; number ``len(words)`` stands for any other word, one more for "before the start".
    """

    words: pa.Array
    counts: np.ndarray
    slot: np.ndarray
    inside: np.ndarray  # log10 chance of each shared word in its slot
    tokens: int
    types: int
    rare_tokens: int
    rare_once: int
    bias: np.ndarray  # by class, then by slot in its class
    slot_bias: np.ndarray
    weights: np.ndarray  # bucket, class
    slot_weights: np.ndarray  # bucket, slot

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.types + 1)))

    def unseen(self) -> float:
        """The chance that a word outside the shared vocabulary is one that training never had."""
        return min(0.99, (self.rare_once + 0.5) / (self.rare_tokens + 1)) if self.rare_tokens else 1.0


@dataclass(frozen=True)
class Stream:
    """Places of a slice of texts, the end of each text included: word number, those before, rows' offsets."""

    word: np.ndarray
    before: np.ndarray
    earlier: np.ndarray
    offsets: np.ndarray


def stream(column: pa.Array, shared: pa.Array) -> tuple[Stream, np.ndarray, pa.Array, np.ndarray]:
    codes, distinct, at = words(column, lower=True)
    number = pc.fill_null(pc.index_in(distinct, value_set=shared), len(shared)).to_numpy().astype(np.int64)
    rows = len(at) - 1
    offsets = at + np.arange(rows + 1)
    word = np.zeros(int(offsets[-1]), np.int64)  # the end is number 0
    inner = np.ones(len(word), bool)
    inner[offsets[1:] - 1] = False
    word[inner] = number[codes]
    start = len(shared) + 1
    before, earlier = np.full(len(word), start), np.full(len(word), start)
    before[1:], earlier[2:] = word[:-1], word[:-2]
    first = offsets[:-1]
    before[first] = start
    earlier[first] = start
    second = first + 1
    second = second[second < offsets[1:]]
    earlier[second] = start
    return Stream(word, before, earlier, offsets), codes, distinct, at


def buckets(before: np.ndarray, earlier: np.ndarray) -> list[np.ndarray]:
    """Hashed features of a place: the word before, the pair before, the word before that."""
    one, two = before.astype(np.uint64), earlier.astype(np.uint64)
    keys = (one << np.uint64(2), (one << np.uint64(32) | two << np.uint64(2)) + np.uint64(1), (two << np.uint64(2)) + np.uint64(2))
    return [mix(k + np.uint64(0x9E3779B97F4A7C15)) for k in keys]


def softmax(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chances of each row before they are divided by their sum, in place of ``logits``, and that sum."""
    top = logits.max()
    # One shift serves all rows unless it could make a row vanish; the largest of each short row takes far longer.
    logits -= top if top - logits.min() < SPAN else logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    return logits, np.einsum("ij->i", logits)


def met_by(keys: list[np.ndarray], group: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The buckets of each feature, for the class and for the slot in ``group``."""
    top = np.uint64(64 - BITS)
    first = [(k >> top).astype(np.int64) for k in keys]
    second = [(mix(k ^ (group.astype(np.uint64) + np.uint64(1))) >> top).astype(np.int64) for k in keys]
    return first, second


def chances(model: Model, first: list[np.ndarray], second: list[np.ndarray], group: np.ndarray):
    """Class chances and slot chances in ``group``, from their buckets, as :func:`softmax` gives them."""
    a, b = np.repeat(model.bias[None, :], len(group), axis=0), model.slot_bias.take(group, axis=0)
    for f, s in zip(first, second):
        a += model.weights.take(f, axis=0)
        b += model.slot_weights.take(s, axis=0)
    return softmax(a), softmax(b)


def powers(model: Model) -> Model | None:
    """``model`` with exp() of all biases and weights, each row less its largest; none where products could vanish.

    Chances are the same if a constant is taken from a row.
    """
    names = ("bias", "slot_bias", "weights", "slot_weights")
    tables = [t - t.max(axis=-1, keepdims=True) for t in (getattr(model, n).astype(np.float64) for n in names)]
    least = [float(t.min()) for t in tables]
    if min(least[0] + FEATURES * least[2], least[1] + FEATURES * least[3]) < -SPAN:
        return None
    return replace(model, **dict(zip(names, map(np.exp, tables))))


def products(ready: Model, first: list[np.ndarray], second: list[np.ndarray], group: np.ndarray):
    """What :func:`chances` gives, up to a factor for each row, from :func:`powers`."""
    a, b = ready.weights.take(first[0], axis=0), ready.slot_weights.take(second[0], axis=0)
    for f, s in zip(first[1:], second[1:]):
        a *= ready.weights.take(f, axis=0)
        b *= ready.slot_weights.take(s, axis=0)
    a *= ready.bias
    b *= ready.slot_bias.take(group, axis=0)
    return (a, np.einsum("ij->i", a)), (b, np.einsum("ij->i", b))


def log_chances(model: Model, places: Stream, ready: Model | None = None) -> np.ndarray:
    """log10 chance of each place; for words outside the shared vocabulary, that of their slot alone.

    ``ready`` is :func:`powers` of the model, which saves an exp() for each class and slot of each place.
    """
    out, inside = np.zeros(len(places.word)), np.append(model.inside, 0.0)
    slot = np.append(model.slot, SIDE * SIDE - 1)
    for begin in range(0, len(out), BATCH):
        own = slice(begin, begin + BATCH)
        group, place = np.divmod(slot[places.word[own]], SIDE)
        found = met_by(buckets(places.before[own], places.earlier[own]), group)
        (a, a_sum), (b, b_sum) = products(ready, *found, group) if ready else chances(model, *found, group)
        row = np.arange(len(group))
        out[own] = np.log10(a[row, group] / a_sum) + np.log10(b[row, place] / b_sum) + inside[places.word[own]]
    return out


@cache
def _cells(rows: int) -> np.ndarray:
    """The places of each row's cells in a table laid out flat."""
    return np.arange(rows * SIDE).reshape(rows, SIDE)


def add_rows(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """``table[at] += rows`` with repeated places."""
    np.add.at(table.reshape(-1), _cells(len(table)).take(at, axis=0).reshape(-1), rows.astype(table.dtype).reshape(-1))


def _descend(batches: Iterator[pa.RecordBatch], model: Model, rate: float) -> Iterator[pa.RecordBatch]:
    """Walk down the gradient over a task's texts: block, changes and counts of its buckets."""
    size = 1 << BITS
    model = replace(model, weights=model.weights.copy(), slot_weights=model.slot_weights.copy())
    tables, met = [model.weights, model.slot_weights], [np.zeros(size), np.zeros(size)]
    before = [t.copy() for t in tables]
    slot = np.append(model.slot, SIDE * SIDE - 1)
    for batch in slices(batches, 0):
        places, *_ = stream(batch.column(0), model.words)
        for begin in range(0, len(places.word), BATCH):
            own = slice(begin, begin + BATCH)
            group, place = np.divmod(slot[places.word[own]], SIDE)
            first, second = met_by(buckets(places.before[own], places.earlier[own]), group)
            (a, a_sum), (b, b_sum) = chances(model, first, second, group)
            row = np.arange(len(group))
            a /= a_sum[:, None]
            b /= b_sum[:, None]
            a[row, group] -= 1
            b[row, place] -= 1
            for table, error, found, times in ((tables[0], a, first, met[0]), (tables[1], b, second, met[1])):
                for f in found:
                    times += np.bincount(f, minlength=size)
                for f in found:
                    add_rows(table, f, -rate / np.sqrt(times[f])[:, None] * error)
    for start in range(0, size, BLOCK):
        own = slice(start, start + BLOCK)
        if met[0][own].any() or met[1][own].any():
            changes = [((t[own] - o[own]) * m[own, None]) for t, o, m in zip(tables, before, met)]
            body = [x.astype(np.float32).tobytes() for x in (*changes, met[0][own], met[1][own])]
            yield pa.RecordBatch.from_arrays([pa.array([start]), *[pa.array([x], pa.binary()) for x in body]], ["block", "classes", "slots", "met", "slots_met"])


UPDATE = "block bigint, classes binary, slots binary, met binary, slots_met binary"


def _add_updates(table: pa.Table) -> pa.Table:
    """The sum of some updates of a block, as one."""
    columns = []
    for name in ("classes", "slots", "met", "slots_met"):
        total = None
        for x in table.column(name):
            value = np.frombuffer(x.as_py(), np.float32)
            total = value.astype(np.float64) if total is None else total + value
        columns.append(pa.array([total.astype(np.float32).tobytes()], pa.binary()))
    return pa.Table.from_arrays([table.column("block").slice(0, 1), *columns, table.column("task").slice(0, 1)], ["block", "classes", "slots", "met", "slots_met", "task"])


def added_up(updates: DataFrame, fan: int = FAN) -> DataFrame:
    """One row for each block: the updates of all tasks added up in a tree, ``fan`` at a time.

    ``updates`` is a stored table with the number of the task that made them; no group holds more than ``fan`` rows, so
    it takes as many levels as the number of tasks has digits in base ``fan``.
    """
    width = (updates.agg(F.max("task")).first()[0] or 0) + 1
    while width > 1:
        grouped = updates.withColumn("task", F.floor(F.col("task") / fan).cast("int")).groupBy("block", "task")
        updates = grouped.applyInArrow(_add_updates, f"{UPDATE}, task int")
        width = -(-width // fan)
    return updates.drop("task")


def trained(model: Model, texts: DataFrame, rounds: int, rate: float) -> Model:
    """The model after ``rounds`` of updates; each round reads another share of the texts, all of them together all."""
    for i in range(rounds):
        share = texts.where(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(rounds)) == i).select("text")
        updates = share.mapInArrow(partial(_descend, model=model, rate=rate), UPDATE)
        total = added_up(stored(updates.withColumn("task", F.spark_partition_id()), "updates")).collect()  # a row for each block
        weights, slot_weights = model.weights.copy(), model.slot_weights.copy()
        for r in total:
            for table, change, met in ((weights, r.classes, r.met), (slot_weights, r.slots, r.slots_met)):
                n = np.frombuffer(met, np.float32)
                table[r.block : r.block + BLOCK] += np.frombuffer(change, np.float32).reshape(-1, SIDE) / np.maximum(n, 1)[:, None]
        model = replace(model, weights=weights, slot_weights=slot_weights)
    return model


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 0):
        codes, distinct, _ = words(batch.column(0), lower=True)
        yield pa.RecordBatch.from_arrays([distinct, pa.array(np.bincount(codes, minlength=len(distinct)).astype(np.int64))], ["word", "times"])


def most_frequent(counts: DataFrame, bound: int) -> list:
    """The ``bound`` most frequent words, or all if there are fewer, with their counts; of equal counts, by word.

    Words are counted by band of frequency (a few hundred bands, whatever the size); whole bands are taken from the top
    while they fit.  The first that doesn't is sorted, and as many of its words as there is room for are taken.  No more
    than ``bound`` words reach the driver from all tasks together.
    """
    band = F.floor(F.log2("times") * 8).cast("int")
    bands = sorted(((r.band, r.n) for r in counts.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, total, over = None, 0, None
    for number, n in bands:
        if total + n > bound:
            over = number
            break
        least, total = number, total + n
    rows = [] if least is None else counts.where(band >= least).collect()
    if over is not None and total < bound:
        # Ids grow with the order: the number of the task, 33 bits, and the place of the row in it.
        order = counts.where(band == over).orderBy(F.desc("times"), "word").withColumn("at", F.monotonically_increasing_id())
        order, left = stored(order, "band"), bound - total
        for task, n in sorted((r.task, r.n) for r in order.groupBy(F.shiftright("at", 33).alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()):
            if n >= left:
                rows += order.where(F.col("at") < (task << 33) + left).select("word", "times").collect()
                break
            left -= n
    return sorted(rows, key=lambda r: (-r.times, r.word))


def start(top: list[tuple[str, int]], texts: int, tokens: int, types: int, once: int) -> Model:
    """The model of the counts alone, before any training."""
    counts = np.array([texts, *[n for _, n in top]], np.int64)
    shared = pa.array([END, *[w for w, _ in top]], pa.string())
    single = SIDE * SIDE - 1 - BANDS
    place = np.arange(len(counts))
    edges = np.geomspace(single, max(SHARED + 1, single + 1), BANDS + 1)
    slot = np.where(place < single, place, single + np.clip(np.searchsorted(edges, place, side="right") - 1, 0, BANDS - 1))
    mass = np.bincount(slot, counts, minlength=SIDE * SIDE).astype(float)
    inside = np.log10(np.maximum(counts, 0.5) / np.maximum(mass[slot], 0.5))
    rare = tokens - int(counts.sum())
    mass[-1] = rare
    mass += 0.01  # no slot is impossible
    square = mass.reshape(SIDE, SIDE)
    once -= int((counts[1:] == 1).sum())
    zero = np.zeros((1 << BITS, SIDE), np.float32)
    return Model(shared, counts, slot, inside, tokens, types, rare, max(once, 0), np.log(square.sum(axis=1)), np.log(square), zero, zero.copy())


SCORED = "row bigint, doc_id bigint, word string, times bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    base = np.append(model.base(model.counts), 0.0)
    known = np.append(model.counts > 0, False)
    ready = powers(model)
    for batch in slices(batches):
        places, codes, distinct, at = stream(batch.column(1), model.words)
        score, n = sums(log_chances(model, places, ready), places.offsets), np.diff(places.offsets)
        base_part, n_known = sums(base[places.word], places.offsets), sums(known[places.word], places.offsets)
        other = np.flatnonzero(places.word == len(model.words))
        row = np.searchsorted(at + np.arange(len(at)), other, side="right") - 1  # each row before has an end besides its words
        key, times = np.unique(row * (len(distinct) + 1) + codes[other - row], return_counts=True)
        own, code = np.divmod(key, len(distinct) + 1)
        # A row for each word outside the shared vocabulary; the first of a text, or a row of its own, has the sums.
        none = np.setdiff1d(np.arange(batch.num_rows), own)
        all_rows = np.concatenate([own, none])
        first = np.ones(len(all_rows), bool)
        first[1 : len(own)] = own[1:] != own[:-1]
        ids = batch.column(0).to_numpy()
        word = pa.concat_arrays([distinct.take(pa.array(code)).cast(pa.string()), pa.array([f" {i}" for i in ids[none]], pa.string())])
        columns = [pa.array(ids[all_rows]), batch.column(2).take(pa.array(all_rows)), word, pa.array(np.concatenate([times, np.zeros(len(none), np.int64)]))]
        columns += [pa.array(np.where(first, x[all_rows], 0)) for x in (n, n_known, base_part, score)]
        yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "word", "times", "n_tokens", "n_known", "base_score", "score"])


def score(docs: DataFrame, trained_on: Column, rounds: int = 2, rate: float = 0.5) -> DataFrame:
    """Learn from the texts that meet ``trained_on`` and score all: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words (A-Z lower-cased), then one end for each text.  base_score is the sum of log10((c + 0.5) / (N + 0.5
    * (V + 1))) over tokens, with the counts, number and types of training tokens; n_known counts tokens with c > 0;
    score is the model's log10 chance of the text.  A row for each row of ``docs``: a null, empty or blank text is its
    end only; null doc_ids and repeated rows stay, and rows for which ``trained_on`` is null are not trained on; an
    empty table gives none.  Without any training text every word is unknown.
    """
    read = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = read.where(trained_on)
    counted = texts.select("text").mapInArrow(_count, "word string, times bigint")
    counts = stored(counted.groupBy("word").agg(F.sum("times").alias("times")), "counts")
    ends = texts.count()
    total = counts.agg(F.sum("times").alias("tokens"), F.count(F.lit(1)).alias("types"), F.count(F.when(F.col("times") == 1, 1)).alias("once")).first()
    top = most_frequent(counts, SHARED)
    tokens, types = (total.tokens or 0) + ends, total.types + (ends > 0)
    model = start([(r.word, r.times) for r in top], ends, tokens, types, total.once)
    model = trained(model, texts, rounds, rate)
    rows = read.withColumn("row", F.monotonically_increasing_id())
    scored = rows.select("row", "text", "doc_id").mapInArrow(partial(_score, model=model), SCORED)
    # Shared words never occur in ``scored``: their sums are in already.
    joined = scored.join(counts.withColumnRenamed("times", "c"), "word", "left")
    c, times = F.coalesce("c", F.lit(0)), F.col("times")
    unseen, rare = model.unseen(), max(model.rare_tokens, 1)
    word_score = F.when(c > 0, F.log10(F.lit(1 - unseen) * c / F.lit(float(rare)))).otherwise(F.lit(float(np.log10(unseen))))
    base = F.log10((c + 0.5) / F.lit(tokens + 0.5 * (types + 1)))
    parts = joined.select(
        "row", "doc_id", "n_tokens", (F.col("n_known") + F.when(c > 0, times).otherwise(0)).alias("n_known"),
        (F.col("base_score") + F.when(times > 0, times * base).otherwise(0.0)).alias("base_score"), (F.col("score") + F.when(times > 0, times * word_score).otherwise(0.0)).alias("score"),
    )
    summed = parts.groupBy("row", "doc_id").agg(*[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base_score", "score")])
    return summed.select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
