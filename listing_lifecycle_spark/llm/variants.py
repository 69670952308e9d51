"""Spelling variants: words one letter apart, found by products of letter-count matrices.

Two words that differ by one replaced letter have the same length and letter counts at squared distance two; with one
letter more or less, lengths differ by one and the squared distance is one.  Words are blocked by how many letters they
have of each of a few letter groups (so by length, too); a near word lies in the same block or one of a few others.  In
tiles of bounded size a matrix product gives all squared distances at once, pairs of distance two at most are compared
letter by letter, and a tile returns one row for each word with a near one, not its pairs.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listing_lifecycle_spark.llm.arrow_text import raw, release, row_of, slices, stored
from listing_lifecycle_spark.llm.runs import crc32_of, joined_crc32, runs

LETTERS = "".join(map(chr, [*range(97, 123), *range(0xC0, 0x100)]))  # a-z and À-ÿ
GROUPS = 5  # letter groups of a block
OWNERS, VISITORS = 2048, 8192  # words of a tile, about
STRIP = 256  # rows of a product at once


def letter_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 belong to A-Z, a-z or U+00C0 to U+00FF (two bytes, of which the first is C3)."""
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    first = data == 0xC3
    second = np.zeros(len(data), bool)
    second[1:] = first[:-1]
    return ascii_letter & (data < 128) | first | second


def _count(batches: Iterator[pa.RecordBatch], every: int, least: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        flat, at = runs(batch.column(1), letter_bytes)
        coded = flat.dictionary_encode()
        distinct, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        counts = np.bincount(codes, minlength=len(distinct))
        extra: Counter[str] = Counter()
        if every and len(codes):
            ids = pc.fill_null(batch.column(0).cast(pa.string()), "").to_pylist()
            first = np.fromiter((zlib.crc32(f"{i}:".encode()) for i in ids), np.uint32, len(ids))
            size = np.diff(raw(distinct)[1])
            h = joined_crc32(first[row_of(at)], crc32_of(distinct)[codes], size[codes])
            hit = np.flatnonzero(h % np.uint32(every) == 0)
            counts -= np.bincount(codes[hit], minlength=len(distinct))
            for word, number in zip(distinct.take(pa.array(codes[hit])).to_pylist(), h[hit].tolist()):
                place = number % len(word)
                extra[word[:place] + word[place + 1 :]] += 1
        keep = (counts > 0) & (pc.utf8_length(distinct).to_numpy() >= least)
        more = {w: n for w, n in extra.items() if len(w) >= least}
        words = pa.concat_arrays([distinct.filter(pa.array(keep)), pa.array(list(more), pa.string())])
        yield pa.RecordBatch.from_arrays([words, pa.array(np.concatenate([counts[keep], np.array(list(more.values()), np.int64)]))], ["word", "n"])
    release()


def word_counts(docs: DataFrame, least_letters: int = 5, least_count: int = 3, every: int = 97) -> DataFrame:
    """word, n: words of at least ``least_letters`` code points that occur at least ``least_count`` times in all texts.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased.  Where ``every`` divides the unsigned CRC-32
    of ``<doc_id>:<word>``, an occurrence has lost the code point at that number modulo its length; 0 deletes none.
    """
    schema = "word string, n bigint"
    rows = docs.select("doc_id", "text").mapInArrow(partial(_count, every=every, least=least_letters), schema)
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def with_blocks(words: DataFrame, groups: int) -> DataFrame:
    """word, n, block: how many letters of each group (code point modulo ``groups``) a word has."""
    own = ["".join(c for c in LETTERS if ord(c) % groups == g) for g in range(groups)]
    counts = [F.char_length("word") - F.char_length(F.translate("word", letters, "")) for letters in own]
    return words.select("word", "n", F.array(*counts).alias("block"))


def visits(rows: DataFrame, groups: int) -> DataFrame:
    """word, n, block, at_home: each word in its own block and in those others where it looks for near words.

    Of two neighbouring blocks only one sends its words: the shorter words visit the longer, and for a replaced letter
    the block with more of the earlier group visits.
    """
    def moved(up: int, down: int | None = None):
        block = F.array(*[F.col("block")[g] + (int(g == up) - int(g == down)) for g in range(groups)])
        return block if down is None else F.when(F.col("block")[down] > 0, block)

    others = [moved(g) for g in range(groups)] + [moved(j, i) for i in range(groups) for j in range(i + 1, groups)]
    away = rows.select("word", "n", F.explode(F.array_compact(F.array(*others))).alias("block"), F.lit(False).alias("at_home"))
    return rows.select("word", "n", F.col("block").alias("block"), F.lit(True).alias("at_home")).union(away)


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letter-count vectors, and the letters themselves (padded with 255), of words that have one length each."""
    texts = words.to_pylist()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("latin-1"), np.uint8)
    code = np.where(flat >= 0xC0, flat - np.uint8(0xC0 - 26), flat - np.uint8(97))
    row = np.repeat(np.arange(len(texts)), lengths)
    vectors = np.bincount(row * len(LETTERS) + code, minlength=len(texts) * len(LETTERS)).reshape(-1, len(LETTERS))
    padded = np.full((len(texts), int(lengths.max())), 255, np.uint8)
    padded[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = code
    return vectors, padded


def replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two matrices of letters differ in one place."""
    return (a != b).sum(axis=1) == 1


def inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which rows of ``long``, one column wider, are those of ``short`` with one letter put in."""
    size = short.shape[1]
    head, tail = short != long[:, :size], short != long[:, 1:]
    first = np.where(head.any(axis=1), head.argmax(axis=1), size)  # the letters before are equal
    last = np.where(tail.any(axis=1), size - tail[:, ::-1].argmax(axis=1), 0)  # those from here on are equal, one place on
    return last <= first


def _tile(left: pa.Table, right: pa.Table) -> pa.Table:
    """For each word of a tile with near words in it: how many, and the best, most frequent first, then least word."""
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    own, visitor = (t.column(c).combine_chunks() for t, c in ((left, "word"), (right, "visitor")))
    n_own, n_visitor = left.column("n").to_numpy(), right.column("visitor_n").to_numpy()
    home = right.column("at_home").to_numpy(zero_copy_only=False)
    x, x_letters = _letters(own)
    rank_own, rank_visitor = np.split(_ranks(pa.concat_arrays([own, visitor])), [len(own)])
    kind = np.float32 if x_letters.shape[1] < 4000 else np.float64  # products are exact: below 2^24 or 2^53
    x = x.astype(kind)
    sides: list[tuple[np.ndarray, np.ndarray]] = []
    # Visitors have the owners' length, or are one letter shorter.
    lengths = pc.utf8_length(visitor).to_numpy()
    for same in (True, False):
        which = np.flatnonzero((lengths == x_letters.shape[1]) == same)
        if not len(which):
            continue
        y, y_letters = _letters(visitor.take(pa.array(which)))
        y, y_square = y.astype(kind), (y * y).sum(axis=1)
        for begin in range(0, len(x), STRIP):
            strip = x[begin : begin + STRIP]
            distance = (strip * strip).sum(axis=1)[:, None] + y_square - 2 * (strip @ y.T)
            i, j = np.nonzero(distance == (2 if same else 1))
            i += begin
            if same:  # words of one block meet twice
                once = ~home[which[j]] | (rank_own[i] < rank_visitor[which[j]])
                i, j = i[once], j[once]
            for at in range(0, len(i), 1 << 16):
                a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                near = replaced(x_letters[a], y_letters[b]) if same else inserted(y_letters[b], x_letters[a])
                sides.append((a[near], which[b[near]]))
    if not sides:
        return schema.empty_table()
    i, j = (np.concatenate(s) for s in zip(*sides))
    parts = [_best(own, i, visitor, j, n_visitor, rank_visitor), _best(visitor, j, own, i, n_own, rank_own)]
    return pa.concat_tables([p.cast(schema) for p in parts])


def _ranks(words: pa.Array) -> np.ndarray:
    """Numbers that order words by code point; equal words have the same."""
    coded = words.dictionary_encode()
    place = np.empty(len(coded.dictionary), np.int64)
    place[pc.sort_indices(coded.dictionary.cast(pa.binary())).to_numpy()] = np.arange(len(place))
    return place[coded.indices.to_numpy()]


def _best(words: pa.Array, i: np.ndarray, others: pa.Array, j: np.ndarray, n: np.ndarray, rank: np.ndarray) -> pa.Table:
    order = np.lexsort((rank[j], -n[j], i))
    i, j = i[order], j[order]
    first = np.flatnonzero(np.diff(i, prepend=-1))
    counts = np.diff(np.append(first, len(i)))
    columns = [words.take(pa.array(i[first])), pa.array(counts), pa.array(n[j[first]]), others.take(pa.array(j[first]))]
    return pa.Table.from_arrays(columns, ["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, groups: int = GROUPS, owners: int = OWNERS, visitors: int = VISITORS) -> DataFrame:
    """word, n_near, best_n, best of every word with a near one: how many, and the most frequent (ties: least word).

    ``words`` (word, n) is a stored table of distinct words of the letters in ``LETTERS``.
    """
    rows = with_blocks(words, groups)
    coming = visits(rows, groups)
    home = rows.groupBy("block").agg(F.count(F.lit(1)).alias("owners"))
    came = coming.select("block").groupBy("block").agg(F.count(F.lit(1)).alias("visitors"))
    parts = lambda c, most: F.ceil(F.col(c) / most).cast("int")
    sizes = stored(home.join(came, "block").where("visitors > 1").select("block", parts("owners", owners).alias("down"), parts("visitors", visitors).alias("across")), "blocks")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda n: F.pmod(F.xxhash64("word"), F.col(n)).cast("int")
    left = rows.join(sizes, "block").select("block", "word", "n", deal("down").alias("i"), each("across").alias("j"))
    right = coming.join(sizes, "block").select("block", F.col("word").alias("visitor"), F.col("n").alias("visitor_n"), "at_home", each("down").alias("i"), deal("across").alias("j"))
    keys = ("block", "i", "j")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_tile, "word string, n_near bigint, best_n bigint, best string")
    top = F.min(F.struct((-F.col("best_n")).alias("fall"), "best")).alias("top")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top).select("word", "n_near", (-F.col("top.fall")).alias("best_n"), F.col("top.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every row of ``forms`` (word, form): from the word, forms are followed to the last.

    Every round a word takes the root that its root has so far, so a chain of forms shortens by half.
    """
    now, changed = forms.select("word", F.col("form").alias("root")), True
    while changed:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stored(now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        changed = bool(step.where("moved").limit(1).count())
        now = step.select("word", "root")
    return now


def spelling_variants(docs: DataFrame, least_letters: int = 5, least_count: int = 3, ratio: int = 2, every: int = 97, groups: int = GROUPS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of :func:`word_counts`.

    Two words are near if they differ by one inserted, deleted or replaced code point; n_near counts a word's near words.
    ``form`` is the near word of largest n (ties: least in code-point order) if that is at least ``ratio`` * the word's own,
    else null; ``root`` is the last of the forms that follow from the word, or the word.  ``ratio`` is at least 2, so forms
    never go in a circle.  Null, empty and letterless texts have no words; a null doc_id counts as an empty one in the
    CRC; repeated rows count each; other columns are not read; an empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    words = stored(word_counts(docs, least_letters, least_count, every), "words")
    near = words.join(near_words(words, groups), "word", "left")
    has = F.col("best_n") >= ratio * F.col("n")
    joined = stored(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "forms")
    ends = roots(joined.where("form IS NOT NULL").select("word", "form"))
    return joined.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
