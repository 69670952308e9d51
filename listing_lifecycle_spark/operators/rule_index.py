"""An index over alert rules, and listings matched against it in Arrow batches.

A rule is filed under its place (subregion, region, island, or the places it allows); of those that meet a listing's
places, only the ones whose sit length and start month can fit are looked at.  Listings with equal place, length class
and start month share one list of candidates.  The other conditions are checked on arrays of pairs, and the keywords of
all rules are looked up at once by one automaton over the folded text.  Wide rows are never repeated: a pair is two
numbers until it has passed everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import numpy as np
import pyarrow as pa

from listing_lifecycle_spark import fixed_values as fv

PLACES = ("island", "region", "subregion")
LISTS = {"island": "allowed_islands", "region": "allowed_regions", "subregion": "allowed_subregions", "house_type": "allowed_house_types"}
CODES = list(fv.SIT_LENGTH_CODES)
PAIRS = 1 << 21  # pairs that are checked at once, about
EPOCH = date(1970, 1, 1)


def _numbers(column: pa.Array) -> np.ndarray:
    """Numbers or days as doubles, nulls as NaN (which no comparison holds for)."""
    if pa.types.is_date(column.type):
        column = column.cast(pa.int32())
    return column.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)


def _flags(column: pa.Array) -> np.ndarray:
    return column.fill_null(False).to_numpy(zero_copy_only=False)


class Limits:
    """A lower or upper limit of each rule, if set."""

    def __init__(self, column: pa.Array, upper: bool):
        self.bound, self.upper = _numbers(column), upper
        self.free = np.isnan(self.bound)

    def hold(self, value: np.ndarray, rule: np.ndarray) -> np.ndarray:
        bound = self.bound[rule]
        return self.free[rule] | (value <= bound if self.upper else value >= bound)


class Keywords:
    """All keywords of all rules in one automaton, and which of them a rule wants and shuns."""

    def __init__(self, include: list[list[str | None] | None], exclude: list[list[str | None] | None]):
        import ahocorasick

        self.numbers: dict[str, int] = {}
        number = lambda word: self.numbers.setdefault(word.casefold(), len(self.numbers))
        self.include = [frozenset(-1 if w is None else number(w) for w in words or ()) for words in include]
        self.exclude = [frozenset(number(w) for w in words or () if w is not None) for words in exclude]
        self.any = np.array([bool(a or b) for a, b in zip(self.include, self.exclude)], bool)
        self.always = frozenset(n for w, n in self.numbers.items() if not w)
        self.automaton = ahocorasick.Automaton()
        for word, n in self.numbers.items():
            if word:
                self.automaton.add_word(word, n)
        if len(self.automaton):
            self.automaton.make_automaton()

    def found(self, text: str) -> frozenset[int]:
        """The keywords that a text holds, whatever the case."""
        return self.always | frozenset(n for _, n in self.automaton.iter(text.casefold())) if len(self.automaton) else self.always

    def fit(self, found: frozenset[int], rule: int) -> bool:
        return self.include[rule] <= found and not self.exclude[rule] & found


class RuleIndex:
    """``rules`` are resolved rules without an error (see ``resolved_rules``)."""

    def __init__(self, rules: pa.Table):
        self.rules, self.n = rules, rules.num_rows
        column = lambda name: rules.column(name).combine_chunks()
        values = {name: rules.column(name).to_pylist() for name in (*LISTS.values(), "excluded_house_types", "want_island", "want_region", "want_subregion", "want_sit_length", "date_window_match")}
        #: Codes of the values that rules name, from 1 on; 0 is any other value, or none.
        self.codes: dict[str, dict[str, int]] = {}
        self.allowed: dict[str, np.ndarray] = {}
        self.want: dict[str, np.ndarray] = {}
        for name, lists in LISTS.items():
            named = {v for row in values[lists] for v in row or ()} | ({v for row in values["excluded_house_types"] for v in row or ()} if name == "house_type" else set(values[f"want_{name}"]))
            self.codes[name] = {v: i + 1 for i, v in enumerate(sorted(named - {None}))}
            self.allowed[name] = self._matrix(values[lists], self.codes[name], free=True)
            if name in PLACES:
                self.want[name] = np.array([-1 if v is None else self.codes[name][v] for v in values[f"want_{name}"]], np.int64)
        self.shunned = self._matrix(values["excluded_house_types"], self.codes["house_type"], free=False)
        self.mode = np.array([v == "overlaps" for v in values["date_window_match"]], bool)
        self.not_before, self.not_after = Limits(column("start_date_on_or_after"), False), Limits(column("end_date_on_or_before"), True)
        self.limits = {
            ("duration_days", "min_duration_days"): Limits(column("min_duration_days"), False), ("duration_days", "max_duration_days"): Limits(column("max_duration_days"), True),
            ("total_animals", "max_total_animals"): Limits(column("max_total_animals"), True), ("dogs_count", "max_dogs"): Limits(column("max_dogs"), True),
            ("reply_rating_score", "min_reply_rating_score"): Limits(column("min_reply_rating_score"), False),
        }
        self.pets = sum(_flags(column(c.replace("_count", "_allowed"))).astype(np.int64) << i for i, c in enumerate(fv.PET_COUNT_COLUMNS))
        self.pets = self.pets | _flags(column("no_pets_allowed")).astype(np.int64) << len(fv.PET_COUNT_COLUMNS)
        self.length = np.array([0 if v is None else 1 << CODES.index(v) for v in values["want_sit_length"]], np.int64)
        month = lambda days, otherwise: np.array([otherwise if np.isnan(d) else _month(d) for d in days], np.int64)
        self.first_month = np.where(self.mode, -1 << 40, month(self.not_before.bound, -1 << 40))
        self.last_month = month(self.not_after.bound, 1 << 40)
        self.keywords = Keywords(rules.column("include_keywords").to_pylist(), rules.column("exclude_keywords").to_pylist())
        self.filed = self._file(values)
        self.candidates: dict[tuple[int, int, int], np.ndarray] = {}
        self.near: dict[tuple[int, int, int], np.ndarray] = {}

    def _matrix(self, lists: list[list[str | None] | None], codes: dict[str, int], free: bool) -> np.ndarray:
        """Which codes a rule's list holds; with ``free`` a rule without a list holds all."""
        out = np.zeros((self.n, len(codes) + 1), bool)
        for i, row in enumerate(lists):
            if row is None:
                out[i] = free
            else:
                out[i, [codes[v] for v in row if v is not None]] = True
        return out

    def _file(self, values: dict[str, list]) -> dict[tuple, list[int]]:
        """Rules by place: the narrowest that a rule's search names, else each that one of its lists allows."""
        filed: dict[tuple, list[int]] = {}
        for i in range(self.n):
            island, region, subregion = (int(self.want[p][i]) for p in PLACES)
            if subregion > 0:
                keys = [("place", region, subregion)]
            elif region > 0:
                keys = [("region", region)]
            elif island > 0:
                keys = [("island", island)]
            else:
                name = next((p for p in reversed(PLACES) if values[LISTS[p]][i] is not None), None)
                keys = [(name, self.codes[name][v]) for v in set(values[LISTS[name]][i]) if v is not None] if name else [()]
            for key in keys:
                filed.setdefault(key, []).append(i)
        return filed

    def _of(self, island: int, region: int, subregion: int, length: int, month: int) -> np.ndarray:
        """Rules that may fit listings of a place, length class (bits of the codes) and start month (-1: not known)."""
        place = (island, region, subregion)
        if place not in self.near:
            keys = [(), ("island", island), ("region", region), ("place", region, subregion), ("subregion", subregion)]
            self.near[place] = np.unique(np.array([i for k in keys for i in self.filed.get(k, ())], np.int64))
        own = self.near[place]
        own = own[(self.length[own] == 0) | (self.length[own] & length > 0)]
        return own if month < 0 else own[(self.first_month[own] <= month) & (month <= self.last_month[own])]

    def _coded(self, batch: pa.RecordBatch, name: str) -> np.ndarray:
        coded = batch.column(name).dictionary_encode()
        codes = np.array([self.codes[name].get(v, 0) for v in coded.dictionary.to_pylist()] + [0], np.int64)
        return codes[coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)]

    def match(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Listings and rules that fit, as row numbers of both."""
        place = {name: self._coded(batch, name) for name in PLACES}
        values = {name: _numbers(batch.column(name)) for name in ("duration_days", "start_date", "end_date", "total_animals", "dogs_count", "reply_rating_score")}
        house = self._coded(batch, "house_type")
        days, start, end = values["duration_days"], values["start_date"], values["end_date"]
        length = sum(((days >= low) & (days <= (np.inf if high is None else high))).astype(np.int64) << i for i, (low, high) in enumerate(fv.SIT_LENGTH_CODES.values()))
        month = np.where(end >= start, _months(start), -1)
        pets = sum((np.nan_to_num(_numbers(batch.column(c))) > 0).astype(np.int64) << i for i, c in enumerate(fv.PET_COUNT_COLUMNS))
        pets = pets | _flags(batch.column("no_pets")).astype(np.int64) << len(fv.PET_COUNT_COLUMNS)
        keys, inverse = np.unique(np.stack([place["island"], place["region"], place["subregion"], length, month], axis=1), axis=0, return_inverse=True)
        lists = []
        for key in map(tuple, keys.tolist()):
            if key not in self.candidates:
                self.candidates[key] = self._of(*key)
            lists.append(self.candidates[key])
        size = np.array([len(x) for x in lists], np.int64)
        flat, begin = np.concatenate(lists) if lists else np.zeros(0, np.int64), np.cumsum(size) - size
        inverse = inverse.reshape(-1)
        total, rows, rules = np.cumsum(size[inverse]), [], []
        at = 0
        while at < batch.num_rows:  # as many listings at once as have some two million pairs
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
            own = np.arange(at, min(stop, batch.num_rows))
            n = size[inverse[own]]
            row = np.repeat(own, n)
            rule = flat[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[inverse[own]], n)]
            fine = np.ones(len(row), bool)
            for name in PLACES:
                want = self.want[name][rule]
                fine &= ((want < 0) | (want == place[name][row])) & self.allowed[name][rule, place[name][row]]
            fine &= (self.length[rule] == 0) | (self.length[rule] & length[row] > 0)
            fine &= (pets[row] & ~self.pets[rule]) == 0
            fine &= self.allowed["house_type"][rule, house[row]] & ~self.shunned[rule, house[row]]
            row, rule = row[fine], rule[fine]
            overlaps = self.mode[rule]
            fine = self.not_before.hold(np.where(overlaps, end[row], start[row]), rule) & self.not_after.hold(np.where(overlaps, start[row], end[row]), rule)
            for (name, _), limit in self.limits.items():
                fine &= limit.hold(values[name][row], rule)
            rows.append(row[fine])
            rules.append(rule[fine])
            at = int(own[-1]) + 1
        row, rule = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, rules))
        return self._with_words(batch, row, rule)

    def _with_words(self, batch: pa.RecordBatch, row: np.ndarray, rule: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        asked = np.flatnonzero(self.keywords.any[rule])
        if not len(asked):
            return row, rule
        own, inverse = np.unique(row[asked], return_inverse=True)
        columns = [batch.column(c).take(pa.array(own)).to_pylist() for c in ("title", "intro", "listing_tag")]
        codes: dict[str, int] = {}
        text = np.array([codes.setdefault(" ".join(filter(None, t)), len(codes)) for t in zip(*columns)], np.int64)
        found = [self.keywords.found(t) for t in codes]
        pair = np.stack([text[inverse], rule[asked]], axis=1)
        pairs, place = np.unique(pair, axis=0, return_inverse=True)
        fits = np.array([self.keywords.fit(found[t], r) for t, r in pairs.tolist()], bool)
        keep = np.ones(len(row), bool)
        keep[asked] = fits[place.reshape(-1)]
        return row[keep], rule[keep]


def _month(days: float) -> int:
    return int(_months(np.array([days]))[0])


def _months(days: np.ndarray) -> np.ndarray:
    """Calendar months since 1970 of days since then; anything for NaN."""
    return np.nan_to_num(days).astype("datetime64[D]").astype("datetime64[M]").astype(np.int64)


def matched(batches: Iterator[pa.RecordBatch], rules: pa.Table) -> Iterator[pa.RecordBatch]:
    """Listings with each rule that they satisfy: the columns of both."""
    index = RuleIndex(rules)
    shown = pa.Table.from_batches(rules.to_batches(), rules.schema).combine_chunks().to_batches()
    for batch in batches:
        row, rule = index.match(batch)
        if len(row):
            left, right = batch.take(pa.array(row)), shown[0].take(pa.array(rule))
            yield pa.RecordBatch.from_arrays([*left.columns, *right.columns], [*left.schema.names, *right.schema.names])
