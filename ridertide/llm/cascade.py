"""Quality rules as a short-circuit cascade.

Counts of a batch of texts are taken at once. The rules then see only the texts that all earlier rules passed. Their
order is found on a sample: each rule's seconds and rejections over all sampled texts give its rejection per cost, and
the best goes first. A text is kept if it passes every rule, so the order changes the cost and never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridertide.llm.arrays import flat, is_space, mixed, ranges, strings, words
from ridertide.llm.tables import arrow_batches

#: Texts of the sample that orders the rules.
SAMPLE = 2000
#: Fixed values of the base test.
LEAST_WORDS, REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
BULLETS = (b"-", b"*", "•".encode())
ELLIPSES = (b"...", "…".encode())

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


@dataclass
class Batch:
    """Texts with their counts; `take` keeps some of them."""

    data: np.ndarray
    offsets: np.ndarray
    counts: dict[str, np.ndarray]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def take(self, index: np.ndarray) -> Batch:
        lengths = np.diff(self.offsets)[index]
        data = self.data[ranges(self.offsets[:-1][index], lengths)]
        return Batch(data, np.r_[0, np.cumsum(lengths)], {k: v[index] for k, v in self.counts.items()})

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text) of the lines with a word."""
        cut = np.zeros(len(self.data) + 1, bool)
        cut[1:] = self.data == 0x0A
        cut[self.offsets] = True
        starts = np.flatnonzero(cut[:-1])
        ends = np.r_[starts[1:], len(self.data)]
        full = sums(~is_space(self.data), np.r_[starts, len(self.data)]) > 0 if len(starts) else np.empty(0, bool)
        starts, ends = starts[full], ends[full]
        ends = ends - (self.data[ends - 1] == 0x0A)
        return starts, ends, np.searchsorted(self.offsets, starts, side="right") - 1


def coded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each span, equal for equal bytes."""
    cuts = np.empty(2 * len(starts) + 1, np.int64)
    cuts[0:-1:2], cuts[1::2], cuts[-1] = starts, ends, len(data)
    return strings(data, cuts, pa.large_binary())[::2].dictionary_encode().indices.to_numpy().astype(np.int64)


def repeats(code: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which (text, code) pairs occurred before."""
    order = np.lexsort([np.arange(len(code)), code, text])
    again = np.zeros(len(code), bool)
    same = (code[order][1:] == code[order][:-1]) & (text[order][1:] == text[order][:-1])
    again[order[1:][same]] = True
    return again


def repeated_words(code: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Words inside a window of three words that the text has twice or more."""
    marked = np.zeros(len(code), bool)
    if len(code) < 3:
        return marked
    start = np.flatnonzero(text[2:] == text[:-2])
    hashed = mixed(mixed(mixed(text[start].astype(np.uint64)) + code[start].astype(np.uint64)) + code[start + 1].astype(np.uint64))
    hashed = mixed(hashed + code[start + 2].astype(np.uint64))
    ordered = np.sort(hashed)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return marked
    at = np.minimum(np.searchsorted(twice, hashed), len(twice) - 1)
    start = start[twice[at] == hashed]
    # Equal hashes are only candidates: the words themselves decide.
    keys = [code[start + 2], code[start + 1], code[start], text[start]]
    order = np.lexsort(keys)
    same = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys])
    found = start[order[np.r_[same, False] | np.r_[False, same]]]
    for k in range(3):
        marked[found + k] = True
    return marked


def counted(texts: pa.Array) -> Batch:
    data, offsets = flat(texts)
    batch = Batch(data, offsets, {})
    starts, ends, n_words = words(data, offsets)
    text = np.repeat(np.arange(len(batch)), n_words)
    code = coded(data, starts, ends)
    line_start, line_end, line_text = batch.lines()
    line_code = coded(data, line_start, line_end)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    by_text = lambda flags, of: np.bincount(of[flags], minlength=len(batch))
    batch.counts = {
        "n_words": n_words,
        "word_chars": sums(~is_space(data) & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": sums(symbol[data], offsets),
        "n_dup_lines": by_text(repeats(line_code, line_text), line_text),
        "n_repeat_words": by_text(repeated_words(code, text), text),
        "n_lines": np.bincount(line_text, minlength=len(batch)),
    }
    return batch


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > REPEAT_PERCENT * counts["n_words"])


# The rules: each says which texts of a batch pass.


def word_length(b: Batch) -> np.ndarray:
    """2.5 to 12 characters a word on average."""
    return (2 * b.counts["word_chars"] >= 5 * b.counts["n_words"]) & (b.counts["word_chars"] <= 12 * b.counts["n_words"])


def few_symbols(b: Batch) -> np.ndarray:
    """At most one symbol for ten words."""
    return 10 * b.counts["n_symbols"] <= b.counts["n_words"]


def few_repeated_lines(b: Batch) -> np.ndarray:
    """At most half of the lines occurred before."""
    return 2 * b.counts["n_dup_lines"] <= b.counts["n_lines"]


def with_letters(b: Batch) -> np.ndarray:
    """At least 80 % of the words have an ASCII letter or a character beyond ASCII."""
    starts, ends, n = words(b.data, b.offsets)
    folded = b.data | 0x20
    letter = ((folded >= 0x61) & (folded <= 0x7A)) | (b.data >= 0x80)
    total = np.zeros(len(b.data) + 1, np.int64)
    np.cumsum(letter, out=total[1:])
    has = total[ends] > total[starts]
    return 100 * np.bincount(np.repeat(np.arange(len(b)), n)[has], minlength=len(b)) >= 80 * n


def lines_with(b: Batch, marks: tuple[bytes, ...], at_end: bool) -> np.ndarray:
    """Lines of each text that begin (or end) with a mark, white space aside."""
    starts, ends, text = b.lines()
    gap = is_space(b.data)
    place = np.flatnonzero(~gap)
    first = place[np.searchsorted(place, starts)]
    last = place[np.searchsorted(place, ends) - 1] + 1
    hit = np.zeros(len(starts), bool)
    for mark in marks:
        at = last - len(mark) if at_end else first
        fits = (at >= first) & (at + len(mark) <= last)
        ok = fits.copy()
        for k, byte in enumerate(mark):
            ok[fits] &= b.data[at[fits] + k] == byte
        hit |= ok
    return np.bincount(text[hit], minlength=len(b))


def few_bullets(b: Batch) -> np.ndarray:
    """At most 90 % of the lines begin with a bullet."""
    return 100 * lines_with(b, BULLETS, False) <= 90 * b.counts["n_lines"]


def few_ellipses(b: Batch) -> np.ndarray:
    """At most 30 % of the lines end in an ellipsis."""
    return 100 * lines_with(b, ELLIPSES, True) <= 30 * b.counts["n_lines"]


RULES: dict[str, Callable[[Batch], np.ndarray]] = {
    f.__name__: f for f in (word_length, few_symbols, few_repeated_lines, with_letters, few_bullets, few_ellipses)
}


def rule_order(docs: DataFrame, sample: int = SAMPLE) -> list[tuple[str, float]]:
    """(rule, texts rejected for a second of work) on about `sample` texts, the best first; ties by name."""
    arrow_batches(docs.sparkSession)
    total = docs.count()

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            batch = counted(record.column("text"))
            batch = batch.take(np.flatnonzero(~base_failed(batch.counts)))
            for name, rule in RULES.items():
                began = time.perf_counter()
                rejected = int((~rule(batch)).sum())
                yield pa.RecordBatch.from_pylist([{"rule": name, "seconds": time.perf_counter() - began, "rejected": rejected}])

    part = docs.select("text").sample(min(1.0, sample / total), seed=7) if total else docs.select("text")
    found = part.mapInArrow(tried, "rule string, seconds double, rejected long").groupBy("rule").agg(F.sum("seconds"), F.sum("rejected"))
    rate = {name: rejected / max(seconds, 1e-9) for name, seconds, rejected in found.collect()}
    return sorted(((name, rate.get(name, 0.0)) for name in RULES), key=lambda x: (-x[1], x[0]))


def judged(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """doc_id with the counts of its whole text, base_failed, kept, and rejected_by (the first rule that said no).

    A null text has no words and fails the base test; so does an empty one. A null doc_id stays null; repeated rows
    are judged each; other columns are ignored; an empty table stays empty.
    """
    docs = docs.select("doc_id", "text")
    names = order or [name for name, _ in rule_order(docs)]
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            batch = counted(record.column("text"))
            failed = base_failed(batch.counts)
            rejected = np.full(len(batch), None, object)
            rejected[failed] = "base"
            alive = np.flatnonzero(~failed)
            left = batch.take(alive)
            for name in names:
                passed = RULES[name](left)
                rejected[alive[~passed]] = name
                alive = alive[passed]
                if not passed.all():
                    left = left.take(np.flatnonzero(passed))
            kept = np.zeros(len(batch), bool)
            kept[alive] = True
            columns = [pa.array(batch.counts[c].astype(np.int64)) for c in COUNTS]
            columns += [pa.array(failed), pa.array(kept), pa.array(rejected.tolist(), pa.string())]
            yield pa.RecordBatch.from_arrays([record.column("doc_id").cast(pa.int64()), *columns], ["doc_id", *COUNTS, "base_failed", "kept", "rejected_by"])

    counts = ", ".join(f"{c} long" for c in COUNTS)
    return docs.mapInArrow(run, f"doc_id long, {counts}, base_failed boolean, kept boolean, rejected_by string")
