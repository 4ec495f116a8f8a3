"""Benchmark decontamination by spaced seeds.

A seed is a mask over consecutive tokens that looks at some places and ignores the others, so
that a substituted token at an ignored place does not hide a copied passage. Test items and
texts are hashed under the same few masks, equal hashes are joined, and around each hit the
two texts are compared token by token along the hit's diagonal. An item gets masks of which,
however the substitutions lie, at least one fits every passage that counts as copied.

Tokens are words in lower case, letters and digits only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .frames import fresh, stored
from .words import CHUNK_BYTES, mixed, row_chunks, text_buffers, words_of

# Places looked at (1) and ignored (0). Wherever a fifth of 20 or more tokens is
# substituted, at least one of the masks still fits.
MASKS = ("111001011", "1101111", "10110111")
# For items too short for these: runs of equal tokens, down to one token.
RUNS = ("1111", "111", "11", "1")


@dataclass(frozen=True)
class Overlap:
    """What counts as a copied passage."""

    least_tokens: int = 20  # an item shorter than this must be covered whole
    least_share: float = 0.8  # of equal tokens within the passage
    masks: tuple[str, ...] = MASKS


# Benchmarks with up to this many seeds are sent to every task; larger ones are dealt by a shuffle.
BROADCAST_SEEDS = 2_000_000

_WORD_BYTE = np.zeros(256, dtype=bool)
for _range in ((48, 58), (97, 123), (128, 256)):
    _WORD_BYTE[_range[0] : _range[1]] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def tokens(texts: pa.Array, most: int = CHUNK_BYTES):
    """(first row, end row, Words) of lower-case texts with all but letters and digits cut out."""
    data, offsets = text_buffers(texts)
    for a, b in row_chunks(offsets, most):
        part = offsets[a : b + 1] - offsets[a]
        raw = data[offsets[a] : offsets[b]]
        keep = _WORD_BYTE[raw] | _SPACE[raw]
        kept = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum(keep, out=kept[1:])
        yield a, b, words_of(raw[keep], kept[part])


def seed_hashes(hashes: np.ndarray, mask: str) -> np.ndarray:
    """A hash of the looked-at tokens for each place at which the mask can start."""
    count = max(0, len(hashes) - len(mask) + 1)
    total = np.full(count, abs(hash_of(mask)), dtype=np.uint64)
    for k, look in enumerate(mask):
        if look == "1":
            total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + count]
    return mixed(total)


def hash_of(mask: str) -> int:
    return int(mask, 2)


@lru_cache(maxsize=64)
def fewest_to_hide(masks: tuple[str, ...], most: int) -> list[int]:
    """For 0 to ``most`` tokens: the fewest substitutions after which none of the masks fits."""
    looks = [(len(m), hash_of(m)) for m in masks]
    kept = (1 << max(n for n, _ in looks)) - 1
    # The fewest so far, by which of the last tokens are substituted.
    states, fewest = {0: 0}, [0]
    for n in range(1, most + 1):
        after: dict[int, int] = {}
        for state, count in states.items():
            for changed in (0, 1):
                new = (state << 1 | changed) & kept
                if any(n >= length and not new & look for length, look in looks):
                    continue
                after[new] = min(count + changed, after.get(new, n))
        states = after
        fewest.append(min(states.values()))
    return fewest


def masks_for(n: int, rule: Overlap) -> tuple[str, ...]:
    """The first masks of the rule's and the runs that fit every passage of an item of ``n`` tokens.

    A passage of twice ``least_tokens`` or more can be cut in two, of which one is a passage as
    well, so shorter ones are all that have to be looked at.
    """
    sizes = range(min(n, rule.least_tokens), min(n, 2 * rule.least_tokens - 1) + 1)
    for masks in (rule.masks, *[(run,) for run in RUNS]):
        fewest = fewest_to_hide(masks, sizes[-1])
        if all(fewest[size] > int((1 - rule.least_share) * size + 1e-9) for size in sizes):
            return masks
    return RUNS[-1:]


def _seeds_of(words, mask: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, token in row) of every place in a row where the mask fits."""
    hashed = seed_hashes(words.hashes, mask)
    row = words.row_of_word()
    at = np.flatnonzero(row[: len(hashed)] == row[len(mask) - 1 : len(mask) - 1 + len(hashed)])
    return hashed[at], row[at], at - words.first[row[at]]


class Items:
    """Test items in memory: their tokens, and their seeds in the order of the hashes."""

    def __init__(self, ids: np.ndarray, hashes: list[np.ndarray], rule: Overlap) -> None:
        self.ids, self.hashes = ids, hashes
        self.sizes = np.array([len(own) for own in hashes], dtype=np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        used: dict[str, None] = {}
        seeds, owners, places = [], [], []
        for i, own in enumerate(hashes):
            for mask in masks_for(len(own), rule) if len(own) else ():
                used[mask] = None
                found = seed_hashes(own, mask)
                seeds.append(found)
                owners.append(np.full(len(found), i))
                places.append(np.arange(len(found)))
        self.masks = tuple(used)
        empty = np.zeros(0, np.int64)
        seeds = np.concatenate(seeds) if seeds else empty.astype(np.uint64)
        order = np.argsort(seeds, kind="stable")
        self.seeds = seeds[order]
        self.owners = (np.concatenate(owners) if owners else empty)[order]
        self.places = (np.concatenate(places) if places else empty)[order]
        # A bit per 24-bit prefix, to pass over most places of a text at once.
        self.maybe = np.zeros(1 << 24, dtype=bool)
        self.maybe[(self.seeds >> np.uint64(40)).astype(np.int64)] = True

    def hits(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``hashed``, number of the seed) of all equal hashes."""
        at = np.flatnonzero(self.maybe[(hashed >> np.uint64(40)).astype(np.int64)])
        low = np.searchsorted(self.seeds, hashed[at], side="left")
        many = np.searchsorted(self.seeds, hashed[at], side="right") - low
        place = np.repeat(at, many)
        first = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])) if len(many) else low, many)
        return place, first + np.arange(len(place))


def best_span(equal: np.ndarray, share: float) -> tuple[int, int, int]:
    """(start, end, equal tokens) of the longest span with at least that share of equal tokens.

    The sums of (equal - share) never fall below their value at the start within such a span,
    so it is found from the running minima and maxima of the sums.
    """
    sums = np.concatenate(([0.0], np.cumsum(equal - share)))
    low = np.minimum.accumulate(sums)
    high = np.maximum.accumulate(sums[::-1])[::-1]
    i = j = best = start = 0
    n = len(sums)
    while i < n and j < n:
        if low[i] <= high[j] + 1e-9:
            if j - i > best:
                best, start = j - i, i
            j += 1
        else:
            i += 1
    return start, start + best, int(equal[start : start + best].sum())


def trimmed(equal: np.ndarray, start: int, end: int) -> tuple[int, int]:
    """The span without the unequal tokens at its ends."""
    while start < end and not equal[start]:
        start += 1
    while end > start and not equal[end - 1]:
        end -= 1
    return start, end


def passages(text: np.ndarray, diagonals: np.ndarray, item: np.ndarray, rule: Overlap):
    """The best passage over the given diagonals (place in text minus place in item), or None.

    Its size counts with unequal tokens at its ends; it is given without them.
    """
    need = min(rule.least_tokens, len(item))
    best = None
    for d in diagonals.tolist():
        a, b = max(0, d), min(len(text), d + len(item))
        equal = text[a:b] == item[a - d : b - d]
        start, end, same = best_span(equal, rule.least_share)
        if same and end - start >= need and (best is None or same > best[2]):
            start, end = trimmed(equal, start, end)
            best = (a + start, a + end, same, a - d + start, a - d + end)
            if same == len(item):
                break
    return best


def _loaded(benchmark: DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    rows = benchmark.select("item_id", F.lower(F.coalesce("text", F.lit(""))).alias("t")).collect()
    texts = pa.array([r["t"] for r in rows], pa.string())
    ids = np.array([r["item_id"] for r in rows], dtype=object)
    found: list[np.ndarray] = []
    for a, b, words in tokens(texts):
        found += [words.hashes[words.first[i] : words.first[i + 1]] for i in range(b - a)]
    return ids, found


FOUND = (
    "item_id bigint, n_matched bigint, span_start bigint, span_end bigint, "
    "item_start bigint, item_end bigint, n_tokens bigint"
)


def overlaps(docs: DataFrame, benchmark: DataFrame, rule: Overlap = Overlap()) -> DataFrame:
    """One row per text and test item of which the text holds a passage.

    ``docs`` gives ``doc_id`` and ``text``; the result has ``doc_id, item_id``, the equal tokens
    ``n_matched``, the passage's tokens in the text (``span_start`` to before ``span_end``) and
    in the item, and the text's ``n_tokens``. A passage has ``least_tokens`` tokens, or all
    of a shorter item, of which ``least_share`` are equal one by one. The longest is given,
    without unequal tokens at its ends.

    Null and empty texts and items hold nothing. Every passage is found, also of an item of one token.
    Repeated rows are each reported. An empty table on either side gives an empty result.
    """
    items = benchmark.select("item_id", "text").where("text is not null")
    # The seeds of an item are fewer than its characters times the masks.
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    limit = BROADCAST_SEEDS * 4 // len(rule.masks)
    if size <= limit:
        return _against(docs, items, rule)
    # Larger benchmarks are cut by hash into parts of that size, each in one pass of the texts.
    parts = -(-size // limit) * 2
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    found = None
    for part in range(parts):
        more = stored(_against(docs, dealt.where(F.col("part") == part), rule))
        found = more if found is None else found.unionByName(more)
    return found


def _against(docs: DataFrame, items: DataFrame, rule: Overlap) -> DataFrame:
    ids, hashes = _loaded(items)
    shared = docs.sparkSession.sparkContext.broadcast((ids, hashes))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Items(*shared.value, rule)
        for batch in batches:
            for a, b, words in tokens(batch.column(1)):
                rows = _found(words, known, rule)
                if rows:
                    owner = pa.array([a + r[0] for r in rows], pa.int64())
                    columns = [pa.array(c, pa.int64()) for c in zip(*[r[1:] for r in rows], strict=True)]
                    names = [f.split()[0] for f in FOUND.split(", ")]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(owner), *columns], ["doc_id", *names]
                    )

    low = docs.select(F.col("doc_id").cast("bigint"), F.lower("text").alias("text"))
    return low.mapInArrow(scan, f"doc_id bigint, {FOUND}")


def _found(words, known: Items, rule: Overlap) -> list[tuple]:
    rows, owners, diagonals = [], [], []
    for mask in known.masks:
        hashed, row, place = _seeds_of(words, mask)
        at, seed = known.hits(hashed)
        rows.append(row[at])
        owners.append(known.owners[seed])
        diagonals.append(place[at] - known.places[seed])
    if not rows:
        return []
    found = np.unique(np.stack([np.concatenate(x) for x in (rows, owners, diagonals)]), axis=1)
    found = found[:, _may_hold(words, known, *found, rule)]
    out = []
    pair = np.flatnonzero(np.any(found[:2, 1:] != found[:2, :-1], axis=0)) + 1
    for group in np.split(found, pair, axis=1) if found.shape[1] else []:
        row, owner = int(group[0, 0]), int(group[1, 0])
        text = words.hashes[words.first[row] : words.first[row + 1]]
        best = passages(text, group[2], known.hashes[owner], rule)
        if best:
            start, end, same, item_start, item_end = best
            out.append((row, known.ids[owner], same, start, end, item_start, item_end, len(text)))
    return out


def _may_hold(
    words, known: Items, rows: np.ndarray, owners: np.ndarray, diagonals: np.ndarray, rule: Overlap
) -> np.ndarray:
    """Numbers of the hits whose whole diagonals have as many equal tokens as a passage needs."""
    size, text_size = known.sizes[owners], np.diff(words.first)[rows]
    low = np.maximum(diagonals, 0)
    shared = np.minimum(text_size, diagonals + size) - low
    need = np.minimum(size, rule.least_tokens)
    enough = np.zeros(len(rows), dtype=bool)
    for a, b in row_chunks(np.concatenate(([0], np.cumsum(shared)))):
        part = shared[a:b]
        inside = np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part)
        in_text = np.repeat(words.first[rows[a:b]] + low[a:b], part) + inside
        in_item = np.repeat(known.first[owners[a:b]] + low[a:b] - diagonals[a:b], part) + inside
        same = np.add.reduceat(words.hashes[in_text] == known.flat[in_item], np.cumsum(part) - part, dtype=np.int64)
        enough[a:b] = (part >= need[a:b]) & (same >= rule.least_share * need[a:b] - 1e-9)
    return np.flatnonzero(enough)


def without_benchmark(docs: DataFrame, benchmark: DataFrame, rule: Overlap = Overlap()) -> DataFrame:
    """The rows of ``docs`` that hold no passage of a test item; all columns as they are.

    Rows are told apart by a hash of id and text, so a null id is no obstacle.
    """
    key, bad = fresh(docs, "key", "bad")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = overlaps(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark, rule)
    bad_keys = stored(found.select(F.col("doc_id").alias(bad)).distinct())
    return keyed.join(bad_keys, F.col(key) == F.col(bad), "left_anti").select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )
