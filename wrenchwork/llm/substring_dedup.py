"""Substring dedup: words of passages that an earlier document has are found and removed.

A passage repeats if a window of ``Windows.size`` words also starts in a document with a
smaller id. Each window goes to one shard, chosen by its anchor: the smallest hash among the
pieces of ``anchor`` words in it. Neighbouring windows mostly share their anchor and travel
together as one segment. Each shard builds a compressed FM-index over its segments and
streams them against it; the intervals of matches that reach the window's size give the
smallest document that holds each window.

The words of a segment are sent only where they can tell something new. That is found out
beforehand by sending anchors and hashes of whole segments: a segment that a smaller document
has word for word repeats in all its windows, and one whose anchor no other document has, but
for such copies of it, has no window that is new to others. Segments or frequent anchors that
occur several times in what one task reads are sent once by it, so a passage in a third of all
documents costs a shard one entry per task. The segments of an anchor that is frequent without
being part of one passage (a common short line) are dealt by whole windows, which spreads them.

Segments overlap, so together they can have three times the words of the texts. They are sent
in as many passes, by anchor, as keep the words of a pass below a share of all words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .fm_index import FMIndex
from .frames import fresh, passed, shards, wider
from .words import Words, mixed, span_hashes, word_chunks, words_of

_U64 = np.uint64


@dataclass(frozen=True)
class Windows:
    size: int = 13
    anchor: int = 4


# Windows of a segment, at most: their marks are the bits of one number.
SEGMENT = 64
# Segments a task gathers before it deals them out: bounds its memory.
GATHERED = 1 << 19
# An anchor is frequent if over this share of all segments have it: at most so many are.
FREQUENT = 10_000
LEAST_FREQUENT = 1_000
# Entries of an anchor that one task asks for; more are sent without asking.
ASKED = 32
# Words of the segments of one pass, at most, as a share of all words.
PASS_SHARE = 0.75
# Marks of a segment: bit i is set if the window from word start + i repeats.
_MARKS = np.dtype([("start", "<i4"), ("marks", "<u8")])


@dataclass
class Segments:
    row: np.ndarray
    start: np.ndarray  # first word, in the row
    count: np.ndarray  # of windows
    anchor: np.ndarray
    content: np.ndarray  # hash of the words
    number: np.ndarray  # of the segment in its row
    word: np.ndarray  # first word, in the chunk

    def take(self, at: np.ndarray) -> Segments:
        return Segments(*[getattr(self, f)[at] for f in self.__dataclass_fields__])


def segments(words: Words, rule: Windows) -> Segments:
    n = max(0, len(words.hashes) - rule.size + 1)
    row = words.row_of_word()
    inside = row[:n] == row[rule.size - 1 : rule.size - 1 + n]
    grams = words.grams(rule.anchor)
    span, smallest = 1, grams
    pieces = rule.size - rule.anchor + 1
    while span * 2 <= pieces:
        smallest = np.minimum(smallest[:-span], smallest[span:])
        span *= 2
    if span < pieces:
        smallest = np.minimum(smallest[: -(pieces - span)], smallest[pieces - span :])
    smallest = smallest[:n]
    new = np.ones(n, dtype=bool)
    new[1:] = (smallest[1:] != smallest[:-1]) | (row[1:n] != row[: max(0, n - 1)])
    at = np.flatnonzero(new)
    if n:
        place = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
        at = np.flatnonzero((place % SEGMENT == 0) & inside)
    count = np.add.reduceat(inside.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
    owner = row[at]
    number = np.arange(len(at)) - np.searchsorted(owner, owner, side="left")
    return Segments(
        owner, at - words.first[owner], count, smallest[at],
        span_hashes(words.hashes, at, at + count + rule.size - 1), number, at,
    )


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """First place of each run of equal values."""
    new = np.ones(len(sorted_values), dtype=bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    return np.flatnonzero(new)


def _spread(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A value per run repeated over its run."""
    return np.repeat(values, np.diff(np.append(at, n)))


def _dealt(shard: np.ndarray, kind: int, columns: list[np.ndarray], texts: list[bytes] | None = None):
    """Arrays cut by shard, each part as one row of packed bytes."""
    order = np.argsort(shard, kind="stable")
    for part in np.split(order, _runs(shard[order])[1:]) if len(order) else []:
        packed = [c[part].tobytes() for c in columns]
        packed += [b""] * (len(_COLUMNS) - len(packed))
        text = b"\n".join([texts[i] for i in part.tolist()]) if texts is not None else b""
        yield (int(shard[part[0]]), kind, *packed, text)


_COLUMNS = "abcdefg"
_DEALT = ["shard", "kind", *_COLUMNS, "text"]
_DEALT_TYPE = f"shard int, kind int, {''.join(f'{c} binary, ' for c in _COLUMNS)}text binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * (len(_COLUMNS) + 1)]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], _DEALT
    )


def _unpacked(table: pa.Table, kind: int, types: list) -> list[np.ndarray]:
    rows = np.flatnonzero(table.column("kind").to_numpy() == kind)
    part = table.take(pa.array(rows))
    return [
        np.frombuffer(b"".join(part.column(c).to_pylist()), dtype=t)
        for c, t in zip(_COLUMNS, types, strict=False)
    ]


def _shard(of: np.ndarray, n_shards: int) -> np.ndarray:
    return (mixed(of.view(np.uint64)) % _U64(n_shards)).astype(np.int64)


def _by_text(doc: np.ndarray, text: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Values packed per text: its document, its print, the bytes of its values."""
    order = np.lexsort((text, doc))
    doc, text, values = doc[order], text[order], values[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return doc[first], text[first], [x.tobytes() for x in np.split(values, first[1:])] if len(first) else []


def _all_marks(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Marks of segments whose windows all repeat."""
    marks = np.empty(len(start), dtype=_MARKS)
    marks["start"] = start
    marks["marks"] = np.where(
        count >= 64, _U64(0xFFFFFFFFFFFFFFFF), (_U64(1) << (count % 64).astype(np.uint64)) - _U64(1)
    )
    return marks


def _later(content: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a smaller document has the same content."""
    order = np.argsort(content)
    at = _runs(content[order])
    later = np.zeros(len(order), dtype=bool)
    if len(order):
        later[order] = doc[order] > _spread(np.minimum.reduceat(doc[order], at), at, len(order))
    return later


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents that can repeat or be repeated. A print of the text tells rows of one id apart."""
    return docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.hash("text").alias("print"), "text"
    )


def _candidates(docs: DataFrame, rule: Windows, n_shards: int) -> tuple[DataFrame, DataFrame, np.ndarray, int]:
    """What is known of segments without their words.

    Per document the first words of segments to be sent; per document the marks of segments
    that a smaller one has word for word; the frequent anchors; the number of passes to send in.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[tuple] = []

        def deal():
            columns = [np.concatenate(x) for x in zip(*gathered, strict=True)]
            gathered.clear()
            later = _later(columns[1], columns[2])
            yield from _dealt(
                np.zeros(1, dtype=np.int64), 3, [np.array([len(later)]), np.array([columns[5].sum(dtype=np.int64)])]
            )
            _, _, doc, text, start, count = (x[later] for x in columns)
            yield from _dealt(_shard(doc, n_shards), 2, [doc, text, _all_marks(start, count)])
            order = np.flatnonzero(~later)
            order = order[np.argsort(columns[0][order])]
            anchor, content, doc, text, start, count = (x[order] for x in columns)
            at = _runs(anchor)
            weight = np.diff(np.append(at, len(anchor)))
            several = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
            many = several & (weight > ASKED)
            known = _spread(many, at, len(anchor))
            yield from _dealt(_shard(doc[known], n_shards), 1, [doc[known], text[known], start[known], count[known]])
            once = np.zeros(len(anchor), dtype=bool)
            once[at] = True
            ask = once | ~known
            start = np.where(known, -1, start)  # known here: asked once, for the others' sake
            weights = np.where(known, _spread(weight, at, len(anchor)), 1).astype(np.int32)
            windows = np.where(known, _spread(np.add.reduceat(count, at), at, len(anchor)), count)
            yield from _dealt(
                _shard(anchor[ask], n_shards), 0,
                [anchor[ask], content[ask], doc[ask], text[ask], start[ask], windows[ask].astype(np.int32), weights[ask]],
            )

        size = 0
        for batch in batches:
            ids, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, _, words in word_chunks(batch.column(2)):
                s = segments(words, rule)
                if len(s.row):
                    gathered.append(
                        (s.anchor, s.content, ids[a + s.row], prints[a + s.row], s.start.astype(np.int32),
                         s.count.astype(np.int32))
                    )
                    size += len(s.row)
                if size >= GATHERED:
                    yield _batch(list(deal()))
                    size = 0
        if gathered:
            yield _batch(list(deal()))

    def answer(table: pa.Table) -> pa.Table:
        columns = _unpacked(table, 0, ["u8", "u8", "i8", "i4", "i4", "i4", "i4"])
        later = _later(columns[1], columns[2]) & (columns[4] >= 0)
        _, _, doc, text, start, count, _ = (x[later] for x in columns)
        marked = [doc, text, _all_marks(start, count)]
        order = np.flatnonzero(~later)
        order = order[np.argsort(columns[0][order])]
        anchor, _, doc, text, start, windows, weight = (x[order] for x in columns)
        at = _runs(anchor)
        frequent = np.zeros(0, np.int64)
        weights = sums = np.zeros(0, np.int64)
        if len(at):
            several = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
            several |= np.minimum.reduceat(start, at) < 0
            weights = np.add.reduceat(weight.astype(np.int64), at)
            sums = np.add.reduceat(windows.astype(np.int64), at)
            frequent = np.flatnonzero(several & (weights > LEAST_FREQUENT))
            reply = _spread(several, at, len(anchor)) & (start >= 0)
            doc, text, start, windows = doc[reply], text[reply], start[reply], windows[reply]
        known = _unpacked(table, 1, ["i8", "i4", "i4", "i4"])
        windows = np.concatenate((windows, known[3]))
        sent = int(windows.sum(dtype=np.int64)) + (rule.size - 1) * len(windows)
        sends = _by_text(*[np.concatenate(x) for x in zip((doc, text, start), known[:3], strict=True)])
        marks = _by_text(*[np.concatenate(x) for x in zip(marked, _unpacked(table, 2, ["i8", "i4", _MARKS]), strict=True)])
        n_segments, n_windows = (int(x.sum()) for x in _unpacked(table, 3, ["i8", "i8"]))
        a, b, c = len(sends[0]), len(marks[0]), len(frequent)
        return pa.table(
            {
                "doc_id": pa.array([*sends[0].tolist(), *marks[0].tolist(), *[None] * (c + 1)], pa.int64()),
                "print": pa.array([*sends[1].tolist(), *marks[1].tolist(), *[None] * (c + 1)], pa.int32()),
                "starts": pa.array([*sends[2], *[None] * (b + c + 1)], pa.binary()),
                "marks": pa.array([*[None] * a, *marks[2], *[None] * (c + 1)], pa.binary()),
                "anchor": pa.array([*[None] * (a + b), *anchor[at[frequent]].view(np.int64).tolist(), None], pa.int64()),
                "segments": pa.array([*[None] * (a + b), *weights[frequent].tolist(), n_segments], pa.int64()),
                "windows": pa.array([*[None] * (a + b), *sums[frequent].tolist(), n_windows], pa.int64()),
                "sent": pa.array([*[None] * (a + b + c), sent], pa.int64()),
            }
        )

    answers = passed(
        docs.mapInArrow(ask, _DEALT_TYPE).groupBy("shard").applyInArrow(
            answer,
            "doc_id bigint, print int, starts binary, marks binary, anchor bigint, segments bigint, windows bigint, "
            "sent bigint",
        )
    )
    total, windows, sent = (
        x or 0 for x in answers.where("sent is not null").agg(F.sum("segments"), F.sum("windows"), F.sum("sent")).first()
    )
    # Weights add up to the total, so fewer than FREQUENT anchors can pass.
    bound = max(total // FREQUENT, LEAST_FREQUENT)
    frequent = answers.where(F.col("anchor").isNotNull() & (F.col("segments") > bound))
    hot = sorted(map(tuple, frequent.select("anchor", "windows").collect()))
    sent += rule.size * sum(x[1] for x in hot)
    passes = max(1, -int(-sent // max(1, int(PASS_SHARE * windows))))
    found = answers.where("starts is not null").groupBy("doc_id", "print").agg(F.collect_list("starts").alias("starts"))
    marks = answers.where("marks is not null").select("doc_id", "print", "marks")
    return found, marks, np.array([x[0] for x in hot], dtype=np.int64).view(np.uint64), passes


def smallest_holders(
    lines: bytes, holders: np.ndarray, rule: Windows
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every line of words its windows' smallest holder, by search in an FM-index.

    Returns the holders of all windows one after the other, each line's first window and the
    number of windows of each line. Lines with the same words are indexed and searched once.
    """
    data = np.frombuffer(lines + b"\n", dtype=np.uint8)
    cuts = np.flatnonzero(data == 10) + 1
    words = words_of(data, np.concatenate(([0], cuts)))
    _, symbols = np.unique(words.hashes, return_inverse=True)
    symbols = symbols + 1
    lengths = np.diff(words.first)
    content = span_hashes(words.hashes, words.first[:-1], words.first[1:])
    _, picked, same = np.unique(content, return_index=True, return_inverse=True)
    smallest = np.full(len(picked), np.iinfo(np.int64).max)
    np.minimum.at(smallest, same, holders)
    # The distinct lines one after the other, each with a zero at its end.
    length = lengths[picked]
    begin = np.concatenate(([0], np.cumsum(length + 1)))
    text = np.zeros(begin[-1], dtype=np.int64)
    source = np.repeat(words.first[picked] - np.cumsum(length) + length, length)
    place = np.repeat(begin[:-1] - np.cumsum(length) + length, length)
    k = np.arange(int(length.sum()))
    text[place + k] = symbols[source + k]
    index = FMIndex(text, int(symbols.max()) + 1)
    # Each window is searched from its last word back; one that is down to a single
    # occurrence is its own only holder and needs no further step.
    count = np.maximum(length - rule.size + 1, 0)
    window_line = np.repeat(np.arange(len(picked)), count)
    within = np.arange(len(window_line)) - np.repeat(np.cumsum(count) - count, count)
    ends = begin[window_line] + within + rule.size
    reached, low, high = index.matches(text, ends, rule.size, least=2)
    held = smallest[window_line]
    repeated = np.flatnonzero(reached == rule.size)
    if len(repeated):
        # Intervals of equal length are equal or disjoint.
        starts, which = np.unique(low[repeated], return_inverse=True)
        stops = np.zeros(len(starts), dtype=np.int64)
        stops[which] = high[repeated]
        holder_of_suffix = np.repeat(smallest, length + 1)[index.order]
        edges = np.stack((starts, stops), axis=1).reshape(-1)
        held[repeated] = np.minimum.reduceat(np.append(holder_of_suffix, 0), edges)[::2][which]
    first = (np.cumsum(count) - count)[same]
    return held, first, count[same]


def _repeats(
    candidates: DataFrame, hot: np.ndarray, rule: Windows, n_shards: int, turn: int = 0, passes: int = 1
) -> DataFrame:
    """``doc_id, print, marks`` of the segments whose anchors have their turn in this pass."""

    def deal_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[tuple] = []

        def deal():
            doc, text, start, count, anchor, content = (
                np.concatenate([g[i] for g in gathered]) for i in range(6)
            )
            lines = [line for g in gathered for line in g[6]]
            gathered.clear()
            later = _later(content, doc)
            first = np.flatnonzero(~later)
            yield from _dealt(
                _shard(doc[later], n_shards), 1, [doc[later], text[later], _all_marks(start[later], count[later])]
            )
            yield from _dealt(
                _shard(anchor[first], n_shards), 0, [doc[first], text[first], start[first]],
                [lines[i] for i in first.tolist()],
            )

        size = 0
        for batch in batches:
            ids, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = batch.column(3)
            for a, b, words in word_chunks(batch.column(2)):
                s = segments(words, rule)
                sent = np.zeros(len(words.hashes), dtype=bool)
                for i in range(b - a):
                    own = np.frombuffer(b"".join(starts[a + i].as_py()), dtype=np.int32)
                    sent[words.first[i] + own] = True
                s = s.take(np.flatnonzero(sent[s.word]))
                s = _by_windows(s, words, np.isin(s.anchor, hot), rule)
                if passes > 1:
                    # By other bits than the shard.
                    s = s.take(np.flatnonzero((mixed(s.anchor) >> _U64(40)) % _U64(passes) == turn))
                gathered.append(
                    (ids[a + s.row], prints[a + s.row], s.start.astype(np.int32), s.count, s.anchor,
                     s.content, words.texts(s.word, s.word + s.count + rule.size - 1))
                )
                size += len(s.row)
                if size >= GATHERED // 4:
                    yield _batch(list(deal()))
                    size = 0
        if size:
            yield _batch(list(deal()))

    def search(table: pa.Table) -> pa.Table:
        doc, text, start = _unpacked(table, 0, ["i8", "i4", "i4"])
        marks = np.zeros(len(doc), dtype=_MARKS)
        marks["start"] = start
        if len(doc):
            lines = b"\n".join(
                t for t, k in zip(table.column("text").to_pylist(), table.column("kind").to_pylist(), strict=True)
                if k == 0
            )
            held, first, count = smallest_holders(lines, doc, rule)
            entry = np.repeat(np.arange(len(doc)), count)
            bit = np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count)
            earlier = held[first[entry] + bit] < doc[entry]
            np.bitwise_or.at(marks["marks"], entry[earlier], _U64(1) << bit[earlier].astype(np.uint64))
        some = marks["marks"] != 0
        later = _unpacked(table, 1, ["i8", "i4", _MARKS])
        docs, prints, blobs = _by_text(
            *[np.concatenate(x) for x in zip((doc[some], text[some], marks[some]), later, strict=True)]
        )
        return pa.table({"doc_id": docs, "print": prints, "marks": pa.array(blobs, pa.binary())})

    return candidates.mapInArrow(deal_segments, _DEALT_TYPE).groupBy("shard").applyInArrow(
        search, "doc_id bigint, print int, marks binary"
    )


def _by_windows(s: Segments, words: Words, cut: np.ndarray, rule: Windows) -> Segments:
    """The segments to be cut as one segment per window, with the window itself as anchor."""
    if not cut.any():
        return s
    whole, parts = s.take(np.flatnonzero(~cut)), s.take(np.flatnonzero(cut))
    each = np.repeat(np.arange(len(parts.row)), parts.count)
    step = np.arange(len(each)) - np.repeat(np.cumsum(parts.count) - parts.count, parts.count)
    word = parts.word[each] + step
    window = span_hashes(words.hashes, word, word + rule.size)
    single = Segments(
        parts.row[each], parts.start[each] + step, np.ones(len(each), np.int64), window, window,
        parts.number[each], word,
    )
    return Segments(
        *[np.concatenate((getattr(whole, f), getattr(single, f))) for f in s.__dataclass_fields__]
    )


def repeated_words(docs: DataFrame, rule: Windows = Windows()) -> DataFrame:
    """The rows of ``docs`` with ``n_words``, ``n_removed`` and ``kept_text`` at the end.

    A word is removed if a window of ``rule.size`` words that covers it also starts in a
    document with a smaller ``doc_id``; windows are judged on the given texts. ``kept_text``
    is the other words joined by one space.

    A null text has no words. A row without id neither loses words nor makes others lose any.
    Rows with the same id are no earlier than each other: neither loses words for the other.
    Texts shorter than a window stay whole. Names that clash get underscores in front.
    """
    keyed = _keyed(docs)
    n_shards = shards(docs.sparkSession)
    found, marks, hot, passes = _candidates(keyed, rule, n_shards)
    asked = keyed.join(found.hint("shuffle_hash"), ["doc_id", "print"]).select(
        "doc_id", "print", "text", "starts"
    )
    for turn in range(passes):
        marks = marks.unionAll(passed(_repeats(asked, hot, rule, n_shards, turn, passes)))
    doc, text_print, mark = fresh(docs, "marked_doc", "marked_print", "marks")
    grouped = marks.groupBy(F.col("doc_id").alias(doc), F.col("print").alias(text_print)).agg(
        F.collect_list("marks").alias(mark)
    )
    names = fresh(docs, "n_words", "n_removed", "kept_text")
    marked = docs.join(
        grouped.hint("shuffle_hash"),
        (docs["doc_id"] == F.col(doc)) & (F.hash(docs["text"]) == F.col(text_print)),
        "left",
    ).select(*[docs[c] for c in docs.columns], mark)
    text_at = docs.columns.index("text")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in word_chunks(batch.column(text_at)):
                part = batch.slice(a, b - a)
                gone = _covered(words, part.column(part.num_columns - 1), rule)
                n_words = np.diff(words.first)
                before = np.concatenate(([0], np.cumsum(gone)))
                removed = before[words.first[1:]] - before[words.first[:-1]]
                columns = part.columns[:-1]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), _kept(words, ~gone)],
                    names=[*part.schema.names[:-1], *names],
                )

    return marked.mapInArrow(sweep, wider(docs, names, ["long", "long", "string"]))


def _covered(words: Words, marks: pa.Array, rule: Windows) -> np.ndarray:
    """Which words the marked windows cover."""
    depth = np.zeros(len(words.hashes) + 1, dtype=np.int64)
    lists = marks.cast(pa.list_(pa.binary()))
    rows = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
    blobs = lists.flatten()
    rows = np.repeat(rows, pc.binary_length(blobs).to_numpy(zero_copy_only=False) // _MARKS.itemsize)
    flat = np.frombuffer(b"".join(blobs.to_pylist()), dtype=_MARKS)
    bits = flat["marks"]
    first = words.first[:-1][rows] + flat["start"]
    for i in range(SEGMENT):
        at = first[(bits >> _U64(i)) & _U64(1) == 1] + i
        np.add.at(depth, at, 1)
        np.add.at(depth, at + rule.size, -1)
    return np.cumsum(depth[:-1]) > 0


def _kept(words: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each row, joined by one space."""
    at = np.flatnonzero(kept)
    size = words.ends[at] - words.starts[at] + 1
    ends = np.cumsum(size)
    source = np.repeat(words.starts[at] - (ends - size), size) + np.arange(int(size.sum()))
    out = words.data[np.minimum(source, max(0, len(words.data) - 1))]
    out[ends - 1] = 32
    before = np.concatenate(([0], np.cumsum(kept)))
    edges = np.concatenate(([0], ends))
    data = out.tobytes()
    rows = []
    for i, j in zip(before[words.first[:-1]].tolist(), before[words.first[1:]].tolist(), strict=True):
        rows.append(data[edges[i] : max(edges[i], edges[j] - 1)])
    return pa.array(rows, pa.binary()).cast(pa.string())


def without_repeats(docs: DataFrame, rule: Windows = Windows()) -> DataFrame:
    """``docs`` with the columns they have and without repeated words.

    A text that loses words becomes its kept words joined by one space, and ``n_chars``, if
    there is such a column, their length. A document that loses all its words goes.
    """
    names = fresh(docs, "n_words", "n_removed", "kept_text")
    swept = repeated_words(docs, rule)
    n_words, n_removed, kept = (F.col(n) for n in names)
    loses = n_removed > 0
    new = {
        "text": F.when(loses, kept).otherwise(F.col("text")),
        "n_chars": F.when(loses, F.length(kept)).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None,
    }
    return swept.where(~(loses & (n_removed == n_words))).select(
        *[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns]
    )
