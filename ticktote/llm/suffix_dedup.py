"""Repeated strings across documents by a sparse suffix array, distributed.

A window is a string of 50 bytes. Its anchor is the least hash of the 16-byte strings in it, so equal windows have equal
anchors, and neighbouring windows mostly share theirs: a run of windows with one anchor, a stretch, is about 18 windows
long. No window repeats whose anchor one document alone has, so those anchors go first, before any bytes move. The
stretches that are left are dealt out by anchor. All suffixes of a group's stretches are sorted by their first 50
bytes; equal ones are neighbours, and the least document of each run of equal suffixes decides for the others.

Of rows with one text, the smallest id stands for all: every window of the others starts in it, so they lose all bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticktote.llm.textops import SLICE_BYTES, columns, mix, pieces

LENGTH = 50
GRAM = 16
#: windows of a stretch at most, for texts that repeat one anchor over and over
STRETCH = 256
#: bits of an anchor, and hexadecimal digits of a text's SHA-256 in its key. Anchors that share theirs, and texts of
#: different ids that share theirs, are only looked at together
ANCHOR_BITS, KEY_DIGITS = 40, 12

_U = np.uint64


def _grams(x: np.ndarray) -> np.ndarray:
    """Hashes of the 16-byte strings of x."""
    n = len(x) - 7
    eight = np.empty(n, np.uint64)
    for r in range(min(8, n)):
        part = x[r : r + (len(x) - r) // 8 * 8]
        eight[r::8] = np.frombuffer(part.tobytes(), dtype=np.uint64)
    return mix(eight[: n - 8] * _U(0x9E3779B97F4A7C15) + eight[8:] * _U(0xD6E8FEB86659FD93))


def _stretches(x: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of bytes: (row, first window, windows, anchor) of each stretch; places are those in x."""
    n = len(x) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    m, size, width = _grams(x), 1, length - GRAM + 1
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < width:
        m = np.minimum(m[:n], m[width - size : width - size + n])
    fits = np.zeros(n + 1, np.int64)
    long = np.flatnonzero(np.diff(off) >= length)
    np.add.at(fits, off[long], 1)
    np.add.at(fits, off[long + 1] - length + 1, -1)
    fits = np.cumsum(fits[:n]) > 0
    new = np.ones(n, bool)
    new[1:] = (m[1:] != m[:-1]) | (fits[1:] != fits[:-1])
    first = np.flatnonzero(new)
    new |= (np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))) % STRETCH == 0
    first = np.flatnonzero(new)
    count, ok = np.diff(np.append(first, n)), fits[first]
    first, count = first[ok], count[ok]
    return np.searchsorted(off, first, side="right") - 1, first, count, m[first] & _U((1 << ANCHOR_BITS) - 1)


def _pieces(data: np.ndarray, off: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, place in it, bytes, offsets) of runs of rows; a very long row comes in pieces that share no window."""
    for a, z in pieces(data, off):
        if z > a + 1 or off[z] - off[a] <= 2 * SLICE_BYTES:
            yield a, 0, data[off[a] : off[z]], off[a : z + 1] - off[a]
            continue
        for lo in range(int(off[a]), int(off[z]) - length + 1, SLICE_BYTES):
            x = data[lo : min(lo + SLICE_BYTES + length - 1, int(off[z]))]
            yield a, lo - int(off[a]), x, np.array([0, len(x)])


def _anchors(length: int):
    """Of rows (key, id, text): rows (anchor, key), each anchor once for a text or a piece of a long one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy()
            for a, _, x, off in _pieces(*columns(b, 2), length):
                row, _, _, anchor = _stretches(x, off, length)
                both = np.unique(row.astype(np.uint64) << _U(ANCHOR_BITS) | anchor)
                found = (both & _U((1 << ANCHOR_BITS) - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(keys[a + (both >> _U(ANCHOR_BITS)).astype(np.int64)])], ["anchor", "key"])

    return run


def _repeated_stretches(length: int):
    """Of rows (key, id, text, anchors): rows (anchor, id, key, at, bytes) of the stretches of those anchors, equal ones of a text as one with all places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, wanted = b.column(0).to_numpy(), b.column(3)
            begin = np.concatenate([[0], np.cumsum(wanted.value_lengths().fill_null(0).to_numpy())])
            values = wanted.flatten().to_numpy().astype(np.uint64)
            for a, at, x, off in _pieces(*columns(b, 2), length):
                row, first, count, anchor = _stretches(x, off, length)
                z = a + len(off) - 1
                of = np.repeat(np.arange(z - a, dtype=np.uint64), np.diff(begin[a : z + 1]))
                keep = np.isin(row.astype(np.uint64) << _U(ANCHOR_BITS) | anchor, of << _U(ANCHOR_BITS) | values[begin[a] : begin[z]])
                row, first, count, anchor = row[keep], first[keep], count[keep], anchor[keep]
                found: dict[tuple[int, bytes], tuple[int, list[int]]] = {}
                for r, f, c, k in zip(row.tolist(), first.tolist(), count.tolist(), anchor.tolist(), strict=True):
                    found.setdefault((r, x[f : f + c + length - 1].tobytes()), (k, []))[1].append(at + f - int(off[r]))
                of = a + np.array([r for r, _ in found], dtype=np.int64)
                places = pa.array([p for _, p in found.values()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found.values()], pa.int64()), b.column(1).take(pa.array(of)), pa.array(keys[of]), places, pa.array([t for _, t in found], pa.binary())], ["anchor", "id", "key", "at", "bytes"])

    return run


def _sorted_suffixes(length: int):
    """Of rows (anchor, id, key, at, bytes) sorted by anchor and id: (key, id, start, stop) of bytes that an earlier id has.

    What is held of an anchor whose rows go on in the next batch: its distinct windows and the rank of their first ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_rank, last, rank = np.zeros(0, f"S{length}"), np.zeros(0, np.int64), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            anchor = b.column(0).to_numpy()
            ids = list(zip(anchor.tolist(), b.column(1).to_pylist(), strict=True))
            ranks = rank + np.cumsum([x != y for x, y in zip(ids, [last, *ids[:-1]], strict=True)])
            data, off = columns(b, 4)
            count = np.diff(off) - length + 1
            ends = np.cumsum(count)
            row = np.repeat(np.arange(b.num_rows), count)
            place = np.arange(ends[-1]) - np.repeat(ends - count, count)
            windows = np.lib.stride_tricks.sliding_window_view(data, length)[off[row] + place].view(f"S{length}").ravel()
            if last is None or last[0] != anchor[0]:
                held, held_rank = held[:0], held_rank[:0]
            every, order_of = np.concatenate([held, windows]), np.concatenate([held_rank, ranks[row]])
            order = np.argsort(every, kind="stable")
            every = every[order]
            new = np.ones(len(every), bool)
            new[1:] = every[1:] != every[:-1]
            heads = np.flatnonzero(new)
            least = order_of[order[heads]]
            found = np.zeros(len(every), bool)
            found[order] = order_of[order] > np.repeat(least, np.diff(np.append(heads, len(every))))
            found = found[len(held) :]
            # of the last anchor, in the order of all suffixes
            group = np.concatenate([np.full(len(held), anchor[0]), anchor[row]])[order[heads]]
            held, held_rank = every[heads][group == anchor[-1]], least[group == anchor[-1]]
            last, rank = ids[-1], int(ranks[-1])
            edge = np.ones(len(found), bool)
            edge[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
            begin = np.flatnonzero(edge)
            end = np.append(begin[1:], len(found)) - 1
            keep = found[begin]
            begin, end = begin[keep], end[keep]
            # once for each place of the stretch
            at = b.column(3).take(pa.array(row[begin]))
            times = at.value_lengths().to_numpy()
            of, at = pa.array(np.repeat(row[begin], times)), at.flatten().to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(2).take(of), b.column(1).take(of), pa.array(at + np.repeat(place[begin], times)), pa.array(at + np.repeat(place[end], times) + length)], ["key", "id", "start", "stop"])

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, id, start, stop) of bytes that windows cover which also start in a row with a smaller id. docs: key, id, text; rows without a text have no windows."""
    found = docs.select("key", "id", "text").mapInArrow(_anchors(length), "anchor long, key long")
    several = found.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("anchor"))).where("n > 1")
    anchors = several.groupBy("key").agg(F.collect_list("anchor").alias("anchors"))
    kind = docs.schema["id"]
    longs = lambda *names: [T.StructField(c, T.LongType()) for c in names]
    # a left join keeps the exchange of the texts as it is, so that it is used again
    parts = docs.join(anchors.hint("merge"), "key", "left").select("key", "id", F.when(F.col("anchors").isNotNull(), F.col("text")).alias("text"), "anchors")
    parts = parts.mapInArrow(_repeated_stretches(length), T.StructType([*longs("anchor"), kind, *longs("key"), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("bytes", T.BinaryType())]))
    dealt = parts.repartition("anchor").sortWithinPartitions("anchor", "id")
    return dealt.mapInArrow(_sorted_suffixes(length), T.StructType([*longs("key"), kind, *longs("start", "stop")]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, id, text, removed): the rows without the removed stretches of bytes."""
    for b in batches:
        data, off = columns(b, 2)
        size, gone, spans, sha, kept = [], [], [], [], []
        for r, cuts in enumerate(b.column(3).to_pylist()):
            x = data[off[r] : off[r + 1]]
            edge = np.zeros(len(x) + 1, np.int64)
            np.add.at(edge, [c["start"] for c in cuts or []], 1)
            np.add.at(edge, [c["stop"] for c in cuts or []], -1)
            out = np.cumsum(edge[:-1]) > 0
            runs = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]])))
            left = x[~out].tobytes()
            size.append(len(x))
            gone.append(int(out.sum()))
            spans.append([{"start": int(a), "end": int(z)} for a, z in zip(runs[::2], runs[1::2], strict=True)])
            sha.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [b.column(1), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, span), pa.array(sha, pa.string()), pa.array(kept, pa.binary())],
            ["id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, spans (maximal removed runs of bytes), kept_sha256, kept (bytes).

    A byte goes if it is covered by a 50-byte string that also starts in a row with a smaller id; rows are judged as
    they came, not by what is left. Null and empty texts and texts under 50 bytes keep all bytes. Rows that share an
    id do not remove each other's strings; null ids neither remove nor lose any. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    digest = F.sha2("text", 256)
    rows = rows.withColumns({"digest": F.unhex(F.substring(digest, 1, 32)), "key": F.conv(F.substring(digest, 1, KEY_DIGITS), 16, 10).cast("long")})
    firsts = rows.where("id is not null").groupBy("key").agg(F.min(F.struct("id", "digest")).alias("first"))
    # one exchange of the texts, by key, serves the three joins
    texts = rows.repartition("key").join(firsts.hint("merge"), "key", "left")
    copy = F.coalesce((F.col("first.digest") == F.col("digest")) & (F.col("id") > F.col("first.id")), F.lit(False)) & (F.octet_length("text") >= LENGTH)
    texts = texts.select("key", "id", "text", copy.alias("copy"))
    others = texts.select("key", "id", F.when(F.col("id").isNotNull() & ~F.col("copy"), F.col("text")).alias("text"))
    spans = repeated_spans(others).groupBy("key").agg(F.collect_list(F.struct("id", "start", "stop")).alias("removed"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("stop")))
    own = F.transform(F.filter("removed", lambda s: s["id"] == F.col("id")), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))
    joined = texts.join(spans.hint("merge"), "key", "left").select("key", "id", "text", F.when(F.col("copy"), whole).otherwise(own).alias("removed"))
    schema = "n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept_sha256 string, kept binary"
    fields = T.StructType([rows.schema["id"], *T._parse_datatype_string(schema).fields])
    return joined.mapInArrow(_cut, fields)
