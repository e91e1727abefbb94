"""Packing of tokenised documents into fixed windows by minimum bin slack.

Documents are cut into full windows and one remainder. The remainders' lengths form a histogram of at most one row
per length, and the plan works on that: the longest length left opens a window, and a bitset subset sum over the
lengths left picks the multiset that fills it closest to capacity, with the counts read back from the bitsets. A
pattern is repeated as often as its lengths last. Pieces find their place by their rank among those of their length.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticktote.llm.common import shared_table

END = "\n"
CACHE_WORDS = 400_000
CACHE_CORES = 300_000
_PARTS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
#: characters of a very long text, and words of several texts, that are encoded at a time
SLICE_CHARS, SLICE_WORDS = 500_000, 50_000


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level tokenizers write bytes as: printable ones as they are, the others from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()


def _as_bytes(text: str) -> str:
    return text.encode().decode("latin-1").translate(_BYTE_LETTERS)


def _packed(ids: Iterable[int]) -> bytes:
    """Ids as bytes, which take a fifth of the memory of a list of numbers."""
    return array("I", ids).tobytes()


class _Codes(dict):
    """Words to numbers; a new word gets the next number and is noted in fresh."""

    def __init__(self, first: list[str]):
        super().__init__((w, i) for i, w in enumerate(first))
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        self.fresh.append(word)
        return code


class WordTokenizer:
    """Token ids of texts, word by word, for tokenizers in which no token crosses white space.

    Ids of words seen before are kept, up to a number of words, and gathered for all words of a slice at once. A word
    of Latin letters and then ASCII punctuation is two pieces to such tokenizers; if this one takes them apart, lower
    case and byte by byte as ASCII, the ids of the letters come from its model directly, once for all such words.
    """

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok, self.end_id = Tokenizer.from_file(path), end_id
        self.cores: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}
        self.by_parts = all(self._whole(core + tail) == self._core(core) + self._whole(tail) for core, tail in (("onhe", ","), ("Éa", "!!"), ("THENHE", "$$$"), ("ß", ".'"), ("abc", "")))
        self._clear()

    def _whole(self, word: str) -> bytes:
        return _packed(self.tok.encode(word, add_special_tokens=False).ids)

    def _core(self, core: str) -> bytes:
        low = core.lower()
        return _packed([t.id for t in self.tok.model.tokenize(low if low.isascii() else _as_bytes(low))])

    def _all_ids(self, words: list[str]) -> list[bytes]:
        if not self.by_parts:
            return [self._whole(w) for w in words]
        if len(self.cores) > CACHE_CORES:
            self.cores.clear()
        if len(self.tails) > 10_000:
            self.tails = {"": b""}
        cores, tails, parts, out = self.cores, self.tails, _PARTS.fullmatch, []
        for w in words:
            m = parts(w)
            if not m:
                out.append(self._whole(w))
                continue
            core, tail = m.groups()
            low = core.lower()
            ids = cores.get(low)
            if ids is None:
                ids = cores[low] = self._core(low)
            if tail:
                if tail not in tails:
                    tails[tail] = self._whole(tail)
                ids += tails[tail]
            out.append(ids)
        return out

    def forget(self) -> None:
        """Lets go of all words, as a Python worker outlives the stage that it worked for."""
        self.cores.clear()
        self.tails = {"": b""}
        self._clear()

    def _clear(self) -> None:
        self.code = _Codes(["", END])
        self.ids = np.array([self.end_id], dtype=np.uint32)
        self.start, self.count = np.array([0, 0]), np.array([0, 1])

    def _learn(self) -> None:
        got = self._all_ids(self.code.fresh)
        self.code.fresh.clear()
        counts = np.fromiter(map(len, got), dtype=np.int64, count=len(got)) // 4
        flat = np.frombuffer(b"".join(got), dtype=np.uint32)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.ids = np.concatenate([self.ids, flat])

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and the number of ids of each word."""
        if len(self.code) > CACHE_WORDS:
            self._clear()
        codes = np.fromiter(map(self.code.__getitem__, words), dtype=np.int64, count=len(words))
        if self.code.fresh:
            self._learn()
        counts = self.count[codes]
        at = np.repeat(self.start[codes] - (np.cumsum(counts) - counts), counts)
        at += np.arange(len(at))
        return self.ids[at], counts


def _split(text: str) -> list[str]:
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def _slices(text: str) -> Iterator[str]:
    """text in slices that end at a blank, so that very long texts need little memory."""
    at = 0
    while len(text) - at > SLICE_CHARS:
        end = text.find(" ", at + SLICE_CHARS)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def _crcs(parts: Iterator[np.ndarray], capacity: int) -> tuple[int, list[int]]:
    """Number of ids and the CRC-32 of each run of capacity ids."""
    n, out, crc = 0, [], 0
    for ids in parts:
        ids = np.ascontiguousarray(ids, dtype="<u4")
        while len(ids):
            take = min(capacity - n % capacity, len(ids))
            crc = zlib.crc32(ids[:take].data, crc)
            n, ids = n + take, ids[take:]
            if n % capacity == 0:
                out.append(crc)
                crc = 0
    if n % capacity:
        out.append(crc)
    return n, out


_TOKENIZERS: dict[tuple[str, int], WordTokenizer] = {}


def _tokenise(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _TOKENIZERS.setdefault((path, end_id), None) or WordTokenizer(path, end_id)
        _TOKENIZERS[path, end_id] = tok
        for b in batches:
            done: list[tuple[int, list[int]]] = []
            words: list[str] = []
            ends: list[int] = []

            def flush(done=done, words=words, ends=ends) -> None:
                if ends:
                    ids, counts = tok.encode(words)
                    cum = np.concatenate([[0], np.cumsum(counts)])[[0, *ends]]
                    done.extend(_crcs(iter([ids[a:z]]), capacity) for a, z in zip(cum[:-1], cum[1:], strict=True))
                    words.clear()
                    ends.clear()

            for value in b.column(1):
                text = value.as_py() or ""
                if len(text) > 2 * SLICE_CHARS:
                    flush()
                    done.append(_crcs((tok.encode(w)[0] for w in (*map(_split, _slices(text)), [END])), capacity))
                    continue
                words.extend(_split(text))
                words.append(END)
                ends.append(len(words))
                if len(words) > SLICE_WORDS:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([n for n, _ in done], pa.int64()), pa.array([c for _, c in done], pa.list_(pa.int64()))], ["id", "doc_tokens", "crcs"])
        tok.forget()

    return run


def minimum_slack_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, last rank, copies in a window, first window, offset of the first copy).

    Ranks count the pieces of one length. Every piece gets a place; windows count from 0.
    """
    left = {n: c for n, c in sorted(histogram.items(), reverse=True) if c > 0}
    used = dict.fromkeys(left, 0)
    rows, window = [], 0
    while left:
        seed = next(iter(left))
        free = capacity - seed
        reach, steps, mask = 1, [], (1 << (free + 1)) - 1
        for n, c in left.items():
            k, b = min(c - (n == seed), free // n), 1
            while k > 0 and not reach >> free & 1:
                t = min(b, k)
                wider = (reach | reach << (t * n)) & mask
                if wider != reach:
                    steps.append((n, t, reach))
                    reach = wider
                k, b = k - t, b * 2
            if reach >> free & 1:
                break
        goal, pick = reach.bit_length() - 1, {seed: 1}
        for n, t, before in reversed(steps):
            if not before >> goal & 1:
                pick[n] = pick.get(n, 0) + t
                goal -= t * n
        times, offset = min(left[n] // k for n, k in pick.items()), 0
        for n, k in pick.items():
            rows.append((n, used[n], used[n] + k * times - 1, k, window, offset))
            used[n] += k * times
            left[n] -= k * times
            if not left[n]:
                del left[n]
            offset += k * n
        window += times
    return rows


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and then end_id; null and empty texts are end_id alone. Each id lies in exactly one
    piece, pieces of one window are gapless from 0, and repeated rows are packed once each. Ties of length go by id
    and place in the input. An empty table gives no rows. The plan is broadcast: it has a few rows for each length
    up to capacity, however many documents there are.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("doc_tokens", T.LongType()), T.StructField("crcs", T.ArrayType(T.LongType()))])
    cut = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(_tokenise(tokenizer_path, capacity, end_id), schema)
    pieces = cut.select("id", "doc_tokens", F.posexplode("crcs").alias("i", "ids_crc32")).select(
        "id", "doc_tokens", "ids_crc32", (F.col("i") * F.lit(capacity).cast("long")).alias("start"),
        F.least(F.lit(capacity).cast("long"), F.col("doc_tokens") - F.col("i") * capacity).alias("length"))
    order = ["length", "id", "start", "ids_crc32"]
    dealt = shared_table(pieces, "pieces")
    placed = shared_table(dealt.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ordered-pieces")
    task, inside = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    base, before, total, shorter = [], [], 0, 0
    for r in placed.groupBy(task.alias("task")).count().orderBy("task").collect():  # one row per task
        base.append((r["task"], total))
        total += r["count"]
    histogram = {r["length"]: r["count"] for r in placed.groupBy("length").count().orderBy("length").collect()}  # capacity rows at most
    for n, c in histogram.items():
        before.append((n, shorter))
        shorter += c
    plan = minimum_slack_plan(histogram, capacity)
    bases = F.broadcast(spark.createDataFrame(base, "task long, base long"))
    firsts = F.broadcast(spark.createDataFrame(before, "length long, shorter long"))
    places = F.broadcast(spark.createDataFrame(plan, "length long, from_rank long, to_rank long, copies long, window long, first_offset long"))
    ranked = placed.withColumn("task", task).join(bases, "task").join(firsts, "length").withColumn("rank", F.col("base") + inside - F.col("shorter"))
    at = F.col("rank") - F.col("from_rank")
    return ranked.join(places, "length").where(F.col("rank").between(F.col("from_rank"), F.col("to_rank"))).select(
        "id", "start", "length", "ids_crc32", "doc_tokens", (F.col("window") + F.floor(at / F.col("copies"))).alias("sequence_id"),
        (F.col("first_offset") + at % F.col("copies") * F.col("length")).alias("offset"))
