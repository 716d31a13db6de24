"""Best-fit packing of token sequences by exact-complement hashing.

The plan is made on the histogram of piece lengths, which has at most ``limit`` entries however large the corpus. Pieces
are then numbered within their length (counts per length and salt, prefix sums, numbers within a salt), so a length
held by a third of all pieces is spread over the salts, and meet the plan in a join on length and number range.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import pin, stored

CACHED_WORDS = 1_000_000
#: Pieces per (length, salt) group, on average at most.
PER_SALT = 200_000


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks fill the cores already
    return Tokenizer.from_file(path)


# Words of these letters alone are one piece to the tokenizer, unchanged by its normaliser.
_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)]))
_LETTERS_ONLY = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


@cache
def _byte_forms(path: str) -> dict[int, str] | None:
    """How the model's vocabulary spells each of ``_LETTERS``; None if words of them cannot go to the model directly."""
    tokenizer = _tokenizer(path)
    if tokenizer.pre_tokenizer is None:
        return None
    forms = {ord(c): tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in _LETTERS}
    for word in (_LETTERS, _LETTERS[::-1], *(a + b for a in _LETTERS for b in "aet\xe9\xdf")):
        ids = tokenizer.encode(word, add_special_tokens=False).ids
        if [t.id for t in tokenizer.model.tokenize(word.translate(forms))] != ids:
            return None
    return forms


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _encode_words(words: list[bytes], path: str) -> dict[bytes, bytes]:
    """Ids of different words. Letters-only words skip the normaliser and the splitter, which take most of the time."""
    forms, model = _byte_forms(path), _tokenizer(path).model
    plain = {w for w in words if _LETTERS_ONLY.fullmatch(w)} if forms else set()
    out = {w: _packed([t.id for t in model.tokenize(w.decode().translate(forms))]) for w in plain}
    rest = [w for w in words if w not in plain]
    if rest:
        got = _tokenizer(path).encode_batch([w.decode() for w in rest], add_special_tokens=False)
        out.update((w, _packed(e.ids)) for w, e in zip(rest, got, strict=True))
    return out


# The tokenizer lower-cases, and parts a letter or digit from a full stop or comma, so both may be done first, which leaves
# fewer different words. Not where marks combine with letters (U+0300 to U+036F) or special tokens may be written out.
_UNSAFE = (b"\xcc", b"\xcd", b"<|")
_STOP = re.compile(rb"([A-Za-z0-9])([.,]+)(?=[ \n]|$)")
_WORDS: dict[str, dict[bytes, bytes]] = {}


def encode(text: bytes, path: str) -> bytes:
    """Token ids as little-endian 32-bit integers.

    The tokenizer normalises and splits at white space, so words between ASCII white space are encoded on their own
    and remembered; the memory is bounded, words beyond it are encoded each time.
    """
    known = _WORDS.setdefault(path, {})
    if not any(x in text for x in _UNSAFE):
        text = _STOP.sub(rb"\1 \2", text.lower())
    words = text.split()
    found = list(map(known.get, words))
    if None in found:
        new = list({w for w, x in zip(words, found, strict=True) if x is None})
        ids = _encode_words(new, path)
        if len(known) + len(ids) <= CACHED_WORDS:
            known.update(ids)
        found = [ids[w] if x is None else x for w, x in zip(words, found, strict=True)]
    return b"".join(found)


def _piece_rows(path: str, limit: int, end: int):
    tail = np.array([end], "<u4").tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            texts = batch.column("text").cast(pa.large_binary())
            for d, t in zip(batch.column("doc").to_pylist(), texts, strict=True):
                ids = encode(t.as_py() or b"", path) + tail
                for i, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    for o, x in zip(out, (d, i, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        o.append(x)
            yield pa.record_batch([pa.array(x, t) for x, t in zip(out, (
                batch.schema.field("doc").type, pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["doc", "piece", "start", "length", "ids_crc32"])

    return rows


def plan(counts: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with the number of sequences each fills, using up all counts.

    From the longest length down, the gap is looked up among the single lengths, then pair sums, then triple sums: a
    combination that fills it exactly is used as often as availability allows. What no such combination fills goes
    into best-fit bins: the longest first, each into the fullest bin with room.
    """
    left = dict(sorted(counts.items(), reverse=True))
    out: list[tuple[tuple[int, ...], int]] = []
    lengths = np.array(sorted(left), np.int64)
    present = np.zeros(limit + 1, bool)

    def use(pattern: tuple[int, ...]) -> bool:
        need = {x: pattern.count(x) for x in pattern}
        n = min(left.get(x, 0) // k for x, k in need.items())
        if n <= 0:
            return False
        out.append((pattern, n))
        for x, k in need.items():
            left[x] -= k * n
            present[x] = left[x] > 0
        return True

    def singles_and_pairs(gap: int, top: int) -> Iterator[tuple[int, ...]]:
        """Exact fillings of a gap by one or two available lengths up to ``top``, larger first."""
        if gap <= top and present[gap]:
            yield (gap,)
        a = lengths[(lengths <= min(top, gap - 1)) & (2 * lengths >= gap)]
        for x in a[present[a] & present[gap - a]][::-1].tolist():
            yield (x, gap - x)

    present[[x for x, n in left.items() if n > 0]] = True
    for x in list(left):
        if x == limit and left[x]:
            use((x,))
            continue
        while left[x] > 0:
            gap, done = limit - x, False
            if gap <= 0:
                break
            for fill in singles_and_pairs(gap, x):
                if use((x, *fill)):
                    done = True
                    break
            if not done:
                for y in lengths[(lengths < gap) & (lengths <= x) & present[lengths]][::-1].tolist():
                    if any(use((x, y, *fill)) for fill in singles_and_pairs(gap - y, y)):
                        done = True
                        break
            if not done:
                break
    return out + best_fit({x: n for x, n in left.items() if n > 0}, limit)


def best_fit(left: dict[int, int], limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: whole groups of bins with the same filling are treated at once."""
    bins: dict[int, dict[tuple[int, ...], int]] = {}  # room -> filling -> bins
    rooms: list[int] = []
    for x in sorted(left, reverse=True):
        n = left[x]
        while n:
            at = bisect_right(rooms, x - 1)
            if at < len(rooms):
                room = rooms[at]
                filling, have = next(iter(bins[room].items()))
                each = 1
                take = min(n, have)
                del bins[room][filling]
                if have > take:
                    bins[room][filling] = have - take
                if not bins[room]:
                    del bins[room]
                    rooms.pop(at)
            else:
                room, filling = limit, ()
                each = max(1, min(limit // x, n))
                take = n // each
            rest = room - each * x
            if rest not in bins:
                bins[rest] = {}
                rooms.insert(bisect_right(rooms, rest), rest)
            full = filling + (x,) * each
            bins[rest][full] = bins[rest].get(full, 0) + take
            n -= take * each
    return [(filling, k) for group in bins.values() for filling, k in group.items()]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> Iterator[tuple[int, int, int, int, int]]:
    """(length, first number, count, first sequence, offset): pieces of one length, in turn, to one place of a pattern."""
    used: dict[int, int] = {}
    sequence = 0
    for pattern, n in patterns:
        offset = 0
        for x in pattern:
            yield x, used.get(x, 0), n, sequence, offset
            used[x] = used.get(x, 0) + n
            offset += x
        sequence += n


def pieces_of(docs: DataFrame, tokenizer: str, doc: str = "doc_id", text: str = "text", limit: int = 4096, end: int = 1) -> DataFrame:
    """Pieces of at most ``limit`` ids of every document (its ids, then ``end``): doc, piece, start, length, ids_crc32."""
    rows = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    return stored(rows.mapInArrow(_piece_rows(tokenizer, limit, end),
                                  f"doc {kind}, piece int, start long, length long, ids_crc32 long"))


def numbered(pieces: DataFrame) -> DataFrame:
    """Pieces with ``number``, gapless from 0 within each length."""
    salts = max(64, -(-pieces.count() // PER_SALT))
    salt: Column = F.pmod(F.xxhash64("doc", "piece"), F.lit(salts)).cast("int")
    pieces = pieces.withColumn("salt", salt)
    totals = pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    base = totals.select("length", "salt", F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc", "piece", "ids_crc32"))
    return pieces.withColumn("inside", inside).join(base, ["length", "salt"]).withColumn(
        "number", F.col("base") + F.col("inside") - 1).drop("salt", "base", "inside")


def pack(docs: DataFrame, tokenizer: str, doc: str = "doc_id", text: str = "text", limit: int = 4096, end: int = 1) -> DataFrame:
    """All pieces of all documents with the sequence that holds them and their place in it.

    Null texts are empty: their one piece holds ``end`` alone. Rows that repeat are packed each on their own. An empty
    table gives no rows. Columns: the ``doc`` column, piece, start, length, ids_crc32, sequence_id, offset.
    """
    spark = docs.sparkSession
    pieces = pieces_of(docs, tokenizer, doc, text, limit, end)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= limit rows
    found = list(slots(plan(counts, limit)))
    # a pattern is at most one row for each of its lengths: bounded by the lengths, not by the pieces
    table = pa.table({c: pa.array([s[i] for s in found], pa.int64()) for i, c in enumerate(
        ("length", "from", "count", "sequence", "offset"))})
    ranges = spark.createDataFrame(table)
    per_length = ranges.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("from", "sequence", "offset"))).alias("slots"))
    rows = numbered(pieces).join(F.broadcast(per_length), "length")
    slot = F.element_at("slots", _last_at_most(F.col("slots"), F.col("number")))
    rows = pin(rows.withColumn("slot", slot).drop("slots"))
    return rows.select(F.col("doc").alias(doc), "piece", "start", "length", "ids_crc32",
                       (F.col("slot.sequence") + F.col("number") - F.col("slot.from")).alias("sequence_id"),
                       F.col("slot.offset").alias("offset"))


def _last_at_most(slots_: Column, number: Column) -> Column:
    return F.size(F.filter(slots_, lambda s: s["from"] <= number))
