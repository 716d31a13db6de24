"""Alignment of two tokenizers over a corpus, as an Arrow pipeline inside tasks and sums in Spark.

Both token sequences of a text spell the same bytes, so a token is known by the byte offset where it ends. Per batch:

1. texts are cut into fragments at single spaces between other characters, where no token of either kind can reach across
   (checked against the vocabularies); equal fragments are tokenized and aligned once per batch;
2. token lists are flattened, parent indices tell the fragment, segmented cumulative sums give the ends;
3. an Acero full outer join on (fragment, end) has one row per stretch between neighbouring ends, which is exactly one
   overlapping pair of tokens; rows where both sides end close a group;
4. an Acero join of (document, fragment) counts with the fragments' pairs and a ``group_by`` give each document's pairs.

The documents' pairs are stored; ``group_by`` counts per task, merged by Spark, say how many documents hold a pair. The
counts meet the stored pairs in parts of bounded size, each broadcast, and the sums per document are added up.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import pieces, stored

#: Bytes of text aligned at once in a task; a longer text comes alone.
CHUNK = 1 << 21
#: Counted pairs that are broadcast at once (about 30 bytes each).
PART = 1 << 20
#: Pairs a task counts before it hands them on.
HELD = 1 << 20
#: Words whose ids a Python worker remembers before it starts anew.
WORDS = 300_000
#: A pair is one integer: id of the first tokenizer times this, plus id of the second.
STEP = 1 << 15

_COLUMNS = ("n_a", "n_b", "n_groups", "n_links")


def _byte_level() -> dict[str, int]:
    """Characters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    out.update((chr(256 + i), b) for i, b in enumerate(b for b in range(256) if b not in plain))
    return out


@cache
def _tokenizers(a_path: str, b_path: str):
    """Both tokenizers, the bytes of their ids, and whether fragments may be cut off at single spaces."""
    import sentencepiece
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks fill the cores already
    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    letters, size = _byte_level(), a.get_vocab_size(with_added_tokens=True)
    a_bytes = [bytes(letters.get(c, 0) for c in a.id_to_token(i) or "") for i in range(size)]
    pieces_ = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
               for i, p in enumerate(pieces_)]
    if len(b_bytes) > STEP:
        raise ValueError(f"the second tokenizer has more than {STEP} ids")
    inner = re.compile("[^▁]▁")
    apart = not any(inner.search(p) for p in pieces_) and len(a.pre_tokenizer.pre_tokenize_str(" a b")) == 2
    return a, b, pa.array(a_bytes, pa.binary()), pa.array(b_bytes, pa.binary()), apart


def _classes() -> tuple[np.ndarray, np.ndarray]:
    after, two = np.zeros(256, bool), np.zeros(256, bool)
    after[0x21:0x7F] = after[0xC3:0xE0] = after[0xE4:0xF5] = True  # C2, E1, E2, E3 may begin a white space character
    two[0xC3:0xE0] = True
    return after, two


_AFTER, _TWO = _classes()


def _fragment_starts(data: np.ndarray, start: np.ndarray, apart: bool) -> np.ndarray:
    """Starts of texts, and single spaces after an ASCII or two-byte character and before a character, none of them white space."""
    n = len(data)
    cut = np.zeros(n, bool)
    if apart and n > 2:
        before = (data >= 0x21) & (data < 0x7F)
        before[1:] |= (data[1:] >= 0x80) & (data[1:] < 0xC0) & _TWO[data[:-1]]
        cut[1:-1] = (data[1:-1] == 0x20) & before[:-2] & _AFTER[data[2:]]
    cut[start] = True
    return np.flatnonzero(cut)


def _mark(value: bytes) -> pa.Scalar:
    return pa.scalar(value, pa.large_binary())


def _lists(ids: list[list[int]]) -> pa.LargeListArray:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return pa.LargeListArray.from_arrays(offsets, pa.array(np.fromiter(chain.from_iterable(ids), np.int32, offsets[-1])))


# In texts of these letters, marks and single line ends the splitter's words are known, and can go straight to its model.
_LETTER, _MARK = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", r"!-&(-/:-@\[-`{-~"
_SIMPLE = re.compile(f" (?:[{_LETTER}{_MARK}]|\\n(?=[{_LETTER}{_MARK}]))+")
_WORD = re.compile(f" ?[{_LETTER}]+| ?[{_MARK}]+|\\n")
_WORDS: dict[str, list[int]] = {}


def _encoded(tokenizer, texts: list[str]) -> list[list[int]]:
    """Ids of every text; words already seen are remembered, up to a bound."""
    simple = [_SIMPLE.fullmatch(t) is not None for t in texts]
    rest = iter(tokenizer.encode_batch_fast([t for t, s in zip(texts, simple, strict=True) if not s], add_special_tokens=False))
    if len(_WORDS) > WORDS:
        _WORDS.clear()
    model, letters, out = tokenizer.model, {b: c for c, b in _byte_level().items()}, []
    for text, is_simple in zip(texts, simple, strict=True):
        ids: list[int] = []
        for word in _WORD.findall(text) if is_simple else ():
            found = _WORDS.get(word)
            if found is None:
                found = _WORDS[word] = [x.id for x in model.tokenize("".join(map(letters.__getitem__, word.encode())))]
            ids += found
        out.append(ids if is_simple else next(rest).ids)
    return out


def _spelt(lists: pa.LargeListArray, vocabulary: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Flattened tokens of every fragment: parent, end offset within the parent; and what each parent's tokens spell."""
    ids, parent = lists.flatten(), pc.list_parent_indices(lists)
    words = vocabulary.take(ids)
    running = pc.cumulative_sum(pc.cast(pc.binary_length(words), pa.int64()))
    before = pa.concat_arrays([pa.array([0], pa.int64()), running]).take(lists.offsets)  # sum before each fragment
    ends = pc.subtract(running, before.take(parent))
    joined = pc.binary_join(pa.LargeListArray.from_arrays(lists.offsets, words.cast(pa.large_binary())), _mark(b""))
    return parent, ends, joined


def _joined(values: pa.Array, ends: np.ndarray, mark: bytes) -> pa.Array:
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, values), _mark(mark))


def _digits(ids: np.ndarray) -> pa.Array:
    return pa.array(ids).cast(pa.large_string()).cast(pa.large_binary())


class _Fragments:
    """Different fragments of a batch: which ones both tokenizers spell out, their counts, pairs and written groups."""

    def __init__(self, fragments: pa.Array, a_path: str, b_path: str):
        a, b, a_bytes, b_bytes, _ = _tokenizers(a_path, b_path)
        texts = [f.decode("utf-8", "replace") for f in fragments.to_pylist()]
        a_lists = _lists(_encoded(a, texts))
        b_lists = _lists(b.encode([t[1:] for t in texts], num_threads=1))  # adds the space itself
        a_parent, a_end, a_joined = _spelt(a_lists, a_bytes)
        b_parent, b_end, b_joined = _spelt(b_lists, b_bytes)
        self.good = pc.and_(pc.equal(a_joined, fragments), pc.equal(b_joined, fragments))
        left = pa.table({"fragment": a_parent, "end": a_end, "a": a_lists.flatten()}).filter(self.good.take(a_parent))
        right = pa.table({"fragment": b_parent, "end": b_end, "b": b_lists.flatten()}).filter(self.good.take(b_parent))
        both = left.join(right, ["fragment", "end"], join_type="full outer", use_threads=False)
        both = both.sort_by([("fragment", "ascending"), ("end", "ascending")]).combine_chunks()
        fragment = both["fragment"].to_numpy()
        has_a, has_b = (pc.is_valid(both[c]).to_numpy() for c in "ab")
        # a fragment ends on both sides, so the next end on either side lies within it
        a_id, b_id = (pc.fill_null_backward(both[c]).to_numpy().astype(np.int64) for c in "ab")
        closes, n = has_a & has_b, len(fragments)
        count = lambda mask: np.bincount(fragment[mask], minlength=n).astype(np.int64)
        self.counts = {"n_a": count(has_a), "n_b": count(has_b), "n_groups": count(closes),
                       "n_links": np.bincount(fragment, minlength=n).astype(np.int64)}
        sides = [_joined(_digits(i[has]), np.cumsum(has)[closes], b",") for i, has in ((a_id, has_a), (b_id, has_b))]
        groups = pc.binary_join_element_wise(*sides, _mark(b"|"))
        self.written = _joined(groups, np.cumsum(self.counts["n_groups"]), b";")
        links = pa.table({"fragment": fragment, "pair": (a_id * STEP + b_id).astype(np.int32)})
        self.pairs = links.group_by(["fragment", "pair"], use_threads=False).aggregate([([], "count_all")]).rename_columns(
            ["fragment", "pair", "times"])


def _aligned(part, a_path: str, b_path: str) -> dict[str, list | pa.Array]:
    """Columns of the texts in ``part``, each beginning with a space."""
    at = _fragment_starts(part.data, part.start, _tokenizers(a_path, b_path)[4])
    offsets = np.append(at, len(part.data)).astype(np.int64)
    found = pa.Array.from_buffers(
        pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(part.data))])
    coded = found.dictionary_encode()
    which, kinds = coded.indices.to_numpy(), _Fragments(coded.dictionary, a_path, b_path)
    first = np.searchsorted(at, np.append(part.start, len(part.data)))
    doc = np.repeat(np.arange(len(part.start)), np.diff(first))
    good = np.ones(len(part.start), bool)
    good[doc[~kinds.good.to_numpy(zero_copy_only=False)[which]]] = False
    out: dict = {"n_docs": len(part.start)}
    for name in _COLUMNS:
        total = np.concatenate([[0], np.cumsum(kinds.counts[name][which])])
        out[name] = np.where(good, total[first[1:]] - total[first[:-1]], 0)
    kept = good[doc]
    uses = pa.table({"doc": doc[kept], "fragment": which[kept].astype(np.int64)})
    uses = uses.group_by(["doc", "fragment"], use_threads=False).aggregate([([], "count_all")]).rename_columns(
        ["doc", "fragment", "uses"])
    links = uses.join(kinds.pairs, ["fragment"], join_type="inner", use_threads=False)
    links = links.append_column("n", pc.multiply(links["uses"], links["times"]))
    links = links.group_by(["doc", "pair"], use_threads=False).aggregate([("n", "sum")])
    key = (links["doc"].to_numpy().astype(np.int64) << 32) + links["pair"].to_numpy()
    order = np.argsort(key)
    ends = np.searchsorted(key[order] >> 32, np.arange(len(part.start) + 1))
    for name, column in (("pairs", "pair"), ("times", "n_sum")):
        out[name] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(links[column].to_numpy()[order]))
    written = kinds.written
    out["groups_sha256"] = [
        hashlib.sha256(b";".join(written.take(pa.array(which[lo:hi])).to_pylist())).hexdigest() if ok else ""
        for lo, hi, ok in zip(first[:-1], first[1:], good, strict=True)]
    return out


def _rows(a_path: str, b_path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.large_binary()), b"")
            full = pc.greater(pc.binary_length(texts), 0)
            names = ["doc", "uid", *_COLUMNS, "groups_sha256", "pairs", "times"]
            blank = batch.filter(pc.invert(full))
            zero = pa.array(np.zeros(len(blank), np.int64))
            none = pa.array([[]] * len(blank), pa.list_(pa.int64()))
            yield pa.record_batch(
                [blank.column("doc"), pa.array(np.arange(uid, uid + len(blank))), zero, zero, zero, zero,
                 pa.array([""] * len(blank), pa.string()), none.cast(pa.list_(pa.int32())), none], names)
            uid += len(blank)
            keys = batch.column("doc").filter(full)
            spaced = pc.binary_join_element_wise(_mark(b" "), texts.filter(full), _mark(b""))
            for part in pieces(spaced, CHUNK):
                got = _aligned(part, a_path, b_path)
                n = got["n_docs"]
                yield pa.record_batch(
                    [keys.slice(part.row[0], n), pa.array(np.arange(uid, uid + n)), *(pa.array(got[c]) for c in _COLUMNS),
                     pa.array(got["groups_sha256"], pa.string()), got["pairs"], got["times"]], names)
                uid += n

    return rows


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that hold each pair, counted per task; handed on whenever many pairs have come together."""
    held = None
    for batch in batches:
        own = pa.table({"pair": batch.column("pairs").flatten()}).group_by("pair", use_threads=False).aggregate(
            [([], "count_all")]).rename_columns(["pair", "n"])
        held = own if held is None else pa.concat_tables([held, own]).group_by("pair", use_threads=False).aggregate(
            [("n", "sum")]).rename_columns(["pair", "n"])
        if len(held) > HELD:
            yield from held.to_batches()
            held = None
    if held is not None:
        yield from held.to_batches()


def align(docs: DataFrame, a_path: str, b_path: str, doc: str = "doc_id", text: str = "text", part: int = PART) -> DataFrame:
    """Per row of ``docs``: tokens of both kinds, groups between common ends, links, and how common its links are.

    ``n_links`` counts overlapping pairs of tokens, ``count_sum`` adds up in how many rows of the corpus each pair is
    linked, ``n_best`` counts the links whose pair is the most frequent of its first id (ties included), and
    ``groups_sha256`` digests the ids of all groups in order. Texts that are null or empty, or that either tokenizer does
    not spell byte for byte (after the space put before them), have no tokens: zeros and an empty digest. Every row counts
    as a document of its own, also with a null or repeated key; an empty table gives no rows; other columns are not used.
    Texts are aligned whole; a task holds one text, or about ``CHUNK`` bytes of shorter ones.
    """
    key = docs.schema[doc].dataType.simpleString()
    shape = (f"doc {key}, uid long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
             "pairs array<int>, times array<long>")
    own = docs.select(F.col(doc).alias("doc"), F.col(text).cast("binary").alias("text"))
    rows = stored(own.mapInArrow(_rows(a_path, b_path), shape))
    counts = stored(rows.select("pairs").mapInArrow(_partial_counts, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    top = counts.groupBy(F.shiftright("pair", 15).alias("a")).agg(F.max("n").alias("top"))
    judged = counts.join(top, F.shiftright(counts["pair"], 15) == top["a"]).select(
        "pair", "n", (F.col("n") == F.col("top")).alias("best"))
    links = rows.select("uid", F.inline(F.arrays_zip("pairs", "times")).alias("pair", "times"))
    parts = max(1, -(-counts.count() // part))
    sums = None
    for i in range(parts):
        mine = lambda df: df.where(F.pmod(F.xxhash64("pair"), F.lit(parts)) == i) if parts > 1 else df
        met = mine(links).join(F.broadcast(mine(judged)), "pair").groupBy("uid").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        sums = met if sums is None else sums.unionByName(met)
    if parts > 1:
        sums = sums.groupBy("uid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.drop("pairs", "times").join(sums, "uid", "left").select(
        F.col("doc").alias(doc), *_COLUMNS, F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")
