"""Token ids written as Re-Pair compressed shards with random access.

File format (``MAGIC``): a table of shards in Parquet, one binary per shard, so any store that Spark
reaches can hold it. A shard holds the ids of consecutive documents:

    magic 4 bytes | version, rules, symbols, documents, first free symbol: uint32 each
    rules:      2 uint32 a rule (left, right); rule k is symbol first_free + k
    symbols:    the compressed sequence, uint32
    lengths:    expanded length of every rule, uint32
    documents:  for each document its first symbol, and its number of ids, uint32

Re-Pair runs in batches: each round counts all adjacent pairs of the shard and replaces those that occur at least
``LEAST`` times; where two such pairs overlap, the more frequent one goes first. Rounds go on until no pair is that
frequent. The end id may also stand inside a text, so while it is compressed each document ends in a symbol of its
own, outside the vocabulary, that no pair holds: every document begins at a symbol boundary and can be expanded
alone; inside it, expansion lengths lead to any position.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import parts_for, save, scratch_dir
from ._words import mix, tidied, tidy

MAGIC = b"RPG1"
END = 1
LEAST = 12
_SLOTS = 18
_CACHE_MOST = 300_000  # entries of each of an encoder's caches; they only save work


# ---- Re-Pair -------------------------------------------------------------------------------------


def _frequent(seq: np.ndarray, places: np.ndarray, least: int, bar: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs at ``places``: those that occur at least ``least`` times, in order, their counts, all places of them and which pair stands there."""
    slot = seq[places] * np.uint32(2654435769)
    slot += seq[places + 1] * np.uint32(2246822519)
    slot >>= np.uint32(32 - _SLOTS)
    often = np.bincount(slot, minlength=1 << _SLOTS) >= least  # a slot holds all occurrences of its pairs
    keep = often[slot] & (seq[places] != bar) & (seq[places + 1] != bar)
    places, slot = places[keep], slot[keep]
    pair = (seq[places].astype(np.uint64) << np.uint64(32)) | seq[places + 1]
    order = np.sort(pair)
    first = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]])) if len(order) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(order)))
    pairs, counts = order[first][counts >= least], counts[counts >= least]
    if not len(pairs):
        return pairs, counts, places[:0], places[:0]
    # which pair stands at a place: by its slot, and by search where two frequent pairs share a slot
    high, low = (pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32)
    home = (high * np.uint32(2654435769) + low * np.uint32(2246822519)) >> np.uint32(32 - _SLOTS)
    stands = np.full(1 << _SLOTS, -1, np.int32)
    stands[home] = np.arange(len(pairs), dtype=np.int32)
    which = stands[slot]
    own = which >= 0
    own[own] = pairs[which[own]] == pair[own]
    shared = np.zeros(1 << _SLOTS, bool)
    shared[home[stands[home] != np.arange(len(pairs))]] = True
    rest = np.flatnonzero(~own & shared[slot])
    at = np.minimum(np.searchsorted(pairs, pair[rest]), len(pairs) - 1)
    found = pairs[at] == pair[rest]
    which[rest[found]], own[rest[found]] = at[found], True
    return pairs, counts, places[own], which[own]


def compress(ids: np.ndarray, least: int = LEAST, first_free: int | None = None, bar: int = END) -> tuple[np.ndarray, np.ndarray, int]:
    """The compressed symbols, the rules (n, 2) and the first rule's symbol; no pair holds ``bar``."""
    seq = ids.astype(np.uint32)
    free = int(seq.max()) + 1 if first_free is None and len(seq) else (first_free or 0)
    rules: list[np.ndarray] = []
    at = free
    open_ = np.arange(max(0, len(seq) - 1))  # places where a frequent pair may stand: all, then those that a round has left or made
    while len(open_):
        pairs, counts, places, which = _frequent(seq, open_, least, bar)
        if not len(pairs):
            break
        # a pair goes before its neighbours if it is more frequent; ties go by a hash, runs of one pair from the left
        rank = np.empty(len(pairs), np.int64)
        rank[np.lexsort((mix(pairs), counts))] = np.arange(len(pairs))
        weight = rank[which]
        near = places[1:] == places[:-1] + 1
        beats = np.ones(len(places), bool)
        beats[1:] &= ~near | (weight[1:] >= weight[:-1])
        beats[:-1] &= ~near | (weight[:-1] >= weight[1:])
        run = np.ones(len(places), bool)
        run[1:] = ~(near & (which[1:] == which[:-1]))
        head = np.maximum.accumulate(np.where(run, np.arange(len(places)), 0))
        beats &= (np.arange(len(places)) - head) % 2 == 0
        met = places
        places, which = places[beats], which[beats]
        stay = np.ones(len(places), bool)  # the last of an odd run may touch the next pair
        stay[1:] = places[1:] != places[:-1] + 1
        places, which = places[stay], which[stay]
        used = np.bincount(which, minlength=len(pairs))
        good = used >= min(4, used.max())  # fewer places don't pay for a rule
        number = np.cumsum(good) - 1
        inside = good[which]
        places, which = places[inside], which[inside]
        seq[places] = (at + number[which]).astype(np.uint32)
        left = np.ones(len(seq), bool)
        left[places + 1] = False
        moved = np.cumsum(left) - 1
        seq = seq[left]
        mark = np.zeros(len(seq) + 1, bool)
        mark[moved[met[left[met]]]] = True
        mark[moved[places]] = True
        mark[moved[places] - 1] = True  # before the first symbol: the spare place
        open_ = np.flatnonzero(mark[: max(0, len(seq) - 1)])
        new = pairs[good]
        rules.append(np.stack([(new >> np.uint64(32)).astype(np.uint32), new.astype(np.uint32)], 1))
        at += len(new)
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), free


def _poured(symbols: np.ndarray, flat: np.ndarray, begin: np.ndarray, size: np.ndarray, free: int) -> np.ndarray:
    """``symbols`` with each rule's symbol replaced by its ids ``flat[begin : begin + size]``."""
    high = symbols >= free
    rule = symbols[high].astype(np.int64) - free
    n = np.ones(len(symbols), np.int64)
    n[high] = size[rule]
    to = np.cumsum(n) - n
    out = np.empty(int(n.sum()), np.uint32)
    out[to[~high]] = symbols[~high]
    n = n[high]
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(to[high], n) + step] = flat[np.repeat(begin[rule], n) + step]
    return out


def rule_lengths(rules: np.ndarray, free: int) -> np.ndarray:
    """Expanded length of every rule; rules hold earlier ones only."""
    size = np.ones(len(rules), np.int64)
    for a, b in _levels(rules, free):
        part = rules[a:b]
        size[a:b] = np.where(part >= free, size[np.maximum(part.astype(np.int64) - free, 0)], 1).sum(1)
    return size


def _levels(rules: np.ndarray, free: int):
    """Runs of rules that hold only rules before the run."""
    highest = rules.max(1).astype(np.int64) if len(rules) else np.zeros(0, np.int64)
    a = 0
    while a < len(rules):
        late = np.flatnonzero(highest[a:] >= free + a)
        b = a + int(late[0]) if len(late) else len(rules)
        yield a, b
        a = b


def flattened(rules: np.ndarray, free: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of all rules one after another, where each begins, and how many they are; rules hold earlier ones only."""
    size = rule_lengths(rules, free)
    begin = np.cumsum(size) - size
    flat = np.empty(int(size.sum()), np.uint32)
    for a, b in _levels(rules, free):
        flat[begin[a] : begin[b - 1] + size[b - 1]] = _poured(rules[a:b].ravel(), flat, begin, size, free)
    return flat, begin, size


def expand(symbols: np.ndarray, rules: np.ndarray, free: int) -> np.ndarray:
    """The ids of ``symbols``."""
    return _poured(symbols, *flattened(rules, free), free)


def pack(ids: np.ndarray, sizes: np.ndarray, first_free: int | None = None) -> bytes:
    """One shard of the file format; ``sizes`` are the documents' numbers of ids, each with its end id."""
    last = np.cumsum(sizes) - 1
    bar = max(int(ids.max()) + 1 if len(ids) else 0, first_free or 0)
    marked = ids.astype(np.uint32)
    marked[last] = bar
    seq, rules, free = compress(marked, first_free=bar + 1, bar=bar)
    ends = np.flatnonzero(seq == bar) + 1
    seq[ends - 1] = ids[last]
    begins = np.concatenate([[0], ends[:-1]]).astype("<u4") if len(sizes) else np.zeros(0, "<u4")
    return b"".join([MAGIC, struct.pack("<5I", 1, len(rules), len(seq), len(sizes), free), rules.astype("<u4").tobytes(), seq.astype("<u4").tobytes(), rule_lengths(rules, free).astype("<u4").tobytes(), begins.tobytes(), np.asarray(sizes).astype("<u4").tobytes()])


class Shard:
    """Reader of one shard: all ids, one document, or a slice of one document."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a shard")
        _, n_rules, n_seq, n_docs, self.free = struct.unpack_from("<5I", blob, 4)
        a = np.frombuffer(blob, "<u4", offset=24)
        cut = np.cumsum([2 * n_rules, n_seq, n_rules, n_docs])
        self.rules, self.seq = a[: cut[0]].reshape(-1, 2), a[cut[0] : cut[1]]
        self.lengths, self.begins, self.sizes = a[cut[1] : cut[2]], a[cut[2] : cut[3]], a[cut[3] :]

        self.flat = flattened(self.rules, self.free)

    def ids(self) -> np.ndarray:
        return _poured(self.seq, *self.flat, self.free)

    def document(self, k: int, start: int = 0, count: int | None = None) -> np.ndarray:
        to = self.begins[k + 1] if k + 1 < len(self.begins) else len(self.seq)
        part = self.seq[self.begins[k] : to]
        count = int(self.sizes[k]) - start if count is None else count
        high = part >= self.free
        size = np.ones(len(part), np.int64)
        size[high] = self.lengths[part[high] - np.uint32(self.free)]
        ends = np.cumsum(size)
        a = int(np.searchsorted(ends, start, side="right"))
        b = int(np.searchsorted(ends, start + count, side="left")) + 1
        skip = start - (int(ends[a - 1]) if a else 0)
        return _poured(part[a:b], *self.flat, self.free)[skip : skip + count]


# ---- tokenizing ----------------------------------------------------------------------------------

# no "<" or ">": special tokens stay with the library. A chunk is cut here only if its lower-cased form stays in the range too.
_PLAIN = re.compile(r"[!-;=?-~À-ÖØ-öø-įı-ɏ]+").fullmatch
_LOWERED = re.compile(r"[!-;=?-@\[-~ß-öø-ɏ]+").fullmatch
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ɏ]+|[0-9]|[^\sa-z0-9ß-öø-ɏ]+").findall


class Encoder:
    """Ids of whole texts, equal to the library's, through a cache by white-space separated chunk.

    The normaliser and the pre-tokenizer of this vocabulary never look across white space. A chunk of plain
    Latin letters, digits and ASCII signs is cut by the same pattern and given to the library's model piece
    by piece; any other chunk is encoded by the library as it stands. Caches hold ids as bytes of uint32.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level alphabet: printable bytes stand for themselves
        rest = [b for b in range(256) if b not in keep]
        self.bytes = {b: b for b in keep} | {b: 256 + k for k, b in enumerate(rest)}
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {"": b""}

    def piece(self, text: str) -> bytes:
        said = text if text.isascii() else text.encode().decode("latin1").translate(self.bytes)
        got = array("I", [t.id for t in self.model.tokenize(said)]).tobytes()
        if len(self.pieces) < _CACHE_MOST:
            self.pieces[text] = got
        return got

    def chunk(self, text: str) -> bytes:
        low = text.lower()
        if text.isascii() and text.isalpha():
            out = self.pieces.get(low) or self.piece(low)
        elif _PLAIN(text) and _LOWERED(low):
            out = b"".join([self.pieces.get(x) or self.piece(x) for x in _PIECE(low)])
        else:
            out = array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self.chunks) < _CACHE_MOST:
            self.chunks[text] = out
        return out

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, END after each text, and the number of ids of each text with its END."""
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        offsets, words = split.offsets.to_numpy().astype(np.int64), split.flatten().dictionary_encode()
        del split  # a batch is large: what is no longer needed goes at once
        get, make = self.chunks.get, self.chunk
        known = [make(w) if (ids := get(w)) is None else ids for w in words.dictionary.to_numpy(zero_copy_only=False).tolist()]
        begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, known), np.int64, len(known)) // 4)])
        each = pa.LargeListArray.from_arrays(pa.array(begin), pa.array(np.frombuffer(b"".join(known), np.uint32)))
        poured = each.take(words.indices)
        del known, begin, each, words
        ends = poured.offsets.to_numpy()[offsets - offsets[0]]
        sizes = np.diff(ends) + 1
        out = np.full(int(ends[-1] - ends[0]) + len(texts), END, np.uint32)
        to = np.ones(len(out), bool)
        to[np.cumsum(sizes) - 1] = False
        out[to] = poured.flatten().to_numpy()
        return out, sizes


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# ---- Spark ---------------------------------------------------------------------------------------

#: shards whose texts are encoded together, as each distinct word of them is looked up once
AT_ONCE = 8

FILE_SCHEMA = "part int, block int, before bigint, doc_ids array<bigint>, n_ids bigint, shard binary"


def _lengths(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _cut(batches, shard_bytes: int):
    """(doc_ids, texts) of consecutive rows, cut where the text of a partition passes a multiple of ``shard_bytes``."""
    ids, texts, done = [], [], 0
    for batch in batches:
        upto = done + np.cumsum(_lengths(batch.column(1)))
        at = 0
        for to in np.flatnonzero(np.diff(np.concatenate([[done], upto]) // shard_bytes)) + 1:
            ids.append(batch.column(0).slice(at, to - at))
            texts.append(batch.column(1).slice(at, to - at))
            yield pa.concat_arrays(ids), pa.concat_arrays(texts)
            ids, texts, at = [], [], int(to)
        if at < batch.num_rows:
            ids.append(batch.column(0).slice(at))
            texts.append(batch.column(1).slice(at))
        done = int(upto[-1]) if len(upto) else done
    if ids:
        yield pa.concat_arrays(ids), pa.concat_arrays(texts)


def write_shards(docs: DataFrame, tokenizer_path: str, shard_bytes: int = 2 << 20, path: str | None = None) -> DataFrame:
    """Encode ``docs(doc_id, text, ...)`` in ascending doc_id order (nulls first, ties by a hash of the text) and write the shards.

    They go to ``path``, by default to a table in the shared folder, and are returned reread. Texts move once,
    range-partitioned by doc_id and hash, so rows that share an id may lie in several partitions; each partition is
    sorted and cut into shards of about ``shard_bytes`` of text, and a task holds ``AT_ONCE`` of them at a time. A text
    that is longer ends its shard. Null and empty texts are one END. Repeated rows are written as often as they occur.
    An empty table writes no shard. Columns other than doc_id and text are not looked at.
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        coder = encoder(tokenizer_path)
        free = coder.whole.get_vocab_size()
        block = before = 0
        for ids, texts in _cut(batches, AT_ONCE * shard_bytes):
            out, n = coder.column(texts)
            upto = np.cumsum(_lengths(texts))
            edges = sorted({0, *(np.flatnonzero(np.diff(np.concatenate([[0], upto]) // shard_bytes)) + 1).tolist(), len(ids)})
            tokens = np.concatenate([[0], np.cumsum(n)])
            for lo, hi in zip(edges, edges[1:]):
                own = out[tokens[lo] : tokens[hi]]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([ids.slice(lo, hi - lo).to_pylist()], pa.list_(pa.int64())), pa.array([len(own)], pa.int64()), pa.array([pack(own, n[lo:hi], free)], pa.binary())], ["part", "block", "before", "doc_ids", "n_ids", "shard"])
                block, before = block + 1, before + len(own)
            tidy()

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("t"))
    ordered = rows.repartitionByRange(parts_for(spark), "doc_id", "t").sortWithinPartitions("doc_id", "t").select("doc_id", "text")
    path = path or f"{scratch_dir(spark)}/token-shards-{uuid.uuid4().hex}"
    save(ordered.mapInArrow(tidied(run), FILE_SCHEMA), path)
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    by_part = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row for each partition that wrote, and so bounded by the number of tasks: it may pass one window and be broadcast
    base = by_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))

    def run(batches):
        for batch in batches:
            for base, ids, blob in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                s = Shard(blob.as_py())
                raw = s.ids().astype("<u4")
                to = np.cumsum(s.sizes.astype(np.int64))
                view = memoryview(raw).cast("B")
                crc = [zlib.crc32(view[4 * (b - n) : 4 * b]) for b, n in zip(to.tolist(), s.sizes.tolist())]
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(base + to - s.sizes, pa.int64()), pa.array(s.sizes, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = shards.join(F.broadcast(base), "part").select((F.col("base") + F.col("before")).alias("base"), "doc_ids", "shard")
    return placed.mapInArrow(tidied(run), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_output(docs: DataFrame, tokenizer_path: str, shard_bytes: int = 2 << 20, path: str | None = None) -> DataFrame:
    """Write ``docs`` as token shards to ``path`` (see ``write_shards``) and return what the files hold of each document.

    One row for each row of ``docs``, with ``doc_id, start, n_tokens, ids_crc32``; a null doc_id stays null.
    """
    return read_shards(write_shards(docs, tokenizer_path, shard_bytes, path))
