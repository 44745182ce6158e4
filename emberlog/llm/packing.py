"""Best-fit packing of documents into token sequences, improved by a swap-based local search.

Every document becomes its token ids and an end id. Documents longer than a sequence are cut from
the end into whole sequences; what is left is the first piece. Whole pieces are sequences of their
own, so each document has at most one piece to pack.

Pieces are dealt by a hash into buckets of about ``BUCKET`` pieces, whatever documents they come
from. In a bucket, best fit by decreasing length makes bins; then the search takes the emptiest
bin and moves its pieces elsewhere, or exchanges one or two of them for one piece of a fuller bin.
Each step raises the sum of squared fills, as the fuller bin gains what the emptier one loses, and
ends when that bin is empty or nothing fits. Bins left with more than ``SLACK`` free places are
opened again and their pieces dealt into new buckets, ``ROUNDS`` times in all, so the last bins of
many buckets share sequences.

Tokenizing goes piece of text by piece of text with a cache of bounded size, which forgets the
pieces that were not used for longest; it gives the ids
that the tokenizer gives for the whole text; texts with characters outside of Latin letters and
ASCII go through the tokenizer whole.

NULL texts are empty: their one token is the end id. Repeated rows, rows without an id and equal
texts are packed like any others; every row is packed. An empty table gives an empty table.
"""

from __future__ import annotations

import ctypes
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.registry import query
from emberlog.llm.support import small_batches, table, written

CAPACITY = 1024
END_ID = 2
BUCKET = 8192
SLACK = 8
ROUNDS = 2
CACHED_WORDS = 100_000

# How a byte-level tokenizer splits text before merging, for the characters of _PLAIN only.
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PLAIN = "\t\n\r -~\xa0-ɏ"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """Bytes and ids of all tokens of a byte-level tokenizer, if merging whatever gives the token of
    the least id comes to the same as its list of merges; else None.

    It does if merges are listed by id and each token is what its own text is merged to: as long
    as no merge crosses the ends of a token's text, what happens inside is what happens to that
    text alone, so no other two parts of it ever meet.
    """
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocab = model.get("vocab") or {}
    # Byte-level tokenizers write a byte as the character of that code or, if that is no visible one,
    # as the next character from 256 on.
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(seen)]
    of_char = {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(others)}
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model.get("merges", ())]
    order = [vocab.get(m, -1) for m in merges]
    odd = {t for t, i in vocab.items() if set(t) - set(of_char)}
    made = {*merges, *of_char}
    plain = [t for t in vocab if t not in odd and t in made]
    if model.get("type") != "BPE" or order != sorted(set(order)) or not set(of_char) <= set(vocab):
        return None
    from tokenizers import Tokenizer

    merge = Tokenizer.from_file(path).model.tokenize
    if any(len(merge(t)) != 1 for t in plain):
        return None
    return {bytes(of_char[c] for c in t): vocab[t] for t in plain}


class Encoder:
    """Token ids, as little-endian 32-bit bytes, of many texts. ``ranks``, if there are any, tell the
    ids of single pieces without the tokenizer."""

    def __init__(self, path: str, ranks: dict[bytes, int] | None = None):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = None
        if ranks:
            import tiktoken

            # A text that comes to it is one piece.
            self.merge = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        # Words used lately, and those used before them, which go when there are too many.
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.plain = re.compile(f"[{_PLAIN}]*")
        self.split = re.compile(
            # Words come first, as most pieces are; nothing else begins like them.
            f" ?[{_LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_DIGIT}]+"
            f"| ?[^\\s{_LETTER}{_DIGIT}]+|\\s+(?!\\S)|\\s+"
        ).findall
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content for t in added]

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def learn(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of single pieces. Those of a space and letters are encoded as one text, which the
        tokenizer splits at each of them again; others as one text with line ends between them,
        which are pieces of their own wherever something else than white space follows."""
        if self.merge:
            yield from zip(words, (array("I", ids).tobytes() for ids in map(self.merge, words)))
            return
        spaced, others, blank = [], [], []
        for w in words:
            (spaced if w[0] == " " and w[1:2].isalpha() else blank if w.isspace() else others).append(w)
        for pieces, text, step in ((spaced, "".join(spaced), 1), (others, "\n" + "\n".join(others), 2)):
            if pieces:
                found = self.tokenizer.encode(text, add_special_tokens=False)
                places = np.array(found.word_ids)
                at = np.arange(len(pieces)) * step + (step - 1)
                starts, ends = np.searchsorted(places, at) * 4, np.searchsorted(places, at, "right") * 4
                ids = np.array(found.ids, "<u4").tobytes()
                yield from zip(pieces, (ids[a:b] for a, b in zip(starts.tolist(), ends.tolist())))
        yield from zip(blank, self.whole(blank))

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [
            self.plain.fullmatch(t) is not None and not any(s in t for s in self.special) for t in texts
        ]
        split = [self.split(t) if p else () for t, p in zip(texts, plain)]
        new = set().union(*split).difference(self.words)
        self.words.update((w, self.older[w]) for w in new.intersection(self.older))
        self.words.update(self.learn(list(new.difference(self.older))))
        known = self.words
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        odd = [i for i, p in enumerate(plain) if not p]
        for i, ids in zip(odd, self.whole([texts[i] for i in odd])):
            out[i] = ids
        if len(known) > CACHED_WORDS // 2:
            self.words, self.older = {}, known
        return out


def _trim() -> None:
    """Give memory that is free back to the system, where the C library can."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: only the first may be shorter."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


_PIECES = "id long, piece int, start long, length long, ids_crc32 long, uid long"


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool, ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Lives as long as the task: a worker may serve others after it, or stay idle.
        encoder = Encoder(path, ranks.value)
        end = np.array([end_id], "<u4").tobytes()
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            _trim()
            for at, rows in _portions(batch):
                rows_out = []
                texts = [t or "" for t in rows.column(1).to_pylist()]
                for doc, ids in zip(rows.column(0).to_pylist(), encoder.encode(texts)):
                    ids += end
                    for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        part = ids[4 * start : 4 * (start + length)]
                        row = (doc, k, start, length, zlib.crc32(part), uid)
                        rows_out.append((*row, np.frombuffer(part, "<u4").astype(np.int32)) if with_ids else row)
                        uid += 1
                cols = list(zip(*rows_out))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                names = ["id", "piece", "start", "length", "ids_crc32", "uid"]
                if with_ids:
                    kinds, names = [*kinds, pa.list_(pa.int32())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
        del encoder
        _trim()

    return run


def _portions(batch: pa.RecordBatch, rows: int = 200) -> Iterator[tuple[int, pa.RecordBatch]]:
    for at in range(0, batch.num_rows, rows):
        yield at, batch.slice(at, rows)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of items: each item, the longest first, goes where least room is left."""
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free places
    mask = 0
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        size = lengths[i]
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = open_[free].pop()
            if not open_[free]:
                mask &= ~(1 << free)
            bins[b].append(i)
            free -= size
        else:
            b = len(bins)
            bins.append([i])
            free = capacity - size
        if free:
            open_[free].append(b)
            mask |= 1 << free
    return bins


def local_search(lengths: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Empty bins by moves, one-for-one and two-for-one exchanges with fuller bins."""
    size = np.array(lengths, np.int64)
    place = np.empty(len(lengths), np.int64)
    for b, items in enumerate(bins):
        place[items] = b
    members = [set(items) for items in bins]
    fill = np.bincount(place, weights=size, minlength=len(bins)).astype(np.int64)
    # Only pieces of bins with room can take part; the others are never looked at again.
    queue = sorted(np.flatnonzero(fill < capacity), key=lambda b: fill[b])
    room = fill < capacity
    pool = np.flatnonzero(room[place])
    for b in queue:
        if fill[b] >= capacity:
            continue
        while members[b]:
            step = _step(b, size, place, members, fill, pool, capacity)
            if step is None:
                break
            out, back, to = step
            for i in out:
                members[b].discard(i)
                members[to].add(i)
                place[i] = to
            if back is not None:
                members[to].discard(back)
                members[b].add(back)
                place[back] = b
            moved = size[list(out)].sum() - (size[back] if back is not None else 0)
            fill[b] -= moved
            fill[to] += moved
    return [sorted(m) for m in members if m]


def _step(b, size, place, members, fill, pool, capacity):
    """The next step that empties bin ``b``: (pieces out, piece back or None, bin), or None."""
    own = sorted(members[b], key=lambda i: -size[i])
    room = capacity - fill
    others = np.flatnonzero((fill >= fill[b]) & (room > 0))
    others = others[others != b]
    if not len(others):
        return None
    for i in own:  # a move to the bin where it fits best
        fits = others[room[others] >= size[i]]
        if len(fits):
            return (i,), None, fits[room[fits].argmin()]
    at = pool[(place[pool] != b) & (fill[place[pool]] >= fill[b]) & (room[place[pool]] > 0)]
    free, have = room[place[at]], size[at]
    # Of pieces of one length two stand for all, and of sets of one total the first for all.
    some, sets = [i for k, i in enumerate(own) if k < 2 or size[i] != size[own[k - 2]]], {}
    for out in [(i,) for i in some] + [(i, j) for k, i in enumerate(some) for j in some[k + 1 :]]:
        sets.setdefault((len(out), int(size[list(out)].sum())), out)
    for out in sets.values():  # an exchange that leaves the other bin as full as it can be
        gain = size[list(out)].sum() - have
        good = (gain > 0) & (gain <= free)
        if good.any():
            k = np.where(good, gain, -1).argmax()
            return out, at[k], place[at[k]]
    return None


def _pack_bucket(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            buckets = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1), len(buckets)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and buckets[a] != key:
                    yield from _placed(held, capacity)
                    held = []
                key = buckets[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from _placed(held, capacity)

    return run


def _placed(held: list[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(held).combine_chunks()
    lengths = rows.column("length").to_pylist()
    uid = rows.column("uid").to_numpy()
    bins = local_search(lengths, best_fit(lengths, capacity), capacity)
    sequence, offset, fill = (np.empty(len(lengths), np.int64) for _ in range(3))
    for items in bins:
        at = 0
        for i in items:
            sequence[i], offset[i] = uid[items[0]], at
            at += lengths[i]
        fill[items] = at
    rows = rows.drop_columns(["bucket"])
    for name, values in (("sequence_id", sequence), ("offset", offset), ("fill", fill)):
        rows = rows.append_column(name, pa.array(values))
    yield from rows.to_batches()


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID,
         tokenizer: str | None = None, with_ids: bool = False,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset and, if asked
    for, ``ids``. A sequence is named after the piece it begins with."""
    path = tokenizer or default_tokenizer()
    small_batches(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(byte_ranks(path))  # a vocabulary, half a megabyte
    schema = _PIECES + (", ids array<int>" if with_ids else "")
    pieces = written(
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(_pieces(path, capacity, end_id, with_ids, ranks), schema),
        "pieces",
    )
    done = pieces.filter(F.col("length") == capacity).select(
        "*", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = pieces.filter(F.col("length") < capacity)
    for turn in range(ROUNDS):
        buckets = max(1, -(-rest.count() // BUCKET))
        packed = written(
            rest.withColumn("bucket", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(buckets)))
            .repartition("bucket").sortWithinPartitions("bucket", "uid")
            .mapInArrow(_pack_bucket(capacity), f"{schema}, sequence_id long, offset long, fill long"),
            "packed",
        )
        full = F.lit(turn == ROUNDS - 1) | (F.col("fill") >= capacity - SLACK)
        done = done.unionByName(packed.filter(full).drop("fill"))
        rest = packed.filter(~full).drop("fill", "sequence_id", "offset")
    columns = [c for c in done.columns if c not in ("id", "uid")]
    return done.select(F.col("id").alias(id_col), *columns)


@query("op6_best_fit_packing")
def _op6(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
