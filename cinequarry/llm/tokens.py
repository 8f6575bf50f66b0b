"""Token-id shards with a minimal-perfect-hash index.

Shard files are written by Spark's own writer, so any file system that Spark can
write to will do. A file holds the raw ids of its documents, little-endian, one after
the other, each document closed by the end id; then a directory of its documents; then
the directory's place:

    ids ... | keys int64[n] | lengths uint32[n] | n, width, documents without an id uint64 | 0x00

The index is a table of buckets. A bucket's row holds the displacements of its minimal
perfect hash and, by slot, a fingerprint and the place of the key's first document: its
shard, number and byte there, and length. One hash and one slot lead from a key to its
ids; the shard's directory then tells whether the key is really there. A few keys read
only the buckets they fall into."""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.shared import new_path

END_ID = 2
#: Stands for a null id among keys.
NULL_KEY = -(1 << 63)
#: Keys that a bucket of the index holds on average.
BUCKET_KEYS = 8192
#: Keys that share a displacement on average.
LOAD = 4
_FOOT, _FOOT_BYTES = "<QQQ", 24
#: Folders that the buckets of an index are dealt to; buckets that a lookup asks for one by one at most.
INDEX_PIECES, PRUNED = 256, 256
#: Bytes of pieces, their ids and the table that finds them that a worker keeps, about; twice that while old ones are given up.
CACHE_BYTES = 96 << 20
#: Characters of a piece that is kept at most, and bytes that an entry takes besides its piece and ids.
_LONGEST, _ENTRY = 64, 96
#: Texts are encoded together up to this many characters.
_CHUNK = 1 << 23
#: What a byte-level pre-tokenizer takes for white space; a piece begins with a space or line end that none comes before.
_SPACE = r"[\s\x{b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_CUT = r"([^\x00" + _SPACE[1:] + r")([ \n])"
#: A space or line end with Latin letters, and what follows from the first ASCII sign or digit on: a pre-tokenizer cuts between them.
_LATIN = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]"
_PART = r"(?s)^([ \n]" + _LATIN + r"+)([!-@\[-`{-~].*)$"
#: A space or line end, then no more white space, whether the tokenizer's or another's.
_SIMPLE = r"^[ \n][^" + _SPACE[1:-1] + r"\x{1c}-\x{1f}]+$"

#: Ids of items one after the other, and how many each has.
Ids = tuple[np.ndarray, np.ndarray]


def _ends(sizes: np.ndarray) -> np.ndarray:
    """0, then where each item ends."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])


def _gathered(ids: Ids, which: np.ndarray) -> Ids:
    """The ids of the items ``which``."""
    flat, sizes = ids
    own = sizes[which]
    until = _ends(own)
    kind = np.int32 if max(until[-1], len(flat)) < 1 << 31 else np.int64  # places of ids: a batch's largest arrays
    at = np.repeat(((_ends(sizes)[:-1])[which] - until[:-1]).astype(kind), own)
    at += np.arange(until[-1], dtype=kind)
    return flat[at], own


class Encoder:
    """Encodes whole texts with a tokenizer of the ``tokenizers`` library.

    A byte-level pre-tokenizer always cuts where white space follows something else, and
    looks at nothing that is further back; nor does it where letters end. So texts are cut
    there, each distinct piece is encoded once and its ids are kept as long as there is room,
    in arrays, so that a batch's pieces are looked up at once; new pieces are encoded as
    one text, whose ids part where a token begins with a space or line end. A text that
    names a special token, and any text if the tokenizer is of another kind, is encoded as
    a whole."""

    def __init__(self, path: str, width: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = width
        kind = json.loads(self.tokenizer.to_str())
        way = kind.get("pre_tokenizer") or {}
        self.parts = way.get("type") == "ByteLevel" and way.get("use_regex", True) and not way.get("add_prefix_space") and not kind.get("normalizer")
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()] + ["\0"]  # which is the mark of a cut
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for x, i in vocabulary.items() if x[:1] in ("\u0120", "\u010a")]] = True
        self.none: Ids = np.zeros(0, f"<u{width}"), np.zeros(0, np.int64)
        self.known, self.known_ids = pa.array([], pa.large_string()), self.none
        self.older, self.older_ids = self.known, self.none
        self.held = 0

    @staticmethod
    def of_worker(path: str, width: int) -> Encoder:
        """The worker process's own: tasks that follow find what earlier ones have encoded."""
        if (path, width) not in _OF_WORKER:
            _OF_WORKER[path, width] = Encoder(path, width)
        return _OF_WORKER[path, width]

    def raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, f"<u{self.width}").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def keep(self, pieces: pa.Array, ids: Ids) -> None:
        self.known = pa.concat_arrays([self.known, pieces])
        self.known_ids = tuple(np.concatenate(x) for x in zip(self.known_ids, ids, strict=True))
        self.held += (pc.sum(pc.binary_length(pieces)).as_py() or 0) + ids[0].nbytes + _ENTRY * len(pieces)
        if self.held > CACHE_BYTES:
            self.older, self.older_ids = self.known, self.known_ids
            self.known, self.known_ids, self.held = pieces[:0], self.none, 0

    def each(self, pieces: list[str]) -> Ids:
        ids = self.raw(pieces)
        return np.frombuffer(b"".join(ids), self.none[0].dtype), np.fromiter(map(len, ids), np.int64, len(ids)) // self.width

    def together(self, pieces: list[str]) -> Iterator[Ids]:
        """Ids of pieces that begin with their only space or line end."""
        for at in range(0, len(pieces), 64):  # the tokenizer's time grows faster than a text's length
            some = pieces[at : at + 64]
            whole = self.each(["".join(some)])[0]
            cuts = np.flatnonzero(self.opens[whole])
            yield (whole, np.diff(cuts, append=len(whole))) if len(cuts) == len(some) else self.each(some)

    def encoded(self, pieces: pa.Array) -> Ids:
        """Ids of new pieces."""
        simple = pc.match_substring_regex(pieces, _SIMPLE).to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)])
        texts, n = pieces.take(pa.array(order)).to_pylist(), int(simple.sum())
        ids = [self.none, *self.together(texts[:n]), self.each(texts[n:])]
        return _gathered(tuple(map(np.concatenate, zip(*ids, strict=True))), np.argsort(order))

    def ids_of(self, pieces: pa.Array) -> Ids:
        """Ids of distinct pieces, kept or new."""
        places = lambda x, among: pc.fill_null(pc.index_in(x, value_set=among), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        which = places(pieces, self.known)
        lacking = np.flatnonzero(which < 0)
        if not len(lacking):
            return _gathered(self.known_ids, which)
        rest = pieces.take(pa.array(lacking))
        at = places(rest, self.older) + len(self.known)
        new = at < len(self.known)
        at[new] = len(self.known) + len(self.older) + np.arange(new.sum())
        which[lacking] = at
        told = self.known_ids, self.older_ids, self.encoded(rest.filter(pa.array(new)))
        out = _gathered(tuple(map(np.concatenate, zip(*told, strict=True))), which)
        short = np.flatnonzero(pc.less_equal(pc.utf8_length(rest), _LONGEST).to_numpy(zero_copy_only=False))
        self.keep(rest.take(pa.array(short)), _gathered(out, lacking[short]))
        return out

    def together_cut(self, texts: list[str]) -> list[bytes]:
        marked = pa.array(texts, pa.large_string())
        runs = pc.any(pc.match_substring_regex(marked, _SPACE + r"[ \n]")).as_py()
        if runs:  # a piece begins with the whole of a run of white space
            marked = pc.replace_substring_regex(marked, _CUT, r"\1" + "\0" + r"\2")
        else:
            marked = pc.replace_substring(pc.replace_substring(marked, " ", "\0 "), "\n", "\0\n")
        cut = pc.split_pattern(marked, "\0")
        coded = pc.dictionary_encode(cut.flatten())
        parted = pc.split_pattern(pc.replace_substring_regex(coded.dictionary, _PART, r"\1" + "\0" + r"\2"), "\0")
        parts = pc.dictionary_encode(parted.flatten())
        flat, sizes = _gathered(self.ids_of(parts.dictionary), parts.indices.to_numpy())
        flat, sizes = _gathered((flat, np.diff(_ends(sizes)[parted.offsets.to_numpy()])), coded.indices.to_numpy())
        whole = flat.tobytes()
        edges = (_ends(sizes)[cut.offsets.to_numpy()] * self.width).tolist()
        return [whole[i:j] for i, j in zip(edges, edges[1:])]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text. Texts are worked on about _CHUNK characters at a time."""
        out: list[bytes] = []
        begin, size = 0, 0
        for at, text in enumerate(texts):
            size += len(text)
            if size < _CHUNK and at + 1 < len(texts):
                continue
            some = texts[begin : at + 1]
            whole = [not self.parts or any(x in t for x in self.special) for t in some]
            by_piece = iter(self.together_cut([t for t, w in zip(some, whole, strict=True) if not w]))
            as_whole = iter(self.raw([t for t, w in zip(some, whole, strict=True) if w]))
            out += [next(as_whole if w else by_piece) for w in whole]
            begin, size = at + 1, 0
        return out


_OF_WORKER: dict[tuple[str, int], Encoder] = {}


def write_shards(docs: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, vocabulary: int = 50_257) -> int:
    """Write every document's ids in ascending order of ``id_col`` and return the bytes of
    an id: 2 if the vocabulary fits, else 4. A null text is empty and has only its end id.

    One file is one range of ids, sorted; a null id sorts first. Rows that repeat an id
    follow each other, in order of a hash of their texts; one id's many rows can fill
    several files, unless their texts are equal too."""
    width = 2 if max(vocabulary - 1, end_id) < 1 << 16 else 4
    end = end_id.to_bytes(width, "little")
    if end[-1] >= 0x80:  # the writer's line end, which is text
        width, end = 4, end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.of_worker(tokenizer_path, width)
        keys, lengths, nulls = [], [], 0
        for batch in batches:
            rows = encode([x or "" for x in batch.column(1).to_pylist()])
            lengths += [len(r) // width + 1 for r in rows]
            nulls += batch.column(0).null_count
            yield pa.RecordBatch.from_arrays([pa.array([r + end[:-1] for r in rows], pa.binary())], names=["row"])
            keys.append(batch.column(0).cast(pa.int64()).fill_null(NULL_KEY).to_numpy())
        if lengths:  # the directory closes with a zero byte, or the end id's last byte
            directory = np.concatenate(keys).astype("<i8").tobytes() + np.array(lengths, "<u4").tobytes() + struct.pack(_FOOT, len(lengths), width, nulls)
            yield pa.RecordBatch.from_arrays([pa.array([directory], pa.binary())], names=["row"])

    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("key", F.xxhash64("text")).sortWithinPartitions("key", F.xxhash64("text"), "text")
    rows = rows.mapInArrow(run, "row binary").select(F.col("row").cast("string").alias("row"))
    rows.write.option("lineSep", end[-1:].decode()).text(path)
    return width


def _open(path: str) -> pa.NativeFile:
    fs, name = pyarrow.fs.FileSystem.from_uri(path)
    return fs.open_input_file(name)


class _Shard:
    """An open shard, its directory and how many of its documents have no id."""

    def __init__(self, path: str) -> None:
        self.file = _open(path)
        size = self.file.size()
        self.n = self.width = self.nulls = self.at = 0
        if size > _FOOT_BYTES:
            self.n, self.width, self.nulls = struct.unpack(_FOOT, self.bytes(size - _FOOT_BYTES - 1, _FOOT_BYTES))
            self.at = size - _FOOT_BYTES - 1 - 12 * self.n

    def bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def keys(self, first: int, n: int) -> np.ndarray:
        return np.frombuffer(self.bytes(self.at + 8 * first, 8 * n), "<i8")

    def lengths(self, first: int, n: int) -> np.ndarray:
        return np.frombuffer(self.bytes(self.at + 8 * self.n + 4 * first, 4 * n), "<u4").astype(np.int64)


def shard_files(spark: SparkSession, path: str) -> DataFrame:
    """(part: int, path): the shards, numbered in order of their documents."""
    files = spark.read.format("binaryFile").load(path)
    return files.where("length > 0").select(F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("int").alias("part"), "path")


def read_directories(spark: SparkSession, path: str) -> DataFrame:
    """(part, at: number of the document in its shard, key, offset: bytes, n_tokens, width)
    of every document, in file order. Only the ends of the files are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, name in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                shard = _Shard(name)
                with shard.file:
                    n, keys, lengths = shard.n, shard.keys(0, shard.n), shard.lengths(0, shard.n)
                offsets = (np.cumsum(lengths) - lengths) * shard.width
                columns = [np.full(n, part, np.int32), np.arange(n), keys, offsets, lengths, np.full(n, shard.width)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "at", "key", "offset", "n_tokens", "width"])

    return shard_files(spark, path).mapInArrow(run, "part int, at bigint, key bigint, offset bigint, n_tokens bigint, width bigint")


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """Three multiplications and shifts that spread 64-bit keys."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


@dataclass(frozen=True)
class PerfectHash:
    """Minimal perfect hash of n distinct 64-bit keys: a key's group gives a pair of
    displacements, and slot = (h1 + d0 * h2 + d1) mod n."""

    n: int
    seed: int
    d0: np.ndarray
    d1: np.ndarray

    @staticmethod
    def _parts(keys: np.ndarray, n: int, groups: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple((_mix(keys, 5 * seed + i) % np.uint64(m)).astype(np.int64) for i, m in ((1, groups), (2, n), (3, n)))

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Few keys can have equal hashes modulo n, and then another seed is taken."""
        return next(found for seed in count() if (found := cls._place(keys, seed)))

    @classmethod
    def _place(cls, keys: np.ndarray, seed: int) -> PerfectHash | None:
        """Groups are placed from the largest to the smallest, each at the first pair of
        displacements that hits free slots only."""
        n = len(keys)
        groups = max(1, -(-n // LOAD))
        group, h1, h2 = cls._parts(keys, n, groups, seed)
        order = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[order], np.arange(groups + 1))
        sizes = np.diff(cuts)
        d0, d1 = np.zeros(groups, np.int32), np.zeros(groups, np.int32)
        free = np.ones(n, bool)
        for g in np.argsort(-sizes, kind="stable").tolist():
            if not sizes[g]:
                break
            own = order[cuts[g] : cuts[g + 1]]
            if len(own) == 1:
                slot = int(np.argmax(free))
                d1[g] = (slot - h1[own[0]]) % n
                free[slot] = False
                continue
            for a in range(min(n, 256)):
                base = (h1[own] + a * h2[own]) % n
                if len(set(base.tolist())) < len(own):
                    continue
                shift = np.flatnonzero(free)[: 128 if a < 32 else n]  # put the first key on a free slot
                shift = (shift - base[0]) % n
                good = free[(base[:, None] + shift[None, :]) % n].all(axis=0)
                if good.any():
                    d0[g], d1[g] = a, shift[int(np.argmax(good))]
                    free[(base + d1[g]) % n] = False
                    break
            else:
                return None
        return cls(n, seed, d0, d1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        group, h1, h2 = self._parts(keys, self.n, len(self.d0), self.seed)
        return (h1 + self.d0[group].astype(np.int64) * h2 + self.d1[group]) % self.n


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 0) >> np.uint64(32)).astype(np.uint32)


#: By slot of a bucket: the place of the key's first document, and how many documents of the key follow in the shard.
_SLOT = {"part": "<i4", "at": "<i8", "offset": "<i8", "start": "<i8", "n_tokens": "<i8", "copies": "<i8"}
_PLACE = "part int, at bigint, offset bigint, start bigint, n_tokens bigint, copies bigint"
INDEX = f"bucket int, n bigint, seed int, d0 binary, d1 binary, prints binary, {', '.join(f'{c} binary' for c in _SLOT)}, more array<struct<slot: bigint, places: array<struct<{_PLACE.replace(' ', ': ').replace(',:', ',')}>>>>"


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")


def build_index(directories: DataFrame, buckets: int) -> DataFrame:
    """The index table, a row for each bucket of keys.

    Shards are numbered in order of their documents, so their running totals, which are
    few next to documents, give every document's place among all ids. A key's documents
    in one shard are one place; the places of a key in further shards are listed in
    ``more``."""
    totals = directories.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    before = totals.select("part", (F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("ids")).alias("before"))
    places = directories.groupBy("key", "part").agg(F.min(F.struct("at", "offset", "n_tokens", "width")).alias("f"), F.count(F.lit(1)).alias("copies")).join(before, "part")
    place = F.struct("part", F.col("f.at").alias("at"), F.col("f.offset").alias("offset"), (F.col("before") + (F.col("f.offset") / F.col("f.width")).cast("long")).alias("start"), F.col("f.n_tokens").alias("n_tokens"), "copies")
    keyed = places.groupBy("key").agg(F.sort_array(F.collect_list(place)).alias("places"))
    keyed = keyed.select("key", "places", F.col("places")[0].alias("p")).select("key", "p.*", F.when(F.size("places") > 1, F.slice("places", 2, 1 << 30)).alias("rest"), bucket_of(buckets).alias("bucket"))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        hashed = PerfectHash.build(rows["key"].to_numpy().astype(np.int64).view(np.uint64))
        rows = rows.take(pa.array(np.argsort(hashed.slots(rows["key"].to_numpy().astype(np.int64).view(np.uint64)))))
        keys = rows["key"].to_numpy().astype(np.int64).view(np.uint64)
        further = np.flatnonzero(rows["rest"].is_valid().to_numpy()).tolist()
        one = {"bucket": key[0].as_py(), "n": hashed.n, "seed": hashed.seed, "d0": hashed.d0.tobytes(), "d1": hashed.d1.tobytes(), "prints": fingerprints(keys).tobytes()}
        one |= {c: rows[c].to_numpy().astype(kind).tobytes() for c, kind in _SLOT.items()}
        one["more"] = [{"slot": i, "places": rows["rest"][i].as_py()} for i in further]
        return pa.Table.from_pylist([one], schema=to_arrow_schema(schema))

    schema = StructType.fromDDL(INDEX)
    return keyed.groupBy("bucket").applyInArrow(run, schema)


@dataclass(frozen=True)
class Store:
    """Shards and their index."""

    path: str
    index_path: str
    buckets: int

    def index_for(self, keyed: DataFrame) -> DataFrame:
        """The index; for keys (key, bucket) of a few buckets, only those are read."""
        index = keyed.sparkSession.read.schema(f"{INDEX}, piece int").parquet(self.index_path)
        wanted = [r.bucket for r in keyed.select("bucket").distinct().limit(PRUNED + 1).collect()]
        if len(wanted) <= PRUNED:
            index = index.where(F.col("piece").isin(sorted({b % INDEX_PIECES for b in wanted})) & F.col("bucket").isin(wanted))
        return index.drop("piece")

    def look_up(self, keys: DataFrame) -> DataFrame:
        """(key, part, at, offset, start, n_tokens, copies), a row for each shard that holds
        documents of each of ``keys`` (key: long, distinct). A key that isn't in the index
        has none, or, if its fingerprint is another key's, one that ``read`` leaves out."""
        names = ["key", *_SLOT]

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            columns = [np.zeros(0, np.int64) for _ in names]
            if right.num_rows and left.num_rows:
                row = {c: right[c][0].as_py() for c in right.column_names}
                keys = left["key"].to_numpy().astype(np.int64)
                hashed = PerfectHash(row["n"], row["seed"], np.frombuffer(row["d0"], np.int32), np.frombuffer(row["d1"], np.int32))
                slots = hashed.slots(keys.view(np.uint64))
                known = np.frombuffer(row["prints"], np.uint32)[slots] == fingerprints(keys.view(np.uint64))
                keys, slots = keys[known], slots[known]
                columns = [keys, *[np.frombuffer(row[c], kind)[slots] for c, kind in _SLOT.items()]]
                if row["more"]:
                    asked = dict(zip(slots.tolist(), keys.tolist(), strict=True))
                    rest = [(asked[m["slot"]], *[place[c] for c in _SLOT]) for m in row["more"] if m["slot"] in asked for place in m["places"]]
                    columns = [np.concatenate([c, np.array(r, np.int64)]) for c, r in zip(columns, zip(*rest, strict=True), strict=True)] if rest else columns
            return pa.table({c: pa.array(v, pa.int32() if c == "part" else pa.int64()) for c, v in zip(names, columns, strict=True)})

        keyed = keys.select("key", bucket_of(self.buckets).alias("bucket"))
        return keyed.groupBy("bucket").cogroup(self.index_for(keyed).groupBy("bucket")).applyInArrow(run, f"key bigint, {_PLACE}")

    def read(self, keys: DataFrame, with_ids: bool = True) -> DataFrame:
        """(key, part, start, n_tokens, ids_crc32: crc32 of the ids as little-endian unsigned
        32-bit integers) for every document of ``keys``, with ids (array<int>) unless
        ``with_ids`` is off. Documents without an id are found under NULL_KEY and have a
        null key. A task reads its places in order, opening each shard once a batch."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                table = {c: batch.column(c).to_numpy() for c in ("key", *_SLOT)}
                paths = batch.column("path").to_pylist()
                cuts = [0, *(np.flatnonzero(np.diff(table["part"])) + 1).tolist(), batch.num_rows]
                for i, j in zip(cuts, cuts[1:]):
                    if i < j:
                        shard = _Shard(paths[i])
                        with shard.file:
                            yield from documents(shard, {c: v[i:j] for c, v in table.items()})

        def documents(shard: _Shard, t: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            low, high = int(t["at"].min()), int((t["at"] + t["copies"]).max())
            keys, lengths = shard.keys(low, high - low), shard.lengths(low, high - low)
            real = keys[t["at"] - low] == t["key"]
            key, at, offset, start, copies = (t[c][real] for c in ("key", "at", "offset", "start", "copies"))
            out: list[tuple] = []
            for k, first, byte, before, n in zip(key.tolist(), at.tolist(), offset.tolist(), start.tolist(), copies.tolist(), strict=True):
                for doc in range(first, first + n):
                    size = int(lengths[doc - low])
                    ids = np.frombuffer(shard.bytes(byte, size * shard.width), f"<u{shard.width}").astype("<u4")
                    out.append((None if doc < shard.nulls else k, before, size, zlib.crc32(ids.tobytes()), ids.astype(np.int32) if with_ids else None))
                    byte, before = byte + size * shard.width, before + size
                    if len(out) == 4096:
                        yield batch_of(out, int(t["part"][0]))
                        out = []
            yield batch_of(out, int(t["part"][0]))

        def batch_of(rows: list[tuple], part: int) -> pa.RecordBatch:
            key, start, n, sums, ids = zip(*rows, strict=True) if rows else ((),) * 5
            columns = [pa.array(key, pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(sums, pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.list_(pa.int32()))] if with_ids else columns, names=["key", "part", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

        places = self.look_up(keys).join(shard_files(keys.sparkSession, self.path), "part")
        places = places.repartitionByRange("part", "offset").sortWithinPartitions("part", "offset")
        return places.mapInArrow(run, "key bigint, part int, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def write_store(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, vocabulary: int = 50_257) -> Store:
    """Encode ``docs`` into shards in the shared folder and build their index. Other
    columns are not read; an empty table gives no shard with documents and an empty index."""
    spark = docs.sparkSession
    path, index_path = new_path(spark, "token-shards"), new_path(spark, "token-index")
    write_shards(docs, tokenizer_path, path, id_col, text_col, end_id, vocabulary)
    directories = read_directories(spark, path)
    buckets = max(1, -(-directories.count() // BUCKET_KEYS))
    index = build_index(directories, buckets).withColumn("piece", F.col("bucket") % INDEX_PIECES)
    index.repartition("piece").sortWithinPartitions("piece", "bucket").write.partitionBy("piece").parquet(index_path)
    return Store(path, index_path, buckets)
