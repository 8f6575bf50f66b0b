"""Line dedup by a fixed-depth log-template tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import WORD_SEPARATOR, discard, materialize

#: Leading tokens that, after the token count, lead to a node of the tree.
DEPTH = 4
#: Runs into which the other tokens are cut. A template fixes all of them but one.
RUNS = 3
#: Share of a line's tokens that have to be fixed; a line with fewer is its own template, digits and all.
SIMILARITY = 0.6
#: Fixed tokens that a recurring template must have repeated: tokens * (documents - 1).
EVIDENCE = 16
#: Texts are taken together up to this many bytes; a longer one is read in slices.
_CHUNK = 1 << 20
_BASE, _SPREAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(_SPREAD)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(_SPREAD)
        return x ^ (x >> np.uint64(32))


class _Runs:
    """64-bit hashes of runs of an array: sums of values times powers of an odd number,
    modulo 2**64, brought to the same first power."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.up) < len(values):
            n = len(values) + len(values) // 4
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, x, np.uint64))]) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self.up[: len(values)])])
        return _mixed((sums[ends] - sums[starts]) * self.down[starts])


def _blank(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def _tokens(raw: np.ndarray, runs: _Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, line and whether it holds a digit of every token. Slices end at white space."""
    parts, at, line = [], 0, 0
    while at < len(raw):
        end = at + _CHUNK
        while end < len(raw) and not _blank(raw[end - 1 : end]).any():
            more = np.flatnonzero(_blank(raw[end : end + _CHUNK]))
            end += int(more[0]) + 1 if len(more) else _CHUNK
        some = raw[at:end]
        word = np.zeros(len(some) + 2, np.int8)
        word[1:-1] = ~_blank(some)
        edge = np.diff(word)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        digits = np.concatenate([np.zeros(1, np.int64), np.cumsum((some >= 48) & (some <= 57))])
        breaks = np.flatnonzero(some == 10)
        parts.append((runs(some.astype(np.uint64) + np.uint64(1), starts, ends), line + np.searchsorted(breaks, starts), digits[ends] > digits[starts]))
        at, line = end, line + len(breaks)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool))


def _places(texts: list[str], runs: _Runs, depth: int, similarity: float) -> tuple[np.ndarray, ...]:
    """Row, line, node, fixed tokens and whether it is the first of its document, for every
    line with a token and each of its templates."""
    raw = np.frombuffer("\n".join(texts).encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.fromiter((x.count("\n") + 1 for x in texts), np.int64, len(texts))
    row = np.repeat(np.arange(len(texts)), counts)
    line = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    hashes, of_line, variable = _tokens(raw, runs)
    sizes = np.bincount(of_line, minlength=len(row))
    until = np.cumsum(sizes)
    some = sizes > 0
    row, line, sizes, until = row[some], line[some], sizes[some], until[some]
    since = until - sizes
    open_fields = np.concatenate([np.zeros(1, np.int64), np.cumsum(variable)])
    fields = lambda i, j: open_fields[j] - open_fields[i]
    loose = sizes - fields(since, until) < similarity * sizes
    masked = np.where(variable, np.uint64(0), hashes)
    lead = since + np.minimum(depth, sizes)
    cuts = [lead + (until - lead) * i // RUNS for i in range(RUNS + 1)]
    start = _mixed(runs(masked, since, lead) ^ _mixed(sizes.astype(np.uint64)))
    told = [runs(masked, cuts[i], cuts[i + 1]) for i in range(RUNS)]
    nodes, fixed = [], []
    for left_out in range(RUNS):
        node, n = start, (lead - since) - fields(since, lead)
        for i in range(RUNS):
            node = _mixed(node * np.uint64(_BASE) + (np.uint64(left_out + 1) if i == left_out else told[i]))
            n = n + (0 if i == left_out else cuts[i + 1] - cuts[i] - fields(cuts[i], cuts[i + 1]))
        nodes.append(node[~loose])
        fixed.append(n[~loose])
    nodes.append(_mixed(runs(hashes, since[loose], until[loose]) ^ _mixed(sizes[loose].astype(np.uint64) + np.uint64(_SPREAD))))
    fixed.append(sizes[loose])
    row = np.concatenate([*[row[~loose]] * RUNS, row[loose]])
    line = np.concatenate([*[line[~loose]] * RUNS, line[loose]])
    node = np.concatenate(nodes).view(np.int64)
    first = np.zeros(len(row), np.int32)
    order = np.lexsort((node, row))
    first[order] = np.concatenate([[1], (np.diff(row[order]) != 0) | (np.diff(node[order]) != 0)])[: len(row)]
    return row, line.astype(np.int32), node, np.concatenate(fixed).astype(np.int32), first


def places_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, similarity: float = SIMILARITY) -> DataFrame:
    """(id, row: long, line: int, node: long, fixed: int, first: int): the templates of every
    line with a token, RUNS for each; ``row`` tells rows of one id apart by their texts. Rows
    without an id are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs()
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            begin, held = 0, 0
            for at, text in enumerate(texts):
                held += len(text)
                if held < _CHUNK and at + 1 < len(texts):
                    continue
                row, *columns = _places(texts[begin : at + 1], runs, depth, similarity)
                at_row = pa.array(row + begin)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at_row), batch.column(2).take(at_row), *map(pa.array, columns)], names=["id", "row", "line", "node", "fixed", "first"])
                begin, held = at + 1, 0

    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("row"))
    return named.mapInArrow(run, f"id {kind}, row bigint, line int, node bigint, fixed int, first int")


def recurring(places: DataFrame, evidence: int = EVIDENCE) -> DataFrame:
    """(node, least_id): templates that recur across documents. A template is in a document
    once, however many of its lines are; the documents have two ids at least."""
    nodes = places.groupBy("node").agg(F.min("id").alias("least_id"), F.max("id").alias("most_id"), F.sum("first").alias("docs"), F.max("fixed").alias("fixed"))
    return nodes.where((F.col("least_id") < F.col("most_id")) & (F.col("fixed") * (F.col("docs") - 1) >= evidence)).select("node", "least_id")


@F.arrow_udf(StringType())
def _without(texts: pa.Array, lines: pa.Array) -> pa.Array:
    out = []
    for text, gone in zip(texts.to_pylist(), lines.to_pylist(), strict=True):
        if gone is not None:
            parts, lost = text.split("\n"), set(gone)
            text = "\n".join([x for i, x in enumerate(parts) if i not in lost])
        out.append(text)
    return pa.array(out, pa.string())


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, evidence: int = EVIDENCE, keep_first: bool = False) -> DataFrame:
    """``docs`` with the text of their remaining lines, and n_lines, n_dropped (long) and
    kept_words, all_words (long).

    Lines end at ``\\n``; a token is a run without ASCII white space; tokens with a digit
    are variable fields. From the root, a line goes by its token count, then its DEPTH
    leading tokens, then the others, of which one of RUNS runs is passed over: what ends
    in one node agrees in two thirds of its tokens or more, the rest are variable. So a
    line has RUNS templates, whatever other lines there are, and goes if one of them
    recurs: if its fixed tokens, times the documents that it is in besides one, are
    ``evidence`` or more. Lines with too few fixed tokens, such as rows of numbers, recur
    only if they are equal.

    A recurring template's lines go from all documents; with ``keep_first`` the document
    with the least id keeps them. Null texts stay null, rows without an id stay whole,
    rows that repeat an id are counted one by one, but no template recurs that is under
    one id only; each loses its own lines, rows that repeat id and text the same ones. Other
    columns pass through; columns of the names above are replaced, and those named _id,
    _row, _gone and _kept dropped."""
    docs = docs.drop(*{"_id", "_row", "_gone", "_kept"} - {id_col, text_col})
    places = materialize(places_of(docs, id_col, text_col, similarity=similarity), "line-places")
    met = places.select("id", "row", "line", "node").join(templates := materialize(recurring(places, evidence), "recurring-templates"), "node")
    met = met.where(F.col("id") != F.col("least_id")) if keep_first else met
    gone = materialize(met.groupBy(F.col("id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_set("line").alias("_gone")), "recurring-lines")
    discard(places, templates)
    df = docs.join(gone, (docs[id_col] == gone["_id"]) & (F.xxhash64(docs[text_col]) == gone["_row"]), "left").drop("_id", "_row")
    cut = F.col("_gone").isNotNull() & F.col(text_col).isNotNull()
    n_words = lambda t: F.size(F.array_remove(F.split(F.coalesce(t, F.lit("")), WORD_SEPARATOR), "")).cast("long")
    breaks = F.length(text := F.coalesce(F.col(text_col), F.lit(""))) - F.length(F.translate(text, "\n", ""))
    df = df.withColumn("_kept", F.when(cut, _without(F.when(cut, F.col(text_col)), F.col("_gone"))).otherwise(F.col(text_col)))
    df = df.withColumn("n_lines", (breaks + 1).cast("long")).withColumn("n_dropped", F.when(cut, F.size("_gone")).otherwise(F.lit(0)).cast("long"))
    df = df.withColumn("all_words", n_words(F.col(text_col))).withColumn("kept_words", F.when(cut, n_words(F.col("_kept"))).otherwise(F.col("all_words")))
    return df.withColumn(text_col, F.col("_kept")).drop("_kept", "_gone")
