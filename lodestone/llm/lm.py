"""Language-model scoring by deleted interpolation.

P(x | prev) = L f2(x | prev) + (1 - L) P1(x),  P1(x) = M f1(x) + (1 - M) / (V + 1)

f2, f1: maximum-likelihood estimates from the counts of all pairs and all words of the training texts, none left out; V: distinct words, with one place more for all unseen ones; L depends on
the bucket (power of two) of the count of prev. Before a text stands its end mark as prev. All weights are learned by expectation-maximisation on the counts of a held-out
fold against estimates with that fold's counts deleted, summed into BINS bins an octave of the ratio f2 / P1 (of f1 for M).

Texts are read once, into blocks of about HEAD_PAIRS tokens. A block cuts its sorted distinct words and pairs (64-bit hashes) into a piece for each of so many ranges of the hash, with its own
counts; the task of a range adds up the pieces of all blocks and answers each with the whole counts, in the order in which it asked, so neither keys nor rows of texts travel back and nothing is
joined. With its answers a block knows all counts of its texts: it gives its share of the bins, and, once the weights are learned, the scores. A frequent word or pair is one entry of a block's
piece however often it occurs. All that is shuffled or written is packed: differences of sorted keys, and counts in the fewest bytes, compressed.

Trigrams are left out: see the README for the figures.

Defined cases: null text is empty, its only token is the end; very long texts are read whole; a null doc_id counts as the empty id for its fold; rows that share doc_id are
scored as rows of their own; without training rows every count is zero and the model is uniform; without a held-out fold in training the weights are WEIGHT; an empty table gives none.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodestone.llm.common import body, fold_of, small_batches, staged, table
from lodestone.llm.tokens import WordHashes, mixed

FOLDS, HELD_OUT, TUNING = 7, 2, 3
#: So many words' hashes a worker remembers; a block ends at the text with which it has more than so many pairs.
HEAD_WORDS, HEAD_PAIRS = 1 << 18, 1 << 20
BINS, WEIGHT, MOST = 64, 0.5, 0.9999
#: The end of a text as a token: no word, as words hold no line feed. It also stands before a text.
END = WordHashes()[b"\n"]
#: The bin of what training without the held-out fold has not seen.
UNSEEN = -(1 << 30)
#: A cell is a bucket and a bin in one number.
CELL = 1 << 32
#: What a block holds; a piece has its words and pairs (each key less the one before, the first less the start of the range), and their counts in training and in the tuning fold.
BLOCK = "block long, doc_ids array<long>, sizes binary, folds binary, types binary, tokens binary"
PIECE = "part int, block long, asks boolean, piece binary"


def planes(values: np.ndarray) -> np.ndarray:
    """Numbers from 0 on: the first byte of each, then the second of each, as far as one needs it."""
    values = np.ascontiguousarray(values, dtype="<u8")
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of planes, compressed together."""
    sizes = b"".join(struct.pack("<BI", *a.shape) for a in arrays)
    return sizes + zstd.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def unpacked(data: bytes, arrays: int = 1) -> list[np.ndarray]:
    """The numbers of so many arrays."""
    bytes_, at, out = np.frombuffer(zstd.ZstdDecompressor().decompress(data[5 * arrays :]), dtype=np.uint8), 0, []
    for k in range(arrays):
        width, n = struct.unpack_from("<BI", data, 5 * k)
        values = np.zeros((n, 8), dtype=np.uint8)
        values[:, :width] = bytes_[at : at + width * n].reshape(width, n).T
        out.append(values.view("<u8").ravel())
        at += width * n
    return out


def one(data: bytes) -> np.ndarray:
    return unpacked(data)[0].astype(np.int64)


def differences(keys: np.ndarray) -> np.ndarray:
    """Of each sorted key and the one before."""
    return np.diff(keys, prepend=np.uint64(0))


def before(tokens: np.ndarray, sizes: np.ndarray, first: int) -> np.ndarray:
    """What stands before each token; first: before a text."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[np.cumsum(sizes) - sizes] = first
    return out


class Block:
    """Texts one after the other: sizes (tokens of each text), tokens and prev (places in the block's types distinct words), pair (a place among its distinct pairs for each token),
    pair_prev and pair_x (places of words for each distinct pair)."""

    def __init__(self, row: dict, types: int, end: int) -> None:
        self.sizes, self.tokens = one(row["sizes"]), one(row["tokens"])
        self.prev = before(self.tokens, self.sizes, end)
        pairs, self.pair = np.unique(self.prev * types + self.tokens, return_inverse=True)
        self.types, self.pair_prev, self.pair_x = types, pairs // max(1, types), pairs % max(1, types)

    def counts(self, folds: np.ndarray) -> tuple[np.ndarray, ...]:
        """Counts of words in training and in the tuning fold, and so of pairs; folds: of each text, 0 not in training, 2 in the tuning fold, 1 in the rest of training."""
        fold = np.repeat(folds, self.sizes)
        return tuple(np.bincount(of[fold >= least], minlength=n) for of, n in ((self.tokens, self.types), (self.pair, len(self.pair_x))) for least in (1, 2))


def hashed(row: dict) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray]:
    """The block of a row BLOCK, the sorted keys of its words, those of its pairs, and for each distinct pair its place in these."""
    types = np.cumsum(unpacked(row["types"])[0], dtype=np.uint64)
    block = Block(row, len(types), int(np.searchsorted(types, np.uint64(END))))
    first, second = types * np.uint64(0x9E3779B97F4A7C15), mixed(types)
    return block, types, *np.unique(mixed(first[block.pair_prev] + second[block.pair_x]), return_inverse=True)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(0, b.num_rows, 16):
            yield from b.slice(i, 16).to_pylist()


def _batch(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def blocks_of(docs: DataFrame, training: bool) -> DataFrame:
    """The blocks, staged; training: whether the rows outside the fold HELD_OUT are counted."""
    small_batches(docs.sparkSession)
    fold = fold_of("doc_id", FOLDS)
    folds = F.when(fold == HELD_OUT, 0).when(fold == TUNING, 2).otherwise(1) if training else F.lit(0)
    schema, remembered, most = _arrow(BLOCK), HEAD_WORDS, HEAD_PAIRS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, task, k = WordHashes(remembered), TaskContext.get().partitionId(), 0
        ids, folds, parts, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            types, tokens = np.unique(np.concatenate(parts), return_inverse=True)
            own = {"sizes": np.array([len(x) for x in parts]), "folds": np.array(folds), "types": differences(types), "tokens": tokens}
            return _batch(schema, [{"block": task << 32 | k, "doc_ids": ids} | {name: packed(planes(x)) for name, x in own.items()}])

        for b in batches:
            columns = b.column("doc_id").to_pylist(), b.column("fold").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()
            for i, f, text in zip(*columns, strict=True):
                words = text.lower().split()
                words.append(b"\n")
                ids.append(i)
                folds.append(f)
                parts.append(hashes.of(words))
                held += len(words)
                if held > most:
                    yield block()
                    k += 1
                    ids, folds, parts, held = [], [], [], 0
        if parts:
            yield block()

    # blocks are as one committed write of each task has them, so a lost executor changes none
    return staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"), folds.cast("int").alias("fold")).mapInArrow(run, BLOCK), "blocks")


def parts_for(*blocks: DataFrame) -> int:
    """So many ranges of the hash that the task of one holds the pieces of four blocks' size at most."""
    return max(int(blocks[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sum(b.count() for b in blocks) // 4))


def pieces(blocks: DataFrame, parts: int, asks: bool) -> DataFrame:
    """The pieces of all blocks; asks: whether they want an answer."""
    schema = _arrow(PIECE)
    edges = np.array([(k << 64) // parts for k in range(parts)], dtype=np.uint64)

    def cut(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ranges begin and end in sorted keys, and the planes of the keys."""
        cuts = np.append(np.searchsorted(keys, edges), len(keys))
        full = cuts[:-1] < cuts[1:]
        apart = differences(keys)
        apart[cuts[:-1][full]] = keys[cuts[:-1][full]] - edges[full]
        return cuts, planes(apart)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block, words, pairs, place = hashed(row)
            *of_words, pair_c, pair_h = block.counts(one(row["folds"]))
            of_pairs = (np.bincount(place, weights=c, minlength=len(pairs)).astype(np.int64) for c in (pair_c, pair_h))
            (word_cuts, words), (pair_cuts, pairs) = cut(words), cut(pairs)
            of_words, of_pairs = [words, *map(planes, of_words)], [pairs, *map(planes, of_pairs)]
            out = []
            for k in range(parts):
                w, p = (slice(cuts[k], cuts[k + 1]) for cuts in (word_cuts, pair_cuts))
                out.append({"part": k, "block": row["block"], "asks": asks, "piece": packed(*(x[:, w] for x in of_words), *(x[:, p] for x in of_pairs))})
            yield _batch(schema, out)

    return blocks.select("block", "sizes", "folds", "types", "tokens").mapInArrow(run, PIECE)


def answers(asked: DataFrame, parts: int) -> DataFrame:
    """Staged: a row with the whole counts for each piece that asks, and one for each part, of null block: n, v, held (tokens, distinct words, tokens of the tuning fold) and by
    bin of the training counts without that fold its tokens."""
    ddl = "part int, block long, counts binary, n long, v long, held long, bins array<long>, sums array<long>"
    schema, width = _arrow(ddl), BINS

    def whole(apart: list[np.ndarray], c: list[np.ndarray], h: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """By distinct key the sums of c and h, for each entry the place of its key, and where each piece begins and ends."""
        found, of = np.unique(np.concatenate([np.cumsum(x, dtype=np.uint64) for x in apart]), return_inverse=True)
        sums = (np.bincount(of, weights=np.concatenate(x), minlength=len(found)).astype(np.int64) for x in (c, h))
        return *sums, of, np.cumsum([0, *map(len, apart)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part = defaultdict(list)
        for row in _rows(batches):
            by_part[row["part"]].append((row["block"], row["asks"], row["piece"]))
        for part, rows in by_part.items():
            own = [list(x) for x in zip(*(unpacked(piece, 6) for _, _, piece in rows), strict=True)]
            word_c, word_h, word, word_cuts = whole(*own[:3])
            pair_c, pair_h, pair, pair_cuts = whole(*own[3:])
            del own
            bins, sums = summed(binned(word_c - word_h, width)[word_h > 0], word_h[word_h > 0])
            out = [{"part": part, "n": int(word_c.sum()), "v": int((word_c > 0).sum()), "held": int(word_h.sum()), "bins": bins, "sums": sums}]
            of_words, of_pairs = [planes(c[word]) for c in (word_c, word_h)], [planes(c[pair]) for c in (pair_c, pair_h)]
            for i, (block, asks, _) in enumerate(rows):
                w, p = (slice(cuts[i], cuts[i + 1]) for cuts in (word_cuts, pair_cuts))
                if asks:
                    out.append({"part": part, "block": block, "counts": packed(*(x[:, w] for x in of_words), *(x[:, p] for x in of_pairs))})
            yield _batch(schema, out)

    return staged(asked.repartitionById(parts, F.col("part")).mapInArrow(run, ddl), "answers")


def binned(ratio: np.ndarray, width: int) -> np.ndarray:
    return np.where(ratio > 0, np.round(np.log2(np.where(ratio > 0, ratio, 1)) * width), UNSEEN).astype(np.int64)


def summed(cells: np.ndarray, weight: np.ndarray) -> tuple[list[int], list[int]]:
    """The distinct cells, and the sum of the weight of each."""
    found, of = np.unique(cells, return_inverse=True)
    return found.tolist(), np.bincount(of, weights=weight, minlength=len(found)).astype(np.int64).tolist()


def _bucket(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(counts, 1)) + 1e-9).astype(np.int64)


def _sums(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells of the columns bins and sums, and the sum of each."""
    each = rows.select(F.explode(F.arrays_zip("bins", "sums")).alias("cell")).select("cell.*")
    t = each.groupBy("bins").agg(F.sum("sums").alias("sums")).toArrow()
    return t["bins"].to_numpy(), t["sums"].to_numpy()


def expectation_maximisation(ratio: np.ndarray, weight: np.ndarray, turns: int = 200) -> float:
    """The weight w that maximises sum weight * log(w ratio + 1 - w)."""
    if not weight.sum():
        return WEIGHT
    w = WEIGHT
    for _ in range(turns):
        w = min(float((weight * (w * ratio / (w * ratio + 1 - w))).sum() / weight.sum()), MOST)
    return w


def _ratios(bins: np.ndarray) -> np.ndarray:
    return np.where(bins == UNSEEN, 0.0, 2.0 ** (np.where(bins == UNSEEN, 0, bins) / BINS))


class Estimates:
    """n tokens and types distinct words of training, held of the tokens in the tuning fold, and the learned weights: a number m and one a bucket."""

    def __init__(self, n: int, types: int, held: int, m: float, weights: np.ndarray) -> None:
        self.n, self.types, self.held, self.m, self.weights = n, types, held, m, weights

    def p1(self, count: np.ndarray, total: int) -> np.ndarray:
        return count * (self.m / max(1, total)) + (1 - self.m) / (self.types + 1)

    def context_weight(self, counts: np.ndarray) -> np.ndarray:
        """L of contexts by their counts."""
        return np.where(counts > 0, self.weights[_bucket(counts)], 0.0)

    def gain(self, c: np.ndarray, prev_count: np.ndarray, x_count: np.ndarray) -> np.ndarray:
        """What a pair of count c adds to the logarithm."""
        w = self.context_weight(prev_count)
        return np.log10(1 + w * c / np.maximum(prev_count, 1) / ((1 - w) * self.p1(x_count, self.n)))

    def cells(self, block: Block, pair_held: np.ndarray, word_c: np.ndarray, word_h: np.ndarray, pair_c: np.ndarray, pair_h: np.ndarray, width: int) -> tuple[list[int], list[int]]:
        """Of the tuning fold's pairs in the block (pair_held: their numbers there) the cells of bucket and bin, and how many each has."""
        at = np.flatnonzero(pair_held)
        prev, x = block.pair_prev[at], block.pair_x[at]
        kept = word_c[prev] - word_h[prev]
        ratio = (pair_c[at] - pair_h[at]) / np.maximum(kept, 1) / self.p1(word_c[x] - word_h[x], self.n - self.held)
        return summed(_bucket(kept) * CELL + binned(ratio, width), pair_held[at])


def answered(blocks: DataFrame, replies: DataFrame, estimates: Estimates) -> DataFrame:
    """Staged: a row for each block with the whole counts of its words and distinct pairs, the place of the end among the words, and its cells."""
    ddl = "doc_ids array<long>, sizes binary, tokens binary, end long, word_c binary, pair_c binary, bins array<long>, sums array<long>"
    schema, width = _arrow(ddl), BINS

    def joined(row: dict, got: list[dict]) -> pa.RecordBatch:
        block, types, _, place = hashed(row)
        word_c, word_h, pair_c, pair_h = (np.concatenate(x).astype(np.int64) for x in zip(*(unpacked(r["counts"], 4) for r in got), strict=True))
        bins, sums = estimates.cells(block, block.counts(one(row["folds"]))[3], word_c, word_h, pair_c[place], pair_h[place], width)
        kept = {name: row[name] for name in ("doc_ids", "sizes", "tokens")} | {"end": int(np.searchsorted(types, np.uint64(END)))}
        return _batch(schema, [kept | {"word_c": packed(planes(word_c)), "pair_c": packed(planes(pair_c[place])), "bins": bins, "sums": sums}])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, got = None, []
        for r in _rows(batches):
            if r["part"] < 0:
                if row:
                    yield joined(row, got)
                row, got = r, []
            else:
                got.append(r)
        if row:
            yield joined(row, got)

    both = blocks.withColumn("part", F.lit(-1)).unionByName(replies.where("block is not null").select("part", "block", "counts"), allowMissingColumns=True)
    return staged(both.repartition("block").sortWithinPartitions("block", "part").mapInArrow(run, ddl), "answered")


class Model(Estimates):
    """Fitted on docs, whose blocks and answers are staged."""

    def __init__(self, docs: DataFrame) -> None:
        self.docs, self.blocks = docs, blocks_of(docs, True)
        parts = parts_for(self.blocks)
        replies = answers(pieces(self.blocks, parts, True), parts)
        whole = replies.where("block is null")
        total = whole.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "held"))).first()
        super().__init__(total["n"], total["v"], total["held"], 0.0, np.full(64, WEIGHT))
        bins, sums = _sums(whole)
        if self.n:
            self.m = expectation_maximisation(_ratios(bins) * ((self.types + 1) / max(1, self.n - self.held)), sums)
        self.own = answered(self.blocks, replies, self.estimates())
        cells, sums = _sums(self.own)
        buckets = (cells + CELL // 2) // CELL
        for bucket in np.unique(buckets):
            at = buckets == bucket
            self.weights[bucket] = expectation_maximisation(_ratios(cells[at] - bucket * CELL), sums[at])

    def estimates(self) -> Estimates:
        """The numbers alone, for the workers."""
        return Estimates(self.n, self.types, self.held, self.m, self.weights)

    def counted(self, docs: DataFrame) -> DataFrame:
        """The blocks of docs with their counts in the training texts."""
        if docs is self.docs:
            return self.own
        asking = blocks_of(docs, False)
        parts = parts_for(self.blocks, asking)
        asked = pieces(self.blocks, parts, False).unionByName(pieces(asking, parts, True))
        return answered(asking, answers(asked, parts), self.estimates())


def fit(docs: DataFrame) -> Model:
    """From the rows of docs outside the fold HELD_OUT; of the others, only what they ask for is counted."""
    return Model(docs)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score. The frame on which the model was fitted has its counts already."""
    ddl = "doc_id long, n_tokens long, n_known long, base_score double, score double"
    estimates, schema = model.estimates(), _arrow(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            word_c, pair_c = one(row["word_c"]), one(row["pair_c"])
            block = Block(row, len(word_c), row["end"])
            known, base = (word_c > 0).astype(np.int64), np.log10(word_c + 1.0) - np.log10(estimates.n + estimates.types + 1)
            as_x, as_prev = np.log10(estimates.p1(word_c, estimates.n)), np.log10(1 - estimates.context_weight(word_c))
            gain = estimates.gain(pair_c, word_c[block.pair_prev], word_c[block.pair_x])
            total = as_x[block.tokens] + as_prev[block.prev] + gain[block.pair]
            starts = np.cumsum(block.sizes) - block.sizes
            sums = [np.add.reduceat(x, starts) for x in (known[block.tokens], base[block.tokens], total)]
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(block.sizes), *map(pa.array, sums)], schema=schema)

    found = model.counted(docs).select("doc_ids", "sizes", "tokens", "end", "word_c", "pair_c").mapInArrow(run, ddl)
    return found.select("doc_id", "n_tokens", "n_known", F.lit(int(model.n)).cast("long").alias("train_tokens"), "base_score", "score")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = fold_of("doc_id", FOLDS)
    found = score(docs, fit(docs))
    return found.select("doc_id", (fold == HELD_OUT).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
