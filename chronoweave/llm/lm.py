"""Cross-entropy difference of two n-gram models: how much more a text looks like the target than like the corpus.

Both models are bigram models over one vocabulary, all words of the corpus. The background model counts all documents, the
target model those with a good label. They are matched: same vocabulary, same bigrams, same smoothing, and background counts
are scaled to the target's number of tokens, so both lean on their priors to the same degree::

    P(w)     = (c(w) s + ALPHA / V) / (N s + ALPHA)
    P(w | v) = (c(v, w) s + MU P(w)) / (c(v) s + MU)

where c(v) adds up the bigrams, so each distribution sums to one; V has two words more than the corpus, the unknown word and
the begin of a text. A document's score is the mean over its tokens of the target's loss less the background's, in nats: the
lower, the closer to the target.

No count is left out, and none reaches the driver. Tasks cut the documents into blocks of about ``BLOCK`` tokens, written once as
numbers. Two exchanges count: each block sends its distinct words, then its distinct bigrams, as packed arrays to buckets dealt by
a hash of the word or bigram, and gets the sums over all blocks back. Buckets hold about ``BUCKET`` entries; their number rises
with the corpus. A hot word or bigram comes once from each block at most.

Defined results: a text that is null or without words has no tokens and null losses; without target documents all losses are
null; a null id is kept and is no target; repeated rows count as often as they occur; an empty table gives an empty result;
other columns are left alone.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm.text import blobs, letter_words, table
from chronoweave.session import cut_lineage

MU, ALPHA = 50.0, 1000.0
#: Tokens of a block, and entries that a bucket gets from all blocks.
BLOCK = 2_000_000
BUCKET = 1_000_000


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on, in the least type that holds them, as compressed byte planes."""
    kind = np.min_scalar_type(int(values.max()) if len(values) else 0)
    planes = np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(len(values), kind.itemsize).T)
    return kind.char.encode() + len(values).to_bytes(7, "little") + pa.Codec("zstd", compression_level=1).compress(planes.tobytes(), asbytes=True)


def _unpack(blob: bytes, kind=np.int64) -> np.ndarray:
    held, size = np.dtype(chr(blob[0])), int.from_bytes(blob[1:8], "little")
    planes = pa.Codec("zstd").decompress(blob[8:], size * held.itemsize, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(held.itemsize, size).T).view(held).reshape(size).astype(kind)


def _sums(places: np.ndarray, parts: list[np.ndarray], size: int) -> np.ndarray:
    return np.bincount(places, np.concatenate(parts), size).astype(np.int64)


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(column, field.type) for column, field in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema)


_BLOCK = "_tokens binary, _words binary, _good binary, n bigint, t bigint, begins bigint, t_begins bigint, distinct bigint"
_WORDS = pa.schema([("block", pa.int64()), ("at", pa.int64()), ("ids", pa.binary()), *((f"c{k}", pa.binary()) for k in range(4)), ("fresh", pa.int64())])
_SENT = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("at", pa.int64()), ("words", pa.binary()), *((f"c{k}", pa.binary()) for k in range(4))])
_PAIRS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("gaps", pa.binary()), ("c0", pa.binary()), ("c1", pa.binary())])
_FOUND = pa.schema([("block", pa.int64()), ("at", pa.int64()), ("c0", pa.binary()), ("c1", pa.binary())])
_KINDS = {pa.int64(): "bigint", pa.binary(): "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{field.name} {_KINDS[field.type]}" for field in schema)


def _cut_in_blocks(size: int):
    """A row per block of about ``size`` tokens: its documents, its distinct words in the order of their hashes, and its tokens as places in them."""

    def run(batches):
        ids, counts, good, tokens, numbers, seen, made, kind = [], [], [], [], _Numbers(), 0, 0, None

        def block():
            words = list(numbers)
            order = sorted(range(len(words)), key=lambda i: (zlib.crc32(words[i]), words[i]))
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(len(words))
            sizes, chosen = np.array(counts, np.int64), np.array(good, bool)
            row = [(TaskContext.get().partitionId() << 32) | made, pa.array([ids], pa.list_(kind)), pa.array([counts], pa.list_(pa.int64())),
                   _pack(place[np.concatenate(tokens)]), b" ".join(words[i] for i in order), _pack(chosen.astype(np.int64)),
                   seen, int(sizes[chosen].sum()), int((sizes > 0).sum()), int((sizes[chosen] > 0).sum()), len(words)]
            names = ["block", "_ids", "_counts", *(x.split()[0] for x in _BLOCK.split(", "))]
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array([x]) for x in row], names)

        for batch in batches:
            kind = batch.column(0).type
            for key, blob, flag in zip(batch.column(0).to_pylist(), blobs(batch, "_text"), batch.column(2).to_pylist()):
                words = letter_words(blob)
                ids.append(key)
                good.append(bool(flag))
                counts.append(len(words))
                tokens.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                seen += len(words)
                if max(seen, len(ids)) >= size:
                    yield block()
                    ids, counts, good, tokens, numbers, seen, made = [], [], [], [], _Numbers(), 0, made + 1
        if ids:
            yield block()

    return run


def _firsts(tokens: np.ndarray, counts: np.ndarray, begin: int) -> np.ndarray:
    """The word before each token, ``begin`` at the begin of a text."""
    out = np.concatenate([np.array([begin], tokens.dtype), tokens[:-1]])[:len(tokens)]
    out[(np.cumsum(counts) - counts)[counts > 0]] = begin
    return out


def _columns(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, tokens of each document, and whether a token belongs to the target."""
    counts = np.array(row["_counts"], np.int64)
    return _unpack(row["_tokens"]), counts, np.repeat(_unpack(row["_good"]), counts)


def _send_words(buckets: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words = row["_words"].split(b" ") if row["_words"] else []
                if not words:
                    continue
                tokens, counts, good = _columns(row)
                first = _firsts(tokens, counts, len(words))
                parts = [np.bincount(x, weights, len(words) + 1)[:-1].astype(np.int64) for x in (tokens, first) for weights in (good, None)]
                bucket = np.fromiter((zlib.crc32(word) * buckets >> 32 for word in words), np.int64, len(words))
                starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                ends = [*starts[1:], len(words)]
                rows = [(int(bucket[i]), row["block"], int(i), b" ".join(words[i:j]), *(_pack(x[i:j]) for x in parts)) for i, j in zip(starts, ends)]
                yield from _rows(_SENT, rows).to_batches()

    return run


def _sum_words(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        rows, numbers = table.to_pylist(), _Numbers()
        places = [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for words in (row["words"].split(b" ") for row in rows)]
        sums = [_sums(np.concatenate(places), [_unpack(row[f"c{k}"]) for row in rows], len(numbers)) for k in range(4)]
        ids = np.arange(len(numbers)) * buckets + rows[0]["bucket"] + 1  # 0 is the begin of a text
        if ids[-1] >= 1 << 32:
            raise ValueError("word numbers need more than 32 bits")
        return _rows(_WORDS, [(row["block"], row["at"], _pack(ids[x]), *(_pack(c[x]) for c in sums), 0 if i else len(numbers)) for i, (row, x) in enumerate(zip(rows, places))])

    return run


def _pairs_of(row: dict, words: list[dict], buckets: int):
    """Of a block: distinct bigrams ordered by bucket and number, where each bucket begins, the bigram of each token, and the tokens."""
    tokens, counts, good = _columns(row)
    ids = np.concatenate([_unpack(x["ids"], np.uint64) for x in words])
    second = ids[tokens]
    keys, inverse = np.unique((_firsts(second, counts, 0) << np.uint64(32)) | second, return_inverse=True)
    bucket = (((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return keys[order], np.searchsorted(bucket[order], np.arange(buckets + 1)), place[inverse], tokens, counts, good


def _send_pairs(buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        words = sorted(right.to_pylist(), key=lambda x: x["at"])
        if not words:
            return _rows(_PAIRS, [])
        row = left.to_pylist()[0]
        keys, bounds, pair, _, _, good = _pairs_of(row, words, buckets)
        every, chosen = np.bincount(pair, None, len(keys)), np.bincount(pair, good, len(keys)).astype(np.int64)
        return _rows(_PAIRS, [(k, row["block"], _pack(np.diff(keys[i:j], prepend=np.uint64(0))), _pack(chosen[i:j]), _pack(every[i:j]))
                              for k, (i, j) in enumerate(zip(bounds, bounds[1:])) if j > i])

    return run


def _sum_pairs(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    keys = [np.cumsum(_unpack(row["gaps"], np.uint64), dtype=np.uint64) for row in rows]
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [_sums(inverse, [_unpack(row[f"c{k}"]) for row in rows], len(distinct)) for k in (0, 1)]
    ends = np.cumsum([len(x) for x in keys])
    return _rows(_FOUND, [(row["block"], row["bucket"], *(_pack(c[inverse[j - len(x):j]]) for c in sums)) for row, x, j in zip(rows, keys, ends)])


def _means(buckets: int, totals: tuple[int, int], begins: tuple[int, int], vocabulary: int, schema: pa.Schema):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row, found = left.to_pylist()[0], sorted(right.to_pylist(), key=lambda x: x["at"])
        counts = np.array(row["_counts"], np.int64)
        means, full = np.full((2, len(counts)), np.nan), counts > 0
        if found:
            words, back = [x for x in found if x["ids"] is not None], [x for x in found if x["ids"] is None]
            keys, _, pair, tokens, counts, _ = _pairs_of(row, words, buckets)
            first = _firsts(tokens, counts, len(np.concatenate([_unpack(x["ids"]) for x in words])))
            document = np.repeat(np.arange(len(counts)), counts)
            for k, scale in ((0, 1.0), (1, totals[0] / totals[1])):
                single = np.concatenate([_unpack(x[f"c{k}"]) for x in words])
                before = np.concatenate([*(_unpack(x[f"c{k + 2}"]) for x in words), [begins[k]]])
                seen = np.concatenate([_unpack(x[f"c{k}"]) for x in back])
                prior = (single[tokens] * scale + ALPHA / vocabulary) / (totals[k] * scale + ALPHA)
                losses = -np.log((seen[pair] * scale + MU * prior) / (before[first] * scale + MU))
                means[k, full] = (np.bincount(document, losses, len(counts)))[full] / counts[full]
        columns = [left.column("_ids").combine_chunks().flatten(), pa.array(counts), *(pa.array(x, from_pandas=True) for x in (*means, means[0] - means[1]))]
        return pa.table(columns, schema.names)

    return run


def full_scores(docs: DataFrame, good: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc id, n_tokens, target_loss, background_loss, score) of all ``docs`` by the counts of all words and bigrams; the target are the ids of ``good``."""
    spark, kind = docs.sparkSession, docs.schema[doc_id].dataType.simpleString()
    # the hint keeps one plan at every size: texts are dealt out by id and meet the labels in a hash table
    chosen = good.select(F.col(doc_id).alias("_good_id"), F.lit(True).alias("_good")).hint("shuffle_hash")
    flagged = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(chosen, F.col("_id") == F.col("_good_id"), "left")
    blocks = cut_lineage(flagged.select("_id", "_text", "_good").mapInArrow(_cut_in_blocks(BLOCK), f"block bigint, _ids array<{kind}>, _counts array<bigint>, {_BLOCK}"))
    totals = blocks.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("n", "t", "begins", "t_begins", "distinct"))).first()
    if not totals["n"] or not totals["t"]:
        return blocks.select(F.inline(F.arrays_zip(F.col("_ids").alias(doc_id), F.col("_counts").alias("n_tokens")))).select(
            F.col(doc_id), "n_tokens", *(F.lit(None).cast("double").alias(x) for x in ("target_loss", "background_loss", "score")))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    word_buckets, pair_buckets = (max(least, totals[x] // BUCKET + 1) for x in ("distinct", "n"))
    tokens = blocks.select("block", "_tokens", "_counts", "_good")
    sent = blocks.select("block", "_words", "_tokens", "_counts", "_good").mapInArrow(_send_words(word_buckets), _ddl(_SENT))
    words = cut_lineage(sent.groupBy("bucket").applyInArrow(_sum_words(word_buckets), _ddl(_WORDS)))
    vocabulary = words.agg(F.sum("fresh")).first()[0] + 2
    pairs = tokens.groupBy("block").cogroup(words.select("block", "at", "ids").groupBy("block")).applyInArrow(_send_pairs(pair_buckets), _ddl(_PAIRS))
    found = pairs.groupBy("bucket").applyInArrow(_sum_pairs, _ddl(_FOUND))
    both = words.drop("fresh").unionByName(found, allowMissingColumns=True)
    out = f"`{doc_id}` {kind}, n_tokens bigint, target_loss double, background_loss double, score double"
    names = pa.schema([(x, pa.null()) for x in (doc_id, "n_tokens", "target_loss", "background_loss", "score")])
    score_blocks = _means(pair_buckets, (totals["t"], totals["n"]), (totals["t_begins"], totals["begins"]), vocabulary, names)
    return blocks.select("block", "_ids", "_tokens", "_counts", "_good").groupBy("block").cogroup(both.groupBy("block")).applyInArrow(score_blocks, out)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; the target are those labelled as good and not toxic."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("x")).filter("q = 1 AND x = 0").select("doc_id")
    return full_scores(docs, good)
