"""Ranked lexical search by hashed max-sketches.

An index holds documents in blocks: the block's terms with how many documents have them, and each text's term counts. From
these a search makes the texts' sketches: a term's impact is the part of its score that depends on the text, and a text's
impacts fold into coordinates by a hash of the term, each coordinate keeping the greatest. Looking up a query's terms in the
sketches of a block and adding their weights times what stands there bounds every text's score from above. Texts are then
scored exactly by falling bound until the bound is below the k-th best score so far; what is left out cannot be among the best.
Equal bounds are still scored, so ties go by document id alone.

Queries are cut into blocks, too. A task goes through pairs of a document block and a query block and keeps its best k texts per
query from one pair to the next, so most texts of later blocks are ruled out by their sketch; no task sends more than k rows per
query for the query blocks it holds at a time. Counts over all documents (documents, terms, documents per query term) are
aggregated by Spark; only two numbers come to the driver. Equal texts of a block are one text, queries of equal text one query.

Scores are whole numbers throughout; the weight of a term is rounded down once, from doubles.

Defined results: a null or empty text has no terms, is not counted and never found; a query without terms, or whose terms no
document holds, finds nothing; only scores above 0 are returned; a null document id comes last among equal scores; repeated
documents are found each, repeated queries get their rows each; an empty table gives an empty result; other columns are left
alone.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from chronoweave.llm.text import blobs, letter_words, table
from chronoweave.session import cut_lineage

#: Bytes of text, and number of texts, at which a block of documents is full; queries of a block.
BLOCK_BYTES, BLOCK_TEXTS, QUERIES = 4 << 20, 8192, 256
#: Sketch coordinates per distinct term of a text, at least; and of any text.
WIDTH, LEAST_WIDTH = 2, 64
#: Texts that are scored at a time.
STEP = 32
#: Query blocks whose best texts a task holds.
HELD = 16
TOP = 10


class Numbers(dict):
    """Terms numbered in order of arrival."""

    def __missing__(self, term: bytes) -> int:
        self[term] = number = len(self)
        return number


def _int(values) -> bytes:
    return np.asarray(values, np.int32).tobytes()


def _block(texts: dict[bytes, list], kind: pa.DataType) -> pa.RecordBatch:
    """One row for a block of distinct texts, each with the ids of its documents."""
    numbers, counts, ids, ends = Numbers(), [], [], []
    for text, of in texts.items():
        held = Counter(letter_words(text))
        if held:
            counts.append((np.fromiter(map(numbers.__getitem__, held), np.int32, len(held)), np.fromiter(held.values(), np.int64, len(held))))
            ids.append(sorted(of, key=lambda i: (i is None, i)))
    sizes = np.array([len(t) for t, _ in counts], np.int64)
    text = np.repeat(np.arange(len(counts)), sizes)
    term, times = (np.concatenate([c[i] for c in counts]) if counts else np.empty(0, np.int64) for i in (0, 1))
    order = np.lexsort((term, text))
    copies = np.array([len(i) for i in ids], np.int64)
    lengths = np.bincount(text, times, len(counts)).astype(np.int64)
    documents = np.bincount(term, copies[text], len(numbers)).astype(np.int64) if len(term) else np.empty(0, np.int64)
    ends = np.cumsum(copies)
    row = {
        "n_docs": pa.array([int(copies.sum())], pa.int64()), "n_terms": pa.array([int((copies * lengths).sum())], pa.int64()),
        "terms": pa.array([[t.decode() for t in numbers]], pa.list_(pa.string())), "dfs": pa.array([documents.tolist()], pa.list_(pa.int64())),
        "ids": pa.array([[i for of in ids for i in of]], pa.list_(kind)), "id_ends": pa.array([_int(ends)]), "sizes": pa.array([_int(sizes)]),
        "lengths": pa.array([lengths.tobytes()]), "term": pa.array([_int(term[order])]), "times": pa.array([_int(times[order])]),
    }
    return pa.RecordBatch.from_arrays(list(row.values()), list(row))


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The written index of ``docs``, a row per block."""

    def run(batches):
        held, total, kind = {}, 0, pa.int64()
        for batch in batches:
            kind = batch.column(0).type
            for i, blob in zip(batch.column(0).to_pylist(), blobs(batch, "_text")):
                if blob:
                    if blob not in held:
                        total += len(blob)
                    held.setdefault(blob, []).append(i)
                if total >= BLOCK_BYTES or len(held) >= BLOCK_TEXTS:
                    yield _block(held, kind)
                    held, total = {}, 0
        if held:
            yield _block(held, kind)

    kind = docs.schema[doc_id].dataType.simpleString()
    columns = f"n_docs bigint, n_terms bigint, terms array<string>, dfs array<bigint>, ids array<{kind}>, id_ends binary, sizes binary, lengths binary, term binary, times binary"
    return cut_lineage(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).mapInArrow(run, columns))


@dataclass
class Queries:
    """A block of queries: each one's number, terms, their weights and hashes; and its best texts so far, best first."""

    numbers: list[int]
    terms: list[list[bytes]]
    weights: list[np.ndarray]
    hashes: list[np.ndarray]
    best: list[list[tuple]] = field(default_factory=list)


def impacts(times: np.ndarray, lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a term that occurs ``times`` times scores in a text of ``lengths`` terms, for a weight of 1."""
    if 90 * int(lengths.max(initial=0)) * n >= 2**63:
        lengths = lengths.astype(object)
    m = (10 + 90 * lengths * n // max(total, 1)).astype(np.int64)
    return 1_000_000_000 * times // (1000 * times + 8 * m)


def sketches(text: np.ndarray, hashes: np.ndarray, impact: np.ndarray, sizes: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(coordinates, the texts, sketches as columns) for texts of each width."""
    width = np.maximum(LEAST_WIDTH, 1 << np.ceil(np.log2(np.maximum(sizes * WIDTH, 1))).astype(np.int64))
    made = []
    for size in np.unique(width).tolist():
        members = np.flatnonzero(width == size)
        place = np.full(len(sizes), -1, np.int64)
        place[members] = np.arange(len(members))
        of = place[text]
        chosen = of >= 0
        sketch = np.zeros((size, len(members)))
        np.maximum.at(sketch.reshape(-1), (hashes[chosen] & (size - 1)) * len(members) + of[chosen], impact[chosen])
        made.append((size, members, sketch))
    return made


class Block:
    """A block of documents, ready for look-ups."""

    def __init__(self, row: dict, n: int, total: int):
        sizes, self.text_ends = (np.frombuffer(row[name], np.int32).astype(np.int64) for name in ("sizes", "id_ends"))
        term, times = (np.frombuffer(row[name], np.int32).astype(np.int64) for name in ("term", "times"))
        text = np.repeat(np.arange(len(sizes)), sizes)
        words = [t.encode() for t in row["terms"]]
        self.numbers, self.ids, self.size = {t: i for i, t in enumerate(words)}, row["ids"], len(words)
        self.impact = impacts(times, np.frombuffer(row["lengths"], np.int64)[text], n, total)
        self.keys = text * max(self.size, 1) + term  # rising
        hashes = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
        self.sketches = sketches(text, hashes[term], self.impact, sizes)

    def bounds(self, hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts, an upper bound of each one's score)."""
        texts = np.concatenate([members for _, members, _ in self.sketches] or [np.empty(0, np.int64)])
        bound = np.concatenate([weights @ sketch[hashes & (size - 1)] for size, _, sketch in self.sketches] or [np.empty(0)])
        return texts, bound

    def scores(self, texts: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores for the block's ``terms``."""
        wanted = texts[:, None] * max(self.size, 1) + terms
        at = np.minimum(np.searchsorted(self.keys, wanted), max(len(self.keys) - 1, 0))
        return (np.where(self.keys[at] == wanted, self.impact[at], 0) * weights).sum(1)

    def documents(self, text: int) -> list:
        return self.ids[int(self.text_ends[text - 1]) if text else 0:int(self.text_ends[text])]


def search_block(block: Block, queries: Queries, top: int) -> None:
    """Brings ``queries.best`` up to date with the block's texts."""
    for q, (terms, weights, hashes) in enumerate(zip(queries.terms, queries.weights, queries.hashes)):
        best = queries.best[q]
        least = -best[-1][0] if len(best) == top else 1
        texts, bound = block.bounds(hashes, weights.astype(np.float64))
        chosen = np.flatnonzero(bound >= least)
        if not len(chosen):
            continue
        order = chosen[np.argsort(-bound[chosen], kind="stable")]
        known = [(number, w) for term, w in zip(terms, weights.tolist()) if (number := block.numbers.get(term)) is not None]
        numbers, held = (np.array([k[i] for k in known], np.int64) for i in (0, 1))
        for start in range(0, len(order), STEP):
            step = order[start:start + STEP]
            if bound[step[0]] < least:
                break
            for text, score in zip(texts[step].tolist(), block.scores(texts[step], numbers, held).tolist()):
                if score >= least and score > 0:
                    best.extend((-score, i is None, i) for i in block.documents(text)[:top])
            if len(best) >= top:
                best.sort()
                del best[top:]
                least = -best[-1][0]


def _searched(n: int, total: int, top: int, kind: pa.DataType):
    def rows(queries: Queries) -> pa.RecordBatch:
        flat = [(number, i, -score) for number, best in zip(queries.numbers, queries.best) for score, _, i in best]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*flat) if flat else [()] * 3, [pa.int64(), kind, pa.int64()])], ["q", "_id", "score"])

    def run(batches):
        held: dict[int, Queries] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in ("terms", "ids", "id_ends", "sizes", "lengths", "term", "times")}
                block = Block(row, n, total)
                number = batch.column("query_block")[i].as_py()
                if number not in held:
                    if len(held) >= HELD:
                        yield rows(held.pop(next(iter(held))))
                    asked = batch.column("queries")[i].as_py()
                    words = [[t.encode() for t in a["terms"]] for a in asked]
                    held[number] = Queries([a["q"] for a in asked], words, [np.array(a["weights"], np.int64) for a in asked],
                                           [np.fromiter(map(zlib.crc32, w), np.int64, len(w)) for w in words], [[] for _ in asked])
                search_block(block, held[number], top)
        for queries in held.values():
            yield rows(queries)

    return run


def query_terms(items: DataFrame, text: str) -> DataFrame:
    """(q, terms) of the distinct texts of ``items`` that have terms, in Python workers as documents are read."""

    def run(batches):
        for batch in batches:
            found = [sorted(set(letter_words(blob))) for blob in blobs(batch, "_text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[t.decode() for t in f] for f in found], pa.list_(pa.string()))], ["q", "terms"])

    return items.select("q", F.col(text).alias("_text")).mapInArrow(run, "q bigint, terms array<string>").filter("size(terms) > 0")


def search(index: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", top: int = TOP) -> DataFrame:
    """(item id, rank, _id, score): the ``top`` best documents of the index for each row of ``items``; ``_id`` is their id."""
    rows = items.select(F.col(item_id).alias("_item"), F.coalesce(F.col(text), F.lit("")).alias("_asked"))
    classes = cut_lineage(rows.select("_asked").distinct().withColumn("q", F.monotonically_increasing_id()))
    terms = cut_lineage(query_terms(classes, "_asked"))
    counts = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("total")).first()
    each = terms.select("q", F.explode("terms").alias("term"))
    listed = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.dfs").alias("df"))
    asked = cut_lineage(each.select("term").distinct())
    frequent = cut_lineage(listed.join(asked, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")))
    weight = F.floor(1000 * F.log((2 * F.lit(counts["n"]) + 2).cast("double") / (2 * F.col("df") + 1))).cast("long")
    weighed = each.join(frequent.select("term", weight.alias("weight")), "term").filter("weight > 0")
    ready_queries = cut_lineage(weighed.groupBy("q").agg(F.collect_list(F.struct("term", "weight")).alias("t")).select("q", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights")))
    n_blocks = max(1, -(-ready_queries.count() // QUERIES))
    blocks = cut_lineage(ready_queries.groupBy(F.pmod(F.xxhash64("q"), F.lit(n_blocks)).alias("query_block")).agg(F.collect_list(F.struct("q", "terms", "weights")).alias("queries")))
    kind = index.schema["ids"].dataType.elementType
    # blocks of queries against blocks of documents: every query is asked of every document
    pairs = index.drop("n_docs", "n_terms", "dfs").crossJoin(blocks)
    found = pairs.mapInArrow(_searched(counts["n"], counts["total"], top, to_arrow_type(kind)), f"q bigint, _id {kind.simpleString()}, score bigint")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("_id")))
    best = cut_lineage(found.withColumn("rank", rank).filter(F.col("rank") <= top))
    return rows.join(classes, "_asked").join(best, "q").select(F.col("_item").alias(item_id), "rank", "_id", "score")


def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    index = build_index(table(spark, sf_dir, "documents"))
    found = search(index, table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", F.col("_id").alias("doc_id"), "score")


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS total FROM d WHERE len(w) > 0),
asked AS (SELECT DISTINCT q, item_id, t FROM i, unnest(w) AS u(t)),
held AS (SELECT r, doc_id, len(w) AS n, t, count(*) AS tf FROM d, unnest(w) AS u(t) WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
weight AS (SELECT t, floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, s GROUP BY t, s.n),
score AS (SELECT q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * held.n * s.n) // s.total))))::BIGINT AS score
          FROM asked JOIN held USING (t) JOIN weight USING (t), s GROUP BY q, item_id, r, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, r)::INTEGER AS rank, doc_id, score FROM score WHERE score > 0
QUALIFY rank <= 10
"""
