"""Byte-level BPE by recursive DuckDB queries, one in-process database per Spark task.

A text is cut by the vocabulary's pattern; each distinct match ("word") is encoded once per task. For a batch of new words,
one recursive query holds a row per word and token position. Each round joins neighbouring rows with the merge table (left
token, right token, rank, which is also the merged token's id), finds each word's pair of least rank, leftmost among equals,
contracts it, and ends when no word has a pair left. A second query decodes: ordered aggregation puts the bytes of the ids of a
word together again. Both results of a word are looked up to put together the ids and the decoded bytes of texts, in order; the
text itself takes no part in decoding. Where the library counts a character to another class than the pattern's matcher does, its
class decides.

The merge table follows from the ranks alone: every way to split a token's bytes into two tokens is a merge with the rank of
the whole. Words longer than ``LONG`` bytes would cost a round per byte over all their rows; they are contracted pair by
pair in the same order by a heap instead, with the same result.

Defined results: a null or empty text has no tokens and the digests of nothing; null ids and repeated rows are kept as they
are; an empty table gives an empty result; other columns are left alone. A worker's memory holds a batch and the bounded
memos of ``tokens``.
"""

from __future__ import annotations

import base64
import heapq

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm.text import blobs, table
from chronoweave.llm.tokens import Lookup, portions, stand_ins

#: Words of more bytes are contracted by a heap.
LONG = 512
#: Words of one recursive query.
ROUND_WORDS = 100_000
#: Of a task's database.
DATABASE_MEMORY = "400MB"

SETUP = """
CREATE TABLE vocabulary AS SELECT *, hex(bytes) AS digits FROM (SELECT unnest($1::BLOB[]) AS bytes, unnest($2::INTEGER[]) AS id);
CREATE TABLE merges AS
  SELECT l.id AS left_id, r.id AS right_id, v.id AS rank
  FROM vocabulary v, unnest(range(1, octet_length(v.bytes))) AS cut(pos)
  JOIN vocabulary l ON l.bytes = v.bytes[:pos] JOIN vocabulary r ON r.bytes = v.bytes[pos + 1:]
"""
#: A row's key is its word's number and its place there, ``BITS`` for the latter, so neighbours follow each other in order.
BITS = 10
#: Rank and key of a pair are compared as one number; key and token of a neighbour are read as one.
KEY_BITS, TOKEN_BITS = 40, 20
ENCODE = f"""
WITH RECURSIVE state(key, token, live) AS (
  SELECT (w.word::BIGINT << {BITS}) + p.place, v.id, true
  FROM words w, unnest(range(0, octet_length(w.bytes))) AS p(place) JOIN vocabulary v ON v.bytes = w.bytes[p.place + 1:p.place + 1]
  UNION ALL
  (WITH here AS (SELECT key, token, lead((key << {TOKEN_BITS}) | token) OVER (ORDER BY key) AS following FROM state WHERE live),
        pairs AS (SELECT h.key >> {BITS} AS word, (m.rank::BIGINT << {KEY_BITS}) | h.key AS pair, h.following >> {TOKEN_BITS} AS next_key
                  FROM here h JOIN merges m ON m.left_id = h.token AND m.right_id = (h.following & ((1 << {TOKEN_BITS}) - 1))
                  WHERE h.following >> {BITS + TOKEN_BITS} = h.key >> {BITS}),
        best AS (SELECT word, min(pair) >> {KEY_BITS} AS rank, min(pair) & ((1::BIGINT << {KEY_BITS}) - 1) AS key, arg_min(next_key, pair) AS gone
                 FROM pairs GROUP BY word)
   SELECT h.key, CASE WHEN h.key = b.key THEN b.rank::INTEGER ELSE h.token END, b.word IS NOT NULL
   FROM here h LEFT JOIN best b ON b.word = h.key >> {BITS} WHERE h.key IS DISTINCT FROM b.gone)
)
SELECT key >> {BITS} AS word, key, token FROM state WHERE NOT live
"""
#: Ids of a word in order, and the bytes that they stand for in the same order.
DECODE = """
SELECT t.word, ' ' || array_to_string(list(t.token ORDER BY t.key), ' ') AS ids, unhex(array_to_string(list(v.digits ORDER BY t.key), '')) AS decoded
FROM tokens t JOIN vocabulary v ON v.id = t.token GROUP BY t.word
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Coder:
    """Encodes and decodes words with the ranks of one vocabulary: a word's ids, each after a space, and its decoded bytes."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.base = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": DATABASE_MEMORY})
        create, merges = SETUP.split(";")
        self.base.execute(create, [list(self.ranks), list(self.ranks.values())])
        self.base.execute(merges)

    def code(self, words: list[bytes]) -> list[tuple[str, bytes]]:
        found: list = [self._by_heap(word) if len(word) > LONG else None for word in words]
        numbers = [i for i, word in enumerate(words) if len(word) <= LONG]
        for start in range(0, len(numbers), ROUND_WORDS):
            chosen = numbers[start:start + ROUND_WORDS]
            self.base.register("words", pa.table({"word": pa.array(chosen, pa.int32()), "bytes": pa.array([words[i] for i in chosen], pa.binary())}))
            self.base.execute(f"CREATE OR REPLACE TEMP TABLE tokens AS {ENCODE}")
            done = self.base.sql(DECODE).to_arrow_table()
            for word, *both in zip(*(done[name].to_pylist() for name in ("word", "ids", "decoded"))):
                found[word] = tuple(both)
            self.base.unregister("words")
        return found

    def _by_heap(self, word: bytes) -> tuple[str, bytes]:
        """The same contractions, least rank first and leftmost among equals, with neighbours in linked lists."""
        held = [word[i:i + 1] for i in range(len(word))]
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        pairs = [(self.ranks[word[i:i + 2]], i, held[i], held[i + 1]) for i in range(len(word) - 1) if word[i:i + 2] in self.ranks]
        heapq.heapify(pairs)
        while pairs:
            _, at, left, right = heapq.heappop(pairs)
            gone = after[at]
            if held[at] != left or gone >= len(word) or held[gone] != right:
                continue
            held[at], held[gone], after[at] = left + right, None, after[gone]
            if after[at] < len(word):
                before[after[at]] = at
            for i, j in ((before[at], at), (at, after[at])):
                if i >= 0 and j < len(word) and (both := held[i] + held[j]) in self.ranks:
                    heapq.heappush(pairs, (self.ranks[both], i, held[i], held[j]))
        ids = [self.ranks[token] for token in held if token is not None]
        return "".join(f" {i}" for i in ids), b"".join(self.tokens[i] for i in ids)


def _library_matches(kind: str, text: str) -> str:
    """What the library's own matcher finds; with single bytes as vocabulary, ids are bytes."""
    import tiktoken

    probe = tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return bytes(probe.encode_ordinary(text)).decode()


#: Look-ups of this Python worker, which Spark uses for many tasks: ids as text and decoded bytes of a word.
_LOOKUPS: dict[tuple[str, str], Lookup] = {}


def _lookup(ranks: str, pattern: str) -> Lookup:
    if (ranks, pattern) not in _LOOKUPS:
        coder = Coder(ranks)
        _LOOKUPS[ranks, pattern] = Lookup(pattern, lambda words: coder.code([word.encode() for word in words]), odd=stand_ins(_library_matches))
    return _LOOKUPS[ranks, pattern]


def encode_texts(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc id, n_tokens, ids, decoded): ids as decimal numbers joined by spaces, decoded as bytes.

    ``ranks`` is a file that every worker has at the same place, as it is part of the installed tokenizers.
    """

    def run(batches):
        lookup = _lookup(ranks, pattern)
        for batch in batches:
            ids, decoded = [], []
            for portion in portions([blob.decode() for blob in blobs(batch, "_text")]):
                for coded in lookup.values(portion):
                    ids.append("".join([word[0] for word in coded])[1:])
                    decoded.append(b"".join([word[1] for word in coded]))
            counts = [found.count(" ") + 1 if found else 0 for found in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.binary())],
                                             [doc_id, "n_tokens", "ids", "decoded"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, F.col(text).alias("_text")).mapInArrow(run, f"`{doc_id}` {kind}, n_tokens bigint, ids string, decoded binary")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every document."""
    import public_tokenizers

    coded = encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2(F.encode("ids", "UTF-8"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
