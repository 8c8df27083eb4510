"""Best-fit packing of token sequences by linear grouping.

Texts become pieces of at most ``capacity`` tokens. Only how many pieces have each length matters for a plan, and there are at
most ``capacity`` lengths, so the plan is made on the driver from a histogram of fixed size, whatever the number of texts:

1. Pieces of a full sequence stand alone. Of the others, those longer than ``small`` are sorted by length and cut into
   ``groups`` groups of equal cardinality; each length is rounded up to the largest of its group.
2. For these few sizes, the least number of sequences is a linear program over configurations (how many pieces of each size
   share a sequence). It is solved by column generation: a knapsack over the dual prices proposes the next configuration.
3. Each whole multiple of a configuration becomes that many sequences, whose places are taken by actual pieces of the group,
   longest first, with their own lengths, so rounding costs no space.
4. What is left over, and all small pieces, are placed by best fit, longest first, in the free space of all sequences.

The plan says, for a length and a range of ranks, which sequences the pieces take. Ranks come from a window over (length, salt)
with offsets of the salts, so a length that a third of all pieces has is numbered by many tasks.

The string of a special token in a text gets that token's id, as the tokenizer gives it.

Defined results: a null or empty text is one piece, the end id alone; a null id is kept, and so are repeated rows, each with
pieces of its own; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.llm.text import blobs, table
from chronoweave.llm.tokens import SPACED, Lookup, PartLookup, every_character, portions, stand_ins
from chronoweave.session import cut_lineage

CAPACITY = 1024
#: Parts of the capacity up to which pieces count as small. Rounding pays where few pieces share a sequence, and costs where
#: there is no lack of small ones, so a plan is made for each part and the one with fewest sequences is taken.
SMALL_PARTS = (2, 3, 4)
#: Sizes left after rounding.
GROUPS = 48
#: Windows that number the pieces of one length.
SALTS = 256

_PLACES = "_length int, _from bigint, _to bigint, _sequence bigint, _offset int, _each int"


@dataclass
class Run:
    """``count`` sequences from ``first`` on with the same free space."""

    first: int
    count: int
    free: int


class Plan:
    """Places for all pieces of a histogram (length to count); ``places`` are rows of ``_PLACES``.

    Pieces of ``_length`` with ranks from ``_from`` up to ``_to`` take ``_each`` places a sequence, from ``_sequence`` and
    ``_offset`` on.
    """

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, small: int = CAPACITY // 2, groups: int = GROUPS):
        self.capacity, self.small, self.sequences = capacity, small, 0
        self.places: list[tuple[int, int, int, int, int, int]] = []
        self.taken: dict[int, int] = defaultdict(int)
        self.left = {length: count for length, count in histogram.items() if count}
        self.runs: dict[int, list[Run]] = defaultdict(list)
        if full := self.left.pop(capacity, 0):
            self._place(capacity, Run(0, full, capacity), 1, full, 0)
            self.sequences = full
        self._configured(groups)
        for length in sorted(self.left, reverse=True):
            self._best_fit(length, self.left[length])

    def _place(self, length: int, run: Run, each: int, count: int, offset: int) -> None:
        begin = self.taken[length]
        self.places.append((length, begin, begin + count, run.first, offset, each))
        self.taken[length] = begin + count

    def _configured(self, groups: int) -> None:
        large = sorted((length for length in self.left if length > self.small), reverse=True)
        total = sum(self.left[length] for length in large)
        if not total:
            return
        members: list[list[list[int]]] = []  # of each group: [length, count], longest first
        room = 0
        for length in large:
            count = self.left[length]
            while count:
                if room == 0:
                    members.append([])
                    room = -(-total // groups)
                part = min(count, room)
                members[-1].append([length, part])
                count, room = count - part, room - part
        sizes = [group[0][0] for group in members]
        for pattern, times in configurations(sizes, [sum(n for _, n in group) for group in members], self.capacity):
            slots = [g for g, n in enumerate(pattern) for _ in range(n)]
            while times:
                # the longest pieces left of each group, as many sequences as have the same lengths in all places
                taken: dict[int, int] = defaultdict(int)
                chosen = []
                for g in slots:
                    skip, k = taken[g], 0
                    while skip >= members[g][k][1]:
                        skip, k = skip - members[g][k][1], k + 1
                    chosen.append(k)
                    taken[g] += 1
                share: dict[tuple[int, int], int] = defaultdict(int)
                for g, k in zip(slots, chosen):
                    share[g, k] += 1
                step = min([times, *(max(1, members[g][k][1] // n) if share[g, k] == taken[g] else 1 for (g, k), n in share.items())])
                run, offset = Run(self.sequences, step, self.capacity), 0
                for g, k in zip(slots, chosen):
                    length = members[g][k][0]
                    self._place(length, run, 1, step, offset)
                    offset += length
                for (g, k), n in share.items():
                    members[g][k][1] -= n * step
                    self.left[members[g][k][0]] -= n * step
                for g in set(slots):
                    members[g] = [m for m in members[g] if m[1]]
                self.sequences += step
                times -= step
                self._add(Run(run.first, step, self.capacity - offset))

    def _add(self, run: Run) -> None:
        if run.free and run.count:
            self.runs[run.free].append(run)

    def _best_fit(self, length: int, count: int) -> None:
        """The tightest sequence that fits, as one by one, for equal sequences at once."""
        for free in sorted(f for f in self.runs if f >= length):
            held = self.runs[free]
            while held and count:
                run, each = held.pop(), free // length
                filled = min(run.count, count // each)
                if filled:
                    self._place(length, run, each, filled * each, self.capacity - free)
                    count -= filled * each
                    self._add(Run(run.first, filled, free - each * length))
                rest = Run(run.first + filled, run.count - filled, free)
                if rest.count and count:  # fewer pieces than one sequence takes
                    self._place(length, Run(rest.first, 1, free), count, count, self.capacity - free)
                    self._add(Run(rest.first, 1, free - count * length))
                    rest, count = Run(rest.first + 1, rest.count - 1, free), 0
                if rest.count:
                    held.append(rest)
                    break
            if not count:
                return
        each = self.capacity // length
        filled = count // each
        if filled:
            run = Run(self.sequences, filled, self.capacity)
            self._place(length, run, each, filled * each, 0)
            self._add(Run(run.first, filled, self.capacity - each * length))
        if count > filled * each:
            rest = count - filled * each
            self._place(length, Run(self.sequences + filled, 1, self.capacity), rest, rest, 0)
            self._add(Run(self.sequences + filled, 1, self.capacity - rest * length))
            filled += 1
        self.sequences += filled


def best_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan with fewest sequences over ``SMALL_PARTS``."""
    return min((Plan(histogram, capacity, capacity // part) for part in SMALL_PARTS), key=lambda plan: plan.sequences)


def _knapsack(sizes: list[int], prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The dearest configuration that fits, and its price."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    sizes_ = np.array(sizes)
    for room in range(1, capacity + 1):
        fit = sizes_ <= room
        best[room] = best[room - 1]
        if fit.any():
            values = np.where(fit, best[np.maximum(room - sizes_, 0)] + prices, -1.0)
            k = int(values.argmax())
            if values[k] > best[room] + 1e-12:
                best[room], choice[room] = values[k], k
    pattern, room = np.zeros(len(sizes), int), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= sizes[choice[room]]
    return float(best[capacity]), pattern


def configurations(sizes: list[int], counts: list[int], capacity: int, rounds: int = 400) -> list[tuple[list[int], int]]:
    """Configurations of the optimal basis and their whole multiples (rounded down); ``rounds`` bounds the simplex steps."""
    m = len(sizes)
    basis = np.diag([capacity // size for size in sizes]).astype(float)  # a column per configuration
    need = np.array(counts, float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        prices = np.ones(m) @ inverse
        value, pattern = _knapsack(sizes, np.maximum(prices, 0), capacity)
        if value <= 1 + 1e-9:
            break
        level, direction = inverse @ need, inverse @ pattern
        ratios = np.where(direction > 1e-9, level / np.where(direction > 1e-9, direction, 1), np.inf)
        basis[:, int(ratios.argmin())] = pattern
    level = np.linalg.solve(basis, need)
    left, chosen = list(counts), []
    for j in np.argsort(-level, kind="stable"):
        pattern = basis[:, j].astype(int)
        times = min([max(0, int(level[j] + 1e-6)), *(left[g] // n for g, n in enumerate(pattern) if n)])
        if times:
            chosen.append((pattern.tolist(), times))
            left = [have - times * n for have, n in zip(left, pattern)]
    return chosen


#: Look-ups of this Python worker, which Spark uses for many tasks.
_LOOKUPS: dict[tuple[str, str], Callable[[list[str]], list[bytes]]] = {}


def _lookup(path: str, pattern: str) -> Callable[[list[str]], list[bytes]]:
    if (path, pattern) not in _LOOKUPS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Regex, Tokenizer
        from tokenizers.pre_tokenizers import Split

        tokenizer = Tokenizer.from_file(path)
        special = [token.content for token in tokenizer.get_added_tokens_decoder().values()]

        def encode(words: list[str]) -> list[bytes]:
            return [np.array(found.ids, "<u4").tobytes() for found in tokenizer.encode_batch_fast(words, add_special_tokens=False)]

        def matches(kind: str, text: str) -> str:
            return "".join(part for part, _ in Split(Regex(kind + "+"), "removed", invert=True).pre_tokenize_str(text))

        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        width = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # bytes that an id stands for
        width[list(vocabulary.values())] = list(map(len, vocabulary))

        def cut(parts: list[str], ids: bytes) -> list[bytes] | None:
            """The ids of each part of a text: those that stand for its bytes."""
            ends = np.cumsum(pc.binary_length(pa.array(parts, pa.large_string())).to_numpy())
            reached = np.cumsum(width[np.frombuffer(ids, "<u4")])
            at = np.searchsorted(reached, ends)
            if at[-1] >= len(reached) or (reached[at] != ends).any():
                return None
            places = [0, *(4 * at + 4).tolist()]
            return [ids[a:b] for a, b in zip(places, places[1:])]

        if pattern in SPACED and not any(" " in token for token in special):
            lookup = PartLookup(encode, cut, matches(r"\s", every_character()))
        else:
            lookup = Lookup(pattern, encode, b"", stand_ins(matches))

        def ids_of(texts: list[str]) -> list[bytes]:
            """By parts or words; a text that holds the string of a special token goes to the tokenizer as it is."""
            whole = {i: text for i, text in enumerate(texts) if any(token in text for token in special)}
            found = lookup.of(["" if i in whole else text for i, text in enumerate(texts)])
            for i, text in whole.items():
                found[i], = encode([text])
            return found

        _LOOKUPS[path, pattern] = ids_of
    return _LOOKUPS[path, pattern]


def token_pieces(docs: DataFrame, path: str, pattern: str, end_id: int = 2, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc id, piece, start, length, ids): ids as little-endian unsigned 32-bit numbers.

    ``path`` is a byte-level BPE of the tokenizers library with ``pattern``; of a longer text, the first piece takes what the
    others, of full length, leave.
    """

    def run(batches):
        lookup, end = _lookup(path, pattern), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            rows: list[int] = []
            done = 0
            for portion in portions([blob.decode() for blob in blobs(batch, "_text")]):
                for row, ids in enumerate(lookup(portion), done):
                    ids += end
                    n = len(ids) // 4
                    first = n % capacity or capacity
                    starts = [0, *range(first, n, capacity)]
                    ends = [*starts[1:], n]
                    rows += [row] * len(starts)
                    columns[0] += range(len(starts))
                    columns[1] += starts
                    columns[2] += [b - a for a, b in zip(starts, ends)]
                    columns[3] += [ids[4 * a:4 * b] for a, b in zip(starts, ends)]
                done += len(portion)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                                             [doc_id, "piece", "start", "length", "ids"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, F.col(text).alias("_text")).mapInArrow(run, f"`{doc_id}` {kind}, piece int, start bigint, length bigint, ids binary")


def pack(pieces: DataFrame, length: str = "length", key: tuple[str, ...] = ("doc_id", "piece"), capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. They are read several times, so they should be a written table."""
    spark = pieces.sparkSession
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*key), F.lit(SALTS)).cast("int")).withColumn("_length", F.col(length).cast("int"))
    sizes = salted.groupBy("_length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long"))))
    histogram = {row["_length"]: row["n"] for row in offsets.groupBy("_length").agg(F.sum("_n").alias("n")).collect()}  # at most ``capacity`` rows
    plan = best_plan(histogram, capacity)
    places = defaultdict(list)
    for at, begin, end, sequence, offset, each in plan.places:
        places[at].append((begin, end, sequence, offset, each))
    # at most a few places per length and configuration, whatever the number of pieces
    table_of = {at: np.array(sorted(rows), np.int64) for at, rows in places.items()}

    def place(batches):
        for batch in batches:
            lengths, ranks = batch.column("_length").to_numpy(), batch.column("_rank").to_numpy()
            out = np.empty((2, len(lengths)), np.int64)
            for at in np.unique(lengths):
                chosen = lengths == at
                rows, rank = table_of[int(at)], ranks[chosen]
                row = rows[np.searchsorted(rows[:, 0], rank, "right") - 1]
                out[0, chosen] = row[:, 2] + (rank - row[:, 0]) // row[:, 4]
                out[1, chosen] = row[:, 3] + (rank - row[:, 0]) % row[:, 4] * int(at)
            keep = batch.schema.names[:-2]
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in keep), pa.array(out[0]), pa.array(out[1])], [*keep, "sequence_id", "offset"])

    rank = F.row_number().over(Window.partitionBy("_length", "_salt").orderBy(*key)) - 1
    numbered = salted.withColumn("_row", rank).join(offsets.select("_length", "_salt", "_base"), ["_length", "_salt"])
    shown = [F.col(name) for name in pieces.columns]
    schema = ", ".join(f"`{name}` {kind}" for name, kind in pieces.dtypes)
    return numbered.select(*shown, "_length", (F.col("_base") + F.col("_row")).alias("_rank")).mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def packed_digests(docs: DataFrame) -> DataFrame:
    """The contract's rows: pieces with the CRC of their ids, and their places."""
    import public_tokenizers

    pieces = token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return pack(cut_lineage(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    return packed_digests(table(spark, sf_dir, "documents"))
