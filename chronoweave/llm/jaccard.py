"""N-gram Jaccard join by PartEnum signatures: every pair of texts whose shingle sets reach the threshold is linked.

Two sets of sizes a and b with Jaccard similarity of at least 3/4 differ in at most (a + b) / 7 shingles, which is at most
a / 3 and b / 3. The shingle domain is cut into partitions; of partitions at most k = a / 3 can differ, so among any k + 1
partitions that set A fills, one is equal in B. A signature is the hash of one such subset: the shingles of a set in one
partition. Where each shingle is a partition, k = a / 4 is enough, for only what A has and B lacks counts. Each set enumerates its k + 1 first filled partitions and some spare ones, in one fixed order of partitions; of
two similar sets, that which gets less far down the order finds at least 1 + spare of its signatures in the other. Sizes
fall into bands of ratio 4 with a number of partitions each, and pairs meet in the band of the larger set, so sets near a
band's end sign for the next one, too. In the first band each shingle is a partition of its own.

A signature that more than ``GROUP`` texts share (a passage or line in many documents) is hot. A set with fewer hot
signatures than it has to share with a partner is always found by another one, so its hot ones are dropped. The others sign
again, among themselves and with all their shingles. Of two similar sets the one that is not larger shares six sevenths of its
shingles, so it finds the other through one that is not hot, unless less than a seventh of it is wording of its own: a text's
rare shingles decide, however common the rest is. Texts with so little of their own, as members of a large group of near
copies, are checked against the member with most hot signatures, and only where that leaves parts unconnected, each looks for
larger partners in other parts, in as few of its smallest groups as a partner cannot miss, and in one of the groups that have the
same members; the largest part does not look within itself. There sketches (which bins hold an odd number of shingles) are
compared tile by tile inside the tasks, which give out only pairs that these cannot rule out. No link is lost, and a group of near
copies costs as many checks as it has members.

Equal texts count as one node (a 64-bit hash; if two different texts share it, all hashes are salted anew). Candidate pairs
that sketches cannot rule out are checked on the whole texts: one partner of each text first, then the pairs that
this leaves unconnected.

Defined results: a null text, or one without words, has no shingles, links with nothing and is its own component; a null id
is never the smallest while there is another one; repeated rows get the same result each; an empty table gives an empty
result; other columns are left alone. Python tasks hold one batch and the shingles of one text.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.llm.components import components
from chronoweave.llm.text import blobs, plain_words, table
from chronoweave.session import cut_lineage

SHINGLE = 5
#: A signature shared by more texts is hot.
GROUP = 16
#: Spare signatures as a share of those that must be enumerated.
SPARE = 0.3
#: Texts whose words are hashed into shingles at once.
BLOCK = 64
#: Texts on either side of a tile.
TILE = 2048
#: Largest set of the first band, ratio of bands, and shingles per partition in the largest set of a band.
FIRST, RATIO, FILL = 256, 4, 1.7

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """Hashes of words seen so far; starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingles(words: list[bytes], known: WordHashes, length: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``length`` words; fewer words make one run, none make none."""
    if not words:
        return np.empty(0, _U)
    hashes = np.fromiter(map(known.__getitem__, words), _U, len(words))
    length = min(length, len(words))
    total = np.full(len(words) - length + 1, length, _U)
    for i in range(length):
        total = mix(total * _U(0x9E3779B97F4A7C15) + hashes[i:len(words) - length + 1 + i])
    return distinct(total)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values, as np.unique gives them."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def sets(texts: list[bytes], known: WordHashes, length: int = SHINGLE) -> Iterable[np.ndarray]:
    """``shingles`` of the plain words of each text, with a look at ``known`` per distinct word of all texts only."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_binary()).view(pa.large_string())))
    coded = split.values.dictionary_encode()
    names = pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary.view(pa.large_binary()))
    words = pc.binary_join(names, pa.scalar(b" ", pa.large_binary()))[0].as_py().split(b" ")
    every = np.fromiter(map(known.__getitem__, words), _U, len(words))[coded.indices.to_numpy()]
    real = (pc.binary_length(coded.dictionary).to_numpy() > 0)[coded.indices.to_numpy()]  # white space at an end has an empty word beside it
    bounds = np.append(0, np.cumsum(real))[split.offsets.to_numpy()].tolist()
    every = every[real]
    for start in range(0, len(texts), BLOCK):
        starts, ends = bounds[start:start + BLOCK], bounds[start + 1:start + 1 + BLOCK]
        held = every[starts[0]:ends[-1]]
        total = np.full(max(0, len(held) - length + 1), length, _U)
        for i in range(length):
            total = mix(total * _U(0x9E3779B97F4A7C15) + held[i:len(total) + i])
        for a, b in zip(starts, ends):
            yield distinct(total[a - starts[0]:b - length + 1 - starts[0]]) if b - a >= length else _short(every[a:b])


def _short(hashes: np.ndarray) -> np.ndarray:
    """The set of a text with fewer words than a shingle has."""
    total = np.full(min(1, len(hashes)), len(hashes), _U)
    for one in hashes:
        total = mix(total * _U(0x9E3779B97F4A7C15) + one)
    return total


def _band(size: int) -> int:
    band, top = 0, FIRST
    while size > top:
        band, top = band + 1, top * RATIO
    return band


def _enumerated(size: int, band: int) -> tuple[int, int, int]:
    """How many partitions of a set a partner may lack, how many are enumerated, and how many of those a partner shares.

    A partner may be smaller by a quarter, go less far down the order and so have fewer spare ones.
    """
    of = 3 if band else 4
    most = size // of
    return most, most + 1 + int(np.ceil(SPARE * most)), 1 + int(np.ceil(SPARE * (-(-3 * size // 4) // of)))


def signatures(held: np.ndarray) -> tuple[np.ndarray, int]:
    """The signatures of a set of shingles, with the band in their low four bits, and how many of a band a partner must share."""
    size = len(held)
    order = mix(held ^ _U(0x5851F42D4C957F2D))
    made, least = [], size
    for band in sorted({_band(size), _band(size * 4 // 3)}):
        most, wanted, share = _enumerated(size, band)
        if band == 0:
            parts = np.partition(order, wanted - 1)[:wanted] if wanted < size else order
            values = parts
        else:
            place = order % _U(int(FIRST * RATIO**band / FILL))
            by = np.argsort(place, kind="stable")
            parts, first = np.unique(place[by], return_index=True)
            parts, values = parts[:wanted], np.add.reduceat(mix(held[by]), first)[:wanted]
        least = min(least, share, len(parts) - most)
        made.append((mix(values + mix(parts + _U(band + 1))) & ~_U(15)) | _U(min(band, 15)))
    return np.concatenate(made) if made else np.empty(0, _U), least


def _share(held: np.ndarray) -> int:
    """The second result of ``signatures``, for which the filled partitions need only be counted."""
    size = least = len(held)
    for band in sorted({_band(size), _band(size * 4 // 3)}):
        most, wanted, share = _enumerated(size, band)
        filled = size
        if band:
            place = mix(held ^ _U(0x5851F42D4C957F2D)) % _U(int(FIRST * RATIO**band / FILL))
            filled = np.count_nonzero(np.bincount(place.astype(np.int64)))
        least = min(least, share, min(wanted, filled) - most)
    return least


def sketch(held: np.ndarray) -> bytes:
    """Whether the shingles that fall into each of 512 or more bins, a power of two four to eight times the set's size, are odd in number.

    Two sets differ in no fewer shingles than bins, for what both have adds up to an even number in every bin.
    """
    bins = 8 * max(64, 1 << max(0, len(held) // 2 - 1).bit_length())
    return np.packbits(np.bincount((held & _U(bins - 1)).astype(np.int64), minlength=bins) & 1, bitorder="little").tobytes()


def differ_at_least(left: bytes, right: bytes) -> int:
    """A lower bound of the shingles in which two sets differ, from their sketches; the finer one is folded."""
    x, y = sorted((np.frombuffer(s, _U) for s in (left, right)), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x))) ^ x).sum())


def _sized(batches):
    """(node, text) to (node, n, share, sketch): the size, and of how many signatures a partner shares one at least."""
    known = WordHashes()
    for batch in batches:
        columns: list[list] = [[], [], []]
        for held in sets(blobs(batch, "_text"), known):
            for column, value in zip(columns, (len(held), _share(held), sketch(held))):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["node", "n", "share", "sketch"])


def _signed(sign):
    """(node, text) to (sig, node), a row per signature that ``sign`` gives for a set of shingles."""
    def run(batches):
        known = WordHashes()
        for batch in batches:
            made = list(map(sign, sets(blobs(batch, "_text"), known)))
            nodes = np.repeat(batch.column(0).to_numpy(), [len(sigs) for sigs in made])
            sigs = np.concatenate(made).view(np.int64) if made else np.empty(0, np.int64)
            for start in range(0, len(sigs), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(sigs[start:start + 100_000]), pa.array(nodes[start:start + 100_000])], ["sig", "node"])

    return run


def _plausible(batches):
    """(a, b, n_a, n_b, sketch_a, sketch_b) to (a, b) that the sketches do not rule out."""
    for batch in batches:
        rows = zip(*(batch.column(i).to_pylist() for i in range(2, 6)))
        chosen = [i for i, (n, m, left, right) in enumerate(rows) if 7 * differ_at_least(left, right) <= n + m]
        yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(chosen, pa.int64())) for i in (0, 1)], ["a", "b"])


def _bounds(one: bytes, table: np.ndarray) -> np.ndarray:
    """``differ_at_least`` of a sketch and each row of a table of sketches."""
    x, y = np.frombuffer(one, _U), np.ascontiguousarray(table).view(_U)
    least = min(len(x), y.shape[1])
    x, y = np.bitwise_xor.reduce(x.reshape(-1, least)), np.bitwise_xor.reduce(y.reshape(len(y), -1, least), axis=1)
    return np.bitwise_count(y ^ x).sum(1, dtype=np.int64)


class _Side:
    """Texts on one side of a tile: nodes, sizes, parts, and sketches by their length."""

    def __init__(self, rows: pa.Table):
        self.node, self.n, self.part = (rows.column(name).to_numpy() for name in ("node", "n", "part"))
        self.sketch = rows.column("sketch").to_pylist()
        lengths = np.fromiter(map(len, self.sketch), np.int64, len(self.sketch))
        self.tables = []
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            self.tables.append((at, np.frombuffer(b"".join(self.sketch[i] for i in at), np.uint8).reshape(len(at), length)))

    def partners(self, node: int, n: int, part: int, sketch: bytes) -> list[tuple[int, int]]:
        """Pairs with the texts here that are in another part, not smaller, and not ruled out."""
        found = []
        for at, table in self.tables:
            fits = np.flatnonzero((self.part[at] != part) & (self.n[at] >= n) & (3 * self.n[at] <= 4 * n))
            if len(fits):
                near = fits[7 * _bounds(sketch, table[fits]) <= n + self.n[at[fits]]]
                found += [(min(node, other), max(node, other)) for other in self.node[at[near]].tolist()]
        return found


def _tiles(largest: int):
    """(sig, row, column, looks, node, n, part, sketch) sorted by the first three, the tile, to pairs (a, b) of those that look with others.

    A looking text of the part ``largest`` meets only texts outside it.
    """
    def pairs(rows: pa.Table) -> pa.RecordBatch:
        looks = rows.column("looks").to_numpy()
        lookers, others = _Side(rows.filter(pa.array(looks))), rows.filter(pa.array(~looks))
        every, outer = _Side(others), _Side(others.filter(pa.array(others.column("part").to_numpy() != largest)))
        found = [pair for one in zip(lookers.node.tolist(), lookers.n.tolist(), lookers.part.tolist(), lookers.sketch)
                 for pair in (outer if one[2] == largest else every).partners(*one)]
        two = np.unique(np.array(found, np.int64).reshape(-1, 2), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(two[:, 0]), pa.array(two[:, 1])], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows])
            keys = np.stack([rows.column(i).to_numpy() for i in range(3)])
            cuts = np.flatnonzero((np.diff(keys) != 0).any(0)) + 1
            starts = [0, *cuts.tolist()]
            for start, end in zip(starts, starts[1:]):
                yield pairs(rows.slice(start, end - start))
            held = rows.slice(starts[-1])
        if held is not None and held.num_rows:
            yield pairs(held)

    return run


def _candidates(batches):
    """(sig, node) sorted by sig to pairs (a, b, null) of groups up to GROUP, and members (a, null, sig) of larger ones."""
    pairs, hot, waiting = [], [], 0
    sig, members, is_hot = None, set(), False

    def flush():
        nonlocal pairs, hot, waiting
        two = np.unique(np.array(pairs, np.int64).reshape(-1, 2), axis=0)
        one = np.array(hot, np.int64).reshape(-1, 2)
        null = lambda n: pa.nulls(n, pa.int64())
        out = [pa.RecordBatch.from_arrays([pa.array(two[:, 0]), pa.array(two[:, 1]), null(len(two))], ["a", "b", "sig"]),
               pa.RecordBatch.from_arrays([pa.array(one[:, 0]), null(len(one)), pa.array(one[:, 1])], ["a", "b", "sig"])]
        pairs, hot, waiting = [], [], 0
        return out

    def close():
        nonlocal waiting
        if not is_hot and len(members) > 1:
            group = sorted(members)
            pairs.extend((a, b) for i, a in enumerate(group) for b in group[i + 1:])
            waiting += len(group) * (len(group) - 1) // 2

    for batch in batches:
        sigs, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero(np.diff(sigs)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(sigs)]])
        # the first run may go on from, and the last one into, another batch; runs of one in between are no group
        chosen = np.flatnonzero((ends - starts > 1) | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == len(starts) - 1))
        for i in chosen.tolist() if len(sigs) else []:
            if sig is None or sigs[starts[i]] != sig:
                close()
                sig, members, is_hot = int(sigs[starts[i]]), set(), False
            new = set(nodes[starts[i]:ends[i]].tolist())
            if not is_hot:
                members |= new
                new = members
            if is_hot or len(members) > GROUP:
                is_hot = True
                hot.extend((node, sig) for node in new)
                waiting += len(new)
                members = set()
            if waiting > 500_000:
                yield from flush()
    close()
    yield from flush()


def _checked(batches):
    """(a, b, text of a, text of b) to (a, b) of similar texts."""
    known = WordHashes()
    for batch in batches:
        sets, out = {}, []
        a, b = (batch.column(i).to_pylist() for i in (0, 1))
        for x, y, left, right in zip(a, b, blobs(batch, "_left"), blobs(batch, "_right")):
            for node, blob in ((x, left), (y, right)):
                if node not in sets:
                    sets[node] = shingles(plain_words(blob), known)
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            out.append(100 * both >= 75 * (len(sets[x]) + len(sets[y]) - both))
        chosen = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(chosen)) for i in (0, 1)], ["a", "b"])


def _node(text: Column, salt: int) -> Column:
    return F.when(text.isNotNull(), F.xxhash64(F.lit(salt), text))


def _classes(docs: DataFrame) -> tuple[int, DataFrame]:
    """The salt and (node, first id): one node per text that differs from all others."""
    salt = 0
    while True:
        rows = docs.select("_id", _node(F.col("_text"), salt).alias("node"), F.md5("_text").alias("key")).filter("node IS NOT NULL")
        classes = cut_lineage(rows.groupBy("node").agg(F.min("_id").alias("first"), (F.min("key") == F.max("key")).alias("pure")))
        if classes.filter("NOT pure").isEmpty():
            return salt, classes.drop("pure")
        salt += 1


def _similar(docs: DataFrame, doc_id: str, text: str) -> tuple[int, DataFrame]:
    """The salt of the nodes and (_id, node, n_shingles, component_id), one row per row of ``docs``."""
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    salt, classes = _classes(rows)
    rows = rows.withColumn("node", _node(F.col("_text"), salt))
    texts = rows.filter("node IS NOT NULL").select("node", "_text")
    known = texts.mapInArrow(_sized, "node bigint, n bigint, share bigint, sketch binary")
    sizes = cut_lineage(known.groupBy("node").agg(*(F.first(name).alias(name) for name in ("n", "share", "sketch"))))

    def candidates(signing: DataFrame, sign) -> tuple[DataFrame, DataFrame]:
        """Pairs of the groups that are not hot, and members of hot ones."""
        spread = signing.mapInArrow(_signed(sign), "sig bigint, node bigint").repartition("sig").sortWithinPartitions("sig")
        found = cut_lineage(spread.mapInArrow(_candidates, "a bigint, b bigint, sig bigint"))
        return plausible(found.filter("b IS NOT NULL").select("a", "b")), found.filter("sig IS NOT NULL").select("sig", F.col("a").alias("node")).distinct()

    def plausible(pairs: DataFrame) -> DataFrame:
        of = {x: sizes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab"}
        near = pairs.distinct().join(of["a"], "a").join(of["b"], "b").filter("100 * least(n_a, n_b) >= 75 * greatest(n_a, n_b)")
        return cut_lineage(near.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_plausible, "a bigint, b bigint"))

    def checked(pairs: DataFrame) -> DataFrame:
        left = pairs.join(some.select(F.col("node").alias("a"), F.col("_text").alias("_left")), "a")
        full = left.join(some.select(F.col("node").alias("b"), F.col("_text").alias("_right")), "b").select("a", "b", "_left", "_right")
        return cut_lineage(full.mapInArrow(_checked, "a bigint, b bigint"))

    def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """The pairs whose ends are not connected yet."""
        of = {x: labels.select(F.col("node").alias(x), F.col("component").alias(f"part_{x}")) for x in "ab"}
        return pairs.join(of["a"], "a", "left").join(of["b"], "b", "left").filter("NOT coalesce(part_a, a) <=> coalesce(part_b, b)").select("a", "b")

    pairs, hot = candidates(texts, lambda held: signatures(held)[0])
    n_hot = F.count(F.lit(1)).alias("n_hot")
    poor = hot.groupBy("node", F.col("sig").bitwiseAND(15).alias("band")).agg(n_hot).join(sizes.select("node", "share"), "node").filter("n_hot >= share")
    again = cut_lineage(poor.select("node").distinct())
    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(again).distinct().join(classes, "node")
    chosen = rows.join(needed, (rows["node"] == needed["node"]) & rows["_id"].eqNullSafe(needed["first"]), "left_semi")
    some = cut_lineage(chosen.select("node", "_text").dropDuplicates(["node"]))  # the texts that are looked at again
    more, hot = candidates(some.join(again, "node", "left_semi"), lambda held: held)
    hot = cut_lineage(hot.join(sizes.select("node", "n"), "node"))
    # as the smaller one of a pair, a text shares n - n div 7 of its shingles
    looks = hot.groupBy("node", "n").agg(n_hot).withColumn("n_looks", F.expr("n_hot - n + n div 7 + 1")).filter("n_looks > 0").drop("n")
    crowds = cut_lineage(hot.join(looks, "node"))
    leaders = cut_lineage(crowds.groupBy("sig").agg(F.max_by("node", F.struct("n_hot", "node")).alias("leader")))
    stars = plausible(crowds.join(leaders, "sig").filter("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")))
    pairs = pairs.unionByName(more)

    # members against leaders and one partner of each text first, which connects most groups; then only what is still apart
    links = checked(cut_lineage(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").unionByName(stars).distinct()))
    labels = components(links)
    rest = cut_lineage(apart(pairs, labels).distinct())
    if not rest.isEmpty():
        links = links.unionByName(checked(rest))
        labels = components(links)

    # If no shingle that is not hot has found a larger partner of a text in a crowd, that partner is in one of any n_looks of its
    # hot groups, so the cheapest ones are enough. Groups of the same members count as one class, of as many groups: a text looks
    # into one of them, and pairs do not come out of every shingle of a passage. Texts of the largest part look outside it only.
    parted = cut_lineage(hot.join(labels, "node", "left").select("sig", "node", "n", F.coalesce("component", "node").alias("part")))
    same = [F.bit_xor(F.xxhash64(F.lit(seed), "node")).alias(f"of_{seed}") for seed in (0, 1)]  # 128 bits that stand for the members
    alike = parted.groupBy("sig").agg(F.count(F.lit(1)).alias("members"), (F.min("part") < F.max("part")).alias("mixed"), *same)
    groups = cut_lineage(alike.groupBy("members", "of_0", "of_1").agg(F.min("sig").alias("sig"), F.count(F.lit(1)).alias("weight"), F.first("mixed").alias("mixed")))
    if not groups.filter("mixed").isEmpty():
        largest = parted.select("node", "part").distinct().groupBy("part").count().agg(F.max_by("part", F.struct("count", "part")).alias("largest")).first()["largest"]
        cheapest = Window.partitionBy("node").orderBy(F.expr("members / least(weight, n_looks)"), "sig")  # a text's own shingles only
        before = F.coalesce(F.sum("weight").over(cheapest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        classes_of = crowds.select("sig", "node", "n_looks").join(groups, "sig").withColumn("before", before)
        chosen = classes_of.filter("before < n_looks AND mixed").select("sig", "node")
        looking = cut_lineage(chosen.join(parted, ["sig", "node"]))
        side = lambda count: F.ceil(F.col(count) / TILE).cast("int")
        met = cut_lineage(looking.groupBy("sig").agg(F.count(F.lit(1)).alias("lookers")).join(groups, "sig").select("sig", side("lookers").alias("rows"), side("members").alias("columns")))
        own = lambda count: F.pmod(F.xxhash64("node"), F.col(count)).cast("int")
        every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
        shown = [F.col(name) for name in ("node", "n", "part")]
        tiles = looking.join(met, "sig").select("sig", own("rows").alias("row"), every("columns").alias("column"), F.lit(True).alias("looks"), *shown).unionByName(
            parted.join(met, "sig").select("sig", every("rows").alias("row"), own("columns").alias("column"), F.lit(False).alias("looks"), *shown))
        dealt = tiles.join(sizes.select("node", "sketch"), "node").select("sig", "row", "column", "looks", "node", "n", "part", "sketch")
        dealt = dealt.repartition("sig", "row", "column").sortWithinPartitions("sig", "row", "column")
        labels = components(links.unionByName(checked(cut_lineage(dealt.mapInArrow(_tiles(largest), "a bigint, b bigint").distinct()))))

    nodes = classes.join(sizes.select("node", "n"), "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = cut_lineage(nodes.groupBy("component").agg(F.min("first").alias("component_id")))
    result = cut_lineage(nodes.join(firsts, "component").select("node", "n", "component_id"))
    return salt, rows.select("_id", "node").join(result, "node", "left").select(
        "_id", "node", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"))


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc id, n_shingles, component_id): one row per row of ``docs``."""
    return _similar(docs, doc_id, text)[1].select(F.col("_id").alias(doc_id), "n_shingles", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, whose id is the smallest of their component; of repeated rows, one."""
    salt, similar = _similar(docs, doc_id, text)
    first = similar.filter(F.col("_id").eqNullSafe(F.col("component_id")))
    keep = first.select(F.col("_id").alias("_cw_id"), F.col("node").alias("_cw_of"), F.xxhash64("_id", "node").alias("_cw_keep")).distinct()
    marked = docs.withColumn("_cw_node", _node(F.col(text), salt)).withColumn("_cw_key", F.xxhash64(doc_id, "_cw_node"))
    same = (F.col("_cw_key") == F.col("_cw_keep")) & F.col(doc_id).eqNullSafe(F.col("_cw_id")) & F.col("_cw_node").eqNullSafe(F.col("_cw_of"))
    rank = F.row_number().over(Window.partitionBy("_cw_key", doc_id, "_cw_node").orderBy("_cw_key"))
    return marked.join(keep, same, "left_semi").withColumn("_cw_rank", rank).filter("_cw_rank = 1").select(*docs.columns)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the size of its shingle set and its component."""
    return similar_documents(table(spark, sf_dir, "documents"))
