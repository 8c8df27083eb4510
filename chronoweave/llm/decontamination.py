"""Benchmark decontamination by winnowing, in built-in functions only.

A text's fingerprints are hashes of runs of ``GRAM`` words: of any ``SPAN - GRAM + 1`` neighbouring runs the one of least hash
is kept (all of equal least). A span of ``SPAN`` words that a document shares with a benchmark item therefore keeps the same run
in both, whatever surrounds it, so joining the fingerprints finds every such span. Each hit is extended word by word, on both
sides and as far as one span can reach; it counts if the common stretch is a span. Longer stretches are found span by span.
Items shorter than a span are one run of their own length, looked for at every place.

Only (text key, place, hash) rows leave the scan of the documents, and of these only the ones whose hash an item has; the
optimizer broadcasts the items' hashes if the written table is small and sorts and merges otherwise. Words are looked at again
only in texts with such a row. Equal texts are one text until the result. Items that share a stretch share one row of it, so a
passage of many items and many documents is verified once per text.

Case: A-Z only count as a-z. Hashes are taken of fully lower-cased words, which is quicker and can only bring in hits that the
word by word check then drops; positions of words are the same either way.

Defined results: a null or empty text has no words, no hits and the digest of no items; an item without words occurs nowhere; a
null item id is not listed, though its words are hit; repeated items count once, repeated documents get a row each; an empty table
of items leaves all documents clean, an empty table of documents gives an empty result; further columns are left alone. Texts are
told apart by two 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm.text import bound, table
from chronoweave.session import cut_lineage

#: Words of a window, and of a fingerprint's run.
SPAN, GRAM = 10, 7
#: Words by which a hit is extended to either side.
REACH = SPAN - GRAM
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _split(text: Column) -> Column:
    return F.array_remove(F.split(text, BETWEEN_WORDS), "")


def hash_words(text: Column) -> Column:
    """Words with every letter in lower case."""
    return _split(F.lower(text))


def exact_words(text: Column) -> Column:
    """Words with A-Z in lower case."""
    return _split(F.translate(text, UPPER, UPPER.lower()))


def text_key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("x"), F.xxhash64(F.lit(1), text).alias("y"))


def runs(words: Column, length: int) -> Column:
    """Hashes of all runs of ``length`` words; ``words`` must be bound."""
    made = F.transform(words, lambda word, i: F.xxhash64(word, *[F.get(words, i + j) for j in range(1, length)]))
    return F.slice(made, F.lit(1), F.greatest(F.size(words) - (length - 1), F.lit(0)))


def winnowed(words: Column, span: int = SPAN, length: int = GRAM) -> Column:
    """(p, h) of the runs that are least among some ``span - length + 1`` neighbours, a struct each."""
    width = span - length + 1
    if width == 1:
        return bound(words, lambda w: F.transform(runs(w, length), lambda h, p: F.struct(p.alias("p"), h.alias("h"))))

    def chosen(held: Column) -> Column:
        least = F.transform(held, lambda h, i: F.least(h, *[F.get(held, i + j) for j in range(1, width)]))
        least = F.slice(least, F.lit(1), F.greatest(F.size(held) - (width - 1), F.lit(0)))
        # each window's least is at most what it covers, so a run is chosen if the greatest of its windows' leasts is its own hash
        return bound(least, lambda m: F.filter(
            F.transform(held, lambda h, p: F.when(h == F.greatest(*[F.get(m, p - j) for j in range(width)]), F.struct(p.alias("p"), h.alias("h")))),
            lambda kept: kept.isNotNull()))

    return bound(F.transform(words, lambda word: F.xxhash64(word)), lambda w: bound(runs(w, length), chosen))


def _short(words: Column, length: int) -> Column:
    return bound(F.transform(words, lambda word: F.xxhash64(word)), lambda w: winnowed(w, length, length))


def _around(words: Column, place: Column, outside: str) -> Column:
    """``SPAN + REACH`` words from ``REACH`` before ``place``; ``outside`` stands for those that the text does not have."""
    at = F.sequence(place - REACH, place + (SPAN - 1))
    return F.transform(at, lambda i: F.coalesce(F.get(words, i), F.lit(outside)))


def item_stretches(items: DataFrame, item_id: str, text: str) -> tuple[DataFrame, DataFrame, list[int]]:
    """(stretch, h, length, around) of distinct stretches, (stretch, item id), and the lengths of items below a span."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = items.select(F.col(item_id).alias("_item"), hash_words(body).alias("_low"), exact_words(body).alias("_words"))
    rows = cut_lineage(rows.filter(F.size("_words") > 0).distinct())
    short = sorted(r[0] for r in rows.select(F.least(F.size("_words"), F.lit(SPAN))).distinct().collect() if r[0] < SPAN)
    size = F.size("_words")
    found = F.when(size >= SPAN, F.transform(winnowed(F.col("_low")), lambda s: F.struct(s["p"], s["h"], F.lit(GRAM).alias("n"))))
    for length in short:
        found = found.when(size == length, F.transform(_short(F.col("_low"), length), lambda s, n=length: F.struct(s["p"], s["h"], F.lit(n).alias("n"))))
    each = rows.select("_item", "_words", F.explode(found).alias("s"))
    # what stands around an item below a span does not matter
    around = F.when(F.size("_words") >= SPAN, _around(F.col("_words"), F.col("s.p"), " ")).otherwise(F.transform(_around(F.col("_words"), F.col("s.p"), " "), lambda w, i: F.when(i < REACH, " ").otherwise(w)))
    each = cut_lineage(each.select("_item", F.col("s.h").alias("h"), F.when(F.size("_words") >= SPAN, F.lit(GRAM)).otherwise(F.size("_words")).alias("length"),
                                   (F.size("_words") < SPAN).alias("whole"), around.alias("around")))
    stretches = cut_lineage(each.select("h", "length", "whole", "around").distinct().withColumn("stretch", F.monotonically_increasing_id()))
    return stretches, cut_lineage(each.join(stretches, ["h", "length", "whole", "around"]).select("stretch", "_item").distinct()), short


def _extended(found: DataFrame) -> DataFrame:
    """(key, stretch, begin, end) of hits (key, p, mine, around, length, whole, stretch) that hold a span."""
    mine, theirs = F.col("mine"), F.col("around")

    def agree(places: list[int]) -> Column:
        """How many of ``places``, one after another, hold the same word."""
        count = F
        for n, i in enumerate(places):
            count = count.when(mine[i] != theirs[i], n)
        return count.otherwise(len(places))

    left = F.when(F.col("whole"), 0).otherwise(agree([*range(REACH)][::-1]))
    right = F.when(F.col("whole"), 0).otherwise(agree([*range(SPAN, SPAN + REACH)]))
    same = F.slice(mine, F.lit(REACH + 1), F.col("length")) == F.slice(theirs, F.lit(REACH + 1), F.col("length"))
    hits = found.filter(same).select("key", "stretch", "p", "length", "whole", left.alias("left"), right.alias("right"))
    return hits.filter(F.col("whole") | (F.col("left") + F.col("right") >= REACH)).select(
        "key", "stretch", (F.col("p") - F.col("left")).alias("begin"), (F.col("p") + F.col("length") + F.col("right")).alias("end"))


def _covered(spans: Column) -> Column:
    """Words within the spans (begin, end), each counted once."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda held, s: F.struct(
        (held["n"] + F.greatest(s["end"] - F.greatest(s["begin"], held["end"]), F.lit(0))).alias("n"), F.greatest(held["end"], s["end"]).alias("end"))
    return F.aggregate(F.sort_array(spans), start, step)["n"].cast("long")


def shared_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, n_words) of all texts, (key, begin, end) of their words within shared spans, and (key, item id) of the items found.

    ``key`` is the ``text_key`` of a document's text, null taken as empty.
    """
    stretches, listed, short = item_stretches(items, item_id, item_text)
    body = F.coalesce(F.col(doc_text), F.lit(""))

    def printed(words: Column) -> Column:
        # the first entry, with a negative place, carries the number of words through the one scan
        count = F.array(F.struct((-1 - F.size(words)).alias("p"), F.lit(0).cast("long").alias("h")))
        return F.concat(count, winnowed(words), *[_short(words, length) for length in short])

    each = docs.select(text_key(body).alias("key"), F.explode(bound(hash_words(body), printed)).alias("s")).select("key", "s.p", "s.h")
    wanted = cut_lineage(stretches.select("h", F.lit(True).alias("wanted")).distinct())
    prints = cut_lineage(each.join(wanted, "h", "left").filter("wanted OR p < 0").select("key", "p", "h").distinct())
    sizes = prints.filter("p < 0").select("key", (-1 - F.col("p")).cast("long").alias("n_words"))
    held = cut_lineage(prints.filter("p >= 0").groupBy("key").agg(F.collect_list(F.struct("p", "h")).alias("prints")))  # of one text
    # one document stands for all copies of its text; texts are dealt by key and id, so no group of copies comes together
    rows = docs.select(text_key(body).alias("key"), F.col(doc_id).alias("id"), body.alias("body"))
    firsts = cut_lineage(rows.select("key", "id").join(held.select("key"), "key", "left_semi").groupBy("key").agg(F.min("id").alias("first")))
    one = firsts.withColumnRenamed("key", "of").hint("merge")  # the same plan for few and many such texts
    texts = rows.join(one, (F.col("key") == F.col("of")) & F.col("id").eqNullSafe(F.col("first")), "left_semi").groupBy("key").agg(F.first("body").alias("body"))
    shown = F.transform("prints", lambda s: F.struct(s["p"].alias("p"), s["h"].alias("h"), _around(F.col("words"), s["p"], "").alias("mine")))
    placed = texts.select("key", exact_words(F.col("body")).alias("words")).join(held, "key").select("key", F.explode(shown).alias("s"))
    hits = cut_lineage(_extended(placed.select("key", "s.*").join(stretches, "h")))
    return sizes, hits.select("key", "begin", "end").distinct(), hits.select("key", "stretch").distinct().join(listed, "stretch").select("key", F.col("_item").alias(item_id)).distinct()


def contaminated_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc id, n_words, n_hit, items): one row per row of ``docs``; ``items`` are the ids found, sorted as strings."""
    sizes, spans, found = shared_spans(docs, items, doc_id, text, item_id, item_text)
    words = spans.groupBy("key").agg(_covered(F.collect_list(F.struct("begin", "end"))).alias("n_hit"))
    listed = found.groupBy("key").agg(F.sort_array(F.collect_set(F.col(item_id).cast("string"))).alias("items"))
    result = cut_lineage(sizes.join(words, "key", "left").join(listed, "key", "left"))
    rows = docs.select(F.col(doc_id), text_key(F.coalesce(F.col(text), F.lit(""))).alias("_key"))
    return rows.join(result.withColumnRenamed("key", "_key"), "_key", "left").select(
        doc_id, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in windows of benchmark items, and a digest of those items."""
    found = contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


OP11_SQL = r"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT row_number() OVER () AS r, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, p, p + least(len(w), 10) - 1), ' ') AS g
         FROM items, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(p) WHERE len(w) > 0),
places AS (SELECT r, p, s.n, array_to_string(list_slice(w, p, p + s.n - 1), ' ') AS g FROM words, (SELECT DISTINCT n FROM wins) s, unnest(range(1, len(w) - s.n + 2)) AS u(p)),
hits AS (SELECT DISTINCT r, p, l.n, item_id FROM places l JOIN wins USING (n, g)),
hit AS (SELECT r, count(DISTINCT p + k) AS n_hit FROM hits, unnest(range(0, n)) AS u(k) GROUP BY r),
found AS (SELECT r, array_to_string(list_sort(list(i)), ',') AS ids, count(*) AS n_items FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (r) LEFT JOIN found USING (r)
"""
