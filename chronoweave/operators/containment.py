"""Which needles occur verbatim in which texts, without comparing every pair.

A needle that occurs in a text brings its inner words along as whole words: only its
first and last word may be cut by the text around it. So a run of inner words is an
anchor. Texts and needles meet in an equi-join on anchors, and only those pairs are
checked with ``contains``. Per needle the rarest of its runs is the anchor, so a run
of common words does not blow up the join. Needles too short to have an inner word
have no anchor; they are matched by all their character windows of one length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.session import cut_lineage

RUN = 3
WINDOW = 4


def _words(text: Column) -> Column:
    return F.split(F.trim(text), r"\s+")


def _runs(items: Column, length: int) -> Column:
    """Hashes of all runs of ``length`` neighbouring items; empty when there are too few.

    The items are hashed once, then the array is zipped with itself, shifted by one place
    per item of the run, so a text is walked a fixed number of times however long it is.
    The lambda over a one-element array binds the hashes, else they would be built again
    for every shift.
    """

    def chained(hashes: Column) -> Column:
        runs = hashes
        for shift in range(1, length):
            rest = F.slice(hashes, F.lit(shift + 1), F.greatest(F.size(hashes) - shift, F.lit(0)))
            runs = F.zip_with(runs, rest, lambda left, right: F.when(right.isNotNull(), F.xxhash64(left, right)))
        return F.array_distinct(F.array_compact(runs))

    return F.transform(F.array(F.transform(items, lambda item: F.xxhash64(item))), chained)[0]


def _windows(text: Column, length: int) -> Column:
    """Hashes of all character windows."""
    return _runs(F.split(text, ""), length)


def _inner(words: Column) -> Column:
    """The words without the first and last one."""
    return F.when(F.size(words) > 2, F.slice(words, F.lit(2), F.size(words) - 2)).otherwise(F.array().cast("array<string>"))


def _anchored(texts: DataFrame, text_id: str, anchors: DataFrame, hashes: Column) -> DataFrame:
    """(text id, anchor) pairs where the text holds the anchor; each pair once per text."""
    held = texts.select(text_id, F.explode(hashes).alias("_anchor"))
    return held.join(anchors.select("_anchor").distinct(), "_anchor", "left_semi")


def _pairs(texts: DataFrame, text_id: str, needle_id: str, options: DataFrame, hashes: Column) -> DataFrame:
    """Candidate pairs through the rarest anchor of each needle.

    ``options`` has one row per needle and possible anchor. The held anchors are written
    once, because both the frequency count and the final join read them.
    """
    held = cut_lineage(_anchored(texts, text_id, options, hashes))
    frequency = held.groupBy("_anchor").agg(F.count(F.lit(1)).alias("_df"))
    # An anchor held by no text means the needle occurs nowhere; zero is then the rarest.
    rated = options.join(frequency, "_anchor", "left").withColumn("_df", F.coalesce("_df", F.lit(0)))
    chosen = rated.groupBy(needle_id).agg(F.min_by("_anchor", F.struct("_df", "_anchor")).alias("_anchor"))
    return held.join(chosen, "_anchor").select(text_id, needle_id).distinct()


def contained(texts: DataFrame, text_id: str, text: str, needles: DataFrame, needle_id: str, needle: str, *, scope: str | None = None) -> DataFrame:
    """Pairs (text id, needle id) where the text contains the needle exactly. Empty needles match nothing.

    With ``scope`` (a column of both tables, e.g. the filing) a needle is looked up only in
    texts of its own scope. Needle ids must be unique over all scopes.
    """
    area = [] if scope is None else [scope]
    texts = texts.select(text_id, text, *area)
    usable = needles.filter(F.col(needle).isNotNull() & (F.col(needle) != ""))
    parts = usable.select(needle_id, *area, F.col(needle).alias("_needle"), _inner(_words(F.col(needle))).alias("_inner"))

    def scoped(hashes: Column) -> Column:
        return hashes if scope is None else F.transform(hashes, lambda item: F.xxhash64(F.col(scope), item))

    def found(chosen: DataFrame, needle_hashes: Column, text_hashes: Column) -> DataFrame:
        options = chosen.select(needle_id, F.explode(scoped(needle_hashes)).alias("_anchor"))
        return _pairs(texts, text_id, needle_id, options, scoped(text_hashes))

    words = _words(F.col(text))
    inner, size = F.col("_inner"), F.length("_needle")
    pairs = found(parts.filter(F.size(inner) >= RUN), _runs(inner, RUN), _runs(words, RUN))
    medium = parts.filter((F.size(inner) > 0) & (F.size(inner) < RUN))
    if not medium.isEmpty():
        pairs = pairs.unionByName(found(medium, _runs(inner, 1), _runs(words, 1)))
    # Needles without an inner word: windows of up to WINDOW characters; at most WINDOW lengths exist.
    bare = parts.filter(F.size(inner) <= 0).withColumn("_width", F.least(size, F.lit(WINDOW)))
    for width in sorted(row[0] for row in bare.select("_width").distinct().collect()):
        same = bare.filter(F.col("_width") == width)
        pairs = pairs.unionByName(found(same, _windows(F.col("_needle"), width), _windows(F.col(text), width)))
    checked = pairs.join(usable.select(needle_id, F.col(needle).alias("_needle")), needle_id).join(
        texts.select(text_id, F.col(text).alias("_text")), text_id)
    return checked.filter(F.contains("_text", "_needle")).select(text_id, needle_id)


def quotes_in_pages(quotes: DataFrame, pages: DataFrame, *, keys: list[str], quote: str = "evidence_quote", text: str = "text") -> DataFrame:
    """Quotes with ``found``: the whitespace-normalised page of the same key contains the quote."""
    def plain(name: str) -> Column:
        return F.trim(F.regexp_replace(name, r"\s+", " "))

    normal = pages.select(*keys, plain(text).alias("_page"))
    return quotes.join(normal, keys, "left").withColumn("found", F.coalesce(F.contains("_page", quote), F.lit(False))).drop("_page")
