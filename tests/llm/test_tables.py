"""Packing, archives, page extraction, the Jaccard join, vectors and the pipeline on small fixtures."""

import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StringType

from chronoweave.llm import components, embeddings, extraction, jaccard, packing, warc
from chronoweave.session import cut_lineage, shared_folder

LONG, INT, TEXT = LongType(), IntegerType(), StringType()
tokenizers = pytest.importorskip("public_tokenizers")


# packing


def check_plan(histogram, capacity=1024):
    plan = packing.best_plan(histogram, capacity)
    held, seen = defaultdict(list), Counter()
    for length, begin, end, first, offset, each in plan.places:
        assert begin == seen[length]
        seen[length] = end
        for rank in range(begin, end):
            held[first + (rank - begin) // each].append((offset + (rank - begin) % each * length, length))
    assert seen == Counter({length: n for length, n in histogram.items() if n})
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(held) == list(range(plan.sequences))
    return plan.sequences


def test_plans_are_whole_and_tight():
    rng = np.random.default_rng(1)
    for n in (0, 1, 50, 4000):
        lengths = np.clip(rng.lognormal(6, 1, n).astype(int), 1, 1024)
        histogram = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}
        least = -(-int(lengths.sum()) // 1024)
        assert least <= check_plan(histogram) <= least + max(2, n // 500)
    assert check_plan({513: 10, 511: 3}) == 10 and check_plan({1024: 5, 1: 3}) == 6 and check_plan({400: 8, 600: 4, 24: 4}) <= 7
    assert check_plan({5: 3, 4: 3}, 9) == 3


def test_configurations_stay_within_counts():
    chosen = packing.configurations([700, 500, 300], [10, 9, 40], 1024)
    for k, count in enumerate([10, 9, 40]):
        assert sum(pattern[k] * times for pattern, times in chosen) <= count
    assert all(sum(n * s for n, s in zip(pattern, [700, 500, 300])) <= 1024 for pattern, _ in chosen)


def odd_texts(rng, count=60):
    """Characters that only newer Unicode versions know, odd white space and strings of special tokens."""
    signs = ["\ua7d2", "\ua7d3", "\u1c89", "\U00010d40", "\u2003", "\x1c", "\x85", "a", "é", "1", " ", "'s", "!", "\n", "<|endoftext|>"]
    return ["".join(rng.choices(signs, k=rng.randint(1, 30))) for _ in range(count)]


def test_packing_matches_tokenizer(spark, folder):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    texts = [None, "", "<|endoftext|>", "a <|endoftext|>b <|endoftext|> c", *odd_texts(rng), "a  b\n\n c", "é🎉 it's", "one two three " * 900] + [" ".join(rng.choices(["the", "xq", "zu9", "\n"], k=rng.randint(1, 700))) for _ in range(60)]
    rows = packing.op2_best_fit_packing(spark, folder(*enumerate(texts), (0, None), (None, "x"))).collect()
    ids = {i: tokenizer.encode(text or "", add_special_tokens=False).ids + [2] for i, text in [*enumerate(texts), (None, "x")]}
    want = Counter()
    for i, held in [*ids.items(), (0, ids[0])]:
        n, first = len(held), len(held) % 1024 or 1024
        starts = [0, *range(first, n, 1024)]
        for piece, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
            want[i, piece, a, b - a, zlib.crc32(np.array(held[a:b], "<u4").tobytes())] += 1
    assert Counter(tuple(row)[:5] for row in rows) == want
    places = defaultdict(list)
    for row in rows:
        places[row["sequence_id"]].append((row["offset"], row["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.op2_best_fit_packing(spark, folder()).count() == 0


# archives


def test_ids_of_parts_are_those_of_whole_texts():
    """White space of all kinds beside spaces, characters of other classes, and more parts than are kept."""
    from tokenizers import Tokenizer

    from chronoweave.llm.tokens import PartLookup

    path = tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(19)
    signs = [" "] * 6 + ["\n", "\t", "a", "é", "'s", "'", "1", "!", "中", "x'll", " \n", "  ", "\u0301", "\ua7cb", "\u1c89", "\u180e", "\x1c", "\x85", "\xa0", "\u3000", "b" * 70]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + ["", " ", "a <|endoftext|> b"]
    packing._LOOKUPS.clear()
    held = packing._lookup(path, tokenizers.PATTERN)
    looked = [cell.cell_contents for cell in held.__closure__ if isinstance(cell.cell_contents, PartLookup)]
    assert len(looked) == 1
    looked[0].parts.size = 50
    whole = [np.array(found.ids, "<u4").tobytes() for found in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    try:
        for _ in range(2):
            assert [ids for at in range(0, len(texts), 100) for ids in held(texts[at:at + 100])] == whole
    finally:
        packing._LOOKUPS.clear()


def pages_of(frame, rows):
    return frame([(*row, "x", 1) for row in rows], ("page_id", LONG), ("url", TEXT), ("html", TEXT), ("_digest", TEXT), ("record_type", INT))


def test_archives_round_trip(spark, frame):
    long, short = "<p>é " * 40, "<p>" * 5
    rows = [(5, "http://a/é b", long), (3, None, long), (9, "u", long), (1, "v", short), (2, "w", short), (4, "x\r\ny", None), (6, "z", ""), (None, "n", long),
            (7, "t", "page " * 200_000), (3, "again", long), (8, "only", "q" * 100), (None, "m", "r" * 200)]
    marked = warc.mark_revisits(pages_of(frame, rows))
    archives = warc.write_archives(marked, f"{shared_folder(spark)}/warc-test")
    got = warc.read_archives(archives).collect()
    assert archives.agg(F.sum("n_records")).first()[0] == len(got) == len(rows)
    want = Counter()
    for page, _, html in rows:
        body = (html or "").encode()
        first = 3 if html == long and page != 3 else None
        want[page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if first else "response", first] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert all(bytes(r["payload"]) == next((h or "").encode() for p, _, h in rows if p == r["page_id"] and (p or h == "r" * 200)) for r in got if r["record_type"] == "response")
    assert warc.read_archives(warc.write_archives(warc.mark_revisits(pages_of(frame, [])), f"{shared_folder(spark)}/warc-none")).count() == 0


def test_reader_finds_damage(tmp_path):
    digest = hashlib.sha256(b"abc").hexdigest()
    good = warc.record("1", "http://u", b"abc", digest, None, "2020-01-01T00:00:00Z")
    assert warc.parse(good)[2] == b"abc"
    for bad in (good.replace(b"\r\n\r\nabc", b"\r\n\r\nabd"), good[:-1], good + b"x", good.replace(b"WARC/1.1", b"HTTP/1.1")):
        with pytest.raises(ValueError):
            warc.parse(bad)
    path = tmp_path / "a.warc.gz"
    path.write_bytes(warc._member(good) * 3)
    with open(path, "rb") as stream:
        assert list(warc.inflate(stream)) == [good] * 3
    path.write_bytes((warc._member(good) * 3)[:-4])
    with open(path, "rb") as stream, pytest.raises(ValueError):
        list(warc.inflate(stream))


# page extraction


def test_extraction_of_layouts(spark, frame, tmp_path):
    words = "There was a long way to go, and nobody knew the end of it. " * 4
    article = f"<article><h1>Title &amp; more</h1><p>One\n  two&nbsp;<b>three</b>{words}</p><p><b>Four &lt;5&gt;<br><p>{words}</article>"
    rows = [
        (1, f"<html><head><title>T</title><script>var t='</p>';</script><style>p{{}}</style></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
            f"<div class=\"ad\">Buy now.</div>{article}<footer>&copy; 2020 Me</footer></body></html>"),
        (2, f"<body><div id='menu'><a href=1>x</a> | <a href=2>y</a></div><div class='post-content'><p>{words}</p><div class='advert'>Buy</div><p>{words}</p></div>"
            f"<div class='comments'><p>{words}</p></div><div class='sidebar'><p>Read this</p></div>"),
        (3, None), (4, ""), (None, "<nav><a href=x>y</a></nav>"), (5, "<div>" * 3000 + words), (6, "<<p>>&#x41;&bogus; < & </p"),
    ]
    table = frame([(i, None, html, "x") for i, html in rows] + [(3, "u", None, "x")], ("page_id", LONG), ("url", TEXT), ("html", TEXT), ("blocks", TEXT))
    table.write.parquet(f"{tmp_path}/pages.parquet")
    got = extraction.op7_html_extraction(spark, str(tmp_path)).collect()
    texts = {row["page_id"]: row["text"] for row in got}
    flat = " ".join(words.split())
    assert len(got) == 8 and all(row["n_chars"] == len(row["text"]) for row in got)
    assert texts[1] == f"Title & more\nOne two three{flat}\nFour <5>\n{flat}"
    assert texts[2] == f"{flat}\n{flat}"
    assert texts[3] == texts[4] == texts[None] == ""


def test_broken_markup_hides_nothing_else():
    texts = lambda html: [*extraction.parse(html).text.values()]
    assert texts("<p>Formula <math><mi>x</mi></math> end</p>") == ["Formula x end"]
    for control in ("button", "textarea", "select"):
        assert texts(f"<div><p>one <{control}>Share</p><p>two</p></div>three") == ["one", "two", "three"]
        assert texts(f"<article><{control}>Share<p>one</p><p>two</p></article>") == ["one", "two"]
    assert texts("<div>a<button><div>b</div></button>c</div>") == ["a c".replace(" ", "")]
    assert texts("<template><p>no</p></template><object><p>yes</p></object>") == ["yes"]
    assert texts("<p>one</p><!-- <p>two</p> three") == ["one"]
    assert texts("<script>if (a</b>) x</script><p>a<b>b</i>c</b> d") == ["abc d"]
    assert texts("<div><p>a<a href=x>b</p>c</a></div>") == ["ab", "c"]


@pytest.mark.parametrize("opened, closed", [("<div>", "</p>"), ("<b>", "</i>"), ("<ul>", "<p>"), ("<i><b>", "</i>"), ("<button>", "</select>"), ("<p><div><ul>", "<li>")])
def test_very_long_pages_of_open_tags(opened, closed):
    n = 1_000_000 // len(opened + closed)
    start = time.process_time()
    tree = extraction.parse(opened * n + closed * n + "</button>the end")
    assert time.process_time() - start < 30 and " ".join(tree.text.values()) == "the end"


def test_extraction_on_pages_it_was_not_trained_on():
    model, right = extraction.trained(), 0
    pages = extraction.sample_pages(100, 99)
    for page, found in zip(pages, extraction.extract(pages, model)):
        tree = extraction.parse(page)
        right += found == [text for node, text in tree.text.items() if tree.label[node] == "1"]
    assert right >= 88


def test_decoding_is_consistent_and_best():
    rng = np.random.default_rng(5)
    for _ in range(40):
        parent = [-1, *(int(rng.integers(0, k)) for k in range(1, 9))]
        score = rng.normal(0, 2, 9)
        holds = extraction.decode(parent, score)

        def value(labels):
            return sum(-np.logaddexp(0, -s if y else s) for s, y in zip(score[1:], labels[1:]))

        valid = [labels for labels in ([True, *(bool(bits >> k & 1) for k in range(8))] for bits in range(256)) if all(labels[parent[k]] or not labels[k] for k in range(1, 9))]
        assert list(holds) in valid and value(holds) == pytest.approx(max(map(value, valid)))


# Jaccard join


def brute_components(texts):
    sets = {}
    for i, text in texts.items():
        words = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(words[j:j + 5]) for j in range(max(1, len(words) - 4))) if words else frozenset()
    label = {i: i for i in texts}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                ra, rb = root(a), root(b)
                label[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in texts}


def corpus(rng):
    """Copies, chains of near copies, shared passages, short and long texts; sizes on both sides of the bands' ends."""
    word = lambda: "".join(rng.choices("etaoinshrd", k=rng.randint(2, 7)))
    texts = ["", " \n", "a", "A", "one two three", "One  TWO\tthree", "é É", "x y z w v u"]
    passage = [word() for _ in range(60)]
    base = [word() for _ in range(150)]
    for _ in range(40):  # near copies of one text, more than a group
        changed = list(base)
        for _ in range(rng.randint(0, 4)):
            changed[rng.randrange(150)] = word()
        texts.append(" ".join(changed))
    texts += [" ".join(base)] * 25
    texts += [" ".join([word() for _ in range(rng.randint(0, 60))] + passage + [word() for _ in range(rng.randint(0, 30))]) for _ in range(40)]
    chain = [word() for _ in range(300)]
    for i in range(12):  # each like the next, the ends not alike
        texts.append(" ".join(chain[8 * i:8 * i + 180]))
    for size in (250, 262, 340, 350, 1000, 1040):
        held = [word() for _ in range(size)]
        texts += [" ".join(held), " ".join(held[:int(size * 0.8)]), " ".join(held[:int(size * 0.7)])]
    return texts


def test_jaccard_join_equals_all_pairs(spark, documents):
    rng = random.Random(11)
    texts = corpus(rng)
    order = list(range(len(texts)))
    rng.shuffle(order)
    held = {order[k]: text for k, text in enumerate(texts)}
    held[1000] = None
    docs = documents(*held.items(), (order[5], texts[5]), (None, texts[-1]))
    got = jaccard.similar_documents(docs).collect()
    want = brute_components(held)
    assert len(got) == len(held) + 2
    assert {row["doc_id"]: (row["n_shingles"], row["component_id"]) for row in got if row["doc_id"] is not None} == want
    assert [row["component_id"] for row in got if row["doc_id"] is None] == [want[order[len(texts) - 1]][1]]
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter(row["doc_id"] for row in kept.collect()) == Counter(i for i, (_, label) in want.items() if i == label)


def test_jaccard_join_of_shared_wording(spark, documents, monkeypatch):
    """Edits that many members of a group share, so that no shingle is rare, in tiles of a few texts; and a line that texts have in common."""
    monkeypatch.setattr(jaccard, "TILE", 8)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    edited = []
    for _ in range(260):
        words = list(base)
        for at in rng.sample(range(2, 58, 4), rng.randint(1, 6)):
            words[at] = f"x{at}"
        edited.append(" ".join(words))
    line = " ".join(f"l{i}" for i in range(15))
    lines = [f"{line} own{i} other{i} third{i}" for i in range(120)] + [f"{line} tail{i}" for i in range(20)]
    long = [" ".join(f"w{j}" for j in range(5000)) + f" end{i}" for i in range(3)]
    texts = edited + lines + long
    tiles, calls = jaccard._tiles, []
    monkeypatch.setattr(jaccard, "_tiles", lambda largest: calls.append(largest) or tiles(largest))
    got = {row["doc_id"]: (row["n_shingles"], row["component_id"]) for row in jaccard.similar_documents(documents(*enumerate(texts))).collect()}
    assert calls and got == brute_components(dict(enumerate(texts)))


def test_jaccard_line_in_common_makes_no_candidates(spark, documents, monkeypatch):
    """Texts of one common line and three words of their own are all unlike: none is read again, whatever their number."""
    line = " ".join(f"l{i}" for i in range(15))
    docs = documents(*((i, f"{line} own{i} other{i} third{i}") for i in range(5000)))
    written = []
    real = jaccard.cut_lineage
    monkeypatch.setattr(jaccard, "cut_lineage", lambda frame: written.append(real(frame)) or written[-1])
    assert jaccard.similar_documents(docs).filter("doc_id <> component_id").count() == 0
    assert all(frame.count() == 0 for frame in written if frame.columns == ["a", "b"])


def test_jaccard_passage_is_looked_into_once(spark, documents, monkeypatch):
    """All shingles of a passage have the same texts: each text looks for partners under one of them, not under several."""
    passage = " ".join(f"p{i}" for i in range(30))
    short = [f"{passage} own{i} other{i} third{i}" for i in range(40)]
    longer = [" ".join([passage, *(f"l{i}x{j}" for j in range(20))]) for i in range(40)]
    written = []
    real = jaccard.cut_lineage
    monkeypatch.setattr(jaccard, "cut_lineage", lambda frame: written.append(real(frame)) or written[-1])
    texts = dict(enumerate(short + longer))
    got = {row["doc_id"]: (row["n_shingles"], row["component_id"]) for row in jaccard.similar_documents(documents(*texts.items())).collect()}
    assert got == brute_components(texts)
    parted, looking = (frame for frame in written if frame.columns == ["sig", "node", "n", "part"])
    assert looking.count() == looking.select("node").distinct().count() == len(short)


def test_sketches_rule_out_most_pairs_that_are_not_similar():
    rng = np.random.default_rng(6)
    for size in (60, 300, 3000):
        full = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        for differing in (0.22, 0.3, 1):  # of each; a seventh is what similar sets may have
            other = np.concatenate([full[int(differing * size):], rng.integers(0, 2**63, int(differing * size)).astype(np.uint64)])
            assert 7 * jaccard.differ_at_least(jaccard.sketch(full), jaccard.sketch(other)) > len(full) + len(other)


def test_bounds_of_tables_are_those_of_pairs():
    rng = np.random.default_rng(8)
    for sizes in ((100, 100), (100, 400), (400, 100), (5000, 5000)):
        one = jaccard.sketch(rng.integers(0, 2**63, sizes[0]).astype(np.uint64))
        others = [jaccard.sketch(rng.integers(0, 2**63, sizes[1]).astype(np.uint64)) for _ in range(5)] + [bytes([255]) * len(jaccard.sketch(np.arange(sizes[1], dtype=np.uint64)))]
        table = np.frombuffer(b"".join(others), np.uint8).reshape(len(others), -1)
        assert jaccard._bounds(one, table).tolist() == [jaccard.differ_at_least(one, other) for other in others]


def test_sets_of_many_texts_are_those_of_each():
    rng = random.Random(17)
    signs = ["a", "B", "c", "é", " ", " ", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "x y z ", "\0", "İ"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))).encode() for _ in range(500)] + [b"", b" ", b"\xff A \x80 b c d e"]
    known = jaccard.WordHashes()
    found = list(jaccard.sets(texts, known))
    assert [held.tolist() for held in found] == [jaccard.shingles(text.lower().split(), known).tolist() for text in texts]
    assert list(jaccard.sets([], known)) == []
    for size in (0, 1, 5, 200, 256, 300, 1500, 9000):
        held = np.sort(np.random.default_rng(size).integers(0, 2**63, size).astype(np.uint64))
        assert jaccard._share(held) == jaccard.signatures(held)[1]


def test_words_are_hashed_once_per_distinct_word_of_a_batch():
    looked = []

    class Counting(jaccard.WordHashes):
        def __getitem__(self, word):
            looked.append(word)
            return super().__getitem__(word)

    assert [len(held) for held in jaccard.sets([b"a b c d e f " * 500] * 3, Counting())] == [6, 6, 6]
    assert sorted(looked) == sorted(set(looked)) and set(looked) - {b""} == set(b"a b c d e f".split())


def test_jaccard_empty_table(spark, documents):
    assert jaccard.similar_documents(documents()).count() == 0 and jaccard.one_of_each(documents()).count() == 0


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(3)
    for _ in range(300):
        size = int(rng.choice([1, 2, 3, 5, 20, 100, 250, 256, 260, 340, 700, 1024, 1100, 3000]))
        full = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        drop = int(rng.integers(0, size // 7 + 1))
        add = int(rng.integers(0, size // 7 + 1))
        other = np.unique(np.concatenate([full[drop:], rng.integers(0, 2**63, add).astype(np.uint64)]))
        both = len(np.intersect1d(full, other))
        if both and 100 * both >= 75 * (len(full) + len(other) - both):
            (a, need_a), (b, need_b) = jaccard.signatures(full), jaccard.signatures(other)
            assert len(np.intersect1d(a, b)) >= min(need_a, need_b) > 0
        assert jaccard.differ_at_least(jaccard.sketch(full), jaccard.sketch(other)) <= len(full) + len(other) - 2 * both


def test_components_of_paths_and_hubs(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(200, 260)] + [(300, 301), (301, 300), (7, 7)]
    got = {row["node"]: row["component"] for row in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, **{k: 100 for k in range(200, 260)}, 300: 300, 301: 300}


# vectors


def test_vectors_match_brute_force(spark, frame):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(30, 16))
    vectors = [base[k % 30] + rng.normal(scale=rng.choice([0.0, 0.05, 0.2]), size=16) for k in range(200)]
    rows = [(k, [float(np.float32(x)) for x in v], int(k % 3)) for k, v in enumerate(vectors)]
    rows += [(500, rows[0][1], 0), (501, rows[0][1], 1), (502, rows[0][1], None), (503, None, 0), (504, [0.0] * 16, 0), (505, [float("nan")] + [1.0] * 15, 0),
             (506, [float("inf")] + [1.0] * 15, 0), (507, [], 0), (508, [2 * x for x in rows[0][1]], 0), (509, rows[0][1][:15], 0), (0, rows[0][1], 0),
             (None, rows[0][1], 0), (510, [None, *rows[0][1][1:]], 0), (511, [3e38] * 16, 2), (512, [1e-38] * 16, 2)]
    table = frame([(*row, 1.0, "x") for row in rows], ("vec_id", LONG), ("embedding", ArrayType(FloatType())), ("label", INT), ("n_links", FloatType()), ("v", TEXT))
    usable = [row[1] is not None and len(row[1]) > 0 and all(x is not None and np.isfinite(np.float32(x)) for x in row[1]) and any(row[1]) and row[2] is not None for row in rows]
    links, label = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if usable[i] and usable[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = (np.float32(rows[k][1]).astype(float) for k in (i, j))
                if x / np.abs(x).max() @ (y / np.abs(y).max()) / np.linalg.norm(x / np.abs(x).max()) / np.linalg.norm(y / np.abs(y).max()) >= 0.98:
                    links[i] += 1
                    links[j] += 1
                    label[root(i)] = root(j)
    least = defaultdict(list)
    for k, row in enumerate(rows):
        if row[0] is not None:
            least[root(k)].append(row[0])
    want = Counter((row[0], links[k], min(least[root(k)], default=None)) for k, row in enumerate(rows))
    assert Counter(tuple(row) for row in embeddings.similar_vectors(table).collect()) == want
    assert embeddings.similar_vectors(table.limit(0)).count() == 0


def test_quantisation_bound_holds(monkeypatch):
    rng = np.random.default_rng(8)
    units = embeddings.unit(rng.normal(size=(300, 24)))
    q, s, d = embeddings.quantised(units)
    near = (q.astype(float) @ q.astype(float).T) * s[:, None] * s[None, :]
    bound = d[:, None] + d[None, :] + d[:, None] * d[None, :]
    assert (np.abs(units @ units.T - near) <= bound + 1e-12).all()
    x, y = embeddings.linked(units, units, 0.5)
    assert {(i, j) for i, j in zip(x.tolist(), y.tolist())} == set(zip(*(a.tolist() for a in np.nonzero(units @ units.T >= 0.5))))


# pipeline


def test_pipeline_stages(spark, frame, folder):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("etaoinshr", k=rng.randint(2, 8)))
    clean = [" ".join(word() for _ in range(60)) for _ in range(150)]
    toxic = [" ".join([word() for _ in range(50)] + ["grumbex", "zubblex"] * 3) for _ in range(60)]
    texts = [*clean, *toxic, clean[0], clean[1] + " more", "short", None, "", "same line of eight words is here again " * 9]
    labels = frame([(i, int(150 <= i < 210)) for i in range(200)], ("doc_id", LONG), ("toxic", INT))
    path = folder(*enumerate(texts), labels=labels)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    left = []
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = cut_lineage(stage(spark, held, path))
        assert held.columns == docs.columns, name
        left.append({row["doc_id"] for row in held.collect()})
    assert left[0] == set(range(212)) and left[1] == set(range(150)) | {210, 211} and left[2] == set(range(150))
    packed = corpus_pipeline.run(spark, path)
    assert {row["doc_id"] for row in packed.collect()} == left[2]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "n-gram Jaccard join", "best-fit packing"]


def test_registered_queries_match_their_sql(spark):
    import os

    from oracle_check import compare, duck

    from chronoweave.llm.queries import ORACLES, QUERIES

    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("driver tables not present")
    connection = duck(path)
    for name in ("op6_warc", "op7_html_extraction", "op9_embedding_near_dedup", "op10_quality_rules"):
        assert compare(spark, connection, path, QUERIES[name], ORACLES[name]) is None, name
