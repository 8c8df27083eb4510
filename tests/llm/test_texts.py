"""License scan, quality rules, byte-level BPE, toxicity and language-model scores on small fixtures."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql.types import IntegerType, LongType

from chronoweave.llm import bpe, licenses, lm, quality, toxicity
from chronoweave.llm.text import letter_words

LONG, INT = LongType(), IntegerType()
MIT = (
    "Copyright (c) 2020 Some One Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, '
    "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject "
    "to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)


def by_id(df):
    return {row["doc_id"]: row for row in df.collect()}


# license scan


def test_license_places_and_labels(spark, folder):
    path = folder((1, "Released under the MIT License. mit license"), (2, "x cc by cc by"), (3, None), (4, ""), (5, "The MIT-licence"), (5, "Apache License"),
                  (None, "gnu general public license"), (6, "é1 MIT LICENSE 中文"), (7, "word " * 30_000 + "apache license"))
    rows = licenses.op1_license_scan(spark, path).collect()
    held = {row["doc_id"]: row for row in rows if row["doc_id"] not in (5,)}
    assert len(rows) == 9
    assert (held[1]["n_words"], held[1]["n_base"], held[1]["first_word"], held[1]["last_word"], held[1]["base_labels"]) == (7, 2, 3, 5, "mit")
    assert held[1]["labels"] == "mit,mit-notice" and held[1]["score"] == 1.0
    assert (held[2]["n_base"], held[2]["first_word"], held[2]["last_word"], held[2]["base_labels"]) == (2, 1, 3, "cc-by")
    for empty in (3, 4):
        assert (held[empty]["n_words"], held[empty]["n_base"], held[empty]["first_word"], held[empty]["labels"], held[empty]["score"]) == (0, 0, None, "", 0.0)
    assert held[None]["base_labels"] == "gpl" and held[6]["first_word"] == 1 and held[6]["n_words"] == 4
    assert held[7]["first_word"] == 30_000 and held[7]["score"] == 0.5
    assert sorted(row["n_base"] for row in rows if row["doc_id"] == 5) == [0, 1]


def test_license_templates():
    full = licenses.compile_template(licenses.TEMPLATES["mit-text"])
    words = letter_words(("before it " + MIT + " after").encode())
    (start, length), = full.places(words)
    assert words[start] == b"copyright" and start == 2 and words[start + length - 1] == b"software"
    changed = [b"deny" if word == b"publish" else word for word in words]
    assert full.places(changed) == []  # mandatory wording must match exactly
    bare = words[words.index(b"permission"):]
    assert [at for at, _ in full.places(bare)] == [0]  # the optional notice may be missing
    made = licenses.compile_template('a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> <<var;match="[0-9]+";least="1";most="2">> d')
    for text, length in ((b"a 1 d", 3), (b"a b 1 2 d", 5), (b"a b c 7 d", 5), (b"a c 1 d", 0), (b"a d", 0), (b"a 1 2 3 d", 0), (b"a x d", 0)):
        assert made.longest(text.split(), 0) == length, text
    for wrong in ('<<var;match=".*";least="0";most="3">>', "a <<beginOptional>> b", "a <<endOptional>>"):
        with pytest.raises(ValueError):
            licenses.compile_template(wrong)


def test_license_empty_table(spark, folder):
    assert licenses.op1_license_scan(spark, folder()).count() == 0


# quality rules


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(8)}
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeats += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(covered)


TEXTS = [None, "", "  \n\t", "a", "one two three four five six seven eight\n" * 3, " x  y", "x\x0by\x0cz\r\n" * 9, "a b " * 30, "é#*$ " * 25, "SHOUT " * 40,
         " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i % 11}" for i in range(50)), "\n".join(["same line here"] * 4 + [" ", " "]), "long " * 20_000,
         " ".join(f"w{i}" for i in range(20)) + " " + " ".join(f"w{i}" for i in range(5, 17)), "🎉 emoji text 中文 " * 8]


def test_quality_measures_match_brute_force(spark, folder):
    rows = by_id(quality.op10_quality_rules(spark, folder(*enumerate(TEXTS), (0, None))))
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        row, want = rows[i], plain_measures(text)
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == want, (i, text and text[:40])
        assert row["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (row["base_failed"] and row["kept"])
    assert rows[10]["kept"] and not rows[9]["kept"]


def test_quality_order_changes_no_verdict(spark, documents):
    docs = documents(*enumerate(TEXTS), (3, "a"))
    kept = sorted(row["doc_id"] for row in quality.kept_documents(docs).collect())
    turned = sorted(row["doc_id"] for row in quality.kept_documents(docs, rules=tuple(reversed(quality.RULES))).collect())
    assert kept == turned and 10 in kept and quality.kept_documents(docs).columns == docs.columns
    assert sorted(rule.name for rule in quality.rule_order(docs)) == sorted(rule.name for rule in quality.RULES)


def test_quality_empty_table(spark, folder, documents):
    assert quality.op10_quality_rules(spark, folder()).count() == 0 and quality.kept_documents(documents()).count() == 0


def test_quality_runs_no_python(spark, folder):
    plan = quality.op10_quality_rules(spark, folder((1, "a b")))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# byte-level BPE

tokenizers = pytest.importorskip("public_tokenizers")


def test_bpe_equals_tiktoken(spark, folder):
    import tiktoken

    ranks = bpe.read_ranks(tokenizers.path("byte_bpe_50k.tiktoken"))
    coding = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = [None, "", " ", "a  b\n\n c\t", "It's the IT'S <|endoftext|>", "x" * 3000, "ab" * 400, "日本語 ñandú 🎉🎉", "\x1c\x85　 ", "word " * 20_000]
    texts += ["".join(rng.choice("ab \n\t'sIt12.é中 \r") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    signs = ["\ua7d2", "\ua7d3", "\u1c89", "\U00010d40", "\u2003", "\x1c", "\x85", "a", "é", "1", " ", "'s", "!", "\n", "<|endoftext|>"]
    texts += ["".join(rng.choices(signs, k=rng.randint(1, 30))) for _ in range(60)]
    rows = bpe.op5_bpe(spark, folder(*enumerate(texts), (0, None))).collect()
    assert len(rows) == len(texts) + 1
    for row in rows:
        text = texts[row["doc_id"]] or ""
        ids = coding.encode_ordinary(text)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), text[:40]
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.op5_bpe(spark, folder()).count() == 0


def test_bpe_query_and_heap_agree():
    coder = bpe.Coder(tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(4)
    words = ["".join(rng.choice("etaoin he") for _ in range(rng.randint(1, 80))).encode() for _ in range(200)] + [bytes([200, 201]), b"aaaa" * 100]
    assert coder.code(words) == [coder._by_heap(word) for word in words]


def test_bpe_decodes_from_ids_not_from_the_text():
    """A wrong id must show in the decoded bytes."""
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    coder = bpe.Coder(path)
    coder.base.execute("UPDATE vocabulary SET digits = '21' WHERE bytes = 'a'::BLOB")
    assert coder.code([b"a"]) == [(f" {coder.ranks[b'a']}", b"!")]


def test_memo_forgets_without_changing_results():
    from chronoweave.llm.tokens import Lookup

    lookup = Lookup(tokenizers.PATTERN, lambda words: [w.upper() for w in words], "")
    lookup.words.size = 3
    for _ in range(3):
        assert lookup.of(["a b c d", "e a", "", "a  b"]) == ["A B C D", "E A", "", "A  B"]


def test_bpe_of_much_text_beyond_ascii_takes_little_time():
    """The whole look-up of ``op5_bpe``; looking for odd characters in these texts alone took 8 s."""
    import time

    lookup = bpe._lookup(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    texts = ["été où ça " * 1000] * 100
    lookup.values(texts[:1])
    began = time.process_time()
    found = lookup.values(texts)
    assert time.process_time() - began < 4
    assert all(b"".join(word[1] for word in coded).decode() == text for coded, text in zip(found, texts))


def test_looking_for_odd_characters_takes_little_time():
    """A class of 17 thousand characters, tried one by one, took 8 s for a million."""
    import time

    from chronoweave.llm.tokens import Lookup, stand_ins

    lookup = Lookup(tokenizers.PATTERN, list, [], stand_ins(bpe._library_matches))
    odd = chr(min(lookup.odd))
    text = "é" * 1_000_000
    began = time.process_time()
    assert lookup.cut(text) == [text]
    assert time.process_time() - began < 3
    assert "".join(lookup.cut(f"{text} {odd}a")) == f"{text} {odd}a"
    assert time.process_time() - began < 6


# toxicity


def toxic_corpus(frame, folder):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(240):
        words = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 8))) for _ in range(60)]
        bad = i % 3 == 0
        if bad:
            for _ in range(rng.randint(2, 6)):
                words[rng.randrange(60)] = rng.choice(["grumbex", "grumbexing", "zubble", "Zubble!"])
        rows.append((i, " ".join(words)))
        if i < 180:
            labels.append((i, int(bad), 1))
    rows += [(900, None), (901, ""), (902, "grumbex zubble " * 20_000), (None, "plain words only")]
    labels += [(None, 1, 1), (5, None, 0), (9999, 1, 0), (3, 0, 1)]
    return folder(*rows, labels=frame(labels, ("doc_id", LONG), ("toxic", INT), ("text", INT)))


def test_toxicity_learns_and_orders(spark, frame, folder):
    path = toxic_corpus(frame, folder)
    rows = by_id(toxicity.op3_toxicity(spark, path))
    assert len(rows) == 244
    unseen = [rows[i] for i in range(180, 240)]
    assert sum(row["toxic"] == (row["doc_id"] % 3 == 0) for row in unseen) >= 57
    assert all(0 <= row["expected_severity"] <= 3 for row in rows.values())
    assert not rows[900]["toxic"] and not rows[901]["toxic"] and not rows[None]["toxic"] and rows[902]["toxic"] and rows[902]["severity"] == 3
    docs = spark.read.parquet(f"{path}/documents.parquet")
    clean = toxicity.clean_documents(docs, spark.read.parquet(f"{path}/labels.parquet"))
    assert clean.columns == docs.columns and {row["doc_id"] for row in clean.collect()} == {i for i, row in rows.items() if not row["toxic"]}


def test_toxicity_without_labels(spark, frame, folder):
    path = folder((1, "a b c"), (1, "a b c"), labels=frame([], ("doc_id", LONG), ("toxic", INT)))
    assert [row["expected_severity"] for row in toxicity.op3_toxicity(spark, path).collect()] == [0.0, 0.0]
    empty = folder(labels=frame([], ("doc_id", LONG), ("toxic", INT)))
    assert toxicity.op3_toxicity(spark, empty).count() == 0


def test_ordinal_fit_shares_weights():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 5, 600)
    grades = np.clip(x - 1, 0, 3)
    weights, thresholds = toxicity.fit([np.zeros(1, int) if k else np.zeros(0, int) for k in x], [np.array([float(k)] if k else []) for k in x], grades, 1)
    assert (np.diff(thresholds) > 0).all() and weights[0] > 0
    model = toxicity.Model({"w": 0}, weights, thresholds)
    values = [model.expected({0: k} if k else {}) for k in range(6)]
    assert values == sorted(values)


# language model


def test_lm_matches_plain_counts(spark, frame, folder):
    texts = {1: "a b a b c", 2: "a b c d e f", 3: "b c b c b c", 4: "x y z", 5: "", 6: None, 7: "a B, a-b"}
    labels = frame([(1, 1, 0), (7, 1, 0), (3, 0, 0), (4, 1, 1), (None, 1, 0)], ("doc_id", LONG), ("quality", INT), ("toxic", INT))
    rows = by_id(lm.op4_lm_scoring(spark, folder(*texts.items(), (None, "a b"), labels=labels)))
    words = {i: letter_words((text or "").encode()) for i, text in [*texts.items(), (None, "a b")]}
    pairs = lambda held: list(zip([None, *held], held))
    background, target = Counter(p for held in words.values() for p in pairs(held)), Counter(p for i in (1, 7) for p in pairs(words[i]))
    size = len({w for held in words.values() for w in held}) + 2

    def loss(seen, scale, held):
        single, first = Counter(), Counter()
        for (_, w), n in seen.items():
            single[w] += n
        for (v, w), n in seen.items():
            first[v] += n
        total = sum(single.values())
        prior = lambda w: (single[w] * scale + lm.ALPHA / size) / (total * scale + lm.ALPHA)
        return np.mean([-np.log((seen[p] * scale + lm.MU * prior(p[1])) / (first[p[0]] * scale + lm.MU)) for p in pairs(held)])

    scale = sum(target.values()) / sum(background.values())
    for i, held in words.items():
        if not held:
            assert rows[i]["n_tokens"] == 0 and rows[i]["score"] is None
            continue
        want = loss(target, 1.0, held), loss(background, scale, held)
        assert rows[i]["target_loss"] == pytest.approx(want[0]) and rows[i]["background_loss"] == pytest.approx(want[1])
        assert rows[i]["score"] == pytest.approx(want[0] - want[1])


def test_lm_without_target(spark, frame, folder):
    labels = frame([], ("doc_id", LONG), ("quality", INT), ("toxic", INT))
    assert [row["score"] for row in lm.op4_lm_scoring(spark, folder((1, "a b"), labels=labels)).collect()] == [None]
    assert lm.op4_lm_scoring(spark, folder(labels=labels)).count() == 0


def test_lm_counts_every_word_and_bigram(spark, frame, folder, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 5_000)
    monkeypatch.setattr(lm, "BUCKET", 5_000)
    many = {i: " ".join(f"w{(i * 7919 + j * 31) % 20_011}" for j in range(300)) for i in range(1, 101)}  # more words than 16,382 may hold
    texts = {**many, 101: "a b a b c", 102: "a b c rare a", 103: "", 104: None, 105: "a B, a-b"}
    labels = frame([(101, 1, 0), (105, 1, 0), (105, 1, 0), (5, 1, 0), (102, 0, 0), (7, 1, 1), (None, 1, 0)], ("doc_id", LONG), ("quality", INT), ("toxic", INT))
    every = [*texts.items(), (None, "a b"), (101, "c c")]
    rows = lm.op4_lm_scoring(spark, folder(*every, labels=labels)).collect()
    words = [(i, letter_words((text or "").encode())) for i, text in every]
    pairs = lambda held: list(zip([None, *held], held))
    size = len({w for _, held in words for w in held}) + 2
    assert size > 16_384

    def model(chosen):
        seen, single, first = (Counter(x) for x in ([p for h in chosen for p in pairs(h)], [w for h in chosen for w in h], [v for h in chosen for v, _ in pairs(h)]))
        return seen, single, first, sum(single.values())

    target, background = model([h for i, h in words if i in (101, 105, 5)]), model([h for _, h in words])

    def loss(held, scale, seen, single, first, total):
        prior = lambda w: (single[w] * scale + lm.ALPHA / size) / (total * scale + lm.ALPHA)
        return np.mean([-np.log((seen[p] * scale + lm.MU * prior(p[1])) / (first[p[0]] * scale + lm.MU)) for p in pairs(held)])

    got = sorted(((r["doc_id"] or 0, r["n_tokens"], r["target_loss"] or 0.0, r["background_loss"] or 0.0, r["score"]) for r in rows), key=lambda r: r[:2])
    want = []
    for i, held in words:
        two = (loss(held, 1.0, *target), loss(held, target[3] / background[3], *background)) if held else (0.0, 0.0)
        want.append((i or 0, len(held), *two, two[0] - two[1] if held else None))
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want, key=lambda r: r[:2])):
        assert a[:2] == b[:2] and a[2:4] == pytest.approx(b[2:4]) and a[4] == (None if b[4] is None else pytest.approx(b[4]))
