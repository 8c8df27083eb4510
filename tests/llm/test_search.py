"""Decontamination, whitening and ranked search against plain versions."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType

from chronoweave.llm import bidiagonal, decontamination, search, whitening

LONG, INT, TEXT = LongType(), IntegerType(), StringType()
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def by_sql(sql, **tables):
    base = duckdb.connect()
    for name, held in tables.items():
        base.register(name, held.toArrow())
    done = base.execute(sql)
    return [column[0] for column in done.description], done.fetchall()


# decontamination


def plain_hits(texts, items):
    """(n_words, n_hit, items) per text, window by window."""
    windows = {}
    for item, text in items:
        held = words(text)
        n = min(10, len(held))
        for i in range(len(held) - n + 1 if n else 0):
            windows.setdefault(tuple(held[i:i + n]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for text in texts:
        held, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(held) - n + 1):
                if of := windows.get(tuple(held[i:i + n])):
                    hit.update(range(i, i + n))
                    found |= of
        out.append((len(held), len(hit), sorted(str(i) for i in found if i is not None)))
    return out


def made_texts(rng, n, pool, passages, long=60):
    texts = []
    for _ in range(n):
        held = rng.choices(pool, k=rng.randrange(0, long))
        for passage in rng.sample(passages, rng.randrange(0, 3)):
            a = rng.randrange(0, max(1, len(passage)))
            at = rng.randrange(0, len(held) + 1)
            held[at:at] = passage[a:a + rng.randrange(1, 16)]
        texts.append(rng.choice([" ", ". ", "\n", "-"]).join(w.upper() if rng.random() < 0.1 else w for w in held))
    return texts


@pytest.fixture
def benchmark(frame):
    return lambda rows: frame([(i, text, 1, 2) for i, text in rows], ("item_id", LONG), ("text", TEXT), ("key", INT), ("h", INT))


def test_contaminated_words_match_windows(documents, benchmark):
    rng = random.Random(5)
    pool = ["a", "b", "c", "Éa", "éa", "İx", "straße", "x1", "漢字", "K"]
    passages = [rng.choices(pool, k=rng.randrange(1, 25)) for _ in range(12)]
    items = [(i, " ".join(p)) for i, p in enumerate(passages)] + [(100, None), (101, ""), (102, "--"), (3, " ".join(passages[4])), (None, "zz yy xx"), (7, " ".join(passages[7]))]
    texts = made_texts(rng, 150, pool, passages) + [None, "", "zz YY,xx zz", " ".join(passages[0]).upper(), " ".join(passages[0]).upper()]
    texts.append(" ".join(rng.choices(pool, k=30_000) + passages[1]))  # a very long one
    ids = [*range(len(texts) - 1), None]
    found = decontamination.contaminated_documents(documents(*zip(ids, texts)), benchmark(items)).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found), key=repr)
    assert got == sorted(((i, *rest) for i, rest in zip(ids, plain_hits(texts, items))), key=repr)
    assert sum(n > 0 for _, _, n, _ in got) > 20


def test_contamination_of_spans_and_empty_tables(documents, benchmark, folder, spark):
    passage = [f"w{i}" for i in range(12)]
    docs = [(1, " ".join(passage[:9])), (2, " ".join(passage[:10])), (2, " ".join(passage[1:11]) + " q"), (3, " ".join(["q", *passage, "q"])), (4, "")]
    path = folder(*docs, benchmark=benchmark([(9, " ".join(passage))]))
    out = {(r["doc_id"], r["n_words"]): (r["n_hit"], r["n_items"], r["contaminated"], r["items_sha256"]) for r in decontamination.op11_benchmark_decontamination(spark, path).collect()}
    none, nine = (hashlib.sha256(s).hexdigest() for s in (b"", b"9"))
    assert out == {(1, 9): (0, 0, False, none), (2, 10): (10, 1, True, nine), (2, 11): (10, 1, True, nine), (3, 14): (12, 1, True, nine), (4, 0): (0, 0, False, none)}
    names, rows = by_sql(decontamination.OP11_SQL, documents=documents(*docs), benchmark=benchmark([(9, " ".join(passage))]))
    want = decontamination.op11_benchmark_decontamination(spark, path)
    assert sorted(names) == sorted(want.columns) and sorted(map(repr, rows)) == sorted(repr(tuple(r[n] for n in names)) for r in want.collect())
    assert decontamination.contaminated_documents(documents(), benchmark([(1, "a b")])).count() == 0
    assert [tuple(r) for r in decontamination.contaminated_documents(documents((1, "a b")), benchmark([])).collect()] == [(1, 2, 0, [])]


def test_one_passage_in_all_documents_and_items(documents, benchmark):
    line = " ".join(f"l{i}" for i in range(10))
    docs = [(i, f"x{i} {line} y{i}") for i in range(300)] + [(1000 + i, line) for i in range(300)]
    items = [(i, f"{line} z{i} z{i + 1}") for i in range(50)]
    found = decontamination.contaminated_documents(documents(*docs), benchmark(items)).collect()
    assert len(found) == 600 and {(r["n_hit"], len(r["items"])) for r in found} == {(10, 50)}


# whitening


def plain_whitening(vectors, k=32):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    y = (n * x - s) / n
    values, directions = np.linalg.eigh(y.T @ y / n)
    values, directions = values[::-1], directions[:, ::-1]
    k = min(k, x.shape[1])
    return n, ((n * x - s) ** 2).sum(1), y @ directions[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


@pytest.mark.parametrize("dim", [1, 2, 5, 40])
def test_whitening_matches_eigenvectors(frame, dim):
    rng = np.random.default_rng(dim)
    vectors = (rng.standard_normal((400, dim)) * (1 + np.arange(dim))).astype(np.float32).tolist()
    bad = [None, [], [None] * dim, [float("nan")] * dim, [1.0] * (dim - 1) + [float("inf")], [1e300] * dim]
    rows = [(i, v, 3, "x", 1.0) for i, v in enumerate(vectors)] + [(1000 + i, v, 3, "x", 1.0) for i, v in enumerate(bad)]
    table = frame(rows, ("vec_id", LONG), ("embedding", ArrayType(DoubleType())), ("n", INT), ("_id", TEXT), ("v", DoubleType()))
    found = sorted(whitening.whitened_vectors(table.repartition(5)).collect(), key=lambda r: r["vec_id"])
    n, deviation, white, explained = plain_whitening(vectors)
    assert [r["vec_id"] for r in found] == list(range(400)) and {r["n"] for r in found} == {n}
    assert [r["deviation"] for r in found] == deviation.tolist()
    got = np.array([r["whitened"] for r in found])
    got *= np.sign((got * white).sum(0))
    assert np.abs(got - white).max() < 1e-9 and np.allclose(found[0]["explained"], explained, rtol=1e-12, atol=0)
    assert all(r["identity_error"] == found[0]["identity_error"] < 1e-10 for r in found)


def test_whitening_edges(frame):
    fields = ("vec_id", LONG), ("embedding", ArrayType(FloatType()))
    assert whitening.whitened_vectors(frame([], *fields)).count() == 0
    one = whitening.whitened_vectors(frame([(None, [0.5, -0.5])], *fields)).collect()
    assert [tuple(r) for r in one] == [(None, 1, 0, [None, None], [0.0, 0.0], 0.0)]
    # one dimension never varies, copies and other dimensions beside it
    rng = np.random.default_rng(0)
    rows = [(i % 40, [float(a), 0.25, float(b)]) for i, (a, b) in enumerate(rng.standard_normal((80, 2)))] + [(500 + i, [float(i)] * 2) for i in range(3)]
    found = whitening.whitened_vectors(frame(rows, *fields)).collect()
    assert len(found) == 83 and all(r["whitened"][2] is None and r["explained"][2] == 0 for r in found if r["vec_id"] < 500)
    assert all(r["n"] == 3 and r["whitened"][1] is None and r["explained"][0] == 1 for r in found if r["vec_id"] >= 500)
    assert max(r["identity_error"] for r in found) < 1e-12
    assert whitening.deviations(np.array([[2**33, 1], [3, 4]], object)) == [None, 25]


def test_triangles_fold_in_rounds(frame, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(9)
    vectors = rng.standard_normal((60, 4)).tolist()
    table = frame(list(enumerate(vectors)), ("vec_id", LONG), ("embedding", ArrayType(DoubleType()))).repartition(9)
    fit = whitening.fit_whitening(table)[4]
    assert np.allclose(fit.explained, plain_whitening(vectors)[3], rtol=1e-12) and fit.n == 60


def test_whitening_query_has_a_row_per_component(frame, folder, spark):
    rng = np.random.default_rng(3)
    table = frame([(i, v) for i, v in enumerate(rng.standard_normal((50, 40)).tolist())], ("vec_id", LONG), ("embedding", ArrayType(FloatType())))
    out = whitening.op12_embedding_whitening(spark, folder(embeddings=table))
    assert out.count() == 50 * 32 and {r["component"] for r in out.collect()} == set(range(1, 33))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def orthogonal(rng, n):
    return np.linalg.qr(rng.standard_normal((n, n)))[0]


@pytest.mark.parametrize("kind", ["random", "equal", "close", "graded", "deficient", "zero"])
def test_bidiagonal_solver(kind):
    rng = np.random.default_rng(1)
    n = 30
    values = {"random": rng.random(n) + 0.1, "equal": np.repeat([3.0, 2.0, 1.0], 10), "close": 1 + 1e-9 * np.arange(n), "graded": 10.0 ** -np.arange(n),
              "deficient": np.r_[np.ones(5), np.zeros(25)], "zero": np.zeros(n)}[kind]
    matrix = orthogonal(rng, n) * values @ orthogonal(rng, n)
    squares, directions = bidiagonal.right_singular(matrix)
    want = np.linalg.svd(matrix, compute_uv=False) ** 2
    assert np.abs(squares - want).max() <= 1e-13 * max(want[0], 1e-300)
    live = squares > bidiagonal.NOISE**2 * max(want[0], 1e-300)
    held = directions[:, live]
    assert np.abs(held.T @ held - np.eye(held.shape[1])).max(initial=0) < 1e-11
    assert np.abs(matrix.T @ (matrix @ held) - held * squares[live]).max(initial=0) <= 1e-13 * max(want[0], 1e-300)


def test_small_singular_values_keep_their_digits():
    diagonal, above = 10.0 ** -np.arange(20), 0.5 * 10.0 ** -np.arange(19)
    found = bidiagonal.squared_singular_values(diagonal, above)
    # scaled copies have the same leading digits: the ratio to the product of the diagonal is exact in every position
    assert math.isclose(math.prod(found), math.prod(diagonal * diagonal), rel_tol=1e-12)
    assert np.all(found > 0) and found[-1] < 1e-37


# search


def plain_search(docs, items, top=10):
    counted = [(i, words(text)) for i, text in docs]
    counted = [(i, w) for i, w in counted if w]
    n, total = len(counted), sum(len(w) for _, w in counted)
    df = {}
    for _, w in counted:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for i, w in counted:
            m = 10 + 90 * len(w) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in set(words(text)) & set(w))
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(sorted(scored)[:top], 1)]
    return out


def search_rows(documents, benchmark, docs, items):
    found = search.search(search.build_index(documents(*docs).repartition(3)), benchmark(items)).collect()
    return sorted(map(tuple, found), key=repr)


@pytest.mark.parametrize("limits", [(search.BLOCK_BYTES, search.BLOCK_TEXTS, 256, 16), (300, 7, 2, 1)])
def test_search_matches_all_scores(documents, benchmark, monkeypatch, limits):
    for name, value in zip(("BLOCK_BYTES", "BLOCK_TEXTS", "QUERIES", "HELD"), limits):
        monkeypatch.setattr(search, name, value)
    rng = random.Random(8)
    pool = [f"t{i}" for i in range(60)] + ["Éa", "éa", "漢字", "Zz"]
    docs = [(i, " ".join(rng.choices(pool, weights=range(1, 65), k=rng.randrange(0, 40)))) for i in range(150)]
    docs += [(1000 - i, "t1 t2 t3") for i in range(30)] + [(None, "t1 t2 t3"), (5000, None), (5001, ""), (7, "T1-t2"), (7, "T1-t2"), (None, "t4 t4")]
    items = [(i, " ".join(rng.choices(pool, k=rng.randrange(0, 12)))) for i in range(12)] + [(20, "t1 t2 t3"), (20, "t1 t2 t3"), (21, None), (22, "nothing there"), (23, "éa"), (None, "t4")]
    assert search_rows(documents, benchmark, docs, items) == sorted(plain_search(docs, items), key=repr)


def test_search_of_long_texts_and_empty_tables(documents, benchmark):
    rng = random.Random(2)
    docs = [(1, " ".join(f"w{rng.randrange(20_000)}" for _ in range(60_000)) + " rare"), (2, "rare w1"), (3, "w2 w3 w1")]
    items = [(1, "rare w1 w2 w19999"), (2, "w5")]
    assert search_rows(documents, benchmark, docs, items) == sorted(plain_search(docs, items), key=repr)
    assert search_rows(documents, benchmark, [], items) == [] == search_rows(documents, benchmark, docs, [])


def test_bounds_are_no_less_than_scores():
    rng = np.random.default_rng(4)
    texts = {" ".join(f"w{i}" for i in rng.integers(0, 400, rng.integers(1, 120))).encode(): [k] for k in range(80)}
    import pyarrow as pa

    row = {name: column[0].as_py() for name, column in zip(*(lambda b: (b.schema.names, b.columns))(search._block(texts, pa.int64())))}
    block = search.Block(row, 80, 5000)
    terms = [f"w{i}".encode() for i in rng.choice(400, 20, replace=False)]
    weights = rng.integers(1, 9000, 20)
    import zlib

    of, bound = block.bounds(np.array([zlib.crc32(t) for t in terms], np.int64), weights.astype(float))
    known = [(block.numbers[t], w) for t, w in zip(terms, weights) if t in block.numbers]
    exact = block.scores(of, *(np.array([k[i] for k in known]) for i in (0, 1)))
    assert np.all(bound >= exact) and np.any(bound == exact) and len(of) == 80


def test_search_query_matches_sql(documents, benchmark, folder, spark):
    docs = [(i, f"alpha beta w{i % 7} w{i % 3} {'gamma ' * (i % 4)}") for i in range(40)]
    items = [(1, "alpha gamma"), (2, "w1 W2"), (3, None)]
    out = search.op13_ranked_lexical_search(spark, folder(*docs, benchmark=benchmark(items)))
    names, rows = by_sql(search.OP13_SQL, documents=documents(*docs), benchmark=benchmark(items))
    assert sorted(names) == sorted(out.columns) and sorted(map(repr, rows)) == sorted(repr(tuple(r[n] for n in names)) for r in out.collect())
