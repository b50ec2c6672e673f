"""Whitening, collocations and substring dedup against brute force, and their edge cases."""

import random
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainlake.llm import collocations, double_array, queries, secret_scan, substring_dedup, whitening

VECTORS = "vec_id long, embedding array<double>, x array<long>, n string, id int"


def whitened(spark, vectors, **options):
    rows = [(i, v, [1], "n", 7) for i, v in enumerate(vectors)]
    found = whitening.whiten(spark.createDataFrame(rows, VECTORS), **options).collect()
    return {r.vec_id: r for r in found}


def expected(vectors, components):
    x = np.floor(64 * np.array(vectors)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(0)
    e, v = np.linalg.eigh(centred.T @ centred / len(fit))
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    deviation = [sum((len(fit) * int(a) - int(s)) ** 2 for a, s in zip(row, fit.sum(0))) for row in x]
    return len(fit), (x - fit.mean(0)) @ v / np.sqrt(e), e / np.trace(centred.T @ centred / len(fit)), deviation


def test_whitening_equals_an_eigensolver(spark):
    rng = np.random.default_rng(1)
    base = (rng.standard_normal((60, 9)) * np.arange(1, 10)).tolist()
    vectors = base + base[:5] + [base[0]] * 200
    found = whitened(spark, vectors, components=4)
    n, coordinates, explained, deviation = expected(vectors, 4)
    got = np.array([found[i].whitened for i in range(len(vectors))])
    assert {r.n for r in found.values()} == {n} == {60}
    assert np.abs(got * np.sign((got * coordinates).sum(0)) - coordinates).max() < 1e-9
    assert np.allclose(found[0].explained, explained, rtol=1e-9)
    assert [found[i].deviation for i in range(len(vectors))] == deviation
    assert found[0].identity_error < 1e-9


def test_whitening_of_equal_and_missing_deviations(spark):
    # The corners of a cube: all three values are equal, and the fourth dimension is constant.
    corners = [[float(a), float(b), float(c), 5.0] for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    found = whitened(spark, corners)
    assert {len(r.whitened) for r in found.values()} == {3}
    assert np.allclose(found[0].explained, [1 / 3] * 3) and found[0].identity_error < 1e-9
    assert not whitened(spark, [[1.0, 2.0]] * 4) and not whitened(spark, [])


def test_more_equal_values_than_a_sequence_meets(spark):
    # Twelve equal large values among forty dimensions: one Krylov sequence alone would give one of them.
    spokes = [[(3.0 if i < 12 else 1.0) * s if i == j else 0.0 for j in range(40)] for i in range(40) for s in (-1, 1)]
    found = whitened(spark, spokes, components=12)
    assert np.allclose(found[0].explained, [9 / (12 * 9 + 28)] * 12) and found[0].identity_error < 1e-8


def test_whitening_leaves_out_what_is_no_vector(spark):
    good = [[0.0, 1.0], [1.0, 0.0], [2.0, 5.0]]
    bad = [None, [], [1.0, None], [float("nan"), 1.0], [1.0, float("inf")], [1e300, 0.0], [1.0], [1.0, 2.0, 3.0]]
    assert sorted(whitened(spark, good + bad)) == [0, 1, 2]


def test_double_array_finds_exactly_its_phrases():
    rng = np.random.default_rng(2)
    for highest, words in ((3, 2), (700, 3), (70_000, 4)):
        codes = (rng.zipf(1.3, 20_000) % (highest + 1)).astype(np.int32)
        windows = np.lib.stride_tricks.sliding_window_view(codes, words)
        windows = np.unique(windows[(windows > 0).all(1)], axis=0)
        chosen = windows[rng.random(len(windows)) < 0.5]
        number = {tuple(p): i for i, p in enumerate(chosen.tolist())}
        got = double_array.build(chosen, highest).walk(codes)
        want = [number.get(tuple(codes[i : i + words].tolist()), -1) for i in range(len(codes))]
        assert got.tolist() == want


@pytest.mark.parametrize("options", [{"max_words": 10}, {"max_phrases": 40}], ids=["joined words", "several tries"])
def test_collocations_do_not_depend_on_bounds(spark, sf_dir, options):
    docs = queries.table(spark, sf_dir, "documents")
    want = collocations.collocations(docs).collect()
    assert want and sorted(collocations.collocations(docs, **options).collect()) == sorted(want)


def test_a_tally_holds_a_bounded_number_of_keys():
    rng = np.random.default_rng(1)
    tracemalloc.start()
    tally, sums = collocations.Tally(), 0
    for _ in range(20):
        tally.add(rng.integers(0, 2**40, 400_000))
        if tally.full():
            sums += sum(np.frombuffer(c, np.int64).sum() for b in tally.blocks(4) for c in b.column("counts").to_pylist())
    sums += sum(np.frombuffer(c, np.int64).sum() for b in tally.blocks(4) for c in b.column("counts").to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sums == 20 * 400_000 and peak < 150_000_000


def test_collocations_of_a_few_texts(spark):
    rows = [("Big\tApple, big apple! big", "en")] * 15 + [("x y", None), (None, "en"), ("", "fr"), ("a\x0bb  c", "und")]
    docs = spark.createDataFrame(rows, "text string, lang string").withColumns({"code": F.lit(1), "word": F.lit(2), "n": F.lit(3)})
    assert [tuple(r) for r in collocations.collocations(docs).collect()] == [("en", 1, "big apple", 30, 45, 30, 75, 800_000)]
    tied = collocations.collocations(docs, least=1).filter("lang = 'und'").orderBy("rank").collect()
    assert [(r.rank, r.phrase, r.score) for r in tied] == [(1, "b  c", 1_000_000), (2, "x y", 1_000_000)]
    assert collocations.collocations(docs.limit(0)).count() == 0


def passages(docs, words):
    """(id, words, removed, kept text) of each row, by sets."""
    cut = [(d, (t or "").encode().split()) for d, t in docs]
    spots = {}
    for d, w in cut:
        for p in range(len(w) - words + 1):
            if d is not None:
                key = tuple(w[p : p + words])
                spots[key] = min(spots.get(key, d), d)
    out = []
    for d, w in cut:
        gone = set()
        for p in range(len(w) - words + 1):
            least = spots.get(tuple(w[p : p + words]))
            if least is not None and (d is None or least < d):
                gone.update(range(p, p + words))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("words", [1, 2, 3, 5, 8, 50])
@pytest.mark.parametrize("ids", ["long", "string"])
def test_passages_equal_brute_force(spark, words, ids):
    rnd = random.Random(words)
    docs = []
    for _ in range(60):
        d = rnd.choice([None, *range(1, 30)])
        text = "".join(rnd.choice(["a", "b ", " c", "\t", "\n", " ", "\u0085 "]) for _ in range(rnd.randrange(60)))
        docs.append((d if d is None or ids == "long" else f"{d:03}", text))
    docs += [docs[0], (docs[1][0], None), docs[2]]
    if words == 50:
        common = " ".join(str(rnd.random()) for _ in range(70))
        docs = [(d, f"{t} {common} {'z ' * i}") for i, (d, t) in enumerate(docs)]
    table = spark.createDataFrame(docs, f"doc_id {ids}, text string").withColumns(
        {"id": F.lit(1), "key": F.lit(2), "runs": F.lit("r"), "row": F.lit(3), "__id": F.lit(4)}
    )
    found = substring_dedup.remove(table, words=words)
    assert found.columns == [*table.columns, "n_words", "n_removed"]
    rows = found.collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.text) for r in rows], key=repr) == passages(docs, words)
    assert {(r.id, r.key, r.runs, r.row, r["__id"]) for r in rows} == {(1, 2, "r", 3, 4)}


def test_periodic_and_long_texts_and_no_texts(spark):
    long = "la " * 300_000
    docs = spark.createDataFrame([(1, long), (2, "la " * 60), (3, "la " * 49), (4, "x " + "la " * 55)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove(docs).collect()}
    assert got == {1: (300_000, 0), 2: (60, 60), 3: (49, 0), 4: (56, 55)}
    assert substring_dedup.remove(docs.limit(0)).count() == 0


def test_assigned_literals_take_time_in_proportion():
    def seconds(n):
        text = "".join(f'password = "hunter{i}xx"; my_secret_key{i} = {i}\n' for i in range(n))
        start = time.perf_counter()
        assert secret_scan.spans(text)
        return time.perf_counter() - start

    seconds(200)
    assert seconds(20_000) < 25 * seconds(2_000) + 1
