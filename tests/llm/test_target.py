"""Whitening, decontamination and resampling against brute force on small odd tables."""

import hashlib
import math
import random
import re
import zlib
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.llm import decontamination, resampling, whitening
from terrafold.llm.queries import QUERIES
from terrafold.session import settle

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def prose(seed, n, vocabulary=300):
    rng = random.Random(seed)
    return " ".join(f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n))


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    def save(rows, schema):
        path = str(tmp_path_factory.mktemp("t") / "t")
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return save


LONG = prose(7, 30_000, 5000)
ODD = [(1, None), (2, ""), (3, " \n\t-- "), (4, "one"), (5, "One two"), (6, "one two"), (6, "one two"), (None, prose(1, 80)), (None, prose(2, 30)), (None, None), (7, prose(1, 80)), (7, prose(3, 80)), (8, LONG), (9, LONG + " end"), (10, "é日本 x-y \x1f word\x85next É")]
DOCS = "doc_id long, text string, score double, rank string, n int, key string, k string, words long"


def table(saved, rows):
    return saved([(i, t, 1.0, "x", 1, "x", "x", 1) for i, t in rows], DOCS)


# -- op 11 ----------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, x string, n long, component int"


def vectors(saved, rows):
    return saved([(i, v, "x", 1, 1) for i, v in rows], VECTORS)


def brute_whitened(rows, width):
    kept = [(i, [math.floor(64 * float(np.float32(c))) for c in v] + [0] * (width - len(v))) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(x[j] for x in fit) for j in range(width)]
    c = np.array([[(n * x[j] - sums[j]) / n for j in range(width)] for x in fit])
    covariance = c.T @ c / n
    values, columns = np.linalg.eigh(covariance)
    return kept, n, sums, covariance, values[::-1], columns[:, ::-1]


def test_whitening(saved):
    rng = np.random.default_rng(5)
    mixed = rng.normal(size=(400, 20)) @ rng.normal(size=(20, 20)) * np.linspace(0.1, 3, 20) + 5
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(mixed)]
    rows += [(0, rows[0][1]), (500, rows[1][1]), (None, rows[2][1])] + [(501 + i, rows[3][1]) for i in range(200)]
    rows += [(900, None), (901, [None] + [1.0] * 19), (902, [math.nan] * 20), (903, [math.inf] * 20), (904, [1.0] * 5), (905, [])]
    out = whitening.whitened(vectors(saved, rows)).collect()
    kept, n, sums, covariance, values, columns = brute_whitened(rows, 20)
    assert len(out) == 16 * len(kept) and {r.n for r in out} == {n}
    assert {r.vec_id for r in out} == {i for i, _ in kept}
    by_id = {}
    for r in out:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    signs = {}
    for i, x in kept:
        away = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        for k in range(16):
            r = by_id[i][k + 1]
            want = sum((n * a - s) / n * u for a, s, u in zip(x, sums, columns[:, k], strict=True)) / math.sqrt(values[k])
            sign = signs.setdefault(k, 1 if r.whitened * want > 0 else -1)
            assert r.deviation == away and abs(r.whitened - sign * want) < 1e-7 * max(1, abs(want))
            assert abs(r.explained - values[k] / np.trace(covariance)) < 1e-10 and r.identity_error < 1e-9


def test_whitening_is_exact_where_doubles_are_not(saved):
    rows = [(i, [float(2**33 + i % 3), float(-(2**33) - 64 * i)]) for i in range(50)]
    out = whitening.whitened(vectors(saved, [(i, [a, b]) for i, (a, b) in rows])).collect()
    kept, n, sums, *_ = brute_whitened(rows, 2)
    want = {i: Decimal(sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))) for i, x in kept}
    assert all(r.deviation == want[r.vec_id] for r in out)


def test_whitening_without_variance_or_rows(saved):
    one = whitening.whitened(vectors(saved, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, 0.0, 0.0)] * 4
    assert whitening.whitened(vectors(saved, [])).count() == 0
    assert whitening.whitened(vectors(saved, [(1, None), (2, []), (3, [math.nan])])).count() == 0
    with pytest.raises(ValueError, match="too large"):
        whitening.whitened(vectors(saved, [(1, [1e20]), (2, [0.0])]))


def test_whitening_query_digest(spark):
    out = QUERIES["op11_whitening"](spark, "/root/testdata/sf0.001")
    assert dict(out.dtypes)["deviation"] == "bigint" and out.count() == 8000


# -- op 12 ----------------------------------------------------------------------------------------

def brute_contaminated(rows, items, width):
    found = {}
    for i, t in items:
        w = plain(t)
        for k in range(max(len(w) - width, 0) + 1 if w else 0):
            found.setdefault(tuple(w[k : k + width]), set()).add("" if i is None else str(i))
    sizes, out = {len(w) for w in found}, []
    for i, t in rows:
        w, hit, ids = plain(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if got := found.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    ids |= got
        out.append((i, len(w), len(hit), tuple(sorted(ids)), bool(hit)))
    return sorted(out, key=str)


ITEMS = "item_id long, text string, words string, n_hit int"


@pytest.mark.parametrize("width", [10, 4])
def test_decontamination(saved, width):
    passage, other, crowd = prose(21, 40, 60), prose(22, 25), "the same words"
    items = [(2, passage), (10, other + " " + passage[:60]), (10, "two rows of one item with more words than just ten of them"), (None, "without id but with words"), (3, None), (4, " -- "), (5, "日本 É-x"), (6, crowd * 8), (7, "w1"), (8, passage)]
    rows = list(ODD) + [(30, f"{prose(31, 50)} {passage} tail"), (31, " ".join(passage.split()[5:15])), (32, " ".join(passage.split()[5:14])), (33, passage.upper().replace(" ", " --\n"))]
    rows += [(40 + i, f"{prose(40 + i, 20)} {other}") for i in range(60)] + [(120 + i, passage) for i in range(80)] + [(300, crowd * 500), (301, "just ten of them without id but with words and 日本 é x"), (302, "日本 É x")]
    got = decontamination.contaminated(table(saved, rows), saved([(i, t, "x", 1) for i, t in items], ITEMS), width).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got), key=str) == brute_contaminated(rows, items, width)
    assert all(r.n_items == len(r["items"]) for r in got)


def test_decontamination_with_a_crowded_bitmap(saved, monkeypatch):
    """What the bitmap lets through by chance, the join drops."""
    monkeypatch.setattr(decontamination, "LEAST_BITS", 64)
    monkeypatch.setattr(decontamination, "MOST_BITS", 64)
    items, rows = [(1, prose(50, 60)), (2, prose(51, 60))], [(i, prose(60 + i, 50) + " " + prose(50 + i % 4, 30)) for i in range(30)]
    got = decontamination.contaminated(table(saved, rows), saved([(i, t, "x", 1) for i, t in items], ITEMS)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got), key=str) == brute_contaminated(rows, items, 10)


def test_decontamination_empty(saved):
    no_items, no_docs = saved([], ITEMS), table(saved, [])
    out = decontamination.contaminated(table(saved, ODD), no_items).collect()
    assert len(out) == len(ODD) and not any(r.contaminated or r["items"] or r.n_hit for r in out)
    assert decontamination.contaminated(no_docs, saved([(1, "a b c", "x", 1)], ITEMS)).count() == 0


# -- op 13 ----------------------------------------------------------------------------------------

def brute_resampled(rows, target, buckets, least, percent):
    def buckets_of(t):
        w = plain(t)
        return [zlib.crc32(f.encode()) % buckets for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]], len(w)

    pool, aim = np.zeros(buckets), np.zeros(buckets)
    for counts, texts in ((pool, [t for _, t in rows]), (aim, target)):
        for t in texts:
            for b in buckets_of(t)[0]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (pool.sum() + buckets) / ((pool[b] + 1) * (aim.sum() + buckets)))) for b in range(buckets)]
    out = []
    for i, t in rows:
        found, n = buckets_of(t)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("percent", [0, 25, 60, 100])
def test_resampling(saved, percent):
    rows = ODD + [(100 + i, prose(i, 20 + i % 30)) for i in range(150)] + [(400, prose(9, 40))] * 12 + [(None, prose(8, 40))] * 5
    aim = [prose(3, 200), None, "", "é日本 W1-w2", "w5 w6 " * 50]
    out = resampling.resampled(table(saved, rows), saved([(i, t, "x", 1) for i, t in enumerate(aim)], ITEMS), percent).collect()
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in out), key=str) == brute_resampled(rows, aim, 10_000, 20, percent)


def test_resampling_empty(saved):
    none = saved([], ITEMS)
    assert resampling.resampled(table(saved, []), none).count() == 0
    out = resampling.resampled(table(saved, ODD), none).collect()
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in out), key=str) == brute_resampled(ODD, [], 10_000, 20, 25)


@pytest.mark.parametrize(("accuracy", "wanted"), [(1000, 250), (10, 1), (2, 777), (3, 1000), (100, 5000)])
def test_cutoff_widens_until_it_holds_the_place(spark, accuracy, wanted):
    """Also with a sketch too coarse for the first bracket, and with thousands of equal scores."""
    pool = settle(spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("n_features"), F.when(F.col("id") % 3 == 0, 50).otherwise(F.col("id") % 90).cast("long").alias("score")))
    order = sorted(((r.score, r.doc_id, 1) for r in pool.collect()), key=lambda r: (-r[0], r[1]))
    assert resampling.cutoff(pool, wanted, accuracy) == order[min(wanted, 1000) - 1]
