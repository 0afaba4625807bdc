"""The text operators against brute force on small cases: nulls, empty and long texts, ties, repeated rows, empty tables, odd columns."""

import collections
import hashlib
import math
import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from terrafold.llm import bpe, licenses, minhash, mixing, neighbours, packing, pii, quality, substrings, toxicity
from terrafold.llm import text as tx

SCHEMA = "doc_id long, text string, lang string, kept boolean, score double, n_words string"


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    """Rows as a table on disk with columns of clashing names."""

    def save(rows):
        path = str(tmp_path_factory.mktemp("docs") / "t")
        full = [(i, t, "en", None, 1.0, "x") for i, t in rows]
        spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return save


def prose(seed, n, vocabulary=300):
    rng = random.Random(seed)
    return " ".join(f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n))


LONG = prose(7, 30_000, 5000)
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "one two"), (6, "one two"), (None, prose(1, 80)), (None, None), (7, prose(1, 80)), (8, LONG), (9, LONG + " end"), (10, "é日本 \x1f word\x85next")]


# -- op 1 -----------------------------------------------------------------------------------------

def brute_components(rows, k, share):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(s)
    parent = {i: i for i in sets if i is not None}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = list(parent)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= share * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def edited(base, seed, changes):
    rng, words = random.Random(seed), base.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_minhash(saved):
    base = prose(3, 150)
    rows = ODD + [(100 + i, edited(base, i, i % 9)) for i in range(60)] + [(300 + i, base) for i in range(20)] + [(400, base.upper())]
    out = minhash.near_duplicates(saved(rows), 4).collect()
    want = brute_components(rows, 4, 80)
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert {r.doc_id: r.n_shingles for r in out}[5] == 1


def test_minhash_empty(saved):
    assert minhash.near_duplicates(saved([])).count() == 0


def test_densified_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    for n in (3, 40, 2000):
        pool = np.unique(rng.integers(0, 2**63, 2 * n, dtype=np.uint64))[: n + n // 4 + 1]
        a, b = np.sort(pool[:n]), np.sort(pool[n // 4 + 1 :])
        got = (minhash.signature([a], 1200) == minhash.signature([b], 1200)).mean()
        want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(got - want) < 0.25 if n < 10 else abs(got - want) < 0.12


# -- op 2 -----------------------------------------------------------------------------------------

def brute_repeats(rows, k):
    seen, out, order = {}, {}, sorted({i if i is not None else 2**63 - 1 for i, _ in rows})
    for i in order:
        for j, t in rows:
            if (j if j is not None else 2**63 - 1) != i:
                continue
            w = (t or "").encode().split()
            gone = [False] * len(w)
            for s in range(len(w) - k + 1):
                if seen.setdefault(tuple(w[s : s + k]), (i, s)) != (i, s):
                    gone[s : s + k] = [True] * k
            left = [x for x, g in zip(w, gone) if not g]
            out.setdefault(j, set()).add((len(w), sum(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [2000, 1])
def test_substrings(saved, crowd):
    passage = prose(11, 60)
    rows = [r for r in ODD if r[0] is not None] + [(None, prose(5, 70))]
    rows += [(50 + i, f"{prose(100 + i, 25)} {passage} {prose(200 + i, 25)}") for i in range(30)] + [(90, "same " * 100)]
    out = substrings.without_repeats(saved(rows), 20, crowd).collect()
    want = brute_repeats(rows, 20)
    assert len(out) == len(rows)
    assert all((r.n_words, r.n_removed, r.kept_sha256) in want[r.doc_id] for r in out)


def test_substrings_of_rows_without_a_name_of_their_own(saved):
    """What one of several rows repeats is taken from that row alone: rows without an id, and texts of one id; a real id may be the largest number."""
    passage, top = prose(11, 40), 2**63 - 1
    rows = [(1, passage), (None, f"{prose(1, 30)} {passage}"), (None, prose(2, 90)), (None, prose(3, 25)), (7, f"{passage} {prose(4, 40)}"), (7, prose(5, 90)), (7, prose(5, 90)), (top, prose(6, 50)), (None, prose(6, 50))]
    out = substrings.without_repeats(saved(rows), 20).collect()
    assert len(out) == len(rows)
    gone = {}
    for r in out:
        gone.setdefault(r.doc_id, []).append((r.n_words, r.n_removed))
    assert gone[1] == [(40, 0)]
    assert sorted(gone[7]) == [(80, 40), (90, 0), (90, 0)]
    # The last passage stands at the largest real id and without an id: one of the two goes.
    twin = gone[top][0][1] + next(n for w, n in gone[None] if w == 50)
    assert twin == 50 and sorted(x for x in gone[None] if x[0] != 50) == [(25, 0), (70, 40), (90, 0)]


def test_substrings_empty(saved):
    assert substrings.without_repeats(saved([])).count() == 0


# -- op 3 -----------------------------------------------------------------------------------------

def test_mixing_base_and_order(saved):
    rows = [r for r in ODD if r[0] is not None] + [(20 + i, prose(i, 300)) for i in range(60)]
    out = mixing.scored(saved(rows), "crc32(cast(doc_id AS string)) % 7 = 2").collect()
    texts = collections.defaultdict(list)
    counts = collections.Counter()
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), b""]
        texts[i].append(w)
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    assert len(out) == len(rows)
    for r in out:
        w = texts[r.doc_id][0]
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2, len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    held = [r for r in out if r.held_out and r.n_tokens > 100]
    # Close to the unigram model on words it knows, far better than eight bits a byte.
    assert held and all(r.bits_per_byte < 4 for r in held)


def test_mixer_is_a_distribution():
    """The probabilities of the two bits of any decision add up to one."""
    mixer = mixing.Mixer()
    odds, gate = np.random.default_rng(0).normal(0, 3, (mixing.CONTEXTS, 500)), np.arange(500) % mixing.GATES
    mixer.learn(odds, gate, np.arange(500) % 2, np.ones(500))
    both = sum(10 ** mixer.log10(odds, gate, np.full(500, y)) for y in (0, 1))
    assert np.allclose(both, 1)


def test_mixing_empty(saved):
    assert mixing.scored(saved([]), "false").count() == 0


# -- op 4 -----------------------------------------------------------------------------------------

# The plain patterns of the base kinds.
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute_pii(t):
    found = {}
    for kind, pattern in PLAIN.items():
        found[kind] = []
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 13 <= len(d) <= 19 and brute_luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                found[kind].append(f"{kind}:{m.start()}:{m.end()}")
    return tuple(len(x) for x in found.values()) + (hashlib.sha256(",".join(sum(found.values(), [])).encode()).hexdigest(),)


def test_pii(saved):
    rng = random.Random(3)
    parts = ["a.b@c.de", "x@y", "@z.q", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "000255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (499) 555-6503", "+49", "é", " ", "-", "_", "%", ".", "7", " 12 ", "日本", "+", "@"]
    rows = ODD + [(100 + i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 40)))) for i in range(400)] + [(900, "a" * 100_000 + "1" * 50_000), (901, "x@y." + "z." * 20_000 + "z")]
    out = pii.personal_data(saved(rows)).collect()
    texts = collections.defaultdict(set)
    for i, t in rows:
        texts[i].add(brute_pii(t or ""))
    assert len(out) == len(rows)
    assert all(tuple(r[1:6]) in texts[r.doc_id] for r in out)


def test_pii_added_kinds_and_redaction(saved):
    rows = [(1, "IBAN GB82 WEST 1234 5698 7654 32 or GB82 WEST 1234 5698 7654 33"), (2, "my ssn 123-45-6789; order 123-45-6789 far away from any such word, as it is"), (3, "mail a@b.c now"), (4, None), (5, "plain")]
    docs = saved(rows)
    spans = {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}
    assert spans[1] == "iban:5:32" and spans[2].split(",")[0] == "ssn:7:18" and spans[5] == ""
    out = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert out[1].startswith("IBAN <IBAN> or GB82") and out[3] == "mail <EMAIL> now" and out[4] is None and out[5] == "plain"


# -- op 5 -----------------------------------------------------------------------------------------

def test_toxicity(spark, saved):
    rows = [r for r in ODD if r[0] is not None] + [(100 + i, prose(i, 60) + (" stupidfool " if i % 4 == 0 else " ") + prose(i + 1000, 20)) for i in range(400)]
    docs = saved(rows)
    labels = spark.createDataFrame([(100 + i, int(i % 4 == 0)) for i in range(300)] + [(None, 1), (1, None), (2, 0), (99999, 1)], "doc_id long, toxic int")
    out = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.fit(docs, labels)).collect()}
    assert all((out[100 + i] >= 0.5) == (i % 4 == 0) for i in range(300, 400))
    assert all(0 <= s <= 1 for s in out.values()) and out[1] == out[2]


def test_toxicity_without_labels(spark, saved):
    docs = saved(ODD)
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {round(r.score, 6) for r in toxicity.scored(docs, model).collect()} == {0.5}
    assert toxicity.scored(saved([]), model).count() == 0


# -- op 6 -----------------------------------------------------------------------------------------

def brute_licence(t):
    w = re.findall(licenses.WORD, re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    at, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        here = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += here
        labels |= {label} if here else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_licenses(saved):
    rows = ODD + [
        (20, "CC BY cc-by cc--BY mit License"), (21, "xmit license émit license mit licenseé"), (22, "Licensed under the Apache License, Version 2.0."), (23, "License " * 3000),
        (24, prose(3, 50) + "\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"), (25, "GNU gnu general public license"), (25, "GNU gnu general public license"),
    ] + [(100 + i, prose(i, 30)) for i in range(60)]
    out = licenses.scanned(saved(rows)).collect()
    want = collections.defaultdict(set)
    for i, t in rows:
        want[i].add(brute_licence(t))
    assert len(out) == len(rows)
    assert all(tuple(r[1:6]) in want[r.doc_id] and 0 <= r.score <= 1 for r in out)
    labels = {r.doc_id: r.labels for r in out}
    assert labels[22] == "apache,apache-2.0" and labels[24] == "mit" and labels[23] == ""
    assert licenses.scanned(saved([])).count() == 0


def test_licenses_several_notices(saved):
    """Every notice of a text is told, however many others stand beside it."""
    words = {label: t for label, t, _ in reversed(licenses.TEMPLATES)}
    held = [("mit", "bsd", "all-rights-reserved"), ("gpl-2.0", "mit"), ("mit", "isc"), ("bsd", "all-rights-reserved"), tuple(words)]
    rows = [(k, prose(k, 20) + "\n" + f"\n{prose(k + 9, 5)}\n".join(words[x] for x in own)) for k, own in enumerate(held)] + [(100 + i, prose(i, 30)) for i in range(90)]
    out = {r.doc_id: r for r in licenses.scanned(saved(rows)).collect()}
    for k, own in enumerate(held):
        assert set(own) <= set(out[k].labels.split(",")) and out[k].score == 1.0
    assert all(out[100 + i].labels == "" for i in range(90))


def test_licenses_common_notice(saved):
    """A notice is told in a third of all rows and in tables of few rows as in any other."""
    for words, label in [("all rights reserved", "all-rights-reserved"), (licenses.TEMPLATES[0][1], "mit"), ("licensed under cc by nc 4 0", "cc-by,cc-by-nc")]:
        rows = [(i, prose(i, 20) + ("\n" + words if i % 3 == 0 else "")) for i in range(60)]
        for some in (rows, rows[:2], rows[:1]):
            got = {r.doc_id: (r.labels, r.score) for r in licenses.scanned(saved(some)).collect()}
            assert got == {i: (label, 1.0) if i % 3 == 0 else ("", 0.0) for i, _ in some}


# -- op 7 -----------------------------------------------------------------------------------------

def brute_quality(t):
    t = t or ""
    w = t.encode().split()
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in t.encode().split(b"\n") if x.split()]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality(saved):
    rows = ODD + [(100 + i, prose(i, 70)) for i in range(50)] + [(200, "a b c " * 40), (201, "x | y\n" * 5 + "\n\nq #$%"), (203, "a b c d a b c")]
    out = quality.judged(saved(rows)).collect()
    want = collections.defaultdict(set)
    for i, t in rows:
        want[i].add(brute_quality(t))
    assert len(out) == len(rows)
    for r in out:
        assert tuple(r[1:6]) in want[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    kept = {r.doc_id: r.kept for r in out}
    assert all(kept[100 + i] for i in range(50)) and not kept[200]
    assert quality.judged(saved([])).count() == 0


def test_bands_come_from_the_distribution(spark):
    nats = [1.5 + 0.001 * (i % 40) for i in range(400)] + [3.2, 0.1]
    (band,) = quality.language_bands(spark.createDataFrame([("en", x) for x in nats], "_lang string, _nats double")).collect()
    assert abs(band["_median"] - np.median(nats)) < 2e-3
    assert abs(band["_below"] - (np.median(nats) - np.quantile(nats, 0.05))) < 3e-3
    assert abs(band["_above"] - (np.quantile(nats, 0.95) - np.median(nats))) < 3e-3


def junk(kind, i):
    rng = random.Random(i)
    if kind == "numbers":
        return " ".join(str(rng.randrange(10**6)) for _ in range(150))
    if kind == "hex":
        return " ".join(f"{rng.randrange(2**32):08x}" for _ in range(150))
    if kind == "capitals":
        return " ".join("".join(rng.choices(string.ascii_uppercase, k=rng.randint(2, 8))) for _ in range(150))
    letters = list(prose(i, 150))
    rng.shuffle(letters)
    return "".join(letters)


def test_perplexity_rejects_junk_and_leaves_clean_texts(spark):
    kinds = ("numbers", "hex", "capitals", "letters")
    rows = [(i, prose(i, 150)) for i in range(600)] + [(1000 + 10 * k + i, junk(kind, i)) for k, kind in enumerate(kinds) for i in range(4)]
    # A language of its own per row must neither fail nor make a model each.
    rows = [(i, t, "en") for i, t in rows] + [(5000 + i, prose(i, 150), f"x{i}") for i in range(100)] + [(6000, prose(3, 150), None)]
    out = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    kept = {r.doc_id: r.kept for r in out}
    assert sum(kept[i] for i in range(600)) >= 0.95 * 600
    assert not any(r.base_failed for r in out)
    for k in range(len(kinds)):
        assert not any(kept[1000 + 10 * k + i] for i in range(4)), kinds[k]
    assert all(kept[5000 + i] for i in range(100)) and kept[6000]


def brute_kneser_ney(counts, alone):
    """ln p of the last symbol of a tuple by the formula, from {tuple: count} of the highest order and the set of n-grams of one text."""
    tables, lone = {quality.ORDER: counts}, {quality.ORDER: alone}
    for k in range(quality.ORDER - 1, 0, -1):
        tables[k] = collections.Counter(g[1:] for g in tables[k + 1])
        lone[k] = {g[1:] for g in lone[k + 1] if tables[k][g[1:]] == 1}
    d = {k: quality.discounts(np.array(list(t.values()))) for k, t in tables.items()}

    def p(g):
        if not g:
            return 1 / quality.N_SYMBOLS
        k, off = len(g), lambda s, c: c if s in lone[len(s)] else d[len(s)][min(c, 3)]
        beside = {s: c for s, c in tables[k].items() if s[:-1] == g[:-1]}
        if not beside:
            return p(g[1:])
        own = tables[k].get(g, 0)
        return ((own - off(g, own) if own else 0) + sum(off(s, c) for s, c in beside.items()) * p(g[1:])) / sum(beside.values())

    return lambda g: np.log(p(g))


def test_kneser_ney():
    code, _ = quality.codes([prose(4, 4000).encode()])
    grams, n = np.unique(code, return_counts=True)
    alone = (n == 1) & (grams % 3 > 0)
    model = quality.kneser_ney(grams, n, alone)
    context = int(code[500]) >> 8
    for head in (context, 0x20207700, 77):
        every = np.array([((head << 8) | s) & ((1 << 32) - 1) for s in range(256)], np.uint32)
        assert abs(np.exp(quality.log_probability(model, every)).sum() - 1) < 1e-3
    unpack = lambda c: tuple((int(c) >> (8 * j)) & 255 for j in range(3, -1, -1))
    want = brute_kneser_ney({unpack(c): int(k) for c, k in zip(grams, n, strict=True)}, {unpack(c) for c in grams[alone]})
    some, _ = quality.codes([prose(5, 20).encode(), b"0AF3 9", "\u00e9\u4e2d".encode()])
    assert np.allclose(quality.log_probability(model, some), [want(unpack(c)) for c in some], atol=1e-4)


def test_no_two_characters_are_one_symbol():
    last = lambda t: int(quality.codes([t.encode()])[0][-1])
    rng = random.Random(1)
    points = [0, 1, 31, 127, 128, 255, 256, 0x3B1, 0x3B1 + 128, 0x4E00, 0x4E80, 0xD7FF, 0xE000, 0xFFFD, 0xFFFF, 0x10000, 0x1F600, 0x1F601, 0x10FFFF]
    points += [p for p in rng.sample(range(0x110000), 3000) if not 0xD800 <= p < 0xE000]
    assert len({last("".join(map(chr, (65, p)))) for p in points}) == len(set(points))
    grams = {"".join(chr(rng.choice([0x3B1, 0x431, 0x4E00, 0x4E80, 1])) for _ in range(4)) for _ in range(2000)}
    assert len({last(g) for g in grams}) == len(grams)
    rows = ["", "a\U0001f600b", "\u4e2d\u6587", "\0\0", "\U0010ffff"]
    code, lengths = quality.codes([t.encode() for t in rows])
    assert list(quality.characters(code, lengths)) == [len(t) for t in rows]


def test_texts_of_other_scripts_are_judged_by_their_characters(spark):
    moved = lambda t, by: "".join(chr(ord(c) + by) if c.isalpha() else c for c in t)
    rows = [(i, moved(prose(i, 150), 0x4E00)) for i in range(300)] + [(1000 + i, moved(prose(i, 150), 0x4E80)) for i in range(4)]
    out = {r.doc_id: r for r in quality.judged(spark.createDataFrame([(*r, "zh") for r in rows], "doc_id long, text string, lang string")).collect()}
    assert sum(out[i].kept for i in range(300)) >= 285
    assert not any(out[1000 + i].kept for i in range(4)) and not any(r.base_failed for r in out.values())


# -- op 8 -----------------------------------------------------------------------------------------

def test_plan_uses_every_piece():
    rng = random.Random(5)
    for _ in range(30):
        counts = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(rng.randint(1, 40))}
        lines = packing.plan(counts, 64)
        used = collections.Counter()
        for n, lengths in lines:
            assert sum(lengths) <= 64
            for x in lengths:
                used[x] += n
        assert used == counts


def test_packing(saved):
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(tokenizer)
    rows = ODD + [(100 + i, prose(i, 5 + 13 * i)) for i in range(60)] + [(200, "a  b\n\n c "), (201, " \n x <|endoftext|> y"), (202, " " * 50), (203, "x\n y z")]
    out = packing.packed(saved(rows), tokenizer, 0, 256).collect()
    want = collections.Counter()
    for i, t in rows:
        ids = [*encoder.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [len(ids)] if len(ids) <= 256 else list(range(len(ids) % 256 or 256, len(ids) + 1, 256))
        for k, (a, b) in enumerate(zip([0, *cuts], cuts)):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    sequences = collections.defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= 1.02 * sum(r.length for r in out) / 256 + 1
    assert packing.packed(saved([]), tokenizer).count() == 0
    carried = packing.packed(saved(rows), tokenizer, 0, 256, with_ids=True).collect()
    assert len(carried) == len(out)
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in carried)


def test_narrow_ids(spark):
    for ids in ([0], [65535, 1, 2], [65536, 1], [1, 2, 99_000]):
        whole = np.array(ids, "<u4").tobytes()
        short = packing.narrowed(whole)
        assert len(short) == (2 if max(ids) < 65536 else 4) * len(ids)
        row = spark.createDataFrame([(short, len(ids))], "ids binary, length long").select(packing.widened("ids", "length").alias("ids")).first()
        assert row.ids == whole


# -- op 9 -----------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def encoders():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        mine = bpe.Encoder.load(lines.readlines(), public_tokenizers.PATTERN)
    return mine, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=mine.ranks, special_tokens={})


def test_bpe_equals_the_library(encoders):
    mine, theirs = encoders
    rng = random.Random(2)
    cases = ["".join(rng.choice("abcdeé thinger\n  \t.,!1234日本THE\x85\x1f") for _ in range(rng.choice([1, 3, 20, 100, 500]))) for _ in range(800)]
    for t in [*cases, "a" * 3000, "ab" * 2000, " " * 2000, "th" * 3000, "", "日本" * 500]:
        ids = mine.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(t)
        assert mine.decode(ids) == t.encode()


def test_bpe_tokens_encode_to_themselves(encoders):
    """The proof of the joins needs every token to be the encoding of its own bytes."""
    mine, _ = encoders
    assert all(mine.merge(t) == (i,) for t, i in mine.ranks.items())


def test_bpe_frames(saved):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe.decoded(bpe.encoded(saved(ODD), ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN).collect()
    assert collections.Counter((r.doc_id, bytes(r.decoded)) for r in out) == collections.Counter((i, (t or "").encode()) for i, t in ODD)


# -- op 10 ----------------------------------------------------------------------------------------

def brute_neighbours(rows, every, k):
    good = sorted({(i, tuple(float(np.float32(x)) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    width = max(len(v) for _, v in good)
    ids, matrix = np.array([i for i, _ in good]), np.array([v + (0.0,) * (width - len(v)) for _, v in good])
    out = {}
    for i, q in zip(ids, matrix):
        if i % every == 0:
            s = neighbours.products(q[None, :], matrix)[0]
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=16) * (1 + i % 3)).tolist()) for i in range(3000)] + [(5000 + i, [1.0] * 16) for i in range(100)]
    rows += [(6000, None), (6020, []), (6040, [0.0] * 16), (6060, [None] + [1.0] * 15), (6080, [float("nan")] * 16), (6100, [float("inf")] * 16), (None, [1.0] * 16), (6120, [1.0, 2.0]), (5000, [1.0] * 16)]
    df = spark.createDataFrame([(i, v, 0.5) for i, v in rows], "vec_id long, embedding array<float>, score double")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, 20, 10, tile_rows=300, block_rows=64, sample_rows=500).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = brute_neighbours(rows, 20, 10)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    assert got[5000] == want[5000] and got[6120][:1] == want[6120][:1]


def test_neighbours_likely_pairs():
    """op10: one matrix product leaves out no pair that reaches the floor, equal scores and tiny or huge entries included, and lets few others through."""
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(600, 24))
    rows[50:90] = rows[7]
    for scale in (1.0, 1e-170, 1e140):
        q, x = rows[:60], rows * scale
        exact = neighbours.products(q, x)
        floor = np.partition(exact, -20, axis=1)[:, -20]
        a, b = neighbours.likely(q, x, floor - neighbours.slack(neighbours.lengths(q), neighbours.lengths(x).max(), 24))
        assert (neighbours.pair_products(q, x, a, b, 100) == exact[a, b]).all()
        told = np.zeros(exact.shape, bool)
        told[a, b] = True
        assert told[exact >= floor[:, None]].all() and (told & (exact < floor[:, None])).sum() < 60


def test_neighbours_few(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 9.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in neighbours.nearest(few).collect()] == [(0, 1, 1), (0, 2, 2)]
    assert neighbours.nearest(few.filter("vec_id > 9")).count() == 0


# -- pipeline -------------------------------------------------------------------------------------

def test_pipeline_stages(spark, saved, tmp_path):
    import corpus_pipeline

    passage, clean = prose(21, 60, 100_000), [(i, prose(i + 50, 120, 3000)) for i in range(40)]
    rows = clean + [(100, clean[0][1]), (101, edited(clean[1][1], 1, 2)), (102, f"{prose(500, 80, 3000)} {passage} mail a@b.cd"), (103, f"{prose(501, 80, 3000)} {passage}"), (104, None), (105, "short"), (106, "a b c " * 50), (None, prose(900, 90, 3000))]
    docs = saved(rows)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", ""))
        out = stage(spark, docs, "")
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs
    ids = lambda name: {r.doc_id for r in kept[name].collect()}
    assert ids("quality rules") == {i for i, _ in rows} - {104, 105, 106}
    assert ids("near-dedup") == ids("quality rules") - {100, 101}
    texts = {r.doc_id: r.text for r in kept["substring dedup"].collect()}
    assert texts[103] == prose(501, 80, 3000) and all(texts[i] == t for i, t in clean)
    assert "<EMAIL>" in {r.doc_id: r.text for r in kept["personal data"].collect()}[102]
    assert ids("packing") == ids("near-dedup")


def test_pipeline_gives_token_ids(spark, saved, tmp_path):
    """Every stage by ``run``: the ids of the last one are those of the text that the others left."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    rows = [(i, prose(i + 50, 120 if i else 4000, 3000)) for i in range(20)] + [(None, prose(900, 90, 3000)), (30, prose(700, 90, 3000) + " mail a@b.cd")]
    saved(rows).write.parquet(str(tmp_path / "documents.parquet"))
    ids = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).orderBy("doc_id", "start").collect():
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        ids[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    encoder = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    texts = {i: t.replace("a@b.cd", "<EMAIL>") for i, t in rows}
    assert set(ids) == set(texts)
    for i, t in texts.items():
        assert ids[i] == [*encoder.encode(t, add_special_tokens=False).ids, 0]


def test_words_are_split_at_the_six_blanks():
    assert tx.words(b"a\x1cb\x0bc\xc2\x85d\x0ce") == [b"a\x1cb", b"c\xc2\x85d", b"e"]


def test_sets_have_no_hidden_columns(saved):
    assert minhash.near_duplicates(saved(ODD).withColumn("fp", F.lit(1)).withColumn("doc", F.lit(2))).count() == len(ODD)


def test_models_are_fitted_in_tasks_and_counts_stay_there(spark, monkeypatch):
    rows = [("en", "the cat sat on the mat"), ("en", "the cat sat on the hat"), ("de", "der Hund und der Hut"), ("de", "der Hund im Hof"), (None, "abc"), ("", "abcd")]
    counts = quality.ngram_counts(spark.createDataFrame(rows, "lang string, text string"))
    table = [(r.lang, r.code, r.n, r.texts) for r in counts.collect()]
    monkeypatch.setattr(type(counts), "toPandas", lambda self: pytest.fail("the counts went to the driver"))
    got = quality.models(counts)
    assert set(got) == {"en", "de", ""}
    for lang, model in got.items():
        code, n, texts = (np.array(c) for c in zip(*[r[1:] for r in table if r[0] == lang], strict=True))
        want = quality.kneser_ney(code, n, texts == 1)
        assert len(model) == len(want) == quality.ORDER
        for a, b in zip(model, want, strict=True):
            for x, y in zip(a, b, strict=True):
                assert x.dtype == y.dtype and np.array_equal(x, y)
