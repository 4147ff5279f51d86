"""Spelling variants, quality rules and periodic runs against brute force, with null, empty, repeated and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evispark.llm import periodic, quality_rules, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, word string, n string, root string, `a.b` string, kept string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), *"xxxxxx") for i, t, lang, s in rows], DOCS)


ODD = [
    (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t", None, "a"), (4, "word", "en", "b"), (4, "word", "en", "b"), (None, "one two three four five six " * 3, "en", "b"), (None, None, None, None),
    (5, "same\nsame\n \nsame\r\nother line $ & #", "en", "c"), (6, "long " * 30000, "en", "c"), (7, "é 日本 ß\x0b\x0c x\x85y z w v u", "de", "c"), (8, "a b c d e f g h i j k a b c d e", None, None), (9, "x " * 9 + "\U0001f600*" * 5, "de", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


# --- spelling variants ---


def edit_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute_variants(words):
    vocab = {w: n for w, n in Counter(words).items() if len(w) >= 5 and n >= 3}
    near = {w: [] for w in vocab}
    by_size = {}
    for w in vocab:
        by_size.setdefault(len(w), []).append(w)
    for w in vocab:
        near[w] = [x for k in (-1, 0, 1) for x in by_size.get(len(w) + k, []) if edit_one(w, x)]
    form = {}
    for w, n in vocab.items():
        best = min(near[w], key=lambda x: (-vocab[x], x), default=None)
        form[w] = best if best is not None and vocab[best] >= 2 * n else None
    out = []
    for w, n in vocab.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), None if form[w] is None else vocab[form[w]]))
    return Counter(out)


def brute_runs_of_letters(rows):
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{w}".encode()) if i is not None else 1
            yield w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w


def as_counter(df):
    return Counter((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def test_spelling_variants(spark, docs):
    want = brute_variants(brute_runs_of_letters((r["doc_id"], r["text"]) for r in docs.collect()))
    assert as_counter(spelling.spelling_variants(docs)) == want
    assert sum(k[1] is not None for k in want) > 50 and any(k[4] > 1 for k in want)


@pytest.mark.parametrize("bucket", [1, 3, 1000])
def test_common_chunks_are_split(spark, bucket):
    """A third of the words share a half; every bucket size gives all pairs, also where chunks are split down to one letter."""
    rng = random.Random(bucket)
    words = []
    for _ in range(250):
        w = rng.choice(["aaaa", "commonpart", ""]) + "".join(rng.choice("abÀ") for _ in range(rng.randint(5, 8)))
        words += [w] * rng.choice([3, 4, 7, 15, 40])
    words += ["Þ" * 5000 + x for x in ("ab", "b", "ac") for _ in range(4)] + ["short"] * 2
    df = spark.createDataFrame([(w,) for w in words], "word string")
    assert as_counter(spelling.variants(df, bucket=bucket)) == brute_variants(words)


def test_chains_and_ties(spark):
    counts = {"abcde": 3, "abcdf": 6, "abcgf": 12, "abhgf": 24, "aihgf": 48, "jihgf": 96, "jihg": 500, "abcdz": 6, "zzzzz": 3, "yzzzz": 3}
    words = [w for w, n in counts.items() for _ in range(n)]
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got["abcde"]["form"] == "abcdf" and got["abcde"]["root"] == "jihgf" and got["jihgf"]["form"] is None and got["jihgf"]["root"] == "jihgf"
    assert got["zzzzz"]["form"] is None and got["zzzzz"]["n_near"] == 1 and "jihg" not in got


def test_spelling_odd_rows(spark):
    rows = [*ODD, (None, "Straße straße STRASSE straße " * 3, "de", "x"), (11, "ÀÉÎÕÜ àéîõü ×÷××÷ " * 4, "fr", "x")]
    df = frame(spark, rows)
    assert as_counter(spelling.spelling_variants(df)) == brute_variants(brute_runs_of_letters((r[0], r[1]) for r in rows))
    assert spelling.spelling_variants(df.limit(0)).count() == 0


# --- quality rules ---


def brute_counts(text):
    text = text or ""
    ws = [w for w in re.split("[ \t-\r]+", text) if w]
    windows = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    repeated = {k for i in range(len(ws) - 4) if windows[tuple(ws[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search("[^ \t-\r]", x)]
    n = len(ws)
    return n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), n < 10 or 100 * len(repeated) > 20 * n


def brute_rules(rows, far=75, reach=3, least=200):
    counted = [(r, brute_counts(r[1])) for r in rows]
    measures = [
        (lambda c: c[4] * 1000 // c[0], False, 200), (lambda c: c[3] * 1000 // c[0], False, 20),
        (lambda c: c[2] * 1000 // c[1], False, 20), (lambda c: c[1] * 100 // c[0], True, 200),
    ]

    def bucket(v):
        low = max(v.bit_length() - 6, 0)
        return v >> low << low

    def spot(values, percent):
        up = sorted(map(bucket, values))
        return next(x for i, x in enumerate(up) if 100 * sum(y <= x for y in up) >= percent * len(up))

    good, out = [(r, c) for r, c in counted if not c[5]], []
    for r, c in counted:
        kept = not c[5]
        for value, two, slack in measures if kept else []:
            groups = [[value(d) for q, d in good if q[2:4] == r[2:4]], [value(d) for q, d in good if q[2] == r[2]], [value(d) for _, d in good]]
            vs = next((g for g in groups[:2] if len(g) >= least), groups[2])
            lo, mid, hi = (spot(vs, p) for p in (100 - far, 50, far))
            v = value(c)
            kept &= v <= mid + max((reach + 1) * (hi - mid), slack) and not (two and v < mid - max((reach + 1) * (mid - lo), slack))
        out.append((r[0], *c, kept))
    return Counter(out)


RULES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def test_quality_rules(spark, docs):
    for df, least in ((docs, 200), (docs, 5), (frame(spark, ODD), 1)):
        rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]
        got = Counter(tuple(r[c] for c in RULES) for r in quality_rules.judged(df, least=least).collect())
        assert got == brute_rules(rows, least=least)
    empty = frame(spark, ODD).limit(0)
    assert quality_rules.quality_rules(empty).count() == 0 and quality_rules.filtered(empty).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ab \n#", max_size=120), min_size=1, max_size=20))
def test_counts(spark, texts):
    df = frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    got = {r["doc_id"]: tuple(r[c] for c in RULES[1:7]) for r in quality_rules.counts(df).collect()}
    assert got == {i: brute_counts(t) for i, t in enumerate(texts)}


def test_filter_keeps_every_column(spark, docs):
    df = frame(spark, [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()] + ODD)
    kept = Counter(map(tuple, quality_rules.filtered(df).collect()))
    good = Counter(r["doc_id"] for r in quality_rules.quality_rules(df).where("kept").collect())
    assert kept and Counter(k[0] for k in kept.elements()) == good and not kept - Counter(map(tuple, df.collect()))
    assert quality_rules.filtered(df).columns == df.columns


def test_sketches_merge(spark):
    """Sketches of parts merge into that of the whole, and their quantiles are within a 32nd."""
    values = [int(10 ** random.Random(i).uniform(0, 6)) for i in range(5000)]
    df = spark.createDataFrame([("a", i % 7, v) for i, v in enumerate(values)], "g string, part int, value long")
    whole = quality_rules.sketch(df, ["g"])
    parts = quality_rules.merged(quality_rules.sketch(df, ["g", "part"]), ["g"])
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, parts.collect()))
    q = quality_rules.quantiles(parts, ["g"], {"p10": 10, "p50": 50, "p99": 99}).first()
    for p in (10, 50, 99):
        true = sorted(values)[-(-p * len(values) // 100) - 1]
        assert true * 31 / 32 <= q[f"p{p}"] <= true


def test_rules_move_with_their_group(spark):
    """The same document is an outlier in one source and usual in another."""
    rng = random.Random(3)

    def text(symbols):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) + "#" * (k < symbols) for k in range(60))

    rows = [(i, text(0), "en", "prose") for i in range(300)] + [(1000 + i, text(rng.randint(30, 50)), "en", "tables") for i in range(300)] + [(5000, text(40), "en", "prose"), (5001, text(40), "en", "tables")]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(frame(spark, rows)).collect()}
    assert not kept[5000] and kept[5001] and sum(kept.values()) == 601


def test_rules_are_native(spark, docs):
    plan = quality_rules.counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- periodic runs ---


def brute_runs(w):
    """Every stretch that agrees with itself q words on, for every q."""
    found, codes = {}, np.unique(np.array(w, dtype=object), return_inverse=True)[1] if len(w) else np.zeros(0, dtype=int)
    for q in range(1, len(w) // 4 + 1):
        same = np.concatenate([[False], codes[:-q] == codes[q:], [False]])
        turns = np.flatnonzero(same[1:] != same[:-1])
        for i, j in zip(turns[::2].tolist(), turns[1::2].tolist()):
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda x: (x[0], x[2]))


def brute_digest(i, text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(w)
    if i is not None and n:
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    drop = {k for s, m, q in runs for k in range(s + q, s + m)}
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (i, len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in drop).encode()).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(0, 90), st.integers(0, 10**6)), min_size=1, max_size=6))
def test_runs_match_brute_force(shapes):
    documents = []
    for letters, n, seed in shapes:
        rng = random.Random(seed)
        w = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            if n > 8:
                a, p = rng.randrange(n), rng.randint(1, 12)
                for k in range(a, rng.randint(a, n)):
                    w[k] = w[min(a + (k - a) % p, n - 1)]
        documents.append(w)
    assert periodic.runs_of([np.array(w, dtype=np.int64) for w in documents]) == [brute_runs(w) for w in documents]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=2, max_size=120))
def test_extensions(w):
    w = np.array(w)
    ext = periodic.Extensions(w)
    a, b = map(np.ravel, np.meshgrid(np.arange(len(w)), np.arange(len(w))))
    a, b = a[a != b], b[a != b]

    def lce(x, y):
        k = 0
        while max(x, y) + k < len(w) and w[x + k] == w[y + k]:
            k += 1
        return k

    assert ext(a, b).tolist() == [lce(x, y) for x, y in zip(a.tolist(), b.tolist())]


def test_run_digest(spark, docs):
    planted = frame(spark, [(i, " ".join(random.Random(i).choices("abc", k=i % 70)), "en", "a") for i in range(400)])
    for df in (docs, frame(spark, ODD), planted):
        got = Counter(map(tuple, periodic.run_digest(df).collect()))
        assert got == Counter(brute_digest(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
    assert periodic.run_digest(planted.limit(0)).count() == 0
    assert periodic.run_digest(planted).where(F.col("n_runs") > 0).count() > 30


def test_long_runs(spark):
    """Long repetitive texts: every grid place agrees; time stays near-linear."""
    df = frame(spark, [(3, "x " * 200000, "en", "a"), (None, "a b c " * 60000 + "end", "en", "a")])
    got = {r["doc_id"]: r for r in periodic.run_digest(df).collect()}
    assert (got[3]["start"], got[3]["length"], got[3]["period"], got[3]["n_runs"]) == (0, 200000, 1, 1)
    assert (got[None]["length"], got[None]["period"], got[None]["exponent_milli"]) == (180000, 3, 60000000)


def test_runs_and_collapsed(spark):
    df = frame(spark, [(1, "go on " * 5 + "then stop", "en", "a"), (2, None, "en", "a")])
    assert [tuple(r) for r in periodic.runs(df).collect()] == [(1, 0, 10, 2, "go on")]
    assert {tuple(r) for r in periodic.collapsed(df).collect()} == {(1, "go on then stop", 8), (2, "", 0)}
