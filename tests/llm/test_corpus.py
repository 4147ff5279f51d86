"""The corpus operators against brute force, exact round trips and held-out accuracy, with null, empty, repeated and odd rows."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evispark.llm import ann, chat_format, decontam, html_extract, language_id, license_scan, mixing, simhash, token_output, toxicity
from evispark.llm.queries import tokenizer_path

DATA = "/root/testdata/sf0.001"
#: Extra columns whose names clash with what operators use.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, fp string, key string, `a.b` string, taken string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", "x", "x", "x", "x", "x") for i, t, lang, s in rows], DOCS)


ODD = [
    (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t", None, "a"), (4, "word", "en", "b"), (4, "word", "en", "b"), (None, "one two three", "en", "b"), (None, None, None, None),
    (5, "All rights reserved. cc by CC BY cc by", "en", "c"), (6, "long " * 30000, "en", "c"), (7, "é 日本 ß", "de", "c"), (8, "Released under the MIT License.", "en", "a"), (9, "Released under the MIT Licence", "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="module")
def docs(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return spark.read.parquet(f"{DATA}/documents.parquet")


# --- license scan ---


def scan(text):
    ws = license_scan.words_of(text or "")
    at = [(i, label) for p, label in license_scan.PHRASES for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    labels, best = {x for _, x in at}, 1.0 if at else 0.0
    lines = [license_scan.words_of(x) for x in re.split("\r\n|\r|\n", text or "")]
    for k in range(len(lines)):
        block, j = list(lines[k]), k + 1
        while j < min(len(lines), k + 16) and 1 <= len(lines[j - 1]) <= 20 and lines[j] and len(block) + len(lines[j]) <= 48:
            block += lines[j]
            j += 1
        b = set(block)
        for _, label, t, need in license_scan.template_sets():
            if len(b & set(t)) >= need:
                labels.add(label)
                best = max(best, len(b & set(t)) / len(t))
    return len(ws), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at})), ",".join(sorted(labels)), round(best, 9)


def test_license_scan(spark, odd, docs):
    for df in (odd, docs, frame(spark, [(1, "cc by all rights reserved general public license cc\nby", "en", "a"), (2, "Licensed, under the Apache-License version 2.0!", "en", "a")])):
        got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 9)) for r in license_scan.license_scan(df).collect())
        assert got == Counter((r["doc_id"], *scan(r["text"])) for r in df.collect())
    assert license_scan.license_scan(odd.limit(0)).count() == 0


def test_wrapped_notices(spark):
    import textwrap

    import duckdb

    rows, labels = [], {}
    for i, (label, text) in enumerate(license_scan.TEMPLATES):
        for width, stop in ((40, "\n"), (60, "\r\n"), (80, "\r"), (10**6, "\n")):
            k = len(rows)
            rows.append((k, "Some first words" + stop * 2 + stop.join(textwrap.wrap(text, width)) + stop * 2 + "and last ones" + stop, "en", "a"))
            labels[k] = label
    rows.append((len(rows), "\n".join(["of the", "software", "", "deal in", "granted"] * 9), "en", "a"))
    rng = random.Random(1)
    words = [w for _, t in license_scan.TEMPLATES for w in t.split()]
    rows += [(len(rows) + i, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "\r\n", "\n\n"]) for _ in range(120)), "en", "a") for i in range(60)]
    df = frame(spark, rows)
    got = {r["doc_id"]: r for r in license_scan.license_scan(df).collect()}
    assert all(label in got[k]["labels"].split(",") for k, label in labels.items())
    assert {k: tuple(r)[1:-1] + (round(r["score"], 9),) for k, r in got.items()} == {i: scan(t) for i, t, *_ in rows}
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toPandas())
    want = {r[0]: r[1:-1] + (round(r[-1], 9),) for r in con.execute(license_scan.oracle()).fetchall()}
    assert {k: tuple(r)[1:-1] + (round(r["score"], 9),) for k, r in got.items()} == want


def test_license_plan_is_native(odd):
    assert "Python" not in license_scan.license_scan(odd)._jdf.queryExecution().executedPlan().toString()


# --- mixing ---


def water_level(size, weight, share=1.5, most=2):
    left, open_, out = share * sum(size.values()), set(size), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if most * size[s] < level * weight[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = most * size[s]
            left -= out[s]
        open_ -= full
    return out


def test_mix(docs, odd):
    for df in (docs, odd):
        rows = mixing.mix(df, rows=40).collect()
        want = Counter((r["doc_id"], len(re.findall(mixing.WORD, r["text"] or ""))) for r in df.collect())
        assert Counter((r["doc_id"], r["size"]) for r in rows) == want
        size = Counter()
        for r in rows:
            size[r["source"]] += r["size"]
        order = sorted(size, key=lambda s: (s is None, s or ""))
        target = water_level(size, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
        taken = Counter()
        for r in rows:
            assert r["source_size"] == size[r["source"]] and math.isclose(r["target"], target[r["source"]], rel_tol=1e-9, abs_tol=1e-6)
            assert 0 <= r["taken"] <= 2 * r["size"]
            taken[r["source"]] += r["taken"]
        assert all(abs(taken[s] - target[s]) <= 0.05 * target[s] + mixing.BLOCK for s in size)
        assert Counter(mixing.mix(df, rows=40).collect()) == Counter(rows)
    assert mixing.mix(odd.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permutation_is_a_bijection(spark, n):
    got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long")).alias("p")).collect()
    assert sorted(r["p"] for r in got) == list(range(n))


def test_mixed_slots_and_documents(docs):
    slots, pieces = mixing.mixed(docs, block=16, shard=64, rows=10**6)
    s, p = slots.collect(), pieces.collect()
    shards: dict = {}
    for r in s:
        shards.setdefault(r["shard"], []).append(r["at"])
    assert len(shards) > 5 and all(sorted(v) == list(range(len(v))) for v in shards.values())
    assert {(r["shard"], r["at"]) for r in p} == {(r["shard"], r["at"]) for r in s}
    per = Counter()
    for r in p:
        per[r["shard"], r["at"]] += r["piece_words"]
    assert 0 < max(per.values()) <= 16
    by: dict = {}
    for r in s:
        by.setdefault(r["skey"], []).append((r["j"], r["block_no"]))
    # taken by brute force: pack each source's documents in order, and count what the slots' blocks hold of them
    want, order = {}, {}
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        order.setdefault("s" + r["source"], []).append((r["doc_id"], len(re.findall(mixing.WORD, r["text"] or ""))))
    for k, items in order.items():
        size = sum(n for _, n in items)
        block = min(16, max(1, size // mixing.FINE))
        owner = [i for i, n in items for _ in range(n)]
        assert sorted(j for j, _ in by[k]) == list(range(len(by[k])))
        uses = Counter(b for _, b in by[k])
        assert set(uses) <= set(range(-(-size // block))) and max(uses.values()) <= 2 and max(uses.values()) - min(uses[b] for b in range(-(-size // block))) <= 1
        got = Counter()
        for b, n in uses.items():
            for i in owner[b * block : (b + 1) * block]:
                got[i] += n
        want |= {i: got[i] for i, _ in items}
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(docs, block=16, shard=64, rows=10**6).collect()} == want
    m = mixing.mixed_documents(docs)
    assert m.columns == docs.columns and m.count() > 0


def test_shards_draw_their_source_counts(spark, docs, monkeypatch):
    placed, sources, n = mixing.packed(mixing.sizes(docs), block=4)
    slots = {r["skey"]: r["slots"] for r in sources.collect()}
    total, shard = sum(slots.values()), 256
    got: dict = {}
    for r in mixing.shard_counts(sources, n, shard).collect():
        got.setdefault(r["shard"], {})[r["skey"]] = r["n"]
    assert [sum(v.values()) for k, v in sorted(got.items())][:-1] == [shard] * (len(got) - 1) and sum(sum(v.values()) for v in got.values()) == total
    # over all shards and sources, squared deviations are those of a multinomial draw
    full = [v for v in got.values() if sum(v.values()) == shard]
    chi = sum((v.get(k, 0) - shard * x / total) ** 2 / (shard * x / total) for v in full for k, x in slots.items() if x)
    free = len(full) * (sum(x > 0 for x in slots.values()) - 1)
    assert abs(chi - free) < 5 * math.sqrt(2 * free)
    plain = Counter(mixing.mix(docs, block=4, rows=40, stray=0.05).select("doc_id", "taken").collect())
    draw, hot = mixing.shard_counts, max(slots, key=slots.get)
    # another draw gives another mix: one source is drawn a twentieth more often
    monkeypatch.setattr(mixing, "shard_counts", lambda *a: draw(*a).withColumn("n", F.when(F.col("skey") == hot, F.ceil(F.col("n") * 1.05)).otherwise(F.col("n"))))
    other = Counter(mixing.mix(docs, block=4, rows=40, stray=0.05).select("doc_id", "taken").collect())
    words = lambda c: sum(r["taken"] for r in c.elements())
    assert other != plain and words(other) > words(plain)


def test_small_sources_come_near_their_targets(spark):
    long = lambda n, s: " ".join(f"{s}{i}" for i in range(n))
    rows = [(1, long(40, "a"), "en", "a"), (2, long(40, "b"), "en", "b"), (3, long(3, "c"), "en", "c"), (4, long(300, "d"), "en", "d"), (5, long(5000, "e"), "en", "e")] + [(6, long(30, "f"), "en", "f")] * 50
    taken, target = Counter(), {}
    got = mixing.mix(frame(spark, rows)).collect()
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= max(1, 0.02 * t) for s, t in target.items())
    same = [r["taken"] for r in got if r["doc_id"] == 6]
    assert len(same) == 50 and max(same) - min(same) <= 1 and max(same) <= 60


def test_mix_plan_is_native_and_reruns_agree(docs):
    m = mixing.mix(docs)
    assert "Python" not in m._jdf.queryExecution().executedPlan().toString()
    assert Counter(m.collect()) == Counter(mixing.mix(docs.repartition(7)).collect())


def test_mixed_documents_meet_each_source_s_words(spark):
    long = lambda n, s: " \n".join(f"{s}{i}" for i in range(n)) + " "
    rows = [(1, long(1000, "a"), "en", "a"), (2, long(5000, "b"), "en", "b")] + [(i, long(7, "b"), "en", "b") for i in range(3, 40)] + [(i, long(300, "c"), "en", None) for i in range(40, 60)] + [(60, long(500, "c"), "en", None)] * 3 + [(None, long(90, "c"), "en", "b"), (61, None, "en", "a")]
    df = frame(spark, rows)
    taken, out, target = Counter(), Counter(), {}
    for r in mixing.mix(df, rows=40).collect():
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    whole = {(i, s): t for i, t, _, s in rows}
    m = mixing.mixed_documents(df, rows=40)
    assert m.columns == df.columns
    for r in m.collect():
        assert r["text"] and whole[r["doc_id"], r["source"]].startswith(r["text"])
        out[r["source"]] += len(re.findall(mixing.WORD, r["text"]))
    assert out == +taken and all(abs(out[s] - t) <= 0.05 * t + mixing.BLOCK for s, t in target.items())


# --- SimHash ---


def brute_print(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(rows):
    fp = [(i, brute_print(t)) for i, t in rows]
    root = list(range(len(fp)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fp)):
        for b in range(a):
            if (fp[a][1] ^ fp[b][1]).bit_count() <= 3:
                root[find(a)] = find(b)
    lo = {}
    for k, (i, _) in enumerate(fp):
        if i is not None:
            lo[find(k)] = min(i, lo.get(find(k), i))
    return Counter((i, f"{f:016x}", lo.get(find(k))) for k, (i, f) in enumerate(fp))


def test_simhash(odd, docs):
    for df in (odd, docs):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        assert Counter(map(tuple, simhash.simhash_groups(df).collect())) == brute_groups(rows)
    assert simhash.simhash_groups(odd.limit(0)).count() == 0


def test_links_find_all_pairs(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(60)]
    xs = sorted({x ^ sum(1 << b for b in rng.sample(range(64), k)) for x in base for k in (0, 1, 2, 3, 3, 4)})
    signed = [x - (1 << 64) if x >> 63 else x for x in xs]
    got = [(r["u"], r["v"]) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()]
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert len(got) == len(set(got)) and set(got) == want


def test_components_of_a_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(90, 91)], "u long, v long")
    got = {r["node"]: r["root"] for r in simhash.components(e).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[91] == 90


def test_deduplicated_keeps_one_of_each_group(odd, docs):
    for df in (odd, docs):
        kept = simhash.deduplicated(df)
        assert kept.columns == df.columns
        groups = {(i, c) for i, _, c in brute_groups([(r["doc_id"], r["text"]) for r in df.collect()])}
        assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(c) for c in {c for _, c in groups})


def test_deduplicated_keeps_unrelated_groups_apart(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(10**6)) for _ in range(40)) for _ in range(6)]
    rows = [(None, t, "en", "a") for t in texts[:4]] + [(None, texts[0], "en", "a")] + [(7, t, "en", "a") for t in texts[4:]] + [(7, texts[4], "en", "a"), (9, texts[5], "en", "a"), (8, texts[3], "en", "a")]
    got = Counter((r["doc_id"], r["text"]) for r in simhash.deduplicated(frame(spark, rows)).collect())
    assert got == Counter([(None, t) for t in texts[:3]] + [(8, texts[3])] + [(7, t) for t in texts[4:]])


# --- language ID ---


def test_phrases_are_longest_matches():
    rng = random.Random(2)
    text = "".join(rng.choice("abcd ") for _ in range(300))
    start = language_id.automaton(text)
    for _ in range(200):
        q = "".join(rng.choice("abcd e") for _ in range(rng.randrange(1, 60)))
        n = i = 0
        while i < len(q):
            k = 1
            while i + k < len(q) and q[i : i + k + 1] in text and q[i] in text:
                k += 1
            n, i = n + 1, i + k
        assert language_id.phrases(start, q) == n


def test_language_id(docs, odd):
    got = language_id.identify(docs).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    for r in language_id.identify(odd).collect():
        if r["doc_id"] in (1, 2, 3):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert language_id.identify(odd).count() == len(ODD) and language_id.identify(odd.limit(0)).count() == 0
    kept = language_id.accepted(odd)
    assert kept.columns == odd.columns and kept.where("doc_id IN (1, 2, 3)").count() == 0 and kept.where("doc_id = 4").count() == 2


@pytest.mark.parametrize("stretch", [1, 3, 16, 256])
def test_tables_parse_as_automata_do(monkeypatch, stretch):
    """Whole texts, phrases across words, whatever the stretches that are parsed side by side."""
    monkeypatch.setattr(language_id, "STRETCH", stretch)
    rng = random.Random(3)
    text = " " + "".join(rng.choice("abcdé ") for _ in range(2000))
    start = language_id.automaton(text)
    table = language_id.Table(start)
    texts = ["".join(rng.choice("abcdéxz日 ") for _ in range(rng.randrange(0, 60))) for _ in range(300)] + ["ab" * 400, "x" * 300, text, text[7:] + text, ""]
    texts += ["".join(rng.choice("abcdé ") for _ in range(3000)) for _ in range(3)]
    want = [language_id.phrases(start, t) if t else 0 for t in texts]
    assert table.phrases(texts).tolist() == want
    assert table.phrases([text]).tolist() == [1] and table.phrases([""]).tolist() == [0] and table.phrases([]).tolist() == []
    table.next, table.start = None, start
    assert table.phrases(texts[:-3]).tolist()[:300] == want[:300]


def brute_language(text, samples):
    """Longest matches of the whole text found by looking for substrings."""
    import regex

    t = " ".join(regex.findall(r"\p{L}+", (text or "").lower()))
    if not t or not samples:
        return "und", 0.0
    costs = []
    for lang, known in samples:
        n = i = 0
        while i < len(t):
            k = 1
            while i + k < len(t) and t[i : i + k + 1] in known:
                k += 1
            n, i = n + 1, i + k
        costs.append((n * math.log2(len(known) + 1) / len(t), lang))
    costs.sort()
    return costs[0][1], 1 - costs[0][0] / costs[1][0] if len(costs) > 1 else 1.0


def test_language_id_against_brute_force(spark, docs, odd):
    more = frame(spark, [(100 + i, t, "en", "a") for i, t in enumerate(["\u00b2 \u00bd \u2462 12 _", "a\u00b2b", "\u216f", "Stra\u00dfe", "x" * 5000, "the and of " * 5000])])
    for df in (docs, odd, more):
        samples = language_id.train(docs, language_id.learnable())
        got = {(r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in language_id.identify(df, samples).collect()}
        for r in df.limit(60).collect():
            lang, score = brute_language(r["text"], samples)
            assert (r["doc_id"], lang, round(score, 9)) in got
    assert {r["lang_pred"] for r in language_id.identify(more).where("doc_id IN (100, 102)").collect()} == {"und"}


def test_training_rows_are_whole_bounded_and_taken_once(spark):
    rows = [(7, "hello there again", "en", "a")] * 500 + [(i, f"wort {'lang ' * (i % 5)}zz{i}", "de", "a") for i in range(400)] + [(None, "hidden", "en", "a"), (9000, "unlabelled", None, "a"), (9001, "y" * 9000 + " end", "fr", "a"), (9002, None, "fr", "a")]
    samples = dict(language_id.train(frame(spark, rows), F.lit(True)))
    assert samples["en"] == " hello there again" and samples["fr"] == " " + "y" * 9000 + " end"
    assert samples["de"].count("wort") == language_id.ROWS and set(samples) == {"de", "en", "fr"}


def test_accepted_fills_null_languages(spark, docs):
    own = frame(spark, [(r["doc_id"], r["text"], None if r["doc_id"] % 2 else r["lang"], "a") for r in docs.collect()])
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    kept = language_id.accepted(own).collect()
    assert sum(r["lang"] == truth[r["doc_id"]] for r in kept) >= 0.95 * len(kept) > 0 and all(r["lang"] for r in kept)
    only = language_id.accepted(own, languages=("de",)).collect()
    assert 0 < len(only) < len(kept)


def test_without_labels_documents_stay(spark, odd):
    bare = odd.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.accepted(bare).count() == len(ODD)


# --- nearest neighbours ---


def test_rows_that_share_an_id_all_take_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (50, [1.0, 0.0]), (50, [0.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in ann.search(df, F.col("vec_id") % 50 == 0, books=2).collect())
    want = Counter()
    for i, (q, x) in enumerate(rows):
        if q % 50 == 0:
            near = sorted((-round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)), 9), v) for j, (v, y) in enumerate(rows) if j != i)
            want.update((q, k + 1, v, -c + 0.0) for k, (c, v) in enumerate(near[:5]))
    assert got == want


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    m = rng.standard_normal((900, 16)).astype(np.float32)
    m[300:330] = m[0]  # ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    rows += [(901, None), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [float("inf")] + [0.0] * 15), (905, [1.0, None] + [0.0] * 14), (906, []), (None, rows[5][1]), (907, [1.0, 2.0]), rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(df, F.col("vec_id") % 50 == 0, books=8, keep=100).collect()
    x = m.astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = {}
    for r in got:
        found.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
        assert math.isclose(r["score"], float(u[r["query_id"]] @ u[r["vec_id"]]), abs_tol=1e-9)
    hit = 0
    for q in range(0, 900, 50):
        cos = np.round(u @ u[q], 9)
        cos[q] = -2
        best = [int(i) for i in np.lexsort((np.arange(900), -cos))[:5]]
        hit += len(set(best) & set(found[q].values()))
        assert sorted(found[q]) == [1, 2, 3, 4, 5]
    assert hit >= 0.9 * 18 * 5 and [found[0][k] for k in range(1, 6)] == [300, 301, 302, 303, 304]
    few = ann.search(df.where("vec_id < 3"), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r["query_id"], r["rank"]) for r in few) == [(0, 1), (0, 2)]
    assert ann.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def recall(spark, m, **options):
    df = spark.createDataFrame([(i, v.tolist(), "x", "x", "x") for i, v in enumerate(m)], "vec_id long, embedding array<float>, x string, code string, norm string")
    found = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0, **options).collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    u = m.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = 0
    for q in range(0, len(m), 50):
        cos = u @ u[q]
        cos[q] = -2
        hit += len(set(np.lexsort((np.arange(len(m)), -cos))[:5].tolist()) & set(found[q]))
    return hit / (5 * len(range(0, len(m), 50)))


def test_recall_with_registered_parameters(spark, monkeypatch):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((60, 64))
    m = (centres[rng.integers(0, 60, 12000)] + 0.7 * rng.standard_normal((12000, 64))).astype(np.float32)
    assert recall(spark, m) >= 0.9
    monkeypatch.setattr(ann, "QUERIES_AT_ONCE", 20)  # several passes find the same
    assert recall(spark, m[:3000]) >= 0.9


def test_nearest_within_a_crowd_of_near_copies(spark):
    rng = np.random.default_rng(11)
    m = rng.standard_normal((4000, 64)).astype(np.float32)
    m[:1500] = m[0] + 1e-3 * rng.standard_normal((1500, 64))  # far more than are reranked, and too near for the codes
    m[2000:2600] = m[2000]  # equal ones: the smaller ids
    assert recall(spark, m, books=8) >= 0.9
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    got = ann.search(df, F.col("vec_id") == 2550, books=4).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [2000, 2001, 2002, 2003, 2004]
    crowd = ann.search(df, F.col("vec_id") == 50).collect()
    u = m.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    cos = u @ u[50]
    cos[50] = -2
    assert {r["vec_id"] for r in crowd} == set(np.argsort(-cos)[:5].tolist())


def test_vectors_of_any_magnitude(spark):
    rows = [(0, [1.0, 0.5]), (1, [1e200, 1e200]), (2, [1e-200, 0.0]), (3, [5e-324, 5e-324]), (4, [1.7e308, -1.7e308]), (5, [0.0, 3.0]), (6, [-0.0, 0.0])]
    got = {r["vec_id"]: r["score"] for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, books=2).collect()}
    want = {1: 1.5 / math.sqrt(2.5), 2: 1 / math.sqrt(1.25), 3: 1.5 / math.sqrt(2.5), 4: 0.5 / math.sqrt(2.5), 5: 0.5 / math.sqrt(1.25)}
    assert set(got) == set(want) and all(math.isclose(got[i], x, rel_tol=1e-12) for i, x in want.items())


# --- chat formatting ---


def test_chat_format(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, "user", "ab"), (5, 0, None, None), (5, 1, "user", ""), (6, 0, None, ""), (None, 0, "user", "z"), (7, 0, "user", "a"), (7, 0, "user", "a")]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "conv_id long, turn long, role string, text string, hashes string, last string")
    convs = {}
    for c, t, r, x in sorted(rows, key=lambda v: tuple((y is not None, y) for y in v)):
        convs.setdefault(c, []).append((r, x))
    keep = {}
    for c in sorted(convs, key=lambda c: (c is None, c or 0)):
        keep.setdefault(tuple(convs[c]), []).append(c)
    want = {(cs[0], len(k), len(cs)) for k, cs in keep.items() if not any(len(o) > len(k) and o[: len(k)] == k for o in keep)}
    got = chat_format.chat_format(df).collect()
    assert {(r["conv_id"], r["n_turns"], r["n_copies"]) for r in got} == want
    assert next(r["chat"] for r in got if r["conv_id"] == 5) == "<|unknown|>\n\n<|end|>\n<|user|>\n\n<|end|>\n"
    assert chat_format.chat_format(df.limit(0)).count() == 0


# --- decontamination ---


def test_lcs():
    rng = random.Random(3)
    for _ in range(100):
        a, b = [rng.choice("abc") for _ in range(rng.randrange(1, 20))], [rng.choice("abcd") for _ in range(rng.randrange(0, 30))]
        row = [0] * (len(b) + 1)
        for x in a:
            old, row = row, [0]
            for j, y in enumerate(b):
                row.append(old[j] + 1 if x == y else max(row[-1], old[j + 1]))
        assert decontam.lcs(decontam.masks(a), len(a), b) == row[-1]
        assert decontam.lcs(decontam.masks(a), len(a), b, row[-1]) == row[-1]


def test_decontamination(spark, docs):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").unionByName(spark.createDataFrame([(None, None), (999, ""), (998, None)], "item_id long, text string"))
    items = {r["item_id"]: decontam.words_of(r["text"]) for r in bench.collect() if decontam.words_of(r["text"])}
    item = next(t for i, t in items.items() if len(t) >= 30)
    words = [w.decode() for w in item]
    para = [w if k % 5 else "anders" for k, w in enumerate(words)]
    filler = docs.where("lang = 'en' AND n_chars > 3000").first()["text"]
    own = frame(spark, [(10**6, filler[:1500] + "\n" + " ".join(para) + "\n" + filler[1500:], "en", "a"), (10**6 + 1, None, "en", "a"), (10**6 + 2, "", "en", "a"), (10**6 + 3, " ".join(words), "en", "a"), (10**6 + 3, " ".join(words), "en", "a"), (None, "x y z", "en", "a")])
    df = docs.select("doc_id", "text").unionByName(own.select("doc_id", "text"))
    got = decontam.contaminated(df, bench).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    spaced = lambda ws: b" " + b" ".join(ws) + b" "
    exact = {(r["doc_id"], i) for r in df.collect() for i, t in items.items() if spaced(t) in spaced(decontam.words_of(r["text"]))}
    target = next(i for i, t in items.items() if t == item)
    assert exact | {(10**6, target)} <= pairs
    assert len(pairs - exact - {(10**6, target)}) <= 2
    assert sum(r["doc_id"] == 10**6 + 3 and r["item_id"] == target for r in got) == 2
    clean = decontam.decontaminated(own, bench)
    assert clean.columns == own.columns and Counter(r["doc_id"] for r in clean.collect()) == Counter([10**6 + 1, 10**6 + 2, None])
    assert decontam.contaminated(df, bench.limit(0)).count() == 0 and decontam.contaminated(df.limit(0), bench).count() == 0


@pytest.mark.parametrize("part", [0.35, 0.39])
def test_far_paraphrases_of_the_longest_items(spark, docs, part):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    items = sorted(((r["item_id"], [w.decode() for w in decontam.words_of(r["text"])]) for r in bench.collect()), key=lambda x: -len(x[1]))[:8]
    filler = docs.where("lang = 'en' AND n_chars > 3000").first()["text"]
    rows = []
    for i, ws in items:
        n = int(part * len(ws))
        new = {int((j + 0.5) * len(ws) / n) for j in range(n)}  # evenly spread
        assert len(ws) - len(new) >= 0.6 * len(ws)
        rows.append((10**6 + i, filler[:1500] + " " + " ".join(f"anders{j}" if j in new else w for j, w in enumerate(ws)) + " " + filler[1500:], "en", "a"))
    df = docs.select("doc_id", "text").unionByName(frame(spark, rows).select("doc_id", "text"))
    pairs = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(df, bench).collect()}
    assert {(10**6 + i, i) for i, _ in items} <= pairs


def test_no_pair_that_passes_in_a_window_is_skipped():
    rng = random.Random(8)
    vocabulary = [b"w%d" % i for i in range(60)]
    items = [(i, [rng.choice(vocabulary) for _ in range(rng.randrange(15, 60))]) for i in range(12)]
    weights = {w: 1 + 5 * rng.random() for _, ws in items for w in ws}
    words = sorted(weights)
    x = np.array([[weights[w] * (w in ws) for w in words] for _, ws in items])
    for rank in (12, 5):  # all directions, and fewer than there are passages
        v = np.linalg.svd(x, full_matrices=False)[2][:rank].T
        latent = [(np.arange(12), words, *decontam.fitted([ws for _, ws in items], words, weights, v))]
        m = decontam.Matcher({"items": items, "weights": weights, "other": 6.0, "latent": latent}, 0.99, 0.6, 0.5)
        for _ in range(40):
            _, ws = items[rng.randrange(12)]
            doc = [b"o%d" % i for i in range(rng.randrange(80))] + [w if rng.random() < 0.64 else rng.choice(vocabulary) for w in ws] + [b"p%d" % i for i in range(rng.randrange(80))]
            got = {h[0] for h in m.find([b" ".join(doc).decode()])[0]}
            for i, item in items:
                full = lambda a, b: decontam.lcs(decontam.masks(a), len(a), b)
                tail = item[-max(1, -(-len(item) // 3)) :]
                parts = [doc[a : a + len(item)] for a in range(len(doc))]
                if any(full(item, p) >= 0.6 * len(item) and full(tail, p) >= 0.5 * len(tail) for p in parts):
                    assert i in got


def test_the_svd_decides_what_is_checked(spark, docs):
    """With random directions in place of the SVD's the finds are the same (nothing may be lost), but far more windows reach an item's need."""
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    model = decontam._model(docs, bench.withColumn("block", F.lit(0)).select("item_id", "text", "block"))
    texts = [r["text"] for r in docs.collect()]
    svd = decontam.Matcher(model, 0.45, 0.6, 0.5)
    own, words, v, _ = model["latent"][0]
    drawn = np.linalg.qr(np.random.default_rng(1).standard_normal(v.shape))[0]
    random_ = decontam.Matcher(model | {"latent": [(own, words, *decontam.fitted([ws for _, ws in model["items"]], words, {w: model["weights"][w] for w in words}, drawn))]}, 0.45, 0.6, 0.5)
    pairs = lambda m: [{h[0] for h in hits} for hits in m.find(texts)]
    assert pairs(svd) == pairs(random_) and any(pairs(svd))
    assert svd.checked < random_.checked / 20


def test_very_short_items_match_nothing(spark, docs):
    bench = spark.createDataFrame([(1, "the"), (2, "of the and a"), (3, None), (4, "..."), (5, "five words that stand together")], "item_id long, text string")
    df = frame(spark, [(1, "the and of the a", "en", "a"), (2, "here are five words that stand together at last", "en", "a")])
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(df, bench).collect()} == {(2, 5)}
    assert decontam.decontaminated(df, bench).count() == 1


def test_latent_directions_are_those_of_the_svd(spark):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    items = [decontam.words_of(r["text"]) for r in bench.collect()]
    idf = {w: 1 + len(w) / 3 for ws in items for w in ws}
    words, v = decontam.latent_directions(bench, idf, len(items) // 2)
    x = np.array([[idf[w] * (w in set(ws)) for w in words] for ws in items])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    best = np.linalg.svd(x, compute_uv=False)[: v.shape[1]]
    assert v.shape[1] == len(items) // 2 and np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-6)
    assert (np.linalg.norm(x @ v) ** 2) >= 0.97 * (best**2).sum()
    again = decontam.latent_directions(bench.repartition(7), idf, len(items) // 2)[1]
    assert (again == v).all()  # fixed-point sums: every run gives the same


def brute_found(texts, items, n, df):
    """(pairs that must be found: those that pass in a window, or near one at the cosine; pairs that may be: all that pass near a window), by full LCS tables."""
    idf = lambda w: min(decontam.CAP, math.log((n + decontam.SMOOTH) / (1 + df.get(w, 0))) + 0.1)
    known = {w for ws in items.values() for w in ws}

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old, row = row, [0]
            for j, y in enumerate(b):
                row.append(old[j] + 1 if x == y else max(row[-1], old[j + 1]))
        return row[-1]

    must, may = set(), set()
    for d, text in texts:
        ws = decontam.words_of(text)
        for i, item in items.items():
            m, width = len(item), 1 << max(4, math.ceil(math.log2(2 * len(item))))
            for at in range(0, max(1, len(ws)), width // 2):
                window = ws[at : at + width]
                shared = sum(idf(w) ** 2 for w in set(window) & set(item))
                norm = math.sqrt(sum(idf(w) ** 2 for w in set(window) & known) + sum(idf(b"") ** 2 for w in window if w not in known))
                own = math.sqrt(sum(idf(w) ** 2 for w in set(item)))
                near, tail = ws[max(0, at - m) : at + width + m], item[-max(1, -(-m // 3)) :]
                if len(set(near) & set(item)) > 4 and longest(item, near) >= 0.6 * m and longest(tail, near) >= 0.5 * len(tail):
                    may.add((d, i))
                    if shared / norm / own >= decontam.COSINE or longest(item, window) >= 0.6 * m:
                        must.add((d, i))
                if at + width >= len(ws):
                    break
    return must, may


def test_decontamination_against_brute_force_under_any_partitioning(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    items = {r["item_id"]: decontam.words_of(r["text"]) for r in bench.collect()}
    rng, rows = random.Random(12), []
    fill = [w for r in docs.where("lang = 'en'").limit(20).collect() for w in (r["text"] or "").split()]
    for k, (i, ws) in enumerate(items.items()):
        part = [w.decode() if rng.random() > 0.5 * k / len(items) else rng.choice(fill) for w in ws]
        rows.append((10**6 + k, " ".join(rng.choices(fill, k=rng.randrange(90)) + part + rng.choices(fill, k=rng.randrange(90))), "en", "a"))
    df = frame(spark, rows).select("doc_id", "text")
    seen = Counter(w for r in rows for w in set(decontam.words_of(r[1])))
    want, most = brute_found([(r[0], r[1]) for r in rows], items, len(rows), seen)
    first = Counter(decontam.contaminated(df, bench).collect())
    got = {(r["doc_id"], r["item_id"]) for r in first}
    assert len(want) > 20 and want <= got <= most
    for n in (1, 7, 50):
        assert Counter(decontam.contaminated(df.repartition(n), bench).collect()) == first
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    assert Counter(decontam.contaminated(df, bench).collect()) == first
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    # several passes of several blocks find the same pairs but for what other latent directions add
    monkeypatch.setattr(decontam, "ITEMS_IN_BLOCK", 3)
    monkeypatch.setattr(decontam, "BLOCKS_IN_PASS", 2)
    assert len(decontam._passes(bench)) > 1
    parts = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(df, bench).collect()}
    assert want <= parts <= most
    assert {r["doc_id"] for r in decontam.decontaminated(df, bench).collect()} == {r[0] for r in rows} - {d for d, _ in parts}


def test_a_very_long_text_and_item(spark):
    rng = random.Random(13)
    long = [f"w{rng.randrange(5000)}" for _ in range(60000)]
    bench = spark.createDataFrame([(1, " ".join(long[20000:22500])), (2, " ".join(long[50000:50030])), (3, "nothing of that kind is here")], "item_id long, text string")
    got = decontam.contaminated(frame(spark, [(5, " ".join(long), "en", "a"), (6, " ".join(reversed(long)), "en", "a")]), bench).collect()
    assert {(r["doc_id"], r["item_id"], r["lcs"]) for r in got} == {(5, 1, 1.0), (5, 2, 1.0)}


# --- token IDs ---


@pytest.mark.parametrize("special", [False, True])
@pytest.mark.parametrize("cache", [token_output.CACHE, 50])
def test_unit_encoder_is_exact(docs, special, cache):
    from tokenizers import Tokenizer

    enc = token_output.UnitEncoder(tokenizer_path(), special, cache)
    texts = [r["text"] or "" for r in docs.collect()] + ["a  b", "a \n b", " lead", "trail ", "", "x\n\n y", "it's 'll <|endoftext|> é z", "<|endoftext|>", "a<|endoftext|>b", "\n", " ", "日本 12 3.4", "a,b. c,, %%, x.\x01y", "\x01", "É.\né,z", "a'b''c's'", "x\u00a0y z\u0301# q_r$$"]
    texts += ["".join(random.Random(i).choice("aZé ß1'.,-#_\n\t \u00a0\u0301日<|") for _ in range(60)) for i in range(200)]
    plain = Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = special
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    for part in (texts, texts[::-1]):  # learned units, and after sweeps of the cache
        ids, n = enc.encode(part)
        assert [list(x) for x in np.split(ids, np.cumsum(n)[:-1])] == (want if part is texts else want[::-1])
    enc.encode(texts[:3])
    assert len(enc.known) == len(enc.met) == len(enc.starts) and (cache > 50 or len(enc.known) <= 50)
    assert (50256 in enc.encode(["a <|endoftext|> b"])[0]) != special


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    enc, texts = token_output.UnitEncoder(path), ["It's a Word, or two.\nAnd  three", "", "x"]
    ids, n = enc.encode(texts)
    assert not enc.by_units and [list(x) for x in np.split(ids, np.cumsum(n)[:-1])] == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_token_files(spark, docs, odd, tmp_path):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path())
    marks = frame(spark, [(i % 3, f"a <|endoftext|> b{i % 2}", "en", "a") for i in range(40)])
    for k, df in enumerate((docs, odd, marks)):
        out = f"file://{tmp_path}/t{k}"
        got = token_output.digest(token_output.tokenized(df, tokenizer_path(), out)).orderBy("start").collect()
        want = Counter()
        for r in df.collect():
            ids = tk.encode(r["text"] or "", add_special_tokens=False).ids + [2]
            want[r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
        start = 0
        for r in got:
            assert r["start"] == start
            start += r["n_tokens"]
        order = [r["doc_id"] for r in got]
        assert order == sorted(order, key=lambda i: (i is not None, i))
    assert token_output.digest(token_output.tokenized(odd.limit(0), tokenizer_path(), f"file://{tmp_path}/e")).count() == 0


def test_token_files_are_selective(docs, tmp_path):
    import pyarrow.parquet as pq

    token_output.write_tokens(docs, tokenizer_path(), f"file://{tmp_path}/t", rows_in_file=50)
    files = sorted(tmp_path.glob("t/*.parquet"))
    assert len(files) == 4
    row = pq.ParquetFile(files[0]).metadata.row_group(0)
    columns = {row.column(i).path_in_schema: row.column(i) for i in range(row.num_columns)}
    assert any("DELTA" in e for e in columns["doc_id"].encodings)
    assert any("DICTIONARY" in e for p, c in columns.items() if p.startswith("ids") for e in c.encodings)
    assert all(c.has_offset_index for c in columns.values())


# --- HTML ---


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""), ("", ""), ("<p>x", ""), ("<html><body><article><h1>T&amp;x</h1><p>a  b<br>c</p></article><footer>f</footer></body></html>", "T&x a b c"),
        ("<body><nav>menu <nav>deep</nav> more</nav><article><script>var t='</p>';</script><p>one <b>two</b>three</p><div class='ad'>buy</div><ul><li>i<li>j</ul><aside>s</aside><form>f</form></article><div id=comments><p>me</p></div>", "one twothree i j"),
        ("<article><p>kept<p>too</article><footer>&copy; cut o", "kept too"),
        ("<article><p class='notice'>no<p>yes</p><p class=ad>buy</p>so<p class='x'>on</p></article>", "yes so on"),
        ("<article><p title='a>b'>x &lt;y&gt; &#233;</p><!-- <p>no</p> --></article>", "x <y> é"),
    ],
)
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


def test_pages_without_an_article():
    long = "word " * 40
    page = f"<body><div>Home</div><div>About</div><h1>Title</h1><p>{long}</p><p>short end.</p><p>{long}</p><div>Legal</div><div>x</div><div>y</div>"
    got = html_extract.main_text(page)
    assert got.startswith("Title word") and got.count("word") == 80 and "short end." in got and "Home" not in got and "Legal" not in got


def test_short_lines_without_an_article():
    verse = [f"a short line of verse {i}" for i in range(12)]
    assert html_extract.main_text("<body>" + "".join(f"<p>{v}</p>" for v in verse)) == " ".join(verse)
    long = "word " * 40 + "end."
    page = f"<div>Home</div><div>Shop</div><p>A first line, short.</p><p>{long}</p><ul>" + "".join(f"<li>item {i}</li>" for i in range(4)) + f"</ul><p>{long}</p><p>The closing line.</p><div>Legal</div>"
    got = html_extract.main_text(page)
    assert got.startswith("A first line, short. word") and got.endswith("end. The closing line.") and "item 0 item 1 item 2 item 3" in got


def test_wrappers_are_not_boilerplate():
    long = "word " * 40 + "end."
    assert html_extract.main_text(f"<div class='site has-sidebar'><div class=sidebar>links</div><p>{long}</p></div><div>x</div>") == long
    assert html_extract.main_text(f"<div class='menu-open'><article><p>a b</p></article><div id=comments><p>{long}</p></div></div>") == "a b"


def test_class_names_count_by_whole_words():
    quiet = ["related-work", "share-price", "search-results", "header-files", "noticeable", "adventure", "comment-analysis", "social-history", "menu-engineering", "side", "list-item", "main-content"]
    loud = ["ad", "ads", "ad-box", "adBox2", "cookie_notice", "site-header", "nav-menu", "comment-list", "post-comments", "share-buttons", "side-bar", "related-posts", "newsletter", "widget-ad-slot"]
    assert not [c for c in quiet if html_extract.noise(c)] and all(map(html_extract.noise, loud))
    page = "<article><h1>T</h1>" + "".join(f"<div class='{c} x'><p>text of {c} here.</p></div>" for c in quiet) + "".join(f"<div class='y {c}'><p>bad {c}.</p></div>" for c in loud) + "</article>"
    assert html_extract.main_text(page) == "T " + " ".join(f"text of {c} here." for c in quiet)


def test_the_distribution_decides_within_marked_articles_too():
    long = "word " * 400 + "end."
    far = "<p>&middot;</p>" * 12
    got = html_extract.main_text(f"<article><h1>Title</h1><p>{long}</p><ul><li>1<li>2</ul><p>{long}</p>{far}</article>")
    assert got.startswith("Title word") and "end. 1 2 word" in got and got.count("\u00b7") <= 2
    assert html_extract.main_text("<body><h1>News</h1><p>Hello there</p>") == "News Hello there"


def brute_kept(blocks, window=3, least=80):
    """The rule, told over characters instead of by formulas."""
    marked = [b for b in blocks if b[1]]
    blocks = marked or blocks
    chars = [i for i, b in enumerate(blocks) for _ in b[0]]
    sums = {i: sum(len(b[0]) for b in blocks[i : i + window]) for i in range(max(1, len(blocks) - window + 1))}
    in_sums = [x for x in sums.values() for _ in range(x)]
    average = sum(in_sums) / len(in_sums)
    threshold = min(6, average / 50) if marked else min(least, average / 10)
    surge = [i for i, x in sums.items() if x >= threshold]
    keep = set()
    for i in surge:
        keep |= set(range(i, min(i + window, len(blocks))))
        after = [j for j in surge if j > i]
        if after and after[0] - min(i + window, len(blocks)) <= 2 * window:
            keep |= set(range(i, after[0]))
    short = max(2, min(least / 4, sum(len(blocks[i][0]) for i in chars) / len(chars) / 20))
    weak = lambda i: len(blocks[i][0]) < short and not blocks[i][2] and blocks[i][0][-1] not in html_extract._ENDS
    out, run = [], []
    for i in [*sorted(keep), 10**9]:
        if run and i != run[-1] + 1:
            while run and not marked and weak(run[0]):
                run.pop(0)
            while run and not marked and (weak(run[-1]) or blocks[run[-1]][2]):
                run.pop()
            out += run
            run = []
        run.append(i)
    return [blocks[i][0] for i in out]


def test_kept_lines_against_brute_force():
    rng = random.Random(5)
    for n in range(400):
        inside = rng.random() < 0.4
        blocks = [("w" * rng.choice([1, 2, 5, 20, 90, 400]) + rng.choice(["", ".", "x"]), inside and rng.random() < 0.8, rng.random() < 0.1) for _ in range(rng.randrange(1, 40))]
        assert html_extract.kept(blocks) == brute_kept(blocks)


def test_long_pages_take_time_in_proportion():
    import time

    def seconds(n):
        page = "<body>" + "<div class=ad><p>buy</p></div><p>some text of the page here</p>" * n + "x" * n
        began = time.process_time()
        assert html_extract.main_text(page).count("some text") == n
        return time.process_time() - began

    seconds(500)
    assert seconds(16000) < 40 * max(seconds(1000), 0.01)


def test_pages_with_article_tags_taken_off():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    import pyarrow.parquet as pq

    lost = more = total = 0
    for page in pq.read_table(DATA.replace("0.001", "0.01") + "/pages.parquet")["html"].to_pylist():
        want = Counter(html_extract.main_text(page).split())
        got = Counter(html_extract.main_text(re.sub(r"</?(article|main)\b[^>]*>", "", page or "")).split())
        lost, more, total = lost + (want - got).total(), more + (got - want).total(), total + want.total()
    assert lost <= 0.002 * total and more <= 0.002 * total


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>a</p></article>", "x"), (1, "u", "<article><p>a</p></article>", "x"), (None, None, None, "x")], "page_id long, url string, html string, text string")
    assert Counter(map(tuple, html_extract.extract(pages).collect())) == Counter([(1, "u", "a", 1)] * 2 + [(None, None, "", 0)])
    assert html_extract.extract(pages.limit(0)).count() == 0


# --- toxicity ---


def test_folding_and_exceptions():
    lex = toxicity.Lexicon({"idiot": 4.0, "clown": 2.0, "stem": 3.0})
    hit = lambda t: lex.measure(t)[0] > 0
    assert all(map(hit, ["you idiot", "you 1d10t!", "you idіоt", "IDIOT", "a stemming"]))
    assert not any(map(hit, [None, "", "a clown fish", "xidiot", "system"]))
    assert lex.measure("idiot")[1] > lex.measure("idiot " + "word " * 500)[1]


def test_toxicity_against_brute_force(spark, docs):
    """The whole operator in plain loops: sample halves by hash, log-odds, curve, score."""
    import struct

    import xxhash

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    texts, y = {r["doc_id"]: r["text"] for r in docs.collect()}, {}
    for r in labels.collect():
        if r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            y[r["doc_id"]] = max(y.get(r["doc_id"], 0), r["toxic"])
    half = {i: xxhash.xxh64_intdigest(struct.pack("<i", 3), seed=xxhash.xxh64_intdigest(struct.pack("<q", i), seed=42)) % 2 for i in y}
    teach = [i for i in y if half[i] == 0 and i in texts]
    nt, nc = sum(y[i] for i in teach), sum(1 - y[i] for i in teach)
    weights, seen = dict(toxicity.INSULTS), {}
    for i in teach:
        for f in toxicity.features(texts[i]):
            seen.setdefault(f, [0, 0])[1 - y[i]] += 1
    for f, (t, c) in seen.items() if nt and nc else ():
        w = math.log((t + 0.1) / (nt + 0.2)) - math.log((c + 1.0) / (nc + 2.0))
        if t >= max(toxicity.SUPPORT, math.ceil(0.005 * nt)) and w >= toxicity.ODDS:
            weights[f] = w
    lexicon = toxicity.Lexicon(weights)
    fit = [(lexicon.measure(texts[i]), y[i]) for i in sorted(y) if half[i] == 1 and i in texts]
    bias, a, b = toxicity.logistic(np.array([[1.0, *m] for m, _ in fit]), np.array([v for _, v in fit]))
    for r in toxicity.toxicity(docs, labels).collect():
        s, d = lexicon.measure(texts[r["doc_id"]])
        assert math.isclose(r["score"], 1 / (1 + math.exp(-max(-30, min(30, bias + a * s + b * d)))), rel_tol=1e-6, abs_tol=1e-9)


def test_no_entry_is_cut_off(spark):
    bad = ["".join(random.Random(k).choices("bcdfgklmnprstvz", k=9)) for k in range(1700)]
    rows = [(i, " ".join(bad if i % 2 else ["calm", "words", "only"]), "en", "a") for i in range(120)]
    weights, _ = toxicity.learn(frame(spark, rows), spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int"))
    assert len(weights) > 5000 and all(w + " " in weights for w in bad)


def test_very_long_texts_score(spark):
    lex = toxicity.Lexicon({"idiot": 4.0})
    assert lex.measure("calm " * 400000 + "idiot")[0] == lex.measure("idiot")[0]


def test_toxicity(spark, odd):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(rng.randrange(9) + 2)[:0] for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            words[5] = words[30] = "zorkel" + rng.choice(["", "n", "ung"])
        rows.append((i, " ".join(words), "en", "a"))
        labels.append((i, int(toxic)))
    y = spark.createDataFrame(labels + [(1, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(frame(spark, rows), y).collect()
    want = dict(labels)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["predicted"] == want[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert toxicity.toxicity(odd, y.limit(0)).count() == len(ODD)
    assert toxicity.toxicity(odd.limit(0), y).count() == 0


def test_toxicity_learns_from_an_id_once(spark):
    """An id that repeats with other texts is learned from once, so the sample bounds the rows."""
    rows = [(7, f"text number {i}", "en", "a") for i in range(3000)] + [(i, "plain words", "en", "a") for i in range(100, 400)]
    y = spark.createDataFrame([(7, 1)] + [(i, i % 2) for i in range(100, 400)], "doc_id long, toxic int")
    learned = toxicity._labelled(frame(spark, rows), y, 50).collect()
    assert 0 < len(learned) <= 50
    whole = toxicity._labelled(frame(spark, rows), y, 10**6)
    assert whole.count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in [7, *range(100, 400)])
    assert whole.where("text like 'text number%'").count() == 1


def test_many_exceptions_in_one_text():
    import time

    lex = toxicity.Lexicon({"idiot": 4.0, "clown": 2.0})
    began = time.time()
    a = lex.measure("clown fish idiot " * 100_000)
    assert time.time() - began < 20 and a[0] == pytest.approx(math.log1p(4.0 * 100_000))
    assert lex.measure("clown fish " * 1000)[0] == 0.0


def test_long_conversations_take_linear_time(spark):
    """One conversation of 100,000 turns, its own snapshots, and a conversation of null ids; spread over parts, hashed by sums."""
    n = 100_000
    long = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), F.col("id") % 97).alias("text"))
    snaps = [long.where(F.col("turn") < k).withColumn("conv_id", F.lit(k).cast("long")) for k in (10, 5000, n - 1)]
    other = long.where("turn < 20000").withColumn("conv_id", F.lit(None).cast("long")).withColumn("role", F.when(F.col("turn") == 19999, "bot").otherwise(F.col("role")))
    df = long.unionByName(snaps[0]).unionByName(snaps[1]).unionByName(snaps[2]).unionByName(other).unionByName(long.withColumn("conv_id", F.lit(2).cast("long")))
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"], len(r["chat"])) for r in chat_format.chat_format(df).collect()}
    line = lambda role, t: len(f"<|{role}|>\n{t}\n<|end|>\n")
    assert got == {1: (n, 2, sum(line("user", f"t{i % 97}") for i in range(n))), None: (20000, 1, sum(line("user", f"t{i % 97}") for i in range(20000)) - 1)}
    assert chat_format.snapshots(df).count() == df.count()
