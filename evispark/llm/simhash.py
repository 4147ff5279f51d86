"""SimHash near-dedup by anchor-point covering.

Fingerprints: lower-cased (A-Z) words between ASCII white space, 3-word shingles with repeats, XXH64 (seed 42) of each, and a
bit for each position that over half of the hashes have set.

Links (3 or fewer differing bits): of two halves of 32 bits, one at least differs in 1 bit or none. A half is 31 coded bits and
one plain bit. The covering code is the perfect Hamming [31, 26] code: each 31-bit word lies within 1 bit of exactly one code
word, its home anchor. A fingerprint y is replicated to every anchor within covering radius plus threshold (1 + 1) of its
half, at most 17 keys, and x, which differs by a bit, waits at its home anchor, one of them. Pairs are compared per anchor on
all 64 bits; nothing is missed. Only distinct fingerprints take part, so copies cost nothing.

Components: large-star / small-star rounds over the links, each written to the shared folder.

Defined cases: null or empty texts have fingerprint zero and are linked like any other; a null doc_id never is a component's
id unless all its ids are null; repeated rows each give a row; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

DISTANCE, WORDS = 3, 3


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    import numpy as np
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(w, w[1:], w[2:])) if len(w) >= WORDS else [b" ".join(w)]
    hashes = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], dtype="<u8")
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        total += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed long), th (hash of the text) for each row."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x - (1 << 64) if x >> 63 else x for x in fps], pa.int64()), b.column(2)], names=["doc_id", "fp", "th"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.lit(1), "text").alias("th")).mapInArrow(run, "doc_id long, fp long, th long")


#: Bits (as a mask of 31) whose position number 1..31 has bit j set: the parity checks of the Hamming code.
CHECKS = [sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1) for j in range(5)]


def _anchored(fps: DataFrame) -> DataFrame:
    """fp, part (0, 1), y (31 coded bits), plain (1 bit), s (syndrome: the position that the nearest code word differs in, or 0)."""
    halves = fps.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("part"))
    half = F.when(F.col("part") == 0, F.col("fp")).otherwise(F.shiftrightunsigned("fp", 32)).bitwiseAND(F.lit(0xFFFFFFFF))
    x = halves.withColumn("half", half).withColumn("y", F.col("half").bitwiseAND(F.lit(0x7FFFFFFF))).withColumn("plain", F.shiftright("half", 31))
    s = sum(((F.bit_count(F.col("y").bitwiseAND(F.lit(m))) % 2) * (1 << j) for j, m in enumerate(CHECKS)), F.lit(0))
    return x.withColumn("s", s.cast("int")).drop("half")


_KEY = "shiftleft(cast(part as bigint), 33) | shiftleft(cast({plain} as bigint), 32) | ({word})"
_FLIP = "(case when {p} = 0 then 0L else shiftleft(1L, {p} - 1) end)"
_HOME = f"y ^ {_FLIP.format(p='s')}"


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (u < v) of distinct fingerprints that differ in ``distance`` (at most 3) bits or fewer, each pair once."""
    if distance > 3:
        raise ValueError("halves cover up to 3 differing bits")
    x = _anchored(fps)
    home = x.select(F.col("fp").alias("u"), F.expr(_KEY.format(plain="plain", word=_HOME)).alias("anchor"))
    second = f"case when s > 0 then transform(filter(sequence(1, 31), i -> i != s and i < (i ^ s)), i -> {_KEY.format(plain='plain', word='y ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ s) - 1)')}) else cast(array() as array<bigint>) end"
    near = f"concat(array({_KEY.format(plain='plain', word=_HOME)}, {_KEY.format(plain='1 - plain', word=_HOME)}), {second})"
    spread = x.select(F.col("fp").alias("v"), "part", F.explode(F.expr(near)).alias("anchor"))
    apart = F.col("u").bitwiseXOR(F.col("v"))
    low = F.bit_count(apart.bitwiseAND(F.lit(0xFFFFFFFF))) <= 1  # such a pair meets in part 0, any other in part 1; each counts there only
    return home.join(spread, "anchor").where((F.col("u") < F.col("v")) & (F.bit_count(apart) <= distance) & ((F.col("part") == 0) == low)).select("u", "v")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of an edge (u, v)."""
    e = saved(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v")).distinct()
        mark = now
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = saved(small.union(low.select("u", "m")).distinct(), "edges")


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, th, fp, root (the least fingerprint of its group), component_id for each row."""
    rows = saved(fingerprints(docs), "fingerprints")
    fps = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("lo")), "distinct")
    roots = components(links(fps.select("fp")))
    labelled = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "lo", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("lo").alias("component_id"))
    per_fp = labelled.join(least, "root").select("fp", "root", "component_id")
    return rows.join(per_fp, "fp")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group, the one with the smallest id (null if it has no other; of rows with that id, the smallest text hash), columns kept."""
    g = grouped(docs.select("doc_id", "text"))
    first = g.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # rows of one group that share the smallest id: keep the smallest hash, and note whether it repeats
    keep = first.groupBy("root", "doc_id", "th").agg(F.count("*").alias("n"))
    keep = keep.groupBy("root").agg(F.min(F.struct("th", "n", "doc_id")).alias("k")).select(F.struct("k.doc_id", "k.th", "k.n").alias("__keep"))
    keep = saved(keep, "kept")
    rows = docs.select(F.struct("*").alias("__row"))
    r, k = F.col("__row"), F.col("__keep")
    on = r["doc_id"].cast("long").eqNullSafe(k["doc_id"]) & (F.xxhash64(F.lit(1), r["text"]) == k["th"])
    single = rows.join(keep.where("__keep.n = 1"), on, "left_semi")
    again = rows.join(keep.where("__keep.n > 1"), on, "left_semi").withColumn("__id", r["doc_id"]).withColumn("__th", F.xxhash64(F.lit(1), r["text"]))
    again = again.groupBy("__id", "__th").agg(F.first("__row").alias("__row")).select("__row")
    return single.union(again).select("__row.*")
