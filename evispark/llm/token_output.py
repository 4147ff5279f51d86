"""Token-ID / binary output: Parquet list columns, in ascending doc_id order, and reading them back.

Files hold part (the file's number), doc_id, local_start (tokens before the document in its file), n_tokens and ids. ids are
dictionary-encoded (50 k values fit a dictionary page), doc_id and local_start delta-encoded, row groups are kept small and
page indexes are written, so that a reader of one id range or of the metadata columns alone skips the rest.

Texts are encoded by the given tokenizer. It is asked once for each distinct unit, a stretch between spaces with the space in
front of it: a byte-level BPE's pre-tokenizer always starts a new piece at a space that follows a non-space, so the ids of a
text are those of its units. A piece also ends between a letter or digit and any other visible sign but an apostrophe, and around a line break
between visible characters; units end there too, which leaves fewer distinct ones. Texts in which white space stands before a
space, or which hold a special token's string, are encoded whole, as are all texts where the tokenizer is of another kind.
Special tokens' strings give their ids, as the tokenizers library does by itself; with ``special_as_text`` they are ordinary text.

Defined cases: null text counts as empty and gives the end token alone; null doc_id comes first; rows with the same id are
ordered by a hash of their text; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import pieces, scratch_dir

END, ROWS_IN_FILE, CACHE, FILES_TO_BROADCAST = 2, 4000, 400_000, 100_000
#: White space before a space, or the mark that units without a space in front of them get.
_AMBIGUOUS = "[\\s\\pZ\\x0b\\x1c-\\x1f\\x{85}] |\x01"


class UnitEncoder:
    """Token ids of many texts, by way of their distinct units.

    Known units are an Arrow array, so that a piece's units are looked up without making Python strings of them. When there
    are more than ``cache``, the half that was met most often of late stays.
    """

    def __init__(self, path: str, special_as_text: bool = False, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path), cache
        self.tokenizer.encode_special_tokens = special_as_text
        about = json.loads(self.tokenizer.to_str())
        before = about.get("pre_tokenizer") or {}
        #: Units stand for texts only where a byte-level pre-tokenizer splits them first and nothing rewrites them.
        self.by_units = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not about.get("normalizer") and about["model"]["type"] == "BPE"
        self.added = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(max([*vocabulary.values(), *self.tokenizer.get_added_tokens_decoder()]) + 2, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)  # in a byte-level vocabulary a character stands for a byte
        self.known, self.met = pa.array([], pa.large_string()), np.zeros(0, np.int64)
        self.starts, self.counts, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: list[str]) -> None:
        spaced = [u[1:] if u[:1] == "\x01" else " " + u for u in units]
        counts, starts, pools, at = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64), [self.pool], len(self.pool)
        alone = [i for i, u in enumerate(units) if not u or u[-1].isspace() or u[0] == "\x01"]
        apart = set(alone)
        joined = [i for i in range(len(units)) if i not in apart]
        parts = [joined[k : k + 512] for k in range(0, len(joined), 512)]
        for part, got in zip(parts, self.whole(["".join(spaced[i] for i in part) for part in parts]) if parts else []):
            ends = np.cumsum(self.bytes_of[got])
            want = np.cumsum([len(spaced[i].encode()) for i in part])
            cut = np.searchsorted(ends, want) + 1
            if len(ends) and ends[-1] == want[-1] and (ends[cut - 1] == want).all():  # tokens end where units end
                pools.append(got)
                counts[part] = np.diff(cut, prepend=0)
                starts[part] = at + cut - counts[part]
                at += len(got)
            else:
                alone += part
        for i, got in zip(alone, self.whole([spaced[i] for i in alone]) if alone else []):
            pools.append(got)
            counts[i], starts[i] = len(got), at
            at += len(got)
        self.known = pa.concat_arrays([self.known, pa.array(units, pa.large_string())])
        self.met = np.concatenate([self.met, np.zeros(len(units), np.int64)])
        self.starts, self.counts, self.pool = np.concatenate([self.starts, starts]), np.concatenate([self.counts, counts]), np.concatenate(pools)

    def _sweep(self) -> None:
        """Keeps the half of the units met most often since the last sweep (older meetings count half)."""
        kept = np.sort(np.argsort(-self.met, kind="stable")[: self.cache // 2])
        counts = self.counts[kept]
        upto = np.cumsum(counts)
        self.pool = self.pool[np.repeat(self.starts[kept] - upto + counts, counts) + np.arange(counts.sum())]
        self.known, self.met, self.starts, self.counts = self.known.take(pa.array(kept)), self.met[kept] // 2, upto - counts, counts

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of each text's ids) of a list or Arrow array of texts."""
        array = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        if not self.by_units:
            return self._whole(array.to_pylist())
        odd = pc.match_substring_regex(array, _AMBIGUOUS)
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(array, token))
        odd = odd.to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._units(array)
        out: list = [None] * len(array)
        for rows, ids, n in ((np.nonzero(~odd)[0], *self._units(array.filter(pa.array(~odd)))), (np.nonzero(odd)[0], *self._whole(array.filter(pa.array(odd)).to_pylist()))):
            for i, piece in zip(rows, np.split(ids, np.cumsum(n)[:-1])):
                out[i] = piece
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = self.whole(texts)
        return np.concatenate([np.zeros(0, np.int32), *out]), np.array([len(x) for x in out], np.int64)

    def _units(self, array) -> tuple[np.ndarray, np.ndarray]:
        if not len(array):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        marked = pc.replace_substring_regex(array, r"([\pL\pN])([^\s\pL\pN'])", "\\1 \x01\\2")
        marked = pc.replace_substring_regex(marked, r"([\pL\pN\pP\pS])\n([\pL\pN\pP\pS])", "\\1 \x01\n \x01\\2")
        # a text's first unit has no space in front of it
        split = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\x01", pa.large_string()), marked, pa.scalar("", pa.large_string())), " ")
        offsets, units = split.offsets.to_numpy(), split.flatten()
        offsets = offsets - offsets[0]
        at = pc.index_in(units, value_set=self.known)
        unit = pc.fill_null(at, -1).to_numpy()
        if at.null_count:
            new, first = units.filter(pc.is_null(at)).dictionary_encode(), len(self.known)
            self._learn(new.dictionary.to_pylist())
            unit = unit.copy()
            unit[unit < 0] = first + new.indices.to_numpy()
        counts = self.counts[unit]
        upto = np.concatenate([[0], np.cumsum(counts)])
        flat = self.pool[np.repeat(self.starts[unit] - upto[:-1], counts) + np.arange(upto[-1])]
        self.met += np.bincount(unit, minlength=len(self.met))
        if len(self.met) > self.cache:
            self._sweep()
        return flat, np.diff(upto[offsets])


_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str, special_as_text: bool = False) -> UnitEncoder:
    key = f"{path}|{special_as_text}"
    if key not in _encoders:
        _encoders[key] = UnitEncoder(path, special_as_text)
    return _encoders[key]


def write_tokens(docs: DataFrame, tokenizer_path: str, out: str, end: int = END, rows_in_file: int = ROWS_IN_FILE, special_as_text: bool = False) -> None:
    """Writes the token files of all documents to the folder ``out``."""

    def run(batches):
        from pyspark import TaskContext

        number, before, tk = TaskContext.get().partitionId(), 0, encoder(tokenizer_path, special_as_text)
        for b in batches:
            for part in pieces(b, 1):
                ids, n = tk.encode(part.column(1))
                stops = np.cumsum(n)
                ids = np.insert(ids, stops, end)
                n = n + 1
                offsets = np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(n), number, np.int32)), part.column(0), pa.array(before + offsets[:-1]), pa.array(n),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())),
                ], names=["part", "doc_id", "local_start", "n_tokens", "ids"])
                before += int(offsets[-1])

    files = max(1, -(-docs.count() // rows_in_file))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # the row's place comes last, so that rows that repeat id and text can be dealt to several files
    rows = rows.repartitionByRange(files, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    coded = rows.mapInArrow(run, "part int, doc_id long, local_start long, n_tokens long, ids array<int>")
    options = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true", "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#local_start": "false", "parquet.block.size": str(16 << 20), "parquet.page.row.count.limit": "1000"}
    coded.write.options(**options).parquet(out)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens, ids."""
    rows = spark.read.schema("part int, doc_id long, local_start long, n_tokens long, ids array<int>").parquet(path)
    per_file = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    first = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    firsts = per_file.select("part", first.alias("first"))
    if per_file.count() <= FILES_TO_BROADCAST:  # a row for each file; beyond that many the join shuffles
        firsts = F.broadcast(firsts)
    return rows.join(firsts, "part").select("doc_id", (F.col("first") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (unsigned, of the ids as little-endian unsigned 32-bit integers)."""

    def run(batches):
        for b in batches:
            ids = b.column(3)
            flat, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenized(docs: DataFrame, tokenizer_path: str, out: str | None = None) -> DataFrame:
    """Writes token files (to ``out``, else to a new folder in the shared one) and reads them back."""
    out = out or f"{scratch_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer_path, out)
    return read_tokens(docs.sparkSession, out)
