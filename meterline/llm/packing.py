"""Packing documents into token sequences by the sum-of-squares rule.

Documents are tokenized whole, ended by one id, and only longer ones are cut, into pieces of the full length.
Pieces are packed in hashed groups of bounded size, largest first: a piece goes to the open sequence that leaves
the smallest sum of squared counts of open sequences per residual gap, and opens a sequence if none has room.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.common import saved

LENGTH = 2048
END = 0
#: Mean number of pieces of a group; a group's only loss is its last sequences.
GROUP = 40_000
#: Equal pieces that are dealt together.
CHUNK = 1_000


class WordCachedTokenizer:
    """Ids of a text as packed little-endian unsigned 32-bit numbers, with caches of bounded size.

    For tokenizers whose pre-tokens never cross white space, so that a text is the sum of its words; words, and
    below them the runs of letters, signs and single digits, are tokenized once while they stay in the cache.
    """

    def __init__(self, path: str, words: int = 150_000, runs: int = 250_000):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.runs_of = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.model = self.tokenizer.model
        # byte-level vocabularies show printable Latin-1 bytes as themselves, the others as characters from 256 on
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        self.shown = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in plain)}
        self.words, self.runs, self.most_words, self.most_runs = {}, {}, words, runs

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if max(word) >= "\u0250":
            return self._encode(word)  # composition and case rules beyond Latin letters are left to the tokenizer
        low = word.lower()
        if low.isalpha():
            return self._run(low)
        if low[:-1].isalpha():
            return self._run(low[:-1]) + self._run(low[-1])
        return b"".join(map(self._run, self.runs_of(low)))

    def _run(self, run: str) -> bytes:
        found = self.runs.get(run)
        if found is None:
            if len(self.runs) >= self.most_runs:
                self.runs.clear()
            # the model alone, on the characters that stand for the run's bytes; control bytes have no symbol of their own
            shown = run if run.isascii() and run.isprintable() else run.encode().decode("latin-1").translate(self.shown)
            found = self.runs[run] = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
        return found

    def encode(self, text: str | None) -> bytes:
        known, out, text = self.words, [], text or ""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self._encode(text)  # split() takes these for white space, the tokenizer doesn't
        if any(t in text for t in self.special):
            return self._encode(text)  # literals of added tokens are one id each
        for w in text.split():
            ids = known.get(w)
            if ids is None:
                ids = self._word(w)
                if len(w) <= 64:
                    if len(known) >= self.most_words:
                        known.clear()
                    known[w] = ids
            out.append(ids)
        return b"".join(out)


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordCachedTokenizer:
    """One tokenizer for each Python worker, kept with its caches from task to task."""
    return WordCachedTokenizer(path)


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every piece of every row; null text is empty.

    ``tokenizer`` is the path of a vocabulary file that every worker has.
    """
    ids_type = ", ids array<int>" if with_ids else ""

    @F.pandas_udf(f"array<struct<piece:int,start:long,length:long,ids_crc32:long{ids_type.replace(' ids ', 'ids:')}>>")
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(tokenizer)
        tail = np.array([end], "<u4").tobytes()
        for part in parts:
            out = []
            for text in part:
                ids, row = encoder.encode(text) + tail, []
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    own = ids[at : at + 4 * length]
                    row.append((k, at // 4, len(own) // 4, zlib.crc32(own), *([np.frombuffer(own, "<u4").astype(np.int32)] if with_ids else [])))
                out.append(row)
            yield pd.Series(out)

    return docs.select("doc_id", F.explode(cut("text")).alias("x")).select("doc_id", "x.*")


def sum_of_squares(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each size, for sizes in the order in which they are placed."""
    counts, open_at = np.zeros(length + 1, np.int64), [[] for _ in range(length + 1)]
    where, offset, made = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        # moving one sequence from gap g to g - s changes the sum by 2 (n[g - s] - n[g] + 1); full ones don't count
        before = counts[s:]
        change = np.where(before > 0, counts[: length + 1 - s] - before, length * length)
        if before[0] > 0:
            change[0] = -before[0] - 1 / 2
        gap = int(change.argmin()) + s
        if before[gap - s] > 0:
            which = open_at[gap].pop()
            counts[gap] -= 1
        else:
            which, gap, made = made, length, made + 1
        where[i], offset[i] = which, length - gap
        if gap > s:
            open_at[gap - s].append(which)
            counts[gap - s] += 1
    return where, offset


def pack(rows: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Adds ``sequence_id, offset`` to pieces with a ``length`` of 1 to ``length``.

    Pieces are dealt by hash to groups of about ``group`` rows whatever the input's size.  Equal ones are counted
    and dealt in chunks, so a group is bounded and no key can be hot; the same input gives the same sequences.  Each
    group is packed by itself: against one group for all, at most the room left in a group's sequences is lost, which
    a group of pieces of all lengths fills but for its last few sequences (a test compares it with the lower bound).
    """
    n = max(1, -(-rows.count() // group))
    names, many = rows.columns, F.col("_n")
    folded = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    folded = folded.select(*names, "_n", F.explode(F.sequence(F.lit(0), F.floor((many - 1) / CHUNK).cast("int"))).alias("_chunk"))
    place = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "_chunk"), F.lit(n)).alias("_group")
    own = F.least(F.lit(CHUNK), many - F.col("_chunk").cast("long") * CHUNK).cast("int")
    rows = folded.select(*names, place, F.explode(F.sequence(F.lit(1), own)).alias("_copy")).drop("_copy")

    def packed(key: tuple[pa.Scalar], t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        where, offset = sum_of_squares(t["length"].to_numpy(), length)
        t = t.append_column("sequence_id", pa.array(where + (key[0].as_py() << 32)))
        return t.append_column("offset", pa.array(offset)).drop_columns(["_group"])

    kept = [f for f in rows.schema.fields if f.name != "_group"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long"
    return rows.groupBy("_group").applyInArrow(packed, schema)


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces of all rows with their places: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts give one piece, the end id alone.  Repeated rows and null ids are packed like any other
    row; texts of any length are cut whole; extra columns are ignored; an empty table gives no pieces.
    """
    return pack(saved(pieces(docs, tokenizer, length, end, with_ids), "pieces"), length)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the token sequences of pieces packed with their ids (at most ``length`` ids each)."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(inside, lambda x: x["ids"])).alias("ids"))
