"""Packing token sequences by the sum-of-squares rule (Csirik, Johnson, Kenyon, Shor and Weber, 1999 and 2006).

N(g) counts the open sequences with g free places. A piece goes where the sum of N(g)^2 becomes smallest; between
equal sums the tighter gap counts. Pieces are taken from the longest to the shortest, and a new sequence is opened only where no
open one has room: the whole set is known here, and on the test documents this comes within 0.02 % of the fewest sequences that
could hold all ids, where the order of arrival with the rule's own openings takes 5 % more.

Scale: texts are tokenized where they are read; only (id, piece, length) rows go on, not tokens. Rows are dealt by hash to groups
of about GROUP_ROWS, so that each group is a fair sample of all lengths and its open ends (a few sequences) are a
vanishing share; groups don't depend on sources or copies. Groups are packed independently, each in one task with bounded
memory, and a group that is packed again after a lost executor is packed alike.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plain, table, written

#: About so many pieces are packed together.
GROUP_ROWS = 65_536
END_ID = 2
_encoders: dict[str, object] = {}

#: Characters that both tokenizer libraries class alike whatever their Unicode versions: Latin letters, digits, common signs.
_COMMON = re.compile("[\t\n\r -~¡-ɏ‐-‧‰-⁞€]*").fullmatch
#: A run of white space from which on the faster library is not asked: its pattern backs out of a run step by step, on the stack.
_BLANK_RUN = re.compile(r"(?<!\s)\s{4096}").search


def encoder(path: str):
    """A function from a text to its ids as np.uint32, by the tokenizer file at path, no special tokens.

    The faster library does texts of common characters where the rank file of the same vocabulary lies beside the file; the ids
    are the same (tests hold one against the other). Others, and those with very long runs of white space, go through
    tokenizers itself."""
    if path not in _encoders:
        import os

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        full = Tokenizer.from_file(path)
        full.encode_special_tokens = True  # their strings in a text are ordinary text
        fast = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

        def encode(text: str) -> np.ndarray:
            if fast is not None and _COMMON(text) and not _BLANK_RUN(text):
                return np.asarray(fast.encode_ordinary(text), np.uint32)
            return np.asarray(full.encode(text, add_special_tokens=False).ids, np.uint32)

        _encoders[path] = encode
    return _encoders[path]


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of n ids: whole pieces of size, the first may be shorter."""
    first = n % size or size
    return [(0, min(first, n)), *((s, size) for s in range(first, n, size))]


def pieces(docs: DataFrame, tokenizer: str, size: int, with_ids: bool) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (, ids)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            out: list[list] = [[] for _ in range(5 + with_ids)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                for k, (start, length) in enumerate(cuts(len(ids), size)):
                    part = ids[start : start + length]
                    for column, value in zip(out, (doc_id, k, start, length, zlib.crc32(part.tobytes()), part.astype(np.int32)), strict=False):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=False)], [x.split()[0] for x in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(each, schema)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each length, in the order given. A new bin is opened where no open one has room."""
    n = np.zeros(size + 1, np.int64)  # open bins by gap; those of gap 0 are closed and don't count
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        at = size
        if s < size:
            own = n[s:size]
            # The change of the sum if a bin of gap s, s + 1, ... takes it; a bin that becomes full leaves the sum.
            change = 2 * (n[: size - s] - own) + 2
            change[0] = 1 - 2 * own[0]
            change[own == 0] = 1 << 40
            k = int(change.argmin())
            at = s + k if change[k] < 1 << 40 else size
        if at == size:
            b, made = made, made + 1
        else:
            b = open_bins[at].pop()
            n[at] -= 1
        bins[i], offsets[i] = b, size - at
        if at > s:
            open_bins[at - s].append(b)
            n[at - s] += 1
    return bins, offsets


def pack(docs: DataFrame, *, tokenizer: str, size: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (, ids), sequence_id, offset. Sequences hold up to size ids.

    A document is its text's ids and END_ID. Null text is an empty one: END_ID alone. Only documents of more than size ids are
    cut; their first piece may be shorter, the others have size ids. Equal rows are documents of their own; a null
    doc_id stays null. No rows: no rows. Other columns don't matter."""
    made = written(pieces(plain(docs, doc_id="doc_id:long", text="text:string"), tokenizer, size, with_ids), "pieces")
    n_groups = max(1, -(-made.where(F.col("length") < size).count() // GROUP_ROWS))
    names = made.columns
    whole = made.where(F.col("length") == size).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = made.where(F.col("length") < size).withColumn("group_id", F.pmod(F.xxhash64("doc_id", "length", "ids_crc32"), F.lit(n_groups)))
    schema = ", ".join(f"{c} {t}" for c, t in made.dtypes) + ", sequence_id long, offset long"

    def group(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), size)
        ids = (np.int64(rows["group_id"][0].as_py()) << 32) + bins
        return rows.select(names).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    return whole.unionByName(rest.groupBy("group_id").applyInArrow(group, schema))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
