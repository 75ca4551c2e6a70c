"""Language-model scores from a subword lattice.

An existing subword vocabulary spans a lattice over each word; all segmentations count, weighted by piece probabilities, and a
forward recursion in log space returns their sum, the word's marginal probability. The first piece of a word comes from one
distribution, the others and the stop from a second, so that the probabilities of all words sum to 1 at most. The vocabulary's
own scores (for a merge vocabulary: ranks, taken as Zipf's law has them) are the start; expected piece counts over all
distinct training words (expectation-maximisation) replace them; each word counts once, since the lattice is needed for rare words. Words seen in training also have an arc of their own: their count less a
discount, and the lattice shares what the discounts free (absolute discounting), so that new words get their due.

Scale: word counts combine in the reading tasks before they are shuffled; the lattice runs once per distinct word, not per
occurrence. Of the counted vocabulary only the HEAD_WORDS most frequent words are broadcast, a fixed bound; all others meet their
documents in a shuffle join on the word, to which a document brings each distinct word once. Piece counts come to the driver as
one row per piece of the fixed vocabulary.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plain, table, written

HEAD_WORDS = 200_000
#: Distinct words that a reading task counts before it passes its counts on.
FLUSH_WORDS = 400_000
EM_ROUNDS = 2
START = "▁"
#: Letters of a block of words that go through the lattice together.
BLOCK_CELLS = 1 << 17
LOG10 = float(np.log(10.0))


class Lattice:
    """Piece log-probabilities and the recursions over blocks of words."""

    def __init__(self, model_file: str, counts: np.ndarray | None = None) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        text = [model.id_to_piece(i) for i in range(size)]
        usable = np.array([not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(size)])
        self.byte_ids = np.zeros(256, np.int64)
        for i in range(size):
            if model.is_byte(i):
                self.byte_ids[int(text[i][3:5], 16)] = i
                usable[i] = True
        is_byte = np.isin(np.arange(size), self.byte_ids)
        first = np.array([t.startswith(START) for t in text]) & ~is_byte
        inside = np.array([START in t[1:] for t in text])
        usable &= ~inside | is_byte
        self.size, self.stop = size, size
        score = np.array([model.get_score(i) for i in range(size)])
        prior = np.zeros(size + 1)
        if (score[usable & ~is_byte] % 1 == 0).all():  # ranks
            prior[:size] = np.where(usable, 1.0 / (10.0 - np.maximum(score, -1e8)), 0.0)
        else:
            prior[:size] = np.where(usable, np.exp(np.maximum(score, -60.0)), 0.0)
        prior[:size][is_byte] = prior[:size][usable & ~is_byte].min()
        group = [np.append(first & usable, False), np.append(~first & usable, True)]
        prior[size] = prior[:size][~first & usable].sum() / 2  # a word has about two further pieces
        p = np.zeros(size + 1)
        for g in group:
            prior[g] /= prior[g].sum()
            # The prior keeps the weight of ten words, so that no piece gets probability 0.
            p[g] = prior[g] if counts is None else (counts[g] + 10 * prior[g]) / (counts[g].sum() + 10)
        with np.errstate(divide="ignore"):
            self.lp = np.append(np.log(p), -np.inf)  # the last: no piece
        self.none = size + 1
        self.longest = max(len(t) for t, u, b in zip(text, usable, is_byte, strict=True) if u and not b)
        keys, ids = [], []
        for i in np.flatnonzero(usable & ~is_byte).tolist():
            h = np.zeros(1, np.uint64)
            for c in text[i]:
                h = _step(h, np.array([ord(c)], np.uint64))
            keys.append(h[0])
            ids.append(i)
        self.tables = _tables(np.array(keys, np.uint64), np.array(ids, np.int32), self.none)

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(h.shape, self.none, np.int32)
        for mult, keys, ids in self.tables:
            at = ((h * mult) >> np.uint64(44)).astype(np.int64)
            hit = keys[at] == h
            out[hit] = ids[at[hit]]
        return out

    def blocks(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]]:
        """Of similar words together: their rows, lengths (with the start sign), the piece ids of their arcs by length, and the
        log-probability of each letter as bytes."""
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            longest = int(lengths[order[at]])
            n = max(1, BLOCK_CELLS // (longest + 4))
            rows = order[at : at + n]
            rows = rows[lengths[rows] <= longest + 3 + longest // 8]
            at += len(rows)
            own = lengths[rows]
            wide = int(own.max())
            codes = np.zeros((len(rows), wide), np.uint64)
            letters = np.frombuffer("".join(START + words[r] for r in rows.tolist()).encode("utf-32-le"), np.uint32)
            codes[np.arange(wide) < own[:, None]] = letters
            codes[:, 1:][codes[:, 1:] == ord(START)] = 0x110000  # inside a word it is a letter like others, and has no pieces
            arcs, h = [], np.zeros_like(codes)
            for d in range(1, min(self.longest, wide) + 1):
                h = _step(h[:, : wide - d + 1], codes[:, d - 1 :])
                arcs.append(self.find(h))
            yield rows, own, arcs, self._as_bytes(codes)

    def _as_bytes(self, codes: np.ndarray) -> np.ndarray:
        out = np.full(codes.shape, -np.inf)
        for c in np.unique(codes[:, 1:]):
            char = START if c == 0x110000 else chr(int(c))
            out[:, 1:][codes[:, 1:] == c] = self.lp[self.byte_ids[list(char.encode("utf-8", "surrogatepass"))]].sum() if c else -np.inf
        return out

    def _forward(self, own: np.ndarray, arcs: list[np.ndarray], as_bytes: np.ndarray) -> np.ndarray:
        """alpha[:, j]: the log-probability of all ways to the letters before j."""
        n, wide = as_bytes.shape
        alpha = np.full((n, wide + 1), -np.inf)
        alpha[:, 0] = 0.0
        for j in range(1, wide + 1):
            ways = [alpha[:, j - d] + self.lp[arcs[d - 1][:, j - d]] for d in range(1, min(len(arcs), j) + 1)]
            ways.append(alpha[:, j - 1] + as_bytes[:, j - 1])
            alpha[:, j] = _log_sum(ways)
        return alpha

    def log_probs(self, words: list[str]) -> np.ndarray:
        """The natural logarithm of each word's marginal probability."""
        out = np.empty(len(words))
        for rows, own, arcs, as_bytes in self.blocks(words):
            alpha = self._forward(own, arcs, as_bytes)
            out[rows] = alpha[np.arange(len(rows)), own] + self.lp[self.stop]
        return out

    def expected(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces (last: the stop) over words with weights."""
        total = np.zeros(self.size + 2)
        total[self.stop] = weights.sum()
        for rows, own, arcs, as_bytes in self.blocks(words):
            n, wide = as_bytes.shape
            alpha = self._forward(own, arcs, as_bytes)
            beta = np.full((n, wide + 1), -np.inf)
            beta[np.arange(n), own] = 0.0
            for i in range(wide - 1, -1, -1):
                ways = [beta[:, i + d] + self.lp[arcs[d - 1][:, i]] for d in range(1, min(len(arcs), wide - i) + 1)]
                ways += [beta[:, i + 1] + as_bytes[:, i], beta[:, i]]
                beta[:, i] = _log_sum(ways)
            log_w = np.log(weights[rows]) - alpha[np.arange(n), own]
            for d, ids in enumerate(arcs, 1):
                some = np.nonzero(ids != self.none)
                got = ids[some]
                share = np.exp(alpha[:, :-d][some] + self.lp[got] + beta[:, d:][some] + log_w[some[0]])
                total += np.bincount(got, share, minlength=len(total))
        return total[: self.size + 1]


def _step(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The hash of a string and one more letter."""
    h = (h ^ (code + np.uint64(0x9E37))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _tables(keys: np.ndarray, ids: np.ndarray, none: int) -> list[tuple[np.uint64, np.ndarray, np.ndarray]]:
    """Hash tables of 2^20 slots; keys that meet in one go to the next."""
    out, k = [], 0
    while len(keys):
        mult = np.uint64((0xBF58476D1CE4E5B9 * (2 * k + 1)) & (2**64 - 1))
        at = ((keys * mult) >> np.uint64(44)).astype(np.int64)
        _, firsts = np.unique(at, return_index=True)
        table_keys, table_ids = np.zeros(1 << 20, np.uint64), np.full(1 << 20, none, np.int32)
        table_keys[at[firsts]], table_ids[at[firsts]] = keys[firsts], ids[firsts]
        out.append((mult, table_keys, table_ids))
        rest = np.delete(np.arange(len(keys)), firsts)
        keys, ids, k = keys[rest], ids[rest], k + 1
    return out


def _log_sum(ways: list[np.ndarray]) -> np.ndarray:
    stack = np.stack(ways)
    top = stack.max(axis=0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(stack - safe).sum(axis=0)) + safe


def tokens(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), c: occurrences in documents that aren't held out, 0 for words of others. docs: text, held_out."""

    def rows(counts: Counter, others: set) -> pa.RecordBatch:
        words = [*counts, *(w for w in others if w not in counts)]
        c = np.zeros(len(words), np.int64)
        c[: len(counts)] = np.fromiter(counts.values(), np.int64, len(counts))
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c)], ["word", "c"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, others = Counter(), set()
        for b in batches:
            for text, held in zip(b.column("text"), b.column("held_out").to_pylist(), strict=True):
                words = tokens(text.as_py())
                if held:
                    others.update(words)
                else:
                    counts.update(words)
                if len(counts) + len(others) > FLUSH_WORDS:
                    yield rows(counts, others)
                    counts, others = Counter(), set()
        yield rows(counts, others)

    return docs.select("text", "held_out").mapInArrow(each, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _piece_counts(vocab: DataFrame, model_file: str, counts: np.ndarray | None, size: int) -> np.ndarray:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total = None, np.zeros(size)
        for b in batches:
            if lattice is None:
                lattice = Lattice(model_file, counts)
            words = [w.decode("utf-8", "surrogatepass") for w in b.column("word").to_pylist()]
            total += lattice.expected(words, np.ones(len(words)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["id", "n"])

    got = vocab.where("c > 0").mapInArrow(each, "id int, n double").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size)
    out[got["id"].to_numpy(np.int64)] = got["n"]
    return out


def _least_count(vocab: DataFrame, most: int) -> int:
    """A count that at most so many words reach; counts are looked at by eighths of powers of two, so few rows come to the driver."""
    step = F.floor(F.log2("c") * 8).cast("int").alias("step")
    sizes = vocab.where("c > 1").groupBy(step).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")).orderBy(F.desc("step")).collect()
    least, total = (1 << 62), 0
    for r in sizes:
        total += r.n
        if total > most:
            break
        least = r.least
    return least


def score(docs: DataFrame, *, vocabulary: str, held_out: str = "pmod(crc32(cast(coalesce(cast(doc_id AS string), '') AS binary)), 7) = 2", head_words: int = HEAD_WORDS, em_rounds: int = EM_ROUNDS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the probability of the
    text's words and its end).

    vocabulary: a sentencepiece model file that all executors have. held_out: SQL over doc_id; the model and the counts learn
    from the other documents. base_score: add-one unigrams, see train_tokens N and the distinct tokens V: the sum over
    tokens of log10((c + 1) / (N + V + 1)).

    Null text is an empty one: only its end counts. A null doc_id is the empty string for held_out. Equal rows each get a row,
    and each counts in training. Without training documents all words come from the lattice's prior. No rows: no rows."""
    d = plain(docs, doc_id="doc_id:long", text="text:string").withColumn("held_out", F.expr(held_out)).withColumn("text_hash", F.xxhash64("text"))
    ends = float(d.where(~F.col("held_out")).count())
    counted = written(word_counts(d), "lm-counts")
    n_words, types, ones, twos = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), *(F.count(F.when(x, 1)) for x in (F.col("c") > 0, F.col("c") == 1, F.col("c") == 2))).first()
    size = Lattice(vocabulary).size + 1
    pieces = None
    for _ in range(em_rounds if n_words else 0):
        pieces = _piece_counts(counted, vocabulary, pieces, size)
    discount = ones / (ones + 2.0 * twos) if ones and twos else 0.5
    all_tokens, distinct = n_words + ends, types + (ends > 0)
    freed = discount * types + 0.5

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = None
        for b in batches:
            if lattice is None:
                lattice = Lattice(vocabulary, pieces)
            words = [w.decode("utf-8", "surrogatepass") for w in b.column("word").to_pylist()]
            c, lp = b.column("c").to_numpy(), lattice.log_probs(words)
            seen = np.maximum(c - discount, 0.0)
            with np.errstate(divide="ignore"):
                lp = np.logaddexp(np.log(seen), np.log(freed) + lp) - np.log(all_tokens + 1.0)
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("c"), pa.array(lp / LOG10)], ["word", "c", "lp"])

    vocab = written(counted.mapInArrow(price, "word binary, c long, lp double"), "lm-vocabulary")
    head = vocab.where(F.col("c") >= _least_count(vocab, head_words)).toPandas()
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((head["word"].map(bytes).tolist(), np.log10(head["c"].to_numpy(float) + 1.0), head["lp"].to_numpy(float)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, log_c, lp = shared.value
        at = {w: i for i, w in enumerate(known)}
        get = at.get
        for b in batches:
            tails, tail_counts, sums = [], [], []
            for text in b.column("text"):
                counts = Counter(tokens(text.as_py()))
                n = np.fromiter(counts.values(), np.int64, len(counts))
                ids = np.fromiter((get(w, -1) for w in counts), np.int64, len(counts))
                head_ids, head_n = ids[ids >= 0], n[ids >= 0]
                sums.append((int(n.sum()) + 1, int(head_n.sum()), float(head_n @ log_c[head_ids]), float(head_n @ lp[head_ids])))
                tails.append([w for w, i in zip(counts, ids.tolist(), strict=True) if i < 0])
                tail_counts.append(n[ids < 0])
            columns = [b.column("doc_id"), b.column("held_out"), b.column("text_hash"), pa.array(tails, pa.list_(pa.binary())), pa.array(tail_counts, pa.list_(pa.int64()))]
            columns += [pa.array([s[k] for s in sums], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "text_hash", "tail", "counts", "n_tokens", "n_known", "log_c", "lp"])

    per = d.mapInArrow(each, "doc_id long, held_out boolean, text_hash long, tail array<binary>, counts array<long>, n_tokens long, n_known long, log_c double, lp double")
    # One row for the document itself, under a name that no word has and that spreads, and one for each of its rarer words.
    own = F.struct(F.concat(F.lit(b" "), F.col("text_hash").cast("string").cast("binary")).alias("word"), F.lit(0).cast("long").alias("n"))
    rest = F.zip_with("tail", "counts", lambda w, n: F.struct(w.alias("word"), n.alias("n")))
    rows = per.select("doc_id", "held_out", "text_hash", "n_tokens", "n_known", "log_c", "lp", F.explode(F.concat(F.array(own), rest)).alias("t"))
    is_own = F.col("t.n") == 0
    rows = rows.select("doc_id", "held_out", "text_hash", "t.word", "t.n", is_own.cast("long").alias("times"), *(F.when(is_own, F.col(c)).otherwise(0).alias(c) for c in ("n_tokens", "n_known", "log_c", "lp")))
    rows = rows.join(vocab.select(F.col("word").alias("w"), F.col("c"), F.col("lp").alias("word_lp")), F.col("word") == F.col("w"), "left")
    n, c = F.col("n"), F.coalesce("c", F.lit(0))
    sums = rows.groupBy("doc_id", "held_out", "text_hash").agg(
        F.sum("times").alias("times"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_known") + F.when(c > 0, n).otherwise(0)).alias("n_known"),
        F.sum(F.col("log_c") + n * F.log10(c + 1.0)).alias("log_c"), F.sum(F.col("lp") + n * F.coalesce("word_lp", F.lit(0.0))).alias("lp"),
    )
    end_c, end_lp = float(np.log10(ends + 1.0)), float(np.log10((ends + 0.5) / (all_tokens + 1.0)))
    times = F.col("times")
    out = sums.select(
        "doc_id", "held_out", (F.col("n_tokens") / times).cast("long").alias("n_tokens"), (F.col("n_known") / times + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(int(all_tokens)).cast("long").alias("train_tokens"), (F.col("log_c") / times + end_c - F.col("n_tokens") / times * float(np.log10(all_tokens + distinct + 1.0))).alias("base_score"),
        (F.col("lp") / times + end_lp).alias("score"), F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("copy"),
    )
    return out.drop("copy")


def op7_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score(table(spark, sf_dir, "documents"), vocabulary=public_tokenizers.path("piece_bpe_32k.model"))
