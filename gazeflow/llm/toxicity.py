"""Toxicity by a support vector machine over a subsequence string kernel (Lodhi et al., 2002) with Nystroem landmarks.

The kernel counts common subsequences of ORDER letters, gaps allowed, each weighted by DECAY to the power of its span; so a word
with letters put in between, or apart, stays near the word itself. A text is as toxic as its worst sentence part: its words,
and runs of single letters taken together. Labels are of whole texts, so the training sentences' worst words are found as
multiple-instance learning does: in a toxic text the few that fit best among words with a telling run of letters, in a
clean text the few that fit best and some others.

Nystroem features are kernel values with LANDMARKS words, times the inverse root of the landmarks' own kernel matrix. Every kernel
value is a sum over subsequences, so the trained machine collapses into one weight per subsequence, and a word costs the same
whatever the number of landmarks.

Scale: training sees at most max_train labelled texts of each class, chosen by hash; only these meet the labels, in a broadcast of
that bounded list. Scoring is one pass over the texts without a shuffle; the model is 128 KB.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plain, table, written

ORDER = 3
DECAY = 0.6
LANDMARKS = 192
#: Of margin errors, all of a class together, against the ridge.
COST = 3000.0
MAX_TRAIN = 3000
ROUNDS = 3
#: The least likelihood ratio of a run of four letters that first shows toxic words.
SIGN = 25.0
#: A run counts only if toxic texts have it so many times as often as clean ones.
TIMES = 5.0
#: Longer words are scored by windows of so many letters, half overlapping.
WINDOW = 24
#: Distinct words whose scores a worker remembers; it then starts anew.
REMEMBERED = 300_000
LETTERS = 32
_SPACED = re.compile(r"(?<!\S)(?:\S[ ]){2,}\S(?!\S)")
#: Characters that stand for letters.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}


def _letter(c: str) -> int:
    """0: no letter; 1 to 26: a to z without accents, or what stands for them; 27 to 31: other letters and digits."""
    base = unicodedata.normalize("NFD", STAND_INS.get(c, c).lower())[:1]
    if "a" <= base <= "z":
        return ord(base) - 96
    return 27 + ord(c) % 5 if c.isalnum() else 0


_CODES = np.array([_letter(chr(i)) if i < 0x3000 else 27 + i % 5 for i in range(0x3001)], np.uint8)


def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All words' letter codes one after another, without other characters (at the ends stand-ins don't count), and ends."""
    codes = np.frombuffer("\n".join(words).encode("utf-32-le", "surrogatepass"), np.uint32) if words else np.empty(0, np.uint32)
    word = np.cumsum(codes == 10)
    code = _CODES[np.minimum(codes, 0x3000)]
    keep = (code > 0) & (codes != 10)
    return code[keep], np.cumsum(np.bincount(word[keep], minlength=len(words)))


_triples: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the subsequences of n letters, and their weights."""
    if n not in _triples:
        at = np.array(list(combinations(range(n), ORDER)), np.int64).reshape(-1, ORDER)
        _triples[n] = at, DECAY ** (at[:, -1] - at[:, 0] + 1.0)
    return _triples[n]


def subsequences(x: np.ndarray) -> np.ndarray:
    """Codes of the subsequences of rows of letters."""
    at, _ = triples(x.shape[1])
    x = x.astype(np.int32)
    return (x[:, at[:, 0]] * LETTERS + x[:, at[:, 1]]) * LETTERS + x[:, at[:, 2]]


def self_kernel(x: np.ndarray) -> np.ndarray:
    """The kernel of each row of letters with itself, by the recursion of Lodhi et al."""
    b, n = x.shape
    prime = np.ones((n + 1, n + 1, b))
    same = (x.T[:, None, :] == x.T[None, :, :]).astype(float)
    for _ in range(ORDER - 1):
        after = np.zeros((n + 1, n + 1, b))
        for i in range(n):
            run = np.zeros(b)
            for j in range(n):
                run = DECAY * (run + DECAY * same[i, j] * prime[i, j])
                after[i + 1, j + 1] = DECAY * after[i, j + 1] + run
        prime = after
    return DECAY**2 * (same * prime[:n, :n]).sum(axis=(0, 1))


class Machine:
    """Word scores from one weight per subsequence."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights.astype(np.float32), bias

    def scores(self, words: list[str]) -> np.ndarray:
        """The decision value of each word, of long words the largest of their windows; under ORDER letters: the bias."""
        codes, ends = letters_of(words)
        starts = np.concatenate(([0], ends[:-1]))
        out = np.full(len(words), self.bias)
        sizes = ends - starts
        for n in np.unique(sizes).tolist():
            if n < ORDER:
                continue
            rows = np.flatnonzero(sizes == n)
            step = max(1, 400_000 // len(triples(min(n, WINDOW))[0]))
            for part in (rows[i : i + step] for i in range(0, len(rows), step)):
                if n <= WINDOW:
                    out[part] = self._windows(codes[starts[part][:, None] + np.arange(n)])
                else:
                    for r in part.tolist():
                        at = np.unique(np.append(np.arange(0, n - WINDOW, WINDOW // 2), n - WINDOW))
                        out[r] = max(float(self._windows(codes[starts[r] + at[i : i + step, None] + np.arange(WINDOW)]).max()) for i in range(0, len(at), step))
        return out

    def _windows(self, x: np.ndarray) -> np.ndarray:
        return (self.weights[subsequences(x)] @ triples(x.shape[1])[1]) / np.sqrt(self_kernel(x)) + self.bias


def windows_of(word: str) -> list[str]:
    """The pieces of a word that are scored on their own: itself up to WINDOW letters, otherwise half overlapping windows of its
    letters."""
    if len(word) <= WINDOW:
        return [word]
    kept = "".join(c for c in word if _letter(c))
    n = len(kept)
    return [word] if n <= WINDOW else [kept[i : i + WINDOW] for i in (*range(0, n - WINDOW, WINDOW // 2), n - WINDOW)]


def _vectors(words: list[str]) -> np.ndarray:
    """Subsequence weights of words (WINDOW letters at most, see windows_of()), normalised: rows of LETTERS ** ORDER, float32."""
    codes, ends = letters_of(words)
    out = np.zeros((len(words), LETTERS**ORDER), np.float32)
    for i, (a, b) in enumerate(zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), strict=True)):
        x = codes[a:b][None]
        if x.shape[1] >= ORDER:
            np.add.at(out[i], subsequences(x)[0], triples(x.shape[1])[1])
            out[i] /= np.linalg.norm(out[i])
    return out


def fit(positive: dict[str, float], negative: dict[str, float], seed: int = 5) -> Machine:
    """A linear support vector machine (squared hinge, classes of equal weight) on Nystroem features. Words with weights."""
    rng = np.random.default_rng(seed)
    pick = lambda words, n: [words[i] for i in rng.permutation(len(words))[:n]]
    marks = sorted(positive, key=lambda w: (-positive[w], w))[: LANDMARKS // 3]
    marks += pick(sorted(positive.keys() - set(marks)), LANDMARKS // 3)
    marks += pick(sorted(negative), LANDMARKS - len(marks))
    base = _vectors(marks)
    values, axes = np.linalg.eigh((base @ base.T).astype(float))
    used = np.flatnonzero(base.any(axis=0))  # other subsequences have no share in any kernel value
    keep = values > 1e-6 * values.max()
    root = axes[:, keep] / np.sqrt(values[keep])
    words = [*positive, *negative]
    z = np.vstack([_vectors(words[i : i + 500])[:, used] @ base[:, used].T for i in range(0, len(words), 500)]).astype(float) @ root
    z = np.hstack([z, np.ones((len(z), 1))])
    y = np.repeat([1.0, -1.0], [len(positive), len(negative)])
    c = np.concatenate([np.array([*m.values()]) / sum(m.values()) for m in (positive, negative)]) * COST
    w, ridge = np.zeros(z.shape[1]), np.append(np.ones(z.shape[1] - 1), 1e-3)
    for _ in range(30):  # Newton steps on the active set
        active = y * (z @ w) < 1
        za, ca = z[active], c[active]
        new = np.linalg.solve((za * ca[:, None]).T @ za + np.diag(ridge), (za * ca[:, None]).T @ y[active])
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return Machine(base.T @ (root @ w[:-1]), float(w[-1]))


def parts(text: str | None) -> set[str]:
    """The words of a text, lower-cased, and its runs of single letters, each as one word."""
    low = (text or "").lower()
    out = set(low.split())
    out.update(run.replace(" ", "") for run in _SPACED.findall(low))
    return out


def gapped(word: str, rng: np.random.Generator) -> list[str]:
    """Variants of a word: a letter put in at two places, one doubled."""
    at = lambda: int(rng.integers(1, max(2, len(word))))
    put = lambda w, i, c: w[:i] + c + w[i:]
    i, j = at(), at()
    return [put(word, i, "abcdefghijklmnopqrstuvwxyz"[int(rng.integers(26))]), put(word, j, "xzq"[int(rng.integers(3))]), put(word, i, word[i - 1])]


class Model:
    """The machine and its calibration: score = 1 / (1 + exp(-(slope * value + shift)))."""

    def __init__(self, machine: Machine | None, slope: float, shift: float) -> None:
        self.machine, self.slope, self.shift = machine, slope, shift

    def values(self, texts: list[str | None], memory: dict[str, float]) -> tuple[np.ndarray, list[str | None]]:
        """The decision value of each text and the part that has it (no parts: None)."""
        all_parts = [parts(t) for t in texts]
        new = list(set().union(*all_parts) - memory.keys())
        memory.update(zip(new, self.machine.scores(new).tolist(), strict=True))
        worst = [max(p, key=lambda w: (memory[w], w)) if p else None for p in all_parts]
        out = np.array([self.machine.bias if w is None else memory[w] for w in worst])
        if len(memory) > REMEMBERED:
            memory.clear()
        return out, worst

    def probability(self, values: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(self.slope * values + self.shift)))


def _grams(text: str | None) -> set[str]:
    return {w[i : i + 4] for w in parts(text) for i in range(len(w) - 3)}


def train(
    docs: DataFrame, labels: DataFrame, *, learns: str, max_train: int = MAX_TRAIN, rounds: int = ROUNDS, max_signs: int = 2000, witnesses: int = 4, others: int = 3, max_varied: int = 1500
) -> Model:
    """learns: SQL over doc_id, true where a row's label may be learnt. Labels that are null don't count; of several labels of a
    document the largest does. Without labels of both classes every text scores the share of toxic labels (none: 0).

    The training set is bounded: max_train texts of each class, of each text at most `witnesses` words that fit best, of a clean
    one also `others` by hash; max_signs: telling runs of four letters; max_varied: positive words that get variants with
    letters put in. Long words take part by their windows, as in scoring. Where no run of letters reaches SIGN (few
    labels), the best ones take its place: those with at least half of the largest ratio."""
    own = plain(labels, doc_id="doc_id:long", toxic="toxic:int").where(f"doc_id IS NOT NULL AND toxic IN (0, 1) AND {learns}")
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = dict(own.groupBy("toxic").count().collect())
    by_hash = lambda k: own.where(F.col("toxic") == k).orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(max_train)
    chosen = by_hash(1).unionAll(by_hash(0)).withColumnRenamed("doc_id", "i")
    d = plain(docs, doc_id="doc_id:long", text="text:string")
    sample = written(d.join(F.broadcast(chosen), F.col("doc_id") == F.col("i")).groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "toxicity-sample")
    n = dict(sample.groupBy("toxic").count().collect())
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    if not n.get(0) or not n.get(1):
        return Model(None, 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for b in batches:
            for toxic, text in zip(b.column("toxic").to_pylist(), b.column("text"), strict=True):
                counts[toxic].update(_grams(text.as_py()))
        both = [*(counts[0] | counts[1])]
        yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), *(pa.array([counts[k][g] for g in both], pa.int64()) for k in (1, 0))], ["gram", "bad", "good"])

    grams = sample.select("toxic", "text").mapInArrow(count_grams, "gram string, bad long, good long").groupBy("gram").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    # Signed likelihood ratio of a gram's documents by class.
    every = n[0] + n[1]
    part = lambda k, m: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) * every / ((F.col("bad") + F.col("good")) * m))).otherwise(0.0)
    ratio = F.when(F.col("bad") * n[0] > TIMES * (F.col("good") + 0.5) * n[1], 2 * (part("bad", n[1]) + part("good", n[0]))).otherwise(0.0)
    top = grams.where("bad > 1").select("gram", ratio.alias("g"), "bad").where("g > 0").orderBy(F.col("g").desc(), "gram").limit(max_signs).toPandas()
    floor = min(SIGN, float(top["g"].max()) / 2) if len(top) else SIGN
    top = top[(top["g"] > floor) & ((floor < SIGN) | (top["bad"] > 2))]
    weight = dict(zip(top["gram"], top["g"].astype(float), strict=True))

    def first_look(word: str) -> float:
        return max((weight.get(word[i : i + 4], 0.0) for i in range(len(word) - 3)), default=0.0)

    def pick(model: Model | None):
        """Of each text the few words that fit best; of clean ones also three words by hash."""

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import zlib

            for b in batches:
                words, values, bad = [], [], []
                all_toxic, texts = b.column("toxic").to_pylist(), b.column("text").to_pylist()
                for i in range(0, len(texts), 128):
                    known = [sorted({x for w in parts(t) for x in windows_of(w)}, key=lambda w: (zlib.crc32(w.encode("utf-8", "surrogatepass")), w)) for t in texts[i : i + 128]]
                    new = list(set().union(*known))
                    look = {w: first_look(w) for w in new}
                    fits = look if model is None else dict(zip(new, model.machine.scores(new).tolist(), strict=True))
                    for toxic, own in zip(all_toxic[i : i + 128], known, strict=True):
                        # A toxic text's witnesses hold a telling run of letters; its other words are as any text's.
                        some = sorted((w for w in own if not toxic or look[w] > floor), key=lambda w: (-fits[w], w))[:witnesses]
                        some += [] if toxic else own[:others]
                        words += some
                        values += [fits[w] for w in some]
                        bad += [toxic] * len(some)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(values, pa.float64()), pa.array(bad, pa.int32())], ["word", "value", "bad"])

        return sample.select("toxic", "text").mapInArrow(each, "word string, value double, bad int").toPandas().sort_values(["bad", "value", "word"], ignore_index=True)

    machine: Machine | None = None
    clean: Counter = Counter()
    for _ in range(rounds):
        got = pick(None if machine is None else Model(machine, 1.0, 0.0))
        seen = Counter(got[got["bad"] == 1]["word"])
        clean.update(got[got["bad"] == 0]["word"])
        # A word that is as often the worst of clean texts is no sign, whatever texts it is in.
        positive = {w: float(k) ** 0.5 for w, k in sorted(seen.items()) if k / n[1] > 2 * clean[w] / n[0]}
        if not positive:
            break
        rng = np.random.default_rng(5)
        for w in sorted(positive, key=lambda w: (-positive[w], w))[:max_varied]:
            for v in gapped(w, rng):
                positive.setdefault(v, 0.5)
        machine = fit(positive, {w: float(k) for w, k in sorted(clean.items()) if w not in positive} or {"the": 1.0})
    if machine is None:
        return Model(None, 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    got = _values(sample, Model(machine, 1.0, 0.0))
    x, y = got["value"].to_numpy(float), got["toxic"].to_numpy(float)
    weights = np.where(y > 0, share / y.sum(), (1 - share) / (1 - y).sum()) * len(y)
    return Model(machine, *_logistic(x, y, weights))


def _values(sample: DataFrame, model: Model):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, float] = {}
        for b in batches:
            values, _ = model.values(b.column("text").to_pylist(), memory)
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(values)], ["toxic", "value"])

    return sample.select("toxic", "text").mapInArrow(each, "toxic int, value double").toPandas().sort_values(["toxic", "value"], ignore_index=True)


def _logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method; targets are drawn in a little, as Platt does."""
    t = np.where(y > 0, 1 - 1 / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    z, w = np.column_stack([x, np.ones(len(x))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weights * (t - p)) - 1e-3 * w
        step = np.linalg.solve((z * (weights * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), g)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def toxicity(docs: DataFrame, labels: DataFrame, *, learns: str, max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per row of docs, in three columns that come after those of docs: toxicity_score (0 to 1), toxicity_predicted (1 from
    0.5 on), toxicity_evidence (the word that has the score). Scores come from the text alone.

    Null, empty and blank texts: the score of a text without any sign, evidence null. Equal rows get equal scores. Long texts are
    scored whole. No rows: no rows. Columns of docs with these names stay, before the new ones."""
    model = train(docs, labels, learns=learns, max_train=max_train)
    names = docs.columns
    rows = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at = next((i for w in ("==", "lower") for i, x in enumerate(names) if (x if w == "==" else x.lower()) == "text"), None)
    rows = rows.withColumn("text", F.col(f"c{at}").cast("string") if at is not None else F.lit(None).cast("string"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, float] = {}
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = part.column("text").to_pylist()
                values, worst = (np.zeros(len(texts)), [None] * len(texts)) if model.machine is None else model.values(texts, memory)
                p = model.probability(values)
                columns = [*part.columns[:-1], pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(worst, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[:-1], "score", "predicted", "evidence"])

    schema = rows.drop("text").schema.add("score", "double").add("predicted", "integer").add("evidence", "string")
    return rows.mapInArrow(each, schema).toDF(*names, "toxicity_score", "toxicity_predicted", "toxicity_evidence")


#: Rows whose labels the query doesn't learn.
HELD_OUT = "pmod(crc32(cast(coalesce(cast(doc_id AS string), '') AS binary)), 5) = 0"


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity(docs, table(spark, sf_dir, "labels"), learns=f"NOT ({HELD_OUT})").drop("text")
    return out.select("doc_id", F.expr(HELD_OUT).alias("held_out"), F.col("toxicity_score").alias("score"), F.col("toxicity_predicted").alias("predicted"), F.col("toxicity_evidence").alias("evidence"))
