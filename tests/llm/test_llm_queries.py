"""The registered queries against SQL or brute force, on the smallest tables."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import same_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from gazeflow.llm import jaccard, lattice_lm, neighbours, packing, queries, simhash, substring_dedup, toxicity


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, duck, small, name):
    same_rows(queries.QUERIES[name](spark, small).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df())


def test_op2(spark, small, texts):
    import xxhash

    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = queries.QUERIES["op2_simhash"](spark, small).toPandas().sort_values("doc_id")
    f = np.array([brute(texts[i]) for i in got.doc_id], np.uint64)
    assert [f"{x:016x}" for x in f] == got.fingerprint.tolist()
    near, label = np.bitwise_count(f[:, None] ^ f[None]) <= 2, np.arange(len(f))
    while not np.array_equal(new := np.array([label[n].min() for n in near]), label):
        label = new
    assert got.component_id.tolist() == got.doc_id.to_numpy()[label].tolist()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, (1 << 16) - 1), min_size=1, max_size=700, unique=True))
def test_forest_keeps_components(values):
    """The look-up of neighbours in long lists links what comparing all pairs links."""
    sigs = np.zeros((len(values), 8), np.uint8)
    sigs[:, 2], sigs[:, 5] = [v >> 8 for v in values], [v & 255 for v in values]
    near, label = np.bitwise_count(np.array(values)[:, None] ^ np.array(values)[None]) <= 2, np.arange(len(values))
    while not np.array_equal(new := np.array([label[n].min() for n in near]), label):
        label = new
    tree = simhash.forest(sigs, 2, 6)
    assert len({*zip(label.tolist(), tree.tolist(), strict=True)}) == len(set(label.tolist())) == len(set(tree.tolist()))


def test_near_copies_at_similarity(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words, 300).tolist() for _ in range(40)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base):
        c = list(b)
        for k in rng.choice(300, 3, replace=False):
            c[k] = "changed"
        rows.append((100 + i, " ".join(c)))
    stay = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), jaccard.near_duplicates).collect()}
    assert set(range(40)) <= stay and len(stay) <= 42


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 3000), st.integers(0, 3000), st.floats(0, 1), st.integers(0, 1 << 30))
def test_sketches_never_differ_in_more_bits_than_sets(n, m, share, seed):
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, n + m))
    a = pool[:n]
    b = np.union1d(a[: int(share * min(n, m))], pool[n:][: m - int(share * min(n, m))])
    lists = [pa.array([np.empty(0, np.int64), jaccard.odd_sketch(x)], pa.list_(pa.int64()))[1:] for x in (a, b)]
    bits, apart = int(jaccard.differing(*lists)[0]), len(np.setxor1d(a, b))
    assert bits <= apart and (apart - bits) % 2 == 0


def test_chance_meetings_shuffle_no_sets(spark, monkeypatch):
    """Texts that share single passages by chance meet in many lists; only whole sets of near copies are compared."""
    rng = np.random.default_rng(5)
    texts = [[f"u{i}" for i in rng.integers(0, 1 << 40, 120)] for _ in range(160)]
    for k in range(0, 160, 2):
        for at in rng.choice(20, 8, replace=False):
            texts[k + 1][6 * at : 6 * at + 5] = texts[k][6 * at : 6 * at + 5]
    copies = [[*t[:-1], "changed"] for t in texts[:6]]
    made, rows = jaccard.written, {}

    def counted(df, tag):
        out = made(df, tag)
        rows[tag] = rows.get(tag, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts + copies)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    assert got == {i: i - 160 if i >= 160 else i for i in range(166)}
    assert rows["jaccard-pairs"] > 40 and rows["jaccard-sets"] <= 16


def test_near_copies_in_many_passes(spark, monkeypatch):
    """Pairs beyond the bounds of a pass, and texts beyond those of a broadcast, take more passes."""
    for name in ("SET_PAIRS", "SKETCH_PAIRS", "BROADCAST_ROWS"):
        monkeypatch.setattr(jaccard, name, 7)
    test_near_copies_at_similarity(spark)


def test_op3(spark, small):
    got = queries.QUERIES["op3_warc"](spark, small).toPandas().set_index("page_id")
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    for i, p in pages.items():
        r = got.loc[i]
        assert (r.payload_bytes, r.payload_digest) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        assert r.record_type == ("response" if first[p] == i else "revisit")


def test_op4(spark, small, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = queries.QUERIES["op4_packing"](spark, small).toPandas().sort_values(["doc_id", "piece"])
    for i, g in got.groupby("doc_id"):
        ids = [*t.encode(texts[i], add_special_tokens=False).ids, 2]
        assert g.start.tolist() == np.cumsum([0, *g.length[:-1]]).tolist() and g.length.sum() == len(ids)
        assert (g.length[1:] == 1024).all() and g.length.iloc[0] <= 1024
        assert [zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) for s, n in zip(g.start, g.length, strict=True)] == g.ids_crc32.tolist()
    used = got.groupby("sequence_id").length.sum()
    assert used.max() <= 1024 and len(used) <= 1.02 * math.ceil(got.length.sum() / 1024) + 1


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from(" \n\t'.,19|<>é–“”endoftext"), st.characters(exclude_categories=("Cs",))), max_size=60))
def test_encoders_agree(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    assert packing.encoder(path)(text).tolist() == t.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60))
def test_packing_rule(lengths):
    lengths = sorted(lengths, reverse=True)
    bins, offsets = packing.sum_of_squares(np.array(lengths, np.int64), 16)
    gaps = {}
    for s, b, o in zip(lengths, bins.tolist(), offsets.tolist(), strict=True):
        counts = Counter(g for g in gaps.values() if g)
        open_ones = [g for g in counts if g >= s]

        def total(g, counts=counts, s=s):
            c = Counter(counts)
            c[g] -= 1
            c[g - s] += 1
            return sum(v * v for k, v in c.items() if k)

        if b in gaps:
            assert gaps[b] == 16 - o and total(gaps[b]) == min(map(total, open_ones))
            gaps[b] -= s
        else:
            assert o == 0 and not open_ones
            gaps[b] = 16 - s


def test_op5(spark):
    got = queries.QUERIES["op5_toxicity"](spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    m = got.merge(labels, on="doc_id")
    held = m[m.held_out]
    assert ((held.predicted == 1) & (held.toxic == 0)).sum() <= 2 and ((held.predicted == 1) & (held.toxic == 1)).sum() >= 3


def test_self_kernel_is_the_sum_over_subsequences():
    codes, ends = toxicity.letters_of(["banana", "abcdef"])
    x = codes.reshape(2, 6)
    for row, k in zip(x, toxicity.self_kernel(x), strict=True):
        weight = Counter()
        for code, w in zip(toxicity.subsequences(row[None])[0].tolist(), toxicity.triples(6)[1].tolist(), strict=True):
            weight[code] += w
        assert math.isclose(k, sum(w * w for w in weight.values()))


def test_gapped_insults_score_high():
    rng = np.random.default_rng(1)
    clean = {"".join(rng.choice(["th", "er", "an", "ing", "ou", "re", "st", "ble"], 3)): 1.0 for _ in range(300)}
    bad = {w: 5.0 for w in ("idiot", "moron", "pathetic", "worthless")}
    bad |= {v: 1.0 for w in list(bad) for _ in range(5) for v in toxicity.gapped(w, rng)}
    m = toxicity.fit(bad, clean)
    assert (m.scores(["i.d.i.o.t", "idxiot", "m0ron", "path-etic", "worthqless"]) > 0).all() and (m.scores(sorted(clean)) < 0).mean() > 0.98
    assert "idiot" in toxicity.parts("what an i d i o t he is")


def test_op7(spark, small, texts):
    got = queries.QUERIES["op7_lattice_lm"](spark, small).toPandas().set_index("doc_id")
    words = {i: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in words.items():
        r = got.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r.score < 0
    sense = got.loc[[i for i in texts if held[i]]]
    assert sense.score.sum() / sense.n_tokens.sum() > -6


def test_lattice_is_the_sum_over_segmentations():
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    lattice = lattice_lm.Lattice(path)
    model = SentencePieceProcessor(model_file=path)
    ids = {model.id_to_piece(i): i for i in range(model.get_piece_size())}

    def brute(word):
        s = lattice_lm.START + word
        ways = [0.0] * len(s) + [math.exp(lattice.lp[lattice.stop])]
        for i in range(len(s) - 1, -1, -1):
            for j in range(i + 1, len(s) + 1):
                if s[i:j] in ids and (i == 0) == s[i:j].startswith(lattice_lm.START):
                    ways[i] += math.exp(lattice.lp[ids[s[i:j]]]) * ways[j]
            if i:
                ways[i] += math.exp(sum(lattice.lp[lattice.byte_ids[b]] for b in s[i].encode())) * ways[i + 1]
        return math.log(ways[0])

    words = ["the", "erthing", "é", "日本語", "a", "unbelievable"]
    assert np.allclose(lattice.log_probs(words), [brute(w) for w in words])
    # Expected counts: each word's pieces, weighted by their share of all segmentations, end in one stop.
    counts = lattice.expected(words, np.ones(len(words)))
    assert math.isclose(counts[lattice.stop], len(words)) and counts[:-1].sum() >= len(words)


@pytest.mark.parametrize("blocks", [False, True])
def test_op8_recall(spark, blocks):
    sf = "/root/testdata/sf0.1"
    if blocks:  # several shards and blocks of queries in a partition
        got = neighbours.nearest(spark.read.parquet(f"{sf}/embeddings.parquet"), shard_rows=300, block_rows=30).toPandas()
    else:
        got = queries.QUERIES["op8_neighbours"](spark, sf).toPandas()
        assert got.groupby("query_id").size().eq(20).all() and got.query_id.nunique() == 100
    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    hit = total = 0
    for q, g in got.groupby("query_id"):
        own = int(np.flatnonzero(ids == q)[0])
        s = (x * x[own]).sum(axis=1)
        s[own] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        hit, total = hit + len({*best} & {*g.vec_id}), total + 20
        assert np.allclose(g.sort_values("rank").score, s[np.searchsorted(ids, g.sort_values("rank").vec_id)])
    assert hit / total >= 0.9


def brute_repeats(texts, w):
    words = [substring_dedup.words_of(t) for t in texts]
    c = Counter(tuple(x[i : i + w]) for x in words for i in range(len(x) - w + 1))
    return [[any(c[tuple(x[j : j + w])] > 1 for j in range(max(0, i - w + 1), min(i, len(x) - w) + 1)) for i in range(len(x))] for x in words]


@pytest.mark.parametrize("hot", [substring_dedup.HOT_SEGMENTS, 1])
def test_op9(spark, small, texts, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT_SEGMENTS", hot)
    got = queries.QUERIES["op9_substring_dedup"](spark, small).toPandas().set_index("doc_id")
    order = sorted(texts)
    for i, gone in zip(order, brute_repeats([texts[i] for i in order], 35), strict=True):
        kept = b" ".join(w for w, g in zip(substring_dedup.words_of(texts[i]), gone, strict=True) if not g)
        assert (got.loc[i].n_words, got.loc[i].n_removed, got.loc[i].kept_sha256) == (len(gone), sum(gone), hashlib.sha256(kept).hexdigest())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(2, 5), min_size=6, max_size=20), min_size=1, max_size=6), st.integers(2, 6))
def test_matching_statistics(parts, most):
    text = np.array([x for p in parts for x in (*p, 1)] + [0])
    index = substring_dedup.FMIndex(text)
    ends = np.flatnonzero(text > 1)[most:] + 1
    ends = ends[[bool((text[e - most : e] > 1).all()) for e in ends]]
    got = index.matching(text, ends, most)
    flat = text.tolist()
    for e, k in zip(ends.tolist(), got.tolist(), strict=True):
        count = lambda n, e=e: sum(flat[i : i + n] == flat[e - n : e] for i in range(len(flat)))
        assert k == 0 or count(k) > 1
        assert k == most or count(k + 1) == 1


def test_quality_removes_boilerplate_and_rejects_depleted(spark):
    from gazeflow.llm.line_quality import line_frequency_rules

    body = lambda i: " ".join(f"w{i}_{k}" for k in range(60))
    menu = "home about contact imprint terms"
    rows = [(i, f"{menu}\n{body(i)}", "h") for i in range(40)] + [(100, "\n".join([f"{menu.upper()} "] * 10 + ["a b c"]), "h"), (101, f"{menu}\n{body(101)}", "other")]
    got = {r.doc_id: r.rules for r in line_frequency_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].clean_text == body(0) and got[0].kept and got[0].n_removed_words == 5
    assert got[100].n_removed_lines == 10 and not got[100].kept
    assert got[101].n_removed_lines == 0 and got[101].kept


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    stages = dict(corpus_pipeline.STAGES)
    assert [*stages] == ["toxicity", "line_dedup", "simhash_near_dedup", "mixing", "packing"]
    out = {}
    for k, (name, f) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = f(spark, docs, d).cache()
        out[name] = docs
        counts.append(docs.count())
        assert docs.columns == names
    assert counts[1] <= counts[0] and counts[2] <= counts[1] and counts[3] <= counts[2]
    kept = {r.doc_id for r in out["simhash_near_dedup"].collect()}
    texts = [r.text for r in out["simhash_near_dedup"].collect()]
    assert len(set(texts)) == len(texts) and kept
    packed = corpus_pipeline.STAGES[4][1](spark, docs, d).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 1024 and set(packed.doc_id) == {r.doc_id for r in docs.collect()}


def test_pipeline_near_duplicates(spark):
    """The near-duplicate stage against true Jaccard of all pairs: pairs at 0.76 to 0.86, a chain, many near copies of one text, short
    and empty texts."""
    import corpus_pipeline

    rng = np.random.default_rng(11)
    new = lambda n: [f"v{i}" for i in rng.integers(0, 1 << 40, n)]
    texts = []
    for n in (24, 104, 504):
        for k in range(30):
            base = new(n)
            s, target = n - 4, 0.76 + 0.1 * k / 29
            shared = round(2 * s * target / (1 + target))
            texts += [base, base[: shared + 4] + new(s - shared)]
    hub = new(100)
    texts += [hub[k:] + new(k) for k in range(0, 40, 4)]
    for _ in range(60):
        c = list(hub)
        c[rng.integers(0, 100)] = "changed"
        texts.append(c)
    texts += [["short", "one"], ["SHORT", "one"], ["short", "two"], [], []]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1 if w else 0))} for w in ([x.lower() for x in t] for t in texts)]
    label = list(range(len(sets)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    close = 0
    for i, a in enumerate(sets):
        for j in range(i):
            either = len(a | sets[j])
            j_ij = len(a & sets[j]) / either if either else 1
            close += 0.8 <= j_ij <= 0.85
            if j_ij >= 0.8:
                x, y = sorted((top(i), top(j)))
                label[y] = x
    assert close > 30
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    got = {r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, "").collect()}
    assert got == {i for i in range(len(rows)) if top(i) == i}


def _without_repeats(texts):
    """Lines left of each text, by brute force: a repeated pair of adjacent lines stays where it is first."""
    at = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - 1):
            at.setdefault((t[k], t[k + 1]), []).append((i, k))
    held = {(i, k + d) for p in at.values() if len(p) > 1 for i, k in p[:1] for d in (0, 1)}
    gone = {(i, k + d) for p in at.values() for i, k in p[1:] for d in (0, 1)} - held
    return [[x for k, x in enumerate(t) if (i, k) not in gone] for i, t in enumerate(texts)]


def _line_stage(spark, texts):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, "\n".join(t), "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    return {r.doc_id: r.text for r in corpus_pipeline.line_dedup_stage(spark, docs, "").collect()}


def test_pipeline_short_blocks(spark):
    """Blocks of 2 to 15 lines in random documents lose all their lines in the second one."""
    rng = np.random.default_rng(5)
    new = lambda n: [f"line {i}" for i in rng.integers(0, 1 << 40, n)]
    texts, own = [], []
    for n in (2, 3, 5, 6, 8, 15):
        for _ in range(20):
            block, a, b = new(n), new(9), new(9)
            texts += [a[:4] + block + a[4:], b[:6] + block + b[6:]]
            own += [texts[-2], b]
    got = _line_stage(spark, texts)
    assert [got[i] for i in range(len(texts))] == ["\n".join(t) for t in own]
    assert _without_repeats(texts) == own


def test_pipeline_runs_of_equal_lines(spark):
    """Runs of one line or of a period of lines, of any length, go but for the first place of each pair of adjacent lines."""
    texts = [["top"] + ["same"] * 8 + ["end"], ["same"] * 1000, ["x", "same", "same", "same", "y"], ["a", "b"] * 40, ["c", "a", "b", "a", "d"], ["lone"], ["lone"]]
    want = {i: "\n".join(t) for i, t in enumerate(_without_repeats(texts)) if t}
    assert _line_stage(spark, texts) == want
    assert want[0] == "top\nsame\nsame\nend" and 1 not in want and want[2] == "x\ny"


def test_windows_verify_less_than_everything():
    """Searches of one shard: most neighbours are found and most vectors left unverified, also where windows have to widen."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 32))
    x[::3] = x[rng.integers(0, 100, 2000)] + 0.2 * rng.standard_normal((2000, 32))
    shard = neighbours.Shard(x, float(np.linalg.norm(x, axis=1).max()), 10)
    hit = verified = 0
    for i in range(60):
        rows, scores, n = shard.search(x[i], 10, np.array([i]))
        s = x @ x[i]
        s[i] = -np.inf
        hit += len({*np.argsort(-s)[:10].tolist()} & {*rows[np.argsort(-scores)[:10]].tolist()})
        verified += n
    assert hit >= 0.9 * 600 and verified < 0.5 * 60 * len(x)


def test_op4_very_long_runs(spark):
    """Texts of one class of characters, millions long, through the operator's own path."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, "😀" * 300_000, ("ab " + " " * 5000) * 50]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tokenizer=path).groupBy("doc_id").sum("length").collect()
    assert {i: n for i, n in rows} == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in enumerate(texts)}


def test_op5_recall_and_auc(spark):
    """Floors, for labels that weren't learnt and those that were."""
    got = queries.QUERIES["op5_toxicity"](spark, "/root/testdata/sf0.01").toPandas()
    m = got.merge(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas(), on="doc_id")
    for part in (m[m.held_out], m[~m.held_out]):
        bad, good = part.score[part.toxic == 1].to_numpy(), part.score[part.toxic == 0].to_numpy()
        assert (bad >= 0.5).mean() >= 0.55 and (good >= 0.5).mean() <= 0.02
        assert (bad[:, None] > good).mean() + 0.5 * (bad[:, None] == good).mean() >= 0.72


def test_few_labels_are_learnt(spark, small):
    """Where no run of letters reaches the usual floor, the best ones count."""
    got = queries.QUERIES["op5_toxicity"](spark, small).toPandas()
    m = got.merge(spark.read.parquet(f"{small}/labels.parquet").toPandas(), on="doc_id")
    assert (m.predicted[m.toxic == 1] == 1).mean() >= 0.5 and (m.predicted[m.toxic == 0] == 1).mean() <= 0.1


def test_long_words_train_by_the_windows_that_score():
    m = toxicity.fit({"idiot": 1.0, "moron": 1.0}, {w: 1.0 for w in ("table", "garden", "window", "reading", "paper")})
    for word in ("short", "x" * 30 + "idiot" + "y" * 40, "--" + "ab" * 40 + "!" + "moron"):
        parts = toxicity.windows_of(word)
        assert all(len(p) <= toxicity.WINDOW for p in parts)
        assert math.isclose(float(m.scores([word])[0]), float(m.scores(parts).max()), rel_tol=1e-5, abs_tol=1e-6)
