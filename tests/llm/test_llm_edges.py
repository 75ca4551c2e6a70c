"""All operators on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

from gazeflow.llm import jaccard, lattice_lm, line_dedup, line_quality, mixing, neighbours, packing, simhash, substring_dedup, toxicity, warc

LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
LINES = "first line here\nsecond line there\nthird one\nfourth"
ROWS = [
    (1, LINES, "a"), (2, LINES + "\nmore\nlines", "a"), (3, None, "b"), (4, "", None), (5, "   \n\t ", "a"), (6, LONG, "b"), (6, LONG, "b"), (None, "no id here", None), (None, None, None), (7, "x " * 60, "c"), (8, "y" * 5000, "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    extra = ["key", "size", "row", "words", "doc", "n", "Text_", "c0", "rules", "score", "group_id", "p"]
    return df.select("*", *(F.lit(str(i)).alias(c) for i, c in enumerate(extra)))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 1), (2, 1, 0), (None, 1, 1), (6, None, None), (7, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def bpe():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def run_all(docs, labels, vocabulary, bpe):
    return {
        "line_dedup": line_dedup.line_dedup(docs)[0].drop("row"), "deduplicated": line_dedup.deduplicated(docs), "near": jaccard.near_duplicates(docs), "near_bits": simhash.near_duplicates(docs), "one": simhash.one_of_each(docs, jaccard.near_duplicates), "pack": packing.pack(docs, tokenizer=bpe, with_ids=True),
        "toxicity": toxicity.toxicity(docs, labels, learns="true"), "mix_plan": mixing.mix_plan(docs), "mix": mixing.mix(docs), "lm": lattice_lm.score(docs, vocabulary=vocabulary), "substring": substring_dedup.substring_dedup(docs), "quality": line_quality.line_frequency_rules(docs),
    }


def test_odd_rows(docs, labels, vocabulary, bpe):
    out = {k: v.collect() for k, v in run_all(docs, labels, vocabulary, bpe).items()}
    n = len(ROWS)
    for k in ("line_dedup", "near", "near_bits", "toxicity", "mix_plan", "lm", "substring", "quality"):
        assert len(out[k]) == n, k
    # Line dedup: the chunk of documents 1 and 2 stays in 1; equal rows lose alike.
    kept = {r.doc_id: r.kept_text for r in out["line_dedup"] if r.doc_id is not None}
    assert kept[1] == LINES and kept[3] is None and kept[4] == "" and kept[7] == "x " * 60
    # SimHash: texts without words are one group, whose first is 3; of equal rows one stays.
    near = {r.doc_id: r.component_id for r in out["near"]}
    assert near[3] == near[4] == near[5] == 3 and near[6] == 6
    stay = sorted((r.doc_id for r in out["one"]), key=str)
    assert stay.count(6) == 1 and 4 not in stay and 5 not in stay and 3 in stay
    assert {r.component_id for r in out["near"] if r.doc_id is None} == {3, None}
    # Packing: one id for a text without any; pieces cover each document; sequences are gapless.
    by_doc = {}
    for r in out["pack"]:
        by_doc.setdefault(r.doc_id, []).append(r)
        assert len(r.ids) == r.length
    assert [r.length for r in by_doc[3]] == [1] and sum(r.piece == 0 for r in by_doc[6]) == 2 and len(by_doc[None]) == 2
    seqs = {}
    for r in out["pack"]:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 1024
    # Toxicity: texts without words score alike, and between 0 and 1.
    tox = {r.doc_id: r.toxicity_score for r in out["toxicity"]}
    assert tox[3] == tox[4] == tox[5] and all(0 <= x <= 1 for x in tox.values())
    # Mixing: sizes 0 take nothing; nothing is over twice its size.
    assert all(r.taken <= 2 * r.size for r in out["mix_plan"])
    words = sum(len((r.text or "").split()) for r in out["mix"])
    assert words == sum(r.taken for r in out["mix_plan"])
    # Language model: a text without words has its end alone.
    lm = {r.doc_id: r for r in out["lm"]}
    assert lm[3].n_tokens == 1 and lm[3].score == lm[4].score == lm[5].score and lm[6].n_tokens == 30_001
    # Repeated passages: equal rows remove each other whole; a text may repeat itself.
    sub = {r.doc_id: r for r in out["substring"]}
    assert sub[6].n_removed == sub[6].n_words == 30_000 and sub[7].n_removed == 60 and sub[1].n_removed == 0 and sub[3].kept == ""
    rules = {r.doc_id: r["rules"] if not isinstance(r["rules"], str) else r[-1] for r in out["quality"]}
    assert rules[3].base_failed and rules[3].clean_text == "" and rules[6].kept and rules[7].n_repeat_words == 60


def test_empty_tables(spark, docs, labels, vocabulary, bpe):
    for k, v in run_all(docs.limit(0), labels.limit(0), vocabulary, bpe).items():
        assert v.count() == 0, k
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_labels_of_one_class(docs, labels):
    out = toxicity.toxicity(docs, labels.where("toxic = 0"), learns="true").collect()
    assert len({r.toxicity_score for r in out}) == 1 and out[0].toxicity_predicted == 0


def test_column_names_in_other_cases(spark):
    df = spark.createDataFrame([(1, "one two three")], "DOC_ID long, TEXT string").select("*", F.lit("other").alias("text2"))
    assert substring_dedup.substring_dedup(df).first().n_words == 3


def test_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (5, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (9, [float("inf"), 1.0]), (10, [2.0]), (11, []), (None, [5.0, 5.0]), (5, [0.5, 0.5])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("query_id", "rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in got if r.query_id == 0] == [(1, 10, 2.0), (2, 3, 1.0), (3, 5, 1.0), (4, 20, 1.0), (5, 5, 0.5)]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_odd_pages(spark, tmp_path, compression):
    rows = [(3, "http://a", "x" * 5000), (1, "http://b c\r\n", "x" * 5000), (2, None, None), (5, "u", ""), (None, "n", "x" * 5000), (7, "z", "é"), (8, "q", "ü" * 200_000), (7, "z", "é")]
    path = str(tmp_path / "w")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash")), path, compression=compression)
    back = spark.read.format("warc").load(path)
    got = {r.page_id: r for r in back.collect()}
    assert back.count() == len(rows)
    assert got[1].record_type == "response" and got[1].target_uri == "http://b c\r\n" and got[1].payload == b"x" * 5000
    assert got[3].record_type == "revisit" and got[3].refers_to == 1 and got[3].payload_bytes == 5000 and got[3].payload is None
    assert got[None].record_type == "revisit" and got[5].refers_to == 2 and got[2].target_uri is None and got[8].payload_bytes == 400_000
    assert back.where("page_id = 7").where("record_type = 'response'").count() == 2  # equal first rows are both responses
    assert [r.page_id for r in back.where("record_type = 'revisit' AND page_id = 3").select("page_id").collect()] == [3]
    assert spark.read.format("warc").schema("page_id long").load(path).where("page_id IS NULL").count() == 1
    empty = str(tmp_path / "e")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), empty, compression=compression)
    assert spark.read.format("warc").load(empty).count() == 0


def test_warc_from_other_writers(spark, tmp_path):
    import gzip

    block = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nhello"
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://x\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "f.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(record) + gzip.compress(record))
    warc.register(spark)
    got = spark.read.format("warc").load(str(tmp_path)).where("record_type = 'response'").select("target_uri", "payload").collect()
    assert [(r.target_uri, r.payload) for r in got] == [("http://x", b"hello")] * 2
