import hashlib
import re

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluice.llm.bpe import read_vocabulary
from sluice.llm.minhash import FEATURES, frequencies, idf_of, jaccard
from sluice.llm.mixing import DOCUMENT_WEIGHTS, mixed
from sluice.llm.quality import SELECT, document_model, score
from sluice.llm.shared import written

from test_minhash import classes_of, slow_sets
from test_secret_scan import slow_spans

DIR = "/root/testdata/sf0.001"


def test_stages_are_slow_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DIR), name)
        out.append(docs)
    quality, dedup, secrets, mix, bpe = ({r.doc_id: r for r in d.collect()} for d in out)
    assert all(d.columns == columns for d in out[:4])

    raw = spark.read.parquet(f"{DIR}/documents.parquet")
    wanted = {r.doc_id for r in score(raw, document_model(spark, DIR)).collect() if r.tail_probability >= SELECT}
    assert set(quality) == wanted and len(wanted) > 100

    ids = sorted(quality)
    texts = [quality[i].text for i in ids]
    idf = idf_of(frequencies(out[0].select("text"))[:FEATURES], len(ids))
    sets = slow_sets(texts)
    link = []
    for a in range(len(ids)):
        sim = jaccard(pa.array([texts[a]] * len(ids)), pa.array(texts), idf)
        link += [(a, b) for b in range(a + 1, len(ids)) if sim[b] >= 0.8 or not sets[a] and texts[a] == texts[b]]
    assert set(dedup) == {ids[c] for c in classes_of(len(ids), link)}

    order = sorted(dedup)
    for i, (_, spans) in zip(order, slow_spans([dedup[i].text for i in order]), strict=True):
        text, at = "", 0
        for s, _, e in spans:
            if s >= at:
                text += dedup[i].text[at:s] + "[SECRET]"
            at = max(at, e)
        text += dedup[i].text[at:]
        assert secrets[i].text == text and secrets[i].n_chars == len(text)
    assert not any(re.search("AKIA[A-Z0-9]{12}", r.text) for r in secrets.values())

    places = {r.doc_id: (r.slot, r.offset) for r in mixed(out[2], DOCUMENT_WEIGHTS).collect()}
    assert [r.doc_id for r in out[3].collect()] == sorted(secrets, key=places.get)

    library = Tokenizer.from_str(read_vocabulary())
    assert set(bpe) == set(mix)
    for i, r in bpe.items():
        want = library.encode(mix[i].text, add_special_tokens=False).ids
        assert r.ids == want and r.decoded_sha256 == hashlib.sha256(mix[i].text.encode()).hexdigest()


def test_odd_documents(spark):
    rows = [(1, "the same text of six words", "en", "a", 26), (1, "the same text of six words", "en", "a", 26), (None, None, None, None, None), (2, "", "en", None, 0), (3, "token = abcdefgh1234", "en", "b", 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    more = {"spans": 1, "base": 2, "tail_probability": 3, "expected_grade": 4, "text_hash_": 5, "id_": 6, "slot": 7, "kept": 8, "id": 9, "mix_place_": 10}
    docs = docs.withColumns({k: F.lit(v) for k, v in more.items()})
    for d, n in ((docs, 4), (docs.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES[1:4]:
            d = written(stage(spark, d, DIR), name)
            assert d.columns == docs.columns and all(r[k] == v for r in d.collect() for k, v in more.items())
        assert {(r.text, r.n_chars) for r in d.collect() if r.doc_id == 3} == ({("[SECRET]", 8)} if n else set())
        assert corpus_pipeline.STAGES[4][1](spark, d, DIR).count() == n
        corpus_pipeline.STAGES[0][1](spark, d, DIR).collect()


def test_run(spark):
    got = corpus_pipeline.run(spark, DIR)
    assert got.count() > 100 and got.columns[:2] == ["doc_id", "n_tokens"]


def test_run_is_in_the_order_of_the_mix(spark, tmp_path, monkeypatch):
    """Several files of unequal size, the later ones larger."""
    rows = [(i, "word " * (1 + i % 7) + str(i), f"src{i % 4}" if i % 5 else None) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    places = {r.doc_id: (r.slot, r.offset) for r in mixed(docs, DOCUMENT_WEIGHTS).collect()}
    last = max(places.values())[0]
    late = [i for i, p in places.items() if p[0] > last // 2]
    docs = docs.withColumn("text", F.when(F.col("doc_id").isin(late), F.repeat("text", 20)).otherwise(F.col("text")))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[3:])
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == sorted(places, key=places.get)
