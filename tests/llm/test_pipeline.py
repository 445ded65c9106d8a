import duckdb
import numpy as np
import tiktoken

import corpus_pipeline as P
from tests.llm.test_queries import shingles, similar
from veilframe.llm import bpe, pii, quality
from veilframe.llm.queries import ORACLE_SQL


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in P.STAGES:
        source = {r.doc_id: r.text for r in docs.collect()} if name in ("near_duplicates", "decontamination") else {}
        docs = P.stage_table(stage(spark, docs, small), name)
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "byte_bpe":
            assert docs.columns == columns
        if name == "quality_rules":  # the verdicts that are compared with an EM by hand elsewhere
            assert kept[name] == {r.doc_id for r in quality.op6_quality_rules(spark, small).where("kept").collect()}
        if name == "near_duplicates":
            groups = similar({i: shingles(t, 5) for i, t in source.items()}, 80)
            assert kept[name] == {i for i, c in groups.items() if i == c}
        if name == "decontamination":
            con = duckdb.connect()
            con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{small}/benchmark.parquet'")
            con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
            con.executemany("INSERT INTO documents VALUES (?, ?)", list(source.items()))
            assert kept[name] == {r[0] for r in con.execute(f"SELECT doc_id FROM ({ORACLE_SQL['op5_decontaminate']}) WHERE NOT contaminated").fetchall()}
            before = {r.doc_id: r.text for r in docs.collect()}
        if name == "personal_data":
            tagger = pii.trained_tagger()
            for r in docs.collect():
                rules, added = pii.find_spans(tagger, [before[r.doc_id]])[0]
                assert r.text == pii.redact(before[r.doc_id], rules + added) and r.n_chars == len(r.text)
            texts = {r.doc_id: r.text for r in docs.collect()}
    sizes = [len(kept[n]) for n, _ in P.STAGES]
    assert sizes == sorted(sizes, reverse=True) and sizes[0] < 200
    good = {i for i, q in duckdb.sql(f"SELECT doc_id, quality FROM '{small}/labels.parquet'").fetchall() if q}
    long = {i for i, n in duckdb.sql(f"SELECT doc_id, len(regexp_split_to_array(text, '\\s+')) FROM '{small}/documents.parquet'").fetchall() if n >= 55}
    assert len(good & long & kept["quality_rules"]) >= 0.95 * len(good & long)
    path, pattern = bpe.default_vocabulary()
    public = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    for r in docs.collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == public.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(ids)


def test_empty_and_awkward_documents(spark, small):
    rows = [(None, "x " * 60, "en", "s", 1), (1, None, None, None, None), (2, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for docs_ in (docs, docs.limit(0)):
        out = docs_
        for name, stage in P.STAGES:
            out = P.stage_table(stage(spark, out, small), name)
        assert out.count() == 0


def test_columns_named_like_our_own_pass_through(spark, small):
    text = " ".join("the cat and the dog of a house that is for all with on by was it as from w%d" % i for i in range(20))
    rows = [(1, text, "a", "b", "c", "d"), (2, text, "e", "f", "g", "h"), (3, "short", "i", "j", "k", "l")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, veil_q string, veil_hit string, veil_gone string, VEIL_W string")
    for name, stage in P.STAGES[:4]:
        docs = P.stage_table(stage(spark, docs, small), name)
        assert docs.columns == ["doc_id", "text", "veil_q", "veil_hit", "veil_gone", "VEIL_W"], name
    assert all(tuple(r) in rows for r in docs.collect())


def test_rows_that_repeat_id_and_text_leave_one(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(4, a, "en"), (4, a, "de"), (4, a + " end", "en"), (7, a + " tail", "en"), (9, b, "en"), (9, b, "en"), (4, b, "fr"), (None, a, "en"), (None, a, "en"), (11, None, "en"), (11, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, veil_gone string")
    out = sorted(((r.doc_id, r.text) for r in P.near_duplicates(spark, docs, "").collect()), key=str)
    assert [x for x in out if x[0] not in (4,)] == [(11, None), (11, None), (None, a), (None, a)]
    of_four = [t for i, t in out if i == 4]
    assert len(of_four) == 2 and of_four.count(b) == 1
