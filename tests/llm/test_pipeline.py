"""The stages against plain Python on a small table."""

import os

import public_tokenizers as P
import tiktoken
from tests.llm.test_simhash import brute_fingerprint, brute_groups

import corpus_pipeline
from weftgraph.llm import bpe, pii
from weftgraph.llm.queries_pii import KEY

TABLE = "doc_id long, text string, lang string, source string, n_chars long"


def prose(k, n=80):
    return " ".join(f"w{(i * i * (k + 3) + 7 * i + k) % 997}" for i in range(n))


def test_all_stages(spark, tmp_path):
    rows = [(i, prose(i), "en", f"src{i % 3}", 1) for i in range(30)]
    rows += [(40, rows[3][1], "en", "src0", 1), (41, rows[3][1] + " tail", "en", "src1", 1), (None, prose(77), None, None, None), (42, None, "en", "src1", 0), (43, "short", "en", "src1", 5), (44, "spam " * 90, "fr", "src2", 9), (5, prose(5), "en", "src2", 1)]
    rows += [(50, prose(50) + " mail ab.12@mail8.example.com now", "de", "src1", 1)]
    spark.createDataFrame(rows, TABLE).write.parquet(os.path.join(tmp_path, "documents.parquet"))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, str(tmp_path)).cache()
    assert sorted(kept.columns) == sorted(docs.columns)
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {42, 43, 44}
    left = kept.collect()
    fps = [brute_fingerprint(r.text) for r in left]
    groups = brute_groups([r.doc_id for r in left], fps)
    alone = corpus_pipeline.near_duplicates(spark, kept, str(tmp_path)).cache()
    assert sorted(r.doc_id for r in alone.collect() if r.doc_id is not None) == sorted({g for g in groups if g is not None})
    masked = corpus_pipeline.pseudonyms(spark, alone, str(tmp_path)).collect()
    plain = {r.doc_id: r.text for r in alone.collect()}
    assert all(r.text == pii.Masker(KEY).mask(plain[r.doc_id])[0] for r in masked)
    assert "mail8.example.com" in next(r.text for r in masked if r.doc_id == 50) and "ab.12@" not in next(r.text for r in masked if r.doc_id == 50)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    text = {r.doc_id: r.text for r in masked}
    assert out and all(r.ids == " ".join(map(str, theirs.encode_ordinary(text[r.doc_id]))) for r in out)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], TABLE).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_names_equal_file_names_and_repeated_rows(spark, tmp_path):
    names = ["_row", "row", "_taken", "_stays", "_spans", "pii_spans", "_bucket", "kept", "n_words", "domain", "tokens", "key", "leaf", "path"]
    schema = f"{TABLE}, {', '.join(f'{n} string' for n in names)}"
    for k in range(2):
        rows = [(i + 30 * k, prose(i + 30 * k), "en", f"src{i % 3}", 1, *names) for i in range(12)] + [(7, prose(3), None, None, None, *names)] * 2
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/new/{k}")
        (tmp_path / "documents" / f"p={k}").mkdir(parents=True)
        next((tmp_path / "new" / str(k)).glob("part-*.parquet")).rename(tmp_path / "documents" / f"p={k}" / "part-0.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents")
    want = {"quality rules": 28, "near duplicates": 24, "pseudonyms": 24, "mixing": 24}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name in want:
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.schema(out.schema).parquet(f"{tmp_path}/{k}")
            got = docs.collect()
            assert all(r[n] == n for r in got for n in names) and len(got) == want[name] or name == "mixing"
        assert out.count() > 0
