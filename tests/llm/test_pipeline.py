import random

import corpus_pipeline
from hinoki.llm import bpe


def test_stages_on_planted_cases(spark, tmp_path):
    r = random.Random(1)
    word = lambda: r.choice("abcdefg") + "".join(r.choice("aeiou") + r.choice("rstlm") for _ in range(r.randrange(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows, labels = [], []
    for i in range(400):
        w = text(r.randrange(40, 120)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(5):
                w.insert(r.randrange(len(w)), r.choice(["nasty", "vile"]))
        rows.append((i, " ".join(w)))
        if i >= 20:
            labels.append((i, 1, int(toxic)))
    passage, item = text(70), text(40)
    rows += [(1000, rows[41][1]), (1001, rows[41][1] + " extra"), (1002, text(50) + " " + passage + " " + text(30)), (1003, text(40) + " " + passage), (1004, text(100) + " " + item + " " + text(20)), (1005, None), (1006, ""), (None, text(30))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")

    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    out, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = spark.createDataFrame(stage(spark, now, d).collect(), stage(spark, now, d).schema)
        out[name] = now
        if name != "tokens":
            assert now.columns == docs.columns
    ids = {k: {x.doc_id for x in v.select("doc_id").collect()} for k, v in out.items()}
    clean = {i for i, _ in rows if i is None or i % 4 or i >= 1000}
    assert clean <= ids["toxicity"] and len(ids["toxicity"] - clean) <= 5
    assert ids["toxicity"] - ids["near_duplicates"] == {1000, 1001}
    kept = {x.doc_id: x for x in out["repeated_strings"].collect()}
    assert passage not in kept[1002].text and passage not in kept[1003].text and kept[1002].n_chars == len(kept[1002].text)
    assert all(kept[i].text == dict(rows)[i] for i in range(1, 40) if i % 4)
    assert ids["repeated_strings"] - ids["benchmark"] == {1004} and {1005, 1006, None} <= ids["benchmark"]
    codec = bpe.Codec(bpe.tokenizer_json())
    last = {x.doc_id: x for x in out["tokens"].collect()}
    assert bytes(last[1].ids) == codec.encode([dict(rows)[1]])[0] and last[1005].n_tokens == 0
    assert corpus_pipeline.run(spark, d).count() == out["tokens"].count()
