"""The pipeline: what each stage keeps, and the packed result against a plain version of it."""

import corpus_pipeline
import public_tokenizers
from tests.llm.test_suffix_dedup import brute as repeated

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, path):
    import random

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(70)]
    rows, labels, bad = [], [], []
    for i in range(400):
        w = [word() for _ in range(rng.choice([20, 120, 400]))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(1 + len(w) // 30):
                w[rng.randrange(len(w))] = rng.choice(["idiotx", "moronz", "stupidq"])
        elif i % 7 == 0:
            w[10:10] = passage
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
        bad += [i] * toxic
    clean = [r for r in rows if r[0] % 4]
    rows += [(1000 + k, clean[0][1]) for k in range(20)] + [(2000, None), (2001, "")]
    long = next(t.split() for i, t in clean if len(t.split()) > 300)
    rows += [(3000 + k, " ".join(long[: 200 + k] + ["changed"] + long[201 + k :])) for k in range(5)]
    spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else 0) for i, t in rows], COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return dict(rows), set(bad)


def test_stages_and_result(spark, tmp_path):
    from tokenizers import Tokenizer

    texts, bad = documents(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        kept[name] = {r.doc_id: r for r in docs.collect()}
    gone = set(texts) - set(kept["toxicity"])
    assert gone <= bad and len(gone) >= 0.95 * len(bad)  # a fitted model: clean documents stay, few others do
    one = kept["minhash_dedup"]
    assert not any(1000 <= i < 2000 or i >= 3000 for i in one) and {2000, 2001} <= set(one)
    assert len(one) == len(kept["toxicity"]) - 25
    left = kept["suffix_dedup"]
    assert set(left) == set(one) and all(r.text is None or r.n_chars == len(r.text) for r in left.values())
    marks = repeated([(i, r.text) for i, r in one.items()])
    for i, m in marks.items():
        if one[i].text is not None:
            assert left[i].text.split() == [w for w, gone in zip(one[i].text.split(), m, strict=True) if not gone]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {i: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for i, r in left.items()}
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == sizes


def test_rows_of_one_id_and_edges(spark, tmp_path):
    import random

    rng = random.Random(4)
    one, two = (" ".join(f"w{rng.randrange(900)}" for _ in range(80)) for _ in range(2))
    rows = [(1, one), (2, one), (2, two), (3, two), (4, "alone here"), (4, "alone here"), (None, one), (None, one), (5, None), (6, ""), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 7) for i, t in rows], COLUMNS)
    left = sorted((r.doc_id or 0, r.text or "") for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect())
    assert left == sorted([(0, one), (1, one), (2, two), (4, "alone here"), (5, ""), (6, "")])
    named = docs.withColumnRenamed("lang", "row_hash").withColumnRenamed("source", "node")
    assert corpus_pipeline.drop_near_duplicates(spark, named, str(tmp_path)).columns == named.columns
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and got.filter("doc_id = 5 and text is null").count() == 1


def test_near_copies_of_one_id_take_no_other_text_with_them(spark, tmp_path):
    import random

    rng = random.Random(11)
    text, other, alone = (" ".join(f"w{rng.randrange(900)}" for _ in range(80)) for _ in range(3))
    rows = [(3, text), (5, text + " more"), (5, alone), (9, other), (9, other + " more"), (9, other + " again")]
    docs = spark.createDataFrame([(i, t, "en", "s", 7) for i, t in rows], COLUMNS)
    left = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()]
    assert sorted(i for i, _ in left) == [3, 5, 9] and (3, text) in left and (5, alone) in left
