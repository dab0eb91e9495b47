"""The pipeline on a small corpus with planted cases, stage by stage."""

import random

import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from aliasmith.llm import bpe


def words(r, n):
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(n))


def test_planted_cases(spark, tmp_path):
    r = random.Random(1)
    bad, good = [words(r, 1) for _ in range(12)], [words(r, 1) for _ in range(2000)]
    clean = lambda n: " ".join(r.choices(good, k=n))
    text = {i: clean(150) for i in range(300)}
    toxic = set(range(0, 300, 6))
    for i in toxic:
        text[i] += " " + " ".join(r.choices(bad, k=40))
    item, passage = clean(25), clean(80)
    text[1] = f"{clean(60)} {item} {clean(60)}"
    for i in (2, 3, 4):
        text[i] = f"{clean(90)} {passage} {clean(90)}"
    text[400], text[401] = text[5], text[7] + " end"
    text[402], text[403] = "", None
    ids = list(text)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array([text[i] for i in ids]), "lang": ["en"] * len(ids), "source": ["s"] * len(ids), "n_chars": pa.array([len(text[i] or "") for i in ids], pa.int64())}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(range(300), pa.int64()), "quality": pa.array([1] * 300, pa.int64()), "toxic": pa.array([int(i in toxic) for i in range(300)], pa.int64())}), tmp_path / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([0], pa.int64()), "text": [item]}), tmp_path / "benchmark.parquet")

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept, left = {}, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, left, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        left = spark.read.parquet(str(tmp_path / f"stage{k}"))
        kept[name] = {x.doc_id: x for x in left.collect()}
    assert set(text) - set(kept["toxicity"]) == toxic
    assert set(kept["toxicity"]) - set(kept["near duplicates"]) == {400, 401}
    assert set(kept["near duplicates"]) == set(kept["substring"])
    cut = {i for i, x in kept["substring"].items() if x.text != text[i]}
    assert cut == {3, 4} and all(passage not in kept["substring"][i].text and kept["substring"][i].n_chars == len(kept["substring"][i].text) for i in cut)
    assert passage in kept["substring"][2].text
    assert set(kept["substring"]) - set(kept["decontamination"]) == {1}
    end = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(end) == set(kept["decontamination"])
    back = {x.doc_id: x.text for x in bpe.decode(corpus_pipeline.run(spark, str(tmp_path))).collect()}
    assert back == {i: x.text for i, x in kept["decontamination"].items()}
    assert [f[0] for f in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "substring", "decontamination", "bpe"]
