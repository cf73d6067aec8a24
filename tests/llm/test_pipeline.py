"""The corpus pipeline on a small folder, stage by stage."""

import random

from helpers import UPPER, brute_components, docs, words, write

import corpus_pipeline
from timelode.llm import packing, quality, toxicity
from timelode.llm._common import table


def test_stages_follow_each_other(spark, tmp_path):
    rng, texts, labels = random.Random(8), [], []
    for i in range(260):
        w, toxic, good = words(rng.randint(20, 60), i), rng.random() < 0.3, rng.random() < 0.75
        if toxic:
            w[3:3] = ["vile", "awful"]
        texts.append(" ".join(w if good else [x.upper() + "!!" for x in w]))
        labels.append((i, int(good), int(toxic)))
    clean = [i for i, g, t in labels if g and not t]
    for k in range(12):
        texts.append(texts[clean[k]])
        w = texts[clean[k + 12]].split() * 4
        texts.append(" ".join(w))
        w[5] = f"z{k}"
        texts.append(" ".join(w))
    texts += ["", None]
    folder = write(tmp_path, documents=docs(spark, texts).repartition(3), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "exact_dedup", "near_dedup", "packing"]
    frame, kept = table(spark, folder, "documents"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in frame.collect()}
        out = stage(spark, frame, folder)
        assert out.columns == frame.columns
        out.write.parquet(f"{tmp_path}/{name}")
        if name == "toxicity":
            model = toxicity.fit(frame, table(spark, folder, "labels"))
            want = {r.doc_id for r in frame.select("doc_id", toxicity.scored(frame, model).alias("s")).collect() if r.s < 0.5}
        elif name == "quality":
            model = quality.fit(frame, table(spark, folder, "labels"))
            want = {r.doc_id for r in frame.select("doc_id", quality.scored(frame, model).alias("s")).collect() if r.s >= 0.7}
        elif name == "exact_dedup":
            last = {}
            for i, t in before.items():
                key = (t or "").translate(UPPER)
                last[key] = max(i, last.get(key, -1))
            want = set(last.values())
        else:
            want = {i for i, (_, c) in brute_components(before.items()).items() if c == i}
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in frame.collect()}
        assert kept[name] == want
    assert not {i for i, _, t in labels if t} & kept["near_dedup"]
    assert len(kept["near_dedup"]) < len(kept["exact_dedup"]) < len(kept["quality"]) < len(kept["toxicity"])
    final = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in final} == kept["near_dedup"]
    want = packing.pieces(frame).count()
    assert len(final) == want


def test_empty_folder(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(tmp_path, documents=docs(spark, []))).count() == 0
