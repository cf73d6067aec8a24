"""The columns that the contracts name, with their types, of every numbered query on small tables and on empty ones."""

import random

import pytest
from helpers import docs, words, write

from timelode.llm.catalog import QUERIES

CONTRACTS = {
    "op1_": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op2_": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op4_": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op6_": "query_id bigint, rank int, vec_id bigint, score double",
    "op7_": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op8_": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op9_": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_": "page_id bigint, host string, path string, rule string, verdict string",
    "op11_": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
    "op12_": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op13_": "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    rng = random.Random(2)
    texts = [" ".join(words(rng.randint(1, 60), i)) for i in range(60)] + ["", None]
    some = {
        "documents": docs(spark, texts, langs=[("en", "fr")[i % 2] for i in range(62)]),
        "labels": spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(60)], "doc_id long, quality int, toxic int"),
        "pages": spark.createDataFrame([(i, f"http://a{i % 3}.net/x/{i}", "") for i in range(30)], "page_id long, url string, html string"),
        "embeddings": spark.createDataFrame([(i, [rng.random() for _ in range(64)], 0) for i in range(40)], "vec_id long, embedding array<float>, label int"),
    }
    return write(tmp_path_factory.mktemp("some"), **some), write(tmp_path_factory.mktemp("none"), documents=docs(spark, []))


@pytest.mark.parametrize("prefix", CONTRACTS)
def test_columns_and_types(spark, folders, prefix):
    name, = (n for n in QUERIES if n.startswith(prefix))
    want = dict(c.split() for c in CONTRACTS[prefix].split(", "))
    for folder in folders:
        out = QUERIES[name](spark, folder)
        assert {c: t for c, t in out.dtypes if c in want} == want
        assert (out.count() > 0) == (folder == folders[0])
