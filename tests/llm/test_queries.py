"""The registered queries, their SQL, and the pipeline stage by stage."""

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from playtrail.llm import decontaminate, langid, pii, simhash
from playtrail.llm.queries import ORACLES, QUERIES
from playtrail.llm.shared import table
from tests.compare import assert_same, connect
from tests.llm.test_nearcopies import slow_groups

FOLDER = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    assert [sum(n.startswith(f"op{i}_") for n in QUERIES) for i in range(1, 14)] == [1] * 13
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert assert_same(spark, connect(FOLDER), FOLDER, QUERIES[name], ORACLES[name]) > 0


@pytest.mark.parametrize("name, columns", [
    ("op2_token_files", {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}),
    ("op3_language_id", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}),
    ("op4_nearest_by_collisions", {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}),
    ("op7_pii_bilstm_crf", {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint",
                            "base_sha256": "string", "spans": "string"}),
    ("op8_secret_linking", {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string",
                            "spans": "string"}),
    ("op9_simhash_near_duplicates", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}),
    ("op10_byte_level_bpe", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}),
])
def test_columns(spark, name, columns):
    out = QUERIES[name](spark, FOLDER)
    assert dict(out.dtypes).items() >= columns.items()
    rows = out.count()
    assert rows > 0 and (name.startswith("op4") or rows == table(spark, FOLDER, "documents").count())


def test_pipeline_equals_its_parts(spark):
    docs = table(spark, FOLDER, "documents")
    given = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = langid.fit(docs)
    known = {i: t for i, t in given.items() if langid.predict_text(model, t)[1] >= model["threshold"]}
    names = slow_groups(sorted(known.items()))
    first = {i: t for i, t in known.items() if names[i] == i}
    items = [r["text"] for r in table(spark, FOLDER, "benchmark").collect()]

    def leaks(text):
        at = decontaminate._signed(decontaminate.seeds_of(text)).tolist()
        for item in items:
            seeds = decontaminate._signed(decontaminate.seeds_of(item)).tolist()
            tiles = decontaminate.tiles_of({p: s for p, s in enumerate(at) if s in set(seeds)}, seeds)
            if sum(t[2] for t in tiles) >= decontaminate.THRESHOLD * (len(seeds) + decontaminate.MIN_MATCH - 1):
                return True
        return False

    clean = {i: t for i, t in first.items() if not leaks(t)}
    assert len(clean) < len(first) < len(given)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert set(got) == set(clean)
    for i, r in got.items():
        fixed = pii.base_spans(clean[i])
        if not fixed and not list(pii.windows_of(clean[i])):
            assert r["text"] == clean[i]
        assert not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        assert r["n_tokens"] == len(np.frombuffer(bytes(r["ids"]), "<u4"))


def test_stages_keep_the_columns(spark):
    docs = table(spark, FOLDER, "documents").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns
        assert stage(spark, docs.where("false"), FOLDER).count() == 0
    assert set(docs.columns) < set(corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).columns)
    assert simhash.keep_one_per_group(docs).count() > 0
