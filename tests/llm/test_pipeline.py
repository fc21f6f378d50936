"""The pipeline's stages on the smallest tables: each stage's decisions take effect."""

import corpus_pipeline as C
import pyarrow as pa
from maskwright.llm import decontamination as D

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        kept = {r.doc_id: r for r in out.collect()}
        before = {r.doc_id: r for r in docs.collect()}
        assert kept.keys() <= before.keys() and len(kept) > 0.5 * len(before)
        if stage is C.drop_repeated_lines:
            from test_native import windows

            assert {i: r.text for i, r in kept.items()} == {i: t for i, (t, _) in windows([(i, r.text) for i, r in before.items()]).items()}
        elif stage is C.drop_near_copies:
            from test_python_ops import jaccard_brute

            assert kept.keys() == {i for i, _, c in jaccard_brute([(i, r.text) for i, r in before.items()]) if i == c}
        docs = spark.createDataFrame(list(kept.values()), docs.schema)
    pieces = C.pack(spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == set(kept)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_on_awkward_rows(spark, tmp_path):
    """Nulls in every column, repeats, a very long text, extra columns with clashing names, and
    no rows at all: no stage fails, all but the last keep the columns, clean rows come through."""
    clean = [(i, " ".join(f"w{(i * 97 + j * 31) % 5000}" for j in range(60)), "en", "s", 1) for i in range(40)]
    rows = [*clean, (None, None, None, None, None), (50, None, "de", None, 0), (51, "", "en", "s", 0), clean[3], clean[3], (52, "long words here " * 20_000, "en", "s", 1), (None, clean[5][1], "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, flagged int, gone string, node long, _hash string, score double"
    docs = spark.createDataFrame([(*r, 1, "g", 2, "h", 0.5) for r in rows], schema)
    spark.createDataFrame([(i, 0, int(i % 9 == 0)) for i in range(20)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "what is the answer here? it is forty two and no more"), (None, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for frame in (docs, docs.limit(0)):
        for name, stage in C.STAGES:
            out = stage(spark, frame, str(tmp_path))
            got = out.collect()
            if name == "best-fit packing":
                assert len({(r.doc_id) for r in got}) == len({r.doc_id for r in frame.collect()})
            else:
                assert out.columns == docs.columns
                if frame is docs and name != "toxicity":
                    assert {r[0] for r in clean} <= {r.doc_id for r in got}
                    assert {50, 51} <= {r.doc_id for r in got} and sum(r.doc_id is None for r in got) == 2


def test_a_worker_gives_back_what_a_stage_freed(spark, monkeypatch):
    """The task of a stage leaves its worker little more memory than it found: the next stage's
    comes on top (packing went over 3000 MB an executor)."""
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    task = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: task.append(run) or self.selectExpr("*", "false AS leaked"))
    D.decontaminate(docs, [D.Index([1], ["what is the answer here? it is forty two and no more"])])

    def batches(n, rows):
        for k in range(n):
            texts = [" ".join(f"w{(i * 97 + j * 31 + k) % 5000}" for j in range(900)) for i in range(rows)]
            yield pa.RecordBatch.from_arrays([pa.array(range(rows)), pa.array(texts)], names=["doc_id", "text"])

    def held():
        with open("/proc/self/status") as f:
            return next(int(x.split()[1]) for x in f if x.startswith("RssAnon")) // 1024

    assert sum(map(len, task[0](batches(1, 20)))) == 20  # what is made once
    before = held()
    assert sum(map(len, task[0](batches(2, 6000)))) == 12_000
    assert held() - before < 45
