"""Row numbers that stay while the splits of the files change between jobs, and columns of any name."""

import pytest

import corpus_pipeline
from creditgrain.llm import decontamination, exact_dedup, parity_join, substring_index
from creditgrain.llm.common import numbered, table

DATA = "/root/testdata/sf0.001"
NAMES = ("row", "row_", "_row", "_found", "path", "place", "key", "n", "text_")


@pytest.fixture
def splits(spark):
    """Sets how finely files are split."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n, None) for n in names}

    def use(fine):
        spark.conf.set(names[0], "20k" if fine else "128m")
        spark.conf.set(names[1], 12 if fine else 2)
        spark.conf.set(names[2], "1k" if fine else "4m")

    yield use
    for n, value in before.items():
        spark.conf.unset(n) if value is None else spark.conf.set(n, value)


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """The documents in several files, with columns named like those of the operators."""
    path = str(tmp_path_factory.mktemp("wide") / "documents.parquet")
    docs = table(spark, DATA, "documents")
    for k, name in enumerate(NAMES):
        docs = docs.selectExpr("*", f"concat('{name}', doc_id) as `{name}`") if k % 2 else docs.selectExpr("*", f"doc_id * 10 as `{name}`")
    docs.repartition(5).write.parquet(path)
    return path


def rows(df):
    return sorted((r.doc_id, r.text, *[r[n] for n in NAMES]) for r in df.collect())


def test_numbers_stay(spark, wide, splits):
    found = []
    for fine in (False, True):
        splits(fine)
        docs = numbered(spark.read.parquet(wide), "number")
        found.append({r.number: r.doc_id for r in docs.collect()})
    assert found[0] == found[1] and len(found[0]) == len(set(found[0].values()))
    derived = numbered(spark.read.parquet(wide).where("doc_id % 2 = 0"), "number")
    splits(False)
    first = {r.number: r.doc_id for r in derived.collect()}
    splits(True)
    assert first == {r.number: r.doc_id for r in derived.collect()}


@pytest.mark.parametrize("way", ["exact", "near", "decontaminate"])
def test_stages_under_changing_splits(spark, wide, splits, monkeypatch, way):
    stage = getattr(corpus_pipeline, way)
    want = rows(stage(spark, spark.read.parquet(wide), DATA))
    assert 0 < len(want) <= spark.read.parquet(wide).count()
    for module, name in ((exact_dedup, "build_index"), (parity_join, "bloom_of"), (decontamination, "contained_items")):
        right = getattr(module, name)

        def finer(*args, right=right, **more):
            out = right(*args, **more)
            splits(True)
            return out

        monkeypatch.setattr(module, name, finer)
    splits(False)
    out = stage(spark, spark.read.parquet(wide), DATA)
    assert out.columns == spark.read.parquet(wide).columns
    assert rows(out) == want


def test_passages_under_changing_splits(spark, wide, splits, monkeypatch):
    want = sorted(tuple(r) for r in substring_index.remove_repeats(spark.read.parquet(wide)).collect())
    right = substring_index.bloom_of

    def finer(*args):
        out = right(*args)
        splits(True)
        return out

    monkeypatch.setattr(substring_index, "bloom_of", finer)
    splits(False)
    assert sorted(tuple(r) for r in substring_index.remove_repeats(spark.read.parquet(wide)).collect()) == want


def test_stages_on_odd_rows_and_empty_tables(spark, odd, odd_rows, empty, tmp_path):
    benchmark = spark.createDataFrame([(None, "the quick brown fox jumps over the lazy dog."), (1, "no number at all, no number")], "item_id long, text string")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1), (6, 1), (13, 0), (None, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    texts = [t or "" for _, t, _ in odd_rows]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, str(tmp_path)).collect()
        assert stage(spark, empty, str(tmp_path)).count() == 0
        kept[name] = sorted((r.doc_id is not None, r.doc_id or 0) for r in out)
        if name != "byte_bpe":
            assert {r.row for r in out} <= {"x"}
    assert len(kept["exact_dedup"]) == len(set(texts)) and len(kept["byte_bpe"]) == len(texts)
    # rows without an id are searched, and items without one are found
    gone = {1, 2, None}
    assert {i if has else None for has, i in kept["decontamination"]} == {d for d, _, _ in odd_rows} - gone
