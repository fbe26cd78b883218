"""Readers and sinks: TSV with a declared schema, fail-fast, partition overwrite, run log."""

import pytest

from seqlabel.operators import curate as C
from seqlabel.session import fresh_path
from seqlabel.sources import readers as R
from seqlabel.sources import sinks as K

SCHEMA = "Sequence string, Membrane int, Cytoplasm int, `Lysosome/Vacuole` int"


def test_tsv_with_header_and_label_discovery(spark):
    path = fresh_path(spark, "tsv")
    spark.createDataFrame([("MKV", 0, 1, 0), ("AAGL", 1, 0, 1)], SCHEMA).coalesce(1) \
        .write.option("header", "true").option("sep", "\t").csv(path)
    df = R.read_sequences(spark, path, fmt="tsv", schema=SCHEMA)
    p = C.project(df, "Sequence", drop=["Membrane"], id_col=None)
    assert p.columns == ["Cytoplasm", "Lysosome/Vacuole", "combined"]
    assert C.label_columns(p) == ["Cytoplasm", "Lysosome/Vacuole"]
    rep = {r["column"]: r for r in C.validate(p, C.label_columns(p)).collect()}
    assert rep["Lysosome/Vacuole"]["n_pos"] == 1 and rep["Cytoplasm"]["n"] == 2


def test_tsv_malformed_fails_fast(spark):
    path = fresh_path(spark, "bad-tsv")
    spark.createDataFrame([("Sequence\tMembrane\tCytoplasm\tLysosome/Vacuole",), ("MKV\t0\tnot-a-number\t1",)],
                          "value string").coalesce(1).write.text(path)
    with pytest.raises(Exception):
        R.read_sequences(spark, path, fmt="tsv", schema=SCHEMA).collect()


def test_partition_overwrite_keeps_other_runs(spark):
    path = fresh_path(spark, "runs")
    df = spark.createDataFrame([(r, r * 10) for r in range(3)], "run int, v int")
    K.write_table(df, path, partition=["run"])
    K.write_table(spark.createDataFrame([(1, 99)], "run int, v int"), path, partition=["run"])
    got = {r["run"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert got == {0: 0, 1: 99, 2: 20}


def test_run_log_long_form(spark):
    wide = spark.createDataFrame([(1, 0.5, 0.7), (2, 0.4, None)], "epoch int, loss double, acc double")
    log = {(r["epoch"], r["metric"]): r["value"] for r in K.run_log(wide).collect()}
    assert log == {(1, "loss"): 0.5, (1, "acc"): 0.7, (2, "loss"): 0.4}


def test_merge_annotation_sources(spark):
    a = spark.createDataFrame([("k1", 1, 0), ("k2", 0, None)], "key string, SP int, TM int")
    b = spark.createDataFrame([("k1", 0), ("k3", 1)], "key string, SP int")
    m = {r["key"]: r for r in C.merge_annotations({"source_a": a, "source_b": b}, "key", ["SP", "TM"]).collect()}
    assert m["k1"]["SP"] == 1 and m["k1"]["SP_conflict"] and m["k1"]["sources"] == ["source_a", "source_b"]
    assert m["k2"]["TM"] is None and m["k3"]["TM"] is None and m["k3"]["sources"] == ["source_b"]


def test_cluster_conf_sizes_shuffle_to_input():
    from seqlabel.session import cluster_conf

    big = cluster_conf(100 * 1024 ** 4, 8000)
    assert int(big["spark.sql.shuffle.partitions"]) == 409600
    small = cluster_conf(10 * 1024 ** 2, 64)
    assert int(small["spark.sql.shuffle.partitions"]) == 128          # never below two waves of cores
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true" and big["spark.ui.enabled"] == "false"


@pytest.mark.parametrize("parts", [1, 3])
def test_embeddings_stream_reads_a_folder_and_a_file(spark, tmp_path, parts):
    """Large tables are folders of parts, small ones single files."""
    from seqlabel.sources import views as V

    df = spark.createDataFrame([(i, [float(i)] * 4, i % 3) for i in range(30)], V.EMBEDDINGS_SCHEMA)
    df.repartition(parts).write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.range(5).write.parquet(str(tmp_path / "documents.parquet"))
    if parts == 1:      # the same table as one file
        (tmp_path / "one").mkdir()
        (part,) = (tmp_path / "embeddings.parquet").glob("part-*.parquet")
        (tmp_path / "one" / "embeddings.parquet").write_bytes(part.read_bytes())
    out = fresh_path(spark, "stream-out")
    q = V.embeddings_stream(spark, str(tmp_path / "one" if parts == 1 else tmp_path)).writeStream.format("parquet").option("path", out) \
        .option("checkpointLocation", fresh_path(spark, "stream-ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["vec_id"] for r in spark.read.parquet(out).collect()) == list(range(30))
