"""Reading corpora."""

import pyarrow as pa
import pyarrow.parquet as pq

from pairsift.sources import corpus


def write_files(folder, texts, cuts, group):
    folder.mkdir()
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(texts)], strict=True)):
        pq.write_table(pa.table({"text": pa.array(texts[a:b], pa.string())}), folder / f"part-{k:03}.parquet", row_group_size=group)
    return str(folder)


def test_corpora_without_ids_keep_the_order_of_their_files(spark, tmp_path):
    texts = [f"line {i}" + " x" * (i % 50) for i in range(5000)]
    texts[7], texts[8] = None, ""
    src = write_files(tmp_path / "src", texts, [1, 900, 900, 4000], 100)
    tgt = write_files(tmp_path / "tgt", [f"T {t}" for t in texts], [2500], 333)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # several splits in each file
    try:
        read = corpus.with_file_position(spark, src)
        assert read.rdd.getNumPartitions() > 8 and read.columns == ["text", "sent_id"]
        assert {r["sent_id"]: r["text"] for r in read.collect()} == dict(enumerate(texts))
        pairs = corpus.load_monolingual_pair(spark, src, tgt, None).collect()
        assert {r["sent_id"]: (r["src"], r["tgt"]) for r in pairs} == {i: (t, f"T {t}") for i, t in enumerate(texts)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_file_positions_don_t_move_rows(spark, tmp_path, capsys):
    src = write_files(tmp_path / "src", [f"line {i}" for i in range(300)], [100], 50)
    corpus.with_file_position(spark, src).explain()
    plan = capsys.readouterr().out
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
