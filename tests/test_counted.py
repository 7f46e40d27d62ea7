"""Blocks of a number of integrations: a stream gives what the table gives, but for what is open or late."""

import pytest
from fringeworks.streaming.counted import count_blocks

SCHEMA = "id int, time double, value double, weight double, block string"


def streamed(spark, parts, n, folder):
    """Files one after another, each a batch."""
    import os

    (folder / "in").mkdir()
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/p{k}")
        name = next(f for f in os.listdir(f"{folder}/p{k}") if f.endswith(".parquet"))
        os.rename(f"{folder}/p{k}/{name}", f"{folder}/in/{k}.parquet")
        os.utime(f"{folder}/in/{k}.parquet", (1000 + k, 1000 + k))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = count_blocks(stream, ["id"], n).writeStream.format("memory").queryName(f"counted{n}").outputMode("append")
    query = query.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination(150)
    assert query.exception() is None
    return {(r.id, r.block, r.first): tuple(r)[3:] for r in spark.table(f"counted{n}").collect()}


def test_stream_equals_table(spark, tmp_path):
    """Integrations split between batches, one batch with many blocks, a null key, rows that count nothing, and late rows."""
    first = [(1, float(t), t * 1.0, 1.0 + t % 2, "x") for t in range(4)] + [(None, 0.0, 1.0, 1.0, "x"), (1, None, 5.0, 1.0, "x"), (1, 1.5, float("nan"), 1.0, "x")]
    second = [(1, 3.0, 9.0, 1.0, "x"), (2, 0.0, 1.0, 0.0, "x")] + [(2, float(t), 2.0, 0.0, "x") for t in range(1, 9)] + [(None, 7.0, 2.0, 1.0, "x")]
    third = [(1, float(t), 1.0, 1.0, "x") for t in range(4, 9)] + [(None, 8.0, 3.0, 1.0, "x"), (None, 9.0, 3.0, 1.0, "x")]
    late = [(1, 1.0, 4.0, 2.0, "x"), (1, 1.0, 6.0, 2.0, "x")]
    new = [(2, 8.5, 1.0, 1.0, "x")]  # not late: it closes a block
    table = spark.createDataFrame(first + second + third + new, SCHEMA)
    want = {(r.id, r.block, r.first): tuple(r)[3:] for r in count_blocks(table, ["id"], 3).collect()}
    got = streamed(spark, [first, second, third, late + new], 3, tmp_path)
    assert got.pop((1, None, 1.0)) == (1.0, 1, 2, 4.0, 5.0)
    ends = {key: max(b for k, b, _ in want if k == key) for key in (1, 2, None)}
    assert got == {k: v for k, v in want.items() if k[1] < ends[k[0]]} and len(got) == 6
    assert want[(1, 1, 3.0)][:3] == (5.0, 3, 4) and want[(2, 0, 0.0)][4] is None and want[(None, 1, 9.0)][1] == 1


def test_blocks_of_tables(spark):
    with pytest.raises(ValueError, match="integration"):
        count_blocks(spark.createDataFrame([], SCHEMA), ["id"], 0)
    assert count_blocks(spark.createDataFrame([], SCHEMA), ["id"], 2).count() == 0
