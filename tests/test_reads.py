import io

import pytest

from loomtable.errors import DataFormatError
from loomtable.sources import envelope
from loomtable.sources.batch import ColumnarBatch, ColumnarSchema
from loomtable.sources.columnar import BatchReader, Preflight, by_rows, choose_reader, compare, select
from loomtable.sources.pgcopy import PgCopySource, encode_copy

MIXED = ColumnarSchema.of(("id", "I64"), ("b", "Bool"), ("i32", "I32"), ("f64", "F64"), ("u", "Uuid"), ("ts", "TimestampTzMicros"), ("t", "Utf8"), ("by", "Bytes"))
MIXED_SQL = """SELECT * FROM VALUES
 (1L, true, 10, 1.25D, X'00000000000000000000000000000005', timestamp'2020-01-01 00:00:00', 'hello', X'0102'),
 (2L, NULL, NULL, NULL, NULL, NULL, NULL, NULL),
 (3L, false, -7, 3.5D, X'ff000000000000000000000000000005', timestamp'2020-01-01 00:00:00.000001', 'x', X'')
 AS v(id, b, i32, f64, u, ts, t, by) ORDER BY id"""


@pytest.mark.parametrize("mode", ["arrow", "row", "auto"])
def test_mixed_types(spark, mode):
    (b,) = BatchReader(spark, MIXED_SQL, MIXED, mode).batches(16)
    assert b.row_count == 3 and b.row_capacity == 16
    assert b.fixed(0).tolist() == [1, 2, 3] and b.validity(1) == bytes([0b101])
    assert b.fixed(5).tolist() == [1577836800000000, 0, 1577836800000001]
    assert b.variable(6)[0].tolist() == [0, 5, 5, 6] and b.variable(7)[1] == b"\1\2"
    assert b.arrow().column(7).to_pylist() == [b"\1\2", None, b""]
    assert envelope.decode(envelope.encode(b)).arrow().equals(b.arrow())


def test_modes_agree_and_batches_are_full(spark):
    sql = "SELECT id, CASE WHEN id % 10 = 0 THEN NULL ELSE id * 0.001D END AS v, CASE WHEN id % 10 = 0 THEN NULL ELSE 'hello' END AS t FROM range(3500) ORDER BY id"
    schema = ColumnarSchema.of(("id", "I64"), ("v", "F64"), ("t", "Utf8"))
    a, b = (list(BatchReader(spark, sql, schema, m).batches(1000)) for m in ("arrow", "row"))
    assert [x.row_count for x in a] == [1000, 1000, 1000, 500] == [x.row_count for x in b]
    assert all(x.arrow().equals(y.arrow()) for x, y in zip(a, b, strict=True))
    r, out = BatchReader(spark, sql, schema), ColumnarBatch(schema, 4000)
    assert [r.next_batch_into(out) for _ in range(3)] == [3500, 0, 0] and out.row_count == 0


def test_choose_reader():
    assert choose_reader("auto", 8, 1_000_000) == "row"
    assert choose_reader("auto", 8) == "arrow" and choose_reader("auto", 65, 10**9) == "arrow" and choose_reader("auto", 128, 10**9) == "arrow"


def test_preflight(spark):
    schema = ColumnarSchema.of(("name_", "Utf8"), ("pwt", "F64"))
    spark.sql("SELECT 'a' AS name_, 1.5D AS pwt WHERE false").createOrReplaceTempView("pre")
    for sql, what in (("SELECT name_ FROM pre", "column count mismatch"), ("SELECT pwt, name_ FROM pre", "column name mismatch"), ("SELECT name_, string(pwt) AS pwt FROM pre", "type mismatch")):
        with pytest.raises(DataFormatError, match=what):
            select(spark, sql, schema)
    assert select(spark, "SELECT name_, pwt FROM pre", schema).count() == 0
    with pytest.raises(DataFormatError, match="type mismatch"):
        select(spark, "SELECT pwt, name_ FROM pre", schema, Preflight(names=False))


def test_pgcopy_source(spark, tmp_path):
    (b,) = BatchReader(spark, MIXED_SQL, MIXED).batches(16)
    for k in range(2):
        out = io.BytesIO()
        encode_copy(iter([b]), out)
        (tmp_path / f"part-{k}.bin").write_bytes(out.getvalue())
    spark.dataSource.register(PgCopySource)
    columns = ",".join(f"{f.name}:{f.type}" for f in MIXED.fields)
    df = spark.read.format("pgcopy").option("columns", columns).load(str(tmp_path))
    assert sorted(map(str, df.collect())) == sorted(map(str, spark.sql(MIXED_SQL).collect() * 2))


def test_jdbc_paging(spark):
    """Ranges of a key in another database are read by as many partitions."""
    url = "jdbc:derby:memory:pages;create=true"
    spark.range(1, 101).selectExpr("id AS K", "id * 2 AS V").write.format("jdbc").option("url", url).option("dbtable", "PAGES").mode("overwrite").save()
    df = spark.read.format("jdbc").options(url=url, dbtable="PAGES", partitionColumn="K", lowerBound=1, upperBound=100, numPartitions=4).load()
    assert df.rdd.getNumPartitions() == 4 and df.selectExpr("sum(V)").first()[0] == 10100
    got = select(spark, "SELECT K, V FROM PAGES WHERE K > 90", ColumnarSchema.of(("K", "I64"), ("V", "I64")), source={"url": url})
    assert got.count() == 10


def test_row_transfer_and_comparison(spark):
    a = select(spark, MIXED_SQL, MIXED)
    plain = a.select([c for c in a.columns if c != "u"])
    schema = ColumnarSchema([f for f in MIXED.fields if f.name != "u"])
    assert sorted(map(str, by_rows(a, MIXED).collect())) == sorted(map(str, a.collect()))
    x = spark.sql("SELECT * FROM VALUES (1L, 1.5D), (2L, NULL), (2L, NULL), (NULL, 3D) AS v(k, v)")
    got = {(r["k"], r["v"]): (r["n_source"], r["n_row"], r["n_arrow"]) for r in compare(x, row=x.where("v = 1.5"), arrow=x.where("k IS NOT NULL")).collect()}
    assert got == {(1, 1.5): (1, 1, 1), (2, None): (2, 0, 2), (None, 3.0): (1, 0, 0)}
    assert compare(plain, row=by_rows(plain, schema)).where("n_row <> n_source").count() == 0


@pytest.mark.parametrize("side", ["row", "arrow"])
@pytest.mark.parametrize("key", [3, 4])
def test_parity_shows_a_lost_row(spark, tmp_path, monkeypatch, side, key):
    """A row that one transfer drops is seen."""
    from loomtable import queries
    from loomtable.sources import columnar

    spark.sql("SELECT id AS l_orderkey, 1 AS l_linenumber, id * 0.5D AS l_quantity, 'R' AS l_returnflag FROM range(9)").write.parquet(f"{tmp_path}/lineitem.parquet")
    run = lambda: {r["l_orderkey"]: (r["n_source"], r["n_row"], r["n_arrow"]) for r in queries.row_vs_arrow_parity(spark, str(tmp_path)).collect()}
    assert run() == dict.fromkeys(range(9), (1, 1, 1))
    module, name = (columnar, "by_rows") if side == "row" else (envelope, "decode_frame")
    f = getattr(module, name)
    monkeypatch.setattr(module, name, lambda d, s: f(d, s).where(f"l_orderkey <> {key}"))
    assert run() == dict.fromkeys(range(9), (1, 1, 1)) | {key: (1, 0, 1) if side == "row" else (1, 1, 0)}


def test_windows_of_partitions(spark, monkeypatch):
    """Windows of one partition give the same batches, whatever the capacity."""
    from loomtable.sources import columnar

    schema = ColumnarSchema.of(("id", "I64"), ("t", "Utf8"))
    sql = "SELECT id, repeat('x', CAST(id % 7 AS INT)) AS t FROM range(0, 5000, 1, 8) ORDER BY id"
    for window in (1, columnar.WINDOW_BYTES):
        monkeypatch.setattr(columnar, "WINDOW_BYTES", window)
        got = list(BatchReader(spark, sql, schema).batches(700))
        assert [b.row_count for b in got] == [700] * 7 + [100]
        assert [x for b in got for x in b.fixed(0).tolist()] == list(range(5000))
        assert got[3].variable(1)[1] == b"".join(b"x" * (k % 7) for k in range(2100, 2800))
    assert not list(BatchReader(spark, "SELECT id, 'x' AS t FROM range(0)", schema).batches(5))
