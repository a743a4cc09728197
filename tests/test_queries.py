"""Each query of the raster operators against its SQL in DuckDB, and the data sources over files."""

import sys

import duckdb
import pytest

from rastrum import queries as Q
from rastrum.sources import raster

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "part", "customer", "embeddings", "orders"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(x):
    return sorted(tuple("NULL" if v is None else repr(float(v)) if isinstance(v, (int, float)) else str(v) for v in r) for r in x)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query(spark, con, name):
    df = Q.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = con.sql(Q.ORACLES[name])
    assert sorted(want.columns) == cols
    assert rows(df.select(*cols).collect()) == rows(want.project(",".join(f'"{c}"' for c in cols)).fetchall())


def test_sources(spark, tmp_path):
    raster.register(spark)
    pixels = Q.bands(spark, DATA)
    path = str(tmp_path / "blobs")
    raster.encode_pixels(pixels, "f64").write.format("raster").mode("append").save(path)
    (tmp_path / "blobs" / "bad").write_bytes(b"Lerc2 " + b"\0" * 80)
    info = spark.read.format("raster_info").load(path)
    assert info.where("error IS NULL").count() == 5 and info.where("error IS NOT NULL").count() == 1
    with pytest.raises(Exception, match="version"):
        spark.read.format("raster").load(path).collect()
    got = spark.read.format("raster").option("mode", "permissive").load(path)
    a, b = (sorted(map(tuple, x.select("band", "row", "col", "value").collect()), key=str) for x in (got, pixels))
    n = pixels.where("value IS NOT NULL").count()
    assert [x for x in a if x[-1] is not None] == [x for x in b if x[-1] is not None] and len([x for x in a if x[-1] is not None]) == n
    top = got.where("value > 400").count()
    assert top == pixels.where("value > 400").count()
    with pytest.raises(Exception, match="version"):
        spark.read.format("raster_info").option("mode", "failfast").load(path).collect()


def test_writer(spark, tmp_path):
    raster.register(spark)
    path = tmp_path / "out"
    path.mkdir()
    blob = bytes(raster.encode_pixels(Q.sizes(spark, DATA), "u8").first()["blob"])

    def write(rows, mode="append"):
        spark.createDataFrame(rows, "raster_id string, blob binary").write.format("raster").mode(mode).save(str(path))

    names = ["a/b", "a_b", ".hidden", "plain.blob", "é %"]
    write([(n, blob) for n in names])
    info = spark.read.format("raster_info").load(str(path))
    assert sorted(r["raster_id"] for r in info.collect()) == sorted(names)
    for bad in ([("x", blob), ("x", blob)], [("y", blob), ("z", None)], [("a/b", blob)]):  # repeated, null, and there already
        with pytest.raises(Exception):
            write(bad)
        assert len(list(path.iterdir())) == len(names)
    write([("new", blob)], "overwrite")
    assert [f.name for f in path.iterdir()] == ["new"]
    assert spark.read.format("raster").option("dtype", "u8").load(str(path)).count() == Q.sizes(spark, DATA).count()
    with pytest.raises(Exception, match="not f32"):
        spark.read.format("raster").option("dtype", "f32").load(str(path)).collect()


def values_of(df):
    return sorted((tuple(r) for r in df.select("raster_id", "band", "row", "col", "depth", "value").collect()), key=str)


def tall(spark, raster_id="t", rows=1030, cols=3):
    """Two bands, the second shorter, values on a grid of halves; no rows of the second 512 rows but the last of them."""
    from pyspark.sql import functions as F

    from rastrum.operators import grid

    place = spark.range(rows * cols).withColumn("band", F.explode(F.array(F.lit(0), F.lit(1)))).where(f"band = 0 OR id < {700 * cols}")
    pixels = grid.from_table(place, F.col("id"), cols, F.when(F.col("id") % 5 != 0, (F.col("id") + F.col("band")) / 2), raster_id, band=F.col("band"))
    return pixels.where("row < 512 OR row >= 1024 OR (band = 1 AND row = 699)")


def test_large_rasters_are_cut(spark, tmp_path):
    """No task holds a whole raster; places, ranges and tolerances are those of the whole."""
    pixels = tall(spark, "a@1_2")
    blobs = raster.encode_pixels(pixels, "f64", 0.001).cache()
    parts = [(r["first_row"], r["first_col"]) for r in blobs.collect()]
    assert sorted(parts) == [(0, 0), (512, 0), (1024, 0)]
    have = {r[:5]: r[5] for r in values_of(pixels)}
    want = [("a@1_2", b, r, c, 0, have.get(("a@1_2", b, r, c, 0))) for b, n in ((0, 1030), (1, 700)) for r in range(n) for c in range(3)]
    assert values_of(raster.decode_blobs(blobs)) == sorted(want, key=str)
    infos = {r["band"]: r for r in raster.raster_info(blobs, strict=True).collect()}
    assert len(infos) == 2 and all(i["tolerance"] == 0.25 and i["width"] == 3 and i["bands"] == 2 for i in infos.values())
    for b, i in infos.items():
        v = [x for k, x in have.items() if k[1] == b and x is not None]
        assert (i["valid_pixels"], i["min_value"], i["max_value"], i["height"]) == (len(v), min(v), max(v), (1030, 700)[b])
    raster.register(spark)
    blobs.write.format("raster").mode("append").save(str(tmp_path / "out"))
    assert len(list((tmp_path / "out").iterdir())) == 3
    assert values_of(spark.read.format("raster").load(str(tmp_path / "out"))) == sorted(want, key=str)


def test_streams_of_cut_rasters(spark, tmp_path):
    from rastrum.streaming.ingest import stream_pixels

    raster.register(spark)
    pixels = tall(spark, "s @3_4")
    blobs = raster.encode_pixels(pixels, "f64").cache()
    blobs.write.format("raster").mode("append").save(str(tmp_path / "out"))
    q = stream_pixels(spark, str(tmp_path / "out")).writeStream.format("memory").queryName("cut").start()
    q.processAllAvailable()
    q.stop()
    assert values_of(spark.table("cut")) == values_of(raster.decode_blobs(blobs))


@pytest.mark.parametrize("kind", Q.KINDS)
def test_laid_out_of_more_rows_than_a_blob_may_have(spark, kind):
    """The older format ends at 20000 rows."""
    from pyspark.sql import functions as F

    from rastrum.operators import grid

    pixels = grid.from_table(spark.range(40100), F.col("id"), 2, F.when(F.col("id") % 3 != 1, F.col("id") % 50), "big")
    blobs = Q.laid_out(pixels, kind).cache()
    assert values_of(raster.decode_blobs(blobs)) == values_of(pixels.withColumn("raster_id", F.lit(kind)))
    (i,) = raster.raster_info(blobs, strict=True).collect()
    assert (i["height"], i["width"], i["max_value"]) == (20050, 2, 49)


def test_damaged_and_null_blobs(spark):
    blobs = spark.createDataFrame([("null", None), ("junk", b"junk")], "raster_id string, blob binary")
    for r in ("null", "junk"):
        with pytest.raises(Exception, match=f"{r}: no magic"):
            raster.decode_blobs(blobs.where(f"raster_id = '{r}'")).collect()
    assert raster.decode_blobs(blobs, strict=False).count() == 0
    assert raster.raster_info(blobs).where("error IS NOT NULL").count() == 2


def test_dense(spark):
    pixels = Q.sizes(spark, DATA)
    assert raster.encode_pixels(pixels, "u8", dense=True).count() == 1
    with pytest.raises(Exception, match="1 places have no row"):
        raster.encode_pixels(pixels.where("NOT (row = 1 AND col = 1)"), "u8", dense=True).collect()


def test_sentinel_of_large_floats(spark):
    """Steps that the type cannot tell from the data are passed over."""
    from pyspark.sql import functions as F

    from rastrum.codec import blob
    from rastrum.plans.planner import nodata_sentinel

    for dtype, code in (("f32", 6), ("f64", 7)):
        for low in (5.0, -3e7, 2.0**60 if dtype == "f64" else 1e6):
            got = spark.range(1).select(nodata_sentinel(F.lit(low), 0.0, dtype, 1e30).alias("x")).first()["x"]
            assert got < low and got == blob.no_data_sentinel(low, 0.0, code, 1e30)


def test_stream(spark, tmp_path):
    from rastrum.streaming.ingest import stream_info

    blob = raster.encode_pixels(Q.sizes(spark, DATA), "u8").first()["blob"]
    (tmp_path / "one.blob").write_bytes(bytes(blob))
    q = stream_info(spark, str(tmp_path)).writeStream.format("memory").queryName("infos").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["raster_id"], r["dtype"]) for r in spark.sql("SELECT * FROM infos").collect()] == [("one.blob", "u8")]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "rastrum" in sys.modules
