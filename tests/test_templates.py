import pytest
from pyspark.sql import functions as F

from ledgerlake.functions import templates
from ledgerlake.operators import catalog_filters


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_components(spark):
    one = lambda t: value(spark, templates.component(F.lit(t)))
    assert one("a/b:c. ") == "a_b_c" and one("") == "" and one(" lead") == " lead"
    assert one("com0.txt") == "com0.txt_" and one("CON") == "CON_" and one("COM") == "COM" and one("a\x07b\n") == "ab"
    assert len(one("é" * 300).encode()) == 200 and one("x" + "é" * 300) == "x" + "é" * 99
    assert templates.crc16(b"123456789") == 0x29B1


def test_templates(spark):
    tokens = {"title": F.lit("A/B: x"), "titleId": F.lit("ABCD"), "region": F.lit("USA"), "ext": F.lit("rvz"), "basename": F.lit("game01")}
    one = lambda t, **more: value(spark, templates.template_column(t, tokens | more))
    none = F.lit(None).cast("string")
    assert one("{region}/{title} [{titleId}] {other}.{ext}") == "USA/A_B_ x [ABCD] {other}.rvz"
    assert one("{console}\\{serial}", serial=none) == "game01" and one("{title}{open", title=none) == "game01{open"
    assert one("a/./b//c") == "a/b/c" and one("a/../b") is None and one("{region}", region=F.lit("..")) is None and one("{console}") is None
    for bad in ("/a", "\\a", "C:a"):
        with pytest.raises(ValueError):
            templates.template_column(bad, tokens)


def test_columns(spark):
    df = spark.createDataFrame([(bytearray(b"abc"),), (None,)], "b binary")
    got = df.select(templates.adler32("b").alias("a"), templates.crc16_column("b").alias("c")).collect()
    assert [tuple(r) for r in got] == [(0x024D0127, templates.crc16(b"abc")), (None, None)]


def test_catalog_selections(spark, tmp_path):
    dats = spark.createDataFrame([("1", "Big Set", "p", ["x"]), ("2", "Other", "q", ["y"])], "id string, name string, platform_id string, tags array<string>")
    dats = dats.withColumns({"signature_group_id": F.lit("g"), "subset": F.lit(None).cast("string")})
    assert [r.id for r in catalog_filters.dat_files(dats, name="big", tag="x", group="g").collect()] == ["1"]
    assert catalog_filters.dat_files(dats, platform="z").count() == 0
    meta = spark.createDataFrame([([("Automatic", "1"), ("Failed", "2"), ("Manual", None)],)], "m array<struct<match_type:string,provider_id:string>>")
    assert [x.provider_id for x in meta.select(catalog_filters.external_ids(F.col("m"))).first()[0]] == ["1"]
    files = spark.createDataFrame([("iso", 0), ("bin", 5)], "ext string, size_bytes long")
    assert tuple(catalog_filters.warnings(files).first()) == (True, 1, 5)
    assert catalog_filters.fits(files, str(tmp_path))
    found = spark.createDataFrame([(("d", "1"), ("i", "2"))], "dat_file struct<name:string,current_version:string>, dat_import struct<name:string,version:string>")
    assert tuple(catalog_filters.display_fields(found).select("dat_file_name", "dat_version").first()) == ("d", "2")
