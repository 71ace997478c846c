"""Files, position logs, documents, XMP, grids and sinks on small hand-made inputs."""

import pytest
from pyspark.sql import functions as F

from fieldspark.sources import files, logs, photo_docs


def test_scan_and_skeleton(spark, tmp_path):
    d = tmp_path / "job" / "DJI_202401010800_003_north"
    d.mkdir(parents=True)
    for n in ("DJI_0001.JPG", "DJI_0002_V.JPG", "notes.txt", "a.tif"):
        (d / n).write_bytes(b"x")
    inv = files.scan_folder(spark, str(tmp_path / "job"), ["jpg", "tif"])
    rows = {r.path.rsplit("/", 1)[1]: r for r in inv.collect()}
    assert set(rows) == {"DJI_0001.JPG", "DJI_0002_V.JPG", "a.tif"}
    assert rows["a.tif"].kind == "raster" and rows["a.tif"].group == "DJI_202401010800_003_north"
    sk = {r.File: r for r in files.photo_skeleton(inv, str(tmp_path / "job")).collect()}
    assert set(sk) == {"DJI_0001.JPG", "DJI_0002_V.JPG"}
    assert sk["DJI_0001.JPG"].FlightNumber == 3 and sk["DJI_0001.JPG"].FlightName == "north"
    assert sk["DJI_0001.JPG"].FolderLevel1 == "DJI_202401010800_003_north"


def test_mrk(spark, tmp_path):
    d = tmp_path / "base" / "flight"
    d.mkdir(parents=True)
    (d / "DJI_202408051200_007_field_Timestamp.MRK").write_text(
        "1\t1.0\t[2]\t-3,N\t4,E\t5,V\t-15.5,Lat\t-54.25,Lon\t512.75,Ellh\n"
        "2\t1.0\t-15.6,lat\t-54.3,lon\t500,ellh\n3\t-15.6,Lat\t-54.3,Lon\n"
    )
    rows = sorted(files.read_mrk(spark, str(tmp_path / "base")).collect(), key=lambda r: r.foto)
    assert [(r.foto, r.lat, r.lon, r.alt) for r in rows] == [(1, -15.5, -54.25, 512.75), (2, -15.6, -54.3, 500.0)]
    r = rows[0]
    assert (r.flight_number, r.flight_name, r.date_name) == ("007", "field", "20240805")
    assert (r.folder_level1, r.folder_level2, r.folder_level3) == ("flight", "base", None)


def test_documents_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [("a.JPG", "/p/f1/a.JPG", "1.5", "odd"), ("b.JPG", "/p/f1/b.JPG", "2.5", None), ("c.JPG", "/p/f2/c.JPG", None, "x")],
        "File string, Path string, Lat string, Strange string",
    )
    out = str(tmp_path / "docs")
    photo_docs.write_photo_docs(df, out)
    back = {r.file: r for r in photo_docs.read_photo_docs(spark, out, lines=True).collect()}
    assert set(back) == {"a.JPG", "b.JPG", "c.JPG"}
    assert back["a.JPG"].Lat == "1.5" and back["a.JPG"].extras == {"Strange": "odd"} and back["a.JPG"].folder == "/p/f1"
    bad = tmp_path / "bad.json"
    bad.write_text('{"schema_version": "1.0", "groups": {}}')
    with pytest.raises(Exception, match="schema_version"):
        photo_docs.read_photo_docs(spark, str(bad)).collect()


def test_xmp(spark, tmp_path):
    body = (
        '<x:xmpmeta><rdf:RDF><rdf:Description xmlns:a="u" drone-dji:GpsLatitude="+1.5" drone-dji:RtkFlag="50"\n'
        'tiff:Model="M3E" drone-dji:DewarpData="2024-01-01;1,2,3,4,5,6,7,8,9" zz:Other="q"></rdf:Description></rdf:RDF></x:xmpmeta>'
    )
    (tmp_path / "x.JPG").write_bytes(b"\xff\xd8" + body.encode("latin1") + b"\x00tail")
    (tmp_path / "y.jpg").write_bytes(b"none")
    rows = {r.File: r for r in files.read_xmp(spark, str(tmp_path)).collect()}
    assert rows["x.JPG"].attributes == {"GpsLatitudeXmp": "+1.5", "RtkFlag": "50", "Model": "M3E"}
    assert rows["x.JPG"].dewarp.DewarpDate == "2024-01-01" and rows["x.JPG"].dewarp.DewarpP2 == 9.0
    assert rows["y.jpg"].attributes == {} and rows["y.jpg"].dewarp is None


def test_ascii_grid(spark, tmp_path):
    (tmp_path / "g.asc").write_text(
        "ncols 3\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 2\nNODATA_value -9999\n1 2 3\n4 -9999 6\n"
    )
    px, grids = files.read_ascii_grid(spark, str(tmp_path))
    assert {(r.row, r.col): r.value for r in px.collect()} == {
        (0, 0): 1.0, (0, 1): 2.0, (0, 2): 3.0, (1, 0): 4.0, (1, 1): -9999.0, (1, 2): 6.0,
    }
    g = grids.first()
    assert (g.raster_id, g.x0, g.y0, g.ncols, g.nodata) == ("g", 10.0, 24.0, 3, -9999.0)


def test_logs(spark, tmp_path):
    (tmp_path / "App_20240102_030405_pid77.log").write_text(
        '{"ts":"2024-01-02T03:04:05","level":"ERROR","tool":"t","class":"C","msg":"boom","pid":7,"data":{"k":1}}\n'
        '{"msg":"bare"}\nnot json\n{"ts":"2024-01-02T03:0\n\n'
    )
    rows = sorted(logs.read_logs(spark, str(tmp_path)).collect(), key=lambda r: r.msg)
    assert [r.msg for r in rows] == ["bare", "boom"]
    assert rows[0].level == "UNKNOWN" and rows[0].pid == 0 and rows[0].event_time is None
    assert rows[1].data == '{"k":1}' and rows[1].session_pid == 77
    assert rows[1].session_name == "2024-01-02 03:04:05 (PID 77)"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.25, float("nan"))], "field string, mean double, cv double")
    files.write_stats_csv(df, str(tmp_path / "s"), comma_decimal=True)
    text = "".join(p.read_text() for p in (tmp_path / "s").glob("part*.csv"))
    assert text.splitlines() == ["field;mean;cv", "a;1,25;"] or text.splitlines() == ["field;mean;cv", 'a;1,25;""']
    pts = files.read_points(spark.createDataFrame([("1", "2"), ("x", "2")], "x string, y string"), "x", "y")
    assert pts.count() == 1
    p = str(tmp_path / "layer.parquet")
    assert files.save_layer(pts, p) == p and files.save_layer(pts, p) == str(tmp_path / "layer_1.parquet")
    g = files.save_layer(pts, str(tmp_path / "l.geojson"))
    assert '"coordinates":[1.0,2.0]' in spark.read.text(g).first().value
    k = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    q = str(tmp_path / "prod")
    assert files.write_if_absent(k, q, ["id"]) == 2
    assert files.write_if_absent(k.unionByName(spark.createDataFrame([(3, "c")], "id int, v string")), q, ["id"]) == 1
    assert spark.read.parquet(q).filter(F.col("id") == 1).count() == 1
