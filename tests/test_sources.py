"""Readers, message logs and kernels."""

import gzip
import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gazeflow.operators import kernels, messages
from gazeflow.series import Axis
from gazeflow.sources import files


def test_delimited(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("t\tx\tname\n1\tNaN\ta\n2\t3.5\tb\n")
    rows = files.read_delimited(spark, str(tmp_path / "a.tsv"), "t double, x double, name string", sep="\t").orderBy("t").collect()
    assert [tuple(r) for r in rows] == [(1.0, None, "a"), (2.0, 3.5, "b")]


def test_gzipped_json_lines(spark, tmp_path):
    with gzip.open(tmp_path / "g.gz", "wt") as f:
        f.write('{"timestamp": 1.5, "type": "gaze", "data": {"gaze2d": [0.1, 0.2], "eyeleft": {"pupildiameter": 3.0}}}\n{"timestamp": 2.0, "type": "gaze", "data": {}}\n')
    df = files.flat_vectors(files.read_json_lines(spark, str(tmp_path / "g.gz"), files.GAZE_SCHEMA))
    a, b = df.orderBy("timestamp").collect()
    assert (a.gaze2d_0, a.gaze2d_1, a.eyeleft_pupildiameter, a.eyeright_pupildiameter) == (0.1, 0.2, 3.0, None) and b.gaze2d_0 is None


def test_key_values(spark, tmp_path):
    (tmp_path / "h.txt").write_text("Program\nname: clip\nrate, 500\nname: other\n")
    assert files.read_key_values(spark, str(tmp_path / "h.txt")).first().kv == {"name": "other", "rate": "500"}
    got = spark.createDataFrame([("subject 7 rate=500.5",)], "v string").select(*files.extract_headers(F.col("v"), {"rate": "rate=([0-9.]+)", "age": "age=([0-9]+)"}, ("rate", "age"))).first()
    assert got.rate == 500.5 and got.age is None


@pytest.mark.parametrize("code,kind", [(0, "Q"), (1, "d"), (2, "I"), (3, "f")])
def test_timestamps(spark, tmp_path, code, kind):
    (tmp_path / "t.bin").write_bytes(bytes([code]) + struct.pack(f"<3{kind}", 90000, 180000, 270000) + b"\x01")
    rows = files.read_timestamps(spark, str(tmp_path / "t.bin"), 90000.0).orderBy("idx").collect()
    assert [r.sec for r in rows] == [1.0, 2.0, 3.0]


def test_line_times(spark):
    lines = spark.createDataFrame([("f", i, str(i)) for i in range(4)], "path string, line_no long, x string")
    times = spark.createDataFrame([("f", i, i / 10) for i in range(3)], "path string, idx long, sec double")
    assert files.with_line_times(lines, times, ["path"]).count() == 3
    with pytest.raises(PySparkException):
        files.with_line_times(lines.where("line_no < 2"), times, ["path"]).collect()


def test_frames_and_files(spark, tmp_path):
    t = spark.createDataFrame([("v", 0, 0.0), ("v", 1, 0.04), ("v", 2, 0.09)], "path string, idx long, sec double")
    assert [round(r.drift, 6) for r in files.frame_drift(t, ["path"]).orderBy("idx").collect()] == [0.0, 0.0, 0.01]
    (tmp_path / "d").mkdir()
    for n in ("s1_a.csv", "d/s2_b.csv", "x.txt"):
        (tmp_path / n).write_text("x")
    idx = files.file_index(spark, str(tmp_path), "*.csv", {"subj": "^(s[0-9])"})
    assert {(r["name"], r.subj, r.dup) for r in idx.collect()} == {("s1_a.csv", "s1", False), ("s2_b.csv", "s2", False)}
    want = spark.createDataFrame([("s1_a.csv",), ("other_b.csv",), ("none_c.csv",)], "file string")
    assert {r.file: r.found is not None for r in files.resolve_files(want, idx, "file").collect()} == {"s1_a.csv": True, "other_b.csv": True, "none_c.csv": False}
    made = []
    make = lambda: made.append(1) or t
    for _ in range(2):
        assert files.read_through(spark, str(tmp_path / "cache"), make).count() == 3
    assert len(made) == 1
    files.write_artefacts({"frames": t}, str(tmp_path / "out"), kind="csv", by="path")
    assert spark.read.option("header", True).csv(str(tmp_path / "out/frames")).count() == 3


def log(spark, lines):
    return messages.tagged(spark.createDataFrame([("r", float(t), m) for t, m in lines], "series string, t double, message string"))


def test_messages(spark):
    m = log(spark, [(0, "RECCFG CR 1000 2 1 LR"), (0, "GAZE_COORDS 0 0 1919 1079"), (1, "SESSION S subj=a age=3"), (2, "SESSION S age=4"), (3, "VID S one WPX=10"), (4, "VID E one"), (5, "VID S two"), (6, "VID A two"), (7, "VID S three")])
    assert tuple(messages.recording_config(m).select("mode", "rate", "eyes").first()) == ("CR", 1000.0, "LR")
    assert messages.gaze_coords(m).first().right == 1919.0
    assert messages.tag_params(m, "SESSION", ["series"], first="S").first().params == {"SESSION_subj": "a", "SESSION_age": "4"}
    t = messages.trials(m, ["series"]).collect()
    assert [(r.start, r.end, r.video, r.params) for r in t] == [(3.0, 4.0, "one", {"WPX": "10"})]
    assert messages.trials(m, ["series"], keep_aborted=True).count() == 2
    with pytest.raises(PySparkException):
        messages.trials(log(spark, [(0, "VID S a"), (1, "VID E b")]), ["series"]).collect()
    with pytest.raises(PySparkException):
        messages.tag_params(log(spark, [(0, "X a=b=c")]), "X", ["series"]).collect()


def test_blocks_are_repaired(spark):
    m = log(spark, [(0, "BLK S free"), (10, "BLK S fix"), (20, "BLK E"), (30, "BLK S free")])
    ends = spark.createDataFrame([("r", 40.0)], "series string, last double")
    b = messages.blocks(m, ends, ["series"])
    assert [(r.start, round(r.end, 3), r.kind) for r in b.orderBy("start").collect()] == [(0.0, 9.98, "free"), (10.0, 20.0, "fix"), (30.0, 40.0, "free")]
    t = spark.createDataFrame([("r", 1.0, 2.0), ("r", 3.0, 4.0), ("r", 21.0, 22.0)], "series string, start double, end double")
    got = messages.trials_in_blocks(t, b, ["series"]).orderBy("start").collect()
    assert [(r.block, r.trial_in_block) for r in got] == [(0, 0), (0, 1), (None, None)]


def test_spline_passes_through_samples():
    rng = np.random.default_rng(0)
    t = np.sort(rng.random(30))
    v = rng.random(30)
    assert np.allclose(kernels.quadratic_spline(t, v, t), v)
    assert np.allclose(kernels.quadratic_spline(t, 3 * t * t - t, np.linspace(t[0], t[-1], 50)), [3 * x * x - x for x in np.linspace(t[0], t[-1], 50)])


def test_classifier_on_a_synthetic_trace(spark):
    rng = np.random.default_rng(0)
    x = np.zeros(3000)
    x[1000:] += np.interp(np.arange(2000), [0, 40], [0, 8])
    x[2000:] += np.arange(1000) * 0.02
    x += rng.normal(0, 0.002, 3000)
    v = np.abs(np.gradient(x)) * 1000
    v = np.convolve(v, np.ones(9) / 9, "same")
    labels = [e for e in kernels.classify(v, x, np.zeros(3000), kernels.ClassifierParams(rate=1000.0))]
    sacc = [e for e in labels if e[0] == "SACC"]
    assert len(sacc) == 1 and abs(sacc[0][1] - 1000) < 30
    assert any(e[0] == "FIXA" and e[2] <= 1020 for e in labels) and any(e[0] == "PURS" and e[1] > 1500 for e in labels)


def test_attitude_finds_down(spark):
    df = spark.createDataFrame([("a", i / 100, i, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0) for i in range(3000)], "series string, t double, pos long, gyrx double, gyry double, gyrz double, accx double, accy double, accz double")
    last = kernels.attitude(df, Axis(), gain=0.5).orderBy(F.desc("t")).first()
    assert abs(last.roll - 90) < 3


def _workbook(path):
    """A workbook with one sheet: a header in its second row, a filled cell, shared and inline texts."""
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rel}><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><t>name</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><fills><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="solid"/></fill></fills><cellXfs><xf fillId="0"/><xf fillId="1"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1"><v>9</v></c></row><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row><row r="3"><c r="A3" s="1"><v>1.5</v></c><c r="C3" t="s"><v>2</v></c></row><row r="4"><c r="C4" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')


def test_workbooks_and_broken_files(spark, tmp_path):
    _workbook(tmp_path / "a.xlsx")
    (tmp_path / "b.xlsx").write_bytes(b"broken")
    df = files.decode_files(spark, str(tmp_path / "*.xlsx"), lambda raw: files.sheet_rows(raw, "S", skip=1), "id string, name string, id_filled boolean")
    rows = {(r.path[-6:], r.status[:10], r.id, r["name"], r.id_filled) for r in df.collect()}
    assert rows == {("b.xlsx", "BadZipFile", None, None, None), ("a.xlsx", "ok", "1.5", "ab", True), ("a.xlsx", "ok", None, "x", False)}


def test_recording_metadata(spark, tmp_path):
    import json

    for name, found in (("one", ["recording.g3", "scene.mp4"]), ("two", ["tobii3_scene.mp4", "gazedata.gz"]), ("three", ["gazedata.gz"])):
        (tmp_path / name).mkdir()
        for f in found:
            (tmp_path / name / f).write_text("x")
    meta = {"scenecamera": {"file": "scene.mp4", "camera-calibration": {"position": [1.0, 2.0, 3.0], "focal-length": [900.0, 901.0], "resolution": [1920, 1080]}}, "gaze": {"file": "g.gz", "samples": 10, "valid-samples": 9}, "imu": {"file": "i.gz"}}
    (tmp_path / "one" / "recording.g3").write_text(json.dumps(meta))
    got = {r.folder.rpartition("/")[2]: r for r in files.recording_metadata(spark, str(tmp_path)).collect()}
    one, two, three = got["one"], got["two"], got["three"]
    assert (one.scene_file, one.gaze_file, one.expected_samples, one.expected_valid, one.camera["focal-length"]) == ("scene.mp4", "g.gz", 10, 9, [900.0, 901.0])
    assert (two.has_metadata, two.scene_file, two.gaze_file, two.imu_file, two.expected_samples, two.camera) == (False, "tobii3_scene.mp4", "gazedata.gz", "imudata.gz", -1, None)
    assert three.scene_file is None


def test_session_info_fails_where_names_meet(spark):
    rows = [("a", 0.0, "SCREEN W=1"), ("a", 1.0, "SESSION S X=2"), ("a", 2.0, "EYE_USED 1 RIGHT"), ("a", 3.0, "RECCFG CR 500 2 1 LR")]
    m = messages.tagged(spark.createDataFrame(rows, "series string, t double, message string"))
    assert messages.session_info(m, ["series"]).first().info == {"SCREEN_W": "1", "SESSION_X": "2", "eye_index": "1", "eye_mode": "RIGHT", "mode": "CR", "rate": "500.0", "file_filter": "2", "link_filter": "1", "eyes": "LR"}
