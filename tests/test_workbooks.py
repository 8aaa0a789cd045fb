"""Arrays and workbooks: round trips and odd files."""

import numpy as np

from triloom.sources import workbooks as W


def test_arrays_round_trip(spark, tmp_path):
    cells = [("t1", "omega", i, j, i + j / 10) for i in range(3) for j in range(4)] + [("t1", "p", i, None, i / 2) for i in range(3)] + [("t2", "omega", 0, 1, None)]
    df = spark.createDataFrame(cells, "traj string, name string, i bigint, j bigint, value double")
    W.write_files(W.npz_files(df, "traj"), str(tmp_path / "out"), "traj", ".npz")
    with np.load(tmp_path / "out" / "t1.npz") as a:
        assert a["omega"].shape == (3, 4)
        assert a["omega"][2, 3] == 2.3
        assert a["p"].tolist() == [0, 0.5, 1]
    np.savez(tmp_path / "out" / "t3.npz", names=np.array(["a", "b"]), flags=np.array([True, False]), none=np.zeros((0, 3)))
    (tmp_path / "out" / "broken.npz").write_bytes(b"no archive")
    got = {(r["path"].rsplit("/", 1)[1], r["name"], r["i"], r["j"]): r["text"] or r["value"] for r in W.read_npz(spark, str(tmp_path / "out")).collect()}
    for t, n, i, j, v in cells:
        if v is not None:
            assert got[(f"{t}.npz", n, i, j)] == v
    assert got[("t3.npz", "names", 1, None)] == "b"
    assert got[("t3.npz", "flags", 0, None)] == 1.0
    assert not any(k[0] == "broken.npz" for k in got)


def test_workbooks_round_trip(spark, tmp_path):
    rows = [("b1", f"z={z}/<{z}>", p, 0.5 * p, "x & y" if p else None) for z in (4, 8) for p in range(3)] + [("b2", "only", 0, None, "é")]
    df = spark.createDataFrame(rows, "book string, sheet string, p int, score double, note string")
    W.write_files(W.xlsx_files(df, "book", "sheet", ["p"]), str(tmp_path / "out"), "book", ".xlsx")
    (tmp_path / "out" / "broken.xlsx").write_bytes(b"")
    got = W.read_xlsx(spark, str(tmp_path / "out")).collect()
    cells = {(r["path"].rsplit("/", 1)[1], r["sheet"], r["row"], r["col"]): r["value"] for r in got}
    assert cells[("b1.xlsx", "z=4_<4>", 0, 1)] == "score"
    assert cells[("b1.xlsx", "z=8_<8>", 2, 1)] == "0.5"
    assert cells[("b1.xlsx", "z=8_<8>", 3, 2)] == "x & y"
    assert ("b1.xlsx", "z=8_<8>", 1, 2) not in cells
    assert cells[("b2.xlsx", "only", 1, 2)] == "é"
    assert {k[0] for k in cells} == {"b1.xlsx", "b2.xlsx"}


def test_names_of_sheets_and_columns():
    book = W.workbook({"a" * 40: (["x"], []), "a" * 41: (["y"], []), "A" * 50: (["z"], [])})
    assert len({s.lower() for s, *_ in W.sheet_cells(book)}) == 3
    wide = W.workbook({"w": ([str(i) for i in range(800)], [])})
    assert [int(v) for _, _, c, v in W.sheet_cells(wide) if int(v) == c] == list(range(800))
