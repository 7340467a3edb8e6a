import json

import pytest

from flockline import __main__ as cli
from flockline import workload as wl
from flockline.schema import Query, Region
from flockline.sources.tracks import write_points

PLAN = wl.Plan({0: 2}, 5, (0, 600), (Region(0, 10, 0, 10), Region(5, 20, 5, 20)))


def test_sweeps():
    assert [p.interval for p in wl.sweep_interval(PLAN, [1, 2])] == [(0, 60), (0, 120)]
    assert [p.duration for p in wl.sweep_duration(PLAN, 15, 46, 15)] == [15, 30, 45]
    assert [p.labels for p in wl.sweep_objects(PLAN, 2, 5, 2)] == [{0: 2}, {0: 4}]
    assert [p.labels for p in wl.sweep_classes(PLAN, 2, 5, 1)] == [{2: 1}, {2: 1, 3: 1}, {2: 1, 3: 1, 4: 1}]
    assert [len(p.regions) for p in wl.sweep_region(PLAN, [[[0, 1, 0, 1]], [[0, 1, 0, 1], [2, 3, 2, 3]]])] == [1, 2]
    assert list(wl.grids((4, 9, 4), (4, 5, 1))) == [(4, 4), (8, 4)]
    assert PLAN.queries(2, 1) == [Query({0: 2}, 10, (0, 1200), Region(0, 10, 0, 10))]


def test_names():
    assert wl.methods("vs") == ["sliding_naive", "sliding_state"]
    assert wl.datasets("sh", ["harbour", "station", "default"]) == ["station", "harbour"]
    assert wl.datasets("all", ["harbour", "default"]) == ["harbour"]
    with pytest.raises(KeyError):
        wl.methods("z")
    with pytest.raises(KeyError):
        wl.datasets("z", ["harbour"])


def test_measure(spark):
    points = spark.createDataFrame([(o, 0, f, 5, 5) for o in (1, 2) for f in range(8)], "oid int, cls int, fid int, x int, y int")
    got = wl.measure(points, [PLAN], "index_max_obj", fps=1, regions=2)
    assert got[0]["patterns"] == 1 and got[0]["runs"] == 2


def test_command_line(spark, tmp_path, capsys):
    points = spark.createDataFrame([(o, 0, f, 100 * o, 100) for o in (1, 2, 9) for f in range(1, 400)], "oid int, cls int, fid int, x int, y int")
    write_points(points, f"{tmp_path}/t")
    assert cli.main(["stats", f"{tmp_path}/t", f"{tmp_path}/s", "--fps", "1"]) == 0
    assert cli.main(["queries", f"{tmp_path}/s", "-n", "2", "--interval", "300"]) == 0
    made = json.loads(capsys.readouterr().out)
    assert len(made) == 2 and made[0]["count"] >= made[1]["count"] > 0
    with pytest.raises(SystemExit):
        cli.main(["queries", f"{tmp_path}/s", "--interval", "250", "--strict-interval"])
    assert cli.resolve("harb", ["harbour", "old town"]) == "harbour"
    with pytest.raises(SystemExit):
        cli.resolve("x", ["harbour"])
