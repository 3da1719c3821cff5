"""Plans and orders from end to end, on small catalogs."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from orbweave import cli
from orbweave.functions import geo
from orbweave.functions import props as P
from orbweave.functions import scoring as S
from orbweave.operators import scenes as SC
from orbweave.plans import orders, planner

CATALOG = "item_id string, collection_id string, acquired timestamp, geometry string, props map<string,string>"


def square(x0, y0, x1, y1):
    return {"type": "Polygon", "coordinates": [[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]}


def catalog(spark, rows):
    return spark.createDataFrame([(i, "PSScene", datetime(2024, 1, d), json.dumps(square(-0.01, -0.01, 0.02, 0.02)), p) for i, d, p in rows], CATALOG)


@pytest.fixture
def aoi(tmp_path):
    path = tmp_path / "aoi.geojson"
    path.write_text(json.dumps(square(0, 0, 0.01, 0.01)))
    return str(path)


def test_plan_selects_until_deep_enough(spark, aoi):
    rows = [(f"s{k}", 1 + k, {"cloud_cover": "0.05", "sun_elevation": "50", "pl:instrument": "PSB.SD"}) for k in range(6)]
    rows.append(("dark", 9, {"cloud_cover": "0.05", "sun_elevation": "10"}))
    rows.append(("cloudy", 9, {"clear_percent": "100", "cloud_cover": "0.95", "sun_elevation": "50"}))
    rows.append(("unknown", 9, {"sun_elevation": "50"}))
    plan = planner.plan_monthly_composites(aoi, "2024-01-01", "2024-02-10", tile_size_m=500, catalog=catalog(spark, rows))
    assert list(plan) == ["2024-01", "2024-02"]
    month = plan["2024-01"]
    assert month["tile_count"] == 6
    assert (month["candidate_count"], month["filtered_count"], month["selected_count"]) == (9, 6, 4)
    assert [i["id"] for i in month["items"]] == ["s0", "s1", "s2", "s3"]
    assert month["aoi_coverage"] == 1.0 and month["clear_depth_fraction"] == 1.0
    assert len(month["items"][0]["properties"]) == 12
    assert plan["2024-02"]["selected_count"] == 0 and plan["2024-02"]["filters"]["month_end"] == "2024-02-10"
    assert "2024-01" in planner.summary(plan)


def test_instrument_filter_falls_back_on_constellation(spark, aoi):
    base = {"cloud_cover": "0", "sun_elevation": "50"}
    rows = [("a", 1, base | {"pl:instrument": "PSB.SD", "constellation": "superdove"}), ("b", 2, base | {"constellation": "SuperDove "}), ("c", 3, base | {"constellation": "dove"}), ("d", 4, base | {"instruments": '["PS2", "psb.sd"]'})]
    plan = planner.plan_monthly_composites(aoi, "2024-01-01", "2024-01-31", instrument_types=["PSB.SD"], min_clear_obs=9, catalog=catalog(spark, rows))
    assert sorted(i["id"] for i in plan["2024-01"]["items"]) == ["a", "b", "d"]


@pytest.mark.parametrize("bad", [{"tile_size_m": 0}, {"month_grouping": "rolling"}])
def test_arguments_are_checked(spark, aoi, bad):
    with pytest.raises(ValueError):
        planner.plan_monthly_composites(aoi, "2024-01-01", "2024-01-31", catalog=catalog(spark, []), **bad)
    with pytest.raises(ValueError):
        planner.plan_monthly_composites(aoi, "2024-02-01", "2024-01-31", catalog=catalog(spark, []))


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def props(**named):
    return F.create_map(*[F.lit(x) for kv in named.items() for x in kv])


@pytest.mark.parametrize(("given", "clear"), [({"clear_percent": "1"}, 0.01), ({"clear_percent": "0.5"}, 0.5), ({"clear_fraction": "1"}, 1.0), ({"clear_percent": "n/a", "pl:clear_percent": "90", "cloud_cover": "0.2"}, 0.8), ({"cloud_cover": "30"}, 0.7), ({"clear_percent": "", "pl_clear_percent": "80"}, 0.8), ({"x": "1"}, None)])
def test_clear_fraction(spark, given, clear):
    found = value(spark, P.clear_fraction(props(**given)))
    assert found is None if clear is None else found == pytest.approx(clear)


@pytest.mark.parametrize(("text", "truth"), [("yes", True), (" N ", False), ("2", True), ("0", False), ("maybe", None)])
def test_boolean(spark, text, truth):
    assert value(spark, P.boolean(F.lit(text))) is truth


def test_similarity(spark):
    at = lambda a, e: value(spark, S.similarity(F.lit(a), F.lit(e), F.lit(100.0), F.lit(50.0), 20.0, 10.0))
    assert at(100.0, 50.0) == 1.0
    assert at(280.0, 10.0) < 1e-3
    assert value(spark, S.similarity(F.lit(None).cast("double"), F.lit(50.0), F.lit(100.0), F.lit(50.0), 20.0, 10.0)) == 1.0


def test_quality_filters(spark):
    good = {"ground_control": "true", "quality_category": " Standard", "view_angle": "2.0"}
    ask = dict(require_ground_control=True, quality_category="standard", max_view_angle=10)
    assert value(spark, SC.quality_ok(props(**good), **ask)) is True
    for bad in ({"ground_control": "false"}, {"quality_category": "test"}, {"view_angle": "35"}):
        assert value(spark, SC.quality_ok(props(**(good | bad)), **ask)) is False
    assert value(spark, SC.quality_ok(props(x="1"), max_view_angle=10)) is False
    assert value(spark, SC.quality_ok(props(view_angle="nan"), max_view_angle=10)) is True


class Refusing:
    """Refuses the first request for one scene."""

    def __init__(self):
        self.requests = []

    def create_order(self, request):
        self.requests.append(request)
        if len(self.requests) == 1:
            raise RuntimeError('400: {"field":{"Details":[{"message":"no access to assets: PSScene/b/[x]"}]}}')
        return {"id": f"o{len(self.requests)}"}


def test_refused_scene_is_replaced(spark, aoi):
    rows = [(i, 5, {"clear_percent": c, "pl:instrument": "PSB.SD", "sun_elevation": "50"}) for i, c in (("a", "99"), ("b", "98"), ("worse", "80"), ("better", "95"))]
    plan = {"2024-01": {"items": [{"id": "a"}, {"id": "b"}, {"id": "a"}], "filters": {"item_type": "PSScene", "instrument_types": ["PSB.SD"], "min_clear_fraction": 0.5}}, "2024-02": {"items": []}}
    client = Refusing()
    done = orders.submit_orders_for_plan(plan, aoi, 8, "sentinel2", "p", client=client, catalog=catalog(spark, rows))
    assert done["2024-01"] == {"order_id": "o2", "order_ids": ["o2"], "item_ids": ["a", "better"]}
    assert done["2024-02"] == {"order_id": None, "item_ids": []}
    first = client.requests[0]
    assert first["products"][0] == {"item_ids": ["a", "b"], "item_type": "PSScene", "product_bundle": "analytic_8b_sr_udm2"}
    assert first["tools"][1] == {"harmonize": {"target_sensor": "Sentinel-2"}}
    assert first["delivery"] == {"archive_type": "zip", "single_archive": True, "archive_filename": "p_2024-01.zip"}
    assert "o2" in orders.summary(done) and orders.summary({}) == "No orders submitted."


def test_orders_are_cut_at_500(spark, aoi, tmp_path):
    plan = {"2024-01": {"items": [{"id": f"i{k}"} for k in range(1201)]}}
    box = orders.Outbox(str(tmp_path / "out.jsonl"))
    done = orders.submit_orders_for_plan(plan, aoi, client=box, order_prefix="p")["2024-01"]
    said = [json.loads(x) for x in (tmp_path / "out.jsonl").read_text().splitlines()]
    assert [s["name"] for s in said] == ["p_2024-01", "p_2024-01_2", "p_2024-01_3"]
    assert [len(s["products"][0]["item_ids"]) for s in said] == [500, 500, 201]
    assert len(done["item_ids"]) == 1201


def test_other_errors_end_the_month(spark, aoi):
    class Broken:
        def create_order(self, request):
            raise RuntimeError("down")

    done = orders.submit_orders_for_plan({"2024-01": {"items": [{"id": "a"}]}}, aoi, client=Broken())
    assert done == {"2024-01": {"order_id": None, "order_ids": [], "item_ids": ["a"]}}


def test_requests_take_no_job_each(aoi, monkeypatch):
    def none():
        raise AssertionError("a Spark job for one order")

    monkeypatch.setattr(orders, "_spark", none)
    box = Refusing()
    box.requests.append({})  # nothing is refused
    done = orders.submit_orders_for_plan({"2024-01": {"items": [{"id": f"i{k}"} for k in range(1001)]}}, aoi, client=box)["2024-01"]
    assert len(done["order_ids"]) == 3 and done["item_ids"] == [f"i{k}" for k in range(1001)]


class Strict:
    """Refuses scenes of each order but the second once, has a month down at its second order, and counts."""

    def __init__(self):
        self.n, self.refused = 0, set()

    def create_order(self, request):
        name, ids = request["name"], request["products"][0]["item_ids"]
        if name == "plan_2024-03_2":
            raise RuntimeError("down")
        if name not in self.refused and not name.endswith("_2"):
            self.refused.add(name)
            raise RuntimeError("400: " + json.dumps({"field": {"Details": [{"message": f"no access to assets: PSScene/{x}/[x]"} for x in (ids[0], ids[-1], "2024-02-600")]}}))
        self.n += 1
        return {"id": f"o{self.n}"}


def test_a_plan_as_a_table_is_ordered_as_a_document_is(spark, aoi):
    plan = {m: {"items": [{"id": f"{m}-{k}"} for k in range(n)]} for m, n in (("2024-01", 3), ("2024-02", 1100), ("2024-03", 700))}
    told = []

    def more(entry, month, wanted, exclude):  # one more than wanted, so that what is over waits
        told.append({r["item_id"] for r in exclude.collect()} if hasattr(exclude, "collect") else exclude)
        return [{"id": f"new-{month}-{k}"} for k in range(wanted + 1)]

    want = orders.submit_orders_for_plan(plan, aoi, client=Strict(), replace=more)
    items = spark.createDataFrame([(m, k, i["id"]) for m, p in plan.items() for k, i in enumerate([*p["items"], p["items"][0], {"id": ""}])], "month string, ord long, id string")
    found = orders.submit_orders_for_table(items, aoi, client=Strict(), replace=more).collect()
    for month, d in want.items():
        own = sorted((r for r in found if r["month"] == month), key=lambda r: r["place"])
        assert [r["id"] for r in own] == d["item_ids"] and [r["place"] for r in own] == list(range(len(own)))
        assert {r["orders"] for r in own} == {len(d["order_ids"])} and {r["order_id"] for r in own} == set(d["order_ids"] or [None])
    assert len(told) == 8 and told[:4] == told[4:]
    assert want["2024-03"]["order_id"] is None and "2024-02-600" not in want["2024-02"]["item_ids"] and len(want["2024-02"]["order_ids"]) == 3


def test_command_line(capsys):
    assert cli.main([]) == 2 and cli.main(["--version"]) == 2
    with pytest.raises(SystemExit):
        cli.parse_plan(["--catalog", "c", "--aoi", "a", "--start", "2024-01-01", "--end", "2024-01-31"])
    a = cli.parse_plan(["--catalog", "c", "--aoi", "a", "--start", "s", "--end", "e", "--instrument-type", "PS2", "--instrument-type", "PSB.SD"])
    assert a.instrument_type == ["PS2", "PSB.SD"] and a.cloud_max == 0.1 and a.tile_size_m == 1000


def test_simplify_keeps_the_limit():
    import numpy as np

    t = np.linspace(0, 2 * np.pi, 2000, endpoint=False)
    circle = geo.Geometry.read({"type": "Polygon", "coordinates": [[*zip(np.cos(t), np.sin(t), strict=True)]]})
    assert circle.vertices() == 2001
    small = circle.simplified(1500)
    assert 4 <= small.vertices() <= 1500
    assert small.bounds() == pytest.approx(circle.bounds(), abs=1e-3)
    with pytest.raises(ValueError):
        geo.union([geo.box(k, 0, k + 0.5, 1) for k in range(10)]).simplified(10)


def plain_greedy(scenes, n, target, depth, weight=0.35):
    """The greedy choice, scene by scene and tile by tile. scenes: ord, tiles, clear, azimuth, elevation, quality."""
    import math

    chosen, left = [], sorted(scenes)
    tiles = {t: {"obs": 0.0, "x": 0.0, "y": 0.0, "aw": 0.0, "e": 0.0, "ew": 0.0, "seen": False} for t in range(n)}
    while sum(t["seen"] for t in tiles.values()) / n < target or sum(t["obs"] >= depth for t in tiles.values()) / n < planner.DEPTH_TARGET:
        best, most = None, 0.0
        for s in left:
            _, own, clear, azimuth, elevation, quality = s
            score = 0.0
            for k in own:
                t = tiles[k]
                if t["seen"] and t["obs"] >= depth:
                    continue
                part = (1 + max(0, depth - t["obs"])) * clear * max(0.0, 1 + weight * (quality - 0.5) * 2)
                if azimuth is not None and t["aw"] > 0:
                    part *= math.exp(-((abs((azimuth - math.degrees(math.atan2(t["y"], t["x"])) % 360 + 180) % 360 - 180) / 20) ** 2))
                if elevation is not None and t["ew"] > 0:
                    part *= math.exp(-(((elevation - t["e"] / t["ew"]) / 10) ** 2))
                score += part
            if score > most:
                best, most = s, score
        if best is None:
            break
        left.remove(best)
        chosen.append(best[0])
        _, own, clear, azimuth, elevation, _ = best
        for k in own:
            t = tiles[k]
            t["seen"], t["obs"] = True, t["obs"] + clear
            if azimuth is not None:
                t["x"], t["y"], t["aw"] = t["x"] + math.cos(math.radians(azimuth)) * clear, t["y"] + math.sin(math.radians(azimuth)) * clear, t["aw"] + clear
            if elevation is not None:
                t["e"], t["ew"] = t["e"] + elevation * clear, t["ew"] + clear
    return chosen


def test_the_whole_greedy_choice_is_that_of_a_plain_version(spark):
    import random

    rng = random.Random(4)
    rows = []
    for month in ("2024-01", "2024-02"):
        for k in range(60):
            x, y = rng.randrange(6), rng.randrange(6)
            own = sorted({(x + i) % 6 * 6 + (y + j) % 6 for i in range(rng.randint(1, 3)) for j in range(rng.randint(1, 3))})
            rows.append((month, k, own, rng.uniform(0.5, 1), rng.choice([None, rng.uniform(0, 360)]), rng.choice([None, rng.uniform(20, 60)]), rng.random()))
    found = planner.select(spark.createDataFrame(rows, "month string, ord long, tiles array<int>, clear_fraction double, sun_azimuth double, sun_elevation double, quality_score double"), 36).collect()
    for month in ("2024-01", "2024-02"):
        want = plain_greedy([r[1:] for r in rows if r[0] == month], 36, 0.98, 3.0)
        assert len(want) > 20 and [r["ord"] for r in sorted(found, key=lambda r: r["rank"]) if r["month"] == month] == want


def arrow_scenes(rows):
    import pyarrow as pa

    names = ["ord", "tiles", "clear_fraction", "sun_azimuth", "sun_elevation", "quality_score"]
    kinds = [pa.int64(), pa.list_(pa.int32()), *[pa.float64()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def test_greedy_by_batches_and_blocks_is_that_of_a_plain_version(monkeypatch):
    import random

    rng = random.Random(6)
    rows = []
    for k in range(200):
        x, y = rng.randrange(6), rng.randrange(6)
        own = sorted({(x + i) % 6 * 6 + (y + j) % 6 for i in range(rng.randint(1, 3)) for j in range(rng.randint(1, 3))})
        rows.append((k, own, rng.choice([0.5, rng.uniform(0.5, 1)]), rng.choice([None, rng.uniform(0, 360)]), rng.choice([None, rng.uniform(20, 60)]), rng.random()))
    monkeypatch.setattr(planner, "SCORED", 7)
    scenes, whole = planner.Scenes(), arrow_scenes(rows)
    for low in range(0, 200, 13):
        scenes.add(whole.slice(low, 13))
    found = planner.greedy(scenes, 36, 0.98, 3.0, 20.0, 10.0, 0.35).tolist()
    assert len(found) > 20 and found == plain_greedy(rows, 36, 0.98, 3.0)


def test_greedy_takes_little_memory_beside_its_scenes():
    import tracemalloc

    import pyarrow as pa

    n = 400_000
    flat = pa.ListArray.from_arrays(pa.array([8 * k for k in range(n + 1)], pa.int32()), pa.array([k % 16 for k in range(8 * n)], pa.int32()))
    columns = [pa.array([0.9] * n), pa.array([100.0] * n), pa.array([40.0] * n), pa.array([0.5] * n)]
    scenes, whole = planner.Scenes(), pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), flat, *columns], ["ord", "tiles", "clear_fraction", "sun_azimuth", "sun_elevation", "quality_score"])
    tracemalloc.start()
    for low in range(0, n, 10_000):
        scenes.add(whole.slice(low, 10_000))
    assert planner.greedy(scenes, 16, 0.98, 3.0, 20.0, 10.0, 0.35).tolist() == list(range(8))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 220 * n  # 80 bytes a scene are its own


def test_a_service_key_is_needed():
    from orbweave.operators import orders as O

    assert O.basic_header("key ") == "Basic a2V5Og=="
    with pytest.raises(ValueError):
        O.basic_header(" ")


def test_lookup_by_a_list(spark):
    from orbweave.operators import orders as O

    items = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "item_id string, n int")
    assert [r["item_id"] for r in O.lookup(items, ["a", "", "zz", "a"]).collect()] == ["a"]
