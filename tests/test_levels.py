import warnings

import pytest

from strata.functions.strategies import Composite, Max, Mean, Min, SmoothMean, Sum
from strata.levels import Levels
from strata.operators import mapping as mp
from strata.operators import nearest as nr
from strata.scratch import numbered

BOX = "minx double, miny double, maxx double, maxy double"


def layer(spark, boxes, **columns):
    """Boxes by id; columns as lists in the same order."""
    rows = [(i, *map(float, b), *(c[k] for c in columns.values())) for k, (i, b) in enumerate(boxes.items())]
    return spark.createDataFrame(rows, ", ".join(["id string", BOX, *(f"{c} double" for c in columns)]))


# a county of three towns side by side, each with two blocks above each other and one behind
COUNTY = {"c": (0, 0, 12, 6)}
TOWNS = {"west": (0, 0, 4, 6), "mid": (4, 0, 8, 6), "east": (8, 0, 12, 6)}
BLOCKS = {f"{t}{k}": (x, 2 * k, x + 4, 2 * k + 2) for t, x in (("w", 0), ("m", 4), ("e", 8)) for k in range(3)}


def graph(spark, strategy=None, column="pop", county=None, towns=None, blocks=None):
    out = Levels(4.0)
    if strategy:
        out.set_strategy(column, strategy, propagate=False)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for name, boxes, values, parent in (("county", COUNTY, county, None), ("town", TOWNS, towns, "county"), ("block", BLOCKS, blocks, "town")):
            out.add_level(name, layer(spark, boxes, **({column: values} if values else {})), parent=parent)
    return out


def values(levels, name, column="pop"):
    return {r["id"]: r[column] for r in levels.tables[name].select("id", column).collect()}


NINE = [1.0, 5.0, 2.0, 7.0, 0.0, 4.0, 3.0, 3.0, 6.0]


def test_up_over_two_levels_and_child_wins(spark):
    up = graph(spark, Sum(), blocks=NINE)
    assert values(up, "town") == {"west": 8, "mid": 11, "east": 12} and values(up, "county") == {"c": 31}
    both = graph(spark, Sum(), county=[777.0], blocks=NINE)
    assert values(both, "town") == {"west": 8, "mid": 11, "east": 12} and values(both, "county") == {"c": 777}
    before = {n: sorted(map(tuple, t.collect())) for n, t in both.tables.items()}
    both.propagate()
    assert before == {n: sorted(map(tuple, t.collect())) for n, t in both.tables.items()}


def test_nulls_are_filled_from_parents(spark):
    third = graph(spark, Sum(), county=[90.0], towns=[None, 50.0, None])
    assert values(third, "town") == {"west": 30, "mid": 50, "east": 30}
    deep = graph(spark, Sum(), county=[90.0], towns=[None, None, None], blocks=[None, *NINE[1:]])
    assert values(deep, "town") == {"west": 30, "mid": 30, "east": 30} and values(deep, "block") == {**dict(zip(BLOCKS, NINE)), "w0": 10}
    peak = graph(spark, Max(), county=[40.0], towns=[None, 6.0, None])
    assert values(peak, "town") == {"west": 40, "mid": 6, "east": 40}


def test_down_weights_and_means(spark):
    even = graph(spark, Sum(), county=[90.0])
    assert values(even, "town") == dict.fromkeys(TOWNS, 30) and sum(values(even, "block").values()) == pytest.approx(90)
    assert values(graph(spark, Mean(), county=[7.0]), "block") == dict.fromkeys(BLOCKS, 7)
    two = Levels(4.0)
    two.set_strategy("rent", Mean(weight="flats"), propagate=False)
    two.set_strategy("flats", Sum(), propagate=False)
    two.add_level("town", layer(spark, TOWNS, rent=[8.0, 20.0, 11.0], flats=[50.0, 10.0, 40.0]))
    two.add_level("county", layer(spark, COUNTY), child="town")
    assert values(two, "county", "rent") == {"c": 10.4} and values(two, "county", "flats") == {"c": 100}


def test_strategies_by_priority_exclusion_and_warnings(spark):
    out = graph(spark, Sum(), blocks=NINE)
    out.set_strategy("pop", Max(), level="block")
    assert values(out, "town") == {"west": 5, "mid": 7, "east": 6} and values(out, "county") == {"c": 18}
    out.exclude_column("pop")
    assert "pop" not in out.tables["town"].columns and "pop" in out.tables["block"].columns
    out.include_column("pop")
    assert values(out, "town") == {"west": 5, "mid": 7, "east": 6}
    with pytest.raises(KeyError):
        out.exclude_column("nothing")
    with pytest.raises(ValueError):
        out.set_strategy()
    with pytest.warns(UserWarning, match="no strategy"):
        bare = Levels(4.0)
        bare.add_level("town", layer(spark, TOWNS, pop=[1.0, 2.0, 3.0]))
        bare.add_level("county", layer(spark, COUNTY), child="town")
    assert "pop" not in bare.tables["county"].columns
    out.set_strategy("pop", upward=Sum(), downward=Max())
    assert values(out, "county") == {"c": 18}


def test_one_strategy_travels_and_replaced_levels_are_forgotten(spark):
    out = Levels(4.0)
    out.add_level("county", layer(spark, COUNTY))
    out.add_level("town", layer(spark, TOWNS), parent="county")
    out.add_level("block", layer(spark, BLOCKS, pop=NINE), strategies=Sum(), parent="town")
    assert values(out, "county") == {"c": 31}
    out.add_level("town", layer(spark, TOWNS, pop=[2.0, 2.0, 2.0]), parent="county", child="block")
    assert values(out, "town") == dict.fromkeys(TOWNS, 2) and values(out, "county") == {"c": 6}
    out.add_level("town", layer(spark, TOWNS), parent="county", child="block")  # without the column: derived again
    assert values(out, "town") == {"west": 8, "mid": 11, "east": 12} and out.native["pop"] == ["block"]
    out.set_strategy("pop", Max())
    assert values(out, "county") == {"c": 7}


def test_made_ids_do_not_depend_on_the_splits(spark):
    rows = layer(spark, BLOCKS, pop=NINE).drop("id").union(layer(spark, TOWNS, pop=[1.0, None, 1.0]).drop("id"))
    once, again = (sorted(map(str, numbered(rows.repartition(n)).collect())) for n in (1, 7))
    assert once == again and sorted(r["id"] for r in numbered(rows).collect()) == list(range(12))
    out = Levels(4.0)
    out.add_level("block", rows)
    assert out.level("block").count() == 12


def test_vector_data_and_direction(spark):
    city = Levels(4.0)
    city.add_level("city", layer(spark, TOWNS))
    city.add_vector(layer(spark, BLOCKS, pop=[*NINE[:8], None]), "city", Sum(), "pop")
    assert values(city, "city") == {"west": 8, "mid": 11, "east": 6}
    city.add_vector(layer(spark, COUNTY, pop=[90.0]), "city", Sum(), "pop")  # coarser, so it is split
    assert values(city, "city") == dict.fromkeys(TOWNS, 30)
    same = layer(spark, {"w": (1, 1, 1, 1)}, pop=[1.0]).union(layer(spark, {"w": (9, 1, 9, 1)}, pop=[2.0]))  # one id twice
    city.add_vector(same, "city", Sum(), "pop", upward=True)
    assert values(city, "city") == {"west": 1, "mid": 0, "east": 2}
    far = layer(spark, {"x": (15, 8, 16, 9)}, pop=[1.0])
    city.add_vector(far, "city", Sum(), "pop", upward=True)
    assert values(city, "city") == dict.fromkeys(TOWNS, 0)
    city.add_vector(far, "city", Sum(), "pop", upward=True, fill_null=None)
    assert values(city, "city") == dict.fromkeys(TOWNS)
    city.add_vector(far, "city", Sum(), "pop", upward=True, buffer=5.0)
    assert sum(values(city, "city").values()) == 1


def test_geoweighted_split_and_modes(spark):
    src, dst = layer(spark, {"D": (0, 0, 1, 1)}, v=[90.0]), layer(spark, {"C1": (-0.5, 0, 0.5, 1), "C2": (0.5, 0, 1, 1)})
    levels = Levels(1.0)
    levels.add_level("coarse", src, strategies={"v": Sum(geoweighted=True)})
    levels.add_level("fine", dst, parent="coarse")
    assert values(levels, "fine", "v") == pytest.approx({"C1": 30, "C2": 60})
    cells = layer(spark, {"in": (0.4, 0.4, 0.5, 0.5), "d1": (0.05, 0.05, 0.15, 0.15), "over": (-0.1, 0, 1.1, 1)})
    two = layer(spark, {"D1": (0, 0, 0.75, 1), "D2": (0.25, 0, 1, 1)})
    rows = sorted(map(tuple, mp.map_touches(cells, two, 0.5).collect()))
    assert rows == [("d1", "D1", 1.0), ("in", "D1", 0.5), ("in", "D2", 0.5)]
    with pytest.raises(ValueError):
        mp.id_mapping(cells, two, 0.5, mode="other")
    assert Sum(mode="exact").geoweighted and Composite(Sum(), Mean(mode="touches")).mode is None


def test_smooth_means_keep_totals_and_skip_nulls(spark):
    src = layer(spark, {"L": (0, 0, 10, 10), "R": (10, 0, 20, 10)}, v=[None, 50.0])
    fine = layer(spark, {f"f{i}": (5 + i, 0, 6 + i, 10) for i in range(10)})
    blend = Levels(10.0)
    blend.add_level("coarse", src, strategies={"v": SmoothMean(k=2)})
    blend.add_level("fine", fine, parent="coarse")
    assert list(values(blend, "fine", "v").values()) == pytest.approx([50.0] * 10)
    dense = Levels(10.0)
    dense.add_level("coarse", layer(spark, {"C": (0, 0, 10, 10)}, v=[700.0]), strategies={"v": SmoothMean(density=True)})
    dense.add_level("fine", layer(spark, {f"f{i}": (i, 0, i + 1, 10) for i in range(10)}), parent="coarse")
    assert list(values(dense, "fine", "v").values()) == pytest.approx([70.0] * 10)
    plain = Levels(10.0)
    plain.add_level("coarse", layer(spark, {"L": (0, 0, 10, 10), "R": (10, 0, 20, 10)}, v=[100.0, 0.0]), strategies={"v": Sum()})
    plain.add_level("fine", fine, parent="coarse")
    assert sorted(values(plain, "fine", "v").values()) == [0.0] * 5 + [20.0] * 5
    assert Min().up("v") is not None


def test_nan_counts_as_null(spark):
    out = graph(spark, Mean(), blocks=[float("nan"), 2.0, *[float("nan")] * 7])
    assert values(out, "town") == dict.fromkeys(TOWNS, 2)  # the others take the county's mean


def test_wide_and_small_boxes_meet_once(spark):
    big = {"w": (0, 0, 100_000, 100_000), "m": (3, 3, 40, 40)}
    small = {f"s{i}": (i, i, i + 0.5, i + 0.5) for i in range(50)}
    got = sorted((r["src_id"], r["dst_id"]) for r in mp.map_intersects(layer(spark, small), layer(spark, big), 1.0).collect())
    want = sorted((s, d) for s, b in small.items() for d, c in big.items() if b[0] <= c[2] and c[0] <= b[2])
    assert got == want
    turned = sorted((r["dst_id"], r["src_id"]) for r in mp.map_intersects(layer(spark, big), layer(spark, small), 1.0).collect())
    assert turned == want


def test_empty_cells(spark):
    grid = {f"{x}{y}": (100 * x, 100 * y, 100 * x + 100, 100 * y + 100) for x in range(5) for y in range(5)}
    cells = layer(spark, grid, score=[float(k % 5 + 1) if k < 5 else None for k in range(25)], other=[float(k) if k < 5 else None for k in range(25)], pop=[10.0] * 25)
    out, lost = nr.relocate_weight(cells, "score", "pop", 100.0, most=1000.0)
    moved = {r["id"]: r["pop"] for r in out.collect()}
    assert sum(moved.values()) == 250 and all(moved[f"0{y}"] == 50 for y in range(5)) and lost.first()[0] == 0
    for most, gone, left in ((150.0, 150, 100), (300.0, 50, 200)):
        out, lost = nr.relocate_weight(cells, "score", "pop", 100.0, most=most)
        assert lost.first()[0] == gone and sum(r["pop"] for r in out.collect()) == left
    full = {r["id"]: r for r in nr.handle_empty(cells, ["score", "other"], "pop", 100.0).collect()}
    assert all(full[f"{x}{y}"]["score"] == y + 1 and full[f"{x}{y}"]["other"] == y for x in range(5) for y in range(5))
    assert nr.handle_empty(cells, "score", "pop", 100.0, "ignore") is cells
    with pytest.raises(ValueError):
        nr.handle_empty(cells, "score", "pop", 100.0, "other")
    rows = spark.createDataFrame([(1.0, 10.0), (None, 1000.0), (3.0, 30.0)], "v double, w double")
    assert nr.group_means(rows, "v", "w").first()["v"] == 2.5


def test_kept_mappings_and_counted_nulls(spark, tmp_path, monkeypatch):
    made = []
    build = mp.id_mapping
    monkeypatch.setattr(mp, "id_mapping", lambda *a: made.append(1) or build(*a))
    for _ in range(2):
        up = Levels(4.0, folder=str(tmp_path))
        up.set_strategy("pop", Sum(), propagate=False)
        up.add_level("town", layer(spark, TOWNS))
        up.add_level("block", layer(spark, BLOCKS, pop=[None, *NINE[1:]]), parent="town")
        assert values(up, "town") == {"west": 7, "mid": 11, "east": 12} and len(made) == 1
    nulls = spark.sparkContext.statusTracker()
    before = len(nulls.getJobIdsForGroup(None))
    up.propagate()
    assert len(nulls.getJobIdsForGroup(None)) == before  # nothing has changed, so no job runs
    up.set_column("block", spark.createDataFrame([(b, 2.0) for b in BLOCKS], "id string, pop double"), "pop")
    assert values(up, "town") == {"west": 6, "mid": 6, "east": 6}
