"""Names, registries, planning, the engine, tiles, the store, streams and the catalogue."""

from __future__ import annotations

import importlib
import subprocess
import sys

import numpy as np
import pytest
from gridloom.errors import InvalidKey, LookupFailed
from gridloom.operators.interpolation import Delaunay, Linear, Nearest
from gridloom.operators.projection import Orthographic, Projection, Spherical
from gridloom.plans import catalog, grammar
from gridloom.plans.engine import ImageKey, RasterEngine, Tile, TiledEngine, TiledSettings
from gridloom.plans.planner import FeaturePlan
from gridloom.plans.registry import FeatureRegistry, FeatureSpec, StrategyRegistry
from gridloom.schema import Raster, Resolution, storable
from gridloom.sources.points import point_table
from gridloom.sources.store import RasterStore, raster_rows, validate_key

from .conftest import array_of, raster_of

FEATURES = grammar.enable_red_relief(grammar.FEATURES.copy())


def args(name):
    spec = FEATURES.match(name)
    return spec.family, {k: v for k, v in spec.args.items() if v is not None}, spec.requires


@pytest.mark.parametrize(
    ("name", "family", "told", "needs"),
    [
        ("range", "range", {}, ()),
        ("scalar_field_a b", "scalar_field", {"field": "a b"}, ()),
        ("totally_unknown_feature", "scalar_field", {"field": "totally_unknown_feature"}, ()),
        ("gradient_z_range", "scalar_field", {"field": "gradient_z_range"}, ()),
        ("gradient_x_gradient_y_range_px1", "gradient", {"axis": "x", "base": "gradient_y_range", "spacing": 1.0}, ("gradient_y_range",)),
        ("gradient_x_range_pxa", "gradient", {"axis": "x", "base": "range_pxa"}, ("range_pxa",)),
        ("gradient_x_px2", "gradient", {"axis": "x", "base": "px2"}, ("px2",)),
        ("sobel_y_log_range", "sobel", {"axis": "y", "base": "log_range"}, ("log_range",)),
        ("hillshade", "hillshade", {"base": "range"}, ("range",)),
        ("hillshade_315", "hillshade", {"base": "315"}, ("315",)),
        ("hillshade_315_45", "hillshade", {"base": "315", "azimuth": 45.0}, ("315",)),
        ("hillshade_range_315_45", "hillshade", {"base": "range", "azimuth": 315.0, "altitude": 45.0}, ("range",)),
        ("hillshade_range_1_2_3_4", "hillshade", {"base": "range_1", "azimuth": 2.0, "altitude": 3.0, "z": 4.0}, ("range_1",)),
        ("hillshade__5", "hillshade", {"base": "_5"}, ("_5",)),
        ("normalized_clip_range_5_95", "normalized", {"base": "clip_range", "low": 5.0, "high": 95.0}, ("clip_range",)),
        ("normalized_clip_range_5_95_0_100", "normalized", {"base": "clip_range_5_95", "low": 0.0, "high": 100.0}, ("clip_range_5_95",)),
        ("normalized_5_95", "normalized", {"base": "5_95"}, ("5_95",)),
        ("clip_range", "scalar_field", {"field": "clip_range"}, ()),
        ("clip_range_5", "scalar_field", {"field": "clip_range_5"}, ()),
        ("average_(range)", "scalar_field", {"field": "average_(range)"}, ()),
        ("sum_(a,)", "scalar_field", {"field": "sum_(a,)"}, ()),
        ("norm_((a,b))", "norm", {"names": ("(a,b)",)}, ("(a,b)",)),
        ("multigrad_x_1", "multigrad", {"base": "x", "scales": (1.0,), "options": ()}, ("x",)),
        ("multigrad_x_range_1", "multigrad", {"axis": "x", "base": "range", "scales": (1.0,), "options": ()}, ("range",)),
        ("multigrad_scalar_field_2_1-2", "multigrad", {"base": "scalar_field", "scales": (2.0,), "options": ("1-2",)}, ("scalar_field",)),
        ("multigrad_a_1.5_2.5", "multigrad", {"base": "a_1.5", "scales": (2.5,), "options": ()}, ("a_1.5",)),
        ("multigrad_range_1_mean.x", "scalar_field", {"field": "multigrad_range_1_mean.x"}, ()),
        ("multigradocc_a_1.5_2.5", "multigradocc", {"base": "a", "scales": (1.5,), "options": ("2.5",)}, ("a",)),
        ("multigradocc_y_range_1-2.5_soft0.4_mask", "multigradocc", {"axis": "y", "base": "range", "scales": (1.0, 2.5), "options": ("soft0.4", "mask")}, ("range",)),
    ],
)
def test_names(name, family, told, needs):
    assert args(name) == (family, told, needs)


def test_lists_and_relief_names():
    assert FEATURES.match("average_(range, sum_(a,b),c)").requires == ("range", "sum_(a,b)", "c")
    assert grammar.split_names("a,(b,c),d ") == ["a", "(b,c)", "d"]
    assert FEATURES.match("rrim").requires == ("range", "rrim_pack_(range,r16,d8,z1)")
    assert FEATURES.match("rrim_(intensity,r4,d4,sclip1-99,red0.5,z1e-05)").requires == ("intensity", "rrim_pack_(intensity,r4,d4,z1e-05)")
    assert FEATURES.match("rrim_pack_(z1e5)").args["base"] == "range" and FEATURES.match("rrim_pack_(z1e5)").args["settings"].z == 1e5
    assert FEATURES.match("rrim_pack_(z1e5x)").args["base"] == "z1e5x"
    assert FEATURES.match("rrim_component_(slope,range,r24,d16)").requires == ("range",)
    assert FEATURES.match("rrim_component_(structure,range,r24)").requires == ("rrim_pack_(range,r24,d8,z1)",)
    for bad in ("rrim_(range,what)", "rrim_(range,r0)", "rrim_(range,z0)", "rrim_component_(colour,range)", "rrim_(range,sclip9-1)"):
        with pytest.raises(ValueError):
            FEATURES.match(bad)
    for z in (1e-06, 0.1, 1.5, 2.0, 4503599627370495.5):
        settings = grammar.relief_settings(f"range,z{grammar.format_number(z)}")[1]
        assert settings.z == z and grammar.relief_settings(grammar.pack_name("range", settings)[11:-1])[1].z == z
    assert grammar.FEATURES.copy().match("rrim").family in ("scalar_field", "rrim")
    for token, value in (("z1e5", 1e5), ("z-1.5E-3", -1.5e-3), ("z1e", None), ("z1e1.5", None), ("z.5", None), ("red+2", None)):
        assert (grammar.read_option(token, grammar.RELIEF) or {}).get("z") == value


def test_options():
    assert grammar.read_options(["sum", "RAW"], grammar.FUSING + grammar.MAGNITUDE) == {"fuse": "sum", "scaled": False}
    told = grammar.read_options("thresh0.5_sigmae1_dilate2_soft_mean".split("_"), grammar.FUSING + grammar.MASKING)
    assert told == {"threshold": 0.5, "edge_sigma": 1.0, "dilate": 2, "soft": 0.3, "fuse": "mean"}
    for bad in ("stack", "threshx", "foo", "dilate1.5", "thresh", ""):
        with pytest.raises(ValueError):
            grammar.read_options([bad], grammar.FUSING + grammar.MASKING)
    for bad in ("multigrad_x_range_1_mag", "multigrad_range_1_stack", "multigradocc_range_1_mag"):
        with pytest.raises(ValueError):
            FEATURES.match(bad).build(lambda name: None)


def test_registries():
    registry = FeatureRegistry()
    with pytest.raises(LookupFailed):
        registry.match("x")
    registry.feature(r"twice_(?P<base_feature>.+)")(lambda raster, base_feature: raster.map(lambda v: 2 * v))
    with pytest.raises(LookupFailed):
        registry.feature(r"twice_(?P<base_feature>.+)")(lambda raster, base_feature: raster)
    registry.feature(r"twice_a")(lambda: None)
    with pytest.raises(LookupFailed):
        registry.match("twice_a")
    registry.register_fallback(lambda name: FeatureSpec(name, "f", {}))
    with pytest.raises(LookupFailed):
        registry.register_fallback(lambda name: FeatureSpec(name, "g", {}))
    strategies = StrategyRegistry(Projection)
    strategies.register("o", Orthographic)
    for error, call in (
        (LookupFailed, lambda: strategies.register("o", Spherical)), (LookupFailed, lambda: strategies.create("p")), (LookupFailed, lambda: strategies.key_of(Spherical)),
        (TypeError, lambda: strategies.create("o", what=1)), (TypeError, lambda: strategies.coerce(["o", {}])), (TypeError, lambda: strategies.coerce(Nearest())),
    ):
        with pytest.raises(error):
            call()
    assert strategies.key_of(Orthographic) == strategies.key_of(Orthographic()) == strategies.key_of(type("Own", (Orthographic,), {})) == "o" and strategies.coerce(("o", {"plane": "yz"})).plane == "yz" and strategies.coerce(Orthographic).plane == "xy"

    class Loose(Projection):
        def __init__(self, a=1, **more):
            self.a, self.more = a, more

    strategies.register("loose", Loose)
    with pytest.warns(UserWarning):
        assert strategies.create("loose", a=2, b=3).more == {}
    error = LookupFailed("no such")
    assert isinstance(error, KeyError) and isinstance(error, RuntimeError) and str(error) == "no such"


def test_resolutions():
    assert Resolution.of((3, 2)) == Resolution(3, 2)
    for error, bad in ((TypeError, [3, 2]), (TypeError, (3.0, 2)), (TypeError, (1, 2, 3)), (ValueError, (0, 2))):
        with pytest.raises(error):
            Resolution.of(bad)


def test_planning():
    registry, made = FeatureRegistry(), []

    def parse(name):
        needs = {"a": ("b", "c"), "b": ("d",), "c": ("d",), "x": ("y",), "y": ("x",), "s": ("s",)}.get(name, ())
        if name == "d":
            return FeatureSpec(name, "base", {}, column=lambda points: None)
        return FeatureSpec(name, "f", {}, needs, build=lambda fetch: (made.append(name), [fetch(n) for n in needs], name)[2])

    registry.register_fallback(parse)
    plan = FeaturePlan(registry)
    plan.request(["a", "b"])
    assert list(plan.base_features()) == ["d"]
    plan.submit("d", "D")
    assert plan.targets() == {"a": "a", "b": "b"} and sorted(made) == ["a", "b", "c"]
    plan.request(["c", "d"])
    assert plan.base_features() == {} and plan.targets() == {"c": "c", "d": "D"} and len(made) == 3 and set(plan.available_features()) == set("abcd")
    for name in ("x", "s"):
        with pytest.raises(ValueError, match="cycle"):
            plan.request([name])


def cloud(spark, n=64, seed=1, tile="t", **fields):
    r = np.random.default_rng(seed)
    rows = [(tile, i, *map(float, r.random(3)), *(float(f) for f in fields.values())) for i in range(n)]
    return spark.createDataFrame(rows, "tile_id string, point_id bigint, x double, y double, z double" + "".join(f", `{f}` double" for f in fields))


def test_engine(spark):
    engine = RasterEngine(cloud(spark, n=30, **{"Scalar field": 3.5}), (8, 6), "orthographic", "nearest_neighbor")
    made = engine.generate(["range", "Scalar field", "sum_(range,scalar_field_Scalar field)", "hillshade", "hillshade"])
    assert list(made) == ["range", "Scalar field", "sum_(range,scalar_field_Scalar field)", "hillshade"]
    assert (array_of(made["Scalar field"]) == 3.5).all()
    assert np.allclose(array_of(made["sum_(range,scalar_field_Scalar field)"]), array_of(made["range"]) + 3.5)
    assert engine.projection.plane == "xy" and set(engine.plan.available_features()) >= {"range", "hillshade"}
    with pytest.raises(ValueError):
        engine.generate(["clip_range"])
    engine.close()
    for bad in ("sphere", ("orthographic", {"plain": "xy"})):
        with pytest.raises((LookupFailed, TypeError)):
            RasterEngine(cloud(spark), (8, 6), bad)


def test_user_features_and_mask_band(spark):
    registry = grammar.FEATURES.copy()
    registry.feature(r"height", base=True)(lambda points: points["z"])
    registry.feature(r"negative_(?P<base_feature>.+)")(lambda raster, base_feature: raster.map(lambda v: -v))
    engine = RasterEngine(cloud(spark), (5, 4), "orthographic", registry=registry)
    made = engine.generate(["height", "negative_height"])
    assert np.allclose(array_of(made["height"]), -array_of(made["negative_height"]))
    with pytest.raises(AssertionError):
        engine.generate(["multigradocc_range_1_mask"])
    engine.close()


def test_tiles(spark, tmp_path):
    tiles = [Tile("tile_00", cloud(spark, seed=1)), Tile("tile_01", cloud(spark, seed=2)), Tile("tile_02", cloud(spark, seed=1), {"field_of_view": None})]
    engine = TiledEngine(tiles, (8, 8), "spherical", "nearest_neighbor")
    made = engine.generate(["range", "gradient_x_range"])
    assert set(made) == {ImageKey(t.tile_id, f) for t in tiles for f in ("range", "gradient_x_range")}
    a, b, c = (array_of(made[ImageKey(t.tile_id, "range")]) for t in tiles)
    alone = RasterEngine(cloud(spark, seed=2), (8, 8), "spherical")
    assert np.allclose(a, c) and not np.allclose(a, b) and np.allclose(b, array_of(alone.generate(["range"])["range"]))
    engine.close()
    alone.close()
    for ids, says in ((("dup", "dup"), "dup"), (("a", "b", "a"), "a")):
        with pytest.raises(ValueError, match=says):
            TiledEngine([Tile(i, tiles[0].points) for i in ids], (8, 8))
    with pytest.raises(TypeError):
        TiledEngine([tiles[2]], (8, 8), projection_options={"field_of_view": None})
    with pytest.raises(InvalidKey):
        TiledEngine([Tile("../x", tiles[0].points)], (8, 8))
    with pytest.raises(ValueError):
        TiledEngine(tiles[:1], (8, 8)).generate(["intensity"])
    assert TiledSettings().as_kwargs() == {"resolution": (16, 12), "projection": "spherical", "interpolation": "nearest_neighbor"}
    settings = TiledSettings((8, 8), store_path=str(tmp_path)).extend_store_path("run_1")
    stored = TiledEngine(tiles[:2], **settings.as_kwargs())
    assert np.allclose(array_of(stored.generate(["range"])[ImageKey("tile_01", "range")]), b) and (tmp_path / "run_1" / "range").exists()
    stored.close()


def test_weights_are_found_once(spark, monkeypatch):
    calls = []
    found = Linear.weights
    monkeypatch.setattr(Linear, "weights", lambda self, points, size: (calls.append(1), found(self, points, size))[1])
    engine = RasterEngine(cloud(spark, n=64, seed=5, intensity=2.5), (8, 8), "orthographic", "linear")
    first = array_of(engine.generate(["range"])["range"])
    second = array_of(engine.generate(["intensity"])["intensity"])
    assert len(calls) == 1
    engine.close()
    alone = RasterEngine(cloud(spark, n=64, seed=5, intensity=2.5), (8, 8), "orthographic", "linear")
    assert np.allclose(array_of(alone.generate(["intensity"])["intensity"]), second, equal_nan=True) and not np.allclose(first, second, equal_nan=True)
    alone.close()


def test_keys():
    for good in ("range", "hillshade_range_315_45", "norm_(range,2,98)", "rrim_pack_(range,r16,d8,z1e-05)", "scalar_field_Scalar field"):
        assert validate_key(good) == good
    for bad in ("", ".", "..", "CON", "con.txt", "tile_03/range", "scalar_field_a\\b", "scalar_field_GPS:time", "tile_03.", "x ", None):
        with pytest.raises(ValueError):
            validate_key(bad)


def test_store(spark, tmp_path):
    store = RasterStore(spark, str(tmp_path), (3, 2))
    one, two = raster_of(spark, [[1.0, 2, 3], [4, 5, np.nan]], "a"), raster_of(spark, np.full((2, 3), 9.0), "b")
    both = Raster(one.df.union(two.df), one.size)
    store.add("norm_(range,2,98)", both)
    assert store.get("norm_(range,2,98)").df.count() == 12
    with pytest.raises(InvalidKey):
        store.add("a/b", one)
    with pytest.raises(AssertionError):
        store.add("norm_(range,2,98)", one.select({"a": one.df["v"], "b": one.df["v"]}))
    assert store.get("norm_(range,2,98)").df.count() == 12  # what is refused changes nothing
    store.add("norm_(range,2,98)", Raster(one.df.selectExpr("tile_id", "y", "x", "v * 10 AS v"), one.size), mode="tiles")
    kept = store.get("norm_(range,2,98)")
    assert kept.df.where("tile_id = 'b' AND v = 9").count() == 6 and kept.df.where("tile_id = 'a' AND v = 50").count() == 1
    store.add("norm_(range,2,98)", one)
    assert np.allclose(array_of(store.get("norm_(range,2,98)")), array_of(one), equal_nan=True)
    assert array_of(store.to_uint8("norm_(range,2,98)")).max() == 255
    with pytest.raises(TypeError):
        store.rasters["x"] = one
    store.untrack("norm_(range,2,98)")
    with pytest.raises(KeyError):
        store.get("norm_(range,2,98)")
    other = RasterStore(spark, str(tmp_path), (3, 2))
    assert other.adopt() == ["norm_(range,2,98)"] and other.get("norm_(range,2,98)").df.count() == 6
    other.purge()
    assert RasterStore(spark, str(tmp_path), (3, 2)).adopt() == []
    with pytest.raises(ValueError):
        storable_wrong = RasterStore(spark, str(tmp_path), (4, 4))
        storable_wrong.add("x", one)
    assert raster_rows(one).count() == 5 and storable(one) is one


def test_engine_with_store(spark, tmp_path):
    store = RasterStore(spark, str(tmp_path), (8, 6))
    engine = RasterEngine(cloud(spark), (8, 6), "orthographic", store=store)
    made = engine.generate(["range", "log_range"])
    assert set(store.rasters) == {"range", "log_range"} and np.allclose(np.log10(array_of(made["range"])), array_of(made["log_range"]))
    engine.close()


def test_points_follow_a_stream(spark, tmp_path):
    from gridloom.streaming.refresh import follow_points

    inbox = str(tmp_path / "in")
    store = RasterStore(spark, str(tmp_path / "store"), (4, 4))
    first, second, third = cloud(spark, 20, 1, "a"), cloud(spark, 20, 2, "b"), cloud(spark, 20, 3, "a").selectExpr("tile_id", "point_id + 100 AS point_id", "x", "y", "z")
    first.unionByName(second).coalesce(1).write.parquet(inbox)
    schema = first.schema

    def drain():
        stream = spark.readStream.schema(schema).parquet(inbox)
        follow_points(stream, str(tmp_path / "points"), store, ["range"], (4, 4), str(tmp_path / "check"), "orthographic").awaitTermination(90)

    drain()
    before = store.get("range").df.where("tile_id = 'b'").collect()
    third.coalesce(1).write.mode("append").parquet(inbox)
    drain()
    after = store.get("range").df
    engine = RasterEngine(first.unionByName(third), (4, 4), "orthographic")
    whole = engine.generate(["range"])["range"]
    got = Raster(after.where("tile_id = 'a'"), Resolution(4, 4))
    assert np.allclose(array_of(got), array_of(whole)) and sorted(map(tuple, after.where("tile_id = 'b'").collect())) == sorted(map(tuple, before))
    engine.close()


def test_point_table(spark):
    df = spark.createDataFrame([(1, 1.0, float("nan"), 2.0, "x")], "i int, a double, b double, c double, t string")
    row = point_table(df, "a", "b", "c", point_id="i", tile_id="t", fields={"f": "c"}).first()
    assert tuple(row) == ("x", 1, 1.0, None, 2.0, 2.0) and point_table(df, "a", "b", "c", point_id="i").first()["tile_id"] == "0"


def test_catalogue_has_twins():
    queries, sql = catalog.queries(), catalog.oracle_sql()
    assert set(sql) <= set(queries) and set(queries) - set(sql) == {"cubic_range"}


def test_smoke_of_a_culled_scan(spark):
    """A made-up scan: most of the picture is covered, within the ranges that went in."""
    r = np.random.default_rng(42)
    h, v = r.uniform(-0.30, 0.30, 2000), r.uniform(1.20, 1.80, 2000)
    far = 10 + 0.5 * np.sin(4 * h) + 0.3 * r.standard_normal(2000)
    xyz = np.column_stack([far * np.sin(v) * np.cos(h), far * np.sin(v) * np.sin(h), far * np.cos(v)])
    points = spark.createDataFrame([("t", i, *map(float, p)) for i, p in enumerate(xyz)], "tile_id string, point_id bigint, x double, y double, z double")
    engine = RasterEngine(points, (100, 130), "spherical", Delaunay())
    got = array_of(engine.generate(["range"])["range"])
    engine.close()
    assert np.isfinite(got).mean() > 0.9 and far.min() - 1e-9 <= np.nanmin(got) and np.nanmax(got) <= far.max() + 1e-9


def test_the_rest_works_without_the_training_data_subpackage(tmp_path):
    code = (
        "import sys; sys.modules['gridloom.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e\n"
        "assert 'hillshade' in e.queries() and not any(q.startswith('op') for q in e.queries()) and 'pipeline' not in e.queries()"
    )
    root = str(importlib.import_module("pathlib").Path(catalog.__file__).parents[2])
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True).returncode == 0
