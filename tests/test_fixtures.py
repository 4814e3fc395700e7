"""Worked examples with known results."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from acrework.functions import scalars as S
from acrework.operators import aggregates, audits, domain, geometry, graph, joins, lots, rules, temporal, text, windows
from acrework.sources import tables


def values(df, *columns):
    return [tuple(r) if len(columns) != 1 else r[0] for r in df.select(*columns).collect()]


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_value_per_area_and_concentration(spark):
    df = spark.createDataFrame([(1, 100.0, 20.0), (2, 100.0, 80.0), (3, 0.0, 100.0), (4, None, 100.0)], "id int, v double, a double")
    out = domain.value_per_area(df, "v", "a", [0, 2], ["low", "high"]).orderBy("id")
    assert values(out, "recorded") == [True, True, False, False]
    shares = windows.concentration(df.filter("v > 0"), "v", "a", "id").orderBy("base_share")
    assert values(shares, "base_share", "amount_share") == [(0.2, 0.5), (1.0, 1.0)]


def test_district_profile_of_selection_or_all(spark):
    rows = [("a", 10.0, 1.0, 4.0, 100.0), ("b", 30.0, None, 4.0, 200.0), ("b", 0.0, 2.0, 2.0, 900.0), (None, 5.0, 1.0, 0.0, None), ("c", None, 0.0, 0.0, 7.0)]
    df = spark.createDataFrame(rows, "k string, w double, top double, bottom double, v double")

    def profile(*keys):
        chosen = spark.createDataFrame([(k,) for k in keys], "k string")
        return values(aggregates.district_profile(df, chosen, "k", ["w"], {"pct": ("top", "bottom")}, ["v"], "w"), "n", "w", "pct", "v")

    assert profile("a", "b", "b", None) == [(3, 40.0, 30.0, 175.0)]
    assert profile("c") == [(1, 0.0, None, None)]
    assert profile() == profile("unknown", None) == [(5, 45.0, 40.0, 175.0)]


def test_area_screen(spark):
    df = spark.createDataFrame([("R2", 4949.0), ("R2", 4950.0), ("R2", None), ("B4", 1000.0)], "d string, a double")
    out = df.select(*(c.alias(n) for n, c in rules.screen(F.col("d") == "R2", [(F.col("a"), 5000)]).items()))
    assert values(out, "below") == [True, False, False, False]
    assert values(out, "evaluated") == [True, True, False, False]


def test_public_owner_names(spark):
    df = spark.createDataFrame([("CITY OF X  PARKS", None), (None, "City of X-P & R"), ("PARK FARM", None)], "a string, b string")
    assert values(df.select(text.name_variant(["CITY OF X"], F.col("a"), F.col("b")).alias("p")), "p") == [True, True, False]


def test_maximum_coverage(spark):
    rows = [("single_family", a) for a in (4000, 3900, 3000, 2000)] + [("two_family", a) for a in (4300, 4000, 3500, 3300, 3000)] + [("other", 4000)]
    df = spark.createDataFrame(rows, "k string, a int")
    assert values(df.select(rules.maximum_coverage(F.col("k"), F.col("a")).alias("c")), "c") == [35, 36, 45, 45, 35, 38, 43, 45, 45, None]


def test_setback_envelopes(spark):
    turn = lambda pts, c, q: [(7 + c * x - q * y, -3 + q * x + c * y) for x, y in pts]
    box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    rows = []
    for c, q in ((1.0, 0.0), (0.6, 0.8), (-0.8, 0.6)):
        for lot, building in ((box(0, 0, 30, 100), box(4, 20, 20, 70)), (box(0, 0, 30, 100), box(0, 20, 16, 70)), (box(0, 0, 30, 45), box(5, 5, 15, 15)), ([(0, 0), (30, 0), (0, 100), (0, 0)], box(4, 20, 20, 70)), (box(0, 0, 30, 100), None)):
            lot, front = turn(lot, c, q), turn([(0, 0), (30, 0)], c, q)
            rows.append((lot[::-1], building and turn(building, c, q), *front[1], *front[0]))
    rows += [(None, None, 0.0, 0.0, 1.0, 0.0), (rows[0][0], None, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, f"ring {geometry.RING}, building {geometry.RING}, x1 double, y1 double, x2 double, y2 double")
    got = [tuple(None if v is None else round(v, 6) for v in r) for r in values(lots.setback_envelopes(df, "ring", "building"), "width", "depth", "rectangularity", "available", "outside")]
    each = [(30, 100, 1, 800, 0), (30, 100, 1, 800, 200), (30, 45, 1, 0, 100), (30, 100, 0.5, None, None), (30, 100, 1, 800, None)]
    assert got == each * 3 + [(None,) * 5] * 2


def test_ring_distance_and_blocks(spark):
    square = lambda x, y, s=10.0: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
    ell = [(0.0, 30.0), (40.0, 30.0), (40.0, 34.0), (4.0, 34.0), (4.0, 70.0), (0.0, 70.0), (0.0, 30.0)]
    rings = {1: square(0.0, 0.0), 2: square(11.0, 11.0), 3: square(22.0, 11.0), 4: square(34.0, 11.0), 5: ell, 6: square(20.0, 50.0), 7: square(21.0, 51.0, 2.0), 8: square(5.3, 35.0, 3.0)}
    df = spark.createDataFrame(list(rings.items()), f"k int, ring {geometry.RING}")
    pairs = df.crossJoin(df.select(F.col("k").alias("j"), F.col("ring").alias("other"))).filter("k < j")
    apart = {(r["k"], r["j"]): round(r["d"], 6) for r in pairs.select("k", "j", geometry.ring_distance(F.col("ring"), F.col("other")).alias("d")).collect()}
    assert apart[1, 2] == round(2**0.5, 6) and apart[2, 3] == 1 and apart[3, 4] == 2 and apart[6, 7] == 0 and apart[5, 8] == 1 and apart[5, 6] == 16 and apart[1, 5] == 20
    blocks = geometry.contiguous_blocks(df, "k", "ring", 0.75, 15.0).orderBy("block")
    assert values(blocks, "block", "parts", "area") == [(1, 3, 300.0), (4, 1, 100.0), (5, 2, 160.0 + 144.0 + 9.0), (6, 2, 104.0)]
    table = geometry.size_table(blocks.withColumn("m", F.col("x") < 20), "area", "parts", "m", [100, 200, 500]).orderBy("least")
    assert values(table, "least", "blocks", "members", "median_parts") == [(100.0, 4, 2, 2.0), (200.0, 2, 2, 2.5), (500.0, 0, 0, 0.0)]


def test_instants(spark):
    assert spark.range(1).select(temporal.instants("2024-05-01 12:00:00", "2024-05-01 13:00:00", 5)).count() == 13


def test_common_box(spark):
    boxes = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0), (0.0, 0.0, 10.0, 10.0), (50.0, 50.0, 60.0, 60.0)], "xmin double, ymin double, xmax double, ymax double")
    polygons = boxes.select(geometry.rectangle(*map(F.col, geometry.BOX)).alias("ring"))
    cells = geometry.grid(spark, 0, 0, 60, 60, 10)
    assert values(geometry.majority_cells(cells, polygons, "ring", 3, 20).join(cells, "cell_id"), "x", "y") == [(5.0, 5.0)]


def test_first_recorded_category(spark):
    cases = spark.createDataFrame([(1, "x|parking_layout"), (2, "x"), (3, "")], "k int, l string")
    listed = spark.createDataFrame([(1, "parking_layout"), (2, "b"), (2, "a")], "k int, c string")
    out = windows.first_recorded(cases, listed, "k", "l", "c", {"b": 1, "a": 2}, {"parking_layout": "parking"}).orderBy("k")
    assert values(out, "primary", "parent") == [("parking_layout", "parking"), ("b", "b"), ("unspecified", "unspecified")]


def test_tax_scenarios(spark):
    parcel = spark.createDataFrame([(1,)], "k int")
    years = domain.tax_scenarios(parcel, "k", F.lit(1000.0), F.lit(2000.0), 2.0)
    first = years.filter("year = 0").first()
    assert years.count() == 21 and (first["conventional"], first["land_only"]) == (6000, 2000)
    assert 0 < domain.present_values(years, "k", 0.04).first()["reduction"] < 1


def test_parking_land(spark):
    assert one(spark, F.lit(1 * 43_560 / 43_560.0), F.bround(F.lit(1075) * 300 / F.lit(43_560.0), 3), F.bround(F.lit(1075) * 350 / F.lit(43_560.0), 3)) == (1, 7.404, 8.638)


def test_distinct_under_predicate(spark):
    df = spark.createDataFrame([(1, 999), (2, 999), (1, 999), (3, 1001)], "site int, d int")
    assert df.agg(aggregates.distinct_where("site", F.col("d") <= 1000)).first()[0] == 2


def test_votes_and_whole_counts(spark):
    df = spark.createDataFrame([(9,), (8,), (7,)], "n int")
    assert values(df.select(rules.least_count(F.col("n"), 1, 2, True).alias("a"), rules.least_count(F.col("n"), 2, 3, False).alias("b")), "a", "b") == [(5, 6), (5, 6), (4, 5)]


def test_finality_on_the_third_open_day(spark):
    friday = F.lit(datetime.datetime(2024, 5, 3, 11))
    assert one(spark, temporal.finality(friday, F.lit(False)), temporal.finality(friday, F.lit(True))) == (datetime.datetime(2024, 5, 8, 16), datetime.datetime(2024, 5, 3, 11))


def test_lapse_and_capped_extension(spark):
    start, later = F.lit(datetime.date(2024, 1, 1)), lambda m: F.add_months(F.lit(datetime.date(2024, 1, 1)), m)
    none = F.lit(None).cast("int")
    got = one(spark, *(temporal.lapsed(start, p, 6, e) for p, e in ((later(6), none), (later(7), none), (later(18), F.lit(18)), (later(7), F.lit(19)))))
    assert got == (False, True, False, True)


@pytest.mark.parametrize("sites, waived, barred", [([(1, 999)], False, False), ([(1, 999), (2, 1000)], False, True), ([(1, 999), (2, 1000)], True, False), ([(1, 999), (2, 1001)], False, False), ([(1, 999), (1, 999)], False, False)])
def test_spacing_bar(spark, sites, waived, barred):
    near = spark.createDataFrame([(7, *s) for s in sites], "k int, site int, d int")
    waivers = spark.createDataFrame([(7,)] if waived else [], "k int")
    assert rules.spacing_bar(near, "k", "site", "d", 1000, waivers).first()["barred"] is barred


def test_waiver_findings(spark):
    cases = [(True, True, False), (True, True, True), (True, False, True), (True, False, False), (False, True, True)]
    got = one(spark, *(rules.waiver_finding(*map(F.lit, c)) for c in cases))
    assert got == ("ambiguous", "eligible", "ambiguous", "none", "denied")


def test_elapsed_and_missing_facts(spark):
    start = F.lit(datetime.date(2024, 1, 1))
    assert one(spark, *(temporal.elapsed_at_least(start, F.date_add(start, d)) for d in (14, 15, 16))) == (False, True, True)
    none = F.lit(None).cast("boolean")
    assert one(spark, rules.missing_fact(none, F.lit(True)), rules.missing_fact(none, F.lit(False))) == ("false", "unknown")


def test_precedence_is_transitive_and_cycles_are_found(spark):
    order = spark.createDataFrame([("notwithstanding", "exception"), ("exception", "default")], "src string, dst string")
    held = spark.createDataFrame([(1, "notwithstanding"), (1, "default")], "s int, r string")
    out = {r["r"]: r["displaced_by"] for r in graph.in_force(held, order, "s", "r").collect()}
    assert out == {"notwithstanding": None, "default": "notwithstanding"}
    cyclic = order.union(spark.createDataFrame([("default", "notwithstanding")], "src string, dst string"))
    assert graph.cycle_nodes(cyclic).count() == 3 and graph.cycle_nodes(order).count() == 0


def test_components_of_a_long_chain_and_of_no_edges(spark):
    from acrework.operators.components import connected_components

    chain = spark.range(1, 60).select((F.col("id") - 1).alias("src"), F.col("id").alias("dst")).union(spark.createDataFrame([(100, 100), (None, 5)], "src bigint, dst bigint"))
    got = {r["node"]: r["component"] for r in connected_components(chain).collect()}
    assert got == {**{i: 0 for i in range(60)}, 100: 100}
    assert connected_components(chain.limit(0)).count() == 0


def test_refusals(spark):
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError):
        audits.assert_unique(twice, "k")
    with pytest.raises(ValueError):
        joins.one_to_one(twice, twice, "k")
    with pytest.raises(ValueError):
        audits.assert_single_value(twice, "k", "v")
    with pytest.raises(ValueError):
        tables.merge_slices([twice.limit(1), twice.limit(1)], "k")
    with pytest.raises(ValueError):
        geometry.require_one_srid(spark.createDataFrame([(1,), (2,)], "srid int"))
    with pytest.raises(ValueError):
        S.resolve(twice, ["absent"])
    assert S.resolve(twice, ["absent"], mandatory=False) is None


def test_kernels():
    line = np.array([[0, 0], [1, 0.01], [2, 0], [3, 2], [4, 4]], float)
    assert geometry.simplify_line(line, 0.1).tolist() == [[0, 0], [2, 0], [4, 4]]
    assert geometry.hull_area(np.array([[0, 0], [4, 0], [4, 4], [0, 4], [2, 2], [1, 0]])) == 16


def test_minutes_with_either_petitioner_label(spark):
    minutes = "Roll\nCASE NO: 10-20\nBZA PETITIONER: A\nLOCATION: 1 Elm\nAffirmative: X, Y\nNegative: Z\nGRANTED\nCASE NO: 11-20\nAPPLICANT: B\nPROPOSAL: a shed\nDENIED, then GRANTED\n"
    got = values(text.minutes_cases(spark.createDataFrame([(1, minutes)], "d int, t string"), "d", "t").orderBy("pos"), "case_number", "petitioner", "location", "votes_for", "votes_against", "decision")
    assert got == [("10-20", "A", "1 Elm", 2, 1, "GRANTED"), ("11-20", "B", None, 0, 0, "GRANTED")]


def test_tokens_names_and_phrases(spark):
    docs = spark.createDataFrame([(1, "The Elm Road lot, if open, shall be 1,500 feet within 3 days. See § 50-1-2!")], "d int, t string")
    rows = text.tokens(docs, "d", "t").cache()
    raw = docs.first()["t"].encode()
    for r in rows.collect():
        assert raw[r["start"] : r["end"]].decode() == r["token"]
    kinds = {r["token"]: r["kind"] for r in rows.collect()}
    assert (kinds["1,500"], kinds["§ 50-1-2"], kinds["!"]) == ("number", "citation", "punctuation")
    assert values(text.proper_name_runs(rows, "d"), "name", "words") == [("The Elm Road", 3)]
    assert values(text.phrases_around(rows, "d", ["shall"]), "sentence", "subject", "predicate") == [(0, "", "be 1,500 feet within 3 days")]
    assert values(text.neighbourhood(rows, "d", ["within"]).orderBy("pos"), "token", "unit") == [("1,500", "feet"), ("3", "days")]


def test_shared_members_and_categories(spark):
    rows = [("a", 1, 10, 7), ("a", 2, 10, None), ("a", 3, 11, 7), ("a", 4, 12, 8), ("b", 1, 10, None), ("b", 5, 99, 8), ("b", 6, 99, None)]
    df = spark.createDataFrame(rows, "cat string, item int, p int, s int")
    got = {(r["cat"], r["item"]): r["label"] for r in graph.category_components(df, "cat", "item", ["p", "s"]).collect()}
    assert got == {("a", 1): 1, ("a", 2): 1, ("a", 3): 1, ("a", 4): 4, ("b", 1): 1, ("b", 5): 5, ("b", 6): 5}
    shared = {r["item"]: (r["component"], r["size"], r["linking"]) for r in graph.shared_member_components(df, "item", "p").collect()}
    assert shared == {1: (1, 2, 1), 2: (1, 2, 1), 5: (5, 2, 1), 6: (5, 2, 1)}


def test_shapes_of_very_different_sizes(spark):
    """Pairs and points of boxes from a hundredth of a cell to a hundred thousand cells, against all comparisons."""
    rng = np.random.default_rng(3)
    made = [(i, *rng.uniform(-2000, 2000, 2).tolist(), float(10.0 ** rng.uniform(-1, 4.5)), float(10.0 ** rng.uniform(-1, 4.5))) for i in range(70)]
    made += [(70, 0.0, 0.0, 1e6, 1e6), (71, 5.0, 5.0, 0.0, 0.0)]
    shapes = spark.createDataFrame([(i, x, y, x + w, y + h) for i, x, y, w, h in made], "k int, xmin double, ymin double, xmax double, ymax double")
    touch = lambda a, b: a[1] <= b[1] + b[3] and b[1] <= a[1] + a[3] and a[2] <= b[2] + b[4] and b[2] <= a[2] + a[4]
    got = sorted(values(geometry.box_pairs(shapes, shapes, 10.0), "k", "r_k"))
    assert got == sorted((a[0], b[0]) for a in made for b in made if touch(a, b))
    spots = [(i, *rng.uniform(-3000, 3000, 2).tolist()) for i in range(60)] + [(60, None, 1.0), (61, 3.0, None), (62, -9e6, 0.0), (62, -9e6, 0.0), (63, 5e5, 5e5), (63, 5e5, 5e5)]
    points = spark.createDataFrame(spots, "id int, x double, y double")
    polygons = shapes.select("k", geometry.rectangle(*map(F.col, geometry.BOX)).alias("ring"))
    expected = []
    for i, x, y in spots:
        inside = [k for k, a, b, w, h in made if x is not None and y is not None and a <= x < a + w and b <= y < b + h]
        expected += [(i, k) for k in inside] or [(i, -1)]
    found = geometry.points_within(points, "x", "y", polygons, "ring", 10.0).select("id", F.coalesce("r_k", F.lit(-1)).alias("k"))
    assert sorted(values(found, "id", "k")) == sorted(expected)


def test_span_states_and_ledger(spark):
    df = spark.createDataFrame([("0123456789é", "0123456789é"), ("0123456789é", "0123x56789é"), ("0123456789é", "012"), ("é" * 5, "é" * 5), (None, "a"), ("0123456789é", None)], "text string, later string")
    cited = text.span_citation(df, "text", F.lit(3), F.lit(8))
    states = cited.select(text.span_state("later", F.lit(3), F.lit(8), F.col("quote_sha256")).alias("s"))
    assert values(states, "s") == ["verified", "changed", "occluded", "invalid", "invalid", "occluded"]
    ledger = spark.createDataFrame([(1, "a", "x", "n"), (1, "a", "x", "n"), (2, "b", "y", "n"), (3, "c", "x", None)], "id int, section string, d string, note string")
    manifest = spark.createDataFrame([("a", "0" * 64), ("b", "A" * 64), ("z", "1" * 64)], "section string, digest string")
    faults = rules.ledger_faults(ledger, manifest, "id", "section", "d", ["x"], ["note"], ["id", "section", "d"])
    assert sorted((a or "", f) for a, f in values(faults, "at", "fault")) == sorted([("", "columns"), ("1", "repeated"), ("1", "repeated"), ("2", "disposition"), ("3", "note"), ("z", "uncovered"), ("c", "unlisted"), ("b", "digest")])


def test_compound_cells(spark):
    df = spark.createDataFrame([("4 ft. minimum / 14 ft. combined",), ("1,200 or 30",), ("35 ft",), ("see 50-13",), (None,)], "cell string")
    found = values(text.dimensional_rules(df, "cell"), "kind", "rule", "amount")
    assert found == [("compound", "individual", 4.0), ("compound", "combined", 14.0), ("compound", "first", 1200.0), ("compound", "second", 30.0), ("number", "single", 35.0), ("cross reference", None, None), ("blank", None, None)]
