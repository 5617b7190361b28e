import pytest
from pyspark.sql import functions as F

from skuforge.functions import scalars as S
from skuforge.functions import units as U
from skuforge.operators import mining


def value(spark, text, expression):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,want,absent",
    [
        ("12x1/8 Metal Cut-Off Wheel", {"diameter": 12, "thickness": 0.125}, ("width",)),
        ('1/2"x18" Sanding Belt', {"width": 0.5, "length": 18}, ("diameter",)),
        ('5"x.045"x7/8" Cut-Off Wheel', {"diameter": 5, "thickness": 0.045, "bore": 0.875}, ()),
        ('HIOLIT 5" P80 for sanders', {"diameter": 5}, ("width",)),
        ("1x6x16 decking board", {"width": 6}, ()),
        ("Decking 1x6-16' grooved", {"thickness": 1, "width": 6, "length_ft": 16}, ()),
        ("5/4x6 decking", {"width": 1.25, "length": 6}, ()),
        ("2-3/4\" x 10' strip", {"width": 2.75, "length": 120}, ()),
    ],
)
def test_dimensions(spark, text, want, absent):
    got = value(spark, text, mining.dimensions)
    assert {k: pytest.approx(v) for k, v in want.items()}.items() <= {k: got.get(k) for k in want}.items() and not set(absent) & set(got)


def test_miners_settle_by_stage_and_bounds(spark):
    rows = [(1, "3M 775L Film P150 50 disc/box CE ul listed"), (2, "27k LED 60w A19 lamp, max 75W, IP65"), (3, "short"), (4, None), (5, "P9999999 nothing else here at all")]
    got = {}
    for r in mining.mine(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect():
        got.setdefault(r.id, {})[r.key] = r.value
    assert got[1]["grit"] == "150" and got[1]["pack_quantity"] == "50" and got[1]["selling_uom"] == "box" and got[1]["certifications"] == "CE, UL"
    assert got[2]["color_temperature"] == "2700" and got[2]["max_wattage"] == "75" and got[2]["ip_rating"] == "IP65" and got[2]["lamp_base"] == "E26"
    assert 3 not in got and 4 not in got and "grit" not in got.get(5, {})


@pytest.mark.parametrize("text,want", [("2-3/4 in", "2.75 in"), ("1/2 in", "0.5 in"), ("3/0 x", "3/0 x"), ("5 mm", "5 mm"), ("1 1/2", "1.5")])
def test_fractions(spark, text, want):
    assert value(spark, text, U.expand_fraction) == want


@pytest.mark.parametrize("text,want", [("-20 to 60 C", (-20, 60, 20, "c")), ("-10..+70°C", (-10, 70, 30, "°c")), ("12 sqft", (12, 12, 12, "sqft")), ("none", (None, None, None, ""))])
def test_quantities_keep_signs(spark, text, want):
    q = value(spark, text, U.parse_quantity)
    assert (q.low, q.high, q.value, q.unit) == want


def test_unit_round_trip(spark):
    rows = [(f, u, 7.0) for f, u, _, _, _ in U.factors()]
    got = U.convert(spark.createDataFrame(rows, "family string, unit string, value double")).collect()
    back = {(f, u): (s, k) for f, u, s, k, _ in U.factors()}
    assert len(got) == len(rows) and all(r.known for r in got)
    for r in got:
        s, k = back[r.family, r.unit]
        assert abs(r.converted - (7.0 + s) * k) <= 1e-4


def test_lists_enums_booleans_and_pages(spark):
    assert value(spark, "Red; red, Blue and green / BLUE", S.to_list) == ["Red", "Blue", "green"]
    enum = lambda c: S.to_enum(c, ["Single Phase", "Three Phase"], {"1": "Single Phase", "3": "Three Phase"})
    assert value(spark, "three phase 415", enum) == "Three Phase" and value(spark, "415", enum) is None
    assert value(spark, "flame retardant", S.to_boolean) is True and value(spark, "maybe", S.to_boolean) is None
    html = "<html><head><style>x</style></head><body><nav>n</nav><table><tr><th>A</th><td>b <b>c</b></td></tr></table><!-- z --><p>Text</p></body></html>"
    assert value(spark, html, S.html_text) == "A b c Text" and value(spark, html, S.html_table_rows) == ["A | b c"]
