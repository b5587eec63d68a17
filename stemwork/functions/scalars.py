"""Column expressions: rates that may have nothing below the line, gates, windows, classes, allometry, maps."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, functions as F

# Fixed values.
CLASSES = ("dominant", "codominant", "intermediate", "suppressed")
BANDS = ("short", "mid", "tall")
RUNGS = ("native", "8", "4", "2", "1")
CHM_ARMS = ("chm_vwf", "multichm")
FAMILIES = {
    "chm_vwf": "chm", "lmfauto": "chm", "multichm": "chm", "ptrees": "pc", "ams3d": "pc", "li2012": "pc", "lidr_li2012": "pc", "lidr_lmf_pc": "pc", "lasr_lmax_pc": "pc",
    "treeisonet": "deep", "segmentanytree": "deep", "forestformer3d": "deep", "deepforest": "rgb", "detectree2": "rgb",
}
CONIFER_GENERA = ("PI", "AB", "CA", "PS", "SE", "TS", "JU", "CU")
BROADLEAF_TAXA = ("CANO9", "CASP8")
BIOMASS = {"conifer": (-2.5356, 2.4349), "broadleaf": (-2.4800, 2.4835)}
TOWER_HALF, OTHER_HALF = 20.0, 10.0
FNV_BASIS, FNV_PRIME = 2166136261.0, 16777619.0
# End of fixed values.


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rate(part, whole) -> Column:
    """part / whole as double; NULL where whole is 0 or either is NULL."""
    return F.try_divide(_c(part).cast("double"), _c(whole).cast("double"))


def f1(recall, precision) -> Column:
    """Harmonic mean; NULL where either is NULL or both are 0."""
    r, p = _c(recall), _c(precision)
    return F.when(r + p > 0, 2 * r * p / (r + p))


def half_even(x) -> Column:
    """Nearest integer as long, halves to the even one."""
    return F.bround(_c(x), 0).cast("long")


def total(x) -> Column:
    """Sum in which nothing counts as 0."""
    return F.coalesce(F.sum(_c(x)), F.lit(0))


def finite(x) -> Column:
    """False for NULL, NaN and infinities."""
    v = _c(x).cast("double")
    return F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))


def rung_order(rung) -> Column:
    """Place of a density level, unknown ones last."""
    at = F.array_position(F.array(*map(F.lit, RUNGS)), _c(rung))
    return F.when(at > 0, at).otherwise(len(RUNGS) + 1).cast("int")


def normal_rung(rung) -> Column:
    """NULL and empty levels are native."""
    r = _c(rung).cast("string")
    return F.when(r.isNull() | (r == ""), "native").otherwise(r)


def height_band(h) -> Column:
    """short up to 8, mid up to 15, tall above; edges belong to the lower band."""
    return F.when(_c(h) <= 8, "short").when(_c(h) <= 15, "mid").when(_c(h) > 15, "tall")


def height_gate(stem_z, det_z, up: float = 8.0) -> Column:
    """Detection heights that a stem allows: [half its height, its height + up]; any, if it has none."""
    a, b = _c(stem_z), _c(det_z)
    return a.isNull() | ((b >= 0.5 * a) & (b <= a + up))


def match_tolerance(crown_diameter, position_error, base: float = 4.0, k: float = 1.0, cap: float = float("inf")) -> Column:
    """min(cap, max(base, k * radius, position error)); terms that are NULL, not finite or not above 0 drop out."""
    term = lambda x: F.when(finite(x) & (x > 0), x).otherwise(F.lit(0.0))
    return F.least(F.lit(cap), F.greatest(F.lit(base), term(k * _c(crown_diameter) / 2), term(_c(position_error))))


def window_size(height, slope: float, low: float, high: float) -> Column:
    """Variable search window slope * height + low, held between low and high."""
    return F.least(F.greatest(slope * _c(height) + low, F.lit(low)), F.lit(high))


def half_extent(plot_type) -> Column:
    return F.when(_c(plot_type) == "tower", TOWER_HALF).otherwise(OTHER_HALF)


def in_box(x, y, cx, cy, half) -> Column:
    return (F.abs(_c(x) - _c(cx)) <= _c(half)) & (F.abs(_c(y) - _c(cy)) <= _c(half))


def in_circle(x, y, cx, cy, r) -> Column:
    return squared(_c(x), _c(y), _c(cx), _c(cy)) <= _c(r) * _c(r)


def squared(ax, ay, bx, by) -> Column:
    """Squared distance in the plane."""
    dx, dy = _c(ax) - _c(bx), _c(ay) - _c(by)
    return dx * dx + dy * dy


def resolution(density) -> Column:
    """Raster cell by point density: 0.25 from 8 points a square metre on, else 0.5."""
    return F.when(_c(density) >= 8, 0.25).otherwise(0.5)


def area_resolution(density) -> Column:
    """0.25 from 8, 0.5 from 4, else 1.0; NULL below 1 point a square metre."""
    d = _c(density)
    return F.when(d >= 8, 0.25).when(d >= 4, 0.5).when(d >= 1, 1.0)


def window_floor(density) -> Column:
    """max(2, 2.5 / sqrt(density) to one decimal)."""
    return F.greatest(F.lit(2.0), F.bround(2.5 / F.sqrt(_c(density)), 1))


def canopy_class(position) -> Column:
    """Crown class of a canopy position in words."""
    p = F.lower(_c(position))
    return (
        F.when(p.contains("open") | p.contains("full sun"), "dominant").when(p.contains("partially"), "codominant").when(p.contains("mostly"), "intermediate").when(p.contains("full shade"), "suppressed")
    )


def functional_type(taxon) -> Column:
    """conifer or broadleaf by the first two letters of a taxon code; NULL for none."""
    t = _c(taxon)
    return F.when(t.isNull() | (t == ""), None).when(t.isin(*BROADLEAF_TAXA), "broadleaf").when(F.upper(F.substring(t, 1, 2)).isin(*CONIFER_GENERA), "conifer").otherwise("broadleaf")


def biomass(dbh, kind) -> Column:
    """exp(b0 + b1 * ln(dbh)) in kg by functional type; NULL without a positive diameter or a known type."""
    out = F.lit(None).cast("double")
    for name, (b0, b1) in BIOMASS.items():
        out = F.when((_c(kind) == name) & (_c(dbh) > 0), F.exp(b0 + b1 * F.ln(_c(dbh)))).otherwise(out)
    return out


def family(arm) -> Column:
    """Modality family of a detector; NULL if unknown."""
    out = F.lit(None).cast("string")
    for name, kind in FAMILIES.items():
        out = F.when(_c(arm) == name, kind).otherwise(out)
    return out


def polar(x, y, distance, azimuth) -> tuple[Column, Column]:
    """Position at a distance and an azimuth in degrees (clockwise from north) from x, y."""
    a = F.radians(_c(azimuth))
    return _c(x) + _c(distance) * F.sin(a), _c(y) + _c(distance) * F.cos(a)


def tile_name(x, y, side: int = 1000) -> Column:
    corner = lambda v: (F.floor(_c(v) / side) * side).cast("long")
    return F.format_string("%d_%d", corner(x), corner(y))


def utm_epsg(zone) -> Column:
    """EPSG code of a UTM zone such as 11N; NULL where it is none."""
    n = F.regexp_extract(_c(zone), r"^(\d{1,2})\s*([NSns])$", 1).try_cast("int")
    south = F.upper(F.regexp_extract(_c(zone), r"^(\d{1,2})\s*([NSns])$", 2)) == "S"
    return F.when(n.between(1, 60), F.when(south, 32700).otherwise(32600) + n)


def utm_to_wgs84(easting, northing, zone, south=None) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of a UTM position, by Krueger's series to the third order."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    base = 0.0 if south is None else F.when(_c(south), 10_000_000.0).otherwise(0.0)
    xi, eta = (_c(northing) - base) / (k0 * radius), (_c(easting) - 500_000.0) / (k0 * radius)
    xi1 = xi - sum(b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(beta, 1))
    eta1 = eta - sum(b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(beta, 1))
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi + sum(d * F.sin(2 * j * chi) for j, d in enumerate(delta, 1))
    lon = F.atan2(F.sinh(eta1), F.cos(xi1)) + F.radians(_c(zone) * 6 - 183)
    return F.degrees(lon), F.degrees(lat)


def reasons(*tests: tuple[Column, str]) -> Column:
    """Names of the tests that hold, joined by semicolons; empty if none does."""
    return F.concat_ws(";", *[F.when(test, name) for test, name in tests])


def unit(*of) -> Column:
    """A number in [0, 1) from the MD5 of the parts joined by bars: 48 bits, equal in every engine that has MD5."""
    text = F.concat_ws("|", *[_c(x).cast("string") for x in of])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def gaussian(*of) -> Column:
    """A standard normal number of the parts, by Box and Muller's rule on two hashes."""
    u, v = unit(*of, F.lit("u")), unit(*of, F.lit("v"))
    return F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * pi * v)


def key_hash(*of) -> Column:
    """31-bit seed of a key, from its MD5 (own hash: it does not repeat any other package's seeds)."""
    return F.floor(unit(*of) * (1 << 31)).cast("long")


def seed_for(*of) -> Column:
    """31-bit seed of a key, its parts joined by bars, by the FNV-1a hash of its characters' low 7 bits in doubles.

    Products beyond 2^53 are rounded as doubles are, which is part of the definition. NULL parts are native.
    """
    text = F.concat_ws("|", *[F.coalesce(_c(x).cast("string"), F.lit("native")) for x in of])
    low = lambda h: F.pmod(h, F.lit(128.0)).cast("int")
    step = lambda h, c: F.pmod((h - low(h) + low(h).bitwiseXOR(F.ascii(c))) * FNV_PRIME, F.lit(2.0**32))
    return F.pmod(F.aggregate(F.split(text, ""), F.lit(FNV_BASIS), step), F.lit(2.0**31)).cast("long")
