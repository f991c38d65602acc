"""Band indices, masks, colour spaces and rule classes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scene classes that are no clear surface; months of the seasons.
SCL_INVALID = [0, 1, 3, 6, 8, 9, 10, 11]
SEASONS = {"winter": [12, 1, 2], "premonsoon": [3, 4, 5], "monsoon": [6, 7, 8, 9], "postmonsoon": [10, 11]}


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0.0))


def difference_index(a: Column, b: Column) -> Column:
    """(a - b) / (a + b)."""
    return ratio(a - b, a + b)


def s2_indices(blue: Column, green: Column, red: Column, edge: Column, nir: Column, narrow: Column, swir1: Column, swir2: Column, scale: float = 10000.0) -> dict[str, Column]:
    """Optical indices of digital numbers; the three-colour sum is floored at 1e-4."""
    b, g, r, e, n, m, s, t = (c.cast("double") / scale for c in (blue, green, red, edge, nir, narrow, swir1, swir2))
    rgb = F.greatest(r + g + b, F.lit(1e-4))
    return {
        "ndvi": difference_index(n, r), "gndvi": difference_index(n, g), "ndre": difference_index(m, e), "ndmi": difference_index(n, s), "nbr": difference_index(n, t),
        "evi": ratio(2.5 * (n - r), n + 6.0 * r - 7.5 * b + 1.0), "red_ratio": r / rgb, "green_ratio": g / rgb, "blue_ratio": b / rgb, "yellow_proxy": (g + r) / rgb,
    }


def planet_indices(blue: Column, green: Column, red: Column, nir: Column) -> dict[str, Column]:
    """Four-band indices."""
    return {"ndvi": difference_index(nir, red), "gndvi": difference_index(nir, green), "ndwi": difference_index(green, nir), "evi": ratio(2.5 * (nir - red), nir + 6.0 * red - 7.5 * blue + 1.0)}


def guarded(index: Column, low: float, high: float) -> Column:
    """Null outside [low, high]."""
    return F.when(index.between(low, high), index)


def decibel(x: Column) -> Column:
    """10 log10(x), null unless x > 0."""
    return F.when(x > 0, 10.0 * F.log10(x))


def sar_features(vv: Column, vh: Column) -> dict[str, Column]:
    """Backscatter in dB, the ratio, and the difference in dB."""
    return {"vv_db": decibel(vv), "vh_db": decibel(vh), "vh_vv_ratio": ratio(vh, vv), "vh_minus_vv_db": decibel(vh) - decibel(vv)}


def clear_surface(scl: Column, *bands: Column, invalid: list[int] = SCL_INVALID) -> Column:
    """The scene class is valid and no band is null."""
    out = F.coalesce(~scl.isin(invalid), F.lit(False))
    for b in bands:
        out = out & b.isNotNull()
    return out


def fmask_clear(fmask: Column, bits: tuple[int, ...] = (1, 2, 3, 4)) -> Column:
    """None of the bits is set."""
    return fmask.cast("int").bitwiseAND(sum(1 << b for b in bits)) == 0


def rgb_indices(r: Column, g: Column, b: Column, epsilon: float = 1e-8) -> dict[str, Column]:
    """Chromatic coordinates and excess green; epsilon keeps the denominator from zero."""
    total = r + g + b + epsilon
    return {"gcc": g / total, "rcc": r / total, "exg": 2.0 * g / total - r / total - b / total}


def flower_indices(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """The variant with null on a zero sum: RCC, GCC and yellowness are shares, the excess indices are not."""
    total = F.when(r + g + b > 0, r + g + b)
    exg, exr = 2.0 * g - r - b, 1.4 * r - g
    return {"rcc": r / total, "gcc": g / total, "yi": (r + g - 2.0 * b) / total, "exg": exg, "exr": exr, "exr_exg": exr - exg}


def rgb_to_hsv(r: Column, g: Column, b: Column) -> Column:
    """struct(h, s, v) in [0, 1] of channels in [0, 1]."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    h = F.when(d == 0, 0.0).when(top == r, F.pmod((g - b) / d, F.lit(6.0))).when(top == g, (b - r) / d + 2.0).otherwise((r - g) / d + 4.0) / 6.0
    return F.struct(h.alias("h"), F.when(top == 0, 0.0).otherwise(d / top).alias("s"), top.alias("v"))


def vegetation(hsv: Column, h: tuple[float, float] = (0.18, 0.48), s: float = 0.15, v: float = 0.12) -> Column:
    """Hue in the green range, saturated and bright enough."""
    return hsv["h"].between(*h) & (hsv["s"] >= s) & (hsv["v"] >= v)


def shadow(hsv: Column, v: float = 0.12) -> Column:
    """Darker than v."""
    return hsv["v"] < v


def luminance(r: Column, g: Column, b: Column, weights: tuple[float, float, float] = (0.299, 0.587, 0.114)) -> Column:
    """B28."""
    return weights[0] * r + weights[1] * g + weights[2] * b


def bad_observation(valid: Column, shade: Column, sharpness: Column, pixels: Column, least_valid: float = 0.60, most_shade: float = 0.55, least_sharp: float = 25.0, least_pixels: int = 20) -> Column:
    """Too few pixels, or too little valid area, too much shade, or too blurred."""
    return (pixels < least_pixels) | (valid < least_valid) | (shade > most_shade) | (sharpness < least_sharp)


def season(month: Column, seasons: dict[str, list[int]] = SEASONS) -> Column:
    """Season of a month; months that no earlier season names belong to the last one."""
    *named, rest = seasons.items()
    out = F.when(month.isNull(), F.lit(None).cast("string"))
    for name, months in named:
        out = out.when(month.isin(months), name)
    return out.otherwise(rest[0])


def in_window(day: Column, year: int, months: dict[str, int] | None = None) -> Column:
    """Array of the names of a year's windows that hold the day: its season, whose winter begins in the December
    before, and its month for January to May. Windows are half open."""
    own = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5} if months is None else months
    date = F.to_date(day)
    seasonal = F.when(season_year(date) == year, season(F.month(date)))
    monthly = [F.when((F.year(date) == year) & (F.month(date) == m), F.lit(name)) for name, m in own.items()]
    return F.array_compact(F.array(seasonal, *monthly))


def season_year(day: Column) -> Column:
    """Q22: the year of a season; December counts to the next year's winter."""
    return F.year(day) + F.when(F.month(day) == 12, 1).otherwise(0)


def calendar(day: Column) -> dict[str, Column]:
    """Year, ISO year, ISO week, month."""
    return {"year": F.year(day), "iso_year": F.extract(F.lit("YEAROFWEEK"), day).cast("int"), "iso_week": F.weekofyear(day), "month": F.month(day)}


def utm_epsg(epsg: Column, tile: Column, item: Column, latitude: Column) -> Column:
    """The scene's EPSG, else 326zz or 327zz by the zone in its tile or id and the hemisphere."""
    zone = F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for c, p in ((tile, r"^(\d{1,2})"), (item, r"_T?(\d{2})[A-Z]{3}"))]).cast("int")
    return F.coalesce(epsg.cast("int"), F.when(latitude >= 0, 32600 + zone).otherwise(32700 + zone))


def stretched(x: Column, low: Column, high: Column) -> Column:
    """X between two percentiles as 0 to 255."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio(x - low, high - low))) * 255.0).cast("int")


def softmax_argmax(scores: dict[str, Column]) -> Column:
    """struct(label, confidence): the largest softmax probability; ties go to the first name."""
    top = F.greatest(*scores.values())
    total = sum((F.exp(s - top) for s in list(scores.values())[1:]), F.exp(list(scores.values())[0] - top))
    label = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, s in scores.items():
        label = label.when(s == top, name)
    return F.struct(label.alias("label"), (1.0 / total).alias("confidence"))


def linear_scores(features: dict[str, Column], weights: dict[str, dict[str, float]], penalty: Column | None = None) -> dict[str, Column]:
    """For each state the weighted sum of features (null as 0), less a penalty."""
    out = {}
    for state, w in weights.items():
        s = F.lit(0.0)
        for name, x in w.items():
            s = s + x * F.coalesce(features[name], F.lit(0.0))
        out[state] = s - penalty if penalty is not None else s
    return out


def flower_colour(rcc: Column, gcc: Column, yi: Column, exr_exg: Column, red: float = 0.38, yellow: float = 0.50, green: float = 0.38) -> Column:
    """Colour class of a cell's median indices; red is tested first, then yellow, then green."""
    unknown = rcc.isNull() | gcc.isNull()
    is_red = (rcc > red) & (gcc < 0.32) & (exr_exg > 0)
    is_yellow = (yi > 0.10) & (gcc > yellow) & (rcc > 0.28)
    return F.when(unknown, "unknown").when(is_red, "red").when(is_yellow, "yellow").when((gcc > green) & (rcc < red), "green").otherwise("mixed")


def phenophase(deciduous: Column, level: Column, on: float = 0.65, off: float = 0.35) -> Column:
    """Stable if not deciduous, else by the normalised greenness."""
    return F.when(~deciduous, "stable").when(level >= on, "leaf_on").when(level <= off, "leaf_off").otherwise("transitioning")


def non_tree(gcc_amp: Column, veg_amp: Column | None = None, gcc_mean: Column | None = None, veg_mean: Column | None = None, limits: dict[str, float] | None = None) -> Column:
    """True where all measures that have a limit are at or below it; a null measure gives false.

    limits: gcc_amp, veg_amp, gcc_mean, veg_mean. With all four, all four must hold; otherwise greenness
    amplitude, with cover amplitude where that has a limit; without a limit on greenness amplitude, false.
    """
    limits = limits or {}
    given = {"gcc_amp": gcc_amp, "veg_amp": veg_amp, "gcc_mean": gcc_mean, "veg_mean": veg_mean}
    low = {k: F.coalesce(c <= limits[k], F.lit(False)) for k, c in given.items() if c is not None and k in limits}
    if "gcc_amp" not in low:
        return F.lit(False)
    if len(low) == 4:
        return low["gcc_amp"] & low["veg_amp"] & low["gcc_mean"] & low["veg_mean"]
    return low["gcc_amp"] & low["veg_amp"] if "veg_amp" in low else low["gcc_amp"]


def literal_map(text: Column, schema: str = "map<string,double>") -> Column:
    """A dict or list that was written with single quotes, parsed."""
    return F.from_json(F.regexp_replace(F.regexp_replace(text, "'", '"'), r"\bNone\b", "null"), schema)


def change_class(difference: Column, threshold: float) -> Column:
    """Stable, increase or decrease."""
    return F.when(F.abs(difference) < threshold, "stable").when(difference >= threshold, "increase").when(difference <= -threshold, "decrease")
