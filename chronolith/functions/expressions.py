"""Column expressions. All are safe under ANSI mode, and missing values are null, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Levels from the highest down, with the amplitude from which they hold, rank, colour and advice.
LEVELS = [
    ("severe", 0.7, 3, "red", "Suspend critical GNSS-dependent operations. Switch to INS/backup."),
    ("warning", 0.4, 2, "orange", "Prepare for signal degradation. Check backup positioning."),
    ("watch", 0.3, 1, "yellow", "Monitor GNSS performance closely."),
]
#: Levels of the other two indices.
SIGMA_PHI_THRESHOLDS = {"watch": 0.10, "warning": 0.25, "severe": 0.50}
ROTI_THRESHOLDS = {"watch": 0.5, "warning": 1.0, "severe": 2.0}
#: What a level means for a sector.
SECTOR_IMPACTS = {
    "aviation": {
        "watch": "Increased positioning noise. Monitor RNP compliance.",
        "warning": "SBAS outages possible. Increase separation standards.",
        "severe": "GNSS-based approaches suspended. Use conventional aids.",
    },
    "maritime": {
        "watch": "Reduced GNSS accuracy. Cross-check with LORAN/radar.",
        "warning": "Position jumps expected. Reduce speed in confined waters.",
        "severe": "Radar-only navigation recommended.",
    },
    "agriculture": {
        "watch": "Variable tractor guidance accuracy.",
        "warning": "Precision seeding/spraying degraded. Suspend operations.",
        "severe": "All RTK operations suspended.",
    },
    "surveying": {
        "watch": "Extended observation times required.",
        "warning": "Static observations recommended. Suspend kinematic surveys.",
        "severe": "All GNSS survey operations suspended.",
    },
}
#: Physical bounds of features.
BOUNDS = {
    "s4": (0.0, 1.0),
    "sigma_phi": (0.0, 3.14159),
    "roti": (0.0, 5.0),
    "tec": (0.0, 100.0),
    "bz": (-50.0, 20.0),
    "v_sw": (200.0, 900.0),
    "n_p": (0.0, 50.0),
    "t_p": (0.0, 1e6),
    "kp": (0.0, 9.0),
    "dst": (-250.0, 50.0),
    "hp_north": (0.0, 300.0),
    "hp_south": (0.0, 300.0),
    "ne": (0.0, 1e7),
}


def micros(t: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    t = F.col(t) if isinstance(t, str) else t
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), t)


def clean(c: str | Column) -> Column:
    """NaN to null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def clip(c: Column, lo, hi) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, lo if isinstance(lo, Column) else F.lit(lo)), hi if isinstance(hi, Column) else F.lit(hi)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda x: F.sin(F.radians(x) / 2)
    a = F.pow(half(lat2 - lat1), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(half(lon2 - lon1), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def solar_hour(t: Column, lon: Column) -> Column:
    return F.pmod(F.hour(t) + F.minute(t) / 60 + lon / 15, F.lit(24.0))


def harmonics(t: Column, lon: Column, diurnal: int = 2, seasonal: int = 2) -> dict[str, Column]:
    """lt_hour, post_sunset, and sine and cosine of the first multiples of the day and the year."""
    hour, day = solar_hour(t, lon), F.dayofyear(t)
    out = {"lt_hour": hour, "post_sunset": hour.between(18, 22).cast("long")}
    for k in range(1, diurnal + 1):
        angle = 2 * F.pi() * k * hour / 24
        out |= {f"sin_hour_{k}": F.sin(angle), f"cos_hour_{k}": F.cos(angle)}
    for k in range(1, seasonal + 1):
        angle = 2 * F.pi() * k * day / 365.25
        out |= {f"sin_doy_{k}": F.sin(angle), f"cos_doy_{k}": F.cos(angle)}
    return out


#: What stands for a measurement that a table doesn't have at all.
ABSENT_BZ, ABSENT_SPEED, ABSENT_DENSITY = 0.0, 400.0, 5.0


def coupling(bz: Column | None = None, v: Column | None = None, n: Column | None = None, bt: Column | None = None) -> dict[str, Column]:
    """epsilon, newell, ey, beta_sw. A measurement that is None has its fixed value; without bt it is the size of bz. A null stays one."""
    bz, v, n = (F.lit(d) if c is None else c for c, d in ((bz, ABSENT_BZ), (v, ABSENT_SPEED), (n, ABSENT_DENSITY)))
    bt = F.abs(bz) if bt is None else bt
    angle = F.atan2(F.abs(bz), F.when(bt == 0, 1e-9).otherwise(bt))
    return {
        "epsilon": F.when(bz < 0, v * F.abs(bz)).otherwise(0.0),
        "newell": F.pow(F.abs(v), F.lit(4 / 3)) * F.pow(F.abs(bt), F.lit(2 / 3)) * F.pow(F.abs(F.sin(angle / 2)), F.lit(8 / 3)),
        "ey": -v * bz / 1000,
        "beta_sw": n * v * v,
    }


def storm_intensity(dst: Column) -> Column:
    return F.when(dst < -200, 3).when(dst < -100, 2).when(dst < -30, 1).when(dst.isNotNull(), 0).cast("long")


def level_of(s4: Column, thresholds: dict[str, float] | None = None) -> Column:
    """severe, warning, watch or quiet; a null amplitude is quiet."""
    at = thresholds or {name: least for name, least, *_ in LEVELS}
    out = F.when(F.lit(False), "")
    for name in sorted(at, key=at.get, reverse=True):
        out = out.when(s4 >= at[name], name)
    return out.otherwise("quiet")


def nested(c: Column, *keys: str, default: Column | None = None) -> Column:
    """What a map of maps holds under the keys one below the other; the default where a key is missing on the way, or null."""
    value = c
    for k in keys:
        value = F.try_element_at(value, F.lit(k))
    return value if default is None else F.coalesce(value, default)


def json_nested(text: Column, *keys: str, default: Column | None = None) -> Column:
    """As nested(), of JSON text; a string."""
    value = F.get_json_object(text, "$" + "".join(f"['{k}']" for k in keys))
    return value if default is None else F.coalesce(value, default)


#: Parts of a daily observation file's name: station, year, day of the year, kind and ending.
_FILE = r"^([A-Za-z0-9]{4})[A-Za-z0-9]*_(\d{4})(\d{3})\d{4}_(\w+?)_(\w+?)_(\w{2})\.([a-z]+)(?:\.(gz|Z))?$"


def file_tokens(path: Column) -> dict[str, Column]:
    """station (upper case), day, span, rate, kind, format, packed of a file's name, as `abcd0000_20240150000_01D_30S_MO.crx.gz`; all null for another name."""
    name = F.element_at(F.split(path, "/"), -1)
    part = lambda i: F.when(name.rlike(_FILE), F.regexp_extract(name, _FILE, i))
    # A day that its year doesn't have is none.
    day = F.date_add(F.make_date(part(2).try_cast("int"), F.lit(1), F.lit(1)), part(3).try_cast("int") - 1)
    valid = F.year(day) == part(2).try_cast("int")
    return {"station": F.upper(part(1)), "day": F.when(valid, day), "span": part(4), "rate": part(5), "kind": part(6), "format": part(7), "packed": F.nullif(part(8), F.lit(""))}
