"""Scalar functions: units, angles, rotations, tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def msec_to_sec(c: Column) -> Column:
    return c * 1e-3


def sec_to_msec(c: Column) -> Column:
    return c * 1000


def meter_to_rad(distance: Column, width: Column) -> Column:
    return F.atan2(width, distance)


def dist_at_angle_deg(distance: Column, angle: Column) -> Column:
    return distance / F.cos(F.radians(angle))


def deg_from_mid_to_meter(distance: Column, angle: Column) -> Column:
    return distance * F.tan(F.radians(angle))


#: Other names of the same function.
deg_to_meter = wid_at_angle_deg = deg_from_mid_to_meter


def flatscreen_dva(distance: Column, width: Column) -> Column:
    """The angle of a width centred before the eye, in degrees."""
    return F.degrees(F.lit(2.0) * F.atan(width / 2 / distance))


def center_dva_per_meter(distance: Column, reference_m: float = 0.01, cutoff_dva: float = 2.0) -> Column:
    """Degrees per metre at the screen's centre; null where the reference spans more than the cutoff, or the distance isn't positive."""
    angle = F.degrees(F.atan2(F.lit(reference_m), distance))
    return F.when((distance > 0) & (angle <= cutoff_dva), angle / reference_m)


def px_to_dva(px: Column, px_per_meter: float, distance_m: float) -> Column:
    return F.degrees(F.atan2(px, F.lit(distance_m * px_per_meter)))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def yaw_pitch_roll(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Degrees that turn (1, 0, 0) to a unit vector by the shortest rotation; straight back is a pitch of 180."""
    back = (x <= -1.0) & (y == 0) & (z == 0)
    yaw = F.when(back, 0.0).otherwise(F.degrees(F.atan2(y, x)))
    pitch = F.when(back, 180.0).otherwise(F.degrees(F.asin(-z)))
    roll = F.when(back | (1 + x == 0), 0.0).otherwise(F.degrees(F.atan2(-y * z / (1 + x), 1 - z * z / (1 + x))))
    return yaw, pitch, roll


def lat_lon(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Latitude and longitude in degrees of a vector whose forward axis is x and whose up axis is z."""
    return F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), F.degrees(F.atan2(y, x))


def permuted(c: Column, axes: tuple[int, ...] = (2, 0, 1)) -> Column:
    return F.array(*(F.get(c, F.lit(i)) for i in axes))


def info_gain(p: Column, q: Column, logged: bool = False) -> Column:
    return p - q if logged else F.log2(p) - F.log2(q)


def tag(message: Column) -> Column:
    return F.substring_index(message, " ", 1)


def tag_map(body: Column, pair: str = " ", value: str = "=") -> Column:
    """KEY=VALUE tokens of a tag's body; later keys win, a token without a value has an empty one."""
    tokens = F.filter(F.split(body, pair), lambda x: x != "")
    return F.aggregate(tokens, F.expr("cast(map() AS map<string,string>)"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != F.substring_index(x, value, 1)), F.create_map(F.substring_index(x, value, 1), F.when(F.instr(x, value) > 0, F.substring(x, F.instr(x, value) + 1, F.length(x))).otherwise(F.lit("")))))


def main_sequence(ampl: Column, dur: Column, gain: float = 1.0) -> Column:
    """True where a duration (s) lies between the two lines over amplitude (degrees); a gain of 0 or less accepts all.

    Fixed values: the upper line runs from 45 ms at 0 degrees to 170 ms at 16, the lower from 14 to 60 ms."""
    if gain <= 0:
        return F.lit(True)
    hi0, hi1 = 0.045 * gain, (0.170 - 0.045) / 16 * gain
    lo0, lo1 = 0.014 / gain, (0.060 - 0.014) / 16 / gain
    return dur.between(F.lit(lo0) + ampl * lo1, F.lit(hi0) + ampl * hi1)


def is_video(name: Column, kinds: tuple[str, ...] = ("mp4", "avi", "mov", "mkv", "webm")) -> Column:
    return F.lower(F.substring_index(name, ".", -1)).isin(*kinds)


def is_image(name: Column, kinds: tuple[str, ...] = ("jpg", "jpeg", "png", "bmp", "gif")) -> Column:
    return F.lower(F.substring_index(name, ".", -1)).isin(*kinds)
