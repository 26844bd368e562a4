"""Scalar derivations as column expressions: geometry, boxes, colours, clocks, jerseys, cursors, clip windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PITCH_LENGTH_M, PITCH_WIDTH_M = 105.0, 68.0
UNKNOWN, TEAM_A, TEAM_B, REFEREE = -1, 0, 1, 2


def lit_or_col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# --- boxes ---------------------------------------------------------------------------------------------------


def center_x(x1: Column, x2: Column) -> Column:
    return (x1.cast("double") + x2) * 0.5


def foot_point(x1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """Where a box stands: the middle of its lower edge."""
    return center_x(x1, x2), y2.cast("double")


def box_height(y1: Column, y2: Column) -> Column:
    return y2.cast("double") - y1


def box_iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Intersection over union of two (x1, y1, x2, y2) boxes, 0 where they don't meet."""
    width = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    height = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    meet = width * height
    area = lambda r: F.greatest(F.lit(0.0), r[2] - r[0]) * F.greatest(F.lit(0.0), r[3] - r[1])
    union = area(a) + area(b) - meet
    return F.when((meet > 0) & (union > 0), meet / union).otherwise(F.lit(0.0))


def scaled_box(box: Sequence[Column], sx: float, sy: float) -> list[Column]:
    return [box[0] * sx, box[1] * sy, box[2] * sx, box[3] * sy]


def moved_box(box: Sequence[Column], dx: float, dy: float) -> list[Column]:
    return [box[0] + dx, box[1] + dy, box[2] + dx, box[3] + dy]


def box_to_center_aspect(box: Sequence[Column]) -> list[Column]:
    """(cx, cy, width / height, height)."""
    height = box[3] - box[1]
    return [(box[0] + box[2]) / 2, (box[1] + box[3]) / 2, F.when(height != 0, (box[2] - box[0]) / height), height]


def center_distance_in_heights(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Distance of two boxes' centres in mean box heights: independent of scale."""
    distance = F.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2)
    return distance / F.greatest(((a[3] - a[1]) + (b[3] - b[1])) / 2, F.lit(1e-6))


def roi_box(roi: Column, normalized: Column, width: Column, height: Column) -> Column:
    """A clamped (x1, y1, x2, y2) of a region of interest, null when it is smaller than two pixels."""
    sx, sy = F.when(normalized, width).otherwise(1), F.when(normalized, height).otherwise(1)
    clamp = lambda v, top: F.least(F.greatest(F.lit(0.0), v), top.cast("double"))
    x1, x2 = clamp(roi["x1"] * sx, width), clamp(roi["x2"] * sx, width)
    y1, y2 = clamp(roi["y1"] * sy, height), clamp(roi["y2"] * sy, height)
    return F.when((width > 0) & (height > 0) & (x2 - x1 >= 2) & (y2 - y1 >= 2), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))


# --- the pitch -----------------------------------------------------------------------------------------------


def project(h: Sequence[Sequence[float]] | Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A 3x3 homography, nested floats or a column of them; null on or behind the vanishing line."""
    at = (lambda i, j: F.element_at(F.element_at(h, i + 1), j + 1)) if isinstance(h, Column) else (lambda i, j: F.lit(float(h[i][j])))
    w = at(2, 0) * x + at(2, 1) * y + at(2, 2)
    part = lambda i: F.when(w > 1e-12, (at(i, 0) * x + at(i, 1) * y + at(i, 2)) / w)
    return part(0), part(1)


def clip_to_pitch(x: Column, y: Column, length: float = PITCH_LENGTH_M, width: float = PITCH_WIDTH_M) -> tuple[Column, Column]:
    clamp = lambda v, half: F.greatest(F.least(v, F.lit(half)), F.lit(-half))
    return clamp(x, length / 2), clamp(y, width / 2)


def in_bounds(x: Column, y: Column, margin: float = 0.0, length: float = PITCH_LENGTH_M, width: float = PITCH_WIDTH_M) -> Column:
    """False for nulls and NaN, which Spark would order above every number."""
    inside = (F.abs(x) <= length / 2 + margin) & (F.abs(y) <= width / 2 + margin)
    return F.coalesce(inside & ~F.isnan(x) & ~F.isnan(y), F.lit(False))


def third(x: Column, direction=1, length: float = PITCH_LENGTH_M) -> Column:
    """0 own, 1 middle, 2 attacking third for a team that plays towards ``direction``."""
    along = x * lit_or_col(direction)
    return F.when(along < -length / 6, 0).when(along > length / 6, 2).otherwise(1)


def inside_box(x: Column, y: Column, box: Column, margin: float = 0.0) -> Column:
    return x.between(box["x1"] - margin, box["x2"] + margin) & y.between(box["y1"] - margin, box["y2"] + margin)


def near_goal_side(x: Column, x_min: Column, x_max: Column, fraction: float) -> Column:
    """Which goal line a point is near to; the left one is tested first."""
    reach = (x_max - x_min) * fraction
    return F.when(x <= x_min + reach, "left").when(x >= x_max - reach, "right")


def is_interrupt(state: Column) -> Column:
    return state.startswith("restart") | state.startswith("goal")


# --- colours and vectors ---------------------------------------------------------------------------------------


def hex_channels(value: Column) -> Column:
    """#rrggbb as an array (red, green, blue)."""
    digits = F.regexp_replace(F.trim(value), "^#", "")
    return F.transform(F.array(F.lit(1), F.lit(3), F.lit(5)), lambda i: F.conv(F.substr(digits, i, F.lit(2)), 16, 10).cast("int"))


def channels_hex(red: Column, green: Column, blue: Column) -> Column:
    byte = lambda c: F.least(F.greatest(F.rint(c), F.lit(0.0)), F.lit(255.0)).cast("int")
    return F.format_string("#%02x%02x%02x", byte(red), byte(green), byte(blue))


def hsv_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Circular hue (of 180), saturation and value; hue counts less where a colour is pale."""
    hue = F.abs(a[0] - b[0])
    hue = F.least(hue, 180.0 - hue) / 90.0
    weight = 0.6 + 0.8 * F.least(a[1], b[1]) / 255.0
    return hue * weight + F.abs(a[1] - b[1]) / 255.0 * 0.5 + F.abs(a[2] - b[2]) / 255.0 * 0.35


def lightness_weighted(lab: Column, weight: float) -> Column:
    return F.transform(lab, lambda v, i: F.when(i == 0, v * weight).otherwise(v))


def histogram_similarity(a: Column, b: Column) -> Column:
    """Bhattacharyya coefficient of two histograms scaled to sum one; null when shapes differ or one is empty."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    overlap = F.aggregate(F.zip_with(a, b, lambda p, q: F.sqrt(F.greatest(p.cast("double") * q, F.lit(0.0)))), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (total(a) > 0) & (total(b) > 0), overlap / F.sqrt(total(a) * total(b)))


# --- clocks, names, cursors --------------------------------------------------------------------------------------


def parse_clock(text: Column) -> Column:
    """SS, MM:SS or HH:MM:SS as seconds; null when a part is no number."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda p: p.try_cast("double"))
    return F.when(F.size(parts) <= 3, F.aggregate(parts, F.lit(0.0), lambda total, p: total * 60 + p))


def format_clock(seconds: Column, with_hours: bool = True) -> Column:
    """[H:]M:SS, or a match's clock that counts minutes on, M:SS; halves go to the even second."""
    total = F.greatest(F.lit(0), F.rint(seconds).cast("long"))
    if not with_hours:
        return F.format_string("%d:%02d", F.floor(total / 60), total % 60)
    hours, minutes, rest = F.floor(total / 3600), F.floor(total / 60) % 60, total % 60
    return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, rest)).otherwise(F.format_string("%d:%02d", minutes, rest))


def normalize_jersey(value: Column) -> Column:
    """07 and 7 are one shirt; all zeros stay as they are."""
    text = F.trim(F.coalesce(value, F.lit("")))
    bare = F.regexp_replace(text, "^0+", "")
    return F.when(bare != "", bare).otherwise(text)


def team_bucket(team: Column, home: Column, away: Column) -> Column:
    """home, away or unattributed, by id or by the team's name."""
    value = F.lower(F.trim(team))
    is_team = lambda side, name: value.isin(side, f"team_{side}") | ((F.trim(name) != "") & (value == F.lower(F.trim(name))))
    return F.when(F.coalesce(value == "", F.lit(True)), "unattributed").when(is_team("home", home), "home").when(is_team("away", away), "away").otherwise("unattributed")


#: Event types that the store accepts. Fixed values.
EVENT_TYPES = ("goal", "shot", "corner_kick", "penalty_kick", "free_kick", "goal_kick", "kickoff", "foul", "save", "yellow_card", "red_card", "chance", "sprint", "dribble", "turnover", "foul_candidate")


def normalize_event_type(value: Column, fallback: str = "shot") -> Column:
    clean = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(clean.isin(*EVENT_TYPES), clean).otherwise(fallback)


def team_side(team: Column) -> Column:
    return F.when(team == TEAM_A, "home").when(team == TEAM_B, "away")


def explanations(signals: Column) -> Column:
    """A map of signals as an array of (signal, value), nulls left out."""
    return F.filter(F.transform(F.map_entries(signals), lambda e: F.struct(e["key"].alias("signal"), e["value"].alias("value"))), lambda e: e["value"].isNotNull())


def encode_cursor(offset: Column) -> Column:
    raw = F.base64(F.greatest(offset, F.lit(0)).cast("string").cast("binary"))
    return F.rtrim(F.translate(raw, "+/", "-_"), F.lit("="))


def decode_cursor(cursor: Column) -> Column:
    """0 for a null, a broken or a negative cursor."""
    padded = F.rpad(F.translate(cursor, "-_", "+/"), (F.ceil(F.length(cursor) / 4) * 4).cast("int"), F.lit("="))
    return F.coalesce(F.greatest(F.lit(0), F.try_to_binary(padded, F.lit("base64")).cast("string").try_cast("int")), F.lit(0))


def clip_window_ms(occurred: Column, start: Column, end: Column, pre_s: float, post_s: float, anchor: str = "window") -> Column:
    """(start_ms, end_ms) of a clip, never empty."""
    first, last = (occurred, occurred) if anchor == "occurred_at" else (start, end)
    a = F.greatest(F.lit(0.0), first / 1000.0 - pre_s)
    b = last / 1000.0 + post_s
    b = F.when(b <= a, a + max(1.0, pre_s + post_s)).otherwise(b)
    a_ms = F.greatest(F.lit(0), F.rint(a * 1000).cast("long"))
    return F.struct(a_ms.alias("start_ms"), F.greatest(a_ms + 1, F.rint(b * 1000).cast("long")).alias("end_ms"))


def interval_overlap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(end_a, end_b) - F.greatest(start_a, start_b))


#: Excitement of an event by its type; anything else counts 0.2. Fixed values.
EXCITEMENT = {
    "goal": 1.0, "shot": 0.6, "save": 0.75, "chance": 0.5, "yellow_card": 0.6, "red_card": 0.6, "penalty_kick": 0.5, "corner_kick": 0.4,
    "free_kick": 0.3, "goal_kick": 0.3, "kickoff": 0.3, "dribble": 0.35, "foul_candidate": 0.3, "sprint": 0.25, "turnover": 0.2,
}
#: Of a shot on target, and of a free kick that a side is known for. Fixed values.
SHOT_ON_TARGET, KNOWN_FREE_KICK = 0.8, 0.4


def base_excitement(kind: Column, on_target: Column, side: Column) -> Column:
    """By type; shots on target and free kicks of a known side count more."""
    value = F.when((kind == "shot") & on_target, SHOT_ON_TARGET).when((kind == "free_kick") & side.isNotNull(), KNOWN_FREE_KICK)
    for name, points in EXCITEMENT.items():
        value = value.when(kind == name, points)
    return value.otherwise(0.2)


#: Providers by host name. Fixed values.
SOURCE_HOSTS = {
    "youtube": ("youtube.com", "www.youtube.com", "youtu.be", "m.youtube.com"), "vimeo": ("vimeo.com", "player.vimeo.com"), "veo": ("veo.co", "app.veo.co"),
    "hudl": ("hudl.com", "www.hudl.com", "fan.hudl.com"), "pixellot": ("pixellot.tv", "www.pixellot.tv"), "xbotgo": ("xbotgo.com", "www.xbotgo.com"),
    "nbc_sports_engine": ("sportsengine.com", "www.sportsengine.com", "nbcsportsengine.com"),
}


def source_of_url(url: Column) -> Column:
    """The provider's key, other_link for an unknown host, null for what is no link."""
    host = F.lower(F.try_parse_url(F.trim(url), F.lit("HOST")))
    pairs = [F.lit(x) for key, hosts in SOURCE_HOSTS.items() for h in hosts for x in (h, key)]
    return F.when(F.contains(url, F.lit("://")) & (host != ""), F.coalesce(F.try_element_at(F.create_map(*pairs), host), F.lit("other_link")))
