"""Small rules of a drawing's analysis as column expressions: scales, widths, gates, names, statuses.

Word lists are the fixed values of these rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MM = {"m": 1000.0, "ft": 304.8}  # fixed values: millimetres of a unit
FEET_PER_METRE = 3.28084
DOOR_CM = 82.0

# Names of open-plan functions and of outdoor places, and what a printed name stands for.
OPEN_PLAN = (
    "Kitchen", "Dining", "Dining room", "Living", "Living room", "Family", "Family room", "Great room", "Breakfast nook", "Nook", "Foyer", "Entry", "Hall", "Hallway", "Sitting area", "Den", "Study",
    "Library", "Playroom", "Sunroom", "Stairs", "Room",
)
LABEL_FUNCTION = {
    "kitchen": "kitchen", "kitchenette": "kitchen", "pantry": "kitchen", "dining": "dining", "dining room": "dining", "breakfast nook": "dining", "nook": "dining", "living": "living", "living room": "living",
    "family": "living", "family room": "living", "great room": "living", "den": "living", "sitting area": "living", "lounge": "living", "bedroom": "bedroom", "master bedroom": "bedroom", "bath": "bath",
    "bathroom": "bath", "laundry": "laundry", "laundry room": "laundry",
}

# Fixed value: the pattern of measures, areas and units in a text of capitals.
MEASURE = r"\d+\s*['′\"″]|\d+[.,]\d+|\bM2\b|M²|\bSQ\b|\bFT\b|\d{3,}"


def millimetres_per_pixel(per_unit: Column, unit: Column) -> Column:
    """struct(mm, reason): from printed sizes alone; null and why where there are none."""
    known = (per_unit > 0) & unit.isin(*MM) & (per_unit < float("inf"))
    mm = F.when(known, F.when(unit == "m", MM["m"]).otherwise(MM["ft"]) / per_unit)
    return F.struct(mm.alias("mm"), F.when(known, "printed").otherwise("uncalibrated").alias("reason"))


def width_in_feet(pixels: Column, per_unit: Column, unit: Column) -> Column:
    """Null where the drawing has no scale."""
    width = pixels / F.when(per_unit != 0, per_unit)
    return F.when(unit == "m", width * FEET_PER_METRE).otherwise(width)


def opening_size_score(ratio: Column, confidence: Column) -> Column:
    """Evidence of a gap's size (four wall thicknesses are full) and of its walls; none for no gap."""
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
    return F.when(ratio <= 0, 0.0).otherwise(F.least(F.lit(1.0), ratio / 4.0) * 0.6 + sure * 0.4)


def significant_gap(gap: Column, thickness: Column, factor: float = 1.5) -> Column:
    return (gap > 0) & (thickness > 0) & (gap >= thickness * factor)


def in_any_region(x: Column, y: Column, regions: Column) -> Column:
    """Whether a point lies in one of an array of boxes (x0, y0, x1, y1); without boxes, always."""
    return regions.isNull() | (F.size(regions) == 0) | F.exists(regions, lambda r: x.between(r["x0"], r["x1"]) & y.between(r["y0"], r["y1"]))


def along_any(angle: Column, directions: Column, tolerance: float = 8.0) -> Column:
    """Whether an undirected angle is within the tolerance of one of an array of directions."""
    off = lambda d: F.abs(F.pmod(angle, F.lit(180.0)) - d)
    return F.exists(directions, lambda d: F.least(off(d), 180.0 - off(d)) <= tolerance)


def suspicious_reading(spaces: Column, largest_share: Column, wall_share: Column) -> Column:
    """Why a reading of a drawing should be tried again; null where nothing speaks against it."""
    return (
        F.when(spaces == 0, "no enclosed space").when(largest_share >= 0.6, "one space holds most of the floor").when(wall_share > 0.3, "too much wall").when(wall_share < 0.005, "almost no wall")
    )


def normalised_reading(text: Column) -> Column:
    """Capitals, one sign for times, feet and inches each; other signs are blanks; outer signs and double blanks go."""
    signs = F.translate(F.upper(text), "×′″", "X'\"")
    kept = F.regexp_replace(signs, r"[^A-Z0-9'\"X.\- /]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(kept, r"^[ .,:;-]+", ""), r"[ .,:;-]+$", ""), r"\s+", " "))


def is_name_token(token: Column, short: tuple[str, ...]) -> Column:
    """Words that can be part of a room's name: numbers of one or two digits, words of three letters or more, and the
    ``short`` ones; no measures, areas, units or mixed fragments."""
    t = F.regexp_replace(F.regexp_replace(F.trim(token), r"^[.,:;]+", ""), r"[.,:;]+$", "")
    measure = F.upper(t).rlike(MEASURE)
    word = t.rlike(r"^[A-Za-z][A-Za-z'./-]*$")
    letters = F.length(F.regexp_replace(t, "[^A-Za-z]", ""))
    return (t != "") & ~measure & (t.rlike(r"^\d{1,2}$") | (word & ((letters >= 3) | F.upper(t).isin(*short))))


def label_function(name: Column) -> Column:
    """What a printed name says a space is for; null for other names."""
    known = F.create_map(*[F.lit(x) for pair in LABEL_FUNCTION.items() for x in pair])
    return F.try_element_at(known, F.trim(F.lower(F.coalesce(name, F.lit("")))))


def shared_space_kind(names: Column) -> Column:
    """Of an array of names in one space: open-plan if all are open-plan functions, else merged."""
    return F.when(F.forall(names, lambda n: n.isin(*OPEN_PLAN)), "open-plan").otherwise("merged")


def label_stays(exterior_share: Column, inside_extent: Column, outdoor: Column) -> Column:
    """Names of places inside the building stay, and outdoor names just outside its walls."""
    return ~((exterior_share > 0.5) & (~inside_extent | ~outdoor))


def drawing_scale(printed: Column, unit: Column, doors: Column) -> Column:
    """struct(px_per_cm, source): printed sizes, else the median of three door widths or more over a door's width."""
    n = F.size(doors)
    line = F.array_sort(doors)
    middle = (F.get(line, F.floor((n - 1) / 2).cast("int")) + F.get(line, F.floor(n / 2).cast("int"))) / 2
    cm = F.when(unit == "m", 100.0).when(unit == "ft", 30.48)
    first = F.when(printed > 0, printed / cm)
    return F.struct(F.coalesce(first, F.when(n >= 3, middle / DOOR_CM)).alias("px_per_cm"), F.when(first.isNotNull(), "printed").when(n >= 3, "doors").alias("source"))


def rectangle_around(x0: Column, y0: Column, x1: Column, y1: Column, half: Column) -> Column:
    """The four corners of a segment's rectangle, ``half`` to each side; null for a point or no width."""
    length = F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))
    nx, ny = -(y1 - y0) / length * half, (x1 - x0) / length * half
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.when((length >= 1e-9) & (half > 0), F.array(corner(x0 + nx, y0 + ny), corner(x1 + nx, y1 + ny), corner(x1 - nx, y1 - ny), corner(x0 - nx, y0 - ny)))


def opening_type(feet_of_door: float = 4.6, feet_of_garage: float = 8.0) -> Column:
    """struct(kind, confidence, symbol) of an opening from its evidence, the first rule that holds: sliding panels, a door's
    symbol, glazing, an outline in its context, a bare gap, or nothing that decides. A single line is an outline only.

    Columns: source, relation, sliding, arc, double_arc, leaf (scores), glazed (full lines inside the wall), dashed, inner
    (any line inside), faces (lines on the wall's faces), covered (lines that cover .6), most (the best line's cover),
    width, thickness, wall, feet (null where there is no scale).
    """
    single, inside, outside = "source = 'single_line'", "relation = 'between_rooms'", "relation = 'room_to_exterior'"
    door = "greatest(arc, double_arc * 1.05D, leaf * 0.95D)"
    glazing = f"CASE WHEN {single} THEN 0D WHEN glazed > 0 THEN CASE WHEN faces > 0 OR glazed >= 2 THEN 0.92D ELSE 0.8D END WHEN dashed THEN 0.62D ELSE 0D END"
    faces = f"(CASE WHEN {single} THEN least(covered, 1) ELSE faces END)"
    base = "greatest(wall, 1D)"
    small = f"CASE WHEN feet IS NOT NULL THEN feet <= {feet_of_door}D ELSE width <= 6D * greatest(thickness, {base}) END"
    garage = f"CASE WHEN feet IS NOT NULL THEN feet >= {feet_of_garage}D ELSE width >= 14D * {base} END"
    made = lambda kind, confidence, symbol: f"struct('{kind}' AS kind, {confidence} AS confidence, {symbol} AS symbol)"
    drawn = "CASE WHEN double_arc * 1.05D >= greatest(arc, leaf * 0.95D) THEN 'double swing' WHEN arc >= leaf * 0.95D THEN 'swing arc' ELSE 'door leaf' END"
    pane = f"CASE WHEN {glazing} >= 0.8D THEN 'glazing lines' ELSE 'dashed glazing line' END"
    outline = (
        f"CASE WHEN {inside} THEN {made('door', '0.72D', repr('outline only'))} WHEN {outside} AND {small} AND {faces} >= 2 THEN {made('door', '0.62D', repr('outline only'))} "
        f"WHEN {outside} AND {garage} THEN {made('door', '0.58D', repr('outline only'))} ELSE {made('opening', '0.4D', repr('outline only'))} END"
    )
    first = (
        f"CASE WHEN sliding AND NOT {single} THEN {made('door', '0.85D', repr('sliding panels'))} "
        f"WHEN {door} >= 0.55D AND {door} >= {glazing} - 0.1D THEN {made('door', f'least(0.95D, 0.6D + 0.35D * {door} + CASE WHEN {inside} THEN 0.05D ELSE 0D END)', drawn)} "
        f"WHEN {glazing} >= 0.62D AND {inside} AND {glazing} < 0.8D THEN {made('opening', '0.45D', repr('weak glazing'))} "
        f"WHEN {glazing} >= 0.62D THEN {made('window', f'least(0.95D, 0.45D + 0.5D * ({glazing}) - CASE WHEN {inside} THEN 0.15D ELSE 0D END)', pane)} "
        f"WHEN {faces} > 0 AND (NOT inner OR {single}) THEN {outline} "
        f"WHEN most < 0.2D AND {door} < 0.35D THEN {made('opening', '0.4D', repr('bare gap'))} ELSE {made('opening', '0.4D', repr('none'))} END"
    )
    unsure = "CASE WHEN relation IN ('unknown', 'same_space') AND t.kind <> 'opening' THEN 0.85D ELSE 1D END"
    return F.expr(f"transform(array({first}), t -> struct(t.kind AS kind, bround(t.confidence * {unsure}, 2) AS confidence, t.symbol AS symbol))[0]")
