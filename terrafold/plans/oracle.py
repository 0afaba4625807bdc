"""Building blocks for the check SQL: the published formulas as DuckDB text."""

R = "6371000.0::DOUBLE"
MPD = "(pi() * 6371000.0::DOUBLE / 180)"


def hav(lat1, lon1, lat2, lon2) -> str:
    return (
        f"(2 * {R} * asin(sqrt(power(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * power(sin((radians({lon2}) - radians({lon1})) / 2), 2))))"
    )


def fmod360(x) -> str:
    return f"(({x}) - 360.0::DOUBLE * floor(({x}) / 360.0::DOUBLE))"


def bearing(lat1, lon1, lat2, lon2) -> str:
    d = f"(radians({lon2}) - radians({lon1}))"
    return fmod360(
        f"degrees(atan2(sin({d}) * cos(radians({lat2})), cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos({d}))) + 360"
    )


def turn(b1, b2) -> str:
    diff = f"({fmod360(f'({b2}) - ({b1}) + 180')} - 180)"
    return f"CASE WHEN abs({diff}) <= 45 THEN 'straight' WHEN {diff} > 45 AND {diff} < 135 THEN 'right' WHEN {diff} < -45 AND {diff} > -135 THEN 'left' ELSE 'u_turn' END"


def r6(x) -> str:
    return f"(round({x}, 6) + 0.0)"


def rn(x, n) -> str:
    return f"(round({x}, {n}) + 0.0)"


def steps_sum(ring, term) -> str:
    """Sum of ``term`` over consecutive vertices; ``term`` uses {a} and {b} for the vertices."""
    t = term.replace("{a}", f"{ring}[i]").replace("{b}", f"{ring}[i+1]")
    return f"coalesce(list_sum(list_transform(range(1, len({ring})), lambda i: {t})), 0.0)"


def seg_dist(px, py, ax, ay, bx, by) -> str:
    """Clamped point-to-segment distance."""
    dx, dy = f"(({bx}) - ({ax}))", f"(({by}) - ({ay}))"
    sq = f"({dx} * {dx} + {dy} * {dy})"
    t = f"(CASE WHEN {sq} = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, ((({px}) - ({ax})) * {dx} + (({py}) - ({ay})) * {dy}) / {sq})) END)"
    ex, ey = f"(({px}) - (({ax}) + {t} * {dx}))", f"(({py}) - (({ay}) + {t} * {dy}))"
    return f"sqrt({ex} * {ex} + {ey} * {ey})"


def in_ring(x, y, ring) -> str:
    hit = (
        f"CASE WHEN (({ring}[i].y > {y}) <> ({ring}[i+1].y > {y})) AND {x} < {ring}[i].x + ({y} - {ring}[i].y) / ({ring}[i+1].y - {ring}[i].y)"
        f" * ({ring}[i+1].x - {ring}[i].x) THEN 1 ELSE 0 END"
    )
    return f"(list_sum(list_transform(range(1, len({ring})), lambda i: {hit})) % 2 = 1)"
