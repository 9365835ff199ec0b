"""SQL for dithered pages of 8 x 8 pixels: a recursive walk over the 64 places of each page, one place a step."""

from __future__ import annotations

from .operators.dither import ALGORITHMS, KERNELS

ONE_BIT = "CASE WHEN {0} < 128 THEN 0.0 ELSE 255.0 END"
TWO_BIT = "CASE WHEN {0} < 42 THEN 0.0 WHEN {0} < 127 THEN 85.0 WHEN {0} < 212 THEN 170.0 ELSE 255.0 END"
# the walk in quarters: each round turns the curve of n x n into that of 2n x 2n
HILBERT = "h1 AS (SELECT 0 AS d, 0 AS x, 0 AS y)" + "".join(
    f""", h{2 * n} AS (SELECT d, y AS x, x AS y FROM h{n} UNION ALL SELECT d + {n * n}, x, y + {n} FROM h{n}
UNION ALL SELECT d + {2 * n * n}, x + {n}, y + {n} FROM h{n} UNION ALL SELECT d + {3 * n * n}, {2 * n - 1} - y, {n - 1} - x FROM h{n})"""
    for n in (1, 2, 4)
)


def _spread(pixels: str, share: str, level: str) -> str:
    """Pages as lists, after each place gave its error to the places ahead. share is by dx, dy, old and err."""
    dx, dy = "(j % 8 - i % 8)", "(j // 8 - i // 8)"
    return f"""WITH RECURSIVE s(vec_id, i, v) AS (SELECT vec_id, 0, list(CAST(g AS FLOAT) ORDER BY y, x) FROM ({pixels}) GROUP BY vec_id
UNION ALL SELECT vec_id, i + 1, list_transform(range(64), lambda j: CAST(CASE WHEN j = i THEN new WHEN j > i AND {dy} <= 2 AND abs({dx}) <= 2 THEN CAST(v[j + 1] AS DOUBLE) + {share.format(dx=dx, dy=dy)} ELSE v[j + 1] END AS FLOAT))
FROM (SELECT *, old - new AS err FROM (SELECT *, CAST({level.format("old")} AS DOUBLE) AS new FROM (SELECT *, CAST(v[i + 1] AS DOUBLE) AS old FROM s WHERE i < 64))))
SELECT vec_id, unnest(range(64)) AS i, unnest(v) AS g FROM s WHERE i = 64"""


def _kernel(name: str) -> str:
    divisor, shares = KERNELS[name]
    table = {(dx, dy): w for dx, dy, w in shares}
    flat = [table.get((dx, dy), 0) for dy in range(3) for dx in range(-2, 3)]
    return f"err / {divisor} * ({flat})[{{dy}} * 5 + {{dx}} + 3]"


def _varying() -> str:
    """Shares that move with the gray: from 0.7, 0.2, 0.1 at its ends to 0.3, 0.4, 0.3 in the middle."""
    gray = "least(greatest(old, 0), 255)"
    t = f"(CASE WHEN {gray} <= 128 THEN {gray} / 128.0::DOUBLE ELSE ({gray} - 128) / 127.0::DOUBLE END)"
    part = lambda a, b: f"err * (CASE WHEN {gray} <= 128 THEN {a}::DOUBLE * (1 - {t}) + {b}::DOUBLE * {t} ELSE {b}::DOUBLE * (1 - {t}) + {a}::DOUBLE * {t} END)"
    return f"CASE WHEN {{dx}} = 1 AND {{dy}} = 0 THEN {part(0.7, 0.3)} WHEN {{dx}} = -1 AND {{dy}} = 1 THEN {part(0.2, 0.4)} WHEN {{dx}} = 0 AND {{dy}} = 1 THEN {part(0.1, 0.3)} ELSE 0 END"


def _curve(pixels: str, level: str) -> str:
    """Each place along the curve hands its whole error to the next."""
    return f"""WITH RECURSIVE {HILBERT}, along AS (SELECT vec_id, list(g ORDER BY d) AS gs FROM ({pixels}) AS p JOIN h8 USING (x, y) GROUP BY vec_id),
s(vec_id, gs, d, value, new) AS (SELECT vec_id, gs, -1, 0.0::DOUBLE, 0.0::DOUBLE FROM along
UNION ALL SELECT vec_id, gs, d, value, CAST({level.format("value")} AS DOUBLE) FROM (SELECT vec_id, gs, d + 1 AS d, gs[d + 2] + (value - new) AS value FROM s WHERE d < 63))
SELECT vec_id, h8.y * 8 + h8.x AS i, new AS g FROM s JOIN h8 USING (d)"""


def page_sql(pixels: str, algorithm: str, two_bit: bool) -> str:
    """vec_id and blob, the encoded page in hex. pixels is SQL for vec_id, x, y, g."""
    level = TWO_BIT if two_bit else ONE_BIT
    if algorithm == "ordered":
        places = f"SELECT vec_id, y * 8 + x AS i, CASE WHEN g > 16 * ([0,8,2,10,12,4,14,6,3,11,1,9,15,7,13,5])[(y % 4) * 4 + x % 4 + 1] THEN 255 ELSE 0 END AS g FROM ({pixels})"
    elif algorithm == "stochastic":
        places = _curve(pixels, level)
    else:
        places = _spread(pixels, _varying() if algorithm == "ostromoukhov" else _kernel(algorithm), level)
    if not two_bit:
        rows = f"SELECT vec_id, i // 8 AS k, printf('%02x', CAST(sum(CASE WHEN g >= 128 THEN 1 << CAST(7 - i % 8 AS INTEGER) ELSE 0 END) AS INTEGER)) AS p FROM ({places}) GROUP BY ALL"
        return f"SELECT vec_id, '58544700080008000000' || '08000000' || string_agg(p, '' ORDER BY k) || string_agg(p, '' ORDER BY k) AS blob FROM ({rows}) GROUP BY vec_id"
    codes = f"SELECT vec_id, 7 - i % 8 AS k, 1 << CAST(7 - i // 8 AS INTEGER) AS bit, CASE WHEN g >= 212 THEN 0 WHEN g >= 127 THEN 1 WHEN g >= 42 THEN 2 ELSE 3 END AS code FROM ({places})"
    hexed = lambda bits: f"printf('%02x', CAST(sum(bit * ({bits})) AS INTEGER))"
    columns = f"SELECT vec_id, k, {hexed('code & 1')} AS p0, {hexed('code >> 1')} AS p1, {hexed('xor(code & 1, code >> 1)')} AS mixed FROM ({codes}) GROUP BY vec_id, k"
    return f"SELECT vec_id, '58544800080008000000' || '10000000' || string_agg(mixed, '' ORDER BY k) || string_agg(p0, '' ORDER BY k) || string_agg(p1, '' ORDER BY k) AS blob FROM ({columns}) GROUP BY vec_id"


def all_pages(pixels: str) -> dict[str, str]:
    return {f"di_{a.replace('-', '_')}{'_2bit' if b else ''}": page_sql(pixels, a, b) for a in ALGORITHMS[1:] for b in (False, True)}
