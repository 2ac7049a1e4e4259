"""SQL for the whole of op10_simhash: XXH64, fingerprints, links and components.

All shingles are hashed side by side: a recursive query takes 32 bytes of each
at a time, another eight, another one.  Numbers are 128 bits wide, so that
products of 64 bits don't overflow.
"""

from __future__ import annotations

# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_WIDE = 1 << 64


def _n(x: int | str) -> str:
    return f"{x}::UHUGEINT" if isinstance(x, int) else x


def _mul(a: str, b: int) -> str:
    return f"({a} * {_n(b)} % {_n(_WIDE)})"


def _add(*parts: int | str) -> str:
    return "((" + " + ".join(map(_n, parts)) + f") % {_n(_WIDE)})"


def _rotate(a: str, r: int) -> str:
    return f"({a} * {_n(1 << r)} % {_n(_WIDE)} + {a} // {_n(1 << 64 - r)})"


def _lane(at: str, size: int) -> str:
    """A little-endian number of so many bytes of b."""
    return "(" + " + ".join(f"b[{at} + {i + 1}] * {_n(256**i)}" for i in range(size)) + ")"


def _turn(a: str, lane: str) -> str:
    """One round of an accumulator."""
    return _mul("(" + _rotate(_add(a, _mul(lane, _P2)), 31) + ")", _P1)


def _mixed(h: str, with_: str, r: int, times: int, plus: int) -> str:
    return _add(_mul(_rotate(f"xor({h}, {with_})", r), times), plus)


def oracle(shingle: int, threshold: int, seed: int = 42) -> str:
    start = [(seed + _P1 + _P2) % _WIDE, (seed + _P2) % _WIDE, seed, (seed - _P1) % _WIDE]
    merged = _add(*[_rotate(f"v{i}", r) for i, r in ((1, 1), (2, 7), (3, 12), (4, 18))])
    steps = "m0 AS (SELECT s, b, n, o, v1, v2, v3, v4, CASE WHEN n >= 32 THEN " + merged + f" ELSE {_n((seed + _P5) % _WIDE)} END AS h FROM stripe WHERE o + 32 > n)"
    for i in range(1, 5):
        merged = _add(_mul(f"xor(h, {_turn(_n(0), f'v{i}')})", _P1), _P4)
        steps += f", m{i} AS (SELECT s, b, n, o, v1, v2, v3, v4, CASE WHEN n >= 32 THEN {merged} ELSE h END AS h FROM m{i - 1})"
    return f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, row_number() OVER () AS r,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), sh AS (
            SELECT r, array_to_string(w[k:k + {shingle - 1}], ' ') AS s FROM (SELECT r, w, unnest(generate_series(1, greatest(len(w) - {shingle - 1}, 1))) AS k FROM d WHERE len(w) > 0)
        ), raw AS (
            SELECT s, hex(encode(s)) AS x FROM (SELECT DISTINCT s FROM sh)
        ), bytes AS (
            SELECT s, list_transform(generate_series(1, length(x), 2), lambda i: (16 * (strpos('0123456789ABCDEF', x[i]) - 1) + strpos('0123456789ABCDEF', x[i + 1]) - 1)::UHUGEINT) AS b, length(x) // 2 AS n FROM raw
        ), stripe AS (
            SELECT s, b, n, 0 AS o, {", ".join(f"{_n(v)} AS v{i}" for i, v in enumerate(start, 1))} FROM bytes
            UNION ALL
            SELECT s, b, n, o + 32, {", ".join(_turn(f"v{i}", _lane(f"o + {8 * (i - 1)}", 8)) for i in range(1, 5))} FROM stripe WHERE o + 32 <= n
        ), {steps}, eight AS (
            SELECT s, b, n, o, {_add("h", "n::UHUGEINT")} AS h FROM m4
            UNION ALL
            SELECT s, b, n, o + 8, {_mixed("h", _turn(_n(0), _lane("o", 8)), 27, _P1, _P4)} FROM eight WHERE o + 8 <= n
        ), four AS (
            SELECT s, b, n, CASE WHEN o + 4 <= n THEN o + 4 ELSE o END AS o, CASE WHEN o + 4 <= n THEN {_mixed("h", _mul(_lane("o", 4), _P1), 23, _P2, _P3)} ELSE h END AS h FROM eight WHERE o + 8 > n
        ), one AS (
            SELECT s, b, n, o, h FROM four
            UNION ALL
            SELECT s, b, n, o + 1, {_mul(_rotate(f"xor(h, {_mul('b[o + 1]', _P5)})", 11), _P1)} FROM one WHERE o < n
        ), a1 AS (
            SELECT s, {_mul(f"xor(h, h // {_n(1 << 33)})", _P2)} AS h FROM one WHERE o = n
        ), a2 AS (
            SELECT s, {_mul(f"xor(h, h // {_n(1 << 29)})", _P3)} AS h FROM a1
        ), hashed AS (
            SELECT s, xor(h, h // {_n(1 << 32)})::UBIGINT AS h FROM a2
        ), fp AS (
            SELECT r, bit_or(CASE WHEN 2 * ones > n THEN 1::UBIGINT << bit::UBIGINT ELSE 0::UBIGINT END) AS f
            FROM (SELECT r, bit, sum(((h >> bit::UBIGINT) & 1)::INT) AS ones, count(*) AS n FROM sh JOIN hashed USING (s), generate_series(0, 63) AS g(bit) GROUP BY r, bit) GROUP BY r
        ), found AS (
            SELECT d.doc_id, coalesce(f, 0::UBIGINT) AS f FROM d LEFT JOIN fp USING (r)
        ), nodes AS (
            SELECT f, min(doc_id) AS low FROM found GROUP BY f
        ), links AS (
            SELECT x.f AS a, y.f AS b FROM nodes x JOIN nodes y ON bit_count(xor(x.f, y.f)) <= {threshold}
        ), reach AS (
            SELECT f, f AS other FROM nodes
            UNION
            SELECT reach.f, links.b FROM reach JOIN links ON reach.other = links.a
        ), named AS (
            SELECT reach.f, min(nodes.low) AS component_id FROM reach JOIN nodes ON reach.other = nodes.f GROUP BY reach.f
        )
        SELECT doc_id, lower(lpad(hex(f), 16, '0')) AS fingerprint, component_id FROM found JOIN named USING (f)
    """
