"""Transliteration in plain SQL (DuckDB's dialect), from regular expressions, joins and windows.

An independent form of the same semantics for Latin and Indic sources and targets, with the alphabets inlined as ``VALUES``; queries are held against it.
"""

from __future__ import annotations

from lipika.functions import alphabets as A, kernel, options as O
from lipika.operators.relational import piece_pattern


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(quote(x) if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


def tokens(relation: str, key: str, text: str, source: str, mask: int = 0) -> str:
    """A query for (key, pos, cls, idx, lit) of the relation's texts."""
    found = kernel.reader(source)
    known = values([(k, n, t[0], t[1]) for k, ts in found.spellings.items() for n, t in enumerate(ts)])
    folded = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')" if found.fold else text
    no_accent = f"AND coalesce(k.cls, -1) <> {A.ACCENT}" if mask & O.IGNORE_ACCENTS else ""
    cut = f"SELECT {key}, unnest(ps) AS piece, unnest(range(len(ps))) AS place, {text} AS whole FROM (SELECT {key}, {text}, regexp_extract_all({folded}, {quote(piece_pattern(source))}) AS ps FROM {relation})"
    spelled = "piece"
    if found.fold:  # verbatim pieces keep their case
        cut = f"SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY {key} ORDER BY place) AS BIGINT) AS past FROM ({cut})"
        spelled = "substr(whole, past - length(piece) + 1, length(piece))"
    return f"""
(WITH cut AS ({cut}),
known(spelling, sub, cls, idx) AS ({known}),
found AS (SELECT {key}, place * 8 + coalesce(sub, 0) AS pos, coalesce(k.cls, -1) AS cls, k.idx, length(piece) = 1 AS one,
  CASE WHEN k.cls IS NULL THEN CASE WHEN piece LIKE '##%##' AND length(piece) > 3 THEN substr({spelled}, 3, length(piece) - 4) ELSE {spelled} END END AS lit
  FROM cut LEFT JOIN known k ON piece = spelling
  WHERE (k.cls IS NOT NULL OR piece LIKE '<%>' OR piece LIKE '##%##' AND length(piece) > 3 OR NOT (starts_with(piece, '<') OR starts_with(piece, '##'))) {no_accent})
SELECT {key}, pos, cls, idx, lit, one FROM found)"""


def token_count(relation: str, key: str, text: str, source: str) -> str:
    """A query for (key, n_all, n_accents): tokens, of which a run of single verbatim characters is one (``#`` starts a new one), and accents among them."""
    return f"""
(SELECT {key}, count(*) FILTER (cls >= 0 OR NOT one OR lit = '#' OR before IS NULL OR before) AS n_all, count(*) FILTER (cls = {A.ACCENT}) AS n_accents
FROM (SELECT *, lag(cls >= 0 OR NOT one) OVER (PARTITION BY {key} ORDER BY pos) AS before FROM {tokens(relation, key, text, source)}) GROUP BY {key})"""


def doubled(found: str, key: str, source: str) -> str:
    """Tokens with the sign that doubles the next consonant spelled out: that consonant (not aspirated) and a mute mark; dropped before anything else."""
    if kernel.reader(source).kind != A.INDIC:
        return found
    sign = f"cls = {A.EXCLUSIVE} AND idx = {A.ADHAK}"
    return f"""
(WITH a AS (SELECT *, lead(cls) OVER w AS cls_, lead(idx) OVER w AS idx_ FROM {found} WINDOW w AS (PARTITION BY {key} ORDER BY pos)),
b AS (SELECT *, {sign} AS sign FROM a)
SELECT {key}, pos * 2 AS pos, CASE WHEN sign AND cls_ = {A.CONSONANT} THEN cls_ WHEN sign THEN {A.EXCLUSIVE} ELSE cls END AS cls,
  CASE WHEN sign AND cls_ = {A.CONSONANT} THEN idx_ - CASE WHEN idx_ < 24 THEN idx_ % 5 % 2 ELSE 0 END WHEN sign THEN {A.SKIP} ELSE idx END AS idx, lit, one FROM b
UNION ALL SELECT {key}, pos * 2 + 1, {A.MARK}, 0, NULL, false FROM b WHERE sign AND cls_ = {A.CONSONANT})"""


def units(relation: str, key: str, text: str, source: str, mask: int = 0) -> str:
    """A query for (key, pos, cls, idx, mark, sign, accent, lit); -1 is an empty slot, class -1 verbatim text; an empty one ends it."""
    latin = kernel.reader(source).kind == A.LATIN
    joining = (A.VOWEL, A.MARK, A.OTHER, A.ACCENT) if latin else (A.MARK, A.OTHER, A.ACCENT)
    counted = A.VOWEL if latin else A.MARK
    if latin:
        joins = f"grp > 0 AND head = {A.CONSONANT} AND NOT lead_row AND n <= 1"
        mark = f"CASE WHEN cls = {A.CONSONANT} THEN CASE WHEN m IS NULL THEN 0 WHEN m = 0 THEN -1 ELSE m END ELSE -1 END"
    else:
        joins = f"grp > 0 AND NOT lead_row AND (head = {A.CONSONANT} OR head = {A.VOWEL} AND n = 0)"
        mark = "coalesce(m, -1)"
    return f"""
(WITH t0 AS (SELECT * FROM {doubled(tokens(relation, key, text, source, mask), key, source)}),
t AS (SELECT {key}, pos, cls, idx, lit FROM (SELECT *, min(CASE WHEN lit = '' THEN pos END) OVER (PARTITION BY {key}) AS stop FROM t0) WHERE stop IS NULL OR pos < stop),
g AS (SELECT *, sum(CASE WHEN cls IN ({", ".join(map(str, joining))}) THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY pos) AS grp FROM t),
h AS (SELECT *, first_value(cls) OVER w AS head, row_number() OVER w = 1 AS lead_row, sum(CASE WHEN cls = {counted} THEN 1 ELSE 0 END) OVER w AS n
  FROM g WINDOW w AS (PARTITION BY {key}, grp ORDER BY pos)),
j AS (SELECT *, ({joins}) AS joins FROM h),
s AS (SELECT {key}, grp, arg_max(idx, pos) FILTER (cls IN ({A.VOWEL}, {A.MARK})) AS m, arg_max(idx, pos) FILTER (cls = {A.OTHER}) AS o, arg_max(idx, pos) FILTER (cls = {A.ACCENT}) AS a
  FROM j WHERE joins GROUP BY {key}, grp)
SELECT j.{key}, pos, cls, idx, CASE WHEN lead_row AND j.grp > 0 THEN {mark} ELSE -1 END AS mark, CASE WHEN lead_row AND j.grp > 0 THEN coalesce(o, -1) ELSE -1 END AS sign,
  CASE WHEN lead_row AND j.grp > 0 THEN coalesce(a, -1) ELSE -1 END AS accent, lit
FROM j LEFT JOIN s ON s.{key} = j.{key} AND s.grp = j.grp WHERE NOT joins)"""


def transliterate(relation: str, key: str, text: str, source: str, target: str, mask: int = 0) -> str:
    """A query for (key, out): every text of the relation in the target script."""
    writer = kernel.writer(target, mask)
    glyphs = values([(c, i, g) for c, row in enumerate(writer.glyphs) for i, g in enumerate(row[:-1]) if g] or [(0, 0, "")])
    literal = "lit" if writer.mask & O.RETAIN_MARKERS else f"translate(lit, {quote(A.MARKERS)}, '')"
    accent = "''" if writer.mask & O.IGNORE_ACCENTS else "coalesce(ga.glyph, '')"
    if writer.kind == A.LATIN:
        sign = "coalesce(gs.glyph, '')"
        if not writer.raw[A.OTHER][1]:
            sign = f"CASE WHEN sign = 1 THEN coalesce(gn.glyph, '') ELSE {sign} END"
        body = f"concat(coalesce(gl.glyph, ''), CASE WHEN cls = {A.CONSONANT} THEN CASE WHEN mark = -1 THEN {quote(writer.glyph(A.VOWEL, 0))} WHEN mark = 0 THEN '' ELSE coalesce(gm.glyph, '') END ELSE '' END, {accent}, {sign})"
    else:
        body = f"concat(coalesce(gl.glyph, ''), coalesce(gm.glyph, ''), coalesce(gs.glyph, ''), {accent})"
    skip = f"cls = {A.EXCLUSIVE} AND u.idx = {A.SKIP}"
    return f"""
(WITH u0 AS (SELECT * FROM {units(relation, key, text, source, mask)}),
u AS (SELECT *, lead(CASE WHEN cls = -1 OR cls = {A.EXCLUSIVE} AND idx = {A.SKIP} THEN 99 ELSE idx END) OVER (PARTITION BY {key} ORDER BY pos) AS follow FROM u0),
glyphs(c, i, glyph) AS ({glyphs}),
written AS (SELECT u.{key}, pos, CASE WHEN cls = -1 THEN {literal} WHEN {skip} THEN '' ELSE {body} END AS s
  FROM u LEFT JOIN glyphs gl ON gl.c = cls AND gl.i = u.idx LEFT JOIN glyphs gm ON gm.c = {A.MARK} AND gm.i = mark
  LEFT JOIN glyphs gs ON gs.c = {A.OTHER} AND gs.i = sign LEFT JOIN glyphs ga ON ga.c = {A.ACCENT} AND ga.i = accent
  LEFT JOIN glyphs gn ON gn.c = {A.CONSONANT} AND gn.i = CASE WHEN follow < 24 THEN follow // 5 * 5 + 4 ELSE 24 END)
SELECT r.{key}, CASE WHEN r.{text} IS NULL THEN NULL ELSE coalesce(w.s, '') END AS out
FROM {relation} r LEFT JOIN (SELECT {key}, string_agg(s, '' ORDER BY pos) AS s FROM written GROUP BY {key}) w ON w.{key} = r.{key})"""
