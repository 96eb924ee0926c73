"""DuckDB SQL of the pseudonyms: the same permutation over a table of finds, round by round."""

from __future__ import annotations

from .pii import _STYLES, ANY, CLASSES, COUNTRY, DAYS, PATTERNS, ROUNDS, SECRET_FRONT, SIGNS


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _hex(digest: str, at: str) -> str:
    """The number of four hexadecimal digits of a digest from place `at` on."""
    digits = (f"(instr('0123456789abcdef', substr({digest}, {at} + {k}, 1)) - 1) * {16 ** (3 - k)}" for k in range(4))
    return "(" + " + ".join(digits) + ")"


def _luhn(digits: str) -> str:
    """The Luhn sum of a digit string whose last digit is the check digit."""
    d = f"substr({digits}, i, 1)::int"
    twice = f"CASE WHEN {d} > 4 THEN {d} * 2 - 9 ELSE {d} * 2 END"
    each = f"CASE WHEN (length({digits}) - i) % 2 = 1 THEN {twice} ELSE {d} END"
    return f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: {each}))"


def _mod97(text: str) -> str:
    codes = f"list_prepend(0, list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))))"
    return f"list_reduce({codes}, lambda a, c: CASE WHEN c < 58 THEN (a * 10 + c - 48) % 97 ELSE (a * 100 + c - 55) % 97 END)"


def _rounds(key: str, state: str) -> tuple[str, str]:
    """Tables of ten rounds over (kind, v, radix, half), and the name of the last."""
    tables, mine = [], state
    for r in range(ROUNDS):
        other, turn = ("v[half + 1:]", "j <= half") if r % 2 == 0 else ("v[:half]", "j > half")
        digest = "(CASE WHEN j <= 16 THEN h ELSE sha256(h || '|' || ((j - 1) // 16)::varchar) END)"
        tables.append(f"""
    {state}_h{r} AS (SELECT * EXCLUDE (h), sha256({_quoted(key)} || '|' || kind || '|{r}|' || array_to_string({other}, ',')) AS h FROM {mine}),
    {state}_{r} AS (SELECT * EXCLUDE (v), list_transform(range(1, len(v) + 1), lambda j:
        CASE WHEN {turn} THEN (v[j] + {_hex(digest, "1 + ((j - 1) % 16) * 4")}) % radix[j] ELSE v[j] END) AS v FROM {state}_h{r}),""")
        mine = f"{state}_{r}"
    return "".join(tables), mine


def pseudonym_sql(key: str) -> str:
    kinds = " ".join(f"WHEN regexp_full_match(m, {_quoted(p)}) THEN '{k}'" for k, p in PATTERNS.items())
    only_digits = "regexp_replace({}, '[^0-9]', '', 'g')"
    styles = [(f"WHEN regexp_matches(m, {_quoted(p)})", _quoted(s)) for p, _, s in _STYLES]
    parsed = "CASE " + " ".join(f"{w} THEN try_strptime(rtrim(m, 'T'), {s})" for w, s in styles) + " END::date"
    spelled = "CASE " + " ".join(f"{w} THEN strftime(d, {s})" for w, s in styles) + " END || CASE WHEN m LIKE '%T' THEN 'T' ELSE '' END"
    phone = "kind = 'phone' AND c BETWEEN 48 AND 57"
    base = f"CASE WHEN {phone} AND c >= 50 THEN 50 " + " ".join(f"WHEN c >= {first} THEN {first}" for first, _ in CLASSES) + " END"
    radix = f"CASE WHEN {phone} AND c >= 50 THEN 8 WHEN {phone} THEN 2 " + " ".join(
        f"WHEN c >= {first} THEN " + ("CASE WHEN hexed THEN 6 ELSE 26 END" if count == 26 else str(count)) for first, count in CLASSES
    ) + " END"
    turned = "replace(substr({0}, 5), ' ', '') || substr({0}, 1, 2) || {1}"
    first, once = _rounds(key, "one")
    second, twice = _rounds(key, "two")
    number = "v[1] * radix[2] + v[2]"
    return rf"""
    WITH split AS (
        SELECT doc_id, text, regexp_extract_all(text, {_quoted(f"({ANY})")}, 1) AS ms, string_split_regex(text, {_quoted(ANY)}) AS parts
        FROM documents),
    finds AS (SELECT doc_id, generate_subscripts(ms, 1) AS pos, unnest(ms) AS m FROM split),
    kinds AS (SELECT *, CASE {kinds} END AS kind FROM finds),
    parsed AS (
        SELECT *, CASE kind WHEN 'date' THEN {parsed} END AS d,
               CASE kind WHEN 'ssn' THEN [substr(m, 1, 3)::int, substr(m, 5, 2)::int, substr(m, 8, 4)::int] END AS a,
               length(regexp_extract(m, {_quoted(SECRET_FRONT)})) AS front
        FROM kinds),
    valid AS (
        SELECT * FROM parsed
        WHERE coalesce(CASE kind WHEN 'date' THEN d IS NOT NULL
                   WHEN 'ssn' THEN a[1] > 0 AND a[1] <> 666 AND a[1] < 900 AND a[2] > 0 AND a[3] > 0
                   WHEN 'card' THEN {_luhn(only_digits.format("m"))} % 10 = 0
                   WHEN 'iban' THEN {_mod97("(" + turned.format("m", "substr(m, 3, 2)") + ")")} = 1 ELSE true END, false)),
    units AS (
        SELECT *, CASE kind WHEN 'secret' THEN front WHEN 'phone' THEN length(regexp_extract(m, {_quoted(COUNTRY)})) WHEN 'iban' THEN 4 ELSE 0 END AS low,
               CASE WHEN kind = 'email' THEN instr(m, '@') - 1 WHEN kind = 'card' THEN length(m) - 1
                    WHEN kind = 'secret' AND m LIKE '-----%' THEN instr(m, '-----END') - 1 ELSE length(m) END AS high,
               kind = 'ipv6' OR kind = 'secret' AND regexp_matches(substr(m, front + 1), '^(?:[0-9a-f]+|[0-9A-Fa-f]{{32,}})$') AS hexed
        FROM valid
        UNION ALL
        SELECT * REPLACE ('domain' AS kind), instr(m, '@') AS low,
               instr(m, '@') + length(regexp_extract(substr(m, instr(m, '@') + 1), '^(.*)[.]', 1)) AS high, false AS hexed
        FROM valid WHERE kind = 'email'),
    coded AS (
        SELECT *, list_filter(range(low + 1, high + 1), lambda i: regexp_matches(substr(m, i, 1), '[{SIGNS}]')) AS spots FROM units),
    based AS (SELECT *, list_transform(spots, lambda i: ascii(substr(m, i, 1))) AS code FROM coded),
    rated AS (
        SELECT *, list_transform(code, lambda c: {base}) AS base, list_transform(code, lambda c: {radix}) AS radii FROM based),
    given AS (
        SELECT *, CASE kind WHEN 'ip' THEN list_transform(string_split(m, '.'), lambda x: x::bigint)
                   WHEN 'date' THEN [date_diff('day', date '1900-01-01', d) // {DAYS[1]}, date_diff('day', date '1900-01-01', d) % {DAYS[1]}]
                   WHEN 'ssn' THEN [(a[1] - CASE WHEN a[1] > 666 THEN 2 ELSE 1 END)::bigint, (a[2] - 1)::bigint, (a[3] - 1)::bigint]
                   ELSE list_transform(range(1, len(code) + 1), lambda j: (code[j] - base[j])::bigint) END AS v0,
               CASE kind WHEN 'ip' THEN [256, 256, 256, 256] WHEN 'date' THEN [{DAYS[0]}, {DAYS[1]}] WHEN 'ssn' THEN [898, 99, 9999]
                   ELSE radii END AS r0
        FROM rated),
    one AS (
        SELECT *, CASE WHEN len(v0) = 1 THEN [v0[1] // ((r0[1] + 1) // 2), v0[1] % ((r0[1] + 1) // 2)] ELSE v0 END AS v,
               CASE WHEN len(v0) = 1 THEN [2, (r0[1] + 1) // 2] ELSE r0 END AS radix,
               CASE WHEN len(v0) = 1 THEN 1 ELSE len(v0) // 2 END AS half, '' AS h
        FROM given WHERE len(v0) > 0),{first}
    two AS (SELECT * FROM {once} WHERE len(v0) = 1 AND {number} >= r0[1]),{second}
    permuted AS (
        SELECT * REPLACE (CASE WHEN len(v0) = 1 THEN [{number}] ELSE v END AS v) FROM {once} WHERE NOT (len(v0) = 1 AND {number} >= r0[1])
        UNION ALL SELECT * REPLACE ([{number}] AS v) FROM {twice}),
    moved AS (
        SELECT * REPLACE (CASE kind WHEN 'date' THEN (date '1900-01-01' + (v[1] * {DAYS[1]} + v[2])::int)::date END AS d),
               CASE WHEN kind IN ('ip', 'date', 'ssn') THEN '' ELSE
                   array_to_string(list_transform(range(1, length(m) + 1), lambda i: CASE WHEN list_contains(spots, i) THEN
                   chr((v[list_position(spots, i)] + base[list_position(spots, i)])::int) ELSE substr(m, i, 1) END), '') END AS chars
        FROM permuted),
    tested AS (
        SELECT *, {only_digits.format("left(chars, length(chars) - 1)")} || '0' AS trial, {turned.format("chars", "'00'")} AS turned FROM moved),
    new AS (
        SELECT doc_id, pos, m, kind, CASE kind WHEN 'ip' THEN array_to_string(v, '.') WHEN 'date' THEN {spelled}
                   WHEN 'ssn' THEN printf('%03d', v[1] + CASE WHEN v[1] > 664 THEN 2 ELSE 1 END) || substr(m, 4, 1) || printf('%02d', v[2] + 1)
                       || substr(m, 4, 1) || printf('%04d', v[3] + 1)
                   WHEN 'card' THEN left(chars, length(chars) - 1) || ((10 - {_luhn("trial")} % 10) % 10)::varchar
                   WHEN 'iban' THEN substr(chars, 1, 2) || lpad((98 - {_mod97("turned")})::varchar, 2, '0') || substr(chars, 5)
                   ELSE chars END AS p
        FROM tested),
    whole AS (
        SELECT doc_id, pos, CASE WHEN bool_or(kind IN ('email', 'domain')) THEN
                   left(coalesce(any_value(p) FILTER (kind = 'email'), any_value(m)), any_value(instr(m, '@')))
                   || substr(coalesce(any_value(p) FILTER (kind = 'domain'), any_value(m)), any_value(instr(m, '@')) + 1)
               ELSE any_value(p) END AS p
        FROM new GROUP BY doc_id, pos),
    pieces AS (
        SELECT f.doc_id, string_agg(s.parts[f.pos] || coalesce(p, f.m), '' ORDER BY f.pos) AS front
        FROM finds f JOIN split s USING (doc_id) LEFT JOIN whole USING (doc_id, pos) GROUP BY f.doc_id)
    SELECT doc_id, CASE WHEN len(ms) > 0 THEN front || parts[len(parts)] ELSE text END AS text, coalesce(len(ms), 0) AS n_found
    FROM split LEFT JOIN pieces USING (doc_id)"""
