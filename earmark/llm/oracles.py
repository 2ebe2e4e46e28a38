"""DuckDB SQL of queries that SQL can express."""

from __future__ import annotations

#: CTEs ``octets`` (values of hexadecimal bytes) and ``crc`` (the table of CRC-32), made by their rules, and an expression on text.
CRC_TABLES = """
bits(b, k, x) AS (
    SELECT range, 0, range::BIGINT FROM range(256)
    UNION ALL SELECT b, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(x ORDER BY b) AS t FROM bits WHERE k = 8)"""


def crc32(text: str) -> str:
    """CRC-32 of an expression's UTF-8 bytes, where table ``crc`` is joined."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce({octets}, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


MIXING = r"""
WITH d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
           (('0x' || substr(md5(concat(coalesce(doc_id::VARCHAR, ''), ':', coalesce(text, ''))), 1, 13))::BIGINT + 0.5::DOUBLE)
               / 4503599627370496::DOUBLE AS u
    FROM documents),
s AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
    FROM d GROUP BY source),
-- sources by the level at which they are full; those before a source are full when it is not
f AS (
    SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS want,
           coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_size,
           sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
    FROM s),
l AS (
    SELECT min((want - 2::DOUBLE * full_size) / open_w) AS level FROM f
    WHERE (want - 2::DOUBLE * full_size) / open_w * w <= 2::DOUBLE * source_size
      AND open_w = (SELECT max(open_w) FROM f WHERE (want - 2::DOUBLE * full_size) / open_w * w <= 2::DOUBLE * source_size)),
t AS (SELECT source, source_size, least(2::DOUBLE * source_size, w * level) AS target FROM s, l),
c AS (
    SELECT d.*, source_size, target, least(2::DOUBLE, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS e
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (
    SELECT *, floor(e)::BIGINT AS whole, e - floor(e) AS part,
           target - sum(floor(e)::BIGINT * size) OVER (PARTITION BY source) AS missing
    FROM c),
o AS (
    SELECT *, sum(size) OVER (PARTITION BY source ORDER BY CASE WHEN part > 0 THEN u / (1 - u) / (part / (1 - part)) END NULLS LAST, doc_id NULLS FIRST, size
                              ROWS UNBOUNDED PRECEDING) AS upto
    FROM p)
SELECT doc_id, size, source_size, target,
       ((whole + CASE WHEN part > 0 AND upto - size / 2::DOUBLE <= missing THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM o"""


def _add(state: str, cost: int, letter: str, line: str | None = None, cut: str = "0") -> str:
    out = f"{state}.o" if line is None else f"{state}.o || chr(10) || {line}"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost} + {cut}, 'a': {state}.a || '{letter}', 'o': {out}}} END"


def _least(*cases: str) -> str:
    return f"list_sort(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL))[1]"


def _closed(select: str, extra: str = "") -> str:
    """States 0 to 3 of ``select`` with insertions allowed."""
    user, assistant = "'user:'", "'assistant:'"
    two = _least("s2", *[_add(f"s{q}", 2, "I", user) for q in (0, 1, 3)])
    return f"""SELECT {extra} s0, s1, s2, {_least('s3', _add('s2', 2, 'I', assistant))} AS s3
        FROM (SELECT {extra} s0, s1, {two} AS s2, s3 FROM ({select}))"""


def _repair() -> str:
    own = "f.role || ':' || f.text"
    may = "f.kind < 2"

    def keep(q, role):
        return f"CASE WHEN {may} AND left(f.role, 1) = '{role}' THEN {_add(f'r.s{q}', 0, 'K', own, 'f.kind')} END"

    def rewrite(q, role):
        return f"CASE WHEN {may} THEN {_add(f'r.s{q}', 2, 'R', f"'{role}:' || f.text", 'f.kind')} END"

    def gone(q):
        return _add(f"r.s{q}", 3, "D")

    step = f"""SELECT r.c AS c, f.i AS i, {gone(0)} AS s0, {_least(gone(1), keep(0, 's'))} AS s1,
        {_least(gone(2), *[x for q in (0, 1, 3) for x in (keep(q, 'u'), rewrite(q, 'user'))])} AS s2,
        {_least(gone(3), keep(2, 'a'), rewrite(2, 'assistant'))} AS s3
        FROM r JOIN faults f ON f.c = r.c AND f.i = r.i + 1"""
    none = "NULL::STRUCT(c BIGINT, a VARCHAR, o VARCHAR)"
    first = f"""SELECT c, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'o': ''}} AS s0, {none} AS s1, {none} AS s2, {none} AS s3 FROM convs"""
    code = crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")
    blank = r"NOT regexp_matches(text, '[^\x20\x09-\x0D]')"
    return f"""
WITH RECURSIVE {CRC_TABLES.strip()},
convs AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id NULLS FIRST) AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
coded AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {code} % 20 AS code
    FROM conversations, crc),
hurt AS (
    SELECT c, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
           CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS again
    FROM coded JOIN convs ON coded.conv_id IS NOT DISTINCT FROM convs.conv_id WHERE code <> 0),
ordered AS (
    SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM hurt),
faults AS (
    SELECT c, turn, i, role, text,
           CASE WHEN {blank} THEN 3 WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 2
                WHEN rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))[-1] NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS kind,
           coalesce(lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal
    FROM ordered),
r AS (
    {_closed(first, 'c, i,')}
    UNION ALL
    {_closed(step, 'c, i,')}),
ends AS (
    SELECT c, {_least('s0', 's3')} AS e FROM r JOIN (SELECT c, max(i) AS n FROM faults GROUP BY c) USING (c) WHERE i = n),
sums AS (
    SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 3) AS blank,
           count(*) FILTER (kind = 2) AS duplicate, count(*) FILTER (kind = 1) AS truncated, count(*) FILTER (illegal) AS illegal
    FROM faults GROUP BY c)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.c, 0)::BIGINT AS cost, coalesce(e.a, '') AS audit,
       sha256(coalesce(substr(e.o, 2), '')) AS repaired_sha256
FROM convs LEFT JOIN sums USING (c) LEFT JOIN ends USING (c)"""


REPAIR = _repair()


def _spelling() -> str:
    # DuckDB compares bytes, so every letter of the range gets a byte of its own
    wide = "".join(chr(c) for c in range(0xC0, 0x100))
    narrow = "".join(chr(c) for c in range(33, 127) if not chr(c).islower() and chr(c) != "'")[:64]
    code = crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")
    return f"""
WITH RECURSIVE {CRC_TABLES.strip()},
runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
    FROM documents),
coded AS (SELECT run, times, {code} AS h FROM (SELECT doc_id, run, count(*) AS times FROM runs GROUP BY ALL), crc),
words AS (
    SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM coded),
v AS (
    SELECT word, sum(times)::BIGINT AS n, translate(word, '{wide}', '{narrow}') AS b FROM words
    WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
-- words one edit apart share a string with one letter less, or one is such a string of the other
k AS (SELECT DISTINCT word, n, b, unnest([b] || list_transform(range(length(b)), lambda i: b[:i] || b[i + 2:])) AS k FROM v),
near AS (
    SELECT DISTINCT x.word, x.n, y.word AS near, y.n AS near_n FROM k x JOIN k y USING (k)
    WHERE x.word <> y.word AND levenshtein(x.b, y.b) = 1),
best AS (
    SELECT word, count(*) AS n_near, max(near_n) AS top, arg_min(near, [-near_n, row_number]) AS near
    FROM (SELECT *, row_number() OVER (ORDER BY near) AS row_number FROM near) GROUP BY word),
forms AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * n THEN near END AS form, CASE WHEN top >= 2 * n THEN top END AS form_n
    FROM v LEFT JOIN best USING (word)),
chain AS (
    SELECT word, word AS at, form AS ahead FROM forms
    UNION ALL SELECT chain.word, forms.word, forms.form FROM chain JOIN forms ON forms.word = chain.ahead)
SELECT forms.word, form, chain.at AS root, n, n_near, form_n FROM forms JOIN chain ON chain.word = forms.word AND chain.ahead IS NULL"""


SPELLING = _spelling()
