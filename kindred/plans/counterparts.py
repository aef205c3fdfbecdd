"""DuckDB expressions that the queries of the catalogue must agree with.

Each is written from the definition of its measure, over lists: ``x`` and ``y`` hold the
bytes of a pair as hex, ``ta`` and ``tb`` its tokens. Tables are filled row by row with
``list_reduce``. All functions here give SQL text.
"""

from __future__ import annotations

from ..functions.kernels import SIMILAR
from ..functions.phonetic import NYSIIS_HEADS, NYSIIS_INNER, NYSIIS_TAILS


def styled(n: str, t: str, z: str) -> str:
    """A two-word name in one of eight writings."""
    one, two = f"split_part({n}, ' ', 1)", f"split_part({n}, ' ', -1)"
    cap = lambda w: f"upper(substr({w}, 1, 1)) || substr({w}, 2)"
    return (
        f"CASE {t} WHEN 0 THEN {n} WHEN 1 THEN replace({n}, ' ', '_') WHEN 2 THEN {one} || {cap(two)} WHEN 3 THEN {cap(one)} || {cap(two)} "
        f"WHEN 4 THEN upper(replace({n}, ' ', '-')) WHEN 5 THEN translate({n}, 'aeion', 'áéíóñ') WHEN 6 THEN {two} || ' ' || {one} ELSE replace({n}, ' ', '.') || '_' || {z}::VARCHAR END"
    )


def in_bytes(s: str) -> str:
    return f"list_transform(range(0, strlen({s})), lambda i: substr(hex(encode({s})), (2 * i + 1)::INT, 2))"


def tokens(s: str) -> str:
    """Default tokens (capitals of ASCII only)."""
    camel = rf"regexp_replace(regexp_replace({s}, '([^A-Z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')"
    return rf"list_transform(list_filter(regexp_split_to_array({camel}, '[-_.:/ \t\n\r]'), lambda x: x <> ''), lambda x: lower(x))"


def normalised(s: str) -> str:
    return rf"trim(regexp_replace(lower(regexp_replace({s}, '([a-z])([A-Z])', '\1 \2', 'g')), '[-_.:/ \t\n\r\v\f]+', ' ', 'g'))"


PAIRS = f"""WITH RECURSIVE raw AS (SELECT u.p_partkey AS k, {styled("u.p_name", "u.p_partkey % 8", "u.p_size")} AS a,
  {styled("CASE WHEN u.p_partkey % 3 = 0 THEN u.p_name ELSE v.p_name END", "(u.p_partkey // 8) % 8", "v.p_size")} AS b
  FROM part u JOIN part v ON v.p_partkey = u.p_partkey + 1),
 n AS (SELECT k, CASE WHEN k % 31 = 0 THEN '' ELSE a END AS a, CASE WHEN k % 29 = 0 THEN '' WHEN k % 23 = 0 AND k % 31 = 0 THEN '' WHEN k % 23 = 0 THEN a ELSE b END AS b FROM raw),
 p AS (SELECT k, a, b, {in_bytes("a")} AS x, {in_bytes("b")} AS y, {tokens("a")} AS ta, {tokens("b")} AS tb FROM n)
"""
#: The same with letters beyond ASCII as one byte each: the code-point forms.
RUNES = "translate({0}, 'áéíóñ', '!@$%&')"

# --- tables row by row -----------------------------------------------------------


def osa(x: str, y: str) -> str:
    return f"""list_reduce(range(1, len({x}) + 1), lambda r, i: {{'q': r.p, 'p': list_reduce(range(1, len({y}) + 1), lambda c, j: list_append(c, least(c[j] + 1, r.p[j + 1] + 1,
 r.p[j] + ({x}[i] <> {y}[j])::INT, CASE WHEN i > 1 AND j > 1 AND {x}[i] = {y}[j - 1] AND {x}[i - 1] = {y}[j] THEN r.q[j - 1] + 1 ELSE 1000000 END)), [i])}},
 {{'q': range(0, len({y}) + 1), 'p': range(0, len({y}) + 1)}}).p[len({y}) + 1]"""


def subsequence(x: str, y: str) -> str:
    return f"""list_reduce(range(1, len({x}) + 1), lambda r, i: list_reduce(range(1, len({y}) + 1), lambda c, j: list_append(c, greatest(c[j], r[j + 1], r[j] + ({x}[i] = {y}[j])::INT)), [0::BIGINT]),
 list_transform(range(0, len({y}) + 1), lambda t: 0::BIGINT))[len({y}) + 1]"""


def indel(x: str, y: str) -> str:
    return f"(CASE WHEN len({x}) + len({y}) = 0 THEN 1.0 ELSE 2.0::DOUBLE * {subsequence(x, y)} / (len({x}) + len({y}))::DOUBLE END)::DOUBLE"


def common_run(x: str, y: str) -> str:
    """struct(n, e, f): length of the longest common run, its first end in x and the first end in y of that."""
    return f"""list_reduce(range(1, len({x}) + 1), lambda r, i: list_transform([list_transform(range(1, len({y}) + 1), lambda j: CASE WHEN {x}[i] = {y}[j] THEN 1 + CASE WHEN j > 1 THEN r.c[j - 1] ELSE 0 END ELSE 0 END)],
 lambda c: {{'c': c, 'n': greatest(r.n, coalesce(list_max(c), 0)), 'e': CASE WHEN list_max(c) > r.n THEN i ELSE r.e END, 'f': CASE WHEN list_max(c) > r.n THEN list_position(c, list_max(c))::BIGINT ELSE r.f END}})[1],
 {{'c': list_transform(range(0, len({y})), lambda t: 0::BIGINT), 'n': 0::BIGINT, 'e': 0::BIGINT, 'f': 0::BIGINT}})"""


def alignment(x: str, y: str) -> str:
    """Best cell of a local alignment: match 1, mismatch -1, gap -1.5 and -0.5, all tables floored at 0."""
    cell = f"""list_transform([{{'m': greatest(0.0::DOUBLE, greatest(r.m[j], r.h[j], r.v[j]) + CASE WHEN {x}[i] = {y}[j] THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END),
 'h': greatest(0.0::DOUBLE, r.m[j + 1] - 1.5::DOUBLE, r.h[j + 1] - 0.5::DOUBLE), 'v': greatest(0.0::DOUBLE, c.m[j] - 1.5::DOUBLE, c.v[j] - 0.5::DOUBLE)}}],
 lambda t: {{'m': list_append(c.m, t.m), 'h': list_append(c.h, t.h), 'v': list_append(c.v, t.v), 'b': greatest(c.b, t.m)}})[1]"""
    zeros = f"list_transform(range(0, len({y}) + 1), lambda t: 0.0::DOUBLE)"
    return f"""list_reduce(range(1, len({x}) + 1), lambda r, i: list_reduce(range(1, len({y}) + 1), lambda c, j: {cell}, {{'m': [0.0::DOUBLE], 'h': [0.0::DOUBLE], 'v': [0.0::DOUBLE], 'b': r.b}}),
 {{'m': {zeros}, 'h': {zeros}, 'v': {zeros}, 'b': 0.0::DOUBLE}}).b"""


def guarded(inner: str) -> str:
    return f"(CASE WHEN a = b THEN 1.0 WHEN a = '' OR b = '' THEN 0.0 ELSE {inner} END)::DOUBLE"


def ratio(distance: str, a: str = "a", b: str = "b") -> str:
    return f"(CASE WHEN {a} = {b} THEN 1.0 ELSE 1.0::DOUBLE - ({distance})::DOUBLE / greatest(strlen({a}), strlen({b}))::DOUBLE END)::DOUBLE"


# --- Jaro and its kin ------------------------------------------------------------


def jaro(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = {b} THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE jaro_similarity({a}, {b}) END)::DOUBLE"


def _prefix(x: str, y: str) -> str:
    return "(CASE " + " ".join(f"WHEN least(len({x}), len({y})) >= {k} AND {x}[1:{k}] = {y}[1:{k}] THEN {k}" for k in (4, 3, 2, 1)) + " ELSE 0 END)::DOUBLE"


def jaro_winkler(a: str, b: str) -> str:
    j = jaro(a, b)
    return f"(CASE WHEN {a} = {b} THEN 1.0 WHEN {j} >= 0.7 THEN {j} + ({_prefix(in_bytes(a), in_bytes(b))} * 0.1::DOUBLE) * (1.0::DOUBLE - {j}) ELSE {j} END)::DOUBLE"


_UP = "CASE WHEN {0} BETWEEN '61' AND '7A' THEN (chr(('0x' || {0})::INT - 32)) WHEN {0} < '80' THEN chr(('0x' || {0})::INT) ELSE {0} END"
_ALIKE = "[" + ", ".join(f"'{min(p)}{max(p)}'" for p in SIMILAR) + "]"
#: p with w (window), then j (matched places in x and, in their order, in y), then u (places left over and credit of similar ones).
STRCMP = (
    PAIRS
    + f""", w AS (SELECT *, greatest(0, greatest(len(x), len(y)) // 2 - 1) AS w, list_transform(x, lambda c: {_UP.format("c")}) AS ux, list_transform(y, lambda c: {_UP.format("c")}) AS uy FROM p WHERE a <> b AND a <> '' AND b <> ''),
 j AS (SELECT *, list_reduce(range(1, len(x) + 1), lambda r, i: list_transform([list_filter(range(greatest(1, i - w), least(len(y), i + w) + 1), lambda t: y[t] = x[i] AND NOT list_contains(r.f, t))],
   lambda h: CASE WHEN len(h) > 0 THEN {{'e': list_append(r.e, i), 'f': list_append(r.f, h[1])}} ELSE r END)[1], {{'e': []::BIGINT[], 'f': []::BIGINT[]}}) AS j FROM w),
 u AS (SELECT *, len(j.e)::DOUBLE AS m, (len(list_filter(range(1, len(j.e) + 1), lambda t: x[j.e[t]] <> y[list_sort(j.f)[t]])) // 2)::DOUBLE AS t,
   list_reduce(list_filter(range(1, len(x) + 1), lambda i: NOT list_contains(j.e, i)), lambda r, i: list_transform([list_filter(r.f, lambda t: list_contains({_ALIKE}, least(ux[i], uy[t]) || greatest(ux[i], uy[t])))],
     lambda h: CASE WHEN len(h) > 0 THEN {{'f': list_filter(r.f, lambda t: t <> h[1]), 'c': r.c + 0.3::DOUBLE}} ELSE r END)[1],
     {{'f': list_filter(range(1, len(y) + 1), lambda t: NOT list_contains(j.f, t)), 'c': 0.0::DOUBLE}}).c AS c FROM j),
 s AS (SELECT *, least(1.0::DOUBLE, ((m + c) / len(x)::DOUBLE + (m + c) / len(y)::DOUBLE + ((m + c) - t) / (m + c)) / 3.0::DOUBLE) AS s0 FROM u WHERE m > 0),
 v AS (SELECT *, CASE WHEN s0 >= 0.7 THEN {_prefix("x", "y")} ELSE 0.0::DOUBLE END AS l FROM s),
 z AS (SELECT *, s0 + (l * 0.1::DOUBLE) * (1.0::DOUBLE - s0) AS s1 FROM v),
 f AS (SELECT k, least(1.0::DOUBLE, CASE WHEN least(len(x), len(y)) > 4 AND m > l + 1 AND 2 * m >= least(len(x), len(y)) + l
   THEN s1 + (1.0::DOUBLE - s1) * (m - l - 1) / ((len(x) + len(y) - 2 * l) + m) ELSE s1 END) AS s FROM z)
 SELECT p.k, p.a, p.b, (CASE WHEN p.a = p.b THEN 1.0 ELSE coalesce(f.s, 0.0) END)::DOUBLE AS value FROM p LEFT JOIN f USING (k)"""
)

# --- grams -------------------------------------------------------------------------


def grams(x: str, n: int) -> str:
    return f"list_transform(range(1, greatest(len({x}) - {n - 1}, 0) + 1), lambda i: array_to_string({x}[i:i + {n - 1}], ''))"


_COUNT = "len(list_filter({0}, lambda o: o = t))"


def gram_pairs(n: int, head: str = PAIRS, source: str = "p") -> str:
    """Adds g: the pairs with their gram lists, sizes and the number of common grams."""
    return f"""{head}, h AS (SELECT *, {grams("x", n)} AS ga, {grams("y", n)} AS gb FROM {source}),
 g AS (SELECT *, len(ga) AS na, len(gb) AS nb, coalesce(list_sum(list_transform(list_distinct(list_intersect(ga, gb)), lambda t: least({_COUNT.format("ga")}, {_COUNT.format("gb")}))), 0)::INT AS i FROM h)
"""


def gram_score(inner: str) -> str:
    return f"(CASE WHEN a = b OR (na = 0 AND nb = 0) THEN 1.0 WHEN na = 0 OR nb = 0 THEN 0.0 ELSE {inner} END)::DOUBLE"


JACCARD = gram_score("i::DOUBLE / (na + nb - i)::DOUBLE")
DICE = gram_score("2.0::DOUBLE * i::DOUBLE / (na + nb)::DOUBLE")
_NORM = "sqrt(list_sum(list_transform(list_distinct({0}), lambda t: " + _COUNT + " ** 2))::DOUBLE)"
_DOT = f"coalesce(list_sum(list_transform(list_distinct(list_intersect(ga, gb)), lambda t: {_COUNT.format('ga')} * {_COUNT.format('gb')})), 0)::DOUBLE"
COSINE = gram_score(f"least(1.0::DOUBLE, {_DOT} / ({_NORM.format('ga')} * {_NORM.format('gb')}))")


def tversky(alpha: float, beta: float) -> str:
    return gram_score(f"CASE WHEN i = 0 THEN 0.0 ELSE i::DOUBLE / (i::DOUBLE + {alpha}::DOUBLE * (na - i)::DOUBLE + {beta}::DOUBLE * (nb - i)::DOUBLE) END")


# --- tokens ------------------------------------------------------------------------

TOKEN_JACCARD = "(CASE WHEN a = b OR (len(ta) = 0 AND len(tb) = 0) THEN 1.0 ELSE len(list_distinct(list_intersect(ta, tb)))::DOUBLE / len(list_distinct(list_concat(ta, tb)))::DOUBLE END)::DOUBLE"
TOKEN_SORT = (
    PAIRS
    + f""", s AS (SELECT *, array_to_string(list_sort(ta), ' ') AS sa, array_to_string(list_sort(tb), ' ') AS sb FROM p),
 q AS (SELECT *, {in_bytes("sa")} AS u, {in_bytes("sb")} AS v FROM s) SELECT k, a, b, (CASE WHEN a = b THEN 1.0 ELSE {indel("u", "v")} END)::DOUBLE AS value FROM q"""
)
TOKEN_SET = (
    PAIRS
    + f""", s AS (SELECT *, list_sort(list_distinct(list_intersect(ta, tb))) AS c, list_sort(list_distinct(list_filter(ta, lambda t: NOT list_contains(tb, t)))) AS da, list_sort(list_distinct(list_filter(tb, lambda t: NOT list_contains(ta, t)))) AS db FROM p),
 j AS (SELECT *, array_to_string(c, ' ') AS w, trim(array_to_string(c, ' ') || ' ' || array_to_string(da, ' ')) AS wa, trim(array_to_string(c, ' ') || ' ' || array_to_string(db, ' ')) AS wb FROM s),
 q AS (SELECT *, {in_bytes("w")} AS u, {in_bytes("wa")} AS ua, {in_bytes("wb")} AS ub FROM j)
 SELECT k, a, b, (CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0 WHEN len(ta) = 0 OR len(tb) = 0 THEN 0.0 WHEN len(c) > 0 AND (len(da) = 0 OR len(db) = 0) THEN 1.0
   ELSE greatest({indel("u", "ua")}, {indel("u", "ub")}, {indel("ua", "ub")}) END)::DOUBLE AS value FROM q"""
)
#: Every window of the longer side that overlaps the shorter one; both ways where they are equally long.
PARTIAL = (
    PAIRS
    + f""", d AS (SELECT k, CASE WHEN len(x) <= len(y) THEN x ELSE y END AS s, CASE WHEN len(x) <= len(y) THEN y ELSE x END AS l FROM p WHERE a <> b AND a <> '' AND b <> ''
   UNION ALL SELECT k, y, x FROM p WHERE a <> b AND a <> '' AND len(x) = len(y)),
 o AS (SELECT k, s, l, unnest(range(2 - len(s), len(l) + 1)) AS i FROM d),
 q AS (SELECT DISTINCT k, s, l[greatest(1, i):least(len(l), i + len(s) - 1)] AS t FROM o),
 m AS (SELECT k, max({indel("s", "t")}) AS s FROM q GROUP BY k)
 SELECT k, a, b, (CASE WHEN a = b THEN 1.0 ELSE coalesce(m.s, 0.0) END)::DOUBLE AS value FROM p LEFT JOIN m USING (k)"""
)


def monge_elkan(ta: str, tb: str, inner) -> str:
    return f"(CASE WHEN a = b THEN 1.0 WHEN len({ta}) = 0 AND len({tb}) = 0 THEN 1.0 WHEN len({ta}) = 0 OR len({tb}) = 0 THEN 0.0 ELSE list_sum(list_transform({ta}, lambda s: list_max(list_transform({tb}, lambda t: {inner('s', 't')})))) / len({ta})::DOUBLE END)::DOUBLE"


#: Matching blocks, the longest first, then to its left and to its right.
RATCLIFF = (
    PAIRS
    + f""", r AS (SELECT k, x, y, {common_run("x", "y")} AS m FROM p WHERE a <> b
   UNION ALL SELECT k, x, y, {common_run("x", "y")} AS m FROM (
     SELECT k, unnest([x[1:m.e - m.n], x[m.e + 1:len(x)]]) AS x, unnest([y[1:m.f - m.n], y[m.f + 1:len(y)]]) AS y FROM r WHERE m.n > 0) WHERE len(x) > 0 AND len(y) > 0),
 t AS (SELECT k, sum(m.n)::DOUBLE AS n FROM r GROUP BY k)
 SELECT k, a, b, (CASE WHEN a = b THEN 1.0 ELSE 2.0::DOUBLE * coalesce(n, 0.0) / (len(x) + len(y))::DOUBLE END)::DOUBLE AS value FROM p LEFT JOIN t USING (k)"""
)

# --- phonetic ------------------------------------------------------------------------


def soundex(s: str) -> str:
    digit = "replace(substr('01230120022455012623010202', ascii(u) - 64, 1), '0', '')"
    return f"""rpad(list_reduce(list_transform(list_filter(string_split({s}, ''), lambda u: u <> '' AND ascii(u) < 128), lambda u: upper(u)), lambda r, u: CASE WHEN u NOT BETWEEN 'A' AND 'Z' THEN {{'o': r.o, 'l': ''}}
 WHEN r.o = '' THEN {{'o': u, 'l': {digit}}} WHEN u IN ('H', 'W') THEN r
 ELSE {{'o': r.o || CASE WHEN {digit} <> r.l THEN {digit} ELSE '' END, 'l': {digit}}} END, {{'o': '', 'l': ''}}).o[1:4],
 CASE WHEN regexp_matches({s}, '[A-Za-z]') THEN 4 ELSE 0 END, '0')"""


def _folded(s: str) -> str:
    return f"list_reduce(string_split({s}, ''), lambda r, c: CASE WHEN right(r, 1) = c THEN r ELSE r || c END, '')"


def mra(s: str) -> str:
    letters = f"upper(regexp_replace({s}, '[^A-Za-z]', '', 'g'))[1:64]"
    bare = f"{letters}[1:1] || regexp_replace({letters}[2:64], '[AEIOU]', '', 'g')"
    return f"list_transform([{_folded(bare)}], lambda m: CASE WHEN length(m) > 6 THEN m[1:3] || right(m, 3) ELSE m END)[1]"


#: p with codes, then matched and sim.
MRA = (
    PAIRS
    + f""", codes AS (SELECT k, a, b, {mra("a")} AS p, {mra("b")} AS q FROM p),
 sums AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(string_split(p, '')), lambda u: least(length(p) - length(replace(p, u, '')), length(q) - length(replace(q, u, ''))))), 0) AS common, length(p) + length(q) AS total FROM codes),
 d AS (SELECT *, CASE WHEN a = b THEN 6 WHEN p = '' OR q = '' OR abs(length(p) - length(q)) >= 3 THEN 0 ELSE greatest(0, 6 - (greatest(length(p), length(q)) - common)) END::INT AS sim FROM sums),
 e AS (SELECT *, a = b OR (p <> '' AND q <> '' AND abs(length(p) - length(q)) < 3 AND sim >= CASE WHEN total <= 4 THEN 5 WHEN total <= 7 THEN 4 WHEN total <= 11 THEN 3 ELSE 2 END) AS matched FROM d)
"""
)


def nysiis(s: str) -> str:
    """Heads, tails, steps over the rest, endings, runs folded, six characters."""
    name = f"upper(regexp_replace({s}, '[^A-Za-z]', '', 'g'))[1:128]"
    head = "CASE " + " ".join(f"WHEN starts_with(n, '{o}') THEN '{w}' || n[{len(o) + 1}:]" for o, w in NYSIIS_HEADS) + " ELSE n END"
    tail = "CASE " + " ".join(f"WHEN suffix(n, '{o}') THEN n[1:length(n) - 2] || '{w}'" for o, w in NYSIIS_TAILS) + " ELSE n END"
    step = "CASE WHEN t = 'W' AND right(r, 1) IN ('A', 'E', 'I', 'O', 'U') THEN r ELSE r || CASE t " + " ".join(f"WHEN '{o}' THEN '{w}'" for o, w in NYSIIS_INNER.items()) + " ELSE t END END"
    steps = f"list_reduce(regexp_extract_all(n[2:], 'SCH|EV|KN|PH|.'), lambda r, t: {step}, n[1:1])"
    let = lambda value, body: f"list_transform([{value}], lambda n: {body})[1]"
    cut = lambda c: f"CASE WHEN length(n) > 1 AND suffix(n, '{c}') THEN n[1:length(n) - 1] ELSE n END"
    ay = "CASE WHEN suffix(n, 'AY') THEN n[1:length(n) - 2] || 'Y' ELSE n END"
    out = let(let(let(let(let(let(name, head), tail), steps), cut("S")), ay), cut("A"))
    return let(out, f"({_folded('n')})[1:6]")


# --- scans ------------------------------------------------------------------------------

_LEV = "CASE WHEN p = q THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein(p, q)::DOUBLE / greatest(strlen(p), strlen(q))::DOUBLE END"
#: Two measures of equal weight over normalised names; {items} gives name, grp, norm, idx, silent, tag.
SCAN = (
    """WITH i AS ({items}),
 z AS (SELECT *, count(*) OVER (PARTITION BY grp) AS gsize, count(*) OVER () AS total, """
    + "list_distinct(" + tokens("norm") + ")"
    + """ AS tok FROM i),
 l AS (SELECT * FROM z WHERE NOT silent),
 c AS (SELECT 1 AS k, a.name AS na, b.name AS nb, a.grp AS ga, b.grp AS gb, a.norm AS p, b.norm AS q, a.tok AS tp, b.tok AS tq, a.tag AS xa, b.tag AS xb FROM l a JOIN l b ON a.grp = b.grp AND a.idx < b.idx
   WHERE a.gsize <= 50 OR len(list_intersect(a.tok, b.tok)) > 0
 {cross}),
 s AS (SELECT *, 0.5::DOUBLE * (len(list_intersect(tp, tq))::DOUBLE / len(list_distinct(list_concat(tp, tq)))::DOUBLE) + (0.5::DOUBLE * ("""
    + _LEV
    + """) + 0.0::DOUBLE) AS score FROM c)
 SELECT CASE WHEN k = 1 THEN 'WithinGroup' ELSE 'AcrossGroups' END AS kind, least(na, nb) AS name_a, greatest(na, nb) AS name_b,
  CASE WHEN na > nb THEN gb ELSE ga END AS group_a, CASE WHEN na > nb THEN ga ELSE gb END AS group_b, CASE WHEN na > nb THEN xb ELSE xa END AS tag_a, CASE WHEN na > nb THEN xa ELSE xb END AS tag_b, score
 FROM s WHERE score >= CASE WHEN k = 1 THEN {within} ELSE {across} END {more}"""
)
CROSS = """UNION ALL SELECT 2, a.name, b.name, a.grp, b.grp, a.norm, b.norm, a.tok, b.tok, a.tag, b.tag FROM l a JOIN l b ON a.grp < b.grp
   WHERE (a.total <= 50 OR len(list_intersect(a.tok, b.tok)) > 0) {same}"""
PART_ITEMS = "SELECT p_name AS name, p_brand AS grp, lower(trim(p_name)) AS norm, min(p_partkey) AS idx, {silent} AS silent, min(p_partkey)::VARCHAR AS tag FROM part GROUP BY p_name, p_brand"
NATION_ITEMS = "SELECT n_name AS name, n_regionkey::VARCHAR AS grp, " + normalised("n_name") + " AS norm, n_nationkey AS idx, false AS silent, n_nationkey::VARCHAR AS tag FROM nation"


def scan(items: str = PART_ITEMS.format(silent="false"), cross: str = "", more: str = "", within: float = 0.6, across: float = 0.65) -> str:
    return SCAN.format(items=items, cross=cross, more=more, within=within, across=across)
