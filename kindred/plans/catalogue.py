"""Queries over the driver's tables, one per operator, with the SQL that must agree.

Pairs are the names of neighbouring parts in eight writings (spaces, snake, camel and Pascal
case, capitals, accents, turned round, numbered), some equal and some with an empty side:
one pair a part, joined on the part's key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import similarity as sim
from ..functions.text import NormalisationOptions, grams, normalise, tokenise
from ..operators import scan
from ..operators.scorer import Scorer, ScorerBuilder, default_scorer, default_scorer_builder
from ..operators.validate import algorithm_name, kind_name, validate
from ..sources import items_from
from . import counterparts as C
from . import recorded as R

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name] = run
    ORACLE_SQL[name] = sql


# --- pairs -------------------------------------------------------------------------


def styled(n: Column, t: Column, z: Column) -> Column:
    """A two-word name in one of eight writings."""
    one, two = F.substring_index(n, " ", 1), F.substring_index(n, " ", -1)
    cap = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))
    forms = [
        n, F.replace(n, F.lit(" "), F.lit("_")), F.concat(one, cap(two)), F.concat(cap(one), cap(two)), F.upper(F.replace(n, F.lit(" "), F.lit("-"))),
        F.translate(n, "aeion", "áéíóñ"), F.concat(two, F.lit(" "), one), F.concat(F.replace(n, F.lit(" "), F.lit(".")), F.lit("_"), z.cast("string")),
    ]
    out = F.when(t == 0, forms[0])
    for i, f in enumerate(forms[1:-1], 1):
        out = out.when(t == i, f)
    return out.otherwise(forms[-1])


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, a, b): the names of part k and of the next one, or of part k twice, each in its writing."""
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("n"), F.col("p_size").alias("z"))
    nxt = part.select((F.col("k") - 1).alias("k"), F.col("n").alias("m"), F.col("z").alias("y"))
    k = F.col("k")
    both = part.join(nxt, "k").select(
        "k", styled(F.col("n"), k % 8, F.col("z")).alias("a"), styled(F.when(k % 3 == 0, F.col("n")).otherwise(F.col("m")), F.floor(k / 8) % 8, F.col("y")).alias("b")
    )
    a = F.when(k % 31 == 0, F.lit("")).otherwise(F.col("a"))
    return both.select("k", a.alias("a"), F.when(k % 29 == 0, F.lit("")).when(k % 23 == 0, a).otherwise(F.col("b")).alias("b"))


def _pairs(name: str, column: Callable[[Column, Column], Column], sql: str) -> None:
    """``column`` of every pair; ``sql`` is an expression over p or a whole statement."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return name_pairs(spark, sf_dir).select("k", "a", "b", column(F.col("a"), F.col("b")).alias("value"))

    _add(name, run, sql if sql.startswith("WITH") else f"{C.PAIRS} SELECT k, a, b, {sql} AS value FROM p")


def _runes(f: Callable) -> Callable:
    return lambda a, b: f(a, b, runes=True)


_ra, _rb = C.RUNES.format("a"), C.RUNES.format("b")
_LEV, _DAM = "levenshtein({0}, {1})::INT", "damerau_levenshtein({0}, {1})::INT"
_HAM = "(CASE WHEN {0} = {1} THEN 0 WHEN strlen({0}) = strlen({1}) THEN hamming({0}, {1}) ELSE greatest(strlen({0}), strlen({1})) END)::INT"
_HAMS = "(CASE WHEN {0} = {1} THEN 1.0 WHEN strlen({0}) <> strlen({1}) THEN 0.0 ELSE 1.0::DOUBLE - hamming({0}, {1})::DOUBLE / strlen({0})::DOUBLE END)::DOUBLE"
_pairs("levenshtein_distance", sim.levenshtein_distance, _LEV.format("a", "b"))
_pairs("levenshtein_distance_runes", _runes(sim.levenshtein_distance), _LEV.format(_ra, _rb))
_pairs("levenshtein_score", sim.levenshtein_score, C.ratio("levenshtein(a, b)"))
_pairs("levenshtein_score_runes", _runes(sim.levenshtein_score), C.ratio(f"levenshtein({_ra}, {_rb})", _ra, _rb))
_pairs("damerau_full_distance", sim.damerau_distance, _DAM.format("a", "b"))
_pairs("damerau_full_distance_runes", _runes(sim.damerau_distance), _DAM.format(_ra, _rb))
_pairs("damerau_full_score", sim.damerau_score, C.ratio("damerau_levenshtein(a, b)"))
_pairs("damerau_full_score_runes", _runes(sim.damerau_score), C.ratio(f"damerau_levenshtein({_ra}, {_rb})", _ra, _rb))
_pairs("hamming_distance", sim.hamming_distance, _HAM.format("a", "b"))
_pairs("hamming_distance_runes", _runes(sim.hamming_distance), _HAM.format(_ra, _rb))
_pairs("hamming_score", sim.hamming_score, _HAMS.format("a", "b"))
_pairs("hamming_score_runes", _runes(sim.hamming_score), _HAMS.format(_ra, _rb))
_pairs("jaro_score", sim.jaro_score, C.jaro("a", "b"))
_pairs("jaro_score_runes", _runes(sim.jaro_score), C.jaro(_ra, _rb))
_pairs("jaro_winkler_score", sim.jaro_winkler_score, C.jaro_winkler("a", "b"))
_pairs("jaro_winkler_score_runes", _runes(sim.jaro_winkler_score), C.jaro_winkler(_ra, _rb))
_pairs("strcmp95_score", sim.strcmp95_score, C.STRCMP)

# code points as lists, for the rune forms of the measures that are tables
_ON_RUNES = C.PAIRS + ", cp AS (SELECT k, a, b, list_filter(string_split(a, ''), lambda t: t <> '') AS x, list_filter(string_split(b, ''), lambda t: t <> '') AS y FROM p)"


def _tables(name: str, f: Callable, sql: str) -> None:
    """A measure on bytes and, as ``<name>_runes``, on code points; ``sql`` is over x and y."""
    _pairs(name, f, f"{C.PAIRS} SELECT k, a, b, {sql} AS value FROM p")
    _pairs(f"{name}_runes", _runes(f), f"{_ON_RUNES} SELECT k, a, b, {sql} AS value FROM cp")


_long = "greatest(len(x), len(y))::DOUBLE"
_tables("osa_distance", sim.osa_distance, f"({C.osa('x', 'y')})::INT")
_tables("osa_score", sim.osa_score, f"(CASE WHEN a = b THEN 1.0 ELSE 1.0::DOUBLE - ({C.osa('x', 'y')})::DOUBLE / {_long} END)::DOUBLE")
_tables("smith_waterman_gotoh_score", sim.smith_waterman_gotoh_score, C.guarded(f"least(1.0::DOUBLE, {C.alignment('x', 'y')} / least(len(x), len(y))::DOUBLE)"))
_tables("smith_waterman_gotoh_raw_score", sim.smith_waterman_gotoh_raw_score, f"(CASE WHEN a = b THEN len(x) WHEN a = '' OR b = '' THEN 0.0 ELSE {C.alignment('x', 'y')} END)::DOUBLE")
_tables("lcs_str_score", sim.lcs_str_score, C.guarded(f"2.0::DOUBLE * ({C.common_run('x', 'y')}).n / (len(x) + len(y))::DOUBLE"))
_pairs("longest_common_substring_runes", _runes(sim.longest_common_substring), f"{_ON_RUNES}, m AS (SELECT *, {C.common_run('x', 'y')} AS m FROM cp) SELECT k, a, b, CASE WHEN m.n = 0 THEN '' ELSE array_to_string(x[m.e - m.n + 1:m.e], '') END AS value FROM m")
_pairs("ratcliff_obershelp_score", sim.ratcliff_obershelp_score, C.RATCLIFF)

# --- grams -----------------------------------------------------------------------------
for _name, _f, _sql in (
    ("q_gram_jaccard_score", sim.q_gram_jaccard_score, C.JACCARD), ("sorensen_dice_score", sim.sorensen_dice_score, C.DICE), ("cosine_score", sim.cosine_score, C.COSINE),
    ("tversky_score", lambda a, b, runes=False: sim.tversky_score(a, b, 3, 0.75, 0.25, runes), C.tversky(0.75, 0.25)),
):
    _pairs(_name, _f, f"{C.gram_pairs(3)} SELECT k, a, b, {_sql} AS value FROM g")
    _pairs(f"{_name}_runes", _runes(_f), f"{C.gram_pairs(3, _ON_RUNES, 'cp')} SELECT k, a, b, {_sql} AS value FROM g")

# --- tokens ----------------------------------------------------------------------------
_pairs("token_jaccard_score", sim.token_jaccard_score, C.TOKEN_JACCARD)
_pairs("token_sort_ratio_score", sim.token_sort_ratio_score, C.TOKEN_SORT)
_pairs("token_set_ratio_score", sim.token_set_ratio_score, C.TOKEN_SET)
_pairs("partial_ratio_score", sim.partial_ratio_score, C.PARTIAL)
_one, _two = C.monge_elkan("ta", "tb", C.jaro_winkler), C.monge_elkan("tb", "ta", C.jaro_winkler)
_pairs("monge_elkan_score_asymmetric", sim.monge_elkan_score_asymmetric, _one)
_pairs("monge_elkan_score", sim.monge_elkan_score, f"(({_one}) + ({_two})) / 2.0::DOUBLE")

# --- phonetic --------------------------------------------------------------------------
_pairs("soundex_score", sim.soundex_score, f"(CASE WHEN a = b OR ({C.soundex('a')} = {C.soundex('b')} AND {C.soundex('a')} <> '') THEN 1.0 ELSE 0.0 END)::DOUBLE")
_pairs("nysiis_score", sim.nysiis_score, f"(CASE WHEN a = b OR ({C.nysiis('a')} = {C.nysiis('b')} AND {C.nysiis('a')} <> '') THEN 1.0 ELSE 0.0 END)::DOUBLE")
_pairs("mra_score", sim.mra_score, f"{C.MRA} SELECT k, a, b, (CASE WHEN matched THEN 1.0 ELSE 0.0 END)::DOUBLE AS value FROM e")
_pairs("mra_compare_similarity", lambda a, b: sim.mra_compare(a, b)["sim"], f"{C.MRA} SELECT k, a, b, sim AS value FROM e")
_pairs("mra_compare_matched", lambda a, b: sim.mra_compare(a, b)["matched"], f"{C.MRA} SELECT k, a, b, matched AS value FROM e")


def _values(rows: tuple, names: str) -> str:
    cell = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v).lower() if isinstance(v, bool) else f"{v!r}::DOUBLE"
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({names})"


def _metaphone(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r[0],) for r in R.METAPHONE], "s string")


def double_metaphone_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the recorded words."""
    return _metaphone(spark).withColumn("d", sim.double_metaphone_keys("s")).select("s", "d.primary", "d.secondary")


def double_metaphone_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of the recorded words that share their number of characters."""
    w = _metaphone(spark)
    x, y = w.select(F.length("s").alias("n"), F.col("s").alias("a")), w.select(F.length("s").alias("n"), F.col("s").alias("b"))
    return x.join(y, "n").select("a", "b", sim.double_metaphone_score("a", "b").alias("value"))


_add("double_metaphone_keys", double_metaphone_keys, f'SELECT s, p AS "primary", q AS secondary FROM {_values(R.METAPHONE, "s, p, q")}')
_add("double_metaphone_score", double_metaphone_score, f"""WITH w AS (SELECT * FROM {_values(R.METAPHONE, "s, p, q")})
 SELECT x.s AS a, y.s AS b, (CASE WHEN x.s = y.s OR (x.p <> '' AND x.p IN (y.p, y.q)) OR (x.q <> '' AND x.q IN (y.p, y.q)) THEN 1.0 ELSE 0.0 END)::DOUBLE AS value FROM w x JOIN w y ON length(x.s) = length(y.s)""")

# --- texts -----------------------------------------------------------------------------


def _texts(name: str, column: Callable[[Column], Column], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        urls = _table(spark, sf_dir, "pages").select(F.col("url").alias("s"))
        names = _table(spark, sf_dir, "customer").select(F.col("c_name").alias("s"))
        return urls.unionByName(names).unionByName(name_pairs(spark, sf_dir).select(F.col("a").alias("s"))).distinct().select("s", column(F.col("s")).alias("value"))

    _add(name, run, f"{C.PAIRS} SELECT s, {sql} AS value FROM (SELECT url AS s FROM pages UNION SELECT c_name FROM customer UNION SELECT a FROM p)")


def _joined(c: Column) -> Column:
    return F.array_join(c, "|")


_texts("normalise", normalise, C.normalised("s"))
_texts("normalise_options", lambda s: normalise(s, NormalisationOptions(lowercase=False, separator_chars="/:", split_camel_case=False, strip_diacritics=True)), r"translate(trim(regexp_replace(s, '[/: \t\n\r\v\f]+', ' ', 'g')), 'áéíóñ', 'aeion')")
_texts("tokenise", lambda s: _joined(tokenise(s)), f"array_to_string({C.tokens('s')}, '|')")
_texts("q_grams", lambda s: _joined(grams(s, 3)), "array_to_string(list_transform(range(1, greatest(length(s) - 2, 0) + 1), lambda i: substr(s, i, 3)), '|')")
_texts("soundex_code", sim.soundex_code, C.soundex("s"))
_texts("nysiis_code", sim.nysiis_code, C.nysiis("s"))
_texts("mra_code", sim.mra_code, C.mra("s"))

# --- diagnostics -------------------------------------------------------------------------


def odd_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs, some without tokens, without ASCII, or very large."""
    k, p = F.col("k"), name_pairs(spark, sf_dir)
    a = F.when(k % 37 == 0, F.lit("__--")).when(k % 41 == 0, F.lit("áéí")).when(k % 499 == 0, F.repeat(F.lit("0123456789"), F.lit(7000))).otherwise(F.col("a"))
    return p.select("k", a.alias("a"), F.when(k % 43 == 0, F.lit("ñó")).otherwise(F.col("b")).alias("b"))


def validate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = odd_pairs(spark, sf_dir).select("k", F.explode(validate("a", "b")).alias("w"))
    return w.select("k", algorithm_name(F.col("w.algorithm")).alias("algorithm"), kind_name(F.col("w.kind")).alias("kind"))


_beyond = "({0} <> '' AND NOT regexp_matches({0}, '[\\x00-\\x7F]'))"
_names = lambda names: "(SELECT unnest([" + ", ".join(f"'{n}'" for n in names) + "]) AS n)"
_add("validate_pairs", validate_pairs, f"""{C.PAIRS}, o AS (SELECT k, CASE WHEN k % 37 = 0 THEN '__--' WHEN k % 41 = 0 THEN 'áéí' WHEN k % 499 = 0 THEN repeat('0123456789', 7000) ELSE a END AS a, CASE WHEN k % 43 = 0 THEN 'ñó' ELSE b END AS b FROM p),
 t AS (SELECT *, strlen(a) AS la, strlen(b) AS lb, len({C.tokens("a")}) AS na, len({C.tokens("b")}) AS nb FROM o)
 SELECT k, 'Any' AS algorithm, 'WarnEmptyInput' AS kind FROM t WHERE a = '' OR b = ''
 UNION ALL SELECT k, 'Any', 'WarnPathologicallyLargeInput' FROM t WHERE greatest(la, lb) > 65536
 UNION ALL SELECT k, 'Hamming', 'WarnUnequalLength' FROM t WHERE la <> lb
 UNION ALL SELECT k, n, 'WarnNoTokensAfterNormalise' FROM t, {_names(S.TOKEN_TIER)} WHERE (na = 0 OR nb = 0) AND (a <> '' OR b <> '')
 UNION ALL SELECT k, n, 'WarnAllNonASCIIDropped' FROM t, {_names(S.ASCII_ONLY)} WHERE {_beyond.format("a")} OR {_beyond.format("b")}""")

# --- scorers -----------------------------------------------------------------------------


def native_scorer() -> Scorer:
    """Two measures that need no Python."""
    return ScorerBuilder().with_threshold(0.6).with_algorithm("Levenshtein", 1).with_algorithm("TokenJaccard", 1).build()


def five_measures(threshold: float = 0.5) -> Scorer:
    """The default measures but Double Metaphone."""
    return default_scorer_builder().without_algorithm("DoubleMetaphone").with_threshold(threshold).build()


def odd_scorer() -> Scorer:
    """Raw weights, raw text and measures with parameters of their own."""
    b = ScorerBuilder().with_threshold(1.0).without_normalisation().with_normalised_weights(False)
    b = b.with_q_gram_jaccard(1.0, 2).with_sorensen_dice(2.0, 2).with_cosine(1.0, 2).with_tversky(0.5, 0.8, 0.2, 2).with_monge_elkan(1.5, "Levenshtein")
    return b.with_smith_waterman_gotoh(1.0, S.SWGParams(1.0, -1.0, -1.5, -0.5)).with_algorithm("Jaro", 9.0).without_algorithm("Jaro").build()


_FIVE = (
    C.PAIRS.replace(" p AS (", " p0 AS (")
    + f""", q0 AS (SELECT k, a AS a0, b AS b0, {C.normalised("a")} AS a, {C.normalised("b")} AS b FROM n),
 p AS (SELECT k, a0, b0, a, b, {C.in_bytes("a")} AS x, {C.in_bytes("b")} AS y, {C.tokens("a")} AS ta, {C.tokens("b")} AS tb FROM q0)"""
)
_FIVE = C.gram_pairs(3, _FIVE) + f""", f AS (SELECT k, a0 AS a, b0 AS b, (CASE WHEN a = b THEN 1.0 ELSE 1.0::DOUBLE - ({C.osa("x", "y")})::DOUBLE / {_long} END)::DOUBLE AS osa,
  {C.jaro_winkler("a", "b")} AS jw, {C.JACCARD} AS qg, {C.DICE} AS sd, {C.TOKEN_JACCARD} AS tj FROM g),
 s AS (SELECT *, 0.2::DOUBLE * tj + (0.2::DOUBLE * sd + (0.2::DOUBLE * qg + (0.2::DOUBLE * jw + (0.2::DOUBLE * osa + 0.0::DOUBLE)))) AS score FROM f)"""


def scorer_score_and_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, match and each measure's part, in one pass."""
    s = five_measures()
    p = name_pairs(spark, sf_dir).withColumn("r", s.score_and_all("a", "b"))
    parts = [F.col("r.scores")[n].alias(c) for n, c in (("DamerauLevenshteinOSA", "osa"), ("JaroWinkler", "jw"), ("QGramJaccard", "qg"), ("SorensenDice", "sd"), ("TokenJaccard", "tj"))]
    return p.select("k", "a", "b", F.col("r.score").alias("score"), *parts)


_add("scorer_score_and_all", scorer_score_and_all, f"{_FIVE} SELECT k, a, b, score, osa, jw, qg, sd, tj FROM s")
_pairs("scorer_score", lambda a, b: five_measures().score(a, b), f"{_FIVE} SELECT k, a, b, score AS value FROM s")
_pairs("scorer_match", lambda a, b: five_measures().match(a, b), f"{_FIVE} SELECT k, a, b, score >= 0.5 AS value FROM s")
_pairs("scorer_score_all", lambda a, b: five_measures().score_all(a, b)["JaroWinkler"], f"{_FIVE} SELECT k, a, b, jw AS value FROM s")
_lev = lambda s, t: f"(CASE WHEN {s} = {t} THEN 1.0 ELSE 1.0::DOUBLE - levenshtein({s}, {t})::DOUBLE / greatest(strlen({s}), strlen({t}))::DOUBLE END)::DOUBLE"
_pairs("scorer_options", lambda a, b: odd_scorer().score(a, b), f"""{C.gram_pairs(2)}, f AS (SELECT *, {C.guarded(f"least(1.0::DOUBLE, {C.alignment('x', 'y')} / least(len(x), len(y))::DOUBLE)")} AS sw, {C.JACCARD} AS qg, {C.DICE} AS sd, {C.COSINE} AS co,
  {C.tversky(0.8, 0.2)} AS tv, ({C.monge_elkan("ta", "tb", _lev)} + {C.monge_elkan("tb", "ta", _lev)}) / 2.0::DOUBLE AS me FROM g)
 SELECT k, a, b, 1.5::DOUBLE * me + (0.5::DOUBLE * tv + (co + (2.0::DOUBLE * sd + (qg + (sw + 0.0::DOUBLE))))) AS value FROM f""")


def default_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default scorer on recorded pairs."""
    s = default_scorer()
    return spark.createDataFrame([r[:2] for r in R.DEFAULT], "a string, b string").select("a", "b", s.score("a", "b").alias("score"), s.match("a", "b").alias("match"))


_add("default_score", default_score, f"SELECT a, b, score, m AS match FROM {_values(R.DEFAULT, 'a, b, score, m')}")

# --- scans -------------------------------------------------------------------------------
_COLUMNS = ("kind", "name_a", "name_b", "group_a", "group_b", "tag_a", "tag_b", "score")


def part_items(spark: SparkSession, sf_dir: str, silent: Column | None = None) -> DataFrame:
    """Distinct part names as items, grouped by brand, placed and tagged by their first key."""
    parts = _table(spark, sf_dir, "part").groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("first"))
    parts = parts.withColumn("silent", F.lit(False) if silent is None else silent).withColumn("tag", F.col("first").cast("string"))
    return items_from(parts, "p_name", "p_brand", "silent", "tag", "first")


def nation_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations by region: few enough for all to be compared."""
    n = _table(spark, sf_dir, "nation").withColumn("tag", F.col("n_nationkey").cast("string"))
    return items_from(n, "n_name", "n_regionkey", None, "tag", "n_nationkey")


def _scan(name: str, items: Callable, config: Callable, sql: str) -> None:
    _add(name, lambda spark, sf_dir: scan.check(items(spark, sf_dir), config(spark, sf_dir)).select(*_COLUMNS), sql)


def _plain(**options) -> Callable:
    return lambda spark, sf_dir: scan.ScanConfig(native_scorer(), **options)


_differ, _all = C.CROSS.format(same="AND a.norm <> b.norm"), C.CROSS.format(same="")
_scan("scan_parts", part_items, _plain(), C.scan())
_scan("scan_parts_across", part_items, _plain(compare_across_groups=True, cross_group_threshold_boost=0.0), C.scan(cross=_differ, across=0.6))
_scan("scan_parts_across_identical", part_items, _plain(compare_across_groups=True, compare_identical_across_groups=True), C.scan(cross=_all))
_scan("scan_parts_silenced", lambda spark, d: part_items(spark, d, F.col("first") % 3 == 0), _plain(), C.scan(C.PART_ITEMS.format(silent="min(p_partkey) % 3 = 0")))


def _same_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of part names with the same second word (before n), in capitals and with an underscore: normalising makes them meet the items."""
    names = _table(spark, sf_dir, "part").select("p_name").distinct().withColumn("w", F.substring_index("p_name", " ", -1)).filter(F.col("w") < "n")
    x, y = names.select("w", F.replace("p_name", F.lit(" "), F.lit("_")).alias("p")), names.select("w", F.upper("p_name").alias("q"))
    return x.join(y, "w").filter(F.lower(F.replace("p", F.lit("_"), F.lit(" "))) != F.lower("q")).select("p", "q")


_scan("scan_parts_suppressed", part_items, lambda spark, d: scan.ScanConfig(native_scorer(), suppressed_pairs=_same_word(spark, d)), C.scan(more="AND (split_part(na, ' ', -1) <> split_part(nb, ' ', -1) OR split_part(na, ' ', -1) >= 'n')"))
_loose = lambda: ScorerBuilder().with_threshold(0.58).with_algorithm("Levenshtein", 1).with_algorithm("TokenJaccard", 1).build()
_scan("scan_nations_across", nation_items, lambda spark, d: scan.ScanConfig(_loose(), compare_across_groups=True, cross_group_threshold_boost=0.025), C.scan(C.NATION_ITEMS, _differ, within=0.58, across=0.605))


def scan_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default scan of the recorded items in its recorded configurations."""
    rows = [(i, *r) for i, r in enumerate(R.ITEMS)]
    items = items_from(spark.createDataFrame(rows, "i long, n string, g string"), "n", "g", order="i")
    base = ("user_id", "userId")
    configs = {
        "DefaultConfig": scan.ScanConfig.default(),
        "DefaultConfig_CrossEnabled": scan.ScanConfig(default_scorer(), True),
        "DefaultConfig_CrossEnabled_AllowIdentical": scan.ScanConfig(default_scorer(), True, compare_identical_across_groups=True),
        "DefaultConfig_WithSuppressedPair": scan.ScanConfig(default_scorer(), suppressed_pairs=(base,)),
    }
    out = None
    for name, cfg in configs.items():
        one = scan.check(items, cfg, sort=False).select(F.lit(name).alias("config"), "kind", "name_a", "name_b", "group_a", "group_b", "score")
        out = one if out is None else out.unionByName(one)
    return out


_add("scan_recorded", scan_recorded, f"SELECT * FROM {_values(R.WARNINGS, 'config, kind, name_a, name_b, group_a, group_b, score')}")


def scan_parts_five_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan with the default measures but Double Metaphone, in the JVM and in Arrow."""
    return scan.check(part_items(spark, sf_dir), scan.ScanConfig(five_measures(0.75))).select(*_COLUMNS)


_add("scan_parts_five_measures", scan_parts_five_measures, f"""WITH i AS ({C.PART_ITEMS.format(silent="false")}),
 z AS (SELECT *, count(*) OVER (PARTITION BY grp) AS gsize, {C.tokens("norm")} AS tok, {C.in_bytes("norm")} AS x FROM i),
 c AS (SELECT a.name AS na, b.name AS nb, a.grp AS grp, a.tag AS xa, b.tag AS xb, a.norm AS a, b.norm AS b FROM z a JOIN z b ON a.grp = b.grp AND a.idx < b.idx WHERE a.gsize <= 50 OR len(list_intersect(a.tok, b.tok)) > 0),
 d AS (SELECT DISTINCT a, b FROM c),
 p AS (SELECT *, {C.in_bytes("a")} AS x, {C.in_bytes("b")} AS y, {C.tokens("a")} AS ta, {C.tokens("b")} AS tb FROM d),
 h AS (SELECT *, {C.grams("x", 3)} AS ga, {C.grams("y", 3)} AS gb FROM p),
 g AS (SELECT *, len(ga) AS na, len(gb) AS nb, coalesce(list_sum(list_transform(list_distinct(list_intersect(ga, gb)), lambda t: least({C._COUNT.format("ga")}, {C._COUNT.format("gb")}))), 0)::INT AS i FROM h),
 s AS (SELECT a, b, 0.2::DOUBLE * {C.TOKEN_JACCARD} + (0.2::DOUBLE * {C.DICE} + (0.2::DOUBLE * {C.JACCARD} + (0.2::DOUBLE * {C.jaro_winkler("a", "b")} + (0.2::DOUBLE * (CASE WHEN a = b THEN 1.0 ELSE 1.0::DOUBLE - ({C.osa("x", "y")})::DOUBLE / {_long} END)::DOUBLE + 0.0::DOUBLE)))) AS score FROM g)
 SELECT 'WithinGroup' AS kind, least(na, nb) AS name_a, greatest(na, nb) AS name_b, grp AS group_a, grp AS group_b, CASE WHEN na > nb THEN xb ELSE xa END AS tag_a, CASE WHEN na > nb THEN xa ELSE xb END AS tag_b, score
 FROM c JOIN s USING (a, b) WHERE score >= 0.75""")
