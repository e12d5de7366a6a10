"""Quality rules: base rules on word counts, then robust multivariate outliers within language and source.

DataFrame functions only. Statistics are fixed-point integers, so that sums, and with them every estimate, are exact and the
same for any partitioning, any retry and any engine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import SPACE, only, stored

SYMBOLS = "[#*$%&|<>]"
#: Transformed statistics; each is an integer in steps of 1 / SCALE.
STATS = ("z_len", "z_word", "z_symbol", "z_line", "z_repeat")
SCALE = 256
#: Least standard deviation of each statistic, in steps: however alike a group is, smaller differences than some of these are no outliers.
FLOORS = {"z_len": SCALE, "z_word": SCALE // 8, "z_symbol": SCALE // 2, "z_line": SCALE // 2, "z_repeat": SCALE // 2}
#: 0.9999 quantile of chi-square with five degrees of freedom; its median; both fixed values.
CUTOFF, CHI2_MEDIAN = 25.745, 4.351
#: Share of a group that the determinant is minimised over, and concentration steps.
SUPPORT_PERCENT, STEPS = 75, 4
#: Every group's moments are its own and, as if PRIOR rows more, the mean moments of its language's supports.
PRIOR = 50
#: Squared distances are counted in bins of 1 / BINS_PER_UNIT; above MAX_BIN they share one.
BINS_PER_UNIT, MAX_BIN = 64, 64 * 1024


def _with_repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words inside 3-word windows of ``_words`` that occur twice or more.

    A window is one number: the hash in the high bits, the place in the low ones, as many as places need. Sorted, equal
    windows stand side by side; the places found, sorted again, tell how many words the windows cover.
    """
    window = lambda i: F.xxhash64(F.get("_h", i), F.get("_h", i + 1), F.get("_h", i + 2))
    places = F.when(F.size("_words") < 4, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size("_words") - 3))
    mask = F.coalesce(F.call_function("shiftleft", F.lit(-1).cast("long"), F.ceil(F.log2((F.size("_words") + 2).cast("double"))).cast("int")), F.lit(0).cast("long"))
    alike = lambda x, i: x.bitwiseXOR(F.get("_p", i + 1)).bitwiseAND(F.col("_m")) == 0
    place = lambda x: x.bitwiseAND(F.bitwise_not("_m"))
    step = lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get("_at", i + 1) - x, F.lit(3).cast("long")))
    return (
        df.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
        .withColumn("_m", mask)
        .withColumn("_p", F.sort_array(F.transform(places, lambda i: window(i).bitwiseAND(F.col("_m")).bitwiseOR(i.cast("long")))))
        .withColumn("_first", F.filter(F.transform("_p", lambda x, i: F.when(alike(x, i), i)), lambda i: i.isNotNull()))
        .withColumn("_at", F.sort_array(F.array_union(F.transform("_first", lambda i: place(F.get("_p", i))), F.transform("_first", lambda i: place(F.get("_p", i + 1))))))
        .withColumn("n_repeat_words", F.aggregate(F.transform("_at", step), F.lit(0).cast("long"), lambda acc, x: acc + x))
        .drop("_h", "_m", "_p", "_first", "_at")
    )


def base_statistics(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed to rows with a text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    counted = docs.withColumn("_words", words).withColumn("_lines", lines)
    counted = (
        counted.withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.char_length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOLS)).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_lines", F.size("_lines").cast("long"))
    )
    counted = _with_repeat_words(counted)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.drop("_words", "_lines").withColumn("base_failed", failed)


def _stat_columns() -> list[tuple[str, str]]:
    """Name and SQL text of each transformed statistic, the same text for Spark and for the oracle."""
    n = "CAST(n_words AS DOUBLE)"
    raw = {
        "z_len": f"ln({n} + 1.0e0)",
        "z_word": f"ln((CAST(word_chars AS DOUBLE) + 100.0e0) / ({n} + 20.0e0))",
        "z_symbol": f"ln((CAST(n_symbols AS DOUBLE) + 0.02e0 * {n} + 1.0e0) / ({n} + 20.0e0))",
        "z_line": "ln((CAST(n_dup_lines AS DOUBLE) + 2.0e0) / (CAST(n_lines AS DOUBLE) + 10.0e0))",
        "z_repeat": f"ln((CAST(n_repeat_words AS DOUBLE) + 0.05e0 * {n} + 1.0e0) / ({n} + 20.0e0))",
    }
    return [(k, f"CAST(floor({v} * {SCALE}.0e0 + 0.5e0) AS BIGINT)") for k, v in raw.items()]


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(STATS)) for j in range(i, len(STATS))]


def _moment_sql() -> list[str]:
    """Exact integer sums: rows, each statistic, each product of two."""
    out = ["CAST(count(*) AS BIGINT) AS m_n"]
    out += [f"CAST(sum({z}) AS DECIMAL(38, 0)) AS m_{i}" for i, z in enumerate(STATS)]
    return out + [f"CAST(sum(CAST({STATS[i]} * {STATS[j]} AS DECIMAL(20, 0))) AS DECIMAL(38, 0)) AS m_{i}_{j}" for i, j in _pairs()]


def _fit_sql() -> list[list[tuple[str, str]]]:
    """Steps from moments (m_ of the group, p_ of its language) to means u_i and the Cholesky factor's terms: lists of (name,
    expression), each over those before."""
    shrunk = lambda k: f"(CAST(m_{k} AS DOUBLE) + {float(PRIOR)!r}e0 * (CAST(p_{k} AS DOUBLE) / CAST(p_n AS DOUBLE))) / (CAST(m_n AS DOUBLE) + {float(PRIOR)!r}e0)"
    mean = [(f"u_{i}", shrunk(i)) for i in range(5)]
    cov = []
    for i, j in _pairs():
        c = f"{shrunk(f'{i}_{j}')} - u_{i} * u_{j}"
        cov.append((f"c_{i}_{j}", f"greatest({c}, {float(FLOORS[STATS[i]] ** 2)!r}e0)" if i == j else c))
    steps = [mean, cov]
    for j in range(5):  # Cholesky: c = l l^T, column by column
        inner = "".join(f" - l_{j}_{k} * l_{j}_{k}" for k in range(j))
        steps.append([(f"l_{j}_{j}", f"sqrt(greatest(c_{j}_{j}{inner}, 1.0e-6))")])
        if j < 4:
            steps.append([(f"l_{i}_{j}", "(" + f"c_{j}_{i}" + "".join(f" - l_{i}_{k} * l_{j}_{k}" for k in range(j)) + f") / l_{j}_{j}") for i in range(j + 1, 5)])
    return steps


FIT_COLUMNS = [f"u_{i}" for i in range(5)] + [f"l_{i}_{j}" for j in range(5) for i in range(j, 5)]


def _distance_sql() -> list[list[tuple[str, str]]]:
    """Steps to the squared Mahalanobis distance: forward substitution, then the sum of squares."""
    steps = [[(f"y_{i}", "(" + f"(CAST({STATS[i]} AS DOUBLE) - u_{i})" + "".join(f" - l_{i}_{k} * y_{k}" for k in range(i)) + f") / l_{i}_{i}")] for i in range(5)]
    return [*steps, [("d2", " + ".join(f"y_{i} * y_{i}" for i in range(5)))], [("bin", f"CAST(floor(least(d2 * {BINS_PER_UNIT}.0e0, {MAX_BIN}.0e0)) AS BIGINT)")]]


def _apply(df: DataFrame, steps: list[list[tuple[str, str]]]) -> DataFrame:
    for step in steps:
        df = df.selectExpr("*", *[f"{text} AS {name}" for name, text in step])
    return df


def _quantile_bin(df: DataFrame, keys: list[str], value: str, percent: int) -> DataFrame:
    """Per group the least ``value`` (an integer of few distinct values) that ``percent`` of its rows do not exceed, as ``q``.

    Counts per value are made before the shuffle; the window then reads a row per distinct value, not per document.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys)
    upto = F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    held = counts.withColumn("_upto", upto).withColumn("_all", F.sum("_c").over(w))
    return held.filter(F.col("_upto") * 100 >= F.col("_all") * percent).groupBy(*keys).agg(F.min(value).alias("q"))


MOMENTS = ["n", *map(str, range(5)), *(f"{i}_{j}" for i, j in _pairs())]


def robust_distances(stats: DataFrame) -> DataFrame:
    """Adds d2, the squared robust distance of each row from its group (``grp``, of a language ``lang``), consistent at the median.

    Fast minimum covariance determinant: the start is the rows nearest to the coordinatewise medians; each of STEPS concentration
    steps fits mean and covariance to the SUPPORT_PERCENT nearest rows and measures all rows anew. Without floors and prior a
    step never raises the determinant; with them small and near-constant groups are bounded by what their language shows.
    Quantiles are over bins of integers, so rows in the last bin taken are all taken (ties are one).

    Quantiles and fits are a row per group, written and read again: where their size is below Spark's broadcast threshold the
    documents are measured where they lie, without a shuffle, and a group of any share of the rows makes no task longer.
    """
    long = stats.select("grp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(z).alias("v")) for i, z in enumerate(STATS)])).alias("s")).select("grp", "s.i", "s.v")
    medians = stored(_quantile_bin(long, ["grp", "i"], "v", 50).groupBy("grp").agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"med_{i}") for i in range(5)]), "quality-medians")
    near = reduce(lambda a, b: a + b, [F.expr(f"pow(CAST({z} - med_{i} AS DOUBLE) / {float(FLOORS[z])!r}e0, 2)") for i, z in enumerate(STATS)])
    current = stats.join(medians, "grp").withColumn("bin", F.floor(F.least(near * BINS_PER_UNIT, F.lit(float(MAX_BIN)))).cast("long")).select(*stats.columns, "bin")
    for _ in range(STEPS):
        support = current.join(stored(_quantile_bin(current, ["grp"], "bin", SUPPORT_PERCENT), "quality-bins"), "grp").filter(F.col("bin") <= F.col("q"))
        own = stored(support.groupBy("lang", "grp").agg(*[F.expr(x) for x in _moment_sql()]), "quality-moments")
        prior = own.groupBy(F.col("lang").alias("p_lang")).agg(*[F.sum(f"m_{k}").cast("decimal(38,0)").alias(f"p_{k}") for k in MOMENTS])
        fit = stored(_apply(own.join(prior, F.col("lang") == F.col("p_lang")), _fit_sql()).select("grp", *FIT_COLUMNS), "quality-fit")
        current = _apply(stats.join(fit, "grp"), _distance_sql()).select(*stats.columns, "d2", "bin")
    middle = stored(_quantile_bin(current, ["grp"], "bin", 50), "quality-bins")
    # Distances are stretched only where the fit is too tight: floors and prior make it wide in groups of like documents.
    factor = F.least(F.lit(1.0), F.lit(CHI2_MEDIAN * BINS_PER_UNIT) / (F.col("q") + 1).cast("double"))
    return current.join(middle, "grp").withColumn("d2", F.col("d2") * factor).select(*stats.columns, "d2")


def quality(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang, source): text_hash, the base statistics, base_failed, d2 and kept.

    Null text: no words, base_failed. Null language or source: a value of its own. Every group is estimated, however small: its
    moments are drawn to its language's by PRIOR rows' weight. Rows that failed the base rules do not enter the estimates; their
    d2 is null. Repeated rows count as often as they stand. Very long texts are counted whole, as arrays of their words in one
    row. No documents: no rows. Extra columns of the input are not returned.
    """
    base = only(docs, doc_id="long", text="string", lang="string", source="string")
    counts = stored(base_statistics(base).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit("")))).drop("text"), "quality-stats")
    passed = counts.filter(~F.col("base_failed")).select("doc_id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", F.to_json(F.array("lang", "source")).alias("grp"), F.to_json(F.array("lang")).alias("lang"))
    stats = stored(passed.selectExpr("doc_id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "grp", "lang", *[f"{v} AS {k}" for k, v in _stat_columns()]), "quality-z")
    columns = ["doc_id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d2", "kept"]
    judged = robust_distances(stats).withColumn("base_failed", F.lit(False)).withColumn("kept", F.col("d2") <= CUTOFF).select(*columns)
    failed = counts.filter("base_failed").withColumn("d2", F.lit(None).cast("double")).withColumn("kept", F.lit(False)).select(*columns)
    return judged.unionByName(failed)


def drop_rejected(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose document is kept, with all their columns. Rows of one doc_id are told apart by their texts."""
    kept = quality(docs).filter("kept").select(F.col("doc_id").alias("__kept_id"), F.col("text_hash").alias("__kept_hash")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__kept_id")) & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col("__kept_hash"))
    return docs.join(kept, same, "left_semi")


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _steps_sql(source: str, steps: list[list[tuple[str, str]]]) -> str:
    for step in steps:
        source = f"(SELECT *, {', '.join(f'{text} AS {name}' for name, text in step)} FROM {source})"
    return source


def _quantile_sql(source: str, keys: str, value: str, percent: int) -> str:
    return (
        f"(SELECT {keys}, min({value}) AS q FROM (SELECT *, sum(c) OVER (PARTITION BY {keys} ORDER BY {value} ROWS UNBOUNDED PRECEDING) AS upto,"
        f" sum(c) OVER (PARTITION BY {keys}) AS total FROM (SELECT {keys}, {value}, count(*) AS c FROM {source} GROUP BY ALL))"
        f" WHERE upto * 100 >= total * {percent} GROUP BY {keys})"
    )


def oracle() -> str:
    """The same rules in the oracle's SQL: the estimates use the same integer sums and the same formulas."""
    near = " + ".join(f"pow(CAST({z} - med_{i} AS DOUBLE) / {float(FLOORS[z])!r}e0, 2)" for i, z in enumerate(STATS))
    ctes = [
        r"words AS (SELECT doc_id, coalesce(text, '') AS text, lang, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)",
        "wins AS (SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3))",
        "twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM wins) WHERE c > 1)",
        "reps AS (SELECT doc_id, count(DISTINCT i + o) AS r FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id)",
        r"lin AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS d FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)",
        "base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,"
        " CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(d, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines"
        " FROM words LEFT JOIN lin USING (doc_id) LEFT JOIN reps USING (doc_id)))",
        "grouped AS (SELECT * EXCLUDE (lang), CAST(to_json([lang, source]) AS VARCHAR) AS grp, CAST(to_json([lang]) AS VARCHAR) AS lang FROM base WHERE NOT base_failed)",
        f"stats AS (SELECT doc_id, grp, lang, {', '.join(f'{v} AS {k}' for k, v in _stat_columns())} FROM grouped)",
        f"long AS ({' UNION ALL '.join(f'SELECT grp, {i} AS i, {z} AS v FROM stats' for i, z in enumerate(STATS))})",
        f"med AS (SELECT grp, {', '.join(f'max(q) FILTER (WHERE i = {i}) AS med_{i}' for i in range(5))} FROM {_quantile_sql('long', 'grp, i', 'v', 50)} GROUP BY grp)",
        f"s0 AS (SELECT stats.*, CAST(floor(least(({near}) * {BINS_PER_UNIT}, {MAX_BIN}.0e0)) AS BIGINT) AS bin FROM stats JOIN med USING (grp))",
    ]
    z = ", ".join(["stats.doc_id", "stats.grp", "stats.lang", *(f"stats.{x}" for x in STATS)])
    for k in range(STEPS):
        ctes.append(f"o{k} AS (SELECT s{k}.lang, s{k}.grp, {', '.join(_moment_sql())} FROM s{k} JOIN {_quantile_sql(f's{k}', 'grp', 'bin', SUPPORT_PERCENT)} AS t ON s{k}.grp = t.grp AND s{k}.bin <= t.q GROUP BY s{k}.lang, s{k}.grp)")
        moments = f"(SELECT * FROM o{k} JOIN (SELECT lang, {', '.join(f'CAST(sum(m_{x}) AS DECIMAL(38, 0)) AS p_{x}' for x in MOMENTS)} FROM o{k} GROUP BY lang) USING (lang))"
        ctes.append(f"f{k} AS (SELECT grp, {', '.join(FIT_COLUMNS)} FROM {_steps_sql(moments, _fit_sql())})")
        ctes.append(f"s{k + 1} AS (SELECT * EXCLUDE ({', '.join(FIT_COLUMNS)}) FROM {_steps_sql(f'(SELECT {z}, f{k}.* EXCLUDE (grp) FROM stats JOIN f{k} USING (grp))', _distance_sql())})")
    last = f"s{STEPS}"
    ctes.append(f"judged AS (SELECT {last}.doc_id, d2 * least(1.0e0, {CHI2_MEDIAN * BINS_PER_UNIT!r}e0 / CAST(q + 1 AS DOUBLE)) <= {CUTOFF}e0 AS ok FROM {last} JOIN {_quantile_sql(last, 'grp', 'bin', 50)} AS t USING (grp))")
    return f"WITH {', '.join(ctes)} SELECT base.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(ok, false) AS kept FROM base LEFT JOIN judged USING (doc_id)"
