"""Quality rules by distribution divergence, in DataFrame operations only.

Two histograms of a text, one of character classes and one of common words, are compared with those
of each language by the Jensen-Shannon distance (base 2, from 0 to 1). A language's reference is the sum
of the histograms of the corpus's rows of that language that pass the base rules. A text is rejected when even its nearest
language is further away than a limit; a histogram of too few entries is not judged.

The common words of four languages are fixed. Every other language that rows are labelled with has its most frequent
words counted in the corpus (in its rows that pass the base rules) and a word histogram of its own, so no labelled language goes without a reference.

Base rules: fewer than 50 words, or over half of the words in repeated 3-word windows. Windows are
compared by a 64-bit hash within one text.

Cases: null text counts as empty (no words, base rule failed); without any reference no text is
rejected by divergence; a null language is part of no reference; repeated rows count as often as they
occur; null ids stay; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.sources.workspace import stage

LANGUAGES = ("de", "en", "es", "fr")
#: Frequent words of the languages; none is in two lists. The last bin holds all other words.
COMMON = {
    "de": ("der", "die", "und", "das", "ist", "nicht", "ein", "von", "mit", "zu"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "with", "it"),
    "es": ("el", "los", "y", "las", "por", "del", "una", "se", "no", "con"),
    "fr": ("le", "et", "les", "des", "du", "est", "pour", "dans", "une", "qui"),
}
#: Words counted as common in a language that has no list above.
TOP_WORDS = 10
#: Character classes; whatever is in none of them, white space left out, is the last bin.
CLASSES = ("a-z", "A-Z", "0-9", ".,;:'\"()\\-", "!?", "\\x{80}-\\x{10FFFF}")
MAX_CHARACTER_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.35
MIN_CHARACTERS = 200
MIN_WORDS = 60

_SPACE = "\\x20\\x09-\\x0D"


def _sql(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def _literal(text: str) -> str:
    return f"'{_sql(text)}'"


def top_words(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, list[str]]:
    """The most frequent words of each language without a fixed list, ties by the word."""
    others = docs.where(F.col(lang).isNotNull() & ~F.col(lang).isin(*LANGUAGES))
    if others.isEmpty():
        return {}
    # written first: a filter on the counts would be pushed into the lambdas
    counted = stage(_counted(others, key, text, lang, {}), "other_languages")
    counts = counted.where(~F.col("base_failed")).select("lang", F.explode("words").alias("word")).groupBy("lang", "word").count()
    order = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    rows = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= TOP_WORDS).collect()
    found: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["place"])):
        found.setdefault(row["lang"], []).append(row["word"])
    return found


def histograms(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", others: dict[str, list[str]] | None = None
) -> DataFrame:
    """``doc_id, lang``, the base counts and the two histograms of every row; ``own``: one more histogram
    of words for each language of ``others``."""
    return _counted(docs, key, text, lang, others or {}).drop("words")


def _counted(docs: DataFrame, key: str, text: str, lang: str, others: dict[str, list[str]]) -> DataFrame:
    rows = docs.select(F.col(key).alias("doc_id"), F.col(lang).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    words = rows.withColumn("words", F.expr(f"filter(split(text, '[{_sql(_SPACE)}]+'), w -> w != '')"))
    # columns that lambdas index are used twice below, which keeps the optimizer from inlining them into the lambda
    starts = words.select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.expr(
            "transform(slice(words, 1, greatest(size(words) - 2, 0)), "
            "(w, i) -> struct(xxhash64(w, words[i + 1], words[i + 2]) AS h, i AS i))"
        ).alias("windows"),
    )
    ordered = starts.withColumn("ordered", F.sort_array("windows"))
    repeated = F.expr(
        "filter(transform(ordered, (x, i) -> if((i > 0 AND ordered[i - 1].h = x.h) OR "
        "(i < size(ordered) - 1 AND ordered[i + 1].h = x.h), x.i, NULL)), x -> x IS NOT NULL)"
    )
    covered = ordered.withColumn("repeated", repeated)
    lines = f"filter(split(text, '\\n'), l -> l RLIKE '[^{_sql(_SPACE)}]')"
    common = [w for name in LANGUAGES for w in COMMON[name]]
    inlist = ", ".join(f"'{w}'" for w in common)
    counted = covered.select(
        "*",
        F.length(F.regexp_replace("text", f"[{_SPACE}]+", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.expr(f"cast(size({lines}) - size(array_distinct({lines})) AS long)").alias("n_dup_lines"),
        F.expr("cast(size(array_distinct(flatten(transform(repeated, x -> array(x, x + 1, x + 2))))) AS long)").alias("n_repeat_words"),
        *[F.length(F.regexp_replace("text", f"[^{c}]+", "")).cast("long").alias(f"c{i}") for i, c in enumerate(CLASSES)],
        F.expr(f"concat(' ', array_join(filter(words, w -> w IN ({inlist})), '  '), ' ')").alias("seen"),
        *([F.expr(f"filter(words, w -> w IN ({', '.join(sorted({_literal(w) for ws in others.values() for w in ws}))}))").alias("hits")] if others else []),
    )
    own = []
    if others:
        lists = ", ".join(f"array({', '.join(map(_literal, ws))})" for ws in others.values())
        hits = f"transform(array({lists}), ws -> transform(ws, w -> cast(size(filter(hits, x -> x = w)) AS long)))"
        # size("hits") is the second use that keeps the list out of the lambda
        own = [F.expr(f"transform({hits}, c -> concat(c, array(n_words - aggregate(c, 0L, (s, m) -> s + m))))").alias("own"), F.size("hits").alias("n_hits")]
    named = [F.col(f"c{i}") for i in range(len(CLASSES))]
    rest = F.col("word_chars") - sum(named[1:], named[0])
    of_word = [
        ((F.length("seen") - F.length(F.replace("seen", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long") for w in common
    ]
    return counted.select(
        *("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"),
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.array(*named, rest).alias("characters"),
        F.array(*of_word, F.col("n_words") - sum(of_word[1:], of_word[0])).alias("common"),
        "words",
        *own,
    )


def references(measured: DataFrame) -> dict[str, tuple[list[int], list[int]]]:
    """Sums of both histograms per language: one small row, whatever the corpus's size."""
    bins = {"characters": len(CLASSES) + 1, "common": sum(map(len, COMMON.values())) + 1}
    sums = [
        F.array(*[F.coalesce(F.sum(F.when(F.col("lang") == name, F.col(column)[i])), F.lit(0)) for i in range(n)]).alias(f"{name}_{column}")
        for name in LANGUAGES
        for column, n in bins.items()
    ]
    row = measured.where(~F.col("base_failed")).agg(*sums).first()
    found = {name: (list(row[f"{name}_characters"]), list(row[f"{name}_common"])) for name in LANGUAGES}
    return {name: both for name, both in found.items() if sum(both[0]) and sum(both[1])}


def other_references(measured: DataFrame, others: dict[str, list[str]]) -> list[tuple[list[int], list[int]]]:
    """Sums of the characters and the own word histogram of each language of ``others``, in its order."""
    at = {name: n for n, name in enumerate(others)}
    places = F.create_map(*[F.lit(x) for pair in at.items() for x in pair])
    rows = measured.where(~F.col("base_failed") & F.col("lang").isin(*others)).withColumn("mine", F.col("own")[places[F.col("lang")]])
    characters = F.array(*[F.sum(F.col("characters")[i]) for i in range(len(CLASSES) + 1)])
    # a language of few words has a shorter histogram
    words = F.array(*[F.sum(F.get("mine", F.lit(i))) for i in range(TOP_WORDS + 1)])
    found = {r["lang"]: r for r in rows.groupBy("lang").agg(characters.alias("characters"), words.alias("words")).collect()}
    return [(list(found[name]["characters"]), list(found[name]["words"])[: len(ws) + 1]) for name, ws in others.items()]


def distance(counts: str, reference: list[int]) -> Column:
    """Jensen-Shannon distance of a column of counts to fixed counts."""
    total = sum(reference)
    fixed = "array(" + ", ".join(f"{n / total!r}D" for n in reference) + ")"
    share = f"transform({counts}, n_ -> n_ / greatest(aggregate({counts}, 0L, (s_, m_) -> s_ + m_), 1L))"
    return F.expr(
        f"sqrt(greatest(0D, aggregate(zip_with({share}, {fixed}, (a, b) -> "
        "if(a > 0, a * ln(2 * a / (a + b)), 0D) + if(b > 0, b * ln(2 * b / (a + b)), 0D)), 0D, (s, x) -> s + x) / (2 * ln(2D))))"
    )


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row the base counts, ``base_failed``, ``kept`` and the distances to the nearest language."""
    others = top_words(docs, key, text, lang)
    measured = stage(histograms(docs, key, text, lang, others), "histograms")
    known = references(measured)
    added = other_references(measured, others) if others else []
    if not known and not added:
        far = measured.withColumns({"character_distance": F.lit(None).cast("double"), "word_distance": F.lit(None).cast("double")})
    else:
        nearest = {
            "character_distance": [distance("characters", c) for c, _ in [*known.values(), *added]],
            "word_distance": [distance("common", w) for _, w in known.values()] + [distance(f"own[{n}]", w) for n, (_, w) in enumerate(added)],
        }
        far = measured.withColumns({k: F.least(*v) if len(v) > 1 else v[0] for k, v in nearest.items()})
    strange = (F.col("word_chars") >= MIN_CHARACTERS) & (F.col("character_distance") > MAX_CHARACTER_DISTANCE)
    odd = (F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE)
    rejected = F.coalesce(strange, F.lit(False)) | F.coalesce(odd, F.lit(False))
    return far.withColumn("kept", ~F.col("base_failed") & ~rejected)


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    common = [w for name in LANGUAGES for w in COMMON[name]]
    quote = lambda text: text.replace("'", "''")
    classes = ", ".join(f"length(regexp_replace(text, '[^{quote(c)}]+', '', 'g'))" for c in CLASSES)
    words = ", ".join(f"'{w}'" for w in common)
    columns = {"characters": len(CLASSES) + 1, "common": len(common) + 1}
    sums = ", ".join(f"[{', '.join(f'sum({column}[{i + 1}])' for i in range(n))}] AS ref_{column}" for column, n in columns.items())
    js = (
        "sqrt(greatest(0.0, list_sum(list_transform(range(1, len({0}) + 1), lambda i: "
        "(CASE WHEN {0}[i] > 0 THEN {0}[i] * ln(2 * {0}[i] / ({0}[i] + {1}[i])) ELSE 0.0 END) + "
        "(CASE WHEN {1}[i] > 0 THEN {1}[i] * ln(2 * {1}[i] / ({0}[i] + {1}[i])) ELSE 0.0 END))) / (2 * ln(2.0))))"
    )
    share = "list_transform({0}, lambda c: c::DOUBLE / greatest(list_sum({0}), 1))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
t AS (SELECT rid, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM w),
t3 AS (SELECT rid, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM t WINDOW o AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM t3 WHERE c IS NOT NULL),
v AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM r, range(0, 3) AS ks(k) WHERE n > 1 GROUP BY rid),
m AS (SELECT w.rid, doc_id, lang, len(words) AS n_words,
  length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  [{classes}] AS named,
  list_transform([{words}], lambda x: len(list_filter(words, lambda y: y = x))) AS hits,
  list_append(hits, len(words) - list_sum(hits)) AS common
  FROM w LEFT JOIN v USING (rid)),
h AS (SELECT *, list_append(named, word_chars - list_sum(named)) AS characters,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
refs AS (SELECT lang AS ref, {sums} FROM h WHERE NOT base_failed AND lang IN ({", ".join(f"'{x}'" for x in LANGUAGES)})
  GROUP BY lang HAVING list_sum(ref_characters) > 0 AND list_sum(ref_common) > 0),
shares AS (SELECT *, {share.format("characters")} AS pc, {share.format("common")} AS pw FROM h),
ref_shares AS (SELECT ref, {share.format("ref_characters")} AS qc, {share.format("ref_common")} AS qw FROM refs),
far AS (SELECT rid, min({js.format("pc", "qc")}) AS dc, min({js.format("pw", "qw")}) AS dw FROM shares, ref_shares GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(word_chars >= {MIN_CHARACTERS} AND dc > {MAX_CHARACTER_DISTANCE}, false)
  AND NOT coalesce(n_words >= {MIN_WORDS} AND dw > {MAX_WORD_DISTANCE}, false) AS kept
FROM h LEFT JOIN far USING (rid)
"""


#: DuckDB SQL of the query.
SQL = _oracle()
