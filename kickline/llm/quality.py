"""Quality rules with cross-document line frequency, in built-in functions only.

Every text is judged by word and line counts of its own. Beyond that its lines are normalised and
hashed, and every line's distinct sets of lines are counted within its host (the `source`); texts of equal
normalised lines count once, so copies, also ones with other digits or capitals, do not make their own lines common. Lines above the limit are boilerplate; a
document of which too little else remains is depleted and rejected, the others lose these lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kickline.llm.common import aside, restored, table
from kickline.llm.registry import query
from kickline.session import stage

#: Space and \x09-\x0D as the characters themselves and as a pattern.
BLANKS = " \t\n\x0b\f\r"
BLANK = r"[\x20\x09-\x0D]"
#: Texts of a host with distinct sets of normalised lines from which on a line is boilerplate.
LINE_TEXTS = 50
#: Words a document must have, of its own and outside boilerplate.
LEAST_WORDS = 50
#: Share of a document's words that must be outside boilerplate.
REMAINING = 0.05


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def words_of(text: Column) -> Column:
    bare = trimmed(text)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK + "+"))


def text_statistics(docs: DataFrame, text: str) -> DataFrame:
    """`docs` plus _n_words, _word_chars, _n_symbols, _n_dup_lines and _n_repeat_words."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: trimmed(x) != "")
    own = docs.columns
    step = docs.select(*own, words_of(body).alias("_w"), lines.alias("_l"), F.char_length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long").alias("_n_symbols"))
    step = step.select(*own, "_n_symbols", F.size("_w").cast("long").alias("_n_words"), F.char_length(F.array_join("_w", "")).cast("long").alias("_word_chars"),
                       (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("_n_dup_lines"), F.transform("_w", lambda x: F.xxhash64(x)).alias("_v"))
    # hashes of three words, made from the words' hashes and their neighbours'
    n = F.size("_v")
    both = F.zip_with(F.col("_v"), F.slice("_v", 2, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))
    step = step.select(*step.columns, both.alias("_b"))
    three = F.zip_with(F.col("_b"), F.slice("_v", 3, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))
    step = step.select(*step.columns[:-2], F.slice(three, 1, F.greatest(n - 2, F.lit(0))).alias("_h"))
    # windows found more than once: neighbours after sorting (hash, position)
    step = step.select(*step.columns[:-1], F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("_s"))
    m = F.size("_s")
    beside = F.arrays_zip(F.col("_s").alias("own"), F.slice("_s", 2, m).alias("next"), F.concat(F.array(F.lit(None).cast("struct<x:bigint,i:int>")), F.slice("_s", 1, m - 1)).alias("last"))
    step = step.select(*step.columns[:-1], F.when(F.col("_s").isNotNull(), beside).alias("_z"))
    again = F.filter("_z", lambda z: F.coalesce(z["own"]["x"] == z["next"]["x"], F.lit(False)) | F.coalesce(z["own"]["x"] == z["last"]["x"], F.lit(False)))
    step = step.select(*step.columns[:-1], F.sort_array(F.transform(again, lambda z: z["own"]["i"])).alias("_i"))
    # every such window covers three words, fewer if the next one begins within it
    reach = F.arrays_zip(F.col("_i").alias("own"), F.slice("_i", 2, F.size("_i")).alias("next"))
    covered = F.aggregate(reach, F.lit(0).cast("long"), lambda t, z: t + F.least(F.lit(3), F.coalesce(z["next"] - z["own"], F.lit(3))))
    # through a generator, so that filters on the counts stay above it and nothing is computed twice
    counts = ["_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words"]
    step = step.select(*step.columns[:-1], F.coalesce(F.when(F.col("_i").isNotNull(), covered), F.lit(0).cast("long")).alias("_n_repeat_words"))
    return step.select(*own, F.explode(F.array(F.struct(*counts))).alias("_counts")).select(*own, "_counts.*")


def base_failed(least_words: int = LEAST_WORDS, most_repeat: int = 50) -> Column:
    return (F.col("_n_words") < least_words) | (100 * F.col("_n_repeat_words") > most_repeat * F.col("_n_words"))


def _host_and_text(host: str, text: str) -> list[Column]:
    """Numbers that name the host and the text; a null host is a host, a null text an empty one."""
    body = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(F.col(host).isNull(), F.col(host)).alias("_host"), F.xxhash64(body).alias("_t1"), F.xxhash64(F.lit("second"), body).alias("_t2")]


def _line_hash(line: Column) -> Column:
    """Of a line in lower case, every number as 0, with single spaces."""
    return F.xxhash64(F.regexp_replace(F.regexp_replace(F.lower(trimmed(line)), "[0-9]+", "0"), BLANK + "+", " "))


def boilerplate(docs: DataFrame, host: str, text: str, line_texts: int) -> DataFrame:
    """One row per text with boilerplate: (_host, _t1, _t2), the hashes of such lines, words lost with them and of all lines over all equal texts."""
    each = F.transform(F.filter(F.split(text, "\n"), lambda x: trimmed(x) != ""), lambda x: F.struct(_line_hash(x).alias("h"), F.size(F.split(trimmed(x), BLANK + "+")).alias("w")))
    lines = docs.select(*_host_and_text(host, text), each.alias("_a"))
    # outer: explode puts filters on the array under it, which compute the array again
    lines = lines.select("*", F.xxhash64(F.sort_array(F.array_distinct("_a.h"))).alias("_s")).select("_host", "_t1", "_t2", "_s", F.explode_outer("_a").alias("_a")).filter("_a IS NOT NULL")
    # per text: equal texts add up evenly, so shares of words are those of one
    own = stage(lines.select("_host", "_t1", "_t2", "_s", "_a.h", "_a.w").groupBy("_host", "_t1", "_t2", "_s", "h").agg(F.sum("w").alias("w")), "host-lines")
    common = own.select("_host", "h", "_s").distinct().groupBy("_host", "h").agg(F.count("*").alias("n")).filter(F.col("n") >= line_texts).select("_host", "h")
    lost = own.join(common, ["_host", "h"]).groupBy("_host", "_t1", "_t2").agg(F.collect_set("h").alias("_drop"), F.sum("w").alias("_lost"))
    every = own.groupBy("_host", "_t1", "_t2").agg(F.sum("w").alias("_all"))
    return every.join(lost, ["_host", "_t1", "_t2"])


def without_lines(text: str, drop: str) -> Column:
    """`text` without the lines whose hashes are in `drop`; blank lines stay, a null `drop` changes nothing."""
    rest = F.filter(F.split(text, "\n"), lambda x: (trimmed(x) == "") | ~F.array_contains(drop, _line_hash(x)))
    return F.when(F.col(drop).isNull(), F.col(text)).otherwise(F.array_join(rest, "\n"))


def judge(docs: DataFrame, host: str = "source", text: str = "text", line_texts: int = LINE_TEXTS, remaining: float = REMAINING, keep_text: bool = True, least_left: int = LEAST_WORDS) -> DataFrame:
    """`docs` (without `text` if it is not to be kept, which spares moving it) plus _n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat_words, _base_failed, _n_left, _kept and, with the text, _clean.

    _clean is the text without its boilerplate lines, _n_left the words in it. A document goes if
    _n_left is below `least_left` or below `remaining` of its words.

    A null or empty text has no words and fails. Every row is judged and comes back, repeated rows
    too; equal texts of a host get the same verdict; texts with the same set of normalised lines count once; a null host is a host of its own. An
    empty table gives an empty table. Columns may have any names but those of the result.
    """
    columns, counts = docs.columns, ["_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words"]
    lines = stage(boilerplate(docs, host, text, line_texts), "boilerplate")
    placed = aside(docs, text)
    host_field = F.col("_text") if host == text else F.col(f"_row.c{columns.index(host)}")
    stats = text_statistics(placed.select("*", host_field.alias("_of")).select("_row", "_text", *_host_and_text("_of", "_text")), "_text")
    stats = stats if keep_text else stats.drop("_text")
    joined = stats.withColumn("_base_failed", base_failed()).join(lines if keep_text else lines.drop("_drop"), ["_host", "_t1", "_t2"], "left")
    # _all is _n_words times the number of equal texts
    left = F.col("_n_words") - F.coalesce(F.expr("_lost div (_all div _n_words)"), F.lit(0))
    joined = joined.withColumn("_n_left", left).withColumn("_kept", ~F.col("_base_failed") & F.coalesce(F.col("_all") - F.col("_lost") >= remaining * F.col("_all"), F.lit(True)) & (F.col("_n_left") >= least_left))
    clean = [without_lines("_text", "_drop").alias("_clean")] if keep_text else []
    return joined.select(*restored(columns, text, "_text" if keep_text else None), *counts, "_base_failed", "_n_left", "_kept", *clean)


SQL = r"""WITH b AS (SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM b),
g AS (SELECT doc_id, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, sum(least(3, coalesce(nx - i, 3))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM r) GROUP BY doc_id),
s AS (SELECT w.doc_id, host, text, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN c USING (doc_id)),
t AS (SELECT DISTINCT host, text FROM b),
k AS (SELECT host, text, regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g') AS line,
len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM (SELECT host, text,
regexp_replace(unnest(string_split(text, chr(10))), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM t) WHERE line <> ''),
f AS (SELECT host, line FROM k GROUP BY host, line HAVING count(DISTINCT text) >= 50),
d AS (SELECT k.host, k.text FROM k LEFT JOIN f ON k.host = f.host AND k.line = f.line GROUP BY k.host, k.text HAVING sum(CASE WHEN f.line IS NULL THEN n ELSE 0 END) < 0.05 * sum(n))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND d.text IS NULL AS kept FROM s LEFT JOIN d ON s.host = d.host AND s.text = d.text"""


@query("op2_quality_rules", SQL)
def op2_quality_rules(spark, sf_dir):
    # kept as the SQL twin has it, by the share alone; the pipeline asks for the words left too
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep_text=False, least_left=0)
    return out.select("doc_id", *[F.col(f"_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])
