"""Line-first quality rules, in DataFrame expressions only.

Every line that has a word is judged by itself: shouting or missing
punctuation, navigation, boilerplate, and equality with an earlier line.
Failing lines are removed; a document that loses too many of its words is
rejected, as is one that fails the base rules (too few words, too many words
in repeated three-word windows).

Cases: a null or blank text has no words and is rejected; its cleaned text is
empty.  Rows are judged one by one, so repeated rows repeat their result and an
empty table gives an empty one.  A document without failing lines keeps its
text byte for byte; otherwise equal lines, blank ones too, are written once.
Equal three-word windows are found by 64-bit hashes.  A text is one row of one
task whatever its length, and every rule looks at whole lines of every length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyrespark.llm.common import SPACES, without, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 50
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•·>"
SHORT_LINE = 3        # words; a shorter line needs no closing mark
HEADING_LINE = 8      # words; up to here a line without a closing mark is a heading or a menu
PHRASE_SPAN = 40      # words of a line, of any length, that one phrase of navigation or boilerplate condemns
WORD = r"[^\x20\x09-\x0D]"
CLOSED = r"[.!?:;,…\"'”’»)\]][\x20\x09-\x0D]*$"
LOUD = r"[!?]{2,}(?:[\x20\x09-\x0D]|$)"
NAVIGATION = r"skip to (?:main )?content|read more|sign in|log in|next page|previous page|back to top|site map|click here"
BOILERPLATE = r"all rights reserved|terms of (?:use|service)|privacy policy|cookie|licensed under|copyright|javascript|subscribe to|powered by"
PHRASES = f"{NAVIGATION}|{BOILERPLATE}"


def _count(array: Column) -> Column:
    return F.size(array).cast("long")


def bad_line(line: Column, n: Column) -> Column:
    """Whether a line of ``n`` words fails a rule."""
    low = F.lower(line)
    seps = F.length(line) - F.length(without(line, SEPARATORS))
    loud = F.size(F.regexp_extract_all(line, F.lit(LOUD), F.lit(0)))
    return (
        ~line.rlike(r"\p{L}")
        | (line.rlike(r"[!?]{2}") & (loud * 2 > n))
        | ((n > SHORT_LINE) & (n <= HEADING_LINE) & ~line.rlike(CLOSED))
        | (line.rlike(f"[{SEPARATORS}][^{SEPARATORS}]*[{SEPARATORS}]") & (n <= 4 * seps))
        | (low.rlike(PHRASES) & (n <= PHRASE_SPAN * F.size(F.regexp_extract_all(low, F.lit(PHRASES), F.lit(0)))))
    )


def _repeat_words(h: str) -> list[tuple[str, Column]]:
    """Steps from word hashes ``h`` to the words covered by repeated three-word windows.

    Windows are sorted as plain numbers first; only a text in which two are equal
    sorts them again with their places.
    """
    last = F.size(h) - 3
    beside = lambda x, j: F.coalesce(F.get("_s", j - 1)["k"] == x["k"], F.lit(False)) | F.coalesce(F.get("_s", j + 1)["k"] == x["k"], F.lit(False))
    return [
        ("_k", F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))))),
        ("_o", F.sort_array("_k")),
        ("_any", F.exists(F.arrays_zip(F.col("_o").alias("a"), F.slice("_o", 2, F.greatest(F.size("_o"), F.lit(1))).alias("b")), lambda x: x["a"] == x["b"])),
        ("_s", F.when(F.col("_any"), F.sort_array(F.transform("_k", lambda x, i: F.struct(x.alias("k"), i.alias("p")))))),
        ("_d", F.array_sort(F.transform(F.filter("_s", beside), lambda x: x["p"]))),
        ("n_repeat_words", F.coalesce(F.aggregate(
            "_d", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
            lambda a: a["n"]), F.lit(0)).cast("long")),
    ]


def settled(frame: DataFrame) -> DataFrame:
    """The same rows behind a generator, so that a filter on a computed column is not
    pushed into the arrays it comes from, where it would be computed for every element."""
    return frame.select(F.explode(F.array(F.struct(*frame.columns))).alias("_r")).select("_r.*")


def line_first(docs: DataFrame, text_col: str = "text", max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """Add measures, ``base_failed``, ``kept`` and ``clean_text`` to a frame of (doc_id, text, ...).

    Added columns start from the text alone; input columns of these names are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("_t", text).withColumn("_w", words_of(F.col("_t"))).withColumn(
        "_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD)))
    out = out.withColumn("_u", F.transform(F.array_distinct("_l"), lambda x: F.struct(x.alias("l"), F.size(words_of(x)).alias("n"))))
    out = out.withColumns({"_h": F.transform("_w", lambda w: F.xxhash64(w)), "_bad": F.filter("_u", lambda x: bad_line(x["l"], x["n"])), "n_words": _count(F.col("_w"))})
    for name, column in _repeat_words("_h"):
        out = out.withColumn(name, column)
    words_in = lambda lines: F.aggregate(lines, F.lit(0), lambda a, x: a + x["n"])
    out = out.withColumns({
        "word_chars": F.length(without(F.col("_t"), SPACES)).cast("long"),
        "n_symbols": (F.length("_t") - F.length(without(F.col("_t"), SYMBOLS))).cast("long"),
        "n_dup_lines": _count(F.col("_l")) - _count(F.col("_u")),
        "n_kept_words": (words_in("_u") - words_in("_bad")).cast("long"),
    })
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    touched = (F.size("_bad") > 0) | (F.col("n_dup_lines") > 0)
    out = out.withColumns({
        "kept": ~F.col("base_failed") & (100 * (F.col("n_words") - F.col("n_kept_words")) <= max_lost_percent * F.col("n_words")),
        "clean_text": F.when(touched, F.array_join(F.array_except(F.split("_t", "\n"), F.transform("_bad", lambda x: x["l"])), "\n")).otherwise(F.col("_t")),
    }).drop("_t", "_w", "_l", "_u", "_h", "_bad", "_k", "_o", "_any", "_s", "_d")
    return settled(out)


def clean_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents that pass, with their cleaned text and its length; the other columns are unchanged."""
    own = [F.col(c) for c in docs.columns]
    judged = line_first(docs.select(F.struct(*own).alias("_row"), F.col(text_col).alias("_text")), "_text").where("kept")
    return judged.select(*[
        F.col("clean_text").alias(c) if c == text_col else F.length("clean_text").cast("long").alias(c) if c == "n_chars" else F.col(f"_row.`{c}`").alias(c)
        for c in docs.columns])


def op4(docs: DataFrame) -> DataFrame:
    judged = line_first(docs.select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    words = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    quote = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    count = lambda chars: f"length({{0}}) - length(regexp_replace({{0}}, '[{chars}]', '', 'g'))"
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {words.format("t")} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {quote(WORD)})) AS l FROM d),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS p, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS k FROM w WHERE len(w) >= 3),
c AS (SELECT r, k FROM g GROUP BY 1, 2 HAVING count(*) > 1),
rep AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT g.r, g.p + o AS p FROM g JOIN c ON c.r = g.r AND c.k = g.k, (SELECT unnest([0, 1, 2]) AS o)) GROUP BY 1),
u0 AS (SELECT r, unnest(list_distinct(l)) AS line FROM w),
u AS (SELECT *, len({words.format("line")}) AS n, {count(SEPARATORS).format("line")} AS seps FROM u0),
b AS (SELECT r, n, NOT regexp_matches(line, '\p{{L}}') OR (2 * len(regexp_extract_all(line, {quote(LOUD)})) > n)
  OR (n > {SHORT_LINE} AND n <= {HEADING_LINE} AND NOT regexp_matches(line, {quote(CLOSED)})) OR (seps >= 2 AND n <= 4 * seps)
  OR n <= {PHRASE_SPAN} * len(regexp_extract_all(lower(line), {quote(PHRASES)})) AS bad FROM u),
k AS (SELECT r, sum(n) FILTER (WHERE NOT bad) AS n FROM b GROUP BY 1),
m AS (SELECT w.r, doc_id, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x))) AS word_chars, {count(SYMBOLS).format("t")} AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(k.n, 0) AS n_kept FROM w LEFT JOIN rep ON rep.r = w.r LEFT JOIN k ON k.r = w.r),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND 100 * (n_words - n_kept) <= {MAX_LOST_PERCENT} * n_words AS kept FROM f
"""


SQL = _sql()
