"""Line-first rules against plain Python."""

import re

from pyspark.sql import functions as F

from gyrespark.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
def measures(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = {g: grams.count(g) for g in set(grams)}
    covered = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(3)}
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def prose(n):
    return "\n".join("Line " + " ".join(f"w{(i * 37 + j * j * 11) % 1009}" for j in range(15)) + "." for i in range(n))


CASES = [
    None, "", " \t\n ", "one", "a b c a b c", "a a a a", "x " * 60, prose(5), prose(5) + "\n" + prose(1), prose(200),
    "\n".join(["Home | About | Contact | Help"] * 3) + "\n" + prose(4), "é☃ 😀 #tag* x\x0by\x0cz", "\n\n".join([prose(3), "###", prose(3)]),
    "\n".join(f"Menu {i} of the site" for i in range(60)), " ".join(f"LOUD{i}!!" for i in range(80)), prose(300).replace("\n", " ")]


def test_measures_equal_plain_python(spark):
    rows = [(i, t, "x") for i, t in enumerate(CASES)] + [(None, prose(4), "y"), (1, "", "x")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, kept string")
    got = quality.op4(frame).collect()
    assert len(got) == len(rows)
    for r, (i, t, _) in zip(sorted(got, key=lambda r: (r[0] is None, r[0] or 0)), sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))):
        n, chars, symbols, dups, repeat = measures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dups, repeat), (i, t)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert not (r.kept and r.base_failed)


def test_verdicts_and_cleaning(spark):
    menu = "Home | About | Contact | Help"
    rows = [(0, prose(6)), (1, menu + "\n" + prose(6)), (2, "\n".join(f"Menu {i} of the site" for i in range(60))),
            (3, " ".join(f"LOUD{i}!!" for i in range(80))), (4, prose(6) + "\n\nLicensed under the Apache License, Version 2.0."),
            (5, " ".join(f"word{i}" for i in range(100)))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in quality.line_first(frame).collect()}
    assert [got[i].kept for i in range(6)] == [True, True, False, False, True, True]
    assert got[0].clean_text == rows[0][1] and got[1].clean_text == prose(6)
    assert "Apache" not in got[4].clean_text
    kept = quality.clean_documents(frame.withColumn("n_chars", F.length("text").cast("long")).withColumn("_text", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "n_chars", "_text"]
    assert {r.doc_id for r in kept.collect()} == {0, 1, 4, 5}
    assert kept.where("n_chars <> length(text)").count() == 0


def test_empty_table_and_native_plan(spark):
    frame = spark.createDataFrame([], "doc_id bigint, text string")
    out = quality.op4(frame)
    assert out.count() == 0
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_phrases_are_judged_by_their_share_of_a_line_of_any_length(spark):
    words = lambda n: " ".join(f"w{i}" for i in range(n))
    lines = [("few", words(30) + " sign in."), ("one in many", words(90) + " sign in."), ("footer", words(60) + " all rights reserved cookie sign in."),
             ("long footer", " ".join(words(30) + " privacy policy" for _ in range(400)) + "."), ("long prose", words(20000) + " cookie.")]
    got = {r.name: r.bad for r in spark.createDataFrame(lines, "name string, line string").select(
        "name", quality.bad_line(F.col("line"), F.size(F.split("line", " "))).alias("bad")).collect()}
    assert got == {"few": True, "one in many": False, "footer": True, "long footer": True, "long prose": False}
