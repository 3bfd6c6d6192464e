"""Texts that are long and monotonous: no operator may crash on them, run out of its stack, or take a quadratic time."""

import time

import pytest
from pyspark.sql import functions as F

from trackmill.llm import collocations, exact_dedup, fill_in_middle, license_scan, line_dedup, mixing, near, packing, pii, quality, simhash, toxicity, url_filter

N = 300_000
UNITS = ["b.", "Mr ", "Ab-", "Anna-", "# ", "* ", "a\n", "// ", " ", "x", "é", "<script ", "<link a", "<!-- ", "a=", "Dr. Anna ", "1-", "+1 ", "sk-a", "0 ", "license ", "and/or ", ""]
HEADS = {"b.": "a@", "# ": "license\n", "* ": "license\n", "// ": "license\n", " ": "license x", "a=": "<link "}


@pytest.fixture(scope="module")
def long(spark):
    texts = [(HEADS.get(u, "") + u * (N // len(u.encode()))) + (" x" if u == " " else "") for u in UNITS]
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(8).cache()


def lexicon(spark, docs):
    return toxicity.learn(docs, spark.createDataFrame([(0, 0, 1), (1, 1, 0)], "doc_id long, quality int, toxic int"))


RUNS = {
    "quality": lambda s, d: quality.judge(d),
    "license": lambda s, d: license_scan.scan(d),
    "lines": lambda s, d: line_dedup.line_dedup(d, min_docs=2),
    "pii": lambda s, d: pii.replace_entities(d, "k"),
    "packing": lambda s, d: packing.pack_documents(d),
    "simhash": lambda s, d: simhash.near_duplicate_groups(d),
    "near": lambda s, d: near.drop_near_duplicates(d),
    "toxicity": lambda s, d: toxicity.with_scores(d, lexicon(s, d)),
    "mixing": lambda s, d: mixing.mix(d),
    "exact": lambda s, d: exact_dedup.content_sort(d),
    "urls": lambda s, d: url_filter.filter_urls(d.select(F.col("doc_id").alias("page_id"), F.lit("http://a/b").alias("url"), F.concat(F.lit("canonical "), "text").alias("html"))),
    "fim": lambda s, d: fill_in_middle.fill_in_middle(d, rate=100),
    "collocations": lambda s, d: collocations.collocations(d, max_words=3),
}


@pytest.mark.parametrize("name", RUNS)
def test_long_monotonous_texts(spark, long, name):
    began = time.time()
    rows = RUNS[name](spark, long).collect()
    assert time.time() - began < 60
    if name not in ("packing", "collocations"):
        assert len(rows) == len(UNITS) if name != "near" else len(rows) <= len(UNITS)


def test_urls_of_long_pages(spark, long):
    pages = long.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a/"), F.substring("text", 1, 200_000)).alias("url"), F.concat("text", F.lit('<link rel="canonical" href="http://z.net/">')).alias("html"))
    rows = url_filter.filter_urls(pages.unionByName(pages)).collect()
    assert len(rows) == 2 * len(UNITS)


def test_marks_of_the_cut_in_a_text(spark):
    cut = pii._CUT
    texts = [cut, f"a{cut}b", f"Mr {cut} Smith", f"x {cut} mail jo@example.com {cut[0]} end {cut[0]}", f"{cut[0]}", f"call +1 212 555 0100 {cut}{cut}", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.replace_entities(docs, "k").collect()}
    assert len(rows) == len(texts) and pii.replace_entities(docs, "k").count() == len(texts)
    assert [rows[i].text for i in (0, 1, 4, 6, 7)] == [texts[i] for i in (0, 1, 4, 6, 7)]
    assert rows[3].n_entities == 1 and rows[3].text.startswith(f"x {cut} mail ") and rows[3].text.endswith(f" {cut[0]} end {cut[0]}") and "jo@example.com" not in rows[3].text
    assert rows[5].n_entities == 1 and rows[5].text.endswith(f" {cut}{cut}")
    assert rows[2].text.count(cut) == 1


def test_comment_marks_in_java_and_elsewhere(spark):
    lines = ["# # x", "* * *", " */", "a */ ", "a * */", "/* b **/", "--> c -->", "** */x", " \t # d \t */ \t", "x" + " " * 50 + "*/", "<!-- e -->", "dnl REM f", "#g", "*/ */"]
    import re

    df = spark.createDataFrame([(x,) for x in lines], "x string")
    got = [r[0] for r in df.select(F.regexp_replace(F.regexp_replace("x", license_scan._MARKS_JAVA, ""), license_scan._CLOSING_JAVA, "")).collect()]
    assert got == [re.sub(license_scan._CLOSING, "", re.sub(license_scan._MARKS, "", x), count=1) for x in lines]
