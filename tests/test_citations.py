import pytest
from pyspark.sql import functions as F

from lexloom.operators import citations


def found(spark, text):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    return [r.asDict() for r in citations.extract(df, "id", "text").orderBy("position").collect()]


CASES = {
    "see (2014) 9 SCC 129 at para 20": ("(2014) 9 SCC 129", "SCC", 2014, "129"),
    "AIR 1973 SC 1461": ("AIR 1973 SC 1461", "AIR", 1973, "1461"),
    "2021 SCC OnLine Bom 123": ("2021 SCC OnLine Bom 123", "SCC OnLine", 2021, "123"),
    "reported as 2024:BHC-AS:12345": ("2024:BHC-AS:12345", "BHC-AS (neutral)", 2024, "12345"),
    "1997 (3) ALL MR 200": ("1997 (3) ALL MR 200", "ALL MR", 1997, "200"),
    "[2024] 10 S.C.R. 108": ("(2024) 10 SCR 108", "SCR", 2024, "108"),
    "2024INSC735": ("2024INSC735", "INSC (neutral)", 2024, "735"),
    "Section 138 of the Negotiable Instruments Act, 1881": None,
}


def test_case_families(spark):
    rows = [(t, t) for t, want in CASES.items() if want]
    df = spark.createDataFrame(rows, "id string, text string")
    got = {
        r.id: (r.normalized, r.reporter, r.year, r.page)
        for r in citations.extract(df, "id", "text").collect()
    }
    assert got == {t: want for t, want in CASES.items() if want}


def test_spaced_neutral_citation_counts_once(spark):
    rows = found(spark, "2023 INSC 456")
    assert [r["normalized"] for r in rows] == ["2023 INSC 456"]


@pytest.mark.parametrize(
    "text, name",
    [
        ("In Swastik Gases v. Indian Oil, (2013) 9 SCC 32, the Court held", "Swastik Gases v. Indian Oil"),
        ("See Dashrath Rathod v. State of Maharashtra, (2014) 9 SCC 129", "Dashrath Rathod v. State of Maharashtra"),
        ("In re Vinay Mishra v. The Bar, (1995) 2 SCC 584", "In re Vinay Mishra v. The Bar"),
        ("A Ltd v. B Ltd; 111 222 333 444 555 666 777 888 999, (2014) 9 SCC 129", None),
    ],
)
def test_case_name(spark, text, name):
    assert found(spark, text)[0]["case_name"] == name


def test_repeats_and_plain_prose(spark):
    assert len(found(spark, "(2014) 9 SCC 129 and again (2014) 9 SCC 129")) == 1
    assert found(spark, "The parties met on 5 occasions.") == []
    assert found(spark, "") == []


@pytest.mark.parametrize(
    "text, section, statute, kind",
    [
        ("Section 138 of the Negotiable Instruments Act, 1881", "138", "Negotiable Instruments Act, 1881", "statute"),
        ("charged under s. 420 IPC", "420", "Indian Penal Code, 1860", "statute"),
        ("Section 4(2) of the Limitation Act, 1963", "4(2)", "Limitation Act, 1963", "statute"),
        ("Order VII Rule 11 CPC", "Order VII Rule 11", "Code of Civil Procedure, 1908", "statute"),
        ("Article 21 of the Constitution", "21", "Constitution of India", "constitution"),
    ],
)
def test_statutes(spark, text, section, statute, kind):
    first = found(spark, text)[0]
    assert (first["section"], first["statute"], first["kind"]) == (section, statute, kind)


def test_order_and_offsets_count_characters(spark):
    text = "धारा é — Under Section 138 of the Negotiable Instruments Act, 1881, and as held in (2014) 9 SCC 129, it lies."
    rows = found(spark, text)
    assert [r["kind"] for r in rows] == ["statute", "case"]
    assert [r["position"] for r in rows] == [text.index("Section"), text.index("(2014)")]


def test_longest_citation_is_the_parsed_one(spark):
    text = "s. 420 IPC in 2021 SCC OnLine Bom 123"
    df = spark.createDataFrame([(1, text), (2, "some arbitrary words")], "id int, text string")
    rows = citations.parse_single(df, "id", "text").collect()
    assert [(r.id, r.normalized) for r in rows] == [(1, "2021 SCC OnLine Bom 123")]


def test_keys_ignore_punctuation(spark):
    from lexloom.functions.text import citation_key

    forms = ["[2024] 10 S.C.R. 108", "(2024) 10 SCR 108", "2024 10 SCR 108"]
    df = spark.createDataFrame([(f,) for f in forms], "c string")
    assert {r.k for r in df.select(citation_key(F.col("c")).alias("k")).collect()} == {"202410scr108"}


def test_control_characters_in_the_text(spark):
    text = "A\u0003 \u0001Ram Lal v. Shyam Das\u0002, (2014) 9 SCC 129 and \u0001 Order 1 Rule 2 of the CPC"
    rows = found(spark, text)
    assert [(r["position"], r["normalized"], r["case_name"]) for r in rows] == [
        (text.index("(2014)"), "(2014) 9 SCC 129", "Ram Lal v. Shyam Das"),
        (text.index("Order"), "Order 1 Rule 2, Code of Civil Procedure, 1908", None),
    ]


def test_only_place_of_a_match_is_no_part_of_something_else(spark):
    import re

    from lexloom.functions import regex

    pattern = r"\b2\d{3}INSC\d+\b"
    texts = [
        "", "none here", "in 2001INSC5.", "x2001INSC5 then 2001INSC5", "2001INSC5, x2001INSC5", "é😀 2001INSC5", "2001INSC5 2001INSC5", "2001INSC55 2001INSC5", None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.m and [(x.pos, x.raw) for x in r.m] for r in regex.with_located(df, "text", pattern, "m").collect()}
    assert [got[i] or [] for i in range(len(texts))] == [[(m.start(), m.group()) for m in re.finditer(pattern, t or "")] for t in texts]
    only = df.selectExpr("id", "array('2001INSC5') AS raws", "text").selectExpr("id", f"{regex._only_place('text', 'raws')} AS at")
    assert {r.id: r.at for r in only.collect() if r.id in (2, 3, 4, 5)} == {2: 3, 3: None, 4: None, 5: 3}


def test_names_start_as_without_the_lookbehind(spark):
    from lexloom.rules.citation_forms import CASE_NAME

    plain = r"(?i)((?:[A-Z][\w&.'\-]*\s+){0,6}[A-Z][\w&.'\-]*)\s+(?:v\.?|vs\.?|versus)\s+((?:[A-Z][\w&.'\-]*\s+){0,6}[A-Z][\w&.'\-]*)"
    assert CASE_NAME != plain
    texts = [
        "In Ram v. Shyam and 3Com Ltd vs. x-Y v. Z", "(Ram versus M/s. A&B", "éRam v v v. v", "'Tis 9a v. b9 v. c. D", "a b c d e f g h i v. j k l m n o p q r v. s",
        "Ram v. Shyam v. Mohan v. X", "ſa v. Kb", "v. v. v.", "Ram  v.\tShyam", "_a v. b", "",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    marks = [F.regexp_replace("t", "(?Uid)" + p[4:], "<$1|$2>") for p in (plain, CASE_NAME)]
    assert df.where(marks[0] != marks[1]).count() == 0


def test_extraction_is_made_of_methods_that_the_jvm_compiles(spark):
    import re

    texts = spark.createDataFrame([(1, "see (2014) 9 SCC 129")], "id int, text string").repartition(2)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the code is made at once
    try:
        shown = citations.extract(texts, "id", "text")._jdf.queryExecution().explainString(mode)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", shown)]
    assert sizes and max(sizes) < 8000, sizes


def test_patterns_match_as_without_the_look_ahead(spark):
    import re

    from lexloom.rules import citation_forms as forms

    text = (
        "AIR 1973 SC 1461, xAIR 1973 SC 1, 1973 AIR SC 2; é2021 SCC OnLine Bom 123 2021 SCC OnLine Bom 123; 2024:BHC-AS:12345:2 12024:AB:1; 1997 (3) ALL MR 200 "
        "2024insc735 _2024INSC7 2024 INſC 7; Sections Sec. 4(2) of the Limitation Act, 1963 s. 420 IPC ss. 5 X Article 21 art. 14(1) Part 5 Art 6; Order VII Rule 11 CPC Border 1 Rule 2 (2014) 9 SCC 129"
    )
    df = spark.createDataFrame([(text,)], "t string")
    patterns = [p for _, p in citations._CASE_FAMILIES + citations._STATUTE_FAMILIES]
    plain = [re.sub(r"\(\?=\[?\w+\]?\)", "", p) for p in patterns]
    assert sum(a != b for a, b in zip(patterns, plain)) == 8 and forms.BRACKETED_YEAR in plain
    all_of = lambda p: F.regexp_extract_all("t", F.lit(citations._pattern(p)), F.lit(0))
    row = df.select(*[all_of(p) for p in patterns + plain]).first()
    assert list(row[:9]) == list(row[9:]) and all(row)


def test_orders_lose_the_blanks_after_them(spark):
    rows = found(spark, "Order 1 Rule 2  \n and Order II, Rule 3 of the ")
    assert [r["raw"] for r in rows] == ["Order 1 Rule 2", "Order II, Rule 3 of the"]


def test_positions_beyond_ascii_and_with_repeats(spark):
    text = "2014INSC5 é😀 2015INSC6 x2016INSC7 2016INSC7"
    for t in (text, text.replace("é😀", "ee")):
        assert [r["position"] for r in found(spark, t)] == [t.index("2014"), t.index("2015"), t.rindex("2016")]


def test_fewer_fields_are_the_same_citations(spark):
    df = spark.createDataFrame([(1, "In Ram v. Shyam, (2014) 9 SCC 129 and 2023 INSC 4, 2023INSC4"), (1, "s. 420 IPC (2014) 9 SCC 129"), (None, "Article 21")], "id int, text string")
    few = ["kind", "family", "position", "citation_key", "case_name"]
    rows = lambda d: sorted(map(tuple, d.select("id", *few).collect()), key=str)
    assert rows(citations.extract(df, "id", "text", fields=few)) == rows(citations.extract(df, "id", "text"))
