import json
import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from lexloom.errors import InvalidRequest, SourceUnavailable
from lexloom.functions import text as textfn
from lexloom.functions.regex import required_text
from lexloom.operators import courts, review, statutes, translation
from lexloom.rules import clauses, drafts
from lexloom.sources import calendars, files, html_index, listing
from lexloom.sources import statutes as statute_files

CONTRACT = """
SERVICES AGREEMENT between Northwind Pvt Ltd and Ms C Rao.
WHEREAS the Provider has agreed to render services.

1. TERM
This Agreement shall remain in force for 12 months and shall automatically
renew for successive periods unless either party gives notice.

2. FEES
The consideration shall be paid against invoice.

3. INDEMNITY
The Provider shall indemnify the Company against all claims and losses.

4. RESTRAINT
For 24 months after termination of this Agreement, the Provider
shall not directly or indirectly compete with the Company.

5. DISPUTES
Any dispute shall be referred to arbitration. The venue shall be Pune.
The courts at Pune shall have exclusive jurisdiction.
"""
SEATED = (
    "Any dispute goes to arbitration by a sole arbitrator. The seat of arbitration shall be Pune. "
    "This Agreement is governed by the laws of India and is duly stamped. Either party may terminate "
    "on notice sent to the address below. Aggregate liability shall be capped at the fees paid."
)
UNICODE = "Vélo warranté warranty. Indemnité, indemnification — जमानत NON-COMPETE “agreement” ſtamped Duty agreement"


@pytest.fixture(scope="module")
def contracts(spark):
    rows = [(1, CONTRACT), (2, SEATED), (3, ""), (4, UNICODE), (5, "termination " * 9)]
    return spark.createDataFrame(rows, "id int, text string")


def test_clause_hits_follow_the_pattern_order(contracts):
    got = {(r.id, r.clause, r.hit): (r.position, r.excerpt) for r in review.clause_hits(contracts, "id", "text").collect()}
    want = {}
    for i, text in [(r.id, r.text) for r in contracts.collect()]:
        for key, _, _, patterns in clauses.CLAUSE_TYPES:
            hits = [m for p in patterns for m in re.finditer(p, text, re.I)][: clauses.CLAUSE_MAX_HITS]
            for n, m in enumerate(hits, 1):
                near = text[max(0, m.start() - clauses.CLAUSE_BEFORE) : m.end() + clauses.CLAUSE_AFTER]
                want[(i, key, n)] = (m.start(), " ".join(near.split()))
    assert got == want


def test_risks(contracts):
    got = {}
    for r in review.risk_flags(contracts, "id", "text").collect():
        got.setdefault(r.id, {})[r.rule] = r
    first = got[1]
    assert first["post_termination_non_compete"].severity == "high"
    assert "section 27" in first["post_termination_non_compete"].authority
    assert {"arbitration_seat_unclear", "uncapped_liability", "auto_renewal"} <= set(first)
    assert first["arbitration_seat_unclear"].position == -1
    assert not {"arbitration_seat_unclear", "uncapped_liability"} & set(got.get(2, {}))
    assert 3 not in got
    for i, text in [(r.id, r.text) for r in contracts.collect()]:
        want = set()
        for key, _, _, pattern, absent, gate, _ in clauses.RISK_RULES:
            if gate and not re.search(gate, text, re.I):
                continue
            if (re.search(pattern, text, re.I | re.S) is None) == absent:
                want.add(key)
        assert set(got.get(i, {})) == want


def test_missing_and_summary(contracts):
    missing = {r.id: r.missing for r in review.missing_clauses(contracts, "id", "text").collect()}
    assert "governing_law" in missing[1] and "governing_law" not in missing[2]
    assert missing[3] == [k for k, _, expected, _ in clauses.CLAUSE_TYPES if expected]
    counts = {r.id: r for r in review.flags_by_severity(review.risk_flags(contracts, "id", "text"), "id").collect()}
    assert counts[1].high >= 3 and counts[1].flag_count == counts[1].high + counts[1].medium + counts[1].low


def test_required_text_is_in_every_match():
    samples = CONTRACT + SEATED + UNICODE
    for _, _, _, patterns in clauses.CLAUSE_TYPES:
        for p in patterns:
            for m in re.finditer(p, samples, re.I):
                assert required_text(p).lower() in m.group(0).lower().replace("ſ", "s")
    assert required_text(r"a|b") == "" and required_text(r"non.?compet(e|ition)") == "compet"


def test_draft_issues(spark):
    rows = [
        (1, "COMPLAINT of {{ name }} [insert date] XXXX affidavit notice TBD"),
        (2, "petition with verification, prayer, limitation, jurisdiction, dated: today"),
        (3, "letter of 1/2/2020"),
    ]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {}
    for r in review.draft_issues(df, "id", "text").collect():
        got.setdefault(r.id, set()).add(r.issue)
    assert got == {
        1: {"unrendered_placeholder", "bracketed_placeholder", "literal_xxx", "to_be_decided", "no_verification", "no_prayer",
            "no_limitation", "no_jurisdiction", "no_affirmation", "no_service_mode", "no_date"},
    }


def test_forum_and_directory(spark):
    df = spark.createDataFrame([("Dishonoured CHEQUE",), ("defective phone",), ("loan",)], "s string")
    got = [r.f.basis for r in df.select(courts.forum(F.col("s")).alias("f")).collect()]
    assert got[0].startswith("section 142") and got[1].startswith("sections 34") and got[2].startswith("sections 15")
    assert courts.court_directory(spark, "tribunal").count() == 6
    with pytest.raises(InvalidRequest):
        courts.court_directory(spark, "moot")


def test_translation(spark):
    df = spark.createDataFrame([("Date: 1 May\nConsumer complaint no. ________ of 2024",), ("nothing",)], "t string")
    rows = translation.translate(df, "t", "hi-IN").collect()
    by = {r.t: (r.translated, r.sentences_translated) for r in rows}
    assert by["nothing"] == ("nothing", 0)
    assert by["Date: 1 May\nConsumer complaint no. ________ of 2024"][0].startswith("दिनांक: 1 May\n")
    assert translation.language_code("xx") == "en" and translation.language_code("HI-in") == "hi"
    assert [r.sentences_translated for r in translation.translate(df, "t", "ta").collect()] == [0, 0]


def test_text_helpers(spark):
    def one(column):
        return spark.range(1).select(column.alias("x")).first().x

    lit = F.lit
    assert one(textfn.section_key(lit("Section 138-A (1)."))) == "138a"
    assert one(textfn.concordance_key(lit(" 318 (4). "))) == "318(4)"
    assert one(textfn.act_key(lit("The  N.I. Act, 1881"))) == "ni act 1881"
    assert one(textfn.party_terms(lit("MCA/1/2024 of CLARA DIAS Vs THE STATE OF Goa Municipal Corp"))) == ["CLARA", "DIAS", "Municipal"]
    assert one(textfn.strip_markup(lit("a<br/>b <b>c</b>d"))) == "a b cd"
    assert one(textfn.loose_date(lit(" 05-Jan-2024 "))) == "2024-01-05"
    assert one(textfn.start_year(lit("1862-65"))) == 1862
    for value, want in [("200000", "2,00,000"), ("12345678.5", "1,23,45,678"), ("-999.5", "-1,000"), ("2.5", "2"), ("x", "x")]:
        assert one(textfn.indian_grouping(lit(value))) == want
    df = spark.createDataFrame([("&lt;b&gt; &hellip;",)], "c string")
    assert df.select(textfn.unescape_entities("c").alias("x")).first().x == "<b> …"


def act(slug, title, **more):
    return {"slug": slug, "title": title, **more}


def test_act_files(spark, tmp_path):
    good = act(
        "cpa-2019", "Consumer Protection Act, 2019", short_title="CPA", coverage="full", aliases=["COPRA"],
        sections=[{"number": "1", "heading": "Old", "text": "x"}, {"number": "Section 1.", "heading": "New", "text": "y", "text_kind": "summary"}, {"number": 2, "heading": "Two"}],
    )
    later = act("xpa", "Extra Act", aliases=["copra"], sections=[{"number": "9", "heading": "h"}])
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text(json.dumps(later))
    (tmp_path / "broken.json").write_text("{ not json")
    (tmp_path / "nonumber.json").write_text(json.dumps(act("z", "Z", sections=[{"heading": "h"}])))
    raw = statute_files.read_acts(spark, str(tmp_path))
    acts, sections, aliases = statute_files.acts_table(raw), statute_files.sections_table(raw), statute_files.alias_table(raw)
    assert {r.slug: r.coverage for r in acts.collect()} == {"cpa-2019": "full", "xpa": "partial"}
    assert {(r.slug, r.heading) for r in sections.collect()} == {("cpa-2019", "New"), ("cpa-2019", "Two"), ("xpa", "h")}
    assert {r.alias: r.slug for r in aliases.collect()}["copra"] == "xpa"
    names = ["the Consumer Protection Act 2019", "Consumer Protection Act", "Consumer Protectoin Act, 2019", "Unrelated Statute of Wills"]
    got = {r.name: (r.slug, r.stage) for r in statutes.resolve_acts(spark.createDataFrame([(n,) for n in names], "name string"), aliases).collect()}
    assert got == {names[0]: ("cpa-2019", 0), names[1]: ("cpa-2019", 1), names[2]: ("cpa-2019", 2)}
    cards = {r.number: r.caveat for r in statutes.section_cards(sections).collect()}
    assert cards["Section 1."] and cards["2"] is None
    with pytest.raises(SourceUnavailable):
        statute_files.read_acts(spark, str(tmp_path / "none"))


def test_upstream_sections(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        from lexloom.sources.schemas import UPSTREAM_SECTION

        rows = [(None, " 1 ", "Ch", None, " Head ", " Body "), (None, None, None, None, "no number", None), ("2", None, "", "3", None, None)]
        df = spark.createDataFrame(rows, UPSTREAM_SECTION)
        got = [tuple(r) for r in statute_files.upstream_sections(df, "ipc").collect()]
        assert got == [("ipc", "1", "Head", "Body", "Ch"), ("ipc", "2", "", "", "3")]
        with pytest.raises(SourceUnavailable):
            statute_files.upstream_sections(df.where("section = 'x'"), "ipc")
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")


def test_concordance(spark):
    df = spark.createDataFrame([("420",), ("318",), ("63",), ("nope",)], "section string")
    got = {(r.section, r.direction, r.domain, r.old_section, r.new_section) for r in statutes.map_sections(df, "section").collect()}
    assert ("420", "old_to_new", "penal", "420", "318(4)") in got
    assert {o for s, d, _, o, _ in got if s == "318" and d == "new_to_old"} == {"415", "417", "420"}
    assert ("63", "new_to_old", "evidence", "65B", "63") in got and ("63", "old_to_new", "evidence", "63", "58") in got
    totals = {r.domain: r.pairs for r in statutes.concordance_coverage(statutes.concordance_table(spark)).collect()}
    assert totals == {"penal": 54, "procedure": 31, "evidence": 18, "total": 103}
    with pytest.raises(InvalidRequest):
        statutes.map_sections(df, "section", "sideways")


def test_suggestions(spark):
    from lexloom.rules import concordance
    from lexloom.rules.limitation import LIMITATION_RULES

    df = spark.createDataFrame([("money lent to a friend",), ("criminal breach of trust",), ("of a",)], "t string")
    rules = df.select(statutes.best_rules(F.col("t"), LIMITATION_RULES).alias("b")).collect()
    assert "money_lent" in [b.key for b in rules[0].b] and rules[2].b == []
    pairs = df.select(statutes.best_subjects(F.col("t"), list(concordance.all_pairs())).alias("b")).collect()
    assert pairs[1].b[0].key == "405 penal" and pairs[1].b[0].score == 3


def test_holiday_documents(spark):
    body = json.dumps({"X": {"2026": [{"date": "2026-03-04", "occasion": "Holi"}, {"date": "bad"}, {"date": "2026-03-05"}], "soon": [{"date": "2026-01-01"}]}})
    df = spark.createDataFrame([(body,), ("{broken",)], "b string")
    got = {(r.court, r.day, r.occasion) for r in calendars.published_holidays(df, "b").collect()}
    assert got == {("X", date(2026, 3, 4), "Holi"), ("X", date(2026, 3, 5), "court holiday")}


def test_listing(spark, tmp_path):
    xml = (
        '<ListBucketResult xmlns="http://s3.amazonaws.com/doc/2006-03-01/">'
        "<Contents><Key>m/year=2020/metadata.parquet</Key><Size>5</Size></Contents>"
        "<Contents><Key>m/year=2020/court=27_1/bench=b/metadata.parquet</Key><Size>7</Size></Contents>"
        "<Contents><Key>m/year=2020/court=27_1/bench=b/mobile.parquet</Key><Size>9</Size></Contents>"
        "<NextContinuationToken>abc</NextContinuationToken></ListBucketResult>"
    )
    df = spark.createDataFrame([(xml,)], "x string")
    keys = listing.parse_listing(df, "x")
    assert keys.count() == 3 and listing.next_tokens(df, "x").first().token == "abc"
    wanted = listing.wanted_keys(keys, ["SC", "27_1"], 2019, 2021)
    assert {r.target for r in wanted.collect()} == {"sc/metadata/year=2020/metadata.parquet", "hc/metadata/year=2020/court=27_1/bench=b/metadata.parquet"}
    held = spark.createDataFrame([("sc/metadata/year=2020/metadata.parquet", 5)], "target string, size bigint")
    totals = {r.court: (r.files, r.bytes, r.skipped) for r in listing.sync_totals(listing.fetch_plan(wanted, held)).collect()}
    assert totals == {"Supreme Court of India": (0, 0, 1), "Bombay High Court": (1, 7, 0), "all courts": (1, 7, 1)}
    assert listing.fetch_plan(wanted, held, force=True).where("fetch").count() == 2
    with pytest.raises(InvalidRequest):
        listing.wanted_keys(keys, ["SC"], 2022, 2021)


def table_row(n, title, day, cnr):
    return f'<tr><td>{n}</td><td>WP/{n}</td><td>{title}</td><td>J</td><td><a href="order-pdf/{cnr}/2024-01-01?path=p{n}">{day}</a></td></tr>'


def test_recent_judgments_stop_at_the_first_old_row(spark):
    pages = [
        (1, table_row(1, "<b>A</b> v B", "05/03/2024", "C1") + table_row(2, "", "05/03/2024", "C2") + "<tr><td>short</td></tr>"),
        (2, table_row(3, "again", "04/03/2024", "C1") + table_row(4, "C v D", "03/03/2024", "C3") + table_row(5, "old", "01/01/2020", "C4") + table_row(6, "after", "03/03/2024", "C5")),
        (3, table_row(7, "later page", "03/03/2024", "C6")),
    ]
    df = spark.createDataFrame(pages, "page int, html string")
    got = {(r.cnr, r.title, r.decision_date) for r in html_index.recent_judgments(df, "page", "html", date(2024, 1, 1)).collect()}
    assert got == {("C1", "A v B", "2024-03-05"), ("C3", "C v D", "2024-03-03")}


def test_reachable_pages(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "url string")
    assert {(r.url, r.depth) for r in html_index.reachable_pages(start, edges).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def levels(start, edges):
    seen, frontier, depth = {}, {start}, 0
    while frontier:
        seen.update(dict.fromkeys(frontier, depth))
        frontier = {b for a, b in edges if a in frontier} - set(seen)
        depth += 1
    return seen


@pytest.mark.parametrize("seed", range(4))
def test_depths_with_chains_rings_and_short_cuts(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(25), rng.randrange(25)) for _ in range(rng.choice([20, 40]))]
    nodes = 100
    for a, b in list(edges[:12]):
        steps = [a, *range(nodes, nodes + rng.randrange(1, 9)), b]
        nodes += 10
        edges += zip(steps, steps[1:])
    edges += [(500, 501), (501, 502), (502, 500), (600, 601), (3, 3), edges[0]]
    start = edges[0][0]
    rows = [(f"p{a}", f"p{b}") for a, b in edges] + [(None, "p1"), ("p1", None)]
    df = spark.createDataFrame(rows, "src string, dst string")
    found = html_index.reachable_pages(spark.createDataFrame([(f"p{start}",)], "url string"), df).collect()
    assert {r.url: r.depth for r in found} == {f"p{k}": v for k, v in levels(start, edges).items()}
    assert len(found) == len({r.url for r in found})


def test_a_long_chain_takes_few_rounds(spark):
    edges = spark.range(1000).selectExpr("concat('p', id) as src", "concat('p', id + 1) as dst")
    start = spark.createDataFrame([("p0",)], "url string")
    spark.sparkContext.setJobGroup("chain", "")
    found = html_index.reachable_pages(start, edges)
    assert {(r.url, r.depth) for r in found.collect()} == {(f"p{i}", i) for i in range(1001)}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 120, jobs


def test_a_crawl_is_never_cut_silently(spark):
    edges = spark.createDataFrame([(f"p{i}", f"p{i + 1}") for i in range(6)], "src string, dst string")
    start = spark.createDataFrame([("p0",)], "url string")
    assert html_index.reachable_pages(start, edges, max_depth=6).count() == 7
    with pytest.raises(InvalidRequest):
        html_index.reachable_pages(start, edges, max_depth=5)


def test_document_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain é", encoding="utf-8")
    (tmp_path / "b.md").write_text("# head")
    (tmp_path / "c.txt").write_text("   ")
    (tmp_path / "d.xls").write_bytes(b"\x00")
    got = {r.path.rsplit("/", 1)[-1]: (r.text, r.problem) for r in files.document_text(files.read_binary(spark, str(tmp_path))).collect()}
    assert got == {"a.txt": ("plain é", None), "b.md": ("# head", None), "c.txt": (None, "no text"), "d.xls": (None, "unsupported file type")}
    with pytest.raises(SourceUnavailable):
        files.require_text(files.document_text(files.read_binary(spark, str(tmp_path), "*.xls")))
    assert drafts.MAX_CHUNK_CHARS == 1800


def test_parameter_gaps(spark):
    df = spark.createDataFrame([(["a", "b"], ["c"], ["b", "c", "z"])], "r array<string>, o array<string>, s array<string>")
    row = df.select(review.parameter_gaps(F.col("r"), F.col("o"), F.col("s")).alias("g")).first().g
    assert (row.missing, row.unknown) == (["a"], ["z"])
