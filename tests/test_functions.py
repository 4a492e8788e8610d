"""Scalar rules against input/expected pairs."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from joblattice.functions.stem import with_stem
from joblattice.functions import classify, cycle, dates, identity, places, text, titles

SEEN = datetime(2026, 8, 1, 12, 0)


def check(pairs, cases, schema, build):
    got = pairs([c[0] if isinstance(c[0], tuple) else (c[0],) for c in cases], schema, build)
    want = [c[1] for c in cases]
    assert [(c[0], g) for c, g in zip(cases, got)] == [(c[0], w) for c, w in zip(cases, want)]


def test_intern_titles(pairs):
    check(pairs, [
        ("Packaging Intern", True), ("Fleet Internship", True), ("Rail Co-op", True),
        ("COOP, Yard", True), ("Summer Analyst, Rates", True), ("Fleet Manager", False),
        ("Internal Controls Lead", False), ("International Sales", False), (None, False),
    ], "t string", text.is_internship("t"))


def test_keywords_are_whole_words(pairs):
    build = text.matches_any("t", ["US", "c++", "logistics"])
    check(pairs, [
        ("Sydney, Australia", False), ("Austin, US", True), ("Logistic lead", False),
        ("LOGISTICS lead", True), ("knows c++", False), ("c++x", True), ("ÉUS", False),
    ], "t string", build)


def test_job_function(pairs):
    build = classify.job_function("t", "s", "c")
    check(pairs, [
        (("Backend Developer Intern", "", ""), "Software Engineering"),
        (("Applied Scientist Intern", "", ""), "Data, AI & Machine Learning"),
        (("PCB Layout Co-op", "", ""), "Hardware & Electrical Engineering"),
        (("Avionics Co-op", "", ""), "Mechanical & Aerospace Engineering"),
        (("UI/UX Intern", "", ""), "Product Management & Design"),
        (("Real Estate Private Equity Intern", "", ""), "Finance, Accounting & Trading"),
        (("Real estate debt and equity", "", ""), "Finance, Accounting & Trading"),
        (("Intern", "", " Data Science "), "Data, AI & Machine Learning"),
        (("Intern", "work on hydrology", "unknown"), "Civil & Environmental Engineering"),
        (("Intern", "x" * 300 + " hydrology", ""), "Other"),
        ((None, None, None), "Other"),
    ], "t string, s string, c string", build)


def test_arrangements(pairs):
    check(pairs, [
        ("Hybrid - Remote/Chicago", "hybrid"), ("Work from home", "remote"), ("WFH", "remote"),
        ("On site, Reno", "onsite"), ("In-Person", "onsite"), ("Remoteville", ""), (None, ""),
    ], "t string", classify.arrangement_from_location("t"))
    check(pairs, [
        (("Intern [Remote]", "Reno, NV", ""), "remote"), (("Intern (Hybrid)", "Remote", ""), "hybrid"),
        (("Telecommute intern", "", ""), "remote"), (("Remote intern", "", " Onsite "), "onsite"),
        (("Intern", "Reno", "weird"), ""),
    ], "t string, l string, c string", classify.standardize_arrangement("t", "l", "c"))
    check(pairs, [
        ("Fully_Remote", "remote"), ("remote-first", "remote"), ("HYBRID", "hybrid"),
        ("In Office", "onsite"), ("office", "onsite"), ("galaxy", ""), (None, ""),
    ], "t string", classify.normalise_arrangement("t"))


def test_locations(pairs):
    check(pairs, [
        ("Fresno, California, USA", "Fresno, CA"), ("New York, New York", "New York, NY"),
        ("Tacoma, WA 98401", "Tacoma, WA"), ("12 Main Street, Quincy, MA 02169", "Quincy, MA"),
        ("USA - Ohio - Dayton", "Dayton, OH"), ("US - CA - Fresno", "Fresno, CA"),
        ("chicago", "Chicago, IL"), ("12 Locations", "Multiple Locations"),
        ("Reno, NV; Tacoma, WA", "Multiple Locations"), ("Reno | Tacoma", "Multiple Locations"),
        ("SGP - Jurong", "Singapore"), ("MYS - Penang", "Penang, Malaysia"),
        ("CHL - Region - santiago centro", "Santiago Centro, Chile"), ("London, UK", "London, United Kingdom"),
        ("Toronto, ON", "Toronto, ON, Canada"), ("Remote - US", "Remote, United States"),
        ("USA - Remote", "Remote, United States"), ("Remote - Reno, NV", "Reno, NV"),
        ("Reno, NV (Hybrid)", "Reno, NV"), ("In-Office", "Not Specified"), ("", "Not Specified"),
        (None, "Not Specified"), ("CA-QC-LAVAL-J01 ~ 1 Main Blvd", "Laval, QC"),
        ("Plant 7 ~ gate", "Plant 7"), ("Lyon,  Rhône", "Lyon, Rhône"), ("\u00a0Reno, nv\u00a0", "Reno, NV"),
    ], "t string", lambda df: places.standardize_location(df, "t", "out"))


def test_place_for_map(pairs):
    check(pairs, [
        ("Remote", None), ("Remote, United States", None), ("Remote - USA", None), ("Flexible / Remote", None),
        ("Remote United States of America", None), ("3 Locations", None), ("N/A", None), ("", None),
        ("Reno, NV", "Reno, NV"), ("Remote - Reno", "Reno"), ("London, United Kingdom", "London, United Kingdom"),
    ], "t string", places.map_place("t"))


def test_cycles(pairs):
    check(pairs, [
        ("Fall/Winter 2026-2027", ("fall", 2026)), ("Autumn '27", ("fall", 2027)), ("FY'28 Intern", ("", 2028)),
        ("JR002026", ("", None)), ("Intern 27", ("", None)), ("2045 Spring", ("spring", None)), (None, ("", None)),
    ], "t string", cycle.parse_cycle("t"))
    check(pairs, [
        (("Stage Hiver 2026", "", "", None), ("winter", 2026)), (("Prácticas de otoño", "", "", None), ("fall", None)),
        (("Winter then Summer 2031", "", "", None), ("summer", 2031)), (("Spring 2026", "", "fall", None), ("fall", 2026)),
        (("Intern", "join us summer 2027", "", None), ("summer", 2027)), (("Intern", "x", "", 2030), ("", 2030)),
        (("Intern été '25", "", "", None), ("summer", 2025)), (("Intern 2023", "", "", None), ("", None)),
    ], "t string, s string, a string, y int", cycle.standardize_cycle("t", "s", "a", "y"))


def test_titles(pairs):
    check(pairs, [
        ("Chemist Intern (REQ-123)", "Chemist Intern"), ("Chemist Intern - JR001923", "Chemist Intern"),
        ("CHEMIST INTERN", "Chemist Intern"), ("AI / ML LAB INTERN", "AI / ML Lab Intern"),
        ("Stage Chimie / Internship Chemistry", "Internship Chemistry"), ("Refinery Intern", "Refinery Intern"),
        ("Job ID: 77 Intern", "Intern"), ("Intern R-12345", "Intern"), (" | Intern  x", "Intern x"), (None, ""),
        ("ABCD", "ABCD"),
    ], "t string", lambda df: titles.clean_title(df, "t", "out"))


def test_company_names(pairs):
    check(pairs, [
        ("cvshealth", "CVS Health"), ("NBCUniversal3", "NBCUniversal"), ("Acme Corporation", "Acme"),
        ("Acme, Inc.", "Acme"), ("HP Inc.", "HP Inc."), ("Moog Inc.", "Moog Inc."), ("10442 Expedia do Brasil", "Expedia Group"),
        ("CityAndCountyOfSanFrancisco1", "City and County of San Francisco"), ("sunworks", "Sunworks"), ("ab", "ab"),
        ("", "Unknown Company"), (None, "Unknown Company"), ("Zeta S.A.", "Zeta"), ("o'neil-co", "O'Neil-Co"),
    ], "t string", lambda df: classify.company_name(df, "t", "out"))


def test_industry(pairs):
    check(pairs, [
        (("Acme", "", "Retail"), "Retail"), (("NVIDIA", "", "Uncategorized"), "Semiconductors & AI Hardware"),
        (("Lakeside Hospital", "", None), "Healthcare & Life Sciences"), (("Nordic Bank", "", ""), "Financial Services"),
        (("Acme", "Software Engineering", " "), "Software & Technology"), (("Acme", "Other", "Uncategorized"), "Uncategorized"),
        (("Acme", "Other", None), "Uncategorized"),
    ], "c string, f string, g string", classify.infer_category("c", "f", "g"))


def test_posted_dates(pairs):
    def at(*a):
        return datetime(*a)

    cases = [
        ("2026-07-09T10:58:08-04:00", (at(2026, 7, 9, 14, 58, 8), False)),
        ("2026-07-09T10:58:08Z", (at(2026, 7, 9, 10, 58, 8), False)),
        ("2026-07-09 10:58:08.25", (at(2026, 7, 9, 10, 58, 8, 250000), False)),
        ("2026-07-09T10", (at(2026, 7, 9, 10), False)), ("20260709", (at(2026, 7, 9), True)),
        ("2026-07-09", (at(2026, 7, 9), True)), ("1625176335503", (at(2021, 7, 1, 21, 52, 15, 503000), False)),
        ("1625176335", (at(2021, 7, 1, 21, 52, 15), False)), ("Posted 2 Days Ago", (SEEN - timedelta(2), True)),
        ("Posted Today", (SEEN, True)), ("posted yesterday", (SEEN - timedelta(1), True)),
        ("Posted 30+ Days Ago", (SEEN - timedelta(30), True)), ("Posted whenever", (None, False)),
        ("soon", (None, False)), ("", (None, False)), (None, (None, False)), ("9" * 30, (None, False)),
        ("2026-13-45", (None, False)), ("Posted 99999999999 Days Ago", (None, False)),
    ]
    got = pairs([(c[0],) for c in cases], "raw string", dates.parse_posted_at("raw", F.lit(SEEN)))
    assert [(c[0], tuple(g)) for c, g in zip(cases, got)] == cases


def test_keys(pairs):
    build = identity.dedup_key("c", "t", "l")
    a, b, c, d, e, f = pairs([
        ("Acme Corp", "Yard Intern", "Reno, NV"), ("ACME, Inc.", "yard-intern!", "reno  nv"),
        ("GE Aerospace", "X", ""), ("geaerospace", "x", None), ("", "X", "Y"), ("Co.", "X", "Y"),
    ], "c string, t string, l string", build)
    assert a == b == "acme|yard intern|reno nv" and c == d == "geaerospace|x|" and e is None and f is None
    check(pairs, [("Éclat & Fils Ltd.", "éclatfils"), ("A.P. Moller - Maersk", "apmollermaersk"), ("3M", "3m")],
          "c string", identity.company_key("c"))


def test_names(pairs):
    check(pairs, [("Acme Holdings, Inc., LLC", "Acme Holdings"), ("Acme L.L.C.", "Acme"), ("Costco", "Costco")],
          "c string", text.clean_legal_name("c"))
    check(pairs, [("4231 Airframe Works", "Airframe Works"), ("7", "7"), ("12-Lab", "Lab")], "c string", text.drop_ledger_code("c"))


def test_markup(pairs):
    check(pairs, [
        ("&amp;lt;p&amp;gt;Hi&amp;nbsp;there&lt;/p&gt;", "Hi there"), (None, ""), ("<b>a</b>  c", "a c"),
    ], "h string", text.strip_html("h"))
    check(pairs, [
        ("<p>One</p><ul><li>a</li><li>b</li></ul>", "One\n\n• a\n\n• b"), ("x<br/>y<link>z", "x\nyz"), ("a\u00a0 b\n\n\n\nc", "a b\n\nc"),
    ], "h string", text.display_text("h"))


def test_markup_keeps_whole_texts(pairs):
    long = "word " * 20_000
    check(pairs, [(f"<p>{long}</p>", long.strip())], "h string", text.strip_html("h"))
    check(pairs, [(f"<p>{long}</p>", long.strip())], "h string", text.display_text("h"))
    check(pairs, [(f"<p>{long}</p>", long[:600])], "h string", text.strip_html("h", 600))


def test_payload_descriptions_are_stored_whole(spark):
    import json

    from joblattice.sources import payloads

    long = "word " * 20_000
    body = json.dumps({"jobs": [{"id": "1", "title": "t", "content": f"<p>{long}</p>"}]})
    raw = spark.createDataFrame([("e", '{"token": "x"}', 1, body)], "source_entry string, entry string, page int, payload string")
    [row] = payloads.normalize(raw, "greenhouse").select("description", "description_snippet").collect()
    assert row.description == long.strip() and row.description_snippet == long[:600]


def test_xml(pairs):
    check(pairs, [('a"b', "'a\"b'"), ("a&b", '"a&amp;b"'), ("a\"'b", '"a&quot;\'b"')], "h string", text.xml_attribute("h"))


@pytest.mark.parametrize("attempts,hours", [(0, 6), (1, 24), (3, 168), (9, 168)])
def test_backoff(pairs, attempts, hours):
    out = pairs([(attempts,)], "n int", dates.backoff("n", [6, 24, 72, 168], F.lit(SEEN)))
    assert out == [SEEN + timedelta(hours=hours)]


def test_detail_urls(pairs):
    build = identity.workday_detail_url("i", "t", "h", "s")
    check(pairs, [
        (("workday:a:b:/job/x:1", "a", "wd1", "b"), "https://a.wd1.myworkdayjobs.com/wday/cxs/a/b/job/x:1"),
        (("workday:a:b", "a", "wd1", "b"), None), (("workday:a:b:/x", "", "wd1", "b"), None),
    ], "i string, t string, h string, s string", build)
    check(pairs, [(("workday:a:b:/x", "https://a.wd12.myworkdayjobs.com/b"), "https://a.wd12.myworkdayjobs.com/wday/cxs/a/b/x")],
          "i string, u string", identity.workday_liveness_url("i", "u"))


STEMS = """consign:consign consigned:consign consigning:consign consignment:consign consist:consist consisted:consist consistency:consist
consistent:consist consistently:consist consisting:consist consists:consist consolation:consol consolations:consol consolatory:consolatori
console:consol consoled:consol consoles:consol consolidate:consolid consolidated:consolid consolidating:consolid consoling:consol
consolingly:consol consols:consol consonant:conson consort:consort consorted:consort consorting:consort conspicuous:conspicu
conspicuously:conspicu conspiracy:conspiraci conspirator:conspir conspirators:conspir conspire:conspir conspired:conspir conspiring:conspir
constable:constabl constables:constabl constance:constanc constancy:constanc constant:constant knack:knack knackeries:knackeri knacks:knack
knave:knave knaves:knave knavish:knavish kneaded:knead kneading:knead knee:knee kneel:kneel kneeled:kneel kneeling:kneel kneels:kneel
knees:knee knell:knell knelt:knelt knew:knew knife:knife knight:knight knightly:knight knights:knight knit:knit knits:knit knitted:knit
knitting:knit knives:knive knob:knob knobs:knob knock:knock knocked:knock knocker:knocker knockers:knocker knocking:knock knocks:knock
knot:knot knots:knot caresses:caress ponies:poni ties:tie caress:caress cats:cat gas:gas gaps:gap kiwis:kiwi feed:feed agreed:agre
plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall
hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky cry:cri by:by say:say relational:relat conditional:condit
rational:ration valency:valenc hesitancy:hesit digitizer:digit conformably:conform radically:radic differently:differ vilely:vile
analogously:analog vietnamization:vietnam predication:predic operator:oper feudalism:feudal decisiveness:decis hopefulness:hope
callousness:callous formality:formal sensitivity:sensit sensibility:sensibl triplicate:triplic formative:format formalize:formal
electricity:electr electrical:electr hopeful:hope goodness:good revival:reviv allowance:allow inference:infer airliner:airlin
gyroscopic:gyroscop adjustable:adjust defensible:defens irritant:irrit replacement:replac adjustment:adjust dependent:depend adoption:adopt
communism:communism activate:activ angularity:angular homologous:homolog effective:effect bowdlerize:bowdler probate:probat rate:rate
cease:ceas controlling:control roll:roll skis:ski skies:sky dying:die lying:lie tying:tie idly:idl gently:gentl ugly:ugli early:earli
only:onli singly:singl news:news howe:howe atlas:atlas cosmos:cosmos bias:bias andes:andes inning:inning innings:inning outing:outing
herring:herring proceed:proceed exceed:exceed succeed:succeed generate:generat generates:generat general:general generally:general
communication:communic arsenal:arsenal interns:intern internship:internship internships:internship engineering:engin engineer:engin
logistics:logist supply:suppli chains:chain summer:summer data:data science:scienc sciences:scienc marketing:market"""


def test_stems_of_known_words(spark):
    known = dict(p.split(":") for p in STEMS.split())
    rows = [(w,) for w in known] + [(None,), ("",), ("ab",), ("日本",), ("x9ing",)]
    got = {r.word: r.term for r in with_stem(spark.createDataFrame(rows, "word string")).collect()}
    assert {w: got[w] for w in known} == known
    assert got[None] == got[""] == "" and got["ab"] == "ab" and got["日本"] == "日本"


def test_references_without_a_semicolon(pairs):
    """As html.unescape reads them, also before a tag."""
    check(pairs, [("<b>ver&amp</b>", "<b>ver&</b>"), ("a &amp;amp b", "a & b"), ("R&amd", "R&amd")], "h string", text.unescape_html("h"))


def test_references_behind_written_ampersands(spark):
    """A reference that only a later pass brings out is read as html.unescape reads it, common or not."""
    import html

    texts = ["&amp;copy; x", "&amp;amp;lt;", "&&amp;lt;b", "&amp", "&amp;#39;", "a & b", "&&quot;x", "&amp;amp;amp;amp;lt;", "plain", "&copy", "&amp; &lt;p&gt;"]

    def three(t):
        for _ in range(3):
            t = html.unescape(t)
        return t

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.unescape_html("t").alias("u")).collect()
    assert {r["t"]: r["u"] for r in rows} == {t: three(t) for t in texts}


def test_bodies_are_parsed_once(spark):
    """No test of an array's length has each body parsed again before it is unfolded."""
    from joblattice.sources import payloads

    raw = spark.createDataFrame([("e", "{}", 1, '{"jobs": [{"id": "7", "title": "Intern", "content": "a"}, null]}'), ("f", "{}", 1, '{"jobs": []}'), ("g", "{}", 1, "no")],
                                "source_entry string, entry string, page int, payload string")
    rows = payloads.normalize(raw, "greenhouse")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(StructField(jobs") == 1
    assert sorted((r["id"], r["title"]) for r in rows.collect()) == [("greenhouse", ""), ("greenhouse:7", "Intern")]


def test_tasks_grow_in_number(spark):
    from joblattice.operators.skew import spread

    rows = spark.range(0, 1000, 1, 1)
    assert spread(rows, 10).rdd.getNumPartitions() == 100
    assert spread(rows, 10).count() == 1000
