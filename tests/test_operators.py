"""Operators on small tables against what plain Python says."""

import itertools
import random
from collections import Counter
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from joblattice.functions.similarity import with_ratio
from joblattice.operators import entities, facets, filters, maintain, ranking, search
from joblattice.operators.skew import lookup
from joblattice.operators.standardize import standardize_posting
from joblattice.plans import catalog, export, feed
from joblattice.plans.bindings import bound
from joblattice.streaming import stall
from joblattice.streaming.lifecycle import lifecycle

T0 = datetime(2026, 8, 1)
AS_OF = datetime(2026, 9, 1)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def postings(spark):
    """A third of the rows share one dedup key; some have none."""
    rng = random.Random(7)
    rows = []
    for i in range(300):
        key = "hot|intern|" if i % 3 == 0 else None if i % 17 == 0 else f"k{rng.randrange(40)}|intern|"
        rows.append((
            f"{'muse' if i % 2 else 'lever'}:t:{i}", i % 9, f"e{i % 9}", f"Acme {i % 4}", "Yard Intern", "Reno, NV", "u",
            "muse" if i % 2 else "lever", rng.choice(["open", "open", "duplicate", "closed"]), None, key, f"c{i % 4}",
            T0 + timedelta(hours=rng.randrange(50)), None if i % 11 == 0 else T0 - timedelta(days=rng.randrange(400)), "Retail"))
    return spark.createDataFrame(
        rows, "id string, source_id long, source_entry string, company string, title string, location string, url string, ats string, "
        "status string, duplicate_of string, dedup_key string, company_key string, first_seen timestamp, posted_at_ts timestamp, category string")


def test_dedup_sweep_matches_a_plain_loop_and_repeats_to_nothing(postings):
    rows = [r.asDict() for r in postings.collect()]
    best = {}
    for r in rows:
        if r["status"] != "closed" and r["dedup_key"]:
            order = (0 if r["ats"] == "lever" else 1, r["first_seen"], r["id"])
            best[r["dedup_key"]] = min(best.get(r["dedup_key"], order), order)
    want = {}
    for r in rows:
        live = r["status"] != "closed" and r["dedup_key"]
        winner = best[r["dedup_key"]][2] if live else None
        want[r["id"]] = (r["status"], None) if not live else ("open", None) if winner == r["id"] else ("duplicate", winner)
    once = maintain.dedup_sweep(postings)
    assert {r["id"]: (r["status"], r["duplicate_of"]) for r in once.collect()} == want
    assert maintain.dedup_sweep(once.drop("changed")).filter("changed").count() == 0


def test_the_next_best_is_promoted_when_the_winner_closes(spark):
    rows = [("a", "lever", "closed", None, "k", T0), ("b", "muse", "duplicate", "a", "k", T0)]
    df = spark.createDataFrame(rows, "id string, ats string, status string, duplicate_of string, dedup_key string, first_seen timestamp")
    got = {r["id"]: (r["status"], r["duplicate_of"]) for r in maintain.dedup_sweep(df).collect()}
    assert got == {"a": ("closed", None), "b": ("open", None)}


def test_lookup_keeps_every_row_of_hot_and_missing_keys(spark):
    left = spark.range(1000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 10 = 1 THEN NULL ELSE id END AS k")
    right = spark.createDataFrame([(7, "hot"), (20, "one"), (None, "no")], "k long, v string")
    got = {r["id"]: r["v"] for r in lookup(left, right, "k", "id").collect()}
    assert len(got) == 1000
    assert all(got[i] == ("hot" if i % 3 == 0 or i == 7 else "one" if i == 20 else None) for i in range(1000))


def test_a_hot_key_is_split_over_tasks(spark):
    """With no broadcast and small thresholds the join of a hot key is split, and stays whole."""
    confs = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        left = spark.range(0, 60000, 1, 16).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id % 5000 END AS k", "uuid() AS pad")
        right = spark.range(5000).selectExpr("id AS k", "'v' || id AS v")
        out = lookup(left, right, "k", "id")
        rows = out.collect()
        assert len(rows) == 60000 and all(r["v"] == f"v{r['k']}" for r in rows)
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_pages_cover_everything_once(postings):
    rows = postings.filter("status = 'open'")
    want = [r["id"] for r in rows.orderBy(*ranking.feed_order()).collect()]
    by_offset = [r["id"] for o in range(0, len(want), 40) for r in ranking.page(rows, ranking.feed_order(), 40, o).orderBy("position").collect()]
    assert by_offset == want
    seen, last = [], None
    while True:
        part = (ranking.page_after(rows, last, 40) if last else rows.orderBy(*ranking.feed_order()).limit(40)).collect()
        if not part:
            break
        seen += [r["id"] for r in part]
        last = part[-1].asDict()
    assert seen == want


def test_a_paged_sort_must_end_unique(postings):
    with pytest.raises(ValueError):
        ranking.total_order(postings, [F.desc("first_seen")], "nope")
    with pytest.raises(ValueError):
        ranking.page(postings, ranking.feed_order(), 5001)


def test_presets(spark):
    rows = [
        ("1", "Acme", "Yard Intern", "freight", "Austin, TX", None, T0), ("2", "Acme", "Sales Intern", "freight", "Austin, TX", None, T0),
        ("3", "Best", "Intern 2026", "", "Reno, NV", None, T0), ("4", "Acme", "Freight Intern", None, "Sydney, Australia", datetime(2016, 1, 1), T0)]
    df = spark.createDataFrame(rows, "id string, company string, title string, description_snippet string, location string, posted_at_ts timestamp, first_seen timestamp")

    def ids(**spec):
        return {r["id"] for r in df.filter(filters.passes(filters.FilterSpec(**spec), F.lit(AS_OF))).collect()}

    assert ids() == set()
    assert ids(keywords_any=["freight"]) == {"1", "2", "4"}
    assert ids(keywords_any=["freight"], exclude_keywords=["sales"], max_age_days=60) == {"1"}
    assert ids(trusted_companies=["Best"], locations_include=["TX"]) == set()
    assert ids(keywords_any=["intern"], locations_exclude=["US", "nv"]) == {"1", "2", "4"}
    with pytest.raises(KeyError):
        filters.resolve_preset("missing", {})
    assert filters.resolve_preset("all", {}) is None


def test_unstated_cycles_come_after_confirmed_ones(spark):
    rows = [("a", "", None), ("b", "summer", 2027), ("c", "summer", None), ("d", "fall", 2027)]
    df = spark.createDataFrame(rows, "id string, cycle_season string, cycle_year int")
    got = {r["id"]: r["cycle_order"] for r in filters.cycle_filter(df, "summer", 2027).collect()}
    assert got == {"a": 1, "b": 0}
    assert {r["id"] for r in filters.cycle_filter(df, None, 2027, include_unstated=False).collect()} == {"b", "d"}


def test_search_orders_and_never_fails(spark):
    rows = [
        ("1", "Rocket Propulsion Intern", "Acme", "Reno", "We build things"), ("2", "Office Intern", "Acme", "Reno", "Near our rocket propulsion lab"),
        ("3", "Rocketry Intern", "Propulsion Inc", "Reno", ""), ("4", "Baker", "Breads", "Reno", "propulsion of rocket parts")]
    df = spark.createDataFrame(rows, "id string, title string, company string, location string, description string")
    index = search.build_index(df)

    def hits(q):
        return {r["id"]: r["rank"] for r in search.search(index, q).collect()}

    assert hits("rocket propulsions")["1"] > hits("rocket propulsions")["2"] > 0
    assert set(hits('"rocket propulsion"')) == {"1", "2"}
    assert set(hits("rocket -things")) == {"2", "4"}
    assert set(hits("bakers or offices")) == {"2", "4"}
    for odd in ("'", '"', "-", "or", "&|!:*", "the"):
        assert hits(odd) == {}
    assert {r["id"] for r in search.search_feed(df, index, "rocketr").collect()} == {"3"}
    assert hits("rocket") == {r["id"]: r["rank"] for r in search.search_texts(df, "rocket").collect()}


def test_name_similarity_is_ratcliff_obershelp(spark):
    names = ["Acme Works", "acmeworks inc", "Bolt", "", "Nordic Bank"]
    pairs = list(itertools.product(["Acme Works", "Nordik Banc"], names))
    df = spark.createDataFrame([(c, c, n) for c, n in pairs], "candidate string, candidate_name string, company string")
    got = {r["candidate"]: r["name_similarity"] for r in facets.name_similarity(df).collect()}

    def slug(s):
        return "".join(ch for ch in s.lower() if ch.isascii() and ch.isalnum())

    for c in ("Acme Works", "Nordik Banc"):
        assert got[c] == max(SequenceMatcher(None, slug(c), slug(n)).ratio() for n in names)


def test_gate_codes(spark):
    c = spark.createDataFrame([(n, "Acme") for n in "abcdefg"], "candidate string, candidate_name string")
    fetched = [("b", 1, "Acme", "Clerk")] + [("c", i, "Acme", "Intern") for i in range(2)] + [("d", 1, "Zzz", "Intern"), ("e", 1, "Acme Co", "Intern")]
    fetched += [("f", i, "Acme", ("Intern", "Summer Intern")[i % 2]) for i in range(4)] + [("g", i, "Acme", f"Intern {i}") for i in range(3)]
    f = spark.createDataFrame(fetched, "candidate string, id long, company string, title string")
    got = {r["candidate"]: r["code"] for r in facets.verify_gate(c, f).collect()}
    assert got == {"a": "zero_postings", "b": "no_internship_titles", "c": "not_distinct", "d": "name_mismatch", "e": "ok", "f": "ok", "g": "ok"}


def test_a_stored_index_is_read_by_bucket_and_term(spark, tmp_path):
    df = spark.createDataFrame([("1", "Rocket intern"), ("2", "Sales intern")], "id string, title string")
    path = f"{tmp_path}/index"
    search.write_index(search.build_index(df), path)
    found = search.search(spark.read.parquet(path), "rocket")
    assert [r["id"] for r in found.collect()] == ["1"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(term,rocket)" in plan.replace("In(term, [rocket])", "EqualTo(term,rocket)")
    assert [r["id"] for r in search.search(spark.read.parquet(path), "-sales", df).collect()] == ["1"]


def test_limits_tell_exactly_whether_rows_were_left_out(spark):
    df = spark.createDataFrame([(k, i) for k, n in (("a", 1), ("b", 2), ("c", 3)) for i in range(n)], "k string, i int")
    got = {(r.k, r.truncated, r.rank) for r in ranking.shown_per(df, "k", [F.asc("i")], 2).collect()}
    assert got == {("a", False, 1), ("b", False, 1), ("b", False, 2), ("c", True, 1), ("c", True, 2)}
    assert ranking.shown_per(df, "k", [F.asc("i")], None).count() == 6
    feed = df.selectExpr("i AS id", "cast(null AS timestamp) AS posted_at_ts", "cast(null AS timestamp) AS first_seen")
    assert [ranking.capped(feed, n)[1].first()[0] for n in (None, 5, 6, 7)] == [False, True, False, False]


def test_two_outcomes_for_one_row_do_not_multiply_it(spark):
    sources = spark.createDataFrame([(1, "disabled", 4, None)], "id long, status string, consecutive_failures int, next_scrape_at timestamp")
    verdicts = spark.createDataFrame([(1, False), (1, True)], "id long, passed boolean")
    out = maintain.reinstate(sources, verdicts, F.lit(AS_OF)).collect()
    assert [r.status for r in out] == ["probation"]
    names = spark.createDataFrame([("Q", "ashby", "z"), ("Q", "workday", "a"), ("R", None, None), ("R", "lever", "c")], "company string, ats string, config string")
    none = spark.createDataFrame([], "company string, ats string, config string, review_status string")
    got = {r.company: (r.ats, r.config) for r in maintain.seed_candidates(none, names).collect()}
    assert got == {"Q": ("ashby", "z"), "R": ("lever", "c")}
    assert maintain.seed_candidates(none, names.limit(0), names).count() == 2


def test_same_company_leaves_itself_out(postings):
    rows = [r.asDict() for r in postings.collect()]

    def newest(key, me):
        far = datetime.min
        open_ = [r for r in rows if r["status"] == "open" and r["company_key"] == key and r["id"] != me]
        return [r["id"] for r in sorted(open_, key=lambda r: (r["posted_at_ts"] is None, far - (r["posted_at_ts"] or far), r["id"]))][:5]

    got = {}
    for r in entities.same_company(postings, postings.select("id"), n=5).orderBy("asked_id", "rank").collect():
        got.setdefault(r["asked_id"], []).append(r["id"])
    assert all(got[r["id"]] == newest(r["company_key"], r["id"]) for r in rows)
    assert entities.same_company(postings, n=5).exceptAll(entities.same_company(postings, postings.select("id"), n=5)).isEmpty()


def test_same_company_query_answers_every_posting(spark):
    """A posting has 25 rows, or as many as its employer has other open postings."""
    rows = [tuple(r) for r in catalog.QUERIES["same_company"].run(spark, SF).select("asked_id", "id").collect()]
    kept = bound(spark, SF, "postings").select("id", "company_key", "status").collect()
    open_ = Counter(r["company_key"] for r in kept if r["status"] == "open")
    want = {r["id"]: min(25, open_[r["company_key"]] - (r["status"] == "open")) for r in kept if r["company_key"] is not None}
    assert Counter(a for a, _ in rows) == Counter({k: n for k, n in want.items() if n})


def _fold(status, failures, scraped, outcomes, threshold=5):
    """The rules run by run."""
    for ok in outcomes:
        if status in ("disabled", "removed"):
            break
        if ok:
            if status == "probation" and scraped:
                status = "active"
            failures = 0
        else:
            failures += 1
            status = "removed" if status == "probation" else "disabled" if failures >= threshold else status
        scraped = True
    return status, failures


def test_lifecycle_matches_a_run_by_run_fold(spark):
    rng = random.Random(3)
    sources, runs, want = [], [], {}
    for i in range(120):
        status, failures, scraped = rng.choice(["active", "probation", "disabled"]), rng.randrange(7), rng.random() < 0.5
        outcomes = [rng.random() < 0.6 for _ in range(rng.choice([0, 1, 2, 5, 30, 400 if i == 5 else 8]))]
        sources.append((i, status, failures, T0 if scraped else None))
        runs += [(i, n, T0 + timedelta(minutes=n), ok) for n, ok in enumerate(outcomes)]
        want[i] = _fold(status, failures, scraped, outcomes)
    rng.shuffle(runs)
    s = spark.createDataFrame(sources, "id long, status string, consecutive_failures int, last_scraped_at timestamp")
    r = spark.createDataFrame(runs, "source_id long, id long, started_at timestamp, ok boolean")
    got = {x["id"]: (x["status"], x["consecutive_failures"]) for x in lifecycle(s, r).collect()}
    assert got == want


def test_stalls_alert_once(spark):
    runs = spark.createDataFrame([("a", T0, True), ("a", AS_OF, False), ("b", AS_OF, True), ("c", T0, False), ("d", T0, True)], "k string, started_at timestamp, ok boolean")
    told = spark.createDataFrame([("d", T0 + timedelta(hours=5))], "k string, created_at timestamp")
    got = {r["key"]: (r["stalled"], r["emit"]) for r in stall.stall_alerts(runs, told, F.lit(AS_OF), "k").collect()}
    assert got == {"a": (True, True), "b": (False, False), "d": (True, False)}


def test_sweeps_repeat_to_nothing(postings, spark):
    wide = standardize_posting(postings.drop("company_key")).withColumns({
        "posted_at": F.lit("Posted 3 Days Ago"), "posted_at_approx": F.lit(False), "liveness_checked_at": F.lit(None).cast("timestamp")})
    s = spark.createDataFrame([(i, f"Co {i}", "X") for i in range(9)], "id long, company string, category string")
    for sweep in (lambda d: maintain.source_sync(d, s), maintain.refresh_company_key, maintain.cycle_sweep, maintain.backfill_posted_at, maintain.move_axis):
        once = sweep(wide)
        assert sweep(once.drop("changed")).filter("changed").count() == 0


def test_a_failed_source_changes_nothing(postings, spark):
    table = postings.withColumns({c: F.lit(None).cast(t) for c, t in (("last_seen", "timestamp"), ("closed_at", "timestamp"), ("description", "string"), ("posted_at_approx", "boolean"))})
    none = maintain.derived(spark.createDataFrame([], "id string, company string, title string, location string, url string, source string, category string, job_function string, work_arrangement string, posted_at string, description_snippet string, description string, source_entry string, source_id long"), F.lit(AS_OF))
    out = maintain.reconcile(table, none, spark.createDataFrame([(3,)], "source_id long"), F.lit(AS_OF))
    actions = {(r["source_id"] == 3 and r["action"] == "closed") or r["action"] == "kept" for r in out.collect()}
    assert actions == {True}
    assert out.filter("action = 'closed'").count() == table.filter("source_id = 3 AND status <> 'closed'").count()


def test_markdown_and_atom_and_bundle(postings, spark, tmp_path):
    every = postings.withColumn("feed_key", F.lit("all")).withColumn("posted_at_approx", F.lit(True))
    lines = export.markdown_feed(every, F.lit(AS_OF))
    export.write_markdown(lines, str(tmp_path / "md"))
    text = [r["value"] for r in spark.read.text(str(tmp_path / "md")).collect()]
    assert sum(t.startswith("- [") for t in text) == 300 and "## Retail" in text
    (doc,) = [r["document"] for r in export.atom_feed(every, as_of=F.lit(AS_OF)).collect()]
    import xml.etree.ElementTree as ET

    assert len(ET.fromstring(doc.encode()).findall("{http://www.w3.org/2005/Atom}entry")) == 50
    full = every.withColumns({"url": F.lit("u"), "description": F.lit("Long text"), "description_snippet": F.lit("x" * 300), "posted_at": F.lit("2026-01-01")})
    presets = spark.createDataFrame([("p",)], "id string")
    export.write_bundle(full, presets, str(tmp_path / "out"), F.lit(AS_OF))
    index = spark.read.json(str(tmp_path / "out" / "feed"))
    assert index.count() == full.filter("status = 'open'").count() == spark.read.json(str(tmp_path / "out" / "descriptions")).count()
    assert index.agg(F.max(F.length("description_snippet"))).first()[0] == 281


def test_feed_page_reads_and_limits_early(postings, tmp_path):
    path = str(tmp_path / "postings")
    full = postings.withColumns({"description_snippet": F.lit(""), "cycle_season": F.lit(""), "cycle_year": F.lit(None).cast("int"),
                                 "description": F.lit("long"), "job_function": F.lit(""), "work_arrangement": F.lit("")})
    full.write.parquet(path)
    stored = postings.sparkSession.read.parquet(path)
    plan = feed.feed(stored, F.lit(AS_OF)).select("id", "position")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(status,open)" in plan
    read = [line for line in plan.splitlines() if "ReadSchema" in line][0]
    assert "description" not in read.split("ReadSchema")[1]


def test_also_listed_groups_answer_for_every_posting(spark):
    rows = [(i, "open", f"k{i // 2}") for i in range(600)] + [(600, "closed", "k0"), (601, "open", None), (602, "open", None)]
    got = {r.id: r.n_elsewhere for r in entities.also_listed_groups(spark.createDataFrame(rows, "id long, status string, dedup_key string")).collect()}
    assert len(got) == 603 and got[0] == got[1] == got[600] == 2 and got[601] == got[602] == 0
    assert all(got[i] == 1 for i in range(2, 600))


def test_common_block_ratio_equals_a_plain_one(spark):
    rng = random.Random(4)
    texts = ["", "a", "ab" * 60, "abcabba", "x" * 30, "z" * 240 + "abc", "abc" * 90] + ["".join(rng.choices("aab c1", k=rng.randrange(1, 24))) for _ in range(60)]
    pairs = [(a, b) for a in texts for b in rng.sample(texts, 8)] + [("abc" * 90, "z" * 240 + "abc"), ("", ""), ("a", "")]
    df = spark.createDataFrame(pairs, "a string, b string").repartition(4)
    for r in with_ratio(df).collect():
        assert r.ratio == pytest.approx(SequenceMatcher(None, r.a, r.b).ratio(), abs=1e-12), (r.a, r.b)


def test_numbering_spreads_a_hot_group(spark):
    rows = [("hot" if i % 3 else None if i % 2 else f"k{i % 5}", (i * 7919) % 3000, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, at int, id int").repartition(4)
    want, seen = {}, {}
    for k, a, i in sorted(rows, key=lambda r: (-r[1], r[2])):
        seen[k] = want[i] = seen.get(k, 0) + 1
    out = ranking.numbered(df, "key", [F.desc("at"), F.asc("id")])
    assert {r.id: r["rank"] for r in out.collect()} == want and out.columns == ["key", "at", "id", "rank"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "_part" in plan and ranking.numbered(df.limit(0), "key", [F.asc("id")]).count() == 0


def test_places_of_words_are_not_shuffled_to_meet_their_stems(spark):
    df = spark.createDataFrame([("1", "Rocket Intern", "Builds rockets, many rockets"), ("2", "Baker", None)], "id string, title string, description string")
    index = search.build_index(df)
    assert "hashpartitioning(word" not in index._jdf.queryExecution().executedPlan().toString()
    assert {(r["id"], r["field"]): r["positions"] for r in index.filter("term = 'rocket'").collect()} == {("1", "title"): [0], ("1", "description"): [1, 3]}
