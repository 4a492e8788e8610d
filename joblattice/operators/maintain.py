"""State changes as table in, table out.

Every function returns the whole new table.  Those that sweep add a boolean
``changed``; running one on its own result changes nothing.  ``as_of`` and
``seen_at`` are timestamp columns, never the clock.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblattice import vocab
from joblattice.functions import dates, identity
from joblattice.functions.classify import arrangement_from_location, pick_arrangement
from joblattice.functions.cycle import parse_cycle
from joblattice.functions.text import blank_to_null, clean_legal_name, is_gone_page, text_of
from joblattice.operators.entities import sample_posting
from joblattice.operators.facets import majority_vote, recent_runs
from joblattice.operators.filters import changed
from joblattice.operators.ranking import due
from joblattice.operators.skew import lookup


def _swap(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Replaces columns by new values and says whether any differs."""
    wide = df.withColumns({f"_new_{c}": v for c, v in new.items()})
    differs = reduce(lambda a, b: a | b, [changed(c, f"_new_{c}") for c in new])
    cols = [F.col(f"_new_{c}").alias(c) if c in new else F.col(c) for c in df.columns if c != "changed"]
    return wide.select(*cols, differs.alias("changed"))


def _one_per(outcomes: DataFrame, key: str, latest: tuple[str, ...] = ()) -> DataFrame:
    """One outcome per key, so that joining it never multiplies rows: the latest, or else the greatest."""
    rest = [c for c in outcomes.columns if c != key and c not in latest]
    return outcomes.groupBy(key).agg(F.max(F.struct(*latest, *rest)).alias("_r")).select(key, "_r.*")


# --- postings ---------------------------------------------------------------


def rebuild(previous: DataFrame, fresh: DataFrame, failed: DataFrame, seen_at: Column) -> DataFrame:
    """The batch store after a run.

    Fresh rows replace, rows no longer listed drop out, rows of failed entries
    (``source_entry``) stay as they were, first_seen is carried over.
    ``is_new`` marks rows never seen before.
    """
    before = previous.select("id", F.col("first_seen").alias("_first"))
    now = fresh.drop("first_seen").join(before, "id", "left").withColumn(
        "first_seen", F.coalesce("_first", seen_at)).withColumn("is_new", F.col("_first").isNull()).drop("_first")
    kept = previous.join(failed.select("source_entry").distinct(), "source_entry", "left_semi").join(
        fresh.select("id"), "id", "left_anti").withColumn("is_new", F.lit(False))
    return now.unionByName(kept, allowMissingColumns=True)


def derived(fresh: DataFrame, seen_at: Column) -> DataFrame:
    """Fresh connector rows with every column the live table derives from them."""
    ts, coarse = dates.posted_parts("posted_at", seen_at)
    # what is used twice is a column first
    staged = fresh.withColumns({
        "posted_at_ts": ts, "_coarse": coarse, "_c": parse_cycle(), "_company_key": identity.company_key()})
    return (
        staged.withColumns({
            "posted_at_approx": dates.is_approximate(F.col("_coarse"), F.col("posted_at_ts")),
            "cycle_season": F.col("_c.season"), "cycle_year": F.col("_c.year"),
            "work_arrangement": pick_arrangement(), "dedup_key": identity.keyed(F.col("_company_key")),
            "company_key": F.col("_company_key"), "description": blank_to_null("description"),
        })
        .withColumnRenamed("source", "ats")
        .drop("_coarse", "_c", "_company_key")
    )


_TAKEN = [
    "title", "location", "url", "description_snippet", "dedup_key", "company_key", "category", "job_function",
    "cycle_season", "cycle_year", "work_arrangement", "company", "posted_at", "posted_at_approx",
]


def reconcile(postings: DataFrame, fresh: DataFrame, ok_sources: DataFrame, seen_at: Column | None = None) -> DataFrame:
    """Postings after the fetches of ``ok_sources`` (source_id), each complete.

    Without ``seen_at`` both ``fresh`` and ``ok_sources`` have a column of that
    name: each source's own time.

    ``fresh`` is ``derived`` output with source_id, one row per id.  Known rows
    take the new values, but keep a description the fetch did not bring and
    the earliest approximate date, and reopen only from closed.  Open or
    duplicate rows of those sources that are not in ``fresh`` close.  Sources
    that failed are not in ``ok_sources`` and nothing of theirs changes.
    ``action`` tells what happened: inserted, updated, reopened, closed, kept.
    """
    columns = postings.columns
    given = [c for c in columns if c in fresh.columns and c != "id"]
    own = seen_at is None
    new = fresh.select("id", F.struct(*given).alias("_n"), (F.col("seen_at") if own else seen_at).alias("_new_at"))
    fetched = ok_sources.groupBy("source_id").agg(
        F.lit(True).alias("_ok"), F.max(F.col("seen_at") if own else seen_at).alias("_old_at"))
    seen_at = F.coalesce("_new_at", "_old_at")
    old = lookup(postings, fetched, "source_id", "id").select("id", "_ok", "_old_at", F.struct(*[c for c in columns if c != "id"]).alias("_o"))
    both = old.join(new, "id", "full_outer")

    def o(c):
        return F.col(f"_o.{c}")

    def n(c):
        return F.col(f"_n.{c}")

    was, now = F.col("_o").isNotNull(), F.col("_n").isNotNull()
    gone = was & ~now & F.coalesce("_ok", F.lit(False)) & o("status").isin("open", "duplicate")
    reopened = was & now & (o("status") == "closed")
    values = {c: F.when(now, n(c)).otherwise(o(c)) for c in _TAKEN if c in given}
    if "description" in given:
        values["description"] = F.coalesce(blank_to_null(n("description")), o("description"))
    earliest = n("posted_at_approx") & o("posted_at_ts").isNotNull() & n("posted_at_ts").isNotNull()
    values["posted_at_ts"] = F.when(earliest, F.least(o("posted_at_ts"), n("posted_at_ts"))).otherwise(
        F.coalesce(n("posted_at_ts"), o("posted_at_ts")))
    values["status"] = F.when(gone, "closed").when(reopened | ~was, "open").otherwise(o("status"))
    values["closed_at"] = F.when(gone, seen_at).when(~reopened, o("closed_at"))
    values["first_seen"] = F.when(was, o("first_seen")).otherwise(seen_at)
    values["last_seen"] = F.when(now, seen_at).otherwise(o("last_seen"))
    action = (
        F.when(gone, "closed").when(~was, "inserted").when(reopened, "reopened").when(now, "updated").otherwise("kept")
    )

    def value(c):
        if c in values:
            return values[c]
        return F.coalesce(o(c), n(c)) if c in given else o(c)

    return both.select("id", *[value(c).alias(c) for c in columns if c != "id"], action.alias("action"))


def dedup_winners(postings: DataFrame, direct=vocab.DIRECT_PLATFORMS) -> DataFrame:
    """(_live_key, _winner): the posting that stands for each dedup key's open and duplicate rows.

    A plain aggregation, which combines before the shuffle; a window would sort
    a hot key's rows in one task.
    """
    order = F.struct(identity.precedence("ats", direct).alias("p"), "first_seen", "id")
    return postings.filter(F.col("status").isin("open", "duplicate") & F.col("dedup_key").isNotNull()).groupBy(
        F.col("dedup_key").alias("_live_key")).agg(F.min(order)["id"].alias("_winner"))


def dedup_sweep(postings: DataFrame, direct=vocab.DIRECT_PLATFORMS, winners: DataFrame | None = None) -> DataFrame:
    """One open posting per dedup key, the rest duplicates of it; closed rows stay closed.

    With ``winners`` (``dedup_winners`` of some keys) only these keys are swept.
    """
    live = F.col("status").isin("open", "duplicate")
    keyed = postings.withColumn("_live_key", F.when(live, F.col("dedup_key")))
    met = lookup(keyed, dedup_winners(postings, direct) if winners is None else winners, "_live_key", "id")
    first, ranked = F.col("id") == F.col("_winner"), F.col("_winner").isNotNull()
    out = _swap(met, {
        "status": F.when(ranked, F.when(first, "open").otherwise("duplicate")).otherwise(F.col("status")),
        "duplicate_of": F.when(ranked, F.when(~first, F.col("_winner"))).otherwise(F.col("duplicate_of")),
    })
    return out.drop("_live_key", "_winner")


def source_sync(postings: DataFrame, sources: DataFrame, direct=vocab.DIRECT_PLATFORMS, refresh_dedup: bool = False) -> DataFrame:
    """Company and industry of direct platforms' postings follow their source, whatever their status."""
    s = sources.select(
        F.col("id").alias("source_id"), F.lit(True).alias("_s"),
        F.col("company").alias("_company"), F.col("category").alias("_category"),
    )
    met = lookup(postings, s, "source_id", "id")
    follows = F.coalesce(F.col("_s") & F.col("ats").isin(list(direct)), F.lit(False))
    new = {
        "company": F.when(follows, F.col("_company")).otherwise(F.col("company")),
        "category": F.when(follows, F.col("_category")).otherwise(F.col("category")),
    }
    if refresh_dedup:
        new["dedup_key"] = F.when(follows, identity.dedup_key("_company")).otherwise(F.col("dedup_key"))
    return _swap(met, new).drop("_s", "_company", "_category")


def refresh_company_key(postings: DataFrame) -> DataFrame:
    return _swap(postings, {"company_key": identity.company_key()})


def cycle_sweep(postings: DataFrame) -> DataFrame:
    """Cycles recomputed for every row; arrangements filled only where blank."""
    return _swap(postings.withColumn("_c", parse_cycle()), {
        "cycle_season": F.col("_c.season"),
        "cycle_year": F.col("_c.year"),
        "work_arrangement": F.coalesce(blank_to_null("work_arrangement"), arrangement_from_location()),
    }).drop("_c")


def backfill_posted_at(postings: DataFrame) -> DataFrame:
    """Dates reparsed against first_seen; what no rule reads is left as it is."""
    read = postings.withColumn("_p", dates.parse_posted_at("posted_at", "first_seen"))
    known = F.col("_p.ts").isNotNull()
    return _swap(read, {
        "posted_at_ts": F.when(known, F.col("_p.ts")).otherwise(F.col("posted_at_ts")),
        "posted_at_approx": F.when(known, F.col("_p.approx")).otherwise(F.col("posted_at_approx")),
    }).drop("_p")


def apply_liveness(postings: DataFrame, outcomes: DataFrame, as_of: Column, stale_days: int = 180,
                   recheck_stale: int = 7, recheck_fresh: int = 30) -> DataFrame:
    """Checks (id, status_code, body; NULL code = no answer) applied to open postings.

    ``liveness`` tells the outcome: closed, alive, deferred, NULL if unchecked.
    """
    one = _one_per(outcomes.select("id", "status_code", "body"), "id").withColumn("_checked", F.lit(True))
    met = postings.join(one, "id", "left")
    code = F.col("status_code")
    # an id that tells no address is checked at the posting's own page
    workday = ((F.col("ats") == "workday") | F.col("id").startswith("workday:")) & identity.workday_liveness_url("id", "url").isNotNull()
    gone = code.isin(vocab.GONE_STATUSES) | (workday & code.isin(vocab.GONE_STATUSES_WORKDAY)) | (
        (code == 200) & ~workday & is_gone_page("body"))
    outcome = F.when(
        F.col("_checked"), F.when(F.coalesce(gone, F.lit(False)), "closed").when(code == 200, "alive").otherwise("deferred"))
    met = met.withColumn("liveness", outcome)
    hit, live, later = (F.col("liveness") == x for x in ("closed", "alive", "deferred"))
    close = hit & (F.col("status") == "open")
    stale = F.coalesce(F.col("posted_at_ts") < F.timestamp_add("DAY", F.lit(-stale_days), as_of), F.lit(False))
    again = F.when(stale, F.timestamp_add("DAY", F.lit(recheck_stale), as_of)).otherwise(
        F.timestamp_add("DAY", F.lit(recheck_fresh), as_of))
    attempts = F.coalesce("liveness_attempts", F.lit(0))
    new = {
        "status": F.when(close, "closed").otherwise(F.col("status")),
        "closed_at": F.when(close, as_of).otherwise(F.col("closed_at")),
        "liveness_checked_at": F.when(close | live, as_of).otherwise(F.col("liveness_checked_at")),
        "liveness_next_check_at": F.when(live, again)
        .when(later, dates.backoff(attempts, vocab.LIVENESS_BACKOFF_HOURS, as_of))
        .otherwise(F.col("liveness_next_check_at")),
        "liveness_attempts": F.when(live, 0).when(later, dates.next_attempts(attempts)).otherwise(F.col("liveness_attempts")),
    }
    return _swap(met, new).drop("status_code", "body", "_checked")


def expired_log(swept: DataFrame, outcomes: DataFrame, as_of: Column) -> DataFrame:
    """Activity rows for postings a liveness sweep closed."""
    rows = swept.filter((F.col("liveness") == "closed") & F.col("changed")).join(
        _one_per(outcomes.select("id", "status_code", "body"), "id").drop("body"), "id")
    code = F.when(F.col("status_code").isin(vocab.GONE_STATUSES), F.col("status_code")).otherwise(404)
    detail = F.concat(F.lit("HTTP "), code.cast("string"), F.lit(" on the posting's own URL -- no longer applicable"))
    return rows.select(F.lit("expired").alias("kind"), "company", detail.alias("detail"), as_of.alias("created_at"))


def apply_descriptions(postings: DataFrame, outcomes: DataFrame, as_of: Column) -> DataFrame:
    """Detail fetches (id, url, status_code, text) applied.

    No url, or an answer that will not change, stores ''; a 200 with readable
    text stores it (NULL text is a broken body); anything else waits longer.
    """
    one = _one_per(outcomes.select("id", F.col("url").alias("_url"), "status_code", "text"), "id").withColumn("_asked", F.lit(True))
    met = postings.join(one, "id", "left")
    code = F.col("status_code")
    final = F.col("_url").isNull() | F.coalesce(code.isin(vocab.NO_DESCRIPTION_STATUSES), F.lit(False))
    got = ~final & F.coalesce(code == 200, F.lit(False)) & F.col("text").isNotNull()
    asked = F.coalesce("_asked", F.lit(False))
    later = asked & ~final & ~got
    attempts = F.coalesce("description_attempts", F.lit(0))
    return _swap(met, {
        "description": F.when(asked & final, "").when(asked & got, F.col("text")).otherwise(F.col("description")),
        "description_attempts": F.when(later, dates.next_attempts(attempts)).otherwise(F.col("description_attempts")),
        "description_next_attempt_at": F.when(later, dates.backoff(attempts, vocab.DESCRIPTION_BACKOFF_HOURS, as_of))
        .otherwise(F.col("description_next_attempt_at")),
    }).drop("_url", "status_code", "text", "_asked")


def move_axis(postings: DataFrame, platform: str = "muse") -> DataFrame:
    """Once: the aggregator's categories are job functions."""
    moves = (F.col("ats") == platform) & (text_of("job_function") == "") & (text_of("category") != "")
    return _swap(postings, {
        "job_function": F.when(moves, F.col("category")).otherwise(F.col("job_function")),
        "category": F.when(moves, "").otherwise(F.col("category")),
    })


# --- sources ----------------------------------------------------------------


def advance(sources: DataFrame, claimed: DataFrame, as_of: Column) -> DataFrame:
    """Claimed sources come due again after their own interval."""
    met = sources.join(claimed.select("id").distinct().withColumn("_claimed", F.lit(True)), "id", "left")
    later = F.timestamp_add("SECOND", F.col("scrape_interval_seconds"), as_of)
    return _swap(met, {
        "next_scrape_at": F.when(F.col("_claimed"), later).otherwise(F.col("next_scrape_at")),
    }).drop("_claimed")


def empty_board_backoff(sources: DataFrame, runs: DataFrame, as_of: Column,
                        n: int = vocab.EMPTY_RUNS_BEFORE_BACKOFF, interval: int = vocab.EMPTY_BOARD_INTERVAL_SECONDS) -> DataFrame:
    """Active sources whose last n runs were all fine and empty are asked once a day."""
    empty = recent_runs(runs, n).filter(
        (F.col("runs") >= n) & (F.col("empty_ok") == F.col("runs")) & (F.col("failures") == 0)
    ).select(F.col("source_id").alias("id"), F.lit(True).alias("_empty"))
    hit = F.coalesce(
        F.col("_empty") & (F.col("status") == "active") & (F.col("scrape_interval_seconds") < interval), F.lit(False))
    return _swap(sources.join(empty, "id", "left").withColumn("_hit", hit), {
        "scrape_interval_seconds": F.when(F.col("_hit"), interval).otherwise(F.col("scrape_interval_seconds")),
        "next_scrape_at": F.when(F.col("_hit"), F.timestamp_add("SECOND", F.lit(interval), as_of)).otherwise(F.col("next_scrape_at")),
    }).drop("_empty", "_hit")


def apply_runs(sources: DataFrame, outcomes: DataFrame, threshold: int = vocab.DISABLE_AFTER_FAILURES) -> DataFrame:
    """One run outcome per source (source_id, ok, error, finished_at) applied.

    ``event`` tells transitions: promoted to active, disabled, removed.  Rows
    with event 'removed' failed on probation; drop them, and record them with
    ``probation_rejects``.
    """
    o = outcomes.select(F.col("source_id").alias("id"), "ok", F.col("error").alias("_error"), "finished_at")
    met = sources.join(_one_per(o, "id", ("finished_at",)), "id", "left")
    ran, ok, probation = F.col("ok").isNotNull(), F.col("ok"), F.col("status") == "probation"
    failed, failures = ran & ~ok, F.col("consecutive_failures") + 1
    event = (
        F.when(ran & ok & probation & F.col("last_scraped_at").isNotNull(), "confirmed")
        .when(failed & probation, "removed")
        .when(failed & (failures >= threshold) & (F.col("status") != "disabled"), "disabled")
    )
    met = met.withColumn("event", event)
    new = {
        "status": F.when(F.col("event") == "confirmed", "active").when(F.col("event") == "disabled", "disabled")
        .otherwise(F.col("status")),
        "consecutive_failures": F.when(ran & ok, 0).when(failed, failures).otherwise(F.col("consecutive_failures")),
        "last_scrape_status": F.when(ran, F.when(ok, "ok").otherwise("error")).otherwise(F.col("last_scrape_status")),
        "last_scrape_error": F.when(ran, F.col("_error")).otherwise(F.col("last_scrape_error")),
        "last_scraped_at": F.when(ran, F.col("finished_at")).otherwise(F.col("last_scraped_at")),
    }
    return _swap(met, new).drop("ok", "_error", "finished_at")


def probation_rejects(applied: DataFrame, as_of: Column) -> DataFrame:
    """Candidate rows for sources that failed their confirmation."""
    evidence = F.to_json(F.struct(F.col("last_scrape_error").alias("error"), F.lit("probation_confirmation").alias("stage")))
    return applied.filter("event = 'removed'").select(
        "company", "ats", "config", F.lit("rejected").alias("review_status"), evidence.alias("evidence"),
        as_of.alias("checked_at"), F.timestamp_add("DAY", F.lit(vocab.DEFAULT_RECHECK_DAYS), as_of).alias("next_check_at"),
    )


def disabled_log(applied: DataFrame, as_of: Column) -> DataFrame:
    detail = F.concat(
        F.col("consecutive_failures").cast("string"), F.lit(" consecutive failures, last error: "), text_of("last_scrape_error"))
    return applied.filter("event = 'disabled'").select(
        F.lit("disabled").alias("kind"), "company", detail.alias("detail"), as_of.alias("created_at"))


def reinstate(sources: DataFrame, verdicts: DataFrame, as_of: Column) -> DataFrame:
    """Disabled sources whose trial passed go back to probation, due now."""
    v = _one_per(verdicts.select("id", F.col("passed").alias("_passed")), "id")
    met = sources.join(v, "id", "left").withColumn(
        "_back", F.coalesce(F.col("_passed") & (F.col("status") == "disabled"), F.lit(False)))
    return _swap(met, {
        "status": F.when(F.col("_back"), "probation").otherwise(F.col("status")),
        "consecutive_failures": F.when(F.col("_back"), 0).otherwise(F.col("consecutive_failures")),
        "next_scrape_at": F.when(F.col("_back"), as_of).otherwise(F.col("next_scrape_at")),
    }).drop("_passed", "_back")


def events_from(old: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    """Activity rows for source status changes: disabled, reinstated."""
    met = old.select("id", F.col("status").alias("_was")).join(new.select("id", "company", "status"), "id")
    kind = F.when((F.col("status") == "disabled") & (F.col("_was") != "disabled"), "disabled").when(
        (F.col("status") == "probation") & (F.col("_was") == "disabled"), "reinstated")
    detail = F.concat(F.lit("was "), F.col("_was"), F.lit(", now "), F.col("status"))
    return met.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select(
        "kind", "company", detail.alias("detail"), as_of.alias("created_at"))


def _with_config(**fields: Column) -> Column:
    """Configuration JSON with some fields set."""
    kept = F.map_filter(F.from_json("config", "map<string, variant>"), lambda k, v: ~k.isin(list(fields)))
    made = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), F.parse_json(F.to_json(F.struct(v.alias("v")))))])
    unwrapped = F.transform_values(made, lambda k, v: F.variant_get(v, "$.v", "variant"))
    return F.to_json(F.map_concat(F.coalesce(kept, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))), unwrapped))


def _collides(sources: DataFrame, renames: DataFrame) -> DataFrame:
    """Renames (id, ats, new_company) that another source, or an earlier rename, already holds."""
    held = sources.select(F.col("id").alias("_other"), F.col("company").alias("new_company"), "ats")
    taken = renames.join(held, ["new_company", "ats"]).filter(F.col("_other") != F.col("id")).select("id")
    first = renames.groupBy("new_company", "ats").agg(F.min("id").alias("_first"))
    later = renames.join(first, ["new_company", "ats"]).filter(F.col("id") != F.col("_first")).select("id")
    return taken.unionByName(later).distinct().withColumn("_collides", F.lit(True))


def apply_categories(sources: DataFrame, results: DataFrame) -> DataFrame:
    """Categorisation results (token, category, company_name) applied to discovered sources of exactly that name.

    ``outcome`` per source: updated, collision, NULL if no result names it.
    Results naming no source are ``unmatched_results``.
    """
    r = _one_per(results.select("token", F.col("category").alias("_category"), blank_to_null("company_name").alias("_name")), "token")
    met = sources.join(r, (sources["company"] == r["token"]) & (sources["added_by"] == "discovery"), "left")
    named = met.withColumn("new_company", F.coalesce("_name", "token"))
    renames = named.filter(F.col("token").isNotNull() & (F.col("new_company") != F.col("company"))).select("id", "ats", "new_company")
    named = named.join(_collides(sources, renames), "id", "left")
    outcome = F.when(F.col("token").isNotNull(), F.when(F.col("_collides"), "collision").otherwise("updated"))
    named = named.withColumn("outcome", outcome)
    hit = F.col("outcome") == "updated"
    return _swap(named, {
        "category": F.when(hit, F.col("_category")).otherwise(F.col("category")),
        "config": F.when(hit, _with_config(category=F.col("_category"), company=F.col("new_company"))).otherwise(F.col("config")),
        "company": F.when(hit, F.col("new_company")).otherwise(F.col("company")),
    }).drop("token", "_category", "_name", "new_company", "_collides")


def unmatched_results(sources: DataFrame, results: DataFrame) -> DataFrame:
    known = sources.filter("added_by = 'discovery'").select(F.col("company").alias("token"))
    return results.join(known, "token", "left_anti")


def apply_names(sources: DataFrame, proposals: DataFrame) -> DataFrame:
    """Resolved names (id, name) applied where they differ in more than case and hold no other source's name."""
    met = sources.join(_one_per(proposals.select("id", F.col("name").alias("new_company")), "id"), "id", "left")
    real = (text_of("new_company") != "") & (F.lower("new_company") != F.lower("company"))
    met = met.withColumn("new_company", F.when(real, F.col("new_company")))
    renames = met.filter(F.col("new_company").isNotNull()).select("id", "ats", "new_company")
    met = met.join(_collides(sources, renames), "id", "left")
    outcome = F.when(F.col("new_company").isNotNull(), F.when(F.col("_collides"), "collision").otherwise("applied"))
    met = met.withColumn("outcome", outcome)
    hit = F.col("outcome") == "applied"
    return _swap(met, {
        "config": F.when(hit, _with_config(company=F.col("new_company"))).otherwise(F.col("config")),
        "company": F.when(hit, F.col("new_company")).otherwise(F.col("company")),
    }).drop("new_company", "_collides")


def name_proposals(sources: DataFrame, postings: DataFrame, details: DataFrame, as_of: Column) -> DataFrame:
    """Names for sources still called by their tenant, by vote over detail results (source_id, organisation).

    Proposals only; organisations are often subsidiaries, so nothing is written.
    """
    waiting = sample_posting(due(sources, "unresolved", as_of), postings).filter(F.col("sample_posting_id").isNotNull())
    votes = majority_vote(details.withColumn("name", clean_legal_name("organisation")), "source_id", "name")
    return waiting.select("id", "company", "sample_posting_id").join(
        votes.withColumnRenamed("source_id", "id"), "id").filter(F.lower("name") != F.lower("company"))


# --- candidates -------------------------------------------------------------


def seed_candidates(candidates: DataFrame, names: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Candidates with new names added once; pre-resolved names bring ats and config, both of one row.

    If the seeds gave no names at all, those of ``fallback`` are taken.
    """
    if fallback is not None and names.isEmpty():
        names = fallback
    cols = [c for c in ("company", "ats", "config") if c in names.columns]
    rest = [c for c in cols if c != "company"]
    one = names.select(*cols).filter(text_of("company") != "")
    # rows that bring something before those that do not, then the smallest
    order = F.struct(*[x for c in rest for x in (F.col(c).isNull(), F.col(c))])
    one = one.groupBy("company").agg(F.min_by(F.struct(*rest), order).alias("_r")).select("company", "_r.*") if rest else one.distinct()
    new = one.join(candidates.select("company"), "company", "left_anti").withColumn("review_status", F.lit("unchecked"))
    if "probe_set_version" in candidates.columns:
        new = new.withColumn("probe_set_version", F.lit(0).cast(candidates.schema["probe_set_version"].dataType))
    return candidates.unionByName(new, allowMissingColumns=True)


def apply_verdicts(candidates: DataFrame, verdicts: DataFrame, as_of: Column, version: int = 1) -> DataFrame:
    """Probe verdicts (id, hit, passed, code, ats, config, evidence) applied.

    No hit waits as no_match; passed is promoted; failed is rejected until its
    code's recheck.  ``outcome`` is NULL for candidates without a verdict.
    """
    v = verdicts.select("id", "hit", "passed", "code", F.col("ats").alias("_ats"), F.col("config").alias("_config"),
                        F.col("evidence").alias("_evidence"))
    met = candidates.join(_one_per(v, "id"), "id", "left")
    outcome = F.when(F.col("hit").isNotNull(), F.when(~F.col("hit"), "no_match").when(F.col("passed"), "promoted").otherwise("rejected"))
    met = met.withColumn("outcome", outcome)
    judged, probed = F.col("outcome").isNotNull(), F.col("outcome").isin("promoted", "rejected")
    wait = F.when(F.col("outcome") == "no_match", F.lit(vocab.DEFAULT_RECHECK_DAYS)).otherwise(dates.recheck_days())
    return _swap(met, {
        "review_status": F.coalesce("outcome", "review_status"),
        "ats": F.when(probed, F.col("_ats")).otherwise(F.col("ats")),
        "config": F.when(probed, F.col("_config")).otherwise(F.col("config")),
        "evidence": F.when(probed, F.col("_evidence")).otherwise(F.col("evidence")),
        "probe_set_version": F.when(judged, F.lit(version)).otherwise(F.col("probe_set_version")).cast("int"),
        "checked_at": F.when(judged, as_of).otherwise(F.col("checked_at")),
        "next_check_at": F.when(judged & (F.col("outcome") != "promoted"), F.timestamp_add("DAY", wait, as_of))
        .otherwise(F.col("next_check_at")),
    }).drop("hit", "passed", "code", "_ats", "_config", "_evidence")


def promoted_sources(judged: DataFrame, sources: DataFrame) -> DataFrame:
    """Source rows for promoted candidates that are not sources yet."""
    new = judged.filter("outcome = 'promoted'").select(
        "company", "ats", F.lit("Uncategorized").alias("category"), "config", F.lit("probation").alias("status"),
        F.lit("discovery").alias("added_by"), F.lit(3600).alias("scrape_interval_seconds"))
    return new.join(sources.select("company", "ats"), ["company", "ats"], "left_anti")


def promoted_log(judged: DataFrame, as_of: Column) -> DataFrame:
    detail = F.concat(F.lit("auto-promoted to probation via "), F.col("ats"))
    return judged.filter("outcome = 'promoted'").select(
        F.lit("promoted").alias("kind"), "company", detail.alias("detail"), as_of.alias("created_at"))


# --- constraints ------------------------------------------------------------


def violations(df: DataFrame, rules: dict) -> DataFrame:
    """(rule, rows): how many rows break each constraint, broken ones only."""
    tests = {f"{c} is missing": F.col(c).isNull() for c in rules.get("not_null", [])}
    tests |= {f"{c} is not allowed": F.col(c).isNotNull() & ~F.col(c).isin(v) for c, v in rules.get("one_of", {}).items()}
    broken = F.array_compact(F.array(*[F.when(t, F.lit(r)) for r, t in tests.items()]))
    parts = [df.select(F.explode(broken).alias("rule")).groupBy("rule").agg(F.count("*").alias("rows"))]
    for key in rules.get("unique", []):
        repeated = df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])).groupBy(*key).agg(
            F.count("*").alias("n")).filter("n > 1")
        parts.append(repeated.agg(F.sum("n").alias("rows")).filter("rows is not null").select(
            F.lit(f"{', '.join(key)} is not unique").alias("rule"), "rows"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def orphans(df: DataFrame, parents: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Rows whose key names no parent."""
    return df.filter(F.col(key).isNotNull()).join(
        parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def clear_orphans(df: DataFrame, parents: DataFrame, key: str, row_id: str = "id", parent_key: str = "id") -> DataFrame:
    """Keys naming no parent become NULL; the rows stay."""
    p = parents.select(F.col(parent_key).alias(key), F.lit(True).alias("_p"))
    met = lookup(df, p, key, row_id)
    return _swap(met, {key: F.when(F.col("_p"), F.col(key))}).drop("_p")
