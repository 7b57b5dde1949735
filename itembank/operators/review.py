"""Validation of extracted rows, consensus of readings, review decisions and queues."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from itembank.functions import predicates as pr
from itembank.functions import text as tx
from itembank.operators.link import FLAG_AUDIT_DIFFERS, FLAG_AUDIT_MISSING, FLAG_DUPLICATE_NUMBER
from itembank.operators.ordered import last_before, row_numbers
from itembank.operators.skew import attach_per_key

# Flags that results depend on.
FLAG_ZOOM = "答案局部放大未通过复核"
FLAG_TEXT = "正文局部复核待处理"
FLAG_CROSS_PAGE = "跨页内容不完整"
FLAG_MEDIA_ERROR, FLAG_MEDIA_PENDING = "题图提取待复核", "题图待视觉复核"
FLAG_OCR = "OCR 不确定"
GROUP_CUE = "为题组"
ZOOM_CLEARS = [FLAG_ZOOM, FLAG_AUDIT_DIFFERS, FLAG_AUDIT_MISSING, tx.FLAG_NOT_TF, tx.FLAG_TF_COUNT]
MAX_RISKS = 3


def validate_items(items: DataFrame, available: Column, owned: Column, min_span: float = 15) -> DataFrame:
    """Rows owned here, with the array of rules each one breaks.

    ``available`` and ``owned`` are arrays of page numbers (literal or per row). Types are those of
    the reader's schema, where a value of another type arrives as null.
    """
    pages = F.col("source_pages")
    bad_pages = F.coalesce(
        (F.size(pages) == 0) | F.exists(pages, lambda p: p.isNull() | ~F.array_contains(available, p)), F.lit(True)
    )
    rows = items.filter(bad_pages | F.array_contains(owned, F.array_min(pages)))
    checks = [
        (~F.coalesce(F.col("kind").isin("question", "solution"), F.lit(False)), "kind"),
        (bad_pages, "pages"),
        *[(F.col(c).isNull(), c) for c in ("number", "section", "stem", "answer", "explanation") if c in items.columns],
        (F.coalesce(F.exists("options", lambda o: o.isNull()), F.lit(True)), "options"),
        ((F.col("kind") == "question") & (tx.strip("stem") == ""), "blank stem"),
        (F.col("complete").isNull(), "complete"),
    ]
    if "category_tags" in items.columns:
        checks.append((F.exists("category_tags", lambda t: t.isNull()), "tags"))
    if "figures" in items.columns:
        bad = lambda f: tx.region_error(f["page"], f["bbox"], available, min_span).isNotNull()
        checks.append((F.exists("figures", bad), "figures"))
    return rows.withColumn("errors", pr.flag_list(*checks))


def batch_verdicts(validated: DataFrame, batch: str = "batch") -> DataFrame:
    """One bad row fails its batch, as the whole reply is asked for again."""
    return validated.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if(F.size("errors") > 0).alias("bad_items")
    ).withColumn("ok", F.col("bad_items") == 0)


def field_value(stem, options, field) -> Column:
    """Value of ``stem`` or ``options[i]``; null for any other field."""
    field = tx.as_col(field)
    index = F.regexp_extract(field, r"\Aoptions\[(\d+)\]\z", 1)
    return F.when(field == "stem", tx.as_col(stem)).when(
        index != "", F.get(tx.as_col(options), index.try_cast("int"))
    )


def validate_findings(envelopes: DataFrame, findings: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable risks, status per question) of a text review.

    ``envelopes``: batch_id, returned_id, status, reviewed_ids. ``findings``: batch_id, id, field,
    quote, reason, ord. ``questions``: batch_id, id, stem, options. A bad envelope covers nothing.
    A risk needs an existing field that contains its quote; one per field and three per question
    count. Uncovered questions, and those with a bad or fourth risk, are unresolved.
    """
    reviewed = envelopes.select("batch_id", "returned_id", "status", F.posexplode_outer("reviewed_ids").alias("i", "id"))
    known = questions.select("batch_id", "id", F.lit(True).alias("__known"))
    checked = reviewed.join(known, ["batch_id", "id"], "left")
    bad_finding = findings.join(known, ["batch_id", "id"], "left_anti").select("batch_id").distinct().withColumn("__alien", F.lit(True))
    ok = checked.groupBy("batch_id").agg(
        F.bool_and(
            F.coalesce(F.col("returned_id") == F.col("batch_id"), F.lit(False)) & F.coalesce(F.col("status").isin("completed", "partial"), F.lit(False))
        ).alias("__head"),
        F.bool_and(F.col("__known").isNotNull() | F.col("id").isNull()).alias("__subset"),
        (F.count("id") == F.count_distinct("id")).alias("__unique"),
    ).join(bad_finding, "batch_id", "left").filter("__head AND __subset AND __unique AND __alien IS NULL")
    good = ok.select("batch_id")
    covered = reviewed.filter("id IS NOT NULL").join(good, "batch_id", "left_semi").select("batch_id", "id").distinct().withColumn("__covered", F.lit(True))
    value = field_value("stem", "options", "field")
    quote = F.coalesce(F.col("quote"), F.lit(""))
    fits = (tx.strip(quote) != "") & F.coalesce(tx.ocr_compare(value).contains(tx.ocr_compare(quote)), F.lit(False))
    judged = findings.join(good, "batch_id", "left_semi").join(questions, ["batch_id", "id"]).withColumn("__fits", fits)
    by_field = W.partitionBy("batch_id", "id", "field").orderBy("ord")
    by_question = W.partitionBy("batch_id", "id").orderBy("ord")
    # A review batch holds six questions, so these windows are small by construction.
    usable = judged.filter("__fits").withColumn("__f", F.row_number().over(by_field)).filter("__f = 1").withColumn(
        "__q", F.row_number().over(by_question)
    )
    trouble = judged.filter("NOT __fits").select("batch_id", "id").unionByName(
        usable.filter(F.col("__q") > MAX_RISKS).select("batch_id", "id")
    ).distinct().withColumn("__trouble", F.lit(True))
    risks = usable.filter(F.col("__q") <= MAX_RISKS).select("batch_id", "id", "field", "quote", "reason")
    status = questions.select("batch_id", "id").join(covered, ["batch_id", "id"], "left").join(trouble, ["batch_id", "id"], "left")
    return risks, status.select(
        "batch_id", "id", F.when(F.col("__covered") & F.col("__trouble").isNull(), "checked").otherwise("unresolved").alias("status")
    )


def valid_readings(readings: DataFrame, keys: list[str]) -> DataFrame:
    """The usable T/F value per reading key, null if there is none.

    ``readings`` carry the printed ``number``, the ``asked`` number and ``n_options`` of the question.
    Exactly one entry of the asked number must exist; it must be complete, all T/F, and fit the options.
    """
    mine = tx.normalize_number("number", ascii_only=True) == tx.normalize_number("asked", ascii_only=True)
    fits = F.coalesce(F.col("complete"), F.lit(False)) & F.coalesce(F.col("characters").rlike(r"\A[TF]+\z"), F.lit(False)) & (
        (F.col("n_options") == 0) | (F.length("characters") == F.col("n_options"))
    )
    return readings.groupBy(*keys).agg(
        F.count_if(mine).alias("entries"), F.max(F.when(mine & fits, F.col("characters"))).alias("v")
    ).select(*keys, F.when(F.col("entries") == 1, F.col("v")).alias("value"))


def answer_consensus(questions: DataFrame, readings: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Confirm or replace answers from independent readings of source crops.

    ``readings``: pos, page, crop ('line' or 'band_i'), view ('raw' or 'contrast'), number, asked,
    n_options, characters, complete, duplicated. On a page the line crop counts if both views agree
    and the number was located once; otherwise the bands count if some band's views agree and every
    value seen is the same and no line view contradicts it. Across pages one confirmed value, no
    error and no contradicting reading are needed. Targets are questions that ask for, or are answered by, a T/F sequence,
    and whose ``answer_source`` (if there is that column) is a PDF; others return as they are.
    """
    page_keys = ["pos", "page"]
    values = valid_readings(readings, [*page_keys, "crop", "view"])
    dup = readings.groupBy(*page_keys).agg(F.bool_or(F.coalesce(F.col("duplicated"), F.lit(False))).alias("dup"))
    raw, contrast = F.max(F.when(F.col("view") == "raw", F.col("value"))), F.max(F.when(F.col("view") == "contrast", F.col("value")))
    crops = values.groupBy(*page_keys, "crop").agg(raw.alias("a"), contrast.alias("b"))
    line, agree = F.col("crop") == "line", F.coalesce(F.col("a") == F.col("b"), F.lit(False))
    pages = crops.groupBy(*page_keys).agg(
        F.max(F.when(line & agree, F.col("a"))).alias("line_value"),
        F.min(F.when(line, F.least("a", "b"))).alias("line_lo"), F.max(F.when(line, F.greatest("a", "b"))).alias("line_hi"),
        F.min(F.when(~line & agree, F.struct("crop", "a")))["a"].alias("band_value"),
        F.min(F.when(~line, F.least("a", "b"))).alias("band_lo"), F.max(F.when(~line, F.greatest("a", "b"))).alias("band_hi"),
    ).join(dup, page_keys)
    line_ok = F.col("line_value").isNotNull() & ~F.col("dup")
    use_band = ~line_ok & F.col("band_value").isNotNull()
    band_ok = (F.col("band_lo") == F.col("band_hi")) & F.coalesce(
        (F.col("line_lo") == F.col("band_value")) & (F.col("line_hi") == F.col("band_value")), F.col("line_lo").isNull()
    )
    evidence = pages.select(
        *page_keys,
        F.when(line_ok, F.col("line_value")).when(use_band & band_ok, F.col("band_value")).alias("confirmed"),
        F.when(use_band, F.least("line_lo", "band_lo")).otherwise(F.col("line_lo")).alias("lo"),
        F.when(use_band, F.greatest("line_hi", "band_hi")).otherwise(F.col("line_hi")).alias("hi"),
    )
    per_q = evidence.groupBy("pos").agg(
        F.min("confirmed").alias("c_lo"), F.max("confirmed").alias("c_hi"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    faults = (errors if errors is not None else per_q.limit(0)).select("pos").distinct().withColumn("fault", F.lit(True))
    rows = questions.join(per_q, "pos", "left").join(faults, "pos", "left")
    good = (
        F.col("c_lo").isNotNull() & (F.col("c_lo") == F.col("c_hi")) & F.col("fault").isNull()
        & (F.col("lo") == F.col("c_lo")) & (F.col("hi") == F.col("c_lo"))
    )
    old = F.coalesce(F.col("answer"), F.lit(""))
    target = old.rlike(r"\A[TF]+\z")
    if "stem" in questions.columns:
        target = target | F.coalesce(tx.tf_question("stem", *(["answer_format"] if "answer_format" in questions.columns else [])), F.lit(False))
    if "answer_source" in questions.columns:
        target = target & F.coalesce(F.lower("answer_source.source_file").endswith(".pdf"), F.lit(False))
    good = F.coalesce(good, F.lit(False)) & target
    flags = F.coalesce(F.col("review_flags"), F.array().cast("array<string>"))
    return rows.select(
        *[c for c in questions.columns if c not in ("answer", "review_flags")],
        F.when(good, F.col("c_lo")).otherwise(F.col("answer")).alias("answer"),
        F.when(good & (old != F.col("c_lo")), old).alias("replaced_answer"),
        F.when(good, pr.drop_flags(flags, ZOOM_CLEARS)).when(target, F.array_union(flags, F.array(F.lit(FLAG_ZOOM)))).otherwise(F.col("review_flags")).alias("review_flags"),
        good.alias("zoom_confirmed"),
    )


def recover_answers(questions: DataFrame, candidates: DataFrame, checks: DataFrame, errors: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Fill missing answers from quoted evidence that a second reading repeats.

    ``candidates``: pos, source_file, page, answer, quote, page_ok. ``checks``: pos, source_file,
    page, matches, answer. ``errors``: grp with a failed source. One distinct answer is needed.
    """
    asked = questions.filter(pr.missing("answer") & ~pr.discarded("status") & (F.lit(force) | ~F.col("tried")))
    answer = F.coalesce(F.col("answer"), F.lit(""))
    norm = tx.normalize_answer("answer")
    shape = asked.select("pos", F.col("stem").alias("__stem"), F.col("options").alias("__options"))
    valid = candidates.filter(
        F.col("page_ok") & (tx.strip(answer) != "") & ~answer.contains(tx.UNCERTAIN)
        & F.coalesce(F.col("quote").contains(tx.strip(answer)), F.lit(False))
    ).select("pos", "source_file", "page", norm.alias("found")).join(shape, "pos").filter(
        F.size(tx.format_flags("__stem", "__options", "found")) == 0
    ).select("pos", "source_file", "page", "found")
    second = checks.filter(F.col("matches")).select("pos", "source_file", "page", tx.strip("answer").alias("again")).distinct()
    agreed = valid.join(second, ["pos", "source_file", "page"]).filter(F.col("found") == F.col("again"))
    per_q = agreed.groupBy("pos").agg(F.min("found").alias("f_lo"), F.max("found").alias("f_hi"), F.min(F.struct("source_file", "page")).alias("src"))
    bad = (errors if errors is not None else questions.select("grp").limit(0)).select("grp").distinct().withColumn("__bad", F.lit(True))
    rows = attach_per_key(asked.select("pos", "grp").join(per_q, "pos", "left"), bad, ["grp"])
    filled = (F.col("f_lo") == F.col("f_hi")) & F.col("__bad").isNull()
    verdict = rows.select(
        "pos", F.when(filled, "recovered").otherwise("unresolved").alias("recovery"),
        F.when(filled, F.col("f_lo")).alias("__answer"), F.when(filled, F.col("src")).alias("answer_source"),
    )
    out = questions.drop("answer_source").join(verdict, "pos", "left")
    return out.withColumn("answer", F.coalesce("__answer", "answer")).withColumn(
        "review_flags", F.when(F.col("recovery") == "recovered", pr.drop_flags("review_flags", [pr.NO_ANSWER_FLAG])).otherwise(F.col("review_flags"))
    ).drop("__answer")


def item_flags(questions: DataFrame) -> DataFrame:
    """Assemble review flags of linked questions and recover shared material from the section.

    Optional columns: media_errors, figure_assets (arrays). ``link_flags`` come from the linker.
    """
    empty = F.array().cast("array<string>")
    has = lambda c: pr.filled(c) if c in questions.columns else F.lit(False)
    answer = tx.normalize_answer("answer")
    texts = F.concat_ws("\n", "stem", F.array_join("options", "\n"), "answer", "explanation")
    flags = F.concat(
        F.filter(F.coalesce(F.col("link_flags"), empty), lambda f: f == FLAG_DUPLICATE_NUMBER),
        F.filter(F.coalesce(F.col("link_flags"), empty), lambda f: f != FLAG_DUPLICATE_NUMBER),
        pr.flag_list(
            (~F.coalesce(F.col("complete"), F.lit(False)), FLAG_CROSS_PAGE),
            (has("media_errors"), FLAG_MEDIA_ERROR),
            (~has("media_errors") & has("figure_assets"), FLAG_MEDIA_PENDING),
            (texts.contains(tx.UNCERTAIN), FLAG_OCR),
            (F.coalesce(F.col("answer"), F.lit("")) == "", pr.NO_ANSWER_FLAG),
        ),
        tx.format_flags("stem", "options", "__answer"),
    )
    section = F.coalesce(F.col("section"), F.lit(""))
    shared = section.contains(GROUP_CUE) & (F.length(section) > 30) & ~F.col("stem").contains(section)
    return questions.withColumn("__answer", answer).withColumn("review_flags", flags).select(
        *[c for c in questions.columns if c not in ("stem", "answer", "link_flags", "review_flags")],
        F.when(shared, F.concat(section, F.lit("\n"), F.col("stem"))).otherwise(F.col("stem")).alias("stem"),
        F.col("__answer").alias("answer"), "review_flags", shared.alias("shared_material"),
    )


def latest_decisions(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """The latest decision per key: one combinable aggregate, no window over a hot row."""
    rest = [c for c in decisions.columns if c not in keys]
    order = ["ts"] + [c for c in ("event_id",) if c in rest] + [c for c in rest if c not in ("ts", "event_id")]
    latest = decisions.groupBy(*keys).agg(F.max(F.struct(*order)).alias("d"))
    return latest.select(*keys, *[F.col(f"d.{c}").alias(c) for c in rest])


def _places(log: DataFrame, *rest: str) -> tuple[list[str], Column]:
    """What tells the rows of a log at one time apart, and the stretch of time (an hour) that one window sees of a question."""
    return [c for c in ("event_id", *rest) if c in log.columns], F.floor(F.unix_seconds("ts") / 3600)


def apply_question_decisions(questions: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(questions after all valid decisions, history, rejected decisions with reasons).

    ``decisions``: pos, token, decision, ts, and event_id where times may be equal. Each is judged on its own: the token must be the
    row's current ``identity``; accepting needs an answer, a confirmed figure where one is suspected, and no uncertain
    text. The latest valid one holds, an accepted one clears all flags for good. ``history`` has a row for each valid
    one, with the status and the flags it met; it is a table, since a question may have any number of them.
    """
    texts = F.concat_ws("\n", "stem", F.array_join("options", "\n"), "answer", "explanation")
    confirmed = F.coalesce(F.col("figure_status") == "confirmed", F.lit(False))
    facts = questions.select(
        "pos", F.lit(True).alias("known"), F.col("identity").alias("current"), F.col("status").alias("own_status"), F.col("review_flags").alias("own_flags"),
        F.when(pr.missing("answer"), "no answer").when(F.col("suspected") & ~confirmed, "figure not confirmed").when(texts.contains(tx.UNCERTAIN), "uncertain text").alias("obstacle"))
    log = attach_per_key(decisions, facts, ["pos"], row_id="ts")
    accepts = F.col("decision") == "accepted"
    reason = (
        F.when(F.col("known").isNull(), "unknown row")
        .when(~F.coalesce(F.col("decision").isin("accepted", "discarded", "pending"), F.lit(False)), "unknown decision")
        .when(~F.coalesce(F.col("token") == F.col("current"), F.lit(False)), "stale")
        .when(accepts, F.col("obstacle"))
    )
    judged = log.withColumn("reason", reason)
    kept = [c for c in decisions.columns if c != "token"]
    rejected = judged.filter("reason IS NOT NULL").select(*kept, "reason")
    valid = judged.filter("reason IS NULL").withColumn("accepted", F.when(accepts, True))
    tie, hour = _places(decisions, "decision")
    met = last_before(valid, ["pos"], "ts", ["decision", "accepted"], tie=tie, bucket=hour)
    none = F.array().cast("array<string>")
    history = met.select(
        *kept, F.coalesce("prev_decision", "own_status").alias("previous_status"), F.when(F.col("prev_accepted"), none).otherwise(F.col("own_flags")).alias("previous_flags"))
    last = valid.groupBy("pos").agg(
        F.max_by("decision", F.struct("ts", *tie)).alias("__d"), F.bool_or(F.coalesce("accepted", F.lit(False))).alias("__clear"), F.count(F.lit(1)).alias("__n"))
    updated = questions.join(last, "pos", "left").select(
        *[c for c in questions.columns if c not in ("status", "review_flags")],
        F.coalesce("__d", "status").alias("status"), F.when(F.col("__clear"), none).otherwise(F.col("review_flags")).alias("review_flags"),
        F.coalesce("__n", F.lit(0)).alias("decisions"))
    return updated, history, rejected


def apply_figure_decisions(questions: DataFrame, decisions: DataFrame, available: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(questions, history, rejects): ``confirm`` keeps the figures there are by then, ``replace`` sets new ones, ``none`` empties them.

    ``decisions``: pos, token, action, regions, ts, and event_id where times may be equal. All valid ones count, in order. They remove
    the media flags and media errors; figures reviewed are shared with no other question. ``history`` has a row for each
    valid one with the figures and flags it met.
    """
    kind = questions.schema["figures"].dataType
    empty = F.array().cast(kind)
    bad = lambda figures: F.exists(figures, lambda f: tx.region_error(f["page"], f["bbox"], available).isNotNull())
    facts = questions.select(
        "pos", F.lit(True).alias("known"), F.col("identity").alias("current"), F.coalesce("figures", empty).alias("own"), F.col("review_flags").alias("own_flags"))
    log = attach_per_key(decisions.withColumn("regions", F.coalesce(F.col("regions").cast(kind), empty)), facts, ["pos"], row_id="ts")
    action = F.col("action")
    reason = (
        F.when(F.col("known").isNull(), "unknown row")
        .when(~F.coalesce(action.isin("confirm", "replace", "none"), F.lit(False)), "unknown action")
        .when(~F.coalesce(F.col("token") == F.col("current"), F.lit(False)), "stale")
        .when((action == "replace") & (F.size("regions") == 0), "no figure").when((action == "replace") & bad(F.col("regions")), "bad region")
    )
    stamped = log.withColumn("reason", reason).withColumn(
        "sets", F.when(F.col("reason").isNull(), F.when(action == "none", empty).when(action == "replace", F.col("regions"))))
    tie, hour = _places(decisions, "action")
    there = last_before(stamped, ["pos"], "ts", ["sets"], tie=tie, bucket=hour).withColumn("met", F.coalesce("prev_sets", "own"))
    confirms = F.col("reason").isNull() & (action == "confirm")
    judged = there.withColumn("reason", F.when(confirms & (F.size("met") == 0), "no figure").when(confirms & bad(F.col("met")), "bad region").otherwise(F.col("reason")))
    kept = [c for c in decisions.columns if c not in ("token", "regions")]
    rejected = judged.filter("reason IS NOT NULL").select(*kept, "reason")
    valid = judged.filter("reason IS NULL").drop("prev_sets").withColumn("one", F.lit(True))
    before = last_before(valid, ["pos"], "ts", ["one"], tie=tie, bucket=hour)
    left = pr.drop_flags("own_flags", pr.MEDIA_FLAGS)
    history = before.select(*kept, F.col("met").alias("previous_figures"), F.when(F.col("prev_one"), left).otherwise(F.col("own_flags")).alias("previous_flags"))
    place = F.struct("ts", *tie)
    last = valid.groupBy("pos").agg(
        F.max_by("sets", F.when(F.col("sets").isNotNull(), place)).alias("__sets"), F.max_by("action", place).alias("__action"), F.count(F.lit(1)).alias("__n"))
    reviewed = F.coalesce("__sets", "figures")
    fields = kind.elementType.names
    if "shared_with" in fields:
        reviewed = F.transform(reviewed, lambda f: f.withField("shared_with", F.array().cast("array<string>")))
    if "sharing_reviewed" in fields:
        reviewed = F.transform(reviewed, lambda f: f.withField("sharing_reviewed", F.lit(True)))
    done = F.col("__n").isNotNull()
    errors = [F.when(done, F.array().cast(questions.schema["media_errors"].dataType)).otherwise(F.col("media_errors")).alias("media_errors")] if "media_errors" in questions.columns else []
    updated = questions.join(last, "pos", "left").select(
        *[c for c in questions.columns if c not in ("figures", "review_flags", "figure_status", "media_errors")],
        F.when(done, reviewed).otherwise(F.col("figures")).alias("figures"),
        F.when(done, pr.drop_flags("review_flags", pr.MEDIA_FLAGS)).otherwise(F.col("review_flags")).alias("review_flags"),
        F.when(done, "confirmed").otherwise(F.col("figure_status")).alias("figure_status"), F.col("__action").alias("figure_action"),
        F.coalesce("__n", F.lit(0)).alias("figure_decisions"), *errors)
    return updated, history, rejected


def apply_text_edits(questions: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions, rejects): the latest edit replaces the four text fields and keeps only media flags.

    ``edits``: pos, token, stem, options, answer, explanation, ts. Previous values are stored.
    """
    fields = ["stem", "options", "answer", "explanation"]
    last = latest_decisions(edits, ["pos"]).select(
        "pos", F.col("token").alias("__t"), F.col("ts").alias("__ts"), *[F.col(c).alias(f"__{c}") for c in fields]
    )
    rows = questions.join(last, "pos", "left")
    texts = F.concat_ws("\n", "__stem", F.array_join("__options", "\n"), "__answer", "__explanation")
    incomplete = F.coalesce(F.exists("__options", lambda o: o.isNull()), F.lit(True))
    for c in ("stem", "answer", "explanation"):
        incomplete = incomplete | F.col(f"__{c}").isNull()
    reject = (
        F.when(F.col("__ts").isNull(), F.lit(None))
        .when(~F.coalesce(F.col("__t") == F.col("identity"), F.lit(False)), "stale")
        .when(incomplete, "missing field")
        .when(tx.strip("__stem") == "", "blank stem")
        .when(texts.contains(tx.UNCERTAIN), "uncertain text")
    )
    judged = rows.withColumn("__reject", reject)
    apply = F.col("__ts").isNotNull() & F.col("__reject").isNull()
    updated = judged.select(
        *[c for c in questions.columns if c not in [*fields, "review_flags"]],
        *[F.when(apply, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in fields],
        F.when(apply, pr.keep_flags("review_flags", pr.MEDIA_FLAGS)).otherwise(F.col("review_flags")).alias("review_flags"),
        F.when(apply, F.struct(*fields, F.col("review_flags").alias("flags"), F.col("__ts").alias("ts"))).alias("previous_values"),
    )
    return updated, judged.filter("__reject IS NOT NULL").select("pos", F.col("__reject").alias("reason"))


def review_sample(questions: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """A reproducible tenth of every source, at least one row, for a visual second look.

    Order is by the digest of source and row; rows that already have a task keep their place in the
    tenth but are not repeated. Ranks are taken per (source, digest prefix), so one large source
    is spread over many tasks.
    """
    keyed = questions.select(
        "pos", "source_file", F.when(F.size("options") > 0, "options[0]").otherwise("stem").alias("field"),
        F.sha2(F.concat("source_file", F.lit("q"), F.col("pos").cast("string")), 256).alias("h"),
    )
    prefix = F.conv(F.substring("h", 1, 4), 16, 10).cast("int")
    ranked = row_numbers(keyed, ["source_file"], "h", "rank", bucket=prefix, total="n")
    share = F.greatest(F.lit(1), F.floor((F.col("n") + 9) / 10))
    picked = ranked.filter(F.col("rank") <= share).select("pos", "source_file", "field", "rank")
    return picked if tasks is None else picked.join(tasks.select("pos"), "pos", "left_anti")


def review_queue(questions: DataFrame) -> DataFrame:
    """Pending rows in bank order with their place and the next pending row (the last wraps to the first)."""
    wait = questions.filter(pr.pending("status", "answer", "review_flags", F.col("suspected"), "figure_status")).select(
        "pos", (F.coalesce(F.col("figure_status"), F.lit("")) != "confirmed").alias("figure_open")
    )
    ranked = row_numbers(wait, [], "pos", "place", total="count")
    # The row after the last one is the first: places close to a ring, so the join key is unique.
    ring = ranked.select((F.pmod(F.col("place") - 2, F.col("count")) + 1).alias("place"), F.col("pos").alias("next_pos"))
    return ranked.join(ring, "place").select("pos", "place", "count", "figure_open", "next_pos")


def opening_card(queue: DataFrame) -> DataFrame:
    """First pending row whose figure is unconfirmed, else the first pending row."""
    return queue.agg(F.coalesce(F.min(F.when(F.col("figure_open"), F.col("pos"))), F.min("pos")).alias("pos"), F.max("count").alias("count"))


def next_pending(questions_pending: DataFrame, after: int) -> DataFrame:
    return questions_pending.agg(
        F.coalesce(F.min(F.when(F.col("pos") > after, F.col("pos"))), F.min("pos")).alias("pos")
    )


def queue_counts(questions: DataFrame) -> DataFrame:
    gone = pr.discarded("status")
    wait = pr.pending("status", "answer", "review_flags", F.col("suspected"), "figure_status")
    return questions.agg(
        F.count_if(wait).alias("pending"), F.count_if(pr.missing("answer") & ~gone).alias("missing"),
        F.count_if(gone).alias("discarded"), F.count(F.lit(1)).alias("total"),
    )


def review_summary(checks: DataFrame, questions: DataFrame) -> DataFrame:
    """Questions checked, fields read again, fields corrected, questions left unresolved.

    ``checks``: pos, field, status. ``questions``: pos, status of the text review.
    """
    unresolved = F.col("status") == "unresolved"
    left = questions.filter(unresolved).select("pos").unionByName(checks.filter(unresolved).select("pos")).distinct()
    tagged = (
        questions.select(F.lit("q").alias("side"), F.lit("").alias("status"))
        .unionByName(checks.select(F.lit("c").alias("side"), "status"))
        .unionByName(left.select(F.lit("u").alias("side"), F.lit("").alias("status")))
    )
    side = F.col("side")
    return tagged.agg(
        F.count_if(side == "q").alias("checked"), F.count_if(side == "c").alias("flagged_fields"),
        F.count_if((side == "c") & (F.col("status") == "corrected")).alias("corrected_fields"),
        F.count_if(side == "u").alias("unresolved_questions"),
    ).withColumn("status", F.when(F.col("unresolved_questions") == 0, "complete").otherwise("needs_review"))
