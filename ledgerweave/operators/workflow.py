"""Submission queue, approval and posting as append-only event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerweave.functions import codes, numbers
from ledgerweave.operators.reconcile import Settings
from ledgerweave.sources import files

#: Allowed moves of the workflow.
MOVES = {None: ("pending",), "pending": ("held", "posted"), "held": ("pending", "held", "posted"), "posted": ()}
ACTIVE = ("pending", "held")


def legal(before: Column, after: Column) -> Column:
    out = F.lit(False)
    for state, to in MOVES.items():
        here = before.isNull() if state is None else before == state
        out = out | (F.coalesce(here, F.lit(False)) & after.isin(*to)) if to else out
    return out


def judged_moves(events: DataFrame) -> DataFrame:
    """Every event with the state before it and whether the move is allowed."""
    w = Window.partitionBy("submission_id").orderBy("event_at", "event_id")
    out = events.withColumn("before", F.lag("state").over(w))
    return out.withColumn("legal", legal(F.col("before"), F.col("state")))


def current_state(events: DataFrame) -> DataFrame:
    """Latest state of every submission, by an aggregate that combines before the shuffle."""
    last = F.max_by(F.struct("state", "event_at", "event_id"), F.struct("event_at", "event_id")).alias("e")
    return events.groupBy("submission_id").agg(last, F.count("*").alias("n_events")).select("submission_id", "e.state", "e.event_at", "n_events")


def approval(settings: Settings, force: Column) -> tuple[Column, Column]:
    """(can approve, reason it cannot) of workflow_status and review_score_pct."""
    active = F.col("workflow_status").isin(*ACTIVE)
    enough = F.col("review_score_pct") >= settings.min_review_score
    forced = force & F.lit(settings.allow_override)
    reason = (
        F.when(~active, F.concat(F.lit("not in an active state: "), F.col("workflow_status")))
        .when(~enough & ~forced, F.format_string("score %.0f%% below minimum %.0f%%", F.col("review_score_pct").cast("double"), F.lit(settings.min_review_score)))
    )
    return active & (enough | forced), reason


def submitted(batch: DataFrame, posted: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason) of a batch. The first submission of an invoice, by id, becomes active,
    so later ones of the batch meet an active submission.

    Invoice keys compare without regard to case and accents (Q5). Firsts are found by an aggregate, which combines before
    the shuffle: all invoices without a number share one key.
    """
    key = codes.collated("lib_facture").alias("__key")
    first = batch.groupBy(key).agg(F.min("submission_id").alias("__first"))
    known = posted.select(key).distinct().withColumn("__posted", F.lit(True))
    active = current.where(F.col("state").isin(*ACTIVE)).select(key).distinct().withColumn("__active", F.lit(True))
    keys = first.join(known.hint("merge"), "__key", "left").join(active.hint("merge"), "__key", "left")
    marked = batch.withColumn("__key", codes.collated("lib_facture")).join(keys.hint("merge"), "__key").drop("__key")
    later = F.col("__active") | (F.col("submission_id") != F.col("__first"))
    reason = F.when(F.col("__posted"), "already posted").when(F.coalesce(later, F.col("submission_id") != F.col("__first")), "active submission exists")
    marked = marked.withColumn("reason", reason).drop("__posted", "__active", "__first")
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


SUBMISSIONS = "submission_id long, lib_facture string, submitted_by string, submitted_at timestamp, review_score_pct decimal(5,2)"
EVENTS = "event_id long, submission_id long, lib_facture string, event_at timestamp, state string"
NOTES = "notification_id long, username string, type string, title string, message string"
REJECTS = f"{SUBMISSIONS}, reason string"


def _typed(df: DataFrame, schema: str) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)])


def recorded(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Tables of all committed batches: submissions, their events, notifications and rejects."""
    kinds = {"submission": SUBMISSIONS, "event": EVENTS, "notification": NOTES, "reject": REJECTS}
    return {name: files.committed_or_empty(spark, root, name, kind) for name, kind in kinds.items()}


def _recorded_as(spark: SparkSession, root: str, batch: str) -> bool:
    return not files.committed_or_empty(spark, root, "metadata", "n long").where(F.col("batch") == batch).isEmpty()


def _event_id(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 1)


def record_submissions(spark: SparkSession, root: str, batch: str, submissions: DataFrame, posted: DataFrame) -> None:
    """The accepted submissions of a batch are appended with their first event and a notification, the others
    with their reason. What earlier batches left active counts. The commit marker comes last: a batch that broke off is
    written again in the same folders, and one that is committed is never run again, so a replay adds nothing."""
    if _recorded_as(spark, root, batch):
        return
    tables = recorded(spark, root)
    latest = tables["event"].groupBy("submission_id", "lib_facture").agg(F.max_by("state", F.struct("event_at", "event_id")).alias("state"))
    accepted, rejected = submitted(submissions, posted, latest)
    events = accepted.select(_event_id(F.col("submission_id"), F.lit("pending")).alias("event_id"), "submission_id", "lib_facture", F.col("submitted_at").alias("event_at"), F.lit("pending").alias("state"))
    out = {"submission": _typed(accepted, SUBMISSIONS), "event": _typed(events, EVENTS), "notification": _typed(notifications(accepted), NOTES), "reject": _typed(rejected, REJECTS)}
    files.write_extraction(out | {"metadata": spark.createDataFrame([(1,)], "n long")}, root, batch)


def record_moves(spark: SparkSession, root: str, batch: str, moves: DataFrame) -> None:
    """The moves ``(submission_id, event_at, state)`` of a batch that are legal after all that is recorded are appended.
    Of several moves of a submission in one batch each is judged after the last one that was legal."""
    if _recorded_as(spark, root, batch):
        return
    tables = recorded(spark, root)
    now = tables["event"].groupBy("submission_id", "lib_facture").agg(F.max_by("state", F.struct("event_at", "event_id")).alias("now"))
    # the few moves of one submission
    asked = moves.groupBy("submission_id").agg(F.array_sort(F.collect_list(F.struct("event_at", "state"))).alias("moves"))
    none = F.array().cast("array<struct<event_at: timestamp, state: string>>")

    def step(s: Column, m: Column) -> Column:
        ok = legal(s["now"], m["state"])
        return F.struct(F.when(ok, m["state"]).otherwise(s["now"]).alias("now"), F.when(ok, F.concat(s["done"], F.array(F.struct(m["event_at"].cast("timestamp").alias("event_at"), m["state"].alias("state"))))).otherwise(s["done"]).alias("done"))

    judged = now.join(asked.hint("merge"), "submission_id").withColumn("s", F.aggregate("moves", F.struct(F.col("now").alias("now"), none.alias("done")), step))
    events = judged.select("submission_id", "lib_facture", F.posexplode("s.done").alias("at", "m")).select(_event_id(F.lit(batch), F.col("submission_id"), F.col("at")).alias("event_id"), "submission_id", "lib_facture", "m.event_at", "m.state")
    files.write_extraction({"event": _typed(events, EVENTS), "metadata": spark.createDataFrame([(1,)], "n long")}, root, batch)


def approved_batch(submissions: DataFrame, ok: Column, lines: DataFrame, articles: DataFrame, already: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables to post, events) of a batch of submissions: those that may be approved are posted and get the state
    ``posted`` with the id of their invoice. An invoice is posted once: not when it is in ``already``, and of several
    submissions by the first."""
    key = codes.collated("lib_facture").alias("__key")
    able = submissions.where(ok).withColumn("__key", codes.collated("lib_facture")).join(already.select(key).distinct().hint("merge"), "__key", "left_anti")
    first = able.groupBy("__key").agg(F.min("submission_id").alias("submission_id"))
    able = able.drop("__key").join(first.select("submission_id").hint("merge"), "submission_id", "left_semi")
    tables = posted_tables(able.select("invoice_id", "lib_facture", "stated_total"), lines, articles, already)
    events = able.select("submission_id", "lib_facture", F.lit("posted").alias("state")).join(tables["facture"], "lib_facture")
    return tables, events


def posted_tables(heads: DataFrame, lines: DataFrame, articles: DataFrame, already: DataFrame) -> dict[str, DataFrame]:
    """Facture, lignefac, alert and metadata rows of invoices not posted yet.

    Ids come from a hash of the invoice key, so a rerun of the same batch makes the same rows; the metadata row is the
    commit marker and is written last. ``articles`` is the article dimension (``reconcile.articles``).
    """
    todo = heads.withColumn("__key", codes.collated("lib_facture")).join(already.select(codes.collated("lib_facture").alias("__key")).distinct().hint("merge"), "__key", "left_anti").drop("__key").withColumn("IDFacture", F.shiftrightunsigned(F.xxhash64("lib_facture"), 1))
    own = lines.join(todo.select("invoice_id", "IDFacture"), "invoice_id")
    # one article for each code, so a line is posted once however often its code is in the table
    filled = own.join(articles.select(F.col("key").alias("__code"), F.col("a.IDArticle").alias("__id")), F.upper("code") == F.col("__code"), "left")
    qty, price = F.col("qty").cast("decimal(12,3)"), F.coalesce("display_price", F.lit(0.0)).cast("decimal(12,3)")
    ligne = filled.select(
        "IDFacture", F.row_number().over(Window.partitionBy("IDFacture").orderBy("line_no")).alias("Ordre"), F.coalesce(F.nullif(F.col("id_article"), F.lit(0)), "__id", F.lit(0)).alias("IDArticle"),
        F.left("code", F.lit(50)).alias("Code"), F.left("designation", F.lit(255)).alias("LibProd"), qty.alias("Quantite"), price.alias("PrixVente"), F.lit("19").cast("decimal(5,2)").alias("TauxTVA"),
        "validation_status", "ocr_price", "erp_price", F.coalesce("score", F.lit(0.0)).alias("score"),
    )
    sums = ligne.groupBy("IDFacture").agg(F.sum(F.col("Quantite").cast("double") * F.col("PrixVente").cast("double")).alias("lines_total"), (F.sum("score") / F.greatest(F.count("*"), F.lit(1))).alias("mean_score"), F.count_if(F.col("validation_status") == "PRICE_MISMATCH").alias("n_mismatch"))
    total = F.coalesce(F.nullif(F.col("stated_total"), F.lit(0.0)), F.round("lines_total", 3), F.lit(0.0)).cast("decimal(12,3)")
    facture = todo.join(sums, "IDFacture", "left").withColumn("TotalHT", total)
    tax, gross = numbers.with_tax(F.col("TotalHT"))
    facture = facture.withColumn("TotalTVA", tax).withColumn("TotalTTC", gross)
    alerts = ligne.where("validation_status = 'PRICE_MISMATCH'").select(
        "IDFacture", "Ordre", F.lit("PRICE_MISMATCH").alias("type"),
        F.format_string("%s: read %.3f, reference %.3f", "Code", "ocr_price", "erp_price").alias("description"), F.lit(False).alias("is_resolved"),
    )
    meta = facture.select("IDFacture", F.coalesce("mean_score", F.lit(0.0)).cast("decimal(5,3)").alias("avg_confidence"), F.to_json(F.struct("lib_facture", "TotalHT", "n_mismatch")).alias("raw_json"))
    return {"facture": facture.select("IDFacture", "lib_facture", "TotalHT", "TotalTVA", "TotalTTC", "n_mismatch"), "lignefac": ligne, "alerts": alerts, "metadata": meta}


def notifications(accepted: DataFrame) -> DataFrame:
    """One notification for each accepted submission, cut to the column lengths."""
    title = F.concat(F.lit("Invoice "), F.col("lib_facture"), F.lit(" submitted"))
    message = F.format_string("%s sent %s for review (score %.1f%%)", "submitted_by", "lib_facture", F.col("review_score_pct").cast("double"))
    return accepted.select(F.col("submission_id").alias("notification_id"), F.left("submitted_by", F.lit(64)).alias("username"), F.lit("submission").alias("type"), F.left(title, F.lit(120)).alias("title"), F.left(message, F.lit(500)).alias("message"))


def unread(notes: DataFrame, receipts: DataFrame) -> DataFrame:
    """Notes without a read receipt."""
    return notes.join(receipts.select("notification_id").distinct(), "notification_id", "left_anti")
