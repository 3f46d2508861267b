"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks (operator 3).

1. Size of a document: number of ``[^\\x20\\x09-\\x0D]+`` runs. Sources in code-point order, null last, weigh
   5, 2, 1, repeating, and share the total of all sizes; a target stops at 3 times its source's size and the excess
   is shared again by weight until no target is above.
2. The mix is cut into equal blocks of words. Blocks go to sources by highest quotients target / (2 s + 1), equal
   quotients in the order of the sources. That is the same as rounding target / d for a common divisor d, which is
   narrowed with a few aggregates over the table of sources; the seats still open are then handed out by quotient and
   source. The method is house monotone, so the first k shards are the mix of a smaller house and each shard has
   integer quotas of its own.
3. Documents of a source are laid end to end in a seeded order and cut into blocks, and the blocks are put in a seeded
   order. A source's blocks are taken in that order, round after round, and its shard quotas cut this run: shard 0 takes
   the first quota of blocks, shard 1 the next, and so on. ``spans`` lists which words of a document go to which shard.

Positions come from range-sorted tables: sums of whole ranges plus a running sum inside each range; the plan of a
source reaches its rows through one row for each range and source. So a source that holds most rows is spread over
many tasks. Only scalars reach the driver.

Defined results: null text has size 0; empty sources get target 0; repeated rows are documents of their own (equal
rows may take different words); a null doc_id sorts like any other value; extra columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.llm.common import dense_index, freeze, with_place

WEIGHTS = (5, 2, 1)
MOST = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, total: int, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds ``weight`` and ``target`` (double) to ``sources(source, source_size)``."""
    ranked = dense_index(sources, [F.col("source").asc_nulls_last()], "rank", "mix-sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = freeze(ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * most), "mix-weights")
    level, before = 0.0, -1
    while True:
        # level * weight > most: the source is full; the others share what is left
        full = F.col("weight") * F.lit(level) > F.col("most")
        left, full_n, held = ranked.agg(
            F.sum(F.when(~full, F.col("weight"))), F.count_if(full), F.sum(F.when(full, F.col("most")).otherwise(F.lit(0)))
        ).first()
        if not left or full_n == before:
            break
        before, level = full_n, (total - (held or 0)) / left
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(level), F.col("most").cast("double"))).drop("most", "rank")


def divisors(shares: DataFrame, houses: list[int], tries: int = 24) -> list[tuple[float, float, int]]:
    """For each house (d, below, lacks): divisor d leaves ``lacks`` seats open, and between d and ``below``, which gives
    at least the house, no source gains more than one seat."""
    total, n, most = shares.agg(F.sum("target"), F.count("*"), F.max("target")).first()
    spans = {i: (total / (h + n + 1), total / max(h - n, 0.25)) for i, h in enumerate(houses)}
    lacks: dict[int, int] = {}
    while True:
        wide = [i for i, (lo, hi) in spans.items() if i not in lacks or lacks[i] and most * (1 / lo - 1 / hi) >= 1]
        if not wide:
            return [(spans[i][1], spans[i][0], lacks[i]) for i in range(len(houses))]
        options = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(spans[i][0]).alias("lo"), F.lit(spans[i][1]).alias("hi")) for i in wide])
        each = shares.select("target", F.explode(options).alias("o")).select("target", "o.*", F.explode(F.sequence(F.lit(1), F.lit(tries))).alias("k"))
        d = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / (tries + 1)
        sums = {(r.i, r.k): r.s for r in each.groupBy("i", "k").agg(F.sum(_rounded("target", d)).alias("s")).collect()}  # one row for each try
        for i in wide:
            lo, hi = spans[i]
            marks = [lo + (hi - lo) * k / (tries + 1) for k in range(1, tries + 1)]
            left = [houses[i] - sums[i, k] for k in range(1, tries + 1)]
            at = next((k for k, x in enumerate(left) if x >= 0), None)  # seats fall as the divisor grows
            if at is None:
                spans[i] = (marks[-1], hi)
            else:
                spans[i], lacks[i] = (marks[at - 1] if at else lo, marks[at]), left[at]


def _rounded(target: str, d: Column) -> Column:
    return F.floor(F.col(target) / d + 0.5).cast("long")


def quotas(shares: DataFrame, block: int, shards: int = 1) -> DataFrame:
    """Adds ``seats``, the blocks of each source, and ``quotas``, an array of its blocks in every shard."""
    total = shares.agg(F.sum("target")).first()[0] or 0.0
    if not total:
        zero = F.lit(0).cast("long")
        return shares.withColumn("seats", zero).withColumn("quotas", F.array_repeat(zero, shards))
    blocks = max(1, round(total / block))
    found = divisors(shares, [blocks * (k + 1) // shards for k in range(shards)])
    upto = shares.withColumn("upto", F.array(*[_rounded("target", F.lit(d)) for d, _, _ in found]))
    ties = [(k, below, lacks) for k, (_, below, lacks) in enumerate(found) if lacks]
    if ties:
        # the open seats go to the sources that gain one below the divisor, in the order of quotient and source
        options = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(below).alias("d"), F.lit(lacks).alias("lacks")) for k, below, lacks in ties])
        tied = upto.select("source", "target", "upto", F.explode(options).alias("o"))
        had = F.get("upto", F.col("o.k"))
        tied = tied.where(_rounded("target", F.col("o.d")) > had).select("source", F.col("o.k").alias("k"), F.col("o.lacks").alias("lacks"), (F.col("target") / (2 * had + 1)).alias("quotient"))
        ranked = dense_index(tied, [F.col("k"), F.col("quotient").desc(), F.col("source").asc_nulls_last()], "place", "mix-ties")
        first = ranked.groupBy("k").agg(F.min("place").alias("first"))  # one row for each shard
        won = ranked.join(F.broadcast(first), "k").where(F.col("place") - F.col("first") < F.col("lacks"))
        won = won.groupBy(F.col("source").alias("s1")).agg(F.collect_set("k").alias("won"))
        upto = upto.join(won.hint("merge"), F.col("source").eqNullSafe(F.col("s1")), "left").drop("s1")
        upto = upto.withColumn("upto", F.transform("upto", lambda u, k: u + F.coalesce(F.array_contains("won", k), F.lit(False)).cast("long"))).drop("won")
    before = F.concat(F.array(F.lit(0).cast("long")), F.slice("upto", 1, shards - 1)) if shards > 1 else F.array(F.lit(0).cast("long"))
    return upto.withColumn("seats", F.element_at("upto", -1)).withColumn("quotas", F.zip_with("upto", before, lambda u, v: u - v)).drop("upto")


def block_words(total: int, sources: int, blocks: int = 4096, most: int = 2048) -> int:
    """Words in a block: parameters are how many blocks a source's mean share should have and the most words of a block."""
    return max(1, min(most, total // max(1, sources * blocks)))


def sized_rows(docs: DataFrame) -> DataFrame:
    """What the mix reads of ``docs(row, doc_id, source, text)``; ``row`` is a value of its own for every row."""
    return docs.select("row", "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("kind"))


def taken_spans(sized: DataFrame, shards: int = 8, seed: int = 23) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, taken, spans) for every row of ``sized``.

    ``spans`` are (shard, round, lo, hi): words [lo, hi) of the document that a shard takes in a round, in word order.
    """
    sized = freeze(sized.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "kind")), "mix-sizes")
    order = [F.col("source").asc_nulls_last(), F.col("h"), F.col("doc_id"), F.col("size"), F.col("row")]
    placed = with_place(sized.drop("kind"), order, "mix-rows")
    ranges = freeze(placed.groupBy("source", "pid").agg(F.sum("size").alias("range_size")), "mix-ranges")
    sources = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    total, n = sources.agg(F.sum("source_size"), F.count("*")).first()
    block = block_words(total or 0, n)
    shares = freeze(targets(sources, total or 0), "mix-targets")
    plan = quotas(shares, block, shards).select(
        F.col("source").alias("s2"), "source_size", "target",
        # the run of a source's words, cut by its shard quotas
        F.transform("quotas", lambda _, k: F.least(F.aggregate(F.slice("quotas", 1, k + 1), F.lit(0).cast("long"), lambda a, q: a + q) * block, F.col("source_size") * MOST)).alias("cuts"),
        F.ceil(F.col("source_size") / block).cast("long").alias("blocks"),
    )
    # seeded order of a source's blocks: place = (block * step + shift) mod blocks, step a prime that does not divide it
    step = F.when(F.col("blocks") % 1_000_003 == 0, 998_244_353).otherwise(1_000_003).cast("long")
    shift = F.pmod(F.xxhash64(F.lit(seed), "s2"), F.greatest("blocks", F.lit(1)))
    plan = freeze(plan.withColumn("step", step).withColumn("shift", shift), "mix-plan")
    ahead = F.sum("range_size").over(Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("range_size")
    ranges = ranges.withColumn("ahead", ahead).drop("range_size")
    # one row for each range and source carries the plan to the rows
    ranges = ranges.join(plan.hint("merge"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2").withColumnsRenamed({"source": "s1", "pid": "p1"})
    inside = Window.partitionBy("pid", "source").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.withColumn("upto", F.sum("size").over(inside))
    rows = rows.join(ranges.hint("merge"), (F.col("pid") == F.col("p1")) & F.col("source").eqNullSafe(F.col("s1")))
    rows = rows.withColumn("end", F.col("ahead") + F.col("upto")).withColumn("begin", F.col("end") - F.col("size"))
    quota, last = F.element_at("cuts", -1), F.col("blocks") - 1

    def place(b: Column) -> Column:
        return F.pmod(b * F.col("step") + F.col("shift"), F.col("blocks"))

    def spans_of(b: Column) -> Column:
        """Spans of the part of the document in block b: where it lies in the source's run, round after round."""
        lo, hi = F.greatest(F.col("begin"), b * block), F.least(F.col("end"), (b + 1) * block)
        # the last block is the short one
        short = F.when(place(last) < place(b), F.col("blocks") * block - F.col("source_size")).otherwise(0)
        at = place(b) * block - short + lo - b * block

        def of_shard(r: Column, k: Column) -> Column:
            shift_to = lo - F.col("begin") - at - r * F.col("source_size")
            left = F.greatest(at + r * F.col("source_size"), F.when(k == 0, 0).otherwise(F.get("cuts", k - 1)))
            right = F.least(at + r * F.col("source_size") + hi - lo, F.get("cuts", k))
            return F.struct(k.alias("shard"), r.alias("round"), (left + shift_to).alias("lo"), (right + shift_to).alias("hi"))

        def of_round(r: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: of_shard(r, k))

        met = F.filter(F.sequence(F.lit(0), F.lit(MOST - 1)), lambda r: at + r * F.col("source_size") < quota)
        return F.filter(F.flatten(F.transform(met, of_round)), lambda s: s["lo"] < s["hi"])

    within = F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))
    none = F.array().cast("array<struct<shard: int, round: int, lo: bigint, hi: bigint>>")
    rows = rows.withColumn("spans", F.when(F.col("size") > 0, F.flatten(F.transform(within, spans_of))).otherwise(none))
    rows = rows.withColumn("taken", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"]))
    return rows.select("row", "doc_id", "source", "size", "source_size", "target", "taken", "spans")


def taken_words(docs: DataFrame, shards: int = 8, seed: int = 23) -> DataFrame:
    """The mix of ``docs(doc_id, source, text)``; see ``taken_spans``."""
    marked = docs.select("doc_id", "source", "text").withColumn("row", F.monotonically_increasing_id())
    return taken_spans(sized_rows(marked), shards, seed).drop("row")


def op3_sainte_lague_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return taken_words(docs).select("doc_id", "size", "source_size", "target", "taken", "spans")


def words_between(text: Column, lo: Column, hi: Column) -> Column:
    """The words lo..hi-1 of a text, joined by blanks."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), lo.cast("int") + 1, (hi - lo).cast("int")), " ")


def row_number_in_file(docs: DataFrame) -> Column:
    """File and row number, the same in every scan however files are split; raises where docs are not read from files."""
    meta = docs.metadataColumn("_metadata")
    return F.struct(F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("index"))


def mixed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents of the mix, exactly the words that ``taken_spans`` plans.

    A document comes once for every round that takes all of it, as it is; of a round that takes parts of it, each run of
    words comes as a document of its own. Documents of which nothing is taken go. ``docs`` are rows as read from Parquet
    files, each known by its file and place, so repeated or missing doc_ids are never mixed up; other rows are written
    out first. Columns of any name pass through.
    """
    try:
        row = row_number_in_file(docs)
    except AnalysisException:
        docs = freeze(docs, "mix-documents")
        row = row_number_in_file(docs)
    sized = sized_rows(docs.select(row.alias("row"), "doc_id", "source", "text"))
    taken = taken_spans(sized).where("taken > 0").select("row", "size", "spans")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    joined = docs.select(row.alias("row"), whole.alias("doc")).join(taken.hint("merge"), "row")

    def runs(r: Column) -> Column:
        """Spans of a round, those that touch joined."""

        def put(a: Column, s: Column) -> Column:
            touching = F.element_at(a, -1)["hi"] == s["lo"]
            last = F.struct(F.element_at(a, -1)["lo"].alias("lo"), s["hi"].alias("hi"))
            grown = F.concat(F.slice(a, 1, F.size(a) - 1), F.array(last))
            return F.when((F.size(a) > 0) & touching, grown).otherwise(F.concat(a, F.array(F.struct(s["lo"].alias("lo"), s["hi"].alias("hi")))))

        mine = F.array_sort(F.transform(F.filter("spans", lambda s: s["round"] == r), lambda s: F.struct(s["lo"], s["hi"])))
        return F.aggregate(mine, F.array().cast("array<struct<lo: bigint, hi: bigint>>"), put)

    runs_taken = joined.select("doc", "size", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(MOST - 1)), runs))).alias("run"))
    piece = F.when(F.col("run.hi") - F.col("run.lo") == F.col("size"), F.col("doc.text")).otherwise(words_between(F.col("doc.text"), F.col("run.lo"), F.col("run.hi")))
    out = runs_taken.select("doc", piece.alias("piece"))
    cols = {"text": F.col("piece"), "n_chars": F.length("piece").cast("long")}
    return out.select(*[cols.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
