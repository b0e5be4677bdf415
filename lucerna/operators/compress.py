"""GEN-02: context within a budget, for all questions at once and in columns alone.

What is served to a question is cut into sentences; sentences are chosen greedily by new words of the question a character, until none
fits or none says anything new. Gains only fall while more is covered and room only shrinks, so a sentence that has
no gain or no room is not looked at again. If a single sentence alone covers more than all that were chosen, it is taken instead:
together that is never less than a third of what the best choice of sentences covers, and at least half in practice (tests enumerate).
Chosen sentences stay in their order and keep their segment's number, so that citations still hold.

Defined results: a context that fits is left whole; a question without words, or whose words no sentence has, gets the first
sentences that fit; a budget too small for any sentence gives an empty context; null texts say nothing; a question that was served
nothing has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..session import DEFAULTS

ITEM = "struct<segment:int,place:int,sentence:string,cost:int,terms:array<string>>"


def items_of(questions: DataFrame, served: DataFrame) -> DataFrame:
    """query_id and items: the sentences served to each question, in order, with what each costs and the question's words that it has."""
    asked = questions.select("query_id", F.array_distinct(t.tokens(t.normalize(F.col("query")), True)).alias("_asked"))
    rows = served.join(asked, "query_id").select("query_id", "segment", "_asked", F.posexplode(t.sentences(t.strip(F.coalesce("text", F.lit(""))))).alias("place", "sentence"))
    line = F.concat(F.lit("[Segment "), F.col("segment").cast("string"), F.lit("] "), t.strip(F.regexp_replace("sentence", r"\s+", " ")))
    rows = rows.where(t.strip(F.col("sentence")) != "").withColumn("sentence", line)
    item = F.struct(
        F.col("segment").cast("int").alias("segment"), F.col("place").cast("int").alias("place"), "sentence", (F.length("sentence") + 1).cast("int").alias("cost"),
        F.array_intersect("_asked", t.tokens(t.normalize(F.col("sentence")))).alias("terms"),
    )
    return rows.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("items"))


def chosen(items: Column, budget: int) -> Column:
    """The chosen items of an array, in its order."""
    none = F.array().cast(f"array<{ITEM}>")
    words = F.array().cast("array<string>")
    new = lambda x, covered: F.size(F.array_except(x["terms"], covered))
    state = lambda left, covered, used, taken: F.struct(left.alias("left"), covered.alias("covered"), used.alias("used"), taken.alias("taken"))

    def step(s: Column, _: Column) -> Column:
        open_ = F.filter(s["left"], lambda x: (x["cost"] + s["used"] <= budget) & (new(x, s["covered"]) > 0))
        # Most new words a character; of equal ones the first in order.
        best = F.array_max(F.transform(open_, lambda x: F.struct((new(x, s["covered"]) / x["cost"]).alias("worth"), (-x["segment"]).alias("s"), (-x["place"]).alias("p"), x.alias("x"))))["x"]
        return F.when(best.isNull(), state(none, s["covered"], s["used"], s["taken"])).otherwise(
            state(
                F.filter(open_, lambda x: (x["segment"] != best["segment"]) | (x["place"] != best["place"])), F.array_union(s["covered"], best["terms"]),
                (s["used"] + best["cost"]).cast("int"), F.concat(s["taken"], F.array(best)),
            )
        )

    start = state(items, words, F.lit(0), none)
    greedy = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1))), start, step)
    single = F.array_max(F.transform(F.filter(items, lambda x: x["cost"] <= budget), lambda x: F.struct(F.size(x["terms"]).alias("n"), (-x["segment"]).alias("s"), (-x["place"]).alias("p"), x.alias("x"))))
    first = F.aggregate(
        items, F.struct(F.lit(0).alias("used"), F.lit(False).alias("full"), none.alias("taken")),
        lambda s, x: F.when(s["full"] | (s["used"] + x["cost"] > budget), F.struct(s["used"].alias("used"), F.lit(True).alias("full"), s["taken"].alias("taken"))).otherwise(
            F.struct((s["used"] + x["cost"]).cast("int").alias("used"), F.lit(False).alias("full"), F.concat(s["taken"], F.array(x)).alias("taken"))
        ),
    )
    total = F.aggregate(items, F.lit(0), lambda s, x: (s + x["cost"]).cast("int"))
    return (
        F.when(total <= budget, items)
        .when(F.size(greedy["covered"]) == 0, first["taken"])
        .when(F.coalesce(single["n"], F.lit(0)) > F.size(greedy["covered"]), F.array(single["x"]))
        .otherwise(F.sort_array(greedy["taken"]))
    )


def compress(questions: DataFrame, served: DataFrame, budget: int = DEFAULTS.context_chars) -> DataFrame:
    """query_id, context, segments (whose sentences it has, in order) and covered (the question's words that it has).

    questions: query_id, query; served: query_id, segment, text.
    """
    rows = items_of(questions, served).withColumn("_taken", chosen(F.col("items"), budget))
    return rows.select(
        "query_id", F.array_join(F.col("_taken.sentence"), "\n").alias("context"), F.array_sort(F.array_distinct(F.col("_taken.segment"))).alias("segments"),
        F.size(F.array_distinct(F.flatten(F.col("_taken.terms")))).alias("covered"),
    )
