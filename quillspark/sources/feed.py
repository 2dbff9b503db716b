"""The cost feed: nested dishes flattened to note lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEED_SCHEMA = (
    "totalDishes long, lastUpdated string, "
    "dishes array<struct<name: string, cost: struct<amount: string, unit: string>, lastUpdated: string, calculationNotes: string>>, "
    "buffetStats struct<buffetBasicoDishCount: long, averageCostBuffetBasico: double, buffetPremiumDishCount: long, "
    "averageCostBuffetPremium: double, cogsPerCustomerBuffetBasico: double, cogsPerCustomerBuffetPremium: double>"
)
SOURCE = "cost feed"


def parse_feed(raw: DataFrame, column: str = "value") -> DataFrame:
    """Typed feed documents from JSON text; what can't be read gives no rows."""
    return raw.select(F.from_json(F.col(column), FEED_SCHEMA).alias("f")).select("f.*").filter("dishes is not null")


def dish_lines(dishes: DataFrame) -> DataFrame:
    """dish_id, part, content: a cost line for each dish, and a breakdown where there are notes on it."""
    cost = F.concat(F.col("name"), F.lit(": "), F.col("amount"), F.lit(" "), F.col("unit"), F.lit(" to produce"))
    notes = F.concat(F.lit("COST BREAKDOWN - "), F.col("name"), F.lit(":\n\n"), F.col("calculation_notes"))
    parts = F.array_compact(
        F.array(
            F.struct(F.lit("cost").alias("part"), cost.alias("content")),
            F.when(F.coalesce("calculation_notes", F.lit("")) != "", F.struct(F.lit("breakdown").alias("part"), notes.alias("content"))),
        )
    )
    return dishes.select("dish_id", F.explode(parts).alias("p")).select("dish_id", "p.part", "p.content")


def feed_notes(feed: DataFrame) -> DataFrame:
    """content, ts (text), source of a feed: a summary, the dishes' lines, and statistics where given."""
    summary = feed.select(
        F.concat(F.lit("DISHES SUMMARY: "), F.col("totalDishes").cast("string"), F.lit(" dishes in production. Last updated: "), "lastUpdated").alias("content"),
        F.col("lastUpdated").alias("ts"),
    )
    exploded = feed.select(F.explode("dishes").alias("d"))
    dishes = exploded.select(
        F.col("d.name").alias("name"), F.col("d.cost.amount").alias("amount"), F.col("d.cost.unit").alias("unit"),
        F.col("d.calculationNotes").alias("calculation_notes"), F.col("d.lastUpdated").alias("dish_id"),
    )
    lines = dish_lines(dishes).select("content", F.col("dish_id").alias("ts"))
    s = "buffetStats"
    stats = feed.filter(F.col(s).isNotNull()).select(
        F.concat_ws(
            "\n",
            F.lit("BUFFET STATISTICS:"),
            F.format_string("• Basic: %d dishes, avg cost: %.2f MXN", f"{s}.buffetBasicoDishCount", f"{s}.averageCostBuffetBasico"),
            F.format_string("• Premium: %d dishes, avg cost: %.2f MXN", f"{s}.buffetPremiumDishCount", f"{s}.averageCostBuffetPremium"),
            F.format_string("• Per customer - Basic: %.2f MXN", f"{s}.cogsPerCustomerBuffetBasico"),
            F.format_string("• Per customer - Premium: %.2f MXN", f"{s}.cogsPerCustomerBuffetPremium"),
        ).alias("content"),
        F.col("lastUpdated").alias("ts"),
    )
    return summary.unionByName(lines).unionByName(stats).withColumn("source", F.lit(SOURCE))


def union_sources(messages: DataFrame, dishes: DataFrame) -> DataFrame:
    """content, source, ts: the user's notes and the feed's lines in one view."""
    own = messages.filter(F.col("type") == "note").select("content", F.lit("user input").alias("source"), "ts")
    fed = dish_lines(dishes).select("content", F.lit(SOURCE).alias("source"))
    return own.unionByName(fed, allowMissingColumns=True)
