"""Task cards: a body, and a log of what the user said that only the engine writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import card_title, clip, one_line
from ..schema import CARD_COLLECTIONS
from .corpus import rules
from .search import Options, search
from .stats import home_project

LOG = "## User's own words"
TRIMMED = "- (earlier lines dropped)"
LOG_MAX, BODY_MAX, MESSAGE_MAX = 8000, 12000, 1000
#: Lines that a log has room for: the shortest is a mark, a time and their blanks, with a line break.
NEWEST = LOG_MAX // len("- 2024-01-01 00:00 \n")
#: A heading in a body that imitates the log's.
FAKE_LOG = r"(?im)^[ \t]*#{0,6}[ \t]*user.{0,3}s[ \t]+own[ \t]+words"
#: Unsaved prompts after which a reminder is due.
STALE_AFTER = 8


def split_card(text: str | Column) -> tuple[Column, Column]:
    """A card's body and its log lines."""
    text = F.col(text) if isinstance(text, str) else text
    at = F.instr(text, LOG)
    body = F.when(at == 0, text).otherwise(F.left(text, at - 1))
    lines = F.when(at == 0, F.array().cast("array<string>")).otherwise(F.filter(F.split(F.substr(text, at + len(LOG)), "\n"), lambda x: x.startswith("- ")))
    return F.trim(body, F.lit(" \t\r\n")), lines


def own_body(body: Column) -> Column:
    """The body up to a heading that imitates the log."""
    cut = F.get(F.split(body, FAKE_LOG, 2), F.lit(0))
    return clip(F.when(body.rlike(FAKE_LOG), F.trim(cut, F.lit(" \t\r\n"))).otherwise(body), BODY_MAX)


def kept_log(lines: Column) -> Column:
    """The newest lines that fit, one at least, after a mark where older ones were dropped."""
    real = F.filter(lines, lambda x: x != TRIMMED)
    newest = F.reverse(real)
    # lines from the newest back until one doesn't fit: reversed, those that fit are a prefix
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"))
    add = lambda s, x: F.struct((s["sum"] + F.char_length(x) + 1).alias("sum"), (s["n"] + (s["sum"] + F.char_length(x) + 1 <= LOG_MAX).cast("int")).alias("n"))
    fit = F.greatest(F.aggregate(newest, start, add)["n"], F.least(F.size(real), F.lit(1)))
    kept = F.reverse(F.slice(newest, F.lit(1), F.greatest(fit, F.lit(1))))
    dropped = (fit < F.size(real)) | F.array_contains(lines, TRIMMED)
    return F.when(F.size(real) == 0, real).when(dropped, F.concat(F.array(F.lit(TRIMMED)), kept)).otherwise(kept)


def compose(body: Column, lines: Column) -> Column:
    kept = kept_log(lines)
    return F.when(F.size(kept) == 0, body).otherwise(F.concat(body, F.lit(f"\n\n{LOG}\n"), F.array_join(kept, "\n")))


def appended(cards: DataFrame, said: DataFrame) -> DataFrame:
    """``cards`` (title, text) with what was said (title, at, message) added to their logs, in order.

    A log has room for ``NEWEST`` lines at most: of what was said under a title so many and one more are gathered, the newest.
    """
    entry = F.concat(F.lit("- "), F.date_format("at", "yyyy-MM-dd HH:mm"), F.lit(" "), clip(one_line("message"), MESSAGE_MAX))
    newest = Window.partitionBy("title").orderBy(F.desc("at"), F.desc("entry"))
    lines_said = said.select(card_title("title").alias("title"), "at", entry.alias("entry")).where("entry is not null")
    late = lines_said.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= NEWEST + 1)
    new = late.groupBy("title").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "entry"))), lambda x: x["entry"]).alias("new"))
    body, lines = split_card("text")
    joined = cards.join(new, "title", "left")
    return joined.withColumn("text", compose(body, F.concat(lines, F.coalesce("new", F.array().cast("array<string>"))))).drop("new")


def finished(memories: DataFrame, titles: DataFrame, done: bool = True) -> DataFrame:
    """The table with the cards of these titles (the first line) moved to the finished ones, or back."""
    source, target = CARD_COLLECTIONS if done else CARD_COLLECTIONS[::-1]
    chosen = titles.select(card_title("title").alias("__title")).distinct().withColumn("__chosen", F.lit(True))
    rows = memories.withColumn("__title", card_title(F.get(F.split("document", "\n"), F.lit(0)))).join(chosen, "__title", "left")
    return rows.withColumn("project", F.when(F.col("__chosen").isNotNull() & (F.col("project") == source), target).otherwise(F.col("project"))).select(*memories.columns)


def merged_list(matching: DataFrame, recent: DataFrame, n: int = 20) -> DataFrame:
    """Matching cards, then recent ones that aren't among them: (place, title)."""
    both = matching.select("title", "place", F.lit(0).alias("first")).unionByName(recent.select("title", "place", F.lit(1).alias("first")))
    once = both.withColumn("nth", F.row_number().over(Window.partitionBy("title").orderBy("first", "place"))).where("nth = 1")
    # both lists are short: a list has ``n`` cards at most
    return once.orderBy("first", "place").limit(n).select("title", "first", "place")


def earlier_rules(queries: DataFrame, memories: DataFrame, n: int = 10) -> DataFrame:
    """(query_id, place, id): for a new card, rules of the project that its durable hits are mostly in, then those hits; ten at most."""
    hits = search(queries, memories, Options(durable_only=True))
    home = home_project(hits)
    ruled = rules(memories).select("id", "project", "created_at").join(home, "project")
    newest = Window.partitionBy("query_id").orderBy(F.desc("created_at"), F.desc("id"))
    first = ruled.select("query_id", "id", F.lit(0).alias("part"), F.row_number().over(newest).alias("nth"))
    both = first.unionByName(hits.select("query_id", "id", F.lit(1).alias("part"), F.col("rank").alias("nth")))
    once = both.groupBy("query_id", "id").agg(F.min(F.struct("part", "nth")).alias("at"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("at", "id"))
    return once.withColumn("place", place).where(F.col("place") <= n).select("query_id", "place", "id")


def stale_prompts(events: DataFrame) -> DataFrame:
    """(session, at) of the prompts at which a reminder is due: the eighth since the session's last save, once."""
    order = Window.partitionBy("session").orderBy("at", "seq")
    saves = F.sum((F.col("kind") == "save").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = events.withColumn("since", saves).where("kind = 'prompt'")
    nth = F.row_number().over(Window.partitionBy("session", "since").orderBy("at", "seq"))
    return rows.withColumn("nth", nth).where(F.col("nth") == STALE_AFTER).select("session", "at")
