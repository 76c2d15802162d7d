"""Conversation tables: recent messages, listings, appends, history text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.ranking import top_per_group

# Fixed values.
RECENT_MESSAGES = 10
HISTORY_MESSAGES = 6
LISTED_CONVERSATIONS = 50


def recent_messages(messages: DataFrame, limit: int = RECENT_MESSAGES) -> DataFrame:
    """Last messages per conversation: `age` 1 is the newest; sort by -age for reading order."""
    order = [F.col("created_at").desc(), F.col("id").desc()]
    return top_per_group(messages, ["conversation_id"], order, limit, rank="age")


def list_conversations(
    conversations: DataFrame, user_id: str | None = None, limit: int = LISTED_CONVERSATIONS
) -> DataFrame:
    """Most recently updated conversations, of one user when given."""
    if user_id is not None:
        conversations = conversations.filter(F.col("user_id") == user_id)
    return conversations.orderBy(F.col("updated_at").desc(), F.col("id")).limit(limit)


def list_per_user(conversations: DataFrame, limit: int = LISTED_CONVERSATIONS) -> DataFrame:
    """The same listing for every user at once."""
    order = [F.col("updated_at").desc(), F.col("id")]
    return top_per_group(conversations, ["user_id"], order, limit)


def look_up(wanted: DataFrame, conversations: DataFrame) -> DataFrame:
    """Wanted ids with their conversation; missing ids are reported by `found`."""
    known = conversations.withColumn("_hit", F.lit(True))
    return (
        wanted.join(known, "id", "left")
        .withColumn("found", F.coalesce("_hit", F.lit(False)))
        .drop("_hit")
    )


def append_messages(messages: DataFrame, new: DataFrame) -> DataFrame:
    return messages.unionByName(new, allowMissingColumns=True)


def create_conversations(conversations: DataFrame, new: DataFrame) -> DataFrame:
    """Adds conversations; a new one was last updated when it was created."""
    return conversations.unionByName(
        new.withColumn("updated_at", F.col("created_at")), allowMissingColumns=True
    )


def bump_updated(conversations: DataFrame, new_messages: DataFrame) -> DataFrame:
    """Conversations with `updated_at` moved to their newest appended message."""
    newest = new_messages.groupBy(F.col("conversation_id").alias("id")).agg(
        F.max("created_at").alias("_newest")
    )
    return (
        conversations.join(newest, "id", "left")
        .withColumn("updated_at", F.greatest("updated_at", "_newest"))
        .drop("_newest")
    )


def history_texts(messages: DataFrame, limit: int = HISTORY_MESSAGES) -> DataFrame:
    """Last messages as `role: content` lines, oldest first."""
    recent = recent_messages(messages, limit)
    lines = F.array_sort(
        F.collect_list(
            F.struct((-F.col("age")).alias("order"), F.concat("role", F.lit(": "), "content").alias("line"))
        )
    )
    return recent.groupBy("conversation_id").agg(
        F.array_join(F.transform(lines, lambda r: r["line"]), "\n").alias("history")
    )
