"""Column functions over conversations: ``array<struct<role string, content string>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import is_blank

ROLES = ("system", "user", "assistant")
BOS = "<|beginoftext|>"
EOS = "<|endoftext|>"
MESSAGES_TYPE = "array<struct<role string, content string>>"


def message(role: Column | str, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"))


def collect_messages(order: Column, role: Column, content: Column) -> Column:
    """Aggregate: the turns of one conversation in order."""
    turns = F.array_sort(F.collect_list(F.struct(order.alias("k"), role.alias("role"), content.alias("content"))))
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))


def valid_messages(messages: Column) -> Column:
    """At least two messages, known roles, non-blank contents, and an assistant at the end."""
    each = F.forall(
        messages,
        lambda m: F.coalesce(m["role"].isin(*ROLES), F.lit(False)) & ~is_blank(m["content"]),
    )
    last = F.coalesce(F.try_element_at(messages, F.lit(-1))["role"] == "assistant", F.lit(False))
    return F.coalesce((F.size(messages) >= 2) & each & last, F.lit(False))


def shared_prefix_length(left: Column, right: Column) -> Column:
    """How many leading messages two conversations have in common."""
    shorter = F.least(F.size(left), F.size(right))
    same = F.transform(
        F.sequence(F.lit(1), shorter),
        lambda i: F.element_at(left, i).eqNullSafe(F.element_at(right, i)),
    )
    first_difference = F.array_position(same, F.lit(False))
    return F.when(shorter <= 0, F.lit(0)).otherwise(
        F.when(first_difference == 0, shorter).otherwise(first_difference - 1)
    ).cast("int")


def split_pair(chosen: Column, rejected: Column) -> Column:
    """Struct of the shared prompt and the two remainders."""
    n = shared_prefix_length(chosen, rejected)
    rest = lambda m: F.slice(m, n + 1, F.greatest(F.size(m) - n, F.lit(0)))
    return F.struct(
        F.slice(chosen, F.lit(1), n).alias("prompt"),
        rest(chosen).alias("chosen"),
        rest(rejected).alias("rejected"),
    )


def _rendered(m: Column) -> Column:
    body = F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit(EOS + "\n"))
    return F.when(m["role"].isin(*ROLES), body).otherwise(
        F.raise_error(F.concat(F.lit("no template for messages of role "), F.coalesce(m["role"], F.lit("null"))))
    )


def chat_render(messages: Column, generation_prompt: bool = False) -> Column:
    """One training string for a conversation; an empty one has no begin token."""
    text = F.concat(
        F.when(F.size(messages) > 0, F.lit(BOS)).otherwise(F.lit("")),
        F.array_join(F.transform(messages, _rendered), ""),
    )
    return F.concat(text, F.lit("<|assistant|>\n")) if generation_prompt else text


def assistant_spans(messages: Column) -> Column:
    """Character spans ``[start, end)`` of :func:`chat_render` that carry loss.

    One running fold keeps the position; a span is the content of an assistant turn and its end
    token, without the role header and the final line break.
    """
    header = lambda m: F.length(m["role"]) + len("<||>\n")
    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    start = F.struct(F.lit(len(BOS)).alias("pos"), empty.alias("spans"))

    def step(acc: Column, m: Column) -> Column:
        begin = acc["pos"] + header(m)
        end = begin + F.length(m["content"]) + len(EOS)
        span = F.array(F.struct(begin.cast("int").alias("start"), end.cast("int").alias("end")))
        return F.struct(
            (end + 1).cast("int").alias("pos"),
            F.when(m["role"] == "assistant", F.concat(acc["spans"], span))
            .otherwise(acc["spans"])
            .alias("spans"),
        )

    return F.aggregate(messages, start, step, lambda acc: acc["spans"])
