"""Chat formatting as relational work: turns collected and sorted, same-role turns merged, texts joined.

A block holds one role: `<|im_start|>`, the role, a line feed, its turns with `<|turn|>` between
them, `<|im_end|>` and a line feed. Control strings inside texts get a backslash after their first
character (one more, if they have some already), so they are never taken for marks, and reading
back removes just that one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.cleaning import let

START, TURN, END = "<|im_start|>", "<|turn|>", "<|im_end|>\n"
CONTROL = r"\|im_start\|>|\|im_end\|>|\|turn\|>|/?s>|/?INST\]"
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(<|\[)(\\*)({CONTROL})", r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(<|\[)\\(\\*)({CONTROL})", "$1$2$3")


def role_out(role: Column) -> Column:
    """A role on one line: backslashes doubled, line feeds as \\n, control strings escaped."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def role_in(role: Column) -> Column:
    # A doubled backslash is set aside as NUL and NUL as NUL-1, so that the n after it isn't read as a line feed.
    own = F.replace(unescaped(role), F.lit("\x00"), F.lit("\x00\x01"))
    own = F.replace(F.replace(own, F.lit("\\\\"), F.lit("\x00\x02")), F.lit("\\n"), F.lit("\n"))
    return F.replace(F.replace(own, F.lit("\x00\x02"), F.lit("\\")), F.lit("\x00\x01"), F.lit("\x00"))


def formatted(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
              learned: str = LEARNED) -> DataFrame:
    """(conv_id, formatted, segments): a row per conversation; segments are (text, loss) in order, and join to `formatted`.

    Turns stand by number, then role, then text; a null number comes first, a null role or text is
    empty, and rows without a key are a conversation of their own. Repeated rows are turns of their
    own. `loss` marks the texts of the learned role, and nothing else. A conversation is one row of
    the result, so it has to fit one. No rows, no conversations.
    """
    pick = lambda name: F.col(f"`{name}`")
    rows = turns.select(pick(key).alias(key), F.struct(pick(turn).alias("turn"), F.coalesce(pick(role).cast("string"), F.lit("")).alias("role"),
                                                       F.coalesce(pick(text).cast("string"), F.lit("")).alias("text")).alias("__turn"))
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list("__turn")).alias("__turns"))

    def block_of(sorted_turns: Column):
        def block(at: Column, until: Column) -> Column:
            role_now = F.get(sorted_turns, at)["role"]
            loss = role_now == learned
            opening = F.concat(F.lit(START), role_out(role_now), F.lit("\n"))
            own = F.slice(sorted_turns, at + 1, until - at)
            inner = F.transform(
                own,
                lambda t, i: F.array(
                    F.struct(F.when(i == 0, opening).otherwise(F.lit(TURN)).alias("text"), F.lit(False).alias("loss")),
                    F.struct(escaped(t["text"]).alias("text"), loss.alias("loss")),
                ),
            )
            closing = F.array(F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")))
            return F.concat(F.flatten(inner), closing)

        return block

    def segments(sorted_turns: Column) -> Column:
        n, block = F.size(sorted_turns), block_of(sorted_turns)
        heads = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(sorted_turns, i)["role"] != F.get(sorted_turns, i - 1)["role"]))
        return let(heads, lambda h: F.flatten(F.transform(h, lambda at, k: block(at, F.coalesce(F.get(h, k + 1), n)))))

    out = grouped.select(key, let(F.col("__turns"), segments).alias("segments"))
    return out.select(key, F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted_text: Column) -> Column:
    """The (role, text) turns of a formatted conversation, from its marks alone."""

    def turns(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        body = F.substr(block, F.length(head) + 2)
        role = role_in(F.substr(head, F.lit(len(START) + 1)))
        return let(role, lambda r: F.transform(F.split(body, r"<\|turn\|>", -1), lambda t: F.struct(r.alias("role"), unescaped(t).alias("text"))))

    blocks = F.split(formatted_text, r"<\|im_end\|>\n", -1)
    return F.flatten(F.transform(F.filter(blocks, lambda b: b != ""), turns))


def digest(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """What reading back gives: turns and their hash, the text under the loss mask and its hash."""
    turns = F.array_join(F.transform(read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    return conversations.select(
        key, F.size(read_back(F.col("formatted"))).cast("bigint").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length(learned).cast("bigint").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
