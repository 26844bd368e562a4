"""Chat formatting: a finite-state machine over roles, a declarative template, per-segment loss flags.

The template maps a role to its opening and closing control string and to a loss flag; a role that it
does not list gets the generic pair with its name inside. Every control string begins with ``<`` or
``[``. Inside texts and role names these two and ``&`` are written as entities, so no text can hold a
control string, and the formatting can be read back exactly.

Defined results: null texts and roles count as empty; turns are ordered by (turn, role, text), nulls
first, so ties and repeated rows are stable; a conversation with an invalid order of turns is still
formatted whole, with ``valid`` false; null conv_ids form one conversation; an empty table gives none;
other columns are ignored.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: role: (opening, closing, counts for the loss)
TEMPLATE = {
    "system": ("<<SYS>>", "<</SYS>>", False),
    "user": ("[INST]", "[/INST]", False),
    "assistant": ("<s>", "</s>", True),
}
#: state: {role: next state}; what isn't listed leads to "invalid"
MACHINE = {
    "start": {"system": "prompted", "user": "asked"},
    "prompted": {"user": "asked"},
    "asked": {"assistant": "answered"},
    "answered": {"user": "asked"},
}
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), (">", "&gt;"))
OTHER_OPEN, OTHER_CLOSE = "<role=", "</role>"


def escape(text: Column) -> Column:
    for raw, safe in ENTITIES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ENTITIES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def _lookup(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def _escaped_by_role(role: Column, place: int, other: Column) -> Column:
    return F.coalesce(F.try_element_at(_lookup({r: t[place] for r, t in TEMPLATE.items()}), role), other)


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, valid, segments, formatted); segments are (role, text, loss) in order."""
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    step = _lookup({f"{a} {role}": b for a, moves in MACHINE.items() for role, b in moves.items()})
    state = F.aggregate(
        "turns", F.lit("start"),
        lambda s, t: F.coalesce(F.try_element_at(step, F.concat_ws(" ", s, t["role"])), F.lit("invalid")),
    )

    def parts(t: Column) -> Column:
        role = t["role"]
        loss = F.coalesce(F.try_element_at(_lookup({r: x[2] for r, x in TEMPLATE.items()}), role), F.lit(False))
        opening = _escaped_by_role(role, 0, F.concat(F.lit(OTHER_OPEN), escape(role), F.lit(">")))
        closing = _escaped_by_role(role, 1, F.lit(OTHER_CLOSE))
        segment = lambda text, flag: F.struct(role.alias("role"), text.alias("text"), flag.alias("loss"))
        return F.array(segment(opening, F.lit(False)), segment(escape(t["text"]), loss), segment(closing, F.lit(False)))

    segments = F.flatten(F.transform("turns", parts))
    return whole.select("conv_id", F.size("turns").cast("long").alias("n_turns"), (state != "invalid").alias("valid"), segments.alias("segments")).withColumn(
        "formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "")
    )


def read_back(formatted: Column) -> Column:
    """The turns in a formatted conversation: an array of (role, text), unescaped."""
    opening = "|".join([rf"\Q{t[0]}\E" for t in TEMPLATE.values()] + [rf"{OTHER_OPEN}[^<\[>]*>"])
    pattern = F.lit(rf"({opening})([^<\[]*)(?:<<?/|\[/)")
    roles = F.regexp_extract_all(formatted, pattern, F.lit(1))
    texts = F.regexp_extract_all(formatted, pattern, F.lit(2))
    names = _lookup({t[0]: role for role, t in TEMPLATE.items()})
    inner = lambda m: F.substring(m, len(OTHER_OPEN) + 1, F.length(m) - len(OTHER_OPEN) - 1)
    return F.zip_with(roles, texts, lambda m, x: F.struct(
        F.coalesce(F.try_element_at(names, m), unescape(inner(m))).alias("role"), unescape(x).alias("text")
    ))


def chat_digest(turns: DataFrame) -> DataFrame:
    """``digest_of`` the formatted conversations."""
    return digest_of(format_conversations(turns))


def digest_of(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid), all read back from the output.

    The turns come from the formatted text, what is learnt from the segments under the loss mask.
    """
    out = formatted.select("conv_id", "valid", "formatted", "segments", read_back(F.col("formatted")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return out.withColumn("learnt", learnt).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )
