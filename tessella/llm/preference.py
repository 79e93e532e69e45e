"""Chat formatting for preference training: one prompt, two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.placement import unique_places
from .common import whole_row

#: How a turn is rendered: the role between OPEN and CLOSE, the text, the end of the turn.
OPEN, CLOSE, STOP = "<|", "|>\n", "<|end|>\n"
TURNS = "array<struct<role:string,text:string>>"
RESULTS = ("n_prompt_turns", "prompt", "chosen_text", "rejected_text", "chosen_loss", "rejected_loss")


def _render(turns: str) -> str:
    return f"array_join(transform({turns}, t -> concat('{OPEN}', t.role, '{CLOSE}', t.text, '{STOP}')), '')".replace("\n", "\\n")


def _spans(turns: str, role: str) -> str:
    """Where the loss counts: begin and end, in characters of the rendered turns, of each text and end of turn that role
    says. A turn's place is the length of what is rendered before it."""
    head, around = len(OPEN) + len(CLOSE), len(OPEN) + len(CLOSE) + len(STOP)
    step = f"named_struct('at', s.at + {around} + length(t.role) + length(t.text), 'spans', if(t.role = '{role}', concat(s.spans, array(named_struct('begin', s.at + {head} + length(t.role), 'end', s.at + {around} + length(t.role) + length(t.text)))), s.spans))"
    return f"aggregate({turns}, named_struct('at', 0, 'spans', cast(array() as array<struct<begin:int,end:int>>)), (s, t) -> {step}, s -> s.spans)"


def format_preferences(pairs: DataFrame, chosen_col: str = "chosen", rejected_col: str = "rejected", learned_role: str = "assistant") -> DataFrame:
    """Adds to pairs of conversations (columns of type TURNS) their training form.

    The longest common prefix of turns, equal in role and text, is rendered once as prompt; what follows in each is a
    completion, with the spans of learned_role's turns, the rest is masked. Without a rejected conversation the prompt
    ends before the last turn of learned_role (at the end, if it has none). Null roles and texts are empty; a null chosen
    conversation has no turns. Of equal conversations both completions are empty; if one begins with the other, that
    other's is.

    Replaces both columns by n_prompt_turns int, prompt, chosen_text, rejected_text string, chosen_loss, rejected_loss
    array of (begin, end); the rejected ones are null without a rejected conversation. Other columns are kept, but for those
    that have the name of a result. Texts of any length are rendered whole; repeated rows give repeated results; empty input
    gives no rows. Works row by row: no shuffle.
    """

    def clean(c: Column) -> Column:
        return F.transform(c, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))

    other = [c for c in pairs.columns if c not in (chosen_col, rejected_col, *RESULTS)]
    held = pairs.select(whole_row(pairs, other).alias("_row"), F.coalesce(clean(F.col(chosen_col)), F.expr(f"cast(array() as {TURNS})")).alias("c"), clean(F.col(rejected_col)).alias("r"))
    common = "least(size(c), size(r))"
    differ = f"coalesce(array_min(filter(transform(c, (t, i) -> if(i < {common} and t <> r[i], i, null)), i -> i is not null)), {common})"
    last = f"coalesce(array_max(filter(transform(c, (t, i) -> if(t.role = '{learned_role}', i, null)), i -> i is not null)), size(c))"
    held = held.withColumn("n", F.expr(f"if(r is null, {last}, {differ})"))
    held = held.select("_row", "n", F.expr("slice(c, 1, n)").alias("p"), F.expr("slice(c, n + 1, size(c))").alias("c"), F.expr("slice(r, n + 1, size(r))").alias("r"))
    return held.select(
        "_row.*",
        F.col("n").alias("n_prompt_turns"),
        F.expr(_render("p")).alias("prompt"),
        F.expr(_render("c")).alias("chosen_text"),
        F.expr(_render("r")).alias("rejected_text"),
        F.expr(_spans("c", learned_role)).alias("chosen_loss"),
        F.when(F.col("r").isNotNull(), F.expr(_spans("r", learned_role))).alias("rejected_loss"),
    )


def pair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learned_role: str = "assistant") -> DataFrame:
    """Pairs of conversations that begin with the same turn: (pair_id, chosen_id, rejected_id, chosen, rejected).

    Conversations are put together from their turns, in the order of turn, role and text (null first; a null
    conversation id is a conversation of its own; repeated turns are said twice). Ids are of any type that has an order;
    other columns are ignored; empty input gives no rows. Those of one first turn are ordered by id and taken two by two; of a
    pair, the one with more characters by learned_role is chosen, of equal ones the first. One that is left over has no
    rejected conversation, so that every conversation is in the result once. pair_id is the first one's id.

    A first turn may begin a third of all conversations: only ids and first turns' digests are ordered, within ranges of
    ids that hold equal shares whatever the ids are, and the counts of the ranges before are added, so that no task sees all
    of them. A single conversation is one row.
    """
    picked = turns.select(F.col(conv_col).alias("id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    whole = picked.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("ts")).select("id", F.expr("transform(ts, t -> named_struct('role', t.role, 'text', t.text))").alias("turns"))
    said = F.expr(f"aggregate(turns, 0L, (n, t) -> n + if(t.role = '{learned_role}', length(t.text), 0))")
    first = F.sha2(F.to_json(F.element_at("turns", 1)), 256)
    keyed = whole.select("id", "turns", said.alias("said"), first.alias("key"))
    places = unique_places(keyed.select("id", "key"), ["key"], ["id"]).select(F.col("id").alias("_id"), (F.col("place") - 1).alias("place"))
    placed = keyed.join(places, keyed["id"].eqNullSafe(places["_id"]))
    two = placed.groupBy("key", F.expr("place div 2").alias("pair")).agg(F.sort_array(F.collect_list(F.struct("place", "id", "said", "turns"))).alias("m"))  # two at most
    swap = F.coalesce(F.expr("get(m, 1).said > m[0].said"), F.lit(False))
    two = two.withColumn("swap", swap).withColumn("second", F.expr("get(m, 1)"))
    return two.select(
        F.expr("m[0].id").alias("pair_id"),
        F.expr("if(swap, second.id, m[0].id)").alias("chosen_id"),
        F.expr("if(swap, m[0].id, second.id)").alias("rejected_id"),
        F.expr("if(swap, second.turns, m[0].turns)").alias("chosen"),
        F.expr("if(swap, m[0].turns, second.turns)").alias("rejected"),
    )


#: The same result in DuckDB's SQL, with spans as text.
PREFERENCE_SQL = """
WITH c AS (
  SELECT conv_id AS id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(coalesce(text, '')) ELSE 0 END) AS BIGINT) AS said
  FROM conversations GROUP BY conv_id
), k AS (
  SELECT *, row_number() OVER (PARTITION BY turns[1] ORDER BY id NULLS FIRST) - 1 AS place FROM c
), p AS (
  SELECT a.id AS pair_id, coalesce(b.said > a.said, false) AS swap, a.id AS ai, b.id AS bi, a.turns AS first_turns, b.turns AS second_turns
  FROM k a LEFT JOIN k b ON a.turns[1] = b.turns[1] AND b.place = a.place + 1 WHERE a.place % 2 = 0
), q AS (
  SELECT pair_id, CASE WHEN swap THEN bi ELSE ai END AS chosen_id, CASE WHEN swap THEN ai ELSE bi END AS rejected_id,
    CASE WHEN swap THEN second_turns ELSE first_turns END AS c, CASE WHEN swap THEN first_turns ELSE second_turns END AS r FROM p
), n AS (
  SELECT *, CAST(CASE WHEN r IS NULL
    THEN coalesce(list_max(list_filter(range(1, len(c) + 1), lambda i: c[i].role = 'assistant')) - 1, len(c))
    ELSE coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i] <> r[i])) - 1, least(len(c), len(r))) END AS INTEGER) AS n FROM q
), s AS (
  SELECT pair_id, chosen_id, rejected_id, n, c[1:n] AS p, c[n + 1:] AS c, r[n + 1:] AS r FROM n
)
SELECT pair_id, chosen_id, rejected_id, n AS n_prompt_turns,
  coalesce(list_aggregate(list_transform(p, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), 'string_agg', ''), '') AS prompt,
  coalesce(list_aggregate(list_transform(c, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), 'string_agg', ''), '') AS chosen_text,
  CASE WHEN r IS NOT NULL THEN coalesce(list_aggregate(list_transform(r, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), 'string_agg', ''), '') END AS rejected_text,
  coalesce(list_aggregate(list_transform(list_filter(range(1, len(c) + 1), lambda i: c[i].role = 'assistant'), lambda i:
    CAST(coalesce(list_sum(list_transform(c[1:i - 1], lambda t: 13 + length(t.role) + length(t.text))), 0) + 5 + length(c[i].role) AS BIGINT) || '-' ||
    CAST(coalesce(list_sum(list_transform(c[1:i], lambda t: 13 + length(t.role) + length(t.text))), 0) AS BIGINT)), 'string_agg', ','), '') AS chosen_loss,
  CASE WHEN r IS NOT NULL THEN coalesce(list_aggregate(list_transform(list_filter(range(1, len(r) + 1), lambda i: r[i].role = 'assistant'), lambda i:
    CAST(coalesce(list_sum(list_transform(r[1:i - 1], lambda t: 13 + length(t.role) + length(t.text))), 0) + 5 + length(r[i].role) AS BIGINT) || '-' ||
    CAST(coalesce(list_sum(list_transform(r[1:i], lambda t: 13 + length(t.role) + length(t.text))), 0) AS BIGINT)), 'string_agg', ','), '') END AS rejected_loss
FROM s
"""


def spans_as_text(formatted: DataFrame) -> DataFrame:
    """The loss spans as begin-end, with commas between, for comparison by value."""
    return formatted.withColumns({c: F.expr(f"array_join(transform({c}, s -> concat(s.begin, '-', s.end)), ',')") for c in ("chosen_loss", "rejected_loss")})
