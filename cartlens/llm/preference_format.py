"""Operator 1: preference formatting.

A preference pair is a chosen and a rejected conversation.  Their longest common prefix of turns is rendered once, as the
prompt; what follows in each is rendered as its completion, with the character spans that carry loss (what the assistant
says, and the mark that ends its turn).  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartlens.llm.common import table

#: Around a turn's text: opening with the role in it, and end.
OPEN = "<|{role}|>\n"
CLOSE = "<|end|>\n"
LEARNED_ROLE = "assistant"
#: Buckets of ids in which a conversation's next one is looked for.
BUCKETS = 4093


def _opening(turn: Column, template: str) -> Column:
    before, _, after = template.partition("{role}")
    return F.concat(F.lit(before), F.coalesce(turn["role"], F.lit("")), F.lit(after))


def _render(turns: Column, opening: str, close: str) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(
        _opening(t, opening), F.coalesce(t["text"], F.lit("")), F.lit(close))), "")


def _mask(turns: Column, opening: str, close: str, role: str) -> Column:
    """Spans (start, end), in characters of the rendered turns, of the text and close of each turn of ``role``."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(at: Column, t: Column) -> Column:
        start = at["at"] + F.length(_opening(t, opening))
        end = start + F.length(F.coalesce(t["text"], F.lit(""))) + len(close)
        own = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == role, F.concat(at["spans"], own)).otherwise(at["spans"]).alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda at: at["spans"])


def common_turns(chosen: Column, rejected: Column) -> Column:
    """Number of turns (role and text, null equal to null) that two conversations have in common from the start."""
    same = F.zip_with(chosen, rejected, lambda a, b: a.isNotNull() & b.isNotNull() & a["role"].eqNullSafe(b["role"])
                      & a["text"].eqNullSafe(b["text"]))
    first_other = F.array_position(same, F.lit(False))
    return F.when(first_other > 0, first_other - 1).otherwise(F.size(same)).cast("int")


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected", opening: str = OPEN,
                 close: str = CLOSE, role: str = LEARNED_ROLE) -> DataFrame:
    """Add n_prefix, prompt, chosen_text, chosen_mask, rejected_text, rejected_mask and status to each pair.

    ``chosen`` and ``rejected`` are arrays of turns with fields role and text.  The prompt and a text in a row are a whole
    conversation; masks count characters from the start of the text.  status is ``identical`` where the conversations
    are the same, ``chosen_ends`` or ``rejected_ends`` where one is the beginning of the other and so has an empty text,
    and else ``ok``.  A null conversation counts as empty, null roles and texts render as empty.  All rows and columns
    stay, but columns of the added names are replaced; repeated rows are formatted each by itself.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    plain = lambda c: F.coalesce(F.transform(c, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))), empty)
    good, bad = plain(F.col(chosen)), plain(F.col(rejected))
    n = common_turns(good, bad)
    rest = lambda c: F.slice(c, n + 1, F.greatest(F.size(c) - n, F.lit(0)))
    status = (F.when((F.size(good) == n) & (F.size(bad) == n), "identical").when(F.size(good) == n, "chosen_ends")
              .when(F.size(bad) == n, "rejected_ends").otherwise("ok"))
    return pairs.withColumns({
        "n_prefix": n, "prompt": _render(F.slice(good, 1, n), opening, close),
        "chosen_text": _render(rest(good), opening, close), "chosen_mask": _mask(rest(good), opening, close, role),
        "rejected_text": _render(rest(bad), opening, close), "rejected_mask": _mask(rest(bad), opening, close, role),
        "status": status,
    })


def conversation_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected) from a table of turns (conv_id, turn, role, text).

    The chosen side is a conversation as it is.  For the rejected side, one of its replies (number conv_id modulo their
    count) is replaced by the last reply of the next conversation, and the conversation ends there.  Next is in the circle of
    all conversations with a reply, by (id modulo BUCKETS, id); so whatever the ids, every one of them makes a pair, unless it is
    the only one, which makes none.  Conversations without a reply make none either.  Repeated turns count once; turns
    without an id are left out.
    """
    convs = (turns.where("conv_id IS NOT NULL").groupBy("conv_id")
             .agg(F.array_distinct(F.sort_array(F.collect_list(F.struct("turn", "role", "text")))).alias("turns")))
    places = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["role"] == LEARNED_ROLE)
    convs = convs.withColumn("replies", places).where(F.size("replies") > 0)
    own = convs.withColumn("at", F.element_at("replies", (F.pmod("conv_id", F.size("replies")) + 1).cast("int")))
    said = convs.select("conv_id", F.pmod("conv_id", F.lit(BUCKETS)).alias("bucket"),
                        F.element_at("turns", F.element_at("replies", -1))["text"].alias("reply"))
    after = F.lead(F.struct("reply")).over(Window.partitionBy("bucket").orderBy("conv_id"))
    # the last of a bucket meets the first of the next one that is not empty: at most BUCKETS rows
    heads = said.groupBy("bucket").agg(F.min(F.struct("conv_id", "reply")).alias("head"))
    circle = Window.partitionBy().orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(F.col("bucket").alias("of"), F.coalesce(F.lead("head").over(Window.partitionBy().orderBy("bucket")),
                                                                 F.first("head").over(circle)).alias("head"))
    other = (said.withColumn("after", after).join(heads, F.col("bucket") == F.col("of"))
             .where(F.col("after").isNotNull() | (F.col("head.conv_id") != F.col("conv_id")))
             .select("conv_id", F.when(F.col("after").isNotNull(), F.col("after.reply")).otherwise(F.col("head.reply")).alias("other")))
    swapped = F.struct(F.lit(LEARNED_ROLE).alias("role"), F.col("other").alias("text"))
    two = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return own.join(other, "conv_id").select(
        "conv_id", two.alias("chosen"), F.concat(F.slice(two, F.lit(1), F.col("at") - 1), F.array(swapped)).alias("rejected"))


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs of all conversations with a reply, formatted; masks as start:end, comma-joined."""
    pairs = format_pairs(conversation_pairs(table(spark, sf_dir, "conversations")))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return pairs.select("conv_id", "n_prefix", "status", "prompt", "chosen_text", text(F.col("chosen_mask")).alias("chosen_mask"),
                        "rejected_text", text(F.col("rejected_mask")).alias("rejected_mask"))


OP1_SQL = """
WITH once AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id
                 ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM once),
reply AS (SELECT conv_id, text, pos, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS k,
                 count(*) OVER (PARTITION BY conv_id) AS n FROM numbered WHERE role = 'assistant'),
circle AS (SELECT conv_id, text, lead(conv_id) OVER w AS after, first_value(conv_id) OVER w AS head FROM reply WHERE k = n
           WINDOW w AS (ORDER BY ((conv_id % 4093) + 4093) % 4093, conv_id)),
pair AS (SELECT a.conv_id, a.pos AS spot, b.text AS other FROM reply a JOIN circle c USING (conv_id)
         JOIN circle b ON b.conv_id = coalesce(c.after, c.head) AND b.conv_id <> a.conv_id
         WHERE a.k = ((a.conv_id % a.n) + a.n) % a.n + 1),
side AS (SELECT 'c' AS side, conv_id, pos, role, text FROM numbered JOIN pair USING (conv_id)
         UNION ALL SELECT 'r', conv_id, pos, role, CASE WHEN pos = spot THEN other ELSE text END
         FROM numbered JOIN pair USING (conv_id) WHERE pos <= spot),
size AS (SELECT conv_id, count(*) FILTER (side = 'c') AS n_c, count(*) FILTER (side = 'r') AS n_r FROM side GROUP BY conv_id),
differs AS (SELECT c.conv_id, min(c.pos) AS pos FROM side c JOIN side r ON c.conv_id = r.conv_id AND c.pos = r.pos
            AND c.side = 'c' AND r.side = 'r' AND (c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text)
            GROUP BY c.conv_id),
prefix AS (SELECT conv_id, n_c, n_r, coalesce(pos - 1, least(n_c, n_r)) AS n FROM size LEFT JOIN differs USING (conv_id)),
drawn AS (SELECT side, conv_id, s.pos, role, n, s.pos > n AS after,
                 '<|' || coalesce(role, '') || '|>' || chr(10) AS head, coalesce(text, '') || '<|end|>' || chr(10) AS body
          FROM side s JOIN prefix USING (conv_id)),
placed AS (SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY side, conv_id, after ORDER BY pos
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start FROM drawn),
made AS (SELECT conv_id,
    string_agg(head || body, '' ORDER BY pos) FILTER (side = 'c' AND NOT after) AS prompt,
    string_agg(head || body, '' ORDER BY pos) FILTER (side = 'c' AND after) AS chosen_text,
    string_agg(start || ':' || (start + length(body)), ',' ORDER BY pos) FILTER (side = 'c' AND after AND role = 'assistant') AS chosen_mask,
    string_agg(head || body, '' ORDER BY pos) FILTER (side = 'r' AND after) AS rejected_text,
    string_agg(start || ':' || (start + length(body)), ',' ORDER BY pos) FILTER (side = 'r' AND after AND role = 'assistant') AS rejected_mask
    FROM placed GROUP BY conv_id)
SELECT conv_id, CAST(n AS INTEGER) AS n_prefix,
       CASE WHEN n_c = n AND n_r = n THEN 'identical' WHEN n_c = n THEN 'chosen_ends' WHEN n_r = n THEN 'rejected_ends' ELSE 'ok' END AS status,
       coalesce(prompt, '') AS prompt, coalesce(chosen_text, '') AS chosen_text, coalesce(chosen_mask, '') AS chosen_mask,
       coalesce(rejected_text, '') AS rejected_text, coalesce(rejected_mask, '') AS rejected_mask
FROM made JOIN prefix USING (conv_id)
"""
