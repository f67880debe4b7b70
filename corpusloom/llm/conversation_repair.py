"""Repair of conversation structure at the least cost (operator 11), in Spark SQL's higher-order functions.

Each turn's first fault counts: blank (no character but ASCII blanks), duplicate (role and text
have been seen earlier), truncated (the last character that is no blank isn't one of .!?).  Windows over a
conversation find them.  Then the cheapest edits are sought that make the roles `(s?(ua)+)?`, by initials:
an optional system turn, then user and assistant in turns.

    Keep 0   Rerole to user or assistant 2   Delete 3   Insert an empty user or assistant turn 2

Blank and duplicate turns are deleted; a truncated turn that isn't costs 1 more.  A conversation's turns,
collected and sorted, are folded by aggregate(), which carries for each of four states - nothing yet, after
a system turn, after a user, after an assistant - the least (cost, audit), by native least().  Of edits of
one cost the audit that is least in ASCII wins: two audits of one cost never begin with one another, so what
is least so far stays least.  Audits are kept short: a fold over BLOCK turns starts from the audits'
ranks, which are replaced by the audits at its end, so a long conversation isn't copied turn by turn.

One shuffle, by conversation.  A conversation is a row of the result, so one task holds it whole (2 GB at most);
that is the bound of this operator: a conversation isn't split, though its windows may spill.

Defined results: a null role or text is one space (so a null text is blank); turns with a null number come
first; turns of one number are ordered by role, then text; a null conv_id is a conversation;
repeated rows are duplicates; an empty table gives no rows; a role is taken by its first character,
and one that is none of s, u, a, as well as an empty one, can only be reroled or deleted; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only, table

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Turns between two replacements of audits by their ranks.
BLOCK = 256
#: Cost of a state that can't be reached.
NEVER = 1 << 40
STATES = ("nothing", "system", "user", "assistant")
#: Letters within the fold.  I and R are for user, J and S for assistant; at one place of two audits that agree so far only one of the two is possible.
PRINTED = ("JS", "IR")
NOT_BLANK = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"


def faults(turns: DataFrame) -> DataFrame:
    """conv_id, gone, turn, role, text, pos (from 1), initial, fault (blank, duplicate, truncated or null), illegal, new_turn of turns (conv_id, turn, role, text, gone).

    Rows with `gone` don't belong to the conversation and see none of its rows.
    """
    t = turns.select("conv_id", "gone", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    t = t.withColumn("initial", F.substring("role", 1, 1)).repartition("conv_id")  # windows and groups find their rows together
    w = Window.partitionBy("conv_id", "gone").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    t = t.withColumns({"pos": F.row_number().over(w), "previous": F.lag("initial").over(w), "last_turn": F.lag("turn").over(w)})
    t = t.withColumn("copy", F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy("pos")))
    fault = F.when(~F.rlike("text", F.lit(NOT_BLANK)), "blank").when(F.col("copy") > 1, "duplicate").when(~F.rlike("text", F.lit(ENDED)), "truncated")
    return t.select(
        "conv_id", "gone", "turn", "role", "text", "pos", "initial", fault.alias("fault"),
        ((F.col("pos") > 1) & ~F.concat("previous", "initial").isin("su", "ua", "au")).alias("illegal"),
        (F.col("turn").isNotNull() & (F.col("last_turn").isNull() | (F.col("last_turn") != F.col("turn")))).alias("new_turn"),
    )


def _with(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _edit(state: Column, cost: Column | int, letter: Column | str) -> Column:
    cost, letter = (x if isinstance(x, Column) else F.lit(x) for x in (cost, letter))
    return F.struct((state["cost"] + cost).cast("bigint").alias("cost"), F.concat(state["audit"], letter).alias("audit"))


def _states(*values: Column) -> Column:
    return F.struct(*(v.alias(n) for n, v in zip(STATES, values, strict=True)))


def _inserted(at: Column) -> Column:
    """The states after any inserts."""
    user = F.least(at["user"], *(_edit(at[s], INSERT, "I") for s in ("nothing", "system", "assistant")))
    return _with(user, lambda u: _states(at["nothing"], at["system"], u, F.least(at["assistant"], _edit(u, INSERT, "J"))))


def _step(at: Column, turn: Column) -> Column:
    """The states after a turn (initial, lost, cut): inserts, then one edit of the turn."""

    def edited(c: Column) -> Column:
        stays = ~turn["lost"]
        cut = F.when(turn["cut"], TRUNCATED).otherwise(0)

        def put(state: Column, role: str, other: str) -> Column:
            keep = turn["initial"] == role
            return F.when(stays, _edit(state, cut + F.when(keep, 0).otherwise(REROLE), F.when(keep, "K").otherwise(other)))

        removed = [_edit(c[s], DELETE, "D") for s in STATES]
        return _states(
            removed[0],
            F.least(removed[1], F.when(stays & (turn["initial"] == "s"), _edit(c["nothing"], cut, "K"))),
            F.least(removed[2], put(F.least(c["nothing"], c["system"], c["assistant"]), "u", "R")),
            F.least(removed[3], put(c["user"], "a", "S")),
        )

    return _with(_inserted(at), edited)


def _block(at: Column, turns: Column) -> Column:
    """The states after a block of turns.  Before an insert, no audit begins with another, so their ranks compare like them."""

    def folded(order: Column) -> Column:
        ranked = _states(*(F.struct(at[s]["cost"].alias("cost"), F.array_position(order, at[s]["audit"]).cast("string").alias("audit")) for s in STATES))
        whole = lambda x: F.struct(x["cost"].alias("cost"), F.concat(F.element_at(order, F.substring(x["audit"], 1, 1).cast("int")), F.substr(x["audit"], F.lit(2))).alias("audit"))
        return _with(F.aggregate(turns, ranked, _step), lambda end: _states(*(whole(end[s]) for s in STATES)))

    return _with(F.array_sort(F.array(*(at[s]["audit"] for s in STATES))), folded)


def cheapest(turns: Column) -> Column:
    """(cost, audit) of the cheapest edits of an array of turns (initial, lost, cut); the audit in the fold's letters."""
    state = lambda cost: F.struct(F.lit(cost).cast("bigint").alias("cost"), F.lit("").alias("audit"))
    n = F.size(turns)
    blocks = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(BLOCK)), lambda k: F.slice(turns, k + 1, BLOCK))).otherwise(F.array(turns))
    start = _states(state(0), *(state(NEVER) for _ in STATES[1:]))
    return F.aggregate(blocks, start, _block, lambda end: _with(_inserted(end), lambda c: F.least(c["nothing"], c["assistant"])))


def edited(turns: Column, audit: Column) -> Column:
    """The turns (role, text) that an audit in the fold's letters leaves of an array of turns (role, text, ...)."""
    line = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    new = lambda letters: F.transform(F.filter(F.split(letters, ""), lambda x: x != ""), lambda x: line(F.when(x == "I", "user").otherwise("assistant"), F.lit("")))
    of_turn = F.regexp_extract_all(audit, F.lit("[IJ]*[KRSD]"), F.lit(0))

    def after(x: Column, letters: Column) -> Column:
        last = F.substring(letters, -1, 1)
        role = F.when(last == "K", x["role"]).when(last == "R", "user").otherwise("assistant")
        kept = F.when(last == "D", F.slice(F.array(line(role, x["text"])), 1, 0)).otherwise(F.array(line(role, x["text"])))
        return F.concat(new(F.substring(letters, F.lit(1), F.length(letters) - 1)), kept)

    return F.concat(F.flatten(F.zip_with(turns, of_turn, after)), new(F.regexp_extract(audit, r"[IJ]*\z", 0)))


def repair(turns: DataFrame, *, gone: str | None = None) -> DataFrame:
    """A row for each conv_id of turns (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired (an array of role, text).

    gone: a column that is true for rows which only make their conversation appear in the result.
    """
    t = only(turns, "conv_id", "turn", "role", "text", *([gone] if gone else []))
    t = faults(t.withColumnRenamed(gone, "gone") if gone else t.withColumn("gone", F.lit(False)))
    here = lambda c: F.count_if(~F.col("gone") & c)
    number = F.when(~F.col("gone"), F.col("turn"))
    row = F.when(~F.col("gone"), F.struct("pos", "initial", F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).alias("lost"), F.coalesce(F.col("fault") == "truncated", F.lit(False)).alias("cut"), "role", "text"))
    each = t.groupBy("conv_id").agg(
        F.coalesce(F.max(number) - F.min(number) + 1 - here(F.col("new_turn")), F.lit(0)).cast("bigint").alias("gaps"),
        *(here(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")),
        here(F.col("illegal")).alias("illegal"),
        F.sort_array(F.collect_list(row)).alias("turns"),
    )
    light = F.transform("turns", lambda x: F.struct(x["initial"].alias("initial"), x["lost"].alias("lost"), x["cut"].alias("cut")))
    each = each.withColumn("best", cheapest(light))
    return each.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"),
        F.translate("best.audit", *PRINTED).alias("audit"), edited(F.col("turns"), F.col("best.audit")).alias("repaired"),
    )


def damage(conversations: DataFrame) -> DataFrame:
    """Turns damaged by the CRC-32 of conv_id:turn modulo 20: 0 drops one (gone), 1 empties its text, 2 removes its .!?, 3 repeats it, 4 makes it the user's."""
    t = only(conversations, "conv_id", "turn", "role", "text").select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    k = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))).cast("binary")) % 20
    t = t.withColumn("k", k)
    t = t.select(
        "conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("k") == 0).alias("gone"), F.explode(F.when(F.col("k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return t.drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = repair(damage(table(spark, sf_dir, "conversations")), gone="gone")
    text = F.array_join(F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    return t.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(text, 256).alias("repaired_sha256"))


def _put(state: str, cost: str, letter: str) -> str:
    return f"(lpad((substr({state}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({state}, 10) || {letter})"


_AFTER = f"least(u, {_put('z', '2', chr(39) + 'I' + chr(39))}, {_put('s', '2', chr(39) + 'I' + chr(39))}, {_put('a', '2', chr(39) + 'I' + chr(39))})"
SQL = rf"""
WITH RECURSIVE byte AS (
  SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM (SELECT unnest(range(256)) AS i))
), raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS k
  FROM conversations, byte
), d AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM raw, range(2) g(i) WHERE k > 0 AND (i = 0 OR k = 3)
), o AS (
  SELECT *, substr(role, 1, 1) AS ini, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM d
), o2 AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS dup FROM o
), r AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN dup THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault,
    coalesce(lag(ini) OVER (PARTITION BY conv_id ORDER BY pos) || ini NOT IN ('su', 'ua', 'au'), false) AS illegal FROM o2
), st AS (
  SELECT conv_id, 0::BIGINT AS pos, '000000000' AS z, '500000000' AS s, '500000000' AS u, '500000000' AS a FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, pos + 1, {_put('z', '3', "'D'")},
    least({_put('s', '3', "'D'")}, CASE WHEN stays AND ini = 's' THEN {_put('z', 'cut', "'K'")} END),
    least({_put('u1', '3', "'D'")}, CASE WHEN stays THEN {_put('least(z, s, a1)', "cut + CASE WHEN ini = 'u' THEN 0 ELSE 2 END", "CASE WHEN ini = 'u' THEN 'K' ELSE 'R' END")} END),
    least({_put('a1', '3', "'D'")}, CASE WHEN stays THEN {_put('u1', "cut + CASE WHEN ini = 'a' THEN 0 ELSE 2 END", "CASE WHEN ini = 'a' THEN 'K' ELSE 'S' END")} END)
  FROM (
    SELECT x.conv_id, x.pos, z, s, u1, least(a, {_put('u1', '2', "'J'")}) AS a1, ini, fault NOT IN ('b', 'd') AS stays, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS cut
    FROM (SELECT *, {_AFTER} AS u1 FROM st) x JOIN r ON r.conv_id IS NOT DISTINCT FROM x.conv_id AND r.pos = x.pos + 1
  )
), best AS (
  SELECT conv_id, least(z, a, {_put('u1', '2', "'J'")}) AS b FROM (SELECT *, {_AFTER} AS u1 FROM st QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1)
), lines AS (
  SELECT best.conv_id, r.pos, l, regexp_replace(regexp_replace(substr(l, 1, len(l) - 1), 'I', 'user:' || chr(10), 'g'), 'J', 'assistant:' || chr(10), 'g') || CASE right(l, 1) WHEN 'D' THEN '' WHEN 'K' THEN role || ':' || text || chr(10) WHEN 'R' THEN 'user:' || text || chr(10) ELSE 'assistant:' || text || chr(10) END AS line
  FROM (SELECT conv_id, regexp_extract_all(substr(b, 10), '[IJ]*[KRSD]') AS ls FROM best) best JOIN r ON r.conv_id IS NOT DISTINCT FROM best.conv_id, LATERAL (SELECT ls[r.pos] AS l)
), joined AS (SELECT conv_id, string_agg(line, '' ORDER BY pos) AS body FROM lines GROUP BY conv_id),
n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'b') AS blank, count_if(fault = 'd') AS duplicate, count_if(fault = 't') AS truncated, count_if(illegal) AS illegal FROM r GROUP BY conv_id
), whole AS (
  SELECT best.conv_id, b, coalesce(body, '') || regexp_replace(regexp_replace(regexp_extract(substr(b, 10), '[IJ]*$'), 'I', 'user:' || chr(10), 'g'), 'J', 'assistant:' || chr(10), 'g') AS t FROM best LEFT JOIN joined ON joined.conv_id IS NOT DISTINCT FROM best.conv_id
)
SELECT w.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  substr(b, 1, 9)::BIGINT AS cost, translate(substr(b, 10), 'JS', 'IR') AS audit, sha256(CASE WHEN t = '' THEN '' ELSE substr(t, 1, len(t) - 1) END) AS repaired_sha256
FROM whole w LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id
"""
